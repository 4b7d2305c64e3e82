"""Packing by power-of-two decomposition.

A document of n tokens is cut into n div MAX_LENGTH pieces of MAX_LENGTH and one piece for each binary digit of the rest, longest
first. Every piece is a sequence of its own whose length is a power of two, so nothing is padded and no sequence holds two documents. ``write_buckets`` puts equal lengths into one folder,
from which batches are cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subledger.llm.words import WordTable, groups

_BEFORE_MARK = re.compile(rb"([.,!?;:]+)(?<=[a-z0-9][.,!?;:])(?=\s)")
MAX_LENGTH = 2048
END_ID = 1
#: Spark's setting for how many files of a partitioned write a task keeps open before it sorts.
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


class WordTokens(WordTable):
    """Token ids by word. White space always parts tokens in this vocabulary, so a text's ids are its words' ids in turn."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ending = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ending[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        super().__init__(most_words=1_000_000)

    def _forget(self) -> None:
        super()._forget()
        self.ids, self.first = np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64)

    def _each(self, texts: list[str], which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, number of ids, ids) of the words, each encoded as a word of its own."""
        sizes, found = np.zeros(len(which), np.int64), [np.zeros(0, np.uint32)]
        for at in range(0, len(which), 4096):
            some = [texts[i] for i in which[at : at + 4096]]
            encoded = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            found.append(np.array(encoded.ids, np.uint32))
            sizes[at : at + len(some)] = np.bincount(np.array(encoded.word_ids, np.int64), minlength=len(some))
        return which, sizes, np.concatenate(found)

    def _together(self, texts: list[str], which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for words of letters: encoded as one text, where the last id of every word is one that ends a word."""
        sizes, found = np.zeros(len(which), np.int64), [np.zeros(0, np.uint32)]
        for at in range(0, len(which), 4096):
            some = which[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(texts[i] for i in some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ending[ids])
            if len(ends) != len(some):  # lower-casing made something else of a letter
                _, sizes[at : at + len(some)], ids = self._each(texts, some)
            else:
                sizes[at : at + len(some)] = np.diff(ends, prepend=-1)
            found.append(ids)
        return which, sizes, np.concatenate(found)

    def compute(self, words: list[bytes]) -> np.ndarray:
        """Appends to ``ids``; the rows are the words' (first, length) there."""
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = np.fromiter((t.isalpha() for t in texts), bool, len(texts))
        parts = [self._together(texts, np.flatnonzero(plain)), self._each(texts, np.flatnonzero(~plain))]
        order = np.argsort(np.concatenate([p[0] for p in parts]), kind="stable")
        sizes = np.concatenate([p[1] for p in parts])
        lengths = sizes[order]
        from_start = (np.cumsum(sizes) - sizes)[order]
        new = np.concatenate([p[2] for p in parts])[np.repeat(from_start - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))]
        end = int(self.first[-1])
        while end + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[end : end + len(new)] = new
        first = end + np.cumsum(lengths) - lengths
        self.first = np.array([end + len(new)])
        return np.stack([first, lengths], 1)


def token_words(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """Words whose tokens, one after the other, are the texts' tokens, and where each text's words begin.

    The vocabulary lower-cases and parts a letter or digit from a mark that follows; doing both first leaves fewer different words. Texts that could hold a special token stay as they are.
    """
    words, starts = [], np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        if t:
            raw = t.encode("utf-8", "replace")
            words += (raw if b"<|" in raw else _BEFORE_MARK.sub(rb" \1", raw.lower())).split()
        starts[i + 1] = len(words)
    return words, starts


def piece_lengths(n: int, most: int = MAX_LENGTH) -> list[int]:
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if rest >> b & 1]


def _pack(batches: Iterator[pa.RecordBatch], path: str, most: int, end_id: int) -> Iterator[pa.RecordBatch]:
    table = WordTokens(path)
    for batch in groups(batches):
        words, starts = token_words(batch.column("text").to_pylist())
        number, rows = table.look_up(words)
        first, length = rows[number].T if words else (np.zeros(0, np.int64),) * 2
        ends = np.concatenate([[0], np.cumsum(length)])
        # One slot after each document's tokens for the end id.
        n = ends[starts[1:]] - ends[starts[:-1]] + 1
        place = ends[:-1] + np.repeat(np.arange(len(n)), np.diff(starts))
        flat = np.full(int(n.sum()), end_id, np.uint32)
        within = np.arange(int(length.sum())) - np.repeat(ends[:-1], length)
        flat[np.repeat(place, length) + within] = table.ids[np.repeat(first, length) + within]
        cuts = [piece_lengths(int(x), most) for x in n]
        counts = np.array([len(c) for c in cuts])
        sizes = np.array([x for c in cuts for x in c], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        owner = np.repeat(np.arange(len(n)), counts)
        begin = np.cumsum(n) - n
        data = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(flat.astype("<u4"))])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner)), pa.array(offsets[:-1] - begin[owner]), pa.array(sizes), pa.array(n[owner]), data], ["doc_id", "start", "length", "doc_tokens", "ids"])


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_length: int = MAX_LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit), sequence_id, offset.

    A null text counts as empty; an empty text is one piece of the end id alone. Each row of ``docs`` is packed by itself, so repeated rows and null ids
    get sequences of their own; other columns play no part, whatever their names. No rows give no rows. ``max_length`` is a power of two. ``sequence_id`` is unique; it follows the input's files and splits.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = rows.mapInArrow(lambda batches: _pack(batches, tokenizer_path, max_length, end_id), "doc_id long, start long, length long, doc_tokens long, ids binary")
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> DataFrame:
    """Write the sequences to ``path``/bucket=LENGTH/ and return the table as read from there: all sequences of one length lie together, ready to be cut into batches without padding.

    Each task writes its own pieces, one file for each of the log2(max_length) + 1 lengths at most, without a shuffle; it keeps all of them open, so that it needn't sort by length.
    """
    spark, rows = pieces.sparkSession, pieces.withColumn("bucket", F.col("length").cast("int"))
    before = spark.conf.get(OPEN_FILES)
    spark.conf.set(OPEN_FILES, "32")
    try:
        rows.write.option("parquet.enable.dictionary#ids", "false").partitionBy("bucket").parquet(path)
    finally:
        spark.conf.set(OPEN_FILES, before)
    return spark.read.schema(rows.schema).parquet(path)
