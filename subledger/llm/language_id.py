"""Language identification by multilingual mixture inference.

Each language has a character-trigram model, counted over all labelled rows. A document is a mixture of languages: its words are draws from them, and a word's likelihood in a
language is that of its trigrams. Expectation-maximisation estimates the proportions. The set of languages is the one whose likelihood, less PENALTY times the
log of the number of words for each language after the first, is largest. It is looked for step by step: the best single language, then the one that adds most, while it pays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subledger.llm.words import WordTable, groups, split_all, sums_by

#: Trigrams are hashed into so many rows for each language.
BUCKETS = 1 << 15
#: Added to each count.
SMOOTHING = 0.5
PENALTY = 2.0
STEPS = 12
#: A word's log likelihoods are capped to this far below its best language, so that one word can't outvote a document.
MOST_APART = 12.0

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the trigrams of each word's letters, lower-cased, with a blank for what is no letter and at both ends; where each word's begin)."""
    marked = [" " + w.decode("utf-8", "replace").lower() + " " for w in words]
    if not marked:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(marked)), np.fromiter(map(len, marked), np.int64, len(marked)))
    is_letter = letters()[codes]
    plain = np.where(is_letter, codes, 32).astype(np.uint64)
    at = np.flatnonzero(is_letter)
    key = (plain[at - 1] * np.uint64(0x1F123BB5) + plain[at] * np.uint64(0x9E3779B9)) * np.uint64(0x85EBCA77) + plain[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F)
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    return key.astype(np.int64), np.searchsorted(owner[at], np.arange(len(marked) + 1))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in groups(batches):
        langs = batch.column("lang").to_pylist()
        words, starts = split_all(batch.column("text").to_pylist())
        names, number = np.unique(np.array(words, object), return_inverse=True) if words else (np.zeros(0, object), np.zeros(0, np.int64))
        buckets, begin = trigrams(list(names))
        of_doc = np.array([sorted(set(langs)).index(x) for x in langs])
        word_lang = np.repeat(of_doc, np.diff(starts))
        for k, lang in enumerate(sorted(set(langs))):
            times = np.bincount(number[word_lang == k], minlength=len(names))
            counts = np.bincount(buckets, np.repeat(times, np.diff(begin)), BUCKETS)
            total[lang] = total.get(lang, 0) + counts
    for lang, counts in total.items():
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(counts[some].astype(np.int64))], ["lang", "bucket", "n"])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log probability of each bucket in each): counted over all rows with a text and a language.

    What reaches the driver has one number for each language and bucket, however many rows there are.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    counts = rows.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    table = np.full((len(langs), BUCKETS), SMOOTHING)
    if langs:
        place = {lang: k for k, lang in enumerate(langs)}
        row = np.fromiter((place[x] for x in counts.column("lang").to_pylist()), np.int64, counts.num_rows)
        np.add.at(table, (row, counts.column("bucket").to_numpy()), counts.column("n").to_numpy())
        table = np.log(table / table.sum(1, keepdims=True))
    return langs, table.astype(np.float32)


class WordLikelihoods(WordTable):
    """Log likelihood of each word in each language, less that in its best language; the last column is the number of trigrams."""

    def __init__(self, table: np.ndarray):
        self.table = table
        super().__init__()

    def compute(self, words: list[bytes]) -> np.ndarray:
        buckets, begin = trigrams(words)
        sums = np.stack([sums_by(row[buckets].astype(np.float64), begin) for row in self.table], 1)
        return np.column_stack([np.maximum(sums - sums.max(1, keepdims=True), -MOST_APART), np.diff(begin)]).astype(np.float32)


def mixture(likelihoods: np.ndarray) -> tuple[np.ndarray, float]:
    """(proportions, log likelihood) of the best mixture of the languages for words with these log likelihoods (one column for each language)."""
    p = np.exp(likelihoods)
    share = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(STEPS):
        joint = p * share
        share = (joint / joint.sum(1, keepdims=True)).mean(0)
    return share, float(np.log(p @ share).sum())


def languages_of(likelihoods: np.ndarray) -> dict[int, float]:
    """{language: proportion} of the set with the largest penalised likelihood."""
    single = likelihoods.sum(0)
    chosen, best, shares = [int(single.argmax())], float(single.max()), np.ones(1)
    price = PENALTY * np.log(len(likelihoods) + 1)
    # No set can do better than every word in its own best language.
    while len(chosen) < likelihoods.shape[1] and -best > price:
        tries = [(*mixture(likelihoods[:, [*chosen, k]]), k) for k in range(likelihoods.shape[1]) if k not in chosen]
        share, value, k = max(tries, key=lambda x: (x[1], -x[2]))
        if value - best <= price:
            break
        chosen, best, shares = [*chosen, k], value, share
    return dict(zip(chosen, map(float, shares), strict=True))


def _identify(batches: Iterator[pa.RecordBatch], langs: list[str], table: np.ndarray, text: str) -> Iterator[pa.RecordBatch]:
    words_seen = WordLikelihoods(table)
    for batch in groups(batches, text):
        words, starts = split_all(batch.column(text).to_pylist())
        found: list[tuple[str, float, list[str]]] = []
        number, rows = words_seen.look_up(words) if langs else (None, None)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            own = rows[number[a:b]] if langs else np.zeros((0, 1))
            own = own[own[:, -1] > 0, :-1]
            if not len(own):
                found.append(("und", 0.0, []))
                continue
            shares = languages_of(own.astype(np.float64))
            ordered = sorted(shares, key=lambda k: (-shares[k], k))
            found.append((langs[ordered[0]], shares[ordered[0]], [langs[k] for k in ordered]))
        new = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.string(), pa.float64(), pa.list_(pa.string())), strict=True)]
        carried = batch.drop_columns([text])
        yield pa.RecordBatch.from_arrays([*carried.columns, *new], [*carried.schema.names, "lang_pred", "score", "languages"])


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], carry: list[str], text_col: str = "text") -> DataFrame:
    """For each row of ``docs`` its columns ``carry``, lang_pred, score (that language's proportion) and languages, largest proportion first.

    A text that is null or has no letter, and any text where nothing could be learned, is ``und`` with score 0 and no languages. Ties go to the language that comes first by
    name. Rows are judged alone by their text; what is carried, nulls and repeats included, stays as it is, but for columns with the names of the results, which are replaced. No rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats for each language
    carried = [c for c in carry if c not in ("lang_pred", "score", "languages")]
    text = "text_" + "_".join(carried)  # no name that is carried
    rows = docs.select(*carried, F.col(text_col).alias(text))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lambda batches: _identify(batches, *shared.value, text), f"{fields}lang_pred string, score double, languages array<string>")
