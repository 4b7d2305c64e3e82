"""Best-fit packing by linear grouping: few sequences, and only what is longer than a sequence is cut.

Of all pieces only the number of each length is needed to plan. Large lengths are put in order and cut into groups of equal
cardinality; each is rounded up to its group's longest. Configurations (multisets of the few rounded sizes that fit a sequence) are chosen by column generation, a linear programme over
the sizes, and rounded down; what that leaves is packed best-fit. Then actual lengths take the places of the rounded ones, and small ones go best-fit into what is left open.

The plan is a table of ranges over "the k-th piece of length L", whose size depends on the sequence length and the number of groups, not on the input. Spark numbers the pieces of each length and looks their places up.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from subledger.llm.common import lookup_join, written
from subledger.llm.words import groups

MAX_LENGTH = 1024
END_ID = 2
#: Groups of equal cardinality that the large lengths are rounded in.
GROUPS = 128
#: Lengths of up to one in SMALL of a sequence are small.
SMALL = 8


class ByteTokens:
    """Token ids of a byte-level vocabulary of the tokenizers library, by tiktoken where that gives the same ids and is several times as fast.

    It gives the same where a token's id is the rank of its merge, which is checked, and where a text holds none of the vocabulary's added tokens; all else goes to tokenizers.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.added = [t["content"] for t in described["added_tokens"]]
        self.fast = self._by_rank(described)

    @staticmethod
    def _by_rank(described: dict):
        import public_tokenizers
        import tiktoken

        vocabulary, before = described["model"]["vocab"], described["pre_tokenizer"] or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex") or described["normalizer"]:
            return None
        merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in described["model"]["merges"]]
        if merged != sorted(merged):
            return None
        # A byte that prints stands for itself, the others for code points from 256 on.
        printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in printing} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printing)}
        added = {t["content"] for t in described["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in added}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(t in text for t in self.added):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, most: int, end_id: int) -> Iterator[pa.RecordBatch]:
    tokens = ByteTokens(path)
    for batch in groups(batches):
        ids = [np.array([*tokens(t or ""), end_id], "<u4") for t in batch.column("text").to_pylist()]
        n = np.array([len(x) for x in ids], np.int64)
        counts = -(-n // most)
        owner = np.repeat(np.arange(len(n)), counts)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        first = n - (counts - 1) * most
        start = np.where(piece == 0, 0, first[owner] + (piece - 1) * most)
        length = np.where(piece == 0, first[owner], most)
        offsets = np.concatenate([[0], np.cumsum(length)])
        data = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(np.concatenate([*ids, np.zeros(0, "<u4")]))])
        columns = {"doc_id": batch.column("doc_id").take(pa.array(owner)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length), "ids": data}
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_length: int = MAX_LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit).

    A document's ids end with ``end_id``; of more than ``max_length`` ids the first piece takes the remainder and the others ``max_length`` each. A null text counts as empty, which is the end id alone. Rows that repeat and
    null ids are documents of their own; other columns play no part, whatever their names. No rows give no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_pieces, path=tokenizer_path, most=max_length, end_id=end_id), "doc_id long, piece int, start long, length long, ids binary")


@dataclass
class Plan:
    """Ranges: pieces ``first`` to ``first + n - 1`` of ``length`` go to sequences from ``sequence`` on, ``each`` to a sequence, one after the other from ``offset``."""

    most: int
    sequences: int = 0
    ranges: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    #: What is open, by free room: (first sequence, number of sequences).
    free: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    used: dict[int, int] = field(default_factory=dict)

    def put(self, length: int, n: int, sequence: int, each: int, offset: int) -> None:
        first = self.used.get(length, 0)
        self.ranges.append((length, first, n, sequence, each, offset))
        self.used[length] = first + n

    def open(self, sequences: int) -> int:
        self.sequences += sequences
        return self.sequences - sequences

    def leave(self, room: int, sequence: int, n: int) -> None:
        if room and n:
            self.free.setdefault(room, []).append((sequence, n))

    def _fill(self, length: int, left: int, room: int, sequence: int, n: int) -> int:
        """Put as many as fit of ``left`` pieces into ``n`` sequences with ``room``; returns how many are left."""
        each = room // length
        full = min(n, left // each)
        if full:
            self.put(length, full * each, sequence, each, self.most - room)
            self.leave(room - each * length, sequence, full)
        left -= full * each
        if left and full < n:
            self.put(length, left, sequence + full, left, self.most - room)
            self.leave(room - left * length, sequence + full, 1)
            full, left = full + 1, 0
        self.leave(room, sequence + full, n - full)
        return left

    def best_fit(self, length: int, n: int) -> None:
        """Each piece goes where the least room is left that holds it; a new sequence is opened where none does. Equal pieces are put in together: a sequence that has taken one has less room than before, so it takes the next as well."""
        for room in sorted(r for r in self.free if r >= length):
            if not n:
                return
            for sequence, many in self.free.pop(room):
                if n:
                    n = self._fill(length, n, room, sequence, many)
                else:
                    self.leave(room, sequence, many)
        if n:
            more = -(-n // (self.most // length))
            self._fill(length, n, self.most, self.open(more), more)


def grouped(counts: np.ndarray, large: np.ndarray, number: int) -> list[list[tuple[int, int]]]:
    """The large lengths, longest first, in at most ``number`` groups of equal cardinality: each as (length, pieces) runs. Groups with one longest length become one."""
    total = int(counts[large].sum())
    size, found, held = max(1, -(-total // number)), [], 0
    for length in sorted(map(int, large), reverse=True):
        left = int(counts[length])
        while left:
            if held % size == 0 and (not found or found[-1][0][0] != length or found[-1][-1][0] != length):
                found.append([])
            some = min(left, size - held % size)
            if found[-1] and found[-1][-1][0] == length:
                found[-1][-1] = (length, found[-1][-1][1] + some)
            else:
                found[-1].append((length, some))
            held, left = held + some, left - some
    return found


def configurations(sizes: np.ndarray, demands: np.ndarray, most: int, steps: int = 4000) -> list[tuple[np.ndarray, int]]:
    """(pieces of each size, number of sequences): the linear programme's configurations, rounded down, by column generation.

    Every step's basis is feasible, so that ``steps`` bounds the time and not what is packed.
    """
    n, most_items = len(sizes), most // int(sizes.min())
    basis = np.diag((most // sizes).astype(float))
    for _ in range(steps):
        inverse = np.linalg.inv(basis)
        prices = inverse.sum(0)
        # The dearest configuration: best[c] is the dearest of i pieces within c; chosen has each step's size.
        best, chosen = np.zeros(most + 1), []
        for _ in range(most_items):
            offers = np.full((n, most + 1), -1.0)
            for g, s in enumerate(sizes):
                offers[g, s:] = best[: most + 1 - s] + prices[g]
            pick = offers.argmax(0)
            dearer = offers[pick, np.arange(most + 1)] > best + 1e-12
            best = np.where(dearer, offers[pick, np.arange(most + 1)], best)
            chosen.append(np.where(dearer, pick, -1))
        if best[most] <= 1 + 1e-7:
            break
        column, room = np.zeros(n), most
        for picks in reversed(chosen):
            if picks[room] >= 0:
                column[picks[room]] += 1
                room -= int(sizes[picks[room]])
        made, change = inverse @ demands, inverse @ column
        grows = change > 1e-9
        ratio = np.where(grows, np.maximum(made, 0) / np.where(grows, change, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    made = np.floor(np.linalg.solve(basis, demands) + 1e-6).astype(np.int64)
    return [(basis[:, j].round().astype(np.int64), int(made[j])) for j in range(n) if made[j] > 0]


def _leftover(sizes: np.ndarray, demands: np.ndarray, most: int) -> list[tuple[np.ndarray, int]]:
    """The sizes that the rounded configurations leave, packed best-fit one by one; there are fewer than sizes times pieces of a sequence."""
    rooms: list[list] = []
    for g in np.argsort(-sizes, kind="stable"):
        for _ in range(int(demands[g])):
            fits = [r for r in rooms if r[0] >= sizes[g]]
            if fits:
                chosen = min(fits, key=lambda r: r[0])
            else:
                rooms.append(chosen := [most, np.zeros(len(sizes), np.int64)])
            chosen[0] -= int(sizes[g])
            chosen[1][g] += 1
    return [(r[1], 1) for r in rooms]


def plan(counts: np.ndarray, most: int = MAX_LENGTH, number: int = GROUPS) -> Plan:
    """Where the pieces of each length go; ``counts[L]`` is how many have length L."""
    made = Plan(most)
    if counts[most]:
        made.put(most, int(counts[most]), made.open(int(counts[most])), 1, 0)
    lengths = np.flatnonzero(counts[:most])
    large, small = lengths[lengths > most // SMALL], lengths[lengths <= most // SMALL]
    if len(large):
        runs = grouped(counts, large, number)
        sizes = np.array([r[0][0] for r in runs])
        demands = np.array([sum(n for _, n in r) for r in runs])
        chosen = configurations(sizes, demands.astype(float), most)
        rest = demands.copy()
        kept = []
        for pattern, times in chosen:
            times = int(min([times, *(rest[pattern > 0] // pattern[pattern > 0])]))
            if times > 0:
                rest -= pattern * times
                kept.append((pattern, times))
        for pattern, times in kept + _leftover(sizes, rest, most):
            _substitute(made, runs, pattern, times)
    for length in sorted(map(int, small), reverse=True):
        made.best_fit(length, int(counts[length]))
    return made


def _substitute(made: Plan, runs: list[list[tuple[int, int]]], pattern: np.ndarray, times: int) -> None:
    """Put actual lengths into ``times`` sequences of a configuration: each place takes the next pieces of its group, longest first."""
    places = []
    for g in np.flatnonzero(pattern):
        for _ in range(int(pattern[g])):
            taken, need = [], times
            while need:
                length, n = runs[g][0]
                some = min(n, need)
                taken.append([length, some])
                need -= some
                runs[g][0] = (length, n - some)
                if n == some:
                    runs[g].pop(0)
            places.append(taken)
    sequence = made.open(times)
    while places[0]:
        n = min(p[0][1] for p in places)
        offset = 0
        for p in places:
            made.put(p[0][0], n, sequence, 1, offset)
            offset += p[0][0]
            p[0][1] -= n
            if not p[0][1]:
                p.pop(0)
        made.leave(made.most - offset, sequence, n)
        sequence += n


def _number(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Adds the task and the piece's number among the task's pieces of its length."""
    seen, task = np.zeros(most + 1, np.int64), TaskContext.get().partitionId()
    for batch in batches:
        length = batch.column("length").to_numpy(zero_copy_only=False)
        order = np.argsort(length, kind="stable")
        here = np.bincount(length, minlength=most + 1)
        rank = np.empty(len(length), np.int64)
        rank[order] = np.arange(len(length)) - (np.cumsum(here) - here)[length[order]]
        rank += seen[length]
        seen += here
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), task, np.int64)), pa.array(rank)], [*batch.schema.names, "_task", "_rank"])


def _place(batches: Iterator[pa.RecordBatch], ranges: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Looks up each piece's range; ``ranges`` is in order of length and first."""
    starts = np.searchsorted(ranges[:, 0], np.arange(ranges[:, 0].max() + 2))
    for batch in batches:
        length, k = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_number"))
        at, to = starts[length], starts[length + 1]
        while (wide := to - at > 1).any():
            middle = (at + to) // 2
            right = wide & (ranges[np.minimum(middle, len(ranges) - 1), 1] <= k)
            at, to = np.where(right, middle, at), np.where(wide & ~right, middle, to)
        _, first, _, sequence, each, offset = ranges[at].T
        inside = k - first
        keep = [i for i, c in enumerate(batch.schema.names) if c != "_number"]
        placed = [pa.array(sequence + inside // each), pa.array(offset + inside % each * length)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *placed], [*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])


def place(parts: DataFrame, max_length: int = MAX_LENGTH, number: int = GROUPS) -> DataFrame:
    """The rows of ``parts``, which have a ``length`` of 1 to ``max_length``, with sequence_id (from 0 on) and offset (gapless from 0).

    Other columns are carried as they are, nulls included; repeated rows are pieces of their own. No rows give no rows. Pieces are counted by length in each task; the driver sees ``max_length`` counts and makes the plan.
    """
    own = StructType(parts.schema.fields)
    numbered = written(parts.mapInArrow(partial(_number, most=max_length), StructType([*own.fields]).add("_task", LongType()).add("_rank", LongType())))
    counted = written(numbered.groupBy("_task", "length").agg(F.count("*").alias("_n")))
    counts = np.zeros(max_length + 1, np.int64)
    for length, n in counted.groupBy("length").agg(F.sum("_n")).collect():
        counts[length] = n
    ranges = np.array(sorted(plan(counts, max_length, number).ranges), np.int64).reshape(-1, 6)
    if not len(ranges):
        ranges = np.zeros((1, 6), np.int64)
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    met = lookup_join(numbered, bases, ["_task", "length"], "_n")
    met = met.select(*parts.columns, (F.col("_before") + F.col("_rank")).alias("_number"))
    return met.mapInArrow(partial(_place, ranges=ranges), StructType([*own.fields]).add("sequence_id", LongType()).add("offset", LongType()))


def sequences(placed: DataFrame, max_length: int = MAX_LENGTH, pad_id: int = END_ID) -> DataFrame:
    """One row for each sequence: sequence_id, length, ids. ``placed`` has the pieces' ``ids``; what is free at the end is filled with ``pad_id``."""
    held = placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("held"))
    joined = F.aggregate("held", F.lit(b""), lambda all_ids, one: F.concat(all_ids, one["ids"]))
    padding = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), (F.lit(max_length) - F.col("length")).cast("int")))
    return held.select("sequence_id", "length", F.concat(joined, padding).alias("ids"))
