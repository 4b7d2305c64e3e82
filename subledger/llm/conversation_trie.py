"""The prefix trie of conversations by an LCP-aware external mergesort.

A conversation's key is the row of its turns' SHA-256 digests, so that a prefix of turns is a prefix of bytes. Tasks make sorted runs whose entries carry the
number of leading turns they share with the entry before (their LCP). Runs are exchanged by ranges of (key, conversation), which is unique, so that no group of equal conversations has to stay in one range. Each range merges its runs by a loser
tree that compares two entries only beyond the turns that both are known to share with the last winner. The merged stream needs one stack of open nodes: what the next conversation doesn't share is finished.

A node on the path of a range's first or last conversation may go on in the next range. Such nodes come as parts, which Spark sums by node; what two neighbouring ranges count twice is taken off once for each boundary.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subledger.llm.common import lookup_join, written

SPACE = r"[\x20\x09-\x0D]+"
#: Conversations that share their first turns with another: that of the id rounded down to a multiple of FAMILY; LENT is one more than the most turns that are lent.
FAMILY, LENT = 20, 4
DIGEST = 32
#: Bytes of keys in a sorted run, and in a range that one task merges, on average.
RUN_BYTES, RANGE_BYTES = 16 << 20, 32 << 20
#: Bytes of conversation ids that one row carries where a node's list is spread over ranges.
CHUNK_BYTES = 1 << 16
OUT_ROWS = 4096
NOTHING = hashlib.sha256(b"").hexdigest()

_RUNS = "run long, pos long, lcp int, conv_id long, key binary, words array<int>"
_OUT = "kind int, id binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, part int, chunk int, data binary, last binary, words array<int>"
#: A node that is whole; one that is whole but whose parent isn't; a part of a node; the first and last key of a range; ids that end in a part.
WHOLE, CHILD, PART, EDGE, ENDS = range(5)


def keyed(conversations: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, turns (hex digest and number of words of each, in order).

    Turns go by ``turn``, null first; turns of one number go by their digests; repeated rows are turns of their own. A null role or text is empty. Rows without a conv_id belong to no conversation. Other columns play no part.
    What is gathered of a conversation is about 100 bytes a turn, never its texts.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    words = F.size(F.filter(F.split(text, SPACE), lambda w: w != ""))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), words.alias("words")).alias("one"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))


def rebuilt(convs: DataFrame, family: int = FAMILY, lent: int = LENT) -> DataFrame:
    """conv_id, key, words: each conversation with its first h turns taken from its family's first one (fewer if that has fewer, none if there is none), h = crc32(conv_id) mod ``lent``. Ids are rounded down, negative ones too."""
    head = F.col("conv_id") - F.pmod("conv_id", F.lit(family))
    first = convs.where(F.pmod("conv_id", F.lit(family)) == 0).select(F.col("conv_id").alias("head"), F.slice("turns", 1, lent - 1).alias("first"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(lent)).cast("int")
    both = convs.withColumn("head", head).join(first, "head", "left").withColumn("h", h)
    own = F.slice("turns", F.col("h") + 1, F.size("turns"))
    turns = both.select("conv_id", F.when(F.col("first").isNull(), own).otherwise(F.concat(F.slice("first", F.lit(1), F.col("h")), own)).alias("turns"))
    return turns.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Leading turns that two keys share, of which ``known`` are known."""
    n, most = known, min(len(a), len(b)) // DIGEST
    while n < most and a[n * DIGEST : (n + 1) * DIGEST] == b[n * DIGEST : (n + 1) * DIGEST]:
        n += 1
    return n


def _run(rows: list[tuple], number: int) -> pa.RecordBatch:
    rows.sort(key=lambda r: r[:2])
    lcps = [0, *(shared(a[0], b[0]) for a, b in pairwise(rows))]
    columns = [[number] * len(rows), range(len(rows)), lcps, [r[1] for r in rows], [r[0] for r in rows], [r[2] for r in rows]]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["run", "pos", "lcp", "conv_id", "key", "words"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of about RUN_BYTES each."""
    number, rows, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        for row in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), batch.column("words").to_pylist(), strict=True):
            rows.append(row)
            size += len(row[0]) + 64
            if size > RUN_BYTES:
                yield _run(rows, number)
                number, rows, size = number + 1, [], 0
    if rows:
        yield _run(rows, number)


def merge(runs: list[list[tuple]]) -> Iterator[tuple]:
    """Merge sorted runs of (key, conv_id, words, lcp with the entry before) by a loser tree; yields (key, conv_id, words, lcp with the entry yielded before).

    A place of the tree holds a loser and the turns that it shares with the entry that beat it. Of two entries the one that shares more with the last winner comes first, without a look at either; only entries that share equally much are compared, from there on.
    """
    width = 1 << max(len(runs) - 1, 0).bit_length()
    at, lcp = [0] * width, [0] * width
    runs = runs + [[]] * (width - len(runs))

    def loser(a: int, b: int) -> tuple[int, int]:
        """(first, second) of two runs by their present entries."""
        if at[a] >= len(runs[a]):
            return b, a
        if at[b] >= len(runs[b]):
            return a, b
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        x, y = runs[a][at[a]], runs[b][at[b]]
        n = shared(x[0], y[0], lcp[a])
        first, second = (a, b) if (x[0][n * DIGEST : (n + 1) * DIGEST], x[1]) < (y[0][n * DIGEST : (n + 1) * DIGEST], y[1]) else (b, a)
        lcp[second] = n
        return first, second

    tree, winners = [0] * width, list(range(width))
    for level in range(width.bit_length() - 2, -1, -1):
        played = [loser(winners[2 * i], winners[2 * i + 1]) for i in range(1 << level)]
        winners = [p[0] for p in played]
        tree[1 << level : 2 << level] = [p[1] for p in played]
    best = winners[0]
    while at[best] < len(runs[best]):
        key, conv, words, _ = runs[best][at[best]]
        yield key, conv, words, lcp[best]
        at[best] += 1
        if at[best] < len(runs[best]):
            lcp[best] = runs[best][at[best]][3]
        place = (width + best) >> 1
        while place:
            best, tree[place] = loser(best, tree[place])
            place >>= 1


class _Node:
    __slots__ = ("children", "depth", "edge", "ends", "id", "leaves", "least", "n", "pending", "saved", "words")

    def __init__(self, id: bytes, depth: int, words: int, edge: bool):
        self.id, self.depth, self.words, self.edge = id, depth, words, edge
        self.n = self.children = self.leaves = self.saved = 0
        self.least, self.ends, self.pending = None, [], []


def child_id(parent: bytes, digest: bytes) -> bytes:
    return hashlib.blake2b(parent + digest, digest_size=16).digest()


class _Stack:
    """The open path. ``out`` gets the rows of what is finished."""

    def __init__(self, part: int):
        self.part, self.out, self.path = part, [], [_Node(b"", 0, 0, True)]
        self.started = False

    def add(self, key: bytes, conv: int, words: list[int], lcp: int) -> None:
        while len(self.path) - 1 > lcp:
            self.close()
        for d in range(len(self.path) - 1, len(key) // DIGEST):
            self.path.append(_Node(child_id(self.path[-1].id, key[d * DIGEST : (d + 1) * DIGEST]), d + 1, words[d], not self.started))
        node = self.path[-1]
        node.ends.append(conv)
        node.n += 1
        node.least = conv if node.least is None else min(node.least, conv)
        self.started = True

    def row(self, kind: int, **values) -> None:
        self.out.append({"kind": kind, "part": self.part} | values)

    def close(self) -> None:
        node = self.path.pop()
        parent = self.path[-1] if self.path else None
        node.leaves = node.leaves or 1
        node.saved += (node.n - 1) * node.words
        if parent:
            parent.n += node.n
            parent.least = node.least if parent.least is None else min(parent.least, node.least)
            parent.children += 1
            parent.leaves += node.leaves
            parent.saved += node.saved
        values = {"conv_id": node.least, "depth": node.depth, "n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved}
        if node.edge:
            self.row(PART, id=node.id, parent=parent.id if parent else None, **values)
            self.give_children(node)
            step = CHUNK_BYTES // 20
            for i in range(0, len(node.ends), step):
                self.row(ENDS, id=node.id, chunk=i // step, data=",".join(map(str, node.ends[i : i + step])).encode())
        else:
            values["ends_sha256"] = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest() if node.ends else None
            for child in node.pending:
                self.row(WHOLE, parent_conv_id=node.least, **child)
            parent.pending.append(values)
            if parent.edge:
                self.give_children(parent)

    def give_children(self, node: _Node) -> None:
        for child in node.pending:
            self.row(CHILD, parent=node.id, **child)
        node.pending = []

    def end(self) -> None:
        for node in self.path:
            node.edge = True
        while self.path:
            self.close()


def _batches(rows: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), OUT_ROWS):
        yield pa.RecordBatch.from_pylist(rows[i : i + OUT_ROWS], schema)


_NAMES = [c.split()[0] for c in _OUT.split(", ")]
_SCHEMA = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[c.split()[1]]) for n, c in zip(_NAMES, _OUT.split(", "), strict=True)])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: its runs' entries, in order of run and position, as nodes, parts and edges."""
    runs: dict[int, list[tuple]] = {}
    for batch in batches:
        for run, lcp, conv, key, words in zip(*(batch.column(c).to_pylist() for c in ("run", "lcp", "conv_id", "key", "words")), strict=True):
            runs.setdefault(run, []).append((key, conv, words, lcp))
    if not runs:
        return
    stack, first, last = _Stack(TaskContext.get().partitionId()), None, None
    for key, conv, words, lcp in merge(list(runs.values())):
        first, last = first or (key, words), key
        stack.add(key, conv, words, lcp)
        if len(stack.out) >= OUT_ROWS:
            yield from _batches(stack.out, _SCHEMA)
            stack.out.clear()
    stack.end()
    stack.row(EDGE, data=first[0], words=first[1], last=last)
    yield from _batches(stack.out, _SCHEMA)


_SPINE = "id binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
_SPINE_SCHEMA = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (c.split() for c in _SPINE.split(", "))])


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a range counts of the nodes that it shares with the range before (its ``before`` is that one's last key) and that range has counted too, as parts to be added."""
    for batch in batches:
        rows = []
        for first, words, before in zip(*(batch.column(c).to_pylist() for c in ("data", "words", "before")), strict=True):
            n = shared(first, before)
            saved, id, parent = sum(words[:n]), b"", None
            leaf = n == len(before) // DIGEST  # the last conversation ended where this range goes on, so it was no leaf yet
            for d in range(n + 1):
                rows.append({"id": id, "parent": parent, "depth": d, "n_convs": 0, "n_children": -(d < n), "n_leaves": -leaf, "saved_tokens": saved})
                saved -= words[d - 1] if d else 0
                if d < n:
                    parent, id = id, child_id(id, first[d * DIGEST : (d + 1) * DIGEST])
        yield from _batches(rows, _SPINE_SCHEMA)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's ids, of which only the running hash is held."""
    schema = pa.schema([("id", pa.binary()), ("ends_sha256", pa.string())])
    now, running = None, None
    for batch in batches:
        done = []
        for id, data in zip(batch.column("id").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if id == now:
                running.update(b"," + data)
                continue
            if running:
                done.append({"id": now, "ends_sha256": running.hexdigest()})
            now, running = id, hashlib.sha256(data)
        yield pa.RecordBatch.from_pylist(done, schema)
    if running:
        yield pa.RecordBatch.from_pylist([{"id": now, "ends_sha256": running.hexdigest()}], schema)


def prefix_trie(conversations: DataFrame, family: int = FAMILY, lent: int = LENT, ranges: int | None = None) -> DataFrame:
    """One row for each distinct sequence of first turns of the rebuilt conversations, the empty one included: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has conv_id, turn, role, text; ``keyed`` and ``rebuilt`` say what becomes of nulls, ties and repeated rows. Two turns are one if role and text are equal. No conversation, no node. ``lent=1`` leaves the conversations as they are.
    A range holds ``RANGE_BYTES`` of keys on average, or ``ranges`` says how many there are. The ids that end in one node are hashed in order; where they are spread over ranges they are read by one task as a stream, since such a hash can't be put together from parts.
    """
    spark = conversations.sparkSession
    runs = written(rebuilt(written(keyed(conversations)), family, lent).mapInArrow(_runs, _RUNS))
    if ranges is None:
        size = runs.agg(F.sum(F.octet_length("key") + 64)).first()[0] or 0
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / RANGE_BYTES))
    out = written(runs.repartitionByRange(ranges, "key", "conv_id").sortWithinPartitions("run", "pos").mapInArrow(_merged, _OUT))

    # One row for each range that isn't empty, so this window is no longer than a stage's list of tasks.
    edges = out.where(F.col("kind") == EDGE).select("data", "words", F.lag("last").over(Window.orderBy("part")).alias("before"))
    twice = edges.where("before is not null").repartition("data").mapInArrow(_twice, _SPINE)
    parts = out.where(F.col("kind") == PART).select(*(c.split()[0] for c in _SPINE.split(", "))).unionByName(twice)
    chunks = out.where(F.col("kind") == ENDS).select("id", "part", "chunk", "data")
    hashes = chunks.repartition("id").sortWithinPartitions("id", "part", "chunk").mapInArrow(_hashes, "id binary, ends_sha256 string")
    sums = (F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))
    spine = written(parts.groupBy("id").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums).join(hashes, "id", "left"))

    shown = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    parents = written(spine.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children"))
    found = out.where(F.col("kind") == WHOLE).select(*shown)
    for rows in (out.where(F.col("kind") == CHILD), spine.where("depth > 0")):
        found = found.unionByName(lookup_join(rows.drop("parent_conv_id"), parents.withColumnRenamed("n_children", "weight"), ["parent"], "weight").select(*shown))
    root = spine.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*shown)
    return found.unionByName(root).fillna(NOTHING, ["ends_sha256"])
