"""N-gram Jaccard join in the metric space of shingle sets, by pivots, Voronoi regions and triangle-inequality windows.

The distance of two documents is 1 - J of their sets, which is a metric; they link when it is at most epsilon, 1 - percent / 100. Equal sets are one point. The join is exact.

1. *Far documents.* A document that is further than epsilon from all others is a region of its own. Of two linked documents the lowest-hashed shingles of each, a fixed share, have L in
   common at least. Those are dealt by hash and counted; a document with fewer than L that others have is far.
2. *Regions.* Pivots are drawn from all other points: points that come first, in a random order, among all that share one of their rare low hashes. Every point within epsilon of a pivot goes to the
   region of its nearest one. What is left draws pivots again, ROUNDS times; a point that is still left is the pivot of its own region. All points of a region are linked by its pivot.
3. *Windows.* A linked pair across regions has one end p in region j and another, q, with d(q, j) <= d(p, j) + epsilon. So q is a boundary document of j only if it shares a rare hash with a point of j and is within
   epsilon plus the region's radius of j. A boundary document within epsilon of j is linked already; the others are copied to the region and join the points of j that are at d(q, j) - epsilon or more from it.
4. *Recursion.* A region that a task can hold is joined there, split by pivots of its own while it is larger than LEAF; a larger one is dealt by Spark to regions of new pivots, and what pivots don't part is
   compared tile by tile. A hash that points of more than HOMES regions share would pair too many; its points are a region of their own, joined in the same way.

Links are found up to connection: regions that they tie are merged by a search for components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subledger.llm.common import discard, lookup_join, settled, without, written
from subledger.llm.words import WordTable, groups, split_all

#: Documents link when 100 * intersection >= percent * union of their shingles of width words; these are op9's.
PERCENT = 85
WIDTH = 4
EPSILON = 1 - PERCENT / 100
#: Extra share of a document's shingles that the first step looks at; more of them rule out more documents.
EXTRA = 0.15
#: Bytes of shingles that one task of the first step counts at once.
DEAL_BYTES = 8 << 20
#: Rounds of drawing pivots for all points; most regions that share a hash whose points meet pairwise with regions.
ROUNDS, HOMES = 2, 16
#: Bytes of sets that are compared with one copy of a pivot in one task.
SPREAD_BYTES = 16 << 20
#: Points that a region compares outright; points and bytes of sets of a region that one task joins.
LEAF, TASK_POINTS, TASK_BYTES = 128, 4096, 32 << 20
#: Inside a region one in so many points is a pivot, MOST_PIVOTS at most. A region there reaches RADIUS + epsilon from its pivot.
PIVOT_SHARE, MOST_PIVOTS, RADIUS = 32, 512, 0.6
#: Matches of shingles that are counted at once.
MATCHES = 1 << 23
#: Rounds in which Spark deals regions that are larger than a task anew, and bytes of pivots that it broadcasts for that.
DEALS, PIVOT_BYTES = 4, 32 << 20
#: Pivots that do not part a region copy its points to each other's windows; with more than COPIES of each, measured on one in 16 points, the region goes to tiles instead.
COPIES = 2.5
#: Stands for all texts of a group that share a shingle.
MANY = 0xFFFF


class WordHashes(WordTable):
    def compute(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], table: WordTable, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles; a shorter text has its whole sequence as one, a text without words none."""
    words, starts = split_all(texts, lower=True)
    number, rows = table.look_up(words)
    hashes, found = rows[number] if words else np.zeros(0, np.uint64), []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        own, n = hashes[a:b], min(width, int(b - a))
        if not n:
            found.append(own)
            continue
        total = np.full(len(own) - n + 1, n, np.uint64)
        for k in range(n):
            total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + own[k : len(own) - n + 1 + k])
        found.append(np.unique(total))
    return found


def needed(n: np.ndarray | int, percent: int = PERCENT) -> np.ndarray | int:
    """Least intersection of a set of n with any set that it links with."""
    return -(-percent * n // 100)


def extra(n: np.ndarray | int) -> np.ndarray | int:
    """L for a set of n: linked sets share as many of their ``n - needed(n, percent) + extra(n)`` lowest hashes, for the smaller L of the two."""
    return np.maximum(1, (n * round(EXTRA * 100)) // 100)


# -- 1. far documents ---------------------------------------------------------------------------------------------------------------


def _deal(batches: Iterator[pa.RecordBatch], shards: int, width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """For each group of texts one row of heads (ids, set sizes, shingles that texts of the group share) and one row of hashes for each shard."""
    from pyspark import TaskContext

    table, part = WordHashes(), TaskContext.get().partitionId()
    for k, batch in enumerate(groups(batches)):
        sets = shingle_sets(batch.column("text").to_pylist(), table, width)
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        cut = [s[: len(s) - needed(len(s), percent) + extra(len(s))] if len(s) else s for s in sets]
        owner = np.repeat(np.arange(len(sets), dtype=np.uint16), np.fromiter(map(len, cut), np.int64, len(cut)))
        every = np.concatenate([np.zeros(0, np.uint64), *cut])
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        _, first, times = np.unique(every, return_index=True, return_counts=True)
        alike = np.repeat(times > 1, times)
        known = np.bincount(owner[alike], minlength=len(sets))
        # What texts of this group share is settled here, so a frequent shingle reaches its shard once for each group.
        owner[alike] = MANY
        every, owner = every[first], owner[first]
        shard = (every % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        every, owner = every[order], owner[order]
        # Only the shards that occur: there are as many shards as the corpus needs, and a group meets few of them.
        met, edge = np.unique(shard[order], return_index=True)
        name = part << 32 | k
        rows = [(name, -1, b"".join(batch.column("key").to_pylist()), np.stack([n, known]).astype(np.int32).tobytes())]
        rows += [(name, s, every[a:b].tobytes(), owner[a:b].tobytes()) for s, a, b in zip(met.tolist(), edge, np.append(edge[1:], len(every)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["grp", "shard", "a", "b"])


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one shard: for each group the texts whose shingles other groups have too, one entry for each shingle."""
    hashes = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["a"]])
    owners = np.concatenate([np.frombuffer(x, np.uint16) for x in pdf["b"]])
    row = np.repeat(np.arange(len(pdf)), [len(x) // 8 for x in pdf["a"]])
    order = np.argsort(hashes, kind="stable")
    _, times = np.unique(hashes, return_counts=True)
    shared = np.zeros(len(hashes), bool)
    shared[order] = np.repeat(times > 1, times)
    shared &= owners != MANY
    row, owners = row[shared], owners[shared]
    edge = np.searchsorted(row, np.arange(len(pdf) + 1))
    out = [(g, owners[a:b].tobytes()) for g, a, b in zip(pdf["grp"], edge[:-1], edge[1:], strict=True) if b > a]
    return pd.DataFrame(out, columns=["grp", "b"])


def _near(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Of one group: every text's key and set size, and whether it may link."""
    head = pdf[pdf["shard"] == -1].iloc[0]
    ids, (n, known) = [bytes(head["a"][i : i + 16]) for i in range(0, len(head["a"]), 16)], np.frombuffer(head["b"], np.int32).reshape(2, -1)
    shared = known.astype(np.int64)
    for x in pdf["b"][pdf["shard"] != -1]:
        shared += np.bincount(np.frombuffer(x, np.uint16), minlength=len(ids))
    return pd.DataFrame({"key": ids, "n_shingles": n.astype(np.int64), "near": (n > 0) & (shared >= extra(needed(n.astype(np.int64), percent)))})


def _near_of(percent: int):
    return lambda pdf: _near(pdf, percent)


def near_texts(rows: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, near, times) for each key, of 16 bytes, of (key, text); ``near`` is false only if the text links with no other."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(max(16, size // DEAL_BYTES))
    dealt = written(rows.mapInArrow(partial(_deal, shards=shards, width=width, percent=percent), "grp long, shard int, a binary, b binary"))
    counted = dealt.where("shard >= 0").groupBy("shard").applyInPandas(_count, "grp long, b binary")
    both = dealt.where("shard = -1").unionByName(counted.select("grp", F.lit(-2).alias("shard"), F.lit(None).cast("binary").alias("a"), "b"))
    near = both.groupBy("grp").applyInPandas(_near_of(percent), "key binary, n_shingles long, near boolean")
    kept = written(near.groupBy("key").agg(F.max("n_shingles").alias("n_shingles"), F.max("near").alias("near"), F.count("*").alias("times")))
    discard(dealt)
    return kept


# -- 2. points ----------------------------------------------------------------------------------------------------------------------


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """For each key of a group its set's digest; the set itself where the group has it first."""
    table = WordHashes()
    for batch in groups(batches):
        texts = dict(zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True))
        sets = [x.tobytes() for x in shingle_sets(list(texts.values()), table, width)]
        digests, seen = [xxhash.xxh3_128_digest(x) for x in sets], set()
        first = [None if d in seen or seen.add(d) else x for d, x in zip(digests, sets, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(list(texts), pa.binary()), pa.array(digests, pa.binary()), pa.array(first, pa.binary())], ["key", "digest", "shingles"])


def _low_hashes(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(point, least, hash) for each point's low hashes; ``least`` of them are in any set that it links with."""
    for batch in batches:
        sets = [np.frombuffer(x, np.uint64) for x in batch.column("shingles").to_pylist()]
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        cut = [s[: len(s) - needed(len(s), percent) + extra(len(s))] for s in sets]
        owner = np.repeat(np.arange(len(sets)), np.fromiter(map(len, cut), np.int64, len(cut)))
        yield pa.RecordBatch.from_arrays([batch.column("point").take(pa.array(owner)), pa.array(extra(needed(n, percent))[owner]), pa.array(np.concatenate([np.zeros(0, np.uint64), *cut]).view(np.int64))], ["point", "least", "hash"])


def components(ties: DataFrame) -> DataFrame:
    """(point, least) for every point of the ties (a, b): the smallest point reachable.

    Large-star and small-star steps take turns: each ties a point's larger, then its smaller, neighbours to the smallest one it knows, until every component is a star. A point with very many
    neighbours is joined by broadcast, so that its star is not one task's.
    """
    low, high = F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")
    edges, before = written(ties.where("a <> b").select(high, low).distinct()), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        large = lookup_join(both.where("v > u"), least, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = lookup_join(large, least, ["u"], "n").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("point"), F.col("v").alias("least")).unionByName(edges.select(F.col("v").alias("point"), F.col("v").alias("least")).distinct())


def rare_hashes(points: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(point, hash) for the rarest low hashes of each point that others have too; two linked points share one."""
    low = points.mapInArrow(partial(_low_hashes, percent=percent), "point long, least long, hash long")
    held = written(low.groupBy("hash").agg(F.count("*").alias("times")).where("times > 1"))
    shared = lookup_join(low, held, ["hash"], "times").groupBy("point", "least").agg(F.sort_array(F.collect_list(F.struct("times", "hash"))).alias("shared"))
    # Hashes of one point alone come first in the order, then the others by how many points have them; two sets with
    # ``least`` in common meet before the last ``least - 1``.
    reach = (F.size("shared") - F.col("least") + 1).cast("int")
    return written(shared.where(reach > 0).select("point", F.explode(F.slice("shared", F.lit(1), reach)).alias("one")).select("point", F.col("one.hash").alias("hash")))


# -- 3. regions of all points ---------------------------------------------------------------------------------------------------------------------


def _to_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pivot, point, both, either): sizes of intersection and union. Rows come pivot by pivot, each pivot's own set before the points'."""
    name, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        found = []
        for pivot, part, point, raw in zip(*(batch.column(c).to_pylist() for c in ("pivot", "part", "point", "shingles")), strict=True):
            some = np.frombuffer(raw, np.uint64)
            if point is None:
                name, own = (pivot, part), some
                continue
            assert name == (pivot, part)
            both = int((own[np.minimum(np.searchsorted(own, some), len(own) - 1)] == some).sum())
            found.append((pivot, point, both, len(own) + len(some) - both))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["pivot", "point", "both", "either"])


def distances(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """(pivot, point, d, linked) for each of the written ``pairs`` (pivot, point); ``points`` has (point, bytes, shingles). A pivot's set is sent once for every SPREAD_BYTES of points, so no region is one task's."""
    parts = written(pairs.join(points.select("point", "bytes"), "point").groupBy("pivot").agg(F.count("*").alias("n"), (F.floor(F.sum("bytes") / SPREAD_BYTES) + 1).cast("int").alias("parts")))
    dealt = lookup_join(pairs.select("pivot", "point"), parts, ["pivot"], "n").withColumn("part", F.pmod(F.xxhash64("point"), "parts").cast("int"))
    sets = dealt.select("pivot", "part", "point").join(points, "point").select("pivot", "part", "point", "shingles")
    own = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(points.select(F.col("point").alias("pivot"), "shingles"), "pivot").select("pivot", "part", F.lit(None).cast("long").alias("point"), "shingles")
    met = sets.unionByName(own).repartition("pivot", "part").sortWithinPartitions("pivot", "part", F.asc_nulls_first("point")).mapInArrow(_to_pivots, "pivot long, point long, both long, either long")
    return written(met.select("pivot", "point", (1 - F.col("both") / F.col("either")).alias("d"), (100 * F.col("both") >= percent * F.col("either")).alias("linked")))


def voronoi(rare: DataFrame, points: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """((point, home, d) for each point of ``rare``: the nearest pivot within epsilon; (a, b): links of points with other pivots than their own)."""
    left = rare
    homes, links = [left.limit(0).select("point", F.col("point").alias("home"), F.lit(0.0).alias("d"))], [left.limit(0).select(F.col("point").alias("a"), F.col("point").alias("b"))]
    for _ in range(ROUNDS):
        first = written(left.groupBy("hash").agg(F.min(F.struct(F.xxhash64("point"), "point")).getField("point").alias("pivot"), F.count("*").alias("n")))
        if first.isEmpty():
            break
        meets = written(lookup_join(left, first, ["hash"], "n").select("pivot", "point").distinct())
        discard(first)
        # A pivot comes first in all its hashes, so no hash leads to two.
        chosen = meets.groupBy("point").agg(F.count_if(F.col("pivot") != F.col("point")).alias("others")).where("others = 0").select(F.col("point").alias("pivot"))
        met = meets.groupBy("pivot").agg(F.count("*").alias("n")).join(chosen, "pivot")
        pairs = written(lookup_join(meets.where(F.col("pivot") != F.col("point")), written(met), ["pivot"], "n").select("pivot", "point"))
        near = distances(pairs, points, percent).where("linked")
        home = near.groupBy("point").agg(F.min(F.struct("d", "pivot")).alias("x")).select("point", F.col("x.pivot").alias("home"), F.col("x.d").alias("d"))
        home = written(home.unionByName(met.select(F.col("pivot").alias("point"), F.col("pivot").alias("home"), F.lit(0.0).alias("d"))))
        homes.append(home)
        links.append(near.select(F.col("pivot").alias("a"), F.col("point").alias("b")))
        left = written(left.join(home.select("point"), "point", "left_anti"))
        discard(meets)
        discard(pairs)
    alone = left.select("point").distinct().select("point", F.col("point").alias("home"), F.lit(0.0).alias("d"))
    return written(reduce(DataFrame.unionByName, [*homes, alone])), reduce(DataFrame.unionByName, links)


def regional_links(points: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """((point, home, d) of all points that may link; (a, b): links between points of different regions, up to connection)."""
    rare = rare_hashes(points, percent)
    homes, links = voronoi(rare, points, percent)
    placed = written(rare.join(homes, "point").select("hash", "point", "home"))
    discard(rare)
    regions_of = placed.groupBy("hash", "home").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("homes"), F.sum("n").alias("n")).where("homes > 1")
    regions_of = written(regions_of)
    if regions_of.isEmpty():
        return homes, links
    crowded = written(regions_of.where(F.col("homes") > HOMES))
    few = without(placed.select("hash", "home").distinct(), crowded, ["hash"], "homes")
    named = few.join(regions_of.where(F.col("homes") <= HOMES).select("hash", "n"), "hash").groupBy("hash", "n").agg(F.collect_list("home").alias("pivots"))
    pairs = lookup_join(placed, written(named), ["hash"], "n").select("point", "home", F.explode("pivots").alias("pivot")).where("home <> pivot").select("pivot", "point").distinct()
    met = distances(written(pairs), points, percent)
    links = links.unionByName(met.where("linked").select(F.col("pivot").alias("a"), F.col("point").alias("b")))

    # Windows: boundary documents, and the points of the region that can be within epsilon of one.
    epsilon = 1 - percent / 100
    radius = homes.groupBy(F.col("home").alias("pivot")).agg(F.max("d").alias("radius")).where("radius > 0")
    edge = written(met.where("not linked").join(radius, "pivot").where(F.col("d") <= F.col("radius") + epsilon + 1e-9).select("pivot", "point", "d"))
    reach = edge.groupBy("pivot").agg(F.min("d").alias("nearest"))
    inside = homes.withColumnRenamed("home", "pivot").join(reach, "pivot").where(F.col("d") >= F.col("nearest") - epsilon - 1e-9)
    regions_ = edge.select(F.xxhash64("pivot").alias("region"), "point").unionByName(inside.select(F.xxhash64("pivot").alias("region"), "point"))
    if not crowded.isEmpty():
        many = written(lookup_join(placed, crowded.select("hash", "n"), ["hash"], "n").select("hash", "point"))
        first = written(many.groupBy("hash").agg(F.min("point").alias("first"), F.count("*").alias("n")))
        block = components(lookup_join(many, first, ["hash"], "n").select(F.col("point").alias("a"), F.col("first").alias("b")).distinct())
        regions_ = regions_.unionByName(block.select(F.xxhash64("least", F.lit(1)).alias("region"), "point"))
    return homes, links.unionByName(join_regions(regions_.distinct().join(points, "point").select("region", "point", "shingles"), percent))


# -- 4. inside a region -------------------------------------------------------------------------------------------------------------


class Index:
    """Sets by shingle, to count what other sets have in common with each."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        names = np.concatenate([np.zeros(0, np.uint64), *sets])
        order = np.argsort(names, kind="stable")
        self.names, self.owner = names[order], np.repeat(np.arange(self.n), [len(x) for x in sets])[order]
        self.sizes = np.fromiter(map(len, sets), np.int64, self.n)

    def overlaps(self, sets: list[np.ndarray]) -> np.ndarray:
        """Sizes of the intersections of each of ``sets`` (rows) with all sets of the index."""
        names = np.concatenate([np.zeros(0, np.uint64), *sets])
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        first = np.searchsorted(self.names, names, "left")
        times = np.searchsorted(self.names, names, "right") - first
        out = np.zeros(len(sets) * self.n, np.int64)
        cuts = np.searchsorted(np.cumsum(times), np.arange(MATCHES, int(times.sum()) + MATCHES, MATCHES))
        for a, b in zip([0, *cuts], [*cuts, len(names)], strict=True):
            t = times[a:b]
            at = np.repeat(first[a:b] - (np.cumsum(t) - t), t) + np.arange(int(t.sum()))
            out += np.bincount(np.repeat(row[a:b], t) * self.n + self.owner[at], minlength=len(out))
        return out.reshape(len(sets), self.n)

    def distances(self, sets: list[np.ndarray]) -> np.ndarray:
        both = self.overlaps(sets)
        return 1 - both / np.maximum(1, self.sizes[None] + np.fromiter(map(len, sets), np.int64, len(sets))[:, None] - both)


def _tie(label: np.ndarray, points: np.ndarray) -> None:
    """Give all points one label, the smallest, and with them all that have a label of theirs."""
    some = np.unique(label[points])
    if len(some) > 1:
        label[np.isin(label, some)] = some[0]


def _outright(points: np.ndarray, sets: list[np.ndarray], label: np.ndarray, percent: int = PERCENT) -> None:
    index = Index([sets[i] for i in points])
    for a in range(0, len(points), 128):
        some = points[a : a + 128]
        both, size = index.overlaps([sets[i] for i in some]), index.sizes[a : a + 128]
        linked = 100 * both >= percent * (size[:, None] + index.sizes[None] - both)
        for row in linked:
            _tie(label, points[row])


def regions(distances: np.ndarray, epsilon: float = EPSILON) -> list[np.ndarray]:
    """For each pivot (row) the points of its region, and last those of the region outside. Any two points within ``epsilon`` share one."""
    nearest = distances.min(0)
    inside = (distances <= nearest + 2 * epsilon + 1e-9) & (distances <= RADIUS + epsilon + 1e-9)
    return [*(np.flatnonzero(x) for x in inside), np.flatnonzero(nearest > RADIUS)]


def join_region(points: np.ndarray, sets: list[np.ndarray], label: np.ndarray, depth: int = 0, percent: int = PERCENT) -> None:
    """Tie all linked pairs among ``points``: split by pivots while that helps, compare outright what is small or can't be split."""
    if len(points) <= LEAF or depth > 12:
        return _outright(points, sets, label, percent)
    pivots = points[depth % PIVOT_SHARE :: max(PIVOT_SHARE, len(points) // MOST_PIVOTS)]
    parts = regions(Index([sets[i] for i in points]).distances([sets[i] for i in pivots]), 1 - percent / 100)
    if sum(len(p) ** 2 for p in parts) > 0.7 * len(points) ** 2:
        return _outright(points, sets, label, percent)
    for p in parts:
        if len(p) > 1:
            join_region(points[p], sets, label, depth + 1, percent)


def _join(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(a, b): each point of a region and the first that it is tied to."""
    pdf = pdf.sort_values("point", ignore_index=True)
    label = np.arange(len(pdf))
    join_region(label.copy(), [np.frombuffer(x, np.uint64) for x in pdf["shingles"]], label, percent=percent)
    ids = pdf["point"].to_numpy()
    return pd.DataFrame({"a": ids, "b": ids[label]})


def _join_of(percent: int):
    return lambda pdf: _join(pdf, percent)


def _deal_regions(batches: Iterator[pa.RecordBatch], pivots: dict[int, list[bytes]], epsilon: float) -> Iterator[pa.RecordBatch]:
    """Each point once for every region of its block that it belongs to."""
    index = {region: Index([np.frombuffer(x, np.uint64) for x in of]) for region, of in pivots.items()}
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            pdf = batch.slice(at, 256).to_pandas()
            for region, some in pdf.groupby("region"):
                if region not in index:  # it drew no pivot
                    yield pa.RecordBatch.from_pandas(some[["region", "point", "shingles"]], preserve_index=False)
                    continue
                parts = regions(index[region].distances([np.frombuffer(x, np.uint64) for x in some["shingles"]]).T, epsilon)
                for k, own in enumerate(parts):
                    if len(own):
                        name = int(_mix(np.array([region], np.int64).view(np.uint64) + np.uint64(k + 1)).view(np.int64)[0])
                        yield pa.RecordBatch.from_pandas(some.iloc[own].assign(region=name)[["region", "point", "shingles"]], preserve_index=False)


def join_regions(regions_: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links that tie what is connected inside each region of (region, point, shingles)."""
    large, found = written(regions_), None
    for deal in range(DEALS + 1):
        sizes = written(large.groupBy("region").agg(F.count("*").alias("n"), F.sum(F.octet_length("shingles")).alias("bytes")))
        over = (F.col("n") > TASK_POINTS) | (F.col("bytes") > TASK_BYTES)
        fits = large.join(sizes.where(~over).select("region"), "region", "left_semi")
        links = fits.groupBy("region").applyInPandas(_join_of(percent), "a long, b long").where("a <> b")
        found = links if found is None else found.unionByName(links)
        drawn = F.least(F.col("n") / PIVOT_SHARE, F.lit(float(MOST_PIVOTS)))
        regions_over, weight = sizes.where(over).agg(F.count("*"), F.sum(drawn * F.col("bytes") / F.col("n"))).first()
        if not regions_over:
            return found
        if deal == DEALS:
            break
        large = large.join(sizes.where(over), "region")
        # Fewer pivots rather than more bytes to broadcast.
        chance = drawn * min(1.0, PIVOT_BYTES / 2 / weight)
        chosen = large.where(F.pmod(F.xxhash64("point", "region"), F.col("n")) < chance).select("region", "shingles")
        size = chosen.agg(F.sum(F.octet_length("shingles"))).first()[0]
        if not size or size > PIVOT_BYTES:
            break
        pivots: dict[int, list[bytes]] = {}
        for r in chosen.toLocalIterator():
            pivots.setdefault(r["region"], []).append(bytes(r["shingles"]))
        shared = large.sparkSession.sparkContext.broadcast(pivots)
        def dealt(rows: DataFrame, shared=shared) -> DataFrame:
            return rows.select("region", "point", "shingles").mapInArrow(lambda batches: _deal_regions(batches, shared.value, 1 - percent / 100), "region long, point long, shingles binary")

        some = large.where(F.pmod(F.xxhash64("point", F.lit(11)), F.lit(16)) == 0)
        if dealt(some).count() > COPIES * some.count():
            break
        large = written(dealt(large))
    # What pivots don't part is compared tile by tile; each pair of tiles is one task's work.
    large = large.select("region", "point", "shingles").join(sizes.where(over), "region")
    tiled = large.withColumn("tiles", F.ceil(F.greatest(F.col("n") / TASK_POINTS, F.col("bytes") / TASK_BYTES) * 2).cast("int")).withColumn("tile", F.pmod(F.xxhash64("point", F.lit(7)), F.col("tiles")).cast("int"))
    pairs = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = pairs.select(F.xxhash64("region", F.least("tile", "other"), F.greatest("tile", "other")).alias("region"), "point", "shingles")
    return found.unionByName(pairs.groupBy("region").applyInPandas(_join_of(percent), "a long, b long").where("a <> b"))


def merged_regions(points: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(point, component) for all points that may link: the least pivot of the regions that links tie together."""
    if points.isEmpty():
        return points.select("point", F.col("point").alias("component"))
    homes, links = regional_links(points, percent)
    home = lambda of: homes.select(F.col("point").alias(of), F.col("home").alias(f"home_{of}"))
    tied = components(links.join(home("a"), "a").join(home("b"), "b").select(F.col("home_a").alias("a"), F.col("home_b").alias("b")).where("a <> b").distinct())
    return homes.join(tied.select(F.col("point").alias("home"), "least"), "home", "left").select("point", F.coalesce("least", "home").alias("component"))


@settled
def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id (the smallest id reachable by links).

    Documents link when their shingles of ``width`` words have a Jaccard similarity of ``percent`` / 100 at least; the defaults are op9's.

    A null text, or one without words, has the empty set and links with nothing, not even its like; other equal texts link. Rows that repeat an id
    are documents of their own with that id; a null id is no smallest id unless all of its component are null. No rows give no rows. Texts and sets are told apart by 128-bit digests,
    shingles by 64-bit hashes. Other columns play no part, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("key"))
    texts = rows.select("key", "text")
    near = near_texts(texts, width, percent)
    sets = written(lookup_join(texts, near.where("near").select("key", "times"), ["key"], "times").select("key", "text").mapInArrow(partial(_sets, width=width), "key binary, digest binary, shingles binary"))
    # Written once, so that a point's number stays.
    one = sets.where("shingles is not null").select("digest", "shingles").dropDuplicates(["digest"])
    points = written(one.select(F.monotonically_increasing_id().alias("point"), "digest", F.octet_length("shingles").alias("bytes"), "shingles"))
    regions_ = merged_regions(points, percent)  # numbers of points and of pivots alike
    named = sets.select("key", "digest").distinct().join(points.select("digest", "point"), "digest").select("key", "point")
    component = named.join(regions_, "point", "left").select("key", F.coalesce("component", "point").alias("component"))
    known = written(near.join(component, "key", "left").select("key", "n_shingles", "component", "times"))
    labelled = written(lookup_join(rows.select("doc_id", "key"), known, ["key"], "times").select("doc_id", "n_shingles", "component"))
    least = written(labelled.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")))
    alone = labelled.where("component is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return alone.unionByName(lookup_join(labelled.where("component is not null"), least, ["component"], "n").select("doc_id", "n_shingles", "component_id"))
