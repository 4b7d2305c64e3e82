"""Sharding by a two-pass external shuffle: a global random order in pieces that fit in memory.

Pass one scatters records over buckets by a seeded hash, so that a bucket holds about ``bucket_bytes``. Pass two gathers each
bucket, deals it into hands in the order of the same hash, shuffles each hand (Fisher and Yates) with draws that are hashes too, and numbers it. (Spark's own ``shuffle`` draws by the number of the partition, so its order would change with the layout.) A record's place in the global order is the rows of all
buckets before plus its place in its own; shards take places in turn, so that their row counts differ by one at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subledger.llm.common import lookup_join, without, written

#: Bytes of text that one bucket holds on average.
BUCKET_BYTES = 8 << 20
#: Records that a hand has: an array of so many is shuffled at once.
HAND = 32
#: Rows that one bucket holds on average at most.
BUCKET_ROWS = 50_000
#: Equal rows that one task makes of their count at once.
EQUAL_RUN = 1000
#: Buckets whose offsets are summed in one window.
BLOCK = 1024


def _offsets(sizes: DataFrame) -> DataFrame:
    """(bucket, offset): the rows of all buckets before, summed in blocks of BLOCK buckets and then over the blocks."""
    sizes = sizes.withColumn("block", F.expr(f"bucket div {BLOCK}"))
    inside = Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.groupBy("block").agg(F.sum("n").alias("block_n"))
    before = blocks.withColumn("start", F.coalesce(F.sum("block_n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return sizes.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(before.select("block", "start"), "block").select("bucket", (F.col("start") + F.col("inner")).alias("offset"))


def _dealt(records: DataFrame, seed: int, buckets: int) -> DataFrame:
    """(record, dice, bucket): dice are a hash of the whole row and, for rows that are equal in every column, of which of them it is.

    So the deal is the same however the rows come and however often they are computed. Rows whose hash repeats are counted by content, with a combination before the shuffle, and
    dealt one by one from the count, so that no group of equal rows fills a bucket.
    """
    rows = records.select(F.struct("*").alias("record")).withColumn("hash", F.xxhash64(F.lit(seed), "record"))
    repeated = written(rows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"))
    if repeated.isEmpty():
        dealt = rows.withColumn("dice", F.xxhash64("hash", F.lit(0).cast("long")))
    else:
        equal = lookup_join(rows, repeated, ["hash"], "n").groupBy("hash", "record").agg(F.count("*").alias("times"))
        # A count is spread over tasks before it is made rows again, in runs of EQUAL_RUN.
        runs = equal.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {EQUAL_RUN}")))).repartition("hash", "run")
        copies = runs.withColumn("which", F.explode(F.sequence(F.col("run") * EQUAL_RUN, F.least((F.col("run") + 1) * EQUAL_RUN, F.col("times")) - 1)))
        apart = without(rows, repeated, ["hash"], "n")
        dealt = apart.withColumn("which", F.lit(0).cast("long")).unionByName(copies.select("record", "hash", "which")).withColumn("dice", F.xxhash64("hash", "which"))
    return dealt.select("record", "dice", F.pmod("dice", F.lit(buckets)).alias("bucket"))


def _fisher_yates(bucket: Column, number: Column, hand: Column, seed: int) -> Column:
    """The hand shuffled from inside out: the i-th record takes the place of the j-th, which moves to the end; j is a hash of seed, bucket, hand and i, from 0 to i."""

    def put(done: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(F.lit(seed), bucket, number, i), i + 1).cast("int")
        return F.when(j == i, F.concat(done, F.array(i))).otherwise(F.concat(F.slice(done, F.lit(1), j), F.array(i), F.slice(done, j + 2, i), F.slice(done, j + 1, F.lit(1))))

    order = F.aggregate(F.sequence(F.lit(0), F.size(hand) - 1), F.array().cast("array<int>"), put)
    return F.transform(order, lambda i: F.get(hand, i))


def external_shuffle(records: DataFrame, size_col: str = "size", shards: int = 8, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Every row of ``records`` once, all its columns in the struct ``record``, with bucket, position, shard and slot.

    ``position`` is the row's place in the seeded global order, gapless from 0; ``shard = position mod shards`` and
    ``slot = position div shards``. Repeated rows are rows of their own; nulls in any column are kept; a null or negative size counts as 0, and buckets are
    bounded by rows too. No rows give no rows. The order depends on the rows and the seed alone, not on how the input is split or in which order it comes; a bucket takes each row by
    its own dice, so no key, source or group of copies can fill one. Columns of map type, which Spark can't compare, are not supported.
    """
    total, n = records.agg(F.sum(F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0))), F.count("*")).first()
    buckets = max(1, math.ceil((total or 0) / bucket_bytes), math.ceil(n / bucket_rows))
    dealt = _dealt(records, seed, buckets)
    offsets = _offsets(dealt.groupBy("bucket").agg(F.count("*").alias("n")))
    held = dealt.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("dice", "record"))).alias("held"))
    hands = F.transform(F.sequence(F.lit(0), F.expr(f"(size(held) - 1) div {HAND}").cast("int")), lambda h: _fisher_yates(F.col("bucket"), h, F.slice("held", h * HAND + 1, F.lit(HAND)), seed))
    placed = held.join(offsets, "bucket").select("bucket", "offset", F.posexplode(F.flatten(hands)).alias("at", "one"))
    position = F.col("offset") + F.col("at")
    return placed.select(F.col("one.record").alias("record"), F.col("bucket").cast("long"), position.alias("position"), F.pmod(position, F.lit(shards)).cast("int").alias("shard"), F.expr(f"(offset + at) div {int(shards)}").alias("slot"))


def write_shards(placed: DataFrame, path: str) -> DataFrame:
    """Write the records to ``path``/shard=N/ and return the table as read from there.

    Each task writes its buckets' records as they are placed, without another shuffle; a file holds runs of slots of one shard, in slot order.
    """
    rows = placed.select("slot", "bucket", "position", "record.*", "shard")
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return placed.sparkSession.read.schema(rows.schema).parquet(path)
