"""Helpers that the corpus operators share."""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest size in bytes of a side that is broadcast; a larger side is joined by a shuffle.
BROADCAST_BYTES = 8 << 20
#: A key is hot when it holds more than one in HOT_SHARE rows, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 256
#: Partitions that a hot key's rows are dealt over where it is too large to broadcast.
SALTS = 64


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


#: Folders made here for local sessions without ``spark.checkpoint.dir``, by application id.
_OWN_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession, folder: str | None = None) -> str:
    """The folder that driver and executors share: ``folder`` if given, else ``spark.checkpoint.dir``. Where that is unset too, one of our own, on a local master only: on a cluster a temporary folder would be each machine's own."""
    folder = folder or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN_FOLDERS:
        _OWN_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="spark-shared-")
    return _OWN_FOLDERS[context.applicationId]


def _path(spark: SparkSession, path: str):
    """(file system, path) as Hadoop knows them."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    files, at = _path(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


_OPEN = threading.local()


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: it cuts the lineage and survives lost executors. The files go with ``discard``, at the end of a ``settled`` function, or when the application ends."""
    folder = scratch(df.sparkSession)
    df.write.parquet(f"{folder}/rows")
    back = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")
    back.shared_path = folder
    for tables in getattr(_OPEN, "scopes", [])[-1:]:
        tables.append(back)
    return back


def discard(table: DataFrame) -> None:
    """Delete the files of a ``written`` table that nothing will read again."""
    files, path = _path(table.sparkSession, table.shared_path)
    files.delete(path, True)


def settled(operator):
    """An operator whose result is written, whereupon all tables that it has written on the way are deleted."""

    @functools.wraps(operator)
    def run(*args, **options) -> DataFrame:
        scopes = _OPEN.__dict__.setdefault("scopes", [])
        scopes.append(tables := [])
        try:
            found = operator(*args, **options)
        finally:
            scopes.pop()
        kept = written(found)
        for table in tables:
            discard(table)
        return kept

    return run


def _bytes(table: DataFrame) -> Column:
    return sum((F.coalesce(F.octet_length(c), F.lit(0)) if t in ("string", "binary") else F.lit(8) for c, t in table.dtypes), F.lit(16))


def _divided(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, bool]:
    """(rows, table) of the hot keys and of the others, and whether the hot keys' part of the table may be broadcast.

    Both sides are told apart by the hash of the key, of which the driver holds fewer than HOT_SHARE; a key that shares a hot one's hash goes with it on both sides.
    """
    mark = F.xxhash64(*keys)
    hot = mark.isin([r[0] for r in table.where(F.col(weight) * HOT_SHARE > total).select(mark).collect()])
    few = table.where(hot)
    return rows.where(hot), few, rows.where(~hot), table.where(~hot), (few.agg(F.sum(_bytes(few))).first()[0] or 0) <= BROADCAST_BYTES


def lookup_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, broadcast_bytes: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with a written ``table`` that has one row for each key; its ``weight`` column says how many rows the key has.

    A table of up to ``broadcast_bytes`` (measured) is broadcast, BROADCAST_BYTES if not given. Of a larger one only the hot keys are, fewer than HOT_SHARE of them, if their bytes (measured too) are within BROADCAST_BYTES;
    else each hot key goes to SALTS partitions and its rows are dealt over these. The other keys meet in a shuffle, where none is hot. A null key meets nothing.
    """
    size, total = table.agg(F.sum(_bytes(table)), F.sum(weight)).first()
    if (size or 0) <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        return rows.join(F.broadcast(table), keys)
    hot_rows, hot, cold_rows, cold, small = _divided(rows, table, keys, weight, total)
    if small:
        met = hot_rows.join(F.broadcast(hot), keys)
    else:
        dealt = hot_rows.withColumn("_salt", F.pmod(F.xxhash64(*hot_rows.columns), F.lit(SALTS)).cast("int"))
        met = dealt.join(hot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "_salt"]).drop("_salt")
    return met.unionByName(cold_rows.join(cold, keys))


def without(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``rows`` whose key is not in the written ``table``; sizes and hot keys are treated as ``lookup_join`` does."""
    size, total = table.agg(F.sum(_bytes(table)), F.sum(weight)).first()
    if (size or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table.select(*keys)), keys, "left_anti")
    hot_rows, hot, cold_rows, cold, small = _divided(rows, table, keys, weight, total)
    if small:
        left = hot_rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    else:
        dealt = hot_rows.withColumn("_salt", F.pmod(F.xxhash64(*hot_rows.columns), F.lit(SALTS)).cast("int"))
        left = dealt.join(hot.select(*keys).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "_salt"], "left_anti").drop("_salt")
    return left.unionByName(cold_rows.join(cold.select(*keys), keys, "left_anti"))
