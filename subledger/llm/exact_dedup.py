"""Exact deduplication by distributed MSD radix partitioning.

Texts are compared byte by byte, most significant digit first. A digit is a run of bytes: the first FIRST_DIGIT
bytes, then runs GROWTH times as long as all bytes before. Each pass splits every open group by its next digit; a group closes
when it is a single row or when its texts have ended. No digest takes part in the comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subledger.llm.common import lookup_join, settled, written

FIRST_DIGIT = 256
GROWTH = 4
SPACE = r"[\x20\x09-\x0D]+"


def digits(longest: int, first: int = FIRST_DIGIT, growth: int = GROWTH) -> list[tuple[int, int]]:
    """(start, length) of each digit of texts of up to ``longest`` bytes; starts count from 0."""
    found, at, length = [], 0, first
    while at < longest or not found:
        found.append((at, length))
        at += length
        length = at * (growth - 1)
    return found


def _piece(column, start: int, length: int):
    return F.substring(column, start + 1, length)


def normalised(text: Column) -> Column:
    """The bytes that are compared: UTF-8, with one space for each run of ASCII white space; none for a null."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ").cast("binary")


@settled
def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty; runs of ASCII white space count as one space. Of equal texts the row with the smallest
    id stays. A null id stays only if all ids of its group are null. Of rows that repeat both id and text exactly one
    has ``kept``. An empty input gives an empty result. Other columns of ``docs`` play no part, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("body"))
    start, length = digits(1)[0]
    rows = rows.select("doc_id", "body", F.sha2("body", 256).alias("text_sha256"), _piece(F.col("body"), start, length).alias("d0"))

    # First pass: what is alone under its first digit is done; only the others' texts are kept for the passes to come.
    first = written(rows.groupBy("d0").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.min("text_sha256").alias("text_sha256"), F.max(F.length("body")).alias("longest")))
    alone = first.where("n = 1").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    shared = first.where("n > 1").select("d0", "n")
    longest = first.where("n > 1").agg(F.max("longest")).first()[0]
    if longest is None:
        return alone

    rest = digits(longest)[1:]
    open_rows = written(
        lookup_join(rows, shared, ["d0"], "n").select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "text_sha256", F.length("body").alias("bytes"), "d0",
            *(_piece(F.col("body"), at, n).alias(f"d{k + 1}") for k, (at, n) in enumerate(rest)),
        )
    )

    state, closed, cuts = open_rows.withColumn("group", F.lit(0).cast("long")), alone, digits(longest)
    for k, (at, n) in enumerate(cuts):
        split = written(
            state.groupBy("group", f"d{k}").agg(
                F.count("*").alias("n"), F.max("bytes").alias("longest"),
                F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"),
            )
        )
        split = split.select("group", f"d{k}", "n", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("next"), ((F.col("n") == 1) | (F.col("longest") <= at + n)).alias("over"))
        # The digits on both sides weigh about the same, so that only hot ones are worth a broadcast.
        moved = lookup_join(state, split, ["group", f"d{k}"], "n", broadcast_bytes=0)
        left = [f"d{i}" for i in range(k + 1, len(cuts))]
        moved = written(moved.select("row", "doc_id", "text_sha256", "bytes", F.col("next").alias("group"), "keep_id", "n", "over", *(F.when(~F.col("over"), F.col(c)).alias(c) for c in left)))
        ended = moved.where("over").select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("group")).alias("kept"), "text_sha256")
        closed = closed.unionByName(ended)
        state = moved.where("not over").select("row", "doc_id", "text_sha256", "bytes", "group", *left)
        if state.isEmpty():
            break
    return closed
