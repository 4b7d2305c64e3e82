"""Quality rules by cross-document line frequency.

Lines are normalised and hashed; for each host (``source``) the distinct documents that hold a line are counted. A line in more documents than the limit is boilerplate
and is removed; a document that loses most of its characters is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subledger.llm.common import BROADCAST_BYTES, let, lookup_join, without, written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: A line is removed when more than LEAST_DOCS documents of its host hold it, however many documents the host has.
LEAST_DOCS = 10
#: Removed lines of a host that one look-up compares.
LOOK_UP = 8
#: A document is rejected when less than this share of its characters is left.
LEFT_SHARE = 0.2


def split_words(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def n_repeat_words(words: Column) -> Column:
    """Words that lie in a window of three words which the array holds twice or more."""
    threes = lambda hs: F.slice(F.transform(hs, lambda h, i: F.xxhash64(h, F.get(hs, i + 1), F.get(hs, i + 2))), F.lit(1), F.greatest(F.size(hs) - 2, F.lit(0)))
    windows = let(F.transform(words, lambda w: F.xxhash64(w)), threes)

    def covered(marked: Column) -> Column:
        twin = lambda x, i: ((i > 0) & (F.get(marked, i - 1)["h"] == x["h"])) | F.coalesce(F.get(marked, i + 1)["h"] == x["h"], F.lit(False))
        at = F.transform(F.filter(marked, twin), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
        return F.size(F.array_distinct(F.flatten(at)))

    def count(w: Column) -> Column:
        marked = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(marked, covered)).cast("long")

    return let(windows, count)


def base_measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text; a null text has none of anything."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    return let(split_words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(_without(whole, " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        (F.octet_length(whole) - F.octet_length(_without(whole, SYMBOLS))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        n_repeat_words(w).alias("n_repeat_words"),
    ))


def marked_lines(text: Column) -> Column:
    """Array of (hash, chars, line) of all lines of a text; case, digits and outer white space of a line don't matter, and a line without a word has no chars."""
    plain = lambda x: F.btrim(F.regexp_replace(F.lower(x), "[0-9]", "0"), F.lit(" \t\n\x0b\x0c\r"))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: let(plain(x), lambda p: F.struct(F.xxhash64(p).alias("hash"), F.char_length(p).cast("long").alias("chars"), x.alias("line"))))


def line_marks(text: Column) -> Column:
    """``marked_lines`` with a word."""
    return F.filter(marked_lines(text), lambda m: m["chars"] > 0)


def frequent_lines(docs: DataFrame, text_col: str = "text", host_col: str = "source", document_col: str | None = None, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(host, line, n): for each host the hashes of the lines that more than ``least_docs`` of its distinct documents hold, and how many do. A null host is a host of its own, named ''.

    Rows with the same ``document_col`` are one document; without that column, or where it is null, rows of equal text are.
    """
    by_text = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    document = F.coalesce(F.col(document_col).cast("string"), by_text) if document_col else by_text
    marked = docs.select(F.coalesce(F.col(host_col), F.lit("")).alias("host"), document.alias("document"), F.array_distinct(F.transform(line_marks(F.col(text_col)), lambda m: m["hash"])).alias("lines"))
    held = marked.select("host", "document", F.explode("lines").alias("line")).distinct()
    return held.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > least_docs)


def _dealt(frequent: DataFrame) -> DataFrame:
    """(host, lines): the hashes of each host in lists of about LOOK_UP; hash h is in list ``h mod number of lists``. For a table that is small enough to broadcast."""
    sized = frequent.groupBy("host").agg(F.greatest(F.floor(F.count("*") / LOOK_UP), F.lit(1)).cast("long").alias("parts"))
    each = frequent.join(sized, "host").select("host", F.pmod("line", "parts").alias("at"), "line")
    empty = sized.select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("at"), F.lit(None).cast("long").alias("line"))
    lists = each.unionByName(empty).groupBy("host", "at").agg(F.collect_list("line").alias("own"))
    return lists.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "own"))), lambda x: x["own"]).alias("lines"))


def _held_by(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """``rows`` (record, body, host) with ``lines``: a list of the frequent lines that the row itself holds. One join on (host, line) and one on the text, whatever a host's number of frequent lines."""
    keyed = rows.withColumn("key", F.md5(F.coalesce("body", F.lit(""))))
    each = keyed.select("host", "key", F.explode(F.array_distinct(F.transform(line_marks(F.col("body")), lambda m: m["hash"]))).alias("line"))
    own = written(lookup_join(each, frequent, ["host", "line"], "n").select("host", "key", "line").distinct().groupBy("host", "key").agg(F.array(F.collect_list("line")).alias("lines")))
    counts = keyed.groupBy("host", "key").agg(F.count("*").alias("times"))
    found = written(own.join(counts, ["host", "key"]))
    none = without(keyed, found, ["host", "key"], "times").withColumn("lines", F.lit(None).cast("array<array<bigint>>"))
    return lookup_join(keyed, found, ["host", "key"], "times").select("record", "body", "host", "lines").unionByName(none.select("record", "body", "host", "lines"))


def quality_rules(docs: DataFrame, text_col: str = "text", host_col: str = "source", document_col: str | None = None, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` with the struct ``rules``: the base measures, base_failed, removed_chars, line_chars, kept and text, which is the text without the removed lines.

    A null or empty text has no words and so fails the base rule. Lines are judged by the counts of all distinct documents of their host: those of ``document_col``, or by equal texts without it, so that
    copies can't make their own lines boilerplate. Repeated rows get equal results; other columns stay, but for one named ``rules``, which is replaced. No rows give no rows.
    """
    frequent = written(frequent_lines(docs, text_col, host_col, document_col, least_docs))
    size = frequent.agg(F.sum(F.octet_length("host") + F.lit(48))).first()[0] or 0
    rows = docs.select(F.struct("*").alias("record"), F.col(text_col).alias("body"), F.coalesce(F.col(host_col), F.lit("")).alias("host"))
    marked = rows.join(F.broadcast(_dealt(frequent)), "host", "left") if size <= BROADCAST_BYTES else _held_by(rows, frequent)

    def ruled(base: Column) -> Column:
        failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
        total = lambda ms: F.aggregate(ms, F.lit(0).cast("long"), lambda s, m: s + m["chars"])

        def weighed(marks: Column) -> Column:
            removed = lambda m: (m["chars"] > 0) & F.array_contains(F.get("lines", F.pmod(m["hash"], F.size("lines")).cast("int")), m["hash"])
            gone = F.when(F.col("lines").isNull(), F.lit(0).cast("long")).otherwise(total(F.filter(marks, removed)))
            left = F.array_join(F.transform(F.filter(marks, lambda m: ~removed(m)), lambda m: m["line"]), "\n")
            return let(gone, lambda g: F.struct(g.alias("removed_chars"), total(marks).alias("line_chars"), F.when(g > 0, left).otherwise(F.col("body")).alias("text")))

        return let(let(marked_lines(F.col("body")), weighed), lambda x: F.struct(
            *(base[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
            failed.alias("base_failed"), x["removed_chars"].alias("removed_chars"), x["line_chars"].alias("line_chars"),
            (~failed & (x["line_chars"] - x["removed_chars"] >= LEFT_SHARE * x["line_chars"])).alias("kept"), x["text"].alias("text"),
        ))

    return marked.select(*(F.col("record")[c].alias(c) for c in docs.columns if c != "rules"), let(base_measures(F.col("body")), ruled).alias("rules"))
