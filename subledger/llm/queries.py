"""The queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subledger.llm import grouped_packing, language_id, toxicity
from subledger.llm.common import let, scratch
from subledger.llm.conversation_trie import prefix_trie
from subledger.llm.exact_dedup import exact_dedup
from subledger.llm.jaccard_join import jaccard_components
from subledger.llm.license_scan import license_report
from subledger.llm.packing import pack, write_buckets
from subledger.llm.quality_model import quality_model
from subledger.llm.quality_rules import quality_rules
from subledger.llm.sentencepiece_sampling import decode, encode
from subledger.llm.sharding import external_shuffle, write_shards
from subledger.llm.tandem_runs import tandem_runs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(column: str, divisor: int):
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(divisor))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(_remainder("doc_id", 4) != 2))
    scored = toxicity.toxicity(docs, model)
    return scored.select("doc_id", F.coalesce(_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_model(table(spark, sf_dir, "documents"), trusted)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules(docs, document_col="doc_id").select("doc_id", *(f"rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_chars")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(docs: DataFrame) -> DataFrame:
    """The sequences as read from the buckets of equal lengths."""
    pieces = write_buckets(pack(docs, tokenizer_path("word_bpe_49k.json")), f"{scratch(docs.sparkSession)}/buckets")
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents shuffled and written; what is returned is read from the shards' files."""
    size, text = (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long"), F.coalesce("text", F.lit(""))
    placed = external_shuffle(table(spark, sf_dir, "documents").withColumn("size", size))
    shards = write_shards(placed, f"{scratch(spark)}/shards")
    return shards.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "bucket", "position")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    encoded = encode(table(spark, sf_dir, "documents"), path).withColumn("ids_crc32", F.crc32("ids"))
    return decode(encoded, path).select("doc_id", "n_pieces", "ids_crc32", F.octet_length("text").cast("long").alias("decoded_bytes"), F.crc32("text").alias("decoded_crc32"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(_remainder("doc_id", 3) != 1))
    found = language_id.identify(docs, model, ["doc_id"])
    return found.select("doc_id", F.coalesce(_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", F.array_join("languages", ",").alias("languages"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def _with_repeats(text, h):
    """The text, or, where h is a multiple of 10, its words with all from one place on replaced by repetitions of the first few of them."""
    g, words = F.floor(h / 10), F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(w):
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = let(F.slice(w, a + 1, p), lambda part: F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get(part, i % p)))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")).otherwise(text)

    return F.when((h % 10 == 0) & text.isNotNull(), let(words, repeated)).otherwise(text)


def op12_tandem_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _with_repeats(F.col("text"), F.crc32(F.col("doc_id").cast("string"))).alias("text"))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = tandem_runs(docs, ["doc_id"]).withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_grouped_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids themselves are digested before the pieces are dealt, so that only the pieces' sizes are shuffled."""
    parts = grouped_packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return grouped_packing.place(parts.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_quality_model, op3_quality_rules, op4_exact_dedup, op5_packing, op6_sharding, op7_sentencepiece, op8_license_scan, op9_jaccard_join, op10_language_id, op11_conversation_trie, op12_tandem_runs, op13_grouped_packing)}

#: DuckDB SQL where it can express the whole result; the others are tested in tests/llm/.
ORACLES: dict[str, str] = {
    "op3_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
windows AS (SELECT doc_id, i, [words[i], words[i + 1], words[i + 2]] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d WHERE len(words) > 2)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1),
lines AS (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS line FROM d),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
marks AS (SELECT doc_id, host, t, trim(regexp_replace(lower(line), '[0-9]', '0', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS mark FROM lines),
frequent AS (SELECT host, mark FROM marks WHERE mark <> '' GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > 10),
gone AS (SELECT doc_id, coalesce(sum(length(m.mark)) FILTER (f.mark IS NOT NULL), 0) AS removed, sum(length(m.mark)) AS total FROM marks m LEFT JOIN frequent f ON f.host = m.host AND f.mark = m.mark GROUP BY 1),
r AS (SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words, removed, total FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND total - removed >= 0.2 * total AS kept, CAST(removed AS BIGINT) AS removed_chars FROM r""",
    "op4_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM d WINDOW w AS (PARTITION BY t)""",
    "op9_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 3], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS MATERIALIZED (SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2) JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, e.y FROM reach JOIN e ON e.x = reach.r)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, g.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1) g USING (doc_id)""",
}
