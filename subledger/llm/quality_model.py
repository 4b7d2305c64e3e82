"""Quality by perplexity under an interpolated modified Kneser-Ney model of character trigrams, trained on trusted text.

Every text's trigrams are counted and dealt to shards by their context. The counts of trusted texts, summed over the corpus, give the model by joins of count tables: trigrams
with their contexts, bigrams by how many characters come before them, and so on down to the uniform distribution. Each shard joins its part of the model with the texts'
counts; the shards' sums give each text's log probability. One in HELD_OUT trusted texts is not trained on; a text is kept if its perplexity is within a quantile of those of its language.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subledger.llm.common import BROADCAST_BYTES, discard, written
from subledger.llm.words import groups

#: A text is kept up to this quantile of the perplexities of held-out trusted texts in its language; one in HELD_OUT is held out, by a hash of its id.
QUANTILE, HELD_OUT = 0.99, 5
#: Shards of the model: SHARDS at least, and one for every SHARD_BYTES of text. More shards mean fewer copies of the model, one for each salt.
SHARDS, SHARD_BYTES = 16, 256 << 20
#: Bytes of texts' counts that one task joins with one shard.
TASK_BYTES = 8 << 20
#: Stand for what comes before a text, twice, and for its end.
BEFORE, END = 2, 3
_MASK = (1 << 21) - 1


def _grams(text: str | None) -> np.ndarray:
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.concatenate([[BEFORE, BEFORE], codes, [END]])
    return codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]


def spread(part: int, k: int, salts: int) -> int:
    """The salt of the k-th group of texts of a partition: a hash of both, so that few groups in each of many partitions use all salts."""
    return xxhash.xxh3_64_intdigest(f"{part} {k}") % salts


def _count(batches: Iterator[pa.RecordBatch], salts: int, shards: int) -> Iterator[pa.RecordBatch]:
    """For each group of texts a head (ids, languages, lengths) and for each shard its trigrams, how many entries each has, and the entries: a text of the group and a count of 255 at most."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for k, batch in enumerate(groups(batches)):
        found = [np.unique(_grams(t), return_counts=True) for t in batch.column("text").to_pylist()]
        lengths = np.array([int(c.sum()) for _, c in found], np.int64)
        gram, count = np.concatenate([g for g, _ in found]), np.concatenate([c for _, c in found])
        owner = np.repeat(np.arange(len(found)), [len(g) for g, _ in found])
        times = -(-count // 255)
        last = np.cumsum(times) - 1
        gram, owner = np.repeat(gram, times), np.repeat(owner, times)
        entry = np.full(len(gram), 255)
        entry[last] = count - 255 * (times - 1)
        shard = ((gram >> 42) * 31 + (gram >> 21 & _MASK) * 131) % shards
        order = np.lexsort((owner, gram, shard))
        gram, owner, entry, shard = gram[order], owner[order].astype(np.uint16), entry[order].astype(np.uint8), shard[order]
        edge = np.searchsorted(shard, np.arange(shards + 1))
        name = part << 32 | k
        rows = [(name, -1, 0, pickle.dumps((batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist())), lengths.tobytes(), b"", b"")]
        for s, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
            own, n = np.unique(gram[a:b], return_counts=True)
            rows.append((name, s, spread(part, k, salts), own.tobytes(), n.astype(np.uint32).tobytes(), owner[a:b].tobytes(), entry[a:b].tobytes()))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["grp", "shard", "salt", "grams", "sizes", "owners", "entries"])


_COUNTED = "grp long, shard int, salt int, grams binary, sizes binary, owners binary, entries binary"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for grp, head in zip(batch.column("grp").to_pylist(), batch.column("grams").to_pylist(), strict=True):
            ids, _ = pickle.loads(head)
            yield pa.RecordBatch.from_arrays([pa.array([grp] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int32()), pa.array(ids, pa.int64())], ["grp", "owner", "doc_id"])


def _flags(pdf: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(int(pdf["owner"].max()) + 1, bool)
    bits[pdf["owner"]] = True
    return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "trusted": [np.packbits(bits).tobytes()]})


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n): how often the trusted texts of a group have it; 0 where only others do."""
    for batch in batches:
        for r in batch.to_pylist():
            gram, sizes = np.frombuffer(r["grams"], np.int64), np.frombuffer(r["sizes"], np.uint32)
            if not len(gram):
                continue
            bits = np.zeros(1 << 16, bool)
            if r["trusted"]:
                flags = np.unpackbits(np.frombuffer(r["trusted"], np.uint8)).astype(bool)
                bits[: len(flags)] = flags
            n = np.frombuffer(r["entries"], np.uint8).astype(np.int64) * bits[np.frombuffer(r["owners"], np.uint16)]
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(np.add.reduceat(n, (np.cumsum(sizes) - sizes).astype(np.int64)))], ["gram", "n"])


def _discounts(counts: DataFrame) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more, from how many counts are 1 to 4."""
    n1, n2, n3, n4 = counts.agg(*(F.count_if(F.col("n") == k) for k in (1, 2, 3, 4))).first()
    if not (n1 and n2 and n3):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    return [min(k, max(0.05, k - (k + 1) * y * b / a)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def _context(counts: DataFrame, key: str, discount: list[float], name: str) -> DataFrame:
    """(key, name_total, name_left): all counts of a context, and the share that discounting leaves for the shorter one."""
    left = sum(F.count_if(F.col("n") == k) * discount[k - 1] for k in (1, 2)) + F.count_if(F.col("n") > 2) * discount[2]
    return counts.groupBy(key).agg(F.sum("n").alias(f"{name}_total"), left.alias("left")).select(key, f"{name}_total", (F.col("left") / F.col(f"{name}_total")).alias(f"{name}_left"))


def _share(n: Column, total: Column, left: Column, discount: list[float], shorter: Column) -> Column:
    less = F.when(n == 1, discount[0]).when(n == 2, discount[1]).otherwise(discount[2])
    own = F.when(n > 0, (n - less) / total).otherwise(0.0)
    return F.when(total.isNull(), shorter).otherwise(own + left * shorter)


def kneser_ney(grams: DataFrame) -> DataFrame:
    """(gram, log_p) for each of (gram, n); n is 0 for trigrams to score that no trusted text has."""
    a, b, c = F.shiftright("gram", 42), F.shiftright("gram", 21).bitwiseAND(F.lit(_MASK)), F.col("gram").bitwiseAND(F.lit(_MASK))
    every = grams.select("gram", "n", F.shiftright("gram", 21).alias("ab"), b.alias("b"), c.alias("c"), F.shiftleft(b, 21).bitwiseOR(c).alias("bc"))
    seen = every.where("n > 0")
    threes = seen.select("ab", "n")
    twos = written(seen.groupBy("bc", "b", "c").agg(F.count("*").alias("n")))
    ones = written(twos.groupBy("c").agg(F.count("*").alias("n")))
    total, names = ones.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    d3, d2, d1 = _discounts(threes), _discounts(twos), _discounts(ones)
    left1 = 1.0 if not total else sum(d1[min(k, 3) - 1] * m for k, m in ones.groupBy(F.least("n", F.lit(3)).alias("k")).count().collect()) / total
    p1 = _share(F.coalesce("n1", F.lit(0)), F.lit(float(total) or None), F.lit(left1), d1, F.lit(1.0 / (names + 1)))
    p2 = _share(F.coalesce("n2", F.lit(0)), F.col("two_total"), F.col("two_left"), d2, p1)
    p3 = _share(F.col("n"), F.col("three_total"), F.col("three_left"), d3, p2)
    joined = every.join(_context(threes, "ab", d3, "three"), "ab", "left").join(twos.select("bc", F.col("n").alias("n2")), "bc", "left")
    joined = joined.join(_context(twos, "b", d2, "two"), "b", "left").join(ones.select("c", F.col("n").alias("n1")), "c", "left")
    return joined.select("gram", F.log(p3).alias("log_p"))


def _score(key, texts: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """Of one shard and salt: the sums of each text of each group."""
    model = model.sort_values("gram")
    names, log_p = model["gram"].to_numpy(), model["log_p"].to_numpy()
    out = []
    for r in texts.itertuples():
        sizes = np.frombuffer(r.sizes, np.uint32)
        if len(sizes):
            each = np.repeat(log_p[np.searchsorted(names, np.frombuffer(r.grams, np.int64))], sizes)
            out.append((r.grp, np.bincount(np.frombuffer(r.owners, np.uint16), each * np.frombuffer(r.entries, np.uint8)).tobytes()))
    return pd.DataFrame(out, columns=["grp", "sums"])


def _total(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one group: each text's log probability and length."""
    head = pdf[pdf["head"].notna()].iloc[0]
    (ids, langs), lengths = pickle.loads(head["head"]), np.frombuffer(head["sums"], np.int64)
    total = np.zeros(len(lengths))
    for x in pdf["sums"][pdf["head"].isna()]:
        part = np.frombuffer(x, np.float64)
        total[: len(part)] += part
    return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "lang": pd.array(langs, "string"), "n_symbols": lengths, "log_p": total})


def quality_model(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, lang, n_symbols, perplexity, threshold, kept. ``trusted`` has the ids of trusted texts.

    A null text counts as empty: its end is its one symbol. A null language is a language of its own. The model is of four in five trusted texts, the thresholds of the fifth; where that has none, all
    trusted texts give the threshold. A language without held-out texts has the threshold of all languages together; without any trusted text, every text is kept. A null id is never trusted. Rows that repeat get equal perplexities, and each counts. No rows give no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(max(SHARDS, size // SHARD_BYTES))
    salts = int(max(1, size * 0.4 // (shards * TASK_BYTES)))
    counted = written(rows.mapInArrow(partial(_count, salts=salts, shards=shards), _COUNTED))
    all_ids = trusted.select(F.col(trusted.columns[0]).cast("long").alias("doc_id")).dropna().distinct()
    held_out = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(HELD_OUT)) == 0
    ids = all_ids.where(~held_out)
    heads, parts = counted.where("shard = -1"), counted.where("shard >= 0")
    flags = written(heads.select("grp", "grams").mapInArrow(_members, "grp long, owner int, doc_id long").join(ids, "doc_id", "left_semi").groupBy("grp").applyInPandas(_flags, "grp long, trusted binary"))
    weight = flags.agg(F.sum(F.octet_length("trusted") + 24)).first()[0] or 0
    flagged = parts.join(F.broadcast(flags) if weight <= BROADCAST_BYTES else flags, "grp", "left")
    grams = written(flagged.select("grams", "sizes", "owners", "entries", "trusted").mapInArrow(_sums, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    shard = F.pmod(F.shiftright("gram", 42) * 31 + F.shiftright("gram", 21).bitwiseAND(F.lit(_MASK)) * 131, F.lit(shards)).cast("int")
    model = written(kneser_ney(grams).withColumn("shard", shard)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    sums = parts.groupBy("shard", "salt").cogroup(model.groupBy("shard", "salt")).applyInPandas(_score, "grp long, sums binary")
    each = heads.select("grp", F.col("grams").alias("head"), F.col("sizes").alias("sums")).unionByName(sums.withColumn("head", F.lit(None).cast("binary")))
    scored = each.groupBy("grp").applyInPandas(_total, "doc_id long, lang string, n_symbols long, log_p double")
    scored = written(scored.select("doc_id", "lang", "n_symbols", F.exp(-F.col("log_p") / F.col("n_symbols")).alias("perplexity")))
    discard(counted)
    known = scored.join(all_ids.where(held_out), "doc_id", "left_semi")
    if known.isEmpty():
        known = scored.join(all_ids, "doc_id", "left_semi")
    limit = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))
    overall = known.agg(limit).first()[0]
    by_lang = written(known.groupBy("lang").agg(limit.alias("own")).select(F.col("lang").alias("name"), "own"))
    judged = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("name")), "left")
    threshold = F.coalesce("own", F.lit(overall).cast("double"))
    return judged.select("doc_id", "lang", "n_symbols", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(True)).alias("kept"))
