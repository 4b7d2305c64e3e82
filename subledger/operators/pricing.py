"""Price evidence: votes of candidates, merging with what is stored, and checks of a page's prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["service", "plan", "route", "country", "currency"]
#: Kinds of evidence by their bit in a mask; the registry is no live evidence.
KIND_BITS = ("registry", "structured", "api", "help", "store", "page")


def valid(candidates: DataFrame, markets: DataFrame) -> DataFrame:
    """Exact prices above 0 in the currency of their country; ``markets`` (country, currency) is a short list."""
    exact = candidates.where((F.col("price_minor") > 0) & (F.coalesce("price_type", F.lit("exact")) == "exact"))
    return exact.join(F.broadcast(markets), ["country", "currency"], "left_semi")


def resolve(candidates: DataFrame) -> DataFrame:
    """One verified price at most for each key; ``candidates`` are valid ones.

    A price that two kinds of live evidence agree on wins, unless two prices have that; else the price of highest priority wins, unless two tie. Of the winner's candidates the one of highest priority, the earliest at a
    tie, gives the details. Kinds are counted by a bit mask, so both aggregations combine before their shuffle.
    """
    best = F.max_by(F.struct("kind", "ord", "line"), F.struct("priority", -F.col("ord"), -F.col("line")))
    bit = F.element_at(F.create_map(*(F.lit(x) for k, kind in enumerate(KIND_BITS) for x in (kind, 1 << k))), F.col("kind"))
    prices = candidates.groupBy(*KEY, "price_minor").agg(F.max("priority").alias("top"), F.bit_or(bit).alias("kinds"), best.alias("best"))
    n_kinds, n_live = F.bit_count("kinds").cast("bigint"), F.bit_count(F.col("kinds").bitwiseAND(F.lit((1 << len(KIND_BITS)) - 2)))
    has = lambda kind: F.col("kinds").bitwiseAND(F.lit(1 << KIND_BITS.index(kind))) != 0
    key = Window.partitionBy(*KEY)
    ranked = prices.withColumn("n_live", n_live).withColumns({"agreed": F.count_if(F.col("n_live") >= 2).over(key), "most": F.max("top").over(key)}).withColumn("ties", F.count_if(F.col("top") == F.col("most")).over(key))
    won = ranked.where("(agreed = 1 and n_live >= 2) or (agreed = 0 and top = most and ties = 1)")
    how = F.when(has("structured"), "authoritative-provider").when(has("registry"), "registry").when(n_kinds >= 2, "multi-source").otherwise("single-source")
    return won.select(*KEY, "price_minor", F.col("best.kind").alias("kind"), F.col("best.ord").alias("ord"), how.alias("verification"), n_kinds.alias("source_count"), (~has("structured") & (n_kinds >= 2)).alias("by_agreement"))


def conflicts(candidates: DataFrame) -> DataFrame:
    """Keys with valid evidence for which no price can be resolved."""
    return candidates.groupBy(*KEY).agg(F.count_distinct("price_minor").alias("n_prices")).join(resolve(candidates).select(*KEY), KEY, "left_anti")


def strong():
    """Evidence good enough to store."""
    return (F.col("price_minor") > 0) & ((F.col("verification") == "authoritative-provider") | ((F.col("verification") == "multi-source") & F.col("by_agreement") & (F.col("source_count") >= 2)))


def merge(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Fresh prices where they are strong, else stored ones, else fresh ones."""
    f = fresh.select(*KEY, F.col("price_minor").alias("fresh_minor"), strong().alias("strong"))
    s = stored.select(*KEY, F.col("price_minor").alias("stored_minor"))
    both = f.join(s, KEY, "full")
    use_fresh = F.coalesce("strong", F.lit(False)) | F.col("stored_minor").isNull()
    return both.select(*KEY, F.when(use_fresh, F.col("fresh_minor")).otherwise(F.col("stored_minor")).alias("price_minor"), F.when(use_fresh, "fresh").otherwise("stored").alias("origin"))


def store(stored: DataFrame, fresh: DataFrame, day) -> DataFrame:
    """Stored prices after strong fresh ones: ``verified_on`` moves only with the price, ``checked_on`` always."""
    f = fresh.where(strong()).select(*KEY, F.col("price_minor").alias("new_minor"))
    both = stored.join(f, KEY, "full")
    got = F.col("new_minor").isNotNull()
    moved = got & ~F.col("price_minor").eqNullSafe(F.col("new_minor"))
    return both.select(*KEY, F.coalesce("new_minor", "price_minor").alias("price_minor"), F.when(moved, F.lit(day)).otherwise(F.col("verified_on")).alias("verified_on"), F.when(got, F.lit(day)).otherwise(F.col("checked_on")).alias("checked_on"))


def snapshot(prices: DataFrame, by: list[str]) -> DataFrame:
    """Per ``by``: how many prices, the newest, and the distinct kinds in the order of first appearance."""
    firsts = prices.groupBy(*by, "kind").agg(F.min(F.struct("ord", "line")).alias("at"), F.max("seen_at").alias("seen"), F.count("*").alias("n"))
    kinds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "kind"))), lambda x: x["kind"]), ", ")
    return firsts.groupBy(*by).agg(F.sum("n").alias("n"), F.max("seen").alias("updated_at"), kinds.alias("sources"))


def cross_check(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of ``first`` whose plan (case and outer blanks aside) and amount ``second`` has too."""
    name = lambda: F.lower(F.btrim("plan"))
    other = second.select("service", name().alias("name"), "price_minor").distinct()
    return first.withColumn("name", name()).join(other, ["service", "name", "price_minor"], "left_semi").drop("name")


def unanimous(prices: DataFrame, keys: list[str]) -> DataFrame:
    """The amount of each key whose rows all agree."""
    return prices.groupBy(*keys).agg(F.min("price_minor").alias("price_minor"), F.max("price_minor").alias("other"), F.count("*").alias("n")).where("price_minor = other").drop("other")


def complete_sets(prices: DataFrame, plans: list[str]) -> DataFrame:
    """Rows of services that have every one of ``plans``, none with two amounts."""
    whole = prices.where(F.col("plan").isin(plans)).groupBy("service", "plan").agg(F.min("price_minor").alias("low"), F.max("price_minor").alias("high"))
    good = whole.groupBy("service").agg(F.count("*").alias("n"), F.max((F.col("low") != F.col("high")).cast("int")).alias("split")).where((F.col("n") == len(plans)) & (F.col("split") == 0))
    return whole.join(good.select("service"), "service", "left_semi").select("service", "plan", F.col("low").alias("price_minor"))


def unambiguous(prices: DataFrame) -> DataFrame:
    """(service, plan, amount) without amounts that two plans of a service share."""
    each = prices.select("service", "plan", "price_minor").distinct()
    shared = each.groupBy("service", "price_minor").agg(F.count("*").alias("n")).where("n > 1")
    return each.join(shared, ["service", "price_minor"], "left_anti").select("service", "plan", "price_minor")


def registry_quality(rows: DataFrame, markets: DataFrame) -> DataFrame:
    """Counts of what a registry must not have: keys twice, prices of 0 or less, missing ids, codes of the wrong form, a currency that is not its country's, a source that is no secure address."""
    keys = rows.groupBy(*KEY, "kind").agg(F.count("*").alias("n"))
    doubled = keys.agg(F.count_if(F.col("n") > 1).alias("doubled_keys"))
    placed = rows.join(F.broadcast(markets.select("country", F.col("currency").alias("own"))), "country", "left")
    no = lambda good: F.count_if(~F.coalesce(good, F.lit(False)))
    rest = placed.agg(
        F.count_if(F.col("price_minor") <= 0).alias("not_positive"), F.count_if(F.col("service").isNull() | F.col("plan").isNull()).alias("no_id"), no(F.col("country").rlike("^[A-Z]{2}$")).alias("bad_country"),
        no(F.col("currency") == F.col("own")).alias("foreign_currency"), no(F.col("source_url").startswith("https://")).alias("not_secure"), F.count("*").alias("n"),
    )
    return doubled.crossJoin(rest)  # one row each


def registry_scan(registry: DataFrame, service: object, country: str, currency: str) -> DataFrame:
    """A service's registry rows of one market; a missing route is direct."""
    own = registry.where((F.col("service") == F.lit(service)) & (F.col("country") == country.upper()) & (F.col("currency") == currency.upper()))
    return own.withColumn("route", F.coalesce("route", F.lit("direct")))


def store_catalogue(catalogue: DataFrame, markets: DataFrame) -> DataFrame:
    """Flat rows of a catalogue (service, country, currency, route, plans: array of (plan, price_minor)), of the given markets alone; store evidence, exact."""
    flat = catalogue.join(F.broadcast(markets), ["country", "currency"], "left_semi").select("service", "country", "currency", "route", F.inline("plans"))
    return flat.where("price_minor > 0").select("service", "plan", "route", "country", "currency", "price_minor", F.lit("exact").alias("price_type"), F.lit("store").alias("kind"))


def china_catalogue(catalogue: DataFrame) -> DataFrame:
    """The same for mainland China, where only prices in its own currency count."""
    return store_catalogue(catalogue, catalogue.sparkSession.createDataFrame([("CN", "CNY")], "country string, currency string"))


def market_sources(adapters: list[DataFrame], registry: DataFrame) -> DataFrame:
    """All evidence of a market: that of every adapter, and the registry's rows of services that no adapter covers."""
    rows = adapters[0]
    for other in adapters[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    covered = rows.select("service").distinct()
    return rows.unionByName(registry.join(covered, "service", "left_anti"), allowMissingColumns=True)


def last_of_each(prices: DataFrame) -> DataFrame:
    """The last row, by (ord, line), of each key."""
    last = prices.groupBy(*KEY).agg(F.max(F.struct("ord", "line", "price_minor", "kind")).alias("last"))
    return last.select(*KEY, F.col("last.price_minor").alias("price_minor"), F.col("last.kind").alias("kind"))


def verified_prices(stored: DataFrame, country: str, currency: str) -> DataFrame:
    """Stored prices of one market as the app shows them; codes in any case."""
    own = stored.where((F.col("country") == country.upper()) & (F.col("currency") == currency.upper()))
    return own.select("service", "plan", "route", "country", "currency", "price_minor", F.lit("exact").alias("price_type"), F.lit("verified").alias("confidence"), F.col("checked_on").alias("updated_on"))


def stored_counts(fresh: DataFrame) -> DataFrame:
    """(received, persisted): how many fresh prices there were, and how many are good enough to store."""
    return fresh.agg(F.count("*").alias("received"), F.count_if(strong()).alias("persisted"))


def refresh_summary(results: DataFrame) -> DataFrame:
    """(checked, refreshed, failed) of a batch of countries (country, n_prices; null where the refresh failed): failed ones are named in order."""
    each = results.groupBy("country").agg(F.max("n_prices").alias("n"))
    return each.agg(F.count("*").alias("checked"), F.count("n").alias("refreshed"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("n").isNull(), F.col("country")))), ",").alias("failed"))
