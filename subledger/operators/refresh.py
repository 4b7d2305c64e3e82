"""A market's price refresh: evidence, votes, merging with stored prices, storing, and a snapshot cache whose entries last a day.

The state is three tables; a refresh is a function from old ones and a set of asked markets to new ones. All markets of a call are refreshed at once, by country as a column.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subledger.operators.pricing import KEY, resolve, strong, valid

#: How long a snapshot is served without asking anew.
LASTS = dt.timedelta(hours=24)
#: The market that is meant where none is named.
HOME = "US"
NO_CURRENCY, NOTHING_FOUND = "unsupported-currency-map", "no-exact-provider-price-found"

STORED = "service bigint, plan string, route string, country string, currency string, price_minor bigint, source string, verified_at timestamp, checked_at timestamp"
CACHE = "country string, currency string, fetched_at timestamp, updated_at timestamp, source string"
ITEMS = "service bigint, plan string, route string, country string, currency string, price_minor bigint, source string, updated_at timestamp"


@dataclass
class Prices:
    """``stored`` has the verified prices, one for each key; ``cache`` a snapshot for each country, and ``items`` its prices."""

    stored: DataFrame
    cache: DataFrame
    items: DataFrame


def no_prices(spark) -> Prices:
    return Prices(*(spark.createDataFrame([], schema) for schema in (STORED, CACHE, ITEMS)))


def _once(table: DataFrame) -> DataFrame:
    """The table worked out now and once, by a checkpoint; without a checkpoint folder, as it is."""
    return table.checkpoint() if table.sparkSession.conf.get("spark.checkpoint.dir", None) else table


def settled(state: Prices) -> Prices:
    """The state with its lineage cut by checkpoints, as a deployment would have stored it; without a checkpoint folder, as it is."""
    return Prices(*(_once(table) for table in (state.stored, state.cache, state.items)))


def merged(fresh: DataFrame, stored: DataFrame, now: dt.datetime) -> DataFrame:
    """Prices of both by key: fresh ones where they are strong or nothing is stored, else stored ones; ``place`` says in which order they came, fresh ones first."""
    new = fresh.select(*KEY, F.col("price_minor").alias("fresh_minor"), F.col("kind").alias("fresh_source"), strong().alias("strong"), "ord")
    old = stored.select(*KEY, F.col("price_minor").alias("stored_minor"), F.col("source").alias("stored_source"), "checked_at")
    both = new.join(old, KEY, "full")
    use = F.coalesce("strong", F.lit(False)) | F.col("stored_minor").isNull()
    pick = lambda a, b: F.when(use, a).otherwise(b)
    place = F.struct(F.col("ord").isNull().alias("late"), "ord", "service", "plan", "route", "currency")
    return both.select(*KEY, pick(F.col("fresh_minor"), F.col("stored_minor")).alias("price_minor"), pick(F.col("fresh_source"), F.col("stored_source")).alias("source"), pick(F.lit(now), F.col("checked_at")).alias("updated_at"), place.alias("place"))


def stored_after(stored: DataFrame, fresh: DataFrame, now: dt.datetime) -> DataFrame:
    """Stored prices after the strong fresh ones: ``verified_at`` moves with the price alone, ``checked_at`` with each of them."""
    new = fresh.where(strong()).select(*KEY, F.col("price_minor").alias("new_minor"), F.col("kind").alias("new_source"))
    both = stored.join(new, KEY, "full")
    got = F.col("new_minor").isNotNull()
    same = F.col("price_minor").eqNullSafe(F.col("new_minor"))
    times = [F.when(got & ~same, F.lit(now)).otherwise(F.col("verified_at")).alias("verified_at"), F.when(got, F.lit(now)).otherwise(F.col("checked_at")).alias("checked_at")]
    return both.select(*KEY, F.coalesce("new_minor", "price_minor").alias("price_minor"), F.when(got, F.col("new_source")).otherwise(F.col("source")).alias("source"), *times)


def refresh(state: Prices, asked: DataFrame, evidence: DataFrame, currencies: DataFrame, now: dt.datetime) -> tuple[DataFrame, Prices]:
    """(served, new state) for the ``asked`` markets (country, force).

    ``served`` has for each asked country: country, outcome, currency, updated_at, source, n_items. A snapshot younger than LASTS is served as it is (``cached``), unless one of the askers forces a refresh. A country without a currency among ``currencies`` (country, currency) gets an empty
    snapshot (``unsupported``). Else the valid ``evidence`` of the market is voted on and merged with what was stored before this refresh (``refreshed``); strong prices are stored. Where that yields nothing and the old snapshot has prices, that one is served and stays as old as it was (``stale``).
    Codes count in any case; a null or empty one is HOME. An asked country is served once, however often it is asked for.
    """
    code = F.upper(F.coalesce(F.nullif("country", F.lit("")), F.lit(HOME)))
    once = asked.groupBy(code.alias("country")).agg(F.max(F.coalesce("force", F.lit(False))).alias("force"))
    old = state.cache.select("country", "fetched_at")
    told = once.join(currencies.select("country", F.col("currency").alias("own")), "country", "left").join(old, "country", "left")
    young = ~F.col("force") & F.coalesce(F.col("fetched_at") > F.lit(now - LASTS), F.lit(False))
    told = _once(told.select("country", "own", F.when(young, "cached").when(F.col("own").isNull(), "unsupported").otherwise("refreshed").alias("way")))
    open_ones = told.where("way = 'refreshed'").select("country", F.col("own").alias("currency"))

    # Votes, merged prices and outcomes are each read several times below. Countries are few, so that tables of prices aren't shuffled by them.
    fresh = _once(resolve(valid(evidence, open_ones)))
    before = state.stored.join(F.broadcast(open_ones), ["country", "currency"], "left_semi")
    items = _once(merged(fresh, before, now))
    found = items.groupBy("country").agg(F.count("*").alias("n_found"), F.max("updated_at").alias("newest"))
    sources = items.groupBy("country", "source").agg(F.min("place").alias("place")).groupBy("country").agg(F.array_sort(F.collect_list(F.struct("place", "source"))).alias("named"))
    held = state.items.groupBy("country").agg(F.count("*").alias("n_held"))
    told = told.join(found, "country", "left").join(sources, "country", "left").join(held, "country", "left")
    stale = (F.col("way") == "refreshed") & F.col("n_found").isNull() & F.col("n_held").isNotNull()
    told = _once(told.withColumn("outcome", F.when(stale, "stale").otherwise(F.col("way"))))

    new = F.col("outcome").isin("refreshed", "unsupported")
    named = F.array_join(F.transform("named", lambda x: x["source"]), ",")
    source = F.when(F.col("outcome") == "unsupported", NO_CURRENCY).when(F.col("n_found").isNull(), NOTHING_FOUND).otherwise(named)
    made = told.where(new).select("country", F.coalesce("own", F.lit("")).alias("currency"), F.lit(now).alias("fetched_at"), F.coalesce("newest", F.lit(now)).alias("updated_at"), source.alias("source"))
    cache = state.cache.join(made.select("country"), "country", "left_anti").unionByName(made)
    kept = state.items.join(F.broadcast(made.select("country")), "country", "left_anti")
    after = Prices(stored_after(state.stored, fresh, now), cache, kept.unionByName(items.drop("place")))
    n_items = F.when(new, F.coalesce("n_found", F.lit(0))).otherwise(F.coalesce("n_held", F.lit(0)))
    served = told.select("country", "outcome", n_items.alias("n_items")).join(cache, "country").select("country", "outcome", "currency", "updated_at", "source", "n_items")
    return served, after


def snapshot_items(state: Prices, served: DataFrame) -> DataFrame:
    """The prices of the served snapshots."""
    return state.items.join(served.select("country"), "country", "left_semi").select(*KEY, "price_minor", "source", "updated_at")
