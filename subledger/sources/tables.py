"""Domain tables as projections of the driver's tables. Each is one scan or a scan with broadcast dimensions, and lazily read."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subledger.operators import lifecycle

#: Dates that stand for today.
EVENTS_AS_OF = dt.date(2024, 1, 31)
ORDERS_AS_OF = dt.date(1998, 7, 1)
#: Source kinds of price evidence and their priorities.
KINDS = ("structured", "registry", "api", "help", "store", "page")
PRIORITIES = {"structured": 110, "registry": 100, "api": 90, "help": 80, "store": 75, "page": 70}
TIMEZONES = ("Europe/Oslo", "America/New_York", "Asia/Tokyo", "", "UTC")
#: Country and currency of the markets that have price evidence.
MARKETS = (("NO", "NOK"), ("SE", "SEK"), ("DE", "EUR"))
CURRENCIES = ("USD", "EUR", "NOK", "GBP", "SEK")


class Tables:
    """The domain tables of one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def history(self) -> DataFrame:
        status = F.when(F.col("event_type") == "error", "PAUSED").when(F.col("event_type") == "click", "CANCELLED").otherwise("ACTIVE")
        return self.raw("events").where("event_type <> 'view'").select(
            F.col("event_id").alias("id"), F.col("user_id").alias("subscription_id"), status.alias("new_status"),
            F.col("ts").cast("date").alias("effective_date"), F.col("ts").alias("recorded_at"),
        )

    def history_prices(self) -> DataFrame:
        """(subscription_id, price_minor) for the history's subscriptions; every 17th has no price."""
        price = F.when(F.col("user_id") % 17 != 0, 500 + F.col("user_id") % 40 * 50)
        return self.raw("events").select(F.col("user_id").alias("subscription_id"), price.alias("price_minor")).distinct()

    def users(self) -> DataFrame:
        nation = self.raw("nation").select("n_nationkey", F.col("n_name").alias("country"), (F.col("n_regionkey") % 5).alias("region"))
        pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), by.cast("int") + 1)
        return self.raw("customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("user_id"), F.lower(F.concat("c_name", F.lit("@example.org"))).alias("email"), "country",
            pick(CURRENCIES, F.col("region")).alias("currency"), pick(TIMEZONES, F.col("c_custkey") % 5).alias("timezone"),
        )

    def subscriptions(self) -> DataFrame:
        key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
        status = F.when(F.col("o_orderstatus") == "F", "CANCELLED").when(F.col("o_orderstatus") == "P", "PAUSED").otherwise("ACTIVE")
        return self.raw("orders").select(
            key.alias("id"), F.col("o_custkey").alias("user_id"), status.alias("status"), day.alias("renewal_date"),
            F.when(status != "ACTIVE", F.date_add(day, (key % 41).cast("int") - 20)).alias("status_effective_date"),
            F.when(key % 11 != 0, F.floor("o_totalprice").cast("bigint")).alias("price_minor"),
            F.when(key % 7 != 0, F.concat(F.lit("Plan "), (key % 3).cast("string"))).alias("plan_name"),
            (key % 150 + 1).alias("service_id"), (key % 5).cast("int").alias("provider_id"),
        )

    def services(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("service_id"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("service_name"), F.col("p_brand").alias("category"), F.floor(F.col("p_retailprice") * 100).cast("bigint").alias("catalog_minor"))

    def providers(self) -> DataFrame:
        return self.raw("region").select(F.col("r_regionkey").alias("provider_id"), F.lower("r_name").alias("provider_slug"))

    def savings_events(self) -> DataFrame:
        day = F.col("ts").cast("date")
        return self.raw("events").where("event_type in ('purchase', 'click')").select(
            F.col("event_id").alias("id"), "user_id", F.col("user_id").alias("subscription_id"), F.when(F.col("event_id") % 13 != 0, F.expr("event_id div 2")).alias("action_id"),
            F.floor(F.col("value") * 100).cast("bigint").alias("amount_minor"), F.element_at(F.array(F.lit("NOK"), F.lit("EUR"), F.lit("USD")), (F.col("user_id") % 3).cast("int") + 1).alias("currency"),
            F.when(F.col("event_type") == "purchase", "VERIFIED").otherwise("ESTIMATED").alias("kind"), day.alias("period_start"),
            F.date_sub(F.add_months(day, 1), 1).alias("period_end"), F.col("ts").alias("created_at"),
        )

    def candidates(self) -> DataFrame:
        """Price evidence of three markets; some of it in a foreign currency, some only a range."""
        kind = F.element_at(F.array(*map(F.lit, KINDS)), ((F.col("l_suppkey") + F.col("l_linenumber")) % 6).cast("int") + 1)
        priority = F.element_at(F.create_map(*(F.lit(x) for kv in PRIORITIES.items() for x in kv)), F.col("kind"))
        market = ((F.col("l_suppkey") + F.col("l_partkey")) % 3).cast("int") + 1
        own = F.element_at(F.array(*(F.lit(c) for _, c in MARKETS)), market)
        return self.raw("lineitem").select(
            F.col("l_partkey").alias("service"), F.col("l_returnflag").alias("plan"), F.col("l_linestatus").alias("route"), F.element_at(F.array(*(F.lit(c) for c, _ in MARKETS)), market).alias("country"),
            F.when(F.col("l_orderkey") % 13 == 0, "USD").otherwise(own).alias("currency"), (F.col("l_quantity").cast("int") % 4).cast("bigint").alias("price_minor"),
            F.when(F.col("l_orderkey") % 11 == 0, "range").otherwise("exact").alias("price_type"),
            kind.alias("kind"), F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").cast("date").alias("seen_at"),
        ).withColumn("priority", priority)

    def markets(self) -> DataFrame:
        return self.spark.createDataFrame(list(MARKETS), "country string, currency string")

    def preferences(self) -> DataFrame:
        """Some users have no row, which means that all is on."""
        key = F.col("c_custkey")
        return self.raw("customer").where("c_custkey % 4 <> 0").select(key.alias("user_id"), (key % 6 != 1).alias("renewal_reminders"), F.when(key % 10 != 3, key % 9 != 2).alias("email_enabled"))

    def endpoints(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").where("c_custkey % 3 <> 0").select(key.alias("user_id"), F.concat(F.lit("ExpoPushToken["), key.cast("string"), F.lit("]")).alias("destination"), (key % 7 != 0).alias("enabled"))

    def actions(self) -> DataFrame:
        """Actions with their stored status; two in eleven are finished."""
        key = F.col("o_orderkey")
        pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (key % len(values)).cast("int") + 1)
        requests = self.raw("orders").select(
            key.alias("id"), key.alias("subscription_id"), F.col("o_custkey").alias("user_id"), pick("PAUSE", "CANCEL", "REACTIVATE").alias("action"),
            pick("DIRECT", "PROVIDER_REDIRECT", "GUIDED", "UNSUPPORTED").alias("execution"), (key % 5 == 0).alias("requires_confirmation"),
            F.when(key % 2 == 0, F.concat(F.lit("https://example.org/"), key.cast("string"))).alias("redirect_url"), F.col("o_orderdate").alias("requested_at"),
        )
        done = F.when(F.col("id") % 11 == 3, "COMPLETED").when(F.col("id") % 11 == 7, "CANCELLED")
        return lifecycle.create_actions(requests).withColumn("status", F.coalesce(done, F.col("status")))

    def action_events(self) -> DataFrame:
        """Confirmations and provider results, several for each action and many of them late, repeated or another user's: the lines of an order are the events of its action."""
        line = self.raw("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_quantity")
        owners = self.raw("orders").select("o_orderkey", "o_custkey")
        odd = (F.col("l_orderkey") + F.col("l_linenumber")) % 3 == 0
        result = F.when(F.col("l_linenumber") == 4, "UNCHANGED").when(F.col("l_returnflag") == "A", "PAUSED").when(F.col("l_returnflag") == "R", "CANCELLED").when(F.col("l_linenumber") == 5, "LATER").otherwise("ACTIVE")
        return line.join(owners, line["l_orderkey"] == owners["o_orderkey"]).select(
            (((F.col("l_orderkey") * 20_000 + F.unix_date(F.col("l_shipdate").cast("date"))) * 8 + F.col("l_linenumber")) * 64 + F.col("l_quantity").cast("long")).alias("event_id"), F.col("l_shipdate").cast("date").alias("at"), F.col("l_orderkey").alias("action_id"), F.when(F.col("l_quantity") > 45, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("user_id"),
            F.when(odd, "CONFIRM").otherwise("RESULT").alias("kind"), F.when(~odd, result).alias("result"), F.when(~odd & (F.col("l_linenumber") != 2), F.date_add(F.col("l_shipdate").cast("date"), 10)).alias("on_date"),
        )
