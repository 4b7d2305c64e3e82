"""Savings: time-prorated savings of paused subscriptions, the ledger and its verification."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Days of a mean month.
MONTH_DAYS = 30.436875


def saving_intervals(history: DataFrame, prices: DataFrame, as_of: dt.date) -> DataFrame:
    """One row for each pause or cancellation: its days up to the next activation strictly after it, or to ``as_of``, and what they saved.

    Each interval is rounded by itself. A pause followed by a cancellation without activation between counts twice. An interval in the future counts no days; no price saves nothing.
    """
    # From the last day backwards, so that the frame grows row by row.
    later = Window.partitionBy("subscription_id").orderBy(F.desc("effective_day")).rangeBetween(Window.unboundedPreceding, -1)
    ends = F.min(F.when(F.col("new_status") == "ACTIVE", F.col("effective_date"))).over(later)
    marked = history.withColumn("effective_day", F.unix_date("effective_date")).withColumn("until", ends).where("new_status in ('PAUSED', 'CANCELLED')")
    days = F.greatest(F.lit(0), F.datediff(F.coalesce("until", F.lit(as_of)), F.col("effective_date"))).cast("bigint")
    priced = marked.withColumn("days", days).join(prices, "subscription_id", "left")
    saved = F.coalesce(F.round(F.col("price_minor") * F.col("days") / F.lit(MONTH_DAYS)).cast("bigint"), F.lit(0).cast("bigint"))
    return priced.select("id", "subscription_id", "new_status", "effective_date", "until", "days", saved.alias("saved_minor"))


def saved_so_far(history: DataFrame, prices: DataFrame, as_of: dt.date) -> DataFrame:
    """(subscription_id, saved_minor) for every subscription with a history; 0 without inactive time."""
    sums = saving_intervals(history, prices, as_of).groupBy("subscription_id").agg(F.sum("saved_minor").alias("saved_minor"))
    every = history.select("subscription_id").distinct()
    return every.join(sums, "subscription_id", "left").select("subscription_id", F.coalesce("saved_minor", F.lit(0).cast("bigint")).alias("saved_minor"))


def savings_summary(events: DataFrame) -> DataFrame:
    """Per user and currency: verified and estimated totals, one event for each action, a verified one before an estimated one, then the newest."""
    group = F.coalesce(F.concat(F.lit("a"), F.col("action_id").cast("string")), F.concat(F.lit("e"), F.col("id").cast("string")))
    order = Window.partitionBy("user_id", "group").orderBy((F.col("kind") != "VERIFIED").asc(), F.desc("created_at"), F.desc("id"))
    one = events.withColumn("group", group).withColumn("n", F.row_number().over(order)).where("n = 1")
    total = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("amount_minor")).otherwise(0)).cast("bigint")
    return one.groupBy("user_id", "currency").agg(total("VERIFIED").alias("verified_minor"), total("ESTIMATED").alias("estimated_minor"), F.count("*").alias("n_actions"))


def savings_ledger(events: DataFrame, subscriptions: DataFrame, services: DataFrame) -> DataFrame:
    """Every event with its subscription's plan and service where they are known. Order is the caller's: a user's rows are sorted by O2's keys, not the whole table."""
    named = subscriptions.select(F.col("id").alias("subscription_id"), "service_id", "plan_name").join(services.select("service_id", "service_name"), "service_id", "left").drop("service_id")
    return events.join(named, "subscription_id", "left").select("id", "user_id", "kind", "amount_minor", "currency", "period_start", "period_end", "service_name", "plan_name")


def ledger_of(ledger: DataFrame, user_id: int) -> DataFrame:
    """One user's ledger, the newest period first and those without one last."""
    return ledger.where(F.col("user_id") == user_id).orderBy(F.desc_nulls_last("period_start"), F.desc("id"))


def estimates(actions: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """The estimated event of each completed pause or cancellation with a price above 0: one month from its effective date."""
    priced = subscriptions.where("price_minor > 0").select(F.col("id").alias("subscription_id"), "price_minor", "status_effective_date")
    done = actions.where("action in ('PAUSE', 'CANCEL')").join(priced, "subscription_id").where("status_effective_date is not null")
    return done.select(F.col("id").alias("action_id"), "user_id", "subscription_id", F.col("price_minor").alias("amount_minor"), F.col("status_effective_date").alias("period_start"), F.date_sub(F.add_months("status_effective_date", 1), 1).alias("period_end"))


def current_status(history: DataFrame) -> DataFrame:
    """(subscription_id, status, status_effective_date): the last recorded change of each subscription."""
    last = history.groupBy("subscription_id").agg(F.max(F.struct("recorded_at", "id", "new_status", "effective_date")).alias("last"))
    return last.select("subscription_id", F.col("last.new_status").alias("status"), F.col("last.effective_date").alias("status_effective_date"))


def verify_savings(events: DataFrame, current: DataFrame, as_of: dt.date) -> DataFrame:
    """New verified events: of estimates whose whole period is over and whose subscription, of the same user, has been inactive from its start on, one for each action that has none yet. ``current``: subscription_id, user_id, status, status_effective_date."""
    estimated = events.where((F.col("kind") == "ESTIMATED") & F.col("action_id").isNotNull() & (F.col("period_end") < F.lit(as_of)))
    open_ones = estimated.join(events.where("kind = 'VERIFIED'").select("action_id").dropna().distinct(), "action_id", "left_anti")
    due = open_ones.join(current.where("status in ('PAUSED', 'CANCELLED')"), ["subscription_id", "user_id"]).where("status_effective_date <= period_start")
    first = due.groupBy("action_id").agg(F.min(F.struct("id", "user_id", "subscription_id", "amount_minor", "currency", "period_start", "period_end")).alias("e"))
    return first.select("action_id", "e.user_id", "e.subscription_id", "e.amount_minor", "e.currency", F.lit("VERIFIED").alias("kind"), "e.period_start", "e.period_end")


def verified_count(events: DataFrame, current: DataFrame, as_of: dt.date) -> DataFrame:
    return verify_savings(events, current, as_of).agg(F.count("*").alias("verified"))


def total_saved(saved: DataFrame, owners: DataFrame) -> DataFrame:
    """Per user the sum of what their subscriptions saved so far; (subscription_id, user_id) are ``owners``, and one without savings counts 0."""
    each = owners.join(saved, "subscription_id", "left")
    return each.groupBy("user_id").agg(F.coalesce(F.sum("saved_minor"), F.lit(0)).cast("bigint").alias("saved_minor"))
