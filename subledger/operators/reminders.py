"""Renewal reminders: when they are due, which are queued, purged and sent."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reminders go out so many days before, at this hour of the user's day, for renewals in so many days at most.
LEAD_DAYS, HOUR, HORIZON_DAYS = 3, 9, 30


def reminder_instant(renewal: Column, timezone: Column) -> Column:
    """UTC time, without zone, of HOUR o'clock, LEAD_DAYS before the renewal, in the zone; a blank zone is UTC. It doesn't depend on the session's zone."""
    zone = F.coalesce(F.nullif(F.btrim(timezone), F.lit("")), F.lit("UTC"))
    day = F.date_sub(renewal, LEAD_DAYS)
    local = F.make_timestamp_ntz(F.year(day), F.month(day), F.dayofmonth(day), F.lit(HOUR), F.lit(0), F.lit(0))
    return F.convert_timezone(zone, F.lit("UTC"), local)


def eligible(status: Column, effective: Column, renewal: Column) -> Column:
    """Three-valued: null where a stop has no date."""
    return (status == "ACTIVE") | (status.isin("PAUSED", "CANCELLED") & (effective > renewal))


def due_renewals(subscriptions: DataFrame, users: DataFrame, preferences: DataFrame, as_of: dt.date) -> DataFrame:
    """Eligible renewals from today on and before the horizon, of users who want reminders; a missing preference is on."""
    within = (F.col("renewal_date") >= F.lit(as_of)) & (F.col("renewal_date") < F.date_add(F.lit(as_of), HORIZON_DAYS))
    open_ones = subscriptions.where(within & eligible(F.col("status"), F.col("status_effective_date"), F.col("renewal_date")))
    wanted = open_ones.join(users, "user_id").join(preferences, "user_id", "left").where(F.coalesce("renewal_reminders", F.lit(True)))
    return wanted.withColumn("scheduled_for", reminder_instant(F.col("renewal_date"), F.col("timezone")))


def queue_push(due: DataFrame, endpoints: DataFrame) -> DataFrame:
    """One job for each due renewal and enabled endpoint."""
    payload = F.to_json(F.struct(F.date_format("renewal_date", "MMM dd").alias("renewal"), F.col("price_minor").alias("price")), {"ignoreNullFields": "false"})
    return due.join(endpoints.where("enabled").select("user_id", "destination"), "user_id").select(F.col("id").alias("subscription_id"), "user_id", "destination", "scheduled_for", payload.alias("payload"))


def queue_email(due: DataFrame) -> DataFrame:
    return due.where(F.coalesce("email_enabled", F.lit(True))).select(F.col("id").alias("subscription_id"), "user_id", F.col("email").alias("destination"), "scheduled_for")


def purge(jobs: DataFrame, subscriptions: DataFrame, users: DataFrame, preferences: DataFrame) -> DataFrame:
    """Unsent ``jobs`` that stay: their subscription is not known to be ineligible, reminders are on, and the time is still right; an unknown time stays."""
    state = jobs.join(subscriptions.select(F.col("id").alias("subscription_id"), "status", "status_effective_date", "renewal_date"), "subscription_id").join(users.select("user_id", "timezone"), "user_id").join(preferences, "user_id", "left")
    out = F.coalesce(~eligible(F.col("status"), F.col("status_effective_date"), F.col("renewal_date")), F.lit(False))
    off = ~F.coalesce("renewal_reminders", F.lit(True))
    moved = F.coalesce(F.col("scheduled_for") != reminder_instant(F.col("renewal_date"), F.col("timezone")), F.lit(False))
    return state.where(~(out | off | moved)).select(*jobs.columns)


#: What a job is unique by.
JOB_KEY = ["subscription_id", "kind", "channel", "destination", "scheduled_for"]


def queue(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """The jobs that ``new`` adds: one for each key that no job has yet, sent and failed ones included."""
    return new.dropDuplicates(JOB_KEY).join(jobs.select(*JOB_KEY), JOB_KEY, "left_anti")


def due_jobs(jobs: DataFrame, subscriptions: DataFrame, users: DataFrame, preferences: DataFrame, endpoints: DataFrame, now: dt.datetime, most: int = 100) -> DataFrame:
    """The oldest due jobs that are neither sent nor failed, ``most`` at a time, and that are still wanted.

    The subscription still renews, reminders are on, and the channel is: e-mail by preference, push by an enabled endpoint with the job's own destination.
    """
    open_ones = jobs.where(F.col("sent_at").isNull() & F.col("failed_at").isNull() & (F.col("scheduled_for") <= F.lit(now)))
    state = open_ones.join(subscriptions.select(F.col("id").alias("subscription_id"), "status", "status_effective_date", "renewal_date"), "subscription_id").join(users.select("user_id"), "user_id")
    reach = endpoints.where("enabled").select("user_id", "destination", F.lit(True).alias("reachable")).distinct()
    state = state.join(preferences, "user_id", "left").join(reach, ["user_id", "destination"], "left")
    wanted = eligible(F.col("status"), F.col("status_effective_date"), F.col("renewal_date")) & F.col("renewal_date").isNotNull() & F.coalesce("renewal_reminders", F.lit(True))
    channel = ((F.col("channel") == "EMAIL") & F.coalesce("email_enabled", F.lit(True))) | ((F.col("channel") == "PUSH") & F.coalesce("reachable", F.lit(False)))
    return state.where(wanted & channel).select(*jobs.columns).orderBy("scheduled_for", "subscription_id", "destination").limit(most)


def dispatched(jobs: DataFrame, results: DataFrame, now: dt.datetime, retryable: tuple[str, ...] = ()) -> DataFrame:
    """Jobs after sending: ``results`` (id, error; null for success). A retryable error is only noted, so that the job stays due; any other fails the job."""
    both = jobs.join(results.select("id", "error", F.lit(True).alias("tried")), "id", "left")
    tried, failed = F.coalesce("tried", F.lit(False)), F.col("error").isNotNull()
    retry = F.col("error").isin(*retryable) if retryable else F.lit(False)
    changed = {
        "sent_at": F.when(tried & ~failed, F.lit(now)).otherwise(F.col("sent_at")), "failed_at": F.when(tried & failed & ~retry, F.lit(now)).otherwise(F.col("failed_at")),
        "last_error": F.when(tried & failed, F.col("error")).otherwise(F.col("last_error")),
    }
    return both.select(*(changed.get(c, F.col(c)).alias(c) for c in jobs.columns))


def dispatch_counts(due: DataFrame, results: DataFrame) -> DataFrame:
    """(queued_or_due, sent)."""
    return due.join(results.select("id", "error", F.lit(True).alias("tried")), "id", "left").agg(F.count("*").alias("queued_or_due"), F.count_if(F.coalesce("tried", F.lit(False)) & F.col("error").isNull()).alias("sent"))


def simply_eligible(status: Column, renewal: Column, reminders_on: Column, channel: Column, email_on: Column, push_on: Column) -> Column:
    """The narrower rule by channel: active ones only; e-mail unless it is off, push only if it is on."""
    by_channel = F.when(channel == "EMAIL", F.coalesce(email_on, F.lit(True))).otherwise(F.coalesce(push_on, F.lit(False)))
    return F.coalesce(status == "ACTIVE", F.lit(False)) & renewal.isNotNull() & F.coalesce(reminders_on, F.lit(False)) & by_channel


# Fixed value: the form of a push token.
PUSH_TOKEN = r"^Expo(nent)?PushToken\[.+\]$"


def set_endpoints(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(endpoints, rejected): a registered token is enabled, again if it was off; one of the wrong form is rejected. Key: user and destination."""
    good = new.where(F.col("destination").rlike(PUSH_TOKEN)).select("user_id", "destination", F.lit(True).alias("enabled")).distinct()
    kept = old.join(good, ["user_id", "destination"], "left_anti").select("user_id", "destination", "enabled")
    return kept.unionByName(good), new.where(~F.coalesce(F.col("destination").rlike(PUSH_TOKEN), F.lit(False))).select("user_id", "destination", F.lit("INVALID_PUSH_TOKEN").alias("error"))


def valid_times(rows: DataFrame, zones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) of (id, renewal, timezone): a date as ``yyyy-mm-dd`` that exists, and a zone of the catalogue; a blank zone is UTC."""
    zone = F.coalesce(F.nullif(F.btrim("timezone"), F.lit("")), F.lit("UTC"))
    named = rows.withColumn("zone", zone).join(F.broadcast(zones.select(F.col("zone"), F.lit(True).alias("known"))), "zone", "left")
    day = F.when(F.col("renewal").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.to_date(F.try_to_timestamp("renewal", F.lit("yyyy-MM-dd"))))
    error = F.when(day.isNull(), "INVALID_DATE").when(F.col("known").isNull(), "INVALID_TIMEZONE")
    judged = named.withColumns({"day": day, "error": error})
    return judged.where("error is null").select("id", F.col("day").alias("renewal"), F.col("zone").alias("timezone")), judged.where("error is not null").select("id", "error")


def set_timezone(users: DataFrame, change: DataFrame, zones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(users, rejected) after a change (user_id, new_zone); a zone that the catalogue lacks is rejected."""
    good = change.join(F.broadcast(zones.select(F.col("zone").alias("new_zone"))), "new_zone", "left_semi")
    rejected = change.join(F.broadcast(zones.select(F.col("zone").alias("new_zone"))), "new_zone", "left_anti").select("user_id", F.lit("INVALID_TIMEZONE").alias("error"))
    return users.join(good, "user_id", "left").withColumn("timezone", F.coalesce("new_zone", "timezone")).drop("new_zone"), rejected


def set_preferences(old: DataFrame, change: DataFrame) -> DataFrame:
    """Preferences after a partial ``change``: null keeps what was, a new row defaults to on."""
    both = old.alias("o").join(change.alias("c"), "user_id", "full")
    value = lambda name: F.coalesce(f"c.{name}", f"o.{name}", F.lit(True)).alias(name)
    return both.select("user_id", *(F.when(F.col(f"c.user_id").isNull(), F.col(f"o.{n}")).otherwise(value(n)).alias(n) for n in ("renewal_reminders", "email_enabled")))
