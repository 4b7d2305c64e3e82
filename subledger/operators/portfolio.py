"""A user's portfolio: totals, rankings, plans and what needs attention."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subledger.functions.text import slugify

from subledger.operators.lifecycle import country_or_currencys, effective_status


def with_effective(subscriptions: DataFrame, as_of: dt.date) -> DataFrame:
    return subscriptions.withColumn("effective", effective_status(F.col("status"), F.col("status_effective_date"), as_of))


def monthly_spend(subscriptions: DataFrame, as_of: dt.date) -> DataFrame:
    """Per user: active subscriptions, what they cost a month (no price is 0), in three months and a year."""
    active = F.col("effective") == "ACTIVE"
    cost = F.sum(F.when(active, F.coalesce("price_minor", F.lit(0))).otherwise(0)).cast("bigint")
    sums = with_effective(subscriptions, as_of).groupBy("user_id").agg(F.count_if(active).alias("n_active"), cost.alias("monthly_minor"))
    return sums.withColumns({"quarter_minor": F.col("monthly_minor") * 3, "annual_minor": F.col("monthly_minor") * 12})


def strict_total(subscriptions: DataFrame) -> DataFrame:
    """Per user: the summed price of active subscriptions; null if any has no price, 0 if there are none."""
    active = F.col("status") == "ACTIVE"
    total = F.when(F.count_if(active) == 0, 0).when(F.count_if(active) == F.count(F.when(active, F.col("price_minor"))), F.sum(F.when(active, F.col("price_minor"))))
    return subscriptions.groupBy("user_id").agg(total.cast("bigint").alias("total_minor"))


def saving_now(subscriptions: DataFrame, as_of: dt.date) -> DataFrame:
    """Per user: what subscriptions that are stopped by now would cost a month and a year."""
    stopped = with_effective(subscriptions, as_of).where("effective in ('PAUSED', 'CANCELLED')")
    sums = stopped.groupBy("user_id").agg(F.count("*").alias("n_stopped"), F.coalesce(F.sum("price_minor"), F.lit(0)).cast("bigint").alias("saving_minor"))
    return sums.withColumn("yearly_minor", F.col("saving_minor") * 12)


def currency_guard(events: DataFrame, home: DataFrame) -> DataFrame:
    """Per user of ``home`` (user_id, currency): the one currency of their events; 'Mixed' for several, their own for none."""
    used = events.groupBy("user_id").agg(F.count_distinct("currency").alias("n"), F.min("currency").alias("one"))
    return home.join(used, "user_id", "left").select("user_id", F.when(F.coalesce("n", F.lit(0)) == 0, F.col("currency")).when(F.col("n") == 1, F.col("one")).otherwise("Mixed").alias("currency"))


def cost_rank(subscriptions: DataFrame, as_of: dt.date) -> DataFrame:
    """Active subscriptions with a price, the dearest of a user first."""
    order = Window.partitionBy("user_id").orderBy(F.desc("price_minor"), "id")
    return with_effective(subscriptions, as_of).where("effective = 'ACTIVE' and price_minor > 0").select("user_id", "id", "price_minor", F.row_number().over(order).alias("rank"))


def top_recommendations(subscriptions: DataFrame, as_of: dt.date, most: int = 2) -> DataFrame:
    return cost_rank(subscriptions, as_of).where(F.col("rank") <= most)


def keep_pause_leave(subscriptions: DataFrame, services: DataFrame) -> DataFrame:
    """Per user: the two cheapest active ones by catalogue price to keep, the dearest to pause, the first inactive one to leave off."""
    priced = subscriptions.join(services.select("service_id", "catalog_minor"), "service_id")
    cheap = Window.partitionBy("user_id", "active").orderBy("catalog_minor", "id")
    dear = Window.partitionBy("user_id", "active").orderBy(F.desc("catalog_minor"), "id")
    first = Window.partitionBy("user_id", "active").orderBy("id")
    ranked = priced.withColumn("active", F.col("status") == "ACTIVE").select("user_id", "id", "active", F.row_number().over(cheap).alias("cheap"), F.row_number().over(dear).alias("dear"), F.row_number().over(first).alias("first"))
    pick = lambda when: F.max(F.when(when, F.col("id")))
    on = F.col("active")
    return ranked.groupBy("user_id").agg(pick(on & (F.col("cheap") == 1)).alias("keep_1"), pick(on & (F.col("cheap") == 2)).alias("keep_2"), pick(on & (F.col("dear") == 1)).alias("pause"), pick(~on & (F.col("first") == 1)).alias("leave_off"))


def next_renewal(subscriptions: DataFrame, as_of: dt.date) -> DataFrame:
    """Per user: the active subscription that renews next, from today on."""
    ahead = with_effective(subscriptions, as_of).where((F.col("effective") == "ACTIVE") & (F.col("renewal_date") >= F.lit(as_of)))
    first = ahead.groupBy("user_id").agg(F.min(F.struct("renewal_date", "id")).alias("next"), F.count("*").alias("n_upcoming"))
    return first.select("user_id", F.col("next.id").alias("id"), F.col("next.renewal_date").alias("renewal_date"), "n_upcoming")


def issues(as_of: dt.date) -> Column:
    """What a subscription with ``effective`` lacks or has out of date."""
    active = F.col("effective") == "ACTIVE"
    return F.array_compact(F.array(
        F.when(F.col("renewal_date").isNull(), "renewal date"), F.when(active & (F.col("renewal_date") < F.lit(as_of)), "updated renewal date"),
        F.when(F.col("provider_id").isNull(), "billing route"), F.when(F.col("price_minor").isNull(), "price"), F.when(F.col("plan_name").isNull(), "plan"),
    ))


def data_health(subscriptions: DataFrame, as_of: dt.date) -> DataFrame:
    """Subscriptions with something missing or out of date, and what."""
    found = issues(as_of)
    return with_effective(subscriptions, as_of).select("id", "user_id", F.size(found).cast("bigint").alias("n_issues"), F.array_join(found, ", ").alias("issues")).where("n_issues > 0")


def attention_feed(subscriptions: DataFrame, as_of: dt.date) -> DataFrame:
    """Per user at most one row of each kind: first data issue, next renewal, first paused one, dearest one. One pass and one aggregation."""
    active, found = F.col("effective") == "ACTIVE", issues(as_of)
    first = lambda when, value: F.min(F.when(when, value))
    each = with_effective(subscriptions, as_of).groupBy("user_id").agg(
        first(F.size(found) > 0, F.col("id")).alias("issue"), first(active & (F.col("renewal_date") >= F.lit(as_of)), F.struct("renewal_date", "id"))["id"].alias("renewal"),
        first(F.col("effective") == "PAUSED", F.col("id")).alias("paused"), first(active & (F.col("price_minor") > 0), F.struct(-F.col("price_minor"), "id"))["id"].alias("recommendation"),
    )
    kinds = F.array(*(F.struct(F.col(k).alias("id"), F.lit(k).alias("kind")) for k in ("issue", "renewal", "paused", "recommendation")))
    return each.select("user_id", F.inline(kinds)).where("id is not null")


def price_fallback(wanted: DataFrame, prices: DataFrame, overrides: DataFrame | None = None, direct: str = "direct") -> DataFrame:
    """(id, price_minor) for each of ``wanted`` (id, service, plan, route, country, currency, own_minor, own_currency).

    A manual override (id, override_minor) comes first; then the price of its route, that of the ``direct`` route, and its own bill if that is in the market's currency. A plan's price is the named plan's, whose names count by their slugs, or the only one that the route has.
    """
    offers = prices.groupBy("service", "country", "currency").agg(F.collect_list(F.struct("route", "plan", "price_minor")).alias("offers"))
    rows = wanted.join(offers, ["service", "country", "currency"], "left")
    rows = rows.join(overrides, "id", "left") if overrides is not None else rows.withColumn("override_minor", F.lit(None).cast("bigint"))

    def by(route) -> list:
        here = F.filter("offers", lambda x: x["route"] == route)
        return [F.get(F.filter(here, lambda x: slugify(x["plan"]) == slugify(F.col("plan"))), 0)["price_minor"], F.when(F.size(here) == 1, F.get(here, 0)["price_minor"])]

    own = F.when(F.col("own_currency") == F.col("currency"), F.col("own_minor"))
    return rows.select("id", F.coalesce("override_minor", *by(F.col("route")), *by(F.lit(direct)), own).alias("price_minor"))


def in_market(subscriptions: DataFrame, country: str) -> DataFrame:
    """Subscriptions of a market; an old one without country belongs to that of its currency."""
    return subscriptions.where(country_or_currencys(F.col("country"), F.col("currency")) == country)


def comparison(subscriptions: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, dearer, difference_minor) of pairs of subscriptions with prices; at a tie neither is dearer."""
    price = lambda of: subscriptions.where("price_minor is not null").select(F.col("id").alias(of), F.col("price_minor").alias(f"{of}_minor"))
    more = F.col("a_minor") - F.col("b_minor")
    return pairs.join(price("a"), "a").join(price("b"), "b").select("a", "b", F.when(more > 0, F.col("a")).when(more < 0, F.col("b")).alias("dearer"), F.abs(more).alias("difference_minor"))


def html_escape(text) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def html_export(subscriptions: DataFrame, saved: DataFrame) -> DataFrame:
    """(user_id, html): a card for each subscription (id, user_id, service_name, status, price_minor), in order of name, and the totals; missing prices show a dash and count 0."""
    rows = subscriptions.join(saved.select(F.col("subscription_id").alias("id"), "saved_minor"), "id", "left")
    price = F.when(F.col("price_minor").isNull(), "-").otherwise(F.format_string("%.2f", F.col("price_minor") / 100))
    card = F.concat(F.lit("<div><h2>"), html_escape(F.coalesce("service_name", F.lit(""))), F.lit("</h2><p>"), html_escape(F.col("status")), F.lit("</p><p>"), price, F.lit("</p></div>"))
    each = rows.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("service_name", F.lit("")).alias("name"), "id", card.alias("card")))).alias("cards"), F.coalesce(F.sum("saved_minor"), F.lit(0)).cast("bigint").alias("saved_minor"))
    body = F.array_join(F.transform("cards", lambda x: x["card"]), "")
    return each.select("user_id", F.concat(F.lit("<main>"), body, F.lit("<p>Total saved: "), F.format_string("%.2f", F.col("saved_minor") / 100), F.lit("</p></main>")).alias("html"))


def goal_plan(subscriptions: DataFrame, protected: DataFrame, goal_minor: int, as_of: dt.date) -> DataFrame:
    """Per user the dearest unprotected subscriptions, as many as it takes to save ``goal_minor`` a month."""
    free = cost_rank(subscriptions, as_of).join(protected, "id", "left_anti")
    before = Window.partitionBy("user_id").orderBy(F.desc("price_minor"), "id").rowsBetween(Window.unboundedPreceding, -1)
    running = free.withColumn("before_minor", F.coalesce(F.sum("price_minor").over(before), F.lit(0)).cast("bigint"))
    return running.where(F.col("before_minor") < goal_minor).select("user_id", "id", "price_minor", "before_minor")


def scenario(spend: DataFrame, subscriptions: DataFrame, months: int) -> DataFrame:
    """What leaving off each active, priced subscription saves in ``months`` and leaves to pay a month."""
    rows = subscriptions.where("status = 'ACTIVE' and price_minor > 0").join(spend.select("user_id", "monthly_minor"), "user_id")
    return rows.select("id", "user_id", (F.col("price_minor") * months).alias("saved_minor"), F.greatest(F.lit(0), F.col("monthly_minor") - F.col("price_minor")).alias("left_minor"))
