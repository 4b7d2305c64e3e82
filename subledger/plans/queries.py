"""The reference's operators as queries over one folder of tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subledger.functions import pages, questions, storefronts, text
from subledger.operators import lifecycle, portfolio, pricing, refresh, reminders, routing, savings
from subledger.sources.tables import EVENTS_AS_OF, MARKETS, ORDERS_AS_OF, Tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
    return f


def _pick(key, *values):
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values)).cast("int") + 1)


def _changes(t: Tables) -> DataFrame:
    return t.subscriptions().where("id % 4 <> 3").select("id", _pick(F.col("id"), "PAUSED", "CANCELLED", "ACTIVE").alias("new_status"), F.when(F.col("id") % 2 == 0, F.lit(dt.date(1998, 8, 15))).alias("on_date"))


def _entitlements(t: Tables) -> DataFrame:
    return t.users().where("user_id % 4 <> 0").select("user_id", _pick(F.col("user_id"), "VIEWER", "MANUAL", "PREMIUM").alias("plan"))


def _due(t: Tables) -> DataFrame:
    return reminders.due_renewals(t.subscriptions(), t.users(), t.preferences(), ORDERS_AS_OF)


def _valid(t: Tables) -> DataFrame:
    return pricing.valid(t.candidates(), t.markets())


def _stored(t: Tables) -> DataFrame:
    return _valid(t).where("service % 3 <> 0").groupBy(*pricing.KEY).agg(F.max("price_minor").alias("price_minor"), F.min("seen_at").alias("verified_on"), F.max("seen_at").alias("checked_on"))


def _current(t: Tables) -> DataFrame:
    """The history's subscriptions with their users; every seventh has another one than its savings say."""
    return savings.current_status(t.history()).withColumn("user_id", F.when(F.col("subscription_id") % 7 == 3, F.col("subscription_id") + 1).otherwise(F.col("subscription_id")))


def _questions(t: Tables) -> DataFrame:
    return t.raw("conversations").where("role = 'user'")


@query
def saved_so_far(t):
    return savings.saved_so_far(t.history(), t.history_prices(), EVENTS_AS_OF)


@query
def saved_so_far_intervals(t):
    return savings.saving_intervals(t.history(), t.history_prices(), EVENTS_AS_OF)


@query
def savings_summary(t):
    return savings.savings_summary(t.savings_events())


@query
def savings_ledger(t):
    return savings.savings_ledger(t.savings_events(), t.subscriptions(), t.services())


@query
def savings_estimate(t):
    return savings.estimates(t.actions(), t.subscriptions())


@query
def savings_verify(t):
    return savings.verify_savings(t.savings_events(), _current(t), dt.date(2024, 3, 5))


@query
def subscription_list(t):
    return lifecycle.subscription_list(t.subscriptions(), t.services(), t.providers())


@query
def subscription_dedupe(t):
    keys = ["user_id", "service_id", "provider_id"]
    return lifecycle.best_of_each(t.subscriptions(), keys).select(*keys, "id", "status", "plan_name", "price_minor", "score")


@query
def effective_status(t):
    return portfolio.with_effective(t.subscriptions(), ORDERS_AS_OF).select("id", "status", "status_effective_date", "effective")


@query
def will_renew(t):
    return t.subscriptions().select("id", lifecycle.renews(F.col("status"), F.col("status_effective_date"), F.col("renewal_date")).alias("renews"))


@query
def renewal_refresh(t):
    return portfolio.with_effective(t.subscriptions(), ORDERS_AS_OF).where((F.col("effective") == "ACTIVE") & (F.col("renewal_date") < F.lit(ORDERS_AS_OF))).select("id", "user_id", "renewal_date")


@query
def status_transition(t):
    return lifecycle.transition(t.subscriptions(), _changes(t), ORDERS_AS_OF)


@query
def status_history_append(t):
    return lifecycle.transition_history(t.subscriptions(), _changes(t), ORDERS_AS_OF)


@query
def action_status(t):
    return lifecycle.confirm(t.actions())


@query
def action_preview(t):
    return lifecycle.preview(t.actions(), _entitlements(t))


@query
def provider_result(t):
    results = t.actions().where("id % 3 <> 1").select("id", _pick(F.col("id"), "PAUSED", "CANCELLED", "ACTIVE", "UNCHANGED").alias("result"), F.col("requested_at").cast("date").alias("on_date"))
    theirs = t.actions().withColumn("user_id", F.when(F.col("id") % 23 == 5, F.col("user_id") + 1).otherwise(F.col("user_id")))
    booked = t.actions().where("id % 6 = 0").select(F.col("id").alias("action_id"), F.when(F.col("id") % 4 == 2, "VERIFIED").otherwise("ESTIMATED").alias("kind"))
    return lifecycle.provider_result(theirs, t.subscriptions(), results, booked)


def _log(t: Tables) -> DataFrame:
    return lifecycle.action_log(t.actions(), t.subscriptions(), t.action_events())


def _after_log(t: Tables):
    booked = t.actions().where("id % 6 = 0").select(F.col("id").alias("action_id"), F.when(F.col("id") % 4 == 2, "VERIFIED").otherwise("ESTIMATED").alias("kind"))
    return lifecycle.after_log(t.actions(), t.subscriptions(), _log(t), booked, ORDERS_AS_OF)


@query
def action_create(t):
    """New actions with the status that they are stored with."""
    return lifecycle.create_actions(t.actions().drop("status")).select("id", "execution", "requires_confirmation", "status")


@query
def action_log(t):
    """Every event with what it did; late and repeated ones do nothing."""
    return _log(t).select("event_id", "action_id", "accepted", "new_status", "sets_status", "sets_date")


@query
def action_log_actions(t):
    return _after_log(t)[0].select("id", "status")


@query
def action_log_subscriptions(t):
    return _after_log(t)[1].select("id", "status", "status_effective_date")


@query
def action_log_savings(t):
    return _after_log(t)[2]


@query
def recent_actions_top100(t):
    return t.actions().select("id", "user_id", "action", "requested_at").orderBy(F.desc("requested_at"), F.desc("id")).limit(100)


@query
def entitlement_upsert(t):
    return lifecycle.upsert(_entitlements(t), t.users().where("user_id % 5 = 0").select("user_id", F.lit("PREMIUM").alias("plan")), "user_id")


@query
def account_purge(t):
    asked = F.when(F.col("user_id") % 3 == 0, F.date_add(F.lit(dt.date(1998, 6, 15)), (F.col("user_id") % 30).cast("int")))
    return lifecycle.without_scheduled(t.users().withColumn("deletion_requested", asked), ORDERS_AS_OF).select("user_id", "email")


@query
def subscription_add(t):
    key = F.col("c_custkey")
    names = t.services().select(F.col("service_id").alias("k"), F.col("service_name").alias("name"))
    asked = t.raw("customer").join(F.broadcast(names.where("k <= 150")), key % 150 + 1 == F.col("k"), "left").select(
        key.alias("request_id"), F.when(key % 4 == 0, "no such service").otherwise(F.col("name")).alias("service_name"), F.when(key % 9 == 0, "nobody").otherwise("asia").alias("provider_slug"), F.when(key % 2 == 0, "NOK").alias("currency"),
    )
    return lifecycle.add_subscriptions(asked, t.services().select("service_id", "service_name"), t.providers())[0]


@query
def reminder_instant(t):
    return _due(t).select("id", "timezone", "renewal_date", F.col("scheduled_for").cast("timestamp_ntz"))


@query
def reminder_queue_push(t):
    return reminders.queue_push(_due(t), t.endpoints()).withColumn("scheduled_for", F.col("scheduled_for").cast("timestamp_ntz"))


@query
def reminder_queue_email(t):
    return reminders.queue_email(_due(t)).withColumn("scheduled_for", F.col("scheduled_for").cast("timestamp_ntz"))


@query
def reminder_purge(t):
    instant = reminders.reminder_instant(F.col("renewal_date"), F.col("timezone")) + F.when(F.col("id") % 5 == 0, F.expr("INTERVAL 1 DAY")).otherwise(F.expr("INTERVAL 0 DAY"))
    jobs = t.subscriptions().where("id % 3 = 0").join(t.users(), "user_id").select(F.col("id").alias("subscription_id"), "user_id", F.when(F.col("id") % 8 != 0, instant).alias("scheduled_for"))
    return reminders.purge(jobs, t.subscriptions(), t.users(), t.preferences()).withColumn("scheduled_for", F.col("scheduled_for").cast("timestamp_ntz"))


def _jobs(t: Tables) -> DataFrame:
    """Jobs of both channels, some sent, some failed, some with an endpoint that is off by now."""
    push = reminders.queue_push(_due(t), t.endpoints().withColumn("enabled", F.lit(True))).withColumn("channel", F.lit("PUSH")).drop("payload")
    both = push.unionByName(reminders.queue_email(_due(t)).withColumn("channel", F.lit("EMAIL")))
    id = F.col("subscription_id") * 2 + (F.col("channel") == "EMAIL").cast("bigint")
    at = lambda k: F.when(F.col("subscription_id") % 10 == k, F.lit(dt.datetime(1998, 7, 1)).cast("timestamp_ntz"))
    return both.select(id.alias("id"), "subscription_id", "user_id", F.lit("RENEWAL").alias("kind"), "channel", "destination", F.col("scheduled_for").cast("timestamp_ntz").alias("scheduled_for"), at(4).alias("sent_at"), at(7).alias("failed_at"), F.lit(None).cast("string").alias("last_error"))


@query
def reminder_due_top100(t):
    now = t.subscriptions().withColumn("status", F.when(F.col("id") % 9 == 0, "CANCELLED").otherwise(F.col("status")))
    return reminders.due_jobs(_jobs(t), now, t.users(), t.preferences(), t.endpoints(), dt.datetime(1998, 7, 20)).select("id", "subscription_id", "channel", "destination", "scheduled_for")


def _results(t: Tables) -> DataFrame:
    return _jobs(t).where("id % 3 <> 1").select("id", F.when(F.col("id") % 5 == 0, "RATE_LIMIT").when(F.col("id") % 7 == 0, "GONE").alias("error"))


@query
def reminder_dispatch(t):
    return reminders.dispatched(_jobs(t), _results(t), dt.datetime(1998, 7, 21), ("RATE_LIMIT",)).select("id", F.col("sent_at").cast("timestamp_ntz").alias("sent_at"), F.col("failed_at").cast("timestamp_ntz").alias("failed_at"), "last_error")


@query
def reminder_dispatch_counts(t):
    return reminders.dispatch_counts(_jobs(t), _results(t))


@query
def reminder_queue_once(t):
    jobs = _jobs(t)
    return reminders.queue(jobs.where("subscription_id % 4 = 1"), jobs.unionByName(jobs.where("id % 2 = 0"))).select("id", "destination", "scheduled_for")


@query
def reminder_simple_rule(t):
    rows = t.subscriptions().join(t.preferences(), "user_id", "left")
    rule = lambda channel: reminders.simply_eligible(F.col("status"), F.when(F.col("id") % 12 != 5, F.col("renewal_date")), F.col("renewal_reminders"), F.lit(channel), F.col("email_enabled"), F.col("user_id") % 2 == 0)
    return rows.select("id", rule("EMAIL").alias("email"), rule("PUSH").alias("push"))


def _tokens(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    return t.raw("customer").where("c_custkey % 2 = 0").select(key.alias("user_id"), F.concat(F.when(key % 5 == 0, "Token[").when(key % 4 == 0, "ExponentPushToken[").otherwise("ExpoPushToken["), key.cast("string"), F.lit("]")).alias("destination"))


@query
def endpoint_upsert(t):
    return reminders.set_endpoints(t.endpoints(), _tokens(t))[0]


@query
def endpoint_rejects(t):
    return reminders.set_endpoints(t.endpoints(), _tokens(t))[1]


def _zones(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("Europe/Oslo",), ("America/New_York",), ("Asia/Tokyo",), ("UTC",)], "zone string")


@query
def timezone_update(t):
    change = t.users().where("user_id % 3 = 0").select("user_id", _pick(F.col("user_id"), "Asia/Tokyo", "Mars/Base", "UTC", "europe/oslo").alias("new_zone"))
    return reminders.set_timezone(t.users(), change, _zones(t))[0].select("user_id", "timezone")


@query
def reminder_validation(t):
    text = F.when(F.col("id") % 8 == 0, F.date_format("renewal_date", "yyyy/MM/dd")).when(F.col("id") % 8 == 1, F.concat(F.date_format("renewal_date", "yyyy-MM"), F.lit("-31"))).otherwise(F.date_format("renewal_date", "yyyy-MM-dd"))
    rows = t.subscriptions().join(t.users().select("user_id", F.when(F.col("user_id") % 9 == 4, "Mars/Base").otherwise(F.col("timezone")).alias("timezone")), "user_id").select("id", text.alias("renewal"), "timezone")
    good, bad = reminders.valid_times(rows, _zones(t))
    return good.select("id", F.concat_ws(" ", F.date_format("renewal", "yyyy-MM-dd"), "timezone").alias("verdict")).unionByName(bad.select("id", F.col("error").alias("verdict")))


@query
def preference_upsert(t):
    change = t.users().where("user_id % 5 < 3").select("user_id", F.when(F.col("user_id") % 2 == 0, F.col("user_id") % 3 == 0).alias("renewal_reminders"), F.when(F.col("user_id") % 3 == 0, F.lit(False)).alias("email_enabled"))
    return reminders.set_preferences(t.preferences(), change)


@query
def price_resolve(t):
    return pricing.resolve(_valid(t))


@query
def price_conflicts(t):
    return pricing.conflicts(_valid(t))


@query
def price_merge(t):
    return pricing.merge(pricing.resolve(_valid(t)), _stored(t))


@query
def price_upsert(t):
    return pricing.store(_stored(t), pricing.resolve(_valid(t)), dt.date(1999, 1, 1))


@query
def price_snapshot(t):
    return pricing.snapshot(t.candidates(), ["service", "country"])


@query
def price_cross_check(t):
    c = t.candidates()
    return pricing.cross_check(c.where("kind in ('structured', 'page')").select(*pricing.KEY, "price_minor").distinct(), c.where("kind = 'help'"))


@query
def price_unanimous(t):
    return pricing.unanimous(t.candidates().where("kind in ('help', 'store')"), ["service", "plan"])


@query
def price_complete_set(t):
    return pricing.complete_sets(t.candidates().where("kind = 'structured'"), ["A", "N", "R"])


@query
def price_unambiguous(t):
    return pricing.unambiguous(t.candidates().where("kind = 'page'"))


@query
def registry_quality(t):
    url = F.concat(F.when(F.col("ord") % 17 == 0, "http").otherwise("https"), F.lit("://example.org/"), F.col("service").cast("string"))
    odd = F.when(F.col("ord") % 19 == 0, F.lower("country")).otherwise(F.col("country"))
    return pricing.registry_quality(t.candidates().withColumns({"source_url": url, "country": odd}), t.markets())


@query
def monthly_spend(t):
    return portfolio.monthly_spend(t.subscriptions(), ORDERS_AS_OF)


@query
def catalog_total_null_strict(t):
    return portfolio.strict_total(t.subscriptions())


@query
def saving_now(t):
    return portfolio.saving_now(t.subscriptions(), ORDERS_AS_OF)


@query
def currency_guard(t):
    e = t.savings_events()
    both = e.select("user_id", "currency").unionByName(e.where("id % 50 = 0").select((F.col("subscription_id") + 1).alias("user_id"), "currency"))
    return portfolio.currency_guard(both, t.users())


@query
def cost_rank(t):
    return portfolio.cost_rank(t.subscriptions(), ORDERS_AS_OF)


@query
def top2_recommendations(t):
    return portfolio.top_recommendations(t.subscriptions(), ORDERS_AS_OF)


@query
def keep_pause_leave(t):
    return portfolio.keep_pause_leave(t.subscriptions(), t.services())


@query
def next_renewal(t):
    return portfolio.next_renewal(t.subscriptions(), ORDERS_AS_OF)


@query
def data_health(t):
    return portfolio.data_health(t.subscriptions(), ORDERS_AS_OF)


@query
def attention_feed(t):
    return portfolio.attention_feed(t.subscriptions(), ORDERS_AS_OF)


@query
def catalog_price_fallback(t):
    key = F.col("id")
    plan = F.when(key % 4 == 0, "A").when(key % 4 == 1, "N").when(key % 4 == 2, "R")
    country, currency = _pick(key, *(c for c, _ in MARKETS)), _pick(key, *(c for _, c in MARKETS))
    wanted = t.subscriptions().select("id", F.col("service_id").alias("service"), plan.alias("plan"), _pick(key, "F", "O").alias("route"), country.alias("country"), currency.alias("currency"), F.col("price_minor").alias("own_minor"), _pick(key, "NOK", "EUR").alias("own_currency"))
    overrides = t.subscriptions().where("id % 29 = 0").select("id", F.lit(777).cast("bigint").alias("override_minor"))
    return portfolio.price_fallback(wanted.withColumn("plan", F.lower("plan")), pricing.resolve(_valid(t)), overrides, direct="O")


@query
def goal_plan(t):
    return portfolio.goal_plan(t.subscriptions(), t.subscriptions().where("id % 5 = 2").select("id"), 300_000, ORDERS_AS_OF)


@query
def scenario(t):
    return portfolio.scenario(portfolio.monthly_spend(t.subscriptions(), ORDERS_AS_OF), t.subscriptions(), 3)


@query
def html_to_text(t):
    return t.raw("pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query
def parse_number(t):
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").cast("double").cast("string")
    some = (key % 900 + 100).cast("string")
    raw = F.when(key % 6 == 0, F.concat(F.lit("kr "), price)).when(key % 6 == 1, F.replace(price, F.lit("."), F.lit(","))).when(key % 6 == 2, F.concat(F.lit("1."), some, F.lit(",5")))
    raw = raw.when(key % 6 == 3, F.concat(F.lit("1,"), some, F.lit(".25 EUR"))).when(key % 6 == 4, F.concat(F.lit("2,"), some)).otherwise("from -")
    return t.raw("orders").select(key.alias("k"), text.parse_number(raw).alias("amount"))


@query
def slugify(t):
    name = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, "+ (HD)").otherwise(""))
    return t.raw("part").select("p_partkey", text.slugify(name).alias("slug"))


@query
def normalize_text(t):
    return t.raw("documents").select("doc_id", text.normalise(F.col("text")).alias("norm"))


@query
def word_match(t):
    words = _questions(t).select(F.explode(F.split(text.normalise(F.col("text")), " ")).alias("word")).where("word <> ''").distinct()
    pairs = words.withColumn("target", F.explode(F.array(*map(F.lit, ("thing", "cancel", "theonion", "a")))))
    return pairs.select("word", "target", text.word_score(F.col("word"), F.col("target")).cast("bigint").alias("score"))


@query
def intent(t):
    return _questions(t).select("conv_id", "turn", questions.intent(F.col("text")).alias("intent"))


@query
def scenario_months(t):
    asked = F.concat(_pick(F.col("conv_id"), "for 3 months ", "a year ", "one month ", "six months ", "0 months ", "12 month "), F.col("text"))
    return _questions(t).select("conv_id", "turn", questions.scenario_months(asked).alias("months"))


@query
def goal_amount(t):
    asked = F.concat(_pick(F.col("conv_id"), "save about 120 kr a month. ", "please cut 12.50 per month, ", "reduce 0 "), F.col("text"))
    return _questions(t).select("conv_id", "turn", questions.goal_minor(asked).alias("goal_minor"), questions.asks_protection(asked).alias("protects"))


@query
def language_detect(t):
    return _questions(t).select("conv_id", "turn", questions.speech_language(F.col("text")).alias("language"))


#: Services whose names are looked for in questions.
SERVICES = ["netflix", "youtube premium", "disney plus", "hbo max", "prime video", "apple tv"]


@query
def fuzzy_entities(t):
    services = SERVICES
    asked = F.concat(_pick(F.col("conv_id"), "cancel netflx and ", "is yt or apple tv dearer, ", "pause disny ", ""), F.col("text"))
    found = _questions(t).select("conv_id", "turn", F.posexplode(questions.named_services(asked, services)).alias("rank", "one"))
    return found.select("conv_id", "turn", "rank", F.col("one.service").alias("service"), F.col("one.score").cast("int").alias("score"))


@query
def price_near_plan(t):
    plans = ["Basic", "Standard", "Standard with Ads", "Premium"]
    body = F.concat(text.html_to_text(F.col("html")), F.lit(" Standard with Ads 99,00 kr per month. Standard NOK "), (F.col("page_id") % 50 + 100).cast("string"), F.lit(" monthly. Premium kr 169 a month"))
    found = t.raw("pages").select("page_id", F.inline(pages.price_near_plan(body, plans, "NOK")))
    return found.select("page_id", "plan", "amount")


# -- accounts and subscriptions ------------------------------------------------------------------------------------------------------


@query
def subscription_ledger_of(t):
    return savings.ledger_of(savings.savings_ledger(t.savings_events(), t.subscriptions(), t.services()), 7)


@query
def subscription_list_of(t):
    return lifecycle.list_of(lifecycle.subscription_list(t.subscriptions(), t.services(), t.providers()), 7)


@query
def savings_verified_count(t):
    return savings.verified_count(t.savings_events(), _current(t), dt.date(2024, 3, 5))


@query
def total_saved_so_far(t):
    saved = savings.saved_so_far(t.history(), t.history_prices(), EVENTS_AS_OF)
    owners = t.history().select("subscription_id").distinct().unionByName(t.users().select(F.col("user_id").alias("subscription_id")).where("subscription_id < 50")).distinct()
    return savings.total_saved(saved, owners.select("subscription_id", (F.col("subscription_id") % 40).alias("user_id")))


def _new_users(t: Tables) -> DataFrame:
    key = F.col("user_id")
    return t.users().where("user_id % 3 = 1").select((key + 1_000_000).alias("user_id"), F.when(key % 2 == 0, F.upper("email")).otherwise(F.concat(F.lit("New"), (key % 50).cast("string"), F.lit("@Example.org"))).alias("email"))


def _created(t: Tables):
    return lifecycle.create_users(t.users().select("user_id", "email"), _entitlements(t), _new_users(t))


@query
def account_create(t):
    users, entitlements, _ = _created(t)
    return users.join(entitlements, "user_id", "left").select("user_id", "email", "plan")


@query
def account_create_rejects(t):
    return _created(t)[2]


@query
def account_by_email(t):
    return lifecycle.user_by_email(t.users(), _entitlements(t), "CUSTOMER#000000004@example.org")


@query
def account_deletion(t):
    users = t.users().withColumn("deletion_requested", F.when(F.col("user_id") % 3 == 0, F.date_add(F.lit(dt.date(1998, 6, 15)), (F.col("user_id") % 30).cast("int"))))
    asked, cancelled = t.users().where("user_id % 2 = 0").select("user_id"), t.users().where("user_id % 5 = 0").select("user_id")
    after = lifecycle.request_deletion(users, asked, cancelled, ORDERS_AS_OF)
    return after.select("user_id", "deletion_requested").join(lifecycle.may_sign_in(after), "user_id")


@query
def plan_gates(t):
    return t.users().join(_entitlements(t), "user_id", "left").select("user_id", lifecycle.at_least(F.col("plan"), "MANUAL").alias("manual"), lifecycle.at_least(F.col("plan"), "PREMIUM").alias("premium"))


@query
def subscription_update(t):
    return lifecycle.update_subscriptions(t.subscriptions(), _edits(t), t.services(), t.providers())[0]


@query
def subscription_update_rejects(t):
    return lifecycle.update_subscriptions(t.subscriptions(), _edits(t), t.services(), t.providers())[1]


def _edits(t: Tables) -> DataFrame:
    key = F.col("id")
    named = t.subscriptions().where("id % 3 = 0").join(t.services().select("service_id", "service_name"), "service_id")
    return named.select(
        "id", F.when(key % 10 == 1, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"), F.when(key % 7 == 2, "no such service").otherwise(F.col("service_name")).alias("service_name"), _pick(key, "asia", "europe", "nobody").alias("provider_slug"),
        F.lit("New plan").alias("new_plan"), F.when(key % 4 != 0, key % 1000).alias("new_price"), F.when(key % 5 == 0, "").otherwise(F.date_format("renewal_date", "yyyy-MM-dd")).alias("renewal"),
    )


def _deleted(t: Tables):
    asked = t.subscriptions().where("id % 6 = 1").select("id", F.when(F.col("id") % 4 == 3, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"))
    return lifecycle.delete_subscriptions(asked, t.subscriptions(), {"actions": t.actions()}, t.savings_events())


@query
def subscription_delete(t):
    return _deleted(t)[0].select("id")


@query
def subscription_delete_actions(t):
    return _deleted(t)[1]["actions"].select("id", "subscription_id")


@query
def subscription_delete_savings(t):
    return _deleted(t)[2].select("id", "subscription_id")


@query
def provider_seed_upsert(t):
    seed = t.spark.createDataFrame([(1, "america", 1), (1, "the americas", 2), (7, "moon", 1)], "provider_id int, provider_slug string, ord int")
    return lifecycle.upsert(t.providers().withColumn("provider_id", F.col("provider_id").cast("int")), seed, "provider_id", "ord")


def _purchases(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    return t.raw("orders").select(
        key.alias("ord"), F.col("o_custkey").alias("user_id"), _pick(key, "IOS", "ANDROID").alias("platform"), _pick(key, "monthly", "yearly", "unknown").alias("product_id"), F.when(key % 31 != 0, key.cast("string")).alias("transaction_id"),
        F.when(key % 37 != 0, F.concat(F.lit("t"), (key % 5000).cast("string"))).alias("original_id"), F.when(key % 17 == 0, F.col("o_orderdate")).alias("revoked_at"), F.date_add(F.col("o_orderdate").cast("date"), 31).alias("expires_at"),
    )


def _claims(t: Tables):
    products = t.spark.createDataFrame([("monthly", "MANUAL"), ("yearly", "PREMIUM")], "product_id string, plan string")
    good = lifecycle.valid_purchase(_purchases(t), products, dt.datetime(1998, 7, 1))
    before = t.raw("orders").where("o_orderkey % 400 = 0").select(_pick(F.col("o_orderkey"), "IOS", "ANDROID").alias("platform"), F.concat(F.lit("t"), (F.col("o_orderkey") % 5000).cast("string")).alias("original_id"), F.lit(1).cast("bigint").alias("user_id")).distinct()
    return good, lifecycle.claim_purchases(before, _entitlements(t), good)


@query
def purchase_validity(t):
    return _claims(t)[0].select("ord", "plan")


@query
def purchase_events(t):
    return _claims(t)[1][0]


@query
def purchase_entitlements(t):
    return _claims(t)[1][1]


@query
def purchase_rejects(t):
    return _claims(t)[1][2]


def _placed(t: Tables) -> DataFrame:
    key = F.col("id")
    return t.subscriptions().withColumns({"currency": _pick(key, "NOK", "USD", "EUR", "DKK"), "country": F.when(key % 3 == 0, _pick(key, "NO", "DE", "US"))})


@query
def country_backfill(t):
    return _placed(t).select("id", lifecycle.country_or_currencys(F.col("country"), F.col("currency")).alias("country"))


@query
def market_filter(t):
    return portfolio.in_market(_placed(t), "NO").select("id")


@query
def renewal_at_noon(t):
    return t.subscriptions().select("id", lifecycle.renewal_noon(F.col("renewal_date")).alias("renews_at"))


@query
def metadata_merge(t):
    return t.actions().select("id", lifecycle.merge_metadata(F.when(F.col("id") % 3 != 0, F.lit('{"a":"1","b":"2"}')), F.concat(F.lit('{"b":"'), F.col("id").cast("string"), F.lit('"}'))).alias("metadata"))


@query
def chat_history(t):
    return lifecycle.chat_history(t.raw("conversations"), 3)


@query
def top3_expensive(t):
    return portfolio.top_recommendations(t.subscriptions(), ORDERS_AS_OF, 3)


@query
def cost_comparison(t):
    pairs = t.subscriptions().where("id % 4 = 0").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return portfolio.comparison(t.subscriptions(), pairs)


@query
def html_export(t):
    rows = lifecycle.subscription_list(t.subscriptions(), t.services(), t.providers()).withColumn("service_name", F.concat("service_name", F.lit(" <&> 'x'")))
    saved = t.subscriptions().where("id % 3 = 0").select(F.col("id").alias("subscription_id"), (F.col("id") % 5000).alias("saved_minor"))
    return portfolio.html_export(rows, saved)


# -- markets and sources -------------------------------------------------------------------------------------------------------------


@query
def price_valid(t):
    return _valid(t).groupBy("country", "currency", "kind").agg(F.count("*").alias("n"))


@query
def price_last_wins(t):
    return pricing.last_of_each(t.candidates())


@query
def price_market_scan(t):
    return pricing.verified_prices(_stored(t), "no", "nok")


@query
def price_store_counts(t):
    return pricing.stored_counts(pricing.resolve(_valid(t)))


def _registry(t: Tables) -> DataFrame:
    return t.candidates().where("kind = 'registry'").withColumn("route", F.when(F.col("ord") % 3 != 0, F.col("route")))


@query
def registry_scan(t):
    return pricing.registry_scan(_registry(t), 5, "no", "NOK").select("plan", "route", "price_minor", "ord", "line")


def _catalogue(t: Tables, markets) -> DataFrame:
    """A nested store catalogue: plans by service and market."""
    pick = lambda k: F.element_at(F.array(*(F.lit(m[k]) for m in markets)), (F.col("p_partkey") % len(markets)).cast("int") + 1)
    price = F.col("p_partkey") % 900
    plans = F.array(F.struct(F.lit("Small").alias("plan"), price.alias("price_minor")), F.struct(F.lit("Large").alias("plan"), (price * 2).alias("price_minor")))
    return t.raw("part").select(F.col("p_partkey").alias("service"), pick(0).alias("country"), pick(1).alias("currency"), F.lit("apple").alias("route"), plans.alias("plans"))


@query
def store_catalogue(t):
    return pricing.store_catalogue(_catalogue(t, (*MARKETS, ("US", "USD"))), t.markets())


@query
def china_catalogue(t):
    return pricing.china_catalogue(_catalogue(t, (("CN", "CNY"), ("CN", "USD"), ("NO", "NOK"))))


@query
def market_sources(t):
    adapters = [t.candidates().where(f"kind = '{kind}' and country = 'NO' and service % 4 <> 1").select(*pricing.KEY, "price_minor", "kind") for kind in ("page", "help")]
    return pricing.market_sources(adapters, t.candidates().where("kind = 'registry' and country = 'NO'").select(*pricing.KEY, "price_minor", "kind")).groupBy("service", "kind").agg(F.count("*").alias("n"))


@query
def refresh_summary(t):
    results = t.raw("nation").select(F.substring("n_name", 1, 2).alias("country"), F.when(F.col("n_nationkey") % 6 != 1, F.col("n_nationkey").cast("bigint")).alias("n_prices"))
    return pricing.refresh_summary(results)


SLUGS = ("netflix", "hulu", "youku", "apple-music", "paramount-plus", "prime-video", "amazon-prime", "amazon-music-unlimited", "disney-plus", "unknown")


@query
def service_availability(t):
    return t.raw("part").select("p_partkey", routing.available(_pick(F.col("p_partkey"), *SLUGS), _pick(F.col("p_partkey"), "US", "NO", "CN", "DE", "SE", "IE", "PT")).alias("available"))


@query
def billing_routes(t):
    routes = t.raw("part").where("p_partkey % 3 <> 0").select(F.concat(F.lit("s"), (F.col("p_partkey") % 60).cast("string")).alias("service"), _pick(F.col("p_partkey"), "apple", "direct", "moon", "carrier", "amazon").alias("provider"))
    services = t.raw("part").select(F.concat(F.lit("s"), (F.col("p_partkey") % 70).cast("string")).alias("service")).distinct()
    return routing.allowed_routes(services, routes, ["direct", "apple", "google-play", "amazon", "carrier"])


@query
def service_picker(t):
    services = t.services().select(_pick(F.col("service_id"), "netflix", "hulu", "youku", "x").alias("slug"), F.concat(F.lit("s"), F.col("service_id").cast("string")).alias("service"), "service_name", "category")
    prices = t.candidates().where("price_minor > 0").select(F.concat(F.lit("s"), F.col("service").cast("string")).alias("service"), "country")
    owned = t.subscriptions().where("user_id = 7").select(F.concat(F.lit("s"), F.col("service_id").cast("string")).alias("service"))
    return routing.picker(services, prices, owned, "NO", "Brand#13")


@query
def country_search(t):
    return routing.country_search(t.raw("nation").select(F.substring("n_name", 1, 2).alias("country"), F.col("n_name").alias("name")), " N_1 ")


@query
def page_metadata(t):
    key = F.col("page_id")
    pages_ = t.raw("pages").select("page_id", _pick(key, "NO", "se", "DE", "USA").alias("requested"), F.when(key % 3 == 0, _pick(key, "NO", "DE")).alias("reported"))
    return routing.page_metadata(pages_)


def _contexts(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    return t.raw("orders").select(key.alias("id"), _pick(key, *SLUGS).alias("service"), _pick(F.floor(key / 3), "apple", "Google", "carrier-tv", "amazon", "direct", "google-play", " DIRECT ").alias("provider"), _pick(F.floor(key / 7), "PAUSE", "CANCEL", "REACTIVATE", "MANAGE").alias("action"), _pick(F.floor(key / 11), "NO", "US", "gb").alias("country"))


@query
def provider_routes(t):
    return _contexts(t).select("id", routing.billing_provider(F.col("provider")).alias("billing"), routing.provider_route(routing.billing_provider(F.col("provider"))).alias("r")).select("id", "billing", "r.provider", "r.url", "r.label")


@query
def management_urls(t):
    pages_ = t.spark.createDataFrame([("netflix", "https://m", "https://p", None, None), ("disney-plus", "https://d", None, "https://c", "https://r"), ("hulu", None, None, "https://h", None)], "service string, manage_url string, pause_url string, cancel_url string, reactivate_url string")
    return routing.management_urls(_contexts(t), pages_).select("id", "url")


@query
def pause_support(t):
    return _contexts(t).select("id", routing.supports_pause(F.col("provider"), F.when(F.col("service") != "unknown", F.col("service").isin("netflix", "hulu"))).alias("pauses"))


@query
def capability_resolution(t):
    return routing.capabilities(_contexts(t).select("id", "service", "provider", "action")).select("id", "adapter", "execution", "supported", "premium_only", "url")


# -- questions -----------------------------------------------------------------------------------------------------------------------

#: Questions that are asked besides the turns' own words, so that every kind of answer occurs.
ASKED = ("never cancel it", "save about 120 kr a month", "what should i cut", "open settings", "how do i add a subscription", "what if i pause it for 3 months", "which costs more", "most expensive", "recommend something", "stale prices", "how much am i spending",
    "what did i save", "set up", "when does it renew", "cancel netflx", "next charge", "hello", "help", "explain dark mode", "and then the first one", "what about the latter")


def _asked(t: Tables) -> DataFrame:
    return _questions(t).select("conv_id", "turn", F.concat(_pick(F.col("conv_id") + F.col("turn"), *ASKED), F.lit(" "), "text").alias("text"))


@query
def help_topics(t):
    return _asked(t).select("conv_id", "turn", questions.help_topic(F.col("text")).alias("topic"))


@query
def answer_kinds(t):
    rows = _asked(t).select("conv_id", "turn", "text", questions.intent(F.col("text")).alias("intent"))
    months, compared = F.when(F.col("conv_id") % 3 == 0, 6), F.when(F.col("conv_id") % 2 == 0, F.col("turn") % 4 == 0)
    return rows.select("conv_id", "turn", "intent", questions.answer_kind(F.col("text"), F.col("intent"), months, compared).alias("kind"))


@query
def conversation_memory(t):
    ids = lambda *xs: F.array(*xs).cast("array<bigint>")
    k = F.col("conv_id") + F.col("turn")
    named = F.when(k % 5 == 0, ids(k)).when(k % 5 == 2, ids(k, k + 1, k + 2)).otherwise(ids())
    rows = questions.remembered(_asked(t).withColumn("mentioned", named))
    return rows.select("conv_id", "turn", "last_id", F.array_join("compared", ",").alias("compared"), F.col("months_before").cast("int").alias("months_before"), "about")


#: Services by name and slug, and what is asked about them besides the turns' own words.
FINDABLE = (("Netflix", "netflix"), ("YouTube Premium", "youtube"), ("Disney+", "disney-plus"), ("Max", None), ("Prime Video", "amazon-prime"), ("Apple TV+", "apple-tv"), ("Canal+ Sport++", "canal"))
NAMES_ASKED = ("netflx and the video prime", "you tube", "plus disney", "HBO?", "", "appel", "canal plus sport", "amazin", "sport", "premum")


@query
def named_service(t):
    rows = _questions(t).select("conv_id", "turn", F.concat(_pick(F.col("conv_id") + F.col("turn"), *NAMES_ASKED), F.lit(" "), "text").alias("text"))
    return rows.select("conv_id", "turn", questions.named_service(F.col("text"), list(FINDABLE)).alias("service"))


@query
def word_matches(t):
    words = _questions(t).select(F.explode(F.split(text.normalise(F.col("text")), " ")).alias("word")).distinct()
    pairs = words.withColumn("target", F.explode(F.array(*map(F.lit, ("the", "canel", "thing", "")))))
    return pairs.select("word", "target", text.word_matches(F.col("word"), F.col("target")).alias("matches"))


# -- pages ---------------------------------------------------------------------------------------------------------------------------

#: What stands on a page in the form that each parser knows; {a} and {b} are prices of the page, and {x} is its currency mark on some pages and another's on others.
SAMPLES = {
    "faq_prices": '<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"components":{"faq":{"faqEntry":[{"question":"How much is Spotify Premium?","answer":"Premium Individual plan costs %d,50 %s per month. Premium Duo plan costs %d kr per month."}]}}}}}</script>',
    "card_recurring": '<a data-testid="l4l_%s" class="x"> %s </a><p>Fra 59 kr per måned</p><p>deretter betaler du</p><b>%d %s per måned</b>',
    "membership": """<div class="c" data-a-input-name='ChoosePlanRadioButton' data-index="%d"><label>€%d.99 %s</label></div>""",
    "kr_range": '<p>Plans range from kr %d a month to kr %d a month</p>',
    "market": '<script>AF_initDataCallback({key: \'ds:0\', hash: \'1\', data:[[null,null,null,12,3,null,"%s"]]});</script>',
    "anchored_price": '<p>Få Apple TV for bare kr %d per måned.</p><p>Apple TV-abonnementet koster NOK %d per måned</p>',
    "recurring_prices": '<p>Individual 0 kr for 3 months, then %d kr per month. Duo kr %d monthly.</p>',
    "footnote_prices": '<p>for øyeblikket %d kr per måned for Premium, %d kr per måned for Standard eller %d %s per måned for Standard med reklame</p>',
    "structured_plans": '<script>[{"productName":{"richTextHtml":"<p>x</p>","plainText":"Basis med reklame"},"price":{"format":"{{amount}} {{currency}}/{{period}}","currencyCode":"NOK","amount":{"richTextHtml":"<p>x</p>","plainText":"%d,00"},"period":{"plainText":"%s"},"currency":{"plainText":"kr"}},"pricePlan":{"id":"p1"}},'
    '{"productName":{"plainText":"Standard"},"price":{"amount":"77","currencyCode":"NOK","period":"month"},"pricePlan":{"id":"p0"}},{"productName":{"plainText":" Premium Plus "},"price":{"format":"x","currencyCode":"%s","amount":{"plainText":"1 %d,50"},"period":{"plainText":"mese"},"currency":{"plainText":"kr"}} , "pricePlan":{"id":"p2"}},'
    '{"productName":{"plainText":"PREMIUM"},"price":{"format":"x","currencyCode":"NOK","amount":{"plainText":"%d"},"period":{"plainText":"month"},"currency":{"plainText":"kr"}},"pricePlan":{"id":"p3"}}]</script>',
    "embedded_plans": '<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"basePageProps":{"country":" %s "},"other":{"planId":"PREMIUM_FAMILY","isRecurringProduct":true,"primaryPriceDescription":"1 kr"},"components":{"a":[{"b":{"planId":"PREMIUM_INDIVIDUAL","isRecurringProduct":true,"primaryPriceDescription":"0 kr for 3 months","secondaryPriceDescription":"%d,90 %s/month after",'
    '"c":[[{"planId":"PREMIUM_STUDENT","isRecurringProduct":%s,"subheaderPrice":"kr %d"}]]}},{"planId":"PREMIUM_DUO","isRecurringProduct":true,"secondaryPriceDescription":null,"primaryPriceDescription":"%d kr"},{"planId":"PREMIUM_DUO","isRecurringProduct":true,"primaryPriceDescription":"5 kr"},{"planId":"TRIAL","isRecurringProduct":true,"primaryPriceDescription":"7 kr"}]}}}}</script>',
    "renewal_price": '<script>x = {"note":"a } brace { in a string, and \\"} one","list":[{"k":{}},{"sellProductName":"SVIP会员","inner":{"a":"}"},"sellSkuName":"%s","sellGoodsName":"SVIP会员连续包月","sellPrice":"18","sellGoodsDesc":"享前3个月18元/月，第4个月起%d元/月"}],"more":%s};</script>',
    "field_plans": '<script>"fields":{"planPriceCurrency":{"fieldType":"String","value":"NOK"},"planPriceAmount":{"fieldType":"String","value":"%d.0"},"billingFrequency":{"fieldType":"String","value":"Monthly"},"planType":{"fieldType":"String","value":"BASIC"}} "fields": {"planType":{"fieldType":"String","value":"STD"},"localizedPlanName":{"fieldType":"String","value":" Standard"},'
    '"planPriceCurrency":{"fieldType":"String","value":"%s"},"planPriceAmount":{"fieldType":"String","value":"%d,50"},"billingFrequency":{"fieldType":"String","value":"%s"}} "fields":{"planType":{"fieldType":"String","value":"Premium"},"planPriceCurrency":{"value":"NOK"},"planPriceAmount":{"value":"%d"},"billingFrequency":{"value":"MONTHLY"}} '
    '"fields":{"planType":{"fieldType":"String","value":"Basis"},"planPriceCurrency":{"value":"NOK"},"planPriceAmount":{"value":"%d"},"billingFrequency":{"value":"Monthly"}}</script>',
    "basic_monthly": '<div class="sku"><h3 class="oc-product-title">Microsoft 365 Basic</h3><i class="oc-displaySalePrice">kr 5,00</i> per måned<span class="oc-displayListPrice"> kr %d,00 </span><span class="oc-displayUnit"> per år </span></div><div class="x sku y"><h3 class="oc-product-title"> Microsoft 365 Basic </h3>'
    '<span class="oc-displaySalePrice">kr 7,00</span><span class="oc-displayUnit">per måned</span><span class="oc-displayListPrice">kr %d,50</span><b>now</b><span class="oc-displayUnit z"> per %s </span></div>',
    "comparison_prices": '<h2 class="h4"> Microsoft 365 Personal </h2><p>kr 1,00/måned</p><div class="h4 sku2price price-heading">kr 2,00/måned</div><div class="h4 sku1price price-heading ">kr %d,00/måned</div><h2>Microsoft 365 Family</h2><div class="sku1price price-heading">kr 1 %d,00/%s</div><h2>Microsoft 365 Basic</h2><div class="sku1price price-heading">kr 3,00/måned</div>',
    "gallery_prices": '<li class="x" data-analytics-gallery-item-id="individual"><h3>X</h3><p>kr %d per måned, gratis i 1 måned</p></li><li class="x" data-analytics-gallery-item-id="family"><h3>X</h3><p>kr %d,50 per måned%s</p></li><li class="x" data-analytics-gallery-item-id="student"><h3>X</h3><p>bare %d kr pr. %s for nye</p></li><li class="x" data-analytics-gallery-item-id="apple one"><h3>X</h3><p>fra kr 999 per måned</p></li>',
    "option_prices": '<script>"optionItemRenderer":{"title":{"runs":[{"text":"Enkeltperson"}]},"subtitle":{"runs":[{"text":"1 måned for 0 kr"},{"text":" Deretter "},{"text":"9,00 kr\u2060/\u2060måned"}]},"optionId":"unlimited-B.P.LITE"}"optionItemRenderer":{"title":{"runs":[{"text":"Personlig"}]},"subtitle":{"runs":[{"text":"1 måned for 0 kr"},{"text":" Deretter "},{"text":"%d,00 kr\u2060/\u2060måned"}]},"optionId":"unlimited.P.INDIVIDUAL"}"optionItemRenderer":{"title":{"runs":[{"text":"Familieabonnement"}]},"subtitle":{"runs":[{"text":"1 måned for 0 kr"},{"text":" Deretter "},{"text":"%d,50 kr\u2060/\u2060måned"}]},"optionId":"unlimited.P.FAMILY"}"optionItemRenderer":{"title":{"runs":[{"text":"%s"}]},"subtitle":{"runs":[{"text":"1 måned for 0 kr"},{"text":" Deretter "},{"text":"%d kr\u2060/\u2060måned"}]},"optionId":"unlimited.P.STUDENT"}"optionItemRenderer":{"title":{"runs":[{"text":"Enkeltperson"}]},"subtitle":{"runs":[{"text":"1 måned for 0 kr"},{"text":" Deretter "},{"text":"%d,00 kr\u2060/\u2060måned"}]},"optionId":"unlimited.P.TWO"}</script>',
    "sku_prices": '<div class="a sku b"><h3 class="oc-product-title"> Microsoft 365 Basic </h3><span class="oc-displaySalePrice">1,00 €</span><span class="oc-displayListPrice"> 20,00 € </span><span class="oc-displayUnit">/Jahr</span></div><div class="a sku b"><h3 class="oc-product-title"> Microsoft 365&nbsp;Basic </h3><span class="oc-displaySalePrice">1,00 €</span><span class="oc-displayListPrice"> %d,00 € </span><span class="oc-displayUnit">/Monat</span></div><div class="a sku b"><h3 class="oc-product-title"> Microsoft 365 SINGLE </h3><span class="oc-displaySalePrice">1,00 €</span><span class="oc-displayListPrice"> € %d,50 </span><span class="oc-displayUnit">/monat</span></div><div class="a sku b"><h3 class="oc-product-title"> Microsoft  365 Familia </h3><span class="oc-displaySalePrice">1,00 €</span><span class="oc-displayListPrice"> 1.%d,00&nbsp;€ TTC </span><span class="oc-displayUnit">%s</span></div><div class="a sku b"><h3 class="oc-product-title"> Microsoft 365 Premium </h3><span class="oc-displaySalePrice">1,00 €</span><span class="oc-displayListPrice"> %d € </span><span class="oc-displayUnit"> al  mes </span></div><div class="a sku b"><h3 class="oc-product-title"> Microsoft 365 Premium </h3><span class="oc-displaySalePrice">1,00 €</span><span class="oc-displayListPrice"> %d € </span><span class="oc-displayUnit">/mois</span></div>',
    "card_prices": '<a data-testid="l4l_premium">PREMIUM</a> Fra %d kr./md Spar 26 %%%% i 6 måneder, derefter %d kr./md <a data-testid="l4l_basic">REKLAMER</a><b>%d</b> kr <a data-testid="l4l_standard">STANDARD</a><p>DKK %d,50 per %s</p><a data-testid="l4l_premium">AGAIN</a> 5 kr./md',
    "last_amount": "<p>0 kr, %d kr, %d kr, NOK %d</p>",
    "page_language": '<HTML class="x" lang="%s">',
    "tv_price": "<p>Get Apple&nbsp;TV for just &#36;%d.99 per month after a free trial.</p><p>Apple One plans start at $21.95 per month.</p><p>Apple Music and Apple TV. Student Plan renews at $6.99 per month.</p><p>Nothing of this is an offer to anyone, and what is written here only keeps the next sentence away from it.</p><p>%s</p>",
    "video_price": '<script>{"osLocale":"%s","recordTerritory":"%s"}</script><script>{"body":"Prime Video %d,90&nbsp;€ \\u002F mois %s","planLogoAltText":"Prime Video"}</script>',
}


def _page(t: Tables, sample: str, *values) -> DataFrame:
    return t.raw("pages").select("page_id", F.concat("html", F.format_string(sample, *values)).alias("html"))


def _amounts(t: Tables):
    key = F.col("page_id")
    return (key % 90 + 10).cast("int"), F.when(key % 7 == 3, "usd").otherwise("kr"), (key % 60 + 120).cast("int")


@query
def page_faq_prices(t):
    return _page(t, SAMPLES["faq_prices"], *_amounts(t)).select("page_id", F.inline(pages.faq_prices(F.col("html"), "NOK")))


@query
def page_price_range(t):
    low, mark, high = _amounts(t)
    rows = _page(t, SAMPLES["kr_range"], low, high)
    return rows.select("page_id", pages.price_range(text.html_to_text(F.col("html")), "NOK").alias("r")).select("page_id", "r.low", "r.high")


@query
def page_market(t):
    code = F.when(F.col("page_id") % 4 == 0, "no").otherwise(_pick(F.col("page_id"), "NO", "SE"))
    rows = _page(t, SAMPLES["market"], code)
    return rows.select("page_id", pages.embedded_market(F.col("html")).alias("market"))


@query
def page_anchored_price(t):
    low, mark, high = _amounts(t)
    rows = _page(t, SAMPLES["anchored_price"], low, F.when(F.col("page_id") % 2 == 0, low).otherwise(high))
    return rows.select("page_id", pages.unanimous_price(text.html_to_text(F.col("html")), pages.NORWAY_MONTHLY).alias("amount"))


@query
def page_recurring_prices(t):
    low, mark, high = _amounts(t)
    rows = _page(t, SAMPLES["recurring_prices"], low, high)
    return rows.select("page_id", F.inline(pages.recurring_prices(text.html_to_text(F.col("html")), ["Individual", "Duo", "Student"], "NOK")))


@query
def page_storage_tiers(t):
    low, mark, high = _amounts(t)
    currency = F.when(F.col("page_id") % 5 == 0, "EUR").otherwise("NOK")
    one = '["%d","100 GB"],2,["%d000000","x","%s"],["1","one.%s","y"],"p","q", "Google AI Pro" '
    rows = _page(t, "<script>AF_initDataCallback({key: 'ds:2', data:[" + one + one.replace('"Google AI Pro"', '"none"') + "]});</script>", low, low, currency, F.lit("monthly"), high, high, F.lit("NOK"), F.when(F.col("page_id") % 2 == 0, "annual").otherwise("monthly"))
    return rows.select("page_id", F.inline(pages.storage_tiers(F.col("html"), "NOK")))


@query
def page_structured_plans(t):
    low, mark, high = _amounts(t)
    key = F.col("page_id")
    period, foreign = F.when(key % 3 == 0, "år").otherwise(_pick(key, "måned", " Måned ")), F.when(key % 4 == 0, "SEK").otherwise("NOK")
    rows = _page(t, SAMPLES["structured_plans"], low, period, foreign, high, high)
    return rows.select("page_id", F.inline(pages.structured_plans(F.col("html"), "NOK")))


@query
def page_embedded_plans(t):
    """Plans at several depths of a page's data; other countries' pages, other currencies, trials and what stands outside the components don't count."""
    low, mark, high = _amounts(t)
    rows = _page(t, SAMPLES["embedded_plans"], F.when(F.col("page_id") % 5 == 0, "SE").otherwise("no"), low, mark, F.when(F.col("page_id") % 2 == 0, "true").otherwise("false"), low, high)
    return rows.select("page_id", F.inline(storefronts.embedded_plans(F.col("html"), "NOK", "NO")))


@query
def page_renewal_price(t):
    """The price of later months, in an object among braces that stand in strings; two products on a page leave it in doubt."""
    low, mark, high = _amounts(t)
    key = F.col("page_id")
    sample = F.format_string(SAMPLES["renewal_price"], F.when(key % 3 == 0, "连续包年").otherwise("连续包月"), low, F.when(key % 4 == 0, '{"sellProductName":"SVIP会员"}').otherwise("{}"))
    return t.raw("pages").select("page_id", F.concat(sample, "html").alias("html")).select("page_id", F.inline(storefronts.renewal_price(F.col("html"), "CNY")))


@query
def page_field_plans(t):
    """Three plans in field objects; a foreign price, a yearly one or a plan with two prices empties the page."""
    low, mark, high = _amounts(t)
    key = F.col("page_id")
    values = low, F.when(key % 7 == 3, "USD").otherwise("NOK"), high, F.when(key % 5 == 0, "Yearly").otherwise(" monthly"), high, F.when(key % 4 == 0, low + 1).otherwise(low)
    return _page(t, SAMPLES["field_plans"], *values).select("page_id", F.inline(storefronts.field_plans(F.col("html"), "NOK")))


@query
def page_tv_price(t):
    """A price near the service's name, with other offers before, after and between."""
    low, mark, high = _amounts(t)
    more = F.when(F.col("page_id") % 3 == 0, "Apple TV is $9.99 / month").when(F.col("page_id") % 3 == 1, "Apple TV with Apple One is $9.99 / month").otherwise("end")
    rows = _page(t, SAMPLES["tv_price"], low, more)
    return rows.select("page_id", storefronts.tv_price(F.col("html"), "USD").alias("amount"))


@query
def page_video_price(t):
    """A price near the service's logo, on pages of the territory and the language alone."""
    low, mark, high = _amounts(t)
    key = F.col("page_id")
    rows = _page(t, SAMPLES["video_price"], _pick(key, "fr-FR", "fr_FR", "de-DE", "fr-FR"), _pick(key, "FR", "fr", "FR", "BE", "FR"), low, F.when(key % 6 == 0, "or €3,99 / mois").otherwise("3,99 € one day"))
    return rows.select("page_id", storefronts.video_price(F.col("html"), "FR", "EUR", ["fr-fr"]).alias("amount"))


@query
def page_footnote_prices(t):
    low, mark, high = _amounts(t)
    rows = _page(t, SAMPLES["footnote_prices"], high, high, low, mark)
    return rows.select("page_id", F.inline(pages.footnote_prices(F.col("html"), "NOK")))


@query
def page_basic_monthly(t):
    low, mark, high = _amounts(t)
    rows = _page(t, SAMPLES["basic_monthly"], high, low, F.when(F.col("page_id") % 3 == 0, "år").otherwise("måned"))
    return rows.select("page_id", pages.basic_monthly(F.col("html"), "NOK").alias("amount"))


@query
def page_comparison_prices(t):
    low, mark, high = _amounts(t)
    rows = _page(t, SAMPLES["comparison_prices"], low, high, F.when(F.col("page_id") % 3 == 0, "år").otherwise("måned"))
    return rows.select("page_id", F.inline(pages.comparison_prices(F.col("html"), "NOK")))


@query
def page_card_prices(t):
    """Cards in any language: an offer first and what it turns into last; a card without a monthly price, and one more of a plan that has been, don't count."""
    low, mark, high = _amounts(t)
    rows = _page(t, SAMPLES["card_prices"], low, high, high, low, F.when(F.col("page_id") % 3 == 0, "år").otherwise("måned"))
    return rows.select("page_id", F.inline(storefronts.card_prices(F.col("html"), "DKK")))


@query
def page_sku_prices(t):
    """Monthly cards of four products in several languages; a product that lacks its card, or has two prices, empties the page."""
    low, mark, high = _amounts(t)
    key = F.col("page_id")
    rows = _page(t, SAMPLES["sku_prices"], low, low, high, F.when(key % 3 == 0, "/Jahr").otherwise("/mese"), high, F.when(key % 4 == 0, high + 1).otherwise(high))
    return rows.select("page_id", F.inline(storefronts.sku_prices(F.col("html"), "EUR")))


@query
def page_option_prices(t):
    """Three full options among smaller ones; an unknown title, or a plan with two prices, empties the page."""
    low, mark, high = _amounts(t)
    key = F.col("page_id")
    rows = _page(t, SAMPLES["option_prices"], low, high, F.when(key % 3 == 0, "Pensjonist").otherwise("Student"), low, F.when(key % 4 == 0, low + 1).otherwise(low))
    return rows.select("page_id", F.inline(storefronts.option_prices(F.col("html"), "NOK")))


@query
def page_gallery_prices(t):
    """Three plans of a gallery beside another offer; an item with a second price, or a yearly one, empties the page."""
    low, mark, high = _amounts(t)
    key = F.col("page_id")
    rows = _page(t, SAMPLES["gallery_prices"], low, high, F.when(key % 4 == 0, " eller 7 kr per måned").otherwise(""), low, F.when(key % 3 == 0, "år").otherwise("maned"))
    return rows.select("page_id", F.inline(storefronts.gallery_prices(F.col("html"), "NOK")))


@query
def page_tier_prices(t):
    low, mark, high = _amounts(t)
    tiers = "".join(f'<div class="tile plan-{x}"><p>%d kr</p></div>' for x in ("50gb", "200gb", "2tb", "6tb", "12tb"))
    rows = _page(t, tiers + "<p>%s</p>", low, low + 1, high, high + 1, high + 2, F.when(F.col("page_id") % 3 == 0, "77 kr").otherwise("end"))
    return rows.select("page_id", F.inline(pages.tier_prices(F.col("html"), "NOK")))


@query
def page_last_amount(t):
    low, mark, high = _amounts(t)
    rows = _page(t, SAMPLES["last_amount"], low, high, low)
    return rows.select("page_id", pages.last_amounts(text.html_to_text(F.col("html")), "NOK").alias("amount"))


@query
def plan_names(t):
    raw = _pick(F.col("p_partkey"), " Basis", "STANDARD", "Standard med reklame ", "Ultra", "premium", "Basic")
    return t.raw("part").select("p_partkey", pages.plan_name(raw).alias("plan"))


@query
def page_language(t):
    declared = F.format_string(SAMPLES["page_language"], _pick(F.col("page_id"), "nb-NO", "en", ""))
    rows = t.raw("pages").select("page_id", F.concat(declared, "html").alias("html"))
    return rows.select("page_id", pages.page_language(F.col("html")).alias("language"))


@query
def page_card_recurring(t):
    low, mark, high = _amounts(t)
    rows = _page(t, SAMPLES["card_recurring"] * 4, F.lit("premium"), F.lit("PREMIUM"), high, F.lit("kr"), F.lit("premium"), F.lit("PREMIUM"), high, F.lit("kr"), F.lit("basic"), F.lit("STANDARD MED REKLAME"), low, mark, F.lit("standard"), F.lit("UKJENT"), low, F.lit("kr"))
    return rows.select("page_id", F.inline(pages.card_recurring(F.col("html"), "NOK")))


@query
def page_china_prices(t):
    low, mark, high = _amounts(t)
    sample = "<h2>Microsoft 365 个人版</h2><p>¥%d/月</p><p>¥%d/年</p><h2>Microsoft 365 家庭版</h2><p>¥ %d.50 / 月</p><i>¥%d.50/月</i><p>¥999/年</p><h2>Microsoft 365 %s</h2>"
    rows = _page(t, sample, low, high, high, F.when(F.col("page_id") % 3 == 0, high + 1).otherwise(high), F.when(F.col("page_id") % 4 == 0, "个人版").otherwise("商业版"))
    return rows.select("page_id", F.inline(pages.china_prices(F.col("html"), "CNY")))


@query
def page_membership_monthly(t):
    low, mark, high = _amounts(t)
    period = F.when(F.col("page_id") % 3 == 0, "per jaar").when(F.col("page_id") % 5 == 0, "per maand, 3,50 € per week").otherwise("per maand")
    rows = _page(t, SAMPLES["membership"] * 2, F.lit(2), high, F.lit("per maand"), F.lit(1), low, period)
    return rows.select("page_id", pages.membership_monthly(F.col("html"), "EUR").alias("amount"))


# -- a market's refresh, from pages to snapshots ---------------------------------------------------------------------------------------

REFRESHES = dt.datetime(1999, 1, 1), dt.datetime(1999, 1, 2), dt.datetime(1999, 1, 2, 12)


def _page_evidence(t: Tables) -> DataFrame:
    """What the card parser finds on pages, as evidence of one kind alone."""
    cents = F.round(F.col("amount") * 100).cast("bigint")
    return page_card_prices(t).select(
        (F.col("page_id") + 1_000_000).alias("service"), "plan", F.lit("direct").alias("route"), F.lit("DK").alias("country"), F.lit("DKK").alias("currency"), cents.alias("price_minor"), F.lit("exact").alias("price_type"),
        F.lit("page").alias("kind"), F.col("page_id").alias("ord"), F.lit(1).alias("line"), F.lit(70).alias("priority"),
    )


def _refreshed(t: Tables) -> tuple[DataFrame, refresh.Prices]:
    """Three refreshes: all evidence; a day later only some of one market's, and none from pages; half a day later none at all."""
    currencies = t.spark.createDataFrame([*MARKETS, ("DK", "DKK"), ("US", "USD")], "country string, currency string")
    asked = lambda *rows: t.spark.createDataFrame(rows, "country string, force boolean")
    evidence = t.candidates().drop("seen_at")
    runs = (
        (asked(("no", False), ("SE", False), ("XX", False), ("DK", None)), evidence.unionByName(_page_evidence(t))),
        (asked(("NO", False), ("SE", True), ("SE", False), ("dk", False), ("xx", False), (None, False)), evidence.where("country = 'NO' and line >= 3")),
        (asked(("NO", False), ("SE", False), ("DK", False), ("", False)), evidence.limit(0)),
    )
    state, told = refresh.no_prices(t.spark), []
    for number, ((who, what), now) in enumerate(zip(runs, REFRESHES, strict=True), 1):
        served, state = refresh.refresh(state, who, what, currencies, now)
        state = refresh.settled(state)
        told.append(served.withColumn("run", F.lit(number)))
    return told[0].unionByName(told[1]).unionByName(told[2]), state


@query
def price_refresh(t):
    return _refreshed(t)[0]


@query
def price_refresh_items(t):
    return _refreshed(t)[1].items


@query
def price_refresh_stored(t):
    return _refreshed(t)[1].stored
