"""Subscriptions: lists, effective status, renewals, and changes as functions from old rows and a change to new rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def effective_status(status: Column, effective: Column, as_of: dt.date) -> Column:
    """A pause or cancellation in the future is still active; no status counts as active."""
    ahead = status.isin("PAUSED", "CANCELLED") & (effective > F.lit(as_of))
    return F.when(status.isNull() | ahead, F.lit("ACTIVE")).otherwise(status)


def renews(status: Column, effective: Column, renewal: Column) -> Column:
    """Whether the renewal takes place: active, or stopped only strictly after it. A stop without a date stops it."""
    return renewal.isNotNull() & (status.isNull() | (status == "ACTIVE") | F.coalesce(status.isin("PAUSED", "CANCELLED") & (effective > renewal), F.lit(False)))


def subscription_list(subscriptions: DataFrame, services: DataFrame, providers: DataFrame) -> DataFrame:
    """Subscriptions with service and provider names and a formatted renewal date. Providers are five; services may be many, and are left to adaptive execution."""
    named = subscriptions.join(services.select("service_id", "service_name"), "service_id").join(F.broadcast(providers), "provider_id")
    shown = F.when(F.col("status") != "ACTIVE", F.date_format("status_effective_date", "yyyy-MM-dd"))
    return named.select("id", "user_id", "service_name", "provider_slug", "status", "plan_name", "price_minor", F.date_format("renewal_date", "yyyy-MM-dd").alias("renewal"), shown.alias("stopped_on"))


def list_of(listed: DataFrame, user_id: int) -> DataFrame:
    """One user's list by service name."""
    return listed.where(F.col("user_id") == user_id).orderBy("service_name", "id")


def best_of_each(subscriptions: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: the one with a plan (2 points) and a price (1 point), the later row at a tie."""
    score = F.col("plan_name").isNotNull().cast("int") * 2 + F.col("price_minor").isNotNull().cast("int")
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("id"))
    return subscriptions.withColumn("score", score).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def transition(subscriptions: DataFrame, changes: DataFrame, today: dt.date) -> DataFrame:
    """Subscriptions after status ``changes`` (id, new_status, on_date); ``changed`` says where the status really moved."""
    joined = subscriptions.join(changes, "id", "left")
    moved = F.col("new_status").isNotNull() & (F.col("new_status") != F.col("status"))
    return joined.select(
        "id", "user_id", F.when(moved, F.col("new_status")).otherwise(F.col("status")).alias("status"),
        F.when(moved, F.coalesce("on_date", F.lit(today))).otherwise(F.col("status_effective_date")).alias("status_effective_date"), moved.alias("changed"),
    )


def transition_history(subscriptions: DataFrame, changes: DataFrame, today: dt.date) -> DataFrame:
    """The history rows that the same changes append."""
    real = subscriptions.join(changes, "id").where("new_status <> status")
    return real.select(F.col("id").alias("subscription_id"), "user_id", F.col("status").alias("previous_status"), "new_status", F.coalesce("on_date", F.lit(today)).alias("effective_date"))


def first_action_status(actions: DataFrame) -> Column:
    """The status that a new action is stored with: one that needs no confirmation waits for its user only where it redirects."""
    return F.when(F.col("requires_confirmation"), "AWAITING_CONFIRMATION").when(F.col("execution") == "PROVIDER_REDIRECT", "AWAITING_USER_ACTION").otherwise("REQUESTED")


def create_actions(requests: DataFrame) -> DataFrame:
    """New actions as they are stored: the requests' columns and ``status``."""
    return requests.withColumn("status", first_action_status(requests))


def _target(action: Column) -> Column:
    return F.when(action == "PAUSE", "PAUSED").when(action == "CANCEL", "CANCELLED").otherwise("ACTIVE")


def confirm(actions: DataFrame) -> DataFrame:
    """Actions after each is confirmed once: only those that are stored as waiting for it move; direct ones complete and set the subscription's status."""
    waits = F.col("status") == "AWAITING_CONFIRMATION"
    direct = waits & (F.col("execution") == "DIRECT")
    after = F.when(direct, "COMPLETED").when(waits, "AWAITING_USER_ACTION").otherwise(F.col("status"))
    return actions.select("id", F.col("status").alias("before"), after.alias("after"), F.when(direct, _target(F.col("action"))).alias("subscription_status"))


def takes_result(actions: DataFrame) -> DataFrame:
    """Actions that a provider's result may still finish: redirected or guided, and stored as waiting."""
    return actions.where(F.col("execution").isin("PROVIDER_REDIRECT", "GUIDED") & F.col("status").isin("AWAITING_CONFIRMATION", "AWAITING_USER_ACTION"))


def provider_result(actions: DataFrame, subscriptions: DataFrame, results: DataFrame, booked: DataFrame | None = None) -> DataFrame:
    """What ``results`` (id, result, on_date), one for each action, do: the action's and the subscription's new state and the saving it books.

    Only redirected or guided actions that are stored as waiting, and whose subscription is their user's, are touched. An action with an estimate among the ``booked`` savings events books no second one. UNCHANGED cancels the action; ACTIVE clears the effective date; a stop with a price above 0 books one estimated month.
    """
    priced = subscriptions.select(F.col("id").alias("subscription_id"), "user_id", "price_minor", F.col("status").alias("status_before"), "status_effective_date")
    joined = takes_result(actions).drop("status").join(results, "id").join(priced, ["subscription_id", "user_id"])
    before = booked.where("kind = 'ESTIMATED'").select(F.col("action_id").alias("id"), F.lit(True).alias("booked")).distinct() if booked is not None else results.limit(0).select("id", F.lit(True).alias("booked"))
    joined = joined.join(before, "id", "left")
    stops = F.col("result").isin("PAUSED", "CANCELLED")
    books = stops & (F.col("price_minor") > 0) & F.col("booked").isNull()
    same = F.col("result") == "UNCHANGED"
    return joined.select(
        "id", "subscription_id", F.when(same, "CANCELLED").otherwise("COMPLETED").alias("action_status"),
        F.when(same, F.col("status_before")).otherwise(F.col("result")).alias("subscription_status"),
        F.when(same, F.col("status_effective_date")).when(stops, F.col("on_date")).alias("status_effective_date"),
        F.when(books, F.col("price_minor")).alias("saving_minor"),
        F.when(books, F.date_sub(F.add_months("on_date", 1), 1)).alias("saving_until"),
    )


def action_log(actions: DataFrame, subscriptions: DataFrame, events: DataFrame) -> DataFrame:
    """What each of ``events`` (event_id, at, action_id, user_id, kind CONFIRM or RESULT, result, on_date) does, in their order by ``at``, event_id, kind, result and on_date: the events with ``accepted``, the action's ``new_status`` and, where it sets them, ``sets_status`` and ``sets_date``.

    An action starts from its stored status. A confirmation is accepted once, while the action waits for it; a result once, while a redirected or guided action waits for either. Both leave the action where no second one is: so of the events of an action at most the first confirmation
    that comes before the first result, and the first result, count, which two minima per action find without gathering its events. Events that share an id count one by one in that order; of equal ones, one is accepted. An event of another user, for no action, or a status-changing result whose subscription is gone does nothing; nor does one of a kind or result that isn't known.
    """
    own = actions.select(F.col("id").alias("action_id"), "user_id", "subscription_id", "action", "execution", "status")
    found = subscriptions.select(F.col("id").alias("subscription_id"), "user_id", F.lit(True).alias("found"))
    open_ones = own.where(F.col("status").isin("AWAITING_CONFIRMATION", "AWAITING_USER_ACTION")).join(found, ["subscription_id", "user_id"], "left")
    joined = events.join(open_ones, ["action_id", "user_id"])
    order = F.struct("at", "event_id", "kind", "result", "on_date")
    confirms = (F.col("kind") == "CONFIRM") & (F.col("status") == "AWAITING_CONFIRMATION")
    known = (F.col("result") == "UNCHANGED") | (F.col("result").isin("ACTIVE", "PAUSED", "CANCELLED") & F.col("found"))
    finishes = (F.col("kind") == "RESULT") & F.col("execution").isin("PROVIDER_REDIRECT", "GUIDED") & known
    first = joined.groupBy("action_id").agg(F.min(F.when(confirms, order)).alias("confirmed"), F.min(F.when(finishes, order)).alias("finished"))
    counted = first.select("action_id", F.when(F.col("finished").isNull() | (F.col("confirmed") < F.col("finished")), F.col("confirmed")).alias("confirmed"), "finished")
    state = own.join(counted, "action_id", "left").withColumnRenamed("user_id", "owner")
    told = events.join(state, "action_id", "left")
    meets = lambda c: F.col(c).isNotNull() & order.eqNullSafe(F.col(c)) & F.col("user_id").eqNullSafe(F.col("owner"))
    told = told.withColumns({"by_confirm": meets("confirmed"), "by_result": meets("finished")})
    equal = Window.partitionBy("action_id", "event_id", "by_confirm", "by_result").orderBy("at")
    told = told.withColumn("nth", F.row_number().over(equal))
    by_confirm, by_result = (F.col(c) & (F.col("nth") == 1) for c in ("by_confirm", "by_result"))
    direct = by_confirm & (F.col("execution") == "DIRECT")
    changes = by_result & (F.col("result") != "UNCHANGED")
    moved = F.when(by_result & (F.col("result") == "UNCHANGED"), "CANCELLED").when(by_result | direct, "COMPLETED").when(by_confirm, "AWAITING_USER_ACTION")
    return told.select(
        *events.columns, "subscription_id", (by_confirm | by_result).alias("accepted"), moved.alias("new_status"),
        F.when(direct, _target(F.col("action"))).when(changes, F.col("result")).alias("sets_status"), F.when(changes & (F.col("result") != "ACTIVE"), F.col("on_date")).alias("sets_date"),
    )


def after_log(actions: DataFrame, subscriptions: DataFrame, log: DataFrame, booked: DataFrame, today: dt.date) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(actions, subscriptions, savings) after an ``action_log``: the same columns with new statuses and dates, and the estimates that it books (action_id, subscription_id, user_id, amount_minor, period_start, period_end).

    Of several actions on a subscription the last accepted one sets its status, and the last accepted result its date. A stop with a price above 0 books a month from its date, or from ``today``; not where the action has an estimate in ``booked``.
    """
    good = log.where("accepted")
    order = F.struct("at", "event_id", "action_id", "kind")
    last = good.groupBy("action_id").agg(F.max_by("new_status", order).alias("new_status"))
    moved = actions.join(last, actions["id"] == last["action_id"], "left").select(*(F.coalesce("new_status", "status").alias(c) if c == "status" else actions[c] for c in actions.columns))
    set_ones = good.where("sets_status is not null")
    result = F.when(F.col("kind") == "RESULT", order)
    effects = set_ones.groupBy("subscription_id", "user_id").agg(F.max_by("sets_status", order).alias("sets_status"), F.max_by("sets_date", result).alias("sets_date"), F.max(result).isNotNull().alias("dated"))
    subs = subscriptions.alias("s").join(effects.withColumnRenamed("subscription_id", "id").alias("e"), ["id", "user_id"], "left")
    new = {"status": F.coalesce("sets_status", F.col("s.status")), "status_effective_date": F.when(F.col("dated"), F.col("sets_date")).otherwise(F.col("s.status_effective_date"))}
    changed = subs.select(*(new.get(c, F.col(c)).alias(c) for c in subscriptions.columns))
    stops = set_ones.where("kind = 'RESULT' and sets_status in ('PAUSED', 'CANCELLED')").join(subscriptions.select(F.col("id").alias("subscription_id"), "user_id", "price_minor").where("price_minor > 0"), ["subscription_id", "user_id"])
    start = F.coalesce("sets_date", F.lit(today))
    estimates = stops.join(booked.where("kind = 'ESTIMATED'").select("action_id"), "action_id", "left_anti")
    return moved, changed, estimates.select("action_id", "subscription_id", "user_id", F.col("price_minor").alias("amount_minor"), start.alias("period_start"), F.date_sub(F.add_months(start, 1), 1).alias("period_end"))


def preview(actions: DataFrame, entitlements: DataFrame) -> DataFrame:
    """What each requested action would come to under its user's plan; no entitlement counts as VIEWER."""
    plan = F.coalesce("plan", F.lit("VIEWER"))
    verdict = F.when(plan == "VIEWER", "REJECTED").when(F.col("execution") == "UNSUPPORTED", "UNSUPPORTED").when((F.col("execution") == "DIRECT") & (plan != "PREMIUM"), "PREMIUM_REQUIRED").otherwise("PREPARED")
    return actions.join(entitlements, "user_id", "left").select("id", "user_id", plan.alias("plan"), verdict.alias("verdict"))


def merge_metadata(old: Column, new: Column) -> Column:
    """Two JSON objects of texts as one; a key of the new one replaces the old one's."""
    maps = [F.coalesce(F.from_json(x, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>")) for x in (old, new)]
    kept = F.map_filter(maps[0], lambda k, _: ~F.array_contains(F.map_keys(maps[1]), k))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, maps[1])))))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with the same key, the rest as it was; both have the same columns. Of new rows with one key the last by ``order`` counts, or one of them without it."""
    if order:
        rank = Window.partitionBy(key).orderBy(F.desc(order))
        last = new.withColumn("nth", F.row_number().over(rank)).where("nth = 1").select(*old.columns)
    else:
        last = new.select(*old.columns).dropDuplicates([key])
    return old.join(last.select(key), key, "left_anti").unionByName(last)


def create_users(users: DataFrame, entitlements: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(users, entitlements, rejected) with new accounts (user_id, email, ...): e-mail in lower case, plan VIEWER; an e-mail that exists, or comes twice, is rejected for all but the first id."""
    lower = new.withColumn("email", F.lower("email"))
    first = lower.groupBy("email").agg(F.min("user_id").alias("user_id")).join(users.select("email"), "email", "left_anti")
    good = lower.join(first, ["email", "user_id"], "left_semi")
    rejected = lower.join(first, ["email", "user_id"], "left_anti").select("user_id", "email", F.lit("EMAIL_EXISTS").alias("error"))
    return users.unionByName(good.select(*users.columns)), entitlements.unionByName(good.select("user_id", F.lit("VIEWER").alias("plan"))), rejected


def user_by_email(users: DataFrame, entitlements: DataFrame, email: str) -> DataFrame:
    """The account with an e-mail, in any case, and its plan."""
    return users.where(F.col("email") == email.lower()).join(entitlements, "user_id", "left").select("user_id", "email", F.coalesce("plan", F.lit("VIEWER")).alias("plan"))


def renewal_noon(renewal: Column) -> Column:
    """Noon of a renewal date, without zone."""
    return F.make_timestamp_ntz(F.year(renewal), F.month(renewal), F.dayofmonth(renewal), F.lit(12), F.lit(0), F.lit(0))


def update_subscriptions(subscriptions: DataFrame, changes: DataFrame, services: DataFrame, providers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(subscriptions, rejected) after ``changes`` (id, user_id, service_name, provider_slug, new_plan, new_price, renewal as text): of the owner's subscription, known services and providers only; an empty date clears it, another becomes noon."""
    known = changes.join(services.select("service_name", F.col("service_id").alias("new_service")), "service_name", "left").join(F.broadcast(providers.select("provider_slug", F.col("provider_id").alias("new_provider"))), "provider_slug", "left")
    owned = known.join(subscriptions.select("id", "user_id", F.lit(True).alias("owned")), ["id", "user_id"], "left")
    good = F.col("new_service").isNotNull() & F.col("new_provider").isNotNull() & F.col("owned").isNotNull()
    rejected = owned.where(~good).select("id", F.lit("SUBSCRIPTION_OR_PROVIDER_NOT_FOUND").alias("error"))
    day = F.to_date(F.nullif("renewal", F.lit("")))
    new = owned.where(good).select("id", "new_service", "new_provider", "new_plan", "new_price", renewal_noon(day).alias("new_renewal"), F.lit(True).alias("changed"))
    both = subscriptions.join(new, "id", "left")
    pick = lambda new_col, old: F.when(F.col("changed"), F.col(new_col)).otherwise(old)
    rows = both.select(
        "id", "user_id", pick("new_service", F.col("service_id")).alias("service_id"), pick("new_provider", F.col("provider_id")).alias("provider_id"), pick("new_plan", F.col("plan_name")).alias("plan_name"),
        pick("new_price", F.col("price_minor")).alias("price_minor"), pick("new_renewal", renewal_noon(F.col("renewal_date"))).alias("renews_at"),
    )
    return rows, rejected


def delete_subscriptions(asked: DataFrame, subscriptions: DataFrame, owned: dict[str, DataFrame], events: DataFrame) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """(subscriptions, dependent tables, savings events) after deleting what users ask for (id, user_id), their own only: rows of ``owned`` tables go with their subscription_id, savings events stay without it."""
    gone = subscriptions.join(asked.select("id", "user_id").distinct(), ["id", "user_id"], "left_semi").select("id")
    by = gone.select(F.col("id").alias("subscription_id"))
    kept = {name: table.join(by, "subscription_id", "left_anti") for name, table in owned.items()}
    marked = events.join(by.withColumn("gone", F.lit(True)), "subscription_id", "left")
    cleared = {"subscription_id": F.when(F.col("gone").isNull(), F.col("subscription_id"))}
    return subscriptions.join(gone, "id", "left_anti"), kept, marked.select(*(cleared.get(c, F.col(c)).alias(c) for c in events.columns))


#: Plans by rank.
RANKS = {"VIEWER": 0, "MANUAL": 1, "PREMIUM": 2}


def at_least(plan: Column, needed: str) -> Column:
    """Whether a plan includes what ``needed`` does; no plan is VIEWER."""
    rank = F.create_map(*(F.lit(x) for kv in RANKS.items() for x in kv))
    return F.coalesce(F.element_at(rank, F.coalesce(plan, F.lit("VIEWER"))), F.lit(0)) >= RANKS[needed]


def valid_purchase(purchases: DataFrame, products: DataFrame, now: dt.datetime) -> DataFrame:
    """Purchases of known products with both transaction ids, not revoked and not expired; with the product's plan."""
    known = purchases.join(F.broadcast(products), "product_id")
    return known.where(F.col("transaction_id").isNotNull() & F.col("original_id").isNotNull() & F.col("revoked_at").isNull() & (F.col("expires_at") > F.lit(now)))


def claim_purchases(events: DataFrame, entitlements: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, entitlements, rejected) after valid purchases (platform, original_id, user_id, plan, ord): a transaction belongs to the user who claimed it first, claiming it again changes nothing but the plan, and
    other users are rejected. A user's last claim by ``ord`` sets the plan."""
    key = ["platform", "original_id"]
    first = new.groupBy(*key).agg(F.min(F.struct("ord", "user_id")).alias("first")).select(*key, F.col("first.user_id").alias("first_user"))
    owner = first.join(events.select(*key, F.col("user_id").alias("old_user")), key, "left").select(*key, F.coalesce("old_user", "first_user").alias("owner"), F.col("old_user").isNull().alias("fresh"))
    judged = new.join(owner, key)
    good = judged.where("user_id = owner")
    added = owner.where("fresh").select(*key, F.col("owner").alias("user_id"))
    rejected = judged.where("user_id <> owner").select("user_id", "original_id", F.lit("PURCHASE_ALREADY_CLAIMED").alias("error"))
    return events.unionByName(added.select(*events.columns)), upsert(entitlements, good.select("user_id", "plan", "ord"), "user_id", "ord"), rejected


# The country of a currency that only one market has.
COUNTRY_OF = {"USD": "US", "NOK": "NO", "SEK": "SE", "DKK": "DK", "CNY": "CN"}


def country_or_currencys(country: Column, currency: Column) -> Column:
    """A row's country, or where it has none that of its currency; null for a currency of several."""
    return F.coalesce(country, F.element_at(F.create_map(*(F.lit(x) for kv in COUNTRY_OF.items() for x in kv)), currency))


def request_deletion(users: DataFrame, asked: DataFrame, cancelled: DataFrame, today: dt.date) -> DataFrame:
    """Users with ``deletion_requested``: today for those who ask and have not asked before, none for those who cancel."""
    marked = users.join(asked.select("user_id", F.lit(True).alias("asks")), "user_id", "left").join(cancelled.select("user_id", F.lit(True).alias("cancels")), "user_id", "left")
    day = F.when(F.col("cancels"), None).when(F.col("asks"), F.coalesce("deletion_requested", F.lit(today))).otherwise(F.col("deletion_requested"))
    return marked.withColumn("deletion_requested", day).drop("asks", "cancels")


def may_sign_in(users: DataFrame) -> DataFrame:
    """(user_id, error): users with a pending deletion may only cancel it."""
    return users.select("user_id", F.when(F.col("deletion_requested").isNotNull(), "ACCOUNT_DELETION_PENDING").alias("error"))


def chat_history(turns: DataFrame, most: int = 10) -> DataFrame:
    """The last ``most`` turns of each conversation, and of those the ones of the user and the assistant that say something."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = turns.withColumn("back", F.row_number().over(back)).where(F.col("back") <= most)
    return last.where(F.col("role").isin("user", "assistant") & (F.btrim("text") != "")).select("conv_id", "turn", "role", F.btrim("text").alias("text"))


def without_scheduled(users: DataFrame, now: dt.date) -> DataFrame:
    """Users whose deletion isn't due: asked for with seven days of grace; the asking date is ``deletion_requested``."""
    return users.where(~F.coalesce(F.date_add("deletion_requested", 7) <= F.lit(now), F.lit(False)))


def add_subscriptions(asked: DataFrame, services: DataFrame, providers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added, rejected): requests by service and provider names; unknown ones are rejected, a missing currency is USD, the status is ACTIVE."""
    known = asked.join(services, "service_name", "left").join(F.broadcast(providers), "provider_slug", "left")
    good = F.col("service_id").isNotNull() & F.col("provider_id").isNotNull()
    added = known.where(good).select("request_id", "service_id", "provider_id", F.lit("ACTIVE").alias("status"), F.coalesce("currency", F.lit("USD")).alias("currency"))
    return added, known.where(~good).select("request_id", F.lit("UNKNOWN_SERVICE_OR_BILLING_PROVIDER").alias("error"))
