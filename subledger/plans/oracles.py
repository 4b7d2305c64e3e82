"""DuckDB SQL for the same results, written independently of the operators: projections of the driver's tables as CTEs, then one statement a query."""

from __future__ import annotations

import re

from subledger.functions import questions as Q
from subledger.plans.queries import ASKED, FINDABLE, NAMES_ASKED, SAMPLES, SERVICES

TABLES = {
    "history": """SELECT event_id AS id, user_id AS subscription_id, CASE event_type WHEN 'error' THEN 'PAUSED' WHEN 'click' THEN 'CANCELLED' ELSE 'ACTIVE' END AS new_status,
        CAST(ts AS DATE) AS effective_date, ts AS recorded_at FROM events WHERE event_type <> 'view'""",
    "prices": "SELECT DISTINCT user_id AS subscription_id, CASE WHEN user_id % 17 <> 0 THEN 500 + user_id % 40 * 50 END AS price_minor FROM events",
    "users": """SELECT c_custkey AS user_id, lower(c_name || '@example.org') AS email, n_name AS country, (['USD','EUR','NOK','GBP','SEK'])[n_regionkey % 5 + 1] AS currency,
        (['Europe/Oslo','America/New_York','Asia/Tokyo','','UTC'])[c_custkey % 5 + 1] AS timezone FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "subs": """SELECT o_orderkey AS id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'CANCELLED' WHEN 'P' THEN 'PAUSED' ELSE 'ACTIVE' END AS status, CAST(o_orderdate AS DATE) AS renewal_date,
        CASE WHEN o_orderstatus IN ('F','P') THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 41 - 20 AS INTEGER) END AS status_effective_date,
        CASE WHEN o_orderkey % 11 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS price_minor, CASE WHEN o_orderkey % 7 <> 0 THEN 'Plan ' || (o_orderkey % 3) END AS plan_name,
        o_orderkey % 150 + 1 AS service_id, CAST(o_orderkey % 5 AS INTEGER) AS provider_id FROM orders""",
    "effective": """SELECT *, CASE WHEN status IN ('PAUSED','CANCELLED') AND status_effective_date > DATE '1998-07-01' THEN 'ACTIVE' ELSE status END AS effective FROM subs""",
    "services": "SELECT p_partkey AS service_id, p_name || ' ' || p_partkey AS service_name, p_brand AS category, CAST(floor(p_retailprice * 100) AS BIGINT) AS catalog_minor FROM part",
    "providers": "SELECT r_regionkey AS provider_id, lower(r_name) AS provider_slug FROM region",
    "saves": """SELECT event_id AS id, user_id, user_id AS subscription_id, CASE WHEN event_id % 13 <> 0 THEN event_id // 2 END AS action_id, CAST(floor(value * 100) AS BIGINT) AS amount_minor,
        (['NOK','EUR','USD'])[user_id % 3 + 1] AS currency, CASE event_type WHEN 'purchase' THEN 'VERIFIED' ELSE 'ESTIMATED' END AS kind, CAST(ts AS DATE) AS period_start,
        CAST(CAST(ts AS DATE) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS period_end, ts AS created_at FROM events WHERE event_type IN ('purchase','click')""",
    "cands": """SELECT l_partkey AS service, l_returnflag AS plan, l_linestatus AS route, (['NO','SE','DE'])[(l_suppkey + l_partkey) % 3 + 1] AS country,
        CASE WHEN l_orderkey % 13 = 0 THEN 'USD' ELSE (['NOK','SEK','EUR'])[(l_suppkey + l_partkey) % 3 + 1] END AS currency, CAST(CAST(l_quantity AS INTEGER) % 4 AS BIGINT) AS price_minor, CASE WHEN l_orderkey % 11 = 0 THEN 'range' ELSE 'exact' END AS price_type,
        (['structured','registry','api','help','store','page'])[(l_suppkey + l_linenumber) % 6 + 1] AS kind, ([110,100,90,80,75,70])[(l_suppkey + l_linenumber) % 6 + 1] AS priority,
        l_orderkey AS ord, l_linenumber AS line, CAST(l_shipdate AS DATE) AS seen_at FROM lineitem""",
    "good": "SELECT * FROM cands WHERE price_minor > 0 AND price_type = 'exact' AND (country, currency) IN (('NO','NOK'), ('SE','SEK'), ('DE','EUR'))",
    "votes": """SELECT service, plan, route, country, currency, price_minor, max(priority) AS top, count(DISTINCT kind) AS nk, count(DISTINCT CASE WHEN kind <> 'registry' THEN kind END) AS lk,
        max(CASE WHEN kind = 'structured' THEN 1 ELSE 0 END) AS st, max(CASE WHEN kind = 'registry' THEN 1 ELSE 0 END) AS rg FROM good GROUP BY ALL""",
    "pairs": "SELECT v.*, w.price_minor AS other, w.lk AS other_lk, w.top AS other_top FROM votes v JOIN votes w USING (service, plan, route, country, currency)",
    "won": """SELECT service, plan, route, country, currency, price_minor, any_value(nk) AS nk, any_value(st) AS st, any_value(rg) AS rg FROM pairs GROUP BY ALL
        HAVING (any_value(lk) >= 2 AND count(*) FILTER (other_lk >= 2) = 1) OR (count(*) FILTER (other_lk >= 2) = 0 AND count(*) FILTER (other <> price_minor AND other_top >= top) = 0)""",
    "resolved": """SELECT service, plan, route, country, currency, price_minor, arg_max(c.kind, (c.priority, -c.ord, -c.line)) AS kind, arg_max(c.ord, (c.priority, -c.ord, -c.line)) AS ord,
        CASE WHEN any_value(st) = 1 THEN 'authoritative-provider' WHEN any_value(rg) = 1 THEN 'registry' WHEN any_value(nk) >= 2 THEN 'multi-source' ELSE 'single-source' END AS verification,
        CAST(any_value(nk) AS BIGINT) AS source_count, any_value(st) = 0 AND any_value(nk) >= 2 AS by_agreement
        FROM won JOIN good c USING (service, plan, route, country, currency, price_minor) GROUP BY service, plan, route, country, currency, price_minor""",
    "stored": "SELECT service, plan, route, country, currency, max(price_minor) AS price_minor, min(seen_at) AS verified_on, max(seen_at) AS checked_on FROM good WHERE service % 3 <> 0 GROUP BY ALL",
    "current": "SELECT subscription_id, CASE WHEN subscription_id % 7 = 3 THEN subscription_id + 1 ELSE subscription_id END AS user_id, new_status, effective_date FROM history QUALIFY row_number() OVER (PARTITION BY subscription_id ORDER BY recorded_at DESC, id DESC) = 1",
    "verified": """SELECT action_id, e.user_id, e.subscription_id, amount_minor, currency, 'VERIFIED' AS kind, period_start, period_end FROM saves e JOIN current c USING (subscription_id, user_id)
        WHERE kind = 'ESTIMATED' AND action_id IS NOT NULL AND period_end < DATE '2024-03-05' AND c.new_status IN ('PAUSED','CANCELLED') AND c.effective_date <= period_start
          AND NOT EXISTS (SELECT 1 FROM saves v WHERE v.action_id = e.action_id AND v.kind = 'VERIFIED') QUALIFY row_number() OVER (PARTITION BY action_id ORDER BY e.id) = 1""",
    "jobs": """SELECT id * 2 + (ch = 'EMAIL')::INT AS id, id AS subscription_id, user_id, ch AS channel, destination, scheduled_for, CASE WHEN id % 10 = 4 THEN TIMESTAMP '1998-07-01' END AS sent_at, CASE WHEN id % 10 = 7 THEN TIMESTAMP '1998-07-01' END AS failed_at
        FROM (SELECT id, user_id, 'PUSH' AS ch, destination, scheduled_for FROM due JOIN ends USING (user_id) UNION ALL SELECT id, user_id, 'EMAIL', email, scheduled_for FROM due WHERE coalesce(email_enabled, true))""",
    "sent": "SELECT id, CASE WHEN id % 5 = 0 THEN 'RATE_LIMIT' WHEN id % 7 = 0 THEN 'GONE' END AS error FROM jobs WHERE id % 3 <> 1",
    "tokens": "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 5 = 0 THEN 'Token[' WHEN c_custkey % 4 = 0 THEN 'ExponentPushToken[' ELSE 'ExpoPushToken[' END || c_custkey || ']' AS destination FROM customer WHERE c_custkey % 2 = 0",
    "newcomers": "SELECT user_id + 1000000 AS user_id, lower(CASE WHEN user_id % 2 = 0 THEN email ELSE 'New' || (user_id % 50) || '@Example.org' END) AS email FROM users WHERE user_id % 3 = 1",
    "accepted": "SELECT min(user_id) AS user_id, email FROM newcomers WHERE email NOT IN (SELECT email FROM users) GROUP BY email",
    "edits": """SELECT id, CASE WHEN id % 10 = 1 THEN user_id + 1 ELSE user_id END AS user_id, CASE WHEN id % 7 = 2 THEN NULL ELSE service_id END AS new_service, CASE id % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 END AS new_provider,
        CASE WHEN id % 4 <> 0 THEN id % 1000 END AS new_price, CASE WHEN id % 5 <> 0 THEN renewal_date END AS new_renewal FROM subs JOIN services USING (service_id) WHERE id % 3 = 0""",
    "applied": "SELECT e.* FROM edits e JOIN subs s ON s.id = e.id AND s.user_id = e.user_id WHERE e.new_service IS NOT NULL AND e.new_provider IS NOT NULL",
    "gone": "SELECT id FROM subs WHERE id % 6 = 1 AND id % 4 <> 3",
    "buys": """SELECT o_orderkey AS ord, o_custkey AS user_id, (['IOS','ANDROID'])[o_orderkey % 2 + 1] AS platform, (['MANUAL','PREMIUM',NULL])[o_orderkey % 3 + 1] AS plan, 't' || (o_orderkey % 5000) AS original_id FROM orders
        WHERE o_orderkey % 3 <> 2 AND o_orderkey % 31 <> 0 AND o_orderkey % 37 <> 0 AND o_orderkey % 17 <> 0 AND CAST(o_orderdate AS DATE) + 31 > DATE '1998-07-01'""",
    "claimed": "SELECT DISTINCT (['IOS','ANDROID'])[o_orderkey % 2 + 1] AS platform, 't' || (o_orderkey % 5000) AS original_id, CAST(1 AS BIGINT) AS user_id FROM orders WHERE o_orderkey % 400 = 0",
    "owners": "SELECT platform, original_id, coalesce(any_value(c.user_id), arg_min(b.user_id, (b.ord, b.user_id))) AS owner, any_value(c.user_id) IS NULL AS fresh FROM buys b LEFT JOIN claimed c USING (platform, original_id) GROUP BY 1, 2",
    "contexts": """SELECT o_orderkey AS id, (['netflix','hulu','youku','apple-music','paramount-plus','prime-video','amazon-prime','amazon-music-unlimited','disney-plus','unknown'])[o_orderkey % 10 + 1] AS service,
        (['apple','Google','carrier-tv','amazon','direct','google-play',' DIRECT '])[o_orderkey // 3 % 7 + 1] AS provider, (['PAUSE','CANCEL','REACTIVATE','MANAGE'])[o_orderkey // 7 % 4 + 1] AS action, (['NO','US','gb'])[o_orderkey // 11 % 3 + 1] AS country FROM orders""",
    "billed": "SELECT *, CASE lower(trim(provider)) WHEN 'google' THEN 'google-play' WHEN 'carrier-tv' THEN 'carrier' ELSE lower(trim(provider)) END AS billing FROM contexts",
    "placed": """SELECT id, (['NOK','USD','EUR','DKK'])[id % 4 + 1] AS currency, coalesce(CASE WHEN id % 3 = 0 THEN (['NO','DE','US'])[id % 3 + 1] END, CASE id % 4 WHEN 0 THEN 'NO' WHEN 1 THEN 'US' WHEN 3 THEN 'DK' END) AS country FROM subs""",
    "priced": "SELECT page_id, html, page_id % 90 + 10 AS low, CASE WHEN page_id % 7 = 3 THEN 'usd' ELSE 'kr' END AS mark, page_id % 60 + 120 AS high FROM pages",
    "prefs": """SELECT c_custkey AS user_id, c_custkey % 6 <> 1 AS renewal_reminders, CASE WHEN c_custkey % 10 <> 3 THEN c_custkey % 9 <> 2 END AS email_enabled FROM customer WHERE c_custkey % 4 <> 0""",
    "ends": "SELECT c_custkey AS user_id, 'ExpoPushToken[' || c_custkey || ']' AS destination, c_custkey % 7 <> 0 AS enabled FROM customer WHERE c_custkey % 3 <> 0",
    "acts": """SELECT o_orderkey AS id, o_orderkey AS subscription_id, o_custkey AS user_id, (['PAUSE','CANCEL','REACTIVATE'])[o_orderkey % 3 + 1] AS action,
        (['DIRECT','PROVIDER_REDIRECT','GUIDED','UNSUPPORTED'])[o_orderkey % 4 + 1] AS execution, o_orderkey % 5 = 0 AS requires_confirmation, CASE WHEN o_orderkey % 2 = 0 THEN 'https://example.org/' || o_orderkey END AS redirect_url,
        CASE WHEN o_orderkey % 11 = 3 THEN 'COMPLETED' WHEN o_orderkey % 11 = 7 THEN 'CANCELLED' WHEN o_orderkey % 5 = 0 THEN 'AWAITING_CONFIRMATION' WHEN o_orderkey % 4 = 1 THEN 'AWAITING_USER_ACTION' ELSE 'REQUESTED' END AS status, o_orderdate AS requested_at FROM orders""",
    "due": """SELECT s.*, u.email, u.timezone, p.renewal_reminders, p.email_enabled,
        timezone('UTC', timezone(CASE WHEN trim(u.timezone) = '' THEN 'UTC' ELSE u.timezone END, CAST(s.renewal_date - 3 AS TIMESTAMP) + INTERVAL 9 HOUR)) AS scheduled_for
        FROM subs s JOIN users u USING (user_id) LEFT JOIN prefs p USING (user_id)
        WHERE s.renewal_date >= DATE '1998-07-01' AND s.renewal_date < DATE '1998-07-31' AND (s.status = 'ACTIVE' OR (s.status IN ('PAUSED','CANCELLED') AND s.status_effective_date > s.renewal_date)) AND coalesce(p.renewal_reminders, true)""",
    "changes": "SELECT id, (['PAUSED','CANCELLED','ACTIVE'])[id % 3 + 1] AS new_status, CASE WHEN id % 2 = 0 THEN DATE '1998-08-15' END AS on_date FROM subs WHERE id % 4 <> 3",
    "results": "SELECT id, (['PAUSED','CANCELLED','ACTIVE','UNCHANGED'])[id % 4 + 1] AS result, CAST(requested_at AS DATE) AS on_date FROM acts WHERE id % 3 <> 1",
    "ents": "SELECT user_id, (['VIEWER','MANUAL','PREMIUM'])[user_id % 3 + 1] AS plan FROM users WHERE user_id % 4 <> 0",
    "ranked": "SELECT user_id, id, price_minor, row_number() OVER (PARTITION BY user_id ORDER BY price_minor DESC, id) AS rank FROM effective WHERE effective = 'ACTIVE' AND price_minor > 0",
    "spend": """SELECT user_id, count(*) FILTER (effective = 'ACTIVE') AS n_active, CAST(coalesce(sum(price_minor) FILTER (effective = 'ACTIVE'), 0) AS BIGINT) AS monthly_minor FROM effective GROUP BY user_id""",
    "issues": """SELECT id, user_id, list_filter([CASE WHEN renewal_date IS NULL THEN 'renewal date' END, CASE WHEN effective = 'ACTIVE' AND renewal_date < DATE '1998-07-01' THEN 'updated renewal date' END,
        CASE WHEN provider_id IS NULL THEN 'billing route' END, CASE WHEN price_minor IS NULL THEN 'price' END, CASE WHEN plan_name IS NULL THEN 'plan' END], lambda x: x IS NOT NULL) AS found FROM effective""",
    "upcoming": "SELECT user_id, id, renewal_date, row_number() OVER (PARTITION BY user_id ORDER BY renewal_date, id) AS n, count(*) OVER (PARTITION BY user_id) AS n_upcoming FROM effective WHERE effective = 'ACTIVE' AND renewal_date >= DATE '1998-07-01'",
    "turns": "SELECT conv_id, turn, text, trim(regexp_replace(regexp_replace(replace(lower(text), '+', ' plus '), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS norm FROM conversations WHERE role = 'user'",
    "events_in_turn": """SELECT ((l_orderkey * 20000 + (CAST(l_shipdate AS DATE) - DATE '1970-01-01')) * 8 + l_linenumber) * 64 + CAST(l_quantity AS BIGINT) AS event_id, CAST(l_shipdate AS DATE) AS day, l_orderkey AS action_id, CASE WHEN l_quantity > 45 THEN o_custkey + 1 ELSE o_custkey END AS user_id, (l_orderkey + l_linenumber) % 3 = 0 AS confirms,
        CASE WHEN l_linenumber = 4 THEN 'UNCHANGED' WHEN l_returnflag = 'A' THEN 'PAUSED' WHEN l_returnflag = 'R' THEN 'CANCELLED' WHEN l_linenumber = 5 THEN 'LATER' ELSE 'ACTIVE' END AS result, CASE WHEN l_linenumber <> 2 THEN CAST(l_shipdate AS DATE) + 10 END AS on_date,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_shipdate AS DATE), l_linenumber, l_quantity) AS nth FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    # An action's events one after the other: each step reads the status that the step before has left.
    "steps": """SELECT id, CAST(0 AS BIGINT) AS nth, CAST(NULL AS BIGINT) AS event_id, status, false AS accepted, CAST(NULL AS VARCHAR) AS sets_status, CAST(NULL AS DATE) AS sets_date, CAST(NULL AS DATE) AS day FROM acts
        UNION ALL SELECT id, nth, event_id, CASE WHEN c THEN CASE WHEN execution = 'DIRECT' THEN 'COMPLETED' ELSE 'AWAITING_USER_ACTION' END WHEN r THEN CASE WHEN result = 'UNCHANGED' THEN 'CANCELLED' ELSE 'COMPLETED' END ELSE status END, c OR r,
        CASE WHEN c AND execution = 'DIRECT' THEN CASE action WHEN 'PAUSE' THEN 'PAUSED' WHEN 'CANCEL' THEN 'CANCELLED' ELSE 'ACTIVE' END WHEN r AND result <> 'UNCHANGED' THEN result END, CASE WHEN r AND result IN ('PAUSED','CANCELLED') THEN on_date END, day
        FROM (SELECT s.id, e.nth, e.event_id, s.status, e.result, e.on_date, e.day, a.execution, a.action, e.confirms AND a.user_id = e.user_id AND s.status = 'AWAITING_CONFIRMATION' AS c,
            NOT e.confirms AND a.user_id = e.user_id AND a.execution IN ('PROVIDER_REDIRECT','GUIDED') AND s.status LIKE 'AWAITING%' AND e.result <> 'LATER' AS r FROM steps s JOIN events_in_turn e ON e.action_id = s.id AND e.nth = s.nth + 1 JOIN acts a ON a.id = s.id)""",
}
#: Which CTEs a CTE reads.
NEEDS = {
    "effective": ["subs"], "good": ["cands"], "votes": ["good"], "pairs": ["votes"], "won": ["pairs"], "resolved": ["won", "good"], "stored": ["good"], "due": ["subs", "users", "prefs"], "changes": ["subs"], "results": ["acts"], "ents": ["users"],
    "ranked": ["effective"], "spend": ["effective"], "issues": ["effective"], "upcoming": ["effective"], "current": ["history"], "verified": ["saves", "current"], "jobs": ["due", "ends"], "sent": ["jobs"], "newcomers": ["users"], "accepted": ["newcomers", "users"],
    "edits": ["subs", "services"], "applied": ["edits", "subs"], "gone": ["subs"], "owners": ["buys", "claimed"], "billed": ["contexts"], "placed": ["subs"], "steps": ["events_in_turn", "acts"],
}


def sql(tables: str, body: str) -> str:
    """``body`` over the named CTEs and those that they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, ()):
            add(other)
        if name not in order:
            order.append(name)

    for name in tables.split():
        add(name)
    return ("WITH RECURSIVE " if "steps" in order else "WITH ") + ",\n".join(f"{n} AS ({TABLES[n]})" for n in order) + "\n" + body


INTERVALS = """ivals AS (SELECT h.id, h.subscription_id, h.new_status, h.effective_date, (SELECT min(a.effective_date) FROM history a WHERE a.subscription_id = h.subscription_id AND a.new_status = 'ACTIVE' AND a.effective_date > h.effective_date) AS until FROM history h WHERE h.new_status IN ('PAUSED','CANCELLED')),
  counted AS (SELECT i.*, CAST(greatest(0, coalesce(until, DATE '2024-01-31') - effective_date) AS BIGINT) AS days FROM ivals i),
  saved AS (SELECT c.*, coalesce(CAST(round(price_minor * days / 30.436875) AS BIGINT), 0) AS saved_minor FROM counted c LEFT JOIN prices USING (subscription_id))"""

RENEWS = "renewal_date IS NOT NULL AND (status = 'ACTIVE' OR coalesce(status IN ('PAUSED','CANCELLED') AND status_effective_date > renewal_date, false))"



def shown(name: str, values: str, times: int = 1) -> str:
    """A CTE of the pages with the query's sample in them, which the SQL then reads by expressions of its own."""
    sample = SAMPLES[name].replace("'", "''") * times
    return f", shown AS (SELECT page_id, html || printf('{sample}', {values}) AS html FROM priced)"


ORACLES: dict[str, str] = {
    "saved_so_far": sql("history prices", "").rstrip() + ",\n" + INTERVALS + "\nSELECT h.subscription_id, CAST(coalesce(sum(s.saved_minor), 0) AS BIGINT) AS saved_minor FROM (SELECT DISTINCT subscription_id FROM history) h LEFT JOIN saved s USING (subscription_id) GROUP BY 1",
    "saved_so_far_intervals": sql("history prices", "").rstrip() + ",\n" + INTERVALS + "\nSELECT id, subscription_id, new_status, effective_date, until, days, saved_minor FROM saved",
    "savings_summary": sql("saves", """, one AS (SELECT DISTINCT ON (user_id, coalesce('a' || action_id, 'e' || id)) * FROM saves ORDER BY user_id, coalesce('a' || action_id, 'e' || id), kind = 'VERIFIED' DESC, created_at DESC, id DESC)
        SELECT user_id, currency, CAST(sum(CASE WHEN kind = 'VERIFIED' THEN amount_minor ELSE 0 END) AS BIGINT) AS verified_minor, CAST(sum(CASE WHEN kind = 'ESTIMATED' THEN amount_minor ELSE 0 END) AS BIGINT) AS estimated_minor, count(*) AS n_actions FROM one GROUP BY 1, 2"""),
    "savings_ledger": sql("saves subs services", "SELECT e.id, e.user_id, e.kind, e.amount_minor, e.currency, e.period_start, e.period_end, v.service_name, s.plan_name FROM saves e LEFT JOIN subs s ON s.id = e.subscription_id LEFT JOIN services v USING (service_id)"),
    "savings_estimate": sql("acts subs", """SELECT a.id AS action_id, a.user_id, a.subscription_id, s.price_minor AS amount_minor, s.status_effective_date AS period_start, CAST(s.status_effective_date + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS period_end
        FROM acts a JOIN subs s ON s.id = a.subscription_id WHERE a.action IN ('PAUSE','CANCEL') AND s.price_minor > 0 AND s.status_effective_date IS NOT NULL"""),
    "savings_verify": sql("verified", "SELECT * FROM verified"),
    "subscription_list": sql("subs services providers", """SELECT s.id, s.user_id, v.service_name, p.provider_slug, s.status, s.plan_name, s.price_minor, strftime(renewal_date, '%Y-%m-%d') AS renewal, CASE WHEN status <> 'ACTIVE' THEN strftime(status_effective_date, '%Y-%m-%d') END AS stopped_on
        FROM subs s JOIN services v USING (service_id) JOIN providers p USING (provider_id)"""),
    "subscription_dedupe": sql("subs", "SELECT user_id, service_id, provider_id, id, status, plan_name, price_minor, CAST((plan_name IS NOT NULL)::INT * 2 + (price_minor IS NOT NULL)::INT AS INTEGER) AS score FROM subs QUALIFY row_number() OVER (PARTITION BY user_id, service_id, provider_id ORDER BY score DESC, id DESC) = 1"),
    "effective_status": sql("effective", "SELECT id, status, status_effective_date, effective FROM effective"),
    "will_renew": sql("subs", f"SELECT id, {RENEWS} AS renews FROM subs"),
    "renewal_refresh": sql("effective", "SELECT id, user_id, renewal_date FROM effective WHERE effective = 'ACTIVE' AND renewal_date < DATE '1998-07-01'"),
    "status_transition": sql("subs changes", """SELECT s.id, s.user_id, CASE WHEN c.new_status <> s.status THEN c.new_status ELSE s.status END AS status, CASE WHEN c.new_status <> s.status THEN coalesce(c.on_date, DATE '1998-07-01') ELSE s.status_effective_date END AS status_effective_date,
        coalesce(c.new_status <> s.status, false) AS changed FROM subs s LEFT JOIN changes c USING (id)"""),
    "status_history_append": sql("subs changes", "SELECT s.id AS subscription_id, s.user_id, s.status AS previous_status, c.new_status, coalesce(c.on_date, DATE '1998-07-01') AS effective_date FROM subs s JOIN changes c USING (id) WHERE c.new_status <> s.status"),
    "action_status": sql("acts", """SELECT id, status AS before, CASE WHEN status <> 'AWAITING_CONFIRMATION' THEN status WHEN execution = 'DIRECT' THEN 'COMPLETED' ELSE 'AWAITING_USER_ACTION' END AS after,
        CASE WHEN status = 'AWAITING_CONFIRMATION' AND execution = 'DIRECT' THEN CASE action WHEN 'PAUSE' THEN 'PAUSED' WHEN 'CANCEL' THEN 'CANCELLED' ELSE 'ACTIVE' END END AS subscription_status FROM acts"""),
    "action_create": sql("acts", "SELECT id, execution, requires_confirmation, CASE WHEN requires_confirmation THEN 'AWAITING_CONFIRMATION' WHEN execution = 'PROVIDER_REDIRECT' THEN 'AWAITING_USER_ACTION' ELSE 'REQUESTED' END AS status FROM acts"),
    "action_log": sql("steps", "SELECT event_id, id AS action_id, accepted, CASE WHEN accepted THEN status END AS new_status, sets_status, sets_date FROM steps WHERE nth > 0"),
    "action_log_actions": sql("steps", "SELECT id, arg_max(status, nth) AS status FROM steps GROUP BY id"),
    "action_log_subscriptions": sql("steps subs", "SELECT s.id, coalesce(t.sets_status, s.status) AS status, CASE WHEN t.id IS NULL OR a.execution = 'DIRECT' THEN s.status_effective_date ELSE t.sets_date END AS status_effective_date FROM subs s LEFT JOIN (SELECT * FROM steps WHERE sets_status IS NOT NULL) t ON t.id = s.id LEFT JOIN acts a ON a.id = s.id"),
    "action_log_savings": sql("steps subs", """SELECT s.id AS action_id, s.id AS subscription_id, s.user_id, s.price_minor AS amount_minor, coalesce(sets_date, DATE '1998-07-01') AS period_start, CAST(coalesce(sets_date, DATE '1998-07-01') + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS period_end
        FROM steps t JOIN acts a USING (id) JOIN subs s ON s.id = t.id WHERE sets_status IN ('PAUSED','CANCELLED') AND a.execution <> 'DIRECT' AND s.price_minor > 0 AND (s.id % 6 <> 0 OR s.id % 4 = 2)"""),
    "action_preview": sql("acts ents", """SELECT a.id, a.user_id, coalesce(e.plan, 'VIEWER') AS plan, CASE WHEN coalesce(e.plan, 'VIEWER') = 'VIEWER' THEN 'REJECTED' WHEN execution = 'UNSUPPORTED' THEN 'UNSUPPORTED' WHEN execution = 'DIRECT' AND e.plan <> 'PREMIUM' THEN 'PREMIUM_REQUIRED' ELSE 'PREPARED' END AS verdict
        FROM acts a LEFT JOIN ents e USING (user_id)"""),
    "provider_result": sql("acts subs results", """SELECT a.id, a.subscription_id, CASE WHEN result = 'UNCHANGED' THEN 'CANCELLED' ELSE 'COMPLETED' END AS action_status, CASE WHEN result = 'UNCHANGED' THEN s.status ELSE result END AS subscription_status,
        CASE WHEN result = 'UNCHANGED' THEN s.status_effective_date WHEN result <> 'ACTIVE' THEN on_date END AS status_effective_date, CASE WHEN result IN ('PAUSED','CANCELLED') AND price_minor > 0 AND (a.id % 6 <> 0 OR a.id % 4 = 2) THEN price_minor END AS saving_minor,
        CASE WHEN result IN ('PAUSED','CANCELLED') AND price_minor > 0 AND (a.id % 6 <> 0 OR a.id % 4 = 2) THEN CAST(on_date + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) END AS saving_until
        FROM acts a JOIN results r USING (id) JOIN subs s ON s.id = a.subscription_id WHERE execution IN ('PROVIDER_REDIRECT','GUIDED') AND a.status IN ('AWAITING_CONFIRMATION','AWAITING_USER_ACTION') AND a.id % 23 <> 5"""),
    "recent_actions_top100": sql("acts", "SELECT id, user_id, action, requested_at FROM acts ORDER BY requested_at DESC, id DESC LIMIT 100"),
    "entitlement_upsert": sql("ents users", "SELECT user_id, plan FROM ents WHERE user_id % 5 <> 0 UNION ALL SELECT user_id, 'PREMIUM' FROM users WHERE user_id % 5 = 0"),
    "account_purge": sql("users", "SELECT user_id, email FROM users WHERE NOT (user_id % 3 = 0 AND DATE '1998-06-15' + CAST(user_id % 30 AS INTEGER) + 7 <= DATE '1998-07-01')"),
    "subscription_add": sql("services providers", """, asked AS (SELECT c_custkey AS request_id, 'wanted' AS x, CASE WHEN c_custkey % 4 = 0 THEN 'no such service' ELSE (SELECT service_name FROM services WHERE service_id = c_custkey % 150 + 1) END AS service_name,
        CASE WHEN c_custkey % 9 = 0 THEN 'nobody' ELSE 'asia' END AS provider_slug, CASE WHEN c_custkey % 2 = 0 THEN 'NOK' END AS currency FROM customer)
        SELECT request_id, service_id, provider_id, 'ACTIVE' AS status, coalesce(currency, 'USD') AS currency FROM asked JOIN services USING (service_name) JOIN providers USING (provider_slug)"""),
    "reminder_instant": sql("due", "SELECT id, timezone, renewal_date, scheduled_for FROM due"),
    "reminder_queue_push": sql("due ends", """SELECT d.id AS subscription_id, d.user_id, e.destination, d.scheduled_for, '{"renewal":"' || strftime(renewal_date, '%b %d') || '","price":' || coalesce(CAST(price_minor AS VARCHAR), 'null') || '}' AS payload FROM due d JOIN ends e USING (user_id) WHERE e.enabled"""),
    "reminder_queue_email": sql("due", "SELECT id AS subscription_id, user_id, email AS destination, scheduled_for FROM due WHERE coalesce(email_enabled, true)"),
    "reminder_purge": sql("subs users prefs", """, jobs AS (SELECT id AS subscription_id, user_id, CASE WHEN id % 8 <> 0 THEN timezone('UTC', timezone(CASE WHEN trim(timezone) = '' THEN 'UTC' ELSE timezone END, CAST(renewal_date - 3 AS TIMESTAMP) + INTERVAL 9 HOUR)) + CASE WHEN id % 5 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END END AS scheduled_for FROM subs JOIN users USING (user_id) WHERE id % 3 = 0)
        SELECT j.* FROM jobs j JOIN subs s ON s.id = j.subscription_id JOIN users u ON u.user_id = j.user_id LEFT JOIN prefs p ON p.user_id = j.user_id
        WHERE NOT coalesce(NOT (s.status = 'ACTIVE' OR (s.status IN ('PAUSED','CANCELLED') AND s.status_effective_date > s.renewal_date)), false) AND coalesce(p.renewal_reminders, true)
          AND NOT coalesce(j.scheduled_for <> timezone('UTC', timezone(CASE WHEN trim(u.timezone) = '' THEN 'UTC' ELSE u.timezone END, CAST(s.renewal_date - 3 AS TIMESTAMP) + INTERVAL 9 HOUR)), false)"""),
    "reminder_due_top100": sql("jobs subs prefs", """SELECT j.id, j.subscription_id, j.channel, j.destination, j.scheduled_for FROM jobs j JOIN subs s ON s.id = j.subscription_id LEFT JOIN prefs p ON p.user_id = j.user_id
        WHERE sent_at IS NULL AND failed_at IS NULL AND scheduled_for <= TIMESTAMP '1998-07-20' AND (CASE WHEN s.id % 9 = 0 THEN 'CANCELLED' ELSE s.status END = 'ACTIVE' OR s.status_effective_date > s.renewal_date) AND coalesce(p.renewal_reminders, true)
          AND ((j.channel = 'EMAIL' AND coalesce(p.email_enabled, true)) OR (j.channel = 'PUSH' AND EXISTS (SELECT 1 FROM ends e WHERE e.user_id = j.user_id AND e.destination = j.destination AND e.enabled))) ORDER BY j.scheduled_for, j.subscription_id, j.destination LIMIT 100"""),
    "preference_upsert": sql("prefs users", """, ch AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN user_id % 3 = 0 END AS renewal_reminders, CASE WHEN user_id % 3 = 0 THEN false END AS email_enabled FROM users WHERE user_id % 5 < 3)
        SELECT user_id, CASE WHEN c.user_id IS NULL THEN p.renewal_reminders ELSE coalesce(c.renewal_reminders, p.renewal_reminders, true) END AS renewal_reminders, CASE WHEN c.user_id IS NULL THEN p.email_enabled ELSE coalesce(c.email_enabled, p.email_enabled, true) END AS email_enabled FROM prefs p FULL JOIN ch c USING (user_id)"""),
    "price_resolve": sql("resolved", "SELECT * FROM resolved"),
    "price_conflicts": sql("votes won", "SELECT service, plan, route, country, currency, count(*) AS n_prices FROM votes v WHERE NOT EXISTS (SELECT 1 FROM won w WHERE w.service = v.service AND w.plan = v.plan AND w.route = v.route AND w.country = v.country AND w.currency = v.currency) GROUP BY ALL"),
    "price_merge": sql("resolved stored", """SELECT service, plan, route, country, currency, CASE WHEN strong OR s.price_minor IS NULL THEN f.price_minor ELSE s.price_minor END AS price_minor, CASE WHEN strong OR s.price_minor IS NULL THEN 'fresh' ELSE 'stored' END AS origin
        FROM (SELECT *, verification = 'authoritative-provider' OR (verification = 'multi-source' AND by_agreement AND source_count >= 2) AS strong FROM resolved) f FULL JOIN stored s USING (service, plan, route, country, currency)"""),
    "price_upsert": sql("resolved stored", """SELECT service, plan, route, country, currency, coalesce(f.price_minor, s.price_minor) AS price_minor, CASE WHEN f.price_minor IS NOT NULL AND f.price_minor IS DISTINCT FROM s.price_minor THEN DATE '1999-01-01' ELSE verified_on END AS verified_on,
        CASE WHEN f.price_minor IS NOT NULL THEN DATE '1999-01-01' ELSE checked_on END AS checked_on
        FROM stored s FULL JOIN (SELECT * FROM resolved WHERE verification = 'authoritative-provider' OR (verification = 'multi-source' AND by_agreement AND source_count >= 2)) f USING (service, plan, route, country, currency)"""),
    "price_snapshot": sql("cands", """, f AS (SELECT service, country, kind, min((ord, line)) AS firsts, max(seen_at) AS seen, count(*) AS n FROM cands GROUP BY ALL)
        SELECT service, country, CAST(sum(n) AS BIGINT) AS n, max(seen) AS updated_at, string_agg(kind, ', ' ORDER BY firsts, kind) AS sources FROM f GROUP BY service, country"""),
    "price_cross_check": sql("cands", """SELECT DISTINCT service, plan, route, country, currency, price_minor FROM cands a WHERE kind IN ('structured','page') AND EXISTS (SELECT 1 FROM cands b WHERE b.kind = 'help' AND b.service = a.service AND lower(trim(b.plan)) = lower(trim(a.plan)) AND b.price_minor = a.price_minor)"""),
    "price_unanimous": sql("cands", "SELECT service, plan, min(price_minor) AS price_minor, count(*) AS n FROM cands WHERE kind IN ('help','store') GROUP BY 1, 2 HAVING count(DISTINCT price_minor) = 1"),
    "price_complete_set": sql("cands", """, p AS (SELECT * FROM cands WHERE kind = 'structured' AND plan IN ('A','N','R')), g AS (SELECT service FROM p GROUP BY 1 HAVING count(DISTINCT plan) = 3),
        b AS (SELECT DISTINCT service FROM (SELECT service, plan FROM p GROUP BY 1, 2 HAVING count(DISTINCT price_minor) > 1))
        SELECT DISTINCT service, plan, price_minor FROM p WHERE service IN (SELECT service FROM g) AND service NOT IN (SELECT service FROM b)"""),
    "price_unambiguous": sql("cands", """, e AS (SELECT DISTINCT service, plan, price_minor FROM cands WHERE kind = 'page') SELECT * FROM e WHERE (SELECT count(DISTINCT plan) FROM e x WHERE x.service = e.service AND x.price_minor = e.price_minor) = 1"""),
    "registry_quality": sql("cands", """, r AS (SELECT *, CASE WHEN ord % 19 = 0 THEN lower(country) ELSE country END AS code, ord % 17 = 0 AS plain FROM cands)
        SELECT (SELECT count(*) FROM (SELECT 1 FROM r GROUP BY service, plan, route, code, currency, kind HAVING count(*) > 1)) AS doubled_keys, count(*) FILTER (price_minor <= 0) AS not_positive, count(*) FILTER (service IS NULL OR plan IS NULL) AS no_id,
        count(*) FILTER (code <> upper(code)) AS bad_country, count(*) FILTER ((code, currency) NOT IN (('NO','NOK'), ('SE','SEK'), ('DE','EUR'))) AS foreign_currency, count(*) FILTER (plain) AS not_secure, count(*) AS n FROM r"""),
    "monthly_spend": sql("spend", "SELECT *, monthly_minor * 3 AS quarter_minor, monthly_minor * 12 AS annual_minor FROM spend"),
    "catalog_total_null_strict": sql("subs", "SELECT user_id, CAST(CASE WHEN count(*) FILTER (status = 'ACTIVE') = 0 THEN 0 WHEN count(*) FILTER (status = 'ACTIVE' AND price_minor IS NULL) > 0 THEN NULL ELSE sum(price_minor) FILTER (status = 'ACTIVE') END AS BIGINT) AS total_minor FROM subs GROUP BY 1"),
    "saving_now": sql("effective", "SELECT user_id, count(*) AS n_stopped, CAST(coalesce(sum(price_minor), 0) AS BIGINT) AS saving_minor, CAST(12 * coalesce(sum(price_minor), 0) AS BIGINT) AS yearly_minor FROM effective WHERE effective <> 'ACTIVE' GROUP BY 1"),
    "currency_guard": sql("users saves", ", u AS (SELECT user_id, count(DISTINCT currency) AS n, min(currency) AS one FROM (SELECT user_id, currency FROM saves UNION ALL SELECT subscription_id + 1, currency FROM saves WHERE id % 50 = 0) GROUP BY 1) SELECT h.user_id, CASE WHEN u.n IS NULL THEN h.currency WHEN u.n = 1 THEN u.one ELSE 'Mixed' END AS currency FROM users h LEFT JOIN u USING (user_id)"),
    "cost_rank": sql("ranked", "SELECT user_id, id, price_minor, CAST(rank AS INTEGER) AS rank FROM ranked"),
    "top2_recommendations": sql("ranked", "SELECT user_id, id, price_minor, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 2"),
    "keep_pause_leave": sql("subs services", """, r AS (SELECT user_id, s.id, status = 'ACTIVE' AS act, row_number() OVER (PARTITION BY user_id, status = 'ACTIVE' ORDER BY catalog_minor, s.id) AS ch, row_number() OVER (PARTITION BY user_id, status = 'ACTIVE' ORDER BY catalog_minor DESC, s.id) AS de, row_number() OVER (PARTITION BY user_id, status = 'ACTIVE' ORDER BY s.id) AS fi FROM subs s JOIN services USING (service_id))
        SELECT user_id, max(id) FILTER (act AND ch = 1) AS keep_1, max(id) FILTER (act AND ch = 2) AS keep_2, max(id) FILTER (act AND de = 1) AS pause, max(id) FILTER (NOT act AND fi = 1) AS leave_off FROM r GROUP BY 1"""),
    "next_renewal": sql("upcoming", "SELECT user_id, id, renewal_date, n_upcoming FROM upcoming WHERE n = 1"),
    "data_health": sql("issues", "SELECT id, user_id, len(found) AS n_issues, array_to_string(found, ', ') AS issues FROM issues WHERE len(found) > 0"),
    "attention_feed": sql("issues upcoming ranked effective", """SELECT user_id, min(id) AS id, 'issue' AS kind FROM issues WHERE len(found) > 0 GROUP BY 1 UNION ALL SELECT user_id, id, 'renewal' FROM upcoming WHERE n = 1
        UNION ALL SELECT user_id, min(id), 'paused' FROM effective WHERE effective = 'PAUSED' GROUP BY 1 UNION ALL SELECT user_id, id, 'recommendation' FROM ranked WHERE rank = 1"""),
    "catalog_price_fallback": sql("resolved subs", """, w AS (SELECT id, service_id AS service, CASE id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'N' WHEN 2 THEN 'R' END AS plan, CASE id % 2 WHEN 0 THEN 'F' ELSE 'O' END AS route, (['NO','SE','DE'])[id % 3 + 1] AS country,
        (['NOK','SEK','EUR'])[id % 3 + 1] AS currency, price_minor AS own_minor, (['NOK','EUR'])[id % 2 + 1] AS own_currency FROM subs),
        k AS (SELECT service, country, currency, route, count(*) AS n, min(price_minor) AS only FROM resolved GROUP BY ALL)
        SELECT w.id, coalesce(CASE WHEN w.id % 29 = 0 THEN 777 END, a.price_minor, CASE WHEN b.n = 1 THEN b.only END, c.price_minor, CASE WHEN d.n = 1 THEN d.only END, CASE WHEN own_currency = w.currency THEN own_minor END) AS price_minor FROM w
        LEFT JOIN resolved a ON a.service = w.service AND a.plan = w.plan AND a.route = w.route AND a.country = w.country AND a.currency = w.currency LEFT JOIN k b ON b.service = w.service AND b.route = w.route AND b.country = w.country AND b.currency = w.currency
        LEFT JOIN resolved c ON c.service = w.service AND c.plan = w.plan AND c.route = 'O' AND c.country = w.country AND c.currency = w.currency LEFT JOIN k d ON d.service = w.service AND d.route = 'O' AND d.country = w.country AND d.currency = w.currency"""),
    "goal_plan": sql("effective", """, f AS (SELECT user_id, id, price_minor FROM effective WHERE effective = 'ACTIVE' AND price_minor > 0 AND id % 5 <> 2) SELECT * FROM (SELECT user_id, id, price_minor, CAST(coalesce((SELECT sum(g.price_minor) FROM f g WHERE g.user_id = f.user_id AND (g.price_minor > f.price_minor OR (g.price_minor = f.price_minor AND g.id < f.id))), 0) AS BIGINT) AS before_minor FROM f) WHERE before_minor < 300000"""),
    "scenario": sql("spend subs", "SELECT s.id, s.user_id, s.price_minor * 3 AS saved_minor, greatest(0, p.monthly_minor - s.price_minor) AS left_minor FROM subs s JOIN spend p USING (user_id) WHERE s.status = 'ACTIVE' AND s.price_minor > 0"),
    "html_to_text": r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&quot;', '"'), '&#39;', chr(39)), '\s+', ' ', 'g')) AS text FROM pages""",
    "slugify": "SELECT p_partkey, regexp_replace(regexp_replace(replace(lower(p_name || CASE WHEN p_partkey % 3 = 0 THEN '+ (HD)' ELSE '' END), '+', ' plus '), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part",
    "parse_number": """, n AS (SELECT k, regexp_replace(raw, '[^0-9,.-]', '', 'g') AS s FROM raw), m AS (SELECT k, CASE WHEN s = '' THEN NULL WHEN contains(s, ',') AND contains(s, '.') THEN CASE WHEN length(s) - strpos(reverse(s), ',') > length(s) - strpos(reverse(s), '.') THEN regexp_replace(replace(s, '.', ''), ',', '.') ELSE replace(s, ',', '') END
        WHEN contains(s, ',') THEN CASE WHEN strpos(reverse(s), ',') - 1 <= 2 THEN regexp_replace(replace(s, '.', ''), ',', '.') ELSE replace(s, ',', '') END ELSE s END AS t FROM n) SELECT k, TRY_CAST(t AS DOUBLE) AS amount FROM m""",
    "normalize_text": "SELECT doc_id, trim(regexp_replace(regexp_replace(replace(lower(text), '+', ' plus '), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS norm FROM documents",
    "word_match": """, w AS (SELECT DISTINCT unnest(string_split(norm, ' ')) AS word FROM turns) SELECT word, t AS target, CASE WHEN word = t THEN 100 WHEN length(word) >= 4 AND length(t) >= 4 AND levenshtein(word, t) <= CASE WHEN length(t) <= 3 THEN 0 WHEN length(t) <= 5 THEN 1 WHEN length(t) <= 8 THEN 2 ELSE 3 END THEN 80 - 10 * levenshtein(word, t) END AS score
        FROM w, (SELECT unnest(['thing','cancel','theonion','a']) AS t) WHERE word <> ''""",
}
ORACLES["word_match"] = sql("turns", ORACLES["word_match"])
ORACLES["parse_number"] = "WITH raw AS (SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'kr ' || o_totalprice WHEN 1 THEN replace(CAST(o_totalprice AS VARCHAR), '.', ',') WHEN 2 THEN '1.' || (o_orderkey % 900 + 100) || ',5' WHEN 3 THEN '1,' || (o_orderkey % 900 + 100) || '.25 EUR' WHEN 4 THEN '2,' || (o_orderkey % 900 + 100) ELSE 'from -' END AS raw FROM orders)" + ORACLES["parse_number"]

ORACLES |= {
    "reminder_dispatch": sql("jobs sent", """SELECT j.id, CASE WHEN s.id IS NOT NULL AND error IS NULL THEN TIMESTAMP '1998-07-21' ELSE sent_at END AS sent_at, CASE WHEN error = 'GONE' THEN TIMESTAMP '1998-07-21' ELSE failed_at END AS failed_at, error AS last_error FROM jobs j LEFT JOIN sent s USING (id)"""),
    "reminder_dispatch_counts": sql("jobs sent", "SELECT (SELECT count(*) FROM jobs) AS queued_or_due, (SELECT count(*) FROM sent WHERE error IS NULL) AS sent"),
    "reminder_queue_once": sql("jobs", "SELECT id, destination, scheduled_for FROM jobs WHERE subscription_id % 4 <> 1"),
    "reminder_simple_rule": sql("subs prefs", """, r AS (SELECT id, user_id, coalesce(status = 'ACTIVE' AND id % 12 <> 5 AND renewal_reminders, false) AS wanted, coalesce(email_enabled, true) AS mail FROM subs LEFT JOIN prefs USING (user_id)) SELECT id, wanted AND mail AS email, wanted AND user_id % 2 = 0 AS push FROM r"""),
    "endpoint_upsert": sql("ends tokens", """SELECT user_id, destination, enabled FROM ends e WHERE NOT EXISTS (SELECT 1 FROM tokens k WHERE k.user_id = e.user_id AND k.destination = e.destination) UNION ALL SELECT user_id, destination, true FROM tokens WHERE destination NOT LIKE 'Token%'"""),
    "endpoint_rejects": sql("tokens", "SELECT user_id, destination, 'INVALID_PUSH_TOKEN' AS error FROM tokens WHERE destination LIKE 'Token%'"),
    "timezone_update": sql("users", "SELECT user_id, CASE WHEN user_id % 3 = 0 AND user_id % 4 = 0 THEN 'Asia/Tokyo' WHEN user_id % 3 = 0 AND user_id % 4 = 2 THEN 'UTC' ELSE timezone END AS timezone FROM users"),
    "reminder_validation": sql("subs users", """SELECT id, CASE WHEN id % 8 = 0 THEN 'INVALID_DATE' WHEN id % 8 = 1 AND month(renewal_date) IN (2, 4, 6, 9, 11) THEN 'INVALID_DATE' WHEN user_id % 9 = 4 THEN 'INVALID_TIMEZONE'
        ELSE strftime(CASE WHEN id % 8 = 1 THEN last_day(renewal_date) ELSE renewal_date END, '%Y-%m-%d') || ' ' || CASE WHEN trim(timezone) = '' THEN 'UTC' ELSE timezone END END AS verdict FROM subs JOIN users USING (user_id)"""),
    "subscription_ledger_of": sql("saves subs services", "SELECT e.id, e.user_id, e.kind, e.amount_minor, e.currency, e.period_start, e.period_end, v.service_name, s.plan_name FROM saves e LEFT JOIN subs s ON s.id = e.subscription_id LEFT JOIN services v USING (service_id) WHERE e.user_id = 7"),
    "subscription_list_of": ORACLES["subscription_list"] + " WHERE s.user_id = 7",
    "savings_verified_count": sql("verified", "SELECT count(*) AS verified FROM verified"),
    "total_saved_so_far": sql("history prices users", "").rstrip() + ",\n" + INTERVALS + """, o AS (SELECT subscription_id FROM history UNION SELECT user_id FROM users WHERE user_id < 50)
        SELECT o.subscription_id % 40 AS user_id, CAST(coalesce(sum(saved_minor), 0) AS BIGINT) AS saved_minor FROM o LEFT JOIN saved USING (subscription_id) GROUP BY 1""",
    "account_create": sql("users ents accepted", "SELECT user_id, email, plan FROM users LEFT JOIN ents USING (user_id) UNION ALL SELECT user_id, email, 'VIEWER' FROM accepted"),
    "account_create_rejects": sql("newcomers accepted", "SELECT user_id, email, 'EMAIL_EXISTS' AS error FROM newcomers WHERE user_id NOT IN (SELECT user_id FROM accepted)"),
    "account_by_email": sql("users ents", "SELECT user_id, email, coalesce(plan, 'VIEWER') AS plan FROM users LEFT JOIN ents USING (user_id) WHERE email = 'customer#000000004@example.org'"),
    "account_deletion": sql("users", """, d AS (SELECT user_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE coalesce(CASE WHEN user_id % 3 = 0 THEN DATE '1998-06-15' + CAST(user_id % 30 AS INTEGER) END, CASE WHEN user_id % 2 = 0 THEN DATE '1998-07-01' END) END AS deletion_requested FROM users)
        SELECT *, CASE WHEN deletion_requested IS NOT NULL THEN 'ACCOUNT_DELETION_PENDING' END AS error FROM d"""),
    "plan_gates": sql("users ents", "SELECT user_id, coalesce(plan IN ('MANUAL','PREMIUM'), false) AS manual, coalesce(plan = 'PREMIUM', false) AS premium FROM users LEFT JOIN ents USING (user_id)"),
    "subscription_update": sql("subs applied", """SELECT s.id, s.user_id, coalesce(a.new_service, s.service_id) AS service_id, CAST(coalesce(a.new_provider, s.provider_id) AS INTEGER) AS provider_id, CASE WHEN a.id IS NOT NULL THEN 'New plan' ELSE plan_name END AS plan_name,
        CASE WHEN a.id IS NOT NULL THEN new_price ELSE price_minor END AS price_minor, CAST(CASE WHEN a.id IS NOT NULL THEN new_renewal ELSE renewal_date END AS TIMESTAMP) + INTERVAL 12 HOUR AS renews_at FROM subs s LEFT JOIN applied a ON a.id = s.id"""),
    "subscription_update_rejects": sql("edits applied", "SELECT id, 'SUBSCRIPTION_OR_PROVIDER_NOT_FOUND' AS error FROM edits WHERE id NOT IN (SELECT id FROM applied)"),
    "subscription_delete": sql("subs gone", "SELECT id FROM subs WHERE id NOT IN (SELECT id FROM gone)"),
    "subscription_delete_actions": sql("acts gone", "SELECT id, subscription_id FROM acts WHERE subscription_id NOT IN (SELECT id FROM gone)"),
    "subscription_delete_savings": sql("saves gone", "SELECT id, CASE WHEN subscription_id NOT IN (SELECT id FROM gone) THEN subscription_id END AS subscription_id FROM saves"),
    "provider_seed_upsert": sql("providers", "SELECT CAST(provider_id AS INTEGER) AS provider_id, provider_slug FROM providers WHERE provider_id <> 1 UNION ALL VALUES (1, 'the americas'), (7, 'moon')"),
    "purchase_validity": sql("buys", "SELECT ord, plan FROM buys"),
    "purchase_events": sql("owners claimed", "SELECT platform, original_id, user_id FROM claimed UNION ALL SELECT platform, original_id, owner FROM owners WHERE fresh"),
    "purchase_entitlements": sql("owners buys ents", """, g AS (SELECT user_id, arg_max(plan, ord) AS plan FROM buys JOIN owners USING (platform, original_id) WHERE user_id = owner GROUP BY 1) SELECT user_id, plan FROM g UNION ALL SELECT user_id, plan FROM ents WHERE user_id NOT IN (SELECT user_id FROM g)"""),
    "purchase_rejects": sql("owners buys", "SELECT user_id, original_id, 'PURCHASE_ALREADY_CLAIMED' AS error FROM buys JOIN owners USING (platform, original_id) WHERE user_id <> owner"),
    "country_backfill": sql("placed", "SELECT id, country FROM placed"),
    "market_filter": sql("placed", "SELECT id FROM placed WHERE country = 'NO'"),
    "renewal_at_noon": sql("subs", "SELECT id, CAST(renewal_date AS TIMESTAMP) + INTERVAL 12 HOUR AS renews_at FROM subs"),
    "metadata_merge": sql("acts", """SELECT id, '{' || CASE WHEN id % 3 <> 0 THEN '"a":"1",' ELSE '' END || '"b":"' || id || '"}' AS metadata FROM acts"""),
    "chat_history": """SELECT conv_id, turn, role, trim(text) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3 AND role IN ('user','assistant') AND trim(text) <> ''""",
    "top3_expensive": sql("ranked", "SELECT user_id, id, price_minor, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 3"),
    "cost_comparison": sql("subs", "SELECT a.id AS a, b.id AS b, CASE WHEN a.price_minor > b.price_minor THEN a.id WHEN b.price_minor > a.price_minor THEN b.id END AS dearer, abs(a.price_minor - b.price_minor) AS difference_minor FROM subs a JOIN subs b ON b.id = a.id + 1 WHERE a.id % 4 = 0 AND a.price_minor IS NOT NULL AND b.price_minor IS NOT NULL"),
    "html_export": sql("subs services", """, c AS (SELECT s.id, user_id, service_name || ' <&> ' || chr(39) || 'x' || chr(39) AS name, '<div><h2>' || service_name || ' &lt;&amp;&gt; &#39;x&#39;</h2><p>' || status || '</p><p>' || coalesce(printf('%.2f', price_minor / 100.0), '-') || '</p></div>' AS card FROM subs s JOIN services USING (service_id))
        SELECT user_id, '<main>' || string_agg(card, '' ORDER BY name, id) || '<p>Total saved: ' || printf('%.2f', coalesce(sum(CASE WHEN id % 3 = 0 THEN id % 5000 END), 0) / 100.0) || '</p></main>' AS html FROM c GROUP BY 1"""),
    "price_valid": sql("good", "SELECT country, currency, kind, count(*) AS n FROM good GROUP BY ALL"),
    "price_last_wins": sql("cands", "SELECT service, plan, route, country, currency, price_minor, kind FROM cands QUALIFY row_number() OVER (PARTITION BY service, plan, route, country, currency ORDER BY ord DESC, line DESC) = 1"),
    "price_market_scan": sql("stored", "SELECT service, plan, route, country, currency, price_minor, 'exact' AS price_type, 'verified' AS confidence, checked_on AS updated_on FROM stored WHERE country = 'NO'"),
    "price_store_counts": sql("resolved", "SELECT count(*) AS received, count(*) FILTER (verification = 'authoritative-provider' OR (verification = 'multi-source' AND by_agreement AND source_count >= 2)) AS persisted FROM resolved"),
    "registry_scan": sql("cands", "SELECT plan, CASE WHEN ord % 3 <> 0 THEN route ELSE 'direct' END AS route, price_minor, ord, line FROM cands WHERE kind = 'registry' AND service = 5 AND country = 'NO' AND currency = 'NOK'"),
    "store_catalogue": """SELECT p_partkey AS service, plan, 'apple' AS route, (['NO','SE','DE'])[p_partkey % 4 + 1] AS country, (['NOK','SEK','EUR'])[p_partkey % 4 + 1] AS currency, p_partkey % 900 * f AS price_minor, 'exact' AS price_type, 'store' AS kind
        FROM part, (VALUES ('Small', 1), ('Large', 2)) v(plan, f) WHERE p_partkey % 4 <> 3 AND p_partkey % 900 > 0""",
    "china_catalogue": """SELECT p_partkey AS service, plan, 'apple' AS route, 'CN' AS country, 'CNY' AS currency, p_partkey % 900 * f AS price_minor, 'exact' AS price_type, 'store' AS kind FROM part, (VALUES ('Small', 1), ('Large', 2)) v(plan, f) WHERE p_partkey % 3 = 0 AND p_partkey % 900 > 0""",
    "market_sources": sql("cands", """, a AS (SELECT service, kind FROM cands WHERE kind IN ('page','help') AND country = 'NO' AND service % 4 <> 1) SELECT service, kind, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT service, kind FROM cands WHERE kind = 'registry' AND country = 'NO' AND service NOT IN (SELECT service FROM a)) GROUP BY ALL"""),
    "refresh_summary": """, e AS (SELECT substr(n_name, 1, 2) AS country, max(CASE WHEN n_nationkey % 6 <> 1 THEN n_nationkey END) AS n FROM nation GROUP BY 1) SELECT count(*) AS checked, count(n) AS refreshed, coalesce(string_agg(country, ',' ORDER BY country) FILTER (n IS NULL), '') AS failed FROM e""".lstrip(", ").replace("e AS", "WITH e AS", 1),
    "service_availability": """SELECT p_partkey, CASE WHEN c = 'CN' THEN s IN ('youku','apple-music') WHEN s = 'hulu' THEN c = 'US' WHEN s = 'paramount-plus' THEN c IN ('US','DE','FR','IT','AT','IE') ELSE s <> 'youku' END AS available FROM (SELECT p_partkey,
        (['netflix','hulu','youku','apple-music','paramount-plus','prime-video','amazon-prime','amazon-music-unlimited','disney-plus','unknown'])[p_partkey % 10 + 1] AS s, (['US','NO','CN','DE','SE','IE','PT'])[p_partkey % 7 + 1] AS c FROM part)""",
    "billing_routes": """WITH r AS (SELECT DISTINCT 's' || (p_partkey % 60) AS service, (['apple','direct','moon','carrier','amazon'])[p_partkey % 5 + 1] AS provider FROM part WHERE p_partkey % 3 <> 0), k AS (SELECT service, provider, list_position(['direct','apple','google-play','amazon','carrier'], provider) AS n FROM r WHERE provider <> 'moon'),
        s AS (SELECT DISTINCT 's' || (p_partkey % 70) AS service FROM part) SELECT s.service, coalesce(string_agg(provider, ',' ORDER BY n), 'direct') AS routes, coalesce(arg_min(provider, n), 'direct') AS default_route FROM s LEFT JOIN k USING (service) GROUP BY 1""",
    "service_picker": sql("services cands subs", """SELECT DISTINCT 's' || service_id AS service, service_name FROM services WHERE category = 'Brand#13' AND service_id IN (SELECT service FROM cands WHERE price_minor > 0 AND country = 'NO') AND service_id NOT IN (SELECT service_id FROM subs WHERE user_id = 7)"""),
    "country_search": "SELECT substr(n_name, 1, 2) AS country, n_name AS name FROM nation WHERE lower(n_name) LIKE '%n\\_1%' ESCAPE '\\'",
    "page_metadata": """, m AS (SELECT page_id, (['NO','se','DE','USA'])[page_id % 4 + 1] AS requested, CASE WHEN page_id % 3 = 0 THEN (['NO','DE'])[page_id % 2 + 1] END AS reported FROM pages) SELECT *, CASE WHEN reported IS NULL THEN 'direct' ELSE 'proxy' END AS transport, CASE WHEN page_id % 2 = 1 THEN 'INVALID_COUNTRY' WHEN reported <> requested THEN 'WRONG_EXIT_COUNTRY' END AS error FROM m""".lstrip(", ").replace("m AS", "WITH m AS", 1),
    "provider_routes": sql("billed", """SELECT id, billing, CASE billing WHEN 'apple' THEN 'APPLE' WHEN 'google-play' THEN 'GOOGLE_PLAY' WHEN 'amazon' THEN 'AMAZON' WHEN 'direct' THEN 'DIRECT' ELSE 'GUIDED' END AS provider,
        CASE billing WHEN 'apple' THEN 'https://apps.apple.com/account/subscriptions' WHEN 'google-play' THEN 'https://play.google.com/store/account/subscriptions' WHEN 'amazon' THEN 'https://www.amazon.com/hz5/yourmembershipsandsubscriptions' END AS url,
        CASE billing WHEN 'apple' THEN 'Open Apple subscriptions' WHEN 'google-play' THEN 'Open Google Play subscriptions' WHEN 'amazon' THEN 'Open Amazon subscriptions' WHEN 'direct' THEN 'Manage directly' ELSE 'Open guided instructions' END AS label FROM billed"""),
    "management_urls": sql("billed", """, p(service, m, pa, ca, re) AS (VALUES ('netflix', 'https://m', 'https://p', NULL, NULL), ('disney-plus', 'https://d', NULL, 'https://c', 'https://r'), ('hulu', NULL, NULL, 'https://h', NULL)),
        v AS (SELECT b.*, 'https://www.primevideo.com/' || CASE WHEN country IN ('NO','gb') THEN 'region/eu/' ELSE '' END || 'settings/your-account' AS prime FROM billed b)
        SELECT id, CASE WHEN billing = 'apple' THEN 'https://apps.apple.com/account/subscriptions' WHEN billing = 'google-play' THEN 'https://play.google.com/store/account/subscriptions' WHEN billing = 'carrier' THEN NULL
        WHEN billing = 'amazon' THEN CASE v.service WHEN 'prime-video' THEN prime WHEN 'amazon-music-unlimited' THEN 'https://www.amazon.com/gp/dmusic/player/settings' WHEN 'amazon-prime' THEN 'https://www.amazon.com/prime' ELSE 'https://www.amazon.com/gp/video/settings/channels' END
        WHEN v.service = 'prime-video' THEN prime ELSE coalesce(CASE action WHEN 'PAUSE' THEN pa WHEN 'CANCEL' THEN ca WHEN 'REACTIVATE' THEN re END, m) END AS url FROM v LEFT JOIN p USING (service)"""),
    "pause_support": sql("billed", "SELECT id, billing = 'direct' AND service IN ('netflix','hulu') AS pauses FROM billed"),
    "capability_resolution": sql("contexts", """, f AS (SELECT *, CASE WHEN service = 'netflix' AND provider = 'direct' THEN 'netflix-direct' WHEN provider = 'apple' THEN 'apple-platform' WHEN service = 'disney-plus' AND provider = 'direct' THEN 'disney-direct' ELSE 'fallback-guided' END AS adapter FROM contexts),
        x AS (SELECT *, CASE WHEN adapter IN ('netflix-direct','disney-direct') THEN 'DIRECT' WHEN action = 'PAUSE' THEN 'UNSUPPORTED' WHEN adapter = 'apple-platform' THEN 'PROVIDER_REDIRECT' ELSE 'GUIDED' END AS execution FROM f)
        SELECT id, adapter, execution, execution <> 'UNSUPPORTED' AS supported, adapter = 'disney-direct' AND action = 'PAUSE' AS premium_only, CASE WHEN execution = 'PROVIDER_REDIRECT' THEN 'https://apps.apple.com/account/subscriptions' END AS url FROM x"""),
    "plan_names": """SELECT p_partkey, (['Basic','Standard','Standard with Ads',NULL,'Premium','Basic'])[p_partkey % 6 + 1] AS plan FROM part""",
    "page_language": """WITH h AS (SELECT page_id, '<HTML class="x" lang="' || (['nb-NO','en',''])[page_id % 3 + 1] || '">' || html AS html FROM pages) SELECT page_id, nullif(lower(regexp_extract(html, '<(?:html|HTML)[^>]* lang="([A-Za-z-]+)"', 1)), '') AS language FROM h""",
    "page_faq_prices": sql("priced", "SELECT page_id, plan, amount FROM (SELECT page_id, unnest(CASE WHEN mark = 'kr' THEN [{'plan': 'Individual', 'amount': low + 0.5}, {'plan': 'Duo', 'amount': CAST(high AS DOUBLE)}] ELSE [{'plan': 'Duo', 'amount': CAST(high AS DOUBLE)}] END, recursive := true) FROM priced)"),
    "page_price_range": sql("priced", shown("kr_range", "low, high") + " SELECT page_id, CAST(regexp_extract(html, 'range from kr ([0-9]+)', 1) AS DOUBLE) AS low, CAST(regexp_extract(html, 'a month to kr ([0-9]+)', 1) AS DOUBLE) AS high FROM shown"),
    "page_market": sql("priced", shown("market", "CASE WHEN page_id % 4 = 0 THEN 'no' WHEN page_id % 2 = 0 THEN 'NO' ELSE 'SE' END") + " SELECT page_id, nullif(regexp_extract(html, 'data:\\[\\[null,null,null,[0-9]+,[0-9]+,null,\"([A-Z]{2})\"', 1), '') AS market FROM shown"),
    "page_anchored_price": sql("priced", shown("anchored_price", "low, CASE WHEN page_id % 2 = 0 THEN low ELSE high END") + ", m AS (SELECT page_id, unnest(regexp_extract_all(html, '(?:kr|NOK) ([0-9]+) per måned', 1)) AS p FROM shown) SELECT page_id, CASE WHEN min(p) = max(p) THEN CAST(min(p) AS DOUBLE) END AS amount FROM m GROUP BY 1"),
    "page_recurring_prices": sql("priced", shown("recurring_prices", "low, high") + " SELECT page_id, 'Individual' AS plan, CAST(regexp_extract(html, 'then ([0-9]+) kr per month', 1) AS DOUBLE) AS amount FROM shown UNION ALL SELECT page_id, 'Duo', CAST(regexp_extract(html, 'Duo kr ([0-9]+) monthly', 1) AS DOUBLE) FROM shown"),
    "page_storage_tiers": sql("priced", "SELECT page_id, 'Google AI Pro — 100 GB' AS plan, CAST(low AS DOUBLE) AS amount FROM priced WHERE page_id % 5 <> 0 UNION ALL SELECT page_id, 'Storage 100 GB', CAST(high AS DOUBLE) FROM priced WHERE page_id % 2 <> 0"),
    "page_structured_plans": sql("priced", shown('structured_plans', "low, CASE WHEN page_id % 3 = 0 THEN 'år' WHEN page_id % 2 = 0 THEN 'måned' ELSE ' Måned ' END, CASE WHEN page_id % 4 = 0 THEN 'SEK' ELSE 'NOK' END, high, high") + r""",
        r AS (SELECT page_id, unnest(regexp_extract_all(html, '"productName".*?"pricePlan":[^}]*')) AS x FROM shown), f AS (SELECT page_id, regexp_extract(x, '"productName":[^}]*"plainText":"([^"]*)"', 1) AS name, regexp_extract(x, '"currencyCode":"([^"]*)"', 1) AS code,
        regexp_extract(x, '"amount":[{][^}]*"plainText":"([^"]*)"', 1) AS amount, lower(trim(regexp_extract(x, '"period":[{][^}]*"plainText":"([^"]*)"', 1))) AS period, regexp_extract(x, '"id":"([^"]*)"', 1) AS plan_id FROM r)
        SELECT page_id, CASE lower(trim(name)) WHEN 'basis med reklame' THEN 'Basic With Ads' WHEN 'premium' THEN 'Premium' ELSE trim(name) END AS plan, CAST(replace(replace(amount, ' ', ''), ',', '.') AS DOUBLE) AS amount, plan_id FROM f WHERE code = 'NOK' AND period IN ('måned','mese','month') AND amount <> ''"""),
    "page_embedded_plans": sql("priced", shown('embedded_plans', "CASE WHEN page_id % 5 = 0 THEN 'SE' ELSE 'no' END, low, mark, CASE WHEN page_id % 2 = 0 THEN 'true' ELSE 'false' END, low, high") + r""",
        j AS (SELECT page_id, CAST(regexp_extract(html, 'id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1) AS JSON) AS data FROM shown), o AS (SELECT page_id, t.id, t.value AS v FROM j, json_tree(data, '$.props.pageProps.components') t WHERE t.type = 'OBJECT' AND upper(trim(data->>'$.props.pageProps.basePageProps.country')) = 'NO'),
        d AS (SELECT page_id, id, v->>'planId' AS plan, unnest([v->>'secondaryPriceDescription', v->>'primaryPriceDescription', v->>'subheaderPrice']) AS x, unnest([1, 2, 3]) AS k FROM o WHERE v->>'isRecurringProduct' = 'true' AND v->>'planId' LIKE 'PREMIUM%'),
        a AS (SELECT *, CAST(nullif(replace(coalesce(nullif(regexp_extract(x, 'kr *([0-9]+)', 1), ''), regexp_extract(x, '([0-9,]+) *kr', 1)), ',', '.'), '') AS DOUBLE) AS amount FROM d)
        SELECT page_id, upper(substr(plan, 9, 1)) || lower(substr(plan, 10)) AS plan, arg_min(amount, (id, k)) AS amount FROM a WHERE amount > 0 GROUP BY page_id, plan"""),
    "page_renewal_price": sql("priced", shown('renewal_price', "CASE WHEN page_id % 3 = 0 THEN '连续包年' ELSE '连续包月' END, low, CASE WHEN page_id % 4 = 0 THEN '{\"sellProductName\":\"SVIP会员\"}' ELSE '{}' END") + r"""
        SELECT page_id, regexp_extract(html, '"sellProductName":"([A-Z]+)', 1) AS plan, CAST(regexp_extract(html, '第 *[0-9]+ *个月起 *([0-9]+) *元', 1) AS DOUBLE) AS amount FROM shown WHERE len(string_split(html, '"sellProductName"')) = 2 AND regexp_extract(html, '"sellSkuName":"([^"]*)"', 1) = '连续包月'"""),
    "page_field_plans": sql("priced", shown('field_plans', "low, CASE WHEN page_id % 7 = 3 THEN 'USD' ELSE 'NOK' END, high, CASE WHEN page_id % 5 = 0 THEN 'Yearly' ELSE ' monthly' END, high, CASE WHEN page_id % 4 = 0 THEN low + 1 ELSE low END") + r""",
        b AS (SELECT page_id, unnest(string_split(replace(html, '"fields": ', '"fields":'), '"fields":')[2:]) AS x FROM shown), g AS (SELECT page_id, regexp_extract(x, '"planType":[^}]*"value":"([^"]*)"', 1) AS kind, regexp_extract(x, '"localizedPlanName":[^}]*"value":"([^"]*)"', 1) AS name, regexp_extract(x, '"planPriceCurrency":[^}]*"value":"([^"]*)"', 1) AS code,
        CAST(replace(regexp_extract(x, '"planPriceAmount":[^}]*"value":"([^"]*)"', 1), ',', '.') AS DOUBLE) AS amount, lower(trim(regexp_extract(x, '"billingFrequency":[^}]*"value":"([^"]*)"', 1))) AS every FROM b),
        n AS (SELECT page_id, CASE WHEN lower(kind) IN ('basic','basis') THEN 'Basic' WHEN lower(kind) = 'premium' THEN 'Premium' WHEN lower(trim(name)) = 'standard' THEN 'Standard' END AS plan, amount FROM g WHERE code = 'NOK' AND every = 'monthly'), u AS (SELECT page_id, plan, min(amount) AS amount FROM n GROUP BY ALL HAVING min(amount) = max(amount))
        SELECT * FROM u WHERE page_id IN (SELECT page_id FROM u GROUP BY 1 HAVING count(*) = 3)"""),
    "page_tv_price": sql("priced", shown('tv_price', "low, CASE page_id % 3 WHEN 0 THEN 'Apple TV is $9.99 / month' WHEN 1 THEN 'Apple TV with Apple One is $9.99 / month' ELSE 'end' END") + r""",
        x AS (SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(html, '&nbsp;', ' '), '&#36;', '$'), '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM shown),
        k AS (SELECT page_id, t, unnest(range(1, length(t) + 1)) AS i FROM x), w AS (SELECT page_id, substr(t, i, 420) AS w FROM k WHERE substr(t, i, 8) = 'apple tv' AND NOT regexp_matches(substr(t, greatest(i - 80, 1), least(i - 1, 80)), 'apple (music|one)')),
        m AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(w, 'apple (music|one).*', ''), '\$ *([0-9.]+) *(?:per|/) month', 1)) AS p FROM w) SELECT x.page_id, CASE WHEN min(CAST(p AS DOUBLE)) = max(CAST(p AS DOUBLE)) THEN min(CAST(p AS DOUBLE)) END AS amount FROM x LEFT JOIN m USING (page_id) GROUP BY 1"""),
    "page_video_price": sql("priced", shown('video_price', "(['fr-FR','fr_FR','de-DE','fr-FR'])[page_id % 4 + 1], (['FR','fr','FR','BE','FR'])[page_id % 5 + 1], low, CASE WHEN page_id % 6 = 0 THEN 'or €3,99 / mois' ELSE '3,99 € one day' END") + r""",
        n AS (SELECT *, replace(replace(substr(html, greatest(instr(html, '"planLogoAltText"') - 6000, 1), 6000), chr(92) || 'u002F', '/'), '&nbsp;', ' ') AS near FROM shown WHERE regexp_matches(html, '"recordTerritory":"(FR|fr)"') AND regexp_matches(html, '"osLocale":"fr[-_]FR"')),
        m AS (SELECT page_id, unnest(regexp_extract_all(near, '([0-9]+,[0-9]+) *€ */ *mois', 1) || regexp_extract_all(near, '€ *([0-9]+,[0-9]+) */ *mois', 1)) AS p FROM n)
        SELECT s.page_id, CASE WHEN min(p) = max(p) THEN CAST(replace(min(p), ',', '.') AS DOUBLE) END AS amount FROM shown s LEFT JOIN m USING (page_id) GROUP BY 1"""),
    "page_footnote_prices": sql("priced", shown("footnote_prices", "high, high, low, mark") + r""", m AS (SELECT page_id, unnest(['Premium', 'Standard', 'Standard with Ads']) AS plan, unnest([regexp_extract(html, '([0-9]+) kr per måned for Premium,', 1), regexp_extract(html, '([0-9]+) kr per måned for Standard eller', 1), regexp_extract(html, '([0-9]+) kr per måned for Standard med', 1)]) AS p FROM shown)
        SELECT page_id, plan, CAST(p AS DOUBLE) AS amount FROM m WHERE page_id NOT IN (SELECT page_id FROM m WHERE p = '')"""),
    "page_basic_monthly": sql("priced", shown("basic_monthly", "high, low, CASE WHEN page_id % 3 = 0 THEN 'år' ELSE 'måned' END") + r""",
        c AS (SELECT page_id, unnest(regexp_split_to_array(html, '<div class="[^"]*sku[^"]*">')[2:]) AS card FROM shown), m AS (SELECT page_id, regexp_extract(card, 'Microsoft 365 Basic *</h3>.*oc-displayListPrice"> *kr ([0-9]+,[0-9]+) *</span>.*oc-displayUnit[^>]*> *per måned *<', 1) AS p FROM c)
        SELECT page_id, max(CAST(replace(nullif(p, ''), ',', '.') AS DOUBLE)) AS amount FROM m GROUP BY 1"""),
    "page_comparison_prices": sql("priced", shown("comparison_prices", "low, high, CASE WHEN page_id % 3 = 0 THEN 'år' ELSE 'måned' END") + r""",
        c AS (SELECT page_id, unnest(regexp_split_to_array(html, '<h2[^>]*>')[2:]) AS part FROM shown), m AS (SELECT page_id, regexp_extract(part, '^ *Microsoft 365 (Personal|Family|Premium) *<', 1) AS plan, regexp_extract(part, 'sku1price price-heading *">kr ([0-9 ]+),00/måned', 1) AS p FROM c)
        SELECT page_id, plan, CAST(replace(p, ' ', '') AS DOUBLE) AS amount FROM m WHERE plan <> '' AND p <> ''"""),
    "page_gallery_prices": sql("priced", shown("gallery_prices", "low, high, CASE WHEN page_id % 4 = 0 THEN ' eller 7 kr per måned' ELSE '' END, low, CASE WHEN page_id % 3 = 0 THEN 'år' ELSE 'maned' END") + r""",
        b AS (SELECT page_id, unnest(string_split(html, 'data-analytics-gallery-item-id="')[2:]) AS x FROM shown), n AS (SELECT page_id, CASE regexp_extract(x, '^([a-z ]+)"', 1) WHEN 'individual' THEN 'Individual' WHEN 'family' THEN 'Family' WHEN 'student' THEN 'Student' END AS plan,
        unnest(regexp_extract_all(x, 'kr ([0-9,]+) per måned', 1) || regexp_extract_all(x, '([0-9,]+) kr (?:per|pr[.]) m[åa]ned', 1)) AS p FROM b), u AS (SELECT page_id, plan, CAST(replace(min(p), ',', '.') AS DOUBLE) AS amount FROM n WHERE plan IS NOT NULL GROUP BY ALL HAVING min(p) = max(p))
        SELECT * FROM u WHERE page_id IN (SELECT page_id FROM u GROUP BY 1 HAVING count(*) = 3)"""),
    "page_option_prices": sql("priced", shown("option_prices", "low, high, CASE WHEN page_id % 3 = 0 THEN 'Pensjonist' ELSE 'Student' END, low, CASE WHEN page_id % 4 = 0 THEN low + 1 ELSE low END") + r""",
        b AS (SELECT page_id, unnest(string_split(html, '"optionItemRenderer":')[2:]) AS x FROM shown), n AS (SELECT page_id, CASE regexp_extract(x, '"title":[^"]*"runs":[^"]*"text":"([^"]*)"', 1) WHEN 'Personlig' THEN 'Individual' WHEN 'Enkeltperson' THEN 'Individual' WHEN 'Familieabonnement' THEN 'Family' WHEN 'Student' THEN 'Student' END AS plan,
        CAST(replace(regexp_extract(x, 'Deretter[^0-9]*([0-9,]+) kr', 1), ',', '.') AS DOUBLE) AS amount FROM b WHERE regexp_matches(x, '"optionId":"unlimited[.]P[.]')),
        u AS (SELECT page_id, plan, min(amount) AS amount FROM n WHERE plan IS NOT NULL GROUP BY ALL HAVING min(amount) = max(amount)) SELECT * FROM u WHERE page_id IN (SELECT page_id FROM u GROUP BY 1 HAVING count(*) = 3)"""),
    "page_sku_prices": sql("priced", shown("sku_prices", "low, low, high, CASE WHEN page_id % 3 = 0 THEN '/Jahr' ELSE '/mese' END, high, CASE WHEN page_id % 4 = 0 THEN high + 1 ELSE high END") + r""",
        c AS (SELECT page_id, unnest(regexp_split_to_array(replace(html, '&nbsp;', ' '), '<div class="[^"]*sku[^"]*">')[2:]) AS card FROM shown), f AS (SELECT page_id, lower(trim(regexp_replace(regexp_extract(card, 'oc-product-title">([^<]*)<', 1), ' +', ' ', 'g'))) AS title,
        regexp_extract(card, 'oc-displayListPrice">[ €]*([0-9.]+(?:,[0-9]+)?)', 1) AS p, lower(trim(regexp_replace(regexp_extract(card, 'oc-displayUnit">([^<]*)<', 1), ' +', ' ', 'g'))) AS unit FROM c),
        n AS (SELECT page_id, CASE title WHEN 'microsoft 365 basic' THEN 'Basic' WHEN 'microsoft 365 single' THEN 'Personal' WHEN 'microsoft 365 familia' THEN 'Family' WHEN 'microsoft 365 premium' THEN 'Premium' END AS plan, CAST(replace(replace(p, '.', ''), ',', '.') AS DOUBLE) AS amount FROM f WHERE unit IN ('/monat','/mese','al mes','/mois')),
        u AS (SELECT page_id, plan, min(amount) AS amount FROM n GROUP BY ALL HAVING min(amount) = max(amount)) SELECT * FROM u WHERE page_id IN (SELECT page_id FROM u GROUP BY 1 HAVING count(*) = 4)"""),
    "page_card_prices": sql("priced", shown("card_prices", "low, high, high, low, CASE WHEN page_id % 3 = 0 THEN 'år' ELSE 'måned' END") + r""",
        c AS (SELECT page_id, unnest(string_split(html, 'data-testid="l4l_')[2:]) AS card, unnest(range(1, 9)) AS k FROM shown), m AS (SELECT page_id, k, regexp_extract(card, '^[a-z]+') AS id, regexp_extract_all(card, '([0-9]+) kr./md', 1) || regexp_extract_all(card, 'DKK ([0-9]+,[0-9]+) per måned', 1) AS p FROM c WHERE card IS NOT NULL)
        SELECT page_id, CASE id WHEN 'premium' THEN 'Premium' WHEN 'standard' THEN 'Standard' ELSE 'Standard with Ads' END AS plan, arg_min(CAST(replace(CASE WHEN len(p) > 1 AND p[1] = p[2] THEN p[1] ELSE p[-1] END, ',', '.') AS DOUBLE), k) AS amount FROM m WHERE len(p) > 0 GROUP BY page_id, id"""),
    "page_tier_prices": sql("priced", "SELECT page_id, plan, CAST(CASE k WHEN 0 THEN low WHEN 1 THEN low + 1 ELSE high + k - 2 END AS DOUBLE) AS amount FROM priced, (VALUES (0, '50 GB'), (1, '200 GB'), (2, '2 TB'), (3, '6 TB'), (4, '12 TB')) v(k, plan) WHERE page_id % 3 <> 0 OR high + 2 = 77"),
    "page_card_recurring": sql("priced", shown("card_recurring", "'premium', 'PREMIUM', high, 'kr', 'premium', 'PREMIUM', high, 'kr', 'basic', 'STANDARD MED REKLAME', low, mark, 'standard', 'UKJENT', low, 'kr'", 4) + r""", c AS (SELECT page_id, unnest(string_split(html, 'data-testid="l4l_')[2:]) AS x FROM shown),
        m AS (SELECT page_id, trim(regexp_extract(x, '>([^<]*)</a>', 1)) AS title, regexp_extract(x, 'deretter betaler du</p><b>([0-9]+) kr per måned', 1) AS p FROM c) SELECT DISTINCT page_id, CASE title WHEN 'PREMIUM' THEN 'Premium' ELSE 'Standard with Ads' END AS plan, CAST(p AS DOUBLE) AS amount FROM m WHERE p <> '' AND title <> 'UKJENT'"""),
    "page_china_prices": sql("priced", "SELECT page_id, 'Personal' AS plan, CAST(low AS DOUBLE) AS amount FROM priced WHERE page_id % 3 <> 0 AND page_id % 4 <> 0 UNION ALL SELECT page_id, 'Family', CAST(high || '.5' AS DOUBLE) FROM priced WHERE page_id % 3 <> 0 AND page_id % 4 <> 0"),
    "page_membership_monthly": sql("priced", shown("membership", "2, high, 'per maand', 1, low, CASE WHEN page_id % 3 = 0 THEN 'per jaar' WHEN page_id % 5 = 0 THEN 'per maand, 3,50 € per week' ELSE 'per maand' END", 2) + r""", c AS (SELECT page_id, regexp_extract(html, 'data-index="1"><label>([^<]*)<', 1) AS x FROM shown),
        m AS (SELECT page_id, x, regexp_extract_all(x, '[0-9]+[.,][0-9]+') AS p FROM c) SELECT page_id, CASE WHEN len(p) = 1 AND contains(x, 'per maand') THEN CAST(p[1] AS DOUBLE) END AS amount FROM m"""),
    "page_last_amount": sql("priced", shown("last_amount", "low, high, low") + r""",
        x AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM shown), m AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(t, '(?i)(?:kr|NOK)\s*[\d][\d.,]*|[\d][\d.,]*\s*(?:kr|NOK)'), lambda p: TRY_CAST(replace(regexp_replace(p, '[^0-9,]', '', 'g'), ',', '.') AS DOUBLE)), lambda p: p > 0) AS p FROM x)
        SELECT page_id, list_filter(p, lambda v, i: NOT list_contains(p[1 : i - 1], v))[-1] AS amount FROM m"""),
}


# -- questions: phrases as rows, each scored against each question ------------------------------------------------------------------------

NORM = "trim(regexp_replace(regexp_replace(replace(lower({}), '+', ' plus '), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
WORD = "CASE WHEN a = b THEN 100 WHEN length(a) >= 4 AND length(b) >= 4 AND abs(length(a) - length(b)) <= 3 AND levenshtein(a, b) <= CASE WHEN length(b) <= 3 THEN 0 WHEN length(b) <= 5 THEN 1 WHEN length(b) <= 8 THEN 2 ELSE 3 END THEN 80 - 10 * levenshtein(a, b) END"
TOKEN = "CASE WHEN a = b THEN 100 WHEN levenshtein(a, b) <= CASE WHEN length(b) <= 2 THEN 0 WHEN length(b) <= 4 THEN 1 WHEN length(b) <= 7 THEN 2 ELSE 3 END THEN 80 - 10 * levenshtein(a, b) END"


def text_of(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def scored(asked: str, phrases: list[tuple[str, str, str]], word: str = WORD, letters: int = 1) -> str:
    """CTEs t (questions with norm and words w) and sc (a score for each question and phrase); ``phrases`` has (group, kind, phrase)."""
    rows = ", ".join(f"({text_of(g)}, {text_of(k)}, {i}, {text_of(x)})" for i, (g, k, x) in enumerate(phrases))
    each = word.replace("length(a)", "length(w[i + k])").replace("length(b)", "length(pw[k + 1])").replace("(a, b)", "(w[i + k], pw[k + 1])").replace("a = b", "w[i + k] = pw[k + 1]")
    runs = f"list_transform(range(1, len(w) - len(pw) + 2), lambda i: list_transform(range(0, len(pw)), lambda k: {each}))"
    best = f"list_max(list_transform({runs}, lambda x: CASE WHEN list_count(x) = len(x) THEN list_sum(x) + 20 * len(x) END))"
    return f"""WITH asked AS ({asked}), t AS (SELECT *, string_split(norm, ' ') AS w FROM (SELECT *, {NORM.format("text")} AS norm FROM asked)), ph(grp, kind, ord, phrase) AS (VALUES {rows}),
        sc AS (SELECT conv_id, turn, grp, kind, ord, CASE WHEN norm = '' THEN NULL WHEN contains(' ' || norm || ' ', ' ' || phrase || ' ') THEN 1000 + 100 * len(pw) + {letters} * length(phrase) ELSE {best} END AS score FROM t, (SELECT *, string_split(phrase, ' ') AS pw FROM ph))"""


def pick(key: str, values) -> str:
    return f"([{', '.join(map(text_of, values))}])[({key}) % {len(values)} + 1]"


def says(text: str, parts) -> str:
    return "(" + " OR ".join(f"contains({text}, {text_of(x)})" for x in parts) + ")"


TURNS = "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'"
ASKING = f"SELECT conv_id, turn, {pick('conv_id + turn', ASKED)} || ' ' || text AS text FROM conversations WHERE role = 'user'"
INTENTS = [*(("ACTION", a, x) for a, p in Q.ACTIONS.items() for x in p), *(("RENEWAL", "", x) for x in Q.RENEWAL), *(("SCREEN", n, x) for n, p in Q.SCREENS.items() for x in p), *(("SPENDING", "", x) for x in Q.SPENDING),
    *(("SAVINGS", "", x) for x in Q.SAVINGS), *(("HELP", "", x) for x in Q.HELP), *(("TOPIC", n, x) for n, p in Q.TOPICS.items() for x in p)]
INTENT = """, best AS (SELECT conv_id, turn, grp, arg_max(kind, (score, -ord)) AS kind, arg_min(kind, ord) AS early FROM sc WHERE score IS NOT NULL GROUP BY 1, 2, 3),
        wide AS (SELECT t.conv_id, t.turn, t.text, norm, max(kind) FILTER (grp = 'ACTION') AS act, count(*) FILTER (grp = 'RENEWAL') AS ren, max(early) FILTER (grp = 'SCREEN') AS screen, count(*) FILTER (grp = 'SPENDING') AS spend, count(*) FILTER (grp = 'SAVINGS') AS sav,
            count(*) FILTER (grp = 'HELP') AS help, max(kind) FILTER (grp = 'TOPIC') AS topic FROM t LEFT JOIN best USING (conv_id, turn) GROUP BY ALL),
        found AS (SELECT conv_id, turn, text, norm, CASE WHEN act IS NOT NULL THEN 'ACTION:' || act WHEN ren > 0 THEN 'RENEWAL_INFO' WHEN (regexp_matches(norm, '(^| )(open|show|navigate)( |$)') OR contains(norm, 'take me') OR contains(norm, 'go to')) AND screen IS NOT NULL THEN 'NAVIGATION:' || screen
            WHEN spend > 0 THEN 'SPENDING_INFO' WHEN sav > 0 THEN 'SAVINGS_INFO' WHEN help > 0 THEN 'APP_HELP' || coalesce(':' || topic, '') ELSE 'OTHER' END AS intent FROM wide)"""
MONTHS = r"""CASE WHEN TRY_CAST(regexp_extract(lower({0}), '\b([0-9]{{1,2}})\s*months?\b', 1) AS INTEGER) > 0 THEN TRY_CAST(regexp_extract(lower({0}), '\b([0-9]{{1,2}})\s*months?\b', 1) AS INTEGER)
        WHEN regexp_matches(lower({0}), '\b(one|a)\s+month\b') OR lower({0}) = 'month' THEN 1 WHEN regexp_matches(lower({0}), '\btwo\s+months?\b') THEN 2 WHEN regexp_matches(lower({0}), '\bthree\s+months?\b') THEN 3
        WHEN regexp_matches(lower({0}), '\bsix\s+months?\b') THEN 6 WHEN regexp_matches(lower({0}), '\byear\b') THEN 12 END"""
GOAL = r"CAST(nullif(TRY_CAST(regexp_extract({0}, '\b(?:save|cut|reduce|lower|get rid of) (?:about |around |roughly )?(?:kr ?)?([0-9]+)(?: ?kr)?(?: (?:a|per) month)?\b', 1) AS BIGINT), 0) * 100 AS BIGINT)"
SPEECH = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), {text_of(p)}) THEN '{tag}'" for tag, p in Q.SPEECH) + " ELSE 'en-US' END"
KIND = f"""CASE WHEN {says('norm', Q.PROTECTION)} THEN 'PROTECTION' WHEN {GOAL.format('norm')} IS NOT NULL THEN 'GOAL_AMOUNT' WHEN {says('q', Q.GOAL_PLAN)} THEN 'GOAL_PLAN' WHEN kind = 'NAVIGATION' THEN 'NAVIGATION' WHEN kind = 'APP_HELP' THEN 'HELP'
        WHEN months IS NOT NULL AND ({says('q', Q.SCENARIO)} OR {says('q', Q.SCENARIO_FOLLOW_UP)}) THEN 'SCENARIO' WHEN {says('q', Q.COMPARISON)} OR (conv_id % 2 = 0 AND turn % 4 = 0 AND {says('q', Q.COMPARISON_FOLLOW_UP)}) THEN 'COMPARISON' WHEN {says('q', Q.RANKING)} THEN 'RANKING'
        WHEN {says('q', Q.RECOMMENDATION)} OR (contains(q, 'why') AND {says('q', ['review', 'autopilot'])}) THEN 'RECOMMENDATION' WHEN {says('q', Q.DATA_HEALTH)} THEN 'DATA_HEALTH' WHEN kind = 'SPENDING_INFO' THEN 'SPENDING' WHEN kind = 'SAVINGS_INFO' THEN 'SAVINGS'
        WHEN {says('q', Q.SETUP)} THEN 'SETUP' WHEN {says('q', Q.RENEWAL_FOLLOW_UP)} THEN 'RENEWAL_FOLLOW_UP' WHEN kind = 'ACTION' THEN 'ACTION' WHEN kind = 'RENEWAL_INFO' THEN 'RENEWAL' ELSE 'REMOTE' END"""
NAMED = [("", s, a) for s in SERVICES for a in Q.aliases_of(s)]
POINT = "trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
ORACLES |= {
    "intent": scored(TURNS, INTENTS) + INTENT + " SELECT conv_id, turn, intent FROM found",
    "help_topics": scored(ASKING, [x for x in INTENTS if x[0] == "TOPIC"]) + " SELECT t.conv_id, t.turn, arg_max(kind, (score, -ord)) FILTER (score IS NOT NULL) AS topic FROM t JOIN sc USING (conv_id, turn) GROUP BY 1, 2",
    "answer_kinds": scored(ASKING, INTENTS) + INTENT + f""", m AS (SELECT conv_id, turn, intent, norm, lower(text) AS q, string_split(intent, ':')[1] AS kind, coalesce({MONTHS.format('text')}, CASE WHEN conv_id % 3 = 0 THEN 6 END) AS months FROM found) SELECT conv_id, turn, intent, {KIND} AS kind FROM m""",
    "scenario_months": f"WITH a AS (SELECT conv_id, turn, {pick('conv_id', ['for 3 months ', 'a year ', 'one month ', 'six months ', '0 months ', '12 month '])} || text AS text FROM conversations WHERE role = 'user') SELECT conv_id, turn, {MONTHS.format('text')} AS months FROM a",
    "goal_amount": f"WITH a AS (SELECT conv_id, turn, {NORM.format('text')} AS norm FROM (SELECT conv_id, turn, {pick('conv_id', ['save about 120 kr a month. ', 'please cut 12.50 per month, ', 'reduce 0 '])} || text AS text FROM conversations WHERE role = 'user')) SELECT conv_id, turn, {GOAL.format('norm')} AS goal_minor, {says('norm', Q.PROTECTION)} AS protects FROM a",
    "language_detect": f"SELECT conv_id, turn, {SPEECH} AS language FROM conversations WHERE role = 'user'",
    "fuzzy_entities": scored(f"SELECT conv_id, turn, {pick('conv_id', ['cancel netflx and ', 'is yt or apple tv dearer, ', 'pause disny ', ''])} || text AS text FROM conversations WHERE role = 'user'", NAMED, TOKEN, 0)
    + """, b AS (SELECT conv_id, turn, kind AS service, max(score) AS score, min(ord) AS k FROM sc WHERE score IS NOT NULL GROUP BY 1, 2, 3), f AS (SELECT conv_id, turn, kind, min(ord) AS first FROM sc GROUP BY 1, 2, 3)
        SELECT b.conv_id, b.turn, CAST(row_number() OVER (PARTITION BY b.conv_id, b.turn ORDER BY score DESC, first) - 1 AS INTEGER) AS rank, service, CAST(score AS INTEGER) AS score FROM b JOIN f ON f.conv_id = b.conv_id AND f.turn = b.turn AND f.kind = b.service""",
    "named_service": f"""WITH q AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(regexp_replace(regexp_replace(lower({pick('conv_id + turn', NAMES_ASKED)} || ' ' || text), '[+]', ' plus '), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda w: w <> '')) AS own FROM conversations WHERE role = 'user'),
        a(k, name) AS (VALUES {', '.join(f"({k}, {text_of(a)})" for k, s in enumerate(FINDABLE) for a in Q.plain_aliases(*s))}), whole AS (SELECT conv_id, turn, min(k) AS k FROM q, a WHERE list_has_all(own, string_split(name, ' ')) GROUP BY ALL),
        c AS (SELECT k, name FROM a UNION SELECT k, unnest(string_split(name, ' ')) FROM a), d AS (SELECT conv_id, turn, k, levenshtein(w, name) AS far, CASE WHEN length(name) <= 4 THEN 1 WHEN length(name) <= 7 THEN 2 ELSE 3 END AS edits FROM (SELECT conv_id, turn, unnest(own) AS w FROM q), c),
        near AS (SELECT conv_id, turn, arg_min(k, (far, k)) AS k FROM d WHERE far <= edits GROUP BY ALL) SELECT q.conv_id, q.turn, coalesce(whole.k, near.k) AS service FROM q LEFT JOIN whole USING (conv_id, turn) LEFT JOIN near USING (conv_id, turn)""",
    "word_matches": sql("turns", """, w AS (SELECT DISTINCT unnest(string_split(norm, ' ')) AS word FROM turns) SELECT word, target, word <> '' AND target <> '' AND (word = target OR levenshtein(word, target) <= CASE WHEN length(target) <= 3 THEN 0 WHEN length(target) <= 5 THEN 1 WHEN length(target) <= 8 THEN 2 ELSE 3 END) AS matches
        FROM w, (SELECT unnest(['the','canel','thing','']) AS target)"""),
    "conversation_memory": f"""WITH a AS (SELECT *, conv_id + turn AS k, {POINT} AS q FROM ({ASKING})), m AS (SELECT *, CASE k % 5 WHEN 0 THEN [k] WHEN 2 THEN [k, k + 1, k + 2] ELSE [] END AS ids, {MONTHS.format('text')} AS mo FROM a),
        b AS (SELECT *, last_value(CASE WHEN len(ids) > 0 THEN ids[-1] END IGNORE NULLS) OVER w AS last_id, last_value(CASE WHEN len(ids) > 1 THEN ids[1:2] END IGNORE NULLS) OVER w AS both_ids, last_value(mo IGNORE NULLS) OVER w AS months_before
            FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT conv_id, turn, last_id, array_to_string(both_ids, ',') AS compared, CAST(months_before AS INTEGER) AS months_before, coalesce(ids[1], CASE WHEN regexp_matches(q, '(^| )(first|former)( |$)') THEN coalesce(both_ids[1], last_id) WHEN regexp_matches(q, '(^| )(second|latter)( |$)') THEN coalesce(both_ids[2], last_id)
            WHEN regexp_matches(q, '(^| )(it|that|this one|the service|the subscription)( |$)') THEN last_id END) AS about FROM b""",
}


# -- refreshes: what three runs leave, each run's tables written out ----------------------------------------------------------------------


def _second(name: str) -> str:
    """A CTE of the votes over the second run's evidence."""
    text = TABLES[name]
    for other in ("good", "votes", "pairs", "won"):
        text = re.sub(rf"\b{other}\b", f"{other}2", text)
    return text


STRONG = "(verification = 'authoritative-provider' OR (verification = 'multi-source' AND by_agreement AND source_count >= 2))"
K = "service, plan, route, country, currency"
FOUND = (
    sql("resolved", ", good2 AS (SELECT * FROM good WHERE country = 'NO' AND line >= 3)")
    + "".join(f", {n}2 AS ({_second(n)})" for n in ("votes", "pairs", "won", "resolved"))
    + f""", cards AS ({ORACLES["page_card_prices"]}), r1 AS (SELECT * FROM resolved WHERE country IN ('NO','SE')), times AS (SELECT TIMESTAMP '1999-01-01' AS t1, TIMESTAMP '1999-01-02' AS t2),
    stored1 AS (SELECT {K}, price_minor, kind AS source FROM r1 WHERE {STRONG}),
    items1 AS (SELECT {K}, price_minor, kind AS source, ord FROM r1 UNION ALL SELECT page_id + 1000000, plan, 'direct', 'DK', 'DKK', CAST(round(amount * 100) AS BIGINT), 'page', page_id FROM cards),
    items2 AS (SELECT {K}, CASE WHEN {STRONG} OR o.price_minor IS NULL THEN f.price_minor ELSE o.price_minor END AS price_minor, CASE WHEN {STRONG} OR o.price_minor IS NULL THEN f.kind ELSE o.source END AS source, CASE WHEN {STRONG} OR o.price_minor IS NULL THEN t2 ELSE t1 END AS updated_at, f.ord
        FROM resolved2 f FULL JOIN (SELECT * FROM stored1) o USING ({K}), times),
    stored2 AS (SELECT {K}, coalesce(f.price_minor, o.price_minor) AS price_minor, coalesce(f.kind, o.source) AS source, CASE WHEN f.price_minor IS NOT NULL AND f.price_minor IS DISTINCT FROM o.price_minor THEN t2 ELSE t1 END AS verified_at, CASE WHEN f.price_minor IS NULL THEN t1 ELSE t2 END AS checked_at
        FROM (SELECT * FROM resolved2 WHERE {STRONG}) f FULL JOIN stored1 o USING ({K}), times),
    held AS (SELECT {K}, price_minor, source, updated_at FROM items2 UNION ALL SELECT {K}, price_minor, source, t1 FROM items1, times WHERE country = 'DK')"""
)


def named(rows: str) -> str:
    """Sources of each country in the order in which they first appear, how many items there are and how new they are."""
    return f"(SELECT country, string_agg(source, ',' ORDER BY place) AS source, sum(n) AS n, max(newest) AS newest FROM (SELECT country, source, count(*) AS n, max(updated_at) AS newest, min((ord IS NULL, coalesce(ord, 0), service, plan, route, currency)) AS place FROM {rows} GROUP BY ALL) GROUP BY 1)"


ORACLES |= {
    "price_refresh_items": FOUND + " SELECT * FROM held",
    "price_refresh_stored": FOUND + " SELECT * FROM stored2",
    "price_refresh": FOUND + f""", one AS {named("(SELECT *, t1 AS updated_at FROM items1, times)")}, two AS {named("items2")},
        s(run, country, outcome) AS (VALUES (1, 'NO', 'refreshed'), (1, 'SE', 'refreshed'), (1, 'DK', 'refreshed'), (1, 'XX', 'unsupported'), (2, 'NO', 'refreshed'), (2, 'SE', 'refreshed'), (2, 'DK', 'stale'), (2, 'XX', 'unsupported'), (2, 'US', 'refreshed'), (3, 'NO', 'cached'), (3, 'SE', 'cached'), (3, 'DK', 'stale'), (3, 'US', 'cached'))
        SELECT run, s.country, outcome, CASE s.country WHEN 'NO' THEN 'NOK' WHEN 'SE' THEN 'SEK' WHEN 'DK' THEN 'DKK' WHEN 'US' THEN 'USD' ELSE '' END AS currency, CASE WHEN s.country = 'XX' AND run = 1 THEN t1 ELSE coalesce(f.newest, t2) END AS updated_at,
        coalesce(f.source, CASE s.country WHEN 'XX' THEN 'unsupported-currency-map' ELSE 'no-exact-provider-price-found' END) AS source, CAST(coalesce(f.n, 0) AS BIGINT) AS n_items
        FROM s, times LEFT JOIN (SELECT 1 AS r, * FROM one UNION ALL SELECT 2, * FROM two) f ON f.country = s.country AND f.r = CASE WHEN run = 1 OR s.country = 'DK' THEN 1 ELSE 2 END""",
}
