"""Prices in the text of a page, as column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from subledger.functions.text import html_to_text, let, parse_number

# How each currency is written on pages.
CURRENCY_PATTERNS = {
    "USD": r"(?:US\$|\$|USD)", "CAD": r"(?:CA\$|CAD)", "MXN": r"(?:MX\$|MXN)", "BRL": r"(?:R\$|BRL)", "ARS": r"(?:ARS|\$)", "GBP": "(?:£|GBP)", "EUR": "(?:€|EUR)",
    "NOK": "(?:kr|NOK)", "SEK": "(?:kr|SEK)", "DKK": "(?:kr|DKK)", "ISK": "(?:kr|ISK)", "CHF": "(?:CHF)", "PLN": "(?:zł|PLN)", "CZK": "(?:Kč|CZK)", "HUF": "(?:Ft|HUF)", "RON": "(?:lei|RON)",
    "AUD": r"(?:A\$|AUD)", "NZD": r"(?:NZ\$|NZD)", "JPY": "(?:¥|JPY)", "KRW": "(?:₩|KRW)", "CNY": "(?:¥|CNY)", "HKD": r"(?:HK\$|HKD)", "TWD": r"(?:NT\$|TWD)", "SGD": r"(?:S\$|SGD)", "INR": "(?:₹|INR)",
    "IDR": "(?:Rp|IDR)", "MYR": "(?:RM|MYR)", "THB": "(?:฿|THB)", "PHP": "(?:₱|PHP)", "VND": "(?:₫|VND)", "AED": "(?:AED)", "SAR": r"(?:SAR|ر\.س)", "ILS": "(?:₪|ILS)", "TRY": "(?:₺|TRY)", "UAH": "(?:₴|UAH)", "ZAR": "(?:R|ZAR)",
}
# What months are called next to a price.
MONTH_WORDS = "(?:month|monthly|måned|månad|monat|mese|mes|mois|maand)"


def currency_pattern(currency: str) -> str:
    return CURRENCY_PATTERNS.get(currency, f"(?:{currency})")


def sections(html: Column, pattern: str) -> Column:
    """What follows each match of ``pattern``, up to the next one."""
    return let(F.split(html, pattern, -1), lambda parts: F.slice(parts, F.lit(2), F.size(parts)))


def price_near_plan(text: Column, plans: list[str], currency: str, whole: bool = False) -> Column:
    """Array of (plan, amount) for plans with a price close by: after the name and monthly, or before the name.

    A plan's name doesn't count where a longer plan's name begins with it, nor, if ``whole``, inside a longer word. The first of four patterns with an amount above 0 counts; amounts that several plans come to are dropped.
    """
    money, number = currency_pattern(currency), r"([\d.,\s]+)"
    ordered = sorted(plans, key=lambda p: -len(p))

    def name(plan: str) -> str:
        longer = [re.escape(o[len(plan) :].strip()).replace(r"\ ", r"\s+") for o in ordered if len(o) > len(plan) and o.lower().startswith(plan.lower())]
        ends = (r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])") if whole else ("", "")
        return ends[0] + re.escape(plan).replace(r"\ ", " ") + ends[1] + (rf"(?!\s+(?:{'|'.join(longer)}))" if any(longer) else "")

    def amount(plan: str) -> Column:
        p = name(plan)
        tries = (rf"{p}.{{0,120}}?{money}\s*{number}.{{0,40}}?{MONTH_WORDS}", rf"{p}.{{0,120}}?{number}\s*{money}.{{0,40}}?{MONTH_WORDS}", rf"{money}\s*{number}.{{0,70}}?{p}", rf"{number}\s*{money}.{{0,70}}?{p}")
        found = (let(parse_number(F.regexp_extract(text, "(?iu)" + t, 1)), lambda x: F.when(x > 0, x)) for t in tries)
        return F.coalesce(*found)

    each = F.array(*(F.struct(F.lit(p).alias("plan"), amount(p).alias("amount")) for p in ordered))
    known = F.filter(each, lambda x: x["amount"].isNotNull())
    return let(known, lambda rows: F.filter(rows, lambda x: F.size(F.filter(rows, lambda y: y["amount"] == x["amount"])) == 1))


def faq_prices(html: Column, currency: str) -> Column:
    """Array of (plan, amount) from the answer on what the plans cost, in the question list of a page's embedded data; empty where there is none."""
    data = F.regexp_extract(html, r'(?is)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    entries = F.from_json(F.get_json_object(data, "$.props.pageProps.components.faq.faqEntry"), "array<struct<question:string,answer:string>>")
    asked = F.filter(entries, lambda e: e["question"].rlike("(?i)how much is spotify premium") & e["answer"].isNotNull())
    pattern = rf"(?i)Premium\s+([A-Za-z][A-Za-z -]*?)\s+plan\s+costs\s+([\d.,\s]+)\s*{currency_pattern(currency)}\s+per\s+month"

    def rows(answer: Column) -> Column:
        names, amounts = (F.regexp_extract_all(answer, F.lit(pattern), F.lit(k)) for k in (1, 2))
        pairs = F.zip_with(names, amounts, lambda n, a: F.struct(F.btrim(n).alias("plan"), parse_number(a).alias("amount")))
        return F.filter(pairs, lambda x: x["amount"] > 0)

    none = F.array().cast("array<struct<plan:string,amount:double>>")
    return F.coalesce(let(F.get(asked, 0)["answer"], rows), none)


def embedded_market(html: Column) -> Column:
    """The two-letter market in a page's first embedded data block; null without one."""
    block = F.regexp_extract(html, r"(?s)AF_initDataCallback\(\{key: 'ds:0'(.*?)(?:</script>|\z)", 1)
    return F.nullif(F.regexp_extract(block, r'data:\s*\[\[\s*null\s*,\s*null\s*,\s*null\s*,\s*\d+\s*,\s*\d+\s*,\s*null\s*,\s*"([A-Z]{2})"', 1), F.lit(""))


def unanimous_price(text: Column, patterns: list[str]) -> Column:
    """The one amount that all matches of all patterns (group 1) come to; null if there are none or several."""
    raw = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit("(?iu)" + p), F.lit(1)) for p in patterns)))
    amounts = F.array_distinct(F.filter(F.transform(raw, parse_number), lambda x: x > 0))
    return let(amounts, lambda a: F.when(F.size(a) == 1, F.get(a, 0)))


# What a monthly subscription is called next to its price on the Norwegian page.
NORWAY_MONTHLY = [
    r"Få\s+Apple TV\s+for\s+bare\s+(?:kr|NOK)\s*([\d.,]+)\s+per\s+måned",
    r"Apple TV-abonnementet.{0,180}?(?:kr|NOK)\s*([\d.,]+)\s+per\s+måned",
    r"månedsabonnement\s+koster\s+bare\s+(?:kr|NOK)\s*([\d.,]+)\s+per\s+måned",
]


def price_range(text: Column, currency: str) -> Column:
    """Struct of the lowest and highest monthly amount that a page names as a range; null without one."""
    money, number, to = currency_pattern(currency), r"([\d.,\s]+)", r"(?:to|til|–|-)"
    tries = (
        rf"(?iu)(?:plans?\s+(?:range|start)|subscriptions?\s+from|abonnementer\s+fra|priser\s+fra|from)\s*{money}?\s*{number}.{{0,120}}?{to}\s*{money}?\s*{number}",
        rf"(?iu){money}\s*{number}.{{0,100}}?{to}\s*{money}\s*{number}.{{0,60}}?{MONTH_WORDS}",
    )
    ends = (F.struct(parse_number(F.regexp_extract(text, t, 1)).alias("low"), parse_number(F.regexp_extract(text, t, 2)).alias("high")) for t in tries)
    return F.coalesce(*(let(e, lambda x: F.when((x["low"] > 0) & (x["high"] >= x["low"]), x)) for e in ends))


PRICES = "array<struct<plan:string,amount:double>>"


def _none() -> Column:
    return F.array().cast(PRICES)


def _pairs(names: Column, amounts: Column) -> Column:
    """(plan, amount) of two arrays, without those that have no amount above 0."""
    rows = F.zip_with(names, amounts, lambda n, a: F.struct(F.btrim(n).alias("plan"), parse_number(a).alias("amount")))
    return F.filter(rows, lambda x: x["amount"] > 0)


def recurring_prices(text: Column, plans: list[str], currency: str) -> Column:
    """Array of (plan, amount): the price that an introductory offer turns into, named by "then" or "after"; without one, the price near the plan's name.

    What follows a plan's name up to another plan's comes first; only without a price there is it looked for beyond, and before the name, which then doesn't count inside a longer word.
    """
    money, number = currency_pattern(currency), r"([\d.,\s]+)"

    def amount(plan: str) -> Column:
        name, others = re.escape(plan), "|".join(re.escape(p) for p in plans if p != plan)
        own, whole = (f"(?:(?!{others}).)" if others else "."), rf"(?<![\p{{L}}\p{{N}}]){name}(?![\p{{L}}\p{{N}}])"
        offer = lambda name, any_: rf"{name}{any_}{{0,220}}?(?:then|after|deretter){any_}{{0,40}}?"
        prices = lambda lead: (rf"(?iu){lead}{money}\s*{number}.{{0,30}}?{MONTH_WORDS}", rf"(?iu){lead}{number}\s*{money}.{{0,30}}?{MONTH_WORDS}")
        near = (rf"(?iu){name}{own}{{0,120}}?{money}\s*{number}.{{0,40}}?{MONTH_WORDS}", rf"(?iu){name}{own}{{0,120}}?{number}\s*{money}.{{0,40}}?{MONTH_WORDS}")
        tries = (*prices(offer(name, own)), *near, *prices(offer(whole, ".")))
        found = [let(parse_number(F.regexp_extract(text, t, 1)), lambda x: F.when(x > 0, x)) for t in tries]
        return F.coalesce(*found, F.get(price_near_plan(text, [plan], currency, whole=True), 0)["amount"])

    each = F.array(*(F.struct(F.lit(p).alias("plan"), amount(p).alias("amount")) for p in plans))
    return F.filter(each, lambda x: x["amount"] > 0)


def storage_tiers(html: Column, currency: str) -> Column:
    """Array of (plan, amount) of the storage plans in a page's third embedded data block: monthly ones in the currency, in millionths there; a plan with an assistant is named after its tier."""
    block = F.regexp_extract(html, r"(?s)AF_initDataCallback\(\{key: 'ds:2'(.*?)(?:</script>|\z)", 1)
    # A record: size, then [millionths, shown price, currency], then [number, product id, ...]; its section ends where the next one begins.
    record = r'\["\d+","([^"]+)"\],2,\["(\d+)","[^"]+","([A-Z]{3})"\],\["\d+","([^"]+)","[^"]+"\],"[^"]+","[^"]+"'
    part = lambda k: F.regexp_extract_all(block, F.lit(record), F.lit(k))
    rest = sections(F.regexp_replace(block, record, "\x01"), "\x01")  # what follows each record
    rows = F.arrays_zip(part(1).alias("size"), part(2).alias("micros"), part(3).alias("currency"), part(4).alias("product"))
    counted = F.transform(rows, lambda r, i: F.struct(r["size"].alias("size"), r["micros"].cast("double").alias("micros"), (r["currency"] == currency).alias("here"), r["product"].alias("product"), F.get(rest, i).alias("rest")))
    good = F.filter(counted, lambda r: r["here"] & ~r["product"].endswith(".annual") & (r["micros"] > 0))

    def named(r: Column) -> Column:
        tier = F.nullif(F.regexp_extract(r["rest"], '"(Google AI (?:Plus|Pro|Ultra))"', 1), F.lit(""))
        return F.struct(F.coalesce(F.concat(tier, F.lit(" — "), r["size"]), F.concat(F.lit("Storage "), r["size"])).alias("plan"), (r["micros"] / 1_000_000).alias("amount"))

    return F.transform(good, named)


# What a month is called in the embedded data of one service.
PERIODS = ("måned", "månad", "month", "monthly", "mois", "mese", "mês", "maand", "kuukausi")


# What one service calls its plans, in lower case.
STRUCTURED_NAMES = {
    "basis med reklame": "Basic With Ads", "basic med reklam": "Basic With Ads", "basis med reklamer": "Basic With Ads", "basic avec pub": "Basic With Ads", "base con pubblicità": "Basic With Ads",
    "basic com anúncios": "Basic With Ads", "basic met reclame": "Basic With Ads", "basic (mainoksilla)": "Basic With Ads", "standard": "Standard", "standaard": "Standard", "premium": "Premium",
}
# The keys of a product record, in its order; those named "plain" hold an object with the text.
RECORD = (("productName", "plain"), ("price", "open"), ("format", "text"), ("currencyCode", "code"), ("amount", "plain"), ("period", "plain"), ("currency", "plain"), ("", "close"), ("pricePlan", "open"), ("id", "id"))


def _record() -> str:
    """A product record as a pattern; its groups are name, currency code, amount, period, currency and plan id."""
    forms = {"plain": r'\{[^{}]*"plainText"\s*:\s*"([^"]+)"\s*\}', "open": r"\{", "text": r'"[^"]*"', "code": r'"([A-Z]{3})"', "id": r'"([^"]+)"\s*\}', "close": r"\}"}
    pattern, comma = "", False
    for key, form in RECORD:
        if form != "close":
            pattern += (r"\s*,\s*" if comma else r"\s*" if pattern else "") + rf'"{key}"\s*:\s*'
        else:
            pattern += r"\s*"
        pattern += forms[form]
        comma = form != "open"
    return pattern


def structured_plans(html: Column, currency: str) -> Column:
    """Array of (plan, amount, plan_id) of products in a page's embedded JSON, whose name, amount, period and currency are objects with a plain text: monthly ones in the currency, each once. Names that are known in several languages get one name."""
    parts = [F.regexp_extract_all(html, F.lit(_record()), F.lit(k)) for k in (1, 2, 3, 4, 6)]
    rows = F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("name", "code", "amount", "period", "id"), strict=True)))
    known = F.create_map(*(F.lit(x) for pair in STRUCTURED_NAMES.items() for x in pair))

    def row(r: Column) -> Column:
        amount = F.regexp_replace(F.regexp_replace(r["amount"], r"[\s\u00a0]", ""), "^([^,]*),", "$1.").try_cast("double")
        good = (r["code"] == currency) & F.lower(F.btrim(r["period"])).isin(*PERIODS) & (amount > 0)
        plan = F.coalesce(F.element_at(known, F.lower(F.btrim(r["name"]))), F.btrim(r["name"]))
        return F.when(good, F.struct(plan.alias("plan"), amount.alias("amount"), r["id"].alias("plan_id")))

    return F.array_distinct(F.filter(F.transform(rows, row), lambda x: x.isNotNull()))


def footnote_prices(html: Column, currency: str) -> Column:
    """Array of (plan, amount) from the Norwegian footnote that states the three current prices together; empty if one is missing, or in another currency."""
    number, month = r"([0-9][0-9\s.,]*)\s*kr\s+per\s+m[åa]ned\s+for\s+", r"(?iu)for\s+[øo]yeblikket\s+"
    pattern = rf"{month}{number}Premium,\s*{number}Standard\s+eller\s+{number}Standard\s+med\s+reklame"
    text = html_to_text(html)
    rows = F.array(*(F.struct(F.lit(plan).alias("plan"), parse_number(F.regexp_extract(text, pattern, k)).alias("amount")) for k, plan in enumerate(("Premium", "Standard", "Standard with Ads"), 1)))
    whole = let(F.filter(rows, lambda x: x["amount"] > 0), lambda x: F.when(F.size(x) == 3, x))
    return F.coalesce(whole, _none()) if currency == "NOK" else _none()


def _spanned(name: str, text: str, tag: str = "span") -> str:
    """A pattern: an element that has a class ``name`` and holds just ``text``."""
    return rf'<{tag}\b[^>]*class="[^"]*\b{name}\b[^"]*"[^>]*>\s*{text}\s*</{tag}>'


def basic_monthly(html: Column, currency: str) -> Column:
    """The monthly amount of the Basic product card: in one card the product's title, then its list price, then that price's unit "per måned"; null for yearly cards, other prices of a card and other currencies."""
    if currency != "NOK":
        return F.lit(None).cast("double")
    cards = sections(html, r'(?i)<div\b[^>]*class="[^"]*\bsku\b[^"]*"[^>]*>')
    card = "(?isu)" + _spanned("oc-product-title", "Microsoft 365 Basic", "h3") + ".*?" + _spanned("oc-displayListPrice", r"kr\s*([0-9][0-9\s.,]*)") + ".{0,500}?" + _spanned("oc-displayUnit", "per måned")
    return F.get(F.filter(F.transform(cards, lambda c: parse_number(F.regexp_extract(c, card, 1))), lambda x: x > 0), 0)


def comparison_prices(html: Column, currency: str) -> Column:
    """Array of (plan, amount): after each product's heading the first price heading that names an amount "/måned", before the next product's heading; amounts elsewhere in a section don't count."""
    if currency != "NOK":
        return _none()
    heading = r'(?isu)<div\b[^>]*class="[^"]*\bsku1price\b[^"]*\bprice-heading\b[^"]*"[^>]*>\s*kr\s*([0-9][0-9\s.,]*)\s*/måned\s*</div>'
    plan = lambda s: F.regexp_extract(s, r"(?is)^\s*Microsoft 365 (Personal|Family|Premium)\s*</h2>", 1)
    rows = F.transform(sections(html, r"(?i)<h2\b[^>]*>"), lambda s: F.struct(plan(s).alias("plan"), parse_number(F.regexp_extract(s, heading, 1)).alias("amount")))
    return F.array_distinct(F.filter(rows, lambda x: (x["plan"] != "") & (x["amount"] > 0)))


# Markers of the storage tiers on a page, in order, and their names.
TIERS = {"plan-50gb": "50 GB", "plan-200gb": "200 GB", "plan-2tb": "2 TB", "plan-6tb": "6 TB", "plan-12tb": "12 TB"}


def tier_prices(html: Column, currency: str) -> Column:
    """Array of (plan, amount) of all five storage tiers; empty unless each one's block, from its marker to the next, names exactly one amount."""
    money = currency_pattern(currency)
    blocks = F.split(html, r'(?=[ "]plan-(?:50gb|200gb|2tb|6tb|12tb)\b)')

    def tier(marker: str, name: str) -> Column:
        own = F.get(F.filter(blocks, lambda b: F.substring(b, 2, len(marker)) == marker), 0)
        text = F.replace(html_to_text(own), F.lit("\u00a0"), F.lit(" "))
        amount = unanimous_price(text, [rf"{money}\s*([\d][\d.,]*)", rf"([\d][\d.,]*)\s*{money}"])
        return F.struct(F.lit(name).alias("plan"), amount.alias("amount"))

    rows = F.filter(F.array(*(tier(m, n) for m, n in TIERS.items())), lambda x: x["amount"].isNotNull())
    return let(rows, lambda x: F.when(F.size(x) == len(TIERS), x).otherwise(_none()))


def last_amounts(text: Column, currency: str) -> Column:
    """The last distinct amount that a card names: an offer comes first, what it turns into last."""
    money = currency_pattern(currency)
    raw = F.regexp_extract_all(text, F.lit(rf"(?iu){money}\s*([\d][\d.,]*)|([\d][\d.,]*)\s*{money}"), F.lit(0))
    amounts = F.array_distinct(F.filter(F.transform(raw, parse_number), lambda x: x > 0))
    return F.when(F.size(amounts) > 0, F.element_at(amounts, -1))


# Other names of plans.
PLAN_NAMES = {"basic": "Basic", "basis": "Basic", "standard": "Standard", "premium": "Premium", "standard with ads": "Standard with Ads", "standard med reklame": "Standard with Ads"}


def plan_name(raw: Column) -> Column:
    """A plan's usual name; null for an unknown one."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in PLAN_NAMES.items() for x in kv)), F.lower(F.btrim(raw)))


def page_language(html: Column) -> Column:
    """The language that a page declares, in lower case; null without one."""
    return F.nullif(F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*\blang=["']?([A-Za-z-]+)""", 1)), F.lit(""))


def card_recurring(html: Column, currency: str) -> Column:
    """Array of (plan, amount) of the Norwegian comparison cards: what is paid after the offer ("deretter betaler du") within a card, each once; offers, unknown plans and other currencies don't count."""
    # Each part begins at a card's link and ends where the next one begins.
    cards = sections(html, '(?i)data-testid="l4l_(?=(?:premium|standard|basic)")')
    title = lambda c: F.regexp_extract(c, r"(?is)^[^>]*>([^<]*)</a>", 1)
    # Fixed value: within how many characters of a card's title the words stand after which the lasting price follows.
    reach = 900
    after = rf"(?isu)^.{{0,{reach}}}?deretter\s+betaler\s+du(?:<[^>]+>|\s)*([0-9][0-9\s.,]*)\s*(?:<[^>]+>\s*)*kr\s+per\s+m[åa]ned"
    amount = lambda c: parse_number(F.regexp_extract(F.regexp_replace(c, r"(?is)^.*?</a>", ""), after, 1))
    rows = F.transform(cards, lambda c: F.struct(plan_name(title(c)).alias("plan"), amount(c).alias("amount")))
    known = F.filter(rows, lambda x: x["plan"].isin("Premium", "Standard", "Standard with Ads") & (x["amount"] > 0))
    return F.array_distinct(known) if currency == "NOK" else _none()


# Headings of the two plans on the Chinese comparison page.
CHINA_PLANS = {"个人版": "Personal", "家庭版": "Family"}


def china_prices(html: Column, currency: str) -> Column:
    """Array of (plan, amount) of both plans on the Chinese comparison page: the one monthly amount between a heading, which the page has once, and the first yearly amount after it; empty if either plan lacks it."""

    def plan(title: str, name: str) -> Column:
        around = F.split(html, rf"(?i)<h2\b[^>]*>\s*Microsoft 365 {title}\s*</h2>")
        tail = F.when(F.size(around) == 2, F.get(around, 1))
        before_year = F.split(tail, r"¥\s*\d[\d.,]*\s*/\s*年", 2)
        monthly = unanimous_price(F.when(F.size(before_year) == 2, F.get(before_year, 0)), [r"¥\s*(\d[\d.,]*)\s*/\s*月"])
        return F.struct(F.lit(name).alias("plan"), monthly.alias("amount"))

    rows = F.filter(F.array(*(plan(t, n) for t, n in CHINA_PLANS.items())), lambda x: x["amount"].isNotNull())
    whole = let(rows, lambda x: F.when(F.size(x) == len(CHINA_PLANS), x))
    return F.coalesce(whole, _none()) if currency == "CNY" else _none()


# What a month is called on the membership card, and how the currencies of its pages are written there.
MEMBERSHIP_MONTH = ["per month", "/month", "per månad", "pro monat", "al mes", "par mois", "por mes", "por mês", "per maand"]
MEMBERSHIP_AMOUNTS = {"USD": [r"\$\s*(\d+(?:[.,]\d{1,2})?)", r"(\d+(?:[.,]\d{1,2})?)\s*USD\b"], "SEK": [r"(\d+(?:[.,]\d{1,2})?)\s*kr\b"], "EUR": [r"€\s*(\d+(?:[.,]\d{1,2})?)", r"(\d+(?:[.,]\d{1,2})?)\s*€"]}


def membership_monthly(html: Column, currency: str) -> Column:
    """The one amount of the first plan card of a membership page, if the card names a month; null for several amounts and for yearly cards. Other cards (students, years) don't count."""
    if currency not in MEMBERSHIP_AMOUNTS:
        return F.lit(None).cast("double")
    opened = F.split(html, r"""(?i)(?=<div\b[^>]*\bdata-a-input-name=["']ChoosePlanRadioButton["'])""")
    first = F.get(F.filter(opened, lambda c: c.rlike(r"""(?i)^<div\b[^>]*\bChoosePlanRadioButton\b[^>]*\bdata-index=["']1["']""")), 0)
    card = html_to_text(F.regexp_extract(first, r"(?is)^(<div\b[^>]*>.{0,2200}?</label>\s*</div>)", 1))
    monthly = F.exists(F.array(*map(F.lit, MEMBERSHIP_MONTH)), lambda m: F.lower(card).contains(m))
    return F.when(monthly, unanimous_price(card, MEMBERSHIP_AMOUNTS[currency]))
