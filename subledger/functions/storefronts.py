"""Prices in the pages of single storefronts, as column functions: array of (plan, amount), or one amount; empty or null where a page leaves any doubt."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from subledger.functions.pages import PRICES, currency_pattern, sections
from subledger.functions.text import html_to_text, let, parse_number
from subledger.functions.walks import objects_around, objects_with

#: White space of a page, the unbreakable kinds too.
S = r"[\s\u00a0\u202f]"

# Plan identities of embedded data and what they are called.
PREMIUM_PLANS = {"PREMIUM_INDIVIDUAL": "Individual", "PREMIUM_STUDENT": "Student", "PREMIUM_DUO": "Duo", "PREMIUM_FAMILY": "Family"}
# Names of plans in embedded field objects.
FIELD_PLANS = {"basic": "Basic", "basis": "Basic", "standard": "Standard", "premium": "Premium", "standard with ads": "Standard with Ads", "standard med reklame": "Standard with Ads"}
FIELD_PLANS_NEEDED = ("Basic", "Standard", "Premium")
# The product that a renewal price belongs to, and how the price of later months is written.
RENEWED = {"sellProductName": "SVIP会员", "sellSkuName": "连续包月", "sellGoodsName": "SVIP会员连续包月"}
RENEWED_PRICE = r"第\s*[0-9]+\s*个月起\s*([0-9]+(?:\.[0-9]{1,2})?)\s*元\s*/\s*月"
# Monthly prices by currency beside the name of the TV service ({n} is the number).
TV_MONTHLY = {
    "USD": [r"\$\s*{n}\s*(?:per\s+month|/\s*month)"],
    "SEK": [r"{n}\s*(?:kr|SEK)\s*(?:per\s+m[åa]nad|/\s*m[åa]nad)"],
    "DKK": [r"{n}\s*(?:kr\.?|DKK)\s*(?:pr\.?\s*m[åa]ned|/\s*m[åa]ned)"],
    "EUR": [
        r"€\s*{n}\s*(?:per\s+month|per\s+maand|pro\s+Monat|al\s+mese|al\s+mes|par\s+mois|por\s+m[eê]s|/\s*(?:month|maand|Monat|mese|mes|mois|m[eê]s|kk))",
        r"{n}\s*€\s*(?:per\s+month|per\s+maand|pro\s+Monat|im\s+Monat|al\s+mese|al\s+mes|par\s+mois|por\s+m[eê]s|kuussa|/\s*(?:month|maand|Monat|mese|mes|mois|m[eê]s|kk))",
    ],
}
# Monthly prices by currency in the video service's offer ({n} is the number).
VIDEO_MONTHLY = {
    "NOK": [r"{n}\s*(?:kr|NOK)\s*/\s*(?:måned|month)", r"(?:kr|NOK)\s*{n}\s*/\s*(?:måned|month)", r"{n}\s*(?:kr|NOK).{0,40}?(?:per|pr\.?)\s*(?:måned|month)", r"(?:kr|NOK)\s*{n}.{0,40}?(?:per|pr\.?)\s*(?:måned|month)"],
    "SEK": [r"{n}\s*(?:kr|SEK)\s*/\s*(?:månad|month)", r"(?:kr|SEK)\s*{n}\s*/\s*(?:månad|month)", r"{n}\s*(?:kr|SEK).{0,40}?per\s*(?:månad|month)"],
    "DKK": [r"{n}\s*(?:kr\.?|DKK)\s*/\s*(?:måned|month)", r"(?:kr\.?|DKK)\s*{n}\s*/\s*(?:måned|month)", r"{n}\s*(?:kr\.?|DKK).{0,40}?(?:per|pr\.?)\s*(?:måned|month)"],
    "USD": [r"\$\s*{n}\s*/\s*month", r"{n}\s*USD\s*/\s*month", r"\$\s*{n}.{0,40}?per\s*month", r"{n}\s*USD.{0,40}?per\s*month"],
    "EUR": [
        r"€\s*{n}\s*/\s*(?:month|monat|mois|mese|mês|maand|kuukausi)", r"{n}\s*€\s*/\s*(?:month|monat|mois|mese|mês|maand|kuukausi)",
        r"€\s*{n}.{0,40}?(?:per|pro|par|al|por)\s*(?:month|monat|mes|mois|mese|mês|maand|kuukausi)", r"{n}\s*€.{0,40}?(?:per|pro|par|al|por)\s*(?:month|monat|mes|mois|mese|mês|maand|kuukausi)",
    ],
}


def none() -> Column:
    return F.array().cast(PRICES)


def around(text: Column, pattern: str, before: int, after: int) -> Column:
    """For each match of ``pattern`` (without groups) the up to ``before`` characters before it and the up to ``after`` characters from its start on: array of (before, after)."""
    marks, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def cut(parts: Column, marks: Column) -> Column:
        lengths = F.transform(marks, lambda m, i: F.length(F.get(parts, i)) + F.when(i > 0, F.length(F.get(marks, i - 1))).otherwise(0))
        starts = F.transform(marks, lambda m, i: F.aggregate(F.slice(lengths, F.lit(1), i + 1), F.lit(0), lambda a, b: a + b))
        piece = lambda at, n: F.substring(text, at + 1, n)
        return F.transform(starts, lambda at: F.struct(piece(F.greatest(at - before, F.lit(0)), F.least(at, F.lit(before))).alias("before"), piece(at, F.lit(after)).alias("after")))

    return let(parts, lambda p: let(marks, lambda m: cut(p, m)))


def the_one(amounts: Column) -> Column:
    """The one amount above 0 that an array of texts comes to; null for none or several."""
    return let(F.array_distinct(F.filter(F.transform(amounts, parse_number), lambda x: x > 0)), lambda a: F.when(F.size(a) == 1, F.get(a, 0)))


def first_of_each(rows: Column) -> Column:
    """The first row of each plan."""
    return F.filter(rows, lambda r, i: ~F.exists(F.slice(rows, F.lit(1), i), lambda other: other["plan"] == r["plan"]))


def one_by_name(names: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), names)


def complete(found: Column, plans: Iterable[str]) -> Column:
    """One row for each of ``plans``; none at all if one of them has no amount, or two."""

    def amounts(plan: str) -> Column:
        return F.array_distinct(F.transform(F.filter(found, lambda r: r["plan"] == plan), lambda r: r["amount"]))

    each = {p: amounts(p) for p in plans}
    good = F.lit(True)
    for a in each.values():
        good = good & (F.size(a) == 1)
    return F.when(good, F.array(*(F.struct(F.lit(p).alias("plan"), F.get(a, 0).alias("amount")) for p, a in each.items()))).otherwise(none())


def embedded_plans(html: Column, currency: str, country: str | None = None) -> Column:
    """(plan, amount) of the recurring plans anywhere in a page's embedded components. Of a plan's prices the second one counts before the first and the heading's, since an introductory offer names the lasting price there.

    With a ``country`` the page's own must be the same. The first object with an amount above 0 in the currency gives a plan's amount.
    """
    data = F.regexp_extract(html, r'(?is)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    here = F.upper(F.btrim(F.get_json_object(data, "$.props.pageProps.basePageProps.country"))) == country.strip().upper() if country else F.lit(True)
    fields = "planId string, isRecurringProduct boolean, secondaryPriceDescription string, primaryPriceDescription string, subheaderPrice string"
    money, number = currency_pattern(currency), rf"([\d](?:[\d.,]|{S})*)"

    def amount(text: Column) -> Column:
        tries = (let(parse_number(F.regexp_extract(text, f"(?iu){p}", 1)), lambda x: F.when(x > 0, x)) for p in (rf"{money}{S}*{number}", rf"{number}{S}*{money}"))
        return F.coalesce(*tries)

    def row(text: Column) -> Column:
        plan = F.from_json(text, fields, {"allowSingleQuotes": "false"})
        price = F.coalesce(*(amount(plan[c]) for c in ("secondaryPriceDescription", "primaryPriceDescription", "subheaderPrice")))
        return F.struct(F.when(plan["isRecurringProduct"], one_by_name(plan["planId"], PREMIUM_PLANS)).alias("plan"), price.alias("amount"))

    found = F.transform(objects_with(F.get_json_object(data, "$.props.pageProps.components"), "planId"), row)
    good = F.filter(found, lambda r: r["plan"].isNotNull() & r["amount"].isNotNull())
    return F.when(F.coalesce(here, F.lit(False)), let(good, first_of_each)).otherwise(none())


def renewal_price(html: Column, currency: str) -> Column:
    """(plan, amount) of the one product that a page sells, from the price that it renews at in later months; never from its introductory or crossed-out price. Empty unless there is one such product, in CNY."""
    if currency != "CNY":
        return none()
    names = [*RENEWED, "sellGoodsDesc"]

    def row(text: Column) -> Column:
        product = F.from_json(text, ", ".join(f"{n} string" for n in names), {"allowSingleQuotes": "false"})
        price = F.regexp_extract(product["sellGoodsDesc"], RENEWED_PRICE, 1).try_cast("double")
        right = F.lit(True)
        for name, value in RENEWED.items():
            right = right & (product[name] == value)
        return F.when(right & (price > 0), F.array(F.struct(F.lit("SVIP").alias("plan"), price.alias("amount")))).otherwise(none())

    return let(objects_around(html, '"sellProductName"'), lambda o: F.when(F.size(o) == 1, F.coalesce(let(F.get(o, 0), row), none())).otherwise(none()))


def field_plans(html: Column, currency: str) -> Column:
    """(plan, amount) of the three plans that a page's field objects describe: monthly ones in the currency. A plan with two amounts counts as none, and without all three plans there is no answer. Only for NOK.

    A field object reaches from one ``"fields":{`` to the next, the last one 2200 characters beyond its first plan type.
    """
    if currency != "NOK":
        return none()
    kind = r'(?i)"planType"\s*:\s*\{\s*"fieldType"\s*:\s*"String"\s*,\s*"value"\s*:\s*"([^"]+)"\s*\}'
    blocks = F.slice(F.split(html, r'(?="fields": ?\{)', -1), F.when(html.rlike(r'^"fields": ?\{'), 1).otherwise(2), F.length(html) + 1)

    def named(value: Column) -> Column:
        return one_by_name(F.lower(F.btrim(value)), FIELD_PLANS)

    def field(block: Column, name: str) -> Column:
        return F.regexp_extract(block, rf'(?i)"{name}"\s*:\s*\{{[^{{}}]{{0,300}}?"value"\s*:\s*"([^"]*)"[^{{}}]{{0,300}}?\}}', 1)

    def rows(block: Column) -> Column:
        amount = parse_number(field(block, "planPriceAmount"))
        good = (field(block, "planPriceCurrency") == currency) & (F.lower(F.btrim(field(block, "billingFrequency"))) == "monthly") & (amount > 0)
        plans = F.transform(F.regexp_extract_all(block, F.lit(kind), F.lit(1)), lambda p: F.coalesce(named(p), named(field(block, "localizedPlanName"))))
        return F.when(good, F.transform(plans, lambda p: F.struct(p.alias("plan"), amount.alias("amount")))).otherwise(none())

    def bounded(all_blocks: Column) -> Column:
        last = F.size(all_blocks) - 1
        return F.transform(all_blocks, lambda b, i: F.when(i == last, F.substring(b, F.lit(1), F.regexp_instr(b, F.lit(kind)) + 2199)).otherwise(b))

    return let(let(blocks, bounded), lambda b: let(F.flatten(F.transform(b, rows)), lambda found: complete(found, FIELD_PLANS_NEEDED)))


# A card's id and its plan, what a month is called on cards, and how the Finnish card names the lasting price.
CARD_PLANS = {"basic": "Standard with Ads", "standard": "Standard", "premium": "Premium"}
CARD_MONTH = r"(?:month|monthly|monat|mois|mese|mes|mês|maand|m[eå]nad|m[åa]ned|m[eå]ned|kuukaudessa|kuukausi(?:hinta)?|md\.?|mo)"
CARD_LASTING = r"t[aä]m[aä]n\s+j[aä]lkeen[\s\S]{0,80}?kuukausihinta\s+on\s+"


def card_prices(html: Column, currency: str) -> Column:
    """(plan, amount) of the comparison cards, told apart by their ids in any language: the last distinct monthly amount of a card, since what an offer turns into comes last; one that is named as the lasting price comes after all others. The first card of a plan with an amount counts. Not for NOK.

    A card reaches to the next one, the last one 7000 characters.
    """
    if currency == "NOK":
        return none()
    money, number = currency_pattern(currency), rf"([\d](?:[\d.,]|{S})*)"
    mark = r"""(?i)(?=data-testid=["']l4l_(?:basic|standard|premium)["'])"""
    parts = F.split(html, mark, -1)

    def amounts(card: Column) -> Column:
        found = F.concat(*(F.regexp_extract_all(card, F.lit(f"(?iu){p}[\\s\\S]{{0,40}}?{CARD_MONTH}"), F.lit(1)) for p in (rf"{money}{S}*{number}", rf"{number}{S}*{money}")))
        usual = F.array_distinct(F.filter(F.transform(found, parse_number), lambda x: x > 0))
        lasting = parse_number(F.regexp_extract(card, rf"(?iu){CARD_LASTING}{number}{S}*{money}", 1))
        return F.when(lasting > 0, F.array(lasting)).otherwise(F.slice(usual, F.greatest(F.size(usual), F.lit(1)), F.lit(1)))

    def cards(all_parts: Column) -> Column:
        last = F.size(all_parts) - 1
        cut = F.transform(all_parts, lambda p, i: F.when(i == last, F.substring(p, 1, 7000)).otherwise(p))
        rows = F.transform(cut, lambda c: F.struct(one_by_name(F.lower(F.regexp_extract(c, r"""(?i)^data-testid=["']l4l_([a-z]+)["']""", 1)), CARD_PLANS).alias("plan"), F.get(amounts(c), 0).alias("amount")))
        return F.filter(rows, lambda r: r["plan"].isNotNull() & r["amount"].isNotNull())

    return F.coalesce(let(let(parts, cards), first_of_each), none())


# Titles of the office products, what a month is called in their cards, and how amounts are written there.
SKU_PLANS = {
    "microsoft 365 basic": "Basic", "microsoft 365 básico": "Basic", "microsoft 365 personal": "Personal", "microsoft 365 single": "Personal", "microsoft 365 personnel": "Personal", "microsoft 365 family": "Family",
    "microsoft 365 familia": "Family", "microsoft 365 famille": "Family", "microsoft 365 familiar": "Family", "microsoft 365 premium": "Premium",
}
SKU_PLANS_NEEDED = ("Basic", "Personal", "Family", "Premium")
SKU_MONTHS = ("/month", "/månad", "/måned", "/monat", "al mes", "/mois", "/mese", "/mês", "/maand", "/kuukausi")
SKU_AMOUNTS = {
    "USD": r"^\$\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)$",
    "SEK": r"^(?:kr\.?\s*)?([0-9][0-9\s.]*(?:,[0-9]{1,2})?)(?:\s*kr\.?)?$",
    "DKK": r"^(?:kr\.?\s*)?([0-9][0-9\s.]*(?:,[0-9]{1,2})?)(?:\s*kr\.?)?$",
    "EUR": r"^(?:€\s*)?([0-9][0-9\s.]*(?:[,.][0-9]{1,2})?)(?:\s*€)?$",
}


def sku_field(card: Column, name: str) -> Column:
    """The text of a card's first heading or span that has a class ``name``; empty without one."""
    text = html_to_text(F.regexp_extract(card, rf'(?is)<(?:h3|span)\b[^>]*class="[^"]*\b{name}\b[^"]*"[^>]*>(.*?)</(?:h3|span)>', 1))
    return F.btrim(F.regexp_replace(F.regexp_replace(text, "(?i)&#160;", " "), f"{S}+", " "))


def sku_prices(html: Column, currency: str) -> Column:
    """(plan, amount) of the four office products from their monthly cards, by title, list price and unit of one card, which reaches to the next one or 5000 characters. Empty unless each product has one amount."""
    if currency not in SKU_AMOUNTS:
        return none()

    def row(card: Column) -> Column:
        monthly = F.lower(sku_field(card, "oc-displayUnit")).isin(*SKU_MONTHS)
        price = F.btrim(F.regexp_replace(F.regexp_replace(sku_field(card, "oc-displayListPrice"), r"(?i)\bTTC\b", " "), r"\s+", " "))
        amount = parse_number(F.regexp_extract(price, SKU_AMOUNTS[currency], 1))
        return F.struct(F.when(monthly & (amount > 0), one_by_name(F.lower(sku_field(card, "oc-product-title")), SKU_PLANS)).alias("plan"), amount.alias("amount"))

    cards = F.transform(sections(html, r'(?i)<div\b[^>]*class="[^"]*\bsku\b[^"]*"[^>]*>'), lambda c: F.substring(c, 1, 5000))
    return F.coalesce(let(F.transform(cards, row), lambda found: complete(found, SKU_PLANS_NEEDED)), none())


# Titles of the options, how the id of a full option begins, and how the price after a trial is written.
OPTION_PLANS = {"Enkeltperson": "Individual", "Personlig": "Individual", "Familieabonnement": "Family", "Student": "Student"}
OPTION_PLANS_NEEDED = ("Individual", "Family", "Student")
OPTION_ID = "unlimited.P."
OPTION_PRICE = r"(?iu)Deretter[^0-9]{0,80}([0-9]+(?:,[0-9]{2})?)\s*kr[^A-Za-zÀ-ž0-9]{0,20}måned"


def option_prices(html: Column, currency: str) -> Column:
    """(plan, amount) of the three full options that a page's renderers offer, by the price after the trial; smaller options are told apart by their id, not their title. Empty unless each plan has one amount. Only for NOK.

    A renderer reaches to the next one, the last one 10000 characters.
    """
    if currency != "NOK":
        return none()
    marker = '"optionItemRenderer":'

    def rows(blocks: Column) -> Column:
        last = F.size(blocks) - 1
        cut = F.transform(blocks, lambda b, i: F.when(i == last, F.substring(b, 1, 10_000 - len(marker))).otherwise(b))

        def row(b: Column) -> Column:
            full = F.regexp_extract(b, '"optionId":"([^"]+)"', 1).startswith(OPTION_ID)
            amount = parse_number(F.regexp_extract(b, OPTION_PRICE, 1))
            title = F.regexp_extract(b, r'"title":\{"runs":\[\{"text":"([^"]+)"\}', 1)
            return F.struct(F.when(full & (amount > 0), one_by_name(title, OPTION_PLANS)).alias("plan"), amount.alias("amount"))

        return F.transform(cut, row)

    return F.coalesce(let(let(sections(html, marker), rows), lambda found: complete(found, OPTION_PLANS_NEEDED)), none())


# Ids of the gallery's plans, the id of another offer there, monthly prices by currency ({n} is the number), and how the questions below a Chinese gallery state the students' price.
GALLERY_PLANS = {"individual": "Individual", "family": "Family", "student": "Student"}
GALLERY_OTHER = "apple one"
GALLERY_MONTHLY = {
    "NOK": [r"(?:kr|NOK)\s*{n}\s+(?:per|pr\.?)\s+m[åa]ned", r"{n}\s*(?:kr|NOK)\s+(?:per|pr\.?)\s+m[åa]ned"],
    "SEK": [r"(?:kr|SEK)\s*{n}\s+(?:per|i)\s+m[åa]nad", r"{n}\s*(?:kr|SEK)\s+(?:per|i)\s+m[åa]nad", r"{n}\s*(?:kr|SEK)\s*/\s*m[åa]nad"],
    "DKK": [r"(?:kr\.?|DKK)\s*{n}\s+(?:pr\.?|per)\s+m[åa]ned", r"{n}\s*(?:kr\.?|DKK)\s+(?:pr\.?|per)\s+m[åa]ned", r"{n}\s*(?:kr\.?|DKK)\s*/\s*m[åa]ned"],
    "USD": [r"\$\s*{n}\s*/\s*month", r"\$\s*{n}\s+per\s+month", r"USD\s*{n}\s+(?:/|per)\s*month"],
    "EUR": [
        r"€\s*{n}\s*(?:/\s*(?:month|monat|mois|mese|mes|m[eê]s|maand|m[åa]nad|kuukausi)|(?:per|pro|par|al|por)\s+(?:month|monat|mois|mese|mes|m[eê]s|maand|kuukausi))",
        r"{n}\s*€\s*(?:/\s*(?:month|monat|mois|mese|mes|m[eê]s|maand|m[åa]nad|kuukausi|kk)|(?:per|pro|par|al|por)\s+(?:month|monat|mois|mese|mes|m[eê]s|maand|kuukausi))",
    ],
    "CNY": [r"RMB\s*{n}\s*/\s*月", r"每月(?:仅需)?\s*RMB\s*{n}"],
}
GALLERY_STUDENT = r"学生可选择\s*Apple\s*Music\s*学生方案\s*[，,]?\s*每月仅需\s*RMB\s*{n}"


def gallery_prices(html: Column, currency: str) -> Column:
    """(plan, amount) of the three plans of a gallery, each from the one monthly amount of its own item; empty unless all three have one. Where the Chinese gallery lacks the students' item alone, the questions on the page may state its price.

    An item reaches from the first place of its id to the next id of another plan or offer, or 12000 characters; in CNY not beyond its list item.
    """
    if currency not in GALLERY_MONTHLY:
        return none()
    mark, number = 'data-analytics-gallery-item-id="{}"', r"([0-9][0-9\s.,]*)"
    read = lambda text, patterns: the_one(F.flatten(F.array(*(F.regexp_extract_all(text, F.lit("(?iu)" + p.replace("{n}", number)), F.lit(1)) for p in patterns))))
    plain = lambda part: F.btrim(F.regexp_replace(F.regexp_replace(html_to_text(part), "(?i)&#160;", " "), f"{S}+", " "))

    def amount(own: str) -> Column:
        others = "|".join(x for x in (*GALLERY_PLANS, GALLERY_OTHER) if x != own)
        tail = F.regexp_extract(html, f"(?s){mark.format(own)}(.*)$", 1)
        parts = F.split(tail, mark.format(f"(?:{others})"), 2)
        item = F.when(F.size(parts) == 2, F.get(parts, 0)).otherwise(F.substring(tail, 1, 12_000 - len(mark.format(own))))
        return read(plain(F.get(F.split(item, "</li>", 2), 0) if currency == "CNY" else item), GALLERY_MONTHLY[currency])

    amounts = {plan: amount(own) for own, plan in GALLERY_PLANS.items()}
    if currency == "CNY":
        asked = F.when(amounts["Individual"].isNotNull() & amounts["Family"].isNotNull(), read(plain(html), [GALLERY_STUDENT]))
        amounts["Student"] = F.coalesce(amounts["Student"], asked)
    rows = F.array(*(F.struct(F.lit(p).alias("plan"), a.alias("amount")) for p, a in amounts.items()))
    return F.coalesce(let(rows, lambda r: complete(F.filter(r, lambda x: x["amount"].isNotNull()), GALLERY_PLANS.values())), none())


def tv_price(html: Column, currency: str) -> Column:
    """The monthly amount that stands within 420 characters from a mention of the TV service on, before any other offer is named there; mentions that follow another offer within 80 characters don't count. Null unless there is one amount. Not for NOK, whose page has a form of its own."""
    if currency not in TV_MONTHLY:
        return F.lit(None).cast("double")
    decoded = html
    for pattern, new in ((r"(?i)&nbsp;|&#160;|&#xA0;|\u00a0|\u202f", " "), ("(?i)&euro;|&#8364;|&#x20AC;", "€"), ("(?i)&dollar;|&#36;", r"\$")):
        decoded = F.regexp_replace(decoded, pattern, new)
    own = F.filter(around(html_to_text(decoded), r"(?i)Apple\s*TV", 80, 420), lambda w: ~w["before"].rlike("(?i)apple (?:music|one)"))
    windows = F.transform(own, lambda w: F.regexp_replace(w["after"], "(?is)apple (?:music|one).*$", ""))
    raw = lambda w: F.flatten(F.array(*(F.regexp_extract_all(w, F.lit("(?iu)" + p.replace("{n}", r"([0-9][0-9\s.,]*)")), F.lit(1)) for p in TV_MONTHLY[currency])))
    return the_one(F.flatten(F.transform(windows, raw)))


def video_price(html: Column, country: str, currency: str, locales: Iterable[str]) -> Column:
    """The monthly amount within 6000 characters of the video service's logo text; null unless there is one amount, and unless the page names the country as its territory and one of ``locales`` as its language."""
    if currency not in VIDEO_MONTHLY:
        return F.lit(None).cast("double")
    plain = lambda c: F.replace(F.lower(F.btrim(c)), F.lit("_"), F.lit("-"))
    tags = F.array_append(F.regexp_extract_all(html, F.lit("""(?i)["'](?:osLocale|locale)["']\\s*:\\s*["']([^"']+)["']"""), F.lit(1)), F.regexp_extract(html, """(?i)<html[^>]+lang\\s*=\\s*["']([^"']+)["']""", 1))
    spoken = F.arrays_overlap(F.transform(tags, plain), F.array(*(F.lit(x.strip().lower().replace("_", "-")) for x in locales)))
    placed = html.rlike(f"""(?i)["'](?:currentTerritory|recordTerritory)["']\\s*:\\s*["']{country.strip().upper()}["']""")
    blocks = F.transform(around(html, """(?i)["']planLogoAltText["']\\s*:\\s*["']Prime Video["']""", 6000, 6000), lambda w: F.concat(w["before"], w["after"]))

    def raw(block: Column) -> Column:
        for pattern, new in ((r"(?i)\\u002F", "/"), ("(?i)&nbsp;|&#160;", " "), ("(?i)&amp;", "&"), ("(?i)&quot;", '"'), ("(?i)&#39;", "'"), (f"{S}+", " ")):
            block = F.regexp_replace(block, pattern, new)
        return let(block, lambda b: F.flatten(F.array(*(F.regexp_extract_all(b, F.lit("(?iu)" + p.replace("{n}", r"([\d.,]+)")), F.lit(1)) for p in VIDEO_MONTHLY[currency]))))

    return F.when(placed & spoken, the_one(F.flatten(F.transform(blocks, raw))))
