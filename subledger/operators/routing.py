"""Where a subscription is managed: billing routes, provider capabilities, markets and the service picker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Services that are offered in mainland China, and those of them that are offered nowhere else.
CHINA_ONLY = ("tencent-video", "iqiyi", "mango-tv", "youku", "bilibili", "qq-music", "netease-cloud-music", "kugou-music", "baidu-netdisk", "wps")
CHINA = (*CHINA_ONLY, "apple-music", "icloud-plus", "microsoft-365")
# Services of one country, and the markets of one that has several.
US_ONLY = ("hulu", "peacock")
PARAMOUNT_MARKETS = ("US", "DE", "FR", "IT", "AT", "IE")
# Countries with the European account page of one service.
PRIME_EUROPE = "AL AD AT BY BE BA BG HR CY CZ DK EE FI FR DE GR HU IS IE IT LV LI LT LU MT MD MC ME NL MK NO PL PT RO SM RS SK SI ES SE CH UA GB VA".split()
# Pages on which platforms and stores manage subscriptions.
APPLE = "https://apps.apple.com/account/subscriptions"
GOOGLE = "https://play.google.com/store/account/subscriptions"
AMAZON = "https://www.amazon.com/hz5/yourmembershipsandsubscriptions"
AMAZON_MUSIC = "https://www.amazon.com/gp/dmusic/player/settings"
AMAZON_PRIME = "https://www.amazon.com/prime"
AMAZON_CHANNELS = "https://www.amazon.com/gp/video/settings/channels"
PRIME_VIDEO = "https://www.primevideo.com/settings/your-account"
PRIME_VIDEO_EUROPE = "https://www.primevideo.com/region/eu/settings/your-account"
# Routes by provider: name, page, label.
ROUTES = {
    "apple": ("APPLE", APPLE, "Open Apple subscriptions"),
    "google-play": ("GOOGLE_PLAY", GOOGLE, "Open Google Play subscriptions"),
    "amazon": ("AMAZON", AMAZON, "Open Amazon subscriptions"),
    "direct": ("DIRECT", None, "Manage directly"),
}
GUIDED = ("GUIDED", None, "Open guided instructions")


def billing_provider(raw: Column) -> Column:
    """A provider's usual name; null becomes the empty text."""
    name = F.lower(F.btrim(F.coalesce(raw, F.lit(""))))
    return F.when(name == "google", "google-play").when(name.isin("tv-provider", "carrier-tv"), "carrier").otherwise(name)


def provider_route(provider: Column) -> Column:
    """Struct of provider, url and label; unknown providers are guided."""
    row = lambda r: F.struct(F.lit(r[0]).alias("provider"), F.lit(r[1]).cast("string").alias("url"), F.lit(r[2]).alias("label"))
    found = F.when(F.lit(False), row(GUIDED))
    for slug, r in ROUTES.items():
        found = found.when(provider == slug, row(r))
    return found.otherwise(row(GUIDED))


def supports_pause(billing: Column, service_pauses: Column) -> Column:
    """Platforms, stores and carriers never offer a pause; a service does if its own entry says so."""
    return ~billing_provider(billing).isin("apple", "google-play", "amazon", "carrier") & F.coalesce(service_pauses, F.lit(False))


def management_urls(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """``rows`` (service, provider, action, country) with ``url``: billing decides before the service, the service before the action.

    ``pages`` has (service, manage_url, pause_url, cancel_url, reactivate_url) of services that are managed directly. Carriers have no page; neither does an unknown service.
    """
    billing, service, action = billing_provider(F.col("provider")), F.col("service"), F.col("action")
    prime = F.when(F.upper(F.coalesce("country", F.lit(""))).isin(PRIME_EUROPE), PRIME_VIDEO_EUROPE).otherwise(PRIME_VIDEO)
    amazon = F.when(service == "prime-video", prime).when(service == "amazon-music-unlimited", AMAZON_MUSIC).when(service == "amazon-prime", AMAZON_PRIME).otherwise(AMAZON_CHANNELS)
    own = F.coalesce(F.when(action == "PAUSE", F.col("pause_url")).when(action == "CANCEL", F.col("cancel_url")).when(action == "REACTIVATE", F.col("reactivate_url")), F.col("manage_url"))
    url = F.when(billing == "apple", APPLE).when(billing == "google-play", GOOGLE).when(billing == "carrier", None).when(billing == "amazon", amazon).when(service == "prime-video", prime).otherwise(own)
    return rows.join(pages, "service", "left").select(*rows.columns, url.alias("url"))


# Adapters in the order in which they are asked; what pausing, cancelling and reactivating come to, and whether pausing needs the highest plan.
ADAPTERS = (
    ("netflix-direct", "netflix", "direct", "DIRECT", "DIRECT", False),
    ("apple-platform", None, "apple", "UNSUPPORTED", "PROVIDER_REDIRECT", False),
    ("disney-direct", "disney-plus", "direct", "DIRECT", "DIRECT", True),
    ("fallback-guided", None, None, "UNSUPPORTED", "GUIDED", False),
)


def capabilities(contexts: DataFrame) -> DataFrame:
    """``contexts`` (id, service, provider, action) with the first adapter that supports them, the execution of the action, whether it is supported, needs the highest plan, and the page to go to."""
    matches = lambda a: (F.lit(True) if a[1] is None else F.col("service") == a[1]) & (F.lit(True) if a[2] is None else F.col("provider") == a[2])
    row = lambda a: F.struct(F.lit(a[0]).alias("adapter"), F.when(F.col("action") == "PAUSE", a[3]).otherwise(a[4]).alias("execution"), ((F.col("action") == "PAUSE") & F.lit(a[5])).alias("premium_only"))
    found = F.coalesce(*(F.when(F.coalesce(matches(a), F.lit(False)), row(a)) for a in ADAPTERS))
    named = contexts.withColumn("found", found).select(*contexts.columns, "found.*")
    return named.withColumns({"supported": F.col("execution") != "UNSUPPORTED", "url": F.when(F.col("execution") == "PROVIDER_REDIRECT", APPLE)})


def available(service: Column, country: Column) -> Column:
    """Whether a service is offered in a market."""
    elsewhere = F.when(service.isin(*US_ONLY), country == "US").when(service == "paramount-plus", country.isin(*PARAMOUNT_MARKETS)).otherwise(~service.isin(*CHINA_ONLY))
    return F.when(country == "CN", service.isin(*CHINA)).otherwise(elsewhere)


def allowed_routes(services: DataFrame, routes: DataFrame, providers: list[str]) -> DataFrame:
    """(service, routes, default_route) for each of ``services``: those of ``routes`` (service, provider) that are ``providers``, in their order; direct alone for a service without any."""
    rank = F.array_position(F.array(*map(F.lit, providers)), F.col("provider"))
    own = routes.withColumn("rank", rank).where("rank > 0").groupBy("service").agg(F.array_sort(F.collect_set(F.struct("rank", "provider"))).alias("found"))
    listed = F.coalesce(F.transform("found", lambda x: x["provider"]), F.array(F.lit("direct")))
    return services.select("service").join(own, "service", "left").select("service", F.array_join(listed, ",").alias("routes"), F.get(listed, 0).alias("default_route"))


def picker(services: DataFrame, prices: DataFrame, owned: DataFrame, country: str, category: str) -> DataFrame:
    """(service, service_name) to choose from in a market: offered there, priced there, of the category, not owned; by name."""
    here = services.where((F.col("category") == category) & available(F.col("service"), F.lit(country)))
    return here.join(prices.where(F.col("country") == country).select("service"), "service", "left_semi").join(owned.select("service"), "service", "left_anti").select("service", "service_name").orderBy("service_name", "service")


def country_search(markets: DataFrame, query: str) -> DataFrame:
    """Markets (country, name) whose code or name holds the query, in any case; all of them for a blank one."""
    wanted = F.lit(query.strip().lower())
    return markets.where(F.lower("name").contains(wanted) | F.lower("country").contains(wanted)).orderBy("name")


def page_metadata(pages: DataFrame) -> DataFrame:
    """(page_id, requested, reported, transport, error) of fetched pages: a country is two capital letters, and the exit country, where it is reported, is the one that was asked for."""
    good = F.col("requested").rlike("^[A-Z]{2}$")
    error = F.when(~F.coalesce(good, F.lit(False)), "INVALID_COUNTRY").when(F.col("reported").isNotNull() & (F.col("reported") != F.col("requested")), "WRONG_EXIT_COUNTRY")
    return pages.select("page_id", "requested", "reported", F.when(F.col("reported").isNull(), "direct").otherwise("proxy").alias("transport"), error.alias("error"))
