"""Enrichment of incoming events: user agents, bots, property routing."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a bot's user agent holds, in lower case.
BOT_TOKENS = (
    "bot", "crawler", "spider", "crawling", "slurp", "headless", "curl/", "wget/", "python-requests", "python-urllib",
    "go-http-client", "java/", "okhttp", "axios/", "node-fetch", "got (", "phantomjs", "lighthouse", "pingdom", "uptimerobot",
    "monitoring", "preview", "facebookexternalhit", "embedly", "quora link preview", "whatsapp", "telegrambot", "discordbot",
    "linkedinbot", "archive.org_bot",
)
# Browser and system names with their patterns, in the order they are tried.
BROWSERS = (
    ("edge", r"\bedg[ea]?/"), ("opera", r"\b(opr|opera)/"), ("samsung", r"\bsamsungbrowser/"),
    ("firefox", r"\bfirefox/"), ("chrome", r"\bchrome/"), ("safari", r"\bsafari/"),
)
SYSTEMS = (
    ("ios", r"\b(iphone|ipad|ipod)\b"), ("android", r"\bandroid\b"), ("macos", r"\bmac os x\b"),
    ("windows", r"\bwindows nt\b"), ("linux", r"\blinux\b"),
)
#: Libraries that run on servers, whose own user agent says nothing of a visitor.
SERVER_LIBRARIES = ("footfall-node", "footfall-python", "footfall-php")
MAX_KEY = 128
RESERVED = "$"


def _has(ua: Column, pattern: str) -> Column:
    return ua.rlike(f"(?i){pattern}")


def _first(ua: Column, table: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda rest, x: F.when(_has(ua, x[1]), x[0]).otherwise(rest), reversed(table), F.lit("unknown"))


def browser(ua: Column) -> Column:
    return F.when(F.coalesce(ua, F.lit("")) == "", "unknown").otherwise(_first(ua, BROWSERS))


def system(ua: Column) -> Column:
    return F.when(F.coalesce(ua, F.lit("")) == "", "unknown").otherwise(_first(ua, SYSTEMS))


def device_type(ua: Column) -> Column:
    os = system(ua)
    return (
        F.when(F.coalesce(ua, F.lit("")) == "", "unknown")
        .when(_has(ua, r"\bipad\b"), "tablet")
        .when((os == "android") & ~_has(ua, r"\bmobile\b"), "tablet")
        .when(_has(ua, r"\b(iphone|ipod)\b") | _has(ua, r"\bmobile\b"), "mobile")
        .when(os == "unknown", "unknown")
        .otherwise("desktop")
    )


def is_bot(ua: Column) -> Column:
    """Whether a user agent is a bot's; a missing one is."""
    tokens = "|".join(re.escape(t) for t in BOT_TOKENS)
    return F.coalesce(ua == "", F.lit(True)) | F.lower(F.coalesce(ua, F.lit(""))).rlike(tokens)


def bot_verdict(transport: Column, forwarded: Column, library: Column, servers: tuple[str, ...] = SERVER_LIBRARIES) -> Column:
    """A server library is judged by the agent it forwards, and not at all if it forwards none."""
    server = F.coalesce(library.isin(*servers), F.lit(False))
    return F.when(server, forwarded.isNotNull() & is_bot(forwarded)).otherwise(is_bot(transport))


def visitor_agent(transport: Column, forwarded: Column, library: Column, servers: tuple[str, ...] = SERVER_LIBRARIES) -> Column:
    return F.when(F.coalesce(library.isin(*servers), F.lit(False)), F.coalesce(forwarded, transport)).otherwise(transport)


def route(bag: Column) -> tuple[Column, Column]:
    """(strings, numbers) of a bag map<string, variant text>: entries (key, kind, value).

    ``bag`` is an array of structs (key, kind: string, number, boolean or null,
    value: text). Keys are cut to MAX_KEY; empty and reserved keys, nulls and
    numbers that aren't finite go; of equal keys the last stays.
    """
    cut = F.transform(bag, lambda e: F.struct(F.substring(e["key"], 1, MAX_KEY).alias("key"), e["kind"].alias("kind"), e["value"].alias("value")))
    kept = F.filter(cut, lambda e: (e["key"] != "") & ~e["key"].startswith(RESERVED) & (e["kind"] != "null"))

    # Keys of one object differ, so only cut ones can be equal.
    may_meet = F.exists(bag, lambda e: F.char_length(e["key"]) > MAX_KEY)

    def last(entries: Column) -> Column:
        alone = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries) + 1), lambda later: later["key"] == e["key"]))
        return F.when(may_meet, alone).otherwise(entries)

    texts = last(F.filter(kept, lambda e: e["kind"] != "number"))
    finite = F.filter(kept, lambda e: (e["kind"] == "number") & F.coalesce(F.abs(e["value"].try_cast("double")) < float("inf"), F.lit(False)))
    numbers = last(finite)
    return (
        F.map_from_entries(F.transform(texts, lambda e: F.struct(e["key"], e["value"]))),
        F.map_from_entries(F.transform(numbers, lambda e: F.struct(e["key"], e["value"].cast("double")))),
    )
