"""Pattern rules on URLs, found by their rarest literal token; only candidate rules run their expression. DataFrame functions only."""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import all_of, let, without

#: So many rules are one constant of the plan (under 2 MB); more go in several.
MAX_BROADCAST_RULES = 10_000
_TOKEN = r"[^a-z0-9]+"


@dataclass(frozen=True)
class UrlRule:
    """A rule: ``pattern`` must be found in host and path (all in lower case if ``fold``); ``literals`` are tokens every fitting URL has.

    ``name`` is what a verdict shows, or null for the method's own rules. Of the rules that fit, the largest ``rank`` wins.
    """

    pattern: str
    literals: tuple[str, ...]
    verdict: str
    rank: int
    name: str | None = None
    fold: bool = False


def host_rule(host: str, path: str, verdict: str) -> UrlRule:
    """Fits ``host`` and its subdomains where the URL's path starts with ``path`` (in its own case); longer rules win."""
    whole = host.lower() + path
    pattern = rf"^(?:[^/]*\.)?{re.escape(host.lower())}{re.escape(path)}"
    # a path may end inside a token, so only tokens closed by a later mark are sure to be in the URL
    closed = re.split(_TOKEN, path.lower())[:-1] if path.isascii() else []
    return UrlRule(pattern, tuple(t for t in [*re.split(_TOKEN, host.lower()), *closed] if t), verdict, 1_000_000 + len(whole), whole)


def method_rule(pattern: str, literals: tuple[str, ...], verdict: str = "block", rank: int = 1) -> UrlRule:
    """A pattern rule without a name, used where no named rule fits."""
    return UrlRule(pattern, literals, verdict, rank, fold=True)


# Words of hosts, between dots or hyphens, that tell spam, shops of expired names, betting and adult sites.
HOST_WORDS = [
    "spam", "casino", "casinos", "poker", "slots", "roulette", "jackpot", "betting", "sportsbook", "bookmaker", "lottery",
    "porn", "porno", "xxx", "sex", "adult", "escort", "escorts", "camgirls", "hentai", "viagra", "cialis", "pharmacy", "pills",
    "payday", "loans", "forex", "replica", "warez", "torrent", "torrents", "keygen", "cracked", "phishing", "malware",
    "clickbait", "linkfarm", "popunder", "adserver", "adserv", "doubleclick", "tracker", "parked", "domainparking",
]
# Names of pages, behind a slash, that hold no text: logins, carts, feeds, searches, machine interfaces.
PATH_NAMES = [
    "wp-login", "wp-admin", "wp-json", "wp-cron", "xmlrpc", "cgi-bin", "phpmyadmin", "administrator", "login", "logout", "signin", "signup",
    "register", "lost-password", "reset-password", "my-account", "cart", "checkout", "wishlist", "add-to-cart", "unsubscribe", "trackback",
    "print-version", "share-by-email", "captcha", "tag-cloud", "sitemap",
]


def default_patterns() -> list[tuple[str, tuple[str, ...]]]:
    """The method's own patterns, over lower-cased URLs, each with the tokens that every fitting URL has."""
    hosts = [(rf"^(?:[^/]*[.\-])?{w}[.\-]", (w,)) for w in HOST_WORDS]
    return hosts + [(rf"/{n}(?:[./?]|$)", tuple(n.split("-"))) for n in PATH_NAMES]


def default_rules() -> list[UrlRule]:
    return [method_rule(p, t) for p, t in default_patterns()]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for a null or a URL without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"(?s)^([^?#]*)", 1)
    empty = F.lit("")
    return F.coalesce(host, empty), F.coalesce(path, empty)


def _filed(tokens: DataFrame, rules: list[UrlRule]) -> list[str]:
    """The literal of each rule that fewest rows of ``tokens`` have (ties: the smallest). The driver gets a count for each literal."""
    named = sorted({t for r in rules for t in r.literals})
    literals = tokens.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(named)), "array<string>")).alias("token"))
    small = F.broadcast if len(named) <= MAX_BROADCAST_RULES else (lambda df: df)
    seen = tokens.select(F.explode("tokens").alias("token")).join(small(literals), "token").groupBy("token").agg(F.count("*").alias("n"))
    counts = {r["token"]: r["n"] for r in seen.collect()}
    return [min(r.literals, key=lambda t: (counts.get(t, 0), t)) for r in rules]


def _best(rules: list[tuple[int, UrlRule, str]], tokens: Column, target: Column) -> Column:
    """The best of ``rules`` (number, rule, the token it is filed under) that fits ``target``, or null.

    The rules are a constant array of slots by the CRC-32 of their token, so a token of a URL reads one slot, however many rules there are.
    """
    slots: list[list[dict]] = [[] for _ in range(2 * len(rules) + 1)]
    for number, r, token in rules:
        entry = {"token": token, "pattern": r.pattern, "fold": r.fold, "rank": r.rank, "number": -number, "name": r.name, "verdict": r.verdict}
        slots[zlib.crc32(token.encode()) % len(slots)].append(entry)
    kind = "array<array<struct<token string, pattern string, fold boolean, rank bigint, number int, name string, verdict string>>>"
    table = F.from_json(F.lit(json.dumps(slots)), kind)

    def fitting(token: Column) -> Column:
        slot = F.get(table, F.pmod(F.crc32(token.cast("binary")), F.lit(len(slots)).cast("long")).cast("int"))
        fits = F.filter(slot, lambda r: (r["token"] == token) & F.rlike(F.when(r["fold"], F.lower(target)).otherwise(target), r["pattern"]))
        return F.transform(fits, lambda r: F.struct(r["rank"].alias("rank"), r["number"].alias("number"), r["name"].alias("rule"), r["verdict"].alias("verdict")))

    return F.array_max(F.flatten(F.transform(tokens, fitting)))


def filter_urls(pages: DataFrame, rules: list[UrlRule], default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` for the column ``url``; input columns of these names are replaced.

    Each rule is filed under the literal token that fewest URLs have, counted over all of them (one pass at once, whose result is a
    count for each literal). A URL's tokens fetch its candidate rules; those run their expression, and of those that fit the
    largest rank wins (ties: the rule listed first). ``rule`` is the winner's name or null; ``verdict`` is the winner's, else ``default``.

    One row comes out for each row that goes in, repeated rows and null ids included; a null URL fits no rule. An empty list of rules,
    or a rule without a literal, is a ValueError. Extra columns pass through. A row is judged where it lies: none is shuffled, numbered or
    put together again, so a hot host costs nothing and a lost task is simply run again. Rules go in blocks of ``MAX_BROADCAST_RULES``,
    each a constant of the plan.
    """
    if not rules or any(not r.literals for r in rules):
        raise ValueError("give one rule at least, and each rule a literal token to be filed under")
    pages = without(pages, ["host", "path", "rule", "verdict"])
    host, path = split_url(F.col(url))
    split = pages.withColumn("host", host).withColumn("path", path)
    tokens = F.array_distinct(F.split(F.lower(F.concat("host", F.lit("/"), "path")), _TOKEN))
    numbered = list(zip(range(len(rules)), rules, _filed(split.select(tokens.alias("tokens")), rules), strict=True))
    blocks = [numbered[i : i + MAX_BROADCAST_RULES] for i in range(0, len(numbered), MAX_BROADCAST_RULES)]
    best = F.array_max(F.array(*[_best(b, tokens, F.concat("host", "path")) for b in blocks]))
    return split.select(*all_of(pages), "host", "path", let(best, lambda b: F.struct(b["rule"].alias("rule"), F.coalesce(b["verdict"], F.lit(default)).alias("verdict"))).alias("__best")).select(
        *all_of(pages), "host", "path", "__best.rule", "__best.verdict"
    )
