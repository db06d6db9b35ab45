"""URL filters: pattern rules found through their rarest literal token.

A rule is a regular expression over ``host + path``, with literal tokens (runs of a-z and 0-9) that every
URL it fits must have. Each rule is filed under the one of its tokens that the fewest URLs have,
counted over all URLs; the tokens of a URL fetch candidate rules from that index, and only those run
their expression. A rule without a literal token is a candidate for every URL.

Everything is Spark expressions and joins. URLs are judged once each, however many pages share
them. The index is broadcast only while its text is below ``broadcast_chars``; beyond that it is joined
by token like any table.

Defined results: a null URL, and one without ``://``, has an empty host and path and fits no rule;
of the given rules that fit the longest wins, of equally long ones the last in the order of their
texts, and any of them before the method's own; without a given rule the verdict is the method's, which
is ``block`` if a pattern of its own fits and ``allow`` otherwise; repeated rows are all returned, null ids
stay null, an empty table gives an empty one; URLs of any length are judged whole.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.llm.common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``given`` rules are ranked by the length of their text; the others are the method's own."""

    text: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    given: bool


def literal_tokens(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(t for t in re.split(r"[^a-z0-9]+", text.lower()) if t))


def site_rule(verdict: str, text: str) -> Rule:
    """``host/path``: fits the host and its subdomains if the path starts with the rule's path. The last
    part of the path is a literal token only if the rule ends it."""
    host, slash, path = text.partition("/")
    whole = path if path.endswith("/") or not path else path[: len(path) - len(re.split(r"[^A-Za-z0-9]", path)[-1])]
    return Rule(text, verdict, rf"\A(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", literal_tokens(f"{host}/{whole}"), True)


def word_rule(verdict: str, *words: str) -> Rule:
    """Fits if the host has these words next to each other."""
    inner = "[^a-z0-9/]+".join(map(re.escape, words))
    return Rule("-".join(words), verdict, rf"\A(?:[^/]*[^a-z0-9/])?{inner}(?:[^a-z0-9].*)?\z", tuple(words), False)


#: The rules of the query.
SITE_RULES = (site_rule("block", "net/"), site_rule("allow", "example.net/en/"), site_rule("block", "example.com/de/"), site_rule("allow", "org/fr/"))
#: The method's own: words of hosts that sell rather than tell, by the categories of public block lists
#: (gambling, adult, pharmacy, loans and scams, advertising servers, file sharing, link farms).
WORD_RULES = tuple(
    word_rule("block", *w.split("-"))
    for w in (
        "casino casinos poker slots jackpot roulette lottery lotto bets betting bookmaker free-bets sportsbook "
        "adult porn porno xxx sex escort escorts webcam-girls hentai nude "
        "pills cheap-pills viagra cialis levitra tramadol xanax online-pharmacy pharmacy-online weight-loss diet-pills "
        "payday loans payday-loan fast-cash get-rich replica-watches crypto-giveaway binary-options forex-signals "
        "adserver adservice adservices doubleclick pagead clicktrack popunder popads banner-ads "
        "torrent torrents warez crackz keygen nulled "
        "spam spam-farm link-farm seo-links buy-links backlinks"
    ).split()
)


@dataclass(frozen=True)
class UrlConfig:
    rules: tuple[Rule, ...] = field(default=SITE_RULES + WORD_RULES)
    broadcast_chars: int = 4_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


#: Rules without a literal token are filed under so many made-up tokens, of which each URL has one.
SHARES = 64


def _rule_table(spark: SparkSession, config: UrlConfig) -> DataFrame:
    """The rules as a literal, so that no row of theirs passes through Python."""
    rows = [{"rule_no": k, "rule": r.text, "rule_verdict": r.verdict, "pattern": r.pattern, "given": r.given, "tokens": list(r.tokens)} for k, r in enumerate(config.rules)]
    schema = "array<struct<rule_no int, rule string, rule_verdict string, pattern string, given boolean, tokens array<string>>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", config: UrlConfig = UrlConfig()) -> DataFrame:
    """One row per input row: the id, ``host``, ``path``, ``rule``, ``verdict`` and ``pattern_rule``, the text of
    the method's own rule that fits, if one does."""
    rules = _rule_table(pages.sparkSession, config)
    bounded = sum(len(r.text) + len(r.pattern) + sum(map(len, r.tokens)) for r in config.rules) <= config.broadcast_chars
    small = F.broadcast if bounded else (lambda df: df)

    host, path = host_and_path(F.col("url"))
    slim = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path}).drop("url")
    slim = slim.withColumn("target", F.concat("host", "path"))
    urls = slim.filter("target <> ''").select("target").distinct()
    tokens = F.filter(F.split(F.translate("target", UPPER, LOWER), r"[^a-z0-9]+"), lambda t: t != "")
    if any(not r.tokens for r in config.rules):
        tokens = F.concat(tokens, F.array(F.concat(F.lit("*"), F.pmod(F.xxhash64("target"), F.lit(SHARES)))))
    spread = urls.select("target", F.explode(F.array_distinct(tokens)).alias("token"))

    owned = rules.select("rule_no", F.explode("tokens").alias("token"))
    counts = spread.join(small(owned.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    filed = owned.join(counts, "token", "left").groupBy("rule_no").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("token"))
    bare = rules.filter(F.size("tokens") == 0).select("rule_no", F.explode(F.array(*[F.lit(f"*{k}") for k in range(SHARES)])).alias("token"))
    index = Scratch(pages.sparkSession, "url-rules").write(filed.unionByName(bare).join(rules.drop("tokens"), "rule_no"), "index")
    fits = spread.join(small(index), "token").filter(F.expr("target rlike pattern"))
    rank = F.struct(F.length("rule"), "rule")
    found = fits.groupBy("target").agg(
        F.max_by(F.when(F.col("given"), F.struct("rule", "rule_verdict")), F.when(F.col("given"), rank)).alias("best"),
        F.max_by(F.when(~F.col("given"), F.struct("rule", "rule_verdict")), F.when(~F.col("given"), rank)).alias("own"),
    )
    # Written and merged, so that the join below is one of plain shuffles, whose hot URLs Spark splits, and never a
    # broadcast of what grows with the pages; rows without a host stay out of it.
    found = Scratch(pages.sparkSession, "url-verdicts").write(found, "found")
    joined = slim.filter("target <> ''").join(found.hint("merge"), "target", "left")
    alone = slim.filter("target = ''").select("target", "id", "host", "path", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("best", "own")])
    judged = joined.unionByName(alone)
    verdict = F.coalesce(F.col("best.rule_verdict"), F.col("own.rule_verdict"), F.lit("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), F.col("own.rule").alias("pattern_rule"))
