"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes.

Every distinct URL becomes the expressions (host suffix, path prefix) under which a rule could name
it. An expression's SHA-256 digest is cut to `PREFIX_HEX` hex digits for the equi-join; the full
digest confirms a hit, and of the confirmed rules the longest wins.

Defined results: a null URL or one without ``://`` has an empty host and path and takes the default
verdict. Equal URLs are judged once and joined back, so repeated rows get equal verdicts. Equally
long rules that both fit: the smaller string wins. An empty table gives an empty table. Other
columns of the input don't matter: only the id and the URL are read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hex digits of a digest that the equi-join uses.
PREFIX_HEX = 8
#: A rule list of at most so many rows is broadcast; a longer one is joined by a shuffle.
BROADCAST_RULES = 10_000

RULE_SCHEMA = "host string, path string, verdict string"


def with_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """Add host and path of each URL."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return urls.withColumns({"host": _small(host), "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """Every distinct URL of `urls` with host, path, the winning rule and the verdict.

    `rules` has host, path and verdict. A rule fits its host and all subdomains if the URL's path
    starts with the rule's path.
    """
    rules = rules.select(_small("host").alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict").where("rule_host is not null").groupBy("rule_host", "rule_path").agg(F.min("verdict").alias("verdict"))
    keyed = rules.withColumn("digest", _digest("rule_host", "rule_path"))
    keyed = keyed.withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    small = keyed.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    # At most one for each length that a rule's path can have, however many rules there are.
    lengths = sorted(r.n for r in rules.select(F.length("rule_path").alias("n")).distinct().collect())

    distinct = with_parts(urls.select(F.col(url).alias("url")).distinct())
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path"))
    prefixes = F.transform(fitting, lambda n: F.substring(F.col("path"), F.lit(1), n))
    spread = (
        distinct.where("host <> ''")
        .select("url", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
        .select("url", "suffix", F.explode("prefixes").alias("head"))
        .select("url", _digest("suffix", "head").alias("full"))
        .withColumn("short", F.substring("full", 1, PREFIX_HEX))
    )
    candidates = spread.join(F.broadcast(keyed) if small else keyed, F.col("short") == F.col("prefix"))
    name = F.concat("rule_host", "rule_path")
    # Within the aggregate, so that the comparison of digests is no second key of the join.
    confirmed = F.when(F.col("full") == F.col("digest"), F.struct((-F.length(name)).alias("shorter"), name.alias("rule"), "verdict"))
    best = candidates.groupBy("url").agg(F.min(confirmed).alias("best")).withColumnRenamed("url", "hit_url")
    return distinct.join(best, F.col("url") == F.col("hit_url"), "left").select("url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", keep: Iterable[str] = ()) -> DataFrame:
    """The columns `keep` of every row with its URL's judgement."""
    own = pages.select(*(F.col(c).alias(f"own_{i}") for i, c in enumerate(keep)), F.col(url).alias("own_url"))
    judged = judge(pages, rules, default, url)
    names = list(keep)
    return own.join(judged, F.col("own_url").eqNullSafe(F.col("url")), "left").select(*(F.col(f"own_{i}").alias(c) for i, c in enumerate(names)), "host", "path", "rule", "verdict")


def _small(host: F.Column | str) -> F.Column:
    """A-Z in lower case."""
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _digest(host: str, path: str) -> F.Column:
    return F.sha2(F.concat(F.col(host), F.lit("\n"), F.col(path)), 256)
