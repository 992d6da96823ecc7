"""Site rules as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone import settings
from lodestone.functions.urls import domain, robots_path
from lodestone.plans.scratch import Scratch

RULES = 200_000   # rows of a rule table that are broadcast
SALTS = 32        # parts over which the URLs of each site are spread where the rules are too many for that


def robots_filter(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``allowed``: the verdict of the first rule (lowest ``seq``) of the URL's site whose prefix it has.

    ``rules``: ``domain, seq, path_prefix, allow``. No matching rule means allowed.
    """
    return apply_rules(urls, *rule_tables(rules), url_col)


def rule_tables(rules: DataFrame, most: int = RULES) -> tuple[DataFrame, DataFrame]:
    """Per site the prefix lengths in use; per site and prefix its first rule.

    Both are stored, and broadcast while their rows and bytes are within bounds. Larger ones are repeated for each of
    ``SALTS`` parts, so that a site of very many URLs, or a prefix that all of them have, is spread over as many tasks.
    """
    lengths = rules.groupBy("domain").agg(F.collect_set(F.length("path_prefix")).alias("_lengths"))
    first = rules.groupBy("domain", F.col("path_prefix").alias("_prefix")).agg(
        F.min(F.struct("seq", "allow")).alias("_rule"))
    scratch = Scratch(rules.sparkSession, "rules")
    stored = scratch.write(first, "first")
    if scratch.bytes("first") <= settings.BROADCAST_BYTES // 8 and stored.count() <= most:
        return F.broadcast(scratch.write(lengths, "lengths")), F.broadcast(stored)
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return scratch.write(lengths, "lengths").withColumn("_part", parts), stored.withColumn("_part", parts)


def apply_rules(urls: DataFrame, lengths: DataFrame, first: DataFrame, url_col: str = "url") -> DataFrame:
    """``robots_filter`` with prepared rule tables.

    A URL is expanded to its prefixes of the lengths its site's rules use and joined on equality, so neither the
    rules nor the URLs of a site are ever gathered in one place.
    """
    part = ["_part"] if "_part" in first.columns else []
    asked = urls.select(F.col(url_col).alias("_url")).distinct().select(
        "_url", domain(F.col("_url")).alias("domain"), robots_path(F.col("_url")).alias("_path"),
        *[F.pmod(F.xxhash64("_url"), F.lit(SALTS)).cast("int").alias(p) for p in part])
    prefixes = asked.join(lengths, ["domain", *part]).select(
        "_url", "domain", "_path", *part, F.explode("_lengths").alias("_length"))
    prefixes = prefixes.where(F.col("_length") <= F.length("_path")).select(
        "_url", "domain", *part, F.substring(F.col("_path"), F.lit(1), F.col("_length")).alias("_prefix"))
    verdicts = prefixes.join(first, ["domain", "_prefix", *part]).groupBy("_url").agg(
        F.min("_rule")["allow"].alias("_allow"))
    return (urls.join(verdicts, urls[url_col] == verdicts["_url"], "left").drop("_url")
            .withColumn("allowed", F.coalesce("_allow", F.lit(True))).drop("_allow"))
