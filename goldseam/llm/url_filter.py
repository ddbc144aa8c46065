"""URL rules found by their rarest literal token; regular expressions run only on what a token fetched.

A rule is a host, which stands for itself and its subdomains, and the beginning of a path. As a pattern it
is one regular expression over host and path. Its literal tokens are the labels of the host (h:net) and the
complete segments of the path (p:en). The index files each rule under the one of its tokens that the fewest
URLs have; a URL fetches the rules filed under its own tokens, and only their expressions run on it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldseam.llm.common import fresh

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class UrlRule:
    """``verdict`` (allow or block) for ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        return r"(?s)^(?:[^/]*\.)?\Q" + self.name + r"\E"

    @property
    def tokens(self) -> list[str]:
        """Literal tokens; the empty token, which every URL has, if there is no other."""
        labels = ["h:" + part for part in self.host.split(".") if part]
        segments = ["p:" + part for part in self.path.split("/")[:-1] if part]
        return sorted({*labels, *segments}) or [""]


def rule_table(spark: SparkSession, rules: list[UrlRule]) -> DataFrame:
    """(rule, verdict, pattern, tokens) as a table of literals."""
    if not rules:
        return spark.sql(
            "SELECT '' rule, '' verdict, '' pattern, array('') tokens FROM range(0)"
        )
    rows = [
        F.struct(
            F.lit(r.name).alias("rule"),
            F.lit(r.verdict).alias("verdict"),
            F.lit(r.pattern).alias("pattern"),
            F.array(*map(F.lit, r.tokens)).alias("tokens"),
        )
        for r in rules
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def host_of(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url):
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens():
    labels = F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.split("path", "/")
    closed = F.slice(parts, 1, F.size(parts) - 1)
    segments = F.transform(closed, lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(F.array(F.lit("")), labels, segments))


def rule_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(token, rule, verdict, pattern): each rule under its token that the fewest of ``urls`` have.

    Only the tokens of rules are counted, and the counts are folded before the shuffle. Ties go to the
    token that sorts first.
    """
    listed = rules.select("rule", "verdict", "pattern", F.explode("tokens").alias("token"))
    seen = (
        urls.select(F.explode(_tokens()).alias("token"))
        .join(listed.select("token").distinct(), "token")
        .groupBy("token")
        .agg(F.count("*").alias("urls"))
    )
    counted = listed.join(seen, "token", "left")
    rarity = F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), F.col("token"))
    return counted.groupBy("rule", "verdict", "pattern").agg(F.min(rarity)["token"].alias("token"))


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    Of the rules that match, the longest decides; of equally long ones the one that sorts last, and
    of one rule with two verdicts the later in the alphabet (block). Without a rule the verdict is
    ``default`` and rule is null. A null url, or one without ``://``, has empty host and path. Rows
    are judged one by one, so repeated rows repeat; each different host and path is matched once,
    however many rows have it. Other columns are not read; an empty table gives an empty table.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = parts.select("host", "path").distinct()
    index = rule_index(urls, rules)
    found = (
        urls.select("host", "path", F.explode(_tokens()).alias("token"))
        .join(index, "token")
        .where(F.expr("concat(host, path) RLIKE pattern"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("size"), "rule", "verdict")).alias("best"))
    )
    return parts.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", "best.rule",
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def allowed(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The rows of ``pages``, all columns, whose verdict is allow."""
    host, path = fresh(pages.columns, "_host"), fresh(pages.columns, "_path")
    keyed = pages.withColumns({host: host_of(F.col("url")), path: path_of(F.col("url"))})
    blocked = (
        judged(pages.select(F.lit(0).alias("page_id"), "url"), rules, default)
        .where(F.col("verdict") == "block")
        .select(F.col("host").alias(host), F.col("path").alias(path))
        .distinct()
    )
    return keyed.join(blocked, [host, path], "left_anti").select(*pages.columns)
