"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from labelled URLs; by default those are the URLs that a rule
decides. Their features are length, depth, digit share, entropy, parameter
counts and how often labelled URLs with the same host suffix were blocked.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storeflow.llm import work
from storeflow.llm.tables import table

SAMPLE_ROWS = 10_000  # labelled URLs that the trees learn from, chosen by a hash
TREES = 15
DEPTH = 3
SEED = 17
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# The rules of the queries, as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host(url: Column) -> Column:
    """From the first ``://`` to the next ``/``, ``?`` or ``#``, A-Z in lower case; empty without ``://``."""
    part = F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit(""))
    return F.translate(part, string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    """From the end of the host to the next ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def longest_rule(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits the columns host and path; null without one.

    A rule fits its host and all subdomains if the path starts with its path; of
    rules of the same length the first one wins.
    """
    name = verdict = F.lit(None).cast("string")
    for decision, rule_host, rule_path in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = (F.col("host") == rule_host) | F.endswith("host", F.lit("." + rule_host))
        fits = fits & F.startswith("path", F.lit(rule_path))
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return name, verdict


def features(url: Column) -> dict[str, Column]:
    """Lexical features of a URL; a null one counts as empty."""
    url = F.coalesce(url, F.lit(""))
    name, place = host(url), path(url)
    n = F.length(url)
    without = lambda pattern: F.length(F.regexp_replace(url, pattern, ""))
    letters = F.split(url, "")
    entropy = F.aggregate(
        F.array_distinct(letters),
        F.lit(0.0),
        lambda total, c: total - (n - F.length(F.replace(url, c, F.lit("")))) / n
        * F.log2((n - F.length(F.replace(url, c, F.lit("")))) / n),
    )
    return {
        "length": n.cast("double"),
        "host_length": F.length(name).cast("double"),
        "host_depth": (F.size(F.split(name, r"\.")) - 1).cast("double"),
        "hyphens": (F.length(name) - F.length(F.regexp_replace(name, "-", ""))).cast("double"),
        "path_depth": (F.length(place) - F.length(F.regexp_replace(place, "/", ""))).cast("double"),
        "digits": F.when(n > 0, (n - without("[0-9]")) / n).otherwise(0.0),
        "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "parameters": (n - without("[=]")).cast("double"),
        "has_fragment": F.contains(url, F.lit("#")).cast("double"),
        "secure": F.startswith(url, F.lit("https://")).cast("double"),
    }


def groups(url: Column) -> dict[str, Column]:
    """Host suffixes and the first part of the path, for which the share of blocked URLs is a feature."""
    name = host(url)
    return {
        "top": F.substring_index(name, ".", -1),
        "site": F.substring_index(name, ".", -2),
        "section": F.regexp_extract(path(url), "^/([^/]*)", 1),
    }


@dataclass
class Filter:
    """Trees, and for each kind of group how often its labelled URLs were blocked (a row per group of the sample)."""

    trees: GBTClassificationModel | None
    rates: dict[str, DataFrame]
    usual: str  # the verdict where nothing can be learned


def _with_features(rows: DataFrame, rates: dict[str, DataFrame]) -> DataFrame:
    """``rows`` (url, ...) with a vector."""
    rows = rows.withColumns({f"f_{k}": c for k, c in features(F.col("url")).items()})
    for key, rate in rates.items():
        # A row per group of the sample: at most SAMPLE_ROWS.
        rows = rows.withColumn(key, groups(F.col("url"))[key]).join(F.broadcast(rate), key, "left")
        total, blocked = F.coalesce(f"{key}_n", F.lit(0)), F.coalesce(f"{key}_blocked", F.lit(0))
        rows = rows.withColumn(f"f_{key}", (blocked + 0.5) / (total + 1.0)).drop(key, f"{key}_n", f"{key}_blocked")
    names = [c for c in rows.columns if c.startswith("f_")]
    return VectorAssembler(inputCols=names, outputCol="vector").transform(rows).drop(*names)


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Filter:
    """Learn from at most ``sample_rows`` rows of ``labelled`` (url, blocked 0 or 1), the first by a hash of the URL.

    One half of them gives the shares of the groups, the other half the trees: a
    row that counted in its own feature would give its label away. Other labels are ignored. With one label only, or none, there are no trees:
    that label, or allow, is the verdict for all.
    """
    chosen = (
        labelled.select("url", F.col("blocked").cast("int").alias("blocked"))
        .where(F.col("blocked").isin(0, 1))
        .orderBy(F.xxhash64("url", F.lit(SEED)), "url", "blocked")
        .limit(sample_rows)
    )
    sample = work.written(chosen, "urls")
    seen = [row["blocked"] for row in sample.select("blocked").distinct().collect()]  # two rows at most
    if len(seen) < 2:
        return Filter(None, {}, "block" if seen == [1] else "allow")
    half = F.pmod(F.xxhash64("url", F.lit(SEED + 1)), F.lit(2)) == 0
    rates = {
        key: work.written(
            sample.where(half).groupBy(part.alias(key)).agg(
                F.count("*").alias(f"{key}_n"), F.sum("blocked").alias(f"{key}_blocked")
            ), "rates",
        )
        for key, part in groups(F.col("url")).items()
    }
    rows = work.written(_with_features(sample.where(~half), rates).select("vector", "blocked"), "vectors")
    if rows.select("blocked").distinct().count() < 2:
        return Filter(None, {}, "allow")
    trees = GBTClassifier(
        featuresCol="vector", labelCol="blocked", maxIter=TREES, maxDepth=DEPTH, seed=SEED, checkpointInterval=-1
    )
    return Filter(trees.fit(rows), rates, "allow")


def judged(rows: DataFrame, learned: Filter) -> DataFrame:
    """``rows`` with p_block; 0.5 and more is a block."""
    if learned.trees is None:
        return rows.withColumn("p_block", F.lit(1.0 if learned.usual == "block" else 0.0))
    scored = learned.trees.transform(_with_features(rows, learned.rates))
    return scored.withColumn("p_block", F.get(vector_to_array("probability"), F.lit(1))).select(*rows.columns, "p_block")


def url_verdicts(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None,
    id_col: str = "page_id", url_col: str = "url", sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``id_col``, url, host, path, rule, verdict, p_block for every row of ``pages``.

    ``rules`` is a short list of (allow or block, host, path); the verdict is
    that of the longest rule that fits, else that of the trees. ``labelled``
    (url, blocked) teaches the trees; by default the URLs that a rule decides do.

    A null URL, or one without ``://``, has an empty host and path and is judged
    by the trees like any other. Null and repeated ids stay as they are; other
    columns are ignored.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{url_col}`").cast("string").alias("url"))
    rows = rows.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    name, verdict = longest_rule(rules)
    ruled = rows.withColumns({"rule": name, "ruled": verdict})
    if labelled is None:
        labelled = ruled.where("ruled is not null").select("url", (F.col("ruled") == "block").cast("int").alias("blocked"))
    scored = judged(ruled, fit(labelled, sample_rows))
    learned = F.when(F.col("p_block") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(id_col, "url", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "p_block")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "p_block")


QUERIES = {"op6_url_filter": op6_url_filter}
SQL: dict[str, str] = {}
