"""URL filters: fixed rules on host and path, and block rules mined from labels by FP-growth. DataFrames only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized_broadcast, written

_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BAD = "label:bad"

#: Fixed values: (verdict, host and path). Rules like these are configuration; their number is small.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)


@dataclass(frozen=True)
class Mining:
    """Pruning of mined rules: shares of labelled urls, the least confidence, and by how much the odds that a url is bad
    must exceed those of all labelled urls."""

    support: float = 0.001
    bad_support: float = 0.0005
    confidence: float = 0.5
    odds: float = 2.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first `://`: the host in lower case, and the path from its slash on. Else both are empty."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), _AZ, _AZ.lower()), F.regexp_extract(text, pattern, 2)


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    named, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):
        of, _, start = rule.partition("/")
        fits = F.endswith(F.concat(F.lit("."), host), F.lit(f".{of}")) & F.startswith(path, F.lit(f"/{start}"))
        named, verdict = F.when(fits, rule).otherwise(named), F.when(fits, kind).otherwise(verdict)
    return named, verdict


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a url: labels of its host, segments of its path (digits as 0), and where they stand."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    parts = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "0"), "/"), lambda x: x != "")
    return F.array_distinct(F.concat(labels, F.transform(parts, lambda x: F.concat(F.lit("p:"), x))))


def least_share(base: float, odds: float) -> float:
    """The share of bad urls whose odds are so many times those of the base rate; 1 at most."""
    return odds * base / (1 - base + odds * base)


def mine_rules(labelled: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """(items array<string>, rare string, confidence, bad long) of the rules `items -> bad`.

    labelled: `items` and a boolean `bad`. FP-growth finds the frequent combinations, of any length; a rule stays if its
    support, confidence and odds reach the limits and no rule with fewer of its items is as sure. rare is its rarest
    item. The number of combinations is bounded by the support, not by the rows.
    """
    labelled = labelled.where(F.size("items") > 0).select(F.when(F.col("bad"), F.array_append("items", F.lit(_BAD))).otherwise(F.col("items")).alias("items"), "bad")
    total, bad = labelled.agg(F.count("*"), F.sum(F.col("bad").cast("long"))).first()
    spark = labelled.sparkSession
    if not bad:
        return spark.createDataFrame([], "items array<string>, rare string, confidence double, bad long")
    model = FPGrowth(itemsCol="items", minSupport=max(mining.bad_support, 2 / total), minConfidence=1.0).fit(labelled.select("items"))
    found = written(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "url_itemsets")
    plain = found.where(~F.array_contains("items", _BAD)).select("items", F.col("freq").alias("seen"))
    with_bad = found.where(F.array_contains("items", _BAD) & (F.size("items") > 1)).select(F.array_sort(F.array_remove("items", _BAD)).alias("items"), F.col("freq").alias("bad"))
    sure = F.col("bad") / F.col("seen")
    rules = with_bad.join(plain, "items").withColumn("confidence", sure)
    rules = rules.where((sure >= mining.confidence) & (sure >= least_share(bad / total, mining.odds)) & (F.col("seen") >= mining.support * total))
    one = plain.where(F.size("items") == 1).select(F.col("items")[0].alias("item"), F.col("seen").alias("n"))
    spread = rules.select("items", "confidence", F.explode("items").alias("item")).join(one, "item")
    rare = spread.groupBy("items").agg(F.min_by("item", F.struct("n", "item")).alias("rare"))
    rules = rules.join(rare, "items")
    less = rules.select(F.col("items").alias("fewer"), F.col("confidence").alias("as_sure"), F.explode("items").alias("any"))
    wider = rules.select("items", "confidence", F.explode("items").alias("any")).join(less, "any")
    wider = wider.where((F.size("fewer") < F.size("items")) & (F.size(F.array_except("fewer", "items")) == 0) & (F.col("as_sure") >= F.col("confidence")))
    return rules.join(wider.select("items").distinct(), "items", "left_anti").select("items", "rare", "confidence", "bad")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, mining: Mining = Mining(), bound: int = 100_000) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    Labels of pages come by their id; a null or missing label teaches nothing, a null url has no tokens. Where no
    fixed rule fits, a url is blocked if it holds all items of a mined rule. Mined rules are an inverted index by
    their rarest item, broadcast if they are at most `bound`, else shuffled. Urls are judged once by host and path;
    verdicts of the few that make up a thousandth of all rows or more are broadcast, the others are joined.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id"), F.col("url"), host.alias("host"), path.alias("path"))
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    labelled = urls.join(known, F.col("page_id") == F.col("doc_id")).select(tokens(F.col("host"), F.col("path")).alias("items"), "bad")
    index = written(mine_rules(labelled, mining), "url_rules")
    index = sized_broadcast(index.select("rare", F.col("items").alias("needs")), index.count(), bound)
    counts = written(urls.groupBy("host", "path").agg(F.count("*").alias("n")), "url_counts")
    spread = counts.withColumn("items", tokens(F.col("host"), F.col("path")))
    hits = spread.select("host", "path", "items", F.explode("items").alias("rare")).join(index, "rare").where(F.size(F.array_except("needs", "items")) == 0)
    hits = written(hits.select("host", "path").distinct().withColumn("mined", F.lit("block")), "url_hits")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") >= max(2, total / 1000)).select("host", "path")  # 1000 rows at most
    hot = F.broadcast(hot.join(hits, ["host", "path"], "left").select("host", "path", F.coalesce("mined", F.lit("allow")).alias("judged")))
    # a url judged already gets a number of its own in place of 0, so it meets no hit and hot urls spread
    out = urls.withColumn("place", F.monotonically_increasing_id()).join(hot, ["host", "path"], "left")
    out = out.withColumn("apart", F.when(F.col("judged").isNull(), 0).otherwise(F.col("place") + 1))
    out = out.join(hits.withColumn("apart", F.lit(0).cast("long")), ["host", "path", "apart"], "left")
    named, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    return out.select("page_id", "host", "path", named.alias("rule"), F.coalesce(verdict, "judged", "mined", F.lit("allow")).alias("verdict"))
