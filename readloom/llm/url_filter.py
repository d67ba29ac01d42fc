"""Association-rule URL filtering: FP-growth over URL tokens, applied through an inverted index.

Rules of a given list (host suffix and path prefix, the longest wins) decide part of the URLs. Those verdicts are the
labels: each decided URL is a transaction of its tokens and its verdict, Spark's FP-growth mines the frequent sets,
and the association rules that conclude a verdict are kept if support and confidence suffice and no rule with fewer
tokens does as well. An undecided URL gets the verdict of its best rule (confidence, then support, then
more tokens, then the tokens themselves), else the default. Rules are found by an inverted index: each hangs on its rarest token, so a
URL meets those rules only whose rarest token it has, and they fire if it has the other tokens as well.

Defined cases: null and malformed URLs have an empty host and path and match no list rule; with no decided URL, or none
of one verdict, the rules that can be mined decide, else the default; rows that repeat an id or a URL get a row each;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import materialize

#: (verdict, host, path): fits the host and its subdomains if the path starts with the rule's.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DEFAULT = "allow"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without a ://."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return lower_ascii(host), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def list_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The struct (rule, verdict) of the longest rule that fits, or null. Length is that of host and path together."""
    out = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: labels of the host by kind of place, the words of labels that have several, path segments by place with digits folded.

    No token repeats what another one says, as that would square the frequent sets and tell nothing.
    """
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    ends = F.transform(labels, lambda x, i: F.concat(F.when(i == F.size(labels) - 1, F.lit("tld:")).otherwise(F.lit("host:")), x))
    several = F.filter(labels, lambda x: x.rlike("[-_]"))
    words = F.filter(F.flatten(F.transform(several, lambda x: F.split(x, "[-_]"))), lambda x: x != "")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    place = F.transform(parts, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit(":"), F.regexp_replace(x, "[0-9]+", "0")))
    return F.array_distinct(F.concat(ends, F.transform(words, lambda x: F.concat(F.lit("word:"), x)), place))


def mine_rules(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.7) -> DataFrame:
    """(tokens, verdict, confidence, support) from rows (tokens, verdict); the rarest token of each as anchor."""
    rows = labelled.select(F.array_append("tokens", F.concat(F.lit("verdict:"), F.col("verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(rows)
    concluded = (
        model.associationRules.withColumn("said", F.element_at("consequent", 1))
        .where(F.col("said").startswith("verdict:"))
        .select(
            F.array_sort("antecedent").alias("tokens"),
            F.substr("said", F.lit(9)).alias("verdict"),
            F.round("confidence", 9).alias("confidence"),
            F.round("support", 9).alias("support"),
        )
    )
    rules = materialize(concluded, "url-rules")
    # Prune what a rule with one token fewer says as surely.
    less = rules.select(
        "tokens", "verdict", "confidence", F.explode(F.transform(F.sequence(F.lit(1), F.size("tokens")), lambda i: F.array_except("tokens", F.array(F.element_at("tokens", i))))).alias("fewer")
    )
    short = rules.select(F.col("tokens").alias("fewer"), "verdict", F.col("confidence").alias("sure"))
    worse = less.where(F.size("tokens") > 1).join(short, ["fewer", "verdict"]).where("sure >= confidence").select("tokens", "verdict").distinct()
    kept = rules.join(worse, ["tokens", "verdict"], "left_anti")
    often = model.freqItemsets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("token"), "freq")
    places = kept.withColumn("token", F.explode("tokens")).join(often, "token")
    anchors = places.groupBy("tokens", "verdict").agg(F.min(F.struct("freq", "token")).getField("token").alias("anchor"))
    return materialize(kept.join(anchors, ["tokens", "verdict"]), "url-index")


def judge_urls(
    pages: DataFrame, rules=RULES, default: str = DEFAULT, min_support: float = 0.005, min_confidence: float = 0.7
) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, mined (tokens of the mined rule that decided)."""
    host, path = url_parts(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    kinds = materialize(
        rows.groupBy("host", "path").agg(F.count("*").alias("n"))
        .withColumn("listed", list_rule(F.col("host"), F.col("path"), rules))
        .withColumn("tokens", url_tokens(F.col("host"), F.col("path"))),
        "url-kinds",
    )
    labelled = kinds.where(F.col("listed").isNotNull() & (F.size("tokens") > 0)).select("tokens", F.col("listed.verdict").alias("verdict"))
    open_ = kinds.where("listed is null")
    found = None
    if not labelled.isEmpty():
        index = mine_rules(labelled, min_support, min_confidence)
        hits = (
            open_.select("host", "path", "tokens", F.explode("tokens").alias("anchor"))
            .join(index.withColumnRenamed("tokens", "needs"), "anchor")
            .where(F.size(F.array_except("needs", "tokens")) == 0)
        )
        best = F.struct("confidence", "support", F.size("needs").alias("n"), "needs", "verdict")
        found = hits.groupBy("host", "path").agg(F.max(best).alias("best"))
    judged = kinds.select("host", "path", "listed")
    if found is None:
        judged = judged.withColumn("best", F.lit(None).cast("struct<needs:array<string>,verdict:string>"))
    else:
        judged = judged.join(found, ["host", "path"], "left")
    judged = materialize(judged, "url-judged")  # a table, so that the join can split the rows of a hot URL
    return rows.join(judged, ["host", "path"]).select(
        "page_id", "host", "path", F.col("listed.rule").alias("rule"),
        F.coalesce("listed.verdict", "best.verdict", F.lit(default)).alias("verdict"),
        F.when(F.col("listed").isNull(), F.col("best.needs")).alias("mined"),
    )
