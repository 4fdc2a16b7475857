"""Filter URLs by listed rules and by association rules mined from labelled pages.

A listed rule is a host with its subdomains and a path prefix; the longest that fits decides. Other
URLs are judged by mined rules: Spark's FP-growth finds combinations of URL tokens (scheme, host
labels and domains, path segments, file ending, query names, fragment) that go with the label *bad*,
pruned by support, confidence and lift. A rule is looked up by its rarest token and fits if all its
tokens are in the URL.

Mining uses all labelled pages. Tokens that always occur together (equal sets of pages, told by a count
and two XORs of hashes) are mined as one: any of them stands for its group in a rule, which gives the
verdicts of all combinations of them without listing these. Rules are a table; their number is bounded by the support threshold
and the table is stored, so the planner knows its size. URLs are judged once each, not once per page.

Defined results:

- null url or one without ``://``: host and path are empty, no rule fits, no token, allowed;
- an empty path begins with no rule's path;
- of listed rules of equal length the first listed decides;
- labels that are null count as good; without labelled pages or frequent combinations no rule is mined;
- a URL may have any number of tokens; its query names cost no more if they come together;
- repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cobaltmill.session import materialise, table

MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.4
MIN_LIFT = 1.2
BAD = "!bad"
#: Verdict, host, path prefix.
LISTED = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = LISTED) -> Column:
    """The longest rule that fits, as ``struct(rule, verdict)``; null if none does."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        rule = F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, rule).otherwise(chosen)
    return chosen


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL; digits in path segments count as one sign."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""),
                        lambda p: F.concat(F.lit("q:"), F.substring_index(p, "=", 1)))
    segments = F.transform(F.filter(F.split(path, "/"), lambda p: p != ""),
                           lambda p: F.concat(F.lit("p:"), F.regexp_replace(p, "[0-9]+", "0")))
    parts = F.split(host, "\\.")
    labels = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0))),
                         lambda p: F.concat(F.lit("h:"), p))
    ending = F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1)
    singles = F.array(
        F.concat(F.lit("s:"), F.regexp_extract(url, "^([A-Za-z]*)://", 1)),
        F.concat(F.lit("d:"), F.substring_index(host, ".", -2)),
        F.when(ending != "", F.concat(F.lit("e:"), ending)),
        F.when(F.regexp_extract(url, "#(.+)", 1) != "", F.lit("f:")))
    known = F.filter(F.concat(singles, labels, segments, names), lambda t: t.isNotNull())
    return F.when(F.contains(url, F.lit("://")), F.array_distinct(known)).otherwise(
        F.array().cast("array<string>"))


def token_groups(baskets: DataFrame, least: float) -> DataFrame:
    """``token, head, members`` of the tokens in at least ``least`` baskets (row, tokens, bad) that have the same
    baskets as others; ``head`` is the smallest of the ``members``, all of one basket."""
    row = F.col("row")
    held = baskets.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(row)).alias("x"),
        F.bit_xor(F.xxhash64(row, F.lit(1))).alias("y")).filter(F.col("n") >= least)
    groups = held.groupBy("n", "x", "y").agg(F.sort_array(F.collect_list("token")).alias("members"))
    return groups.filter(F.size("members") > 1).select(
        F.explode("members").alias("token"), F.col("members")[0].alias("head"), "members")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT,
         min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """Rules ``tokens, confidence, support, lift, anchor, others`` from rows (tokens, bad).

    ``anchor`` is the rarest of a rule's tokens. Where tokens always came together, ``tokens`` names the
    smallest, and ``others`` maps it to all of them.
    """
    spark = labelled.sparkSession
    schema = ("tokens array<string>, confidence double, support double, lift double, anchor string, "
              "others map<string,array<string>>")
    baskets = materialise(labelled.filter(F.size("tokens") > 0).select(
        F.monotonically_increasing_id().alias("row"), F.array_distinct("tokens").alias("tokens"), "bad"), "url-baskets")
    n = baskets.count()
    if not n:
        return spark.createDataFrame([], schema)
    groups = materialise(token_groups(baskets, min_support * n), "url-groups")
    follows = groups.filter("token <> head").select("token", F.lit(True).alias("follows"))
    heads = baskets.select("row", "bad", F.explode("tokens").alias("token")).join(follows, "token", "left")
    items = F.collect_list(F.when(F.col("follows").isNull(), F.col("token")))
    marked = heads.groupBy("row").agg(items.alias("tokens"), F.bool_or("bad").alias("bad")).select(
        F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(
        materialise(marked, "url-items"))
    found = model.associationRules.filter(
        (F.col("consequent") == F.array(F.lit(BAD))) & (F.col("lift") >= min_lift))
    rules = materialise(found.select(
        F.sort_array("antecedent").alias("tokens"), "confidence", "support", "lift"), "url-rules")
    freq = model.freqItemsets.filter(F.size("items") == 1).select(
        F.col("items")[0].alias("token"), "freq")
    joined = groups.filter("token = head").select("token", "members")
    parts = rules.select("tokens", F.explode("tokens").alias("token")).join(freq, "token").join(joined, "token", "left")
    known = F.collect_list(F.when(F.col("members").isNotNull(), F.struct("token", "members")))
    anchors = parts.groupBy("tokens").agg(
        F.min_by("token", F.struct("freq", "token")).alias("anchor"), F.map_from_entries(known).alias("others"))
    return materialise(rules.join(anchors, "tokens").select(
        "tokens", "confidence", "support", "lift", "anchor", "others"), "url-anchored")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """URLs (url, tokens) that a mined rule fits, with the highest confidence: ``url, confidence``.

    A rule fits if each of its tokens, or another that always came with it, is in the URL.
    """
    def any_of(token: Column) -> Column:
        return F.coalesce(F.try_element_at("others", token), F.array(token))

    posted = urls.select("url", "tokens", F.explode("tokens").alias("anchor"))
    named = rules.select(F.explode(any_of(F.col("anchor"))).alias("anchor"), "confidence",
                         F.transform("tokens", any_of).alias("need"))
    fits = F.forall("need", lambda some: F.arrays_overlap(some, F.col("tokens")))
    return posted.join(named, "anchor").filter(fits).groupBy("url").agg(
        F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, rules: DataFrame, listed: Sequence[tuple[str, str, str]] = LISTED) -> DataFrame:
    """``page_id, host, path, rule, verdict, confidence`` for every row of ``pages`` (page_id, url)."""
    listed_fit = listed_rule(F.col("host"), F.col("path"), listed)
    parsed = pages.select("page_id", "url", host_of(F.col("url")).alias("host"),
                          path_of(F.col("url")).alias("path")).withColumn("listed", listed_fit)
    urls = parsed.filter("listed is null and url is not null").select("url").distinct()
    found = match(urls.withColumn("tokens", url_tokens(F.col("url"))), rules)
    hits = materialise(found.withColumnRenamed("url", "_url"), "url-hits")
    open_ = parsed.filter("listed is null").join(hits, F.col("url") == F.col("_url"), "left")
    fixed = parsed.filter("listed is not null").withColumn("confidence", F.lit(None).cast("double"))
    verdict = F.coalesce(F.col("listed.verdict"),
                         F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return fixed.unionByName(open_.drop("_url")).select(
        "page_id", "host", "path", F.col("listed.rule").alias("rule"), verdict.alias("verdict"), "confidence")


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (tokens, bad) of the pages whose document is labelled.

    A page's document is named by the last number in its path; a document of low quality or with toxic
    text is bad.
    """
    number = F.regexp_extract(path_of(F.col("url")), "([0-9]{1,18})[^0-9]*$", 1)
    numbered = pages.select("url", number.try_cast("long").alias("doc_id"))
    bad = F.coalesce(F.max(F.greatest(1 - F.col("quality"), F.col("toxic"))), F.lit(0)) > 0
    judged = labels.filter("doc_id is not null").groupBy("doc_id").agg(bad.alias("bad"))
    return numbered.filter("doc_id is not null").join(judged, "doc_id").select(
        url_tokens(F.col("url")).alias("tokens"), "bad")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, mine(page_labels(pages, table(spark, sf_dir, "labels"))))
