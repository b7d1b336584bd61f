"""URL filters: fixed host and path rules, and association rules mined from labels. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import staged

#: (verdict, host, path), the rules of op1.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
BAD = "label=bad"
#: The fewest bad pages that a mined rule rests on, and by how many deviations its confidence lies above the base rate.
LEAST, SURE = 10, 4.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: on to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of ``rule`` and ``verdict``; null if none does."""
    fits = []
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        on_host = (host == h) | F.endswith(host, F.lit("." + h))
        fits.append(F.when(on_host & F.startswith(path, F.lit(p)), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits)


def tokens(host: Column, path: Column) -> Column:
    """A url's distinct items: host labels, path words, with digits standing for any number."""
    parts = lambda c, mark: F.transform(F.filter(F.split(F.regexp_replace(F.lower(c), "[0-9]+", "0"), "[^a-z0-9]+"), lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    return F.array_distinct(F.concat(parts(host, "h:"), parts(path, "p:")))


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``(page_id, url, bad)`` of the pages that ``labels`` knows: bad if toxic or of quality 0 in any of the rows whose doc_id is the page_id."""
    bad = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False)).cast("int")).alias("bad"))
    urls = pages.where("url IS NOT NULL").select("page_id", "url")
    return urls.join(bad, urls["page_id"] == bad["doc_id"]).select("page_id", "url", "bad")


def wilson(good: Column, n: Column, z: float = SURE) -> Column:
    """The lower end of the Wilson interval of ``good`` of ``n``."""
    p = good / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def mine(pages: DataFrame, labels: DataFrame, min_support: float = 0.002, min_confidence: float = 0.5, min_lift: float = 1.5, least: int = LEAST) -> DataFrame:
    """Rules ``(rule_id, items, confidence, support)`` whose consequent is a bad page, from ``labelled`` pages.

    FP-growth runs over all labelled pages; its memory is that of the frequent item sets, which ``min_support`` and ``least`` bound.
    A rule rests on ``least`` bad pages at least, and on ``min_support`` of all. Rules below the confidence or lift
    given are dropped, and so are those whose confidence could be the base rate's by chance: its Wilson bound of ``SURE`` deviations has to lie above
    that. Last go the rules that any shorter rule of no less confidence implies.
    """
    from pyspark.ml.fpm import FPGrowth

    host, path = host_and_path(F.col("url"))
    marked = labelled(pages, labels).select(tokens(host, path).alias("items"), "bad").where("size(items) > 0")
    n, bad = marked.agg(F.count(F.lit(1)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    spark = pages.sparkSession
    if not bad:
        return spark.createDataFrame([], "rule_id bigint, items array<string>, confidence double, support double")
    marked = marked.select(F.concat("items", F.when(F.col("bad") == 1, F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    fewest = max(least, math.ceil(min_support * n))
    # half a page less, so that no rounding of the ratio asks for one page more
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, (fewest - 0.5) / n), minConfidence=min_confidence).fit(marked).associationRules
    kept = found.where((F.col("consequent")[0] == BAD) & (F.col("lift") >= min_lift)).select(F.array_sort("antecedent").alias("items"), "confidence", "support")
    hits = F.round(F.col("support") * n)
    kept = kept.where(wilson(hits, F.round(hits / F.col("confidence"))) > bad / n).withColumn("rule_id", F.xxhash64("items"))
    kept = staged(kept, "rules")
    # a shorter rule is listed under its first item; a longer one meets it there
    short = kept.select(F.col("items")[0].alias("item"), F.col("items").alias("part"), F.col("confidence").alias("as_sure"))
    longer = kept.select("rule_id", "confidence", "items", F.explode("items").alias("item"))
    within = (F.size("part") < F.size("items")) & (F.col("as_sure") >= F.col("confidence")) & (F.size(F.array_except("part", "items")) == 0)
    implied = longer.join(short, "item").where(within).select("rule_id").distinct()
    return kept.join(implied, "rule_id", "left_anti")


def held_out_precision(pages: DataFrame, labels: DataFrame, folds: int = 5, **options) -> DataFrame:
    """One row ``pages, bad, caught, caught_bad``: how rules mined from the other pages do on a fold chosen by a hash of the url."""
    fold = F.pmod(F.xxhash64("url"), F.lit(folds)) == 0
    rules = mine(pages.where(~fold), labels, **options)
    held = labelled(pages.where(fold), labels)
    found = held.join(match(held.select("url"), rules), "url", "left")
    hit = F.col("mined_rule").isNotNull()
    return found.agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count_if(hit).alias("caught"), F.count_if(hit & (F.col("bad") == 1)).alias("caught_bad"))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(url, mined_rule, confidence)`` of each distinct url that some mined rule fits: its surest rule.

    An inverted index lists each rule under its least frequent item only, so a url meets few
    rules; the other items are then checked in place.
    """
    host, path = host_and_path(F.col("url"))
    held = urls.where("url IS NOT NULL").select("url").distinct().select("url", tokens(host, path).alias("has"))
    posted = held.select("url", "has", F.explode("has").alias("item"))
    wanted = rules.select(F.explode("items").alias("item")).distinct()
    # counted before the join: a very common item is then a row a task, not all its rows in one task
    often = posted.groupBy("item").agg(F.count(F.lit(1)).alias("n")).join(wanted, "item", "left_semi")
    listed = rules.select("rule_id", "items", "confidence", F.explode("items").alias("item")).join(often, "item", "left")
    index = listed.groupBy("rule_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "item")).alias("rarest"), F.first("items").alias("items"), F.first("confidence").alias("confidence")).select(F.col("rarest.item").alias("item"), "items", "confidence")
    hits = posted.join(index, "item").where(F.size(F.array_except("items", "has")) == 0)
    best = hits.groupBy("url").agg(F.max(F.struct("confidence", F.array_join("items", " ").alias("mined_rule"))).alias("best"))
    return best.select("url", F.col("best.mined_rule").alias("mined_rule"), F.col("best.confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, **options) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined_rule, confidence`` of every row of ``pages``.

    A fixed rule decides if one fits; else a page is blocked if a mined rule fits its url and
    allowed if none does. A null url, or one without ``://``, has an empty host and path and is allowed.
    Repeated rows and rows with a null page_id are judged like any; very long urls are read whole. No labels, no mined rules; an
    empty table gives no rows. Other columns are not read.
    """
    mined = mine(pages, labels, **options)
    found = match(pages, mined).withColumnRenamed("url", "__url")
    host, path = host_and_path(F.col("url"))
    base = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    judged = base.join(found, base["url"] == found["__url"], "left").withColumn("fixed", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("fixed.verdict"), F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), "mined_rule", "confidence")


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op1 over the whole ``pages`` table."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP1_SQL = r"""
WITH RECURSIVE u AS (
  SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
i AS (
  SELECT *, list_sort(list_distinct(list_concat(
    list_transform(list_filter(regexp_split_to_array(regexp_replace(lower(host), '[0-9]+', '0', 'g'), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: 'h:' || x),
    list_transform(list_filter(regexp_split_to_array(regexp_replace(lower(path), '[0-9]+', '0', 'g'), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: 'p:' || x)))) AS items FROM h),
bad AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
marked AS (SELECT row_number() OVER () AS k, items, bad FROM i JOIN bad ON i.page_id = bad.doc_id WHERE url IS NOT NULL AND len(items) > 0),
totals AS (SELECT count(*) AS n, sum(bad) AS b FROM marked),
common AS (SELECT item FROM (SELECT unnest(items) AS item, bad FROM marked) z GROUP BY item HAVING sum(bad) >= 10),
slim AS (SELECT k, list_sort(list_intersect(items, l)) AS items, bad FROM marked, (SELECT coalesce(list(item), CAST([] AS VARCHAR[])) AS l FROM common) c),
sub AS (
  SELECT k, bad, items, CAST([] AS VARCHAR[]) AS s, 0 AS upto FROM slim
  UNION ALL
  SELECT k, bad, items, list_append(s, items[j]), j FROM (SELECT *, unnest(range(upto + 1, len(items) + 1)) AS j FROM sub) z),
counted AS (SELECT s, count(*) AS n, sum(bad) AS b FROM sub WHERE len(s) > 0 GROUP BY s),
rules AS (
  SELECT s, c.b / c.n AS confidence, (c.b / c.n + 16.0 / (2 * c.n) - 4.0 * sqrt((c.b / c.n) * (1 - c.b / c.n) / c.n + 16.0 / (4 * c.n * c.n))) / (1 + 16.0 / c.n) AS low, t.b / t.n AS base
  FROM counted c, totals t WHERE c.b >= greatest(10, ceil(0.002 * t.n)) AND c.b / c.n >= 0.5 AND (c.b / c.n) / (t.b / t.n) >= 1.5),
sure AS (SELECT s, confidence FROM rules WHERE low > base),
kept AS (SELECT s, confidence FROM sure a WHERE NOT EXISTS (SELECT 1 FROM sure b WHERE len(b.s) < len(a.s) AND b.confidence >= a.confidence AND list_has_all(a.s, b.s))),
hit AS (
  SELECT url, array_to_string(s, ' ') AS mined_rule, confidence, row_number() OVER (PARTITION BY url ORDER BY confidence DESC, array_to_string(s, ' ') DESC) AS r
  FROM (SELECT DISTINCT url, items FROM i WHERE url IS NOT NULL) x JOIN kept ON list_has_all(items, s)),
fixed AS (
  SELECT i.*, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM i)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN mined_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, mined_rule, confidence
FROM fixed LEFT JOIN hit ON fixed.url = hit.url AND hit.r = 1
"""
