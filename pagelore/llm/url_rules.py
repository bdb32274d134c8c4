"""Association-rule URL filter.

Host and path tokens of labelled urls are mined with Spark's FP-growth.  Rules that lead to the
block label are kept by support and confidence and stored in an inverted index under their
rarest token, so a url meets only the rules that share that token with it.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.llm.common import cut, own, replace, table

#: Listed rules (host and path prefix) and their verdicts.
LISTED = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.9
#: A rule rests on so many blocked rows at least, however few are labelled.
MIN_ROWS = 5
BLOCK = "label:block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, listed=LISTED) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(listed, key=lambda r: len(r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column) -> Column:
    """Host labels and runs of letters or digits of the path; a number stands for all numbers."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda t: t != ""), lambda t: F.concat(F.lit("h:"), t))
    words = F.filter(F.split(F.translate(path, UPPER, LOWER), r"[^a-z0-9]+"), lambda t: t != "")
    words = F.transform(words, lambda t: F.concat(F.lit("p:"), F.when(t.rlike("^[0-9]+$"), "#").otherwise(t)))
    return F.array_distinct(F.concat(labels, words))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_rows: int = MIN_ROWS) -> DataFrame:
    """Inverted index ``token``, ``antecedent`` of the block rules mined from ``tokens``, ``blocked``.

    A rule stands under its rarest token.  No labelled row gives no rule.
    """
    need = max(min_support * labelled.count(), min_rows)
    return _combinations(labelled, need, min_confidence, labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq")))


def _combinations(labelled: DataFrame, need: float, min_confidence: float, counts: DataFrame) -> DataFrame:
    """Rules that rest on ``need`` blocked rows, by FP-growth over the tokens of the rows."""
    baskets = labelled.select(F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit(BLOCK)))).otherwise(F.col("tokens")).alias("items"))
    # half a row less: the miner rounds up
    support = min(1.0, (need - 0.5) / max(labelled.count(), 1))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.filter(F.col("consequent")[0] == BLOCK).select("antecedent")
    return (
        rules.select("antecedent", F.explode("antecedent").alias("token")).join(counts.select("token", "freq"), "token")
        .groupBy("antecedent").agg(F.min_by("token", F.struct("freq", "token")).alias("token"))
    )


def mine_minimal(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_rows: int = MIN_ROWS) -> DataFrame:
    """The rules of ``mine`` that match the same urls, without those that hold a token which is a rule by itself.

    A set that holds a rule matches no url more.  So such tokens never reach the miner, and neither do tokens with too
    few blocked rows: a long url that repeats is not listed in all its subsets.  What is mined are combinations of
    tokens that occur often on both sides.
    """
    rows = labelled.select("tokens", F.coalesce("blocked", F.lit(False)).alias("blocked"))
    need = max(min_support * rows.count(), min_rows)
    counts = rows.select("blocked", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"), F.count_if("blocked").alias("hits"))
    frequent = cut(counts.filter(F.col("hits") >= need))  # at most the tokens of a url over the support
    alone = F.col("hits") / F.col("freq") >= min_confidence
    single = frequent.filter(alone).select(F.array("token").alias("antecedent"), "token")
    open_tokens = frequent.filter(~alone).agg(F.collect_list("token")).scalar()
    baskets = cut(rows.select(F.array_intersect("tokens", open_tokens).alias("tokens"), "blocked").filter(F.size("tokens") > 1))
    return single if baskets.isEmpty() else single.unionByName(_combinations(baskets, need, min_confidence, frequent))


def judge_urls(pages: DataFrame, listed=LISTED, labelled: DataFrame | None = None, min_support: float = MIN_SUPPORT,
               min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """All rows and columns of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    A listed rule decides where one fits.  Elsewhere a url is blocked if a mined rule's tokens are
    all among its own, else allowed.  Rules are mined from ``labelled`` (``host``, ``path``, ``blocked``)
    or, if not given, from the urls that the list decides.  Null urls and urls without ``://`` have an
    empty host and path and are allowed.  Repeated rows are judged alike; an empty table gives an
    empty result; input columns named like an output give way.
    """
    url = F.col("url")
    base = pages.withColumns({"_host": host_of(url), "_path": path_of(url)})
    rule, verdict = listed_rule(F.col("_host"), F.col("_path"), listed)
    base = base.withColumns({"_rule": rule, "_listed": verdict})
    if labelled is None:
        labelled = base.filter("_listed is not null").select(F.col("_host").alias("host"), F.col("_path").alias("path"), (F.col("_listed") == "block").alias("blocked"))
    index = mine_minimal(labelled.select(tokens(F.col("host"), F.col("path")).alias("tokens"), "blocked"), min_support, min_confidence)

    # each distinct url that the list leaves open meets the index once
    asked = base.filter("_listed is null").select("_host", "_path").distinct().withColumn("tokens", tokens(F.col("_host"), F.col("_path")))
    hits = (
        asked.withColumn("token", F.explode("tokens")).join(index, "token")
        .filter(F.size(F.array_except("antecedent", "tokens")) == 0).select("_host", "_path").distinct().withColumn("_mined", F.lit("block"))
    )
    judged = base.join(hits, ["_host", "_path"], "left")
    outputs = {"host": F.col("_host"), "path": F.col("_path"), "rule": F.col("_rule"), "verdict": F.coalesce("_listed", "_mined", F.lit("allow"))}
    return replace(judged, outputs).drop("_host", "_path", "_rule", "_listed", "_mined")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(own(table(spark, sf_dir, "pages"), "page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op3_url_rules": op3_url_rules}

_FITS = " ".join(
    f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{{{i}}}'"
    for i, (r, _) in sorted(enumerate(LISTED), key=lambda x: -len(x[1][0])))

ORACLE = {"op3_url_rules": rf"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, CASE {_FITS.format(*[r for r, _ in LISTED])} END AS rule, CASE {_FITS.format(*[v for _, v in LISTED])} END AS listed FROM parts),
urls AS (
  SELECT *, list_sort(list_distinct(list_concat(
      list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
      list_transform(list_filter(regexp_split_to_array(translate(path, '{UPPER}', '{LOWER}'), '[^a-z0-9]+'), lambda x: x <> ''),
        lambda x: 'p:' || CASE WHEN regexp_full_match(x, '[0-9]+') THEN '#' ELSE x END)))) AS tokens
  FROM ruled),
labelled AS (SELECT row_number() OVER () AS n, tokens, listed = 'block' AS blocked FROM urls WHERE listed IS NOT NULL),
subsets AS (
  SELECT blocked, list_filter(tokens, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS items
  FROM (SELECT blocked, tokens, unnest(range(1, CAST(1 << len(tokens) AS BIGINT))) AS mask FROM labelled)),
rules AS (
  SELECT items FROM subsets GROUP BY items
  HAVING count(*) FILTER (blocked) >= greatest({MIN_ROWS}, (SELECT ceil({MIN_SUPPORT} * count(*)) FROM labelled))
    AND CAST(count(*) FILTER (blocked) AS DOUBLE) / count(*) >= {MIN_CONFIDENCE}),
asked AS (SELECT DISTINCT host, path, tokens FROM urls WHERE listed IS NULL),
hits AS (SELECT DISTINCT host, path FROM asked, rules WHERE list_has_all(tokens, items))
SELECT u.page_id, u.host, u.path, u.rule, coalesce(u.listed, CASE WHEN h.host IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM urls u LEFT JOIN hits h ON u.host = h.host AND u.path = h.path"""}
