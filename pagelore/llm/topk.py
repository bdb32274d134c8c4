"""Exact top-k by block-at-a-time pruning.

Vectors lie in blocks of a document range, each with its forward index (the packed integer
vectors) and the extremes of each component.  For a query the blocks of a task are ordered by the
sum of what each component can add at most; blocks are scored in that order until the next bound
falls below the query's k-th score.  Queries are scored in blocks against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelore.llm.common import table

K = 10
SCALE = 1024
BLOCK_ROWS = 256
#: Blocks that a task scores at a time, and queries of a query block.
BLOCKS_PER_SHARD = 32
QUERY_ROWS = 1024


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector whose components are all finite, as ``vec_id`` and integer ``vec``."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(F.lit(float(SCALE)) * v)).alias("vec"))


def _matrix(vecs: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vecs), width))
    for i, v in enumerate(vecs):
        out[i, : len(v)] = v
    return out


def search_shard(queries: pd.DataFrame, docs: pd.DataFrame, k: int = K) -> pd.DataFrame:
    """The k best of these rows for each of these queries, ties to the smaller id; the own row is left out."""
    empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    if queries.empty or docs.empty:
        return empty
    docs = docs.sort_values("vec_id", kind="stable")
    width = max(max(map(len, docs.vec)), max(map(len, queries.vec)), 1)
    q, d = _matrix(queries.vec, width), _matrix(docs.vec, width)
    ids, qids = docs.vec_id.to_numpy(), queries.vec_id.to_numpy()
    starts = range(0, len(d), BLOCK_ROWS)
    top, bottom = (np.array([f(d[s : s + BLOCK_ROWS], axis=0) for s in starts]) for f in (np.max, np.min))
    exact = np.abs(q).max() * np.abs(d).max() * width < 2**53  # then floats carry the integers unchanged
    if not exact:
        q, d, top, bottom = (np.vectorize(int, otypes=[object])(x) for x in (q, d, top, bottom))
    plus, minus = np.where(q > 0, q, 0), np.where(q < 0, q, 0)
    bounds = plus @ top.T + minus @ bottom.T
    found = []
    for i in range(len(q)):
        scores, rows = np.empty(0, dtype=q.dtype), np.empty(0, dtype="int64")
        for b in np.argsort(-bounds[i].astype(float), kind="stable"):
            if len(scores) == k and bounds[i, b] < scores[-1]:
                break  # a bound equal to the k-th score may still win by its id
            at = slice(b * BLOCK_ROWS, (b + 1) * BLOCK_ROWS)
            other = ids[at] != qids[i]
            scores = np.concatenate([scores, (d[at] @ q[i])[other]])
            rows = np.concatenate([rows, ids[at][other]])
            best = np.lexsort((rows, -scores.astype(float) if exact else [-s for s in scores]))[:k]
            scores, rows = scores[best], rows[best]
        found.append(pd.DataFrame({"query_id": qids[i], "vec_id": rows, "score": scores.astype("int64") if exact else [int(s) for s in scores]}))
    return pd.concat(found) if found else empty


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of each query's k highest integer products.

    Both sides have ``vec_id`` and ``embedding``; rows with a null id, a null vector or a null or
    non-finite component take no part.  Shorter vectors count as padded with zeros.  Ties go to the
    smaller id.  A repeated query row gives its answer once; repeated candidate rows stand for
    themselves.  A query without candidates, and an empty table, give no rows.
    """
    rows, asked = usable(vectors), usable(queries).dropDuplicates(["vec_id"])
    per_shard = BLOCK_ROWS * BLOCKS_PER_SHARD
    shards = max(1, -(-rows.count() // per_shard))
    parts = max(1, -(-asked.count() // QUERY_ROWS))
    # ranges of documents: the rows in order of their ids, some thousands to a shard
    placed = rows.repartitionByRange(shards, F.col("vec_id"), F.xxhash64("vec")).withColumn("shard", F.spark_partition_id())
    right = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    left = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def score(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        return search_shard(q, d, k)

    local = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInPandas(score, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_topk(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


QUERIES = {"op4_block_topk": op4_block_topk}

ORACLE = {"op4_block_topk": f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(q.vec, d.vec) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= {K}"""}
