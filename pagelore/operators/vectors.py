"""Exact cosine top-k over stored vector blocks, and over the vectors of one document.

``write_blocks`` deals vectors out to blocks by their nearest anchor and stores, for each block, its centroid and the
angle that holds all members.  By the triangle inequality of angles no member is nearer to a query than the angle
to the centroid less that radius.  A query first meets the summaries (pages of them), scores the blocks with the highest
bounds, and its k-th score then leaves out every block whose bound is below it.  The plan is the same at every size.

Vectors meet queries in cells: a block is read once, the queries that concern it stream past, one matrix product an
Arrow batch.  No row holds two vectors, and k rows at most leave a cell for each query.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelore.operators.blocks import meet
from pagelore.session import ensure_checkpoint_dir

BLOCK_VECTORS = 2048
#: Anchors are so many of the vectors at most; a cell of an anchor has about so many blocks, and a page the summaries of so many cells.
MAX_ANCHORS, CELL_BLOCKS, PAGE_CELLS = 4096, 16, 256
FIRST_BLOCKS = 2
#: So many queries share a task where they meet a page of summaries; each such part of them reads the page.
PART_QUERIES = 8192
#: Scores are rounded to six decimals; a bound must fall short by more than that and the noise of the angles.
SLACK = 2e-6


def unit(matrix: list) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in matrix])
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)


def best(ids: np.ndarray, scores: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """Positions (or their values in ``at``) of the k best scores; equal scores go by id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= floor)
    else:
        keep = np.arange(len(scores))
    keep = keep[np.lexsort((ids[keep], -scores[keep]))][:k]
    return keep if at is None else at[keep]


def rank_rows(df: DataFrame, score: str, rank: str, k: int, *ties: str) -> DataFrame:
    """Number rows per query by falling score and keep k (cut before the shuffle by Spark)."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), *(ties or ("chunk_id",)))
    return df.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _member(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return rows["chunk_id"].to_numpy(), unit(rows["embedding"])


def score_cells(blocks: DataFrame, asked: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """``query_id``, ``chunk_id``, ``vector_score``: of each query and cell the k best.

    blocks: cell, chunk_id, embedding; asked: cell, query_id, embedding and, optionally, floor, below which a score is of no use.
    """
    floored = "floor" in asked.columns

    def answer(block: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids, matrix = block
        asking = rows["query_id"].to_numpy()
        scores = np.round(unit(rows["embedding"]) @ matrix.T, 6)
        if exclude_self:
            for i in np.flatnonzero(pd.Series(asking).isin(ids)):
                scores[i, ids == asking[i]] = -np.inf
        useful = np.isfinite(scores) & (scores >= rows["floor"].to_numpy()[:, None]) if floored else np.isfinite(scores)
        chosen = [best(ids[at], scores[i, at], k, at) for i, at in ((i, np.flatnonzero(useful[i])) for i in np.flatnonzero(useful.any(axis=1)))]
        lines = np.repeat(np.flatnonzero(useful.any(axis=1)), [len(at) for at in chosen])
        columns = np.concatenate(chosen) if chosen else np.array([], dtype=int)
        return pd.DataFrame({"query_id": asking[lines], "chunk_id": ids[columns], "vector_score": scores[lines, columns] + 0.0})

    return meet(blocks, asked, _member, answer, f"query_id {_type(asked, 'query_id')}, chunk_id {_type(blocks, 'chunk_id')}, vector_score double")


# --- all vectors -------------------------------------------------------------------
def write_blocks(vectors: DataFrame, folder: str, block_vectors: int = BLOCK_VECTORS) -> None:
    """Blocks of ``vectors`` (chunk_id, embedding) as a table ``folder``: the members, and on each first one the block's summary.

    Anchors are the vectors with the least hashed ids, one for each block's worth of vectors up to ``MAX_ANCHORS``; beyond
    that every anchor has several cells by hash.  A cell streams through a task, which cuts it into blocks.
    """
    v = vectors.select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding")).filter(F.col("embedding").isNotNull())
    n = v.count()
    wanted = max(1, min(MAX_ANCHORS, n // block_vectors))
    salts = max(1, -(-n // (wanted * block_vectors * CELL_BLOCKS)))
    anchors = v.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(wanted).select("embedding").toPandas()["embedding"]
    matrix = unit(list(anchors)).astype(np.float32) if len(anchors) else np.zeros((1, 1), dtype=np.float32)

    @F.pandas_udf("long")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series((unit(list(batch)).astype(np.float32) @ matrix.T).argmax(axis=1).astype("int64")) if len(batch) else pd.Series([], dtype="int64")

    def block(cell: int, number: int, rows: pd.DataFrame) -> pd.DataFrame:
        members = unit(rows["embedding"])
        mean = members.mean(axis=0)
        length = np.sqrt((mean * mean).sum())
        centre = mean / max(length, 1e-300)
        radius = float(np.arccos(np.clip((members @ centre).min(), -1, 1))) if length > 1e-9 else float(np.pi)
        rest = [None] * (len(rows) - 1)
        return pd.DataFrame({"page": cell // PAGE_CELLS, "block": (cell << 24) + number, "chunk_id": rows["chunk_id"].to_numpy(), "embedding": list(rows["embedding"]),
                             "centre": [centre, *rest], "radius": [radius, *rest]})

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, number, held, size = None, 0, [], 0
        for frame in frames:
            cells = frame["cell"].to_numpy()
            ends = np.flatnonzero(cells[1:] != cells[:-1]) + 1
            for low, high in zip(np.append(0, ends), np.append(ends, len(frame))):
                if low == high:
                    continue
                if cells[low] != cell:
                    if held:
                        yield block(cell, number, pd.concat(held))
                    cell, number, held, size = int(cells[low]), 0, [], 0
                while low < high:
                    taken = frame.iloc[low:min(high, low + block_vectors - size)]
                    held.append(taken)
                    low, size = low + len(taken), size + len(taken)
                    if size == block_vectors:
                        yield block(cell, number, pd.concat(held))
                        number, held, size = number + 1, [], 0
        if held:
            yield block(cell, number, pd.concat(held))

    cell = (nearest("embedding") * salts + F.pmod(F.xxhash64("chunk_id"), F.lit(salts))).alias("cell")
    kind = _type(v, "chunk_id")
    v.select(cell, "chunk_id", "embedding").repartition("cell").sortWithinPartitions("cell", "chunk_id").mapInPandas(
        cut, f"page long, block long, chunk_id {kind}, embedding array<float>, centre array<double>, radius double").write.mode("overwrite").parquet(folder)


def _bounds(queries: DataFrame, folder: str, first: int, parts: int = 1) -> DataFrame:
    """``query_id``, ``block``, ``bound``, ``embedding`` of blocks that queries have to see.

    Without ``floor`` in queries these are the ``first`` best-bounded blocks of each page of summaries, with it
    all blocks whose bound reaches the floor, except those ``seen`` (an array).  Queries come to a page in ``parts`` by hash.
    """
    spark = queries.sparkSession
    summaries = spark.read.parquet(folder).filter(F.col("radius").isNotNull()).select(F.col("page").alias("cell"), F.col("block").alias("summary_block"), "centre", "radius")
    pages = summaries.agg(F.max("cell")).scalar()
    page = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(pages, F.lit(0).cast("long"))))
    asked = queries.withColumn("cell", page).withColumn("cell", F.col("cell") * parts + F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    summaries = summaries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("cell", F.col("cell") * parts + F.col("part")).drop("part")
    floored = "floor" in queries.columns

    def load(rows: pd.DataFrame) -> tuple:
        blocks = rows["summary_block"].to_numpy()
        return blocks, np.stack([np.asarray(c) for c in rows["centre"]]), rows["radius"].to_numpy(), {b: j for j, b in enumerate(blocks)}

    def answer(page: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        blocks, centres, radii, column = page
        angles = np.arccos(np.clip(unit(rows["embedding"]) @ centres.T, -1, 1)) - radii
        limits = np.cos(np.maximum(angles, 0))
        if floored:
            wanted = limits >= rows["floor"].to_numpy()[:, None] - SLACK
            met = [(i, column[b]) for i, seen in enumerate(rows["seen"]) for b in seen if b in column]
            wanted[[i for i, _ in met], [j for _, j in met]] = False
            lines, at = np.nonzero(wanted)
        else:
            chosen = [best(blocks, line, first) for line in limits]
            lines, at = np.repeat(np.arange(len(rows)), [len(c) for c in chosen]), np.concatenate(chosen)
        return pd.DataFrame({"query_id": rows["query_id"].to_numpy()[lines], "block": blocks[at], "bound": limits[lines, at], "embedding": rows["embedding"].to_numpy()[lines]})

    return meet(summaries, asked, load, answer, f"query_id {_type(queries, 'query_id')}, block long, bound double, embedding array<float>")


def blocks_topk(queries: DataFrame, folder: str, k: int, exclude_self: bool = False, first_blocks: int = FIRST_BLOCKS) -> DataFrame:
    """``query_id``, ``chunk_id``, ``vector_score``, ``vector_rank``: exact top-k of every query (unique query_id) over stored blocks."""
    spark = queries.sparkSession
    ensure_checkpoint_dir(spark)
    stored = spark.read.parquet(folder).select(F.col("block").alias("cell"), "chunk_id", "embedding")
    q = queries.select("query_id", F.col("embedding").cast("array<float>").alias("embedding")).filter(F.col("embedding").isNotNull())

    def scored(chosen: DataFrame) -> DataFrame:
        blocks = stored.join(chosen.select(F.col("block").alias("cell")).distinct(), "cell", "left_semi")
        return score_cells(blocks, chosen.withColumnRenamed("block", "cell").drop("bound"), k, exclude_self)

    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    parts = max(1, -(-q.count() // PART_QUERIES))
    opening = _bounds(q, folder, first_blocks, parts).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= first_blocks).drop("_n").checkpoint()
    opened = scored(opening).checkpoint()
    floors = rank_rows(opened, "vector_score", "_n", k).filter(F.col("_n") == k).select("query_id", F.col("vector_score").alias("floor"))
    seen = opening.groupBy("query_id").agg(F.collect_list("block").alias("seen"))
    rest = q.join(seen, "query_id").join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    left = _bounds(rest, folder, first_blocks, parts).join(rest.select("query_id", "floor"), "query_id").checkpoint()
    return rank_rows(opened.unionByName(scored(left)), "vector_score", "vector_rank", k)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, exclude_self: bool = False, folder: str | None = None) -> DataFrame:
    """Exact cosine top-k of every query over all vectors.

    ``folder`` names blocks that ``write_blocks`` stored for these vectors; without it they are written for this call.
    """
    if folder is None:
        folder = f"{ensure_checkpoint_dir(vectors.sparkSession)}/vector-blocks-{uuid.uuid4().hex}"
        write_blocks(vectors, folder)
    return blocks_topk(queries, folder, k, exclude_self)


# --- one document ------------------------------------------------------------------
def vector_topk_prefilter(queries: DataFrame, vectors: DataFrame, k: int, exclude_self: bool = False, block_vectors: int = BLOCK_VECTORS) -> DataFrame:
    """Rank only the vectors of the query's own document.

    A document that is asked for is one cell; one with more vectors than a block holds is cut by hash, and its
    queries go to every part.  Vectors of other documents do not reach the exchange of the cells.
    """
    asked = queries.select("query_id", "document_id", F.col("embedding").cast("array<float>").alias("embedding")).filter(F.col("embedding").isNotNull())
    wanted = asked.select("document_id").distinct()
    sizes = vectors.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).join(wanted, "document_id", "left_semi").select(
        "document_id", F.ceil(F.col("n") / block_vectors).cast("long").alias("parts"))
    cell = lambda part: F.concat_ws("/", F.col("document_id").cast("string"), part.cast("string")).alias("cell")
    blocks = vectors.filter(F.col("embedding").isNotNull()).join(sizes, "document_id").select(
        cell(F.pmod(F.xxhash64("chunk_id"), F.col("parts"))), "chunk_id", F.col("embedding").cast("array<float>").alias("embedding"))
    parts = asked.join(sizes, "document_id").select("query_id", "document_id", "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    found = score_cells(blocks, parts.select(cell(F.col("part")), "query_id", "embedding"), k, exclude_self)
    return rank_rows(found, "vector_score", "vector_rank", k)


def vector_topk_postfilter(queries: DataFrame, vectors: DataFrame, k: int, allowed: DataFrame, exclude_self: bool = False,
                           folder: str | None = None) -> DataFrame:
    """Rank over everything first, then keep hits whose document is allowed for the query."""
    hits = vector_topk(queries, vectors, k, exclude_self, folder).join(vectors.select("chunk_id", "document_id"), "chunk_id")
    return hits.join(allowed.select("query_id", "document_id"), ["query_id", "document_id"], "left_semi")


def vector_count(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.count(F.lit(1)).alias("n_vectors"))
