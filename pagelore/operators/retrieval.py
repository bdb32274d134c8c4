"""Embeddings, BM25, fused ranking and content search; vector top-k is in ``vectors``, the corpus-wide BM25 index in ``bm25``.

Ranks are made on scores rounded to six decimals with the chunk key as the last
tie-break, so a ranking does not depend on the order in which sums were added.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelore.functions import fixed_values as fv
from pagelore.functions import text as tx
from pagelore.operators.substring import matches
from pagelore.operators.vectors import rank_rows, vector_count, vector_topk, vector_topk_postfilter, vector_topk_prefilter  # noqa: F401
from pagelore.session import BROADCAST_ROWS, ensure_checkpoint_dir

EMBED_DIM = 256
CORPUS = "corpus_id"


# --- embeddings --------------------------------------------------------------
def hashed_embedding(text: Column, dim: int = EMBED_DIM) -> Column:
    """Unit vector of hashed word counts: words are hashed in the JVM, counted in numpy."""
    buckets = F.transform(
        tx.lower_words(text), lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % dim).cast("int")
    )

    @F.pandas_udf("array<float>")
    def unit_counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for ids in batch:
                counts = np.bincount(np.asarray(ids, dtype=np.int64), minlength=dim).astype(np.float64)
                out.append((counts / max(np.sqrt((counts * counts).sum()), 1e-12)).astype(np.float32))
            yield pd.Series(out)

    return unit_counts(buckets)


def embed_texts(df: DataFrame, text: str, embedder: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add ``embedding``; ``embedder`` may be any (pandas) function column over the text."""
    return df.withColumn("embedding", (embedder or hashed_embedding)(F.col(text)))


# --- BM25 --------------------------------------------------------------------
def term_counts(tokens: Column) -> Column:
    """Distinct terms of one text with their counts: run lengths of the sorted tokens."""
    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return tx.let(starts, lambda b: F.transform(
            b, lambda at, j: F.struct(F.get(s, at).alias("term"), (F.coalesce(F.get(b, j + 1), F.size(s)) - at).alias("tf"))))

    empty = F.array().cast("array<struct<term:string,tf:int>>")
    return F.when(F.size(tokens) == 0, empty).otherwise(tx.let(F.sort_array(tokens), runs))


def postings(docs: DataFrame, key: str = "chunk_id", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(documents with length and counted terms, exploded postings); nothing is shuffled."""
    counted = docs.select(CORPUS, key, tx.lower_words(F.col(content)).alias("tokens")).select(
        CORPUS, key, F.size("tokens").alias("dl"), term_counts(F.col("tokens")).alias("terms")
    )
    return counted, counted.select(CORPUS, key, "dl", F.inline("terms"))


def bm25_scores(queries: DataFrame, docs: DataFrame, key: str = "chunk_id", content: str = "content",
                k1: float = fv.BM25_K1, b: float = fv.BM25_B, epsilon: float = fv.BM25_EPSILON) -> DataFrame:
    """Okapi scores of (query, text) pairs that share a term; other pairs score zero.

    ``corpus_id`` separates corpora, so a global corpus and one corpus per query run
    through the same plan.  Document frequencies and lengths are aggregated before
    any shuffle; the query terms meet the postings in a join that Spark broadcasts
    when the query side is small and splits when a term is hot.
    """
    counted, posts = postings(docs, key, content)
    sizes = counted.groupBy(CORPUS).agg(
        F.count(F.lit(1)).alias("n_docs"), (F.sum("dl") / F.count(F.lit(1))).alias("avgdl"))
    freq = posts.groupBy(CORPUS, "term").agg(F.count(F.lit(1)).alias("df")).join(sizes, CORPUS)
    raw = freq.withColumn("idf", F.ln(F.col("n_docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    average = raw.groupBy(CORPUS).agg(F.avg("idf").alias("avg_idf"))

    q_terms = queries.select("query_id", CORPUS, F.inline(term_counts(tx.lower_words(F.col("query"))))).withColumnRenamed("tf", "qtf")
    weights = q_terms.join(raw, [CORPUS, "term"]).join(average, CORPUS).select(
        "query_id", CORPUS, "term", "avgdl",
        (F.col("qtf") * F.when(F.col("idf") < 0, F.col("avg_idf") * epsilon).otherwise(F.col("idf"))).alias("weight"),
    )
    tf, dl = F.col("tf"), F.col("dl")
    part = F.col("weight") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("avgdl")))
    return (
        posts.join(weights, [CORPUS, "term"]).select("query_id", key, part.alias("part"))
        .groupBy("query_id", key).agg(F.round(F.sum("part"), 6).alias("bm25_score"))
    )


def normalize_scores(scores: DataFrame, score: str, out: str) -> DataFrame:
    """Min-max per query; equal scores become 1.  The extremes are combined before the shuffle, so no query's rows meet in one place.

    ``scores`` is read twice: a dear one should be stored.
    """
    ends = scores.groupBy(F.col("query_id").alias("_asked")).agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    ensure_checkpoint_dir(scores.sparkSession)
    ends = ends.checkpoint()
    few = ends.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # then the scores stay where they are
    joined = scores.join(F.broadcast(ends) if few else ends, F.col("query_id").eqNullSafe(F.col("_asked")))
    return joined.withColumn(out, _scaled(F.col(score), F.col("_low"), F.col("_high"))).drop("_asked", "_low", "_high")


def _scaled(score: Column, low: Column, high: Column) -> Column:
    return F.coalesce((score - low) / F.nullif(high - low, F.lit(0.0)), F.lit(1.0))


# --- fused search ------------------------------------------------------------
HIT_COLUMNS = ["query_id", "rank", "chunk_id", "document_id", "page_number", "chunk_index", "source_type", "content",
               "bm25_score", "vector_score", "final_score"]


def candidates(queries: DataFrame, vectors: DataFrame, k: int, documents: DataFrame | None = None, blocks: str | None = None,
               one_document: bool = False) -> DataFrame:
    """Vector candidates by scope: one document before ranking, several after.

    A question that names no document is asked of its owner's processed documents: the best of all
    are kept where they are in one of those.  Without ``documents`` or without ``owner_id`` in ``queries``
    such a question is unrestricted.  ``blocks`` names stored vector blocks of ``vectors``; with ``one_document`` all questions name one.
    """
    one = F.coalesce(F.size("document_ids") == 1, F.lit(False))
    narrow = queries.filter(one).select("query_id", "embedding", F.get("document_ids", F.lit(0)).alias("document_id"))
    wide = queries.filter(~one)
    meta = vectors.drop("embedding")
    scoped = vector_topk_prefilter(narrow, vectors, k).join(meta, "chunk_id")
    if one_document:
        return scoped
    owners = documents is not None and "owner_id" in queries.columns
    asker = ["owner_id"] if owners else []
    ranked = vector_topk(wide, vectors, k, folder=blocks).join(meta, "chunk_id").join(wide.select("query_id", "document_ids", *asker), "query_id")
    several = F.coalesce(F.size("document_ids") > 1, F.lit(False))
    if owners:
        own = documents.filter(F.col("status") == "processed").select(F.col("id").alias("document_id"), "owner_id").withColumn("_own", F.lit(True))
        ranked = ranked.join(own, ["document_id", "owner_id"], "left")
        allowed = F.when(several, F.array_contains("document_ids", F.col("document_id"))).otherwise(F.coalesce("_own", F.lit(False)))
    else:
        allowed = ~several | F.array_contains("document_ids", F.col("document_id"))
    return scoped.unionByName(ranked.filter(allowed).drop("document_ids", "owner_id", "_own"))


def hybrid_search(queries: DataFrame, vectors: DataFrame, top_k: int = fv.TOP_K, bm25_weight: float = fv.BM25_WEIGHT,
                  vector_weight: float = fv.VECTOR_WEIGHT, over_fetch: int = 3, documents: DataFrame | None = None,
                  blocks: str | None = None, one_document: bool = False) -> DataFrame:
    """Vector candidates re-scored by BM25 among themselves; both min-max scaled, weighted, cut to k.

    queries: query_id, query, embedding, document_ids; vectors: chunk_id, document_id,
    content, embedding and any page columns.  Once the few candidates of a query are
    together (one exchange on query_id) every later step works on that partitioning.
    """
    found = candidates(queries, vectors, top_k * over_fetch, documents, blocks, one_document)
    return fuse(candidate_bm25(found, queries), top_k, bm25_weight, vector_weight)


def candidate_bm25(found: DataFrame, queries: DataFrame, k1: float = fv.BM25_K1, b: float = fv.BM25_B, epsilon: float = fv.BM25_EPSILON) -> DataFrame:
    """BM25 of each candidate with the candidates of its query as the corpus; one that shares no term scores zero.

    Same formula as ``bm25_scores``; the corpora hold k candidates at most, so the
    statistics are windows over query_id.  A term with n postings adds 1/n per posting
    to the sums behind the mean inverse frequency.
    """
    by_query, by_term = Window.partitionBy("query_id"), Window.partitionBy("query_id", "term")
    found = found.join(queries.select("query_id", term_counts(tx.lower_words(F.col("query"))).alias("asked")), "query_id")
    sized = found.withColumn("_tokens", tx.lower_words(F.col("content"))).withColumn("dl", F.size("_tokens")).select(
        "*", F.count(F.lit(1)).over(by_query).alias("n_docs"), F.avg("dl").over(by_query).alias("avgdl"),
        term_counts(F.col("_tokens")).alias("_terms"))
    kept = [c for c in found.columns if c != "asked"]
    posts = sized.drop("_tokens").select("*", F.inline_outer("_terms")).drop("_terms").withColumn("df", F.count("term").over(by_term))
    idf = F.ln(F.col("n_docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    posts = posts.withColumn("idf", F.when(F.col("term").isNotNull(), idf))
    average = F.sum(F.col("idf") / F.col("df")).over(by_query) / F.sum(F.when(F.col("term").isNotNull(), 1.0 / F.col("df"))).over(by_query)
    qtf = F.get(F.filter("asked", lambda t: t["term"] == F.col("term")), F.lit(0))["tf"]
    weighed = posts.withColumn("weight", qtf * F.when(F.col("idf") < 0, average * epsilon).otherwise(F.col("idf")))
    tf, dl = F.col("tf"), F.col("dl")
    part = F.col("weight") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("avgdl")))
    keep = [F.first(c).alias(c) for c in kept if c not in ("query_id", "chunk_id")]
    return weighed.groupBy("query_id", "chunk_id").agg(
        *keep, F.round(F.coalesce(F.sum(part), F.lit(0.0)), 6).alias("bm25_score"))


def fuse(scored: DataFrame, top_k: int, bm25_weight: float = fv.BM25_WEIGHT, vector_weight: float = fv.VECTOR_WEIGHT) -> DataFrame:
    """A query holds at most the over-fetched candidates here, so windows per query stay small."""
    group = Window.partitionBy("query_id")

    def scaled(name: str) -> Column:
        return _scaled(F.col(name), F.min(name).over(group), F.max(name).over(group))

    fused = scored.select(
        "*", scaled("vector_score").alias("_v"), scaled("bm25_score").alias("_b")
    ).withColumn("final_score", F.round(vector_weight * F.col("_v") + bm25_weight * F.col("_b"), 4))
    fused = fused.withColumn("vector_score", F.round("_v", 6)).withColumn("bm25_score", F.round("_b", 6)).drop("_v", "_b")
    ranked = rank_rows(fused, "final_score", "rank", top_k, "vector_rank")
    return ranked.select(*[c for c in HIT_COLUMNS if c in ranked.columns])


def rerank(queries: DataFrame, hits: DataFrame, top_k: int = fv.TOP_K, scorer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Overwrite the score with ``scorer(query, content)`` and rank again; old ranks break ties."""
    score = (scorer or tx.simple_overlap)(F.col("query"), F.col("content")).cast("double")
    joined = hits.withColumnRenamed("rank", "old_rank").join(queries.select("query_id", "query"), "query_id")
    rescored = joined.withColumn("final_score", score).drop("query")
    return rank_rows(rescored, "final_score", "rank", top_k, "old_rank").drop("old_rank")


# --- content search ----------------------------------------------------------
def search_content(requests: DataFrame, chunks: DataFrame, documents: DataFrame, limit: int | None = 20) -> DataFrame:
    """Case-insensitive LIKE over the chunks of the asking owner, with a snippet; ``limit`` hits a request (None: all).

    Chunks are found per owner and needle (``substring.matches``) and cut to the limit there; only hits meet the requests.
    """
    owners = documents.select(F.col("id").alias("document_id"), "owner_id", "original_name")
    asked = requests.select("owner_id", F.lower("needle").alias("key"), "needle", "request_id")
    theirs = chunks.join(owners.join(asked.select("owner_id").distinct(), "owner_id", "left_semi"), "document_id")
    found = matches(requests.select("owner_id", "needle"), theirs.select("owner_id", "chunk_id", F.col("content").alias("text")), "owner_id", "chunk_id", wildcards=True)
    placed = found.join(theirs.drop("owner_id"), "chunk_id")
    order = Window.partitionBy("owner_id", "needle").orderBy("document_id", "chunk_index")
    best = placed.withColumn("position", F.row_number().over(order).cast("long"))
    if limit is not None:
        best = best.filter(F.col("position") <= limit)
    return best.withColumnRenamed("needle", "key").join(asked, ["owner_id", "key"]).select(
        "request_id", "position", "document_id", F.col("original_name").alias("filename"), "page_number", "chunk_id",
        tx.snippet(F.col("content"), F.col("needle")).alias("snippet"))


def highlight(requests: DataFrame, vectors: DataFrame, documents: DataFrame, top_k: int = 10) -> DataFrame:
    """Best sentence of each of the ten best chunks of one document, optionally on one page.

    With ``owner_id`` in ``requests`` a document of somebody else gives nothing.
    """
    if "owner_id" in requests.columns:
        requests = requests.join(documents.select(F.col("id").alias("document_id"), "owner_id"), ["document_id", "owner_id"], "left_semi").drop("owner_id")
    asked = requests.withColumn("document_ids", F.array("document_id"))
    hits = hybrid_search(asked, vectors, top_k, one_document=True)
    joined = hits.join(requests.select("query_id", "query", F.col("page_number").alias("only_page")), "query_id").filter(
        F.col("only_page").isNull() | (F.col("only_page") == 0) | (F.col("only_page") == F.col("page_number"))
    )
    parts = F.split("content", r"\.")
    scored = F.transform(parts, lambda s, i: F.struct(
        (-F.size(F.array_intersect(tx.word_set(F.col("query")), tx.word_set(s)))).alias("o"), i.alias("i"), tx.strip(s).alias("s")))
    best = tx.let(F.array_min(scored), lambda b: F.when((b["o"] < 0) & (b["s"] != ""), b["s"]).otherwise(
        F.substring(F.col("content"), 1, 200)))
    names = documents.select(F.col("id").alias("document_id"), F.col("original_name").alias("file"))
    return joined.join(names, "document_id").select(
        "query_id", "document_id", "file", F.col("page_number").alias("page"), "chunk_index",
        F.substring("content", 1, 500).alias("content"), best.alias("highlight_text"), F.col("final_score").alias("score"), "source_type",
    )


def related_queries(requests: DataFrame, n_words: int = 8) -> DataFrame:
    """Question widened by up to eight words of the answer, in alphabetical order."""
    extra = F.slice(F.sort_array(F.filter(
        tx.word_set(F.coalesce("answer_text", F.lit(""))),
        lambda w: ~F.array_contains(tx.string_array(fv.RELATED_STOP), w) & (F.length(w) > 3))), 1, n_words)
    widened = F.when(F.size(extra) > 0, F.concat(F.col("query"), F.lit(" "), F.array_join(extra, " "))).otherwise(F.col("query"))
    return requests.withColumn("query", widened)


def related_content(requests: DataFrame, vectors: DataFrame, documents: DataFrame, top_k: int = fv.TOP_K,
                    embedder: Callable[[Column], Column] | None = None, blocks: str | None = None) -> DataFrame:
    """Further hits that neither contain the given answer nor are contained in it."""
    widened = embed_texts(related_queries(requests).drop("embedding"), "query", embedder)
    hits = hybrid_search(widened, vectors, top_k + 5, documents=documents, blocks=blocks).join(requests.select("query_id", "answer_text"), "query_id")
    answer, content = F.lower(F.coalesce("answer_text", F.lit(""))), F.lower("content")
    fresh = hits.filter((answer == "") | ~(F.contains(answer, content) | F.contains(content, answer)))
    kept = rank_rows(fresh.withColumnRenamed("rank", "hit_rank"), "final_score", "rank", top_k, "hit_rank")
    preview = tx.let(tx.split_sentences(F.col("content")), lambda s: F.when(
        F.size(s) > 0, F.array_join(F.slice(s, 1, 3), " ")).otherwise(F.substring(F.col("content"), 1, 300)))
    names = documents.select(F.col("id").alias("document_id"), "original_name")
    return kept.join(names, "document_id", "left").select(
        "query_id", F.col("rank").cast("long").alias("rank"), preview.alias("content"), F.col("page_number").alias("page"),
        F.coalesce("original_name", F.concat(F.lit("Document "), F.col("document_id").cast("string"))).alias("file"),
        F.col("final_score").alias("score"), "source_type",
    )
