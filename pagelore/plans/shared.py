"""Intermediate relations that several catalog queries read.

Within one session they are stored once per data folder below the checkpoint folder, as a user would store
a chunk table that many questions are asked against; readers prune columns and join by the stored sizes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.operators import answers as an
from pagelore.operators import bm25
from pagelore.operators import retrieval as rt
from pagelore.operators import vectors as vc
from pagelore.plans import fixtures as fx
from pagelore.plans import pages_plan
from pagelore.session import ensure_checkpoint_dir

_stored: dict[tuple, str] = {}


def place(spark: SparkSession, d: str, name: str, write: Callable[[str], None]) -> str:
    """Where ``write`` stored a relation of a data folder in this session."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _stored:
        path = f"{ensure_checkpoint_dir(spark)}/pagelore-{name}-{uuid.uuid4().hex}"
        write(path)
        _stored[key] = path
    return _stored[key]


def keep(spark: SparkSession, d: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    return spark.read.parquet(place(spark, d, name, lambda path: build().write.parquet(path)))


def release() -> None:
    """Forget the stored relations and their catalog names (used between bench runs)."""
    spark = SparkSession.getActiveSession()
    for (_, _, name), path in _stored.items():
        if spark is not None and name == BUCKETED:
            spark.sql(f"DROP TABLE IF EXISTS {table_name(path)}")
    _stored.clear()


#: The relation that is a bucketed table; its catalog name comes from its folder.
BUCKETED = "chunk_vectors"


def table_name(path: str) -> str:
    return path.rsplit("/", 1)[1].replace("-", "_")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return keep(spark, d, "chunks", lambda: pages_plan.chunks(spark, d))


def chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with their vectors in buckets of the document: joins on ``document_id`` move no vector."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = place(spark, d, BUCKETED, lambda path: rt.embed_texts(chunks(spark, d), "content").repartition(n, "document_id").write.option(
        "path", path).bucketBy(n, "document_id").sortBy("document_id").saveAsTable(table_name(path)))
    return spark.table(table_name(path))


def vector_blocks(spark: SparkSession, d: str) -> str:
    return place(spark, d, "vector-blocks", lambda path: vc.write_blocks(chunk_vectors(spark, d), path))


def text_index(spark: SparkSession, d: str) -> str:
    return place(spark, d, "text-index", lambda path: bm25.write_index(chunks(spark, d), path))


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages as questions: four roles, three kinds of document scope."""
    role = F.element_at(F.array(*[F.lit(r) for r in ("student", "teacher", "researcher", "admin")]),
                        (F.col("query_id") % 4 + 1).cast("int"))
    many = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long")), lambda i: i * 2 + F.col("query_id") % 2)
    ids = F.when(F.col("query_id") % 3 == 1, F.array("query_id")).when(F.col("query_id") % 3 == 2, many)
    asked = fx.text_queries(spark, d).select("query_id", "query", role.alias("role"), ids.alias("document_ids"), (F.col("query_id") % 20).alias("owner_id"))
    return keep(spark, d, "questions", lambda: rt.embed_texts(asked, "query"))


def hits(spark: SparkSession, d: str) -> DataFrame:
    def build() -> DataFrame:
        q, docs = questions(spark, d), fx.documents(spark, d)
        return an.attach(rt.hybrid_search(q, chunk_vectors(spark, d), documents=docs, blocks=vector_blocks(spark, d)), q, docs)

    return keep(spark, d, "hits", build)
