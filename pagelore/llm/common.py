"""Small helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.operators.running import bit_table, marked
from pagelore.session import ensure_checkpoint_dir

__all__ = ["WORD", "bit_table", "cut", "marked", "n_words", "own", "replace", "table", "unused"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: rows go to the shared checkpoint folder, so a lost executor costs nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def own(df: DataFrame, *names: str) -> DataFrame:
    """The columns asked for; one that is missing is null.  Extra columns, whatever their names, stay out."""
    have = set(df.columns)
    return df.select(*[F.col(n) if n in have else F.lit(None).cast("string").alias(n) for n in names])


def replace(df: DataFrame, outputs: dict[str, Column]) -> DataFrame:
    """``df`` with the outputs appended; an input column of an output's name gives way to it."""
    return df.select(*[F.col(c) for c in df.columns if c not in outputs], *[c.alias(n) for n, c in outputs.items()])


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores ahead until no column of ``df`` is called so in any case of letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name
