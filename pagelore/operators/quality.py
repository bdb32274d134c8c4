"""Answer-quality measures: overlap, length, groundedness, BLEU and ROUGE.

Clipped n-gram counts come from two aggregations over exploded n-grams (the first is
combined before its shuffle), so long texts need no quadratic matching in a row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.functions import text as tx


def rouge_tokens(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams of a row, joined by a blank; empty when the row is shorter than n."""
    if n == 1:
        return tokens
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1)))
    grams = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def clipped_counts(pairs: DataFrame, tokenizer, n: int) -> DataFrame:
    """(answer_id, matched, n_hyp, n_ref) for n-grams of answer and reference."""
    tokens = pairs.select("answer_id", tokenizer(F.col("answer")).alias("h"), tokenizer(F.col("reference")).alias("r"))
    sides = tokens.select("answer_id", F.explode(F.array(
        F.struct(F.lit(1).alias("is_h"), ngrams(F.col("h"), n).alias("g")), F.struct(F.lit(0).alias("is_h"), ngrams(F.col("r"), n).alias("g")))).alias("s"))
    grams = sides.select("answer_id", "s.is_h", F.explode("s.g").alias("gram"))
    per_gram = grams.groupBy("answer_id", "gram").agg(F.sum("is_h").alias("nh"), F.count_if(F.col("is_h") == 0).alias("nr"))
    return per_gram.groupBy("answer_id").agg(
        F.sum(F.least("nh", "nr")).alias("matched"), F.sum("nh").alias("n_hyp"), F.sum("nr").alias("n_ref"))


def bleu2(pairs: DataFrame) -> DataFrame:
    """Uni- and bigram BLEU with epsilon smoothing and brevity penalty, four decimals."""
    one = clipped_counts(pairs, tx.lower_words, 1)
    two = clipped_counts(pairs, tx.lower_words, 2).select("answer_id", F.col("matched").alias("m2"), F.col("n_hyp").alias("h2"))
    j = pairs.select("answer_id").join(one, "answer_id", "left").join(two, "answer_id", "left")
    m1, h1, r1 = (F.coalesce(c, F.lit(0)).cast("double") for c in ("matched", "n_hyp", "n_ref"))
    m2, h2 = F.coalesce("m2", F.lit(0)).cast("double"), F.greatest(F.coalesce("h2", F.lit(0)), F.lit(1)).cast("double")
    p1, p2 = m1 / F.greatest(h1, F.lit(1.0)), F.when(m2 == 0, 0.1).otherwise(m2) / h2
    penalty = F.when(h1 >= r1, F.lit(1.0)).otherwise(F.exp(1 - F.try_divide(r1, h1)))
    score = penalty * F.exp(0.5 * F.ln(p1) + 0.5 * F.ln(p2))
    return j.select("answer_id", F.when((h1 == 0) | (r1 == 0) | (m1 == 0), F.lit(0.0)).otherwise(F.round(score, 4)).alias("bleu"))


def _f_measure(matched: Column, n_hyp: Column, n_ref: Column) -> Column:
    p, r = matched / F.greatest(n_hyp, F.lit(1)), matched / F.greatest(n_ref, F.lit(1))
    return F.coalesce(F.round(F.try_divide(2 * p * r, p + r), 4), F.lit(0.0))


def rouge_n(pairs: DataFrame, n: int) -> DataFrame:
    c = clipped_counts(pairs, rouge_tokens, n)
    j = pairs.select("answer_id").join(c, "answer_id", "left")
    m, h, r = (F.coalesce(x, F.lit(0)).cast("double") for x in ("matched", "n_hyp", "n_ref"))
    return j.select("answer_id", _f_measure(m, h, r).alias(f"rouge{n}"))


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence of two token arrays, bit-parallel over whole rows."""

    @F.pandas_udf("long")
    def lcs(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right):
            at: dict[str, int] = {}
            for i, token in enumerate(x):
                at[token] = at.get(token, 0) | (1 << i)
            full = (1 << len(x)) - 1
            row = full
            for token in y:
                hit = row & at.get(token, 0)
                row = ((row + hit) | (row - hit)) & full
            out.append(len(x) - bin(row).count("1"))
        return pd.Series(out)

    return lcs(a, b)


def rouge_l(pairs: DataFrame) -> DataFrame:
    t = pairs.select("answer_id", rouge_tokens(F.col("answer")).alias("h"), rouge_tokens(F.col("reference")).alias("r"))
    s = t.withColumn("m", lcs_length(F.col("h"), F.col("r")))
    return s.select("answer_id", _f_measure(F.col("m").cast("double"), F.size("h"), F.size("r")).alias("rougeL"))


def overlap_measures(pairs: DataFrame) -> DataFrame:
    """Source overlap, query relevance, length ratio and groundedness; one pass per row."""
    answer, sources = F.col("a"), F.col("s")
    sets = pairs.select("answer_id", tx.word_set(F.col("query")).alias("q"), tx.word_set(F.col("answer")).alias("a"),
                        tx.word_set(F.col("sources")).alias("s"), F.length("answer").alias("la"), F.length("sources").alias("ls"))
    return sets.select(
        "answer_id", tx.set_overlap(answer, sources).alias("source_overlap"), tx.set_overlap(F.col("q"), answer).alias("query_relevance"),
        F.coalesce(F.round(F.try_divide(F.col("la"), F.col("ls")), 4), F.lit(0.0)).alias("length_ratio"),
        F.coalesce(F.round(F.try_divide(F.size(F.array_intersect(answer, sources)), F.size(answer)), 4), F.lit(0.0)).alias("groundedness"))


def overlap_fallback(pairs: DataFrame) -> DataFrame:
    """Measures without n-gram libraries: plain overlap for BLEU, ROUGE-1 and ROUGE-L."""
    o = tx.simple_overlap(F.col("reference"), F.col("answer"))
    return pairs.select("answer_id", o.alias("o")).select(
        "answer_id", F.col("o").alias("bleu"), F.col("o").alias("rouge1"), F.lit(0.0).alias("rouge2"), F.col("o").alias("rougeL"))


def evaluate_answers(pairs: DataFrame) -> DataFrame:
    """All measures, one row per answer; n-gram measures only where a reference is given."""
    referenced = pairs.filter(F.coalesce("reference", F.lit("")) != "")
    out = overlap_measures(pairs)
    for part in (bleu2(referenced), rouge_n(referenced, 1), rouge_n(referenced, 2), rouge_l(referenced)):
        out = out.join(part, "answer_id", "left")
    return out
