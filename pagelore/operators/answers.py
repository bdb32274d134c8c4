"""Extractive answers by role, confidence, sources, reasoning and follow-up questions.

``hits`` holds at most top-k ranked rows per query with the columns query_id, query,
role, rank, document_id, filename, page_number, source_type, content, final_score.
Sentence work stays inside the hit row; a query only brings its few hits together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.functions import fixed_values as fv
from pagelore.functions import text as tx
from pagelore.operators import retrieval as rt

QUERY = ["query_id", "query", "role"]


def attach(hits: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits with the question, its role and the file name (``Document n`` when unknown)."""
    names = documents.select(F.col("id").alias("document_id"), "original_name")
    named = hits.join(queries.select(*QUERY), "query_id").join(names, "document_id", "left")
    default = F.concat(F.lit("Document "), F.col("document_id").cast("string"))
    return named.withColumn("filename", F.coalesce("original_name", default)).drop("original_name")


def display_sentences(content: Column) -> Column:
    return tx.split_sentences(tx.clean_chunk_for_display(content))


def _shared(query: Column, sentence: Column) -> Column:
    return F.size(F.array_intersect(tx.word_set(query), tx.word_set(sentence)))


def sentence_scores(hits: DataFrame) -> DataFrame:
    s = hits.select("query_id", "rank", "query", F.posexplode(display_sentences(F.col("content"))).alias("pos", "sentence"))
    return s.select("query_id", "rank", "pos", "sentence", _shared(F.col("query"), F.col("sentence")).alias("overlap"))


def gather(hits: DataFrame) -> DataFrame:
    """The hits of a query (top-k at most) as one ordered array: one exchange serves every step."""
    item = F.struct("rank", "document_id", "filename", "page_number", "source_type", "content", "final_score")
    return hits.groupBy(*QUERY).agg(F.array_sort(F.collect_list(item)).alias("hits"))


def _hit(i: int) -> Column:
    return F.get("hits", F.lit(i))


def _by_overlap(query: Column, sentences: Column, n: int) -> Column:
    """The n sentences with the largest overlap, earlier ones first among equals."""
    scored = F.transform(sentences, lambda s, i: F.struct((-_shared(query, s)).alias("o"), i.alias("i"), s.alias("s")))
    return F.transform(F.slice(F.sort_array(scored), 1, n), lambda x: x["s"])


def _relevant(query: Column, content: Column, n: int = 2) -> Column:
    return F.slice(F.filter(display_sentences(content), lambda s: _shared(query, s) > 0), 1, n)


def student_text() -> Column:
    """Three closest sentences of the best hit."""
    query, content = F.col("query"), _hit(0)["content"]
    return tx.let(display_sentences(content), lambda s: F.when(
        F.size(s) > 0, F.array_join(_by_overlap(query, s, 3), " ")).otherwise(tx.truncate_text(content, 300)))


def teacher_text() -> Column:
    """Numbered key points, each with its page, from the first three hits."""
    def point(h: Column) -> Column:
        return tx.let(_relevant(F.col("query"), h["content"]), lambda r: F.when(F.size(r) > 0, F.concat(
            h["rank"].cast("string"), F.lit(". "), F.array_join(r, " "), F.lit(" (Page "),
            h["page_number"].cast("string"), F.lit(")"))))

    return tx.let(F.array_compact(F.transform(F.slice("hits", 1, 3), point)), lambda points: F.when(
        F.size(points) > 0, F.concat(F.lit(fv.MSG_TEACHER_HEAD + "\n"), F.array_join(points, "\n"))
    ).otherwise(tx.truncate_text(_hit(0)["content"], 500)))


def researcher_text() -> Column:
    """Sentences numbered through the first four hits, then the list of references by hit."""
    used = F.slice("hits", 1, 4)
    sentences = F.flatten(F.transform(used, lambda h: _relevant(F.col("query"), h["content"])))
    cited = F.transform(sentences, lambda s, i: F.concat(s, F.lit(" ["), (i + 1).cast("string"), F.lit("]")))
    body = tx.let(cited, lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(tx.truncate_text(_hit(0)["content"], 600))))
    references = F.transform(used, lambda h: F.concat(
        F.lit("["), h["rank"].cast("string"), F.lit("] "), h["filename"], F.lit(", Page "), h["page_number"].cast("string")))
    return F.array_join(F.concat(body, F.array(F.lit(fv.MSG_REFERENCES_HEAD)), references), "\n")


def role_text() -> Column:
    role = F.col("role")
    return F.when(role == "student", student_text()).when(role == "teacher", teacher_text()).otherwise(researcher_text())


def answer_student(hits: DataFrame) -> DataFrame:
    return gather(hits).select("query_id", student_text().alias("answer"))


def answer_teacher(hits: DataFrame) -> DataFrame:
    return gather(hits).select("query_id", teacher_text().alias("answer"))


def answer_researcher(hits: DataFrame) -> DataFrame:
    return gather(hits).select("query_id", researcher_text().alias("answer"))


def answer_by_role(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """One answer per query: student and teacher styles, every other role as researcher."""
    given = gather(hits).select("query_id", role_text().alias("answer"))
    return queries.select(*QUERY).join(given, "query_id", "left").withColumn(
        "answer", F.coalesce("answer", F.lit(fv.MSG_NO_EXTRACT)))


# --- scores of a gathered query --------------------------------------------------
def _scores() -> Column:
    return F.transform("hits", lambda h: h["final_score"])


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def max_score() -> Column:
    return F.array_max(_scores())


def mean_score() -> Column:
    """Mean to four decimals, half up; scores hold four decimals, so whole units are added."""
    units = _total(F.transform(_scores(), lambda x: F.round(x * 10000, 0)))
    return F.floor(F.try_divide(units, F.size("hits")) + 0.5) / 10000


def confidence_score() -> Column:
    """Mean of the scores over the best one, weighted by one over the rank."""
    shares = _total(F.transform("hits", lambda h: h["final_score"] / h["rank"]))
    weights = _total(F.transform("hits", lambda h: F.lit(1.0) / h["rank"]))
    top = F.when(max_score() > 0, max_score()).otherwise(F.lit(1.0))
    return F.round(F.least(F.try_divide(shares / top, weights), F.lit(1.0)), 4)


def _distinct(field: str) -> Column:
    return F.size(F.array_distinct(F.transform("hits", lambda h: h[field])))


def _four(c: Column) -> Column:
    return F.format_string("%.4f", F.round(c, 4))


def weak_reason_text() -> Column:
    return F.concat(
        F.lit("All "), F.size("hits").cast("string"), F.lit(" retrieved segments had very low relevance (max score: "),
        _four(max_score()), F.lit(", avg: "), _four(mean_score()),
        F.lit("). The question likely falls outside the scope of uploaded documents."))


def reason_text() -> Column:
    return F.concat(
        F.lit("Answer derived from "), F.size("hits").cast("string"), F.lit(" document segments across "),
        _distinct("document_id").cast("string"), F.lit(" document(s). Top score: "), _four(max_score()),
        F.lit(", Average score: "), _four(mean_score()), F.lit("."))


def confidence(hits: DataFrame) -> DataFrame:
    return gather(hits).select("query_id", confidence_score().alias("confidence"))


def out_of_scope(hits: DataFrame, threshold: float = fv.LOW_RELEVANCE) -> DataFrame:
    weak = max_score() < threshold
    return gather(hits).select(
        "query_id", weak.alias("out_of_scope"), max_score().alias("confidence"),
        F.when(weak, F.lit(fv.MSG_LOW_RELEVANCE)).alias("answer"), F.when(weak, weak_reason_text()).alias("reasoning"))


def reasoning(hits: DataFrame) -> DataFrame:
    return gather(hits).select("query_id", reason_text().alias("reasoning"))


# --- sources and follow-up questions ---------------------------------------------
def source_rows(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id", F.col("rank").cast("long").alias("rank"), F.col("filename").alias("file"),
        F.col("page_number").alias("page"), F.col("final_score").alias("score"), "source_type",
        tx.truncate_text(F.col("content"), 150).alias("content_preview"))


def source_array() -> Column:
    return F.transform("hits", lambda h: F.struct(
        h["filename"].alias("file"), h["page_number"].alias("page"), h["final_score"].alias("score"),
        h["source_type"].alias("source_type"), tx.truncate_text(h["content"], 150).alias("content_preview")))


def sources(hits: DataFrame) -> DataFrame:
    """Ordered array of source structs per query (at most top-k items)."""
    return gather(hits).select("query_id", source_array().alias("sources"))


def _question(s: Column) -> Column:
    def about(word: str) -> Column:
        return F.concat(F.lit("What "), F.lower(tx.strip(F.substring_index(s, word, 1))), F.lit("?"))

    low = F.lower(s)
    return F.when(low.contains("is"), about("is")).when(low.contains("are"), about("are")).otherwise(
        F.concat(F.lit("Can you explain: "), tx.truncate_text(s, 80), F.lit("?")))


def question_array(limit: int = 5) -> Column:
    """Questions made from marked sentences among the first ten of the three best hits."""
    text = F.array_join(F.transform(F.slice("hits", 1, 3), lambda h: h["content"]), " ")
    marked = F.filter(
        F.slice(tx.split_sentences(text), 1, 10),
        lambda s: F.lower(s).rlike("|".join(fv.QUESTION_MARKERS)) & (F.length(s) > 20) & (F.length(s) < 200))
    return F.slice(F.transform(marked, _question), 1, limit)


def suggest_questions(hits: DataFrame, limit: int = 5) -> DataFrame:
    return gather(hits).select("query_id", question_array(limit).alias("suggested_questions"))


def compose_answers(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Everything a question gets back, one row per query, from one pass over its hits."""
    joined = queries.select(*QUERY).join(gather(hits).drop("query", "role"), "query_id", "left")
    none, weak = F.col("hits").isNull(), max_score() < fv.LOW_RELEVANCE
    return joined.select(
        "query_id", "query", "role",
        F.when(none, F.lit(fv.MSG_NO_HITS)).when(weak, F.lit(fv.MSG_LOW_RELEVANCE)).otherwise(role_text()).alias("answer"),
        F.when(none, F.lit(0.0)).when(weak, max_score()).otherwise(confidence_score()).alias("confidence"),
        F.when(none, F.lit(fv.MSG_NO_HITS_REASON)).when(weak, weak_reason_text()).otherwise(reason_text()).alias("reasoning"),
        F.when(none | weak, F.slice(source_array(), 1, 0)).otherwise(source_array()).alias("sources"),
        question_array().alias("suggested_questions"),
    )


def rag_query(queries: DataFrame, vectors: DataFrame, documents: DataFrame, top_k: int = fv.TOP_K, enable_rerank: bool = False,
              blocks: str | None = None, one_document: bool = False) -> DataFrame:
    """Search, optional re-ranking and answers for a batch of questions."""
    hits = rt.hybrid_search(queries, vectors, top_k, documents=documents, blocks=blocks, one_document=one_document)
    if enable_rerank:
        hits = rt.rerank(queries, hits, top_k)
    return compose_answers(queries, attach(hits, queries, documents))


def compare_documents_answers(requests: DataFrame, vectors: DataFrame, documents: DataFrame) -> DataFrame:
    """The same question answered from each requested document on its own (two at least)."""
    asked = requests.filter(F.size(F.array_distinct("document_ids")) >= 2).select(
        "query_id", "query", "role", "embedding", F.explode(F.array_distinct("document_ids")).alias("document_id"))
    pair = F.concat_ws(":", F.col("query_id").cast("string"), F.col("document_id").cast("string"))
    keyed = asked.select(pair.alias("query_id"), "query", "role", "embedding", F.array("document_id").alias("document_ids"))
    names = documents.select(F.col("id").alias("document_id"), "original_name")
    parts = F.split("query_id", ":")
    answers = rag_query(keyed, vectors, documents, one_document=True).select(
        F.get(parts, F.lit(0)).cast("long").alias("query_id"), F.get(parts, F.lit(1)).cast("long").alias("document_id"),
        "query", "answer", "confidence", "sources")
    default = F.concat(F.lit("Document "), F.col("document_id").cast("string"))
    return answers.join(names, "document_id", "left").withColumn("filename", F.coalesce("original_name", default)).drop("original_name")


# --- answers without ranking hits ----------------------------------------------
def _distinct_lower_runs(c: Column) -> Column:
    return F.array_distinct(tx.word_runs(F.lower(c)))


def query_keywords(query: Column) -> Column:
    return F.filter(_distinct_lower_runs(query), lambda w: ~F.array_contains(tx.string_array(fv.CONTEXT_STOP), w) & (F.length(w) > 2))


def read_sentences(context: Column) -> Column:
    """The sentences of a text that may answer, with what questions are held against: the small letters and their words."""
    kept = F.filter(tx.loose_sentences(context), lambda s: F.length(s) > 20)
    return F.transform(F.transform(kept, lambda s: F.struct(s.alias("s"), F.lower(s).alias("low"))), lambda x: F.struct(
        x["s"].alias("s"), x["low"].alias("low"), F.array_distinct(tx.word_runs(x["low"])).alias("runs")))


def focus_context(query: Column, context: Column, top_n: int = 8, read: Column | None = None) -> Column:
    """The sentences closest to the question, back in text order.  ``read``: those of the context, where many ask for them."""
    def score(keys: Column, x: Column) -> Column:
        shared = F.size(F.array_intersect(keys, x["runs"]))
        near = F.exists(keys, lambda w: F.contains(x["low"], w))
        return -(shared + F.when(near, F.lit(0.5)).otherwise(F.lit(0.0)))

    def pick(sentences: Column, keys: Column) -> Column:
        scored = F.transform(sentences, lambda x, i: F.struct(score(keys, x).alias("o"), i.alias("i"), x["s"].alias("s")))
        best = F.transform(F.slice(F.sort_array(scored), 1, top_n), lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))
        return F.array_join(F.transform(F.sort_array(best), lambda x: x["s"]), " ")

    return tx.let(read_sentences(context) if read is None else read, lambda ss: F.when(F.size(ss) == 0, F.substring(context, 1, 1024)).otherwise(
        tx.let(query_keywords(query), lambda keys: pick(ss, keys))))


def extractive_context(requests: DataFrame, top_n: int = 8) -> DataFrame:
    return requests.select("query_id", focus_context(F.col("query"), F.col("context"), top_n).alias("context"))


def direct_text(query: Column, context: Column) -> Column:
    return tx.let(tx.strip(focus_context(query, context, 4)), lambda t: F.when(
        (F.length(tx.strip(context)) > 50) & (F.length(t) > 30),
        F.concat(F.lit(fv.MSG_FALLBACK_HEAD), t, F.lit(fv.MSG_FALLBACK_TAIL))).otherwise(F.lit(fv.MSG_FALLBACK_NONE)))


def extractive_fallback_answer(requests: DataFrame) -> DataFrame:
    return requests.select("query_id", direct_text(F.col("query"), F.coalesce("context", F.lit(""))).alias("answer"))


def answer_mode(answers: DataFrame, modes: DataFrame) -> DataFrame:
    """The answer by mode (``pdf``, ``ai``, ``both``) from composed answers.

    ``pdf`` and ``both`` keep the grounded answer, its confidence, sources and reasoning.  ``ai`` searches nothing:
    its direct answer has no context, no sources and confidence 0.  ``both`` adds a direct answer over the
    previews of the grounded answer's sources, which are none where nothing relevant was found.
    """
    mode = F.col("answer_mode")
    previews = F.array_join(F.transform("sources", lambda x: x["content_preview"]), " ")
    rows = answers.join(modes, "query_id").withColumn("context", F.when(mode == "both", previews).otherwise(F.lit("")))
    ai = mode == "ai"
    direct = direct_text(F.col("query"), F.col("context"))
    return rows.select(
        "query_id", "answer_mode", F.when(ai, direct).otherwise(F.col("answer")).alias("answer"),
        F.when(mode != "pdf", direct).alias("direct_ai_answer"),
        F.when(ai, F.lit(0.0)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(ai, F.slice("sources", 1, 0)).otherwise(F.col("sources")).alias("sources"),
        F.when(ai, F.lit(fv.MSG_AI_REASON)).otherwise(F.col("reasoning")).alias("reasoning"))


def confidence_level(c: Column) -> Column:
    return F.when(c > 0.7, "high").when(c > 0.4, "medium").otherwise("low")


def explain_confidence(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Why an answer got its score: source count, best score, distinct files, level and advice."""
    found = gather(hits).select(
        "query_id", F.size("hits").alias("n"), max_score().alias("top"), _distinct("filename").alias("files"),
        confidence_score().alias("score"))
    j = queries.select("query_id").join(found, "query_id", "left")
    n, top = F.coalesce("n", F.lit(0)), F.col("top")

    def factor(name: str, impact: str, detail: Column) -> Column:
        return F.struct(F.lit(name).alias("factor"), F.lit(impact).alias("impact"), detail.alias("detail"))

    percent = F.concat(F.lit("Best match: "), F.round(top * 100, 0).cast("bigint").cast("string"), F.lit("%"))
    count = F.when(n >= 3, factor("Multiple sources found", "positive", F.concat(n.cast("string"), F.lit(" relevant sources identified")))).when(
        n == 0, factor("No sources found", "negative", F.lit("No matching content in documents"))).otherwise(
        factor("Limited sources", "neutral", F.concat(F.lit("Only "), n.cast("string"), F.lit(" source(s) found"))))
    quality = F.when(top > 0.8, factor("High relevance match", "positive", percent)).when(
        top > 0.5, factor("Moderate relevance", "neutral", percent)).when(
        n > 0, factor("Low relevance scores", "negative", percent))
    spread = F.when(F.col("files") > 1, factor(
        "Cross-document validation", "positive", F.concat(F.lit("Found in "), F.col("files").cast("string"), F.lit(" different documents"))))
    level = confidence_level(F.coalesce("score", F.lit(0.0)))
    advice = F.when(level == "high", F.lit(fv.MSG_HIGH)).when(level == "medium", F.lit(fv.MSG_MEDIUM)).otherwise(F.lit(fv.MSG_LOW))
    return j.select("query_id", F.coalesce("score", F.lit(0.0)).alias("score"), level.alias("level"),
                    F.array_compact(F.array(count, quality, spread)).alias("factors"), advice.alias("recommendation"))


def fact_check_heuristic(answers: DataFrame, limit: int = 5) -> DataFrame:
    claims = F.slice(F.filter(tx.split_sentences(F.col("answer")), lambda s: F.length(s) > 20), 1, limit)
    return answers.select("answer_id", claims.alias("claims"), F.lit("medium").alias("confidence_rating"),
                          F.lit("unknown").alias("consistency"))
