"""Check statements for text functions, quality measures and study material."""

from __future__ import annotations

from collections.abc import Callable

from pagelore.functions import fixed_values as fv
from pagelore.oracles import duck as dk
from pagelore.oracles.base import C

NL = "chr(10)"


def over_text(expr: str, name: str) -> str:
    return f"SELECT doc_id, {expr} AS {name} FROM documents"


# --- n-gram measures ---------------------------------------------------------------
def rouge_tokens(c: str) -> str:
    x = dk.sub(f"lower({c})", "[^a-z0-9]+", " ")
    return dk.tfilter(f"string_split({x}, ' ')", lambda w: f"{w} <> ''")


def grams(tokens: str, n: int) -> str:
    if n == 1:
        return tokens
    return dk.let(tokens, lambda t: f"list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])")


def add_clipped(name: str, tokenizer: Callable[[str], str], n: int) -> None:
    C.add(name, f"""
SELECT answer_id, sum(least(nh, nr))::BIGINT AS m, sum(nh)::BIGINT AS h, sum(nr)::BIGINT AS r FROM (
  SELECT answer_id, g, sum(x) AS nh, sum(1 - x) AS nr FROM (
    SELECT answer_id, 1 AS x, unnest({grams(tokenizer('answer'), n)}) AS g FROM evals_v
    UNION ALL SELECT answer_id, 0, unnest({grams(tokenizer('reference'), n)}) FROM evals_v) GROUP BY 1, 2) GROUP BY 1""", "evals_v")


add_clipped("bleu_one", dk.lower_words, 1)
add_clipped("bleu_two", dk.lower_words, 2)
add_clipped("rouge_one", rouge_tokens, 1)
add_clipped("rouge_two", rouge_tokens, 2)
C.add("bleu_v", """
SELECT e.answer_id, CASE WHEN coalesce(a.h, 0) = 0 OR coalesce(a.r, 0) = 0 OR a.m = 0 THEN 0.0::DOUBLE ELSE
  round(CASE WHEN a.h >= a.r THEN 1.0::DOUBLE ELSE exp(1 - a.r / a.h) END * exp(0.5::DOUBLE * ln(a.m / a.h) + 0.5::DOUBLE * ln(
    (CASE WHEN coalesce(b.m, 0) = 0 THEN 0.1::DOUBLE ELSE b.m END) / greatest(coalesce(b.h, 0), 1))), 4) END AS bleu
FROM evals_v e LEFT JOIN bleu_one a USING (answer_id) LEFT JOIN bleu_two b USING (answer_id)""", "evals_v", "bleu_one", "bleu_two")


def f_measure(t: str) -> str:
    p, r = f"(coalesce({t}.m, 0) / greatest(coalesce({t}.h, 0), 1))", f"(coalesce({t}.m, 0) / greatest(coalesce({t}.r, 0), 1))"
    return f"coalesce(round(2 * {p} * {r} / nullif({p} + {r}, 0), 4), 0.0)"


C.add("rouge_v", f"""
SELECT e.answer_id, {f_measure('a')} AS rouge1, {f_measure('b')} AS rouge2
FROM evals_v e LEFT JOIN rouge_one a USING (answer_id) LEFT JOIN rouge_two b USING (answer_id)""", "evals_v", "rouge_one", "rouge_two")

# longest common subsequence: one recursion step per answer token carries the row of lengths
C.add("lcs_in", f"SELECT answer_id, {rouge_tokens('answer')} AS h, {rouge_tokens('reference')} AS r FROM evals_v", "evals_v")
C.add("lcs_v", """! AS (
SELECT answer_id, h, r, 0::BIGINT AS i, list_transform(range(0, len(r) + 1), lambda x: 0::BIGINT) AS d FROM lcs_in
UNION ALL
SELECT answer_id, h, r, i + 1, list_prepend(0::BIGINT, list_transform(range(1, len(r) + 1), lambda j:
         list_max(list_transform(range(1, j + 1), lambda k: greatest(d[k + 1], CASE WHEN r[k] = h[i + 1] THEN d[k] + 1 ELSE 0 END)))))
FROM lcs_v WHERE i < len(h))""", "lcs_in")
C.add("rouge_l_v", f"""
SELECT answer_id, {f_measure('x')} AS "rougeL" FROM (SELECT answer_id, d[len(r) + 1] AS m, len(h) AS h, len(r) AS r FROM lcs_v WHERE i = len(h)) x""", "lcs_v")

_a, _s, _q = dk.word_set("answer"), dk.word_set("sources"), dk.word_set("query")
C.add("overlap_v", f"""
SELECT answer_id, {dk.set_overlap('a', 's')} AS source_overlap, {dk.set_overlap('q', 'a')} AS query_relevance,
       coalesce(round(length(answer) / nullif(length(sources), 0), 4), 0.0) AS length_ratio,
       coalesce(round({dk.overlap_size('a', 's')} / nullif(len(a), 0), 4), 0.0) AS groundedness
FROM (SELECT *, {_a} AS a, {_s} AS s, {_q} AS q FROM evals_v)""", "evals_v")


# --- study material -----------------------------------------------------------------
def squeeze(c: str) -> str:
    return dk.strip(dk.sub(c, " {2,}", " "))


def kept(rel: str, key: str, text: str, metadata: tuple[str, ...], chars: int) -> str:
    """(key, pos, s) of the sentences that stay."""
    pattern = dk.q("(?i)(?:" + "|".join(metadata) + ")")
    return f"""
SELECT {key}, pos, s FROM (SELECT {key}, unnest(ss) AS s, generate_subscripts(ss, 1) AS pos FROM (SELECT {key}, {dk.loose_sentences(text)} AS ss FROM {rel}))
WHERE len({dk.words('s')}) >= 8 AND NOT {dk.mostly_capitals('s')} AND NOT regexp_matches(s, {pattern})
QUALIFY row_number() OVER (PARTITION BY {key}, lower(substring(s, 1, {chars})) ORDER BY pos) = 1"""


C.add("repaired_v", f"SELECT document_id, chunk_index, {dk.clean_ocr_text('content')} AS c FROM chunks_v", "chunks_v")
C.add("faq_join", f"""
SELECT document_id, {dk.strip_material_noise("coalesce(string_agg(c, ' ' ORDER BY chunk_index) FILTER (" + dk.is_quality_text('c', 6) + "), '')")} AS t
FROM repaired_v WHERE chunk_index < 20 GROUP BY 1""", "repaired_v")
C.add("faq_kept", kept("faq_join", "document_id", "t", fv.FAQ_METADATA, 40), "faq_join")
C.add("faq_text", f"""
SELECT j.document_id, coalesce(substring({squeeze('k.t')}, 1, 6000), '') AS text FROM faq_join j LEFT JOIN (
  SELECT document_id, string_agg(s, ' ' ORDER BY pos) AS t FROM faq_kept GROUP BY 1) k USING (document_id)""", "faq_join", "faq_kept")
C.add("gen_in", f"SELECT document_id, {squeeze(dk.strip_material_noise('text'))} AS t FROM faq_text WHERE len({dk.words('text')}) >= 20", "faq_text")
C.add("gen_kept", kept("gen_in", "document_id", "t", fv.FAQ_GENERATOR_METADATA, 50), "gen_in")
C.add("material_v", f"""
SELECT document_id, string_agg(s, {NL} ORDER BY pos) AS sentences, list(s ORDER BY pos) AS ss, substring(string_agg(s, ' ' ORDER BY pos), 1, 6000) AS cleaned
FROM gen_kept GROUP BY 1 HAVING length(substring(string_agg(s, ' ' ORDER BY pos), 1, 6000)) >= 80""", "gen_kept")
C.add("noise_in", f"SELECT chunk_id, {squeeze(dk.strip_material_noise('content'))} AS t FROM chunks_v", "chunks_v")
C.add("noise_kept", kept("noise_in", "chunk_id", "t", fv.FAQ_GENERATOR_METADATA, 50), "noise_in")


def first_match(patterns: tuple[str, ...]) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(s, {dk.q(p)}, 1), '')" for p in patterns) + ", NULL)" if patterns else "NULL::VARCHAR"


def fill(template: str, *values: str) -> str:
    pieces = template.split("{}")
    out = dk.q(pieces[0])
    for value, piece in zip(values, pieces[1:]):
        out += f" || {value} || {dk.q(piece)}"
    return f"({out})"


def short(x: str, low: int, high: int, chars: int) -> str:
    return f"len({dk.words(x)}) BETWEEN {low} AND {high} AND length({x}) > {chars}"


def faq_question(rule: tuple) -> str:
    number, _, patterns, fallback, template, _ = rule
    subject = dk.clean_subject(first_match(patterns))
    if fallback is not None:
        return fill(template, f"coalesce({subject}, {dk.key_terms('s', fallback)})")
    limits = {1: (1, 5, 2), 2: (0, 5, 2), 11: (0, 5, 3)}[number]
    return dk.let(subject, lambda t: f"CASE WHEN {short(t, *limits)} THEN {fill(template, t)} END")


def card_question(rule: tuple) -> str:
    number, _, patterns, fallback, template, _ = rule
    found = first_match(patterns)
    if number == 4:
        subject = dk.sub(dk.strip(found), r"\.+\z", "")
        pair = fill(template, dk.key_terms("substring(s, 1, 60)", 3, True), subject)
        return f"CASE WHEN {found} IS NOT NULL THEN {pair} ELSE 'Compare: ' || {dk.key_terms('s', fallback, True)} END"
    if number in (1, 2):
        limits = (2, 6, 3) if number == 1 else (0, 5, 3)
        return dk.let(dk.without_article(found), lambda t: f"CASE WHEN {short(t, *limits)} THEN {fill(template, t)} END")
    if number == 9:
        content = dk.tfilter(dk.words("s"), lambda w: f"NOT list_contains({dk.strlist(fv.STUDY_STOP)}, lower({w})) AND length({w}) > 2")
        other = dk.let(content, lambda ws: f"CASE WHEN len({ws}) >= 5 THEN 'Explain the concept: ' || array_to_string({ws}[1:4], ' ') END")
        named = dk.let(dk.strip(found), lambda t: f"CASE WHEN {short(t, 0, 5, 3)} THEN {fill(template, t)} END")
        return f"CASE WHEN {found} IS NOT NULL THEN {named} ELSE {other} END"
    return fill(template, f"coalesce({dk.strip(found)}, {dk.key_terms('s', fallback, True)})")


def candidates(rel: str, rules: tuple, question: Callable[[tuple], str]) -> str:
    parts, seen = [], {}
    for rule in rules:
        gate = "true" if rule[1] is None else f"regexp_matches(s, {dk.q(rule[1])})"
        only = gate if rule[0] not in seen else f"{gate} AND NOT {seen[rule[0]]}"
        seen[rule[0]] = gate
        parts.append(f"SELECT document_id, {rule[0]} AS pass, i, {question(rule)} AS question, {rule[5]} AS win FROM {rel} WHERE {only}")
    return " UNION ALL ".join(parts)


C.add("faq_rows", "SELECT document_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS i FROM material_v", "material_v")
C.add("faq_cands", candidates("faq_rows", fv.FAQ_RULES, faq_question), "faq_rows")
C.add("faq_topics_v", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY pass, i) - 1 AS topic FROM (
  SELECT * FROM faq_cands WHERE length(question) >= 12 AND length(question) - length(replace(question, ' is ', '')) <= 4
  QUALIFY row_number() OVER (PARTITION BY document_id, substring(lower(question), 1, 60) ORDER BY pass, i) = 1)) WHERE topic < 10""", "faq_cands")
def runs(c: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({c}), {dk.q(fv.W + '+')}))"



_keys = dk.tfilter(runs("question"), lambda w: f"NOT list_contains({dk.strlist(fv.CONTEXT_STOP)}, {w}) AND length({w}) > 2")
_ctx = dk.tfilter(dk.loose_sentences("cleaned"), lambda s: f"length({s}) > 20")
C.add("faq_focus", f"""
SELECT document_id, topic, string_agg(s, ' ' ORDER BY i) AS focus FROM (
  SELECT document_id, topic, s, i, row_number() OVER (PARTITION BY document_id, topic ORDER BY {dk.overlap_size('keys', runs('s'))}
         + CASE WHEN len(list_filter(keys, lambda w: contains(lower(s), w))) > 0 THEN 0.5 ELSE 0 END DESC, i) AS n FROM (
    SELECT t.document_id, t.topic, {_keys} AS keys, m.s, m.i FROM faq_topics_v t JOIN (
      SELECT document_id, unnest(c) AS s, generate_subscripts(c, 1) AS i FROM (SELECT document_id, {_ctx} AS c FROM material_v)) m USING (document_id)))
WHERE n <= 5 GROUP BY 1, 2""", "faq_topics_v", "material_v")
C.add("faq_near", """
SELECT t.document_id, t.topic, string_agg(r.s, ' ' ORDER BY r.i) AS near FROM faq_topics_v t JOIN faq_rows r
  ON r.document_id = t.document_id AND r.i BETWEEN t.i - 1 AND t.i + t.win GROUP BY 1, 2""", "faq_topics_v", "faq_rows")
C.add("faq_ctx", f"""
SELECT t.document_id, t.topic, t.question, coalesce(x.c, '') AS context FROM faq_topics_v t LEFT JOIN (
  SELECT document_id, topic, substring(string_agg(s, ' ' ORDER BY pos), 1, 1200) AS c FROM (
    SELECT document_id, topic, s, pos FROM (SELECT document_id, topic, unnest(p) AS s, generate_subscripts(p, 1) AS pos FROM (
      SELECT document_id, topic, {dk.loose_sentences("near || ' ' || coalesce(focus, '')")} AS p FROM faq_near LEFT JOIN faq_focus USING (document_id, topic)))
    WHERE length(s) > 20 QUALIFY row_number() OVER (PARTITION BY document_id, topic, lower(substring(s, 1, 40)) ORDER BY pos) = 1)
  GROUP BY 1, 2) x USING (document_id, topic)""", "faq_topics_v", "faq_near", "faq_focus")
_p = dk.tfilter(dk.loose_sentences("context"), lambda s: f"length({s}) > 25")
C.add("faq_answers_v", f"""
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY topic) - 1 AS position, question, answer FROM (
  SELECT document_id, topic, question, CASE WHEN len(p) >= 2 THEN array_to_string(p[1:3], ' ') WHEN len(p) = 1 THEN p[1] ELSE substring(context, 1, 300) END AS answer
  FROM (SELECT *, {_p} AS p FROM faq_ctx)) WHERE length(answer) > 20 QUALIFY position < 5""", "faq_ctx")
C.add("faq_pages", """
SELECT document_id, array_to_string(list_sort(list_distinct(list(page_number)))[1:5], ',') AS page_numbers
FROM chunks_v WHERE chunk_index < 20 AND page_number <> 0 GROUP BY 1""", "chunks_v")

C.add("card_flags", f"""
SELECT document_id, chunk_index, c, good, sum(good) OVER (PARTITION BY document_id) AS n_good, count(*) OVER (PARTITION BY document_id) AS n_all,
       sum(good) OVER (PARTITION BY document_id ORDER BY chunk_index) - good AS before
FROM (SELECT *, CASE WHEN {dk.is_quality_text('c')} THEN 1 ELSE 0 END AS good FROM repaired_v)""", "repaired_v")
C.add("card_material", f"""
SELECT document_id, {dk.strip("substring(string_agg(c, ' ' ORDER BY chunk_index), 1, 8000)")} AS material FROM card_flags
WHERE CASE WHEN n_good > 0 THEN good = 1 AND before % greatest(n_good // 12, 1) = 0 ELSE chunk_index % greatest(n_all // 12, 1) = 0 END
GROUP BY 1 HAVING length({dk.strip("substring(string_agg(c, ' ' ORDER BY chunk_index), 1, 8000)")}) >= 50""", "card_flags")
_long = dk.tfilter(dk.loose_sentences("material"), lambda s: f"length({s}) > 35")
C.add("card_rows", f"""
SELECT document_id, unnest(q) AS s, generate_subscripts(q, 1) - 1 AS i FROM (
  SELECT document_id, CASE WHEN len(g) > 0 THEN g ELSE a END AS q FROM (
    SELECT document_id, a, {dk.tfilter('a', lambda s: dk.is_quality_text(s, 6))} AS g FROM (SELECT document_id, {_long} AS a FROM card_material)))""", "card_material")
C.add("card_cands", candidates("card_rows", fv.CARD_RULES, card_question), "card_rows")
C.add("card_topics_v", """
SELECT t.document_id, t.topic, t.pass, t.i AS at_pos, t.question, t.win, string_agg(r.s, ' ' ORDER BY r.i) AS context FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY pass, i) - 1 AS rn,
         row_number() OVER (PARTITION BY document_id ORDER BY pass, i) - 1 AS topic FROM (
    SELECT * FROM card_cands WHERE length(question) >= 12
    QUALIFY row_number() OVER (PARTITION BY document_id, substring(trim(lower(question), '?. '), 1, 50) ORDER BY pass, i) = 1)) t
JOIN card_rows r ON r.document_id = t.document_id AND r.i BETWEEN t.i - 1 AND t.i + t.win
WHERE t.pass < 9 OR t.rn < 25 GROUP BY ALL HAVING length(context) > 30""", "card_cands", "card_rows")
_c = dk.tfilter(dk.loose_sentences("context"), lambda s: f"length({s}) > 20")

_third = f"coalesce(lower({dk.words('text')}[3]), 'x')"
SQL = {
    "clean_text": over_text(dk.clean_text("text"), "cleaned"),
    "remove_header_footer": over_text(dk.remove_header_footer("text"), "body"),
    "clean_chunk_for_display": over_text(dk.clean_chunk_for_display("text"), "shown"),
    "split_sentences": f"SELECT doc_id, pos, sentence FROM (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS pos FROM ("
                       f"SELECT doc_id, {dk.split_sentences('text')} AS ss FROM documents))",
    "truncate_text": over_text(dk.truncate_text("text", 500), "short"),
    "clean_ocr_text": over_text(dk.clean_ocr_text("text"), "repaired"),
    "is_quality_text": over_text(dk.is_quality_text("text"), "is_quality"),
    "clean_faq_text": C.sql("SELECT * FROM faq_text", "faq_text"),
    "faq_noise_clean": C.sql("SELECT chunk_id, substring(string_agg(s, ' ' ORDER BY pos), 1, 6000) AS cleaned FROM noise_kept GROUP BY 1 "
                             "HAVING length(substring(string_agg(s, ' ' ORDER BY pos), 1, 6000)) >= 80", "noise_kept"),
    "detect_language": over_text(dk.detect_language("text"), "language"),
    "language_agreement": f"SELECT lang, {dk.detect_language('text')} AS detected, count(*) AS n FROM documents GROUP BY 1, 2",
    "language_name": over_text(dk.language_name("lang"), "language"),
    "key_terms": over_text(dk.key_terms("text", 4), "terms"),
    "card_terms": over_text(dk.key_terms("text", 4, True), "terms"),
    "clean_subject": over_text(f"array_to_string({dk.tmap(dk.loose_sentences('text'), dk.clean_subject)}, ' | ')", "subjects"),
    "snippet": over_text(dk.let(_third, lambda n: dk.snippet("text", n)), "snippet"),
    "simple_overlap": C.sql(f"SELECT id, {dk.simple_overlap('query', 'answer')} AS overlap FROM bookmarks_v", "bookmarks_v"),
    "cache_key": C.sql("SELECT query_id, md5(query || CASE WHEN query_id % 4 <> 0 THEN '|[' || array_to_string(list_sort([query_id * 3 % 10, query_id % 10, query_id * 7 % 10]), ', ') || ']' "
                       "ELSE '' END) AS cache_key FROM queries_v", "queries_v"),
    **{m: C.sql(f"SELECT answer_id, {m} FROM overlap_v", "overlap_v") for m in ("source_overlap", "query_relevance", "length_ratio", "groundedness")},
    "bleu2": C.sql("SELECT * FROM bleu_v", "bleu_v"),
    "rouge_n": C.sql("SELECT * FROM rouge_v", "rouge_v"),
    "rouge_l": C.sql("SELECT * FROM rouge_l_v", "rouge_l_v"),
    "overlap_fallback": C.sql(f"SELECT answer_id, o AS bleu, o AS rouge1, 0.0::DOUBLE AS rouge2, o AS \"rougeL\" FROM ("
                              f"SELECT answer_id, {dk.simple_overlap('reference', 'answer')} AS o FROM evals_v)", "evals_v"),
    "evaluate_answers": C.sql("SELECT o.*, bleu, rouge1, rouge2, \"rougeL\" FROM overlap_v o JOIN bleu_v USING (answer_id) JOIN rouge_v USING (answer_id) JOIN rouge_l_v USING (answer_id)",
                              "overlap_v", "bleu_v", "rouge_v", "rouge_l_v"),
    "faq_candidates": C.sql("SELECT document_id, sentences, cleaned FROM material_v", "material_v"),
    "faq_topics": C.sql("SELECT document_id, topic, pass::BIGINT AS pass, i AS \"at\", question FROM faq_topics_v", "faq_topics_v"),
    "faq_context": C.sql("SELECT * FROM faq_ctx", "faq_ctx"),
    "faq_answers": C.sql("SELECT * FROM faq_answers_v", "faq_answers_v"),
    "faq_table": C.sql("SELECT a.document_id, original_name AS filename, position, question, answer, page_numbers, 0.7::DOUBLE AS confidence FROM faq_answers_v a "
                       "LEFT JOIN faq_pages USING (document_id) JOIN docs_v d ON d.id = a.document_id", "faq_answers_v", "faq_pages", "docs_v"),
    "flashcard_material": C.sql("SELECT * FROM card_material", "card_material"),
    "flashcard_topics": C.sql("SELECT document_id, topic, pass::BIGINT AS pass, at_pos AS \"at\", question, win::BIGINT AS \"window\", context FROM card_topics_v", "card_topics_v"),
    "flashcards": C.sql(f"""
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY topic) - 1 AS position, front, back FROM (
  SELECT document_id, topic, question AS front, array_to_string({_c}[1:3], ' ') AS back FROM card_topics_v)
WHERE length(back) > 30 AND length(front) > 10 QUALIFY position < 10""", "card_topics_v"),
}
