"""DuckDB spellings of the text functions, used only to check results.

Each helper returns SQL text.  They are written against the same fixed values as
the Spark side but use DuckDB's list functions and RE2 patterns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import count

from pagelore.functions import fixed_values as fv

_names = count(1)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def let(value: str, body: Callable[[str], str]) -> str:
    v = f"v{next(_names)}"
    return f"list_transform([{value}], lambda {v}: {body(v)})[1]"


def tmap(items: str, body: Callable[[str], str]) -> str:
    v = f"v{next(_names)}"
    return f"list_transform({items}, lambda {v}: {body(v)})"


def tfilter(items: str, body: Callable[[str], str]) -> str:
    v = f"v{next(_names)}"
    return f"list_filter({items}, lambda {v}: {body(v)})"


def sub(text: str, pattern: str, repl: str, raw: bool = False) -> str:
    return f"regexp_replace({text}, {q(pattern)}, {repl if raw else q(repl)}, 'g')"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q(pattern)})"


def strip(c: str) -> str:
    return f"trim({c}, {q(fv.WS_CHARS)})"


def strlist(values: Iterable[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def words(c: str) -> str:
    return tfilter(f"regexp_split_to_array({c}, {q(fv.S + '+')})", lambda w: f"{w} <> ''")


def lower_words(c: str) -> str:
    return words(f"lower({c})")


def word_set(c: str) -> str:
    return f"list_distinct({lower_words(c)})"


def overlap_size(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def clean_text(c: str) -> str:
    x = f"coalesce({c}, '')"
    x = sub(x, fv.CONTROL_CHARS, "")
    x = f"translate({x}, '|`', 'I''')"
    x = sub(x, "[ \t]+", " ")
    x = sub(x, "\n{3,}", "\n\n")
    return strip(f"array_to_string({tmap(f'string_split({x}, chr(10))', strip)}, chr(10))")


def remove_header_footer(c: str) -> str:
    digits = r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉]+\z"

    def opening(a: str, i: int) -> str:
        return f"(length({strip(f'{a}[{i + 1}]')}) < 60 AND NOT {has(f'substring({a}[{i + 1}], 1, 5)', chr(92) + 'p{L}')})"

    def closing(a: str, i: int) -> str:
        x = strip(f"{a}[len({a}) - {i - 1}]")
        return f"(length({x}) < 60 AND {has(x, digits)})"

    def run(test: Callable[[int], str], first: int) -> str:
        return (f"(CASE WHEN NOT {test(first)} THEN 0 WHEN NOT {test(first + 1)} THEN 1 "
                f"WHEN NOT {test(first + 2)} THEN 2 ELSE 3 END)")

    def body(a: str) -> str:
        s, e = run(lambda i: opening(a, i), 0), run(lambda i: closing(a, i), 1)
        return (f"CASE WHEN len({a}) <= 6 THEN array_to_string({a}, chr(10)) "
                f"ELSE array_to_string({a}[{s} + 1 : len({a}) - {e}], chr(10)) END")

    return let(f"string_split({c}, chr(10))", body)


def keep_display_line(x: str) -> str:
    cited = has(f"lower({x})", "|".join(k.replace(".", r"\.") for k in fv.CITATION_KEYWORDS))
    return (
        f"(length({x}) >= 4 AND {has(x, chr(92) + 'p{L}')} AND NOT {has(x, fv.WHOLE_LINE_NOISE)} "
        f"AND NOT {has(x, fv.LINE_START_NOISE)} AND NOT ({has(x, fv.DOT_LEADER)} AND {has(x, fv.D)}) "
        f"AND NOT ({has(x, fv.CITATION_START)} AND length({x}) < 100 AND {cited}))"
    )


def clean_chunk_for_display(c: str) -> str:
    x = sub(f"coalesce({c}, '')", f"({fv.W}+)-\n({fv.W}+)", r"\1\2")
    lines = tfilter(tmap(f"string_split({x}, chr(10))", strip), keep_display_line)
    return strip(sub(f"array_to_string({lines}, ' ')", "  +", " "))


def split_sentences(c: str) -> str:
    x = sub(c, fv.ABBREVIATION_DOT, r"\1<DOT>")
    x = sub(x, fv.DIGIT_DOT, r"\1<DOT>")
    x = sub(x, rf"([.!?]){fv.S}+([A-Z])", r"'\1' || chr(1) || '\2'", raw=True)
    parts = tmap(f"string_split({x}, chr(1))", lambda s: strip(f"replace({s}, '<DOT>', '.')"))
    return tfilter(parts, lambda s: f"{s} <> ''")


def page_sentences(c: str) -> str:
    return let(clean_text(c), lambda t: let(remove_header_footer(t),
                                            lambda u: split_sentences(clean_chunk_for_display(u))))


def loose_sentences(c: str) -> str:
    x = sub(c, rf"([.!?]){fv.S}+", r"'\1' || chr(1)", raw=True)
    return tmap(f"string_split({x}, chr(1))", strip)


def truncate_text(c: str, limit: int) -> str:
    head = f"substring({c}, 1, {limit})"
    pos = f"strpos(reverse({head}), '.')"
    return (f"CASE WHEN length({c}) <= {limit} THEN {c} "
            f"WHEN {pos} > 0 AND {limit} - {pos} > {limit * 0.5} THEN substring({head}, 1, {limit} - {pos} + 1) "
            f"ELSE {head} || '...' END")


def clean_ocr_text(c: str) -> str:
    """Letter gaps are decided between neighbouring pieces of a split on single spaces."""
    ends = rf"(?:^|{fv.NW})[A-Za-z]\z"
    starts = rf"^[A-Za-z](?:{fv.NW}|\z)"
    lone = r"^[A-Za-z]\z"

    def join(t: str) -> str:
        i = f"v{next(_names)}"
        gap = (f"CASE WHEN {i} = 1 THEN '' WHEN {has(f'{t}[{i} - 1]', ends)} AND {has(f'{t}[{i}]', starts)} AND ("
               f"({has(f'{t}[{i} - 1]', lone)} AND {i} > 2 AND {has(f'{t}[{i} - 2]', ends)}) OR "
               f"({has(f'{t}[{i}]', lone)} AND {i} < len({t}) AND {has(f'{t}[{i} + 1]', starts)})) "
               f"THEN '' ELSE ' ' END")
        return f"array_to_string(list_transform(range(1, len({t}) + 1), lambda {i}: {gap} || {t}[{i}]), '')"

    joined = let(f"string_split({c}, ' ')", join)
    lines = f"regexp_split_to_array({joined}, " + q(r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]") + ")"
    keep = tfilter(lines, lambda x: let(words(x), lambda w: (
        f"(len({w}) > 0 AND len({tfilter(w, lambda y: f'length({y}) = 1')}) / greatest(len({w}), 1) <= 0.5)")))
    return f"array_to_string({keep}, ' ')"


def is_quality_text(c: str, min_words: int = 8) -> str:
    def judged(w: str) -> str:
        chars = f"coalesce(list_sum({tmap(w, lambda y: f'length({y})')}), 0)"
        single = f"len({tfilter(w, lambda y: f'length({y}) = 1')})"
        n = f"greatest(len({w}), 1)"
        return f"(len({w}) >= {min_words} AND {chars} / {n} >= 3.5 AND {single} / {n} < 0.25)"

    return let(words(c), judged)


def strip_material_noise(c: str) -> str:
    for pattern in fv.MATERIAL_NOISE:
        c = sub(c, pattern, " ")
    return c


def mostly_capitals(c: str) -> str:
    letters = sub(c, "[^a-zA-Z]", "")
    capitals = sub(letters, "[^A-Z]", "")
    return f"coalesce(length({capitals}) / nullif(length({letters}), 0) > 0.7, false)"


def key_terms(c: str, n: int = 4, skip_parentheses: bool = False) -> str:
    def wanted(w: str) -> str:
        keep = f"(NOT list_contains({strlist(fv.STUDY_STOP)}, lower({w})) AND length({w}) > 2"
        if skip_parentheses:
            keep += f" AND NOT starts_with({w}, '(') AND NOT ends_with({w}, ')')"
        return keep + ")"

    def shown(ws: str) -> str:
        head = f"[upper({ws}[1][1]) || lower({ws}[1][2:])]"
        return (f"CASE WHEN len({ws}) = 0 THEN 'this concept' "
                f"ELSE array_to_string(list_concat({head}, {ws}[2:{n}]), ' ') END")

    return let(tfilter(words(c), wanted), shown)


def clean_subject(c: str) -> str:
    x = sub(strip(c), fv.ARTICLES, "")
    x = strip(sub(x, fv.DETERMINERS, ""))
    return sub(x, r"[.,;:]+\z", "")


def without_article(c: str) -> str:
    return sub(strip(c), fv.ARTICLES, "")


def snippet(content: str, needle: str, margin: int = 80) -> str:
    def cut(i: str) -> str:
        start = f"greatest({i} - {margin}, 0)"
        end = f"least(length({content}), {i} + length({needle}) + {margin})"
        return (f"(CASE WHEN {start} > 0 THEN '...' ELSE '' END || "
                f"substring({content}, {start} + 1, greatest({end} - {start}, 0)) || "
                f"CASE WHEN {end} < length({content}) THEN '...' ELSE '' END)")

    return let(f"strpos(lower({content}), lower({needle})) - 1", cut)


def set_overlap(a: str, b: str) -> str:
    return (f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE "
            f"ELSE round({overlap_size(a, b)} / greatest(len({a}), len({b}), 1)::DOUBLE, 4) END")


def simple_overlap(a: str, b: str) -> str:
    return let(word_set(a), lambda x: let(word_set(b), lambda y: set_overlap(x, y)))


def detect_language(c: str) -> str:
    sample = f"substring({c}, 1, 1000)"
    tokens = tfilter(f"regexp_extract_all(lower({sample}), {q(fv.W + '+')})", lambda w: has(w, r"^[a-zà-ÿ]+\z"))

    def hits(ws: str, markers: Iterable[str]) -> str:
        return overlap_size(ws, strlist(markers))

    def accents(low: str, pattern: str) -> str:
        return f"(length({low}) - length({sub(low, pattern, '')}))"

    def choose(tk: str) -> str:
        return let(f"list_distinct({tk})", lambda ws: let(hits(ws, fv.EN_MARKERS), lambda en: scored(tk, ws, en)))

    def scored(tk: str, ws: str, en: str) -> str:
        def strong(markers: list[str], false_hits: list[str]) -> str:
            strict = [m for m in markers if m not in false_hits]
            return f"CASE WHEN {en} > 3 THEN {hits(ws, strict)} ELSE {hits(ws, markers)} END"

        arr = (f"[{en}, {strong(fv.FR_MARKERS, fv.FR_FALSE)}, {strong(fv.ES_MARKERS, fv.ES_FALSE)}, "
               f"{hits(ws, fv.DE_MARKERS)}, {strong(fv.PT_MARKERS, fv.PT_FALSE)}]")
        total = f"greatest(len({tk}), 1)"

        def decide(sc: str) -> str:
            low = f"lower({sample})"
            best = f"list_max({sc})"
            code = f"['en', 'fr', 'es', 'de', 'pt'][list_position({sc}, {best})]"
            return (
                f"CASE WHEN {code} <> 'en' AND {best} / {total} > ({sc}[1] / {total}) * 1.5 AND {best} / {total} > 0.02 THEN {code} "
                f"WHEN {accents(low, fv.FR_ACCENTS)} > 5 AND {sc}[2] > {sc}[1] THEN 'fr' "
                f"WHEN {accents(low, fv.DE_ACCENTS)} > 3 THEN 'de' "
                f"WHEN {accents(low, fv.ES_ACCENTS)} > 2 THEN 'es' "
                f"WHEN {accents(low, fv.PT_ACCENTS)} > 3 AND {sc}[5] > {sc}[2] THEN 'pt' ELSE 'en' END"
            )

        return let(arr, decide)

    scripts = " ".join(f"WHEN {has(sample, p)} THEN '{code}'" for code, p in fv.SCRIPT_RANGES)
    return (f"CASE WHEN {c} IS NULL OR length({strip(c)}) < 10 THEN 'en' {scripts} "
            f"ELSE {let(tokens, choose)} END")


def language_name(code: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.LANGUAGE_NAMES.items())
    return f"CASE {code} {whens} ELSE {code} END"


# --- composing statements ----------------------------------------------------
class Ctes:
    """Named relations with their dependencies; ``sql`` emits only what is used."""

    def __init__(self) -> None:
        self.defs: dict[str, tuple[tuple[str, ...], str]] = {}

    def add(self, name: str, sql: str, *needs: str) -> None:
        self.defs[name] = (needs, sql)

    def sql(self, body: str, *needs: str) -> str:
        order: list[str] = []

        def visit(name: str) -> None:
            if name in order:
                return
            for dep in self.defs[name][0]:
                visit(dep)
            order.append(name)

        for name in needs:
            visit(name)
        if not order:
            return body
        parts = ",\n".join(
            f"{n}{'' if self.defs[n][1].startswith('!') else ' AS MATERIALIZED ('}"
            f"{self.defs[n][1].lstrip('!')}{'' if self.defs[n][1].startswith('!') else ')'}" for n in order
        )
        recursive = "RECURSIVE " if any(self.defs[n][1].startswith("!") for n in order) else ""
        return f"WITH {recursive}{parts}\n{body}"
