"""Text column functions: every one is a native Spark expression.

``let`` binds an intermediate value once, so that a long chain of regular
expressions is not evaluated again for each place that reads its result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelore.functions import fixed_values as fv


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(fv.WS_CHARS))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


#: ``fv.S`` as Java reads it fastest: printable ASCII is refused before the long class is looked at.
_SPACE = rf"[\x00-\x20\x7f-\x{{10ffff}}&&{fv.S}]"


def java(pattern: str) -> str:
    """A shared pattern with its white space as Java reads it fastest."""
    return pattern.replace(fv.S, _SPACE)


def words(c: Column) -> Column:
    """Whitespace split without empty items."""
    return F.filter(F.split(c, _SPACE + "+"), lambda w: w != "")


def lower_words(c: Column) -> Column:
    return words(F.lower(c))


def word_set(c: Column) -> Column:
    return F.array_distinct(lower_words(c))


def word_runs(c: Column) -> Column:
    """Maximal runs of word characters."""
    return F.regexp_extract_all(c, F.lit("(" + fv.W + "+)"), F.lit(1))


def string_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def any_match(c: Column, patterns: Iterable[str], flags: str = "(?i)") -> Column:
    return c.rlike(java(flags + "(?:" + "|".join(patterns) + ")"))


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


# --- page cleaning -----------------------------------------------------------
def clean_text(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    c = F.regexp_replace(c, fv.CONTROL_CHARS, "")
    c = F.replace(F.replace(c, F.lit("|"), F.lit("I")), F.lit("`"), F.lit("'"))
    c = F.regexp_replace(c, "\t[ \t]*| [ \t]+", " ")  # a single blank is no match
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    return strip(F.array_join(F.transform(F.split(c, "\n"), strip), "\n"))


def _opening_noise(lines: Column, i: int) -> Column:
    line = F.get(lines, F.lit(i))
    return (F.length(strip(line)) < 60) & ~F.substring(line, 1, 5).rlike(r"\p{L}")


def _closing_noise(lines: Column, i: int) -> Column:
    line = strip(F.get(lines, F.size(lines) - i))
    return (F.length(line) < 60) & line.rlike(r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉]+\z")


def _run_of_three(test: Callable[[int], Column], first: int) -> Column:
    return (
        F.when(~test(first), 0).when(~test(first + 1), 1).when(~test(first + 2), 2).otherwise(3)
    )


def remove_header_footer(c: Column) -> Column:
    def trimmed(lines: Column) -> Column:
        start = _run_of_three(lambda i: _opening_noise(lines, i), 0)
        dropped = _run_of_three(lambda i: _closing_noise(lines, i), 1)
        body = F.slice(lines, start + 1, F.greatest(F.size(lines) - start - dropped, F.lit(0)))
        return F.array_join(F.when(F.size(lines) <= 6, lines).otherwise(body), "\n")

    return let(F.split(c, "\n"), trimmed)


def keep_display_line(line: Column) -> Column:
    cited = F.lower(line).rlike("|".join(k.replace(".", r"\.") for k in fv.CITATION_KEYWORDS))
    return (
        (F.length(line) >= 4)
        & line.rlike(r"\p{L}")
        & ~line.rlike(fv.WHOLE_LINE_NOISE)
        & ~line.rlike(fv.LINE_START_NOISE)
        & ~(line.rlike(fv.DOT_LEADER) & line.rlike(fv.D))
        & ~(line.rlike(fv.CITATION_START) & (F.length(line) < 100) & cited)
    )


def clean_chunk_for_display(c: Column) -> Column:
    c = F.regexp_replace(F.coalesce(c, F.lit("")), f"({fv.W})-\n({fv.W}+)", "$1$2")
    lines = F.filter(F.transform(F.split(c, "\n"), strip), keep_display_line)
    return strip(F.regexp_replace(F.array_join(lines, " "), "  +", " "))


#: White space behind a sentence mark: most characters are refused before it is looked what stands ahead of them.
_AFTER_MARK = f"{_SPACE}(?<=[.!?]{_SPACE}){_SPACE}*"


def split_sentences(c: Column) -> Column:
    c = F.regexp_replace(c, rf"\.(?<={fv.ABBREVIATION_DOT})", "<DOT>")
    c = F.regexp_replace(c, fv.DIGIT_DOT, "$1<DOT>")
    parts = F.split(c, f"{_AFTER_MARK}(?=[A-Z])")
    parts = F.transform(parts, lambda s: strip(F.replace(s, F.lit("<DOT>"), F.lit("."))))
    return F.filter(parts, lambda s: s != "")


def page_sentences(c: Column) -> Column:
    """Sentences of a page after the three cleaning steps."""
    return let(
        clean_text(c),
        lambda t: let(remove_header_footer(t), lambda u: split_sentences(clean_chunk_for_display(u))),
    )


def truncate_text(c: Column, limit: int) -> Column:
    head = F.substring(c, 1, limit)
    from_end = F.locate(".", F.reverse(head))
    last_dot = F.lit(limit) - from_end  # zero-based; only read when a dot exists
    cut = F.when(
        (from_end > 0) & (last_dot > limit * 0.5), F.substring(head, F.lit(1), last_dot + 1)
    ).otherwise(F.concat(head, F.lit("...")))
    return F.when(F.length(c) <= limit, c).otherwise(cut)


# --- noise from optical recognition and slides --------------------------------
_LONE = f"(?<!{fv.W})[A-Za-z]"
#: A blank in a run of lone letters; nothing but a blank before a letter is looked at twice.
_SPACED_LETTER_GAP = (
    f" (?=[A-Za-z])(?:(?<={_LONE} [A-Za-z] )(?=[A-Za-z](?!{fv.W}))|(?<={_LONE} )(?=[A-Za-z] [A-Za-z](?!{fv.W})))"
)


def _single_char_share(ws: Column) -> Column:
    return ratio(F.size(F.filter(ws, lambda w: F.length(w) == 1)), F.size(ws))


def clean_ocr_text(c: Column) -> Column:
    joined = F.regexp_replace(c, _SPACED_LETTER_GAP, "")
    lines = F.split(joined, r"[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]")  # what stands between \r and \n goes as an empty line
    keep = F.filter(
        lines,
        lambda line: let(words(line), lambda ws: (F.size(ws) > 0) & (_single_char_share(ws) <= 0.5)),
    )
    return F.array_join(keep, " ")


def is_quality_text(c: Column, min_words: int = 8) -> Column:
    def judged(ws: Column) -> Column:
        chars = F.length(F.array_join(ws, ""))
        return (
            (F.size(ws) >= min_words)
            & F.coalesce(ratio(chars, F.size(ws)) >= 3.5, F.lit(False))
            & F.coalesce(_single_char_share(ws) < 0.25, F.lit(False))
        )

    return let(words(c), judged)


def strip_material_noise(c: Column) -> Column:
    for pattern in fv.MATERIAL_NOISE:
        # Java spelling of "word boundary" and "line start" with the reach these patterns mean
        spelled = java(pattern).replace(r"\b", r"(?U:\b)").replace("(?m)^", "(?dm:^)")
        sign = "|" if r"\|" in pattern else "/" if f"/{fv.S}" in pattern else None
        if sign is None:
            c = F.regexp_replace(c, spelled, " ")
        else:  # nothing is looked for in a text without the sign
            c = let(c, lambda t: F.when(F.contains(t, F.lit(sign)), F.regexp_replace(t, spelled, " ")).otherwise(t))  # noqa: B023
    return c


def mostly_capitals(c: Column) -> Column:
    """More than seven in ten ASCII letters are capitals; what is not counted goes in runs, not letter by letter."""
    capitals, letters = (F.length(F.regexp_replace(c, f"[^{kind}]+", "")) for kind in ("A-Z", "a-zA-Z"))
    return F.coalesce(ratio(capitals, letters) > 0.7, F.lit(False))


def loose_sentences(c: Column) -> Column:
    """Split after any sentence mark followed by white space, trimmed."""
    return F.transform(F.split(c, _AFTER_MARK), strip)


# --- study helpers -----------------------------------------------------------
def _capitalized(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))


def key_terms(c: Column, n: int = 4, skip_parentheses: bool = False) -> Column:
    def wanted(w: Column) -> Column:
        keep = (F.length(w) > 2) & ~F.lower(w).isin(fv.STUDY_STOP)
        if skip_parentheses:
            keep = keep & ~w.startswith("(") & ~w.endswith(")")
        return keep

    def shown(ws: Column) -> Column:
        first = F.array(_capitalized(F.get(ws, F.lit(0))))
        return F.when(F.size(ws) == 0, F.lit("this concept")).otherwise(
            F.array_join(F.concat(first, F.slice(ws, 2, max(n - 1, 1))), " ")
        )

    return let(F.filter(words(c), wanted), shown)


def clean_subject(c: Column) -> Column:
    c = F.regexp_replace(strip(c), java(fv.ARTICLES), "")
    c = strip(F.regexp_replace(c, java(fv.DETERMINERS), ""))
    return F.regexp_replace(c, r"[.,;:]+\z", "")


def without_article(c: Column) -> Column:
    return F.regexp_replace(strip(c), java(fv.ARTICLES), "")


def snippet(content: Column, needle: Column, margin: int = 80) -> Column:
    """Text around the first case-insensitive hit; a missing hit counts as index -1."""
    at = F.instr(F.lower(content), F.lower(needle)) - 1

    def cut(idx: Column) -> Column:
        start = F.greatest(idx - margin, F.lit(0))
        end = F.least(F.length(content), idx + F.length(needle) + margin)
        return F.concat(
            F.when(start > 0, "...").otherwise(""),
            F.substring(content, start + 1, F.greatest(end - start, F.lit(0))),
            F.when(end < F.length(content), "...").otherwise(""),
        )

    return let(at, cut)


def set_overlap(a: Column, b: Column) -> Column:
    """|A and B| over the larger set, four decimals; zero when a side is empty."""
    shared = F.size(F.array_intersect(a, b))
    largest = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.round(ratio(shared, largest), 4)
    )


def simple_overlap(a: Column, b: Column) -> Column:
    return let(word_set(a), lambda x: let(word_set(b), lambda y: set_overlap(x, y)))


def cache_key(query: Column, document_ids: Column) -> Column:
    """MD5 of the question and the sorted id list written as ``[1, 2]``."""
    ids = F.concat(F.lit("["), F.array_join(F.sort_array(document_ids).cast("array<string>"), ", "), F.lit("]"))
    has_ids = F.coalesce(F.size(document_ids) > 0, F.lit(False))
    return F.md5(F.when(has_ids, F.concat_ws("|", query, ids)).otherwise(query))


# --- language ----------------------------------------------------------------
def _hits(ws: Column, markers: list[str]) -> Column:
    return F.size(F.array_intersect(ws, string_array(markers)))


def _accent_count(c: Column, pattern: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def detect_language(c: Column) -> Column:
    sample = F.substring(c, 1, 1000)

    def latin(tokens: Column) -> Column:
        return let(
            F.array_distinct(tokens),
            lambda ws: let(
                _hits(ws, fv.EN_MARKERS),
                lambda en: _choose(F.lower(sample), ws, en, F.greatest(F.size(tokens), F.lit(1))),
            ),
        )

    def _choose(low: Column, ws: Column, en: Column, total: Column) -> Column:
        def strong(markers: list[str], false_hits: list[str]) -> Column:
            strict = [m for m in markers if m not in false_hits]
            return F.when(en > 3, _hits(ws, strict)).otherwise(_hits(ws, markers))

        scores = F.array(
            en, strong(fv.FR_MARKERS, fv.FR_FALSE), strong(fv.ES_MARKERS, fv.ES_FALSE),
            _hits(ws, fv.DE_MARKERS), strong(fv.PT_MARKERS, fv.PT_FALSE),
        )

        def decide(sc: Column) -> Column:
            share = lambda i: F.get(sc, F.lit(i)) / total
            best = F.array_max(sc)
            winner = F.array_position(sc, best)
            code = F.element_at(string_array(["en", "fr", "es", "de", "pt"]), winner.cast("int"))
            clear = (code != "en") & (best / total > share(0) * 1.5) & (best / total > 0.02)
            return (
                F.when(clear, code)
                .when((_accent_count(low, fv.FR_ACCENTS) > 5) & (share(1) > share(0)), "fr")
                .when(_accent_count(low, fv.DE_ACCENTS) > 3, "de")
                .when(_accent_count(low, fv.ES_ACCENTS) > 2, "es")
                .when((_accent_count(low, fv.PT_ACCENTS) > 3) & (share(4) > share(1)), "pt")
                .otherwise("en")
            )

        return let(scores, decide)

    result = F.when(c.isNull() | (F.length(strip(c)) < 10), F.lit("en"))
    for code, pattern in fv.SCRIPT_RANGES:
        result = result.when(sample.rlike(pattern), code)
    tokens = F.filter(word_runs(F.lower(sample)), lambda w: w.rlike(r"^[a-zà-ÿ]+\z"))
    return result.otherwise(let(tokens, latin))


def language_name(code: Column) -> Column:
    pairs = [F.lit(x) for kv in fv.LANGUAGE_NAMES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code)
