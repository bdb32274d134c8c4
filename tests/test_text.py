"""Text functions against expectations worked out by hand."""

import pytest
from pyspark.sql import functions as F

from pagelore.functions import text as tx


def one(spark, build, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return df.select(build(*[F.col(n) for n in names]).alias("v")).first()["v"]


@pytest.mark.parametrize("raw, want", [
    (None, ""), ("", ""), ("a\x00b\x07c", "abc"), ("a | b", "a I b"), ("it`s", "it's"), ("“q”", "“q”"),
    ("a  \t b", "a b"), ("a\n\n\n\nb", "a\n\nb"), ("  x \n y  ", "x\ny"),
])
def test_clean_text(spark, raw, want):
    assert one(spark, tx.clean_text, raw) == want


def test_header_and_footer_go_only_from_long_pages(spark):
    short = "1\nBody\n2"
    assert one(spark, tx.remove_header_footer, short) == short
    page = "12\n---\nTitle line\na\nb\nc\nd\n7\n8"
    assert one(spark, tx.remove_header_footer, page) == "Title line\na\nb\nc\nd"


@pytest.mark.parametrize("line, kept", [
    ("12", False), ("- 3 -", False), ("Page 4 of 9", False), ("3 | P a g e", False), ("xiv", False), ("Intro ........ 5", False),
    ("-----", False), ("[3] Someone wrote", False), ("1. Smith et al. wrote", False), ("1. Install the program", True),
    ("https://example.com/x", False), ("Copyright by us", False), ("abc", False), ("12345 678", False), ("A normal line.", True),
])
def test_display_lines(spark, line, kept):
    assert one(spark, tx.clean_chunk_for_display, line) == (line if kept else "")


def test_hyphenated_breaks_join(spark):
    assert one(spark, tx.clean_chunk_for_display, "A hyphen-\nated word") == "A hyphenated word"


def test_sentences(spark):
    text = "Dr. Who came. It cost 3.5 coins. See Fig. 2. Then he left! Done"
    assert one(spark, tx.split_sentences, text) == ["Dr. Who came.", "It cost 3.5 coins.", "See Fig. 2. Then he left!", "Done"]


def test_truncate(spark):
    assert one(spark, lambda c: tx.truncate_text(c, 20), "short") == "short"
    assert one(spark, lambda c: tx.truncate_text(c, 20), "First part ok. Second part") == "First part ok."
    assert one(spark, lambda c: tx.truncate_text(c, 20), "A. " + "x" * 30) == "A. " + "x" * 17 + "..."


def test_spaced_letters_are_joined(spark):
    assert one(spark, tx.clean_ocr_text, "T h e dog and a b stay") == "The dog and a b stay"
    assert one(spark, tx.clean_ocr_text, "x y\nreal words here") == "real words here"


def test_languages(spark):
    assert one(spark, tx.detect_language, "short") == "en"
    assert one(spark, tx.detect_language, "The cat and the dog were here before they left") == "en"
    assert one(spark, tx.detect_language, "der Hund und die Katze sind nicht auf dem Tisch") == "de"
    assert one(spark, tx.detect_language, "Привет всем людям") == "ru"
    assert one(spark, tx.language_name, "de") == "German"
    assert one(spark, tx.language_name, "xx") == "xx"


def test_terms_and_subject(spark):
    assert one(spark, lambda c: tx.key_terms(c, 3), "the quick BROWN fox is here") == "Quick BROWN fox"
    assert one(spark, lambda c: tx.key_terms(c, 3), "it is to") == "this concept"
    assert one(spark, tx.clean_subject, " The such method., ") == "method"


def test_snippet_and_overlap(spark):
    text = "x" * 100 + "needle" + "y" * 100
    assert one(spark, lambda a, b: tx.snippet(a, b), text, "NEEDLE") == "..." + "x" * 80 + "needle" + "y" * 80 + "..."
    assert one(spark, tx.simple_overlap, "a b c", "b c d e") == 0.5
    assert one(spark, tx.simple_overlap, "", "a") == 0.0
