from __future__ import annotations

import math
import random
from itertools import combinations

import numpy as np

from pagelore.llm import topk, url_rules, wrapper

VECTORS = "vec_id long, embedding array<float>, score string, vec string"


def test_topk_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "BLOCKS_PER_SHARD", 4)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    rng = np.random.default_rng(1)
    data = [(int(i), [float(np.float32(x)) for x in np.round(rng.normal(size=6), 1)], "s", "v") for i in range(300)]
    data += [(300, None, "", ""), (400, [1.0, None, 0.0, 0.0, 0.0, 0.0], "", ""), (500, [1.0, float("nan")], "", ""), (600, [float("inf")], "", ""), (None, [1.0], "", ""), (700, data[100][1], "", ""), (8, data[8][1], "", "")]
    vectors = spark.createDataFrame(data, VECTORS)
    got = sorted(map(tuple, topk.exact_topk(vectors, vectors.filter("vec_id % 100 = 0")).collect()))
    sound = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in {i: v for i, v in sound if i % 100 == 0}.items():
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in sound if i != q))[:10]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    assert got == sorted(want)
    assert topk.exact_topk(vectors.limit(0), vectors.limit(0)).count() == 0


def test_topk_with_few_candidates_and_large_numbers(spark):
    data = [(0, [1e9, 3.0], "", ""), (1, [1.0, 1e8], "", ""), (2, [1.0], "", "")]
    vectors = spark.createDataFrame(data, VECTORS)
    got = [tuple(r) for r in topk.exact_topk(vectors, vectors.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, int(1024e9) * 1024 + 3072 * int(1024e8)), (0, 2, 2, int(1024e9) * 1024)]


URLS = [*["x://shop.com/de/7"] * 3, "http://a.example.org/en/1x", "https://EXAMPLE.org/es/3?q=1", "x://shop.com/de/7", "x://shop.com/de/8", "x://shop.com/de/9", "x://shop.org/", "x://a.com/fr/1#t",
        "x://shop.net/de/4", "x://b.net/en/5", "x://org", "x://org/", "notaurl", "", None, "x://?q", "x://shop.net/de/4", "x://com.example/de/", "http://HÖST.net/Ä/1"]


def test_url_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    judged = {r.page_id: r for r in url_rules.judge_urls(pages).collect()}
    assert len(judged) == len(URLS)
    got = {k - 3 - (k > 8): r for k, r in judged.items() if k >= 3 and k != 8}
    assert (got[0].rule, got[0].verdict) == ("example.org/en/1", "block")
    assert (got[1].host, got[1].path, got[1].rule) == ("example.org", "/es/3", "example.org/es/")
    assert got[2].verdict == "block" and got[5].rule == "com/fr/"
    assert got[8].rule is None and got[9].rule == "org/"  # a rule's path needs at least its slash
    assert got[6].verdict == got[14].verdict == "block"  # shop with de is blocked wherever the list knows it
    assert got[7].verdict == "allow" and (got[12].host, got[12].path, got[12].verdict) == ("", "", "allow")
    assert got[13].host == "" and got[16].host == "hÖst.net"
    assert url_rules.judge_urls(pages.limit(0)).count() == 0


def test_mined_rules_are_all_frequent_confident_sets(spark):
    pages = spark.createDataFrame([(i, f"x://{h}.com/{p}/{i}") for i, (h, p) in enumerate([("a", "de"), ("a", "de"), ("a", "en"), ("b", "en"), ("b", "de"), ("c", "en")] * 4)], "page_id long, url string")
    cut = pages.select(url_rules.host_of(url_rules.F.col("url")).alias("host"), url_rules.path_of(url_rules.F.col("url")).alias("path")).withColumn("blocked", url_rules.F.col("path").startswith("/de"))
    data = [(tuple(r.tokens), r.blocked) for r in cut.select(url_rules.tokens(url_rules.F.col("host"), url_rules.F.col("path")).alias("tokens"), "blocked").collect()]
    got = {frozenset(r.antecedent) for r in url_rules.mine(cut.select(url_rules.tokens(url_rules.F.col("host"), url_rules.F.col("path")).alias("tokens"), "blocked"), 0.2, 0.9, 1).collect()}
    want = set()
    for n in range(1, 6):
        for items in {frozenset(c) for t, _ in data for c in combinations(t, n)}:
            has = [b for t, b in data if items <= set(t)]
            if sum(has) >= 0.2 * len(data) and sum(has) / len(has) >= 0.9:
                want.add(items)
    assert got == want


def test_minimal_rules_match_the_same_urls(spark):
    rng = random.Random(8)
    words = ["ads", "spam", "casino", "news", "de", "shop", "x1"]
    rows = [(sorted(rng.sample(words, rng.randint(1, 5))),) for _ in range(300)]
    rows = [(t, {"ads", "casino"} <= set(t) or "spam" in t) for (t,) in rows]
    labelled = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    every = [set(r.antecedent) for r in url_rules.mine(labelled, 0.02, 0.9, 5).collect()]
    least = [set(r.antecedent) for r in url_rules.mine_minimal(labelled, 0.02, 0.9, 5).collect()]
    assert {"spam"} in least and {"ads", "casino"} in least and len(least) < len(every)
    for n in range(1, 5):
        for t in combinations(words, n):
            assert any(r <= set(t) for r in every) == any(r <= set(t) for r in least)
    assert url_rules.mine_minimal(labelled.limit(0)).count() == 0


def test_long_repeated_urls_are_mined_in_time(spark):
    long = "/".join(f"seg{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))
    other = "/".join(f"oth{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))
    urls = [f"x://a.example.org/es/{long}"] * 1000 + [f"x://b.org/{other}"] * 1000 + [f"x://c.net/{long}", f"x://c.net/{other}", "x://c.net/segab"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    judged = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge_urls(pages).collect()}
    assert judged[0] == ("example.org/es/", "block") and judged[1500] == ("org/", "allow")
    assert [judged[n] for n in (2000, 2001, 2002)] == [(None, "block"), (None, "allow"), (None, "block")]


PAGE = """<!DOCTYPE html><html><head><title>t{i}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/x">x{i}</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div>{body}<aside>Side {i}</aside><div id="comments"><p>Reader {i} says</p></div><form><p>Search</p></form><footer>&copy; {i}</footer></body></html>"""


def test_article_text(spark):
    body = "<article><h1>Head &amp; {i}</h1><p><b>First\n  words {i}.<br><p>Second &eacute;&nbsp;x {i}</p><div class='ad'>Buy</div><p>Share this page</p><ul><li>one {i}<li>two</ul></article>"
    data = [(i, f"http://h.com/{i}", PAGE.format(i=i, body=body.format(i=i)), "clash") for i in range(12)]
    data += [(50, "http://h.com/1", data[0][2], ""), (51, None, None, ""), (52, "http://h.com/", "", ""), (53, "http://o.com", "<p>plain <i>text</i> here", ""), (None, "http://o.com", "a < b & c", "")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, text string")
    rows = wrapper.extract_pages(pages).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == len(data)
    # the share line and the item that never change are template by the wrapper
    assert got[3].text == "Head & 3\n\nFirst words 3.\n\nSecond é x 3\n\none 3"
    assert got[3].n_chars == len(got[3].text)
    assert got[51].text == "" and got[52].text == "" and got[51].n_chars == 0
    assert got[53].text == "plain text here" and got[None].text == "a < b & c"
    assert wrapper.extract_pages(pages.limit(0)).count() == 0


def test_template_keeps_what_parts_words(spark):
    body = "<article><p>one{i}<br>two{i} <b>a{i}</b> <i>b{i}</i></p><p><a>x{i}</a>, <a>y{i}</a></p><p>Share this page</p><div>in{i}<div>Share me</div>out{i}</div></article>"
    for n in (2, 10):  # the blanks are the same whatever the size of the host
        data = [(i, f"http://h.com/{i}", PAGE.format(i=i, body=body.format(i=i))) for i in range(n)]
        got = {r.page_id: r.text for r in wrapper.extract_pages(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
        blocks = [b for b in got[1].split("\n\n") if not b.startswith("Share")]
        assert blocks == ["one1 two1 a1 b1", "x1, y1", "in1", "out1"]


def test_region_without_article_element(spark):
    body = "<div class='wrap'><div class='links'><a href='/'>Home</a></div><div class='text'><p>Story {i} tells of {i} things</p><p>More {i} and {i}</p></div></div>"
    data = [(i, f"http://h.com/{i}", PAGE.format(i=i, body=body.format(i=i))) for i in range(10)]
    got = {r.page_id: r.text for r in wrapper.extract_pages(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert got[4] == "Story 4 tells of 4 things\n\nMore 4 and 4"


def test_tree_matching_is_the_largest():
    a, b = wrapper.parse("<div><p>x</p><ul><li>1<li>2</ul><p>y</p></div>"), wrapper.parse("<div><ul><li>1</ul><p>y</p><p>z</p></div>")
    score, pairs = wrapper.match(a, b)
    tags = [x.tag for x, _ in pairs]
    assert tags.count("li") == 1 and tags.count("p") == 1 and all(x.tag == y.tag for x, y in pairs)
    deep = "<div>" * 5000 + "x"
    assert wrapper.match(wrapper.parse(deep), wrapper.parse(deep))[0] > 0
    wide = "".join(f"<p>{i}</p>" for i in range(3000))
    assert wrapper.match(wrapper.parse(wide), wrapper.parse(wide))[0] >= 3000


def test_long_lists_are_matched_in_full():
    rows = lambda n, skip: "<ul>" + "".join(f"<li><b>{i}</b> <i>x</i></li>" for i in range(n) if i % 40 != skip) + "</ul>"
    plain = lambda n, skip: "<p>new</p>" * skip + "".join(f"<p>{i}</p>" for i in range(n))
    score, pairs = wrapper.match(wrapper.parse(rows(300, 3)), wrapper.parse(rows(300, 5)))
    assert score >= 284 * 6 and sum(x.tag == "li" for x, _ in pairs) == 292
    a, b = wrapper.parse(plain(250, 0)), wrapper.parse(plain(250, 30))  # every old paragraph finds itself behind 30 new ones
    score, pairs = wrapper.match(a, b)
    assert score == 1 + 250 * 3 and sum(x.tag == "p" and x.plain == y.plain for x, y in pairs) == 250
