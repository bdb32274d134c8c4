import hashlib
import random
import zlib

import numpy as np
import pytest

from pagelore.llm import conversations as co
from pagelore.llm import language_cnn as lc
from pagelore.llm import merkle as me
from tests.llm import samples


# --- language network ------------------------------------------------------------
def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


LANG_ROWS = [("a", "abcde"), ("b", "defgh"), ("ü", "üöäßx")]


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    return [(i, words(rng, letters, rng.randint(3, 300)), lang, "s", 1, 2, "x", "clash") for i in range(n) for lang, letters in [LANG_ROWS[i % 3]]]


def test_windows_cover_the_whole_text():
    for n in (0, 1, 252, 253, 254, 256, 257, 509, 510, 1000):
        text = "".join(chr(97 + i % 26) for i in range(n))
        cut, held = lc.windows(text)
        step = lc.LENGTH - max(lc.WIDTHS) + 1
        joined = b"".join(bytes(row[:step] if i < len(cut) - 1 else row[:held[i]]) for i, row in enumerate(cut))
        assert joined[:n] == text.encode() and (n == 0 or len(joined) == n)
        grams = {text[i:i + 4] for i in range(n - 3)}
        assert grams <= {bytes(row[i:i + 4]).decode() for row in cut for i in range(lc.LENGTH - 3) if 0 not in row[i:i + 4]}


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    net = lc.Network(["a", "b", "c"], 5)
    for i, p in enumerate(net.parameters()):
        p += rng.normal(0, 0.2, p.shape).astype(np.float32)
    net.tables = [t.astype(np.float64) for t in net.tables]
    net.bias, net.dense, net.base = (p.astype(np.float64) for p in (net.bias, net.dense, net.base))
    x, y = rng.integers(0, 6, (5, 30)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    loss = lambda: -np.log(net.probabilities(x)[np.arange(5), y]).mean()
    for p, g in zip(net.parameters(), net.gradients(x, y)):
        for _ in range(6):
            at = tuple(rng.integers(0, min(d, 6)) for d in p.shape)
            kept, e = p[at], 1e-5
            p[at] = kept + e
            up = loss()
            p[at] = kept - e
            down = loss()
            p[at] = kept
            assert abs((up - down) / (2 * e) - g[at]) < 1e-3


def test_held_out_languages_are_told(spark):
    docs = samples.docs(spark, corpus())
    network = lc.learn(docs)
    assert network.langs == ["a", "b", "ü"]
    got = lc.predict(docs, network).collect()
    assert len(got) == 60 and sum(r.lang == r.lang_pred for r in got) >= 58
    odd = samples.docs(spark, [(1, None, "a", *"s123x"[:1], 1, 2, "x", "c"), (2, "", "a", "s", 1, 2, "x", "c"), (3, "12 ½ ... ²", "a", "s", 1, 2, "x", "c"),
                               (4, "üöä " * 200_000, None, None, None, None, "x", "c"), (4, "üöä " * 200_000, None, None, None, None, "x", "c"), (None, "abc", "a", "s", 1, 2, "x", "c")])
    told = lc.predict(odd.withColumnRenamed("shard", "_TOLD"), network)
    assert told.columns.count("score") == 1 and "_TOLD" in told.columns
    by = {(r.doc_id, r.lang_pred, r.score) for r in told.collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)} <= by
    assert len([r for r in by if r[0] == 4]) == 1 and {r[1] for r in by if r[0] == 4} == {"ü"}
    assert lc.learn(samples.none(spark)) is None and lc.predict(samples.none(spark), None).count() == 0
    assert lc.predict(odd, None).first().lang_pred == "und"


def test_nothing_is_learned_from_held_out_rows(spark):
    kept = [r for r in corpus() if zlib.crc32(str(r[0]).encode()) % 5]
    noise = [(i, "zzzz zzz", "held", "s", 1, 2, "x", "c") for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5 == 0]
    a, b = lc.learn(samples.docs(spark, kept)), lc.learn(samples.docs(spark, kept + noise))
    assert a.langs == b.langs and all(np.array_equal(p, q) for p, q in zip(a.parameters(), b.parameters()))


# --- Merkle manifest --------------------------------------------------------------
def plain_manifest(rows):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, extra=0: h("".join(part(v) for v in (r[0], r[3], r[2], None if r[4] is None else r[4] + extra, r[1])))
    touched = lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
        return out

    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(langs, key=lambda v: (v is not None, (v or "").encode()))
    trees = {lang: levels([x[2] for x in sorted(langs[lang], key=lambda x: x[:3])]) for lang in order}
    top = levels([trees[lang][-1][0] for lang in order])
    out = []
    for rank, lang in enumerate(order):
        for i, (_, _, original, r) in enumerate(sorted(langs[lang], key=lambda x: x[:3])):
            cur, proof = (leaf(r, 1) if touched(r) else original), ""
            for tree, at in ((trees[lang], i), (top, rank)):
                for level in tree[:-1]:
                    pair = level[at - at % 2:at - at % 2 + 2]
                    proof += "".join(x for k, x in enumerate(pair) if k != at % 2)
                    cur = h("".join(cur if k == at % 2 else x for k, x in enumerate(pair)))
                    at //= 2
            out.append((r[0], original, trees[lang][-1][0], top[-1][0], h(proof), cur, cur == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("stride", [1, 2, 3, 10])
def test_manifest_against_plain_trees(spark, stride):
    rng = random.Random(stride)
    rows = samples.rows(stride, 60) + [(1000 + i, f"t{i}", rng.choice(["zz", "é", "", "en"]), None, i, 1, "x", "y") for i in range(20)]
    got = me.manifest(samples.docs(spark, rows), stride).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_manifest(rows)
    assert any(not r.verified for r in got) and any(r.verified for r in got)


def test_manifest_of_one_leaf_and_of_none(spark):
    row = [(7, "text", None, None, 4, 1, "x", "y")]
    assert [tuple(r) for r in me.manifest(samples.docs(spark, row)).collect()] == plain_manifest(row)
    assert me.manifest(samples.none(spark)).count() == 0
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    many = [(5, "same", "en", "a", 4, 1, "x", "y")] * 9
    assert sorted((tuple(r) for r in me.manifest(samples.docs(spark, many), 2).collect()), key=repr) == plain_manifest(many)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == limit


# --- conversations -----------------------------------------------------------------
def plain_edits(rows):
    """Least (cost, audit) by a row at a time; rows are (symbol, role)."""
    best = {s: (0 if s in (0, 3) else None, "") for s in range(4)}

    def filled(found):
        out = {}
        for s in range(4):
            options, at, n = [], s, 0
            while n < 4:
                if found[at][0] is not None:
                    options.append((found[at][0] + 3 * n, "I" * n + found[at][1]))
                at, n = co.FILL[at], n + 1
            out[s] = min(options)
        return out

    best = filled(best)
    for symbol, _ in reversed(rows):
        found = {}
        for s in range(4):
            options = [(4 + best[s][0], "D" + best[s][1])]
            if symbol != "x":
                extra = 3 if symbol.endswith("t") else 0
                if s in co.KEEP.get(symbol[0], {}):
                    c, a = best[co.KEEP[symbol[0]][s]]
                    options.append((extra + c, "K" + a))
                c, a = best[co.FILL[s]]
                options.append((3 + extra + c, "R" + a))
            found[s] = min(options)
        best = filled(found)
    return best[0]


def test_runs_against_a_row_at_a_time():
    rng = random.Random(4)
    symbols = ["s", "u", "a", "o", "st", "ut", "at", "ot", "x"]
    for _ in range(3000):
        rows = [s for _ in range(rng.randint(0, 6)) for s in [rng.choice(symbols)] * rng.choice([1, 1, 2, 3, 9])]
        piece = co.Piece("c")
        for s in rows:
            piece._run(s, 1)
        audit, _, cost = co.solve(tuple(piece.runs))
        assert (cost, audit) == plain_edits([(s, None) for s in rows])


def test_a_cut_conversation_is_solved_as_a_whole_one():
    rng = random.Random(5)
    symbols = ["s", "u", "a", "ut", "at", "x", "o"]
    for _ in range(400):
        parts = [tuple((rng.choice(symbols), rng.randint(1, 4)) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 5))]
        behind = [co.END]
        for p in reversed(parts[1:]):
            behind.append(co.act(co.matrix(p), behind[-1]))
        state, audit, cost = co.START, "", 0
        for i, (p, v) in enumerate(zip(parts, reversed(behind))):
            letters, state, c = co.solve(p, v, state, i == len(parts) - 1)
            audit, cost = audit + letters, cost + c
        assert (cost, audit) == plain_edits([(s, None) for p in parts for s, n in p for _ in range(n)])


def test_a_long_run_is_unrolled():
    audit, _, cost = co.solve((("u", 100_001), ("x", 50_000)))
    assert len(audit.replace("I", "")) == 150_001 and audit.endswith("D" * 50_000)
    assert cost == 4 * 50_000 + sum(3 for c in audit if c in "IR") + 4 * (audit.count("D") - 50_000)


def plain_repair(rows):
    crc = lambda c, t: zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
    space, out = " \t\n\x0b\x0c\r", []
    for conv in {r[0] for r in rows}:
        left = []
        for _, turn, role, text in [r for r in rows if r[0] == conv]:
            kind, role, text = crc(conv, turn), " " if role is None else role, " " if text is None else text
            if kind == 0:
                continue
            text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
            left += [(turn is not None, turn or 0, "user" if kind == 4 else role, hashlib.md5(text.encode()).hexdigest(), text)] * (2 if kind == 3 else 1)
        left.sort()
        seen, symbols, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, _, text in left:
            fault = "blank" if not text.strip(space) else "duplicate" if (role, text) in seen else "truncated" if text.strip(space)[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols.append(("x" if fault in ("blank", "duplicate") else initial + fault[:1], role))
        cost, audit = plain_edits(symbols)
        lines, state, at = [], 0, 0
        for letter in audit:
            if letter in "IR":
                lines.append(f"{co.ROLE[state]}:{left[at][4] if letter == 'R' else ''}")
                state = co.FILL[state]
            elif letter == "K":
                lines.append(f"{left[at][2]}:{left[at][4]}")
                state = co.KEEP[left[at][2][0]][state]
            at += letter != "I"
        turns = {t for known, t, *_ in left if known}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(left, left[1:])]
        out.append((conv, gaps, *faults.values(), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, giant):
    rng = random.Random(seed)
    texts = ["Fine.", "Fine", "Yes!", "what?", " \n", "", None, "é ü.", "a.b", "long " * 3000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "usher"]
    rows = [(c, t * rng.choice([1, 1, 1, 3]) + 5, rng.choice(roles), f"{rng.choice(texts) or ''}{rng.choice(['', '', t])}" if rng.random() < 0.9 else rng.choice(texts))
            for c in [None, *range(40)] for t in range(rng.randint(1, 9))]
    rows += [(c, None, "user", "Hello.") for c in (3, 3, 4)] + [(2000, 1, "user", "Hi.")] * 7 + [(2001, t, "user", None) for t in range(3)]
    rows += [(77, t, "user" if t % 2 else "assistant", "Same answer." if t % 3 else f"Answer {t}{rng.choice('.!,')}") for t in range(giant)]
    dropped = next(c for c in range(5000, 9000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (dropped, 0, "user", "Gone.")]


@pytest.mark.parametrize("partitions", [2, 24])
def test_repair_against_a_plain_one(spark, tmp_path, partitions):
    rows = conversations(partitions, 900)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, n int").write.parquet(f"{tmp_path}/conversations.parquet")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = co.op13_conversation_repair(spark, str(tmp_path)).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sorted((tuple(r) for r in got), key=repr) == plain_repair(rows)


def test_repair_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert co.op13_conversation_repair(spark, str(tmp_path)).count() == 0
