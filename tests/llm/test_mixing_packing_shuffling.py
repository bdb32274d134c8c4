from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from pagelore.llm import mixing, packing, shuffling
from pagelore.llm.perplexity import base_statistics

from . import samples


def filled(sizes: dict, cycle=(1, 2, 3), cap=3.0) -> dict:
    """Shares by weight, sources above their cap stopped one round after another."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:
        left = sum(sizes.values()) - sum(cap * sizes[s] for s in names if s not in open_)
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s] + 1e-9}
        if not over:
            return {**{s: cap * sizes[s] for s in names if s not in open_}, **share}
        open_ -= over
        if not open_:
            return {s: cap * sizes[s] for s in names}


def test_mix_meets_targets_and_reruns_agree(spark):
    docs = samples.docs(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(3)).collect()))
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in got:
        assert r["size"] == base_statistics(r.text)[0]  # the input's own size column gave way
        assert r.taken % max(r["size"], 1) == 0 and r.taken <= 3 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    want = filled(dict(sizes))
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    for s, goal in want.items():
        assert abs(taken[s] - goal) <= largest[s] / 2 + 1


def test_epochs_come_first_and_weights_matter(spark):
    docs = spark.createDataFrame([(i, "a b c d", "x" if i < 5 else "y") for i in range(50)], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    x = sorted(r.copies for r in got if r.source == "x")
    assert x == [3] * 5  # a third of the total is more than three times its size
    lowered = mixing.mix(docs, weight=mixing.F.when(mixing.F.col("doc_id") % 2 == 0, 1.0).otherwise(1e-6)).filter("source = 'y' and copies = 0").collect()
    assert all(r.doc_id % 2 for r in lowered)


def test_mix_of_nothing(spark):
    assert mixing.mix(samples.none(spark)).count() == 0
    assert mixing.mixed_rows(samples.docs(spark, [(1, None, None, None, None, 1, "", "")])).columns == samples.docs(spark).columns


def test_shuffle_deals_rows_evenly(spark):
    docs = samples.docs(spark)
    for bucket in (1 << 30, 3000):
        got = shuffling.external_shuffle(docs, bucket_bytes=bucket).collect()
        assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted((r.doc_id or -1, r.text or "") for r in docs.collect())
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        n = [len(slots[k]) for k in range(16)]
        assert max(n) - min(n) <= 1
        again = shuffling.external_shuffle(docs.repartition(5), bucket_bytes=bucket).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert shuffling.external_shuffle(samples.none(spark)).count() == 0


def test_shuffle_is_no_order_of_ids(spark):
    docs = spark.range(400).selectExpr("id doc_id", "cast(id as string) text")
    place = {r.doc_id: r.slot * 16 + r.shard for r in shuffling.external_shuffle(docs, bucket_bytes=700).collect()}
    order = np.array([place[i] for i in range(400)])
    assert sorted(order) == list(range(400)) and abs(np.corrcoef(order, np.arange(400))[0, 1]) < 0.2


def test_word_cache_is_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer, cache = Tokenizer.from_file(packing.vocabulary_path()), packing.WordCache(packing.vocabulary_path())
    rng = random.Random(3)
    letters = "ab cdéß漢😀'.,<|>\n\t 12İ\u0301\u00a0\u2009sStTendoftext"
    texts = ["it's <|endoftext|> x<|startoftext|>y", *("".join(rng.choice(letters) for _ in range(80)) for _ in range(300))]
    for text in texts:
        assert np.frombuffer(cache.ids(text), "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    docs = samples.docs(spark)
    got = packing.pack(docs.coalesce(1), with_ids=True).collect()
    want = Counter()
    for r in docs.collect():
        want[r.doc_id, tuple([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1])] += 1
    assert sum(len(r.ids) for r in got) == sum(len(k[1]) * n for k, n in want.items())
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.MAX_TOKENS
    assert len(sequences) == -(-sum(len(k[1]) * n for k, n in want.items()) // packing.MAX_TOKENS)
    for (doc, ids), n in want.items():
        if n == 1 and doc is not None:
            joined = [x for r in sorted(pieces[doc], key=lambda r: r.start) for x in r.ids]
            assert joined == list(ids) and all(r.doc_tokens == len(ids) for r in pieces[doc])
    assert packing.pack(samples.none(spark)).count() == 0


def test_balance_evens_the_cost():
    lengths = np.random.default_rng(5).integers(1, 500, 400)
    spans = packing.balance(lengths, 2048)
    cost, fill = Counter(), Counter()
    for _, _, length, at, _ in spans:
        cost[at] += length + packing.QUADRATIC * length**2
        fill[at] += length
    assert max(fill.values()) <= 2048 and len(fill) == -(-lengths.sum() // 2048)
    assert max(cost.values()) < 1.1 * np.mean(list(cost.values()))
