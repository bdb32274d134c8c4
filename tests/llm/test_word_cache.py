from __future__ import annotations

import random

import numpy as np

from pagelore.llm import packing


def test_spellings_with_the_same_ids_are_tokenized_once():
    cache, asked = packing.WordCache(packing.vocabulary_path()), []
    learn = cache._learn
    cache._learn = lambda words: (asked.extend(words), learn(words))
    cache.ids("Word word, WORD word! wOrD? éWord éword,")
    assert sorted(asked) == sorted([b"word", "éWord".encode(), "éword".encode()])


def test_spellings_give_the_ids_of_the_whole_text(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    cache = packing.WordCache(packing.vocabulary_path())
    rng = random.Random(8)
    letters = "abABsStTzZ'.,;:!?H̱́éÉß漢İΣς12 \n"
    texts = ["<|ENDOFTEXT|> <|endoftext|>, x<|EndOfText|>Y, Y<|endoftext|>y!", "IT'S It's, can'T! A. a.. É, H̱, ẖ", ", . A", "O'Re,"]
    texts += ["".join(rng.choice(letters) for _ in range(60)) for _ in range(400)]
    for text in texts:
        assert np.frombuffer(cache.ids(text), "<u2").tolist() == cache.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_plain_words_do_not_need_the_whole_tokenizer(monkeypatch):
    cache = packing.WordCache(packing.vocabulary_path())
    whole, asked = cache.tokenizer, []

    class Counted:
        def encode(self, text, **options):
            asked.append(text)
            return whole.encode(text, **options)

    cache.tokenizer = Counted()
    monkeypatch.setattr(packing, "CACHE_PIECES", 20)
    rng = random.Random(9)
    plain = "".join(map(chr, range(33, 127))) + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
    texts = ["Eton&&& l'ÉTÉ, It's 'tis 're''ll \"Ça\" naïve-ß 12é3 a'<|b", " ".join(plain)]
    texts += ["".join(rng.choice(plain + "  ''aeéÉst") for _ in range(80)) for _ in range(500)]
    for text in texts:
        assert np.frombuffer(cache.ids(text), "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
    assert all("<|" in text for text in asked) and asked
