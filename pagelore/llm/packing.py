"""Cost-balanced packing of token sequences.

Documents are tokenized, closed with an end token and cut into full sequences and a tail.  The
tails of some thousands of documents are packed together: a tail costs a linear plus a quadratic
share of attention, and in descending order each goes to the cheapest sequence that still has
room.  What fits nowhere whole is cut to fill the cheapest gaps.  Packing happens where the
documents lie, so neither texts nor tokens are shuffled.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.llm.common import table

MAX_TOKENS = 2048
END_ID = 1
#: Documents packed together, and the weight of a squared token in the cost.
GROUP_DOCS = 4096
QUADRATIC = 1.0 / 1024
VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a worker remembers in each of two generations.
CACHE_WORDS = 700_000
#: Words that are tokenized in one call.
CALL_WORDS = 2000
#: Marks that are a token of their own behind an ASCII letter.
MARKS = b".,;:!?"
LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Words of printable ASCII and Latin-1 letters, which no normal form changes, and what the vocabulary's pre-tokenizer cuts them into.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: Pieces of marks and digits whose ids are remembered.
CACHE_PIECES = 10_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordCache:
    """Ids of texts, by words: this vocabulary never joins what white space parts, so a word's ids are its own.

    ``ids(text)`` is what the tokenizer gives for the whole text, as packed 16-bit numbers.  Spellings with the
    same ids are tokenized once: this vocabulary lowers ASCII words, and parts a letter from a mark behind it.
    Plain words are cut into its pieces here and go straight to its model, all others through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]  # these are matched as spelled
        self.byte_letters = {ord(c): "".join(b for b, _ in byte_level.pre_tokenize_str(c)) for c in map(chr, range(0xC0, 0x100))}
        self.pieces: dict[str, bytes] = {}
        self.marks = {m: np.array(self.tokenizer.encode(chr(m), add_special_tokens=False).ids, dtype="<u2").tobytes() for m in MARKS}

    def _find(self, missing: list[bytes]) -> None:
        """Fills ``young`` for words that are in neither generation."""
        young, old, spelled, plain = self.young, self.old, [], {}
        for w in missing:
            mark = b""
            core = w
            if len(w) > 1 and w[-1] in MARKS and w[-2] in LETTERS:
                mark, core = self.marks[w[-1]], w[:-1]
            if core.isascii() and not any(t in core.lower() for t in self.added):
                core = core.lower()
            if core != w:
                spelled.append((w, core, mark))
            if core not in young:
                if core in old:
                    young[core] = old[core]
                else:
                    plain[core] = None
        self._learn(list(plain))
        for w, core, mark in spelled:
            young[w] = young[core] + mark

    def _piece(self, piece: str) -> bytes:
        known = self.pieces.get(piece)
        if known is None:
            spelled = piece if piece.isascii() else piece.translate(self.byte_letters)
            ids = [t.id for t in self.model.tokenize(spelled)]
            known = struct.pack(f"<{len(ids)}H", *ids)
            if not piece[0].isalpha():
                if len(self.pieces) >= CACHE_PIECES:
                    self.pieces.clear()
                self.pieces[piece] = known
        return known

    def _learn(self, words: list[bytes]) -> None:
        others = []
        for w in words:
            text = w.decode("utf-8", "replace")
            if PLAIN.fullmatch(text) and "<|" not in text:  # added tokens begin so
                self.young[w] = b"".join(map(self._piece, PIECES.findall(text.lower())))
            else:
                others.append((w, text))
        for at in range(0, len(others), CALL_WORDS):
            some = others[at : at + CALL_WORDS]
            texts = [t for _, t in some]
            found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
            first = np.fromiter((a for a, _ in found.offsets), dtype=np.int64, count=len(found.ids))
            edges = (2 * np.searchsorted(first, np.r_[starts, starts[-1] + len(texts[-1]) + 1])).tolist()
            ids = np.array(found.ids, dtype="<u2").tobytes()
            for (w, _), a, b in zip(some, edges, edges[1:], strict=False):
                self.young[w] = ids[a:b]

    def ids(self, text: str | None) -> bytes:
        words = (text or "").encode("utf-8", "replace").split()
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = {w: None for w in words if w not in young}
        for w in [w for w in missing if w in old]:
            young[w] = old[w]
            del missing[w]
        if missing:
            self._find(list(missing))
        return b"".join(map(young.__getitem__, words))


@lru_cache(maxsize=1)
def worker_cache(path: str) -> WordCache:
    """One cache for all tasks that a worker runs."""
    return WordCache(path)


def balance(lengths: np.ndarray, capacity: int = MAX_TOKENS, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) that place each length in full, in as few sequences as can hold them."""
    n = -(-int(lengths.sum()) // capacity)
    cost, room, placed, left = np.zeros(n), np.full(n, capacity), [], []

    def put(doc: int, start: int, length: int, at: int) -> None:
        placed.append((doc, start, length, at, int(capacity - room[at])))
        room[at] -= length
        cost[at] += length + quadratic * length * length

    for doc in np.lexsort((np.arange(len(lengths)), -lengths)):
        at = int(np.argmin(np.where(room >= lengths[doc], cost, np.inf)))
        if room[at] >= lengths[doc]:
            put(int(doc), 0, int(lengths[doc]), at)
        else:
            left.append(int(doc))
    for doc in left:
        start = 0
        while start < lengths[doc]:
            at = int(np.argmin(np.where(room > 0, cost, np.inf)))
            length = int(min(room[at], lengths[doc] - start))
            put(doc, start, length, at)
            start += length
    return placed


SPANS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS, group_docs: int = GROUP_DOCS, with_ids: bool = False) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence.

    ``ids_crc32`` is the checksum of the piece's ids as little-endian 32-bit numbers; ``with_ids`` adds
    the ids.  Null and empty texts have the end token alone.  Equal rows are separate documents; a null
    id stays null.  ``sequence_id`` is unique and fixed for the same input splits.  Only ``doc_id`` and
    ``text`` are read; an empty table gives no rows.
    """
    path = path or vocabulary_path()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = worker_cache(path)
        sequence = TaskContext.get().partitionId() << 32
        out: list[tuple] = []
        tails: list[tuple] = []

        def emit(doc, start: int, ids: np.ndarray, tokens: int, at: int, offset: int) -> None:
            wide = ids.astype("<u4")
            out.append((doc, start, len(ids), zlib.crc32(wide.tobytes()), tokens, at, offset, *([wide.tolist()] if with_ids else [])))

        def flush() -> None:
            nonlocal sequence
            if tails:
                spans = balance(np.array([len(t[1]) for t in tails]), max_tokens)
                for d, start, length, at, offset in spans:
                    doc, ids, before, tokens = tails[d]
                    emit(doc, before + start, ids[start : start + length], tokens, sequence + at, offset)
                sequence += 1 + max(s[3] for s in spans)
                tails.clear()

        def frame_of(rows: list[tuple]) -> pd.DataFrame:
            frame = pd.DataFrame(rows, columns=names)
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            return frame

        for frame in frames:
            for doc, text in zip(frame.doc_id, frame.text, strict=True):
                doc = None if pd.isna(doc) else int(doc)
                ids = np.r_[np.frombuffer(cache.ids(text), dtype="<u2"), np.array([END_ID], dtype="<u2")]
                full = len(ids) // max_tokens * max_tokens
                for at in range(0, full, max_tokens):
                    emit(doc, at, ids[at : at + max_tokens], len(ids), sequence, 0)
                    sequence += 1
                if full < len(ids):
                    tails.append((doc, ids[full:], full, len(ids)))
                if len(tails) >= group_docs:
                    flush()
                if len(out) >= 20_000:
                    yield frame_of(out)
                    out = []
        flush()
        if out:
            yield frame_of(out)

    schema = SPANS + (", ids array<long>" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, schema)


def op7_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op7_cost_balanced_packing": op7_cost_balanced_packing}
