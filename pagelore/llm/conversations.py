"""Repair of conversation structure by run-length dynamic programming.

Rows are damaged by a seeded rule, judged (blank, duplicate, truncated) and written as symbols of role and
fault.  Equal symbols in a row are one run.  A run acts on the four states of ``(s?(ua)+)?`` as a power of a
4 x 4 min-plus transition; powers of two are computed once and cached, so a run costs its logarithm.  The
cheapest edits are unrolled from the cost-to-go at the run's ends, halving runs by the same powers.

Shape of the job: faults and duplicates are columns and pre-aggregated joins on (conversation, role, md5), so a
message that repeats is no hot group.  Symbols, without texts, are dealt out by range of conversation and turn; a long
conversation is several pieces.  A piece is one min-plus matrix; only the first and the last conversation of a partition
can be cut, so two small rows a partition carry the states over the cuts.  Texts join the kept rows
afterwards and stream through the digest in order.  A digest is a chain, so the texts of one conversation pass
through one task, a batch at a time.

Rows: a null role or text is one space, a null id is a conversation of its own, a null turn comes first; equal turns go by
role, then by md5 of the text; equal rows are kept together.  A role that starts with none of s, u, a fits nowhere.
Very long texts never enter the programme.  An empty table gives an empty result.  Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.llm.common import cut, own, table

SPACE = r"[\x20\x09-\x0D]"
INF = 1 << 60
#: States: nothing yet, after s, after u, after a.
STATES, START = 4, 0
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: What an inserted or reroled turn leads to, and its role; a kept one by its initial.
FILL = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
LEGAL = {"su", "ua", "au"}
#: A symbol is a role's initial (o for any other) and a fault: "" none, t truncated; "x" must go.
GONE = "x"

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]
Runs = tuple[tuple[str, int], ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(min(a[i][k] + b[k][j] for k in range(STATES)), INF) for j in range(STATES)) for i in range(STATES))


def act(m: Matrix, v: Vector) -> Vector:
    return tuple(min(min(m[i][k] + v[k] for k in range(STATES)), INF) for i in range(STATES))


def _closure() -> Matrix:
    """Cheapest insertions between two states."""
    rows = []
    for s in range(STATES):
        row, at, cost = [INF] * STATES, s, 0
        while row[at] == INF:
            row[at], at, cost = cost, FILL[at], cost + INSERT
        rows.append(tuple(row))
    return tuple(rows)


CLOSURE = _closure()
#: Cost to go when no row is left: the grammar ends with nothing or after an assistant turn.
END: Vector = act(CLOSURE, (0, INF, INF, 0))
UNIT: Matrix = tuple(tuple(0 if i == j else INF for j in range(STATES)) for i in range(STATES))


def edits(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done with a row, insertions apart, in ASCII order."""
    found = [("D", DELETE, state)]
    if symbol != GONE:
        extra = TRUNCATED if symbol.endswith("t") else 0
        if state in KEEP.get(symbol[0], {}):
            found.append(("K", extra, KEEP[symbol[0]][state]))
        found.append(("R", REROLE + extra, FILL[state]))
    return found


@lru_cache(maxsize=4096)
def power(symbol: str, j: int) -> Matrix:
    """Transition of 2^j equal rows."""
    if j:
        half = power(symbol, j - 1)
        return times(half, half)
    rows = []
    for s in range(STATES):
        row = [INF] * STATES
        for _, cost, to in edits(symbol, s):
            row[to] = min(row[to], cost)
        rows.append(tuple(row))
    return times(CLOSURE, tuple(rows))


def before(symbol: str, n: int, after: Vector) -> Vector:
    """Cost to go ahead of n equal rows."""
    for j in range(n.bit_length()):
        if n >> j & 1:
            after = act(power(symbol, j), after)
    return after


@lru_cache(maxsize=1 << 14)
def _unroll(symbol: str, n: int, after: Vector, state: int) -> tuple[str, int]:
    if n == 1:
        letters, now = "", before(symbol, 1, after)
        while True:
            for letter, cost, to in sorted([*edits(symbol, state), ("I", INSERT, FILL[state])]):
                if cost + (now if letter == "I" else after)[to] == now[state]:
                    break
            letters, state = letters + letter, to
            if letter != "I":
                return letters, state
    j = (n - 1).bit_length() - 1
    first, state = unroll(symbol, n - (1 << j), act(power(symbol, j), after), state)
    second, state = unroll(symbol, 1 << j, after, state)
    return first + second, state


def unroll(symbol: str, n: int, after: Vector, state: int) -> tuple[str, int]:
    """Edits of a run from a state, ASCII-least among the cheapest, and the state after it; equal halves are unrolled once."""
    low = min(after)
    return _unroll(symbol, n, tuple(min(x - low, INF) if x < INF else INF for x in after), state)


@lru_cache(maxsize=1 << 14)
def solve(runs: Runs, after: Vector = END, state: int = START, last: bool = True) -> tuple[str, int, int]:
    """(audit, end state, cost) of a piece of a conversation that begins in ``state`` and has ``after`` to go behind it."""
    ends = [after]
    for symbol, n in reversed(runs):
        ends.append(before(symbol, n, ends[-1]))
    total, audit = ends[-1][state] if runs else after[state], []
    for (symbol, n), behind in zip(runs, reversed(ends[:-1])):
        letters, state = unroll(symbol, n, behind, state)
        audit.append(letters)
    left = after[state]
    while last and state not in (0, 3):
        audit.append("I")
        state = FILL[state]
    return "".join(audit), state, total - (0 if last else left)


def matrix(runs: Runs) -> Matrix:
    whole = UNIT
    for symbol, n in runs:
        for j in range(n.bit_length()):
            if n >> j & 1:
                whole = times(whole, power(symbol, j))
    return whole


# --- rows ----------------------------------------------------------------------
def damage(rows: DataFrame) -> DataFrame:
    """``conv`` (id as text, empty for null), turn, role, text, copies: the rows that are left, by the seeded rule."""
    rows = own(rows, "conv_id", "turn", "role", "text")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return rows.withColumn("kind", kind).filter("kind != 0").select(
        F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.when(F.col("kind") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def judged(rows: DataFrame) -> DataFrame:
    """``conv``, ``turn``, ``role``, ``hash``, ``n``, ``fault`` of ``damage`` rows, equal ones as one row with their number.

    fault holds for the first of the n: blank, duplicate, truncated or none; the others are duplicates (or blank).
    """
    blank, ended = ~F.col("text").rlike(f"[^{SPACE[1:]}"), F.col("text").rlike(rf"[.!?]{SPACE}*\z")
    fault = F.when(blank, "blank").when(ended, "none").otherwise("truncated")
    groups = rows.select("conv", "turn", "role", F.md5("text").alias("hash"), fault.alias("fault"), "copies").groupBy(
        "conv", "turn", "role", "hash", "fault").agg(F.sum("copies").alias("n"))
    key = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = groups.groupBy("conv", "role", "hash").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("groups")).filter("groups > 1")
    repeat = F.col("first").isNotNull() & (F.col("first") != key) & (F.col("fault") != "blank")
    return groups.join(firsts, ["conv", "role", "hash"], "left").select(
        "conv", "turn", "role", "hash", "n", F.when(repeat, "duplicate").otherwise(F.col("fault")).alias("fault"))


# --- pieces ----------------------------------------------------------------------
class Piece:
    """The rows of one conversation that lie in one partition, in order."""

    def __init__(self, conv: str):
        self.conv, self.rows, self.runs = conv, [], []
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}

    def _run(self, symbol: str, n: int) -> None:
        if n and self.runs and self.runs[-1][0] == symbol:
            self.runs[-1] = (symbol, self.runs[-1][1] + n)
        elif n:
            self.runs.append((symbol, n))

    def add(self, turn: int | None, role: str, text_hash: str, n: int, fault: str) -> None:
        initial = role[:1] if role[:1] in KEEP else "o"
        self.count["illegal"] += n - 1 + (bool(self.rows) and self.rows[-1][0] + initial not in LEGAL)
        self.rows.append((initial, turn, role, text_hash, n))
        if fault in ("blank", "duplicate"):
            self.count[fault] += n
            self._run(GONE, n)
        else:
            self.count["truncated"] += fault == "truncated"
            self.count["duplicate"] += n - 1
            self._run(initial + ("t" if fault == "truncated" else ""), 1)
            self._run(GONE, n - 1)

    def lines(self, audit: str, state: int) -> Iterator[tuple]:
        """(turn, role, hash, role that stays) of every kept or inserted row; an inserted one has no hash."""
        rows = iter(self.rows)
        row, left = None, 0
        for letter in audit:
            if letter == "I":
                yield None, None, None, ROLE[state]
                state = FILL[state]
                continue
            if not left:
                row = next(rows)
                left = row[4]
            left -= 1
            if letter == "K":
                yield row[1], row[2], row[3], row[2]
                state = KEEP[row[0]][state]
            elif letter == "R":
                yield row[1], row[2], row[3], ROLE[state]
                state = FILL[state]


def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, Piece, bool]]:
    """(partition, piece, whether the conversation may go on in another partition) of sorted rows."""
    piece, first, seg = None, True, 0
    for frame in frames:
        for seg, conv, turn, role, text_hash, n, fault in zip(frame["seg"], frame["conv"], frame["turn"].astype(object), frame["role"], frame["hash"], frame["n"], frame["fault"]):
            if piece is None or conv != piece.conv:
                if piece is not None:
                    yield int(seg), piece, first
                    first = False
                piece = Piece(conv)
            piece.add(None if turn is None or turn != turn else int(turn), role, text_hash, int(n), fault)
    if piece is not None:
        yield int(seg), piece, True


def _edge_rows(ordered: DataFrame, schema: str, row: Callable[[int, Piece], tuple | None]) -> list:
    """A small row for each piece at an end of its partition: at most two a partition, so the driver may hold them."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [r for seg, piece, edge in pieces(frames) if edge for r in [row(seg, piece)] if r is not None]
        if found:
            yield pd.DataFrame(found, columns=names)

    return ordered.mapInPandas(run, schema).collect()


def carried(ordered: DataFrame) -> dict[tuple[str, int], tuple[int, Vector, bool, str]]:
    """(state before, cost to go behind, whether the last, last initial before) of each piece of a conversation that is cut."""
    found = _edge_rows(ordered, "conv string, seg long, matrix string, head string, tail string", lambda seg, p: (
        p.conv, seg, " ".join(str(x) for r in matrix(tuple(p.runs)) for x in r), p.rows[0][0], p.rows[-1][0]))
    parts = defaultdict(list)
    for r in found:
        flat = [int(x) for x in r.matrix.split()]
        parts[r.conv].append((r.seg, tuple(tuple(flat[STATES * i:STATES * i + STATES]) for i in range(STATES)), r.tail))
    chains = {conv: sorted(p) for conv, p in parts.items() if len({seg for seg, _, _ in p}) > 1}
    if not chains:
        return {}
    behind: dict[tuple[str, int], tuple[Vector, bool]] = {}
    for conv, chain in chains.items():
        v = END
        for seg, m, _ in reversed(chain):
            behind[conv, seg] = (v, v is END)
            v = act(m, v)

    def ends(seg: int, p: Piece) -> tuple | None:
        if (p.conv, seg) not in behind:
            return None
        after, last = behind[p.conv, seg]
        return p.conv, seg, " ".join(str(solve(tuple(p.runs), after, s, last)[1]) for s in range(STATES))

    reached = {(r.conv, r.seg): [int(x) for x in r.ends.split()] for r in _edge_rows(ordered, "conv string, seg long, ends string", ends)}
    out = {}
    for conv, chain in chains.items():
        state, tail = START, ""
        for seg, _, own_tail in chain:
            out[conv, seg] = (state, *behind[conv, seg], tail)
            state, tail = reached[conv, seg][state], own_tail
    return out


SOLVED = ("conv string, seg long, pos long, audit string, cost long, blank long, duplicate long, truncated long, illegal long, "
          "turn long, role string, hash string, kept_role string")


def solved(ordered: DataFrame) -> DataFrame:
    """For each piece a row with its counts and audit, and a row (``pos``) for each kept or inserted turn."""
    given = carried(ordered)
    names = [f.split()[0] for f in SOLVED.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []

        def frame() -> pd.DataFrame:
            made = pd.DataFrame(out, columns=names)
            return made.astype({c: "Int64" for c in ("pos", "cost", "blank", "duplicate", "truncated", "illegal", "turn")})

        for seg, piece, _ in pieces(frames):
            state, after, last, tail = given.get((piece.conv, seg), (START, END, True, ""))
            audit, _, cost = solve(tuple(piece.runs), after, state, last)
            c = piece.count
            crossing = int(bool(tail) and tail + piece.rows[0][0] not in LEGAL)
            out.append((piece.conv, seg, None, audit, cost, c["blank"], c["duplicate"], c["truncated"], c["illegal"] + crossing, None, None, None, None))
            for pos, line in enumerate(piece.lines(audit, state)):
                out.append((piece.conv, seg, pos, None, None, None, None, None, None, *line))
                if len(out) >= 50_000:
                    yield frame()
                    out.clear()
        if out:
            yield frame()

    return ordered.mapInPandas(run, SOLVED)


def digests(lines: DataFrame) -> DataFrame:
    """``conv``, ``repaired_sha256`` of lines (conv, seg, pos, line): joined by newlines, in order, a batch at a time."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state = None, None
        for frame in frames:
            done = []
            for name, line in zip(frame["conv"], frame["line"]):
                if name != conv:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = name, hashlib.sha256(line.encode())
                else:
                    state.update(b"\n" + line.encode())
            if done:
                yield pd.DataFrame(done, columns=["conv", "repaired_sha256"])
        if state is not None:
            yield pd.DataFrame([(conv, state.hexdigest())], columns=["conv", "repaired_sha256"])

    return lines.repartition("conv").sortWithinPartitions("conv", "seg", "pos").select("conv", "line").mapInPandas(run, "conv string, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row a conversation: conv, counts, cost, audit; the repaired turns: conv, seg, pos, role, text) of damaged rows."""
    flagged = judged(rows)
    order = [F.col("conv"), F.asc_nulls_first("turn"), F.col("role"), F.col("hash")]
    ordered = cut(flagged.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seg", F.spark_partition_id().cast("long")))
    found = cut(solved(ordered))
    ends = F.sort_array(F.collect_list(F.struct("seg", "audit")))  # a piece a partition at most
    counts = found.filter(F.col("pos").isNull()).groupBy("conv").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], F.array_join(F.transform(ends, lambda e: e["audit"]), "").alias("audit"))
    key = ["conv", "_turn", "role", "hash"]
    whole = F.coalesce(F.col("turn").cast("string"), F.lit(""))
    texts = rows.select("conv", whole.alias("_turn"), "role", F.md5("text").alias("hash"), "text").groupBy(*key).agg(F.first("text").alias("text"))
    kept = found.filter(F.col("pos").isNotNull()).select("conv", "seg", "pos", whole.alias("_turn"), "role", "hash", "kept_role")
    turns = kept.filter(F.col("hash").isNotNull()).join(texts, key).select("conv", "seg", "pos", F.col("kept_role").alias("role"), "text")
    filled = kept.filter(F.col("hash").isNull()).select("conv", "seg", "pos", F.col("kept_role").alias("role"), F.lit("").alias("text"))
    return counts, turns.unionByName(filled)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    rows = damage(conversations)
    counts, turns = repair(rows)
    hashes = digests(turns.select("conv", "seg", "pos", F.concat("role", F.lit(":"), "text").alias("line")))
    distinct = rows.filter(F.col("turn").isNotNull()).groupBy("conv", "turn").agg(F.lit(1).alias("_one"))
    gaps = distinct.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    every = conversations.select(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("conv")).distinct()
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(gaps, "conv", "left").join(counts, "conv", "left").join(hashes, "conv", "left").select(
        F.nullif("conv", F.lit("")).cast("long").alias("conv_id"), *[none(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


QUERIES = {"op13_conversation_repair": op13_conversation_repair}

_CRC = """xor(list_reduce(list_transform(range(1, length(name) + 1), lambda i: ord(substr(name, i::INT, 1))::BIGINT),
    lambda c, x: list_reduce(range(0, 8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(c, x)), 4294967295::BIGINT), 4294967295)"""


def _choice(letter: str, cost: str, to: int, line: str | None) -> str:
    rest = f"{line} || coalesce(chr(10) || b{to}.t, '')" if line else f"b{to}.t"
    return f"{{'c': {cost} + b{to}.c, 'a': '{letter}' || b{to}.a, 't': {rest}}}"


def _row(state: int) -> str:
    """Least (cost, audit) of what may be done with a row in a state, insertions apart."""
    options = [_choice("D", "4", state, None), _choice("R", "CASE WHEN gone THEN 1000000000 ELSE 3 + extra END", FILL[state], f"'{ROLE[state]}:' || text")]
    for initial, moves in KEEP.items():
        if state in moves:
            options.append(_choice("K", f"CASE WHEN gone OR initial != '{initial}' THEN 1000000000 ELSE extra END", moves[state], "role || ':' || text"))
    return f"list_min([{', '.join(options)}])"


def _filled(state: int, prefix: str) -> str:
    """The same with insertions ahead of the row."""
    options, at, letters, lines = [f"{prefix}{state}"], state, "", []
    for _ in range(3):
        lines.append(f"'{ROLE[at]}:'")
        at, letters = FILL[at], letters + "I"
        ahead = " || chr(10) || ".join(lines)
        options.append(f"{{'c': {3 * len(letters)} + {prefix}{at}.c, 'a': '{letters}' || {prefix}{at}.a, 't': {ahead} || coalesce(chr(10) || {prefix}{at}.t, '')}}")
    return f"list_min([{', '.join(options)}])"


_NO_ROW = ", ".join(f"{{'c': {0 if s in (0, 3) else 10 ** 9}, 'a': '', 't': NULL::VARCHAR}} AS e{s}" for s in range(STATES))

#: The plain programme, a row a step from the end, with cost, audit and text of each state; no runs, no powers.
ORACLE = {"op13_conversation_repair": f"""
WITH RECURSIVE named AS (
    SELECT coalesce(conv_id::VARCHAR, '') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
kinds AS (SELECT *, {_CRC} % 20 AS kind FROM named),
damaged AS (
    SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM kinds WHERE kind != 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(text), copy) AS place FROM damaged),
seen AS (
    SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY place) > 1 AS again, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
        NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS open, substr(role, 1, 1) AS initial,
        lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY place) AS ahead FROM placed),
faults AS (
    SELECT *, blank OR again AS gone, CASE WHEN open THEN 3 ELSE 0 END AS extra, place > 1 AND coalesce(ahead || initial, '') NOT IN ('su', 'ua', 'au') AS illegal FROM seen),
counts AS (
    SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
        count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (open AND NOT again AND NOT blank) AS truncated,
        count(*) FILTER (illegal) AS illegal, max(place) AS n FROM faults GROUP BY conv),
ends AS (SELECT {_NO_ROW}),
steps AS (
    SELECT conv, n + 1 AS place, {', '.join(f"{_filled(s, 'e')} AS b{s}" for s in range(STATES))} FROM counts, ends
    UNION ALL
    SELECT conv, place, {', '.join(f"{_filled(s, 'e')} AS b{s}" for s in range(STATES))} FROM (
        SELECT f.conv, f.place, {', '.join(f"{_row(s)} AS e{s}" for s in range(STATES))}
        FROM steps p JOIN faults f ON f.conv = p.conv AND f.place = p.place - 1))
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(s.b0.c, 0)::BIGINT AS cost,
    coalesce(s.b0.a, '') AS audit, sha256(coalesce(s.b0.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv = coalesce(o.conv_id::VARCHAR, '')
    LEFT JOIN steps s ON s.conv = c.conv AND s.place = 1
"""}
