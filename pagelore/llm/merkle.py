"""Merkle manifest of a dataset: build the trees, then let a recursive query climb from every leaf.

Leaves of a language form one binary tree, the subroots of the languages another one above them.  Built
levels are stored in the shared folder as node rows linked to a parent: a row has the hash, the siblings on
its way up to the parent (``STRIDE`` levels, a side and 32 bytes each) and the key of the parent.  A Spark
recursive query starts at the leaf rows and joins the parents' rows until no parent is left; on the way it appends
siblings and folds the hash of the leaf, tampered or not.  So the recursion takes depth / STRIDE steps.

Rows: a null in any column is hashed as ``-``; equal rows and equal ids are leaves of their own, one after the
other, by id (nulls first) and hash; an empty text is the value of no bytes.  An empty table has no root and gives
an empty result.  Columns other than doc_id, source, lang, n_chars and text are never read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.llm.common import cut, own, table
from pagelore.operators.running import number_rows
from pagelore.session import ensure_checkpoint_dir

#: Levels between a stored node and its parent row; a block is the 2^STRIDE nodes below one parent.
STRIDE = 10
#: Keys of the trees: a null language before the others, and the tree over the subroots.
NULL_TREE, LANG_TREE, ROOT_TREE = "0", "1", "root"
DIGEST = 32
#: Keys of a tree in a join with its leaves.
SALTS = 64

LINK = "sides string, siblings binary"


def digest(*columns: Column) -> Column:
    """H over columns: ``-`` for a null, else bytes, ``:`` and the value."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def of_tree(rows: DataFrame, trees: DataFrame, spread: str) -> DataFrame:
    """``rows`` with the columns of their tree; a tree with a large share of the rows is split by ``spread`` over ``SALTS`` keys."""
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    return salted.join(trees.withColumn("_salt", salts), ["tree", "_salt"]).drop("_salt")


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``tree``, ``leaf`` and ``tampered`` (null where nothing is tampered with) as 32 bytes."""
    docs = own(docs, "doc_id", "source", "lang", "n_chars", "text").withColumns(
        {"doc_id": F.col("doc_id").cast("long"), "n_chars": F.col("n_chars").cast("long")})
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tree = F.coalesce(F.concat(F.lit(LANG_TREE), F.col("lang")), F.lit(NULL_TREE))
    return docs.select("doc_id", tree.alias("tree"), F.unhex(digest(*fields)).alias("leaf"),
                       F.when(touched & F.col("n_chars").isNotNull(), F.unhex(digest(*changed))).alias("tampered"))


def climb_block(hashes: list[bytes], levels: int) -> tuple[list[tuple[str, bytes]], bytes]:
    """The way up of every node of one block, and the hash above them all.

    A way has one side a level: the sibling stands left (L) or right (R), or there is none (-, no bytes
    that count but ``DIGEST`` zeros, so that a level's bytes are found by position).
    """
    sides, siblings = [""] * len(hashes), [b""] * len(hashes)
    row = [h.hex() for h in hashes]
    for level in range(levels):
        raw = [bytes.fromhex(h) for h in row]
        for i in range(len(hashes)):
            at = (i >> level) ^ 1
            if at < len(raw):
                sides[i] += "L" if at < (i >> level) else "R"
                siblings[i] += raw[at]
            else:
                sides[i] += "-"
                siblings[i] += bytes(DIGEST)
        row = [hashlib.sha256("".join(row[k:k + 2]).encode()).hexdigest() for k in range(0, len(row), 2)]
    return list(zip(sides, siblings)), bytes.fromhex(row[0])


def linked(nodes: DataFrame, level: int, stride: int) -> DataFrame:
    """Node rows of one stored level with their way to the parent; the first row of a block has the parent's ``top`` hash.

    nodes: tree, idx, hash, depth (levels of the tree), and any other columns.  A block is at most 2^stride rows, which
    stream through a task block by block; no tree, however large, is in one task.
    """
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in nodes.schema.fields)}, {LINK}, top binary"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(block: pd.DataFrame) -> pd.DataFrame:
            ways, top = climb_block(list(block["hash"]), min(stride, int(block["depth"].iloc[0]) - level))
            return block.assign(sides=[s for s, _ in ways], siblings=[b for _, b in ways], top=[top] + [None] * (len(block) - 1))

        held: list[pd.DataFrame] = []
        for frame in frames:
            for _, part in frame.groupby(["tree", frame["idx"] // (1 << stride)], sort=False):
                if held and (held[0]["tree"].iloc[0], held[0]["idx"].iloc[0] >> stride) != (part["tree"].iloc[0], part["idx"].iloc[0] >> stride):
                    yield done(pd.concat(held, ignore_index=True))
                    held = []
                held.append(part)
        if held:
            yield done(pd.concat(held, ignore_index=True))

    block = F.shiftright("idx", stride)
    return nodes.repartition("tree", block).sortWithinPartitions("tree", "idx").mapInPandas(run, schema)


def _store(nodes: DataFrame, above: str | None, folder: str, name: str, levels: int, stride: int) -> list[str]:
    """Write the node rows of all levels; the folders, leaf level first.  A tree ends as node ``rank`` of the tree ``above``."""
    paths: list[str] = []
    for level in range(0, max(levels, 1), stride):
        last = F.col("depth") <= level + stride
        paths.append(f"{folder}/{name}-{level}")
        linked(nodes, level, stride).withColumns({
            "level": F.lit(level), "p_tree": F.when(last, F.lit(above).cast("string")).otherwise(F.col("tree")),
            "p_level": F.when(last, 0).otherwise(level + stride), "p_idx": F.when(last, F.col("rank")).otherwise(F.shiftright("idx", stride)),
            "subroot": F.when(last, F.col("top"))}).write.parquet(paths[-1])
        tops = nodes.sparkSession.read.parquet(paths[-1]).filter(F.col("top").isNotNull() & F.col("subroot").isNull())
        nodes = tops.select("tree", F.shiftright("idx", stride).alias("idx"), F.col("top").alias("hash"), "depth", "rank")
    return paths


def _subroots(spark: SparkSession, paths: list[str]) -> DataFrame:
    """What remains of each tree: tree, rank, subroot."""
    return reduce(DataFrame.unionByName, [spark.read.parquet(p).filter(F.col("subroot").isNotNull()).select("tree", "rank", "subroot") for p in paths])


def depth(n: Column) -> Column:
    """Levels above n leaves: while several nodes remain, pairs become one."""
    return F.length(F.regexp_replace(F.bin(n - 1), "^0$", ""))


FOLD = """aggregate(sequence(1, length({sides})), {start}, (acc, i) -> CASE WHEN length({sides}) = 0 THEN acc
    WHEN substring({sides}, i, 1) = 'L' THEN sha2(concat(lower(hex(substring({siblings}, {d} * i - {d} + 1, {d}))), acc), 256)
    WHEN substring({sides}, i, 1) = 'R' THEN sha2(concat(acc, lower(hex(substring({siblings}, {d} * i - {d} + 1, {d})))), 256)
    ELSE sha2(acc, 256) END)"""


def fold(sides: str, siblings: str, start: str) -> str:
    """SQL that carries a hash up a stored way."""
    return f"if(length({sides}) = 0, {start}, {FOLD.format(sides=sides, siblings=siblings, start=start, d=DIGEST)})"


def climb(spark: SparkSession, leaf_path: str, node_paths: list[str]) -> DataFrame:
    """``doc_id``, ``tree``, ``leaf``, ``folded``, ``sides``, ``siblings`` of every leaf at the root, by a recursive query."""
    tag = uuid.uuid4().hex
    spark.read.parquet(leaf_path).createOrReplaceTempView(f"leaf_{tag}")
    node_columns = ["tree", "level", "idx", "sides", "siblings", "p_tree", "p_level", "p_idx"]
    above = [spark.read.parquet(p).select(*node_columns) for p in node_paths]
    reduce(DataFrame.unionByName, above).createOrReplaceTempView(f"node_{tag}")
    query = f"""
        WITH RECURSIVE climb(doc_id, tree, leaf, folded, sides, siblings, p_tree, p_level, p_idx) AS (
            SELECT doc_id, tree, hash, {fold('sides', 'siblings', 'lower(hex(coalesce(tampered, hash)))')}, sides, siblings, p_tree, p_level, p_idx
            FROM leaf_{tag}
            UNION ALL
            SELECT c.doc_id, c.tree, c.leaf, {fold('n.sides', 'n.siblings', 'c.folded')}, concat(c.sides, n.sides),
                   concat(c.siblings, n.siblings), n.p_tree, n.p_level, n.p_idx
            FROM climb c JOIN node_{tag} n ON c.p_tree = n.tree AND c.p_level = n.level AND c.p_idx = n.idx)
        SELECT doc_id, tree, leaf, folded, sides, siblings FROM climb WHERE p_tree IS NULL"""
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # every leaf climbs, whatever their number; the caller's setting comes back
    try:
        proof = F.expr(f"""sha2(array_join(transform(filter(sequence(1, greatest(length(sides), 1)), i -> substring(sides, i, 1) IN ('L', 'R')),
            i -> lower(hex(substring(siblings, {DIGEST} * i - {DIGEST} + 1, {DIGEST})))), ''), 256)""")
        return cut(spark.sql(query).select("doc_id", "tree", "leaf", F.unhex("folded").alias("folded"), F.unhex(proof).alias("proof")))
    finally:
        spark.conf.set(limit, before)


def manifest(docs: DataFrame, stride: int = STRIDE) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified`` of every row of ``docs``."""
    spark = docs.sparkSession
    out = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    hashed = cut(leaves(docs))
    trees = hashed.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    trees = cut(number_rows(trees, "tree", "rank").withColumns({"rank": F.col("rank") - 1, "depth": depth(F.col("n"))}))
    known = trees.agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n")).first()
    if not known.n:
        return spark.createDataFrame([], out)
    folder = f"{ensure_checkpoint_dir(spark)}/merkle-{uuid.uuid4().hex}"

    numbered = number_rows(hashed.withColumn("_tie", F.monotonically_increasing_id()), ["tree", "doc_id", "leaf", "_tie"], "no").drop("_tie")
    starts = numbered.groupBy("tree").agg(F.min("no").alias("first"))
    placed = of_tree(numbered, starts.join(trees.select("tree", "depth", "rank"), "tree"), "no").select(
        "tree", (F.col("no") - F.col("first")).alias("idx"), F.col("leaf").alias("hash"), "depth", "rank", "doc_id", "tampered")
    lower = _store(placed, ROOT_TREE, folder, "lang", known.depth, stride)
    tops = _subroots(spark, lower)
    upper_depth = (known.n - 1).bit_length()
    subroots = tops.select(F.lit(ROOT_TREE).alias("tree"), F.col("rank").alias("idx"), F.col("subroot").alias("hash"),
                           F.lit(upper_depth).alias("depth"), F.lit(0).cast("long").alias("rank"))
    upper = _store(subroots, None, folder, "root", upper_depth, stride)
    root = F.lit(_subroots(spark, upper).first().subroot.hex())  # one digest

    climbed = climb(spark, lower[0], lower[1:] + upper)
    text = lambda c: F.lower(F.hex(c))
    return of_tree(climbed, tops.select("tree", "subroot"), "proof").select(
        "doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), root.alias("root"), text("proof").alias("proof_sha256"),
        text("folded").alias("folded_root"), (text("folded") == root).alias("verified"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}


def _h(*values: str) -> str:
    parts = [f"coalesce(octet_length(encode({v}))::VARCHAR || ':' || {v}, '-')" for v in values]
    return f"sha256({' || '.join(parts)})"


#: The same by levels: all nodes of a level from the pairs of the one below, then a climb of one level a step.
ORACLE = {"op12_merkle_manifest": f"""
WITH RECURSIVE bytes AS (
    SELECT doc_id, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT) AS b FROM (SELECT DISTINCT doc_id FROM documents)),
crc AS (
    SELECT doc_id, xor(list_reduce(b, lambda c, x: list_reduce(range(0, 8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(c, x)), 4294967295::BIGINT), 4294967295) AS crc FROM bytes),
leaf AS (
    SELECT d.doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS tree,
        {_h('doc_id::VARCHAR', 'source', 'lang', 'n_chars::VARCHAR', 'text')} AS leaf,
        CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL THEN {_h('doc_id::VARCHAR', 'source', 'lang', '(n_chars + 1)::VARCHAR', 'text')} END AS tampered
    FROM (SELECT d.*, c.crc FROM documents d LEFT JOIN crc c USING (doc_id)) d),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaf),
built AS (
    SELECT tree, 0 AS level, idx, leaf AS h, n FROM placed
    UNION ALL
    SELECT tree, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 1) // 2 FROM built WHERE n > 1 GROUP BY tree, level, idx // 2),
subroots AS (SELECT tree, level AS depth, h AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS rank, count(*) OVER () AS n FROM built WHERE n = 1),
roots AS (
    SELECT 0 AS level, rank AS idx, subroot AS h, n FROM subroots
    UNION ALL
    SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 1) // 2 FROM roots WHERE n > 1 GROUP BY level, idx // 2),
nodes AS (SELECT tree, level, idx, h, n FROM built UNION ALL SELECT 'root', level, idx, h, n FROM roots),
climb AS (
    SELECT p.doc_id, p.leaf, p.tree AS home, p.idx AS place, p.tree, 0 AS level, p.idx, coalesce(p.tampered, p.leaf) AS folded, '' AS proof FROM placed p
    UNION ALL
    SELECT c.doc_id, c.leaf, c.home, c.place, CASE WHEN s.n = 1 THEN 'root' ELSE c.tree END, CASE WHEN s.n = 1 THEN 0 ELSE c.level + 1 END,
        CASE WHEN s.n = 1 THEN r.rank ELSE c.idx // 2 END,
        CASE WHEN s.n = 1 THEN c.folded WHEN o.h IS NULL THEN sha256(c.folded) WHEN o.idx < c.idx THEN sha256(o.h || c.folded) ELSE sha256(c.folded || o.h) END,
        c.proof || CASE WHEN s.n = 1 THEN '' ELSE coalesce(o.h, '') END
    FROM climb c JOIN nodes s ON s.tree = c.tree AND s.level = c.level AND s.idx = c.idx
        LEFT JOIN nodes o ON o.tree = c.tree AND o.level = c.level AND o.idx = xor(c.idx, 1)
        LEFT JOIN subroots r ON r.tree = c.tree
    WHERE NOT (c.tree = 'root' AND s.n = 1))
SELECT c.doc_id, c.leaf, s.subroot, t.h AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = t.h AS verified
FROM climb c JOIN subroots s ON s.tree = c.home JOIN roots t ON t.n = 1 AND c.tree = 'root' AND c.level = t.level
"""}
