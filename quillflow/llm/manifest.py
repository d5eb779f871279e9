"""Merkle manifest of a table: one tree per group, one tree over the groups' roots.

Rows are leaves, numbered by their order inside the group. A level is built by sibling-shift self-joins:
every node is joined with the nodes whose index is computed from its own (its XOR 1 in a binary tree, the
other slots of its run otherwise), and the rows of slot zero emit the parents. Nodes of all groups climb
together, keyed by (group, index), so a group that holds most rows is spread like any other.

Proofs come down the same tables: a node's proof is its run's other digests followed by its parent's
proof, so all levels together handle about two rows per leaf and not one per leaf and level. Every level is
written, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
WIDTH = 32  # bytes of a digest


def field(value: Column) -> Column:
    """A value as the leaves spell it: `-` for null, else its length in UTF-8 bytes, a colon, and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _join_digests(digests: Column) -> Column:
    """Digests in one binary value, in order."""
    return F.aggregate(digests, F.unhex(F.lit("")), lambda total, d: F.concat(total, d))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds `idx`, the place of a row in its group (from 0), and `n`, the group's rows.

    One distributed sort; after it only a count per sorted partition and group is added up. Rows that are
    equal in all of `order` are told apart by where they were read, so that many of them can be split.
    """
    placed = rows.withColumn("_read", F.monotonically_increasing_id()).orderBy(group, *order, "_read").drop("_read")
    placed = written(placed.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33).alias("_part")
    stretches = placed.groupBy(F.col(group), part).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    line = Window.partitionBy(group).orderBy("_part")
    stretches = written(stretches.select(
        group, "_part", "_first",
        (F.sum("_rows").over(line) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(group)).alias("n")), "stretches")
    joined = placed.withColumn("_part", part).join(stretches, [group, "_part"])
    return joined.select(
        *rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("idx"), "n")


def _level(nodes: DataFrame, fanout: int, keep: list[str]) -> DataFrame:
    """Nodes (key, idx, n, h) with the other digests of their run; rows of slot zero also hold the parent's digest."""
    slot = F.pmod("idx", F.lit(fanout))
    joined = nodes
    for shift in range(1, fanout):
        beside = F.col("idx").bitwiseXOR(F.lit(1)) if fanout == 2 else (
            F.col("idx") - slot + F.pmod(slot - shift, F.lit(fanout)))
        # The node at `idx` is told to the one that finds it `shift` slots further on.
        told = nodes.select("key", beside.alias("idx"), F.col("h").alias(f"_h{shift}"))
        joined = joined.join(told, ["key", "idx"], "left")
    after = F.array(*[F.col(f"_h{shift}") for shift in range(1, fanout)])
    left, right = F.slice(after, F.lit(fanout) - slot, slot), F.slice(after, F.lit(1), F.lit(fanout - 1) - slot)
    others = _join_digests(F.array_compact(F.concat(left, right)))
    level = joined.select(*keep, "key", "idx", "n", "h", slot.cast("int").alias("slot"), others.alias("others"))
    up = F.unhex(F.sha2(_hex(F.concat("h", "others")), 256))
    return level.withColumn("up", F.when(F.col("slot") == 0, up))


def climb(leaves: DataFrame, fanout: int = 2) -> tuple[list[DataFrame], DataFrame]:
    """The levels below the roots, and the roots (key, height, h), of the trees over leaves (key, idx, n, h, ...).

    Trees of any size climb side by side; a tree that is down to one node has its root and leaves.
    """
    keep = [c for c in leaves.columns if c not in ("key", "idx", "n", "h")]
    most = leaves.agg(F.max("n")).first()[0] or 0
    roots = [leaves.where("n = 1").select("key", F.lit(0).alias("height"), "h")]
    nodes, levels = leaves.where("n > 1"), []
    while most > 1:
        level = written(_level(nodes, fanout, [] if levels else keep), f"level-{len(levels)}")
        levels.append(level)
        parents = level.where("slot = 0").select(
            "key", F.floor(F.col("idx") / fanout).alias("idx"), F.ceil(F.col("n") / fanout).alias("n"), F.col("up").alias("h"))
        roots.append(parents.where("n = 1").select("key", F.lit(len(levels)).alias("height"), "h"))
        nodes = parents.where("n > 1")
        most = -(-most // fanout)
    every = roots[0]
    for more in roots[1:]:
        every = every.unionByName(more)
    return levels, written(every, "roots")


PATH = "array<struct<slot:int,others:binary>>"


def descend(levels: list[DataFrame], roots: DataFrame, fanout: int, carry: list[str]) -> DataFrame:
    """The leaves that have siblings or parents, each with its `path`: steps (slot, others) from itself to the top.

    `roots` are (key, height, path, ...): `path` leads on from a tree's root, and the columns `carry` are
    handed to all its leaves.
    """
    known = None
    for height in range(len(levels) - 1, -1, -1):
        level = levels[height]
        above = roots.where(F.col("height") == height + 1).select("key", F.lit(0).cast("long").alias("_up"), F.col("path").alias("_path"), *carry)
        if known is not None:
            above = above.unionByName(known)
        step = F.struct("slot", "others")
        own = [c for c in level.columns if c not in ("n", "up", "slot", "others")]
        here = level.withColumn("_up", F.floor(F.col("idx") / fanout)).join(above, ["key", "_up"]).select(
            *own, F.concat(F.array(step).cast(PATH), "_path").alias("path"), *carry)
        if height:
            known = written(here.select("key", F.col("idx").alias("_up"), F.col("path").alias("_path"), *carry), f"paths-{height}")
        else:
            known = here
    return known


def folded(leaf: Column, path: Column) -> Column:
    """Digest (hex) at the top, from a leaf (hex) and its path."""
    def up(h: Column, step: Column) -> Column:
        cut = step["slot"] * WIDTH
        left, right = F.substr(step["others"], F.lit(1), cut), F.substr(step["others"], cut + 1)
        return F.sha2(F.concat(_hex(left), h, _hex(right)), 256)

    return F.aggregate(path, leaf, up)


def manifest(documents: DataFrame, fanout: int = 2, tampered: Column | None = None, n_chars: Column | None = None) -> DataFrame:
    """doc_id, leaf, forged, subroot, root (hex) and `path` of every row.

    Leaves are rows of FIELDS. Trees go by `lang`, null first, then in order of UTF-8 bytes; a null lang is a
    group of its own. Inside a group rows ascend by doc_id (null first); rows of one doc_id follow by their
    digest, and equal rows are interchangeable. Null, empty and long texts are values like any other. Where
    `tampered` holds, `forged` is the digest with `n_chars` in place of the stored one, else it is the leaf.
    An empty table has no rows and no root. Other columns are ignored.
    """
    values = {c: F.col(c) for c in FIELDS}
    leaf = row_digest(list(values.values()))
    changed = row_digest([n_chars if c == "n_chars" and n_chars is not None else v for c, v in values.items()])
    hit = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    # The key sorts like the language and is never null.
    key = F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0"))
    rows = documents.select(key.alias("key"), "doc_id", leaf.alias("h"), F.when(hit, changed).alias("forged"))
    leaves = written(numbered(rows, "key", ["doc_id", "h"]), "leaves")
    levels, roots = climb(leaves, fanout)

    over = numbered(roots.select(F.lit("").alias("all"), "key", "height", "h"), "all", ["key"])
    tops = written(over.select(
        F.col("all").alias("key"), F.col("key").alias("group"), "height", "idx", "n", "h"), "tops")
    top_levels, top = climb(tops, fanout)
    end = F.array().cast(PATH)
    root = top.select(_hex(F.col("h")).alias("root")).first()
    root = root["root"] if root else None
    led = tops.where("n = 1").select("group", F.col("height").alias("height"), "h", end.alias("path"))
    if top_levels:
        more = descend(top_levels, top.withColumn("path", end), fanout, [])
        led = led.unionByName(more.select("group", "height", "h", "path"))
    starts = written(led.select(F.col("group").alias("key"), "height", "path", F.col("h").alias("subroot")), "starts")

    wanted = ["doc_id", "h", "forged", "path", "subroot"]
    alone = leaves.where("n = 1").join(starts, "key").select(*wanted)
    done = alone.unionByName(descend(levels, starts, fanout, ["subroot"]).select(*wanted)) if levels else alone
    return done.select(
        "doc_id", _hex(F.col("h")).alias("leaf"), _hex(F.coalesce("forged", "h")).alias("forged"),
        _hex(F.col("subroot")).alias("subroot"), F.lit(root).cast("string").alias("root"), "path")


def digests(documents: DataFrame) -> DataFrame:
    """The manifest with every row checked: rows whose doc_id's crc32 is divisible by 7 have been tampered with."""
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    rows = manifest(documents, tampered=hit, n_chars=F.col("n_chars") + 1)
    siblings = F.aggregate("path", F.lit(""), lambda total, step: F.concat(total, _hex(step["others"])))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
        folded(F.col("forged"), F.col("path")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


# Digests by aggregates and a recursive climb; crc32 is spelled out byte by byte with its usual polynomial.
ORACLE = """
WITH RECURSIVE
crc_step(v, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL
  SELECT v, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM crc_step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY v) AS t FROM crc_step WHERE k = 8),
rows AS (
  SELECT d.*, xor(list_reduce(
      list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AS hit
  FROM documents d, crc_table),
spelled AS (
  SELECT doc_id, lang, hit,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS size,
    coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS forged_size,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM rows),
hashed AS (
  SELECT doc_id, lang, sha256(head || size || tail) AS leaf,
    sha256(head || CASE WHEN hit THEN forged_size ELSE size END || tail) AS forged
  FROM spelled),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY lang) AS n, coalesce('1' || lang, '0') AS k
  FROM hashed),
nodes(k, height, idx, n, h) AS (
  SELECT k, 0, idx, n, leaf FROM leaves
  UNION ALL
  SELECT k, height + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY k, height, idx // 2, n),
subroots AS (
  SELECT k, height, h, row_number() OVER (ORDER BY k) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
over(height, idx, n, h) AS (
  SELECT 0, idx, n, h FROM subroots
  UNION ALL
  SELECT height + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx))
  FROM over WHERE n > 1 GROUP BY height, idx // 2, n),
tops AS (SELECT s.k, s.height AS below, s.idx, s.n, s.h FROM subroots s),
steps AS (
  SELECT k, height, idx, n, h, false AS above FROM nodes WHERE n > 1
  UNION ALL SELECT t.k, t.below + o.height, o.idx, o.n, o.h, true
  FROM tops t JOIN over o ON o.n > 1),
walk(leaf_idx, k, height, idx, n, above, h, proof) AS (
  SELECT idx, k, 0, idx, n, false, forged, '' FROM leaves
  UNION ALL
  SELECT w.leaf_idx, w.k, CASE WHEN w.n = 1 THEN w.height ELSE w.height + 1 END,
    CASE WHEN w.n = 1 THEN t.idx ELSE w.idx // 2 END, CASE WHEN w.n = 1 THEN t.n ELSE (w.n + 1) // 2 END,
    w.above OR w.n = 1,
    CASE WHEN w.n = 1 THEN w.h WHEN s.h IS NULL THEN sha256(w.h)
      WHEN w.idx % 2 = 0 THEN sha256(w.h || s.h) ELSE sha256(s.h || w.h) END,
    w.proof || CASE WHEN w.n = 1 THEN '' ELSE coalesce(s.h, '') END
  FROM walk w JOIN tops t ON t.k = w.k
  LEFT JOIN steps s ON s.k = w.k AND s.height = w.height AND s.above = w.above AND s.idx = xor(w.idx, 1) AND w.n > 1
  WHERE NOT (w.above AND w.n = 1)),
ends AS (SELECT k, leaf_idx, h, proof FROM walk WHERE above AND n = 1)
SELECT l.doc_id, l.leaf, t.h AS subroot, (SELECT h FROM over WHERE n = 1) AS root, sha256(e.proof) AS proof_sha256,
  e.h AS folded_root, e.h = (SELECT h FROM over WHERE n = 1) AS verified
FROM leaves l JOIN ends e ON e.k = l.k AND e.leaf_idx = l.idx JOIN tops t ON t.k = l.k"""
