"""Merkle manifest of a dataset by bitmap ranks and slot arrays (operator 11).

A document's leaf is the sha256 of its columns, each with its length. Leaves stand in one tree per
group (lang), ordered by doc_id; the trees' roots stand in a tree over the groups. Nothing sorts
the leaves:

1. Per group a compressed bitmap of its doc_ids: words of 64 ids, only those that hold one, merged
   by ``bit_or`` over all tasks. A running sum of their row counts is the directory.
2. A leaf's place is its word's directory entry plus the set bits below its own.
3. Leaves are put into arrays of ``2**LEVELS`` slots, keyed by group and place. An array is reduced
   by ``LEVELS`` levels at once; its node is a leaf of the next, far smaller stage.
4. Paths of siblings go down the same arrays, from the root to the leaves, where each document's
   proof is put together and folded.

Defined results: a null column counts as ``-``, so null and empty texts differ; texts are read
whole; the null group comes first; rows without a doc_id come first in their group; rows that
repeat a doc_id stand next to each other by their leaves (equal rows in any order), each with its
own place; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticelake.llm import tokens as tk
from noticelake.llm.repeats import stored

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
GROUP = "lang"
ID = "doc_id"
#: Levels that an array of slots reduces at once.
LEVELS = 10
#: The word of rows without an id, below all others.
_NO_ID = -(1 << 60)


def digest(values: dict[str, Column]) -> Column:
    """The sha256 of columns, each ``-`` if null, else its UTF-8 length, a colon and its text."""
    parts = []
    for value in values.values():
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def _parent(left: str, right: str = "") -> str:
    return sha256((left + right).encode()).hexdigest()


def _leaves(docs: DataFrame, columns: tuple[str, ...], altered: dict[str, Column]) -> DataFrame:
    """``l`` (group), ``id``, ``leaf``, ``altered`` (null where nothing is altered), and the place of the id's bit."""
    now = {c: F.col(c) for c in columns}
    then = digest({**now, **altered})
    leaf = digest(now)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(v) for c, v in altered.items()], F.lit(True))
    number = F.col(ID).cast("long")
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(GROUP).cast("string")), F.lit("")).alias("l"),
        number.alias("id"), leaf.alias("leaf"), F.when(~same, then).alias("altered"),
        F.coalesce(F.shiftright(number, 6), F.lit(_NO_ID)).alias("word"),
        F.coalesce(number.bitwiseAND(F.lit(63)), F.lit(0)).cast("int").alias("bit"))


def running(df: DataFrame, group: str, order: str, weight: str) -> DataFrame:
    """``df`` with ``upto``, the sum of ``weight`` over earlier rows of the group, and its ``total``.

    Rows are cut by range; one small row per group and range carries the sums between ranges.
    """
    parts = stored(df.repartitionByRange(group, order).sortWithinPartitions(group, order)
                   .withColumn("part", F.spark_partition_id()), "ranges")
    sums = parts.groupBy(group, "part").agg(F.sum(weight).alias("s"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, "part", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("before"),
                       F.sum("s").over(whole).alias("total"))
    here = Window.partitionBy(group, "part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("here", F.coalesce(F.sum(weight).over(here), F.lit(0)))
    return parts.join(sums, [group, "part"]).withColumn("upto", F.col("here") + F.col("before")).drop(
        "part", "here", "before")


def _repeats(leaves: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Ids of several rows (l, word, bit, m), and their rows with ``within``, the place among equals."""
    crowded = words.filter("n > bit_count(bits)").select("l", "word")
    if crowded.isEmpty():
        return None
    rows = leaves.join(crowded, ["l", "word"], "left_semi")
    ids = stored(rows.groupBy("l", "word", "bit").agg(F.count("*").alias("m")).filter("m > 1"), "repeated-ids")
    # A repeated id may have any number of rows: they are numbered within small parts of them.
    rows = stored(rows.join(ids.select("l", "word", "bit"), ["l", "word", "bit"], "left_semi").select(
        "*", F.substring("leaf", 1, 1).alias("head"), F.spark_partition_id().alias("part")), "repeated-rows")
    key, small = ["l", "word", "bit"], ["l", "word", "bit", "head", "part"]
    earlier = Window.partitionBy(*key).orderBy("head", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*small).count().select(*small, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("b"))
    number = F.row_number().over(Window.partitionBy(*small).orderBy("leaf"))
    rows = rows.withColumn("number", number).join(before, small).withColumn(
        "within", F.col("b") + F.col("number") - 1).drop("head", "part", "number", "b")
    return ids, rows


def ranked(leaves: DataFrame) -> DataFrame:
    """Leaves with ``r``, their place in their group, and ``total``, the group's number of rows."""
    words = leaves.groupBy("l", "word").agg(
        F.expr("bit_or(shiftleft(1L, bit))").alias("bits"), F.count("*").alias("n"))
    words = running(words, "l", "word", "n")
    rows = leaves.withColumn("within", F.lit(0).cast("long"))
    more = F.lit(0)
    if (repeats := _repeats(leaves, words)) is not None:
        ids, several = repeats
        rows = leaves.join(ids.select("l", "word", "bit"), ["l", "word", "bit"], "left_anti").withColumn(
            "within", F.lit(0).cast("long")).unionByName(several)
        extras = ids.groupBy("l", "word").agg(F.collect_list(F.struct("bit", (F.col("m") - 1).alias("more"))).alias("extras"))
        words = words.join(extras, ["l", "word"], "left")
        more = F.coalesce(F.aggregate(
            F.filter("extras", lambda x: x["bit"] < F.col("bit")), F.lit(0).cast("long"),
            lambda a, x: a + x["more"]), F.lit(0))
    below = F.expr("bit_count(bits & ~shiftleft(-1L, bit))")
    return rows.join(words, ["l", "word"]).select(
        "l", "id", "leaf", "altered", (F.col("upto") + below + more + F.col("within")).alias("r"), "total")


def _slots(nodes: DataFrame, at_once: int) -> DataFrame:
    """One row per array of slots; its entries come in any order, each with its slot."""
    columns = {"id": "bigint", "leaf": "binary", "altered": "binary", "member": "string"}
    entry = [F.col("r").bitwiseAND(F.lit((1 << at_once) - 1)).cast("int").alias("slot")]
    entry += [F.col(c) if c in nodes.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()]
    return stored(nodes.groupBy("l", F.shiftright("r", at_once).alias("b"), "total").agg(
        F.collect_list(F.struct(*entry)).alias("rows")), "slots")


def _levels(rows: list[dict], total: int, at_once: int) -> list[list[str]]:
    """Nodes of one array, level by level, up to the one that stands for it."""
    level = [""] * len(rows)
    for row in rows:
        level[row["slot"]] = row["leaf"].hex()
    levels = [level]
    for _ in range(min(at_once, (total - 1).bit_length())):
        level = [_parent(*level[i: i + 2]) for i in range(0, len(level), 2)]
        levels.append(level)
    return levels


def _reduced(at_once: int):
    schema = pa.schema([("l", pa.string()), ("r", pa.int64()), ("total", pa.int64()), ("leaf", pa.binary())])

    def emit(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                node = bytes.fromhex(_levels(row["rows"], row["total"], at_once)[-1][0])
                out.append({"l": row["l"], "r": row["b"], "total": -(-row["total"] >> at_once), "leaf": node})
            yield pa.RecordBatch.from_pylist(out, schema)

    return emit


class Tree:
    """The slot arrays of all groups, stage by stage, and each group's root."""

    def __init__(self, nodes: DataFrame, at_once: int):
        self.at_once = at_once
        self.stages: list[DataFrame] = []
        self.ended: list[DataFrame] = []
        while not self.ended or not nodes.isEmpty():
            self.stages.append(_slots(nodes, at_once))
            above = stored(self.stages[-1].mapInArrow(
                _reduced(at_once), "l string, r long, total long, leaf binary"), "nodes")
            self.ended.append(above.filter("total <= 1").select("l", "leaf"))
            nodes = above.filter("total > 1")

    def roots(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.ended)

    def paths(self, top: DataFrame) -> DataFrame:
        """Arrays of the lowest stage with the path of siblings above them, and the columns of
        ``top`` (l, turns, proof, and more) for their group."""
        found = None
        for stage, ended in zip(reversed(self.stages), reversed(self.ended), strict=True):
            above = top.join(ended.select("l"), "l").withColumn("b", F.lit(0).cast("long"))
            if found is not None:
                above = above.unionByName(found)
            joined = stage.join(above, ["l", "b"])
            if stage is self.stages[0]:
                return joined
            found = stored(joined.mapInArrow(_down(self.at_once), above.schema), "paths")


def _local(row: dict, at_once: int) -> tuple[list[str], list[str], int]:
    """Turns and siblings from each slot of an array up to the root, and how many turns are inside."""
    levels = _levels(row["rows"], row["total"], at_once)
    all_turns, proofs = [row["turns"]], [row["proof"]]
    for level in reversed(levels[:-1]):
        size = len(level)
        # To the right of an even place, to the left of an odd one; none next to a lone last node.
        all_turns = [("L" if i & 1 else "R" if i + 1 < size else "N") + all_turns[i >> 1] for i in range(size)]
        proofs = [(level[i ^ 1] if i ^ 1 < size else "") + proofs[i >> 1] for i in range(size)]
    return all_turns, proofs, len(levels) - 1


def _down(at_once: int):
    """Paths of the nodes below; their place is the number of the array they stand for."""

    def emit(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            carried = [n for n in batch.schema.names if n not in ("l", "b", "total", "rows", "turns", "proof")]
            out: list[dict] = []
            for row in batch.to_pylist():
                turns, proofs, _ = _local(row, at_once)
                out.extend({"l": row["l"], "b": (row["b"] << at_once) + i, "turns": turns[i], "proof": proofs[i],
                            **{c: row[c] for c in carried}} for i in range(len(turns)))
            yield pa.RecordBatch.from_pylist(out, pa.schema(
                [(c, pa.string()) for c in ("l", "turns", "proof", *carried)] + [("b", pa.int64())]))

    return emit


def fold(node: str, turns: str, proof: str) -> str:
    """The root that a node and its siblings lead to."""
    at = 0
    for turn in turns:
        if turn == "N":
            node = _parent(node)
            continue
        sibling = proof[at: at + 64]
        at += 64
        node = _parent(node, sibling) if turn == "R" else _parent(sibling, node)
    return node


_PROVED = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
           "verified boolean, lang string, place long")


def _prove(at_once: int, siblings: bool):
    def emit(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                turns, proofs, inside = _local(row, at_once)
                beyond: dict[str, str] = {}  # what a node of the whole array leads to
                for x in row["rows"]:
                    i = x["slot"]
                    top = fold((x["altered"] or x["leaf"]).hex(), turns[i][:inside], proofs[i])
                    if top not in beyond:
                        beyond[top] = fold(top, row["turns"], row["proof"])
                    out.append({
                        "doc_id": x["id"], "leaf": x["leaf"].hex(), "subroot": row["subroot"], "root": row["root"],
                        "proof_sha256": sha256(proofs[i].encode()).hexdigest(), "folded_root": beyond[top],
                        "verified": beyond[top] == row["root"], "lang": row["l"][1:] if row["l"] else None,
                        "place": (row["b"] << at_once) + i,
                        **({"turns": turns[i], "proof": proofs[i]} if siblings else {})})
            fields = [("doc_id", pa.int64()), *((c, pa.string()) for c in (
                "leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_()),
                ("lang", pa.string()), ("place", pa.int64())]
            fields += [("turns", pa.string()), ("proof", pa.string())] if siblings else []
            yield pa.RecordBatch.from_pylist(out, pa.schema(fields))

    return emit


def proved(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, altered: dict[str, Column] | None = None,
           siblings: bool = False, at_once: int = LEVELS) -> DataFrame:
    """Per row its leaf, its group's root, the root, its proof's digest, and what it folds to.

    ``altered`` gives columns other values for the folded leaf; where these are equal the original
    leaf is folded. ``verified`` says whether the root is reached. With ``siblings`` also the proof:
    ``turns`` has a letter per level (sibling to the right, left or none), ``proof`` the siblings.
    """
    tk.bound_batches(docs.sparkSession)
    leaves = stored(_leaves(docs, columns, altered or {}), "leaves")
    tree = Tree(ranked(leaves), at_once)
    members = tree.roots().select(F.lit("").alias("g"), F.col("l").alias("member"), "leaf", F.lit(1).alias("one"))
    members = running(members, "g", "member", "one")
    over = Tree(members.select(F.col("g").alias("l"), "member", "leaf", F.col("upto").alias("r"), "total"), at_once)
    start = over.roots().select("l", F.lit("").alias("turns"), F.lit("").alias("proof"),
                                F.lower(F.hex("leaf")).alias("root"))
    paths = stored(over.paths(start).mapInArrow(
        _members(at_once), "l string, turns string, proof string, root string, subroot string"), "group-paths")
    schema = _PROVED + (", turns string, proof string" if siblings else "")
    return tree.paths(paths).mapInArrow(_prove(at_once, siblings), schema)


def _members(at_once: int):
    """The path of each group's root."""
    names = ("l", "turns", "proof", "root", "subroot")

    def emit(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                turns, proofs, _ = _local(row, at_once)
                out.extend(dict(zip(names, (
                    x["member"], turns[x["slot"]], proofs[x["slot"]], row["root"], x["leaf"].hex()), strict=True))
                    for x in row["rows"])
            yield pa.RecordBatch.from_pylist(out, pa.schema([(n, pa.string()) for n in names]))

    return emit


def tampered(column: str = "n_chars") -> dict[str, Column]:
    """One more in ``column`` where the crc32 of the doc_id is divisible by 7; nulls stay."""
    chosen = F.coalesce(F.crc32(F.col(ID).cast("string")) % 7 == 0, F.lit(False))
    value = F.col(column).cast("decimal(20,0)")
    return {column: F.when(chosen, value + 1).otherwise(value)}


SQL = """
WITH RECURSIVE plain AS (
  SELECT doc_id, source, lang, n_chars, text, CAST(doc_id AS VARCHAR) AS i,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r,
         count(*) OVER (PARTITION BY lang) AS total
  FROM documents),
checked AS (
  SELECT *, xor(list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(string_split(i, ''), lambda x: ascii(x)::UBIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
      lambda a, z: xor(a >> 1, (a & 1::UBIGINT) * 3988292384::UBIGINT))), 4294967295::UBIGINT) AS crc
  FROM plain),
fields AS (
  SELECT *, coalesce(strlen(i) || ':' || i, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         CAST(n_chars AS VARCHAR) AS n, CAST(n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS m,
         coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM checked),
leaves AS (
  SELECT doc_id, lang, r, total, sha256(head || coalesce(strlen(n) || ':' || n, '-') || tail) AS leaf,
         sha256(head || coalesce(strlen(m) || ':' || m, '-') || tail) AS altered
  FROM fields),
levels AS (
  SELECT lang, 0 AS lv, r AS idx, total, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, lv + 1, idx // 2, (total + 1) // 2, sha256(string_agg(h, '' ORDER BY idx))
  FROM levels WHERE total > 1 GROUP BY lang, lv, idx // 2, total),
subroots AS (
  SELECT lang, lv AS depth, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS groups
  FROM levels WHERE total = 1),
tops AS (
  SELECT 0 AS lv, g AS idx, groups AS total, subroot AS h FROM subroots
  UNION ALL
  SELECT lv + 1, idx // 2, (total + 1) // 2, sha256(string_agg(h, '' ORDER BY idx))
  FROM tops WHERE total > 1 GROUP BY lv, idx // 2, total),
steps AS (
  SELECT l.doc_id, l.leaf, l.altered, s.subroot, n.lv AS lv, l.r >> n.lv AS idx, x.h AS sibling
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
  JOIN levels n ON n.lang IS NOT DISTINCT FROM l.lang AND n.idx = l.r >> n.lv AND n.lv < s.depth
  LEFT JOIN levels x ON x.lang IS NOT DISTINCT FROM l.lang AND x.lv = n.lv AND x.idx = xor(l.r >> n.lv, 1)
  UNION ALL
  SELECT l.doc_id, l.leaf, l.altered, s.subroot, s.depth + n.lv, s.g >> n.lv, x.h
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
  JOIN tops n ON n.idx = s.g >> n.lv AND n.total > 1
  LEFT JOIN tops x ON x.lv = n.lv AND x.idx = xor(s.g >> n.lv, 1)),
folds AS (
  SELECT doc_id, 0 AS lv, altered AS h FROM leaves
  UNION ALL
  SELECT f.doc_id, f.lv + 1, sha256(CASE WHEN s.sibling IS NULL THEN f.h WHEN s.idx % 2 = 0 THEN f.h || s.sibling
                                         ELSE s.sibling || f.h END)
  FROM folds f JOIN steps s ON s.doc_id = f.doc_id AND s.lv = f.lv),
proofs AS (
  SELECT doc_id, sha256(coalesce(string_agg(sibling, '' ORDER BY lv), '')) AS proof_sha256, count(*) AS n
  FROM steps GROUP BY doc_id)
SELECT l.doc_id, l.leaf, s.subroot, t.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
       f.h AS folded_root, f.h = t.h AS verified
FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
JOIN (SELECT h FROM tops WHERE total = 1) t ON true
LEFT JOIN proofs p ON p.doc_id = l.doc_id
JOIN folds f ON f.doc_id = l.doc_id AND f.lv = coalesce(p.n, 0)
"""
