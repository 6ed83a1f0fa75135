"""A Merkle manifest of a dataset: every row's digest, its proof up to one root, and its check.

Rows are leaves; those of one key stand in order, and every `fanout` nodes become one, level by level,
up to the key's subroot; subroots, in the order of keys, become the root in the same way. Leaves are
dealt by ranges and numbered from the sizes of the ranges before, so that a block holds an aligned,
bounded stretch of one key's leaves, whatever share of the rows the key has. A block is the partition
of the exchange. Each block works out the root of its own subtree; then, round by round, the blocks of
`fanout` neighbouring subtrees swap their roots as in a butterfly: every block sends to its counterparts
in the other subtrees, all blocks of a group hash the node above them, and keep what they received as
the next step of their proofs. So after the last round each block has the proof from its own root to
the subroot, and nothing is sent back down. The languages swap subroots in the same rounds. Digests
alone are shuffled, never texts; the largest row that meets another is a block.

Cases: a null field is written `-`; null keys come first and are a key of their own; null order values
come first; rows with the same key and order are ordered by their digests, and rows that repeat wholly
are leaves each (each at its own place, with a proof of its own); a key with one row has its leaf as
subroot; an empty table gives an empty result; further columns, whatever they are called, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import SQL_CRC, fold_of, partitions, small_batches, written

STEP = "struct<place: int, siblings: array<string>>"  # the own place among its run, the run's other nodes


def field_text(value: Column) -> Column:
    """`-` for a null, else the bytes that follow, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """Digest of a row by its fields, in hex."""
    return F.sha2(F.concat(*map(field_text, values)), 256)


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (key, ord, ...) dealt by ranges of (key, ord, leaf) with part, key_no (of keys in the part) and at (of rows of that key in the part), written."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key_no, at, last = TaskContext.get().partitionId(), -1, 0, None
        for batch in batches:
            numbers = []
            for key in batch.column("key").to_pylist():
                if key_no < 0 or key != last:
                    key_no, at, last = key_no + 1, 0, key
                numbers.append((key_no, at))
                at += 1
            keys, places = zip(*numbers, strict=True) if numbers else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(numbers), pa.int64()), pa.array(keys, pa.int64()), pa.array(places, pa.int64())], [*batch.schema.names, "part", "key_no", "at"])

    # Of rows that repeat wholly the reader's partition tells, so that they fill several ranges.
    ranged = rows.withColumn("read", F.spark_partition_id()).repartitionByRange(partitions(rows.sparkSession), F.asc_nulls_first("key"), F.asc_nulls_first("ord"), "leaf", "read")
    ordered = ranged.drop("read").sortWithinPartitions(F.asc_nulls_first("key"), F.asc_nulls_first("ord"), "leaf")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return written(ordered.mapInArrow(number, f"{schema}, part long, key_no long, at long"), "dealt")


def _keys_in_parts(dealt: DataFrame) -> DataFrame:
    """part, key_no, start (rows of the key in parts before), leaves (of the key), tree (number of the key): a row for each part and each further key in it."""
    pairs = dealt.groupBy("part", "key_no", "key").agg(F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    of_key = Window.partitionBy("key")
    pairs = pairs.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(of_key).alias("leaves"), (F.min("part").over(of_key) == F.col("part")).alias("new"))
    pairs = written(pairs, "pairs")
    # A key is numbered in the part that it begins in; the window over all parts has a row for each.
    fresh = pairs.where("new").groupBy("part").agg(F.count("*").alias("begun"))
    begun = fresh.select("part", F.coalesce(F.sum("begun").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = pairs.where("new").select("part", "key", F.row_number().over(Window.partitionBy("part").orderBy("key_no")).alias("no"))
    trees = own.join(begun, "part").select(F.col("key").alias("of"), (F.col("base") + F.col("no") - 1).alias("tree"))
    return pairs.join(trees, F.col("key").eqNullSafe(F.col("of"))).select("part", "key_no", "start", "leaves", "tree")


def levels_of(leaves: list[str], fanout: int, levels: int | None) -> list[list[str]]:
    """Nodes of a block, level by level from its leaves: so many levels, or up to a single node."""
    out = [leaves]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        nodes = out[-1]
        out.append([hashlib.sha256("".join(nodes[i : i + fanout]).encode()).hexdigest() for i in range(0, len(nodes), fanout)])
    return out


def swapped(state: DataFrame, width: int, fanout: int) -> DataFrame:
    """One round: members (of trees) whose subtrees have `width` members get the nodes of the subtrees beside theirs.

    A member's counterparts in another subtree are those at its own place, and at every own subtree's
    size further, so that each of them hears from one member, also where the last subtree is shorter.
    """
    own = state.selectExpr("*", f"member div {width} AS sub", f"member div {width * fanout} * {fanout} AS base", f"least({width}, members - member div {width} * {width}) AS size", f"member % {width} AS inside")
    there = f"transform(filter(sequence(base, base + {fanout - 1}), j -> j <> sub AND j * {width} < members), j -> struct(j * {width} AS begin, least({width}, members - j * {width}) AS n))"
    targets = f"flatten(transform({there}, s -> IF(inside < s.n, sequence(s.begin + inside, s.begin + s.n - 1, size), array())))"
    sent = own.selectExpr("tree", "members", f"explode(concat(array(struct(member AS to, path AS path)), transform({targets}, t -> struct(t AS to, CAST(NULL AS array<{STEP}>) AS path)))) AS e", "struct(int(sub - base) AS place, node AS node) AS offer")
    met = sent.groupBy("tree", F.col("e.to").alias("member")).agg(F.max("members").alias("members"), F.first("e.path", ignorenulls=True).alias("path"), F.sort_array(F.collect_list("offer")).alias("offers"))
    mine = f"int(member div {width} % {fanout})"
    step = f"struct({mine} AS place, transform(filter(offers, o -> o.place <> {mine}), o -> o.node) AS siblings)"
    return met.selectExpr(
        "tree", "member", "members",
        f"IF(members > {width}, sha2(array_join(transform(offers, o -> o.node), ''), 256), offers[0].node) AS node",
        f"IF(members > {width}, concat(path, array({step})), path) AS path",
    )


def _butterfly(state: DataFrame, most: int, fanout: int) -> DataFrame:
    """All rounds for trees of at most `most` members; each reads the round before once, so they are one chain of shuffles."""
    width = 1
    while width < most:
        state, width = swapped(state, width, fanout), width * fanout
    return state


def manifest(rows: DataFrame, fanout: int = 2, block: int = 4096) -> DataFrame:
    """rows (key string, ord, leaf in hex, and what else is to be kept of a leaf) -> the same columns with subroot, root and proof.

    A proof has a step for each level, from the leaf up. What else is kept has none of the names part, key_no, at, start, leaves, tree.
    """
    spark = rows.sparkSession
    small_batches(spark, 2000)
    levels = 1
    while fanout ** (levels + 1) <= block:
        levels += 1
    block = fanout**levels
    dealt = _dealt(rows.withColumn("leaf", F.unhex("leaf")))
    keys = written(_keys_in_parts(dealt), "keys")
    sizes = keys.agg(F.max("leaves").alias("leaves"), F.max("tree").alias("tree")).first()
    if sizes.leaves is None:
        return rows.selectExpr("*", "'' AS subroot", "'' AS root", f"CAST(array() AS array<{STEP}>) AS proof")
    placed = dealt.join(keys, ["part", "key_no"]).withColumn("place", F.col("start") + F.col("at"))
    held = [c for c in rows.columns if c != "leaf"]
    leaf = F.struct("place", "leaf", *held)
    packed = placed.groupBy("tree", F.expr(f"place div {block}").alias("member")).agg(F.max("leaves").alias("leaves"), F.sort_array(F.collect_list(leaf)).alias("rows"))
    packed = written(packed.withColumn("members", F.expr(f"(leaves + {block - 1}) div {block}")), "blocks")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [levels_of([x.hex() for x in row], fanout, levels if members > 1 else None)[-1][0] for row, members in zip(batch.column("leaf").to_pylist(), batch.column("members").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(nodes, pa.string())], ["tree", "member", "members", "node"])

    state = packed.selectExpr("tree", "member", "members", "rows.leaf AS leaf").mapInArrow(roots, "tree long, member long, members long, node string")
    empty = F.expr(f"CAST(array() AS array<{STEP}>)")
    state = written(_butterfly(state.withColumn("path", empty), -(-sizes.leaves // block), fanout), "paths")
    tops = state.where("member = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("member"), F.lit(sizes.tree + 1).cast("long").alias("members"), "node", empty.alias("path"))
    tops = _butterfly(tops, sizes.tree + 1, fanout).select(F.col("member").alias("tree"), F.col("node").alias("root"), F.col("path").alias("above"))
    paths = state.join(tops, "tree").select("tree", "member", F.col("node").alias("subroot"), "root", F.concat("path", "above").alias("path"))
    schema = rows.schema
    names = [f.name for f in schema]
    plan = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members, subroot, root = (batch.column(c).to_pylist() for c in ("members", "subroot", "root"))
            listed, path = batch.column("rows"), batch.column("path")
            for i in range(batch.num_rows):
                own, above = listed[i].values, path[i].values
                leaves = [x.hex() for x in own.field("leaf").to_pylist()]
                tree = levels_of(leaves, fanout, levels if members[i] > 1 else None)[:-1]
                places, siblings, at, begin = [], [], [], 0
                for level, nodes in enumerate(tree):
                    at.append(begin + np.arange(len(leaves)) // fanout**level)
                    begin += len(nodes)
                    for k in range(len(nodes)):
                        first = k - k % fanout
                        places.append(k - first)
                        siblings.append(nodes[first:k] + nodes[k + 1 : first + fanout])
                steps = pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.array(siblings, pa.list_(pa.string()))], ["place", "siblings"])
                steps = pa.concat_arrays([steps, pa.StructArray.from_arrays([above.field("place").cast(pa.int32()), above.field("siblings").cast(pa.list_(pa.string()))], ["place", "siblings"])])
                at.extend(np.full(len(leaves), begin + k) for k in range(len(above)))
                index = np.stack(at, 1).ravel() if at else np.zeros(0, np.int64)
                proof = pa.ListArray.from_arrays(pa.array(np.arange(len(leaves) + 1, dtype=np.int32) * len(at)), steps.take(pa.array(index)))
                columns = [pa.array(leaves) if c == "leaf" else own.field(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([subroot[i]] * len(leaves)), pa.array([root[i]] * len(leaves)), proof], [*names, "subroot", "root", "proof"])

    met = packed.join(paths, ["tree", "member"]).select("members", "rows", "subroot", "root", "path")
    return met.mapInArrow(proofs, f"{plan}, subroot string, root string, proof array<{STEP}>")


def proof_digest(proof: str = "proof") -> Column:
    """Digest of all siblings of a proof, from the leaf up and from left to right."""
    return F.expr(f"sha2(array_join(flatten(transform({proof}, s -> s.siblings)), ''), 256)")


def folded(leaf: str, proof: str = "proof") -> Column:
    """The root that a leaf has by its proof."""
    return F.expr(f"aggregate({proof}, {leaf}, (node, s) -> sha2(array_join(concat(slice(s.siblings, 1, s.place), array(node), slice(s.siblings, s.place + 1, size(s.siblings))), ''), 256))")


def document_leaves(docs: DataFrame) -> DataFrame:
    """documents -> key (lang), ord (doc_id), leaf, and changed: the leaf after tampering with n_chars, where the contract has it."""
    fields = [docs[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = leaf_digest(*fields[:3], docs["n_chars"] + 1, docs["text"])
    tampered = (fold_of(docs["doc_id"], 7) == 0) & docs["n_chars"].isNotNull()
    return docs.select(docs["lang"].alias("key"), docs["doc_id"].cast("long").alias("ord"), leaf_digest(*fields).alias("leaf"), F.when(tampered, changed).alias("changed"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot, root and proof, and its check after tampering with some."""
    proved = manifest(document_leaves(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    out = proved.select(F.col("ord").alias("doc_id"), "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), folded("coalesce(changed, leaf)").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_leaf(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in fields) + ")"


#: Levels, and the folds along them, one row a node and a row at a time; doc_ids that are null or repeated are not told apart.
SQL = f"""WITH RECURSIVE {SQL_CRC}, x AS (SELECT doc_id, lang, {_sql_leaf('n_chars')} AS leaf, CASE WHEN h % 7 = 0 AND n_chars IS NOT NULL THEN {_sql_leaf('(n_chars + 1)')} END AS changed FROM documents JOIN crc USING (doc_id)),
lf AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM x),
up AS (SELECT tree, 0 AS level, place, n, leaf AS node FROM lf UNION ALL SELECT tree, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY place)) FROM up WHERE n > 1 GROUP BY tree, level, place // 2, n),
top AS (SELECT 0 AS level, tree AS place, (SELECT max(tree) + 1 FROM lf) AS n, node FROM up WHERE n = 1 UNION ALL SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY place)) FROM top WHERE n > 1 GROUP BY level, place // 2, n),
fold AS (SELECT doc_id, tree, 0 AS level, place, n, false AS above, coalesce(changed, leaf) AS node, '' AS proof FROM lf
 UNION ALL SELECT doc_id, tree, CASE WHEN fold.n > 1 THEN level + 1 ELSE 0 END, CASE WHEN fold.n > 1 THEN place // 2 ELSE tree END, CASE WHEN fold.n > 1 THEN (fold.n + 1) // 2 ELSE (SELECT max(tree) + 1 FROM lf) END, above OR fold.n = 1,
  CASE WHEN fold.n = 1 THEN fold.node WHEN place % 2 = 0 THEN sha256(fold.node || coalesce(s.node, '')) ELSE sha256(s.node || fold.node) END, proof || CASE WHEN fold.n > 1 THEN coalesce(s.node, '') ELSE '' END
  FROM fold LEFT JOIN (SELECT false AS up2, tree AS t2, level AS l2, place AS p2, node FROM up UNION ALL SELECT true, -1, level, place, node FROM top) s ON s.up2 = fold.above AND s.t2 = CASE WHEN fold.above THEN -1 ELSE tree END AND s.l2 = level AND s.p2 = xor(place, 1)
  WHERE fold.n > 1 OR NOT above)
SELECT lf.doc_id, leaf, sub.node AS subroot, root.node AS root, sha256(fold.proof) AS proof_sha256, fold.node AS folded_root, fold.node = root.node AS verified FROM lf JOIN fold ON fold.doc_id = lf.doc_id AND fold.above AND fold.n = 1 JOIN (SELECT tree, node FROM up WHERE n = 1) sub ON sub.tree = lf.tree, (SELECT node FROM top WHERE n = 1) root"""
