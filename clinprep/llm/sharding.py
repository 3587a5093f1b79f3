"""Sharding by a k-d tree: distributed weighted medians along the widest metadata dimension.

Only DataFrame functions run. Each node of the tree is cut where its bytes halve, along the
dimension in which the node is widest (relative to the whole table). The median is found by
histograms that refine the range of the dimension; rows that tie in it are ordered by a hash of their
text, then by a hash of their id, and rows that agree in both by a hash of their number in a stored table. Equal texts therefore
stay in one shard, unless a group of copies is so heavy that shards of near-equal bytes need it split. All nodes of a level share
each pass, a pass moves at most BUCKETS sums a node and task, and at most SUMS (two a node) reach the driver. The rows of each
level, without their texts, are a written table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinprep.llm.text import inline_table, positions, table
from clinprep.sources.shared import store

BUCKETS = 1024
SUMS = 1 << 20
#: A cut may miss its share of bytes by this part of a shard.
SLACK = 0.005
#: Equal texts stay together if that costs at most this part of a shard.
GROUP_SLACK = 0.02
HASH_BITS = 40
#: What orders the rows of a node: the cut's dimension, and what follows where rows tie.
LEVELS = ("value", "text_hash", "id_hash", "row_hash")


def _hash40(*cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 64 - HASH_BITS)


def _find(rows: DataFrame, nodes: dict[int, dict], column: str, slack: float) -> None:
    """Narrow each open node's cut in ``column``: rows below ``lo`` go left, rows above ``hi`` go right.

    Ends when lo == hi or when what lies between weighs no more than slack; then the node gets done
    and everything up to the nearer side goes left.
    """
    spark = rows.sparkSession
    open_nodes = {k: n for k, n in nodes.items() if not n["done"]}
    while open_nodes:
        buckets = max(2, min(BUCKETS, SUMS // len(open_nodes)))
        params = [(k, n["lo"], (n["hi"] - n["lo"]) // buckets + 1, n["hi"], n["want"] - n["before"]) for k, n in open_nodes.items()]
        small = inline_table(spark, [p[:4] for p in params], "node long, lo long, width long, hi long")
        found = rows.join(F.broadcast(small), "node").filter(F.col(column).between(F.col("lo"), F.col("hi")))
        bucket = F.floor((F.col(column) - F.col("lo")) / F.col("width")).cast("long").alias("bucket")
        sums: dict[int, list] = {}
        for r in found.groupBy("node", bucket).agg(F.sum("size").alias("weight")).collect():  # SUMS at most
            sums.setdefault(r["node"], []).append((r["bucket"], r["weight"]))
        for (node, _, width, _, want) in params:
            n, below = nodes[node], 0
            for at, weight in sorted(sums[node]):
                if below + weight >= want:
                    break
                below += weight
            else:  # the rows' sum, in floating point, may miss what is wanted of it
                below -= weight
            n["lo"] += at * width
            n["hi"] = min(n["hi"], n["lo"] + width - 1)
            n["before"] += below
            n["weight"] = weight
            if weight <= slack:
                n["done"] = True
        open_nodes = {k: n for k, n in open_nodes.items() if not n["done"] and n["lo"] < n["hi"]}


def _near(n: dict) -> bool:
    """Whether the rows between lo and hi are better left of the cut."""
    return n["want"] - n["before"] > n["weight"] / 2


def _cuts(rows: DataFrame, parts: dict[int, int], dims: list[str], spans: dict[str, int], leaf: float) -> list[tuple]:
    """For each node that holds several shards: (node, dimension, and a limit for each of LEVELS); rows up to it go left."""
    ranges = rows.groupBy("node").agg(F.sum("size").alias("total"), *[f(d).alias(f"{k}_{d}") for d in dims for k, f in (("lo", F.min), ("hi", F.max))]).collect()
    cut: dict[int, dict] = {}
    for r in ranges:
        k = parts[r["node"]]
        if k > 1:
            dim = max(dims, key=lambda d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / max(1, spans[d]))
            cut[r["node"]] = {"dim": dim, "lo": r[f"lo_{dim}"], "hi": r[f"hi_{dim}"], "want": r["total"] * ((k + 1) // 2) / k, "before": 0, "weight": r["total"], "done": False, "key": {}}
    if not cut:
        return []
    chosen = inline_table(rows.sparkSession, [(n, dims.index(c["dim"])) for n, c in cut.items()], "node long, dim int")
    value = F.element_at(F.array(*[F.col(d) for d in dims]), F.col("dim") + 1)
    within, tied = rows.join(F.broadcast(chosen), "node").withColumn("value", value), dict(cut)
    for level, column in enumerate(LEVELS):
        if column == "id_hash":  # equal texts stay together where that costs little
            for c in tied.values():
                if min(abs(c["want"] - c["before"]), abs(c["want"] - c["before"] - c["weight"])) <= GROUP_SLACK * leaf:
                    c["key"]["text_hash"] -= not _near(c)
                    c["done"] = True
            tied = {n: c for n, c in tied.items() if not c["done"]}
        if not tied:
            break
        if level:
            last = LEVELS[level - 1]
            fixed = inline_table(rows.sparkSession, [(n, c["key"][last]) for n, c in tied.items()], "node long, tie long")
            within = within.join(F.broadcast(fixed), "node").filter(F.col(last) == F.col("tie")).drop("tie")
            for c in tied.values():
                c["lo"], c["hi"] = 0, (1 << HASH_BITS) - 1
        _find(within, tied, column, SLACK * leaf)
        for c in tied.values():  # done: what lies between lo and hi goes to one side; else rows tie at lo
            c["key"][column] = c["lo"] if not c["done"] else c["hi"] if _near(c) else c["lo"] - 1
        tied = {n: c for n, c in tied.items() if not c["done"]}
    for c in tied.values():  # rows that tie to the end
        c["key"][LEVELS[-1]] -= not _near(c)
    return [(n, dims.index(c["dim"]), *[c["key"].get(x, 1 << HASH_BITS) for x in LEVELS]) for n, c in cut.items()]


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", dims: dict[str, Column] | None = None, keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: ``doc_id, size`` and the columns of ``keep``, ``shard`` (from 0), ``slot`` (from 0, gapless).

    Give ``shards`` or ``target_bytes``; a tree of ceil(bytes / target_bytes) leaves is built. ``dims``
    are non-negative longs (default: characters, lines, and bytes beyond one a character); null counts as 0. A null or empty
    text has size 1. Rows that agree in all are dealt out like others, so bytes stay even whatever ids and texts repeat; each row has
    a slot of its own. An empty table gives an empty result;
    with fewer documents than shards some shards stay empty. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    dims = dims or {"chars": F.length(text), "lines": F.length(text) - F.length(F.translate(text, "\n", "")), "width": F.octet_length(text) - F.length(text)}
    names = [f"d{i}" for i in range(len(dims))]
    held = keep or {}
    rows = store(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            size.alias("size"),
            _hash40(text).alias("text_hash"),
            _hash40(F.col(id_col), F.lit("row")).alias("id_hash"),
            _hash40(F.monotonically_increasing_id()).alias("row_hash"),
            *[F.coalesce(c.cast("long"), F.lit(0)).alias(n) for n, c in zip(names, dims.values(), strict=True)],
            *[c.alias(f"k{i}") for i, c in enumerate(held.values())],
        ),
        "shard-meta",
    )
    whole = rows.agg(F.sum("size").alias("total"), *[(F.max(n) - F.min(n)).alias(n) for n in names]).first()
    total = whole["total"] or 0
    if shards is None:
        shards = max(1, math.ceil(total / target_bytes))
    leaf = total / shards
    spans = {n: whole[n] or 0 for n in names}
    placed, parts = rows.withColumn("node", F.lit(0).cast("long")), {0: shards}
    firsts = {0: 0}
    for _ in range(math.ceil(math.log2(shards)) if total else 0):
        cuts = _cuts(placed, parts, names, spans, leaf)
        # a node that holds one shard or no rows goes on unchanged as its own left child
        known = {c[0]: c for c in cuts}
        for n in parts:
            known.setdefault(n, (n, 0, 1 << 62, 0, 0, 0))
        limits = [f"cut_{x}" for x in LEVELS]
        small = F.broadcast(inline_table(spark, list(known.values()), "node long, cut_dim int, " + ", ".join(f"{x} long" for x in limits)))
        value = F.element_at(F.array(*[F.col(d) for d in names]), F.col("cut_dim") + 1)
        at = F.struct(value.alias("value"), *LEVELS[1:])
        limit = F.struct(*[F.col(x).alias(n) for x, n in zip(limits, LEVELS, strict=True)])
        placed = store(placed.join(small, "node").withColumn("node", F.col("node") * 2 + (at > limit).cast("long")).drop("cut_dim", *limits), "shard-level")
        halves = {n: ((k + 1) // 2 if k > 1 else 1, k // 2 if k > 1 else 0) for n, k in parts.items()}
        firsts = {2 * n + side: firsts[n] + side * halves[n][0] for n in parts for side in (0, 1) if halves[n][side]}
        parts = {2 * n + side: halves[n][side] for n in parts for side in (0, 1) if halves[n][side]}
    leaves = F.broadcast(inline_table(spark, list(firsts.items()), "node long, shard int"))
    sharded = placed.join(leaves, "node").withColumn("spread", F.col("row_hash"))
    sharded = positions(sharded, ["shard"], [F.col("row_hash"), F.col("id_hash"), F.col("text_hash")], "slot")
    return sharded.select("doc_id", "size", *[F.col(f"k{i}").alias(n) for i, n in enumerate(held)], "shard", F.col("slot").cast("long").alias("slot"))


def op8_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``documents``: eight shards by law ``bytes``.

    A null text has size 1 and the CRC of no bytes; equal texts share a shard unless that unbalances it; repeated rows and null ids
    have slots of their own; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    out = kd_shards(docs, shards=8, keep={"text_crc32": F.crc32(F.coalesce("text", F.lit("")))})
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
