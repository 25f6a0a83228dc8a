"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard. At each node every child draws
-ln(u) / weight, with u hashed from the child's path and the document's key,
and the smallest draw wins, so a child gets documents in proportion to its
weight. A child's draw depends on nothing but its own path and weight: when
the weights of a subtree change, only documents that enter or leave it move.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from substrata.llm.common import draw, id_text, sql_draw, table

SLOT_BUCKETS = 1024
#: Rows of two whole numbers each.
BROADCAST_STARTS = 1 << 20


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


@dataclass(frozen=True)
class Topology:
    leaves: tuple[Leaf, ...]

    @classmethod
    def even(cls, shards: int, per_rack: int = 4, racks: int = 2) -> Topology:
        """Shards 0 to shards-1 of equal weight, in racks of per_rack, in regions of so many racks."""
        return cls(tuple(Leaf(i // (per_rack * racks), i // per_rack % racks, i) for i in range(shards)))

    def grown(self, weight: float = 1.0) -> Topology:
        """One shard more, in a region of its own: documents can only move into that region, so into the new shard alone."""
        return Topology((*self.leaves, Leaf(max((x.region for x in self.leaves), default=-1) + 1, 0, max((x.shard for x in self.leaves), default=-1) + 1, weight)))

    def tree(self) -> dict[int, dict[int, dict[int, float]]]:
        out: dict[int, dict[int, dict[int, float]]] = {}
        for x in self.leaves:
            if x.weight <= 0:
                raise ValueError(f"shard {x.shard}: a weight is above 0")
            out.setdefault(x.region, {}).setdefault(x.rack, {})[x.shard] = x.weight
        if not out:
            raise ValueError("a topology has at least one shard")
        return out


def _weights(tree: dict) -> dict:
    total = lambda node: sum(map(total, node.values())) if isinstance(node, dict) else node
    return {k: float(total(v)) for k, v in tree.items()}


_LEAVES = "array<struct<child:int,weight:double>>"
_RACKS = f"array<struct<child:int,weight:double,below:{_LEAVES}>>"
_REGIONS = f"array<struct<child:int,weight:double,below:{_RACKS}>>"


def _nested(tree: dict) -> list[dict]:
    """Children in order, with their weights and what is below them."""
    return [{"child": k, "weight": w} | ({"below": _nested(tree[k])} if isinstance(tree[k], dict) else {}) for k, w in sorted(_weights(tree).items())]


def _winner(children: Column, path: Column, key: Column, below: bool = True) -> Column:
    """The child with the smallest draw, the first of equal ones: its number and what is below it."""

    def drawn(c: Column) -> Column:
        number = -F.ln(draw(F.concat(path, F.lit("/"), c["child"].cast("string")), key)) / c["weight"]
        return F.struct(number.alias("draw"), c["child"].alias("child"), *([c["below"].alias("below")] if below else []))

    return F.array_min(F.transform(children, drawn))


def locate(df: DataFrame, topology: Topology, id_col: str = "doc_id", prefix: str = "") -> DataFrame:
    """Add region, rack and shard (INT), each under the prefix; columns of these names are replaced.

    The tree is a constant array, so the expression is as short for thousands
    of shards as for a few. Null ids count as one id.
    """
    key = id_text(id_col)
    tree = F.from_json(F.lit(json.dumps(_nested(topology.tree()))), _REGIONS)
    region = _winner(tree, F.lit("tree"), key)
    path = lambda *found: F.concat_ws("/", F.lit("tree"), *[x["child"].cast("string") for x in found])
    others = [F.col(f"`{c}`") for c in df.columns if c not in {f"{prefix}{x}" for x in ("region", "rack", "shard")}]
    df = df.select(*others, F.struct(region.alias("region"), key.alias("key")).alias("place"))
    at = F.col("place.region")
    df = df.withColumn("place", F.struct(at.alias("region"), _winner(at["below"], path(at), F.col("place.key")).alias("rack"), F.col("place.key").alias("key")))
    at, rack = F.col("place.region"), F.col("place.rack")
    shard = _winner(rack["below"], path(at, rack), F.col("place.key"), below=False)
    return df.select(*others, at["child"].alias(f"{prefix}region"), rack["child"].alias(f"{prefix}rack"), shard["child"].alias(f"{prefix}shard"))


def _slotted(rows: DataFrame, shards: int, slot_buckets: int) -> DataFrame:
    """Add slot to rows that have doc_id, size, text_crc32 and shard, and at most `row` besides.

    The slot numbers a shard's rows from 0 without gaps. Rows are numbered
    within hash buckets of a shard and each bucket starts where the one before
    ends, so no task holds a whole shard, nor all rows without an id or with
    one id, unless their texts are equal too. The table of bucket sizes has at
    most shards x slot_buckets rows, whatever the input, and is broadcast if
    that is at most BROADCAST_STARTS.
    """
    whole = F.concat_ws(":", id_text("doc_id"), "size", "text_crc32")
    rows = rows.withColumn("bucket", F.pmod(F.conv(F.substring(F.md5(whole), 1, 8), 16, 10).cast("long"), F.lit(slot_buckets)))
    starts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    starts = starts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("start"))
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    rows = rows.withColumn("at", F.row_number().over(order))
    rows = rows.join(F.broadcast(starts) if shards * slot_buckets <= BROADCAST_STARTS else starts, ["shard", "bucket"])
    return rows.withColumn("slot", F.col("start") + F.col("at") - 1).drop("bucket", "at", "start")


def _sized(id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]


def shard_documents(df: DataFrame, topology: Topology, *, id_col: str = "doc_id", text_col: str = "text", slot_buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Return id, size (UTF-8 bytes of the text plus 1), text_crc32, region, rack, shard, slot and grown_shard of every row.

    Null text: no bytes, CRC of the empty text. Null ids: all share one shard.
    Repeated ids: one shard, slots of their own. Rows alike in id, size and
    CRC have their slots in no certain order. Empty table: no rows.
    """
    rows = locate(locate(df.select(*_sized(id_col, text_col)), topology), topology.grown(), prefix="grown_").drop("grown_region", "grown_rack")
    return _slotted(rows, len(topology.leaves), slot_buckets).select("doc_id", "size", "text_crc32", "region", "rack", "shard", "slot", "grown_shard")


def placed(df: DataFrame, topology: Topology, *, id_col: str = "doc_id", text_col: str = "text", slot_buckets: int = SLOT_BUCKETS) -> DataFrame:
    """The rows with all their columns and region, rack, shard and slot; columns of these names are replaced.

    Null ids, repeated rows and ties: see shard_documents(). Texts are carried
    whole, of any length; a null one counts as empty. Empty table: no rows.
    """
    added = ("region", "rack", "shard", "slot")
    rows = locate(df.select(*_sized(id_col, text_col), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")), topology)
    return _slotted(rows, len(topology.leaves), slot_buckets).select(*[F.col("row")[c].alias(c) for c in df.columns if c not in added], *added)


def write_shards(df: DataFrame, topology: Topology, path: str, *, id_col: str = "doc_id", salts: int = 16) -> None:
    """Write the rows as Parquet, one folder a shard, each in at most so many files."""
    located = locate(df, topology, id_col, "__")
    located.repartition("__shard", F.pmod(F.xxhash64(id_text(id_col)), F.lit(salts))).drop("__region", "__rack").write.partitionBy("__shard").parquet(path)


def op10_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), Topology.even(16))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def sql_winner(path: str, weights: dict[int, float], key: str) -> str:
    if len(weights) == 1:
        return str(next(iter(weights)))
    draws = ", ".join(f"{{'draw': -ln({sql_draw(f"'{path}/{c}:' || {key}")}) / {w!r}, 'child': {c}}}" for c, w in sorted(weights.items()))
    return f"(list_sort([{draws}])[1]).child"


def sql_locate(topology: Topology, key: str) -> tuple[str, str, str]:
    """Region, rack (given region) and shard (given both) in DuckDB's SQL."""
    tree = topology.tree()
    case = lambda on, by: f"CASE {on} " + " ".join(f"WHEN {k} THEN {v}" for k, v in sorted(by.items())) + " END"
    return (
        sql_winner("tree", _weights(tree), key),
        case("region", {r: sql_winner(f"tree/{r}", _weights(racks), key) for r, racks in tree.items()}),
        case("region", {r: case("rack", {k: sql_winner(f"tree/{r}/{k}", leaves, key) for k, leaves in racks.items()}) for r, racks in tree.items()}),
    )


def oracle(topology: Topology, slot_buckets: int = SLOT_BUCKETS, documents: Sequence[str] = ("documents",)) -> str:
    key = "coalesce(doc_id::VARCHAR, 'null')"
    old_region, old_rack, old_shard = sql_locate(topology, key)
    new_region, new_rack, new_shard = sql_locate(topology.grown(), key)
    return f"""
    WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n::BIGINT] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    a AS (SELECT doc_id, coalesce(text, '') AS text, {old_region} AS region FROM {documents[0]}),
    b AS (SELECT *, {old_rack} AS rack FROM a),
    c AS (SELECT doc_id, text, {old_shard} AS shard FROM b),
    d AS (SELECT *, {new_region} AS region FROM c),
    e AS (SELECT *, {new_rack} AS rack FROM d),
    f AS (SELECT doc_id, text, shard, {new_shard} AS grown_shard, hex(encode(text)) AS bytes,
                 {key} AS key FROM e),
    h AS (SELECT f.*, strlen(text)::BIGINT + 1 AS size,
                 xor(list_reduce([4294967295::BIGINT] || list_transform(range(strlen(text)::BIGINT), lambda i: ('0x' || substr(bytes, 2 * i + 1, 2))::BIGINT),
                                 lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8)), 4294967295) AS text_crc32
          FROM f, crc),
    g AS (SELECT *, (('0x' || substr(md5(key || ':' || size || ':' || text_crc32), 1, 8))::BIGINT) % {slot_buckets} AS bucket FROM h)
    SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
           row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, size, text_crc32) - 1 AS slot, grown_shard::INTEGER AS grown_shard
    FROM g"""
