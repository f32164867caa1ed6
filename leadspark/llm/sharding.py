"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A document's key is the hash of its text, so equal texts share one place on the ring. Each shard has VIRTUAL places; a
key belongs to the next shard clockwise, and if that is full, continues clockwise to the next that is not. A shard is
full at (1 + EPSILON) times the mean of bytes, so balance is guaranteed, and only keys that overflow move.

Loads are kept for cells, not documents: the ring is cut into CELLS equal arcs whose bytes Spark sums; only these sums
(at most CELLS, whatever the input) reach the driver, which places the cells, large ones first so that small ones
fill what is left. A cell of over a quarter of a shard, such as a text with very many copies, is cut by
hashes of doc_id into SUBCELLS with the same place on the ring, and overflows piece by piece.

Law: `bytes`. Slots number a shard's rows without gaps, from counts of hash buckets, never with a shard in one task.

Defined results: a null text has no bytes and counts as empty; null doc_ids hash like others; repeated rows are rows
of their own; columns of the documents are kept whatever their names, but for `shard` and `slot`, which are replaced.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.llm.common import materialise

SHARDS = 8
#: Places of each shard on the ring, and the load over the mean at which a shard is full.
VIRTUAL, EPSILON = 256, 0.002
#: Arcs of the ring, pieces of a large arc, and the share of a shard's mean load that makes an arc large.
CELLS, SUBCELLS, LARGE = 1 << 16, 1 << 10, 1 / 4
#: Buckets in which the rows of a shard are numbered: as many, a power of two, as keep about BUCKET_ROWS in each, MOST at most.
BUCKET_ROWS, MOST_BUCKETS = 1 << 15, 1 << 20


def _bits(h: Column, n: int) -> Column:
    """The top bits of a 64-bit hash: a number below n, a power of two."""
    return F.shiftrightunsigned(h, 64 - (n.bit_length() - 1)).cast("int")


def with_keys(documents: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns as the struct `row`, doc_id, and shard_size, shard_crc, shard_cell, shard_sub, shard_bucket."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row") if columns else F.lit(0).alias("row"),
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("shard_size"),
        F.crc32(text.cast("binary")).alias("shard_crc"),
        _bits(F.xxhash64(text), CELLS).alias("shard_cell"),
        _bits(F.xxhash64(F.lit("sub"), "doc_id"), SUBCELLS).alias("shard_sub"),
        F.xxhash64(F.lit("slot"), "doc_id").alias("shard_bucket"),
    )


def _hash(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "big")


def place(units: list[tuple[int, int, int]], shards: int, epsilon: float = EPSILON, virtual: int = VIRTUAL) -> dict[tuple[int, int], int]:
    """The shard of each unit (cell, piece, bytes): the first clockwise from its cell that has room for it; where
    none has, the one with the least load."""
    ring = sorted(((_hash("node", s, v) / (1 << 64)) * CELLS, s) for s in range(shards) for v in range(virtual))
    at = [p for p, _ in ring]
    room = (1 + epsilon) * sum(b for _, _, b in units) / shards
    load, out = [0] * shards, {}
    for cell, piece, size in sorted(units, key=lambda u: (-u[2].bit_length(), _hash("unit", u[0], u[1]))):
        start, tried = bisect.bisect_left(at, cell + 0.5), set()
        for k in range(len(ring)):
            s = ring[(start + k) % len(ring)][1]
            if load[s] + size <= room:
                break
            tried.add(s)
            if len(tried) == shards:
                s = min(range(shards), key=lambda x: (load[x], x))
                break
        load[s] += size
        out[cell, piece] = s
    return out


def plan(keyed: DataFrame, shards: int, epsilon: float = EPSILON) -> tuple[list[int], DataFrame]:
    """The large cells, and a table (shard_unit, shard) of at most CELLS + SUBCELLS * shards / LARGE rows."""
    spark = keyed.sparkSession
    cells = {r[0]: r[1] for r in keyed.groupBy("shard_cell").agg(F.sum("shard_size")).collect()}
    mean = sum(cells.values()) / shards
    large = sorted(c for c, b in cells.items() if b > LARGE * mean)
    units = [(c, -1, b) for c, b in cells.items() if b <= LARGE * mean]
    if large:
        units += [tuple(r) for r in keyed.where(F.col("shard_cell").isin(large)).groupBy("shard_cell", "shard_sub").agg(F.sum("shard_size")).collect()]
    rows = [(c * (SUBCELLS + 1) + p + 1, s) for (c, p), s in place(units, shards, epsilon).items()]
    return large, spark.createDataFrame(rows or [(-1, 0)], "shard_unit long, shard int")


def with_shard(keyed: DataFrame, large: list[int], placed: DataFrame, name: str = "shard") -> DataFrame:
    piece = F.when(F.col("shard_cell").isin(large), F.col("shard_sub") + 1).otherwise(0) if large else F.lit(0)
    unit = F.col("shard_cell").cast("long") * (SUBCELLS + 1) + piece
    return keyed.withColumn("shard_unit", unit).join(F.broadcast(placed.withColumnRenamed("shard", name)), "shard_unit").drop("shard_unit")


def with_slot(df: DataFrame, counted: DataFrame) -> DataFrame:
    """df with slot, from 0 within each shard. counted: the same rows, thin. Rows are numbered in buckets by a hash of the
    id, whose number grows with the rows; counts are one a bucket and shard."""
    rows = counted.count()
    buckets = min(MOST_BUCKETS, max(256, 1 << max(0, rows // (BUCKET_ROWS * SHARDS)).bit_length()))
    df, counted = (x.withColumn("shard_bucket", _bits(F.col("shard_bucket"), buckets)) for x in (df, counted))
    counts = counted.groupBy("shard", "shard_bucket").agg(F.count("*").alias("n"))
    first = counts.withColumn("shard_first", F.sum("n").over(Window.partitionBy("shard").orderBy("shard_bucket")) - F.col("n")).drop("n")
    order = Window.partitionBy("shard", "shard_bucket").orderBy("doc_id", "shard_crc", "shard_size")
    numbered = df.withColumn("slot", F.row_number().over(order).cast("long") - 1).join(F.broadcast(first), ["shard", "shard_bucket"])
    return numbered.withColumn("slot", F.col("slot") + F.col("shard_first")).drop("shard_first")


def _thin(documents: DataFrame) -> DataFrame:
    return materialise(with_keys(documents, []).drop("row"), "shard-keys")


def report(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    thin = _thin(documents)
    placed = with_shard(thin, *plan(thin, shards))
    law, none = F.lit("bytes"), F.lit(None).cast("int")
    return with_slot(placed, placed).select("doc_id", F.col("shard_size").alias("size"), F.col("shard_crc").alias("text_crc32"), law.alias("law"), "shard", "slot", none.alias("grown_shard"))


def shard_documents(documents: DataFrame, shards: int = SHARDS, epsilon: float = EPSILON) -> DataFrame:
    """documents, all columns, with shard and slot."""
    thin = _thin(documents)
    large, placed = plan(thin, shards, epsilon)
    columns = [c for c in documents.columns if c not in ("shard", "slot")]
    df = with_slot(with_shard(with_keys(documents, columns), large, placed), with_shard(thin, large, placed))
    return df.select("row.*", "shard", "slot")
