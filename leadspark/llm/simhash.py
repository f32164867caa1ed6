"""SimHash near-duplicates through deletion-variant signatures.

A document's fingerprint has 64 bits, each the majority of that bit in the hashes of its word shingles. Two documents
are linked if their fingerprints differ in at most three bits. Cut into two halves, one half of such a pair differs in
at most one bit: so each half is indexed as it is and once for every bit with that bit as a wildcard. Rows of equal
signatures meet in an equality join, in which a wildcard's two sides must differ at the wildcard, so that a pair meets
once for each half; every pair met is verified over all 64 bits. Linked fingerprints are then joined into components.

Sizes on disk don't tell how many rows come of a table here (66 signatures of a fingerprint), so Spark is not left to
decide by them what it broadcasts: only tables whose rows have been counted are, up to BROADCAST_ROWS of them.

A signature that very many fingerprints share is cut once more the same way: its pairs differ in at most three bits of
the other half, so one of that half's quarters differs in at most one bit.

Defined results: a null text is an empty one, and has fingerprint zero, linked like any other; equal fingerprints are
always in one component; a component's id is the smallest doc_id in it, null only if all are; repeated rows give one
result row each; other columns of the documents are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import map_batches, materialise, texts_of, words_of

#: Words in a shingle, seed of its hash, bits in which linked fingerprints may differ.
SHINGLE, HASH_SEED, MOST_BITS = 3, 42, 3
#: A signature of more fingerprints than this is cut once more.
HOT = 512
HALF = 0xFFFFFFFF
#: A table of more rows than this is never broadcast, however small its file is: it would pass through the driver.
BROADCAST_ROWS = 20_000


def fingerprint(words: list[bytes], size: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text's words."""
    if not words:
        return 0
    shingles = zip(*(words[k:] for k in range(size)), strict=False) if len(words) > size else [words]
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(s), HASH_SEED) for s in shingles], dtype="<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def _text_hash() -> Column:
    """Of the text; a null text is an empty one."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def fingerprints(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp, the fingerprint as a signed number, and h, the text's hash, for each row."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.fromiter((fingerprint(words_of(t), size) for t in texts_of(batch)), np.uint64, batch.num_rows)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64)), batch.column("h")], ["doc_id", "fp", "h"])

        return each

    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"), _text_hash().alias("h"))
    return map_batches(docs, make, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long, h long")


def _signatures(value: Column, bits: int, first_tag: int) -> Column:
    """Array of (tag, rest, side): the value as it is, on both sides, and with each bit as a wildcard, on that bit's side."""
    row = lambda tag, rest, side: F.struct(F.lit(tag).alias("tag"), rest.alias("rest"), side.alias("side"))
    bit = lambda p: F.shiftright(value, p).bitwiseAND(F.lit(1)).cast("int")
    exact = [row(first_tag, value, F.lit(side)) for side in (0, 1)]
    return F.array(*exact, *[row(first_tag + 1 + p, value.bitwiseAND(F.lit(~(1 << p))), bit(p)) for p in range(bits)])


def _side(table: DataFrame) -> DataFrame:
    """A written table as the second side of a join: broadcast if its rows are few, merged if not."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table.hint("merge")


def _halves(fp: Column) -> Column:
    low = lambda shift: F.shiftright(fp, shift).bitwiseAND(F.lit(HALF)).cast("long")
    return F.concat(_signatures(low(0), 32, 0), _signatures(low(32), 32, 33))


def _pairs(rows: DataFrame, keys: list[str], exact: Column, most: int) -> DataFrame:
    """Linked pairs (a, b) of the rows (fp, side, *keys) that meet under equal keys."""
    a, b = rows.where("side = 0").alias("a"), rows.where("side = 1").alias("b")
    on = (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= most) & (~exact | (F.col("a.fp") < F.col("b.fp")))
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b.hint("merge"), on).select(F.least("a.fp", "b.fp").alias("a"), F.greatest("a.fp", "b.fp").alias("b"))


def links(nodes: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Distinct pairs a < b of the distinct fingerprints `fp` that differ in at most `most` (up to three) bits."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = nodes.repartition(parts, "fp")  # few bytes, but 66 rows come of each
    rows = nodes.select("fp", F.explode(_halves(F.col("fp"))).alias("s")).select("fp", F.col("s.tag").alias("tag"), F.col("s.rest").alias("rest"), F.col("s.side").alias("side"))
    hot = materialise(rows.groupBy("tag", "rest").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("tag", "rest"), "simhash-hot")
    is_exact = F.col("a.tag").isin(0, 33)
    if hot.isEmpty():
        return _pairs(rows, ["tag", "rest"], is_exact, most).distinct()
    hot = _side(hot)
    cold = _pairs(rows.join(hot, ["tag", "rest"], "left_anti"), ["tag", "rest"], is_exact, most)
    # In a hot signature the other half's quarters are indexed: each pair that differs in at most three bits there
    # meets under one of them. Either side of the first wildcard may be on either side of the second.
    other = F.when(F.col("tag") < 33, F.shiftright("fp", 32)).otherwise(F.col("fp")).bitwiseAND(F.lit(HALF)).cast("long")
    quarter = lambda shift: F.shiftright(other, shift).bitwiseAND(F.lit(0xFFFF)).cast("long")
    more = F.explode(F.concat(_signatures(quarter(0), 16, 0), _signatures(quarter(16), 16, 17)))
    again = rows.join(hot, ["tag", "rest"]).where("side = 0 or tag not in (0, 33)").select("fp", "tag", "rest", more.alias("s"))
    again = again.select("fp", "tag", "rest", F.col("s.tag").alias("sub"), F.col("s.rest").alias("sub_rest"), F.col("s.side").alias("side")).distinct()
    return cold.union(_pairs(again, ["tag", "rest", "sub", "sub_rest"], F.col("a.sub").isin(0, 17), most)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b): root is the smallest node reachable.

    Every node points to its smallest neighbour; pointers are doubled until they reach roots; then each edge is
    replaced by that of its ends' roots, and the rest is done again. Each round at least halves what is left, and is
    written to the shared folder."""
    edges = materialise(edges, "cc-edges")
    total = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        point = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "cc-point")
        while True:
            up = _side(point.select(F.col("node").alias("_node"), F.col("root").alias("_root")))
            jumped = point.join(up, point["root"] == up["_node"]).select("node", F.col("_root").alias("root"), (F.col("_root") != F.col("root")).alias("moved"))
            jumped = materialise(jumped, "cc-jump")
            point, moved = jumped.select("node", "root"), jumped.where("moved")
            if moved.isEmpty():
                break
        if total is None:
            total = point
        else:
            p = _side(point.select(F.col("node").alias("_node"), F.col("root").alias("_root")))
            total = materialise(total.join(p, total["root"] == p["_node"], "left").select("node", F.coalesce("_root", "root").alias("root")), "cc-total")
        pa_, pb = _side(point.select(F.col("node").alias("a"), F.col("root").alias("ra"))), _side(point.select(F.col("node").alias("b"), F.col("root").alias("rb")))
        edges = materialise(edges.join(pa_, "a").join(pb, "b").where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if total is None else total


def cluster(documents: DataFrame, size: int = SHINGLE, most: int = MOST_BITS) -> DataFrame:
    """doc_id, fp, component_id, h and first_h for each row of documents: the hashes of its text and of the least text
    that has the component's id."""
    docs = materialise(fingerprints(documents, size), "simhash-docs")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))
    nodes = materialise(docs.groupBy("fp").agg(first.alias("least")), "simhash-nodes")
    roots = components(links(nodes, most))
    rooted = nodes.join(_side(roots), nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("first"))
    named = materialise(rooted.join(ids.hint("merge"), "root").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.h").alias("first_h")), "simhash-named")
    return docs.join(_side(named), "fp").select("doc_id", "fp", "component_id", "h", "first_h")


def report(documents: DataFrame) -> DataFrame:
    return cluster(documents).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(documents: DataFrame) -> DataFrame:
    """documents with one row of each component, that of the smallest doc_id (rows without one come last) and of its
    texts the one with the least hash. Id and text together tell the component, so a null id, or an id that has several
    texts, is judged text by text. All columns stay."""
    found = materialise(cluster(documents), "simhash-found")
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("h") == F.col("first_h"))
    gone = materialise(found.where(~first).select("doc_id", "h").distinct(), "simhash-gone")
    twice = found.where(first).groupBy("doc_id", "h").count().where("count > 1")
    gone = _side(gone.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")))
    columns = [F.col(f"`{c}`") for c in documents.columns]
    docs = documents.select(F.struct(*columns).alias("row"), F.col("doc_id").alias("_doc_id"), _text_hash().alias("_text_hash"))
    kept = docs.join(gone, docs["_doc_id"].eqNullSafe(gone["_id"]) & (docs["_text_hash"] == gone["_h"]), "left_anti")
    kept = kept if twice.isEmpty() else kept.dropDuplicates(["_doc_id", "_text_hash"])
    return kept.select("row.*")
