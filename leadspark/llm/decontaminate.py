"""Benchmark decontamination with DataFrame functions only.

Every run of WINDOW words of a benchmark item (the whole item, if shorter) is a window. The windows' hashes go to
every task as a broadcast hash set; each document's token windows are hashed and looked up, the few that are found
are verified by comparing words, and hit words or whole documents are removed.

Up to LITERAL_WINDOWS distinct windows the set is part of the generated code; up to BROADCAST_WINDOWS, some 24 bytes each in a
task's process, it is a broadcast table that the documents' hashes stream past; past that stated bound of memory a
broadcast isn't safe, and Spark shuffles. All three give the same rows, and none but the last moves what isn't found.

Defined results: a null text has no words; items without words take no part; the windows of an item with a null id hit,
but it is no item to list; a document without words is clean; very long texts are cut into windows whole; overlapping
hits count each word once; repeated rows give one result row each; columns of the documents other than doc_id and text are
never read by name, so theirs may clash with ours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import ascii_lower, materialise

#: Words in a window.
WINDOW = 10
#: Up to so many distinct windows are sent to the tasks in the code, and up to so many as a broadcast table.
LITERAL_WINDOWS, BROADCAST_WINDOWS = 20_000, 4_000_000
#: Fixed value: what separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    split = F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)
    return F.filter(split, lambda w: w != "")


def _window_hash(ws: Column, at: Column, length: int) -> Column:
    """Hash of the `length` words from position `at` (from 1)."""
    return F.xxhash64(*[F.get(ws, at + (k - 1)) for k in range(length)])


def _starts(n: Column, length: int) -> Column:
    return F.when(n >= length, F.sequence(F.lit(1), n - (length - 1))).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """One row for each distinct window: gram (its words, space-joined), length, hash, items (ids as
    strings, none for those of an item without an id)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("ws")).where("size(ws) > 0")
    starts = F.when(F.size("ws") >= WINDOW, F.sequence(F.lit(1), F.size("ws") - (WINDOW - 1))).otherwise(F.array(F.lit(1)))
    cut = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("ws", i, WINDOW))).alias("ws"))
    hashes = F.lit(None).cast("long")
    for length in range(1, WINDOW + 1):
        hashes = F.when(F.size("ws") == length, _window_hash(F.col("ws"), F.lit(1), length)).otherwise(hashes)
    return cut.groupBy(F.concat_ws(" ", "ws").alias("gram"), F.size("ws").alias("length"), hashes.alias("hash")).agg(F.collect_set("item").alias("items"))


def _candidates(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """docs (with ws, n) and an array column `cand` of (at, length, gram) whose hash is that of a window."""
    found = windows.groupBy("length").agg(F.collect_set("hash").alias("hashes")).collect()
    parts = []
    for length, hashes in sorted((r["length"], r["hashes"]) for r in found):
        hits = F.filter(_starts(F.col("n"), length), lambda i: _window_hash(F.col("ws"), i, length).isin(hashes))  # noqa: B023
        parts.append(F.transform(hits, lambda i: F.struct(i.alias("at"), F.lit(length).alias("length"), F.concat_ws(" ", F.slice("ws", i, length)).alias("gram"))))  # noqa: B023
    none = F.array().cast("array<struct<at:int,length:int,gram:string>>")
    return docs.withColumn("cand", F.concat(none, *parts) if parts else none)


def _looked_up(docs: DataFrame, windows: DataFrame, lengths: list[int], bounded: bool) -> DataFrame:
    """The same for any number of windows: key, at, length, items of verified hits. Only hashes meet the windows, in a
    broadcast join if their number is bounded; the words of what is found are then compared with the document's."""
    parts = []
    for length in lengths:
        parts.append(F.transform(_starts(F.col("n"), length), lambda i: F.struct(i.alias("at"), F.lit(length).alias("length"), _window_hash(F.col("ws"), i, length).alias("hash"))))  # noqa: B023
    each = docs.select("key", F.explode(F.concat(*parts)).alias("w")).select("key", "w.*")
    known = windows.select("hash", "length").distinct()
    found = materialise(each.join(F.broadcast(known) if bounded else known, ["hash", "length"], "left_semi"), "windows-found")
    held = docs.join(found.groupBy("key").agg(F.collect_list(F.struct("at", "length", "hash")).alias("w")), "key")  # the documents hit
    grams = held.select("key", F.explode(F.transform("w", lambda x: F.struct(x["at"].alias("at"), x["length"].alias("length"), x["hash"].alias("hash"), F.concat_ws(" ", F.slice("ws", x["at"], x["length"])).alias("gram")))).alias("w"))
    return grams.select("key", "w.*").join(windows, ["hash", "length", "gram"]).select("key", "at", "length", "items")


def hits(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of documents: doc_id, text_hash, n_words, spans (start and length of found windows, by
    start), items (distinct ids of the items with a window found), copies folded: equal rows are counted in `rows`."""
    windows = materialise(benchmark_windows(benchmark), "windows")
    bound = windows.agg(F.count("*").alias("n"), F.collect_set("length").alias("lengths")).first()
    docs = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    docs = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h"), F.hash("text").alias("g")).alias("key"), words(F.col("text")).alias("ws")).withColumn("n", F.size("ws"))
    if bound["n"] <= LITERAL_WINDOWS:
        found = _candidates(docs, windows).select("key", "n", F.posexplode_outer("cand").alias("p", "c"))
        known = F.broadcast(windows.select("gram", F.col("length").alias("_length"), "items"))  # at most LITERAL_WINDOWS rows
        found = found.select("key", "n", F.coalesce("p", F.lit(0)).alias("p"), "c.*")
        found = found.join(known, (found["gram"] == known["gram"]) & (found["length"] == known["_length"]), "left")
        rows = found.select("key", "n", (F.col("p") == 0).cast("long").alias("is_row"), "at", "length", "items")
    else:
        none = F.lit(None)
        base = docs.select("key", "n", F.lit(1).cast("long").alias("is_row"), none.cast("int").alias("at"), none.cast("int").alias("length"), none.cast("array<string>").alias("items"))
        one = docs.dropDuplicates(["key"])
        more = _looked_up(one, windows, sorted(bound["lengths"]), bound["n"] <= BROADCAST_WINDOWS)
        rows = base.unionByName(more.select("key", none.cast("int").alias("n"), F.lit(0).cast("long").alias("is_row"), "at", "length", "items"))
    span = F.when(F.col("items").isNotNull(), F.struct("at", "length"))
    distinct = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))  # each list of items once a document
    by_doc = rows.groupBy("key").agg(F.max("n").cast("long").alias("n_words"), F.sum("is_row").alias("rows"), F.array_sort(F.collect_set(span)).alias("spans"), distinct.alias("items"))
    return by_doc.select("key.doc_id", F.col("key.h").alias("text_hash"), "rows", "n_words", "spans", "items")


def merged(spans: Column) -> Column:
    """The spans (sorted by start) as disjoint runs: array of (at, until), both counted from 1, until exclusive."""
    none = F.array().cast("array<struct<at:int,until:int>>")

    def add(runs: Column, s: Column) -> Column:
        end, last = s["at"] + s["length"], F.try_element_at(runs, F.lit(-1))
        apart = last.isNull() | (last["until"] < s["at"])
        kept = F.when(apart, runs).otherwise(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))))
        start = F.when(apart, s["at"]).otherwise(last["at"])
        return F.concat(kept, F.array(F.struct(start.alias("at"), F.greatest(end, F.coalesce(F.when(~apart, last["until"]), end)).alias("until"))))

    return F.aggregate(spans, none, add)


def covered(spans: Column) -> Column:
    """How many word positions the spans (sorted by start) cover."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(acc: Column, s: Column) -> Column:
        end = s["at"] + s["length"]  # exclusive
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["at"]))).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(spans, zero, add, lambda acc: acc["n"].cast("long"))


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A digest row for each row of documents."""
    found = hits(documents, benchmark)
    n_hit = covered(F.col("spans"))
    out = found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "rows",
    )
    return out.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int")))).drop("_", "rows")


def remove_documents(documents: DataFrame, benchmark: DataFrame, most: float = 0.0) -> DataFrame:
    """documents without those of whose words more than the share `most` are hit; all columns stay.

    Few documents are hit, so these are taken out by an anti join; equality is null-safe."""
    found = hits(documents, benchmark)
    bad = found.where(covered(F.col("spans")) > F.col("n_words") * most).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    match = documents["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(F.coalesce(documents["text"], F.lit(""))) == bad["_hash"])
    return documents.join(bad, match, "left_anti")


def remove_spans(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and text, without the words that are hit; the rest of the words is kept in lower case, space-joined."""
    found = hits(documents, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), merged(F.col("spans")).alias("runs")).where(F.size("spans") > 0)
    docs = documents.select("doc_id", "text")
    both = docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found["_hash"]), "left")
    inside = lambda i: F.exists("runs", lambda r: (r["at"] <= i + 1) & (i + 1 < r["until"]))
    left = F.concat_ws(" ", F.filter(words(F.col("text")), lambda w, i: ~inside(i)))
    return both.select("doc_id", F.when(F.col("runs").isNull(), F.col("text")).otherwise(left).alias("text"))


#: DuckDB SQL for report(); what the query op2 is held against.
SQL = r"""
WITH w AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, len(list_slice(ws, i, i + 9)) AS length, array_to_string(list_slice(ws, i, i + 9), ' ') AS gram
  FROM w, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS t(i) WHERE len(ws) > 0),
d AS (
  SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents),
g AS (
  SELECT k, i, l.length, array_to_string(list_slice(ws, i, i + l.length - 1), ' ') AS gram
  FROM d, (SELECT DISTINCT length FROM win) AS l, unnest(generate_series(1, len(ws) - l.length + 1)) AS t(i)),
h AS (SELECT g.k, g.i, g.length, win.item_id FROM g JOIN win ON g.gram = win.gram AND g.length = win.length),
n AS (SELECT k, count(DISTINCT p) AS n_hit FROM h, unnest(generate_series(i, i + length - 1)) AS t(p) GROUP BY k),
it AS (SELECT k, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM h WHERE item_id IS NOT NULL GROUP BY k)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(it.items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(it.items, ','), '')) AS items_sha256,
  coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (k) LEFT JOIN it USING (k)
"""
