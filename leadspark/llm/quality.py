"""Weak-label quality classifier.

Overlapping heuristic labellers vote good, bad or abstain on each text. Expectation-maximisation over the votes of
all documents, which are counted by pattern (at most 2^labellers patterns, whatever the input), estimates each labeller's
accuracy with no human labels. The posterior of each pattern is the soft label with
which a linear scorer on hashed byte n-grams is fitted, on a sample of at most TRAIN_ROWS documents; the scorer judges
every whole text.

Defined results: a null text is empty; all labellers abstain on an empty text, and its score is that of no evidence; it is
kept (accepted) if that is. A text of few words is judged like any other, and a very long one whole. A row without a doc_id
never enters the fit, but is scored; a score of just the cut is accepted. Repeated rows give one result row
each; other columns of the documents are kept by filter_documents and ignored otherwise.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadspark.llm import hashed
from leadspark.llm.common import map_batches, materialise, record, texts_of

#: Rows to fit the scorer on at most, n-gram width, selected n-grams, documents that must hold one.
TRAIN_ROWS, WIDTH, SELECTED, LEAST = 12_000, 4, 2000, 4
#: A document is rejected if it is likelier bad than good.
ACCEPT = 0.5
#: What share of documents is good before any vote is seen.
PRIOR = 0.85
#: White space, capitals, letters, and marks that prose hardly uses.
_SPACE, _UPPER = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"#$%&*+<=>[\\]^_`{|}~@")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".?!;:,")] = True
_CLASSES = (_SPACE.astype(np.uint8) | _UPPER.astype(np.uint8) << 1 | _LETTER.astype(np.uint8) << 2 | _MARK.astype(np.uint8) << 3 | _STOP.astype(np.uint8) << 4)

GOOD, BAD, ABSTAIN = 1, -1, 0
#: What is measured on a text, in the order of measures().
MARKS, CAPITALS, MARKED, SHOUTED, DOUBLED, LINES, OTHERS, AGAIN, POOR, TOP = range(10)
#: The labellers: what each votes, and on what measures: bad from each of the values on, good up to all of them; else it abstains.
LABELLERS = (
    (BAD, {MARKS: 0.06}),  # share of bytes that are marks prose hardly uses
    (BAD, {CAPITALS: 0.40}),  # share of letters that are A to Z
    (BAD, {MARKED: 0.20}),  # share of words that hold such a mark
    (BAD, {SHOUTED: 0.30}),  # share of words of two letters or more that are in capitals
    (BAD, {DOUBLED: 0.20}),  # share of words that end in a doubled stop
    (BAD, {LINES: 0.60}),  # share of lines that were there before
    (BAD, {OTHERS: 0.20}),  # share of bytes that are neither letters nor white space
    (BAD, {AGAIN: 0.30}),  # share of words that repeat the word before
    (BAD, {POOR: 0.66}),  # root of the number of words over the number of different words
    (BAD, {TOP: 0.20}),  # share of the most frequent word
    (GOOD, {MARKS: 0.01, MARKED: 0.03, CAPITALS: 0.12, AGAIN: 0.10}),
    (GOOD, {OTHERS: 0.09, SHOUTED: 0.05, DOUBLED: 0.05, POOR: 0.50}),
)
#: Texts of fewer words say nothing by repetition.
FEW = 20


def measures(text: bytes) -> list[float]:
    """The measures that the labellers use; nothing for a text without words."""
    kinds = _CLASSES[np.frombuffer(text, np.uint8)]
    space = (kinds & 1).astype(bool)
    n = int((~space).sum())
    if not n:
        return []
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    upper, letter, mark, stop = (np.concatenate(([0], np.cumsum((kinds >> k) & 1, dtype=np.int64))) for k in (1, 2, 3, 4))
    each = lambda c: c[ends] - c[starts]
    words, letters = len(starts), int(letter[-1])
    ws = text.split()
    times = Counter(ws)
    lines = [x for x in text.split(b"\n") if x.strip()]
    last = np.maximum(ends - 2, 0)
    doubled = (ends - starts >= 3) & (stop[ends] - stop[last] == 2)
    return [
        mark[-1] / n,
        upper[-1] / letters if letters else 0.0,
        float((each(mark) > 0).sum()) / words,
        float(((each(letter) >= 2) & (each(upper) == each(letter))).sum()) / words,
        float(doubled.sum()) / words,
        1 - len(set(lines)) / len(lines),
        1 - letters / n,
        sum(map(eq, ws, ws[1:])) / words if words >= FEW else 0.0,
        words**0.5 / len(times) if words >= FEW else 0.0,
        max(times.values()) / words if words >= FEW else 0.0,
    ]


def votes(text: bytes) -> int:
    """The labellers that don't abstain, as bits."""
    found = measures(text)
    if not found:
        return 0
    does = lambda sense, edges: all(found[m] <= x if sense == GOOD else found[m] >= x for m, x in edges.items())
    return sum(1 << j for j, (sense, edges) in enumerate(LABELLERS) if does(sense, edges))


def shape(text: bytes) -> bytes:
    """What the scorer sees: the words, space-joined, a repeated one shown as such, so that an n-gram can tell."""
    ws = text.split()
    return b" " + b" ".join([w if w != before else b"\x01\x01\x01" for before, w in zip([b"", *ws], ws, strict=False)]) + b" "


def pattern_of(documents: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep, and `pattern`, each text's votes."""
    docs = documents.select(*keep, F.col("text").cast("string").alias("text"))
    fields = ", ".join(f"{c} {t}" for c, t in docs.dtypes if c in keep)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return record(**{c: batch.column(c) for c in keep}, pattern=pa.array([votes(t) for t in texts_of(batch)], pa.int32()))

        return each

    return map_batches(docs, make, f"{fields}{', ' if fields else ''}pattern int")


def expectation_maximisation(cast: np.ndarray, counts: np.ndarray, senses: np.ndarray, prior: float = PRIOR, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, float]:
    """cast: for each pattern, which labellers vote; counts: how many documents have it; senses: what each labeller
    votes. Returns each pattern's posterior of good, the labellers' accuracies (how often a vote is right) and the
    share of good.

    Each labeller votes with one probability on good texts and one on bad texts, independently given which; the start,
    at which all vote far more often where they are right, fixes which class is good. To abstain tells too: with the
    probability of not voting."""
    cast = cast.astype(np.float64)
    rates = np.where(senses[:, None] > 0, [0.1, 0.8], [0.4, 0.02])  # P(votes | bad), P(votes | good)
    posterior = np.full(len(cast), prior)
    for _ in range(rounds):
        logs = np.stack([cast @ np.log(rates[:, y]) + (1 - cast) @ np.log(1 - rates[:, y]) for y in (0, 1)])
        logit = np.log(prior / (1 - prior)) + logs[1] - logs[0]
        new = 1 / (1 + np.exp(-np.clip(logit, -60, 60)))
        done = np.abs(new - posterior).max(initial=0) < 1e-9
        posterior = new
        if done:
            break
        for y, weight in ((0, counts * (1 - posterior)), (1, counts * posterior)):
            rates[:, y] = np.clip((weight @ cast + 1) / (weight.sum() + 2), 1e-4, 1 - 1e-4)
        prior = float(np.clip((posterior @ counts + 1) / (counts.sum() + 2), 0.05, 0.99))
    share = np.array([1 - prior, prior])
    own = np.where(senses > 0, 1, 0)
    accuracy = share[own] * rates[np.arange(len(senses)), own] / (rates @ share)
    return posterior, accuracy, prior


def train(documents: DataFrame) -> tuple[hashed.Linear, np.ndarray, np.ndarray]:
    """The scorer, the posterior of each pattern, and the labellers' estimated accuracies."""
    found = pattern_of(documents).groupBy("pattern").agg(F.count("*").alias("n")).collect()  # at most 2^labellers rows
    counts = np.zeros(1 << len(LABELLERS))
    for r in found:
        counts[r["pattern"]] = r["n"]
    cast = (np.arange(len(counts))[:, None] >> np.arange(len(LABELLERS))) & 1
    posterior, accuracy, _ = expectation_maximisation(cast, counts, np.array([sense for sense, _ in LABELLERS]))
    order = F.xxhash64(F.lit("quality"), "doc_id")
    ids = F.broadcast(documents.where("doc_id is not null").select("doc_id").distinct().orderBy(order, "doc_id").limit(TRAIN_ROWS).select(F.col("doc_id").alias("_id")))
    docs = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.join(ids, docs["doc_id"] == ids["_id"]).select("text", order.alias("o"))

    def make():
        return lambda batch: record(y=pa.array([float(posterior[votes(t)]) for t in texts_of(batch)], pa.float64()), o=batch.column("o"), raw=pa.array([shape(t) for t in texts_of(batch)], pa.binary()))

    sample = materialise(map_batches(docs, make, "y double, o long, raw binary"), "quality-sample")
    n, good = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    model = hashed.Linear.blank(WIDTH, hashed.select(hashed.document_frequencies(sample, "raw", WIDTH, "y", LEAST), n, good, SELECTED))
    model.weights[-1] = 1.0
    model.fit(sample, "raw", "y", "o")
    return model, posterior, accuracy


def score(documents: DataFrame, model: hashed.Linear, name: str = "quality_score") -> DataFrame:
    """documents, all columns, with the probability that the text is good under `name`, which must be free."""
    schema = T.StructType([*documents.schema.fields, T.StructField(name, T.DoubleType())])
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = pa.array([model.probability(shape(t)) for t in texts_of(batch)], pa.float64())
            return pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, name])

        return each

    return map_batches(documents, make, schema)


def report(documents: DataFrame) -> DataFrame:
    model, _, _ = train(documents)
    scored = score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", F.col("quality_score").alias("score"), (F.col("quality_score") >= ACCEPT).cast("int").alias("accepted"))


def filter_documents(documents: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of documents that the scorer accepts, with their columns."""
    model, _, _ = train(documents)
    name = "quality_score"
    while name in documents.columns:
        name = f"_{name}"
    return score(documents, model, name).where(F.col(name) >= accept).drop(name)
