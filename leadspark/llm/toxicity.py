"""Toxicity scores of deobfuscated text.

Obfuscated words are restored as sent through a noisy channel: each character of a suspicious word opens a lattice of
what was meant (leetspeak read as letters, filler dropped, repetitions collapsed, the blanks of spaced-out words
dropped), and the Viterbi path under a character trigram model of the whole corpus is the restored word. A linear
model on hashed n-grams of the restored text gives the score.

The character model counts all texts; labels are learned from a bounded sample (TRAIN_ROWS) of the labelled rows
that the split gives for training. Only the text enters a score.

Defined results: a null text is empty and gets the score of no evidence; a null doc_id counts as the empty text in
the split; rows labelled twice are toxic if any label says so, null labels are none; repeated rows give one result
row each; with no labelled rows every score is 0; words and runs of single characters are decoded whole, however long they
are, in time that follows their length; of equally likely readings the first in the lattice's order is taken.
"""

from __future__ import annotations

import functools
import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.llm import hashed
from leadspark.llm.common import map_batches, materialise, record, remainder, texts_of, words_of

#: Labelled rows to learn from at most, n-gram width, selected n-grams, documents that must hold one.
TRAIN_ROWS, WIDTH, SELECTED, LEAST = 20_000, 6, 4000, 4
THRESHOLD = 0.3
#: What a leetspeak character may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c"}
#: Characters that may be filler inside a word, and those that hide one letter.
FILLER, MASK = "._-*~'`^ ", "*"
#: Natural logarithms of the channel's probabilities: of a reading of leetspeak, of dropping filler or a repeated
#: letter or a mark at either end, of keeping what may be read otherwise, of a masked letter, and of dropping one of a mere double.
READ, DROP, KEEP, GUESS, DOUBLE = -0.7, -0.7, -4.0, -2.5, -8.0
#: The same of a blank among single characters that does part words, and of dropping a mark at a word's edge that is
#: neither filler nor repeated for effect.
BLANK, MARK = -1.5, -3.0
#: Symbols of the character model: 0 for all that is no letter, a to z, and what the other UTF-8 bytes map to.
SYMBOLS = 96
#: Bytes, about, of the words of which a task remembers the restored form.
HELD = 100_000_000

_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[128:] = 27 + (np.arange(128) // 2) % (SYMBOLS - 27)
_LETTERS = bytes(c if 97 <= c < 123 or c >= 128 else 32 for c in range(256))
_SUSPECT = re.compile(rb"[a-z\x80-\xff][^a-z\x80-\xff]+[a-z\x80-\xff]|([a-z])\1\1|^[$@0-9!|+(<*]+[a-z]|[a-z\x80-\xff][$@0-9!|+(<*]+$")
_SPACED = re.compile(rb"(?<!\S)\S(?:[ ._*-]\S){2,}(?!\S)")
_MARKS = b"$@!|+(<*"  # what may be meant as a letter, at either end of a word too
_EDGES = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _MARKS)


class CharModel:
    """Interpolated character trigrams; text starts and ends with symbol 0."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
        c2, c1 = c.sum(axis=0), c.sum(axis=(0, 1))
        p1 = (c1 + 1) / (c1.sum() + SYMBOLS)
        p2 = (c2 + 20 * p1) / (c2.sum(axis=1, keepdims=True) + 20)
        self.log = np.log((c + 20 * p2[None]) / (c.sum(axis=2, keepdims=True) + 20)).astype(np.float32)

    @functools.cached_property
    def rows(self) -> list[list[list[float]]]:
        """log as plain numbers, which a path reads one at a time."""
        return self.log.tolist()


def char_counts(documents: DataFrame) -> np.ndarray:
    """Trigram counts of the symbols of all texts; at most SYMBOLS cubed numbers reach the driver."""

    def make():
        total = np.zeros(SYMBOLS**3, np.int64)

        def each(batch: pa.RecordBatch) -> None:
            joined = b"  " + b"  ".join(texts_of(batch)).lower() + b"  "
            code = _CODE[np.frombuffer(joined, np.uint8)]
            code = code[np.concatenate(([True, True], (code[2:] > 0) | (code[1:-1] > 0)))]  # at most two 0 in a row
            at = (code[:-2] * SYMBOLS + code[1:-1]) * SYMBOLS + code[2:]
            total[:] += np.bincount(at, minlength=len(total))

        def finish() -> pa.RecordBatch:
            found = np.flatnonzero(total)
            return record(at=found, n=total[found])

        return each, finish

    rows = map_batches(documents.select(F.col("text").cast("string").alias("text")), make, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SYMBOLS**3, np.int64)
    out[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return out


@functools.cache
def _readings(c: str, repeats: int, at_edge: bool) -> tuple[tuple[str, float], ...]:
    """What a character may stand for, '' for nothing, with the channel's log probability. repeats: the length of the
    run of this character, at most 3, if it isn't the first of it, else 0; plain double letters are seldom typing for
    effect. at_edge: no letter stands before it, or none after it, so that it may be a mere mark of punctuation."""
    if c in LEET:
        found = [(x, READ) for x in LEET[c]] + [(c, KEEP)]
    elif c.isalpha():
        found = [(c, 0.0)]
    else:
        found = [(c, BLANK if c == " " else KEEP)]
    if at_edge and not c.isalnum():
        found.append(("", DROP if c in FILLER or c == "!" or repeats > 2 else MARK))
    elif c in FILLER:
        found.append(("", DROP))
    if c in MASK and not at_edge:
        found += [(x, GUESS + math.log(1 / 26)) for x in "abcdefghijklmnopqrstuvwxyz"]
    if repeats and c.isalpha():
        found.append(("", DROP if repeats > 2 and c.isascii() else DOUBLE))
    return tuple(found)


def _repeats(word: str) -> list[int]:
    """For each character the length of its run, 3 at most, and 0 for the first letter of it."""
    out = []
    for c, run in itertools.groupby(word):
        n = len(list(run))
        out += [0 if c.isalpha() else min(n, 3)] + [min(n, 3)] * (n - 1)
    return out


def _code_of(c: str) -> int:
    return int(_CODE[c.encode()[-1]])


def decode(word: str, model: CharModel) -> str:
    """The most likely meaning of an obfuscated word of any length: a Viterbi path over its lattice. A state is the
    last two symbols written, with the path that led there as a chain of (path before, character); a run of
    three or more of one letter may only stay as one or two of it. Time and memory follow the length."""
    log, steps, repeats = model.rows, {(0, 0): (0.0, None)}, _repeats(word)
    letters = [i for i, c in enumerate(word) if c.isalpha()]
    first, last = (letters[0], letters[-1]) if letters else (len(word), -1)
    for i, c in enumerate(word):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        long_run = i >= 2 and c.isalpha() and word[i - 1] == word[i - 2] == c
        for meant, cost in _readings(c, repeats[i], not first < i < last):
            if not meant:
                for state, (total, path) in steps.items():
                    if state not in after or total + cost > after[state][0]:
                        after[state] = (total + cost, path)
            elif not long_run:
                s = _code_of(meant)
                for (a, b), (total, path) in steps.items():
                    value, state = total + cost + log[a][b][s], (b, s)
                    if state not in after or value > after[state][0]:
                        after[state] = (value, (path, meant))
        steps = after
    _, path = max(((total + log[a][b][0], path) for (a, b), (total, path) in steps.items()), key=lambda x: x[0])
    out = []
    while path is not None:
        path, meant = path
        out.append(meant)
    return "".join(reversed(out))


class Restorer(dict):
    """word -> restored word, both UTF-8 and lower case. Remembers words of HELD bytes in all."""

    def __init__(self, model: CharModel):
        super().__init__()
        self.model = model
        self.bytes = 0

    def __missing__(self, word: bytes) -> bytes:
        core = word.strip(_EDGES)
        out = word
        if _SUSPECT.search(core):
            at = word.find(core)
            out = word[:at] + decode(core.decode("utf-8", "replace"), self.model).encode() + word[at + len(core) :]
        self.bytes += 200 + 2 * len(word)
        if self.bytes > HELD:
            self.clear()
            self.bytes = 0
        self[word] = out
        return out

    def text(self, text: bytes) -> bytes:
        """Restored words, space-joined. Runs of single characters are decoded from the text as it is, so that their
        leetspeak and masks are read in their lattice; what is left is restored word by word."""
        joined, out, at = b" ".join(words_of(text)), [], 0
        for run in _SPACED.finditer(joined):
            if re.search(rb"[a-z]", run[0]):
                out += map(self.__getitem__, joined[at : run.start()].split())
                out.append(decode(run[0].decode("utf-8", "replace"), self.model).encode())
                at = run.end()
        out += map(self.__getitem__, joined[at:].split())
        return b" ".join(out)


def plain(text: bytes) -> bytes:
    """Letters only, words between single spaces."""
    return b" " + b" ".join(text.translate(_LETTERS).split()) + b" "


def train(documents: DataFrame, labels: DataFrame, is_train: Column) -> tuple[CharModel, hashed.Linear]:
    """is_train: of the labels' doc_id."""
    chars = CharModel(char_counts(documents))
    order = F.xxhash64(F.lit("toxicity"), "doc_id")
    known = labels.where(is_train & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = F.broadcast(known.orderBy(order, "doc_id").limit(TRAIN_ROWS).select(F.col("doc_id").alias("_id"), "toxic"))
    docs = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.join(sample, docs["doc_id"] == sample["_id"]).select("text", "toxic", order.alias("o"))
    shared = documents.sparkSession.sparkContext.broadcast(chars)

    def make():
        restorer = Restorer(shared.value)
        return lambda batch: record(y=batch.column("toxic"), o=batch.column("o"), restored=pa.array([plain(restorer.text(t)) for t in texts_of(batch)], pa.binary()))

    restored = materialise(map_batches(docs.withColumn("toxic", F.col("toxic").cast("double")), make, "y double, o long, restored binary"), "toxicity-sample")
    n, positives = restored.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    selected = hashed.select(hashed.document_frequencies(restored, "restored", WIDTH, "y", LEAST), n, positives, SELECTED)
    model = hashed.Linear.blank(WIDTH, selected)
    model.weights[-1] = -40.0
    model.fit(restored, "restored", "y", "o")
    return chars, model


def score(documents: DataFrame, chars: CharModel, model: hashed.Linear) -> DataFrame:
    """doc_id and score for each row."""
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast((chars, model))

    def make():
        chars, model = shared.value
        restorer = Restorer(chars)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = [model.probability(plain(restorer.text(t))) for t in texts_of(batch)]
            return record(doc_id=batch.column("doc_id"), score=pa.array(scores, pa.float64()))

        return each

    return map_batches(docs, make, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    held = remainder(F.col("doc_id"), 4) == 2
    scored = score(documents, *train(documents, labels, ~held))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
