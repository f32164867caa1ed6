import math
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leadspark.llm import brown as B
from leadspark.llm.common import BATCH_ROWS, map_batches, materialise, record, remainder, table, words_of
from tests.llm.conftest import EDGE


SHORT = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]


def tokens(text):
    return [*(text or "").encode().lower().split(), B.END]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def base(docs):
    c = Counter(w for i, t in docs if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {(i, t): (held(i), len(ws := tokens(t)), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, t in docs}


@pytest.mark.parametrize("local", [1 << 16, 40])
def test_base_and_edges(spark, make_docs, monkeypatch, local):
    monkeypatch.setattr(B, "LOCAL", local)
    monkeypatch.setattr(B, "FREQUENT", 20)
    docs = [*EDGE, *((100 + k, f"the word number{k} and the word é{k % 3} \t more") for k in range(30))]
    want, got = base(docs), B.report(make_docs(docs)).collect()
    assert len(got) == len(docs)
    by = {}
    for (i, t), w in want.items():
        by.setdefault(i, []).append((t, w))
    for r in got:
        w = by[r.doc_id][0][1]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and abs(r.base_score - w[4]) < 1e-6 * max(1, abs(w[4]))


def test_empty(spark, make_docs):
    assert B.report(make_docs([])).count() == 0
    alone = next(k for k in range(100) if held(k))
    r = B.report(make_docs([(alone, "x")])).first()
    assert r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0


def small(make_docs):
    texts = [(100 + k, f"the cat{k % 9} sat on a mat{k % 5} and the dog{k % 7} ran{k % 4} to a tree{k % 11} \u00e9{k % 3} X{k}") for k in range(90)]
    return [*texts, *EDGE[:8]]


@pytest.mark.parametrize("local", [1 << 16, 15])
def test_classes_and_score_by_hand(spark, make_docs, monkeypatch, local):
    """Every word outside the core has the class that its own neighbours favour most; the score is that of the bigram model."""
    monkeypatch.setattr(B, "FREQUENT", 8)
    monkeypatch.setattr(B, "LOCAL", local)
    docs = small(make_docs)
    frame, is_train = make_docs(docs), remainder(F.col("doc_id"), 7) != 2
    m = B.train(frame, is_train)
    training = [tokens(t) for i, t in docs if not held(i)]
    counts = Counter(w for t in training for w in t)
    core = [B.END, *sorted((w for w in counts if w != B.END), key=lambda w: (-counts[w], w))[:8]]
    assert m.local[:9] == core
    place = lambda w: core.index(w) if w in core else len(core) + B.suffix_bucket(w)
    bigrams = np.zeros((len(core) + B.BUCKETS,) * 2)
    for t in training:
        for a, b in zip([B.END, *t], t, strict=False):
            bigrams[place(a), place(b)] += 1
    of, k = B.exchange(bigrams), B.CLASSES + 1
    slots = {w: np.zeros(2 * k) for w in counts if w not in core}
    for t in training:
        for x, w, y in zip([B.END, *t], t, [*t[1:], None], strict=False):
            if w in slots:
                slots[w][of[place(x)]] += 1
                slots[w][k + of[place(y)]] += 1
    gains = B.criterion(of, bigrams)
    want = {w: (counts[w], int(np.argmax([sum(slots[w][s] * gains[s, c] for s in np.flatnonzero(slots[w])) for c in range(k)]))) for w in slots}
    got = {bytes(r.word): (r.n, r["class"]) for r in m.rest.collect()}
    assert got == want
    classes = {w: int(of[core.index(w)]) for w in core} | {w: c for w, (_, c) in want.items()}
    class_of = lambda w: classes.get(w, int(of[len(core) + B.suffix_bucket(w)]))
    table, n, v = np.zeros((k, k)), np.zeros(k), np.zeros(k)
    for t in training:
        for a, b in zip([B.END, *t], t, strict=False):
            table[class_of(a), class_of(b)] += 1
    for w, c in counts.items():
        n[class_of(w)] += c
        v[class_of(w)] += 1
    share = (n + 1) / (n + 1).sum()
    p = (table + k * share) / (table.sum(axis=1, keepdims=True) + k)
    assert np.allclose(p.sum(axis=1), 1)
    for c in range(1, k):  # of a class: all its words, and one place for those never seen
        assert math.isclose(sum((counts[w] + 1) / (n[c] + v[c] + 1) for w in classes if classes[w] == c) + 1 / (n[c] + v[c] + 1), 1)
    scores = {(i, t): sum(math.log10(p[class_of(a), class_of(b)] * (counts[b] + 1) / (n[class_of(b)] + v[class_of(b)] + 1)) for a, b in zip([B.END, *tokens(t)], tokens(t), strict=False)) for i, t in docs}
    by = {i: scores[i, t] for i, t in docs}
    rows = B.report(frame).collect()
    assert len(rows) == len(docs) and all(abs(r.score - by[r.doc_id]) < 1e-6 * max(1, abs(r.score)) for r in rows)


def test_what_an_executor_holds(spark, make_docs, monkeypatch):
    """Batches of every written step are as short as the slices, texts are joined without words; the session's settings return."""
    sizes, handed = [], []

    def written(df, name):
        sizes.extend(r.n for r in spark.range(0, 3000, 1, 1).mapInArrow(lambda it: (record(n=[b.num_rows]) for b in it), "n long").collect())
        return materialise(df, name)

    def mapped(df, *rest):
        handed.append(df.columns)
        return map_batches(df, *rest)

    monkeypatch.setattr(B, "materialise", written)
    monkeypatch.setattr(B, "map_batches", mapped)
    before = [spark.conf.get(k) for k in SHORT]
    assert B.report(make_docs(EDGE)).count() == len(EDGE)
    assert max(sizes) <= BATCH_ROWS
    assert [c for c in handed if "found" in c] == [["doc_id", "train", "n_tokens", "n_known", "logs", "classes", "ends", "uses", "found"]]
    assert before == [spark.conf.get(k) for k in SHORT]


def test_words_of_slices():
    """Words and suffix buckets of whole slices are those of each text and word alone."""
    texts = ["", None, "ab", "CD e\u00c9F", " x", "y ", "\u00a0\x1c\x85 \x0b\x0cz\r", "\t\n", "\x00 long-word-Here", None, "\u2003a b\U0001f600C abcd"]
    for column in (pa.array(texts), pa.array(["no", *texts, "no"]).slice(1, len(texts)), pa.array(texts[:2]), pa.array([], pa.string())):
        want = [words_of((t or "").encode()) for t in column.to_pylist()]
        words, sizes = B.split(column)
        assert words.to_pylist() == [w for ws in want for w in ws] and sizes.tolist() == [len(ws) for ws in want]
        assert B.suffix_buckets(words).tolist() == [B.suffix_bucket(w) for w in words.to_pylist()]


def test_what_a_run_reads_and_leaves(spark, make_docs, monkeypatch):
    """Texts are cut into words twice only; shuffled files are gone once their step has run; counts handed on early add up."""
    handed = []

    def mapped(df, *rest):
        handed.append(df.columns)
        return map_batches(df, *rest)

    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for i in range(files.size()) if (f := files.apply(i).getName()).startswith("shuffle_")}

    monkeypatch.setattr(B, "map_batches", mapped)
    docs, order = make_docs(small(make_docs)), lambda r: (str(r.doc_id), r.n_tokens)
    before = shuffled()
    want = sorted(B.report(docs).collect(), key=order)
    assert sum("text" in c for c in handed) == 2
    until = time.time() + 20
    while (left := shuffled() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    monkeypatch.setattr(B, "HELD", 0)
    got = sorted(B.report(docs).collect(), key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want] and np.allclose([r[5:] for r in got], [r[5:] for r in want])


def test_exchange_against_brute_force():
    """No single move raises the likelihood any more, and separate vocabularies end in separate classes."""
    rng = np.random.default_rng(1)
    m = np.zeros((31, 31))
    for _ in range(4000):
        lang = rng.integers(0, 2) * 15
        m[1 + lang + rng.integers(0, 15), 1 + lang + rng.integers(0, 15)] += 1
    m[0, 1:] = m[1:, 0] = 3
    of = B.exchange(m, classes=2, rounds=50)
    f = lambda x: float(B._xlogx(x).sum())

    def likelihood(of):
        o = np.eye(3)[of]
        t = o.T @ m @ o
        return f(t) - f(t.sum(axis=0)) - f(t.sum(axis=1))

    best = likelihood(of)
    for u in range(1, 31):
        for c in (1, 2):
            other = of.copy()
            other[u] = c
            assert likelihood(other) <= best + 1e-6
    assert len(set(of[1:16])) == 1 and len(set(of[16:])) == 1 and of[1] != of[16]


def test_beats_the_base_on_held_out_texts(spark):
    r = B.report(table(spark, "/root/testdata/sf0.01", "documents")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > 0.95 * r[1]
