import re
from collections import defaultdict

from pyspark.sql import functions as F

from leadspark.llm import mixing as M
from leadspark.llm.common import table
from tests.llm.conftest import EDGE


def targets(sizes):
    """Water-filling by hand: sources by code point, null last, weights repeating."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: M.WEIGHTS[k % 3] for k, s in enumerate(order)}
    total, capped = M.TOTAL * sum(sizes.values()), set()
    while True:
        rest, w = total - sum(2 * sizes[s] for s in capped), sum(weight[s] for s in sizes if s not in capped)
        goal = {s: 2.0 * sizes[s] if s in capped else rest * weight[s] / w for s in sizes}
        if not (over := {s for s in sizes if s not in capped and goal[s] > 2 * sizes[s]}):
            return goal
        capped |= over


def noise(docs):
    """For each source five standard deviations of the sum of its independent trials, and a word."""
    words, sizes = defaultdict(list), {}
    for _, t, s in docs:
        words[s].append(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    sizes = {s: sum(w) for s, w in words.items()}
    goal = targets(sizes)
    part = {s: goal[s] / sizes[s] % 1 if sizes[s] else 0 for s in sizes}
    return lambda s: 1 + 5 * (part[s] * (1 - part[s]) * sum(x * x for x in words[s])) ** 0.5


def check(rows, docs, near):
    words = {(i, t, s): len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, s in docs}
    sizes = defaultdict(int)
    for i, t, s in docs:
        sizes[s] += words[i, t, s]
    goal, taken = targets(sizes), defaultdict(int)
    assert len(rows) == len(docs)
    source = {i: s for i, _, s in docs}
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - goal[s]) < 1e-6 and r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= near(s), (s, taken[s], goal[s])


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    plain = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    rows = M.report(docs).collect()
    check(rows, plain, noise(plain))
    assert sorted(rows) == sorted(M.report(docs.repartition(5)).collect())


def test_copies_depend_on_the_document_and_the_rate_only(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    trial = F.pmod(F.xxhash64(F.lit(M.SEED), "doc_id", "text"), F.lit(1 << 53)) / float(1 << 53)
    u = {r.doc_id: r.u for r in docs.select("doc_id", trial.alias("u")).collect()}
    for r in M.report(docs).where("size > 0").collect():
        rate = r.target / r.source_size
        assert r.taken == r.size * (int(rate) + (u[r.doc_id] < rate - int(rate)))


def test_edges(spark, make_docs):
    sources = [None, "b", "a", None, "b", "b", "é", "Z", "a"]
    docs = make_docs(EDGE, sources)
    rows = M.report(docs).collect()
    plain = [(i, t, s) for (i, t), s in zip(EDGE, sources, strict=True)]
    check(rows, plain, noise(plain))
    assert M.report(make_docs([])).count() == 0
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.taken // r.size for r in rows if r.size) + sum(1 for r in mixed.collect() if not (r.text or "").split())


def test_one_source_is_capped_at_its_share(spark, make_docs):
    rows = M.report(make_docs([(k, "w " * (k + 1)) for k in range(50)], ["s"] * 50)).collect()
    assert {r.target for r in rows} == {1.5 * sum(range(1, 51))} and abs(sum(r.taken for r in rows) - rows[0].target) <= noise([(k, "w " * (k + 1), "s") for k in range(50)])("s")


def test_tied_sources(spark):
    """Ties of size over weight: the water-filling is the same, whichever of the tied comes first."""
    for sizes in ({"a": 300, "b": 100}, {f"s{k}": 10 for k in range(7)}, {"a": 30, "b": 10, "c": 20, None: 900}, {"a": 3, "b": 1, "c": 2, "d": 0}, {"a": 0, "b": 0}):
        rows = M.targets(spark.createDataFrame(list(sizes.items()), "mix_source string, mix_source_size long")).collect()
        want = targets(sizes)
        assert len(rows) == len(sizes) and all(abs(r.mix_target - want[r.mix_source]) < 1e-9 for r in rows), (sizes, rows)
