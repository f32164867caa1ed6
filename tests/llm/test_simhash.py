import numpy as np
import pytest
import xxhash

from leadspark.llm import simhash as H
from leadspark.llm.common import table
from tests.llm.conftest import EDGE


def one(text):
    ws = (text or "").encode().lower().split()
    shingles = [b" ".join(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))] if ws else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def roots(fps):
    """Root of each fingerprint, by all pairs."""
    left, comp = set(fps), {}
    while left:
        seed = min(left)
        todo, group = [seed], {seed}
        left.discard(seed)
        while todo:
            x = todo.pop()
            near = {y for y in left if (x ^ y).bit_count() <= 3}
            left -= near
            group |= near
            todo += near
        comp |= dict.fromkeys(group, seed)
    return comp


def brute(docs):
    fp = [one(t) for _, t in docs]
    comp = roots(fp)
    least = {}
    for (i, _), f in zip(docs, fp, strict=True):
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    return sorted(((i, f"{f:016x}", least.get(comp[f])) for (i, _), f in zip(docs, fp, strict=True)), key=str)


def test_edges(spark, make_docs):
    docs = [*EDGE, (30, "one two"), (31, "ONE\ttwo"), (32, "a b c"), (33, "é b c d")]
    assert sorted((tuple(r) for r in H.report(make_docs(docs)).collect()), key=str) == brute(docs)
    assert H.report(make_docs([])).count() == 0
    kept = H.deduplicate(make_docs(docs))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({c for _, _, c in brute(docs)} | {None}, key=str)


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    assert sorted((tuple(r) for r in H.report(docs).collect()), key=str) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("hot", [512, 8])
def test_links_against_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(H, "HOT", hot)
    rng = np.random.default_rng(7)
    fps = set()
    for base in rng.integers(0, 1 << 63, 12, dtype=np.uint64):
        for _ in range(25):
            x = int(base)
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
            fps.add(x - (1 << 64) if x >> 63 else x)
    u = lambda x: x % (1 << 64)
    want = {(a, b) for a in fps for b in fps if a < b and (u(a) ^ u(b)).bit_count() <= 3}
    got = H.links(spark.createDataFrame([(x,) for x in fps], "fp long"))
    assert {tuple(r) for r in got.collect()} == want


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 105), (105, 103)]
    got = dict(map(tuple, H.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in (100, 101, 103, 105)}


def test_deduplicate_keeps_one_row_of_each_component(spark, make_docs):
    """Null ids beside others and alone, one id with several texts, repeated rows: no component is lost, none stays twice."""
    texts = ["alpha beta gamma delta", "some other words entirely", "a third text is here", "the fourth one of them", "fifth of all the texts"]
    docs = [(None, texts[0]), (1, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (7, texts[4]), (3, texts[4]), (2, None), (2, "")]
    docs += [(9, "one id with two texts"), (9, "the second text of nine")]
    kept = sorted(((r.doc_id, r.text or "") for r in H.deduplicate(make_docs(docs)).collect()), key=str)
    want = [(1, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (3, texts[4]), (2, ""), (9, "one id with two texts"), (9, "the second text of nine")]
    assert kept == sorted(want, key=str)


def test_only_counted_tables_are_broadcast(spark, monkeypatch, make_docs):
    """66 signatures come of a fingerprint, so a file within Spark's limit may not be broadcast: the driver would hold them all."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    nodes = spark.createDataFrame([(k * 7919,) for k in range(100)], "fp long").localCheckpoint()
    docs = make_docs([(k, f"text {k % 5} of some words {k % 3}") for k in range(20)])
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    assert "Broadcast" not in plan(H.links(nodes)) and "BroadcastHashJoin" in plan(H.cluster(docs))
    want = sorted((tuple(r) for r in H.report(docs).collect()), key=str)
    monkeypatch.setattr(H, "BROADCAST_ROWS", 0)
    assert "Broadcast" not in plan(H.cluster(docs)) and "Broadcast" not in plan(H.deduplicate(docs))
    assert sorted((tuple(r) for r in H.report(docs).collect()), key=str) == want == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
