import hashlib
import re

import pytest

from leadspark.llm import decontaminate as D
from leadspark.llm.common import table
from tests.llm.conftest import EDGE


def brute(docs, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    wins = {}
    for i, t in items:
        ws = cut(t)
        if ws:
            for k in range(max(1, len(ws) - window + 1)):
                wins.setdefault(tuple(ws[k : k + window]), set()).update([] if i is None else [str(i)])
    lengths, out = {len(w) for w in wins}, []
    for d, t in docs:
        ws, hit, found = cut(t), set(), set()
        for n in lengths:
            for k in range(len(ws) - n + 1):
                if (w := tuple(ws[k : k + n])) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[w]
        out.append((d, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(10, "one two three four five six seven eight nine ten eleven twelve"), (2, "Tiny item"), (3, None), (4, "..."), (None, "no id"), (None, "tiny item"), (10, "tiny ITEM"), (5, "a a a a a a a a a a a")]
TEXTS = [*EDGE, (20, "x One two three four five six seven eight nine ten y"), (21, "two three four five six seven eight nine ten eleven, twelve; tiny item"), (22, "a " * 25), (23, "one two three"), (24, "here is no id given")]


@pytest.mark.parametrize("literal,broadcast", [(20_000, 4_000_000), (0, 4_000_000), (0, 0)])
def test_edges(spark, make_docs, monkeypatch, literal, broadcast):
    monkeypatch.setattr(D, "LITERAL_WINDOWS", literal)
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", broadcast)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((tuple(r) for r in D.report(make_docs(TEXTS), items).collect()), key=str)
    assert got == brute(TEXTS, ITEMS)


def test_whole_table(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert sorted((tuple(r) for r in D.report(docs, items).collect()), key=str) == want


def test_removal(spark, make_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = make_docs(TEXTS)
    left = D.remove_documents(docs, items)
    assert left.columns == docs.columns
    bad = {r[0] for r in brute(TEXTS, ITEMS) if r[5]}
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((i for i, _ in TEXTS if i not in bad), key=str)
    texts = {r.doc_id: r.text for r in D.remove_spans(docs, items).collect()}
    assert texts[20] == "x y" and texts[21] == "" and texts[22] == "" and texts[23] == "one two three"


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.report(make_docs(TEXTS[:3]), none).where("contaminated").count() == 0
    assert D.report(make_docs([]), none).count() == 0
