import zlib

import pytest

from leadspark.llm import sharding as S
from leadspark.llm.common import table
from tests.llm.conftest import EDGE


def check(rows, docs, near):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    loads = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    mean = sum(loads) / 8
    assert max(loads) <= mean * (1 + S.EPSILON) + near and min(loads) >= mean * (1 - 8 * S.EPSILON) - near
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


@pytest.mark.parametrize("copies", [0, 600])
def test_balance_and_groups(spark, make_docs, copies):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    plain = [tuple(r) for r in docs.collect()] + [(10_000 + k, "one text that has very many copies, a third of all bytes or so. " * 30) for k in range(copies)]
    rows = S.report(make_docs(plain)).collect()
    check(rows, plain, 1000)
    place = {}
    for r in rows:
        place.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert sum(len(s) > 1 for s in place.values()) == (1 if copies else 0)  # only the group that overflows is split


def test_edges(spark, make_docs):
    rows = S.report(make_docs(EDGE)).collect()
    check(rows, EDGE, 300_000)
    assert S.report(make_docs([])).count() == 0
    out = S.shard_documents(make_docs(EDGE))
    assert out.columns == [*make_docs(EDGE).columns, "shard", "slot"] and out.count() == len(EDGE)


def test_limited_movement():
    """With room to spare, a ninth shard takes about its share and little else moves."""
    units = [(c, -1, 100 + c % 50) for c in range(0, S.CELLS, 7)]
    a, b = S.place(units, 8, 0.25), S.place(units, 9, 0.25)
    assert sum(a[k] != b[k] for k in a) < 0.25 * len(a)
