import zlib
from collections import Counter

import corpus_pipeline as P
from leadspark.llm import decontaminate, mixing, quality
from leadspark.llm.common import table
from tests.llm.conftest import EDGE
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_mixing import check as check_mix
from tests.llm.test_mixing import noise
from tests.llm.test_sharding import check as check_shards
from tests.llm.test_simhash import brute as clusters


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = start = table(spark, sf, "documents")
    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    for name, stage in P.STAGES:
        before, docs = docs, stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        old = [tuple(r) for r in before.select("doc_id", "text", "source").collect()]
        new = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
        if name != "sharding":
            assert docs.columns == start.columns
        pairs = [(i, t) for i, t, _ in old]
        if name == "quality classifier":
            accepted = {r.doc_id for r in quality.report(before).collect() if r.accepted}
            assert Counter(new) == Counter(o for o in old if o[0] in accepted) and 0.7 < len(new) / len(old) < 0.95
        elif name == "SimHash near-dedup":
            keep = {c for _, _, c in clusters(pairs)}
            assert Counter(new) == Counter(o for o in old if o[0] in keep)
        elif name == "benchmark decontamination":
            bad = {r[0] for r in contaminated(pairs, items) if r[5]}
            assert bad and Counter(new) == Counter(o for o in old if o[0] not in bad)
        elif name == "mixing sources to target weights":
            times = Counter(i for i, _, _ in new)
            rows = mixing.report(before).collect()
            assert all(times[r.doc_id] * r.size == r.taken for r in rows)
            check_mix(rows, old, noise(old))
        else:
            rows = [type("R", (), {"doc_id": r.doc_id, "size": len(r.text.encode()) + 1, "text_crc32": zlib.crc32(r.text.encode()), "shard": r.shard, "slot": r.slot}) for r in docs.collect()]
            check_shards(rows, pairs, 10_000)


def test_run(spark):
    out = P.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"] and out.count() > 50


def test_edges(spark, make_docs, tmp_path):
    (tmp_path / "x").mkdir()
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (EDGE, []):
        docs = make_docs(rows)
        for _, stage in P.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[-2:] == ["shard", "slot"] and docs.count() <= 3 * len(rows)
    assert decontaminate.WINDOW == 10
