import itertools

import pytest
from pyspark.sql import functions as F

from leadspark.llm import toxicity as T
from leadspark.llm.common import table
from tests.llm.conftest import EDGE


@pytest.fixture(scope="module")
def chars(spark):
    return T.CharModel(T.char_counts(table(spark, "/root/testdata/sf0.01", "documents")))


def test_restoring(chars):
    restored = T.Restorer(chars)
    for sent, meant in [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("cl0wn", "clown"), ("p@th3tic", "pathetic"), ("tr4sh!!", "trash"), ("diisgusting", "diisgusting"), ("wooorthless", "worthless")]:
        assert restored.text(sent.encode()).decode() == meant, sent
    assert restored.text(b"you i d i o t there") == b"you idiot there"
    for clean in ("the end, it was. Plain words - and a list | of", "mail me a.b@c.org", "12.5 and 3x"):
        assert restored.text(clean.encode()).split()[0] == clean.lower().encode().split()[0]


def test_decode_against_all_paths(chars):
    """The Viterbi path is as good as the best of all paths."""
    import itertools

    word = "cl0w-n"
    best = -1e9
    for path in itertools.product(*(T._readings(c, r, False) for c, r in zip(word, T._repeats(word), strict=True))):
        a = b = 0
        total = 0.0
        for meant, cost in path:
            total += cost
            if meant:
                s = int(T._CODE[meant.encode()[-1]])
                total += float(chars.log[a, b, s])
                a, b = b, s
        best = max(best, (total := total + float(chars.log[a, b, 0])))
        if total == best:
            text = "".join(m for m, _ in path)
    assert T.decode(word, chars) == text


def test_held_out_accuracy(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    r = T.report(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").groupBy("toxic").agg(F.avg("predicted").alias("said"), F.count("*").alias("n")).collect()
    said = {x.toxic: x.said for x in r}
    assert said[1] >= 0.85 and said[0] <= 0.01


def test_edges(spark, make_docs):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, None), (4, 1, 1), (None, 0, 1), (99, 0, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    rows = T.report(make_docs(EDGE), labels).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert T.report(make_docs([]), labels).count() == 0
    none = T.report(make_docs(EDGE), labels.where("false")).collect()
    assert {r.predicted for r in none} == {0}


def test_words_and_runs_of_any_length(spark):
    """Leetspeak at the first, middle and last place; marks at an edge; runs far beyond one word's length."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    r = T.Restorer(T.CharModel(T.char_counts(docs)))
    assert [r[w] for w in (b"idio7", b"1diot", b"id1ot", b"i.d.i.o.t", b"iiidiiiooot")] == [b"idiot"] * 5
    assert [T.plain(r[w]) for w in (b"que!!", b"the***", b"the.", b"mail8")] == [T.plain(w) for w in (b"que", b"the", b"the", r[b"mail8"])]
    letters = "youareanidiot" * 40
    spaced = r.text(" ".join(letters).encode()).decode()
    assert spaced.replace(" ", "") == letters and max(map(len, spaced.split())) > 3
    assert r.text(("i" * 5000 + "d" * 5000).encode()) in (b"id", b"iid", b"iidd", b"idd")


def test_viterbi_against_all_paths(spark):
    """Of all readings of a short word's lattice the decoded one is the best."""
    m = T.CharModel(T.char_counts(table(spark, "/root/testdata/sf0.001", "documents")))
    for word in ("1d1o7", "a5.s", "b0$$", "w0o0"):
        spots, letters = T._repeats(word), [i for i, c in enumerate(word) if c.isalpha()]
        lists = [T._readings(c, spots[i], not letters[0] < i < letters[-1]) for i, c in enumerate(word)]

        def value(path):
            a = b = 0
            total = sum(cost for _, cost in path)
            for x, _ in path:
                if x:
                    s = T._code_of(x)
                    total, a, b = total + m.rows[a][b][s], b, s
            return total + m.rows[a][b][0]

        best = max(itertools.product(*lists), key=value)
        assert abs(value(best) - max(map(value, [p for p in itertools.product(*lists) if "".join(x for x, _ in p) == T.decode(word, m)]))) < 1e-9
