import math

from leadspark.llm import token_counts as C
from leadspark.llm.common import table
from tests.llm.conftest import EDGE

VOCAB = C.vocabulary()
LONGEST = max(map(len, VOCAB))


def brute(word):
    """Forward scores of one pre-token alone."""
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - LONGEST), end):
            log = VOCAB.get(word[start:end])
            if log is not None:
                score, n = best[start][0] + log, best[start][1] + 1
                if score > best[end][0] or (score == best[end][0] and n < best[end][1]):
                    best[end] = (score, n)
    return best[-1]


def check(spark, docs, rows):
    known, got = {}, {}
    for i, t in docs:
        words = C.PRE_TOKEN.findall((t or "").encode())
        for w in words:
            if w not in known:
                known[w] = brute(w)
        got.setdefault(i, []).append((len((t or "").encode()), len(words), sum(known[w][1] for w in words)))
    assert sorted((str(i), x) for i, xs in got.items() for x in xs) == sorted((str(r.doc_id), (r.n_bytes, r.n_pretokens, r.n_tokens)) for r in rows)


def test_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    check(spark, [tuple(r) for r in docs.select("doc_id", "text").collect()], C.report(docs).collect())


def test_edges(spark, make_docs):
    docs = [(i, t) for i, t in EDGE if i != 9] + [(9, "A" * 3000), (10, "é ü\n\nß\x00 the the\tthe"), (11, "antidisestablishmentarianism " * 3)]
    check(spark, docs, C.report(make_docs(docs)).collect())
    assert C.report(make_docs([])).count() == 0


def test_shared_prefixes_do_not_change_scores():
    counter = C.Counter(C.prefixes(VOCAB))
    words = {b" the", b" then", b" there", b" thereby", b"the", b"x", b" therefore"}
    counter.learn(words)
    assert {w: counter[w][0] for w in words} == {w: brute(w)[1] for w in words}
    assert all(abs(counter[w][1] - brute(w)[0]) < 1e-9 for w in words)
