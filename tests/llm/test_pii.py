import hashlib
import math
import re
from collections import Counter

from leadspark.llm import pii as P
from leadspark.llm.common import table
from tests.llm.conftest import EDGE

RE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(m):
    d = [int(c) for c in m if c.isdigit()]
    return 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d))) % 10 == 0


KEEP = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": luhn, "phone": lambda m: 10 <= sum(c.isdigit() for c in m) <= 15}


def brute(docs):
    out = []
    for i, t in docs:
        found = sorted((m.start(), k, m.end(), kind) for k, kind in enumerate(RE) for m in re.finditer(RE[kind], t or "", re.A) if KEEP[kind](m[0]))
        text = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in found)
        out.append((i, *(sum(f[3] == kind for f in found) for kind in RE), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


TEXTS = [
    *EDGE,
    (20, "Write é to a.b@c-d.example.com_x@y.z, 1.2.3.4.5.6.7.8 or 256.1.1.1 or 001.002.03.0255"),
    (21, "4539 1488 0343 6467 and 4539148803436467 and 4539148803436468, 1 2 3 4 5 6 7 8 9 0 1 2 3 4"),
    (22, "call +1 (988) 555-2485 4539148803436467 or +12 or +123456789012345678 now"),
    (23, "a@b a@b. a@b.c @x.y x@@y.z ü@ü.de 1.2.3 1..2.3.4"),
    (24, "1 " * 20000 + "+1" * 5000 + "a.b" * 10000 + "@" + "9." * 20000),
    (25, "+" + "1 (" * 3000 + " 12345678901234567890123456789012345678901234567890.1.1.1"),
]


def test_base(spark, make_docs):
    got = P.report(make_docs(TEXTS)).select("doc_id", *(f"n_{k}" for k in RE), "base_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(TEXTS)


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = P.report(docs).select("doc_id", *(f"n_{k}" for k in RE), "base_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_disclosing_terms(spark, make_docs):
    """A nickname that shows up beside one address only gives it away; common words don't."""
    texts = [(k, f"number {k}: the Zorblax writes from zed@x.org today") for k in range(5)]
    texts += [(10 + k, f"the mail of user{k}@y.org number {k} writes today from home") for k in range(40)]
    docs = make_docs(texts)
    found = {r.doc_id: r for r in P.report(docs).collect()}
    assert [found[k].n_term for k in range(5)] == [1] * 5 and all(found[10 + k].n_term == 0 for k in range(40))
    assert found[0].spans == "term:14:21,email:34:43"
    clean = {r.doc_id: r.text for r in P.sanitise(docs).collect()}
    assert clean[0] == "number 0: the [term] writes from [email] today" and clean[12] == "the mail of [email] number 2 writes today from home"
    assert {r.doc_id: r.text for r in P.sanitise(docs, remove_terms=True).collect()}[1] == "number 1: the  writes from [email] today"


def test_terms_without_a_broadcast(spark, make_docs, monkeypatch):
    texts = [(k, f"number {k}: the Zorblax writes from zed@x.org today") for k in range(5)] + [(10 + k, f"the {k}") for k in range(20)]
    want = sorted(map(str, P.report(make_docs(texts)).collect()))
    monkeypatch.setattr(P, "BROADCAST_ROWS", 0)
    assert sorted(map(str, P.report(make_docs(texts)).collect())) == want


def disclosing(docs):
    """The disclosing terms by hand."""
    low = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
    n, df, joint, ents = len(docs), Counter(), Counter(), Counter()
    for _, t in docs:
        t = t or ""
        df.update({low(w) for w in re.findall(P.TERM[:-1], t)})
        spans = sorted((m.start(), m.end(), kind, m[0]) for kind in RE for m in re.finditer(RE[kind], t, re.A) if KEEP[kind](m[0]))
        if not spans:
            continue
        chars, held = list(t), set()
        for a, b, kind, found in spans:
            chars[a:b] = " " * (b - a)
            digits = re.sub("[^0-9]", "", found)
            group = {"email": found.split("@")[-1].lower(), "ip": ".".join(found.split(".")[:2]), "card": digits[:6], "phone": digits[:4]}[kind]
            held |= {(kind, found), (kind, "group", group)}
        ents.update(held)
        joint.update((e, w) for e in held for w in {low(w) for w in re.findall(P.TERM[:-1], "".join(chars))})
    out = set()
    for (e, w), both in joint.items():
        p = ents[e] / n
        given = (both + P.SMOOTH * p) / (df[w] + P.SMOOTH)
        if p <= 2**-P.LEAST_BITS and (math.log2(given) - math.log2(p)) / -math.log2(p) >= P.DISCLOSURE - 1e-12:
            out.add(w)
    return out


def test_terms_of_the_whole_table_by_hand(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    plain = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = disclosing(plain)
    assert want and {r.term for r in P.disclosures(docs, P._scan(docs)).collect()} == want
    text = dict(plain)
    for r in P.report(docs).collect():
        spans = [(int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k == "term"]
        assert len(spans) == r.n_term
        for a, b in spans:
            assert "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text[r.doc_id][a:b]) in want


def test_empty(spark, make_docs):
    assert P.report(make_docs([])).count() == 0


def test_disclosing_terms_stand_anywhere(spark, make_docs):
    """Far from the address, twice in a text, and in texts that don't hold the address."""
    far = " the plain words go on" * 30
    texts = [(k, f"number {k}: zed@x.org writes{far}, says Zorblax") for k in range(30)]
    texts += [(100 + k, f"the mail of user{k}@y.org number {k} writes and says: the plain words go on") for k in range(240)]
    docs = make_docs([*texts, (60, f"zorblax{far} and ZORBLAX again")])
    found = {r.doc_id: r for r in P.report(docs).collect()}
    assert [found[k].n_term for k in range(30)] == [1] * 30 and all(found[100 + k].n_term == 0 for k in range(240))
    assert found[60].n_term == 2 and found[60].spans.startswith("term:0:7,term:")
    assert {r.doc_id: r.text for r in P.sanitise(docs).collect()}[60] == f"[term]{far} and [term] again"
