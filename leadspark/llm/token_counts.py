"""Token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a word with the blank before it, or a white-space character. Under a unigram model of a public
vocabulary its tokens are those of the segmentation of the highest score. The forward score of a prefix depends on
nothing after it, so the distinct pre-tokens of a batch are walked as a trie: sorted, each shares the forward scores,
and the vocabulary entries still open, of its longest common prefix with the one before, and only new characters are
computed. The terminal counts are kept, and a document's count is the sum over its pre-tokens.

The vocabulary file gives ranks, not probabilities: rank r has probability in proportion to 1 / (r + SHIFT), the
Zipf-Mandelbrot law. Every single byte is in the vocabulary, so every text can be written.

Defined results: null and empty texts have no tokens; ties go to fewer tokens; repeated rows give one result row each;
other columns of the documents are ignored.
"""

from __future__ import annotations

import base64
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import map_batches, record, texts_of

#: A file of ranks: on each line a token in base64 and its rank.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SHIFT = 1000.0
#: Pre-tokens of which a task remembers the counts.
HELD = 400_000
PRE_TOKEN = re.compile(rb" ?[^\x09-\x0D\x20]+|[\x09-\x0D\x20]")


def vocabulary(path: str = VOCABULARY, shift: float = SHIFT) -> dict[bytes, float]:
    """The log probability of each token."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    weight = {t: 1 / (r + shift) for t, r in ranks.items()}
    total = sum(weight.values())
    return {t: float(np.log(w / total)) for t, w in weight.items()}


def prefixes(vocab: dict[bytes, float]) -> dict[bytes, float | None]:
    """Every prefix of every token: its log probability, or None where it is no token itself."""
    out: dict[bytes, float | None] = {}
    for token in vocab:
        for k in range(1, len(token)):
            out.setdefault(token[:k], None)
    return out | vocab


class Counter(dict):
    """pre-token -> (count, score)."""

    def __init__(self, table: dict[bytes, float | None]):
        super().__init__()
        self.table = table

    def learn(self, words: set[bytes]) -> None:
        """Walk the trie of the words depth first, which is sorted order."""
        best, count, opened = [0.0], [0], [[0]]  # by depth: forward score, its tokens, starts of the entries still open
        before, get = b"", self.table.get
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :], opened[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, tokens, still = -np.inf, 0, []
                for start in opened[-1]:
                    piece = word[start:end]
                    log = get(piece, 0)
                    if log == 0:  # no token begins so
                        continue
                    still.append(start)
                    if log is not None:
                        value = best[start] + log
                        if value > top or (value == top and count[start] + 1 < tokens):
                            top, tokens = value, count[start] + 1
                still.append(end)
                best.append(top)
                count.append(tokens)
                opened.append(still)
            self[word] = (count[-1], best[-1])
            before = word


def report(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_bytes, n_pretokens, n_tokens, log_prob for each row."""
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(prefixes(vocabulary(path)))  # as large as the vocabulary

    def make():
        known = Counter(shared.value)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [PRE_TOKEN.findall(t) for t in texts_of(batch)]
            if len(known) > HELD:
                known.clear()
            known.learn({w for ws in texts for w in ws} - known.keys())
            found = [[known[w] for w in ws] for ws in texts]
            return record(
                doc_id=batch.column("doc_id"), n_bytes=pa.array([sum(map(len, ws)) for ws in texts], pa.int64()), n_pretokens=pa.array(map(len, texts), pa.int64()),
                n_tokens=pa.array([sum(c for c, _ in f) for f in found], pa.int64()), log_prob=pa.array([float(sum(s for _, s in f)) for f in found], pa.float64()),
            )

        return each

    return map_batches(docs, make, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_pretokens long, n_tokens long, log_prob double")
