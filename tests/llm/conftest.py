import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, hash string, items string, shard_x int, words array<string>"


@pytest.fixture()
def make_docs(spark):
    """Documents with extra columns whose names clash with the operators' own."""

    def make(texts, sources=None):
        rows = [(i, t, "en", (sources[k] if sources else f"s{k % 3}"), len(t or ""), 1, "h", "x", 7, ["w"]) for k, (i, t) in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


#: Null, empty, blank, ties, a repeated row, a null id and a very long text.
EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "same words here again"), (5, "same words here again"), (5, "same words here again"), (None, "no id here"), (8, "long word " * 20000), (9, "A" * 50000)]
