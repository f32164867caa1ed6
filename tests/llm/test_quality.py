import numpy as np
from pyspark.sql import functions as F

from leadspark.llm import quality as Q
from leadspark.llm.common import table
from tests.llm.conftest import EDGE


def test_held_against_human_labels(spark):
    """No label is used in training; all the human labels are held out."""
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    r = Q.report(docs).join(labels, "doc_id").groupBy("quality").agg(F.avg("accepted").alias("kept")).collect()
    kept = {x.quality: x.kept for x in r}
    assert kept[1] >= 0.99 and kept[0] <= 0.15


def test_filter_keeps_columns_and_edges(spark, make_docs):
    prose = [(100 + k, f"The quiet river ran past village number {k}, and people went down to it with their boats.") for k in range(40)]
    junk = [(200 + k, "### $$$ %%% buy*** now&&& " * (20 + k)) for k in range(8)] + [(300 + k, "SHOUT!! AT!! EVERYONE!! " * (15 + k)) for k in range(8)]
    docs = make_docs([*EDGE, *prose, *junk]).withColumn("quality_score", F.lit("clash"))
    kept = Q.filter_documents(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {100 + k for k in range(40)} <= ids and not ids & {200 + k for k in range(8)} and not ids & {300 + k for k in range(8)}
    assert Q.report(make_docs([])).count() == 0


def test_expectation_maximisation_recovers_accuracies():
    rng = np.random.default_rng(5)
    senses, truth = np.array([-1, -1, -1, 1, 1]), rng.random(20_000) < 0.8
    right, wrong = np.array([0.8, 0.7, 0.6, 0.9, 0.8]), np.array([0.01, 0.02, 0.01, 0.1, 0.05])
    cast = np.array([rng.random(len(truth)) < np.where(truth == (s > 0), r, w) for s, r, w in zip(senses, right, wrong, strict=True)]).T.astype(int)
    patterns, counts = np.unique(cast, axis=0, return_counts=True)
    posterior, accuracy, prior = Q.expectation_maximisation(patterns, counts.astype(float), senses)
    precision = [np.mean(truth[cast[:, j] == 1] == (s > 0)) for j, s in enumerate(senses)]
    assert np.abs(accuracy - precision).max() < 0.1 and 0.7 < prior < 0.9
    by = {tuple(p): x for p, x in zip(patterns, posterior, strict=True)}
    voted = cast.any(axis=1)
    assert np.mean([(by[tuple(c)] >= 0.5) == t for c, t in zip(cast[voted], truth[voted], strict=True)]) > 0.95


def test_measures_by_hand():
    m = Q.measures(b"AB cd# ef!! \nx y\nx y\n")
    assert m[Q.MARKS] == 1 / 13 and m[Q.CAPITALS] == 2 / 10 and m[Q.MARKED] == 1 / 7 and m[Q.SHOUTED] == 1 / 7 and m[Q.DOUBLED] == 1 / 7 and abs(m[Q.LINES] - 1 / 3) < 1e-12
    assert Q.measures(b" \n") == [] and Q.votes(b"") == 0
