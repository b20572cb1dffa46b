"""Quality discriminant and toxicity chain: held-out accuracy and edge cases."""
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

from quarry.llm import base, qda, toxicity
from quarry.sources.tables import load

SF = "/root/testdata/sf0.01"


def test_scores_on_held_out_documents(spark):
    docs, labels = load(spark, SF, "documents"), load(spark, SF, "labels")
    rows = qda.quality_scores(docs, labels).join(labels, "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.93 * len(held)


def test_scores_are_graded_and_calibrated(spark):
    docs, labels = load(spark, SF, "documents"), load(spark, SF, "labels")
    rows = [r for r in qda.quality_scores(docs, labels).join(labels, "doc_id").collect() if r.held_out]
    p = np.clip([r.score for r in rows], 1e-12, 1 - 1e-12)
    y = np.array([r.quality for r in rows])
    loss = -np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))
    share = y.mean()
    assert loss < 0.6 * -(share * np.log(share) + (1 - share) * np.log(1 - share))  # far better than the share of class 1
    assert np.mean((p > 1e-9) & (p < 1 - 1e-9)) > 0.8


def test_the_temperature_is_the_one_with_the_least_loss_on_other_folds(spark):
    rng = np.random.default_rng(9)
    n = 900
    y = rng.integers(0, 2, n)
    fold = rng.choice([0, 1, 3], n)
    x = rng.normal(size=(n, 1)) * 1.5 + np.where(y, 8.0, 0.0)[:, None] + np.zeros((n, qda.D))
    x += rng.normal(size=x.shape) * 0.05  # statistics that say the same many times
    cols = [f"x{i}" for i in range(qda.D)]
    rows = spark.createDataFrame([(int(a), int(b), *map(float, v)) for a, b, v in zip(y, fold, x)],
                                 "y int, fold int, " + ", ".join(f"{c} double" for c in cols))
    of = lambda keep: qda.Discriminant(
        [int((keep & (y == k)).sum()) for k in (0, 1)], [x[keep & (y == k)].sum(axis=0) for k in (0, 1)],
        [x[keep & (y == k)].T @ x[keep & (y == k)] for k in (0, 1)])
    models = {f: of(fold != f) for f in (0, 1, 3)}
    d = np.zeros(n)
    for f, m in models.items():
        d[fold == f] = m.log_odds(x[fold == f])
    counts = [(y == 0).sum(), (y == 1).sum()]
    target = np.where(y == 1, (counts[1] + 1) / (counts[1] + 2), 1 / (counts[0] + 2))
    loss = [-(target * np.log(q) + (1 - target) * np.log1p(-q)).sum() for q in
            (np.clip(1 / (1 + np.exp(-d / t)), 1e-300, 1 - 1e-16) for t in qda.TEMPERATURES)]
    assert qda._temperature(rows, models, counts) == qda.TEMPERATURES[int(np.argmin(loss))] > 1


def test_held_out_labels_are_not_used(spark):
    docs, labels = load(spark, SF, "documents"), load(spark, SF, "labels")
    kept = labels.where("pmod(crc32(cast(doc_id as string)), 4) != 2")
    a = {r.doc_id: r.score for r in qda.quality_scores(docs, labels).collect()}
    b = {r.doc_id: r.score for r in qda.quality_scores(docs, kept).collect()}
    assert max(abs(a[d] - b[d]) for d in a) < 1e-9


def test_discriminant_equals_densities_written_out():
    rng = np.random.default_rng(5)
    x = [rng.normal(size=(80, qda.D)), rng.normal(1, 2, size=(50, qda.D))]
    model = qda.Discriminant([80, 50], [v.sum(axis=0) for v in x], [v.T @ v for v in x], 0.2)
    z = rng.normal(size=(10, qda.D))
    centre, scale = np.concatenate(x).mean(axis=0), np.concatenate(x).std(axis=0)
    y = [(v - centre) / scale for v in x]
    within = sum(len(v) / 130 * v.var(axis=0) for v in y)
    logs = []
    for v in y:
        cov = 0.8 * np.cov(v.T, bias=True) + 0.2 * np.diag(within) + qda.FLOOR * np.eye(qda.D)
        d = (z - centre) / scale - v.mean(axis=0)
        logs.append(np.log(len(v) / 130) - 0.5 * np.linalg.slogdet(cov)[1]
                    - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(model.score(z), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_statistics_do_not_depend_on_blocks():
    texts = ["a b c", "", "x x x x\ny!! #", "é" * 300, "one two three " * 90, "\n\n"]
    data, offsets = base.byte_rows(pa.array([t.encode() for t in texts], pa.binary()))
    whole = qda.document_stats(data, offsets)
    parts = np.concatenate([qda.document_stats(data[offsets[k]:offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]))
                            for k in range(len(texts))])
    assert np.allclose(whole, parts) and np.isfinite(whole).all()


def edge_docs(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("score", T.StringType()), T.StructField("y", T.IntegerType())])
    rows = [Row(1, None, "a", 1), Row(None, "", "a", 1), Row(2, "word " * 90_000, None, 1), Row(2, "word " * 90_000, "a", 2),
            Row(3, "you idiot", "a", None)]
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("labels", [[], [(2, 1, 0)], [(1, 0, 1), (2, 1, 0), (2, 1, 0), (3, 0, 1), (3, None, None), (None, 1, 0)]])
def test_edges(spark, labels):
    docs = edge_docs(spark)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = qda.quality_scores(docs, table).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 2, 2, 3] and all(0 <= r.score <= 1 for r in got)
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert qda.quality_scores(docs.limit(0), table).count() == 0
    chain = toxicity.train(docs, table)
    got = toxicity.toxicity(docs, chain).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 2, 2, 3] and all(0 <= r.toxic_score <= 1 for r in got)
    assert toxicity.toxicity(docs.limit(0), chain).count() == 0


def test_toxicity_of_documents_that_the_fit_has_not_seen(spark):
    sf = "/root/testdata/sf0.1"
    labels = load(spark, sf, "labels")
    docs = load(spark, sf, "documents").repartition(8)
    chain = toxicity.train(docs, labels.where("doc_id % 3 != 0"))
    rows = toxicity.toxicity(docs, chain).join(labels.where("doc_id % 3 = 0"), "doc_id", "inner") \
        .select(labels.toxic.alias("label"), "quality", "toxic_score").collect()
    hits = [r.toxic_score >= toxicity.THRESHOLD for r in rows if r.label == 1 and r.quality == 1]
    false = [r.toxic_score >= toxicity.THRESHOLD for r in rows if r.label == 0]
    assert sum(hits) >= 0.9 * len(hits) and sum(false) <= 0.01 * len(false)


def test_chain_uses_earlier_categories():
    rng = np.random.default_rng(6)
    terms = toxicity.Terms(["bad", "sto*"])
    x = np.hstack([rng.integers(0, 2, (400, 2)).astype(float), np.zeros((400, 2))])
    labels = np.stack([x[:, 0], x[:, 0], x[:, 0], x[:, 0]], axis=1)
    chain = toxicity.fit_chain(terms, x, labels, np.arange(400) % toxicity.FOLDS)
    assert [len(w) for w in chain.weights] == [5, 6, 7, 8]
    assert chain.weights[3][4:7].max() > 0
    p = chain.probabilities(terms.vectors([b"bad", b"good stone"]))
    assert (p[0] > 0.9).all() and (p[1] < 0.1).all()


def test_terms_are_words_and_beginnings():
    t = toxicity.Terms(["bad", "sto*", "stone"])
    v = t.vector("Stone, BAD stop! stone".encode())
    assert v.tolist() == [1, 1, 1, 1, 1, 1]
    assert t.vector(b"").tolist() == [0] * 6
