import numpy as np
import pyarrow as pa
import pytest

from quarry.operators import embed, knn


def test_hashed_embedding_unit_length_and_zero_vector(spark):
    df = spark.createDataFrame([(1, "alpha beta beta"), (2, ""), (3, None)], "id long, text string")
    rows = {r.id: r.embedding for r in embed.hashed_embedding(df).collect()}
    assert len(rows[1]) == 64 and np.linalg.norm(rows[1]) == pytest.approx(1.0)
    assert rows[2] == [0.0] * 64 and rows[3] == [0.0] * 64


def test_model_provider_runs_per_batch(spark):
    def encode(texts):
        return np.array([[len(t), t.count("a"), 1.0] for t in texts], dtype=float)
    df = spark.createDataFrame([(i, "a" * i) for i in range(1, 30)], "id long, text string").repartition(3)
    out = embed.embed_with_model(df, encode, dim=3)
    got = {r.id: r.embedding for r in out.collect()}
    assert got[5] == [5.0, 5.0, 1.0] and len(got) == 29
    q = out.where("id = 7").selectExpr("id AS qid", "embedding AS qvec")
    top = knn.nearest(q, out.withColumnRenamed("embedding", "vec"), 1, "l2").first()
    assert top.id == 7 and top.score == 0.0


def test_rows_with_one_id_keep_their_own_vectors(spark):
    from quarry.operators import embed
    df = spark.createDataFrame([(1, "alpha"), (1, "beta"), (2, None), (3, "")], "id long, text string")
    out = embed.hashed_embedding(df, carry=("text",))
    rows = out.collect()
    assert len(rows) == 4 and len({tuple(r.embedding) for r in rows if r.id == 1}) == 2
    assert all(sum(r.embedding) == 0 for r in rows if r.id in (2, 3))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_texts_travel_in_small_batches_and_are_counted_in_steps(spark, monkeypatch):
    texts = [(k, " ".join(f"w{(k * j) % 97}" for j in range(k % 60))) for k in range(700)] + [(700, None), (701, "a " * 500)]
    df = spark.createDataFrame(texts, "id long, text string").coalesce(1)
    whole = sorted(embed.hashed_embedding(df).collect())
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= embed.BATCH_ROWS
    monkeypatch.setattr(embed, "STEP_TOKENS", 100)
    sizes = [0, 40, 70, 0, 500, 3, 0]
    assert list(embed._steps(sizes)) == [(0, 2), (2, 2), (4, 1), (5, 2)]
    words = [[f"w{j % 7}" for j in range(n)] for n in sizes]
    parts = [embed._counted(pa.array(words[lo:lo + n], pa.list_(pa.string())), np.array(sizes[lo:lo + n]), 64)
             for lo, n in embed._steps(sizes)]
    assert (np.concatenate(parts).sum(axis=1) == sizes).all() and len(whole) == 702
