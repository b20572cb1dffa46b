"""The pipeline: each stage on its own input, and the whole against brute force."""
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import crf, decontam, linededup, simhash
from quarry.llm.base import stored
from quarry.sources.tables import load


def test_stages_in_order(spark, sf_small):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    docs = load(spark, sf_small, "documents")
    columns, states = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, states[-1], sf_small), name)
        if name != "best_fit_packing":
            assert out.columns == columns and out.dtypes == docs.dtypes
        states.append(out)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    raw, ruled, lined, single, clean, packed = states
    field = crf.train(raw, load(spark, sf_small, "labels"))
    assert ids(ruled) == ids(crf.quality_rules(raw, field).where("kept"))
    assert ids(lined) == ids(ruled)
    want = {r.doc_id: r.kept_sha256 for r in linededup.digest(ruled).collect()}
    assert {r.doc_id: r.h for r in lined.select("doc_id", F.sha2("text", 256).alias("h")).collect()} == want
    assert all(r.n_chars == len(r.text) for r in lined.collect())
    assert ids(single) == sorted({r.component_id for r in simhash.near_duplicates(lined).collect()})
    dirty = {r.doc_id for r in decontam.contained_items(single, load(spark, sf_small, "benchmark")).collect()}
    assert ids(clean) == sorted(set(ids(single)) - dirty)
    assert sorted({r.doc_id for r in packed.collect()}) == ids(clean)
    whole = corpus_pipeline.run(spark, sf_small)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, packed.collect()))


def test_stages_take_nulls_extra_columns_and_nothing(spark, sf_small):
    docs = spark.createDataFrame(
        [(1, None, "en", None, None, "x"), (None, "", None, "s", 0, "x"), (2, "a b c " * 60, "en", "s", 9, None),
         (3, "word%d " % 7 * 80, "en", "s", 9, "x")] + [(4, " ".join(f"w{k}" for k in range(90)), "de", "s", 1, "x")] * 3,
        "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for start in (docs, docs.limit(0)):
        at = start
        for name, stage in corpus_pipeline.STAGES:
            at = stored(stage(spark, at, sf_small), name)
            if name != "best_fit_packing":
                assert at.columns == docs.columns
        assert at.count() == (1 if start is docs else 0)
