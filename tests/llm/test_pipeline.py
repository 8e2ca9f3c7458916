from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import langid, mixing, secrets, simhash


def test_stages_take_effect(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    bad = spark.createDataFrame([(10**6, "12 34 !!", "en", "src1", 8), (10**6 + 1, None, None, None, None)], docs.schema)
    kept = docs.union(bad)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, "")
        assert kept.columns == docs.columns, name
        a, b = sorted(r["doc_id"] for r in before.collect()), sorted(r["doc_id"] for r in kept.collect())
        if stage is corpus_pipeline.identify_language:
            model = langid.fit(before)
            assert b == sorted(r["doc_id"] for r in before.collect() if model.predict(r["text"])[0] != "und" and model.predict(r["text"])[1] >= 0.5)
            assert set(a) - set(b) == {10**6, 10**6 + 1}
        if stage is corpus_pipeline.drop_near_copies:
            assert b == sorted({r["component_id"] for r in simhash.near_duplicates(before).collect()}) and len(b) < len(a)
        if stage is corpus_pipeline.mask_secrets:
            assert a == b and not any(r["spans"] for r in secrets.find_secrets(kept).collect())
            assert all(r["n_chars"] == len(r["text"]) for r in kept.collect())
        if stage is corpus_pipeline.mix_sources:
            assert b == sorted(r["doc_id"] for r in mixing.mix(before).collect() for _ in range(r["copies"] if r["taken"] else 0))
    out = corpus_pipeline.encode_pieces(spark, kept, "").collect()
    assert sorted(r["doc_id"] for r in out) == b and all(r["round_trip"] for r in out) and len(rows) > 100


def test_stages_on_empty_tables_and_clashing_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    names = ["_p", "p", "_copies", "_spans", "h", "n", "fp", "doc", "tmp0", "tmp1", "TMP2", "start", "size", "copies", "_id", "keep"]
    odd = docs.withColumns({c: F.lit(i) for i, c in enumerate(names)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), "").count() == 0, name
        odd = stage(spark, odd, "")
        assert odd.columns == [*docs.columns, *names], name
        assert odd.where(" OR ".join(f"`{c}` <> {i}" for i, c in enumerate(names))).count() == 0, name
    assert corpus_pipeline.encode_pieces(spark, docs.limit(0), "").count() == 0 and corpus_pipeline.encode_pieces(spark, odd, "").count() == odd.count()
