"""The pipeline stage by stage: each takes what the one before kept."""

from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from quillmill.llm import packing, pii, simhash
from quillmill.llm.common import materialise, sliced


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        seen[name] = docs
        if name != "packing":
            assert docs.schema == before.schema
    ids = {k: Counter(r.doc_id for r in v.select("doc_id").collect()) for k, v in seen.items()}
    # eleven toxic rows are few to learn from: half of them at least must go
    assert sum(1 for d, r in labels.items() if r.toxic and d in ids["toxicity"]) <= sum(r.toxic for r in labels.values()) / 2
    assert not [d for d, r in labels.items() if not r.toxic and d not in ids["toxicity"]]
    prints = simhash.near_duplicates(seen["near_duplicates"]).collect()
    assert len({r.component_id for r in prints}) == len(prints)
    assert ids["personal_data"] == ids["near_duplicates"] and set(ids["mixing"]) <= set(ids["personal_data"]) and max(ids["mixing"].values()) <= 2
    assert not any(pii.base_spans(r.text) for r in seen["personal_data"].collect())
    assert set(ids["packing"]) == set(ids["mixing"])
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).drop("sequence_id", "offset").collect()) == Counter(tuple(r) for r in seen["packing"].drop("sequence_id", "offset").collect())


def test_odd_rows_pass_through_every_stage(spark, sf_dir):
    kind = "doc_id long, text string, source string, toxic string, key int, _text_hash long, ids string, sequence_id int, bucket int, n long"
    clean = "calm words about gardens and rivers that nobody minds at all "
    rows = [(i, t, s, "mine", 1, 2, "x", 3, 4, 5) for i, (t, s) in enumerate([(None, None), ("", "a"), ("  \n", "a"), (clean + "one two", "b"), (clean + "one two", "b"), ("x" * 300_000, "c"), ("mail a.b@c.de now please " + clean, None), ("汉字" * 5000, "d")])]
    rows += [rows[3], (None, "no id here but words enough to stay", "b", None, None, None, None, None, None, None)]
    for made in (rows, []):
        docs = spark.createDataFrame(made, kind)
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, materialise(stage(spark, docs, sf_dir))
            if name != "packing":
                assert docs.schema == before.schema, name
                assert docs.count() == before.count() or name in ("near_duplicates", "mixing"), name
        got = docs.collect()
        assert bool(got) == bool(made) and all(len(r.ids) == 4 * r.length for r in got)
        if made:
            assert {r.doc_id for r in got} >= {3, 5, 6, 7, None}


def test_python_gets_bounded_batches(spark, monkeypatch):
    """packing once had a batch of any number of bytes in executor and worker."""
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    seen = []
    monkeypatch.setattr(packing, "tokenised", lambda docs, *_: docs.mapInArrow(sizes, "n long"))
    monkeypatch.setattr(packing, "materialise", lambda df, *a: seen.append(max(r.n for r in materialise(df, *a).collect())) or df.selectExpr("1L AS length"))
    monkeypatch.setattr(packing, "place", lambda pieces, *_: pieces)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    packing.pack(docs, "")
    assert seen[0] < 2 * packing.BATCH_BYTES and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    parts = list(sliced(iter([pa.record_batch([list(range(2500))], ["x"]), pa.record_batch([pa.array([], pa.int64())], ["x"])])))
    assert [p.num_rows for p in parts] == [1000, 1000, 500] and pa.Table.from_batches(parts)["x"].to_pylist() == list(range(2500))
