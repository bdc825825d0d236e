import re

from helpers import EXTRA, awkward

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from folioq.llm import mixing, pii, quality, simhash

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    """Each stage against its rule, on what the stage before kept."""
    assert [k for k, _ in pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "PII", "mixing sources to target weights", "best-fit packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    schema = docs.schema
    good, one, masked, mixed = [], [], [], []
    (_, a), (_, b), (_, c), (_, d), (_, e) = pipeline.STAGES
    good = a(spark, docs, SF).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, quality.grades(labels))
    keep = {r.doc_id for r in quality.score(docs, model).where("selected").collect()}
    assert {r.doc_id for r in good.collect()} == keep and good.schema == schema
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert len(keep & bad) <= 0.1 * len(bad)

    one = b(spark, good, SF).cache()
    groups = {}
    for r in simhash.near_groups(good).collect():
        groups.setdefault(r.component_id, []).append(r.doc_id)
    assert sorted(r.doc_id for r in one.collect()) == sorted(groups) and all(min(v) == k for k, v in groups.items())
    texts = [r.text for r in one.collect()]
    assert len(texts) == len(set(texts))

    masked = c(spark, one, SF).cache()
    before = {r.doc_id: r.text for r in one.collect()}
    for r in masked.collect():
        assert r.text == pii.masked(before[r.doc_id]) and r.n_chars == len(r.text) and not pii.find_pii(r.text)[0]
    assert [t for _, t in masked.dtypes] == [t for _, t in docs.dtypes]

    mixed = d(spark, masked, SF).cache()
    times = {r.doc_id: (r.taken, r.size) for r in mixing.mix(masked).collect()}
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert all(got.get(k, 0) * n == taken for k, (taken, n) in times.items())

    packed = e(spark, mixed, SF).collect()
    assert sum(r.size for r in packed) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in mixed.collect())


def test_run_and_awkward_input(spark, tmp_path):
    awkward(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(20, 1, 0), (21, 0, 0), (22, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert [f.name for f in docs.schema] == [c.split()[0] for c in EXTRA.split(", ")], name
    assert entry.queries()["pipeline"](spark, str(tmp_path)).count() > 0
    assert "pipeline" not in entry.oracle_sql()
