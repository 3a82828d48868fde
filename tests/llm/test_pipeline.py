"""Each stage of the pipeline against a plain form of it, each on its own input."""

import collections

import corpus_pipeline
import pyarrow as pa
import pytest
from test_shingles import brute

from quillon.llm.quality import classify
from quillon.llm.secrets import find, fit, redact
from quillon.llm.shared import BATCH, BATCH_SETTING, small_batches


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs.toPandas(), after.toPandas()))
        docs = after
    return dict(zip([n for n, _ in corpus_pipeline.STAGES], out))


def test_columns_and_order(stages):
    assert list(stages) == ["quality", "near_duplicates", "secrets", "mixing", "packing"]
    for name, (before, after) in stages.items():
        assert name == "packing" or list(after.columns) == list(before.columns)


def test_quality_drops_what_it_rejects_and_keeps_the_clean(spark, sf, stages):
    before, after = stages["quality"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    verdict = {r.doc_id: r.kept for r in classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).collect()}
    assert sorted(after.doc_id) == sorted(d for d in before.doc_id if verdict[d])
    lab = labels.toPandas()
    clean = set(lab[(lab.quality == 1) & (lab.toxic == 0)].doc_id)
    assert len(clean & set(after.doc_id)) >= 0.995 * len(clean)


def test_one_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    before = before.sort_values("doc_id")
    roots = brute(list(zip(before.doc_id, before.text)))  # five-word shingles, similarity 0.8
    assert sorted(after.doc_id) == sorted(set(roots))


def test_secrets_are_gone_and_nothing_else(spark, stages):
    before, after = stages["secrets"]
    rule = fit(spark.createDataFrame(before[["text"]]))
    texts = dict(zip(after.doc_id, after.text))
    assert len(after) == len(before)
    for d, t in zip(before.doc_id, before.text):
        assert texts[d] == redact(t, rule)
        if not find(t, rule):
            assert texts[d] == t
    assert (after.n_chars == after.text.str.len()).all()


def test_mixing_drops_toxic_and_keeps_clean(spark, sf, stages):
    before, after = stages["mixing"]
    lab = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    clean = set(lab[(lab.quality == 1) & (lab.toxic == 0)].doc_id) & set(before.doc_id)
    toxic = set(lab[lab.toxic == 1].doc_id) & set(before.doc_id)
    assert len(clean & set(after.doc_id)) >= 0.98 * len(clean)
    assert len(toxic & set(after.doc_id)) <= 0.25 * len(toxic)  # about fifty toxic labels teach this model
    assert set(after.doc_id) <= set(before.doc_id)


def test_packing_has_every_document(stages):
    before, after = stages["packing"]
    pieces = collections.Counter(after.doc_id)
    assert set(pieces) == set(before.doc_id)
    assert after.groupby("sequence_id").length.sum().max() <= 1024


def test_run(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf).toPandas()
    assert sorted(zip(got.doc_id, got.piece, got.ids_crc32)) == sorted(zip(*[stages["packing"][1][c] for c in ("doc_id", "piece", "ids_crc32")]))


def test_workers_get_small_batches(spark, sf, monkeypatch):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    monkeypatch.setattr(corpus_pipeline, "redact_secrets", lambda docs: docs.mapInArrow(sizes, "n long"))
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('0123456789', 400) AS text")
    got = [r.n for r in corpus_pipeline.secrets(spark, docs, sf).collect()]
    assert sum(got) > 12_000_000
    assert max(got) < 1.1 * BATCH  # one batch of 12 MB before


def test_a_session_keeps_its_own_batches(spark):
    other = spark.newSession()
    other.conf.set(BATCH_SETTING, "1m")
    small_batches(other)
    assert other.conf.get(BATCH_SETTING) == "1m"
