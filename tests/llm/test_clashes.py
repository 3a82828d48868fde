"""Callers' columns may have any name: what an operator makes on its way never meets them, and what it returns replaces its own names alone."""

import re
from pathlib import Path

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillon.llm import alignment, fingerprint, mixing, packing, pii, quality, secrets, shingles, simhash, spelling, substring_dedup, token_files

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
MADE = set()
for file in [*Path(quality.__file__).parent.glob("*.py")]:
    text = file.read_text()
    MADE |= set(re.findall(r'alias\("(\w+)"\)|withColumn\("(\w+)"', text)) | {(x,) for x in re.findall(r'"(_?[a-z]\w*)"', text)}
MADE = sorted({x for t in MADE for x in t if x} - {"doc_id", "text", "lang", "source", "n_chars"})


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clash"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{path}/labels.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    wide = docs.select("*", *[F.lit("mine").alias(c) for c in MADE])
    return path, docs, wide


def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")


OWN = {
    "op1": (lambda s, d: secrets.scan_secrets(d), ["doc_id", *[c.split()[0] for c in secrets.SPANS.split(", ")]]),
    "op1 redacted": (lambda s, d: secrets.redact_secrets(d), ["doc_id", "text", "n_chars"]),
    "op3": (lambda s, d: fingerprint.compare_with_next(d), None),
    "op4": (lambda s, d: packing.pack_documents(d, BYTES, end_id=2, capacity=1024), ["doc_id", "piece", "start", "length"]),
    "op5": (lambda s, d: simhash.near_duplicates(d), None),
    "op6": (lambda s, d: quality.classify(d, labels(s)), None),
    "op6 kept": (lambda s, d: quality.keep_good(d, labels(s)), ["doc_id", "text"]),
    "op7": (lambda s, d: mixing.draw(mixing.mix(d, labels(s)), nearest=True), ["doc_id", "n_tokens", "p_clean", "rate"]),
    "op9": (lambda s, d: substring_dedup.remove_repeats(d), ["doc_id", "n_words", "n_removed", "kept_sha256"]),
    "op11": (lambda s, d: spelling.group_variants(d), None),
    "op12": (lambda s, d: alignment.link_documents(d, BYTES, PIECES), None),
    "op13": (lambda s, d: pii.find_personal_data(d), None),
    "alike": (lambda s, d: shingles.similar(d), None),
    "one alike": (lambda s, d: shingles.keep_one_alike(d), ["doc_id", "text"]),
}


@pytest.mark.parametrize("name", OWN)
def test_any_column_name(spark, tables, name):
    _, docs, wide = tables
    run, columns = OWN[name]
    plain, got = run(spark, docs), run(spark, wide)
    columns = columns or plain.columns
    key = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert key(got) == key(plain)
    if set(MADE) & set(got.columns) and "own" in got.columns:
        assert {r.own for r in got.select("own").collect()} <= {"mine"}


def test_token_files(spark, tables, tmp_path):
    for k, docs in enumerate(tables[1:]):
        token_files.write_tokens(docs, f"{tmp_path}/{k}", public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    plain, got = (sorted(map(str, token_files.read_tokens(spark, f"{tmp_path}/{k}").collect())) for k in (0, 1))
    assert got == plain


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_keep_any_column(spark, tables, name, stage):
    path, docs, wide = tables
    got = stage(spark, wide, path)
    if name != "packing":
        assert got.columns == wide.columns
        assert sorted(map(str, got.select(*docs.columns).collect())) == sorted(map(str, stage(spark, docs, path).collect()))
    else:
        assert got.count() == stage(spark, docs, path).count()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_of_no_rows(spark, tables, name, stage):
    assert stage(spark, tables[1].limit(0), tables[0]).count() == 0


def test_a_stage_called_again_leaves_the_first_result(spark, tables):
    path, docs, _ = tables
    for _, stage in corpus_pipeline.STAGES:
        first = stage(spark, docs, path)
        second = stage(spark, docs.limit(20), path)
        assert first.count() > 0 and second.count() > 0
