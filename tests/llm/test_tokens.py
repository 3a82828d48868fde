"""Token files and packing against the library's ids of whole texts."""

import zlib
from math import ceil

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillon.llm.encoding import Encoder
from quillon.llm.packing import combinations, cut_documents, pack, pack_documents
from quillon.llm.shared import stash
from quillon.llm.token_files import pack_ranks, read_tokens, unpack_ranks, write_tokens

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a  b", "a   b\n c", "  lead ", "tab\t y  z", "é́ ́x", "don't  it's 12 345", "x \x1c y", "A\n\n B \n C", "~ ~a ~", "ΑΣ Σ", "wörter, wörter. wörter!!", "ab" * 3000]


def ids_of(file, texts, end=2):
    t = Tokenizer.from_file(file)
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("file", [WORD, BYTE])
def test_pieces_give_the_ids_of_whole_texts(file):
    code = Encoder(file)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in code.encode(ODD)] == [x[:-1] for x in ids_of(file, ODD)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab,.! ~'s\n\té́ 1²|<ſ")), max_size=30), max_size=6))
def test_any_text(texts):
    for file in (WORD, BYTE):
        if not hasattr(test_any_text, file):
            setattr(test_any_text, file, (Encoder(file), Tokenizer.from_file(file)))
        code, whole = getattr(test_any_text, file)
        assert [np.frombuffer(x, "<u4").tolist() for x in code.encode(texts)] == [whole.encode(x, add_special_tokens=False).ids for x in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 70_000), max_size=50))
def test_rank_code_round_trip(ranks):
    got = unpack_ranks(*pack_ranks(np.array(ranks, "u4")), len(ranks))
    assert got.tolist() == ranks


def test_files_hold_every_document_in_order(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    write_tokens(docs, str(tmp_path / "t"), WORD)
    got = read_tokens(spark, str(tmp_path / "t"), with_ids=True).toPandas().sort_values("doc_id")
    want = docs.orderBy("doc_id").toPandas()
    ids, at = ids_of(WORD, want.text), 0
    for row, own in zip(got.itertuples(), ids, strict=True):
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(own), crc(own))
        at += len(own)
    # Files in order of bucket and block hold ascending ids, and the most frequent id has one byte.
    blocks = spark.read.parquet(str(tmp_path / "t/blocks")).orderBy("bucket", "block").collect()
    assert [x for b in blocks for x in np.frombuffer(b.doc_ids, "<i8")] == sorted(want.doc_id)


def test_odd_documents(spark, tmp_path):
    rows = [(None, "b"), (None, None), (7, "x y"), (7, "x y"), (3, None), (1, "")] + [(100 + k, x) for k, x in enumerate(ODD)]
    docs = spark.createDataFrame([(d, t, 5, "z") for d, t in rows], "doc_id long, text string, start int, ids string")
    write_tokens(docs, str(tmp_path / "o"), WORD)
    got = read_tokens(spark, str(tmp_path / "o")).toPandas().sort_values("start")
    assert got.doc_id.isna().tolist() == [True, True] + [False] * (len(rows) - 2)
    assert sorted(got.ids_crc32) == sorted(crc(x) for x in ids_of(WORD, [t for _, t in rows]))
    assert got.start.tolist() == [0, *np.cumsum(got.n_tokens)[:-1]]
    packed = pack_documents(docs, BYTE).toPandas()
    assert packed.length.sum() == sum(len(x) for x in ids_of(BYTE, [t for _, t in rows]))


def test_no_documents(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    write_tokens(none, str(tmp_path / "n"), WORD)
    assert read_tokens(spark, str(tmp_path / "n")).count() == 0
    assert pack_documents(none, BYTE).count() == 0


def test_packing_is_whole_gapless_and_tight(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = pack_documents(docs, BYTE).toPandas()
    want = docs.toPandas()
    ids = dict(zip(want.doc_id, ids_of(BYTE, want.text), strict=True))
    for doc, own in got.sort_values("piece").groupby("doc_id"):
        assert own.piece.tolist() == list(range(len(own)))
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        assert own.length.tolist()[1:] == [1024] * (len(own) - 1)
        assert [crc(ids[doc][a : a + n]) for a, n in zip(own.start, own.length, strict=True)] == own.ids_crc32.tolist()
        assert own.length.sum() == len(ids[doc])
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 1024
    assert got.sequence_id.nunique() <= 1.01 * ceil(got.length.sum() / 1024)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(0, 9), max_size=8))
def test_combinations_use_everything_once(counts):
    plan, used = combinations(counts, 12), {}
    for combo, times in plan:
        assert times > 0 and sum(n * c for n, c in combo) <= 12
        for n, c in combo:
            used[n] = used.get(n, 0) + c * times
    assert used == {n: c for n, c in counts.items() if c}


def test_fullest_combination():
    # 7 takes 3+2 over 4, the largest that fits alone
    assert combinations({7: 1, 4: 1, 3: 1, 2: 1}, 12)[0] == ([(7, 1), (3, 1), (2, 1)], 1)


def test_general_pack_keeps_columns(spark):
    rows = [(k, 1 + k % 9, f"v{k}") for k in range(500)]
    made = stash(spark.createDataFrame(rows, "row long, length long, extra string"), "t")
    got = pack(made, 10).toPandas()
    assert sorted(got.extra) == sorted(r[2] for r in rows)
    assert (got.groupby("sequence_id").length.sum() <= 10).all()
    assert cut_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), BYTE, 2, 1024, True).first()["ids"]
