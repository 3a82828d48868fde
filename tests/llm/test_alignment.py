import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import alignment
from quillon.llm.encoding import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", None, " ", "  ", "a ", " a", "a  b", "a\n b", "a \nb", "\n \n", "a\n \nb\tc d", "<|endoftext|> x <s></s><unk>", "▁ a▁b", "a\xa0b   c", "日本 語 x́y ‍",
    "😀 😀😀", "a\x00b c\x1c d", "᠎ ᠎x y", "don't I'll  we've 12 345 6", "a" * 3000, "é " * 50, "x�y z", "\x85 \x85a b", "ﬁ ½ Å Å", "\r\n \r\nq", "w " * 20_000,
]


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = {c: k for k, c in byte_letters().items()}

    def told(text):
        """(groups, each of A's and B's ids) of whole texts, by walking both lists of tokens."""
        if not text:
            return []
        ids = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        pieces = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        if any(b"".join(x for _, x in t) != (" " + text).encode() for t in (ids, pieces)):
            return []
        groups, own, at = [], ([], []), [0, 0]
        left = [iter(ids), iter(pieces)]
        while True:
            side = at[0] > at[1]
            if (token := next(left[side], None)) is None:
                return groups
            own[side].append(token[0])
            at[side] += len(token[1])
            if at[0] == at[1]:
                groups.append(own)
                own = ([], [])

    return told


def expect(rows, told):
    docs = [(d, told(t)) for d, t in rows]
    links = [Counter((x, y) for g in gs for x in g[0] for y in g[1]) for _, gs in docs]
    n = Counter(p for each in links for p in each)
    most = {}
    for (x, _), c in n.items():
        most[x] = max(most.get(x, 0), c)
    out = []
    for (d, gs), each in zip(docs, links):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
        best = sum(m for p, m in each.items() if n[p] == most[p[0]])
        out.append((d, sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), sum(each.values()), best, sum(m * n[p] for p, m in each.items()), hashlib.sha256(said.encode()).hexdigest() if gs else ""))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("heavy", [alignment.HEAVY, 500, 0])
def test_the_table_and_odd_texts(spark, plain, heavy):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000 + k // 2, t) for k, t in enumerate(ODD)] + [(None, "the end"), (None, "the end"), (3, "the end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(alignment.link_documents(docs, A, B, heavy)) == expect(rows, plain)


def test_whole_texts_and_small_memory(plain):
    cut, whole = alignment.Aligner(A, B, memory=3), alignment.Aligner(A, B)
    assert cut.cuts
    whole.cuts = False
    for texts in ([t] for t in ODD):
        x, y = next(cut.align(texts)), next(whole.align(texts))
        assert x[:4] == y[:4] and sorted(x[4]) == sorted(y[4])
        assert x[3] == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in plain(texts[0]))


def test_heavy_pairs_are_bounded(spark):
    counts = spark.createDataFrame([(k, n) for k, n in enumerate([1] * 50 + [2] * 20 + [9] * 5 + [1000])], "pair long, n long")
    for most in (0, 1, 5, 6, 26, 75, 76, 1000):
        assert counts.where(F.col("n") >= alignment.heavy_from(counts, most)).count() <= most
    assert alignment.heavy_from(counts, 76) == 1 and alignment.heavy_from(counts, 26) == 2
    assert alignment.heavy_from(counts.limit(0), 5) == 1


def test_odd_tables(spark, plain):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.link_documents(empty, A, B).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    clash = docs.withColumns({c: F.lit("x") for c in ("row", "pair", "pairs", "times", "n", "best", "n_a", "groups_sha256")})
    assert got(alignment.link_documents(clash, A, B)) == expect([(1, "a b"), (1, "a b"), (2, None)], plain)
