"""The opN queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm.alignment import link_documents
from quillon.llm.embedding_dedup import near_vectors
from quillon.llm.fingerprint import compare_with_next
from quillon.llm.mixing import mix
from quillon.llm.packing import pack_documents
from quillon.llm.pii import find_personal_data
from quillon.llm.quality import classify
from quillon.llm.secrets import scan_secrets
from quillon.llm.shared import read_table, scratch_dir, tidied
from quillon.llm.simhash import near_duplicates
from quillon.llm.spelling import group_variants
from quillon.llm.substring_dedup import remove_repeats
from quillon.llm.token_files import read_tokens, write_tokens
from quillon.llm.url_rules import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


@tidied
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every text of documents: doc_id, counts, base_sha256, spans, n_random. Null texts have none."""
    found = scan_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through the token files: written in doc_id order, read back as doc_id, start, n_tokens, ids_crc32."""
    path = f"{scratch_dir(spark)}/quillon/token-files-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_tokens(spark, path)


@tidied
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of documents against its edited text and the next document, in descending doc_id order."""
    return compare_with_next(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@tidied
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut and packed in sequences of at most 1024 tokens."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


@tidied
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of all documents, links at three bits or fewer."""
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@tidied
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity, threshold and verdict of all documents under models of the trusted labels."""
    labels = read_table(spark, sf_dir, "labels")
    return classify(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), labels)


@tidied
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors and rates of all documents for nine tenths clean tokens."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    mixed = mix(docs, read_table(spark, sf_dir, "labels"), {"clean": 0.9, "junk": 0.05, "toxic": 0.05}, with_text=False)
    return mixed.select("doc_id", "source", "n_tokens", "p_clean", "p_junk", "p_toxic", "rate")


@tidied
def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_links, component_id and kept of all embeddings at cosine 0.93 within a label."""
    return near_vectors(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


@tidied
def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each of documents without its repeated windows of 35 words."""
    return remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


@tidied
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every url of pages under URL_RULES."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


@tidied
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every frequent word of documents."""
    return group_variants(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@tidied
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token groups and links of each of documents between a byte-level and a piece tokenizer."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return link_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@tidied
def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every text of documents: fixed patterns and what their contexts find."""
    return find_personal_data(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["op1_secrets"] = op1_secrets
QUERIES["op2_token_files"] = op2_token_files
QUERIES["op3_fingerprints"] = op3_fingerprints
QUERIES["op4_packing"] = op4_packing
QUERIES["op5_simhash"] = op5_simhash
QUERIES["op6_quality"] = op6_quality
QUERIES["op7_mixing"] = op7_mixing
QUERIES["op8_embeddings"] = op8_embeddings
QUERIES["op9_substrings"] = op9_substrings
QUERIES["op10_url_filter"] = op10_url_filter
QUERIES["op11_spelling"] = op11_spelling
QUERIES["op12_alignment"] = op12_alignment
QUERIES["op13_pii"] = op13_pii
ORACLES["op9_substrings"] = r"""
WITH texts AS (SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
spots AS (SELECT k, unnest(range(1, len(w) - 33)) AS p, w FROM texts WHERE len(w) >= 35),
windows AS (SELECT k, p, md5(array_to_string(w[p:p + 34], ' ')) AS h FROM spots),
twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT k, unnest(range(p, p + 35)) AS i FROM windows SEMI JOIN twice USING (h)),
lost AS (SELECT k, list(i) AS l FROM gone GROUP BY k),
told AS (SELECT doc_id, w, CASE WHEN l IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(l, x[2])), lambda x: x[1]) END AS kept FROM texts LEFT JOIN lost USING (k))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM told
"""
ORACLES["op8_embeddings"] = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
unit AS (SELECT vec_id, label, list_transform(e, lambda x: x / n) AS u FROM ok WHERE n > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.label = b.label AND len(a.u) = len(b.u) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.u, b.u) >= 0.93),
walk(a, b) AS (SELECT a, b FROM pairs UNION SELECT w.a, p.b FROM walk w JOIN pairs p ON w.b = p.a),
least AS (SELECT a, min(b) AS m FROM walk GROUP BY a), links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(links.n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM v LEFT JOIN least ON least.a = vec_id LEFT JOIN links ON links.a = vec_id
"""
ORACLES["op11_spelling"] = r"""
WITH RECURSIVE crc_table AS (SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
runs AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY 1, 2),
coded AS (SELECT run, c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
bytes AS (SELECT run, c, list_transform(range(1, length(x), 2), lambda i: 16 * (strpos('0123456789ABCDEF', substr(x, i, 1)) - 1) + strpos('0123456789ABCDEF', substr(x, i + 1, 1)) - 1) AS b FROM coded),
hashed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295, b), lambda h, y: xor(h // 256, t[xor(h, y) % 256 + 1])), 4294967295) AS h FROM bytes, crc_table),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT c, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed) WHERE length(word) >= 5 GROUP BY 1 HAVING sum(c) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
opened AS (SELECT word, n, left(word, i - 1) || '_' || substr(word, i + 1) AS p, left(word, i - 1) || substr(word, i + 1) AS d FROM places),
cut AS (SELECT DISTINCT o.word AS long, o.n AS long_n, w.word AS short, w.n AS short_n FROM opened o JOIN words w ON w.word = o.d),
pairs AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM opened a JOIN opened b ON a.p = b.p AND a.word <> b.word
  UNION ALL SELECT long, long_n, short, short_n FROM cut UNION ALL SELECT short, short_n, long, long_n FROM cut),
near AS (SELECT word, n, count(*) AS n_near, max(other_n) AS most, arg_min(other, {'a': -other_n, 'b': other}) AS best FROM pairs GROUP BY 1, 2),
forms AS (SELECT word, best AS form, most FROM near WHERE most >= 2 * n),
walk(word, final, step) AS (SELECT word, form, 1 FROM forms UNION ALL SELECT w.word, f.form, step + 1 FROM walk w JOIN forms f ON f.word = w.final),
ends AS (SELECT word, arg_max(final, step) AS root FROM walk GROUP BY 1)
SELECT word, form, coalesce(root, word) AS root, words.n AS n, coalesce(n_near, 0) AS n_near, forms.most AS form_n FROM words LEFT JOIN near USING (word) LEFT JOIN forms USING (word) LEFT JOIN ends USING (word)
"""
ORACLES["op10_url_filter"] = r"""
WITH rules(rh, rp, rv) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'),
  ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
cut AS (SELECT row_number() OVER () AS k, page_id,
  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosted AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
parts AS (SELECT k, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosted),
met AS (SELECT p.*, r.* FROM parts p LEFT JOIN rules r
  ON (p.host = r.rh OR suffix(p.host, '.' || r.rh)) AND starts_with(p.path, r.rp))
SELECT page_id, host, path, rh || rp AS rule, coalesce(rv, 'allow') AS verdict FROM met
QUALIFY row_number() OVER (PARTITION BY k ORDER BY length(rh) + length(rp) DESC NULLS LAST) = 1
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages over documents, one after the other."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
