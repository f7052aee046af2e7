"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hamsieve.llm.align import align
from hamsieve.llm.decontam import contaminated
from hamsieve.llm.exact import exact_groups
from hamsieve.llm.html import extract_pages
from hamsieve.llm.jaccard import near_groups
from hamsieve.llm.lm import score_texts
from hamsieve.llm.mixing import mix
from hamsieve.llm.quality import fit_neighbours, score_quality
from hamsieve.llm.sharding import shard_rows
from hamsieve.llm.suffixes import remove_repeats
from hamsieve.llm.toxicity import fit_subwords, score_toxicity
from hamsieve.llm.trie import graft, number_turns, prefix_trie
from hamsieve.llm.urls import judge_urls
from hamsieve.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

#: The URL rules of the contract.
URL_RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
SHARDS = 24
#: Where the vocabulary files lie.
TOKENIZERS = os.environ.get("HAMSIEVE_TOKENIZERS", "/opt/tokenizers")


def _remainder(modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id has remainder 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % modulus


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = score_texts(docs, train=_remainder(10) != 0)
    return scores.withColumn("held_out", _remainder(10) == 0)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), SHARDS)


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=50)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_neighbours(docs, table(spark, sf_dir, "labels").where(_remainder(4) != 2))
    return score_quality(docs, model).withColumn("held_out", _remainder(4) == 2)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), k=3, percent=90)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = number_turns(table(spark, sf_dir, "conversations"))
    conv = F.col("conv_id")
    head = F.crc32(conv.cast("string").cast("binary")) % 9
    return prefix_trie(*graft(turns, base=conv - conv % 5, head=head, most=8))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_subwords(docs, table(spark, sf_dir, "labels").where(_remainder(5) != 0))
    return score_toxicity(docs, model).withColumn("held_out", _remainder(5) == 0)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), TOKENIZERS)


QUERIES: dict[str, Query] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_sharding": op2_sharding,
    "op3_repeats": op3_repeats,
    "op4_html_extraction": op4_html_extraction,
    "op5_url_filters": op5_url_filters,
    "op6_quality": op6_quality,
    "op7_decontamination": op7_decontamination,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_mixing": op10_mixing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_toxicity": op12_toxicity,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES: dict[str, str] = {
    "op5_url_filters": r"""
WITH u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT u.page_id, u.host, u.path, r.rh || r.rp AS rule, r.v,
    row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.rh || r.rp) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (u.host = r.rh OR ends_with(u.host, '.' || r.rh)) AND starts_with(u.path, r.rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
""",
    "op9_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
""",
    "op11_prefix_trie": r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
-- crc32 bit by bit: eight shifts per byte of the decimal id.
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
u AS (
  SELECT c.conv_id, 0 AS own, t.p, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.p <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.p, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.p > c.h),
w AS (
  SELECT c.conv_id, coalesce(list({'r': u.role, 't': u.text} ORDER BY u.own, u.p) FILTER (u.text IS NOT NULL), []) AS path
  FROM c LEFT JOIN u USING (conv_id) GROUP BY c.conv_id),
m AS (SELECT conv_id, len(path) AS size, d.d, path[:d.d] AS prefix FROM w, LATERAL (SELECT unnest(range(0, len(path) + 1)) AS d) d),
n AS (
  SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, count(*) FILTER (size = d) AS n_ends,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256
  FROM m GROUP BY d, prefix),
k AS (SELECT d - 1 AS d, prefix[:d - 1] AS prefix, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
nk AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children,
    CASE WHEN n.d = 0 THEN 0 ELSE (n.n_convs - 1) * octet_length(encode(n.prefix[n.d].t)) END AS saved
  FROM n LEFT JOIN k USING (d, prefix)),
below AS (
  SELECT a.d, a.prefix, sum(x.saved)::BIGINT AS saved_tokens, count(*) FILTER (x.n_children = 0) AS n_leaves
  FROM nk AS x, LATERAL (SELECT unnest(range(0, x.d + 1)) AS d) AS s JOIN n AS a ON a.d = s.d AND a.prefix = x.prefix[:s.d]
  GROUP BY a.d, a.prefix)
SELECT nk.conv_id, nk.d AS depth, up.conv_id AS parent_conv_id, nk.n_convs, nk.n_children, below.n_leaves, below.saved_tokens,
  nk.ends_sha256, nk.n_ends
FROM nk JOIN below USING (d, prefix) LEFT JOIN n AS up ON up.d = nk.d - 1 AND up.prefix = nk.prefix[:nk.d - 1]
""",
}
