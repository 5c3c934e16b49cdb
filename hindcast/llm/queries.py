"""The registered queries of this subpackage and the SQL that states the same result, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm import bpe, exact_dedup, fim, license_scan, lm_score, media, ngram_join, packing, quality, spelling, substring_dedup, token_store, toxicity
from hindcast.llm._shared import crc_mod, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file, as of the package that holds them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents")).drop("matches")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end=2, capacity=1024, with_ids=False)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda doc_id: crc_mod(doc_id, 4) != 2)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), n=5, percent=75)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_score.lm_score(table(spark, sf_dir, "documents"), lambda doc_id: crc_mod(doc_id, 7) != 2)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end=2)


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    found = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda doc_id: crc_mod(doc_id, 3) != 1)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.fill_in_middle(table(spark, sf_dir, "documents"), seed="7", rate=100, spm_rate=50)
    digests = (F.sha2(x.cast("binary"), 256).alias(name) for x, name in ((F.col("output"), "output_sha256"), (fim.restored(F.col("output"), F.col("form")), "restored_sha256")))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), damage=199, min_length=6, min_count=5, factor=5)


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id,
  first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
  CAST(count(*) OVER (PARTITION BY norm) AS BIGINT) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS kept,
  sha256(norm) AS text_sha256
FROM d
"""

OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT doc_id, len(w) AS n, unnest(range(1, len(w) + 1)) AS q, unnest(w) AS word FROM d
), g AS (
  SELECT doc_id, n, q, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY q ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM x
), s AS (
  SELECT DISTINCT doc_id, s FROM g WHERE q <= greatest(n - 4, 1)
), c AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), m AS (
  SELECT a, min(b) AS b FROM r GROUP BY 1
)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m ON m.a = d.doc_id
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT doc_id, len(w) AS n, unnest(range(1, len(w) + 1)) AS q, unnest(w) AS word FROM d
), g AS (
  SELECT doc_id, n, q, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY q ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS s FROM x
), later AS (
  SELECT doc_id, q, row_number() OVER (PARTITION BY s ORDER BY doc_id, q) > 1 AS later FROM g WHERE q <= n - 19
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(q, q + 20)) AS q FROM later WHERE later
), k AS (
  SELECT x.doc_id, count(*) AS n_words, count(gone.q) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY x.q) FILTER (WHERE gone.q IS NULL), '') AS kept
  FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.q = x.q GROUP BY 1
)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), k AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k
), p AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:n], ''), '') AS suf FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

#: The CRC's table follows from its polynomial; near words are equal words with one code point left out at one place, or such a one and a whole word.
OP13_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zA-ZÀ-ÿ]+')) AS w FROM documents
), g AS (
  SELECT doc_id, w, count(*) AS n FROM r GROUP BY 1, 2
), b AS (
  SELECT w, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 | (CAST(unicode(c) AS BIGINT) >> 6), 128 | (CAST(unicode(c) AS BIGINT) & 63)] END)) AS bytes FROM g
), h AS (
  SELECT w, n, xor(list_reduce(list_concat([4294967295], bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, tab
), v AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(w, CAST(h % length(w) AS BIGINT)) || substring(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM h
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5
), cut AS (
  SELECT word, n, i, left(word, i - 1) || substring(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.less = b.word
), best AS (
  SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS k FROM near
), f AS (
  SELECT words.word, words.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN CAST(other_n AS BIGINT) END AS form_n
  FROM words LEFT JOIN best ON best.word = words.word AND k = 1
), walk AS (
  SELECT word, word AS root FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL
), ends AS (
  SELECT walk.word, walk.root FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NULL
)
SELECT f.word, f.form, ends.root, f.n, f.n_near, f.form_n FROM f JOIN ends USING (word)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:2] == "op" and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op7_ngram_jaccard_join": OP7_SQL, "op8_substring_dedup": OP8_SQL, "op12_fill_in_middle": OP12_SQL, "op13_spelling_variants": OP13_SQL}
