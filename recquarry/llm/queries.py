"""Registered queries of this subpackage with their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recquarry.llm import byte_bpe, decontaminate, exact_dedup, fill_in_middle, forced_bpe, language_id, line_dedup
from recquarry.llm import minhash_dedup, spelling, suffix_dedup, token_counts, toxicity, url_filter
from recquarry.llm.common import remainder, table

BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON_BPE = public_tokenizers.path("byte_bpe_50k.json")
UNIGRAM = public_tokenizers.path("piece_bpe_32k.model")
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]

QUERIES: dict = {}
SQL: dict = {}


def add(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


@add("op1_suffix_dedup")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf, "documents"))


def toxicity_scores(spark: SparkSession, sf: str, docs: DataFrame):
    """Model learned from the labelled training rows of ``documents``, and the score column for ``docs``."""
    labels = table(spark, sf, "labels").where(remainder("doc_id", 5) != 0)
    model = toxicity.fit(table(spark, sf, "documents"), labels)
    return toxicity.score(docs, model)


@add("op2_toxicity")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    scored = docs.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), toxicity_scores(spark, sf, docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@add("op3_decontamination")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@add("op4_token_counts")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", token_counts.count_tokens(docs, UNIGRAM).alias("n_pieces"))


@add("op5_byte_bpe")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", byte_bpe.digests(docs, BYTE_BPE).alias("r")).select("doc_id", "r.*")


@add("op6_minhash_dedup")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return minhash_dedup.classes(table(spark, sf, "documents"))


LINE_SQL = """
WITH lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
wins AS (
  SELECT doc_id, i AS pos, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS w
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM lines WHERE len(ls) >= 3)
  WHERE trim(ls[i] || ls[i + 1] || ls[i + 2], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
ranked AS (
  SELECT *, first_value(doc_id) OVER o AS doc0, first_value(pos) OVER o AS pos0,
         row_number() OVER o AS nth
  FROM wins WINDOW o AS (PARTITION BY w ORDER BY doc_id, pos)),
gone AS (
  SELECT DISTINCT doc_id, p FROM (
    SELECT doc_id, doc0, pos0, unnest([pos, pos + 1, pos + 2]) AS p FROM ranked WHERE nth > 1)
  WHERE NOT (doc_id = doc0 AND p BETWEEN pos0 AND pos0 + 2)),
removed AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_filter(ls, lambda x, i: NOT list_contains(coalesce(ps, []), i)), chr(10)), '')) AS kept_sha256
FROM lines LEFT JOIN removed USING (doc_id)"""


@add("op7_line_dedup", LINE_SQL)
def op7(spark: SparkSession, sf: str) -> DataFrame:
    kept = line_dedup.remove_repeats(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


COPIES_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS s FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256
FROM d"""


@add("op8_exact_dedup", COPIES_SQL)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, sf, "documents"), keep="largest")


@add("op9_url_filter")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@add("op10_language_id")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held_out = remainder("doc_id", 4) == 2
    model = language_id.fit(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), language_id.identify(docs, model).alias("r"))
    return found.select("doc_id", "held_out", "r.lang_pred", "r.score")


FIM_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS x FROM documents),
h AS (SELECT *, CAST(len(u) AS BIGINT) AS n, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2,
  ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
       WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""


@add("op11_fill_in_middle", FIM_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    made = fill_in_middle.transform(table(spark, sf, "documents").select("doc_id", "text"))
    hashed = (F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashed)


# crc32 byte by byte over its table; accented letters are two bytes each
SPELLING_SQL = """
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
  CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
per AS (SELECT doc_id, w, count(*) AS m FROM runs WHERE length(w) >= 6 GROUP BY 1, 2),
bytes AS (SELECT w, m, flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda c:
  CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END)) AS b FROM per),
hashed AS (SELECT w, m, xor(list_reduce(b, lambda h, x: xor(h >> 8, t[(xor(h, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM bytes, crc),
slipped AS (SELECT m, CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, sum(m)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY 1 HAVING sum(m) >= 5),
cuts AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS z FROM words, unnest(range(1, length(word) + 1)) r(i)),
near AS (SELECT x.word, y.word AS near, y.n FROM cuts x JOIN cuts y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.a || c.z
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.a || c.z),
best AS (SELECT word, count(*) AS n_near, max(n) AS top, min({'n': -n, 'w': near}) AS b FROM near GROUP BY 1),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * w.n THEN b.w END AS form, CASE WHEN top >= 5 * w.n THEN top END AS form_n
  FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, form AS at FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.at WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN forms f ON f.word = walk.at WHERE f.form IS NULL)
SELECT forms.word, form, coalesce(root, forms.word) AS root, n, n_near, form_n FROM forms LEFT JOIN ends USING (word)"""


@add("op12_spelling_variants", SPELLING_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    words = spelling.count_words(table(spark, sf, "documents"), min_length=6, min_count=5, slip_one_in=199)
    return spelling.variants(words, ratio=5)


@add("op13_forced_bpe")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", forced_bpe.digests("text", JSON_BPE).alias("r")).select("doc_id", "r.*")


@add("pipeline")
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
