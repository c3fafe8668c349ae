"""The registered queries of this subpackage, each with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridefield.llm import (
    byte_bpe, chat, curriculum, filter_audit, fingerprint, host_rules, html_text, hyperlang, lsh_forest, pii, suffix_dedup, unigram, vector_codes,
)
from stridefield.llm.storage import cut, table

PROBE = r"\### Assistant: </turn> ok"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted; every column is read back from the output."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    done = chat.format_conversations(turns.unionByName(probe))
    read = done.withColumn("_back", chat.parse_turns(F.col("formatted"))).withColumn(
        "_loss", chat.masked_text(F.col("formatted"), F.col("loss_spans"))
    )
    whole = F.array_join(F.transform("_back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("_back").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS n,
    length(replace(replace(role, '\', '\\'), '<|', '<\|')) AS r,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS DISTINCT FROM role AS opens
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE WHEN opens THEN r + 24 ELSE 8 END) - 1 AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, and kept by its own rules and its host's shrunken failure rate."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    counted = cut(host_rules.rule_counts(docs).drop("text"))  # one row a document, without its text
    return host_rules.judge(counted).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM s WHERE len(w) >= 3)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
l AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (
  SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
c AS (
  SELECT s.doc_id, s.source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM s LEFT JOIN cov USING (rid) LEFT JOIN l USING (rid)),
f AS (SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeats, 10 * n_symbols > n_words AS symbols,
    20 * n_dup_lines > n_words AS same_lines FROM c),
u AS (SELECT source, rule, count(*) AS n, sum(CAST(failed AS BIGINT)) AS k
  FROM (UNPIVOT (SELECT source, short, repeats, symbols, same_lines FROM f) ON short, repeats, symbols, same_lines INTO NAME rule VALUE failed) GROUP BY ALL),
p AS (SELECT rule, avg(k / n) AS m, var_pop(k / n) AS v FROM u GROUP BY rule),
t AS (SELECT u.*, m, CASE WHEN v > 0 THEN least(1e6, greatest(1.0, m * (1 - m) / v - 1))
    WHEN m > 0 AND m < 1 THEN 1e6 ELSE 1.0 END AS st FROM u JOIN p USING (rule)),
r AS (SELECT source, bool_and((k + m * st) / (n + st) <= greatest(0.3e0, m + 2 * sqrt(m * (1 - m) / (st + 1)))) AS host_kept FROM t GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (short OR repeats) AS base_failed,
  NOT (short OR repeats) AND host_kept AS kept
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
"""


def op10_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words; position is when a document first comes up, null if never."""
    mixed = curriculum.mix(curriculum.narrow(table(spark, sf_dir, "documents")))
    placed = mixed.withColumn("position", F.get("positions", F.lit(0)))
    return placed.repartitionByRange(F.col("position"), F.col("_key")).sortWithinPartitions("position", "_key").select(
        "doc_id", "size", "source_size", "target", "taken", "position"
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk
  FROM d GROUP BY source),
w AS (
  SELECT *, [5, 2, 1][rk % 3 + 1] AS weight, [1.5e0, 1e0, 0.5e0][rk % 3 + 1] AS w0, [0.5e0, 1e0, 1.5e0][rk % 3 + 1] AS w1,
    2 * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, rk) AS n,
    CAST(1.5 AS DOUBLE) * sum(source_size) OVER () AS total FROM w),
v AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
x AS (SELECT min(n) AS first, arg_min(level, n) AS lam FROM v WHERE level * weight <= cap),
t AS (SELECT source, source_size, w0, w1, CASE WHEN n < coalesce(first, n + 1) THEN CAST(cap AS DOUBLE) ELSE lam * weight END AS target
  FROM v LEFT JOIN x ON true),
b AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
j AS (
  SELECT b.*, t.source_size, t.target, w0, w1, CAST(floor(target) AS BIGINT) AS due
  FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, least(size, greatest(0, due - before)) AS t1, least(size, greatest(0, due - before - source_size)) AS t2,
    before / greatest(target, 1e0) AS share FROM j)
SELECT doc_id, size, source_size, target, CAST(t1 + t2 AS BIGINT) AS taken,
  CASE WHEN t1 > 0 THEN round(least(1e0, greatest(0e0, CASE WHEN w1 - w0 = 0 THEN share
    ELSE (sqrt(greatest(0e0, w0 * w0 + 2 * (w1 - w0) * share * ((w0 + w1) / 2))) - w0) / (w1 - w0) END)), 9) END AS position
FROM k
"""


def op2_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans by rule and learned ``id`` spans of every document; the counts are of base spans."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[pii.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS[:4]],
        F.sha2(pii.described(F.col("base")), 256).alias("base_sha256"),
        pii.described(F.col("spans")).alias("spans"),
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of repeated 200-byte strings."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document and its number of links."""
    return lsh_forest.near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digests of every text and of its edited form, with its class of exact copies."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprint.fingerprints(docs).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id", "copies"
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; prototypes are learned from documents that are not held out."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc % 4 == 2).alias("held_out"))
    names, prototypes = hyperlang.train(docs.filter(~F.col("held_out")))
    return hyperlang.predict(docs.select("doc_id", "held_out", "text"), names, prototypes)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, with pieces of a public file and synthetic log scores (see unigram.load)."""
    return unigram.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), ids=False)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the ranks of a public file and decoded again."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in each of their 120 orders, by language."""
    return filter_audit.interactions(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH s AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM s),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text), regexp_matches(text, '[#$%&*|]'),
    coalesce(first < w.doc_id, false)] AS f FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
x AS (SELECT i, chr(CAST(65 + i AS INT)) AS letter FROM range(5) t(i)),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o, a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
k AS (SELECT o.*, CAST(step AS INT) AS step, o[step] AS v, o[1:step - 1] AS before FROM o, range(1, 6) t(step)),
r AS (SELECT part, filter_order, step, v,
    sum(CASE WHEN NOT f[v + 1] AND len(list_filter(before, lambda b: f[b + 1])) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN f[v + 1] AND len(list_filter(before, lambda b: f[b + 1])) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN f[v + 1] AND len(list_filter(before, lambda b: f[b + 1])) > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN f[v + 1] AND len(list_filter(f, lambda b: b)) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN f[v + 1] AND len(list_filter(before, lambda b: f[b + 1])) = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN f[v + 1] AND len(list_filter(before, lambda b: f[b + 1])) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, k GROUP BY part, filter_order, step, v)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, v) AS BIGINT) AS shapley FROM r
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all embeddings, fitted in two exact rounds."""
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return codes.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))


def _op13_round(k: int) -> str:
    """Books k + 1 from the nearest entries of books k."""
    return f"""n{k} AS MATERIALIZED (SELECT v.part, v.vec_id, arg_min(entry, {{'a': list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'b': entry}}) AS entry
  FROM v JOIN b{k} b ON b.part = v.part GROUP BY v.part, v.vec_id),
m{k} AS (SELECT part, entry, i, CAST(floor(sum(x[i]) / count(*)::DOUBLE) AS BIGINT) AS c FROM n{k} JOIN v USING (part, vec_id), range(1, 1 + (SELECT max(len(x)) FROM v)) t(i) GROUP BY part, entry, i),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(y.x, b.x) AS x FROM b{k} b LEFT JOIN (SELECT part, entry, list(c ORDER BY i) AS x FROM m{k} GROUP BY part, entry) y USING (part, entry))"""


OP13_SQL = f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
v AS MATERIALIZED (SELECT vec_id, part, x[part * (len(x) // 16) + 1 : (part + 1) * (len(x) // 16)] AS x FROM e, range(16) t(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM v QUALIFY entry < 64),
{_op13_round(0)},
{_op13_round(1)},
z AS MATERIALIZED (SELECT v.part, v.vec_id, entry, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v JOIN b2 b ON b.part = v.part
  QUALIFY row_number() OVER (PARTITION BY v.part, v.vec_id ORDER BY d, entry) = 1),
s AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM z GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
FROM s JOIN e USING (vec_id)
"""

QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_pii_bootstrap": op2_pii_bootstrap,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_minhash_forest": op4_minhash_forest,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op6_quality_rules": op6_quality_rules,
    "op7_language_id": op7_language_id,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_html_extraction": op9_html_extraction,
    "op10_curriculum_mixing": op10_curriculum_mixing,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_filter_audit": op12_filter_audit,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES = {
    "op1_chat_formatting": OP1_SQL,
    "op6_quality_rules": OP6_SQL,
    "op10_curriculum_mixing": OP10_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
