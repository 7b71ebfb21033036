"""Registered queries of the ten operators and the pipeline, with their SQL.

Each query applies its operator with production parameters to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import alignment, bpe, ego, fingerprints, gam, idcoder, interactions, minhash, mixing, pii, rules, unigram_count, warc
from .common import prepare, split_pattern, table, take_columns, vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _register(fn):
    name = fn.__name__

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)

    run.__name__, run.__doc__ = name, fn.__doc__
    QUERIES[name] = run
    return run


@_register
def op1_minhash_dedup(spark, sf_dir):
    """ICWS near-duplicates of all documents: doc_id, class_id, n_same, kept."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@_register
def op2_pii_surrogates(spark, sf_dir):
    """Surrogates in all documents: doc_id, text, n_entities, kinds."""
    docs = take_columns(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    return pii.pseudonymize(docs, pii.session_key(spark))


@_register
def op3_source_mixing(spark, sf_dir):
    """Subset-sum mix of all documents to source targets."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@_register
def op4_quality_rules(spark, sf_dir):
    """Rule measures and verdicts of all documents."""
    return rules.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


@_register
def op5_token_id_files(spark, sf_dir):
    """All documents tokenized, written as coded id blocks and read back."""
    path = scratch_path(spark, "token-ids")
    idcoder.write_ids(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return idcoder.read_documents(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_register
def op6_token_counts(spark, sf_dir):
    """Unigram token counts of all documents: doc_id, n_tokens."""
    docs = take_columns(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    return unigram_count.count_tokens(docs, vocabulary("piece_bpe_32k.model")).select("doc_id", "n_tokens")


@_register
def op7_quality_classifier(spark, sf_dir):
    """Quality scores of all documents by the additive model."""
    docs = table(spark, sf_dir, "documents")
    model = gam.fit(docs, table(spark, sf_dir, "labels"))
    scored = gam.score(take_columns(docs, ["doc_id", "text"]), model)
    return scored.select(
        "doc_id", F.coalesce(gam.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= gam.THRESHOLD).cast("int").alias("predicted"))


@_register
def op8_byte_bpe(spark, sf_dir):
    """All documents encoded by rank file and decoded again."""
    path, pattern = vocabulary("byte_bpe_multi_50k.tiktoken"), split_pattern()
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, pattern)


@_register
def op9_warc_records(spark, sf_dir):
    """All pages written as WARC archives and read back."""
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_register
def op10_embedding_dedup(spark, sf_dir):
    """Epsilon grid order join of all embeddings by label."""
    return ego.near_duplicates(table(spark, sf_dir, "embeddings"))


@_register
def op11_document_fingerprints(spark, sf_dir):
    """Threshold-scaled sketches of all documents and of their edited texts."""
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


@_register
def op12_tokenizer_alignment(spark, sf_dir):
    """All documents cut into groups where tokens of two tokenizers end together."""
    return alignment.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"),
                           vocabulary("piece_bpe_32k.model"))


@_register
def op13_filter_audit(spark, sf_dir):
    """What five filters remove from all documents in each of 120 orders."""
    return interactions.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

ORACLE["op4_quality_rules"] = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents
), n AS (
  SELECT *, len(w) AS n,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
         ELSE [] END AS win
  FROM w
), d AS (
  SELECT row_number() OVER () AS r, * FROM n
), g AS (
  SELECT r, unnest(win) AS x, generate_subscripts(win, 1) AS p FROM d
), twice AS (
  SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, x) AS c FROM g) WHERE c > 1
), cover AS (
  SELECT r, count(DISTINCT q) AS c FROM (SELECT r, unnest(range(p, p + 5)) AS q FROM twice) GROUP BY r
), m AS (
  SELECT doc_id, n AS n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(t) - length(replace(t, '!', '')) AS n_bang,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    len(list_filter(w, lambda x: list_contains([{', '.join(repr(s) for s in dict.fromkeys(rules.STOP_WORDS))}], lower(x)))) AS n_stop,
    coalesce(c, 0) AS n_repeat_words
  FROM d LEFT JOIN cover USING (r)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars >= n_words * 2.0 AND word_chars <= n_words * 14.0
    AND n_symbols <= n_words * 0.1::DOUBLE AND n_bang <= n_words * 0.5::DOUBLE
    AND n_stop >= n_words * 0.005::DOUBLE AND n_dup_lines <= n_lines * 0.3::DOUBLE AS kept
FROM b
"""

ORACLE["op9_warc_records"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM f
"""

ORACLE["op10_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, coalesce(vec_id, 4611686018427387904 + row_number() OVER ()) AS node, label,
    list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.node AS a, b.node AS b FROM ok a JOIN ok b
  ON a.label = b.label AND a.node <> b.node AND len(a.e) = len(b.e)
    AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach(id, c) AS (
  SELECT node, node FROM v
  UNION SELECT r.id, l.b FROM reach r JOIN link l ON r.c = l.a
), comp AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links,
  CASE WHEN component_id < 4611686018427387904 THEN component_id END AS component_id,
  coalesce(component_id = v.vec_id, false) AS kept
FROM v JOIN comp ON comp.id = v.node LEFT JOIN n ON n.a = v.node
"""


ORACLE["op13_filter_audit"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS} AS w FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), g AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
    len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
    100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM w LEFT JOIN l USING (doc_id)
), m AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM g GROUP BY part, fails
), p(o, used) AS (
  SELECT '', []::INT[] UNION ALL
  SELECT o || chr((64 + i)::INT), list_append(used, i::INT) FROM p, range(1, 6) r(i) WHERE NOT list_contains(used, i)
), s AS (
  SELECT o AS filter_order, step, used[step] AS f, used[1:step - 1] AS earlier, list_filter([1, 2, 3, 4, 5], lambda x: x <> used[step]) AS others
  FROM p, range(1, 6) r(step) WHERE len(used) = 5
), q AS (
  SELECT part, filter_order, step::INT AS step, f,
    sum(CASE WHEN fails[f] OR len(list_filter(earlier, lambda x: fails[x])) > 0 THEN 0 ELSE n END) AS kept,
    sum(CASE WHEN fails[f] AND len(list_filter(earlier, lambda x: fails[x])) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails[f] AND len(list_filter(earlier, lambda x: fails[x])) > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails[f] AND len(list_filter(others, lambda x: fails[x])) = 0 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails[f] AND len(list_filter(earlier, lambda x: fails[x])) = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails[f] AND len(list_filter(earlier, lambda x: fails[x])) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM q
"""


def _add_pipeline() -> None:
    """The pipeline at the repository's top, registered as a query."""
    import corpus_pipeline

    QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL is not None:
        ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL


_add_pipeline()
