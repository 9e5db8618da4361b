"""Queries of the training-data operators over whole tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontaminate import contamination
from .edit_counts import edited_counts
from .language_id import languages
from .lcp_runs import run_report
from .merkle_manifest import tampering_drill
from .packing import packed
from .pii_bilstm import personal_data
from .quality_ri import quality_scores
from .repetition import repetition_coverage
from .secrets_markov import secrets
from .vertical_jaccard import jaccard_components
from .warc_merkle import scrub_drill
from .zdict import compressed_ids

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; the operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_warc_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scrub_drill(table(spark, sf_dir, "pages"))
    return found.fillna(0, ["length", "replica_length"]).fillna("", ["sha", "replica_sha"])


def op2_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_coverage(table(spark, sf_dir, "documents"))


def op3_zstd_dictionary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed_ids(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_bilstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op5_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_vertical_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op8_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op11_hierarchical_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op12_lcp_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tampering_drill(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_warc_merkle_audit": op1_warc_merkle_audit,
    "op2_repetition_coverage": op2_repetition_coverage,
    "op3_zstd_dictionary_ids": op3_zstd_dictionary_ids,
    "op4_bilstm_crf_pii": op4_bilstm_crf_pii,
    "op5_random_indexing_quality": op5_random_indexing_quality,
    "op6_edit_token_counts": op6_edit_token_counts,
    "op7_vertical_jaccard": op7_vertical_jaccard,
    "op8_nnls_packing": op8_nnls_packing,
    "op9_benchmark_windows": op9_benchmark_windows,
    "op10_markov_secrets": op10_markov_secrets,
    "op11_hierarchical_language": op11_hierarchical_language,
    "op12_lcp_runs": op12_lcp_runs,
    "op13_merkle_manifest": op13_merkle_manifest,
}

# Words, lines and windows of whole texts; positions count from 1.
_REPETITION_SQL = r"""
WITH w AS (
  SELECT doc_id, u.p, u.word FROM (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
  ), LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word) u
), base AS (
  SELECT d.doc_id, count(w.word) AS n_words, coalesce(sum(length(w.word)), 0) AS word_chars
  FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id GROUP BY d.doc_id
), sym AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols FROM documents
), l AS (
  SELECT doc_id, u.i, u.line FROM (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
  ), LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line) u
  WHERE regexp_matches(u.line, '[^\x20\x09-\x0D]')
), l2 AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again,
         length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars FROM l
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (again) AS n_dup_lines,
         coalesce(sum(chars) FILTER (again), 0) AS dup_line_chars FROM l2 GROUP BY doc_id
), w3 AS (
  SELECT doc_id, p, [word, lead(word, 1) OVER o, lead(word, 2) OVER o] AS g, lead(word, 2) OVER o AS z
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY p)
), r3 AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) > 1 AS twice FROM w3 WHERE z IS NOT NULL
), c3 AS (
  SELECT doc_id, count(DISTINCT p + k) AS n_repeat_words
  FROM r3, (SELECT unnest(range(3)) AS k) WHERE twice GROUP BY doc_id
)__NGRAMS__
SELECT b.doc_id, b.n_words::BIGINT AS n_words, b.word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
       (b.n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * b.n_words) AS base_failed,
       NOT (b.n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * b.n_words)
         AND 100 * coalesce(dup_line_chars, 0) <= 30 * b.word_chars__LIMITS__ AS kept,
       coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars__COLUMNS__
FROM base b JOIN sym USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN c3 USING (doc_id)__JOINS__
"""


def _repetition_sql() -> str:
    from .repetition import NGRAM_LIMITS

    ngrams, limits, columns, joins = "", "", "", ""
    for n, limit in sorted(NGRAM_LIMITS.items()):
        gram = ", ".join(f"lead(word, {k}) OVER o" for k in range(n))
        ngrams += f"""
, g{n} AS (
  SELECT doc_id, p, [{gram}] AS g, lead(word, {n - 1}) OVER o AS z
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY p)
), a{n} AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id, g ORDER BY p) > 1 AS again FROM g{n} WHERE z IS NOT NULL
), d{n} AS (
  SELECT w.doc_id, sum(length(w.word)) AS dup_chars_{n} FROM w SEMI JOIN (
    SELECT doc_id, p + k AS p FROM a{n}, (SELECT unnest(range({n})) AS k) WHERE again
  ) c ON c.doc_id = w.doc_id AND c.p = w.p GROUP BY w.doc_id
)"""
        limits += f"\n         AND 100 * coalesce(dup_chars_{n}, 0) <= {round(100 * limit)} * b.word_chars"
        columns += f",\n       coalesce(dup_chars_{n}, 0)::BIGINT AS dup_chars_{n}"
        joins += f" LEFT JOIN d{n} USING (doc_id)"
    sql = _REPETITION_SQL.replace("__NGRAMS__", ngrams).replace("__LIMITS__", limits)
    return sql.replace("__COLUMNS__", columns).replace("__JOINS__", joins)


_DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), g AS (
  SELECT DISTINCT item, k, ws[p:p + k - 1] AS gram FROM (
    SELECT item, ws, least(len(ws), 10) AS k, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS p FROM b WHERE len(ws) > 0
  )
), dw AS (
  SELECT doc_id, k, p, ws[p:p + k - 1] AS gram FROM (
    SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM g) WHERE len(ws) >= k
  )
), h AS (
  SELECT doc_id, dw.k, p, item FROM dw JOIN g ON g.k = dw.k AND g.gram = dw.gram
), n AS (
  SELECT doc_id, count(DISTINCT p + j) AS n_hit FROM (SELECT doc_id, p, unnest(range(k)) AS j FROM h) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id
"""

# Shingle sets of classes of equal sets, links by counted overlaps, components by label spreading.
_JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []
                      WHEN len(ws) < 4 THEN [ws]
                      ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 2), lambda p: ws[p:p + 3]))) END AS g FROM w
), c AS (
  SELECT g, min(doc_id) AS id, len(g) AS n FROM s GROUP BY g
), t AS (
  SELECT id, n, unnest(g) AS x FROM c WHERE n > 0
), o AS (
  SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.x = b.x AND a.id < b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), e AS (
  SELECT a, b FROM o UNION ALL SELECT b, a FROM o
), r AS (
  SELECT id, id AS least FROM c UNION SELECT e.b, r.least FROM r JOIN e ON e.a = r.id
), k AS (
  SELECT id, min(least) AS component_id FROM r GROUP BY id
)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE component_id END AS component_id
FROM s JOIN c ON c.g = s.g JOIN k ON k.id = c.id
"""

# The records and offsets anew, and the damage that the scrub drill does, record by record.
_MERKLE_SQL = r"""
WITH r AS (
  SELECT page_id, page_id // 512 AS file,
         concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10),
                'Content-Length: ', strlen(coalesce(html, '')), chr(13), chr(10), chr(13), chr(10), coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) AS record
  FROM pages
), p AS (
  SELECT *, coalesce(sum(strlen(record)) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM r
), q AS (
  SELECT *, CASE WHEN page_id % 997 = 5 THEN NULL
                 WHEN page_id % 499 = 7 THEN concat(substr(record, 1, 24), chr(0), substr(record, 26))
                 WHEN page_id % 1009 = 11 THEN substr(record, 1, length(record) - 3)
                 ELSE record END AS copy FROM p
)
SELECT file::BIGINT AS file, pos AS offset, (pos // 262144)::BIGINT AS range_idx,
       CASE WHEN copy IS NULL THEN 'missing' ELSE 'changed' END AS kind,
       strlen(record)::BIGINT AS length, sha256(record) AS sha, coalesce(strlen(copy), 0)::BIGINT AS replica_length, coalesce(sha256(copy), '') AS replica_sha
FROM q WHERE copy IS DISTINCT FROM record
"""

# Leaves, then level by level: of all sources at once, and of the sources' subroots.
_MANIFEST_SQL = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE concat('=', source) END AS grp,
         concat(__doc_id__, __source__, __lang__, __n_chars__) AS head, __text__ AS body,
         text, doc_id::VARCHAR AS id FROM documents
), crc AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, len(id) + 1),
                lambda i: [ascii(substr(id, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
              lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) AS c FROM f
), l AS (
  SELECT doc_id, grp, sha256(concat(head, body)) AS leaf,
         CASE WHEN c % 2 = 0 AND text IS NOT NULL
              THEN sha256(concat(head, strlen(replace(text, chr(10), ''))::VARCHAR, ':', replace(text, chr(10), ''))) END AS changed
  FROM crc
), p AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM l
), t AS (
  SELECT 0 AS level, grp, idx, n, leaf AS sha FROM p
  UNION ALL
  SELECT level + 1, grp, idx // 3, ((n + 2) // 3)::BIGINT, sha256(string_agg(sha, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY level, grp, n, idx // 3
), s AS (
  SELECT grp, sha AS subroot, level AS h, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1
), u AS (
  SELECT 0 AS level, idx, n, subroot AS sha FROM s
  UNION ALL
  SELECT level + 1, idx // 3, ((n + 2) // 3)::BIGINT, sha256(string_agg(sha, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY level, n, idx // 3
), tree AS (
  SELECT grp, level, idx, sha FROM t WHERE n > 1
  UNION ALL SELECT NULL, level, idx, sha FROM u WHERE n > 1
), sib AS (
  SELECT a.grp, a.level, a.idx, coalesce(string_agg(b.sha, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
         coalesce(string_agg(b.sha, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM tree a JOIN tree b ON a.grp IS NOT DISTINCT FROM b.grp AND a.level = b.level AND a.idx // 3 = b.idx // 3 GROUP BY a.grp, a.level, a.idx
), step AS (
  SELECT p.doc_id, p.leaf, p.changed, s.grp, s.subroot, s.h, p.idx AS idx, s.idx AS top, 0 AS lvl, '' AS proof, coalesce(p.changed, p.leaf) AS sha
  FROM p JOIN s ON s.grp = p.grp
  UNION ALL
  SELECT step.doc_id, step.leaf, step.changed, step.grp, step.subroot, step.h, CASE WHEN lvl < h THEN step.idx // 3 ELSE step.idx END,
         CASE WHEN lvl >= h THEN top // 3 ELSE top END, lvl + 1, concat(proof, l, r), sha256(concat(l, sha, r))
  FROM step JOIN sib ON CASE WHEN lvl < h THEN sib.grp = step.grp AND sib.level = lvl AND sib.idx = step.idx
                             ELSE sib.grp IS NULL AND sib.level = lvl - h AND sib.idx = top END
), r AS (
  SELECT sha AS root, level AS h2 FROM u WHERE n = 1
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, sha AS folded_root, sha = root AS verified
FROM step, r WHERE lvl = h + h2
"""


def _manifest_sql() -> str:
    sql = _MANIFEST_SQL
    for c in ("doc_id", "source", "lang", "n_chars", "text"):
        sql = sql.replace(f"__{c}__", f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen({c}::VARCHAR)::VARCHAR, ':', {c}::VARCHAR) END")
    return sql


ORACLES: dict[str, str] = {
    "op1_warc_merkle_audit": _MERKLE_SQL,
    "op2_repetition_coverage": _repetition_sql(),
    "op7_vertical_jaccard": _JACCARD_SQL,
    "op9_benchmark_windows": _DECONTAMINATION_SQL,
    "op13_merkle_manifest": _manifest_sql(),
}
