"""The queries opN_<name>, thin digests of the operators, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.llm import bandjoin, bpe, decontam, langmix, linedrop, pii, repetition, simhash, sourceaudit, suffixdedup, vectordedup, warc, weaklabel
from sheafline.session import table


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer files lie; the environment may name another folder."""
    folder = os.environ.get("SHEAFLINE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langmix.train(docs.filter(~langmix.held_out()))
    return langmix.language_mixture(docs, model).select("doc_id", langmix.held_out().alias("held_out"), "lang_pred", "score", "langs", "proportions", "known")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op4_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weaklabel.weak_quality(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op7_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


def op8_repetition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.repetition_quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedrop.drop_lines(table(spark, sf_dir, "documents"))


def op10_warc_index_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op11_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordedup.vector_links(table(spark, sf_dir, "embeddings"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sourceaudit.source_audit(table(spark, sf_dir, "documents"))


def op13_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bandjoin.band_join(table(spark, sf_dir, "items"), table(spark, sf_dir, "sale_lines"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_template_decontamination,
        op2_language_mixture,
        op3_personal_data,
        op4_weak_quality,
        op5_suffix_dedup,
        op6_simhash_near_dedup,
        op7_trie_bpe,
        op8_repetition_quality,
        op9_line_dedup,
        op10_warc_index_first,
        op11_vector_near_dedup,
        op12_source_audit,
        op13_band_join,
    )
}

_SPACE = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LINES = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, translate(trim(line, {_SPACE}), '{_UPPER}', '{_LOWER}') AS k FROM lines),
often AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT keyed.*, often.last IS NOT NULL AND often.last <> doc_id AS gone FROM keyed LEFT JOIN often USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex FROM p),
f AS (SELECT hex, min(page_id) AS first FROM d GROUP BY hex)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
    (instr('0123456789abcdef', substr(hex, 1 + (5 * i) // 4, 1)) - 1) * 16 + greatest(instr('0123456789abcdef', substr(hex, 2 + (5 * i) // 4, 1)) - 1, 0)
  ) // (2 ** (3 - (5 * i) % 4))::INT % 32)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f USING (hex)"""

_NGRAMS = ((5, 15), (6, 14), (7, 13), (8, 12), (9, 11), (10, 10))
_REPETITION = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT doc_id, w, pos, length(w) AS n FROM (
    SELECT doc_id, unnest(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS w,
      generate_subscripts(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''), 1) AS pos FROM docs)),
windows AS (
  SELECT doc_id, pos, g, list(w) OVER (PARTITION BY doc_id, g ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ws
  FROM words, (VALUES {", ".join(f"({n})" for n, _ in _NGRAMS)}) AS t(g)),
grams AS (SELECT doc_id, pos, g, ws[1:g] AS gram FROM windows WHERE len(ws) >= g),
many AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g, gram) AS c FROM grams) WHERE c > 1),
hit AS (SELECT DISTINCT doc_id, g, pos + o AS pos FROM many, (SELECT unnest(range(10)) AS o) WHERE o < g),
share AS (SELECT doc_id, g, count(*) AS hit_words, sum(n) AS hit_chars FROM hit JOIN words USING (doc_id, pos) GROUP BY ALL),
lines AS (
  SELECT doc_id, line, pos, sum(length(x)) AS chars FROM (
    SELECT doc_id, line, pos, unnest(list_filter(string_split_regex(line, '[ \\t\\n\\x0B\\f\\r]+'), lambda y: y <> '')) AS x FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs)) GROUP BY ALL),
dup AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (k > 1) AS n_dup, coalesce(sum(chars) FILTER (k > 1), 0) AS dup_chars FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS k FROM lines) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, coalesce(w.n_words, 0) AS n_words, coalesce(w.word_chars, 0) AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
    coalesce(dup_chars, 0) AS dup_chars, coalesce(r.hit_words, 0) AS n_repeat_words
  FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS n_words, sum(n) AS word_chars FROM words GROUP BY doc_id) w USING (doc_id)
  LEFT JOIN dup USING (doc_id) LEFT JOIN (SELECT * FROM share WHERE g = 5) r USING (doc_id)),
over AS (SELECT doc_id, bool_or({" OR ".join(f"g = {n} AND hit_chars * 100 > {p} * word_chars" for n, p in _NGRAMS)}) AS bad FROM share JOIN base USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR coalesce(bad, false)
    OR n_dup_lines * 100 > 30 * greatest(n_lines, 1) OR dup_chars * 100 > 20 * greatest(word_chars, 1)) AS kept
FROM base LEFT JOIN over USING (doc_id)"""

_VECTORS = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS row, vec_id, label, embedding::DOUBLE[] AS e,
    label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable
  FROM embeddings),
links AS MATERIALIZED (
  SELECT a.row AS a, b.row AS b FROM v a JOIN v b ON a.label = b.label AND a.row <> b.row AND len(a.e) = len(b.e)
  WHERE a.usable AND b.usable AND list_cosine_similarity(a.e, b.e) >= 0.93),
reached AS (SELECT row, row AS other FROM v UNION SELECT r.row, l.b FROM reached r JOIN links l ON r.other = l.a),
least AS (SELECT r.row, min(v.vec_id) AS component_id FROM reached r JOIN v ON v.row = r.other GROUP BY r.row),
sums AS (SELECT a AS row, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN least USING (row) LEFT JOIN sums USING (row)"""

_AUDIT = r"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
terms AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM terms GROUP BY ALL HAVING count(DISTINCT row) >= 30),
groups AS (SELECT DISTINCT lang, source FROM docs),
occurring AS (SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
filled AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN occurring USING (lang, source, term)),
of_group AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM filled JOIN sizes USING (lang)),
of_lang AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM filled GROUP BY ALL) JOIN sizes USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM of_group a JOIN of_group b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
outstanding AS (SELECT g.lang, g.source, 'term' AS part, g.term AS item, p - q AS value FROM of_group g JOIN of_lang USING (lang, term) WHERE g.n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM outstanding))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50"""

_BAND = """
WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
lines AS (
  SELECT sale_id, line_no, item_id, quantity::BIGINT AS q, floor(100 * amount + 0.5)::BIGINT AS a FROM sale_lines
  WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity <> 0 AND amount IS NOT NULL),
priced AS (
  SELECT sale_id, line_no, item_id, (2 * a + q - (((2 * a + q) % (2 * q)) + 2 * q) % (2 * q)) // (2 * q) AS u,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(sale_id || ',' || coalesce(line_no::VARCHAR, '') || ',' || item_id, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM lines, crc),
wanted AS (SELECT row_number() OVER () AS row, item_id, floor(100 * price + 0.5)::BIGINT AS p FROM items),
ends AS (SELECT *, p - greatest(50, p // 100) AS low, p + greatest(50, p // 100) AS high FROM wanted WHERE p IS NOT NULL AND item_id IS NOT NULL),
pairs AS (
  SELECT e.row, abs(l.u - e.p) AS gap, l.u, l.sale_id, l.line_no, l.item_id AS line_item_id, l.crc
  FROM ends e JOIN priced l ON l.u BETWEEN e.low AND e.high
  WHERE l.item_id <> e.item_id AND (abs(l.u - e.p) <= 50 OR 1000 * abs(l.u - e.p) <= 5 * least(l.u, e.p))),
placed AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY gap, u, sale_id, line_no NULLS FIRST, line_item_id) AS rank FROM pairs),
sums AS (SELECT row, count(*) AS n_pairs, sum(gap) AS gap_sum, sum(crc) AS lines_crc FROM pairs GROUP BY row)
SELECT w.item_id, coalesce(f.rank, 0)::INTEGER AS rank, f.gap, f.u, f.sale_id, f.line_no::BIGINT AS line_no, f.line_item_id,
  coalesce(s.n_pairs, 0)::BIGINT AS n_pairs, coalesce(s.gap_sum, 0)::BIGINT AS gap_sum, coalesce(s.lines_crc, 0)::BIGINT AS lines_crc
FROM wanted w LEFT JOIN sums s USING (row) LEFT JOIN (SELECT * FROM placed WHERE rank <= 10) f USING (row)"""

ORACLE_SQL: dict[str, str] = {"op8_repetition_quality": _REPETITION, "op9_line_dedup": _LINES, "op10_warc_index_first": _WARC, "op11_vector_near_dedup": _VECTORS, "op12_source_audit": _AUDIT, "op13_band_join": _BAND}
