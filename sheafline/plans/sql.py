"""DuckDB SQL for the catalogue's queries."""

from __future__ import annotations

from sheafline.functions.html import BLOCKS
from sheafline.schema import LANGUAGES, MATH_CHAR, OPERATOR_CHAR

SPANS = """
lines AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM documents),
cut AS (SELECT doc_id, lang, ln, list_filter(string_split(line, ' '), lambda w: w <> '') AS ws FROM lines),
runs AS (SELECT doc_id, lang, ln, unnest(range((len(ws) + 7) // 8)) AS c, ws FROM cut),
numbered AS (SELECT doc_id, lang, ln, c, array_to_string(ws[c * 8 + 1 : c * 8 + 8], ' ') AS text, row_number() OVER (PARTITION BY doc_id ORDER BY ln, c) - 1 AS k FROM runs),
slots AS (SELECT *, 40 * (1 + doc_id % 2) AS pp, k % (40 * (1 + doc_id % 2)) AS slot, CASE WHEN c = 0 THEN 25 ELSE 0 END AS indent FROM numbered),
boxes AS (
  SELECT doc_id, lang, (k // pp + 1)::INT AS page, k::BIGINT AS span_id, text, (50 + 290 * (slot // 40) + indent)::DOUBLE AS "left",
    (60 + 16 * (slot % 40) + CASE WHEN slot % 40 >= 20 THEN 24 ELSE 0 END)::DOUBLE AS top, least(255 - indent, 5 * length(text))::DOUBLE AS width,
    (CASE WHEN ln = 0 THEN 15 ELSE 11 END)::DOUBLE AS height, (CASE WHEN ln = 0 THEN 14 ELSE 10 END)::DOUBLE AS font_size, CASE WHEN ln = 0 THEN 700 ELSE 400 END AS font_weight,
    CASE WHEN (doc_id + ln) % 7 = 0 THEN 'italic' ELSE 'normal' END AS font_style, CASE WHEN doc_id % 5 = 0 THEN 'Mono' ELSE 'Serif' END AS font_family, 'rgb(0, 0, 0)' AS color FROM slots),
spans AS (SELECT *, "left" + width AS "right", top + height AS bottom FROM boxes)"""

VALID = r"""width > 1 AND height > 1 AND length(t) > 0 AND NOT regexp_matches(t, '^[0-9]{1,3}$') AND NOT regexp_matches(t, '^[•\-»«]$') AND NOT starts_with(t, 'http')"""
TRIM = r"regexp_replace({}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')"


def trim(x: str) -> str:
    return TRIM.format(x)


PARAS = (
    SPANS
    + rf""",
m AS (SELECT *, length(text) > 0 AND regexp_matches(text, '{MATH_CHAR}') AS math FROM spans),
p AS (SELECT *, lag(math) OVER w AS p_math, lag("left") OVER w AS p_left, lag(top) OVER w AS p_top, lag("right") OVER w AS p_right, lag(bottom) OVER w AS p_bottom, lag(font_size) OVER w AS p_size,
    lag(text) OVER w AS p_text, lag(font_weight) OVER w AS p_weight, lag(font_family) OVER w AS p_family FROM m WINDOW w AS (PARTITION BY doc_id, page ORDER BY top, "left", span_id)),
j AS (SELECT *, p_top IS NOT NULL AND font_family = p_family AND abs(font_size - p_size) <= 1 AND abs(font_weight - p_weight) <= 300 AND (
    (top - p_bottom <= least(greatest(font_size, p_size) * 1.6 * 1.3, greatest(font_size, p_size) * 2.2) AND (abs("left" - p_left) < 2 * least(font_size, p_size) OR abs("right" - p_right) < 2 * least(font_size, p_size)))
    OR (abs(bottom - p_bottom) < least(font_size, p_size) * CASE WHEN math OR p_math THEN 0.75 ELSE 0.45 END AND "left" - p_right >= 0 AND "left" - p_right < least(font_size, p_size) * CASE WHEN math OR p_math THEN 0.9 ELSE 0.55 END)
    OR (regexp_matches({trim("p_text")}, '[\x{{00AD}}-]$') AND top > p_top AND abs("left" - p_left) < font_size * 1.8)) AS joins FROM p),
paras AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY top, "left", span_id) - 1 AS para_id FROM j)"""
)

_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#039;')"
ESCAPED = _ESC.format("text")
TAGGED = "CASE WHEN font_style = 'italic' THEN '<i>' || b || '</i>' ELSE b END"
RICH = f"""
b AS (SELECT *, CASE WHEN font_weight >= 700 THEN '<b>' || {ESCAPED} || '</b>' ELSE {ESCAPED} END AS b FROM paras),
h AS (SELECT *, {TAGGED} AS html, floor(top + 0.5) AS line FROM b),
l AS (SELECT doc_id, page, para_id, line, string_agg(html, ' ' ORDER BY "left", span_id) AS html FROM h GROUP BY ALL),
r AS (SELECT doc_id, page, para_id, string_agg(html, '<br>' ORDER BY line) AS html FROM l GROUP BY ALL)"""

SQL: dict[str, str] = {}
SQL["span_source"] = f'WITH {SPANS} SELECT doc_id, page, span_id, text, "left", top, "right", bottom, font_size, font_weight::INT AS font_weight, font_style, font_family FROM spans'
SQL["span_validity"] = f"WITH {SPANS}, t AS (SELECT *, {trim('text')} AS t FROM spans) SELECT lang, count(*) AS n, count(*) FILTER ({VALID}) AS n_valid FROM t GROUP BY lang"
SQL["span_structure"] = f"WITH {SPANS}, t AS (SELECT *, {trim('text')} AS t FROM spans WHERE span_id % 7 > 0 AND span_id % 11 > 0) SELECT doc_id, count(*) AS n, count(*) FILTER ({VALID}) AS n_valid FROM t GROUP BY doc_id"
SQL["page_count"] = f"WITH {SPANS} SELECT doc_id, greatest(count(DISTINCT page), 1) AS pages FROM spans GROUP BY doc_id"
SQL["math_context"] = f"""WITH {SPANS} SELECT doc_id, span_id, CASE WHEN length(text) > 0 AND regexp_matches(text, '{MATH_CHAR}') THEN CASE WHEN contains(text, '=') OR contains(text, '∑') THEN 'equation' ELSE 'inline' END ELSE 'none' END AS math_context FROM spans"""
SQL["style_columns"] = r"""
WITH c AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'rgb(' || doc_id % 256 || ', 2, 3)' WHEN 1 THEN '#abc' WHEN 2 THEN '#0a0b0c' ELSE 'red' END AS color,
  CASE doc_id % 3 WHEN 0 THEN 'bold' WHEN 1 THEN '550' ELSE 'normal' END AS weight FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN (doc_id % 256) || ',2,3' WHEN 1 THEN '170,187,204' WHEN 2 THEN '10,11,12' ELSE '0,0,0' END AS rgb,
  CASE weight WHEN 'bold' THEN 700 WHEN '550' THEN 550 ELSE 400 END AS weight,
  'Serif|' || printf('%.1f', floor((8 + doc_id % 10 * 0.3::DOUBLE) * 2 + 0.5) / 2) || '|' || CASE weight WHEN 'bold' THEN '700' WHEN '550' THEN '550' ELSE '400' END || '|normal|' ||
  CASE doc_id % 4 WHEN 0 THEN (doc_id % 256) || ',2,3' WHEN 1 THEN '170,187,204' WHEN 2 THEN '10,11,12' ELSE '0,0,0' END AS style_sig FROM c"""
SQL["html_escape"] = f"SELECT doc_id, {ESCAPED} AS escaped FROM documents"
SQL["html_to_text"] = "SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#039;', chr(39)), '&amp;', '&') AS plain FROM pages"
SQL["relative_rects"] = f"""WITH {SPANS} SELECT doc_id, span_id, round("left" / 612, 4) AS rel_left, round(top / 792, 4) AS rel_top, round(width / 612, 4) AS rel_width, round(height / 792, 4) AS rel_height,
  greatest(0.0, least("left" - 60, 612 - width)) AS in_left, greatest(0.0, least(top * 1.2, 792 - height)) AS in_top FROM spans"""
SQL["overlay_fonts"] = f"""WITH {PARAS} SELECT doc_id, page, para_id::INT AS para_id, avg(font_size) AS mean_size, avg(font_size) * 0.95 * 1.5 AS shown_size, least(greatest(avg(font_size) * 0.95 * 1.5, 6.0), 72.0) AS clamped FROM paras GROUP BY ALL"""
SQL["template_fill"] = "SELECT conv_id, turn, 'From ' || coalesce(role, '') || ': ' || substr(text, 1, 3000) || ' [' || role || ']' AS prompt, '> ' || replace(text, chr(10), chr(10) || '> ') AS quoted FROM conversations"
SQL["json_paths"] = r"""SELECT event_id, json_extract_string(props, '$.k') AS k, replace(replace(props, '\', '\\'), '"', '\"') AS escaped FROM events"""
SQL["lang_name"] = "SELECT lang, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' ELSE lang END AS lang_name, count(*) AS n FROM documents GROUP BY lang"
SQL["links_and_paths"] = "SELECT doc_id, 'lib/' || source || '/doc ' || doc_id || '.pdf' AS link, 'notes/doc ' || doc_id || '.translations.md' AS note_path, 'a/b/c/' AS folder FROM documents"
SQL["base64_metadata"] = "SELECT doc_id, text AS decoded FROM documents"
SQL["sentence_ends"] = f"WITH {SPANS} SELECT doc_id, count(*) FILTER (regexp_matches({trim('text')}, '[.?!]\\s*$')) AS n_plain, count(*) FILTER (regexp_matches({trim('text')} || '</b></i>', '[.?!](\\s*</[bi]>)*\\s*$')) AS n_html FROM spans GROUP BY doc_id"
SQL["initial_paragraphs"] = f"WITH {PARAS} SELECT doc_id, page, span_id, para_id::INT AS para_id FROM paras"
SQL["paragraph_box"] = f"""WITH {PARAS} SELECT doc_id, page, para_id::INT AS para_id, count(*) AS n_spans, min("left") AS "left", min(top) AS top, max("right") AS "right", max(bottom) AS bottom, avg(font_size) AS avg_font_size,
  first(font_family ORDER BY top, "left", span_id) AS font_family, string_agg(font_size::INT::VARCHAR, ',' ORDER BY top, "left", span_id) AS font_sizes FROM paras GROUP BY ALL"""
SQL["text_line_height"] = f"WITH {SPANS} SELECT doc_id, page, coalesce(median(height) FILTER (height > 3), 15.0) AS line FROM spans GROUP BY ALL"
_LINES = """
lg AS (SELECT *, top - lag(bottom) OVER (PARTITION BY doc_id, page, para_id ORDER BY top, "left", span_id) AS g FROM paras),
lk AS (SELECT *, CASE WHEN g > 0 AND g < 396 THEN g END AS gap FROM lg),
lr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY gap IS NULL, gap, span_id) - 1 AS rank, count(gap) OVER (PARTITION BY doc_id, page) AS n FROM lk),
la AS (SELECT doc_id, page, coalesce(avg(gap) FILTER (n >= 5 AND rank >= floor(n * 0.15) AND rank < n - floor(n * 0.15)), 0) AS mean_gap, median(font_size) AS font FROM lr GROUP BY ALL),
lh AS (SELECT doc_id, page, CASE WHEN font IS NULL THEN 16 ELSE greatest(mean_gap * 1.25, font * 1.6 * 0.8) END AS line_height FROM la)"""
SQL["line_height"] = f"WITH {PARAS}, {_LINES} SELECT doc_id, page, round(line_height, 6) AS line_height FROM lh"
SQL["column_chain"] = f"""WITH {PARAS}, x AS (SELECT doc_id, page, para_id, min("left") AS "left", min(top) AS top, max("right") AS "right", max(bottom) AS bottom, sum(bottom - top) AS h, count(*) AS n FROM paras GROUP BY ALL),
y AS (SELECT *, CASE WHEN sum(h) OVER v / sum(n) OVER v > 0 THEN sum(h) OVER v / sum(n) OVER v * 2 ELSE 20 END AS lim, lag("left") OVER (PARTITION BY doc_id, page ORDER BY "left", para_id) AS pl FROM x WINDOW v AS (PARTITION BY doc_id, page)),
z AS (SELECT *, sum(CASE WHEN abs("left" - pl) >= lim THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY "left", para_id) AS col_id FROM y),
c AS (SELECT doc_id, page, col_id, min("left") AS "left", min(top) AS top, max("right") AS "right", max(bottom) AS bottom, count(*) AS n_paragraphs FROM z GROUP BY ALL)
SELECT doc_id, page, col_id::INT AS col_id, "left", top, "right", bottom, n_paragraphs, col_id = 0 OR lead(col_id) OVER w IS NULL AS is_edge, ("right" + lead("left") OVER w) / 2 AS gap_x FROM c WINDOW w AS (PARTITION BY doc_id, page ORDER BY col_id)"""
_GAP_PARTS = """t AS (SELECT doc_id, page, greatest(6.0, coalesce(median(height) FILTER (height > 3), 15.0) * 0.75) AS step FROM spans GROUP BY ALL),
bands AS (SELECT doc_id, page, step, unnest(range(ceil(792 / step)::INT)) AS band FROM t),
hit AS (SELECT DISTINCT s.doc_id, s.page, band, "left", "right" FROM spans s JOIN bands b ON s.doc_id = b.doc_id AND s.page = b.page AND s.bottom > band * step AND s.top < least(792, band * step + step)),
o AS (SELECT *, max("right") OVER (PARTITION BY doc_id, page, band ORDER BY "left", "right" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hit),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR "left" > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, band ORDER BY "left", "right" ROWS UNBOUNDED PRECEDING) AS island FROM o),
f AS (SELECT doc_id, page, band, island, min("left") AS "left", max("right") AS "right" FROM i GROUP BY ALL),
inner_ AS (SELECT doc_id, page, band, greatest(coalesce(max("right") OVER (PARTITION BY doc_id, page, band ORDER BY "left" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS "left", "left" AS "right" FROM f),
tail AS (SELECT doc_id, page, band, max("right") AS "left", 612.0 AS "right" FROM f GROUP BY ALL),
gaps AS (SELECT * FROM inner_ WHERE "right" - "left" >= 2 UNION ALL SELECT * FROM tail WHERE "right" - "left" >= 2
  UNION ALL SELECT doc_id, page, band, 0.0, 612.0 FROM bands b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = b.doc_id AND f.page = b.page AND f.band = b.band))"""
_GAPS = f"{SPANS}, {_GAP_PARTS}"
# Gaps meet clusters one after the other, clusters become strips, strips meet the strip before them: three folds.
_STRIP_PARTS = """
tl AS (SELECT doc_id, page, coalesce(median(height) FILTER (height > 3), 15.0) AS line FROM spans GROUP BY ALL),
gk AS MATERIALIZED (SELECT g.doc_id, g.page, row_number() OVER (PARTITION BY g.doc_id, g.page ORDER BY g.band, g."left") AS k, g.band * t.step AS y1, least(792.0, g.band * t.step + t.step) AS y2, g."left", g."right", (g."left" + g."right") / 2 AS c, line, greatest(4.0, line * 0.5) AS tol, t.step
  FROM gaps g JOIN t USING (doc_id, page) JOIN tl USING (doc_id, page)),
cr AS (SELECT doc_id, page, k, 1::BIGINT AS cl, [c] AS lasts FROM gk WHERE k = 1 UNION ALL
  SELECT doc_id, page, k, cl, CASE WHEN cl <= len(lasts) THEN lasts[1 : cl - 1] || [c] || lasts[cl + 1 :] ELSE lasts || [c] END FROM (
    SELECT gk.doc_id, gk.page, gk.k, gk.c, lasts, coalesce(nullif(list_position(list_transform(lasts, lambda x: abs(x - gk.c) <= gk.tol), true), 0), len(lasts) + 1)::BIGINT AS cl
    FROM cr JOIN gk ON gk.doc_id = cr.doc_id AND gk.page = cr.page AND gk.k = cr.k + 1)),
cs AS (SELECT doc_id, page, cl, line, median("left") AS l, median("right") AS r, min(y1) AS top, max(y2) AS bottom,
    least(1, 0.5 * count(DISTINCT floor(y1 + 0.5)) / ceil(792 / step) + 0.25 * (1 - least(1, coalesce(stddev_samp("right" - "left"), 0) / greatest(1, median("right" - "left")))) + 0.25 * (1 - least(1, coalesce(stddev_samp(c), 0) / greatest(1, median(c))))) AS confidence
  FROM cr JOIN gk USING (doc_id, page, k) GROUP BY doc_id, page, cl, line, step),
cn AS MATERIALIZED (SELECT doc_id, page, l, r, top, bottom, confidence, row_number() OVER (PARTITION BY doc_id, page ORDER BY l + r, cl) AS n FROM cs WHERE bottom - top >= 1.5 * line AND confidence >= 0.6),
cm AS (SELECT doc_id, page, n, 1::BIGINT AS sid, l, r, top, bottom, confidence FROM cn WHERE n = 1 UNION ALL
  SELECT doc_id, page, n, CASE WHEN near THEN sid ELSE sid + 1 END, CASE WHEN near THEN least(l, l0) ELSE l END, CASE WHEN near THEN greatest(r, r0) ELSE r END, CASE WHEN near THEN least(top, top0) ELSE top END,
    CASE WHEN near THEN greatest(bottom, bottom0) ELSE bottom END, CASE WHEN near THEN greatest(confidence, c0) ELSE confidence END FROM (
    SELECT cn.*, cm.sid, cm.l AS l0, cm.r AS r0, cm.top AS top0, cm.bottom AS bottom0, cm.confidence AS c0, abs((cn.l + cn.r) / 2 - (cm.l + cm.r) / 2) <= 3 AND cn.top < cm.bottom AND cn.bottom > cm.top AS near
    FROM cm JOIN cn ON cn.doc_id = cm.doc_id AND cn.page = cm.page AND cn.n = cm.n + 1)),
strips AS (SELECT doc_id, page, l AS "left", r AS "right", top, bottom, confidence FROM cm QUALIFY row_number() OVER (PARTITION BY doc_id, page, sid ORDER BY n DESC) = 1)"""
_STRIPS = f"WITH RECURSIVE {_GAPS}, {_STRIP_PARTS}"
SQL["vertical_strips"] = f'{_STRIPS} SELECT doc_id, page, "left", "right", top, bottom, round(confidence, 6) AS confidence FROM strips WHERE confidence >= 0.7 AND "right" - "left" >= 4'
SQL["split_strips"] = f'{_STRIPS} SELECT doc_id, page, "left", "right", top, bottom, round(confidence, 6) AS confidence FROM strips WHERE confidence >= 0.7 AND "right" - "left" >= 6 AND bottom - top >= 12'
_BANDS = f"""WITH RECURSIVE {PARAS}, {_LINES}, {_GAP_PARTS}, {_STRIP_PARTS},
be AS (SELECT doc_id, page, min(top) AS a, max(bottom) AS b, line_height FROM strips JOIN lh USING (doc_id, page) WHERE confidence >= 0.7 AND "right" - "left" >= 4 GROUP BY ALL),
bb AS (SELECT doc_id, page, a, b, a > line_height * 0.75 AS above, b < 792 - line_height * 0.75 AS below, b <= a + greatest(2, line_height * 0.2) AS one FROM be),
bm AS (SELECT doc_id, page, 0.0::DOUBLE AS y, CASE WHEN below AND one THEN 792.0 ELSE a END::DOUBLE AS height FROM bb WHERE above UNION ALL SELECT doc_id, page, b, 792.0 - b FROM bb WHERE below AND NOT (above AND one))"""
SQL["layout_bands"] = f"{_BANDS} SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY y) - 1)::INT AS band_id, round(y, 6) AS y, round(height, 6) AS height, 0.8::DOUBLE AS confidence FROM bm"
SQL["inferred_bands"] = f"{_BANDS} SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY y)::INT AS band_id, round(y, 6) AS y, round(height, 6) AS height, 0.8::DOUBLE AS confidence FROM bm"
_ZONES = f"""{_BANDS},
pg AS (SELECT DISTINCT doc_id, page FROM spans),
bz AS (SELECT doc_id, page, y AS top, y + height AS bottom FROM bm),
ze AS (SELECT *, coalesce(max(bottom) OVER (PARTITION BY doc_id, page ORDER BY top, bottom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM (SELECT * FROM bz UNION ALL SELECT doc_id, page, 792, 792 FROM pg)),
rz AS (SELECT * FROM bz UNION ALL SELECT doc_id, page, reach, top FROM ze WHERE top > reach),
pz AS (SELECT * FROM bz UNION ALL SELECT doc_id, page, 0, 792 FROM pg WHERE (doc_id, page) NOT IN (SELECT (doc_id, page) FROM bz)),
zn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY top, bottom) - 1 AS zone FROM {{zones}}),
zs AS (SELECT z.doc_id, z.page, zone, (s."left" + s."right") / 2 AS m FROM zn z JOIN strips s USING (doc_id, page) WHERE s.confidence >= 0.7 AND s."right" - s."left" >= 4
  AND least(z.bottom, s.bottom) > greatest(z.top, s.top) AND (least(z.bottom, s.bottom) - greatest(z.top, s.top)) / greatest(1, s.bottom - s.top, z.bottom - z.top) >= 0.4),
xs AS (SELECT DISTINCT doc_id, page, zone, m FROM zs WHERE m > 0 UNION SELECT doc_id, page, zone, 0 FROM zn),
cu AS (SELECT doc_id, page, zone, m AS l, coalesce(lead(m) OVER (PARTITION BY doc_id, page, zone ORDER BY m), 612) AS r FROM xs),
rg AS (SELECT doc_id, page, zone, l, r, row_number() OVER (PARTITION BY doc_id, page, zone ORDER BY l) - 1 AS region, count(*) OVER (PARTITION BY doc_id, page, zone) AS n FROM cu WHERE r - l > 1)"""
_ORDER = """,
sz AS (SELECT p.doc_id, p.page, p.span_id, p.para_id, p.top, p."left", p."right", z.zone, least(p.bottom, z.bottom) - greatest(p.top, z.top) AS c, (least(p.bottom, z.bottom) - greatest(p.top, z.top)) / greatest(1, p.bottom - p.top, z.bottom - z.top) AS share,
  abs((p.top + p.bottom) / 2 - (z.top + z.bottom) / 2) AS away FROM paras p JOIN zn z USING (doc_id, page)),
so AS (SELECT * FROM sz QUALIFY row_number() OVER (PARTITION BY doc_id, page, span_id ORDER BY c > 0 DESC, CASE WHEN c > 0 THEN -share ELSE away END, zone) = 1),
sc AS (SELECT so.*, region FROM so JOIN rg USING (doc_id, page, zone) QUALIFY row_number() OVER (PARTITION BY so.doc_id, so.page, span_id ORDER BY (so."left" + so."right") / 2 >= l AND (so."left" + so."right") / 2 < r DESC, CASE WHEN (so."left" + so."right") / 2 < l THEN region ELSE -region END) = 1)"""
SQL["zone_regions"] = f"""{_ZONES.replace("{zones}", "rz")}
SELECT doc_id, page, zone::INT AS zone, round(top, 6) AS top, round(bottom, 6) AS bottom, region::INT AS region, round(l, 6) AS "left", round(r, 6) AS "right" FROM zn JOIN rg USING (doc_id, page, zone)"""
SQL["column_order"] = f"""{_ZONES.replace("{zones}", "rz")}{_ORDER}
SELECT doc_id, page, span_id, zone::INT AS band, region::INT AS col, (row_number() OVER (PARTITION BY doc_id, page ORDER BY zone, region, top, "left", span_id) - 1)::INT AS pos FROM sc"""
SQL["paragraph_order"] = f"""{_ZONES.replace("{zones}", "pz")}{_ORDER}
SELECT doc_id, page, para_id, span_id, zone::INT AS band, region::INT AS col, (row_number() OVER (PARTITION BY doc_id, page, para_id ORDER BY zone, region, top, "left", span_id) - 1)::INT AS pos FROM sc"""
# First paragraphs with their page's strips and bands; folds meet them one after the other, each page's at a time.
_OPERATORS = "[" + OPERATOR_CHAR.replace("-", "\\-") + "]"
_FIRST = f"""{_BANDS},
sl AS (SELECT doc_id, page, list({{'l': "left", 'r': "right", 't': top, 'b': bottom}} ORDER BY "left", "right", top) AS st FROM strips WHERE confidence >= 0.7 AND "right" - "left" >= 6 AND bottom - top >= 12 GROUP BY ALL),
bl AS (SELECT doc_id, page, list({{'y': y, 'h': height}} ORDER BY y) AS bd FROM bm GROUP BY ALL),
pp AS (SELECT doc_id, page, para_id, min(span_id) AS id, min("left") AS l, min(top) AS t, max("right") AS r, max(bottom) AS b, first(font_size ORDER BY top, "left", span_id) AS size, first(font_family ORDER BY top, "left", span_id) AS fam,
    first(font_weight ORDER BY top, "left", span_id) AS wt, bool_or(math) AS math, bool_or(regexp_matches(text, '{_OPERATORS}')) AS op FROM paras GROUP BY ALL),
pi AS MATERIALIZED (SELECT pp.*, row_number() OVER (PARTITION BY doc_id, page ORDER BY {{order}}) AS k, line_height AS lh, coalesce(st, []) AS st, coalesce(bd, []) AS bd FROM pp JOIN lh USING (doc_id, page) LEFT JOIN sl USING (doc_id, page) LEFT JOIN bl USING (doc_id, page))"""


def _related(a: str, b: str, page: str) -> tuple[str, str, str]:
    """Alike in style, in one column, and no band between, of two boxes with a page's strips and bands; their common width; in one column."""
    low, wide = f"least({a}.r, {b}.r) - greatest({a}.l, {b}.l)", f"greatest(0, least({a}.r, {b}.r) - greatest({a}.l, {b}.l)) > 0.3 * least({a}.r - {a}.l, {b}.r - {b}.l)"
    gap = f"(CASE WHEN {a}.l < {b}.l THEN {b}.l - {a}.r ELSE {a}.l - {b}.r END)"
    east, west = f"(CASE WHEN {a}.l < {b}.l THEN {b}.l ELSE {a}.l END)", f"(CASE WHEN {a}.l < {b}.l THEN {a}.r ELSE {b}.r END)"
    top, bottom = f"least({a}.t, {b}.t)", f"greatest({a}.b, {b}.b)"
    parts = f"list_transform(list_filter({page}.st, lambda z: (least({bottom}, z.b) - greatest({top}, z.t)) / (z.b - z.t) >= 0.6), lambda z: greatest(0, least(z.r, {east}) - greatest(z.l, {west})))"
    column = f"(CASE WHEN len({page}.st) = 0 THEN {wide} AND abs(({a}.l + {a}.r) / 2 - ({b}.l + {b}.r) / 2) < 3 * greatest({a}.r - {a}.l, {b}.r - {b}.l) WHEN {bottom} <= {top} OR {wide} OR {gap} <= 0 THEN true ELSE coalesce(list_sum(list_filter({parts}, lambda z: z >= greatest(3, 0.1 * {gap}))), 0) / {gap} < 0.65 END)"
    alike = f"{a}.fam = {b}.fam AND abs({a}.size - {b}.size) <= 1 AND abs({a}.wt - {b}.wt) <= 300"
    parted = f"len(list_filter({page}.bd, lambda z: z.y > least({a}.b, {b}.b) AND z.y + z.h < greatest({a}.t, {b}.t))) > 0"
    return f"({alike} AND {column} AND NOT {parted})", low, column


def _first_fit(order: str, near: str) -> str:
    """Each paragraph joins the first group that it follows, as grown so far, or begins one."""
    fields = ("l", "t", "r", "b", "size", "fam", "wt")
    new = "{" + ", ".join(f"'{c}': p.{c}" for c in fields) + "}"
    grown = "{'l': least(g.l, p.l), 't': least(g.t, p.t), 'r': greatest(g.r, p.r), 'b': greatest(g.b, p.b), 'size': g.size, 'fam': g.fam, 'wt': g.wt}"
    follows = f"({near}) AND {_related('g', 'p', 'p')[0]}"
    return f"""{_FIRST.replace("{order}", order)},
ff AS (SELECT doc_id, page, k, [{new}] AS groups, 1::BIGINT AS grp FROM pi AS p WHERE k = 1 UNION ALL
  SELECT doc_id, page, k, CASE WHEN pos = 0 THEN groups || [fresh] ELSE list_transform(groups, lambda g, n: CASE WHEN n = pos THEN met ELSE g END) END, CASE WHEN pos = 0 THEN len(groups) + 1 ELSE pos END::BIGINT FROM (
    SELECT *, CASE WHEN pos > 0 THEN grow[pos] END AS met FROM (
      SELECT p.doc_id, p.page, p.k, f.groups, {new} AS fresh, list_transform(f.groups, lambda g: {grown}) AS grow, coalesce(list_position(list_transform(f.groups, lambda g: {follows}), true), 0) AS pos
      FROM ff f JOIN pi p ON p.doc_id = f.doc_id AND p.page = f.page AND p.k = f.k + 1))),
gm AS (SELECT ff.doc_id, ff.page, para_id, min(id) OVER (PARTITION BY ff.doc_id, ff.page, grp) AS group_id FROM ff JOIN pi USING (doc_id, page, k))
SELECT doc_id, page, span_id, group_id FROM paras JOIN gm USING (doc_id, page, para_id)"""


_SHARE = "greatest(0, least(g.r, p.r) - greatest(g.l, p.l)) > 0.25 * greatest(1, least(g.r - g.l, p.r - p.l))"
SQL["merge_pass"] = _first_fit("para_id", f"p.t - g.b <= least(p.lh * 1.35, greatest(g.size, p.size) * 2) AND (abs(g.l - p.l) < g.size * 2 OR abs(g.r - p.r) < g.size * 2 OR {_SHARE})")
SQL["stack_pass"] = _first_fit(
    "t, l, para_id", f"p.t - g.b <= least(p.lh * 1.35, greatest(g.size, p.size) * 2) AND p.t >= g.b AND (abs(g.l - p.l) < greatest(1, least(g.size, p.size) * 2) OR abs(g.r - p.r) < greatest(1, least(g.size, p.size) * 2) OR {_SHARE})"
)
_STACKS = f"p.t - g.b <= least(p.lh * 1.35, greatest(g.size, p.size) * 2) AND p.t >= g.b AND (abs(g.l - p.l) < greatest(1, least(g.size, p.size) * 2) OR abs(g.r - p.r) < greatest(1, least(g.size, p.size) * 2) OR {_SHARE})"


def _fold(name: str, source: str, order: str, near: str) -> str:
    """One pass over the paragraphs of ``source`` as CTEs: those made of them, with the first one's style and all their first paragraphs."""
    fields = ("l", "t", "r", "b", "size", "fam", "wt")
    new = "{" + ", ".join(f"'{c}': p.{c}" for c in fields) + "}"
    grown = "{'l': least(g.l, p.l), 't': least(g.t, p.t), 'r': greatest(g.r, p.r), 'b': greatest(g.b, p.b), 'size': g.size, 'fam': g.fam, 'wt': g.wt}"
    return f"""{name}_i AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY {order}) AS k FROM {source}),
{name}_f AS (SELECT doc_id, page, k, [{new}] AS groups, 1::BIGINT AS grp FROM {name}_i AS p WHERE k = 1 UNION ALL
  SELECT doc_id, page, k, CASE WHEN pos = 0 THEN groups || [fresh] ELSE list_transform(groups, lambda g, n: CASE WHEN n = pos THEN met ELSE g END) END, CASE WHEN pos = 0 THEN len(groups) + 1 ELSE pos END::BIGINT FROM (
    SELECT *, CASE WHEN pos > 0 THEN grow[pos] END AS met FROM (
      SELECT p.doc_id, p.page, p.k, f.groups, {new} AS fresh, list_transform(f.groups, lambda g: {grown}) AS grow, coalesce(list_position(list_transform(f.groups, lambda g: ({near}) AND {_related('g', 'p', 'p')[0]}), true), 0) AS pos
      FROM {name}_f f JOIN {name}_i p ON p.doc_id = f.doc_id AND p.page = f.page AND p.k = f.k + 1))),
{name} AS MATERIALIZED (SELECT doc_id, page, grp AS seen, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, arg_min(size, k) AS size, arg_min(fam, k) AS fam, arg_min(wt, k) AS wt, bool_or(math) AS math, bool_or(op) AS op, flatten(list(parts ORDER BY k)) AS parts, any_value(lh) AS lh, any_value(st) AS st, any_value(bd) AS bd
  FROM {name}_i JOIN {name}_f USING (doc_id, page, k) GROUP BY doc_id, page, grp)"""


_MOVED = 'FROM (SELECT * REPLACE (CASE WHEN span_id % 5 = 0 THEN "left" - 30 ELSE "left" END AS "left", CASE WHEN span_id % 5 = 0 THEN top - 9 ELSE top END AS top) FROM boxes))'
_REL, _LOW, _COLUMN = _related("a", "c", "a")
_HIGH = "least(a.b, c.b) - greatest(a.t, c.t)"
_HOLDS = " OR ".join(f"({x}.l - 1 <= {y}.l AND {x}.r + 1 >= {y}.r AND {x}.t - 1 <= {y}.t AND {x}.b + 1 >= {y}.b)" for x, y in (("a", "c"), ("c", "a")))
_NESTED = f"({_HOLDS} OR ({_LOW} > 0 AND {_HIGH} > 0 AND ({_LOW}) * ({_HIGH}) / coalesce(nullif(least((a.r - a.l) * (a.b - a.t), (c.r - c.l) * (c.b - c.t)), 0), 1) > 0.7))"
_SIZE = "greatest(a.size, c.size)"
_FORMULA = f"((a.math OR c.math) AND {_COLUMN} AND abs(a.t - c.t) < {_SIZE} * 2 AND CASE WHEN a.op OR c.op THEN abs(a.l - c.l) < {_SIZE} * 1.5 ELSE abs((a.l + a.r) - (c.l + c.r)) / 2 < {_SIZE} * 2.5 END)"
SQL["nest_pass"] = f"""{_FIRST.replace("{order}", "para_id").replace("FROM boxes)", _MOVED, 1)},
nj AS (SELECT a.doc_id, a.page, a.k, list(c.k ORDER BY c.k) AS js FROM pi a JOIN pi c ON c.doc_id = a.doc_id AND c.page = a.page AND c.k > a.k WHERE {_REL} AND ({_NESTED} OR {_FORMULA}) GROUP BY ALL),
nk AS (SELECT pi.doc_id, pi.page, pi.k, coalesce(js, []) AS js FROM pi LEFT JOIN nj USING (doc_id, page, k)),
nf AS (SELECT doc_id, page, k, js[1] AS j, [k] || js[1:1] AS used FROM nk WHERE k = 1 UNION ALL
  SELECT doc_id, page, k, CASE WHEN NOT taken THEN free[1] END, used || [k] || CASE WHEN taken THEN [] ELSE free[1:1] END FROM (
    SELECT n.doc_id, n.page, n.k, f.used, list_contains(f.used, n.k) AS taken, list_filter(n.js, lambda x: NOT list_contains(f.used, x)) AS free FROM nf f JOIN nk n ON n.doc_id = f.doc_id AND n.page = f.page AND n.k = f.k + 1)),
ng AS (SELECT doc_id, page, k, coalesce((SELECT min(f.k) FROM nf f WHERE f.doc_id = nk.doc_id AND f.page = nk.page AND f.j = nk.k), k) AS grp FROM nk),
gm AS (SELECT ng.doc_id, ng.page, para_id, min(id) OVER (PARTITION BY ng.doc_id, ng.page, grp) AS group_id FROM ng JOIN pi USING (doc_id, page, k))
SELECT doc_id, page, span_id, group_id FROM paras JOIN gm USING (doc_id, page, para_id)"""
SQL["split_pass"] = f"""{_FIRST.replace("{order}", "para_id")},
wg AS (SELECT *, lag("right") OVER w AS pr, lag(height) OVER w AS ph FROM paras WINDOW w AS (PARTITION BY doc_id, page, para_id, top ORDER BY "left", span_id)),
wc AS (SELECT DISTINCT doc_id, page, para_id, (pr + "left") / 2 AS cut FROM wg JOIN sl USING (doc_id, page) WHERE "left" - pr > 0.8 * least(ph, height) * 2.5 AND "left" - pr > 0.8 * least(ph, height) * 1.2),
sp AS (SELECT p.doc_id, p.page, p.para_id, p.span_id, count(cut) FILTER ((p."left" + p."right") / 2 >= cut) AS part FROM paras p LEFT JOIN wc USING (doc_id, page, para_id) GROUP BY ALL)
SELECT doc_id, page, span_id, min(span_id) OVER (PARTITION BY doc_id, page, para_id, part) AS group_id FROM sp"""
_VALID_ONLY = f"FROM (SELECT * EXCLUDE (t) FROM (SELECT *, {trim('text')} AS t FROM boxes) WHERE {VALID}))"
# Merge, then stack until nothing changes (six passes: five change something at most). Pages on which a paragraph
# would be cut or nested have no rows here: split_pass and nest_pass stand for these steps, and no page of the tables needs them.
_STACK_CHAIN = ",\n".join(_fold(f"w{n}", "m0" if n == 1 else f"w{n - 1}", "t, l, seen", _STACKS) for n in range(1, 7))
_LAYOUT = f"""{_FIRST.replace("{order}", "para_id").replace("FROM boxes)", _VALID_ONLY, 1)},
p0 AS (SELECT doc_id, page, para_id AS seen, l, t, r, b, size, fam, wt, math, op, [para_id] AS parts, lh, st, bd FROM pi),
{_fold("m0", "p0", "seen", f"p.t - g.b <= least(p.lh * 1.35, greatest(g.size, p.size) * 2) AND (abs(g.l - p.l) < g.size * 2 OR abs(g.r - p.r) < g.size * 2 OR {_SHARE})")},
wg AS (SELECT *, lag("right") OVER w AS pr, lag(height) OVER w AS ph FROM paras WINDOW w AS (PARTITION BY doc_id, page, para_id, top ORDER BY "left", span_id)),
other AS (SELECT a.doc_id, a.page FROM m0 a JOIN m0 c ON c.doc_id = a.doc_id AND c.page = a.page AND c.seen > a.seen WHERE {_REL} AND ({_NESTED} OR {_FORMULA}) UNION SELECT doc_id, page FROM wg JOIN sl USING (doc_id, page) WHERE "left" - pr > 0.8 * least(ph, height) * 2.5),
{_STACK_CHAIN},
done AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY t, l, seen) - 1 AS para_id, unnest(parts) AS part FROM w6 WHERE (doc_id, page) NOT IN (SELECT (doc_id, page) FROM other)),
fp AS MATERIALIZED (SELECT s.* REPLACE (d.para_id AS para_id) FROM done d JOIN paras s ON s.doc_id = d.doc_id AND s.page = d.page AND s.para_id = d.part)"""
SQL["page_layout"] = f"""{_LAYOUT} SELECT doc_id, page, para_id::INT AS para_id, (row_number() OVER (PARTITION BY doc_id, page, para_id ORDER BY top, "left", span_id) - 1)::INT AS pos, span_id FROM fp"""
SQL["page_segments"] = f"""WITH RECURSIVE {SPANS}, tl AS (SELECT doc_id, page, coalesce(median(height) FILTER (height > 3), 15.0) AS line FROM spans GROUP BY ALL),
ys AS (SELECT doc_id, page, line, unnest(range(ceil(792 / greatest(5.0, 0.5 * line))::INT)) * greatest(5.0, 0.5 * line) AS y FROM tl),
sm AS (SELECT y.doc_id, y.page, y.line, y.y, list_sort(list(DISTINCT s."left")) AS ls, min(s."left") AS l, max(s."right") AS r FROM ys y JOIN spans s ON s.doc_id = y.doc_id AND s.page = y.page AND s.top <= y.y AND s.bottom >= y.y GROUP BY ALL),
pt AS MATERIALIZED (SELECT doc_id, page, line, y, l, r, list_reduce(list_transform(ls, lambda x: {{'n': 1::BIGINT, 'v': x}}), lambda a, x: CASE WHEN x.v - a.v > 2 * line THEN {{'n': a.n + 1, 'v': x.v}} ELSE a END).n AS cols, row_number() OVER (PARTITION BY doc_id, page ORDER BY y) AS k FROM sm),
ch AS (SELECT doc_id, page, k, true AS turn, 0.0::DOUBLE AS since, y, l, r, cols FROM pt WHERE k = 1 UNION ALL
  SELECT doc_id, page, k, turn, y0, CASE WHEN turn THEN y ELSE y0 END, CASE WHEN turn THEN l ELSE l0 END, CASE WHEN turn THEN r ELSE r0 END, CASE WHEN turn THEN cols ELSE cols0 END FROM (
    SELECT pt.*, ch.y AS y0, ch.l AS l0, ch.r AS r0, ch.cols AS cols0, pt.cols <> ch.cols OR abs(pt.l - ch.l) > 4 * line OR abs(pt.r - ch.r) > 4 * line AS turn FROM ch JOIN pt ON pt.doc_id = ch.doc_id AND pt.page = ch.page AND pt.k = ch.k + 1)),
sg AS MATERIALIZED (SELECT doc_id, page, row_number() OVER w AS k, since AS a, CASE WHEN lead(k) OVER w IS NULL THEN 792.0 ELSE y END AS b, l, r, cols FROM ch WHERE turn WINDOW w AS (PARTITION BY doc_id, page ORDER BY k)),
jo AS (SELECT doc_id, page, k, 1::BIGINT AS gid, a, b, l, r, cols FROM sg WHERE k = 1 UNION ALL
  SELECT doc_id, page, k, CASE WHEN own THEN gid ELSE gid + 1 END, CASE WHEN own THEN a0 ELSE a END, b, CASE WHEN own THEN least(l, l0) ELSE l END, CASE WHEN own THEN greatest(r, r0) ELSE r END, CASE WHEN own THEN cols0 ELSE cols END FROM (
    SELECT sg.*, jo.gid, jo.a AS a0, jo.l AS l0, jo.r AS r0, jo.cols AS cols0, jo.b - jo.a < 2 * line OR sg.cols = jo.cols AS own FROM jo JOIN sg ON sg.doc_id = jo.doc_id AND sg.page = jo.page AND sg.k = jo.k + 1 JOIN tl ON tl.doc_id = jo.doc_id AND tl.page = jo.page)),
fi AS (SELECT jo.*, line, least(line * 0.5, (b - a) * 0.1) AS room FROM jo JOIN tl USING (doc_id, page) QUALIFY row_number() OVER (PARTITION BY doc_id, page, gid ORDER BY k DESC) = 1),
ok AS (SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY gid) - 1)::INT AS segment, greatest(0, a - room) AS top, least(792, b + room) AS bottom, l AS "left", r AS "right", cols::INT AS columns FROM fi WHERE b - a > 2 * line),
al AS (SELECT * FROM ok UNION ALL SELECT doc_id, page, 0, 0, 792, 0, 612, 1 FROM tl WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.doc_id = tl.doc_id AND ok.page = tl.page))
SELECT doc_id, page, segment, round(top, 6) AS top, round(bottom, 6) AS bottom, "left", "right", columns FROM al"""
SQL["occupied_intervals"] = f'WITH {_GAPS} SELECT doc_id, page, band::INT AS band, island::INT AS island, "left", "right" FROM f'
SQL["given_bands"] = f"WITH {SPANS} SELECT doc_id, page, count(*) AS n, min(top) AS first_y FROM spans WHERE 0.4 + font_size / 50 >= 0.6 GROUP BY ALL"
SQL["page_gutters"] = f"""WITH {SPANS}, g AS (SELECT doc_id, page, top, max(bottom) OVER (PARTITION BY doc_id, page ORDER BY top, bottom, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans)
SELECT doc_id, page, (reach + top) / 2 - 12 * 0.2::DOUBLE / 2 AS y, 12 * 0.2::DOUBLE AS height, 0.95::DOUBLE AS confidence FROM g WHERE top - reach >= 18"""
SQL["trivial_segments"] = f'WITH {SPANS} SELECT DISTINCT doc_id, page, 0 AS segment, 0.0::DOUBLE AS top, 792.0::DOUBLE AS bottom, 0.0::DOUBLE AS "left", 612.0::DOUBLE AS "right", 1 AS columns FROM spans'
SQL["forced_paragraphs"] = f"WITH {PARAS} SELECT doc_id, page, max(para_id)::INT + 1 AS n_paragraphs FROM paras GROUP BY ALL".replace("font_family = p_family AND abs(font_size - p_size) <= 1 AND abs(font_weight - p_weight) <= 300 AND (", "(")
SQL["occupancy_gaps"] = f'WITH {_GAPS} SELECT doc_id, page, band::INT AS band, "left", "right" FROM gaps'
SQL["band_merge"] = f"""WITH {SPANS}, b AS (SELECT DISTINCT doc_id, page, top AS y, height, 0.5 + font_size / 50 AS confidence FROM spans),
o AS (SELECT *, max(y + height) OVER (PARTITION BY doc_id, page ORDER BY y, height ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR y > reach + greatest(2, 11 * 0.2) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y, height ROWS UNBOUNDED PRECEDING) AS band_id FROM o)
SELECT doc_id, page, band_id::INT AS band_id, min(y) AS y, max(y + height) - min(y) AS height, max(confidence) AS confidence FROM i GROUP BY doc_id, page, band_id"""
SQL["boundary_columns"] = f"""WITH {SPANS}, d AS (SELECT DISTINCT doc_id, page, "left" AS x FROM spans WHERE "left" > 0 AND "left" < 612 UNION SELECT DISTINCT doc_id, page, 612.0 FROM spans)
SELECT * FROM (SELECT doc_id, page, row_number() OVER w AS col, coalesce(lag(x) OVER w, 0.0) AS "left", x AS "right" FROM d WINDOW w AS (PARTITION BY doc_id, page ORDER BY x)) WHERE col <= 6"""
SQL["rich_lines"] = f"WITH {PARAS}, {RICH} SELECT doc_id, page, para_id::INT AS para_id, html FROM r"
SQL["sentence_groups"] = f"""WITH {PARAS}, e AS (SELECT *, lag(CASE WHEN regexp_matches({trim("text")}, '[.?!]\\s*$') THEN 1 ELSE 0 END) OVER w AS cut FROM paras WINDOW w AS (PARTITION BY doc_id, page, para_id ORDER BY floor(top / 5), "left", span_id))
SELECT doc_id, page, para_id::INT AS para_id, span_id, sum(coalesce(cut, 0)) OVER (PARTITION BY doc_id, page, para_id ORDER BY floor(top / 5), "left", span_id)::INT AS sentence FROM e"""
SQL["translation_units"] = f"""WITH {PARAS}, {RICH},
se AS (SELECT *, lag(CASE WHEN regexp_matches({trim("text")}, '[.?!]\\s*$') THEN 1 ELSE 0 END) OVER w AS cut FROM h WINDOW w AS (PARTITION BY doc_id, page, para_id ORDER BY floor(top / 5), "left", span_id)),
sn AS (SELECT *, sum(coalesce(cut, 0)) OVER (PARTITION BY doc_id, page, para_id ORDER BY floor(top / 5), "left", span_id) AS sentence FROM se),
sl AS (SELECT doc_id, page, para_id, sentence, line, string_agg(html, ' ' ORDER BY "left", span_id) AS html FROM sn GROUP BY ALL),
sr AS (SELECT doc_id, page, para_id, sentence, string_agg(html, '<br>' ORDER BY line) AS html FROM sl GROUP BY ALL),
un AS (SELECT doc_id, page, para_id, 0 AS part, 'para-' || para_id::INT AS unit_id, html FROM r WHERE length(html) <= 400
  UNION ALL SELECT sr.doc_id, sr.page, sr.para_id, sentence, 'para-' || sr.para_id::INT || '-sent-' || sentence::INT, sr.html FROM sr JOIN r USING (doc_id, page, para_id) WHERE length(r.html) > 400)
SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY para_id, part) - 1)::INT AS ord, unit_id, html AS text FROM un WHERE length(html) > 5"""
SQL["translation_modes"] = """WITH u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) || '. ' || text AS line FROM conversations),
m AS (SELECT conv_id, count(*) AS n, sum(length(line))::BIGINT + count(*) - 1 AS chars FROM u GROUP BY conv_id)
SELECT *, CASE WHEN n > 1 AND chars > 1500 THEN 'chunked' WHEN n > 1 THEN 'batch' ELSE 'single' END AS mode FROM m"""
# A pointer walks over the units: it puts one into the chunk, or closes the chunk, and may step back to the unit that moves on.
SQL["unit_packing"] = f"""WITH RECURSIVE u AS MATERIALIZED (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, length(text) AS size, {trim("text")} LIKE '%<br>' OR regexp_matches({trim("text")}, '[.?!](\\s*</[bi]>)*\\s*$') AS ends FROM conversations),
w AS (SELECT conv_id, 0::BIGINT AS step, 0::BIGINT AS i, 0::BIGINT AS chunk, 0::BIGINT AS n, 0::BIGINT AS used, NULL::BIGINT AS placed FROM u WHERE i = 0 UNION ALL
  SELECT conv_id, step + 1, CASE WHEN NOT closes THEN i + 1 WHEN n > 1 AND NOT before THEN i - 1 ELSE i END, CASE WHEN closes THEN chunk + 1 ELSE chunk END, CASE WHEN closes THEN 0 ELSE n + 1 END, CASE WHEN closes THEN 0 ELSE used + own END, CASE WHEN closes THEN NULL ELSE i END FROM (
    SELECT w.*, length((n + 1)::VARCHAR) + 3 + u.size AS own, used > 0 AND used + length((n + 1)::VARCHAR) + 3 + u.size > 1500 AS closes, p.ends AS before FROM w JOIN u ON u.conv_id = w.conv_id AND u.i = w.i LEFT JOIN u p ON p.conv_id = w.conv_id AND p.i = w.i - 1)),
f AS (SELECT conv_id, placed, chunk FROM w WHERE placed IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, placed ORDER BY step DESC) = 1)
SELECT f.conv_id, chunk::INT AS chunk_id, (row_number() OVER (PARTITION BY f.conv_id, chunk ORDER BY placed) - 1)::INT AS ord_in_chunk, turn AS ord FROM f JOIN u ON u.conv_id = f.conv_id AND u.i = f.placed"""
_REPLY = """t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, replace(text, chr(10), ' ') AS original, (conv_id + turn) % 3 = 0 AS lost FROM conversations),
l AS (SELECT conv_id, ord, original, CASE WHEN lost THEN 'Translation missing' ELSE trim(original) END AS line, count(*) OVER (PARTITION BY conv_id) AS n, sum(CASE WHEN lost THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS gone FROM t)"""
SQL["numbered_reply"] = f"""WITH {_REPLY},
k AS (SELECT conv_id, count(*) AS n, count(*) FILTER (NOT lost) + CASE conv_id % 5 WHEN 2 THEN 1 ELSE 0 END AS found, coalesce(list({trim("original")} ORDER BY ord) FILTER (NOT lost), []) || CASE conv_id % 5 WHEN 2 THEN ['again'] ELSE [] END AS plain FROM t GROUP BY conv_id),
c AS (SELECT t.conv_id, ord, lost, {trim("original")} AS own, k.n, CASE k.conv_id % 5 WHEN 1 THEN 0 ELSE found END < 0.5 * k.n AS few, CASE WHEN len(plain) = 0 THEN [''] ELSE plain END AS plain FROM t JOIN k USING (conv_id))
SELECT conv_id, ord::INT AS ord, CASE WHEN few AND ord < len(plain) THEN plain[ord + 1] WHEN conv_id % 5 = 2 AND ord = 0 THEN 'again' WHEN conv_id % 5 = 1 OR lost THEN 'Translation missing' ELSE own END AS line FROM c"""
SQL["line_count_check"] = f"""WITH {_REPLY}, a AS (SELECT conv_id, count(*) AS n_units, nullif(count(*) FILTER (NOT lost OR conv_id % 2 = 0), 0) AS n_lines FROM t GROUP BY conv_id) SELECT * FROM a WHERE n_units <> coalesce(n_lines, 0)"""
SQL["fallback_fill"] = f"WITH {_REPLY} SELECT conv_id, ord::INT AS ord, CASE WHEN (n > 1 AND gone > 0.5 * n) OR line = 'Translation missing' THEN original ELSE line END AS final FROM l"
SQL["reassemble"] = "SELECT conv_id, 'para-' || turn // 3 AS paragraph_id, string_agg(text, ' ' ORDER BY turn) AS text, count(*) AS n_units FROM conversations GROUP BY ALL"
SQL["region_replace"] = f"""WITH {PARAS}, b AS (SELECT doc_id, page, para_id, min("left") / 612 AS l, min(top) / 792 AS t, (max("right") - min("left")) / 612 AS w, (max(bottom) - min(top)) / 792 AS h FROM paras GROUP BY ALL),
n AS (SELECT * FROM b WHERE para_id % 5 = 0), o AS (SELECT * FROM b WHERE para_id % 5 <> 0),
u AS (SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = o.doc_id AND n.page = o.page AND o.l <= n.l + n.w + 1e-5 AND o.l + o.w >= n.l - 1e-5 AND o.t <= n.t + n.h + 1e-5 AND o.t + o.h >= n.t - 1e-5))
SELECT doc_id, page, para_id::INT AS para_id, round(l, 6) AS rel_left, round(t, 6) AS rel_top, round(w, 6) AS rel_width, round(h, 6) AS rel_height FROM u"""
SQL["region_cells"] = SQL["region_replace"]
SQL["region_join"] = """WITH o AS (SELECT p_partkey % 50 AS page, p_partkey AS id, (p_partkey * 7) % 40 / 40.0::DOUBLE AS l, (p_partkey * 13) % 40 / 40.0::DOUBLE AS t FROM part), n AS (SELECT s_suppkey % 50 AS page, s_suppkey AS id, (s_suppkey * 7 + 3) % 40 / 40.0::DOUBLE AS l, (s_suppkey * 13) % 40 / 40.0::DOUBLE AS t FROM supplier),
u AS (SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.page = o.page AND o.l <= n.l + 0.04 + 1e-5 AND o.l + 0.04 >= n.l - 1e-5 AND o.t <= n.t + 0.03 + 1e-5 AND o.t + 0.03 >= n.t - 1e-5))
SELECT page, id, round(l, 6) AS rel_left, round(t, 6) AS rel_top FROM u"""
_PAGES = "e AS (SELECT 'doc' || user_id AS doc, (event_id % 7 + 1)::VARCHAR AS page_key, event_id AS ord, value, event_type FROM events)"
SQL["page_upsert"] = f"""WITH {_PAGES}, s AS (SELECT * FROM e WHERE ord % 3 = 0), c AS (SELECT * FROM e WHERE ord % 3 <> 0), k AS (SELECT DISTINCT doc, page_key FROM c WHERE ord % 11 < 4)
SELECT doc, page_key, ord, value FROM s WHERE (doc, page_key) NOT IN (SELECT (doc, page_key) FROM k) UNION ALL SELECT doc, page_key, ord, value FROM c WHERE event_type <> 'click' AND (doc, page_key) IN (SELECT (doc, page_key) FROM k)"""
SQL["page_saves"] = f"""WITH {_PAGES}, k AS (SELECT DISTINCT doc, page_key FROM e WHERE event_type = 'view')
SELECT doc, page_key, ord, event_type FROM e WHERE event_type = 'view' OR (doc, page_key) NOT IN (SELECT (doc, page_key) FROM k)"""
SQL["page_deletes"] = f"""WITH {_PAGES}, k AS (SELECT DISTINCT doc, page_key FROM e WHERE event_type IN ('view', 'click'))
SELECT doc, count(DISTINCT CASE WHEN (doc, page_key) NOT IN (SELECT (doc, page_key) FROM k) THEN page_key END) AS pages FROM e GROUP BY doc"""
_STORED = """(1 + doc_id % 3)::VARCHAR AS page_key, (1 + doc_id % 3)::INT AS page, source AS text_content, lang || chr(10) || source AS translated_text, round((doc_id % 97) / 97.0::DOUBLE, 4) AS rel_left,
  round(1 / 3.0::DOUBLE, 4) AS rel_top, 0.5::DOUBLE AS rel_width, round((1 + doc_id % 7) / 9.0::DOUBLE, 4) AS rel_height, round(8 + (doc_id % 11) / 7.0::DOUBLE, 2) AS font_size, CASE WHEN doc_id % 2 = 0 THEN 'Serif' END AS font_family"""
SQL["store_round_trip"] = f"SELECT 'lib/doc ' || doc_id || '.pdf' AS doc, {_STORED}, epoch_us(TIMESTAMP '2024-01-02 03:04:05') AS ts_us FROM documents"
SQL["note_files"] = f"SELECT 'notes/doc ' || doc_id || '.translations.md' AS note_path, {_STORED} FROM documents"
SQL["note_records"] = "SELECT 'lib/doc ' || doc_id || '.pdf' AS doc, (1 + doc_id % 3)::VARCHAR AS page_key, source AS text_content FROM documents WHERE doc_id IN (SELECT s_suppkey FROM supplier)"
SQL["note_map"] = "SELECT 'lib/doc ' || doc_id || '.pdf' AS pdf_path, 'notes/doc ' || doc_id || '.translations.md' AS note_path FROM documents"
SQL["old_notes"] = """SELECT 'd' || doc_id AS doc, (1 + doc_id % 3)::VARCHAR AS page_key, (1 + doc_id % 4)::INT AS page, source || ' | x' AS text_content, lang || chr(10) || 'end' AS translated_text, 0.25::DOUBLE AS rel_left, 0.0625::DOUBLE AS rel_height, (8 + doc_id % 5)::DOUBLE AS font_size FROM documents WHERE doc_id % 11 <> 0"""
SQL["source_links"] = """WITH c AS (SELECT doc_id, 'pdf-source: ' || chr(39) || '[[new ' || doc_id || '.pdf]]' || chr(39) || chr(10) AS link, '# ' || source || chr(10) || 'pdf-source: not here' AS body, '---' || chr(10) AS rule, 'x: 1' || chr(10) AS x FROM documents)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN rule || x || link || rule || body WHEN 1 THEN rule || link || x || rule || body ELSE body END AS content FROM c"""
SQL["note_times"] = "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, CASE WHEN event_id % 10 = 0 THEN 946684800000 ELSE epoch_us(ts) // 1000 END AS ms FROM events"
SQL["path_map"] = """WITH f AS (SELECT 'lib/' || source || '/doc' || doc_id || '.pdf' AS path, 'doc' || doc_id || '.pdf' AS name, doc_id FROM documents)
SELECT path AS pdf_path, 'notes/' || CASE WHEN doc_id % 4 = 0 THEN 'z' ELSE 'n' END || doc_id || '.md' AS note_path FROM f"""
SQL["note_lookup"] = "SELECT 'lib/' || doc_id || '.pdf' AS pdf_path, CASE WHEN doc_id % 3 <> 0 THEN 'n/' || doc_id || '.translations.md' END AS note_path FROM documents"
SQL["file_lookup"] = "SELECT 'n/' || doc_id || '.translations.md' AS note_path, 'lib/' || doc_id || '.pdf' AS pdf_path FROM documents WHERE doc_id IN (SELECT c_custkey * 3 FROM customer)"
_UNITS = """u AS (SELECT conv_id % 40 AS doc_id, (conv_id // 40 + 1)::INT AS page, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, replace(text, chr(10), ' ') AS original FROM conversations),
m AS (SELECT doc_id, page, count(*) AS n, sum(length((ord + 1) || '. ' || original))::BIGINT + count(*) - 1 AS chars FROM u GROUP BY ALL),
d AS (SELECT *, CASE WHEN n > 1 AND chars > 1500 THEN 'chunked' WHEN n > 1 THEN 'batch' ELSE 'single' END AS mode FROM m)"""
SQL["translate_job"] = f"WITH {_UNITS} SELECT doc_id, page, ord::INT AS ord, mode, original, replace(original, 'th', 'z') AS final FROM u JOIN d USING (doc_id, page)"
SQL["unit_job"] = f"""WITH {_UNITS}, a AS (SELECT *, CASE WHEN length(substr(original, 1, 200)) % 4 = 0 THEN 'Translation missing' ELSE substr(original, 1, 200) || chr(10) || 'and so on' END AS line FROM u),
b AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page) AS n, count(*) FILTER (line = 'Translation missing') OVER (PARTITION BY doc_id, page) AS gone FROM a)
SELECT doc_id, page, ord::INT AS ord, line, CASE WHEN (n > 1 AND gone > 0.5 * n) OR line = 'Translation missing' THEN original ELSE line END AS final FROM b"""
_JOB = f"""{_UNITS}, j AS (SELECT doc_id, page, d.n AS units, CASE WHEN mode = 'batch' AND chars % 5 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN mode = 'batch' AND chars % 5 = 0 THEN d.n WHEN mode = 'single' AND max(length(original)) % 5 = 0 THEN 1 ELSE 0 END AS missing
  FROM d JOIN u USING (doc_id, page) WHERE page BETWEEN 1 AND 3 GROUP BY doc_id, page, d.n, mode, chars)"""
SQL["page_range_job"] = f"WITH {_JOB} SELECT doc_id, page, units, missing, status FROM j"
SQL["job_progress"] = f"WITH {_JOB} SELECT doc_id, count(*) AS pages, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, 0::BIGINT AS cancelled FROM j GROUP BY doc_id"
SQL["provider_answers"] = f"SELECT conv_id, turn, {trim("text")} AS answer FROM conversations"
SQL["moved_notes"] = """SELECT CASE WHEN doc_id % 4 = 0 THEN 'new/x' || doc_id || '.pdf' ELSE 'lib/' || doc_id || '.pdf' END AS pdf_path, 'n/' || CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE '' END || doc_id || '.translations.md' AS note_path, 'n/' || doc_id || '.translations.md' AS old_note_path FROM documents WHERE doc_id % 7 <> 0"""
SQL["streamed_store"] = """WITH r AS (SELECT event_id // 40 AS w, 'doc' || (event_id // 40) % 30 AS doc, (event_id % 4 + 1)::VARCHAR AS page_key, ((event_id // 4) % 10)::INT AS ord, CASE WHEN (event_id // 40 + event_id % 4) % 9 > 0 THEN event_type END AS text_content, event_id::VARCHAR AS translated_text FROM events),
l AS (SELECT *, rank() OVER (PARTITION BY doc, page_key ORDER BY w * 7 % 1009 DESC) AS k FROM r)
SELECT doc, page_key, ord, text_content, translated_text FROM l WHERE k = 1 AND text_content IS NOT NULL"""
SQL["debounced_changes"] = """WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM e)
SELECT user_id, count(*) AS n_events, epoch_us(min(ts))::BIGINT AS first_us, epoch_us(max(ts))::BIGINT AS last_us FROM g GROUP BY user_id, burst"""
SQL["latest_paths"] = """WITH c AS (SELECT 'p' || user_id % 500 AS path, 'p' || (user_id + 1) % 500 AS old_path, event_id AS ts, CASE event_type WHEN 'click' THEN 'delete' WHEN 'view' THEN 'rename' ELSE 'upsert' END AS op FROM events),
a AS (SELECT path, ts, CASE WHEN op = 'delete' THEN 0 ELSE 1 END AS alive FROM c UNION ALL SELECT old_path, ts, 0 FROM c WHERE op = 'rename'),
m AS (SELECT path, ts, alive, row_number() OVER (PARTITION BY path ORDER BY ts DESC, alive DESC) AS k FROM a)
SELECT path, ts FROM m WHERE k = 1 AND alive = 1"""
SQL["pages_in_view"] = f"""WITH {SPANS}, p AS (SELECT DISTINCT doc_id, page FROM spans),
b AS (SELECT doc_id, page, (page - 1) * 800.0::DOUBLE - doc_id * 37 % 3000 AS top FROM p)
SELECT doc_id, first(page ORDER BY greatest(0, least(900, top + 792) - greatest(0, top)) DESC, page) AS largest_page,
  first(page ORDER BY abs(top + 396 - 450), page) FILTER (top + 792 > 0 AND top < 900) AS central_page,
  count(*) FILTER (top + 792 > 0 AND top < 900) AS n_visible, count(*) FILTER (top + 792 >= -200 AND top <= 1100) AS n_near FROM b GROUP BY doc_id"""
SQL["pages_with_items"] = """WITH k AS (SELECT source, CASE WHEN doc_id % 5 = 0 THEN lang ELSE (doc_id % 7 - 1)::VARCHAR END AS k FROM documents)
SELECT DISTINCT source, TRY_CAST(k AS DOUBLE) AS page FROM k WHERE TRY_CAST(k AS DOUBLE) > 0"""
SQL["folder_search"] = """WITH f AS (SELECT 'Lib/' || event_type || '/U' || user_id % 50 AS folder FROM events)
SELECT folder, count(*) AS n_files FROM f WHERE contains(lower(folder), '/u1') GROUP BY folder"""
SQL["copied_text"] = """WITH c AS (SELECT conv_id, turn, text, 'talk ' || conv_id || '.pdf' AS name, '[[lib/' || role || '/talk ' || conv_id || '.pdf#page=' || turn || ']]' AS link FROM conversations)
SELECT conv_id, turn, '> ' || replace(text, chr(10), chr(10) || '> ') || chr(10) || name || ' ' || link || ' ' || turn || ': ' || text AS copied FROM c"""
SQL["preset_upsert"] = """WITH n AS (SELECT p_partkey * 2 AS id, p_name AS name, p_brand AS settings FROM part),
s AS (SELECT n.id, n.name, n.settings, CASE WHEN c_custkey IS NULL THEN '2024-06-01' ELSE '2024-01-01' END AS created_at, '2024-06-01' AS updated_at FROM n LEFT JOIN customer ON c_custkey = n.id
  UNION ALL SELECT c_custkey, c_name, c_mktsegment, '2024-01-01', '2024-01-01' FROM customer WHERE c_custkey NOT IN (SELECT id FROM n))
SELECT * FROM s WHERE id NOT IN (SELECT s_suppkey * 3 FROM supplier)"""
SQL["position_read_back"] = f"""WITH {SPANS} SELECT doc_id, span_id, round(("left" - 10) / 612, 4) AS rel_left, round((top - 20) / 792, 4) AS rel_top, round(width / 612, 4) AS rel_width, round(height / 792, 4) AS rel_height,
  CASE WHEN span_id % 3 <> 0 THEN round((font_size / 1.25::DOUBLE + height / 1.25::DOUBLE) / 2, 4) END AS font_size, CASE WHEN span_id % 3 = 0 THEN 0 ELSE 2 END AS n_sizes FROM spans"""
SQL["position_read_back_plain"] = f"""WITH {SPANS} SELECT doc_id, span_id, round(("left" - 10) / 612, 4) AS rel_left, height / 2 AS first_size, CASE WHEN span_id % 2 = 1 THEN font_family END AS font_family FROM spans"""
SQL["selected_spans"] = f"""WITH {SPANS}, v AS (SELECT *, {trim('text')} AS t, 100 + doc_id % 50 AS side FROM spans)
SELECT doc_id, page, span_id FROM v WHERE doc_id % 6 <> 0 AND "left" <= 300 + side AND "right" >= 300 AND top <= 71 + side AND bottom >= 71 AND {VALID}"""
SQL["absolute_rects"] = f"""WITH {SPANS} SELECT doc_id, span_id, round("left" / 612 * 1000 + 10, 4) AS abs_left, round(top / 792 * 1400 + 20, 4) AS abs_top, round(width / 612 * 1000, 4) AS abs_width, round(height / 792 * 1400, 4) AS abs_height,
  floor(least(greatest(font_size / 7, 0.8), 2.0) * 10 + 0.5) / 10 AS shown_line FROM spans"""
SQL["rect_relations"] = f"""WITH {SPANS}, p AS (SELECT *, lag("left") OVER w - 30 AS l, lag(top) OVER w AS t, lag("right") OVER w + 40 AS r, lag(bottom) OVER w + 16.5 AS b FROM spans WINDOW w AS (PARTITION BY doc_id, page ORDER BY span_id))
SELECT doc_id, span_id, l - 1 <= "left" AND r + 1 >= "right" AND t - 1 <= top AND b + 1 >= bottom AS holds, greatest(l, "left") < least(r, "right") AND greatest(t, top) < least(b, bottom) AS crosses,
  round(greatest(0, least(r, "right") - greatest(l, "left")) * greatest(0, least(b, bottom) - greatest(t, top)), 4) AS shared FROM p WHERE l IS NOT NULL"""
SQL["snapshots"] = f"""WITH {SPANS}, m AS (SELECT *, length(text) > 0 AND regexp_matches(text, '{MATH_CHAR}') AS math FROM spans)
SELECT doc_id, span_id, "left" / 2 AS "left", height / 2 AS height, font_size / 2 AS font_size, font_weight::INT AS weight, '0,0,0' AS rgb, math AS is_math, CASE WHEN NOT math THEN 'none' WHEN contains(text, '=') OR contains(text, '∑') THEN 'equation' ELSE 'inline' END AS math_context,
  font_family || '|' || printf('%.1f', floor(font_size / 2 * 2 + 0.5) / 2) || '|' || font_weight || '|' || font_style || '|0,0,0' AS style_sig FROM m"""
SQL["preset_by_id"] = "SELECT p_partkey AS id, p_name AS name, p_brand AS settings, 'a' AS created_at, 'b' AS updated_at FROM part WHERE p_partkey = 17"
SQL["target_languages"] = f"WITH l(lang, lang_name) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in LANGUAGES.items())}) SELECT l.lang, lang_name, count(doc_id) AS n FROM l LEFT JOIN documents d ON d.lang = l.lang WHERE l.lang <> 'auto' GROUP BY ALL"
_RENAMES = """e AS (SELECT user_id, 2 + user_id % 3 AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
log AS (SELECT user_id, 'lib/u' || user_id || '-' || (k - 1) % m || '.pdf' AS old_path, 'lib/u' || user_id || '-' || k % m || '.pdf' AS path, k FROM e),
nxt AS (SELECT a.path, a.k, min(b.k) AS next FROM log a LEFT JOIN log b ON b.old_path = a.path AND b.k > a.k GROUP BY a.path, a.k),
walk AS (
  SELECT old_path AS first, path, k, 1 AS hops FROM log WHERE k = (SELECT min(k) FROM log) UNION ALL
  SELECT w.first, l.path, l.k, w.hops + 1 FROM walk w JOIN nxt n ON n.path = w.path AND n.k = w.k JOIN log l ON l.old_path = w.path AND l.k = n.next),
ends AS (SELECT first, arg_max(path, hops) AS path, max(hops) AS hops FROM walk GROUP BY first)"""
SQL["rename_chains"] = f"WITH RECURSIVE {_RENAMES} SELECT first AS old_path, path, hops::BIGINT AS hops, false AS replaced FROM ends"
SQL["chained_notes"] = f"WITH RECURSIVE {_RENAMES} SELECT path AS pdf_path, 'n/' || replace(string_split(path, '/')[2], '.pdf', '.translations.md') AS note_path FROM ends"
SQL["followed_files"] = """WITH e AS (SELECT 'f' || user_id AS file, 'lib/' || event_type || event_id % 11 || '.pdf' AS path, ts FROM events)
SELECT file, first(path ORDER BY ts, path) AS first_path, first(path ORDER BY ts DESC, path DESC) AS path, count(*) AS n_names FROM e GROUP BY file"""
SQL["streamed_path_map"] = """WITH k AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'more/o' || doc_id || '.pdf' WHEN doc_id % 5 = 0 THEN 'lib/new' || doc_id || '.pdf' ELSE 'lib/d' || doc_id || '.pdf' END AS pdf_path FROM documents WHERE doc_id % 7 <> 0)
SELECT pdf_path, 'n/' || CASE WHEN doc_id % 5 = 0 AND doc_id % 3 <> 0 THEN 'new' ELSE 'd' END || doc_id || '.translations.md' AS note_path FROM k"""
SQL["stored_page_range"] = """WITH p AS (SELECT 'doc' || user_id AS doc, event_id % 60 + 1 AS page, max(event_type) AS text FROM events GROUP BY ALL)
SELECT doc, page::VARCHAR AS page_key, CASE WHEN page % 3 = 0 THEN 'new ' || text ELSE text END AS text_content FROM p WHERE page BETWEEN 9 AND 40 AND NOT (page % 3 = 0 AND page % 11 = 0)"""
# What the pages' markup is made of: one script with a tag in a string, comments, tags without > in attributes, four references, an end anywhere.
_MASKED = "regexp_replace(replace(html, 'var t=\"</p>\";', 'var t=\"' || chr(2) || '\";'), '(?s)<!--.*?(-->|$)', '', 'g')"
_TAG = "<[a-zA-Z!][^>]*(>|$)|</[a-zA-Z][^>]*(>|$)"
_DECODED = "replace(regexp_replace(replace(replace(replace({}, '&quot;', chr(34)), '&copy;', '©'), '&middot;', '·'), '&amp;?', chr(1), 'g'), chr(1), '&')"
SQL["page_content"] = f"SELECT page_id, replace({_DECODED.format(f"regexp_replace({_MASKED}, '{_TAG}', '', 'g')")}, chr(2), '</p>') AS content FROM pages"
_BLOCK = f"</?({'|'.join(BLOCKS)}|br)([ \\t\\n\\r\\f/][^>]*)?>"
SQL["page_text"] = f"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace({_MASKED}, '(?s)<(script)>.*?(</script>|$)|<style>.*?(</style>|$)|<title>.*?(</title>|$)', '', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'), '{_BLOCK}', chr(10), 'g') AS h FROM pages)
SELECT page_id, array_to_string(list_filter(list_transform(string_split({_DECODED.format(f"regexp_replace(h, '{_TAG}', '', 'g')")}, chr(10)), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM t"""
SQL["page_links"] = """SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"[^>]*>', 1)) AS href FROM pages) GROUP BY ALL"""
SQL["page_tags"] = f"""WITH m AS (SELECT page_id, html, {_MASKED} AS h FROM pages),
t AS (SELECT page_id, 'start' AS kind, unnest(regexp_extract_all(h, '<([a-zA-Z][a-zA-Z0-9]*)[^>]*>', 1)) AS name FROM m UNION ALL SELECT page_id, 'end', unnest(regexp_extract_all(h, '</([a-zA-Z][a-zA-Z0-9]*)[^>]*>', 1)) FROM m
  UNION ALL SELECT page_id, 'comment', unnest(regexp_extract_all(html, '<!(--)', 1)) FROM m UNION ALL SELECT page_id, 'doctype', unnest(regexp_extract_all(h, '<!DOCTYPE (html)>', 1)) FROM m)
SELECT page_id, kind, CASE WHEN kind = 'comment' THEN '' ELSE name END AS name, count(*) AS n FROM t GROUP BY ALL"""
SQL["numbered_reply_in_sql"] = SQL["numbered_reply"]
SQL["old_notes_in_sql"] = SQL["old_notes"]
SQL["note_source"] = SQL["note_files"]
_UNIT_PARTS = f"""{RICH.replace("FROM paras)", "FROM fp)")},
se AS (SELECT *, lag(CASE WHEN regexp_matches({trim("text")}, '[.?!]\\s*$') THEN 1 ELSE 0 END) OVER w AS cut FROM h WINDOW w AS (PARTITION BY doc_id, page, para_id ORDER BY floor(top / 5), "left", span_id)),
sn AS (SELECT *, sum(coalesce(cut, 0)) OVER (PARTITION BY doc_id, page, para_id ORDER BY floor(top / 5), "left", span_id) AS sentence FROM se),
un AS (SELECT doc_id, page, para_id, CASE WHEN length(r.html) > 600 THEN sentence ELSE -1 END AS part, sn."left", sn."right", top, bottom, font_family, line, span_id, sn.html FROM sn JOIN r USING (doc_id, page, para_id)),
ul AS (SELECT doc_id, page, para_id, part, line, string_agg(html, ' ' ORDER BY "left", span_id) AS html, min("left") AS l, max("right") AS r, min(top) AS t, max(bottom) AS b, min(font_family) AS fam FROM un GROUP BY ALL),
ur AS (SELECT doc_id, page, para_id, part, string_agg(html, '<br>' ORDER BY line) AS text, min(l) AS l, max(r) AS r, min(t) AS t, max(b) AS b, min(fam) AS fam FROM ul GROUP BY ALL)"""
SQL["page_units"] = f"""{_LAYOUT}, {_UNIT_PARTS}
SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY para_id, part) - 1)::INT AS ord, 'para-' || para_id::INT || CASE WHEN part >= 0 THEN '-sent-' || part::INT ELSE '' END AS unit_id, 'para-' || para_id::INT AS paragraph_id, text,
  l AS "left", t AS top, r AS "right", b AS bottom, fam AS font_family FROM ur WHERE length(text) > 5"""
_CHOSEN = f"""FROM (SELECT * EXCLUDE (t, sl, st) FROM (SELECT *, {trim('text')} AS t, 40.0 + doc_id % 300 AS sl, 50.0 + page * 37 % 400 AS st FROM boxes) WHERE {VALID} AND doc_id % 7 > 0 AND "left" <= sl + doc_id % 7 * 60 AND "left" + width >= sl AND top <= st + 120 AND top + height >= st))"""
SQL["region_job"] = f"""{_LAYOUT.replace(_VALID_ONLY, _CHOSEN)}, {_UNIT_PARTS.replace("> 600", "> 7500")},
fresh AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY para_id, part) - 1 AS ord, l / 612 AS rl, t / 792 AS rt, (r - l) / 612 AS rw, (b - t) / 792 AS rh, replace(text, 'th', 'z') AS text FROM ur WHERE length(text) > 5),
old AS (SELECT doc_id, page, para_id + 1000 AS ord, min("left") / 612 AS rl, min(top) / 792 AS rt, (max("right") - min("left")) / 612 AS rw, (max(bottom) - min(top)) / 792 AS rh, NULL::VARCHAR AS text FROM (WITH {PARAS} SELECT * FROM paras) GROUP BY doc_id, page, para_id),
u AS (SELECT *, true AS is_new FROM fresh UNION ALL SELECT *, false FROM old o WHERE NOT EXISTS (SELECT 1 FROM fresh n WHERE n.doc_id = o.doc_id AND n.page = o.page AND o.rl <= n.rl + n.rw + 1e-5 AND o.rl + o.rw >= n.rl - 1e-5 AND o.rt <= n.rt + n.rh + 1e-5 AND o.rt + o.rh >= n.rt - 1e-5))
SELECT doc_id, page, ord::INT AS ord, round(rl, 6) AS rel_left, round(rt, 6) AS rel_top, round(rw, 6) AS rel_width, round(rh, 6) AS rel_height, text, is_new FROM u"""
