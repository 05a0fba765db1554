"""Queries of geometry, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as g
from .adapters import RECTS, REGIONS, oracle, view
from .registry import register

_PAIRS = f"""rects AS ({oracle(RECTS)}), regions AS ({oracle(REGIONS)}), pairs AS (SELECT region_id, leaf_id, greatest(0, least(r.x + r.width, l.x + l.width) - greatest(r.x, l.x)) * greatest(0, least(r.y + r.height, l.y + l.height) - greatest(r.y, l.y)) AS area, l.width * l.height AS whole FROM regions r JOIN rects l USING (page)), near AS (SELECT * FROM pairs WHERE area > 0)"""
_pairs = lambda s, d: g.region_overlaps(_f(view(s, d, REGIONS)), _f(view(s, d, RECTS)))


def _f(df):
    return df.withColumns({c: F.col(c).cast("double") for c in ("x", "y", "width", "height")})


register("region_overlaps", lambda s, d: _pairs(s, d).withColumn("area", F.round("area", 6)).withColumn("whole", F.round("whole", 6)), f"WITH {_PAIRS} SELECT region_id, leaf_id, CAST(round(area, 6) AS DOUBLE) AS area, CAST(round(whole, 6) AS DOUBLE) AS whole FROM near")
register("region_hits", lambda s, d: g.region_hits(_pairs(s, d)), f"WITH {_PAIRS}, c AS (SELECT *, CAST(area AS DOUBLE) / CAST(whole AS DOUBLE) AS c FROM near) SELECT region_id, leaf_id, round(c, 6) AS coverage, CASE WHEN c >= 0.995 THEN 'whole' WHEN c >= 0.5 THEN 'part' ELSE 'skipped' END AS hit FROM c")
register("best_overlap", lambda s, d: g.best_overlap(_pairs(s, d)), f"WITH {_PAIRS} SELECT leaf_id, first(region_id ORDER BY area DESC, region_id) AS region_id FROM near GROUP BY leaf_id")
_UNION = f"rects AS ({oracle(RECTS)}), u AS (SELECT page, CAST(min(x) AS DOUBLE) AS x0, CAST(min(y) AS DOUBLE) AS y0, CAST(max(x + width) AS DOUBLE) AS x1, CAST(max(y + height) AS DOUBLE) AS y1 FROM rects GROUP BY page)"
register("union_boxes", lambda s, d: g.union_boxes(_f(view(s, d, RECTS)), "page"), f"WITH {_UNION} SELECT * FROM u")
register("crop_regions", lambda s, d: g.crops(g.union_boxes(_f(view(s, d, RECTS)), "page"), 90.0, 40.0), f"WITH {_UNION}, c AS (SELECT page, greatest(0, x0 - 6) AS x0, greatest(0, y0 - 6) AS y0, least(90, x1 + 6) AS x1, least(40, y1 + 6) AS y1 FROM u) SELECT page, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, round(least(3.0, 1568 / greatest(x1 - x0, y1 - y0)), 6) AS scale FROM c")


def _lines(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))


_RAW = "raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE text IS NOT NULL)"
_INKED = f"{_RAW}, inked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS line_no FROM raw WHERE translate(text, ' ' || chr(9) || chr(13), '') <> ''), lines AS (SELECT doc_id, line_no, length(translate(text, ' ' || chr(9) || chr(13), '')) AS n, CAST(line * 20 AS DOUBLE) AS top, CAST(line * 20 + 10 AS DOUBLE) AS bottom FROM inked)"
register("line_clusters", lambda s, d: g.line_clusters(g.glyphs(_lines(s, d))), f"WITH {_INKED} SELECT * FROM lines")
register("row_dividers", lambda s, d: g.row_dividers(g.line_clusters(g.glyphs(_lines(s, d)))), f"WITH {_INKED}, a AS (SELECT doc_id, bottom, lead(top) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM lines), p AS (SELECT doc_id, nxt - bottom AS gap, (nxt + bottom) / 2 AS y FROM a WHERE nxt IS NOT NULL), s AS (SELECT doc_id, gap, gap / lag(gap) OVER (PARTITION BY doc_id ORDER BY gap) AS ratio FROM (SELECT DISTINCT doc_id, gap FROM p)), b AS (SELECT doc_id, first(gap ORDER BY ratio DESC, gap) AS least_ FROM s WHERE ratio >= 1.6 GROUP BY doc_id) SELECT p.doc_id, y FROM p LEFT JOIN b USING (doc_id) WHERE least_ IS NULL OR gap >= least_")
register("words_in_grid", lambda s, d: g.words(g.glyphs(_lines(s, d))), f"WITH {_RAW}, w AS (SELECT doc_id, line, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, line, regexp_extract_all(text, '[^ \\t\\r]+') AS ws FROM raw)) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line, i) AS INT) AS word_no, length(w) AS n FROM w")
register("phrases", lambda s, d: g.phrases(g.glyphs(_lines(s, d))).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("x1").alias("right")), f"WITH {_RAW}, p AS (SELECT doc_id, len(regexp_extract_all(regexp_replace(text, '[\\t\\r]', ' ', 'g'), '[^ ]+( [^ ]+)*')) AS k, length(rtrim(text, ' ' || chr(9) || chr(13))) * 6.0 AS e FROM raw) SELECT doc_id, CAST(sum(k) AS BIGINT) AS n, CAST(max(e) FILTER (k > 0) AS DOUBLE) AS \"right\" FROM p GROUP BY doc_id HAVING sum(k) > 0")
