"""Queries of texts and summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import audit as a
from ..operators import predicates as p
from ..operators import summary as m
from ..operators import text as x
from .adapters import DOC_PAGES, LEAF_TEXT, OUTLINE, view
from .registry import register
from .tree_queries import _DIRECT, _PAGE_OF, HEADS, on_tree

_T = ("leaf_text", LEAF_TEXT)
_PULLED = "pulled AS (SELECT a.doc_id, anc AS node_id, string_agg(text, ' ' ORDER BY a.pre) AS text FROM anc a JOIN leaf_text l ON l.doc_id = a.doc_id AND l.node_id = a.node_id JOIN tree e ON e.doc_id = a.doc_id AND e.node_id = a.anc WHERE a.type = 'content' AND text <> '' AND e.type = 'element' GROUP BY ALL)"
on_tree("leaf_text", lambda t, w: x.resolved_leaf_text(w(LEAF_TEXT)), "SELECT doc_id, node_id, coalesce(nullif(text, ''), CASE WHEN has_image THEN '[Image]' END, CASE WHEN has_vector THEN '[Graphic]' END) AS text FROM leaf_text", _T)
on_tree("pull_text", lambda t, w: x.content_text(t, w(LEAF_TEXT)), f", {_PULLED} SELECT * FROM pulled", _T)
on_tree("direct_text", lambda t, w: x.direct_text(t, w(LEAF_TEXT)), f", {_DIRECT} SELECT * FROM direct", _T)
on_tree("text_offsets", lambda t, w: x.text_offsets(t, w(LEAF_TEXT)), "SELECT t.doc_id, t.node_id, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY t.doc_id, parent_id ORDER BY pre ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM tree t JOIN leaf_text l USING (doc_id, node_id) WHERE type = 'content' AND text <> ''", _T)
_HALVES = f"SELECT doc_id, node_id, 1 AS run_no, 0 AS start, CAST(length(text) - 3 AS INT) AS stop FROM ({LEAF_TEXT}) z WHERE text <> '' UNION ALL SELECT doc_id, node_id, 2, length(text) - 3, length(text) FROM ({LEAF_TEXT}) z WHERE text <> ''"
on_tree("node_runs", lambda t, w: x.runs_of_nodes(t, w(LEAF_TEXT), w(_HALVES).withColumnRenamed("stop", "end")),
        ", o AS (SELECT t.doc_id, t.node_id, t.parent_id, t.pre, t.page, coalesce(sum(length(text) + 1) OVER (PARTITION BY t.doc_id, parent_id ORDER BY pre ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM tree t JOIN leaf_text l USING (doc_id, node_id) WHERE type = 'content' AND text <> '') SELECT o.doc_id, parent_id AS node_id, page, CAST(row_number() OVER (PARTITION BY o.doc_id, parent_id ORDER BY pre, run_no) AS INT) AS run_no, CAST(base + start AS BIGINT) AS start, CAST(base + stop AS BIGINT) AS \"end\" FROM o JOIN runs USING (doc_id, node_id)", _T, ("runs", _HALVES))
on_tree("subtree_runs", lambda t, w: x.runs_of_subtrees(t, w(LEAF_TEXT), w(_HALVES).withColumnRenamed("stop", "end"), t.filter("depth IN (1, 2) AND node_id % 3 <> 0").select("doc_id", "node_id", F.explode(F.array(F.lit(0), F.lit(2), F.lit(5))).alias("page"))),
        ", o AS (SELECT w.doc_id, w.node_id AS anc, t.node_id, t.pre, t.page, coalesce(sum(length(text) + 1) OVER (PARTITION BY w.doc_id, w.node_id ORDER BY t.pre ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM tree w JOIN tree t ON t.doc_id = w.doc_id AND t.pre BETWEEN w.pre AND w.last_pre JOIN leaf_text l ON l.doc_id = t.doc_id AND l.node_id = t.node_id WHERE w.depth IN (1, 2) AND w.node_id % 3 <> 0 AND t.type = 'content' AND text <> '') SELECT o.doc_id, anc AS node_id, page, CAST(row_number() OVER (PARTITION BY o.doc_id, anc, page ORDER BY pre, run_no) AS INT) AS run_no, CAST(base + start AS BIGINT) AS start, CAST(base + stop AS BIGINT) AS \"end\" FROM o JOIN runs USING (doc_id, node_id) WHERE page IN (0, 2, 5)", _T, ("runs", _HALVES))
on_tree("list_parts", lambda t, w: x.list_parts(t, w(LEAF_TEXT)),
        """, c AS (SELECT i.doc_id, i.node_id AS item, a.node_id, a.pre, l.text, EXISTS (SELECT 1 FROM tree b WHERE b.doc_id = i.doc_id AND b.role = 'Lbl' AND b.parent_id = i.node_id AND a.pre BETWEEN b.pre AND b.last_pre) AS lbl FROM tree i JOIN tree a ON a.doc_id = i.doc_id AND a.pre > i.pre AND a.pre <= i.last_pre JOIN leaf_text l ON l.doc_id = a.doc_id AND l.node_id = a.node_id WHERE i.role = 'LI' AND a.type = 'content' AND text <> '')
 SELECT doc_id, item, row_number() OVER (PARTITION BY doc_id, item ORDER BY lbl DESC) AS part_no, CASE WHEN lbl THEN 'label' ELSE 'text' END AS kind, string_agg(text, ' ' ORDER BY pre) AS value FROM c GROUP BY doc_id, item, lbl""", _T)
on_tree("cell_text", lambda t, w: x.cell_text(t, w(LEAF_TEXT)), "SELECT e.doc_id, e.node_id, string_agg(text, ' ' ORDER BY c.pre) AS text FROM tree e JOIN tree c ON c.doc_id = e.doc_id AND c.pre > e.pre AND c.pre <= e.last_pre JOIN leaf_text l ON l.doc_id = c.doc_id AND l.node_id = c.node_id WHERE e.role IN ('TH', 'TD') AND c.type = 'content' AND text <> '' GROUP BY ALL", _T)
_TITLES = f"titles AS (SELECT t.doc_id, t.node_id, CAST(substr(role, 2) AS INT) AS level, coalesce(nullif(trim(coalesce(actual_text, '')), ''), nullif(trim(coalesce(p.text, '')), ''), 'Untitled ' || role) AS title FROM tree t LEFT JOIN pulled p USING (doc_id, node_id) WHERE role IN {HEADS})"
on_tree("heading_titles", lambda t, w: x.heading_titles(t, w(LEAF_TEXT)), f", {_PULLED}, {_TITLES} SELECT * FROM titles", _T)
on_tree("tree_summary", lambda t, _: m.tree_summary(t, a.empty_nodes(t)), f"SELECT doc_id, count(*) FILTER (type = 'element') AS n_tags, count(*) FILTER (type = 'content') AS n_leaves, max(depth) FILTER (type = 'element') AS max_depth, count(*) FILTER (role IN ('Figure', 'Formula') AND coalesce(alt, '') = '') AS n_figures_without_alt, count(*) FILTER (role IN {HEADS}) AS n_headings, (SELECT count(*) FROM empty e WHERE e.doc_id = t.doc_id) AS n_empty FROM tree t GROUP BY doc_id")
on_tree("tags_per_role", lambda t, _: m.tags_per_role(t), "SELECT doc_id, role, count(*) AS n FROM nodes WHERE type = 'element' GROUP BY ALL")
on_tree("tags_per_page", lambda t, _: m.tags_per_page(t), f", {_PAGE_OF} SELECT doc_id, page_no, count(*) AS n FROM page_of JOIN nodes USING (doc_id, node_id) WHERE type = 'element' AND page_no IS NOT NULL GROUP BY ALL")
on_tree("heading_list", lambda t, _: m.heading_list(t), f"SELECT doc_id, node_id, level, truncated FROM (SELECT *, CAST(substr(role, 2) AS INT) AS level, row_number() OVER (PARTITION BY doc_id ORDER BY pre) AS n, count(*) OVER (PARTITION BY doc_id) > 200 AS truncated FROM tree WHERE role IN {HEADS}) WHERE n <= 200")
on_tree("organizational_below", lambda t, _: m.organizational_below(t), "SELECT e.doc_id, e.node_id, count(*) AS n FROM tree e JOIN tree c ON c.doc_id = e.doc_id AND c.pre > e.pre AND c.pre <= e.last_pre WHERE e.type = 'element' AND (lower(c.role) IN ('div', 'sect', 'part', 'sub') OR lower(c.role) LIKE '%span%') GROUP BY ALL")
on_tree("link_totals", lambda t, _: m.link_totals(t), "SELECT doc_id, count(*) FILTER (role = 'Link') AS n_links, count(*) FILTER (type = 'object-ref' AND target_id IS NOT NULL) AS n_objects FROM nodes GROUP BY doc_id")
on_tree("severity_below", lambda t, _: m.severity_below(t, t.filter("type = 'element' AND node_id % 5 = 1").select("doc_id", "node_id", F.when(F.col("ord") % 2 == 0, 1).otherwise(2).alias("severity"))), "SELECT e.doc_id, e.node_id, max(CASE WHEN c.ord % 2 = 0 THEN 1 ELSE 2 END) AS severity FROM tree e JOIN tree c ON c.doc_id = e.doc_id AND c.pre > e.pre AND c.pre <= e.last_pre WHERE c.type = 'element' AND c.node_id % 5 = 1 GROUP BY ALL")
on_tree("badges", lambda t, _: m.badges(t, t.filter("type = 'element' AND node_id % 7 = 1").select("doc_id", "node_id", F.lit(2).alias("severity")), t.filter("type = 'element' AND node_id % 5 = 1").select("doc_id", "node_id", F.lit(1).alias("severity"))),
        """, ai AS (SELECT * FROM tree WHERE type = 'element' AND node_id % 7 = 1), att AS (SELECT * FROM tree WHERE type = 'element' AND node_id % 5 = 1), b AS (SELECT e.doc_id, e.node_id, CASE WHEN e.type = 'element' AND e.node_id % 7 = 1 THEN 'AI**' WHEN EXISTS (SELECT 1 FROM ai c WHERE c.doc_id = e.doc_id AND c.pre > e.pre AND c.pre <= e.last_pre) THEN 'AI**↓'
 WHEN e.type = 'element' AND e.node_id % 5 = 1 THEN 'AT*' WHEN EXISTS (SELECT 1 FROM att c WHERE c.doc_id = e.doc_id AND c.pre > e.pre AND c.pre <= e.last_pre) THEN 'AT*↓' END AS badge FROM tree e) SELECT * FROM b WHERE badge IS NOT NULL""")
on_tree("bookmark_parents", lambda t, _: m.bookmark_parents(t), f", {_PAGE_OF}, h AS (SELECT *, CAST(substr(role, 2) AS INT) AS level FROM tree JOIN page_of USING (doc_id, node_id) WHERE role IN {HEADS} AND page_no IS NOT NULL) SELECT h.doc_id, h.node_id, max_by(p.node_id, p.pre) AS parent FROM h LEFT JOIN h p ON p.doc_id = h.doc_id AND p.pre < h.pre AND p.level < h.level GROUP BY ALL")
on_tree("bookmark_listing", lambda t, w: m.bookmark_listing(w(OUTLINE)), "SELECT doc_id, bookmark_id, 0 AS level, total, total > 300 AS truncated FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM outline_) WHERE n <= 300", ("outline_", OUTLINE))
on_tree("outline_slot", lambda t, w: m.outline_slot(w(OUTLINE), w(DOC_PAGES)), "SELECT p.doc_id, p.page, (SELECT max_by(o.bookmark_id, o.ord) FROM outline_ o WHERE o.doc_id = p.doc_id AND o.ord < coalesce((SELECT min(z.ord) FROM outline_ z WHERE z.doc_id = p.doc_id AND z.page > p.page), 9223372036854775807)) AS after FROM pages_ p", ("outline_", OUTLINE), ("pages_", DOC_PAGES))

# lines and pairs of documents
_LINES = "SELECT doc_id, i - 1 AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)"


def _doc_lines(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


#: Words that the newer version of a document has replaced.
_OLD = ("the", "der", "de", "la")


def _pairs(s, d):
    """Each document with its next version: of three documents one has other words, one other white space, one is the same."""
    docs = s.read.parquet(f"{d}/documents.parquet").filter("text IS NOT NULL").select("doc_id", F.col("text").alias("a"))
    other = F.array_join(F.transform(x.word_tokens(F.col("a")), lambda t: F.when(t.isin(*_OLD), F.concat(F.lit("~"), t)).otherwise(t)), "")
    return docs.withColumn("b", F.when(F.col("doc_id") % 3 == 0, other).when(F.col("doc_id") % 3 == 1, F.regexp_replace("a", " ", "  ")).otherwise(F.col("a")))


_WS = "[ \\t\\n\\x0B\\f\\r\\x{00A0}]"


def _collapsed(c):
    return f"trim(regexp_replace({c}, '{_WS}+', ' ', 'g'))"



register("list_labels", lambda s, d: _doc_lines(s, d).select("doc_id", "line_no", x.is_list_label(F.split_part("line", F.lit(" "), F.lit(1))).alias("label"), x.leading_label_length(F.col("line")).alias("n")),
         f"SELECT doc_id, line_no, regexp_matches(trim(split_part(line, ' ', 1)), '{x.MARKER}') AS label, CAST(length(regexp_extract(line, '{x.LEADING}', 1)) AS INT) AS n FROM ({_LINES})")
register("clipped_lines", lambda s, d: _doc_lines(s, d).select("doc_id", "line_no", p.clip(F.col("line"), 20).alias("clip")), "WITH c AS (SELECT doc_id, line_no, trim(regexp_replace(coalesce(line, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS flat FROM (" + _LINES + ")) SELECT doc_id, line_no, CASE WHEN length(flat) > 20 THEN substr(flat, 1, 19) || '…' ELSE flat END AS clip FROM c")
_TOKENS = f"tokens AS (SELECT doc_id, text, regexp_extract_all(text, '{_WS}+|[^ \\t\\n\\x0B\\f\\r\\x{{00A0}}]+') AS ts FROM documents WHERE text IS NOT NULL)"
_HITS = f"{_TOKENS}, hits AS (SELECT doc_id, text AS a, ts, CASE WHEN doc_id % 3 = 0 THEN len(list_filter(ts, lambda t: t IN {_OLD})) ELSE 0 END AS k, CASE WHEN doc_id % 3 = 1 THEN len(list_filter(ts, lambda t: contains(t, ' '))) ELSE 0 END AS wide, CASE WHEN doc_id % 3 = 1 THEN len(text) - len(replace(text, ' ', '')) ELSE 0 END AS blanks FROM tokens), sized AS (SELECT *, power((len(a) * 2 + k + blanks) / 4.0, 2) <= 4000000 AS affordable FROM hits)"
register("white_space_change", lambda s, d: _pairs(s, d).select("doc_id", x.white_space_only(F.col("a"), F.col("b")).alias("same"), x.severity(F.col("a"), F.col("b")).alias("severity"), x.affordable(F.col("a"), F.col("b")).alias("affordable")),
         f"WITH {_HITS} SELECT doc_id, k = 0 AS same, CASE WHEN k = 0 THEN 1 ELSE 2 END AS severity, affordable FROM sized")
register("word_tokens", lambda s, d: _doc_lines(s, d).select("doc_id", "line_no", F.size(x.word_tokens(F.col("line"))).alias("n"), F.array_join(x.word_tokens(F.col("line")), "|").alias("tokens")), f"SELECT doc_id, line_no, CAST(len(t) AS INT) AS n, array_to_string(t, '|') AS tokens FROM (SELECT doc_id, line_no, regexp_extract_all(line, '{_WS}+|[^ \\t\\n\\x0B\\f\\r\\x{{00A0}}]+') AS t FROM ({_LINES}))")
_N = lambda kind: F.size(F.filter("ops", lambda o: o["type"] == kind))
_STATUS = "CASE WHEN k + wide = 0 THEN 'equal' WHEN affordable THEN 'aligned' ELSE 'long' END"
register("word_diff", lambda s, d: x.word_diff(_pairs(s, d)).select("doc_id", "status", *[F.when(F.col("ops").isNotNull(), _N(kind)).alias(f"n_{kind}") for kind in ("removed", "added", "common")]),
         f"WITH {_HITS}, w AS (SELECT *, {_STATUS} AS status FROM sized) SELECT doc_id, status, CASE WHEN status <> 'long' THEN CAST(k + wide AS INT) END AS n_removed, CASE WHEN status <> 'long' THEN CAST(k + wide AS INT) END AS n_added, CASE WHEN status <> 'long' THEN CAST(len(ts) - k - wide AS INT) END AS n_common FROM w")
register("new_side", lambda s, d: x.word_diff(_pairs(s, d).filter("doc_id % 3 = 0")).filter("status <> 'long'").select("doc_id", x.new_side(F.col("ops")).alias("side")).select("doc_id", F.size("side").alias("n"), F.array_join(F.transform(F.filter("side", lambda o: o["added"]), lambda o: o["text"]), ",").alias("added")),
         f"WITH {_HITS}, w AS (SELECT *, {_STATUS} AS status FROM sized) SELECT doc_id, CAST(len(ts) AS INT) AS n, coalesce(array_to_string(list_transform(list_filter(ts, lambda t: t IN {_OLD}), lambda t: '~' || t), ','), '') AS added FROM w WHERE doc_id % 3 = 0 AND status <> 'long'")
register("diff_regions", lambda s, d: x.diff_regions(x.word_diff(_pairs(s, d).filter("doc_id % 3 = 0"), every=True), "doc_id"),
         f"WITH {_HITS}, each AS (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM sized WHERE doc_id % 3 = 0 AND k > 0), spot AS (SELECT doc_id, t, coalesce(sum(len(t)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM each) SELECT doc_id, CAST(p AS BIGINT) AS start, CAST(p + len(t) AS BIGINT) AS \"end\", false AS inserted FROM spot WHERE t IN {_OLD}")
register("find_cut", lambda s, d: x.find_cut(_doc_lines(s, d).withColumn("needle", F.split_part("line", F.lit(" "), F.lit(2))), "line", "needle").select("doc_id", "line_no", "refusal", "cut"),
         f"""WITH l AS (SELECT doc_id, line_no, regexp_replace(line, '{_WS}', '', 'g') AS flat, regexp_replace(split_part(line, ' ', 2), '{_WS}', '', 'g') AS want FROM ({_LINES})), p AS (SELECT *, CAST(strpos(flat, want) AS INT) AS first FROM l),
 r AS (SELECT *, CASE WHEN want = '' OR first = 0 THEN 'missing' WHEN strpos(substr(flat, first + 1), want) > 0 THEN 'ambiguous' WHEN first = 1 THEN 'at the start' END AS refusal FROM p) SELECT doc_id, line_no, refusal, CASE WHEN refusal IS NULL THEN first - 1 END AS cut FROM r""")
register("split_pieces", lambda s, d: x.split_pieces(_doc_lines(s, d).filter("length(line) > 7").withColumn("key", F.concat_ws(":", "doc_id", "line_no")).withColumn("cuts", F.array(F.lit(3), F.lit(7))), "key", "line", "cuts"),
         f"SELECT doc_id || ':' || line_no AS key, p.n AS piece_no, CASE p.n WHEN 1 THEN substr(line, 1, 3) WHEN 2 THEN substr(line, 4, 4) ELSE substr(line, 8) END AS piece FROM ({_LINES}), (VALUES (1), (2), (3)) p(n) WHERE length(line) > 7")
_TURNS = "SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM {conversations}"
register("reply_json", lambda s, d: view(s, d, _TURNS).select("conv_id", "turn", x.lenient_json(F.concat(F.lit('note {"n": '), F.col("turn").cast("string"), F.lit(', "s": "}"} tail'))).alias("json")), """SELECT conv_id, CAST(turn AS BIGINT) AS turn, '{"n": ' || CAST(turn AS VARCHAR) || ', "s": "}"}' AS json FROM conversations""")
register("reply_reconciliation", lambda s, d: x.reconcile(view(s, d, _TURNS).filter("role = 'user'").select("conv_id", F.col("turn").alias("id")), view(s, d, _TURNS).filter("role <> 'user'").select("conv_id", (F.col("turn") - 1).alias("id")), "conv_id"),
         "WITH q AS (SELECT DISTINCT conv_id, turn AS id FROM conversations WHERE role = 'user'), r AS (SELECT conv_id, turn - 1 AS id, count(*) AS n FROM conversations WHERE role <> 'user' GROUP BY ALL), b AS (SELECT conv_id, q.id IS NOT NULL AS asked, n FROM q FULL JOIN r USING (conv_id, id)), s AS (SELECT conv_id, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (asked AND n > 1) AS repeated, count(*) FILTER (NOT asked) AS unknown FROM b GROUP BY conv_id) SELECT *, missing + repeated + unknown = 0 AS accepted FROM s")
_SENT = "SELECT CAST(doc_id % 40 AS BIGINT) AS batch, doc_id AS id, lang || ' ' || source AS text FROM {documents}"
register("payload_guard", lambda s, d: x.payload_guard(view(s, d, _SENT), "batch"),
         f"""WITH j AS (SELECT batch, CAST(length('[' || string_agg('{{"id":' || id || ',"text":"' || text || '"}}', ',' ORDER BY id) || ']') AS INT) AS size FROM ({_SENT.format(documents='documents')}) GROUP BY batch) SELECT batch, size, size > 150000 AS refused FROM j""")
_ITEMS = "SELECT conv_id, CAST(turn AS BIGINT) AS item_no, coalesce(text, '') AS text, role = 'user' AS ends_line FROM {conversations}"
_WHOLE = f"WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, CASE WHEN role = 'user' THEN chr(10) ELSE '' END AS brk FROM conversations), w AS (SELECT conv_id, string_agg(text || brk, '' ORDER BY turn) AS whole FROM t GROUP BY conv_id), c AS (SELECT conv_id, CAST(length(whole) - length(regexp_replace(whole, '^{_WS}+', '')) AS BIGINT) AS lead, regexp_replace(regexp_replace(whole, '^{_WS}+', ''), '{_WS}+$', '') AS text FROM w)"
register("leaf_texts", lambda s, d: x.leaf_texts(view(s, d, _ITEMS), "conv_id"), f"{_WHOLE} SELECT conv_id, text FROM c")
register("item_starts", lambda s, d: x.item_starts(view(s, d, _ITEMS), "conv_id"), f"{_WHOLE}, o AS (SELECT conv_id, turn, length(text) AS n, coalesce(sum(length(text || brk)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM t), p AS (SELECT conv_id, CAST(turn AS BIGINT) AS item_no, CAST(greatest(0, pos - lead) AS BIGINT) AS start, CAST(least(length(c.text), pos + n - lead) AS BIGINT) AS \"end\" FROM o JOIN c USING (conv_id)) SELECT * FROM p WHERE start < \"end\"")
_LOG = "SELECT event_id AS run_id, event_type AS provider, ts, user_id + 1 AS chars, value AS ms FROM {events}"
register("batch_time_range", lambda s, d: m.batch_time(view(s, d, _LOG)), "WITH l AS (SELECT event_type AS provider, value / (user_id + 1) AS r FROM events ORDER BY ts DESC, event_id DESC LIMIT 50) SELECT provider, round(CASE WHEN count(*) < 4 THEN quantile_cont(r, 0.5) * 0.7 ELSE quantile_cont(r, 0.25) END, 6) AS low, round(CASE WHEN count(*) < 4 THEN quantile_cont(r, 0.5) * 1.3 ELSE quantile_cont(r, 0.75) END, 6) AS high FROM l GROUP BY provider")
_VERSIONS = "SELECT p_partkey AS id, CAST(p_size AS STRING) || CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '.0' WHEN 2 THEN '.0.' || CAST(p_partkey % 12 AS STRING) WHEN 3 THEN '.' || CAST(p_partkey AS STRING) || '00000000000.7' ELSE '.1.2.3.4.' || CAST(p_partkey % 12 AS STRING) END || CASE WHEN p_partkey % 3 = 0 THEN '-rc.' || CAST(p_partkey % 4 AS STRING) ELSE '' END AS version FROM {part}"
register("version_order", lambda s, d: view(s, d, _VERSIONS).select("id", F.dense_rank().over(Window.partitionBy((F.col("id") % 7).alias("g")).orderBy(x.version_key(F.col("version")))).alias("place")),
         f"""WITH v AS (SELECT id, string_split(split_part(version, '-', 1), '.') AS ps, CASE WHEN contains(version, '-') THEN substr(version, strpos(version, '-') + 1) END AS pre FROM ({_VERSIONS.format(part='part')})),
 n AS (SELECT id, [CAST(coalesce(ps[i], '0') AS HUGEINT) FOR i IN [1, 2, 3, 4, 5, 6]] AS ns, pre FROM v) SELECT id, CAST(dense_rank() OVER (PARTITION BY id % 7 ORDER BY ns, pre IS NULL, pre) AS INT) AS place FROM n""")
register("inline_spans", lambda s, d: view(s, d, "SELECT doc_id, '**' || source || '** and *' || lang || '* or `x*y` ' || CAST(doc_id AS STRING) AS entry FROM {documents}").select("doc_id", F.posexplode(x.inline_spans(F.col("entry"))).alias("no", "s")).select("doc_id", "no", "s.kind", "s.text"),
         "SELECT doc_id, CAST(e.n AS INT) AS no, e.kind AS kind, CASE e.n WHEN 0 THEN source WHEN 1 THEN lang ELSE 'x*y' END AS text FROM documents, (VALUES (0, 'bold'), (1, 'italic'), (2, 'code')) e(n, kind)")
_NOTES = "SELECT doc_id, '## [' || CAST(doc_id AS STRING) || '.0] - 2024' || chr(10) || '### Added' || chr(10) || '- ' || source || chr(10) || '  wrapped' || chr(10) || '- ' || lang || chr(10) || chr(10) || '[x]: y' AS text FROM {documents}"
register("release_notes", lambda s, d: x.sections(view(s, d, _NOTES)), "SELECT doc_id, doc_id || '.0' AS version, e.n AS entry_no, 'Added' AS \"group\", CASE e.n WHEN 1 THEN source || ' wrapped' ELSE lang END AS entry FROM documents, (VALUES (CAST(1 AS BIGINT)), (2)) e(n)")
