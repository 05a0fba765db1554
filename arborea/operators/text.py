"""Text of nodes, list markers, word differences, replies and release notes."""

from __future__ import annotations

import re
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import tree as t
from .predicates import blank, numbered_heading

#: White space of the diff and of collapsing, as one class on every engine.
WHITE = r"[ \t\n\x0B\f\r ]"
_TOKENS = WHITE + r"+|[^ \t\n\x0B\f\r\u00A0]+"
# fixed values: a marker, and a marker at the start of a text
MARKER = r"^(?:[•‣◦▪●○*]|[A-Za-z]\.|[0-9]+\.)$"
LEADING = r"^([ \t]*(?:[•‣◦▪●○*]|[A-Za-z]\.|[0-9]+\.))[ \t]+[^ \t]"
#: Largest table of an alignment, in cells of words of four characters; longest batch, in characters of JSON.
MOST_CELLS, MOST_PAYLOAD = 4_000_000, 150_000


def resolved_leaf_text(leaf_text: DataFrame) -> DataFrame:
    """Own text, else '[Image]', else '[Graphic]', else null."""
    shown = F.coalesce(F.nullif("text", F.lit("")), F.when(F.col("has_image"), "[Image]"), F.when(F.col("has_vector"), "[Graphic]"))
    return leaf_text.select("doc_id", "node_id", shown.alias("text"))


def _ordered(pre: str, text: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pre, text))), lambda s: s[text]), " ")


def content_text(tree: DataFrame, leaf_text: DataFrame) -> DataFrame:
    """doc_id, node_id, text: non-empty texts of all leaves below each element, in document order, joined by one space."""
    leaf = tree.filter("type = 'content'").join(leaf_text.filter("text <> ''").select("doc_id", "node_id", "text"), ["doc_id", "node_id"])
    up = t.below(leaf, F.lit(True)).filter("step.type = 'element'")
    return up.groupBy("doc_id", F.col("anc").alias("node_id")).agg(_ordered("pre", "text").alias("text"))


def direct_text(tree: DataFrame, leaf_text: DataFrame) -> DataFrame:
    """The same over content children only."""
    leaf = tree.filter("type = 'content'").join(leaf_text.filter("text <> ''").select("doc_id", "node_id", "text"), ["doc_id", "node_id"])
    return leaf.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(_ordered("pre", "text").alias("text"))


def text_offsets(tree: DataFrame, leaf_text: DataFrame) -> DataFrame:
    """doc_id, node_id (leaf), start: where each leaf's text begins in its parent's direct text."""
    leaf = tree.filter("type = 'content'").join(leaf_text.filter("text <> ''").select("doc_id", "node_id", "text"), ["doc_id", "node_id"])
    w = Window.partitionBy("doc_id", "parent_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    return leaf.select("doc_id", "node_id", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("long").alias("start"))


def runs_of_nodes(tree: DataFrame, leaf_text: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, node_id (parent), page, run_no, start, end: runs of the leaves (doc_id, node_id, run_no, start, end) by their place in the
    parent's direct text; leaves are numbered on in document order."""
    at = text_offsets(tree, leaf_text).withColumnRenamed("start", "base")
    leaf = t.with_page(tree).filter("type = 'content'").select("doc_id", "node_id", "parent_id", "pre", "page").join(at, ["doc_id", "node_id"]).join(runs, ["doc_id", "node_id"])
    n = F.row_number().over(Window.partitionBy("doc_id", "parent_id").orderBy("pre", "run_no"))
    return leaf.select("doc_id", F.col("parent_id").alias("node_id"), "page", n.alias("run_no"), (F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.col("end")).alias("end"))


def runs_of_subtrees(tree: DataFrame, leaf_text: DataFrame, runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, node_id, page, run_no, start, end: runs of the leaves (doc_id, node_id, run_no, start, end) by their place in the text of all content below a
    node, for each node and page wanted (doc_id, node_id, page). Leaves of other pages, and the blanks between leaves, move what follows and have no runs."""
    w = wanted.select("doc_id", F.col("node_id").alias("anc"), F.col("page").alias("on_page")).distinct()
    leaf = t.with_page(tree).filter("type = 'content'").join(leaf_text.filter("text <> ''").select("doc_id", "node_id", "text"), ["doc_id", "node_id"])
    under = leaf.select("doc_id", "node_id", "pre", "page", F.length("text").alias("size"), F.explode("path.node_id").alias("anc")).join(w, ["doc_id", "anc"])
    before = Window.partitionBy("doc_id", "anc", "on_page").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    placed = under.withColumn("base", F.coalesce(F.sum(F.col("size") + 1).over(before), F.lit(0))).filter("page = on_page")
    n = F.row_number().over(Window.partitionBy("doc_id", "anc", "page").orderBy("pre", "run_no"))
    return placed.join(runs, ["doc_id", "node_id"]).select("doc_id", F.col("anc").alias("node_id"), "page", n.alias("run_no"), (F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.col("end")).alias("end"))


def leaf_texts(items: DataFrame, *keys: str) -> DataFrame:
    """keys, text: items (keys, item_no, text, ends_line) one after another, a line break after one that ends a line, trimmed."""
    part = F.concat("text", F.when(F.col("ends_line"), "\n").otherwise(""))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_no", part.alias("part")))), lambda s: s["part"]), "")
    return items.groupBy(*keys).agg(collapsed_ends(whole).alias("text"))


def item_starts(items: DataFrame, *keys: str) -> DataFrame:
    """keys, item_no, start, end of each item in the trimmed text of ``leaf_texts``; items that the trimming takes are left out."""
    size = F.length(F.concat("text", F.when(F.col("ends_line"), "\n").otherwise("")))
    w = Window.partitionBy(*keys).orderBy("item_no")
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    texts = items.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_no", F.concat("text", F.when(F.col("ends_line"), "\n").otherwise("")).alias("part")))), lambda s: s["part"]), "").alias("whole"))
    cut = texts.select(*keys, F.length(F.regexp_extract("whole", f"^({WHITE}*)", 1)).alias("lead"), F.length(collapsed_ends(F.col("whole"))).alias("total"))
    at = items.withColumn("from", before).withColumn("to", F.col("from") + F.length("text")).join(cut, list(keys))
    a, b = F.greatest(F.lit(0), F.col("from") - F.col("lead")), F.least(F.col("total"), F.col("to") - F.col("lead"))
    return at.filter(a < b).select(*keys, "item_no", a.cast("long").alias("start"), b.cast("long").alias("end"))


def list_parts(tree: DataFrame, leaf_text: DataFrame) -> DataFrame:
    """doc_id, item, part_no, kind, value: what each LI shows, in order: its label (the text of its first Lbl child), texts, and the lists
    nested in it as separate parts (their node id as value). Leaves between nested lists are one text."""
    leaf = tree.filter("type = 'content'").join(leaf_text.filter("text <> ''").select("doc_id", "node_id", "text"), ["doc_id", "node_id"]).select("doc_id", "node_id", "pre", "path", "text")
    lists = tree.filter("role = 'L'").select("doc_id", "node_id", "pre", "path", F.lit(None).cast("string").alias("text"))
    is_item = lambda s: s["role"] == "LI"
    e = leaf.withColumn("nested", F.lit(False)).unionByName(lists.withColumn("nested", F.lit(True)))
    item = F.try_element_at(F.filter(t.ancestors(), is_item), F.lit(-1))["node_id"]
    # below the item: a leaf under a nested list belongs to that list's own items
    inner = F.filter(t.ancestors(), lambda s: F.array_position(F.col("path.node_id"), s["node_id"]) > F.array_position(F.col("path.node_id"), F.col("item")))
    e = e.withColumn("item", item).filter("item IS NOT NULL").filter(~F.exists(inner, lambda s: s["role"].eqNullSafe("L")))
    first = tree.filter("role = 'Lbl'").groupBy("doc_id", F.col("parent_id").alias("item")).agg(F.min_by("node_id", "pre").alias("lbl"))
    e = e.join(first, ["doc_id", "item"], "left").withColumn("kind", F.when(F.col("nested"), "list").when(F.array_contains("path.node_id", F.col("lbl")), "label").otherwise("text"))
    w = Window.partitionBy("doc_id", "item").orderBy(F.col("kind") != "label", "pre")
    e = e.withColumn("isle", F.sum((F.col("nested") | ~F.lag("kind").over(w).eqNullSafe(F.col("kind"))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    p = e.groupBy("doc_id", "item", "isle", "kind").agg(_ordered("pre", "text").alias("shown"), F.min("node_id").alias("id"))
    return p.select("doc_id", "item", F.col("isle").cast("long").alias("part_no"), "kind", F.when(F.col("kind") == "list", F.col("id").cast("string")).otherwise(F.col("shown")).alias("value"))


def cell_text(tree: DataFrame, leaf_text: DataFrame, roles: tuple[str, ...] = ("TH", "TD")) -> DataFrame:
    """doc_id, node_id, text of each cell, top down: an element's trimmed actual text stands for its subtree, a Figure is
    '[Figure]', else what is below."""
    shown = F.when(~blank(F.col("actual_text")), F.trim("actual_text")).when(F.col("role") == "Figure", "[Figure]")
    e = tree.join(leaf_text.select("doc_id", "node_id", F.col("text").alias("own")), ["doc_id", "node_id"], "left").withColumn("shown", F.when(F.col("type") == "element", shown).when(F.col("type") == "content", F.nullif("own", F.lit("")))).filter("shown IS NOT NULL")
    # an ancestor that shows something stands for everything below it
    stands = lambda s: (s["type"] == "element") & (s["has_actual"] | s["role"].eqNullSafe("Figure"))
    cell = lambda s: s["role"].isin(*roles)
    e = e.withColumn("in_cell", t.nearest(cell, True)["node_id"]).filter("in_cell IS NOT NULL")
    inside = F.filter(t.ancestors(), lambda s: F.array_position(F.col("path.node_id"), s["node_id"]) >= F.array_position(F.col("path.node_id"), F.col("in_cell")))
    e = e.filter(~F.exists(inside, stands))
    return e.groupBy("doc_id", F.col("in_cell").alias("node_id")).agg(_ordered("pre", "shown").alias("text"))


def is_list_label(text: Column) -> Column:
    return F.trim(text).rlike(MARKER)


def leading_label_length(text: Column) -> Column:
    """Characters of leading blanks and marker where blanks and something else follow; else 0."""
    return F.length(F.regexp_extract(text, LEADING, 1))


def collapsed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE + "+", " "), "^ | $", "")


def white_space_only(a: Column, b: Column) -> Column:
    return collapsed(a) == collapsed(b)


def severity(a: Column, b: Column) -> Column:
    """1: only white space differs; 2: words do."""
    return F.when(white_space_only(a, b), 1).otherwise(2)


def affordable(a: Column, b: Column) -> Column:
    n = (F.length(a) + F.length(b)) / 4.0
    return n * n <= MOST_CELLS


def word_tokens(text: Column) -> Column:
    """Words and the white space between them, both kept."""
    return F.regexp_extract_all(text, F.lit(f"({_TOKENS})"), F.lit(1))


#: Kinds of operations of an alignment.
COMMON, REMOVED, ADDED = 0, 1, 2


def align(a: list[str], b: list[str]) -> list[int]:
    """The operations that turn tokens a into b, by the longest common subsequence; on ties the removal comes first. Each is three times a position, in a for
    COMMON and REMOVED, in b for ADDED, plus its kind.

    Equal ends are set aside, so near copies cost what differs. Rows of the table are whole numbers with a bit a token, a zero where the subsequence grows;
    about twice the root of their number are held at once."""
    n, m, lead, tail = len(a), len(b), 0, 0
    while lead < min(n, m) and a[lead] == b[lead]:
        lead += 1
    while tail < min(n, m) - lead and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    out = [3 * i + COMMON for i in range(lead)]
    i, j, n_in, m_in = lead, lead, n - tail, m - tail
    if i < n_in and j < m_in:
        places: dict[str, int] = {}
        for k in range(m_in - 1, j - 1, -1):
            places[b[k]] = places.get(b[k], 0) | 1 << (m_in - 1 - k)
        whole, step = (1 << (m_in - j)) - 1, max(1, isqrt(n_in - i))

        def after(v: int, k: int) -> int:
            """The row of the last k + 1 tokens of a, from that of the last k."""
            hit = v & places.get(a[n_in - 1 - k], 0)
            return (v + hit | v - hit) & whole

        # every step-th row is kept; those between are made again, a block at a time, as the walk gets to them
        kept, v = [whole], whole
        for k in range(n_in - i):
            v = after(v, k)
            if (k + 1) % step == 0:
                kept.append(v)
        blocks: dict[int, list[int]] = {}

        def row(k: int) -> int:
            at = k // step
            if at not in blocks:
                blocks.pop(at + 2, None)
                made = blocks[at] = [kept[at]]
                for x in range(at * step, min((at + 1) * step - 1, n_in - lead)):
                    made.append(after(made[-1], x))
            return blocks[at][k - at * step]

        common = lambda i, j: m_in - j - (row(n_in - i) & (1 << (m_in - j)) - 1).bit_count()
        while i < n_in and j < m_in:
            if a[i] == b[j]:
                out.append(3 * i + COMMON)
                i, j = i + 1, j + 1
            elif common(i + 1, j) >= common(i, j + 1):
                out.append(3 * i + REMOVED)
                i += 1
            else:
                out.append(3 * j + ADDED)
                j += 1
    # one side is at its equal end; what is left of the other goes before the first token that fits
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            out.append(3 * i + COMMON)
            i, j = i + 1, j + 1
        elif n - i > m - j:
            out.append(3 * i + REMOVED)
            i += 1
        else:
            out.append(3 * j + ADDED)
            j += 1
    return out


def _aligned(a: pd.Series, b: pd.Series) -> pd.Series:
    tokens = re.compile(_TOKENS).findall
    return pd.Series([None if x is None or y is None else np.array(align(tokens(x), tokens(y)), np.int32) for x, y in zip(a, b)])


def word_diff(pairs: DataFrame, every: bool = False) -> DataFrame:
    """Adds status and ops to every pair (a, b): 'equal' with all tokens common, 'aligned', or 'long' without ops, where the pair is beyond
    ``MOST_CELLS`` and is shown without marks; with ``every`` such pairs are aligned as well. Only pairs to be aligned carry their texts to Python, and only positions come back."""
    status = F.when(F.col("a") == F.col("b"), "equal").when(F.col("a").isNotNull() & F.col("b").isNotNull() if every else affordable(F.col("a"), F.col("b")), "aligned").otherwise("long")
    aligned = F.pandas_udf(_aligned, "array<int>")
    p = pairs.withColumn("status", status)
    sent = lambda c: F.when(F.col("status") == "aligned", F.coalesce(c, F.lit("")))
    p = p.withColumn("__ops", aligned(sent("a"), sent("b")))
    at = lambda side, o: F.element_at(side, (o / 3).cast("int") + 1)
    named = lambda s, o: F.struct(F.when(o % 3 == COMMON, "common").when(o % 3 == REMOVED, "removed").otherwise("added").alias("type"), F.when(o % 3 == ADDED, at(s["b"], o)).otherwise(at(s["a"], o)).alias("text"))
    same = F.transform(word_tokens(F.col("a")), lambda x: F.struct(F.lit("common").alias("type"), x.alias("text")))
    # bound by a lambda, or the optimizer may cut the whole text to tokens again for every one of them
    sides = F.array(F.struct(word_tokens(F.col("a")).alias("a"), word_tokens(F.coalesce("b", F.lit(""))).alias("b")))
    found = F.element_at(F.transform(sides, lambda s: F.transform("__ops", lambda o: named(s, o))), 1)
    return p.withColumn("ops", F.when(F.col("status") == "aligned", found).when(F.col("status") == "equal", same)).drop("__ops")


def new_side(ops: Column) -> Column:
    """The new text's tokens (struct text, added) of an alignment."""
    return F.transform(F.filter(ops, lambda o: o["type"] != "removed"), lambda o: F.struct(o["text"].alias("text"), (o["type"] == "added").alias("added")))


def _hunks(marks: pd.Series, texts: pd.Series) -> pd.Series:
    """Per alignment its stretches without a common token: old characters before it, its old and its new text. marks: length of a common
    token, -1 of a removed one, -2 of an added one; texts: of those that aren't common."""
    out = []
    for row, said in zip(marks, texts):
        if row is None:
            out.append(None)
            continue
        hunks, at, open_, said = [], 0, None, iter(said)
        for m in row.tolist():
            if m >= 0:
                at, open_ = at + m, None
                continue
            if open_ is None:
                hunks.append(open_ := {"at": at, "old": "", "new": ""})
            text = next(said)
            if m == -1:
                open_["old"] += text
                at += len(text)
            else:
                open_["new"] += text
        out.append(hunks)
    return pd.Series(out, dtype=object)


def diff_regions(diff: DataFrame, key: str) -> DataFrame:
    """key, start, end, inserted: where the old text changed, trimmed of white space; zero wide where only something was added. An alignment is
    read where it is, in one row."""
    hunks = F.pandas_udf(_hunks, "array<struct<at: int, old: string, new: string>>")
    marks = F.transform("ops", lambda o: F.when(o["type"] == "common", F.length(o["text"])).when(o["type"] == "removed", -1).otherwise(-2))
    changed = F.transform(F.filter("ops", lambda o: o["type"] != "common"), lambda o: o["text"])
    hunk = diff.select(key, F.explode(hunks(marks, changed)).alias("h")).select(key, "h.*")
    lead = F.length(F.regexp_extract("old", f"^({WHITE}*)", 1))
    size = F.length(collapsed_ends(F.col("old")))
    inked = ~blank(collapsed(F.col("old")))
    return hunk.select(key, F.when(inked, F.col("at") + lead).otherwise(F.col("at")).cast("long").alias("start"), F.when(inked, F.col("at") + lead + size).otherwise(F.col("at")).cast("long").alias("end"), (~inked).alias("inserted"), (inked | ~blank(collapsed(F.col("new")))).alias("seen")).filter("seen").drop("seen")


def collapsed_ends(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def heading_titles(tree: DataFrame, leaf_text: DataFrame) -> DataFrame:
    """doc_id, node_id, level, title: trimmed actual text, else the pulled text, else 'Untitled Hn'."""
    h = tree.filter(numbered_heading(F.col("role"))).join(content_text(tree, leaf_text), ["doc_id", "node_id"], "left")
    title = F.coalesce(F.nullif(F.trim(F.coalesce("actual_text", F.lit(""))), F.lit("")), F.nullif(F.trim(F.coalesce("text", F.lit(""))), F.lit("")), F.concat(F.lit("Untitled "), F.col("role")))
    return h.select("doc_id", "node_id", F.expr("TRY_CAST(substring(role, 2) AS INT)").alias("level"), F.regexp_replace(title, r" *\n *", " ").alias("title"))


def find_cut(rows: DataFrame, text: str, needle: str) -> DataFrame:
    """Adds cut (characters before the needle, white space aside) or refusal: missing, ambiguous, at the start."""
    flat, want = F.regexp_replace(F.col(text), WHITE, ""), F.regexp_replace(F.col(needle), WHITE, "")
    first = F.position(want, flat)
    again = F.position(want, flat, first + 1)
    why = F.when((want == "") | (first == 0), "missing").when(again > 0, "ambiguous").when(first == 1, "at the start")
    return rows.withColumn("refusal", why).withColumn("cut", F.when(why.isNull(), first - 1).cast("int"))


def split_pieces(rows: DataFrame, key: str, text: str, cuts: str) -> DataFrame:
    """key, piece_no, piece: the text between the edges 0, the cuts, its length."""
    edges = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), cuts, F.array(F.length(text)))))
    each = rows.select(key, F.col(text).alias("t"), edges.alias("e")).select(key, "t", "e", F.explode(F.sequence(F.lit(1), F.size("e") - 1)).alias("piece_no"))
    return each.select(key, "piece_no", F.substring("t", F.element_at("e", F.col("piece_no")) + 1, F.element_at("e", F.col("piece_no") + 1) - F.element_at("e", F.col("piece_no"))).alias("piece"))


def lenient_json(reply: Column) -> Column:
    """The fenced block, else the whole reply, else the first balanced braces, as valid JSON text; null if none is."""
    fenced = F.nullif(F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    start = F.position(F.lit("{"), reply)
    chars = F.split(F.substring(reply, start, F.length(reply)), "")
    state = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(s, c):
        over = s["end"] > 0
        depth = F.when(s["quoted"], s["depth"]).when(c == "{", s["depth"] + 1).when(c == "}", s["depth"] - 1).otherwise(s["depth"])
        return F.struct(
            depth.alias("depth"), F.when((c == '"') & ~s["escaped"], ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"), (s["quoted"] & (c == "\\") & ~s["escaped"]).alias("escaped"),
            (s["n"] + 1).alias("n"), F.when(over, s["end"]).when((c == "}") & ~s["quoted"] & (depth == 0), s["n"] + 1).otherwise(s["end"]).alias("end"))

    end = F.aggregate(chars, state, step)["end"]
    braces = F.when((start > 0) & (end > 0), F.substring(reply, start, end))
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(valid(fenced), valid(reply), valid(braces))


def reconcile(asked: DataFrame, answered: DataFrame, batch: str) -> DataFrame:
    """batch, missing, repeated, unknown, accepted: whether each asked id was answered once and nothing else was."""
    n = answered.groupBy(batch, "id").agg(F.count("*").alias("n"))
    both = asked.select(batch, "id").distinct().withColumn("asked", F.lit(True)).join(n, [batch, "id"], "full")
    out = both.groupBy(batch).agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("asked") & (F.col("n") > 1)).alias("repeated"), F.count_if(F.col("asked").isNull()).alias("unknown"))
    return out.withColumn("accepted", F.col("missing") + F.col("repeated") + F.col("unknown") == 0)


def version_key(version: Column) -> Column:
    """Sort key (struct) of a dotted version with any number of parts of any length: numbers in order, missing parts as 0, a pre-release
    before its release, pre-releases by their text."""
    core, pre = F.split_part(version, F.lit("-"), F.lit(1)), F.regexp_extract(version, "-(.*)$", 1)
    digits = F.transform(F.split(F.regexp_replace(core, r"(\.0*)+$", ""), r"\."), lambda x: F.regexp_replace(x, "^0+", ""))
    return F.struct(F.transform(digits, lambda x: F.struct(F.length(x).alias("n"), x.alias("digits"))).alias("numbers"), (pre == "").alias("released"), pre.alias("pre"))


def payload_guard(items: DataFrame, key: str, id_: str = "id", text: str = "text", most: int = MOST_PAYLOAD) -> DataFrame:
    """key, size, refused: length of a batch's items as JSON, and whether it is too long to be sent."""
    size = F.length(F.to_json(F.array_sort(F.collect_list(F.struct(F.col(id_).alias("id"), F.col(text).alias("text"))))))
    return items.groupBy(key).agg(size.alias("size")).withColumn("refused", F.col("size") > most)


def inline_spans(entry: Column) -> Column:
    """Bold, italic and code spans (struct kind, text) of an entry, in order; the rest of the text is between them."""
    found = F.regexp_extract_all(entry, F.lit(r"(\*\*[^*]+\*\*|\*[^*]+\*|`[^`]+`)"), F.lit(1))
    kind = lambda x: F.when(x.startswith("**"), "bold").when(x.startswith("*"), "italic").otherwise("code")
    return F.transform(found, lambda x: F.struct(kind(x).alias("kind"), F.regexp_replace(x, r"^(\*\*|\*|`)|(\*\*|\*|`)$", "").alias("text")))


def sections(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, version, group, entry_no, entry: bullets of release notes, wrapped lines rejoined, link definitions dropped."""
    line = texts.select(key, F.posexplode(F.split("text", r"\r?\n")).alias("i", "line"))
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    head = F.nullif(F.regexp_extract("line", r"^## \[([^\]]+)\]", 1), F.lit(""))
    line = line.filter(~F.col("line").rlike(r"^\[[^\]]+\]:")).withColumn("head", head)
    line = line.withColumn("version", F.last("head", ignorenulls=True).over(w)).filter("version IS NOT NULL")
    ws = Window.partitionBy(key, "version").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    group = F.nullif(F.regexp_extract("line", r"^### (.+)$", 1), F.lit(""))
    line = line.withColumn("group", F.last(group, ignorenulls=True).over(ws)).withColumn("opens", F.col("line").rlike("^- ").cast("int")).withColumn("stops", (F.col("line").startswith("#") | (F.trim("line") == "")).cast("int"))
    line = line.withColumn("entry_no", F.sum("opens").over(ws)).withColumn("cut", F.sum(F.col("opens") + F.col("stops")).over(ws)).filter("entry_no > 0 AND stops = 0")
    first = Window.partitionBy(key, "version", "entry_no")
    line = line.withColumn("open_cut", F.min(F.when(F.col("opens") == 1, F.col("cut"))).over(first)).filter("cut = open_cut")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.trim(F.regexp_replace("line", "^- ", "")).alias("x")))), lambda s: s["x"]), " ")
    return line.groupBy(key, "version", "entry_no").agg(F.first("group").alias("group"), words.alias("entry"))
