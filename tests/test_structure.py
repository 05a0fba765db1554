"""Rewrites that build structure, against recursion on random trees."""

import random

from test_operators import NODE

from arborea.operators import structure as r
from arborea.operators import summary
from arborea.operators import tree as t
from arborea.sources.scratch import written
from pyspark.sql import functions as F


def _random_tree(rnd, doc):
    """Rows of a document, and children by node: [(id, role or None)]."""
    rows, kids, roles = [(doc, 0, None, 0, "root", "root", None)], {0: []}, {0: None}
    for i in range(1, 32):
        up = rnd.choice([k for k in kids if k == 0 or roles[k]])
        leaf = i > 6 and rnd.random() < 0.55
        role = None if leaf or not i else rnd.choice(["L", "LI", "LI", "Lbl", "LBody", "Span", "Div", "P", "Figure"])
        if up == 0 and leaf:
            continue
        kids[up].append(i)
        kids[i], roles[i] = [], role
        rows.append((doc, i, up, i, "content" if leaf else "element", "content-int" if leaf else "element", role))
    return [(*x, None, None, None, 1, False, 0 if x[6] else None, x[1] if x[4] == "content" else None, None) for x in rows], kids, roles


SEEN_THROUGH = {"L", "Span", "Div", "LI", "Lbl", "LBody"}


def _plain_leaves(n, kids, roles):
    """Leaves below n through Spans alone, or None."""
    out = []
    for c in kids[n]:
        if roles[c] is None:
            out.append(c)
        elif roles[c] != "Span" or (below := _plain_leaves(c, kids, roles)) is None:
            return None
        else:
            out += below
    return out


def _melt(n, kids, roles):
    """What n becomes: kept nodes as ids, paragraphs as lists of leaves."""
    if roles[n] not in SEEN_THROUGH:
        return [n]
    out, bare, body = [], [], []

    def close(both):
        for held in (bare, body) if both else (bare,):
            if held:
                out.append(list(held))
                held.clear()

    for c in kids[n]:
        if roles[c] is None:
            bare.append(c)
        elif roles[n] == "LI" and roles[c] in ("Lbl", "LBody") and (own := _plain_leaves(c, kids, roles)) is not None:
            close(False)
            body.extend(own)
        else:
            close(True)
            out += _melt(c, kids, roles)
    close(True)
    return out


def _melted(n, kids, roles, targets):
    """The subtree below n with its topmost targets melted, as nested pairs; a paragraph is ('P', its leaves)."""
    out = []
    for c in kids[n]:
        if c in targets and roles[c] in ("L", "Span", "Div"):
            out += [("P", [(None, x) for x in part]) if isinstance(part, list) else (part, _whole(part, kids, roles)) for part in _melt(c, kids, roles)]
        elif c in targets and roles[c]:
            out.append((c, _whole(c, kids, roles)))
        else:
            out.append((None, c) if roles[c] is None else (c, _melted(c, kids, roles, targets)))
    return out


def _whole(n, kids, roles):
    return [(None, c) if roles[c] is None else (c, _whole(c, kids, roles)) for c in kids[n]]


def test_paragraphs_against_recursion(spark):
    rnd, rows, want = random.Random(5), [], {}
    for doc in range(60):
        own, kids, roles = _random_tree(rnd, doc)
        rows += own
        want[doc] = _melted(0, kids, roles, {i for i in kids if i % 3 == 0 and roles[i]})
    tree = written(t.tree_keys(spark.createDataFrame(rows, NODE)), "tree")
    got = r.to_paragraphs(tree, tree.filter("node_id % 3 = 0 AND type = 'element'"), F.lit(1000) + F.col("first")).collect()
    below = {}
    for x in sorted(got, key=lambda x: (x.doc_id, x.ord)):
        below.setdefault((x.doc_id, x.parent_id), []).append(x)

    def shape(doc, n):
        return [(None, x.node_id) if x.type == "content" else ("P" if x.node_id >= 1000 else x.node_id, shape(doc, x.node_id)) for x in below.get((doc, n), [])]

    for doc, tree_of in want.items():
        assert shape(doc, 0) == tree_of, doc
    assert {x.role for x in got if x.node_id >= 1000} == {"P"}


def test_names_of_undivided_roles(spark):
    one = spark.createDataFrame([("TD",), ("P",), (None,)], "role string").select(r.undivided(F.col("role")).alias("u")).collect()
    assert [x.u for x in one] == [True, False, False]


def test_bookmarks_without_a_page_are_deleted_from_too(spark):
    from arborea.plans import registry
    from arborea.plans.adapters import tree

    small = "/root/testdata/sf0.001"
    heads = {(r.doc_id, r.node_id): r.parent for r in summary.heading_parents(tree(spark, small).filter(summary.numbered_heading(F.col("role")))).collect()}
    gone = {k for k in heads if k[1] % 5 == 0}
    while more := {(d, n) for (d, n), up in heads.items() if (d, up) in gone} - gone:
        gone |= more
    assert {(r.doc_id, r.bookmark_id) for r in registry.QUERIES["delete_bookmarks"](spark, small).collect()} == set(heads) - gone
