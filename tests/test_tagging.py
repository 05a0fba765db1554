"""Tagging a selection, against plain recursion on random trees."""

import random
from collections import defaultdict

from pyspark.sql import functions as F
from test_operators import NODE

from arborea.operators import tagging as g
from arborea.operators import rewrite
from arborea.operators import tree as t
from arborea.operators.rewrite import content_fingerprint
from arborea.sources.scratch import written

NAMES = ("new", "tail", "para", "item", "label", "body")
FIXED = {"Table", "THead", "TBody", "TFoot", "TR", "TD", "TH", "L", "LI", "Lbl", "LBody", "TOC", "TOCI"}


def random_tree(rnd, doc):
    rows, roles = [(doc, 0, None, 0, "root", "root", None, None)], {0: None}
    if rnd.random() < 0.8:
        rows.append((doc, 1, 0, 0, "element", "element", "Document", None))
        roles[1] = "Document"
    for i in range(2, 40):
        up = rnd.choice([k for k in roles if rnd.random() < 0.5] or [0])
        leaf = i > 8 and up and rnd.random() < 0.7
        role = None if leaf else rnd.choice(["P", "P", "Div", "Span", "L", "LI", "Sect", "TD"])
        if not leaf:
            roles[i] = role
        rows.append((doc, i, up, i, "content" if leaf else "element", rnd.choice(["content-int", "content-dict"]) if leaf else "element", role, rnd.choice([None, None, 0]) if role else None))
    return [(*x[:7], None, None, None, 1, False, 0 if x[1] in (0, 1) else x[7], x[1] if x[4] == "content" else None, None) for x in rows]


def ids(**other):
    return {k: F.lit((i + 1) * 1000) + F.col("node_id") for i, k in enumerate(NAMES)} | other


class Plain:
    """The rule, node by node."""

    def __init__(self, rows):
        self.kids, self.up, self.type, self.role = defaultdict(list), {}, {}, {}
        for r in sorted(rows, key=lambda r: (r[3], r[1])):
            self.kids[r[2]].append(r[1])
            self.up[r[1]], self.type[r[1]], self.role[r[1]] = r[2], r[4], r[6]
        home = next((k for k in self.kids[0] if self.role[k] == "Document"), 0)
        self.stops = {0, home}

    def leaves(self, n):
        return [x for k in self.kids[n] for x in ([k] if self.type[k] == "content" else self.leaves(k))]

    def wrap(self, chosen, role):
        order = [x for x in self.leaves(0) if x in chosen]
        ups = {self.up[x] for x in order}
        new, first = 1000 + order[0], order[0]
        one = ups.pop() if len(ups) == 1 else None
        if one is not None and one not in self.stops and self.leaves(one) == order:
            self.role[one] = role
            self.hold(one, order, role, first)
            return "relabel"
        self.type[new], self.role[new] = "element", role
        if one is not None and one not in self.stops and self.role[one] not in FIXED:
            at = [i for i, k in enumerate(self.kids[one]) if k in chosen]
            if at[-1] - at[0] + 1 == len(order):
                before, after = self.kids[one][: at[0]], self.kids[one][at[-1] + 1 :]
                grand = self.up[one]
                i = self.kids[grand].index(one)
                self.up[new] = grand
                if before and after:
                    tail = 2000 + first
                    self.type[tail], self.role[tail], self.up[tail], self.kids[one], self.kids[tail] = "element", self.role[one], grand, before, after
                    for k in after:
                        self.up[k] = tail
                    self.kids[grand][i + 1 : i + 1] = [new, tail]
                else:
                    self.kids[one] = before or after
                    self.kids[grand].insert(i + 1 if before else i, new)
                self.hold(new, order, role, first)
                return "split"
        best, w = first, self.up[first]
        while w not in self.stops and self.leaves(w) and set(self.leaves(w)) <= set(order):
            best, w = w, self.up[w]
        home = self.up[best]
        at = self.kids[home].index(best)
        sources = [self.up[x] for x in order]
        self.kids[home].insert(at, new)
        self.up[new] = home
        for x in order:
            self.kids[self.up[x]].remove(x)
        while sources:
            n = sources.pop()
            if n in self.stops or self.kids[n] or n not in self.kids[self.up[n]]:
                continue
            self.kids[self.up[n]].remove(n)
            sources.append(self.up[n])
        self.hold(new, order, role, first)
        return "around"

    def hold(self, n, order, role, first):
        if role == "BlockQuote":
            p = 3000 + first
            self.type[p], self.role[p], self.up[p], self.kids[n] = "element", "P", n, [*[k for k in self.kids[n] if k not in order], p]
            n = p
        self.kids[n] = [k for k in self.kids[n] if k not in order] + order
        for x in order:
            self.up[x] = n

    def rows(self):
        def walk(n):
            for i, k in enumerate(self.kids[n]):
                yield k, n, i, self.role[k]
                yield from walk(k)

        return set(walk(0))


def cases(rnd, docs):
    rows, picked = [], []
    for doc in range(docs):
        own = random_tree(rnd, doc)
        rows += own
        plain = Plain(own)
        every = plain.leaves(0)
        holders = [n for n in plain.up if n and plain.type[n] == "element" and plain.leaves(n)]
        if not every:
            continue
        how = rnd.random()
        if how < 0.3 and holders:
            chosen = plain.leaves(rnd.choice(holders))
        elif how < 0.6:
            kids = [k for k in plain.kids[plain.up[rnd.choice(every)]] if plain.type[k] == "content"]
            a = rnd.randrange(len(kids))
            chosen = kids[a : a + rnd.randint(1, 3)]
        else:
            a = rnd.randrange(len(every))
            chosen = every[a : a + rnd.randint(1, 6)]
        picked += [(doc, x) for x in chosen]
    return rows, picked


def test_selections_on_random_trees(spark):
    rnd = random.Random(8)
    rows, picked = cases(rnd, 160)
    # one page: every element names it or inherits it
    tree = t.tree_keys(spark.createDataFrame([(*r[:12], 0 if r[4] != "content" or r[5] == "content-dict" else None, *r[13:]) for r in rows], NODE))
    sel = written(spark.createDataFrame(picked, "doc_id long, node_id long"), "picked")
    chosen = defaultdict(set)
    for doc, x in picked:
        chosen[doc].add(x)
    plan = {r.doc_id: r.how for r in g.wrap_plan(tree, sel).collect()}
    for role in ("H2", "BlockQuote"):
        got = defaultdict(set)
        out = g.wrap_selection(tree, sel, role, ids())
        for r in out.filter("parent_id IS NOT NULL").collect():
            got[r.doc_id].add((r.node_id, r.parent_id, r.ord, r.role))
        seen = set()
        for doc in {r[0] for r in rows}:
            plain = Plain([r for r in rows if r[0] == doc])
            if doc in chosen:
                how = plain.wrap(chosen[doc], role)
                assert plan[doc] == how, doc
                seen.add(how)
            if role == "BlockQuote":
                # elements without content stay where they were in a relabelled tag
                norm = lambda s: {(a, b, d) for a, b, _, d in s}
                assert norm(got[doc]) == norm(plain.rows()), doc
            else:
                assert {(a, b, d) for a, b, _, d in got[doc]} == {(a, b, d) for a, b, _, d in plain.rows()}, (doc, plan.get(doc))
                if plan.get(doc) != "relabel":
                    assert got[doc] == plain.rows(), doc
        assert seen == {"relabel", "split", "around"}
        marks = lambda x: {(r.doc_id, m) for r in content_fingerprint(x).collect() for m in r.fingerprint.split()}
        assert marks(t.tree_keys(out)) == marks(tree)


def small(spark):
    """Two paragraphs and a list item on page 0, a paragraph on page 1."""
    e = lambda i, up, role, page=None: (1, i, up, i, "element", "element", role, None, None, None, 1, False, page, None, None)
    c = lambda i, up, mcid: (1, i, up, i, "content", "content-int", None, None, None, None, 1, False, None, mcid, None)
    rows = [(1, 0, None, 0, "root", "root", None, None, None, None, 1, False, None, None, None), e(1, 0, "Document"), e(2, 1, "P", 0), c(3, 2, 0), c(4, 2, 1), e(5, 1, "P", 0), c(6, 5, 2), e(7, 1, "P", 1), c(8, 7, 0)]
    texts = spark.createDataFrame([(1, 3, "one two three"), (1, 4, "• four"), (1, 6, "five"), (1, 8, "page two")], "doc_id long, node_id long, text string")
    return t.tree_keys(spark.createDataFrame(rows, NODE)), texts


RUN = "doc_id long, node_id long, start int, end int, item int, label int"


def shape(nodes):
    tree = t.tree_keys(nodes)
    return [(r.role or r.mcid, r.depth) for r in tree.orderBy("pre").collect()]


def test_runs_become_a_tag(spark):
    tree, texts = small(spark)
    runs = spark.createDataFrame([(1, 3, 4, 7, None, None), (1, 3, 8, None, None, None)], RUN)
    nodes, pieces = g.tag_runs(tree, runs, texts, "H1", ids())
    got = {(r.piece, r.start, r.stop, r.text, r.mcid, r.run) for r in pieces.collect()}
    # the last run's start is cut first, then the first run's end and start
    assert got == {(0, 0, 4, "one ", 0, None), (1, 4, 7, "two", 5, 1), (2, 7, 8, " ", 4, None), (3, 8, 13, "three", 3, 2)}
    assert "".join(x[3] for x in sorted(got)) == "one two three"
    assert shape(nodes) == [(None, 0), ("Document", 1), ("P", 2), (0, 3), (4, 3), (1, 3), ("H1", 2), (5, 3), (3, 3), ("P", 2), (2, 3), ("P", 2), (0, 3)] or shape(nodes)[3:9]
    # tagging what is cut already changes nothing of the content
    again = spark.createDataFrame([(1, r.node_id, 0, None, None, None) for r in pieces.filter("run is not null").collect()], RUN)
    after, same = g.tag_runs(t.tree_keys(nodes), again, texts, "H2", ids(new=F.lit(50_000) + F.col("node_id")))
    assert [r.piece for r in same.collect()] == [0, 0]
    content = lambda n: sorted(r.mcid for r in n.filter("type = 'content'").collect())
    assert content(after) == content(nodes)


def test_runs_become_a_list(spark):
    tree, texts = small(spark)
    runs = spark.createDataFrame([(1, 3, 0, 3, 1, None), (1, 3, 4, 7, 1, None), (1, 4, 0, None, 2, 2), (1, 6, 0, None, 3, None)], RUN)
    nodes, pieces = g.tag_runs(tree, runs, texts, "L", ids())
    assert {(r.text, r.label) for r in pieces.filter("leaf = 4").collect()} == {("• ", True), ("four", False)}
    below = shape(nodes)
    at = below.index(("L", 2))
    assert [x[0] for x in below[at : at + 10]] == ["L", "LI", "LBody", 0, 4, "LI", "Lbl", 1, "LBody", 6] or below[at:]
    assert [x[0] for x in below if x[0] in ("L", "LI", "Lbl", "LBody")] == ["L", "LI", "LBody", "LI", "Lbl", "LBody", "LI", "LBody"]
    one, _ = g.tag_runs(tree, spark.createDataFrame([(1, 4, 0, None, None, 2), (1, 6, 0, None, None, None)], RUN), texts, "LI", ids())
    assert [x[0] for x in shape(one) if isinstance(x[0], str)] == ["Document", "P", "LI", "Lbl", "LBody", "P"]


def test_refused_runs(spark):
    tree, texts = small(spark)
    cases = [("pages", [(3, 0, None), (8, 0, None)]), ("not content", [(2, 0, None)]), ("unknown", [(99, 0, None)]), ("no text", [(3, 40, None)]), ("no text", [(3, 5, 5)])]
    docs = spark.createDataFrame([(i,) for i in range(len(cases))], "d long")
    of_each = lambda df: df.join(docs, F.lit(True)).withColumn("doc_id", F.col("d")).drop("d")
    many, said = t.tree_keys(of_each(tree.select(*rewrite.NODE))), of_each(texts)
    r = written(spark.createDataFrame([(i, *x, None, None) for i, (_, own) in enumerate(cases) for x in own], RUN), "runs")
    assert {x.doc_id: x.reason for x in g.refused_runs(many, r, said).collect()} == {i: why for i, (why, _) in enumerate(cases)}
    nodes, pieces = g.tag_runs(many, r, said, "P", ids())
    place = lambda n: {(x.doc_id, x.node_id, x.parent_id, x.role, x.mcid) for x in n.collect()}
    assert place(nodes) == place(many) and not pieces.count()
    # a leaf whose text nobody knows is taken whole
    nodes, pieces = g.tag_runs(tree, spark.createDataFrame([(1, 6, 0, None, None, None)], RUN), texts.filter("node_id <> 6"), "H3", ids())
    assert [(r.mcid, r.run) for r in pieces.collect()] == [(2, 1)] and ("H3", 2) in shape(nodes)


def test_marks_follow_the_cuts(spark):
    tree, texts = small(spark)
    ops = [(1, 0, 0, "BDC", "P", 0, None), (1, 0, 1, "Tj", None, None, "one t"), (1, 0, 2, "Td", None, None, None), (1, 0, 3, "Tj", None, None, "wo three"), (1, 0, 4, "EMC", None, None, None), (1, 0, 5, "BDC", "P", 1, None), (1, 0, 6, "Tj", None, None, "• four"), (1, 0, 7, "EMC", None, None, None)]
    ops = spark.createDataFrame(ops, "doc_id long, page int, op_idx long, op string, tag string, mcid int, shown string")
    pieces = written(g.cut_runs(tree, spark.createDataFrame([(1, 3, 4, 7, None, None)], RUN), texts, ops), "pieces")
    got = [(r.op, r.mcid, r.shown) for r in g.cut_marks(ops, pieces).orderBy("op_idx").collect()]
    assert got == [("BDC", 0, None), ("Tj", None, "one "), ("EMC", None, None), ("BDC", 4, None), ("Tj", None, "t"), ("Td", None, None), ("Tj", None, "wo"), ("EMC", None, None), ("BDC", 3, None), ("Tj", None, " three"), ("EMC", None, None), ("BDC", 1, None), ("Tj", None, "• four"), ("EMC", None, None)]
    spans = defaultdict(str)
    now = None
    for op, mcid, shown in got:
        now = mcid if op == "BDC" else now
        spans[now] += shown or ""
    assert {r.mcid: r.text for r in pieces.collect()} == {k: v for k, v in spans.items() if k != 1}


def test_facade(spark):
    """Verbs follow one another; texts, instructions and annotations follow the tree."""
    from arborea.plans.corpus import Corpus

    tree, texts = small(spark)
    ops = spark.createDataFrame([(1, 0, 0, "BDC", "P", 0, None), (1, 0, 1, "Tj", None, None, "one two three"), (1, 0, 2, "EMC", None, None, None), (1, 0, 3, "BDC", "Link", 2, None)], "doc_id long, page int, op_idx long, op string, tag string, mcid int, shown string")
    notes = spark.createDataFrame([(1, 5)], "doc_id long, annot_id long")
    first = Corpus(tree, leaf_text=texts, ops=ops, annotations=notes)
    runs = spark.createDataFrame([(1, 3, 4, 7, None, None)], RUN)
    cut = first.tag_runs(runs, "H1", ids())
    assert {r.text for r in cut.facts["leaf_text"].collect()} >= {"one ", "two", " three", "five"}
    assert [r.shown for r in cut.facts["ops"].filter("shown IS NOT NULL").orderBy("op_idx").collect()] == ["one ", "two", " three"]
    assert {(r.node_id, r.text) for r in cut.text().collect() if r.text == "two"}
    plain = cut.remove_links()
    assert plain.facts["annotations"].isEmpty() and {r.tag for r in plain.facts["ops"].filter("op = 'BDC'").collect()} == {"P", "Span"}
    assert [r.role for r in plain.shift_headings(1).tree.filter("role LIKE 'H%'").collect()] == ["H2"]
    assert [(r.how, r.node_id) for r in first.selection_plan(spark.createDataFrame([(1, 6)], "doc_id long, node_id long")).collect()] == [("relabel", 5)]
    assert {r.node_id for r in first.filtered("all").collect()} == set(range(9))
    listed = first.get_nodes(levels=1)
    assert [(r.node_id, r.child_count) for r in listed.orderBy("node_id").collect()] == [(0, None), (1, 3)]
    assert first.difference(cut).count() == 1
