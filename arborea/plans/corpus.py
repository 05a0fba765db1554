"""One facade over a corpus: the verbs of the query and edit interface as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import audit, content, predicates, rewrite, structure, summary, tables, tagging, text, tree as t


class Corpus:
    """A corpus of documents: node rows, and the fact tables that a verb may need."""

    def __init__(self, nodes: DataFrame, **facts: DataFrame):
        self.tree = nodes if "path" in nodes.columns else t.tree_keys(nodes)
        self.facts = facts

    def _next(self, nodes: DataFrame) -> "Corpus":
        return Corpus(nodes, **self.facts)

    # reading
    def tree_summary(self) -> DataFrame:
        return summary.tree_summary(self.tree, self.empty())

    def get_nodes(self, starts: DataFrame | None = None, levels: int = 3, most: int = 300, with_leaves: bool = False) -> DataFrame:
        """The tags below each start (doc_id, node_id), or below the root."""
        starts = self.tree.filter("depth = 0").select("doc_id", "node_id") if starts is None else starts
        return predicates.subtree(self.tree, starts, levels, most, with_leaves)

    def attributes(self) -> DataFrame:
        return predicates.attributes(self.tree)

    def filtered(self, name: str, flags: DataFrame | None = None) -> DataFrame:
        """doc_id, node_id of what one tag filter lists, the outermost where it stops at a match."""
        found = predicates.filters(self.tree, self.empty(), flags)
        return predicates.outermost(found.filter(F.col("filter") == name)).select("doc_id", "node_id")

    def proofread(self) -> DataFrame:
        return predicates.proofread(self.tree)

    def headings(self) -> DataFrame:
        return summary.heading_list(self.tree)

    def table_cells(self, mode: str = "preview") -> DataFrame:
        return tables.walked_cells(self.tree, mode)

    def artifacts(self) -> DataFrame:
        """Listed artifacts of the facts ``ops``; with ``declared`` also their text and boxes."""
        deep = content.with_depth(self.facts["ops"])
        spans = content.spans(deep)
        return content.artifact_details(deep, spans, self.facts["declared"]) if "declared" in self.facts else content.artifacts(deep, spans)

    def parent_tree(self) -> DataFrame:
        """The reverse map with the keys of the facts ``page_keys``, ``object_keys`` and ``declared_keys``."""
        return t.parent_tree(self.tree, self.facts["page_keys"], self.facts["object_keys"], self.facts["declared_keys"])

    def selection_plan(self, selection: DataFrame) -> DataFrame:
        return tagging.wrap_plan(self.tree, selection)

    def find_nodes(self, **filters) -> DataFrame:
        return predicates.find_nodes(self.tree, **filters)

    def empty(self) -> DataFrame:
        return audit.empty_nodes(self.tree)

    def verify(self) -> DataFrame:
        f = self.facts
        shown = content.shown_text(f["ops"]) if "ops" in f else None
        orphans = content.orphans_by_document(f["ops"], f["claimed"]) if "ops" in f else None
        found = audit.instances(self.tree, f["pages"], f["annotations"], self.empty(), shown)
        return audit.report(f["info"], audit.document_rules(f["info"], f["outline"], self.tree), found, self.tree, f["annotations"], orphans)

    def text(self) -> DataFrame:
        return text.content_text(self.tree, self.facts["leaf_text"])

    def direct_text(self) -> DataFrame:
        return text.direct_text(self.tree, self.facts["leaf_text"])

    def bookmarks(self) -> DataFrame:
        """The outline that the headings give, with titles and pages."""
        return structure.generated_bookmarks(self.tree, self.facts["leaf_text"])

    def bookmark_slots(self, pages: DataFrame) -> DataFrame:
        """Where bookmarks for pages (doc_id, page) belong in the outline of the facts."""
        return summary.nested_slots(self.facts["outline"], pages)

    # editing: each returns the next version
    def update_nodes(self, changes: DataFrame) -> "Corpus":
        return self._next(rewrite.update_nodes(self.tree, rewrite_only(self.tree, changes)))

    def delete(self, selection: DataFrame) -> "Corpus":
        return self._next(rewrite.delete_nodes(self.tree, selection))

    def move_to_front(self, selection: DataFrame) -> "Corpus":
        return self._next(rewrite.move_to_front(self.tree, selection))

    def join_previous(self, selection: DataFrame) -> "Corpus":
        return self._next(rewrite.join_previous(self.tree, selection))

    def flatten(self, targets: DataFrame) -> "Corpus":
        return self._next(rewrite.flatten(self.tree, targets))

    def to_paragraphs(self, targets: DataFrame, new_id: Column) -> "Corpus":
        return self._next(structure.to_paragraphs(self.tree, targets, new_id))

    def group(self, selection: DataFrame, role: str, group_id: Column, item_id: Column) -> "Corpus":
        return self._next(structure.group_nodes(self.tree, selection, role, group_id, item_id))

    def make_lists(self, selection: DataFrame, ids: dict[str, Column]) -> "Corpus":
        return self._next(structure.make_lists(self.tree, selection, self.facts["leaf_text"], ids))

    def move_one_step(self, selection: DataFrame, by: int) -> "Corpus":
        return self._next(structure.move_one_step(self.tree, selection, by))

    def insert_paragraphs(self, anchors: DataFrame, new_id: Column) -> "Corpus":
        return self._next(structure.insert_paragraphs(self.tree, anchors, new_id))

    def join_into_first(self, selection: DataFrame) -> "Corpus":
        return self._next(rewrite.join_into_first(self.tree, selection))

    def move(self, moves: DataFrame) -> "Corpus":
        return self._next(rewrite.move_nodes(self.tree, moves))

    def replace_role(self, find: str, put: str) -> "Corpus":
        return self._next(rewrite.replace_role(self.tree, find, put))

    def shift_headings(self, by: int) -> "Corpus":
        return self._next(rewrite.shift_headings(self.tree, by))

    def wrap_content(self, selection: DataFrame, role: str, ids: dict[str, Column]) -> "Corpus":
        return self._next(tagging.wrap_selection(self.tree, selection, role, ids))

    def tag_runs(self, runs: DataFrame, role: str, ids: dict[str, Column]) -> "Corpus":
        """Runs of text under one new tag; the facts' texts and instructions follow the cuts."""
        nodes, pieces = tagging.tag_runs(self.tree, runs, self.facts["leaf_text"], role, ids, self.facts.get("ops"))
        return self._cut(nodes, pieces)

    def convert_items(self, selection: DataFrame, ids: dict[str, Column]) -> "Corpus":
        nodes, pieces = tagging.convert_items(self.tree, selection, self.facts["leaf_text"], ids, self.facts.get("ops"))
        return self._cut(nodes, pieces)

    def _cut(self, nodes: DataFrame, pieces: DataFrame) -> "Corpus":
        facts = dict(self.facts)
        cut = pieces.filter("text IS NOT NULL").select("doc_id", "node_id", F.col("text").alias("piece_text"))
        facts["leaf_text"] = facts["leaf_text"].join(cut, ["doc_id", "node_id"], "full").withColumn("text", F.coalesce("piece_text", "text")).drop("piece_text")
        if "shown" in facts.get("ops", nodes).columns:
            facts["ops"] = tagging.cut_marks(facts["ops"], pieces)
        return Corpus(nodes, **facts)

    def to_figure(self, targets: DataFrame) -> "Corpus":
        return self._next(rewrite.collapse_to_leaves(self.tree, targets, "Figure"))

    def prune(self, candidates: DataFrame) -> "Corpus":
        return self._next(rewrite.prune_emptied(self.tree, candidates))

    def scope_tables(self) -> "Corpus":
        return self._next(rewrite.scoped(self.tree))

    def toggle_headers(self, tables_: DataFrame) -> "Corpus":
        """The cells of tables (doc_id, tab) become headers, or data where all are headers."""
        new = tables.toggled_headers(tables.cells(self.tree).join(tables_, ["doc_id", "tab"], "left_semi")).withColumnRenamed("role", "new_role")
        return self._next(self.tree.join(new, ["doc_id", "node_id"], "left").withColumn("role", F.coalesce("new_role", "role")).select(*rewrite.NODE))

    def remove_links(self) -> "Corpus":
        """Links become text; the facts' annotations go, and spans marked Link are renamed."""
        facts = dict(self.facts)
        role_map = facts.get("role_map")
        if "annotations" in facts:
            facts["annotations"] = facts["annotations"].limit(0)
        if "ops" in facts:
            facts["ops"] = rewrite.unlinked_ops(facts["ops"])
        return Corpus(rewrite.remove_links(self.tree, role_map), **facts)

    def repair_orphans(self) -> "Corpus":
        """Content that no tag claims becomes an artifact of its page."""
        return Corpus(self.tree, **self.facts | {"ops": content.repaired_pages(self.facts["ops"], self.facts["claimed"])})

    def update_doc_info(self, changes: DataFrame) -> "Corpus":
        return Corpus(self.tree, **self.facts | {"info": structure.update_doc_info(self.facts["info"], changes)})

    def set_tab_order(self) -> "Corpus":
        return Corpus(self.tree, **self.facts | {"pages": structure.set_tab_order(self.facts["pages"]).drop("changed")})

    def difference(self, after: "Corpus") -> DataFrame:
        return t.shape_difference(self.tree, after.tree)

    def run_script(self, steps: list[dict]) -> "Corpus":
        return self._next(rewrite.run_script(self.tree, steps))


def rewrite_only(tree: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes without those that would be refused."""
    return changes.join(rewrite.refused_updates(tree, changes), ["doc_id", "node_id"], "left_anti")
