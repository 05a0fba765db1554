"""Sources and sinks: nested trees, markup, command logs, versions with a pointer."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .scratch import written

# fixed values: what each element of markup becomes; elements without content; elements that end when another of their kind begins
ROLES = {
    "h1": "H1", "h2": "H2", "h3": "H3", "h4": "H4", "h5": "H5", "h6": "H6", "p": "P", "ul": "L", "ol": "L", "li": "LI", "a": "Link", "b": "Span", "i": "Span", "em": "Span", "strong": "Span", "span": "Span", "code": "Code",
    "table": "Table", "tr": "TR", "th": "TH", "td": "TD", "nav": "Sect", "header": "Sect", "footer": "Sect", "main": "Sect", "section": "Sect", "article": "Art", "div": "Div", "img": "Figure", "blockquote": "BlockQuote", "body": "Document",
}
VOID = frozenset(("img", "br", "hr", "meta", "link", "input"))
SILENT = frozenset(("script", "style", "head", "title", "template"))
CLOSES = {"p": ("p",), "li": ("li", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p")}


class _Nodes(HTMLParser):
    """Rows of one page in document order; unclosed elements end with what holds them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.stack, self.quiet, self.counts = [], [("", 0)], [], {0: 0}

    def _row(self, role, kind, text=None, alt=None) -> int:
        parent, n = self.stack[-1][1], len(self.rows) + 1
        self.rows.append((n, parent, self.counts.get(parent, 0), kind, role, text, alt))
        self.counts[parent] = self.counts.get(parent, 0) + 1
        return n

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.quiet.append(tag)
        if self.quiet or tag not in ROLES:
            return
        if tag in CLOSES:
            while self.stack[-1][0] in CLOSES[tag]:
                self.stack.pop()
        n = self._row(ROLES[tag], "element", None, dict(attrs).get("alt"))
        if tag not in VOID:
            self.stack.append((tag, n))

    def handle_endtag(self, tag):
        if tag in self.quiet:
            del self.quiet[self.quiet.index(tag) :]
        elif any(t == tag for t, _ in self.stack[1:]) and not self.quiet:
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not self.quiet and data.strip():
            self._row(None, "content", " ".join(data.split()))


def markup_nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """doc_id, node_id, parent_id (0: the page), ord, type, role, text, alt of the nodes of each page's markup."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k, h in zip(pdf["doc_id"], pdf["html"]):
                p = _Nodes()
                p.feed(h or "")
                p.close()
                rows += [(k, *r) for r in p.rows]
            yield pd.DataFrame(rows, columns=["doc_id", "node_id", "parent_id", "ord", "type", "role", "text", "alt"])

    return pages.select(F.col(key).cast("long").alias("doc_id"), F.col(html).alias("html")).mapInPandas(run, "doc_id long, node_id int, parent_id int, ord int, type string, role string, text string, alt string")


def nested_nodes(trees: DataFrame) -> DataFrame:
    """doc_id, path, role, ord of the nodes of nested trees (doc_id, tree: JSON text with role and children), level by level until one is empty."""
    spark = trees.sparkSession
    level = written(trees.select("doc_id", F.lit("0").alias("path"), F.lit(0).alias("ord"), F.try_parse_json("tree").alias("v")).select("doc_id", "path", "ord", F.try_variant_get("v", "$.role", "string").alias("role"), F.to_json(F.try_variant_get("v", "$.children", "variant")).alias("kids")), "nested")
    found = level
    while True:
        level = written(spark.sql("SELECT doc_id, concat(path, '/', pos) AS path, CAST(pos AS INT) AS ord, try_variant_get(value, '$.role', 'string') AS role, to_json(try_variant_get(value, '$.children', 'variant')) AS kids FROM {up}, LATERAL variant_explode(try_parse_json(kids))", up=level), "nested")
        if level.isEmpty():
            return found.drop("kids")
        found = found.unionByName(level)


def command_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """id, cmd, payload, bad of a log of JSON lines; a malformed line is a bad row and stops nothing. Works on streams."""
    v = F.try_parse_json(column)
    return lines.select(F.try_variant_get(v, "$.id", "bigint").alias("id"), F.try_variant_get(v, "$.cmd", "string").alias("cmd"), F.col(column).alias("payload"), v.isNull().alias("bad"))


def save_version(df: DataFrame, root: str, version: int, at: str) -> None:
    """Writes a version beside the earlier ones, then names it in the table of versions; readers see whole versions only."""
    df.write.mode("errorifexists").parquet(f"{root}/v={version}")
    df.sparkSession.createDataFrame([(version, at)], "version long, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(f"{root}/versions")


def open_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The newest version, or the one asked for."""
    if version is None:
        version = spark.read.parquet(f"{root}/versions").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{root}/v={version}")


def expired_versions(versions: DataFrame, now: str, days: int = 7) -> DataFrame:
    """Versions older than the retention, the newest aside."""
    newest = versions.agg(F.max("version")).first()[0]
    return versions.filter((F.col("at") < F.to_timestamp(F.lit(now)) - F.make_interval(days=F.lit(days))) & (F.col("version") != newest))
