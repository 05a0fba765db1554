"""Source divergence audit: how far the sources of a language differ in the terms they use.

Every term of a group (language, source) gets a smoothed share p of 1,000,000,000; two groups diverge by the sum of
floor((p - q)^2 / (p + q)) over all terms that the language keeps.

Pairs are priced by a sparse merge. The kept terms of a language are dealt to blocks of about ``BLOCK`` and numbered in each; a group's array in
a block holds its (term id, share) in order of id, and one row brings the arrays of the two groups of an unordered pair together. The
shorter array gallops through the longer one; overlaps are priced by both shares, one-sided terms by the share that an absent term has
on the other side, and terms absent from both need no array: what blocks don't list is counted and priced once, at the end. A task
holds arrays of one block, whatever the size of the vocabulary; of languages with many sources the pairs are also dealt by tiles of ``TILE`` sources.

Terms are counted where texts are read, so what is shuffled is one row for each term, group and task. All arithmetic is on whole numbers of 64
bits: shares are divided in three steps of 1,000, exact up to 9 * 10^15 occurrences in a group.

Defined cases: a null text, language or source counts as empty; a group without terms has shares like any other, in a language without kept terms
all values are 0; repeated rows count each; a very long text is one document; ties go to the smaller item in UTF-8; other columns, whatever their
names, are not looked at; doc_id is not needed; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch, bounded_batches

#: A term is kept from so many documents of its language; ranks of terms that are listed.
DOCUMENTS, LISTED = 10, 10
#: Terms of a block, sources of a tile, terms that a task counts before it hands them on.
BLOCK, TILE, HELD = 2_048, 256, 500_000
WHOLE = 1_000_000_000
#: A-Z to lower case; what is no letter of ASCII and below 0x80 to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])


def _count(batches):
    """Occurrences and documents of every term of a group; a group's own row has the empty term."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush():
        for (lang, source), (n, df) in groups.items():
            terms = [b"", *n]
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(terms), pa.string()) for x in (lang, source)] + [pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(df.__getitem__, n)], pa.int64())], schema=_COUNTS)
        groups.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary())):
            n, df = groups.setdefault((lang, source), (Counter(), Counter()))
            terms = (text.as_py() or b"").translate(_FOLD).split()
            n.update(terms)
            df.update(set(terms))
        if sum(len(n) for n, _ in groups.values()) > HELD:
            yield from flush()
    yield from flush()


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(WHOLE * (count + 2) / (total + 2 * kept)), three digits at a time."""
    below, out, rest = total + 2 * kept, F.lit(0).cast("long"), count + 2
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + _div(rest, below), rest % below
    return out + 1


def apart(p: Column, q: Column) -> Column:
    """What a term adds to the divergence of two groups; p and q up to WHOLE + 1, so the square fits 64 bits."""
    return _div((p - q) * (p - q), p + q)


def gallop(longer: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """First place in ``longer`` whose id isn't below, for each id of ``shorter``: doubling steps until the id is passed, then bisection."""
    high, last = np.zeros(len(shorter), np.int64), len(longer) - 1
    step = 1
    while len(behind := np.flatnonzero((high <= last) & (longer[np.minimum(high, last)] < shorter))):
        high[behind] = step
        step *= 2
    low = high // 2  # what stands before is below the id
    high = np.minimum(high, last + 1)
    while (low < high).any():
        mid = (low + high) // 2
        less = longer[np.minimum(mid, last)] < shorter
        low = np.where((low < high) & less, mid + 1, low)
        high = np.where(less, high, mid)
    return low


def _apart(p: np.ndarray, q) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def price(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], none_a: int, none_b: int) -> tuple[int, int]:
    """Sum over the terms that either of two sparse arrays (ascending ids, shares) lists, and their number. ``none_*``: the share of an absent term."""
    if len(a[0]) < len(b[0]):
        a, b, none_a, none_b = b, a, none_b, none_a
    if not len(b[0]):
        return int(_apart(a[1], none_b).sum()), len(a[0])
    at = gallop(a[0], b[0])
    met = (at < len(a[0])) & (a[0][np.minimum(at, len(a[0]) - 1)] == b[0])
    only_a = np.ones(len(a[0]), bool)
    only_a[at[met]] = False
    total = _apart(a[1][at[met]], b[1][met]).sum() + _apart(a[1][only_a], none_b).sum() + _apart(none_a, b[1][~met]).sum()
    return int(total), len(a[0]) + int((~met).sum())


def _price(batches):
    for batch in batches:
        sides = []
        for side in "ab":
            lists = batch.column(f"terms_{side}")
            ends, each = lists.offsets.to_numpy(), lists.values
            ids, shares = each.field("id").to_numpy(zero_copy_only=False), each.field("p").to_numpy(zero_copy_only=False)
            sides.append((ends, ids, shares, batch.column(f"none_{side}").to_numpy()))
        found = [price(*((ids[e[i] : e[i + 1]], ps[e[i] : e[i + 1]]) for e, ids, ps, _ in sides), *(int(none[i]) for *_, none in sides)) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("lang", "a", "b")), pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["lang", "a", "b", "value", "listed"])


def _pairs(kept: DataFrame, groups: DataFrame, scratch: Scratch, block: int, tile: int) -> DataFrame:
    """lang, a, b, value for every unordered pair of a language's groups, a < b."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("v") / block))
    terms = kept.filter("term <> ''").join(groups.select("lang", "source", "v", "n_group"), ["lang", "source"])
    terms = terms.select("lang", "source", "term", F.pmod(F.xxhash64("term"), blocks).alias("block"), share(F.col("n"), F.col("n_group"), F.col("v")).alias("p"))
    # each group has an array in each block, if an empty one
    grid = groups.filter("v > 0").select("lang", "source", F.lit(None).cast("string").alias("term"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), F.lit(None).cast("long").alias("p"))
    numbered = terms.unionByName(grid).withColumn("id", F.dense_rank().over(Window.partitionBy("lang", "block").orderBy("term")).cast("long"))
    arrays = numbered.groupBy("lang", "block", "source").agg(F.sort_array(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("id", "p")))).alias("terms"))
    arrays = scratch.write(arrays, "arrays").join(groups.select("lang", "source", "none"), ["lang", "source"])
    tiles = -(-(groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0) // tile)
    # the tiles of side a; side b goes to each of them
    a = arrays.select("lang", "block", F.pmod(F.xxhash64("source"), F.lit(max(1, tiles))).alias("tile"), F.col("source").alias("a"), F.col("terms").alias("terms_a"), F.col("none").alias("none_a"))
    b = arrays.select("lang", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, tiles) - 1).cast("long"))).alias("tile"), F.col("source").alias("b"), F.col("terms").alias("terms_b"), F.col("none").alias("none_b"))
    both = a.join(b, ["lang", "block", "tile"]).filter("a < b and (size(terms_a) > 0 or size(terms_b) > 0)").select("lang", "a", "b", "terms_a", "terms_b", "none_a", "none_b")
    priced = both.mapInArrow(_price, "lang string, a string, b string, value long, listed long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("listed").alias("listed"))
    one, other = (groups.select("lang", F.col("source").alias(x), F.col("none").alias(f"none_{x}"), "v") for x in "ab")
    every = one.join(other.drop("v"), "lang").filter("a < b").join(priced, ["lang", "a", "b"], "left")
    absent = (F.col("v") - F.coalesce("listed", F.lit(0))) * apart(F.col("none_a"), F.col("none_b"))
    return every.select("lang", "a", "b", F.when(F.col("v") > 0, F.coalesce("value", F.lit(0)) + absent).otherwise(0).alias("value"))


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", documents: int = DOCUMENTS, listed: int = LISTED, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` for all other sources of the language, part ``term`` for the terms that a source uses most beyond its
    language."""
    bounded_batches(docs)
    scratch = Scratch(docs.sparkSession, "divergence")
    src = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(x) for c, x in ((lang, "lang"), (source, "source"))), F.col(text).cast("string").alias("text"))
    counts = src.mapInArrow(_count, "lang string, source string, term string, n long, df long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    term = Window.partitionBy("lang", "term")
    counts = counts.select("lang", "source", "term", "n", F.sum("df").over(term).alias("df"), F.sum("n").over(term).alias("n_term"), (F.min("source").over(term) == F.col("source")).alias("first"))
    kept = scratch.write(counts.filter((F.col("term") == "") | (F.col("df") >= documents)), "kept")
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.count_if(F.col("first") & (F.col("term") != "")).alias("v"))
    of_lang = Window.partitionBy("lang")
    groups = groups.select("lang", "source", "n_group", F.sum("n_group").over(of_lang).alias("n_lang"), F.sum("v").over(of_lang).alias("v"))
    groups = scratch.write(groups.withColumn("none", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("n_group"), F.col("v")))), "groups")

    pairs = _pairs(kept, groups, scratch, block, tile)
    pairs = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    p, q = share(F.col("n"), F.col("n_group"), F.col("v")), share(F.col("n_term"), F.col("n_lang"), F.col("v"))
    terms = kept.filter("n > 0").join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", apart(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= listed)
    return pairs.unionByName(terms)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT lang, source, id, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS n_lang FROM kept GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT x.lang, x.source, coalesce(v, 0) AS v, coalesce(n_lang, 0) AS n_lang, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN v ON v.lang = x.lang
      LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s ON s.lang = x.lang AND s.source = x.source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * g.v) AS BIGINT) AS p,
             CAST(1 + (1000000000::HUGEINT * (kept.n + 2)) // (g.n_lang + 2 * g.v) AS BIGINT) AS q
      FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) u)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
