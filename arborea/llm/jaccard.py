"""N-gram Jaccard join: exact links between near-duplicate documents.

Two documents link when the Jaccard similarity of their sets of five-word shingles reaches the threshold. The
join loses no link and never lists the pairs of a group:

1. Documents with equal sets are one *class*; only classes go on.
2. Shingles travel packed, dealt by hash, in batches of classes: eight bytes each, whatever the number of tiles. What comes back to
   a batch are its shingles that another batch or another class of it holds too, with their number. A class with fewer shared
   shingles than the threshold asks for has no partner and goes.
3. The classes that share a rare shingle of their prefix (the shingles of a class in order of rarity, as many
   as two linked classes can't both miss) form a *family*, through star edges and connected components.
4. A family is compared in *tiles* of bounded size: members in order of set size, so that only a band of sizes
   is looked at; a hashed bitmap of each member bounds the overlap from above by its bit counts; what passes
   is intersected exactly on sorted arrays. Members already connected aren't compared again. A tile returns
   spanning links alone.
5. A family of several blocks goes through two rounds. The first compares each block inside and with a few
   representatives of the family, and so connects near copies of one text at a cost in proportion to their number.
   For the second only shingles of prefixes that different components hold count: linked classes share one, so
   no link is lost. Classes with such a shingle form families anew, and in each the largest component is met
   with the rest, and the rest with itself, but never with itself.

Shingles that occur in very many documents of one batch are marked there (``HOT``) and only the mark travels
to the counting task, so a passage in a third of all rows isn't gathered anywhere.

Defined cases: a null or blank text has an empty set and links with nothing; a text of fewer than five words
has one shingle, the whole sequence; repeated rows each get a row of the result; a null doc_id stays null and
takes the component of its class; very long texts are read whole, in batches of one where they are long; ties of the threshold link; of
equally small ids the component has that id; other columns, whatever their names, are not looked at; an empty table gives an empty result.

Sets are told apart by a 64-bit hash and shingles by 48 bits of theirs, which nothing verifies: a pair of n and m shingles has a false common one
with a chance of about n * m / 2^48 (4e-9 for two documents of 1,000 words), and two of N sets the same hash with N * N / 2^65.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, components, mix, pack48, sub_batches, text_bytes, tiles_for, unpack48, window_hashes, word_hashes, words, bounded_batches

#: Classes of one batch from which a shingle counts as hot, and its rank in the order of rarity.
HOT_IN_BATCH, HOT = 64, (1 << 15) - 1
#: Text bytes whose shingles one counting task gathers; shingles of a batch; shingles in a tile's block.
TILE_BYTES, BATCH_TOKENS, BLOCK_TOKENS = 6_000_000, 600_000, 250_000
#: Shingles of a batch for each tile, and of a batch at most (memory); tiles from which they become larger.
SHARE, MOST_BATCH_TOKENS, MANY_TILES = 24, 4_000_000, 50_000
#: Partitions that the tiles are dealt to at most; beyond, a partition holds several tiles, one after another.
MOST_PARTITIONS = 20_000
#: Members of a family of several blocks that each of its blocks meets in the first round.
REPRESENTATIVES = 8
_LOW48 = np.uint64((1 << 48) - 1)


def shingle_sets(texts: list[str | None], n_words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    split = [words(t, lower=True) for t in texts]
    h = word_hashes([w for ws in split for w in ws])
    grams, out, at = window_hashes(h, n_words), [], 0
    for ws in split:
        n = len(ws)
        if n >= n_words:
            out.append(np.unique(grams[at : at + n - n_words + 1]))
        elif n:
            out.append(mix(window_hashes(h[at : at + n], n) + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def class_key(s: np.ndarray) -> int:
    """Identifies a set: a signed 64-bit hash of its sorted shingles."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _sized(batch: pa.RecordBatch, column: str):
    texts = batch.column(column).to_pylist()
    for a, b in sub_batches([len(t or "") for t in texts], 1_500_000):
        yield a, b, texts[a:b]


def _documents(n_words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.int64())])

    def run(batches):
        for batch in batches:
            for a, b, texts in _sized(batch, "text"):
                sets = shingle_sets(texts, n_words)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_key(s) if len(s) else None for s in sets], pa.int64())], schema=schema)

    return run, "doc_id long, n_shingles long, cls long"


_TILE = pa.schema([("tile", pa.int32()), ("batch", pa.int64()), *((c, pa.binary()) for c in ("tok", "who", "marks", "keys", "sizes", "hot", "hot_who"))])
_TILE_SQL = "tile int, batch long, tok binary, who binary, marks binary, keys binary, sizes binary, hot binary, hot_who binary"
_BACK = ["batch", "tok", "who", "keys", "sizes", "hot", "hot_who"]
_BACK_SQL = "batch long, tok binary, who binary, keys binary, sizes binary, hot binary, hot_who binary"


def batch_tokens(n_tiles: int) -> int:
    """Shingles of a batch: so many that a tile's share of it doesn't become a row for every few of them."""
    return max(BATCH_TOKENS, min(MOST_BATCH_TOKENS, SHARE * n_tiles))


def tile_bytes(total: int) -> int:
    """Text of a tile: more, up to four times, where there would be very many tiles."""
    return TILE_BYTES * min(4, max(1, round(total / (MANY_TILES * TILE_BYTES))))


def _tiles(n_words: int, n_tiles: int):
    """Deals the shingles of batches of classes to tiles, eight bytes each: six of the hash, two of the class' place in its
    batch. What places stand for, and the hot shingles, travel once a batch and pass through one tile."""

    def flush(held: dict[int, np.ndarray], number: int) -> pa.RecordBatch:
        keys = np.array(list(held), np.int64)
        sizes = np.array([len(s) for s in held.values()], np.int32)
        batch = xxhash.xxh3_64_intdigest(keys.tobytes(), seed=(TaskContext.get().partitionId() << 24) + number) - (1 << 63)
        tok = np.concatenate([s & _LOW48 for s in held.values()])
        who = np.repeat(np.arange(len(keys), dtype="<u2"), sizes)
        order = np.argsort(tok)
        tok, who = tok[order], who[order]
        first = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
        n = np.diff(np.r_[first, len(tok)])
        hot = np.repeat(n > HOT_IN_BATCH, n)
        marks = tok[first[n > HOT_IN_BATCH]]
        rows = [(batch % n_tiles, batch, None, None, None, keys.tobytes(), sizes.tobytes(), pack48(tok[hot]), who[hot].tobytes())]
        tile = (mix(marks) % np.uint64(n_tiles)).astype(np.int64)
        rows += [(t, batch, None, None, pack48(marks[tile == t]), None, None, None, None) for t in np.unique(tile).tolist()]
        tok, who = tok[~hot], who[~hot]
        tile = (mix(tok) % np.uint64(n_tiles)).astype(np.int64)
        order = np.argsort(tile, kind="stable")
        tile, tok, who = tile[order], tok[order], who[order]
        for a, b in zip(*_bounds(tile)):
            rows.append((int(tile[a]), batch, pack48(tok[a:b]), who[a:b].tobytes(), None, None, None, None, None))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _TILE)], schema=_TILE)

    most = batch_tokens(n_tiles)

    def run(batches):
        held, total, number = {}, 0, 0
        for batch in batches:
            for _, _, texts in _sized(batch, "text"):
                for s in shingle_sets(texts, n_words):
                    if len(s) and (key := class_key(s)) not in held:
                        held[key], total = s, total + len(s)
                if total >= most or len(held) > 50_000:
                    yield flush(held, number)
                    held, total, number = {}, 0, number + 1
        if held:
            yield flush(held, number)

    return run


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one tile: the shingles that two classes or more hold, with their rarity; one row a batch.

    Copies of a class in several batches count as several here; that only makes more shingles shared."""
    through = pdf[pdf["keys"].notna()]
    cold = pdf[pdf["tok"].notna()]
    marks = np.unique(np.concatenate([unpack48(x) for x in pdf["marks"].dropna()] or [np.empty(0, np.uint64)]))
    out = [(r.batch, None, None, r.keys, r.sizes, r.hot, r.hot_who) for r in through.itertuples()]
    if len(cold):
        parts = [unpack48(x) for x in cold["tok"]]
        tok, source = np.concatenate(parts), np.repeat(np.arange(len(parts), dtype=np.int32), [len(x) for x in parts])
        who = np.concatenate([np.frombuffer(x, "<u2") for x in cold["who"]])
        order = np.argsort(tok)
        tok = tok[order]
        first = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
        n = np.diff(np.r_[first, len(tok)])
        rank = np.minimum(n, HOT - 1)
        if len(marks):
            rank[np.isin(tok[first], marks)] = HOT
        rank = np.repeat(rank, n)
        some = rank > 1
        order, ranked = order[some], (rank[some].astype(np.uint64) << np.uint64(48)) | tok[some]
        at = np.argsort(source[order], kind="stable")
        order, ranked = order[at], ranked[at]
        names = cold["batch"].to_numpy()
        for a, b in zip(*_bounds(source[order])):
            out.append((names[source[order[a]]], ranked[a:b].tobytes(), who[order[a:b]].tobytes(), None, None, None, None))
    return pd.DataFrame(out, columns=_BACK)


def _members(percent: int):
    """Of one batch, the classes that may have a partner: their shared shingles and those of the prefix, in order of rarity."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf["keys"].notna()].iloc[0]
        keys, n = np.frombuffer(head["keys"], np.int64), np.frombuffer(head["sizes"], np.int32).astype(np.int64)
        hot = unpack48(head["hot"]) | np.uint64(HOT << 48)
        ranked = np.concatenate([np.frombuffer(b"".join(pdf["tok"].dropna()), np.uint64), hot])
        owner = np.concatenate([np.frombuffer(b"".join(pdf["who"].dropna()), "<u2"), np.frombuffer(head["hot_who"], "<u2")])
        need = -(-percent * n // 100)
        keep = (np.bincount(owner, minlength=len(keys)) >= need)[owner]
        ranked, owner = ranked[keep], owner[keep]
        order = np.lexsort((ranked, owner))
        ranked, owner = ranked[order], owner[order]
        rows = []
        for a, b in zip(*_bounds(owner)):
            i, own = owner[a], ranked[a:b]
            rows.append((keys[i], n[i], np.sort(own & _LOW48).tobytes(), (own[: len(own) - need[i] + 1] & _LOW48).astype(np.int64)))
        return pd.DataFrame(rows, columns=["cls", "n", "shared", "prefix"])

    return run


def _bounds(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, np.int64)
    return first, np.r_[first[1:], len(owner)] if len(first) else first


def _bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for row, s in zip(out, sets):
        at = mix(s) % np.uint64(bits)
        np.bitwise_or.at(row, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def spanning_links(keys: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all that is connected among the members of a tile.

    sizes: of the whole sets; sets: sorted arrays of the shingles that a partner may hold; known: components that are already connected."""
    order = np.argsort(sizes, kind="stable")
    keys, sizes, sets = keys[order], sizes[order], [sets[i] for i in order]
    held = np.array([len(s) for s in sets])
    maps = _bitmaps(sets, int(min(1 << 14, max(256, 1 << int(2 * np.median(held)).bit_length()))))
    group, links = np.arange(len(keys)) if known is None else np.unique(known[order], return_inverse=True)[1], []
    starts = np.searchsorted(sizes * 100, sizes * percent)  # smaller sets can't reach the threshold
    for i in range(1, len(keys)):
        j = np.arange(starts[i], i)
        j = j[group[j] != group[i]]
        if len(j):
            mine, theirs = maps[i], maps[j]
            bound = np.minimum(held[i] - np.bitwise_count(mine & ~theirs).sum(1, dtype=np.int64), held[j] - np.bitwise_count(theirs & ~mine).sum(1, dtype=np.int64))
            j = j[bound * (100 + percent) >= percent * (sizes[i] + sizes[j])]
        # members of large groups first: one link settles the whole group
        while len(j):
            j = j[group[j] != group[i]]
            if not len(j):
                break
            k, j = j[-1], j[:-1]
            both = np.searchsorted(sets[i], sets[k])
            overlap = int((sets[i][np.minimum(both, len(sets[i]) - 1)] == sets[k]).sum())
            if 100 * overlap >= percent * (sizes[i] + sizes[k] - overlap):
                links.append((int(keys[i]), int(keys[k])))
                group[group == group[i]] = group[k]
    return links


def _compare(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, rows in pdf.groupby(["root", "i", "j"], sort=False):
            if len(rows) > 1:
                out += spanning_links(rows["cls"].to_numpy(), rows["n"].to_numpy(), [np.frombuffer(x, np.uint64) for x in rows["shared"]], percent, rows["comp"].to_numpy())
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _families(posted: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, root of the classes that share a shingle of ``posted`` (cls, token), directly or through others."""
    hubs = posted.groupBy("token").agg(F.min("cls").alias("hub"), F.max("cls").alias("last")).filter("hub <> last").select("token", "hub")
    stars = posted.join(hubs, "token").filter("cls <> hub").select(F.col("cls").alias("a"), F.col("hub").alias("b")).distinct()
    return components(stars, scratch, name)


def _blocks(size):
    return F.ceil(F.sum(size) / F.lit(8 * BLOCK_TOKENS)).cast("int")


def _links(dealt: DataFrame, percent: int) -> DataFrame:
    """Links of the tiles of ``dealt`` (root, i, j, small, comp, cls, n, shared): small tiles share groups, any other has its own."""
    total = dealt.filter("small").agg(F.sum(F.length("shared"))).first()[0]
    bins = F.pmod(F.xxhash64("root"), F.lit(tiles_for(int(total or 0), 8 * BLOCK_TOKENS))).cast("int")
    own = F.when(~F.col("small"), F.struct("root", "i", "j"))
    dealt = dealt.select("root", "i", "j", "comp", "cls", "n", "shared", F.when(F.col("small"), bins).alias("bin"), own.alias("own"))
    return dealt.groupBy("bin", "own").applyInPandas(_compare(percent), "a long, b long")


def _first_round(inside: DataFrame) -> DataFrame:
    """Tiles of whole families of one block; of larger ones each block with the family's representatives."""
    blocks = inside.groupBy("root").agg(_blocks("size").alias("nb"), *[F.min(F.struct(F.xxhash64("cls", F.lit(i)).alias("h"), "cls"))["cls"].alias(f"r{i}") for i in range(REPRESENTATIVES)])
    blocks = blocks.select("root", "nb", F.array(*[f"r{i}" for i in range(REPRESENTATIVES)]).alias("reps"))
    dealt = inside.join(blocks, "root").withColumn("small", F.col("nb") == 1)
    every, own = F.sequence(F.lit(0), F.col("nb") - 1), F.array(F.pmod(F.xxhash64("cls"), "nb").cast("int"))
    dealt = dealt.withColumn("i", F.explode(F.when(~F.col("small") & F.array_contains("reps", F.col("cls")), every).otherwise(own)))
    return dealt.select("root", "i", F.col("i").alias("j"), "small", F.col("cls").alias("comp"), "cls", "n", "shared")


def _second_round(inside: DataFrame) -> DataFrame:
    """Tiles in which the largest component of a family (``most``) meets all others, and those meet each other."""
    most = inside.groupBy("root", "comp").agg(F.sum("size").alias("size")).groupBy("root").agg(F.max_by("comp", F.struct("size", "comp")).alias("most"))
    sided = inside.join(most, "root").withColumn("large", F.col("comp") == F.col("most"))
    # a family has two components at least, so both sides have members
    blocks = sided.groupBy("root").agg(*[_blocks(F.when(F.col("large") == side, F.col("size"))).alias(name) for side, name in ((True, "nl"), (False, "nr"))])
    dealt = sided.join(blocks, "root").withColumn("small", (F.col("nl") == 1) & (F.col("nr") == 1))
    at = F.pmod(F.xxhash64("cls"), F.when(F.col("large"), F.col("nl")).otherwise(F.col("nr"))).cast("int")
    dealt = dealt.withColumn("at", at)
    tile = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    # i counts blocks of the largest component; -1 - i those of the rest where they meet each other
    met = F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda o: tile(F.col("at"), o))
    meets = F.transform(F.sequence(F.lit(0), F.col("nl") - 1), lambda o: tile(o, F.col("at")))
    others = F.filter(F.sequence(F.lit(0), F.col("nr") - 1), lambda o: o != F.col("at"))
    rest = F.transform(others, lambda o: tile(-1 - F.least(F.col("at"), o), F.greatest(F.col("at"), o)))
    dealt = dealt.withColumn("tile", F.explode(F.when(F.col("large"), met).otherwise(F.concat(meets, rest))))
    return dealt.select("root", "tile.i", "tile.j", "small", "comp", "cls", "n", "shared")


def jaccard_components(docs: DataFrame, n_words: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for every row of ``docs``."""
    spark: SparkSession = docs.sparkSession
    bounded_batches(docs)
    scratch = Scratch(spark, "jaccard")
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    run, schema = _documents(n_words)
    each = scratch.write(src.mapInArrow(run, schema), "documents")
    total = text_bytes(src)
    n_tiles = tiles_for(total, tile_bytes(total))
    tiles = src.select("text").mapInArrow(_tiles(n_words, n_tiles), _TILE_SQL).repartition(min(n_tiles, MOST_PARTITIONS), "tile")
    shared = tiles.groupBy("tile").applyInPandas(_count, _BACK_SQL)
    members = scratch.write(shared.groupBy("batch").applyInPandas(_members(percent), "cls long, n long, shared binary, prefix array<long>"), "members")

    posted = members.select("cls", F.explode("prefix").alias("token"))
    family = _families(posted, scratch, "family").withColumnRenamed("node", "cls")
    inside = members.join(family, "cls").dropDuplicates(["cls"])  # a class may come from several batches
    inside = scratch.write(inside.select("cls", "root", "n", "shared", "prefix", F.length("shared").alias("size")), "inside")
    sized = inside.drop("prefix")
    links = scratch.write(_links(_first_round(sized), percent), "links")
    linked = components(links, scratch, "linked")

    large = sized.groupBy("root").agg(_blocks("size").alias("nb")).filter("nb > 1").select("root")
    comp = sized.select("cls", "root").join(large, "root", "left_semi").select("cls").join(linked.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("root", "cls").alias("comp"))
    comp = scratch.write(comp, "comp")
    if not comp.isEmpty():
        left = inside.select("cls", F.explode("prefix").alias("token")).join(comp, "cls")
        mixed = left.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("token")
        family = _families(left.join(mixed, "token").select("cls", "token"), scratch, "family-2").withColumnRenamed("node", "cls")
        more = scratch.write(_links(_second_round(sized.drop("root").join(family, "cls").join(comp, "cls")), percent), "links-2")
        if not more.isEmpty():
            linked = components(links.unionByName(more), scratch, "linked-2")

    classes = each.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("low"))
    rooted = classes.join(linked.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lows, "root").select("cls", "component_id")
    return each.join(named, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM documents),
w AS (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE regexp_split_to_array(text, '[\x20\x09-\x0D]+') END AS ws FROM t),
sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS x FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS d, doc_id AS r FROM sets UNION SELECT reach.d, b FROM reach JOIN both_ways ON r = a)
SELECT d AS doc_id, CAST(any_value(len(s)) AS BIGINT) AS n_shingles, min(r) AS component_id FROM reach JOIN sets ON d = doc_id GROUP BY d
"""
