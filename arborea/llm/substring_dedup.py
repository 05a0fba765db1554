"""Substring dedup with difference-cover anchors.

Words covered by a window of ``WINDOW`` words that also starts in a document with a smaller doc_id go.

Documents are dealt to buckets of bounded size by a hash of the row, once; every step reads that exchange, and what travels names a
document by its bucket and its place there.

1. *Anchors*: in each document, windows of ``WINDOW - PERIOD + 1`` words are hashed at the positions whose remainder
   modulo ``PERIOD`` lies in ``COVER``. Every remainder is a difference of two members of the cover, so two
   documents that share ``WINDOW`` words share an anchor that both have hashed, however they are aligned.
2. Anchors are dealt by hash; those that two documents or more hold come back to their buckets. An anchor that very many documents
   of one bucket hold (``HOT``) comes back without being gathered.
3. *Extension*: only windows around such anchors are hashed in full and dealt by hash; a window that a smaller
   doc_id holds too comes back. A bucket of documents settles its own repeats first and sends on only the
   smallest document's window, so a passage in very many documents costs one entry a bucket.
4. Documents meet the windows found in them and drop the covered words.

Anchors are compared by 48-bit hashes, which only select; windows by 64-bit hashes of 13 word hashes of 64 bits: among n windows a
wrong match has a chance of about n * n / 2^65.

Defined cases: a null or blank text has no words; a text with fewer words than the window loses none; a null doc_id
comes after every other; rows with one doc_id never remove each other's words; very long texts are read whole, one bucket's in memory at
a time; other columns, whatever their names, are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import mix, pack48, sub_batches, text_bytes, tiles_for, unpack48, window_hashes, word_hashes, words, bounded_batches

#: A perfect difference set: {a - b mod 7} is all of 0..6.
WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
#: Documents of one bucket from which an anchor counts as shared without being counted; text bytes of a bucket and of a tile.
HOT, BUCKET_BYTES, TILE_BYTES = 64, 6_000_000, 12_000_000
#: Text bytes from which buckets and tiles become larger.
MANY_BYTES = 60_000_000_000
#: Partitions at most; beyond, a partition holds several tiles or buckets, one after another.
MOST_PARTITIONS = 20_000
_LAST = (1 << 63) - 1


def _runs(sorted_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    first = np.flatnonzero(np.r_[True, sorted_hashes[1:] != sorted_hashes[:-1]]) if len(sorted_hashes) else np.empty(0, np.int64)
    return first, np.diff(np.r_[first, len(sorted_hashes)])


def _planes(x: np.ndarray) -> bytes:
    """Byte planes of 32-bit values, so that the shuffle's compression meets runs."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _steps(place: np.ndarray, pos: np.ndarray) -> bytes:
    """Positions as steps within each document."""
    return _planes(np.where(np.r_[True, place[1:] != place[:-1]], pos, np.diff(pos, prepend=0)) if len(pos) else pos)


def _unsteps(place: np.ndarray, raw: bytes) -> np.ndarray:
    steps = _unplanes(raw)
    if not len(steps):
        return steps.astype(np.int32)
    total = steps.cumsum()
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return (total - np.repeat(total[first] - steps[first], np.diff(np.r_[first, len(steps)]))).astype(np.int32)


_NAMES = ["tile", "bucket", "hash", "who", "pos", "ords", "marks"]
_TILE_SQL = "tile int, bucket int, hash binary, who binary, pos binary, ords binary, marks binary"
_FOUND = "bucket int, who binary, pos binary"


def _bounds(sorted_: np.ndarray) -> zip:
    first, n = _runs(sorted_)
    return zip(first, first + n)


def _dealt(bucket: int, n_tiles: int, h, who, pos, packed, known, marks, ords=None) -> pd.DataFrame:
    """One row a tile of the hashes of a bucket, in the order of documents and positions. known: (who, pos) that only pass through."""
    tile = (mix(h) % np.uint64(n_tiles)).astype(np.int64)
    order = np.argsort(tile, kind="stable")
    tile, h, who, pos = tile[order], h[order], who[order], pos[order]
    rows = [(int(tile[a]), bucket, packed(h[a:b]), _planes(who[a:b]), _steps(who[a:b], pos[a:b]), None if ords is None else _eights(ords[order[a:b]]), None) for a, b in _bounds(tile)]
    if len(known[0]):
        rows.append((bucket % n_tiles, bucket, None, _planes(known[0]), _steps(*known), None, None))
    tile = (mix(marks) % np.uint64(n_tiles)).astype(np.int64)
    rows += [(t, bucket, None, None, None, None, pack48(marks[tile == t])) for t in np.unique(tile).tolist()]
    return pd.DataFrame(rows, columns=_NAMES)


def _eights(x: np.ndarray) -> bytes:
    """Byte planes of 64-bit values."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _uneights(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _placed(docs: pd.DataFrame) -> pd.DataFrame:
    """The documents of a bucket in the order that gives them their places."""
    return docs.sort_values(["ord", "rid"], kind="stable", ignore_index=True)


def _anchors(n_tiles: int):
    low48, width = np.uint64((1 << 48) - 1), WINDOW - PERIOD + 1

    def run(docs: pd.DataFrame) -> pd.DataFrame:
        docs = _placed(docs)
        texts, hashes, who, pos = docs["text"].tolist(), [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a, b in sub_batches([len(t or "") for t in texts], 3_000_000):
            split = [words(t, lower=False) for t in texts[a:b]]
            h, at = window_hashes(word_hashes([w for ws in split for w in ws]), width), 0
            for i, ws in enumerate(split, a):
                if len(ws) >= WINDOW:
                    p = np.arange(len(ws) - width + 1)
                    p = p[np.isin(p % PERIOD, COVER)]
                    hashes.append(h[at + p] & low48)
                    who.append(np.full(len(p), i))
                    pos.append(p)
                at += len(ws)
        h, who, pos = (np.concatenate(x) for x in (hashes, who, pos))
        order = np.argsort(h, kind="stable")
        first, n = _runs(h[order])
        fresh = np.r_[True, (h[order][1:] != h[order][:-1]) | (who[order][1:] != who[order][:-1])][: len(h)]  # who rises within a run
        hot, marks = np.zeros(len(h), bool), np.empty(0, np.uint64)
        if len(h):
            many = np.add.reduceat(fresh.astype(np.int64), first) > HOT
            hot[order], marks = np.repeat(many, n), h[order][first[many]]
        return _dealt(int(docs["bucket"].iloc[0]), n_tiles, h[~hot], who[~hot], pos[~hot], pack48, (who[hot], pos[hot]), marks)

    return run


def _gathered(pdf: pd.DataFrame, decode):
    """The hashes of a tile, each with the number of its row, its place and position; what only passes through; the marks."""
    rows, through = pdf[pdf["hash"].notna()], pdf[pdf["hash"].isna() & pdf["who"].notna()]
    none = np.empty(0, np.int64)
    parts = [decode(x) for x in rows["hash"]]
    who = [_unplanes(x) for x in rows["who"]]
    pos = [_unsteps(w, x) for w, x in zip(who, rows["pos"])]
    row = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    out = [(r.bucket, r.who, r.pos) for r in through.itertuples()]
    marks = np.unique(np.concatenate([unpack48(x) for x in pdf["marks"].dropna()] or [np.empty(0, np.uint64)]))
    return rows, np.concatenate(parts or [np.empty(0, np.uint64)]), row, np.concatenate(who or [none]), np.concatenate(pos or [none]), out, marks


def _back(rows: pd.DataFrame, keep: np.ndarray, row, who, pos, out: list) -> pd.DataFrame:
    """One row a bucket of what is kept; rows of a tile are in order of place and position already."""
    buckets, row, who, pos = rows["bucket"].to_numpy(), row[keep], who[keep], pos[keep]
    out += [(buckets[row[a]], _planes(who[a:b]), _steps(who[a:b], pos[a:b])) for a, b in _bounds(row)]
    return pd.DataFrame(out, columns=["bucket", "who", "pos"])


def _shared_anchors(pdf: pd.DataFrame) -> pd.DataFrame:
    rows, h, row, who, pos, out, marks = _gathered(pdf, unpack48)
    keep = np.zeros(len(h), bool)
    if len(h):
        order = np.argsort(h, kind="stable")
        first, n = _runs(h[order])
        doc = (row[order] << 32) | who[order]
        keep[order] = np.repeat((np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)) | np.isin(h[order][first], marks), n)
    return _back(rows, keep, row, who, pos, out)


def _positions(found: pd.DataFrame) -> dict[int, np.ndarray]:
    """Positions by the place of each document of a bucket."""
    if not len(found):
        return {}
    who = [_unplanes(x) for x in found["who"]]
    pos = np.concatenate([_unsteps(w, x) for w, x in zip(who, found["pos"])])
    who = np.concatenate(who)
    order = np.argsort(who, kind="stable")
    who, pos = who[order], pos[order]
    return {int(who[a]): pos[a:b] for a, b in _bounds(who)}


def _windows(n_tiles: int):
    """Of one bucket of documents, the windows around its shared anchors, dealt by hash."""

    def run(docs: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        near_of, hashes, who, pos = _positions(anchors), [], [], []
        docs = _placed(docs)
        for i in sorted(near_of):
            h = window_hashes(word_hashes(words(docs["text"].iat[i], lower=False)), WINDOW)
            near = np.zeros(len(h) + WINDOW, bool)
            for back in range(PERIOD):
                near[np.maximum(near_of[i] - back, 0)] = True
            starts = np.flatnonzero(near[: len(h)])
            hashes.append(h[starts])
            who.append(np.full(len(starts), i))
            pos.append(starts)
        if not hashes:
            return pd.DataFrame(columns=_NAMES)
        h, who, pos = (np.concatenate(x) for x in (hashes, who, pos))
        # a bucket settles its own repeats: what a smaller document of it holds needs no other
        ords = docs["ord"].to_numpy()[who]
        order = np.lexsort((ords, h))
        first, n = _runs(h[order])
        later = np.zeros(len(h), bool)
        later[order] = ords[order] > np.repeat(ords[order][first], n)
        one = ~later
        return _dealt(int(docs["bucket"].iloc[0]), n_tiles, h[one], who[one], pos[one], lambda x: x.tobytes(), (who[later], pos[later]), np.empty(0, np.uint64), ords[one])

    return run


def _repeated_windows(pdf: pd.DataFrame) -> pd.DataFrame:
    rows, h, row, who, pos, out, _ = _gathered(pdf, lambda raw: np.frombuffer(raw, np.uint64))
    keep = np.zeros(len(h), bool)
    if len(h):
        ords = np.concatenate([_uneights(x) for x in rows["ords"]])
        order = np.argsort(h, kind="stable")
        first, n = _runs(h[order])
        keep[order] = ords[order] > np.repeat(np.minimum.reduceat(ords[order], first), n)
    return _back(rows, keep, row, who, pos, out)


def covered(n_words: int, starts: np.ndarray) -> np.ndarray:
    """Which words lie in a window that begins at one of ``starts``."""
    edge = np.zeros(n_words + WINDOW + 1, np.int32)
    starts = np.unique(starts)
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    return edge.cumsum()[:n_words] > 0


def _result(with_text: bool):
    names = ["doc_id", "n_words", "n_removed", "kept_text" if with_text else "kept_sha256"]

    def run(docs: pd.DataFrame, repeats: pd.DataFrame) -> pd.DataFrame:
        found, rows = _positions(repeats), []
        docs = _placed(docs)
        for i, (o, t) in enumerate(zip(docs["ord"].tolist(), docs["text"].tolist())):
            ws, gone = words(t, lower=False), 0
            n = len(ws)
            if i in found:
                out = covered(n, found[i])
                ws, gone = [w for w, x in zip(ws, out) if not x], int(out.sum())
            kept = b" ".join(ws)
            rows.append((None if o == _LAST else o, n, gone, kept.decode("utf-8", "surrogatepass") if with_text else hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return run, f"doc_id long, n_words long, n_removed long, {names[3]} string"


def dealt_to(total: int) -> tuple[int, int]:
    """Tiles and buckets for so many bytes of text. A bucket deals a row to each tile, so both become larger, up to four times, where there would be very
    many of them; else a row would hold a few anchors only."""
    size = min(4.0, max(1.0, (total / MANY_BYTES) ** 0.5))
    return tiles_for(total, int(TILE_BYTES * size)), tiles_for(total, int(BUCKET_BYTES * size))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the kept words joined by one space) or its kept_sha256, for every row."""
    bounded_batches(docs)
    total = text_bytes(docs, text)
    n_tiles, n_buckets = dealt_to(total)
    src = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("ord"), F.col(text).alias("text")).withColumn("rid", F.xxhash64("ord", "text"))
    whole = src.withColumn("bucket", F.pmod("rid", F.lit(n_buckets)).cast("int")).repartition(min(n_buckets, MOST_PARTITIONS), "bucket")
    tiled = lambda df, run: df.repartition(min(n_tiles, MOST_PARTITIONS), "tile").groupBy("tile").applyInPandas(run, _FOUND)
    anchors = tiled(whole.groupBy("bucket").applyInPandas(_anchors(n_tiles), _TILE_SQL), _shared_anchors)
    windows = tiled(whole.groupBy("bucket").cogroup(anchors.groupBy("bucket")).applyInPandas(_windows(n_tiles), _TILE_SQL), _repeated_windows)
    run, schema = _result(with_text)
    return whole.groupBy("bucket").cogroup(windows.groupBy("bucket")).applyInPandas(run, schema)


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, CASE WHEN trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN []
                               ELSE regexp_split_to_array(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+') END AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS h FROM starts),
firsts AS (SELECT h, min(doc_id) AS low FROM windows GROUP BY h),
hit AS (SELECT doc_id, i FROM windows JOIN firsts USING (h) WHERE doc_id > low),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM hit),
gones AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(ws, lambda x, k: NOT coalesce(list_contains(ps, k), false)), ' ')) AS kept_sha256
FROM w LEFT JOIN gones USING (doc_id)
"""
