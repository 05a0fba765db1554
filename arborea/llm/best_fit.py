"""Best-fit decreasing packing of a whole table, whatever its size.

Token counts are small integers, so what best-fit decreasing does depends only on how many pieces there are of each length: at most
``SIZE`` numbers. The pieces of one length are placed as a run: a segment tree over the remaining capacities finds the tightest
capacity that still holds the length, and all open bins of that capacity take as many of its pieces as go in, as they would one
after another. A run of bins halves its capacity at least each time it is met, and a length opens three ranges at most, so
the plan has under 70,000 rows for any table of 2048-token sequences. It is one best-fit decreasing of all pieces, not one of each partition.

Spark does the rest: tasks encode whole texts and write one short row a piece; pieces get their place among those of equal length from sums
over the partitions that wrote them (no length is gathered in one task), and look their bin up in the plan by bisection.

Defined cases: a null or empty text has the end token alone; a null doc_id stays null; repeated rows are packed each; a very long text is
cut, its first piece the shorter one; of bins with equal room any is taken; special tokens are found in the raw text, as the file asks;
other columns, whatever their names, are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import byte_alphabet
from .common import Scratch, bounded_batches

SIZE, END = 2048, 0
#: Chunks in a worker's cache, and the characters of a text that are split at a time.
CACHE_CHUNKS, SLICE = 400_000, 1 << 20
#: How the byte-level files cut a text before the merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space that may stand inside a run of white space: no cut before it.
_INSIDE = re.compile(r"\s (?!\S)")
_CUT = re.compile(r"(?<=\S) (?=\S)")


class ByteEncoder:
    """A byte-level BPE file, encoded chunk by chunk: a text may be cut before any space that has no white space on one side."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model, before = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or model["end_of_word_suffix"]:
            raise ValueError(f"{path}: not a byte-level BPE without a normalizer")
        byte_of = {c: i for i, c in enumerate(byte_alphabet())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in model["vocab"].items() if t not in self.special}
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        made = [model["vocab"][a + b] for a, b in merges]
        if made != sorted(made):
            raise ValueError(f"{path}: ids do not follow the merges")
        self.plain = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.chunks = _Chunks(self._whole)

    def _whole(self, text: str) -> bytes:
        return array("I", self.plain(text)).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.split and len(parts := self.split.split(text)) > 1:
            return b"".join(self.special[x].to_bytes(4, "little") if i % 2 else self.encode(x) for i, x in enumerate(parts))
        out, at = [], 0
        while at < len(text):
            end = len(text)
            if end - at > SLICE and (found := _CUT.search(text, at + SLICE)):
                end = found.start()
            part = text[at:end]
            if _INSIDE.search(part):
                out.append(self._whole(part))
            else:
                first, *rest = part.split(" ")
                out.append(self._whole(first))
                out.extend(map(self.chunks.__getitem__, rest))
            at = end
        return b"".join(out)


#: What is a piece of its own after a letter of ASCII.
_ENDS = frozenset(".,;:!?")


class _Chunks(dict):
    """Ids of a space and what follows it up to the next; starts anew when it is full. A word and the mark after it are looked up apart."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.marks = {x: encode(x) for x in _ENDS}

    def __missing__(self, chunk: str) -> bytes:
        if chunk[-1:] in _ENDS and chunk[:-1].isascii() and chunk[-2:-1].isalpha():
            found = self[chunk[:-1]] + self.marks[chunk[-1]]
        else:
            found = self.encode(" " + chunk)
        if len(chunk) < 64:
            if len(self) >= CACHE_CHUNKS:
                self.clear()
            self[chunk] = found
        return found


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


class Rooms:
    """Segment tree over remaining capacities: a leaf counts the ranges of open bins with that much room."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.open[at] += by
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The smallest room of at least ``length``; two walks of logarithmic length."""
        at = length + self.leaves
        if not self.open[at]:
            while at > 1 and (at & 1 or not self.open[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit_plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces a bin, first bin, offset) of every run, by best-fit decreasing over pieces counted by length.

    The pieces of a length from ``first rank`` up to the next run's go into consecutive bins, ``pieces a bin`` in each, from ``offset`` on."""
    rooms, ranges, runs, bins = Rooms(size), {}, [], 0

    def leave(room: int, first: int, number: int) -> None:
        if room and number:
            ranges.setdefault(room, []).append((first, number))
            rooms.add(room, 1)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                room, first, number = size, bins, -(-left // (size // length))
                bins += number
            else:
                first, number = ranges[room].pop()
                rooms.add(room, -1)
            each = room // length
            full = min(number, left // each)
            if full:
                runs.append((length, rank, each, first, size - room))
                leave(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < number and left:
                runs.append((length, rank, left, first + full, size - room))
                leave(room - left * length, first + full, 1)
                full, left = full + 1, 0
            leave(room, first + full, number - full)
    return runs


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int64()), ("serial", pa.int64())])
_PIECES_SQL = "doc_id long, piece long, start long, length long, ids_crc32 long, part long, serial long"


def _cut(path: str, size: int, end: int):
    tail = end.to_bytes(4, "little")

    def run(batches):
        e, part, seen = encoder(path), TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = memoryview(e.encode(text.as_py()) + tail)
                n, at = len(ids) // 4, 0
                for piece in range(-(-n // size)):
                    stop = n - size * (-(-n // size) - piece - 1)
                    rows.append((doc_id, piece, at, stop - at, zlib.crc32(ids[4 * at : 4 * stop]), part, seen[stop - at]))
                    seen[stop - at] += 1
                    at = stop
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_PIECES), _PIECES)], schema=_PIECES)

    return run


def _place(runs: list[tuple[int, int, int, int, int]]):
    plan = np.array(sorted(runs), np.int64).reshape(-1, 5)
    keys = plan[:, 0] << 44 | plan[:, 1]

    def run(batches):
        for b in batches:
            length, rank = (b.column(x).to_numpy() for x in ("length", "rank"))
            _, since, each, first, offset = plan[np.searchsorted(keys, length << 44 | rank, "right") - 1].T
            at = rank - since
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(first + at // each), pa.array(offset + at % each * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_best_fit(docs: DataFrame, path: str, size: int = SIZE, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of at most ``size`` tokens."""
    bounded_batches(docs)
    scratch = Scratch(docs.sparkSession, "best-fit")
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = scratch.write(src.mapInArrow(_cut(path, size, end), _PIECES_SQL), "pieces")
    counts = scratch.write(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    # at most one number for each length
    runs = best_fit_plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("serial")).alias("rank"))
    return ranked.mapInArrow(_place(runs), "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumn("piece", F.col("piece").cast("int"))
