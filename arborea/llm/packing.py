"""Packing of token sequences with bounded space.

Each partition keeps at most ``OPEN`` windows open. A document's tokens fill whole windows first; the rest goes to the
open window where it fits best. When it fits nowhere and no further window may be opened, the fullest is topped
up with as many of its tokens as fit and emitted, and what remains is placed again. The windows still open at
the end of a partition are leftovers: those of ``MERGE`` partitions at a time are merged whole, the largest first,
each into the fullest window where it fits.

Defined cases: a null or empty text has the end token alone; a null doc_id stays null; repeated rows are packed each; a very long text fills
windows of its own; of equally full windows the oldest is taken; other columns, whatever their names, are not looked at; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .bpe import character_classes, vocabulary
from .common import Scratch, bounded_batches

SIZE, OPEN, MERGE, END = 2048, 16, 64, 1
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("window", pa.int64()), ("offset", pa.int64()), ("left", pa.bool_())])
_PIECES_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, left boolean"


class Packer:
    """Places (document, first token, number of tokens) online; a closed window is a list of them."""

    def __init__(self, size: int = SIZE, most: int = OPEN):
        self.size, self.most = size, most
        self.open: list[list] = []  # [filled, pieces]

    def add(self, doc, n: int):
        """Yields the windows that close."""
        at = 0
        while n - at >= self.size:
            yield [(doc, at, self.size, 0)]
            at += self.size
        while at < n:
            rest = n - at
            fits = [w for w in self.open if w[0] + rest <= self.size]
            if fits:
                w = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.most:
                self.open.append(w := [0, []])
            else:
                w = max(self.open, key=lambda w: w[0])
                rest = self.size - w[0]
            w[1].append((doc, at, rest, w[0]))
            w[0] += rest
            at += rest
            if w[0] == self.size:
                self.open.remove(w)
                yield w[1]

    def leftovers(self):
        return [w[1] for w in self.open]


def _pack(path: str):
    classes = character_classes()

    def run(batches):
        v, packer, held = vocabulary(path, classes), Packer(), {}
        base, count, rows = TaskContext.get().partitionId() << 32, 0, []

        def close(pieces, left):
            nonlocal count
            for key, at, n, offset in pieces:
                doc_id, ids, parts = held[key]
                rows.append((doc_id, at, n, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + n)]), len(ids) // 4, base + count, offset, left))
                held[key][2] -= n
                if not held[key][2]:
                    del held[key]  # all its tokens are placed and emitted
            count += 1

        serial = 0
        for batch in batches:
            for doc_id, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = v.encode(t.as_py()) + END.to_bytes(4, "little")
                held[serial] = [doc_id, ids, len(ids) // 4]
                for pieces in packer.add(serial, len(ids) // 4):
                    close(pieces, False)
                serial += 1
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)
                rows.clear()
        for pieces in packer.leftovers():
            close(pieces, True)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which window a leftover joins, and where it then begins. At most OPEN * MERGE rows."""
    out, windows = [], []  # window: [filled, id]
    for r in pdf.sort_values(["filled", "window"], ascending=[False, True]).itertuples():
        fits = [w for w in windows if w[0] + r.filled <= SIZE]
        if fits:
            w = max(fits, key=lambda w: w[0])
        else:
            windows.append(w := [0, r.window])
        out.append((r.window, w[1], w[0]))
        w[0] += r.filled
    return pd.DataFrame(out, columns=["window", "sequence_id", "base"], dtype="int64")


def pack_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece."""
    bounded_batches(docs)
    scratch = Scratch(docs.sparkSession, "packing")
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = scratch.write(src.mapInArrow(_pack(path), _PIECES_SQL), "pieces")
    left = pieces.filter("left").groupBy("window").agg(F.sum("length").alias("filled")).withColumn("bin", F.shiftright("window", 32) / MERGE)
    merged = left.withColumn("bin", F.floor("bin")).groupBy("bin").applyInPandas(_merge, "window long, sequence_id long, base long")
    return pieces.join(merged, "window", "left").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.coalesce("sequence_id", "window").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))
