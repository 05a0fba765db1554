"""Phrase collocations: word sequences that occur more often than their parts explain.

All counts come from one table of longest windows. A window is a word with up to four that follow it in its piece, padded with empty words. Windows
are counted once, and Spark's ROLLUP over their columns sums the shorter prefixes: the count of a phrase is the sum over the windows that
begin with it, so no shorter n-grams are ever exploded.

Only phrases of ``LEAST`` occurrences matter, and every part of such a phrase is as frequent. Two passes therefore add up, in cells of a hashed
table of fixed size, one byte each and no higher than ``LEAST``, first words and pairs of words, then the longer phrases all of whose pairs fell
into frequent cells: what falls into a cell below ``LEAST`` is infrequent for certain. The last pass ends a window where its words so far
become infrequent (it begins no frequent longer phrase) and gives infrequent first words one common window without a word, which is counted in n
alone. The cells decide only how many windows are shuffled, never a result. There are ``WORDS_A_CELL`` words to a cell up to ``MOST_CELLS``; far
beyond, the cells fill up and more windows travel. Windows of each length have a ROLLUP of their own, over the columns that they fill.

Defined cases: a null text counts as empty, a null language as ``und``; repeated rows count each; a very long text is read in slices that
end where pieces end; ties go to the smallest cut and, in the ranking, to the more frequent phrase and then the
smaller one in UTF-8; other columns, whatever their names, are not looked at; doc_id is not needed; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch, bounded_batches, mix, sub_batches, text_bytes

#: Occurrences of a phrase that counts, words of the longest one, phrases listed for a language.
LEAST, LONGEST, LISTED = 100, 5, 2_000
#: Cells of the hashed table (powers of two, eight or more a part) and the parts in which it travels; MOST_CELLS bounds a task's memory (bytes) and what is broadcast (an eighth).
WORDS_A_CELL, LEAST_CELLS, MOST_CELLS, SEGMENTS = 16, 1 << 16, 1 << 28, 256
#: Characters of text at a time, words of a task's dictionary, windows held before they are counted.
SLICE, MOST_WORDS, HELD = 4_000_000, 1 << 20, 2_000_000
#: What ends a piece; blank and tab separate words within it.
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_END = re.compile(rb"[.,;:!?\x0a-\x0d]")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 10 if c in _ENDS else 32 if c == 9 else c for c in range(256))
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_COLUMNS = [f"w{i}" for i in range(1, LONGEST + 1)]


class Words(dict):
    """Numbers of words in UTF-8, from 2 on; 0 stands for no word, 1 for the end of a piece."""

    def __init__(self):
        super().__init__({b"": 0, b"\n": 1})
        self.hashes = np.zeros(1 << 16, np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        if n >= len(self.hashes):
            self.hashes = np.r_[self.hashes, np.zeros(len(self.hashes), np.uint64)]
        self.hashes[n] = xxhash.xxh3_64_intdigest(word)
        return n

    def numbers(self, text: bytes) -> np.ndarray:
        """Numbers of a text's words and ends of pieces, in order."""
        tokens = text.translate(_FOLD).replace(b"\n", b" \n ").split(b" ")
        found = np.fromiter(map(self.__getitem__, tokens), np.int32, len(tokens))
        return found[found > 0]


class _Text:
    """Words of a text as numbers, and the cells of its phrases."""

    def __init__(self, words: Words, lang: str, text: bytes, cells: int):
        self.ids = words.numbers(text)
        self.hash = words.hashes[self.ids] ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8")))
        self.word, self.low = self.ids > 1, np.uint64(cells - 1)

    def cells(self, at: np.ndarray, length: int) -> np.ndarray:
        """Cells of the phrases of some length that begin at the places ``at``."""
        h = self.hash[at].copy()
        for k in range(1, length):
            h = h * _PAIR + self.hash[at + k]
        return mix(h + np.uint64(length)) & self.low

    def places(self, joined: np.ndarray, length: int) -> np.ndarray:
        """Where a phrase of that length has all its pairs in ``joined`` (whether a word and the next may stand together)."""
        n = len(self.ids) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        good = joined[:n].copy()
        for k in range(1, length - 1):
            good &= joined[k : n + k]
        return np.flatnonzero(good)

    def frequent_pairs(self, bits: Bits) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is frequent, and each with the next."""
        good, joined = np.zeros(len(self.ids), bool), np.zeros(len(self.ids), bool)
        at = np.flatnonzero(self.word)
        good[at] = bits.frequent(self.cells(at, 1))
        at = self.places(good, 2)
        at = at[good[at + 1]]
        joined[at] = bits.frequent(self.cells(at, 2))
        return good, joined


class Bits:
    """A bit for every cell: set where ``LEAST`` occurrences or more fell into it."""

    def __init__(self, raw: bytes):
        self.raw = np.frombuffer(raw, np.uint8)

    def frequent(self, cell: np.ndarray) -> np.ndarray:
        return (self.raw[cell >> np.uint64(3)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _slices(batch, most: int):
    """(language, text in UTF-8) of a batch, texts of a language together, at most about ``most`` bytes at a time. A long text is cut at ends of pieces."""
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
        raw, at = text.as_py() or b"", 0
        while len(raw) - at > most and (end := _END.search(raw, at + most)):
            texts.setdefault(lang, []).append(raw[at : end.end()])
            at = end.end()
        texts.setdefault(lang, []).append(raw[at:])
    for lang, own in texts.items():
        for a, b in sub_batches(list(map(len, own)), most):
            yield lang, b"\n".join(own[a:b])


def _sketch(cells: int, pairs=None):
    """Cells of words and pairs, or, given the bits of those, of longer phrases."""
    each = cells // SEGMENTS

    def run(batches):
        words, found, bits = Words(), np.zeros(cells, np.uint8), pairs and Bits(pairs.value)
        for batch in batches:
            for lang, text in _slices(batch, SLICE):
                t = _Text(words, lang, text, cells)
                if bits:
                    _, joined = t.frequent_pairs(bits)
                    hits = [t.cells(t.places(joined, k), k) for k in range(3, LONGEST + 1)]
                else:
                    at = t.places(t.word, 2)
                    hits = [t.cells(np.flatnonzero(t.word), 1), t.cells(at[t.word[at + 1]], 2)]
                for hit in hits:
                    at, n = np.unique(hit, return_counts=True)
                    found[at] = np.minimum(LEAST, found[at] + np.minimum(n, LEAST))
                if len(words) > MOST_WORDS:
                    words = Words()
        for i in range(SEGMENTS):
            if found[i * each : (i + 1) * each].any():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([i], pa.int32()), "cells": pa.array([found[i * each : (i + 1) * each].tobytes()], pa.binary())})

    return run


def _sum_cells(batches):
    """One row a segment, with a bit for each frequent cell; what stands in a partition is added up as it arrives."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for segment, raw in zip(batch.column("segment").to_pylist(), batch.column("cells")):
            own = np.frombuffer(raw.as_py(), np.uint8).astype(np.uint16)
            sums[segment] = np.minimum(LEAST, sums[segment] + own).astype(np.uint8) if segment in sums else own.astype(np.uint8)
    for segment, own in sums.items():
        yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "bits": pa.array([np.packbits(own >= LEAST).tobytes()], pa.binary())})


class _Windows:
    """Windows of one language, counted in bounded memory. Single words by number, longer windows sorted and merged."""

    def __init__(self):
        self.single, self.none, self.longer, self.held = np.zeros(0, np.int64), 0, [], 0

    def add(self, ids: np.ndarray, length: np.ndarray) -> None:
        ones = np.bincount(ids[length == 1])
        if len(ones) > len(self.single):
            ones[: len(self.single)] += self.single
            self.single = ones
        else:
            self.single[: len(ones)] += ones
        self.none += int(((length == 0) & (ids > 1)).sum())
        at = np.flatnonzero(length > 1)
        # numbers of the window's words, 0 where it is padded
        rows = np.stack([np.where(length[at] > k, ids[np.minimum(at + k, len(ids) - 1)], 0) for k in range(LONGEST)], axis=1)
        self.longer.append(rows)
        self.held += len(rows)

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct windows (a row of numbers each) and how often they occur."""
        rows = np.concatenate(self.longer) if self.longer else np.zeros((0, LONGEST), np.int32)
        # three numbers of 21 bits, then two: two keys in one order
        first = rows[:, 0].astype(np.int64) << 42 | rows[:, 1].astype(np.int64) << 21 | rows[:, 2]
        last = rows[:, 3].astype(np.int64) << 21 | rows[:, 4]
        order = np.lexsort((last, first))
        first, last = first[order], last[order]
        new = np.r_[True, (first[1:] != first[:-1]) | (last[1:] != last[:-1])] if len(rows) else np.zeros(0, bool)
        begins = np.flatnonzero(new)
        singles = np.flatnonzero(self.single)
        alone = np.zeros((len(singles) + (self.none > 0), LONGEST), np.int32)
        alone[: len(singles), 0] = singles
        counts = np.r_[np.diff(np.r_[begins, len(rows)]), self.single[singles], [self.none] * (self.none > 0)]
        return np.concatenate([rows[order[begins]], alone]), counts


def _window_counts(cells: int, pairs, longer):
    def run(batches):
        of_pairs, of_longer = Bits(pairs.value), Bits(longer.value)
        words, windows = Words(), {}

        def flush():
            names = np.array([b""] * len(words), object)
            for word, i in words.items():
                if i > 1:
                    names[i] = word
            names = pa.array(names, pa.binary()).cast(pa.string())
            for lang, own in windows.items():
                rows, counts = own.counted()
                for a in range(0, len(rows), 20_000):
                    part = rows[a : a + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), *(names.take(pa.array(part[:, k])) for k in range(LONGEST)), pa.array(counts[a : a + 20_000], pa.int64())], names=["lang", *_COLUMNS, "n"])

        for batch in batches:
            for lang, text in _slices(batch, SLICE):
                t = _Text(words, lang, text, cells)
                good, joined = t.frequent_pairs(of_pairs)
                length = good.astype(np.int8) + joined
                for k in range(3, LONGEST + 1):
                    at = t.places(joined, k)
                    at = at[length[at] == k - 1]
                    length[at] += of_longer.frequent(t.cells(at, k))
                windows.setdefault(lang, _Windows()).add(t.ids, length)
                if len(words) > MOST_WORDS or sum(w.held for w in windows.values()) > HELD:
                    yield from flush()
                    words, windows = Words(), {}
        yield from flush()

    return run


def ngram_counts(src: DataFrame, scratch: Scratch) -> DataFrame:
    """lang, words (0 for the language as a whole), phrase, f: how often every frequent phrase of up to ``LONGEST`` words occurs."""
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << max(0, (text_bytes(src) // 6 // WORDS_A_CELL)).bit_length()))
    pairs = _frequent(src, cells)
    longer = _frequent(src, cells, pairs)
    windows = scratch.write(src.mapInArrow(_window_counts(cells, pairs, longer), "lang string, " + ", ".join(f"{w} string" for w in _COLUMNS) + ", n long"), "windows")
    # what is padded at a window's last column is no phrase of that length
    filled = sum((F.col(w) != "").cast("int") for w in _COLUMNS)
    found = None
    for k in range(1, LONGEST + 1):
        rolled = windows.filter(filled <= 1 if k == 1 else filled == k).rollup("lang", *_COLUMNS[:k]).agg(F.sum("n").alias("f"), F.grouping_id().alias("rolled"))
        # each column that is summed over is a bit of ``rolled``, the last column the lowest
        words = None
        for m in range(k + 1):
            here = F.col("rolled") == (1 << (k - m)) - 1
            here = here & (F.col(_COLUMNS[0]) != "") if m else here
            words = F.when(here, m) if words is None else words.when(here, m)
        part = rolled.withColumn("words", words).filter("words is not null").select("lang", "words", F.concat_ws(" ", *_COLUMNS[:k]).alias("phrase"), "f")
        found = part if found is None else found.unionByName(part)
    return scratch.write(found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).filter((F.col("words") == 0) | (F.col("f") >= LEAST)), "grams")


def _frequent(src: DataFrame, cells: int, pairs=None):
    """The bits of ``_sketch``, broadcast: MOST_CELLS / 8 bytes at most."""
    bits = src.mapInArrow(_sketch(cells, pairs), "segment int, cells binary").repartition("segment").mapInArrow(_sum_cells, "segment int, bits binary")
    whole = bytearray(cells // 8)
    for r in bits.collect():
        whole[r.segment * len(whole) // SEGMENTS : (r.segment + 1) * len(whole) // SEGMENTS] = r.bits
    return src.sparkSession.sparkContext.broadcast(bytes(whole))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", listed: int = LISTED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first ``listed`` phrases of every language."""
    bounded_batches(docs)
    scratch = Scratch(docs.sparkSession, "collocations")
    src = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    grams = ngram_counts(src, scratch)
    of_lang = grams.filter("words = 0").select("lang", F.col("f").alias("n"))
    known = grams.filter("words > 0").select("lang", "phrase", "f")
    candidates = grams.filter("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("each"))
    # a longer phrase is as frequent only if the phrases between are, so those with one word more decide
    inner = candidates.filter("words > 2").select("lang", "a", F.explode(F.array(F.slice("each", F.lit(1), F.col("words") - 1), F.slice("each", F.lit(2), F.col("words") - 1))).alias("inner"))
    inner = inner.groupBy("lang", F.array_join("inner", " ").alias("phrase")).agg(F.max("a").alias("longer"))
    alone = candidates.join(inner, ["lang", "phrase"], "left").filter("longer is null or longer < a").join(of_lang, "lang")
    cuts = alone.select("lang", "phrase", "words", "a", "n", "each", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "n", "k", F.array_join(F.slice("each", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("each", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    whole = {x: F.col(x).cast("decimal(19,0)") for x in ("a", "n", "l", "r")}
    # 1000 * a in 19 digits, the products in 38
    score = F.call_function("div", (F.col("a") * 1000).cast("decimal(19,0)") * whole["n"], whole["l"] * whole["r"]).cast("long")
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"), F.first("a").alias("a"), F.first("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    found = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= listed)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
n AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
grams AS (SELECT lang, m, list_slice(words, i, i + m - 1) AS phrase FROM (SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m) s WHERE len(words) >= m) x),
f AS (SELECT lang, m, array_to_string(phrase, ' ') AS phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE m > 1),
alone AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.lang = c.lang AND b.m > c.m AND b.a >= c.a AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM alone),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.a, k, l.f AS l, r.f AS r, n, CAST((1000 * a)::HUGEINT * n // (l.f::HUGEINT * r.f) AS BIGINT) AS score
           FROM cuts JOIN n USING (lang) JOIN f l ON l.lang = cuts.lang AND l.phrase = array_to_string(words[1:k], ' ') JOIN f r ON r.lang = cuts.lang AND r.phrase = array_to_string(words[k + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best QUALIFY rank <= 2000
"""
