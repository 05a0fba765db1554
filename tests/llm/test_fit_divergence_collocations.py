"""Best-fit packing, the divergence audit and collocations against plain versions: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import bisect
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from conftest import rows_of
from tokenizers import Tokenizer

from arborea.llm import best_fit, collocations, divergence

BYTES = public_tokenizers.path("byte_bpe_50k.json")
CLASH = ("n", "part", "rank", "block", "term", "value", "words", "w1", "piece", "length", "serial", "cells", "df")
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASH)


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in rows], SCHEMA)


def corpus():
    rnd = random.Random(5)
    vocab = ["Alpha", "beta", "gamma", "déjà", "Ünit", "x1", "a-b", "the", "of", "漢字"] + [f"word{i}" for i in range(60)]
    rows = []
    for i in range(400):
        ws = [rnd.choice(vocab[: rnd.choice([4, 12, 70])]) for _ in range(rnd.randint(0, 60))]
        text = "".join(w + rnd.choice([" ", " ", " ", "\t", "  ", ". ", ", ", "\n", ";", " \x1c ", "\xa0"]) for w in ws)
        rows.append((i, text, rnd.choice(["en", "en", "en", "de", None, ""]), rnd.choice(["s1", "s1", "s2", "s3", None])))
    odd = [(500, None, "en", "s1"), (501, "", "en", "empty"), (502, "??? 12", "xx", "only"), (503, "one", "xx", "two"), (None, "beta beta", "en", "s2"), (7, rows[7][1], "en", "s1"), (7, rows[7][1], "en", "s1")]
    return rows + odd + [(600, "Alpha beta gamma " * 20_000, "en", "s2"), (601, "\xb5" * 5_000, "und", "s2"), (602, "aİb " * 30, "en", "s3"), (603, "One two\tthree four five six. " * 120, None, "s1"), (604, "one two. two three four, ten " * 70, "und", "s1")]


ROWS = corpus()


# --- best-fit packing


def literal_best_fit(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, n)
        room = rooms.pop(i) if i < len(rooms) else size
        bisect.insort(rooms, room - n)
    return len(rooms)


def test_plan_is_best_fit_decreasing():
    rnd = random.Random(1)
    for _ in range(120):
        size = rnd.choice([10, 64, 2048])
        lengths = [min(size, 1 + int(rnd.expovariate(1 / rnd.choice([3, 100, 700])))) for _ in range(rnd.randint(0, 600))]
        counts = Counter(lengths)
        runs, bins = sorted(best_fit.best_fit_plan(counts, size)), defaultdict(list)
        for i, (n, since, each, first, offset) in enumerate(runs):
            until = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == n else counts[n]
            for k in range(since, until):
                bins[first + (k - since) // each].append((offset + (k - since) % each * n, n))
        for placed in bins.values():
            at = 0
            for offset, n in sorted(placed):
                assert offset == at
                at += n
            assert at <= size
        assert sum(map(len, bins.values())) == len(lengths) and len(bins) == literal_best_fit(lengths, size)


def test_plan_stays_small():
    assert len(best_fit.best_fit_plan({n: 10**9 + 7 * n for n in range(1, 2049)})) < 70_000


def test_tightest_room():
    rnd = random.Random(2)
    rooms, open_ = best_fit.Rooms(50), Counter()
    for _ in range(2_000):
        room = rnd.randint(1, 50)
        by = -1 if open_[room] and rnd.random() < 0.5 else 1
        rooms.add(room, by)
        open_[room] += by
        want = rnd.randint(1, 50)
        assert rooms.tightest(want) == min((r for r in open_ if open_[r] and r >= want), default=None)


@pytest.mark.parametrize("cut", [1 << 20, 8])
def test_byte_encoder_equals_the_library(monkeypatch, cut):
    monkeypatch.setattr(best_fit, "SLICE", cut)
    rnd, e, t = random.Random(3), best_fit.ByteEncoder(BYTES), Tokenizer.from_file(BYTES)
    signs = [*" \n\t\x0b\x1c\x85\xa0　ab'sd1é.,<|", "<|endoftext|>", "  ", "'ll", "漢", "é", "Word", " the"]
    for _ in range(8_000):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30)))
        assert np.frombuffer(e.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_best_fit_packing(spark):
    t = Tokenizer.from_file(BYTES)
    got = best_fit.pack_best_fit(table(spark, ROWS).repartition(5), BYTES).collect()
    want, lengths = Counter(), []
    for doc_id, text, *_ in ROWS:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or min(len(ids), 2048)
        ends = [first, *range(first + 2048, len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip([0, *ends], ends)):
            want[doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
            lengths.append(b - a)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) == literal_best_fit(lengths, 2048)
    empty = best_fit.pack_best_fit(table(spark, []), BYTES)
    assert empty.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and not empty.count()


# --- divergence of sources


def plain_divergence(rows, documents=10, listed=10):
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.add((lang, source))
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
    out, utf8 = set(), lambda x: (-x[1], x[0].encode())
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= documents]
        of = {s: Counter({t: counts[lang, s][t] for t in kept}) for g, s in groups if g == lang}
        total = {s: sum(c.values()) for s, c in of.items()}
        whole, below = Counter(), sum(total.values()) + 2 * len(kept)
        for c in of.values():
            whole.update(c)
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (total[s] + 2 * len(kept)) for t in kept} for s, c in of.items()}
        for s in of:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept)) for o in of if o != s]
            out |= {(lang, s, "pair", o, v, i + 1) for i, (o, v) in enumerate(sorted(pairs, key=utf8))}
            terms = []
            for t in kept:
                a, q = p[s][t], 1 + 10**9 * (whole[t] + 2) // below
                if of[s][t] and a > q:
                    terms.append((t, (a - q) ** 2 // (a + q)))
            out |= {(lang, s, "term", t, v, i + 1) for i, (t, v) in enumerate(sorted(terms, key=utf8)[:listed])}
    return out


@pytest.mark.parametrize(("block", "tile"), [(divergence.BLOCK, divergence.TILE), (3, 2)])
def test_divergence(spark, block, tile):
    got = divergence.source_divergence(table(spark, ROWS).repartition(3), block=block, tile=tile).collect()
    found = {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got}
    assert found == plain_divergence(ROWS) and len(found) == len(got)
    # groups without terms, and a language without kept terms
    assert ("xx", "only", "pair", "two", 0, 1) in found and any(r[1] == "empty" and r[4] > 0 for r in found)


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(table(spark, [])).count() == 0
    assert divergence.source_divergence(table(spark, [(1, None, None, None)])).count() == 0


def test_counts_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 5)
    assert {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.source_divergence(table(spark, ROWS)).collect()} == plain_divergence(ROWS)


def test_gallop():
    rnd = np.random.default_rng(4)
    for _ in range(300):
        a, b = (np.unique(rnd.integers(0, 60, rnd.integers(0, n))) for n in (50, 30))
        if len(a):
            assert divergence.gallop(a, b).tolist() == np.searchsorted(a, b).tolist()
        p, q = (rnd.integers(1, 10**9, len(x)) for x in (a, b))
        pa, pb = dict(zip(a.tolist(), p.tolist())), dict(zip(b.tolist(), q.tolist()))
        want = sum((pa.get(t, 7) - pb.get(t, 9)) ** 2 // (pa.get(t, 7) + pb.get(t, 9)) for t in pa.keys() | pb.keys())
        assert divergence.price((a, p), (b, q), 7, 9) == (want, len(pa.keys() | pb.keys()))


def test_shares_are_exact(spark):
    n = [(0, 1, 1), (10**15, 4 * 10**15, 10**12), (12_345_678_901, 98_765_432_109_876, 77), (5, 7, 3)]
    from pyspark.sql import functions as F

    got = spark.createDataFrame(n, "n long, total long, v long").select(divergence.share(F.col("n"), F.col("total"), F.col("v")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 2) // (t + 2 * v) for c, t, v in n]


# --- collocations


def plain_collocations(rows, least=100):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for m in range(1, 6):
                f[lang].update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang in n:
        known = {p: c for p, c in f[lang].items() if c >= least}
        inside = Counter()
        for p, c in known.items():
            for m in range(1, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], c)
        found = []
        for p, a in known.items():
            if len(p) > 1 and inside[p] < a:
                score, k = min((1000 * a * n[lang] // (known[p[:k]] * known[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), known[p[:k]], known[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:2000])]
    return sorted(out)


def found_in(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def test_collocations(spark):
    want = plain_collocations(ROWS)
    assert found_in(collocations.collocations(table(spark, ROWS).repartition(3))) == want
    assert {r[0] for r in want} >= {"en", "und"} and any(len(r[2].split()) > 2 for r in want)
    assert not collocations.collocations(table(spark, [])).count() and not collocations.collocations(table(spark, [(1, None, None, None)])).count()


@pytest.mark.parametrize("names", ["SLICE", "MOST_WORDS", "HELD", "MOST_CELLS"])
def test_collocations_do_not_depend_on_limits(spark, monkeypatch, names):
    """Short slices, small dictionaries, early counts, and a table of cells so small that all are full."""
    monkeypatch.setattr(collocations, names, {"SLICE": 200, "MOST_WORDS": 20, "HELD": 500, "MOST_CELLS": 2048}[names])
    monkeypatch.setattr(collocations, "LEAST_CELLS", 2048)
    assert found_in(collocations.collocations(table(spark, ROWS))) == plain_collocations(ROWS)


@pytest.mark.parametrize("module", [divergence, collocations])
def test_sql_of_the_same(spark, module):
    import pandas as pd

    # the SQL copies a piece's words for each of them: no very long piece here
    rows = [r for r in ROWS if r[0] != 600]
    con = duckdb.connect()
    documents = pd.DataFrame([r[:4] for r in rows], columns=["doc_id", "text", "lang", "source"])
    con.register("documents", documents)
    run = module.source_divergence if module is divergence else module.collocations
    assert rows_of(run(table(spark, rows)).toArrow()) == rows_of(con.sql(module.ORACLE_SQL).to_arrow_table())
