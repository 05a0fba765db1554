"""Corpus operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arborea.llm import bpe, exact_dedup, jaccard, licenses, neighbours, packing, pii, quality, substring_dedup, warc

PATH = public_tokenizers.path("word_bpe_49k.json")
#: Columns whose names operators use inside.
CLASH = ("cls", "n", "entry", "sha", "digest", "ord", "rid", "bucket", "component_id", "kept", "score", "window", "root")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["x"] * len(CLASH)) for i, t in rows], SCHEMA)


def corpus():
    rnd = random.Random(11)
    vocab = ["w%d" % i for i in range(300)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(20, 90))] for _ in range(12)]
    rows = []
    for i in range(120):
        ws = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 5)):
            ws[rnd.randrange(len(ws))] = rnd.choice(vocab)
        rows.append((i, rnd.choice([" ", "\n", "\t  "]).join(ws)))
    long = " ".join(rnd.choice(vocab) for _ in range(30_000))
    odd = [(200, None), (201, ""), (202, "  \n "), (203, "A b"), (204, "a B"), (205, "a b c d e"), (206, long), (207, long + " tail"), (208, "x" * 40_000), (5, rows[5][1]), (5, rows[5][1]), (None, rows[7][1]), (None, None), (300, "the " * 60), (301, "é È ß\x0b\x0cΣ")]
    return rows + odd


ROWS = corpus()


def brute_components(rows):
    sets = []
    for _, t in rows:
        ws = (t or "").encode().lower().split()
        sets.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), 1 << 62), d)
    return [(d, len(s), d if not s else low.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def same(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_jaccard(spark, monkeypatch):
    same(jaccard.jaccard_components(table(spark, ROWS)).collect(), brute_components(ROWS))
    monkeypatch.setattr(jaccard, "HOT_IN_BATCH", 3)  # hot shingles and split families
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 200)
    same(jaccard.jaccard_components(table(spark, ROWS)).collect(), brute_components(ROWS))


def test_jaccard_large_family(spark, monkeypatch, tmp_path):
    """A family of many blocks: each group of tiles stays small, and shuffled rows grow with the family, not with its square."""
    rnd = random.Random(5)
    base = ["b%d" % i for i in range(80)]
    rows = []
    for i in range(400):
        ws = list(base)
        ws[rnd.randrange(80)] = "e%d" % i
        rows.append((i, " ".join(ws)))
    # a third shares half of the text only; a chain is linked to it and to each other step by step
    rows += [(1000 + i, " ".join(base[:60] + ["f%d" % (i // 3 * 40 + k) for k in range(40)])) for i in range(30)]
    rows += [(2000 + i, " ".join(base[6 * i :] + ["c%d" % k for k in range(6 * i)])) for i in range(9)]
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 1500)
    compare, seen = jaccard._compare, str(tmp_path / "seen")

    def counted(percent):
        run = compare(percent)

        def f(pdf):
            with open(seen, "a") as out:
                out.write(f"{len(pdf)}\n")
            return run(pdf)

        return f

    monkeypatch.setattr(jaccard, "_compare", counted)
    same(jaccard.jaccard_components(table(spark, rows)).collect(), brute_components(rows))
    met = [int(n) for n in open(seen)]
    assert sum(met) < 5 * len(rows) and max(met) < 120, (sum(met), max(met))


def test_exact_dedup(spark):
    for size in (32, 1):  # a digest of one byte clashes: the byte verification resolves it
        groups = {}
        for d, t in ROWS:
            groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(d)
        got = exact_dedup.exact_duplicates(table(spark, ROWS), digest_bytes=size).collect()
        sha = {hashlib.sha256(t.encode()).hexdigest(): ds for t, ds in groups.items()}
        assert len(got) == len(ROWS) and sum(r.kept for r in got) == len(groups)
        for r in got:
            ids = [d for d in sha[r.text_sha256] if d is not None]
            assert r.group_size == len(sha[r.text_sha256]) and r.keep_id == (min(ids) if ids else None) and (not r.kept or r.doc_id == r.keep_id)


def brute_substring(rows):
    first = {}
    split = [((1 << 63) if d is None else d, (t or "").encode().split()) for d, t in rows]
    for d, ws in split:
        for i in range(len(ws) - 12):
            k = tuple(ws[i : i + 13])
            first[k] = min(first.get(k, 1 << 64), d)
    out = []
    for (d, _), (o, ws) in zip(rows, split):
        gone = {i + k for i in range(len(ws) - 12) if first[tuple(ws[i : i + 13])] < o for k in range(13)}
        out.append((d, len(ws), len(gone), hashlib.sha256(b" ".join(w for i, w in enumerate(ws) if i not in gone)).hexdigest()))
    return out


def test_substring_dedup(spark, monkeypatch):
    same(substring_dedup.remove_repeats(table(spark, ROWS), with_text=False).collect(), brute_substring(ROWS))
    monkeypatch.setattr(substring_dedup, "HOT", 2)
    same(substring_dedup.remove_repeats(table(spark, ROWS), with_text=False).collect(), brute_substring(ROWS))


def test_what_is_dealt_stays_in_proportion():
    """Bytes a shingle are the same, within 15 %, for tables of 5 GB, 500 GB and 5 TB of text; anchors of a bucket are many a tile."""
    import pyarrow as pa

    rnd = random.Random(4)
    texts = [" ".join(rnd.choices(WORDS, k=700)) for _ in range(6_000)]
    WORDS_OF = pa.RecordBatch.from_pydict({"text": texts})
    bytes_of = []
    for total in (5e9, 5e11, 5e12):
        n = jaccard.tiles_for(int(total), jaccard.tile_bytes(int(total)))
        out = list(jaccard_tiles(n, WORDS_OF))
        # a row costs its binaries, and some 24 bytes of keys and lengths
        size = sum(len(x.as_py()) for b in out for c in ("tok", "who") for x in b.column(c) if x.is_valid) + 24 * sum(b.num_rows for b in out)
        bytes_of.append(size / sum(len(x.as_py()) // 6 for b in out for x in b.column("tok") if x.is_valid))
        tiles, buckets = substring_dedup.dealt_to(int(total))
        assert total / buckets / 14 / tiles >= 10  # about 14 bytes of text for an anchor
    assert max(bytes_of) <= 1.15 * min(bytes_of), bytes_of


def jaccard_tiles(n, batch):
    from unittest import mock

    with mock.patch.object(jaccard, "TaskContext") as context:
        context.get.return_value.partitionId.return_value = 0
        yield from jaccard._tiles(5, n)([batch])


WORDS = [f"w{i}" for i in range(50_000)]


def test_difference_cover():
    p = substring_dedup
    for a in range(p.PERIOD):
        for b in range(p.PERIOD):
            assert any((a + j) % p.PERIOD in p.COVER and (b + j) % p.PERIOD in p.COVER for j in range(p.PERIOD))


ODD = ["it's ISN'T 12 ½ x²", "<|endoftext|> a <|startoftext|>b", "İstanbul ΣΑΣ ſ ﬁ", "é 한 가", "\x1c\x85 ​", "😀😀 a_b--c!!"]


def test_bpe_equals_the_library(spark):
    rows = ROWS + [(1000 + i, t) for i, t in enumerate(ODD)]
    tk = Tokenizer.from_file(PATH)
    want = []
    for d, t in rows:
        ids = tk.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    same(bpe.encoding_digests(table(spark, rows), PATH).collect(), want)
    got = {r.doc_id: r for r in bpe.encode_documents(table(spark, rows[:3]), PATH).collect()}
    assert np.frombuffer(got[1].ids, "<u4").tolist() == tk.encode(rows[1][1], add_special_tokens=False).ids


def test_bpe_controls_beside_white_space():
    """U+001C to U+001F are white space to Python alone."""
    t, v, rnd = Tokenizer.from_file(PATH), bpe.vocabulary(PATH), random.Random(6)
    white = ["", " ", "\n", "\t", "\x85", "\u2003"]
    texts = [a + b + c + d + e for a in white for b in ("", "x") for c in "\x1c\x1d\x1e\x1f" for d in ("", "y") for e in white]
    texts += ["".join(rnd.choice(" \n\t\x1c\x1d\x1f\x85ab.Éé\u0301") for _ in range(rnd.randint(0, 12))) for _ in range(50_000)]
    for text, e in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(v.encode(text), "<u4").tolist() == e.ids, repr(text)


def test_bpe_every_code_point():
    """Letters, digits, cases and compositions are those of the library, whatever Unicode version either has."""
    v, tk = bpe.vocabulary(PATH), Tokenizer.from_file(PATH)
    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x32000), *range(0xE0000, 0xE0200)]]
    texts = [f"a{c}b {c} 1{c}. A{c}" for c in points]
    for a in range(0, len(texts), 20_000):
        for t, e in zip(texts[a : a + 20_000], tk.encode_batch(texts[a : a + 20_000], add_special_tokens=False)):
            assert v.encode(t) == np.array(e.ids, "<u4").tobytes(), t.encode("unicode_escape")


def test_bpe_long_words():
    v, tk, rnd = bpe.vocabulary(PATH), Tokenizer.from_file(PATH), random.Random(2)
    for _ in range(20):
        w = "".join(rnd.choice(["th", "in", "er", "tion", "a", "st", "zz", "qu"]) for _ in range(rnd.randint(400, 1500)))
        assert len(w) > 4 * v.lookahead or len(w) > 500
        assert v.word(w.encode()) == tk.encode(w, add_special_tokens=False).ids


def test_packing(spark):
    tk = Tokenizer.from_file(PATH)
    ids = [(d, np.array(tk.encode(t or "", add_special_tokens=False).ids + [1], "<u4")) for d, t in ROWS]
    got = packing.pack_documents(table(spark, ROWS).repartition(3), PATH).collect()
    assert sum(r.length for r in got) == sum(len(x) for _, x in ids)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
        assert any(d == r.doc_id and len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for d, x in ids)
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SIZE
    assert len(by) <= 1.3 * sum(len(x) for _, x in ids) / packing.SIZE + 3


def test_packer_is_bounded():
    p, rnd, n, total = packing.Packer(100, 4), random.Random(4), 0, 0
    for i in range(2000):
        size = rnd.randint(1, 250)
        total += size
        for w in p.add(i, size):
            n += sum(x[2] for x in w)
            assert sum(x[2] for x in w) == 100
        assert len(p.open) <= 4
    assert n + sum(x[2] for w in p.leftovers() for x in w) == total


def test_nearest(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(600, 16)).astype(np.float32)
    x[100:140] = x[100]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (750, []), (800, [0.0] * 16), (850, [float("nan")] + [1.0] * 15), (900, [None] + [1.0] * 15), (950, [1.0] * 3), (50, x[50].tolist()), (None, x[3].tolist())]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    y = x.astype(float)
    norm, hits, total = np.linalg.norm(y, axis=1), 0, 0
    for q in range(0, 600, 50):
        s = y @ y[q] / (norm * norm[q])
        s[q] = -9
        want = np.lexsort((np.arange(600), -np.round(s, 12)))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - s[r.vec_id]) < 1e-12 for r in mine)
        hits += len({r.vec_id for r in mine} & set(want.tolist()))
        total += 5
    assert hits / total >= 0.9 and {r.query_id for r in got} == set(range(0, 600, 50))
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 100] == [101, 102, 103, 104, 105]
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_nearest_over_shards(spark, monkeypatch):
    """Recall against brute force with five shards and several blocks of queries, on clustered vectors; other columns don't matter."""
    rnd = np.random.default_rng(8)
    x = (rnd.normal(size=(40, 24))[rnd.integers(0, 40, 5000)] + 0.4 * rnd.normal(size=(5000, 24))).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), "x", "y", 1.0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, rep string, shard string, score double")
    got = neighbours.nearest(rows, every=2, n_shards=5).collect()
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = y[::2] @ y.T
    s[np.arange(2500), np.arange(0, 5000, 2)] = -9
    want = np.argsort(-s, axis=1, kind="stable")[:, :5]
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(found[2 * i] & set(w)) / 5 for i, w in enumerate(want.tolist())]) >= 0.9
    assert neighbours.shards_for(100, 8) == 1 and neighbours.shards_for(10_000, 64) == 4 and neighbours.shards_for(10**6, 64) == 64 and neighbours.shards_for(10**9, 768) == 11_445


@pytest.mark.parametrize("kind", ["scaled copies", "forty directions", "one direction"])
def test_equal_directions(spark, kind):
    """Vectors of one direction and many lengths: what is found is as near as what brute force finds."""
    rnd = np.random.default_rng(3)
    if kind == "scaled copies":
        x = np.r_[rnd.normal(size=(1500, 32)), rnd.normal(size=32) * rnd.uniform(0.1, 9, (500, 1))]
    elif kind == "forty directions":
        x = rnd.normal(size=(40, 32))[rnd.integers(0, 40, 2000)] * rnd.uniform(0.1, 9, (2000, 1))
    else:
        x = rnd.normal(size=32) * rnd.uniform(0.1, 9, (2000, 1))
    x = x.astype(np.float32)[rnd.permutation(len(x))]
    got = neighbours.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    y = x.astype(float)
    norm, hits = np.linalg.norm(y, axis=1), 0
    for q in range(0, 2000, 50):
        s = y @ y[q] / (norm * norm[q])
        s[q] = -9
        mine = [r.score for r in got if r.query_id == q]
        assert len(mine) == 5
        hits += sum(v >= np.sort(s)[-5] - 1e-9 for v in mine)
    assert hits / 200 >= 0.9


def test_every_node_is_reached():
    x = np.eye(6, dtype=np.float32)
    edges = neighbours.connected(x, np.full((6, 2), -1), 0, 4)
    seen = {0}
    while new := {int(e) for n in seen for e in edges[n] if e >= 0} - seen:
        seen |= new
    assert seen == set(range(6))


def test_warc(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a/x y", big), (2, None, big), (3, "http://a/\n", "small"), (4, "u", "small"), (5, "u", None), (9, "u", big), (9, "u", big), (None, "u", "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id or 0), r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_and_read(pages).collect())
    assert [g[:3] for g in got] == [(0, 1, "response"), (1, 1200, "revisit"), (2, 1200, "revisit"), (3, 5, "response"), (4, 5, "response"), (5, 0, "response"), (9, 1200, "response"), (9, 1200, "revisit")]
    assert all(g[3] == (9 if g[2] == "revisit" else None) for g in got)
    first = {r.file: r.sha256 for r in warc.write_archives(pages, str(tmp_path / "a")).collect()}
    assert first == {r.file: r.sha256 for r in warc.write_archives(pages, str(tmp_path / "b")).collect()}
    # again into the same folder, as by a task that runs once more: same files, nothing left over
    assert first == {r.file: r.sha256 for r in warc.write_archives(pages.withColumn("payload", F.lit("x")).withColumn("keep_id", F.lit(1)), str(tmp_path / "a")).collect()}
    assert {p.name for p in (tmp_path / "a").iterdir()} == {*first, "manifest"}
    back = {(r.page_id, bytes(r.payload)) for r in warc.read_archives(spark, str(tmp_path / "a")).collect() if r.payload is not None}
    assert (9, big.encode()) in back and (3, b"small") in back
    assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_personal_data(spark):
    rnd = random.Random(9)
    parts = ["a.b@x.co", "@", "a@b", "@@x.y", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (314) 555-4198", "+1", "+12345678 ", "..", " ", "9", "é", "x@y.z@w.v", "-", "%"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9))) for _ in range(3000)] + ["a" * 2_000 + "@", "1" * 2_000, "1." * 1_000, "+1" * 1_000]
    for t in texts:
        assert pii.base_spans(t) == brute_pii(t), t[:200]
    for t in ("a" * 2_000_000 + "@", "1" * 1_000_000, "1." * 500_000, "+1" * 500_000, "@" * 1_000_000):
        pii.base_spans(t)  # linear: ends at once
    rows = list(enumerate(texts[:100])) + [(500, None), (501, ""), (501, ""), (None, "a@b.com")]
    got = pii.find_personal_data(table(spark, rows)).collect()
    want = sorted(hashlib.sha256(",".join("%s:%d:%d" % s for s in brute_pii(t or "")).encode()).hexdigest() for _, t in rows)
    assert sorted(r.base_sha256 for r in got) == want
    assert pii.redact("mail a@b.com, 1.2.3.4!", pii.base_spans("mail a@b.com, 1.2.3.4!")) == "mail [EMAIL], [IP]!"


def brute_spans(t, model):
    """All spans by a plain reading of the rules: base ones, then every other match that overlaps none before it and is likely."""
    base = brute_pii(t)
    more = [("ip", *m.span()) for m in re.finditer(r"(?<![0-9])[0-9]+(\.[0-9]+){3}", t)]
    more += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(re.sub("[^0-9]", "", m[0])) <= 19]
    more += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)]
    more += [(k, *m.span()) for k, p in pii._WIDE.items() for m in p.finditer(t)]
    kept = []
    for k, a, b in sorted(set(more) - set(base), key=lambda s: (s[1], s[2], s[0])):
        if all(b <= x or y <= a for _, x, y in base + kept):
            kept.append((k, a, b))
    likely = [s for s in kept if model.probability(s[0], pii.votes(t, *s, False)) >= pii.ACCEPT]
    return sorted(base + likely, key=lambda s: (pii.KINDS.index(s[0]), s[1]))


def test_personal_data_spans(spark):
    """spans and reliabilities: labelers that disagree, candidates of every kind that are taken and refused."""
    rnd = random.Random(4)
    parts = ["call +1 (314) 555-4198 now", "tel (314) 555-4198 please", "version 1.2.3.999 of it", "host 10.1.2.3 up", "card 4111 1111 1111 1111 ok", "order 9111 1111 1111 1112 no", "visa 3782 822463 10005 x", "id 1234567890123 y", "joe [at] site [dot] org", "mail a.b@x.co", "fe80:0:0:0:202:b3ff:fe1e:8329 ip", "+123", "section 12.13.14.15.16", "plain words"]
    rows = [(i, " ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 6)))) for i in range(400)] + [(900, None), (901, ""), (None, "tel (314) 555-4198")]
    docs = table(spark, rows)
    model = pii.estimate(pii.vote_counts(docs))
    assert all(0.001 < x < 0.999 for t in model.reliability.values() for x in t.ravel()) and set(model.reliability) == set(pii.KINDS)
    got = pii.find_personal_data(docs, model=model).collect()
    shown = lambda t: ",".join("%s:%d:%d" % s for s in brute_spans(t or "", model))
    same([(r.doc_id, r.spans) for r in got], [(d, shown(t)) for d, t in rows])
    spans = [(k, t[a:b]) for _, t in rows if t for k, a, b in pii.find_spans(t, model)[1]]
    assert ("phone", "(314) 555-4198") in spans and ("ip", "1.2.3.999") not in spans and ("card", "9111 1111 1111 1112") not in spans


def test_personal_data_votes():
    good, bad, half = ("phone", (1, 1, 1, 0, 0, 1, 2, 2, 0, 0), 200), ("phone", (-1, -1, -1, 0, -1, -1, 4, 0, 1, 1), 50), ("phone", (-1, 1, 1, 1, 0, 1, 2, 2, 0, 0), 20)
    model = pii.estimate([good, bad, half])
    assert model.probability("phone", good[1]) > 0.9 > 0.5 > model.probability("phone", bad[1]) and model.probability("phone", half[1]) > 0.9


def test_quality(spark):
    rnd = random.Random(1)
    ws = ["the", "and", "of", "cat", "house", "river", "walks", "slowly", "green", "morning"]
    rows = [(i, " ".join(rnd.choice(ws) for _ in range(60)) if i % 3 else " ".join(w.upper() + "!!" for w in rnd.choices(ws, k=60))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows + [(500, None), (501, ""), (None, "cat"), (1, rows[1][1])])
    got = quality.score_documents(docs, quality.learn(docs, labels)).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.doc_id for r in held} == {r.doc_id for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert np.mean([r.predicted == (r.doc_id % 3 > 0) for r in held if r.doc_id < 400]) > 0.95
    none = quality.score_documents(docs, quality.learn(docs, labels.limit(0))).collect()
    assert {r.score for r in none} == {0.5}


def test_quality_by_brute_force(spark):
    """Every score of the given tables from plain compressions, and its accuracy on rows that were held out."""
    import zstandard

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    model = quality.learn(docs, labels)
    got = {r.doc_id: r for r in quality.score_documents(docs.withColumn("score", F.lit(9)), model).collect()}
    plain = {k: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), level=quality.LEVEL) for k, d in (("good", model.good), ("bad", model.bad))}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for d, t in texts.items():
        raw = (t or "").encode()
        size = {k: sum(len(c.compress(raw[a : a + 512])) for a in range(0, len(raw), 512)) for k, c in plain.items()}
        want = 1 / (1 + math.exp(-model.curve[0] - model.curve[1] * (size["bad"] - size["good"]) / max(1, len(raw))))
        assert abs(got[d].score - want) < 1e-12
    held = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = ([x for x, y in held if y == k] for k in (1, 0))
    auc = np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])
    assert len(held) > 50 and auc > 0.98 and np.mean([(x >= 0.5) == y for x, y in held]) > 0.95
    # repeated rows don't multiply the sample, and one kind of label gives a constant
    again = quality.learn(docs.unionByName(docs), labels)
    assert (again.good, again.bad, again.curve) == (model.good, model.bad, model.curve)
    assert quality.learn(docs, labels.filter("quality = 1")).scores([b"a", b""]).tolist() == [1.0, 1.0]
    assert quality.score_documents(docs.limit(0), model).count() == 0


def test_licenses(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c.txt", "plain text\nmore"), (3, "a/b/d.txt", "Licensed under the Apache License, Version 2.0.\n" + "word " * 90), (4, "z/e.txt", None), (5, None, ""), (6, "q/x", "he said licensing is hard in general for many people here"), (2, "a/b/c.txt", "plain text\nmore")]
    got = {r.doc_id: (r.license, r.origin, r.origin_path) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got[1] == ("MIT", "own", "a/LICENSE") and got[2] == ("MIT", "inherited", "a/LICENSE") and got[3] == ("Apache-2.0", "own", "a/b/d.txt")
    assert got[4][:2] == got[5][:2] == got[6][:2] == ("none", "none")


def test_licences_told_apart(spark):
    """Each header and notice is its own licence, in a table with clashing columns; an empty table gives nothing."""
    rows = [(i, f"d{i}/f.c", f"# {body}\n" + "int x;\n" * 40, "x", "y") for i, (_, _, body) in enumerate(licenses.TEMPLATES)]
    got = {r.doc_id: r.license for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string, block string, license string")).collect()}
    assert got == {i: t[0] for i, t in enumerate(licenses.TEMPLATES)}


def test_license_files_and_wrapped_clauses(spark):
    whole = {p.stem: p.read_text() for p in Path(licenses.__file__).with_name("license_texts").glob("*.txt")}
    rows = [(f"{n}/LICENSE", "Copyright (c) 2020 A. Writer\n\n" + t) for n, t in whole.items()] + [(f"{n}/src/x.py", "x = 1") for n in whole]
    rows += [("h/a.c", "/* This program is free software: you can redistribute it\n * and/or modify it under the terms of the GNU General\n * Public License, either version 3 of the License */\n" + "int x;\n" * 90), ("h/b.c", "int y;")]
    rows += [("f/COPYING", "GNU AFFERO GENERAL PUBLIC LICENSE\n" + whole["GPL-3.0"])]
    # two matching lines of a fifth of the words each
    rows += [("s/NOTICE", "Released under the MIT License.\n" + "word " * 15 + "\nReleased under the MIT License."), ("s/c.c", "int z;")]
    got = {r.path: (r.license, r.origin) for r in licenses.license_scan(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, path string, text string")).collect()}
    for n in whole:
        assert (n, got[f"{n}/LICENSE"], got[f"{n}/src/x.py"]) == (n, (n, "own"), (n, "inherited"))
    assert got["h/a.c"] == ("GPL-3.0", "own") and got["h/b.c"] == ("none", "none") and got["f/COPYING"][0] == "AGPL-3.0"
    assert got["s/c.c"] == ("MIT", "inherited")


@pytest.mark.parametrize("run", [jaccard.jaccard_components, exact_dedup.exact_duplicates, substring_dedup.remove_repeats, lambda d: bpe.encoding_digests(d, PATH), lambda d: packing.pack_documents(d, PATH), pii.find_personal_data, lambda d: licenses.license_scan(d, path="source")])
def test_empty_tables(spark, run):
    assert run(table(spark, [])).count() == 0


def test_latin_words_need_no_composition(monkeypatch):
    from arborea.llm import bpe, queries
    from tokenizers import Tokenizer
    known = Tokenizer.from_file(str(queries.VOCABULARY))
    said = ["Über Straße, STRASSE, Straße, ÀÉÿ ÅNGSTRÖM; straße,", "ª º µ ²³ x²y Ça·va 1Ä2  É\u0085é", "don't, DON'T, don't,"]
    monkeypatch.setattr(bpe, "_FOLD", None)
    v = bpe.Vocabulary(str(queries.VOCABULARY), bpe.character_classes())
    for text in said * 2:
        assert list(memoryview(v.encode(text)).cast("I")) == known.encode(text, add_special_tokens=False).ids
    assert "straße," in v.cache and "àéÿ" in v.cache
