"""Each stage of the pipeline against a plain version, on its predecessor's rows; a document without text and repeated rows included."""

import re
import zlib

import corpus_pipeline as p
import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arborea.llm import pii, quality


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("cls", F.lit("x"))
    twice = docs.limit(3)
    null = docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(9999).cast("long"))
    out = [docs.unionByName(twice).unionByName(null)]
    for i, (_, stage) in enumerate(p.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, out[-1], SMALL).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_quality(spark, stages):
    model = quality.learn(stages[0], spark.read.parquet(f"{SMALL}/labels.parquet"))
    want = sorted(r.doc_id for r in quality.score_documents(stages[0], model).collect() if r.predicted)
    assert sorted(d for d, _ in rows(stages[1])) == want


def test_exact(stages):
    low = {}
    for d, t in rows(stages[1]):
        k = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        low[k] = min(low.get(k, 1 << 60), d)
    assert sorted(d for d, _ in rows(stages[2])) == sorted(low.values())


def test_near(stages):
    docs = sorted(rows(stages[2]))
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").encode().lower().split()) else set() for d, t in docs}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(d for d, _ in rows(stages[3])) == sorted(d for d in sets if find(d) == d)


def test_near_rows_without_ids(spark, stages):
    """Rows with a null or shared doc_id are judged each for itself; repeated rows leave one; blank ones stay."""
    base = ["w%d" % i for i in range(60)]
    near, far = " ".join(base[:-1] + ["x"]), " ".join("v%d" % i for i in range(60))
    given = [(None, " ".join(base)), (None, near), (5, near + " y"), (5, far), (5, far), (8, "other words than all the rest here"), (None, far + " z"), (9, None), (9, None), (None, " "), (10, "short"), (10, "short")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in given], "doc_id long, text string, lang string, source string, n_chars long, component string")
    got = p.drop_near_copies(spark, docs, SMALL)
    assert got.columns == docs.columns
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(rows(got), key=key) == sorted([(5, near + " y"), (5, far), (8, given[5][1]), (9, None), (9, None), (None, " "), (10, "short")], key=key)


def test_empty(spark, stages):
    for _, stage in p.STAGES:
        assert stage(spark, stages[0].limit(0), SMALL).count() == 0


def test_personal_data(stages):
    before, after = dict(rows(stages[3])), dict(rows(stages[4]))
    counts = {}
    for t in before.values():
        base, others = pii.candidates(t or "")
        for spans, is_base in ((base, True), (others, False)):
            for k, a, b in spans:
                at = (k, pii.votes(t, k, a, b, is_base))
                counts[at] = counts.get(at, 0) + 1
    model = pii.estimate(sorted((k, v, n) for (k, v), n in counts.items()))
    for d, t in before.items():
        want = t
        if t:
            spans = sorted(pii.find_spans(t, model)[1], key=lambda s: (s[1], -s[2]))
            whole = []
            for k, a, b in spans:
                if whole and a < whole[-1][2]:
                    whole[-1][2] = max(whole[-1][2], b)
                else:
                    whole.append([k, a, b])
            for k, a, b in reversed(whole):
                want = want[:a] + f"[{k.upper()}]" + want[b:]
        assert after[d] == want
    assert before.keys() == after.keys() and all(r.n_chars == len(r.text or "") for r in stages[4].filter("text IS NOT NULL").collect())


def test_packing(stages):
    """Every id of every document lies in one piece, and pieces lie gapless in sequences of bounded length."""
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in rows(stages[4])}
    assert len(ids) == stages[4].count()
    pieces, sequences = {}, {}
    for r in stages[5].collect():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found, whole in [(sorted(x), len(ids[d])) for d, x in pieces.items()] + [(sorted(x), None) for x in sequences.values()]:
        at = 0
        for a, n in found:
            assert a == at
            at += n
        assert at == whole if whole else at <= 2048
    assert pieces.keys() == ids.keys()
