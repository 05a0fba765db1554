"""Tables and proposals on fixtures and by brute force."""

import random

from arborea.operators import proposals as p
from arborea.operators import tables as b


def _grown(cells, block):
    """Grows one block by rescanning its table."""
    r0, r1, c0, c1 = block
    while True:
        hit = [x for x in cells if x[0] <= r1 and x[0] + x[2] - 1 >= r0 and x[1] <= c1 and x[1] + x[3] - 1 >= c0]
        new = (min([r0, *(x[0] for x in hit)]), max([r1, *(x[0] + x[2] - 1 for x in hit)]), min([c0, *(x[1] for x in hit)]), max([c1, *(x[1] + x[3] - 1 for x in hit)]))
        if new == (r0, r1, c0, c1):
            return new
        r0, r1, c0, c1 = new


def test_grown_blocks_against_rescanning(spark):
    rnd, rows, blocks, want = random.Random(2), [], [], {}
    for tab in range(40):
        cells, taken = [], set()
        for r in range(1, 7):
            for c in range(1, 7):
                if (r, c) in taken:
                    continue
                deep, wide = rnd.choice([(1, 1), (1, 1), (2, 1), (1, 2)])
                spots = {(r + i, c + j) for i in range(deep) for j in range(wide)}
                if spots & taken or max(x for x, _ in spots) > 6 or max(y for _, y in spots) > 6:
                    deep, wide, spots = 1, 1, {(r, c)}
                taken |= spots
                cells.append((r, c, deep, wide))
        rows += [(1, tab, *x) for x in cells]
        block = (rnd.randint(1, 3), rnd.randint(3, 5), rnd.randint(1, 3), rnd.randint(3, 5))
        blocks.append((1, tab, *block))
        want[tab] = _grown(cells, block)
    got = b.grown_blocks(spark.createDataFrame(rows, "doc_id long, tab long, row_no int, col_no int, row_span int, col_span int"), spark.createDataFrame(blocks, "doc_id long, tab long, r0 int, r1 int, c0 int, c1 int"))
    assert {x.tab: (x.r0, x.r1, x.c0, x.c1) for x in got.collect()} == want


def test_cell_runs(spark):
    # a blank follows its glyph, one outside breaks the run, a leading blank has its own place
    rows = [("a", i, t, c) for i, (t, c) in enumerate([(" ", 1), ("x", 1), (" ", 2), ("ff", 2), ("y", None), (" ", 2), ("z", 3)])] + [("b", 0, "", 1), ("b", 1, "q", None)]
    got = b.cell_runs(spark.createDataFrame(rows, "leaf string, seq int, text string, cell long")).collect()
    assert {(x.leaf, x.cell, x.start, x.end) for x in got} == {("a", 1, 0, 3), ("a", 2, 3, 5), ("a", 2, 6, 7), ("a", 3, 7, None)}


def test_faults_of_grids():
    assert b.place([[(1, 1), (1, 1)], [(2, 1)]])[2] is None
    assert b.place([[(1, 1), (1, 1)], [(1, 1)]])[2] == "ragged width"
    assert b.place([[(1, 2)]])[2] == "past the last row"
    assert b.place([[(0, 1)]])[2] == "invalid span"
    assert b.place([[]])[2] == "no cells"
    assert b.place([[(1, 1), (1, 2)], [(2, 1)]])[2] == "overlap"


BOX = {"x": 0.0, "y": 0.0, "width": 100.0, "height": 40.0, "seed_columns": [33.0, 70.0], "seed_rows": []}


def _word(no, text, x, y):
    return {"word_no": no, "text": text, "x": x, "y": y, "width": 20.0, "height": 10.0}


def _cell(r, k, words=(), text="", rows=1, cols=1):
    return {"row_no": r, "cell_no": k, "row_span": rows, "col_span": cols, "text": text, "word_nos": list(words)}


def test_proposals():
    words = [_word(1, "a", 0.0, 0.0), _word(2, "b", 60.0, 0.0), _word(3, "c", 0.0, 20.0), _word(4, "c", 60.0, 20.0)]
    got = p.fit([_cell(1, 1, [1]), _cell(1, 2, [2]), _cell(2, 1, [], "c"), _cell(2, 2, [], "c")], words, BOX)
    assert (got["columns"], got["rows"], got["matched_by_text"], got["misfiled"], got["rebuilt"]) == ([40.0], [15.0], 2, 0, False)
    assert p.fit([_cell(1, 1, [9])], words, BOX)["error"] == "unknown word"
    assert p.fit([_cell(1, 1, [1]), _cell(1, 2, [1])], words, BOX)["error"] == "word in two cells"
    assert p.fit([_cell(1, 1, [], "zzz")], words, BOX)["error"] == "no words matched"
    assert p.fit([], words, BOX)["error"] == "no rows"
    # an empty column takes the seeds nearest to its neighbours' edges; boxes that overlap are counted
    assert p.fit([_cell(1, 1, [1]), _cell(1, 2), _cell(1, 3, [2])], words[:2], BOX)["columns"] == [33.0, 70.0]
    assert p.fit([_cell(1, 1, [2]), _cell(1, 2, [1])], words[:2], BOX)["conflicts"] == 1
    assert p.fitting([3.0, 10.0, 12.0, 99.0, 50.0], 0.0, 100.0) == [10.0, 50.0]
