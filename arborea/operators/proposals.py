"""Tables that someone proposes for a region's words: words to cells, dividers from the cells' boxes, what doesn't agree.

A region is one dragged box, so its words and cells are few (a proposal is refused beyond ``MOST_WORDS``, with a reason); regions are rows, and Spark
deals them out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .tables import place

#: Words of a region up to which a proposal is taken; least distance between dividers.
MOST_WORDS, APART = 2500, 4.0

_RESULT = "region_id long, error string, n_rows int, n_cols int, columns array<double>, rows array<double>, conflicts int, misfiled int, matched_by_text int, rebuilt boolean"


def normal(text: Column) -> Column:
    """Text for comparison: lower case, one space between words."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def assign_words(cells: list[dict], words: list[dict]) -> tuple[dict[int, int], int, str | None]:
    """Cell of each word (by place in the list), the number of cells found by text, and a refusal. Named words come first; a cell without any
    takes the first free stretch of words that reads like its text."""
    at = {w["word_no"]: i for i, w in enumerate(words)}
    owner, by_text = {}, 0
    for k, cell in enumerate(cells):
        for no in cell["word_nos"]:
            if no not in at:
                return {}, 0, "unknown word"
            if at[no] in owner:
                return {}, 0, "word in two cells"
            owner[at[no]] = k
    named = set(owner.values())
    for k, cell in enumerate(cells):
        want = cell["text"].split()
        if k in named or not want:
            continue
        for a in range(len(words) - len(want) + 1):
            if all(a + i not in owner and words[a + i]["text"] == w for i, w in enumerate(want)):
                owner.update({a + i: k for i in range(len(want))})
                by_text += 1
                break
    return owner, by_text, None


def dividers(ends: list[tuple[int, int, float, float]], count: int, seeds: list[float], low: float, extent: float) -> tuple[list[float], int]:
    """Lines between ``count`` stripes, and how many cut through a box. ends: first and last stripe, near and far edge of each cell with words.
    A line goes midway between the boxes that end and those that begin there; where a side has none it takes the nearest seed left, else an
    even share."""
    out, conflicts, left = [], 0, list(seeds)
    for k in range(count - 1):
        over = max((far for _, last, _, far in ends if last == k), default=None)
        under = min((near for first, _, near, _ in ends if first == k + 1), default=None)
        even = low + extent * (k + 1) / count
        if over is not None and under is not None:
            conflicts += over > under
            out.append((over + under) / 2)
        elif left:
            want = next(v for v in (over, under, even) if v is not None)
            out.append(left.pop(min(range(len(left)), key=lambda i: abs(left[i] - want))))
        else:
            out.append(even)
    return out, conflicts


def fitting(lines: list[float], low: float, extent: float) -> list[float]:
    """Lines in order that keep their distance from the box's edges and from each other."""
    kept: list[float] = []
    for v in sorted(lines):
        if low + APART <= v <= low + extent - APART and (not kept or v - kept[-1] >= APART):
            kept.append(v)
    return kept


def fit(cells: list[dict], words: list[dict], box: dict) -> dict:
    """The grid of one region's proposal, or its error."""
    none = dict.fromkeys(("n_rows", "n_cols", "columns", "rows", "conflicts", "misfiled", "matched_by_text", "rebuilt"))
    if len(words) > MOST_WORDS:
        return none | {"error": "too many words"}
    lines: list[list[dict]] = [[] for _ in range(max((c["row_no"] for c in cells), default=0))]
    for c in sorted(cells, key=lambda c: (c["row_no"], c["cell_no"])):
        lines[c["row_no"] - 1].append(c)
    placed, n_cols, error = place([[(c["col_span"], c["row_span"]) for c in line] for line in lines])
    if not lines:
        error = "no rows"
    cells = [c for line in lines for c in line]
    at = [(r, p) for r, row in enumerate(placed) for p in row]
    owner, by_text, refusal = assign_words(cells, words) if not error else ({}, 0, None)
    error = error or refusal or (None if owner else "no words matched")
    if error:
        return none | {"error": error}
    held: list[list[dict]] = [[] for _ in cells]
    for i, k in owner.items():
        held[k].append(words[i])
    ends: dict[str, list] = {"x": [], "y": []}
    for c, (r, p), own in zip(cells, at, held):
        if own:
            for axis, side, first, span in (("x", "width", p, c["col_span"]), ("y", "height", r, c["row_span"])):
                ends[axis].append((first, first + span - 1, min(w[axis] for w in own), max(w[axis] + w[side] for w in own)))
    raw_x, cut_x = dividers(ends["x"], n_cols, box["seed_columns"], box["x"], box["width"])
    raw_y, cut_y = dividers(ends["y"], len(lines), box["seed_rows"], box["y"], box["height"])
    xs, ys = fitting(raw_x, box["x"], box["width"]), fitting(raw_y, box["y"], box["height"])
    rebuilt, misfiled = xs != raw_x or ys != raw_y, 0
    if not rebuilt:
        for c, (r, p), own in zip(cells, at, held):
            for w in own:
                col, row = sum(v < w["x"] + w["width"] / 2 for v in xs), sum(v < w["y"] + w["height"] / 2 for v in ys)
                misfiled += not (p <= col < p + c["col_span"] and r <= row < r + c["row_span"])
    return {"error": None, "n_rows": len(ys) + 1, "n_cols": len(xs) + 1, "columns": xs, "rows": ys, "conflicts": cut_x + cut_y, "misfiled": misfiled, "matched_by_text": by_text, "rebuilt": rebuilt}


def proposed_grids(regions: DataFrame, cells: DataFrame, words: DataFrame) -> DataFrame:
    """region_id, error or the grid of each region's proposal: dividers, conflicts (a divider cuts words of one cell), misfiled words, cells
    matched by text, rebuilt (dividers too close were dropped, so the cells come back plain).

    regions: region_id, x, y, width, height, seed_columns, seed_rows; cells: region_id, row_no, cell_no, row_span, col_span, text,
    word_nos; words: region_id, word_no, text, x, y, width, height."""
    box = F.struct("x", "y", "width", "height", "seed_columns", "seed_rows").alias("box")
    word = words.groupBy("region_id").agg(F.array_sort(F.collect_list(F.struct("word_no", normal(F.col("text")).alias("text"), "x", "y", "width", "height"))).alias("words"))
    cell = cells.groupBy("region_id").agg(F.collect_list(F.struct("row_no", "cell_no", "row_span", "col_span", normal(F.col("text")).alias("text"), "word_nos")).alias("cells"))
    rows = regions.select("region_id", box).join(cell, "region_id", "left").join(word, "region_id", "left")

    def run(batches):
        for pdf in batches:
            found = [{"region_id": r.region_id} | fit(*([dict(x) | ({"word_nos": list(x["word_nos"])} if "word_nos" in x else {}) for x in (v if v is not None else [])] for v in (r.cells, r.words)), {k: list(v) if k.startswith("seed") else v for k, v in dict(r.box).items()}) for r in pdf.itertuples()]
            yield pd.DataFrame(found, columns=[c.split()[0] for c in _RESULT.split(", ")]).astype({k: "Int32" for k in ("n_rows", "n_cols", "conflicts", "misfiled", "matched_by_text")} | {"rebuilt": "boolean"})

    return rows.mapInPandas(run, _RESULT)
