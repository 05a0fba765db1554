"""Tree keys of whole documents in arrays: what a task reads of nodes in order of their documents becomes rows of a parent and its children."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Nodes taken at once, about.
STEP = 100_000
#: Nodes of a document, and entries of its parents' paths, that a task holds at most; a larger document is numbered level by level.
MOST = 2_000_000


def _whole(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, bool]]:
    """Whole documents, many at a time; of one with more than ``most`` nodes a row alone, marked."""
    held, n, least, large = [], 0, STEP, None
    for b in batches:
        t = pa.Table.from_batches([b])
        if large is not None:
            t = t.filter(pc.not_equal(t["doc_id"], large))
            if not t.num_rows:
                continue
            large = None
        held.append(t)
        n += t.num_rows
        if n < least:
            continue
        t = pa.concat_tables(held).combine_chunks()
        last = t["doc_id"][n - 1]
        cut = pc.index(t["doc_id"], last).as_py()
        if cut:
            yield t.slice(0, cut), False
        t = t.slice(cut)
        if t.num_rows > most:
            yield t.slice(0, 1), True
            t, large = t.slice(0, 0), last
        held, n, least = [t], t.num_rows, max(STEP, 2 * t.num_rows)
    if n:
        yield pa.concat_tables(held).combine_chunks(), False


def _ints(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A column's values (null: 0), and where there is one."""
    c = t[name].combine_chunks()
    return pc.fill_null(c.cast(pa.int64()), 0).to_numpy(zero_copy_only=False), pc.is_valid(c).to_numpy(zero_copy_only=False)


def _blocks(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices of blocks, one after the other."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())


def _before(size: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of each node of blocks the nodes of its earlier siblings' subtrees."""
    total = np.cumsum(size) - size
    return total - np.repeat(total[np.cumsum(count) - count], count)


def _keys(t: pa.Table, most: int, most_levels: int):
    """Rows in order of their parents and of siblings (those reached from a root); parent, depth, pre and size of each row, whether it or one below it is a leaf or has a box,
    and whether its document is left out."""
    doc = t["doc_id"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    (node, _), (above, inner), (at, known) = _ints(t, "node_id"), _ints(t, "parent_id"), _ints(t, "ord")
    n, docs = len(doc), int(doc[-1]) + 1
    names, rank = np.unique(node, return_inverse=True)
    key = doc * len(names) + rank
    by_key = np.argsort(key, kind="stable")
    sorted_key = key[by_key]
    left_out = np.zeros(docs, bool)
    # ids that occur twice have their children below each
    left_out[doc[by_key[1:]][sorted_key[1:] == sorted_key[:-1]]] = True
    place = np.minimum(np.searchsorted(names, above), len(names) - 1)
    wanted = doc * len(names) + place
    found = np.minimum(np.searchsorted(sorted_key, wanted), n - 1)
    parent = np.where(inner & (names[place] == above) & (sorted_key[found] == wanted), by_key[found], -1)
    rows = np.flatnonzero(~inner | (parent >= 0))
    home = np.where(inner, parent, n + doc)
    rows = rows[np.lexsort((rank[rows], at[rows], known[rows], home[rows]))]
    count = np.bincount(home[rows], minlength=n + docs)
    start = np.cumsum(count) - count
    depth, pre, size = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    # the roots of each document, then each level's children, by parent
    holders, levels = np.flatnonzero(count[n:]) + n, []
    while len(holders):
        c = count[holders]
        kids = rows[_blocks(start[holders], c)]
        depth[kids] = len(levels)
        levels.append((holders, c, kids))
        holders = kids[count[kids] > 0]
        if len(levels) >= most_levels and len(holders):
            left_out[doc[holders]] = True
            break
    leafy = t["leafy"].to_numpy().copy()
    for holders, c, kids in reversed(levels[1:]):
        size[holders] = np.add.reduceat(size[kids] + 1, np.cumsum(c) - c)
        leafy[holders] |= np.logical_or.reduceat(leafy[kids], np.cumsum(c) - c)
    for k, (holders, c, kids) in enumerate(levels):
        pre[kids] = 1 + (np.repeat(pre[holders], c) if k else 0) + _before(size[kids] + 1, c)
    parents = np.flatnonzero((count[:n] > 0) & (depth >= 0))
    left_out |= np.bincount(doc[parents], weights=depth[parents] + 1, minlength=docs) > most
    return rows[(depth[rows] >= 0) & ~left_out[doc[rows]]], parent, depth, pre, size, leafy, left_out[doc]


def families(schema: pa.Schema, own: list[str], known: list[str], kids: int, most_levels: int, most: int | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From nodes in order of documents to rows (doc_id, parent_id, up, part, kids) of a parent, its path and children of it whose pre lies in one stretch of ``kids``.

    own: columns of a child besides pre, node_id, size and leafy; known: those of a path entry besides node_id. Documents that are larger than a task may hold,
    deeper than ``most_levels``, or have an id twice, get a row of part -1 instead."""
    most = MOST if most is None else most

    def left(t: pa.Table) -> pa.RecordBatch:
        docs = t["doc_id"].combine_chunks().unique()
        none = {f.name: pa.nulls(len(docs), f.type) for f in schema}
        return pa.RecordBatch.from_arrays([(none | {"doc_id": docs, "part": pa.array(np.full(len(docs), -1), pa.int32())})[f.name] for f in schema], schema=schema)

    def struct(kind: pa.DataType, arrays: dict[str, pa.Array]) -> pa.Array:
        return pa.StructArray.from_arrays([arrays[f.name] for f in kind], fields=list(kind))

    def run(batches):
        for t, large in _whole(batches, most):
            if large:
                yield left(t)
                continue
            rows, parent, depth, pre, size, leafy, odd = _keys(t, most, most_levels)
            if odd.any():
                yield left(t.filter(pa.array(odd)))
            if not len(rows):
                continue
            up = parent[rows]
            # roots have no parent, but a document
            first = np.flatnonzero(np.r_[True, (up[1:] != up[:-1]) | (pre[rows[1:]] // kids != pre[rows[:-1]] // kids) | ((up[1:] < 0) & (pre[rows[1:]] <= pre[rows[:-1]]))])
            head, at = rows[first], up[first]
            length = np.where(at >= 0, depth[at] + 1, 0)
            ends = np.cumsum(length)
            path = np.zeros(ends[-1], np.int64)
            step, to = at, ends - 1
            while len(step := step[more := step >= 0]):
                to = to[more]
                path[to] = step
                step, to = parent[step], to - 1
            entry = t.select(["node_id", *known]).take(pa.array(path)).combine_chunks()
            child = t.select(["node_id", *own]).take(pa.array(rows)).combine_chunks()
            alone = lambda x, c: x[c].chunk(0) if x[c].num_chunks else pa.array([], x[c].type)
            kind = {f.name: f.type for f in schema}
            ups = struct(kind["up"].value_type, {c: alone(entry, c) for c in ("node_id", *known)})
            below = struct(kind["kids"].value_type, {c: alone(child, c) for c in ("node_id", *own)} | {"pre": pa.array(pre[rows], pa.int32()), "size": pa.array(size[rows], pa.int64()), "leafy": pa.array(leafy[rows])})
            held = t.select(["doc_id", "parent_id"]).take(pa.array(head)).combine_chunks()
            arrays = {"doc_id": alone(held, "doc_id"), "parent_id": alone(held, "parent_id"), "part": pa.array(pre[head] // kids, pa.int32()),
                      "up": pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), ups, type=kind["up"]), "kids": pa.ListArray.from_arrays(pa.array(np.r_[first, len(rows)], pa.int32()), below, type=kind["kids"])}
            yield pa.RecordBatch.from_arrays([arrays[f.name] for f in schema], schema=schema)

    return run
