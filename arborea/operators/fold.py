"""Order-dependent scans of many keys in constant memory, for rules that no window function states."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


def fold(df: DataFrame, keys: list[str], order: list[str], begin: Callable[[], object], schema: str) -> DataFrame:
    """Reads the rows of each key in order and returns what its machine says.

    ``begin()`` makes a machine for a key: ``add(row)`` and ``end(key)`` yield output rows as tuples. Rows are dealt by key and sorted
    by Spark, which spills; a task holds one machine and one batch, however many rows a key or a partition has.

    A window deals and sorts them: unlike after ``repartition``, which Spark drops behind a join on the keys, adaptive execution may not
    read a key's rows by mapper or split them among tasks."""
    names = [c.split()[0] for c in schema.split(", ")]
    sorted_ = df.withColumn("fold_turn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, machine = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                at = tuple(getattr(row, k) for k in keys)
                if machine is None or at != key:
                    if machine is not None:
                        out += machine.end(key)
                    key, machine = at, begin()
                out += machine.add(row)
            if out:
                yield pd.DataFrame(out, columns=names, dtype=object)
        if machine is not None and (out := list(machine.end(key))):
            yield pd.DataFrame(out, columns=names, dtype=object)

    return sorted_.mapInPandas(run, schema)
