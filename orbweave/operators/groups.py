"""Many small groups in one Python call: rows are brought together by key, sorted, and passed by in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Stands for a null key, so that rows without one are a group too.
NO_KEY = -(1 << 63)


def by_group(df: DataFrame, key: str, order: list[Column], kernel: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str | StructType) -> DataFrame:
    """What ``kernel`` makes of the columns (arrays by name) of each group of an integer ``key``, rows in ``order``.

    A call for each group through Spark costs some milliseconds; here a group costs what its kernel does. One group is held at
    a time, so its rows must fit a task's memory.
    """
    marked = df.withColumn("_group", F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict[str, np.ndarray]] = []  # the beginning of a group that goes on

        def whole(pieces: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
            return pieces[0] if len(pieces) == 1 else {n: np.concatenate([p[n] for p in pieces]) for n in pieces[0]}

        def together(done: list[dict[str, np.ndarray]]) -> Iterator[pd.DataFrame]:
            if done:
                yield pd.DataFrame({n: np.concatenate([d[n] for d in done]) for n in done[0]})

        for part in parts:
            if not len(part):
                continue
            columns = {n: part[n].to_numpy() for n in part.columns}
            group, done = columns.pop("_group"), []
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1), len(group)]
            for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
                piece = {c: v[a:b] for c, v in columns.items()}
                if held and (n or now != group[0]):
                    done.append(kernel(whole(held)))
                    held = []
                held.append(piece)
            now = group[-1]
            yield from together(done)
        if held:
            yield from together([kernel(whole(held))])

    return marked.repartition("_group").sortWithinPartitions("_group", *order).mapInPandas(run, schema)
