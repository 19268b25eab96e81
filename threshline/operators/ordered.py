"""Folds in order: results that depend on all earlier rows of a key, with constant memory for each key.

A key's rows meet in one sorted partition (the sort spills to disk) and pass by
in batches; only the running state is held. Windows cannot express these, and
collecting a key's rows into an array would grow with the key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def fold_sorted(rows: DataFrame, key: str, order: list[str], start: Callable[[], Any], step: Callable[[Any, tuple], tuple[Any, Any]], out: str, kind: str, keep: list[str]) -> DataFrame:
    """``keep`` columns of each row and ``out``: what ``step(state, row)`` gives with the state of the key's rows before it.

    ``step`` gets the key's ordered columns, then any further ones of ``rows``, as a tuple in the order of ``rows.columns``.
    """
    names = rows.columns
    at = names.index(key)
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for b in batches:
            said = []
            for row in b.itertuples(index=False, name=None):
                if row[at] != now:
                    now, state = row[at], start()
                state, value = step(state, row)
                said.append(value)
            yield b[keep].assign(**{out: said})

    schema = ", ".join(f"`{k}` {fields[k]}" for k in keep) + f", `{out}` {kind}"
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
