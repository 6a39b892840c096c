"""Ordered folds: one pass over sorted rows per key with a small state, for rules that no window can state.

Rows are hash-partitioned by key and sorted by Spark (which spills); Python sees Arrow batches and keeps only the
current key's state, so a key of any size needs constant memory. Operators cut keys at natural resets first, so
that one busy camera becomes many independent pieces.
"""

from __future__ import annotations

from operator import attrgetter
from typing import Any, Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame


def column_names(schema: str) -> list[str]:
    """Column names of a flat schema text."""
    return [part.split()[0] for part in schema.split(",")]


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    start: Callable[[], Any],
    step: Callable[[Any, Any], list[tuple]],
    schema: str,
    group: str | None = None,
) -> DataFrame:
    """Fold sorted rows per key; ``step(state, row)`` returns output rows and changes the state in place.

    With ``group`` the step receives the list of consecutive rows that share that column (one frame).
    """
    names = column_names(schema)
    keys = list(keys)

    def frame_of(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame.from_records(rows, columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, waiting, frame = None, None, [], None
        key_of, frame_of_row = attrgetter(*keys), attrgetter(group) if group else None
        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.itertuples(index=False):
                key = key_of(row)
                if group is None:
                    if key != current:
                        current, state = key, start()
                    out += step(state, row)
                    continue
                if waiting and (key != current or frame_of_row(row) != frame):
                    out += step(state, waiting)
                    waiting = []
                if key != current:
                    current, state = key, start()
                if not waiting:
                    frame = frame_of_row(row)
                waiting.append(row)
            if out:
                yield frame_of(out)
        if waiting:
            yield frame_of(step(state, waiting))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
