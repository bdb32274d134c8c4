"""Blocks of stored rows and the requests that concern them, brought together without pair rows.

Both sides go through one exchange on ``cell``.  A task reads the rows of a block first (a block is bounded by
whoever cuts it), then the requests of that block stream past it, however many there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: So many requests at most meet a block at a time: what they give together lies in memory at once.
REQUESTS = 256


def _blank(kind: T.DataType) -> Column:
    """A filler that keeps a column free of nulls, so that integers stay integers in the tasks."""
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, T.StringType):
        return F.lit("")
    return F.lit(0).cast(kind)


def meet(blocks: DataFrame, asked: DataFrame, load: Callable[[pd.DataFrame], object],
         answer: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``answer(load(rows of a block), some requests)`` for all requests; both frames have ``cell``.

    Columns of one name must have one type.  A request whose block has no rows gets no answer.
    """
    columns = {f.name: f.dataType for f in (*blocks.schema.fields, *asked.schema.fields)}

    def laid(df: DataFrame, tag: int) -> DataFrame:
        have = set(df.columns)
        return df.select(*[F.col(n) if n in have else _blank(t).alias(n) for n, t in columns.items()], F.lit(tag).alias("_tag"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell: object = None
        held: list[pd.DataFrame] = []
        state: object = None
        for frame in frames:
            if not len(frame):
                continue
            cells, tags = frame["cell"].to_numpy(), frame["_tag"].to_numpy()
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (tags[1:] != tags[:-1])) + 1
            for low, high in zip(np.append(0, cuts), np.append(cuts, len(frame))):
                if cells[low] != cell:
                    cell, held, state = cells[low], [], None
                part = frame.iloc[low:high]
                if tags[low] == 0:
                    held.append(part)
                    continue
                if held:
                    state, held = load(pd.concat(held, ignore_index=True)), []
                for first in range(0, len(part) if state is not None else 0, REQUESTS):
                    found = answer(state, part.iloc[first:first + REQUESTS])
                    if len(found):
                        yield found

    both = laid(blocks, 0).unionByName(laid(asked, 1))
    return both.repartition("cell").sortWithinPartitions("cell", "_tag").mapInPandas(run, schema)
