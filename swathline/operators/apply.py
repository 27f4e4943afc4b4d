"""User functions over tiles and partitions, with failures turned into rows."""

from __future__ import annotations

import socket
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

RESULT = "tile_id bigint, pixel_count bigint, status string, duration double, executor string"


def tile_apply(pixels: DataFrame, fn: Callable[[pd.DataFrame], int]) -> DataFrame:
    """Run ``fn`` on the pixels of each tile (a group of bounded size) and report one row.

    An exception becomes an ERROR row; the other tiles go on.
    """

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        began = time.perf_counter()
        try:
            count, status = int(fn(cells)), "SUCCESS"
        except Exception as error:
            count, status = 0, f"ERROR: {error}"
        took = time.perf_counter() - began
        row = {
            "tile_id": [int(cells["tile_id"].iloc[0])],
            "pixel_count": [count],
            "status": [status],
            "duration": [took],
            "executor": [socket.gethostname()],
        }
        return pd.DataFrame(row)

    return pixels.groupBy("tile_id").applyInPandas(run, RESULT)


def partition_apply(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run ``fn`` over the Arrow batches of every partition; a batch at a time is in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)
