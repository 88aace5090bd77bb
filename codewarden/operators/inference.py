"""Inference hook: run a caller's function over a prompt table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType


def infer(prompts: DataFrame, complete: Callable[[str, str], str], keys: list[str],
          system: str = "system", user: str = "user") -> DataFrame:
    """(keys, raw, error, duration_ms): a failing call becomes an error in its row.

    Prompts are independent, so partitions are the only unit of parallelism;
    text streams through in Arrow batches.
    """
    import time

    narrow = prompts.select(*keys, system, user)
    schema = StructType([*[f for f in narrow.schema.fields if f.name in keys], StructField("raw", StringType()),
                         StructField("error", StringType()), StructField("duration_ms", LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for s, u in zip(pdf[system], pdf[user]):
                start = time.monotonic()
                try:
                    rows.append((complete(s, u), None, int((time.monotonic() - start) * 1000)))
                except Exception as err:  # the row records it, the job goes on
                    rows.append((None, str(err), int((time.monotonic() - start) * 1000)))
            out = pdf[keys].copy()
            out[["raw", "error", "duration_ms"]] = pd.DataFrame(rows, index=pdf.index, columns=["raw", "error", "duration_ms"])
            yield out

    return narrow.mapInPandas(run, schema)
