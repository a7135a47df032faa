"""Whole numbers counted over all rows in the workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matloom.llm.workers import tidy


def counts(docs: DataFrame, count: Callable[[Iterator[str]], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of what `count` gives for the texts of each task (docs: text; nulls are left out). It adds whole numbers, so the sum does not depend on how rows are dealt out; what comes to the driver is an array of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = count(text.as_py() for batch in batches for text in batch.column(0)).ravel()
        at = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(got[at], pa.int64())], names=["slot", "n"])
        tidy()

    out = np.zeros(shape, np.int64)
    for slot, n in docs.select("text").where("text IS NOT NULL").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n")).collect():
        out.ravel()[slot] = n
    return out
