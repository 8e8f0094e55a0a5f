"""Models and services as plugs: called in Arrow batches inside tasks, a failing row leaving the others whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import kept

ERROR_CHARS = 512


@dataclass(frozen=True)
class Plug:
    """``open`` makes a client, once for each task; ``call`` takes it and a list of rows (dicts) and returns as many answers.

    A call that raises, or returns another number of answers, is tried ``retries`` times again; after that its rows are
    called one by one, so that only those that fail alone have an error. ``returns`` is the answers' type in SQL.
    """

    call: Callable[[Any, list[dict]], list]
    returns: str = "string"
    open: Callable[[], Any] = lambda: None
    batch: int = 64
    retries: int = 1


def attempt(plug: Plug, client: Any, rows: list[dict], kind: pa.DataType) -> tuple[list, list[str | None], int]:
    """(answers, errors, calls) of some rows; an answer that isn't of the plug's type is an error, too."""
    calls, error = 0, ""
    for _ in range(plug.retries + 1):
        calls += 1
        try:
            got = list(plug.call(client, rows))
            if len(got) != len(rows):
                raise ValueError(f"{len(got)} answers for {len(rows)} rows")
            pa.array(got, kind)
            return got, [None] * len(rows), calls
        except Exception as e:  # noqa: BLE001  whatever a service raises
            error = f"{type(e).__name__}: {e}"[:ERROR_CHARS]
    if len(rows) == 1:
        return [None], [error], calls
    each = [attempt(plug, client, [r], kind) for r in rows]
    return [x[0][0] for x in each], [x[1][0] for x in each], calls + sum(x[2] for x in each)


def enrich(df: DataFrame, inputs: list[str], plug: Plug, result: str = "result") -> DataFrame:
    """df with ``result``, ``error`` (null where it went well) and ``calls`` (those made for the row's batch, told once for each batch).

    Only the columns ``inputs`` reach the plug. Rows are cut into batches as Spark gives them, and answers stay with their rows.
    df must not have columns of these three names.
    """
    kind = to_arrow_type(T._parse_datatype_string(plug.returns))
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string(f"`{result}` {plug.returns}, error string, calls int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, opened = None, False
        for b in batches:
            asked = b.select(inputs).to_pylist()
            answers, errors, calls = [], [], []
            for lo in range(0, len(asked), plug.batch):
                if not opened:
                    client, opened = plug.open(), True
                rows = asked[lo : lo + plug.batch]
                got, failed, n = attempt(plug, client, rows, kind)
                answers, errors, calls = answers + got, errors + failed, calls + [n] + [0] * (len(rows) - 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(answers, kind), pa.array(errors, pa.string()), pa.array(calls, pa.int32())], names=[*b.schema.names, result, "error", "calls"])

    return df.mapInArrow(run, schema)


def split(enriched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, failed) rows of enrich(), by one pass: both are written once, in two folders, and read from there."""
    both = kept.keep(enriched.withColumn("failed", F.col("error").isNotNull()), "enriched", "failed")
    return both.where("not failed").drop("failed", "error"), both.where("failed").drop("failed")


def completer(plug: Plug) -> Callable[[DataFrame], DataFrame]:
    """A plug that answers prompts, as summary.build takes it: from (..., prompt) to (..., response, error)."""
    return lambda df: enrich(df, ["prompt"], plug, "response").drop("prompt", "calls")
