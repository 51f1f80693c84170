"""Records fetched by URL: a bounded number of requests at a time in each task, failures are rows."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fetched(rows: DataFrame, key: str, url: str, workers: int = 64, seconds: float = 30.0) -> DataFrame:
    """(key, status, content, problem) of each row's URL.

    At most ``workers`` requests of a task are open, and no more answers wait in memory. An answer of 400 or above, a null or
    unusable URL and a broken connection give a problem and no content. A task that runs again asks again, so only requests
    that may be repeated should be made; ``pending`` leaves out what an earlier run has.
    """
    kind = rows.schema[key].dataType

    def one(address: str | None) -> tuple[int | None, bytes | None, str | None]:
        if not address:
            return None, None, "no URL"
        try:
            with urllib.request.urlopen(address, timeout=seconds) as answer:
                return answer.status, answer.read(), None
        except urllib.error.HTTPError as error:
            return error.code, None, f"HTTP {error.code}"
        except (OSError, ValueError) as error:
            return None, None, f"{type(error).__name__}: {error}"

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answers(batch: pa.RecordBatch, pool: ThreadPoolExecutor):
            keys, waiting = batch.column(0), deque()
            for i, address in enumerate(batch.column(1).to_pylist()):
                waiting.append((i, pool.submit(one, address)))
                if len(waiting) >= workers:
                    yield keys, *waiting.popleft()
            while waiting:
                yield keys, *waiting.popleft()

        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                for keys, i, answer in answers(batch, pool):
                    status, content, problem = answer.result()
                    columns = [keys.slice(i, 1), pa.array([status], pa.int32()), pa.array([content], pa.binary()), pa.array([problem], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "status", "content", "problem"])

    out = rows.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"))
    schema = f"key {kind.simpleString()}, status int, content binary, problem string"
    return out.mapInArrow(fetch, schema).withColumnRenamed("key", key)


def pending(rows: DataFrame, earlier: DataFrame, key: str) -> DataFrame:
    """Rows that no earlier run has fetched without a problem; a row with a null key is always asked again."""
    return rows.join(earlier.where("problem is null").select(key), key, "left_anti")
