"""Keyed stream state in maps and values of the state store: ordered release with a stop, loop stops, an index across pages.

State lives in the RocksDB store, a row per waiting item, so a batch touches only the items that came and those that leave.
Items are ``(key, at)`` with ``at`` from 0; they may come in any order and any batch, and a repeated ``at`` is ignored once
it has left (before that the later one counts). Keys and places that are null are dropped before the state.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from folioflow.operators.loops import Detector, Rule

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that leave in one frame.
FRAME = 10_000


@contextmanager
def rocks_store(spark: SparkSession):
    """The session's state store is RocksDB inside, as it was after."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class _InOrder(StatefulProcessor):
    """Hands on a key's items in the order of ``at``, each as soon as all earlier ones are there."""

    waiting_schema: str
    kinds: dict[str, type]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "at long", self.waiting_schema)
        self.progress = handle.getValueState("progress", "following long, stopped boolean, told boolean")

    def _came(self, rows: Iterator[pd.DataFrame]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Places in their order, of repeated ones the last to come, and the columns beside them: arrays, as a batch may hold millions of a key."""
        parts = []
        for frame in rows:
            own = np.asarray(frame["at"], np.int64)
            fits = np.zeros(len(own), bool) if self.stopped else own >= self.following
            if fits.any():
                parts.append((own[fits], *(frame[c].to_numpy()[fits].astype(kind) for c, kind in self.kinds.items())))
        if not parts:
            return np.zeros(0, np.int64), [np.zeros(0, kind) for kind in self.kinds.values()]
        at, *columns = (np.concatenate(column) for column in zip(*parts, strict=True))
        del parts
        order = np.argsort(at, kind="stable")
        order = order[np.r_[at[order[1:]] != at[order[:-1]], True]]
        return at[order], [column[order] for column in columns]

    def ready(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """(at, *fields) of the items that may leave; the caller may set ``self.stopped``."""
        self.following, self.stopped, self.told = self.progress.get() if self.progress.exists() else (0, False, False)
        came, columns = self._came(rows)
        values = lambda k: tuple(v.tolist() if isinstance(v, np.ndarray | np.generic) else v for v in (column[k] for column in columns))
        at, waits = 0, self.waiting.exists()  # a key with nothing waiting asks its state no more
        while not self.stopped:
            if at < len(came) and came[at] == self.following:
                item = values(at)
                at += 1
                if waits and self.waiting.containsKey((self.following,)):
                    self.waiting.removeKey((self.following,))
            elif waits and self.waiting.containsKey((self.following,)):
                item = self.waiting.getValue((self.following,))
                self.waiting.removeKey((self.following,))
            else:
                break
            self.following += 1
            yield self.following - 1, *item
        if self.stopped:
            if self.waiting.exists():
                self.waiting.clear()
        else:
            for k in range(at, len(came)):
                self.waiting.updateValue((int(came[k]),), values(k))
        self.held = {c: column[at:] for c, column in zip(self.kinds, columns, strict=True)}
        self.progress.update((self.following, self.stopped, self.told))

    def close(self) -> None:
        pass


class _Release(_InOrder):
    waiting_schema = "value double, failed boolean"
    kinds = {"value": float, "failed": bool}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, names = [], ["by", "at", "value", "signal"]
        for at, value, failed in self.ready(rows):
            out.append((key[0], at, None if pd.isna(value) else value, "failed" if failed else "row"))
            self.stopped = bool(failed)
            if len(out) == FRAME:
                yield pd.DataFrame(out, columns=names)
                out = []
        if not self.stopped and not self.told and self.held["failed"].any():
            out.append((key[0], self.following, None, "blocked"))
            self.progress.update((self.following, False, True))
        if self.stopped:
            if self.waiting.exists():
                self.waiting.clear()
            self.progress.update((self.following, True, self.told))
        yield pd.DataFrame(out, columns=names)


def _keyed(stream: DataFrame, by: str, at: str, **fields) -> DataFrame:
    rows = stream.select(F.col(by).alias("by"), F.col(at).cast("long").alias("at"), *(c.alias(n) for n, c in fields.items()))
    return rows.where("by is not null and at >= 0")


def released(stream: DataFrame, by: str, at: str, value: str, failed: str | None = None) -> DataFrame:
    """(by, at, value, signal): items leave in the order of their place, as soon as all earlier ones have come.

    signal is ``row``, or ``failed`` for the failed item that is the last of its key to leave. ``blocked`` comes once for a key
    whose failure waits behind a place that hasn't come, which it names, so that a source can stop feeding it.
    """
    bad = F.coalesce(F.col(failed), F.lit(False)) if failed else F.lit(False)
    rows = _keyed(stream, by, at, value=F.col(value).cast("double"), failed=bad)
    kind = f"by {rows.schema['by'].dataType.simpleString()}, at long, value double, signal string"
    out = rows.groupBy("by").transformWithStateInPandas(_Release(), kind, "Append", "None")
    return out.select(F.col("by").alias(by), F.col("at").alias(at), F.col("value").alias(value), "signal")


class _Loops(_InOrder):
    waiting_schema = "token long"
    kinds = {"token": np.int64}

    def __init__(self, digits: dict[int, int], rule: Rule):
        self.digits, self.rule = digits, rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.detector = handle.getValueState("detector", "state binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        detector = Detector.unpacked(bytes(self.detector.get()[0]), self.rule) if self.detector.exists() else Detector(self.rule)
        out = []
        for at, token in self.ready(rows):
            if hit := detector.push(int(token), self.digits.get(int(token))):
                out.append((key[0], at, *hit))
                self.stopped = True
        if self.stopped:
            if self.detector.exists():
                self.detector.clear()
        else:
            self.detector.update((detector.packed(),))
        yield pd.DataFrame(out, columns=["by", "stop", "rule", "period"])


def loop_stops(stream: DataFrame, by: str, at: str, token: str, digits: dict[int, int] | None = None, rule: Rule = Rule()) -> DataFrame:
    """(by, stop, rule, period): the token of each key at which ``operators.loops`` ends its sequence, as soon as it and all before have come.

    Held per key: a detector of fixed size and the tokens that came before their turn; a stopped key holds neither.
    """
    rows = _keyed(stream, by, at, token=F.col(token).cast("long")).where("token is not null")
    kind = f"by {rows.schema['by'].dataType.simpleString()}, stop long, rule string, period long"
    return rows.groupBy("by").transformWithStateInPandas(_Loops(digits or {}, rule), kind, "Append", "None").withColumnRenamed("by", by)


class _Pages(_InOrder):
    """Proposals for each page from the pages before it; the document's last page ends its state."""

    waiting_schema = "tokens array<bigint>, last boolean"
    kinds = {"tokens": object, "last": bool}

    def __init__(self, size: int, ahead: int):
        self.size, self.ahead = size, ahead

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.index = handle.getMapState("index", ", ".join(f"t{k} long" for k in range(self.size)), "page long, ahead array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for at, tokens, last in self.ready(rows):
            tokens = [int(t) for t in (tokens if tokens is not None else [])]
            grams = [tuple(tokens[i : i + self.size]) for i in range(len(tokens) - self.size + 1)]
            first = next(((i, g) for i, g in enumerate(grams) if self.index.containsKey(g)), None)
            if first is not None:
                page, ahead = self.index.getValue(first[1])
                out.append((key[0], at, first[0], int(page), [int(t) for t in ahead]))
            for i, gram in enumerate(grams):
                self.index.updateValue(gram, (at, tokens[i + self.size : i + self.size + self.ahead]))
            self.stopped = bool(last)
        if self.stopped and self.index.exists():
            self.index.clear()
        yield pd.DataFrame(out, columns=["by", "at", "place", "earlier", "ahead"])


def page_proposals(stream: DataFrame, by: str, at: str, tokens: str, last: str, size: int = 4, ahead: int = 8) -> DataFrame:
    """(by, at, place, earlier, ahead): the first gram of each page that an earlier page of its document has, and what followed it there.

    The index holds each gram's latest place, with the tokens after it on its own page, so no match crosses pages. Pages
    are taken in order; after a document's ``last`` page its index is cleared and later pages are ignored.
    """
    rows = _keyed(stream, by, at, tokens=F.col(tokens).cast("array<bigint>"), last=F.coalesce(F.col(last), F.lit(False)))
    kind = f"by {rows.schema['by'].dataType.simpleString()}, at long, place long, earlier long, ahead array<bigint>"
    out = rows.groupBy("by").transformWithStateInPandas(_Pages(size, ahead), kind, "Append", "None")
    return out.withColumnsRenamed({"by": by, "at": at})


def isolated(rows: DataFrame, work, key: str, result: str) -> DataFrame:
    """(key, result, error) of ``work`` on each row of a cohort (a dict to a string): a row that fails keeps its error and the rest go on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                try:
                    out.append((row[key], str(work(row)), None))
                except Exception as error:  # any failure of the work is the row's result
                    out.append((row[key], None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=[key, result, "error"])

    return rows.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, {result} string, error string")


