"""Stops for degenerate repetition in token sequences: exact loops, and loops that count.

Exact rule: the newest tokens repeat with a period p over ``max(window, repeats * p)`` tokens. Counting rule: runs of digit tokens
are one number each, so that tokens become symbols; over ``cycles`` periods of p symbols and at least ``window`` tokens
every other symbol equals the one p before, every number differs from it by the same step in each period, and some step
isn't zero. A number is known when the token after it comes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators.sequences import exact_needs, first_loop, may_run
from folioflow.sources.workspace import small_batches

NUMBER = -1
_WRAP = (1 << 64) - 1


@dataclass(frozen=True)
class Rule:
    """Fixed values of the detector: longest period, least tokens, least repeats of an exact loop, least periods that count."""

    periods: int = 128
    window: int = 256
    repeats: int = 4
    cycles: int = 128


class Detector:
    """Bounded state of one sequence: counters for each period, the last tokens and symbols (newest first)."""

    ARRAYS = ("recent", "run", "names", "values", "begins", "matched", "start", "still")

    def __init__(self, rule: Rule = Rule()):
        self.rule, n = rule, rule.periods
        self.period = np.arange(1, n + 1)
        self.recent, self.run = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.names, self.begins, self.values = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64), np.zeros(2 * n, np.uint64)
        self.matched, self.start, self.still = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.tokens = self.symbols = 0
        self.number: tuple[int, int] | None = None

    def push(self, token: int, digit: int | None) -> tuple[str, int] | None:
        """The rule and period that a token completes; ``digit`` is its value if it is one."""
        at = self.tokens
        exact = self._exact(token)
        counted = None
        if digit is not None:
            value, begin = self.number or (0, at)
            self.number = (value * 10 + digit) & _WRAP, begin
        else:
            if self.number:
                counted = self._symbol(NUMBER, *self.number, at)
                self.number = None
            after = self._symbol(token, 0, at, at + 1)
            counted = counted or after
        self.tokens += 1
        return ("exact", exact) if exact else ("counting", counted) if counted else None

    def _exact(self, token: int) -> int | None:
        n = min(self.tokens, self.rule.periods)
        self.run[:n] = np.where(self.recent[:n] == token, self.run[:n] + 1, 0)
        self.recent[1:] = self.recent[:-1]
        self.recent[0] = token
        long = np.flatnonzero(self.run[:n] + self.period[:n] >= np.maximum(self.rule.window, self.rule.repeats * self.period[:n]))
        return int(long[0]) + 1 if len(long) else None

    def _symbol(self, name: int, value: int, begin: int, end: int) -> int | None:
        n = min(self.symbols, self.rule.periods)
        p = self.period[:n]
        fits, moved = self.names[:n] == name, np.zeros(n, bool)
        if name == NUMBER:
            step = np.uint64(value) - self.values[:n]
            fits &= (self.matched[:n] < p) | (step == self.values[:n] - self.values[2 * p - 1])
            moved = step != 0
        fresh = self.matched[:n] == 0
        self.start[:n] = np.where(fresh, self.begins[:n], self.start[:n])
        self.still[:n] = np.where(moved, 0, np.where(fresh, 1 << 40, self.still[:n] + 1))
        self.matched[:n] = np.where(fits, self.matched[:n] + 1, 0)
        long = np.flatnonzero(fits & (self.still[:n] < p) & (end - self.start[:n] >= self.rule.window) & (self.matched[:n] + p >= self.rule.cycles * p))
        for held, new in ((self.names, name), (self.values, np.uint64(value)), (self.begins, begin)):
            held[1:] = held[:-1]
            held[0] = new
        self.symbols += 1
        return int(long[0]) + 1 if len(long) else None

    def packed(self) -> bytes:
        """The state as bytes of one length for each rule."""
        number = (0, 0, 0) if self.number is None else (1, self.number[0], self.number[1])
        head = np.array([self.tokens, self.symbols, *number], np.uint64)
        return head.tobytes() + b"".join(getattr(self, name).tobytes() for name in self.ARRAYS)

    @classmethod
    def unpacked(cls, data: bytes, rule: Rule = Rule()) -> Detector:
        out = cls(rule)
        tokens, symbols, has, value, begin = (int(x) for x in np.frombuffer(data, np.uint64, 5))
        out.tokens, out.symbols, out.number = tokens, symbols, (value, begin) if has else None
        at = 40
        for name in cls.ARRAYS:
            held = getattr(out, name)
            held[:] = np.frombuffer(data, held.dtype, len(held), at)
            at += held.nbytes
        return out


def symbols(tokens: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, values, begins and ends of a sequence's symbols; digit is -1 where a token is none. A number at the end is still open."""
    is_digit = digit >= 0
    heads = ~is_digit | np.r_[True, ~is_digit[:-1]]
    begins = np.flatnonzero(heads)
    ends = np.r_[begins[1:], len(tokens)]
    if len(begins) and is_digit[-1]:
        begins, ends = begins[:-1], ends[:-1]
    numbers = is_digit[begins]
    values = np.zeros(len(begins), np.uint64)
    for i in np.flatnonzero(numbers):
        value = 0
        for d in digit[begins[i] : ends[i]].tolist():
            value = value * 10 + d
        values[i] = value & _WRAP
    return np.where(numbers, NUMBER, tokens[begins]), values, begins, ends


def first_count(tokens: np.ndarray, digit: np.ndarray, rule: Rule = Rule(), among: list[int] | None = None) -> tuple[int, int] | None:
    """(stop, period) of the counting rule over a whole sequence; of two periods at one place the shorter. ``among``: the only periods that may be found, if known.

    A loop needs a number in each of its periods and a stretch of equal names at its period, so few sequences and few
    stretches are looked at closely.
    """
    if among == [] or np.count_nonzero(np.diff(np.r_[False, digit >= 0].astype(np.int8)) == 1) < rule.cycles - 1:
        return None
    names, values, begins, ends = symbols(tokens, digit)
    best = None
    for p in range(1, rule.periods + 1) if among is None else among:
        if p >= len(names):
            break
        edges = np.r_[p - 1, np.flatnonzero(names[p:] != names[:-p]) + p, len(names)]
        for k in np.flatnonzero(np.diff(edges) > (rule.cycles - 1) * p):
            hit = _counted(range(edges[k] + 1, edges[k + 1]), p, names, values, begins, ends, rule)
            if hit is not None and (best is None or hit < best[0]):
                best = hit, p
            if hit is not None:
                break
    return best


def _counted(stretch: range, p: int, names, values, begins, ends, rule: Rule) -> int | None:
    """Where a window inside a stretch of equal names at distance p is long enough."""
    first = stretch.start
    moved = None
    for j in stretch:
        step = (int(values[j]) - int(values[j - p])) & _WRAP
        if names[j] == NUMBER and j - first >= p and step != (int(values[j - p]) - int(values[j - 2 * p])) & _WRAP:
            first, moved = j + 1, None
            continue
        if names[j] == NUMBER and step:
            moved = j
        if j + 1 - first + p >= rule.cycles * p and moved is not None and j - moved < p and ends[j] - begins[first - p] >= rule.window:
            return int(ends[j]) if names[j] == NUMBER else int(ends[j]) - 1
    return None


def first_stop(tokens: np.ndarray, digit: np.ndarray, rule: Rule = Rule(), loops: list[int] | None = None, counts: list[int] | None = None) -> tuple[int, str, int] | None:
    """(stop, rule, period): the first token, by its place from 0, at which a sequence ends; exact loops come first at one place.

    ``loops`` and ``counts``: the only periods that either rule may find, if known.
    """
    exact, counted = first_loop(tokens, rule.periods, rule.window, rule.repeats, loops), first_count(tokens, digit, rule, counts)
    if counted and (exact is None or counted[0] < exact[0]):
        return counted[0], "counting", counted[1]
    return (exact[0], "exact", exact[1]) if exact else None


Sifted = dict[int, list[int]]


def may_stop(tokens: np.ndarray, digit: np.ndarray, ends: np.ndarray, rule: Rule = Rule()) -> tuple[Sifted, Sifted]:
    """For the exact and the counting rule, the periods at which each of many sequences, laid end to end up to its end, may have a stop."""
    is_digit = digit >= 0
    first = np.zeros(len(tokens) + 1, bool)
    first[0] = first[ends] = True
    heads = np.flatnonzero(~is_digit | first[:-1] | ~np.r_[False, is_digit[:-1]])
    names, closes = np.where(is_digit[heads], NUMBER, tokens[heads].astype(np.int64)), np.searchsorted(heads, ends)
    numbers = np.diff(np.r_[0, np.cumsum(names == NUMBER)][np.r_[0, closes]])
    counting = may_run(names, closes, {p: (rule.cycles - 1) * p for p in range(1, rule.periods + 1)})
    return may_run(tokens, ends, exact_needs(rule.periods, rule.window, rule.repeats)), {i: p for i, p in counting.items() if numbers[i] >= rule.cycles - 1}


def _pieces(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of sequences of at most so many tokens together, or of one sequence."""
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield start, stop
        start = stop


def loop_stops(rows: DataFrame, by: str, tokens: str, digits: dict[int, int], rule: Rule = Rule()) -> DataFrame:
    """(by, stop, rule, period) of the sequences (arrays of numbers, or texts: their code points) that either rule ends; ``digits`` has the value of each digit token.

    Null arrays, and those with null tokens, have no stop. Many sequences at a time are laid end to end and sifted; what
    may have a stop is looked at alone.
    """
    text = dict(rows.dtypes)[tokens] == "string"

    def laid(own: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all sequences and where each one ends."""
        if not text:
            return own.flatten().to_numpy(zero_copy_only=False), np.cumsum(own.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        whole = "".join(own.to_pylist())
        return np.frombuffer(whole.encode("utf-32-le"), np.uint32), np.cumsum(pc.utf8_length(own).to_numpy(zero_copy_only=False), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            lengths = pc.utf8_length(batch["tokens"]) if text else batch["tokens"].value_lengths()
            for start, stop in _pieces(np.cumsum(lengths.to_numpy(zero_copy_only=False), dtype=np.int64), 1 << 22):
                ids, ends = laid(batch["tokens"].slice(start, stop - start))
                digit = np.full(len(ids), -1, np.int8)
                for token, value in digits.items():
                    digit[ids == token] = value
                exact, counting = may_stop(ids, digit, ends, rule)
                for i in sorted(exact.keys() | counting.keys()):
                    own = slice(ends[i - 1] if i else 0, ends[i])
                    if hit := first_stop(ids[own].astype(np.int64), digit[own], rule, exact.get(i, []), counting.get(i, [])):
                        found.append((batch[by][start + i].as_py(), *hit))
            kinds = (batch[by].type, pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], names=[by, "stop", "rule", "period"])

    small_batches(rows.sparkSession)
    if text:
        some = rows.select(by, F.col(tokens).alias("tokens")).where(F.length("tokens") >= rule.window)
    else:
        some = rows.select(by, F.col(tokens).cast("array<bigint>").alias("tokens")).where((F.size("tokens") >= rule.window) & ~F.exists("tokens", lambda t: t.isNull()))
    return some.mapInArrow(run, f"{by} {some.schema[by].dataType.simpleString()}, stop long, rule string, period long")
