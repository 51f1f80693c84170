"""Operator 11, conversation structure repair: the cheapest edits that give a conversation the roles ``(s?(ua)+)?``.

Rows are ``(conv_id, turn, role, text)``. In order of turn each row is kept (0), given the role that fits (1) or deleted (2), and
rows of a fitting role and no text may be inserted anywhere (5). Blank and duplicate rows must be deleted, a truncated row that
isn't deleted adds 5. The grammar has four states (nothing, system, user, assistant), so a role that fits follows from the
state. A forward Viterbi pass carries the least (cost, audit string) of each state over the rows and closes each row's layer
with at most two inserts, more being never cheaper. Two audits of one cost, place and state are never one the beginning of
the other (the longer would have paid for its inserts), so the least by ASCII is found state by state.

No conversation is gathered. Equal rows become one row with a number of copies before any shuffle, the first turn of each
(role, text) is an aggregate joined back, and rows are dealt by ranges of (conv_id, turn, role, text), so that a
long conversation spans many tasks. A task cuts its rows into pieces of at most ``PIECE`` rows. A piece that may continue
a conversation is passed once from each state, giving a 4 x 4 table of (cost, audit); tables of a conversation are folded in
order, which holds what four audits differ in. A conversation that lies inside its task is settled there and moves no more.
Only the digest of a conversation over many pieces sees its rows in one task, as a stream, since SHA-256 is sequential.

Null roles and texts are one space; a null turn comes first; a null conv_id is one conversation; ties of turn go by role and
text; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.sources.workspace import small_batches, stored

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = (NOTHING, ASSISTANT)
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
DELETE_COST, REROLE_COST, INSERT_COST, TRUNCATED_COST = 2, 1, 5, 5
PIECE = 1024
PIECE_CHARS = 4_000_000
#: White space of the word pattern, ends of a whole sentence, pairs of initials that may follow each other.
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
LEGAL = ("su", "ua", "au")

Layer = list[tuple[int, str] | None]


def fitting(state: int) -> int:
    """The state after a row whose role is made to fit."""
    return ASSISTANT if state == USER else USER


def kept(state: int, initial: str) -> int | None:
    """The state after a row that keeps its role; None if the role doesn't fit."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "u":
        return None if state == USER else USER
    return ASSISTANT if initial == "a" and state == USER else None


_KEPT = {initial: [kept(q, initial) for q in range(4)] for initial in "sua"}
_NEVER = [None] * 4


def closed(layer: Layer) -> Layer:
    """The layer with inserts after it."""
    for _ in range(2):
        after = list(layer)
        for q, best in enumerate(layer):
            if best:
                to, found = fitting(q), (best[0] + INSERT_COST, best[1] + INSERT)
                if after[to] is None or found < after[to]:
                    after[to] = found
        layer = after
    return layer


def advanced(layer: Layer, initial: str, fault: str | None, copies: int = 1) -> Layer:
    """The closed layer after a row and its further copies, which are duplicates."""
    after: Layer = [b and (b[0] + DELETE_COST, b[1] + DELETE) for b in layer]
    if fault not in ("blank", "duplicate"):
        extra, keep = TRUNCATED_COST if fault else 0, _KEPT.get(initial, _NEVER)
        for q, best in enumerate(layer):
            if best:
                for to, cost, edit in ((keep[q], extra, KEEP), (fitting(q), extra + REROLE_COST, REROLE)):
                    if to is not None:
                        found = (best[0] + cost, best[1] + edit)
                        if after[to] is None or found < after[to]:
                            after[to] = found
    after = closed(after)
    if copies > 1:
        after = closed([b and (b[0] + DELETE_COST * (copies - 1), b[1] + DELETE * (copies - 1)) for b in after])
    return after


def edited(rows, audit: str, state: int = NOTHING) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the rows that an audit leaves; rows are (role, text), copies one by one."""
    rows = iter(rows)
    for edit in audit:
        role, text = next(rows) if edit != INSERT else (None, "")
        if edit == DELETE:
            continue
        state = kept(state, role[:1]) if edit == KEEP else fitting(state)
        yield edit, role if edit == KEEP else ("assistant" if state == ASSISTANT else "user"), text


def fault_of(text: Column, first: Column) -> Column:
    """blank, duplicate, truncated or null: the first that holds."""
    trimmed = F.rtrim(text, F.lit(SPACE))
    return F.when(trimmed == "", "blank").when(~first, "duplicate").when(~F.right(trimmed, F.lit(1)).isin(*ENDS), "truncated")


def with_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, fault): different rows, how often each occurs, and the fault of its first copy."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    counted = rows.select("conv_id", "turn", blank("role"), blank("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    marked = counted.withColumn("mark", F.sha2(F.encode("text", "utf-8"), 256))
    first = marked.groupBy("conv_id", "role", "mark").agg(F.min(F.struct("turn")).alias("first")).select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("mark").alias("m"), F.col("first.turn").alias("first_turn"))
    joined = marked.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("mark") == F.col("m")))
    return joined.select("conv_id", "turn", "role", "text", "copies", fault_of(F.col("text"), F.col("turn").eqNullSafe(F.col("first_turn"))).alias("fault"))


class _Piece:
    """Rows of one conversation, the layers over them, and what the report counts."""

    def __init__(self, conv, number: int, whole_start: bool):
        self.conv, self.number, self.start, self.whole = conv, number, whole_start, False
        self.rows: list[tuple] = []
        self.chars = self.n_turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns: list = []
        if whole_start:
            self.layers = [closed([(0, ""), None, None, None])]
        else:
            self.layers = [[(0, "") if p == q else None for p in range(4)] for q in range(4)]

    def add(self, turn, role: str, text: str, copies: int, fault: str | None) -> None:
        initial = role[:1]
        self.layers = [advanced(layer, initial, fault, copies) for layer in self.layers]
        self.illegal += (copies - 1) * ((initial + initial) not in LEGAL) + (bool(self.rows) and self.rows[-1][0][:1] + initial not in LEGAL)
        if fault == "blank":
            self.blank += copies
        elif fault == "duplicate":
            self.duplicate += copies
        else:
            self.duplicate += copies - 1
            self.truncated += fault == "truncated"
        if turn is not None and (not self.turns or turn != self.turns[-1]):
            self.n_turns += 1
            self.turns = [self.turns[0] if self.turns else turn, turn]
        self.rows.append((role, text, copies))
        self.chars += len(text)


_COUNTS = ("n_turns", "blank", "duplicate", "truncated", "illegal")


def _pieces(most: int):
    rows_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("copies", pa.int64())]))

    def packed(pieces: list[_Piece], convs: pa.DataType, turns: pa.DataType, pid: int) -> pa.RecordBatch:
        table = [[(layer[q] if layer else None) for layer in (p.layers if not p.start else [*p.layers, None, None, None]) for q in range(4)] for p in pieces]
        columns = {
            "conv_id": pa.array([p.conv for p in pieces], convs),
            "pid": pa.array([pid] * len(pieces), pa.int32()),
            "number": pa.array([p.number for p in pieces], pa.int64()),
            "start": pa.array([p.start for p in pieces], pa.bool_()),
            "whole": pa.array([p.whole for p in pieces], pa.bool_()),
            "costs": pa.array([[b and b[0] for b in t] for t in table], pa.list_(pa.int64())),
            "audits": pa.array([[b and b[1] for b in t] for t in table], pa.list_(pa.string())),
            "first_initial": pa.array([p.rows[0][0][:1] for p in pieces], pa.string()),
            "last_initial": pa.array([p.rows[-1][0][:1] for p in pieces], pa.string()),
            "first_turn": pa.array([p.turns[0] if p.turns else None for p in pieces], turns),
            "last_turn": pa.array([p.turns[-1] if p.turns else None for p in pieces], turns),
            **{c: pa.array([int(getattr(p, c)) for p in pieces], pa.int64()) for c in _COUNTS},
            "rows": pa.array([[{"role": r, "text": t, "copies": n} for r, t, n in p.rows] for p in pieces], rows_type),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, open_piece, done, number = TaskContext.get().partitionId(), None, [], 0
        convs = turns = None
        for batch in batches:
            convs, turns = batch["conv_id"].type, batch["turn"].type
            for conv, turn, role, text, copies, fault in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "fault")), strict=True):
                same = open_piece is not None and open_piece.conv == conv
                if not same or len(open_piece.rows) >= most or open_piece.chars >= PIECE_CHARS:
                    if open_piece:
                        open_piece.whole = open_piece.start and not same
                        done.append(open_piece)
                    # the first conversation of a task may have begun in an earlier one
                    open_piece = _Piece(conv, number, open_piece is not None and not same)
                    number += 1
                open_piece.add(turn, role, text, copies, fault)
            if done:
                yield packed(done, convs, turns, pid)
                done = []
        if open_piece:
            yield packed([open_piece], convs, turns, pid)

    return run


def pieces(rows: DataFrame, most: int = PIECE) -> DataFrame:
    """Pieces of at most ``most`` rows of all conversations, in the shared folder; a conversation's pieces are in order of (pid, number).

    A ``whole`` piece is a conversation that began and ended inside its task.
    """
    faulty = with_faults(rows)
    conv, turn = (faulty.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    small_batches(rows.sparkSession)
    order = ("conv_id", "turn", "role", "text")
    kind = f"conv_id {conv}, pid int, number long, start boolean, whole boolean, costs array<long>, audits array<string>, first_initial string, last_initial string, first_turn {turn}, last_turn {turn}, "
    kind += ", ".join(f"{c} long" for c in _COUNTS) + ", rows array<struct<role:string,text:string,copies:long>>"
    return stored(faulty.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces(most), kind), "repair-pieces")


class _Fold:
    """The four best paths of a conversation over the pieces seen so far."""

    def __init__(self, conv):
        self.conv, self.layer, self.sure = conv, closed([(0, ""), None, None, None]), []
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.path: list[tuple] = []
        self.initial = self.first_turn = self.last_turn = None

    def add(self, piece: dict) -> None:
        table = [[(c, a) if c is not None else None for c, a in zip(piece["costs"][4 * q : 4 * q + 4], piece["audits"][4 * q : 4 * q + 4], strict=True)] for q in range(4)]
        if piece["start"]:
            self.layer, back = table[0], [NOTHING] * 4
        else:
            after, back = _NEVER.copy(), _NEVER.copy()
            for q, before in enumerate(self.layer):
                for to, step in enumerate(table[q]):
                    if before and step:
                        found = (before[0] + step[0], before[1] + step[1])
                        if after[to] is None or found < after[to]:
                            after[to], back[to] = found, q
            self.layer = after
        self.path.append((piece["pid"], piece["number"], piece["start"], back))
        shared = os.path.commonprefix([b[1] for b in self.layer if b])
        self.sure.append(shared)
        self.layer = [b and (b[0], b[1][len(shared) :]) for b in self.layer]
        for c in _COUNTS:
            self.counts[c] += piece[c]
        if self.initial is not None and self.initial + piece["first_initial"] not in LEGAL:
            self.counts["illegal"] += 1
        if self.last_turn is not None and self.last_turn == piece["first_turn"]:
            self.counts["n_turns"] -= 1
        self.initial = piece["last_initial"]
        self.first_turn = piece["first_turn"] if self.first_turn is None else self.first_turn
        self.last_turn = piece["last_turn"] if piece["last_turn"] is not None else self.last_turn

    def ended(self) -> list[dict]:
        """A row for each piece: the states around it, and with the last the report of the conversation."""
        state = min((q for q in ACCEPTING if self.layer[q]), key=lambda q: self.layer[q])
        cost, rest = self.layer[state]
        out: list[dict] = []
        for k in range(len(self.path) - 1, -1, -1):
            pid, number, start, back = self.path[k]
            before = back[state]
            lead = "" if k or start else INSERT * (0, 0, 1, 2)[before]
            out.append({"conv_id": self.conv, "pid": pid, "number": number, "before": before, "after": state, "lead": lead, "last": False})
            state = before
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.counts["n_turns"]
        out[0] |= {"last": True, "gaps": gaps, "cost": cost, "audit": "".join(self.sure) + rest} | {c: self.counts[c] for c in _COUNTS[1:]}
        return out


_PATH = ("conv_id", "pid", "number", "before", "after", "lead", "last", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def paths(cut: DataFrame) -> DataFrame:
    """Pieces of the same conversations folded in order: a row per piece with its states; the last piece's row has the report."""
    conv = cut.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, convs, done = None, None, []
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), *[pa.int64()] * 6, pa.string()]

        def packed(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kind) for c, kind in zip(_PATH, [convs, *kinds], strict=True)], names=list(_PATH))

        for batch in batches:
            convs = batch["conv_id"].type
            for piece in batch.to_pylist():
                if fold is None or fold.conv != piece["conv_id"]:
                    if fold:
                        done += fold.ended()
                    fold = _Fold(piece["conv_id"])
                fold.add(piece)
            if done:
                yield packed(done)
                done = []
        if fold:
            yield packed(fold.ended())

    kind = f"conv_id {conv}, pid int, number long, before int, after int, lead string, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    return cut.drop("rows").repartition("conv_id").sortWithinPartitions("conv_id", "pid", "number").mapInArrow(run, kind)


def settled(cut: DataFrame) -> DataFrame:
    """The whole pieces with their states and report: no other piece decides with them, so nothing moves."""
    ends = F.filter(F.array(*(F.struct(F.col("costs")[q].alias("cost"), F.col("audits")[q].alias("audit"), F.lit(q).alias("after")) for q in ACCEPTING)), lambda x: x["cost"].isNotNull())
    gaps = F.when(F.col("first_turn").isNull(), 0).otherwise(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns")).cast("long")
    found = cut.where("whole").withColumn("best", F.array_min(ends))
    return found.select("*", F.lit(NOTHING).alias("before"), "best.after", F.lit("").alias("lead"), gaps.alias("gaps"), "best.cost", "best.audit")


def joined(cut: DataFrame, path: DataFrame) -> DataFrame:
    """The other pieces with the states that ``paths`` found."""
    return cut.where("not whole").join(path.select("pid", "number", "before", "after", "lead"), ["pid", "number"])


def repaired(ready: DataFrame) -> DataFrame:
    """(conv_id, pid, number, place, edit, role, text): the rows of the repaired conversations, ordered by (pid, number, place), from pieces with their states."""
    chosen = F.col("audits")[F.when(F.col("start"), F.lit(0)).otherwise(F.col("before")) * 4 + F.col("after")]
    ready = ready.select("conv_id", "pid", "number", F.concat("lead", chosen).alias("audit"), F.when(F.col("lead") != "", F.lit(NOTHING)).otherwise(F.col("before")).alias("before"), "rows")
    conv = ready.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1).to_pylist()[0]
                each = ((r["role"], r["text"]) for r in one["rows"] for _ in range(r["copies"]))
                found = list(edited(each, one["audit"], one["before"]))
                n = len(found)
                if n:
                    same = [pa.array([one[c]] * n, batch[c].type) for c in ("conv_id", "pid", "number")]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(range(n), pa.int64()), *(pa.array([f[k] for f in found], pa.string()) for k in range(3))], names=["conv_id", "pid", "number", "place", "edit", "role", "text"])

    return ready.mapInArrow(run, f"conv_id {conv}, pid int, number long, place long, edit string, role string, text string")


def text_digests(rows: DataFrame, dealt: bool = True) -> DataFrame:
    """(conv_id, repaired_sha256) of ``role:text``, joined by line ends, of rows as ``repaired`` gives them; streamed.

    With ``dealt`` rows are dealt and sorted by conversation first; rows of whole pieces come in order as they are.
    """
    conv = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_conv, state, convs = None, None, None

        def packed(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], convs), pa.array([f[1] for f in found], pa.string())], names=["conv_id", "repaired_sha256"])

        for batch in batches:
            done, convs = [], batch["conv_id"].type
            for conv_id, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if state is None or conv_id != open_conv:
                    if state is not None:
                        done.append((open_conv, state.hexdigest()))
                    open_conv, state = conv_id, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            if done:
                yield packed(done)
        if state is not None:
            yield packed([(open_conv, state.hexdigest())])

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "pid", "number", "place") if dealt else rows
    return ordered.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {conv}, repaired_sha256 string")


def damaged(rows: DataFrame, of: int = 20) -> DataFrame:
    """Rows with faults put in by the checksum of ``conv_id:turn``: 0 dropped, 1 emptied, 2 without ends, 3 twice, 4 by the user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(blank("conv_id"), F.lit(":"), blank("turn")), "utf-8")) % of
    put = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return put.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("time")).drop("time")


def report(rows: DataFrame, wanted: DataFrame | None = None, most: int = PIECE) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation.

    ``wanted`` has the conv_ids to report; one without rows gets zeros, an empty audit and the digest of nothing.
    """
    cut = pieces(rows, most)
    own = settled(cut)
    path = stored(paths(cut.where("not whole")), "repair-paths")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    found = path.where("last").select("conv_id", *counts, "audit").unionByName(own.select("conv_id", *counts, "audit"))
    digests = text_digests(repaired(own), False).unionByName(text_digests(repaired(joined(cut, path))))
    digests = digests.select(F.col("conv_id").alias("digested"), "repaired_sha256")
    ids = (wanted if wanted is not None else rows).select(F.col("conv_id").alias("wanted")).distinct()
    out = ids.join(found, F.col("wanted").eqNullSafe(F.col("conv_id")), "left").join(digests, F.col("wanted").eqNullSafe(F.col("digested")), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("wanted").alias("conv_id"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
