"""Structure repair against an exhaustive search, on small pieces and on one long conversation."""

import hashlib
import itertools
import random
import re

from folioflow.llm import queries, repair
from tests.oracle import same

SCHEMA = "conv_id long, turn long, role string, text string, cost long, audit string"
SPACE = " \t\n\x0b\x0c\r"


def ordered(rows):
    """(conv_id, turn, role, text) with nulls as the operator takes them, in its order."""
    full = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    return sorted(full, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        end = text.rstrip(SPACE)
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def search(rows):
    """The least (cost, audit, roles and texts) over every edit sequence, grown row by row without pruning by state."""
    grammar = re.compile(r"(s?(ua)*)?")  # of beginnings; the end is checked apart
    found = faults(rows)

    def grow(paths):
        """Up to two inserts after each path."""
        out = list(paths)
        for n in (1, 2):
            for cost, audit, made in paths:
                for roles in itertools.product(("user", "assistant"), repeat=n):
                    out.append((cost + 5 * n, audit + "I" * n, made + tuple((r, "") for r in roles)))
        return out

    def begins(made):
        initials = "".join(r[:1] or "?" for r, _ in made)
        return grammar.fullmatch(initials) or grammar.fullmatch(initials + "a") or initials == "s"

    paths = grow([(0, "", ())])
    for (_, _, role, text), fault in zip(rows, found, strict=True):
        after = []
        for cost, audit, made in paths:
            after.append((cost + 2, audit + "D", made))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault else 0
                after.append((cost + extra, audit + "K", made + ((role, text),)))
                after += [(cost + extra + 1, audit + "R", made + ((r, text),)) for r in ("user", "assistant")]
        paths = [p for p in grow([p for p in after if begins(p[2])]) if begins(p[2])]
        best: dict = {}
        for p in sorted(paths):  # of equal roles made, the least
            best.setdefault("".join(r[:1] or "?" for r, _ in p[2]), p)
        paths = list(best.values())
    whole = [p for p in paths if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in p[2]))]
    cost, audit, made = min(whole)
    return cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()


def wanted(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = ordered([r for r in rows if r[0] == conv])
        found = faults(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        out[conv] = (gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, *search(mine))
    return out


def reported(spark, rows, **more):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return {r[0]: tuple(r)[1:] for r in repair.report(table, **more).collect()}


def conversation(rng, conv, n):
    texts = ["yes.", "no!", "well", " ", "", None, "why?\n", "so\x0b", "é。", "a.\nb"]
    return [(conv, rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool", "us"]), rng.choice(texts)) for _ in range(n)]


def test_every_edit_sequence(spark):
    rng = random.Random(11)
    rows = [r for conv in range(160) for r in conversation(rng, conv, rng.randrange(1, 6))] + conversation(rng, None, 4)
    want = wanted(rows)
    assert reported(spark, rows) == want
    assert reported(spark, rows, most=1) == want and reported(spark, rows, most=2) == want


def test_damage_and_conversations_without_rows(spark):
    rows = [(1, 2, None, None), (1, None, "user", "a."), (2, 1, "user", "b")]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    ids = spark.createDataFrame([(1,), (7,), (None,)], "conv_id long")
    got = {r[0]: r for r in repair.report(table, ids).collect()}
    assert set(got) == {1, 7, None}
    assert tuple(got[7])[1:] == tuple(got[None])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.report(table.limit(0)).count() == 0
    kinds = {r.turn: r for r in repair.damaged(spark.range(0, 400).selectExpr("5 as conv_id", "id as turn", "'system' as role", "'A. b! c?' as text")).collect()}
    assert len(kinds) < 400 and {r.text for r in kinds.values()} == {"A. b! c?", "", "A b c"} and {r.role for r in kinds.values()} == {"system", "user"}


def test_one_long_conversation(spark):
    """A conversation over many partitions and pieces: the same report whatever the piece, and copies counted whole."""
    rng = random.Random(2)
    rows = [(1, t, rng.choice(["user", "assistant", "user", "assistant", "tool"]), f"text {rng.randrange(2000)}{rng.choice('.!? x')}") for t in range(3000)] + [(1, 5, "user", "again.")] * 300
    ones, many = reported(spark, rows, most=100_000), reported(spark, rows, most=7)
    assert ones == many
    mine = ordered(rows)
    assert sum(c in "KRD" for c in ones[1][6]) == len(mine)
    found = list(repair.edited([(r[2], r[3]) for r in mine], ones[1][6]))
    assert re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] for _, r, _ in found))
    assert hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in found).encode()).hexdigest() == ones[1][7]
    layer = repair.closed([(0, ""), None, None, None])
    for row, fault in zip(mine, faults(mine), strict=True):
        layer = repair.advanced(layer, row[2][:1], fault)
    assert min(b for q, b in enumerate(layer) if q in repair.ACCEPTING) == ones[1][5:7]


def test_query_against_sql(spark, sf):
    same(queries.QUERIES["op11_structure_repair"](spark, sf), queries.SQL["op11_structure_repair"], sf)
    same(queries.QUERIES["op11_structure_repair"](spark, "/root/testdata/sf0.01"), queries.SQL["op11_structure_repair"], "/root/testdata/sf0.01")
