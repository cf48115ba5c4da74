import hashlib
import random
import re
import zlib
from heapq import heappop, heappush

import pytest

from tubeql.llm import queries, repair
from tubeql.llm.common import table

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
FORM = re.compile(r"(s?(ua)+)?\Z")
STEP = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """rows: (initial, must_go, truncated). Dijkstra over (rows read, last initial): an independent parser."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, last = heappop(heap)
        if (at, last) in seen:
            continue
        seen.add((at, last))
        if at == len(rows) and last in ("", "a"):
            return cost, audit
        for role in STEP[last].replace("s", ""):
            heappush(heap, (cost + 3, audit + "I", at, role))
        if at < len(rows):
            initial, must_go, truncated = rows[at]
            heappush(heap, (cost + 4, audit + "D", at + 1, last))
            if not must_go:
                for role in STEP[last]:
                    if role == initial:
                        heappush(heap, (cost + 3 * truncated, audit + "K", at + 1, role))
                    if role != "s":
                        heappush(heap, (cost + 3 + 3 * truncated, audit + "R", at + 1, role))


def brute(rows):
    """rows: (conv_id, turn, role, text, copies)."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv and r[4]), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        mine = [r for r in mine for _ in range(r[4])]
        seen, faults, codes = set(), [], []
        for _, _, role, text, _ in mine:
            solid = text.strip(WHITE)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            codes.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = cheapest(codes)
        turns = {r[1] for r in mine if r[1] is not None}
        lines, left, last = [], list(mine), ""
        for edit in audit:
            if edit == "I":
                last = "assistant" if last[:1] == "u" else "user"
                lines.append(f"{last}:")
            else:
                _, _, role, text, _ = left.pop(0)
                if edit != "D":
                    last = role if edit == "K" else "assistant" if last[:1] == "u" else "user"
                    lines.append(f"{last}:{text}")
        assert not left and FORM.match("".join(x[0] for x in lines))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = df.collect()
    assert len({r["conv_id"] for r in found}) == len(found)
    return {r["conv_id"]: tuple(r[c] for c in columns) for r in found}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        case = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if case == 1:
            text = ""
        if case == 2:
            text = re.sub("[.!?]", "", text)
        out.append((conv, turn, "user" if case == 4 else role, text, {0: 0, 3: 2}.get(case, 1)))
    return out


def test_whole_table_against_brute_force(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = brute(damage(rows))
    assert got(queries.op11_repair(spark, sf)) == want and len(want) == len({r[0] for r in rows})


@pytest.mark.parametrize("seed", range(4))
def test_random_charts(seed):
    rng = random.Random(seed)
    for n in [*range(9)] * 12 + [60, 300]:
        rows = [(rng.choice("suaax"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(n)]
        rows = [(a, b, c and not b) for a, b, c in rows]
        chart = repair.Chart()
        for r in rows:
            chart.read(*r)
            if rng.random() < 0.1:
                chart.settle()
        assert chart.repair() == cheapest(rows)


def test_audits_that_never_meet():
    """Users only: the paths to asked and answered part at the first row and stay apart."""
    chart = repair.Chart()
    for _ in range(5_000):
        chart.read("u", False, False)
    cost, audit = chart.repair()
    assert (cost, audit) == cheapest([("u", False, False)] * 5_000)
    assert max(len(t) for _, t in chart.items.values()) < 2 * repair.SETTLE


def test_nulls_ties_repeats_and_extra_columns(spark):
    rows = [
        (1, None, "user", "First?"), (1, 0, None, "No role."), (1, 0, "assistant", None), (1, 5, "assistant", "Yes"), (1, 5, "assistant", "Yes"), (1, 5, "user", "A tie."),
        (None, None, None, None), (None, 3, "user", "Alone."), (2, None, "assistant", "."), (3, 7, "system", "Only this."), (4, 1, "user", "a. " * 200_000), (4, 2, "assistant", "b. "),
        (5, 1, "user", ""), (5, 2, "user", "\t\n "), (6, 2, "unknown", "Kept as it is."), (6, 3, "assistant", "Fine!"), (7, -4, "", "No initial."),
    ]
    df = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], "conv_id long, turn int, role string, text string, copy string, n int")
    want = brute([(c, t, *(" " if x is None else x for x in (r, s)), 1) for c, t, r, s in rows])
    assert got(repair.report(df)) == want
    assert got(repair.report(repair.damaged(df))) == brute(damage(rows))
    by = {}
    for r in sorted(repair.repair(df).collect(), key=lambda r: (r["conv_id"] or 0, r["place"])):
        by.setdefault(r["conv_id"], []).append((r["edit"], r["role"], r["text"]))
    for conv, edits in by.items():
        assert "".join(e for e, _, _ in edits) == want[conv][6]
        lines = "\n".join(f"{role}:{text}" for e, role, text in edits if e != "D")
        assert hashlib.sha256(lines.encode()).hexdigest() == want[conv][7]


def test_all_dropped_and_empty(spark):
    schema = "conv_id string, turn long, role string, text string"
    dropped = next(str(k) for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "Gone.")], schema)
    assert got(repair.report(repair.damaged(df))) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair.report(spark.createDataFrame([], schema)).count() == 0
    assert repair.repair(spark.createDataFrame([], schema)).count() == 0


def test_a_long_conversation_is_streamed(spark):
    n = 20_000
    df = spark.range(n).selectExpr("7L conv_id", "id turn", "CASE WHEN id % 3 = 0 THEN 'user' ELSE 'assistant' END role", "concat('t', id % 5000, IF(id % 11 = 0, '', '.')) text")
    rows = [(7, i, "user" if i % 3 == 0 else "assistant", f"t{i % 5000}" + ("" if i % 11 == 0 else "."), 1) for i in range(n)]
    assert got(repair.report(df)) == brute(rows)
