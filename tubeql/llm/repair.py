"""Conversation structure repair by error-correcting Earley parsing.

A repaired conversation has the role initials (s?(ua)+)?. The weighted grammar, whose terminals are edits of rows:

    empty    -> nothing | empty Delete
    system   -> empty Keep(s) | system Delete
    asked    -> (empty | system | answered) (Keep(u) | Rerole(user) | Insert(user)) | asked Delete
    answered -> asked (Keep(a) | Rerole(assistant) | Insert(assistant)) | answered Delete
    dialogue -> empty | answered

It is left-recursive, so every Earley item begins at the first row and a chart set holds four completed items at most;
each keeps the least (cost, audit), the audit being the initials of the edits so far. Completed items advance the
rules that wait for them: Keep, Rerole and Delete scan the next row into the next set, Insert stays in its set. The
completed dialogue of the last set is the repair: given its audit, the role of every row is settled.

A conversation's rows are streamed in order, and only the present chart set is held, so memory does not grow with a
conversation but for its audit (one letter a row, four candidates at most). Parsing looks at row codes, not texts. What
needs all rows of a conversation (earlier equal rows) is an aggregate and a salted join beforehand.

Defined results
* null role or text: one space. Null conv_id: those rows are one conversation. Null turns come first.
* turns of equal number follow each other by role, then by the MD5 of the text; rows that repeat are counted before
  the shuffle, all but the first are duplicates.
* a blank row is blank even if it repeats another; a row that repeats is a duplicate even if it is truncated.
* a conversation without rows (all rows dropped): zeros, an empty audit. An empty table gives an empty result; other
  columns are not looked at and may have any names; texts of any length pass through whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_CLASS, checkpoint, skew_join

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
EMPTY, SYSTEM, ASKED, ANSWERED = range(4)
#: For each completed nonterminal the rules that wait for it: what they complete, the initial a kept row needs, and
#: the role that Rerole and Insert give (none: only Keep).
WAITING: tuple[tuple[tuple[int, str, str | None], ...], ...] = (
    ((SYSTEM, "s", None), (ASKED, "u", "user")),
    ((ASKED, "u", "user"),),
    ((ANSWERED, "a", "assistant"),),
    ((ASKED, "u", "user"),),
)
#: Initials of neighbours that need no repair.
LEGAL = {"su", "ua", "au"}
#: An item that costs more than another by this can't win any more: Insert makes asked and answered of each other, and
#: one Delete stands in for a kept system row.
HOPELESS = INSERT + DELETE + 1
#: Rows after which the audits of a set are cut to what tells them apart.
SETTLE = 1_024


@dataclass
class Chart:
    """The present set: for each completed nonterminal (cost, tail).

    A tail is one character that ranks the audit up to the last settling, and the letters since. Audits of one set come
    from equally many rows, so without their trailing Inserts none is the beginning of another and ranks compare as the
    audits do.
    """

    items: dict[int, tuple[int, str]] = field(default_factory=dict)
    past: dict[str, tuple] = field(default_factory=lambda: {"0": ()})  # by rank: (the path before, letters)
    since: int = 0

    def __post_init__(self):
        self.items = self.inserted({EMPTY: (0, "0")})

    @staticmethod
    def inserted(items: dict[int, tuple[int, str]]) -> dict[int, tuple[int, str]]:
        """The set with all items that Inserts complete in it."""
        todo = list(items)
        while todo:
            n = todo.pop()
            cost, tail = items[n]
            for left, _, role in WAITING[n]:
                if role:
                    new = (cost + INSERT, tail + "I")
                    if left not in items or new < items[left]:
                        items[left] = new
                        todo.append(left)
        return items

    def read(self, initial: str, must_go: bool, truncated: bool) -> None:
        """Scans a row."""
        found: dict[int, tuple[int, str]] = {}
        extra = TRUNCATED if truncated else 0

        def offer(n: int, cost: int, tail: str) -> None:
            if n not in found or (cost, tail) < found[n]:
                found[n] = (cost, tail)

        for n, (cost, tail) in self.items.items():
            offer(n, cost + DELETE, tail + "D")
            if not must_go:
                for left, wanted, role in WAITING[n]:
                    if initial == wanted:
                        offer(left, cost + extra, tail + "K")
                    if role:
                        offer(left, cost + REROLE + extra, tail + "R")
        found = self.inserted(found)
        most = min(found[n][0] for n in (ASKED, ANSWERED)) + HOPELESS
        self.items = {n: item for n, item in found.items() if item[0] <= most}
        self.since += 1
        if self.since == SETTLE:
            self.settle()

    def settle(self) -> None:
        bases = sorted({tail.rstrip("I") for _, tail in self.items.values()})
        names = {base: chr(48 + k) for k, base in enumerate(bases)}
        self.past = {name: (self.past[base[0]], base[1:]) for base, name in names.items()}
        self.items = {n: (cost, names[base := tail.rstrip("I")] + tail[len(base) :]) for n, (cost, tail) in self.items.items()}
        self.since = 0

    def repair(self) -> tuple[int, str]:
        """(cost, audit) of the completed dialogue."""
        cost, tail = min(self.items[n] for n in (EMPTY, ANSWERED) if n in self.items)
        path, letters = self.past[tail[0]], [tail[1:]]
        while path:
            path, more = path
            letters.append(more)
        return cost, "".join(reversed(letters))


@dataclass
class Findings:
    """What one conversation's rows, read in order, come to."""

    chart: Chart = field(default_factory=Chart)
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    before: str | None = None

    def read(self, turn: int | None, initial: str, n: int, first: bool, blank: bool, truncated: bool) -> None:
        """n equal rows; first: the first of them is no duplicate."""
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
            self.turns += 1
        for k in range(n):
            again = not blank and not (first and k == 0)
            cut = truncated and not blank and not again
            self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + again, self.truncated + cut
            self.illegal += self.before is not None and self.before + initial not in LEGAL
            self.before = initial
            self.chart.read(initial, blank or again, cut)

    def row(self) -> tuple:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.chart.repair())


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows after the contract's damage; a dropped one has copies 0."""
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), case.alias("case"))
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("case") == 0, 0).when(F.col("case") == 3, 2).otherwise(1).cast("long")
    return rows.select("conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, tie, n, first, blank, truncated): equal rows of (conv_id, turn, role, text) as one.

    rows may have a column copies. A conversation whose rows have no copies keeps one row with n = 0.
    """
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1).cast("long")
    known = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"), copies.alias("copies"))
    there = F.col("copies") > 0  # all that is dropped from a conversation becomes one row
    known = known.select("conv_id", F.when(there, F.col("turn")).alias("turn"), *[F.when(there, F.col(c)).otherwise("").alias(c) for c in ("role", "text")], "copies", there.alias("there"))
    counted = known.groupBy("conv_id", "turn", "role", "text", "there").agg(F.sum("copies").alias("n")).drop("there")
    same = F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.length("role").cast("string"), F.concat("role", "text")))
    listed = checkpoint(counted.withColumns({"same": same, "tie": F.md5("text")}))
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    earliest = listed.where("n > 0").groupBy("same").agg(F.min(place).alias("earliest"))
    joined = skew_join(listed, earliest, "same", "left")
    solid = F.col("text").rlike(SPACE_CLASS.replace("[", "[^"))
    ends_well = F.col("text").rlike(r"[.!?]" + SPACE_CLASS + r"*\z")
    return joined.select("conv_id", "turn", "role", "text", "tie", "n", F.coalesce(place == F.col("earliest"), F.lit(False)).alias("first"), (~solid).alias("blank"), (~ends_well).alias("truncated"))


ORDER = ["conv_id", "turn", "role", "tie"]
FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def in_order(rows: DataFrame, *first: str) -> DataFrame:
    """A conversation's rows together and in order; a task streams them."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, *ORDER[1:])


def type_of(rows: DataFrame, name: str) -> T.StructField:
    return T.StructField(name, rows.schema[name].dataType)


def parsed(listed: DataFrame) -> DataFrame:
    """(conv_id, FOUND): faults, cost and audit of each conversation of turns()."""
    kind = type_of(listed, "conv_id")
    schema = T.StructType([kind, *T.StructType.fromDDL(FOUND)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Findings | None = None
        name, done, conv_type = None, [], pa.null()

        def out() -> pa.RecordBatch:
            columns = list(zip(*done))
            arrays = [pa.array(columns[0], conv_type), *(pa.array(c, pa.int64()) for c in columns[1:7]), pa.array(columns[7], pa.string())]
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for b in batches:
            conv_type = b.schema.field(0).type
            for conv, turn, initial, n, first, blank, truncated in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or conv != name:
                    if now is not None:
                        done.append((name, *now.row()))
                    now, name = Findings(), conv
                now.read(turn, initial, n, first, blank, truncated)
            if len(done) >= 1_000:
                yield out()
                done = []
        if now is not None:
            done.append((name, *now.row()))
            yield out()

    codes = in_order(listed.drop("text")).select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "n", "first", "blank", "truncated")
    return codes.mapInArrow(run, schema)


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, edit, role, text) for each edit, from sorted rows (conv_id, audit, role, text, n): a conversation's
    audit comes in a row of its own before the others. A conversation without edits gives one tuple of Nones."""
    audit, at, last, name = "", 0, "", None

    def inserts() -> Iterator[tuple]:
        nonlocal at, last
        while at < len(audit) and audit[at] == "I":
            last, at = "assistant" if last[:1] == "u" else "user", at + 1
            yield name, "I", last, ""

    for b in batches:
        for conv, letters, role, text, n in zip(*(c.to_pylist() for c in b.columns)):
            if letters is not None:
                yield from inserts()  # of the conversation before
                name, audit, at, last = conv, letters, 0, ""
                if not audit:
                    yield name, None, None, None
                continue
            for _ in range(n):
                yield from inserts()
                edit, at = audit[at], at + 1
                if edit == "D":
                    yield name, "D", role, text
                    continue
                last = role if edit == "K" else "assistant" if last[:1] == "u" else "user"
                yield name, edit, last, text
    yield from inserts()


def with_audits(listed: DataFrame, audits: DataFrame) -> DataFrame:
    """What edited() reads."""
    none = lambda kind: F.lit(None).cast(kind)
    rows = listed.select("conv_id", "turn", "role", "tie", "text", "n", none("string").alias("audit"), F.lit(1).alias("kind"))
    heads = audits.select("conv_id", none("long").alias("turn"), none("string").alias("role"), none("string").alias("tie"), none("string").alias("text"), F.lit(0).cast("long").alias("n"), "audit", F.lit(0).alias("kind"))
    return in_order(heads.unionByName(rows), "kind").select("conv_id", "audit", "role", "text", "n")


def repaired(listed: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): each conversation of turns() after the edits of parsed(), place from 0 in
    the order of the edits. Deleted rows come too, with edit D."""
    schema = T.StructType([type_of(listed, "conv_id"), *T.StructType.fromDDL("place long, edit string, role string, text string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def typed(bs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in bs:
                kinds[:] = [b.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string()]
                yield b

        held, name, place, size = [], object(), 0, 0
        for conv, edit, role, text in edited(typed(batches)):
            if edit is None:
                continue
            place, name = (place + 1 if conv == name else 0), conv
            held.append((conv, place, edit, role, text))
            size += len(text)
            if len(held) >= 1_000 or size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=schema.names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=schema.names)

    return with_audits(listed, audits).mapInArrow(run, schema)


def digests(listed: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of the repaired role:text lines, as they stream by."""
    schema = T.StructType([type_of(listed, "conv_id"), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def typed(bs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in bs:
                kinds[:] = [b.schema.field(0).type, pa.string()]
                yield b

        done, name, digest, lines = [], None, None, 0
        for conv, edit, role, text in edited(typed(batches)):
            if digest is None or conv != name:
                if digest is not None:
                    done.append((name, digest.hexdigest()))
                name, digest, lines = conv, hashlib.sha256(), 0
            if edit not in (None, "D"):
                digest.update((b"\n" if lines else b"") + role.encode() + b":")
                digest.update(text.encode())
                lines += 1
            if len(done) >= 1_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=schema.names)
                done = []
        if digest is not None:
            done.append((name, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=schema.names)

    return with_audits(listed, audits).mapInArrow(run, schema)


def report(rows: DataFrame) -> DataFrame:
    """conv_id, the faults, cost, audit and repaired_sha256 of each conversation of rows (as turns() takes them)."""
    listed = checkpoint(turns(rows))
    audits = checkpoint(parsed(listed))
    again = digests(listed, audits).withColumnRenamed("conv_id", "conv")
    return audits.join(again, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")


def repair(rows: DataFrame) -> DataFrame:
    """As repaired(), from rows as turns() takes them."""
    listed = checkpoint(turns(rows))
    return repaired(listed, checkpoint(parsed(listed)))

