"""Repair of the turn structure of conversations by bidirectional Dijkstra.

A conversation's rows and the roles seen so far span an edit lattice: node (i, s) is "i
rows read, state s", an edge keeps, reroles or deletes the next row or inserts an empty
turn. The cheapest edits that end in a legal order of roles are a shortest path. A forward
and a reverse search take turns, the one with the cheaper heap top first; they stop when
no cheaper or equal path can be left, so that all equal-cost crossings are known, and the
least concatenated audit of these wins. (Equal-cost audits between the same two nodes are
never prefixes of each other, since every insertion costs, so least parts make least
wholes.)

Rows are dealt by range of (conversation, turn, role, text) and streamed in order; a long
conversation is cut into blocks of ``BLOCK`` rows, and over several tasks, whose cheapest
edits between all pairs of states are multiplied up in the order of rows. So one huge
conversation is searched by many tasks at once, and none holds its rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLOCK = 512
#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: What a role's initial leads to, from each state.
STEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: Where a conversation may end.
ENDS = (START, ASSISTANT)
#: The role that a rerole or an insertion gives, from each state.
FILL = ("u", "u", "a", "u")


# ------------------------------------------------------------------ the lattice

Row = tuple[str, str]
"""A row's role initial and its fault: b(lank), d(uplicate), t(runcated) or nothing."""


def forward_edges(rows: list[Row], node: tuple[int, int]) -> Iterator[tuple[int, str, tuple[int, int]]]:
    """Cost, letter and end of each edit that leaves a node."""
    i, s = node
    yield INSERT, "I", (i, STEP[s][FILL[s]])
    if i < len(rows):
        initial, fault = rows[i]
        yield DELETE, "D", (i + 1, s)
        if fault not in ("b", "d"):
            more = TRUNCATED if fault == "t" else 0
            if initial in STEP[s]:
                yield KEEP + more, "K", (i + 1, STEP[s][initial])
            yield REROLE + more, "R", (i + 1, STEP[s][FILL[s]])


def reverse_edges(rows: list[Row], node: tuple[int, int]) -> Iterator[tuple[int, str, tuple[int, int]]]:
    """Cost, letter and beginning of each edit that leads to a node."""
    i, s = node
    for before in STATES:
        if STEP[before][FILL[before]] == s:
            yield INSERT, "I", (i, before)
    if i:
        initial, fault = rows[i - 1]
        yield DELETE, "D", (i - 1, s)
        if fault not in ("b", "d"):
            more = TRUNCATED if fault == "t" else 0
            for before in STATES:
                if STEP[before].get(initial) == s:
                    yield KEEP + more, "K", (i - 1, before)
                if STEP[before][FILL[before]] == s:
                    yield REROLE + more, "R", (i - 1, before)


def cheapest(rows: list[Row], entry: int, exits: tuple[int, ...]) -> tuple[int, str, int] | None:
    """Cost, audit and exit state of the cheapest edits of ``rows``, ties by the least audit; None: no edits lead there."""
    first, n = (0, entry), len(rows)
    # labels: node -> (cost, audit, the end reached); heaps: by cost, then by rows in the search's direction, as keeping costs nothing
    ahead, back = {first: (0, "", None)}, {(n, s): (0, "", s) for s in exits}
    heap_f, heap_r = [(0, 0, first)], [(0, 0, (n, s)) for s in exits]
    heapq.heapify(heap_r)
    done_f, done_r = set(), set()
    best = min((ahead[x][0] + back[x][0] for x in ahead.keys() & back.keys()), default=None)
    while heap_f and heap_r and (best is None or heap_f[0][0] + heap_r[0][0] <= best):
        forward = heap_f[0][0] <= heap_r[0][0]
        heap, own, other, done = (heap_f, ahead, back, done_f) if forward else (heap_r, back, ahead, done_r)
        cost, depth, node = heapq.heappop(heap)
        if node in done:
            continue
        done.add(node)
        _, audit, end = own[node]
        for c, letter, to in (forward_edges if forward else reverse_edges)(rows, node):
            label = (cost + c, audit + letter if forward else letter + audit, end)
            if to in done:
                continue
            if to not in own or label[:2] < own[to][:2]:
                if to not in own or label[0] < own[to][0]:
                    heapq.heappush(heap, (label[0], to[0] if forward else n - to[0], to))
                own[to] = label
            if to in other and (best is None or label[0] + other[to][0] < best):
                best = label[0] + other[to][0]
    met = [(a + back[x][1], back[x][2]) for x, (c, a, _) in ahead.items() if x in back and c + back[x][0] == best]
    return (best, *min(met)) if met else None


Matrix = dict[tuple[int, int], tuple[int, str]]
"""(entry, exit) -> cost and audit of the cheapest edits."""


def block_matrix(rows: list[Row]) -> Matrix:
    found = {(a, b): cheapest(rows, a, (b,)) for a in STATES for b in STATES}
    return {k: v[:2] for k, v in found.items() if v}


def multiply(x: Matrix | None, y: Matrix) -> Matrix:
    """Cheapest edits of the rows of both, one after the other."""
    if x is None:
        return y
    out: Matrix = {}
    for (a, m), (c1, s1) in x.items():
        for b in STATES:
            if (m, b) in y:
                c2, s2 = y[m, b]
                label = (c1 + c2, s1 + s2)
                if (a, b) not in out or label < out[a, b]:
                    out[a, b] = label
    return out


# ------------------------------------------------------------------ over tables


def damage(df: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` (null role or text: one space) with a fault put into a row in four, by crc32 of "conv_id:turn"."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), k.alias("_k")).where("_k <> 0")
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def _fault(text: Column, repeated: Column) -> Column:
    last = F.substring(F.regexp_replace(text, r"[\x20\x09-\x0D]+$", ""), -1, 1)
    return F.when(~text.rlike(WORD), "b").when(repeated, "d").when(~last.isin(".", "!", "?"), "t").otherwise("")


def ordered_rows(df: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, fault, at``: all rows in the order of ``at`` (long), of which each task's are contiguous.

    Order within a conversation: turn, nulls first, then role, then the text's first
    characters and digest; null roles and texts count as one space. Equal rows are counted
    before they move; all but the first are duplicates, which are deleted and carry no text.
    """
    spark = df.sparkSession
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), space("role"), space("text"))
    each = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("digest", F.sha2("text", 256))
    # where a role and text that come more than once do so first: partial minima, then a row for each
    first = each.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    first = first.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "first")
    met = each.join(first, each["conv_id"].eqNullSafe(F.col("_c")) & (each["role"] == F.col("_r")) & (each["digest"] == F.col("_d")), "left")
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    numbered = met.select("conv_id", "turn", "role", "text", "digest", later.alias("later"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    repeated = F.col("later") | (F.col("copy") > 1)
    full = numbered.select("conv_id", "turn", "role", F.when(repeated, "").otherwise(F.col("text")).alias("text"), _fault(F.col("text"), repeated).alias("fault"), F.substring("text", 1, 64).alias("_head"), "digest", "copy")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = ["conv_id", "turn", "role", "_head", "digest", "copy"]
    return cut(full.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_head", "digest", "copy").withColumn("at", F.monotonically_increasing_id()))


class _Run:
    """What one task has seen of one conversation, row by row; holds ``BLOCK`` rows at most."""

    def __init__(self, conv_id: int | None, at: int) -> None:
        self.conv_id, self.at, self.waiting, self.matrix = conv_id, at, [], None
        self.faults = {"b": 0, "d": 0, "t": 0}
        self.illegal, self.turns, self.first_turn, self.last_turn, self.first, self.last = 0, 0, None, None, None, ""

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if self.first is None:
            self.first = initial
        else:
            self.illegal += illegal(self.last, initial)
        self.last = initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if fault:
            self.faults[fault] += 1
        self.waiting.append((initial, fault))
        if len(self.waiting) >= BLOCK:
            self.matrix, self.waiting = multiply(self.matrix, block_matrix(self.waiting)), []

    def close(self, whole: bool) -> dict:
        """A row for the merge; of a conversation that lies wholly in one block only the path that counts is searched."""
        if whole and self.matrix is None:
            cost, audit, end = cheapest(self.waiting, START, ENDS)
            paths = {(START, end): (cost, audit)}
        else:
            paths = multiply(self.matrix, block_matrix(self.waiting))
        return {
            "conv_id": self.conv_id, "at": self.at, "whole": whole and self.matrix is None, "blank": self.faults["b"], "duplicate": self.faults["d"], "truncated": self.faults["t"], "illegal": self.illegal, "turns": self.turns, "first_turn": self.first_turn, "last_turn": self.last_turn,
            "first": self.first, "last": self.last, "paths": [{"entry": a, "exit": b, "cost": c, "audit": s} for (a, b), (c, s) in paths.items()],
        }


_COUNTS = [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")]
_RUN = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("whole", pa.bool_()), *_COUNTS, ("turns", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("paths", pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])
_RUN_DDL = "conv_id long, at long, whole boolean, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first string, last string, paths array<struct<entry: int, exit: int, cost: long, audit: string>>"
_MERGED = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), *_COUNTS, ("cost", pa.int64()), ("audit", pa.string()), ("parts", pa.list_(pa.struct([("run", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32()), ("audit", pa.string())])))])
_MERGED_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, parts array<struct<run: long, entry: int, exit: int, audit: string>>"
_EDIT = pa.schema([("conv_id", pa.int64()), ("run", pa.int64()), ("step", pa.int32()), ("edit", pa.string()), ("given", pa.string()), ("at", pa.int64())])


def illegal(before: str, after: str) -> bool:
    """Whether a role's initial may not follow another."""
    return before + after not in ("su", "ua", "au")


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    out: list[dict] = []
    for r in rows:
        out.append(r)
        if len(out) >= size:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation that a task has rows of; only a task's first and last may go on elsewhere."""

    def rows() -> Iterator[dict]:
        run, seen = None, 0
        for b in batches:
            for conv, at, turn, initial, fault in zip(*[b.column(c).to_pylist() for c in ("conv_id", "at", "turn", "initial", "fault")], strict=True):
                if run is None or conv != run.conv_id:
                    if run is not None:
                        yield run.close(whole=seen > 1)
                    run, seen = _Run(conv, at), seen + 1
                run.add(turn, initial, fault)
        if run is not None:
            yield run.close(whole=False)

    return _batches(rows(), _RUN, 1000)


def _merge(table: pa.Table) -> pa.Table:
    """A conversation's report, and the part of the audit in each of its runs, at most one a task."""
    runs = sorted(table.to_pylist(), key=lambda r: r["at"])
    ahead: list[dict] = [{START: (0, "", START)}]  # after each run, of each state: cost, audit, the state before the run
    for r in runs:
        after: dict = {}
        for p in r["paths"]:
            if p["entry"] in ahead[-1]:
                cost, audit, _ = ahead[-1][p["entry"]]
                label = (cost + p["cost"], audit + p["audit"], p["entry"])
                if p["exit"] not in after or label < after[p["exit"]]:
                    after[p["exit"]] = label
        ahead.append(after)
    cost, audit, end = min((*ahead[-1][b][:2], b) for b in ENDS if b in ahead[-1])
    parts = []
    for k in range(len(runs) - 1, -1, -1):
        entry = ahead[k + 1][end][2]
        piece = next(p["audit"] for p in runs[k]["paths"] if (p["entry"], p["exit"]) == (entry, end))
        parts.append({"run": runs[k]["at"], "entry": entry, "exit": end, "audit": piece})
        end = entry
    turned = [r for r in runs if r["turns"]]
    distinct = sum(r["turns"] for r in turned) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(turned, turned[1:], strict=False))
    row = {c: sum(r[c] for r in runs) for c, _ in _COUNTS}
    row["illegal"] += sum(illegal(a["last"], b["first"]) for a, b in zip(runs, runs[1:], strict=False))
    row |= {"conv_id": runs[0]["conv_id"], "gaps": turned[-1]["last_turn"] - turned[0]["first_turn"] + 1 - distinct if turned else 0, "cost": cost, "audit": audit, "parts": parts[::-1]}
    return pa.Table.from_pylist([row], _MERGED)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of audits as rows. A part's exit tells its last turn's role, and roles alternate back from there; before the first "ua" only a system turn is left."""

    def rows() -> Iterator[dict]:
        for b in batches:
            for conv, run, end, audit in zip(*[b.column(c).to_pylist() for c in ("conv_id", "run", "exit", "audit")], strict=True):
                left, at = len(audit) - audit.count("D"), run
                for k, letter in enumerate(audit):
                    given = None
                    if letter != "D":
                        left -= 1
                        given = "user" if (end == USER) == (left % 2 == 0) else "assistant"
                    yield {"conv_id": conv, "run": run, "step": k, "edit": letter, "given": given if letter in "RI" else None, "at": None if letter == "I" else at}
                    at += letter != "I"

    return _batches(rows(), _EDIT, 10_000)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, which come in order; only the state of the hash is kept."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def rows() -> Iterator[dict]:
        now, h = None, None
        for b in batches:
            for conv, line in zip(b.column("conv_id").to_pylist(), b.column("line").to_pylist(), strict=True):
                if h is None or conv != now:
                    if h is not None:
                        yield {"conv_id": now, "repaired_sha256": h.hexdigest()}
                    now, h = conv, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(line.encode("utf-8", "surrogatepass"))
        if h is not None:
            yield {"conv_id": now, "repaired_sha256": h.hexdigest()}

    return _batches(rows(), schema, 1000)


class Repair:
    """Repaired conversations: ``report``, ``edits`` and ``turns``.

    ``report``: a row for each conversation that has rows: ``conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit``. ``edits``: ``conv_id, run, step, edit,
    given, at``, a row for each letter of each audit, in the order of run and step.
    ``turns``: ``conv_id, run, step, edit, role, text``, the repaired rows in that order.
    """

    def __init__(self, ordered: DataFrame, merged: DataFrame) -> None:
        self.report = merged.drop("parts")
        parts = merged.select("conv_id", F.explode("parts").alias("p")).select("conv_id", "p.run", "p.exit", "p.audit")
        self.edits = parts.mapInArrow(_edits, "conv_id long, run long, step int, edit string, given string, at long")
        left = self.edits.where("edit <> 'D'").join(ordered.select("at", F.col("role").alias("_role"), "text"), "at", "left")
        self.turns = left.select("conv_id", "run", "step", "edit", F.coalesce("given", "_role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def digests(self) -> DataFrame:
        """``conv_id, repaired_sha256``: of ``role:text`` lines; a hash has one order, so each conversation's turns pass one task, one at a time."""
        lines = self.turns.select("conv_id", "run", "step", F.concat_ws(":", "role", "text").alias("line"))
        return lines.repartition("conv_id").sortWithinPartitions("conv_id", "run", "step").drop("run", "step").mapInArrow(_hashes, "conv_id long, repaired_sha256 string")


def repair(df: DataFrame) -> Repair:
    """Repair the rows (``conv_id`` and ``turn`` long, ``role``, ``text``; other columns play no part) of all conversations.

    Null roles and texts count as one space, and a role is known by its first character.
    Rows of a null ``conv_id`` are one conversation. Within a turn, null turns first, rows are
    ordered by role, then by text. Blank rows and repeats of a role and text are deleted,
    whatever that costs; empty tables give no rows.
    """
    ordered = ordered_rows(df)
    light = ordered.select("conv_id", "at", "turn", F.substring("role", 1, 1).alias("initial"), "fault")
    runs = cut(light.mapInArrow(_runs, _RUN_DDL))
    # most conversations lie within one block of one task and are done; only the others' runs meet
    path = F.col("paths")[0]
    part = F.struct(F.col("at").alias("run"), path["entry"].alias("entry"), path["exit"].alias("exit"), path["audit"].alias("audit"))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    whole = runs.where("whole").select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", path["cost"].alias("cost"), path["audit"].alias("audit"), F.array(part).alias("parts"))
    met = runs.where("not whole").groupBy("conv_id").applyInArrow(_merge, _MERGED_DDL)
    return Repair(ordered, cut(whole.unionByName(met)))


EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def repair_damaged(df: DataFrame) -> DataFrame:
    """The report and digest of each of the given conversations after ``damage``; one without rows has zeros, an empty audit and the empty text's digest."""
    fixed = repair(damage(df))
    both = fixed.report.alias("r").join(fixed.digests().alias("h"), F.col("r.conv_id").eqNullSafe(F.col("h.conv_id")), "left").select("r.*", "repaired_sha256")
    ids = df.select(F.col("conv_id").cast("long").alias("_id")).distinct()
    out = ids.join(both, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("_id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"))
