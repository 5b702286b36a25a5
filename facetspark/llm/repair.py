"""Repair of conversations at least cost by depth-first branch-and-bound.

Every row of a conversation is kept, given another role or deleted, and empty turns can be inserted, so that the
initials of the roles read ``(s?(ua)+)?``. A node of the search is a place among the rows and the last initial put
out. Nodes wait on an explicit stack, the one with the least bound on top; the bound adds what the remaining rows
cost at least (in a relaxation of what may stand at the start). Per node, a table holds the best
prefix that reached it, as (cost, audit), and worse prefixes end there; so do nodes that cannot beat the best whole
repair found yet, the incumbent. When the stack is empty the incumbent is proved to be the best.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
ENDINGS = (".", "!", "?")
#: Pairs of neighbouring initials that may stand.
LEGAL = {"su", "ua", "au"}
#: What was put out last: nothing, a system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
DONE = (START, ASSISTANT)
#: A result batch is closed at so many characters.
OUT_CHARS = 4 << 20

SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("n_rows", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
    ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
])
DDL = (
    "conv_id long, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, roles array<string>, texts array<string>"
)


# --- the search ------------------------------------------------------------------


class Prefix:
    """Edits up to a node; shares its beginning with the prefix it extends. ``jump`` is a prefix much shorter."""

    __slots__ = ("place", "last", "cost", "edit", "before", "depth", "jump")

    def __init__(self, place, last, cost, edit, before):
        self.place, self.last, self.cost, self.edit, self.before = place, last, cost, edit, before
        if before is None:
            self.depth, self.jump = 0, self
        else:
            self.depth, far = before.depth + 1, before.jump
            self.jump = far.jump if before.depth - far.depth == far.depth - far.jump.depth else before

    def shortened(self, depth: int) -> "Prefix":
        at = self
        while at.depth > depth:
            at = at.jump if at.jump.depth >= depth else at.before
        return at

    def audit(self) -> str:
        out, at = [], self
        while at.before:
            out.append(at.edit)
            at = at.before
        return "".join(reversed(out))


def audit_order(a: Prefix, b: Prefix) -> int:
    """Negative if the audit of ``a`` is less in ASCII order; jumps back to where the two part."""
    depth = min(a.depth, b.depth)
    left, right = a.shortened(depth), b.shortened(depth)
    if left is right:
        return a.depth - b.depth
    while left.before is not right.before:
        far = left.jump is not right.jump
        left, right = (left.jump, right.jump) if far else (left.before, right.before)
    return (left.edit > right.edit) - (left.edit < right.edit)


def suffix_bounds(initials: list[str], faults: list[str]) -> dict[int, list[int]]:
    """For what was put out last, the least cost of the rows from each place on, whatever their audits.

    A relaxation: a system turn may stand alone.
    """
    n = len(initials)
    start, user_due, assistant_due = [0] * (n + 1), [0] * (n + 1), [INSERT_COST] * (n + 1)
    for k in range(n - 1, -1, -1):
        user, assistant, first = (DELETE_COST + due[k + 1] for due in (user_due, assistant_due, start))
        if faults[k] not in ("blank", "duplicate"):
            own = TRUNCATED_COST if faults[k] == "truncated" else 0
            user = min(user, own + REROLE_COST * (initials[k] != "u") + assistant_due[k + 1])
            assistant = min(assistant, own + REROLE_COST * (initials[k] != "a") + user_due[k + 1])
            if initials[k] == "s":
                first = min(first, own + user_due[k + 1])
        user_due[k], assistant_due[k] = min(user, INSERT_COST + assistant), min(assistant, INSERT_COST + user)
        start[k] = min(first, user_due[k])
    return {START: start, SYSTEM: user_due, USER: assistant_due, ASSISTANT: user_due}


def branches(node: Prefix, initials: list[str], faults: list[str]) -> Iterator[Prefix]:
    """The prefixes that extend ``node`` by one edit."""
    place, last, cost = node.place, node.last, node.cost
    due = ASSISTANT if last == USER else USER
    yield Prefix(place, due, cost + INSERT_COST, INSERT, node)
    if place == len(initials):
        return
    yield Prefix(place + 1, last, cost + DELETE_COST, DELETE, node)
    fault, initial = faults[place], initials[place]
    if fault in ("blank", "duplicate"):
        return
    cost += TRUNCATED_COST if fault == "truncated" else 0
    if initial == "ua"[due == ASSISTANT]:
        yield Prefix(place + 1, due, cost, KEEP, node)
    else:
        yield Prefix(place + 1, due, cost + REROLE_COST, REROLE, node)
        if initial == "s" and last == START:
            yield Prefix(place + 1, SYSTEM, cost, KEEP, node)


def cheapest_repair(initials: list[str], faults: list[str]) -> tuple[int, str]:
    """Cost and audit of the cheapest repair; among equal costs the audit that is least in ASCII order."""
    n = len(initials)
    rest = suffix_bounds(initials, faults)

    def bound(node: Prefix) -> int:
        return node.cost + rest[node.last][node.place]

    root = Prefix(0, START, 0, "", None)
    incumbent = root
    for _ in range(n):  # deleting every row always repairs
        incumbent = Prefix(incumbent.place + 1, START, incumbent.cost + DELETE_COST, DELETE, incumbent)
    best: dict[tuple[int, int], Prefix] = {}
    stack = [root]
    while stack:
        node = stack.pop()
        if bound(node) > incumbent.cost:
            continue
        seen = best.get((node.place, node.last))
        if seen is not node and seen is not None and not better(node, seen):
            continue
        best[node.place, node.last] = node
        if node.place == n and node.last in DONE:
            if better(node, incumbent):
                incumbent = node
            continue
        found = []
        for branch in branches(node, initials, faults):
            seen = best.get((branch.place, branch.last))
            if bound(branch) <= incumbent.cost and (seen is None or better(branch, seen)):
                found.append((bound(branch), branch.edit, branch))
        found.sort(key=lambda f: f[:2], reverse=True)
        stack.extend(f[2] for f in found)
    return incumbent.cost, incumbent.audit()


def better(a: Prefix, b: Prefix) -> bool:
    """Whether prefix ``a`` to a node makes prefix ``b`` to the same node useless."""
    return a.cost < b.cost or (a.cost == b.cost and audit_order(a, b) < 0)


# --- one conversation ------------------------------------------------------------


def fault_of(role: str, text: str, seen: set) -> str:
    """The first fault of a row, given the rows before it (``seen`` is extended)."""
    bare = text.rstrip(SPACE)
    repeated = (role, text) in seen
    seen.add((role, text))
    if not bare:
        return "blank"
    return "duplicate" if repeated else "" if bare.endswith(ENDINGS) else "truncated"


def apply_audit(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The repaired ``(role, text)`` turns that ``audit`` makes of ``rows``."""
    out, at, user_due = [], 0, True
    for edit in audit:
        role, text = (("user" if user_due else "assistant"), "") if edit == INSERT else rows[at]
        at += edit != INSERT
        if edit == DELETE:
            continue
        if edit == REROLE:
            role = "user" if user_due else "assistant"
        out.append((role, text))
        user_due = role[:1] != "u"
    return out


def repaired(conv_id, turns: list, rows: list[tuple[str, str]]) -> tuple:
    """A row of ``SCHEMA``; turns and rows in order."""
    seen: set = set()
    faults = [fault_of(role, text, seen) for role, text in rows]
    initials = [role[:1] for role, _ in rows]
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    cost, audit = cheapest_repair(initials, faults)
    out = apply_audit(rows, audit)
    return (
        conv_id, len(rows), gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
        [role for role, _ in out], [text for _, text in out],
    )


def conversations(batches) -> Iterator[tuple]:
    """Sorted rows ``(conv_id, turn, role, text, dropped)``, conversation by conversation."""
    held, turns, rows = None, [], []
    for batch in batches:
        for conv_id, turn, role, text, dropped in zip(*(c.to_pylist() for c in batch.columns)):
            if held != (conv_id,):
                if held:
                    yield held[0], turns, rows
                held, turns, rows = (conv_id,), [], []
            if not dropped:
                turns.append(turn)
                rows.append((role, text))
    if held:
        yield held[0], turns, rows


def repair_conversations(turns: DataFrame) -> DataFrame:
    """One row a conversation: its faults, the cheapest repair, and the repaired turns.

    Input ``conv_id, turn, role, text`` and, if there, ``dropped``: rows so marked only keep their conversation in
    the result. Other columns are ignored. Rows are taken by turn (null turns first), ties by role and text; null
    roles and texts are empty. The first fault of a row counts: ``blank`` (no visible character), ``duplicate`` (role
    and text of an earlier row), ``truncated`` (does not end in ``.``, ``!`` or ``?``). Keeping a row costs 0, another
    role 1, deleting it 2 (blank and duplicate rows must go), an inserted empty turn 5; truncated rows that stay cost 5
    more. ``audit`` has the initial of each edit in order; of equally cheap repairs it is the least in ASCII order.
    ``gaps`` counts missing turn numbers, ``illegal`` neighbouring initials that may not stand, both before the
    repair. Repeated rows are duplicates; null ids are one conversation; a conversation without rows has zeros, an
    empty audit and no turns; an empty table gives an empty result.

    One shuffle by conversation, sorted inside partitions (Spark's sort spills); a task holds one conversation at a
    time, and the table of a conversation has four entries a row.
    """
    dropped = F.coalesce("dropped", F.lit(False)) if "dropped" in turns.columns else F.lit(False)
    empty = F.lit("")
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"), dropped.alias("dropped"),
    )

    def run(batches):
        out, size = [], 0
        for conv_id, turns, found in conversations(batches):
            out.append(repaired(conv_id, turns, found))
            size += sum(map(len, out[-1][-1])) + len(out[-1][8])
            if size >= OUT_CHARS or len(out) >= 4096:
                yield as_batch(out)
                out, size = [], 0
        if out:
            yield as_batch(out)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, DDL)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)
