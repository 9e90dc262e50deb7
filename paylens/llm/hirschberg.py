"""Cheapest edits that give a conversation the role pattern ``(s?(ua)+)?``, in linear space.

The pattern is an automaton of four states: nothing yet, after ``system``, after
``user``, after ``assistant``. A *step* says what it costs to go from one state to
another over one row (or over a block of rows): a list of (entry, exit, cost, order),
where ``order`` ranks the exits of one entry by their audit texts. Every row is one
letter K, R or D of the audit, after the inserts before it; so of two audits over the
same rows none is the beginning of the other, and their order never depends on what
follows.

``crossings`` finds the states between the steps by divide and conquer: a forward
vector of four costs (with the order of their audits) from the entry and a backward
vector from the end meet in the middle; of the states where their sum is least the one
with the least audit is taken, and both halves are solved in the same way. Only vectors
of four numbers are kept, never a table of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

Step = list[tuple[int, int, int, int]]  # (entry, exit, cost, order)

# ---- fixed values: states, costs of the edits, what may follow ----
START, SYSTEM, USER, ASSISTANT = range(4)
NONE = 1 << 60
RECAST, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
INITIALS = "sua"
PLAIN, TRUNCATED, REMOVE = range(3)
AFTER_INSERT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
AFTER_KEEP = {
    "s": {START: SYSTEM},
    "u": {START: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
}
LEGAL_PAIRS = {"su", "ua", "au"}
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}


def row_code(initial: str, fault: int) -> int:
    """A row's number: what its role begins with, and what is wrong with it."""
    return 3 * (INITIALS.index(initial) if initial and initial in INITIALS else 3) + fault


def _pieces(code: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(entry, exit) -> (cost, audit) of one row with the inserts before it."""
    initial, fault = (INITIALS + " ")[code // 3], code % 3
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for entry in range(4):
        state, cost, text = entry, 0, ""
        for _ in range(3):
            moves = [("D", state, DELETE)]
            if fault != REMOVE:
                more = CUT_OFF if fault == TRUNCATED else 0
                if state in AFTER_KEEP.get(initial, ()):
                    moves.append(("K", AFTER_KEEP[initial][state], more))
                moves.append(("R", AFTER_INSERT[state], RECAST + more))
            for letter, to, price in moves:
                best[entry, to] = min(best.get((entry, to), (NONE, "")), (cost + price, text + letter))
            state, cost, text = AFTER_INSERT[state], cost + INSERT, text + "I"
    return best


PIECES = [_pieces(code) for code in range(12)]


def _step(pieces: dict[tuple[int, int], tuple[int, str]]) -> Step:
    out = []
    for entry in range(4):
        audits = sorted(t for (p, _), (_, t) in pieces.items() if p == entry)
        out += [(entry, s, cost, audits.index(text)) for (p, s), (cost, text) in pieces.items() if p == entry]
    return out


ROW_STEPS = [_step(p) for p in PIECES]

#: Costs and audits of what may follow the last row: nothing, or inserts.
FINISH = [(0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, "")]
END = tuple(cost for cost, _ in FINISH)


def forward(steps: Sequence[Step], entry: int) -> tuple[list[int], list[int]]:
    """Least costs from ``entry`` to each state over the steps, and the order of the
    audits that reach them."""
    costs, orders = [NONE] * 4, [0] * 4
    costs[entry] = 0
    for step in steps:
        found: list[tuple[int, int, int]] = [(NONE, 0, 0)] * 4
        for p, s, cost, order in step:
            if costs[p] < NONE and (way := (costs[p] + cost, orders[p], order)) < found[s]:
                found[s] = way
        ranks = sorted({way[1:] for way in found})
        costs = [way[0] for way in found]
        orders = [ranks.index(way[1:]) for way in found]
    return costs, orders


def backward(steps: Sequence[Step], end: Sequence[int]) -> list[int]:
    """Least costs from each state over the steps to the end."""
    costs = list(end)
    for step in reversed(steps):
        before = [NONE] * 4
        for p, s, cost, _ in step:
            if costs[s] < NONE and cost + costs[s] < before[p]:
                before[p] = cost + costs[s]
        costs = before
    return costs


def crossings(steps: Sequence[Step], entry: int, end: Sequence[int]) -> list[int]:
    """The state after each step on the cheapest way, of those the one whose audit is
    the least in ASCII order."""
    if not steps:
        return []
    middle = len(steps) // 2 if len(steps) > 1 else 1
    costs, orders = forward(steps[:middle], entry)
    rest = backward(steps[middle:], end)
    state = min((costs[s] + rest[s], orders[s], s) for s in range(4) if costs[s] < NONE and rest[s] < NONE)[2]
    if len(steps) == 1:
        return [state]
    there = [0 if s == state else NONE for s in range(4)]
    return crossings(steps[:middle], entry, there) + crossings(steps[middle:], state, end)


def block_step(codes: bytes) -> Step:
    """A block of rows as one step."""
    rows = [ROW_STEPS[c] for c in codes]
    out = []
    for entry in range(4):
        costs, orders = forward(rows, entry)
        out += [(entry, s, costs[s], orders[s]) for s in range(4) if costs[s] < NONE]
    return out


@lru_cache(maxsize=1 << 16)
def _short(codes: bytes, entry: int, end: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(crossings([ROW_STEPS[c] for c in codes], entry, end))


def row_crossings(codes: bytes, entry: int = START, end: Sequence[int] = END) -> Sequence[int]:
    """``crossings`` of rows given by their codes; short ones are remembered."""
    if len(codes) <= 64:
        return _short(codes, entry, tuple(end))
    return crossings([ROW_STEPS[c] for c in codes], entry, end)
