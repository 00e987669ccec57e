"""Cheapest edits that give a conversation its order of roles, by divide and conquer in linear space."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import lru_cache
from itertools import product

import numpy as np

# What has been said so far decides who may speak: nothing yet, a system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
NEEDED = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
AFTER = {"u": USER, "a": ASSISTANT}
# Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# A conversation may end before it starts or after the assistant.
END_INSERTS = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}

# A row as one letter: the initial of its role (o: any other), in upper case if it is truncated; after # if it must go.
_ROW = re.compile(r"(#?[suaoSUAO])(\d*)")
INFINITE = math.inf

Run = tuple[str, int]
Vector = tuple[list[float], list[int]]


@lru_cache(maxsize=None)
def moves(letter: str) -> tuple[tuple[int, int, float, str], ...]:
    """(from, to, cost, edits) of everything that can be done with a row.

    Inserts stand before the row that they make room for, and never before a
    deleted one: after it they cost the same and their audit is less.
    """
    if letter.startswith("#"):
        return tuple((state, state, DELETE, "D") for state in STATES)
    role, extra = letter.lower(), 0 if letter.islower() else TRUNCATED
    found = [(state, state, DELETE, "D") for state in STATES]
    if role == "s":
        found.append((START, SYSTEM, extra, "K"))
    for state, inserts in product(STATES, (0, 1)):
        there = AFTER[NEEDED[state]] if inserts else state
        speaker = NEEDED[there]
        cost, edits = INSERT * inserts + extra, "I" * inserts
        if role == speaker:
            found.append((state, AFTER[speaker], cost, edits + "K"))
        found.append((state, AFTER[speaker], cost + REROLE, edits + "R"))
    return tuple(found)


def runs(letters: str) -> list[Run]:
    """Rows from their text form: ``ua#u12A`` has 12 rows ``#u``."""
    return [(letter, int(count or 1)) for letter, count in _ROW.findall(letters)]


def _clear(start: int) -> Vector:
    return [0 if state == start else INFINITE for state in STATES], [0] * len(STATES)


def forward(rows: Sequence[Run], start: int) -> Vector:
    """Cheapest cost from ``start`` to every state, and the order of the cheapest audits by ASCII.

    Audits of the same rows from the same state that end in different states are
    different, and none is the beginning of another, so their order is kept
    whatever is added.
    """
    cost, rank = _clear(start)
    for letter, count in rows:
        if letter.startswith("#"):
            cost = [c + DELETE * count for c in cost]
            continue
        best = {}
        for a, b, price, edits in moves(letter):
            offer = (cost[a] + price, rank[a], edits)
            if cost[a] < INFINITE and (b not in best or offer < best[b]):
                best[b] = offer
        order = {b: i for i, b in enumerate(sorted(best, key=lambda b: best[b][1:]))}
        cost = [best[b][0] if b in best else INFINITE for b in STATES]
        rank = [order.get(b, 0) for b in STATES]
    return cost, rank


def backward(rows: Sequence[Run], end: int) -> list[float]:
    """Cheapest cost from every state to ``end``."""
    cost = _clear(end)[0]
    for letter, count in reversed(rows):
        if letter.startswith("#"):
            cost = [c + DELETE * count for c in cost]
            continue
        before = [INFINITE] * len(STATES)
        for a, b, price, _ in moves(letter):
            before[a] = min(before[a], cost[b] + price)
        cost = before
    return cost


def _single(row: Run, start: int, end: int) -> str:
    letter, count = row
    if letter.startswith("#"):
        return "D" * count
    return min((price, edits) for a, b, price, edits in moves(letter) if (a, b) == (start, end))[1]


def audit_between(rows: Sequence[Run], start: int, end: int) -> str:
    """The ASCII-least of the cheapest audits from one state to another.

    Forward and backward costs meet in the middle; of the states in which they add
    up to the least, the audit takes the one whose first half is less.  Each half
    is then treated in the same way, so only two vectors are held at a time.
    """
    done, waiting = [], [(0, len(rows), start, end)]
    while waiting:
        low, high, a, b = waiting.pop()
        if high - low == 1:
            done.append(_single(rows[low], a, b))
        elif high > low:
            middle = (low + high) // 2
            cost, rank = forward(rows[low:middle], a)
            rest = backward(rows[middle:high], b)
            at = min((state for state in STATES if cost[state] < INFINITE), key=lambda s: (cost[s] + rest[s], rank[s]))
            waiting += [(middle, high, at, b), (low, middle, a, at)]
    return "".join(done)


def last_state(vector: Vector) -> int:
    """Where the cheapest and then ASCII-least audit of a whole conversation ends before its last inserts."""
    cost, rank = vector
    return min((s for s in STATES if cost[s] < INFINITE), key=lambda s: (cost[s] + INSERT * END_INSERTS[s], rank[s]))


# ---- conversations in several pieces

def transfer(rows: Sequence[Run]) -> list[float]:
    """Costs and orders from every state to every state, in 32 numbers: a piece of a long conversation."""
    return [x for start in STATES for x in (*forward(rows, start)[0], *map(float, forward(rows, start)[1]))]


def states_between(pieces: Sequence[Sequence[float]]) -> list[tuple[int, int]]:
    """The state before and after every piece on the cheapest, ASCII-least way through all of them.

    The same meeting in the middle as within a piece, on the pieces' tables of costs.
    """
    tables = [(np.reshape(p, (4, 2, 4))[:, 0], np.reshape(p, (4, 2, 4))[:, 1]) for p in pieces]

    def ahead(low: int, high: int, start: int) -> Vector:
        cost, rank = _clear(start)
        for price, order in tables[low:high]:
            best = {}
            for b in STATES:
                offers = [(cost[a] + price[a][b], rank[a], order[a][b]) for a in STATES if cost[a] + price[a][b] < INFINITE]
                if offers:
                    best[b] = min(offers)
            places = {b: i for i, b in enumerate(sorted(best, key=lambda b: best[b][1:]))}
            cost = [best[b][0] if b in best else INFINITE for b in STATES]
            rank = [places.get(b, 0) for b in STATES]
        return cost, rank

    def back(low: int, high: int, end: int) -> list[float]:
        cost = np.array(_clear(end)[0])
        for price, _ in reversed(tables[low:high]):
            cost = (price + cost[None, :]).min(axis=1)
        return cost.tolist()

    borders = {0: START, len(tables): last_state(ahead(0, len(tables), START))}
    waiting = [(0, len(tables))]
    while waiting:
        low, high = waiting.pop()
        if high - low > 1:
            middle = (low + high) // 2
            cost, rank = ahead(low, middle, borders[low])
            rest = back(middle, high, borders[high])
            borders[middle] = min((s for s in STATES if cost[s] < INFINITE), key=lambda s: (cost[s] + rest[s], rank[s]))
            waiting += [(low, middle), (middle, high)]
    return [(borders[i], borders[i + 1]) for i in range(len(tables))]


def cost_of(rows: Sequence[Run], start: int, end: int) -> float:
    return forward(rows, start)[0][end]


def spoken(audit: str, roles: Sequence[str], state: int = START) -> tuple[list[tuple[str, int | None]], int]:
    """What an audit makes of the roles of its rows: (role, number of the row or None if inserted), and the last state."""
    said, at = [], 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        speaker = NEEDED[state]
        if edit == "K" and roles[at][:1] == "s":
            said.append((roles[at], at))
            state = SYSTEM
        else:
            said.append((roles[at] if edit == "K" else "user" if speaker == "u" else "assistant", None if edit == "I" else at))
            state = AFTER[speaker]
        at += edit != "I"
    return said, state
