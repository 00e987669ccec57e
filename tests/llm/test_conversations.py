import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from surveyloom.llm import conversations, crossing

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"
MATCH = re.compile(r"(s?(ua)+)?")


def plain_repair(rows):
    """The best of all ways of editing (role, text, must go, cut off) rows, each tried."""
    best = None

    def go(at, audit, cost, said):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if at == len(rows):
            initials = "".join(r[:1] or "?" for r, _ in said)  # an empty role cannot be kept
            if MATCH.fullmatch(initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, said)
        else:
            role, text, gone, cut = rows[at]
            go(at + 1, audit + "D", cost + 4, said)
            if not gone:
                go(at + 1, audit + "K", cost + 3 * cut, said + [(role, text)])
                for new in ("user", "assistant"):
                    go(at + 1, audit + "R", cost + 3 + 3 * cut, said + [(new, text)])
        if len(said) < len(rows) + 2:
            for new in ("user", "assistant"):
                if not said or said[-1][0][:1] != new[0]:
                    go(at, audit + "I", cost + 3, said + [(new, "")])

    go(0, "", 0, [])
    return best


def plain_facts(rows):
    """What the contract asks for, for the rows of one conversation."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    counts, seen, marked = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), []
    for _, role, text in rows:
        fault = ("blank" if not text.strip(WHITE) else "duplicate" if (role, text) in seen
                 else "truncated" if text.rstrip(WHITE)[-1] not in ".!?" else None)
        if fault:
            counts[fault] += 1
        seen.add((role, text))
        marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, said = plain_repair(marked)
    initials = [r[1][:1] for r in rows]
    return {**counts, "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "cost": cost, "audit": audit,
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            "sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest(),
            "said": said}


@pytest.mark.parametrize("length", range(5))
def test_audit_is_the_least_of_the_cheapest(length):
    letters = ["s", "u", "a", "o", "U", "A", "#u", "#s"]
    rng = random.Random(length)
    every = list(product(letters, repeat=length))
    for case in every if len(every) <= 600 else rng.sample(every, 600):
        rows = [({"s": "system", "u": "user", "a": "assistant", "o": "tool"}[x[-1].lower()], "t", x[0] == "#", x.isupper()) for x in case]
        runs = crossing.runs("".join(case))
        vector = crossing.forward(runs, crossing.START)
        end = crossing.last_state(vector)
        inserts = crossing.END_INSERTS[end]
        audit = crossing.audit_between(runs, crossing.START, end) + "I" * inserts
        cost, wanted, said = plain_repair(rows)
        assert (vector[0][end] + 3 * inserts, audit) == (cost, wanted), case
        assert [r for r, _ in crossing.spoken(audit, [r[0] for r in rows])[0]] == [r for r, _ in said]


def test_pieces_meet_in_the_same_states():
    rng = random.Random(9)
    for _ in range(200):
        parts = [[(rng.choice(["s", "u", "a", "o", "U", "A"]), 1) for _ in range(rng.randint(1, 6))] for _ in range(rng.randint(1, 6))]
        whole = [row for part in parts for row in part]
        end = crossing.last_state(crossing.forward(whole, crossing.START))
        states = crossing.states_between([crossing.transfer(part) for part in parts])
        assert states[-1][1] == end
        assert "".join(crossing.audit_between(p, a, b) for p, (a, b) in zip(parts, states)) == crossing.audit_between(
            whole, crossing.START, end)


def talks(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "Well", " ", "", None, f"Number {turn}? ", "End.\r\n", "é. x"])
            rows.append((conv, rng.choice([turn, turn + 1, None]) if rng.random() < 0.3 else turn, role, text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("piece_rows", [200_000, 2])
def test_repairs_equal_brute_force(spark, piece_rows, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE_ROWS", piece_rows)
    rows = talks(3)
    repair = conversations.Repair(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as conv", "2 as mark", "3 as audit"))
    assert repair.solved.count() > 41 or piece_rows > 2
    wanted = {c: plain_facts([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    summary = {r.conv: r.asDict() for r in repair.summary().collect()}
    assert summary.keys() == wanted.keys()
    for conv, facts in wanted.items():
        assert {k: summary[conv][k] for k in facts if k not in ("sha256", "said")} == {
            k: v for k, v in facts.items() if k not in ("sha256", "said")}, conv
    assert {r.conv: r.sha256 for r in repair.digests().collect()} == {c: f["sha256"] for c, f in wanted.items()}
    said = sorted(repair.repaired().collect(), key=lambda r: (r.conv is None, r.conv, r.position))
    for conv, facts in wanted.items():
        mine = [r for r in said if r.conv == conv]
        assert [(r.role, r.text) for r in mine] == facts["said"] and [r.position for r in mine] == list(range(len(mine)))


def test_very_many_copies_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE_ROWS", 100)
    rows = [(1, 0, "user", "Hello.")] * 3000 + [(1, 1 + i, "assistant" if i % 2 == 0 else "user", f"Turn {i}.") for i in range(999)]
    repair = conversations.Repair(spark.createDataFrame(rows, SCHEMA))
    found = repair.summary().first()
    assert (found.duplicate, found.cost, found.illegal) == (2999, 4 * 2999, 2999)
    assert found.audit == "K" + "D" * 2999 + "K" * 999
    text = "\n".join(["user:Hello."] + [f"{r[2]}:{r[3]}" for r in rows[3000:]])
    assert repair.digests().first().sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert repair.repaired().count() == 1000


def test_planted_faults(spark):
    rows = [(c, t, "assistant", f"One. Two {c}!") for c in range(30) for t in (0, 1, None)]
    found = conversations.damaged(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as _times")).collect()
    wanted = []
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        text = "" if fault == 1 else text.replace(".", "").replace("!", "") if fault == 2 else text
        wanted += [(c, t, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)


def test_empty_table(spark):
    repair = conversations.Repair(conversations.damaged(spark.createDataFrame([], SCHEMA)))
    assert repair.summary().count() == repair.repaired().count() == repair.digests().count() == 0
