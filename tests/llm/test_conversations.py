import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from seepkit.llm import conversations
from seepkit.llm.conversations import SPACE, Repair, block_matrix, closure, damaged, repair_digest

NEXT = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("2", "a"): "3", ("3", "u"): "2"}


def cheapest(kinds):
    """Least (cost, audit) by a search from turn to turn; kinds as in ``turn_matrix``."""
    heap, done = [(0, "", 0, "0")], set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(kinds) and state in "03":
            return cost, audit
        for r in "ua":
            if (to := NEXT.get((state, r))) is not None:
                heapq.heappush(heap, (cost + 2, audit + "I", at, to))
        if at < len(kinds):
            k = kinds[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state))
            if k != "x":
                for r, name, c in ((k.lower(), "K", 0), ("u", "R", 2), ("a", "R", 2)):
                    if (to := NEXT.get((state, r))) is not None:
                        heapq.heappush(heap, (cost + c + k.isupper(), audit + name, at + 1, to))
    raise AssertionError


def listed(kinds):
    """Least (cost, audit) over all edits with up to two insertions at a place."""
    best = None
    gaps = ["", *"ua", *map("".join, itertools.product("ua", repeat=2))]
    edits = {k: [("D", "", 3)] + ([] if k == "x" else [("K", k.lower(), k.isupper()), ("R", "u", 2 + k.isupper()), ("R", "a", 2 + k.isupper())]) for k in set(kinds)}
    for added in itertools.product(gaps, repeat=len(kinds) + 1):
        for chosen in itertools.product(*(edits[k] for k in kinds)):
            roles = added[0] + "".join(e[1] + g for e, g in zip(chosen, added[1:], strict=True))
            if re.fullmatch("(s?(ua)+)?", roles):
                audit = "I" * len(added[0]) + "".join(e[0] + "I" * len(g) for e, g in zip(chosen, added[1:], strict=True))
                made = (sum(e[2] for e in chosen) + 2 * sum(map(len, added)), audit)
                best = min(best or made, made)
    return best


def least(m):
    return min(m[e][:2] for e in conversations.ENDS if m[e])


def test_matrices_find_the_cheapest_audit():
    r = random.Random(4)
    for n in [*range(1, 12)] * 12:
        kinds = "".join(r.choice("suaaouUASOxu") for _ in range(n))
        assert least(block_matrix(kinds)) == cheapest(kinds), kinds
    for kinds in ["", "u", "a", "s", "x", "O", "us", "AU", "sx", "ua", "oo"]:
        assert listed(kinds) == cheapest(kinds) == least(block_matrix(kinds))
    assert closure()[3][:2] == (4, "II")
    assert closure()[0][:2] == (0, "")


def test_products_are_associative():
    r = random.Random(5)
    for _ in range(40):
        kinds = "".join(r.choice("suaoUAx") for _ in range(9))
        cut = sorted(r.sample(range(1, 9), 2))
        parts = [block_matrix(kinds[a:b]) for a, b in zip([0, *cut], [*cut, 9], strict=True)]
        want = [e and e[:2] for e in block_matrix(kinds)]
        for tree in (parts, [conversations._product(parts[:2]), parts[2]], [parts[0], conversations._product(parts[1:])]):
            assert [e and e[:2] for e in conversations._product(tree)] == want


def brute(rows):
    """All of ``repair_digest`` by plain loops."""
    made = {k: [] for k, *_ in rows}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm:
            text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
            made[conv] += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    out = set()
    for conv, turns in made.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        kinds, seen, count = "", set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in turns:
            bare = text.strip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            kinds += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
            if fault:
                count[fault] += 1
        cost, audit = cheapest(kinds)
        known = {t for t, *_ in turns if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        lines, state, left = [], "0", iter(turns)
        for e in audit:
            _, role, text = next(left) if e != "I" else (None, "", "")
            if e in "RI":
                role = "assistant" if state == "2" else "user"
            if e != "D":
                lines.append(f"{role}:{text}")
                state = NEXT[state, role[0]]
        out.add((conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


SCHEMA = "conv_id long, turn long, role string, text string, kinds string, bid string"
ROLES = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "sage", "User"]
TEXTS = ["Yes.", "No!", "why?", "and so", " \t", "", None, " ", "fine. \n", "É", "ok.", "..."]


def drawn(n, seed, convs=9):
    r = random.Random(seed)
    return [(r.choice([*range(convs), None]), r.choice([*range(12), None, 40]), r.choice(ROLES), r.choice([*TEXTS, f"text {r.random()}."])) for _ in range(n)]


def got(df):
    rows = [tuple(x[c] for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for x in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("turns", "n", "parts"), [(256, 150, 2), (2, 150, 5), (1, 60, 3)])
def test_repair_equals_loops(spark, monkeypatch, turns, n, parts):
    monkeypatch.setattr(conversations, "TURNS", turns)
    monkeypatch.setattr(conversations, "FAN", 3)
    rows = drawn(n, n + turns)
    df = spark.createDataFrame([(*x, "odd", "odd") for x in rows], SCHEMA).repartition(parts)
    assert got(repair_digest(df)) == brute(rows)


def test_a_long_conversation_is_cut_and_put_together(spark):
    r = random.Random(8)
    rows = [(7, i, ROLES[i % 2] if r.random() < 0.9 else "system", f"turn {i if r.random() < 0.9 else i % 50}.") for i in range(1500)] + drawn(40, 2)
    rows += [(8, 3, "user", "again.")] * 700 + [(None, None, None, None)] * 600
    df = spark.createDataFrame([(*x, "", "") for x in rows], SCHEMA)
    assert got(repair_digest(df)) == brute(rows)
    repair = Repair(damaged(df))
    text = "\n".join(f"{x.role}:{x.text}" for x in repair.rows().filter("conv_id = 7").orderBy("bid", "pos").collect())
    assert hashlib.sha256(text.encode()).hexdigest() == next(x[-1] for x in brute(rows) if x[0] == 7)
    repair.close()


def test_odd_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repair_digest(df).count() == 0
    dropped = next(i for i in range(99) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "Hello.")]
    assert got(repair_digest(spark.createDataFrame([(*x, "", "") for x in rows], SCHEMA))) == brute(rows) == {(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    rows = [(1, 2, "user", "a" * 2_500_000 + "."), (1, 3, "assistant", "b " * 900_000), (1, -(2**63), "system", "x."), (1, 2**63 - 1, "user", "?")]
    made = got(repair_digest(spark.createDataFrame([(*x, "", "") for x in rows], SCHEMA)))
    assert {x[2:] for x in made} == {x[2:] for x in brute(rows)}
    assert {x[1] for x in made} == {2**63 - 1}
