"""Conversation repair against a plain row-by-row version."""

import hashlib
import random
import re
import zlib

import pytest

from shelfsight.llm import queries, repair

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, cid string, pos int"
NEXT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NAMES = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k == 1:
            text = ""
        elif k == 2:
            text = re.sub("[.!?]", "", text)
        elif k == 4:
            role = "user"
        out += [(c, t, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def brute(ids, rows):
    """{conv_id: report} of damaged rows, by one pass over whole conversations."""
    out = {}
    for c in ids:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults, seen = [], set()
        for _, _, role, text in mine:
            chars = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not chars else "duplicate" if (role, text) in seen else
                          "truncated" if chars[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[2][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))

        def inserts(ways):
            for q in (0, 1, 3, 2, 0, 1, 3, 2):  # u goes to 2, a from 2 to 3
                if q in ways:
                    cost, audit, lines = ways[q]
                    put, to = NEXT[q]
                    new = (cost + 2, audit + "I", [*lines, NAMES[put] + ":"])
                    if to not in ways or new < ways[to]:
                        ways[to] = new
            return ways

        ways = {0: (0, "", [])}
        for (_, _, role, text), fault in zip(mine, faults, strict=True):
            after = {}
            for q, (cost, audit, lines) in inserts(ways).items():
                new = [(q, (cost + 3, audit + "D", lines))]
                if fault not in ("blank", "duplicate"):
                    extra = fault == "truncated"
                    if (q, role[:1]) in KEEP:
                        new.append((KEEP[q, role[:1]], (cost + extra, audit + "K", [*lines, f"{role}:{text}"])))
                    put, to = NEXT[q]
                    new.append((to, (cost + 2 + extra, audit + "R", [*lines, f"{NAMES[put]}:{text}"])))
                for to, way in new:
                    if to not in after or way < after[to]:
                        after[to] = way
            ways = after
        cost, audit, lines = min(w for q, w in inserts(ways).items() if q in (0, 3)) if mine else (0, "", [])
        out[c] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                  hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def report(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User", "unknown"]
    texts = ["Yes.", "No!", "cut off", "", " \n", None, "Why?", "done. \t", "é", "a.\x85", "line\nbreak?", "x" * 3000 + "."]
    out = []
    for c in range(160):
        out += [(c, rng.choice([None, *range(6)]), rng.choice(roles[:5] if c % 3 else roles),
                 rng.choice(texts if c % 2 else texts[:3] + texts[6:8])) for _ in range(rng.randint(0, 9))]
    out += [(None, 1, "user", "A?"), (None, 2, "assistant", "B."), (None, None, None, None)]
    out += [(1000, None, "user", "x") for _ in range(4)]
    # one conversation over several blocks, with many equal rows
    out += [(2000, t // 3, ["user", "assistant", "system"][rng.randrange(40) // 19], f"{rng.randrange(400)}{rng.choice('.?x')}")
            for t in range(900)] + [(2000, 5, "assistant", "same") for _ in range(300)]
    return out


def test_repair_equals_plain_version(spark, rows):
    ids = {r[0] for r in rows}
    talks = frame(spark, rows)
    assert report(repair.repaired(talks, talks)) == brute(ids, [(c, t, r if r is not None else " ", x if x is not None else " ")
                                                                 for c, t, r, x in rows])
    assert report(repair.repaired(talks, repair.damage(talks))) == brute(ids, damaged(rows))


def test_query_over_the_smallest_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = report(queries.op12_conversation_repair(spark, SF))
    want = brute({r[0] for r in rows}, damaged(rows))
    assert got == want
    assert sum(w[5] for w in want.values()) and sum(w[1] + w[2] for w in want.values())


def test_no_rows(spark):
    none = frame(spark, [])
    assert repair.repaired(none, repair.damage(none)).collect() == []
    one = frame(spark, [(7, 1, "user", "x")])
    assert report(repair.repaired(one, none)) == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_every_entry_and_exit_of_a_segment():
    """The heaps against the chained row steps, for random segments."""
    rng = random.Random(3)
    for _ in range(300):
        codes = "".join(chr(65 + 4 * rng.randrange(4) + rng.choice([0, 0, 0, 1, 2])) for _ in range(rng.randint(1, 9)))
        for entry in range(4):
            ways = {entry: (0, "")}
            for row in repair._edges(codes)[:-1]:
                after = {}
                for _ in range(4):
                    for q, (cost, audit) in list(ways.items()):
                        for letter, taken, to, w in row[q]:
                            new = (cost + w, audit + letter.translate(repair._AUDIT))
                            table = after if taken else ways
                            if to not in table or new < table[to]:
                                table[to] = new
                ways = after
            cost, _, plans = repair._ways(codes, entry)
            for goal in range(4):
                if goal in ways:
                    assert (cost[goal], plans[goal].translate(repair._AUDIT)) == ways[goal]
                else:
                    assert cost[goal] == repair._NONE
