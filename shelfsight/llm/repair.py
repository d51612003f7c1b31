"""Conversation structure repair by a cheapest edit of each conversation.

A repaired conversation has the role initials ``(s?(ua)+)?``: nothing, or an
optional system row and then user and assistant in turn. Edits of a row: Keep
(0), Rerole to user or assistant (2), Delete (3); an empty user or assistant
row may be Inserted anywhere (2). A row's first fault counts: *blank* (no word
character), *duplicate* (role and text of an earlier row), *truncated* (its
last word character is not ``.``, ``!`` or ``?``). Blank and duplicate rows
must be deleted, a truncated row that stays costs 1. Among the cheapest edits
the one whose audit (initials of the edits in order) is least in ASCII wins.

Method
  1. Rows are range-partitioned by (conversation, turn, role, text, place in
     the input) and written once, so a conversation of any length spans many
     tasks and every row has a global place. A duplicate is a row after the
     first place of its (conversation, role, text), an aggregate joined back.
  2. A *segment* is the part of one conversation in one block of ``BLOCK``
     places, one character a row. For a state of the role automaton at its
     start and one at its end, bidirectional Dijkstra over the edit lattice
     (row, state) finds the cheapest edits: a forward and a reverse heap run
     until their tops together exceed the best meeting, so every equal-cost
     crossing is finished, and the least concatenated audit is taken.
  3. Segments are chained: costs to the end from the last segment backwards,
     then states forwards. Inserts belong to the row they precede (or to the
     end of the conversation), so the audits of one segment's cheapest edits
     never start with each other and the least one can be picked segment by
     segment. Only 16 costs and ranks a segment meet in one row.
  4. The chosen edits are joined to the rows; the repaired lines stream in
     order through a hash, one conversation after the other, in bounded
     memory.

Defined results for odd input: a NULL role or text is one space (a blank
text), turns sort with NULLs first, rows of one turn by role and text; a NULL
conv_id is a conversation of its own; a conversation without rows gets zeros,
an empty audit and the hash of the empty text; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.common import settled, written

BLOCK = 256
# The characters between words.
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

# States of the role automaton: 0 nothing yet, 1 after system, 2 after user,
# 3 after assistant. _KEEP[state][class] for the classes system, user,
# assistant, other; _NEXT[state] is the state after the one role that may be
# put there. The end may be 0 or 3; _TAIL completes the others.
_KEEP = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
_NEXT = (2, 2, 3, 2)
_PUT = ("u", "u", "a", "u")
_TAIL = {0: "", 3: "", 1: "ua", 2: "a"}
_AUDIT = str.maketrans("uaUA", "IIRR")
_NONE = 1 << 40
# A row's code: 'A' + 4 * class + fault.
_CLASSES = "sua"
_SOUND, _CUT, _GONE = 0, 1, 2


def _edges(codes: str) -> list[list[list[tuple]]]:
    """Edges (letter, rows taken, state, cost) out of every (row, state). A
    plan letter is u or a (insert), K, U or A (rerole) or D. No insert follows
    the last row."""
    out = []
    for code in codes:
        cls, fault = divmod(ord(code) - 65, 4)
        row = []
        for q in range(4):
            edges = [("D", 1, q, DELETE), (_PUT[q], 0, _NEXT[q], INSERT)]
            if fault < _GONE:
                extra = TRUNCATED if fault == _CUT else 0
                if _KEEP[q][cls] is not None:
                    edges.append(("K", 1, _KEEP[q][cls], KEEP + extra))
                edges.append((_PUT[q].upper(), 1, _NEXT[q], REROLE + extra))
            row.append(edges)
        out.append(row)
    return out + [[[], [], [], []]]


def _cheapest(edges: list, back: list, start: int, goal: int) -> tuple[int, str] | None:
    """(cost, plan) of the cheapest edits from ``start`` to ``goal``, the
    least audit among equals.

    Heaps are ordered by cost and then by row, so that a node is settled only
    after all that reach it at the same cost."""
    n = len(edges) - 1
    front, rear = {(0, start): (0, "", "")}, {(n, goal): (0, "", "")}
    heaps = [[(0, 0, start)], [(0, -n, goal)]]
    done: tuple[set, set] = (set(), set())
    best = _NONE
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        # both ends are settled first, so that every way crosses over
        side = int(bool(done[0]) and (not done[1] or heaps[1][0][0] < heaps[0][0][0]))
        cost, i, q = heapq.heappop(heaps[side])
        i = abs(i)
        if (i, q) in done[side]:
            continue
        done[side].add((i, q))
        mine, other = (rear, front) if side else (front, rear)
        _, audit, plan = mine[i, q]
        if (i, q) in other:
            best = min(best, cost + other[i, q][0])
        for letter, taken, to, w in (back if side else edges)[i][q]:
            node = (i - taken if side else i + taken, to)
            mark = letter.translate(_AUDIT)
            label = (cost + w, mark + audit, letter + plan) if side else (cost + w, audit + mark, plan + letter)
            if node not in mine or label < mine[node]:
                mine[node] = label
                heapq.heappush(heaps[side], (cost + w, -node[0] if side else node[0], to))
    found = None
    for i, q in done[0]:
        cost, audit, plan = front[i, q]
        crossings = [("", 0, q, 0)] if (i, q) == (n, goal) else edges[i][q]
        for letter, taken, to, w in crossings:
            node = (i + taken, to)
            if node in done[1] and cost + w + rear[node][0] == best:
                way = (audit + letter.translate(_AUDIT) + rear[node][1], plan + letter + rear[node][2])
                found = way if found is None else min(found, way)
    return None if found is None else (best, found[1])


def _reversed(edges: list) -> list:
    back = [[[] for _ in range(4)] for _ in edges]
    for i, row in enumerate(edges):
        for q, out in enumerate(row):
            for letter, taken, to, w in out:
                back[i + taken][to].append((letter, taken, q, w))
    return back


@lru_cache(maxsize=1 << 14)
def _ways(codes: str, entry: int) -> tuple[list[int], list[int], list[str]]:
    """Costs, audit ranks and plans of a segment from ``entry`` to each state."""
    edges = _edges(codes)
    back = _reversed(edges)
    ways = [_cheapest(edges, back, entry, goal) for goal in range(4)]
    order = sorted(w[1].translate(_AUDIT) for w in ways if w)
    return ([w[0] if w else _NONE for w in ways], [order.index(w[1].translate(_AUDIT)) if w else 4 for w in ways],
            [w[1] if w else "" for w in ways])


def _segment_ways(it):
    """Costs, ranks and plans of every segment for all 16 state pairs. A
    segment that starts inside a block starts its conversation, which is in
    state 0 there."""
    for batch in it:
        cost, rank, plans, wrong = [], [], [], []
        for codes, lo in zip(batch.column("codes").to_pylist(), batch.column("lo").to_pylist(), strict=True):
            ways = [_ways(codes, q) if q == 0 or lo % BLOCK == 0 else ([_NONE] * 4, [4] * 4, [""] * 4) for q in range(4)]
            cost.append([c for w in ways for c in w[0]])
            rank.append([r for w in ways for r in w[1]])
            plans.append([p for w in ways for p in w[2]])
            cls = [(ord(c) - 65) // 4 for c in codes]
            wrong.append(sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(cls, cls[1:])))
        yield pa.RecordBatch.from_arrays(
            [batch.column("cid"), batch.column("blk"), batch.column("lo"), batch.column("codes"),
             pa.array(cost, pa.list_(pa.int64())), pa.array(rank, pa.list_(pa.int32())),
             pa.array(plans, pa.list_(pa.string())), pa.array(wrong, pa.int64())],
            ["cid", "blk", "lo", "codes", "cost", "rank", "plans", "wrong"])


def _chained(it):
    """(cid, cost, illegal, picks): the way taken through every segment."""
    for batch in it:
        costs, wrongs, picks = [], [], []
        for parts in batch.column("parts").to_pylist():
            ahead = [INSERT * len(_TAIL[q]) for q in range(4)]
            todo = [ahead]
            for p in reversed(parts):
                ahead = [min(p["cost"][4 * q + x] + ahead[x] for x in range(4)) for q in range(4)]
                todo.append(ahead)
            todo.reverse()
            q, way = 0, []
            for p, here, after in zip(parts, todo, todo[1:]):
                x = min((x for x in range(4) if p["cost"][4 * q + x] + after[x] == here[q]),
                        key=lambda x, p=p, q=q: p["rank"][4 * q + x])
                way.append({"blk": p["blk"], "way": 4 * q + x, "tail": ""})
                q = x
            way[-1]["tail"] = _TAIL[q]
            wrong = sum(p["wrong"] for p in parts)
            for a, b in zip(parts, parts[1:]):
                pair = (ord(a["ends"][1]) - 65) // 4, (ord(b["ends"][0]) - 65) // 4
                wrong += pair not in ((0, 1), (1, 2), (2, 1))
            costs.append(todo[0][0])
            wrongs.append(wrong)
            picks.append(way)
        kind = pa.list_(pa.struct([("blk", pa.int64()), ("way", pa.int32()), ("tail", pa.string())]))
        yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(costs, pa.int64()), pa.array(wrongs, pa.int64()),
                                          pa.array(picks, kind)], ["cid", "cost", "illegal", "picks"])


def _hashed(it):
    """Hash of the lines of each conversation, from sorted rows."""
    at, digest, ids, hashes = None, None, [], []
    for batch in it:
        for cid, line in zip(batch.column("cid").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if cid != at:
                if digest is not None:
                    ids.append(at)
                    hashes.append(digest.hexdigest())
                at, digest = cid, hashlib.sha256(line)
            else:
                digest.update(b"\n")
                digest.update(line)
        if ids:
            yield pa.RecordBatch.from_pydict({"cid": ids, "repaired_sha256": hashes})
            ids, hashes = [], []
    if digest is not None:
        yield pa.RecordBatch.from_pydict({"cid": [at], "repaired_sha256": [digest.hexdigest()]})


def _class() -> Column:
    first = F.substring("role", 1, 1)
    out = F.lit(len(_CLASSES))
    for i, c in enumerate(_CLASSES):
        out = F.when(first == c, i).otherwise(out)
    return out


def faulty_rows(talks: DataFrame) -> DataFrame:
    """``cid, turn, role, text, pos, blk, class, fault`` of every row in
    order; pos is its place among all rows. A conversation's places follow one
    another within a block."""
    rows = talks.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("cid"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    order = ["cid", "turn", "role", "text", "salt"]
    # the place in the input parts rows that are equal in all else
    rows = rows.withColumn("salt", F.monotonically_increasing_id())
    size = int(talks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(rows.repartitionByRange(size, *order).sortWithinPartitions(*order).drop("salt")
                   .withColumn("pos", F.monotonically_increasing_id()))
    key = F.sha2(F.concat(F.length("cid"), F.lit(":"), "cid", F.length("role"), F.lit(":"), "role", "text"), 256)
    again = rows.groupBy(key.alias("key")).agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = rows.withColumn("key", key).join(again.select("key", "first"), "key", "left")
    last = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    return rows.select(
        "cid", "turn", "role", "text", "pos", F.expr(f"pos div {BLOCK}").alias("blk"), _class().alias("class"),
        F.when(last == "", "blank").when(F.col("pos") > F.col("first"), "duplicate")
         .when(~last.isin(".", "!", "?"), "truncated").alias("fault"))


def repair(talks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, lines): a row per conversation with faults, cost, audit and
    repaired_sha256; and the repaired rows (cid, pos, before, role, text), of
    which ``before`` names the roles inserted before the row ('u', 'a')."""
    rows = written(faulty_rows(talks))
    fault = F.when(F.col("fault") == "truncated", _CUT).when(F.col("fault").isNotNull(), _GONE).otherwise(_SOUND)
    code = F.char(65 + 4 * F.col("class") + fault)
    segments = rows.groupBy("cid", "blk").agg(
        F.min("pos").alias("lo"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", code.alias("code")))), lambda x: x["code"]), "")
        .alias("codes"))
    segments = written(segments.mapInArrow(
        _segment_ways, "cid string, blk long, lo long, codes string, cost array<long>, rank array<int>, "
                       "plans array<string>, wrong long"))
    part = F.struct("blk", "cost", "rank", "wrong",
                    F.concat(F.substring("codes", 1, 1), F.substring("codes", -1, 1)).alias("ends"))
    chain = written(segments.groupBy("cid").agg(F.array_sort(F.collect_list(part)).alias("parts")).mapInArrow(
        _chained, "cid string, cost long, illegal long, picks array<struct<blk: long, way: int, tail: string>>"))
    plans = written(segments.join(chain.select("cid", F.inline("picks")), ["cid", "blk"]).select(
        "cid", "blk", "lo", F.concat(F.element_at("plans", F.col("way") + 1), "tail").alias("plan")))

    def n(kind: str) -> Column:
        return F.count(F.when(F.col("fault") == kind, 1)).alias(kind)
    counts = rows.groupBy("cid").agg(
        n("blank"), n("duplicate"), n("truncated"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    audit = plans.groupBy("cid").agg(F.translate(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("blk", "plan"))), lambda x: x["plan"]), ""), "uaUA", "IIRR").alias("audit"))

    steps = plans.select("cid", "lo", F.posexplode(F.regexp_extract_all("plan", F.lit("[ua]*[KDUA]|[ua]+$"), F.lit(0))))
    steps = steps.select("cid", (F.col("lo") + F.col("pos")).alias("pos"), F.regexp_replace("col", "[KDUA]$", "").alias("before"),
                         F.regexp_extract("col", "[KDUA]$", 0).alias("act"))
    lines = steps.join(rows.select("cid", "pos", "role", "text"), ["cid", "pos"], "left").select(
        "cid", "pos", "before",
        F.when(F.col("act") == "K", F.col("role")).when(F.col("act") == "U", "user").when(F.col("act") == "A", "assistant")
         .alias("role"), F.when(F.col("act").isin("K", "U", "A"), F.col("text")).alias("text"))
    added = F.transform(F.split("before", ""), lambda c: F.when(c == "u", "user:").when(c == "a", "assistant:"))
    line = F.array_compact(F.concat(added, F.array(F.concat("role", F.lit(":"), "text"))))
    ordered = (lines.select("cid", "pos", line.alias("lines")).where(F.size("lines") > 0)
               .select("cid", "pos", F.array_join("lines", "\n").cast("binary").alias("line"))
               .repartition("cid").sortWithinPartitions("cid", "pos"))
    hashes = ordered.select("cid", "line").mapInArrow(_hashed, "cid string, repaired_sha256 string")
    report = (counts.join(chain.select("cid", "cost", "illegal"), "cid").join(audit, "cid")
              .join(hashes, "cid", "left"))
    return report, lines


def repaired(original: DataFrame, talks: DataFrame) -> DataFrame:
    """The report of ``talks`` for every conv_id of ``original``."""
    return settled(talks.sparkSession, lambda: _repaired(original, talks))


def _repaired(original: DataFrame, talks: DataFrame) -> DataFrame:
    report, _ = repair(talks)
    ids = original.select("conv_id").distinct().withColumn("cid", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c)
            for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(report, "cid", "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def damage(talks: DataFrame, kinds: int = 20) -> DataFrame:
    """``talks`` with the damage that ``crc32(conv_id:turn) % kinds`` names: 0
    drops the row, 1 empties its text, 2 removes its ``.``, ``!`` and ``?``, 3
    repeats it, 4 sets its role to user. A NULL is one space."""
    space = F.lit(" ")
    rows = talks.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                        (F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                                          F.coalesce(F.col("turn").cast("string"), space))) % kinds).alias("kind"))
    return rows.where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
         .alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
