import hashlib
import itertools
import random
import re

from pyspark.sql import functions as F

from playcohort.llm import conversations
from playcohort.llm.conversations import Repair
from playcohort.llm.queries import damaged, op11_conversation_repair

FORM = re.compile(r"(s?(ua)+)?")
INSERTS = ["", "u", "a", "ua", "au"]


def cheapest(rows):
    """All edits of a few (initial, must_go, truncated) rows, tried one by one."""
    best = None
    for kinds in itertools.product(["K", "u", "a", "D"], repeat=len(rows)):
        for more in itertools.product(INSERTS, repeat=len(rows) + 1):
            cost, form, audit = 2 * len("".join(more)), more[0], "I" * len(more[0])
            for (initial, must_go, truncated), kind, new in zip(rows, kinds, more[1:]):
                if kind != "D" and must_go or kind == "K" and initial not in "sua":
                    break
                cost += 3 if kind == "D" else truncated + (0 if kind == "K" else 2)
                form += {"K": initial, "D": ""}.get(kind, kind) + new
                audit += (kind if kind in "KD" else "R") + "I" * len(new)
            else:
                if FORM.fullmatch(form) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def by_strings(rows):
    """The same for long conversations, each state holding all its letters."""
    follow = conversations.NEXT

    def insert(ways):
        for state in ("", "s", "a", "u"):
            if state in ways:
                new = conversations.GIVEN[state]
                cost, letters = ways[state]
                ways[new] = min(ways.get(new, (9**9, "")), (cost + 2, letters + "I"))
        return ways

    ways = {"": (0, "")}
    for initial, must_go, truncated in rows:
        new = {}
        for state, (cost, letters) in insert(ways).items():
            options = [(state, cost + 3, "D")]
            if not must_go:
                options += [(follow[state][initial], cost + truncated, "K")] if initial in follow[state] else []
                options += [(conversations.GIVEN[state], cost + 2 + truncated, "R")]
            for target, price, letter in options:
                new[target] = min(new.get(target, (9**9, "")), (price, letters + letter))
        ways = new
    return min(way for state, way in insert(ways).items() if state in ("", "a"))


def searched(rows):
    search, letters, held = Repair(), [], 0
    for k, (initial, must_go, truncated) in enumerate(rows):
        letters += search.push(initial, must_go, truncated, (k,))
        held = max(held, k + 1 - sum(row is not None for _, _, row in letters))
    letters += search.finish()
    assert [row[0] for _, _, row in letters if row] == list(range(len(rows)))
    return (search.cost, "".join(letter for letter, *_ in letters)), held


def drawn(rng, n, initials="ssuuaax"):
    return [(rng.choice(initials), rng.random() < 0.2, rng.random() < 0.2) for _ in range(n)]


def test_every_short_conversation_against_all_edits():
    rng = random.Random(1)
    for n in (0, 1, 2, 3):
        for _ in range([1, 40, 40, 25][n]):
            rows = drawn(rng, n)
            assert searched(rows)[0] == cheapest(rows) == by_strings(rows)


def test_long_conversations_against_whole_strings():
    rng = random.Random(2)
    for _ in range(60):
        rows = drawn(rng, 400, rng.choice(["ua", "sua", "u", "ssuuaax"]))
        assert searched(rows)[0] == by_strings(rows)


def test_little_is_held():
    rng = random.Random(3)
    assert searched(drawn(rng, 20_000))[1] < 60
    assert searched([("ua"[k % 2], False, False) for k in range(20_000)])[1] < 10
    assert searched([("a", True, False)] * 20_000)[1] < 10
    # Two ways of different parity stay open, and the letters decide at the end.
    for n in (3_000, 3_001):
        assert searched([("s", False, False)] * n)[0] == by_strings([("s", False, False)] * n)
    assert searched([("x", True, False)] * 3_000)[0] == (9_000, "D" * 3_000)


def test_freed_nodes():
    search = Repair()
    rng = random.Random(4)
    for row in drawn(rng, 3_000):
        search.push(*row, ())
    alive, stack = set(), [node for _, node in search.ways.values()]
    while stack:
        node = stack.pop()
        if id(node) not in alive:
            alive.add(id(node))
            stack += [node.parent] if node.parent else []
    assert len(alive) < 120


def brute(rows):
    """The contract for the damaged (turn, role, text) rows of one conversation."""
    white = " \t\n\x0b\f\r"
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, flagged = set(), []
    faults = {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        end = text.strip(white)[-1:]
        fault = "blank" if not end else "duplicate" if (role, text) in seen else None if end in ".!?" else "truncated"
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        flagged.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(flagged, flagged[1:]))
    cost, audit = by_strings(flagged)
    out, form, left = [], "", iter(rows)
    for letter in audit:
        row = next(left) if letter != "I" else None
        if letter == "D":
            continue
        if letter == "K":
            form += row[1][0]
            out.append(f"{row[1]}:{row[2]}")
        else:
            form += "a" if form[-1:] == "u" else "u"
            out.append({"u": "user", "a": "assistant"}[form[-1]] + ":" + (row[2] if row else ""))
    assert FORM.fullmatch(form)
    return (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def grouped(rows):
    out = {}
    for conv, *row in rows:
        out.setdefault(conv, []).append(tuple(row))
    return out


def test_whole_table_against_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    want = {c: brute(rows) for c, rows in grouped(damaged(table).drop("col").collect()).items()}
    got = {r[0]: tuple(r)[1:] for r in op11_conversation_repair(spark, sf).collect()}
    ids = {r[0] for r in table.select("conv_id").distinct().collect()}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: want.get(c, empty) for c in ids}


def test_odd_rows(spark):
    rng = random.Random(5)
    texts = ["One.", "Two", "", " \t", None, "é🙂!", "x " * 50_000 + ".", "Three? \n"]
    rows = [
        (c, rng.choice([None, 0, 1, 2, 2**40, -5]), rng.choice(["user", "assistant", "system", "", "tool", None]), rng.choice(texts))
        for c in [None, 1, 2, 3, 3, 3, 4]
        for _ in range(12)
    ]
    rows += [(9, 0, "user", "Same."), (9, 0, "user", "Same."), (9, 1, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumn("conv", F.lit("x")).withColumn("seq", F.lit("y")).withColumn("_n", F.lit(1))
    found = conversations.edits(df)
    known = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = {c: brute(part) for c, part in grouped(known).items()}
    assert {r[0]: tuple(r)[1:] for r in conversations.summaries(found).collect()} == want
    kept = conversations.repaired(found).collect()
    assert conversations.summaries(conversations.edits(df.limit(0))).count() == 0
    # A repaired conversation needs nothing more, but for truncated and inserted texts.
    again = spark.createDataFrame(
        [(r.conv_id, r.seq, r.role, f"{r.seq}.") for r in kept], "conv_id long, turn long, role string, text string"
    )
    assert all(r.cost == 0 and set(r.audit) <= {"K"} for r in conversations.summaries(conversations.edits(again)).collect())


def test_one_shuffle_of_the_texts(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    found = conversations.summaries(conversations.edits(table))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
