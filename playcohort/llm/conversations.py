"""Repair of the structure of conversations by a Viterbi search with survivor coalescence.

A well-formed conversation has the role initials ``(s?(ua)+)?``: an optional system turn,
then user and assistant in turn. The cheapest edits that give this form are found row by row.
Four states say what the kept turns end with (nothing, s, u, a); each state keeps its
cheapest way there, the survivor, unless another state's beats it whatever may follow (else
the way that deletes everything would live on). The ways form a tree of back pointers whose nodes count the
ways that go through them. As soon as all survivors share an ancestor, the edits up to it are
final: they are emitted and their nodes dropped. What is held is the unresolved part only,
not the conversation (which a conversation full of turns to be given new roles may reach:
two ways of different parity then stay open). Ways of equal cost are decided by their whole
unresolved letters (D < I < K < R): survivors of a row are ranked by them, and since none is
a beginning of another, the ranks of the next row follow from these ranks and the letters
added, without walking back.

Rows are shuffled by conversation and sorted on disk by turn; repeats of role and text are
found by a window over the same shuffle. A conversation is one stream through one task: its
edits, and a digest of its repaired text, depend on the rows in order. A task holds one batch
of rows and the unresolved part, whatever the length of the conversation.

Nulls: a null role or text is read as one space, a null turn comes before all others and is
ignored for gaps, a null conversation is a conversation. Rows of one turn come in the order
of role and text, so repeated rows are neighbours; all but the first are duplicates. A role
with another initial than s, u or a (also an empty one) cannot be kept. An empty table gives
an empty table. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playcohort.llm.common import arrow_schema, bounded_batches

#: Costs of the edits, and of keeping the role or text of a truncated row.
KEEP, REROLE, INSERT, DELETE, TRUNCATED = 0, 2, 2, 3, 1
COST = {"K": KEEP, "R": REROLE, "I": INSERT, "D": DELETE}
WHITE = " \t\n\x0b\f\r"

#: State -> role initial -> state after a turn of that role; states name their last initial.
START = ""
NEXT = {START: {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
ROLE = {"u": "user", "a": "assistant"}
#: The only role that can follow a state, where a role is given to a turn.
GIVEN = {START: "u", "s": "u", "u": "a", "a": "u"}
COMPLETE = (START, "a")
#: (state, other) -> what it costs at most to go on from ``other`` whatever goes on from
#: ``state``: after a, only a system turn must go instead of staying; after u, an assistant
#: turn must be inserted before.
LEAD = {(START, "a"): DELETE, (START, "u"): DELETE + INSERT, ("s", "a"): 0, ("s", "u"): INSERT, ("s", START): 0, ("a", START): 0}


class Node:
    """One edit: ``refs`` counts the nodes and survivors that point at it, ``rank`` is the
    place of its letters among those of the survivors it is one of."""

    __slots__ = ("parent", "letter", "role", "row", "refs", "rank")

    def __init__(self, parent: Node | None, letter: str, role: str | None, row: tuple | None):
        self.parent, self.letter, self.role, self.row = parent, letter, role, row
        self.refs = self.rank = 0
        if parent:
            parent.refs += 1


class Repair:
    """The search over one conversation. ``push`` and ``finish`` return the edits that are
    final: (letter, role given or kept, row), the row being None for an insertion.

    Survivors end with the edit of a row. A way between two rows is (cost, rank of its
    survivor, letters since, the survivor); as survivors of one row have different letters and
    none begins another, these compare as the whole letters do.
    """

    def __init__(self) -> None:
        self.root = Node(None, "", None, None)
        self.root.refs = 1
        self.ways: dict[str, tuple[int, Node]] = {START: (0, self.root)}
        self.cost = 0

    def _with_insertions(self) -> dict[str, tuple[int, int, str, Node]]:
        ways = {state: (cost, node.rank, "", node) for state, (cost, node) in self.ways.items()}
        # At most two in a row help: more come back to a state they passed.
        for state in (START, "s", "a", "u"):
            if state in ways:
                cost, rank, letters, node = ways[state]
                way, given = (cost + INSERT, rank, letters + "I", node), GIVEN[state]
                if given not in ways or way[:3] < ways[given][:3]:
                    ways[given] = way
        return ways

    def _release(self, node: Node) -> None:
        """Free a way that nothing points at, up to what others still use."""
        while node.refs == 0 and node is not self.root:
            node = node.parent
            node.refs -= 1

    def push(self, initial: str, must_go: bool, truncated: bool, row: tuple) -> list[tuple]:
        more = TRUNCATED if truncated else 0
        best: dict[str, tuple] = {}
        for state, (cost, rank, letters, node) in self._with_insertions().items():
            options = [(state, cost + DELETE, "D", None)]
            if not must_go:
                options.append((GIVEN[state], cost + REROLE + more, "R", ROLE[GIVEN[state]]))
                if initial in NEXT[state]:
                    options.append((NEXT[state][initial], cost + KEEP + more, "K", None))
            for target, price, letter, role in options:
                way = (price, rank, letters + letter, node, role, state)
                if target not in best or way[:3] < best[target][:3]:
                    best[target] = way
        # A way that another beats whatever follows is no survivor.
        for (state, other), lead in LEAD.items():
            if state in best and other in best and best[other][0] + lead < best[state][0]:
                del best[state]
        ways, inserted = {}, {}
        ordered = sorted(best.items(), key=lambda item: item[1][1:3])
        for rank, (state, (cost, _, letters, node, role, via)) in enumerate(ordered):
            # The insertions before the row end in the state ``via``; ways share them.
            for given in ("ua" if via == "a" else "au")[3 - len(letters) :]:
                if node not in inserted:
                    inserted[node] = Node(node, "I", ROLE[given], None)
                node = inserted[node]
            last = Node(node, letters[-1], role, row)
            last.refs, last.rank = 1, rank
            ways[state] = (cost, last)
        for _, node in self.ways.values():
            node.refs -= 1
            self._release(node)
        self.ways = ways
        return self._settled()

    def _settled(self) -> list[tuple]:
        """Edits that all ways share; the last of them becomes the root."""
        if self.root.refs != 1:
            return []
        path, node = [], next(iter(self.ways.values()))[1]
        while node is not self.root:
            path.append(node)
            node = node.parent
        out = []
        while path and self.root.refs == 1:
            node = path.pop()
            out.append((node.letter, node.role, node.row))
            node.parent = None
            self.root = node
        return out

    def finish(self) -> list[tuple]:
        ways = self._with_insertions()
        state = min((s for s in COMPLETE if s in ways), key=lambda s: ways[s][:3])
        self.cost, _, letters, node = ways[state]
        path = [("I", ROLE[role], None) for role in ("a", "u")[: len(letters)]]
        while node is not self.root:
            path.append((node.letter, node.role, node.row))
            node = node.parent
        return path[::-1]


def edits(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """The edits of every conversation: ``conv_col``, ``seq`` (from 0), ``edit`` (K, R, D or I),
    ``turn``, ``role`` and ``text`` of the row (null for I), its ``fault`` (blank, duplicate,
    truncated or null), ``new_role`` and ``new_text`` (null for D), and the ``cost`` of the edit.

    The edits of a conversation lie together in one partition, in their order.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    space = F.lit(" ")
    rows = df.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), space).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), space).alias("text"),
    )
    # The windows and the sort below reuse this shuffle.
    rows = rows.repartition("conv").withColumn("_same", F.md5(F.col("text").cast("binary")))
    seen = Window.partitionBy("conv", "role", "_same").orderBy(F.asc_nulls_first("turn"))
    rows = rows.withColumn("_n", F.row_number().over(seen))
    shown = F.rtrim("text", F.lit(WHITE))
    fault = (
        F.when(shown == "", "blank")
        .when(F.col("_n") > 1, "duplicate")
        .when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), "truncated")
    )
    ordered = rows.sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text", "_n").select(
        "conv", "turn", "role", "text", fault.alias("fault")
    )
    conv = T.StructField("conv", rows.schema["conv"].dataType)
    schema = T.StructType([conv]).add("seq", "long").add("edit", "string").add("turn", "long").add("role", "string")
    schema = schema.add("text", "string").add("fault", "string").add("new_role", "string").add("new_text", "string")
    schema = schema.add("cost", "long")
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        state: Repair | None = None
        current, seq = None, 0

        def emit(found: list[tuple]) -> None:
            nonlocal seq
            for letter, role, row in found:
                turn, old, text, fault = row or (None, None, None, None)
                kept = letter != "D"
                cost = COST[letter] + (TRUNCATED if kept and fault == "truncated" else 0)
                new = (role or old, text or "") if kept else (None, None)
                out.append((current, seq, letter, turn, old, text, fault, *new, cost))
                seq += 1

        def flush() -> pa.RecordBatch:
            nonlocal out
            done, out = out, []
            return batch_of(done, target)

        for batch in batches:
            for name, *row in zip(*[column.to_pylist() for column in batch.columns]):
                if state is None or name != current:
                    if state is not None:
                        emit(state.finish())
                    state, current, seq = Repair(), name, 0
                fault = row[3]
                emit(state.push(row[1][:1], fault in ("blank", "duplicate"), fault == "truncated", tuple(row)))
            yield flush()
        if state is not None:
            emit(state.finish())
            yield flush()

    return ordered.mapInArrow(run, schema).withColumnRenamed("conv", conv_col)


def repaired(found: DataFrame) -> DataFrame:
    """The repaired conversations of ``edits``, as the rows that stay and those inserted."""
    kept = found.where(F.col("edit") != "D")
    return kept.select(found.columns[0], "seq", "turn", F.col("new_role").alias("role"), F.col("new_text").alias("text"))


class Summary:
    """Figures of one conversation, from its edits in order."""

    def __init__(self) -> None:
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.first = self.last = self.before = None
        self.turns = self.illegal = self.cost = 0
        self.letters: list[str] = []
        self.digest = hashlib.sha256()
        self.empty = True

    def add(self, letter, turn, role, fault, new_role, new_text, cost) -> None:
        self.letters.append(letter)
        self.cost += cost
        if letter != "I":
            if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = role[:1]
            if fault:
                self.faults[fault] += 1
            if turn is not None and turn != self.last:
                self.first = turn if self.first is None else self.first
                self.last = turn
                self.turns += 1
        if letter != "D":
            line = f"{new_role}:{new_text}"
            self.digest.update((line if self.empty else "\n" + line).encode())
            self.empty = False

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.letters), self.digest.hexdigest())


def summaries(found: DataFrame) -> DataFrame:
    """One row per conversation of ``edits``: the ``gaps`` in its turns, its ``blank``,
    ``duplicate`` and ``truncated`` rows, its ``illegal`` neighbours, ``cost`` and ``audit`` (the
    letters of its edits) and the SHA-256 of the repaired ``role:text`` lines.

    Reads the edits as ``edits`` leaves them, a stream per conversation; of a conversation only
    the letters and a running digest are held.
    """
    conv = found.columns[0]
    names = ["edit", "turn", "role", "fault", "new_role", "new_text", "cost"]
    schema = T.StructType([T.StructField(conv, found.schema[conv].dataType)])
    for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"):
        schema = schema.add(name, "long")
    schema = schema.add("audit", "string").add("repaired_sha256", "string")
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: Summary | None = None
        current = None
        for batch in batches:
            done = []
            for name, seq, *edit in zip(*[column.to_pylist() for column in batch.columns]):
                if seq == 0:
                    if state is not None:
                        done.append((current, *state.row()))
                    state, current = Summary(), name
                state.add(*edit)
            yield batch_of(done, target)
        if state is not None:
            yield batch_of([(current, *state.row())], target)

    return found.select(conv, "seq", *names).mapInArrow(run, schema)


def batch_of(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(target)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, target)], schema=target)
