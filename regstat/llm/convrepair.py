"""Conversation structure repair by a survivor-coalescence Viterbi.

A repaired conversation has the role initials ``(s?(ua)+)?``. Rows are kept
(K, 0), given another role (R, 1) or deleted (D, 2; the only edit of blank and
duplicate rows); empty user or assistant rows may be inserted anywhere (I, 5);
a truncated row that is not deleted adds 5. The cheapest edits are taken, and
of equally cheap ones those whose letters are least in ASCII.

The automaton of the wanted shape has four states, so a Viterbi step keeps at
most four survivors. Their edits form a backpointer tree with reference
counts: a node that no survivor stands on is freed, and as soon as all
survivors share an ancestor the edits above it are emitted. What stays in
memory is the unresolved part only. Ties are decided on the complete
unresolved suffixes: inserts stand before the row they precede, so the edits of
two survivors consume the same rows, end in a row's letter, and neither is a
prefix of the other. Their order never changes later, so each step carries the
survivors' order as a rank instead of comparing the letters anew.

A survivor is dropped if another one can take over each of its continuations
for less (``TAKE_OVER``), or for the same with lesser letters.

Conversations are dealt by hash and sorted inside their task. One with more
than ``segment_rows`` rows is cut into segments by range; each segment is
summed up as cost and rank of every (state before, state after), the segments
of a conversation go through the same survivors, and then every segment knows
its two states and is repaired on its own.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regstat.llm.common import buckets_for, written

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: state after an inserted or re-roled row, and the role that it gets
AFTER = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: most inserts before a row that can pay, by state; more lead back to a state
INSERTS = (2, 2, 1, 1)
#: inserts that close a conversation, by state
CLOSE = (0, 2, 1, 0)
#: TAKE_OVER[y][x]: most that a continuation of x costs more when it starts in
#: y: inserts to get there, a system row deleted instead of kept (2), or "ua"
#: inserted where x could end at once (10)
TAKE_OVER = ((0, 0, 5, 0), (10, 0, 5, 10), (7, 5, 0, 5), (2, 0, 5, 0))
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
WHITE = " \t\n\x0b\x0c\r"
SEGMENT_ROWS = 200_000

EDITS = ("conv_id long, segment long, pos long, edit string, turn long, role string, text string, "
         "new_role string, fault string")


def row_moves(initial: str, fault: str | None) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, letters) of everything one row allows."""
    out = []
    for state in STATES:
        at = state
        for k in range(INSERTS[state] + 1):
            cost, letters = INSERT * k, "I" * k
            out.append((state, at, cost + DELETE, letters + "D"))
            if fault not in ("blank", "duplicate"):
                more = cost + (TRUNCATED if fault == "truncated" else 0)
                if initial in NEXT[at]:
                    out.append((state, NEXT[at][initial], more + KEEP, letters + "K"))
                out.append((state, AFTER[at], more + REROLE, letters + "R"))
            at = AFTER[at]
    return out


def choose(costs: tuple, ranks: tuple, moves) -> tuple[tuple, tuple, tuple]:
    """One step: per state the cheapest way in (cost, then letters), without
    the states that another one takes over. Returns the new costs (None: no
    survivor), ranks and, per state, (state before, label)."""
    best: dict[int, tuple] = {}
    for before, after, cost, label in moves:
        if costs[before] is not None:
            key = (costs[before] + cost, ranks[before], label, before)
            if after not in best or key < best[after]:
                best[after] = key
    order = sorted(best, key=lambda s: best[s][1:3])
    place = {s: i for i, s in enumerate(order)}
    live = [x for x in order if not any(
        (best[y][0] + TAKE_OVER[y][x], place[y]) < (best[x][0], place[x]) for y in order if y != x)]
    return (tuple(best[s][0] if s in live else None for s in STATES),
            tuple(live.index(s) if s in live else None for s in STATES),
            tuple((best[s][3], best[s][2]) if s in live else None for s in STATES))


class Node:
    """An edit in the backpointer tree; ``refs`` counts its children and, if a
    survivor stands on it, the survivor."""

    __slots__ = ("parent", "step", "children", "refs")

    def __init__(self, parent, step):
        self.parent, self.step, self.children, self.refs = parent, step, [], 0


class Survivors:
    """Viterbi over the states; ``step`` returns what has become certain as
    (state before, state after, label, payload), in order."""

    def __init__(self, entry: int = START, known: dict | None = None):
        self.root = Node(None, None)
        self.root.refs = 1
        self.at = [self.root if s == entry else None for s in STATES]
        self.costs = tuple(0 if s == entry else None for s in STATES)
        self.ranks = self.costs
        self.spent = 0
        self.known = {} if known is None else known

    def step(self, moves, payload, kind=None) -> list:
        """``kind`` names the moves; a step seen before is taken from memory
        (costs are kept relative, so there are few of them)."""
        key = (self.costs, self.ranks, kind)
        found = self.known.get(key) if kind is not None else None
        if found is None:
            costs, ranks, ways = choose(self.costs, self.ranks, moves)
            least = min(c for c in costs if c is not None)
            found = (tuple(None if c is None else c - least for c in costs), ranks, ways, least)
            if kind is not None:
                self.known[key] = found
        self.costs, self.ranks, ways, least = found
        self.spent += least
        now = [None] * len(ways)
        for state, way in enumerate(ways):
            if way is not None:
                parent = self.at[way[0]]
                node = Node(parent, (way[0], state, way[1], payload))
                node.refs = 1
                parent.children.append(node)
                parent.refs += 1
                now[state] = node
        for node in self.at:
            if node is not None:
                self._release(node)
        self.at = now
        return self._emit()

    def _release(self, node: Node) -> None:
        node.refs -= 1
        while node.refs == 0 and node.parent is not None:
            parent = node.parent
            parent.children.remove(node)
            parent.refs -= 1
            node.parent = None
            node = parent

    def _emit(self) -> list:
        out = []
        while self.root.refs == 1 and self.root.children:
            child = self.root.children[0]
            child.parent = None
            out.append(child.step)
            self.root = child
        return out

    def finish(self, state: int) -> list:
        """All that is left on the way to ``state``."""
        path, node = [], self.at[state]
        while node is not self.root:
            path.append(node.step)
            node = node.parent
        return path[::-1]

    def best_end(self) -> int:
        return min((s for s in STATES if self.costs[s] is not None),
                   key=lambda s: (self.costs[s] + INSERT * CLOSE[s], self.ranks[s]))


class _Kinds:
    """Moves by (initial, fault); every initial but s, u, a allows the same."""

    def __init__(self):
        self.moves: dict = {}

    def of(self, role: str, fault: str | None):
        kind = (role[:1] if role[:1] in ("s", "u", "a") else "", fault)
        if kind not in self.moves:
            self.moves[kind] = row_moves(*kind)
        return kind, self.moves[kind]


def prepared(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) written with a number ``_id`` and
    the hash ``_h`` of the text; null roles and texts are one space."""
    space = F.lit(" ")
    base = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"))
    return written(base.withColumn("_h", F.sha2(F.encode("text", "UTF-8"), 256))
                   .withColumn("_id", F.monotonically_increasing_id()), "conv-rows")


def flagged(base: DataFrame) -> DataFrame:
    """``prepared`` rows with ``fault``: blank (only white space), duplicate
    (role and text stand earlier in the conversation), truncated (last
    character that is no white space not one of ``.!?``) or null; the first
    that holds.

    Duplicates are found from the smallest place of each (conversation, role,
    SHA-256 of the text), counted with partial aggregation; only keys that
    occur twice are joined back.
    """
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "_id")
    firsts = (base.groupBy("conv_id", "role", "_h").agg(F.min(place).alias("_first"),
                                                       F.count(F.lit(1)).alias("_n"))
              .filter("_n > 1")
              .select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"),
                      F.col("_h").alias("_g"), F.col("_first._id").alias("_first")))
    same = (F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r"))
            & (F.col("_h") == F.col("_g")))
    stripped = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = (F.when(stripped == "", "blank")
             .when(F.col("_first") != F.col("_id"), "duplicate")
             .when(~F.substring(stripped, -1, 1).isin(".", "!", "?"), "truncated"))
    return (base.join(firsts, same, "left").withColumn("fault", fault)
            .select("conv_id", "turn", "role", "text", "_id", "fault"))


def _summary(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A segment's cost and rank of every (state before, state after)."""
    table = table.sort_by("ord")
    kinds, known, costs, ranks = _Kinds(), {}, [], []
    rows = list(zip(table["role"].to_pylist(), table["fault"].to_pylist()))
    for entry in STATES:
        line = Survivors(entry, known)
        for role, fault in rows:
            kind, moves = kinds.of(role, fault)
            line.step(moves, None, kind)
        costs += [None if c is None else c + line.spent for c in line.costs]
        ranks += line.ranks
    return pa.table({"conv_id": pa.array([key[0].as_py()], pa.int64()),
                     "segment": pa.array([key[1].as_py()], pa.int64()),
                     "costs": pa.array([costs], pa.list_(pa.int64())),
                     "ranks": pa.array([ranks], pa.list_(pa.int32()))})


def _runs(batches, columns):
    """The rows of all batches, one after the other, with these columns."""
    for batch in batches:
        lists = [batch.column(c).to_pylist() for c in columns]
        yield from zip(*lists)


class _Out:
    """Rows gathered into Arrow batches."""

    def __init__(self, schema: pa.Schema, size: int = 8192):
        self.schema, self.size = schema, size
        self.rows: list[tuple] = []

    def full(self):
        if len(self.rows) >= self.size:
            yield from self.flush()

    def flush(self):
        if self.rows:
            columns = list(zip(*self.rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
            self.rows = []


_STATES_SCHEMA = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()),
                            ("entry", pa.int32()), ("leave", pa.int32())])


def _segment_states(batches):
    """(conv_id, segment, entry, leave) from the summaries of a conversation
    in order; ``leave`` is -1 for the last one, which ends where it is best.
    The newest segment waits for the next row, which tells whether it is the
    last one."""
    out, line, conv, newest = _Out(_STATES_SCHEMA), None, None, None

    def add(steps):
        out.rows.extend((conv, seg, before, after) for before, after, _, seg in steps)

    def end():
        if line is not None:
            add(line.step(*newest))
            add(line.finish(line.best_end()))
            out.rows[-1] = (*out.rows[-1][:3], -1)

    for c, segment, costs, ranks in _runs(batches, ("conv_id", "segment", "costs", "ranks")):
        if line is None or c != conv:
            end()
            line, conv = Survivors(), c
        else:
            add(line.step(*newest))
        yield from out.full()
        newest = ([(x, y, costs[4 * x + y], ranks[4 * x + y]) for x in STATES for y in STATES
                   if costs[4 * x + y] is not None], segment)
    end()
    yield from out.flush()


_EDITS_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("segment", pa.int64()), ("pos", pa.int64()), ("edit", pa.string()),
    ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("new_role", pa.string()),
    ("fault", pa.string())])


def _edits(batches):
    """The edits of sorted rows, emitted as the survivors coalesce."""
    out, kinds = _Out(_EDITS_SCHEMA), _Kinds()
    line, key, leave, pos, known = None, None, None, 0, {}

    def add(steps):
        nonlocal pos
        for before, _, letters, (turn, role, text, fault) in steps:
            at = before
            for letter in letters:
                if letter == "I":
                    at = AFTER[at]
                    out.rows.append((*key, pos, "I", None, None, "", ROLE[at], None))
                else:
                    new = None
                    if letter == "K":
                        new = role
                    elif letter == "R":
                        new = ROLE[AFTER[at]]
                    out.rows.append((*key, pos, letter, turn, role, text, new, fault))
                pos += 1

    def end():
        nonlocal pos
        if line is None:
            return
        state = line.best_end() if leave < 0 else leave
        add(line.finish(state))
        if leave < 0:
            for _ in range(CLOSE[state]):
                state = AFTER[state]
                out.rows.append((*key, pos, "I", None, None, "", ROLE[state], None))
                pos += 1

    columns = ("conv_id", "segment", "turn", "role", "text", "fault", "entry", "leave")
    for conv, segment, turn, role, text, fault, entry, to in _runs(batches, columns):
        if line is None or (conv, segment) != key:
            end()
            line, key, leave, pos = Survivors(entry, known), (conv, segment), to, 0
        kind, moves = kinds.of(role, fault)
        add(line.step(moves, (turn, role, text, fault), kind))
        yield from out.full()
    end()
    yield from out.flush()


def repair(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The cheapest edits of every conversation of ``rows`` (conv_id, turn,
    role, text), as one row per edit: conv_id, segment, pos (order within the
    segment), edit (K, R, D, I), turn, role, text, new_role (null: deleted),
    fault (blank, duplicate, truncated or null).

    Rows are taken by turn (nulls first), then role, then text. Null roles and
    texts are one space; rows with a null conv_id are one conversation; equal
    rows are each a row (all but the first are duplicates); other columns are
    ignored; an empty table gives no edits. ``segment_rows`` bounds the rows
    of a conversation in one task and never changes the edits.
    """
    base = prepared(rows)
    marked = flagged(base)
    order = ["conv_id", "turn", "role", "text", "_id"]
    giants = written(base.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_rows"))
                     .filter(F.col("_rows") > segment_rows), "conv-giants")
    total = giants.agg(F.sum("_rows")).first()[0] or 0
    small = marked.withColumns({"segment": F.lit(0).cast("long"),
                                "entry": F.lit(START), "leave": F.lit(-1)})
    parts = []
    if total:
        names = giants.select(F.col("conv_id").alias("_g"))
        big = marked.join(names, F.col("conv_id").eqNullSafe(F.col("_g")), "left_semi")
        big = (big.repartitionByRange(buckets_for(total, segment_rows), *order)
               .sortWithinPartitions(*order)
               .withColumn("ord", F.monotonically_increasing_id())
               .withColumn("segment", F.shiftright("ord", 33)))
        big = written(big, "conv-segments")
        sums = (big.select("conv_id", "segment", "ord", "role", "fault")
                .groupBy("conv_id", "segment")
                .applyInArrow(_summary, "conv_id long, segment long, costs array<long>, ranks array<int>"))
        states = written(sums.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
                         .mapInArrow(_segment_states,
                                     "conv_id long, segment long, entry int, leave int"), "conv-states")
        states = states.select(F.col("conv_id").alias("_c"), F.col("segment").alias("_s"), "entry", "leave")
        joined = big.join(states, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("segment") == F.col("_s")))
        parts.append(_repaired(joined, ["segment", "ord"]))
        small = small.join(names, F.col("conv_id").eqNullSafe(F.col("_g")), "left_anti")
    parts.append(_repaired(small, ["segment", "turn", "role", "text", "_id"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _repaired(rows: DataFrame, order: list[str]) -> DataFrame:
    return (rows.repartition("conv_id", "segment").sortWithinPartitions("conv_id", *order)
            .select("conv_id", "segment", "turn", "role", "text", "fault", "entry", "leave")
            .mapInArrow(_edits, EDITS))


_DIGEST_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
    ("repaired_sha256", pa.string())])
LEGAL = {"su", "ua", "au"}


class _Digest:
    """Running figures of one conversation."""

    def __init__(self, conv):
        self.conv, self.faults = conv, {"blank": 0, "duplicate": 0, "truncated": 0}
        self.low = self.high = self.before = None
        self.distinct = self.illegal = self.cost = 0
        self.audit, self.sha, self.rows = [], hashlib.sha256(), 0

    def add(self, edit, turn, role, text, new_role, fault):
        self.audit.append(edit)
        if edit != "I":
            if turn is not None and turn != self.high:
                self.low = turn if self.low is None else self.low
                self.high = turn
                self.distinct += 1
            if fault:
                self.faults[fault] += 1
            if self.before is not None and self.before + role[:1] not in LEGAL:
                self.illegal += 1
            self.before = role[:1]
        self.cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
        if edit in "KR" and fault == "truncated":
            self.cost += TRUNCATED
        if new_role is not None:
            self.sha.update((("\n" if self.rows else "") + new_role + ":" + text).encode())
            self.rows += 1
        if len(self.audit) > 65_536:
            self.audit = ["".join(self.audit)]

    def row(self):
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost,
                "".join(self.audit), self.sha.hexdigest())


def _digests(batches):
    out, now = _Out(_DIGEST_SCHEMA), None
    for conv, *rest in _runs(batches, ("conv_id", "edit", "turn", "role", "text", "new_role", "fault")):
        if now is None or conv != now.conv:
            if now is not None:
                out.rows.append(now.row())
            yield from out.full()
            now = _Digest(conv)
        now.add(*rest)
    if now is not None:
        out.rows.append(now.row())
    yield from out.flush()


def digest(edits: DataFrame) -> DataFrame:
    """One row per conversation of ``edits``: its gaps, faults, illegal
    neighbours, cost, audit (edit letters in order) and the SHA-256 of its
    repaired rows. A conversation's edits pass one task in order, row by row:
    a hash of the whole cannot be split; only the letters are kept."""
    return (edits.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "pos")
            .select("conv_id", "edit", "turn", "role", "text", "new_role", "fault")
            .mapInArrow(_digests, "conv_id long, gaps long, blank long, duplicate long, truncated long, "
                                  "illegal long, cost long, audit string, repaired_sha256 string"))


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` damaged by crc32(``conv_id:turn``) % 20: 0 drops the
    row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it a
    user's. Nulls are one space (also in the key); conv_id and turn stay null."""
    def text_of(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    how = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    return (conversations
            .select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"),
                    how.alias("_how"))
            .filter("_how <> 0")
            .withColumn("text", F.when(F.col("_how") == 1, "").when(F.col("_how") == 2, F.translate("text", ".!?", ""))
                        .otherwise(F.col("text")))
            .withColumn("role", F.when(F.col("_how") == 4, "user").otherwise(F.col("role")))
            .withColumn("_copy", F.explode(F.when(F.col("_how") == 3, F.array(F.lit(0), F.lit(1)))
                                           .otherwise(F.array(F.lit(0)))))
            .select("conv_id", "turn", "role", "text"))


def audit_conversations(conversations: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Damage, repair and digest ``conversations``: one row per original
    conv_id (a null one too). No rows after damage: zeros, an empty audit and
    the hash of the empty string; an empty table gives no rows."""
    found = digest(repair(damage(conversations), segment_rows))
    every = conversations.select(F.col("conv_id").cast("long").alias("_conv")).distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    none = hashlib.sha256(b"").hexdigest()
    return (every.join(found, F.col("_conv").eqNullSafe(F.col("conv_id")), "left")
            .select(F.col("_conv").alias("conv_id"),
                    *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in numbers],
                    F.coalesce(F.col("audit"), F.lit("")).alias("audit"),
                    F.coalesce(F.col("repaired_sha256"), F.lit(none)).alias("repaired_sha256")))
