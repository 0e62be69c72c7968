"""Repairing the structure of conversations with the cheapest edits: survivor-coalescence Viterbi.

The roles of a sound conversation start with the letters ``(s?(ua)+)?``: perhaps a system turn, then pairs of user and
assistant. Turns are kept, given the other role, deleted, or put in without text; each edit has a cost, and of
equally cheap repairs the one whose edits' first letters come first in ASCII order wins.

A conversation streams through its task in order. Four states (nothing yet, system, user and assistant last) each have
one survivor, the best way there; ways that cannot win any more are dropped. Survivors are leaves of a tree of
backpointers with counted references: what no survivor needs is freed, and as soon as all survivors share an ancestor,
the edits up to it are final and leave the task. So memory holds only the undecided end of one conversation.

Ties need the complete undecided ends. Inserts belong to the turn behind them, so every survivor's end has as many
turns and none is another's beginning: the order of two ends is that of their parents, or of their last letters if
they share one. Carrying the order of the survivors along so compares complete ends at a fixed cost.
"""

from __future__ import annotations

import hashlib
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where the turn that must follow a state leads, and its role.
FOLLOWING = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
#: Where a kept turn leads, by its role's first letter.
KEPT = {(START, "s"): SYSTEM, **{(s, r[0]): to for s, (to, r) in FOLLOWING.items()}}
#: What it costs at most to go on from one state as another could: (from, as) -> cost.
_BRIDGE = {(0, 1): 0, (0, 2): 5, (0, 3): 0, (1, 0): 10, (1, 2): 5, (1, 3): 10, (2, 0): 7, (2, 1): 5, (2, 3): 5, (3, 0): 2, (3, 1): 0, (3, 2): 5}
_SPACE = " \t\n\x0b\x0c\r"
_BATCH_ROWS, _BATCH_CHARS = 20_000, 4 << 20
#: Names of the edits by their letters.
EDITS = {"K": "Keep", "R": "Rerole", "D": "Delete", "I": "Insert"}


def fault_of(text: str, repeated: bool) -> str | None:
    """The first fault of a turn: blank, duplicate, truncated (its last character ends no sentence), or none."""
    end = text.rstrip(_SPACE)[-1:]
    return "blank" if not end else "duplicate" if repeated else None if end in ".!?" else "truncated"


@cache
def _moves(fault: str | None, initial: str) -> tuple[tuple[int, int, int, str], ...]:
    """(from, to, cost, letters) of the best way over one turn, inserts before it included, for each pair of states."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in range(4):
        state, cost, letters = start, 0, ""
        for _ in range(3):  # a third insert in a row would lead where fewer do
            ways = [(state, cost + DELETE, letters + "D")]
            if fault not in ("blank", "duplicate"):
                left = cost + (TRUNCATED if fault else 0)
                ways.append((FOLLOWING[state][0], left + REROLE, letters + "R"))
                if (state, initial) in KEPT:
                    ways.append((KEPT[state, initial], left, letters + "K"))
            for to, total, way in ways:
                best[start, to] = min(best.get((start, to), (total, way)), (total, way))
            state, cost, letters = FOLLOWING[state][0], cost + INSERT, letters + "I"
    return tuple((a, b, cost, way) for (a, b), (cost, way) in best.items())


class _Node:
    """An edit on the way to a survivor; ``held`` if a survivor ends here."""

    __slots__ = ("parent", "children", "letter", "turn", "held")

    def __init__(self, parent, letter, turn):
        self.parent, self.letter, self.turn = parent, letter, turn
        self.children, self.held = [], False


class Repair:
    """The survivors of one conversation; ``add`` and ``end`` yield (letter, turn, role) of edits that are final."""

    def __init__(self):
        self.root = _Node(None, "", None)
        self.root.held = True
        self.state = START  # behind the root
        self.survivors = {START: (0, 0, self.root)}  # state -> cost, order among the survivors, node

    def add(self, turn, role: str, fault: str | None):
        best: dict[int, tuple] = {}
        for start, to, cost, way in _moves(fault, role[:1] if role[:1] in "sua" else ""):
            if start in self.survivors:
                before, order, node = self.survivors[start]
                found = (before + cost, order, way)
                if to not in best or found < best[to][0]:
                    best[to] = (found, node)
        least = {s: found[0] for s, (found, _) in best.items()}
        best = {s: x for s, x in best.items() if all(least[b] + _BRIDGE[b, s] >= least[s] for b in least if b != s)}
        ordered = sorted(best, key=lambda s: best[s][0][1:])
        self._replace({s: (best[s][0][0], k, *best[s]) for k, s in enumerate(ordered)}, turn)
        yield from self._final()

    def _replace(self, chosen, turn):
        old = [node for _, _, node in self.survivors.values()]
        self.survivors = {}
        for state, (cost, order, (_, _, way), node) in chosen.items():
            for letter in way:
                child = _Node(node, letter, turn if letter != "I" else None)
                node.children.append(child)
                node = child
            node.held = True
            self.survivors[state] = (cost, order, node)
        for node in old:
            node.held = False
            while not node.children and not node.held and node is not self.root:
                node.parent.children.remove(node)
                node = node.parent

    def _final(self):
        while len(self.root.children) == 1 and not self.root.held:
            self.root = self.root.children[0]
            self.root.parent = None
            yield self._edit(self.root.letter, self.root.turn)

    def _edit(self, letter, turn):
        role = None
        if letter in "RI":
            self.state, role = FOLLOWING[self.state]
        elif letter == "K":
            self.state = KEPT[self.state, turn[1][:1]]
        return letter, turn, role

    def end(self):
        """The rest of the edits, when no more turns come."""
        closing = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
        found = [(cost + INSERT * len(closing[s]), order, closing[s], node) for s, (cost, order, node) in self.survivors.items()]
        _, _, way, node = min(found, key=lambda x: x[:2])
        last = []
        while node is not self.root:
            last.append((node.letter, node.turn))
            node = node.parent
        for letter, turn in [*reversed(last), *((x, None) for x in way)]:
            yield self._edit(letter, turn)


def in_order(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies, first), each conversation sorted in one partition.

    Equal rows become one with their number. ``first`` says that no earlier turn has the same role and text. Null
    roles and texts count as empty; null turns come first; a null conversation is one like others.
    """
    rows = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("mark", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    earliest = rows.groupBy("conv", "mark").agg(F.min("turn").alias("from"), F.max(F.col("turn").isNull()).alias("unplaced"))
    earliest = earliest.withColumnsRenamed({"conv": "conv_", "mark": "mark_"})
    marked = rows.join(earliest, rows["conv"].eqNullSafe(earliest["conv_"]) & (rows["mark"] == earliest["mark_"]))
    first = F.when(F.col("unplaced"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("from"))
    rows = marked.select("conv", "turn", "role", "text", "copies", first.alias("first"))
    return rows.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, edit, turn, old_role, role, text, fault, cost): the edits of every conversation, one row each.

    ``place`` runs from 0 in each conversation, ``edit`` is Keep, Rerole, Delete or Insert. ``old_role`` is the role
    before the edit (null for an insert), ``role`` the one after it (null for a deleted turn), ``fault`` the turn's own
    first fault. ``cost`` of an edit includes that of a truncated turn that stays. Turns stand in the order of turn,
    role and text, nulls first; equal rows repeat each other. Null roles and texts count as empty, a null conversation
    is one like others, an empty table has no edits, further columns are not read. The rows of a conversation lie
    together in one partition, in order.
    """
    keys = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"))
    kinds = {f.name: f.type for f in to_arrow_schema(keys.schema)}
    names = "conv place edit turn old_role role text fault cost".split()
    text = pa.string()
    types = dict(zip(names, [kinds["conv"], pa.int64(), text, kinds["turn"], text, text, text, text, pa.int64()]))

    def run(batches):
        out, chars = [], 0
        current, conv, place = None, None, 0

        def written():
            columns = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(c, types[n]) for n, c in zip(names, columns)], names)

        def put(letter, turn, role):
            nonlocal place, chars
            number, old, words, fault = turn or (None, None, "", None)
            cost = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[letter] + (TRUNCATED if fault == "truncated" and letter != "D" else 0)
            out.append((conv, place, EDITS[letter], number, old, old if letter == "K" else role, words, fault, cost))
            place, chars = place + 1, chars + len(words)

        for batch in batches:
            for key, number, role, words, copies, first in zip(*(c.to_pylist() for c in batch.columns)):
                if current is None or key != conv:
                    if current is not None:
                        for edit in current.end():
                            put(*edit)
                    current, conv, place = Repair(), key, 0
                for copy in range(copies):
                    fault = fault_of(words, copy > 0 or not first)
                    for edit in current.add((number, role, words, fault), role, fault):
                        put(*edit)
                    if len(out) >= _BATCH_ROWS or chars >= _BATCH_CHARS:
                        yield written()
                        out, chars = [], 0
        if current is not None:
            for edit in current.end():
                put(*edit)
        if out:
            yield written()

    kind = dict(keys.dtypes)
    schema = f"conv {kind['conv']}, place long, edit string, turn {kind['turn']}, old_role string, role string, text string, fault string, cost long"
    return in_order(conversations, conv_col, turn_col, role_col, text_col).mapInArrow(run, schema)


class _Audit:
    """What the edits of one conversation come to, taken one after the other."""

    def __init__(self):
        self.turns, self.least, self.most, self.last = 0, None, None, None
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.cost, self.letters, self.before = 0, 0, [], None
        self.hash, self.lines = hashlib.sha256(), 0

    def add(self, edit, turn, old_role, role, text, fault, cost):
        self.cost += cost
        self.letters.append(edit[0])
        if old_role is not None:
            initial = old_role[:1]
            if self.before is not None and self.before + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = initial
            if fault:
                self.faults[fault] += 1
            if turn is not None and turn != self.last:  # turns come in order
                self.turns, self.last = self.turns + 1, turn
                self.least, self.most = turn if self.least is None else self.least, turn
        if role is not None:
            self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
            self.lines += 1

    def row(self, conv):
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return (conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.letters), self.hash.hexdigest())


def audits(edits: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) from the rows of ``repair``.

    Reads the edits where ``repair`` left them, in order and without a shuffle. ``gaps`` counts the missing numbers
    between the first and the last turn, the next three the turns by their first fault, ``illegal`` the neighbours whose
    roles may not follow each other; ``audit`` has the first letter of each edit, and the digest is that of the repaired
    ``role:text`` lines. A conversation is one run of rows, of which only counters and the audit are kept.
    """
    names = "conv gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    types = [to_arrow_schema(edits.select("conv").schema).field(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
    wanted = "conv edit turn old_role role text fault cost".split()

    def run(batches):
        current, conv = None, None
        for batch in batches:
            done = []
            for key, *edit in zip(*(batch.column(c).to_pylist() for c in wanted)):
                if current is None or key != conv:
                    if current is not None:
                        done.append(current.row(conv))
                    current, conv = _Audit(), key
                current.add(*edit)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(current.row(conv), types)], names)

    kind = dict(edits.dtypes)["conv"]
    return edits.mapInArrow(run, f"conv {kind}, " + ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in list(zip(names, types))[1:]))


def damage(conversations: DataFrame) -> DataFrame:
    """The conversations as the check of the repair wants them damaged: by the CRC32 of conversation and turn.

    Of 20 remainders 0 drops a row, 1 empties its text, 2 takes the ends of its sentences, 3 repeats it, and 4 makes it
    a user's. Null roles and texts become one space before, null ids one space in the number.
    """
    name = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")))
    code = F.crc32(name.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return conversations.where(code != 0).select(
        "conv_id", "turn", F.when(code == 4, "user").otherwise(role).alias("role"),
        F.when(code == 1, "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


#: The same over DuckDB: the damage, and Viterbi turn by turn with whole audits.
ORACLE = r"""
WITH RECURSIVE coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::UBIGINT)),
      lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, zero: xor(x >> 1, 3988292384::UBIGINT * (x & 1::UBIGINT)))), 4294967295::UBIGINT) % 20 AS code
  FROM conversations),
turns AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded WHERE code <> 0),
marked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
    regexp_extract(text, '(?s)([^ 	-])[ 	-]*\z', 1) AS ending
  FROM turns),
numbered AS (
  SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM marked),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM numbered GROUP BY conv_id),
follow(state, "to", role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
filled AS (
  SELECT state AS start, state, 0 AS cost, '' AS way, []::VARCHAR[] AS lines FROM follow
  UNION ALL SELECT state, "to", 5, 'I', [role || ':'] FROM follow
  UNION ALL SELECT a.state, b."to", 10, 'II', [a.role || ':', b.role || ':'] FROM follow a JOIN follow b ON b.state = a."to"),
best AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, "to", cost, audit, lines FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, "to" ORDER BY cost, audit) AS rank FROM (
      SELECT b.conv_id, n.i,
        CASE e.letter WHEN 'D' THEN x.state WHEN 'R' THEN f."to" ELSE CASE WHEN x.state = 0 AND left(n.role, 1) = 's' THEN 1 WHEN left(n.role, 1) = left(f.role, 1) THEN f."to" END END AS "to",
        b.cost + x.cost + CASE e.letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN e.letter <> 'D' AND n.fault = 'truncated' THEN 5 ELSE 0 END AS cost,
        b.audit || x.way || e.letter AS audit,
        list_concat(b.lines, list_concat(x.lines, CASE e.letter WHEN 'D' THEN [] WHEN 'R' THEN [f.role || ':' || n.text] ELSE [n.role || ':' || n.text] END)) AS lines
      FROM best b JOIN numbered n ON n.conv_id IS NOT DISTINCT FROM b.conv_id AND n.i = b.i + 1
      JOIN filled x ON x.start = b.state JOIN follow f ON f.state = x.state
      CROSS JOIN (VALUES ('D'), ('K'), ('R')) e(letter)
      WHERE e.letter = 'D' OR n.fault NOT IN ('blank', 'duplicate')) WHERE "to" IS NOT NULL) WHERE rank = 1),
ended AS (
  SELECT b.conv_id, b.cost + x.cost AS cost, b.audit || x.way AS audit, list_concat(b.lines, x.lines) AS lines
  FROM best b JOIN filled x ON x.start = b.state
  WHERE x.state IN (0, 3) AND b.i = coalesce((SELECT max(n.i) FROM numbered n WHERE n.conv_id IS NOT DISTINCT FROM b.conv_id), 0)),
chosen AS (
  SELECT * FROM ended QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
SELECT h.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
  coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, h.cost::BIGINT AS cost, h.audit,
  sha256(array_to_string(h.lines, chr(10))) AS repaired_sha256
FROM chosen h LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM h.conv_id
"""
