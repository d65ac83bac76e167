"""Conversation structure repair: the cheapest edits that make turns alternate, found in one bounded pass.

A repaired conversation's role initials read (s?(ua)+)?.  Rows are kept (K, cost 0), given the role
user or assistant (R, 3) or deleted (D, 4; required for blank and duplicate rows); empty turns of user
or assistant are inserted anywhere (I, 3); a truncated row that isn't deleted adds 3.  Among the
cheapest edit lists the one whose initials are least in ASCII order counts.

1. Faults.  A row is a duplicate if its role and text were seen earlier in the conversation.  Rows are
   counted by (conversation, role, text digest) with partial sums; only what occurs more than once is
   joined back with its first turn, so no task holds a conversation's texts.
2. Viterbi.  Rows are dealt by conversation, sorted by turn and streamed.  Four states (nothing yet, after
   system, after user, after assistant) each have one survivor: its cost and a node of a backpointer tree
   of edits.  Nodes count their references (survivors and children) and are freed at 0.  As soon as all
   survivors share an ancestor the edits up to it are final and are emitted with their rows, so
   memory follows the longest stretch that is still undecided.  A survivor that any completion could
   leave for a strictly cheaper one is dropped, so "nothing yet" doesn't hold back the others.
3. Ties.  Two equally cheap ways into a state are compared over everything not yet emitted, from
   their last common ancestor on.  Neither can be the other's beginning: they'd differ by insertions
   alone, and those cost.  So the order of two ways is settled where they part, and stays so.

Order: by turn (nulls first), then role, then text.  One conversation is streamed by one task, however long;
its rows are sorted on disk if need be.

Defined cases: null role or text is one space; null conv_ids are one conversation; rows with ``present``
false only announce their conversation; a conversation without rows has no edits; other columns are
ignored; repeated rows are duplicates; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petrograph.llm.common import WORD, batch, columns

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; what initial leads where.
STEP = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
FINAL = (0, 3)
#: What a completion of the first state may cost more if begun from the second: a kept system row goes.
EXCESS = {(0, 3): DELETE, (1, 3): 0}


class EditTree:
    """Backpointer tree of edits: arrays with a free list, and a reference count for each node.

    A node's children have different letters, as a state allows one role only for each edit.  So of two
    ways the one with the smaller letter below their last common ancestor comes first.  Jump pointers
    find that ancestor in a logarithmic number of steps, however long the undecided stretch is.
    """

    def __init__(self) -> None:
        self.letter, self.role = bytearray(1), bytearray(1)
        self.parent, self.refs, self.depth = array("q", [-1]), array("q", [0]), array("q", [0])
        self.jump, self.jump_depth = array("q", [0]), array("q", [0])
        self.free: list[int] = []
        self.root = 0
        self.hold(0)

    def hold(self, at: int) -> None:
        self.refs[at] += 1

    def release(self, at: int) -> None:
        """Give up one reference; nodes without any are free."""
        self.refs[at] -= 1
        while self.refs[at] == 0:
            self.free.append(at)
            at = self.parent[at]
            self.refs[at] -= 1

    def add(self, parent: int, letter: str, role: str) -> int:
        """A new node, held once."""
        self.hold(parent)
        values = (ord(letter), ord(role), parent, 1, self.depth[parent] + 1, *self._jump(parent))
        arrays = (self.letter, self.role, self.parent, self.refs, self.depth, self.jump, self.jump_depth)
        if self.free:
            at = self.free.pop()
            for column, value in zip(arrays, values, strict=True):
                column[at] = value
            return at
        for column, value in zip(arrays, values, strict=True):
            column.append(value)
        return len(self.letter) - 1

    def _jump(self, parent: int) -> tuple[int, int]:
        """Jump of a child of parent: two jumps of the parent if they are of one length, else the parent."""
        least, depth = self.depth[self.root], self.depth[parent]
        if self.jump_depth[parent] >= least:
            over = self.jump[parent]
            if self.jump_depth[over] >= least and depth - self.depth[over] == self.depth[over] - self.jump_depth[over]:
                return self.jump[over], self.jump_depth[over]
        return parent, depth

    def _raised(self, at: int, depth: int) -> int:
        """The ancestor of a node at a depth below its own, or the node."""
        while self.depth[at] > depth:
            at = self.jump[at] if self.jump_depth[at] >= depth else self.parent[at]
        return at

    def _parting(self, a: int, b: int) -> tuple[int, int]:
        """The first nodes on the two ways that differ; one node twice, if one way is the other's beginning."""
        depth = min(self.depth[a], self.depth[b])
        a, b = self._raised(a, depth), self._raised(b, depth)
        while a != b and self.parent[a] != self.parent[b]:
            far = (self.jump_depth[a] == self.jump_depth[b] >= self.depth[self.root] and self.jump[a] != self.jump[b])
            a, b = (self.jump[a], self.jump[b]) if far else (self.parent[a], self.parent[b])
        return a, b

    def less(self, a: int, b: int) -> bool:
        """Whether a's edits come before b's in ASCII order."""
        x, y = self._parting(a, b)
        return self.letter[x] < self.letter[y] if x != y else self.depth[a] < self.depth[b]

    def common(self, a: int, b: int) -> int:
        """The last common ancestor."""
        x, y = self._parting(a, b)
        return x if x == y else self.parent[x]

    def path(self, at: int) -> list[tuple[str, str]]:
        """(edit, role initial) of each node below the root, down to this one."""
        out = []
        while at != self.root:
            out.append((chr(self.letter[at]), chr(self.role[at])))
            at = self.parent[at]
        return out[::-1]

    def settle(self, nodes: list[int]) -> list[tuple[str, str]]:
        """Make the last common ancestor of the held nodes the root; the edits down to it."""
        # The root is held by itself and by each child: two children, and nothing is settled.
        if self.refs[self.root] != 2 or self.root in nodes:
            return []
        low = nodes[0]
        for node in nodes[1:]:
            low = self.common(low, node)
        done = self.path(low)
        self.hold(low)
        at = low
        while at != self.root:      # every node on the way has this one child only
            at = self.parent[at]
            self.free.append(at)
        self.parent[low], self.root = -1, low
        return done


class Repair:
    """The survivors of one conversation; ``row`` and ``end`` return the edits that have become final."""

    def __init__(self) -> None:
        self.tree = EditTree()
        self.alive: dict[int, tuple[int, int]] = {0: (0, 0)}    # state: cost, node
        self.tree.hold(0)
        self._insertions(self.alive)

    def _offer(self, into: dict[int, tuple[int, int]], state: int, cost: int, parent: int, letter: str, role: str) -> bool:
        """Take the way into a state if it is cheaper, or as cheap and earlier in ASCII order."""
        old = into.get(state)
        if old and old[0] < cost:
            return False
        node = self.tree.add(parent, letter, role)
        if old and old[0] == cost and not self.tree.less(node, old[1]):
            self.tree.release(node)
            return False
        into[state] = (cost, node)
        if old:
            self.tree.release(old[1])
        return True

    def _insertions(self, states: dict[int, tuple[int, int]]) -> None:
        changed = True
        while changed:
            changed = False
            for state in sorted(states):
                cost, node = states[state]
                for role in STEP[state].keys() & ROLES.keys():
                    changed |= self._offer(states, STEP[state][role], cost + INSERT, node, "I", role)

    def row(self, initial: str, must_go: bool, truncated: bool) -> list[tuple[str, str]]:
        extra = TRUNCATED if truncated else 0
        after: dict[int, tuple[int, int]] = {}
        for state, (cost, node) in self.alive.items():
            self._offer(after, state, cost + DELETE, node, "D", "-")
            for role, to in () if must_go else STEP[state].items():
                if role == initial:
                    self._offer(after, to, cost + KEEP + extra, node, "K", role)
                elif role in ROLES:
                    self._offer(after, to, cost + REROLE + extra, node, "R", role)
        self._insertions(after)
        gone = [node for _, node in self.alive.values()]
        for (state, other), more in EXCESS.items():
            if state in after and other in after and after[other][0] + more < after[state][0]:
                gone.append(after.pop(state)[1])
        for node in gone:
            self.tree.release(node)
        self.alive = after
        return self.tree.settle([node for _, node in after.values()])

    def end(self) -> tuple[int, list[tuple[str, str]]]:
        """The cost and the remaining edits of the best survivor that may end the conversation."""
        best = None
        for cost, node in (self.alive[state] for state in FINAL if state in self.alive):
            if best is None or cost < best[0] or (cost == best[0] and self.tree.less(node, best[1])):
                best = (cost, node)
        return best[0], self.tree.path(best[1])


# -- faults -----------------------------------------------------------------------------------
def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def with_faults(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present, fault: blank, duplicate, truncated or null.

    Among rows alike in conversation, turn, role and text all but one are duplicates; that one is settled
    by the stream, which has them side by side.
    """
    present = F.coalesce(F.col("present"), F.lit(False)) if "present" in conversations.columns else F.lit(True)
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                                _text("role").alias("role"), _text("text").alias("text"), present.alias("present"))
    same = F.unhex(F.md5(F.concat(F.hex("role"), F.lit(":"), F.col("text"))))
    order = F.coalesce(F.col("turn").cast("decimal(20,0)"), F.lit("-10000000000000000000").cast("decimal(20,0)"))
    tagged = rows.withColumn("_same", same).withColumn("_order", order)
    again = (tagged.filter("present").groupBy(F.col("conv_id").alias("_conv"), F.col("_same").alias("_again"))
             .agg(F.min("_order").alias("_first"), F.max("_order").alias("_last")).filter("_first < _last")
             .select("_conv", "_again", "_first"))
    met = tagged.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_same") == F.col("_again")), "left")
    # The last character that isn't white space; a text without one is blank.
    last = F.right(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    return met.select("conv_id", "turn", "role", "text", "present",
                      F.when(~F.col("text").rlike(WORD), "blank").when(F.col("_first") < F.col("_order"), "duplicate")
                      .when(~last.isin(".", "!", "?"), "truncated").alias("fault"))


def in_order(faulty: DataFrame) -> DataFrame:
    return faulty.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


# -- the stream -------------------------------------------------------------------------------
class _Conversation:
    """Counts of one conversation, its repair, and the rows whose edits are still open."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.repair, self.sha = conv_id, Repair(), hashlib.sha256()
        self.audit = bytearray()
        self.open: list[tuple[int | None, str, str]] = []
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.low = self.high = self.turn = None
        self.turns = self.illegal = self.rows = self.written = self.place = 0
        self.before: tuple | None = None

    def row(self, turn: int | None, role: str, text: str, fault: str | None) -> list[tuple]:
        if fault != "blank" and self.before == (turn, role, text):
            fault = "duplicate"
        if self.before is not None and self.before[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.turn
            self.high = self.turn = turn
        self.before = (turn, role, text)
        if fault:
            self.counts[fault] += 1
        self.open.append((turn, role, text))
        self.rows += 1
        return self._final(self.repair.row(role[:1], fault in ("blank", "duplicate"), fault == "truncated"))

    def end(self) -> tuple[list[tuple], tuple]:
        cost, edits = self.repair.end()
        out = self._final(edits)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return out, (self.conv_id, gaps, *self.counts.values(), self.illegal, cost, self.audit.decode(),
                     self.sha.hexdigest())

    def _final(self, edits: list[tuple[str, str]]) -> list[tuple]:
        """Rows of final edits: conv_id, place (from 0, none for deleted rows), edit, turn, role, text."""
        out, used = [], 0
        for letter, initial in edits:
            self.audit.append(ord(letter))
            turn, role, text = None, ROLES.get(initial, ""), ""
            if letter != "I":
                turn, own, text = self.open[used]
                used += 1
                role = own if letter in "KD" else role
            if letter == "D":
                out.append((self.conv_id, None, letter, turn, role, text))
                continue
            self.sha.update(("\n" if self.written else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            self.written += 1
            out.append((self.conv_id, self.place, letter, turn, role, text))
            self.place += 1
        del self.open[:used]
        return out


EDITS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()),
                   ("role", pa.string()), ("text", pa.string())])
AUDIT = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
                   ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
                   ("repaired_sha256", pa.string())])


#: Rows of a batch that is handed on.
OUT_ROWS = 2000


def streaming(want_rows: bool):
    """The repair of conversations in order: a row per edit, or one per conversation."""
    schema = EDITS if want_rows else AUDIT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        out: list[tuple] = []

        def finished() -> list[tuple]:
            rows, audit = now.end()
            return rows if want_rows else [audit]

        for b in batches:
            for conv_id, turn, role, text, present, fault in zip(
                    *columns(b, "conv_id", "turn", "role", "text", "present", "fault"), strict=True):
                if now is None or now.conv_id != conv_id:
                    out += finished() if now else []
                    now = _Conversation(conv_id)
                if present:
                    rows = now.row(turn, role, text, fault)
                    out += rows if want_rows else []
                if len(out) >= OUT_ROWS:
                    yield batch(schema, [list(c) for c in zip(*out, strict=True)])
                    out = []
        out += finished() if now else []
        if out:
            yield batch(schema, [list(c) for c in zip(*out, strict=True)])
    return run


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, place, edit (K, R, D, I), turn, role, text: every edit; rows with a place are the repaired conversation."""
    return in_order(with_faults(conversations)).mapInArrow(
        streaming(True), "conv_id bigint, place bigint, edit string, turn bigint, role string, text string")


def audited(conversations: DataFrame) -> DataFrame:
    """One row a conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    return in_order(with_faults(conversations)).mapInArrow(
        streaming(False), "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
                          "cost bigint, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: the rows after a fixed damage by crc32(conv_id:turn) % 20."""
    kind = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"), kind.alias("_kind"))
    text = (F.when(F.col("_kind") <= 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    hurt = rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), (F.col("_kind") != 0).alias("present"), "_kind")
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy")
    return hurt.select("conv_id", "turn", "role", "text", "present", copies).drop("_copy")


# -- SQL twin -------------------------------------------------------------------------------
def _sql() -> str:
    """The contract's rows in DuckDB SQL: one recursive step a row, each state as cost (nine digits) and edits."""
    def then(state: str, cost: str, letter: str) -> str:
        return f"(lpad(CAST(CAST({state}[1:9] AS INTEGER) + {cost} AS VARCHAR), 9, '0') || {state}[10:] || {letter})"

    def turn(state: str, role: str) -> str:
        own = f"initial = '{role}'"
        kept = then(state, f"extra + CASE WHEN {own} THEN {KEEP} ELSE {REROLE} END", f"CASE WHEN {own} THEN 'K' ELSE 'R' END")
        return f"CASE WHEN NOT must_go THEN {kept} END"

    drop = [then(f"c{s}", str(DELETE), "'D'") for s in range(4)]
    ins = [then(f"b{s}", str(INSERT), "'I'") for s in range(4)]
    return rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce("text", ' ') AS t,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hurt AS (SELECT *, xor(list_reduce(list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda acc, x:
         list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), xor(acc, x)), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS kind FROM keyed),
copies AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(t, '.!?', '') ELSE t END AS t,
           unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS n FROM hurt),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, t, n) AS i FROM copies),
f AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS previous,
      CASE WHEN NOT regexp_matches(t, '{WORD}') THEN 'blank'
           WHEN row_number() OVER (PARTITION BY conv_id, role, t ORDER BY i) > 1 THEN 'duplicate'
           WHEN right(rtrim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?')
           THEN 'truncated' END AS fault FROM r),
p AS (SELECT conv_id, i, initial, coalesce(fault IN ('blank', 'duplicate'), false) AS must_go,
             CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS extra FROM f),
w AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS c0, CAST(NULL AS VARCHAR) AS c1, '000000003I' AS c2,
             '000000006II' AS c3 FROM (SELECT DISTINCT conv_id FROM conversations) x
      UNION ALL
      SELECT conv_id, i, b0, b1, d2, least(b3, {then('d2', str(INSERT), "'I'")}) FROM (
        SELECT *, least(b2, {ins[0]}, {ins[1]}, {ins[3]}) AS d2 FROM (
          SELECT p.conv_id, p.i, {drop[0]} AS b0,
                 least({drop[1]}, CASE WHEN NOT must_go AND initial = 's' THEN {then('c0', 'extra', "'K'")} END) AS b1,
                 least({drop[2]}, {turn('c0', 'u')}, {turn('c1', 'u')}, {turn('c3', 'u')}) AS b2,
                 least({drop[3]}, {turn('c2', 'a')}) AS b3
          FROM w JOIN p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.i = w.i + 1) y) z),
e AS (SELECT conv_id, least(c0, c3) AS found FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back FROM w) x
      WHERE back = 1),
s AS (SELECT conv_id, CAST(found[1:9] AS BIGINT) AS cost, found[10:] AS audit FROM e),
letters AS (SELECT conv_id, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS pos FROM s
            WHERE audit <> ''),
placed AS (SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS i,
                  count(*) FILTER (WHERE letter <> 'D') OVER (PARTITION BY conv_id ORDER BY pos) AS place FROM letters),
said AS (SELECT l.conv_id, l.pos, l.letter, l.place, f.role, f.t, f.initial,
                max(CASE WHEN l.letter = 'K' AND l.place = 1 AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS lead
         FROM placed l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i AND l.letter <> 'I'),
texts AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                     || ':' || CASE WHEN letter = 'I' THEN '' ELSE t END, chr(10) ORDER BY pos) AS whole
          FROM said WHERE letter <> 'D' GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                  count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
                  count(*) FILTER (WHERE fault = 'truncated') AS truncated,
                  count(*) FILTER (WHERE previous || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT s.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit,
       sha256(coalesce(whole, '')) AS repaired_sha256
FROM s LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM s.conv_id
LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM s.conv_id"""


SQL = _sql()
