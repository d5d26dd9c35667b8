"""Repair of conversation structure by A* on the edit lattice.

A node of the lattice is (turns consumed, what may follow); its edges keep a turn, give it another role, delete it or
insert an empty one. The heuristic is admissible and consistent: suffix sums of the deletions that blank and repeated
turns need and of the least that an unfinished turn costs, kept or not. The queue is keyed by cost plus heuristic, then
by the edits' initials, so the first path to reach a node is the cheapest, of equals the ASCII-least.

Turns are streamed in order through the tasks. A long conversation is searched block by block: the best path to each
state at a block's end starts the next block's search, so the search holds one block, however long the conversation
is. That is exact: two cheapest paths to the same node consume the same turns, so neither's edits begin with the other's,
and the lesser one stays the lesser with any continuation.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

DELETE, INSERT, REROLE, UNFINISHED = 2, 5, 1, 5
BLOCK = 512  # turns searched at once
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn. Where a role's initial leads; a path may end in the first or last.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
ROLE = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)


def search(initials: str, faults: list[int], starts: list[tuple[int, str] | None], last: bool) -> dict[int, tuple[int, str, int]]:
    """Best (cost, edits, start) at the end of some turns, by state: of all four, or of the best final one if these are the ``last`` turns.

    ``starts`` has (cost, order key) of the states that the search may begin in; keys of equal length keep their order.
    """
    n = len(initials)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (0 if faults[i] == FINE else min(DELETE, UNFINISHED) if faults[i] == TRUNCATED else DELETE)
    queue: list[tuple[int, str, str, int, int, int, int]] = []
    for q, s in enumerate(starts):
        if s is not None:
            heappush(queue, (s[0] + ahead[0], s[1], "", 0, q, s[0], q))
    done: set[tuple[int, int]] = set()
    out: dict[int, tuple[int, str, int]] = {}
    while queue:
        _, key, edits, i, q, cost, start = heappop(queue)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == n:
            if not last or q in FINAL:
                out[q] = (cost, edits, start)
                if last or len(out) == 4:
                    break
        move = lambda letter, j, to, price, key=key, edits=edits, cost=cost, start=start: heappush(queue, (cost + price + ahead[j], key, edits + letter, j, to, cost + price, start)) if (j, to) not in done else None
        for role in ROLE:
            if role in NEXT[q]:
                move("I", i, NEXT[q][role], INSERT)
        if i < n:
            move("D", i + 1, q, DELETE)
            if faults[i] in (FINE, TRUNCATED):
                charge = UNFINISHED if faults[i] == TRUNCATED else 0
                if initials[i] in NEXT[q]:
                    move("K", i + 1, NEXT[q][initials[i]], charge)
                for role in ROLE:
                    if role in NEXT[q]:
                        move("R", i + 1, NEXT[q][role], REROLE + charge)
    return out


class _Conversation:
    """One conversation as its turns come by."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.turns: list[tuple[str, str]] = []
        self.faults: list[int] = []
        self.starts: list[tuple[int, str] | None] = [(0, "0"), None, None, None]
        self.paths: list[list[str]] = [[], [], [], []]
        self.searched = 0
        self.numbers: tuple[int, int] | None = None
        self.n_numbers = 0
        self.illegal = 0
        self.seen: set[tuple[str, str]] = set()

    def add(self, turn: int | None, role: str, text: str, state: int) -> None:
        if turn is not None:  # in order, so a number's turns are together
            if self.numbers is None or turn != self.numbers[1]:
                self.n_numbers += 1
            self.numbers = (turn if self.numbers is None else self.numbers[0], turn)
        if self.turns and self.turns[-1][0][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        if state != BLANK:
            if (role, text) in self.seen:
                state = DUPLICATE
            self.seen.add((role, text))
        self.turns.append((role, text))
        self.faults.append(state)
        if len(self.turns) - self.searched == BLOCK:
            self._search(last=False)

    def _search(self, last: bool) -> dict[int, tuple[int, str, int]]:
        at = self.searched
        found = search("".join(r[:1] or " " for r, _ in self.turns[at:]), self.faults[at:], self.starts, last)
        self.searched = len(self.turns)
        if not last:
            # the order of the paths so far, as keys of one length: by the start's key, then by the edits since
            order = sorted(found, key=lambda q: (self.starts[found[q][2]][1], found[q][1]))
            self.paths = [[*self.paths[found[q][2]], found[q][1]] if q in found else [] for q in range(4)]
            self.starts = [(found[q][0], str(order.index(q))) if q in found else None for q in range(4)]
        return found

    def result(self) -> dict:
        found = self._search(last=True)
        cost, edits, start = next(iter(found.values()))
        audit = "".join([*self.paths[start], edits])
        repaired: list[dict[str, str]] = []
        rest, state = iter(self.turns), 0
        for letter in audit:
            role, text = next(rest) if letter != "I" else ("", "")
            if letter == "D":
                continue
            if letter != "K":
                role = ROLE["a" if state == 2 else "u"]
            state = NEXT[state][role[:1]]
            repaired.append({"role": role, "text": text})
        gaps = self.numbers[1] - self.numbers[0] + 1 - self.n_numbers if self.numbers else 0
        return {"conv_id": self.conv_id, "gaps": gaps, **{name: self.faults.count(f) for name, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))}, "illegal": self.illegal, "cost": cost, "audit": audit, "repaired": repaired}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[_Conversation]:
    now: _Conversation | None = None
    for batch in batches:
        for conv_id, turn, role, text, state, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    yield now
                now = _Conversation(conv_id)
            if not gone:
                now.add(turn, role, text, state)
    if now is not None:
        yield now


_OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>"


def _state(text: Column) -> Column:
    ends = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return F.when(ends == "", BLANK).when(ends.isin(".", "!", "?"), FINE).otherwise(TRUNCATED)


def repair_conversations(turns: DataFrame, gone_col: str | None = None) -> DataFrame:
    """turns (conv_id, turn, role, text) -> a row for each conv_id, null included: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired.

    ``repaired`` has the conversation's turns after the cheapest edits (``audit``: their initials, Keep, Rerole, Delete,
    Insert) that give role initials ``(s?(ua)+)?``; the counts are of the turns as they came. Turns are taken by turn
    (null first), then role and text. Null roles and texts are one space; a role whose initial isn't s, u or a, or an
    empty one, can't be kept. A row whose ``gone_col`` is true only tells that its conversation exists: one without other
    rows has zeros and no edits. Repeated rows are turns of their own (and then duplicates), other
    columns are ignored, and an empty table gives an empty one. A conversation's turns come out as one row, so they
    must fit into one.
    """
    gone = F.coalesce(F.col(f"`{gone_col}`"), F.lit(False)) if gone_col else F.lit(False)
    filled = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *filled, gone.alias("gone"))
    rows = rows.select("conv_id", "turn", "role", "text", _state(F.col("text")).alias("state"), "gone")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(c, pa.int64()) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
        held: list[dict] = []
        n = 0
        for conversation in _rows(batches):
            held.append(conversation.result())
            n += len(conversation.turns)
            if n > 5000 or len(held) > 1000:
                yield pa.RecordBatch.from_pylist(held, kinds)
                held, n = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, kinds)

    return rows.mapInArrow(run, _OUT)


def damage(turns: DataFrame) -> DataFrame:
    """Conversations with faults made by crc32(conv_id:turn) % 20: 0 drops a turn (``gone``), 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's. Nulls are one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair_conversations(damage(read(spark, sf_dir, "conversations")), "gone")
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines, 256).alias("repaired_sha256"))


_CRC = """list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(8 * length(k)), lambda j: CASE WHEN j % 8 = 0 THEN 256::UBIGINT + ascii(k[j // 8 + 1])::UBIGINT ELSE 0::UBIGINT END)),
  lambda c, x: xor(xor(c, x & 255::UBIGINT) >> 1, CASE WHEN xor(c, x & 255::UBIGINT) & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))"""
#: One step a turn: the best path to each state, then at most two insertions (a third never pays); ties by the edits' initials.
ORACLE_SQL = {
    "op11_conversation_repair": rf"""
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
 kinds AS (SELECT conv_id, turn, role, text, xor({_CRC}, 4294967295::UBIGINT) % 20 AS kind FROM named),
 damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM kinds WHERE kind <> 0),
 placed AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
 seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ends, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM placed),
 rows AS (SELECT conv_id, turn, role, text, i, earlier, CASE WHEN ends = '' THEN 1 WHEN nth > 1 THEN 2 WHEN ends NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM seen),
 figures AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE earlier IS NOT NULL AND left(earlier, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM rows GROUP BY conv_id),
 follows(q, r, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
 names(r, name) AS (VALUES ('u', 'user'), ('a', 'assistant')),
 one AS (SELECT f.q, f.q2, n.name FROM follows f JOIN names n ON f.r = n.r),
 inserts AS (SELECT q, q AS q2, 0 AS c, '' AS e, '' AS t FROM (VALUES (0), (1), (2), (3)) v(q) UNION ALL SELECT q, q2, 5, 'I', chr(10) || name || ':' FROM one UNION ALL SELECT a.q, b.q2, 10, 'II', chr(10) || a.name || ':' || chr(10) || b.name || ':' FROM one a JOIN one b ON a.q2 = b.q),
 paths AS (
  SELECT f.conv_id, 0::BIGINT AS i, s.q2 AS q, s.c::BIGINT AS cost, s.e AS edits, s.t AS out FROM figures f JOIN inserts s ON s.q = 0
  UNION ALL
  SELECT conv_id, i, q, min(cost), arg_min(edits, lpad(cost::VARCHAR, 12, '0') || edits), arg_min(out, lpad(cost::VARCHAR, 12, '0') || edits) FROM (
   SELECT m.conv_id, m.i, s.q2 AS q, m.cost + s.c AS cost, m.edits || s.e AS edits, m.out || s.t AS out FROM (
    SELECT p.conv_id, r.i, x.q2, p.cost + x.c + CASE WHEN r.fault = 3 AND x.e <> 'D' THEN 5 ELSE 0 END AS cost, p.edits || x.e AS edits, p.out || CASE x.e WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || r.role || ':' || r.text ELSE chr(10) || x.name || ':' || r.text END AS out
    FROM paths p JOIN rows r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1
    JOIN (SELECT q, q AS q2, 2 AS c, 'D' AS e, NULL AS r, NULL AS name FROM (VALUES (0), (1), (2), (3)) v(q) UNION ALL SELECT q, q2, 0, 'K', r, NULL FROM follows UNION ALL SELECT q, q2, 1, 'R', NULL, name FROM one) x
     ON x.q = p.q AND (x.e = 'D' OR r.fault IN (0, 3)) AND (x.e <> 'K' OR x.r = left(r.role, 1))
   ) m JOIN inserts s ON s.q = m.q2
  ) GROUP BY conv_id, i, q
 ),
 best AS (SELECT p.conv_id, min(cost) AS cost, arg_min(edits, lpad(cost::VARCHAR, 12, '0') || edits) AS audit, arg_min(out, lpad(cost::VARCHAR, 12, '0') || edits) AS out FROM paths p JOIN figures f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = f.n WHERE p.q IN (0, 3) GROUP BY p.conv_id)
SELECT c.conv_id, coalesce(f.gaps, 0)::BIGINT AS gaps, coalesce(f.blank, 0)::BIGINT AS blank, coalesce(f.duplicate, 0)::BIGINT AS duplicate, coalesce(f.truncated, 0)::BIGINT AS truncated, coalesce(f.illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(b.out[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id"""
}
