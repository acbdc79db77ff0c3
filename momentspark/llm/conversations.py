"""Conversation structure repair (dealt operator 12): the cheapest edits that give every conversation a proper order of roles.

Depth-first branch and bound over a conversation's rows: an explicit stack of (row, state, cost, audit), a lower bound of every suffix
and state from a pass over the rows backwards, an incumbent (cost, audit) and, for each row and state, the best (cost, audit) met there, which eliminates
worse prefixes. Rows come sorted by conversation and turn, and are taken in blocks of `BLOCK`: of a longer conversation a block is
solved from each state it can be entered in to each it can be left in, and the best prefix for each state goes on with its
running hash. So a task holds one block of texts, the audits and the digests of texts seen, however long a conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: What the repair costs: the values are part of the operator's contract.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLOCK = 512
#: States: 0 nothing so far, 1 a system turn, 2 after a user turn, 3 after an assistant's. 0 and 3 may end a conversation.
ACCEPT = (0, 3)
ROLE = {2: "user", 3: "assistant"}
FAR = 1 << 60


class Turn(NamedTuple):
    initial: str
    must_go: bool
    truncated: bool
    role: str
    text: str


def _next(state: int) -> int:
    """The state after a user or assistant turn, whichever is due."""
    return 3 if state == 2 else 2


def bounds(turns: list[Turn], goal: int | None) -> list[list[int]]:
    """For each suffix and state: a lower bound of what it costs from there to `goal`, or, if None, to the end of the conversation."""
    out = [[0, 2 * INSERT, INSERT, 0] if goal is None else [0 if s == goal else FAR for s in range(4)]]
    for t in reversed(turns):
        after, fine = out[-1], TRUNCATED if t.truncated else 0
        raw = [DELETE + c for c in after]
        if not t.must_go:
            for s in range(4):
                keep = t.initial == ROLE[_next(s)][0]
                raw[s] = min(raw[s], fine + after[_next(s)] + (0 if keep else REROLE))
            if t.initial == "s":
                raw[0] = min(raw[0], fine + after[1])
        out.append([min(raw[s], INSERT + raw[_next(s)], 2 * INSERT + raw[_next(_next(s))]) for s in range(4)])
    return out[::-1]


def search(turns: list[Turn], start: int, goal: int | None = None) -> tuple[int, int, str] | None:
    """The least (cost, audit) that leads from `start` past all turns to `goal`, as (cost, state, audit), or None if nothing does.

    Without a goal: to a state that may end a conversation, and turns may be inserted at the end as well; otherwise inserted turns
    stand before a row of this block, so that an audit has one place for each of its letters.
    """
    n, least = len(turns), bounds(turns, goal)
    best: tuple[int, str, int] | None = None  # the incumbent
    met: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, start, 0, "")] if least[0][start] < FAR else []
    while stack:
        i, state, cost, audit = stack.pop()
        bound = cost + least[i][state]
        if best is not None and (bound > best[0] or bound == best[0] and audit >= best[1]):
            continue  # what begins with a greater audit ends with one
        if met.get((i, state), (FAR, "")) <= (cost, audit):
            continue
        met[i, state] = cost, audit
        if i == n and (state in ACCEPT if goal is None else state == goal):
            best = min(best or (FAR, "", 0), (cost, audit, state))
            continue
        ways = [(i, _next(state), cost + INSERT, audit + "I")] if i < n or goal is None else []
        if i < n:
            t = turns[i]
            ways.append((i + 1, state, cost + DELETE, audit + "D"))
            if not t.must_go:
                fine, keep = TRUNCATED if t.truncated else 0, t.initial == ROLE[_next(state)][0]
                ways.append((i + 1, _next(state), cost + fine + (0 if keep else REROLE), audit + ("K" if keep else "R")))
                if t.initial == "s" and state == 0:
                    ways.append((i + 1, 1, cost + fine, audit + "K"))
        # the least bound is gone into first, among equal ones the least audit
        stack += sorted((w for w in ways if least[w[0]][w[1]] < FAR), key=lambda w: (w[2] + least[w[0]][w[1]], w[3]), reverse=True)
    return None if best is None else (best[0], best[2], best[1])


def apply(turns: list[Turn], start: int, audit: str) -> Iterator[tuple[str, str]]:
    """The (role, text) turns that an audit leaves."""
    state, rows = start, iter(turns)
    for edit in audit:
        if edit == "I":
            state = _next(state)
            yield ROLE[state], ""
            continue
        t = next(rows)
        if edit == "D":
            continue
        state = 1 if edit == "K" and t.initial == "s" else _next(state)
        yield t.role if edit == "K" else ROLE[state], t.text


class _Way:
    """The best prefix that ends in a state: cost, rank of its audit among the prefixes, its audit in pieces, its hash."""

    def __init__(self, cost: int = 0, rank: int = 0, audit: tuple = (), digest=None, empty: bool = True):
        self.cost, self.rank, self.audit, self.digest, self.empty = cost, rank, audit, digest or hashlib.sha256(), empty


class Repair:
    """One conversation, fed turn by turn."""

    def __init__(self, conv_id):
        self.conv_id, self.block, self.ways = conv_id, [], {0: _Way()}
        self.seen: set[bytes] = set()
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.turns = [None, None, 0]  # least, greatest, how many
        self.before: str | None = None

    def add(self, turn: int | None, role: str, text: str, blank: bool, ends: bool) -> None:
        if len(self.block) == BLOCK:
            self._solve(last=False)
        if turn is not None and turn != self.turns[1]:  # turns come in ascending order
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        fault = "blank" if blank else "duplicate" if digest in self.seen else None if ends else "truncated"
        self.seen.add(digest)
        if fault:
            self.faults[fault] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.faults["illegal"] += 1
        self.before = initial
        self.block.append(Turn(initial, fault in ("blank", "duplicate"), fault == "truncated", role, text))

    def _solve(self, last: bool) -> None:
        best: dict[int, tuple] = {}
        for start, way in self.ways.items():
            for goal in [None] if last else range(4):
                if found := search(self.block, start, goal):
                    cost, state, audit = found
                    best[state] = min(best.get(state, (FAR,)), (way.cost + cost, way.rank, audit, start))
        if last:
            state = min(best, key=lambda s: best[s])
            best = {state: best[state]}
        ranks = {x[1:3]: k for k, x in enumerate(sorted(best.values(), key=lambda x: x[1:3]))}
        ways = {}
        for state, (cost, rank, audit, start) in best.items():
            way = self.ways[start]
            digest, empty = way.digest.copy(), way.empty
            for role, text in apply(self.block, start, audit):
                digest.update(f"{'' if empty else '\n'}{role}:{text}".encode())
                empty = False
            ways[state] = _Way(cost, ranks[rank, audit], (way.audit, audit), digest, empty)
        self.ways, self.block = ways, []

    def row(self) -> dict:
        self._solve(last=True)
        (way,) = self.ways.values()
        pieces, rest = [], way.audit
        while rest:
            rest, piece = rest
            pieces.append(piece)
        low, high, distinct = self.turns
        gaps = 0 if low is None else (high - low + 1 - distinct + 2**63) % 2**64 - 2**63  # as a long
        return {"conv_id": self.conv_id, "gaps": gaps, **self.faults, "cost": way.cost, "audit": "".join(reversed(pieces)), "repaired_sha256": way.digest.hexdigest()}


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, `there`: rows with damage by crc32(`conv_id:turn`) % 20: 0 drops a row (`there` is false), 1 empties its
    text, 2 takes `[.!?]` out of it, 3 repeats it, 4 sets role user. Nulls count as one space (turns stay null)."""
    blank = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    out = rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind != 0).alias("there"), F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("times"),
    )
    return out.withColumn("times", F.explode("times")).drop("times")


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conv_id (null is one as well) of `rows` (conv_id, turn, role, text, `there`: whether the row is, or only names its conversation).

    Rows go by turn (null first), then role and text. Null roles and texts count as one space. `gaps` are turns that are missing between the
    first and the last; a row is at fault by the first that holds: `blank` (no character but white space), `duplicate` (role and text seen
    earlier), `truncated` (the last such character is none of `.!?`); `illegal` counts neighbours whose role initials are not su, ua or au.
    Edits: Keep 0, Rerole (user or assistant) 1, Delete 2 (what is blank or a duplicate must go), Insert an empty turn 5; truncated rows that stay
    add 5. `cost` and `audit` are the cheapest edits' sum and initials that give role initials `(s?(ua)+)?`, ties by the least audit;
    `repaired_sha256` is of the repaired `role:text` lines. Repeated rows are duplicates. An empty table gives an empty one; other columns are ignored.
    A conversation is one task's, as its audit is one string and its hash one sequence; memory grows by its audits and 16 bytes a row.
    """
    conv = dict(rows.dtypes)["conv_id"]
    white = " \t\n\x0b\x0c\r"
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    ends = F.substring(F.rtrim(text, F.lit(white)), -1, 1)
    slim = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), (ends == "").alias("blank"), ends.isin(".", "!", "?").alias("ends"), "there")
    dealt = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = f"conv_id {conv}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, names = None, [], ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        kinds = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in done], type=kinds if n == "conv_id" else pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names], names)

        for batch in slices(batches, "text"):
            kinds = batch.schema.field("conv_id").type
            for c, turn, role, text, blank, ends, there in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "blank", "ends", "there")), strict=True):
                if now is None or now.conv_id != c:
                    if now is not None:
                        done.append(now.row())
                    now = Repair(c)
                if there:
                    now.add(turn, role, text, blank, ends)
            if len(done) >= 1000:
                yield out()
                done = []
        if now is not None:
            done.append(now.row())
            yield out()

    return dealt.mapInArrow(run, schema)


def _oracle_sql() -> str:
    """The damage, the faults and the cheapest edits state by state, as a recursion over rows."""
    table = "list_transform(range(256), lambda i: list_reduce(list_concat([i::BIGINT], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END))"
    crc = "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(crc_table.t[(xor(a, b) & 255) + 1], a >> 8)))"
    white = r"[\x20\x09-\x0D]"

    def way(state: str, cost: str, edit: str, line: str = "", when: str = "true") -> str:
        lines = f"list_append({state}.o, {line})" if line else f"{state}.o"
        return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'o': {lines}}} END"

    def to(state: str, name: str, due: str) -> str:
        """Keeps or reroles the row to `name`."""
        keep = way(state, "fine", "K", "role || ':' || text", f"NOT must_go AND role[1:1] = '{due}'")
        return f"{keep}, {way(state, f'{REROLE} + fine', 'R', f"'{name}:' || text", f"NOT must_go AND role[1:1] <> '{due}'")}"

    kind = "STRUCT(c BIGINT, a VARCHAR, o VARCHAR[])"
    insert = lambda s, name: way(s, str(INSERT), "I", f"'{name}:'")
    return f"""WITH RECURSIVE crc_table AS (SELECT {table} AS t),
    hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations, crc_table),
    rows_after AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM hit, (VALUES (0), (1)) times(n) WHERE kind <> 0 AND (n = 0 OR kind = 3)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM rows_after),
    faulty AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1:1] AS pair, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, regexp_extract(text, '([^\\x20\\x09-\\x0D]){white}*$', 1) NOT IN ('.', '!', '?') AS cut FROM placed),
    turns AS (SELECT *, blank OR again AS must_go, CASE WHEN cut THEN {TRUNCATED} ELSE 0 END AS fine FROM faulty),
    walk AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'o': []}}::{kind} AS s0, NULL::{kind} AS s1, NULL::{kind} AS s2, NULL::{kind} AS s3 FROM conversations
      UNION ALL
      SELECT conv_id, i, {way('s0', str(DELETE), 'D')}::{kind},
        list_min([{way('s1', str(DELETE), 'D')}, {way('s0', 'fine', 'K', "role || ':' || text", "NOT must_go AND role[1:1] = 's'")}])::{kind},
        list_min([{way('s2', str(DELETE), 'D')}, {to('s0', 'user', 'u')}, {to('s1', 'user', 'u')}, {to('s3', 'user', 'u')}])::{kind},
        list_min([{way('s3', str(DELETE), 'D')}, {to('s2', 'assistant', 'a')}])::{kind}
      FROM (SELECT t.*, w.s0, w.s1, list_min([w.s2, {insert('w.s0', 'user')}, {insert('w.s1', 'user')}, {insert('w.s3', 'user')}]) AS s2, list_min([w.s3, {insert('w.s2', 'assistant')}]) AS s3
        FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1)),
    done AS (SELECT conv_id, list_min([s0, s3, {insert('s2', 'assistant')}]) AS b FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
    counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
      count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
    SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
      b.c::BIGINT AS cost, b.a AS audit, sha256(array_to_string(b.o, chr(10))) AS repaired_sha256
    FROM done d LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id"""


ORACLE_SQL = _oracle_sql()
