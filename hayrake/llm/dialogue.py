"""Conversation structure repair: A* on the edit lattice of a conversation's rows.

A state is (rows read, role that stands last); edits lead from state to state: keep, rerole, delete, insert.  The heuristic is the
suffix sum of what no path avoids: 4 for each row that has to be deleted, 3 for each truncated one (deleting it costs more).  It
never falls by more than an edge costs, so the first time a state leaves the queue, ordered by (cost plus heuristic, audit), its
path is the cheapest and, of those, the ASCII-least.

Rows reach a task sorted by conversation, and are read in blocks of BLOCK rows: at a block's end the best path to each of the four
roles is settled and carried on, as cost, audit and SHA-256 state.  So of a conversation of any length a task holds one block of
texts; faults are found before by window functions, which spill.  A conversation's audit is one cell and its hash runs over its
rows in order, so one conversation is read by one task, streaming.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import claim, prepare, table

DELETE, RECAST, INSERT, CUT = 4, 3, 3, 3
#: Rows that are searched at once.
BLOCK = 1024
#: Roles that stand last: none, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Role initial -> states in which it may follow.
_MAY = {"s": (START,), "u": (START, SYSTEM, ASSISTANT), "a": (USER,)}
_STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_NAME = {USER: "user", ASSISTANT: "assistant"}
NONE, BLANK, DUPLICATE, TRUNCATED, DROPPED = range(5)
_SPACES = r"[\x20\x09-\x0D]"


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, dropped): rows after the seeded damage; dropped ones stay, marked, without role and text.

    Null roles and texts are one space; in the key of the draw a null conv_id or turn is one space too.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(draw == 4, "user").otherwise(space("role")).alias("role"),
        text.alias("text"),
        F.explode(F.when(draw == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        (draw == 0).alias("dropped"),
    )


def faults(rows: DataFrame) -> DataFrame:
    """Add ``fault``, of each row the first of blank, duplicate and truncated; rows in order of (turn, role, text) within a conversation.

    One exchange by conversation serves the window of repeats and the order of reading.
    """
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(rf"[.!?]{_SPACES}*\z")
    same = Window.partitionBy("conv_id", "dropped", "role", "digest").orderBy(F.asc_nulls_first("turn"), "copy")
    seen = F.row_number().over(same) > 1
    fault = F.when(F.col("dropped"), DROPPED).when(blank, BLANK).when(F.col("seen"), DUPLICATE).when(cut, TRUNCATED).otherwise(NONE)
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    return rows.withColumn("digest", digest).repartition("conv_id").withColumn("seen", seen).withColumn("fault", fault).drop("digest", "seen")


def search(rows: list[tuple[str, int]], entries: list[tuple[int, str, int]], last: bool) -> list[tuple[int, str, int, int]]:
    """Cheapest paths over a block: (cost, audit, entry, state) of each state at its end, or of the first final one where ``last``.

    ``rows`` are (role initial, fault); ``entries`` (cost, audit, state).  Audits are whole, so that ties of paths from different
    entries fall to the ASCII-least.
    """
    n = len(rows)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if rows[i][1] in (BLANK, DUPLICATE) else CUT if rows[i][1] == TRUNCATED else 0)
    queue = [(g + rest[0], audit, 0, q, e) for e, (g, audit, q) in enumerate(entries)]
    heapq.heapify(queue)
    closed: set[tuple[int, int]] = set()
    found = []
    while queue:
        f, audit, i, q, e = heapq.heappop(queue)
        if (i, q) in closed:
            continue
        closed.add((i, q))
        g = f - rest[i]
        if i == n:
            if not last or q in (START, ASSISTANT):
                found.append((g, audit, e, q))
                if last or len(found) == 4:
                    break
        put = ASSISTANT if q == USER else USER
        if (i, put) not in closed:
            heapq.heappush(queue, (f + INSERT, audit + "I", i, put, e))
        if i < n:
            initial, fault = rows[i]
            nxt = rest[i + 1]
            heapq.heappush(queue, (g + DELETE + nxt, audit + "D", i + 1, q, e))
            if fault not in (BLANK, DUPLICATE):
                g += CUT if fault == TRUNCATED else 0
                if q in _MAY.get(initial, ()):
                    heapq.heappush(queue, (g + nxt, audit + "K", i + 1, _STATE[initial], e))
                heapq.heappush(queue, (g + RECAST + nxt, audit + "R", i + 1, put, e))
    return found


class _Reader:
    """One conversation, read row by row."""

    def __init__(self):
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.before = None
        self.settled: list[str] = []
        self.paths = [(0, "", START, hashlib.sha256())]
        self.block: list[tuple[str, str, str, int]] = []

    def add(self, turn, role: str, text: str, fault: int) -> None:
        if fault == DROPPED:
            return
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == TRUNCATED
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        if len(self.block) == BLOCK:
            self.settle(False)
        self.block.append((initial, role, text, fault))

    def settle(self, last: bool) -> None:
        rows = [(b[0], b[3]) for b in self.block]
        found = search(rows, [p[:3] for p in self.paths], last)
        done = []
        for cost, audit, e, q in found:
            _, known, state, sha = self.paths[e]
            done.append((cost, audit, q, self.hashed(audit[len(known) :], state, sha.copy())))
        # what all live audits have in common at their start is decided
        audits = [p[1] for p in done]
        low, high = min(audits), max(audits)
        same = next((k for k in range(len(low)) if low[k] != high[k]), len(low))
        self.settled.append(low[:same])
        self.paths = [(c, a[same:], q, s) for c, a, q, s in done]
        self.block = []

    def hashed(self, edits: str, state: int, sha):
        at = 0
        for edit in edits:
            if edit == "D":
                at += 1
                continue
            put = ASSISTANT if state == USER else USER
            role, text = _NAME[put], ""
            if edit != "I":
                initial, own, text, _ = self.block[at]
                at += 1
                if edit == "K":
                    role, put = own, _STATE[initial]
            sha.update(f"{chr(10) if state else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            state = put
        return sha

    def result(self) -> tuple:
        self.settle(True)
        ((cost, audit, _, sha),) = self.paths
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.settled) + audit, sha.hexdigest()


_FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, dropped, fault): counts, cost, audit and digest of the repair."""
    prepare(rows.sparkSession)
    kept = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", "fault")
    ordered = kept.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    head = kept.schema["conv_id"]
    kinds = {"conv_id": head.dataType.simpleString()} | dict.fromkeys(_FIELDS, "bigint") | {"audit": "string", "repaired_sha256": "string"}

    def run(batches):
        claim("dialogue")
        reader, of, names = None, None, list(kinds)
        for b in batches:
            ids = b.column(0)
            out_ids, out = [], []
            for conv, *row in zip(ids.to_pylist(), *(b.column(k).to_pylist() for k in range(1, 5)), strict=True):
                if reader is None or conv != of:
                    if reader is not None:
                        out_ids.append(of)
                        out.append(reader.result())
                    reader, of = _Reader(), conv
                reader.add(*row)
            if out:
                yield _batch(out_ids, out, ids.type, names)
        if reader is not None:
            yield _batch([of], [reader.result()], ids.type, names)

    return ordered.mapInArrow(run, ", ".join(f"{k} {t}" for k, t in kinds.items()))


def _batch(ids: list, rows: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    types = [pa.int64()] * len(_FIELDS) + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=names)


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """Damage, faults and repair of whole conversations; see ``op12_dialogue_repair``."""
    return repair(faults(damage(conversations.select("conv_id", "turn", "role", "text"))))


def op12_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every conversation after seeded damage, and its cheapest repair.

    Null roles and texts are one space (so the text is blank, the role has to be recast); null turns come first and open no gap;
    rows without conv_id are one conversation.  Rows of one turn are taken by role, then text; a repeated row is a duplicate.
    Empty and very long texts count whole.  Equal costs fall to the ASCII-least audit.  A conversation that lost all rows has zeros,
    an empty audit and the digest of nothing; an empty table gives an empty result.
    """
    return repair_conversations(table(spark, sf_dir, "conversations"))


def _crc_sql(text: str) -> str:
    """zlib's crc32 of an ASCII text, byte by byte."""
    step = "xor(crc_table[(xor(c, b) & 255) + 1], c >> 8)"
    return f"xor(list_reduce(list_transform(range(1, length({text}) + 1), lambda k: ascii(substr({text}, k, 1))::BIGINT), lambda c, b: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


def _moves_sql() -> str:
    """All (state, inserts, edit, needed initial, state after): up to two inserts, then an edit of the row or the end."""
    put = lambda q: ASSISTANT if q == USER else USER
    out = []
    for q in range(4):
        at = q
        for k in range(3):
            out += [(q, k, "D", "", at), (q, k, "R", "", put(at)), (q, k, "E", "", at)]
            out += [(q, k, "K", c, _STATE[c]) for c, may in _MAY.items() if at in may]
            at = put(at)
    return ", ".join(f"({q}, {k}, '{e}', '{c}', {t})" for q, k, e, c, t in out)


OP12_SQL = rf"""
WITH RECURSIVE bits(n, v, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY n) AS crc_table FROM bits WHERE k = 8),
moves(q, k, edit, needs, nq) AS (VALUES {_moves_sql()}),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
drawn AS (SELECT keyed.*, {_crc_sql("key")} % 20 AS d FROM keyed, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM drawn, range(2) AS c(copy) WHERE d <> 0 AND (copy = 0 OR d = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    left(role, 1) AS initial FROM hurt),
judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before, count(*) OVER (PARTITION BY conv_id) AS n FROM placed),
paths(conv_id, i, q, cost, audit) AS (
  SELECT DISTINCT conv_id, 1::BIGINT, 0, 0, '' FROM judged
  UNION ALL
  SELECT conv_id, i, q, cost, audit FROM (
    SELECT p.conv_id, p.i + 1 AS i, m.nq AS q, p.audit || repeat('I', m.k) || m.edit AS audit,
      p.cost + {INSERT} * m.k + CASE m.edit WHEN 'D' THEN {DELETE} WHEN 'R' THEN {RECAST} ELSE 0 END
        + CASE WHEN r.fault = 'truncated' AND m.edit <> 'D' THEN {CUT} ELSE 0 END AS cost
    FROM paths p JOIN judged r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i
    JOIN moves m ON m.q = p.q AND m.edit <> 'E' AND (m.edit <> 'K' OR m.needs = r.initial)
      AND (m.edit = 'D' OR r.fault NOT IN ('blank', 'duplicate')))
  QUALIFY row_number() OVER (PARTITION BY conv_id, i, q ORDER BY cost, audit) = 1),
ends AS (SELECT p.conv_id, p.cost + {INSERT} * m.k AS cost, p.audit || repeat('I', m.k) AS audit
  FROM paths p JOIN (SELECT DISTINCT conv_id, n FROM judged) c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = c.n + 1
  JOIN moves m ON m.q = p.q AND m.edit = 'E' AND m.nq IN ({START}, {ASSISTANT})
  QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + {INSERT} * m.k, p.audit || repeat('I', m.k)) = 1),
steps AS (SELECT conv_id, s, substr(audit, s, 1) AS edit, length(replace(substr(audit, 1, s), 'I', '')) AS i
  FROM ends, unnest(range(1, length(audit) + 1)) AS t(s)),
rolled AS (SELECT s.conv_id, s.s, s.edit, CASE WHEN s.edit = 'K' THEN r.role END AS own, CASE WHEN s.edit = 'I' THEN '' ELSE r.text END AS text,
    row_number() OVER (PARTITION BY s.conv_id ORDER BY s.s) AS pos,
    max(CASE WHEN s.edit = 'K' AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv_id) AS has_system
  FROM steps s LEFT JOIN judged r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i AND s.edit <> 'I' WHERE s.edit <> 'D'),
mended AS (SELECT conv_id, string_agg(coalesce(own, CASE WHEN (pos - has_system) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY s) AS body
  FROM rolled GROUP BY conv_id),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN mended m ON m.conv_id IS NOT DISTINCT FROM a.conv_id
"""
