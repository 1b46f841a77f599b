import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from hayrake.llm import dialogue as dg


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def _faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def _cheapest(rows, faults):
    """All sequences of edits with up to two inserts in each gap."""
    best = None
    choices = []
    for (_, _, role, _), fault in zip(rows, faults, strict=True):
        cut = 3 if fault == "truncated" else 0
        own = [("D", 4, None)]
        if fault not in ("blank", "duplicate"):
            own += [("K", cut, role), ("R", 3 + cut, "user"), ("R", 3 + cut, "assistant")]
        choices.append(own)
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for edits in itertools.product(*choices):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            audit, cost, said = "", 0, []
            for k, gap in enumerate(gaps):
                audit, cost, said = audit + "I" * len(gap), cost + 3 * len(gap), said + [(r, "") for r in gap]
                if k < len(rows):
                    e, c, role = edits[k]
                    audit, cost = audit + e, cost + c
                    said += [(role, rows[k][3])] if e != "D" else []
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in said)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, "\n".join(f"{r}:{t}" for r, t in said)
    return best


def _brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        mine = sorted(_damaged(mine), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults = _faults(mine)
        turns = [t for _, t, _, _ in mine if t is not None]
        initials = [r[2][:1] for r in mine]
        cost, audit, body = _cheapest(mine, faults)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
            cost,
            audit,
            hashlib.sha256(body.encode()).hexdigest(),
        )
    return out


SCHEMA = "conv_id bigint, turn bigint, role string, text string, cost string, fault int"


def _sample():
    rng = random.Random(12)
    roles = ["user", "assistant", "system", "tool", None, "", "unknown"]
    texts = ["Yes.", "No", "", None, "  \n", "So? ", "Ünï 🙂!", "a\nb.", "Yes."]
    rows = [(c, rng.choice([k, k, None]), rng.choice(roles[: 3 if c % 2 else 7]), rng.choice(texts)) for c in range(60) for k in range(rng.randrange(1, 4))]
    rows += [(None, 3, "user", "Hi."), (None, None, "assistant", "Oh")]
    return rows


@pytest.mark.parametrize("block", [1024, 1])
def test_against_all_edits(spark, monkeypatch, block):
    monkeypatch.setattr(dg, "BLOCK", block)
    rows = _sample()
    got = dg.repair_conversations(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == _brute(rows)


def test_sql_says_the_same(spark):
    rows = _sample() + [(100, k, ["user", "assistant"][k % 3 % 2], "A." if k % 7 else "b") for k in range(300)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    conversations = df.toArrow()  # noqa: F841
    want = sorted(duckdb.sql(dg.OP12_SQL).fetchall(), key=str)
    assert sorted(map(tuple, dg.repair_conversations(df).collect()), key=str) == want


def test_blocks_change_nothing(monkeypatch):
    rng = random.Random(5)
    for n in (5, 40, 300):
        # rows that fit nowhere let paths differ from their first edit on
        rows = [(rng.choice("usaax")[:1], rng.choice([0, 0, 0, dg.TRUNCATED, dg.BLANK])) for _ in range(n)]
        if n == 40:
            rows = [("x", 0)] * n
        (cost, audit, _, _), = dg.search(rows, [(0, "", dg.START)], True)
        reader = dg._Reader()
        for size in (1, 3, 64):
            monkeypatch.setattr(dg, "BLOCK", size)
            reader = dg._Reader()
            for k, (initial, fault) in enumerate(rows):
                reader.add(k, initial, f"t{k}", fault)
            out = reader.result()
            assert out[5:7] == (cost, audit)


def test_heuristic_never_falls_by_more_than_an_edge(spark):
    assert dg.CUT <= dg.DELETE
    assert dg.search([], [(0, "", dg.START)], True) == [(0, "", 0, dg.START)]


def test_empty_table_and_long_texts(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert dg.repair_conversations(none).count() == 0
    long = "word " * 400_000
    rows = [(1, 4, "user", long + "."), (1, 5, "assistant", long), (1, 5, "assistant", long)]
    got = dg.repair_conversations(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()
    assert tuple(got[0])[1:] == _brute(rows)[1]


def test_one_exchange(spark):
    plan = dg.op12_dialogue_repair(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
