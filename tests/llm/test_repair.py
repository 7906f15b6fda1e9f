"""Conversation repair against a brute-force version of the contract."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gearsight.llm import queries, repair

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, at int, conv string, edit string"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if x is None else x for x in (role, text))
        what = zlib.crc32(key.encode()) % 20
        if what:
            text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
            out += [(conv, turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    return out


def brute_repair(rows):
    """One conversation's (gaps, blank, duplicate, truncated, illegal, cost, audit, repaired lines)."""
    rows = sorted(((" " if r is None else r, " " if x is None else x, t) for t, r, x in rows),
                  key=lambda m: (m[2] is not None, m[2] or 0, m[0], m[1]))
    turns = [t for _, _, t in rows if t is not None]
    counts, seen, kinds = dict(blank=0, duplicate=0, truncated=0), set(), []
    for role, text, _ in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append(fault)
        if fault:
            counts[fault] += 1
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def better(table, state, entry):
        if state not in table or entry[:2] < table[state][:2]:
            table[state] = entry

    def inserts(table):
        for _ in range(4):
            for state, (cost, audit, lines) in list(table.items()):
                for role in ("user", "assistant"):
                    if (state, role[0]) in step:
                        better(table, step[state, role[0]], (cost + 5, audit + "I", (*lines, f"{role}:")))
        return table

    for (role, text, _), fault in zip(rows, kinds):
        new = {}
        for state, (cost, audit, lines) in inserts(best).items():
            better(new, state, (cost + 2, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                cost += 5 * (fault == "truncated")
                if (state, role[:1]) in step:
                    better(new, step[state, role[:1]], (cost, audit + "K", (*lines, f"{role}:{text}")))
                for given in ("user", "assistant"):
                    if (state, given[0]) in step:
                        better(new, step[state, given[0]], (cost + 1, audit + "R", (*lines, f"{given}:{text}")))
        best = new
    cost, audit, lines = min(entry for state, entry in inserts(best).items() if state in ("", "a"))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)


def by_conversation(rows):
    out = defaultdict(list)
    for conv, *row in rows:
        out[conv].append(tuple(row))
    return out


HARD = [[(0, "system", "Be kind."), (1, "user", "Hello."), (2, "assistant", "Hi!")],
        [(0, "user", "a."), (1, "user", "b."), (2, "user", "c.")], [(5, "assistant", "x"), (2, "tool", "y?"), (9, "system", "z.")],
        [(0, "system", "only.")], [(0, "user", " \t\n"), (1, "assistant", "")], [(None, None, None), (None, "user", "q?"), (1, "user", "q?")],
        [(3, "user", "same."), (3, "user", "same."), (3, "user", "same."), (4, "assistant", "ok.")],
        [(7, "", "no role."), (7, "System", "capital."), (8, "Üser", "é")], [(0, "user", "cut off"), (1, "assistant", "cut too")],
        [(i, ("user", "assistant")[i % 2], f"turn {i}" + "." * (i % 3 > 0)) for i in range(0, 400, 1)],
        [(i, "user", f"again {i % 3}.") for i in range(50)], [(0, "user", "long. " * 50000), (1, "assistant", "fine.")],
        [(2**60, "user", "late."), (-2**60, "assistant", "early.")], [(i, "sua"[i % 3], "one.") for i in range(9)]]


def hard_rows():
    return [(None if i == 3 else i, *row) for i, conv in enumerate(HARD) for row in conv]


@pytest.fixture(scope="module")
def hard(spark, tables):
    return tables(spark, [(*r, 1, "c", "e") for r in hard_rows()], SCHEMA).repartition(4)


def test_report(spark, hard):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # conversations go over many batches
    try:
        got = {r[0]: tuple(r)[1:] for r in repair.repair(hard, "report").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for conv, rows in by_conversation(hard_rows()).items():
        assert got[conv] == brute_repair(rows)[:-1], conv
    assert len(got) == len(HARD)


def test_turns(hard):
    out = repair.repair(hard).collect()
    assert out[0].__fields__ == ["conv_id", "at", "turn", "edit", "role", "text"]
    made = defaultdict(dict)
    for r in out:
        if r.at is not None:
            made[r.conv_id][r.at] = f"{r.role}:{r.text}"
        assert (r.edit == "D") == (r.at is None) and (r.edit != "I" or r.text == "")
    for conv, rows in by_conversation(hard_rows()).items():
        lines = brute_repair(rows)[-1]
        assert [made[conv][i] for i in range(len(made[conv]))] == list(lines)
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    after, every = by_conversation(brute_damage(rows)), {r[0] for r in rows}
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op12_conversation_repair"](spark, SMALL).collect()}
    assert got == {conv: brute_repair(after.get(conv, []))[:-1] for conv in every}
    assert {e for r in got.values() for e in r[6]} >= set("DKR")


def test_damage_of_nulls_and_lost_conversations(spark, tables, tmp_path):
    rows = hard_rows() + [(1000 + i, 0, "user", None) for i in range(60)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()}
    after = by_conversation(brute_damage(rows))
    assert got == {conv: brute_repair(after.get(conv, []))[:-1] for conv in {r[0] for r in rows}}
    assert any(conv not in after for conv in got)


def test_empty(hard):
    assert repair.repair(hard.limit(0)).count() == 0
    assert repair.repair(hard.filter(F.lit(False)), "report").count() == 0
