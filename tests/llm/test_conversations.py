"""Conversation repair against trying all edits."""

import random

import brute_new as brute
import pytest
from lanternflow.llm import conversations as C
from pyspark.sql import functions as F

SHAPE = "conv_id long, turn long, role string, text string"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def found(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows}


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([t, t, t, t + 2, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]),
                         rng.choice(["yes.", "no", "well? ", "", " \n", None, "dot. tail", f"own {t}!"])))
    return rows


def test_damage_and_repair_equal_all_edits(spark):
    rows = random_rows(3, 150, 9)
    df = spark.createDataFrame(rows, SHAPE).withColumn("fault", F.lit("x")).withColumn("kind", F.lit("x"))
    assert found(C.audit_conversations(C.damaged(df))) == {c: brute.audited(t) for c, t in brute.damaged_rows(rows).items()}


def test_given_table_equals_all_edits(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert found(C.audit_conversations(C.damaged(df))) == {c: brute.audited(t) for c, t in brute.damaged_rows(rows).items()}


def test_nulls_empty_table_and_repeated_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (5, None, "user", "Hi."), (5, None, "user", "Hi."), (6, 1, "", "x")]
    plain = {None: brute.audited([(None, " ", " "), (1, "user", "Hi.")]), 5: brute.audited([(None, "user", "Hi.")] * 2),
             6: brute.audited([(1, " ", "x")])}
    assert found(C.audit_conversations(spark.createDataFrame(rows, SHAPE))) == plain
    assert found(C.audit_conversations(C.damaged(spark.createDataFrame([], SHAPE)))) == {}
    gone = spark.createDataFrame([(9, 1, "user", "Hi.")], SHAPE).withColumn("gone", F.lit(True))
    assert found(C.audit_conversations(gone)) == {9: brute.audited([])}


@pytest.mark.parametrize("n", [0, 1, 2, 7, 64, 65, 1000])
def test_checkpoints_give_the_edits_of_the_whole_table(n):
    rng = random.Random(n)
    turns = [(rng.choice(["user", "assistant", "system", "tool"]), str(i), rng.choice([0, 0, 1, 2, 3])) for i in range(n)]
    vectors = [C.END]
    for role, _, fault in reversed(turns):
        vectors.append(C.before(vectors[-1], fault, role[:1]))
    repair = C.Repair()
    for role, _, fault in reversed(turns):
        repair.back(fault, role[:1])
    assert len(repair.plan.marks) <= 2 * repair.plan.every and repair.plan.every <= max(4, 2 * n ** 0.5)
    whole, got = C.Repair(), []
    whole.state = 0
    for i, turn in enumerate(turns):
        got += list(whole._settle(turn, vectors[n - i], vectors[n - i - 1]))
    got += list(whole.end())
    mine = [e for t in turns for e in repair.forward(*t)] + list(repair.end())
    assert mine == got and repair.cost == vectors[-1][0]
    assert sum({"D": 3, "I": 2, "R": 2, "K": 0}[e] for e, _, _ in mine) <= repair.cost


def test_long_conversation_and_long_text(spark):
    n = 60_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                 F.concat(F.lit("t"), F.col("id").cast("string"), F.lit(".")).alias("text"))
    long = spark.createDataFrame([(2, 0, "user", "ab " * 700_000 + ".")], SHAPE)
    out = found(C.audit_conversations(rows.unionByName(long)))
    assert out[1][:7] == (0, 0, 0, 0, 0, 0, "K" * n)
    assert out[2] == brute.audited([(0, "user", "ab " * 700_000 + ".")])


def test_edits_give_the_repaired_text(spark):
    rows = random_rows(4, 30, 7)
    df = C.damaged(spark.createDataFrame(rows, SHAPE))
    audits = found(C.audit_conversations(df))
    steps = {}
    for r in C.repair_conversations(df).collect():
        steps.setdefault(r["conv_id"], []).append((r["step"], r["edit"], r["role"], r["text"]))
    for conv, want in audits.items():
        mine = sorted(steps.get(conv, []))
        assert "".join(s[1] for s in mine) == want[6]
        assert brute.sha256("\n".join(f"{s[2]}:{s[3]}" for s in mine if s[1] != "D").encode()).hexdigest() == want[7]
