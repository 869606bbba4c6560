"""Adapters against plain definitions, on generated flow rows."""

import itertools
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lanternflow.functions import values as V
from lanternflow.operators import adapters

FLOW_FIELDS = ["Stime", "dstip", "srcip", "proto", "dsport", "sbytes", "dbytes", "attack_cat", "label"]


def generated_flows(n, seed):
    """Flows of a small office network; some names carry blanks, some flags are not numbers."""
    rnd = random.Random(seed)
    return [(str(1_611_000_000 + 37 * i), f"printer-{rnd.randrange(5)}", f" desk-{rnd.randrange(9)} ",
             rnd.choice(["TCP", "udp", " sctp "]), str(rnd.choice([22, 631, 1024, 49151, 49152])),
             str(rnd.randrange(4000)), str(rnd.randrange(4000)),
             rnd.choice([None, "", "Worms", " Shellcode", "NORMAL", "Backdoors"]), rnd.choice(["0", "1", "n/a"]))
            for i in range(n)]


def flow_table(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in FLOW_FIELDS))


def plain_label(text, flag, unnamed=False):
    name = (text or "").strip()
    if flag == "0":
        return "BENIGN"
    if unnamed and not name and flag == "1":
        return "ATTACK"
    if name.lower() in ("", "normal"):
        return "BENIGN"
    return {"Backdoors": "Backdoor"}.get(name, name)


@pytest.mark.parametrize("seed, unnamed", [(11, False), (12, True)])
def test_flow_rows_follow_the_definition(spark, seed, unnamed):
    rows = generated_flows(60, seed)
    got = adapters.adapt_unsw(flow_table(spark, rows), unnamed_attack=unnamed).orderBy("timestamp").collect()
    want = [(d, s.strip(), f"{p.strip().lower()}:{q}", float(int(a) + int(b)), plain_label(c, f, unnamed))
            for _, d, s, p, q, a, b, c, f in rows]
    assert [(r.entity_id, r.dst_id, r.event_type, r.bytes, r.label) for r in got] == want
    start = datetime.fromtimestamp(1_611_000_000, timezone.utc).replace(tzinfo=None)
    assert [r.timestamp for r in got] == [start + timedelta(seconds=37 * i) for i in range(60)]


def test_every_required_flow_column_is_asked_for(spark):
    table = flow_table(spark, generated_flows(3, 5))
    for column in adapters.UNSW_REQUIRED:
        with pytest.raises(ValueError, match=column):
            adapters.adapt_unsw(table.drop(column))
    with pytest.raises(ValueError, match="event_types"):
        adapters.adapt_unsw(table, event_types="by moon phase")


def test_rows_without_required_values_go_or_stop_the_run(spark):
    good = generated_flows(8, 21)
    broken = [tuple(None if i == k else v for i, v in enumerate(good[k])) for k in range(7)]
    table = flow_table(spark, [*broken, good[7]])
    assert [r.bytes for r in adapters.adapt_unsw(table).collect()] == [float(int(good[7][5]) + int(good[7][6]))]
    with pytest.raises(adapters.MalformedRows, match="7 rows"):
        adapters.adapt_unsw(table, drop_malformed=False)
    assert adapters.adapt_unsw(flow_table(spark, good[7:]), drop_malformed=False).count() == 1


def test_port_classes_at_their_borders(spark):
    ports = {"1023": "WELL_KNOWN", "1024": "REGISTERED", "49151": "REGISTERED", "49152": "EPHEMERAL",
             "": "REGISTERED", "ftp": "REGISTERED", None: "REGISTERED"}
    cases = [(p, q) for p, q in itertools.product(["tcp", "17", " Udp", "6", "gre"], ports)]
    df = spark.createDataFrame([(i, p, q) for i, (p, q) in enumerate(cases)], "i int, p string, q string")
    got = [r[0] for r in df.orderBy("i").select(V.port_class(F.col("p"), F.col("q"))).collect()]
    base = {"tcp": "TCP", "6": "TCP", "17": "UDP", " Udp": "UDP"}
    assert got == [f"{base[p]}_{ports[q]}" if p in base else "P0_WELL_KNOWN" for p, q in cases]


def test_day_first_clock_over_a_whole_day(spark):
    texts = [f"28/2/2021 {h}:{m:02d}" for h in range(24) for m in (0, 59)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = [r[0].hour for r in df.select(V.parse_day_first(F.col("t"))).collect()]
    assert got == [h + 12 if 1 <= h <= 7 else h for h in range(24) for _ in (0, 59)]
    plain = [r[0].hour for r in df.select(V.parse_day_first(F.col("t"), twelve_hour_clock=False)).collect()]
    assert plain == [h for h in range(24) for _ in (0, 59)]
    odd = spark.createDataFrame([("31/02/2021 9:00",), ("noon",), (None,)], "t string")
    assert [r[0] for r in odd.select(V.parse_day_first(F.col("t"))).collect()] == [None] * 3


def test_either_end_of_a_flow_can_be_profiled(spark):
    names = ["Flow ID", " Timestamp", "Source IP ", " Destination IP", "Destination Port", " Protocol",
             "Subflow Fwd Bytes", " Subflow Bwd Bytes"]
    rows = [(str(i), f"9/11/2020 10:{i:02d}:30", f"in{i % 3}", f"out{i % 2}", str(440 + i), "17", str(i), str(10 * i)) for i in range(12)]
    table = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
    for side, other, k in (("dst", "src", 2), ("src", "dst", 3)):
        got = adapters.adapt(table, entity_side=side).orderBy("timestamp").collect()
        stem = {2: "out", 3: "in"}
        assert [r.entity_id for r in got] == [f"{stem[k]}{i % k}" for i in range(12)]
        assert [r.dst_id for r in got] == [f"{stem[5 - k]}{i % (5 - k)}" for i in range(12)]
        assert [(r.bytes, r.label, r.event_type) for r in got] == [(11.0 * i, "", "UDP_WELL_KNOWN") for i in range(12)]
    with pytest.raises(ValueError, match="entity_side"):
        adapters.adapt(table, entity_side="both")
    assert adapters.detect_format([c.strip() for c in names if "Port" not in c]) == "unknown"


def test_clean_events_get_defaults(spark):
    rows = [("2022-05-01T06:00:00Z", "pump", "open", None, "x12"), ("2022-05-01T06:00:01Z", "pump", "shut", "12.5", None),
            ("yesterday", "pump", "open", "1", "a"), (None, "pump", "open", "1", "a"),
            ("2022-05-01", None, "open", "1", "a"), ("2022-05-01", "pump", None, "1", "a")]
    table = spark.createDataFrame(rows, "timestamp string, entity_id string, event_type string, bytes string, dst_id string")
    got = adapters.adapt(table).orderBy("timestamp").collect()
    assert [(r.event_type, r.bytes, r.dst_id, r.label) for r in got] == [("open", 0.0, "x12", ""), ("shut", 12.5, "", "")]
    bare = adapters.adapt(table.select("timestamp", "entity_id", "event_type")).collect()
    assert [(r.bytes, r.dst_id, r.label) for r in bare] == [(0.0, "", "")] * 2
    with pytest.raises(ValueError):
        adapters.adapt(table.drop("event_type"))


def test_labels_over_all_pairs_of_name_and_flag(spark):
    cases = list(itertools.product([None, "", "  ", "Normal ", "Worms", "Backdoors", " Analysis "], ["0", "1"]))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a string, b string").orderBy("i")
    for unnamed in (False, True):
        got = [r[0] for r in df.select(V.normalize_label(F.col("a"), F.col("b"), unnamed)).collect()]
        assert got == [plain_label(a, b, unnamed) for a, b in cases]


@pytest.mark.parametrize("at_least", [1, 4, 7])
def test_entities_with_enough_events(spark, at_least):
    rows = [(f"host{k}", "BENIGN" if j % 2 else "Worms") for k in range(1, 8) for j in range(k)]
    df = spark.createDataFrame(rows, "entity_id string, label string")
    kept = adapters.keep_entities(df, at_least)
    assert {r.entity_id: r["count"] for r in kept.groupBy("entity_id").count().collect()} == {
        f"host{k}": k for k in range(at_least, 8)}
    assert adapters.keep_label(df, "Worms").count() == sum(label == "Worms" for _, label in rows)
    assert adapters.keep_label(df, None).count() == len(rows)


def test_trend_on_a_grid(spark):
    grid = [(float(c), float(p)) for c in range(4) for p in range(4)]
    df = spark.createDataFrame([(i, c, p) for i, (c, p) in enumerate(grid)], "i int, c double, p double").orderBy("i")
    got = [r[0] for r in df.select(V.percent_trend(F.col("c"), F.col("p"))).collect()]
    assert got == [round((c - p) / p * 100, 1) if p else 100.0 * (c > 0) for c, p in grid]
