import hashlib
import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lanternflow.functions import content
from lanternflow.sources import digests, files, sinks


def test_entropy_covers_all_bytes_of_a_long_blob(spark):
    blob = bytes(2_500_000) + bytes([255]) * 2_500_000
    df = spark.createDataFrame([(1, blob), (2, b""), (3, None)], "k int, content binary")
    got = {r.k: r.e for r in df.select("k", content.byte_entropy(F.col("content")).alias("e")).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0}
    short = df.filter("k = 1").select(content.byte_entropy(F.col("content"), 1_000).alias("e")).first()
    assert short.e == 0.0


def test_symbol_entropy_of_odd_texts(spark):
    df = spark.createDataFrame([(1, "aab"), (1, "\U0001F600x"), (2, ""), (3, None), (4, "....")], "k int, t string")
    got = sorted((r.k, round(r.entropy, 9)) for r in content.symbol_entropy(df, "k", F.col("t")).collect())
    assert got == [(1, round(math.log2(3) - 2 / 3, 9)), (1, 1.0), (2, 0.0), (3, 0.0), (4, 0.0)]


def test_csv_keeps_quotes_commas_and_backslashes(spark, tmp_path):
    rows = [("1", 'say "hi", twice', "x"), ("2", 'back\\slash "', "y"), ("3", ",,", None), ("4", '"', "z")]
    path = str(tmp_path / "t")
    sinks.write_table(spark.createDataFrame(rows, "id string, text string, label string"), path, "csv")
    assert sorted(tuple(r) for r in files.read_table(spark, path).collect()) == rows


def test_csv_with_line_breaks(spark, tmp_path):
    (tmp_path / "f.csv").write_text('id,text\n1,"a ""q"",\nb"\n2,c\n')
    got = files.read_table(spark, str(tmp_path / "f.csv"), multi_line=True).collect()
    assert [tuple(r) for r in got] == [("1", 'a "q",\nb'), ("2", "c")]


def tree(data, size, fan):
    level = [hashlib.sha256(data[i:i + size]).hexdigest() for i in range(0, max(len(data), 1), size)]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i:i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
    return level[0]


def test_files_of_all_lengths_have_their_tree_digest(spark, tmp_path):
    sizes = [0, 1, 9, 10, 11, 29, 30, 31, 90, 91, 1000, 100_000]
    for n in sizes:
        (tmp_path / f"n {n}%20#é").write_bytes(bytes(i * 7 % 251 for i in range(n)))
    got = {r.length: r.sha256 for r in digests.file_digests(spark, str(tmp_path), 10, 3).collect()}
    filled = sizes[1:]  # empty files aren't listed
    assert got == {n: tree(bytes(i * 7 % 251 for i in range(n)), 10, 3) for n in filled}
    whole = {r.length: r.sha256 for r in digests.file_digests(spark, str(tmp_path)).collect()}
    assert whole == {n: hashlib.sha256(bytes(i * 7 % 251 for i in range(n))).hexdigest() for n in filled}
    with pytest.raises(ValueError):
        digests.file_digests(spark, str(tmp_path), 0)


def test_row_text_is_exact_and_unambiguous(spark):
    xs = [0.0, -0.0, 1.0, -1.0, 0.1, 2.0 ** 1023, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 8.0, 7.999999999999999, 3e-310]
    texts = [r.text for r in digests.row_texts(spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1)).collect()]
    for x, t in zip(xs, texts):
        size, _, body = t.partition(":")
        assert int(size) == len(body)
        whole, _, power = body.partition("p")
        assert (Fraction(int(whole)) * Fraction(2) ** (int(power) - 52) if power else 0) == Fraction(x)
    odd = spark.createDataFrame([("1:a", "b", None), ("1", "a1:b", None), (None, "", float("nan")), ("", None, float("-inf"))], "a string, b string, x float")
    assert sorted(r.text for r in digests.row_texts(odd).collect()) == ["-0:3:nan", "0:-4:-inf", "1:14:a1:b-", "3:1:a1:b-"]
    assert digests.table_digest(odd) != digests.table_digest(odd.filter("false"))
