"""URL filter rules by a sort-merge range join on reversed-host keys.

A rule (host, path) fits its host and all subdomains if the path of the url starts with
the rule's. With the host's labels reversed, ``host)path`` becomes one binary key, and the
urls under a rule are the keys between the rule's key and that key followed by a byte that
UTF-8 never uses. A url gives one key for each trailing part of its host that some rule
names. Rules and keys are sorted together; a sweep keeps the rules that are open, and
because intervals nest or are disjoint they form a stack whose top is the longest path.
Of the host parts of a url, the one with most labels that has an open rule decides.

Only DataFrame operations are used. The key space is cut into ranges that Spark samples
from the keys themselves; a rule is copied to every range that it overlaps, so no range
depends on another, and repeated urls are folded before the sweep. Only the borders of the
ranges, one key a partition, come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternflow.llm.common import boxed, durable, range_bucket

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _key(host: Column, path: Column) -> Column:
    # A host can hold neither '/' nor control characters that matter: the path begins at the
    # first byte 0, so a longer host never falls under the interval of a shorter one.
    return F.encode(F.concat(reversed_host(host), F.lit("\x00"), path), "UTF-8")


def judge_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """Add ``host, path, rule, verdict`` to ``urls``.

    ``rules`` has ``host, path, verdict``. Among the rules that fit, the one with the longest
    host wins, then the one with the longest path; of two rules with the same host and path
    the ``block`` wins. Without a fitting rule ``rule`` is null and ``verdict`` is ``default``.
    A null url, or one without ``://``, has an empty host and path. Rows are kept as they are,
    repeated ones too; columns of these names in ``urls`` are replaced.
    """
    spark = urls.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    address = F.col(f"_row.`{url}`")
    parsed = boxed(urls, "host", "path", "rule", "verdict").withColumn("host", host_of(address)).withColumn("path", path_of(address))
    known = durable(rules.filter("host IS NOT NULL AND path IS NOT NULL")
                    .groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path")
                    .agg(F.max("verdict").alias("verdict")))

    # One key for each trailing part of a distinct host that is the host of a rule.
    places = durable(parsed.groupBy("host", "path").agg(F.lit(1).alias("_one")).drop("_one"))
    labels = F.split("host", r"\.")
    parts = (places.groupBy("host").agg(F.lit(1).alias("_one")).select("host", labels.alias("_l"))
             .select("host", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("_l")), lambda n: F.array_join(
                 F.slice("_l", F.size("_l") - n + 1, n), "."))).alias("_n", "part")))
    named = known.select(F.col("host").alias("part")).distinct()
    levels = parts.join(named, "part", "left_semi").groupBy("host").agg(F.collect_list(F.struct("_n", "part")).alias("_parts"))
    points = (places.join(levels, "host").select("host", "path", F.explode("_parts").alias("_p"))
              .select("host", "path", F.col("_p._n").alias("_n"), _key(F.col("_p.part"), F.col("path")).alias("_k")))

    # Ranges of the key space, by Spark's own sample of the keys: one border a range.
    in_ranges = durable(points.repartitionByRange(ranges, "_k").withColumn("_c", F.spark_partition_id()))
    lows = [bytes(r[0]) for r in in_ranges.groupBy("_c").agg(F.min("_k").alias("_lo")).sort("_lo").select("_lo").collect()]
    range_of = lambda k: range_bucket(k, lows[1:])
    in_ranges = in_ranges.withColumn("_c", range_of(F.col("_k")))
    spans = known.select(_key(F.col("host"), F.col("path")).alias("_s"),
                         F.struct("host", "path", "verdict").alias("_rule"))
    spans = spans.withColumn("_e", F.concat("_s", F.unhex(F.lit("FF"))))
    opened = spans.withColumn("_c", F.explode(F.sequence(range_of(F.col("_s")), range_of(F.col("_e")))))
    none = F.lit(None)
    events = (opened.select("_c", F.col("_s").alias("_k"), F.lit(1).alias("_kind"), "_rule", none.cast("string").alias("host"),
                            none.cast("string").alias("path"), none.cast("int").alias("_n"))
              .unionByName(opened.select("_c", F.col("_e").alias("_k"), F.lit(0).alias("_kind"), none.cast(
                  spans.schema["_rule"].dataType).alias("_rule"), none.cast("string").alias("host"),
                  none.cast("string").alias("path"), none.cast("int").alias("_n")))
              .unionByName(in_ranges.select("_c", "_k", F.lit(2).alias("_kind"), none.cast(
                  spans.schema["_rule"].dataType).alias("_rule"), "host", "path", "_n")))
    # The depth of the stack, then its top: the last rule opened at this depth.
    running = Window.partitionBy("_c").orderBy("_k", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("_kind") == 1, 1).when(F.col("_kind") == 0, -1).otherwise(0)
    at_depth = Window.partitionBy("_c", "_depth").orderBy("_k", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = (events.withColumn("_depth", F.sum(step).over(running))
             .withColumn("_top", F.when(F.col("_depth") > 0, F.last("_rule", ignorenulls=True).over(at_depth))))
    best = (swept.filter("_kind = 2 AND _top IS NOT NULL").groupBy("host", "path")
            .agg(F.max(F.struct("_n", "_top")).alias("_best")).select("host", "path", "_best._top"))
    found = parsed.join(best, ["host", "path"], "left")
    return found.select("_row.*", "host", "path",
                        F.concat(F.col("_top.host"), F.col("_top.path")).alias("rule"),
                        F.coalesce("_top.verdict", F.lit(default)).alias("verdict"))
