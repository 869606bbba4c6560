"""Scalar expressions for cleaning raw flow records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "no attack", compared after trim and lower.
BENIGN_LABELS = ["", "0", "benign", "normal", "none", "nan"]
# One family spelled two ways in the UNSW release.
LABEL_SPELLINGS = {"Backdoors": "Backdoor"}
# Protocol spellings, port limits.
TCP_NAMES, UDP_NAMES = ["6", "TCP"], ["17", "UDP"]
LAST_WELL_KNOWN_PORT, LAST_REGISTERED_PORT = 1023, 49151
# Hours that are afternoon on a 12-hour clock without AM/PM.
AFTERNOON_FROM, AFTERNOON_TO = 1, 7
# Day, month and year in front of a time, with slashes or dashes.
_DAY_FIRST = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})(?=[ T])"

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def to_number(c: Column) -> Column:
    """Double from text or number; anything unparsable becomes null."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def log_bytes(c: Column) -> Column:
    """ln(1 + max(bytes, 0)), the scale on which byte counts are binned and averaged."""
    return F.ln(F.lit(1.0) + F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)))


def is_benign(label: Column) -> Column:
    return F.lower(F.trim(F.coalesce(label, F.lit("")))).isin(BENIGN_LABELS)


def normalize_label(text: Column, numeric: Column, unnamed_attack: bool = False) -> Column:
    """BENIGN for a zero flag or a benign word, else the trimmed family name.

    A blank name with a non-zero flag counts as BENIGN unless ``unnamed_attack`` is set.
    """
    flag = to_number(numeric).cast("bigint")
    name = F.trim(F.coalesce(text, F.lit("")))
    out = F.when(flag == 0, "BENIGN")
    if unnamed_attack:
        out = out.when((name == "") & (flag != 0), "ATTACK")
    out = out.when(F.lower(name).isin(BENIGN_LABELS), "BENIGN").otherwise(name)
    for odd, usual in LABEL_SPELLINGS.items():
        out = F.when(out == odd, usual).otherwise(out)
    return out


def port_class(proto: Column, port: Column) -> Column:
    """Protocol plus port class, e.g. ``TCP_WELL_KNOWN``.

    Other protocols share one class. A missing port counts as registered, and so does
    a negative one.
    """
    name = F.upper(F.trim(proto.cast("string")))
    base = F.when(name.isin(TCP_NAMES), "TCP").when(name.isin(UDP_NAMES), "UDP")
    p = to_number(port)
    kind = (F.when(p.isNull(), "REGISTERED")
            .when((p >= 0) & (p <= LAST_WELL_KNOWN_PORT), "WELL_KNOWN")
            .when(p <= LAST_REGISTERED_PORT, "REGISTERED").otherwise("EPHEMERAL"))
    return F.when(base.isNull(), "P0_WELL_KNOWN").otherwise(F.concat_ws("_", base, kind))


def parse_utc(c: Column) -> Column:
    """Timestamp from ISO text or a timestamp column; unparsable values become null."""
    return c.try_cast("timestamp")


def parse_day_first(c: Column, twelve_hour_clock: bool = True) -> Column:
    """Day-first text with or without seconds; hours 1-7 move to the afternoon."""
    # Turned to year-first, both layouts are what a plain cast accepts.
    text = F.regexp_replace(F.trim(c.cast("string")), _DAY_FIRST, "$3-$2-$1")
    ts = F.regexp_replace(text, "^(\\d{4})/(\\d{1,2})/(\\d{1,2})", "$1-$2-$3").try_cast("timestamp")
    if not twelve_hour_clock:
        return ts
    return F.when(F.hour(ts).between(AFTERNOON_FROM, AFTERNOON_TO),
                  ts + F.expr("INTERVAL 12 HOURS")).otherwise(ts)


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def day_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def hash_bucket(digest: Column, buckets: int = 1000) -> Column:
    """Bucket from the first eight hex digits of a sha-256 digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets


def reason_band(z: Column) -> Column:
    return (F.when(z > 6, "extreme deviation for entity").when(z > 4, "unexpected event sequence")
            .when(z > 3, "rare but plausible behavior").otherwise("normal variation"))


def severity_band(z: Column) -> Column:
    return F.when(z > 5, "high").when(z > 3.5, "medium").otherwise("low")


def percent_trend(current: Column, previous: Column) -> Column:
    """Percent change against the previous snapshot; from zero it is 0 or 100."""
    change = F.round((current - previous) / F.nullif(previous, F.lit(0)) * 100, 1)
    return F.when(previous == 0, F.when(current == 0, 0.0).otherwise(100.0)).otherwise(change)
