"""The event schema every source is adapted to, and shared column names."""

from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("entity_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("dst_id", T.StringType()),
    T.StructField("bytes", T.DoubleType()),
    T.StructField("label", T.StringType()),
])
EVENT_COLUMNS = EVENT_SCHEMA.fieldNames()

# Total order inside an entity. Ties on the timestamp are settled by the row id.
TIME_ORDER = ["timestamp", "event_row_id"]

# The columns of one scored window, in the order that settles ties
# between equally strong features.
WINDOW_FEATURES = ["tok_uniq", "tok_top_share", "dst_uniq", "dst_top_share",
                   "bytes_mean", "bytes_std", "repeat_last"]
SCORE_FEATURES = WINDOW_FEATURES + ["nll"]

# Reserved token ids.
PAD_ID, UNK_ID, FIRST_KNOWN_ID = 0, 1, 2
