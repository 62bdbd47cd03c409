"""Row types shared by sources and operators."""

from pyspark.sql import types as T

STORED_MESSAGE = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("img_path", T.StringType()), T.StructField("box", T.ArrayType(T.IntegerType())),
    T.StructField("time_label", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("screen_idx", T.IntegerType()), T.StructField("speaker", T.StringType()),
    T.StructField("side", T.StringType()), T.StructField("chat_name", T.StringType()),
    T.StructField("fingerprint", T.StringType())])

# ``part`` is ours: a chat too large for one document is stored as several, numbered from 0.
STORED_CHAT = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("captured_at", T.StringType()),
    T.StructField("time_window", T.StringType()), T.StructField("coverage", T.StringType()),
    T.StructField("part", T.LongType()), T.StructField("messages", T.ArrayType(STORED_MESSAGE))])

BLOCK = T.StructType([
    T.StructField("frame_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("box", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("score", T.DoubleType())])

LEDGER = "name string, status string, messages bigint, error string, at timestamp_ntz"
