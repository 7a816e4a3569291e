"""Schemas of the tables the engine reads and writes. Nothing is inferred from data."""
from pyspark.sql import types as T

TURN = T.StructType([T.StructField("speaker", T.StringType()), T.StructField("text", T.StringType())])
SNAPSHOT = T.StructType([
    T.StructField("agent_speaking", T.BooleanType()), T.StructField("user_partial", T.StringType()),
    T.StructField("agent_last_utterance", T.StringType()),
    T.StructField("recent_turns", T.ArrayType(TURN))])
EXAMPLE = T.StructType([
    *[T.StructField(n, T.StringType()) for n in (
        "id", "decision", "event", "source", "group", "split", "label", "kind")],
    T.StructField("hard", T.BooleanType()), T.StructField("company", T.StringType()),
    T.StructField("labeller", T.StringType()), T.StructField("guidelines", T.StringType()),
    T.StructField("prompt", T.StringType()), T.StructField("snapshot", SNAPSHOT)])
TRANSCRIPT_CSV = T.StructType([
    T.StructField("swda_filename", T.StringType()), T.StructField("ptb_basename", T.StringType()),
    T.StructField("conversation_no", T.IntegerType()), T.StructField("transcript_index", T.IntegerType()),
    T.StructField("act_tag", T.StringType()), T.StructField("caller", T.StringType()),
    T.StructField("utterance_index", T.IntegerType()), T.StructField("subutterance_index", T.IntegerType()),
    *[T.StructField(n, T.StringType()) for n in ("text", "pos", "trees", "ptb_treenumbers")]])
MESSAGE_CSV = T.StructType([
    T.StructField("tweet_id", T.LongType()), T.StructField("author_id", T.StringType()),
    T.StructField("inbound", T.BooleanType()), T.StructField("created_at", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("response_tweet_id", T.StringType()),
    T.StructField("in_response_to_tweet_id", T.DoubleType())])
PAIRS = T.ArrayType(T.ArrayType(T.StringType()))
INTENT_JSON = T.StructType([T.StructField(n, PAIRS) for n in (
    "train", "val", "test", "oos_train", "oos_val", "oos_test")])
LABEL = T.StructType([T.StructField(n, T.StringType()) for n in (
    "id", "split", "label", "guidelines", "labeller", "model", "prompt", "provider", "at")])
SEGMENT = T.StructType([
    T.StructField("who", T.StringType()), T.StructField("at_ms", T.LongType()),
    T.StructField("dur_ms", T.LongType()), T.StructField("text", T.StringType())])
EXPECT = T.StructType([
    T.StructField("seg", T.IntegerType()), T.StructField("want", T.StringType()),
    T.StructField("route", T.StringType()), T.StructField("escalate", T.BooleanType()),
    T.StructField("why", T.StringType())])
SCRIPT = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("covers", T.ArrayType(T.StringType())), T.StructField("history", T.ArrayType(TURN)),
    T.StructField("timeline", T.ArrayType(SEGMENT)), T.StructField("expect", T.ArrayType(EXPECT))])
CALL = T.StructType([
    T.StructField("at", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("provider", T.StringType()), T.StructField("purpose", T.StringType()),
    T.StructField("prompt_tokens", T.LongType()), T.StructField("completion_tokens", T.LongType()),
    T.StructField("cost_usd", T.DoubleType()), T.StructField("latency_ms", T.DoubleType())])
