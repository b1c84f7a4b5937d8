"""Usage-event queries over ``events`` and job queries over ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import elapsed_ms
from ..operators import collections as ops
from ..operators import records, usage
from ..operators import textures as tx
from ..sources.shared import new_folder

# Event types as kinds of maps, for the pick queries.
PRIORITY = ("purchase", "signup", "error")


def _events(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _shaped(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).select(
        "event_id", "ts", "user_id", F.col("event_type").alias("tool_name"), F.col("value").alias("duration_ms"),
        F.concat(F.lit("prompt "), F.col("event_id").cast("string")).alias("prompt_text"), F.col("props").alias("metadata"),
        F.when(F.col("event_type") == "error", F.repeat("props", 30)).otherwise("").alias("error_message"),
        _session().alias("session_id"),
    )


def _session():
    """A session's id, which the event carries; sessions are told apart by it, not by gaps."""
    return F.md5(F.concat_ws("/", "user_id", (F.get_json_object("props", "$.k").cast("int") % 8).cast("string")).cast("binary"))


def dict_last_wins(spark, sf_dir):
    return ops.last_wins(_events(spark, sf_dir), "event_type", "value", "event_id")


def priority_pick(spark, sf_dir):
    return ops.priority_pick(_events(spark, sf_dir), "user_id", "event_type", "value", "event_id", PRIORITY)


def arm_fallback(spark, sf_dir):
    """Users as materials; their event types play the parts of map types."""
    kinds = F.when(F.col("event_type") == "click", "arm").when(F.col("event_type") == "view", "roughness").when(F.col("event_type") == "signup", "metallic").when(F.col("event_type") == "error", "diffuse").otherwise("ao")
    return tx.packed_fallback(_events(spark, sf_dir).select("user_id", kinds.alias("kind")), "user_id", "kind")


def first_match_else_first(spark, sf_dir):
    return ops.first_match_else_first(_events(spark, sf_dir), "user_id", "value", "event_id", F.col("value").between(400, 800))


def last_match(spark, sf_dir):
    return ops.last_match(_events(spark, sf_dir), "user_id", "value", "event_id", F.col("event_type") == "view")


def consent_mask(spark, sf_dir):
    return usage.mask(_shaped(spark, sf_dir), F.col("user_id") % 2 == 0).select("event_id", "prompt_text", "metadata", "error_message")


def telemetry_row(spark, sf_dir):
    """Whole rows as they are sent, masked by consent."""
    shaped = _shaped(spark, sf_dir)
    rows = shaped.withColumns({
        "customer_uuid": F.col("user_id").cast("string"), "event_type": F.when(F.col("tool_name") == "signup", "startup").otherwise("tool_execution"),
        "success": F.col("tool_name") != "error", "version": F.lit("1.0"), "platform": F.when(F.col("user_id") % 3 == 0, "linux").otherwise("darwin"),
        "app_version": F.lit(None).cast("string"), "metadata": F.when(F.col("event_id") % 4 != 0, F.col("metadata")),
    })
    return usage.wire_row(rows, F.col("user_id") % 2 == 0).withColumn("k", F.get_json_object("metadata", "$.k").cast("int"))


def enabled_events(spark, sf_dir):
    """Events of those who record at all: configured so, and none of three settings says no."""
    words = [F.lit(x) for x in ("", "TRUE", "no", "1", "0", " yes", "On")]
    env = [F.get(F.array(*words), F.pmod(F.col("user_id") * k, F.lit(7)).cast("int")) for k in (1, 3, 0)]
    return _events(spark, sf_dir).where(usage.enabled(F.col("user_id") % 10 != 0, *env)).select("event_id", "user_id")


def bounded_queue(spark, sf_dir):
    """What a queue of 20 places takes of each day's burst; the newest are dropped."""
    days = _events(spark, sf_dir).select("event_id", F.col("ts").cast("date").alias("day"))
    return ops.bounded_burst(days, "day", "event_id", 20).groupBy("day").agg(F.count_if("taken").alias("taken"), F.count_if(~F.col("taken")).alias("dropped"), F.max(F.when(F.col("taken"), F.col("event_id"))).alias("last_taken"))


def call_time(spark, sf_dir):
    """Milliseconds between a user's first and last event."""
    seconds = usage.epoch_seconds(F.col("ts"))
    spans = _events(spark, sf_dir).groupBy("user_id").agg(F.min(seconds).alias("a"), F.max(seconds).alias("b"))
    return spans.select("user_id", elapsed_ms(F.col("a"), F.col("b")).alias("ms"))


def json_kinds(spark, sf_dir):
    """What JSON texts hold, by their type; some are malformed."""
    texts = [F.col("props"), F.lit("[1, 2]"), F.lit('"text"'), F.lit("true"), F.col("event_id").cast("string"), F.concat(F.col("event_id").cast("string"), F.lit(".25")), F.lit("null"), F.lit("{broken"), F.lit(None).cast("string")]
    raw = F.get(F.array(*texts), (F.col("event_id") % len(texts)).cast("int"))
    return _events(spark, sf_dir).select("event_id", records.json_kind(raw).alias("kind"))


def job_last_status(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return usage.last_status(c, "conv_id", "role", "turn")


def job_all_done(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.groupBy("conv_id").agg(F.bool_and(F.col("role") == "assistant").alias("all_done"), F.bool_or(F.col("role") == "system").alias("any_system"), F.count("*").alias("n"))


def daily_users(spark, sf_dir):
    """Extension."""
    return _events(spark, sf_dir).groupBy(F.col("ts").cast("date").alias("day")).agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("events"))


def monthly_users(spark, sf_dir):
    """Extension."""
    return _events(spark, sf_dir).groupBy(F.year("ts").alias("year"), F.month("ts").alias("month")).agg(F.count_distinct("user_id").alias("users"))


def tool_success_rate(spark, sf_dir):
    """Extension: k below 90 counts as success."""
    k = F.get_json_object("props", "$.k").cast("int")
    return _events(spark, sf_dir).groupBy(F.col("event_type").alias("tool_name")).agg(F.count("*").alias("n"), F.count_if(k < 90).alias("ok")).withColumn("rate", F.col("ok") / F.col("n"))


def tool_duration_stats(spark, sf_dir):
    """Extension: the median is exact, and no task holds a tool's durations."""
    e = _events(spark, sf_dir).select(F.col("event_type").alias("tool_name"), "value")
    stats = e.groupBy("tool_name").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("n"))
    return stats.join(ops.exact_median(e, "tool_name", "value"), "tool_name", "left").withColumn("median", F.floor(F.col("median") * 100 + 0.5) / 100)


def session_rollup(spark, sf_dir):
    """Extension: what each session did; its id tells sessions apart."""
    e = _events(spark, sf_dir).withColumn("session_id", _session())
    return e.groupBy("session_id", "user_id").agg(F.count("*").alias("events"), F.count_distinct("event_type").alias("tools"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


def telemetry_stream(spark, sf_dir):
    """Extension: the masked events as a stream, run to its end; rows only."""
    from ..streaming.events import masked_stream, write_available

    folder = new_folder(spark, "stream")
    # A pattern, so that the table may be a file or a folder.
    stream = masked_stream(spark, f"{sf_dir}/events.parquet*", _events(spark, sf_dir).schema)
    write_available(stream, f"{folder}/rows", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("event_id", "user_id", "tool_name", "metadata", "error_message")


def event_sink_stream(spark, sf_dir):
    """Extension: the masked events sent batch by batch, each batch once."""
    from ..streaming.events import each_batch, masked_stream

    folder = new_folder(spark, "sink")
    stream = masked_stream(spark, f"{sf_dir}/events.parquet*", _events(spark, sf_dir).schema)
    done = each_batch(stream.select("event_id", "user_id", "tool_name", "metadata"), f"{folder}/rows", f"{folder}/state")
    return spark.read.parquet(*done)


def job_status_stream(spark, sf_dir):
    """The last status of each job, from status rows as they come in."""
    from ..streaming.events import each_batch, last_statuses

    folder = new_folder(spark, "jobs")
    schema = spark.read.parquet(f"{sf_dir}/conversations.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/conversations.parquet*")
    done = each_batch(last_statuses(rows, "conv_id", "role", "turn"), f"{folder}/rows", f"{folder}/state", mode="complete")
    return spark.read.parquet(done[-1])


def framed_messages(spark, sf_dir):
    """Messages put together again from chunks: each user's events come in two parts, and some end in the middle of one."""
    from ..streaming.framing import framed

    folder = new_folder(spark, "chunks")
    cut = F.lit(4)
    parts = F.array(F.struct(F.lit(0).alias("k"), F.left("props", cut).alias("part")), F.struct(F.lit(1).alias("k"), F.expr("substring(props, 5)").alias("part")))
    chunks = _events(spark, sf_dir).select("user_id", "event_id", F.explode(parts).alias("c")).select("user_id", (F.col("event_id") * 2 + F.col("c.k")).alias("ord"), "c.part")
    chunks.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(chunks.schema).parquet(f"{folder}/in")
    from ..streaming.events import write_available

    write_available(framed(stream, "user_id", "ord", "part"), f"{folder}/rows", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


QUERIES = {f.__name__: f for f in (
    dict_last_wins, priority_pick, arm_fallback, first_match_else_first, last_match, consent_mask, telemetry_row, job_last_status,
    job_all_done, daily_users, monthly_users, tool_success_rate, tool_duration_stats, session_rollup, telemetry_stream, enabled_events,
    bounded_queue, call_time, json_kinds, event_sink_stream, job_status_stream, framed_messages,
)}

_SESSION = "md5(user_id || '/' || CAST(json_extract_string(props, '$.k') AS INTEGER) % 8)"
_ERROR = "CASE WHEN event_type = 'error' THEN repeat(props, 30) ELSE '' END"

ORACLES = {
    "dict_last_wins": "SELECT event_type, arg_max(value, event_id) AS value, min(event_id) AS position FROM events GROUP BY 1",
    "priority_pick": """
SELECT user_id, event_type AS picked_kind, value AS picked FROM (
  SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY
    CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, event_id DESC) AS r
  FROM events WHERE event_type IN ('purchase', 'signup', 'error')) WHERE r = 1""",
    "arm_fallback": """
WITH f AS (SELECT user_id, bool_or(event_type = 'click') AS arm, bool_or(event_type = 'view') AS rough, bool_or(event_type = 'signup') AS metal,
  bool_or(event_type = 'error') AS colour, bool_or(event_type = 'purchase') AS ao FROM events GROUP BY 1)
SELECT user_id, arm AND NOT rough AS g_to_roughness, arm AND NOT metal AS b_to_metallic,
  CASE WHEN arm AND colour THEN CAST(0.8 AS DOUBLE) END AS r_mix, CASE WHEN ao AND colour THEN CAST(0.8 AS DOUBLE) END AS ao_mix FROM f""",
    "first_match_else_first": """
SELECT user_id, coalesce(arg_min(value, event_id) FILTER (value BETWEEN 400 AND 800), arg_min(value, event_id)) AS value,
  bool_or(value BETWEEN 400 AND 800) AS matched FROM events GROUP BY 1""",
    "last_match": "SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY 1",
    "consent_mask": f"""
SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'prompt ' || CAST(event_id AS VARCHAR) END AS prompt_text, CASE WHEN user_id % 2 = 0 THEN props END AS metadata,
  CASE WHEN user_id % 2 = 0 THEN CASE WHEN length(m) > 200 THEN left(m, 200) || '...' ELSE m END
    WHEN length(m) > 0 THEN '{usage.MASKED_ERROR}' ELSE m END AS error_message
FROM (SELECT *, {_ERROR} AS m FROM events)""",
    "telemetry_row": f"""
WITH e AS (SELECT *, {_ERROR} AS m, user_id % 2 = 0 AS yes FROM events)
SELECT CAST(user_id AS VARCHAR) AS customer_uuid, {_SESSION} AS session_id, CASE WHEN event_type = 'signup' THEN 'startup' ELSE 'tool_execution' END AS event_type,
  event_type AS tool_name, CASE WHEN yes THEN 'prompt ' || CAST(event_id AS VARCHAR) END AS prompt_text, event_type <> 'error' AS success, value AS duration_ms,
  CASE WHEN yes THEN CASE WHEN length(m) > 200 THEN left(m, 200) || '...' ELSE m END WHEN length(m) > 0 THEN '{usage.MASKED_ERROR}' ELSE m END AS error_message,
  '1.0' AS version, CASE WHEN user_id % 3 = 0 THEN 'linux' ELSE 'darwin' END AS platform, CAST(NULL AS VARCHAR) AS app_version,
  CASE WHEN yes AND event_id % 4 <> 0 THEN props ELSE '{{}}' END AS metadata, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS event_timestamp,
  CASE WHEN yes AND event_id % 4 <> 0 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM e""",
    "enabled_events": """
SELECT event_id, user_id FROM events WHERE user_id % 10 <> 0 AND user_id % 7 NOT IN (1, 3, 6) AND user_id * 3 % 7 NOT IN (1, 3, 6)""",
    "bounded_queue": """
WITH r AS (SELECT CAST(ts AS DATE) AS day, event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) AS r FROM events)
SELECT day, count(*) FILTER (r <= 20) AS taken, count(*) FILTER (r > 20) AS dropped, max(event_id) FILTER (r <= 20) AS last_taken FROM r GROUP BY 1""",
    "call_time": """
SELECT user_id, CAST((max(floor(epoch_us(ts) / 1000000.0)) - min(floor(epoch_us(ts) / 1000000.0))) * 1000 AS BIGINT) AS ms FROM events GROUP BY 1""",
    "json_kinds": """
SELECT event_id, (['object', 'array', 'string', 'boolean', 'integer', 'number', 'null', 'malformed', 'malformed'])[event_id % 9 + 1] AS kind FROM events""",
    "event_sink_stream": "SELECT event_id, user_id, event_type AS tool_name, CASE WHEN user_id % 2 = 0 THEN props END AS metadata FROM events",
    "job_status_stream": "SELECT conv_id, arg_max(role, turn) AS last_status, max(turn) AS last_order FROM conversations GROUP BY 1",
    "framed_messages": "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS message, props AS body FROM events",
    "job_last_status": "SELECT conv_id, arg_max(role, turn) AS last_status, max(turn) AS last_order FROM conversations GROUP BY 1",
    "job_all_done": "SELECT conv_id, bool_and(role = 'assistant') AS all_done, bool_or(role = 'system') AS any_system, count(*) AS n FROM conversations GROUP BY 1",
    "daily_users": "SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS users, count(*) AS events FROM events GROUP BY 1",
    "monthly_users": "SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2",
    "tool_success_rate": """
SELECT event_type AS tool_name, count(*) AS n, count(*) FILTER (CAST(json_extract_string(props, '$.k') AS INTEGER) < 90) AS ok,
  CAST(count(*) FILTER (CAST(json_extract_string(props, '$.k') AS INTEGER) < 90) AS DOUBLE) / count(*) AS rate FROM events GROUP BY 1""",
    "tool_duration_stats": """
SELECT event_type AS tool_name, min(value) AS least, max(value) AS most, count(*) AS n, floor(quantile_cont(value, 0.5) * 100 + 0.5) / 100 AS median FROM events GROUP BY 1""",
    "session_rollup": f"""
SELECT {_SESSION} AS session_id, user_id, count(*) AS events, count(DISTINCT event_type) AS tools, min(event_id) AS first_event, max(event_id) AS last_event
FROM events GROUP BY 1, 2""",
    "telemetry_stream": f"""
SELECT event_id, user_id, event_type AS tool_name, CASE WHEN user_id % 2 = 0 THEN props END AS metadata,
  CASE WHEN event_type = 'error' THEN CASE WHEN user_id % 2 = 0 THEN props ELSE '{usage.MASKED_ERROR}' END END AS error_message FROM events""",
}
