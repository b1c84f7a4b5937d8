"""Record-shape queries: requests, merges, manifests, names, nodes, jobs and archives."""

from __future__ import annotations

import contextlib
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions import strings as st
from ..functions.timing import recorded
from ..operators import collections as ops
from ..operators import records
from ..operators import textures as tx
from ..operators import usage
from ..sources import files
from ..sources.shared import new_folder
from .catalog_queries import exact_round_sql


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _part(spark, sf_dir):
    return _read(spark, sf_dir, "part")


def _pick(values: list[str | None], number):
    return F.get(F.array(*(F.lit(v) for v in values)), F.pmod(number, F.lit(len(values))).cast("int"))


def request_build(spark, sf_dir):
    """Search requests: some keys are always there, whatever their value; others only if it says something."""
    rows = _part(spark, sf_dir).select(
        "p_partkey", F.lit("models").alias("type"), _pick(["false", "red", "0"], F.col("p_partkey")).alias("q"), (F.col("p_size") % 4).cast("long").alias("count"),
        (F.col("p_size") % 2 == 0).alias("downloadable"), F.lit(False).alias("archives_flavours"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise("").alias("categories"), (F.col("p_size") % 5).cast("long").alias("seed"),
    )
    made = records.request(rows, ["type", "q", "count", "downloadable", "archives_flavours"], ["categories", "seed"])
    return rows.select("p_partkey", made.alias("request"))


def map_merge(spark, sf_dir):
    """Two attribute maps merged, the later one's values winning."""
    a = F.create_map(F.lit("name"), F.col("p_name"), F.lit("kind"), F.col("p_type"))
    b = F.create_map(F.lit("kind"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    m = records.merge(a, b)
    return _part(spark, sf_dir).select("p_partkey", *(F.try_element_at(m, F.lit(k)).alias(k) for k in ("name", "kind", "size")), F.size(F.map_keys(m)).cast("long").alias("n"))


def material_names(spark, sf_dir):
    """Materials of each object: slots expanded, empty ones dropped, gathered in order."""
    slots = F.array(F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")))
    made = records.slot_names(_part(spark, sf_dir).select("p_partkey", slots.alias("slots")), "p_partkey", "slots")
    return made.select("p_partkey", F.concat_ws(", ", "names").alias("names"), F.size("names").cast("long").alias("n"))


def _images(spark, sf_dir):
    return _read(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.concat(F.lit("img"), (F.col("user_id") % 60).cast("string")).alias("name"))


def texture_nodes(spark, sf_dir):
    """Each part as a node with the first image (event) of its name."""
    nodes = _part(spark, sf_dir).select(F.col("p_partkey").alias("node"), F.concat(F.lit("img"), F.col("p_size").cast("string")).alias("image"))
    return tx.node_images(nodes, _images(spark, sf_dir)).select("node", "image", "image_ord")


def texture_node_of_type(spark, sf_dir):
    """The node that each map type ends up with: the last one that has an image."""
    nodes = _part(spark, sf_dir).select(F.col("p_partkey").alias("node"), F.col("p_partkey").alias("ord"), F.col("p_type").alias("map_type"), F.concat(F.lit("img"), F.col("p_size").cast("string")).alias("image"))
    return tx.last_node_of_type(nodes, _images(spark, sf_dir))


def link_filter(spark, sf_dir):
    """Links that don't go into one socket; those whose socket is missing stay."""
    lines = _read(spark, sf_dir, "lineitem")
    socket = F.when(F.col("l_linenumber") != 3, F.col("l_returnflag"))
    links = lines.select(F.col("l_suppkey").alias("from_node"), socket.alias("to_socket"), F.col("l_linestatus").alias("from_socket")).distinct()
    return records.without_links_to(links, "R")


def manifest_lookup(spark, sf_dir):
    """What a landed manifest has: map type, resolution and format for textures, two levels for models."""
    one = lambda k, v: F.create_map(k, v)
    kinds = ["diffuse", "nor", "rough"]
    manifest = _part(spark, sf_dir).select(
        F.col("p_partkey").alias("ord"),
        one(_pick(kinds, F.col("p_size")), one(F.concat((F.col("p_size") % 4).cast("string"), F.lit("k")), one(_pick(["jpg", "exr"], F.col("p_size")), F.concat(F.lit("u"), F.col("p_partkey"))))).alias("files"),
    )
    path = files.landed_json(manifest, "manifest")
    read = files.json_records(spark, path, "ord BIGINT, files MAP<STRING, MAP<STRING, MAP<STRING, STRING>>>")
    kind, size, fmt = _pick(kinds, F.col("ord")), F.lit("1k"), F.lit("exr")
    url = F.try_element_at(F.try_element_at(F.try_element_at(F.col("files"), kind), size), fmt)
    model = F.try_element_at(F.col("files"), F.lit("nor"))
    return read.select("ord", tx.manifest_has(F.col("files"), kind, size, fmt).alias("there"), url.alias("url"), F.coalesce(tx.model_has(model, size, fmt), F.lit(False)).alias("model_there"))


def job_states(spark, sf_dir):
    """Statuses of landed jobs: read from their JSON, whether all are done, and what each service's words mean."""
    words = ["Done", "Waiting", "Done", "IN_QUEUE", "COMPLETED", "RUN", "DONE", "Failed"]
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"))
    n = F.pmod(F.col("ord"), F.lit(4))
    jobs = F.transform(F.slice(F.array(*(_pick(words, F.col("ord") + i * (F.col("ord") % 3)) for i in range(3))), F.lit(1), n.cast("int")), lambda s: F.struct(s.alias("status")))
    path = files.landed_json(o.select("ord", F.when(F.col("ord") % 7 != 0, F.to_json(jobs)).alias("jobs")), "jobs")
    read = files.json_records(spark, path, "ord BIGINT, jobs STRING").withColumn("status_list", records.statuses(F.col("jobs")))
    last = F.try_element_at("status_list", F.lit(-1))
    return read.select(
        "ord", usage.job_status(F.col("status_list")).alias("done"), F.when(F.col("jobs").isNotNull(), F.concat_ws(",", "status_list")).alias("statuses"),
        *(usage.job_state(last, s).alias(f"{s}_state") for s in ("list", "queue", "run")),
    )


def submit_handle(spark, sf_dir):
    """Handles of submitted jobs under the names that polling asks for."""
    o = _read(spark, sf_dir, "orders")
    raw = F.to_json(F.struct(F.concat(F.lit("job_"), F.col("o_orderkey")).alias("uuid"), F.struct(F.col("o_orderpriority").alias("subscription_key")).alias("jobs")))
    got = records.handle(F.when(F.col("o_orderkey") % 5 != 0, raw).otherwise("{}"))
    return o.select("o_orderkey", *(c.alias(k) for k, c in got.items())).withColumn("job_id", st.strip_prefix(F.col("task_uuid"), "job_"))


def thumbnail_pick(spark, sf_dir):
    """The first thumbnail of a middling width, else the first one, from an array; and the first of all."""
    p = _part(spark, sf_dir)
    widths = F.slice(F.array(F.col("p_size") * 20, (F.col("p_partkey") % 900).cast("int"), F.lit(640)), F.lit(1), F.pmod(F.col("p_partkey"), F.lit(4)).cast("int"))
    rows = p.select("p_partkey", widths.alias("w"))
    return rows.select("p_partkey", records.first_where_else_first(F.col("w"), lambda w: w.between(400, 800)).alias("width"), ops.first_of_array(F.col("w")).alias("first_width"))


def file_or_error(spark, sf_dir):
    """Of each job's files the first with the wanted suffix, else an error."""
    e = _read(spark, sf_dir, "events").select("user_id", "event_id", F.concat("event_type", F.lit("."), _pick(["glb", "obj", "zip", "txt"], F.col("event_id") + F.col("user_id"))).alias("name"))
    some = e.where(F.col("user_id") % 3 != 0).union(e.where((F.col("user_id") % 3 == 0) & ~F.col("name").endswith(".glb")))
    return ops.first_match(some, "user_id", "name", "event_id", st.suffix(F.col("name")) == ".glb")


def blob_name(spark, sf_dir):
    """Names and references of stored blobs, and the UTC day of their second."""
    e = _read(spark, sf_dir, "events")
    name = records.blob_name(F.lit("shot"), F.col("user_id"), F.unix_micros(F.col("ts").cast("timestamp")))
    return e.select("event_id", name.alias("name"), records.storage_reference("shots", name).alias("reference"), records.utc_day(usage.epoch_seconds(F.col("ts"))).alias("day"))


def transpose_points(spark, sf_dir):
    """A vector's points as rows turned into axes, and all their numbers in one list."""
    v = _read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    points = F.transform(F.sequence(F.lit(0), F.floor(F.size("v") / 3).cast("int") - 1), lambda i: F.slice("v", i * 3 + 1, 3))
    rows = v.select("vec_id", records.transpose(points, 3).alias("axes"), F.flatten(points).alias("all"))
    return rows.select("vec_id", F.array_min(F.col("axes")[0]).alias("min_x"), F.array_max(F.col("axes")[2]).alias("max_z"), F.size("all").cast("long").alias("n"), F.element_at("all", -1).alias("last"))


def key_kind(spark, sf_dir):
    """What kind of key each customer has: the trial key, one of their own, or none."""
    key = _pick(["TRIAL", "mine", "", None], F.col("c_custkey"))
    return _read(spark, sf_dir, "customer").select("c_custkey", records.key_kind(key, "TRIAL").alias("kind"))


def rounded_exactly(spark, sf_dir):
    """Rounding of the exact binary value, halves to even, at two and four digits."""
    x = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity") / 8).otherwise(F.col("l_extendedprice") * (1 - F.col("l_discount")) / 7)
    signed = F.when(F.col("l_linenumber") % 3 == 0, -x).otherwise(x)
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.exact_round(signed, 2).alias("two"), numbers.exact_round(signed, 4).alias("four"))


def settings_clamped(spark, sf_dir):
    """Numeric settings kept within their bounds; the default where there is none."""
    from ..schemas import SETTINGS

    x = F.when(F.col("p_partkey") % 9 != 0, F.col("p_retailprice") * F.col("p_size") - 900)
    low, high, default = SETTINGS["port"]
    s_low, s_high, s_default = SETTINGS["num_inference_steps"]
    return _part(spark, sf_dir).select(
        "p_partkey", numbers.clamp(F.coalesce(x, F.lit(float(default))), float(low), float(high)).cast("int").alias("port"),
        numbers.clamp(F.coalesce(F.when(x.isNotNull(), F.col("p_size")), F.lit(s_default)), s_low, s_high).cast("int").alias("steps"),
    )


def archive_paths(spark, sf_dir):
    """Whether the paths of archive entries stay below the folder that they are extracted to."""
    shapes = [F.col("p_name"), F.concat(F.lit("../"), F.col("p_name")), F.concat(F.lit("a/../b/"), F.col("p_name"), F.lit("..txt")), F.concat(F.lit("/etc/"), F.col("p_name")), F.concat(F.lit("../extract-not/"), F.col("p_name"))]
    path = F.get(F.array(*shapes), (F.col("p_partkey") % 5).cast("int"))
    return _part(spark, sf_dir).select("p_partkey", st.inside("/extract", path).alias("safe"), st.suffix(path).alias("suffix"), st.normalised(st.joined(F.lit("/extract/"), path)).alias("real"))


def _zipped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A ZIP file of each row's names; every seventh one is broken."""
    for frame in frames:
        made = []
        for key, names in zip(frame["key"], frame["names"]):
            raw = io.BytesIO()
            with zipfile.ZipFile(raw, "w") as z:
                for n in names:
                    z.writestr(zipfile.ZipInfo(n), n.upper())
            made.append((f"{key}.zip", raw.getvalue() if key % 7 else b"broken"))
        yield pd.DataFrame(made, columns=["path", "content"])


def archive_files(spark, sf_dir):
    """Entries of ZIP files with what is in them; broken files are rows with an error."""
    names = F.array(F.concat("s_name", F.lit(".obj")), F.concat(F.lit("../"), "s_name"))
    zips = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), names.alias("names")).mapInPandas(_zipped, "path string, content binary")
    made = files.archive_entries(zips, extract=True)
    return made.select("path", "entry", "size", "safe", F.col("data").cast("string").alias("data"), F.when(F.col("error").isNotNull(), "error").alias("error"))


def binary_listing(spark, sf_dir):
    """Files of a folder as bytes: length, digest and base64, there and back; those whose name has a suffix."""
    folder = new_folder(spark, "binary")
    _read(spark, sf_dir, "nation").select(F.col("n_name").alias("value"), F.concat(F.col("n_nationkey"), F.when(F.col("n_nationkey") % 2 == 0, ".glb").otherwise(".txt")).alias("name")).write.partitionBy("name").text(folder)
    name = F.regexp_extract("path", "name=([^/]+)/", 1)
    found = files.binary_files(spark, folder, "part-*").where(st.suffix(name) == ".txt")
    b64 = st.base64_plain(F.col("content"))
    return found.select(name.alias("name"), "length", F.sha2("content", 256).alias("sha256"), b64.alias("b64"), st.unbase64_text(b64).alias("back"))


def existing_materials(spark, sf_dir):
    """Materials to delete and to create: names that are there, and those that aren't."""
    have = _part(spark, sf_dir).select(F.col("p_brand").alias("name")).distinct()
    want = _read(spark, sf_dir, "nation").select(F.concat(F.lit("Brand#"), F.col("n_nationkey")).alias("name")).distinct()
    gone = want.join(have, "name", "left_semi").withColumn("action", F.lit("replace"))
    return gone.union(ops.difference(want, have, "name").withColumn("action", F.lit("create")))


def recorded_calls(spark, sf_dir):
    """Records of calls that were wrapped: a table's count succeeds, one of a missing column fails."""
    rows: list[dict] = []

    def count(table: str, column: str | None = None) -> int:
        df = _read(spark, sf_dir, table)
        return (df.select(column) if column else df).count()

    for table in ("region", "nation", "supplier"):
        for column in (None, "no_such_column"):
            with contextlib.suppress(AnalysisException):  # it is in the record
                recorded(f"count_{table}", rows.append, ["table", "column"])(count)(table, column)
    flat = [(r["tool_name"], r["success"], r["duration_ms"] >= 0, r["metadata"].get("table"), r["metadata"].get("column"), r["error_message"] is not None) for r in rows]
    return spark.createDataFrame(flat, "tool_name string, success boolean, timed boolean, table_name string, column_name string, has_error boolean")


QUERIES = {f.__name__: f for f in (
    request_build, map_merge, material_names, texture_nodes, texture_node_of_type, link_filter, manifest_lookup, job_states, submit_handle,
    thumbnail_pick, file_or_error, blob_name, transpose_points, key_kind, rounded_exactly, settings_clamped, archive_paths, archive_files,
    binary_listing, existing_materials, recorded_calls,
)}

_SIGNED = """CASE WHEN l_linenumber % 3 = 0 THEN -1 ELSE 1 END *
  CASE WHEN l_linenumber % 2 = 0 THEN l_quantity / 8.0::DOUBLE ELSE l_extendedprice * (1.0::DOUBLE - l_discount) / 7.0::DOUBLE END"""
_WORD = "(['Done', 'Waiting', 'Done', 'IN_QUEUE', 'COMPLETED', 'RUN', 'DONE', 'Failed'])"

ORACLES = {
    "request_build": """
SELECT p_partkey, '{"type":"models","q":"' || (['false', 'red', '0'])[p_partkey % 3 + 1] || '","count":' || p_size % 4 || ',"downloadable":' || CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END ||
  ',"archives_flavours":false' || CASE WHEN p_size % 3 = 0 THEN ',"categories":"' || p_type || '"' ELSE '' END ||
  CASE WHEN p_size % 5 <> 0 THEN ',"seed":' || p_size % 5 ELSE '' END || '}' AS request FROM part""",
    "map_merge": "SELECT p_partkey, p_name AS name, p_brand AS kind, CAST(p_size AS VARCHAR) AS size, CAST(3 AS BIGINT) AS n FROM part",
    "material_names": """
SELECT p_partkey, p_brand || CASE WHEN p_size % 2 = 0 THEN ', ' || p_type ELSE '' END AS names,
  CAST(CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n FROM part""",
    "texture_nodes": """
WITH i AS (SELECT 'img' || CAST(user_id % 60 AS VARCHAR) AS image, min(event_id) AS image_ord FROM events GROUP BY 1)
SELECT p_partkey AS node, image, image_ord FROM part JOIN i ON image = 'img' || CAST(p_size AS VARCHAR)""",
    "texture_node_of_type": """
WITH i AS (SELECT 'img' || CAST(user_id % 60 AS VARCHAR) AS image, min(event_id) AS image_ord FROM events GROUP BY 1),
n AS (SELECT p_type AS map_type, p_partkey AS node, image, image_ord, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey DESC) AS r
  FROM part JOIN i ON image = 'img' || CAST(p_size AS VARCHAR))
SELECT map_type, node, image, image_ord FROM n WHERE r = 1""",
    "link_filter": """
SELECT * FROM (SELECT DISTINCT l_suppkey AS from_node, CASE WHEN l_linenumber <> 3 THEN l_returnflag END AS to_socket, l_linestatus AS from_socket FROM lineitem)
WHERE to_socket IS DISTINCT FROM 'R'""",
    "manifest_lookup": """
WITH m AS (SELECT p_partkey AS ord, (['diffuse', 'nor', 'rough'])[p_size % 3 + 1] AS kind, p_size % 4 = 1 AND p_size % 2 = 1 AS fits, (['diffuse', 'nor', 'rough'])[p_partkey % 3 + 1] AS asked FROM part)
SELECT ord, kind = asked AND fits AS there, CASE WHEN kind = asked AND fits THEN 'u' || ord END AS url, kind = 'nor' AND fits AS model_there FROM m""",
    "job_states": f"""
WITH s AS (SELECT o_orderkey AS ord, o_orderkey % 7 <> 0 AS there,
  ([{_WORD}[o_orderkey % 8 + 1], {_WORD}[(o_orderkey + o_orderkey % 3) % 8 + 1], {_WORD}[(o_orderkey + 2 * (o_orderkey % 3)) % 8 + 1]])[1:o_orderkey % 4] AS l FROM orders),
x AS (SELECT ord, CASE WHEN there THEN l END AS l, CASE WHEN there AND len(l) > 0 THEN l[len(l)] END AS last FROM s)
SELECT ord, CASE WHEN l IS NOT NULL THEN len(list_filter(l, lambda y: y <> 'Done')) = 0 END AS done, CASE WHEN l IS NOT NULL THEN coalesce(array_to_string(l, ','), '') END AS statuses,
  CASE WHEN last IS NULL THEN NULL WHEN last = 'Done' THEN 'done' ELSE 'failed' END AS list_state,
  CASE WHEN last IS NULL THEN NULL WHEN last = 'COMPLETED' THEN 'done' WHEN last IN ('IN_QUEUE', 'IN_PROGRESS') THEN 'running' ELSE 'failed' END AS queue_state,
  CASE WHEN last IS NULL THEN NULL WHEN last = 'DONE' THEN 'done' WHEN last IN ('WAIT', 'RUN') THEN 'running' ELSE 'failed' END AS run_state FROM x""",
    "submit_handle": """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 'job_' || o_orderkey END AS task_uuid, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS subscription_key,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS job_id FROM orders""",
    "thumbnail_pick": """
WITH w AS (SELECT p_partkey, ([p_size * 20, CAST(p_partkey % 900 AS INTEGER), 640])[1:p_partkey % 4] AS w FROM part)
SELECT p_partkey, coalesce((list_filter(w, lambda x: x BETWEEN 400 AND 800))[1], w[1]) AS width, w[1] AS first_width FROM w""",
    "file_or_error": """
WITH e AS (SELECT user_id, event_id, event_type || '.' || (['glb', 'obj', 'zip', 'txt'])[(event_id + user_id) % 4 + 1] AS name FROM events),
s AS (SELECT * FROM e WHERE user_id % 3 <> 0 OR name NOT LIKE '%.glb')
SELECT user_id, arg_min(name, event_id) FILTER (name LIKE '%.glb') AS name, CASE WHEN NOT bool_or(name LIKE '%.glb') THEN 'no match' END AS error FROM s GROUP BY 1""",
    "blob_name": """
WITH n AS (SELECT event_id, 'shot_' || CAST(user_id AS VARCHAR) || '_' || CAST(CAST(floor(epoch_us(ts) / 1000.0) AS BIGINT) AS VARCHAR) || '.png' AS name, strftime(ts, '%Y-%m-%d') AS day FROM events)
SELECT event_id, name, 'storage:shots/' || name AS reference, day FROM n""",
    "transpose_points": """
SELECT vec_id, list_min(list_transform(range(21), lambda k: CAST(embedding[1 + 3 * k] AS DOUBLE))) AS min_x,
  list_max(list_transform(range(21), lambda k: CAST(embedding[3 + 3 * k] AS DOUBLE))) AS max_z, CAST(63 AS BIGINT) AS n,
  CAST(embedding[63] AS DOUBLE) AS last FROM embeddings""",
    "key_kind": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'free_trial' WHEN 1 THEN 'private' END AS kind FROM customer",
    "rounded_exactly": f"""
SELECT l_orderkey, l_linenumber, {exact_round_sql("x", 2)} AS two, {exact_round_sql("x", 4)} AS four FROM (SELECT l_orderkey, l_linenumber, {_SIGNED} AS x FROM lineitem)""",
    "settings_clamped": """
SELECT p_partkey, CAST(trunc(greatest(least(CASE WHEN p_partkey % 9 <> 0 THEN p_retailprice * p_size - 900 ELSE 9876 END, 65535), 1024)) AS INTEGER) AS port,
  CASE WHEN p_partkey % 9 <> 0 THEN greatest(least(p_size, 50), 20) ELSE 20 END AS steps FROM part""",
    "archive_paths": """
SELECT p_partkey, p_partkey % 5 IN (0, 2) AS safe, CASE WHEN p_partkey % 5 = 2 THEN '.txt' ELSE '' END AS suffix,
  CASE p_partkey % 5 WHEN 0 THEN '/extract/' || p_name WHEN 1 THEN '/' || p_name WHEN 2 THEN '/extract/b/' || p_name || '..txt' WHEN 3 THEN '/etc/' || p_name
    ELSE '/extract-not/' || p_name END AS "real" FROM part""",
    "archive_files": """
SELECT s_suppkey || '.zip' AS path, s_name || '.obj' AS entry, CAST(length(s_name) + 4 AS BIGINT) AS size, true AS safe, upper(s_name || '.obj') AS data, CAST(NULL AS VARCHAR) AS error FROM supplier WHERE s_suppkey % 7 <> 0
UNION ALL SELECT s_suppkey || '.zip', '../' || s_name, CAST(length(s_name) + 3 AS BIGINT), false, NULL, NULL FROM supplier WHERE s_suppkey % 7 <> 0
UNION ALL SELECT s_suppkey || '.zip', NULL, NULL, NULL, NULL, 'error' FROM supplier WHERE s_suppkey % 7 = 0""",
    "binary_listing": """
SELECT n_nationkey || '.txt' AS name, CAST(length(n_name) + 1 AS BIGINT) AS length, sha256(n_name || chr(10)) AS sha256, base64(encode(n_name || chr(10))) AS b64, n_name || chr(10) AS back
FROM nation WHERE n_nationkey % 2 = 1""",
    "existing_materials": """
WITH w AS (SELECT DISTINCT 'Brand#' || n_nationkey AS name FROM nation)
SELECT name, CASE WHEN name IN (SELECT p_brand FROM part) THEN 'replace' ELSE 'create' END AS action FROM w""",
    "recorded_calls": """
SELECT 'count_' || t AS tool_name, c IS NULL AS success, true AS timed, t AS table_name, c AS column_name, c IS NOT NULL AS has_error
FROM (VALUES ('region'), ('nation'), ('supplier')) a(t), (VALUES (NULL), ('no_such_column')) b(c)""",
}
