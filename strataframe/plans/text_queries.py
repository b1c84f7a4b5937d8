"""String, URL and settings queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings as st
from ..operators import textures as tx
from ..operators import usage


def _pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def string_parse(spark, sf_dir):
    url = F.col("url")
    return _pages(spark, sf_dir).select(
        "page_id", st.last_segment(url, "/").alias("last"), F.split_part(url, F.lit("/"), F.lit(3)).alias("host"),
        F.upper(F.split_part(url, F.lit(":"), F.lit(1))).alias("scheme"), st.is_web_url(url).alias("web"), url.contains("..").alias("dots"),
        st.strip_prefix(url, "https://").alias("bare"), F.rtrim(url, F.lit("/")).alias("trimmed"), F.trim(F.concat(F.lit("  "), url, F.lit(" "))).alias("stripped"),
        st.has_host(F.when(F.col("page_id") % 4 != 0, url).otherwise(F.split_part(url, F.lit("/"), F.lit(3)))).alias("address"), st.image_format(F.when(F.col("page_id") % 3 == 0, "image/png"), url).alias("suffix"),
    )


def truncate_ellipsis(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", st.ellipsis(F.col("text"), 200).alias("short"), (F.length("text") > 200).alias("long"))


def text_digest(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = F.col("text").cast("binary")
    return docs.select("doc_id", F.sha2(raw, 256).alias("sha256"), st.base64_plain(raw).alias("b64"))


# Parts' names with a map type behind them stand for the names of images.
_KINDS = ["diffuse", "nor_gl", "Normal", "DISP", "rough", "metal", "arm", "floor_diffuse", "diff", "height", "COLOR", "disp"]


def _pick(values, number):
    return F.get(F.array(*(F.lit(v) for v in values)), F.pmod(number, F.lit(len(values))).cast("int"))


def _image_names(spark, sf_dir):
    kind = _pick(_KINDS, F.col("p_size"))
    name = F.concat(F.translate("p_name", " ", "_"), F.lit("_"), kind, F.when(F.col("p_size") % 2 == 0, ".jpg").otherwise(".exr"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 11 == 0, "plain").otherwise(name).alias("name"))


def map_type_slot(spark, sf_dir):
    df = _image_names(spark, sf_dir).withColumn("kind", st.map_type(F.col("name")))
    return df.select(
        "ord", "kind", tx.slot(F.col("kind")).alias("apply_slot"),
        tx.slot(F.col("kind"), tx.NORMAL_DOWNLOAD, exact_displacement=True).alias("download_slot"),
        tx.colour_space(F.col("kind")).alias("space"), tx.colour_space(F.col("kind"), exact=True).alias("space_exact"),
    )


def prefix_capture(spark, sf_dir):
    """The images of texture ``red``, by map type; ``red_widget`` and others that extend its id are captured too."""
    return tx.images_of(_image_names(spark, sf_dir), "red")


def config_precedence(spark, sf_dir):
    """Customers' settings from three places, with a key that wins over the first, a default and yes-or-no texts."""
    c, k = spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_custkey")
    pref, scene, env = _pick(["p", "", None], k), _pick(["s", "", "TRIAL", None], k), _pick(["yes", "", "ON", "0", None], k)
    return c.select(
        "c_custkey", usage.setting(pref, scene, env).alias("value"), usage.setting_with_trial(pref, scene, env, "TRIAL").alias("trial_value"),
        F.coalesce(st.non_empty(pref), F.lit("fallback")).alias("with_default"), st.truthy(env).alias("on"),
    )


def envelope_route(spark, sf_dir):
    """Commands as JSON texts, some of them malformed, and the whole responses to them."""
    e, n = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id") % 6
    body = F.concat(F.lit('{"type": "'), F.col("event_type"), F.lit('", "params": '), F.col("props"), F.lit("}"))
    raw = F.when(n == 0, '{"params": {}}').when(n == 1, F.left(body, F.length(body) - 1)).when(n == 2, F.concat(body, body)).otherwise(body)
    got = usage.command(raw)
    reply = usage.respond(["click", "view", "signup"], got["type"], got["valid"])
    return e.select(
        "event_id", got["type"].alias("type"), F.get_json_object(got["params"], "$.k").alias("k"), reply["status"].alias("status"), reply["message"].alias("message"),
        usage.response_json(reply, F.struct(F.col("user_id").alias("user"))).alias("response"),
    )


def argument_checks(spark, sf_dir):
    """Whether exactly one of two arguments is given, and whether a prompt isn't too long."""
    from ..operators.collections import exactly_one

    p, k = _pages(spark, sf_dir), F.col("page_id")
    return p.select("page_id", exactly_one(F.when(k % 2 == 0, F.col("url")), F.when(k % 3 == 0, F.col("url")).when(k % 3 == 1, "")).alias("valid"), (F.length("html") > 200).alias("too_long"))


def status_route(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", usage.http_route(_pick([200, 401, 404, 500, None], F.col("o_orderkey"))).alias("route"))


def format_default(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    kind, asked = _pick(["hdris", "textures", "models", "other"], F.col("p_size")), _pick([None, "exr", None], F.col("p_partkey"))
    return p.select("p_partkey", tx.asset_format(asked, kind).alias("format"))


QUERIES = {f.__name__: f for f in (
    string_parse, truncate_ellipsis, text_digest, map_type_slot, prefix_capture, config_precedence, envelope_route,
    argument_checks, status_route, format_default,
)}

_IMAGES = f"""n AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 11 = 0 THEN 'plain'
  ELSE replace(p_name, ' ', '_') || '_' || ({_KINDS})[p_size % {len(_KINDS)} + 1] || CASE WHEN p_size % 2 = 0 THEN '.jpg' ELSE '.exr' END END AS name FROM part)"""

ORACLES = {
    "string_parse": """
SELECT page_id, split_part(url, '/', -1) AS last, split_part(url, '/', 3) AS host, upper(split_part(url, ':', 1)) AS scheme,
  regexp_matches(url, '^(?i)https?://') AS web, contains(url, '..') AS dots,
  CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END AS bare, rtrim(url, '/') AS trimmed, trim(url) AS stripped, page_id % 4 <> 0 AND regexp_matches(url, '^https?://[^/]+') AS address,
  CASE WHEN ends_with(url, '.png') OR page_id % 3 = 0 THEN 'png' ELSE 'jpeg' END AS suffix FROM pages""",
    "truncate_ellipsis": """
SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS short, length(text) > 200 AS long FROM documents""",
    "text_digest": "SELECT doc_id, sha256(text) AS sha256, base64(encode(text)) AS b64 FROM documents",
    "map_type_slot": f"""
WITH {_IMAGES},
k AS (SELECT ord, split_part(split_part(name, '_', -1), '.', 1) AS kind FROM n),
l AS (SELECT *, lower(kind) AS low FROM k)
SELECT ord, kind,
  CASE WHEN low IN ('color', 'diffuse', 'albedo') THEN 'Base Color' WHEN low IN ('roughness', 'rough') THEN 'Roughness'
    WHEN low IN ('metallic', 'metalness', 'metal') THEN 'Metallic' WHEN low IN ('normal', 'nor', 'dx', 'gl') THEN 'Normal'
    WHEN low IN ('displacement', 'disp', 'height') THEN 'Displacement' END AS apply_slot,
  CASE WHEN low IN ('color', 'diffuse', 'albedo') THEN 'Base Color' WHEN low IN ('roughness', 'rough') THEN 'Roughness'
    WHEN low IN ('metallic', 'metalness', 'metal') THEN 'Metallic' WHEN low IN ('normal', 'nor') THEN 'Normal'
    WHEN kind IN ('displacement', 'disp', 'height') THEN 'Displacement' END AS download_slot,
  CASE WHEN low IN ('color', 'diffuse', 'albedo') THEN 'sRGB' ELSE 'Non-Color' END AS space,
  CASE WHEN kind IN ('color', 'diffuse', 'albedo') THEN 'sRGB' ELSE 'Non-Color' END AS space_exact FROM l""",
    "prefix_capture": f"""
WITH {_IMAGES}, m AS (SELECT ord, name, split_part(split_part(name, '_', -1), '.', 1) AS map_type FROM n WHERE starts_with(name, 'red_'))
SELECT map_type, arg_max(name, ord) AS name, min(ord) AS position FROM m GROUP BY 1""",
    "config_precedence": """
WITH r AS (SELECT c_custkey, (['p', '', NULL])[c_custkey % 3 + 1] AS pref, (['s', '', 'TRIAL', NULL])[c_custkey % 4 + 1] AS scene, (['yes', '', 'ON', '0', NULL])[c_custkey % 5 + 1] AS env FROM customer)
SELECT c_custkey, coalesce(nullif(pref, ''), nullif(scene, ''), nullif(env, ''), '') AS value,
  CASE WHEN scene = 'TRIAL' THEN scene ELSE coalesce(nullif(pref, ''), nullif(scene, ''), nullif(env, ''), '') END AS trial_value,
  coalesce(nullif(pref, ''), 'fallback') AS with_default, coalesce(lower(env) IN ('true', '1', 'yes', 'on'), false) AS "on" FROM r""",
    "envelope_route": """
WITH t AS (SELECT event_id, user_id, event_id % 6 NOT IN (1, 2) AS valid, CASE WHEN event_id % 6 > 2 THEN event_type END AS type, props FROM events),
s AS (SELECT *, valid AND coalesce(type IN ('click', 'view', 'signup'), false) AS ok FROM t),
m AS (SELECT *, CASE WHEN NOT valid THEN 'Invalid JSON' WHEN NOT ok THEN 'Unknown command type: ' || coalesce(type, 'null') END AS message FROM s)
SELECT event_id, type, CASE WHEN event_id % 6 > 2 THEN json_extract_string(props, '$.k') END AS k, CASE WHEN ok THEN 'success' ELSE 'error' END AS status, message,
  CASE WHEN ok THEN '{"status":"success","result":{"user":' || user_id || '}}' ELSE '{"status":"error","message":"' || message || '"}' END AS response FROM m""",
    "argument_checks": """
SELECT page_id, (page_id % 2 = 0) <> (page_id % 3 = 0) AS valid, length(html) > 200 AS too_long FROM pages""",
    "status_route": "SELECT o_orderkey, (['ok', 'unauthorised', 'not found', 'failed', 'failed'])[o_orderkey % 5 + 1] AS route FROM orders",
    "format_default": """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN 'exr' ELSE (['hdr', 'jpg', 'gltf', NULL])[p_size % 4 + 1] END AS format FROM part""",
}
