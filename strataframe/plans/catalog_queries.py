"""Scene and catalogue queries. ``part`` stands in for objects and assets, ``lineitem`` for downloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import exact_round, fit_to_max, fixed
from ..functions.strings import map_type, padded, yes_no
from ..operators import collections as ops
from ..operators.records import json_default
from ..operators.textures import colour_space, connections
from ..schemas import ASSETS
from ..sources.files import json_records, landed_json, map_rows
from ..sources.files import json_report as json_object


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _objects(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_type").alias("type"),
        F.col("p_brand").alias("material"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("x"),
    )


def _vectors(spark, sf_dir) -> DataFrame:
    """Location, rotation and scale of objects, from the components of vectors."""
    v = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), "label", F.transform("embedding", lambda x: x.cast("double") * 100).alias("v"))
    three = lambda i: F.array(*(F.element_at("v", i + j) for j in range(3)))
    return v.select("ord", "label", three(1).alias("location"), three(4).alias("rotation"), three(7).alias("scale"))


def scene_summary(spark, sf_dir):
    """The first objects with their place, rounded as the exact binary values say."""
    objects = _objects(spark, sf_dir)
    first = ops.with_total(objects, ops.head(objects, "ord", 10), "object_count")
    place = {"x": F.col("x") / 7, "y": F.col("size") / 8, "z": F.lit(2.675)}
    return first.withColumn("materials_count", objects.agg(F.count_distinct("material")).scalar()).select(
        "ord", "name", "type", *(exact_round(v, 2).alias(a) for a, v in place.items()), "object_count", "materials_count"
    )


def object_info(spark, sf_dir):
    """All of an object: vectors from their components, whether it is seen, the parts that only a mesh has."""
    mesh = F.when(F.col("label") % 2 == 0, F.struct((F.col("ord") * 8).alias("vertices"), (F.col("ord") * 12).alias("edges")))
    wide = _vectors(spark, sf_dir).select(
        "ord", F.concat(F.lit("object "), F.col("ord")).alias("name"), F.when(F.col("label") % 2 == 0, "MESH").otherwise("LIGHT").alias("type"),
        "location", "rotation", "scale", (F.col("label") % 3 != 0).alias("visible"), mesh.alias("mesh"),
    )
    parts = [F.col(c)[i].alias(f"{c}_{a}") for c in ("location", "rotation", "scale") for i, a in enumerate("xyz")]
    return wide.select("ord", "name", "type", *parts, "visible", "mesh.vertices", "mesh.edges")


def json_report(spark, sf_dir):
    """Each object as one JSON object."""
    return _objects(spark, sf_dir).select("ord", json_object(F.col("ord"), F.col("name"), F.when(F.col("size") % 2 == 0, F.col("type")).alias("type"), F.col("size")).alias("report"))


def fixed_format(spark, sf_dir):
    """Numbers as text with three and six digits, and with zeros in front."""
    x = F.col("x") / 7
    return _objects(spark, sf_dir).select("ord", fixed(x, 3).alias("three"), fixed(x / 100, 6).alias("six"), padded(F.col("size"), 4).alias("number"))


def search_page(spark, sf_dir):
    """A page of search results: the source gives so many rows, the first in its order, and the page's size counts what is
    missing in it too."""
    asked = ops.page(_objects(spark, sf_dir).where(F.col("name").contains("o")), "ord", 24)
    shown = asked.select("ord", F.when(F.col("size") % 5 != 0, F.col("name")).alias("name"))
    return shown.withColumn("found", F.count("*").over(Window.partitionBy(F.lit(0)))).where(F.col("name").isNotNull())


def _assets(spark, sf_dir):
    """The capped assets with their downloads. The cap comes first, so only those assets' downloads are counted."""
    capped = ops.head(_objects(spark, sf_dir).select("ord", "name", "type", "size"), "ord", 20)
    lines = _read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ord"))
    downloads = lines.join(F.broadcast(capped.select("ord")), "ord", "left_semi").groupBy("ord").agg(F.count("*").alias("download_count"))
    return capped.join(F.broadcast(downloads), "ord", "left")


def catalog_truncate_then_sort(spark, sf_dir):
    ranked = ops.cap_then_rank(_assets(spark, sf_dir), "ord", "download_count", 20)
    counted = ops.with_total(_objects(spark, sf_dir), ranked, "total_count")
    return counted.select("ord", "name", "download_count", "rank", "total_count", F.least(F.col("total_count"), F.lit(20)).cast("long").alias("returned_count"))


def catalog_report(spark, sf_dir):
    """The text that a client shows: a head, then each capped asset in order of downloads. The assets are read and
    ranked once; the total is carried along."""
    ranked = ops.with_total(_objects(spark, sf_dir), ops.cap_then_rank(_assets(spark, sf_dir), "ord", "download_count", 20), "total_count")
    # Labels and line formats of the report.
    kinds = F.array(F.lit("HDRI"), F.lit("Texture"), F.lit("Model"))
    line = F.concat(
        F.format_string("- %s (ID: %d)\n  Type: %s\n", F.col("name"), F.col("ord"), F.get(kinds, F.col("size") % 3)),
        F.format_string("  Categories: %s\n  Downloads: %s\n", F.col("type"), F.coalesce(F.col("download_count").cast("string"), F.lit("Unknown"))),
    )
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    total = F.max("total_count")
    head = F.format_string("Found %d assets\nShowing %d assets:\n\n", total, F.least(total, F.lit(20)))
    return ranked.agg(F.concat(head, F.concat_ws("\n", F.transform(lines, lambda x: x["line"]))).alias("report"))


def category_counts_sorted(spark, sf_dir):
    counts = _objects(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))
    return ops.rank_counts(counts, "n", "type")


def object_lookup(spark, sf_dir):
    """Names that events ask for, some of which nothing has."""
    words = ("red", "small", "blue", "large"), ("widget", "ring", "bolt", "nothing")
    pick = lambda ws, c: F.get(F.array(*map(F.lit, ws)), F.pmod(c, F.lit(len(ws))).cast("int"))
    e = _read(spark, sf_dir, "events").select(F.concat_ws(" ", pick(words[0], F.col("event_id")), pick(words[1], F.col("user_id"))).alias("name")).distinct()
    return ops.lookup(e, _objects(spark, sf_dir).select("name", "ord", "type", "x"), "name")


def conditional_struct(spark, sf_dir):
    mesh = F.when(F.col("type") == "PROMO", F.struct((F.col("size") * 2).cast("long").alias("vertices"), F.col("size").cast("long").alias("edges")))
    return _objects(spark, sf_dir).withColumn("mesh", mesh).select("ord", "name", "type", F.col("mesh.vertices").alias("vertices"), F.col("mesh.edges").alias("edges"))


def type_label(spark, sf_dir):
    labels = F.array(F.lit("HDRI"), F.lit("Texture"), F.lit("Model"))
    code = F.pmod(F.col("size"), F.lit(4))
    return _objects(spark, sf_dir).select("ord", F.try_element_at(labels, code + 1).alias("label"), F.get(labels, code - 1).alias("label_before"))


def fit_to_max_size(spark, sf_dir):
    w, h = fit_to_max(F.col("size") * 40, F.col("x").cast("int"), 800)
    return _objects(spark, sf_dir).select("ord", w.alias("width"), h.alias("height"))


def filters_members(spark, sf_dir):
    t = F.col("type")
    return _objects(spark, sf_dir).select(
        "ord", (t == "PROMO").alias("eq"), t.isin("SMALL", "LARGE").alias("member"), (~t.isin("SMALL", "LARGE")).alias("no_member"),
        F.col("size").between(10, 20).alias("in_range"), F.col("name").startswith("red ").alias("prefix"),
        F.col("name").endswith("ring").alias("suffix"), F.col("name").contains("o").alias("inside"),
        (F.length("name") > 9).alias("long"), yes_no(F.col("size") > 25).alias("label"),
    ).where("eq or member or in_range")


def import_diff(spark, sf_dir):
    after = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    before = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"))
    return ops.difference(after, before, "key")


def whitelist_parameters(spark, sf_dir):
    rows = _objects(spark, sf_dir).select("ord", F.when(F.col("size") % 2 == 0, F.col("size")).alias("size"), "type")
    made = rows.select("ord", ops.whitelist(["size", "type"]).alias("m"))
    return made.select("ord", F.size("m").cast("long").alias("n"), F.try_element_at("m", F.lit("size")).alias("size"), F.try_element_at("m", F.lit("type")).alias("type"))


def graph_connections(spark, sf_dir):
    """Suppliers as nodes with their image and its colour space, the types of the parts they ship as targets, in order of the
    first line that ships one."""
    image = F.concat(F.lit("map_"), F.get(F.array(F.lit("diffuse"), F.lit("rough"), F.lit("Albedo")), (F.col("s_suppkey") % 3).cast("int")), F.lit(".png"))
    suppliers = _read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("node"), image.alias("image"))
    nodes = suppliers.select("node", "image", colour_space(map_type(F.col("image"))).alias("colorspace"))
    parts = _read(spark, sf_dir, "part").select("p_partkey", "p_type")
    used = _read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"))
    links = (
        used.join(suppliers, used.l_suppkey == suppliers.s_suppkey).join(parts, used.l_partkey == parts.p_partkey)
        .groupBy(F.col("node").alias("from_node"), F.col("l_returnflag").alias("from_socket"), F.col("p_type").alias("to_node"))
        .agg(F.min(F.struct("ord", "p_partkey")).alias("o")).select("from_node", "from_socket", "to_node", F.lit("in").alias("to_socket"), "o.ord")
    )
    made = connections(nodes, links)
    return made.select("node", "image", "colorspace", F.concat_ws("; ", "connections").alias("connections"), F.size("connections").cast("long").alias("n"))


def catalogue_files(spark, sf_dir):
    """The catalogue as a client gets it: JSON that was landed, read with a declared schema. A missing count is told from one
    that is null, and a map of assets is read as rows."""
    downloads = F.when(F.col("size") % 3 != 0, F.col("size") * 10)
    asset = F.to_json(F.struct(F.col("name"), F.when(F.col("size") % 2 == 0, F.array("type", "material")).alias("categories"), downloads.alias("download_count")))
    null_count = F.regexp_replace(asset, "\\}$", ',"note":null}')
    path = landed_json(_objects(spark, sf_dir).select(F.lit("assets").alias("kind"), F.col("ord"), null_count.alias("raw")), "catalogue")
    read = json_records(spark, path, "kind STRING, ord BIGINT, raw STRING")
    one = read.select("ord", "raw", F.from_json("raw", ASSETS.replace("ord BIGINT, ", "")).alias("a"))
    return one.select(
        "ord", "a.name", F.coalesce(F.col("a.download_count").cast("string"), F.lit("Unknown")).alias("downloads"), F.concat_ws(", ", "a.categories").alias("categories"),
        json_default(F.col("raw"), "note", "no key").alias("note"), json_default(F.col("raw"), "author", "no key").alias("author"),
    )


def category_map(spark, sf_dir):
    """Category counts that come as one JSON object, as rows with their place in it."""
    counts = _objects(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", F.struct("n")))))
    path = landed_json(counts.agg(entries.alias("categories")), "categories")  # as many keys as there are types
    return map_rows(json_records(spark, path, "categories MAP<STRING, STRUCT<n: BIGINT>>"), "categories", "category").select("category", "n", F.row_number().over(Window.orderBy("category")).cast("long").alias("place"))


QUERIES = {f.__name__: f for f in (
    scene_summary, catalog_truncate_then_sort, catalog_report, category_counts_sorted, object_lookup, conditional_struct,
    type_label, fit_to_max_size, filters_members, import_diff, whitelist_parameters, graph_connections, object_info, json_report,
    fixed_format, search_page, catalogue_files, category_map,
)}



def exact_round_sql(x: str, digits: int) -> str:
    """Rounding of the exact binary value, as SQL: the decimal text of a double with many digits is exact, and so are decimals."""
    m = 10**digits
    a = f"abs(CAST({x} AS DOUBLE))"
    up = f"CAST(printf('%.22f', {a}) AS DECIMAL(38, 22)) * {m}"
    low = f"floor({a} * {m})"
    whole = f"CAST(floor({up}) AS DOUBLE)"
    rest = f"({up} - floor({up}))"
    odd = f"({whole} % 2)"
    made = f"({whole} + CASE WHEN {rest} > 0.5 OR ({rest} = 0.5 AND {odd} = 1) THEN 1 ELSE 0 END) / {m}.0::DOUBLE"
    return f"CASE WHEN {x} IS NULL OR {low} IS NULL THEN NULL WHEN {x} < 0 THEN -({made}) ELSE {made} END"


_CAPPED = """
WITH capped AS (SELECT p_partkey AS ord, p_name AS name FROM part ORDER BY p_partkey LIMIT 20),
d AS (SELECT l_partkey AS ord, count(*) AS download_count FROM lineitem GROUP BY 1),
ranked AS (
  SELECT c.ord, name, download_count, row_number() OVER (ORDER BY coalesce(download_count, 0) DESC, c.ord) AS rank
  FROM capped c LEFT JOIN d ON c.ord = d.ord)
"""

ORACLES = {
    "scene_summary": f"""
SELECT p_partkey AS ord, p_name AS name, p_type AS type, {exact_round_sql("p_retailprice / 7.0", 2)} AS x, {exact_round_sql("p_size / 8.0", 2)} AS y,
  CAST(2.67 AS DOUBLE) AS z, (SELECT count(*) FROM part) AS object_count, (SELECT count(DISTINCT p_brand) FROM part) AS materials_count
FROM part ORDER BY p_partkey LIMIT 10""",
    "object_info": """
SELECT vec_id AS ord, 'object ' || vec_id AS name, CASE WHEN label % 2 = 0 THEN 'MESH' ELSE 'LIGHT' END AS type, """ + ", ".join(
        f"CAST(embedding[{3 * k + i + 1}] AS DOUBLE) * 100 AS {c}_{a}" for k, c in enumerate(("location", "rotation", "scale")) for i, a in enumerate("xyz")
    ) + """, label % 3 <> 0 AS visible, CASE WHEN label % 2 = 0 THEN vec_id * 8 END AS vertices, CASE WHEN label % 2 = 0 THEN vec_id * 12 END AS edges FROM embeddings""",
    "json_report": """
SELECT p_partkey AS ord, '{"ord":' || p_partkey || ',"name":"' || p_name || '","type":' || CASE WHEN p_size % 2 = 0 THEN '"' || p_type || '"' ELSE 'null' END ||
  ',"size":' || p_size || '}' AS report FROM part""",
    "fixed_format": """
SELECT p_partkey AS ord, printf('%.3f', p_retailprice / 7.0::DOUBLE) AS three, printf('%.6f', p_retailprice / 7.0::DOUBLE / 100.0::DOUBLE) AS six,
  lpad(CAST(p_size AS VARCHAR), 4, '0') AS number FROM part""",
    "search_page": """
WITH p AS (SELECT * FROM part WHERE contains(p_name, 'o') ORDER BY p_partkey LIMIT 24)
SELECT p_partkey AS ord, p_name AS name, (SELECT count(*) FROM p) AS found FROM p WHERE p_size % 5 <> 0""",
    "catalogue_files": """
SELECT p_partkey AS ord, p_name AS name, CASE WHEN p_size % 3 <> 0 THEN CAST(p_size * 10 AS VARCHAR) ELSE 'Unknown' END AS downloads,
  CASE WHEN p_size % 2 = 0 THEN p_type || ', ' || p_brand ELSE '' END AS categories, CAST(NULL AS VARCHAR) AS note, 'no key' AS author FROM part""",
    "category_map": """
SELECT type AS category, n, row_number() OVER (ORDER BY type) AS place FROM (SELECT p_type AS type, count(*) AS n FROM part GROUP BY 1)""",
    "catalog_truncate_then_sort": _CAPPED + """
SELECT ord, name, download_count, CAST(rank AS INTEGER) AS rank, (SELECT count(*) FROM part) AS total_count,
  CAST(least((SELECT count(*) FROM part), 20) AS BIGINT) AS returned_count FROM ranked""",
    "catalog_report": _CAPPED + """
SELECT 'Found ' || (SELECT count(*) FROM part) || ' assets' || chr(10) || 'Showing ' || least((SELECT count(*) FROM part), 20) || ' assets:' || chr(10) || chr(10) ||
  string_agg('- ' || name || ' (ID: ' || ord || ')' || chr(10) || '  Type: ' || CASE p_size % 3 WHEN 0 THEN 'HDRI' WHEN 1 THEN 'Texture' ELSE 'Model' END || chr(10) ||
  '  Categories: ' || p_type || chr(10) || '  Downloads: ' || coalesce(CAST(download_count AS VARCHAR), 'Unknown') || chr(10), chr(10) ORDER BY rank) AS report
FROM ranked JOIN part ON p_partkey = ord""",
    "category_counts_sorted": """
SELECT type, n, CAST(row_number() OVER (ORDER BY n DESC, type) AS INTEGER) AS rank
FROM (SELECT p_type AS type, count(*) AS n FROM part GROUP BY 1)""",
    "object_lookup": """
WITH names AS (SELECT DISTINCT (['red', 'small', 'blue', 'large'])[event_id % 4 + 1] || ' ' || (['widget', 'ring', 'bolt', 'nothing'])[user_id % 4 + 1] AS name FROM events),
item AS (SELECT p_name AS name, min(p_partkey) AS ord FROM part GROUP BY 1)
SELECT n.name, i.ord IS NOT NULL AS found, i.ord, p.p_type AS type, p.p_retailprice AS x
FROM names n LEFT JOIN item i ON n.name = i.name LEFT JOIN part p ON p.p_partkey = i.ord""",
    "conditional_struct": """
SELECT p_partkey AS ord, p_name AS name, p_type AS type,
  CASE WHEN p_type = 'PROMO' THEN CAST(p_size * 2 AS BIGINT) END AS vertices,
  CASE WHEN p_type = 'PROMO' THEN CAST(p_size AS BIGINT) END AS edges FROM part""",
    "type_label": """
SELECT p_partkey AS ord, CASE p_size % 4 WHEN 0 THEN 'HDRI' WHEN 1 THEN 'Texture' WHEN 2 THEN 'Model' END AS label,
  CASE p_size % 4 WHEN 1 THEN 'HDRI' WHEN 2 THEN 'Texture' WHEN 3 THEN 'Model' END AS label_before FROM part""",
    "fit_to_max_size": """
SELECT ord, CASE WHEN greatest(w, h) > 800 THEN CAST(trunc(w * (800.0::DOUBLE / greatest(w, h))) AS INTEGER) ELSE w END AS width,
  CASE WHEN greatest(w, h) > 800 THEN CAST(trunc(h * (800.0::DOUBLE / greatest(w, h))) AS INTEGER) ELSE h END AS height
FROM (SELECT p_partkey AS ord, p_size * 40 AS w, CAST(trunc(p_retailprice) AS INTEGER) AS h FROM part)""",
    "filters_members": """
SELECT * FROM (SELECT p_partkey AS ord, p_type = 'PROMO' AS eq, p_type IN ('SMALL', 'LARGE') AS member,
  p_type NOT IN ('SMALL', 'LARGE') AS no_member, p_size BETWEEN 10 AND 20 AS in_range, starts_with(p_name, 'red ') AS prefix,
  ends_with(p_name, 'ring') AS suffix, contains(p_name, 'o') AS inside, length(p_name) > 9 AS long,
  CASE WHEN p_size > 25 THEN 'Yes' ELSE 'No' END AS label FROM part) WHERE eq OR member OR in_range""",
    "import_diff": "SELECT o_orderkey AS key FROM orders EXCEPT SELECT l_orderkey FROM lineitem",
    "whitelist_parameters": """
SELECT p_partkey AS ord, CAST(1 + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n,
  CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) END AS size, p_type AS type FROM part""",
    "graph_connections": """
WITH n AS (SELECT s_suppkey, s_name AS node, 'map_' || (['diffuse', 'rough', 'Albedo'])[s_suppkey % 3 + 1] || '.png' AS image FROM supplier),
l AS (SELECT node, l_returnflag || ' → ' || p_type || '.in' AS c, min(l_orderkey * 100 + l_linenumber) AS ord
  FROM lineitem JOIN n ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT n.node, image, CASE WHEN contains(image, 'rough') THEN 'Non-Color' ELSE 'sRGB' END AS colorspace,
  coalesce(string_agg(c, '; ' ORDER BY ord, c), '') AS connections, count(c) AS n
FROM n LEFT JOIN l ON n.node = l.node GROUP BY ALL""",
}
