"""Box, hierarchy and import queries. ``embeddings`` stands in for corners and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import percent_of_max_json
from ..operators import geometry as geo


def _vectors(spark, sf_dir) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return v.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _boxes(spark, sf_dir) -> DataFrame:
    v = _vectors(spark, sf_dir).withColumn("corners", geo.flat_corners(F.col("v")))
    return v.select("vec_id", "label", *(c.alias(k) for k, c in geo.corners_box(F.col("corners")).items()))


def object_aabb(spark, sf_dir):
    return _boxes(spark, sf_dir)


def object_world_box(spark, sf_dir):
    """Corners under a matrix that scales by 2 and moves by the label; only even labels are of type MESH."""
    v = _vectors(spark, sf_dir)
    at = F.col("label").cast("double")
    row = lambda i: F.array(*(F.lit(2.0) if j == i else F.lit(0.0) for j in range(3)), at)
    objects = v.select(
        F.col("vec_id").alias("ord"), F.col("label").cast("string").alias("name"), F.when(F.col("label") % 2 == 0, "MESH").otherwise("LIGHT").alias("type"),
        geo.flat_corners(F.col("v")).alias("bound_box"), F.array(row(0), row(1), row(2), F.array(*(F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)))).alias("matrix_world"),
    )
    return geo.object_box(objects)


def combined_aabb_normalise(spark, sf_dir):
    box = geo.dimensions(geo.combined_box(_boxes(spark, sf_dir), "label"))
    return box.withColumn("factor", geo.normalise_factor(F.col("largest"), 1.0))


def bbox_ratio(spark, sf_dir):
    """Sides as percentages of the longest, from the JSON they come in; whole numbers only are passed on as they are."""
    v = _vectors(spark, sf_dir).withColumn("label", F.col("label").cast("int"))
    whole = F.transform("v", lambda x: F.floor(x * 100).cast("string"))
    parts = F.transform("v", lambda x: F.concat((F.floor(F.abs(x) * 1000) + F.when(F.col("vec_id") % 5 == 0, 0).otherwise(1)).cast("string"), F.lit(".0")))
    raw = F.concat(F.lit("["), F.concat_ws(",", F.when(F.col("label") % 2 == 0, whole).otherwise(parts)), F.lit("]"))
    r = v.select("vec_id", percent_of_max_json(raw).alias("r"))
    return r.select("vec_id", F.size("r").cast("long").alias("n"), F.array_max("r").alias("most"), F.array_min("r").alias("least"), F.aggregate("r", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


def _tree(spark, sf_dir) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    pad = lambda p, c: F.concat(F.lit(p), F.lpad(F.col(c).cast("string"), 9, "0"))
    return (
        read("region").select(pad("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"))
        .union(read("nation").select(pad("n", "n_nationkey"), pad("r", "n_regionkey")))
        .union(read("supplier").select(pad("s", "s_suppkey"), pad("n", "s_nationkey")))
    )


def hierarchy_descendants(spark, sf_dir):
    return geo.descendants(_tree(spark, sf_dir)).withColumn("path", F.concat_ws("/", "path"))


def hierarchy_roots(spark, sf_dir):
    return geo.roots(_tree(spark, sf_dir)).select("id")


def _scene(spark, sf_dir):
    """Nations as roots that are no meshes, suppliers below them, customers below suppliers; an import is a region."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    pad = lambda p, c: F.concat(F.lit(p), F.lpad(c.cast("string"), 9, "0"))
    n, s, c = read("nation"), read("supplier"), read("customer")
    first = s.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("above"))
    below = c.join(first, "c_nationkey")
    kind = lambda x: F.when(x % 3 == 0, "EMPTY").otherwise("MESH")
    nodes = (
        n.select(pad("n", F.col("n_nationkey")).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit("EMPTY").alias("type"))
        .union(s.select(pad("s", F.col("s_suppkey")), pad("n", F.col("s_nationkey")), kind(F.col("s_suppkey"))))
        .union(below.select(pad("c", F.col("c_custkey")), pad("s", F.col("above")), kind(F.col("c_custkey"))))
    )
    box = lambda key, id_, x: [id_.alias("id"), *((x / d + (key % m)).alias(f"min_{a}") for a, d, m in _SIDES), *((x / d + (key % m) + key % 7).alias(f"max_{a}") for a, d, m in _SIDES)]
    boxes = s.select(*box(F.col("s_suppkey"), pad("s", F.col("s_suppkey")), F.col("s_acctbal"))).union(c.select(*box(F.col("c_custkey"), pad("c", F.col("c_custkey")), F.col("c_acctbal"))))
    roots = n.select(pad("n", F.col("n_nationkey")).alias("root"), F.col("n_regionkey").alias("import_id"), *(F.col("n_nationkey").cast("double").alias(f"at_{a}") for a in "xyz"))
    return nodes, boxes, roots


# Divisor and modulus by axis, for made-up boxes.
_SIDES = (("x", 64.0, 17), ("y", 128.0, 13), ("z", 256.0, 11))


def mesh_descendants(spark, sf_dir):
    """The meshes below each root, in pre-order."""
    nodes, _, _ = _scene(spark, sf_dir)
    return geo.mesh_descendants(nodes).select("root", "id", F.concat_ws("/", "path").alias("path"))


def import_normalised(spark, sf_dir):
    """Each import's box over all its meshes, the factor that makes its longest side 10, and the box after its roots are scaled."""
    nodes, boxes, roots = _scene(spark, sf_dir)
    meshes = geo.mesh_descendants(nodes).join(boxes, "id").join(roots.select("root", "import_id"), "root")
    return geo.normalise_import(meshes, roots.drop("import_id"), "import_id", 10.0)


def import_box_all(spark, sf_dir):
    """The box around all meshes, and around none of them: one row of nulls."""
    nodes, boxes, _ = _scene(spark, sf_dir)
    meshes = geo.mesh_descendants(nodes).join(boxes, "id")
    one = geo.import_box(meshes, None).withColumn("what", F.lit("all"))
    return one.union(geo.import_box(meshes.where("id = 'none'"), None).withColumn("what", F.lit("none")))


def import_cleanup(spark, sf_dir):
    """What to keep of each import: an order's first lines as its objects."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(F.col("l_linenumber") <= 1 + F.col("l_orderkey") % 3)
    empty = (F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 4 != 0)
    rows = lines.select(
        F.col("l_orderkey").alias("import_id"), F.concat(F.lit("o"), F.col("l_linenumber")).alias("name"), F.when(empty, "EMPTY").otherwise("MESH").alias("type"),
        F.when((F.col("l_linenumber") == 2) & (F.col("l_orderkey") % 5 != 0), "o1").alias("parent"),
    ).dropDuplicates(["import_id", "name"])
    return geo.cleanup_decision(rows, "import_id")


def aabb_overlap(spark, sf_dir):
    """Extension: pairs of boxes that overlap; customers' balances and keys place them."""
    c, key = spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_custkey")
    low = {"x": F.col("c_acctbal"), "y": (key % 1009).cast("double"), "z": (key % 613).cast("double")}
    boxes = c.select(key.alias("box"), *(x.alias(f"min_{a}") for a, x in low.items()), *((x + 2 + key % 5 * 8).alias(f"max_{a}") for a, x in low.items()))
    return geo.overlapping(boxes, "box")


QUERIES = {f.__name__: f for f in (
    object_aabb, object_world_box, combined_aabb_normalise, bbox_ratio, hierarchy_descendants, hierarchy_roots, mesh_descendants,
    import_normalised, import_box_all, import_cleanup, aabb_overlap,
)}


def _axis(i: int, f: str, scaled: bool = False) -> str:
    x = f"CAST(embedding[1 + 3 * k + {i}] AS DOUBLE)"
    if scaled:
        x = f"({x} * 2.0 + label)"
    return f"list_{f}(list_transform(range(21), lambda k: {x}))"


_BOX = ", ".join(f"{_axis(i, f)} AS {f}_{a}" for i, a in enumerate("xyz") for f in ("min", "max"))
_WORLD = ", ".join(f"CASE WHEN label % 2 = 0 THEN {_axis(i, f, True)} END AS {f}_{a}" for i, a in enumerate("xyz") for f in ("min", "max"))
_ALL = ", ".join(f"{f}({f}_{a}) AS {f}_{a}" for a in "xyz" for f in ("min", "max"))
_COMBINED = f"box AS (SELECT label, {_ALL} FROM (SELECT label, {_BOX} FROM embeddings) GROUP BY label)"
_MEET = " AND ".join(f"a.min_{x} <= b.max_{x} AND b.min_{x} <= a.max_{x}" for x in "xyz")
_NODES = """
nodes AS (
  SELECT 'r' || lpad(CAST(r_regionkey AS VARCHAR), 9, '0') AS id, CAST(NULL AS VARCHAR) AS parent_id FROM region
  UNION ALL SELECT 'n' || lpad(CAST(n_nationkey AS VARCHAR), 9, '0'), 'r' || lpad(CAST(n_regionkey AS VARCHAR), 9, '0') FROM nation
  UNION ALL SELECT 's' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), 'n' || lpad(CAST(s_nationkey AS VARCHAR), 9, '0') FROM supplier)
"""

_KIND = "CASE WHEN {0} % 3 = 0 THEN 'EMPTY' ELSE 'MESH' END"
_MADE = ", ".join(f"{{1}} / {d}::DOUBLE + {{0}} % {m}{extra} AS {side}_{a}" for side, extra in (("min", ""), ("max", " + {0} % 7")) for a, d, m in _SIDES)
_SCENE = f"""RECURSIVE up AS (SELECT s_nationkey, min(s_suppkey) AS above FROM supplier GROUP BY 1),
nodes AS (
  SELECT 'n' || lpad(CAST(n_nationkey AS VARCHAR), 9, '0') AS id, CAST(NULL AS VARCHAR) AS parent_id, 'EMPTY' AS type FROM nation
  UNION ALL SELECT 's' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), 'n' || lpad(CAST(s_nationkey AS VARCHAR), 9, '0'), {_KIND.format("s_suppkey")} FROM supplier
  UNION ALL SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 's' || lpad(CAST(above AS VARCHAR), 9, '0'), {_KIND.format("c_custkey")} FROM customer JOIN up ON c_nationkey = s_nationkey),
boxes AS (SELECT 's' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS id, {_MADE.format("s_suppkey", "s_acctbal")} FROM supplier
  UNION ALL SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), 9, '0'), {_MADE.format("c_custkey", "c_acctbal")} FROM customer),
tree AS (
  SELECT id AS root, id, id AS path, type FROM nodes WHERE parent_id IS NULL
  UNION ALL SELECT t.root, n.id, t.path || '/' || n.id, n.type FROM tree t JOIN nodes n ON n.parent_id = t.id)"""

ORACLES = {
    "object_aabb": f"SELECT vec_id, label, {_BOX} FROM embeddings",
    "object_world_box": f"""
SELECT vec_id AS ord, CAST(label AS VARCHAR) AS name, CASE WHEN label % 2 = 0 THEN 'MESH' ELSE 'LIGHT' END AS type, {_WORLD} FROM embeddings""",
    "combined_aabb_normalise": f"""
WITH {_COMBINED}, d AS (SELECT *, max_x - min_x AS dim_x, max_y - min_y AS dim_y, max_z - min_z AS dim_z FROM box),
g AS (SELECT *, greatest(dim_x, dim_y, dim_z) AS largest FROM d)
SELECT *, CASE WHEN largest > 0 THEN 1.0::DOUBLE / largest ELSE 1.0::DOUBLE END AS factor FROM g""",
    "bbox_ratio": """
WITH v AS (SELECT vec_id, label % 2 = 0 AS whole, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
b AS (SELECT vec_id, whole, list_transform(v, lambda x: CASE WHEN whole THEN floor(x * 100) ELSE floor(abs(x) * 1000) + CASE WHEN vec_id % 5 = 0 THEN 0 ELSE 1 END END) AS b FROM v),
r AS (SELECT vec_id, CASE WHEN whole THEN list_transform(b, lambda x: CAST(x AS INTEGER)) WHEN list_min(b) <= 0 THEN NULL
  ELSE list_transform(b, lambda x: CAST(trunc(x / list_max(b) * 100) AS INTEGER)) END AS r FROM b)
SELECT vec_id, CAST(len(r) AS BIGINT) AS n, list_max(r) AS most, list_min(r) AS least, CAST(list_sum(r) AS BIGINT) AS total FROM r""",
    "hierarchy_descendants": f"""
WITH RECURSIVE {_NODES}, tree AS (
  SELECT id AS root, id, 0 AS depth, id AS path FROM nodes WHERE parent_id IS NULL
  UNION ALL SELECT t.root, n.id, t.depth + 1, t.path || '/' || n.id FROM tree t JOIN nodes n ON n.parent_id = t.id)
SELECT * FROM tree""",
    "hierarchy_roots": f"WITH {_NODES} SELECT id FROM nodes WHERE parent_id IS NULL",
    "mesh_descendants": f"""
WITH {_SCENE} SELECT root, id, path FROM tree WHERE type = 'MESH'""",
    "import_normalised": f"""
WITH {_SCENE}, m AS (SELECT t.root, n_regionkey AS import_id, CAST(n_nationkey AS DOUBLE) AS place, b.* FROM tree t JOIN boxes b ON t.id = b.id
  JOIN nation ON t.root = 'n' || lpad(CAST(n_nationkey AS VARCHAR), 9, '0') WHERE type = 'MESH'),
a AS (SELECT import_id, {_ALL} FROM m GROUP BY 1),
d AS (SELECT *, max_x - min_x AS dim_x, max_y - min_y AS dim_y, max_z - min_z AS dim_z FROM a), g AS (SELECT *, greatest(dim_x, dim_y, dim_z) AS largest FROM d),
f AS (SELECT *, CASE WHEN largest > 0 THEN 10.0::DOUBLE / largest ELSE 1.0::DOUBLE END AS factor FROM g),
n AS (SELECT m.import_id, {", ".join(f"{k}(place + factor * (m.{k}_{x} - place)) AS new_{k}_{x}" for x in "xyz" for k in ("min", "max"))} FROM m JOIN f ON m.import_id = f.import_id GROUP BY 1)
SELECT f.*, n.* EXCLUDE (import_id) FROM f JOIN n ON f.import_id = n.import_id""",
    "import_box_all": f"""
WITH {_SCENE}, m AS (SELECT b.* FROM tree t JOIN boxes b ON t.id = b.id WHERE type = 'MESH')
SELECT {_ALL}, 'all' AS what FROM m UNION ALL SELECT {_ALL}, 'none' FROM m WHERE id = 'none'""",
    "import_cleanup": """
WITH o AS (SELECT DISTINCT l_orderkey AS import_id, l_linenumber AS k FROM lineitem WHERE l_linenumber <= 1 + l_orderkey % 3),
t AS (SELECT import_id, k, CASE WHEN k = 1 AND import_id % 4 <> 0 THEN 'EMPTY' ELSE 'MESH' END AS type, CASE WHEN k = 2 AND import_id % 5 <> 0 THEN 1 END AS parent FROM o),
c AS (SELECT import_id, count(*) AS n, count(*) FILTER (type = 'MESH') AS meshes, max(k) FILTER (type = 'MESH') AS mesh, max(parent) FILTER (type = 'MESH') AS above,
  max(k) FILTER (type = 'EMPTY' AND parent IS NULL) AS empty FROM t GROUP BY 1),
d AS (SELECT *, CASE WHEN n = 1 AND meshes = 1 THEN 'keep' WHEN n = 2 AND meshes = 1 AND above = empty THEN 'unparent' ELSE 'error' END AS action FROM c)
SELECT import_id, action, CASE WHEN action <> 'error' THEN 'o' || mesh END AS kept, CASE WHEN action = 'unparent' THEN 'o' || empty END AS dropped FROM d""",
    "aabb_overlap": f"""
WITH l AS (SELECT c_custkey AS box, c_acctbal AS min_x, CAST(c_custkey % 1009 AS DOUBLE) AS min_y, CAST(c_custkey % 613 AS DOUBLE) AS min_z, 2 + c_custkey % 5 * 8 AS side FROM customer),
box AS (SELECT *, min_x + side AS max_x, min_y + side AS max_y, min_z + side AS max_z FROM l)
SELECT a.box AS box_a, b.box AS box_b FROM box a JOIN box b ON a.box < b.box AND {_MEET}""",
}
