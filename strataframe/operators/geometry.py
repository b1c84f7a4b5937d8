"""Axis-aligned boxes, normalisation and hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed

AXES = ("x", "y", "z")


def transform_point(matrix: Column, point: Column) -> Column:
    """The point under a 4x4 affine matrix: each of the first three rows times (x, y, z, 1)."""
    p = F.concat(point, F.array(F.lit(1.0)))
    return F.transform(
        F.slice(matrix, 1, 3),
        lambda row: F.aggregate(F.zip_with(row, p, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v),
    )


def corners_box(corners: Column) -> dict[str, Column]:
    """Minimum and maximum of each axis over an array of points."""
    out = {}

    def along(i: int) -> Column:
        return F.transform(corners, lambda c: c[i])

    for i, axis in enumerate(AXES):
        values = along(i)
        out[f"min_{axis}"] = F.array_min(values)
        out[f"max_{axis}"] = F.array_max(values)
    return out


def object_box(objects: DataFrame) -> DataFrame:
    """World box of each object of type MESH from its local corners and its matrix; null for other types."""
    corners = F.transform(F.col("bound_box"), lambda c: transform_point(F.col("matrix_world"), c))
    box = corners_box(corners)
    return objects.select("ord", "name", "type", *(F.when(F.col("type") == "MESH", c).alias(k) for k, c in box.items()))


def flat_corners(values: Column) -> Column:
    """Consecutive triples of an array, as points."""
    n = F.floor(F.size(values) / 3).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(values, i * 3 + 1, 3))


def combined_box(boxes: DataFrame, key: str) -> DataFrame:
    """The box around all boxes of a key; map-side partial minima and maxima, one row a key and task shuffled."""
    return boxes.groupBy(key).agg(
        *(f(f"{name}_{a}").alias(f"{name}_{a}") for a in AXES for name, f in (("min", F.min), ("max", F.max)))
    )


def dimensions(box: DataFrame) -> DataFrame:
    dims = {a: F.col(f"max_{a}") - F.col(f"min_{a}") for a in AXES}
    return box.withColumns({f"dim_{a}": d for a, d in dims.items()}).withColumn("largest", F.greatest(*dims.values()))


def normalise_factor(largest: Column, target: float) -> Column:
    """What a root is scaled by so that the largest dimension becomes ``target``; 1 where there is no extent."""
    return F.when(largest > 0, F.lit(target) / largest).otherwise(F.lit(1.0))


def overlapping(boxes: DataFrame, key: str) -> DataFrame:
    """Extension: pairs (key_a < key_b) of boxes that overlap or touch on every axis. Boxes are dealt to the cells of a grid as
    wide as the widest box, so each is in at most eight; a pair is told in one cell only, that of the low corner of what
    the two share."""
    widest = boxes.agg(*(F.max(F.col(f"max_{a}") - F.col(f"min_{a}")).alias(a) for a in AXES)).first()
    size = max([x for x in widest if x] or [1.0])
    cells = boxes
    for a in AXES:
        at = lambda side, a=a: F.floor(F.col(f"{side}_{a}") / F.lit(size))
        cells = cells.withColumn(f"cell_{a}", F.explode(F.sequence(at("min"), at("max"))))
    one, two = (cells.select(*(F.col(c).alias(f"{c}_{n}") for c in cells.columns)) for n in "ab")
    meet = F.col(f"{key}_a") < F.col(f"{key}_b")
    for a in AXES:
        low = F.greatest(f"min_{a}_a", f"min_{a}_b")
        meet = meet & (F.col(f"cell_{a}_a") == F.col(f"cell_{a}_b")) & (low <= F.least(f"max_{a}_a", f"max_{a}_b")) & (F.floor(low / F.lit(size)) == F.col(f"cell_{a}_a"))
    return one.join(two, meet).select(f"{key}_a", f"{key}_b")


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("parent_id").isNull())


def descendants(nodes: DataFrame) -> DataFrame:
    """(root, id, depth, path) of each node below each root, roots included; ordering by ``path``, an array, is pre-order.

    ``nodes`` has id, parent_id (strings). One join a level, however many there are; each level is written to the shared
    folder before the next. Nodes on a cycle are below no root."""
    level = checkpointed(nodes.where(F.col("parent_id").isNull()).select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"), F.array("id").alias("path")))
    children = nodes.where(F.col("parent_id").isNotNull()).select(F.col("id").alias("child"), F.col("parent_id").alias("above"))
    found = level
    while not level.isEmpty():
        below = level.join(children, F.col("id") == F.col("above"))
        level = checkpointed(below.select("root", F.col("child").alias("id"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("child")).alias("path")))
        found = found.union(level)
    return found


def mesh_descendants(nodes: DataFrame) -> DataFrame:
    """(root, id, path) of the nodes of type MESH at or below each root, in pre-order by ``path``. ``nodes`` has a type."""
    meshes = nodes.where(F.col("type") == "MESH").select("id")
    return descendants(nodes.select("id", "parent_id")).join(meshes, "id").select("root", "id", "path")


def import_box(meshes: DataFrame, key: str | None) -> DataFrame:
    """The box around all meshes of an import; with no key, of all there are, and one row of nulls if there are none."""
    sides = [f(f"{name}_{a}").alias(f"{name}_{a}") for a in AXES for name, f in (("min", F.min), ("max", F.max))]
    return meshes.groupBy(key).agg(*sides) if key else meshes.agg(*sides)


def normalise_import(meshes: DataFrame, roots_: DataFrame, key: str, target: float) -> DataFrame:
    """Per import: the box of its meshes, the factor by which its roots are scaled so that its largest side would be ``target``,
    and the box made anew after that.

    ``meshes`` has key, root and the sides of each mesh's box, ``roots_`` root and its place (at_x, at_y, at_z). A root
    scales what is below it about its own place, which stays; so with several roots the new box isn't the old one
    scaled, and is taken from the scaled meshes."""
    before = dimensions(import_box(meshes, key)).withColumn("factor", normalise_factor(F.col("largest"), target))
    placed = meshes.join(roots_, "root").join(before.select(key, "factor"), key)
    moved = {f"{s}_{a}": F.col(f"at_{a}") + F.col("factor") * (F.col(f"{s}_{a}") - F.col(f"at_{a}")) for a in AXES for s in ("min", "max")}
    after = import_box(placed.withColumns(moved), key)
    new = after.select(key, *(F.col(f"{s}_{a}").alias(f"new_{s}_{a}") for a in AXES for s in ("min", "max")))
    return before.join(new, key)


def cleanup_decision(objects: DataFrame, group: str) -> DataFrame:
    """What to keep of each imported group (columns name, type, parent): the mesh alone, or the mesh below a single
    EMPTY parent, which is dropped; anything else is an error."""
    counted = objects.groupBy(group).agg(
        F.count("*").alias("n"), F.count_if(F.col("type") == "MESH").alias("meshes"),
        F.count_if((F.col("type") == "EMPTY") & F.col("parent").isNull()).alias("empties"),
        F.max(F.when(F.col("type") == "MESH", F.col("name"))).alias("mesh"),
        F.max(F.when(F.col("type") == "MESH", F.col("parent"))).alias("mesh_parent"),
        F.max(F.when(F.col("type") == "EMPTY", F.col("name"))).alias("empty"),
    )
    alone = (F.col("n") == 1) & (F.col("meshes") == 1)
    below = (F.col("n") == 2) & (F.col("meshes") == 1) & (F.col("empties") == 1) & F.coalesce(F.col("mesh_parent") == F.col("empty"), F.lit(False))
    return counted.select(
        group, F.when(alone, "keep").when(below, "unparent").otherwise("error").alias("action"),
        F.when(alone | below, F.col("mesh")).alias("kept"), F.when(below, F.col("empty")).alias("dropped"),
    )
