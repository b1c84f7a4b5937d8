"""Texture maps: which slot, which colour space, which fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of map types, by what they are used for.
COLOUR = ("color", "diffuse", "albedo")
ROUGHNESS = ("roughness", "rough")
METALLIC = ("metallic", "metalness", "metal")
NORMAL_DOWNLOAD = ("normal", "nor")
NORMAL_APPLY = ("normal", "nor", "dx", "gl")
DISPLACEMENT = ("displacement", "disp", "height")


def slot(kind: Column, normal: tuple[str, ...] = NORMAL_APPLY, exact_displacement: bool = False) -> Column:
    """The shader slot of a map type, or null. With ``exact_displacement`` that one test minds upper case."""
    low = F.lower(kind)
    return (
        F.when(low.isin(*COLOUR), "Base Color").when(low.isin(*ROUGHNESS), "Roughness").when(low.isin(*METALLIC), "Metallic")
        .when(low.isin(*normal), "Normal").when((kind if exact_displacement else low).isin(*DISPLACEMENT), "Displacement")
    )


def colour_space(kind: Column, exact: bool = False) -> Column:
    return F.when((kind if exact else F.lower(kind)).isin(*COLOUR), "sRGB").otherwise("Non-Color")


def packed_fallback(maps: DataFrame, key: str, kind: str) -> DataFrame:
    """What a packed map (ambient occlusion, roughness, metallic) stands in for, per key: its second channel only
    without a roughness map, its third only without a metallic one, its first times a base colour at 0.8 only with one.
    Kinds are compared as they are written."""
    has = lambda *names: F.coalesce(F.bool_or(F.col(kind).isin(*names)), F.lit(False))
    flags = maps.groupBy(key).agg(has("arm").alias("arm"), has(*ROUGHNESS).alias("rough"), has(*METALLIC).alias("metal"), has(*COLOUR).alias("colour"), has("ao").alias("ao"))
    return flags.select(
        key, (F.col("arm") & ~F.col("rough")).alias("g_to_roughness"), (F.col("arm") & ~F.col("metal")).alias("b_to_metallic"),
        F.when(F.col("arm") & F.col("colour"), 0.8).alias("r_mix"), F.when(F.col("ao") & F.col("colour"), 0.8).alias("ao_mix"),
    )


def images_of(images: DataFrame, texture_id: str) -> DataFrame:
    """Images whose name starts with the id and an underscore, by map type; the last one of a type wins. Another id
    that extends this one is captured too."""
    from ..functions.strings import map_type
    from .collections import last_wins

    mine = images.where(F.col("name").startswith(texture_id + "_")).select(map_type(F.col("name")).alias("map_type"), "name", "ord")
    return last_wins(mine, "map_type", "name", "ord")


def connections(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Per node its links as ``socket -> node.socket``, in the order of their ``ord``; a node without a link has an empty list.
    All other columns of ``nodes`` stay. A node's links are one row, as the summary asks: it is meant for graphs whose
    nodes have few."""
    text = F.concat(F.col("from_socket"), F.lit(" → "), F.col("to_node"), F.lit("."), F.col("to_socket"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", text.alias("text"))))
    made = links.groupBy(F.col("from_node").alias("node")).agg(F.transform(ordered, lambda x: x["text"]).alias("connections"))
    return nodes.join(made, "node", "left").withColumn("connections", F.coalesce("connections", F.array().cast("array<string>")))


def node_images(nodes: DataFrame, images: DataFrame) -> DataFrame:
    """Each node with the first image of its name."""
    first = images.groupBy(F.col("name").alias("image")).agg(F.min("ord").alias("image_ord"))
    return nodes.join(first, "image")


def last_node_of_type(nodes: DataFrame, images: DataFrame) -> DataFrame:
    """Per map type the last node (by ``ord``) that has an image, with the first image of its name."""
    return node_images(nodes, images).groupBy("map_type").agg(F.max_by(F.struct("node", "image", "image_ord"), "ord").alias("n")).select("map_type", "n.*")


def model_has(files: Column, resolution: Column, fmt: Column) -> Column:
    """The manifest test for models, which asks for two levels only: resolution and format."""
    return F.try_element_at(F.try_element_at(files, resolution), fmt).isNotNull()


def manifest_has(files: Column, map_type: Column, resolution: Column, fmt: Column) -> Column:
    """Whether a nested manifest map_type -> resolution -> format has an entry; a missing level is no error."""
    return F.try_element_at(F.try_element_at(F.try_element_at(files, map_type), resolution), fmt).isNotNull()


# The file format that each kind of asset has unless one is asked for.
DEFAULT_FORMAT = {"hdris": "hdr", "textures": "jpg", "models": "gltf"}


def asset_format(asked: Column, kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in DEFAULT_FORMAT.items() for x in pair))
    return F.coalesce(asked, F.try_element_at(table, kind))
