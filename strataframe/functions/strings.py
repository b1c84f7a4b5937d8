"""Name, path and text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_segment(x: Column, sep: str) -> Column:
    return F.split_part(x, F.lit(sep), F.lit(-1))


def map_type(name: Column) -> Column:
    """The part of an image name behind its last underscore and before the next dot: ``a_nor_gl.jpg`` gives ``gl``."""
    return F.split_part(last_segment(name, "_"), F.lit("."), F.lit(1))


def strip_prefix(x: Column, prefix: str) -> Column:
    return F.when(x.startswith(prefix), F.substring(x, len(prefix) + 1, 1 << 30)).otherwise(x)


def ellipsis(x: Column, n: int) -> Column:
    """At most n characters, with ``...`` behind what was cut."""
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("..."))).otherwise(x)


def non_empty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def first_non_empty(*columns: Column) -> Column:
    """The first that is neither null nor empty, else the empty string."""
    return F.coalesce(*(non_empty(c) for c in columns), F.lit(""))


def truthy(x: Column) -> Column:
    """Whether a setting's text means yes."""
    return F.coalesce(F.lower(x).isin("true", "1", "yes", "on"), F.lit(False))


def is_web_url(x: Column) -> Column:
    return x.rlike("(?i)^https?://")


def yes_no(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit(False)), "Yes").otherwise("No")


def base64_plain(x: Column) -> Column:
    """Base64 on one line; the built-in function breaks lines after 76 characters."""
    return F.translate(F.base64(x), "\r\n", "")


def image_format(content_type: Column, url: Column) -> Column:
    """png if the content type or the address says so, else jpeg. A null type says nothing."""
    png = F.coalesce(content_type.contains("png"), F.lit(False)) | url.endswith(".png")
    return F.when(png, "png").otherwise("jpeg")


def unbase64_text(x: Column) -> Column:
    return F.unbase64(x).cast("string")


def has_host(url: Column) -> Column:
    """Whether an address has a scheme and a host; false for text that is no address, and for null."""
    part = lambda name: F.coalesce(F.length(F.try_parse_url(url, F.lit(name))) > 0, F.lit(False))
    return part("PROTOCOL") & part("HOST")


def padded(x: Column, width: int) -> Column:
    """A whole number with zeros in front."""
    return F.format_string(f"%0{width}d", x)


def suffix(name: Column) -> Column:
    """The last dot of a file name and what is behind it; empty without one, or if the only dot comes first."""
    base = last_segment(name, "/")
    return F.regexp_extract(base, "^.+(\\.[^.]+)$", 1)


def normalised(path: Column) -> Column:
    """An absolute path without ``.``, ``..`` and empty parts; what would climb above the root stays at the root."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda have, p: F.when(p.isin("", "."), have).when(p == "..", F.slice(have, F.lit(1), F.greatest(F.size(have) - 1, F.lit(0)))).otherwise(F.concat(have, F.array(p))),
    )
    return F.when(path.isNotNull(), F.concat(F.lit("/"), F.concat_ws("/", kept)))


def joined(root: Column, path: Column) -> Column:
    """Two paths as one; an absolute second path stands alone."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.rtrim(root, F.lit("/")), F.lit("/"), path))


def inside(root: str, path: Column) -> Column:
    """Whether an archive path, once normalised, stays below the absolute path ``root``: whole parts are compared, so
    neither a sibling with the same prefix passes nor a name with two dots fails. Null for a null path."""
    top = "/" + "/".join(p for p in root.split("/") if p)
    real = normalised(joined(F.lit(top), path))
    return (real == top) | real.startswith(top.rstrip("/") + "/")
