"""File sources: JSON records with an explicit schema, binary files, archives, reports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import inside
from .shared import new_folder


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; no pass over the data to infer one. A broken line is a row of nulls."""
    return spark.read.schema(schema).json(path)


def landed_json(df: DataFrame, name: str) -> str:
    """The frame as JSON lines in a new folder that all executors share; gives the path. Null fields are left out."""
    path = new_folder(df.sparkSession, name)
    df.write.json(path)
    return path


def map_rows(df: DataFrame, column: str, key: str) -> DataFrame:
    """A map column as rows, with ``ord`` for the place in the map."""
    return df.select(F.posexplode(F.map_entries(column)).alias("ord", "e")).select(F.col("ord").cast("long"), F.col("e.key").alias(key), "e.value.*")


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of the files of a folder, and of those below it, whose name fits."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def archive_entries(files: DataFrame, root: str = "/extract", extract: bool = False) -> DataFrame:
    """(path, entry, size, error, safe) of each entry of each ZIP file; ``safe`` says that it stays below the target folder.
    With ``extract`` also ``data``, the bytes of each safe entry. A file that is no ZIP archive, or a broken entry, gives a row
    with an error. One entry is held at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                row = lambda *values: pd.DataFrame([(path, *values)], columns=["path", "entry", "size", "error", "data"])
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except (zipfile.BadZipFile, ValueError, OSError) as e:
                    yield row(None, None, f"not an archive: {type(e).__name__}", None)
                    continue
                with archive:
                    for i in archive.infolist():
                        data = error = None
                        if extract:
                            try:
                                data = archive.read(i)
                            except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError, RuntimeError, EOFError) as e:
                                error = f"broken entry: {type(e).__name__}"
                        yield row(i.filename, i.file_size, error, data)

    listed = files.select("path", "content").mapInPandas(run, "path string, entry string, size long, error string, data binary")
    made = listed.withColumn("safe", inside(root, F.col("entry")))
    return made.withColumn("data", F.when(F.col("safe"), F.col("data"))) if extract else made.drop("data")


def report(df: DataFrame, order: str, line: str) -> DataFrame:
    """One row with a line for each row of a capped frame, in order. Only for results whose size is capped."""
    return df.agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda s: s[line])).alias("report"))


def json_report(*columns: Column | str) -> Column:
    """A JSON object of the named columns, in their order; nulls are written."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
