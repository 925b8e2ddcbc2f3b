"""CSV with encoding fallback and tables with leading rows to skip."""

from __future__ import annotations

import csv
import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import header_name, renamed


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """Files whose every line decodes as UTF-8 are read so, the others as Latin-1 (which accepts any byte).

    The encoding is chosen per file; only the names of the Latin-1 files come to the driver. Files of one folder have the same columns, in any order, or lack some.
    """
    lines = spark.read.text(path)
    bad = lines.where(~F.is_valid_utf8("value")).select(F.col("_metadata.file_path").alias("f")).distinct()
    latin = {_plain(r["f"]) for r in bad.collect()}
    files = [_plain(f) for f in lines.inputFiles()]
    reader = spark.read.options(**{"header": True, **options})
    parts = []
    for encoding, wanted in (("UTF-8", False), ("ISO-8859-1", True)):
        some = [f for f in files if (f in latin) == wanted]
        if some:
            parts.append(reader.option("encoding", encoding).csv(path if len(some) == len(files) else some))
    if not parts:
        return reader.csv(path)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def _plain(file: str) -> str:
    """A file name without the escapes and repeated slashes in which Spark's spellings of it differ."""
    return re.sub("^([a-z0-9]+:)/+", r"\1/", unquote(file)) if file.startswith("file:") else unquote(file)


def decoded_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, file, start, at``: lines with their file, the first byte of their block, and a rising number inside it.

    A file with a line that is no UTF-8 is read as Latin-1 as a whole; only the names of such files come to the driver.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
    )
    latin = [r["file"] for r in lines.where(~F.is_valid_utf8("value")).select("file").distinct().collect()]
    if not latin:
        return lines
    old = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    return lines.withColumn("value", F.when(F.col("file").isin(latin), old).otherwise(F.col("value")))


def records(lines: DataFrame) -> DataFrame:
    """``lines`` of :func:`decoded_lines` with the lines of a quoted line break put together again.

    A line starts a record if an even number of quotes comes before it in its file. Without a line of an odd
    number of quotes every line is a record and nothing is shuffled. Otherwise quotes are counted per block of a
    file, so a line is placed by its block and the blocks before it; blocks, not files, are the tasks. Only the
    lines of broken records go through a second shuffle.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = (quotes % 2 == 1).cast("int")
    if lines.where(odd == 1).isEmpty():
        return lines
    lines = lines.withColumn("_odd", odd)
    block = Window.partitionBy("file", "start").orderBy("at")
    # one row per block of a file
    blocks = lines.groupBy("file", "start").agg(F.sum("_odd").alias("_n"))
    carry = blocks.select(
        "file", "start", (F.sum("_n").over(Window.partitionBy("file").orderBy("start")) - F.col("_n")).alias("_carry")
    )
    counted = lines.withColumn("_inside", F.sum("_odd").over(block) - F.col("_odd")).join(carry, ["file", "start"])
    before = F.col("_carry") + F.col("_inside")
    # odd lines open and close broken records in turn: the number of the pair names the record
    counted = counted.withColumns({"_pair": F.floor(before / 2), "_broken": (before % 2 == 1) | (F.col("_odd") == 1)})
    whole = counted.where(~F.col("_broken")).select(*lines.columns)
    parts = F.array_sort(F.collect_list(F.struct("start", "at", "value")))
    joined = counted.where("_broken").groupBy("file", "_pair").agg(parts.alias("_parts")).select(
        F.array_join(F.transform("_parts", lambda e: e["value"]), "\n").alias("value"), "file",
        F.col("_parts")[0]["start"].alias("start"), F.col("_parts")[0]["at"].alias("at"), F.lit(0).alias("_odd"),
    )
    return whole.unionByName(joined).drop("_odd")


def read_mapped(spark: SparkSession, path: str, table: dict, sep: str = ",") -> DataFrame | None:
    """CSV with ``table['skip']`` leading lines, renamed by ``table['columns']``.

    ``path`` is a file, or a folder whose first file starts with the leading lines. None if
    an expected column is absent. Only the leading lines and the header come to the driver;
    the rest of the scan keeps its parallelism. Files are UTF-8 or Latin-1, each as a whole; fields in quotes may hold
    line breaks (read as \\n) and doubled quotes. The leading lines and the header are one line each.
    A quote that is never closed takes the rest of its file into one record.
    """
    lines = decoded_lines(spark, path)
    head = lines.where("start = 0").orderBy("file", "at").limit(table["skip"] + 1).collect()
    if len(head) <= table["skip"]:
        return None
    header = head[-1]
    names = [header_name(n) for n in next(csv.reader([header["value"]], delimiter=sep))]
    wanted = {header_name(k): v for k, v in table["columns"].items()}
    if any(n not in names for n in wanted):
        return None
    leading = (F.col("file") == header["file"]) & (F.col("start") == 0) & (F.col("at") <= header["at"])
    schema = ", ".join(f"`{n or f'c{i}'}` string" for i, n in enumerate(names))
    parsed = records(lines.where(~leading)).where(F.length(F.trim("value")) > 0).select(
        F.from_csv("value", schema, {"sep": sep, "escape": '"', "multiLine": "true"}).alias("r")
    )
    return renamed(parsed.select("r.*"), wanted)
