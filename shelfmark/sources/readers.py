"""Each reader gives records (tab, gid, row, cells, ...), one for each sheet row."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: how the format that script JSON names ends.
SCRIPT_VERSION = "-v1"

SCRIPT_SCHEMA = """format string, spreadsheetId string, fetchedAt string,
    tabs array<struct<name:string,gid:string,hiddenTab:boolean,headerRow:int,above:array<array<string>>,headers:array<string>,columns:array<string>,lastColumn:string,
        rows:array<struct<row:int,values:array<string>,raw:map<string,string>,links:map<string,string>,hidden:boolean>>>>,
    errors array<struct<tab:string,message:string>>"""


def parse_csv(text: str | None) -> list[list[str]]:
    """RFC 4180: quoted line ends stay in their cell, CRLF, LF and CR end a record, empty lines are records too, a final line end adds none."""
    text = (text or "").removeprefix("﻿")
    records: list[list[str]] = []
    cells, cell, quoted, i, n = [], [], False, 0, len(text)
    fresh = True  # nothing of the cell has been read
    while i < n:
        c = text[i]
        if quoted:
            if c == '"' and text[i + 1 : i + 2] == '"':
                cell.append('"')
                i += 1
            elif c == '"':
                quoted = False
            else:
                cell.append(c)
        elif c == '"' and fresh:
            quoted, fresh = True, False
        elif c == ",":
            cells.append("".join(cell))
            cell, fresh = [], True
        elif c in "\r\n":
            i += c == "\r" and text[i + 1 : i + 2] == "\n"
            records.append([*cells, "".join(cell)])
            cells, cell, fresh = [], [], True
        else:
            cell.append(c)
            fresh = False
        i += 1
    if cells or cell or quoted or not fresh:
        records.append([*cells, "".join(cell)])
    return records


def csv_records(files: DataFrame) -> DataFrame:
    """Files: (tab, gid, content). A file is one tab, read whole by one task; row is its 1-based place, empty lines counted."""
    parse = F.pandas_udf(lambda s: pd.Series([parse_csv(x) for x in s]), T.ArrayType(T.ArrayType(T.StringType())))
    return files.select("tab", "gid", F.posexplode(parse("content")).alias("at", "cells")).select("tab", "gid", (F.col("at") + 1).alias("row"), "cells")


#: Fixed value: how a web page begins that came in place of data.
_PAGE = "(?i)^\\s*<(?:!doctype|html|head|body)"


def load_tabs(wanted: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, errors): each wanted tab's records, or an error (tab, kind, message) of that tab alone.

    wanted: (tab, gid, path), path being the end of a file's path from a slash on; files: (path, content), as `tab_files` reads
    them. A tab without a file, an empty one and a web page in place of data are errors; the others load. Of several files
    that a path fits the first by name counts.
    """
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    asked, there = wanted.withColumn("name", name(F.col("path"))), files.withColumn("name", name(F.col("path"))).withColumnRenamed("path", "file")
    fits = F.concat(F.lit("/"), "file").endswith(F.concat(F.lit("/"), F.ltrim("path", F.lit("/"))))
    found = asked.join(there, "name").filter(fits).groupBy("tab", "gid").agg(F.min_by("content", "file").alias("content"))
    every = wanted.select("tab", "gid").distinct().join(found.withColumn("found", F.lit(True)), ["tab", "gid"], "left")
    text = F.coalesce("content", F.lit(""))
    kind = F.when(F.col("found").isNull(), "missing").when(text.rlike(r"^\s*$"), "empty").when(F.substring(text, 1, 200).rlike(_PAGE), "html")
    said = F.when(F.col("kind") == "missing", "the tab was not found").when(F.col("kind") == "empty", "the tab is empty").otherwise("a web page came in place of the tab")
    judged = every.withColumn("kind", kind)
    return csv_records(judged.filter("kind IS NULL").select("tab", "gid", "content")), judged.filter("kind IS NOT NULL").select("tab", "kind", said.alias("message"))


def tab_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of a folder's CSV files, each read whole by one task, as a tab is."""
    own = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").schema("value string").text(folder, wholetext=True)
    return own.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def load_csv_tabs(spark: SparkSession, folder: str, paths: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of tabs by name; paths: of each within the folder."""
    wanted = spark.createDataFrame([(tab, str(k), path) for k, (tab, path) in enumerate(paths.items())], "tab string, gid string, path string")
    return load_tabs(wanted, tab_files(spark, folder))


def read_csv_tabs(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """S5, where every tab must be there: the records of files by tab."""
    out = None
    for k, (tab, path) in enumerate(paths.items()):
        one = spark.read.text(path, wholetext=True).select(F.lit(tab).alias("tab"), F.lit(str(k)).alias("gid"), F.col("value").alias("content"))
        out = one if out is None else out.unionByName(one)
    return csv_records(out)


def script_tables(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3: (records, errors) of script JSON; documents: (json). What is no such document is an error, not a failure."""
    parsed = documents.select(F.from_json("json", SCRIPT_SCHEMA).alias("d"))
    good = F.coalesce(F.col("d.format").endswith(SCRIPT_VERSION), F.lit(False))
    tabs = parsed.filter(good).select(F.col("d.spreadsheetId").alias("sheet_id"), F.explode("d.tabs").alias("t"))
    header = tabs.select("sheet_id", F.col("t.name").alias("tab"), F.col("t.gid").alias("gid"), F.col("t.headerRow").alias("row"), F.col("t.headers").alias("cells"), F.lit(None).cast("boolean").alias("hidden"))
    data = tabs.select("sheet_id", F.col("t.name").alias("tab"), F.col("t.gid").alias("gid"), F.explode("t.rows").alias("r")).select("sheet_id", "tab", "gid", "r.row", F.col("r.values").alias("cells"), "r.hidden")
    said = parsed.filter(good).select(F.explode("d.errors").alias("e")).select("e.tab", "e.message")
    bad = parsed.filter(~good).select(F.lit(None).cast("string").alias("tab"), F.lit("not a list").alias("message"))
    return header.unionByName(data), said.unionByName(bad)


GRID_SCHEMA = """sheets array<struct<properties:struct<sheetId:bigint,title:string,hidden:boolean>,
    merges:array<struct<startRowIndex:int,endRowIndex:int,startColumnIndex:int,endColumnIndex:int>>,
    data:array<struct<startRow:int,startColumn:int,rowMetadata:array<struct<hiddenByUser:boolean,hiddenByFilter:boolean>>,
        rowData:array<struct<values:array<struct<formattedValue:string,hyperlink:string>>>>>>>>"""


def grid_records(documents: DataFrame) -> DataFrame:
    """Grid JSON as records; a cell merged downwards gives its value to the rows it covers. documents: (json)."""
    sheets = documents.select(F.explode(F.from_json("json", GRID_SCHEMA)["sheets"]).alias("s"))
    own = sheets.select(F.col("s.properties.title").alias("tab"), F.col("s.properties.sheetId").cast("string").alias("gid"), "s.merges", F.explode("s.data").alias("d"))
    rows = own.select("tab", "gid", "merges", F.coalesce("d.startRow", F.lit(0)).alias("first"), F.col("d.rowMetadata").alias("meta"), F.posexplode("d.rowData").alias("at", "r"))
    texts = F.transform(F.coalesce("r.values", F.array()), lambda v: F.coalesce(v["formattedValue"], F.lit("")))
    shown = rows.select(
        "tab", "gid", (F.col("first") + F.col("at")).alias("at"), texts.alias("cells"), "merges",
        F.when(F.col("meta").isNotNull(), F.coalesce(F.get("meta", "at")["hiddenByUser"], F.get("meta", "at")["hiddenByFilter"], F.lit(False))).alias("hidden"),
    )
    merges = shown.select("tab", "gid", F.explode("merges").alias("m")).distinct().select("tab", "gid", F.col("m.startRowIndex").alias("top"), F.col("m.endRowIndex").alias("end"), F.col("m.startColumnIndex").alias("column"))
    covered = merges.select("tab", "gid", "column", "top", F.explode(F.sequence(F.col("top") + 1, F.greatest(F.col("end") - 1, F.col("top") + 1))).alias("at"), "end").filter("at < end")
    tops = shown.select("tab", "gid", F.col("at").alias("top"), F.col("cells").alias("top_cells"))
    values = covered.join(tops, ["tab", "gid", "top"]).groupBy("tab", "gid", "at").agg(F.map_from_entries(F.collect_list(F.struct("column", F.get("top_cells", "column")))).alias("over"))
    width = F.greatest(F.size("cells"), F.coalesce(F.array_max(F.map_keys("over")) + 1, F.lit(0)))
    filled = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.try_element_at("over", i), F.get("cells", i), F.lit("")))
    out = shown.join(values, ["tab", "gid", "at"], "left")
    return out.select("tab", "gid", (F.col("at") + 1).alias("row"), F.when(width > 0, filled).otherwise(F.col("cells")).alias("cells"), "hidden")


def aliases(documents: DataFrame) -> DataFrame:
    """(group_id, name) of alias JSON; documents: (json). No aliases is no error."""
    schema = "aliases array<struct<kind:string,names:array<string>>>"
    groups = documents.select(F.posexplode(F.from_json("json", schema)["aliases"]).alias("group_id", "g"))
    return groups.select("group_id", F.explode("g.names").alias("name")).filter("name is not null")


def write_csv(grid: DataFrame, path: str) -> None:
    """A results table, replaced as a whole; a cell that a sheet would take for a formula is written as text."""
    text = [f.name for f in grid.schema if isinstance(f.dataType, T.StringType)]
    safe = {c: F.when(F.col(f"`{c}`").rlike("^[=+@-]"), F.concat(F.lit("'"), F.col(f"`{c}`"))).otherwise(F.col(f"`{c}`")) for c in text}
    grid = grid.withColumns(safe)
    grid.write.mode("overwrite").csv(path, header=True)
