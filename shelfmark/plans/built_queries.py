"""Queries that build files of the catalogue's formats out of the tables and read them back, and spell numbers to read them again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import folding, links, numbers
from ..operators import extract
from ..sources import readers
from .catalogue import query, table


def _by_distinct(f, kind: T.DataType):
    return F.pandas_udf(folding._by_distinct(f), kind)


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def _csv_tabs(spark, sf_dir):
    """A tab for each nation: a banner, an empty line, a header, a section, and its suppliers with commas, quotes and line ends in their names."""
    own = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n"), "s_suppkey", "s_name")
    name = F.concat(F.col("s_name"), F.lit(', "The"\nend '), F.col("s_suppkey").cast("string"))
    line = F.concat_ws(",", _quoted(name), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 3 == 0, "UAS").otherwise("MOE"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("line")))), lambda x: x["line"])
    head = F.lit("Banned list,,\r\n\r\nTitle,ISBN,Banned by\r\nItems added 2024-25,,\r\n")
    files = own.groupBy("n").agg(lines.alias("lines")).filter(F.size("lines") > 1)  # of a lone row most rows can't be said
    return files.select(F.concat(F.lit("tab "), F.col("n").cast("string")).alias("tab"), F.col("n").cast("string").alias("gid"), F.concat(head, F.array_join("lines", "\r\n"), F.lit("\r\n")).alias("content"))


_SUPPLIERS = """s AS (SELECT 'tab ' || s_nationkey AS tab, s_suppkey, s_name || ', "The"' || chr(10) || 'end ' || s_suppkey AS title, CASE WHEN s_suppkey % 3 = 0 THEN 'UAS' ELSE 'MOE' END AS code,
    row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) + 4 AS row FROM supplier QUALIFY count(*) OVER (PARTITION BY s_nationkey) > 1)"""


@query(f"""WITH {_SUPPLIERS}, t AS (SELECT DISTINCT tab FROM s),
    r AS (SELECT tab, row, [title, CAST(s_suppkey AS VARCHAR), code] AS cells FROM s UNION ALL SELECT tab, 1, ['Banned list', '', ''] FROM t UNION ALL SELECT tab, 2, [''] FROM t
    UNION ALL SELECT tab, 3, ['Title', 'ISBN', 'Banned by'] FROM t UNION ALL SELECT tab, 4, ['Items added 2024-25', '', ''] FROM t)
    SELECT tab, CAST(row AS INTEGER) AS row, len(cells) AS n, array_to_string(cells, '|') AS cells FROM r""")
def csv_tab_records(spark, sf_dir):
    """S1, S2."""
    found = readers.csv_records(_csv_tabs(spark, sf_dir))
    return found.select("tab", "row", F.size("cells").cast("bigint").alias("n"), F.array_join("cells", "|").alias("cells"))


def _extracted(spark, sf_dir):
    found = readers.csv_records(_csv_tabs(spark, sf_dir))
    first = found.agg(F.min("tab").alias("tab")).first().tab
    header = extract.find_header(found.filter(F.col("tab") == first))
    if header is None:
        raise ValueError("no header found")
    return extract.extract(found, header)


@query(f"""WITH {_SUPPLIERS} SELECT tab, CAST(row AS INTEGER) AS row, title, CAST(s_suppkey AS VARCHAR) AS isbn, code AS banned_by, 'Items added 2024-25' AS section,
    CASE code WHEN 'UAS' THEN 'uas' ELSE 'ministry' END AS level FROM s""")
def extracted_rows(spark, sf_dir):
    """The header under its banner, sections carried down, status by code."""
    return _extracted(spark, sf_dir)[0].select("tab", "row", "title", "isbn", "banned_by", "section", F.col("status.level").alias("level"))


@query(f"WITH {_SUPPLIERS} SELECT DISTINCT tab, CAST(4 AS INTEGER) AS row, 'sectionHeading' AS kind, 'Items added 2024-25' AS detail FROM s")
def extracted_issues(spark, sf_dir):
    """X6, X7."""
    return _extracted(spark, sf_dir)[1]


def _regions(spark, sf_dir):
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


@query("""SELECT r_name AS tab, CAST(r_regionkey AS VARCHAR) AS gid, CAST(n_nationkey + 2 AS INTEGER) AS row, n_name || '|' || n_nationkey AS cells, n_nationkey % 2 = 0 AS hidden
    FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, CAST(r_regionkey AS VARCHAR), 1, 'Title|Notes', NULL FROM region""")
def script_tab_records(spark, sf_dir):
    """S3: a tab for each region, its nations as rows; one document of another format is an error and gives no row."""
    row = F.struct((F.col("n_nationkey") + 2).cast("int").alias("row"), F.array("n_name", F.col("n_nationkey").cast("string")).alias("values"), (F.col("n_nationkey") % 2 == 0).alias("hidden"))
    tabs = _regions(spark, sf_dir).groupBy("r_name", "r_regionkey").agg(F.collect_list(row).alias("rows"))
    tab = F.struct(F.col("r_name").alias("name"), F.col("r_regionkey").cast("string").alias("gid"), F.lit(1).alias("headerRow"), F.array(F.lit("Title"), F.lit("Notes")).alias("headers"), "rows")
    good = tabs.groupBy().agg(F.collect_list(tab).alias("tabs")).select(F.to_json(F.struct(F.lit("list-v1").alias("format"), F.lit("x").alias("spreadsheetId"), "tabs")).alias("json"))
    bad = spark.sql("""SELECT '{"format": "something else", "tabs": []}' AS json""")
    records, _ = readers.script_tables(good.unionByName(bad))
    return records.select("tab", "gid", "row", F.array_join("cells", "|").alias("cells"), "hidden")


@query("""WITH n AS (SELECT r_name AS tab, CAST(r_regionkey AS VARCHAR) AS gid, n_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS row FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT tab, gid, CAST(row AS INTEGER) AS row, tab || '|' || n_name AS cells FROM n""")
def grid_fill_down(spark, sf_dir):
    """A column merged over all rows of its tab gives each of them its value."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])
    tabs = _regions(spark, sf_dir).groupBy("r_name", "r_regionkey").agg(names.alias("names"))
    text = lambda c: F.struct(c.alias("formattedValue"))
    data = F.transform("names", lambda x, i: F.struct(F.array(text(F.when(i == 0, F.col("r_name"))), text(x)).alias("values")))
    merge = F.struct(F.lit(0).alias("startRowIndex"), F.size("names").alias("endRowIndex"), F.lit(0).alias("startColumnIndex"), F.lit(1).alias("endColumnIndex"))
    sheet = F.struct(F.struct(F.col("r_regionkey").alias("sheetId"), F.col("r_name").alias("title")).alias("properties"), F.array(merge).alias("merges"), F.array(F.struct(F.lit(0).alias("startRow"), data.alias("rowData"))).alias("data"))
    documents = tabs.groupBy().agg(F.collect_list(sheet).alias("sheets")).select(F.to_json(F.struct("sheets")).alias("json"))
    return readers.grid_records(documents).select("tab", "gid", "row", F.array_join("cells", "|").alias("cells"))


@query("SELECT CAST(row_number() OVER (ORDER BY r_name) - 1 AS INTEGER) AS group_id, unnest([r_name, lower(r_name)]) AS name FROM region")
def alias_groups(spark, sf_dir):
    """S11."""
    group = F.struct(F.lit("author").alias("kind"), F.array("r_name", F.lower("r_name")).alias("names"))
    groups = table(spark, sf_dir, "region").groupBy().agg(F.array_sort(F.collect_list(F.struct("r_name", group.alias("g")))).alias("all"))
    return readers.aliases(groups.select(F.to_json(F.struct(F.transform("all", lambda x: x["g"]).alias("aliases"))).alias("json")))


_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def _spelled(n: Column) -> Column:
    """English words of a number below a million."""
    ones, tens = F.array(*map(F.lit, _ONES)), F.array(*map(F.lit, _TENS))
    gap = lambda a, b: F.concat_ws(" ", a, b)

    def below_hundred(x: Column) -> Column:
        ten = F.get(tens, (x / 10).cast("int") - 2)
        return F.when(x < 20, F.get(ones, x)).when(x % 10 == 0, ten).otherwise(gap(ten, F.get(ones, x % 10)))

    def below_thousand(x: Column) -> Column:
        rest = F.when(x % 100 != 0, F.concat(F.lit("and "), below_hundred(x % 100)))
        return F.when(x < 100, below_hundred(x)).otherwise(F.concat_ws(" ", F.get(ones, (x / 100).cast("int")), F.lit("hundred"), rest))

    small = below_thousand(n % 1000)
    return F.when(n < 1000, small).otherwise(F.concat_ws(" ", below_thousand((n / 1000).cast("int")), F.lit("thousand"), F.when(n % 1000 != 0, small)))


def _numbers(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 37 % 100_000).cast("int").alias("n"))


@query("SELECT p_partkey AS id, CAST(p_partkey * 37 % 100000 AS BIGINT) AS value, FALSE AS ordinal FROM part")
def cardinal_values(spark, sf_dir):
    """Numbers spelled out, read back."""

    def read(words: str):
        found = numbers.cardinal(words.split())
        return {"value": found[0], "ordinal": found[1]} if found else None

    value = F.udf(read, "value bigint, ordinal boolean", useArrow=True)(_spelled(F.col("n")))
    return _numbers(spark, sf_dir).withColumn("v", value).select("id", "v.value", "v.ordinal")


@query("SELECT p_partkey AS id, CAST(1100 + p_partkey % 800 AS BIGINT) AS value FROM part WHERE p_partkey % 100 >= 10")
def spoken_years(spark, sf_dir):
    """Years in two groups, the first of eleven to nineteen."""
    n = (F.lit(1100) + F.col("p_partkey") % 800).cast("int")
    own = table(spark, sf_dir, "part").filter(F.col("p_partkey") % 100 >= 10).select(F.col("p_partkey").alias("id"), n.alias("n"))
    own = own.withColumn("words", F.concat_ws(" ", _spelled((F.col("n") / 100).cast("int")), _spelled(F.col("n") % 100)))
    read = _by_distinct(lambda t: numbers.two_groups(t.split()), T.LongType())
    return own.select("id", read("words").alias("value"))


@query("SELECT p_partkey AS id, CAST(21 + p_partkey % 9 + 10 * (p_partkey % 8) AS BIGINT) AS value FROM part")
def numbers_run_together(spark, sf_dir):
    """Twentyone to ninetynine, written as one word."""
    n = (F.lit(21) + F.col("p_partkey") % 9 + 10 * (F.col("p_partkey") % 8)).cast("int")
    read = _by_distinct(numbers.run_together, T.LongType())
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), read(F.replace(_spelled(n), F.lit(" "), F.lit(""))).alias("value"))


@query("SELECT p_partkey AS id, CAST(1 + p_partkey % 39 AS BIGINT) AS value FROM part")
def roman_values(spark, sf_dir):
    """Roman numerals up to 39."""
    n = (F.lit(1) + F.col("p_partkey") % 39).cast("int")
    ones = F.array(*map(F.lit, ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]))
    read = _by_distinct(numbers.roman, T.LongType())
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), read(F.concat(F.repeat(F.lit("x"), (n / 10).cast("int")), F.get(ones, n % 10))).alias("value"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN array_to_string(list_transform(range(p_size, p_size + 4), lambda k: '#book' || k), ' ') ELSE '#grade' || p_size END AS terms FROM part")
def labels_with_numbers(spark, sf_dir):
    """T10, T11: 'books 4 to 7' and '5th grade' as terms."""
    n = F.col("p_size").cast("string")
    tail = F.when(F.col("p_size").isin(1, 21, 31, 41), "st").when(F.col("p_size").isin(3, 23, 33, 43), "rd").otherwise("th")
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("knots books "), n, F.lit(" to "), (F.col("p_size") + 3).cast("string"))).otherwise(F.concat(F.lit("the "), n, tail, F.lit(" grade")))
    read = _by_distinct(lambda t: " ".join(numbers.label_pairs(t.split())), T.StringType())
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), read(text).alias("terms"))


_SHEET = "1aBcDeFgHiJkLmNoPqRsTuVwXyZ0123456789"


@query(f"SELECT p_partkey AS id, '{_SHEET}' AS sheet, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_partkey AS VARCHAR) END AS gid FROM part WHERE p_partkey % 5 <> 0")
def sheet_links(spark, sf_dir):
    """The sheet and the tab of links; of every fifth, a published copy, neither."""
    key = F.col("p_partkey").cast("string")
    gid = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("#gid="), key)).otherwise(F.concat(F.lit("?gid="), key))
    link = F.concat(F.lit(f"https://{links.HOST}/spreadsheets/d/"), F.when(F.col("p_partkey") % 5 == 0, "e/").otherwise(""), F.lit(f"{_SHEET}/edit"), gid)
    read = F.udf(lambda x: dict(zip(("sheet", "gid"), links.parse_sheet_link(x) or (None, None), strict=True)), "sheet string, gid string", useArrow=True)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), read(link).alias("x")).select("id", "x.sheet", "x.gid").filter("sheet is not null")
