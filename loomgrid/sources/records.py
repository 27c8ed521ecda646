"""Manifest, map and table sources, and partitioned and report sinks."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATASET = (
    "canvas INT, seed INT, classes ARRAY<STRUCT<id: STRING, label: STRING, family: STRING>>, "
    "samples ARRAY<STRUCT<file: STRING, label: STRING, class: STRING, clean: BOOLEAN, aug: STRUCT<scale: DOUBLE, rotateDeg: DOUBLE, dx: DOUBLE, dy: DOUBLE>>>"
)
SHEET = (
    "sheetId INT, grid STRUCT<cols: INT, rows: INT>, cells ARRAY<STRUCT<index: INT, row: INT, col: INT, root: STRING, text: STRING, box: STRUCT<x: INT, y: INT, w: INT, h: INT>>>"
)


def manifest_samples(manifests: DataFrame, clean_only: bool = False) -> DataFrame:
    """One row per sample of dataset manifests, with the index of its label among the sorted labels."""
    labels = F.array_sort(F.array_distinct(F.transform("samples", lambda s: s["label"])))
    rows = manifests.select(F.explode("samples").alias("s"), labels.alias("labels")).select("s.*", "labels")
    rows = rows.withColumn("label_index", F.array_position("labels", F.col("label")) - 1).drop("labels")
    return rows.where("clean") if clean_only else rows


def sheet_cells(sheets: DataFrame) -> DataFrame:
    """One row per cell of capture manifests."""
    return sheets.select("sheetId", F.explode("cells").alias("c")).select("sheetId", "c.*")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON documents; fields not in the schema are left out, missing ones are null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def code_points(text: DataFrame, column: str) -> DataFrame:
    """cp, name from JSON in either dialect: an object from hex to name, or a list of objects."""
    as_map = F.from_json(column, "map<string,string>")
    as_list = F.from_json(column, "array<struct<codepoint:string,name:string>>")
    is_list = F.trim(column).startswith("[")
    pairs = F.when(is_list, F.transform(as_list, lambda e: F.struct(e["codepoint"].alias("key"), e["name"].alias("value")))).otherwise(F.map_entries(as_map))
    rows = text.select(F.explode(pairs).alias("e"))
    return rows.select(F.conv(F.regexp_replace("e.key", "^(0x|U\\+)", ""), 16, 10).cast("int").alias("cp"), F.col("e.value").alias("name"))


def either_box(box: F.Column) -> F.Column:
    """Struct xMin .. yMax of a box given as xMin .. yMax or as x1 .. y2."""
    names = [("xMin", "x1"), ("yMin", "y1"), ("xMax", "x2"), ("yMax", "y2")]
    return F.struct(*[F.coalesce(box[a], box[b]).alias(a) for a, b in names])


LOOKUPS = "array<struct<lookup:int,type:string,single:map<string,string>,many:map<string,array<string>>,error:string>>"


def flatten_lookups(text: DataFrame, column: str) -> DataFrame:
    """lookup, type, source, targets from a list of substitution lookups; unknown kinds and errors stay as rows."""
    rows = text.select(F.explode(F.from_json(column, LOOKUPS)).alias("l")).select("l.*")
    single = F.transform(F.map_entries("single"), lambda e: F.struct(e["key"].alias("source"), F.array(e["value"]).alias("targets")))
    many = F.transform(F.map_entries("many"), lambda e: F.struct(e["key"].alias("source"), e["value"].alias("targets")))
    every = F.concat(F.coalesce(single, F.array().cast("array<struct<source:string,targets:array<string>>>")), F.coalesce(many, F.array().cast("array<struct<source:string,targets:array<string>>>")))
    status = F.when(F.col("error").isNotNull(), "error").when(F.size(every) == 0, "unparsed").otherwise("parsed")
    return rows.select("lookup", "type", status.alias("status"), F.explode_outer(every).alias("e")).select("lookup", "type", "status", "e.source", F.array_join("e.targets", " ").alias("targets"))


SUBSTITUTIONS = (
    "array<struct<lookup:int,type:string,single:map<string,string>,multiple:map<string,array<string>>,alternate:map<string,array<string>>,ligature:map<string,string>,"
    "rules:array<struct<before:array<string>,input:array<string>,after:array<string>,applies:array<struct<at:int,lookup:int>>>>,error:string>>"
)
_PAIRS = "array<struct<source:string,targets:string>>"


def flatten_substitutions(text: DataFrame, column: str) -> DataFrame:
    """lookup, type, status, source, targets of substitution lookups of every kind; unknown kinds and errors stay as rows."""
    rows = text.select(F.explode(F.from_json(column, SUBSTITUTIONS)).alias("l")).select("l.*")
    pair = lambda source, targets: F.struct(source.alias("source"), targets.alias("targets"))
    entries = lambda c, f: F.transform(F.map_entries(c), f)
    chained = lambda r: pair(
        F.array_join(F.array(*[F.array_join(r[c], " ") for c in ("before", "input", "after")]), " | "),
        F.array_join(F.transform(r["applies"], lambda a: F.concat_ws(":", a["at"], a["lookup"])), " "),
    )
    kinds = [
        entries("single", lambda e: pair(e["key"], e["value"])), entries("multiple", lambda e: pair(e["key"], F.array_join(e["value"], " "))),
        F.flatten(entries("alternate", lambda e: F.transform(e["value"], lambda v: pair(e["key"], v)))), entries("ligature", lambda e: pair(e["key"], e["value"])), F.transform("rules", chained),
    ]
    every = F.concat(*[F.coalesce(k, F.array().cast(_PAIRS)) for k in kinds])
    status = F.when(F.col("error").isNotNull(), "error").when(F.size(every) == 0, "unparsed").otherwise("parsed")
    return rows.select("lookup", "type", status.alias("status"), F.explode_outer(every).alias("e")).select("lookup", "type", "status", "e.source", "e.targets")


POSITIONS = "array<struct<lookup:int,type:string,marks:map<string,struct<class:int,x:int,y:int>>,bases:map<string,array<struct<x:int,y:int>>>,error:string>>"


def flatten_positions(text: DataFrame, column: str) -> DataFrame:
    """lookup, type, status, base, mark, dx, dy of positioning lookups: where each mark goes on each base that has an anchor of its class."""
    rows = text.select(F.explode(F.from_json(column, POSITIONS)).alias("l")).select("l.*")
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("marks").isNull() | F.col("bases").isNull(), "unparsed").otherwise("parsed")
    rows = rows.select("lookup", "type", status.alias("status"), F.explode_outer(F.map_entries("bases")).alias("b"), "marks")
    rows = rows.select("lookup", "type", "status", F.col("b.key").alias("base"), F.col("b.value").alias("anchors"), F.explode_outer(F.map_entries("marks")).alias("m"))
    anchor = F.get("anchors", F.col("m.value.class"))
    rows = rows.where("status != 'parsed'").unionByName(rows.where("status = 'parsed'").where(anchor.isNotNull()))
    return rows.select("lookup", "type", "status", "base", F.col("m.key").alias("mark"), (anchor["x"] - F.col("m.value.x")).alias("dx"), (anchor["y"] - F.col("m.value.y")).alias("dy"))


def lexicon(text: DataFrame, column: str) -> DataFrame:
    """ord, cr of JSON lexicons, an object or a list of objects with a field cr: the roots that are not empty, in order."""
    listed, keyed = F.from_json(column, "array<struct<cr:string>>"), F.map_values(F.from_json(column, "map<string,struct<cr:string>>"))
    values = F.when(F.trim(column).startswith("["), listed).otherwise(keyed)
    return text.select(F.posexplode(F.filter(values, lambda v: F.length(F.coalesce(v["cr"], F.lit(""))) > 0)).alias("ord", "v")).select("ord", "v.cr")


def cached_table(spark: SparkSession, path: str, version: int, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path if it is of this version and all its files can be read, else a newly built one, written there as Parquet."""
    at = f"{path}/version={version}"
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        try:
            return spark.read.option("mergeSchema", True).parquet(at)  # which reads the foot of every file
        except (PySparkException, Py4JJavaError):
            pass  # a file is damaged: all is built anew
    build().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def write_by_class(df: DataFrame, path: str, column: str) -> None:
    """JSON files in one folder per value of a column."""
    df.write.mode("overwrite").partitionBy(column).json(path)


def report_lines(df: DataFrame, title: str) -> DataFrame:
    """A Markdown table of a small result, one line a row in the order of its first column."""
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    spark = df.sparkSession
    first = spark.createDataFrame(list(enumerate(head)), "n long, line string").withColumn("k", F.lit(None).cast("string"))
    body = df.select(F.lit(len(head)).cast("long").alias("n"), F.concat(F.lit("| "), F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), " | "), F.lit(" |")).alias("line"), F.col(df.columns[0]).cast("string").alias("k"))
    return first.unionByName(body).orderBy("n", "k").select("line")
