"""Document types of a framework that keeps its models as JSON beside their controllers.

A JSON file with doctype `DocType` is a node; its fields link it to other
types and embed child tables, its folder names its controller, and source
files load types by the name in a string.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import snake

_SCHEMA = "doctype string, name string, module string, issingle int, is_virtual int, fields array<struct<fieldtype:string,fieldname:string,options:string>>"
# Functions whose first argument, a string, names a document type.
LOADERS = ("get_doc", "new_doc", "get_cached_doc", "get_last_doc", "get_single", "get_all", "get_list", "get_value")
DB_LOADERS = ("get_value", "set_value", "get_all", "exists", "count", "delete", "get_singles_value")
LOADS = rf"""\bfrappe\.(?:(?:{"|".join(LOADERS)})|db\.(?:{"|".join(DB_LOADERS)}))\s*\(\s*["']([^"']+)["']"""


def doctypes(json_files: DataFrame) -> DataFrame:
    """(node, name, snake, module, file, links, children, controller, is_single, is_virtual) of files(path, text); others are skipped."""
    rows = json_files.withColumn("d", F.from_json("text", _SCHEMA)).where("d.doctype = 'DocType' and d.name <> ''")
    rows = rows.select("path", "d.*").withColumn("snake", snake("name"))
    fields = F.filter(F.coalesce("fields", F.array().cast("array<struct<fieldtype:string,fieldname:string,options:string>>")), lambda f: F.trim(F.coalesce(f["options"], F.lit(""))) != "")
    of = lambda *kinds: F.transform(F.filter(fields, lambda f: f["fieldtype"].isin(*kinds)), lambda f: F.trim(f["options"]))
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    return rows.select(
        F.concat(F.lit("frappe.doctype."), "snake", F.lit(":"), "snake").alias("node"),
        "name",
        "snake",
        "module",
        F.col("path").alias("file"),
        of("Link").alias("links"),
        of("Table", "Table MultiSelect").alias("children"),
        F.concat(folder, "snake", F.lit(".py")).alias("controller"),
        (F.coalesce("issingle", F.lit(0)) != 0).alias("is_single"),
        (F.coalesce("is_virtual", F.lit(0)) != 0).alias("is_virtual"),
    ).dropDuplicates(["node"])


def doctype_edges(types: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, kind, resolution, reason): links, child tables, controllers, and loads by name from Python files.

    A controller is the Python module node of its file, else its first class,
    else its first symbol. A load counts for every node of its file.
    """
    by_name = types.select(F.col("name").alias("ref"), F.col("node").alias("dst"))
    out = None
    for column, kind in (("links", "doctype_link"), ("children", "doctype_child")):
        e = types.select(F.col("node").alias("src"), F.explode(column).alias("ref")).join(by_name, "ref").select("src", "dst", F.lit(kind).alias("kind"), F.lit(kind).alias("resolution"), F.col("ref").alias("reason"))
        out = e if out is None else out.unionByName(e)
    python = nodes.where("language = 'python'")
    order = F.when(F.col("kind") == "module", 0).when(F.col("kind") == "class", 1).otherwise(2)
    owner = python.groupBy("file").agg(F.min(F.struct(order.alias("o"), "node")).alias("b")).select(F.col("file").alias("controller"), F.col("b.node").alias("dst"))
    out = out.unionByName(types.join(owner, "controller").select(F.col("node").alias("src"), "dst", F.lit("doctype_controller").alias("kind"), F.lit("doctype_controller").alias("resolution"), F.col("controller").alias("reason")))
    loads = files.where("language = 'python' and text is not null").select(F.col("path").alias("file"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(LOADS), F.lit(1)))).alias("ref"))
    names = by_name.unionByName(types.select(F.col("snake").alias("ref"), F.col("node").alias("dst"))).distinct()
    loads = loads.join(names, "ref").join(python.select("file", F.col("node").alias("src")), "file")
    out = out.unionByName(loads.select("src", "dst", F.lit("orm_load").alias("kind"), F.lit("orm_load").alias("resolution"), F.col("ref").alias("reason")))
    return out.where("src <> dst")
