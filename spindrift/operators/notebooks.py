"""Notebook cells: filters, projections, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text as T


def select_cells(cells: DataFrame, last: int | None = None, no_comments: bool = False, no_markdown: bool = False, no_code: bool = False, no_output: bool = False, only_error: bool = False) -> DataFrame:
    """id, pos, type, source, output, has_error of cells (id, pos, cell_type, source, outputs) that are kept.

    Cells without text, after comments are gone, are left out with their output; `last` keeps the last so many of what is left.
    """
    code = F.col("cell_type") == "code"
    source = F.when(code, T.without_comments(F.col("source"))).otherwise(F.col("source")) if no_comments else F.col("source")
    out = cells.withColumn("source", source).filter(T.strip(F.col("source")) != "")
    if no_markdown:
        out = out.filter("cell_type IS DISTINCT FROM 'markdown'")
    out = out.withColumn("has_error", F.exists("outputs", lambda o: F.coalesce(o.output_type == "error", F.lit(False))))
    if only_error:
        out = out.filter("has_error")
    texts = F.filter(F.transform("outputs", lambda o: o.text), lambda t: t.isNotNull())
    output = F.lit("") if no_output else F.when(code, F.array_join(texts, "\n")).otherwise("")
    out = out.select("id", "pos", F.col("cell_type").alias("type"), (F.when(code, "").otherwise(F.col("source")) if no_code else F.col("source")).alias("source"), output.alias("output"), "has_error")
    if last is not None and last > 0:
        n = F.row_number().over(Window.partitionBy("id").orderBy(F.col("pos").desc()))
        out = out.withColumn("_n", n).filter(F.col("_n") <= last).drop("_n")
    return out


def cell_markdown(type_: Column, source: Column, output: Column) -> Column:
    code = F.when(T.strip(source) != "", F.concat(F.lit("### Code:\n```python\n"), source, F.lit("\n```\n"))).otherwise("")
    result = F.when(output != "", F.concat(F.lit("### Output:\n```text\n"), output, F.lit("\n```\n"))).otherwise("")
    return F.concat(F.when(type_ == "markdown", F.concat(F.lit("### Markdown:\n"), source, F.lit("\n"))).when(type_ == "code", F.concat(code, result)).otherwise(""), F.lit("\n"))


def as_markdown(cells: DataFrame) -> DataFrame:
    """id, text: the cells of each notebook with a rule of 40 dashes after each."""
    shown = cells.withColumn("_t", cell_markdown(F.col("type"), F.col("source"), F.col("output"))).filter(T.strip(F.col("_t")) != "")
    parts = shown.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "_t"))).alias("_p"))
    return parts.select("id", F.array_join(F.transform("_p", lambda p: F.concat(p["_t"], F.lit("\n" + "-" * 40 + "\n"))), "").alias("text"))


def as_json(cells: DataFrame) -> DataFrame:
    """id, json: the cells of each notebook as an array of objects."""
    one = F.struct("pos", F.struct("type", "source", "output", "has_error").alias("cell"))
    parts = cells.groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("_p"))
    return parts.select("id", F.to_json(F.transform("_p", lambda p: p.cell)).alias("json"))
