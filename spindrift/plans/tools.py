"""The tool facade for workbooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.operators import sheets
from spindrift.sources import workbooks


def excel_structure(spark: SparkSession, path: str, sheet: str | None = None, style: str = "full") -> DataFrame:
    """path, text for a workbook, or for every workbook of a folder."""
    read = spark.read.format("binaryFile")
    files = (read if path.lower().endswith(".xlsx") else read.option("pathGlobFilter", "*.xlsx")).load(path).select("path", "content")
    return sheets.workbook_maps(workbooks.parts(files), sheet, style)


def tool_definition() -> dict:
    """A function description for language models."""
    text = lambda what: {"type": "string", "description": what}
    return {
        "type": "function",
        "function": {
            "name": "get_excel_structure",
            "description": "Describes the structure of workbooks as text: cells, formats, merged ranges and likely input fields.",
            "parameters": {"type": "object", "properties": {"file_path": text("A workbook; without it, every .xlsx file of the folder."), "sheet_name": text("A sheet; without it, all sheets.")}, "required": []},
        },
    }
