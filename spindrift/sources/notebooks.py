"""Notebooks as cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cells(notebooks: DataFrame, id_col: str = "path", json_col: str = "json") -> DataFrame:
    """id, pos, cell_type, source, outputs (array of output_type, text, traceback) from notebook JSON.

    A notebook without cells, or text that isn't JSON, gives no rows.
    """
    parsed = notebooks.select(F.col(id_col).alias("id"), F.posexplode(F.expr(f"try_variant_get(try_parse_json({json_col}), '$.cells', 'array<variant>')")).alias("pos", "cell"))
    outputs = F.transform(
        F.coalesce(F.expr("try_variant_get(cell, '$.outputs', 'array<variant>')"), F.expr("array()").cast("array<variant>")),
        lambda o: F.struct(
            F.try_variant_get(o, "$.output_type", "string").alias("output_type"),
            F.when(F.try_variant_get(o, "$.output_type", "string") == "stream", F.coalesce(F.array_join(F.try_variant_get(o, "$.text", "array<string>"), ""), F.try_variant_get(o, "$.text", "string")))
            .when(F.try_variant_get(o, "$.output_type", "string") == "execute_result", F.coalesce(F.array_join(F.try_variant_get(o, "$.data['text/plain']", "array<string>"), ""), F.try_variant_get(o, "$.data['text/plain']", "string")))
            .when(F.try_variant_get(o, "$.output_type", "string") == "error", F.array_join(F.coalesce(F.try_variant_get(o, "$.traceback", "array<string>"), F.array().cast("array<string>")), "\n"))
            .alias("text"),
        ),
    )
    source = F.coalesce(F.array_join(F.expr("try_variant_get(cell, '$.source', 'array<string>')"), ""), F.expr("try_variant_get(cell, '$.source', 'string')"), F.lit(""))
    return parsed.select("id", "pos", F.expr("try_variant_get(cell, '$.cell_type', 'string')").alias("cell_type"), source.alias("source"), outputs.alias("outputs"))
