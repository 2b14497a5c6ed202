"""What is shown of a file, and how."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import code as C
from spindrift.functions import constants as K
from spindrift.functions import text as T
from spindrift.operators.search import search_text


def mode(name: Column, chosen: Column, full: list[str], outline: bool, summary_only: bool, is_dependency: Column) -> Column:
    """full, outline, summary or raw, in this order of precedence; a file is full if its name contains one of the given texts."""
    whole = F.coalesce(chosen == "f", F.lit(False))
    for f in full:
        whole = whole | F.contains(name, F.lit(f))
    free = chosen.isNull()
    return (
        F.when(whole, "full")
        .when(F.coalesce(chosen == "o", F.lit(False)) | (free & F.lit(outline)) | is_dependency, "outline")
        .when(F.coalesce(chosen == "s", F.lit(False)) | (free & F.lit(summary_only)), "summary")
        .otherwise("raw")
    )


def shown(files: DataFrame, focus: str | None = None, preview_lines: int = K.PREVIEW_LINES) -> DataFrame:
    """rel_path, mode, preview from files (rel_path, content, mode, tags, is_dependency).

    tags are those of the summary as it is shown.  A focus replaces the text by its matching definitions, if there are any.
    """
    ext = T.extension(F.col("rel_path"))
    content = F.col("content")
    outline = T.outline(content, ext)
    outline = F.when(F.col("is_dependency"), F.concat(F.lit(K.DEPENDENCY_HEADER + "\n"), outline)).otherwise(outline)
    first = T.summary(content)
    first = F.when(first == "", K.NO_SUMMARY).otherwise(first)
    text = F.when(content == "", "").when(F.col("mode") == "outline", outline).when(F.col("mode") == "summary", search_text(first, F.col("tags"))).otherwise(content)
    out = files.select("rel_path", "mode", text.alias("_text"))
    if focus:
        out = out.withColumn("_text", F.coalesce(C.blocks(F.col("_text"), T.extension(F.col("rel_path")), focus), F.col("_text")))
    return out.select("rel_path", "mode", F.when(F.col("_text") == "", "").otherwise(T.first_lines(F.col("_text"), preview_lines)).alias("preview"))


def markdown(path: Column, preview: Column) -> Column:
    name = T.file_name(path)
    ext = F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), F.lower(F.element_at(F.split(name, r"\."), -1)))).otherwise("")
    head = F.concat(F.lit("### File: "), path)
    return F.when(F.coalesce(preview, F.lit("")) == "", F.concat(head, F.lit(f" {K.NO_PREVIEW}\n"))).otherwise(F.concat(head, F.lit("\n```"), T.language(ext), F.lit("\n"), preview, F.lit("\n```\n")))


def estimated_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("bigint")
