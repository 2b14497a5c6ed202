"""Directory trees from paths: ancestors, order, connectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text as T


def nodes(paths: DataFrame, path_col: str = "path", folders: DataFrame | None = None) -> DataFrame:
    """path, name, parent, depth, is_dir of all files and of the folders above them; folders (path) are kept even if empty."""
    parts = F.split(F.col(path_col), "/", -1)
    files = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("path"), (i < F.size(parts)).alias("is_dir")))).alias("n")).select("n.*")
    if folders is not None:
        own = F.split("path", "/", -1)
        files = files.unionByName(folders.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(own)), lambda i: F.struct(F.array_join(F.slice(own, 1, i), "/").alias("path"), F.lit(True).alias("is_dir")))).alias("n")).select("n.*"))
    one = files.groupBy("path").agg(F.max("is_dir").alias("is_dir"))
    split = F.split("path", "/", -1)
    return one.select("path", F.element_at(split, -1).alias("name"), F.array_join(F.slice(split, 1, F.size(split) - 1), "/").alias("parent"), F.size(split).alias("depth"), "is_dir")


def ranked(tree: DataFrame) -> DataFrame:
    """The nodes with place and is_last among their siblings: folders first, then by name without case."""
    order = Window.partitionBy("parent").orderBy(F.col("is_dir").desc(), F.lower("name"), "name")
    every = Window.partitionBy("parent")
    return tree.withColumn("place", F.row_number().over(order)).withColumn("is_last", F.col("place") == F.count(F.lit(1)).over(every))


def rendered(tree: DataFrame, space: str = "", slash: str = "/", max_depth: int = -1) -> DataFrame:
    """path, depth, line, sort: a line for each node with its connectors; `sort` puts them in order from top to bottom.

    The tree style is ├──name with a slash after folders; the other style has a space and no slash.
    """
    r = ranked(tree if max_depth < 0 else tree.filter(F.col("depth") <= max_depth))
    up = F.split("path", "/", -1)
    pairs = r.select("path", "name", "depth", "is_dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(up)), lambda i: F.array_join(F.slice(up, 1, i), "/"))).alias("above"))
    marks = r.select(F.col("path").alias("above"), F.col("depth").alias("_level"), "place", "is_last")
    rows = pairs.join(marks, "above").groupBy("path", "name", "depth", "is_dir").agg(F.array_sort(F.collect_list(F.struct("_level", "place", "is_last"))).alias("way"))
    line = F.concat(
        F.array_join(F.transform(F.slice("way", 1, F.size("way") - 1), lambda w: F.when(w.is_last, "    ").otherwise("│   ")), ""),
        F.when(F.element_at("way", -1).is_last, "└──").otherwise("├──"),
        F.lit(space), F.col("name"), F.when(F.col("is_dir"), slash).otherwise(""),
    )
    return rows.select("path", "depth", line.alias("line"), F.transform("way", lambda w: w.place).alias("sort"))


def plain_tree(paths: DataFrame, path_col: str = "path", max_depth: int = -1, directories_only: bool = False, exclude: tuple[str, ...] = (), folders: DataFrame | None = None) -> DataFrame:
    """The plain style: excluded names (shell patterns, any case) go with all below them; folders at the depth limit are listed, not opened."""
    kept = paths.filter(~_hidden(F.col(path_col), exclude))
    tree = nodes(kept, path_col, folders.filter(~_hidden(F.col("path"), exclude)) if folders is not None else None)
    return rendered(tree.filter("is_dir") if directories_only else tree, " ", "", max_depth)


def _hidden(path: Column, exclude: tuple[str, ...]) -> Column:
    return F.exists(F.split(path, "/", -1), lambda part: T.matches_any(F.lower(part), [p.lower() for p in exclude]))


def flat_json(files: DataFrame) -> DataFrame:
    """rel_path, json for files (rel_path, size, mtime, preview): one object for each file instead of a nested one."""
    one = F.struct(T.file_name(F.col("rel_path")).alias("name"), F.col("rel_path").alias("relativePath"), F.lit("file").alias("type"), "size", F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ss").alias("modified"), "preview")
    return files.select("rel_path", F.to_json(one).alias("json"))


def as_text(lines: DataFrame, root: str | None = None) -> Column | str:
    """The whole picture, on the driver: a report for people, as long as the tree."""
    rows = [r["line"] for r in lines.orderBy("sort").select("line").collect()]
    return "\n".join(([root] if root is not None else []) + rows)


def as_json(tree: DataFrame, previews: DataFrame, root: str) -> dict:
    """The nested form: folders {name, children, files_inside}, files {name, preview}.  previews: path, preview."""
    rows = ranked(tree).join(previews, "path", "left").orderBy("depth", "parent", "place").collect()
    top: dict = {"name": root, "children": []}
    at = {"": top}
    for r in rows:
        node = {"name": r["name"]} | ({"children": []} if r["is_dir"] else {"preview": r["preview"] or ""})
        if r["is_dir"]:
            at[r["path"]] = node
        at[r["parent"]]["children"].append(node)
    for node in at.values():
        node["files_inside"] = bool(node["children"])
    return top
