"""Dependency graphs of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import code as C
from spindrift.functions import text as T
from spindrift.plans.scratch import written


def dependencies(files: DataFrame) -> DataFrame:
    """src, dst from files (rel_path, content): imported names joined to file stems.

    Of files with one stem the last by path counts; a file isn't its own dependency.
    """
    path = F.col("rel_path")
    stems = files.groupBy(T.stem(path).alias("name")).agg(F.max(path).alias("dst"))
    named = files.select(path.alias("src"), F.explode(C.imports(F.col("content"), T.extension(path))).alias("name")).distinct()
    return named.join(stems, "name").filter("src <> dst").select("src", "dst").distinct()


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """id: the seeds and all that they lead to.  seeds: id.

    A breadth-first frontier; each round joins only the newly found nodes and is written, so that the plan stays
    short.  As many rounds as the longest shortest path.
    """
    known = written(seeds.select("id").distinct(), "closure")
    frontier = known
    while True:
        found = frontier.join(edges, frontier["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct().join(known, "id", "left_anti")
        frontier = written(found, "frontier")
        if frontier.isEmpty():
            return known
        known = written(known.unionByName(frontier), "closure")


def direct_dependencies(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """id of what targets (id) import directly and that isn't a target."""
    return edges.join(targets, edges["src"] == targets["id"], "left_semi").select(F.col("dst").alias("id")).distinct().join(targets, "id", "left_anti")
