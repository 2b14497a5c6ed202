"""Line dedup over a whole corpus, with DataFrame operations only.

Line keys are hashed to 128 bits.  The state is a list of levels of runs; a run is a written table of
(key hash, in how many documents), sorted by hash.  Documents come in batches.  A batch is merge-joined
against the runs: keys that a run already holds often enough are left out of it (anti-join), the rest
is written as a run of level 0.  Runs are bucketed and sorted alike, so that join shuffles and sorts none again.  Once a level has `fanout` runs they are compacted, by a merge that
sums the counts, into one run of the next level.  At the end all runs are compacted into one, whose
keys of at least `min_docs` documents are the repeated lines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm._shared import CLEANUP, SPACE, Scratch, carried, given_back, lower_ascii, need, setting

_KEY = ("h1", "h2")


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


#: Spark's setting that lets a scan of buckets, one sorted file each, count as sorted.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class LineRuns:
    """Levelled sorted runs of (h1, h2, n).

    A run is a table in `buckets` buckets by key, each one file sorted by key.  All runs have the same buckets, which are also
    the partitions of a batch's aggregation, so joins of a batch with runs move no run, nor sort it again.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 3, scratch: Scratch | None = None):
        if min_docs < 1 or fanout < 2:
            raise ValueError("min_docs is 1 at least, fanout 2")
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.scratch = scratch or Scratch(spark, "line-runs")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        """The runs' keys with their counts summed.  Runs are read as plain files here, as a union of buckets is none."""
        plain = [self.spark.read.schema(r.schema).parquet(r._scratch_place) for r in runs]
        out = plain[0]
        for r in plain[1:]:
            out = out.unionByName(r)
        return out.groupBy(*_KEY).agg(F.sum("n").alias("n"))

    def _store(self, df: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        place, name = self.scratch.path(f"level{level}"), f"spindrift_run_{uuid.uuid4().hex}"
        with setting(self.spark, ORDERED, "true"), setting(self.spark, CLEANUP, "true"):
            df.write.option("compression", "zstd").option("path", place).bucketBy(self.buckets, *_KEY).sortBy(*_KEY).saveAsTable(name, format="parquet")
        run = self.spark.table(name)
        run._scratch_place, run._name = place, name
        self.levels[level].append(run)

    def _drop(self, runs: list[DataFrame]) -> None:
        for r in runs:
            self.spark.sql(f"DROP TABLE {r._name}")
        self.scratch.drop(*runs)

    def add(self, keys: DataFrame) -> None:
        """keys: h1, h2, a row for each key and document of the batch."""
        new = keys.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"))
        for run in self.runs():
            new = new.join(run.filter(F.col("n") >= self.min_docs).select(*_KEY).hint("merge"), list(_KEY), "left_anti")
        self._store(new, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._store(self._merge(old), level + 1)
            self._drop(old)
            level += 1

    def repeated(self) -> DataFrame:
        """h1, h2 of the keys found in min_docs documents at least: all runs compacted.  Ends the runs."""
        out = self.scratch.write(self._merge(self.runs()).filter(F.col("n") >= self.min_docs).select(*_KEY), "repeated")
        self._drop(self.runs())
        self.levels = []
        return out


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 3, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept (the text without repeated lines) for every row.

    Lines are split at \\n; a line's key is the line without white space at its ends, A-Z lower-cased.
    Keys of at least `min_chars` code points that at least `min_docs` rows have lose all their lines.
    Null or empty text is one empty line.  Rows of equal id are documents of their own, as are rows
    of null id.  Other columns are left out but for those named in `carry`; one with the name of a result column comes as carried_<name>.  Any text length: a document is handled by hash-based array
    functions in one row, and only (hash, document, position) triples are shuffled for counting.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    rows = need(docs, *dict.fromkeys((id_col, text_col, *carry))).select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), carried(carry))
    lines = rows.withColumn("lines", F.split("text", "\n", -1))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("\0null"))
    row = F.struct(F.xxhash64(name, "text").alias("a"), F.xxhash64(F.lit(1), name, "text").alias("b"))  # 128 bits
    keyed = lines.select(
        row.alias("row"),
        F.transform("lines", lambda x, i: F.struct(F.xxhash64(line_key(x)).alias("h1"), F.xxhash64(F.lit(1), line_key(x)).alias("h2"), i.alias("pos"), (F.length(line_key(x)) >= min_chars).alias("counts"))).alias("keys"),
    )
    ordered = keyed.select("row", F.array_sort(F.filter("keys", lambda k: k.counts)).alias("keys"))
    at = F.transform("keys", lambda k, i: F.struct(k.h1.alias("h1"), k.h2.alias("h2"), k.pos.alias("pos"), ((i == 0) | (F.get("keys", i - 1).h1 != k.h1) | (F.get("keys", i - 1).h2 != k.h2)).alias("first")))
    # one row for each line, in batches by document
    table = scratch.write(ordered.select("row", F.explode(at).alias("k")).select("row", "k.*", F.pmod(F.col("row.a"), F.lit(batches)).cast("int").alias("batch")), "keys")
    runs = LineRuns(spark, min_docs, fanout, scratch)
    for b in range(batches):
        runs.add(table.filter((F.col("batch") == b) & F.col("first")).select(*_KEY))
    repeated = runs.repeated()
    found = table.select("row", *_KEY, "pos").join(repeated, list(_KEY), "left_semi").groupBy("row").agg(F.collect_set("pos").alias("dropped"))
    joined = lines.withColumn("row", row).join(found, "row", "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped")), lambda i: F.get("lines", i))
    return joined.select("doc_id", F.size("lines").cast("bigint").alias("n_lines"), F.size("dropped").cast("bigint").alias("n_dropped"), F.when(F.size("dropped") == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept"), *given_back(carry, ("doc_id", "n_lines", "n_dropped", "kept")))
