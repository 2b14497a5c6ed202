"""Project parts out of assistant answers: code files, directory trees, packages.  Nothing is written or run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text as T

# How files, roots and trees are written.
FILE_HEADER = r"(?U)###.*?[\(`]([\w\-\./]+\.[a-zA-Z0-9]+)[\)`]?"
ROOT_BEFORE_TREE = r"(?U)([\w_-]+)/\s*\n├──"
FENCED = r"(?s)```[\w]*\n(.*?)```"
TREE_PREFIX = r"^([│├─└\s]*)(.*)"
PROSE = r"[ぁ-んァ-ン一-龥]"
LONGEST_LINE = 100


def code_files(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, path, content, pos: the code blocks that have a file header before them; of blocks for one path the last counts.

    Lines carry state by windows: the parity of fences says what is inside a block, and a header holds until the next
    block ends.
    """
    root = F.regexp_extract(F.col(text_col), ROOT_BEFORE_TREE, 1)
    rows = texts.select(F.col(id_col).alias("id"), root.alias("root"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"))
    name = F.when(F.contains("line", F.lit("###")), F.nullif(F.regexp_extract("line", FILE_HEADER, 1), F.lit("")))
    rows = rows.withColumn("header", name).withColumn("fence", F.col("header").isNull() & F.startswith(T.strip(F.col("line")), F.lit("```")))
    by = Window.partitionBy("id").orderBy("pos")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("fences", F.sum(F.col("fence").cast("int")).over(by)).withColumn("closing", F.col("fence") & (F.col("fences") % 2 == 0))
    rows = rows.withColumn("named", F.last(F.when(F.col("header").isNotNull(), F.struct("pos", F.col("header").alias("file"))), ignorenulls=True).over(by))
    rows = rows.withColumn("ended", F.last(F.when(F.col("closing"), F.col("pos")), ignorenulls=True).over(before))
    file = F.when(F.col("named.pos") > F.coalesce("ended", F.lit(-1)), F.col("named.file"))
    rows = rows.withColumn("file", file).withColumn("block", F.when(F.col("closing"), F.col("fences") / 2).otherwise(F.ceil(F.col("fences") / 2)).cast("int"))
    inside = (F.col("fences") % 2 == 1) & ~F.col("fence") & F.col("header").isNull() & F.col("file").isNotNull()
    blocks = rows.groupBy("id", "root", "block").agg(F.max(F.when(F.col("closing"), F.struct("pos", "file"))).alias("end"), F.array_sort(F.collect_list(F.when(inside, F.struct("pos", "line")))).alias("body"))
    found = blocks.filter("end.file IS NOT NULL")
    path = F.when((F.col("root") == "") | F.startswith(F.col("end.file"), F.col("root")), F.col("end.file")).otherwise(F.concat_ws("/", "root", "end.file"))
    found = found.select("id", path.alias("path"), F.array_join(F.transform("body", lambda b: b["line"]), "\n").alias("content"), F.col("end.pos").alias("pos"))
    return found.groupBy("id", "path").agg(F.max_by("content", "pos").alias("content"), F.max("pos").alias("pos"))


def directory_actions(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, pos, path, action (mkdir or touch): what a drawn tree asks for, in order.  Ids tell texts apart.

    The first fenced block with a branch counts, else all lines.  An entry's folders are found by windows: at
    each depth that some folder of the text has, the last entry so far that isn't deeper is an ancestor of what follows further in
    if it is a folder of just that depth.  A name that starts with a slash starts its path anew.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    drawn = F.filter(F.regexp_extract_all(text, F.lit("(?U)" + FENCED), F.lit(1)), lambda b: F.contains(b, F.lit("├──")) | F.contains(b, F.lit("└──")))
    shown = texts.select(F.col(id_col).alias("id"), F.posexplode(T.lines(F.coalesce(F.get(drawn, F.lit(0)), text))).alias("line_no", "line"))
    cut = T.rstrip(F.substring_index("line", "#", 1))
    shown = shown.select("id", "line_no", cut.alias("line")).filter((F.col("line") != "") & (F.length("line") <= LONGEST_LINE) & ~F.col("line").rlike(PROSE))
    shown = shown.select("id", "line_no", F.length(F.regexp_extract("line", "(?U)" + TREE_PREFIX, 1)).alias("depth"), T.strip(F.regexp_extract("line", "(?U)" + TREE_PREFIX, 2)).alias("name"))
    named = F.endswith("name", F.lit("/")) | F.contains("name", F.lit("."))
    folder = F.endswith("name", F.lit("/")) | ~F.contains(T.file_name(F.col("name")), F.lit("."))
    entries = shown.filter((F.col("name") != "") & ((F.col("depth") > 0) | named)).withColumn("folder", folder)
    levels = entries.filter("folder").groupBy("id").agg(F.sort_array(F.collect_set("depth")).alias("levels"))  # depths of one text
    each = entries.join(levels, "id", "left").withColumn("level", F.explode_outer("levels"))
    before = Window.partitionBy("id", "level").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    above = F.last(F.when(F.col("depth") <= F.col("level"), F.struct("depth", "folder", "name")), ignorenulls=True).over(before)
    holds = (F.col("level") < F.col("depth")) & (F.col("above.depth") == F.col("level")) & F.col("above.folder")
    chains = each.withColumn("above", above).groupBy("id", "line_no", "name", "folder").agg(F.array_sort(F.collect_list(F.when(holds, F.struct("level", F.col("above.name").alias("name"))))).alias("chain"))
    parts = F.concat(F.transform("chain", lambda c: c["name"]), F.array("name"))
    start = F.array_max(F.transform(parts, lambda p, i: F.when(F.startswith(p, F.lit("/")), i)))
    joined = F.array_join(F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.rtrim(p, F.lit("/"))).otherwise(p)), "/")
    anew = F.array_join(F.transform(F.slice(parts, start + 1, F.size(parts)), lambda p, i: F.when(i < F.size(parts) - start - 1, F.rtrim(p, F.lit("/"))).otherwise(p)), "/")
    path = F.when(start.isNull(), F.concat(F.lit("./"), joined)).otherwise(anew)
    order = F.row_number().over(Window.partitionBy("id").orderBy("line_no")) - 1
    return chains.select("id", order.alias("pos"), path.alias("path"), F.when(F.col("folder"), "mkdir").otherwise("touch").alias("action"))


def requested_packages(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, pos, package of install commands, to the end of their lines."""
    lists = texts.select(F.col(id_col).alias("id"), F.posexplode(T.packages(F.col(text_col))).alias("pos", "list"))
    return lists.select("id", "pos", F.explode(F.filter(F.split("list", r"\s+"), lambda p: p != "")).alias("package"))
