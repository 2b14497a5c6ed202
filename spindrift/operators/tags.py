"""Term statistics, vocabularies and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import code as C
from spindrift.functions import constants as K
from spindrift.functions import text as T
from spindrift.plans.scratch import written


def terms(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """row, id, ord, word, n, first, total: each text's words with how often and where first, and its number of words.

    A text without words has one row, with a null word.  Written, so that several statistics take one scan of the texts.
    `ord` orders texts where they have a column of that name.
    """
    ord_ = F.col("ord") if "ord" in texts.columns else F.lit(0)
    rows = texts.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), ord_.alias("ord"), T.identifiers(F.coalesce(F.col(text_col), F.lit(""))).alias("_w"))
    words = rows.select("row", "id", "ord", F.size("_w").alias("total"), F.posexplode_outer("_w").alias("pos", "word"))
    return written(words.groupBy("row", "id", "ord", "total", "word").agg(F.count("word").alias("n"), F.min("pos").alias("first")), "terms")


def document_frequency(found: DataFrame) -> DataFrame:
    """word, df over the texts of a `terms` table; counted with map-side sums."""
    return found.filter("word IS NOT NULL").groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def inverse_document_frequency(found: DataFrame) -> DataFrame:
    """word, idf = ln(N / (1 + df)) + 1; texts without words count in N."""
    n = found.filter("first = 0 OR word IS NULL").agg(F.count(F.lit(1)).alias("_n"))  # one row of each text
    return document_frequency(found).crossJoin(F.broadcast(n)).select("word", (F.log(F.col("_n") / (1 + F.col("df"))) + 1).alias("idf"))  # one row


def vocabulary(found: DataFrame, size: int = K.VOCABULARY_SIZE) -> DataFrame:
    """The most frequent words of a `terms` table, ties by first occurrence: word, n."""
    words = found.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"), F.min(F.struct("ord", "first")).alias("at"))
    return words.orderBy(F.col("n").desc(), "at").limit(size).select("word", "n")


def top_words(found: DataFrame, idf: DataFrame | None = None, vocab: DataFrame | None = None, k: int = K.TAGS_PER_TEXT) -> DataFrame:
    """id, word, score, rank: the k words of the highest term weight of each text of a `terms` table, ties by first occurrence.

    Unknown words have idf 1; words of the vocabulary, of whatever size, count twice.
    """
    counted = found.filter("word IS NOT NULL")
    score = F.col("n") / F.col("total")
    if idf is not None:
        counted = counted.join(idf.select("word", "idf"), "word", "left")
        score = score * F.coalesce("idf", F.lit(1.0))
    if vocab is not None:
        counted = counted.join(vocab.select("word", F.lit(True).alias("_known")).distinct(), "word", "left")
        score = score * F.when(F.col("_known"), K.VOCABULARY_BOOST).otherwise(1.0)
    scored = counted.withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "first"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "word", "score", "rank")


def file_tags(files: DataFrame, idf: DataFrame | None = None, vocab: DataFrame | None = None) -> DataFrame:
    """rel_path, tags for files (rel_path, content, summary): top words of the summary and names of definitions, sorted.

    A Python text that parses gives its definitions by parser; others, and Python texts that would have no tag
    at all, by pattern.
    """
    best = top_words(terms(files, "rel_path", "summary"), idf, vocab).groupBy("id").agg(F.collect_list("word").alias("_words"))
    ext = T.extension(F.col("rel_path"))
    joined = files.join(best, files["rel_path"] == best["id"], "left")
    none = F.array().cast("array<string>")
    joined = joined.select("rel_path", F.coalesce("_words", none).alias("_words"), T.definitions(F.col("content")).alias("_found"), C.python_definitions(F.when(ext == ".py", F.col("content")).otherwise("(")).alias("_parsed"))
    parsed = F.array_union("_words", F.coalesce("_parsed", none))
    tags = F.when(F.col("_parsed").isNotNull() & (F.size(parsed) > 0), parsed).otherwise(F.array_union("_words", "_found"))
    return joined.select("rel_path", F.array_sort(F.array_distinct(tags)).alias("tags"))


def has_tags(tags, required: list[str]):
    """Whether all required tags are there, whatever their case; none required: always."""
    return F.size(F.array_except(F.array(*[F.lit(t.lower()) for t in required]).cast("array<string>"), F.transform(tags, F.lower))) == 0
