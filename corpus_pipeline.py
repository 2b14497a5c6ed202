"""From raw documents to packed training sequences, stage by stage.

Every stage takes any table with the columns of `documents`, more columns or none of its rows: further columns are left out,
an empty table gives an empty one, null texts count as empty and null sources as a source of their own, texts are taken
whole.  Rows of one id are documents of their own, but for near-dedup, which keeps one of equal id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm._shared import Scratch, documents
from spindrift.llm.lines import dedup_lines
from spindrift.llm.mixing import Mix
from spindrift.llm.near_dup import near_duplicates, row_key
from spindrift.llm.packing import pack_documents
from spindrift.llm.quality import quality, train
from spindrift.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the classifier keep, unchanged.  Null and empty texts fail the rules; without labels the rules alone decide."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), max_rows=3000)
    return quality(docs, model, threshold=0.2, carry=COLUMNS).filter("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that 10 documents or more have.  A text may become empty; a null one does."""
    out = dedup_lines(docs, min_docs=10, carry=("lang", "source"))
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("bigint").alias("n_chars"))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each near-duplicate group, once: repeated rows of equal id and text are one.

    Texts without words are like no other and stay; rows of null id are told apart by their texts.
    """
    keyed = docs.withColumn("_key", row_key(docs["doc_id"], docs["text"]))
    kept = near_duplicates(keyed, size=5, percent=80, id_col="_key").filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    held = keyed.join(kept.hint("merge"), keyed["_key"] == kept["_kept"], "left_semi")
    return held.dropDuplicates(["_key", "text"]).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; a document taken in two epochs comes twice, one without words not at all."""
    mixed = Mix(docs, (3, 1, 2), 1.5, 2, with_text=True, carry=("lang",)).mixed_documents()
    return mixed.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048.  An empty text is its end token alone."""
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), 2048, 0)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", minhash_dedup),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
