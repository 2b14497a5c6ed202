"""The registered queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm._shared import Scratch, documents


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.llm.near_dup import near_duplicates

    return near_duplicates(documents(spark, sf_dir), size=3, percent=85)


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.llm.packing import pack_documents

    return pack_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), 2048, 0)


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.llm.mixing import Mix

    return Mix(documents(spark, sf_dir), (3, 1, 2), 1.5, 2).taken().select("doc_id", "size", "source_size", "target", "taken")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.llm.lines import dedup_lines

    return dedup_lines(documents(spark, sf_dir), min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
repeated AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(r.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE r.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN repeated r ON keyed.k = r.k
GROUP BY doc_id
"""


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.llm.fingerprints import fingerprints

    return fingerprints(documents(spark, sf_dir), min_docs=2, min_idf=3.0)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.llm.repeats import remove_repeats

    out = remove_repeats(documents(spark, sf_dir), 200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of `pages`, fetched on day page_id mod 365 of 2024, against a list made by rule from all hosts.

    With n a host's smallest page_id, the host is listed from day n mod 200 if n mod 3 = 0, taken off 60 days
    later if n mod 2 = 0, and listed again after another 60 days if n mod 5 = 0.
    """
    from spindrift.llm.url_filter import filter_captures, host_of

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    captures = pages.withColumn("fetched_at", day(F.col("page_id") % 365))
    hosts = pages.select("page_id", host_of(F.col("url")).alias("entry")).filter("entry <> ''").groupBy("entry").agg(F.min("page_id").alias("n")).filter("n % 3 = 0")
    event = lambda rule, later, added: hosts.filter(rule).select("entry", F.lit(added).alias("added"), day(F.col("n") % 200 + later).alias("at"))
    events = event("true", 0, True).unionByName(event("n % 2 = 0", 60, False)).unionByName(event("n % 2 = 0 AND n % 5 = 0", 120, True))
    return filter_captures(captures, events).withColumn("fetched_at", F.col("fetched_at").cast("string"))


OP7_SQL = """
WITH p AS (
  SELECT page_id, DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS fetched_at,
         regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '\\.+$', '') AS host
  FROM pages),
h AS (SELECT host AS entry, min(page_id) AS n FROM p WHERE host <> '' GROUP BY host HAVING min(page_id) % 3 = 0),
stays AS (
  SELECT entry, DATE '2024-01-01' + CAST(n % 200 AS INTEGER) AS since,
         CASE WHEN n % 2 = 0 THEN DATE '2024-01-01' + CAST(n % 200 + 60 AS INTEGER) END AS until FROM h
  UNION ALL
  SELECT entry, DATE '2024-01-01' + CAST(n % 200 + 120 AS INTEGER), NULL FROM h WHERE n % 10 = 0),
keys AS (
  SELECT page_id, fetched_at, array_to_string(string_split(host, '.')[i:], '.') AS entry
  FROM (SELECT *, unnest(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)) AS i FROM p WHERE host <> '')),
hits AS (
  SELECT k.page_id, count(*) AS n_matches, arg_max(k.entry, (length(k.entry), k.entry)) AS matched
  FROM keys k JOIN stays s ON k.entry = s.entry AND k.fetched_at >= s.since AND (s.until IS NULL OR k.fetched_at < s.until)
  GROUP BY k.page_id)
SELECT p.page_id, p.host, CAST(p.fetched_at AS VARCHAR) AS fetched_at, coalesce(n_matches, 0) AS n_matches,
       matched, matched IS NOT NULL AS blocked
FROM p LEFT JOIN hits USING (page_id)
""".replace("\\\\", "\\")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.llm.quality import quality, train

    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), max_rows=3000)
    return quality(docs, model, 10, 20, threshold=0.2)


def op9_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.llm.records import read_records, write_records

    scratch = Scratch(spark, "records")
    manifest = write_records(documents(spark, sf_dir), scratch.path("files"), vocabulary("word_bpe_49k.json"), 2)
    return read_records(spark, scratch.write(manifest, "manifest"), with_ids=False)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.llm.tokens import count_tokens

    return count_tokens(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), 2048)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_duplicates, op2_pack, op3_mix, op4_line_dedup, op5_fingerprints, op6_repeats, op7_url_filter, op8_quality, op9_records, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4_SQL, "op7_url_filter": OP7_SQL}
