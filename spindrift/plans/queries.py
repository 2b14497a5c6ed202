"""Registered queries of the engine's own operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions import code as C
from spindrift.functions import constants as K
from spindrift.functions import text as T
from spindrift.operators import assistant_text, cache, graph, notebooks, render, search, sheets, styles, tags, trees
from spindrift.plans import samples
from spindrift.sources import files as source
from spindrift.sources import notebooks as notebook_source
from spindrift.sources import word_files as word_source
from spindrift.sources import workbooks as workbook_source
from spindrift.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ASKED = "the inst the thnt license"
_ASKED = {"the": 2, "inst": 1, "thnt": 1, "license": 1}


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_BM25 = (
    "WITH t AS (SELECT doc_id AS id, length(text) AS len, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents), "
    "c AS (SELECT id, len, " + ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS f{i}" for i, t in enumerate(_ASKED)) + " FROM t), "
    "s AS (SELECT count(*) AS n, avg(len) AS a, " + ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(len(_ASKED))) + " FROM c), "
    "r AS (SELECT id, " + " + ".join(f"{m} * ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.5 / (f{i} + 1.5 * (0.25 + 0.75 * len / a))" for i, m in enumerate(_ASKED.values())) + " AS bm25 FROM c, s) "
)


@query(_BM25 + "SELECT id, round(bm25, 6) AS bm25 FROM r")
def bm25_scores(spark, sf_dir):
    return search.bm25(_table(spark, sf_dir, "documents"), ASKED, "doc_id").select("id", F.round("bm25", 6).alias("bm25"))


@query(_BM25 + "SELECT id, round(bm25, 6) AS bm25 FROM r WHERE bm25 > 0 ORDER BY r.bm25 DESC, id LIMIT 20")
def bm25_top_hits(spark, sf_dir):
    scored = search.bm25(_table(spark, sf_dir, "documents"), ASKED, "doc_id")
    return search.top_hits(scored, 20, "bm25").select("id", F.round("bm25", 6).alias("bm25"))


_COSINE = "list_dot_product(e.embedding::DOUBLE[], q.v) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.v, q.v)))"


def _query_vector(spark, sf_dir) -> list[float]:
    return _table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]


@query(f"WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1) SELECT e.vec_id AS id, round({_COSINE}, 6) AS similarity FROM embeddings e, q")
def vector_similarity(spark, sf_dir):
    scores = search.vector_scores(_table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), "vec_id")
    return scores.select("id", F.round("similarity", 6).alias("similarity"))


@query(
    _BM25 + f", q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1), "
    f"v AS (SELECT e.vec_id AS id, greatest(0, {_COSINE}) AS s FROM embeddings e, q), m AS (SELECT max(bm25) AS m FROM r) "
    "SELECT r.id, round(0.3 * bm25 / (CASE WHEN m > 0 THEN m ELSE 1 END) + 0.7 * coalesce(s, 0), 6) AS combined FROM r CROSS JOIN m LEFT JOIN v ON r.id = v.id "
    "WHERE 0.3 * bm25 / (CASE WHEN m > 0 THEN m ELSE 1 END) + 0.7 * coalesce(s, 0) > 0 ORDER BY 0.3 * bm25 / (CASE WHEN m > 0 THEN m ELSE 1 END) + 0.7 * coalesce(s, 0) DESC, r.id LIMIT 50"
)
def hybrid_top_hits(spark, sf_dir):
    lexical = search.bm25(_table(spark, sf_dir, "documents"), ASKED, "doc_id")
    similar = search.vector_scores(_table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), "vec_id")
    return search.top_hits(search.hybrid(lexical, similar), 50).select("id", F.round("combined", 6).alias("combined"))


_STOP = _list(K.STOP_WORDS)
_IDENT = "list_filter(list_transform(list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '[a-zA-Z_][a-zA-Z0-9_]{2,}')), lambda x: lower(x)), lambda x: x NOT IN (" + _STOP + "))"


@query(f"WITH w AS (SELECT unnest(list_distinct({_IDENT})) AS word FROM documents), n AS (SELECT count(*) AS n FROM documents) SELECT word, count(*) AS df, round(ln(any_value(n) / (1 + count(*))) + 1, 9) AS idf FROM w, n GROUP BY word")
def term_idf(spark, sf_dir):
    found = tags.terms(_table(spark, sf_dir, "documents"), "doc_id")
    both = tags.document_frequency(found).join(tags.inverse_document_frequency(found), "word")
    return both.select("word", "df", F.round("idf", 9).alias("idf"))


_POSITIONS = f"(SELECT doc_id, unnest({_IDENT}) AS word, unnest(range(len({_IDENT}))) AS pos, len({_IDENT}) AS total FROM documents)"


@query(f"SELECT word, count(*) AS n FROM {_POSITIONS} GROUP BY word ORDER BY count(*) DESC, min((doc_id, pos)) LIMIT 50")
def vocabulary_terms(spark, sf_dir):
    return tags.vocabulary(tags.terms(_table(spark, sf_dir, "documents").withColumn("ord", F.col("doc_id")), "doc_id"))


@query(
    f"WITH p AS {_POSITIONS}, n AS (SELECT count(*) AS n FROM documents), d AS (SELECT word, ln(any_value(n) / (1 + count(DISTINCT doc_id))) + 1 AS idf FROM p, n GROUP BY word), "
    f"v AS (SELECT word FROM p GROUP BY word ORDER BY count(*) DESC, min((doc_id, pos)) LIMIT 50), "
    "c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first, any_value(total) AS total FROM p GROUP BY ALL), "
    "s AS (SELECT doc_id, c.word, first, n / total * idf * (CASE WHEN v.word IS NOT NULL THEN 2.0 ELSE 1.0 END) AS score FROM c JOIN d ON c.word = d.word LEFT JOIN v ON c.word = v.word), "
    "r AS (SELECT doc_id, word, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first) AS rank FROM s) SELECT doc_id AS id, word, round(score, 9) AS score, rank FROM r WHERE rank <= 3".replace("GROUP BY ALL", "GROUP BY doc_id, word")
)
def tfidf_tags(spark, sf_dir):
    found = tags.terms(_table(spark, sf_dir, "documents").withColumn("ord", F.col("doc_id")), "doc_id")
    best = tags.top_words(found, tags.inverse_document_frequency(found), tags.vocabulary(found))
    return best.select("id", "word", F.round("score", 9).alias("score"), "rank")


@query("SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def estimated_tokens(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", render.estimated_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[1:3], chr(10)) AS head FROM documents")
def line_cap(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.first_lines(F.col("text"), 3).alias("head"))


@query("SELECT doc_id, CASE WHEN strlen(text) <= 2097 THEN length(text) ELSE 0 END AS shown FROM documents")
def size_cap(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.length(source.capped(F.col("text"), 0.002)).cast("bigint").alias("shown"))


_HOST = "split_part(regexp_replace(url, '^https?://', ''), '?', 1)"
_TREE = (
    f"WITH p AS (SELECT DISTINCT rtrim(split_part({_HOST}, '#', 1), '/') AS path FROM pages), "
    "n AS (SELECT array_to_string(string_split(path, '/')[1:i], '/') AS path, bool_or(i < len(string_split(path, '/'))) AS is_dir FROM (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM p) GROUP BY 1), "
    "m AS (SELECT path, string_split(path, '/')[-1] AS name, array_to_string(string_split(path, '/')[1:-2], '/') AS parent, len(string_split(path, '/')) AS depth, is_dir FROM n), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY is_dir DESC, lower(name), name) AS place, count(*) OVER (PARTITION BY parent) AS of FROM m)"
)


def _url_paths(spark, sf_dir) -> DataFrame:
    """Page addresses as a tree of paths."""
    path = F.rtrim(F.split(F.split(F.regexp_replace("url", "^https?://", ""), r"\?")[0], "#")[0], F.lit("/"))
    return _table(spark, sf_dir, "pages").select(path.alias("path")).distinct()


@query(_TREE + " SELECT path, name, parent, depth, is_dir, place, place = of AS is_last FROM k")
def tree_nodes(spark, sf_dir):
    return trees.ranked(trees.nodes(_url_paths(spark, sf_dir)))


@query(
    _TREE + " SELECT a.path, a.depth, coalesce(string_agg(CASE WHEN b.place = b.of THEN '    ' ELSE '│   ' END, '' ORDER BY b.depth) FILTER (WHERE b.depth < a.depth), '') || "
    "any_value(CASE WHEN a.place = a.of THEN '└──' ELSE '├──' END || a.name || CASE WHEN a.is_dir THEN '/' ELSE '' END) AS line "
    "FROM k a JOIN k b ON b.path = a.path OR starts_with(a.path, b.path || '/') GROUP BY a.path, a.depth"
)
def visual_tree(spark, sf_dir):
    return trees.rendered(trees.nodes(_url_paths(spark, sf_dir))).select("path", "depth", "line")


@query(_TREE + " SELECT path, depth, is_dir FROM k WHERE depth <= 2 AND is_dir")
def tree_depth_limit(spark, sf_dir):
    return trees.nodes(_url_paths(spark, sf_dir)).filter("depth <= 2 AND is_dir").select("path", "depth", "is_dir")


@query("SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '(^|/)(m\\.[^/]*|fr)(/|$)')")
def exclude_patterns(spark, sf_dir):
    return _table(spark, sf_dir, "pages").filter(~source.excluded(F.col("url"), ["m.*", "fr"])).select("page_id", "url")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def listed_semi_join(spark, sf_dir):
    listed = _table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").cast("string").alias("rel_path"))
    files = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("rel_path"))
    return source.select_files(files, (), (), True, listed=listed).select(F.col("rel_path").cast("bigint").alias("doc_id"))


@query(
    "WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), "
    "n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM m) "
    "SELECT user_id, CAST(run AS BIGINT) AS run, min(event_id) AS start, count(*) - 1 AS repeats, any_value(event_type) AS event_type, run = max(run) OVER (PARTITION BY user_id) AS is_last_run FROM n GROUP BY user_id, run"
)
def run_length_rows(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return sheets.run_lengths(rows, ["user_id"], "event_id", F.col("event_type"))


@query("SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS k FROM events GROUP BY user_id, event_type) WHERE k = 1")
def most_common_value(spark, sf_dir):
    return styles.most_common(_table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("SELECT id, pos, role, text FROM (SELECT conv_id AS id, turn AS pos, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role <> 'system') WHERE k <= 3")
def last_cells(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), F.when(F.col("role") == "system", "markdown").otherwise(F.col("role")).alias("cell_type"), F.col("text").alias("source"))
    rows = rows.withColumn("outputs", F.expr("cast(array() as array<struct<output_type:string,text:string>>)"))
    kept = notebooks.select_cells(rows, last=3, no_markdown=True)
    return kept.select("id", "pos", F.col("type").alias("role"), F.col("source").alias("text"))


@query(
    "SELECT conv_id AS id, string_agg(CASE WHEN role = 'user' THEN '### Markdown:' || chr(10) || text || chr(10) || chr(10) ELSE '### Code:' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || chr(10) END || chr(10) || repeat('-', 40) || chr(10), '' ORDER BY turn) AS text "
    "FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id"
)
def cells_as_markdown(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").filter("role <> 'system'")
    rows = rows.select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), F.when(F.col("role") == "user", "markdown").otherwise("code").alias("cell_type"), F.col("text").alias("source"), F.expr("cast(array() as array<struct<output_type:string,text:string>>)").alias("outputs"))
    return notebooks.as_markdown(notebooks.select_cells(rows))


@query(
    "WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey <> l_suppkey), r(id) AS (SELECT p_partkey FROM part WHERE p_size = 1 UNION SELECT dst FROM r JOIN e ON r.id = e.src) SELECT id FROM r"
)
def dependency_closure(spark, sf_dir):
    edges = _table(spark, sf_dir, "lineitem").filter("l_partkey <> l_suppkey").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    seeds = _table(spark, sf_dir, "part").filter("p_size = 1").select(F.col("p_partkey").alias("id"))
    return graph.closure(edges, seeds)


@query(
    "WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey <> l_suppkey), t AS (SELECT p_partkey AS id FROM part WHERE p_size = 1) SELECT DISTINCT dst AS id FROM e WHERE src IN (SELECT id FROM t) AND dst NOT IN (SELECT id FROM t)"
)
def direct_dependencies(spark, sf_dir):
    edges = _table(spark, sf_dir, "lineitem").filter("l_partkey <> l_suppkey").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    return graph.direct_dependencies(edges, _table(spark, sf_dir, "part").filter("p_size = 1").select(F.col("p_partkey").alias("id")))


@query("SELECT p_partkey, (p_size - 1) // 26 AS r, p_size AS c, CASE WHEN p_size > 26 THEN chr(CAST(64 + (p_size - 1) // 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + (p_size - 1) % 26 AS INTEGER)) || CAST(p_partkey AS VARCHAR) AS coordinate FROM part")
def coordinates(spark, sf_dir):
    made = _table(spark, sf_dir, "part").select("p_partkey", F.floor((F.col("p_size") - 1) / 26).cast("int").alias("r"), T.coordinate(F.col("p_partkey"), F.col("p_size")).alias("coordinate"))
    return made.select("p_partkey", "r", T.cell_column(F.col("coordinate")).alias("c"), "coordinate")


@query("SELECT o_orderkey, strftime(DATE '1899-12-30' + CAST(floor(o_totalprice / 10) AS INTEGER), '%Y-%m-%d') AS day FROM orders")
def serial_dates(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", T.serial_date((F.col("o_totalprice") / 10).cast("string")).alias("day"))


@query(
    "WITH c AS (SELECT l_orderkey, l_linenumber AS c, l_quantity AS q, l_returnflag = 'R' AS border, l_linestatus = 'O' AS fill FROM lineitem), "
    "t AS (SELECT l_orderkey, c, '[' || chr(64 + c) || CAST(l_orderkey AS VARCHAR) || '] ' || CASE WHEN q >= 25 THEN CAST(CAST(q AS INTEGER) AS VARCHAR) || CASE WHEN fill OR border THEN ' <' ELSE '' END ELSE '{_INPUT_} <' END || concat_ws(' ', CASE WHEN fill THEN 'BG:COLOR' END, CASE WHEN border THEN 'BORDER' END) || CASE WHEN fill OR border THEN '>' ELSE '' END AS t, q, fill, border FROM c WHERE q >= 25 OR fill OR border) "
    "SELECT l_orderkey, string_agg(t, ' | ' ORDER BY c, t) AS line FROM t GROUP BY l_orderkey"
)
def row_text(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    cells = li.select("l_orderkey", F.col("l_linenumber").alias("c"), T.coordinate(F.col("l_orderkey"), F.col("l_linenumber")).alias("coordinate"), sheets.cell_text(F.when(F.col("l_quantity") >= 25, F.col("l_quantity").cast("int").cast("string")), F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", F.lit(False), F.lit(None).cast("string"), F.lit(False), "lite").alias("t")).filter("t IS NOT NULL")
    parts = cells.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("c", F.concat(F.lit("["), "coordinate", F.lit("] "), "t").alias("t")))).alias("p"))
    return parts.select("l_orderkey", F.array_join(F.transform("p", lambda x: x.t), " | ").alias("line"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND l_linenumber BETWEEN 2 AND CASE o_orderpriority WHEN '1-URGENT' THEN 4 ELSE 1 END)")
def merged_cells_hidden(spark, sf_dir):
    cells = _table(spark, sf_dir, "lineitem").select(F.lit("f").alias("path"), F.lit("s").alias("sheet"), F.col("l_orderkey").alias("r"), F.col("l_linenumber").alias("c"))
    ranges = _table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.lit("f").alias("path"), F.lit("s").alias("sheet"), F.col("o_orderkey").alias("r1"), F.lit(1).alias("c1"), F.col("o_orderkey").alias("r2"), F.lit(4).alias("c2"))
    return sheets.hidden(cells, ranges).select(F.col("r").alias("l_orderkey"), F.col("c").alias("l_linenumber"))


@query(
    "WITH c AS (SELECT event_id AS k, ts, user_id FROM events WHERE event_id % 2 = 0) SELECT e.event_id, CASE WHEN c.k IS NOT NULL THEN 'hit' END AS cached_content FROM events e LEFT JOIN c ON c.k = e.event_id AND c.ts = e.ts"
)
def cache_lookup(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("rel_path"), F.col("ts").alias("mtime"), "event_id")
    key = cache.settings_key("summary")
    stored = events.filter("event_id % 2 = 0").select("rel_path", "mtime", key.alias("settings"), F.lit("hit").alias("cached_content"))
    return cache.looked_up(events, stored, key).select("event_id", "cached_content")


@query("SELECT ts::DATE::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, sf_dir):
    return streams.windowed(_table(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


# ------------------------------------------------------------------ source files made of the documents by rule

# A file for each document: five languages in turn, ten of the files are modules that others import.
_COMMENT = "'Note ' || doc_id || ' of ' || source || ' in ' || lang"
_MADE = (
    "SELECT doc_id, CASE WHEN doc_id < 7 THEN 'lib/mod' || doc_id WHEN doc_id < 10 THEN 'lib/pkg' || (doc_id - 7) ELSE 'd' || (doc_id % 11) || '/f' || doc_id END "
    "|| CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.c' WHEN 3 THEN '.html' ELSE '.txt' END AS rel_path, "
    "CASE doc_id % 5 WHEN 0 THEN '\"\"\"' || {c} || '\"\"\"~import mod' || (doc_id % 7) || '.sub~from pkg' || (doc_id % 3) || ' import y~class K' || doc_id || '(Base):~    def run_' || (doc_id % 10) || '(self):~        return 1~' "
    "WHEN 1 THEN '// ' || {c} || '~import q from \"./mod' || (doc_id % 7) || '\"~export function go' || doc_id || '(a) {~  return a~}~' "
    "WHEN 2 THEN '/* ' || {c} || ' */~#include <mod' || (doc_id % 7) || '.h>~int main_' || doc_id || '(int a) {~  if (a) { return 1; }~}~' "
    "WHEN 3 THEN '<!-- ' || {c} || ' -->~<p>x</p>' ELSE '# ' || {c} || '~# ' || lang || '~~' || text END AS content FROM documents"
).replace("{c}", _COMMENT)
_FILES = "WITH raw AS (" + _MADE + "), f AS (SELECT doc_id, doc_id % 5 AS kind, rel_path, replace(content, '~', chr(10)) AS content FROM raw), d AS (SELECT doc_id, " + _COMMENT + " AS c, lang FROM documents) "
_SUMMARY = "c || CASE WHEN kind = 4 THEN chr(10) || lang ELSE '' END"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    made = _MADE.split(" AS rel_path, ")
    path, content = made[0].removeprefix("SELECT doc_id, "), made[1].removesuffix(" AS content FROM documents")
    return docs.select("doc_id", F.expr(path).alias("rel_path"), F.replace(F.expr(content), F.lit("~"), F.lit("\n")).alias("content"))


@query(_FILES + f"SELECT rel_path, {_SUMMARY} AS summary FROM f JOIN d USING (doc_id)")
def file_summaries(spark, sf_dir):
    return _files(spark, sf_dir).select("rel_path", T.summary(F.col("content")).alias("summary"))


@query(
    _FILES + "SELECT rel_path, CASE kind WHEN 0 THEN 'class K' || doc_id || '(Base): ...' || chr(10) || '    def run_' || (doc_id % 10) || '(self): ...' WHEN 1 THEN 'export function go' || doc_id || '(a) { ... }' "
    f"WHEN 2 THEN 'int main_' || doc_id || '(int a) {{ ... }}' ELSE {_SUMMARY} END AS outline FROM f JOIN d USING (doc_id)"
)
def file_outlines(spark, sf_dir):
    return _files(spark, sf_dir).select("rel_path", T.outline(F.col("content"), T.extension(F.col("rel_path"))).alias("outline"))


_IMPORTS = "i AS (SELECT rel_path, 'mod' || (doc_id % 7) AS name FROM f WHERE kind < 3 UNION ALL SELECT rel_path, 'pkg' || (doc_id % 3) FROM f WHERE kind = 0)"


@query(_FILES + f", {_IMPORTS} SELECT rel_path, name FROM i")
def file_imports(spark, sf_dir):
    return _files(spark, sf_dir).select("rel_path", F.explode(C.imports(F.col("content"), T.extension(F.col("rel_path")))).alias("name"))


@query(_FILES + f", {_IMPORTS}, s AS (SELECT rel_path AS dst, CASE WHEN doc_id < 7 THEN 'mod' || doc_id ELSE 'pkg' || (doc_id - 7) END AS name FROM f WHERE doc_id < 10) SELECT DISTINCT rel_path AS src, dst FROM i JOIN s USING (name) WHERE rel_path <> dst")
def file_dependencies(spark, sf_dir):
    return graph.dependencies(_files(spark, sf_dir))


_FOUND = "list_transform(regexp_extract_all(content, '\\b(?:class|def|function|struct|interface)\\s+([a-zA-Z_][a-zA-Z0-9_]*)', 1), lambda x: x)"
# The words of a summary, most frequent first, then by first place; three of them and the names of definitions are a file's tags.
_TAGGED = (
    f"w AS (SELECT rel_path, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT rel_path, {_IDENT.replace('(text,', '(summary,')} AS w FROM (SELECT rel_path, {_SUMMARY} AS summary FROM f JOIN d USING (doc_id)))), "
    "r AS (SELECT rel_path, word, row_number() OVER (PARTITION BY rel_path ORDER BY count(*) DESC, min(pos)) AS rank FROM w GROUP BY rel_path, word), "
    f"t AS (SELECT rel_path, word FROM r WHERE rank <= 3 UNION SELECT rel_path, unnest({_FOUND}) FROM f) "
)


@query(_FILES + f", {_TAGGED} SELECT f.rel_path, coalesce(string_agg(word, ',' ORDER BY word), '') AS tags FROM f LEFT JOIN t USING (rel_path) GROUP BY f.rel_path")
def file_tags(spark, sf_dir):
    files = _files(spark, sf_dir).withColumn("summary", T.summary(F.col("content")))
    return tags.file_tags(files).select("rel_path", F.array_join("tags", ",").alias("tags"))


@query(_FILES + f", {_TAGGED} SELECT rel_path FROM t WHERE lower(word) IN ('note', 'src7') GROUP BY rel_path HAVING count(DISTINCT lower(word)) = 2")
def tag_filter(spark, sf_dir):
    files = _files(spark, sf_dir).withColumn("summary", T.summary(F.col("content")))
    return tags.file_tags(files).filter(tags.has_tags(F.col("tags"), ["Note", "SRC7"])).select("rel_path")


@query(_FILES + "SELECT rel_path, CASE WHEN kind = 0 AND doc_id % 10 = 5 THEN '    def run_5(self):' || chr(10) || '        return 1' END AS blocks FROM f")
def focus_blocks(spark, sf_dir):
    return _files(spark, sf_dir).select("rel_path", C.blocks(F.col("content"), T.extension(F.col("rel_path")), "run_5").alias("blocks"))


@query(_FILES + "SELECT rel_path, CASE WHEN kind = 2 THEN 'int main_' || doc_id || '(int a) {' || chr(10) || '  if (a) { return 1; }' || chr(10) || '}' END AS blocks FROM f")
def brace_blocks(spark, sf_dir):
    return _files(spark, sf_dir).select("rel_path", C.blocks(F.col("content"), T.extension(F.col("rel_path")), "main_").alias("blocks"))


@query(
    _FILES + "SELECT rel_path, '### File: ' || rel_path || chr(10) || '```' || CASE kind WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'c' WHEN 3 THEN 'html' ELSE '' END || chr(10) "
    "|| array_to_string(string_split(content, chr(10))[1:2], chr(10)) || chr(10) || '```' || chr(10) AS shown FROM f"
)
def file_markdown(spark, sf_dir):
    return _files(spark, sf_dir).select("rel_path", render.markdown(F.col("rel_path"), T.first_lines(F.col("content"), 2)).alias("shown"))


_MODES = {"lib/pkg0.c": "x", "lib/mod1.js": "f", "lib/mod2.c": "s"}
_SHOWN_OUTLINE = "CASE kind WHEN 0 THEN 'class K' || doc_id || '(Base): ...' || chr(10) || '    def run_' || (doc_id % 10) || '(self): ...' WHEN 1 THEN 'export function go' || doc_id || '(a) { ... }' WHEN 2 THEN 'int main_' || doc_id || '(int a) { ... }' ELSE c || CASE WHEN kind = 4 THEN chr(10) || lang ELSE '' END END"


@query(
    _FILES + ", m AS (SELECT f.*, c, lang, CASE WHEN contains(string_split(rel_path, '/')[-1], 'f11') OR rel_path = 'lib/mod1.js' THEN 'full' WHEN rel_path = 'lib/mod2.c' THEN 'summary' ELSE 'outline' END AS mode FROM f JOIN d USING (doc_id) WHERE rel_path <> 'lib/pkg0.c') "
    f"SELECT rel_path, mode, CASE mode WHEN 'full' THEN rtrim(array_to_string(string_split(rtrim(content, chr(10)), chr(10))[1:4], chr(10)), '') WHEN 'outline' THEN {_SHOWN_OUTLINE} END AS preview FROM m WHERE mode <> 'summary' "
    "UNION ALL SELECT rel_path, mode, 'Note 2 of ' || source || ' in ' || documents.lang || chr(10) || chr(10) || '[Tags: note, ' || lower(source) || ']' FROM m JOIN documents USING (doc_id) WHERE mode = 'summary'"
)
def project_modes(spark, sf_dir):
    """A dump in outlines, with some files in full, one as a summary and one left out."""
    from spindrift.plans.project import Options, ProjectDump

    files = _files(spark, sf_dir).select("rel_path", F.lit(None).cast("timestamp").alias("mtime"), "content")
    plan = ProjectDump(spark, Options(outline=True, modes=_MODES, full=("f11",), preview_lines=4, exclude=()), files=files)
    return plan.shown.select("rel_path", "mode", "preview")


_OTHER = "regexp_replace(lower(text), '[^\\p{L}\\p{N}]|[a-z0-9_]', '', 'g')"


@query(
    f"WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w, {_OTHER} AS o FROM documents) SELECT doc_id, len(w) AS words, "
    "md5(array_to_string(list_concat(w, CASE WHEN length(o) = 1 THEN [o] ELSE list_transform(range(length(o) - 1), lambda i: substring(o, i + 1, 2)) END), ' ')) AS tokens FROM t"
)
def search_tokens(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(T.words(F.col("text"))).cast("bigint").alias("words"), F.md5(F.array_join(T.search_tokens(F.col("text")), " ").cast("binary")).alias("tokens"))


@query("SELECT p_partkey, CAST(p_size / 2.0 AS DOUBLE)::VARCHAR || 'pt' AS size FROM part")
def half_point_sizes(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", T.half_points(F.col("p_size").cast("string")).alias("size"))


# ------------------------------------------------------------------ answers made of the conversations by rule

_ASKED_FOR = (
    "text || '~~Plan:~```~proj' || (conv_id % 5) || '/~├── m' || turn || '.py~├── sub' || (conv_id % 3) || '/~│   └── u' || conv_id || '.py  # ' || role || '~└── README.md~```~~"
    "### 1. Start (m' || turn || '.py)~```python~print(' || conv_id || ')~```~### `sub' || (conv_id % 3) || '/u' || conv_id || '.py`~```python~x = ' || turn || '~y = 2~```~done~```sh~pip install numpy pkg' || turn || '~```~'"
)
_ROWS = "SELECT conv_id * 1000 + turn AS id, conv_id AS c, turn AS t, 'proj' || (conv_id % 5) AS root, 'sub' || (conv_id % 3) AS sub FROM conversations"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.replace(F.expr(_ASKED_FOR), F.lit("~"), F.lit("\n")).alias("text"))


@query(f"WITH r AS ({_ROWS}) SELECT id, root || '/m' || t || '.py' AS path, 'print(' || c || ')' AS content FROM r UNION ALL SELECT id, root || '/' || sub || '/u' || c || '.py', 'x = ' || t || chr(10) || 'y = 2' FROM r")
def answer_code_files(spark, sf_dir):
    return assistant_text.code_files(_answers(spark, sf_dir)).select("id", "path", "content")


@query(
    f"WITH r AS ({_ROWS}) SELECT id, 0 AS pos, './' || root || '/' AS path, 'mkdir' AS action FROM r UNION ALL SELECT id, 1, './' || root || '/m' || t || '.py', 'touch' FROM r "
    "UNION ALL SELECT id, 2, './' || root || '/' || sub || '/', 'mkdir' FROM r UNION ALL SELECT id, 3, './' || root || '/' || sub || '/u' || c || '.py', 'touch' FROM r UNION ALL SELECT id, 4, './' || root || '/README.md', 'touch' FROM r"
)
def answer_directories(spark, sf_dir):
    return assistant_text.directory_actions(_answers(spark, sf_dir))


@query(f"WITH r AS ({_ROWS}) SELECT id, 0 AS pos, 'numpy' AS package FROM r UNION ALL SELECT id, 0, 'pkg' || t FROM r")
def answer_packages(spark, sf_dir):
    return assistant_text.requested_packages(_answers(spark, sf_dir))


@query("SELECT doc_id, 'x = ' || doc_id || chr(10) || 'y = ''# ' || source || '''' || chr(10) || 'if x:' || chr(10) || '    z = \"a#' || lang || '\"' AS cleaned FROM documents")
def comments_removed(spark, sf_dir):
    source_ = "'# ' || lang || '~x = ' || doc_id || '  # ' || source || '~~y = ''# ' || source || '''   ~if x:~    z = \"a#' || lang || '\" # c~   # d'"
    made = _table(spark, sf_dir, "documents").select("doc_id", F.replace(F.expr(source_), F.lit("~"), F.lit("\n")).alias("code"))
    return made.select("doc_id", T.without_comments(F.col("code")).alias("cleaned"))


# ------------------------------------------------------------------ notebooks made of the conversations by rule

_NOTEBOOK_ROWS = (
    "SELECT conv_id AS id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, CASE role WHEN 'user' THEN 'markdown' WHEN 'assistant' THEN 'code' ELSE 'raw' END AS type, text AS source, "
    "CASE WHEN role = 'assistant' THEN CASE turn % 3 WHEN 0 THEN 'out ' || turn WHEN 1 THEN 'v' || conv_id || chr(10) || 'a' || chr(10) || 'b' ELSE 'T1' || chr(10) || 'T' || turn END ELSE '' END AS output, role = 'assistant' AND turn % 3 = 2 AS has_error FROM conversations"
)


def _notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, pos, ... of cells, read back from notebook JSON with streams, results, errors, and displays that don't count."""
    turns = _table(spark, sf_dir, "conversations")
    text = lambda c: F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)
    stream = F.concat(F.lit('{"output_type": "stream", "text": ["out ", "'), F.col("turn").cast("string"), F.lit('"]}'))
    result = F.concat(F.lit('{"output_type": "execute_result", "data": {"text/plain": "v'), F.col("conv_id").cast("string"), F.lit('"}}, {"output_type": "display_data", "data": {"text/plain": "no"}}, {"output_type": "stream", "text": "a\\nb"}'))
    error = F.concat(F.lit('{"output_type": "error", "traceback": ["T1", "T'), F.col("turn").cast("string"), F.lit('"]}'))
    outputs = F.when(F.col("turn") % 3 == 0, stream).when(F.col("turn") % 3 == 1, result).otherwise(error)
    kind = F.when(F.col("role") == "user", "markdown").when(F.col("role") == "assistant", "code").otherwise("raw")
    cell = F.concat(F.lit('{"cell_type": "'), kind, F.lit('", "source": '), text(F.col("text")), F.lit(', "outputs": ['), F.when(kind == "code", outputs).otherwise(""), F.lit("]}"))
    books = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", cell.alias("cell")))).alias("c"))
    return notebook_source.cells(books.select(F.col("conv_id").alias("path"), F.concat(F.lit('{"cells": ['), F.array_join(F.transform("c", lambda x: x.cell), ", "), F.lit("]}")).alias("json")))


@query(_NOTEBOOK_ROWS)
def notebook_cells(spark, sf_dir):
    return notebooks.select_cells(_notebooks(spark, sf_dir))


@query(f"SELECT * FROM ({_NOTEBOOK_ROWS}) WHERE has_error")
def notebook_errors(spark, sf_dir):
    return notebooks.select_cells(_notebooks(spark, sf_dir), only_error=True)


@query(f"SELECT id, pos, type, CASE WHEN type = 'code' THEN '' ELSE source END AS source, '' AS output, has_error FROM ({_NOTEBOOK_ROWS}) WHERE type <> 'markdown'")
def notebook_projection(spark, sf_dir):
    return notebooks.select_cells(_notebooks(spark, sf_dir), no_code=True, no_output=True, no_markdown=True)


@query(f"SELECT id, to_json(list({{'type': type, 'output': output, 'has_error': has_error}} ORDER BY pos)) AS json FROM ({_NOTEBOOK_ROWS}) GROUP BY id")
def notebook_json(spark, sf_dir):
    whole = notebooks.as_json(notebooks.select_cells(_notebooks(spark, sf_dir)))
    slim = F.from_json("json", "array<struct<type:string,output:string,has_error:boolean>>")
    return whole.select("id", F.to_json(slim).alias("json"))


@query(
    "WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM m) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM n GROUP BY user_id, run"
)
def event_sessions(spark, sf_dir):
    return streams.sessions(_table(spark, sf_dir, "events"))


# ------------------------------------------------------------------ workbooks and word-processor files made of the tables by rule

_SHEET = (
    "WITH i AS (SELECT 's' || l_suppkey || '.xlsx' AS path, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS r, CASE l_returnflag WHEN 'N' THEN 'No' ELSE l_returnflag END AS flag, "
    "CASE WHEN l_quantity >= 10 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS quantity, l_linestatus = 'O' AS open, strftime(l_shipdate, '%Y-%m-%d') AS day, "
    "CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber AS VARCHAR) END AS even, CASE WHEN l_discount >= 0.05 THEN 'in ' || l_linenumber END AS note, l_tax = 0 AS merged FROM lineitem) "
)
_LITE = (
    ", t AS (SELECT path, r, merged, 'One' AS sheet, concat_ws(' | ', '[A' || r || '] ' || flag, CASE WHEN quantity IS NOT NULL OR open THEN '[B' || r || '] ' || coalesce(quantity, '{_INPUT_}') || CASE WHEN open THEN ' <BORDER>' ELSE '' END END, "
    "'[C' || r || '] ' || day, '[D' || r || '] ' || even || ' <FORMULA>', CASE WHEN NOT merged THEN '[E' || r || '] ' || note || ' <BG:COLOR>' END) AS line FROM i WHERE r <= 300)"
)


def _sheet_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workbook_source.parts(samples.workbooks(_table(spark, sf_dir, "lineitem")))


def _marked(parts: DataFrame) -> DataFrame:
    cells = workbook_source.cells(parts)
    seen = sheets.hidden(cells, workbook_source.merges(parts)).select("path", "sheet", "coordinate", F.lit(False).alias("hidden"))
    return cells.join(seen, ["path", "sheet", "coordinate"], "left").withColumn("hidden", F.coalesce("hidden", F.lit(True)))


@query(
    _SHEET + ", c AS (SELECT path, 'A' || r AS coordinate, flag AS value, false AS formula, false AS border, false AS fill, false AS is_date FROM i UNION ALL SELECT path, 'B' || r, quantity, false, open, false, false FROM i "
    "UNION ALL SELECT path, 'C' || r, day, false, false, false, true FROM i UNION ALL SELECT path, 'D' || r, even, true, false, false, false FROM i WHERE even IS NOT NULL UNION ALL SELECT path, 'E' || r, note, false, false, true, false FROM i WHERE note IS NOT NULL) SELECT * FROM c"
)
def workbook_cells(spark, sf_dir):
    return workbook_source.cells(_sheet_parts(spark, sf_dir)).select("path", "coordinate", "value", "formula", "border", "fill", "is_date")


@query(_SHEET + "SELECT path, 'D' || r || ':E' || r AS ref, r AS r1, 4 AS c1, r AS r2, 5 AS c2 FROM i WHERE merged")
def workbook_merges(spark, sf_dir):
    return workbook_source.merges(_sheet_parts(spark, sf_dir)).select("path", "ref", "r1", "c1", "r2", "c2")


@query(_SHEET + _LITE + "SELECT path, sheet, r, line FROM t")
def workbook_rows(spark, sf_dir):
    return sheets.row_texts(_marked(_sheet_parts(spark, sf_dir)))


@query(
    _SHEET + "SELECT path, r, concat_ws(' | ', '[A' || r || '] ' || flag || ' ', CASE WHEN quantity IS NOT NULL THEN '[B' || r || '] ' || quantity || ' ' WHEN open THEN '[B' || r || '] {{__INPUT_HERE__}} <BORDER>' END, "
    "'[C' || r || '] ' || day || ' <DATE>', '[D' || r || '] ' || even || ' ', CASE WHEN NOT merged THEN '[E' || r || '] ' || note || ' <BG_COLOR:FF..>' END) AS line FROM i WHERE r <= 300"
)
def workbook_rows_in_full(spark, sf_dir):
    return sheets.row_texts(_marked(_sheet_parts(spark, sf_dir)), style="full").select("path", "r", "line")


@query(
    _SHEET + _LITE + ", g AS (SELECT *, regexp_replace(line, '\\[[A-Z0-9]+\\] ', '', 'g') AS sig FROM t), n AS (SELECT *, CASE WHEN lag(sig) OVER w = sig THEN 0 ELSE 1 END AS new FROM g WINDOW w AS (PARTITION BY path ORDER BY r)), "
    "k AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY r) AS run FROM n), z AS (SELECT path, run, min(r) AS start, arg_min(line, r) || CASE WHEN count(*) > 1 THEN chr(10) || '... (Repeated ' || (count(*) - 1) || ' rows) ...' ELSE '' END AS text FROM k GROUP BY path, run), "
    "m AS (SELECT path, coalesce(string_agg('D' || r || ':E' || r, ', ' ORDER BY r) FILTER (WHERE merged), '') AS refs FROM i GROUP BY path) "
    "SELECT path, '=== SHEET: One ===' || chr(10) || 'Merged Ranges: ' || any_value(refs) || chr(10) || repeat('-', 60) || chr(10) || string_agg(text, chr(10) ORDER BY start) AS text FROM z JOIN m USING (path) GROUP BY path"
)
def workbook_maps(spark, sf_dir):
    return sheets.workbook_maps(_sheet_parts(spark, sf_dir), style="lite")


_WORD_LINES = (
    "WITH p AS (SELECT 'd' || doc_id || '.docx' AS path, *, string_split(text, chr(10)) AS x FROM documents), l AS ("
    "SELECT path, 0 AS place, 'paragraph' AS kind, '[HEADING1] ' || lang AS text FROM p UNION ALL SELECT path, 1, 'paragraph', '[LIST_ITEM] [LINK: ' || source || ']' FROM p "
    "UNION ALL SELECT path, 2, 'paragraph', 'doc ' || CASE WHEN doc_id % 2 = 0 THEN '{{Style:Em C:FF0000| red}}' ELSE 'red' END || CASE WHEN doc_id % 12 = 0 THEN '{{S:12.0pt BG:FFFF00 Bold| big}}' WHEN doc_id % 3 = 0 THEN '{{S:12.0pt Bold| big}}' WHEN doc_id % 4 = 0 THEN '{{BG:FFFF00| big}}' ELSE 'big' END FROM p "
    "UNION ALL SELECT path, 3, 'table', '[TABLE START]' FROM p UNION ALL SELECT path, 4, 'row', '| ' || source || ' | ' || lang || ' |' FROM p UNION ALL SELECT path, 5, 'table', '[TABLE END]' FROM p "
    "UNION ALL SELECT path, 5 + i, 'paragraph', trim(x[i]) FROM (SELECT path, x, unnest(range(1, len(x) + 1)) AS i FROM p) WHERE trim(x[i]) <> '' "
    "UNION ALL SELECT path, 6 + len(x), 'paragraph', '[DRAWING: CHART Shape:rect]' || chr(10) || '[Chart Data: Title: T | [S] a=' || doc_id || ']' || chr(10) || '[IMAGE REF: image_01.png]' FROM p WHERE doc_id % 5 = 0) "
)


@query(_WORD_LINES + "SELECT path, row_number() OVER (PARTITION BY path ORDER BY place) AS line_no, kind, text FROM l")
def word_lines(spark, sf_dir):
    found = word_source.word_lines(samples.documents(_table(spark, sf_dir, "documents")))
    return found.select("path", F.row_number().over(Window.partitionBy("path").orderBy("pos")).alias("line_no"), "kind", "text")


# The head of a map.
_WORD_HEAD = (
    "'--- Word Structure Map: ' || path || ' ---' || chr(10) || 'このテキストはWord文書の構造、スタイル、画像の配置を示したマップです。' || chr(10) || '画像ファイルは ''extracted_images/'' フォルダに抽出されています。' || chr(10) || chr(10) || '【凡例とデフォルト設定】' || chr(10) || "
    "'- [HEADING] や [TABLE] などのタグは文書構造を表します。' || chr(10) || '- {{属性| テキスト}} の形式は、特定のスタイルが適用された箇所です。' || chr(10) || '- [DRAWING/SHAPE] は図形、SmartArt、グラフなどを表します。' || chr(10) || '- 以下の属性は「文書の標準スタイル」として省略されています:' || chr(10) || "
    "'    - 文字色 (Color): 自動/黒' || chr(10) || '    - サイズ (Size): 自動/標準' || chr(10) || '    - 背景色 (BG): なし' || chr(10) || repeat('-', 50) || chr(10) || chr(10)"
)


@query(_WORD_LINES + f"SELECT path, {_WORD_HEAD} || string_agg(text, chr(10) ORDER BY place) AS text FROM l GROUP BY path")
def word_maps(spark, sf_dir):
    return word_source.word_maps(samples.documents(_table(spark, sf_dir, "documents")))


@query("SELECT 'd' || doc_id || '.docx' AS path, 'image_01.png' AS name, 'png' AS content FROM documents")
def word_images(spark, sf_dir):
    return word_source.images(samples.documents(_table(spark, sf_dir, "documents"))).select("path", "name", F.col("content").cast("string").alias("content"))
