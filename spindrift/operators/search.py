"""Lexical, vector and hybrid search over a corpus of texts."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import constants as K
from spindrift.functions import text as T
from spindrift.plans.scratch import written


def bm25(corpus: DataFrame, query: str, id_col: str = "id", text_col: str = "text", k1: float = K.BM25_K1, b: float = K.BM25_B) -> DataFrame:
    """id, bm25 for every text; a text's length is its number of characters, repeated query tokens count again.

    The texts are read once: the query's tokens are counted, all words by one pattern, and the counts written, a few numbers a
    text.  The corpus statistics are one aggregated row of that table, joined back to it.
    """
    asked = Counter(T.query_tokens(query))
    text = F.coalesce(F.col(text_col), F.lit(""))
    tokens = sorted(asked)
    plain = [t for t in tokens if T.is_word(t)]
    found = corpus.select(F.col(id_col).alias("id"), F.length(text).alias("_len"), T.found_words(text, plain).alias("_found"), *[T.token_count(text, t).alias(f"_t{i}") for i, t in enumerate(tokens) if t not in plain])
    among = lambda t: F.size(F.filter("_found", lambda w: w == F.lit(t)))
    words = {i: among(t) for i, t in enumerate(tokens) if t in plain}
    counts = written(found.select("id", "_len", *[words.get(i, F.col(f"_t{i}")).alias(f"_t{i}") for i in range(len(tokens))]), "counts")
    stats = counts.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"), *[F.sum(F.when(F.col(f"_t{i}") > 0, 1).otherwise(0)).alias(f"_d{i}") for i in range(len(tokens))])
    score: Column = F.lit(0.0)
    for i, t in enumerate(tokens):
        f, d = F.col(f"_t{i}").cast("double"), F.col(f"_d{i}")
        idf = F.log(1 + (F.col("_n") - d + 0.5) / (d + 0.5))
        part = idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))
        score = score + F.when(f > 0, part * asked[t]).otherwise(0.0)
    return counts.crossJoin(F.broadcast(stats)).select("id", score.alias("bm25"))  # one row


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def vector_scores(vectors: DataFrame, query: list[float], id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """id, similarity to one query vector, which is a literal of the plan."""
    return vectors.select(F.col(id_col).alias("id"), cosine(F.col(vector_col), F.array(*[F.lit(float(x)) for x in query])).alias("similarity"))


def mean_pool(tokens: Column, mask: Column) -> Column:
    """The mean of the token vectors that the mask keeps; the divisor is 1e-9 at least."""
    weight = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m.cast("double")), F.lit(1e-9))
    kept = F.zip_with(tokens, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m.cast("double")))
    total = F.aggregate(kept, F.transform(F.get(tokens, F.lit(0)), lambda x: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda p, q: p + q))
    return F.transform(total, lambda x: x / weight)


def hybrid(lexical: DataFrame, similar: DataFrame | None = None, weights: tuple[float, float] = (K.LEXICAL_WEIGHT, K.VECTOR_WEIGHT), semantic: bool = True) -> DataFrame:
    """id, combined, bm25, similarity.  Each score is divided by its largest where that is above 0; negative similarity counts as 0.

    Without `semantic` combined is the normalised lexical score; with it but without vectors the weights still hold.
    """
    top = lexical.agg(F.max("bm25").alias("_m"))
    out = lexical.crossJoin(F.broadcast(top))  # one row
    out = out.join(similar, "id", "left") if similar is not None else out.withColumn("similarity", F.lit(None).cast("double"))
    vector = F.greatest(F.coalesce("similarity", F.lit(0.0)), F.lit(0.0))
    level = F.col("bm25") / F.when(F.col("_m") > 0, F.col("_m")).otherwise(1.0)
    combined = weights[0] * level + weights[1] * vector if semantic else level
    return out.select("id", combined.alias("combined"), "bm25", vector.alias("similarity"))


def top_hits(scored: DataFrame, k: int = K.TOP_K, score_col: str = "combined", id_col: str = "id") -> DataFrame:
    """The k best rows with a positive score, ties by id; at least one is asked for."""
    return scored.filter(F.col(score_col) > 0).orderBy(F.col(score_col).desc(), id_col).limit(max(k, 1))


def search_text(summary: Column, tags: Column, content: Column | None = None) -> Column:
    """What is searched of a file: its summary and tags, and the whole text if given."""
    short = F.when(F.size(tags) > 0, F.concat(summary, F.lit("\n\n[Tags: "), F.array_join(tags, ", "), F.lit("]"))).otherwise(summary)
    return short if content is None else F.concat(short, F.lit("\n\n"), content)
