"""I-Match fingerprints of documents, with DataFrame operations only.

The lexicon is the corpus's terms within a band of inverse document frequency.  It has several
randomised subsets: LEVELS sampling rates times REPLICAS, each term in a subset by bits of its hash.  A
document's fingerprint is, for each subset, the hash of its sorted distinct terms there.  Sparse
subsets say something about long texts, denser ones about short texts, so likeness is taken at the level that says
most.  Only terms in some subset are joined: others can't occur in these subsets.  Texts that are left with few
band terms are looked at again with all their terms.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm._shared import Scratch, need

#: Bits of a term's hash that are zero: a subset of level n has 1 / 2**n of all terms.
LEVELS = (5, 7, 9, 11)
REPLICAS = 8
EMPTY = "-" * 8
#: So many subsets must speak for a level to be fully believed.
ENOUGH = 4
#: A text has few band terms if fewer than FEW of them are in some subset.  It is mostly outside the band if less than one in OUTSIDE of its terms is in it.
FEW, OUTSIDE = 8, 8
#: The lexicon is counted in so many rounds.
SLICES = 2


def _bits(h: Column, replica: int) -> Column:
    """16 bits of the hash, other ones for each replica."""
    return (F.shiftrightunsigned(h, 8 * replica) if replica < 7 else F.shiftrightunsigned(h, 56).bitwiseOR(F.shiftleft(h, 8))).bitwiseAND(F.lit(0xFFFF))


def _in_some(h: Column) -> Column:
    out = None
    for r in range(REPLICAS):
        test = F.shiftrightunsigned(h, 8 * r).bitwiseAND(F.lit((1 << LEVELS[0]) - 1)) == 0
        out = test if out is None else out | test
    return out


def _member(level: int, replica: int) -> Callable[[Column], Column]:
    return lambda t: _bits(t, replica).bitwiseAND(F.lit((1 << level) - 1)) == 0


def _cell(bits: int, at: int, cell: int) -> Callable[[Column], Column]:
    return lambda t: F.shiftrightunsigned(t, at).bitwiseAND(F.lit((1 << bits) - 1)) == cell


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-cased words."""
    split = F.split(F.lower(text), "[ \\t-\\r]+")
    return F.array_distinct(F.transform(F.filter(split, lambda w: w != ""), lambda w: F.xxhash64(w)))


def _sides(own: str, other: str) -> Column:
    """term, side: 1 for a term of the text, 2 for one of the edited text, 3 for one of both."""
    return F.concat(
        F.transform(F.array_intersect(own, other), lambda t: F.struct(t.alias("term"), F.lit(3).alias("side"))),
        F.transform(F.array_except(own, other), lambda t: F.struct(t.alias("term"), F.lit(1).alias("side"))),
        F.transform(F.array_except(other, own), lambda t: F.struct(t.alias("term"), F.lit(2).alias("side"))),
    )


def _terms_of(side: int, rule: Callable[[Column], Column] = lambda t: F.lit(True)) -> Column:
    return F.transform(F.filter("found", lambda t: (t.side.bitwiseAND(F.lit(side)) != 0) & rule(t)), lambda t: t.term)


def _hashes(column: str, members: list[Callable[[Column], Column]]) -> Column:
    """For each subset, the hash of the column's terms there."""
    out = []
    for member in members:
        part = F.filter(column, member)
        out.append(F.when(F.size(part) > 0, F.lpad(F.lower(F.hex(F.xxhash64(part).bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")).otherwise(EMPTY))
    return F.array(*out)


#: The subsets of a fingerprint over the band, level by level.
SPARSE = [_member(level, r) for level in LEVELS for r in range(REPLICAS)]
#: Two denser levels for texts with few band terms: twice four cells of 1/4 and eight of 1/8 of all terms.  Each term is in a cell, so none is left out.
DENSE = [_cell(2, at, r) for at in (20, 50) for r in range(4)] + [_cell(3, 34, r) for r in range(REPLICAS)]
DENSE_LEVELS = len(DENSE) // REPLICAS


def lexicon_of(scratch: Scratch, rows: DataFrame, min_docs: int, min_idf: float) -> DataFrame:
    """term, band: the terms that min_docs rows have, and whether they are in the band.

    Exact copies weigh once in the band: what a text's further copies add is taken off again.  Terms are counted in
    SLICES by their hash, one after the other, as all at once would take a shuffle of twice the input.
    """
    copies = scratch.write(rows.groupBy("h").agg((F.count(F.lit(1)) - 1).alias("more")).filter("more > 0"), "copies")
    repeated, extra = copies.agg(F.count(F.lit(1)), F.coalesce(F.sum("more"), F.lit(0))).first()
    most = max(int((rows.count() - extra) * exp(-min_idf)), min_docs)
    weighed = rows.select("text", F.lit(1).cast("bigint").alias("weight"))
    if repeated:
        weighed = weighed.unionByName(scratch.write(rows.join(copies, "h").groupBy("h").agg(F.first("text").alias("text"), (-F.first("more")).alias("weight")).select("text", "weight"), "repeated"))
    out = None
    for i in range(SLICES):
        here = weighed.select(F.explode(F.filter(terms(F.col("text")), lambda t: F.pmod(F.shiftrightunsigned(t, 40), F.lit(SLICES)) == i)).alias("term"), "weight")
        counts = here.groupBy("term").agg(F.sum("weight").alias("texts"), F.sum(F.greatest("weight", F.lit(0))).alias("n")).filter(F.col("n") >= min_docs)
        part = scratch.write(counts.select("term", (F.col("texts") <= most).alias("band")), "lexicon")
        out = part if out is None else out.unionByName(part)
    return out


def following(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """doc_id, key, h, n_chars, again, copies, next_key, next_h: which row follows which, by key, then h; after the last the first.

    rows: doc_id, key, h, n_chars.  Equal rows are one here: all but the last of them are followed by their like (again).
    Only keys are sorted and moved.  The order is dealt by ranges; a range's last row is followed by the first of the next
    range that has one, and of these there is one a range.
    """
    single = rows.groupBy("doc_id", "key", "h").agg(F.first("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("n"))
    ranges = single.repartitionByRange("key", "h").withColumn("part", F.spark_partition_id())
    ordered = scratch.write(ranges, "order")
    starts = ordered.groupBy("part").agg(F.min(F.struct("key", "h")).alias("start"))
    after = Window.orderBy("part")  # as many rows as ranges
    first = F.first("start").over(after.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = starts.select("part", F.coalesce(F.lead("start").over(after), first).alias("then"))
    within = Window.partitionBy("part").orderBy("key", "h")
    led = ordered.withColumn("lead", F.lead(F.struct("key", "h")).over(within)).join(ends, "part").withColumn("then", F.coalesce("lead", "then"))
    last = led.select("doc_id", "key", "h", "n_chars", F.lit(False).alias("again"), F.lit(1).cast("bigint").alias("copies"), F.col("then.key").alias("next_key"), F.col("then.h").alias("next_h"))
    like = ordered.filter("n > 1").select("doc_id", "key", "h", "n_chars", F.lit(True).alias("again"), (F.col("n") - 1).alias("copies"), F.col("key").alias("next_key"), F.col("h").alias("next_h"))
    return scratch.write(last.unionByName(like), "following")


def with_next(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """What `following` has, with text and next_text: as many first code points of the next row's text as the edit takes.

    Texts are moved once, to their key, and beginnings of them once more, to the row before.
    """
    pairs = following(scratch, rows.select("doc_id", "key", "h", F.length("text").cast("bigint").alias("n_chars")))
    # one of equal rows, told by a running count after the texts' only exchange: an aggregation would sort them before it, too
    seen = F.count(F.lit(1)).over(Window.partitionBy("key", "h").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    texts = rows.select("key", "h", "text").withColumn("_seen", seen).filter("_seen = 1").drop("_seen")
    asked = pairs.select(F.col("next_key").alias("key"), F.col("next_h").alias("h"), F.struct("key", "h", "again").alias("to"), _swap().alias("swap"))
    begun = texts.hint("merge").join(asked.hint("merge"), ["key", "h"]).select("to.key", "to.h", F.col("to.again").alias("_again"), F.substring(F.col("text"), F.lit(1), F.col("swap")).alias("next_text"))
    both = texts.hint("merge").join(pairs.hint("merge"), ["key", "h"]).join(begun.hint("merge"), ["key", "h"])
    return both.filter((F.col("again").cast("int") + F.col("_again").cast("int")) % 2 == 0).drop("_again")  # no join key, so that texts stay where they are


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: of two fingerprints, the greatest share over levels of equal subsets among those with terms on a side; 1 if equal.

    a, b: arrays of subset hashes.  Levels that only one of them has are left out.
    """
    best = F.lit(0.0)
    for i in range(2 * (len(LEVELS) + DENSE_LEVELS)):
        x, y = F.slice(a, i * REPLICAS + 1, REPLICAS), F.slice(b, i * REPLICAS + 1, REPLICAS)
        pairs = F.zip_with(x, y, lambda p, q: F.when((p == EMPTY) & (q == EMPTY), 0).when(p == q, 65).otherwise(64))
        total = F.aggregate(pairs, F.lit(0), lambda s, v: s + v)
        # 64 for each subset that speaks, 1 more for each that agrees
        said, same = F.floor(total / 64), total % 64
        # dense levels hold every term, so they are believed however few subsets speak
        dense = i % (len(LEVELS) + DENSE_LEVELS) >= len(LEVELS)
        share = same / F.greatest(said, F.lit(1 if dense else ENOUGH))
        best = F.greatest(best, F.when(F.least(F.size(a), F.size(b)) >= (i + 1) * REPLICAS, share).otherwise(0.0))
    return F.when(a == b, 1.0).otherwise(best)


def _poor(scratch: Scratch, rows: DataFrame, stored: DataFrame, lexicon: DataFrame) -> DataFrame:
    """uid, more_a, more_b: what is added to the fingerprints of texts with few band terms, from all their terms.

    Dense levels over the band, and then all levels over terms of any frequency, if less than one in OUTSIDE of the text's terms in the lexicon is in the band.
    An edited text has them, too, if it has few band terms itself.
    """
    poor = scratch.write(stored.filter((F.col("n_a") < FEW) | (F.col("n_b") < FEW)).select("uid", "key", "h", "next_key", "next_h", "n_chars", (F.col("n_a") < FEW).alias("few")), "poor")
    asked = poor.select("key", "h").unionByName(poor.select(F.col("next_key").alias("key"), F.col("next_h").alias("h"))).distinct()
    texts = scratch.write(rows.join(asked, ["key", "h"], "left_semi").groupBy("key", "h").agg(F.first("text").alias("text")), "poor-texts")
    follows = texts.select(F.col("key").alias("next_key"), F.col("h").alias("next_h"), F.col("text").alias("next_text"))
    pairs = poor.join(texts, ["key", "h"]).join(follows, ["next_key", "next_h"])
    pairs = scratch.write(pairs.select("uid", "few", terms(F.col("text")).alias("own"), terms(_edited()).alias("other")), "poor-terms")
    used = pairs.select("uid", "few", F.explode(_sides("own", "other")).alias("t")).select("uid", "few", "t.term", "t.side").join(lexicon, "term")
    held = used.groupBy("uid").agg(F.first("few").alias("few"), F.array_sort(F.collect_list(F.struct("term", "side", "band"))).alias("found"))
    band = lambda t: t.band
    held = held.withColumns({"mine": _terms_of(1), "theirs": _terms_of(2), "mine_band": _terms_of(1, band), "theirs_band": _terms_of(2, band)})
    nothing = F.array().cast("array<string>")
    outside = F.col("few") & (F.size("mine_band") * OUTSIDE < F.size("mine"))
    wide = lambda c: F.when(outside, _hashes(c, SPARSE + DENSE)).otherwise(nothing)
    more_a = F.when(F.col("few"), F.concat(_hashes("mine_band", DENSE), wide("mine"))).otherwise(nothing)
    return held.select("uid", more_a.alias("more_a"), F.concat(_hashes("theirs_band", DENSE), wide("theirs")).alias("more_b"))


def _swap() -> Column:
    return F.floor(F.col("n_chars") / 4).cast("int")


def _edited() -> Column:
    swap = _swap()
    return F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - swap), F.substring(F.col("next_text"), F.lit(1), swap))


def fingerprints(docs: DataFrame, min_docs: int = 2, min_idf: float = 3.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    A term is in the lexicon if at least min_docs rows have it, and in the band if also log(distinct texts /
    distinct texts with it) is min_idf at least.  The edited text has the last quarter of the code points replaced by the first as many of the
    next row's, by id (null first, equal ids by a hash of the text); the last row is followed by the first.  Null text counts
    as empty.  A text with few band terms also has denser subsets, in which each of them is; if nearly all of its terms are too frequent for the band, it has subsets over its terms of
    any frequency.  A text without a term in any subset has a fingerprint of its own, of its whole text.  Equal texts have equal
    fingerprints.  Extra columns are left out; an empty table gives an empty one.
    """
    if docs.schema[id_col].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError("integer ids are needed")
    scratch = Scratch(docs.sparkSession, "fingerprints")
    rows = need(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumns({"key": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))), "h": F.xxhash64("text")})
    lexicon = lexicon_of(scratch, rows, min_docs, min_idf)
    pairs = with_next(scratch, rows)
    sampled = lambda c: F.filter(terms(c), _in_some)
    made = pairs.withColumn("edited", _edited()).select(F.monotonically_increasing_id().alias("uid"), "copies", "doc_id", "key", "h", "next_key", "next_h", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.xxhash64("edited").alias("edited_h"), sampled(F.col("text")).alias("own"), sampled(F.col("edited")).alias("other"))
    table = scratch.write(made, "terms")
    used = table.select("uid", F.explode(_sides("own", "other")).alias("t")).select("uid", "t.term", "t.side").join(lexicon.filter("band"), "term", "left_semi")
    held = used.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("term", "side"))).alias("found"))  # terms of one text
    joined = table.drop("own", "other").join(held, "uid", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<term:bigint,side:int>>")))
    joined = joined.withColumns({"mine": _terms_of(1), "theirs": _terms_of(2)})
    joined = joined.withColumns({"a": _hashes("mine", SPARSE), "b": _hashes("theirs", SPARSE), "n_a": F.size("mine"), "n_b": F.size("theirs")}).drop("found", "mine", "theirs")
    stored = scratch.write(joined, "prints")
    scratch.drop(table)
    more = _poor(scratch, rows, stored, lexicon)
    added = lambda c, m: F.concat(c, F.coalesce(m, F.array().cast("array<string>")))
    whole = lambda c, h: F.when(F.exists(c, lambda x: x != EMPTY), F.col(c)).otherwise(F.array(F.concat(F.lit("x"), F.lower(F.hex(h)))))
    stored = stored.join(more, "uid", "left").withColumns({"a": added("a", "more_a"), "b": added("b", "more_b")}).drop("more_a", "more_b")
    stored = scratch.write(stored.withColumns({"a": whole("a", "h"), "b": whole("b", "edited_h")}), "whole")
    next_prints = stored.groupBy(F.col("key").alias("next_key"), F.col("h").alias("next_h")).agg(F.first("a").alias("c"))
    out = stored.join(next_prints, ["next_key", "next_h"])
    out = out.select("copies", "doc_id", "n_chars", "edited_sha256", F.array_join("a", "").alias("fingerprint"), F.array_join("b", "").alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"))
    # equal rows, all but the last of them followed by their like, are one until here
    return out.select(F.explode(F.array_repeat(F.struct(*[c for c in out.columns if c != "copies"]), F.col("copies").cast("int"))).alias("r")).select("r.*")
