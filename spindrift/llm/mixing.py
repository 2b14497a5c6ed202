"""Mixing sources to target weights.

Each source's words, document after document, are one stream, cut into blocks of a fixed number of
words.  The mix is a sequence of slots, dealt over output shards; each shard draws how many of its slots
each source gets from a multinomial distribution over what the sources still have to give, and draws
again what goes beyond that, so that the totals come out as planned.  A source's k-th slot
takes the block at place k of a pseudorandom permutation of its block indices (a Feistel network, cycle
walked, another one for each epoch), and blocks are joined to slots by index.  The last slot of a source may be
cut short so that it meets its target to the word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm._shared import Scratch, blobs, bounded, carried, given_back, mix64, need, salts, words

#: Sources are a dimension: their totals go to the driver, and at most CELLS counts of shards times sources, as arrays.
#: With many sources there are fewer, larger shards.  Up to SMALL sources their totals are broadcast.
SMALL = 20_000
MAX_SHARDS = 4096
CELLS = 4_000_000


def targets(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """share * sum(sizes) dealt by weight; none over cap times its size, the excess dealt again by weight."""
    out: list[float | None] = [None] * len(sizes)
    left = share * sum(sizes)
    while True:
        open_ = [i for i, t in enumerate(out) if t is None]
        total = sum(weights[i] for i in open_)
        if not open_:
            break
        full = [i for i in open_ if left * weights[i] / total > cap * sizes[i]] if total > 0 else open_
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(cap * sizes[i])
        left -= sum(cap * sizes[i] for i in full)
        left = max(left, 0.0)
    return out


class Permutation:
    """A pseudorandom permutation of 0 .. n - 1 and its inverse, without a table."""

    def __init__(self, n: int, *seed: int):
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = (np.uint64(1) << self.half) - np.uint64(1)
        key = np.zeros(1, np.uint64)
        self.keys = []
        for s in (*seed, 1, 2, 3, 4):
            key = mix64(key ^ np.uint64(s % (1 << 64)))
            self.keys.append(key[0])
        self.keys = self.keys[-4:]

    def _walk(self, x: np.ndarray, keys: list, back: bool) -> np.ndarray:
        out = x.astype(np.uint64)
        todo = np.arange(len(out))
        while len(todo):
            l, r = out[todo] >> self.half, out[todo] & self.mask
            for k in keys:
                if back:
                    l, r = r ^ (mix64(l ^ k) & self.mask), l
                else:
                    l, r = r, l ^ (mix64(r ^ k) & self.mask)
            out[todo] = l << self.half | r
            todo = todo[out[todo] >= self.n]
        return out.astype(np.int64)

    def of(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self.keys, False)

    def place(self, y: np.ndarray) -> np.ndarray:
        return self._walk(y, self.keys[::-1], True)


def quota(size: int, words_wanted: int, block: int, *seed: int) -> tuple[int, int]:
    """How many slots a source needs for so many words, and how many words its last slot takes (0: all)."""
    if not size or not words_wanted:
        return 0, 0
    blocks = -(-size // block)
    tail = size - (blocks - 1) * block
    epochs, rest = divmod(words_wanted, size)
    at = int(Permutation(blocks, *seed, epochs).place(np.array([blocks - 1]))[0])
    if rest <= at * block:
        slots, cut = divmod(rest, block)
    elif rest < at * block + tail:
        slots, cut = at, rest - at * block
    else:
        slots, cut = divmod(rest - at * block - tail, block)
        slots += at + 1
    return epochs * blocks + slots + (cut > 0), cut


def draw_shards(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Slots of each source in each shard; columns sum to the quotas."""
    rng = np.random.Generator(np.random.Philox(seed))
    left = quotas.astype(np.int64).copy()
    total = int(left.sum())
    out = np.zeros((shards, len(left)), np.int64)
    for g in range(shards):
        missing = total * (g + 1) // shards - total * g // shards
        while missing:
            got = np.minimum(rng.multinomial(missing, left / left.sum()), left)
            out[g] += got
            left -= got
            missing -= int(got.sum())
    return out


def _count_words(docs: DataFrame, id_col: str, source_col: str, text_col: str, with_text: bool, carry: tuple[str, ...] = ()) -> DataFrame:
    rows = need(docs, *dict.fromkeys((id_col, source_col, text_col, *carry))).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("raw"), carried(carry))
    rows = rows.withColumn("_h", F.xxhash64("raw"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "raw", 2 << 20):
            raw, at = blobs(b.column(2))
            _, _, text = words(raw, at, lower=False)
            sizes = pa.array(np.bincount(text, minlength=b.num_rows).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), sizes, b.columns[-1], *([b.column(2)] if with_text else []), b.column(3)], ["doc_id", "source", "size", "h", *(["raw"] if with_text else []), "_carried"])

    return rows.mapInArrow(run, f"doc_id {kind}, source string, size bigint, h bigint" + ", raw binary" * with_text + f", _carried {rows.schema['_carried'].dataType.simpleString()}")


class Mix:
    """The plan of a mix over a table of documents; see `taken` and `mixed_documents`.

    Null and empty texts have no words and take no part.  Null is a source of its own, the last.  Rows
    that share an id, or all columns, are documents of their own.  An empty table gives empty results.  Reruns
    agree: draws and permutations depend on the seed alone, a source's stream on the ids.
    """

    def __init__(self, docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = 128, seed: int = 7, each: int = 1_000, with_text: bool = False, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", carry: tuple[str, ...] = ()):
        if block < 1 or cap != int(cap):
            raise ValueError("blocks hold a word at least; the cap is a whole number of epochs")
        self.carry = carry
        spark = self.spark = docs.sparkSession
        self.scratch, self.block, self.seed = Scratch(spark, "mixing"), block, seed
        self.texts = self.scratch.write(_count_words(docs, id_col, source_col, text_col, with_text, carry).withColumn("row_key", F.monotonically_increasing_id()), "sized")
        sized = self.texts.select("doc_id", "source", "size", "h", "row_key")  # texts are left out of all windows
        found = {r["source"]: (r["size"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()}  # a row for each source
        self.sources = sorted((s for s in found if s is not None)) + [None] * (None in found)
        self.sizes = [int(found[s][0]) for s in self.sources]
        self.targets = targets(self.sizes, [weights[i % len(weights)] for i in range(len(self.sources))], share, cap)
        wanted = [min(int(t + 0.5), int(cap) * n) for t, n in zip(self.targets, self.sizes)]
        quotas = [quota(n, w, block, seed, i) for i, (n, w) in enumerate(zip(self.sizes, wanted))]
        self.quotas = np.array([q for q, _ in quotas], np.int64)
        self.cuts = [c for _, c in quotas]
        self.shards = int(max(1, min(MAX_SHARDS, CELLS // len(self.quotas), -(-int(self.quotas.sum()) // 8192)))) if len(self.quotas) else 0
        # the streams: a source's documents in parts of about `each`, by id within a part, parts one after the other
        stats = spark.createDataFrame([(s, i, n, t, salts(found[s][1], each)) for i, (s, n, t) in enumerate(zip(self.sources, self.sizes, self.targets))], "source string, source_no int, source_size bigint, target double, parts int")
        stats = F.broadcast(stats) if len(found) <= SMALL else stats
        part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
        order = [F.col("doc_id").asc_nulls_first(), "size", "h", "row_key"]
        numbered = sized.join(stats, sized["source"].eqNullSafe(stats["source"])).drop(stats["source"]).withColumn("part", part).drop("parts")
        within = Window.partitionBy("source_no", "part").orderBy(*order)
        numbered = numbered.withColumn("no", F.row_number().over(within)).withColumn("before", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        if any(n > each for _, n in found.values()):
            sums = sized.join(stats, sized["source"].eqNullSafe(stats["source"])).groupBy(F.col("source_no").alias("_s"), part.alias("_p")).agg(F.sum("size").alias("_n"))
            base = sums.select("_s", "_p", (F.sum("_n").over(Window.partitionBy("_s").orderBy("_p")) - F.col("_n")).alias("_base"))
            numbered = numbered.join(base, (F.col("source_no") == F.col("_s")) & (F.col("part") == F.col("_p"))).withColumn("before", F.col("before") + F.col("_base")).drop("_s", "_p", "_base")
        self.rows = numbered

    def slots(self) -> DataFrame:
        """source_no, shard, slot, block_no, epoch, take: the mix, a row for each slot."""
        counts = draw_shards(self.quotas, self.shards, self.seed) if self.shards else np.zeros((0, 0), np.int64)
        firsts = np.cumsum(counts, axis=0) - counts
        g, s = np.nonzero(counts)  # CELLS at most
        plan = pa.table({"source_no": s.astype(np.int32), "shard": g.astype(np.int32), "first": firsts[g, s].astype(np.int64), "slots": counts[g, s].astype(np.int64)})
        table = self.spark.createDataFrame(plan)
        step = 1 << 14
        table = table.select("source_no", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("slots") - 1, F.lit(step))).alias("lo"), (F.col("first") + F.col("slots")).alias("end"))
        block, seed, sizes, quotas, cuts = self.block, self.seed, self.sizes, self.quotas, self.cuts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s, shard, lo, end in zip(*(c.to_pylist() for c in b.columns)):
                    slot = np.arange(lo, min(lo + step, end))
                    blocks = -(-sizes[s] // block)
                    epoch, at = slot // blocks, slot % blocks
                    no = np.empty(len(slot), np.int64)
                    for e in np.unique(epoch):
                        no[epoch == e] = Permutation(blocks, seed, s, int(e)).of(at[epoch == e])
                    take = np.full(len(slot), block, np.int64)
                    if cuts[s]:
                        take[slot == quotas[s] - 1] = cuts[s]
                    yield pa.RecordBatch.from_pydict({"source_no": np.full(len(slot), s, np.int32), "shard": np.full(len(slot), shard, np.int32), "slot": slot, "block_no": no, "epoch": epoch.astype(np.int32), "take": take})

        return table.mapInArrow(run, "source_no int, shard int, slot bigint, block_no bigint, epoch int, take bigint")

    def parts(self, *more: str) -> DataFrame:
        """For each slot and document with words in its block: source_no, part, no, shard, slot, epoch, lo, hi (words of the document)."""
        first, last = F.floor(F.col("before") / self.block).cast("bigint"), F.floor((F.col("before") + F.col("size") - 1) / self.block).cast("bigint")
        blocks = self.rows.filter("size > 0").select("source_no", "part", "no", "size", "before", *more, F.explode(F.sequence(first, last)).alias("block_no"))
        start: Column = F.col("block_no") * self.block
        joined = blocks.hint("merge").join(self.slots().hint("merge"), ["source_no", "block_no"])  # both grow with the corpus
        lo = F.greatest(start - F.col("before"), F.lit(0))
        hi = F.least(start + F.col("take") - F.col("before"), F.col("size"))
        return joined.select("source_no", "part", "no", *more, "shard", "slot", "epoch", lo.alias("lo"), hi.alias("hi")).filter("hi > lo")

    def taken(self) -> DataFrame:
        """doc_id, source, size, source_size, target, taken for every row of the documents."""
        key = ("doc_id", "source", "size", "source_size", "target")
        used = self.parts("doc_id", "source", "source_size", "target").select("source_no", "part", "no", F.col("doc_id"), (F.col("hi") - F.col("lo")).alias("taken"))
        every = self.rows.select("source_no", "part", "no", *key, F.lit(0).cast("bigint").alias("taken"))
        sums = every.unionByName(used, allowMissingColumns=True).groupBy("source_no", "part", "no").agg(*[F.max(c).alias(c) for c in key], F.sum("taken").alias("taken"))
        return sums.select(*key, "taken")

    def mixed_documents(self) -> DataFrame:
        """doc_id, source, epoch, text: what the mix takes of each document, a row for each epoch that takes some.

        A document that an epoch takes whole keeps its text as it is; of others the taken runs of words
        remain as they are in the text, joined by \\n.  Needs with_text.  Carried columns follow, one with the name of these as carried_<name>.
        """
        runs = self.parts().groupBy("source_no", "part", "no", "epoch").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("runs"))  # blocks of one document at most
        keyed = runs.join(self.rows.select("source_no", "part", "no", "row_key"), ["source_no", "part", "no"]).select("row_key", "epoch", "runs")
        joined = keyed.hint("merge").join(self.texts, "row_key")  # the only shuffle of texts
        rows = joined.select("doc_id", "source", "epoch", "size", "raw", F.transform("runs", lambda r: r.lo).alias("lo"), F.transform("runs", lambda r: r.hi).alias("hi"), "_carried")
        kind = self.rows.schema["doc_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in bounded(batches, "raw", 2 << 20):
                out = []
                for size, text, lo, hi in zip(*(b.column(i).to_pylist() for i in (3, 4, 5, 6))):
                    if sum(hi) - sum(lo) == size:
                        out.append(text.decode())
                        continue
                    ink = np.concatenate([[False], ~np.isin(np.frombuffer(text, np.uint8), [9, 10, 11, 12, 13, 32]), [False]])
                    edges = np.flatnonzero(ink[1:] != ink[:-1])
                    pieces, k = [], 0
                    while k < len(lo):
                        m = k
                        while m + 1 < len(lo) and lo[m + 1] == hi[m]:
                            m += 1
                        pieces.append(text[edges[2 * lo[k]] : edges[2 * hi[m] - 1]].decode())
                        k = m + 1
                    out.append("\n".join(pieces))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.string()), b.column(7)], ["doc_id", "source", "epoch", "text", "_carried"])

        made = rows.mapInArrow(run, f"doc_id {kind}, source string, epoch int, text string, _carried {self.texts.schema['_carried'].dataType.simpleString()}")
        ours = ("doc_id", "source", "epoch", "text")
        return made.select(*ours, *given_back(self.carry, ours))
