"""Near-duplicate groups of documents by word shingles.

Signatures are SuperMinHash: element by element, slot p[j] of a pseudorandom permutation p gets the
value j + r, r uniform, if that is smaller than what it has, for j = 0, 1, ...; an element stops at the
first j above all its document's values.  All elements of many documents take step j together, so
elements of long documents stop after a step or two.

Bands of equal slots make buckets.  Documents of equal shingle sets are one (their representative).  In
each bucket all documents are checked against the bucket's hub, the smallest document, on full sets; the
links found are joined to components.  Where a bucket still has several components, documents outside the
bucket's largest component are checked, in bounded blocks, against all of the bucket's documents in
other components, again on full sets.  No pair that shares a bucket and isn't already connected
is left out, so whether two documents are linked depends on the banding alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm._shared import Scratch, blobs, bounded, groups, mix64, need, words

#: Slots are BANDS x ROWS.  A pair of similarity s shares no bucket with probability (1 - s**ROWS)**BANDS: 4e-7 at 0.85.
BANDS, ROWS = 25, 5
#: Documents of a block in the second check: a task holds two blocks' texts.
BLOCK = 512
#: Documents that are checked against one hub in one part.
PART = 256


def shingles(raw: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each shingle, repeats included; a text of fewer words has one shingle, of all its words."""
    h, _, text = words(raw, at, lower=True)
    count = np.bincount(text, minlength=len(at) - 1)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    n = np.where(count == 0, 0, np.maximum(count - size + 1, 1))
    owner = np.repeat(np.arange(len(n)), n)
    where = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    out = np.zeros(len(where), np.uint64)
    span = np.minimum(count[owner], size)
    for k in range(size):
        on = k < span
        out[on] = mix64(out[on] ^ h[where[on] + k])
    return mix64(out ^ span.astype(np.uint64)), owner


def distinct(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's shingles once, sorted."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], owner[new]


def super_minhash(h: np.ndarray, owner: np.ndarray, docs: int, slots: int) -> np.ndarray:
    """Signatures, docs x slots.  A value is step << 32 | random bits; documents without elements have the largest value."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(docs * slots, empty, np.uint64)
    active = np.arange(len(h))
    perm = None
    for j in range(slots):
        if not len(active):
            break
        e = h[active]
        x = mix64(e ^ mix64(np.array([j + 1], np.uint64)))
        k = j + ((x >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        value = np.uint64(j) << np.uint64(32) | (x & np.uint64(0xFFFFFFFF))
        if j == 0:
            slot = k
        else:
            rows = np.arange(len(active))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[rows, j]
            perm[rows, j] = slot
        np.minimum.at(sig, owner[active] * slots + slot, value)
        # an element goes on as long as its document has a value above the next step's smallest
        top = sig.reshape(docs, slots).max(axis=1) >> np.uint64(32)
        on = top[owner[active]] >= j + 1
        if j == 0:
            active, first = active[on], k[on]
            perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(active), 1))
            rows = np.arange(len(active))
            perm[rows, 0], perm[rows, first] = first, 0
        else:
            active, perm = active[on], perm[on]
    return sig.reshape(docs, slots)


def _sign(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (a 128-bit key of the set), bands, hint (16 bits of each slot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "raw", 1 << 20):
            raw, at = blobs(b.column(1))
            n = len(at) - 1
            h, owner = distinct(*shingles(raw, at, size))
            count = np.bincount(owner, minlength=n)
            keys = []
            for seed in (1, 2):
                sums = np.zeros(n + 1, np.uint64)
                sums[1:] = np.cumsum(count)
                total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(h ^ np.uint64(seed * 0x5851F42D4C957F2D % 2**64)), dtype=np.uint64)])
                keys.append(mix64(total[sums[1:].astype(np.int64)] - total[sums[:-1].astype(np.int64)] + count.astype(np.uint64)).view(np.int64))
            sig = super_minhash(h, owner, n, BANDS * ROWS)
            bands = np.zeros((n, BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for r in range(ROWS):
                bands = mix64((bands ^ sig[:, r::ROWS]).ravel()).reshape(n, BANDS)
            flat = pa.array(bands.view(np.int64).ravel())
            hint = mix64(sig.ravel()).astype(np.uint16).reshape(n, -1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(count.astype(np.int64)), pa.array(keys[0]), pa.array(keys[1]), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), flat), pa.array([x.tobytes() for x in hint], pa.binary())],
                ["doc_id", "n_shingles", "s1", "s2", "bands", "hint"],
            )

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, bands array<bigint>, hint binary")


class Similar:
    """Whether 100 * intersection >= percent * union, on sorted distinct shingle arrays."""

    def __init__(self, percent: int):
        self.percent = percent

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if 100 * min(len(a), len(b)) < self.percent * max(len(a), len(b)):
            return False
        if len(a) > len(b):
            a, b = b, a
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        common = int((b[at] == a).sum()) if len(b) else 0
        return 100 * common >= self.percent * (len(a) + len(b) - common)


def _sets(raws: list[bytes], size: int) -> list[np.ndarray]:
    at = np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)
    h, owner = distinct(*shingles(np.frombuffer(b"".join(raws), np.uint8), at, size))
    return np.split(h, np.searchsorted(owner, np.arange(1, len(raws))))


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """doc, root: the smallest document reachable, for documents with links.  Union-find by alternating stars.

    Each round links every document's larger neighbours to its smallest one (large star), then its
    smaller neighbours (small star), with the result written; the number of rounds grows with the
    logarithm of a component's diameter.  All counts stay on the cluster but for one sum a round.
    """
    current = scratch.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), name)  # with the work that finds edges
    last = None
    while True:
        check = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not check[0] or last == tuple(check):
            return current.select(F.col("a").alias("doc"), F.col("b").alias("root"))
        last = tuple(check)
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.write(large.filter("a <> b").distinct(), name, light=True)
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        after = scratch.write(small.filter("a <> b").distinct(), name, light=True)
        scratch.drop(current, large)
        current = after


def row_key(doc_id: Column, text: Column) -> Column:
    """The id, or for a null one a number from 2**62 up, from the text."""
    made = F.xxhash64(F.coalesce(text.cast("binary"), F.lit(b""))).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    return F.coalesce(doc_id.cast("bigint"), made)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row.

    Words are maximal runs without ASCII white space, A-Z lower-cased; a set is the distinct `size`-word
    shingles.  Documents with 100 * intersection >= percent * union are linked.  component_id is the smallest
    id reachable.  Null texts and texts without words have an empty set and stay alone.  Rows of equal id are
    one document if their sets are equal; ids must tell other documents apart.  Rows of null id are told apart by their texts, come after ids below 2**62, and have a
    null id in the result; so has a group without another id.  Other columns are left out.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup")
    rows = need(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("raw"))
    missing = scratch.write(rows.filter("id IS NULL").select(row_key(F.col("id"), F.col("raw")).alias("key")).distinct(), "null-ids")
    rows = rows.select(row_key(F.col("id"), F.col("raw")).alias("doc_id"), "raw")
    signed = scratch.write(_sign(rows, size), "signed")
    # equal sets: one representative
    full = signed.filter("n_shingles > 0")
    firsts = full.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"))
    seen = F.row_number().over(Window.partitionBy("rep").orderBy("s1"))  # repeated rows of an id have one set
    own = full.select(F.col("doc_id").alias("rep"), "s1", "s2", "bands", "hint").join(firsts, ["s1", "s2", "rep"])
    reps = scratch.write(own.withColumn("_n", seen).filter("_n = 1").drop("_n"), "reps")
    exploded = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    hubs = exploded.groupBy("band", "key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("docs")).filter("docs > 1")
    members = scratch.write(exploded.join(hubs, ["band", "key"]), "members")
    stars = members.filter("rep <> hub").groupBy("hub", "rep").agg(F.min("band").alias("band"))
    links = scratch.write(_check_stars(scratch, rows, stars, size, percent), "star-links")
    roots = components(scratch, links, "star-roots")
    # buckets that still hold several components
    big = members.filter("docs > 2")
    rooted = big.join(roots, big["rep"] == roots["doc"], "left").withColumn("root", F.coalesce("root", "rep")).drop("doc")
    per = rooted.groupBy("band", "key", "root").agg(F.count(F.lit(1)).alias("n"))
    open_ = per.groupBy("band", "key").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    open_ = open_.select("band", "key", F.col("m.root").alias("main"), (F.col("all") - F.col("m.n")).alias("others"))
    left = scratch.write(rooted.join(open_, ["band", "key"]), "open")
    more = _check_blocks(rows, reps, left, size, percent)
    roots = components(scratch, links.unionByName(more), "roots")
    named = signed.join(reps.select("s1", "s2", "rep"), ["s1", "s2"], "left")
    out = named.join(roots, named["rep"] == roots["doc"], "left")
    component = F.coalesce("root", "rep", "doc_id")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(component).alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    if missing.isEmpty():
        return out
    for c in ("doc_id", "component_id"):
        out = out.join(missing, out[c] == missing["key"], "left").withColumn(c, F.when(F.col("key").isNull(), F.col(c))).drop("key")
    return out


def _check_stars(scratch: Scratch, rows: DataFrame, stars: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: hubs and documents that are linked.  A hub's documents are dealt in parts of about PART, each with the hub's text."""
    sizes = stars.groupBy("hub").agg(F.count(F.lit(1)).alias("docs"))
    pairs = stars.join(sizes, "hub").select("hub", "rep", F.pmod(F.xxhash64("rep"), F.ceil(F.col("docs") / PART)).cast("int").alias("part"))
    pairs = scratch.write(pairs, "stars")
    heads = pairs.select(F.col("hub").alias("doc"), "hub", F.col("hub").alias("rep"), "part", F.lit(False).alias("follows")).distinct()
    asked = heads.unionByName(pairs.select(F.col("rep").alias("doc"), "hub", "rep", "part", F.lit(True).alias("follows")))
    # texts are always shuffled, once: a broadcast of what is asked for would only do for small tables
    dealt = asked.hint("merge").join(rows, asked["doc"] == rows["doc_id"]).select("hub", "part", "rep", "raw", "follows").withColumn("task", F.xxhash64("hub", "part"))
    dealt = dealt.repartition("task").sortWithinPartitions("task", "hub", "part", "follows", "rep")
    same = Similar(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, head = None, None
        for b in bounded(batches, "raw", 1 << 20):
            hubs, parts_, reps = (b.column(i).to_numpy() for i in (0, 1, 2))
            sets = _sets(b.column(3).to_pylist(), size)
            follows = b.column(4).to_pylist()
            a, c = [], []
            for i in range(b.num_rows):
                if not follows[i]:
                    hub, head = (hubs[i], parts_[i]), sets[i]
                elif hub != (hubs[i], parts_[i]):
                    raise ValueError("a hub's text is missing")
                elif same.linked(head, sets[i]):
                    a.append(int(reps[i])), c.append(int(hubs[i]))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(c, pa.int64())})

    return dealt.select("hub", "part", "rep", "raw", "follows").mapInArrow(run, "a bigint, b bigint")


def _check_blocks(rows: DataFrame, reps: DataFrame, left: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: links between components of a bucket, enough to join them.

    left: band, key, rep, root, main, docs and others (documents of the bucket, and those outside its main component).  The others are
    dealt in blocks, all documents in other blocks, and each block of others meets each block of all.  First on signatures, which
    cheaply excludes pairs far below the threshold (by over 5 standard deviations) and pairs that meet in an earlier band; then on
    full texts, sent only where needed.
    """
    slots = BANDS * ROWS
    s = percent / 100
    least = int(slots * (s - 5.2 * (s * (1 - s) / slots) ** 0.5))
    mark = F.xxhash64("rep")
    parts = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    dealt = left.withColumns({"rows": parts("others"), "columns": parts("docs"), "apart": F.col("root") != F.col("main")})
    dealt = dealt.withColumns({"i": F.pmod(mark, F.col("rows")).cast("int"), "j": F.pmod(mark, F.col("columns")).cast("int")})
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sides = dealt.select("band", "key", "rep", "root", "apart", F.lit(True).alias("right"), every("rows").alias("i"), "j")
    lefts = dealt.filter("apart").select("band", "key", "rep", "root", "apart", F.lit(False).alias("right"), "i", every("columns").alias("j"))
    both = sides.unionByName(lefts)
    both = both.join(reps.select("rep", "bands", "hint"), "rep").withColumn("task", F.xxhash64("band", "key", "i", "j"))
    both = both.select("task", "band", "rep", "root", "apart", "right", "bands", "hint").repartition("task").sortWithinPartitions("task", "right", "rep")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "task"):
            t = t.combine_chunks()
            right, apart = (t.column(c).to_numpy(zero_copy_only=False) for c in ("right", "apart"))
            rep, root = t.column("rep").to_numpy(), t.column("root").to_numpy()
            band = t.column("band")[0].as_py()
            hint = np.frombuffer(b"".join(t.column("hint").to_pylist()), np.uint16).reshape(len(rep), slots)
            lists = t.column("bands").combine_chunks()
            bands = (lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists).flatten().to_numpy().reshape(len(rep), BANDS)
            l, r = np.flatnonzero(~right), np.flatnonzero(right)
            doc, partners = [], []
            for x in l:
                y = r[(root[r] != root[x]) & (~apart[r] | (rep[r] > rep[x]))]  # two others meet twice
                if band:
                    y = y[~(bands[y, :band] == bands[x, :band]).any(axis=1)]
                y = y[(hint[y] == hint[x]).sum(axis=1) >= least]
                if len(y):
                    doc.append(int(rep[x])), partners.append(rep[y])
            if doc:
                task = t.column("task")[0].as_py()
                others = np.unique(np.concatenate(partners))
                others = others[~np.isin(others, doc)]
                n = len(doc) + len(others)
                yield pa.RecordBatch.from_pydict({"task": pa.array([task] * n, pa.int64()), "rep": pa.array(doc + others.tolist(), pa.int64()), "partners": pa.array([p.tolist() for p in partners] + [[]] * len(others), pa.list_(pa.int64()))})

    found = both.mapInArrow(candidates, "task bigint, rep bigint, partners array<bigint>")  # read once, as the links are
    texts = found.hint("merge").join(rows, found["rep"] == rows["doc_id"]).select("task", "rep", "partners", "raw").repartition("task").sortWithinPartitions("task", "rep")
    same = Similar(percent)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "task"):
            reps_ = t.column("rep").to_pylist()
            place = {d: i for i, d in enumerate(reps_)}
            partners = t.column("partners").to_pylist()
            sets = _sets(t.column("raw").to_pylist(), size)
            parent = list(range(len(reps_)))

            def find(i: int) -> int:
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            a, b = [], []
            for i, others in enumerate(partners):
                for d in others:
                    j = place[d]
                    if find(i) != find(j) and same.linked(sets[i], sets[j]):
                        parent[find(i)] = find(j)
                        a.append(reps_[i]), b.append(d)
            if a:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return texts.mapInArrow(verify, "a bigint, b bigint")
