"""Removal of bytes covered by strings that occur more than once in the corpus.

Prefix-free parsing: triggers are rolling-hash minima.  Of every string of `width` bytes the leftmost smallest
gram (a run of width / 2 bytes) is its anchor, so equal strings have equal anchors at equal places, and
consecutive starts with one anchor make a phrase: an anchor's extent is all the bytes of these strings.
The extents are the dictionary; a document's parse is its sequence of extents.

The parse is put in order of (gram, extent), so that equal strings can only be within one gram.  An extent that
occurs twice has all its strings repeated.  A gram that occurs once has none.  What is left are entries that share a
gram but differ.  The entries of a gram are dealt together and their suffix array is built by prefix doubling over the
bytes: suffixes are ranked by their first 8 bytes, then 16, 32 and so on to `width`, so equal ranks mean equal
bytes, and neighbours in this order that have one rank are repeated strings.  No string of `width` bytes leaves its
extent and order beyond `width` bytes changes nothing, so entries take the place of the parse's own suffix array: what follows
an extent never decides.  Extents are told apart by 128 bits besides the gram's 64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm._shared import _BASE, _INVERSE, _LUT, Scratch, _powers, blobs, bounded, groups, mix64, need

#: Two independent byte values of the rolling hashes.
_FIRST, _SECOND = _LUT, mix64(_LUT ^ np.uint64(0x165667B19E3779F9))
#: Bytes of texts and of extents that a task works on at a time, however many rows they are; one text is always taken whole.
_PIECE = 1 << 20


class Rolling:
    """64-bit hashes of any spans of a byte buffer, from prefix sums."""

    def __init__(self, raw: np.ndarray, letters: np.ndarray = _FIRST):
        self.n = len(raw)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(letters[raw] * _powers(_BASE, self.n), dtype=np.uint64, out=self.sums[1:])
        self.inverse = _powers(_INVERSE, self.n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inverse[start])

    def all(self, width: int) -> np.ndarray:
        """Of every span of that width."""
        return mix64((self.sums[width:] - self.sums[: self.n + 1 - width]) * self.inverse[: self.n + 1 - width])


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value, leftmost among equals, of every `width` consecutive values."""
    n = len(h)
    packed = (h >> np.uint64(32)) << np.uint64(32) | np.arange(n, dtype=np.uint64)
    pad = -n % width
    full = np.concatenate([packed, np.full(pad, 0xFFFFFFFFFFFFFFFF, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[: n - width + 1], ahead[width - 1 : n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def parse(raw: np.ndarray, at: np.ndarray, width: int, half: int):
    """Anchors of all texts: (text, anchor, first and last window start, key of the anchor's gram, two keys of the extent)."""
    n = len(raw)
    if n < width:
        z = np.zeros(0, np.int64)
        return z, z, z, z, *[z.astype(np.uint64)] * 3
    roll = Rolling(raw)
    gram = width - half
    anchor = sliding_argmin(roll.all(gram), half + 1)  # for each start 0 .. n - width
    size = np.diff(at)
    ok = np.zeros(len(anchor) + 1, np.int32)
    whole = size >= width
    ok[at[:-1][whole]] += 1
    np.add.at(ok, np.minimum(at[1:][whole] - width + 1, len(anchor)), -1)
    s = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
    a = anchor[s]
    new = np.ones(len(s), bool)
    new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    lo, hi, t = s[first], s[last], a[first]
    text = np.searchsorted(at, lo, side="right") - 1
    g = roll.of(t, t + gram)
    shape = mix64(((t - lo) << 32 | (hi - lo)).astype(np.uint64))
    e, e2 = (mix64(r.of(lo, hi + width) ^ shape) for r in (roll, Rolling(raw, _SECOND)))
    return text, t, lo, hi, g, e, e2


def _classes(e: np.ndarray, e2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First index of each class of equal (e, e2), each element's class, and the classes' sizes."""
    order = np.lexsort((e2, e))
    new = np.ones(len(e), bool)
    new[1:] = (e[order][1:] != e[order][:-1]) | (e2[order][1:] != e2[order][:-1])
    of = np.empty(len(e), np.int64)
    of[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return order[first], of, np.diff(np.append(first, len(e)))


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of anchors sorted by (g, e, e2): those whose gram occurs twice or more, as kind, g, row, row2, lo, span.

    kind 0: the extent occurs twice or more; kind 1: it doesn't; kind 2: once for each repeated extent.
    Rows whose `many` is 1 stand for several of a batch, whose own runs come with 2 and pass through as kind 0.
    Only one batch and a row are held, however often a gram occurs.
    """
    pending, was = None, (False, False)
    schema = None

    def out(cols: list[np.ndarray], pg: np.ndarray, pe: np.ndarray, ng: np.ndarray, ne: np.ndarray) -> pa.RecordBatch:
        many = cols[-1]
        keep = (pg | ng) & (many < 2)
        kind = np.where(pe | ne | (many > 0), 0, 1)
        first = np.flatnonzero(keep & (ne | (many == 1)) & ~pe)
        rows = np.flatnonzero((keep & (many == 0)) | (many == 2))
        take = np.concatenate([rows, first])
        kinds = np.concatenate([kind[rows], np.full(len(first), 2)])
        keep_ = [0, 3, 4, 5, 6]
        return pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int8)), *[pa.array(cols[i][take]) for i in keep_]], ["kind", *[schema[i] for i in keep_]])

    for b in batches:
        if not b.num_rows:
            continue
        schema = b.schema.names
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if pending is not None:
            cols = [np.concatenate([p, c]) for p, c in zip(pending, cols)]
        g, e, e2 = cols[:3]
        sg = g[1:] == g[:-1]
        se = sg & (e[1:] == e[:-1]) & (e2[1:] == e2[:-1])
        pg, pe = np.concatenate([[was[0]], sg]), np.concatenate([[was[1]], se])
        pending, was = [c[-1:] for c in cols], (bool(pg[-1]), bool(pe[-1]))
        if len(g) > 1:
            yield out([c[:-1] for c in cols], pg[:-1], pe[:-1], sg, se)
    if pending is not None:
        no = np.zeros(1, bool)
        yield out(pending, np.array([was[0]]), np.array([was[1]]), no, no)


def _runs(s: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of consecutive s within equal key."""
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero((s[1:] != s[:-1] + 1) | (key[1:] != key[:-1])) + 1
    return np.concatenate([[0], cut]), np.append(cut, len(s)) - 1


def _windows(at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, owner and offset of every window of every extent."""
    count = np.diff(at) - width + 1
    owner = np.repeat(np.arange(len(count)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return at[owner] + offset, owner, offset


def suffix_ranks(data: np.ndarray, width: int) -> np.ndarray:
    """Rank of every suffix of the buffer, cut to `width` bytes, in the order of bytes: equal ranks mean equal bytes.

    Prefix doubling: ranks for k bytes, of a suffix and of the one k further on, give those for 2 k.  Suffixes of less than
    `width` bytes have no rank; there is one for each of the len(data) - width + 1 others.
    """
    if len(data) < width:
        return np.zeros(0, np.int64)
    have = min(8, width)
    key = np.zeros(len(data) - have + 1, np.uint64)
    for k in range(have):
        key = key << np.uint64(8) | data[k : k + len(key)]
    ranks = np.unique(key, return_inverse=True)[1]
    while have < width:
        step = min(have, width - have)
        both = ranks[: len(ranks) - step].astype(np.int64) * (int(ranks.max()) + 1) + ranks[step:]
        ranks = np.unique(both, return_inverse=True)[1]
        have += step
    return ranks


def repeated_bytes(docs: DataFrame, width: int = 200, hot: int = 5_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, raw, los, his for every row: the first and last starts of runs of repeated windows, in no order.

    `hot`: from how many different extents of one gram on windows are counted by a shuffle on 128 bits of hash
    rather than in one task; the result is the same.
    """
    if width < 2:
        raise ValueError("strings of 2 bytes at least")
    half = width // 2
    scratch = Scratch(docs.sparkSession, "repeats")
    rows = need(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("raw"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("\0null"))
    rows = rows.withColumns({"row": F.xxhash64(name, "raw"), "row2": F.xxhash64(F.lit(1), name, "raw")})  # 128 bits

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "raw", _PIECE):
            raw, at = blobs(b.column(1))
            text, t, lo, hi, g, e, e2 = parse(raw, at, width, half)
            # extents found twice here need no partner elsewhere: one stands for all, and their runs go as they are
            one, of, n = _classes(e, e2)
            again = n[of] > 1
            single = np.flatnonzero(~again)
            stands = one[n > 1]
            local = np.flatnonzero(again)
            joined = np.flatnonzero(np.concatenate([[True], (lo[local][1:] != hi[local][:-1] + 1) | (text[local][1:] != text[local][:-1])])) if len(local) else local
            start, stop = lo[local[joined]], hi[local[np.append(joined[1:], len(local)) - 1]] if len(local) else hi[local]
            owner = text[local[joined]]
            spread = mix64(b.column(0).to_numpy()[owner].view(np.uint64) + start.astype(np.uint64))
            take = np.concatenate([single, stands])
            of_row = np.concatenate([text[take], owner])
            yield pa.RecordBatch.from_pydict({
                "g": np.concatenate([g[take], spread]).view(np.int64),
                "e": np.concatenate([e[take], spread]).view(np.int64),
                "e2": np.concatenate([e2[take], spread]).view(np.int64),
                "row": b.column(0).to_numpy()[of_row],
                "row2": b.column(2).to_numpy()[of_row],
                "lo": np.concatenate([lo[take] - at[text[take]], start - at[owner]]),
                "span": np.concatenate([hi[take] - lo[take], stop - start]).astype(np.int32),
                "many": np.repeat(np.array([0, 1, 2], np.int8), [len(single), len(stands), len(start)]),
            })

    dealt = rows.select("row", "raw", "row2").mapInArrow(anchors, "g bigint, e bigint, e2 bigint, row bigint, row2 bigint, lo bigint, span int, many tinyint").repartition("g").sortWithinPartitions("g", "e", "e2")
    found = scratch.write(dealt.mapInArrow(_classify, "kind tinyint, g bigint, row bigint, row2 bigint, lo bigint, span int"), "anchors")
    unsure = found.filter("kind = 1")
    partners = found.filter("kind = 2").join(unsure.select("g").distinct(), "g", "left_semi")
    dictionary = unsure.unionByName(partners.select(*found.columns))
    wanted = dictionary.groupBy("row", "row2").agg(F.collect_list(F.struct("kind", "g", "lo", "span")).alias("parts"))  # of one document
    texts = rows.join(wanted, ["row", "row2"]).select("row", "raw", "row2", "parts.kind", "parts.g", "parts.lo", "parts.span")

    def extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "raw", _PIECE):
            out = {k: [] for k in ("g", "kind", "row", "row2", "lo", "extent")}
            for row, raw, row2, kinds, gs, los, spans in zip(*(c.to_pylist() for c in b.columns)):
                out["g"] += gs
                out["kind"] += kinds
                out["lo"] += los
                out["row"] += [row] * len(gs)
                out["row2"] += [row2] * len(gs)
                out["extent"] += [raw[lo : lo + span + width] for lo, span in zip(los, spans)]
            yield pa.RecordBatch.from_arrays([pa.array(out["g"], pa.int64()), pa.array(out["kind"], pa.int8()), pa.array(out["row"], pa.int64()), pa.array(out["row2"], pa.int64()), pa.array(out["lo"], pa.int64()), pa.array(out["extent"], pa.binary())], list(out))

    entries = scratch.write(texts.mapInArrow(extents, "g bigint, kind tinyint, row bigint, row2 bigint, lo bigint, extent binary"), "dictionary")
    many = entries.groupBy("g").count().filter(F.col("count") > hot).select("g")
    common = entries.join(many, "g", "left_anti").repartition("g").sortWithinPartitions("g")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def settle() -> pa.RecordBatch:
            t = pa.concat_tables(held).combine_chunks()
            kind, row, row2, lo = (t.column(k).to_numpy() for k in ("kind", "row", "row2", "lo"))
            data, at = blobs(t.column("extent"))
            start, owner, offset = _windows(at, width)
            rank = suffix_ranks(data, width)[start]  # equal strings have equal anchors, so they are of one gram
            twice = np.bincount(rank)[rank] > 1
            i = np.flatnonzero(twice & (kind[owner] == 1))
            a, z = _runs(offset[i], owner[i])
            own = owner[i[a]]
            return pa.RecordBatch.from_pydict({"row": row[own], "row2": row2[own], "lo": lo[own] + offset[i[a]], "hi": lo[own] + offset[i[z]]})

        for t in groups(batches, "g"):  # a group is at most `hot` entries; small ones are settled together
            held.append(t)
            size += t.column("extent").nbytes
            if size >= _PIECE:
                yield settle()
                held, size = [], 0
        if held:
            yield settle()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "extent", _PIECE):
            data, at = blobs(b.column(5))
            start, owner, offset = _windows(at, width)
            w, w2 = (Rolling(data, k).of(start, start + width).view(np.int64) for k in (_FIRST, _SECOND))
            yield pa.RecordBatch.from_pydict({"w": w, "w2": w2, "kind": b.column(1).to_numpy()[owner], "row": b.column(2).to_numpy()[owner], "row2": b.column(3).to_numpy()[owner], "lo": b.column(4).to_numpy()[owner] + offset})

    each = entries.join(many, "g", "left_semi").select(*entries.columns).mapInArrow(windows, "w bigint, w2 bigint, kind tinyint, row bigint, row2 bigint, lo bigint")
    twice = each.groupBy("w", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("w", "w2")
    split = each.filter("kind = 1").join(twice, ["w", "w2"], "left_semi").select("row", "row2", "lo", F.col("lo").alias("hi"))
    edges = scratch.write(common.mapInArrow(local, "row bigint, row2 bigint, lo bigint, hi bigint").unionByName(split), "edges")
    spans = found.filter("kind = 0").select("row", "row2", "lo", (F.col("lo") + F.col("span")).alias("hi")).unionByName(edges)
    flags = spans.groupBy("row", "row2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")).select("row", "row2", "spans.lo", "spans.hi")  # of one document
    return rows.join(flags, ["row", "row2"], "left").select("doc_id", "raw", F.col("lo").alias("los"), F.col("hi").alias("his"))


def remove_repeats(docs: DataFrame, width: int = 200, hot: int = 5_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) for every row.

    A byte goes if a string of `width` bytes that covers it also starts anywhere else, in any row or the same.
    Texts are UTF-8 bytes, whole; null counts as empty; shorter texts than `width` stay.  Rows that are equal
    in all columns are documents of their own and repeat each other.  Other columns are left out.
    """
    spans = repeated_bytes(docs, width, hot, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "raw", _PIECE):
            removed, runs, kept, sizes = [], [], [], []
            for raw, los, his in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                sizes.append(len(raw))
                if not los:
                    removed.append(0), runs.append(0), kept.append(raw)
                    continue
                lo = np.array(los)
                order = np.argsort(lo, kind="stable")
                lo, end = lo[order], np.maximum.accumulate(np.array(his)[order] + width)
                new = np.concatenate([[True], lo[1:] > end[:-1]])
                first, last = lo[new], end[np.append(np.flatnonzero(new)[1:], len(lo)) - 1]
                removed.append(int((last - first).sum())), runs.append(len(first))
                kept.append(b"".join(raw[a:z] for a, z in zip([0, *last.tolist()], [*first.tolist(), len(raw)])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return spans.mapInArrow(cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
