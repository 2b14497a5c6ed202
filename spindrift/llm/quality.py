"""Rule counts and a learnt quality score for documents, in Arrow batches.

The classifier is a logistic regression over hashed n-grams: words, word pairs, and runs of 4 bytes, each
family averaged over the document so that length doesn't count.  It is fitted on at most `max_rows` labelled
rows, half of each class (features are made on the executors; a document's feature list is bounded by
the number of buckets), and its probabilities are calibrated on a held-out fifth, weighted back to the
classes' shares among all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm._shared import blobs, bounded, mix64, need, words

BITS = 17
FAMILIES = 3
SYMBOLS = "#*$%&|<>"
_SCALE = 8.0


def grams(raw: np.ndarray, at: np.ndarray, h: np.ndarray, text: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bucket and text of each feature, one pair for each family.  h, text: word hashes and their texts."""
    shift = np.uint64(64 - BITS)
    pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    same = text[:-1] == text[1:]
    out = [((h >> shift).astype(np.int32), text), ((mix64(pair[same]) >> shift).astype(np.int32) + (1 << BITS), text[:-1][same])]
    if len(raw) >= 4:
        four = raw[:-3].astype(np.uint32)
        for k in (1, 2, 3):
            four |= raw[k : len(raw) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
        four *= np.uint32(0x9E3779B1)
        four ^= four >> np.uint32(15)
        four *= np.uint32(0x85EBCA6B)
        four >>= np.uint32(32 - BITS)
        owner = np.repeat(np.arange(len(at) - 1), np.maximum(np.diff(at) - 3, 0))
        size = np.maximum(np.diff(at) - 3, 0)
        where = np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        out.append((four[where].astype(np.int32) + (2 << BITS), owner))
    else:
        out.append((np.zeros(0, np.int32), np.zeros(0, np.int64)))
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0  # calibration
    shift: float = 0.0
    report: dict = field(default_factory=dict)

    def logits(self, raw: np.ndarray, at: np.ndarray, h: np.ndarray, text: np.ndarray) -> np.ndarray:
        n = len(at) - 1
        z = np.full(n, self.bias)
        for bucket, owner in grams(raw, at, h, text):
            z += _SCALE * np.bincount(owner, self.weights[bucket], n) / np.maximum(np.bincount(owner, minlength=n), 1)
        return z

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))


def _features(docs: DataFrame) -> DataFrame:
    """label, bucket list, value list of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "raw", 1 << 20):
            raw, at = blobs(b.column(0))
            h, _, text = words(raw, at, lower=True)
            n = len(at) - 1
            keys, values = [], []
            for bucket, owner in grams(raw, at, h, text):
                total = np.maximum(np.bincount(owner, minlength=n), 1)
                key, count = np.unique(owner.astype(np.int64) << 32 | bucket, return_counts=True)
                keys.append(key), values.append(count / total[key >> 32])
            key, value = np.concatenate(keys), np.concatenate(values).astype(np.float32)
            order = np.argsort(key, kind="stable")
            cuts = np.searchsorted(key[order] >> 32, np.arange(1, n))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(np.split((key[order] & 0xFFFFFFFF).astype(np.int32), cuts) if n else [], pa.list_(pa.int32())), pa.array(np.split(value[order], cuts) if n else [], pa.list_(pa.float32()))], ["label", "buckets", "values"])

    return docs.mapInArrow(run, "label int, buckets array<int>, values array<float>")


def _fit(y: np.ndarray, bucket: np.ndarray, value: np.ndarray, owner: np.ndarray, steps: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the logistic loss."""
    size = FAMILIES << BITS
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    x = value * np.float32(_SCALE)
    w32 = w.astype(np.float32)
    for t in range(1, steps + 1):
        w32[:] = w
        z = b + np.bincount(owner, x * w32[bucket], len(y))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        grad = np.bincount(bucket, x * g.astype(np.float32)[owner], size) + decay * w
        gb = g.sum()
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        mb += 0.1 * (gb - mb)
        vb += 0.01 * (gb * gb - vb)
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, b


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 3000, label_col: str = "quality", steps: int = 60, rate: float = 0.05, decay: float = 1e-6) -> Model | None:
    """Fit and calibrate; None where there is nothing to learn from (no labelled row of one of the classes).

    Labels other than 0 and 1, null ids and labels of unknown documents are left out; of a document
    labelled twice the lower label holds.  The sample is in order of a hash of the id, so reruns agree.
    """
    known = need(labels, "doc_id", label_col).select(F.col("doc_id").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.filter(F.col("_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("_id").agg(F.min("label").alias("label"))
    share = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(share) < 2:
        return None
    picks = [known.filter(F.col("label") == k).orderBy(F.xxhash64("_id"), "_id").limit(max_rows // 2) for k in (0, 1)]
    sample = F.broadcast(picks[0].unionByName(picks[1]))  # max_rows rows at most
    rows = need(docs, "doc_id", "text").select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"))
    table = _features(rows.join(sample, F.col("doc_id") == F.col("_id")).select("raw", "label")).toArrow().combine_chunks()
    y = table.column("label").to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return None
    lists = table.column("buckets").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    value = table.column("values").combine_chunks()
    value = value.chunk(0) if isinstance(value, pa.ChunkedArray) else value
    size = np.diff(lists.offsets.to_numpy())
    offsets = lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
    bucket, value = lists.flatten().to_numpy(), value.flatten().to_numpy()
    del table, lists
    # a document's side of the split follows its features, not its place in the table
    sums = np.add.reduceat(np.append(mix64(bucket.astype(np.uint64)), np.uint64(0)), offsets[:-1]) * (size > 0).astype(np.uint64)
    order = np.lexsort((sums, y))
    held = np.zeros(len(y), bool)
    held[order[mix64(sums[order]) % np.uint64(5) == 0]] = True
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held[:] = False
        held[order[::5]] = True
    owner = np.repeat(np.arange(len(y), dtype=np.int32), size)
    place = (np.cumsum(~held) - 1).astype(np.int32)
    on = ~held[owner]
    w, b = _fit(y[~held], bucket[on], value[on], place[owner[on]], steps, rate, decay)
    z = b + np.bincount(owner, np.float32(_SCALE) * value * w.astype(np.float32)[bucket], len(y))
    model = Model(w.astype(np.float32), b)
    # Platt's scaling, with each class weighted to its share among all labelled rows
    zc, yc = z[held], y[held]
    weight = np.where(yc == 1, share[1] / max((yc == 1).sum(), 1), share[0] / max((yc == 0).sum(), 1)) / (share[0] + share[1])
    pos, neg = (yc == 1).sum(), (yc == 0).sum()
    target = np.where(yc == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    p = np.array([1.0, float(np.log(share[1] / share[0]))])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(p[0] * zc + p[1], -30, 30)))
        r, s = weight * (q - target), weight * q * (1 - q) + 1e-9
        hess = np.array([[(s * zc * zc).sum() + 1e-9, (s * zc).sum()], [(s * zc).sum(), s.sum() + 1e-9]])
        d = np.linalg.solve(hess, [(r * zc).sum(), r.sum()])
        p -= np.clip(d, -1, 1)
    model.slope, model.shift = max(float(p[0]), 1e-3), float(p[1])
    good = model.probability(zc)
    model.report = {"fitted": int((~held).sum()), "held_out": int(held.sum()), "good": [float(np.mean(good[yc == 1] >= t)) for t in (0.1, 0.2, 0.3, 0.5)], "bad": [float(np.mean(good[yc == 0] < t)) for t in (0.1, 0.2, 0.3, 0.5)]}
    return model


def repeated_words(h: np.ndarray, text: np.ndarray, texts: int, window: int = 5) -> np.ndarray:
    """For each text, how many words are in a window of words that it holds twice or more."""
    n = len(h)
    if n < window:
        return np.zeros(texts, np.int64)
    key = mix64(text[: n - window + 1].astype(np.uint64))
    for k in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[k : n - window + 1 + k]
    key = mix64(key)
    whole = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
    order = whole[np.argsort(key[whole])]
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    mark = np.zeros(n + 1, np.int32)
    mark[order[twice]] += 1
    mark[order[twice] + window] -= 1
    return np.bincount(text[np.cumsum(mark[:-1]) > 0], minlength=texts)


def rule_counts(b: pa.RecordBatch, column: int, raw: np.ndarray, at: np.ndarray, h: np.ndarray, text: np.ndarray) -> dict[str, np.ndarray]:
    n = len(at) - 1
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    blank = np.concatenate([[0], np.cumsum((raw == 32) | (raw - np.uint8(9) <= 4))])
    mark = np.zeros(256, bool)
    mark[list(SYMBOLS.encode())] = True
    marks = np.concatenate([[0], np.cumsum(mark[raw])])
    dup = np.zeros(n, np.int64)
    for i, t in enumerate(b.column(column).to_pylist()):
        if b"\n" in t:
            lines = [x for x in t.split(b"\n") if x and not x.isspace()]
            dup[i] = len(lines) - len(set(lines))
    of = lambda c: (c[at[1:]] - c[at[:-1]]).astype(np.int64)
    return {"n_words": np.bincount(text, minlength=n).astype(np.int64), "word_chars": of(points) - of(blank), "n_symbols": of(marks), "n_dup_lines": dup, "n_repeat_words": repeated_words(h, text, n).astype(np.int64)}


def quality(docs: DataFrame, model: Model | None, min_words: int = 10, max_repeat_percent: int = 20, threshold: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    One pass, no shuffle, a row for each row.  Null text has no words and fails the base rules, as do
    empty texts.  score is the calibrated probability of good quality (null without a model; the base
    rules alone decide then).  Whole texts of any length; equal texts get equal results; extra columns
    are left out but for those named in `carry`, which come last.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    others = [c for c in carry if c != "text"]
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw")
    rows = need(docs, *dict.fromkeys(("doc_id", "text", *others))).select("doc_id", raw, F.col("text").isNull().alias("_none"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(others)])
    held = docs.sparkSession.sparkContext.broadcast(model)  # FAMILIES << BITS weights
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in bounded(batches, "raw", 1 << 20):
            raw, at = blobs(b.column(1))
            exact, _, text = words(raw, at, lower=False)
            out = rule_counts(b, 1, raw, at, exact, text)
            failed = (out["n_words"] < min_words) | (100 * out["n_repeat_words"] > max_repeat_percent * out["n_words"])
            if m is None:
                score, good = pa.nulls(b.num_rows, pa.float64()), ~failed
            else:
                lowered, _, text = words(raw, at, lower=True)
                p = m.probability(m.logits(raw, at, lowered, text))
                score, good = pa.array(p), ~failed & (p >= threshold)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(out[c]) for c in columns], pa.array(failed), score, pa.array(good), *(b.columns[1:] if carry else [])], ["doc_id", *columns, "base_failed", "score", "kept", *(b.schema.names[1:] if carry else [])])

    more = ", raw binary, _none boolean" + "".join(f", _{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(others)) if carry else ""
    out = rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in columns) + ", base_failed boolean, score double, kept boolean" + more)
    own = ["doc_id", *columns, "base_failed", "score", "kept"]
    text = F.when(F.col("_none"), None).otherwise(F.col("raw").cast("string")).alias("text")
    return out.select(*own, *[text if c == "text" else F.col(f"_{others.index(c)}").alias(c) for c in carry if c not in own])
