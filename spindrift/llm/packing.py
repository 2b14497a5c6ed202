"""Packing pieces of documents into as few fixed-length sequences as possible.

The lengths' histogram, which has at most `capacity` entries whatever the corpus, goes to the driver.
A configuration (a multiset of lengths that fits one sequence) is a column of a covering linear
program: the least number of sequences so that every length is covered as often as it occurs.  It is
solved by multiplicative weights: a length's price is its weight, which falls as the length gets covered, and the
dearest configurations at these prices are found by bounded-knapsack dynamic programming, one for each length that
it holds.  Prices also bound the program from below (their total over the dearest configuration's), so rounds
end when the multiplicities, divided by the least coverage, are near that bound.

Rounding goes in passes.  Configurations that the best prices hold worth a full sequence are taken as often as the
whole part of their multiplicity, then once more, as long as their pieces last; the program is solved
again for what is left.  Only the last half percent of the pieces, or what no such configuration fits, is packed best fit.  The plan is a
list of (configuration, multiplicity), so its size doesn't grow with the number of documents.  Each piece then finds
its place from its rank among pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm._shared import Scratch, bounded, free_name, need, salts
from spindrift.llm.tokens import encoder

#: A configuration: ((length, how often), ...), longest first.
Config = tuple[tuple[int, int], ...]


class Knapsack:
    """Dearest multisets of lengths within a room, no length more often than it occurs.

    A length is split into items of 1, 2, 4, ... copies, so that the dynamic program is one vector step an item.
    """

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, capacity: int):
        self.capacity = capacity
        of, copies = [], []
        for j in np.argsort(-lengths):
            left, k = min(int(counts[j]), capacity // int(lengths[j])), 1
            while left:
                k = min(k, left)
                of.append(int(j)), copies.append(k)
                left, k = left - k, 2 * k
        self.of, self.copies = np.array(of), np.array(copies)
        self.size = lengths[self.of] * self.copies

    def solve(self, price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The greatest price for each room, and for each item and room whether the item is taken there."""
        best = np.zeros(self.capacity + 1)
        taken = np.zeros((len(self.of), self.capacity + 1), bool)
        for i, (size, value) in enumerate(zip(self.size.tolist(), (price[self.of] * self.copies).tolist())):
            gain = best[: self.capacity + 1 - size] + value
            np.greater(gain, best[size:], out=taken[i, size:])
            np.maximum(best[size:], gain, out=best[size:])
        return best, taken

    def contents(self, taken: np.ndarray, rooms: np.ndarray) -> list[dict[int, int]]:
        """What is in each of the rooms, as length index -> copies; all rooms are traced together."""
        room = rooms.copy()
        out: list[dict[int, int]] = [{} for _ in rooms]
        for i in range(len(self.of) - 1, -1, -1):
            hit = np.flatnonzero(taken[i][room])
            if len(hit):
                room[hit] -= self.size[i]
                j, k = int(self.of[i]), int(self.copies[i])
                for r in hit.tolist():
                    out[r][j] = out[r].get(j, 0) + k
        return out


#: A round adds at most STEP to a length's coverage; its weight falls by exp(-RATE * coverage); configurations within
#: NEAR of the dearest are taken.  Rounds end when multiplicities are within GAP of the lower bound.  After PHASE rounds
#: without that the rate is halved for twice as many, and so on, as slower weights come nearer; if PHASE rounds have
#: not gained 1 %, what is covered by then is rounded.
STEP, RATE, NEAR, GAP, PHASE = 0.2, 4.0, 0.03, 0.2, 200


def solve_lp(lengths: np.ndarray, counts: np.ndarray, capacity: int, gap: float = GAP) -> tuple[list[tuple[dict[int, int], float]], np.ndarray, float]:
    """Configurations with fractional multiplicities that cover every length; prices at which no configuration is worth more than 1; a lower bound.

    The first prices are the lengths, which solve the dual program if nothing need be wasted.  Where other prices bound
    better, a gap of a 20th is asked for, as rounding then goes by prices that are only as good as the gap.
    """
    sack = Knapsack(lengths, counts, capacity)
    often = counts.tolist()
    covered = np.zeros(len(lengths))
    found: dict[tuple, float] = {}
    bound, total, dual, flat = 0.0, 0.0, None, 0.0
    rate, phase, rounds, added = RATE, PHASE, 0, []
    mean = np.zeros(len(lengths))
    reached, since = np.inf, 0

    def take(config: dict[int, int], x: float) -> None:
        nonlocal total
        for k, n in config.items():
            added[k] += x * n / often[k]
        key = tuple(sorted(config.items()))
        found[key] = found.get(key, 0.0) + x
        total += x

    while True:
        rounds += 1
        if rounds > phase:
            rate, phase = rate / 2, 3 * phase
        price = lengths * np.exp(-rate * (covered - covered.min()))
        best, taken = sack.solve(price)
        top = best[capacity]
        below = float((price * counts).sum() / top)
        if below > bound:
            bound, dual = below, price / top
        flat = flat or bound
        # each length's configuration that is near the dearest, the scarcest lengths first
        own = np.flatnonzero(price + best[capacity - lengths] >= (1 - NEAR) * top)
        own = own[np.argsort(covered[own], kind="stable")]
        added = [0.0] * len(often)
        value = price.tolist()
        for j, config in zip(own.tolist(), sack.contents(taken, capacity - lengths[own])):
            config[j] = min(config.get(j, 0) + 1, often[j])
            if added[j] >= STEP:
                continue
            x = min((STEP - added[k]) * often[k] / n for k, n in config.items())
            if x > 1e-3 * STEP * often[j] / config[j]:
                take(config, x)
            # the scarcest of them gets its whole step, if need be without lengths that have had theirs
            while j == own[0] and added[j] < STEP * 0.999:
                config = {k: n for k, n in config.items() if added[k] < STEP * 0.999}
                if sum(value[k] * n for k, n in config.items()) < (1 - NEAR) * top:
                    break
                take(config, min((STEP - added[k]) * often[k] / n for k, n in config.items()))
        covered += added
        least = float(covered.min())
        mean += price / (price * counts).sum()
        if not rounds % 20:  # the mean of all prices is nearer to the dual solution than any round's
            top = sack.solve(mean)[0][capacity]
            if (below := float((mean * counts).sum() / top)) > bound:
                bound, dual = below, mean / top
        if least > 0 and total < 0.99 * reached * least:
            reached, since = total / least, rounds
        if least > 0 and (total <= (1 + (gap if bound == flat else gap / 20)) * least * bound or rounds - since > PHASE):
            return [(dict(c), x / least) for c, x in found.items()], dual, bound


def round_down(parts: list[tuple[dict[int, int], float]], worth: np.ndarray, left: np.ndarray, slack: float = 1e-9) -> list[tuple[dict[int, int], int]]:
    """Whole multiplicities of the configurations worth a full sequence but for slack, as far as pieces last; `left` is reduced.

    Configurations of few pieces come first: what is left is then small and easier to place.
    """
    full = [(c, x) for c, x in parts if sum(worth[j] * n for j, n in c.items()) >= 1 - slack]
    full.sort(key=lambda p: (sum(p[0].values()), -p[1]) if slack < 1e-6 else -sum(worth[j] * n for j, n in p[0].items()))
    out = []
    for whole in (True, False):
        for config, x in full:
            times = min(int(x) if whole else 1, min(int(left[j]) // n for j, n in config.items()))
            if times > 0:
                for j, n in config.items():
                    left[j] -= times * n
                out.append((config, times))
    return out


def best_fit(lengths: list[int], counts: list[int], capacity: int) -> list[tuple[Config, int]]:
    """Longest first into the fullest sequence that has room, for all pieces of a length at once.

    Open sequences of equal contents are one entry with a multiplicity, so the work follows the number
    of different lengths and contents, not of pieces.
    """
    open_: dict[int, list[list]] = {}
    free: list[int] = []

    def put(room: int, items: tuple, times: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(free, room)
        open_[room].append([items, times])

    for size, left in sorted(zip(lengths, counts), reverse=True):
        while left:
            at = bisect_left(free, size)
            if at == len(free):
                each = capacity // size
                if left >= each:
                    put(capacity - each * size, ((size, each),), left // each)
                    left %= each
                else:
                    put(capacity - left * size, ((size, left),), 1)
                    left = 0
                continue
            room = free[at]
            items, times = open_[room].pop()
            if not open_[room]:
                del open_[room]
                free.pop(at)
            each = min(room // size, left)
            use = min(times, left // each)
            if use < times:
                put(room, items, times - use)
            put(room - each * size, items + ((size, each),), use)
            left -= use * each
    return [(items, times) for groups in open_.values() for items, times in groups]


def plan(histogram: dict[int, int], capacity: int, gap: float = GAP) -> tuple[list[tuple[Config, int]], int]:
    """Configurations and how many sequences have each, holding every piece once; and how many pieces came by the linear program."""
    out: list[tuple[Config, int]] = []
    if capacity in histogram:
        out.append((((capacity, 1),), histogram[capacity]))
    lengths = np.array(sorted(n for n in histogram if n < capacity), np.int64)
    if not len(lengths):
        return out, 0
    if lengths[0] < 1 or max(histogram) > capacity:
        raise ValueError("lengths must be from 1 to the capacity")
    counts = np.array([histogram[int(n)] for n in lengths], np.int64)
    left = counts.copy()
    while 200 * int(left.sum()) > int(counts.sum()):
        on = np.flatnonzero(left)
        size, here = lengths[on], left[on]
        before = int(here.sum())
        parts, worth, bound = solve_lp(size, here.copy(), capacity, gap)
        flat = int((size * here).sum()) / capacity
        slack = 1e-9 if bound <= flat * (1 + 1e-9) else 2 * (sum(x for _, x in parts) / bound - 1)
        for config, times in round_down(parts, worth, here, slack):
            out.append((tuple(sorted(((int(size[j]), n) for j, n in config.items()), reverse=True)), times))
        left[on] = here
        if before - int(here.sum()) < before / 10:
            break
    by_program = int(counts.sum() - left.sum())
    rest = [(int(n), int(c)) for n, c in zip(lengths, left) if c]
    if rest:
        out += best_fit([n for n, _ in rest], [c for _, c in rest], capacity)
    return out, by_program


class Places:
    """rank among the pieces of a length -> sequence and offset."""

    def __init__(self, configs: list[tuple[Config, int]]):
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        first = 0
        filled: dict[int, int] = {}
        for items, times in configs:
            offset = 0
            for size, each in items:
                rank = filled.get(size, 0)
                runs.setdefault(size, []).append((rank, first, offset, each))
                filled[size] = rank + each * times
                offset += size * each
            first += times
        self.sequences = first
        self.runs = {size: np.array(r, np.int64).T for size, r in runs.items()}

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        sizes, at = np.unique(length[order], return_index=True)
        for size, rows in zip(sizes, np.split(order, at[1:])):
            starts, first, before, each = self.runs[int(size)]
            r = rank[rows]
            k = np.searchsorted(starts, r, side="right") - 1
            q = r - starts[k]
            sequence[rows] = first[k] + q // each[k]
            offset[rows] = before[k] + q % each[k] * size
        return sequence, offset


def pack(pieces: DataFrame, capacity: int, length_col: str = "length", each: int = 1_000, gap: float = GAP) -> DataFrame:
    """The rows with sequence_id and offset: sequences are gapless from 0 and hold `capacity` at most.

    `pieces` must be a table that reads the same each time (written, not sampled), with lengths from 1
    to the capacity; null lengths raise.  Columns already named sequence_id or offset are replaced, others stay whatever
    their names.  Equal rows are told apart by order and get places of their own.  A length's pieces are ranked in parts
    of about `each` rows, whose sizes are summed up, so no length, however common, is ranked in one task.  An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    part, size_, part_, n_, base_, rank = (free_name(pieces, n) for n in ("part", "size", "p", "n", "base", "rank"))
    size = F.col(f"`{length_col}`")
    hist = {r[0]: r[1] for r in pieces.groupBy(size.cast("bigint").alias("n")).count().collect()}  # capacity rows at most
    if None in hist:
        raise ValueError("a piece has no length")
    if hist and (min(hist) < 1 or max(hist) > capacity):
        raise ValueError("lengths must be from 1 to the capacity")
    places = spark.sparkContext.broadcast(Places(plan(hist, capacity, gap)[0]))  # bounded by the number of lengths
    ids = [F.col(f"`{c}`") for c in pieces.columns]
    split = {n: salts(c, each) for n, c in hist.items() if c > each}
    parts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in split.items() for x in kv]), size.cast("int")), F.lit(1)) if split else F.lit(1)  # capacity entries at most
    dealt = pieces.withColumn(part, F.pmod(F.xxhash64(*ids), parts).cast("int"))
    ranked = dealt.withColumn(rank, (F.row_number().over(Window.partitionBy(size, part).orderBy(*ids)) - 1).cast("bigint"))
    if split:
        sums = dealt.filter(size.isin(*split)).groupBy(size.alias(size_), F.col(part).alias(part_)).agg(F.count(F.lit(1)).alias(n_))
        base = sums.select(size_, part_, (F.sum(n_).over(Window.partitionBy(size_).orderBy(part_)) - F.col(n_)).alias(base_))
        ranked = ranked.join(base, (size == F.col(size_)) & (F.col(part) == F.col(part_)), "left").withColumn(rank, F.col(rank) + F.coalesce(F.col(base_), F.lit(0)))
    ranked = ranked.select(*ids, rank)
    kept = len(pieces.columns)
    where = pieces.columns.index(length_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = places.value.of(b.column(where).to_numpy().astype(np.int64), b.column(kept).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.array(sequence), pa.array(offset)], [*b.schema.names[:kept], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def cut(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of token ids: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its ids and end_id.  Only longer ones than the capacity are cut; all pieces but the
    first then have the full length.  Null text counts as empty: its only piece is end_id.
    """
    rows = need(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("raw"))
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary)
        for b in bounded(batches, "raw", 1 << 20 if with_ids else 4 << 20):
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, raw in enumerate(b.column(1).to_pylist()):
                data = memoryview(tokens.ids(raw) + end)
                n, at, k = len(data) // 4, 0, 0
                while at < n:
                    size = (n - 1) % capacity + 1 if not at else capacity
                    part = data[4 * at : 4 * (at + size)]
                    doc.append(i), piece.append(k), start.append(at), length.append(size), crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                    at, k = at + size, k + 1
            out = {"doc_id": b.column(0).take(pa.array(doc, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:
                out["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, **columns) -> DataFrame:
    """Tokenise, cut and pack: the pieces with sequence_id and offset.  Tokens are made once and written."""
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(scratch.write(cut(docs, vocabulary, capacity, end_id, with_ids, **columns), "pieces"), capacity)
