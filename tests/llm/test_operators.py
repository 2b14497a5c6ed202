"""Every operator against a plain restatement, on tables with nulls, empty and long texts, ties, repeated rows,
clashing extra columns, and on empty tables."""

import hashlib
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from spindrift.llm import fingerprints, lines, mixing, near_dup, packing, quality, records, repeats, tokens, url_filter  # noqa: E402
from spindrift.llm._shared import Scratch, blobs, bounded  # noqa: E402, F401

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PASSAGE = "the same long passage is found in several documents of this small corpus and has to be found there every time, " * 3
LONG = " ".join(f"w{i * i % 977}x{i}" for i in range(9000))
TEXTS = [
    None, "", " \n\t ", "one", "one two three", "One TWO three", "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu",
    "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", LONG, LONG + " tail", "start " + PASSAGE + "end", "begin " + PASSAGE + "stop", PASSAGE,
    "école Ünïcode ßtraße 日本語 🙂 <|endoftext|> <|ENDOFTEXT|>\x1c!\x1f a b", "line\nLine \n\nother\nline", "a" * 700, "line\nrare line here",
    *["shared boilerplate line\nunique %d text of its own" % i for i in range(12)],
]
SOURCES = ["s%d" % (i % 3) if i % 7 else None for i in range(len(TEXTS))]
#: Extra columns with names that the operators use inside.
EXTRA = ["lang", "length", "row", "raw", "part", "no", "g", "h", "kept", "size", "rep", "uid", "text2"]
WORDS = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, s, *[f"{c}{i}" for c in EXTRA]) for i, (t, s) in enumerate(zip(TEXTS, SOURCES))]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def text(i):
    return TEXTS[i] or ""


def shingle_sets(size):
    out = []
    for t in TEXTS:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, empty, size, percent):
    sets = shingle_sets(size)
    root = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs, size, percent).collect()}
    assert [got[i].component_id for i in range(len(sets))] == root
    assert [got[i].n_shingles for i in range(len(sets))] == [len(s) for s in sets]
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert near_dup.near_duplicates(empty, size, percent).count() == 0
    assert near_dup.near_duplicates(docs.unionByName(docs), size, percent).filter("kept").select("doc_id").distinct().count() == sum(i == r for i, r in enumerate(root))


def test_near_duplicate_chain_within_buckets(spark):
    """Documents that only link through others, in buckets whose hub isn't like all of them."""
    base = [f"word{i}" for i in range(200)]
    rng = np.random.default_rng(5)
    rows = []
    for k in range(60):
        w = list(base)
        for i in rng.choice(200, k % 12, replace=False):
            w[i] = f"x{k}y{i}"
        rows.append((k, " ".join(w)))
    sets = [{tuple(t.split()[i : i + 3]) for i in range(198)} for _, t in rows]
    root = list(range(60))
    for _ in range(60):
        for i in range(60):
            for j in range(60):
                if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert [got[k] for k in range(60)] == root


def test_near_duplicates_of_a_large_hub(spark, monkeypatch):
    """A hub's documents go in many parts; repeated rows of an id are one."""
    monkeypatch.setattr(near_dup, "PART", 4)
    base = [f"word{i}" for i in range(120)]
    rows = [(k, " ".join(base + [f"end{k}"])) for k in range(50)] + [(100 + k, " ".join(base)) for k in range(5)] + [(3, " ".join(base + ["end3"]))]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert len(got) == 56 and {r.component_id for r in got} == {0}


def test_near_duplicates_of_negative_ids(spark):
    words = [[f"g{g}w{k}" for k in range(60)] for g in range(2)]
    rows = [(-10 + g * 2 + k, " ".join(words[g] + [f"end{k}"] * k)) for g in range(2) for k in range(2)]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got == {-10: -10, -9: -10, -8: -8, -7: -8}


def test_near_duplicates_of_null_ids(spark):
    words = [" ".join(f"g{g}w{k}" for k in range(60)) for g in range(3)]
    rows = [(None, words[0]), (7, words[0] + " end"), (None, words[1]), (None, words[1] + " end"), (3, words[2]), (None, None)]
    got = [tuple(r) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert len(got) == 6 and {(7, 57, 7, True), (3, 56, 3, True), (None, 56, 7, False), (None, 0, None, True)} <= set(got)
    assert sorted(kept for d, n, c, kept in got if d is None and n and c is None) == [False, True]


def test_superminhash_estimates_similarity_with_less_variance():
    rng = np.random.default_rng(0)
    for n in (4, 40, 1500):
        found = []
        for _ in range(40):
            u = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
            a, b = u[: 3 * n // 2], u[n // 2 :]
            s = near_dup.super_minhash(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, 125)
            found.append((s[0] == s[1]).mean())
        assert abs(np.mean(found) - 0.5) < 0.03
        assert np.std(found) < 1.3 * (0.25 / 125) ** 0.5


@lru_cache
def library(path):
    return Tokenizer.from_file(path)


def encoded(t, path, end):
    return library(path).encode(t or "", add_special_tokens=False).ids + [end]


def test_packing(docs, empty):
    want = {}
    for i, t in enumerate(TEXTS):
        ids, at, k = encoded(t, BYTE, 0), 0, 0
        while at < len(ids):
            n = (len(ids) - 1) % 2048 + 1 if not at else 2048
            want[i, k] = (at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()))
            at, k = at + n, k + 1
    rows = packing.pack_documents(docs, BYTE).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    check_sequences(rows, 2048)
    assert len({r.sequence_id for r in rows}) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.pack_documents(empty, BYTE).count() == 0
    twice = packing.pack_documents(docs.unionByName(docs), BYTE, with_ids=True).collect()
    check_sequences(twice, 2048)
    assert all(len(r.ids) == r.length for r in twice)


def check_sequences(rows, capacity):
    held = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == held.get(r.sequence_id, 0)
        held[r.sequence_id] = r.offset + r.length
    assert max(held.values(), default=0) <= capacity


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 400), max_size=30))
def test_plan_holds_every_piece_once(hist):
    configs, _ = packing.plan(hist, 60)
    held = Counter()
    for items, times in configs:
        assert sum(n * k for n, k in items) <= 60
        for n, k in items:
            held[n] += k * times
    assert held == Counter(hist)
    places = packing.Places(configs)
    size = np.repeat(list(hist), list(hist.values())).astype(np.int64)
    rank = np.concatenate([np.arange(k) for k in hist.values()] or [np.zeros(0)]).astype(np.int64)
    sequence, offset = places.of(size, rank)
    for s in range(places.sequences):
        on = np.flatnonzero(sequence == s)
        on = on[np.argsort(offset[on])]
        assert (offset[on] == np.cumsum(size[on]) - size[on]).all()


def test_plan_packs_by_the_linear_program():
    """At least nine tenths of the pieces are placed by the program, in no more sequences than best fit alone needs and one."""
    rng = np.random.default_rng(3)
    for pieces, spread in ((2_000, 1.0), (20_000, 0.7), (3_000_000, 1.0)):
        size = np.clip(rng.lognormal(5.5, spread, pieces).astype(int), 1, 2047)
        hist = {int(n): int(c) for n, c in zip(*np.unique(size, return_counts=True))}
        configs, placed = packing.plan(hist, 2048)
        alone = packing.best_fit(list(hist), list(hist.values()), 2048)
        assert placed >= 0.9 * pieces
        assert sum(t for _, t in configs) <= 1.0001 * sum(t for _, t in alone) + 1


def test_linear_program_covers_every_length_within_its_bound():
    rng = np.random.default_rng(4)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 200, 12))
        counts = rng.integers(1, 50, len(lengths))
        parts, worth, bound = packing.solve_lp(lengths, counts, 200)
        covered = np.zeros(len(lengths))
        for config, x in parts:
            assert sum(lengths[j] * n for j, n in config.items()) <= 200
            assert sum(worth[j] * n for j, n in config.items()) <= 1 + 1e-9
            for j, n in config.items():
                covered[j] += x * n
        assert (covered >= counts * (1 - 1e-9)).all()
        assert (worth * counts).sum() == pytest.approx(bound)
        assert bound <= sum(x for _, x in parts) <= 1.2 * bound + 1e-6


def test_packing_replaces_columns_of_its_names(spark):
    names = ("sequence_id", "offset", "_part", "_rank", "_base", "_size", "_p", "_n")
    rows = spark.range(30).select((F.col("id") % 9 + 1).alias("length"), *[F.col("id").alias(n) for n in names])
    got = packing.pack(Scratch(spark, "test").write(rows, "pieces"), 20, each=2).collect()
    check_sequences(got, 20)
    assert sorted(r._rank for r in got) == list(range(30))


def test_hot_length_is_ranked_in_parts(spark):
    table = Scratch(spark, "test").write(spark.range(500).select(F.col("id").alias("k"), F.lit(7).cast("long").alias("length")), "pieces")
    rows = packing.pack(table, 20, each=40).collect()
    check_sequences(rows, 20)
    assert len({r.sequence_id for r in rows}) == 250


@pytest.mark.parametrize("block", [1, 7, 128])
def test_mixing(docs, empty, block):
    rows = mixing.Mix(docs, block=block, each=4).taken().collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(TEXTS)))
    size = {i: len(WORDS.findall(text(i))) for i in range(len(TEXTS))}
    total, by, aim = Counter(), Counter(), {}
    for r in rows:
        assert r.size == size[r.doc_id] and r.taken <= 2 * r.size
        total[r.source] += r.size
        by[r.source] += r.taken
        aim[r.source] = (r.target, r.source_size)
    order = sorted(s for s in total if s is not None) + [None]
    want = mixing.targets([total[s] for s in order], [3, 1, 2, 3][: len(order)], 1.5, 2)
    for s, t in zip(order, want):
        assert aim[s] == (pytest.approx(t), total[s]) and abs(by[s] - t) <= 1
    assert sum(want) == pytest.approx(1.5 * sum(total.values()))
    assert mixing.Mix(empty).taken().count() == 0
    again = mixing.Mix(docs.repartition(5), block=block, each=4).taken().collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in rows}


def test_mixed_texts_are_the_words_taken(docs):
    mix = mixing.Mix(docs, block=7, with_text=True, each=4, carry=("lang", "raw", "no", "text"))
    taken = {r.doc_id: r.taken for r in mix.taken().collect()}
    found = Counter()
    for r in mix.mixed_documents().collect():
        words = WORDS.findall(r.text)
        assert set(words) <= set(WORDS.findall(text(r.doc_id))) and (r.lang, r.raw, r.no) == tuple(f"{c}{r.doc_id}" for c in ("lang", "raw", "no")) and r.carried_text == TEXTS[r.doc_id]
        found[r.doc_id] += len(words)
    assert all(found[i] == n for i, n in taken.items())


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutation(n):
    p = mixing.Permutation(n, 3, 4)
    image = p.of(np.arange(n))
    assert sorted(image) == list(range(n)) and (p.place(image) == np.arange(n)).all()


def test_shards_meet_quotas():
    quotas = np.array([0, 5, 1000, 37])
    drawn = mixing.draw_shards(quotas, 9, 1)
    assert (drawn.sum(axis=0) == quotas).all() and drawn.sum(axis=1).max() - drawn.sum(axis=1).min() <= 1


def test_line_dedup(docs, empty):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    count = Counter(k for i in range(len(TEXTS)) for k in {key(x) for x in text(i).split("\n")} if k)
    for min_docs in (2, 10):
        for batches in (1, 5):
            got = {r.doc_id: r for r in lines.dedup_lines(docs, min_docs, batches=batches, fanout=2).collect()}
            for i in range(len(TEXTS)):
                rows = text(i).split("\n")
                kept = [x for x in rows if count[key(x)] < min_docs]
                assert (got[i].n_lines, got[i].n_dropped, got[i].kept) == (len(rows), len(rows) - len(kept), "\n".join(kept))
    assert lines.dedup_lines(empty).count() == 0
    assert lines.dedup_lines(docs.unionByName(docs), 2).filter("kept = ''").count() >= 2 * len(TEXTS) - 2


def test_line_runs_are_joined_without_exchange(spark):
    runs = lines.LineRuns(spark, 3, fanout=4)
    batch = lambda k: spark.range(100).select((F.col("id") % k).alias("h1"), F.lit(7).cast("long").alias("h2"))
    for k in (50, 30, 10):
        runs.add(batch(k))
    planned = lambda df: df._jdf.queryExecution().executedPlan().toString()
    with lines.setting(spark, lines.ORDERED, "true"):
        first, second = runs.runs()[:2]
        joined = planned(first.hint("merge").join(second.select("h1", "h2"), ["h1", "h2"], "left_anti"))
    assert "SortMergeJoin" in joined and "Exchange" not in joined and "Sort [" not in joined
    assert sorted(r.h1 for r in runs.repeated().collect()) == list(range(30))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("spindrift_run_")]


def test_line_dedup_carries_columns_of_any_name(docs):
    for r in lines.dedup_lines(docs, carry=("row", "kept", "text2")).collect():
        assert (r.row, r.carried_kept, r.text2) == (f"row{r.doc_id}", f"kept{r.doc_id}", f"text2{r.doc_id}")


def test_mixing_of_many_sources(spark):
    """More sources than counts of a dense plan could hold for many shards: fewer shards, the same targets."""
    table = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 1500).cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"))
    mix = mixing.Mix(table, block=2, each=1)
    taken = Counter()
    for r in mix.taken().collect():
        taken[r.source if "source" in r else None] += r.taken
    assert sum(taken.values()) == pytest.approx(1.5 * sum(mix.sizes), abs=len(mix.sources))


def test_line_dedup_stays_native(docs):
    plan = lines.dedup_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_fingerprints(docs, empty):
    rows = {r.doc_id: r for r in fingerprints.fingerprints(docs, 1, 0.0).collect()}
    n = len(TEXTS)
    for i in range(n):
        k = len(text(i)) // 4
        edited = text(i)[: len(text(i)) - k] + text((i + 1) % n)[:k]
        assert rows[i].n_chars == len(text(i)) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
        for j in range(n):
            if text(i) == text(j):
                assert rows[i].fingerprint == rows[j].fingerprint
    assert rows[6].near_next == 1.0  # an exact copy follows
    assert rows[8].fingerprint != rows[10].fingerprint
    assert fingerprints.fingerprints(empty).count() == 0
    assert fingerprints.fingerprints(docs.filter("doc_id = 8")).collect()[0].near_next == 1.0


def xx(data, seed=42):
    import xxhash

    n = xxhash.xxh64_intdigest(data, seed % 2**64)
    return n - 2**64 if n >= 2**63 else n


def plain_terms(t):
    return {xx(w.encode()) for w in re.split("[ \\t-\\r]+", t.lower()) if w}


def plain_hash(found, member):
    part = sorted(t for t in found if member(t % 2**64))
    seed = 42
    for t in part:
        seed = xx((t % 2**64).to_bytes(8, "little"), seed)
    return f"{seed & 0xFFFFFFFF:08x}" if part else "-" * 8


def plain_subsets():
    """Sparse levels of 1/32 to 1/2048, eight subsets each; dense ones of two times four quarters and eight eighths."""
    bits = lambda t, r: ((t >> 8 * r) if r < 7 else (t >> 56 | t << 8)) & 0xFFFF
    sparse = [lambda t, level=level, r=r: bits(t, r) % 2**level == 0 for level in (5, 7, 9, 11) for r in range(8)]
    dense = [lambda t, at=at, r=r: (t >> at) % 4 == r for at in (20, 50) for r in range(4)] + [lambda t, r=r: (t >> 34) % 8 == r for r in range(8)]
    return sparse, dense


def plain_likeness(a, b):
    if a == b:
        return 1.0
    best = 0.0
    for i in range(12):
        x, y = a[8 * i : 8 * i + 8], b[8 * i : 8 * i + 8]
        if min(len(a), len(b)) >= 8 * i + 8:
            said = sum(p != "-" * 8 or q != "-" * 8 for p, q in zip(x, y))
            same = sum(p == q != "-" * 8 for p, q in zip(x, y))
            best = max(best, same / max(said, 1 if i % 6 >= 4 else 4))
    return best


def plain_prints(texts, min_docs, min_idf):
    """fingerprint, edited fingerprint, near_edited, near_next of each text, restated one text at a time."""
    sparse, dense = plain_subsets()
    known, weight = Counter(), Counter()
    for t in texts:
        known.update(plain_terms(t))
    for t in set(texts):
        weight.update(plain_terms(t))
    most = max(int(len(set(texts)) * np.exp(-min_idf)), min_docs)
    lexicon = {t for t, n in known.items() if n >= min_docs}
    band = {t for t in lexicon if weight[t] <= most}
    sampled = lambda found: {t for t in found & band if any(m(t % 2**64) for m in sparse[:8])}
    out = []
    for i, t in enumerate(texts):
        k = len(t) // 4
        edited = t[: len(t) - k] + texts[(i + 1) % len(texts)][:k]
        own, other = plain_terms(t), plain_terms(edited)
        a, b = ([plain_hash(sampled(x), m) for m in sparse] for x in (own, other))
        few = len(sampled(own)) < 8
        if (few or len(sampled(other)) < 8) and (own | other) & lexicon:
            outside = few and 8 * len(own & band) < len(own & lexicon)
            b += [plain_hash(other & band, m) for m in dense] + [plain_hash(other & lexicon, m) for m in (sparse + dense) * outside]
            if few:
                a += [plain_hash(own & band, m) for m in dense] + [plain_hash(own & lexicon, m) for m in (sparse + dense) * outside]
        a, b = (p if any(x != "-" * 8 for x in p) else [f"x{xx(x.encode()) % 2**64:x}"] for p, x in ((a, t), (b, edited)))
        out.append((a, b))
    return [("".join(a), "".join(b), plain_likeness(a, b), plain_likeness(a, out[(i + 1) % len(out)][0])) for i, (a, b) in enumerate(out)]


@pytest.mark.parametrize("min_docs,min_idf", [(1, 0.0), (2, 1.0), (2, 3.0)])
def test_fingerprints_as_restated(spark, min_docs, min_idf):
    rng = np.random.default_rng(9)
    texts = [t or "" for t in TEXTS] + [" ".join(f"v{int(k)}" for k in rng.integers(0, 400, n)) for n in rng.integers(1, 300, 60)]
    texts += [texts[30] + " one more", texts[30]] + ["common words only"] * 9 + [f"common words only {k}" for k in range(9)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = sorted(fingerprints.fingerprints(table, min_docs, min_idf).collect(), key=lambda r: r.doc_id)
    for r, want in zip(got, plain_prints(texts, min_docs, min_idf), strict=True):
        assert (r.fingerprint, r.edited_fingerprint) == want[:2], r.doc_id
        assert (r.near_edited, r.near_next) == pytest.approx(want[2:]), r.doc_id


def test_fingerprints_of_equal_rows(spark):
    """All but the last of equal rows are followed by their like."""
    table = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "e f g h"), (None, "n")], "doc_id long, text string")
    want = Counter(hashlib.sha256(t.encode()).hexdigest() for t in ("a b c a", "a b c a", "a b c e", "e f g n", "n"))
    rows = fingerprints.fingerprints(table, 1, 0.0).collect()
    assert len(rows) == 5 and Counter(r.edited_sha256 for r in rows) == want


def test_fingerprints_of_a_large_group_of_near_copies(spark):
    common = [f"common{k}" for k in range(80)]
    group = [" ".join(common[:k] + [f"changed{k}"] + common[k + 1 :]) for k in range(40)]
    rest = [" ".join(f"v{(i * 7 + k * k) % 300}" for k in range(60)) for i in range(60)]
    exact = [rest[0]] * 50  # weigh once, so that the terms of rest[0] stay in the band
    table = spark.createDataFrame(list(enumerate(group + rest + exact)), "doc_id long, text string")
    rows = sorted(fingerprints.fingerprints(table, 2, 1.0).collect(), key=lambda r: r.doc_id)
    assert all(not r.fingerprint.startswith("x") for r in rows[:40])
    assert sum(r.near_next > 0.5 for r in rows[:39]) >= 35 and sum(r.near_edited > 0 for r in rows[:39]) >= 35
    assert {r.fingerprint for r in rows[100:]} == {rows[40].fingerprint} and not rows[40].fingerprint.startswith("x")


def test_fingerprints_of_short_texts(spark):
    texts = [t for i in range(60) for t in (f"one{i} two{i} three{i} four{i} five{i} six{i}", f"one{i} two{i} three{i} four{i} five{i} other{i}")]
    alone = [t for i in range(30) for t in (f"only{i}", f"only{i} new{i}")]  # one term in the band
    rows = sorted(fingerprints.fingerprints(spark.createDataFrame(list(enumerate(texts + alone)), "doc_id long, text string")).collect(), key=lambda r: r.doc_id)
    assert not any(r.fingerprint.startswith("x") for r in rows)
    assert all(r.near_next == 1.0 for r in rows[::2])  # their terms in the lexicon are equal
    assert sum(r.near_edited > 0.3 for r in rows[:120]) >= 110


@pytest.mark.parametrize("width,hot", [(20, 20_000), (20, 0), (201, 20_000), (2, 3)])
def test_repeats(docs, empty, width, hot):
    raws = [text(i).encode() for i in range(len(TEXTS))]
    count = Counter(r[k : k + width] for r in raws for k in range(len(r) - width + 1))
    got = {r.doc_id: r for r in repeats.remove_repeats(docs, width, hot).collect()}
    for i, r in enumerate(raws):
        gone = np.zeros(len(r) + 1, int)
        for k in range(len(r) - width + 1):
            if count[r[k : k + width]] > 1:
                gone[k] += 1
                gone[k + width] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(r) else 0
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(r), len(r) - len(kept), spans, kept), i
    assert repeats.remove_repeats(empty, width).count() == 0


@pytest.mark.parametrize("width", [1, 2, 7, 8, 9, 64, 200])
def test_suffix_ranks_are_the_order_of_bytes(width):
    data = np.random.default_rng(width).integers(0, 2, 1500).astype(np.uint8).tobytes()
    suffixes = [data[i : i + width] for i in range(len(data) - width + 1)]
    place = {x: i for i, x in enumerate(sorted(set(suffixes)))}
    assert repeats.suffix_ranks(np.frombuffer(data, np.uint8), width).tolist() == [place[x] for x in suffixes]


def test_repeats_of_equal_rows(docs):
    twice = repeats.remove_repeats(docs.unionByName(docs), 5).collect()
    assert len(twice) == 2 * len(TEXTS) and all(r.n_removed == (r.n_bytes if r.n_bytes >= 5 else 0) for r in twice)


def test_url_filter(spark):
    captures = [(1, "http://A.b.example.com:80/x", 5), (1, "http://A.b.example.com:80/x", 5), (2, "https://u:p@example.com./", 9), (3, None, 5), (4, "no url", 5), (5, "http://other.org", None), (6, "http://b.example.com", 12), (7, "http://localhost/", 5), (8, "http://notexample.com/", 9)]
    table = spark.createDataFrame(captures, "page_id long, url string, fetched_at int").withColumn("entry", F.lit("clash")).withColumn("host", F.lit("clash"))
    events = spark.createDataFrame([("example.com", True, 8), ("example.com", False, 11), ("b.example.com", True, 1), ("b.example.com", True, 3), ("b.example.com", False, 6), ("localhost", True, 5), ("x", True, None), ("example.com", True, 12), ("example.com", False, 12)], "entry string, added boolean, at int")
    stays = {(r.entry, r.since, r.until) for r in url_filter.intervals(events).collect()}
    assert stays == {("example.com", 8, 11), ("b.example.com", 1, 6), ("localhost", 5, None)}
    got = sorted((r.page_id, r.matched, r.n_matches, r.blocked) for r in url_filter.filter_captures(table, events).collect())
    assert got == [(1, "b.example.com", 1, True), (1, "b.example.com", 1, True), (2, "example.com", 1, True), (3, None, 0, False), (4, None, 0, False), (5, None, 0, False), (6, None, 0, False), (7, "localhost", 1, True), (8, None, 0, False)]
    assert url_filter.filter_captures(table.limit(0), events).count() == 0 and url_filter.filter_captures(table, events.limit(0)).filter("blocked").count() == 0


def brute_counts(t):
    w = WORDS.findall(t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if WORDS.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeated)


def test_quality_counts(docs, empty):
    for r in quality.quality(docs, None).collect():
        n = brute_counts(text(r.doc_id))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and r.kept == (not r.base_failed)
    assert quality.quality(empty, None).count() == 0


def test_classifier_on_held_out_rows(spark):
    rng = np.random.default_rng(2)
    good, bad = [f"good{i}" for i in range(60)], [f"spam{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(good if i % 4 else bad, 30))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)] + [(None, 1), (9999, 0), (3, 1)], "doc_id long, quality int")
    model = quality.train(docs, marks, max_rows=300)
    got = {r.doc_id: r.kept for r in quality.quality(docs, model, max_repeat_percent=100).collect()}
    assert np.mean([got[i] == (i % 4 > 0) for i in range(400, 600)]) > 0.98
    assert quality.train(docs, marks.filter("quality = 1")) is None and quality.train(docs.limit(0), marks) is None


def test_records_round_trip(spark, docs, empty, tmp_path):
    place = f"file://{tmp_path}/files"
    manifest = Scratch(spark, "test").write(records.write_records(docs, place, WORD, 2, partitions=3), "manifest")
    rows = records.read_records(spark, manifest).orderBy("doc_id").collect()
    start = 0
    for i, r in enumerate(rows):
        ids = encoded(TEXTS[i], WORD, 2)
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    f = manifest.orderBy("shard").first()
    doc, ids = records.read_one(f.path, f.width, 2)
    assert ids.tolist() == encoded(TEXTS[doc], WORD, 2)
    none = records.write_records(empty, f"file://{tmp_path}/none", WORD, 2)
    assert records.read_records(spark, none).count() == 0
    path = f.path.removeprefix("file://") + ".rec"
    data = bytearray(open(path, "rb").read())
    data[30] ^= 1
    open(path, "wb").write(bytes(data))
    with pytest.raises(Exception, match="damaged"):
        records.read_records(spark, manifest).collect()


ODD = ["", " ", "a\t\n\tb  c d <|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "It's I'LL don't 12345 x²y ½", "日本語 テスト", "İstanbul ΣΑΣ ς", "a\x1cb !\x1c!", "🙂 👩‍👩‍👧 ﬁ", "x.\ny,\n\nz 'S", "À ̀a a ͅ", "a b　 c\x85d", "\n", " \na", "a \n", "x" * 3000]


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=150, deadline=None)
@given(st.one_of(st.sampled_from(ODD), st.text(), st.text(alphabet="aB é.,'\n\t<|>1日 ", max_size=40)))
def test_token_ids_and_counts_equal_the_library(path, t):
    want = library(path).encode(t, add_special_tokens=False).ids
    assert np.frombuffer(tokens.encoder(path).ids(t.encode()), "<u4").tolist() == want
    assert tokens.counter(path).count(t.encode()) == len(want)


def test_token_counts(docs, empty):
    for r in tokens.count_tokens(docs, WORD).collect():
        n = len(encoded(TEXTS[r.doc_id], WORD, 2)) - 1
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text(r.doc_id).encode()), n, n > 2048)
    assert tokens.count_tokens(empty, WORD).count() == 0


def test_cache_keeps_two_generations():
    calls = []
    c = tokens.Cache(lambda k: calls.append(k) or k, 2)
    assert [c[k] for k in (1, 2, 3, 1, 4, 1)] == [1, 2, 3, 1, 4, 1] and calls == [1, 2, 3, 4]
    assert len(c) + len(c.old) <= 4


def test_written_tables_are_few_plain_files_that_are_checked(spark, tmp_path, monkeypatch):
    import glob
    import os

    scratch = Scratch(spark, "test")
    monkeypatch.setattr(scratch, "root", f"file://{tmp_path}/scratch")
    with pytest.raises(Exception, match="(?i)checksum|crc"):
        table = scratch.write(spark.range(0, 50_000, 1, 3).withColumn("x", F.xxhash64("id")), "many")
        assert table.count() == 50_000 and len(glob.glob(f"{tmp_path}/scratch/*/part-*.parquet")) == 3
        assert not glob.glob(f"{tmp_path}/scratch/**/.*.crc", recursive=True, include_hidden=True)
        for path in glob.glob(f"{tmp_path}/scratch/*/part-*.parquet"):
            with open(path, "r+b") as f:  # one byte of a page
                f.seek(os.path.getsize(path) // 2)
                byte = f.read(1)[0]
                f.seek(-1, 1)
                f.write(bytes([byte ^ 1]))
        table.agg(F.sum("x")).collect()
    small = scratch.write(spark.range(0, 4000, 1, 3).groupBy(F.col("id") % 1000).count(), "light", light=True)
    assert small.count() == 1000 and len(glob.glob(f"{tmp_path}/scratch/*light/part-*.parquet")) == 1


def test_tables_read_once_are_not_written(docs, monkeypatch):
    names, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name, *a, **b: names.append(name) or write(self, df, name, *a, **b))
    near_dup.near_duplicates(docs, 3, 85)
    assert "signed" in names and not {"candidates", "block-links"} & set(names)


def test_repeats_leave_no_checksum_files(docs, tmp_path, monkeypatch):
    import glob

    monkeypatch.setattr(Scratch, "path", lambda self, name: f"file://{tmp_path}/{name}")
    assert repeats.remove_repeats(docs, 200).count() == len(TEXTS)
    assert glob.glob(f"{tmp_path}/dictionary/part-*") and not glob.glob(f"{tmp_path}/**/.*.crc", recursive=True, include_hidden=True)
