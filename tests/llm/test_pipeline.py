"""The pipeline's stages against plain restatements, each on the stage's own input."""

import os

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    from spindrift.llm._shared import Scratch

    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(scratch.write(stage(spark, tables[-1], SF), "stage"))
    assert [t.columns for t in tables[:5]] == [docs.columns] * 5
    rows = [{r.doc_id: r.text for r in t.collect()} for t in tables[:5]]
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    assert rows[1].items() <= rows[0].items()
    lost = good & rows[0].keys() - rows[1].keys()
    assert all(len(rows[0][d].split()) < 10 or len(set(rows[0][d].split())) < 0.9 * len(rows[0][d].split()) for d in lost)
    assert rows[2].keys() == rows[1].keys()
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    count = {}
    for t in rows[1].values():
        for k in {key(x) for x in t.split("\n")}:
            count[k] = count.get(k, 0) + 1
    assert rows[2] == {d: "\n".join(x for x in t.split("\n") if not key(x) or count[key(x)] < 10) for d, t in rows[1].items()}
    sets = {}
    for d, t in rows[2].items():
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    for a in sorted(sets):
        twins = [b for b in sets if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        assert (a in rows[3]) == (not twins)
    words = sum(len(t.split()) for t in rows[3].values())
    mixed = sum(len(r.text.split()) for r in tables[4].collect())
    assert abs(mixed - 1.5 * words) <= 25
    pieces = tables[5].collect()
    held = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == held.get(r.sequence_id, 0)
        held[r.sequence_id] = r.offset + r.length
    assert max(held.values()) <= 2048


def test_near_dedup_keeps_one_of_repeated_rows(spark):
    words = [" ".join(f"g{g}w{k}" for k in range(60)) for g in range(3)]
    rows = [(1, words[0]), (2, words[0] + " end"), (None, words[1]), (4, words[2]), (5, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows * 2], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.minhash_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in got.collect()))) == ["1", "4", "5", "None"]


ODD = "clean words of a text that goes on for some time without saying the same thing twice in any window at all "
LONG = " ".join(f"w{i * i % 9973}x{i}" for i in range(60_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in each column, empty and very long texts, ties, repeated rows, and extra columns with names of ours."""
    rows = [(1, ODD + "one", "en", "s", 9), (1, ODD + "one", "en", "s", 9), (None, ODD + "of null id", "en", "s", 9), (2, None, "en", "s", None), (3, "", None, None, 0), (4, LONG, "en", None, 9), (5, LONG + " tail", None, "s", 9)]
    rows += [(10 + i, f"shared line of many\nown{i} " + " ".join(f"u{i}k{k}" for k in range(30)), "en", "t", 9) for i in range(12)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, raw string, kept boolean, row int, h string, length string, target string"
    return spark.createDataFrame([(*r, "x", False, 1, "h", "l", "t") for r in rows], schema).repartition(3)


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def texts(table):
    return sorted((str(r.doc_id), r.text) for r in table.collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_quality_stage_of_odd_tables(spark, odd):
    kept = corpus_pipeline.quality_rules(spark, odd, SF)
    assert kept.columns == COLUMNS
    got = {r.doc_id for r in kept.collect()}
    assert not got & {2, 3} and got <= {1, None, 4, 5, *range(10, 22)}
    assert corpus_pipeline.quality_rules(spark, odd.limit(0), SF).count() == 0


def test_line_stage_of_odd_tables(spark, odd):
    out = corpus_pipeline.line_dedup(spark, odd, SF)
    assert out.columns == COLUMNS and out.filter("n_chars <> length(text)").count() == 0
    want = sorted((str(r.doc_id), (r.text or "").removeprefix("shared line of many\n")) for r in odd.collect())
    assert texts(out) == want
    assert corpus_pipeline.line_dedup(spark, odd.limit(0), SF).count() == 0


def test_near_dedup_stage_of_odd_tables(spark, odd):
    out = corpus_pipeline.minhash_dedup(spark, odd, SF)
    # one of the repeated rows, which the row of null id is like; one of the long texts
    assert out.columns == COLUMNS and sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, [1, 2, 3, 4, *range(10, 22)]))
    assert corpus_pipeline.minhash_dedup(spark, odd.limit(0), SF).count() == 0


def test_mixing_stage_of_odd_tables(spark, odd):
    out = corpus_pipeline.mix_sources(spark, odd, SF)
    rows = out.collect()
    assert out.columns == COLUMNS and not {2, 3} & {r.doc_id for r in rows}
    words = sum(len((r.text or "").split()) for r in odd.collect())
    assert abs(sum(len(r.text.split()) for r in rows) - 1.5 * words) <= 3
    assert corpus_pipeline.mix_sources(spark, odd.limit(0), SF).count() == 0


def test_packing_stage_of_odd_tables(spark, odd):
    rows = corpus_pipeline.best_fit_packing(spark, odd, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in odd.collect()} and sum(r.doc_id in (2, 3) and r.length == 1 for r in rows) == 2
    held = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == held.get(r.sequence_id, 0)
        held[r.sequence_id] = r.offset + r.length
    assert max(held.values()) <= 2048
    assert corpus_pipeline.best_fit_packing(spark, odd.limit(0), SF).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
