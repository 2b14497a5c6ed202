"""The engine's own operators on fixtures made here."""

import fnmatch
import io
import json
import re
import subprocess
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.functions import code as C
from spindrift.functions import text as T
from spindrift.operators import assistant_text, cache, graph, notebooks, render, search, sheets, styles, tags, trees
from spindrift.plans import queries, tools
from spindrift.plans.project import Options, ProjectDump
from spindrift.sources import files, notebooks as notebook_files, word_files, workbooks
from spindrift.streaming import events


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


# ---------------------------------------------------------------- text functions


def test_summaries(spark):
    cases = {
        '  """Doc\nstring"""\nx': "Doc\nstring", "'''a'''": "a", "/* b */ c": "b", "<!-- c -->": "c", "<!-- open": "", '"""open': "",
        "#!/bin/sh\n# two\n\n# three": "!/bin/sh\ntwo", "## T\ntext": "# T", "// x\n/// y\ncode": "x\ny", "x = 1\n# no": "", "": "", "﻿# bom": "",
    }
    rows = spark.createDataFrame(list(cases.items()), "c string, want string").select("want", T.summary(F.col("c")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_lines_and_caps(spark):
    for text in ("a\r\nb\rc\n", "a\n\nb", "", "\n", "a\x0cb\x85c d"):
        for n in (1, 2, 100):
            assert one(spark, T.first_lines(F.col("c"), n), c=text) == "\n".join(text.splitlines()[:n])
    assert one(spark, T.first_lines(F.col("c"), -1), c="a\nb\nc") == "a\nb"
    assert one(spark, files.capped(F.col("c"), 3 / 1024 / 1024), c="éé") == "" and one(spark, files.capped(F.col("c"), 4 / 1024 / 1024), c="éé") == "éé"


def test_names(spark):
    got = [tuple(r) for r in spark.createDataFrame([("a/b.Tar.GZ",), ("Dockerfile",), (".env",), ("x.",), ("d.d/f",)], "p string").select(T.extension(F.col("p")), T.stem(F.col("p"))).collect()]
    assert got == [(".gz", "b.Tar"), ("", "Dockerfile"), ("", ".env"), ("", "x."), ("", "f")]


PATTERNS = ["venv*", "*.dir", ".json", "[ab]?", "x[!y]", "a.b", "*", "q?*"]


def test_patterns_match_as_in_the_shell(spark):
    names = ["venv3", "xvenv", "a.dir", ".json", "x.json", "ab", "a", "xy", "xz", "a.b", "axb", "q", "qq", "A.DIR", "a\nb"]
    for p in PATTERNS:
        got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(T.matches_any(F.col("n"), [p])).collect()]
        assert got == [fnmatch.fnmatchcase(n, p) for n in names], p


def plain_tokens(text):
    low = text.lower()
    rest = re.sub(r"[a-z0-9_\s\W]+", "", low)
    return re.findall("[a-z0-9_]+", low) + ([rest[i : i + 2] for i in range(len(rest) - 1)] if len(rest) > 1 else [rest] if rest else [])


def test_search_tokens(spark):
    texts = ["Hello world_1 école", "日本語 text テスト", "é", "", "a b a", "abc é, ü x 日本 語"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.search_tokens(F.col("t"))).collect()]
    assert got == [plain_tokens(t) for t in texts] == [T.query_tokens(t) for t in texts]
    for t in texts:
        for token in set(plain_tokens("hello a 日本語 é") + plain_tokens(t)):
            assert one(spark, T.token_count(F.col("t"), token), t=t) == plain_tokens(t).count(token)


def test_identifiers_and_packages(spark):
    assert one(spark, T.identifiers(F.col("t")), t="The parser_2 of éabc and xyz 12ab Foo foo") == ["parser_2", "xyz", "foo", "foo"]
    assert one(spark, T.packages(F.col("t")), t="run pip install numpy  pandas-x\nthen text. pip install q") == ["numpy  pandas-x", "q"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9999), st.integers(1, 18278)), min_size=1, max_size=20))
def test_coordinates_round_trip(spark, cells):
    def letters(c):
        out = ""
        while c:
            c, k = divmod(c - 1, 26)
            out = chr(65 + k) + out
        return out

    rows = spark.createDataFrame(cells, "r int, c int").withColumn("x", T.coordinate(F.col("r"), F.col("c")))
    got = rows.select("x", T.cell_row(F.col("x")), T.cell_column(F.col("x")), "r", "c").collect()
    assert all(g[0] == f"{letters(g.c)}{g.r}" and (g[1], g[2]) == (g.r, g.c) for g in got)


def test_dates_and_sizes(spark):
    assert one(spark, T.serial_date(F.col("v")), v="45292.7") == "2024-01-01" and one(spark, T.serial_date(F.col("v")), v="x") is None
    assert one(spark, T.half_points(F.col("v")), v="21") == "10.5pt"


# ---------------------------------------------------------------- code


def test_code_blocks():
    text = "@deco\ndef run_it():\n    def inner_run():\n        pass\nclass Other:\n    pass\n"
    assert C.python_blocks(text, "run") == "@deco\ndef run_it():\n    def inner_run():\n        pass\n\n    def inner_run():\n        pass"
    assert C.python_blocks("def (", "x") is None and C.python_blocks(text, "zzz") is None
    braces = "function go() {\n  if (x) {\n  }\n}\nfunction go2() {}\nfunction go3() {\n"
    assert C.brace_blocks(braces, "go(") == "function go() {\n  if (x) {\n  }\n}"
    assert C.brace_blocks("go {\n", "go") is None


# ---------------------------------------------------------------- search, tags, graph, trees


def test_bm25_edges(spark):
    corpus = spark.createDataFrame([(1, "a b a"), (2, "c"), (3, None), (4, "")], "id int, text string")
    got = {r.id: r.bm25 for r in search.bm25(corpus, "a a zzz").collect()}
    assert got[2] == got[3] == got[4] == 0 and got[1] == pytest.approx(2 * search.bm25(corpus, "a").filter("id = 1").first().bm25)
    assert search.bm25(corpus.limit(0), "a").count() == 0 and search.bm25(corpus, "").agg(F.sum("bm25")).first()[0] == 0
    ranked = search.top_hits(search.hybrid(search.bm25(corpus, "a"), None, semantic=False), 0).collect()
    assert [(r.id, r.combined) for r in ranked] == [(1, 1.0)]
    weighted = search.top_hits(search.hybrid(search.bm25(corpus, "a"), None, semantic=True), 5).collect()
    assert [(r.id, r.combined) for r in weighted] == [(1, pytest.approx(0.3))]


def test_vectors(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0])], "id int, embedding array<double>")
    assert {r.id: r.similarity for r in search.vector_scores(table, [2.0, 0.0]).collect()} == {1: 1.0, 2: 0.0, 3: -1.0}
    pooled = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "t array<array<double>>, m array<int>")
    assert pooled.select(search.mean_pool(F.col("t"), F.col("m"))).first()[0] == [2.0, 3.0]


def test_tags(spark):
    texts = spark.createDataFrame([(1, "beta alpha beta gamma delta"), (2, ""), (3, "alpha")], "id int, text string")
    best = [(r.id, r.word, r["rank"]) for r in tags.top_words(tags.terms(texts)).orderBy("id", "rank").collect()]
    assert best == [(1, "beta", 1), (1, "alpha", 2), (1, "gamma", 3), (3, "alpha", 1)]
    vocab = spark.createDataFrame([("delta", 1)], "word string, n int")
    assert [r.word for r in tags.top_words(tags.terms(texts), None, vocab).filter("id = 1").orderBy("rank").collect()] == ["beta", "delta", "alpha"]
    assert one(spark, tags.has_tags(F.split("t", ","), ["A", "b"]), t="a,B,c") and not one(spark, tags.has_tags(F.split("t", ","), ["x"]), t="a")


def test_closure_with_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 8)], "src int, dst int")
    seeds = spark.createDataFrame([(1,), (1,), (7,)], "id int")
    assert sorted(r.id for r in graph.closure(edges, seeds).collect()) == [1, 2, 3, 4, 7]
    assert [r.id for r in graph.direct_dependencies(edges, seeds).collect()] == [2]
    assert graph.closure(edges, seeds.limit(0)).count() == 0


def test_trees(spark):
    paths = spark.createDataFrame([("b.txt",), ("A/z/q",), ("A/k",), ("c",)], "path string")
    tree = trees.nodes(paths, folders=spark.createDataFrame([("empty",)], "path string"))
    want = "root/\n├──A/\n│   ├──z/\n│   │   └──q\n│   └──k\n├──empty/\n├──b.txt\n└──c"
    assert trees.as_text(trees.rendered(tree), "root/") == want
    assert trees.as_text(trees.plain_tree(paths, max_depth=1)) == "├── A\n├── b.txt\n└── c"
    assert trees.as_text(trees.plain_tree(paths, exclude=("a", "C*"))) == "└── b.txt"
    flat = spark.sql("SELECT 'd/a.py' AS rel_path, 3 AS size, timestamp'2024-01-02 03:04:05' AS mtime, 'x' AS preview")
    assert json.loads(trees.flat_json(flat).first().json) == {"name": "a.py", "relativePath": "d/a.py", "type": "file", "size": 3, "modified": "2024-01-02T03:04:05", "preview": "x"}
    previews = spark.createDataFrame([("c", "text")], "path string, preview string")
    nested = trees.as_json(trees.nodes(paths), previews, "root")
    assert [c["name"] for c in nested["children"]] == ["A", "b.txt", "c"] and nested["children"][2] == {"name": "c", "preview": "text"} and nested["files_inside"]


# ---------------------------------------------------------------- project dump


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    texts = {
        "README.md": "# Search engine\nindexes text with parser parser\n", "a.py": '"""Parser of text."""\nimport b\nclass Foo:\n    def bar(self):\n        return 1\n',
        "b.py": "# helper of the parser\n\nimport c\ndef run(x): return x\n", "c.py": "x = 1\n", "src/m.js": "import q from './b'\nexport function go(a) {\n  return a\n}\n",
        "src/node_modules/z.js": "no", "data.json": "{}", "big.txt": "x" * 2_000_000, "__init__.py": "", ".hidden.py": "h = 1", "crlf.txt": "a\r\nb", "my file+1.txt": "spaced", ".gitignore": "# c\n/data.json\n\n",
    }
    for name, text in texts.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    (root / "jp.txt").write_bytes("日本語".encode("cp932"))
    (root / "x.bin").write_bytes(b"\xff\x00")
    return str(root)


def dump(spark, project, **options):
    return {r.rel_path: (r.mode, r.preview) for r in ProjectDump(spark, Options(path=project, **options)).shown.collect()}


def test_scan(spark, project):
    got = {r.rel_path: r.content for r in files.scan(spark, project).collect()}
    assert set(got) == {"README.md", "a.py", "b.py", "c.py", "src/m.js", "data.json", "big.txt", "crlf.txt", "my file+1.txt", "jp.txt", "__init__.py", ".hidden.py"}
    assert got["jp.txt"] == "日本語" and got["big.txt"] == "" and got["crlf.txt"] == "a\nb"
    assert "x.bin" in {r.rel_path for r in files.scan(spark, project, include_non_preview=True).collect()}
    assert [r.rel_path for r in files.scan(spark, f"{project}/a.py").collect()] == ["a.py"]
    assert files.ignore_patterns(f"{project}/.gitignore") == ["data.json"] and files.ignore_patterns(f"{project}/none") == []
    assert "data.json" not in dump(spark, project, use_gitignore=True)


def test_git_lists(spark, project, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init")
    for n in ("t", "s", "m", "n"):
        (tmp_path / n).write_text("1")
    run("add", "t", "m")
    run("commit", "-m", "x")
    (tmp_path / "m").write_text("2")
    run("add", "s")
    got = {m: {r[0] for r in files.git_files(spark, str(tmp_path), m).collect()} for m in ("Tracked", "Staged", "Modified")}
    assert got == {"Tracked": {"t", "m", "s"}, "Staged": {"s"}, "Modified": {"m", "s", "n"}}
    assert files.git_files(spark, f"{project}/src", "Tracked").count() == 0


def test_modes(spark, project):
    assert dump(spark, project, summary_only=True)["b.py"] == ("summary", "helper of the parser\n\n[Tags: helper, parser, run]")
    assert dump(spark, project, summary_only=True)["c.py"][1] == "(No summary provided)\n\n[Tags: provided, summary]"
    assert dump(spark, project, outline=True, full=("a.",))["a.py"][0] == "full"
    assert dump(spark, project, outline=True)["a.py"] == ("outline", "class Foo: ...\n    def bar(self): ...")
    chosen = dump(spark, project, modes={"a.py": "x", "b.py": "s", "c.py": "f"}, outline=True)
    assert "a.py" not in chosen and chosen["b.py"][0] == "summary" and chosen["c.py"][0] == "full"
    assert dump(spark, project, preview_lines=1)["README.md"][1] == "# Search engine"
    assert dump(spark, project, directories_only=True) == {}
    assert set(dump(spark, project, tag=("FOO",))) == {"a.py"}


def test_focus_and_dependencies(spark, project):
    assert dump(spark, project, focus="Foo") == {"a.py": ("raw", "class Foo:\n    def bar(self):\n        return 1")}
    assert set(dump(spark, project, focus="a.py:Foo", resolve_deps=True)) == {"a.py", "b.py", "c.py"}
    smart = dump(spark, project, focus="Foo", smart_context=True)
    assert set(smart) == {"a.py", "b.py"} and smart["b.py"][1].startswith("// [Smart Context")


def test_search_plan(spark, project):
    plan = ProjectDump(spark, Options(path=project, search="parser text", top_k=1))
    assert [r.id for r in plan.hits.collect()] == ["a.py"]
    shown = {r.rel_path: r.mode for r in plan.shown.collect()}
    assert shown["a.py"] == "full" and shown["b.py"] == "summary" and len(shown) == 12
    assert dump(spark, project, search="zzzz") == {}
    text = plan.text()
    assert "### File: a.py\n```python\n" in text and plan.tokens().first().tokens == (sum(len(r.text) + 1 for r in plan.markdown().collect())) // 4
    assert plan.json("p")["name"] == "p" and "a.py" in {r.rel_path for r in plan.candidates().collect()}


def test_cache(spark, project, tmp_path):
    plan = ProjectDump(spark, Options(path=project))
    place = f"file://{tmp_path}/cache"
    assert cache.load(spark, place) is None
    cache.save(cache.merged(None, plan.fresh_cache()), place)
    stored = cache.load(spark, place)
    hits = cache.looked_up(plan.features.select("rel_path", "mtime"), stored, plan.settings).filter("cached_content IS NOT NULL")
    assert hits.count() == plan.features.count()
    newer = stored.filter("rel_path = 'a.py'").withColumn("mtime", F.col("mtime") + F.expr("INTERVAL 1 DAY"))
    assert cache.merged(stored, newer).count() == stored.count()
    empty = f"file://{tmp_path}/none"
    cache.save(stored.limit(0), empty)
    assert cache.load(spark, empty) is None


def test_markdown_and_tokens(spark):
    assert one(spark, render.markdown(F.col("p"), F.col("t")), p="d/a.md", t="x") == "### File: d/a.md\n```\nx\n```\n"
    assert one(spark, render.estimated_tokens(F.col("t")), t="x" * 11) == 2


# ---------------------------------------------------------------- notebooks


def test_notebook(spark):
    cells = [
        {"cell_type": "markdown", "source": ["# T\n", "x"]},
        {"cell_type": "code", "source": "# only a comment", "outputs": [{"output_type": "stream", "text": "lost"}]},
        {"cell_type": "code", "source": ["a = 1  # c\n", "a"], "outputs": [{"output_type": "stream", "text": ["1\n", "2"]}, {"output_type": "execute_result", "data": {"text/plain": "3"}}, {"output_type": "display_data", "data": {"text/plain": "no"}}]},
        {"cell_type": "code", "source": "boom", "outputs": [{"output_type": "error", "traceback": ["T1", "T2"]}]},
        {"cell_type": "raw", "source": "r"},
    ]
    table = spark.createDataFrame([("n", json.dumps({"cells": cells})), ("bad", "{"), ("none", "{}")], "path string, json string")
    read = notebook_files.cells(table)
    pick = lambda **o: [(r.type, r.source, r.output, r.has_error) for r in notebooks.select_cells(read, **o).orderBy("pos").collect()]
    assert pick(no_comments=True) == [("markdown", "# T\nx", "", False), ("code", "a = 1\na", "1\n2\n3", False), ("code", "boom", "T1\nT2", True), ("raw", "r", "", False)]
    assert len(pick()) == 5 and pick(only_error=True) == [("code", "boom", "T1\nT2", True)]
    assert pick(no_code=True)[2] == ("code", "", "1\n2\n3", False) and pick(no_output=True)[2][2] == "" and len(pick(no_markdown=True, last=2)) == 2
    text = notebooks.as_markdown(notebooks.select_cells(read, no_comments=True)).first().text
    rule = "-" * 40 + "\n"
    assert text == f"### Markdown:\n# T\nx\n\n\n{rule}### Code:\n```python\na = 1\na\n```\n### Output:\n```text\n1\n2\n3\n```\n\n\n{rule}### Code:\n```python\nboom\n```\n### Output:\n```text\nT1\nT2\n```\n\n\n{rule}"
    assert json.loads(notebooks.as_json(notebooks.select_cells(read, last=1)).first().json) == [{"type": "raw", "source": "r", "output": "", "has_error": False}]


# ---------------------------------------------------------------- workbooks


def workbook(sheet, merges="", drawing=""):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    styles_xml = f"""<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="yyyy/mm"/><numFmt numFmtId="171" formatCode="0.0"/></numFmts>
    <fills><fill><patternFill/></fill><fill><patternFill/></fill><fill><patternFill><fgColor rgb="FFFFCC00"/></patternFill></fill></fills>
    <borders><border><left/></border><border><left style="thin"/></border></borders>
    <cellXfs><xf/><xf borderId="1"/><xf fillId="2"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>"""
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><t>plain</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>',
        "xl/styles.xml": styles_xml,
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData>{merges}{drawing}</worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, x in parts.items():
            z.writestr(n, x)
    return out.getvalue()


SHEET = (
    '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" s="3"><v>45292</v></c></row>'
    '<row><c r="A2" s="1"/><c r="B2" s="2"/><c r="C2"><f>A1</f><v>5</v></c></row>'
    '<row><c r="A4" t="b"><v>1</v></c><c r="B4" t="inlineStr"><is><t>in</t></is></c></row>'
    + "".join(f'<row><c r="A{r}"><v>7</v></c></row>' for r in (5, 6, 7)) + '<row><c r="A8" s="4"><v>x</v></c><c r="B8" t="s"><v>99</v></c></row>'
)


def test_workbook_lite(spark):
    files_ = spark.createDataFrame([("w.xlsx", workbook(SHEET, '<mergeCells><mergeCell ref="A4:B4"/></mergeCells>', "<drawing/>")), ("bad.xlsx", b"no")], "path string, content binary")
    parts = workbooks.parts(files_)
    text = sheets.sheet_maps(parts).first().text
    assert text == "\n".join([
        "=== SHEET: One ===", "[INFO] This sheet contains Images/Charts/Shapes (detected but not rendered).", "Merged Ranges: A4:B4", "-" * 60,
        "[A1] plain | [B1] rich | [C1] 2024-01-01", "[A2] {_INPUT_} <BORDER> | [B2] {_INPUT_} <BG:COLOR> | [C2] 5 <FORMULA>", "<EMPTY_ROW>", "[A4] True",
        "[A5] 7", "... (Repeated 2 rows) ...", "[A8] x",
    ])
    maps = {r.path: r.text for r in sheets.workbook_maps(parts).collect()}
    assert maps["bad.xlsx"].startswith("Error loading bad.xlsx")
    assert "[B2] {{__INPUT_HERE__}} <COLORED>" in maps["w.xlsx"] and "[A1] plain  | " in maps["w.xlsx"].replace("plain |", "plain  |") and "<DATE>" in maps["w.xlsx"]
    missing = {r.path: r.text for r in sheets.workbook_maps(parts, "Two").collect()}
    assert missing["w.xlsx"] == "Error: Sheet 'Two' not found."


def test_merged_ranges_in_order_of_the_file(spark):
    refs = ["B9:C9", "A4:B4", "A30:B31", "D2:E2", "A10:B10", "C1:D1", "A2:B2"]
    book = lambda rs: workbook(SHEET, "<mergeCells>" + "".join(f'<mergeCell ref="{r}"/>' for r in rs) + "</mergeCells>")
    parts = workbooks.parts(spark.createDataFrame([("w.xlsx", book(refs)), ("v.xlsx", book(refs[::-1])), ("u.xlsx", book([]))], "path string, content binary"))
    for scattered in (parts.coalesce(1).sortWithinPartitions("value"), parts.coalesce(1).sortWithinPartitions(F.desc("value")), parts.repartition(3, "value")):
        for style in ("lite", "full"):
            got = {r.path: r.text.split("\n")[1] for r in sheets.sheet_maps(scattered, style).collect()}
            assert got == {"w.xlsx": "Merged Ranges: " + ", ".join(refs), "v.xlsx": "Merged Ranges: " + ", ".join(refs[::-1]), "u.xlsx": "Merged Ranges: "}


def test_workbook_limits_and_runs(spark, tmp_path):
    many = "".join(f'<row><c r="A{r}"><v>1</v></c><c r="AZ{r}"><v>2</v></c></row>' for r in range(1, 311))
    (tmp_path / "m.xlsx").write_bytes(workbook(many))
    text = tools.excel_structure(spark, str(tmp_path)).first().text
    assert text.endswith("[A1] 1 \n... (Identical structure repeated for 299 rows to end) ...")
    assert tools.excel_structure(spark, f"{tmp_path}/m.xlsx", "One").first().text == text
    assert tools.tool_definition()["function"]["parameters"]["required"] == []


@settings(max_examples=20, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=30))
def test_run_lengths(spark, values):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, i int, v string")
    got = [(r.start, r.repeats, r.v, r.is_last_run) for r in sheets.run_lengths(rows, ["k"], "i", F.col("v")).orderBy("start").collect()]
    want = []
    for i, v in enumerate(values):
        if want and want[-1][2] == v:
            want[-1][1] += 1
        else:
            want.append([i, 0, v, False])
    want[-1][3] = True
    assert got == [tuple(w) for w in want]


# ---------------------------------------------------------------- word-processor files


def word(body, extra=None):
    spaces = " ".join(f'xmlns:{k}="{v}"' for k, v in word_files.NS.items())
    style = f'<w:styles {spaces}><w:style w:styleId="Em"><w:rPr><w:color w:val="FF0000"/></w:rPr></w:style></w:styles>'
    rels = '<Relationships><Relationship Id="r1" Target="media/p.png"/><Relationship Id="r2" Target="charts/chart1.xml"/><Relationship Id="r3" Target="diagrams/data1.xml"/><Relationship Id="r4" Target="http://x"/></Relationships>'
    chart = f'<c:chartSpace {spaces}><c:title><a:t>T</a:t></c:title><c:ser><c:tx><c:v>S</c:v></c:tx><c:cat><c:v>a</c:v><c:v>b</c:v></c:cat><c:val><c:v>1</c:v></c:val></c:ser></c:chartSpace>'
    art = f"<dgm:data {spaces}><dgm:t><a:t>x</a:t></dgm:t><dgm:t><a:t>y</a:t></dgm:t></dgm:data>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, x in {"word/document.xml": f"<w:document {spaces}><w:body>{body}</w:body></w:document>", "word/styles.xml": style, "word/_rels/document.xml.rels": rels, "word/charts/chart1.xml": chart, "word/diagrams/data1.xml": art, "word/media/p.png": "png"}.items():
            if x is not None and n not in (extra or ()):
                z.writestr(n, x)
    return out.getvalue()


def run(text, props=""):
    return f"<w:r><w:rPr>{props}</w:rPr><w:t>{text}</w:t></w:r>"


BODY = (
    f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr>{run("Title")}</w:p>'
    f'<w:p>{run("plain ")}{run("red", chr(60) + "w:rStyle w:val=" + chr(34) + "Em" + chr(34) + "/>")}{run("big", chr(60) + "w:sz w:val=" + chr(34) + "24" + chr(34) + "/><w:b/>")}</w:p>'
    f'<w:p><w:pPr><w:numPr/></w:pPr><w:hyperlink>{run("link")}</w:hyperlink></w:p>'
    f"<w:tbl><w:tr><w:tc><w:p>{run('a')}</w:p><w:p>{run('b')}</w:p></w:tc><w:tc><w:p>{run('c')}</w:p></w:tc></w:tr></w:tbl>"
    '<w:p><w:r><mc:AlternateContent><mc:Choice><w:drawing><a:prstGeom prst="rect"/><a:blip r:embed="r1"/><c:chart r:id="r2"/><dgm:relIds r:dm="r3"/></w:drawing></mc:Choice><mc:Fallback><w:pict/></mc:Fallback></mc:AlternateContent></w:r></w:p>'
)


def test_word(spark):
    rows = [("d/w.docx", word(BODY)), ("z.docx", b"no"), ("n.docx", word(BODY, {"word/document.xml"})), ("m.docx", None)]
    table = spark.createDataFrame(rows, "path string, content binary")
    lines = {}
    for r in word_files.word_lines(table).orderBy("path", "pos").collect():
        lines.setdefault(r.path, []).append(r.text)
    assert lines["d/w.docx"] == [
        "[HEADING1] Title", "plain {{Style:Em C:FF0000| red}}{{S:12.0pt Bold| big}}", "[LIST_ITEM] [LINK: link]", "[TABLE START]", "| a<br>b | c |", "[TABLE END]",
        "[DRAWING: CHART SMARTART Shape:rect]\n[SmartArt Data: x | y]\n[Chart Data: Title: T | [S] a=1]\n[IMAGE REF: image_01.png]",
    ]
    assert lines["z.docx"] == ["not a zip file"] and lines["n.docx"] == ["no document part"] and lines["m.docx"] == ["file not found"]
    text = {r.path: r.text for r in word_files.word_maps(table).collect()}
    assert text["d/w.docx"].startswith("--- Word Structure Map: w.docx ---\n") and "    - 文字色 (Color): 自動/黒\n" in text["d/w.docx"] and text["z.docx"] == "Error: not a zip file"
    assert [(r.name, r.part, bytes(r.content)) for r in word_files.images(table).collect()] == [("image_01.png", "word/media/p.png", b"png")]


def test_most_common(spark):
    rows = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "c", 0)], "k int, v string, i int")
    assert sorted((r.k, r.v) for r in styles.most_common(rows, "k", "v", "i").collect()) == [(1, "b"), (2, "c")]


# ---------------------------------------------------------------- assistant answers


def test_code_files_of_answers(spark):
    texts = [
        "### x (a.py)\n```\n1\n```\n```\nlost\n```",  # a header serves one block
        "```\nbefore\n### mid (b.py)\nafter\n```",  # a header within a block names it from there on
        "### (c.py)\n```\nopen",  # never closed
        "proj/\n├── d.py\n\n### `d.py`\n```py\n1\n```\n### (proj/e.py)\n```\n2\n```",
        "", None,
    ]
    table = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r.id, r.path): r.content for r in assistant_text.code_files(table).collect()}
    assert got == {(0, "a.py"): "1", (1, "b.py"): "after", (3, "proj/d.py"): "1", (3, "proj/e.py"): "2"}


def test_directory_actions(spark):
    text = "Intro text\n```\nroot/\n├── src/\n│   ├── a.py # note\n│   └── deep\n└── 説明\nplain\n```"
    uneven = "top/\n    ├── a/\n    ├── b.txt\n        ├── under b.txt\n  ├── between/\n    └── c.d\n/abs/\n└── e.f\n└── g/\n    └── h.i"
    table = spark.createDataFrame([(0, text), (1, "a.txt\nnot a path\n" + "x" * 101 + "."), (2, uneven), (3, ""), (4, None)], "id int, text string")
    got = {}
    for r in assistant_text.directory_actions(table).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append((r.pos, r.path, r.action))
    assert got == {
        0: [(0, "./root/", "mkdir"), (1, "./root/src/", "mkdir"), (2, "./root/src/a.py", "touch"), (3, "./root/src/deep", "mkdir")],
        1: [(0, "./a.txt", "touch")],
        2: [(0, "./top/", "mkdir"), (1, "./top/a/", "mkdir"), (2, "./top/b.txt", "touch"), (3, "./top/under b.txt", "touch"), (4, "./top/between/", "mkdir"), (5, "./top/between/c.d", "touch"), (6, "/abs/", "mkdir"), (7, "/abs/e.f", "touch"), (8, "/abs/g/", "mkdir"), (9, "/abs/g/h.i", "touch")],
    }


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["k {", "}", "x { y", "} k {", "k", "{ }", "k { }", "}}"]), max_size=14))
def test_brace_blocks(rows):
    """Against a scan from each line with the keyword."""
    want = []
    for first, row in enumerate(rows):
        level, opened = 0, False
        for last in range(first, len(rows)) if "k" in row and "{" in row else ():
            level += rows[last].count("{") - rows[last].count("}")
            opened = opened or level > 0
            if opened and level == 0:
                want.append("\n".join(rows[first : last + 1]))
                break
    assert C.brace_blocks("\n".join(rows), "k") == ("\n\n".join(want) or None)


# ---------------------------------------------------------------- streams and the registry


def test_streamed_windows_equal_the_table(spark, tmp_path):
    table = spark.sql("SELECT id AS event_id, timestamp'2024-01-01' + make_interval(0,0,0,0,id) AS ts, id % 3 AS user_id, concat('t', id % 2) AS event_type, CAST(id AS double) AS value FROM range(100)")
    table.repartition(3).write.parquet(f"{tmp_path}/events")
    stream = events.windowed(events.event_stream(spark, f"{tmp_path}/events"))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, events.windowed(table).collect()))
    assert sorted(map(tuple, spark.table("windows").collect())) == want
    assert sum(r.n for r in events.sessions(table, "2 hours").collect()) == 100


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


# ---------------------------------------------------------------- command line


def test_command_line(spark, project, tmp_path):
    from spindrift.__main__ import _parser, run as command

    call = lambda *args: command(spark, _parser().parse_args(list(args)))
    assert "### File: a.py" in call("project", "-p", project, "--text", "--outline")
    assert json.loads(call("project", "-p", project))["files_inside"]
    assert "├──src/" in call("project", "-p", project, "--tree") and "a.py  [Foo, bar" in call("project", "-p", project, "--dry-run")
    assert "├── src" in call("tree", project, "--max-depth", "1") and "node_modules" not in call("tree", project, "--exclude", "NODE_*")
    (tmp_path / "n.ipynb").write_text(json.dumps({"cells": [{"cell_type": "markdown", "source": "x"}]}))
    assert json.loads(call("notebook", f"{tmp_path}/n.ipynb", "--json"))[0]["source"] == "x"
    assert call("notebook", f"{tmp_path}/n.ipynb", "--no-markdown").startswith("(No relevant")
    (tmp_path / "w.docx").write_bytes(word(BODY))
    assert "[HEADING1] Title" in call("word", f"{tmp_path}/w.docx")
    (tmp_path / "w.xlsx").write_bytes(workbook(SHEET))
    assert "=== SHEET MAP: One ===" in call("workbook", f"{tmp_path}/w.xlsx")
    assert call("answer", "pip install numpy", "--pip") == "package numpy"


def test_interactive_modes(spark, project):
    from spindrift.__main__ import _parser, _project, chosen_modes

    answers = iter(["", "q", " S ", "", "x"])
    assert chosen_modes(["b", "a", "d"], ["c"], lambda _: next(answers)) == {"a": "f", "b": "s", "c": "o", "d": "x"}
    args = _parser().parse_args(["project", "-p", project, "--text", "--interactive", "--outline"])
    shown = _project(spark, args, lambda asked: "x" if not asked.startswith("a.py") else "")
    assert shown.count("### File:") == 1 and "### File: a.py" in shown and "return 1" in shown


def test_tokens_of_a_dump(spark):
    public = pytest.importorskip("public_tokenizers")
    files = spark.createDataFrame([("a.md", "Hello world, hello.")], "rel_path string, content string").withColumn("mtime", F.lit(None).cast("timestamp"))
    plan = ProjectDump(spark, Options(exclude=()), files=files)
    counted = plan.tokens(public.path("byte_bpe_50k.tiktoken"), public.PATTERN).first().tokens
    assert plan.tokens().first().tokens == (len(plan.text()) + 1) // 4 and 5 < counted < len(plan.text())


def test_tokens_of_reports(spark):
    from spindrift.functions.token_count import tokens

    assert one(spark, tokens(F.col("t")), t="x" * 9) == 2
    public = pytest.importorskip("public_tokenizers")
    n = one(spark, tokens(F.col("t"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN), t="Hello world, hello.")
    assert n == 5
