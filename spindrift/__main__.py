"""Command line: python -m spindrift {project,tree,notebook,workbook,word,answer} ..."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable, Iterable
from itertools import repeat

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spindrift.functions import constants as K


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spindrift")
    tools = p.add_subparsers(dest="tool", required=True)
    a = tools.add_parser("project", help="a folder as JSON, Markdown or a tree").add_argument
    a("--path", "-p", default=".")
    a("--exclude", "-e", nargs="*", default=list(K.EXCLUDES))
    a("--outfile", "-o", default="")
    a("--preview-exts", nargs="*", default=list(K.PREVIEW_EXTS))
    a("--preview-lines", type=int, default=K.PREVIEW_LINES)
    a("--max-preview-size-mb", type=float, default=K.PREVIEW_MB)
    a("--git-filter", choices=("None", "Tracked", "Staged", "Modified"), default="None")
    a("--focus", "-f")
    a("--search", "-s")
    a("--top-k", type=int, default=K.TOP_K)
    a("--full", nargs="*", default=[])
    a("--tag", nargs="*", default=[])
    a("--vocab-file", default="README.md")
    a("--token-ranks", help="a rank file of a byte-pair vocabulary for the token count")
    a("--token-pattern", help="the pattern that cuts text for it")
    for flag in ("directories-only", "include-non-preview", "resolve-deps", "summary-only", "outline", "smart-context", "search-full", "semantic-search", "dry-run", "use-gitignore", "tree", "text", "interactive"):
        a(f"--{flag}", action="store_true")
    a = tools.add_parser("tree", help="a plain directory tree").add_argument
    a("path", nargs="?", default=".")
    a("--exclude", nargs="*", default=[])
    a("--max-depth", type=int, default=-1)
    a("--directories-only", action="store_true")
    a = tools.add_parser("notebook", help="cells of a notebook").add_argument
    a("file")
    a("--tail", type=int)
    for flag in ("no-markdown", "no-code", "no-output", "only-error", "no-comments", "json"):
        a(f"--{flag}", action="store_true")
    a = tools.add_parser("workbook", help="maps of sheets").add_argument
    a("file", nargs="?", default=".")
    a("sheet", nargs="?")
    a("--style", choices=("full", "lite"), default="full")
    a = tools.add_parser("word", help="maps of word-processor files").add_argument
    a("file")
    a("--img-dir", default="extracted_images")
    a = tools.add_parser("answer", help="what an assistant's answer asks for; nothing is written or run").add_argument
    a("text")
    for flag in ("pip", "tree", "code"):
        a(f"--{flag}", action="store_true")
    return p


#: How a file is shown, by the letter that asks for it.
MODES = {"f": "full text", "s": "summary", "o": "outline", "x": "left out"}


def chosen_modes(paths: Iterable[str], dependencies: Iterable[str], ask: Callable[[str], str]) -> dict[str, str]:
    """rel_path -> letter of MODES, asked file by file until the answer is one; no answer means f, or o for a dependency."""
    usual = {**dict.fromkeys(paths, "f"), **dict.fromkeys(dependencies, "o")}
    choices = "/".join(f"{k} {v}" for k, v in MODES.items())
    given = lambda path, default: (ask(f"{path} ({choices}; {default}): ").strip().lower() or default for _ in repeat(None))
    return {path: next(x for x in given(path, usual[path]) if x in MODES) for path in sorted(usual)}


def _project(spark: SparkSession, a: argparse.Namespace, ask: Callable[[str], str] = input) -> str:
    from spindrift.operators import trees
    from spindrift.plans.project import Options, ProjectDump

    skipped = {"tool", "outfile", "dry_run", "tree", "text", "interactive", "token_ranks", "token_pattern"}
    options = {k: tuple(v) if isinstance(v, list) else v for k, v in vars(a).items() if k not in skipped}
    dump = ProjectDump(spark, Options(**options))
    if a.interactive:
        listed = [r.rel_path for r in dump.features.select("rel_path").collect()]
        more = [r.id for r in dump.smart_dependencies.collect()] if a.smart_context else []
        dump = ProjectDump(spark, Options(**options, modes=chosen_modes(listed, more, ask)))
    name = os.path.basename(os.path.abspath(a.path))
    if a.dry_run:
        return "\n".join(f"{r.rel_path}  [{', '.join(r.tags)}]" for r in dump.candidates().orderBy("rel_path").collect())
    if a.tree:
        return trees.as_text(dump.tree(), f"{name}/")
    return dump.text() if a.text else json.dumps(dump.json(name), ensure_ascii=False, separators=(",", ":"))


def _answer(spark: SparkSession, a: argparse.Namespace) -> str:
    from spindrift.operators import assistant_text as T

    table = spark.createDataFrame([(0, a.text)], "id int, text string")
    every = not (a.pip or a.tree or a.code)
    out = []
    if a.pip or every:
        out += [f"package {r.package}" for r in T.requested_packages(table).collect()]
    if a.tree or every:
        out += [f"{r.action} {r.path}" for r in T.directory_actions(table).orderBy("pos").collect()]
    if a.code or every:
        out += [f"file {r.path}\n{r.content}" for r in T.code_files(table).orderBy("pos").collect()]
    return "\n".join(out)


def run(spark: SparkSession, a: argparse.Namespace) -> str:
    from spindrift.operators import notebooks, trees
    from spindrift.plans import tools
    from spindrift.sources import files, notebooks as notebook_files, word_files

    if a.tool == "project":
        return _project(spark, a)
    if a.tool == "answer":
        return _answer(spark, a)
    if a.tool == "tree":
        paths = files.listing(spark, a.path).select(F.col("rel_path").alias("path"))
        return trees.as_text(trees.plain_tree(paths, max_depth=a.max_depth, directories_only=a.directories_only, exclude=tuple(a.exclude)))
    if a.tool == "workbook":
        return "\n\n".join(r.text for r in tools.excel_structure(spark, a.file, a.sheet, a.style).orderBy("path").collect())
    binary = spark.read.format("binaryFile").load(a.file).select("path", "content")
    if a.tool == "word":
        return "\n\n".join(r.text for r in word_files.word_maps(binary, a.img_dir).orderBy("path").collect())
    cells = notebook_files.cells(binary.select("path", F.col("content").cast("string").alias("json")))
    kept = notebooks.select_cells(cells, a.tail, a.no_comments, a.no_markdown, a.no_code, a.no_output, a.only_error)
    if a.json:
        rows = notebooks.as_json(kept).collect()
        return json.dumps(json.loads(rows[0].json) if rows else [], ensure_ascii=False, indent=2)
    rows = notebooks.as_markdown(kept).collect()
    return rows[0].text if rows else "(No relevant cells found matching the criteria)"


def main(args: list[str] | None = None) -> None:
    a = _parser().parse_args(args)
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").config("spark.ui.enabled", "false").getOrCreate()
    text = run(spark, a)
    if getattr(a, "outfile", ""):
        with open(a.outfile, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        sys.stdout.write(text + "\n")
    from spindrift.functions.token_count import tokens

    count = tokens(F.col("text"), getattr(a, "token_ranks", None), getattr(a, "token_pattern", None))
    print(f"[Tokens: {spark.createDataFrame([(text,)], 'text string').select(count).first()[0]:,}]", file=sys.stderr)


if __name__ == "__main__":
    main()
