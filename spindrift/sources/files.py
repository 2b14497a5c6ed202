"""Scans of project trees: files, their text, and the lists that narrow a scan."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from fnmatch import translate
from pathlib import Path

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from spindrift.functions import constants as K
from spindrift.functions import text as T


@F.pandas_udf(StringType())
def _legacy_text(content: pd.Series) -> pd.Series:
    """Bytes that aren't UTF-8: Japanese Windows encoding where it fits, else Latin-1."""

    def of(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        try:
            return bytes(raw).decode("cp932")
        except UnicodeDecodeError:
            return bytes(raw).decode("latin-1")

    return content.map(of)


def decoded(content: Column) -> Column:
    """The text of a file, line ends as \\n; a byte order mark stays.  Only bytes that aren't UTF-8 reach Python."""
    good = F.is_valid_utf8(content.cast("string"))
    text = F.when(good, content.cast("string")).otherwise(_legacy_text(F.when(~good, content)))
    return F.regexp_replace(text, "\r\n?", "\n")


def excluded(rel_path: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """Whether the name of the file or of one of its folders matches; the root's own name doesn't count."""
    return F.exists(F.split(rel_path, "/", -1), lambda part: T.matches_any(part, patterns))


def capped(text: Column, megabytes: float = K.PREVIEW_MB) -> Column:
    """The text, or nothing if it is empty or longer in UTF-8 than allowed; the row stays."""
    return F.when(F.octet_length(text) <= int(megabytes * 1024 * 1024), text).otherwise("")


def select_files(files: DataFrame, excludes: list[str] | tuple[str, ...] = K.EXCLUDES, preview_exts: list[str] | tuple[str, ...] = K.PREVIEW_EXTS, include_non_preview: bool = False, directories_only: bool = False, listed: DataFrame | None = None) -> DataFrame:
    """Rows of files (rel_path, ...) that a scan keeps, with is_preview.  listed: rel_path, a list from version control."""
    out = files.withColumn("is_preview", T.extension(F.col("rel_path")).isin(*preview_exts)).filter(~excluded(F.col("rel_path"), excludes))
    if directories_only:
        return out.limit(0)
    if not include_non_preview:
        out = out.filter("is_preview")
    return out.join(listed, "rel_path", "left_semi") if listed is not None else out


def _file_system(root: str) -> tuple[pafs.FileSystem, str]:
    if root.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + root[5:].lstrip("/")
    return pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), str(Path(root).absolute()))


_LISTED = "rel_path string, mtime timestamp, size bigint"


def listing(spark: SparkSession, root: str, excludes: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """rel_path, mtime, size of all files below a folder, or of one file.  Excluded folders are not entered.

    Spark's own readers pass over names that start with _ or ., so folders are listed here.  The driver lists the top folder alone;
    the folders in it are walked by the executors, each by one task.
    """
    fs, base = _file_system(root)
    base = base.rstrip("/")
    top = fs.get_file_info(base)
    if top.type == pafs.FileType.File:
        return spark.createDataFrame([(base[base.rfind("/") + 1 :], top.mtime, top.size)], _LISTED)
    skip = [re.compile(translate(p)) for p in dict.fromkeys(excludes)]
    found = fs.get_file_info(pafs.FileSelector(base))
    here = spark.createDataFrame([(f.base_name, f.mtime, f.size) for f in found if f.type == pafs.FileType.File], _LISTED)
    folders = [f.base_name for f in found if f.type == pafs.FileType.Directory and not any(p.match(f.base_name) for p in skip)]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _file_system(root)
        base = base.rstrip("/")
        for b in batches:
            todo = [f"{base}/{name}" for name in b.column(0).to_pylist()]
            while todo:
                inside = [f for f in fs.get_file_info(pafs.FileSelector(todo.pop(), allow_not_found=True)) if not any(p.match(f.base_name) for p in skip)]
                todo += [f.path for f in inside if f.type == pafs.FileType.Directory]
                rows = [f for f in inside if f.type == pafs.FileType.File]
                yield pa.RecordBatch.from_arrays([pa.array([f.path[len(base) + 1 :] for f in rows], pa.string()), pa.array([f.mtime for f in rows], pa.timestamp("us", "UTC")), pa.array([f.size for f in rows], pa.int64())], ["rel_path", "mtime", "size"])

    if not folders:
        return here
    names = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(len(folders))
    return here.unionByName(names.mapInArrow(walk, _LISTED))


def read_contents(files: DataFrame, root: str) -> DataFrame:
    """files (rel_path, ..., wanted) with content as bytes, null for files that aren't wanted or can't be read."""
    base = root.rstrip("/")
    single = _file_system(base)[0].get_file_info(_file_system(base)[1]).type == pafs.FileType.File
    names = files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _file_system(base)
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                raw = None
                if row.column(names.index("wanted"))[0].as_py():
                    path = folder if single else f"{folder}/{row.column(names.index('rel_path'))[0].as_py()}"
                    try:
                        with fs.open_input_stream(path) as f:
                            raw = f.read()
                    except OSError:
                        raw = None
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([raw], pa.binary())], [*names, "content"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(run, f"{schema}, content binary")


def scan(spark: SparkSession, root: str, excludes: list[str] | tuple[str, ...] = K.EXCLUDES, preview_exts: list[str] | tuple[str, ...] = K.PREVIEW_EXTS, include_non_preview: bool = False, max_mb: float = K.PREVIEW_MB, listed: DataFrame | None = None, contents: bool = True) -> DataFrame:
    """rel_path, mtime, content, is_preview of the files below a root folder, or of one file.

    Excluded folders aren't walked.  Only files that are kept, shown and small enough are opened; without contents none is.  A file
    of another encoding can be under the limit in bytes and over it in UTF-8, so the text's size counts, too.
    """
    kept = select_files(listing(spark, root, excludes), excludes, preview_exts, include_non_preview, listed=listed)
    if not contents:
        return kept.select("rel_path", "mtime", F.lit("").alias("content"), "is_preview")
    small = F.col("size") <= 4 * int(max_mb * 1024 * 1024)  # no encoding here needs over 4 bytes for one of UTF-8
    read = read_contents(kept.select("rel_path", "mtime", "is_preview", (F.col("is_preview") & small).alias("wanted")).repartition("rel_path"), root)
    return read.select("rel_path", "mtime", F.coalesce(capped(decoded(F.col("content")), max_mb), F.lit("")).alias("content"), "is_preview")


def git_files(spark: SparkSession, root: str, mode: str) -> DataFrame:
    """rel_path of Tracked, Staged or Modified files; nothing where git fails.  Modified: unstaged, staged and new files."""
    calls = {"Tracked": [["ls-files", "-z"]], "Staged": [["diff", "--cached", "--name-only", "-z"]], "Modified": [["diff", "--name-only", "-z"], ["diff", "--cached", "--name-only", "-z"], ["ls-files", "--others", "--exclude-standard", "-z"]]}[mode]
    found: set[str] = set()
    for call in calls:
        try:
            done = subprocess.run(["git", "-C", root, *call], capture_output=True, check=True)
        except (OSError, subprocess.CalledProcessError):
            continue
        found |= {p.decode(errors="replace") for p in done.stdout.split(b"\0") if p}
    return spark.createDataFrame([(p,) for p in sorted(found)], "rel_path string")


def ignore_patterns(path: str) -> list[str]:
    """Patterns of an ignore file: no blank lines and comments, outer slashes dropped.  Empty if there is no file."""
    file = Path(path.removeprefix("file://"))
    rows = [r.strip() for r in file.read_text("utf-8", "replace").splitlines()] if file.is_file() else []
    return [r.strip("/") for r in rows if r and not r.startswith("#")]
