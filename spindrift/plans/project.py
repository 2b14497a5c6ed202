"""The project dump as one lazy plan: scan, focus, tags, search, dependencies, modes, rendering."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import code as C
from spindrift.functions import constants as K
from spindrift.functions import text as T
from spindrift.functions import token_count
from spindrift.operators import cache as cached
from spindrift.operators import graph, render, search, tags, trees
from spindrift.sources import files as source


@dataclass
class Options:
    """What a dump shows; names follow the command line options they stand for."""

    path: str = "."
    exclude: tuple[str, ...] = K.EXCLUDES
    use_gitignore: bool = False
    git_filter: str = "None"
    directories_only: bool = False
    include_non_preview: bool = False
    preview_exts: tuple[str, ...] = K.PREVIEW_EXTS
    preview_lines: int = K.PREVIEW_LINES
    max_preview_size_mb: float = K.PREVIEW_MB
    focus: str | None = None
    resolve_deps: bool = False
    summary_only: bool = False
    outline: bool = False
    smart_context: bool = False
    modes: dict[str, str] = field(default_factory=dict)  # rel_path -> f, s, o or x
    search: str | None = None
    search_full: bool = False
    semantic_search: bool = False
    full: tuple[str, ...] = ()
    top_k: int = K.TOP_K
    tag: tuple[str, ...] = ()
    vocab_file: str = "README.md"
    vectors: DataFrame | None = None  # id, embedding of files
    query_vector: list[float] | None = None


class ProjectDump:
    """Each property is a DataFrame; nothing runs before a result is asked for.

    files may be given (rel_path, mtime, content, is_preview), as any table of texts, instead of a folder to scan.
    """

    def __init__(self, spark: SparkSession, options: Options, files: DataFrame | None = None, cache: DataFrame | None = None):
        self.spark, self.o, self.cache = spark, options, cache
        self._files = files

    @cached_property
    def patterns(self) -> tuple[str, ...]:
        more = source.ignore_patterns(f"{self.o.path.rstrip('/')}/.gitignore") if self.o.use_gitignore else []
        return tuple(dict.fromkeys([*self.o.exclude, *more]))

    @cached_property
    def files(self) -> DataFrame:
        o = self.o
        listed = source.git_files(self.spark, o.path, o.git_filter) if o.git_filter != "None" else None
        if self._files is not None:
            return source.select_files(self._files, self.patterns, o.preview_exts, o.include_non_preview, o.directories_only, listed)
        found = source.scan(self.spark, o.path, self.patterns, o.preview_exts, o.include_non_preview, o.max_preview_size_mb, listed)
        return found.limit(0) if o.directories_only else found

    @cached_property
    def focus(self) -> tuple[str | None, str | None]:
        """Path part and keyword."""
        parts = (self.o.focus or "").split(":")
        return (parts[0], parts[1]) if len(parts) == 2 and all(parts) else (None, self.o.focus or None)

    @cached_property
    def edges(self) -> DataFrame:
        return graph.dependencies(self.files)

    @cached_property
    def focused(self) -> DataFrame:
        """The files that focus and closure select."""
        part, keyword = self.focus
        if not keyword:
            return self.files
        path, content = F.col("rel_path"), F.col("content")
        out = self.files.filter(F.contains(F.concat(F.lit(self.o.path.rstrip("/") + "/"), path), F.lit(part))) if part else self.files
        named = F.contains(T.file_name(path), F.lit(keyword))
        defined = C.blocks(F.when(~named & F.contains(content, F.lit(keyword)), content), T.extension(path), keyword).isNotNull()
        roots = out.filter(named | defined)
        if not self.o.resolve_deps:
            return roots
        wanted = graph.closure(self.edges, roots.select(path.alias("id")))
        return self.files.join(wanted, self.files["rel_path"] == wanted["id"], "left_semi")

    @cached_property
    def vocabulary(self) -> DataFrame:
        return tags.vocabulary(tags.terms(self.files.filter(F.col("rel_path") == self.o.vocab_file), "rel_path", "content"))

    @cached_property
    def idf(self) -> DataFrame:
        return tags.inverse_document_frequency(tags.terms(self.focused.filter("content <> ''").select("rel_path", T.summary(F.col("content")).alias("text")), "rel_path"))

    def _tagged(self, files: DataFrame, summary: Column) -> DataFrame:
        rows = files.select("rel_path", "content", summary.alias("summary"))
        return tags.file_tags(rows, self.idf, self.vocabulary)

    @cached_property
    def features(self) -> DataFrame:
        """rel_path, mtime, content, summary, tags of the selected files, strict tags applied."""
        own = self._tagged(self.focused, T.summary(F.col("content")))
        out = self.focused.join(own, "rel_path").withColumn("summary", T.summary(F.col("content")))
        return out.filter(tags.has_tags(F.col("tags"), list(self.o.tag))) if self.o.tag else out

    def candidates(self) -> DataFrame:
        """What a dry run lists: before any search."""
        return self.features.select("rel_path", "tags")

    @cached_property
    def corpus(self) -> DataFrame:
        """id, text that are searched; current cached summaries are used where there are any."""
        text = search.search_text(F.col("summary"), F.col("tags"))
        rows = cached.looked_up(self.features, self.cache, self.settings)
        short = F.coalesce("cached_content", text)
        return rows.select(F.col("rel_path").alias("id"), F.concat(short, F.lit("\n\n"), "content").alias("text") if self.o.search_full else short.alias("text"))

    @property
    def settings(self) -> Column:
        return cached.settings_key("summary", self.o.vocab_file, self.o.focus or "")

    @cached_property
    def hits(self) -> DataFrame:
        """id, combined, bm25, similarity of the best files."""
        lexical = search.bm25(self.corpus, self.o.search or "")
        similar = search.vector_scores(self.o.vectors, self.o.query_vector) if self.o.semantic_search and self.o.vectors is not None and self.o.query_vector else None
        return search.top_hits(search.hybrid(lexical, similar, semantic=self.o.semantic_search), self.o.top_k)

    @cached_property
    def smart_dependencies(self) -> DataFrame:
        """id of what the selected files import directly and that isn't selected."""
        return graph.direct_dependencies(self.edges, self.features.select(F.col("rel_path").alias("id")))

    @cached_property
    def shown(self) -> DataFrame:
        """rel_path, mode, preview of every file of the output.

        After a search, hits are shown in full and the other selected files as summaries; without hits nothing is shown.
        """
        o = self.o
        out = self.features.withColumn("is_dependency", F.lit(False))
        if o.smart_context:
            more = self.smart_dependencies
            added = self.files.join(more, self.files["rel_path"] == more["id"], "left_semi").withColumns({"summary": T.summary(F.col("content")), "tags": F.array().cast("array<string>"), "is_dependency": F.lit(True)})
            out = out.unionByName(added, allowMissingColumns=True)
        chosen = self.spark.createDataFrame(list(o.modes.items()), "rel_path string, chosen string")
        out = out.join(F.broadcast(chosen), "rel_path", "left").filter("chosen IS DISTINCT FROM 'x'")  # options of one call
        full = list(o.full)
        if o.search:
            full += [r[0] for r in self.hits.select(T.file_name(F.col("id"))).collect()]  # top_k rows
            out = out if full else out.limit(0)
        mode = render.mode(T.file_name(F.col("rel_path")), F.col("chosen"), full, o.outline, o.summary_only or bool(o.search), F.col("is_dependency"))
        out = out.withColumn("mode", mode)
        first = F.when(F.col("summary") == "", K.NO_SUMMARY).otherwise(F.col("summary"))
        final = self._tagged(out.filter("mode = 'summary'"), first).withColumnRenamed("tags", "_tags")
        out = out.join(final, "rel_path", "left").withColumn("tags", F.coalesce("_tags", "tags"))
        return render.shown(out, self.focus[1], o.preview_lines)

    def fresh_cache(self) -> DataFrame:
        text = search.search_text(F.col("summary"), F.col("tags"))
        return self.features.select("rel_path", "mtime", self.settings.alias("settings"), text.alias("cached_content"))

    def tree(self) -> DataFrame:
        return trees.rendered(trees.nodes(self.shown.select(F.col("rel_path").alias("path"))))

    def markdown(self) -> DataFrame:
        """rel_path, sort, text: a section for each file, in tree order."""
        order = self.tree().select("path", "sort")
        rows = self.shown.join(order, F.col("rel_path") == F.col("path"))
        return rows.select("rel_path", "sort", render.markdown(F.col("rel_path"), F.col("preview")).alias("text"))

    def text(self) -> str:
        return "\n".join(r["text"] for r in self.markdown().orderBy("sort").collect())

    def json(self, name: str) -> dict:
        return trees.as_json(trees.nodes(self.shown.select(F.col("rel_path").alias("path"))), self.shown.select(F.col("rel_path").alias("path"), "preview"), name)

    def tokens(self, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
        """tokens: of the text under a rank file, section by section; without one a quarter of the characters."""
        if ranks_path and pattern:
            return self.markdown().agg(F.sum(token_count.tokens(F.concat("text", F.lit("\n")), ranks_path, pattern)).alias("tokens"))
        return self.markdown().agg(F.sum(F.length("text") + 1).alias("chars")).select(F.floor(F.col("chars") / 4).cast("bigint").alias("tokens"))
