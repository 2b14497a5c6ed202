"""Lists, patterns and numbers that results depend on."""

# Words that never become tags.
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "it", "this", "that")

# BM25 and hybrid search.
BM25_K1 = 1.5
BM25_B = 0.75
LEXICAL_WEIGHT = 0.3
VECTOR_WEIGHT = 0.7
TOP_K = 5
VOCABULARY_SIZE = 50
VOCABULARY_BOOST = 2.0
TAGS_PER_TEXT = 3
QUERY_PREFIX = "検索クエリ: "
DOCUMENT_PREFIX = "検索文書: "

# Limits of previews and sheets.
PREVIEW_LINES = 2000
PREVIEW_MB = 1.0
SHEET_ROWS = 300
SHEET_COLUMNS = 50

# Language of a file name's extension.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".java": "java", ".go": "go", ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp",
    ".cs": "c_sharp", ".rb": "ruby", ".php": "php", ".html": "html",
}

# Names left out of a scan.  The second list is that of the plain directory tree.
EXCLUDES = (
    "venv*", ".venv", ".env", ".git", "node_modules", "__pycache__", ".vscode", "_deps", "*.dir", "x64", ".cache",
    ".history", "*.pyc", "*.class", "*.egg-info", "dist", "build", ".ruff_cache", ".json", ".DS_Store",
    "package-lock.json", "yarn.lock", ".pytest_cache", ".onnx_cache",
)

# Extensions whose contents are shown.
PREVIEW_EXTS = (
    ".md", ".py", ".txt", ".json", ".yaml", ".yml", ".c", ".h", ".cpp", ".hpp", ".java", ".html", ".js", ".jsx",
    ".ts", ".tsx", ".sh", ".bat", ".ps1", ".css", ".sql", ".rs", ".go", ".dockerfile", "Dockerfile", ".toml", ".ini",
)

# Built-in number formats of workbooks that show dates, and letters that mark other ones.
DATE_FORMATS = (14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 45, 46, 47)
DATE_LETTERS = "dmyhs"

# Patterns of imports, definitions, outlines and packages.
IMPORT_PATTERNS = (r"import\s+.*\s+from\s+['\"](.+)['\"]", r"require\s*\(['\"](.+)['\"]\)", r"#include\s*[<\"](.+)[>\"]", r"use\s+(.+);")
DEFINITION_PATTERN = r"\b(?:class|def|function|struct|interface)\s+([a-zA-Z_][a-zA-Z0-9_]*)"
OUTLINE_PYTHON = r"^\s*(class|def|async\s+def)\s+"
OUTLINE_SCRIPT = (r"^(export\s+)?(default\s+)?(class|function|interface|type)\s+", r"^(export\s+)?const\s+\w+\s*=\s*(\(.*?\)|[^=\s]+)\s*=>")
OUTLINE_BRACES = (
    r"^((public|private|protected|internal|export|func|fn)\s+)?(static\s+)?(class|struct|interface|impl)\s+",
    r"^((public|private|protected|internal|export|func|fn)\s+)?(static\s+)?[a-zA-Z_]\w*(<.*?>)?\s+[a-zA-Z_]\w*\s*\(",
)
SCRIPT_EXTS = (".js", ".jsx", ".ts", ".tsx")
BRACE_EXTS = (".java", ".c", ".cpp", ".cs", ".rs", ".go", ".php")
PACKAGE_PATTERN = r"pip install ([\w -]+)"

# Texts of results.
NO_OUTLINE = "(No clear outline found)"
NO_SUMMARY = "(No summary provided)"
NO_PREVIEW = "(No content preview)"
DEPENDENCY_HEADER = "// [Smart Context: Auto-resolved Dependency Outline]"
EMPTY_ROW = "<EMPTY_ROW>"
