"""Column functions over text: lines, summaries, outlines, tokens, comments, coordinates, dates."""

from __future__ import annotations

import re
from fnmatch import translate

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions import constants as K

#: Where a text is cut into lines, as editors and scripting languages do.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_BLANK}+|{_BLANK}+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{_BLANK}+$", "")


def lines(c: Column) -> Column:
    """Lines without their ends; a break at the end starts no further line."""
    parts = F.split(c, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def first_lines(c: Column, n: Column | int) -> Column:
    """The first n lines; a negative n leaves out as many at the end."""
    n = F.lit(n) if isinstance(n, int) else n
    parts = lines(c)
    return F.array_join(F.slice(parts, 1, F.greatest(F.when(n < 0, F.size(parts) + n).otherwise(n), F.lit(0))), "\n")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def extension(path: Column) -> Column:
    """The lower-cased suffix with its dot; none for names that start with their only dot or end with one."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.when(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1) == "", name).otherwise(F.regexp_extract(name, r"(?s)^(.+)\.[^.]+$", 1))


def language(ext: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in K.LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, ext), F.lit(""))


def matches_any(name: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """Whether a name matches one of the shell patterns, case counting; one regular expression for all."""
    if not patterns:
        return F.lit(False)
    one = "|".join(_java_glob(p) for p in dict.fromkeys(patterns))
    return name.rlike(f"(?s)^(?:{one})$")


def _java_glob(pattern: str) -> str:
    out = re.sub(r"\(\?s:(.*)\)(\\Z|\\z)$", r"\1", translate(pattern), flags=re.S)
    return out.replace("(?>", "(?:")


def summary(content: Column) -> Column:
    """The comment a text opens with: a doc string, a block comment or a run of # or // lines; else empty."""
    c = F.regexp_replace(content, f"^{_BLANK}+", "")
    blocks = []
    for opening, closing in (('"""', '"""'), ("'''", "'''"), ("/*", "*/"), ("<!--", "-->")):
        pattern = f"(?s)^{_quote(opening)}(.*?){_quote(closing)}"
        blocks.append(F.when(c.rlike(pattern), strip(F.regexp_extract(c, pattern, 1))))
    trimmed = F.transform(lines(c), strip)
    marked = F.transform(trimmed, lambda x: x.startswith("#") | x.startswith("//"))
    end = F.array_position(marked, False)
    head = F.slice(trimmed, 1, F.when(end > 0, end.cast("int") - 1).otherwise(F.size(trimmed)))
    return F.coalesce(*blocks, F.array_join(F.transform(head, lambda x: F.regexp_replace(x, r"^(#|//+)[\s\p{Z}]*", "")), "\n"))


def _quote(s: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", s)


def outline(content: Column, ext: Column) -> Column:
    """Signature lines of classes and functions, by family of languages; other files give their summary."""
    rows = lines(content)

    def cut(x: Column) -> Column:
        whole = rstrip(x)
        return F.when(F.contains(whole, F.lit("{")), F.concat(rstrip(F.substring_index(whole, "{", 1)), F.lit(" { ... }"))).otherwise(F.concat(whole, F.lit(" ...")))

    python = F.transform(F.filter(rows, lambda x: x.rlike("(?U)" + K.OUTLINE_PYTHON)), lambda x: F.concat(rstrip(x), F.when(rstrip(x).endswith(":"), " ...").otherwise(": ...")))
    script = F.transform(F.filter(rows, lambda x: strip(x).rlike("(?U)" + K.OUTLINE_SCRIPT[0]) | strip(x).rlike("(?U)" + K.OUTLINE_SCRIPT[1])), cut)
    braces = F.transform(F.filter(rows, lambda x: (strip(x).rlike("(?U)" + K.OUTLINE_BRACES[0]) | strip(x).rlike("(?U)" + K.OUTLINE_BRACES[1])) & ~strip(x).endswith(";")), cut)
    found = F.when(ext == ".py", python).when(ext.isin(*K.SCRIPT_EXTS), script).when(ext.isin(*K.BRACE_EXTS), braces)
    return F.when(found.isNull(), summary(content)).when(F.size(found) == 0, K.NO_OUTLINE).otherwise(F.array_join(found, "\n"))


def identifiers(c: Column) -> Column:
    """Lower-cased words of 3 characters or more that could be names, without stop words, in order, repeats kept."""
    found = F.regexp_extract_all(c, F.lit(r"(?<![\p{L}\p{N}_])([a-zA-Z_][a-zA-Z0-9_]{2,})(?![\p{L}\p{N}_])"), F.lit(1))
    return F.filter(F.transform(found, F.lower), lambda w: ~w.isin(*[s for s in K.STOP_WORDS if len(s) > 2]))


def definitions(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(K.DEFINITION_PATTERN), F.lit(1)))


def words(c: Column) -> Column:
    """Search tokens of ASCII letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), F.lit(0))


def other_letters(c: Column) -> Column:
    """All other letters and digits of the whole text, joined."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]|[a-z0-9_]", "")


def search_tokens(c: Column) -> Column:
    """ASCII words, then the other letters in overlapping pairs (one letter stays alone)."""
    rest = other_letters(c)
    pairs = F.when(F.length(rest) > 1, F.regexp_extract_all(rest, F.lit(r"(?s)(?=(..))"), F.lit(1))).when(F.length(rest) == 1, F.array(rest)).otherwise(F.array().cast("array<string>"))
    return F.concat(words(c), pairs)


def query_tokens(text: str) -> list[str]:
    """search_tokens of one string, on the driver."""
    low = text.lower()
    rest = "".join(ch for ch in low if ch.isalnum() and not re.match("[a-z0-9_]", ch))
    return re.findall("[a-z0-9_]+", low) + ([rest] if len(rest) == 1 else [rest[i : i + 2] for i in range(len(rest) - 1)])


def is_word(token: str) -> bool:
    """Whether a search token is one of ASCII letters, digits and underscores."""
    return re.fullmatch("[a-z0-9_]+", token) is not None


def found_words(c: Column, tokens: list[str]) -> Column:
    """All occurrences of these ASCII search tokens in a text, by one pattern in one pass."""
    if not tokens:
        return F.array().cast("array<string>")
    return F.regexp_extract_all(F.lower(c), F.lit(rf"(?<![a-z0-9_])(?:{'|'.join(tokens)})(?![a-z0-9_])"), F.lit(0))


def token_count(c: Column, token: str) -> Column:
    """How often a search token occurs in a text, without building its token list."""
    if is_word(token):
        return F.regexp_count(F.lower(c), F.lit(rf"(?<![a-z0-9_]){token}(?![a-z0-9_])"))
    rest = other_letters(c)
    found = F.regexp_count(rest, F.lit(f"(?={_quote(token)})"))
    return found if len(token) > 1 else F.when(rest == token, 1).otherwise(0)


def without_comments(source: Column) -> Column:
    """Lines without # comments (quoted strings are kept), without blank lines and spaces at line ends."""
    quoted = r"""("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(#.*)"""
    cleaned = F.transform(lines(source), lambda x: rstrip(F.regexp_replace(x, quoted, "$1")))
    return F.array_join(F.filter(cleaned, lambda x: x != ""), "\n")


def packages(c: Column) -> Column:
    """Package lists of install commands, each to the end of its line."""
    return F.transform(F.regexp_extract_all(c, F.lit("(?U)" + K.PACKAGE_PATTERN), F.lit(1)), strip)


def cell_row(coordinate: Column) -> Column:
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(coordinate, "^[A-Z]+([0-9]+)", 1), F.lit("")), F.lit("9999999999")).cast("int"), F.lit(0))


def cell_column(coordinate: Column) -> Column:
    """A is 1, Z 26, AA 27; 0 where there is no coordinate."""
    letters = F.filter(F.split(F.regexp_extract(coordinate, "^([A-Z]+)[0-9]+", 1), ""), lambda x: x != "")
    return F.aggregate(letters, F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64)


def coordinate(row: Column, column: Column) -> Column:
    """The inverse, for columns up to ZZZ."""
    letter = lambda n: F.char(F.lit(65) + n)
    c = column - 1
    one = letter(c % 26)
    two = F.when(column > 26, letter((F.floor(c / 26) - 1) % 26)).otherwise("")
    three = F.when(column > 702, letter((F.floor((F.floor(c / 26) - 1) / 26) - 1) % 26)).otherwise("")
    return F.concat(three, two, one, row.cast("string"))


def serial_date(value: Column) -> Column:
    """The day of a workbook's date number as yyyy-MM-dd; null where it isn't a number."""
    days = F.floor(value.try_cast("double")).cast("int")
    return F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), days), "yyyy-MM-dd")


def half_points(value: Column) -> Column:
    return F.concat((value.try_cast("double") / 2).cast("string"), F.lit("pt"))
