"""Token ids and token counts under public vocabularies.

A text is cut at white space into chunks that the vocabulary's own pre-tokenizer never joins, so that
each distinct chunk is encoded once per Python worker and then looked up.  The caches hold two generations
of a fixed number of entries, so memory is bounded whatever the text, and chunks in use stay.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm._shared import bounded, need

#: Entries of a cache's generation.
CACHE = 450_000

#: White space of the libraries' patterns (Unicode White_Space), for use inside a character class.
WHITE = "\t-\r \x85\xa0  -     　"
#: Letters that are letters, and composed, in every version of Unicode.
LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_CHUNKS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_PLAIN = re.compile(rf"([ \n]?)([{LETTER}]+)([.,!?;:]*)")
_PLAIN_WORD = re.compile(rf"([{LETTER}]+)([.,!?;:]*)")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = [""] * 256
    for b in printable:
        out[b] = chr(b)
    spare = 256
    for b in range(256):
        if not out[b]:
            out[b] = chr(spare)
            spare += 1
    return out


#: The array type of 4 bytes.
_WORD = next(c for c in "IL" if array(c).itemsize == 4)
_SYMBOL = dict(enumerate(byte_symbols()))


def to_symbols(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(_SYMBOL)


class Cache(dict):
    """Key -> make(key), in two generations: what the younger one lacks is taken over from the older or made."""

    def __init__(self, make: Callable, most: int | None = None):
        super().__init__()
        self.make, self.most, self.old = make, most or CACHE, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Chunk of text -> its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        kind = json.loads(self.library.to_str())
        if kind.get("truncation") or kind.get("padding"):
            raise ValueError("truncating or padding tokenizers aren't supported")
        self.lowers = kind.get("normalizer") is not None
        self.model = self.library.model
        self.chunks = Cache(self.chunk)

    def library_ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        """One pre-token of letters and perhaps a space before, by the library's model."""
        return array(_WORD, [t.id for t in self.model.tokenize(piece.replace(" ", _SYMBOL[32]) if piece.isascii() else to_symbols(piece))]).tobytes()


class ByteLevelEncoder(Encoder):
    """White space belongs to the following word: chunks are white space and what follows it."""

    def chunk(self, chunk: str) -> bytes:
        m = _PLAIN.fullmatch(chunk)
        if m is None:
            return self.library_ids(chunk)
        gap, word, marks = m.groups()
        if not marks and gap != "\n":
            return self.piece(chunk)
        known = self.chunks
        return (known["\n"] + known[word] if gap == "\n" else known[gap + word]) + (known[marks] if marks else b"")

    def ids(self, raw: bytes) -> bytes:
        return b"".join(map(self.chunks.__getitem__, _CHUNKS.findall(raw.decode())))


class WordEncoder(Encoder):
    """White space is dropped and letters are lower-cased: chunks are words."""

    def chunk(self, chunk: bytes) -> bytes:
        word = chunk.decode()
        m = _PLAIN_WORD.fullmatch(word)
        if m is None:
            return self.library_ids(word)
        if not m[2]:
            return self.piece(word.lower())
        return self.chunks[m[1].lower().encode()] + self.chunks[m[2].encode()]

    def ids(self, raw: bytes) -> bytes:
        # the special strings are found in the text as it is, so a text that may hold one isn't lower-cased
        return b"".join(map(self.chunks.__getitem__, (raw if b"<|" in raw else raw.lower()).split()))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _ENCODERS:
        with open(path) as f:
            drops = json.load(f).get("normalizer") is not None
        _ENCODERS[path] = (WordEncoder if drops else ByteLevelEncoder)(path)
    return _ENCODERS[path]


# ---------------------------------------------------------------------------------------------- counting


class PairMerger:
    """Byte-pair merging with a heap of adjacent pairs over a doubly linked list of symbols.

    The lowest-rank pair, leftmost first, is popped and merged until no pair has a rank.  Only the
    number of symbols left is kept: initial symbols minus merges.
    """

    def __init__(self, merges: list, suffix: str):
        self.rank = {tuple(p) if isinstance(p, list) else tuple(p.split(" ")): r for r, p in enumerate(merges)}
        self.suffix = suffix

    def count(self, symbols: list[str]) -> int:
        n = len(symbols)
        if n < 2:
            return n
        s = list(symbols)
        s[-1] += self.suffix
        rank = self.rank.get
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, s[i], s[i + 1]) for i in range(n - 1) if (r := rank((s[i], s[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if s[i] != a or j >= n or s[j] != b:
                continue  # one of the two has been merged since
            merged = s[i] = a + b
            s[j] = ""
            merges += 1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (r := rank((merged, s[k]))) is not None:
                    heapq.heappush(heap, (r, i, merged, s[k]))
            h = left[i]
            if h >= 0 and (r := rank((s[h], merged))) is not None:
                heapq.heappush(heap, (r, h, s[h], merged))
        return n - merges


class Counter:
    """Chunk of text -> its number of tokens, without any id.

    The library's normaliser and pre-tokenizer give the pieces of unusual chunks; pieces are merged
    by PairMerger.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("a plain byte-pair vocabulary is needed")
        self.front = Tokenizer.from_file(path)
        self.words = spec.get("normalizer") is not None
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(re.escape(t) for t in sorted(special, key=len, reverse=True))) if special else None
        self.merger = PairMerger(model["merges"], model.get("end_of_word_suffix") or "")
        self.pieces = Cache(self.merger_count, CACHE // 4)
        self.chunks = Cache(self.chunk)

    def merger_count(self, symbols: str) -> int:
        return self.merger.count(list(symbols))

    def plain(self, text: str) -> int:
        if self.front.normalizer is not None:
            text = self.front.normalizer.normalize_str(text)
        return sum(self.pieces[p] for p, _ in self.front.pre_tokenizer.pre_tokenize_str(text))

    def unusual(self, text: str) -> int:
        if self.special is None:
            return self.plain(text)
        found = len(self.special.findall(text))
        return found + sum(self.plain(part) for part in self.special.split(text) if part)

    def chunk(self, key) -> int:
        text = key.decode() if self.words else key
        m = (_PLAIN_WORD if self.words else _PLAIN).fullmatch(text)
        if m is None:
            return self.unusual(text)
        known = self.chunks
        if self.words:
            return known[m[1].lower().encode()] + known[m[2].encode()] if m[2] else self.merger_count(to_symbols(text.lower()))
        gap, word, marks = m.groups()
        if not marks and gap != "\n":
            return self.merger_count(to_symbols(text))
        return (known["\n"] + known[word] if gap == "\n" else known[gap + word]) + (known[marks] if marks else 0)

    def count(self, raw: bytes) -> int:
        if self.words:
            return sum(map(self.chunks.__getitem__, (raw if b"<|" in raw else raw.lower()).split()))
        return sum(map(self.chunks.__getitem__, _CHUNKS.findall(raw.decode())))


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, n_bytes, n_tokens, over_limit for every row; one pass, no shuffle.

    Null or empty text has 0 bytes and 0 tokens.  Repeated rows and null ids give a row each.  Texts of
    any length are counted whole.  Other columns are left out.  `vocabulary` is a byte-pair tokenizer file
    at the same place on every executor.
    """
    if id_col == text_col:
        raise ValueError("two columns are needed")
    rows = need(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("raw"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(vocabulary)
        for b in bounded(batches, "raw"):
            raws = b.column(1).to_pylist()
            n = np.fromiter(map(tokens.count, raws), np.int64, len(raws))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.fromiter(map(len, raws), np.int64, len(raws))), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
