"""Splitting texts into overlapping chunks, for prose and for code.

A text is cut after the coarsest separator that occurs in it, and what is too
long after the next finer one; pieces are gathered into chunks that each begin
with the tail of the one before. Everything is kept as bounds in the text:
chunks are slices of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.columns import normalized
from marlstone.session import bounded

# fixed values: separators from coarse to fine; an empty one means fixed slices
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
# fixed values: sizes and overlaps of chunks, and what marks a text as code
PROSE, CODE = (1500, 150), (2000, 200)
CODE_SUFFIXES = (
    "py", "pyi", "js", "jsx", "ts", "tsx", "go", "rs", "java", "kt", "rb", "c", "h", "cc", "cpp", "hpp", "cs", "swift", "php", "sh", "bash", "zsh", "sql",
)
#: Characters of chunks that a task holds before it hands them on.
BATCH_CHARS = 1 << 20
SCHEMA = "doc_id long, position int, text string, start_char int, end_char int, chunk_hash string"


@dataclass(frozen=True)
class Chunk:
    start: int
    end: int


def bounds(text: str, size: int) -> Iterator[int]:
    """Ends of the pieces of a text, each piece of ``size`` characters at most."""
    open_ = [(0, len(text), 0)]  # spans that are left, the next one last; the separators before the number are used up
    while open_:
        a, b, level = open_.pop()
        if b - a <= size:
            if b > a:
                yield b
            continue
        while SEPARATORS[level] and text.find(SEPARATORS[level], a, b) < 0:
            level += 1
        sep = SEPARATORS[level]
        if not sep:
            yield from (min(b, x + size) for x in range(a, b, size))
            continue
        cuts, at = [a], text.find(sep, a, b)
        while at >= 0:
            cuts.append(at + len(sep))
            at = text.find(sep, cuts[-1], b)
        if cuts[-1] < b:
            cuts.append(b)
        open_ += [(x, y, level + 1) for x, y in zip(reversed(cuts[:-1]), reversed(cuts[1:]), strict=True)]


def chunks_of(text: str, size: int = PROSE[0], overlap: int = PROSE[1]) -> list[Chunk]:
    """Chunks as bounds, where they stand; one that equals an earlier passage is told at the first place from

    the overlap with the chunk before on, which is what a search for its text would find.
    """
    spans, start, end = [], 0, 0
    for stop in bounds(text, size):
        if end > start and stop - start > size:
            spans.append((start, end))
            start = end - overlap if 0 < overlap < end - start else end
        end = stop
    if end > start:
        spans.append((start, end))
    told: list[Chunk] = []
    for a, b in spans:
        low = max(told[-1].start + 1, told[-1].end - overlap) if told else 0
        at = text.find(text[a:b], low, b) if low < a else a
        told.append(Chunk(at, at + b - a) if at >= 0 else Chunk(a, b))
    return told


# fixed values: parts of a type that name a programming language
CODE_MARKS = ("python", "typescript", "javascript", "go", "rust", "java", "kotlin", "ruby", "c++", "csharp", "swift", "php", "shellscript", "sql")


def is_code(uri: Column, mime: Column) -> Column:
    """Whether the suffix, or a type of ``text/x-`` or ``application/x-``, names a programming language."""
    suffix = F.lower(F.regexp_extract(F.coalesce(uri, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    kind = F.lower(F.coalesce(mime, F.lit("")))
    marked = reduce(lambda a, b: a | b, (kind.contains(m) for m in CODE_MARKS))
    return suffix.isin(*CODE_SUFFIXES) | ((kind.startswith("text/x-") | kind.startswith("application/x-")) & marked)


def unseen(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs (file_hash, text) that have a text and whose hash is not among ``known`` (file_hash); a null hash is never known."""
    return docs.where(F.rlike("text", F.lit(r"\S"))).join(known.where("file_hash IS NOT NULL").select("file_hash").distinct(), "file_hash", "left_anti")


def chunk(docs: DataFrame, size: int = PROSE[0], overlap: int = PROSE[1], normalize: bool = True) -> DataFrame:
    """doc_id, position, text, start_char, end_char and chunk_hash of every chunk.

    Texts are normalised first, in the same pass; a null text, or one of blanks alone, has no chunks.
    """
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())
    named = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in kinds]
        held = 0

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=named)
            for c in cols:
                c.clear()
            return out

        for batch in batches:
            for d, x in zip(batch.column(0), batch.column(1), strict=True):  # one text at a time becomes a string of Python
                t = x.as_py()
                if t is None or not t.strip(" \t\n\x0b\f\r"):
                    continue
                t = normalized(t) if normalize else t
                for k, c in enumerate(chunks_of(t, size, overlap)):
                    own = t[c.start : c.end]
                    for col, v in zip(cols, (d.as_py(), k, own, c.start, c.end, hashlib.sha256(own.encode()).hexdigest()), strict=True):
                        col.append(v)
                    held += len(own)
                    if held >= BATCH_CHARS:
                        yield told()
                        held = 0
        if cols[0]:
            yield told()

    bounded(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def chunk_by_kind(docs: DataFrame) -> DataFrame:
    """Chunks of documents with uri and mime, with splitter: code in longer chunks than prose."""
    code = is_code(F.col("uri"), F.col("mime"))
    told = lambda df, of, name: chunk(df, *of).withColumn("splitter", F.lit(name))
    return told(docs.where(~code), PROSE, "text").union(told(docs.where(code), CODE, "code_fallback"))
