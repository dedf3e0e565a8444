"""Language ID: cross-parsing entropy against suffix automata.

For each language a suffix automaton of labelled text is built. A document is
parsed against it from left to right into the longest phrases that occur in
the language's text: as long as the automaton has an edge the phrase goes on,
else a new phrase begins at that character. The language that needs the
fewest phrases for the document's length wins; ties go to the first name.

Every letter that a sample holds is a symbol of its own, whatever its code
point; letters that no sample holds share one, and a run of other characters
counts as one blank. Many texts are parsed side by side, with one gather per
character and language for the edge and one for the way on from the root.
Every text is parsed whole. For speed it is parsed in segments of ``SEGMENT``
characters at once, each from the root; then each segment is entered again
with the state that the segment before it left, until both parses are in the
same state, from where they agree. Segments whose last state has changed by
that are followed by another round, so the phrases are those of one parse from
the first character to the last.

Learns every language that labels a document with a letter outside the
held-out third, from at most ``chars`` characters and ``docs_each`` documents
each: texts of 64 to chars / 4 characters first, by a hash, then chars / 4
characters of longer ones, then shorter ones. Languages are parsed in blocks
of automata of at most ``block_bytes``, so their number is bounded by time
alone. Defined cases: a text that is null or has no letter is ``und`` with
score 0; documents without a label are predicted like all; with no labelled
language every document is ``und``; a null doc_id is predicted like any and
teaches nothing; of rows that share a doc_id and a language one teaches, and
each is predicted by its own text; equal needs go to the first language by
name; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.features import fold
from marlstone.llm.tables import table
from marlstone.llm.textops import as_bytes, slices, tune

FOLDS = 3
CHARS = 20_000
DOCS_EACH = 24
SHORTEST = 64
SEGMENT = 256
BLOCK_BYTES = 128 << 20
_NEAR = 0x3000


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Edges of each state; state 0 is the root and every substring is a path from it."""
    edges: list[dict[int, int]] = [{}]
    link, size = [-1], [0]
    last = 0
    for c in text:
        cur = len(edges)
        edges.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = cur
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return edges


def _lower(cp: int) -> int:
    low = chr(cp).lower()
    return ord(low) if len(low) == 1 else cp


def _spoken(cls: np.ndarray) -> np.ndarray:
    """Which characters are parsed: letters, and the first of each run of others."""
    out = cls != 1
    out[1:] |= cls[:-1] != 1
    if len(out):
        out[0] = True
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Letters:
    """Classes of characters. 0: a letter that no sample has, 1: whatever is no letter, from 3 on: each learned letter."""

    def __init__(self, texts: list[str]):
        found = {_lower(cp) for t in texts for cp in np.unique(_points(t)).tolist() if chr(cp).isalpha()}
        self.learned = np.array(sorted(found), dtype=np.uint32)
        self.width = len(self.learned) + 3
        self.near = self._look_up(np.arange(_NEAR, dtype=np.uint32))

    def _look_up(self, points: np.ndarray) -> np.ndarray:
        out = np.ones(len(points), dtype=np.int32)
        letter = np.array([chr(p).isalpha() for p in points.tolist()], dtype=bool)
        low = np.array([_lower(p) for p in points[letter].tolist()], dtype=np.uint32)
        at = np.searchsorted(self.learned, low)
        known = at < len(self.learned)
        known[known] = self.learned[at[known]] == low[known]
        out[letter] = np.where(known, at + 3, 0)
        return out

    def classes(self, points: np.ndarray) -> np.ndarray:
        """Frequent code points by a table, the others by their distinct values."""
        out = self.near[np.minimum(points, _NEAR - 1)]
        far = np.flatnonzero(points >= _NEAR)
        if len(far):
            distinct, which = np.unique(points[far], return_inverse=True)
            out[far] = self._look_up(distinct)[which]
        return out


class Automaton:
    """Suffix automaton of a language's sample in one table of its own letters.

    A state is an offset of its own, and its edge for letter c lies in cell
    state + c: the upper half of the cell names the state that owns it, the
    lower half holds the next state. Cells are shared out by trial, so the
    table grows with the edges and not with the letters.
    """

    def __init__(self, classes: np.ndarray, width: int):
        own, text = np.unique(classes, return_inverse=True)
        # learned letters and blanks from 1 on; 0 is whatever the sample has not; -1 stays -1
        self.local = np.zeros(width + 1, dtype=np.int32)
        self.local[own] = np.arange(1, len(own) + 1)
        self.local[-1] = -1
        edges = suffix_automaton((text[_spoken(classes)] + 1).tolist())
        wide = len(own) + 1
        size = 3 * sum(map(len, edges)) + 2 * wide
        r = np.random.default_rng(1)
        used = np.zeros(size + wide, dtype=bool)
        taken, place = set(), [0] * len(edges)
        tries: list[int] = []
        for s in sorted(range(len(edges)), key=lambda s: (-len(edges[s]), s)):  # full states while there is room
            mine = list(edges[s])
            many = np.array(mine) if len(mine) > 8 else None
            while True:
                if not tries:
                    tries = r.integers(0, size, 1 << 14).tolist()
                at = tries.pop()
                if at not in taken and not (used[at + many].any() if many is not None else any(used[at + c] for c in mine)):
                    break
            taken.add(at)
            place[s] = at
            for c in mine:
                used[at + c] = True
        self.table = np.full(size + wide, -1, dtype=np.int64)
        for s, e in enumerate(edges):
            for c, to in e.items():
                self.table[place[s] + c] = place[s] << 32 | place[to]
        self.root = place[0]
        # where each letter leads as the first of a phrase
        self.start = np.array([place[edges[0].get(c, 0)] for c in range(wide)], dtype=np.int64)

    def phrases(self, codes: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Phrases that begin in each segment, the first of a text included.

        codes: (steps, segments) of classes, longest segments first, -1 after a segment's end.
        before: the number of the segment that comes before each in its text, -1 for the first.
        """
        steps, lanes = codes.shape
        states = np.empty((steps, lanes), dtype=np.int32)
        new = np.zeros((steps, lanes), dtype=bool)
        last = np.full(lanes, self.root, dtype=np.int64)
        alive = lanes
        for step in range(steps):
            c = self.local[codes[step, :alive]]
            if c[alive - 1] < 0:
                alive = int((c >= 0).sum())
                c = c[:alive]
            now = last[:alive]
            cell = self.table[now + c]
            fresh = (cell >> 32) != now
            new[step, :alive] = fresh
            last[:alive] = np.where(fresh, self.start[c], cell & 0xFFFFFFFF)
            states[step, :alive] = last[:alive]
        after = np.full(lanes, -1)
        after[before[before >= 0]] = np.flatnonzero(before >= 0)
        open_ = np.flatnonzero(before >= 0)
        while len(open_):
            lane, state = open_, last[before[open_]]
            ended: list[tuple[np.ndarray, np.ndarray]] = []
            for step in range(steps):
                c = self.local[codes[step, lane]]
                on = c >= 0
                if not on.all():
                    ended.append((lane[~on], state[~on]))
                    lane, state, c = lane[on], state[on], c[on]
                if not len(lane):
                    break
                cell = self.table[state + c]
                fresh = (cell >> 32) != state
                state = np.where(fresh, self.start[c], cell & 0xFFFFFFFF)
                new[step, lane] = fresh
                apart = states[step, lane] != state  # the same state from here on is the same parse
                states[step, lane] = state
                lane, state = lane[apart], state[apart]
            ended.append((lane, state))
            changed = np.concatenate([x for x, _ in ended])
            last[changed] = np.concatenate([x for _, x in ended])
            open_ = after[changed]
            open_ = np.sort(open_[open_ >= 0])
        return new.sum(axis=0) + (before < 0)


class Parser:
    """The letters of all samples and the automata of some or all languages."""

    def __init__(self, samples: dict[str, str], letters: Letters | None = None):
        self.languages = sorted(samples)
        self.letters = letters or Letters(list(samples.values()))
        self.automata = [Automaton(self.letters.classes(_points(samples[k])), self.letters.width) for k in self.languages]

    def needs(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases for a parsed character of each text (rows) in each language, and whether the text has a letter."""
        n = len(texts)
        points = [_points(t.decode("utf-8", "replace")) if t else np.zeros(0, np.uint32) for t in texts]
        sizes = np.array([len(p) for p in points], dtype=np.int64)
        if not sizes.sum():
            return np.zeros((n, len(self.automata))), np.zeros(n, dtype=bool)
        flat = self.letters.classes(np.concatenate(points))
        owner = np.repeat(np.arange(n), sizes)
        has = np.bincount(owner, weights=flat != 1, minlength=n) > 0
        said = _spoken(flat)
        flat, owner = flat[said], owner[said]
        sizes = np.bincount(owner, minlength=n)
        total = int(sizes.sum())
        first = np.concatenate(([0], np.cumsum(sizes)))
        per = -(-sizes // SEGMENT)
        seg_doc = np.repeat(np.arange(n), per)
        nth = np.arange(len(seg_doc)) - np.repeat(np.cumsum(per) - per, per)
        seg_at = first[seg_doc] + nth * SEGMENT
        seg_len = np.minimum(SEGMENT, first[seg_doc + 1] - seg_at)
        order = np.argsort(-seg_len, kind="stable")
        seg_doc, seg_at, seg_len = seg_doc[order], seg_at[order], seg_len[order]
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        before = np.where(nth[order] > 0, rank[np.maximum(order - 1, 0)], -1)
        steps = np.arange(int(seg_len[0]))
        index = np.minimum(seg_at[None, :] + steps[:, None], total - 1)
        codes = np.where(steps[:, None] < seg_len[None, :], flat[index], -1).astype(np.int32)
        out = np.zeros((n, len(self.automata)))
        for k, one in enumerate(self.automata):
            out[:, k] = np.bincount(seg_doc, weights=one.phrases(codes, before), minlength=n)
        return out / np.maximum(sizes, 1)[:, None], has


def judge(languages: list[str], need: np.ndarray, has: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    n = len(has)
    if not n or not languages:
        return ["und"] * n, np.zeros(n)
    best = need.argmin(axis=1)
    least = need[np.arange(n), best]
    rest = need.copy()
    rest[np.arange(n), best] = np.inf
    second = rest.min(axis=1)
    score = np.where(np.isfinite(second), second / np.maximum(second + least, 1e-9), 1.0)
    names = [languages[b] if h else "und" for b, h in zip(best, has, strict=True)]
    return names, np.where(has, score, 0.0)


def samples(docs: DataFrame, chars: int = CHARS, docs_each: int = DOCS_EACH) -> dict[str, str]:
    """Labelled text of every language, of at most ``chars`` characters, from documents that are not held out.

    Texts of ``SHORTEST`` to chars // 4 characters come first, then longer ones, of
    which the first chars // 4 characters with a letter on are taken, then shorter
    ones. Ids are chosen first, so that only chosen texts travel, one a doc_id.
    """
    most = chars // 4
    known = docs.where((fold("doc_id", FOLDS) != 1) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    size = F.length("text")
    later = F.when(size.between(SHORTEST, most), 0).when(size > most, 1).otherwise(2)
    narrow = known.select("doc_id", "lang", later.alias("_later")).groupBy("lang", "doc_id").agg(F.min("_later").alias("_later"))
    salted = narrow.withColumn("_h", F.xxhash64("doc_id")).withColumn("_s", F.pmod(F.shiftright("_h", 20), F.lit(64)))
    # each partition keeps the few first of each language before these are shuffled
    first = ("_later", "_h", "doc_id")
    local = salted.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*first))).where(F.col("_r") <= docs_each)
    chosen = local.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy(*first))).where(F.col("_k") <= docs_each)
    ids = chosen.select("doc_id", F.col("lang").alias("_lang"), "_k")
    taken = F.when(size > most, F.regexp_extract("text", rf"(?s)^\P{{L}}*(\p{{L}}.{{0,{most - 1}}})", 1)).otherwise(F.col("text"))
    rows = known.select("doc_id", "lang", later.alias("_later"), taken.alias("_text")).join(F.broadcast(ids.withColumnRenamed("_lang", "lang")), ["doc_id", "lang"])
    got = rows.groupBy("lang", "_k").agg(F.min(F.struct("_later", "_text"))["_text"].alias("_text")).collect()
    out: dict[str, str] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["_k"])):
        have = out.get(r["lang"], "")
        if len(have) + len(r["_text"]) + 1 <= chars or not have:
            out[r["lang"]] = have + " " + r["_text"] if have else r["_text"]
    return out


def blocks(found: dict[str, str], block_bytes: int = BLOCK_BYTES) -> Iterator[Parser]:
    """Parsers of some languages each, with about ``block_bytes`` of tables at most."""
    letters = Letters(list(found.values()))
    names, size = [], 0
    for k in sorted(found):
        need = 70 * len(found[k]) + 4 * letters.width  # fewer than 3 edges a character, 3 cells an edge, 8 bytes a cell
        if names and size + need > block_bytes:
            yield Parser({n: found[n] for n in names}, letters)
            names, size = [], 0
        names.append(k)
        size += need
    yield Parser({n: found[n] for n in names}, letters)


def predict(docs: DataFrame, chars: int = CHARS, docs_each: int = DOCS_EACH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    tune(docs.sparkSession)
    found = samples(docs, chars, docs_each)
    languages = sorted(found)
    sent = [docs.sparkSession.sparkContext.broadcast(p) for p in blocks(found, block_bytes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            cuts = list(slices(texts))
            needs = []
            for one in sent:
                parser = one.value
                got = [parser.needs(texts[lo:hi]) for lo, hi in cuts]
                needs.append(np.concatenate([g[0] for g in got]) if got else np.zeros((0, len(parser.languages))))
                has = np.concatenate([g[1] for g in got]) if got else np.zeros(0, dtype=bool)
                if len(sent) > 1 and one._path is not None:
                    del parser, one._value  # the next block takes its place; this one is read again from the worker's disk
            names, scores = judge(languages, np.concatenate(needs, axis=1), has)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (fold("doc_id", FOLDS) == 1).alias("held_out"), "lang_pred", "score")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_language_id": op9}
