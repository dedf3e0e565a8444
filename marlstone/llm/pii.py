"""Personal data: base patterns, and a skip-chain conditional random field.

Base spans (email, ip, card, phone) come from fixed patterns with their
checks. The field then labels every token that holds a digit or an ``@``:
neighbouring tokens are chained, and tokens that repeat or resemble each other
(equal without case, equal digits, or the same six first or last digits) are
joined by skip edges, wherever in the document they stand. Tokens of base
spans are observed; sum-product messages run over chains and skips until they
settle, for as many rounds as there are tokens at least, so a witness is heard
throughout a document. A token that is no base span becomes a further span if
it is more likely some kind than none. Without a witness, that is a base span
among the tokens that skip edges lead to, it also has to be as likely as a
threshold asks that is learned too: on every ``HELD_OUT``-th document of the
sample the labels are hidden, and the threshold is the least one at which
``PRECISE`` of the spans found there by form and chains are base spans. So a
number with the form of a card but a wrong check digit needs a witness.

Weights are learned here by pseudo-likelihood: a softmax over a token's form
and its neighbours' and twins' labels, from base spans of at most ``TRAIN_DOCS``
documents of at most ``TRAIN_CHARS`` characters (the first by a hash).
Tokens are joined to the next of their like, and to the first observed one of
each kind among their like, so edges stay linear.

Texts without any base span are labelled too, by form and chains alone.

Messages that still change after as many rounds as there are tokens and
``SWINGS`` more swing for ever: a token that hears one becomes no further span.

Defined cases: a null text counts as empty and has no spans; a text without
tokens of interest has its base spans alone; base spans of different kinds may
overlap and all stay; a token that is as likely some kind as none, or as two
kinds, takes none, or the first kind listed; repeated rows are treated alike;
extra columns stay as they are, whatever their names; an empty table gives no
rows and trains nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.tables import table
from marlstone.llm.textops import tune

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0: none
TRAIN_DOCS, TRAIN_CHARS = 1500, 20_000
FEATURES = 512
SETTLED, SWINGS = 1e-4, 200
HELD_OUT, PRECISE = 4, 0.95

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if k % 2:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """All base spans, by start and then kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if re.search("[0-9]", text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = _NOT_DIGIT.sub("", m[0])
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def tokens(text: str) -> list[tuple[int, int]]:
    """Cores of the tokens of interest: without the punctuation around them."""
    out = []
    for m in _TOKEN.finditer(text):
        a, b = m.start(), m.end()
        while a < b and not (text[a].isalnum() or text[a] == "+"):
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _form(text: str, a: int, b: int) -> list[int]:
    """Feature numbers of a token."""
    core = text[a:b]
    digits = sum("0" <= c <= "9" for c in core)
    letters = sum(c.isalpha() for c in core)
    shape = re.sub(r"(.)\1+", r"\1", "".join("9" if "0" <= c <= "9" else "a" if c.isalpha() else c for c in core[:64]))
    names = (
        f"digits{min(digits, 20)}", f"letters{min(letters, 4)}", f"at{'@' in core}", f"dots{min(core.count('.'), 4)}", f"dashes{min(core.count('-'), 4)}",
        f"plus{core[0] == '+'}", f"shape{shape[:12]}", f"before{text[max(0, a - 1):a]}", f"after{text[b:b + 1]}", f"part{digits * 4 // max(1, b - a)}",
    )
    return [crc32(n.encode()) % FEATURES for n in names]


def _keys(core: str) -> list[tuple]:
    """What a token has in common with those that repeat or resemble it."""
    d = _NOT_DIGIT.sub("", core)
    keys = [("same", core)]
    if len(d) >= 6:
        keys += [("digits", d), ("head", d[:6]), ("tail", d[-6:])]
    if "@" in core:
        keys.append(("name", core.split("@", 1)[0]))
    return keys


def skips(text: str, toks: list[tuple[int, int]], seen: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of tokens that repeat or resemble each other: each with the next of its like.

    With ``seen``, also each unobserved token with the first observed one of each kind among its like.
    """
    last: dict[tuple, int] = {}
    witness: dict[tuple, dict[int, int]] = {}
    alike = [_keys(text[a:b].casefold()) for a, b in toks]
    out = set()
    for i, keys in enumerate(alike):
        for k in keys:
            if (j := last.get(k)) is not None:
                out.add((j, i))
            last[k] = i
            if seen is not None and seen[i]:
                witness.setdefault(k, {}).setdefault(int(seen[i]), i)
    if witness:
        for i, keys in enumerate(alike):
            if not seen[i]:
                out.update((min(i, j), max(i, j)) for k in keys for j in witness.get(k, {}).values())
    return sorted(out)


def observed(toks: list[tuple[int, int]], spans: list[Span]) -> np.ndarray:
    """The base kind (from 1) of each token, 0 for none."""
    out = np.zeros(len(toks), dtype=np.int64)
    live: list[Span] = []
    k = 0
    for i, (a, b) in enumerate(toks):
        while k < len(spans) and spans[k][0] < b:
            live.append(spans[k])
            k += 1
        live = [s for s in live if s[2] > a]
        if live:
            out[i] = 1 + min(s[1] for s in live)
    return out


class Field:
    """Weights: form x label, and label x label for chain and skip edges."""

    def __init__(self) -> None:
        self.form = np.zeros((FEATURES, LABELS))
        self.chain = np.zeros((LABELS, LABELS))
        self.skip = np.zeros((LABELS, LABELS))
        self.least = 0.0  # how likely a further span's kind has to be

    def unary(self, text: str, toks: list[tuple[int, int]]) -> np.ndarray:
        return np.array([self.form[_form(text, a, b)].sum(axis=0) for a, b in toks])

    def beliefs(self, unary: np.ndarray, seen: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Marginals by loopy sum-product; ``chain`` and ``skip`` hold index pairs."""
        u = unary.copy()
        fixed = np.flatnonzero(seen > 0)
        u[fixed] = -1e9  # beyond what any number of twins can say against it
        u[fixed, seen[fixed]] = 0.0
        ends = np.concatenate((chain, skip))
        if len(ends):
            pot = np.concatenate((np.broadcast_to(self.chain, (len(chain), LABELS, LABELS)), np.broadcast_to(self.skip, (len(skip), LABELS, LABELS))))
            src, dst = np.concatenate((ends[:, 0], ends[:, 1])), np.concatenate((ends[:, 1], ends[:, 0]))
            pots = np.concatenate((pot, pot.transpose(0, 2, 1)))
            m = len(ends)
            back = np.concatenate((np.arange(m, 2 * m), np.arange(m)))
            msg = np.zeros((2 * m, LABELS))
            # no path is longer than the number of tokens, so the bound only ends what swings for ever
            swing = np.zeros(2 * m, dtype=bool)
            for _ in range(len(u) + SWINGS):
                total = u.copy()
                np.add.at(total, dst, msg)
                x = (total[src] - msg[back])[:, :, None] + pots
                top = x.max(axis=1, keepdims=True)
                new = np.log(np.exp(x - top).sum(axis=1)) + top[:, 0, :]
                new -= new.max(axis=1, keepdims=True)
                swing = np.abs(new - msg).max(axis=1) >= SETTLED
                if not swing.any():
                    break
                msg = 0.5 * (msg + new)
            np.add.at(u, dst, msg)
            unsure = np.unique(dst[swing])
            unsure = unsure[seen[unsure] == 0]
            u[unsure] = -1e9
            u[unsure, 0] = 0.0
        u -= u.max(axis=1, keepdims=True)
        p = np.exp(u)
        return p / p.sum(axis=1, keepdims=True)

    def more_spans(self, text: str, spans: list[Span]) -> list[Span]:
        toks = tokens(text)
        if not toks:
            return []
        seen = observed(toks, spans)
        if (seen > 0).all():
            return []
        chain, skip = self.edges(text, toks, seen)
        p = self.beliefs(self.unary(text, toks), seen, chain, skip)
        best = p.argmax(axis=1)
        heard = seen > 0
        while len(skip):  # along the skip edges from the base spans on
            more = heard.copy()
            more[skip[:, 0]] |= heard[skip[:, 1]]
            more[skip[:, 1]] |= heard[skip[:, 0]]
            if (more == heard).all():
                break
            heard = more
        sure = (seen == 0) & (best > 0) & (heard | (p.max(axis=1) >= self.least))
        return [(toks[i][0], int(best[i]) - 1, toks[i][1]) for i in np.flatnonzero(sure).tolist()]

    @staticmethod
    def edges(text: str, toks: list[tuple[int, int]], seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chain and skip edges of a text's tokens."""
        chain = np.array([(i, i + 1) for i in range(len(toks) - 1) if toks[i + 1][0] - toks[i][1] <= 2], dtype=np.int64).reshape(-1, 2)
        return chain, np.array(skips(text, toks, seen), dtype=np.int64).reshape(-1, 2)


def least_sure(field: Field, texts: list[str], precise: float = PRECISE) -> float:
    """The least belief from which on ``precise`` of the kinds that the field gives to hidden tokens are those of the patterns.

    It lies half way to the next belief below; 0 where nothing is to be kept out.
    """
    found: list[tuple[float, bool]] = []
    for t in texts:
        if toks := tokens(t):
            none = np.zeros(len(toks), dtype=np.int64)
            p = field.beliefs(field.unary(t, toks), none, *field.edges(t, toks, none))
            best, truth = p.argmax(axis=1), observed(toks, base_spans(t))
            found += [(float(p[i, best[i]]), bool(best[i] == truth[i])) for i in np.flatnonzero(best > 0).tolist()]
    found.sort(reverse=True)
    right, least = 0, 1.0
    for n, (p, ok) in enumerate(found, 1):
        right += ok
        after = found[n][0] if n < len(found) else -p  # below the last there is nothing to keep out
        if right >= precise * n and after < p:
            least = (p + after) / 2
    return least if found else 0.0


def learn(texts: list[str], rounds: int = 150, rate: float = 0.5, l2: float = 1e-3) -> Field:
    """Pseudo-likelihood: each token's label given its form and the labels around it."""
    field = Field()
    forms, around, twins, y = [], [], [], []
    for t in texts:
        toks = tokens(t)
        if not toks:
            continue
        seen = observed(toks, base_spans(t))
        near = np.zeros((len(toks), LABELS))
        for i in range(len(toks) - 1):
            if toks[i + 1][0] - toks[i][1] <= 2:
                near[i, seen[i + 1]] += 1
                near[i + 1, seen[i]] += 1
        like = np.zeros((len(toks), LABELS))
        for i, j in skips(t, toks):
            like[i, seen[j]] += 1
            like[j, seen[i]] += 1
        for i, (a, b) in enumerate(toks):
            forms.append(_form(t, a, b))
            around.append(near[i])
            twins.append(like[i])
            y.append(seen[i])
    if not y or len(set(y)) < 2:
        field.form[:, 0] = 0.1
        field.skip = 3.0 * np.eye(LABELS)
        return field
    x, c, s = np.array(forms), np.array(around), np.array(twins)
    goal = np.eye(LABELS)[np.array(y)]
    # twins always agree in the sample, so their weight starts where agreement pays and is held back by l2 alone
    field.skip = 3.0 * np.eye(LABELS)
    for _ in range(rounds):
        z = field.form[x].sum(axis=1) + c @ field.chain + s @ field.skip
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        g = (goal - p / p.sum(axis=1, keepdims=True)) / len(y)
        step = np.zeros_like(field.form)
        for k in range(x.shape[1]):
            np.add.at(step, x[:, k], g)
        field.form += rate * (step - l2 * field.form)
        up = c.T @ g
        field.chain += rate * ((up + up.T) / 2 - l2 * field.chain)
        up = s.T @ g
        field.skip += rate * ((up + up.T) / 2 - l2 * (field.skip - 3.0 * np.eye(LABELS)))
    return field


def train(docs: DataFrame, rows: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> Field:
    ids = docs.where(F.col("doc_id").isNotNull() & (F.length("text") <= chars)).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    some = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where(F.length("text") <= chars)
    got = some.groupBy("doc_id").agg(F.min("text").alias("text")).collect()  # one text an id
    texts = [r["text"] for r in sorted(got, key=lambda r: (r["doc_id"], r["text"]))]
    field = learn([t for k, t in enumerate(texts) if k % HELD_OUT])
    field.least = least_sure(field, texts[::HELD_OUT])
    return field


def _cleaned(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by the name of its first kind."""
    out, at = [], 0
    k = 0
    while k < len(spans):
        a, kind, b = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < b:
            b = max(b, spans[k][2])
            k += 1
        out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _mapped(docs: DataFrame, field: Field, keep: list[str], fields: str, make: Callable[[str | None, list[Span], list[Span]], tuple], kinds: tuple) -> DataFrame:
    tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(field)
    read = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_text"))
    names = [*keep, *[f.split()[0] for f in fields.split(", ")]]
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in read.schema.fields[:-1]] + [fields])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            cols: list[list] = [[] for _ in kinds]
            for t in batch.column(len(keep)).to_pylist():
                base = base_spans(t) if t else []
                for c, v in zip(cols, make(t, base, sent.value.more_spans(t, base) if t else []), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=names)

    return read.mapInArrow(run, schema)


def _told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each kind, the digest of the base spans, and all spans."""

    def make(_: str | None, base: list[Span], more: list[Span]) -> tuple:
        n = [sum(s[1] == k for s in base) for k in range(len(KINDS))]
        return (*n, hashlib.sha256(_told(base).encode()).hexdigest(), _told(sorted(base + more)))

    fields = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return _mapped(docs, train(docs), ["doc_id"], fields, make, (pa.int64(),) * 4 + (pa.string(),) * 2)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of their texts replaced by its kind; all columns as they were otherwise."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row")

    def make(t: str | None, base: list[Span], more: list[Span]) -> tuple:
        return (_cleaned(t, sorted(base + more)) if base or more else t,)

    out = _mapped(docs.select(row, "text"), train(docs), ["_row"], "_new string", make, (pa.string(),))
    return out.select(*[F.col("_new").alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_pii": op1}
