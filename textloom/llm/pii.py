"""Personal data: exact patterns, extended by a skip-chain conditional random field.

Patterns give the base spans, which always stay. The field then labels the
other tokens of a document that hold a digit or an at sign. Its nodes are
those tokens and the base spans, which are clamped to their kind. Besides the
chain between neighbours, skip edges join each node to the next one that
spells the same value (the same digits, the same last ten digits, the same
address), however far away. Loopy sum-product messages run over the graph, and
a token whose marginal for a kind passes one half becomes a span: a card
number written with dots, a telephone number without its plus sign, when the
document spells it out elsewhere.

An edge's weight depends on what is observed: among mentions of a value of
which one is a base span it is ``skip``, among others ``weak``. Tokens that
spell the same value and are no base span (a date, an order number, said twice)
share potentials too, but do not make each other personal data. That can be
shown: by itself a kind is ``outside - shape`` below none. Over an edge of
weight w, a node where a kind has at most one half lifts that kind by at most
log((1 + e^w) / 2), and a base span by w. A node has two chain edges and, without
support, at most six weak ones (before and after, by address, by all digits and
by the last ten). ``Potentials`` checks that these together stay below
``outside - shape``; so, round by round, no marginal passes one half. Texts in
which no base span is repeated have nothing to add, and skipping the messages
there changes no result.

No labels exist for personal data, so potentials are parameters, not learnt.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import python_on

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-".decode())
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A match starts where a run of digits starts, and runs never need to give back.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_NOT_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: each at sign looks back over its run, so long runs cost their length once."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        if at >= free:
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at)):
                out.append((start, m.end()))
                free = m.end()
            elif start == at or not m:
                free = max(free, at + 1)
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in code points, end exclusive."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if not _DIGIT.search(text):
        return out
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGITS.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGITS.sub("", m[0])) <= 15]
    return out


@dataclass(frozen=True)
class Potentials:
    """Log potentials; labels are none and then KINDS."""

    clamped: float = 30.0
    outside: float = 2.5
    shape: float = 1.5
    chain: float = 0.1
    #: Of edges among mentions of a value that a base span spells, and among others.
    skip: float = 4.0
    weak: float = 0.2
    rounds: int = 12
    #: Digits from which a value names something by itself.
    least_digits: int = 8
    tail_digits: int = 10

    def __post_init__(self) -> None:
        if self.outside - self.shape <= 2 * self.chain + 6 * np.log((1 + np.exp(self.weak)) / 2):
            raise ValueError("tokens could become spans without the support of a base span")


def _keys(value: str, p: Potentials) -> list[str]:
    """Names of what a token spells, by which skip edges find it again."""
    digits = _NOT_DIGITS.sub("", value)
    keys = []
    if "@" in value:
        keys.append("a:" + value.lower())
    if len(digits) >= p.least_digits:
        keys.append("d:" + digits)
    if len(digits) >= p.tail_digits:
        keys.append("t:" + digits[-p.tail_digits :])
    return keys


def _shape(value: str, p: Potentials) -> np.ndarray:
    """What a token looks like by itself."""
    out = np.zeros(1 + len(KINDS))
    out[0] = p.outside
    digits = _NOT_DIGITS.sub("", value)
    if "@" in value[1:-1]:
        out[1] += p.shape
    if value.count(".") == 3 and len(digits) <= 12:
        out[2] += p.shape
    if 16 <= len(digits) <= 19:
        out[3] += p.shape
    if 8 <= len(digits) <= 15:
        out[4] += p.shape
    return out


def _marginals(unary: np.ndarray, edges: np.ndarray, weights: np.ndarray, rounds: int) -> np.ndarray:
    """Loopy sum-product; an edge adds its weight where both ends have one kind that is not none."""
    n, k = unary.shape
    if not len(edges):
        return _softmax(unary)
    gain = np.zeros((2 * len(edges), k))
    gain[:, 1:] = np.expm1(np.concatenate([weights, weights]))[:, None]
    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    sent = np.zeros((len(source), k))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, target, sent)
        carry = belief[source] - sent[back]
        carry = np.exp(carry - carry.max(axis=1, keepdims=True))
        new = np.log(carry.sum(axis=1, keepdims=True) + gain * carry)
        new -= new.max(axis=1, keepdims=True)
        if np.abs(new - sent).max() < 1e-4:
            break
        sent = new
    belief = unary.copy()
    np.add.at(belief, target, sent)
    return _softmax(belief)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


_TRIM = "()[]{}<>\"'`,;:!?."


class _Groups:
    """Mentions joined by the values that they share."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.root(j)] = self.root(i)


def field_of(text: str, base: dict[str, list[tuple[int, int]]], p: Potentials = Potentials()) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray, np.ndarray, bool]:
    """Nodes (start, end, label of a base span or 0), unary potentials, edges, their weights, and whether a base span's value is repeated."""
    covered = sorted((s, e, k) for k, spans in base.items() for s, e in spans)
    starts = [c[0] for c in covered]
    furthest = list(accumulate((e for _, e, _ in covered), max))
    nodes = [(s, e, 1 + KINDS.index(k)) for s, e, k in covered]
    for m in _TOKEN.finditer(text):
        if not ("@" in m[0] or _DIGIT.search(m[0])):
            continue
        value = m[0].strip(_TRIM)
        if not value:
            continue
        start = m.start() + m[0].find(value)
        end = start + len(value)
        i = bisect_right(starts, end - 1) - 1
        if i < 0 or furthest[i] <= start:  # no base span that starts before the token's end reaches into it
            nodes.append((start, end, 0))
    nodes.sort()
    unary = np.zeros((len(nodes), 1 + len(KINDS)))
    edges = [(i - 1, i) for i in range(1, len(nodes))]
    chain = len(edges)
    groups, last = _Groups(len(nodes)), {}
    for i, (s, e, label) in enumerate(nodes):
        value = text[s:e]
        if label:
            unary[i, label] = p.clamped
        else:
            unary[i] = _shape(value, p)
        near = set()
        for key in _keys(value, p):
            if key in last and last[key] not in near:
                near.add(last[key])
                edges.append((last[key], i))
                groups.join(last[key], i)
            last[key] = i
    supported = {groups.root(i) for i, (_, _, label) in enumerate(nodes) if label}
    weights = [p.chain] * chain + [p.skip if groups.root(i) in supported else p.weak for i, _ in edges[chain:]]
    return nodes, unary, np.array(edges, dtype=np.int64).reshape(-1, 2), np.array(weights), p.skip in weights[chain:]


def added_spans(text: str, base: dict[str, list[tuple[int, int]]], p: Potentials = Potentials()) -> list[tuple[str, int, int]]:
    """Spans that the field adds: tokens that overlap no base span."""
    if not any(base.values()):
        return []  # without support no token passes one half
    nodes, unary, edges, weights, supported = field_of(text, base, p)
    if not supported:
        return []
    out = []
    for (s, e, label), m in zip(nodes, _marginals(unary, edges, weights, p.rounds)):
        k = int(m.argmax())
        if not label and k and m[k] > 0.5:
            out.append((KINDS[k - 1], s, e))
    return out


def find_spans(text: str | None) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """Base spans by kind, and all spans in order of kind, then place."""
    text = text or ""
    base = base_spans(text)
    every = [(k, s, e) for k in KINDS for s, e in base[k]]
    every += added_spans(text, base)
    return base, sorted(every, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of df: doc_id, n_<kind> (base spans), base_spans, spans (kind:start:end, comma-joined).

    Null texts count as empty and have no spans. Ids are passed on, null or
    repeated. Other columns are not read. Texts are worked off one by one,
    whole, with tokens of any length. An empty table gives an empty table.
    """
    schema = T.StructType(
        [T.StructField("doc_id", df.schema[id_col].dataType)]
        + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
        + [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, spans = [], []
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(1).slice(at, 256).to_pylist():
                    base, every = find_spans(text)
                    for c, k in zip(counts, KINDS):
                        c.append(len(base[k]))
                    digests.append(hashlib.sha256(_joined([(k, s, e) for k in KINDS for s, e in base[k]]).encode()).hexdigest())
                    spans.append(_joined(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=schema.names,
            )

    return python_on(df).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def op5_personal_data(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
