"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features, those of its neighbours and the
labels' transitions give the field; forward-backward sums give the marginal of
each line; a document's quality is the mean of its lines' marginals, weighted
by length, and calibrated.

Weights are fitted here: labelled documents give their label to their lines,
and the conditional likelihood is climbed on a bounded sample of them, each
read whole. Scores read texts only, one at a time, in pieces of so many lines
that a text of millions of lines needs some tens of bytes a line besides itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import exp, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_text, python_on

#: Labelled documents that the fit reads at most, and lines that they have together at most.
FIT_DOCUMENTS, FIT_LINES = 4000, 200_000
#: Lines whose features are made at a time; numbers of a group of chains that are worked off side by side, and lines from which a chain is by itself.
PIECE, GROUP_CELLS, LONG_LINES = 4096, 1 << 16, 2048
STEPS = 250
SYMBOLS = b"#*$%&|<>{}[]=_~^\\/@+"
DIGITS = b"0123456789"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
N_FEATURES = 16


def line_ends(text: bytes) -> np.ndarray:
    """Where each line of a text ends."""
    return np.append(np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 10), len(text))


def pieces(text: bytes, ends: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """The lines of a text, some at a time, with the number of the first."""
    for at in range(0, len(ends), PIECE):
        start = int(ends[at - 1]) + 1 if at else 0
        yield at, text[start : int(ends[min(at + PIECE, len(ends)) - 1])].split(b"\n")


def place_features(hashes: np.ndarray) -> np.ndarray:
    """What a line's place says, from the hashes of all lines: as the one before, times seen before, share of distinct lines so far."""
    n = len(hashes)
    order = np.argsort(hashes, kind="stable")
    in_order = hashes[order]
    first = np.flatnonzero(np.concatenate(([True], in_order[1:] != in_order[:-1])))
    again = np.empty(n, dtype=np.int64)
    again[order] = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    out = np.zeros((n, 3))
    out[1:, 0] = hashes[1:] == hashes[:-1]
    out[:, 1] = np.minimum(again, 5) / 5
    out[:, 2] = np.cumsum(again == 0) / np.arange(1, n + 1)
    return out


def word_features(lines: list[bytes]) -> np.ndarray:
    """What each line says by itself."""
    out = np.zeros((len(lines), N_FEATURES - 3))
    for f, line in zip(out, lines):
        ws = line.split()
        n, nw = len(line), len(ws)
        f[0] = np.log1p(nw)
        if nw:
            mean = (n - nw + 1) / nw
            kinds = len(set(ws))
            triples = list(zip(ws, ws[1:], ws[2:]))
            f[1] = mean / 8
            f[2] = (n - len(line.translate(None, SYMBOLS))) / nw
            f[3] = ws.count(b"|") / nw
            f[4] = (n - len(line.translate(None, DIGITS))) / n
            f[5] = (n - len(line.translate(None, UPPER))) / nw
            f[6] = (n - len(line.translate(None, LETTERS))) / n
            f[7] = kinds / nw
            f[8] = 1 - len(set(triples)) / len(triples) if triples else 0.0
            f[9] = line[-1:] in (b".", b"!", b"?")
            f[10] = sum(len(w) == 1 for w in ws) / nw
            f[11] = (mean > 12) + (mean < 3)
            f[12] = nw < 5
    return out


def features(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Features of a text's lines by themselves, some lines at a time, with the number of the first."""
    ends = line_ends(text)
    hashes = np.empty(len(ends), dtype=np.uint64)
    for at, lines in pieces(text, ends):
        hashes[at : at + len(lines)] = np.fromiter(map(xxhash.xxh64_intdigest, lines), dtype=np.uint64, count=len(lines))
    places = place_features(hashes)
    for at, lines in pieces(text, ends):
        yield at, np.hstack([word_features(lines), places[at : at + len(lines)]])


def chain_features(text: bytes) -> np.ndarray:
    """Features of each line, of the lines before and after it, and a constant."""
    own = np.vstack([x for _, x in features(text)])
    none = np.zeros((1, own.shape[1]))
    return np.hstack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none]), np.ones((len(own), 1))])


def line_sizes(text: bytes) -> np.ndarray:
    """Bytes of each line, its end counted."""
    return np.diff(line_ends(text), prepend=-1).astype(float)


def marginals(unary: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and expected transitions (chains, 2, 2).

    unary: (chains, lines), the log odds of good by itself, padded; move: log potentials [label, next label].
    """
    d, n = unary.shape
    at = np.arange(n) < lengths[:, None]
    a = np.zeros((d, n, 2))
    b = np.zeros((d, n, 2))
    a[:, 0, 1] = unary[:, 0]
    for t in range(1, n):
        for y in (0, 1):
            a[:, t, y] = np.logaddexp(a[:, t - 1, 0] + move[0, y], a[:, t - 1, 1] + move[1, y]) + (unary[:, t] if y else 0.0)
    for t in range(n - 2, -1, -1):
        inside = at[:, t + 1]
        for y in (0, 1):
            on = np.logaddexp(move[y, 0] + b[:, t + 1, 0], move[y, 1] + unary[:, t + 1] + b[:, t + 1, 1])
            b[:, t, y] = np.where(inside, on, 0.0)
    both = a + b
    total = np.logaddexp(both[:, 0, 0], both[:, 0, 1])
    good = 1 / (1 + np.exp(np.clip(both[:, :, 0] - both[:, :, 1], -700, 700)))
    pairs = np.zeros((d, 2, 2))
    if n > 1:
        inside = at[:, 1:]
        for y in (0, 1):
            for z in (0, 1):
                log = a[:, :-1, y] + move[y, z] + (unary[:, 1:] if z else 0.0) + b[:, 1:, z] - total[:, None]
                pairs[:, y, z] = np.where(inside, np.exp(np.minimum(log, 0.0)), 0.0).sum(axis=1)
    return np.where(at, good, 0.0), pairs


def chain_odds(unary: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Log odds of good of each line; (chains, lines), padded. As marginals, in half the numbers and without transitions."""
    n = unary.shape[1]
    ahead, behind = unary.copy(), np.zeros_like(unary)
    for t in range(1, n):
        a = ahead[:, t - 1]
        ahead[:, t] += np.logaddexp(move[0, 1], a + move[1, 1]) - np.logaddexp(move[0, 0], a + move[1, 0])
    for t in range(n - 2, -1, -1):
        x = unary[:, t + 1] + behind[:, t + 1]
        behind[:, t] = np.where(t + 1 < lengths, np.logaddexp(move[1, 0], x + move[1, 1]) - np.logaddexp(move[0, 0], x + move[0, 1]), 0.0)
    return ahead + behind


def long_chain_odds(unary: np.ndarray, move: np.ndarray) -> np.ndarray:
    """chain_odds of one chain, number by number."""
    (m00, m01), (m10, m11) = np.exp(move - move.max()).tolist()

    def carry(x: float, bad_good: float, good_bad: float) -> float:
        if x > 0:
            e = exp(-x)
            return log((bad_good * e + m11) / (m00 * e + good_bad))
        e = exp(x)
        return log((bad_good + m11 * e) / (m00 + good_bad * e))

    out = np.empty(len(unary))
    a = 0.0
    for at in range(0, len(unary), PIECE):
        part = unary[at : at + PIECE].tolist()
        for i, u in enumerate(part):
            a = u + carry(a, m01, m10) if at or i else u
            part[i] = a
        out[at : at + PIECE] = part
    b = 0.0
    for at in reversed(range(0, len(unary), PIECE)):
        part = unary[at : at + PIECE].tolist()
        for i in reversed(range(len(part))):
            u, part[i] = part[i], b
            b = carry(u + b, m10, m01)
        out[at : at + PIECE] += part
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    move: np.ndarray
    slope: float
    shift: float

    def unary(self, text: bytes) -> np.ndarray:
        """Log odds of good of each line by itself."""
        weights = self.weights / self.scale
        parts = weights[:-1].reshape(3, N_FEATURES).T
        each = np.vstack([x @ parts for _, x in features(text)])
        out = each[:, 0] + weights[-1] - self.mean @ weights
        out[1:] += each[:-1, 1]
        out[:-1] += each[1:, 2]
        return out

    def document_scores(self, texts: Iterable[bytes]) -> np.ndarray:
        """Quality of each text, from 0 to 1."""
        means: list[float] = []
        waiting: list[tuple[int, np.ndarray, np.ndarray]] = []

        def work_off() -> None:
            """Chains of like length side by side, so that padding is small."""
            waiting.sort(key=lambda w: len(w[1]))
            while waiting:
                longest = len(waiting[-1][1])
                group = [waiting.pop() for _ in range(min(len(waiting), max(1, GROUP_CELLS // longest)))]
                unary, size = np.zeros((2, len(group), longest))
                for r, (_, u, s) in enumerate(group):
                    unary[r, : len(u)], size[r, : len(u)] = u, s
                good = sigmoid(chain_odds(unary, np.array([len(u) for _, u, _ in group]), self.move))
                for (i, _, s), total in zip(group, (good * size).sum(axis=1)):
                    means[i] = total / s.sum()

        held = 0
        for i, text in enumerate(texts):
            unary, size = self.unary(text), line_sizes(text)
            means.append(0.0)
            if len(unary) > LONG_LINES:
                means[i] = float(sigmoid(long_chain_odds(unary, self.move)) @ size / size.sum())
            else:
                waiting.append((i, unary, size))
                held += len(unary)
            if held > 8 * GROUP_CELLS:
                work_off()
                held = 0
        work_off()
        return self.calibrated(np.array(means))

    def calibrated(self, mean: np.ndarray) -> np.ndarray:
        p = np.clip(mean, 1e-6, 1 - 1e-6)
        return sigmoid(self.slope * np.log(p / (1 - p)) + self.shift)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def fit(chains: list[np.ndarray], sizes: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, decay: float = 0.02) -> Model:
    """Climb the conditional likelihood of line labels (the document's own), each document counting alike."""
    width = 3 * N_FEATURES + 1
    if not chains:
        return Model(np.zeros(width), np.ones(width), np.zeros(width), np.zeros((2, 2)), 1.0, 0.0)
    lengths = np.array([len(c) for c in chains])
    rows = np.vstack(chains)
    mean, scale = rows.mean(axis=0), rows.std(axis=0)
    scale[scale < 1e-6] = 1.0
    mean[-1], scale[-1] = 0.0, 1.0
    rows = (rows - mean) / scale
    groups, left = [], np.argsort(-lengths, kind="stable")
    while len(left):  # chains of like length together, so that padding is small
        most = max(1, min(250, GROUP_CELLS // lengths[left[0]]))
        groups.append(left[:most])
        left = left[most:]
    first = np.concatenate(([0], np.cumsum(lengths)))
    padded = []
    for g in groups:
        place = np.minimum(first[g][:, None] + np.arange(lengths[g].max()), len(rows) - 1)
        padded.append((rows[place], lengths[g], labels[g].astype(float)))
    weights, move = np.zeros(width), np.zeros((2, 2))
    grad_sum = np.zeros(width + 4)

    def expectations():
        for x, n, y in padded:
            yield x, n, y, *marginals(x @ weights, n, move)

    for _ in range(steps):
        grad = np.zeros(width + 4)
        for x, n, y, good, pairs in expectations():
            share = 1.0 / n
            inside = np.arange(x.shape[1]) < n[:, None]
            grad[:width] += np.einsum("dl,dlf->f", np.where(inside, y[:, None] - good, 0.0) * share[:, None], x)
            truth = np.zeros_like(pairs)
            truth[:, 0, 0], truth[:, 1, 1] = (n - 1) * (1 - y), (n - 1) * y
            grad[width:] += ((truth - pairs) * share[:, None, None]).sum(axis=0).ravel()
        grad = grad / len(labels) - decay * np.concatenate([weights, move.ravel()]) * np.append(np.ones(width - 1), [0.0] + [1.0] * 4)
        grad_sum = 0.9 * grad_sum + 0.1 * grad**2 if grad_sum.any() else grad**2
        change = 0.05 * grad / (np.sqrt(grad_sum) + 1e-8)
        weights += change[:width]
        move += change[width:].reshape(2, 2)
    model = Model(mean, scale, weights, move, 1.0, 0.0)
    means = np.empty(len(labels))
    for g, (x, n, y, good, _) in zip(groups, expectations()):
        size = np.zeros(good.shape)
        for r, i in enumerate(g):
            size[r, : lengths[i]] = sizes[i]
        means[g] = (good * size).sum(axis=1) / size.sum(axis=1)
    p = np.clip(means, 1e-6, 1 - 1e-6)
    z = np.stack([np.log(p / (1 - p)), np.ones(len(p))], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(20):  # Newton's steps towards the calibration, held near (1, 0)
        q = 1 / (1 + np.exp(-z @ beta))
        slope = z.T @ (labels - q) - (beta - [1.0, 0.0])
        bend = (z * (q * (1 - q))[:, None]).T @ z + np.eye(2)
        beta = beta + np.linalg.solve(bend, slope)
    model.slope, model.shift = float(max(beta[0], 1e-3)), float(beta[1])
    return model


def learn(
    df: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", documents: int = FIT_DOCUMENTS, lines: int = FIT_LINES
) -> Model:
    """Fit on labelled rows of df for which ``may_learn`` (of column id) holds: in the order of a hash, as many as have
    ``documents`` rows and ``lines`` lines together at most. A row that would pass that sum is passed over; all others are read whole.

    labels: doc_id, quality; of several labels of an id the largest counts, null ones don't. Equal rows count once.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("label"))
    chosen = known.where(may_learn).orderBy(F.xxhash64("id"), "id").limit(documents)
    rows = python_on(df).select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    n_lines = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    listed = rows.join(F.broadcast(chosen), "id").select("id", "h", n_lines.alias("n")).orderBy(F.xxhash64("id"), "id", "h").limit(documents)
    taken, sum_of_lines = [], 0
    for r in listed.distinct().orderBy(F.xxhash64("id"), "id", "h").collect():  # bounded by ``documents``
        if sum_of_lines + r["n"] <= lines:
            taken.append((r["id"], r["h"]))
            sum_of_lines += r["n"]
    wanted = df.sparkSession.createDataFrame(taken, T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("h", T.LongType())]))
    texts = rows.join(F.broadcast(wanted), ["id", "h"]).groupBy("id", "h").agg(F.first("text").alias("text")).join(F.broadcast(chosen), "id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], []
            for text in batch.column(0).to_pylist():
                out.append(chain_features(text).astype("<f4").tobytes())
                size.append(line_sizes(text).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(size, pa.binary()), *batch.columns[1:]], names=["x", "size", "label", "at"])

    at = F.struct(F.xxhash64("id"), "id", "h").cast("string")
    got = texts.select(F.col("text").cast("binary").alias("text"), F.col("label").cast("int").alias("label"), at.alias("at")).mapInArrow(read, "x binary, size binary, label int, at string").collect()
    got.sort(key=lambda r: r["at"])
    chains = [np.frombuffer(bytes(r["x"]), dtype="<f4").reshape(-1, 3 * N_FEATURES + 1).astype(float) for r in got]
    sizes = [np.frombuffer(bytes(r["size"]), dtype="<f8") for r in got]
    return fit(chains, sizes, np.array([float(r["label"] > 0) for r in got]))


def score_quality(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with ``score`` (replacing a column of that name): from 0 to 1, higher for good texts.

    Null texts count as empty, one line without words. Equal texts have equal
    scores, up to the last bits. Texts of any number of lines are read whole.
    An empty table gives an empty table.
    """
    df = python_on(df).select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != "score"])
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                scores = model.document_scores((t.as_py() or "").encode() for t in part.column(place))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=schema.names)

    return df.mapInArrow(run, schema)


def third(column: Column) -> Column:
    """crc32(id as text) mod 3."""
    return F.crc32(id_text(column)) % 3


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = learn(docs, labels, third(F.col("id")) != 1)
    return score_quality(docs, model).select(
        "doc_id", (third(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
