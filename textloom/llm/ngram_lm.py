"""Language-model scoring with a weighted backoff automaton.

The model is an n-gram model with Dirichlet smoothing: with c(h) training
occurrences of a history h and mass m,

    p(w | h) = (c(hw) + m p(w | shorter h)) / (c(h) + m),

down to the add-one unigram model. As an automaton: seen histories are states;
seen n-grams are arcs that weigh log p(w | h); every state has a failure arc to
its shorter history that weighs log(m / (c(h) + m)); the root has an arc for
each word. A text is read once from left to right; each token follows failure
arcs until an arc takes it.

The counts grow with the corpus and are never gathered in one place. Texts are
grouped into blocks of bounded size. A block counts its distinct n-grams (64-bit
hashes) and sends each shard of the hash range one message with those it holds;
shards add the messages up and answer each with the totals; a block builds the
part of the automaton that its own texts can reach, and walks it. Training
counts are combined per block before they are sent, so a frequent word costs a
block one entry. All that a task holds is one block or one shard.
Equal rows are merged and counted before they are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, merge_equal, python_on, text_bytes

#: Text bytes that a block and a shard should hold.
BLOCK_BYTES = 6 << 20
ORDER = 2
#: Smoothing mass of histories of one word, of two, ...
MASS = (100.0, 10.0)
#: Texts are walked in pieces of so many tokens, side by side.
STRIDE = 256
END = np.uint64(xxhash.xxh64_intdigest(b"end of text \n"))
START = np.uint64(xxhash.xxh64_intdigest(b"start of text \n"))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_hashes(text: bytes) -> np.ndarray:
    """Hashes of the lower-cased words and one end."""
    ws = text.lower().split()
    out = np.empty(len(ws) + 1, dtype=np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, ws), dtype=np.uint64, count=len(ws))
    out[-1] = END
    return out


@dataclass
class Block:
    """The tokens of a block's texts, a start before each text, and its distinct n-grams.

    ``items[k - 1]`` numbers the k-gram that ends at each place, -1 where the
    text is too short. Items are sorted: unigrams by key, then all others.
    """

    tokens: np.ndarray
    starts: np.ndarray  # place of each text's start
    lengths: np.ndarray  # tokens of each text, end included
    keys: np.ndarray
    n_uni: int
    items: list[np.ndarray]
    order_of: np.ndarray
    at: np.ndarray  # a place where each item ends
    train: np.ndarray  # how often each place is learnt from


def read_block(texts: list[bytes], train: np.ndarray, order: int) -> Block:
    parts = [token_hashes(t) for t in texts]
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])).astype(np.int64)
    n = int(lengths.sum() + len(parts))
    tokens = np.empty(n, dtype=np.uint64)
    is_start = np.zeros(n, dtype=bool)
    is_start[starts] = True
    tokens[is_start] = START
    tokens[~is_start] = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    del parts
    place = np.arange(n) - np.repeat(starts, lengths + 1)  # tokens before, the start counted
    trained = np.repeat(train, lengths + 1)
    keys, order_of, at, items = [], [], [], []
    running, done = _mix(tokens + np.uint64(1)), 0
    for k in range(1, order + 1):
        if k > 1:
            shifted = np.empty_like(running)
            shifted[1:], shifted[0] = running[:-1], 0
            running = _mix(shifted * np.uint64(0x9E3779B97F4A7C15) + tokens + np.uint64(k))
        # the start alone counts among the others: it is a history, not a token
        for wanted in [(~is_start), is_start] if k == 1 else [place >= k - 1]:
            where = np.flatnonzero(wanted)
            found, first, inverse = np.unique(running[where], return_index=True, return_inverse=True)
            keys.append(found)
            at.append(where[first])
            order_of.append(np.full(len(found), k, dtype=np.int64))
            if k > 1 or wanted is not is_start:
                items.append(np.full(n, -1, dtype=np.int64)) if len(items) < k else None
            items[k - 1][where] = inverse.ravel() + done
            done += len(found)
    n_uni = len(keys[0])
    every = np.concatenate(keys)
    rank = np.concatenate([np.arange(n_uni), n_uni + np.argsort(every[n_uni:], kind="stable")])
    back = np.empty(len(rank), dtype=np.int64)
    back[rank] = np.arange(len(rank))
    items = [np.where(i >= 0, back[i], -1) for i in items]
    return Block(tokens, starts, lengths, every[rank], n_uni, items, np.concatenate(order_of)[rank], np.concatenate(at)[rank], trained)


def training_counts(block: Block) -> np.ndarray:
    out = np.zeros(len(block.keys), dtype=np.int64)
    for i in block.items:
        counted = (i >= 0) & (block.train > 0)
        out += np.bincount(i[counted], weights=block.train[counted], minlength=len(out)).astype(np.int64)
    return out


def _shard_edges(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's keys begin in sorted keys; the last is the end."""
    first = np.array([-(-(s << 64) // shards) for s in range(1, shards)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, first), [len(keys)])).astype(np.int64)


def _pack(values: np.ndarray) -> bytes:
    """Sorted or small 64-bit values: differences of sorted ones, byte planes, zstd."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel()


def _differences(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


class Automaton:
    """States, arcs and failure arcs that a block's texts can reach."""

    def __init__(self, block: Block, counts: np.ndarray, n: int, v: int, order: int, mass: tuple[float, ...]):
        k, at, items = block.order_of, block.at, block.items
        total = len(block.keys)
        self.base = np.log10((counts[: block.n_uni] + 1.0) / (n + v + 1.0))
        word = np.where(k == 1, np.arange(total), items[0][at])
        history = np.full(total, -1, dtype=np.int64)  # the item before the last word
        suffix = np.full(total, -1, dtype=np.int64)  # the item without its first word
        for j in range(2, order + 1):
            these = k == j
            history[these] = items[j - 2][at[these] - 1]
            suffix[these] = items[j - 2][at[these]]
        is_end = block.tokens[at] == END
        state = np.zeros(total, dtype=np.int64)
        seen = (counts > 0) & (k < order) & ~is_end
        state[seen] = np.arange(1, seen.sum() + 1)
        log_p = np.full(total, -np.inf)
        log_p[: block.n_uni] = self.base
        self.fail = np.zeros(int(seen.sum()) + 1, dtype=np.int64)
        self.fail_weight = np.zeros(len(self.fail))
        into = state.copy()
        for j in range(1, order + 1):
            these = np.flatnonzero(k == j)
            if j > 1:
                m, h, s = mass[j - 2], counts[history[these]], suffix[these]
                # the shorter n-gram was seen wherever this one was, so it is an arc with its own weight
                with np.errstate(divide="ignore"):
                    log_p[these] = np.log10((counts[these] + m * 10.0 ** log_p[s]) / (h + m))
                into[these] = np.where(state[these] > 0, state[these], np.where(is_end[these], 0, into[s]))
            here = these[seen[these]]
            self.fail[state[here]] = np.where(suffix[here] >= 0, state[suffix[here]], 0)
            self.fail_weight[state[here]] = np.log10(mass[j - 1] / (counts[here] + mass[j - 1])) if j < order else 0.0
        arcs = np.flatnonzero((k > 1) & (counts > 0))
        label = state[history[arcs]] << np.int64(32) | word[arcs]
        order_ = np.argsort(label)
        self.arc, self.arc_weight, self.arc_into = label[order_], log_p[arcs][order_], into[arcs][order_]
        self.root_into = into[: block.n_uni]
        start = items[0][block.starts[:1]]
        self.start = int(state[start[0]]) if len(start) else 0

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States and log probabilities after each state has read its word."""
        state, weight, out = state.copy(), np.zeros(len(state)), np.zeros(len(state), dtype=np.int64)
        open_ = np.arange(len(state))
        while len(open_):
            root = state[open_] == 0
            done = open_[root]
            weight[done] += self.base[word[done]]
            out[done] = self.root_into[word[done]]
            open_ = open_[~root]
            if not len(open_) or not len(self.arc):
                hit, at = np.zeros(len(open_), dtype=bool), np.zeros(len(open_), dtype=np.int64)
            else:
                label = state[open_] << np.int64(32) | word[open_]
                at = np.minimum(np.searchsorted(self.arc, label), len(self.arc) - 1)
                hit = self.arc[at] == label
                weight[open_[hit]] += self.arc_weight[at[hit]]
                out[open_[hit]] = self.arc_into[at[hit]]
            open_ = open_[~hit]
            weight[open_] += self.fail_weight[state[open_]]
            state[open_] = self.fail[state[open_]]
        return out, weight

    def walk(self, block: Block, order: int, stride: int = STRIDE) -> np.ndarray:
        """Log10 probability of each text.

        Long texts are walked in pieces side by side. The state depends on the
        last order - 1 tokens, so a piece reads those first, at no weight.
        """
        pieces = np.maximum(1, -(-block.lengths // stride))
        text = np.repeat(np.arange(len(pieces)), pieces)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = block.starts[text] + 1 + number * stride
        length = np.minimum(stride, block.lengths[text] - number * stride)
        words = block.items[0]
        state = np.where(number == 0, self.start, 0)
        for back in range(min(order - 1, stride), 0, -1):
            warm = np.flatnonzero(number > 0)
            if len(warm):
                state[warm] = self.step(state[warm], words[first[warm] - back])[0]
        by_length = np.argsort(-length, kind="stable")
        first, length, state, text = first[by_length], length[by_length], state[by_length], text[by_length]
        score = np.zeros(len(text))
        for t in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -t))  # pieces longer than t
            state[:n], weight = self.step(state[:n], words[first[:n] + t])
            score[:n] += weight
        return np.bincount(text, weights=score, minlength=len(pieces))


def score_texts(
    df: DataFrame, held_out: Column, order: int = ORDER, mass: tuple[float, ...] = MASS, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row a row of df: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from rows for which ``held_out`` isn't true. Null text
    counts as empty: it has the end alone. With no training rows all scores are
    those of the empty model, 0. Rows with equal ids are scored each for
    itself. Other columns are not read. An empty table gives an empty table.
    """
    if order < 2 or len(mass) < order - 1:
        raise ValueError("order must be 2 or more, with a mass for each length of history")
    kind = df.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    docs = python_on(df).select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("t"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    merged = merge_equal(docs, "copies")
    blocks = max(1, -(-text_bytes(docs, "t") // block_bytes))
    shards = blocks
    docs = merged.select("doc_id", F.col("t").cast("binary").alias("t"), "held_out", "copies", F.pmod(F.xxhash64("doc_id", "t"), F.lit(blocks)).alias("block"))

    def texts_of(part: pa.Table) -> tuple[list[bytes], np.ndarray]:
        learnt = ~part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        return part.column("t").to_pylist(), np.where(learnt, part.column("copies").to_numpy(), 0)

    def send(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        block = read_block(*texts_of(part), order)
        counts = training_counts(block)
        uni, more = _shard_edges(block.keys[: block.n_uni], shards), _shard_edges(block.keys[block.n_uni :], shards) + block.n_uni
        out = {"block": [], "shard": [], "n_uni": [], "keys": [], "counts": []}
        for s in range(shards):
            where = [slice(uni[s], uni[s + 1]), slice(more[s], more[s + 1])]
            out["block"].append(key[0].as_py())
            out["shard"].append(s)
            out["n_uni"].append(int(uni[s + 1] - uni[s]))
            out["keys"].append(_pack(np.concatenate([_differences(block.keys[w]) for w in where])))
            out["counts"].append(_pack(np.concatenate([counts[w] for w in where])))
        return pa.table(out)

    def add_up(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        n_uni = part.column("n_uni").to_pylist()
        keys, uni = [], []
        for data, n in zip(part.column("keys").to_pylist(), n_uni):
            steps = _unpack(data)
            keys.append(np.concatenate([np.cumsum(steps[:n], dtype=np.uint64), np.cumsum(steps[n:], dtype=np.uint64)]))
            uni.append(np.arange(len(steps)) < n)
        sizes = np.cumsum([0, *map(len, keys)])
        found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([_unpack(c).astype(np.int64) for c in part.column("counts").to_pylist()])
        total = np.bincount(inverse.ravel(), weights=counts, minlength=len(found)).astype(np.int64)
        is_uni = np.zeros(len(found), dtype=bool)
        is_uni[inverse.ravel()[np.concatenate(uni)]] = True
        n, v = int(total[is_uni].sum()), int((total[is_uni] > 0).sum())
        answers = [_pack(total[inverse.ravel()[sizes[i] : sizes[i + 1]]]) for i in range(len(keys))]
        return pa.table({"block": part.column("block"), "shard": part.column("shard"), "answer": pa.array(answers, pa.binary()), "n": pa.array([n] * len(keys), pa.int64()), "v": pa.array([v] * len(keys), pa.int64())})

    def score(key: tuple[pa.Scalar, ...], part: pa.Table, answers: pa.Table) -> pa.Table:
        block = read_block(*texts_of(part), order)
        answers = answers.sort_by("shard")
        n, v = sum(answers.column("n").to_pylist()), sum(answers.column("v").to_pylist())
        uni, more = _shard_edges(block.keys[: block.n_uni], shards), _shard_edges(block.keys[block.n_uni :], shards) + block.n_uni
        counts = np.zeros(len(block.keys), dtype=np.int64)
        for s, data in enumerate(answers.column("answer").to_pylist()):
            got = _unpack(data).astype(np.int64)
            here = uni[s + 1] - uni[s]
            counts[uni[s] : uni[s + 1]], counts[more[s] : more[s + 1]] = got[:here], got[here:]
        machine = Automaton(block, counts, n, v, order, mass)
        word = block.items[0]
        text = np.repeat(np.arange(len(block.starts)), block.lengths + 1)
        real = np.ones(len(word), dtype=bool)
        real[block.starts] = False
        word, text = word[real], text[real]
        size = len(block.starts)
        return pa.table(
            {
                "doc_id": part.column("doc_id"),
                "held_out": part.column("held_out"),
                "copies": part.column("copies"),
                "n_tokens": pa.array(block.lengths, pa.int64()),
                "n_known": pa.array(np.bincount(text, weights=counts[word] > 0, minlength=size).astype(np.int64)),
                "train_tokens": pa.array(np.full(size, n, dtype=np.int64)),
                "base_score": pa.array(np.bincount(text, weights=machine.base[word], minlength=size)),
                "score": pa.array(machine.walk(block, order)),
            }
        )

    sent = docs.groupBy("block").applyInArrow(send, "block long, shard long, n_uni long, keys binary, counts binary")
    answered = sent.groupBy("shard").applyInArrow(add_up, "block long, shard long, answer binary, n long, v long")
    scored = docs.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(
        score, f"doc_id {kind}, held_out boolean, copies long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return scored.select("*", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copies", "copy")


def op2_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs, F.crc32(id_text(F.col("doc_id"))) % 7 == 2)
