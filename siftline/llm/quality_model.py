"""Quality classifier: a convolutional network over bytes, in NumPy.

Bytes are embedded; learned filters slide over overlapping chunks of 16 bytes (every 8) that cover the whole text; each
filter's largest response in the document is kept, and one logistic unit combines them into a probability. Beside the
embedded bytes a chunk has a channel for every distance up to ``LAGS``: how many of its bytes are those that stood so
far before. These let filters see that something is repeated, whatever it is, with a period longer than a chunk.

It is fitted on the driver on a bounded sample of labelled rows: at most ``per_class`` documents of either label, each
of at most ``max_bytes`` bytes, chosen by a hash of their ids. Scoring covers every whole text, in blocks of bounded size.

Defined results: a null or empty text is one chunk of padding and gets that chunk's score; repeated rows get equal
scores; an id with several labels counts with the largest; where the labels have one class or none, every score is
that class's share, or 0.5. Empty tables give empty results; other columns are ignored, and never inputs of a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops

STEP = 8
DIMS = 8
FILTERS = 64
LAGS = 24
PAD = 256
BLOCK_BYTES = 1_000_000


@dataclass
class Network:
    embed: np.ndarray  # 257 x DIMS; the last row is padding
    filters: np.ndarray  # 2 * (STEP * DIMS + LAGS) x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: float

    def responses(self, blocks: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        """Of each chunk (two neighbouring blocks of STEP bytes) in a run of blocks."""
        x = np.concatenate([self.embed[blocks].reshape(len(blocks), STEP * DIMS), repeats], 1)
        half = x.shape[1]
        both = x @ np.concatenate([self.filters[:half], self.filters[half:]], 1)
        return both[:-1, :FILTERS] + both[1:, FILTERS:] + self.bias

    def pooled(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The largest responses in each of the texts that lie end to end in ``data``."""
        blocks, first = layout(data, bounds)
        if len(first) == 2 and len(blocks) * STEP > BLOCK_BYTES:  # one long text, piece by piece
            size, back = BLOCK_BYTES // STEP, -(-LAGS // STEP)
            pieces = []
            for i in range(0, len(blocks) - 1, size):
                seen = min(i, back)  # blocks before the piece, for what is repeated from there
                repeats = lag_channels(blocks[i - seen : i + size + 1], np.zeros(1, np.int64))[seen:]
                pieces.append(self.responses(blocks[i : i + size + 1], repeats).max(0))
            return np.maximum.reduce(pieces)[None]
        r = self.responses(blocks, lag_channels(blocks, first[:-1]))
        r = np.concatenate([r, np.full((1, FILTERS), -np.inf, np.float32)])
        r[first[1:] - 1] = -np.inf  # chunks across two texts
        return np.maximum.reduceat(r, first[:-1])

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        z = np.maximum(self.pooled(data, bounds), 0).astype(np.float64) @ self.out.astype(np.float64) + self.out_bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def layout(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of STEP bytes, padded at each text's end, at least two a text; each text's first block, and their number."""
    size = np.diff(bounds)
    blocks = np.maximum(2, -(-size // STEP))
    first = np.concatenate([[0], np.cumsum(blocks)])
    out = np.full(first[-1] * STEP, PAD, np.uint16)
    out[np.repeat(first[:-1] * STEP - bounds[:-1], size) + np.arange(bounds[0], bounds[-1])] = data
    return out.reshape(-1, STEP), first


def lag_channels(blocks: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per block and distance 1 to LAGS the share of its bytes that equal the byte so far before, in the same text.

    ``first`` has the texts' first blocks."""
    flat = blocks.ravel()
    narrow = flat.astype(np.uint8)
    padding = np.flatnonzero(flat == PAD)
    starts = first * STEP
    out = np.empty((len(blocks), LAGS), np.float32)
    same = np.zeros(len(flat), bool)
    for lag in range(1, LAGS + 1):
        np.equal(narrow[lag:], narrow[:-lag], out=same[lag:])
        same[:lag] = False
        same[padding] = False
        # The first bytes of a text have nothing so far before them.
        at = (starts[:, None] + np.arange(lag)).ravel()
        same[at[at < len(same)]] = False
        out[:, lag - 1] = np.bitwise_count(same.view(np.uint64))
    out /= STEP
    return out


def fit(texts: list[bytes], labels: list[int], even: float, epochs: int = 12, least_steps: int = 400, batch: int = 32, rate: float = 0.01, seed: int = 11) -> Network:
    """Adam on the logistic loss, classes weighed alike; a document that is as likely of either gets the score ``even``.
    Small samples are passed over more often, until there are ``least_steps``."""
    epochs = max(epochs, math.ceil(least_steps * batch / len(texts)))
    rng = np.random.Generator(np.random.PCG64(seed))
    width = 2 * (STEP * DIMS + LAGS)
    embedded = 2 * STEP * DIMS
    columns = np.concatenate([np.arange(STEP * DIMS), STEP * DIMS + LAGS + np.arange(STEP * DIMS)])  # of embedded bytes
    p = {
        "embed": rng.normal(0, 0.5, (257, DIMS)), "filters": rng.normal(0, 1.5 / math.sqrt(width), (width, FILTERS)), "bias": np.zeros(FILTERS),
        "out": rng.normal(0, 0.3, FILTERS), "out_bias": np.zeros(1),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    y = np.array(labels, np.float32)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
    m1, m2, turn = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            data = np.frombuffer(b"".join(texts[i] for i in rows), np.uint8)
            bounds = np.concatenate([[0], np.cumsum([len(texts[i]) for i in rows])])
            blocks, first = layout(data, bounds)
            net = Network(p["embed"], p["filters"], p["bias"], p["out"], float(p["out_bias"][0]))
            repeats = lag_channels(blocks, first[:-1])
            r = net.responses(blocks, repeats)
            top = np.stack([first[i] + r[first[i] : first[i + 1] - 1].argmax(0) for i in range(len(rows))])
            pooled = r[top, np.arange(FILTERS)]
            act = np.maximum(pooled, 0)
            z = act @ p["out"] + p["out_bias"][0]
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows] / len(rows)
            back = (d[:, None] * p["out"]) * (pooled > 0)
            chunk = np.concatenate([blocks[top], blocks[top + 1]], 2)  # rows x FILTERS x 2 * STEP bytes
            x = np.empty((len(rows), FILTERS, width), np.float32)
            x[:, :, columns] = p["embed"][chunk].reshape(len(rows), FILTERS, embedded)
            x[:, :, STEP * DIMS : STEP * DIMS + LAGS], x[:, :, -LAGS:] = repeats[top], repeats[top + 1]
            slope = (back[:, :, None] * p["filters"][columns].T[None]).reshape(-1, DIMS)
            embed = np.zeros_like(p["embed"])
            np.add.at(embed, chunk.reshape(-1), slope)
            grad = {"out": act.T @ d + 1e-4 * p["out"], "out_bias": d.sum(keepdims=True), "bias": back.sum(0), "filters": np.einsum("bf,bfw->wf", back, x), "embed": embed}
            turn += 1
            step = rate * (1 - epoch / epochs * 0.8)
            for k, g in grad.items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                p[k] = (p[k] - step * (m1[k] / (1 - 0.9**turn)) / (np.sqrt(m2[k] / (1 - 0.999**turn)) + 1e-8)).astype(np.float32)
    return Network(p["embed"], p["filters"], p["bias"], p["out"], float(p["out_bias"][0]) + math.log(even / (1 - even)))


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, target: str, per_class: int, max_bytes: int) -> tuple[list[bytes], list[int], float]:
    """The training texts, their labels, and the share of label 1 among all rows to learn from."""
    known = labels.where(~F.coalesce(held_out(), F.lit(True)) & F.col(target).isNotNull()).groupBy("doc_id").agg(F.max(target).alias("y"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    order = [F.xxhash64("doc_id", F.lit(5)), F.col("doc_id")]
    chosen = known.where("y = 1").orderBy(*order).limit(per_class).unionByName(known.where("y = 0").orderBy(*order).limit(per_class))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes).join(F.broadcast(chosen), "doc_id")  # 2 * per_class rows at most
    rows = sorted(texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect(), key=lambda r: r.doc_id)
    return [r.text.encode() for r in rows], [int(r.y) for r in rows], counts.get(1, 0) / total if total else 0.5


def quality_scores(
    docs: DataFrame, labels: DataFrame, target: str = "quality", text: str = "text", key: str = "doc_id", per_class: int = 2500, max_bytes: int = 32_768, cutoff: float = 0.3
) -> DataFrame:
    """One row per row of ``docs``: ``key``, held_out, score (a probability of label 1; ``cutoff`` is that of a document
    that is as likely of label 0, both labels being weighed alike), predicted."""
    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    texts, marks, prior = sample(named, labels, target, per_class, max_bytes)
    net = fit(texts, marks, cutoff) if len(set(marks)) == 2 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, bounds in textops.utf8_batches(batch.column(1), BLOCK_BYTES):
                rows = len(bounds) - 1
                got = net.scores(data, bounds) if net else np.full(rows, prior)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), pa.array(got)], names=["doc_id", "score"])

    scored = named.mapInArrow(run, "doc_id long, score double")
    return scored.select(F.col("doc_id").alias(key), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))
