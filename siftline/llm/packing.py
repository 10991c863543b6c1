"""Packing: vector bin packing by the dot-product heuristic.

Every document's token ids (with an end id) are cut into pieces that fit the limits alone, and a rest. Pieces are
placed under three limits at once: tokens, number of segments, and loss-bearing tokens (those with a predecessor in
their piece: a piece's first token is never predicted). A sequence is filled with the piece whose demand has the
largest dot product with what the sequence has left, each resource weighed by its total demand, until none fits.
Buckets of pieces are packed side by side. All three limits bind: many short pieces run into the segments, few long
ones into the loss-bearing tokens, and what lies between into the tokens.

Defined results: a null or empty text has the end id only; repeated rows are packed each on its own; an empty table
gives an empty result; documents of any length are cut, none is dropped; ties go by id, start and checksum, so the
same rows give the same sequences however they are dealt to tasks. Other columns of the input are ignored.
The tokenizer drops white space and never joins across it or its runs of letters; each distinct run is tokenized once,
and a bounded memory keeps what it gave.
"""

from __future__ import annotations

import itertools
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops, workspace

END_ID = 1
CAPACITY = 2048
#: Documents that one sequence may mix.
MAX_SEGMENTS = 32
#: Loss-bearing tokens that a sequence may hold, as a share of its capacity: 2040 of 2048.
LOSS_SHARE = 255 / 256
CACHE_RUNS = 1_500_000
BATCH_BYTES = 6_000_000

#: What a byte is to the tokenizer: 0 white space, 1 a letter of the Latin alphabet (also either byte of one with
#: an accent), 2 punctuation, 3 a digit (each is tokenized alone), 4 anything else.
_KIND = np.full(256, 4, np.uint8)
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = 1
_KIND[[b for b in range(33, 127) if chr(b) not in "'" and not chr(b).isalnum()]] = 2
_KIND[range(48, 58)] = 3
_KINDS = _KIND.tobytes()
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def byte_alphabet() -> list[str]:
    """The letters that stand for the 256 bytes in byte-level vocabularies: printable ones for themselves, the others
    by the code points from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class RunTokenizer:
    """Token ids of many texts at once; every distinct run is tokenized once, as long as it is remembered.

    The vocabulary's rule parts a text into runs of letters, of punctuation, and single digits before any merge. In
    words of Latin letters, digits and punctuation these runs are found here, and go to the bare merges. All other
    words (with an apostrophe, of other alphabets, with combining marks, or with a special token) go whole through
    the whole tokenizer.
    """

    def __init__(self, path: str, cache_runs: int = CACHE_RUNS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        letters = byte_alphabet()
        self.spelled = {b: letters[b] for b in range(256) if letters[b] != chr(b) and b != 10}
        self.cache_runs = cache_runs
        self._forget()

    def _forget(self) -> None:
        #: The runs that are known, and of each where its ids begin in ``flat`` and how many it has.
        self.known = pa.array([], pa.binary())
        self.flat, self.begin, self.count = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    def _bare_ids(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of simple runs end to end, and how many each has. Many go in one call, parted by line breaks."""
        ids, counts = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for part in itertools.batched(runs, 20_000):
            text = b"\n".join(part).decode("latin-1")
            got = self.bare.encode(text if text.isascii() else text.translate(self.spelled), add_special_tokens=False)
            ids.append(np.array(got.ids, "<u4"))
            counts.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(part)))
        return np.concatenate(ids), np.concatenate(counts)

    def _whole_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [np.empty(0, "<u4")], []
        for part in itertools.batched(words, 20_000):
            for got in self.whole.encode_batch_fast([w.decode() for w in part], add_special_tokens=False):
                ids.append(np.array(got.ids, "<u4"))
                counts.append(len(ids[-1]))
        return np.concatenate(ids), np.array(counts, np.int64)

    def _learn(self, runs: pa.Array, simple: np.ndarray) -> None:
        for some, encode in ((simple, self._bare_ids), (~simple, self._whole_ids)):
            if some.any():
                new = runs.filter(pa.array(some))
                ids, count = encode(new.to_pylist())
                self.known = pa.concat_arrays([self.known, new])
                self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(count) - count])
                self.count = np.concatenate([self.count, count])
                self.flat = np.concatenate([self.flat, ids])

    def _entries(self, runs: pa.Array, simple: np.ndarray) -> np.ndarray:
        """Where each of these distinct runs stands among the known ones."""
        at = pc.index_in(runs, value_set=self.known)
        if at.null_count:
            if len(self.known) + at.null_count > self.cache_runs:
                self._forget()
                at = pa.nulls(len(runs), pa.int32())
            new = pc.is_null(at)
            self._learn(runs.filter(new), simple[new.to_numpy(zero_copy_only=False)])
            at = pc.index_in(runs, value_set=self.known)
        return at.to_numpy(zero_copy_only=False)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and each text's first (one more than there are texts)."""
        if len(data) == 0:
            return np.empty(0, "<u4"), np.zeros(len(bounds), np.int64)
        text = data.tobytes()
        kind = np.frombuffer(text.translate(_KINDS), np.uint8)
        low = np.frombuffer(bytearray(text.translate(_LOWER)), np.uint8)
        # A byte of another kind, an accent's second byte out of place, or the start of a special token: not simple.
        odd = kind == 4
        if not text.isascii():
            accents = np.flatnonzero(data[:-1] == 0xC3) + 1
            seconds = (data >= 0x80) & (data < 0xC0)
            seconds[accents] = False
            odd |= seconds
            odd[accents[(data[accents] == 0x97) | (data[accents] == 0xB7) | (data[accents] < 0x80)]] = True
            low[accents[(data[accents] >= 0x80) & (data[accents] < 0x9F)]] += 32
        for m in re.finditer(rb"<\|", text):
            odd[m.start()] = True
        # Runs, white space among them: a change of kind, each digit, each text.
        begins = np.empty(len(data), bool)
        begins[0] = True
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
        begins |= kind == 3
        begins[bounds[:-1][bounds[:-1] < len(data)]] = True
        at = np.flatnonzero(begins)
        space = kind[at] == 0
        if odd.any():
            # Words with something odd are one run each, and stay as they are spelled.
            word_begins = ~space
            word_begins[1:] &= space[:-1] | np.isin(at[1:], bounds, assume_unique=False)
            word = np.cumsum(word_begins)
            is_odd = np.zeros(word[-1] + 1, bool)
            owners = np.searchsorted(at, np.flatnonzero(odd), "right") - 1
            is_odd[word[owners]] = True
            whole = is_odd[word] & ~space
            ends = np.append(at[1:], len(data))
            spans, sizes = at[whole], (ends - at)[whole]
            spelled = np.repeat(spans - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            low[spelled] = data[spelled]
            keep = ~whole | word_begins
            at, space, whole = at[keep], space[keep], whole[keep]
        else:
            whole = np.zeros(len(at), bool)
        offsets = pa.py_buffer(np.append(at, len(data)).astype(np.int32))
        runs = pa.Array.from_buffers(pa.binary(), len(at), [None, offsets, pa.py_buffer(low)]).dictionary_encode()
        which, distinct = runs.indices.to_numpy(zero_copy_only=False), runs.dictionary
        kinds = np.zeros(len(distinct), np.uint8)  # 0 white space, 1 simple, 2 whole
        kinds[which] = np.where(space, 0, np.where(whole, 2, 1))
        some = kinds > 0
        begin, count = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        entry = self._entries(distinct.filter(pa.array(some)), kinds[some] == 1)
        begin[some], count[some] = self.begin[entry], self.count[entry]
        n = count[which]
        total = np.concatenate([[0], np.cumsum(n)])
        out = self.flat[np.repeat(begin[which] - total[:-1], n) + np.arange(total[-1])]
        return out, total[np.searchsorted(at, bounds)]


_TOKENIZERS: dict[str, RunTokenizer] = {}


def tokenizer_of(path: str) -> RunTokenizer:
    """The worker's tokenizer for this file: tasks that run in one worker share what it has learnt."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = RunTokenizer(path)
    return _TOKENIZERS[path]


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("loss", pa.int64())])


def cut_documents(docs: DataFrame, tokenizer: str, piece_tokens: int, end_id: int = END_ID, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, loss (its tokens but the first)."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokenizer_of(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at, data, bounds in textops.utf8_batches(batch.column(1), BATCH_BYTES):
                flat, first = encoder.encode(data, bounds)
                out = []
                for i, doc in enumerate(keys[at : at + len(first) - 1]):
                    ids = flat[first[i] : first[i + 1]].tobytes() + end
                    n = len(ids) // 4
                    for start in range(0, n, piece_tokens):
                        part = ids[4 * start : 4 * (start + piece_tokens)]
                        out.append((doc, start, len(part) // 4, zlib.crc32(part), n, len(part) // 4 - 1))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), PIECES.types)], schema=PIECES)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss long")


def place(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, offset in it, and order, of each item, under ``limits`` on tokens, segments and loss-bearing tokens.

    An item larger than a limit gets a sequence of its own.
    """
    n = len(tokens)
    kinds, kind_of, count = np.unique(np.stack([tokens, loss], 1), axis=0, return_inverse=True, return_counts=True)
    members = np.argsort(kind_of.ravel(), kind="stable")
    nxt = np.cumsum(count) - count
    cap_t, cap_s, cap_l = limits
    t, lo = kinds[:, 0], kinds[:, 1]
    share = np.array([tokens.sum() / cap_t, n / cap_s, loss.sum() / max(cap_l, 1)])
    share = share / max(share.sum(), 1e-12)
    by_t, by_l = share[0] * t / cap_t**2, share[2] * lo / max(cap_l, 1) ** 2
    by_s = share[1] / cap_s**2
    sequence, offset, order = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    number, left = 0, n
    while left:
        rt, rs, rl, used, seg = cap_t, cap_s, cap_l, 0, 0
        while left and rs > 0:
            fits = (count > 0) & (t <= rt) & (lo <= rl)
            if not fits.any():
                if seg:
                    break
                fits = count > 0
            k = int(np.argmax(np.where(fits, by_t * rt + by_s * rs + by_l * rl, -1.0)))
            item = members[nxt[k]]
            sequence[item], offset[item], order[item] = number, used, seg
            nxt[k] += 1
            count[k] -= 1
            used, seg, left = used + int(t[k]), seg + 1, left - 1
            rt, rs, rl = rt - int(t[k]), rs - 1, rl - int(lo[k])
        number += 1
    return sequence, offset, order


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int | None = None,
    end_id: int = END_ID,
    text: str = "text",
    key: str = "doc_id",
    bucket_pieces: int = 8192,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, loss, sequence_id, offset, segment.

    ``max_loss`` is ``LOSS_SHARE`` of the capacity unless given. Pieces are cut so that each fits all limits alone.
    """
    limits = (capacity, max_segments, max(0, math.floor(capacity * LOSS_SHARE)) if max_loss is None else max_loss)
    cut = cut_documents(docs, tokenizer, max(1, min(capacity, limits[2] + 1)), end_id, text, key)
    # Equal pieces of rows with one id are counted, then numbered: so their buckets depend on the rows alone, not on
    # how the input is dealt, and many copies of one row come into many buckets.
    counted = workspace.stage(cut.groupBy(*PIECES.names).agg(F.count("*").alias("copies")), "pack-pieces")
    total = counted.agg(F.sum("copies")).first()[0] or 0
    buckets = max(1, -(-total // bucket_pieces))
    pieces = workspace.numbered(counted, "copies", "nr")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32", "nr"], kind="stable")
        sequence, offset, order = place(pdf["length"].to_numpy(), pdf["loss"].to_numpy(), limits)
        return pdf.assign(sequence_id=(pdf["bucket"].to_numpy() << 32) + sequence, offset=offset, segment=order).drop(columns=["nr", "bucket"])

    bucket = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens", "nr"), F.lit(buckets)).cast("long")
    return pieces.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(
        fill, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss long, sequence_id long, offset long, segment long"
    )
