"""Cost-balanced packing of tokenized documents into sequences.

A sequence's cost is linear in its tokens plus quadratic in the tokens of each piece (attention does not
cross documents). Within a window of about `window` sequences, documents (in pieces of at most `length`)
go in descending order to the cheapest sequence with enough capacity left; one that fits nowhere is cut to
fill the cheapest one that has room. A window's capacity equals its tokens: sequences of `length`, and for
what is left sequences of powers of two, so that nothing is padded. Windows are runs of an input partition:
no shuffle, memory bounded by a window, and a lost task is repeated with the same result.

Tokens come from a public vocabulary file. The vocabulary's text splitter never joins text across white
space nor across the borders letter/digit/other in plain Latin text, so each distinct piece is encoded once
per task; words with other characters or an apostrophe are encoded whole.

Defined results. Null and empty texts are one end id. Repeated rows are packed one by one. No rows, no
pieces. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_SPACE, LOWER, Poly, pieces, relieved, small_batches, table, utf8

LENGTH, END_ID, WINDOW = 4096, 2, 256
LINEAR, QUADRATIC = 1.0, 1.0 / 4096


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Token ids of texts, each distinct piece encoded once (the store is emptied at `most` pieces)."""

    def __init__(self, path: str, most: int = 300_000) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.poly, self.most = Tokenizer.from_file(path), Poly(11), most
        self.kind = np.full(256, 3, np.uint8)  # 0 white, 1 letter, 2 digit, 3 other, 4 needs the whole word
        self.kind[IS_SPACE] = 0
        self.kind[[*range(65, 91), *range(97, 123)]] = 1
        self.kind[48:58] = 2
        self.kind[128:] = 4
        self.kind[[39, 60]] = 4  # contractions, and the marks of special tokens
        self.kind[[*range(1, 9), *range(14, 32), 127]] = 4
        words = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.at: dict[int, int] = {}
        self.ids, self.filled = np.zeros(1 << 20, np.uint32), 0
        self.begin, self.count = np.zeros(self.most + 1, np.int64), np.zeros(self.most + 1, np.int64)

    def _store(self, keys: list[int], ids: np.ndarray, count: np.ndarray) -> None:
        n, k = len(self.at), len(keys)
        while self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        if n + k > len(self.begin):
            self.begin, self.count = (np.concatenate([x, np.zeros(n + k, np.int64)]) for x in (self.begin, self.count))
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.count[n : n + k] = count
        self.begin[n : n + k] = self.filled + np.cumsum(count) - count
        self.filled += len(ids)
        self.at.update(zip(keys, range(n, n + k), strict=True))

    def _learn(self, keys: list[int], texts: list[str], simple: np.ndarray) -> None:
        """Simple pieces give one word each, whose last token bears the word's end: many are encoded as one text."""
        run = np.flatnonzero(simple).tolist()
        if run:
            lines = [" ".join([texts[i] for i in run[k : k + 256]]) for k in range(0, len(run), 256)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(run):
                self._store([keys[i] for i in run], ids, np.diff(ends, prepend=0))
            else:
                simple = np.zeros(len(keys), bool)
        own = np.flatnonzero(~simple).tolist()
        if own:
            got = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([texts[i] for i in own], add_special_tokens=False)]
            self._store([keys[i] for i in own], np.concatenate(got), np.array([len(x) for x in got]))

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with END_ID, and the n + 1 offsets."""
        n = len(offsets) - 1
        if not len(buf):
            return np.full(n, END_ID, np.uint32), np.arange(n + 1)
        kind = self.kind[buf]
        lead = np.flatnonzero(buf[:-1] == 0xC3)  # Latin-1 letters but for the two signs among them
        lead = lead[(buf[lead + 1] >= 0x80) & (buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = 1
        border = np.zeros(len(buf) + 1, bool)
        border[offsets[offsets < len(buf)]] = True
        white = kind == 0
        word = border[:-1].copy()
        word[1:] |= white[1:] != white[:-1]
        word[0] = True
        starts = np.flatnonzero(word)
        whole = np.bitwise_or.reduceat(kind == 4, starts)
        cut = word.copy()
        cut[1:] |= (kind[1:] != kind[:-1]) & ~np.repeat(whole, np.diff(np.append(starts, len(buf))))[1:]
        at = np.flatnonzero(cut)
        end = np.append(at[1:], len(buf))
        keep = ~white[at]
        at, end = at[keep], end[keep]
        doc = np.searchsorted(offsets, at, "right") - 1
        low = LOWER[buf]
        p = self.poly.prefix(low)
        # the length, so that pieces of different length never meet
        h = self.poly.hashes(p, at, end) + (end - at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        uniq, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.at) + len(uniq) > self.most:
            self.clear()
        keys = uniq.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.at]
        if new:
            raw = low.tobytes()
            f = first[new]
            simple = (kind[at[f]] == 1) | (kind[at[f]] == 3)
            simple &= ~whole[np.searchsorted(starts, at[f], "right") - 1]
            self._learn([keys[i] for i in new], [raw[a:b].decode() for a, b in zip(at[f].tolist(), end[f].tolist(), strict=True)], simple)
        entry = np.fromiter((self.at[k] for k in keys), np.int64, len(keys))[back]
        begin, count = self.begin[entry], self.count[entry]
        per = np.bincount(doc, count, n).astype(np.int64)
        off = np.concatenate([[0], np.cumsum(per + 1)])
        out = np.full(off[-1], END_ID, np.uint32)
        before = np.concatenate([[0], np.cumsum(count)])
        total = int(before[-1])
        where = np.arange(total)
        out[where + np.repeat(doc, count)] = self.ids[np.repeat(begin - before[:-1], count) + where]
        return out, off


@functools.lru_cache(1)
def encoder_for(path: str) -> PieceEncoder:
    """One for each Python worker, which keeps it from task to task; the store only saves time."""
    return PieceEncoder(path)


def assign(lengths: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(document, start, sequence, tokens) of every piece of a window, in the order of placing."""
    total = int(lengths.sum())
    rest = total % length
    sizes = [length] * (total // length) + [1 << b for b in range(length.bit_length() - 1, -1, -1) if rest >> b & 1]
    free, cost = np.array(sizes, np.int64), np.zeros(len(sizes))
    out, todo, used = [], [], 0
    for d, n in enumerate(lengths.tolist()):
        for s in range(0, n - n % length, length):
            out.append((d, s, used, length))
            free[used] = 0
            used += 1
        if n % length:
            todo.append((n % length, d, n - n % length))
    todo.sort(key=lambda x: (-x[0], x[1]))
    for n, d, s in todo:
        while n:
            k = int(np.argmin(np.where(free >= n, cost, np.inf)))
            take = n
            if free[k] < n:
                k = int(np.argmin(np.where(free > 0, cost, np.inf)))
                take = int(free[k])
            out.append((d, s, k, take))
            free[k] -= take
            cost[k] += LINEAR * take + QUADRATIC * take * take
            n, s = n - take, s + take
    return out


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, window: int = WINDOW, with_ids: bool = False, reuse: bool = True) -> DataFrame:
    """doc_id, text -> one row per piece; with_ids adds the ids themselves. reuse=False: workers hold no vocabulary after a task, for half as much time again."""
    spark = docs.sparkSession
    small_batches(spark)
    path = path or vocabulary()
    source = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = (encoder_for if reuse else PieceEncoder)(path), TaskContext.get().partitionId()
        held: list[tuple] = []
        tokens = sequence = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, tokens, sequence
            n = np.array([len(x) for _, x in held])
            filled: dict[int, int] = {}
            rows = []
            for d, s, k, take in assign(n, length):
                ids = held[d][1][s : s + take]
                rows.append((held[d][0], s, take, zlib.crc32(ids.astype("<u4").tobytes()), len(held[d][1]), (part << 32) + sequence + k, filled.get(k, 0), *([ids] if with_ids else [])))
                filled[k] = filled.get(k, 0) + take
            sequence += len(filled)
            held, tokens = [], 0
            cols = list(zip(*rows, strict=True))
            out = [pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(c, pa.list_(pa.int32())) for c in cols[7:]]
            return pa.RecordBatch.from_arrays(out, COLUMNS + ["ids"] * with_ids)

        for batch in batches:
            names, (buf, offs) = batch.column("doc_id").to_pylist(), utf8(batch.column("text"))
            for a, b in pieces(offs, 1 << 19):
                ids, at = encoder.encode(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                for i in range(b - a):
                    held.append((names[a + i], ids[at[i] : at[i + 1]]))
                    tokens += int(at[i + 1] - at[i])
                    if tokens >= window * length:
                        yield flush()
        if held:
            yield flush()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return source.mapInArrow(relieved(run), schema)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
