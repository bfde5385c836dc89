"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer numpy network.

Two token streams describe a text: its words (lower-cased in ASCII, hashed) and their shapes (runs of
character kinds: lower, upper, digit, high byte, each sign). A random index vector belongs to each hashed
token; a token's vector sums the index vectors of its neighbours, and of the other stream's token at its
place, over all documents (random indexing), and an unseen token has its own index vector. Means over
each stream, with the share of repeated words and the log length, feed the network (tanh, then logistic);
a temperature fitted on a part of the training rows calibrates the probabilities.

The context sums have a fixed size whatever the corpus: tasks add them up block by block, in two salted rounds.
The network is fitted on at most `most` labelled rows (chosen by hash of the id, one text an id); of those only
the features come to the driver, never a text. Scoring is one pass of the whole table without a shuffle.
Training labels come only from rows whose crc32(doc_id as text) mod 5 is not 0; labels, lang, source and ids are
never inputs.

Defined results. Null and empty texts have a score (of the zero vector). A null doc_id counts as not held
out. A doc_id labelled twice takes its highest label, and of several texts the one with the least hash; null
labels are skipped. Without both labels in the sample the score is the share of label 1 (0.5 without any
label). Repeated rows score alike. Columns of any name pass through untouched, but for held_out, score and
predicted, which give way to the operator's own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Poly, mixed, pieces, relieve, relieved, small_batches, table, unwrapped, utf8, word_spans, wrapped, written

BUCKETS, DIM, HIDDEN, MOST, THRESHOLD = 1 << 14, 24, 24, 3000, 0.3
_CHUNK, _BLOCKS, _SALTS = 1 << 20, 64, 16  # bytes at a time; parts of the context sums; tasks that add up one of them first

_KIND = np.zeros(256, np.uint8)
_KIND[:] = np.arange(256)  # a sign is its own kind
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 1, 2, 3, 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def tokens(poly: Poly, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, word hash and shape hash of each word."""
    at, end, doc = word_spans(buf, offsets)
    if not len(at):
        return doc, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    words = mixed(poly.hashes(poly.prefix(LOWER[buf]), at, end))
    kind = _KIND[buf]
    first = np.ones(len(buf), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[at] = True
    run = np.flatnonzero(first)  # the text without repeats of a kind
    shapes = poly.prefix(kind[run])
    a, b = np.searchsorted(run, at), np.searchsorted(run, end)
    return doc, words, mixed(poly.hashes(shapes, a, b) + np.uint64(1))


@dataclass
class Model:
    vectors: np.ndarray  # 2, BUCKETS, DIM
    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    constant: float | None = None


def index_places(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Of each stream's tokens: the four non-zero places of the index vector, and their signs."""
    rng = np.random.default_rng(seed)
    places = rng.integers(0, DIM, (2, 4, BUCKETS))
    return places, np.array([1, -1, 1, -1])


def index_vectors() -> np.ndarray:
    places, signs = index_places()
    out = np.zeros((2, BUCKETS, DIM), np.float32)
    for s in range(2):
        for place, sign in zip(places[s], signs, strict=True):
            out[s, np.arange(BUCKETS), place] += sign
    return out


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(50)).astype(np.int64)


def pooled(vectors: np.ndarray, poly: Poly, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features a document."""
    n = len(offsets) - 1
    out = np.zeros((n, 2 * DIM + 2), np.float64)
    for a, b in pieces(offsets, _CHUNK // 4):
        lo = offsets[a]
        doc, words, shapes = tokens(poly, buf[lo : offsets[b]], offsets[a : b + 1] - lo)
        if not len(doc):
            continue
        count = np.bincount(doc, minlength=b - a)
        some = np.flatnonzero(count)
        first = np.searchsorted(doc, some)
        for s, h in enumerate((words, shapes)):
            out[a + some, s * DIM : (s + 1) * DIM] = np.add.reduceat(vectors[s][buckets(h)], first, axis=0, dtype=np.float64) / count[some, None]
        own = mixed(words ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        _, where = np.unique(own, return_index=True)
        distinct = np.bincount(doc[where], minlength=b - a)
        out[a + some, 2 * DIM] = distinct[some] / count[some]
        out[a + some, 2 * DIM + 1] = np.log1p(count[some])
    return out


def context_sums(out: np.ndarray, poly: Poly, places: np.ndarray, signs: np.ndarray, buf: np.ndarray, offsets: np.ndarray, reach: int = 2) -> None:
    """Add to out (2, BUCKETS * DIM): for each token the index vectors of its neighbours in the document, and of the other stream's token at its place."""
    for a, b in pieces(offsets, _CHUNK):
        lo = offsets[a]
        doc, words, shapes = tokens(poly, buf[lo : offsets[b]], offsets[a : b + 1] - lo)
        if not len(doc):
            continue
        streams = [buckets(words), buckets(shapes)]
        for s, own in enumerate(streams):
            pairs = [(1 - s, own, streams[1 - s])]
            for step in range(1, min(reach, len(own) - 1) + 1):
                same = doc[step:] == doc[:-step]
                x, y = own[:-step][same], own[step:][same]
                pairs += [(s, y, x), (s, x, y)]
            for of, at, other in pairs:
                for place, sign in zip(places[of], signs, strict=True):
                    out[s] += sign * np.bincount(at * DIM + place[other], minlength=BUCKETS * DIM)


def random_indexing(docs: DataFrame) -> np.ndarray:
    """The token vectors over all texts. A task's sums have a fixed size; they meet block by block, first in `_SALTS` shares."""
    spark = docs.sparkSession
    small_batches(spark)
    width = 2 * BUCKETS * DIM // _BLOCKS

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        poly, (places, signs), out = Poly(21), index_places(), np.zeros((2, BUCKETS * DIM), np.int64)
        for batch in batches:
            buf, offsets = utf8(batch.column("text"))
            context_sums(out, poly, places, signs, buf, offsets)
        if out.any():
            parts = [zlib.compress(x.tobytes(), 1) for x in out.reshape(_BLOCKS, width)]  # mostly zeros in a short task
            salt = TaskContext.get().partitionId() % _SALTS
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(_BLOCKS, dtype=np.int32)), pa.array(np.full(_BLOCKS, salt, np.int32)), pa.array(parts, pa.binary())], ["block", "salt", "sums"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column("block").to_pylist(), batch.column("sums"), strict=True):
                x = np.frombuffer(zlib.decompress(x.as_buffer()), np.int64)
                sums[k] = sums[k] + x if k in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], ["block", "sums"])

    kind = "block int, sums binary"
    found = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(relieved(scan), "block int, salt int, sums binary")
    some = found.repartition("block", "salt").select("block", "sums").mapInArrow(add, kind)
    rows = some.repartition(8, "block").mapInArrow(add, kind).collect()  # _BLOCKS rows in all
    out = np.zeros((_BLOCKS, width), np.float64)
    for r in rows:
        out[r.block] += np.frombuffer(zlib.decompress(r.sums), np.int64)
    out = out.reshape(2, BUCKETS, DIM)
    index = index_vectors()
    norm = np.linalg.norm(out, axis=2, keepdims=True)
    own = index / np.maximum(np.linalg.norm(index, axis=2, keepdims=True), 1)
    return np.where(norm > 0, out / np.maximum(norm, 1e-9) + own, own).astype(np.float32)


def _logits(m: Model, x: np.ndarray) -> np.ndarray:
    return np.tanh(((x - m.shift) / m.scale) @ m.w1 + m.b1) @ m.w2 + m.b2


def score(m: Model, x: np.ndarray) -> np.ndarray:
    if m.constant is not None:
        return np.full(len(x), m.constant)
    return 1 / (1 + np.exp(-np.clip(_logits(m, x) / m.temperature, -40, 40)))


def fit(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 3) -> Model:
    rng = np.random.default_rng(seed)
    if not len(y) or y.min() == y.max():
        z = np.zeros(0)
        return Model(vectors, z, z, z, z, z, 0.0, 1.0, float(y.mean()) if len(y) else 0.5)
    m = Model(vectors, x.mean(0), x.std(0) + 1e-3, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0, 1.0)
    aside = rng.random(len(y)) < 0.15
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        aside[:] = False
    z, t = (x[~aside] - m.shift) / m.scale, y[~aside]
    state = [np.zeros_like(p, float) for p in (m.w1, m.b1, m.w2, np.zeros(1)) for _ in range(2)]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(t))
        for k in range(0, len(t), 64):
            i = order[k : k + 64]
            hidden = np.tanh(z[i] @ m.w1 + m.b1)
            error = (1 / (1 + np.exp(-np.clip(hidden @ m.w2 + m.b2, -40, 40))) - t[i]) / len(i)
            back = error[:, None] * m.w2 * (1 - hidden**2)
            grads = (z[i].T @ back + 1e-4 * m.w1, back.sum(0), hidden.T @ error + 1e-4 * m.w2, np.array([error.sum()]))
            step += 1
            moves = []
            for j, g in enumerate(grads):  # Adam
                state[2 * j] += 0.1 * (g - state[2 * j])
                state[2 * j + 1] += 0.001 * (g * g - state[2 * j + 1])
                moves.append(0.003 * (state[2 * j] / (1 - 0.9**step)) / (np.sqrt(state[2 * j + 1] / (1 - 0.999**step)) + 1e-8))
            m.w1, m.b1, m.w2, m.b2 = m.w1 - moves[0], m.b1 - moves[1], m.w2 - moves[2], m.b2 - float(moves[3][0])
    if aside.any():
        logits, t = _logits(m, x[aside]), y[aside]
        loss = lambda c: np.mean(np.logaddexp(0, logits / c) - t * logits / c)
        m.temperature = float(min(np.geomspace(0.5, 8, 60), key=loss))
    return m


def train(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Model:
    """Word vectors over all documents; the network on at most `most` labelled rows, whose features come to the driver."""
    small_batches(docs.sparkSession)
    known = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    sample = known.groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    texts = written(texts.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")))
    vectors = random_indexing(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly = Poly(21)
        for batch in batches:
            buf, offsets = utf8(batch.column("text"))
            x = pooled(shared.value, poly, buf, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["quality", "x"])

    rows = texts.mapInArrow(relieved(run), "quality double, x array<double>").collect()
    shared.destroy()
    rows.sort(key=lambda r: (r.x, r.quality))  # the order of arrival says nothing
    return fit(vectors, np.array([r.x for r in rows]), np.array([r.quality for r in rows], float))


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD, own: bool = True) -> DataFrame:
    """docs with held_out, score and predicted; own=False keeps the rows wrapped (row_), for callers that need the input's columns as they are."""
    small_batches(docs.sparkSession)
    source = wrapped(docs, held_out=held_out(docs["doc_id"]), text_=F.coalesce(docs["text"], F.lit("")))

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        poly = Poly(21)
        for batch in texts:
            buf, offsets = utf8(batch)
            yield pa.array(score(model, pooled(model.vectors, poly, buf, offsets)), pa.float64())
        relieve()

    # only the texts go to Python; said to be nondeterministic, so that a filter on the score is no second run
    scored = F.arrow_udf(run, "double").asNondeterministic()
    out = source.select("row_", "held_out", scored("text_").alias("score"))
    out = out.select("row_", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
    return unwrapped(out, "held_out", "score", "predicted") if own else out


def op8_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return classify(docs, model).select("doc_id", "held_out", "score", "predicted")
