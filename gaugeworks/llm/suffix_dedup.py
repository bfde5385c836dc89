"""Suffix-array removal of every byte covered by a long string that also starts elsewhere.

The suffix array is sparse and distributed by content. Every window of `length` bytes has an anchor, its
leftmost least 32-byte gram by hash, so equal windows have the same anchor at the same place; windows in a
row with one anchor form a span. Suffixes that can be equal therefore share an anchor, and:

1. Spans are counted by anchor (partial aggregation; no text moves). Spans of an anchor that occurs once
   hold no repeat; spans that are equal repeat in all their windows. Equal means equal 128-bit BLAKE2 digests of
   their bytes: no collision of these is known or to be expected, so this verifies whole spans without moving them.
2. Where spans of an anchor differ (at the edges of repeats), each distinct span that occurs once brings
   its text. In a bucket, the suffixes at all window starts are mergesorted. Two suffixes are compared by
   polynomial prefix hashes and binary search for their common extension, so a comparison costs
   log(length) probes. Every neighbour is verified: a full common extension byte by byte, the others' order by
   the bytes where they part and a second hash of what they share. A bucket where any of this fails (a
   collision) is done again by its bytes alone.
3. Buckets above `hot` spans (a passage in countless contexts) would make one task's work, so their windows are
   dealt out by their own 128-bit BLAKE2 digests instead, and counted with partial aggregation. This changes
   only where the work is done.

Nothing is capped: a hot passage, or copies that make up a third of all rows, only raise counts, and the rows of
a hot anchor or span meet broadcast counts instead of one task. Texts are scanned in segments, so that their
length has no bound.

Defined results. Null text is empty text: no bytes, no spans, the digest of the empty string. Texts shorter
than `length` are kept whole. Repeated rows repeat each other and so lose what they share, each in its own
row. An empty table gives no rows. Matches never cross rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Poly, broadcast_if_small, dropped, hot_limit, join_hot, mixed, pieces, relieved, small_batches, table, utf8, written

LENGTH, GRAM, HOT, BATCH = 200, 32, 4096, 4000
_BYTES, _SEGMENT, _PLACE = 1 << 20, 1 << 26, np.uint64(28)  # a segment's places fit in _PLACE bits


def segments(offsets: np.ndarray, length: int, most: int = _SEGMENT) -> list[tuple[int, int, np.ndarray]]:
    """First text, its start, and the offsets of what is scanned at once: a few texts, or a part of a long one. The parts share length - 1 bytes, so that each window is in one."""
    out = []
    for a, b in pieces(offsets, _BYTES):
        n = int(offsets[b] - offsets[a])
        if b - a > 1 or n <= most:
            out.append((a, 0, offsets[a : b + 1]))
        else:
            out += [(a, k, offsets[a] + np.array([k, min(k + most, n)])) for k in range(0, max(1, n - length + 1), most - length + 1)]
    return out


def digests(buf: np.ndarray, at: np.ndarray, end: np.ndarray, also: np.ndarray | None = None) -> np.ndarray:
    """128-bit BLAKE2 digests, as rows of two longs, of the bytes of each range (and a number)."""
    raw, blake = buf.tobytes(), functools.partial(hashlib.blake2b, digest_size=16)
    tail = (x.to_bytes(8, "little") for x in also.tolist()) if also is not None else itertools.repeat(b"")
    return np.frombuffer(b"".join([blake(raw[a:b] + t).digest() for a, b, t in zip(at.tolist(), end.tolist(), tail, strict=False)]), np.int64).reshape(-1, 2)


def sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours, from running minima of blocks of w."""
    n = len(v) - w + 1
    full = -(-len(v) // w) * w
    x = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    x[: len(v)] = v
    x = x.reshape(-1, w)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    behind = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(poly: Poly, buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Spans of the texts: document, start in it, windows, anchor hash, the span's digest (with the anchor's place in it)."""
    gram = min(GRAM, length)
    none = *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
    if len(buf) < length:
        return none
    prefix = poly.prefix(buf)
    g = mixed(poly.windows(prefix, gram))
    ranked = (g >> _PLACE << _PLACE) | np.arange(len(g), dtype=np.uint64)
    at = (sliding_least(ranked, length - gram + 1) & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64)
    start = np.arange(len(at))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    inside = start + length <= offsets[doc + 1]
    start, at, doc = start[inside], at[inside], doc[inside]
    if not len(start):
        return none
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    a, p, d = start[first], at[first], doc[first]
    return d, a - offsets[d], count, g[p], digests(buf, a, a + count + length - 1, p - a)


def sort_suffixes(poly: Poly, buf: np.ndarray, at: np.ndarray, bucket: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at `at` by bucket and first `length` bytes, and each one's common extension
    with the next (0 across buckets). A pass on the first bytes makes the initial runs; mergesort does the rest."""
    lead = min(8, length)
    prefix = poly.prefix(buf)
    key = np.zeros(len(at), np.uint64)
    for i in range(lead):
        key = (key << np.uint64(8)) | buf[at + i]
    order = np.lexsort((key, bucket))
    k, b = key[order], bucket[order]
    new = np.ones(len(at), bool)
    new[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    seg = np.repeat(first, np.diff(np.append(first, len(at))))  # where each one's run of equal leads begins
    size = np.repeat(np.diff(np.append(first, len(at))), np.diff(np.append(first, len(at))))

    def extension(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        lo, hi = np.full(len(x), lead), np.full(len(x), length)
        while (go := lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = poly.hashes(prefix, x, x + mid) == poly.hashes(prefix, y, y + mid)
            lo, hi = np.where(go & same, mid, lo), np.where(go & ~same, mid - 1, hi)
        return lo

    def less(x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = extension(x, y)
        whole = n == length
        m = np.where(whole, 0, n)
        return np.where(whole, or_equal, buf[x + m] < buf[y + m])

    width = 1
    while (live := np.flatnonzero(size > width)).size:
        r = live - seg[live]
        run = r // width
        other = run ^ 1
        lo = seg[live] + np.minimum(other * width, size[live])
        end = seg[live] + np.minimum((other + 1) * width, size[live])
        hi, base = end.copy(), lo.copy()
        left = (run & 1) == 1  # the other run stands before: its equals come first
        mine = at[order[live]]
        while (go := lo < hi).any():
            g = np.flatnonzero(go)
            mid = (lo[g] + hi[g]) // 2
            below = less(at[order[mid]], mine[g], left[g])
            lo[g], hi[g] = np.where(below, mid + 1, lo[g]), np.where(below, hi[g], mid)
        place = seg[live] + (run & ~1) * width + (r - run * width) + (lo - base)
        order[place] = order[live].copy()
        width *= 2
    common = np.zeros(len(at), np.int64)
    inner = np.flatnonzero(~new) - 1
    if len(inner):
        common[inner] = extension(at[order[inner]], at[order[inner + 1]])
    return order, common


def _misled(buf: np.ndarray, at: np.ndarray, bucket: np.ndarray, order: np.ndarray, common: np.ndarray, length: int) -> bool:
    """Whether the order or an extension of the sorted suffixes is not what their bytes say."""
    x, y, c = at[order[:-1]], at[order[1:]], common[:-1]
    same = bucket[order[:-1]] == bucket[order[1:]]
    x, y, c = x[same], y[same], c[same]
    part = c < length
    # those with less in common than what the first pass sorted by have 0 here: their leads differ, and were compared as bytes
    x0, y0, c0 = x[part & (c > 0)], y[part & (c > 0)], c[part & (c > 0)]
    if (buf[x0 + c0] >= buf[y0 + c0]).any():
        return True
    other = Poly(53)
    prefix = other.prefix(buf)
    if (other.hashes(prefix, x0, x0 + c0) != other.hashes(prefix, y0, y0 + c0)).any():
        return True
    x, y, reach = x[~part], y[~part], np.arange(length)
    return any((buf[x[k : k + 20_000, None] + reach] != buf[y[k : k + 20_000, None] + reach]).any() for k in range(0, len(x), 20_000))


def repeated(poly: Poly, buf: np.ndarray, at: np.ndarray, bucket: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which suffixes share their first `length` bytes with another one of their bucket."""
    order, common = sort_suffixes(poly, buf, at, bucket, length)
    out = np.zeros(len(at), bool)
    if _misled(buf, at, bucket, order, common, length):  # a hash collision: by the bytes alone
        seen: dict[tuple, list[int]] = {}
        for i, (s, b) in enumerate(zip(at.tolist(), bucket.tolist(), strict=True)):
            seen.setdefault((b, buf[s : s + length].tobytes()), []).append(i)
        for same in seen.values():
            out[same] = len(same) > 1
        return out
    pair = np.flatnonzero(common >= length)
    out[order[pair]] = out[order[pair + 1]] = True
    return out


def _spans(n: np.ndarray) -> np.ndarray:
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


_RID = ["rid", "rid2"]  # two hashes of a row: 128 bits


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """rid, rid2 (of docs: rid, rid2, text) and the byte ranges to remove: spans array<struct<s, e>>, which may overlap."""
    spark = docs.sparkSession
    small_batches(spark)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly = Poly(41)
        for batch in batches:
            rid, rid2 = (batch.column(c).to_numpy() for c in _RID)
            buf, offsets = utf8(batch.column("text"))
            for a, start, offs in segments(offsets, length):
                d, s, n, mh, sh = anchors(poly, buf[offs[0] : offs[-1]], offs - offs[0], length)
                if len(d):
                    cols = [mh.view(np.int64), sh[:, 0], sh[:, 1], rid[a + d], rid2[a + d], (s + start).astype(np.int32), n.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["mh", "sh", "sh2", *_RID, "s", "n"])

    found = written(docs.where(F.octet_length("text") >= length).mapInArrow(relieved(scan), "mh long, sh long, sh2 long, rid long, rid2 long, s int, n int"))
    span = F.struct("sh", "sh2")
    several = found.groupBy("mh").agg(F.count("*").alias("c"), F.min(span).alias("lo"), F.max(span).alias("hi")).where("c > 1")
    several = written(several.select("mh", "c", (F.col("lo") == F.col("hi")).alias("pure")))
    limit = hot_limit(found)
    rows = written(join_hot(found, several.select("mh", "pure"), "mh", hot=several.where(F.col("c") > limit)))
    dropped(found)
    ends = (F.col("s") + F.col("n") + (length - 1)).alias("e")
    plain = rows.where("pure").select(*_RID, "s", ends)
    unlike = rows.where("not pure").drop("pure")
    same = ["mh", "sh", "sh2"]
    distinct = written(unlike.groupBy(*same).agg(F.count("*").alias("c"), F.min(F.struct(*_RID, "s", "n")).alias("rep")))
    again = join_hot(unlike, distinct.where("c > 1").select(*same), same, hot=distinct.where(F.col("c") > limit)).select(*_RID, "s", ends)
    buckets = distinct.groupBy("mh").agg(F.count("*").alias("members"), F.min("c").alias("least")).where("least = 1").select("mh", "members")
    reps = written(join_hot(distinct, buckets, "mh", hot=buckets.where(F.col("members") > hot_limit(distinct))).select("mh", "members", (F.col("c") == 1).alias("once"), "rep.*"))
    needed = broadcast_if_small(reps.select(*_RID).distinct())
    texts = docs.join(needed, _RID, "left_semi")
    part = F.substring(F.col("text").cast("binary"), F.col("s") + 1, F.col("n") + (length - 1))
    with_text = written(texts.join(reps, _RID).select("mh", "members", "once", *_RID, "s", "n", part.alias("text")).distinct())

    def suffixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly, held, size = Poly(43), [], 0

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            once = t["once"].to_numpy(zero_copy_only=False)
            _, bucket = np.unique(t["mh"].to_numpy(), return_inverse=True)
            n, s, rid, rid2 = (t[c].to_numpy() for c in ("n", "s", *_RID))
            buf, offsets = utf8(t["text"])
            of, within = np.repeat(np.arange(len(n)), n), _spans(n)
            hit = repeated(poly, buf, offsets[of] + within, bucket[of], length) & once[of]
            of, within = of[hit], within[hit]
            if len(of):
                new = np.ones(len(of), bool)
                new[1:] = (of[1:] != of[:-1]) | (within[1:] != within[:-1] + 1)
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(of)) - 1
                at, end = s[of[first]] + within[first], s[of[first]] + within[last] + length
                yield pa.RecordBatch.from_arrays([pa.array(rid[of[first]]), pa.array(rid2[of[first]]), pa.array(at.astype(np.int32)), pa.array(end.astype(np.int32))], [*_RID, "s", "e"])

        for batch in batches:  # in the order of mh: the last bucket may go on
            held.append(batch)
            size += len(batch)
            if size >= BATCH:
                t = pa.Table.from_batches(held)
                mh = t["mh"].to_numpy()
                cut = int(np.searchsorted(mh, mh[-1], "left"))
                if cut:
                    yield from done(t.slice(0, cut))
                held, size = t.slice(cut).combine_chunks().to_batches(), len(t) - cut
        if size:
            yield from done(pa.Table.from_batches(held))

    calm = with_text.where(F.col("members") <= hot).repartition("mh").sortWithinPartitions("mh", *_RID, "s").drop("members")
    parts = [plain, again, calm.mapInArrow(relieved(suffixes), "rid long, rid2 long, s int, e int")]

    if not (crowd := with_text.where(F.col("members") > hot)).isEmpty():

        def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, s, rid, rid2 = (batch.column(c).to_numpy() for c in ("n", "s", *_RID))
                once = batch.column("once").to_numpy(zero_copy_only=False)
                buf, offsets = utf8(batch.column("text"))
                of = np.repeat(np.arange(len(n)), n)
                at = offsets[of] + _spans(n)
                h = digests(buf, at, at + length)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[:, 0], h[:, 1], rid[of], rid2[of], (s[of] + _spans(n)).astype(np.int32), once[of])], ["h1", "h2", *_RID, "s", "once"])

        every = crowd.mapInArrow(relieved(windows), "h1 long, h2 long, rid long, rid2 long, s int, once boolean")
        twice = every.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1").select("h1", "h2")
        parts.append(every.where("once").join(twice, ["h1", "h2"]).select(*_RID, "s", (F.col("s") + length).alias("e")))

    union = parts[0]
    for p in parts[1:]:
        union = union.union(p)
    return union.groupBy(*_RID).agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes)."""
    text = F.coalesce("text", F.lit(""))
    # equal rows share an id here, and so what is removed from them
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    source = docs.select("doc_id", F.xxhash64(name, text).alias("rid"), F.xxhash64(F.lit(17), text, name).alias("rid2"), text.alias("text"))
    spans = repeated_spans(source.select(*_RID, "text"), length, hot)
    joined = source.join(spans, _RID, "left").select("doc_id", "text", "spans")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = utf8(batch.column("text"))
            out = []
            lists = batch.column("spans")
            bounds, flat = lists.offsets.to_numpy(), lists.values
            s, e = (flat.field(k).to_numpy() for k in (0, 1))
            for i in range(len(batch)):
                own = buf[offsets[i] : offsets[i + 1]]
                removed = runs = 0
                if lists[i].is_valid:
                    edge = np.zeros(len(own) + 1, np.int32)
                    np.add.at(edge, s[bounds[i] : bounds[i + 1]], 1)
                    np.add.at(edge, e[bounds[i] : bounds[i + 1]], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed = int(gone.sum())
                    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    own_kept = own[~gone].tobytes()
                else:
                    own_kept = own.tobytes()
                out.append((len(own), removed, runs, hashlib.sha256(own_kept).hexdigest(), *([own_kept] if with_text else [])))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])])

    kind = dict(docs.dtypes)["doc_id"]
    return joined.mapInArrow(relieved(cut), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
