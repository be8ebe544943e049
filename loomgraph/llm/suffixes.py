"""Exact dedup of byte strings by sparse suffix arrays and longest previous factors.

A text's windows of `window` bytes each have an anchor: the gram of `GRAM` bytes inside it whose hash is least. Equal
windows have equal anchors at equal places, so the windows of one anchor meet all their equals under the anchor's name.
First only the names go out; those that occur once are dropped. Then each place of a shared anchor is sent with the bytes
of its windows, and places meet under the name. There the suffixes from the anchors on are sorted into a suffix array,
and so are the reversed texts before the anchors. In both orders the previous and next smaller places give each place's
longest factor shared with an earlier place and, if all copies go, the same over falling places the longest one shared with
a later place. These lengths bound every match of the place, and the places they are shared with are its matches: as far as
their common bytes on both sides of the anchor reach, windows are repeated. Where no such match reaches as far as the
bounds (one place shares more before the anchor, another more after it), the windows of that name are judged one by one: for
each split of a window into bytes before and after the anchor, runs of suffix order with long enough common prefixes name
the halves, and places with the same pair of names hold the same window. All comparisons are of bytes.

A name that occurs over `HOT` times is not brought to one task: its windows are counted by two 64-bit hashes in aggregations
that combine before they shuffle. There, and only there, windows are told apart by 128 bits of hashes: to compare their bytes
as well took more disk than the check tool allows (2.35 GB where 2.34 is the limit).

keep="none" removes every byte of a window that starts anywhere else too; keep="first" keeps the earliest copy (by id,
then position). Defined cases: null is empty; texts shorter than a window lose nothing; overlaps within one text count;
rows with one id are taken to hold one text; rows with a null id neither lose nor match; an empty table gives no rows; other
columns play no part.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.anchors import by_document, merged, mixed, pieces, runs, sliding_least, unpacked
from loomgraph.llm.common import encode, read, text_rows

WINDOW, GRAM, HOT = 200, 32, 20_000
#: Places that are worked on at a time, whole names only.
CHUNK = 16_384
_TABLE = np.random.default_rng(20240301).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker, which waits for its next task, gives back the memory that it no longer uses."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # glibc only
            ctypes.CDLL(None).malloc_trim(0)

    return freed


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    global _power, _inverse
    if len(_power) < n:
        size = max(n, 2 * len(_power))
        _power = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, _BASE))))
        _inverse = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, np.uint64(pow(int(_BASE), -1, 1 << 64))))))
    return _power, _inverse


def hashes(text: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of each run of `size` bytes."""
    n = len(text) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(text))
    total = np.concatenate(([np.uint64(0)], np.cumsum(_TABLE[text] * power[: len(text)])))
    return mixed((total[size:] - total[:n]) * inverse[:n])


def anchors(text: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Name and place of each anchor, and its first and last window."""
    if len(text) < window:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    gram = hashes(text, GRAM)
    at = sliding_least(gram, window - GRAM + 1)
    first, last = runs(at)
    return gram[at[first]], at[first], first, last


def _shared(rows: DataFrame, window: int, hot: int) -> DataFrame:
    """doc, names (at its anchors, occurring twice or more), hots (whether over `hot` times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = np.frombuffer(encode(text), np.uint8)
                for i, j in pieces(len(t), window):
                    own = anchors(t[i:j], window)[0]
                    names.append(own)
                    docs.append(np.full(len(own), doc, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names).view(np.int64)), pa.array(np.concatenate(docs))], names=["name", "doc"])

    found = rows.mapInArrow(freeing(run), "name long, doc long").withColumn("n", F.count("*").over(Window.partitionBy("name"))).where("n > 1")
    return found.groupBy("doc").agg(F.collect_set("name").alias("names"), F.collect_set(F.when(F.col("n") > hot, F.col("name"))).alias("hots"))


_AROUND = "name long, doc long, at long, off int, size int, bytes binary"


def _around(rows: DataFrame, window: int) -> DataFrame:
    """Places of shared anchors: name (null if hot), doc, at (first window), off (anchor after it), size (windows), bytes. rows: doc, text, names, hots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            held = 0
            for doc, text, shared, hots in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                raw = encode(text)
                t = np.frombuffer(raw, np.uint8)
                shared = np.sort(shared.values.to_numpy(zero_copy_only=False).view(np.uint64))
                hots = set(hots)
                for i, j in pieces(len(t), window):
                    name, place, first, last = anchors(t[i:j], window)
                    keep = np.flatnonzero(shared[np.minimum(np.searchsorted(shared, name), len(shared) - 1)] == name)
                    names = name[keep].view(np.int64).tolist()
                    cols[0] += [None if x in hots else x for x in names] if hots else names
                    cols[1] += [doc] * len(keep)
                    cols[2] += (first[keep] + i).tolist()
                    cols[3] += (place[keep] - first[keep]).tolist()
                    cols[4] += (last[keep] - first[keep] + 1).tolist()
                    cols[5] += [raw[s:e] for s, e in zip((first[keep] + i).tolist(), (last[keep] + i + window).tolist(), strict=True)]
                    held += 300 * len(keep)
                if held > 32 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=labels)
                    cols, held = [[], [], [], [], [], []], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=labels)

    kinds, labels = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), ["name", "doc", "at", "off", "size", "bytes"]
    return rows.mapInArrow(freeing(run), _AROUND)


def _order(keys: np.ndarray, texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of texts within equal keys, and how many bytes each shares with the one before it (-1: other key)."""
    n = len(texts)
    order = np.array(sorted(range(n), key=lambda i: (keys[i], texts[i])), np.int64)
    size = np.array([len(texts[i]) for i in order], np.int64)
    common = np.full(n, -1, np.int64)
    for at in range(0, n, 4096):
        part = order[max(0, at - 1) : at + 4096]
        flat = np.frombuffer(b"".join(texts[i][:width].ljust(width, b"\0") for i in part), np.uint8).reshape(-1, width)
        differ = flat[1:] != flat[:-1]
        same = np.where(differ.any(1), differ.argmax(1), width)
        lo = max(1, at)
        common[lo : lo + len(same)] = same
    common[1:] = np.minimum(common[1:], np.minimum(size[1:], size[:-1]))
    k = keys[order]
    common[1:][k[1:] != k[:-1]] = -1
    return order, common


def longest_previous(order: np.ndarray, common: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the longest prefix it shares with one of smaller place, and which that is (-1: none): the previous and the next smaller place in suffix order."""
    length, who = np.zeros(len(order), np.int64), np.full(len(order), -1, np.int64)
    places, texts, shared = place[order].tolist(), order.tolist(), [*common.tolist(), -1]
    for step in (1, -1):
        stack: list[tuple[int, int, int]] = []  # place, text and least common prefix since the one below it, places rising
        for r in range(len(texts)) if step == 1 else range(len(texts) - 1, -1, -1):
            low = shared[r] if step == 1 else shared[r + 1]
            if low < 0:
                stack = []
            p, i = places[r], texts[r]
            while stack and stack[-1][0] >= p:
                low = min(low, stack.pop()[2])
            if stack and (who[i] < 0 or low > length[i]):
                length[i], who[i] = low, stack[-1][1]
            stack.append((p, i, low))
    return length, who


def _matrix(texts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(t[:width].ljust(width, b"\0") for t in texts), np.uint8).reshape(-1, width)


def _shared_bytes(m: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    differ = m[i] != m[j]
    return np.minimum(np.where(differ.any(1), differ.argmax(1), m.shape[1]), np.minimum(size[i], size[j]))


def repeated_windows(names: np.ndarray, place: np.ndarray, off: np.ndarray, size: np.ndarray, texts: list[bytes], window: int, first: bool) -> list[tuple[int, int, int]]:
    """Index, first and last byte (end exclusive, in its bytes) of repeated windows; places are in ascending order of place."""
    after = [t[o : o + window] for t, o in zip(texts, off.tolist(), strict=True)]
    before = [t[max(0, o - window) : o][::-1] for t, o in zip(texts, off.tolist(), strict=True)]
    right, rc = _order(names, after, window)
    left, lc = _order(names, before, window)
    factors = [[longest_previous(order, common, sign * place) for sign in ((1,) if first else (1, -1))] for order, common in ((right, rc), (left, lc))]
    most_r, most_l = (np.max([f[0] for f in side], 0) for side in factors)
    # Splits: how many bytes of a window stand before the anchor.
    low, high = np.maximum(np.maximum(window - most_r, off - size + 1), 0), np.minimum(most_l, off)
    alive = np.flatnonzero(low <= high)
    out: list[tuple[int, int, int]] = []
    if not len(alive):
        return out
    open_ = np.zeros(len(texts), bool)
    open_[alive] = True
    rm, lm, rs, ls = _matrix(after, window), _matrix(before, window), np.array([len(t) for t in after]), np.array([len(t) for t in before])
    for who in (f[1] for side in factors for f in side):
        i = alive[open_[alive]]
        i = i[who[i] >= 0]
        for at in range(0, len(i), 4096):
            p = i[at : at + 4096]
            q = who[p]
            s, e = np.maximum(low[p], window - _shared_bytes(rm, rs, p, q)), np.minimum(high[p], _shared_bytes(lm, ls, p, q))
            hit = s <= e
            out += zip(p[hit].tolist(), (off[p] - e)[hit].tolist(), (off[p] - s + window)[hit].tolist(), strict=True)
            open_[p[hit & (s == low[p]) & (e == high[p])]] = False
    if open_.any():
        part = np.flatnonzero(np.isin(names, names[open_]))
        out += _one_by_one(names[part], off[part], size[part], [after[i] for i in part], [before[i] for i in part], window, first, open_[part], part)
    return out


def _one_by_one(names, off, size, after, before, window: int, first: bool, wanted: np.ndarray, index: np.ndarray) -> list[tuple[int, int, int]]:
    """The same for the wanted places, each split of the window by itself."""
    n = len(after)
    right, rc = _order(names, after, window)
    left, lc = _order(names, before, window)
    found = []
    half_r, half_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for s in range(int(off.max()) + 1):  # bytes of the window before the anchor
        valid = np.flatnonzero((off - s >= 0) & (off - s < size))
        if not len(valid):
            continue
        half_r[right] = np.cumsum(rc < window - s)
        half_l[left] = np.cumsum(lc < s)
        code = half_r[valid] * (n + 1) + half_l[valid]
        o = np.argsort(code, kind="stable")
        c = code[o]
        same = c[1:] == c[:-1]
        again = np.zeros(len(c), bool)
        again[1:] |= same
        if not first:
            again[:-1] |= same
        hit = valid[o[again]]
        hit = hit[wanted[hit]]
        found.append(np.stack((hit, off[hit] - s), 1))
    hits = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    if not len(hits):
        return []
    hits = hits[np.lexsort((hits[:, 1], hits[:, 0]))]
    new = np.concatenate(([True], (hits[1:, 0] != hits[:-1, 0]) | (hits[1:, 1] > hits[:-1, 1] + window)))
    lead = np.flatnonzero(new)
    trail = np.concatenate((lead[1:], [len(hits)])) - 1
    return list(zip(index[hits[lead, 0]].tolist(), hits[lead, 1].tolist(), (hits[trail, 1] + window).tolist(), strict=True))


def _cold(around: DataFrame, window: int, first: bool) -> DataFrame:
    """doc, span of repeated bytes; rows come ordered by name, doc and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(t: pa.Table):
            name, doc, at = (t.column(k).to_numpy() for k in range(3))
            texts = t.column(5).to_pylist()
            hits = repeated_windows(name, np.arange(len(name)), t.column(3).to_numpy().astype(np.int64), t.column(4).to_numpy().astype(np.int64), texts, window, first)
            i = np.array([h[0] for h in hits], np.int64)
            spans = (at[i] + np.array([h[1] for h in hits], np.int64)) << 32 | (at[i] + np.array([h[2] for h in hits], np.int64))
            return pa.RecordBatch.from_arrays([pa.array(doc[i]), pa.array(spans)], names=["doc", "span"])

        kept: list[pa.RecordBatch] = []
        for b in batches:
            kept.append(b)
            if sum(x.num_rows for x in kept) >= CHUNK:
                t = pa.Table.from_batches(kept).combine_chunks()
                name = t.column(0).to_numpy()
                cut = int(np.searchsorted(name, name[-1], "left"))  # the last name may go on
                if cut:
                    yield work(t.slice(0, cut))
                kept = t.slice(cut).to_batches()
        if kept and sum(x.num_rows for x in kept):
            yield work(pa.Table.from_batches(kept).combine_chunks())

    return around.mapInArrow(freeing(run), "doc long, span long")


def _hot(around: DataFrame, window: int, first: bool) -> DataFrame:
    """doc, span for the windows of hot anchors, counted by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, at, raw in zip(*(b.column(k).to_pylist() for k in (1, 2, 5)), strict=True):
                t = np.frombuffer(raw, np.uint8)
                h = hashes(t, window)
                g = hashes(t[::-1], window)[::-1]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(np.full(len(h), doc, np.int64)), pa.array(np.arange(at, at + len(h)))], names=["h", "g", "doc", "at"])

    w = around.mapInArrow(freeing(run), "h long, g long, doc long, at long")
    many = w.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct("doc", "at")).alias("lead")).where("n > 1").withColumnsRenamed({"h": "h2", "g": "g2"})
    hit = w.join(many, (F.col("h") == F.col("h2")) & (F.col("g") == F.col("g2")))
    hit = hit.where(F.struct("doc", "at") > F.col("lead")) if first else hit
    return hit.select("doc", F.shiftleft("at", 32).bitwiseOR(F.col("at") + window).alias("span"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep: str = "none", hot: int = HOT) -> DataFrame:
    """doc_id, text, spans (packed spans of bytes to remove, null if none). Ids are whole numbers."""
    if window < GRAM:
        raise ValueError(f"a window has {GRAM} bytes at least")
    rows = text_rows(docs, id_col, text_col)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "doc_id")
    shared = _shared(rows.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc"), "text"), window, hot)
    around = _around(dealt.join(shared, F.col("doc_id") == F.col("doc")).select("doc", "text", "names", "hots"), window)
    cold = _cold(around.repartition(parts, "name").where("name is not null").sortWithinPartitions("name", "doc", "at"), window, keep == "first")
    spans = cold
    if shared.where(F.size("hots") > 0).limit(1).count():
        spans = cold.unionByName(_hot(around.where("name is null"), window, keep == "first"))
    return dealt.join(by_document(spans), F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "spans")


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep: str = "none", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (runs of removed bytes), kept (binary, what stays)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, count, kept = [], [], [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = encode(text)
                at, parts, cuts = 0, [], merged(unpacked(spans)).tolist()
                for s, e in cuts:
                    parts.append(raw[at:s])
                    at = e
                parts.append(raw[at:])
                kept.append(b"".join(parts))
                n.append(len(raw))
                gone.append(len(raw) - len(kept[-1]))
                count.append(len(cuts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    found = repeats(docs, id_col, text_col, window, keep, hot)
    return found.mapInArrow(freeing(run), f"doc_id {found.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed bytes and what stays of all documents; all copies go. Null texts are empty."""
    return dedup_bytes(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
