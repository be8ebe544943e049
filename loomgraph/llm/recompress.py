"""Substring dedup over words by recompression.

Rounds of recompression name runs of equal symbols and then pairs of symbols, the alphabet split in two by a bit of the
symbol's name: a pair is joined where a left symbol meets a right one. Names are hashes of what they stand for, so
they agree all over the corpus without exchange, and whether a boundary between words outlives a round depends on the
few words around it: equal strings have the same interior symbols. `ROUNDS` rounds fit a window of 13 words. In each
window the interior boundary that outlives most rounds (ties: by the name of the symbols around it) is its anchor.

Spark brings equal symbols together twice. First, the names at anchors: only names that occur in several documents go
on. Then, per document, the windows around its shared anchors: they meet under the anchor's name, ordered by document,
and a window is repeated if the same words, at the same place around the anchor, came in a smaller document.

Defined cases: null, empty and short texts have no windows and lose nothing; windows of one document or of rows with the
same id do not remove each other; rows with one id are taken to hold one text; a null id neither loses nor gives words.
Windows are compared by 64-bit hashes under a 64-bit name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.anchors import by_document, merged, mixed, pieces, runs, sliding_least, unpacked
from loomgraph.llm.common import cut, encode, read, text_rows
from loomgraph.llm.neardup import word_hashes

WINDOW, ROUNDS = 13, 2
#: Words on either side of a boundary on which its fate in all rounds depends.
CONTEXT = 3
CHUNK = 200_000


def _left(names: np.ndarray, turn: int) -> np.ndarray:
    return (mixed(names + np.uint64(turn)) >> np.uint64(63)).astype(bool)


def outlived(h: np.ndarray) -> np.ndarray:
    """For each boundary between two words (index of the second), how many rounds it outlives; 0 at the text's start."""
    n = len(h)
    level = np.zeros(n, np.int64)
    if n < 2:
        return level
    same = h[1:] == h[:-1]
    left = _left(h, 1)
    cut = np.concatenate(([True], ~same & ~(left[:-1] & ~left[1:])))  # runs are joined, then left-right pairs
    level[1:] += cut[1:]
    # A symbol of the next round is named, at each boundary, by its two words next to it at most.
    begins = np.flatnonzero(cut)
    size = np.diff(np.append(begins, n))
    one = np.uint64(0x9E3779B97F4A7C15)
    head = np.where(size > 1, mixed(h[begins] * one + h[np.minimum(begins + 1, n - 1)]), h[begins])
    ends = begins + size - 1
    tail = np.where(size > 1, mixed(h[np.maximum(ends - 1, 0)] * one + h[ends]), h[ends])
    stays = (tail[:-1] != head[1:]) & ~(_left(tail[:-1], 2) & ~_left(head[1:], 2))
    level[begins[1:][stays]] += 1
    return level


def anchors(h: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words' hashes: name of each anchor, its place, and its first and last window."""
    width = window - 2 * CONTEXT + 1
    n = len(h) - 2 * CONTEXT + 1  # boundaries with their context
    if len(h) < window:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    name = np.zeros(n, np.uint64)
    for i in range(2 * CONTEXT):
        name = mixed(name * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    # Only what the context fixes: the first boundaries of a text see less than it.
    level = outlived(h)[CONTEXT : CONTEXT + n]
    order = (np.uint64(ROUNDS) - level.astype(np.uint64)) << np.uint64(62) | name >> np.uint64(2)
    at = sliding_least(order, width)
    first, last = runs(at)
    return name[at[first]], at[first], first, last


def _windows(h: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    for i in range(window):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[starts + i])
    return out


def _shared(rows: DataFrame, window: int) -> DataFrame:
    """doc and the names at its anchors that another document has as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, docs = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = word_hashes(encode(text).split())
                own = np.unique(np.concatenate([anchors(h[i:j], window)[0] for i, j in pieces(len(h), window)]))
                names.append(own)
                docs.append(np.full(len(own), doc, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names).view(np.int64)), pa.array(np.concatenate(docs))], names=["name", "doc"])

    found = rows.mapInArrow(run, "name long, doc long")
    by = Window.partitionBy("name")
    return found.withColumn("lo", F.min("doc").over(by)).withColumn("hi", F.max("doc").over(by)).where("lo < hi").groupBy("doc").agg(F.collect_list("name").alias("names"))


def _around(rows: DataFrame, window: int) -> DataFrame:
    """name, doc, at (first window, in words), hashes of the windows of shared anchors. rows: doc, text, names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for doc, text, shared in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                h = word_hashes(encode(text).split())
                shared = np.sort(shared.values.to_numpy(zero_copy_only=False).view(np.uint64))
                for i, j in pieces(len(h), window):
                    name, _, first, last = anchors(h[i:j], window)
                    keep = shared[np.minimum(np.searchsorted(shared, name), len(shared) - 1)] == name
                    name, first, size = name[keep], first[keep], (last - first + 1)[keep]
                    starts = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
                    for k, x in enumerate((name.view(np.int64), np.full(len(name), doc, np.int64), first + i, size, _windows(h[i:j], starts, window).view(np.int64))):
                        out[k].append(x)
            name, docs, at, size, hashes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
            ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(docs), pa.array(at.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes))], names=["name", "doc", "at", "hashes"])

    return rows.mapInArrow(run, "name long, doc long, at int, hashes array<long>")


def _repeated(around: DataFrame, window: int) -> DataFrame:
    """doc, span: words covered by windows that a smaller document has; rows come ordered by name and doc."""

    def judged(name, doc, at, size, hashes, carry):
        """Spans of repeated windows, and the first documents of the last name's windows."""
        row = np.repeat(np.arange(len(name)), size)
        step = np.arange(len(hashes)) - np.repeat(np.cumsum(size) - size, size)
        code = mixed(hashes.view(np.uint64) + mixed(name.view(np.uint64))[row])
        all_code, all_doc = np.concatenate((carry[0], code)), np.concatenate((carry[1], doc[row]))
        order = np.argsort(all_code, kind="stable")
        s = all_code[order]
        head = np.concatenate(([True], s[1:] != s[:-1]))
        low = np.empty(len(s), np.int64)
        low[order] = all_doc[order][np.flatnonzero(head)][np.cumsum(head) - 1]
        hit = np.flatnonzero(low[len(carry[0]) :] < doc[row])
        start = at[row[hit]] + step[hit]
        # One span for neighbouring windows of a row
        new = np.concatenate(([True], (row[hit][1:] != row[hit][:-1]) | (start[1:] != start[:-1] + 1))) if len(hit) else np.zeros(0, bool)
        lead = np.flatnonzero(new)
        trail = np.concatenate((lead[1:], [len(hit)])) - 1 if len(hit) else lead
        span = start[lead] << 32 | (start[trail] + window)
        last = name[row] == name[-1] if len(name) else np.zeros(0, bool)
        keep = order[np.flatnonzero(head)]
        keep = keep[np.concatenate((np.ones(len(carry[0]), bool), last))[keep]]
        return doc[row[hit[lead]]], span, (all_code[keep], all_doc[keep])

    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, last = none, None
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                name, doc = part.column(0).to_numpy(), part.column(1).to_numpy()
                lists = part.column(3)
                size = np.diff(lists.offsets.to_numpy())
                carry = carry if last is not None and len(name) and name[0] == last else none
                d, span, carry = judged(name, doc, part.column(2).to_numpy().astype(np.int64), size, lists.flatten().to_numpy(), carry)
                last = name[-1] if len(name) else last
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(span)], names=["doc", "span"])

    return around.mapInArrow(run, "doc long, span long")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, text, spans (packed spans of words to remove, null if none), copy (a smaller document has the same text). Ids are whole numbers."""
    if not 2 * CONTEXT + 1 <= window:
        raise ValueError(f"a window has {2 * CONTEXT + 1} words at least")
    rows = text_rows(docs, id_col, text_col)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "doc_id")
    hashed = rows.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(3), "text").alias("h2"))
    firsts = hashed.groupBy("h1", "h2").agg(F.min("doc_id").alias("first")).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "first")
    # Of equal texts only the first meets the others; the rest is repeated as a whole.
    known = cut(hashed.join(firsts, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))).select(F.col("doc_id").alias("of"), (F.col("doc_id") > F.col("first")).alias("copy")).distinct())
    lead = dealt.join(known.where("not copy"), F.col("doc_id") == F.col("of")).select(F.col("doc_id").cast("long").alias("doc"), "text")
    around = _around(lead.join(_shared(lead, window), "doc").select("doc", "text", "names"), window)
    spans = by_document(_repeated(around.repartition(parts, "name").sortWithinPartitions("name", "doc"), window))
    return dealt.join(known, F.col("doc_id") == F.col("of"), "left").join(spans, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "spans", F.coalesce("copy", F.lit(False)).alias("copy"))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, kept = [], [], []
            for text, spans, copy in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                w = encode(text).split()
                at, gone, parts = 0, 0, []
                for s, e in [(0, len(w))] if copy and len(w) >= window else merged(unpacked(spans)).tolist():
                    parts += w[at:s]
                    gone += min(e, len(w)) - s
                    at = e
                n.append(len(w))
                removed.append(gone)
                kept.append(b" ".join(parts + w[at:]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    found = repeats(docs, id_col, text_col, window)
    return found.mapInArrow(run, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed words and what stays of all documents; null texts have no words."""
    return dedup_substrings(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
x as (select doc_id, i, array_to_string(w[i:i+12], ' ') as win from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d)),
f as (select win, min(doc_id) as first from x group by 1),
g as (select distinct doc_id, unnest(range(i, i + 13)) as wd from x join f using (win) where doc_id > first),
l as (select doc_id, list(wd) as gone, count(*) as n from g group by 1)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(l.n, 0)::bigint as n_removed,
  sha256(coalesce(array_to_string(case when l.gone is null then d.w else list_filter(d.w, lambda x, i: not list_contains(l.gone, i)) end, ' '), '')) as kept_sha256
from d left join l using (doc_id)
"""
