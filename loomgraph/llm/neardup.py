"""MinHash near-duplicates by min-max hashing, links confirmed on full shingle sets.

A text's set holds its distinct word shingles as 64-bit hashes. Each of `PERMUTATIONS` hash functions is evaluated once a
shingle and gives two signature entries, its minimum and its maximum over the set; both are unbiased, and together vary
less than two minima. The signature is cut into bands of `ROWS` entries.

Texts with equal sets are one class. Class representatives that share a band are candidates. The bands are taken in
`GROUPS`, so that later bands find most links made: in each bucket that still holds several components the smallest id is
the centre, every member of another component is compared with it on the full sets, links join components, and the
bucket's next round leaves the used centre out. After `STARS` rounds the pairs that are still in different components
of one bucket are compared as they are. Before any comparison an exact bound rules pairs out: a parity sketch of 1024
bits differs in no more bits than the sets differ in shingles. So a large group of copies costs a comparison a member,
not one a pair, and no bucket is capped. With 24 bands of 4 a pair at the limit of 0.8 is missed with a chance of 3e-6.

Defined cases: null or wordless texts have an empty set and stay alone; a text with fewer words than a shingle is one
shingle; equal rows with one id form one row each; ids must not be null to be linked (null ids stay alone).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, encode, read, text_rows

PERMUTATIONS, ROWS, STARS, SKETCH = 48, 4, 2, 16
GROUPS = ((0, 6), (6, 14), (14, 24))
_RANDOM = np.random.default_rng(20240229).integers(1, 1 << 63, (2, PERMUTATIONS), dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


class _Words(dict):
    """64-bit hashes of words, kept while there are not too many."""

    def __missing__(self, w: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        if len(self) >= 1 << 17:
            self.clear()
        self[w] = h
        return h


_words = _Words()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text, A-Z lower-cased."""
    words = encode(text).lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    n = max(1, len(h) - k + 1)
    total = np.full(n, len(h) if len(h) < k else k, np.uint64)
    for i in range(min(k, len(h))):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(total)


def signature(s: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation, side by side."""
    low, high = np.full(PERMUTATIONS, np.iinfo(np.uint64).max), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(s), 4096):
        part = s[at : at + 4096, None] * _RANDOM[0] + _RANDOM[1]
        part ^= part >> np.uint64(32)
        low, high = np.minimum(low, part.min(0)), np.maximum(high, part.max(0))
    return np.stack((low, high), 1).ravel()


def bands(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(-1, ROWS)
    out = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for j in range(ROWS):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return out.view(np.int64)


def parity(s: np.ndarray) -> np.ndarray:
    """SKETCH longs; each bit tells whether an odd number of shingles falls on it."""
    return np.packbits((np.bincount((s & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1).astype(np.uint8)).view(np.int64)


def sign(rows: DataFrame, k: int) -> DataFrame:
    """doc_id, n, d1 and d2 (digest of the set), bands, sketch; rows has doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, d, bs, sk = [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(text, k)
                n.append(len(s))
                d.append(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64))
                sk.append(parity(s))
                bs.append(bands(signature(s)) if len(s) else np.zeros(0, np.int64))
            d = np.array(d, np.int64).reshape(-1, 2)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in bs]))).astype(np.int32)
            flat = np.concatenate(bs) if bs else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([x.tolist() for x in sk], pa.list_(pa.int64()))], names=["doc_id", "n", "d1", "d2", "bands", "sketch"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, d1 long, d2 long, bands array<long>, sketch array<long>")


def _sets(rows: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, k).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["sid", "s"])

    return rows.mapInArrow(run, f"sid {rows.schema['doc_id'].dataType.simpleString()}, s binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those rows of pairs (a, b) whose sets are similar enough."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = 0
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    m = np.concatenate((x, y))
                    m.sort(kind="stable")
                    both = int(np.count_nonzero(m[1:] == m[:-1]))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            at = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], names=["a", "b"])

    wide = pairs.join(sets.withColumnRenamed("s", "y"), pairs.b == F.col("sid")).drop("sid").join(sets.withColumnRenamed("s", "x"), F.col("a") == F.col("sid"))
    return wide.select("a", "b", "x", "y").mapInArrow(run, f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node reachable), for the nodes of links (a, b): large stars and small stars until nothing changes."""
    state = lambda x: tuple(x.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).head())
    links = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(links)
    while True:
        # Each node tells its larger neighbours of its smallest one; then those that a node hooked to are hooked to the least of them.
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("of")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "of")
        small = large.join(least, F.col("a") == F.col("of")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        links = cut(small)
        after = state(links)
        if after == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
        before = after


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept (it is that one)."""
    rows = text_rows(docs, id_col, text_col)
    signed = cut(sign(rows, k))
    classes = signed.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    member = cut(signed.drop("bands").join(classes.withColumnsRenamed({"d1": "e1", "d2": "e2"}), (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left").select("doc_id", "n", "rep"))
    reps = member.where("doc_id = rep").select(F.col("rep").alias("of")).distinct()
    sketch = [f"k{i}" for i in range(SKETCH)]
    spread = signed.where("n > 0").join(reps, F.col("doc_id") == F.col("of"), "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), "n", *(F.get("sketch", i).alias(k) for i, k in enumerate(sketch)), F.posexplode("bands").alias("no", "band"))
    full = spread.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select(F.col("band").alias("of"))
    buckets = cut(spread.join(full, F.col("band") == F.col("of"), "left_semi"))
    few = buckets.select(F.col("id").alias("of")).distinct()
    sets = cut(_sets(rows.join(few, F.col("doc_id") == F.col("of"), "left_semi").dropDuplicates(["doc_id"]), k))

    def near(prefix: str) -> Column:
        """Whether lengths and sketches allow the similarity with the member under the prefix."""
        n, m = F.col("n"), F.col(f"{prefix}n")
        differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(prefix + c))) for c in sketch), F.lit(0))
        return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * differ <= (100 - percent) * (n + m))

    labels = None
    for first, last in GROUPS:
        active = buckets.where(f"no >= {first} and no < {last}").drop("no")
        for turn in range(STARS + 1):
            if labels is None:
                active = active.withColumn("label", F.col("id"))
            else:
                active = active.drop("label").join(labels, F.col("id") == F.col("node"), "left").withColumn("label", F.coalesce("label", "id")).drop("node")
            ends = active.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.struct("id", "n", *sketch, "label")).alias("c")).where("lo <> hi").select(F.col("band").alias("of"), *(F.col(f"c.{x}").alias(f"c_{x}") for x in ("id", "n", *sketch, "label")))
            active = cut(active.join(ends, F.col("band") == F.col("of")).drop("of"))
            if turn < STARS:
                pairs = active.where((F.col("label") != F.col("c_label")) & near("c_")).select(F.col("c_id").alias("a"), F.col("id").alias("b"))
            else:
                x = active.select("band", "id", "n", "label", *sketch)
                y = x.toDF(*(f"y_{c}" for c in x.columns))
                pairs = x.join(y, (F.col("band") == F.col("y_band")) & (F.col("id") < F.col("y_id")) & (F.col("label") != F.col("y_label")) & near("y_")).select(F.col("id").alias("a"), F.col("y_id").alias("b"))
            found = cut(_confirmed(pairs.distinct(), sets, percent))
            if found.limit(1).count():
                labels = components(found if labels is None else found.unionByName(labels.toDF("a", "b")))
            active = active.where("id <> c_id").select("band", "id", "n", *sketch)
            if turn < STARS and not active.limit(1).count():
                break
    if labels is None:
        labels = found.toDF("node", "label")
    out = member.join(labels, F.col("rep") == F.col("node"), "left").withColumn("component_id", F.coalesce("label", "rep", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets and components of all documents over four-word shingles; null and wordless texts stay alone."""
    return link(read(spark, sf_dir, "documents"), k=4)


#: DuckDB: shingle sets, a join on shared shingles, components by recursion. Null and wordless texts have no shingles.
OP3_SQL = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) end) as s from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)),
e as (select a, b from l union all select b, a from l),
r(doc_id, node) as (select a, a from e union select r.doc_id, e.b from r join e on r.node = e.a),
c as (select doc_id, min(node) as c from r group by 1)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.c, w.doc_id) as component_id, coalesce(c.c, w.doc_id) = w.doc_id as kept
from w left join n using (doc_id) left join c using (doc_id)
"""
