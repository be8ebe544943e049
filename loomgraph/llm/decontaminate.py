"""Benchmark decontamination by one Aho-Corasick automaton over normalised test items.

A-Z are lower-cased; words are runs of [0-9a-z] and of everything beyond ASCII. Each item gives its windows of
`window` words (an item with fewer words, but not none, is one window). The words of a document are joined by one
space, so that a window is a plain substring between spaces; the automaton reads that string once, and a hit's words
are mapped back to offsets of the original text.

Defined cases: a null or empty text has no words and no hits; an item without words gives nothing; equal windows of
several items count for each of them; repeated documents and documents without an id are judged each on their own; an item
without an id still hits words, but is no item of the list; an empty benchmark hits nothing; other columns play no part.

The windows are sent to all executors in parts of `max_bytes` at most; documents are read once a part, and the parts'
results are joined by row. A benchmark of one part, the usual case, needs no join.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, encode, read, text_rows

WINDOW = 8
#: Bound on the windows of the benchmark that one automaton holds, in bytes of their text; what is more makes further parts.
PART_BYTES = 64 << 20
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ORIGINAL = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: The automaton of this Python worker, by digest of its patterns.
_built: dict[str, object] = {}


def normal_words(text: str | None) -> list[bytes]:
    return encode(text).translate(_KEEP).split()


def windows(items: Iterable[tuple[str | None, str | None]], window: int = WINDOW) -> dict[bytes, list[str]]:
    """Window, with a space at either end, to the ids of the items that hold it (none for an item without an id)."""
    found: dict[bytes, set[str]] = defaultdict(set)
    for item, text in items:
        w = normal_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            ids = found[b" " + b" ".join(w[i : i + window]) + b" "]
            if item is not None:
                ids.add(item)
    return {k: sorted(v) for k, v in found.items()}


def _automaton(patterns: dict[bytes, list[str]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for p, ids in patterns.items():
        a.add_word(p.decode("latin-1"), (p.count(b" ") - 1, ids))
    if patterns:
        a.make_automaton()
    return a


def scan(automaton, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged runs of hit words (end exclusive), items."""
    w = normal_words(text)
    runs: list[list[int]] = []
    items: set[str] = set()
    if w and len(automaton):
        line = (b" " + b" ".join(w) + b" ").decode("latin-1")
        at = seen = 0
        for end, (n, ids) in automaton.iter(line):
            seen += line.count(" ", at, end)
            at = end
            first = seen - n
            items.update(ids)
            runs.append([first, seen])
    merged: list[list[int]] = []
    for a, b in sorted(runs):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    return len(w), [(a, b) for a, b in merged], items


def _scanned(rows: DataFrame, patterns: dict[bytes, list[str]]) -> DataFrame:
    """The columns of rows but text, with n_words, runs of hit words, items and spans under one automaton. rows: text last."""
    key = hashlib.sha256(repr(sorted(patterns.items())).encode()).hexdigest()
    sent = rows.sparkSession.sparkContext.broadcast(patterns)
    names = [*rows.columns[:-1], "n_words", "runs", "items", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _built:
            _built.clear()
            _built[key] = _automaton(sent.value)
        automaton = _built[key]
        for b in batches:
            n_words, runs, items, spans = [], [], [], []
            for text in b.column(b.num_columns - 1).to_pylist():
                n, found, ids = scan(automaton, text)
                n_words.append(n)
                runs.append([{"s": s, "e": e} for s, e in found])
                items.append(sorted(ids))
                if found:
                    at = [m.span() for m in _ORIGINAL.finditer(text)]
                    spans.append([{"start": at[s][0], "end": at[e - 1][1]} for s, e in found])
                else:
                    spans.append([])
            pair = lambda x, y: pa.list_(pa.struct([(x, pa.int64()), (y, pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(n_words, pa.int64()), pa.array(runs, pair("s", "e")), pa.array(items, pa.list_(pa.string())), pa.array(spans, pair("start", "end"))],
                names=names,
            )

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rows.columns[:-1])
    return rows.mapInArrow(run, f"{kinds}, n_words long, runs array<struct<s: long, e: long>>, items array<string>, spans array<struct<start: long, end: long>>")


def _parts(known: DataFrame, window: int, most: int) -> Iterator[dict[bytes, list[str]]]:
    """The windows of the items in parts of `most` bytes at most (one item at least)."""
    held: list[tuple[str | None, str]] = []
    size = 0
    for i, t in known.toLocalIterator():
        # A word of an item stands in `window` windows at most.
        cost = window * len(encode(t))
        if held and size + cost > most:
            yield windows(held, window)
            held, size = [], 0
        held.append((i, t))
        size += cost
    yield windows(held, window)


def _together(first: str | Column, second: str | Column) -> Column:
    """Sorted disjoint runs of two such arrays; touching ones stay two, as they cover the same."""
    both = F.array_sort(F.concat(first, second))
    last = lambda acc: F.element_at(acc, -1)

    def step(acc: Column, x: Column) -> Column:
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc).s.alias("s"), F.greatest(last(acc).e, x.e).alias("e"))))
        return F.when(F.size(acc) == 0, F.array(x)).when(x.s <= last(acc).e, joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(both, F.slice(both, 1, 0), step)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (array of ids as strings, sorted), spans (array of start and end in the original, end exclusive)."""
    known = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).cast("string").alias("t")).where("t is not null")
    rows = text_rows(docs, id_col, text_col)
    held = known.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).head()[0]
    if held * window <= part_bytes:
        found = _scanned(rows, windows(known.toLocalIterator(), window))
    else:
        # Rows are told apart by a number, as ids may repeat; it is written, so that all parts see the same.
        rows = cut(rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "text"))
        found = None
        for patterns in _parts(known, window, part_bytes):
            part = cut(_scanned(rows, patterns))
            if found is None:
                found = part
            else:
                more = part.select(F.col("row").alias("r2"), F.col("runs").alias("runs2"), F.col("items").alias("items2"), F.col("spans").alias("spans2"))
                found = cut(
                    found.join(more, F.col("row") == F.col("r2")).select(
                        "doc_id", "row", "n_words", _together("runs", "runs2").alias("runs"), F.array_sort(F.array_union("items", "items2")).alias("items"),
                        F.transform(_together(*(F.transform(c, lambda x: F.struct(x.start.alias("s"), x.end.alias("e"))) for c in ("spans", "spans2"))), lambda x: F.struct(x.s.alias("start"), x.e.alias("end"))).alias("spans"),
                    )
                )
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, x: a + x.e - x.s)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "spans")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of all documents against all of benchmark; a document of two items or more is contaminated."""
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"))


#: The words of a text in DuckDB, null as none.
_SQL_WORDS = r"list_filter(string_split_regex(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP7_SQL = f"""
with d as (select doc_id, {_SQL_WORDS.format("text")} as w from documents),
b as (select item_id, {_SQL_WORDS.format("text")} as w from benchmark),
p as (select distinct item_id, least(len(w), 8) as k, array_to_string(w[i:i+7], ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) as i from b where len(w) > 0)),
lens as (select distinct k from p),
x as (select doc_id, k, i, array_to_string(w[i:i+k-1], ' ') as win
  from (select doc_id, k, w, unnest(range(1, len(w) - k + 2)) as i from d, lens where len(w) >= k)),
h as (select x.doc_id, p.item_id, x.i, x.k from x join p on x.win = p.win and x.k = p.k),
hit as (select doc_id, count(distinct wd) as n from (select doc_id, unnest(range(i, i + k)) as wd from h) group by 1),
it as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as ids from (select distinct doc_id, cast(item_id as varchar) as item from h) group by 1)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(hit.n, 0) as bigint) as n_hit, cast(coalesce(it.n, 0) as bigint) as n_items,
  sha256(coalesce(it.ids, '')) as items_sha256, coalesce(it.n, 0) >= 2 as contaminated
from d left join hit using (doc_id) left join it using (doc_id)
"""
