"""Language identification by interpolated Kneser-Ney character models.

Text is lower-cased, each letter of the basic plane is one 16-bit symbol, letters beyond it share the symbols of its
private range, everything else (by Unicode's own classes) is a space, runs of spaces are one. Per language a 4-gram model with modified continuation counts for the lower orders is learned; the final
interpolated log-probabilities of all languages stand side by side in one table per order, whose keys are the packed
symbols under a bijective multiplicative hash, sorted, so that a text is scored by binary search in whole arrays: a
4-gram of the table costs one search, others back off through the weights of their contexts.
The language with the lowest cross-entropy per character wins. Its confidence comes from a logistic curve over the
margin to the second, fitted on labelled documents kept out of the counts; a document is rejected if it has no letter or
if its cross-entropy, less `SLACK` over the root of its length, lies beyond the limit of the winning language: the value
that one right document in 1 / `FALSE_REJECTS` exceeds, by an exponential tail fitted to the highest tenth of those documents.

Learning takes about `sample` labelled documents a language, chosen by the hash of their id; that is the documented
bound of the model's size a language. Languages are not limited: they stand in blocks of `BLOCK`, each with its own
tables, so that the model grows in proportion to them. Whole texts are counted and scored.

Defined cases: null or letterless text is `und` with score 0, rejected; a null lang is never learned from; with no
labelled document everything is `und`; ties between languages go to the first by code point; repeated rows are judged
each on their own; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, read, text_rows

SAMPLE = 3000
BLOCK = 64
SLACK, FALSE_REJECTS = 4.0, 1e-4
#: The table of languages and their rows is sent to all executors up to so many rows, which are counted first.
BROADCAST_ROWS = 1 << 20
DISCOUNT = 0.75
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Symbol of each code point: its lower-case letter, or a space. Letters beyond the basic plane share its private range, where no letter is."""
    global _LETTER
    if _LETTER is None:
        table = np.full(0x110000, 32, np.uint16)
        for cp in range(0x10000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                table[cp] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else cp
        for cp in range(0x10000, 0x110000):
            c = chr(cp)
            if c.isalpha():
                table[cp] = 0xE000 + ord(c.lower()[0]) % 0x1900
        _LETTER = table
    return _LETTER


def symbols(text: str | None) -> np.ndarray:
    """Symbols between two spaces; none if there is no letter."""
    cps = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.concatenate(([32], _letters()[cps], [32])).astype(np.uint16)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 32) | (s[:-1] != 32)
    s = s[keep]
    return s if len(s) > 2 else s[:0]


def grams(s: np.ndarray) -> np.ndarray:
    """Each symbol but the first with the three before it, packed; before the text stand zeros."""
    p = np.concatenate((np.zeros(2, np.uint64), s.astype(np.uint64)))
    return (p[:-3] << np.uint64(48)) | (p[1:-2] << np.uint64(32)) | (p[2:-1] << np.uint64(16)) | p[3:]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k, at = np.unique(keys, return_inverse=True)
    return k, np.bincount(at, counts, len(k))


_LOW = [np.uint64((1 << (16 * o)) - 1) for o in (1, 2, 3, 4)]


def tail_limit(falling: list[float], rate: float = FALSE_REJECTS) -> float:
    """What a value exceeds with a chance of `rate`, by an exponential tail over the highest tenth of such values (its scale is 0.05 at least)."""
    k = max(1, len(falling) // 10)
    start = falling[min(k, len(falling) - 1)]
    scale = max(0.05, sum(x - start for x in falling[:k]) / k)
    return max(falling[0], start + scale * math.log(k / len(falling) / rate))


class Tables:
    """The tables of some languages side by side. counts: language to packed 4-grams and how often they occur; floor: log-probability of a symbol at large."""

    def __init__(self, languages: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]], floor: float):
        n, sixteen = len(languages), np.uint64(16)
        low = _LOW
        union4 = np.unique(np.concatenate([counts[lang][0] for lang in languages]))
        keys = [np.unique(union4 & m) for m in low[:3]] + [union4]
        contexts = [np.unique(k >> sixteen) for k in keys]  # of order 1 there is the empty one
        self.floor, self.n = floor, n
        logp = [np.zeros((len(k), n), np.float32) for k in keys]
        logb = [np.zeros((len(c), n), np.float32) for c in contexts]
        for j, lang in enumerate(languages):
            k4, c4 = counts[lang]
            order = [None, None, None, (k4, c4.astype(float))]
            for o in (2, 1, 0):  # continuation counts: how many different symbols come before
                order[o] = _summed(order[o + 1][0] & low[o], np.ones(len(order[o + 1][0])))
            below = None
            for o in range(4):
                k, c = order[o]
                ctx, at = np.unique(k >> sixteen, return_inverse=True)
                total, kinds = np.bincount(at, c, len(ctx)), np.bincount(at, minlength=len(ctx))
                back = DISCOUNT * kinds / total
                at_key = np.searchsorted(contexts[o], ctx)
                all_back = np.ones(len(contexts[o]))
                all_back[at_key] = back
                weight = all_back[np.searchsorted(contexts[o], keys[o] >> sixteen)]
                lower = np.full(len(keys[0]), math.exp(self.floor)) if o == 0 else below[np.searchsorted(keys[o - 1], keys[o] & low[o - 1])]
                own = np.zeros(len(keys[o]))
                own[np.searchsorted(keys[o], k)] = np.maximum(c - DISCOUNT, 0) / total[at]
                below = own + weight * lower
                logp[o][:, j], logb[o][:, j] = np.log(below), np.log(all_back)
        self.tables = []
        for o in range(4):
            hashed, ctx = keys[o] * _ODD, contexts[o] * _ODD
            a, b = np.argsort(hashed), np.argsort(ctx)
            self.tables.append((hashed[a], logp[o][a], ctx[b], logb[o][b]))

    def entropies(self, g: np.ndarray) -> np.ndarray:
        """Mean negative log-probability of the grams under each language."""
        out = np.zeros(self.n)
        total = len(g)
        weights = np.zeros(self.n)
        for o in (3, 2, 1, 0):
            keys, logp, ctx, logb = self.tables[o]
            h = g * _ODD
            i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[i] == h
            out += np.bincount(i[hit], minlength=len(keys)) @ logp if hit.sum() > len(keys) else logp[i[hit]].sum(0, dtype=np.float64)
            g = g[~hit]
            if not len(g):
                break
            c = (g >> np.uint64(16)) * _ODD
            i = np.minimum(np.searchsorted(ctx, c), len(ctx) - 1)
            weights += logb[i[ctx[i] == c]].sum(0, dtype=np.float64)
            g = g & np.uint64((1 << (16 * o)) - 1) if o else g
        out += weights + len(g) * self.floor
        return -out / max(1, total)

class Model:
    """All languages, in blocks. counts: language to packed 4-grams and how often they occur."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], block: int = BLOCK):
        self.languages = sorted(counts)
        symbols_seen = len(np.unique(np.concatenate([np.unique(k & _LOW[0]) for k, _ in counts.values()]))) if counts else 0
        floor = math.log(1.0 / (symbols_seen + 1))
        self.blocks = [Tables(self.languages[i : i + block], counts, floor) for i in range(0, len(self.languages), block)]
        self.slope, self.shift = 1.0, 0.0
        self.limits = np.full(len(self.languages), np.inf)

    def entropies(self, g: np.ndarray) -> np.ndarray:
        """Mean negative log-probability of the grams under each language."""
        return np.concatenate([b.entropies(g) for b in self.blocks])

    def judge(self, text: str | None) -> tuple[str, float, bool, float, float, int]:
        """Language, score, rejected, its cross-entropy, margin to the second, grams."""
        g = grams(symbols(text))[1:] if text else np.zeros(0, np.uint64)
        if not len(g) or not self.languages:
            return "und", 0.0, True, math.inf, 0.0, 0
        h = self.entropies(g)
        best = int(np.argmin(h))
        margin = float(np.partition(h, 1)[1] - h[best]) * math.sqrt(len(g)) if len(h) > 1 else math.sqrt(len(g))
        score = 1 / (1 + math.exp(-min(50.0, max(-50.0, self.slope * margin + self.shift))))
        return self.languages[best], score, bool(h[best] - SLACK / math.sqrt(len(g)) > self.limits[best]), float(h[best]), margin, len(g)

    def calibrate(self, labelled: list[tuple[str, str]]) -> None:
        """Confidence and limits from labelled texts that were not counted."""
        seen = [(lang, *self.judge(text)) for text, lang in labelled]
        seen = [x for x in seen if x[1] != "und"]
        if not seen:
            return
        x, y = np.array([s[5] for s in seen]), np.array([float(s[0] == s[1]) for s in seen])
        good, bad = y.sum(), (1 - y).sum()
        t = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))  # smoothed, as all may be right
        z = np.minimum(x, 40.0) / 10.0
        a, b = 1.0, 0.0
        for _ in range(2000):
            p = 1 / (1 + np.exp(-(a * z + b)))
            a, b = a - 2.0 * float(((p - t) * z).mean()), b - 2.0 * float((p - t).mean())
        self.slope, self.shift = max(0.01, a / 10.0), b
        for j, lang in enumerate(self.languages):
            own = sorted((s[4] - SLACK / math.sqrt(s[6]) for s in seen if s[0] == s[1] == lang), reverse=True)
            if own:
                self.limits[j] = tail_limit(own)


def _share(rows: DataFrame, sample: int) -> DataFrame:
    """About `sample` rows of each lang, by the hash of the id."""
    per = cut(rows.groupBy("lang").agg(F.count("*").alias("n")).withColumnRenamed("lang", "of"))
    per = F.broadcast(per) if per.count() <= BROADCAST_ROWS else per
    part = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000))
    return rows.join(per, F.col("lang") == F.col("of")).where(part < F.lit(1_000_000.0) * sample / F.col("n")).drop("of", "n")


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """labelled: doc_id, text, lang. One in ten of the sample, 300 a language at most, calibrates."""
    rows = labelled.where("lang is not null and text is not null")
    kept_out = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(10)) == 0
    chosen = _share(rows, sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(grams(symbols(text))[1:])
            for lang, parts in by.items():
                k, c = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "gram", "n"])

    counted = chosen.where(~kept_out).select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    counts = {}
    langs = np.array(counted.column("lang").to_pylist(), object)
    gram, n = counted.column("gram").to_numpy().view(np.uint64), counted.column("n").to_numpy()
    for lang in dict.fromkeys(langs):
        at = np.flatnonzero(langs == lang)
        at = at[np.argsort(gram[at])]
        counts[lang] = gram[at], n[at]
    model = Model(counts)
    model.calibrate([(r.text, r.lang) for r in _share(rows.where(kept_out), min(300, sample)).select("text", "lang").toLocalIterator()])
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected, cross_entropy (nats per character; null if there is no letter)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = [sent.value.judge(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([s[0] for s in seen], pa.string()), pa.array([s[1] for s in seen], pa.float64()), pa.array([s[2] for s in seen], pa.bool_()), pa.array([s[3] if s[5] else None for s in seen], pa.float64())],
                names=["doc_id", "lang_pred", "score", "rejected", "cross_entropy"],
            )

    rows = text_rows(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean, cross_entropy double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those that are not held out."""
    docs = read(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")
