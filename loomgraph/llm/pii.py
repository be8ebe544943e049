"""Personal data: candidate spans scored by boosted trees, by DataFrame functions only.

Four base rules find e-mail addresses, IP addresses, card and phone numbers. High-recall generators propose further,
overlapping spans (written-out addresses, local phone numbers, identity and account numbers, long numbers) and, to learn
from, numbers that are no personal data (short ones, versions). Every candidate has discrete features of its format and of
its context: the words before it, and how many other kinds of validated personal data its text holds.

Labels come from what can be validated: a candidate is positive if its format proves itself (octets, digits, Luhn,
the checks of identity and account numbers), negative if it cannot be personal data (impossible octets or digits, failing
identity and account checks, short numbers, versions), else unlabelled. A number of a card's length that fails Luhn
is unlabelled: it may hold a slip or be another number of a person. Boosted trees of depth 2 are fitted to the labelled
candidates of three documents in four, on the table of distinct feature vectors with their counts, whose size is bounded by
the product of the features' levels, whatever the input. They never see what a check found, so unlabelled candidates are
judged by format and context alone. The trees are scored as nested CASE expressions; the least score from which on the
labelled candidates of the other documents are positive with `PRECISION` selects the spans that are added. Base spans always
stay, and added ones overlap neither them nor each other.

Positions come from the pieces between matches (split) and the matches (regexp_extract_all), both of one pattern, by sums over
blocks of matches. Patterns are possessive and start only where a run starts, so they take linear time on long runs.

Defined cases: a null or empty text has no spans; without labelled candidates of both kinds, for training or for the
threshold, nothing is added; repeated rows are judged each on their own; equal scores prefer the earlier span; an empty table
gives no rows; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, read
from loomgraph.llm.quality import let

BASE = ("email", "ip", "card", "phone")
EXTRA = ("email_words", "phone_local", "identity", "account")
#: Candidates to learn from, never added.
NOISE = ("short", "version")
#: The name of an added span that is a card's candidate.
LONG_NUMBER = "number"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "email_words": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\(\[]at[\)\]] ?[A-Za-z0-9-]{1,64}+(?: ?[\(\[]dot[\)\]] ?[A-Za-z0-9-]{1,64}+){1,4}+",
    "phone_local": r"(?<![0-9+.-])\(?[0-9]{2,5}\)?[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9])",
    "identity": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "short": r"(?<![A-Za-z0-9.+-])[0-9]{1,6}+(?![A-Za-z0-9@-]|\.[0-9])",
    "version": r"(?<![A-Za-z0-9.])[0-9]++(?:\.[0-9]++){1,2}+(?![A-Za-z0-9@]|\.[0-9])",
}
#: A cheap test that a text can hold a match at all.
MAY = {
    "email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9]",
    "email_words": r"[\(\[]at[\)\]]", "phone_local": r"[0-9]\)?[ .-][0-9]{2,4}[ .-][0-9]", "identity": r"[0-9]{3}-[0-9]{2}-[0-9]", "account": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]", "short": "[0-9]", "version": r"[0-9]\.[0-9]",
}
#: Words before a span that speak for a kind.
CUES = {"contact": r"(?i)(?:mail|phone|tel|call|fax|mobile|contact|reach)", "number": r"(?i)(?:card|visa|account|iban|ssn|social|passport|id|no\.?|number)\W{0,3}$", "noise": r"(?i)(?:version|page|isbn|order|item|ref|line|v)\W{0,3}$"}
CONTEXT = 32
ROUNDS, RATE, PRECISION = 24, 0.3, 0.9
#: One document in so many sets the threshold and is not trained on.
FOLDS = 4


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check."""

    def worth(i: Column, r: Column) -> Column:
        d = F.try_to_number(F.substr(r, i, F.lit(1)), F.lit("9")).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return let(F.reverse(number), lambda r: F.aggregate(F.sequence(F.lit(1), F.length(r)), F.lit(0), lambda a, i: a + worth(i, r)) % 10 == 0)


CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False))),
    "card": lambda m: let(digits(m), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False))),
    "phone": lambda m: F.length(digits(m)).between(8, 15),
}


def mod97(s: Column) -> Column:
    """An account number (letters as two digits, its first four characters last) modulo 97."""
    turned = F.regexp_replace(s, " ", "")
    turned = F.concat(F.substr(turned, F.lit(5)), F.substr(turned, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.when(value(c) > 9, a * 100 + value(c)).otherwise(a * 10 + value(c)) % 97)


#: Whether a candidate is personal data, null where its format cannot tell. Kinds of BASE have CHECKS.
LABELS: dict[str, Callable[[Column], Column]] = {
    "email_words": lambda m: F.lit(None).cast("boolean"),
    "phone_local": lambda m: F.lit(None).cast("boolean"),
    "identity": lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"),
    "account": lambda m: mod97(m) == 1,
    "short": lambda m: F.lit(False),
    "version": lambda m: F.lit(False),
}


def label(kind: str, m: Column) -> Column:
    if kind == "card":
        return F.when(CHECKS[kind](m), True).when(~F.length(digits(m)).between(16, 19), False)
    return CHECKS[kind](m) if kind in CHECKS else LABELS[kind](m)


def ends(sizes: Column) -> Column:
    """Running sums of an array of whole numbers, by blocks: n to the power 1.5 steps, and nothing is appended one by one."""

    def by_block(x: Column, width: Column) -> Column:
        total = lambda part: F.aggregate(part, F.lit(0), lambda a, v: a + v)
        before = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / width).cast("int")), lambda b: total(F.slice(x, 1, b * width)))
        return let(before, lambda p: F.transform(x, lambda v, i: F.get(p, F.floor(i / width).cast("int")) + total(F.slice(x, F.floor(i / width).cast("int") * width + 1, i % width + 1))))

    return let(sizes, lambda x: let(F.ceil(F.sqrt(F.size(x))).cast("int"), lambda w: by_block(x, w)))


def matches(text: Column, kind: str) -> Column:
    """Array of start, end (exclusive, code points), match and the characters before it, in order."""
    empty = F.array().cast("array<struct<start:int,end:int,m:string,before:string>>")

    def place(pieces: Column, found: Column) -> Column:
        one = lambda m, i, e: F.struct((F.get(e, i) - F.length(m)).alias("start"), F.get(e, i).alias("end"), m.alias("m"), F.right(F.get(pieces, i), F.lit(CONTEXT)).alias("before"))
        return let(ends(F.transform(found, lambda m, i: F.length(F.get(pieces, i)) + F.length(m))), lambda e: F.transform(found, lambda m, i: one(m, i, e)))

    whole = let(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), lambda f: F.when(F.size(f) > 0, let(F.split(text, PATTERNS[kind], -1), lambda p: place(p, f))).otherwise(empty))
    return F.when(F.contains(text, F.lit("@")) if kind == "email" else text.rlike(MAY[kind]), whole).otherwise(empty)


FEATURES = ("n_digits", "length", "separators", "dots", "at", "plus", "letters", "contact", "number", "noise", "company")


def featured(kind: str, x: Column) -> Column:
    """A candidate: kind, place, whether it is a base span, its label (null if there is none) and the discrete features but company."""
    n = F.length(digits(x.m))
    without = lambda c: F.length(x.m) - F.length(F.regexp_replace(x.m, c, ""))
    letters = without("[A-Za-z]")
    return F.struct(
        F.lit(kind).alias("name"), x.start.alias("start"), x.end.alias("end"),
        (CHECKS[kind](x.m) if kind in CHECKS else F.lit(False)).alias("passes"), label(kind, x.m).alias("good"),
        F.when(n == 0, 0).when(n < 4, 1).when(n < 8, 2).when(n < 12, 3).when(n < 16, 4).when(n < 20, 5).otherwise(6).alias("n_digits"),
        F.least(F.floor(F.length(x.m) / 6), F.lit(7)).cast("int").alias("length"),
        F.least(without(r"[ ()\[\]-]"), F.lit(5)).alias("separators"), F.least(without(r"\."), F.lit(4)).alias("dots"),
        F.contains(x.m, F.lit("@")).cast("int").alias("at"), F.startswith(x.m, F.lit("+")).cast("int").alias("plus"),
        F.when(letters == 0, 0).when(letters <= 2, 1).when(letters <= 8, 2).otherwise(3).alias("letters"),
        *(x.before.rlike(p).cast("int").alias(c) for c, p in CUES.items()),
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fold, and an array of candidates for each kind. Candidates that are numbers of under 12 digits are no cards."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    one = lambda k: F.transform(matches(F.col("t"), k), lambda x: featured(k, x))
    out = rows.select("doc_id", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).alias("fold"), *(one(k).alias(k) for k in BASE + EXTRA + NOISE))
    out = out.withColumn("card", F.filter("card", lambda x: x.n_digits >= 4))
    has = {k: F.exists(k, lambda x: x.passes).cast("int") for k in BASE}
    company = lambda k: F.least(sum((has[o] for o in BASE if o != k), F.lit(0)), F.lit(3))
    accompanied = lambda k: F.transform(k, lambda x: x.withField("company", company(k))).alias(k)
    return out.select("doc_id", "fold", *map(accompanied, BASE + EXTRA + NOISE))


class Trees:
    """Boosted trees of depth 2 over integer features, by the counts of distinct vectors."""

    def __init__(self, table: list[tuple[tuple[int, ...], float, float]]):
        """table: vector, weight of positives, weight of all."""
        total, good = sum(w for *_, w in table), sum(p for _, p, _ in table)
        rate = (good + 1) / (total + 2)
        self.prior, self.trees, self.threshold = math.log(rate / (1 - rate)), [], 2.0
        score = [self.prior] * len(table)
        splits = sorted({(f, v) for x, _, _ in table for f, v in enumerate(x)})
        for _ in range(ROUNDS if table else 0):
            grads = [(p - w / (1 + math.exp(-s)), w * (q := 1 / (1 + math.exp(-s))) * (1 - q)) for (_, p, w), s in zip(table, score, strict=True)]
            root = self._best(range(len(table)), table, grads, splits)
            if root is None:
                break
            sides = [[i for i in range(len(table)) if (table[i][0][root[0]] <= root[1]) == left] for left in (True, False)]
            tree = (root, [])
            for side in sides:
                s = self._best(side, table, grads, splits)
                parts = [side] if s is None else [[i for i in side if (table[i][0][s[0]] <= s[1]) == left] for left in (True, False)]
                leaves = [RATE * sum(grads[i][0] for i in p) / (sum(grads[i][1] for i in p) + 1.0) for p in parts]
                tree[1].append((s, leaves))
                for p, leaf in zip(parts, leaves, strict=True):
                    for i in p:
                        score[i] += leaf
            self.trees.append(tree)

    def calibrate(self, table: list[tuple[tuple[int, ...], float, float]]) -> None:
        """The least score from which on the vectors of table are positive with PRECISION (by Laplace's rule); none if there is no such."""
        by: dict[float, list[float]] = {}
        for x, pos, all_ in table:
            sums = by.setdefault(round(self.probability(x), 12), [0.0, 0.0])
            sums[0] += pos
            sums[1] += all_
        self.threshold = 2.0
        p = w = 0.0
        for s, (pos, all_) in sorted(by.items(), reverse=True):
            p, w = p + pos, w + all_
            if (p + 1) / (w + 2) >= PRECISION and w > p - 1 and any(y < a for _, y, a in table):
                self.threshold = s - 1e-9

    def probability(self, x: tuple[int, ...]) -> float:
        total = self.prior
        for root, sides in self.trees:
            split, leaves = sides[0 if x[root[0]] <= root[1] else 1]
            total += leaves[0 if split is None or x[split[0]] <= split[1] else 1]
        return 1 / (1 + math.exp(-total))

    @staticmethod
    def _best(rows, table, grads, splits):
        rows = list(rows)
        g, h = sum(grads[i][0] for i in rows), sum(grads[i][1] for i in rows)
        best, gain = None, 1e-6
        sums: dict[tuple[int, int], list[float]] = {}
        for i in rows:
            for f, v in enumerate(table[i][0]):
                s = sums.setdefault((f, v), [0.0, 0.0])
                s[0] += grads[i][0]
                s[1] += grads[i][1]
        feature, gl, hl = None, 0.0, 0.0
        for f, v in splits:
            if f != feature:
                feature, gl, hl = f, 0.0, 0.0
            a, b = sums.get((f, v), (0.0, 0.0))
            gl, hl = gl + a, hl + b
            now = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if now > gain:
                best, gain = (f, v), now
        return best

    def score(self, x: Column) -> Column:
        """The probability, as a Column over a struct with the features."""
        test = lambda s: x[FEATURES[s[0]]] <= s[1]
        side = lambda s, leaves: F.lit(leaves[0]) if s is None else F.when(test(s), leaves[0]).otherwise(leaves[1])
        total = F.lit(self.prior)
        for root, (left, right) in self.trees:
            total = total + F.when(test(root), side(*left)).otherwise(side(*right))
        return 1 / (1 + F.exp(-total))


def fit(found: DataFrame) -> Trees:
    """Trees from the labelled candidates; what comes to the driver is one row a distinct vector and side of the split."""
    rows = found.select((F.col("fold") == 0).alias("kept_out"), F.explode(F.concat(*BASE, *EXTRA, *NOISE)).alias("x")).where("x.good is not null")
    table = rows.groupBy("kept_out", *(F.col(f"x.{f}").alias(f) for f in FEATURES)).agg(F.sum(F.col("x.good").cast("double")).alias("p"), F.count("*").cast("double").alias("w"))
    sides: tuple[list, list] = ([], [])
    for r in table.collect():
        sides[r.kept_out].append((tuple(int(r[f]) for f in FEATURES), r.p, r.w))
    trees = Trees(sorted(sides[0]))
    if 0 < sum(p for _, p, _ in sides[0]) < sum(w for *_, w in sides[0]):
        trees.calibrate(sorted(sides[1]))
    return trees


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and added: arrays of name, start and end, by kind as listed, then start."""
    found = cut(candidates(docs, id_col, text_col))
    trees = fit(found)
    plain = lambda x: F.struct(x["name"].alias("name"), x.start.alias("start"), x.end.alias("end"))
    found = found.withColumn("base", F.transform(F.filter(F.concat(*BASE), lambda x: x.passes), plain))
    meet = lambda a, b: (a.start < b.end) & (b.start < a.end)
    # What a check has refuted is not added, however it scores.
    more = F.filter(F.concat("card", *EXTRA), lambda x: ~x.passes & F.coalesce(x.good, F.lit(True)))
    name = lambda x: F.when(x["name"] == "card", LONG_NUMBER).otherwise(x["name"])
    scored = F.transform(more, lambda x: F.struct(name(x).alias("name"), x.start.alias("start"), x.end.alias("end"), trees.score(x).alias("p")))
    found = found.withColumn("scored", F.when(F.size(F.concat("card", *EXTRA)) > 0, scored).otherwise(F.array().cast("array<struct<name:string,start:int,end:int,p:double>>")))
    found = found.withColumn("scored", F.filter("scored", lambda x: (x.p >= trees.threshold) & ~F.exists("base", lambda b: meet(x, b))))
    best = F.filter("scored", lambda x: ~F.exists("scored", lambda y: meet(x, y) & ((y.p > x.p) | ((y.p == x.p) & ((y.start < x.start) | ((y.start == x.start) & ((y.end > x.end) | ((y.end == x.end) & (y["name"] < x["name"])))))))))
    order = F.array(*map(F.lit, (*EXTRA, LONG_NUMBER)))
    added = F.transform(F.array_sort(F.transform(best, lambda x: F.struct(F.array_position(order, x["name"]).alias("k"), x.start.alias("start"), x.end.alias("end"), x["name"].alias("name")))), plain)
    return found.select("doc_id", "base", added.alias("added"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and all spans of all documents, null texts as empty."""
    found = find_pii(read(spark, sf_dir, "documents"))
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["name"], x.start, x.end)), ",")
    n = lambda k: F.size(F.filter("base", lambda x: x["name"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(n(k) for k in BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
