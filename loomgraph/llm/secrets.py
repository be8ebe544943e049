"""Secret scan by assignment-aware lexing.

Three base rules find their kinds wherever they stand. The method adds to them. A lexer goes once over the text and knows
comments (`#`, `//`, `/* */`, `<!-- -->`), braces, elements (`<name>literal</name>`) and assignments (`name = literal`,
`name: literal`, `"name": "literal"`, `name := literal`, `name => literal`, `name += literal`, `export NAME=x`); a comparison
(`==`, `!=`, `<=`, `>=`) is none. So it reads source and configuration syntax into name-literal pairs. A literal that a name
was bound to is carried to later uses of that name (`b = a`, `${a}`, `"x" + a`), within the braces in which it was bound and
in those inside them; what comments bind holds in the comment alone. Each literal is scored by how sensitive the name it
ends up under is and by its own shape, and literals that score enough become spans of kind `literal`. The pieces of a
concatenation, over line ends too, are scored each and joined; what passes joined gives a span for each of its pieces, and
the name carries them all.

Defined cases: a null or empty text has no spans; equal spans of different kinds stay apart; repeated rows are judged
each on their own; a literal counts once in a joined value, whatever the number of its uses; a closing brace without an open
one is nothing; an empty table gives no rows; other columns play no part. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import read, text_rows

KINDS = ("assign", "access", "hex", "literal")
THRESHOLD = 2.0
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Comments, braces, elements, or a name, an operator of assignment and a quoted literal or a bare one up to a separator, with what is added to it.
_TOKEN = re.compile(
    r"""(?P<comment>(?:(?<![^\s;])\#|(?<![:\w])//)[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/)?|<!--(?:[^-]|-(?!->))*+(?:-->)?)
    |(?P<open>\{)|(?P<close>\})
    |<(?P<tag>[A-Za-z_][A-Za-z0-9_.-]*+)(?:[\x20\t][^<>\n]*+)?>(?P<inner>[^<>\n]++)(?=</)
    |(?<![A-Za-z0-9_.$-])["']?(?P<name>[A-Za-z_][A-Za-z0-9_.-]*+)["']?[\x20\t]*+(?P<op>:=|=>|\+=|=(?![=~])|:(?![/:]))[\x20\t]*+
      (?:"(?P<double>[^"\n\\]*+(?:\\.[^"\n\\]*+)*+)"|'(?P<single>[^'\n\\]*+(?:\\.[^'\n\\]*+)*+)'|`(?P<back>[^`\n]*+)`|(?P<bare>\$\{[A-Za-z_][A-Za-z0-9_.]*+\}|[^\s"'`,;(){}\[\]<>]++))
      (?P<more>(?:\s*+\+\s*+(?:"[^"\n]*+"|'[^'\n]*+'|[A-Za-z_][A-Za-z0-9_.]*+))*+)""",
    re.A | re.X,
)
_PART = re.compile(r"""["']([^"'\n]*)["']|([A-Za-z_][A-Za-z0-9_.]*)""", re.A)
_REFERENCE = re.compile(r"^(?:\$\{?|%|#\{|\{\{\s*)?([A-Za-z_][A-Za-z0-9_.]*)(?:\}|%|\}\})?$", re.A)
#: Weights of the parts of a name.
NAME_WEIGHTS = {"password": 2.0, "passwd": 2.0, "passphrase": 2.0, "pwd": 1.6, "pass": 1.2, "secret": 2.0, "token": 1.7, "apikey": 2.0, "credential": 1.7, "credentials": 1.7, "auth": 1.0, "authorization": 1.3, "private": 0.8, "access": 0.6, "api": 0.6, "key": 0.8, "salt": 0.7, "signature": 0.7, "bearer": 1.3, "client": 0.2}
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", re.A)
_EMPTY = re.compile(r"^(?:none|null|nil|true|false|undefined|changeme|example|placeholder|your[_-].*|x+|\*+|\.+|<.*>|todo|test|password|secret|token)$", re.I)


def name_score(name: str) -> float:
    parts = [p.lower() for p in _WORDS.findall(name)]
    joined = "".join(parts)
    return max([sum(NAME_WEIGHTS.get(p, 0.0) for p in dict.fromkeys(parts)), *(NAME_WEIGHTS[k] for k in ("apikey", "password", "passwd") if k in joined)])


def literal_score(value: str) -> float:
    """From -3 for what cannot be a secret to about 1.5 for long, mixed, high-entropy values."""
    if len(value) < 6 or _EMPTY.match(value) or " " in value.strip() and len(value.split()) > 3:
        return -3.0
    counts = Counter(value)
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    classes = sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(bits / 4.0, 1.0) + 0.25 * (classes - 1) - (0.7 if classes == 1 else 0.0)


def pairs(text: str, start: int = 0, end: int | None = None) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """Name and the pieces of its value, literals and where they stand, constants carried along: each piece, then all if joined."""
    scopes: list[dict[str, list[tuple[str, int, int]]]] = [{}]

    def known(name: str) -> list[tuple[str, int, int]] | None:
        return next((s[name] for s in reversed(scopes) if name in s), None)

    for m in _TOKEN.finditer(text, start, len(text) if end is None else end):
        if m["comment"] is not None:
            if m.start() > start or end is None:  # else it is the comment that is being read
                yield from pairs(text, m.start() + 1, m.end())
        elif m["open"]:
            scopes.append({})
        elif m["close"]:
            if len(scopes) > 1:
                scopes.pop()
        elif m["tag"]:
            yield m["tag"], [(m["inner"], *m.span("inner"))]
        else:
            name = m["name"]
            kind = next(k for k in ("double", "single", "back", "bare") if m[k] is not None)
            value = m[kind]
            ref = _REFERENCE.match(value) if kind == "bare" or value[:1] in "$%#{" else None
            carried = known(ref[1]) if ref else None
            first = carried or [(value, *m.span(kind))]
            # A bare word before a plus is a name of which nothing is known: it is no part of what is joined.
            joined = [] if ref and carried is None and m["more"] else list(first)
            if m["op"] == "+=":
                joined = [*(known(name) or []), *joined]
            yield name, first
            for p in _PART.finditer(text, *m.span("more")):
                piece = [(p[1], *p.span(1))] if p[1] is not None else known(p[2])
                if piece:
                    joined += piece
                    yield name, piece
            scopes[-1][name] = list(dict.fromkeys(joined)) or first
            if len(scopes[-1][name]) > 1:
                yield name, scopes[-1][name]


def spans_of(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    """All spans by start, then kind as listed."""
    if not text:
        return []
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if "=" in text or ":" in text or "</" in text:
        sensitive = ((n, some) for name, pieces in pairs(text) if (n := name_score(name)) >= 1.0 for some in (pieces, *([p] for p in pieces if len(pieces) > 1)))
        extra = {(start, end) for n, some in sensitive if n + literal_score("".join(p[0] for p in some)) >= threshold for _, start, end in some if end > start}
        found += [("literal", s, e) for s, e in extra]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and spans: array of kind, start and end, by start, then kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t, threshold)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "spans"])

    rows = text_rows(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind: string, start: long, end: long>>")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and all spans of all documents, null texts as empty."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    found = scan_secrets(read(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(F.filter("spans", lambda s: s.kind != "literal")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), n("literal"))
