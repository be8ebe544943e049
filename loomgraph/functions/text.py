"""Scalar functions over strings, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no claim.
STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "of", "to", "in", "on", "at",
    "for", "and", "or", "it", "its", "this", "that", "with", "by", "as", "from", "which", "can",
    "may", "will", "would", "should", "could",
)
# Names and patterns of secrets, in the order in which they are redacted.
SECRETS = (
    ("pem_private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|\z)"),
    ("aws_access_key_id", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{20,}\b"),
    ("github_pat", r"\bgithub_pat_[A-Za-z0-9_]{20,}\b"),
    ("api_key", r"\bsk-[A-Za-z0-9_-]{20,}\b"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"),
    ("authorization_header", r"""(?i)\bauthorization\s*[:=]\s*(?:bearer\s+|basic\s+|token\s+)?[^\s"',;]+"""),
    ("env_assignment", r"(?im)^[ \t]*(?:export[ \t]+)?[A-Z0-9_]*(?:KEY|SECRET|TOKEN|PASSWORD)[A-Z0-9_]*[ \t]*=[ \t]*[^\s#]+"),
    ("secret_literal", r"""(?i)\b[a-z0-9_]*(?:password|passwd|secret|api_?key|access_?token|private_?key)[a-z0-9_]*\s*[:=]\s*["'`][^"'`\s]{6,}["'`]"""),
)


def claim_tokens(text: Column) -> Column:
    """Sorted distinct words of a claim: quoted text is <lit>, numbers, line references and stop words go."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), r'"[^"]+"', " \u0001 ")
    s = F.lower(F.regexp_replace(F.regexp_replace(s, '"[^"]*$', " "), '"', " "))
    s = F.regexp_replace(s, r"(?<![\p{L}\p{N}_])line[^\p{L}\p{N}_\u0001]+[0-9]+(?![\p{L}\p{N}_])", " ")
    w = F.filter(F.split(s, r"[^\p{L}\p{N}_\u0001]+"), lambda x: (x != "") & ~x.rlike("^l?[0-9]+$") & ~x.isin(*STOP_WORDS))
    return F.sort_array(F.array_distinct(F.transform(w, lambda x: F.when(x == "\u0001", "<lit>").otherwise(x))))


def identifier_parts(text: Column) -> Column:
    """Lower-case parts of identifiers, at underscores and at case, digit and acronym boundaries."""
    s = F.regexp_replace(text, r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", "_")
    return F.transform(F.filter(F.split(s, r"[^\p{L}\p{N}]+"), lambda x: x != ""), lambda x: F.lower(x))


def word_tokens(text: Column) -> Column:
    """Sorted distinct lower-case runs of letters and digits."""
    return F.sort_array(F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The file's name without a test suffix, else without its last extension."""
    name = file_name(path)
    test = F.regexp_extract(name, r"^(.*?)\.(?:spec|test|e2e-spec)\.", 1)
    cut = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.when(name.rlike(r"\.(?:spec|test|e2e-spec)\."), test).otherwise(cut)


def directory(path: Column) -> Column:
    return F.regexp_replace(F.when(F.contains(path, F.lit("/")), path).otherwise(""), r"/[^/]*$", "")


def mirrored(test: Column, source: Column) -> Column:
    """Whether a test stands where one would look for the source's: beside it, under __tests__, or in test/ for src/."""
    t, s = directory(test), directory(source)
    rel = lambda d, p: F.when(d.rlike(f"^(?:{p})"), F.regexp_replace(d, f"^(?:{p})/*", ""))
    return (t == s) | (t == F.concat(s, F.lit("/__tests__"))) | ((s == "") & (t == "__tests__")) | F.coalesce(rel(s, "src") == rel(t, "tests|test"), F.lit(False))


def is_test_path(path: Column) -> Column:
    return path.rlike(r"\.(?:spec|test|e2e-spec)\.[^/]*$|(?:^|/)__tests__/")


def has_secret(text: Column) -> Column:
    any_ = F.lit(False)
    for _, p in SECRETS:
        any_ = any_ | text.rlike(p)
    return F.coalesce(any_, F.lit(False))


def redact(text: Column) -> Column:
    """Secrets replaced by their pattern's name and the first eight digits of their SHA-256, so that equal secrets stay equal."""
    for name, p in SECRETS:
        # A lambda's variable, so that each step's text is computed once.
        text = F.get(F.transform(F.array(text), _one_pattern(name, p)), F.lit(0))
    return text


def _one_pattern(name: str, p: str):
    return lambda t: F.when(t.rlike(p), _replaced(t, name, p)).otherwise(t)


def _replaced(text: Column, name: str, p: str) -> Column:
    pieces, found = F.split(text, p, -1), F.regexp_extract_all(text, F.lit(p), F.lit(0))
    mark = lambda m: F.when(m.isNull(), "").otherwise(F.concat(F.lit(f"«redacted:{name}:"), F.substring(F.sha2(m, 256), 1, 8), F.lit("»")))
    return F.array_join(F.zip_with(pieces, found, lambda a, m: F.concat(a, mark(m))), "")


def redact_remote(url: Column) -> Column:
    """A remote's address without credentials, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@", "$1"), r"[?#].*$", "")


def http_path(path: Column) -> Column:
    """A route with parameters as {}, one slash at a time, none at the end."""
    p = F.regexp_replace(path, r"[?#][\s\S]*$", "")
    p = F.regexp_replace(p, r"(?<=^|/)(?:[:*][^/]*|\{[^/]+\}|\[[^/]+\])(?=/|$)", "{}")
    p = F.regexp_replace(F.concat(F.lit("/"), p), "/+", "/")
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, "/$", ""))


def db_identifier(name: Column) -> Column:
    n = F.trim(name)
    quoted = F.concat(F.lit('"'), F.replace(F.substring(n, F.lit(2), F.length(n) - 2), F.lit('""'), F.lit('"')), F.lit('"'))
    return F.when(n.rlike('^"[\\s\\S]*"$') & (F.length(n) >= 2), quoted).otherwise(F.lower(n))


def package_name(spec: Column) -> Column:
    """A package's name without version and path; null if there is none."""
    s = F.trim(spec)
    scoped = F.regexp_extract(s, r"^(@[^/]+/[^/@]+)", 1)
    plain = F.regexp_extract(s, r"^(?:node:)?([^/@][^/@]*)", 1)
    return F.nullif(F.when(F.startswith(s, F.lit("@")), scoped).otherwise(plain), F.lit(""))


def is_env_name(name: Column) -> Column:
    return name.rlike("^[A-Za-z_][A-Za-z0-9_]*$")


def symbol_id(lang: Column, module: Column, qualified: Column, kind: Column, ordinal: Column | None = None) -> Column:
    """lang:module#qualified/kind[~ordinal]"""
    base = F.concat(lang, F.lit(":"), module, F.lit("#"), qualified, F.lit("/"), kind)
    return base if ordinal is None else F.when(ordinal > 0, F.concat(base, F.lit("~"), ordinal.cast("string"))).otherwise(base)


def parse_symbol_id(s: Column) -> Column:
    part = lambda i: F.regexp_extract(s, r"^([^:]+):([^#]*)#(.*)/([^/~]+)(?:~([0-9]+))?$", i)
    return F.when(s.rlike(r"^[^:]+:[^#]*#.*/[^/~]+(?:~[0-9]+)?$"), F.struct(part(1).alias("lang"), part(2).alias("module"), part(3).alias("qualified"), part(4).alias("kind"), F.coalesce(F.nullif(part(5), F.lit("")).cast("int"), F.lit(0)).alias("ordinal")))


def module_path(path: Column) -> Column:
    return F.regexp_replace(path, r"(?:\.d)?\.[A-Za-z0-9]+$", "")


def truncate(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def token_estimate(text: Column) -> Column:
    return F.floor((F.length(text) + 3) / 4).cast("long") + 8


def sql_access(sql: Column) -> Column:
    """read, write or null from the first keyword."""
    first = F.lower(F.regexp_extract(sql, r"^\s*([A-Za-z]+)", 1))
    return F.when(first.isin("select", "with"), "read").when(first.isin("insert", "update", "delete", "merge", "truncate", "upsert", "replace"), "write")


def shingle_hashes(tokens: Column, k: int = 3) -> Column:
    """Sorted distinct hashes (28 bits of md5) of runs of k tokens; one for a shorter list."""
    h = lambda x: F.conv(F.substring(F.md5(F.array_join(x, " ")), 1, 7), 16, 10).cast("long")

    def of(t: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (k - 1), F.lit(1))), lambda i: h(F.slice(t, i, k)))
        return F.when(F.size(t) == 0, F.array().cast("array<bigint>")).otherwise(F.sort_array(F.array_distinct(many)))

    return F.transform(F.array(tokens), of)[0]  # the tokens are computed once


def content_hash(*parts: Column) -> Column:
    """Digest of parts, each with its length in front, so that no two lists run together."""
    return F.sha2(F.concat(*(F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts)), 256)


def point_id(*parts: Column) -> Column:
    """A stable id in the shape of a UUID."""
    h = F.md5(F.concat_ws("/", *parts))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def retry_after(value: Column, now: Column) -> Column:
    """Seconds from a number or an HTTP date, at least 0; null if neither."""
    date = F.try_to_timestamp(F.regexp_replace(value, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.coalesce(F.when(F.trim(value).rlike("^[0-9]+$"), F.trim(value).try_cast("bigint")), F.when(date.isNotNull(), F.greatest(F.unix_timestamp(date) - F.unix_timestamp(now), F.lit(0).cast("bigint"))))


def line_count(text: Column) -> Column:
    """Lines of a text; a newline at the end begins none."""
    return F.when(F.length(text) == 0, 0).otherwise(F.size(F.split(text, "\n")) - F.when(F.endswith(text, F.lit("\n")), 1).otherwise(0)).cast("long")


def is_trivia(line: Column) -> Column:
    """Blank, or the look of a comment."""
    t = F.trim(F.regexp_replace(line, r"[\t\r]", " "))
    return (t == "") | t.rlike(r"^(?://|/\*|\*|#|<!--)")


def summary(name: Column, callers: Column, callees: Column, top: int = 3) -> Column:
    """One sentence about a symbol with the first of its neighbours by name."""
    some = lambda a: F.array_join(F.slice(F.sort_array(a), 1, top), ", ")
    return F.concat(name, F.lit(". Called by: "), some(callers), F.lit(". Calls: "), some(callees), F.lit("."))
