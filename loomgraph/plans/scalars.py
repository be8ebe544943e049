"""Queries of scalar functions, over texts and numbers of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import numbers as N
from loomgraph.functions import text as X
from loomgraph.operators import aggregates as A
from loomgraph.operators import text_units as T
from loomgraph.plans.catalog import query, table

# Paths, names and addresses made from the tables, the same in Spark and in SQL.
_PATH = "concat(case when p_partkey % 5 = 0 then 'src/' when p_partkey % 5 = 1 then 'test/' when p_partkey % 5 = 2 then 'src/a/__tests__/' else '' end, replace(p_type, ' ', '/'), '/', replace(p_brand, '#', ''), case p_partkey % 4 when 0 then '.service.ts' when 1 then '.spec.ts' when 2 then '.d.ts' else '' end)"


def paths(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey", f"{_PATH} as path", "p_name", "p_brand")


PATHS = f"(select p_partkey, {_PATH} as path, p_name, p_brand from part)"


def _each(name, source, key, exprs, sql_from, sql_exprs):
    def run(spark, sf):
        return source(spark, sf).select(key, *(c.alias(n) for n, c in exprs().items()))

    query(name, f"select {key}, " + ", ".join(f"{e} as {n}" for n, e in sql_exprs.items()) + f" from {sql_from}")(run)


c = F.col
docs = lambda spark, sf: table(spark, sf, "documents")
talk = lambda spark, sf: table(spark, sf, "conversations").withColumn("k", F.concat_ws(":", "conv_id", "turn"))
TALK = "(select *, concat_ws(':', conv_id, turn) as k from conversations)"
_W = r"[^\p{L}\p{N}]+"

_each(
    "x1_claim_tokens", talk, "k", lambda: {"tokens": F.array_join(X.claim_tokens(c("text")), " ")}, TALK,
    {"tokens": "array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split_regex(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\"[^\"]+\"', ' \x01 ', 'g'), '\"[^\"]*$', ' '), '\"', ' ', 'g')), '(^|[^\\p{L}\\p{N}_])line[^\\p{L}\\p{N}_\x01]+[0-9]+', '\\1 ', 'g'), '[^\\p{L}\\p{N}_\x01]+'), lambda x: x <> '' and not regexp_full_match(x, 'l?[0-9]+') and x not in (" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + ")), lambda x: case when x = '\x01' then '<lit>' else x end))), ' ')"},
)
_each(
    "x2_identifier_parts", lambda s, d: paths(s, d).withColumn("i", F.concat(F.initcap(F.lit("http")), F.replace(F.initcap("p_name"), F.lit(" ")), F.lit("XMLFile"), c("p_partkey"))), "p_partkey",
    lambda: {"parts": F.array_join(X.identifier_parts(c("i")), " ")}, "(select p_partkey, concat('Http', array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ''), 'XMLFile', p_partkey) as i from part)",
    {"parts": r"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(i, '[^\p{L}\p{N}]+', ' ', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g'), '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '(\p{L})(\p{N})', '\1 \2', 'g'), '(\p{N})(\p{L})', '\1 \2', 'g')))"},
)
_each("x3_word_tokens", docs, "doc_id", lambda: {"tokens": F.array_join(X.word_tokens(c("text")), " ")}, "documents", {"tokens": rf"array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(text), '{_W}'), lambda x: x <> ''))), ' ')"})
_each(
    "x4_stem_and_directory", paths, "p_partkey", lambda: {"stem": X.stem(c("path")), "dir": X.directory(c("path")), "is_test": X.is_test_path(c("path")), "mirrors": X.mirrored(c("path"), F.regexp_replace("path", "^test/", "src/"))}, PATHS,
    {"stem": r"case when regexp_matches(string_split(path, '/')[-1], '\.(spec|test|e2e-spec)\.') then regexp_extract(string_split(path, '/')[-1], '^(.*?)\.(spec|test|e2e-spec)\.', 1) else regexp_replace(string_split(path, '/')[-1], '\.[^.]*$', '') end", "dir": "regexp_replace(case when contains(path, '/') then path else '' end, '/[^/]*$', '')", "is_test": r"regexp_matches(path, '\.(spec|test|e2e-spec)\.[^/]*$|(^|/)__tests__/')", "mirrors": "true"},
)
_each(
    "x5_redact", lambda s, d: docs(s, d).withColumn("t", F.concat("text", F.lit('\napi_key = "'), F.md5("text"), F.lit('" # x'))), "doc_id", lambda: {"redacted": F.md5(X.redact(c("t"))), "has_secret": X.has_secret(c("t"))}, "documents",
    {"redacted": """md5(text || chr(10) || '«redacted:env_assignment:' || substr(sha256('api_key = "' || md5(text) || '"'), 1, 8) || '» # x')""", "has_secret": "text is not null"},
)
_each("x6_redact_remote", lambda s, d: table(s, d, "pages").withColumn("u", F.concat(F.regexp_replace("url", "://", "://user:pw@"), F.lit("?q=1#x"))), "page_id", lambda: {"remote": X.redact_remote(c("u"))}, "pages", {"remote": "regexp_replace(regexp_replace(concat(regexp_replace(url, '://', '://user:pw@'), '?q=1#x'), '^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@', '\\1'), '[?#].*$', '')"})
_each("x7_http_path", lambda s, d: paths(s, d).withColumn("r", F.concat(F.lit("users/:id//{x}/"), c("path"), F.lit("/[slug]/*rest/?q=1"))), "p_partkey", lambda: {"route": X.http_path(c("r"))}, PATHS, {"route": "'/' || 'users/{}/{}/' || path || '/{}/{}'"})
_each(
    "x8_database_and_package_names", lambda s, d: paths(s, d).withColumn("q", F.when(c("p_partkey") % 2 == 0, F.concat(F.lit(' "'), c("p_name"), F.lit('" '))).otherwise(c("p_name"))).withColumn("s", F.concat(F.when(c("p_partkey") % 3 == 0, "@scope/").otherwise(""), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("@1.2/lib"))), "p_partkey",
    lambda: {"ident": X.db_identifier(c("q")), "package": X.package_name(c("s")), "env": X.is_env_name(F.replace("p_name", F.lit(" "), F.lit("_")))}, "part",
    {"ident": "case when p_partkey % 2 = 0 then '\"' || p_name || '\"' else lower(trim(p_name)) end", "package": "case when p_partkey % 3 = 0 then '@scope/' else '' end || replace(p_brand, '#', '-')", "env": "regexp_full_match(replace(p_name, ' ', '_'), '[A-Za-z_][A-Za-z0-9_]*')"},
)
_each(
    "x9_symbol_id", lambda s, d: paths(s, d).withColumn("sid", X.symbol_id(F.lit("ts"), X.module_path(c("path")), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("method"), c("p_partkey") % 3)).withColumn("p", X.parse_symbol_id(c("sid"))), "p_partkey",
    lambda: {"sid": c("sid"), "module": c("p.module"), "ordinal": c("p.ordinal")}, PATHS,
    {"sid": r"'ts:' || regexp_replace(path, '(\.d)?\.[A-Za-z0-9]+$', '') || '#' || replace(p_name, ' ', '.') || '/method' || case when p_partkey % 3 > 0 then '~' || (p_partkey % 3) else '' end", "module": r"regexp_replace(path, '(\.d)?\.[A-Za-z0-9]+$', '')", "ordinal": "cast(p_partkey % 3 as int)"},
)
query("x10_module_path", rf"with m as (select p_partkey, regexp_replace(path, '(\.d)?\.[A-Za-z0-9]+$', '') as module from {PATHS}) select p_partkey, module, count(*) over (partition by module) > 1 as collides from m")(
    lambda s, d: A.collisions(paths(s, d).select("p_partkey", X.module_path(c("path")).alias("module")), "module")
)
_each("x11_truncate", docs, "doc_id", lambda: {"head": X.truncate(c("text"), 80)}, "documents", {"head": "substr(text, 1, 80)"})
_each("x12_collapse_spaces", docs, "doc_id", lambda: {"md5": F.md5(X.collapse(c("text")))}, "documents", {"md5": r"md5(trim(regexp_replace(text, '\s+', ' ', 'g')))"})
_each("x13_token_estimate", docs, "doc_id", lambda: {"tokens": X.token_estimate(c("text"))}, "documents", {"tokens": "(length(text) + 3) // 4 + 8"})
_each(
    "x14_sql_access", lambda s, d: table(s, d, "part").withColumn("q", F.concat(F.element_at(F.array(*map(F.lit, ("select ", " INSERT into ", "update ", "with x ", "explain "))), (c("p_partkey") % 5 + 1).cast("int")), c("p_name"))), "p_partkey", lambda: {"access": X.sql_access(c("q"))}, "part",
    {"access": "case p_partkey % 5 when 0 then 'read' when 1 then 'write' when 2 then 'write' when 3 then 'read' end"},
)
_each(
    "x15_shingle_hashes", docs, "doc_id", lambda: {"shingles": F.md5(F.array_join(X.shingle_hashes(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")), ","))}, "(select doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') as t from documents)",
    {"shingles": "md5(array_to_string(case when len(t) = 0 then [] else list_sort(list_distinct(list_transform(range(1, greatest(len(t) - 2, 1) + 1), lambda i: ('0x' || substr(md5(array_to_string(t[i:i+2], ' ')), 1, 7))::bigint))) end, ','))"},
)
_each("x16_content_hash", docs, "doc_id", lambda: {"hash": X.content_hash(F.lit("doc"), F.lit("3"), c("text"))}, "documents", {"hash": "sha256('3:doc1:3' || length(text) || ':' || text)"})
_each("x17_input_hash", docs, "doc_id", lambda: {"hash": X.content_hash(c("source"), c("lang"), c("n_chars").cast("string"))}, "documents", {"hash": "sha256(length(source) || ':' || source || length(lang) || ':' || lang || length(n_chars::varchar) || ':' || n_chars)"})
query("x18_fingerprint", "select source, sha256(string_agg(md5(text), ',' order by doc_id)) as fingerprint from documents group by 1")(
    lambda s, d: docs(s, d).groupBy("source").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", F.md5("text").alias("h")))), lambda x: x.h), ","), 256).alias("fingerprint"))
)
_each("x19_point_id", docs, "doc_id", lambda: {"point": X.point_id(c("source"), c("doc_id").cast("string"))}, "(select doc_id, md5(source || '/' || doc_id) as h from documents)", {"point": "substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21,12)"})
query("x20_sections", """with l as (select doc_id, no, line from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as no from documents)),
h as (select *, case when length(line) < 40 and line <> '' then line end as head from l),
s as (select *, last_value(head ignore nulls) over (partition by doc_id order by no) as section from h)
select doc_id, section, count(*) as n_lines, min(no)::int as first_line from s group by 1, 2""")(
    lambda s, d: T.sections(docs(s, d), "doc_id", "text", lambda line: (F.length(line) < 40) & (line != ""))
)
_each(
    "x21_summary", lambda s, d: table(s, d, "nation").join(table(s, d, "customer"), c("n_nationkey") == c("c_nationkey")).groupBy("n_nationkey", "n_name").agg(F.collect_set("c_mktsegment").alias("a"), F.collect_set("c_mktsegment").alias("b")), "n_nationkey",
    lambda: {"summary": X.summary(c("n_name"), c("a"), c("b"))}, "(select n_nationkey, n_name, array_to_string(list_sort(list(distinct c_mktsegment))[1:3], ', ') as a from nation join customer on n_nationkey = c_nationkey group by 1, 2)", {"summary": "n_name || '. Called by: ' || a || '. Calls: ' || a || '.'"},
)
_each(
    "x22_retry_after", lambda s, d: table(s, d, "events").withColumn("v", F.when(c("event_id") % 3 == 0, (c("event_id") % 100).cast("string")).when(c("event_id") % 3 == 1, F.concat(F.lit("Mon, "), F.date_format("ts", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise("soon")), "event_id",
    lambda: {"seconds": X.retry_after(c("v"), F.lit("2024-01-15 00:00:00").cast("timestamp"))}, "events", {"seconds": "case event_id % 3 when 0 then event_id % 100 when 1 then greatest(epoch(date_trunc('second', ts))::bigint - epoch(timestamp '2024-01-15')::bigint, 0) end"},
)
_each("x23_line_count", docs, "doc_id", lambda: {"lines": X.line_count(c("text"))}, "documents", {"lines": "case when length(text) = 0 then 0 else len(string_split(text, chr(10))) - case when text like '%' || chr(10) then 1 else 0 end end::bigint"})

line = lambda s, d: table(s, d, "lineitem").withColumn("k", F.concat_ws(":", "l_orderkey", "l_linenumber"))
LINE = "(select *, concat_ws(':', l_orderkey, l_linenumber) as k from lineitem)"
_each("m1_permille", line, "k", lambda: {"p": N.permille(c("l_discount") * 11 - 0.05)}, LINE, {"p": "least(greatest(round((l_discount * 11 - 0.05) * 1000), 0), 1000)::int"})
_each(
    "m2_derived_confidence", line, "k", lambda: {"p": N.derived_confidence(F.when(c("l_linenumber") % 2 == 0, "name_unique").otherwise("import"), N.permille(c("l_discount") * 10))}, LINE, {"p": "least(case when l_linenumber % 2 = 0 then 600 else 950 end, least(round(l_discount * 10 * 1000), 1000)::int)"},
)
_each("m3_proximity", line, "k", lambda: {"p": N.proximity(F.when(c("l_linenumber") < 6, c("l_linenumber") - 1))}, LINE, {"p": "case when l_linenumber >= 6 then 0.2 else [1.0, 0.8, 0.5, 0.2, 0.0][l_linenumber] end::double"})
_each("m4_semantic_signal", line, "k", lambda: {"p": F.round(N.semantic_signal(c("l_quantity") / 50), 9)}, LINE, {"p": "round(greatest(least((l_quantity / 50 - 0.5) / 0.5, 1), 0), 9)"})
_each("m5_unit", line, "k", lambda: {"p": N.unit(c("l_tax") * 15 - 0.1)}, LINE, {"p": "greatest(least(l_tax * 15 - 0.1, 1), 0)"})
_each("m6_sample_factors", line, "k", lambda: {"s": F.round(N.sample_factor(c("l_quantity")), 9), "m": F.round(N.spread_factor(c("l_linenumber")), 9)}, LINE, {"s": "round(least(1.0, ln(1 + l_quantity) / ln(31)), 9)", "m": "round(least(1.0, l_linenumber / 3), 9)::double"})
_each("m7_backoff", line, "k", lambda: {"ms": N.backoff_ms(c("l_linenumber"))}, LINE, {"ms": "least(300000, 5000 * pow(2, l_linenumber - 1))::bigint"})
_each(
    "m8_directory_distance", lambda s, d: paths(s, d).withColumn("q", F.regexp_replace("path", "/", "/x/")), "p_partkey", lambda: {"d": N.directory_distance(c("path"), c("path")), "e": N.directory_distance(c("path"), c("q"))}, PATHS,
    {"d": "0", "e": "(len(string_split(path, '/')) - 1) + 2 * (len(string_split(path, '/')) - 1) - 2 * least(1, len(string_split(path, '/')) - 1)"},
)
_each(
    "m9_vector_maths", lambda s, d: table(s, d, "embeddings"), "vec_id", lambda: {"norm": F.round(N.norm(c("embedding")), 6), "unit": F.round(N.dot(N.l2_normalize(c("embedding")), N.l2_normalize(c("embedding"))), 6)}, "embeddings",
    {"norm": "round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6)", "unit": "1.0::double"},
)
_R = "array(named_struct('start', l_linenumber, 'end', l_linenumber + 3), named_struct('start', 20, 'end', 30))"
_each(
    "m11_ranges", lambda s, d: line(s, d).withColumn("r", F.expr(_R)).withColumn("x", c("l_quantity").cast("int")), "k", lambda: {"inside": N.in_ranges(c("r"), c("x")), "near": N.nearest_line(c("r"), c("x"), 5)}, "(select *, l_quantity::int as x, l_linenumber as a from lineitem) as q, lateral (select concat_ws(':', q.l_orderkey, q.l_linenumber) as k)",
    {"inside": "(x >= a and x < a + 3) or (x >= 20 and x < 30)", "near": "case when abs(greatest(a, least(x, a + 2)) - x) <= abs(greatest(20, least(x, 29)) - x) then case when abs(greatest(a, least(x, a + 2)) - x) <= 5 then greatest(a, least(x, a + 2)) end when abs(greatest(20, least(x, 29)) - x) <= 5 then greatest(20, least(x, 29)) end"},
)
_each("m16_json_predicate", lambda s, d: table(s, d, "events").where(F.get_json_object("props", "$.k").isin("1", "2", "3")), "event_id", lambda: {"value": c("value")}, "events where json_extract_string(props, '$.k') in ('1', '2', '3')", {"value": "value"})
_each("m17_json_object", lambda s, d: table(s, d, "orders"), "o_orderkey", lambda: {"j": F.to_json(F.struct(c("o_orderkey").alias("id"), c("o_orderstatus").alias("state")))}, "orders", {"j": "'{\"id\":' || o_orderkey || ',\"state\":\"' || o_orderstatus || '\"}'"})
_each("m18_time_formats", lambda s, d: table(s, d, "events"), "event_id", lambda: {"iso": N.iso_micros(c("ts")), "us": N.epoch_micros(c("ts").cast("timestamp"))}, "events", {"iso": "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')", "us": "epoch_us(ts)"})
_each("m19_event_timestamp", lambda s, d: table(s, d, "events").withColumn("a", c("ts").cast("string")).withColumn("b", F.lit("2024-01-15 00:00:00")), "event_id", lambda: {"us": N.epoch_micros(N.newest_time(c("a"), c("b"), F.lit("never")))}, "events", {"us": "epoch_us(greatest(ts, timestamp '2024-01-15'))"})
query("m20_minute_bucket", "select user_id, epoch_us(date_trunc('minute', ts)) as minute, count(*) as n from events group by 1, 2")(lambda s, d: table(s, d, "events").groupBy("user_id", F.unix_micros(F.date_trunc("minute", F.col("ts").cast("timestamp"))).alias("minute")).agg(F.count("*").alias("n")))
_each("m21_price_staleness", lambda s, d: table(s, d, "orders"), "o_orderkey", lambda: {"stale": N.stale_days(c("o_orderdate"), F.lit("1998-01-01").cast("date"), 900)}, "orders", {"stale": "datediff('day', o_orderdate::date, date '1998-01-01') > 900"})
