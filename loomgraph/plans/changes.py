"""Queries of changes: signals, roll-up, hunks, chains, packages, publication, tests and bulk rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import changes as C
from loomgraph.operators import review as R
from loomgraph.operators import schema
from loomgraph.plans.adapters import EDGES, duck, spark_sql
from loomgraph.plans.catalog import query, table

c = F.col
FILES = """select 'src/' || case p_partkey % 8 when 0 then 'auth/' when 1 then 'db/migrations/' when 2 then 'payments-v2/' when 3 then 'billing/x/' when 4 then 'security/' else '' end
  || case when p_partkey % 8 = 5 then 'Dockerfile' else 'f' || cast(p_partkey as string) || '.ts' end as path, case p_partkey % 13 when 0 then 'generated' when 1 then 'vendored' else 'analyze' end as disposition from {part}"""
files = lambda s, d: spark_sql(s, d, FILES)
_RULES = "(values " + ", ".join(f"('{a}', '{b}', {w}::double, {'null' if f is None else repr(f)})" for a, b, w, f in R.RULES) + ") as rules(rule, category, weight, floor)"
_ANALYZED = f"(select distinct path from ({duck(FILES)}) where disposition = 'analyze')"
_PAY = "regexp_matches(path, '(^|/)payment[^/]*.*/|(^|/)billing/')"
_DEFAULT = f"""select 'path.auth' as rule, path from {_ANALYZED} where regexp_matches(path, '(^|/)(auth|security)/') union all select 'path.migrations', path from {_ANALYZED} where regexp_matches(path, '(^|/)migrations/')
union all select 'path.infra', path from {_ANALYZED} where regexp_matches(path, '(^|/)Dockerfile$') union all select 'path.payments', path from {_ANALYZED} where {_PAY}"""
_PATH_SIGNALS = f"select rule, path as subject, category, weight, floor, 1.0::double as confidence from ({_DEFAULT}) join {_RULES} using (rule)"
query("r1_path_signals", _PATH_SIGNALS)(lambda s, d: C.path_signals(files(s, d)))
query("r1_configured_paths", f"""select 'path.configured' as rule, path as subject, case when path like 'src/auth/%' then 'authentication' else 'public_api_contracts' end as category, case when path like 'src/auth/%' then 0.8 else 0.4 end::double as weight,
  case when path like 'src/auth/%' then 'critical' else 'medium' end as floor, 1.0::double as confidence from {_ANALYZED} where path like 'src/auth/%' or path like '%5.ts'
union all select 'path.payments', path, 'payments', 0.65::double, null, 1.0::double from {_ANALYZED} where {_PAY}""")(lambda s, d: C.path_signals(files(s, d), [("src/auth/**", "critical", None), ("**/*5.ts", "medium", None), ("src/auth/*5.ts", "low", "secrets")]))

_CLASSES = ("authorization_changed", "validation_removed", "database_write_changed", "transaction_boundary_changed", "api_contract_changed", "async_behavior_changed", "exception_handling_changed")
_TAGS = ("authz_call_removed", "direct_role_comparison_added", "guard_removed", "guard_added", "inside_transaction", "additive", "breaking", "floating_promise", "await_removed_on_db_write")


def classes(s, d):
    tags = F.array_compact(F.array(*(F.when((c("l_partkey") + i * c("l_suppkey")) % 4 == 0, F.lit(t)) for i, t in enumerate(_TAGS))))
    return table(s, d, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("symbol"), F.get(F.array(*map(F.lit, _CLASSES)), (c("l_partkey") % len(_CLASSES)).cast("int")).alias("class"), tags.alias("tags"), (1 - c("l_discount")).alias("confidence"))


_HAS = {t: f"((l_partkey + {i} * l_suppkey) % 4 = 0)" for i, t in enumerate(_TAGS)}
_AUTHZ = "list_filter([" + ", ".join(f"case when {_HAS[t]} then '{r}' end" for t, r in (("authz_call_removed", "authz.call_removed"), ("direct_role_comparison_added", "authz.direct_role_check"), ("guard_removed", "authz.guard_removed"), ("guard_added", "authz.guard_added"))) + "], lambda x: x is not null)"
_CLASS_RULES = f"""select l_orderkey || ':' || l_linenumber as subject, 1 - l_discount as confidence, unnest(case (l_partkey % 7)::int when 0 then case when len({_AUTHZ}) > 0 then {_AUTHZ} else ['authz.logic_changed'] end when 1 then ['validation.removed']
  when 2 then [case when {_HAS['inside_transaction']} then 'db.write_changed_in_tx' else 'db.write_changed' end] when 3 then ['tx.boundary_changed'] when 4 then [case when {_HAS['additive']} and not {_HAS['breaking']} then 'api.additive_change' else 'api.breaking_change' end]
  when 5 then case when {_HAS['floating_promise']} or {_HAS['await_removed_on_db_write']} then ['async.floating_promise'] else [] end else [] end) as rule from lineitem"""
_CLASS_SIGNALS = f"select rule, subject, category, weight, floor, confidence from ({_CLASS_RULES}) join {_RULES} using (rule)"
query("r3_class_signals", _CLASS_SIGNALS)(lambda s, d: C.class_signals(classes(s, d)))
query("r5_all_signals", f"select rule, subject, category, max(confidence) as confidence, subject as explanation, max(weight) as weight, any_value(floor) as floor from ({_PATH_SIGNALS} union all {_CLASS_SIGNALS}) group by 1, 2, 3")(lambda s, d: C.all_signals(C.path_signals(files(s, d)), C.class_signals(classes(s, d))))

# A signal of an order is about a symbol, a file, a cluster or the change; its lines tell category and floor.
SIGNALS = """select case o_custkey % 5 when 0 then 'file' when 1 then 'cluster' else case when o_orderkey % 999 = 0 then 'change' else 'symbol' end end as kind, cast(o_orderkey % 700 as string) as subject, o_orderpriority as category,
  round(o_totalprice / 1000000, 4) as contribution, case when o_orderkey % 50 = 0 then 'high' end as floor from {orders}"""
_SYMBOLS = "select cast(id as string) as symbol, cast(id % 90 as string) as file from (select distinct o_orderkey % 700 as id from {orders})"
_MEMBERS = "select cast(id % 40 as string) as cluster, case when id % 3 = 0 then 'file' else 'symbol' end as kind, cast(id as string) as subject from (select distinct o_orderkey % 700 as id from {orders})"
_LV = "case {} when 'critical' then 3 when 'high' then 2 when 'medium' then 1 when 'low' then 0 end"


def _scored(rows: str) -> str:
    return f"""(with p as (select key, category, max(contribution) as con, max({_LV.format('floor')}) as f from ({rows}) group by 1, 2), s as (select key, 1 - product(1 - con) as raw, max(f) as f from p group by 1),
    l as (select *, greatest(case when raw >= 0.75 then 3 when raw >= 0.5 then 2 when raw >= 0.25 then 1 else 0 end, coalesce(f, -1)) as lv from s) select key, greatest(raw, case when f is null then 0 else [0, 0.25, 0.5, 0.75][lv + 1] end)::double as score, lv from l)"""


_S, _M, _Y = f"({duck(SIGNALS)})", f"({duck(_MEMBERS)})", f"({duck(_SYMBOLS)})"
_PER_SYMBOL = _scored(f"select subject as key, category, contribution, floor from {_S} where kind = 'symbol' union all select symbol, category, contribution, s.floor from {_Y} y join {_S} s on s.kind = 'file' and s.subject = y.file")
_PER_CLUSTER = _scored(f"select cluster as key, category, contribution, s.floor from {_M} m join {_S} s on m.kind = s.kind and m.subject = s.subject union all select subject, category, contribution, floor from {_S} where kind = 'cluster' and subject in (select cluster from {_M})")
_CHANGE = _scored(f"select 'change' as key, category, contribution, floor from {_S} where kind = 'change'")
query("a8_risk_rollup", f"""with y as (select * from {_PER_SYMBOL}), k as (select * from {_PER_CLUSTER}), w as (select max(score) as score, max(lv) as lv from (select score, lv from k union all select score, lv from {_CHANGE})),
b as (select 1 - (1 - score) * 0.9 as score, greatest(lv, case when 1 - (1 - score) * 0.9 >= 0.75 then 3 when 1 - (1 - score) * 0.9 >= 0.5 then 2 when 1 - (1 - score) * 0.9 >= 0.25 then 1 else 0 end) as lv from w),
a as (select 'symbol' as scope, key, score, lv from y union all select 'cluster', key, score, lv from k union all select 'change', '', score, lv from b)
select scope, key, floor(score * 1000000 + 0.5001)::bigint as score, ['low', 'medium', 'high', 'critical'][lv + 1] as level from a""")(
    lambda s, d: C.roll_up(spark_sql(s, d, SIGNALS), spark_sql(s, d, _SYMBOLS), spark_sql(s, d, _MEMBERS), 60, digits=12).withColumn("score", F.floor(c("score") * 1000000 + 0.5001))
)
# An order's lines are hunk lines: returned ones deleted, accepted ones added.
query("m12_changed_ranges", """with x as (select l_orderkey, case l_returnflag when 'R' then 'old' else 'new' end as side, l_linenumber as n from lineitem where l_returnflag <> 'N'),
g as (select *, n - row_number() over (partition by l_orderkey, side order by n) as g from (select distinct * from x)) select l_orderkey, side, min(n)::int as "start", (max(n) + 1)::int as "end" from g group by l_orderkey, side, g""")(
    lambda s, d: C.changed_ranges(table(s, d, "lineitem").select("l_orderkey", F.when(c("l_returnflag") == "R", "del").when(c("l_returnflag") == "A", "add").otherwise("context").alias("kind"), c("l_linenumber").cast("int").alias("old_no"), c("l_linenumber").cast("int").alias("new_no")), ["l_orderkey"])
)
_NEW_TEXT = """with l as (select doc_id, no, parts[no] as line from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as no from (select doc_id, string_split(text, chr(10)) as parts from documents where text is not null))),
n as (select doc_id, no as a, 0 as b, line from l where no % 3 <> 1 union all select doc_id, no, no * 2, 'new ' || no from l where no % 3 = 1)"""
query("m13_apply_hunks", f"{_NEW_TEXT} select doc_id, md5(string_agg(line, chr(10) order by a, b)) as digest from n group by 1")(
    lambda s, d: (lambda l: C.apply_hunks(l, l.where("no % 3 = 1").select("doc_id", F.explode(F.array(F.struct((c("no") * 2 - 1).alias("seq"), F.lit("del").alias("kind"), c("no").alias("old_no"), c("line").alias("text")), F.struct((c("no") * 2).alias("seq"), F.lit("add").alias("kind"), F.lit(None).cast("int").alias("old_no"), F.concat(F.lit("new "), "no").alias("text")))).alias("x")).select("doc_id", "x.*"), "doc_id"))(
        table(s, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line")).select("doc_id", (c("no") + 1).alias("no"), "line")
    ).select("doc_id", F.md5("text").alias("digest"))
)
# Snapshots: each customer's base is a lower one; every tenth is full, some are missing or not ready.
_METAS = "select c_custkey as id, case when c_custkey % 10 = 0 then null else c_custkey - 1 end as base, c_custkey % 10 = 0 and c_custkey % 30 <> 0 as \"full\", c_custkey % 47 <> 0 as ready from {customer} where c_custkey % 31 <> 5"
query("v6_chain_walk", f"""with recursive m as ({duck(_METAS)}), r(id, cur, chain, status) as (select i.c_custkey, i.c_custkey, []::bigint[], null::varchar from customer i
union all select r.id, m.base, list_prepend(r.cur, r.chain), case when m.id is null then case when len(r.chain) = 0 then 'not_found' else 'broken' end when not m.ready then 'not_ready' when m.base is null then case when m."full" then 'ok' else 'broken' end end from r left join m on m.id = r.cur where r.status is null)
select id, case when status = 'ok' then array_to_string(chain, '>') end as chain, status from r where status is not null""")(
    lambda s, d: C.chain_walk(table(s, d, "customer").select(c("c_custkey").alias("id")), spark_sql(s, d, _METAS.replace('"full"', "`full`"))).select("id", F.array_join("chain", ">").alias("chain"), "status")
)
_HEAD = "select distinct 'm' || cast(l_suppkey % 60 as string) as source, 'm' || cast((l_suppkey * 7 + l_linenumber) % 60 as string) as target from {lineitem} where l_linenumber < 3"
_BASE = "select source, target from ({head}) where source <> 'm7'".replace("{head}", _HEAD)
_SCC = "(with recursive e as ({e}), r(a, b) as (select source, target from e union select r.a, e.target from r join e on r.b = e.source), s as (select x.a as n, least(x.a, min(x.b)) as k from r x join r y on x.a = y.b and x.b = y.a where x.a <> x.b group by x.a) select array_to_string(list_sort(list(n)), ',') as members from s group by k)"
query("u4_new_cycles", f"select list_sort(string_split(members, ','))[1] as first, members from (select * from {_SCC.format(e=duck(_HEAD))} except select * from {_SCC.format(e=duck(_BASE))})")(
    lambda s, d: (lambda h: C.new_cycles(h, spark_sql(s, d, _BASE), h.select(c("source").alias("node_key"))).select(F.array_min("members").alias("first"), F.array_join("members", ",").alias("members")))(spark_sql(s, d, _HEAD))
)
query("o16_package", """with x as (select l_orderkey, l_linenumber || ':' || l_partkey as item, l_linenumber = 2 as pinned, l_discount as score, l_quantity::int as tokens from lineitem)
select l_orderkey, string_agg(item, ',' order by not pinned, -score, item, tokens) as items, sha256(string_agg(item || ':' || printf('%.6f', score) || ':' || tokens, chr(10) order by not pinned, -score, item, tokens)) as hash from x group by 1""")(
    lambda s, d: C.package(table(s, d, "lineitem").select("l_orderkey", F.concat_ws(":", "l_linenumber", "l_partkey").alias("item"), (c("l_linenumber") == 2).alias("pinned"), c("l_discount").cast("double").alias("score"), c("l_quantity").cast("int").alias("tokens")), ["l_orderkey"]).withColumn("items", F.array_join("items", ","))
)
_SEV = "['critical', 'high', 'medium', 'low', 'info'][(o_orderkey % 5)::int + 1]"
query("o24_finding_sort", f"select o_orderkey, {_SEV} as severity from orders order by o_orderkey % 5, o_totalprice desc, o_orderpriority, o_orderkey limit 100")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", F.get(F.array(*map(F.lit, C.SEVERITIES)), (c("o_orderkey") % 5).cast("int")).alias("severity"), c("o_totalprice").alias("confidence"), c("o_orderpriority").alias("path"), c("o_orderkey").alias("line")).orderBy(*C.finding_order()).limit(100).select("o_orderkey", "severity")
)
query("o19_publication_plan", """with f as (select o_orderkey, o_custkey, o_orderpriority as path, o_orderkey % 40 as line, o_orderkey % 17 <> 0 as renders, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders),
g as (select *, line between (o_custkey % 20) and (o_custkey % 20) + 17 and path <> '5-LOW' as inside from f), h as (select *, sum((inside and renders)::int) over (partition by o_custkey order by rank) as n from g)
select o_orderkey, case when inside and renders and n <= 4 then 'inline' else 'summary' end as placed, case when not inside then 'out_of_diff' when not renders then 'render_error' when n > 4 then 'inline_cap' end as reason from h""")(
    lambda s, d: C.publication_plan(
        spark_sql(s, d, "select o_orderkey, o_custkey, o_orderpriority as path, o_orderkey % 40 as line, o_orderkey % 17 <> 0 as renders, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from {orders}"),
        spark_sql(s, d, "select distinct o_custkey, o_orderpriority as path, o_custkey % 20 as start, o_custkey % 20 + 18 as `end` from {orders} where o_orderpriority <> '5-LOW'"), ["o_custkey"], 4,
    ).select("o_orderkey", "placed", "reason")
)
query("e5_request_audit", """select event_id, case when event_id % 3 < 2 then case when event_id % 5 = 0 then 'no organization_id' when event_id % 7 = 0 then 'no repository_id' when event_id % 11 = 0 then 'tenant key elsewhere' end when event_id % 3 = 2 then case when event_id % 13 = 0 then 'no points' when event_id % 17 = 0 then 'payload without key' end end as violation from events""")(
    lambda s, d: C.audit_requests(table(s, d, "events").select(
        "event_id", F.when(c("event_id") % 3 == 0, "search").when(c("event_id") % 3 == 1, "count").otherwise("upsert").alias("op"),
        F.array_compact(F.array(F.when(c("event_id") % 5 != 0, F.struct(F.lit("organization_id").alias("key"), F.array(F.lit("o")).alias("values"))), F.when(c("event_id") % 7 != 0, F.struct(F.lit("repository_id").alias("key"), F.array(F.lit("r"), F.lit("q")).alias("values"))))).alias("must"),
        F.when(c("event_id") % 11 == 0, F.array(F.lit("organization_id"))).otherwise(F.array(F.lit("lang"))).alias("elsewhere"),
        F.when(c("event_id") % 13 != 0, F.array(F.when(c("event_id") % 17 == 0, F.create_map(F.lit("organization_id"), F.lit("o"))).otherwise(F.create_map(F.lit("organization_id"), F.lit("o"), F.lit("repository_id"), F.lit("r"))))).alias("payloads"),
    )).select("event_id", "violation")
)
_TESTS = "select 'p' || cast(p_partkey as string) as node_key, case p_partkey % 4 when 0 then 'test_case' when 1 then 'test_suite' when 2 then 'file' else 'function' end as kind, p_name as name, 'src/d' || cast(p_partkey % 20 as string) || case when p_partkey % 3 = 0 then '/a.spec.ts' else '/a.ts' end as path from {part}"
_HOLDS = "select distinct 'p' || cast(l_partkey as string) as source, 'p' || cast((l_partkey * 3 + l_linenumber) % 200 as string) as target from {lineitem} where l_partkey % 4 = 1"
query("o3_test_index", f"""with n as ({duck(_TESTS)}), h as ({duck(_HOLDS)}), x as (select h.target, max(h.source) as suite from h join n on n.node_key = h.source and n.kind = 'test_suite' group by 1)
select n.node_key, n.path, x.suite, s.name as suite_name from n left join x on x.target = n.node_key left join n s on s.node_key = x.suite where n.kind = 'test_case'""")(lambda s, d: C.test_index(spark_sql(s, d, _TESTS), spark_sql(s, d, _HOLDS))[0].select("node_key", "path", "suite", "suite_name"))
query("o3_test_files", f"select distinct path from ({duck(_TESTS)}) where kind in ('test_case', 'test_suite') or path like '%.spec.ts'")(lambda s, d: C.test_index(spark_sql(s, d, _TESTS), spark_sql(s, d, _HOLDS))[1])
query("o10_versioned_symbols", f"with n as ({duck(_TESTS)}) select path, case when path like '%.spec.ts' then null else md5(path) end as file_version, string_agg(distinct name, ',' order by name) as symbols from n group by 1")(
    lambda s, d: (lambda n: C.versioned_symbols(n.select("path", c("name").alias("symbol")), n.select("path").distinct().where("path not like '%.spec.ts'").withColumn("version", F.md5("path"))).withColumn("symbols", F.array_join("symbols", ",")))(spark_sql(s, d, _TESTS))
)
_CLS = "select 'f' || cast(p_partkey % 300 as string) as path, 'T' || cast(p_size * 5 + p_partkey % 9 as string) as name, 'k' || cast(p_partkey as string) as key from {part}"
_IMP = "select distinct 'f' || cast(l_suppkey % 300 as string) as path, 'T' || cast(l_linenumber * 5 + l_partkey % 9 as string) as name, 'f' || cast(l_partkey % 300 as string) as target_path from {lineitem}"
_REFS = "select o_orderkey as id, 'f' || cast(o_custkey % 300 as string) as path, case when o_orderkey % 2 = 0 then 'Promise<' else '' end || 'T' || cast(o_orderkey % 260 as string) || '[]' as type from {orders}"
query("j5_type_references", f"""with k as ({duck(_CLS)}), i as ({duck(_IMP)}), f as ({duck(_REFS)}), r as (select *, 'T' || (id % 260) as head from f), own as (select path, name, min(key) as key from k group by 1, 2),
via as (select i.path, i.name, min(o.key) as key from i join own o on o.path = i.target_path and o.name = i.name group by 1, 2), one as (select name, min(key) as key from k group by 1 having count(distinct key) = 1)
select r.id, coalesce(o.key, v.key, u.key) as target, case when o.key is not null then 'same_file' when v.key is not null then 'import' when u.key is not null then 'unique' end as how
from r left join own o on o.path = r.path and o.name = r.head left join via v on v.path = r.path and v.name = r.head left join one u on u.name = r.head""")(
    lambda s, d: C.type_references(spark_sql(s, d, _REFS), spark_sql(s, d, _CLS), spark_sql(s, d, _IMP)).select("id", "target", "how")
)
query("o15_cluster_members", """with m as (select distinct l_suppkey as cluster, l_partkey as symbol from lineitem), t as (select distinct l_partkey as symbol from lineitem where l_quantity > 47)
select m.cluster, count(distinct p_partkey) as symbols, count(distinct p_brand) as files, bool_or(t.symbol is null and p_size % 5 <> 0) as untested, bool_or(p_size % 5 <> 0) as substantial from m join part on p_partkey = m.symbol left join t on t.symbol = m.symbol group by 1""")(
    lambda s, d: C.cluster_members(table(s, d, "lineitem").select(c("l_suppkey").alias("cluster"), c("l_partkey").alias("symbol")).distinct(), table(s, d, "part").select(c("p_partkey").alias("symbol"), c("p_brand").alias("path"), (c("p_size") % 5 == 0).alias("cosmetic")), table(s, d, "lineitem").where("l_quantity > 47").select(c("l_partkey").alias("symbol")))
)
query("k7_embedding_upsert", "select doc_id as unit from documents d where not exists (select 1 from documents e where e.doc_id = d.doc_id and e.doc_id % 3 <> 0 and md5(coalesce(e.text, '')) = md5(case when d.doc_id % 5 = 0 then 'x' else coalesce(d.text, '') end))")(
    lambda s, d: (lambda x: C.upsert_units(x.select(c("doc_id").alias("unit"), F.md5(F.when(c("doc_id") % 5 == 0, "x").otherwise(F.coalesce("text", F.lit("")))).alias("content_hash")), x.where("doc_id % 3 <> 0").select(c("doc_id").alias("unit"), F.md5(F.coalesce("text", F.lit(""))).alias("content_hash"))).select("unit"))(table(s, d, "documents"))
)
query("k4_bulk_rows", "select l_orderkey, l_linenumber, l_partkey from lineitem")(
    lambda s, d: C.from_arrays(table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x")).select("l_orderkey", c("x.l_linenumber").alias("l_linenumber"), c("x.l_partkey").alias("l_partkey")), ["l_orderkey"], ["l_linenumber", "l_partkey"])
)
_ODD = f"select source, case when confidence % 7 = 3 then 'smells' else kind end as kind, target from ({EDGES})"
_NO = "[" + ", ".join(f"'{k}'" for k in schema.EDGE_KINDS) + "]"
query("o9_stored_edges", f"select source, target, (list_position({_NO}, kind) - 1)::int as kind_no from ({duck(_ODD)}) where list_contains({_NO}, kind)")(lambda s, d: C.stored_edges(spark_sql(s, d, _ODD), schema.EDGE_KINDS)[0].select("source", "target", "kind_no"))
query("o9_dropped_kinds", f"select kind, count(*) as dropped from ({duck(_ODD)}) where not list_contains({_NO}, kind) group by 1")(lambda s, d: C.stored_edges(spark_sql(s, d, _ODD), schema.EDGE_KINDS)[1])
query("m14_canonical_json", "select event_id, '{\"a\":[' || event_id || ',null],\"k\":' || printf('%.6f', value) || ',\"z\":\"é\"}' as j from events")(
    lambda s, d: table(s, d, "events").select("event_id", C.canonical_json(F.concat(F.lit('{ "z": "é", "k": '), F.format_string("%.2f", c("value").cast("double")), F.lit(', "a": ['), "event_id", F.lit(", null] }"))).alias("j"))
)
