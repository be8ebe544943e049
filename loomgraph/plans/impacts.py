"""Queries of impact, clusters, plans, linking and control-plane joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import numbers as N
from loomgraph.functions import text as X
from loomgraph.operators import impact as P
from loomgraph.operators import review as R
from loomgraph.plans.adapters import MERGED_SQL, duck, spark_sql
from loomgraph.plans.catalog import query, table
from loomgraph.plans.graphs import keys, merged
from loomgraph.plans.reviews import ev

c = F.col
M = f"({MERGED_SQL})"

query("g13_caller_expansion", f"""with e as (select target as k, source as other, max(confidence) as c from {M} group by 1, 2), a as (select s as seed, other as node, c, row_number() over (partition by s order by c desc, other) as rn from (values ('p:1'), ('p:2'), ('s:4')) v(s) join e on k = s)
select seed, node, 1 as distance, c as confidence from a where rn <= 20""")(lambda s, d: P.expand(merged(s, d), keys(s, "p:1", "p:2", "s:4"), "in", 1, 20).select("seed", "node", "distance", "confidence"))
query("g14_removed_callees", f"select distinct source as seed, target as node from {M} where kind = 'calls' and source in ('c:1', 'c:2') and confidence < 500 and target not in (select target from {M} m2 where m2.kind = 'calls' and m2.confidence >= 500 and m2.source = source)".replace("m2.source = source", "m2.source = x.source").replace(f"from {M} where kind = 'calls' and source in", f"from {M} x where kind = 'calls' and source in"))(
    lambda s, d: (lambda m: P.removed_callees(m.where("confidence < 500"), m.where("confidence >= 500"), keys(s, "c:1", "c:2")))(merged(s, d))
)
query("g17_siblings", "with m as (select n_regionkey as contract, s_suppkey % 5 as name, s_suppkey as key from supplier join nation on s_nationkey = n_nationkey) select distinct x.key as member, y.key as sibling from m x join m y using (contract, name) where x.key <> y.key")(
    lambda s, d: P.siblings(table(s, d, "nation").select(c("n_nationkey").alias("owner"), c("n_regionkey").alias("contract")), table(s, d, "supplier").select(c("s_nationkey").alias("owner"), (c("s_suppkey") % 5).alias("name"), c("s_suppkey").alias("key")))
)
_TRAILS = "select l_orderkey as seed, l_partkey as node, l_linenumber as distance, cast(l_quantity as int) as confidence, array(cast(l_suppkey as string)) as path from {lineitem}"
query("g18_best_trails", "select seed, node, distance, confidence, n - 1 as others from (select l_orderkey as seed, l_partkey as node, l_linenumber as distance, l_quantity::int as confidence, row_number() over (partition by l_orderkey, l_partkey order by l_quantity desc, l_linenumber, l_suppkey::varchar) as rn, count(*) over (partition by l_orderkey, l_partkey) as n from lineitem) where rn = 1")(lambda s, d: P.best_trails(spark_sql(s, d, _TRAILS)).select("seed", "node", "distance", "confidence", "others"))
query("j19_test_mapping", "with w as (select l_orderkey as test, l_suppkey as symbol, l_returnflag as kind, max(l_quantity / 100) as w from lineitem group by 1, 2, 3), s as (select test, symbol, floor((1 - product(1 - w)) * 10000 + 0.5000001)::bigint as score from w group by 1, 2) select test, symbol, score, score >= 6000 as included from s")(
    lambda s, d: P.test_scores(table(s, d, "lineitem").select(c("l_orderkey").alias("test"), c("l_suppkey").alias("symbol"), c("l_returnflag").alias("kind"), (c("l_quantity") / 100).alias("weight"))).select("test", "symbol", F.round(c("score") * 10000).cast("long").alias("score"), "included")
)
_L = "select distinct o_custkey as a, l_suppkey * 100000 as b, cast(l_quantity as int) as weight from {orders} join {lineitem} on l_orderkey = o_orderkey"
query("c1_change_clusters", f"""with recursive l as ({duck(_L)}), e as (select a, b from l union select b, a from l), r(n, m) as (select a, a from e union select r.n, e.b from r join e on r.m = e.a), k as (select n, min(m) as m from r group by 1)
select c_custkey as member, coalesce(m, c_custkey) as cluster from customer left join k on n = c_custkey""")(lambda s, d: P.clusters(spark_sql(s, d, _L), table(s, d, "customer").select(c("c_custkey").alias("member"))))
query("c2_cluster_split")(lambda s, d: (lambda l: P.split_oversized(l, P.clusters(l, l.select(F.explode(F.array("a", "b")).alias("member")).distinct())))(spark_sql(s, d, _L)))
query("w5_plan_rank", """select o_orderkey, row_number() over (partition by o_custkey order by round(least(1.0, (o_orderkey % 100) / 100.0 + 0.1 * least((o_orderkey % 5) / 3.0, 1) + 0.05 * (o_orderkey % 2)), 6) desc, o_orderkey % 7 desc, o_orderkey)::int as position from orders""")(
    lambda s, d: P.plan_rank(table(s, d, "orders").select(c("o_custkey").alias("pr"), c("o_orderkey").alias("cluster"), (c("o_orderkey") % 100 / 100.0).alias("base"), (c("o_orderkey") % 5).alias("high"), (c("o_orderkey") % 2 == 1).alias("reachable"), (c("o_orderkey") % 7).alias("size"))).select(c("cluster").alias("o_orderkey"), "position")
)
query("t11_review_plan")(lambda s, d: P.spend(table(s, d, "orders").select(c("o_custkey").alias("pr"), c("o_orderkey").alias("cluster"), F.element_at(F.array(*map(F.lit, R.LEVELS)), (c("o_orderkey") % 4 + 1).cast("int")).alias("level"), (c("o_totalprice") / 1000).cast("int").alias("cost"), c("o_orderkey").alias("position")), 800))
query("o17_model_route", "select l_suppkey, l_returnflag, arg_min(l_orderkey, (l_linenumber, l_orderkey)) as entry from lineitem where l_linestatus = 'O' group by 1, 2")(
    lambda s, d: P.first_route(table(s, d, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", c("l_orderkey").alias("entry"), F.struct("l_linenumber", "l_orderkey").alias("order")), ["l_suppkey", "l_returnflag"], c("l_linestatus") == "O")
)
# Linking and control plane
query("j1_import_resolution", "select o_orderkey, coalesce(a.s_suppkey, b.s_suppkey) as target from orders left join supplier a on a.s_suppkey = o_custkey left join supplier b on b.s_suppkey = o_custkey % 40")(
    lambda s, d: (lambda sup: table(s, d, "orders").join(sup.toDF("k1", "t1"), c("o_custkey") == c("k1"), "left").join(sup.toDF("k2", "t2"), c("o_custkey") % 40 == c("k2"), "left").select("o_orderkey", F.coalesce("t1", "t2").alias("target")))(table(s, d, "supplier").select("s_suppkey", c("s_suppkey").alias("t")))
)
query("j3_super_lookup", "with recursive r(k, cur, depth) as (select n_nationkey, n_nationkey, 0 from nation union all select k, (cur * 2 + 1) % 25, depth + 1 from r where depth < 8), h as (select k, min(depth) as depth from r join (select distinct s_nationkey from supplier where s_acctbal > 9000) on cur = s_nationkey group by 1) select n_nationkey, h.depth::int as depth from nation left join h on k = n_nationkey")(
    lambda s, d: (lambda n, own: n.join(_levels(n, own), "n_nationkey", "left"))(table(s, d, "nation").select("n_nationkey"), table(s, d, "supplier").where("s_acctbal > 9000").select("s_nationkey").distinct())
)


def _levels(n, own):
    now, found = n.withColumn("at", c("n_nationkey").cast("long")), None
    for k in range(9):
        hit = now.join(own, c("at") == c("s_nationkey"), "left_semi").select("n_nationkey", F.lit(k).alias("depth"))
        found = hit if found is None else found.unionByName(hit)
        now = now.select("n_nationkey", ((c("at") * 2 + 1) % 25).alias("at"))
    return found.groupBy("n_nationkey").agg(F.min("depth").alias("depth"))


query("j7_module_probing", "select p_partkey, arg_min(x.e, x.i) as hit from part join (select unnest(['.ts', '.tsx', '/index.ts']) as e, unnest([0, 1, 2]) as i) x on (p_partkey + x.i) % 3 = 0 and p_size > 10 group by 1")(
    lambda s, d: table(s, d, "part").where("p_size > 10").select("p_partkey", F.posexplode(F.array(*map(F.lit, (".ts", ".tsx", "/index.ts")))).alias("i", "e")).where("(p_partkey + i) % 3 = 0").groupBy("p_partkey").agg(F.min_by("e", "i").alias("hit"))
)
query("j8_global_guards", "select r_name, n_name from region, nation where r_regionkey < 2")(lambda s, d: table(s, d, "nation").crossJoin(F.broadcast(table(s, d, "region").where("r_regionkey < 2").limit(100))).select("r_name", "n_name"))
query("j18_interface_dispatch", "select p_partkey, o.o_custkey as caller, least(900, max(round(l_discount * 10000)::int)) as confidence from part join lineitem on l_partkey = p_partkey join orders o on o_orderkey = l_orderkey group by 1, 2")(
    lambda s, d: table(s, d, "part").join(table(s, d, "lineitem"), c("p_partkey") == c("l_partkey")).join(table(s, d, "orders"), c("l_orderkey") == c("o_orderkey")).groupBy("p_partkey", c("o_custkey").alias("caller")).agg(F.least(F.lit(900), F.max(F.round(c("l_discount") * 10000).cast("int"))).alias("confidence"))
)
query("j22_publish_context", "select o_orderkey, c_name, n_name, r_name, l.n as lines from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey left join (select l_orderkey, count(*) as n from lineitem where l_returnflag = 'R' group by 1) l on l_orderkey = o_orderkey")(
    lambda s, d: table(s, d, "orders").join(table(s, d, "customer"), c("o_custkey") == c("c_custkey")).join(table(s, d, "nation"), c("c_nationkey") == c("n_nationkey")).join(table(s, d, "region"), c("n_regionkey") == c("r_regionkey")).join(table(s, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("lines")), c("o_orderkey") == c("l_orderkey"), "left").select("o_orderkey", "c_name", "n_name", "r_name", "lines")
)
query("j26_expectations", "select x.o_orderkey as finding, y.o_orderkey as expectation from orders x join orders y on x.o_custkey = y.o_custkey and x.o_orderpriority = y.o_orderpriority and abs(x.o_orderkey - y.o_orderkey) <= 3000 and x.o_orderstatus = 'O' and y.o_orderstatus = 'F'")(
    lambda s, d: (lambda o: o.where("o_orderstatus = 'O'").alias("x").join(o.where("o_orderstatus = 'F'").alias("y"), ["o_custkey", "o_orderpriority"]).where(F.abs(c("x.o_orderkey") - c("y.o_orderkey")) <= 3000).select(c("x.o_orderkey").alias("finding"), c("y.o_orderkey").alias("expectation")))(table(s, d, "orders"))
)
query("j27_stale_findings", "select p.o_orderkey, bool_or(q.o_orderkey is not null) as persists from (select * from orders where o_orderkey % 2 = 0) p left join (select * from orders where o_orderkey % 2 = 1) q on p.o_custkey = q.o_custkey and (p.o_orderpriority = q.o_orderpriority) group by 1")(
    lambda s, d: (lambda o: o.where("o_orderkey % 2 = 0").join(o.where("o_orderkey % 2 = 1").select("o_custkey", "o_orderpriority", F.lit(True).alias("h")).distinct(), ["o_custkey", "o_orderpriority"], "left").select("o_orderkey", F.coalesce("h", F.lit(False)).alias("persists")))(table(s, d, "orders"))
)
query("j29_anchor_reconcile", "select coalesce(a.k, b.k) as k, case when a.n is null then 'provider_only' when b.n is null then 'local_only' when a.n <> b.n then 'differs' else 'same' end as status from (select l_partkey as k, count(*) as n from lineitem where l_linestatus = 'O' group by 1) a full join (select l_partkey as k, count(*) as n from lineitem where l_linestatus = 'F' group by 1) b on a.k = b.k")(
    lambda s, d: (lambda li, g: g(li.where("l_linestatus = 'O'"), "a").join(g(li.where("l_linestatus = 'F'"), "b"), "k", "full_outer").select("k", F.when(c("a").isNull(), "provider_only").when(c("b").isNull(), "local_only").when(c("a") != c("b"), "differs").otherwise("same").alias("status")))(table(s, d, "lineitem"), lambda x, n: x.groupBy(c("l_partkey").alias("k")).agg(F.count("*").alias(n)))
)
query("a15_wilson", """with m as (select user_id, count(*) filter (value > 20) as k, count(*)::double as n, 1.959963984540054 as z from events group by 1)
select user_id, round(greatest((k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 0), 9) as low, round(least((k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 1), 9) as high from m""")(
    lambda s, d: ev(s, d).groupBy("user_id").agg(N.wilson(F.count_if(c("value") > 20), F.count("*")).alias("w")).select("user_id", F.round("w.low", 9).alias("low"), F.round("w.high", 9).alias("high"))
)
query("a25_outcome_counts", "select count(*) filter (o_orderstatus = 'O') as ok, count(*) filter (o_orderstatus = 'F') as failed, count(*) filter (o_orderstatus = 'P') as partial from orders")(lambda s, d: table(s, d, "orders").agg(*(F.count_if(c("o_orderstatus") == k).alias(n) for k, n in (("O", "ok"), ("F", "failed"), ("P", "partial")))))
query("a27_incremental_counters", "select l_shipdate::date::varchar as day, sum((l_returnflag = 'R')::int)::bigint as removed, sum((l_returnflag = 'A')::int)::bigint as added from lineitem group by 1")(lambda s, d: table(s, d, "lineitem").groupBy(c("l_shipdate").cast("date").cast("string").alias("day")).agg(F.sum((c("l_returnflag") == "R").cast("int")).alias("removed"), F.sum((c("l_returnflag") == "A").cast("int")).alias("added")))
query("a28_code_metrics", "select doc_id, 1 + len(regexp_extract_all(text, '\\b(?:if|for|while|case|and|or)\\b')) as cyclomatic, len(string_split(text, chr(10)))::bigint as lines from documents")(lambda s, d: table(s, d, "documents").select("doc_id", (1 + F.regexp_count("text", F.lit(r"\b(?:if|for|while|case|and|or)\b"))).alias("cyclomatic"), F.size(F.split("text", "\n")).cast("long").alias("lines")))
query("f7_probes", "select page_id, contains(html, '@generated') as marker, length(html) / len(string_split(html, chr(10))) > 500 as minified from pages")(lambda s, d: table(s, d, "pages").select("page_id", F.contains("html", F.lit("@generated")).alias("marker"), (F.length("html") / F.size(F.split("html", "\n")) > 500).alias("minified")))
query("f8_path_rules", "select p_partkey, case when p_type like 'PROMO%' then 'high' else 'medium' end as level from part where p_type like 'PROMO%' or p_type like '%BRASS'")(
    lambda s, d: table(s, d, "part").join(F.broadcast(s.createDataFrame([(0, "^PROMO", "high"), (1, "BRASS$", "medium")], "no int, re string, level string")), F.expr("p_type rlike re")).groupBy("p_partkey").agg(F.min_by("level", "no").alias("level"))
)
query("f9_test_paths", "select p_partkey, p_partkey % 2 = 0 as is_test from part")(lambda s, d: table(s, d, "part").select("p_partkey", X.is_test_path(F.concat(F.lit("src/a"), F.when(c("p_partkey") % 2 == 0, ".spec.").otherwise(".x."), F.lit("ts"))).alias("is_test")))
query("f11_optional_filter", "select o_orderkey from orders where o_orderstatus = 'F'")(lambda s, d: (lambda status, priority: table(s, d, "orders").where(F.lit(True) if status is None else c("o_orderstatus") == status).where(F.lit(True) if priority is None else c("o_orderpriority") == priority).select("o_orderkey"))("F", None))
query("m15_typed_attributes", "select event_id, json_extract_string(props, '$.k')::int as k, false as missing from events")(lambda s, d: ev(s, d).select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.get_json_object("props", "$.k").isNull().alias("missing")))
query("o12_latest_run", "select user_id, arg_max(event_type, (ts, event_id)) as state from events group by 1")(lambda s, d: ev(s, d).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state")))
query("o20_finding_trace", "select c_custkey, count(distinct o_orderkey) as orders, count(l_partkey) as lines from customer left join orders on o_custkey = c_custkey left join lineitem on l_orderkey = o_orderkey group by 1")(lambda s, d: table(s, d, "customer").join(table(s, d, "orders"), c("o_custkey") == c("c_custkey"), "left").join(table(s, d, "lineitem"), c("l_orderkey") == c("o_orderkey"), "left").groupBy("c_custkey").agg(F.countDistinct("o_orderkey").alias("orders"), F.count("l_partkey").alias("lines")))
query("o21_audit_list", "select event_id from events where event_type = 'click' and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-25' order by ts desc, event_id desc limit 100")(lambda s, d: ev(s, d).where((c("event_type") == "click") & (c("ts") >= F.lit("2024-01-05").cast("timestamp")) & (c("ts") < F.lit("2024-01-25").cast("timestamp"))).orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id"))
query("o23_membership_sync", "select c_custkey, c_mktsegment as role from customer where c_custkey % 3 = 0 union all select c_custkey, 'new' from customer where c_custkey % 3 = 1")(lambda s, d: (lambda cu: cu.where("c_custkey % 3 = 0").select("c_custkey", c("c_mktsegment").alias("role")).unionByName(cu.where("c_custkey % 3 = 1").select("c_custkey", F.lit("new").alias("role"))))(table(s, d, "customer")))
query("q12_state_machine", "select event_id, coalesce(before, 'view') || '>' || event_type as step from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before from events)")(lambda s, d: ev(s, d).select("event_id", F.concat_ws(">", F.coalesce(F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.lit("view")), "event_type").alias("step")))
query("q13_run_invalidation", "select event_id, event_type as before, 'invalidated' as after from events where user_id = 7")(lambda s, d: ev(s, d).where("user_id = 7").select("event_id", c("event_type").alias("before"), F.lit("invalidated").alias("after")))
query("q14_run_reuse", "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0)")(lambda s, d: table(s, d, "orders").join(table(s, d, "customer").where("c_acctbal < 0"), c("o_custkey") == c("c_custkey"), "left_semi").select("o_orderkey", "o_custkey"))
query("u3_import_only", "select o_custkey, count(*) filter (o_orderstatus = 'P') = 0 as import_only from orders group by 1")(lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg((F.count_if(c("o_orderstatus") == "P") == 0).alias("import_only")))
query("t6_priority_order", "select o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderpriority desc, o_orderkey)::int as n from orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), F.desc("o_orderpriority"), "o_orderkey")).alias("n")))
query("t10_budget", "select o_orderkey, greatest(least(least(24000 * (1 + o_orderkey % 3), 150000), 40000 + o_custkey * 10) - 2500, 0) as tokens from orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", F.greatest(F.least(F.least(24000 * (1 + c("o_orderkey") % 3), F.lit(150000)), 40000 + c("o_custkey") * 10) - 2500, F.lit(0)).alias("tokens")))
query("r2_manifest_signals", "select p_partkey, case when p_size < 10 then 'dep.added' when p_size > 40 then 'dep.major_bump' when p_name like '%anvil%' then 'dep.removed' end as rule from part where p_size < 10 or p_size > 40 or p_name like '%anvil%'")(lambda s, d: table(s, d, "part").select("p_partkey", F.when(c("p_size") < 10, "dep.added").when(c("p_size") > 40, "dep.major_bump").when(F.contains("p_name", F.lit("anvil")), "dep.removed").alias("rule")).where("rule is not null"))
query("r8_effects", "select o_orderkey, case when o_totalprice > 300000 then 'deep' when o_totalprice > 150000 then 'standard' else 'light' end as depth from orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", F.when(c("o_totalprice") > 300000, "deep").when(c("o_totalprice") > 150000, "standard").otherwise("light").alias("depth")))
query("r12_reviewer_routing", "select o_orderkey, k as reviewer from orders join (values ('security', 'O'), ('correctness', 'F')) v(k, st) on o_orderstatus = st")(lambda s, d: table(s, d, "orders").join(F.broadcast(s.createDataFrame([("security", "O"), ("correctness", "F")], "reviewer string, st string")), c("o_orderstatus") == c("st")).select("o_orderkey", "reviewer"))
query("r13_candidate_gates", "select o_orderkey, case when o_totalprice < 5000 then 'low_value' when o_orderpriority like '5%' then 'low_priority' end as reason from orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", F.when(c("o_totalprice") < 5000, "low_value").when(F.startswith("o_orderpriority", F.lit("5")), "low_priority").alias("reason")))
query("c11_identity_key", "select o_orderkey, md5(coalesce(c.c_name, 'own' || o_orderkey) || '/' || o_orderpriority) as k from orders left join customer c on c_custkey = o_custkey and c_acctbal > 5000")(lambda s, d: table(s, d, "orders").join(table(s, d, "customer").where("c_acctbal > 5000"), c("c_custkey") == c("o_custkey"), "left").select("o_orderkey", F.md5(F.concat(F.coalesce("c_name", F.concat(F.lit("own"), "o_orderkey")), F.lit("/"), "o_orderpriority")).alias("k")))
