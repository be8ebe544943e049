"""Queries of jobs, budgets, invalidation and the rest of traversal."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import control as C
from loomgraph.operators import graph as G
from loomgraph.operators import versioning as V
from loomgraph.plans.adapters import MERGED_SQL
from loomgraph.plans.catalog import query, table
from loomgraph.plans.graphs import keys, merged
from loomgraph.plans.reviews import ev

c = F.col
M = f"({MERGED_SQL})"

query("q15_budget_reserve")(lambda s, d: C.reserve(table(s, d, "orders").select("o_custkey", c("o_orderkey").alias("id"), (c("o_totalprice") / 1000).cast("long").alias("amount"), c("o_orderkey").alias("order")), "o_custkey", 1000))
query("q2_job_states")(lambda s, d: C.job_states(ev(s, d).select("user_id", F.element_at(F.array(*map(F.lit, ("claim", "fail", "claim", "complete", "claim"))), (c("event_id") % 5 + 1).cast("int")).alias("what"), F.struct("ts", "event_id").alias("order")), "user_id"))
query("v17_invalidation_plan", f"""with x as (select 'p:' || p_partkey as key, 0 as a from part where p_size = 1 union all select 'p:' || p_partkey, 1 from part where p_size in (1, 2) union all select source, 2 from {M} where kind = 'calls' and target in (select 'p:' || p_partkey from part where p_size = 1))
select key, ['full', 'rekey', 'summary'][min(a) + 1] as action from x group by 1""")(
    lambda s, d: (lambda p: C.invalidation(p.where("p_size = 1"), p.where("p_size in (1, 2)"), merged(s, d)))(table(s, d, "part").select(F.concat(F.lit("p:"), "p_partkey").alias("key"), "p_size"))
)
query("e3_collections", """with l as (select l_suppkey, arg_max(l_orderkey, (l_shipdate, l_orderkey)) as lead from lineitem where l_returnflag <> 'R' and l_linenumber = 1 group by 1)
select l_suppkey as space, l_orderkey as id, case when l_orderkey = lead then 'active' when l_returnflag = 'R' then 'building' when datediff('day', l_shipdate::date, date '1997-01-01') >= 7 then 'delete' else 'retired' end as status from lineitem left join l using (l_suppkey) where l_linenumber = 1""")(
    lambda s, d: C.collections(table(s, d, "lineitem").where("l_linenumber = 1").select(c("l_suppkey").alias("space"), c("l_orderkey").alias("id"), c("l_shipdate").alias("created"), (c("l_returnflag") != "R").alias("ready")), F.lit("1997-01-01").cast("date"))
)
query("r10_structural_classes", """with x as (select l_suppkey, l_returnflag, count(*) filter (l_linestatus = 'F') as f, count(*) filter (l_linestatus = 'O') as o from lineitem group by 1, 2) select l_suppkey as symbol, case l_returnflag when 'A' then 'condition_changed' when 'N' then 'loop_changed' else 'return_changed' end as class from x where f <> o""")(
    lambda s, d: (lambda li: C.structural_changes(V.multiset_diff(li.where("l_linestatus = 'F'"), li.where("l_linestatus = 'O'"), ["l_suppkey", "l_returnflag"]).select(c("l_suppkey").alias("symbol"), F.when(c("l_returnflag") == "A", "condition").when(c("l_returnflag") == "N", "loop").otherwise("return").alias("kind"))))(table(s, d, "lineitem"))
)
query("r9_low_risk", "select o_orderkey as key, case when o_orderkey % 7 = 0 or o_custkey % 11 = 0 then null when o_orderstatus = 'P' then 'comment_only' when o_orderkey % 2 = 0 then 'format_only' when o_orderkey % 3 = 0 then 'rename' when o_orderkey % 5 = 0 then 'test_only' end as verdict from orders")(
    lambda s, d: (lambda o: C.low_risk(o.select(c("o_orderkey").alias("key"), (c("o_orderstatus") == "P").alias("comment_only"), (c("o_orderkey") % 2 == 0).alias("format_only"), (c("o_orderkey") % 3 == 0).alias("renamed_only"), (c("o_orderkey") % 5 == 0).alias("test"), (c("o_custkey") % 11 == 0).alias("degraded")), o.where("o_orderkey % 7 = 0").select(c("o_orderkey").alias("key"))))(table(s, d, "orders"))
)
query("g23_io_reachability", f"with e as (select distinct source, target from {M} where kind in ('calls', 'depends_on')), one as (select distinct source as k from e where target = 's:3') select k as node_key from one union select source from e where target in (select k from one)")(lambda s, d: C.two_hops(merged(s, d), keys(s, "s:3")))
query("g16_type_hierarchy", f"with recursive e as (select source as a, target as b from {M} where kind in ('contains', 'declares')), r(n, depth) as (select 'r:3', 0 union select e.b, depth + 1 from r join e on e.a = r.n where depth < 2) select n as node_key, min(depth)::int as depth from r group by 1")(lambda s, d: G.bfs(merged(s, d).where(c("kind").isin("contains", "declares")), keys(s, "r:3"), "out", 2, max_nodes=None)[0].select("node_key", "depth"))
query("g20_trust_boundary", f"with recursive e as (select target as a, source as b from {M} where kind in ('depends_on', 'calls')), r(n, depth) as (select 's:9', 0 union select e.b, depth + 1 from r join e on e.a = r.n where depth < 2), g as (select c_custkey from customer where c_acctbal > 5000) select n as entry, min(depth)::int as depth, substr(n, 3)::bigint in (select c_custkey from g) as guarded from r where n like 'c:%' group by 1")(
    lambda s, d: G.bfs(merged(s, d).where(c("kind").isin("depends_on", "calls")), keys(s, "s:9"), "in", 2, max_nodes=None)[0].where(F.startswith("node_key", F.lit("c:"))).join(table(s, d, "customer").where("c_acctbal > 5000").select(F.concat(F.lit("c:"), "c_custkey").alias("g")), c("node_key") == c("g"), "left").select(c("node_key").alias("entry"), "depth", c("g").isNotNull().alias("guarded"))
)
query("c12_expectation_assignment")(lambda s, d: (lambda o: V.assign(o.where("o_orderstatus = 'O'").select("o_custkey", c("o_orderkey").alias("a"), c("o_totalprice").alias("x")).join(o.where("o_orderstatus = 'F'").select("o_custkey", c("o_orderkey").alias("b"), c("o_totalprice").alias("y")), "o_custkey").select("a", "b", (1 / (1 + F.abs(c("x") - c("y")))).alias("similarity"))))(table(s, d, "orders")))
query("v15_container_pairs", "select x.n_nationkey as a, y.n_nationkey as b from nation x join nation y on x.n_regionkey = y.n_regionkey and x.n_nationkey % 2 = 0 and y.n_nationkey % 2 = 1")(lambda s, d: (lambda n: n.where("n_nationkey % 2 = 0").alias("x").join(n.where("n_nationkey % 2 = 1").alias("y"), "n_regionkey").select(c("x.n_nationkey").alias("a"), c("y.n_nationkey").alias("b")))(table(s, d, "nation")))
