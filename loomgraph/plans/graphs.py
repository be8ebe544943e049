"""Queries over the graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.operators import graph as G
from loomgraph.operators import schema
from loomgraph.plans.adapters import EDGES, MERGED_SQL, NODES, duck, spark_sql
from loomgraph.plans.catalog import query, table

nodes = lambda s, d: spark_sql(s, d, NODES)
edges = lambda s, d: spark_sql(s, d, EDGES)
merged = lambda s, d: G.merge_occurrences(edges(s, d))
keys = lambda s, *k: s.createDataFrame([(x,) for x in k], "node_key string")
E, N, M = f"({duck(EDGES)})", f"({duck(NODES)})", f"({MERGED_SQL})"
BOTH = f"(select source as a, target as b, kind, confidence from {M} union all select target, source, kind, confidence from {M})"

query("f1_edge_filter", f"select source, kind, target, confidence from {E} where kind in ('calls', 'depends_on') and confidence >= 600")(lambda s, d: edges(s, d).where(schema.edge_filter(["calls", "depends_on"], 600)).select("source", "kind", "target", "confidence"))
query("f2_selector_filters", f"select source, kind, target, 'out' as side from {E} where kind = 'contains' union all select source, kind, target, 'in' from {E} where kind = 'calls' and confidence >= 0")(
    lambda s, d: (lambda o, i: edges(s, d).where(o).select("source", "kind", "target", F.lit("out").alias("side")).unionByName(edges(s, d).where(i).select("source", "kind", "target", F.lit("in").alias("side"))))(*schema.selector_filters(["contains", "called_by"]))
)
query("f3_kind_sets", f"select node_key, array_to_string(list_sort(list(distinct kind)), ',') as kinds, count(distinct kind) as n, bool_or(kind = 'calls') as calls from (select source as node_key, kind from {E} union all select target, kind from {E}) group by 1")(
    lambda s, d: G.directed(edges(s, d), "both").groupBy(F.col("at").alias("node_key")).agg(F.collect_set("kind").alias("k")).select("node_key", F.array_join(F.sort_array("k"), ",").alias("kinds"), F.size("k").cast("long").alias("n"), F.arrays_overlap("k", F.array(F.lit("calls"))).alias("calls"))
)
query("f4_symbol_kind_filter", f"select node_key, kind from {N} where replace(lower(kind), '_', '') in ('function', 'class')")(lambda s, d: nodes(s, d).where(F.replace(F.lower("kind"), F.lit("_"), F.lit("")).isin("function", "class")).select("node_key", "kind"))
query("f18_schema_rules", f"select source, kind, target from {E} where not ((kind = 'contains' and source like 'r:%') or kind = 'calls')")(
    lambda s, d: edges(s, d).withColumn("sk", F.substring("source", 1, 1)).join(F.broadcast(s.createDataFrame([("contains", "r"), ("calls", "c")], "kind string, sk string")), ["kind", "sk"], "left_anti").select("source", "kind", "target")
)
query("f19_projection", f"select node_key as id, name as label, kind, coalesce(path, '') as file from {N}")(lambda s, d: nodes(s, d).select(F.col("node_key").alias("id"), F.col("name").alias("label"), "kind", F.coalesce("path", F.lit("")).alias("file")))
query("a1_degree", f"select node_key, count(*) as degree from (select source as node_key from {E} union all select target from {E}) group by 1")(lambda s, d: G.degree(edges(s, d)))
query("a2_kind_histogram", f"select node_key, side, kind, least(confidence // 100, 9)::int as bucket, count(*) as n from (select source as node_key, 'out' as side, kind, confidence from {E} union all select target, 'in', kind, confidence from {E}) group by 1, 2, 3, 4")(lambda s, d: G.kind_histogram(edges(s, d)))
query("a3_graph_statistics", f"select (select count(*) from {N}) as nodes, (select count(*) from {M}) as edges, (select count(distinct path) from {N}) as files")(
    lambda s, d: nodes(s, d).agg(F.count("*").alias("nodes"), F.countDistinct("path").alias("files")).crossJoin(merged(s, d).agg(F.count("*").alias("edges"))).select("nodes", "edges", "files")
)
query("a4_merge_occurrences", f"""select source, kind, target, max(confidence) as confidence, arg_min(resolved_by, (-confidence, resolved_by)) as resolved_by, bit_or(flags) as flags, sum(occurrences)::bigint as occurrences,
  min((path, line))[1] as path, min((path, line))[2] as line from {E} group by 1, 2, 3""")(merged)
query("g1_out_edges", f"select source as at, kind, target as other, row_number() over (partition by source order by case kind when 'contains' then 0 when 'declares' then 1 when 'calls' then 4 else 24 end, target) as rank from {M} where source in ('n:1', 'n:2', 'c:1')")(
    lambda s, d: G.adjacent(merged(s, d), keys(s, "n:1", "n:2", "c:1"), "out").select("at", "kind", "other", "rank")
)
query("g2_neighbours", f"with q as (select a, b from {BOTH} where a in ('n:1', 'p:5', 'r:0')) select a as node_key, b as neighbour from q union select a, a from q")(lambda s, d: G.neighbours(merged(s, d), keys(s, "n:1", "p:5", "r:0")))
query("g3_reverse_view", f"select target as node_key, source as called_by, confidence from {M} where kind = 'calls' and confidence >= 500")(lambda s, d: merged(s, d).where(schema.edge_filter(["calls"], 500)).select(F.col("target").alias("node_key"), F.col("source").alias("called_by"), "confidence"))
_BFS = "with recursive e as ({e}), r(node_key, depth) as (select unnest([{seeds}]), 0 union select e.b, r.depth + 1 from r join e on e.a = r.node_key where r.depth < {depth}) select node_key, min(depth)::int as depth from r group by 1"
query("g4_bounded_bfs", _BFS.format(e=f"select source as a, target as b from {M}", seeds="'r:1', 'n:3'", depth=3))(lambda s, d: G.bfs(merged(s, d), keys(s, "r:1", "n:3"), "out", 3, max_nodes=None)[0].select("node_key", "depth"))
query("g4_bounded_bfs_in", _BFS.format(e=f"select target as a, source as b from {M} where confidence >= 900", seeds="'s:7'", depth=2))(lambda s, d: G.bfs(merged(s, d).where("confidence >= 900"), keys(s, "s:7"), "in", 2, max_nodes=None)[0].select("node_key", "depth"))
query("g5_parents_are_edges", f"with recursive e as (select source as a, target as b from {M}), r(node_key, depth) as (select 'r:2', 0 union select e.b, r.depth + 1 from r join e on e.a = r.node_key where r.depth < 2) select node_key, min(depth)::int as depth, min(depth) = 0 or true as found from r group by 1")(
    lambda s, d: (lambda m: G.bfs(m, keys(s, "r:2"), "out", 2, max_nodes=None)[0].join(m.select(F.col("source").alias("s"), F.col("target").alias("t"), F.col("kind").alias("k")), (F.col("parent") == F.col("s")) & (F.col("node_key") == F.col("t")) & (F.col("kind") == F.col("k")), "left").select("node_key", "depth", ((F.col("depth") == 0) | F.col("s").isNotNull()).alias("found")))(merged(s, d))
)
# Of the ways of fewest hops from a region to a part the first: at each level a node is found by its earliest discovered parent, then kind.
query("g6_shortest_path", f"""with recursive e as (select source, kind, target, max(confidence) as confidence, case kind when 'contains' then 0 when 'declares' then 1 when 'calls' then 4 else 24 end as k from {M} where kind in ('contains', 'declares', 'calls') group by 1, 2, 3),
n as (select target as n, source as p, kind, confidence from e where source = 'r:0'), c as (select e.target as n, e.source as p, e.kind, e.confidence from e join n on n.n = e.source where e.target like 'c:%'),
l as (select e.target as n, min_by(e.source, (string_split(e.source, ':')[2], e.k)) as p from e join c on c.n = e.source where e.target = 'p:9' group by 1)
select count(*) as ways from l""")(lambda s, d: G.shortest_path(merged(s, d).where("kind in ('contains', 'declares', 'calls')"), "r:0", "p:9", max_depth=4).where("to = 'p:9'").agg(F.count("*").alias("ways")))
query("g7_path_confidence", "select o_custkey, coalesce(min(case when o_orderstatus = 'F' then cast(floor(o_totalprice) as int) % 1000 end), 1000) as confidence from orders group by 1")(
    lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.when(F.col("o_orderstatus") == "F", F.floor("o_totalprice").cast("int") % 1000)).alias("way")).select("o_custkey", G.path_confidence(F.col("way")).alias("confidence"))
)
query("g8_all_paths", f"""with recursive e as (select source, target, max(confidence) as c from {M} where kind <> 'depends_on' group by 1, 2),
r(nodes, c) as (select ['n:4'], 1000 union all select list_append(nodes, e.target), least(r.c, e.c) from r join e on e.source = nodes[-1] where len(nodes) < 4 and not list_contains(nodes, e.target) and nodes[-1] <> 'p:100')
select array_to_string(nodes, '>') as path, (len(nodes) - 1)::int as hops, c as confidence from r where nodes[-1] = 'p:100' order by hops, nodes limit 10""")(
    lambda s, d: G.all_paths(merged(s, d).where("kind <> 'depends_on'"), "n:4", "p:100", 3, 10).select(F.array_join("nodes", ">").alias("path"), "hops", "confidence")
)
query("g9_subgraph", f"with recursive e as (select source as a, target as b from {M} where kind in ('contains', 'declares')), r(n, depth) as (select 'n:5', 0 union select e.b, r.depth + 1 from r join e on e.a = r.n where r.depth < 1) select source, kind, target from {M} where kind in ('contains', 'declares') and source in (select n from r) and target in (select n from r)")(
    lambda s, d: G.subgraph(merged(s, d).where(F.col("kind").isin("contains", "declares")), keys(s, "n:5"), "out", 1, max_nodes=None)[1].select("source", "kind", "target")
)
query("g11_symbol_search", f"""select n.node_key, n.name, case when lower(name) = 'ab' or lower(qualified_name) = 'ab' then 0 when lower(name) like 'an%' or lower(qualified_name) like 'an%' then 1 else 2 end::int as rank, coalesce(g.degree, 0) as degree
from {N} n left join (select node_key, count(*) as degree from (select source as node_key from {M} union all select target from {M}) group by 1) g using (node_key)
where lower(name) like '%an%' or lower(qualified_name) like '%an%' order by rank, name, node_key limit 50""")(
    lambda s, d: G.search(nodes(s, d), merged(s, d), "an").select("node_key", "name", "rank", "degree")
)
query("g12_lookups", f"select node_key, name from {N} where path = 'n3' or node_key = 'r:1'")(lambda s, d: nodes(s, d).where("path = 'n3' or node_key = 'r:1'").select("node_key", "name"))
query("g15_widest_path", f"with recursive e as (select target as a, source as b, max(confidence) as c from {M} group by 1, 2), r(n, c, k) as (select 's:3', 1000, 0 union select e.b, least(r.c, e.c), k + 1 from r join e on e.a = r.n where k < 2) select n as node_key, max(c)::int as confidence from r group by 1")(
    lambda s, d: G.widest(merged(s, d), keys(s, "s:3"), "in", 2)
)
_MODULES = "select distinct 'c' || (o_custkey % 40) as source, 'c' || ((o_custkey * 7 + l_linenumber) % 40) as target from {orders} join {lineitem} on l_orderkey = o_orderkey"
query("g21_cycles", f"""with recursive e as ({duck(_MODULES)}), r(a, b) as (select source, target from e union select r.a, e.target from r join e on r.b = e.source),
s as (select x.a as n, least(x.a, min(x.b)) as component from r x join r y on x.a = y.b and x.b = y.a where x.a <> x.b group by x.a) select component, array_to_string(list_sort(list(n)), ',') as members from s group by 1""")(
    lambda s, d: G.cycles(spark_sql(s, d, _MODULES)).select("component", F.array_join("members", ",").alias("members"))
)
_LINKS = "select distinct 'x' || (l_orderkey % 500) as a, 'x' || (l_partkey % 500) as b from {lineitem}"
query("g22_components", f"""with recursive l as ({duck(_LINKS)}), e as (select a, b from l union select b, a from l), r(n, m) as (select a, a from e union select r.n, e.b from r join e on r.m = e.a) select n as node_key, min(m) as component from r where n in (select a from e where a <> b) group by 1""")(
    lambda s, d: G.components(spark_sql(s, d, _LINKS))
)
_CHAIN = "select 'k' || c_custkey as from_key, 'k' || (c_custkey + c_custkey % 3) as to_key from {customer} where c_custkey % 3 <> 0"
query("g24_lineage_follow", f"with recursive c as ({duck(_CHAIN)}), r(f, t, k) as (select from_key, to_key, 1 from c union all select r.f, c.to_key, k + 1 from r join c on r.t = c.from_key where k < 65) select f as from_key, arg_max(t, k) as to_key from r group by 1")(lambda s, d: G.follow(spark_sql(s, d, _CHAIN)))
query("v10_validate", f"""select 'duplicate_edge' as "check", 'error' as severity, source || '|' || kind || '|' || target as key from {E} group by source, kind, target having count(*) > 1
union all select 'orphan', 'warning', node_key from {N} where node_key not in (select source from {E} union select target from {E})""")(lambda s, d: G.validate(nodes(s, d), edges(s, d)))
_SIDES = ("select o_orderkey as k, o_orderstatus as a, round(o_totalprice) as b from {orders} where o_orderkey % 7 <> 0", "select o_orderkey as k, case when o_orderkey % 11 = 0 then 'X' else o_orderstatus end as a, round(o_totalprice) as b from {orders} where o_orderkey % 5 <> 0")
query("j15_graph_compare", f"""select coalesce(x.k, y.k) as k, case when y.k is null then 'only_a' when x.k is null then 'only_b' when x.a is distinct from y.a then 'changed' else 'same' end as status, case when x.k is not null and y.k is not null and x.a is distinct from y.a then 'a' else '' end as fields
from ({duck(_SIDES[0])}) x full join ({duck(_SIDES[1])}) y on x.k = y.k""")(lambda s, d: G.compare(spark_sql(s, d, _SIDES[0]), spark_sql(s, d, _SIDES[1]), ["k"], ["a", "b"]))
query("o6_orphan_pruning", f"select node_key from {N} where node_key in (select source from {E} union select target from {E})")(lambda s, d: nodes(s, d).join(edges(s, d).select(F.explode(F.array("source", "target")).alias("e")).distinct(), F.col("node_key") == F.col("e"), "left_semi").select("node_key"))
query("o7_kind_refinement", f"select node_key, case when node_key like 'p:%5' then 'endpoint' else kind end as kind from {N}")(
    lambda s, d: nodes(s, d).join(table(s, d, "part").where("p_partkey % 10 = 5").select(F.concat(F.lit("p:"), "p_partkey").alias("k"), F.lit("endpoint").alias("refined")), F.col("node_key") == F.col("k"), "left").select("node_key", F.coalesce("refined", "kind").alias("kind"))
)
query("o2_name_index", f"select name, array_to_string(list_sort(list(distinct node_key)), ',') as keys from {N} group by 1")(lambda s, d: nodes(s, d).groupBy("name").agg(F.array_join(F.sort_array(F.collect_set("node_key")), ",").alias("keys")))
query("w3_relation_cap", f"with r as (select target, source, confidence, row_number() over (partition by target order by confidence desc, source) as rn, count(*) over (partition by target) as n from {M} where kind = 'calls') select target, source, confidence, greatest(n - 5, 0) as dropped from r where rn <= 5")(
    lambda s, d: (lambda w: merged(s, d).where("kind = 'calls'").withColumn("rn", F.row_number().over(w.orderBy(F.desc("confidence"), "source"))).withColumn("dropped", F.greatest(F.count("*").over(w) - 5, F.lit(0))).where("rn <= 5").select("target", "source", "confidence", "dropped"))(Window.partitionBy("target"))
)
