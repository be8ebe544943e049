"""Queries over chains, differences and matches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import intervals as I
from loomgraph.operators import text_units as T
from loomgraph.operators import versioning as V
from loomgraph.plans.adapters import duck, spark_sql
from loomgraph.plans.catalog import query, table

# A chain: an order's lines are positions, its customer's parts are keys, returned lines are tombstones.
CHAIN = "select o_custkey % 500 as source, l_partkey % 200 as target, o_orderkey * 10 + l_linenumber as chain_pos, l_returnflag = 'R' as removed, cast(round(l_discount * 10000) as int) as confidence from {lineitem} join {orders} on l_orderkey = o_orderkey"
chain = lambda s, d: spark_sql(s, d, CHAIN)
_LIVE = f"(select source, target, arg_max(removed, (chain_pos, removed, confidence)) as removed, arg_max(confidence, (chain_pos, removed, confidence)) as confidence, max(chain_pos) as chain_pos from ({duck(CHAIN)}) group by 1, 2)"

query("neighbors_at_snapshot", f"select source, target, confidence from {_LIVE} where not removed and confidence >= 300 and source = 7 and target > 20 order by target limit 25")(
    lambda s, d: V.page(V.at_snapshot(chain(s, d), ["source", "target"], floor=F.col("confidence") >= 300).where("source = 7").select("source", "target", "confidence"), ["target"], [20], 25).drop("more")
)
query("j9_chain_join", f"select source, target, confidence from {_LIVE} where not removed and confidence >= 300")(lambda s, d: V.at_snapshot(chain(s, d), ["source", "target"], floor=F.col("confidence") >= 300).select("source", "target", "confidence"))
query("w1_latest_per_key", f"select source, target, removed, confidence from {_LIVE}")(lambda s, d: V.latest(chain(s, d), ["source", "target"], F.col("chain_pos")).select("source", "target", "removed", "confidence"))
query("w2_newest", "select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey from orders group by 1")(lambda s, d: V.latest(table(s, d, "orders"), ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey"))
query("s16_snapshot_full_read", f"select source, target from {_LIVE} where not removed")(lambda s, d: V.at_snapshot(chain(s, d), ["source", "target"]).select("source", "target"))
query("s17_snapshot_delta_read", f"select chain_pos, removed, count(*) as n from ({duck(CHAIN)}) where chain_pos % 10 = 3 group by 1, 2")(lambda s, d: chain(s, d).where("chain_pos % 10 = 3").groupBy("chain_pos", "removed").agg(F.count("*").alias("n")))
_BASE = "select o_orderkey as k, o_orderstatus as v from {orders} where o_orderkey % 3 <> 0"
_ADD = "select o_orderkey as k, 'N' as v from {orders} where o_orderkey % 4 = 0"
_GONE = "select o_orderkey as k from {orders} where o_orderkey % 5 = 0"
_FLAT = f"select k, v from ({duck(_BASE)}) where k not in ({duck(_GONE)}) and k % 4 <> 0 union all {duck(_ADD)}"
query("v1_flatten", _FLAT)(lambda s, d: V.flatten(spark_sql(s, d, _BASE), [(spark_sql(s, d, _ADD), spark_sql(s, d, _GONE))], ["k"]))
query("v3_overlay_read", f"select * from ({_FLAT}) where k % 2 = 0")(lambda s, d: V.overlay(spark_sql(s, d, _BASE), spark_sql(s, d, _ADD), spark_sql(s, d, _GONE), ["k"]).where("k % 2 = 0"))
query("v2_normalise", f"select source, target, min(confidence) as confidence from ({duck(CHAIN)}) group by 1, 2")(lambda s, d: chain(s, d).groupBy("source", "target").agg(F.min("confidence").alias("confidence")))
query("v5_touched_files", "select distinct l_partkey % 100 as path from lineitem where l_linestatus = 'F'")(lambda s, d: table(s, d, "lineitem").where("l_linestatus = 'F'").select((F.col("l_partkey") % 100).alias("path")).distinct())
query("a5_churn", "select o_custkey, case when sum(l_quantity) = 0 then 0 else sum(l_quantity) / max(o_totalprice) end as churn from orders join lineitem on l_orderkey = o_orderkey group by 1")(
    lambda s, d: table(s, d, "orders").join(table(s, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(V.churn(F.col("l_quantity"), F.lit(0), F.col("o_totalprice")).alias("churn"))
)
_CH = "select o_custkey, count(*)::int as depth, count(*) / 200.0 as ratio from orders group by 1"
query("v7_compaction_decision", f"select o_custkey, case when depth > 20 then 'chain_depth' when depth > 0 and ratio > 0.1 then 'churn' else 'keep' end as decision from ({_CH})")(lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).select("o_custkey", V.compaction(F.col("n"), F.col("n") / 200).alias("decision")))
query("v8_rebuild_decision", "select c_custkey, case when c_custkey % 4 = 3 then 'reparse' when c_custkey % 4 = 2 then 'relink' when c_custkey % 4 = 1 and c_custkey % 30 >= 20 then 'compact_then_incremental' when c_custkey % 4 = 0 and c_custkey % 30 >= 20 then 'compact_then_incremental' else 'incremental' end as decision from customer")(
    lambda s, d: table(s, d, "customer").select("c_custkey", V.rebuild(F.when(F.col("c_custkey") % 4 == 3, F.array(F.lit("linker_version_changed"), F.lit("explicit"))).when(F.col("c_custkey") % 4 == 2, F.array(F.lit("linker_version_changed"))).otherwise(F.array().cast("array<string>")), F.col("c_custkey") % 30, F.lit(0.0)).alias("decision"))
)
_STEPS = "select event_id, user_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as before from {events}"
query("v9_status_steps", f"select event_id, coalesce(before || '>' || event_type in ('view>click', 'click>purchase'), false) as legal from ({duck(_STEPS)})")(lambda s, d: spark_sql(s, d, _STEPS).select("event_id", F.coalesce(V.legal_step(F.col("before"), F.col("event_type"), (("view", "click"), ("click", "purchase"))), F.lit(False)).alias("legal")))
_NB, _NA, _NR = ("select p_name as name, cast(p_partkey as string) as key from {part} where p_partkey % 3 = 0", "select p_name as name, cast(p_partkey as string) as key from {part} where p_partkey % 7 = 1", "select p_name as name, cast(p_partkey as string) as key from {part} where p_partkey % 6 = 0")
query("v11_affected_names", f"""with b as (select distinct * from ({duck(_NB)})), a as (select * from ({duck(_NA)})), r as (select * from ({duck(_NR)})), n as (select name from a union select name from r),
x as (select n.name, list_sort(coalesce((select list(distinct key) from b where b.name = n.name), [])) as b, list_sort(coalesce((select list(distinct key) from (select * from b union select * from a) u where u.name = n.name and not exists (select 1 from r where r.name = u.name and r.key = u.key)), [])) as a from n)
select name, len(b)::int as before, len(a)::int as after, (len(b) <= 1 and len(a) >= 2) or (len(b) >= 2 and len(a) <= 1) or (len(b) <= 3) <> (len(a) <= 3) as crossed from x where a <> b""")(
    lambda s, d: V.affected_names(spark_sql(s, d, _NB), spark_sql(s, d, _NA), spark_sql(s, d, _NR))
)
_SB, _SH = ("select o_orderkey as k, o_orderstatus as a, o_orderpriority as b from {orders} where o_orderkey % 7 <> 0", "select o_orderkey as k, case when o_orderkey % 11 = 0 then 'X' else o_orderstatus end as a, o_orderpriority as b from {orders} where o_orderkey % 5 <> 0")
query("j13_symbol_diff", f"select coalesce(x.k, y.k) as k, case when y.k is null then 'removed' when x.k is null then 'added' when x.a <> y.a then 'modified' else 'unchanged' end as change, case when x.a <> y.a then 'a' else '' end as flags from ({duck(_SB)}) x full join ({duck(_SH)}) y on x.k = y.k")(
    lambda s, d: V.symbol_diff(spark_sql(s, d, _SB), spark_sql(s, d, _SH), "k", ["a", "b"])
)
query("j14_fact_multiset_diff", """with x as (select l_suppkey, l_returnflag, count(*) as n from lineitem where l_linestatus = 'F' group by 1, 2), y as (select l_suppkey, l_returnflag, count(*) as n from lineitem where l_linestatus = 'O' group by 1, 2)
select coalesce(x.l_suppkey, y.l_suppkey) as l_suppkey, coalesce(x.l_returnflag, y.l_returnflag) as l_returnflag, greatest(coalesce(x.n, 0) - coalesce(y.n, 0), 0) as removed, greatest(coalesce(y.n, 0) - coalesce(x.n, 0), 0) as added
from x full join y on x.l_suppkey = y.l_suppkey and x.l_returnflag = y.l_returnflag where coalesce(x.n, 0) <> coalesce(y.n, 0)""")(
    lambda s, d: V.multiset_diff(table(s, d, "lineitem").where("l_linestatus = 'F'"), table(s, d, "lineitem").where("l_linestatus = 'O'"), ["l_suppkey", "l_returnflag"])
)
for _n, _how, _sql in (("u1_added", "left_anti", "not in"), ("u1_unchanged", "left_semi", "in")):
    query(_n, f"select o_orderkey from orders where o_orderkey % 5 <> 0 and o_orderkey {_sql} (select o_orderkey from orders where o_orderkey % 7 <> 0)")(
        lambda s, d, how=_how: table(s, d, "orders").where("o_orderkey % 5 <> 0").join(table(s, d, "orders").where("o_orderkey % 7 <> 0"), "o_orderkey", how).select("o_orderkey")
    )
query("u2_multiset_difference", "select l_partkey, l_suppkey from lineitem where l_linestatus = 'F' except all select l_partkey, l_suppkey from lineitem where l_linestatus = 'O'")(lambda s, d: (lambda li: li.where("l_linestatus = 'F'").select("l_partkey", "l_suppkey").exceptAll(li.where("l_linestatus = 'O'").select("l_partkey", "l_suppkey")))(table(s, d, "lineitem")))
query("u5_coverage", "select distinct l_partkey from lineitem except select p_partkey from part where p_size < 25")(lambda s, d: table(s, d, "lineitem").select("l_partkey").subtract(table(s, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("l_partkey"))))
query("u6_name_overlay", "with x as (select o_custkey, list_sort(list(distinct o_orderpriority)) as a from orders group by 1) select o_custkey, array_to_string(list_filter(list_sort(list_distinct(list_append(a, 'new'))), lambda v: v <> '1-URGENT'), ',') as names from x")(
    lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("a")).select("o_custkey", F.array_join(F.sort_array(F.array_except(F.array_union("a", F.array(F.lit("new"))), F.array(F.lit("1-URGENT")))), ",").alias("names"))
)
query("u7_kind_set_algebra", "select l_orderkey, bit_or(1 << l_linenumber)::int as mask, bit_and(255 - (1 << l_linenumber))::int as rest from lineitem group by 1")(lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.bit_or(F.expr("shiftleft(1, l_linenumber)")).alias("mask"), F.bit_and(F.expr("255 - shiftleft(1, l_linenumber)")).alias("rest")))


def _symbols(s, d, side):
    docs = table(s, d, "documents").where(f"doc_id % 2 = {side}")
    t = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")
    return docs.select(F.col("doc_id").alias("key"), F.col("lang").alias("kind"), F.substring("text", 1, 12).alias("name"), F.col("source").alias("module"), F.md5("text").alias("body"), F.md5(F.substring("text", 1, 40)).alias("signature"), F.size(t).alias("tokens"), X.shingle_hashes(t).alias("shingles"))


_SYM = """(select doc_id as key, lang as kind, substr(text, 1, 12) as name, source as module, md5(text) as body, md5(substr(text, 1, 40)) as signature, len(t) as tokens,
 case when len(t) = 0 then [] else list_sort(list_distinct(list_transform(range(1, greatest(len(t) - 2, 1) + 1), lambda i: ('0x' || substr(md5(array_to_string(t[i:i+2], ' ')), 1, 7))::bigint))) end as shingles
 from (select *, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') as t from documents))"""
_CAND = f"""with s as {_SYM}, h as (select key, kind, 'b' || body as block from s union select key, kind, 's' || signature from s union select key, kind, 'h' || unnest(shingles[1:4]) from s),
m as (select distinct x.key as a, y.key as b from h x join h y on x.kind = y.kind and x.block = y.block and x.key % 2 = 0 and y.key % 2 = 1),
j as (select p.*, m.a, m.b, q.body as qb, q.signature as qs, q.name as qn, q.module as qm, least(p.tokens, q.tokens) as n, case when len(p.shingles) + len(q.shingles) = 0 then 1.0 else len(list_intersect(p.shingles, q.shingles)) / (len(p.shingles) + len(q.shingles) - len(list_intersect(p.shingles, q.shingles))) end as jac
 from m join s p on p.key = m.a join s q on q.key = m.b),
c as (select a, b, case when body = qb and n >= 6 then 'exact_body' when signature = qs and name = qn and module <> qm and n >= 12 then 'signature_and_name' when jac >= 0.8 and n >= 12 then 'token_similarity' end as rule, case when body = qb and n >= 6 then 1.0 when signature = qs and name = qn and module <> qm and n >= 12 then greatest(jac, 0.8) else jac end as similarity from j)
"""
query("v12_rename_rules", _CAND + "select a, b, rule, round(similarity, 6) as similarity from c where rule is not null")(lambda s, d: V.rename_candidates(_symbols(s, d, 0), _symbols(s, d, 1)).withColumn("similarity", F.round("similarity", 6)))
query("v13_assignment")(lambda s, d: V.assign(V.rename_candidates(_symbols(s, d, 0), _symbols(s, d, 1))))
query("v14_ambiguous", _CAND + ", r as (select *, rank() over (partition by a order by similarity desc) as r from c where rule is not null) select a from r where r = 1 group by 1 having count(*) > 1")(
    lambda s, d: (lambda c: c.withColumn("r", F.rank().over(Window.partitionBy("a").orderBy(F.desc("similarity")))).where("r = 1").groupBy("a").count().where("count > 1").select("a"))(V.rename_candidates(_symbols(s, d, 0), _symbols(s, d, 1)))
)
query("w6_runner_up_margin", _CAND + ", r as (select *, row_number() over (partition by a order by similarity desc, b) as r, lead(similarity) over (partition by a order by similarity desc, b) as nxt from c where rule is not null) select a, b, round(similarity - nxt, 6) as margin from r where r = 1")(
    lambda s, d: (lambda W: V.rename_candidates(_symbols(s, d, 0), _symbols(s, d, 1)).withColumn("r", F.row_number().over(W)).withColumn("n", F.lead("similarity").over(W)).where("r = 1").select("a", "b", F.round(F.col("similarity") - F.col("n"), 6).alias("margin")))(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))
)
query("v16_transition", "select p_partkey, case when p_partkey % 2 = 0 and p_size > 25 then 'renamed_and_moved' when p_partkey % 2 = 0 then 'renamed' when p_size > 25 then 'moved' else 'same' end as t from part")(
    lambda s, d: table(s, d, "part").select("p_partkey", V.transition(F.col("p_partkey") % 2, F.lit(1), (F.col("p_size") > 25), F.lit(False)).alias("t"))
)
query("v18_snapshot_ids", "select o_custkey, array_to_string((list_filter(x, lambda v: v <> 'k') || ['k'])[-5:], ',') as ids from (select o_custkey, list_sort(list('k' || o_orderkey)) as x from orders group by 1)")(
    lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.concat(F.lit("k"), F.col("o_orderkey")))).alias("x")).select("o_custkey", F.array_join(V.merge_ids(F.col("x"), F.lit("k"), 5), ",").alias("ids"))
)
query("v19_dead_points", "select vec_id from embeddings where not (label % 3 = 0 or vec_id % 5 = 0)")(lambda s, d: table(s, d, "embeddings").where(~F.arrays_overlap(F.array(F.col("label") % 3, (F.col("vec_id") % 5 + 10).cast("int")), F.array(F.lit(0), F.lit(10)))).select("vec_id"))
query("v20_rereview", "select coalesce(c.id, p.id) as identity, case when c.id is not null and p.id is not null then 'persisting' when c.id is not null then 'new' when p.id % 3 = 0 then 'fixed' else 'not_reevaluated' end as status from (select o_orderkey as id from orders where o_orderkey % 4 <> 0) c full join (select o_orderkey as id from orders where o_orderkey % 5 <> 0) p on c.id = p.id")(
    lambda s, d: (lambda o: V.rereview(o.where("identity % 4 <> 0"), o.where("identity % 5 <> 0"), o.where("identity % 3 = 0")))(table(s, d, "orders").select(F.col("o_orderkey").alias("identity")))
)
query("v21_post_verdict_dedup", "select o_orderkey, o_orderstatus from orders where (o_orderkey, o_orderstatus) not in (select o_orderkey, 'F' from orders where o_orderkey % 2 = 0)")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", "o_orderstatus").join(table(s, d, "orders").where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("F").alias("o_orderstatus")), ["o_orderkey", "o_orderstatus"], "left_anti")
)
# Lines and ranges
_RANGES = "select o_custkey as k, o_orderkey % 400 as start, o_orderkey % 400 + 5 as end from orders"
query("w9_range_merge", f"""with r as (select k, start, "end" as e from ({_RANGES.replace('as end', 'as "end"')})), g as (select *, case when max(e) over w is null or start > max(e) over w then 1 else 0 end as new from r window w as (partition by k order by start, e rows between unbounded preceding and 1 preceding)),
i as (select *, sum(new) over (partition by k order by start, e rows unbounded preceding) as g from g) select k, min(start) as start, max(e) as "end", count(*) as n from i group by k, g""")(lambda s, d: I.islands(spark_sql(s, d, "select o_custkey as k, o_orderkey % 400 as start, o_orderkey % 400 + 5 as `end` from {orders}"), ["k"]))
query("w8_hunk_grouping", f"""with r as (select k, start, "end" as e from ({_RANGES.replace('as end', 'as "end"')})), g as (select *, case when max(e) over w is null or start > max(e) over w + 6 then 1 else 0 end as new from r window w as (partition by k order by start, e rows between unbounded preceding and 1 preceding)),
i as (select *, sum(new) over (partition by k order by start, e rows unbounded preceding) as g from g) select k, min(start) as start, max(e) as "end", count(*) as n from i group by k, g""")(lambda s, d: I.islands(spark_sql(s, d, "select o_custkey as k, o_orderkey % 400 as start, o_orderkey % 400 + 5 as `end` from {orders}"), ["k"], gap=6))
_SYMS = "select o_custkey as k, cast(o_orderkey % 100 as int) as start, cast(o_orderkey % 100 + o_orderkey % 37 as int) as `end`, o_orderkey as symbol from {orders}"
_LINES = "select c_custkey as k, cast(c_custkey % 120 as int) as line from {customer}"
query("j12_innermost_symbol", f"""with s as ({duck(_SYMS).replace('`end`', 'e')}), l as ({duck(_LINES)}), j as (select l.k, l.line, s.symbol, row_number() over (partition by l.k, l.line order by s.start desc, s.e, s.symbol) as rn from l left join s on l.k = s.k and l.line between s.start and s.e)
select k, line, symbol from j where rn = 1""")(lambda s, d: I.innermost(spark_sql(s, d, _LINES), spark_sql(s, d, _SYMS), "k"))
query("j28_nearest_line", f"""with l as ({duck(_LINES)}), t as (select o_custkey as k, cast(o_orderkey % 120 as int) as t from orders) select l.k, l.line, (select t from t where t.k = l.k and abs(t - l.line) <= 10 order by abs(t - l.line), t limit 1) as nearest from l""")(
    lambda s, d: I.nearest(spark_sql(s, d, _LINES), spark_sql(s, d, "select o_custkey as k, cast(o_orderkey % 120 as int) as line from {orders}"), "k", 10)
)
query("s21_patch_lines", """select c_custkey, kind, sum(old_no)::bigint as old_no, sum(new_no)::bigint as new_no, count(*) as n from (select c_custkey, unnest(['context', 'del', 'add', 'add', 'context']) as kind, unnest([c_custkey, c_custkey + 1, null, null, c_custkey + 2]) as old_no, unnest([c_custkey + 3, null, c_custkey + 4, c_custkey + 5, c_custkey + 6]) as new_no from customer) group by 1, 2""")(
    lambda s, d: I.parse_patch(table(s, d, "customer").select("c_custkey", F.concat(F.lit("--- a\n+++ b\n@@ -"), "c_custkey", F.lit(",3 +"), F.col("c_custkey") + 3, F.lit(",4 @@\n x\n-y\n+z\n+w\n v")).alias("p")), "c_custkey", "p").groupBy("c_custkey", "kind").agg(F.sum("old_no").alias("old_no"), F.sum("new_no").alias("new_no"), F.count("*").alias("n"))
)
query("a24_diff_stats", "select l_orderkey, count(*) filter (l_returnflag = 'A') as additions, count(*) filter (l_returnflag = 'R') as deletions from lineitem group by 1")(lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("additions"), F.count_if(F.col("l_returnflag") == "R").alias("deletions")))
query("w11_ordinals", "select p_partkey, (row_number() over (partition by p_name, p_brand order by p_partkey) - 1)::int as ordinal from part")(lambda s, d: table(s, d, "part").select("p_partkey", (F.row_number().over(Window.partitionBy("p_name", "p_brand").orderBy("p_partkey")) - 1).alias("ordinal")))
query("w10_line_windows", """select doc_id, w[1]::int as start, w[2]::int as "end" from (select doc_id, n, unnest(list_transform(range(0, greatest(((n - 60) + 49) // 50, 0) + 1), lambda i: [i * 50, least(i * 50 + 60, n)])) as w from (select doc_id, len(string_split(text, chr(10))) * 17 as n from documents))""")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.explode(T.line_windows(F.size(F.split("text", "\n")) * 17)).alias("w")).select("doc_id", "w.start", "w.end")
)
