"""Queries of risk, ranking, selection, merging, evaluation, joins, queues and series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import numbers as N
from loomgraph.functions import text as X
from loomgraph.operators import intervals as I
from loomgraph.operators import queue as Q
from loomgraph.operators import review as R
from loomgraph.operators import vector as E
from loomgraph.operators.common import ranked
from loomgraph.plans.catalog import query, table

c = F.col
ev = lambda s, d: table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
_RULES = "(values " + ", ".join(f"('{a}', '{b}', {w}, {'null' if f is None else repr(f)})" for a, b, w, f in R.RULES) + ") as rules(rule, category, weight, floor)"
_NAMES = "[" + ", ".join(f"'{r[0]}'" for r in R.RULES) + "]"
# Signals: a line is a signal of a rule about its order.
_SIG = f"(select l_orderkey as subject, {_NAMES}[(l_partkey % {len(R.RULES)})::int + 1] as rule, l_linenumber / 7.0::double as confidence, l_linenumber as explanation, l_returnflag = 'R' as low_risk from lineitem)"


def signals(s, d):
    names = F.array(*(F.lit(r[0]) for r in R.RULES))
    li = table(s, d, "lineitem").select(c("l_orderkey").alias("subject"), F.get(names, (c("l_partkey") % len(R.RULES)).cast("int")).alias("rule"), (c("l_linenumber") / 7.0).alias("confidence"), c("l_linenumber").alias("explanation"), (c("l_returnflag") == "R").alias("low_risk"))
    return li.join(R.rule_table(s), "rule").withColumn("from_path", F.startswith("rule", F.lit("path.")))


_LV = "case {} when 'critical' then 3 when 'high' then 2 when 'medium' then 1 when 'low' then 0 end"
_DEDUP = f"select rule, subject, category, max(confidence) as confidence, arg_max(explanation, (confidence, explanation)) as explanation, max(weight) as weight, any_value(floor) as floor from {_SIG} join {_RULES} using (rule) group by 1, 2, 3"
query("a10_signal_dedup", _DEDUP.replace("max(weight) as weight", "max(weight)::double as weight"))(lambda s, d: R.dedup_signals(signals(s, d)))
_CON = f"""(select x.*, round(least(greatest(weight * confidence * case when category in ('authorization', 'authentication', 'validation') and r.subject is not null then 1.15 else 1 end * case when low_risk and rule like 'path.%' then 0.3 else 1 end, 0), 0.95), 4) as contribution
from (select * from {_SIG} join {_RULES} using (rule)) x left join (select distinct subject from {_SIG} where rule = 'endpoint.reachable') r on x.subject = r.subject)"""
query("a9_contribution", f"select subject, rule, sum(round(contribution * 10000))::bigint as total from {_CON} group by 1, 2")(lambda s, d: R.contributions(signals(s, d)).groupBy("subject", "rule").agg(F.sum(F.round(c("contribution") * 10000).cast("long")).alias("total")))
_SCORE = f"""with p as (select subject, category, max(contribution) as con, max({_LV.format('floor')}) as f from {_CON} group by 1, 2), s as (select subject, 1 - product(1 - con) as raw, max(f) as f from p group by 1),
l as (select *, greatest(case when raw >= 0.75 then 3 when raw >= 0.5 then 2 when raw >= 0.25 then 1 else 0 end, coalesce(f, -1)) as lv from s)
select subject, floor(greatest(raw, case when f is null then 0 else [0, 0.25, 0.5, 0.75][lv + 1] end)::double * 10000 + 0.5000001)::bigint as score, ['low', 'medium', 'high', 'critical'][lv + 1] as level from l"""
query("a7_risk_score", _SCORE)(lambda s, d: R.risk_scores(R.contributions(signals(s, d)), digits=15).withColumn("score", F.floor(c("score") * 10000 + 0.5000001)))
query("a6_noisy_or", "select l_orderkey, round(1 - product(1 - l_discount), 6) as score from lineitem group by 1")(lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.round(1 - F.product(1 - c("l_discount")), 6).alias("score")))
query("r7_levels", "select o_orderkey, case when o_totalprice / 500000 >= 0.75 then 'critical' when o_totalprice / 500000 >= 0.5 then 'high' when o_totalprice / 500000 >= 0.25 then 'medium' else 'low' end as level from orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", N.risk_level(c("o_totalprice") / 500000).alias("level")))
query("r6_rules", f"select rule, category, weight::double as weight, floor from {_RULES}")(lambda s, d: R.rule_table(s))
query("r15_untested", "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)")(lambda s, d: table(s, d, "part").join(table(s, d, "lineitem").where("l_quantity > 45"), c("p_partkey") == c("l_partkey"), "left_anti").select("p_partkey"))
query("r17_publication", "select o_orderkey, case when o_orderstatus = 'O' and o_orderkey % 3 = 0 then 'success' when o_orderstatus = 'O' then 'neutral' end as conclusion from orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", F.when(c("o_orderstatus") == "O", F.when(c("o_orderkey") % 3 == 0, "success").otherwise("neutral")).alias("conclusion")))
_SEV = "['info', 'low', 'medium', 'high', 'critical'][(o_orderkey % 5)::int + 1]"
query("t5_priority", """select o_orderkey, round((0.35 * (o_orderkey % 5) / 4 + 0.2 * least(round(o_totalprice / 400000, 2), 1) + 0.15 * greatest(o_orderkey % 7 / 7.0, o_orderkey % 3 / 3.0) + 0.1 * (o_orderkey % 2) + 0.08 * 0.5 + 0.07 * least(log2(1 + o_custkey) / log2(33), 1) + 0.05 * (o_custkey % 2))::double, 4) as p from orders""")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", R.priority(F.get(F.array(*map(F.lit, ("info", "low", "medium", "high", "critical"))), (c("o_orderkey") % 5).cast("int")), F.round(c("o_totalprice") / 400000, 2), c("o_custkey"), c("o_orderkey") % 2 * F.lit(1.0), c("o_orderkey") % 7 / 7.0, c("o_orderkey") % 3 / 3.0, c("o_custkey") % 2 * F.lit(1.0), F.lit(0.5)).alias("p"))
)
_W = {k: v for k, v in R.CONTEXT_WEIGHTS.items()}
_REV = "['correctness', 'security', 'test', 'architecture', 'performance', 'maintainability'][(o_orderkey % 6)::int + 1]"
_SUM = " + ".join(f"[{', '.join(str(v[i]) for v in _W.values())}][(o_orderkey % 6)::int + 1] * ((o_orderkey * {i + 3}) % 11 / 10.0)" for i in range(10))


def _context(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", F.get(F.array(*map(F.lit, _W)), (c("o_orderkey") % 6).cast("int")).alias("reviewer"), *(((c("o_orderkey") * (i + 3)) % 11 / 10.0).alias(n) for i, n in enumerate(R.SIGNALS)))
    return o.withColumn("score", R.context_score(c("reviewer"), c("o_custkey") % 10 / 10.0, c("o_custkey") % 2 == 0))


query("t7_context_score", f"select o_orderkey, round(({_SUM}) * (0.5 + 0.5 * (o_custkey % 10 / 10.0)) * case when o_custkey % 2 = 0 then 0.7 else 1 end, 5) as score from orders")(lambda s, d: _context(s, d).select("o_orderkey", F.round("score", 5).alias("score")))
query("f16_distance_gate", """select o_orderkey, case o_custkey % 6 when 0 then 'pass' when 1 then case when sc >= 0.2 then 'pass' else 'below' end when 2 then case when sc >= 0.35 then 'pass' else 'below' end when 3 then case when sc >= 0.5 and o_orderkey % 3 >= 2 then 'pass' when sc < 0.5 then 'below' else 'distance' end else case when o_orderkey % 2 = 0 then 'pass' else 'distance' end end as gate
from (select *, o_orderkey % 100 / 100.0 as sc from orders)""")(lambda s, d: table(s, d, "orders").select("o_orderkey", R.context_gate(c("o_custkey") % 6, c("o_orderkey") % 100 / 100.0, c("o_orderkey") % 3, F.lit(False), F.when(c("o_orderkey") % 2 == 0, "test").otherwise("doc")).alias("gate")))
query("t8_weights_valid", "select 6 as reviewers, true as valid")(lambda s, d: s.createDataFrame([(k, float(x)) for k, v in _W.items() for x in v], "reviewer string, w double").groupBy("reviewer").agg(F.abs(F.sum("w") - 1).alias("off"), F.max("w").alias("m")).agg(F.count("*").cast("int").alias("reviewers"), F.bool_and((c("off") < 1e-9) & (c("m") <= 0.35)).alias("valid")))
_ITEMS = """select l_orderkey as cluster, l_linenumber || ':' || l_partkey as item, l_discount as score, l_quantity::int as tokens, case when l_tax > 0.04 then floor(l_quantity / 2)::int end as cheaper, l_linenumber <= 3 as pinned, l_returnflag as category,
  case l_linenumber when 3 then 1 when 2 then 2 when 1 then 3 else 4 end as first from lineitem"""
query("t9_greedy_selection", f"""with recursive o as (select *, row_number() over (partition by cluster order by first, case when pinned then 0 else -score / greatest(tokens, 1) end, -score, item) as rn from ({_ITEMS})),
r as (select cluster, rn, item, 90 as room, 1 as of_r, null::varchar as reason, null::int as taken from (select distinct cluster, 0::bigint as rn, ''::varchar as item from o)
union all select o.cluster, o.rn, o.item, r.room - coalesce(x.cost, 0), r.of_r - (x.cost is not null and o.category = 'R')::int, x.reason, x.cost from r join o on o.cluster = r.cluster and o.rn = r.rn + 1,
  lateral (select case when o.category = 'R' and r.of_r <= 0 then 'count' when o.tokens <= r.room or (o.cheaper <= r.room and (o.pinned or o.score >= 0.5)) then 'selected' else 'tokens' end as reason,
    case when o.category = 'R' and r.of_r <= 0 then null when o.tokens <= r.room then o.tokens when o.cheaper <= r.room and (o.pinned or o.score >= 0.5) then o.cheaper end as cost) x)
select cluster, item, taken::bigint as taken, reason from r where rn > 0""")(
    lambda s, d: R.select_greedy(
        table(s, d, "lineitem").select(
            c("l_orderkey").alias("cluster"), F.concat_ws(":", "l_linenumber", "l_partkey").alias("item"), c("l_discount").alias("score"), c("l_quantity").cast("int").alias("tokens"), F.when(c("l_tax") > 0.04, (c("l_quantity") / 2).cast("int")).alias("cheaper_tokens"),
            (c("l_linenumber") <= 3).alias("pinned"), c("l_returnflag").alias("category"), F.when(c("l_linenumber") == 3, "changed_symbol").when(c("l_linenumber") == 2, "class_signature").otherwise("other").alias("kind"),
        ), ["cluster"], 90, {"R": 1},
    )
)
query("t1_neighbour_page", "select l_partkey, l_suppkey, l_quantity from lineitem where (l_partkey, l_suppkey) > (30, 5) order by l_partkey, l_suppkey, l_quantity limit 40")(
    lambda s, d: table(s, d, "lineitem").where(F.struct("l_partkey", "l_suppkey") > F.struct(F.lit(30).cast("long").alias("l_partkey"), F.lit(5).cast("long").alias("l_suppkey"))).orderBy("l_partkey", "l_suppkey", "l_quantity").limit(40).select("l_partkey", "l_suppkey", "l_quantity")
)
query("t2_time_page", "select o_orderkey from orders where (o_orderdate, o_orderkey) < (timestamp '1996-01-01', 5000) order by o_orderdate desc, o_orderkey desc limit 51")(
    lambda s, d: table(s, d, "orders").where(F.struct(c("o_orderdate").cast("timestamp"), "o_orderkey") < F.struct(F.lit("1996-01-01").cast("timestamp").alias("o_orderdate"), F.lit(5000).cast("long").alias("o_orderkey"))).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(51).select("o_orderkey")
)
query("t3_finding_order", "select o_orderkey, row_number() over (order by o_orderpriority, o_totalprice desc nulls last, o_orderdate, o_orderkey)::int as n from orders")(lambda s, d: ranked(table(s, d, "orders"), c("o_orderpriority"), F.desc_nulls_last("o_totalprice"), c("o_orderdate"), c("o_orderkey")).select("o_orderkey", "n"))
query("t4_publishable_order", "select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey)::int as number from orders where o_orderstatus <> 'F'")(lambda s, d: table(s, d, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("number")))
query("t12_candidate_cap", "select o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 3 as kept from orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", (F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")) <= 3).alias("kept")))
query("t14_job_claim", "select user_id, event_id from (select *, row_number() over (partition by user_id order by value desc, ts, event_id) as rn from events) where rn = 1")(lambda s, d: Q.claim(ev(s, d), "user_id", F.desc("value"), c("ts"), c("event_id")).select("user_id", "event_id"))
query("t15_failed_sample", "select o_orderkey from orders where o_orderstatus = 'F' order by o_orderkey limit 20")(lambda s, d: table(s, d, "orders").where("o_orderstatus = 'F'").orderBy("o_orderkey").limit(20).select("o_orderkey"))
# Merging and evaluation
query("c6_range_jaccard", "select o_orderkey, round(greatest(0, 11 - o_orderkey % 15) / (22 - greatest(0, 11 - o_orderkey % 15)), 6)::double as j from orders")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", F.round(I.range_jaccard(F.expr("array(named_struct('start', 0L, 'end', 10L))"), F.expr("array(named_struct('start', o_orderkey % 15, 'end', o_orderkey % 15 + 10))")), 6).alias("j"))
)
query("c7_claim_jaccard", "select conv_id, turn, case when len(a) = 0 then 1.0 else 1.0 end as j from (select conv_id, turn, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') as a from conversations)")(lambda s, d: table(s, d, "conversations").select("conv_id", "turn", N.jaccard(X.claim_tokens(c("text")), X.claim_tokens(c("text"))).alias("j")))
query("c3_shared_table_links", "select l_suppkey, l_partkey as a, lead(l_partkey) over (partition by l_suppkey order by l_partkey) as b from (select distinct l_suppkey, l_partkey from lineitem where l_quantity > 48) qualify b is not null".replace("select l_suppkey, l_partkey as a", "select l_partkey as a"))(lambda s, d: R.consecutive_links(table(s, d, "lineitem").where("l_quantity > 48"), "l_suppkey", "l_partkey"))
query("c4_cluster_key", "select o_custkey, sha256(string_agg('o' || o_orderkey, ',' order by 'o' || o_orderkey)) as k from orders group by 1")(lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(R.cluster_key(F.collect_list(F.concat(F.lit("o"), "o_orderkey"))).alias("k")))
query("c10_fingerprint", "select doc_id, substr(sha256('5:claim' || length(source) || ':' || source || '32:' || md5(text)), 1, 32) as f from documents")(lambda s, d: table(s, d, "documents").select("doc_id", F.substring(X.content_hash(F.lit("claim"), c("source"), F.md5("text")), 1, 32).alias("f")))
query("c5_merge_groups")(lambda s, d: R.merge_groups(table(s, d, "orders").select(c("o_orderkey").alias("id"), F.md5(F.concat_ws(":", "o_custkey", "o_orderpriority")).alias("fingerprint"), c("o_custkey").cast("string").alias("symbol"), c("o_orderstatus").alias("predicate"), F.expr("array(named_struct('start', o_orderkey % 30, 'end', o_orderkey % 30 + 8))").alias("ranges"), (c("o_orderkey") % 30).alias("start"), (c("o_orderkey") % 30 + 8).alias("end"), F.split("o_orderpriority", "-").alias("tokens"), F.round(c("o_totalprice") / 1e6, 3).alias("confidence"), (c("o_orderkey") % 5).alias("severity"), (c("o_orderkey") % 3).alias("evidence"))))
query("a12_conventions", """with g as (select l_suppkey, count(*) as n, avg((l_tax > 0.005)::int) as consistency, count(distinct l_returnflag) as modules from lineitem group by 1)
select l_suppkey, n, consistency, modules, round(consistency * least(1, ln(1 + n) / ln(31)) * least(1, modules / 3), 6) as confidence, round(consistency * least(1, ln(1 + n) / ln(31)) * least(1, modules / 3), 6) >= 0.9 and n >= 10 as enforceable from g""")(
    lambda s, d: R.conventions(table(s, d, "lineitem").select("l_suppkey", (c("l_tax") > 0.005).alias("conforms"), c("l_returnflag").alias("module")), ["l_suppkey"])
)
query("a14_evaluation", """with m as (select count(*) filter (quality = 1 and toxic = 0) as tp, count(*) filter (quality = 0) as fp, count(*) filter (toxic = 1) as dup, count(*) filter (doc_id % 2 = 0) as expected, count(*) filter (doc_id % 2 = 0 and quality = 1) as hit, count(*) as n from labels), z as (select *, tp / (tp + fp) as p, tp + fp as t, 1.959963984540054 as z from m)
select p as precision, tp / (tp + fp + dup) as precision_strict, hit / expected as recall, fp / n as fp_rate, round(greatest((p + z * z / (2 * t) - z * sqrt(p * (1 - p) / t + z * z / (4 * t * t))) / (1 + z * z / t), 0), 9) as precision_low, round(least((p + z * z / (2 * t) + z * sqrt(p * (1 - p) / t + z * z / (4 * t * t))) / (1 + z * z / t), 1), 9) as precision_high from z""")(
    lambda s, d: R.evaluation(table(s, d, "labels").select(((c("quality") == 1) & (c("toxic") == 0)).alias("tp"), (c("quality") == 0).alias("fp"), (c("toxic") == 1).alias("dup"), (c("doc_id") % 2 == 0).alias("expected"), ((c("doc_id") % 2 == 0) & (c("quality") == 1)).alias("hit")))
)
query("a16_percentiles", "select event_type, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.5) as p50 from events group by 1")(lambda s, d: ev(s, d).groupBy("event_type").agg(F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"), F.expr("percentile_disc(0.5) within group (order by value)").alias("p50")))
query("a17_regression_gate", "with m as (select event_type, avg(value) as v from events where day(ts) <= 15 group by 1), n as (select event_type, avg(value) as w from events where day(ts) > 15 group by 1) select event_type from m join n using (event_type) where w > v * 1.01")(
    lambda s, d: ev(s, d).where("day(ts) <= 15").groupBy("event_type").agg(F.avg("value").alias("v")).join(ev(s, d).where("day(ts) > 15").groupBy("event_type").agg(F.avg("value").alias("w")), "event_type").where("w > v * 1.01").select("event_type")
)
query("a18_recall", "select o_custkey, case when len(t) = 0 then 1.0 else len(list_intersect(t, g)) / len(t) end as r from (select o_custkey, coalesce(list(o_orderkey) filter (o_orderkey % 2 = 0), []) as t, coalesce(list(o_orderkey) filter (o_orderkey % 3 = 0), []) as g from orders group by 1)")(
    lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(E.recall_at_k(F.collect_list(F.when(c("o_orderkey") % 2 == 0, c("o_orderkey"))), F.collect_list(F.when(c("o_orderkey") % 3 == 0, c("o_orderkey")))).alias("r"))
)
query("a11_language_statistics", "select lang, count(*) as files, sum(strlen(text))::bigint as bytes, max(n_chars) as longest, arg_max(doc_id, (n_chars, doc_id)) as largest from documents group by 1")(lambda s, d: table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"), F.max("n_chars").alias("longest"), F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("largest")))
query("a13_scope_narrowing", "with g as (select l_suppkey, l_returnflag, avg((l_tax > 0.02)::int) as k from lineitem group by 1, 2) select l_suppkey, coalesce(min(l_returnflag) filter (k >= 0.8), '**') as scope from g group by 1")(lambda s, d: table(s, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg((c("l_tax") > 0.02).cast("int")).alias("k")).groupBy("l_suppkey").agg(F.coalesce(F.min(F.when(c("k") >= 0.8, c("l_returnflag"))), F.lit("**")).alias("scope")))
query("a19_state_counts", "select coalesce(o_orderstatus, 'all') as state, count(*) as n from orders group by rollup (o_orderstatus)")(lambda s, d: table(s, d, "orders").rollup("o_orderstatus").count().select(F.coalesce("o_orderstatus", F.lit("all")).alias("state"), c("count").alias("n")))
query("a20_queue_depth", "select event_type, count(*) filter (value > 50) as queued from events group by 1")(lambda s, d: ev(s, d).groupBy("event_type").agg(F.count_if(c("value") > 50).alias("queued")))
query("a21_feedback_rates", "select coalesce(d.source, 'all') as reviewer, count(*) as n, avg(quality) as accepted, avg(toxic) as false_positive from labels l join documents d using (doc_id) group by rollup (d.source)")(lambda s, d: table(s, d, "labels").join(table(s, d, "documents"), "doc_id").rollup("source").agg(F.count("*").alias("n"), F.avg("quality").alias("accepted"), F.avg("toxic").alias("false_positive")).select(F.coalesce("source", F.lit("all")).alias("reviewer"), "n", "accepted", "false_positive"))
query("a22_cost_total", "select l_returnflag, sum(cast(round(l_quantity * 1000 * case l_returnflag when 'A' then 3 when 'N' then 5 else 2 end) as bigint))::bigint as micros from lineitem group by 1")(lambda s, d: table(s, d, "lineitem").join(F.broadcast(s.createDataFrame([("A", 3), ("N", 5), ("R", 2)], "l_returnflag string, price int")), "l_returnflag").groupBy("l_returnflag").agg(F.sum(F.round(c("l_quantity") * 1000 * c("price")).cast("long")).alias("micros")))
query("a23_agreement", "select o_custkey, least((count(distinct o_orderpriority) - 1) / 2, 1)::double as agreement from orders group by 1")(lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.least((F.countDistinct("o_orderpriority") - 1) / 2, F.lit(1.0)).alias("agreement")))
query("a26_tolerance", "select l_suppkey from lineitem group by 1 having count(*) filter (l_returnflag = 'R') / count(*) > 0.3")(lambda s, d: table(s, d, "lineitem").groupBy("l_suppkey").agg((F.count_if(c("l_returnflag") == "R") / F.count("*")).alias("r")).where("r > 0.3").select("l_suppkey"))
query("a29_truncation", "select l_returnflag, l_linestatus, sum(l_linenumber)::bigint as dropped, max(l_linenumber) as most from lineitem group by 1, 2")(lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_linenumber").alias("dropped"), F.max("l_linenumber").alias("most")))
# Joins
query("j4_name_join", """with n as (select name, count(distinct key) as k from (select p_name as name, p_partkey as key from part where p_partkey < 900) group by 1), r as (select p_partkey as ref, p_name as name from part where p_partkey >= 900), x as (select r.*, coalesce(k, 0) as k from r left join n using (name))
select ref, cast(p.p_partkey as varchar) as target, case when k = 1 then 'unique' else 'ambiguous' end as outcome, case when k = 1 then 600 else 300 end as confidence, k as candidates from x join part p on p.p_name = x.name and p.p_partkey < 900 where k between 1 and 3 union all select ref, null, 'unresolved', 0, k from x where k = 0 or k > 3""")(
    lambda s, d: R.name_join(table(s, d, "part").where("p_partkey >= 900").select(c("p_partkey").alias("ref"), c("p_name").alias("name")), table(s, d, "part").where("p_partkey < 900").select(c("p_name").alias("name"), c("p_partkey").cast("string").alias("key")))
)
query("j6_overrides", "select x.s_suppkey as sub, y.s_suppkey as super from supplier x join supplier y on y.s_nationkey = (x.s_nationkey + 1) % 25 and x.s_suppkey % 3 = y.s_suppkey % 3")(
    lambda s, d: R.overrides(table(s, d, "supplier").select(c("s_nationkey").alias("owner"), (c("s_suppkey") % 3).alias("name"), c("s_suppkey").alias("key")), table(s, d, "nation").select(c("n_nationkey").alias("owner"), ((c("n_nationkey") + 1) % 25).alias("parent")))
)
query("j10_key_list_join", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where c_custkey in (1, 5, 9, 77)")(lambda s, d: table(s, d, "orders").join(F.broadcast(table(s, d, "customer").where(c("c_custkey").isin(1, 5, 9, 77))), c("o_custkey") == c("c_custkey")).select("o_orderkey", "c_name"))
query("j11_node_lookup", "select k.o::int as ord, s_name from (values (0, 3), (1, 999999), (2, 5)) k(o, k) left join supplier on s_suppkey = k.k")(lambda s, d: s.createDataFrame([(0, 3), (1, 999999), (2, 5)], "ord int, k long").join(table(s, d, "supplier"), c("k") == c("s_suppkey"), "left").select("ord", "s_name"))
query("j17_resource_partners", "with a as (select distinct l_suppkey as resource, l_partkey as member from lineitem where l_quantity > 49), j as (select x.resource, x.member, y.member as other, row_number() over (partition by x.resource, x.member order by y.member) as k from a x join a y on x.resource = y.resource and x.member <> y.member) select resource, member, other from j where k <= 5")(lambda s, d: R.resource_partners(table(s, d, "lineitem").where("l_quantity > 49").select(c("l_suppkey").alias("resource"), c("l_partkey").alias("member"))))
query("j20_three_way_left_join", "select o_orderkey, c.c_name, n.n_name from orders left join customer c on o_custkey = c_custkey and c_acctbal > 0 left join nation n on c_nationkey = n_nationkey and n_regionkey < 3")(
    lambda s, d: table(s, d, "orders").join(table(s, d, "customer").where("c_acctbal > 0"), c("o_custkey") == c("c_custkey"), "left").join(table(s, d, "nation").where("n_regionkey < 3"), c("c_nationkey") == c("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name")
)
query("j21_feedback_join", "select d.lang, count(*) as n, sum(l.quality)::bigint as good from labels l join documents d using (doc_id) group by 1")(lambda s, d: table(s, d, "labels").join(table(s, d, "documents"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("good")))
query("j23_reconcile_targets", "select c_custkey, coalesce(o.n, 0) as n from customer left join (select o_custkey, count(*) as n from orders where o_orderstatus = 'O' group by 1) o on c_custkey = o_custkey where coalesce(o.n, 0) < 5")(lambda s, d: table(s, d, "customer").join(table(s, d, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("n")), c("c_custkey") == c("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("n")).where("n < 5"))
query("j24_latest_row", "select c_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as latest from customer left join orders on c_custkey = o_custkey group by 1")(lambda s, d: table(s, d, "customer").join(table(s, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest")), c("c_custkey") == c("o_custkey"), "left").select("c_custkey", "latest"))
query("j25_forbidden_dependencies", "select distinct x.s_nationkey as a, y.p_size as b from lineitem join supplier x on l_suppkey = s_suppkey join part y on l_partkey = p_partkey where x.s_nationkey < 5 and y.p_size > 45 and x.s_nationkey <> 3")(
    lambda s, d: table(s, d, "lineitem").join(table(s, d, "supplier").where("s_nationkey < 5"), c("l_suppkey") == c("s_suppkey")).join(table(s, d, "part").where("p_size > 45"), c("l_partkey") == c("p_partkey")).select(c("s_nationkey").alias("a"), c("p_size").alias("b")).distinct().join(s.createDataFrame([(3,)], "a int"), "a", "left_anti")
)
query("o4_directory_chain", "with p as (select distinct replace(p_type, ' ', '/') as path from part), x as (select string_split(path, '/') as q from p), u as (select unnest(range(1, len(q) + 1)) as i, q from x) select distinct array_to_string(q[1:i-1], '/') as parent, array_to_string(q[1:i], '/') as child from u")(lambda s, d: R.ancestors(table(s, d, "part").select(F.replace("p_type", F.lit(" "), F.lit("/")).alias("path")), "path"))
query("o11_capped_diagnostics", "select l_suppkey, l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) as rn from lineitem) where rn <= 50")(lambda s, d: table(s, d, "lineitem").withColumn("rn", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey"))).where("rn <= 50").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"))
query("o18_cache_lookup", "select o_orderkey, case when o_orderdate > timestamp '1996-06-01' then o_orderstatus end as hit from orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", F.when(c("o_orderdate") > F.lit("1996-06-01").cast("timestamp"), c("o_orderstatus")).alias("hit")))
query("o22_effective_settings", "select c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'default') as setting from customer")(lambda s, d: table(s, d, "customer").select("c_custkey", F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("default")).alias("setting")))
# Vectors
query("e1_filtered_top_k", "with q as (select * from embeddings where vec_id % 20 = 0), x as (select q.vec_id as query, p.vec_id as id, round(list_cosine_similarity(q.embedding::double[], p.embedding::double[]), 6) as score from q join embeddings p on q.label = p.label and q.vec_id <> p.vec_id) select query, id, score, rank::int as rank from (select *, row_number() over (partition by query order by score desc, id) as rank from x) where rank <= 10")(
    lambda s, d: E.top_k(table(s, d, "embeddings").where("vec_id % 20 = 0"), table(s, d, "embeddings"), 10, "vec_id", "embedding", "label")
)
query("e2_embed_or_reuse", "select vec_id, case when vec_id % 3 = 0 then 'reuse' else 'embed' end as action from embeddings")(lambda s, d: table(s, d, "embeddings").join(table(s, d, "embeddings").where("vec_id % 3 = 0").select(c("vec_id").alias("v")), c("vec_id") == c("v"), "left").select("vec_id", F.when(c("v").isNotNull(), "reuse").otherwise("embed").alias("action")))
query("f12_vector_filter", "select vec_id from embeddings where label in (1, 2, 3) and not vec_id between 10 and 40")(lambda s, d: table(s, d, "embeddings").where(c("label").isin(1, 2, 3) & ~c("vec_id").between(10, 40)).select("vec_id"))
query("f13_tenant_scope", "select vec_id, label from embeddings where label = 2")(lambda s, d: E.tenant(table(s, d, "embeddings").withColumn("org", c("label").cast("string")), "2", "org").select("vec_id", "label"))
query("f14_no_tenant_no_rows", "select vec_id from embeddings where false")(lambda s, d: E.tenant(table(s, d, "embeddings"), None, "label").select("vec_id"))
query("m10_feature_embedding", """with t as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), lambda x: x <> '') as w from documents), f as (select doc_id, f, count(*) as tf from (select doc_id, unnest(list_transform(w, lambda x: 'u:' || x) || list_transform(range(1, len(w)), lambda i: 'b:' || w[i] || ' ' || w[i+1]) || flatten(list_transform(list_filter(w, lambda x: length(x) >= 3), lambda x: list_transform(range(1, length(x) - 1), lambda i: 't:' || substr(x, i, 3))))) as f from t) group by 1, 2),
h as (select doc_id, ('0x' || substr(md5(f), 1, 8))::bigint as h, case when f like 't:%' then 0.5 else 1 end * (1 + ln(tf)) as w from f), b as (select doc_id, h % 64 as bucket, sum(case when (h // 64) % 2 = 0 then 1 else -1 end * w) as v from h group by 1, 2)
select doc_id, bucket::int as bucket, round(coalesce(v / nullif(sqrt(sum(v * v) over (partition by doc_id)), 0), 0), 6) + 0.0 as value from b""")(
    lambda s, d: E.embed(table(s, d, "documents"), "doc_id", F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"), lambda x: x != ""), 64).withColumn("value", F.round("value", 6) + 0.0)
)
# Queues and series
query("q1_idempotent_enqueue", "select user_id, arg_min(event_id, (ts, event_id)) as event_id from events group by 1")(lambda s, d: Q.first_by_key(ev(s, d).select("user_id", "ts", "event_id"), "user_id", "ts", "event_id").select("user_id", "event_id"))
query("q3_expired_leases", "select event_id, case when event_type = 'click' and ts < timestamp '2024-01-10' then case when user_id % 5 >= 3 then 'dead' else 'queued' end when event_type = 'click' then 'running' else 'done' end as next_state from events")(lambda s, d: Q.lease_state(ev(s, d).select("event_id", F.when(c("event_type") == "click", "running").otherwise("done").alias("state"), c("ts").alias("locked_until"), (c("user_id") % 5).alias("attempts")), F.lit("2024-01-10").cast("timestamp")).select("event_id", "next_state"))
query("q4_depth_gauge", "select event_type, value > 50 as high, count(*) as n from events group by 1, 2")(lambda s, d: ev(s, d).groupBy("event_type", (c("value") > 50).alias("high")).agg(F.count("*").alias("n")))
query("q5_bulk_cancel", "select event_id, case when event_type = 'view' and user_id in (1, 2, 3) then 'cancelled' else 'queued' end as state from events")(lambda s, d: ev(s, d).select("event_id", F.when((c("event_type") == "view") & c("user_id").isin(1, 2, 3), "cancelled").otherwise("queued").alias("state")))
query("q6_delivery_replays", "select event_id, case when rn = 1 then 'first' when props = f then 'duplicate' else 'replay' end as verdict from (select *, row_number() over w as rn, first_value(props) over w as f from events window w as (partition by user_id order by ts, event_id))")(lambda s, d: Q.replays(ev(s, d), "user_id", "props", "ts", "event_id").select("event_id", "verdict"))
query("q7_late_events", "select event_id from events where ts >= timestamp '2024-01-20'")(lambda s, d: ev(s, d).where(c("ts") >= F.lit("2024-01-20").cast("timestamp")).select("event_id"))
query("q8_rate_limit", "select event_id, row_number() over (partition by event_type, epoch(ts)::bigint // 3600 order by ts, event_id) > 2 as limited from (select * replace (date_trunc('second', ts) as ts), ts as t from events)".replace("order by ts, event_id", "order by t, event_id"))(lambda s, d: Q.rate_limited(ev(s, d), "event_type", "ts", 2, 3600).select("event_id", "limited"))
query("q9_token_bucket")(lambda s, d: Q.token_bucket(ev(s, d).select("user_id", "event_id", F.unix_millis("ts").alias("ms"), F.lit(1.0).alias("cost")), "user_id", "ms", "cost", 3.0, 1 / 86_400_000))
query("q10_supersession", "select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) > 1 as superseded from events")(lambda s, d: ev(s, d).select("user_id", "event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))) > 1).alias("superseded")))
query("q11_stale_update_guard", "select user_id, arg_max(value, (ts, event_id)) as value from events group by 1")(lambda s, d: ev(s, d).groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value")))
query("q16_bucket_sum", "select epoch(date_trunc('second', ts))::bigint // 3600 * 3600 as bucket, event_type, round(sum(value), 4) as total, count(*) as n from events group by 1, 2")(lambda s, d: Q.bucket_sum(ev(s, d), "ts", 3600, "value", ["event_type"]).withColumn("total", F.round("total", 4)))
query("q17_bucket_percentile", "select epoch(date_trunc('second', ts))::bigint // 86400 * 86400 as bucket, event_type, quantile_disc(value, 0.95) as p from events group by 1, 2")(lambda s, d: Q.bucket_percentile(ev(s, d), "ts", 86400, "value", 0.95, ["event_type"]))
query("q18_held_breaches", """with b as (select event_type, epoch(date_trunc('second', ts))::bigint // 3600 * 3600 as bucket, sum(value) as v from events group by 1, 2), h as (select *, bucket - row_number() over (partition by event_type order by bucket) * 3600 as g from b where v > 100)
select event_type, min(bucket) as start, max(bucket) as "end", count(*) as n from h group by event_type, g having count(*) >= 3""")(lambda s, d: Q.held_breaches(Q.bucket_sum(ev(s, d), "ts", 3600, "value", ["event_type"]), "event_type", "bucket", "total", 100.0, 3, 3600))
query("q19_counter_increase", "select event_id, case when p is null then 0 when value < p then value else value - p end as increase from (select *, lag(value) over (partition by user_id order by ts, event_id) as p from events)")(lambda s, d: Q.counter_increase(ev(s, d), "user_id", ["ts", "event_id"], "value").select("event_id", "increase"))
query("q20_ratio_alert", "select epoch(date_trunc('second', ts))::bigint // 86400 * 86400 as bucket, count(*) filter (value > 90) / count(*) as ratio, count(*) as n from events group by 1 having count(*) >= 20 and count(*) filter (value > 90) / count(*) > 0.05")(lambda s, d: Q.ratio_alert(ev(s, d), "ts", 86400, c("value") > 90, 0.05, 20))
query("q21_trailing_rates", """with d as (select date_trunc('day', ts)::date as day, count(*) filter (value > 50) as a, count(*) as n from events group by 1) select day::varchar as day, (sum(a) over w / sum(n) over w) as rate from d window w as (order by day range between interval 6 days preceding and current row)""")(
    lambda s, d: (lambda x, w: x.select(c("day").cast("string").alias("day"), (F.sum("a").over(w) / F.sum("n").over(w)).alias("rate")))(ev(s, d).groupBy(c("ts").cast("date").alias("day")).agg(F.count_if(c("value") > 50).alias("a"), F.count("*").alias("n")), Window.orderBy(F.unix_date("day")).rangeBetween(-6, 0))
)
query("q22_polling_reconcile", "select o_orderkey from orders where o_orderstatus = 'O' and o_orderkey not in (select l_orderkey from lineitem where l_linestatus = 'O' and l_quantity > 30)")(lambda s, d: table(s, d, "orders").where("o_orderstatus = 'O'").join(table(s, d, "lineitem").where("l_linestatus = 'O' and l_quantity > 30"), c("o_orderkey") == c("l_orderkey"), "left_anti").select("o_orderkey"))
query("w7_hash_chain_verify", "select user_id, null::bigint as first_bad from events group by 1")(lambda s, d: (lambda r: Q.chain_breaks(Q.hash_chain(r, "user_id", "event_id", "props"), r, "user_id", "event_id", "props"))(ev(s, d).select("user_id", "event_id", "props")))
# Filters
query("f5_path_glob", "select p_partkey from part where p_type like 'SMALL%' and not p_type like '%STEEL'")(lambda s, d: table(s, d, "part").where(c("p_type").rlike("^SMALL.*$") & ~c("p_type").rlike("^.*STEEL$")).select("p_partkey"))
query("f6_file_disposition", "select doc_id, case when text like '%Licensed under%' then 'vendored' when length(text) > 20000 then 'too_large' when length(text) / len(string_split(text, chr(10))) > 500 then 'minified' else 'analyze' end as disposition from documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.when(F.contains("text", F.lit("Licensed under")), "vendored").when(F.length("text") > 20000, "too_large").when(F.length("text") / F.size(F.split("text", "\n")) > 500, "minified").otherwise("analyze").alias("disposition"))
)
query("f10_finding_filter", "select o_orderkey from orders where o_orderstatus in ('O', 'P') and coalesce(o_orderpriority, '5') like '1%'")(lambda s, d: table(s, d, "orders").where(c("o_orderstatus").isin("O", "P") & F.startswith(F.coalesce("o_orderpriority", F.lit("5")), F.lit("1"))).select("o_orderkey"))
query("f15_trivia", "select count(*) filter (trim(line) = '' or starts_with(trim(line), '#') or starts_with(trim(line), '//') or starts_with(trim(line), '*') or starts_with(trim(line), '/*') or starts_with(trim(line), '<!--')) as trivia, count(*) as n from (select unnest(string_split(translate(text, chr(9) || chr(13), '  '), chr(10))) as line from documents)")(lambda s, d: table(s, d, "documents").select(F.explode(F.split("text", "\n")).alias("line")).agg(F.count_if(X.is_trivia(c("line"))).alias("trivia"), F.count("*").alias("n")))
query("f17_secrets", "select doc_id from documents where " + " or ".join("regexp_matches(text, '" + p.replace("'", "''") + "')" for _, p in X.SECRETS))(lambda s, d: table(s, d, "documents").where(X.has_secret(c("text"))).select("doc_id"))
