"""Queries of sources and sinks over files made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import queue as Q
from loomgraph.plans.adapters import duck, spark_sql
from loomgraph.plans.catalog import query, table
from loomgraph.plans.scalars import PATHS, paths
from loomgraph.sources import readers as S
from loomgraph.sources import writers as K

c = F.col
_OLD = "select 'f' || o_orderkey as path, o_custkey || o_orderstatus || o_orderkey as blob from {orders} where o_orderkey % 3 <> 0"
_NEW = "select case when o_orderkey % 7 = 0 then 'g' else 'f' end || o_orderkey as path, o_custkey || case when o_orderkey % 11 = 0 then 'X' else o_orderstatus end || o_orderkey as blob from {orders} where o_orderkey % 5 <> 0"
query("s2_tree_diff", f"""with a as ({duck(_OLD)}), b as ({duck(_NEW)}), j as (select coalesce(a.path, b.path) as path, a.blob as x, b.blob as y from a full join b on a.path = b.path where a.blob is distinct from b.blob),
m as (select g.path as old_path, h.path as new_path from (select * from j where y is null) g full join (select * from j where x is null) h on g.x = h.y)
select coalesce(new_path, old_path) as path, case when new_path is not null and old_path is not null then old_path end as old_path, case when new_path is null then 'deleted' when old_path is null then 'added' else 'renamed' end as status from m
union all select path, null, 'modified' from j where x is not null and y is not null""")(lambda s, d: S.tree_diff(spark_sql(s, d, _OLD), spark_sql(s, d, _NEW)))
query("s3_language", f"select p_partkey, case when p_partkey % 4 in (0, 1, 2) then 'typescript' end as lang from {PATHS}")(lambda s, d: paths(s, d).select("p_partkey", S.language(c("path")).alias("lang")))
query("s4_manifest_dependencies", "select p_partkey::varchar as path, name, case name when 'a' then '^' || p_size else '1.' || p_size end as version, name = 'b' as dev from part, (values ('a'), ('b')) as v(name)")(
    lambda s, d: S.npm_dependencies(table(s, d, "part").select(c("p_partkey").cast("string").alias("path"), F.concat(F.lit('{"dependencies": {"a": "^'), "p_size", F.lit('",}, // x\n "devDependencies": {"b": "1.'), "p_size", F.lit('"}}')).alias("text")))
)
query("s9_generated", f"select p_partkey, case when path like '%/__tests__/%' then 'marker' end as reason from {PATHS}")(lambda s, d: paths(s, d).select("p_partkey", S.generated_reason(c("path"), F.when(F.contains("path", F.lit("/__tests__/")), "// DO NOT EDIT").otherwise("x\ny")).alias("reason")))
query("s10_code_owners", f"select distinct path, case when path like 'test/%' then '@b' when path like 'src/%' then '@c,@d' else '@a' end as owners from {PATHS}")(
    lambda s, d: S.owners_of(paths(s, d), S.code_owners(s.createDataFrame([(1, "# owners"), (2, "* @a"), (3, "/test/ @b # x"), (4, ""), (5, "/src/** @c @d")], "line_no int, line string"))).select("path", F.array_join("owners", ",").alias("owners"))
)
query("s11_json_with_comments", "select p_partkey, p_name as v from part")(lambda s, d: table(s, d, "part").select("p_partkey", F.get_json_object(S.strip_comments(F.concat(F.lit('{/* a */ "v": "'), "p_name", F.lit('", // b\n}'))), "$.v").alias("v")))
query("s15_parse_cache", "select doc_id from documents where doc_id % 3 <> 0")(lambda s, d: K.new_rows(table(s, d, "documents").select("doc_id"), table(s, d, "documents").where("doc_id % 3 = 0").select("doc_id"), ["doc_id"]))
query("s18_batched_keys", "select o_orderkey, o_totalprice from orders where o_custkey in (select c_custkey from customer where c_nationkey = 3)")(lambda s, d: table(s, d, "orders").join(table(s, d, "customer").where("c_nationkey = 3"), c("o_custkey") == c("c_custkey"), "left_semi").select("o_orderkey", "o_totalprice"))
query("s19_vector_count", "select label, count(*) as n from embeddings where label > 1 group by 1")(lambda s, d: table(s, d, "embeddings").where("label > 1").groupBy("label").agg(F.count("*").alias("n")))
query("s22_webhook_events", "select event_id as delivery_id, case event_id % 4 when 0 then 'opened' when 1 then 'synchronize' when 2 then 'closed' else 'other' end as kind, user_id as number, 'h' || event_id as head from events")(
    lambda s, d: S.normalize_event(table(s, d, "events").select(c("event_id").alias("delivery_id"), F.to_json(F.struct(F.element_at(F.array(*map(F.lit, ("opened", "synchronize", "closed", "labeled"))), (c("event_id") % 4 + 1).cast("int")).alias("action"), F.struct(c("user_id").alias("number"), F.struct(F.concat(F.lit("h"), "event_id").alias("sha")).alias("head")).alias("pull_request"))).alias("payload")))
)
query("k3_content_addressed_upsert", "select distinct md5(text) as h from documents where md5(text) not in (select md5(text) from documents where doc_id % 2 = 0)")(lambda s, d: K.new_rows(table(s, d, "documents").select(F.md5("text").alias("h")), table(s, d, "documents").where("doc_id % 2 = 0").select(F.md5("text").alias("h")), ["h"]))
query("k8_point_delete", "select vec_id from embeddings where label not in (2, 3)")(lambda s, d: table(s, d, "embeddings").join(s.createDataFrame([(2,), (3,)], "label int"), "label", "left_anti").select("vec_id"))
query("k10_stage_output_conflicts", "select o_orderkey, o_orderstatus as stored, 'F' as given from orders where o_orderkey % 2 = 0 and o_orderstatus <> 'F'")(lambda s, d: K.conflicts(table(s, d, "orders").where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("F").alias("v")), table(s, d, "orders").select("o_orderkey", c("o_orderstatus").alias("v")), ["o_orderkey"], "v"))
query("k11_audit_chain")(lambda s, d: Q.hash_chain(table(s, d, "events").select("user_id", "event_id", "props"), "user_id", "event_id", "props"))
