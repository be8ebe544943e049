"""Operator inputs made from the star schema, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NODES = """select 'r:' || r_regionkey as node_key, 'repository' as kind, r_name as name, r_name as qualified_name, cast(null as string) as path from {region}
union all select 'n:' || n_nationkey, 'directory', n_name, 'r' || n_regionkey || '.' || n_name, 'r' || n_regionkey from {nation}
union all select 's:' || s_suppkey, 'file', s_name, s_name, 'n' || s_nationkey from {supplier}
union all select 'c:' || c_custkey, 'class', c_name, c_mktsegment || '.' || c_name, 'n' || c_nationkey from {customer}
union all select 'p:' || p_partkey, 'function', p_name, p_brand || '.' || p_name, p_type from {part}"""
#: Regions contain nations, nations suppliers and customers; customers call the parts of their orders, parts depend on suppliers.
EDGES = """select 'r:' || n_regionkey as source, 'contains' as kind, 'n:' || n_nationkey as target, 1000 as confidence, 0 as resolved_by, 1 as flags, 1 as occurrences, 'nation' as path, cast(n_nationkey as int) as line from {nation}
union all select 'n:' || s_nationkey, 'contains', 's:' || s_suppkey, 1000, 0, 1, 1, 'supplier', cast(s_suppkey as int) from {supplier}
union all select 'n:' || c_nationkey, 'declares', 'c:' || c_custkey, 950, 1, 2, 1, 'customer', cast(c_custkey as int) from {customer}
union all select 'c:' || o_custkey, 'calls', 'p:' || l_partkey, cast(round(l_discount * 10000) as int), cast(l_linenumber as int), l_linenumber, 1, 'orders', cast(o_orderkey as int) from {lineitem} join {orders} on l_orderkey = o_orderkey
union all select 'p:' || l_partkey, 'depends_on', 's:' || l_suppkey, cast(1000 - round(l_tax * 10000) as int), 9, 4, 1, 'lineitem', cast(l_orderkey as int) from {lineitem}"""


def spark_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", text))


def duck(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text).replace("as string)", "as varchar)")


MERGED_SQL = f"select source, kind, target, max(confidence) as confidence from ({duck(EDGES)}) group by 1, 2, 3"
