"""A property graph derived from the relational tables, as portable SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents")

NODES_SQL = """
SELECT concat('module:', r_regionkey) AS id, 'module' AS kind, r_name AS name, r_name AS qualified_name,
       concat('geo/r', r_regionkey, '/Region.java') AS file_path, 1 AS start_line, true AS is_exported, CAST(NULL AS STRING) AS docstring
FROM {region}
UNION ALL
SELECT concat('nation:', n_nationkey), 'class', n_name, concat(r_name, '.', n_name),
       concat('geo/r', n_regionkey, '/N', n_nationkey, '.java'), n_nationkey + 1, true, NULL
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL
SELECT concat('customer:', c_custkey), 'class', c_name, concat('NATION_', c_nationkey, '.', c_name),
       concat('sales/n', c_nationkey, '/', c_mktsegment, '.java'), CAST(c_custkey + 1 AS INT), c_acctbal >= 0, NULL
FROM {customer}
UNION ALL
SELECT concat('supplier:', s_suppkey), 'interface', s_name, concat('NATION_', s_nationkey, '.', s_name),
       concat('supply/n', s_nationkey, '/Supplier.java'), CAST(s_suppkey + 1 AS INT), true, NULL
FROM {supplier}
UNION ALL
SELECT concat('part:', p_partkey), 'class', p_name, concat(p_brand, '.', p_name, '.', p_partkey),
       concat(CASE WHEN p_size < 5 THEN 'src/test/' ELSE 'src/main/' END, 'catalog/', p_brand, '/', p_type, '.java'),
       CAST(p_partkey + 1 AS INT), p_size >= 25, p_type
FROM {part}
UNION ALL
SELECT concat('order:', o_orderkey), 'method', concat('order', o_orderkey), concat('Customer', o_custkey, '.order', o_orderkey),
       concat('sales/orders/', o_orderpriority, '.java'), CAST(o_orderkey + 1 AS INT), o_orderstatus = 'F', o_orderpriority
FROM {orders}
UNION ALL
SELECT concat('doc:', doc_id), 'function', concat('doc', doc_id), concat(source, '.', lang, '.doc', doc_id),
       concat('docs/', source, '/', lang, '.md'), CAST(doc_id + 1 AS INT), false, text
FROM {documents}
"""

EDGES_SQL = """
SELECT concat('module:', n_regionkey) AS source, concat('nation:', n_nationkey) AS target, 'contains' AS kind, 1 AS line FROM {nation}
UNION ALL SELECT concat('nation:', c_nationkey), concat('customer:', c_custkey), 'contains', 1 FROM {customer}
UNION ALL SELECT concat('nation:', s_nationkey), concat('supplier:', s_suppkey), 'contains', 1 FROM {supplier}
UNION ALL SELECT concat('customer:', o_custkey), concat('order:', o_orderkey), 'contains', 1 FROM {orders}
UNION ALL SELECT concat('order:', l_orderkey), concat('part:', l_partkey), 'calls', min(l_linenumber) FROM {lineitem} GROUP BY l_orderkey, l_partkey
UNION ALL SELECT concat('order:', l_orderkey), concat('supplier:', l_suppkey), 'references', min(l_linenumber) FROM {lineitem} GROUP BY l_orderkey, l_suppkey
UNION ALL SELECT concat('part:', l_partkey), concat('supplier:', l_suppkey), 'implements', 1 FROM {lineitem} GROUP BY l_partkey, l_suppkey
UNION ALL SELECT concat('part:', p_partkey), concat('part:', CAST(floor(p_partkey / 2) AS BIGINT)), 'extends', 1 FROM {part} WHERE p_partkey > 0
UNION ALL SELECT concat('doc:', doc_id), concat('doc:', CAST(5 * floor(doc_id / 5) AS BIGINT) + mod(doc_id + 1, 5)), 'imports', 1 FROM {documents}
"""

#: The head of every oracle query: both tables inlined over the base tables.
WITH = f"WITH RECURSIVE nodes AS ({NODES_SQL}), edges AS ({EDGES_SQL})".format(**{t: t for t in TABLES})


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(NODES_SQL, **_tables(spark, sf_dir))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EDGES_SQL, **_tables(spark, sf_dir))


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
