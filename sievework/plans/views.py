"""Analog views over the shared tables, in SQL that both engines read; ``{table}`` stands for a table.

They stand for graphs, functions, scores and runs, and use all rows of their tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def on_spark(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", sql))


def for_oracle(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: m[1], sql)


FOREST = """
SELECT 'forest' AS binary_id, concat('r', n_regionkey) AS src, concat('n', n_nationkey) AS dst FROM {nation}
UNION ALL SELECT 'forest', concat('n', c_nationkey), concat('c', c_custkey) FROM {customer}
UNION ALL SELECT 'forest', concat('c', o_custkey), concat('o', o_orderkey) FROM {orders}"""

SINGLE_ROOT = f"""
SELECT 'single' AS binary_id, src, dst FROM ({FOREST}) f
UNION ALL SELECT 'single', 'main', concat('r', r_regionkey) FROM {{region}}"""

#: Parts bought one after the other in an order: a dense graph with cycles.
CYCLIC = """
SELECT DISTINCT 'cyclic' AS binary_id, concat('p', a.l_partkey) AS src, concat('p', b.l_partkey) AS dst
FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
WHERE a.l_partkey <> b.l_partkey"""

#: Region, nation, customer, supplier, part, brand: six layers, many to many in between.
DAG = """
SELECT 'dag' AS binary_id, concat('r', n_regionkey) AS src, concat('n', n_nationkey) AS dst FROM {nation}
UNION ALL SELECT 'dag', concat('n', c_nationkey), concat('c', c_custkey) FROM {customer}
UNION ALL SELECT 'dag', concat('n', s_nationkey), concat('s', s_suppkey) FROM {supplier}
UNION ALL SELECT DISTINCT 'dag', concat('c', o_custkey), concat('s', l_suppkey) FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey
UNION ALL SELECT DISTINCT 'dag', concat('s', l_suppkey), concat('p', l_partkey) FROM {lineitem}
UNION ALL SELECT 'dag', concat('p', p_partkey), concat('b', p_brand) FROM {part}"""

GRAPHS = {"forest": FOREST, "single": SINGLE_ROOT, "cyclic": CYCLIC, "dag": DAG}


def vertices_of(edges: str) -> str:
    return f"SELECT binary_id, src AS name FROM ({edges}) e1 UNION SELECT binary_id, dst FROM ({edges}) e2"


#: Every part as a function: a stem with an address, and text that each clause of the gate finds cases in.
FUNCTIONS = r"""
SELECT 'parts' AS binary_id, fid, name, concat(name, '-', address) AS stem, size,
  CASE WHEN fid % 13 = 0 THEN '  '
       WHEN fid % 13 = 1 THEN concat('/* WARNING: bad data */', chr(10), '/* a', chr(10), 'b */', chr(10), '// c', chr(10), 'void ', name, '(void)', chr(10), '{ halt_baddata(); }')
       WHEN fid % 13 = 2 THEN concat('/* ns::Store::', name, '(int, Item const&) */', chr(10), '#include <a>', chr(10), 'long ', name, '(int total)', chr(10), '{', chr(10), repeat(concat('  total = total + ', size, ';', chr(10)), 1 + size % 7), '  return total;', chr(10), '}')
       ELSE concat('/* ns::Graph::', name, '(int) const */', chr(10), 'undefined8 ', name, '(int param_1)', chr(10), '{', chr(10), repeat(concat('  iVar', fid % 7, ' = local_', size, ' + param_1;', chr(10)), size % 9), '  DAT_0010', address, ' = FUN_', following, '(0x', address, ');', chr(10), '  return iVar', fid % 7, ';', chr(10), '}') END AS code
FROM (SELECT p_partkey AS fid, CAST(p_size AS BIGINT) AS size, printf('%08x', p_partkey) AS address, printf('%08x', p_partkey + 1) AS following,
  CASE p_partkey % 11 WHEN 0 THEN 'std::vector::push_back' WHEN 1 THEN '__cxa_finalize' WHEN 2 THEN concat('thunk_FUN_', printf('%08x', p_partkey))
    WHEN 3 THEN replace(p_name, ' ', '_') WHEN 4 THEN concat('Ledger::', replace(p_name, ' ', '_')) WHEN 5 THEN 'processEntry _start' ELSE concat('FUN_', printf('%08x', p_partkey)) END AS name
  FROM {part}) p"""

#: Two neighbouring turns: the later one as the original, the earlier as the candidate, the one before as raw.
PAIRS = r"""
SELECT a.conv_id, a.turn, b.text AS original, a.text AS candidate, coalesce(r.text, '') AS raw
FROM {conversations} a JOIN {conversations} b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
LEFT JOIN {conversations} r ON r.conv_id = a.conv_id AND r.turn = a.turn - 1"""

SCORES = """
SELECT concat('s', l_suppkey) AS candidate, concat('p', l_partkey) AS example, CAST(round(avg(l_discount) * 10, 4) AS DOUBLE) AS score
FROM {lineitem} GROUP BY l_suppkey, l_partkey"""

TRUTH = """
SELECT d.doc_id AS address, l.quality AS quality, d.n_chars AS n_chars, l.doc_id IS NOT NULL AS known
FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id"""
