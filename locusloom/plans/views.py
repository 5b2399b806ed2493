"""Association tables derived from the driver's tables. The same text runs in Spark and in other SQL engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "variants": """
select p_partkey as vid, concat('chr', cast(1 + p_partkey % 22 as varchar(4))) as chrom, 1000 + p_partkey * 100 as pos,
  substring('ACGT', cast(1 + p_partkey % 4 as int), 1) as ref, substring('ACGT', cast(1 + (p_partkey + 1 + p_size % 3) % 4 as int), 1) as alt
from part""",
    "study_stats": """
select l_suppkey % 4 as study, l_partkey as vid, round(sum(l_discount) / count(*) - 0.05, 8) as es, round(0.01 + sum(l_tax) / count(*) / 4, 8) as se,
  sum(l_quantity) as ns, sum(case when l_returnflag = 'R' then l_quantity else 0.0 end) as nc, round(0.05 + sum(l_discount) / count(*) * 8, 8) as af
from lineitem group by l_suppkey % 4, l_partkey""",
    "dosage": """
select o_custkey % 50 as sample, l_partkey as vid, round(sum(l_quantity) / count(*) / 25, 8) as ds, cast(sum(l_linenumber) % 3 as bigint) as n_alt
from lineitem join orders on l_orderkey = o_orderkey group by o_custkey % 50, l_partkey""",
    "raw_text": """
select concat(cast(l_orderkey as varchar(20)), ':', cast(l_linenumber as varchar(4))) as row_id, cast(1 + l_partkey % 26 as varchar(4)) as chr_raw,
  concat(cast(1 + l_suppkey % 9 as varchar(2)), '.', cast(l_linenumber as varchar(2)), 'e-', cast(cast(l_quantity as bigint) * 9 as varchar(6))) as p_raw,
  case when l_linenumber = 7 then 'NA' else cast(l_linenumber as varchar(4)) end as a1_raw, l_discount, l_tax, l_quantity
from lineitem""",
    "chain_blocks": """
select p_partkey as block_ind, p_partkey % 22 as chain_ind, concat('chr', cast(1 + p_partkey % 22 as varchar(4))) as t_chrom,
  cast(floor(p_partkey / 22) as bigint) * 10000 as t_start, cast(floor(p_partkey / 22) as bigint) * 10037 as q_start, 8000 as size, 100000000 as q_size, p_partkey % 2 as q_strand
from part""",
    "chain_lines": """
select p_partkey % 22 as chain_ind, cast(floor(p_partkey / 22) as bigint) as line, cast(100 + p_size as bigint) as size,
  cast(case when p_partkey % 5 = 0 then 1 else p_size % 7 end as bigint) as dt, cast(case when p_partkey % 5 = 0 then 1 else p_size % 11 end as bigint) as dq
from part""",
    "gene_models": """
select p_partkey as vid, concat('chr', cast(1 + p_partkey % 22 as varchar(4))) as chrom, 1000 + p_partkey * 101 - (p_partkey * 7) % 300 as s1, 40 + p_size as l1, 20 + p_size % 7 as l2, p_partkey % 2 as minus
from part""",
    "ld_nodes": """
select cast(floor(p_partkey / 20) as bigint) as ld_block, p_partkey % 20 as ld_node, p_partkey as vid, p_partkey % 2 as aa,
  round(cast(0.05 + 0.009 * p_size as double), 6) as af, round(cast(1 + p_size / 10.0 as double), 6) as ld_diagonal
from part""",
    "ld_edges": """
select cast(floor(p_partkey / 20) as bigint) as ld_block, p_partkey % 20 as i, p_partkey % 20 + 1 as j, round(cast(-0.1 - p_size / 200.0 as double), 6) as w
from part where p_partkey % 20 < 19""",
}
BASE = ("part", "lineitem", "orders")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if re.search(rf"\b{t}\b", text)}
    return spark.sql(re.sub(rf"\b({'|'.join(BASE)})\b", r"{\1}", text), **tables)


def with_views(query: str) -> str:
    """``query`` with the views that it names before it."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", query)]
    heads = ", ".join(f"{n} as ({VIEWS[n].strip()})" for n in used)
    query = query.strip()
    if not heads:
        return query
    if query.lower().startswith("with recursive "):
        return f"with recursive {heads}, {query[15:]}"
    return f"with {heads}, {query[5:]}" if query.lower().startswith("with ") else f"with {heads} {query}"
