"""Study-shaped views over the given tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "annotation": """select l_orderkey as episode, o_custkey as nid, case when l_linenumber % 2 = 1 then 'dx' else 'px' end as kind,
 concat(substr(p_type,1,1), '0', cast(p_size % 4 as varchar(2)), '.', substr(p_brand,7,1)) as raw_code, l_returnflag as rf, l_linestatus as ls,
 row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) as pos
 from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey""",
    "rater_annotation": """select 'reference' as rater, * from annotation where rf <> 'A' union all select 'clinician_2', * from annotation where rf <> 'N'
 union all select 'clinician_3', * from annotation where rf <> 'R' union all select 'coder', * from annotation where ls = 'F'
 union all select 'model_1', * from annotation where ls = 'O' union all select 'model_2', * from annotation where pos <= 3""",
    "clinician_episode": """select o_orderkey as ep_key, o_custkey as nid, case when o_orderkey % 2 = 0 and day(o_orderdate) <= 12 and day(o_orderdate) <> month(o_orderdate)
 then make_date(cast(year(o_orderdate) as int), cast(day(o_orderdate) as int), cast(month(o_orderdate) as int)) else cast(o_orderdate as date) end as adm from orders where o_orderkey % 3 = 0""",
    "coder_admission": """select o_custkey as nid, o_orderkey as seq, cast(o_orderdate as date) as adm from orders where o_orderkey % 3 <> 1 and o_orderkey % 5 <> 0
 and (o_custkey % 4 <> 0 or o_orderkey in (select min(o_orderkey) from orders group by o_custkey))""",
    "map_row": """select case when p_partkey % 2 = 0 then 'diagnosis' else 'procedure' end as refset, p_partkey % 200 as sctid, 1 + p_size % 2 as map_group,
 cast(p_size as int) as priority, case p_size % 3 when 0 then '' when 1 then 'OTHERWISE TRUE' else 'IFA 1' end as map_rule,
 case when p_partkey % 3 = 0 then 'ADDITIONAL CODE MANDATORY' else '' end as advice,
 case when p_partkey % 7 = 0 then '' else concat(substr(p_type,1,1), '0', cast(p_size % 10 as varchar(2)), substr(p_brand,7,1)) end as target, p_partkey as ord from part""",
    "verdict": """select l_suppkey % 4 as model, case l_linenumber when 1 then 'TP' when 2 then 'FP - additional not relevant' when 3 then 'FP - hallucination'
 when 4 then 'FN - correct extraction, incorrect code' when 5 then 'FN (no diagnosis)' when 6 then 'TN ruled out' else 'Could not find record' end as verdict,
 case when l_returnflag = 'A' then 'diagnoses' else 'procedures' end as qualifier from lineitem""",
    "run_metadata": """select event_id as episode_id, event_type as model, value as elapsed_seconds, 1 + event_id % 9 as n_llm_calls, 1000 + event_id % 5000 as prompt_tokens, 100 + event_id % 700 as completion_tokens from events""",
    "note": """select doc_id as note_id, cast(date_add(date '2024-01-01', cast(doc_id % 365 as int)) as date) as note_date, source as note_class, text as note_text from documents""",
    "snippet": "select item_id % 10 as episode, item_id as snippet_id, text as snippet from benchmark",
    "snippet_coder_date": "select distinct item_id % 10 as episode, cast(date_add(date '2024-01-01', cast((item_id * 37) % 365 as int)) as date) as adm from benchmark",
    "pilot_coder": "select o_custkey as patient_id, cast(o_orderdate as date) as admission, cast(date_add(cast(o_orderdate as date), cast(o_orderkey % 9 as int)) as date) as discharge, o_orderkey as ord, concat('P0', substr(o_orderpriority,1,1)) as code from orders",
    "pilot_reference": """select o_custkey as patient_id, cast(o_orderdate as date) as admission, cast(date_add(cast(o_orderdate as date), cast(o_orderkey % 9 + case when o_orderkey % 11 = 0 then 1 else 0 end as int)) as date) as discharge, concat('P0', cast(1 + l_linenumber % 5 as varchar(2))) as code, l_orderkey, l_linenumber from lineitem join orders on l_orderkey = o_orderkey""",
    "binary_rating": "select doc_id as episode, quality as rater_a, 1 - toxic as rater_b from labels",
}


def needed(sql: str) -> list[str]:
    """Views that ``sql`` names, directly or not, in the order of VIEWS."""
    words = set(re.findall(r"\w+", sql))
    for name in reversed(VIEWS):
        if name in words:
            words |= set(re.findall(r"\w+", VIEWS[name]))
    return [v for v in VIEWS if v in words]


#: what rows of annotation a rater has, as in the SQL of rater_annotation
RATERS = {"reference": "rf <> 'A'", "clinician_2": "rf <> 'N'", "clinician_3": "rf <> 'R'", "coder": "ls = 'F'", "model_1": "ls = 'O'", "model_2": "pos <= 3"}


def annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view of that name. Here lines lie by ``episode`` itself, so that what is grouped by episodes afterwards is not shuffled again."""
    lines, parts, orders = (view(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    lines = lines.withColumnRenamed("l_orderkey", "episode").join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders.select("o_orderkey", F.col("o_custkey").alias("nid")), F.col("episode") == F.col("o_orderkey"))
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    kind = F.expr("case when l_linenumber % 2 = 1 then 'dx' else 'px' end")
    code = F.expr("concat(substr(p_type,1,1), '0', cast(p_size % 4 as varchar(2)), '.', substr(p_brand,7,1))")
    flags = F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls")
    return lines.select("episode", "nid", kind.alias("kind"), code.alias("raw_code"), *flags, F.row_number().over(W.partitionBy("episode").orderBy(*order)).alias("pos"))


def view(spark: SparkSession, sf_dir: str, name: str, added: dict[str, Column] | None = None) -> DataFrame:
    """A view or table as a DataFrame, with columns ``added``."""
    if name == "annotation":
        return annotation(spark, sf_dir).withColumns(added or {})
    if name == "rater_annotation":  # one scan, whose rows go to their raters; what is added is computed before that
        raters = F.array(*(F.when(F.expr(where), F.lit(rater)) for rater, where in RATERS.items()))
        rows = view(spark, sf_dir, "annotation", added)
        return rows.select(F.explode(raters).alias("rater"), *rows.columns).where("rater is not null")
    sql = f"select * from {name}"
    chain = needed(sql)
    words = set(re.findall(r"\w+", " ".join([sql, *(VIEWS[v] for v in chain)])))
    for t in BASE:
        if t in words:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(with_views(sql)).withColumns(added or {})


def with_views(sql: str, *ctes: str) -> str:
    """``sql`` after the definitions of the views it names, and after further CTEs 'name as (...)'."""
    text = " ".join([sql, *ctes])
    parts = [f"{v} as ({VIEWS[v]})" for v in needed(text)] + list(ctes)
    return f"with {', '.join(parts)} {sql}" if parts else sql
