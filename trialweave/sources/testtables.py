"""Study inputs derived from the order tables: patients, prescriptions, measurements.

Each definition is one SQL text that both Spark and another SQL engine can run; table
names stand in braces.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from trialweave.study import CohortSpec

SPEC = CohortSpec(start=date(1996, 1, 1), months=24)

PATIENTS = """
select c_custkey as patid,
  case when c_custkey % 2 = 0 then 'Male' else 'Female' end as gender,
  c_mktsegment as gen_ethnicity_mapped, r_name as region, cast(c_nationkey % 5 + 1 as string) as imd2015_5,
  date '1920-01-01' + cast((c_custkey * 7919) % 14600 as int) as dob,
  date '1985-01-01' + cast((c_custkey * 104729) % 4380 as int) as startdate,
  date '1999-01-01' + cast((c_custkey * 1299709) % 1300 as int) as enddate,
  case when c_custkey % 11 <> 0 then date '1993-01-01' + cast((c_custkey * 15485863) % 1800 as int) end as HF_date,
  case when c_custkey % 3 = 0 then 'HFpEF' else 'HFrEF' end as hf_type,
  case when c_custkey % 4 = 0 then date '1996-06-01' + cast((c_custkey * 32452843) % 1800 as int) end as dod,
  case when c_custkey % 5 < 2 then date '1994-01-01' + cast((c_custkey * 49979687) % 2000 as int) end as hypertension_date,
  case when c_custkey % 6 = 1 then date '1994-01-01' + cast((c_custkey * 67867967) % 2000 as int) end as diabetes_date
from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey
"""

PRESCRIPTIONS = """
select o_custkey as patid, cast(o_orderdate as date) as eventdate, o_orderkey as event_id,
  case o_orderpriority when '1-URGENT' then 'BB' when '2-HIGH' then 'ACE' when '3-MEDIUM' then 'ARB'
    when '4-NOT SPECIFIED' then 'Diuretics' else 'statin' end as med_name
from {orders}
"""

MEASUREMENTS = """
select o_custkey as patid, cast(l_shipdate as date) as eventdate, l_orderkey * 10 + l_linenumber as event_id,
  case l_linenumber when 1 then 'bmi' when 2 then 'sbp' when 3 then 'dbp' when 4 then 'creatinine'
    when 5 then 'tchdl_rat' else 'smoke' end as measure_name,
  case l_linenumber when 1 then 15 + l_quantity / 2 when 2 then 90 + l_quantity * 1.5 when 3 then 50 + l_quantity
    when 4 then 50 + l_extendedprice / 1000 when 5 then 2 + l_discount * 40 end as value_num,
  case when l_linenumber = 6 then case l_returnflag when 'A' then 'Active smoker' when 'N' then 'Non-smoker'
    else 'Ex-smoker' end end as value_str
from {lineitem} join {orders} on l_orderkey = o_orderkey where l_linenumber <= 6
"""


def _run(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients, dealt by their number: few bytes each, so that files or exchanges sized by bytes would leave the
    dozens of rows that come of each to few tasks."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return _run(spark, sf_dir, PATIENTS, "customer", "nation", "region").repartition(parts, "patid")


def prescriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, PRESCRIPTIONS, "orders")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, MEASUREMENTS, "lineitem", "orders")
