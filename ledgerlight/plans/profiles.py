"""Applicant profiles that follow from the customer table, with every kind of gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .spread import dealt

#: Portable between SQL engines.
SQL = """select cast(c_custkey as bigint) as profile_id,
  cast(18 + c_custkey % 60 as double) as age,
  case when c_custkey % 11 = 0 then null else round(abs(c_acctbal) * 8, 2) end as monthly_income,
  case when c_custkey % 13 = 0 then null else cast(300 + (c_custkey * 37) % 601 as double) end as credit_score,
  case when c_custkey % 19 = 0 then null when c_mktsegment = 'BUILDING' then 'salaried' when c_mktsegment = 'AUTOMOBILE' then 'self_employed' when c_mktsegment = 'MACHINERY' then 'government' when c_mktsegment = 'HOUSEHOLD' then 'pensioner' else 'unemployed' end as employment_type,
  case when c_custkey % 23 = 0 then null else cast((c_custkey * 7) % 120 as double) end as work_experience_months,
  case when c_custkey % 17 = 0 then null when c_custkey % 29 = 0 then cast(c_custkey % 100 as double) else (c_custkey % 100) / 100e0 end as dti_ratio
from {customer}"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SQL, customer=dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal", "c_mktsegment")))
