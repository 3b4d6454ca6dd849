"""Stand-in inputs: views over the driver tables, in SQL that runs on Spark and DuckDB alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

RAW = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
       "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS = {
    "intake": """
SELECT o_orderkey AS intake_no, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_custkey END AS kcid, o_orderdate AS call_stamp,
  CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE o_orderpriority END AS disposition,
  CASE o_orderkey % 3 WHEN 0 THEN '6' WHEN 1 THEN '12' ELSE '0' END AS statute_timeline_ind,
  CASE WHEN o_orderkey % 11 = 0 THEN CAST('1900-01-01' AS DATE) ELSE o_orderdate + INTERVAL '1' SECOND * CAST(o_orderkey % 60 AS INT) END AS face_ref_stamp,
  o_orderdate + INTERVAL '1' MINUTE * CAST(o_orderkey * 7919 % 60000 - 2000 AS INT) AS disposition_stamp
FROM orders
""",
    "disposition_ref": """
SELECT * FROM (VALUES
  ('1-URGENT','new detention','Y','Y','N','N','MH','2021'), ('2-HIGH','revocation','N','Y','N','N','SUD','2021'),
  ('3-MEDIUM','voluntary','Y','N','Y','N','MH','2021'), ('4-NOT SPECIFIED','referral','Y','N','N','Y','MH','2021'),
  ('5-LOW','information','N','N','N','N','NA','2021'), ('1-URGENT','new detention','Y','Y','N','N','MH','2018'))
  AS t(disposition, description, investigation, detained, voluntary, discharge_referral, disposition_type, version)
""",
    "petition": """
SELECT DISTINCT l_orderkey * 10 + l_linenumber AS petition_no, l_orderkey AS intake_no, CAST(l_shipdate AS DATE) AS file_date
FROM lineitem WHERE l_returnflag = 'R'
""",
    "auth": """
SELECT o_orderkey AS auth_no, lpad(CAST(o_orderkey % 40 AS STRING), 3, '0') AS agency_id, o_custkey AS kcid,
  CASE o_orderpriority WHEN '1-URGENT' THEN '58' WHEN '2-HIGH' THEN 'SRS' ELSE 'IP' END AS program,
  'IP' AS auth_type, CASE o_orderstatus WHEN 'F' THEN 'AA' WHEN 'O' THEN 'TM' ELSE 'CX' END AS status_code,
  o_orderpriority AS status_reason, CAST(o_orderdate AS DATE) AS start_date,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INT) END AS expire_date
FROM orders
""",
    "facility_stay": """
SELECT l_orderkey * 10 + l_linenumber AS stay_no, l_orderkey AS auth_no, lpad(CAST(l_suppkey % 100 AS STRING), 3, '0') AS agency_id,
  CAST(l_shipdate AS DATE) AS admit_date,
  CASE WHEN l_quantity >= 49 THEN NULL ELSE CAST(l_shipdate AS DATE) + CAST(l_quantity AS INT) END AS discharge_date
FROM lineitem
""",
    "excluded_stay": """
SELECT DISTINCT l_orderkey * 10 + l_linenumber AS stay_no FROM lineitem WHERE l_linenumber = 7
""",
    "ip_master": """
SELECT o_orderkey AS auth_no, CASE WHEN o_orderkey % 2 = 0 THEN 'I' ELSE 'V' END AS ip_type FROM orders
""",
    "ip_invol": """
SELECT o_orderkey AS auth_no FROM orders WHERE o_orderkey % 2 = 0
""",
    "ip_vol": """
SELECT o_orderkey AS auth_no FROM orders WHERE o_orderkey % 2 = 1
""",
    "crosswalk": """
SELECT c_custkey AS kcid, 'P' || CAST(CASE WHEN c_custkey % 4 = 0 THEN c_custkey - c_custkey % 16 ELSE c_custkey END AS STRING) AS p1_id,
  CAST('2000-01-01' AS DATE) + CAST(c_custkey * 31 % 997 AS INT) AS post_stamp
FROM customer
""",
    "coverage": """
SELECT DISTINCT o_custkey AS kcid, CASE WHEN o_orderkey % 3 = 0 THEN 'F20' ELSE 'F19' END AS plan,
  CAST(date_trunc('month', o_orderdate) AS DATE) AS start_date,
  CASE WHEN o_orderkey % 7 = 0 THEN last_day(CAST(o_orderdate AS DATE)) + 31 ELSE last_day(CAST(o_orderdate AS DATE)) END AS end_date
FROM orders
""",
    "monthly_coverage": """
SELECT DISTINCT o_custkey AS kcid,
  CAST(year(o_orderdate) AS STRING) || '-' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS census_month,
  CASE o_custkey % 4 WHEN 0 THEN 'AGP' WHEN 1 THEN 'CHP' ELSE 'MHW' END AS mco
FROM orders
""",
    "claim_header": """
SELECT 'P' || CAST(o_custkey AS STRING) AS id_mcaid, o_orderkey AS claim_header_id, CAST(o_orderkey % 8 AS INT) AS claim_type_id,
  CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS admsn_date,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 5 END AS dschrg_date,
  CAST(o_orderdate AS DATE) AS first_service_date, CAST(o_orderdate AS DATE) + 5 AS last_service_date
FROM orders
""",
    "claim_line": """
SELECT 'P' || CAST(o_custkey AS STRING) AS id_mcaid, l_orderkey AS claim_header_id, CAST(l_partkey AS STRING) AS rev_code,
  CAST(l_shipdate AS DATE) AS first_service_date, CAST(l_shipdate AS DATE) + 5 AS last_service_date
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""",
    "claim_dx": """
SELECT 'P' || CAST(o_custkey AS STRING) AS id_mcaid, l_orderkey AS claim_header_id, CAST(l_partkey AS STRING) AS icdcm_norm,
  CASE WHEN l_tax >= 0.07 THEN 9 ELSE 10 END AS icdcm_version, lpad(CAST(l_linenumber AS STRING), 2, '0') AS icdcm_number,
  CAST(o_orderdate AS DATE) AS first_service_date
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""",
    "claim_pharm": """
SELECT 'P' || CAST(o_custkey AS STRING) AS id_mcaid, CAST(l_partkey AS STRING) AS ndc, CAST(l_shipdate AS DATE) AS rx_fill_date
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'N'
""",
    "hedis_codes": """
SELECT CASE WHEN p_size % 5 = 0 THEN '2018' ELSE '2020' END AS version,
  CASE p_type WHEN 'ECONOMY' THEN 'Inpatient Stay' WHEN 'PROMO' THEN 'Inpatient Stay' WHEN 'SMALL' THEN 'Mental Illness'
    WHEN 'LARGE' THEN 'Mental Health Diagnosis' WHEN 'MEDIUM' THEN 'Intentional Self-Harm' ELSE 'Nonacute Inpatient Stay' END AS value_set_name,
  CASE WHEN p_type IN ('SMALL','LARGE','MEDIUM') THEN 'ICD10CM' ELSE 'UBREV' END AS code_system,
  CAST(p_partkey AS STRING) AS code, p_name AS definition
FROM part
""",
    "value_set": """
SELECT CASE WHEN p_type IN ('ECONOMY','SMALL') THEN 'MI-Diagnosis' WHEN p_type IN ('PROMO','LARGE') THEN 'SUD-Dx-Value-Set' ELSE 'Psychotropic-NDC' END AS value_set_name,
  p_brand AS code_set, CAST(p_partkey AS STRING) AS code,
  CASE WHEN p_type IN ('ECONOMY','SMALL') THEN CASE p_size % 5 WHEN 0 THEN 'ADHD' WHEN 1 THEN 'Anxiety' WHEN 2 THEN 'Depression' WHEN 3 THEN 'Mania/Bipolar' ELSE 'Psychotic' END
    WHEN p_type IN ('PROMO','LARGE') THEN CASE p_size % 5 WHEN 0 THEN 'NA' WHEN 1 THEN 'Hallucinogen' WHEN 2 THEN 'Inhalant' WHEN 3 THEN 'Cannabis' ELSE 'Opioid' END
    ELSE CASE p_size % 5 WHEN 0 THEN 'ADHD Rx' WHEN 1 THEN 'Antianxiety Rx' WHEN 2 THEN 'Antidepressants Rx' WHEN 3 THEN 'Antimania Rx' ELSE 'Antipsychotic Rx' END END AS sub_group
FROM part
""",
    "dx_lookup": """
SELECT CAST(p_partkey AS STRING) AS dx, 10 AS dx_ver,
  CASE WHEN p_size % 10 = 1 THEN 1 ELSE 0 END AS ccw_a, CASE WHEN p_size % 10 IN (2, 3) THEN 1 ELSE 0 END AS ccw_b,
  CASE WHEN p_size % 10 = 4 THEN 1 ELSE 0 END AS ccw_a_excl, CASE WHEN p_size % 10 = 5 THEN 1 ELSE 0 END AS ccw_b_excl
FROM part
""",
    "windows": """
SELECT m AS start_window, CAST(last_day(CAST(m + INTERVAL '23' MONTH AS DATE)) AS DATE) AS end_window
FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders) t
""",
    "demographics": """
SELECT c_custkey AS kcid, CASE WHEN c_custkey % 13 = 0 THEN 1 ELSE 0 END AS Multiple_race,
  CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS AIAN, CASE WHEN c_custkey % 7 = 1 THEN 1 ELSE 0 END AS Asian,
  CASE WHEN c_custkey % 7 = 2 THEN 1 ELSE 0 END AS BlackAA, CASE WHEN c_custkey % 17 = 3 THEN 1 ELSE 0 END AS MENA,
  CASE WHEN c_custkey % 19 = 4 THEN 1 ELSE 0 END AS NHPI, CASE WHEN c_custkey % 23 = 5 THEN 1 ELSE 0 END AS Other,
  CASE WHEN c_custkey % 7 = 6 THEN 1 ELSE 0 END AS Unknown_Race, CASE WHEN c_custkey % 7 IN (3, 4) THEN 1 ELSE 0 END AS White,
  CASE c_custkey % 10 WHEN 0 THEN 'yes' WHEN 1 THEN 'unknown' WHEN 2 THEN NULL ELSE 'no' END AS hispanic,
  CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE CAST('1930-01-01' AS DATE) + CAST(c_custkey * 37 % 22000 AS INT) END AS dob
FROM customer
""",
    "metric": """
SELECT last_day(CAST(o_orderdate AS DATE)) AS report_date, CASE WHEN o_orderstatus = 'F' THEN 'ITA_NEW_DETAINED' ELSE 'ITA_INVEST' END AS met_abbr, count(*) AS count
FROM orders GROUP BY 1, 2
""",
    "person_list": """
SELECT CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey END AS kcid, CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 1 ELSE NULL END AS kcid2
FROM customer WHERE c_mktsegment = 'BUILDING'
""",
    "code_dict": """
SELECT DISTINCT 'mktsegment' AS column_name, c_mktsegment AS code_id FROM customer
UNION ALL SELECT DISTINCT 'orderstatus' AS column_name, o_orderstatus AS code_id FROM orders
""",
}

_TABLE = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join(RAW) + r")\b")


_SCHEMAS: dict[str, StructType] = {}


class Inputs:
    """The driver tables of one folder and the views on them, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._views: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        if path not in _SCHEMAS:  # reading the footer is a job of its own: once per file is enough
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        if name not in self._views:
            text = VIEWS[name]
            used = {m.group(2) for m in _TABLE.finditer(text)}
            self._views[name] = self.spark.sql(_TABLE.sub(r"\1 {\2}", text), **{t: self.raw(t) for t in used})
        return self._views[name]
