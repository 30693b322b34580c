"""The input tables of the analysis, as views of the star-schema test tables.

The same text runs in Spark and, as common table expressions, in the SQL that checks the results.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Added before rounding: engines differ in how they round an exact half.
NUDGE = 1e-9
TABLES = ["nation", "supplier", "customer", "part", "orders", "lineitem"]

_NAMES = "CASE s_suppkey%5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END"

VIEWS = {
    "claims": """
SELECT CAST(l_suppkey AS STRING) billing_npi,
 CAST(CASE WHEN l_returnflag='R' THEN l_suppkey+1 ELSE l_suppkey END AS STRING) servicing_npi,
 CONCAT(p_brand,':',p_type) hcpcs_code, CAST(date_trunc('month',l_shipdate) AS DATE) claim_from_month,
 CAST(l_linenumber AS BIGINT) total_unique_beneficiaries, CAST(l_quantity AS BIGINT) total_claims, l_extendedprice total_paid
FROM {lineitem} JOIN {part} ON l_partkey=p_partkey""",
    "code_categories": """
SELECT DISTINCT CONCAT(p_brand,':',p_type) hcpcs_code,
 CASE p_type WHEN 'SMALL' THEN 'skilled_nursing' WHEN 'ECONOMY' THEN 'aide' WHEN 'PROMO' THEN 'personal_care'
  WHEN 'MEDIUM' THEN 'therapy' ELSE 'assessment' END hh_category
FROM {part} WHERE p_type<>'STANDARD'""",
    "providers": """
SELECT CAST(s_suppkey AS STRING) npi, CASE WHEN s_suppkey%3=0 THEN 1 ELSE 2 END entity_type, n_name state,
 CASE WHEN s_suppkey%4=0 THEN '251E00000X' WHEN s_suppkey%4=1 THEN '253Z00000X' WHEN s_suppkey%4=2 THEN '251J00000X'
  ELSE '207RC0000X' END primary_taxonomy,
 CAST('2005-05-23' AS DATE) + CAST(s_suppkey%1000 AS INT) enumeration_date,
 CASE WHEN s_acctbal<0 THEN CAST('2020-01-15' AS DATE) END deactivation_date,
 CASE WHEN s_suppkey%10=3 THEN CAST('2021-06-01' AS DATE) END reactivation_date,
 CASE WHEN s_suppkey%3=0 THEN CASE WHEN s_suppkey%2=0 THEN 'Y' ELSE 'N' END END sole_proprietor,
 CASE WHEN s_suppkey%7=0 THEN 'Y' ELSE 'N' END org_subpart,
 CASE WHEN s_suppkey%2=0 THEN '208D00000X' END taxonomy_2, CASE WHEN s_suppkey%6=0 THEN '363L00000X' END taxonomy_3
FROM {supplier} JOIN {nation} ON s_nationkey=n_nationkey""",
    "org_npis": """
SELECT CONCAT('C',CAST(c_custkey AS STRING)) npi, c_name org_name, CASE WHEN c_custkey%5=0 THEN CONCAT('DBA ',c_name) END org_dba,
 CONCAT('ADDR ',CAST(c_custkey%3 AS STRING)) address_line1, CONCAT('CITY ',CAST(c_custkey%2 AS STRING)) city, n_name state,
 '00000-1234' zip5, CASE WHEN c_acctbal<0 THEN '2020-01-15' END deactivation_date,
 CASE WHEN c_acctbal<0 AND c_custkey%2=0 THEN '2021-06-01' END reactivation_date,
 CASE WHEN c_custkey%4=0 THEN ' y' WHEN c_custkey%4=1 THEN 'N' END is_subpart,
 c_mktsegment ao_last,
 CASE WHEN c_custkey%50=7 THEN CONCAT('S',CAST(c_custkey AS STRING)) ELSE CAST(c_custkey%40 AS STRING) END ao_first,
 CASE WHEN c_custkey%40<20 THEN 'M' ELSE '' END ao_middle, CONCAT('555-',CAST(c_custkey%7 AS STRING)) ao_phone,
 CASE WHEN c_custkey%9=0 THEN '251E00000X' ELSE '207RC0000X' END primary_taxonomy
FROM {customer} JOIN {nation} ON c_nationkey=n_nationkey""",
    "raw_orgs": """
SELECT CONCAT('C',CAST(c_custkey AS STRING)) npi, CASE WHEN c_custkey%13=0 THEN '1' ELSE '2' END entity_type,
 CONCAT(c_name,', the "',n_name,'" group') org_name, CASE WHEN c_custkey%5=0 THEN CONCAT('DBA ',c_name) END org_dba, n_name state,
 CASE WHEN c_custkey%17=0 THEN '  ' WHEN c_custkey%19=0 THEN NULL ELSE CONCAT(' ',LOWER(c_mktsegment)) END ao_last,
 CONCAT(CAST(c_custkey%40 AS STRING),' ') ao_first, CASE WHEN c_custkey%3=0 THEN 'm ' END ao_middle
FROM {customer} JOIN {nation} ON c_nationkey=n_nationkey""",
    "exclusions": f"""
SELECT CASE WHEN s_suppkey%4=3 THEN '' ELSE {_NAMES} END lastname, CAST(s_suppkey%40 AS STRING) firstname,
 CASE WHEN s_suppkey%3=0 THEN 'M' ELSE '' END midname, CASE WHEN s_suppkey%4=3 THEN c_name WHEN s_suppkey%9=0 THEN 'BOTH' ELSE '' END busname,
 CASE WHEN s_suppkey%4=0 THEN 'CITY 0' ELSE '' END city, CASE WHEN s_suppkey%4=3 THEN cn.n_name ELSE n.n_name END state,
 CASE WHEN s_suppkey%20=0 THEN CONCAT('C',CAST(s_suppkey AS STRING)) ELSE '0000000000' END npi,
 CASE WHEN s_suppkey%2=0 THEN '1128a1' ELSE '1128b4' END excltype, CAST(20100101+s_suppkey%5 AS STRING) excldate
FROM {{supplier}} JOIN {{nation}} n ON s_nationkey=n.n_nationkey JOIN {{customer}} ON c_custkey=s_suppkey
 JOIN {{nation}} cn ON c_nationkey=cn.n_nationkey""",
    "individuals": f"""
SELECT CAST(s_suppkey AS STRING) npi, CASE WHEN s_suppkey%23=0 THEN '2' ELSE '1' END entity_type, {_NAMES} ind_last,
 CAST(s_suppkey%40 AS STRING) ind_first, n_name ind_state,
 CASE WHEN s_acctbal<0 THEN '2020-01-15' END deactivation_date, '207RC0000X' ind_taxonomy
FROM {{supplier}} JOIN {{nation}} ON s_nationkey=n_nationkey""",
    "deactivated": "SELECT CAST(s_suppkey AS STRING) npi FROM {supplier} WHERE s_suppkey%3=0",
    "org_claims": """
SELECT CONCAT('C',CAST(o_custkey AS STRING)) billing_npi, o_orderpriority hcpcs_code,
 CAST(date_trunc('month',o_orderdate) AS DATE) claim_from_month, CAST(1 AS BIGINT) total_claims,
 CAST(1 AS BIGINT) total_unique_beneficiaries, o_totalprice total_paid
FROM {orders}""",
}


def check_sql(text: str) -> str:
    """The statement with the views it names put in front as common table expressions."""
    used = [name for name in VIEWS if re.search(rf"\b{name}\b", text)]
    views = [f"{name} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[name]).strip()})" for name in used]
    text = text.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if text.upper().startswith(start):
            return start + ",\n".join([*views, text[len(start):]])
    return "WITH " + ",\n".join(views) + "\n" + text


class Tables:
    """The views over one folder of test tables, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        used = sorted(set(re.findall(r"{(\w+)}", text)))
        frames = {table: self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet") for table in used}
        return self.spark.sql(text, **frames)

    @cached_property
    def claims(self) -> DataFrame:
        return self.view("claims")

    @cached_property
    def code_categories(self) -> DataFrame:
        return self.view("code_categories")

    @cached_property
    def providers(self) -> DataFrame:
        from claimscope.functions.columns import count_non_null

        taxonomies = ["primary_taxonomy", "taxonomy_2", "taxonomy_3"]
        return self.view("providers").withColumn("num_taxonomy_codes", count_non_null(taxonomies))

    @cached_property
    def orgs(self) -> DataFrame:
        from claimscope.operators.networks import org_flags

        return org_flags(self.view("org_npis"))

    @cached_property
    def raw_orgs(self) -> DataFrame:
        return self.view("raw_orgs")

    @cached_property
    def exclusions(self) -> DataFrame:
        return self.view("exclusions")

    @cached_property
    def individuals(self) -> DataFrame:
        return self.view("individuals")

    @cached_property
    def deactivated(self) -> DataFrame:
        return self.view("deactivated")

    @cached_property
    def org_claims(self) -> DataFrame:
        return self.view("org_claims")


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and arrays joined to text, so that two engines can be compared by value."""
    columns = []
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        column = F.col(f"`{field.name}`")
        if kind == "double":
            column = F.round(column + NUDGE, digits)
        elif kind.startswith("array"):
            column = F.array_join(column.cast("array<string>"), "|")
        columns.append(column.alias(field.name))
    return df.select(*columns)
