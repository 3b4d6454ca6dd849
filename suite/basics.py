"""Scans, projections, joins, aggregates, windows, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import dates, labels
from strandline.operators import relational as rel
from strandline.operators import sequence as seq
from strandline.plans import admissions, conditions, demographics, detentions
from strandline.session import work_folder
from strandline.sources import sinks, tables
from suite.parts import AGENCIES, END, FROM, REVOKED, START, TO
from suite.registry import query

DISTRIBUTION_SQL = "SELECT n AS max_ita, count(kcid) AS count FROM (SELECT kcid, count(*) AS n FROM det_period GROUP BY kcid) GROUP BY n"


def detained(t):
    return detentions.detained_intakes(t.intake, t.disposition_ref, START, END)


def involuntary(t):
    return admissions.involuntary_admissions(t.auth, t.facility_stay, t.ip_invol, admissions.status_in(), None, FROM, TO)


def condition_table(t):
    return conditions.condition_person_table(t.claim_dx, t.claim_pharm, t.value_set, FROM, TO)


PERSON_TABLE_SQL = f"""
SELECT DISTINCT id_mcaid, bh_cond AS indicator, DATE '{FROM}' AS from_date, DATE '{TO}' AS to_date FROM ev_all
WHERE svc_date BETWEEN DATE '{FROM}' AND DATE '{TO}'"""


# ---- scans, sources, sinks --------------------------------------------------------

@query("table_scan", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def _(t):
    return tables.table_scan(t.spark, "orders", ["o_orderkey", "o_custkey", "o_orderpriority"], root=t.sf_dir)


@query("config_scan", "SELECT id_mcaid, claim_header_id, first_service_date FROM claim_header")
def _(t):
    t.claim_header.createOrReplaceTempView("suite_claim_header")
    config = {"claim_header_from_table": "unused", "second": {"claim_header_from_table": "suite_claim_header"}}
    return tables.config_scan(
        t.spark, config, "claim_header_from", ["claim_header_id", "first_service_date"], source="mcaid", server="second"
    )


@query("row_cap", "SELECT intake_no, kcid FROM intake ORDER BY intake_no LIMIT 100")
def _(t):
    return tables.row_cap(t.intake.select("intake_no", "kcid"), ["intake_no"], 100)


@query("metric_file_scan", f"""
SELECT report_date, met_abbr, count FROM metric WHERE met_abbr IN ('ITA_NEW_DETAINED', 'ITA_INVEST')
  AND report_date >= DATE '{FROM}' AND report_date <= DATE '{TO}'""")
def _(t):
    path = work_folder(t.spark, "metric")
    t.metric.write.option("header", True).csv(path)
    return tables.metric_file_scan(t.spark, path, ["ITA_NEW_DETAINED", "ITA_INVEST"], FROM, TO)


@query("key_list_load", "SELECT kcid, kcid2 FROM person_list WHERE kcid IS NOT NULL")
def _(t):
    return tables.key_list_load(t.person_list, "kcid", "kcid2", "suite_person_list")


@query("stage_intermediate", "SELECT kcid, count(*) AS n FROM det_period GROUP BY kcid HAVING count(*) > 1")
def _(t):
    staged = tables.stage_intermediate(detained(t), "suite_detained")
    return staged.groupBy("kcid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("overwrite_result", PERSON_TABLE_SQL)
def _(t):
    path = work_folder(t.spark, "result")
    sinks.overwrite_result(t.claim_pharm.select("id_mcaid"), path)
    return sinks.overwrite_result(condition_table(t), path)


@query("append_with_stamp", """
SELECT id_mcaid, svc_date, bh_cond FROM ev_dx UNION ALL SELECT id_mcaid, svc_date, bh_cond FROM ev_rx""")
def _(t):
    path = work_folder(t.spark, "events")
    sinks.declare_result(t.spark, path, "id_mcaid string, svc_date date, bh_cond string, last_run timestamp")
    sinks.append_with_stamp(conditions.conditions_from_diagnosis(t.claim_dx, t.value_set), path)
    out = sinks.append_with_stamp(conditions.conditions_from_pharmacy(t.claim_pharm, t.value_set), path)
    return out.filter(F.col("last_run").isNotNull()).drop("last_run")


@query("declare_result", "SELECT kcid, max_ita FROM (SELECT kcid, count(*) AS max_ita FROM det_period GROUP BY kcid)")
def _(t):
    path = work_folder(t.spark, "declared")
    declared = sinks.declare_result(t.spark, path, "kcid bigint, max_ita bigint")
    return declared.unionByName(detentions.repeat_counts(detained(t)))


@query("report_export", f"""
SELECT 'by_repeat' AS sheet, CAST(max_ita AS VARCHAR) AS label, count FROM ({DISTRIBUTION_SQL})
UNION ALL SELECT 'by_condition', indicator, count(id_mcaid) FROM ({PERSON_TABLE_SQL}) GROUP BY indicator""")
def _(t):
    by_repeat = detentions.repeat_distribution(detained(t)).select(F.col("max_ita").cast("string").alias("label"), "count")
    by_condition = conditions.condition_counts(condition_table(t)).select(
        F.col("indicator").alias("label"), F.col("cnt").alias("count")
    )
    paths = sinks.report_export({"by_repeat": by_repeat, "by_condition": by_condition}, work_folder(t.spark, "report"))
    sheets = [
        t.spark.read.schema("label string, count bigint").option("header", True).csv(path).select(
            F.lit(name).alias("sheet"), "label", "count"
        ) for name, path in paths.items()
    ]
    return rel.stack_by_name(*sheets)


# ---- projections, filters, predicates ---------------------------------------------

@query("project_rename", "SELECT intake_no AS ita_auth_no, kcid, call_stamp FROM intake")
def _(t):
    return t.intake.select(F.col("intake_no").alias("ita_auth_no"), "kcid", "call_stamp")


@query("constant_column", f"SELECT auth_no, 1 AS invol_flag, DATE '{FROM}' AS from_date FROM ip_invol")
def _(t):
    return t.ip_invol.select("auth_no", F.lit(1).alias("invol_flag"), dates.as_date(FROM).alias("from_date"))


@query("not_null_filter", "SELECT intake_no, kcid FROM intake WHERE kcid IS NOT NULL AND disposition IS NOT NULL")
def _(t):
    return t.intake.filter(F.col("kcid").isNotNull() & F.col("disposition").isNotNull()).select("intake_no", "kcid")


@query("closed_range_filter", f"SELECT stay_no, admit_date FROM facility_stay WHERE admit_date >= DATE '{FROM}' AND admit_date <= DATE '{TO}'")
def _(t):
    return t.facility_stay.filter(labels.in_closed_range("admit_date", FROM, TO)).select("stay_no", "admit_date")


@query("stamp_range_filter", f"""
SELECT intake_no, disposition_stamp FROM intake WHERE disposition_stamp >= TIMESTAMP '{FROM} 00:00:00' AND disposition_stamp <= TIMESTAMP '{TO} 00:00:00'""")
def _(t):
    return t.intake.filter(labels.stamp_in_range("disposition_stamp", FROM, TO)).select("intake_no", "disposition_stamp")


@query("in_list_filter", "SELECT auth_no, status_code FROM auth WHERE status_code = 'TM' OR status_code = 'AA'")
def _(t):
    return t.auth.filter(admissions.status_in()).select("auth_no", "status_code")


@query("exclude_status", "SELECT auth_no, status_code FROM auth WHERE NOT (status_code = 'CX')")
def _(t):
    return t.auth.filter(admissions.status_not()).select("auth_no", "status_code")


@query("either_date_in_period", f"""
SELECT stay_no, admit_date, discharge_date FROM facility_stay
WHERE (discharge_date >= DATE '{FROM}' AND discharge_date <= DATE '{TO}') OR (admit_date >= DATE '{FROM}' AND admit_date <= DATE '{TO}')""")
def _(t):
    return t.facility_stay.filter(labels.either_in_period("discharge_date", "admit_date", FROM, TO)).select(
        "stay_no", "admit_date", "discharge_date"
    )


@query("fallback_range", f"""
SELECT claim_header_id, admsn_date, first_service_date FROM claim_header
WHERE coalesce(admsn_date, first_service_date) BETWEEN DATE '{FROM}' AND DATE '{TO}'""")
def _(t):
    return t.claim_header.filter(labels.fallback_in_range("admsn_date", "first_service_date", FROM, TO)).select(
        "claim_header_id", "admsn_date", "first_service_date"
    )


@query("min_duration_or_open", """
SELECT auth_no, start_date, expire_date FROM auth WHERE coalesce(expire_date - start_date, 180) >= 180""")
def _(t):
    return t.auth.filter(labels.lasted_or_open("start_date", "expire_date", 180)).select("auth_no", "start_date", "expire_date")


@query("indicator_flag", f"""
SELECT intake_no, detained, new_detained, revoked_detained FROM classified_intakes""")
def _(t):
    is_detained = F.col("detained") == "Y"
    return t.intake.filter(F.col("disposition").isNotNull()).join(t.disposition_ref, "disposition", "left").select(
        "intake_no", labels.yes_flag("detained").alias("detained"),
        labels.flag(is_detained & (F.col("disposition") != REVOKED)).alias("new_detained"),
        labels.flag(is_detained & (F.col("disposition") == REVOKED)).alias("revoked_detained"),
    )


@query("code_relabel", """
SELECT code, sub_group, CASE sub_group WHEN 'ADHD Rx' THEN 'ADHD' WHEN 'Antianxiety Rx' THEN 'Anxiety' WHEN 'Antidepressants Rx' THEN 'Depression'
  WHEN 'Antimania Rx' THEN 'Mania/Bipolar' WHEN 'Antipsychotic Rx' THEN 'Psychotic' END AS bh_cond FROM value_set""")
def _(t):
    return t.value_set.select("code", "sub_group", labels.relabel("sub_group", conditions.DRUG_CONDITIONS).alias("bh_cond"))


@query("count_bucket", """
SELECT kcid, n AS max_ita, CASE n WHEN 1 THEN 'whut' WHEN 2 THEN 'two' WHEN 3 THEN 'three' WHEN 4 THEN 'four-five' WHEN 5 THEN 'four-five'
  ELSE 'more than 5' END AS grp FROM (SELECT kcid, count(*) AS n FROM det_period GROUP BY kcid)""")
def _(t):
    return detentions.repeat_counts(detained(t)).withColumn("grp", labels.count_bucket("max_ita"))


@query("facility_type", f"""
SELECT stay_no, agency_id, CASE WHEN list_contains({AGENCIES}, agency_id) THEN 'ET' ELSE 'OTHER' END AS facility_type FROM facility_stay""")
def _(t):
    return t.facility_stay.select("stay_no", "agency_id", labels.facility_type("agency_id", AGENCIES).alias("facility_type"))


@query("null_default", """
SELECT h.claim_header_id, count(l.claim_header_id) AS n_lines FROM claim_header h
LEFT JOIN (SELECT * FROM claim_line WHERE rev_code IN (SELECT code FROM inpatient_codes)) l ON h.claim_header_id = l.claim_header_id GROUP BY ALL""")
def _(t):
    codes = rel.code_rows(t.hedis_codes, ["Inpatient Stay"], "UBREV", "2020")
    lines = rel.with_code_in(t.claim_line, "rev_code", codes).groupBy("claim_header_id").agg(F.count(F.lit(1)).alias("n"))
    return t.claim_header.select("claim_header_id").join(lines, "claim_header_id", "left").select(
        "claim_header_id", F.coalesce("n", F.lit(0)).alias("n_lines")
    )


@query("conditional_overwrite", """
SELECT auth_no, CASE WHEN coalesce(expire_date, DATE '2001-01-01') < DATE '2001-01-01' THEN 0 ELSE 1 END AS capped_end,
  CASE WHEN coalesce(expire_date, DATE '2001-01-01') < DATE '2001-01-01' THEN expire_date ELSE DATE '2000-12-31' END AS expire_date FROM auth""")
def _(t):
    return rel.conditional_cap(t.auth, "expire_date", "2001-01-01", "2000-12-31", "capped_end").select(
        "auth_no", "capped_end", "expire_date"
    )


@query("row_sum", "SELECT kcid, AIAN + Asian + BlackAA + MENA + NHPI + Other + White + unknown AS sum_race FROM recoded")
def _(t):
    return demographics.recode_ethnicity(t.demographics).select("kcid", labels.row_sum(demographics.SUMMED).alias("sum_race"))


@query("column_ratio", """
SELECT report_date, count(*) FILTER (WHERE f) AS part, count(*) AS whole, CAST(count(*) FILTER (WHERE f) AS DOUBLE) / count(*) AS pct
FROM (SELECT last_day(CAST(o_orderdate AS DATE)) AS report_date, o_orderstatus = 'F' AS f FROM orders) GROUP BY report_date""")
def _(t):
    per_month = t.metric.groupBy("report_date").agg(
        F.sum(F.when(F.col("met_abbr") == "ITA_NEW_DETAINED", F.col("count")).otherwise(0)).alias("part"), F.sum("count").alias("whole")
    )
    return per_month.withColumn("pct", labels.ratio("part", "whole"))


# ---- joins ------------------------------------------------------------------------

@query("inner_equi_join", """
SELECT auth_no, a.kcid, s.stay_no, s.admit_date FROM auth a JOIN facility_stay s USING (auth_no) JOIN ip_invol r USING (auth_no)""")
def _(t):
    return t.auth.join(t.facility_stay.drop("agency_id"), "auth_no").join(t.ip_invol, "auth_no").select(
        "auth_no", "kcid", "stay_no", "admit_date"
    )


@query("left_lookup_join", """
SELECT i.intake_no, i.disposition, d.description, d.version FROM intake i LEFT JOIN disposition_ref d ON d.disposition = i.disposition""")
def _(t):
    return t.intake.join(t.disposition_ref, "disposition", "left").select("intake_no", "disposition", "description", "version")


@query("left_two_key_join", """
SELECT i.intake_no, i.kcid, strftime(i.call_stamp, '%Y-%m') AS call_month, m.mco FROM intake i
LEFT JOIN monthly_coverage m ON i.kcid = m.kcid AND strftime(i.call_stamp, '%Y-%m') = m.census_month""")
def _(t):
    cover = t.monthly_coverage.withColumnRenamed("census_month", "call_month")
    return t.intake.withColumn("call_month", dates.month_key_text("call_stamp")).join(
        cover, ["kcid", "call_month"], "left"
    ).select("intake_no", "kcid", "call_month", "mco")


@query("value_set_join", """
SELECT l.id_mcaid, l.claim_header_id, l.rev_code, k.definition FROM claim_line l JOIN hedis_codes k ON l.rev_code = k.code
WHERE k.value_set_name = 'Inpatient Stay' AND k.code_system = 'UBREV' AND k.version = '2020'""")
def _(t):
    codes = t.hedis_codes.filter("value_set_name = 'Inpatient Stay' AND code_system = 'UBREV' AND version = '2020'")
    return rel.with_code_columns(t.claim_line, "rev_code", codes.select("code", "definition")).select(
        "id_mcaid", "claim_header_id", "rev_code", "definition"
    )


@query("left_join_on_range", f"""
SELECT l.id_mcaid, l.claim_header_id, h.admsn_date FROM claim_line l
LEFT JOIN claim_header h ON l.claim_header_id = h.claim_header_id AND h.admsn_date BETWEEN DATE '{FROM}' AND DATE '{TO}'""")
def _(t):
    lines = t.claim_line.select("id_mcaid", "claim_header_id")
    header = t.claim_header.select("claim_header_id", "admsn_date")
    return rel.left_join_in_range(lines, header, "claim_header_id", labels.in_closed_range("admsn_date", FROM, TO)).select(
        "id_mcaid", "claim_header_id", "admsn_date"
    )


@query("semi_join", "SELECT claim_header_id, id_mcaid FROM claim_header h WHERE EXISTS (SELECT 1 FROM cohort c WHERE c.p1_id = h.id_mcaid)")
def _(t):
    from suite.composites import program_cohort

    return rel.in_keys(t.claim_header, "id_mcaid", (program_cohort(t), "p1_id")).select("claim_header_id", "id_mcaid")


@query("either_key_semi_join", """
SELECT auth_no, kcid FROM auth WHERE kcid IN (SELECT kcid FROM person_list) OR kcid IN (SELECT kcid2 FROM person_list)""")
def _(t):
    return rel.in_keys(t.auth, "kcid", (t.person_list, "kcid"), (t.person_list, "kcid2")).select("auth_no", "kcid")


@query("anti_join", """
SELECT s.stay_no, s.auth_no FROM facility_stay s LEFT JOIN excluded_stay x ON s.stay_no = x.stay_no WHERE x.stay_no IS NULL""")
def _(t):
    return rel.not_in_keys(t.facility_stay, "stay_no", t.excluded_stay, "stay_no").select("stay_no", "auth_no")


@query("right_join", """
SELECT p.petition_no, i.intake_no, i.kcid FROM intake i LEFT JOIN petition p ON p.intake_no = i.intake_no""")
def _(t):
    petitions = t.petition.select("intake_no", "petition_no")
    return rel.left_join_many(t.intake.select("intake_no", "kcid"), petitions, "intake_no").select("petition_no", "intake_no", "kcid")


@query("constant_key_cross_join", """
SELECT k.kcid, w.start_window, w.end_window FROM (SELECT DISTINCT kcid FROM coverage) k CROSS JOIN windows w""")
def _(t):
    # Calendar windows are few and each person needs all: attach them as a list, then open it.
    calendar = conditions.Calendar.of(t.windows)
    return calendar.explode(F.lit(0), F.lit(calendar.n - 1), ["kcid"], t.coverage.select("kcid").distinct())


@query("point_in_window_join", """
SELECT p.id_mcaid, p.ndc, p.rx_fill_date, w.start_window FROM claim_pharm p JOIN windows w ON p.rx_fill_date BETWEEN w.start_window AND w.end_window""")
def _(t):
    return rel.window_pairs(t.claim_pharm, t.windows, "rx_fill_date").select("id_mcaid", "ndc", "rx_fill_date", "start_window")


@query("left_join_then_filter", """
SELECT i.intake_no, d.disposition_type FROM intake i LEFT JOIN disposition_ref d ON i.disposition = d.disposition
WHERE d.detained = 'Y' AND d.version = '2021'""")
def _(t):
    return t.intake.join(t.disposition_ref.filter("detained = 'Y' AND version = '2021'"), "disposition").select(
        "intake_no", "disposition_type"
    )


@query("summary_chain_join", """
WITH y AS (SELECT year(call_stamp) AS call_year, disposition FROM intake),
a AS (SELECT call_year, count(*) AS n_urgent FROM y WHERE disposition = '1-URGENT' GROUP BY 1),
b AS (SELECT call_year, count(*) AS n_high FROM y WHERE disposition = '2-HIGH' GROUP BY 1),
c AS (SELECT call_year, count(*) AS n_all FROM y GROUP BY 1)
SELECT CAST(a.call_year AS INT) AS call_year, n_urgent, n_high, n_all FROM a LEFT JOIN b USING (call_year) LEFT JOIN c USING (call_year)""")
def _(t):
    what = F.col("disposition")
    return rel.count_chain(t.intake, [F.year("call_stamp").alias("call_year")], {"n_urgent": what == "1-URGENT", "n_high": what == "2-HIGH", "n_all": None})


@query("group_share_join", """
SELECT a.report_date, subset_count, total_count FROM
  (SELECT last_day(start_date) AS report_date, count(auth_no) AS subset_count FROM auth WHERE program = '58' GROUP BY 1) a JOIN
  (SELECT last_day(start_date) AS report_date, count(auth_no) AS total_count FROM auth GROUP BY 1) b ON a.report_date = b.report_date""")
def _(t):
    rows = t.auth.withColumn("report_date", dates.month_end("start_date"))
    return rel.subset_share(rows, ["report_date"], "auth_no", F.col("program") == "58")


# ---- aggregates and reshaping -----------------------------------------------------

@query("group_count", "SELECT disposition, count(kcid) AS n_with_person FROM intake GROUP BY disposition")
def _(t):
    return t.intake.groupBy("disposition").agg(F.count("kcid").alias("n_with_person"))


@query("flag_sum", f"""
SELECT CAST(year(admit_date) AS INT) AS admit_year, CAST(sum(CASE WHEN agency_id IN ('058', '081', '082', '086', '005') THEN 1 ELSE 0 END) AS BIGINT) AS n_et
FROM facility_stay GROUP BY 1""")
def _(t):
    is_et = labels.flag(F.col("agency_id").isin(AGENCIES))
    return t.facility_stay.groupBy(F.year("admit_date").alias("admit_year")).agg(F.sum(is_et).alias("n_et"))


@query("distinct_count", """
SELECT program, count(auth_no) AS n_auth, count(DISTINCT kcid) AS n_person FROM auth GROUP BY program""")
def _(t):
    return t.auth.groupBy("program").agg(F.count("auth_no").alias("n_auth"), F.countDistinct("kcid").alias("n_person"))


@query("distinct_count_with_null", """
SELECT disposition, count(DISTINCT coalesce(kcid, -1)) AS count FROM intake GROUP BY disposition""")
def _(t):
    return t.intake.groupBy("disposition").agg(rel.distinct_with_null("kcid").alias("count"))


@query("min_max", "SELECT agency_id, min(admit_date) AS first_admit, max(discharge_date) AS last_discharge FROM facility_stay GROUP BY agency_id")
def _(t):
    return t.facility_stay.groupBy("agency_id").agg(
        F.min("admit_date").alias("first_admit"), F.max("discharge_date").alias("last_discharge")
    )


@query("integer_mean", """
SELECT agency_id, CAST(trunc(avg(discharge_date - admit_date)) AS INT) AS mean_days FROM facility_stay GROUP BY agency_id""")
def _(t):
    stays = t.facility_stay.withColumn("days", dates.day_diff("admit_date", "discharge_date"))
    return stays.groupBy("agency_id").agg(rel.whole_mean("days").alias("mean_days"))


@query("group_by_expression", "SELECT CAST(year(admit_date) AS INT) AS admit_year, count(admit_date) AS n_stay FROM facility_stay GROUP BY year(admit_date)")
def _(t):
    return t.facility_stay.groupBy(F.year("admit_date").alias("admit_year")).agg(F.count("admit_date").alias("n_stay"))


@query("post_agg_filter", """
SELECT id_mcaid, count(*) AS n_claim FROM claim_header GROUP BY id_mcaid HAVING count(*) >= 2 AND max(first_service_date) - min(first_service_date) >= 1""")
def _(t):
    per_person = t.claim_header.groupBy("id_mcaid").agg(
        F.count(F.lit(1)).alias("n_claim"), F.min("first_service_date").alias("a"), F.max("first_service_date").alias("b")
    )
    return per_person.filter((F.col("n_claim") >= 2) & dates.spans_days("a", "b")).select("id_mcaid", "n_claim")


@query("row_distinct", "SELECT kcid, disposition FROM intake GROUP BY kcid, disposition")
def _(t):
    return t.intake.select("kcid", "disposition").distinct()


@query("fixed_pivot", """
SELECT p1_id, max(CASE WHEN r = 1 THEN kcid END) AS kcid_1, max(CASE WHEN r = 2 THEN kcid END) AS kcid_2, max(CASE WHEN r = 3 THEN kcid END) AS kcid_3
FROM (SELECT p1_id, kcid, row_number() OVER (PARTITION BY p1_id ORDER BY post_stamp, kcid) AS r FROM crosswalk) GROUP BY p1_id""")
def _(t):
    ranked = rel.first_ranks(t.crosswalk, "p1_id", ["post_stamp", "kcid"], 3)
    return rel.pivot_ranks(ranked, "p1_id", "row_num", "kcid", [1, 2, 3], "kcid_")


@query("spread_pivot", """
SELECT report_date, sum(count) FILTER (WHERE met_abbr = 'ITA_INVEST')::BIGINT AS ITA_INVEST,
  sum(count) FILTER (WHERE met_abbr = 'ITA_NEW_DETAINED')::BIGINT AS ITA_NEW_DETAINED FROM metric GROUP BY report_date""")
def _(t):
    return rel.spread(t.metric, ["report_date"], "met_abbr", "count", ["ITA_INVEST", "ITA_NEW_DETAINED"], only_listed=True)


RACES = ["AIAN", "Asian", "BlackAA", "MENA", "NHPI", "Other", "Unknown_Race", "White"]


@query("unpivot", " UNION ALL ".join(f"SELECT kcid, '{r}' AS race, {r} AS cnt FROM demographics" for r in RACES))
def _(t):
    return t.demographics.unpivot(["kcid"], RACES, "race", "cnt")


@query("arg_max_per_group", f"""
SELECT kcid, CASE greatest({", ".join(RACES)}) {" ".join(f"WHEN {r} THEN '{r}'" for r in RACES)} END AS race,
  greatest({", ".join(RACES)}) AS cnt FROM demographics""")
def _(t):
    return rel.arg_max(t.demographics, "kcid", RACES, "race", "cnt")


@query("max_flag_per_claim", """
SELECT d.claim_header_id, max(x.ccw_a_excl) AS exclude1, max(x.ccw_b_excl) AS exclude2 FROM claim_dx d
JOIN dx_lookup x ON d.icdcm_norm = x.dx AND d.icdcm_version = x.dx_ver WHERE x.ccw_a_excl = 1 OR x.ccw_b_excl = 1 GROUP BY 1""")
def _(t):
    return conditions.max_flags(t.claim_dx, t.dx_lookup, {"exclude1": "ccw_a_excl", "exclude2": "ccw_b_excl"})


@query("distinct_count_by_null_flag", """
SELECT CASE WHEN dschrg_date IS NULL THEN 1 ELSE 0 END AS is_missing, count(DISTINCT claim_header_id) AS cnt FROM claim_header GROUP BY 1""")
def _(t):
    return rel.null_profile(t.claim_header, "dschrg_date", "claim_header_id")


# ---- windows ----------------------------------------------------------------------

@query("row_number_by_stamp", """
SELECT p1_id, kcid, row_number() OVER (PARTITION BY p1_id ORDER BY post_stamp, kcid) AS row_num FROM crosswalk""")
def _(t):
    return seq.number_events(t.crosswalk, "p1_id", "post_stamp", "kcid").select(
        "p1_id", "kcid", F.col("position").alias("row_num")
    )


@query("running_count", "SELECT intake_no, kcid, count(intake_no) OVER (PARTITION BY kcid ORDER BY call_stamp) AS cnt FROM intake")
def _(t):
    rows = t.intake.select("intake_no", "kcid", "call_stamp")
    return seq.number_events(rows, "kcid", "call_stamp", "intake_no").select("intake_no", "kcid", F.col("ordinal").alias("cnt"))


@query("previous_value", """
SELECT intake_no, kcid, CASE WHEN ordinal <> 1 THEN prev_stamp END AS prev_call FROM seq_period""")
def _(t):
    return seq.add_gaps(detentions.detention_sequence(detained(t))).select("intake_no", "kcid", "prev_call")


@query("gap_days", """
SELECT intake_no, CAST(CAST(call_stamp AS DATE) - CAST(lag(call_stamp) OVER (PARTITION BY kcid ORDER BY call_stamp, intake_no) AS DATE) AS INT) AS gap_days
FROM intake""")
def _(t):
    numbered = seq.number_events(t.intake.select("intake_no", "kcid", "call_stamp"), "kcid", "call_stamp", "intake_no")
    return numbered.select("intake_no", dates.day_diff("prev_stamp", "call_stamp").alias("gap_days"))


@query("gap_years", """
SELECT intake_no, CAST(CASE WHEN ordinal > 1 THEN year(call_stamp) - year(prev_stamp) END AS INT) AS gap_years FROM seq_period""")
def _(t):
    return seq.add_year_gaps(detentions.detention_sequence(detained(t))).select("intake_no", "gap_years")


@query("next_value", """
SELECT id_mcaid, bh_cond, svc_date, lag(svc_date) OVER (PARTITION BY id_mcaid, bh_cond ORDER BY svc_date DESC) AS next_date FROM ev_all""")
def _(t):
    return conditions.next_dates(conditions.condition_events(t.claim_dx, t.claim_pharm, t.value_set))


@query("overlap_flag", "SELECT id_mcaid, bh_cond, svc_date, cont FROM chain_flags")
def _(t):
    return conditions.overlap_flag(conditions.condition_events(t.claim_dx, t.claim_pharm, t.value_set)).select("id_mcaid", "bh_cond", "svc_date", "cont")


def _flagged_windows(t):
    events = conditions.condition_events(t.claim_dx, t.claim_pharm, t.value_set)
    return conditions.flag_discontinuity(conditions.windows_with_events(events, conditions.Calendar.of(t.windows), nested=True))


DISCONT_SQL = """
SELECT id_mcaid, bh_cond, start_window, end_window, CASE WHEN n > 1 AND date_diff('month', e, start_window) > 1 AND start_window >= e THEN n END AS discont
FROM (SELECT *, row_number() OVER w AS n, lag(end_window) OVER w AS e FROM (SELECT DISTINCT id_mcaid, bh_cond, start_window, end_window FROM matrix)
  WINDOW w AS (PARTITION BY id_mcaid, bh_cond ORDER BY start_window))"""


@query("discontinuity_flag", f"SELECT id_mcaid, bh_cond, start_window, CAST(discont AS INT) AS discont FROM ({DISCONT_SQL})")
def _(t):
    return conditions.open_windows(_flagged_windows(t)).select("id_mcaid", "bh_cond", "start_window", "discont")


@query("running_group_id", f"""
SELECT id_mcaid, bh_cond, start_window, count(discont) OVER (PARTITION BY id_mcaid, bh_cond ORDER BY start_window ROWS UNBOUNDED PRECEDING) AS grp FROM ({DISCONT_SQL})""")
def _(t):
    return conditions.open_windows(conditions.window_groups(_flagged_windows(t))).select("id_mcaid", "bh_cond", "start_window", "grp")


# ---- sorts, limits, set operations ------------------------------------------------

@query("sort_output", "SELECT kcid, start_date, auth_no FROM auth ORDER BY kcid NULLS FIRST, start_date, auth_no")
def _(t):
    return t.auth.select("kcid", "start_date", "auth_no").orderBy("kcid", "start_date", "auth_no")


@query("top_n", "SELECT auth_no, kcid, start_date FROM auth ORDER BY start_date, auth_no LIMIT 1000")
def _(t):
    return rel.top_rows(t.auth.select("auth_no", "kcid", "start_date"), ["start_date", "auth_no"], 1000)


@query("top_n_distinct", "SELECT DISTINCT call_stamp FROM intake ORDER BY call_stamp LIMIT 1000")
def _(t):
    return rel.top_rows(t.intake.select("call_stamp").distinct(), ["call_stamp"], 1000)


@query("union_distinct", "SELECT id_mcaid, first_service_date AS d FROM claim_dx UNION SELECT id_mcaid, rx_fill_date FROM claim_pharm")
def _(t):
    return t.claim_dx.select("id_mcaid", F.col("first_service_date").alias("d")).union(
        t.claim_pharm.select("id_mcaid", "rx_fill_date")
    ).distinct()


@query("union_all_by_name", """
SELECT kcid, program, CAST(NULL AS VARCHAR) AS plan FROM auth UNION ALL SELECT kcid, NULL, plan FROM coverage UNION ALL SELECT kcid, NULL, mco FROM monthly_coverage""")
def _(t):
    return rel.stack_by_name(
        t.auth.select("kcid", "program"), t.coverage.select("plan", "kcid"), t.monthly_coverage.select("kcid", F.col("mco").alias("plan"))
    )


@query("intersect_distinct", """
SELECT DISTINCT d.kcid, d.disposition FROM intake d WHERE EXISTS
  (SELECT 1 FROM intake e WHERE e.kcid IS NOT DISTINCT FROM d.kcid AND e.disposition IS NOT DISTINCT FROM d.disposition AND year(e.call_stamp) >= 1999)
  AND year(d.call_stamp) < 1999""")
def _(t):
    pairs = t.intake.select("kcid", "disposition", F.year("call_stamp").alias("y"))
    return rel.rows_in_both(pairs.filter("y < 1999").drop("y"), pairs.filter("y >= 1999").drop("y"))


@query("except_distinct", """
SELECT DISTINCT d.kcid, d.disposition FROM intake d WHERE NOT EXISTS
  (SELECT 1 FROM intake e WHERE e.kcid IS NOT DISTINCT FROM d.kcid AND e.disposition IS NOT DISTINCT FROM d.disposition AND year(e.call_stamp) >= 1999)
  AND year(d.call_stamp) < 1999""")
def _(t):
    pairs = t.intake.select("kcid", "disposition", F.year("call_stamp").alias("y"))
    return rel.rows_only_in_first(pairs.filter("y < 1999").drop("y"), pairs.filter("y >= 1999").drop("y"))


# ---- scalar functions -------------------------------------------------------------

@query("date_parts", "SELECT stay_no, CAST(date_part('year', admit_date) AS INT) AS y, CAST(date_part('month', admit_date) AS INT) AS m FROM facility_stay")
def _(t):
    return t.facility_stay.select("stay_no", F.year("admit_date").alias("y"), F.month("admit_date").alias("m"))


@query("half_year", """
SELECT stay_no, CASE quarter(discharge_date) WHEN 1 THEN 'Q1-Q2' WHEN 2 THEN 'Q1-Q2' WHEN 3 THEN 'Q3-Q4' WHEN 4 THEN 'Q3-Q4' ELSE 'What' END AS half FROM facility_stay""")
def _(t):
    return t.facility_stay.select("stay_no", dates.half_year("discharge_date").alias("half"))


@query("day_diff", "SELECT stay_no, CAST(discharge_date - admit_date AS INT) AS los FROM facility_stay")
def _(t):
    return t.facility_stay.select("stay_no", dates.day_diff("admit_date", "discharge_date").alias("los"))


@query("minute_diff", "SELECT intake_no, CAST(date_diff('minute', face_ref_stamp, disposition_stamp) AS INT) AS minutes FROM intake")
def _(t):
    return t.intake.select("intake_no", dates.minute_diff("face_ref_stamp", "disposition_stamp").alias("minutes"))


@query("month_diff", "SELECT auth_no, CAST(date_diff('month', start_date, expire_date) AS INT) AS months FROM auth")
def _(t):
    return t.auth.select("auth_no", dates.month_diff("start_date", "expire_date").alias("months"))


@query("add_months", "SELECT stay_no, CAST(admit_date + INTERVAL 2 YEAR AS DATE) AS end_window FROM facility_stay")
def _(t):
    return t.facility_stay.select("stay_no", dates.add_months("admit_date", 24).alias("end_window"))


@query("month_start", "SELECT intake_no, CAST(strftime(call_stamp, '%Y-%m-01') AS DATE) AS call_month FROM intake")
def _(t):
    return t.intake.select("intake_no", dates.month_start("call_stamp").alias("call_month"))


@query("month_end", "SELECT intake_no, CAST(date_trunc('month', call_stamp) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS report_date FROM intake")
def _(t):
    return t.intake.select("intake_no", dates.month_end("call_stamp").alias("report_date"))


@query("month_key_text", "SELECT intake_no, strftime(call_stamp, '%Y-%m') AS call_month FROM intake")
def _(t):
    return t.intake.select("intake_no", dates.month_key_text("call_stamp").alias("call_month"))


@query("month_key_int", "SELECT stay_no, CAST(strftime(admit_date, '%Y%m') AS INT) AS census_month FROM facility_stay")
def _(t):
    return t.facility_stay.select("stay_no", dates.month_key_int("admit_date").alias("census_month"))


@query("same_month_span", "SELECT kcid, plan, start_date, end_date FROM coverage WHERE date_diff('month', start_date, end_date) = 0")
def _(t):
    return t.coverage.filter(dates.same_month("start_date", "end_date")).select("kcid", "plan", "start_date", "end_date")


@query("type_cast", """
SELECT CAST(kcid AS VARCHAR) AS id, CAST(call_stamp AS DATE) AS call_date, CAST(CAST(intake_no % 100000 AS DECIMAL(9,2)) AS DOUBLE) AS amount FROM intake""")
def _(t):
    return t.intake.select(
        F.col("kcid").cast("string").alias("id"), F.col("call_stamp").cast("date").alias("call_date"),
        (F.col("intake_no") % 100000).cast("decimal(9,2)").cast("double").alias("amount"),
    )


AGE_SQL = """
SELECT i.intake_no, CAST(date_part('year', age(CAST(i.call_stamp AS DATE), d.dob)) AS INT) AS age FROM intake i LEFT JOIN demographics d ON i.kcid = d.kcid"""


def _aged(t):
    rows = t.intake.select("intake_no", "kcid", "call_stamp").join(t.demographics.select("kcid", "dob"), "kcid", "left")
    return rows.select("intake_no", dates.age_years("dob", F.col("call_stamp").cast("date")).alias("age"))


@query("age_years", AGE_SQL)
def _(t):
    return _aged(t)


@query("age_group", f"""
SELECT intake_no, CASE WHEN age IS NULL THEN '0.5' WHEN age < 18 THEN '<18' WHEN age < 25 THEN '18-24' WHEN age < 35 THEN '25-34' WHEN age < 45 THEN '35-44'
  WHEN age < 55 THEN '45-54' WHEN age < 65 THEN '55-64' ELSE '65+' END AS age_group FROM ({AGE_SQL})""")
def _(t):
    return _aged(t).select("intake_no", dates.age_group("age").alias("age_group"))


@query("abs_day_span", "SELECT auth_no, abs(expire_date - start_date) >= 1 AS apart FROM auth")
def _(t):
    return t.auth.select("auth_no", dates.spans_days("expire_date", "start_date").alias("apart"))
