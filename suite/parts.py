"""Named steps shared by the check SQL, written apart from the DataFrame operators."""

from suite.registry import part

# Period bounds used throughout, shifted to the dates of the driver tables.
START, END = "1996-01-01", "2000-12-31"
FROM, TO = "1998-01-01", "1999-12-31"
AGENCIES = ["058", "081", "082", "086", "005"]
REVOKED = "2-HIGH"
MH_SETS = "('Mental Health Diagnosis', 'Mental Illness', 'Intentional Self-Harm')"

part("det_codes", "SELECT disposition FROM disposition_ref WHERE detained = 'Y' AND version = '2021'")
part("det_period", f"""
SELECT DISTINCT i.intake_no, i.kcid, i.call_stamp FROM intake i JOIN det_codes USING (disposition)
WHERE i.call_stamp >= DATE '{START}' AND i.call_stamp <= DATE '{END}'""")
part("det_past", f"""
SELECT DISTINCT i.intake_no, i.kcid, i.call_stamp FROM intake i JOIN det_codes USING (disposition)
WHERE i.call_stamp <= DATE '{END}'""")
for name, base in (("seq_period", "det_period"), ("seq_past", "det_past")):
    part(name, f"""
SELECT *, count(intake_no) OVER (PARTITION BY kcid ORDER BY call_stamp) AS ordinal,
  lag(call_stamp) OVER (PARTITION BY kcid ORDER BY call_stamp, intake_no) AS prev_stamp FROM {base}""")
part("gaps_period", """
SELECT intake_no, kcid, call_stamp, ordinal, CASE WHEN ordinal > 1 THEN prev_stamp END AS prev_call,
  CAST(CASE WHEN ordinal > 1 THEN date_diff('day', prev_stamp, call_stamp) END AS INT) AS gap_days FROM seq_period""")
part("classified_intakes", f"""
SELECT i.intake_no, i.kcid, i.call_stamp, CAST(date_trunc('month', i.call_stamp) AS DATE) AS call_month, i.disposition, d.description,
  CASE i.statute_timeline_ind WHEN '6' THEN 'ER' WHEN '12' THEN 'Law Enforcement' ELSE 'N/A' END AS type,
  CASE WHEN year(i.face_ref_stamp) = 1900 THEN NULL WHEN mins < 0 THEN NULL ELSE least(mins, 43200) END AS minutes,
  CASE WHEN d.investigation = 'Y' THEN 1 ELSE 0 END AS investigation, CASE WHEN d.detained = 'Y' THEN 1 ELSE 0 END AS detained,
  CASE WHEN d.detained = 'Y' AND i.disposition <> '{REVOKED}' THEN 1 ELSE 0 END AS new_detained,
  CASE WHEN d.detained = 'Y' AND i.disposition = '{REVOKED}' THEN 1 ELSE 0 END AS revoked_detained,
  CASE WHEN d.voluntary = 'Y' THEN 1 ELSE 0 END AS voluntary, CASE WHEN d.discharge_referral = 'Y' THEN 1 ELSE 0 END AS discharge_referral
FROM (SELECT *, date_diff('minute', face_ref_stamp, disposition_stamp) AS mins FROM intake) i
LEFT JOIN disposition_ref d ON i.disposition = d.disposition
WHERE i.call_stamp IS NOT NULL AND i.disposition IS NOT NULL""")

part("cohort", f"""
SELECT a.auth_no, a.agency_id, a.kcid, c.p1_id, a.status_code, a.status_reason, a.start_date, a.expire_date
FROM auth a JOIN crosswalk c ON a.kcid = c.kcid
WHERE a.program = '58' AND year(a.start_date) >= 1996 AND a.start_date < DATE '2000-07-01' AND a.status_code <> 'CX'
  AND (a.expire_date IS NULL OR date_diff('day', a.start_date, a.expire_date) >= 180)""")
part("inpatient_codes", """
SELECT DISTINCT code FROM hedis_codes WHERE value_set_name = 'Inpatient Stay' AND code_system = 'UBREV' AND version = '2020'""")
part("cohort_claims", """
SELECT DISTINCT l.id_mcaid, l.claim_header_id, h.admsn_date AS admit_date, h.dschrg_date AS discharge_date, h.last_service_date
FROM claim_line l JOIN inpatient_codes k ON l.rev_code = k.code LEFT JOIN claim_header h ON l.claim_header_id = h.claim_header_id
WHERE l.id_mcaid IN (SELECT p1_id FROM cohort)""")
part("stays_ip", f"""
SELECT DISTINCT l.id_mcaid, l.claim_header_id, h.admsn_date AS admit_date
FROM claim_line l JOIN inpatient_codes k ON l.rev_code = k.code LEFT JOIN claim_header h ON l.claim_header_id = h.claim_header_id
  AND (h.admsn_date BETWEEN DATE '{FROM}' AND DATE '{TO}'
    OR (h.admsn_date IS NULL AND h.first_service_date BETWEEN DATE '{FROM}' AND DATE '{TO}'))""")
part("claims_mh", f"""
SELECT DISTINCT h.id_mcaid, h.claim_header_id, h.admsn_date AS admit_date
FROM claim_dx d JOIN hedis_codes k ON d.icdcm_norm = k.code AND k.code_system = 'ICD10CM' AND k.value_set_name IN {MH_SETS}
LEFT JOIN claim_header h ON d.claim_header_id = h.claim_header_id AND h.admsn_date BETWEEN DATE '{FROM}' AND DATE '{TO}'
WHERE d.icdcm_version = 10 AND d.icdcm_number = '01'""")
part("ip_mh", "SELECT * FROM stays_ip INTERSECT SELECT * FROM claims_mh")
part("invol", f"""
SELECT DISTINCT a.auth_no, a.kcid, s.admit_date, 1 AS invol_flag, s.agency_id
FROM auth a JOIN facility_stay s ON a.auth_no = s.auth_no JOIN ip_invol r ON a.auth_no = r.auth_no
WHERE a.status_code IN ('TM', 'AA') AND s.admit_date BETWEEN DATE '{FROM}' AND DATE '{TO}'""")
part("vol", f"""
SELECT DISTINCT a.auth_no, a.kcid, s.admit_date, 0 AS invol_flag, s.agency_id
FROM auth a JOIN facility_stay s ON a.auth_no = s.auth_no JOIN ip_vol r ON a.auth_no = r.auth_no
WHERE a.status_code IN ('TM', 'AA') AND s.admit_date BETWEEN DATE '{FROM}' AND DATE '{TO}'""")
part("cover_months", """
SELECT DISTINCT kcid, CAST(strftime(start_date, '%Y%m') AS INT) AS census_month, 'Medicaid' AS coverage_plan FROM coverage
WHERE plan = 'F19' AND date_trunc('month', start_date) = date_trunc('month', end_date) AND kcid IN (SELECT kcid FROM invol)""")
part("invol_cov", """
SELECT DISTINCT v.auth_no, v.kcid, v.admit_date, v.agency_id, CASE WHEN m.kcid IS NULL THEN 0 ELSE 1 END AS medicaid_flag, v.invol_flag
FROM invol v LEFT JOIN cover_months m ON v.kcid = m.kcid AND CAST(strftime(v.admit_date, '%Y%m') AS INT) = m.census_month""")
part("ids_ranked", """
SELECT p1_id, kcid, row_number() OVER (PARTITION BY p1_id ORDER BY post_stamp, kcid) AS row_num FROM crosswalk
WHERE kcid IN (SELECT kcid FROM invol_cov)""")
part("ids_wide", """
SELECT p1_id, max(kcid) FILTER (WHERE row_num = 1) AS kcid_1, max(kcid) FILTER (WHERE row_num = 2) AS kcid_2,
  max(kcid) FILTER (WHERE row_num = 3) AS kcid_3 FROM ids_ranked WHERE row_num <= 3 GROUP BY p1_id""")
part("invol_p1", "SELECT v.*, w.p1_id FROM invol_cov v LEFT JOIN ids_wide w ON v.kcid = w.kcid_1")
part("vol_mcaid", """
SELECT p1_id, admit_date, 0 AS invol_flag, 1 AS medicaid_flag FROM (
  SELECT id_mcaid AS p1_id, admit_date FROM ip_mh EXCEPT SELECT p1_id, admit_date FROM invol_p1 WHERE medicaid_flag = 1)""")
part("vol_all", """
SELECT DISTINCT p1_id AS id, admit_date, invol_flag, medicaid_flag, 1 AS vol_flag, 'P1' AS id_type FROM vol_mcaid
UNION SELECT DISTINCT CAST(kcid AS VARCHAR), admit_date, invol_flag, 0, 1, 'KC' FROM vol""")
part("invol_ip", f"""
SELECT DISTINCT a.auth_no, a.kcid, s.admit_date, 1 AS invol_flag, s.agency_id
FROM auth a JOIN facility_stay s ON a.auth_no = s.auth_no JOIN ip_invol r ON a.auth_no = r.auth_no
WHERE a.status_code <> 'CX' AND a.program = 'IP' AND s.admit_date BETWEEN DATE '{FROM}' AND DATE '{TO}'""")
part("residential", f"""
SELECT DISTINCT a.auth_no, a.kcid, s.agency_id, s.admit_date, 1 AS flag
FROM auth a JOIN facility_stay s ON a.auth_no = s.auth_no
WHERE a.program = 'SRS' AND a.auth_type = 'IP' AND a.status_code <> 'CX' AND s.admit_date BETWEEN DATE '{FROM}' AND DATE '{TO}'""")

part("recoded", """
SELECT *, CASE WHEN hispanic = 'yes' THEN 1.0::DOUBLE WHEN hispanic IN ('no', 'unknown') THEN 0 ELSE 0.5 END AS hisp,
  CASE WHEN hispanic IS NULL OR Unknown_Race IS NULL THEN 0.5::DOUBLE WHEN Unknown_Race = 1 OR hispanic = 'unknown' THEN 1 ELSE 0 END AS unknown
FROM demographics""")
part("flagged", """
SELECT *, CASE WHEN hisp = 0.5 THEN 0.5::DOUBLE WHEN Multiple_race = 1 OR sum_race > 1 THEN 1 - hisp
  WHEN Multiple_race = 0 AND sum_race IN (0, 1) THEN 0 ELSE 0.5 END AS multiple_NH
FROM (SELECT *, AIAN + Asian + BlackAA + MENA + NHPI + Other + White + unknown AS sum_race FROM recoded)""")
part("race_long", """
SELECT kcid, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS pos, unnest(['AIAN', 'Asian', 'BlackAA', 'MENA', 'NHPI', 'White', 'Other', 'unknown']) AS race,
  unnest([AIAN::DOUBLE, Asian, BlackAA, MENA, NHPI, White, Other, unknown]) AS cnt
FROM flagged WHERE hisp = 0 AND multiple_NH = 0""")
part("race_single", """
SELECT kcid, race FROM race_long WHERE cnt IS NOT NULL QUALIFY row_number() OVER (PARTITION BY kcid ORDER BY cnt DESC, pos) = 1""")
part("race_of", """
SELECT kcid, 'Hispanic' AS race FROM flagged WHERE hisp = 1
UNION ALL SELECT kcid, 'Multi-Race,NH' FROM flagged WHERE hisp = 0 AND multiple_NH = 1
UNION ALL SELECT kcid, race FROM race_single""")
part("investigated", f"""
SELECT DISTINCT kcid, year(call_month) AS year FROM classified_intakes
WHERE call_stamp >= DATE '{FROM}' AND call_stamp <= DATE '{TO}' AND investigation = 1""")

part("ev_dx", """
SELECT DISTINCT d.id_mcaid, d.first_service_date AS svc_date,
  CASE WHEN v.value_set_name = 'SUD-Dx-Value-Set' AND v.sub_group IN ('NA', 'Hallucinogen', 'Inhalant') THEN 'Other Substance' ELSE v.sub_group END AS bh_cond
FROM claim_dx d JOIN value_set v ON d.icdcm_norm = v.code WHERE v.value_set_name IN ('MI-Diagnosis', 'SUD-Dx-Value-Set')""")
part("ev_rx", """
SELECT DISTINCT p.id_mcaid, p.rx_fill_date AS svc_date,
  CASE v.sub_group WHEN 'ADHD Rx' THEN 'ADHD' WHEN 'Antianxiety Rx' THEN 'Anxiety' WHEN 'Antidepressants Rx' THEN 'Depression'
    WHEN 'Antimania Rx' THEN 'Mania/Bipolar' WHEN 'Antipsychotic Rx' THEN 'Psychotic' END AS bh_cond
FROM claim_pharm p JOIN value_set v ON p.ndc = v.code WHERE v.value_set_name = 'Psychotropic-NDC'""")
part("ev_all", "SELECT * FROM ev_dx UNION SELECT * FROM ev_rx")
part("chain_flags", """
SELECT *, CASE WHEN lag(end_window) OVER (PARTITION BY id_mcaid, bh_cond ORDER BY svc_date) BETWEEN svc_date AND end_window THEN 1 ELSE 0 END AS cont
FROM (SELECT id_mcaid, bh_cond, svc_date, CAST(svc_date + INTERVAL 24 MONTH AS DATE) AS end_window FROM ev_all)""")
part("matrix", """
SELECT e.id_mcaid, e.bh_cond, e.svc_date, w.start_window, w.end_window
FROM ev_all e JOIN windows w ON e.svc_date BETWEEN w.start_window AND w.end_window""")

# Condition rules a (type 1) and b (type 2) of the fixtures, each written out.
_RULES = {
    "a": dict(code=1, cond="ccw_a", fields="AND icdcm_number IN ('01', '02')", bar="x.ccw_a_excl = 1", t1="(0, 1, 2)", t2="(3, 4)",
              rule="n1 >= 1"),
    "b": dict(code=2, cond="ccw_b", fields="", bar="(x.ccw_a_excl = 1 AND d.icdcm_number = '01') OR (x.ccw_b_excl = 1 AND d.icdcm_number IN ('01', '02'))",
              t1="(0)", t2="(1, 2, 3, 4, 5, 6, 7)", rule="n1 >= 1 OR (n2 >= 2 AND abs(date_diff('day', d_min, d_max)) >= 1)"),
}
for key, r in _RULES.items():
    part(f"barred_{key}", f"""
SELECT DISTINCT d.claim_header_id FROM claim_dx d JOIN dx_lookup x ON d.icdcm_norm = x.dx AND d.icdcm_version = x.dx_ver WHERE {r['bar']}""")
    part(f"header_{key}", f"""
SELECT h.id_mcaid, h.claim_header_id, h.claim_type_id, h.first_service_date, {r['code']} AS ccw_code,
  CASE WHEN h.claim_type_id IN {r['t1']} THEN 1 ELSE 0 END AS condition1, CASE WHEN h.claim_type_id IN {r['t2']} THEN 1 ELSE 0 END AS condition2,
  CASE WHEN h.claim_type_id IN {r['t1']} THEN h.first_service_date END AS condition_1_from_date,
  CASE WHEN h.claim_type_id IN {r['t2']} THEN h.first_service_date END AS condition_2_from_date
FROM claim_header h RIGHT JOIN (
  SELECT d.claim_header_id FROM (SELECT * FROM claim_dx WHERE true {r['fields']}) d
  JOIN dx_lookup x ON d.icdcm_norm = x.dx AND d.icdcm_version = x.dx_ver AND x.{r['cond']} = 1) q ON h.claim_header_id = q.claim_header_id
WHERE q.claim_header_id NOT IN (SELECT claim_header_id FROM barred_{key})""")
    part(f"counts_{key}", f"""
SELECT * FROM (
  SELECT c.id_mcaid, w.start_window, w.end_window, sum(c.condition1) AS n1, sum(c.condition2) AS n2,
    min(c.condition_2_from_date) AS d_min, max(c.condition_2_from_date) AS d_max
  FROM header_{key} c JOIN windows w ON c.first_service_date BETWEEN w.start_window AND w.end_window
  WHERE c.id_mcaid IS NOT NULL GROUP BY ALL) WHERE {r['rule']}""")
    part(f"periods_{key}", f"""
SELECT id_mcaid, min(start_window) AS from_date, max(end_window) AS to_date, {r['code']} AS ccw_code, '{r['cond']}' AS ccw_desc FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY id_mcaid ORDER BY start_window) AS grp FROM (
    SELECT *, CASE WHEN date_diff('month', lag(end_window) OVER w, start_window) <= 1 OR lag(end_window) OVER w IS NULL THEN 0 ELSE 1 END AS fresh
    FROM counts_{key} WINDOW w AS (PARTITION BY id_mcaid ORDER BY start_window)))
GROUP BY id_mcaid, grp""")
