"""Queries over the rule engine, on profiles that follow from the customer table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as R
from ..plans.profiles import SQL, profiles
from ..sources.rules import banks, default_rules, rules_table
from .registry import query

RULES = default_rules()


def _sql_rules() -> str:
    """The rules as rows; what they say is data, how they are read is the SQL below."""
    text = lambda x: "null" if x is None else "'" + x.replace("'", "''") + "'"
    rows = ",".join(f"('{r.bank}',{r.bank_ord},{r.ord},'{r.id}','{r.field}','{r.operator}',{'null' if r.num_value is None else r.num_value},{text(r.list_value and ','.join(r.list_value))},{text(r.message)},{text(R.expected(r))})" for r in RULES)
    return f"(values {rows}) as t(bank,bank_ord,ord,rule_id,field,operator,num_value,list_value,message,expected)"


_PRIORITY = "case field " + " ".join(f"when '{k}' then {v}" for k, v in R.PRIORITY.items()) + " else 99 end"
_CATEGORY = "case field " + " ".join(f"when '{k}' then '{v}'" for k, v in R.CATEGORY.items()) + " else field end"

_BASE = f"""with p as ({SQL.format(customer="customer")}),
r as (select * from {_sql_rules()}),
v as (select p.*, r.*, case field when 'age' then cast(age as varchar) when 'monthly_income' then cast(monthly_income as varchar) when 'credit_score' then cast(credit_score as varchar)
   when 'employment_type' then coalesce(employment_type,'salaried') when 'work_experience_months' then cast(coalesce(work_experience_months,12) as varchar) else cast(coalesce(dti_ratio,0.35) as varchar) end as actual from p cross join r),
e as (select *, case when actual is null then 'missing'
   when operator='in' then case when list_contains(string_split(list_value,','), actual) then 'pass' else 'fail' end
   when operator='>=' then case when cast(actual as double) >= num_value then 'pass' else 'fail' end
   else case when cast(actual as double) <= num_value then 'pass' else 'fail' end end as status, actual || ' ' || operator || ' ' || expected || ' ✗ — requires ' || expected || ', got ' || actual as why, 'Applicant has ' || actual || ', requirement is ' || operator || ' ' || expected as plain_why, {_PRIORITY} as priority, {_CATEGORY} as category from v),
b as (select profile_id, bank, bank_ord, cast(count(*) filter (status='pass') as int) as n_pass, cast(count(*) filter (status='fail') as int) as n_fail, cast(count(*) filter (status='missing') as int) as n_missing,
   coalesce(bool_or(status='missing' and field in ('age','monthly_income','credit_score')), false) as critical_missing,
   coalesce(string_agg(message, '; ' order by ord) filter (status='pass'),'') as passed, coalesce(string_agg(message, '; ' order by ord) filter (status='fail'),'') as failed, coalesce(string_agg(message, '; ' order by ord) filter (status='missing'),'') as missing,
   coalesce(array_to_string((list(why order by ord) filter (status='fail'))[1:2], '; '),'') as two, coalesce(array_to_string((list(plain_why order by ord) filter (status='fail'))[1:2], '; '),'') as plain_two, list(message order by ord) filter (status='fail') as fails, list(message order by ord) filter (status='missing') as lacks, (list(message order by ord) filter (status='pass'))[1:3] as passes, coalesce(string_agg(field, ', ' order by ord) filter (status='missing' and field in ('age','monthly_income','credit_score')),'') as needs, count(*) as n_rules
   from e group by all),
s as (select *, n_fail = 0 and not critical_missing as eligible, round_even(n_pass / greatest(n_pass + n_fail, 1), 3) as rule_score from b),
f as (select *, round_even(greatest(case when eligible then rule_score - n_fail*0.15e0 - n_missing*0.05e0 else least(rule_score - n_fail*0.15e0 - n_missing*0.05e0, 0.60e0) end, 0.05e0), 2) as final_score from s),
c as (select profile_id, ((case when age is not null then 1 else 0 end)+(case when monthly_income is not null then 1 else 0 end)+(case when credit_score is not null then 1 else 0 end)+(case when employment_type is not null then 1 else 0 end)+(case when work_experience_months is not null then 1 else 0 end)+(case when dti_ratio is not null then 1 else 0 end))/6e0 as completeness,
   (case when age is not null then 1 else 0 end)+(case when monthly_income is not null then 1 else 0 end)+(case when credit_score is not null then 1 else 0 end) as core from p),
d as (select f.profile_id, any_value(completeness) as completeness, any_value(core) as core, cast(count(*) as int) as n_total, cast(count(*) filter (eligible) as int) as n_eligible, cast(count(*) filter (critical_missing) as int) as n_critical, cast(count(*) filter (not eligible and n_fail > 0) as int) as n_hard, cast(count(*) filter (not eligible and not critical_missing) as int) as n_rejected, cast(count(*) filter (not eligible and n_missing > 0) as int) as n_partial,
   coalesce(string_agg(bank, ',' order by bank_ord) filter (eligible),'') as eligible_banks, coalesce(string_agg(bank, ',' order by bank_ord) filter (not eligible and critical_missing),'') as missing_banks, coalesce(string_agg(bank, ',' order by bank_ord) filter (not eligible and not critical_missing),'') as rejected_banks,
   first(bank order by rule_score desc, bank_ord) filter (eligible) as best_bank, first(bank order by rule_score desc, bank_ord) filter (not eligible and rule_score > 0) as closest_bank, first(bank order by rule_score desc, bank_ord) filter (not eligible) as nearest_bank,
   sum(rule_score order by bank_ord)/count(*) as avg_rule_score from f join c using (profile_id) group by f.profile_id),
k as (select profile_id, coalesce(bool_or(status='fail' and field in ('age','monthly_income','credit_score')), false) as critical_fail from e group by 1),
g as (select *, case when completeness = 0 then 'Insufficient Data' when n_eligible = n_total then 'Eligible' when n_eligible > 0 then 'Partially Eligible' when n_critical > 0 and n_hard = 0 then 'Partial Profile' else 'Not Eligible' end as decision from d join k using (profile_id)),
h as (select *, round_even(greatest(0.05e0, least(case when critical_fail then least(least(0.85e0 + avg_rule_score*0.14e0, 0.99e0), 0.60e0) else least(0.85e0 + avg_rule_score*0.14e0, 0.99e0) end - greatest(n_rejected - 1, 0)*0.04e0, 0.99e0)), 2) as confidence from g)
"""


def _evaluated(spark, sf_dir):
    return R.evaluate(profiles(spark, sf_dir), RULES)


def _reasoned(spark, sf_dir):
    return R.reason(_evaluated(spark, sf_dir))


@query(_BASE + "select profile_id, completeness, n_total, n_eligible, n_critical, n_hard, n_rejected, decision from h")
def q01_rule_decisions(spark, sf_dir):
    return _reasoned(spark, sf_dir).select("profile_id", "completeness", "n_total", "n_eligible", "n_critical", "n_hard", "n_rejected", "decision")


@query(_BASE + "select profile_id, bank, rule_id, field, operator, expected, status, message, case status when 'missing' then 'Field ' || chr(39) || field || chr(39) || ' not provided.' when 'pass' then actual || ' ' || operator || ' ' || expected || ' ✓' else why end as reason, category, priority from e")
def q02_rule_evaluations(spark, sf_dir):
    return R.long(_evaluated(spark, sf_dir)).select("profile_id", "bank", "rule_id", "field", "operator", "expected", "status", "message", "reason", "category", "priority")


@query(_BASE + "select profile_id, bank, n_pass, n_fail, n_missing, critical_missing, eligible, rule_score, final_score, passed, failed, missing, case when eligible then '✅ Eligible — all ' || n_pass || ' rules passed.' when critical_missing then '⚠️ Need more info — please provide: ' || needs else '❌ Not eligible — ' || n_fail || ' rule(s) failed: ' || two end as summary, case when eligible then '✅ Eligible — all ' || n_pass || ' rules passed.' when critical_missing then '⚠️ Cannot evaluate — missing: ' || needs else '❌ Not eligible — ' || n_fail || ' rule(s) failed: ' || plain_two end as plain_summary from f")
def q03_rule_bank_results(spark, sf_dir):
    return R.by_bank(_evaluated(spark, sf_dir)).drop("bank_ord")


@query(_BASE + """, n as (select profile_id, concat_ws(',', case when age is not null then 'age' end, case when monthly_income is not null then 'monthly_income' end, case when credit_score is not null then 'credit_score' end, case when employment_type is not null then 'employment_type' end, case when work_experience_months is not null then 'work_experience_months' end, case when dti_ratio is not null then 'dti_ratio' end) as provided from p),
 x as (select profile_id, string_agg(bank || ':' || rule_id, ',' order by priority, bank_ord, ord) as critical_failures from e where status = 'fail' and field in ('age', 'monthly_income', 'credit_score') group by 1)
select profile_id, eligible_banks, missing_banks, rejected_banks, best_bank, closest_bank, provided, coalesce(critical_failures, '') as critical_failures from h join n using (profile_id) left join x using (profile_id)""")
def q04_rule_best_closest(spark, sf_dir):
    return _reasoned(spark, sf_dir).select("profile_id", "eligible_banks", "missing_banks", "rejected_banks", "best_bank", "closest_bank", "provided", F.array_join(F.transform("critical_failures", lambda e: F.concat(e["bank"], F.lit(":"), e["rule_id"])), ",").alias("critical_failures"))


@query(_BASE + "select profile_id, category, count(*) as n from e where status='fail' group by 1, 2")
def q05_rule_failure_summary(spark, sf_dir):
    return R.failure_summary(_reasoned(spark, sf_dir))


@query(_BASE + ", o as (select *, row_number() over (partition by profile_id, field order by priority, bank_ord, ord) as k from e where status='fail'), t as (select *, cast(row_number() over (partition by profile_id order by priority, bank_ord, ord) as int) as rank from o where k=1) select profile_id, rank, field, bank, message from t where rank <= 5")
def q06_rule_top_failures(spark, sf_dir):
    return R.top_failures(_reasoned(spark, sf_dir))


@query(_BASE + "select profile_id, round(avg_rule_score, 6) as avg_rule_score, critical_fail, confidence, greatest(confidence, case when core=3 then 0.80e0 when core=2 then 0.65e0 else 0e0 end) as floored_confidence from h")
def q07_rule_confidence(spark, sf_dir):
    return _reasoned(spark, sf_dir).select("profile_id", F.round("avg_rule_score", 6).alias("avg_rule_score"), "critical_fail", "confidence", "floored_confidence")


@query(_BASE + """, x as (
 select profile_id, 'error' as severity, 'eligible with failed rules' as issue, bank from f where eligible and n_fail > 0
 union all select profile_id, 'warning', 'not eligible without cause', bank from f where not eligible and n_fail = 0 and not critical_missing
 union all select distinct profile_id, 'warning', 'dti looks like a percentage', bank from e where field='dti_ratio' and cast(actual as double) > 1.5
 union all select profile_id, 'error', 'decision eligible, lenders differ', '' from h where decision='Eligible' and n_eligible < n_total
 union all select profile_id, 'error', 'decision not eligible, lenders differ', '' from h where decision='Not Eligible' and n_eligible > 0
 union all select profile_id, 'warning', 'low confidence', '' from h where confidence < 0.5
 union all select profile_id, 'warning', 'critical failures, all eligible', '' from h where critical_fail and decision='Eligible')
select * from x""")
def q08_rule_validation(spark, sf_dir):
    return R.validate(_reasoned(spark, sf_dir))


@query(_BASE + "select profile_id, cast(row_number() over (partition by profile_id order by floor(final_score*100 + 1e-9) desc, bank_ord) as int) as rank, bank, cast(floor(final_score*100 + 1e-9) as int) as score, eligible, case bank when 'axis' then '9.98% – 22%' when 'hdfc' then '9.98% – 24%' when 'icici' then '9.99% – 16.5%' when 'sbi' then '10.00% – 15.1%' else 'N/A' end as rate from f")
def q09_rule_ranked(spark, sf_dir):
    return R.ranked(_evaluated(spark, sf_dir))


@query(_BASE + "select profile_id, n_eligible, n_partial, n_total - n_eligible - n_partial as n_rejected, nearest_bank as closest_bank, case when completeness = 0 or (n_partial > 0 and n_eligible = 0) then 'Insufficient Data' when n_eligible = n_total then 'Eligible' when n_eligible > 0 then 'Partially Eligible' else 'Not Eligible' end as decision, round_even(least(0.5e0*avg_rule_score + 0.3e0*completeness + 0.2e0, 0.99e0), 2) as report_confidence from h")
def q10_rule_partial_report(spark, sf_dir):
    return R.partial_report(_reasoned(spark, sf_dir))


_CLEAN = f"""with p as ({SQL.format(customer="customer")}), q as (select *, case when dti_ratio > 1.5 then dti_ratio/100 else dti_ratio end as d from p)
select profile_id, case when age between 18 and 80 then age end as age, case when monthly_income between 3e3 and 1e7 then round(monthly_income,2) end as monthly_income, case when credit_score between 300 and 900 then credit_score end as credit_score, lower(employment_type) as employment_type, case when work_experience_months > 0 and work_experience_months < 600 then work_experience_months end as work_experience_months, case when d > 0 and d < 1 then round_even(d,4) end as dti_ratio from q"""


@query(_CLEAN)
def q11_profile_clean(spark, sf_dir):
    return R.clean_profile(profiles(spark, sf_dir))


@query(f"""with p as ({SQL.format(customer="customer")}), o as (select o_custkey as profile_id, max(o_totalprice) as monthly_income, cast(null as double) as age, cast(650 as double) as credit_score, 'salaried' as employment_type, cast(null as double) as work_experience_months, cast(0.5 as double) as dti_ratio from orders group by 1)
select p.profile_id, p.age, coalesce(p.monthly_income, o.monthly_income) as monthly_income, coalesce(p.credit_score, o.credit_score) as credit_score, coalesce(p.employment_type, o.employment_type) as employment_type, coalesce(p.work_experience_months, o.work_experience_months) as work_experience_months, coalesce(p.dti_ratio, o.dti_ratio) as dti_ratio from p left join o using (profile_id)""")
def q12_profile_merge(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("profile_id")).agg(F.max("o_totalprice").alias("monthly_income"))
    second = orders.select("profile_id", F.lit(None).cast("double").alias("age"), "monthly_income", F.lit(650.0).alias("credit_score"), F.lit("salaried").alias("employment_type"), F.lit(None).cast("double").alias("work_experience_months"), F.lit(0.5).alias("dti_ratio"))
    return R.merge_profiles(profiles(spark, sf_dir), second)


@query(f"select bank, count(*) as n_rules, count(num_value) as n_numeric from {_sql_rules()} group by bank")
def q13_rule_catalogue(spark, sf_dir):
    assert banks(RULES)
    return rules_table(spark, RULES).groupBy("bank").agg(F.count("*").alias("n_rules"), F.count("num_value").alias("n_numeric"))


@query(_BASE + """select h.profile_id, case when n_fail = 0 then best_bank || ' is the recommended bank — it passed all ' || n_pass || ' eligibility rules with a score of ' || cast(round_even(final_score * 100, 0) as int) || '% and has the lowest entry requirements among eligible options.' when n_fail > 0 then best_bank || ' has the highest eligibility score (' || cast(round_even(final_score * 100, 0) as int) || '%) among evaluated banks, passing ' || n_pass || ' rules with ' || n_fail || ' condition(s) to address.' end as sentence,
 case when n_fail = 0 then best_bank || ' is recommended — passed all ' || n_pass || ' eligibility rules (' || cast(round_even(rule_score * 100, 0) as int) || '% score) and has the most favourable terms.' when n_fail > 0 then best_bank || ' has the highest eligibility score (' || cast(round_even(rule_score * 100, 0) as int) || '%) among evaluated banks, with ' || n_pass || ' rules passed and ' || n_fail || ' to address.' end as plain_sentence
from h left join f on f.profile_id = h.profile_id and f.bank = best_bank""")
def q14_best_sentence(spark, sf_dir):
    return R.best_sentence(_evaluated(spark, sf_dir))


@query(_BASE + """, l as (select profile_id, bank_ord, '  ' || bank || ': ' || case when len(lacks) > 0 and coalesce(len(fails), 0) = 0 then 'PARTIAL PROFILE (missing fields — cannot fully evaluate)' when eligible then 'ELIGIBLE' else 'NOT ELIGIBLE' end || ' (score=' || cast(round_even(rule_score * 100, 0) as int) || '%)'
 || coalesce(chr(10) || array_to_string(list_transform(fails, lambda m: '    ✗ FAILED: ' || m), chr(10)), '') || coalesce(chr(10) || array_to_string(list_transform(lacks, lambda m: '    ? MISSING (NOT a failure — just not provided): ' || m), chr(10)), '') || coalesce(chr(10) || array_to_string(list_transform(passes, lambda m: '    ✓ PASSED: ' || m), chr(10)), '') as line from f)
select h.profile_id, 'FINAL DECISION (must appear verbatim in summary): ' || decision || chr(10) || chr(10) || 'PER-BANK RULE RESULTS:' || chr(10) || string_agg(line, chr(10) order by bank_ord) as prompt from h join l using (profile_id) group by h.profile_id, decision""")
def q15_prompt(spark, sf_dir):
    return R.prompt(_evaluated(spark, sf_dir))


@query(_BASE + "select profile_id, cast(row_number() over (partition by profile_id order by rule_score desc, bank_ord) as int) as position, bank, rule_score from f")
def q16_rule_standing(spark, sf_dir):
    return R.standing(_evaluated(spark, sf_dir))
