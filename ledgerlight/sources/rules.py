"""Lender rules: a small declarative table, from our own list or from YAML files, one file a lender."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Rule:
    bank: str
    bank_ord: int
    loan_type: str
    logic: str
    ord: int
    id: str
    field: str
    operator: str
    num_value: float | None
    list_value: tuple[str, ...] | None
    message: str


# The rules of each lender, in order (id, field, operator, value, message).
RULES = {
    "axis": (
        ("age_min", "age", ">=", 21, "Minimum age is 21 years"),
        ("age_max", "age", "<=", 60, "Maximum age is 60 years at time of loan maturity"),
        ("monthly_income", "monthly_income", ">=", 15000, "Minimum monthly income is ₹15,000 (existing Axis Bank customers) or ₹25,000 (new customers)"),
        ("credit_score", "credit_score", ">=", 750, "Minimum CIBIL score is 750 for standard approval; scores 700–749 may be considered at higher rates"),
        ("employment_type", "employment_type", "in", ("salaried", "self_employed", "professional", "government"), "Employment must be salaried (public/private/govt), self-employed, or professional (doctors, CAs, etc.)"),
        ("work_experience", "work_experience_months", ">=", 12, "Minimum 12 months employment history for salaried; 36 months business continuity for self-employed"),
        ("dti_ratio", "dti_ratio", "<=", 0.50, "Total EMI obligations (including proposed loan) must not exceed 50% of net monthly income"),
    ),
    "hdfc": (
        ("age_min", "age", ">=", 21, "Minimum age is 21 years"),
        ("age_max", "age", "<=", 60, "Maximum age is 60 years at loan maturity"),
        ("monthly_income", "monthly_income", ">=", 25000, "Minimum monthly income is ₹25,000 (₹75,000+ qualifies for Golden Edge premium rates)"),
        ("credit_score", "credit_score", ">=", 700, "Minimum CIBIL score is 700; scores below 750 attract higher interest rates; 750+ for prime pricing"),
        ("employment_type", "employment_type", "in", ("salaried", "self_employed", "professional", "government"), "Employment must be salaried, self-employed, professional, or government sector"),
        ("work_experience", "work_experience_months", ">=", 12, "Minimum 12 months employment; 24 months preferred for best rates"),
        ("dti_ratio", "dti_ratio", "<=", 0.50, "Debt-to-income ratio must not exceed 50%; HDFC strictly evaluates all existing EMI obligations"),
    ),
    "icici": (
        ("age_min", "age", ">=", 23, "Minimum age is 23 years (25 years for self-employed doctors)"),
        ("age_max", "age", "<=", 65, "Maximum age is 65 years at loan maturity (updated from 58 per 2026 policy)"),
        ("monthly_income", "monthly_income", ">=", 30000, "Minimum monthly income is ₹30,000; higher income qualifies for preferential rates"),
        ("credit_score", "credit_score", ">=", 700, "Minimum CIBIL score is 700; 750+ for best rates and instant pre-approval"),
        ("employment_type", "employment_type", "in", ("salaried", "self_employed", "professional"), "Employment must be salaried (MNCs, PSUs, government) or self-employed/professional"),
        ("work_experience", "work_experience_months", ">=", 24, "Minimum 24 months total work experience; minimum 1 year with current employer; 36 months for self-employed non-professionals"),
        ("dti_ratio", "dti_ratio", "<=", 0.55, "Total EMI-to-net-monthly-income ratio should not exceed 55%; applications favorable at 50–65% per ICICI underwriting"),
    ),
    "sbi": (
        ("age_min", "age", ">=", 21, "Minimum age is 21 years"),
        ("age_max", "age", "<=", 76, "Maximum age is 76 years at loan maturity (loan must be repaid within service/pension period)"),
        ("monthly_income", "monthly_income", ">=", 15000, "Minimum monthly income is ₹15,000 for standard applicants; ₹5,000 for government/defence/pensioners under Xpress Credit"),
        ("credit_score", "credit_score", ">=", 750, "Minimum CIBIL score is 750 (strict cutoff per 2026 SBI policy); scores 700–749 may qualify with enhanced documentation"),
        ("employment_type", "employment_type", "in", ("salaried", "government", "self_employed", "defence", "pensioner"), "SBI primarily serves government/PSU employees, defence, para-military, coast guards; also covers corporate salaried and pensioners"),
        ("work_experience", "work_experience_months", ">=", 12, "Minimum 12 months employment; pensioners may apply with pension documentation as alternative"),
        ("requires_salary_account", "employment_type", "in", ("government", "salaried", "defence", "pensioner", "self_employed"), "SBI Xpress Credit requires salary/pension account with SBI (mandatory for standard processing)"),
    ),
}
#: Advertised rates by lender.
RATES = {"axis": "9.98% – 22%", "hdfc": "9.98% – 24%", "icici": "9.99% – 16.5%", "sbi": "10.00% – 15.1%"}


def default_rules() -> list[Rule]:
    number = lambda v: None if isinstance(v, tuple) else float(v)
    listed = lambda v: v if isinstance(v, tuple) else None
    return [Rule(bank, k, "personal", "all", i, r, field, op, number(v), listed(v), message) for k, (bank, rules) in enumerate(RULES.items()) for i, (r, field, op, v, message) in enumerate(rules)]


def read_rules(folder: str) -> list[Rule]:
    """Rules from <folder>/<bank>.yaml files with bank, loan_type, logic and a list of rules. The rule set is
    configuration: a few rows for each lender, read once on the driver."""
    import yaml

    out = []
    for k, path in enumerate(sorted(Path(folder).glob("*.yaml"))):
        spec = yaml.safe_load(path.read_text())
        for i, r in enumerate(spec["rules"]):
            many = isinstance(r["value"], list)
            number = float(r["value"]) if isinstance(r["value"], (int, float)) and not isinstance(r["value"], bool) else None
            values = tuple(map(str, r["value"])) if many else None if number is not None else (str(r["value"]),)
            out.append(Rule(path.stem.lower(), k, spec.get("loan_type", "personal"), spec.get("logic", "all"), i, r["id"], r["field"], r["operator"], number, values, r.get("message", r["id"])))
    return out


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    schema = "bank string, bank_ord int, loan_type string, logic string, ord int, id string, field string, operator string, num_value double, list_value array<string>, message string"
    return spark.createDataFrame([(r.bank, r.bank_ord, r.loan_type, r.logic, r.ord, r.id, r.field, r.operator, r.num_value, None if r.list_value is None else list(r.list_value), r.message) for r in rules], schema)


def banks(rules: list[Rule]) -> list[str]:
    return sorted({r.bank for r in rules})
