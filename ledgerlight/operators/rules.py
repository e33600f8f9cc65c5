"""The rule engine as columns.

Rules are configuration, so they are compiled into columns: a state for each rule, then plain sums of states for each
lender, which Spark compiles to code. What follows (scores, decisions, confidence, checks) is computed inside the row
from a few numbers by lender; evaluations and messages stand in columns of their own, which plans drop where nothing
asks for them. No step of the engine shuffles; explode() gives the long forms.

Missing, failed and erroneous are three things: a missing critical field blocks, a failed rule rejects, an error
neither counts nor blocks.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.rules import RATES, Rule

FIELDS = ("age", "monthly_income", "credit_score", "employment_type", "work_experience_months", "dti_ratio")
CRITICAL = ("age", "monthly_income", "credit_score")
#: Stand in for optional fields only.
DEFAULTS = {"work_experience_months": 12, "dti_ratio": 0.35, "employment_type": "salaried"}
# Order in which failures are reported, and what they are called.
PRIORITY = {"credit_score": 1, "monthly_income": 2, "dti_ratio": 3, "work_experience_months": 4, "employment_type": 5, "age": 6}
CATEGORY = {"monthly_income": "low_income", "credit_score": "low_cibil", "age": "age_out_of_range", "dti_ratio": "high_dti", "work_experience_months": "insufficient_experience", "employment_type": "ineligible_employment_type"}

_COMPARE = {">=": ">=", "<=": "<=", ">": ">", "<": "<", "==": "=", "!=": "<>"}


def _rounded(x: Column, digits: int) -> Column:
    """Half to even on the binary value, as scripts round; bround() would round the shortest decimal form."""
    return F.rint(x * 10**digits) / 10**digits


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _actual(field: str, kind: str) -> str:
    """The field, or what stands in for an optional one. Rules are compiled to SQL text, which builds much faster than
    columns do."""
    default = DEFAULTS.get(field)
    if default is None:
        return f"`{field}`"
    return f"coalesce(`{field}`, {_quoted(str(default)) if kind == 'string' or isinstance(default, str) else f'{float(default)}D'})"


def _status(rule: Rule, kind: str) -> str:
    """pass, fail, missing or error; kind is the type of the rule's column."""
    value = _actual(rule.field, kind)
    text = f"cast({value} as string)"
    if rule.operator in ("in", "not_in") and rule.list_value is not None:
        ok = f"{text} {'not ' * (rule.operator == 'not_in')}in ({', '.join(map(_quoted, rule.list_value))})"
    elif rule.operator in _COMPARE and rule.num_value is not None:
        number = f"try_cast({text} as double)" if kind == "string" else f"cast({value} as double)"
        ok = f"{number} {_COMPARE[rule.operator]} {rule.num_value}D"
    elif rule.operator in ("==", "!=") and rule.list_value is not None:
        ok = f"{text} {_COMPARE[rule.operator]} {_quoted(rule.list_value[0])}"
    else:
        ok = "cast(null as boolean)"
    return f"case when {value} is null then 'missing' when ({ok}) is null then 'error' when {ok} then 'pass' else 'fail' end"


def expected(rule: Rule) -> str:
    return "[" + ", ".join(f"'{x}'" for x in rule.list_value) + "]" if rule.list_value is not None else f"{rule.num_value:g}"


def _failed(rule: Rule, kind: str, plain: bool) -> str:
    """Why a rule failed; plain is the wording of the alternative report."""
    value, want = f"cast({_actual(rule.field, kind)} as string)", expected(rule)
    if plain:
        return f"concat('Applicant has ', {value}, {_quoted(f', requirement is {rule.operator} {want}')})"
    return f"concat({value}, {_quoted(f' {rule.operator} {want} ✗ — requires {want}, got ')}, {value})"


def _reason(rule: Rule, kind: str, state: str) -> str:
    value, want = f"cast({_actual(rule.field, kind)} as string)", expected(rule)
    known = rule.operator in (*_COMPARE, "in", "not_in")
    error = f"concat('Cannot compare \\'', {value}, {_quoted(f"' with threshold '{want}'.")})" if known else _quoted(f"Unknown operator '{rule.operator}'.")
    return f"case {state} when 'missing' then {_quoted(f"Field '{rule.field}' not provided.")} when 'pass' then concat({value}, {_quoted(f' {rule.operator} {want} ✓')}) when 'fail' then {_failed(rule, kind, False)} else {error} end"


def _evaluation(rule: Rule, kind: str, state: str) -> str:
    fixed = {"bank": _quoted(rule.bank), "bank_ord": rule.bank_ord, "ord": rule.ord, "rule_id": _quoted(rule.id), "field": _quoted(rule.field), "operator": _quoted(rule.operator), "expected": _quoted(expected(rule))}
    found = {"actual": f"cast({_actual(rule.field, kind)} as string)", "message": _quoted(rule.message), "status": state, "reason": _reason(rule, kind, state), "priority": PRIORITY.get(rule.field, 99), "category": _quoted(CATEGORY.get(rule.field, rule.field))}
    return _struct(fixed | found)


def _struct(values: dict) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + ")"


# What is said of a lender, by the engine and by the alternative report.
ELIGIBLE, NEEDS, REJECTED = "✅ Eligible — all %d rules passed.", ("⚠️ Need more info — please provide: ", "⚠️ Cannot evaluate — missing: "), "❌ Not eligible — %d rule(s) failed: "


def evaluate(profiles: DataFrame, rules: list[Rule]) -> DataFrame:
    """profiles with banks (for each lender its counts, rule_score, eligible, final_score), evals (all evaluations) and
    texts (for each lender its messages and summaries), arrays in the order of lenders."""
    types = dict(profiles.dtypes)
    ordered = sorted(rules, key=lambda r: (r.bank_ord, r.ord))
    by_bank = [list(own) for _, own in groupby(ordered, key=lambda r: r.bank)]
    state = {id(r): f"_state{k}" for k, r in enumerate(ordered)}
    kind = lambda r: types.get(r.field, "string")

    def total(own: list[Rule], want: str, critical: bool = False) -> str:
        return " + ".join(["0", *(f"int({state[id(r)]} = '{want}')" for r in own if not critical or r.field in CRITICAL)])

    def bank(own: list[Rule], k: int) -> str:
        eligible = f"(_fail{k} = 0 and _without{k} = 0)" if own[0].logic == "all" else f"(_pass{k} > 0)"
        score = f"rint(_pass{k} / greatest(_pass{k} + _fail{k}, 1) * 1000) / 1000"
        raw = f"({score} - _fail{k} * 0.15D - _missing{k} * 0.05D)"
        final = f"rint(greatest(if({eligible}, {raw}, least({raw}, 0.60D)), 0.05D) * 100) / 100"
        dti = f"coalesce(try_cast({_actual('dti_ratio', types.get('dti_ratio', 'string'))} as double) > 1.5D, false)" if any(r.field == "dti_ratio" for r in own) else "false"
        return _struct({
            "bank": _quoted(own[0].bank), "bank_ord": own[0].bank_ord, "loan_type": _quoted(own[0].loan_type), "n_rules": len(own), "n_pass": f"_pass{k}", "n_fail": f"_fail{k}", "n_missing": f"_missing{k}",
            "critical_missing": f"_without{k} > 0", "critical_fail": f"_barred{k} > 0", "eligible": eligible, "rule_score": score, "final_score": final, "dti_high": dti,
        })

    def said(own: list[Rule], k: int) -> str:
        each = lambda want, text: "array_compact(array(" + ", ".join(f"if({state[id(r)]} = '{want}', {text(r)}, null)" for r in own) + "))"
        message = lambda r: _quoted(r.message)
        needs = "concat_ws(', ', " + ", ".join([f"if({state[id(r)]} = 'missing', {_quoted(r.field)}, null)" for r in own if r.field in CRITICAL] or ["null"]) + ")"
        eligible = f"_fail{k} = 0 and _without{k} = 0" if own[0].logic == "all" else f"_pass{k} > 0"

        def summary(plain: bool) -> str:
            fails = f"array_join(slice({each('fail', lambda r: _failed(r, kind(r), plain))}, 1, 2), '; ')"
            return f"case when {eligible} then format_string({_quoted(ELIGIBLE)}, _pass{k}) when _without{k} > 0 then concat({_quoted(NEEDS[plain])}, {needs}) else concat(format_string({_quoted(REJECTED)}, _fail{k}), {fails}) end"

        return _struct({"passed": each("pass", message), "failed": each("fail", message), "missing": each("missing", message), "summary": summary(False), "plain_summary": summary(True)})

    counts = {"pass": ("pass", False), "fail": ("fail", False), "missing": ("missing", False), "without": ("missing", True), "barred": ("fail", True)}
    array = lambda of, empty: f"array({', '.join(of)})" if of else f"cast(array() as {empty})"
    banks, texts = ([f(own, k) for k, own in enumerate(by_bank)] for f in (bank, said))
    columns = [f"`{c}`" for c in profiles.columns]
    states = profiles.selectExpr(*columns, *[f"{_status(r, kind(r))} as {state[id(r)]}" for r in ordered])
    summed = states.selectExpr(*states.columns, *[f"{total(own, *how)} as _{c}{k}" for k, own in enumerate(by_bank) for c, how in counts.items()])
    return summed.selectExpr(*columns, f"{array(banks, _BANKS)} as banks", f"{array([_evaluation(r, kind(r), state[id(r)]) for r in ordered], _EVALS)} as evals", f"{array(texts, _TEXTS)} as texts")


_BANKS = "array<struct<bank:string,bank_ord:int,loan_type:string,n_rules:int,n_pass:int,n_fail:int,n_missing:int,critical_missing:boolean,critical_fail:boolean,eligible:boolean,rule_score:double,final_score:double,dti_high:boolean>>"
_EVALS = "array<struct<bank:string,bank_ord:int,ord:int,rule_id:string,field:string,operator:string,expected:string,actual:string,message:string,status:string,reason:string,priority:int,category:string>>"
_TEXTS = "array<struct<passed:array<string>,failed:array<string>,missing:array<string>,summary:string,plain_summary:string>>"


def _each(rows: DataFrame, values: Column | str, place: bool = False) -> DataFrame:
    """profile_id and e, a row for each value, with its place i. Outer explodes: for a plain one Spark would first test
    where rows are read whether there is a value, for which it would compute all of them there, twice in all."""
    if place:
        return rows.select("profile_id", F.posexplode_outer(values).alias("i", "e")).filter("i is not null")
    return rows.select("profile_id", F.explode_outer(values).alias("e")).filter("e is not null")


def long(evaluated: DataFrame) -> DataFrame:
    """A row for each profile, lender and rule."""
    return _each(evaluated, "evals").select("profile_id", "e.*")


def by_bank(evaluated: DataFrame) -> DataFrame:
    """A row for each profile and lender: counts, scores, eligibility, messages and a summary sentence."""
    b = _each(evaluated, F.arrays_zip("banks", "texts")).select("profile_id", "e.banks.*", "e.texts.*")
    joined = {c: F.array_join(c, "; ") for c in ("passed", "failed", "missing")}
    return b.withColumns(joined).select("profile_id", "bank", "bank_ord", "n_pass", "n_fail", "n_missing", "critical_missing", "eligible", "rule_score", "final_score", "passed", "failed", "missing", "summary", "plain_summary")


def _count(keep) -> Column:
    return F.size(F.filter("banks", keep))


def _first_best(keep) -> Column:
    """The lender of the highest rule_score among those kept; the first on a tie."""
    ranked = F.array_sort(F.transform(F.filter("banks", keep), lambda b: F.struct((-b["rule_score"]).alias("s"), b["bank_ord"].alias("o"), b["bank"].alias("bank"))))
    return F.get(ranked, 0)["bank"]


def completeness() -> Column:
    return sum((F.col(f).isNotNull().cast("int") for f in FIELDS), F.lit(0)) / len(FIELDS)


def _names(fields: tuple[str, ...], known: bool) -> Column:
    return F.concat_ws(",", *[F.when(F.col(f).isNotNull() if known else F.col(f).isNull(), F.lit(f)) for f in fields])


def reason(evaluated: DataFrame) -> DataFrame:
    """A row for each profile: lenders by state, best and closest lender, failures (all, and of critical fields, by
    priority), which fields are known, decision, confidence."""
    fails = F.filter("evals", lambda e: e["status"] == "fail")
    d = evaluated.withColumn("fails", fails).withColumn("completeness", completeness())
    order = lambda e: F.struct(e["priority"].alias("p"), e["bank_ord"].alias("b"), e["ord"].alias("o"), e.alias("e"))
    critical = F.array_sort(F.transform(F.filter("fails", lambda e: e["field"].isin(*CRITICAL)), order))
    d = d.withColumns({"critical_failures": F.transform(critical, lambda x: x["e"]), "provided": _names(FIELDS, True), "not_provided": _names(FIELDS, False)})
    d = d.withColumn("n_total", F.size("banks")).withColumn("n_eligible", _count(lambda b: b["eligible"])).withColumn("n_critical", _count(lambda b: b["critical_missing"]))
    d = d.withColumn("n_hard", _count(lambda b: ~b["eligible"] & (b["n_fail"] > 0))).withColumn("n_rejected", _count(lambda b: ~b["eligible"] & ~b["critical_missing"]))
    names = lambda keep: F.array_join(F.transform(F.filter("banks", keep), lambda b: b["bank"]), ",")
    d = d.withColumn("eligible_banks", names(lambda b: b["eligible"])).withColumn("missing_banks", names(lambda b: ~b["eligible"] & b["critical_missing"])).withColumn("rejected_banks", names(lambda b: ~b["eligible"] & ~b["critical_missing"]))
    d = d.withColumn("best_bank", _first_best(lambda b: b["eligible"])).withColumn("closest_bank", _first_best(lambda b: ~b["eligible"] & (b["rule_score"] > 0)))
    d = d.withColumn("decision", F.when((F.col("completeness") == 0) | (F.col("n_total") == 0), "Insufficient Data").when(F.col("n_eligible") == F.col("n_total"), "Eligible").when(F.col("n_eligible") > 0, "Partially Eligible").when((F.col("n_critical") > 0) & (F.col("n_hard") == 0), "Partial Profile").otherwise("Not Eligible"))
    critical = F.exists("banks", lambda b: b["critical_fail"])
    average = F.aggregate("banks", F.lit(0.0), lambda a, b: a + b["rule_score"]) / F.greatest(F.col("n_total"), F.lit(1))
    d = d.withColumn("critical_fail", critical).withColumn("avg_rule_score", average)
    raw = F.least(0.85 + F.col("avg_rule_score") * 0.14, F.lit(0.99))
    raw = F.when(F.col("critical_fail"), F.least(raw, F.lit(0.60))).otherwise(raw) - F.greatest(F.col("n_rejected") - 1, F.lit(0)) * 0.04
    d = d.withColumn("confidence", _rounded(F.greatest(F.lit(0.05), F.least(raw, F.lit(0.99))), 2))
    core = sum((F.col(f).isNotNull().cast("int") for f in CRITICAL), F.lit(0))
    return d.withColumn("floored_confidence", F.greatest("confidence", F.when(core == 3, 0.80).when(core == 2, 0.65).otherwise(0.0)))


def retrieval_confidence(scores: Column, count: Column) -> Column:
    """Confidence of an answer from retrieval alone."""
    mean = F.when(F.size(scores) > 0, _rounded(F.least(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores), F.lit(1.0)), 3)).otherwise(F.least(count / 8, F.lit(1.0)))
    return F.when(count == 0, 0.10).otherwise(_rounded(F.least(0.60 + mean * 0.20, F.lit(0.84)), 2))


def failure_summary(reasoned: DataFrame) -> DataFrame:
    """How often each category failed for a profile, over lenders."""
    f = _each(reasoned, "fails")
    return f.groupBy("profile_id", F.col("e.category").alias("category")).agg(F.count("*").alias("n"))


def top_failures(reasoned: DataFrame, most: int = 5) -> DataFrame:
    """The first failure of each field by priority, then lender and rule; most fields at most."""
    key = lambda e: F.struct(e["priority"].alias("priority"), e["bank_ord"].alias("bank_ord"), e["ord"].alias("ord"), e["bank"].alias("bank"), e["field"].alias("field"), e["message"].alias("message"))
    ordered = F.array_sort(F.transform("fails", key))
    first = F.filter(ordered, lambda e: F.element_at(F.filter(ordered, lambda x: x["field"] == e["field"]), 1) == e)
    e = _each(reasoned, F.slice(first, 1, most), place=True)
    return e.select("profile_id", (F.col("i") + 1).alias("rank"), "e.field", "e.bank", "e.message")


def validate(reasoned: DataFrame) -> DataFrame:
    """profile_id, severity, issue, bank: contradictions between evaluations, decision and confidence."""
    issue = lambda cond, severity, text, bank=None: F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(text).alias("issue"), (bank if bank is not None else F.lit("")).alias("bank")))
    each = F.flatten(F.transform("banks", lambda b: F.array(
        issue(b["eligible"] & (b["n_fail"] > 0), "error", "eligible with failed rules", b["bank"]),
        issue(~b["eligible"] & (b["n_fail"] == 0) & ~b["critical_missing"], "warning", "not eligible without cause", b["bank"]),
        issue(b["dti_high"], "warning", "dti looks like a percentage", b["bank"]),
    )))
    whole = F.array(
        issue((F.col("decision") == "Eligible") & (F.col("n_eligible") < F.col("n_total")), "error", "decision eligible, lenders differ"),
        issue((F.col("decision") == "Not Eligible") & (F.col("n_eligible") > 0), "error", "decision not eligible, lenders differ"),
        issue(F.col("confidence") < 0.5, "warning", "low confidence"),
        issue(F.col("best_bank").isNotNull() & ~F.array_contains(F.split("eligible_banks", ","), F.col("best_bank")), "error", "best lender is not eligible", F.col("best_bank")),
        issue(F.col("critical_fail") & (F.col("decision") == "Eligible") & (F.col("n_eligible") == F.col("n_total")), "warning", "critical failures, all eligible"),
    )
    return _each(reasoned, F.array_compact(F.concat(each, whole))).select("profile_id", "e.*")


def ranked(evaluated: DataFrame) -> DataFrame:
    """Lenders of each profile by whole percent of the final score, then in order; with their rates."""
    order = F.array_sort(F.transform("banks", lambda b: F.struct((-F.floor(b["final_score"] * 100 + 1e-9)).alias("s"), b["bank_ord"].alias("o"), b["bank"].alias("bank"), b["eligible"].alias("eligible"))))
    r = _each(evaluated, order, place=True)
    rates = F.create_map(*[F.lit(x) for kv in RATES.items() for x in kv])
    return r.select("profile_id", (F.col("i") + 1).alias("rank"), F.col("e.bank").alias("bank"), (-F.col("e.s")).cast("int").alias("score"), F.col("e.eligible").alias("eligible"), F.coalesce(F.try_element_at(rates, F.lower("e.bank")), F.lit("N/A")).alias("rate"))


def standing(evaluated: DataFrame) -> DataFrame:
    """Lenders of each profile by rule score, then in order: profile_id, position, bank, rule_score."""
    order = F.array_sort(F.transform("banks", lambda b: F.struct((-b["rule_score"]).alias("s"), b["bank_ord"].alias("o"), b["bank"].alias("bank"))))
    r = _each(evaluated, order, place=True)
    return r.select("profile_id", (F.col("i") + 1).alias("position"), F.col("e.bank").alias("bank"), (-F.col("e.s")).alias("rule_score"))


def partial_report(reasoned: DataFrame) -> DataFrame:
    """The alternative report: lenders with any missing field are partial, the closest lender may have no score at all,
    the decision is more careful, and confidence is simpler."""
    partial = lambda b: ~b["eligible"] & (b["n_missing"] > 0)
    conf = _rounded(F.least(0.5 * F.col("avg_rule_score") + 0.3 * F.col("completeness") + 0.2, F.lit(0.99)), 2)
    unsure = (F.col("completeness") == 0) | ((_count(partial) > 0) & (F.col("n_eligible") == 0))
    decision = F.when(unsure, "Insufficient Data").when(F.col("n_eligible") == F.col("n_total"), "Eligible").when(F.col("n_eligible") > 0, "Partially Eligible").otherwise("Not Eligible")
    return reasoned.select("profile_id", "n_eligible", _count(partial).alias("n_partial"), (F.col("n_total") - F.col("n_eligible") - _count(partial)).alias("n_rejected"), _first_best(lambda b: ~b["eligible"]).alias("closest_bank"), decision.alias("decision"), conf.alias("report_confidence"))


def clean_profile(p: DataFrame) -> DataFrame:
    """Out-of-range values become null; a debt ratio given in percent becomes a share."""
    dti = F.when(F.col("dti_ratio") > 1.5, F.col("dti_ratio") / 100).otherwise(F.col("dti_ratio"))
    keep = lambda c, ok, v=None: F.when(ok, F.col(c) if v is None else v)
    return p.select(
        "profile_id",
        keep("age", F.col("age").between(18, 80)).alias("age"),
        keep("monthly_income", F.col("monthly_income").between(3e3, 1e7), F.round("monthly_income", 2)).alias("monthly_income"),
        keep("credit_score", F.col("credit_score").between(300, 900)).alias("credit_score"),
        F.lower("employment_type").alias("employment_type"),
        keep("work_experience_months", (F.col("work_experience_months") > 0) & (F.col("work_experience_months") < 600)).alias("work_experience_months"),
        F.when((dti > 0) & (dti < 1), _rounded(dti, 4)).alias("dti_ratio"),
    )


def merge_profiles(first: DataFrame, second: DataFrame) -> DataFrame:
    """Field by field, first wins over second."""
    return first.alias("a").join(second.alias("b"), "profile_id", "left").select("profile_id", *[F.coalesce(F.col(f"a.{f}"), F.col(f"b.{f}")).alias(f) for f in FIELDS])


# Why the best lender is the best one; by the engine, and by the alternative report.
BEST = (
    "%s is the recommended bank — it passed all %d eligibility rules with a score of %s%% and has the lowest entry requirements among eligible options.",
    "%s has the highest eligibility score (%s%%) among evaluated banks, passing %d rules with %d condition(s) to address.",
)
BEST_PLAIN = (
    "%s is recommended — passed all %d eligibility rules (%s%% score) and has the most favourable terms.",
    "%s has the highest eligibility score (%s%%) among evaluated banks, with %d rules passed and %d to address.",
)


def best_sentence(evaluated: DataFrame) -> DataFrame:
    """Why the best lender is the best one: from its final score, and in the alternative report from its rule score.
    Null without an eligible lender."""
    best = F.get(F.filter("banks", lambda b: b["bank"] == F.col("best_bank")), F.lit(0))

    def said(words: tuple[str, str], score: str) -> Column:
        share = F.rint(F.col("b")[score] * 100).cast("int").cast("string")
        bank, n_pass, n_fail = F.col("b.bank"), F.col("b.n_pass"), F.col("b.n_fail")
        return F.when(n_fail == 0, F.format_string(words[0], bank, n_pass, share)).when(n_fail > 0, F.format_string(words[1], bank, share, n_pass, n_fail))

    r = reason(evaluated).select("profile_id", best.alias("b"))
    return r.select("profile_id", said(BEST, "final_score").alias("sentence"), said(BEST_PLAIN, "rule_score").alias("plain_sentence"))


# What a writer is told of a lender.
LABELS = ("ELIGIBLE", "NOT ELIGIBLE", "PARTIAL PROFILE (missing fields — cannot fully evaluate)")
LINES = {"failed": "    ✗ FAILED: ", "missing": "    ? MISSING (NOT a failure — just not provided): ", "passed": "    ✓ PASSED: "}


def prompt(evaluated: DataFrame) -> DataFrame:
    """What a writer is told: the decision, and for each lender its label and score, its failed and missing rules, and
    three passed ones at most."""

    def lender(x: Column) -> Column:
        b, t = x["banks"], x["texts"]
        some = lambda c: F.size(t[c]) > 0
        label = F.when(some("missing") & ~some("failed"), F.lit(LABELS[2])).when(b["eligible"], F.lit(LABELS[0])).otherwise(F.lit(LABELS[1]))
        head = F.concat(F.lit("  "), b["bank"], F.lit(": "), label, F.lit(" (score="), F.rint(b["rule_score"] * 100).cast("int").cast("string"), F.lit("%)"))
        marked = lambda c: F.transform(F.slice(t[c], 1, 3) if c == "passed" else t[c], lambda m: F.concat(F.lit(LINES[c]), m))
        return F.array_join(F.concat(F.array(head), *map(marked, LINES)), "\n")

    lenders = F.array_join(F.transform(F.arrays_zip("banks", "texts"), lender), "\n")
    return reason(evaluated).select("profile_id", F.concat(F.lit("FINAL DECISION (must appear verbatim in summary): "), F.col("decision"), F.lit("\n\nPER-BANK RULE RESULTS:\n"), lenders).alias("prompt"))


# Intents that are answered without a profile, and what is said where nothing is known.
FACTUAL_INTENTS = ("interest_rate", "fees", "document", "comparison")
NO_DATA = "Please provide your profile details to check eligibility."


def answer_without_data(intent: Column, n_lenders: Column, n_chunks: Column) -> Column:
    """How a query is answered: explained from what was found, from general knowledge if it asks for a fact, else with
    the request for a profile."""
    return F.when((n_lenders > 0) | (n_chunks > 0), F.lit("explain")).when(intent.isin(*FACTUAL_INTENTS), F.lit("explain without context")).otherwise(F.lit(NO_DATA))
