"""Queries over the extraction of signals from applicants' sentences and of values that pages write.

The SQL states its patterns itself, so that it checks those of the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as X
from ..operators.rules import answer_without_data
from ..plans.spread import dealt
from . import cases
from .registry import query, table


def _got(t: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({t}, '(?i){pattern}', {group}), '')"


def _num(t: str, pattern: str, group: int = 1) -> str:
    return f"try_cast(replace({_got(t, pattern, group)}, ',', '') as double)"


def _int(t: str, pattern: str, group: int = 1) -> str:
    return f"try_cast({_got(t, pattern, group)} as int)"


def _says(t: str, pattern: str) -> str:
    return f"regexp_matches({t}, '(?i){pattern}')"


def _within(x: str, low: str, high: str) -> str:
    return f"case when {x} between {low} and {high} then {x} end"


def _first(t: str, table_: dict[str, str], default: str = "null") -> str:
    return "case " + " ".join(f"when {_says(t, p)} then '{n}'" for n, p in table_.items()) + f" else {default} end"


def _listed(conditions: list[tuple[str, str]]) -> str:
    """Names of the conditions that hold, in order, each once."""
    names = "[" + ", ".join(f"case when {c} then '{n}' end" for n, c in conditions) + "]"
    some = f"list_filter({names}, lambda x: x is not null)"
    return f"list_filter({some}, lambda x, i: list_position({some}, x) = i)"


# ---- queries of applicants

_SLANG = (
    (r"\bmil\s+jayega\b", "will i get"), (r"\bmil\s+sakta\s+hai\b", "can i get"), (r"\bmil\s+sakta\b", "can i get"), (r"\bkya\s+loan\b", "can i get loan"), (r"\bloan\s+milega\b", "will i get loan"), (r"\bkya\b", ""),
    (r"\bpe\b", "for"), (r"\bke\s+liye\b", "for"), (r"\bjaldi\b", "fast urgent"), (r"\bkaun\s*sa\b", "which"), (r"\bkitna\b", "how much"), (r"\bsaal\b", "years"), (r"\brupaye\b", "rupees"), (r"\bnahi\b", "no"), (r"\bhoga\b", "will be"),
    (r"\bbro\b", ""), (r"\byaar\b", ""), (r"\bdude\b", ""),
)


def _plain(slang) -> str:
    out = "trim(s)"
    for p, w in slang:
        out = f"regexp_replace({out}, '{p}', '{w}', 'gi')"
    return rf"trim(regexp_replace({out}, '\s{{2,}}', ' ', 'g'))"


_SAID = cases.pick(cases.ASKED, "c_custkey")
_Q = f"with a as (select c_custkey as id, {_SAID} as s from customer), q as (select id, s, {_plain(_SLANG)} as t, lower({_plain(_SLANG)}) as l from a) "


def _asked(spark, sf_dir):
    s = dealt(table(spark, sf_dir, "customer").select("c_custkey")).select(F.col("c_custkey").alias("id"), F.explode(F.array(F.expr(_SAID))).alias("s"))
    return X.computed(s, "t", X.normalise(F.col("s")))


_INCOMES = (
    _num("t", r"₹?\s*(\d[\d,]*)\s*(?:per\s*month|/month|pm\b|monthly)"),
    _num("t", r"₹?\s*(\d+)\s*k\b") + " * 1000",
    _num("t", r"(\d+(?:\.\d+)?)\s*lpa\b") + " * 100000 / 12",
    _num("t", r"salary\s+(?:of\s+)?₹?\s*(\d[\d,]*)"),
    _num("t", r"earn(?:ing|s)?\s+₹?\s*(\d[\d,]*)"),
    _num("t", r"income\s+(?:of\s+)?₹?\s*(\d[\d,]*)"),
)
_INCOME = "coalesce(" + ", ".join(f"case when {x} > 5e3 and {x} < 1e8 then round({x}, 2) end" for x in _INCOMES) + ")"
_NAMED = r"\b(cibil|credit\s*score)\s*(?:of|is|:|=)?\s*(\d{3})\b"
_SCORE0 = f"case when {_says('t', _NAMED)} then {_int('t', _NAMED, 2)} when {_says('t', 'cibil|score')} then {_int('t', r'\b([4-9]\d{2})\b')} end"
_SCORE = _within(f"({_SCORE0})", "300", "900")
_AGED = r"\b(\d{2})\s*years?\s*(?:old|of\s*age)?\b|(?:age|aged?)\s*(?:of\s*|is\s*|:)?\s*(\d{2})\b|(?:\bam|is)\s+(\d{2})\b"
_AGE = _within("coalesce(" + ", ".join(_int("t", _AGED, g) for g in (1, 2, 3)) + ")", "18", "75")
_YEARS = _int("t", r"(\d+)\s*years?\s*(?:of\s*)?(?:experience|service|work)")
_DTI = _num("t", r"\bdti\s*(?:of|is|=)?\s*(\d+)%?")
_DTI = f"case when {_DTI} > 1.5 then {_DTI} / 100 else {_DTI} end"
_EMPLOYMENT = _first("t", {
    "self_employed": r"\bself.?emp|\bfreelance[rd]?\b|\bfreelancing\b|\bgig\s*worker\b|\bconsultant\b|\bown\s+business\b|\bproprietor\b|\bbusiness\s+owner\b",
    "unemployed": r"\bno\s+job\b|\bunemployed\b|\bjobless\b|\bno\s+(?:fixed\s+)?income\b",
    "government": r"\bgovernment\b|\bpsu\b|\bpublic\s+sector\b|\bdefence\b|\bdefense\b",
    "professional": r"\bprofessional\b|\bdoctor\b|\bca\b|\bchartered\b|\blawyer\b|\barchitect\b",
    "salaried": r"\bsalaried\b|\bemployed\b|\bservice\b|\bworking\b",
})
_BANKS = _listed([("Axis", "contains(l, 'axis')"), ("HDFC", "contains(l, 'hdfc')"), ("ICICI", "contains(l, 'icici')"), ("SBI", "contains(l, 'sbi')"), ("SBI", "contains(l, 'state bank')")])
_LOAN = "case when contains(l, 'personal loan') then 'personal' when contains(l, 'home loan') or contains(l, 'housing loan') then 'home' when contains(l, 'car loan') or contains(l, 'auto loan') then 'car' when contains(l, 'business loan') then 'business' when contains(l, 'education loan') then 'education' when contains(l, 'gold loan') then 'gold' else 'personal' end"


@query(_Q + f"select id, {_INCOME} as income, {_SCORE} as score, {_AGE} as age, case when {_YEARS} > 0 and {_YEARS} < 50 then {_YEARS} * 12 end as experience, case when {_DTI} > 0 and {_DTI} < 1 then round({_DTI}, 3) end as dti from q")
def q40_query_numbers(spark, sf_dir):
    t = F.col("t")
    return _asked(spark, sf_dir).select("id", X.income(t).alias("income"), X.credit_score(t).alias("score"), X.age(t).alias("age"), X.experience_months(t).alias("experience"), X.dti(t).alias("dti"))


@query(_Q + f"select id, array_to_string({_BANKS}, ',') as lenders, {_LOAN} as loan, {_EMPLOYMENT} as employment from q")
def q41_query_entities(spark, sf_dir):
    t = F.col("t")
    return _asked(spark, sf_dir).select("id", F.array_join(X.lenders(t), ",").alias("lenders"), X.first_phrase(t, X.LOANS, "personal").alias("loan"), X.employment(t).alias("employment"))


_COMPARES = r"\bcompare|\bvs\.?\b|\bbetter\b|\bbest\b|\bwhich bank|\bhighest|\blowest\b|\bfastest\b|\bsafest\b|\bcheapest\b|\beasiest\b|\bquickest\b"
_WISHES = r"\bneed.*loan\b|\bwant.*loan\b|\bget.*loan\b"
_FACTS = r"\bwhat\s+(?:is|are|documents?)\b|\bhow\s+much\b|\bminimum\b|\bmaximum\b|\brequired\b|\bwhat\s+do\s+i\s+need\b"
_POINTS = {
    "e": f"2 * cast({_says('t', r'\beligib|\bqualif|\bcan i\b|\bam i\b|\bwill i\b|\bdo i qualify|\bapply\b|\bget a loan\b|\bget approved\b|\bapproved\b|' + _WISHES + r'|\bwhat to do\b|\burgent.*loan\b|\bloan.*urgent\b')} as int)"
    f" + cast({_says('t', 'salary|cibil|income|age|score|earn')} and not {_says('t', _FACTS)} as int) + 2 * cast({_says('t', _WISHES)} as int)",
    "i": f"2 * cast({_says('t', r'\binterest rate|\broi\b|\brate of interest|\b% p\.?a|\bemi\b|\binstalment\b|\bminimum (?:salary|income|cibil|age|score)\b|\bwhat (?:is|are) (?:the )?(?:minimum|maximum|requirement)')} as int)",
    "c": f"2 * cast({_says('t', _COMPARES)} as int) + 2 * cast(len({_BANKS}) > 1 as int)",
    "f": f"2 * cast({_says('t', r'\bfee|\bcharge|\bpenalty|\bprocessing fee|\bforeclos|\bprepay')} as int)",
    "d": f"2 * cast({_says('t', r'\bdocument|\bkyc\b|\bpapers?\b|\bsubmit\b|\brequired.*doc|\bdoc.*required|\bpan(?:\s*card)?\b|\baadhaar\b|\bproof\b|\bsalary\s*slip\b|\bitr\b|\bbank\s*statement\b|\bpassport\b|\bform\s*16\b')} as int)",
}
_INTENT = _Q + ", p as (select *, " + ", ".join(f"{v} as {k}" for k, v in _POINTS.items()) + f"), j as (select *, greatest(e, i, c, f, d) as best from p), k as (select *, case when best = 0 then 'general' when e = best then 'eligibility' when i = best then 'interest_rate' when c = best and {_says('t', _COMPARES)} then 'comparison' when f = best then 'fees' when d = best then 'document' else 'comparison' end as intent from j) "
_INTENT = _INTENT.replace(" as d), j as", " as d from q), j as")


@query(_INTENT + "select id, intent, case when best = 0 then 0.5e0 else round(best / (e + i + c + f + d), 2) end as confidence from k")
def q42_query_intent(spark, sf_dir):
    t = F.col("t")
    return _asked(spark, sf_dir).select("id", X.intent(t).alias("intent"), X.intent_confidence(t).alias("confidence"))


_FOR_MODELS = tuple((p, "fast" if "jaldi" in p else w) for p, w in _SLANG if "rupaye" not in p)


@query(_Q + f"select id, t as normal, {_plain(_FOR_MODELS)} as for_models from q")
def q43_query_normalised(spark, sf_dir):
    return _asked(spark, sf_dir).select("id", F.col("t").alias("normal"), X.normalise(F.col("s"), for_models=True).alias("for_models"))


_HINTS = [
    ("credit_score", r"\bcibil\b|credit.?score"), ("monthly_income", r"\bincome\b|\bsalary\b|\bearning"), ("age", r"\bage\b|\byears.old\b"), ("dti_ratio", r"\bdti\b|debt.to.income"), ("employment_type", r"\bemployment\b|\bsalaried\b"),
    ("work_experience_months", r"\bexperience\b|\btenure\b"), ("interest_rate", r"\binterest\s*rate\b|\broi\b"), ("fees", r"\bfee\b|\bcharge\b|\bpenalty\b|\bprocessing\b|\bforeclos\b"),
]


@query(_Q + f"select id, array_to_string({_listed([(n, _says('t', p)) for n, p in _HINTS])}, ',') as hints from q")
def q44_query_hints(spark, sf_dir):
    return _asked(spark, sf_dir).select("id", F.array_join(X.hints(F.col("t")), ",").alias("hints"))


def _once(text: str) -> str:
    w = rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda x: x <> '')"
    return f"array_to_string(list_filter({w}, lambda x, i: list_position(list_transform({w}, lambda y: lower(y)), lower(x)) = i), ' ')"


_PARTS = f"""concat_ws(' ', t, case when intent = 'eligibility' then 'eligibility criteria requirements' end, case when {_says('t', r'\burgent\b|\bfast\b|\bquick\b|\binstant\b|\bjaldi\b')} then 'instant disbursal pre-approved fast approval' end,
 case when intent = 'comparison' or {_says('t', r'\bbest\b|\bsafest\b|\bcheapest\b|\blowest\b')} then 'compare difference vs lowest interest rate' end, case when {_LOAN} <> 'personal' then {_LOAN} || ' loan' end, array_to_string({_BANKS}, ' '),
 case when {_INCOME} is not null then 'salary income ' || printf('%.0f', {_INCOME}) end, 'CIBIL credit score ' || {_SCORE}, {_EMPLOYMENT})"""


@query(_INTENT + f"select id, {_once(_PARTS)} as query from k")
def q45_query_reformulated(spark, sf_dir):
    return _asked(spark, sf_dir).select("id", X.reformulate(F.col("t")).alias("query"))


_KNOWN = f"coalesce({_INCOME} is not null or {_SCORE} is not null or {_AGE} is not null or {_YEARS} between 1 and 49 or {_DTI} between 1e-9 and 0.999999999 or {_EMPLOYMENT} is not null, false)"


@query(_INTENT + f"select id, len(regexp_extract_all(s, '[^ ]+')) <= 3 and intent = 'eligibility' and {_KNOWN} as direct, intent in ('eligibility', 'comparison') and {_KNOWN} as by_rules from k")
def q46_query_route(spark, sf_dir):
    t = F.col("t")
    known = F.coalesce(*[x.cast("string") for x in (X.income(t), X.credit_score(t), X.age(t), X.experience_months(t), X.dti(t), X.employment(t))]).isNotNull()
    kind = X.intent(t)
    return _asked(spark, sf_dir).select("id", ((F.regexp_count("s", F.lit("[^ ]+")) <= 3) & (kind == "eligibility") & known).alias("direct"), (kind.isin("eligibility", "comparison") & known).alias("by_rules"))


@query(_INTENT + "select id, case when id % 3 > 0 or id % 2 > 0 then 'explain' when intent in ('interest_rate', 'fees', 'document', 'comparison') then 'explain without context' else 'Please provide your profile details to check eligibility.' end as answer from k")
def q17_answer_route(spark, sf_dir):
    return _asked(spark, sf_dir).select("id", answer_without_data(X.intent(F.col("t")), F.col("id") % 3, F.col("id") % 2).alias("answer"))


_PI = r"(?:earn|salary|income|pay)\s*(?:of|is|=|:)?\s*₹?\s*(\d[\d,]*)\s*(k|thousand|lakh|lpa)?"
_PB = r"₹?\s*(\d[\d,]+)\s*(k\b|thousand\b)?"
_PX = f"({_num('s', _PI)} * case lower({_got('s', _PI, 2)}) when 'k' then 1e3 when 'thousand' then 1e3 when 'lakh' then 1e5 when 'lpa' then 1e5 / 12 else 1 end)"
_PY = f"({_num('s', _PB)} * case when {_got('s', _PB, 2)} is null then 1 else 1e3 end)"
_PS = r"(?:cibil|credit|score)\s*(?:of|is|=|:)?\s*(\d{3})"
_PA = r"(\d{2})\s*years?\s*(?:old|of\s*age)?\b|(?:age|aged?)\s*(?:of\s*|is\s*|:)?\s*(\d{2})\b|(?:\bam|is)\s+(\d{2})\b"


@query(_Q + f"""select id, coalesce(case when {_PX} > 3e3 and {_PX} < 1e8 then round({_PX}, 2) end, {_within(f'round({_PY}, 2)', '5e3', '5e5')}) as income,
 {_within(f"(case when {_says('s', _PS)} then {_int('s', _PS)} else {_int('s', r'\b([4-9]\d{2})\b')} end)", '300', '900')} as score, {_within('coalesce(' + ', '.join(_int('s', _PA, g) for g in (1, 2, 3)) + ')', '18', '80')} as age,
 {_first('s', {'unemployed': r'\bno\s+job\b|\bunemployed\b|\bjobless\b', 'self_employed': r'\bfreelance[rd]?\b|\bfreelancing\b|\bself.?emp\b|\bconsultant\b|\bown\s+business\b|\bproprietor\b|\bgig\b', 'government': r'\bgovernment\b|\bpsu\b|\bdefence\b|\bdefense\b', 'salaried': r'\bsalaried\b|\bworking\b|\bemployed\b|\bservice\b'})} as employment from q""")
def q4a_query_plain_profile(spark, sf_dir):
    p = X.plain_profile(F.col("s"))
    return _asked(spark, sf_dir).select("id", p["monthly_income"].alias("income"), p["credit_score"].alias("score"), p["age"].alias("age"), p["employment_type"].alias("employment"))


# ---- values that pages write

_VALUE = cases.pick(cases.WRITTEN, "p_partkey")
_N = f"with q as (select p_partkey as id, {_VALUE} as s, lower({_VALUE}) as t from part) "


def _written(spark, sf_dir):
    return dealt(table(spark, sf_dir, "part").select("p_partkey")).select(F.col("p_partkey").alias("id"), F.explode(F.array(F.expr(_VALUE))).alias("s"))


def _money(x: str) -> str:
    return f"coalesce({_num(x, r'([\d.]+)\s*cr(?:ore)?')} * 1e7, {_num(x, r'([\d.]+)\s*la(?:kh|c|cs)?')} * 1e5, {_num(x, r'([\d.]+)\s*(?:thousand|k)\b')} * 1e3, {_num(f'replace({x}, chr(32), chr(0))'.replace('chr(0)', chr(39) * 2), r'([\d,]+(?:\.\d+)?)')})"


_AS_MEANT, _AS_CODED = "regexp_replace(trim(t), '[₹,]', '', 'g')", r"trim(regexp_replace(trim(t), '[₹,\s/month/year]', ' ', 'g'))"
_LAKHS = f"coalesce({_num('t', r'([\d.]+)\s*lpa\b')}, {_num('t', r'([\d.]+)\s*lakh.*?(?:per\s*annum|pa\b|annually)')})"
_PM = r"(?:₹|rs\.?)?\s*([\d,]+(?:\.\d+)?)\s*(k\b|thousand)?\s*(?:per\s*month|monthly|pm\b|/month)"


def _monthly(money: str) -> str:
    return f"coalesce(round({_LAKHS} * 1e5 / 12, 2), {_num('t', _PM)} * case when {_got('t', _PM, 2)} is null then 1 else 1e3 end, case when {money} > 5e5 then round({money} / 12, 2) when {money} >= 5e3 then {money} end)"


@query(_N + f", n as (select *, {_money(_AS_MEANT)} as m, {_money(_AS_CODED)} as c from q) select id, m as money, c as money_as_coded, {_monthly('m')} as monthly, {_monthly('c')} as monthly_as_coded from n")
def q47_money(spark, sf_dir):
    s = F.col("s")
    return _written(spark, sf_dir).select("id", X.money(s).alias("money"), X.money(s, as_coded=True).alias("money_as_coded"), X.monthly_income(s).alias("monthly"), X.monthly_income(s, as_coded=True).alias("monthly_as_coded"))


_RANGE = r"(\d+(?:\.\d+)?)\s*%?\s*(?:to|–|—|-|upto|up\s*to)\s*(\d+(?:\.\d+)?)\s*%"
_R = [_num("s", _RANGE, g) for g in (1, 2)]
_ALL = r"list_filter(list_transform(regexp_extract_all(s, '(\d+(?:\.\d+)?)\s*%', 1), lambda x: cast(x as double)), lambda x: x > 0 and x < 100)"
_PLAUSIBLE = f"least({_R[0]}, {_R[1]}) > 0 and greatest({_R[0]}, {_R[1]}) < 100"


@query(_N + f"select id, case when {_PLAUSIBLE} then least({_R[0]}, {_R[1]}) else list_min({_ALL}) end as low, case when {_PLAUSIBLE} then greatest({_R[0]}, {_R[1]}) else list_max({_ALL}) end as high, case when {_num('s', r'(\d+(?:\.\d+)?)\s*%')} > 0 and {_num('s', r'(\d+(?:\.\d+)?)\s*%')} < 100 then {_num('s', r'(\d+(?:\.\d+)?)\s*%')} end as first, {_within(_int('s', r'\b([4-9]\d{2})\b'), '300', '900')} as score from q")
def q48_rates(spark, sf_dir):
    r = X.rate_range(F.col("s"))
    return _written(spark, sf_dir).select("id", F.get(r, 0).alias("low"), F.get(r, 1).alias("high"), X.percent(F.col("s")).alias("first"), X.least_score(F.col("s")).alias("score"))


_A = [_int("s", r"(\d+)\s*(?:to|–|—|-)\s*(\d+)", g) for g in (1, 2)]
_AM = _int("s", r"(?:min(?:imum)?|at\s*least)\s*(\d+)")
_AOK = f"{_A[0]} >= 18 and {_A[0]} <= {_A[1]} and {_A[1]} <= 80"
_TWO = r"list_filter(list_transform(regexp_extract_all(s, '\b(\d{2})\b', 1), lambda x: cast(x as int)), lambda x: x between 18 and 80)"


@query(_N + f"select id, case when {_AOK} then {_A[0]} when {_AM} between 18 and 40 then {_AM} when len({_TWO}) > 1 then list_min({_TWO}) end as low, case when {_AOK} then {_A[1]} when {_AM} between 18 and 40 then 65 when len({_TWO}) > 1 then list_max({_TWO}) end as high from q")
def q49_ages(spark, sf_dir):
    r = X.age_range(F.col("s"))
    return _written(spark, sf_dir).select("id", F.get(r, 0).alias("low"), F.get(r, 1).alias("high"))


def _tenure(x: str) -> str:
    bare = _num(x, r"^\s*(\d+)\s*$")
    return f"cast(trunc(coalesce({_num(x, r'(\d+(?:\.\d+)?)\s*(?:year|yr)')} * 12, {_num(x, r'(\d+)\s*(?:month|mo\b)')}, case when {bare} <= 30 then {bare} * 12 else {bare} end)) as int)"


_SPLIT = r"regexp_split_to_array(t, '\s*(?:to|–|—|-)\s*')"
_UNIT = r"regexp_extract(w[2], '(year|yr|month|mo\b)', 1)"
_TENURES = _N + f", p as (select *, {_SPLIT} as w from q), u as (select *, case when regexp_matches(w[1], '^\\s*\\d+\\s*$') and len(w) > 1 and {_UNIT} <> '' then trim(w[1]) || ' ' || {_UNIT} else w[1] end as l from p), v as (select id, len(w) = 2 as pair, {_tenure('l')} as a, {_tenure('w[1]')} as c, {_tenure('w[2]')} as b, {_tenure('t')} as one from u) "


def _bound(f: str, a: str) -> str:
    return f"case when pair and {a} <> 0 and b <> 0 then {f}({a}, b) when one <> 0 then one end"


@query(_TENURES + f"select id, {_bound('least', 'a')} as low, {_bound('greatest', 'a')} as high, {_bound('least', 'c')} as low_as_coded, {_bound('greatest', 'c')} as high_as_coded from v")
def q50_tenures(spark, sf_dir):
    r, c = X.tenure_range(F.col("s")), X.tenure_range(F.col("s"), as_coded=True)
    return _written(spark, sf_dir).select("id", F.get(r, 0).alias("low"), F.get(r, 1).alias("high"), F.get(c, 0).alias("low_as_coded"), F.get(c, 1).alias("high_as_coded"))


def _kinds(t: str) -> str:
    table_ = (("salaried", "salaried"), ("salaried", "salary"), ("salaried", "employed"), ("self_employed", "self.employ"), ("self_employed", "self employ"), ("self_employed", "business"), ("professional", "professional"), ("professional", "doctor"), ("professional", r"ca\b"), ("government", "government"), ("government", "govt"), ("government", "psu"), ("government", "public sector"), ("nri", "nri"))
    return _listed([(v, f"regexp_matches({t}, '{p}')") for v, p in table_])


@query(_N + f"select id, array_to_string({_kinds('t')}, ',') as kinds from q")
def q51_employment_kinds(spark, sf_dir):
    return _written(spark, sf_dir).select("id", F.array_join(X.employment_kinds(F.col("s")), ",").alias("kinds"))


# ---- what page texts tell of a loan

_PAGE = cases.pick(cases.TOLD, "o_orderkey")
_PAGES = f"with a as (select o_orderkey as id, {_PAGE} as page from orders) "
_INC = (
    r"(?:min(?:imum)?\s*(?:monthly)?\s*(?:income|salary|earning))\s*(?:of|:)?\s*([\d,₹.\s]+(?:lakh|lpa|k|thousand)?(?:\s*per\s*month|\s*pm)?)",
    r"(?:income|salary)\s+(?:should\s+be|must\s+be|required|atleast)\s*([\d,₹.\s]+(?:lakh|lpa|k)?)",
    r"monthly\s+(?:income|salary)\s+(?:above|more\s+than|greater\s+than|at\s+least)\s*([\d,₹.\s]+)",
)
_AGES = (r"(age\s*(?:between|from|:)?\s*\d+\s*(?:to|–|-|and)\s*\d+\s*years)", r"((?:minimum|min)?\s*age\s*(?:of|:)?\s*\d+\s*years?)")
_AMOUNT = r"(?:loan|borrow)\s*(?:up\s*to|upto|maximum|of|ranging\s*from)?\s*₹?\s*([\d.,]+\s*(?:lakh|crore|k|thousand)?)\s*(?:to|–)?\s*₹?\s*([\d.,]+\s*(?:lakh|crore|k|thousand)?)?"


def _of(column: str, sql: str, name: str) -> str:
    """sql, which reads s and t, over the text of another column."""
    return f"(select {sql} from (select {column} as s, lower({column}) as t)) as {name}"


_RAGE = f"case when {_AOK} then [{_A[0]}, {_A[1]}] when {_AM} between 18 and 40 then [{_AM}, 65] when len({_TWO}) > 1 then [list_min({_TWO}), list_max({_TWO})] end"
_MONTHLY = _monthly(_money(_AS_MEANT))


@query(
    _PAGES + ", b as (select *, " + ", ".join(f"{_got('page', p)} as i{k}" for k, p in enumerate(_INC)) + ", " + ", ".join(f"{_got('page', p)} as g{k}" for k, p in enumerate(_AGES)) + f", {_got('page', _AMOUNT)} as m1, {_got('page', _AMOUNT, 2)} as m2, {_num('page', r'processing\s*(?:fee|charge)\s*(?:of|:)?\s*([\d.]+)\s*%')} as fee, {_got('page', r'(?:cibil|credit\s*score)\s*(?:of|above|minimum|min|:)?\s*(\d{3})\+?')} as c from a)"
    + ", d as (select *, " + ", ".join(_of(f"i{k}", _MONTHLY, f"n{k}") for k in range(3)) + ", " + ", ".join(_of(f"g{k}", _RAGE, f"r{k}") for k in range(2)) + ", " + _of("m1", _money(_AS_MEANT), "low") + ", " + _of("m2", _money(_AS_MEANT), "top") + f", {_within(_int('c', r'\b([4-9]\d{2})\b'), '300', '900')} as score from b), f as (select *, case when m2 is null then low else top end as high from d)"
    + " select id, coalesce(nullif(n0, 0), nullif(n1, 0), nullif(n2, 0)) as income, coalesce(r0, r1)[1] as age_from, coalesce(r0, r1)[2] as age_to, case when low > 0 and high > 0 and low <= high then low end as amount_from, case when low > 0 and high > 0 and low <= high then high end as amount_to, score, case when fee > 0 and fee < 10 then fee end as fee from f"
)
def q52_page_terms(spark, sf_dir):
    t = dealt(table(spark, sf_dir, "orders").select("o_orderkey")).select(F.col("o_orderkey").alias("id"), F.explode(F.array(F.expr(_PAGE))).alias("page"))
    x = X.loan_terms(F.col("page"))
    pair = lambda k, i: F.get(x[k], F.lit(i))
    return t.select("id", x["min_income"].alias("income"), pair("age_range", 0).alias("age_from"), pair("age_range", 1).alias("age_to"), pair("loan_amount", 0).alias("amount_from"), pair("loan_amount", 1).alias("amount_to"), x["min_cibil"].alias("score"), x["processing_fee_pct"].alias("fee"))


_NAMES = (("axis bank", "Axis"), ("axisbank", "Axis"), ("hdfc bank", "HDFC"), ("hdfcbank", "HDFC"), ("icici bank", "ICICI"), ("icicidirect", "ICICI"), ("state bank of india", "SBI"), ("sbi", "SBI"), ("paisabazaar", "Paisabazaar"), ("bankbazaar", "BankBazaar"), ("rbi", "RBI"), ("reserve bank", "RBI"))
_ADDRESSES = (("icici", "ICICI"), ("axis", "Axis"), ("sbi", "SBI"), ("hdfc", "HDFC"), ("paisabazaar", "Paisabazaar"), ("bankbazaar", "BankBazaar"), ("rbi", "RBI"))
_WRITERS = ("Axis Bank Ltd", "https://www.axisbank.com/a", "HDFC Bank", "hdfcbank", "ICICI Bank", "icicidirect.com", "State Bank of India", "onlinesbi", "PaisaBazaar", "www.bankbazaar.com", "arbiter", "Reserve Bank", "Some Co-operative")
_NAMED_BY = cases.pick(_WRITERS, "s_suppkey")


@query(f"with q as (select s_suppkey as id, {_NAMED_BY} as s from supplier) select id, case " + " ".join(f"when contains(lower(s), '{k}') then '{v}'" for k, v in _NAMES) + " else s end as bank, case " + " ".join(f"when contains(lower(s), '{k}') then '{v}'" for k, v in _ADDRESSES) + " end as of_address from q")
def q53_bank_names(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.explode(F.array(F.expr(_NAMED_BY))).alias("s"))
    return t.select("id", X.bank_name(F.col("s")).alias("bank"), X.bank_of_address(F.col("s")).alias("of_address"))


_ANSWER = """case e.event_id % 6 when 0 then '{"salary": "₹' || (e.event_id % 900) || ',500", "age": 31, "cibil": 7' || (10 + e.event_id % 90) || '}' when 1 then '{"monthly_income": ' || (e.event_id % 700) || ', "employment_type": "Salaried", "work_experience": 30}'
 when 2 then '{"income": "n/a", "credit_score": ' || (e.event_id % 1100) || ', "dti_ratio": 0.4}' when 3 then '{"monthly_income": ' || (e.event_id * 7 % 90000) || ', "credit_score": ' || (e.event_id % 1100) || ', "age": ' || (e.event_id % 99) || ', "employment_type": "Gig"}' when 4 then '{}' else 'not json' end"""
_MODEL = f"with a as (select event_id as id, {_ANSWER} as raw from events e), j as (select id, case when json_valid(raw) then raw end as j from a), v as (select id, " + ", ".join(f"json_extract_string(j, '$.{k}') as {k}" for k in ("monthly_income", "salary", "income", "age", "credit_score", "cibil", "cibil_score", "employment_type", "work_experience_months", "work_experience", "experience_months", "dti_ratio")) + r" from j), w as (select *, try_cast(regexp_replace(coalesce(monthly_income, salary, income), '[₹,\s]', '', 'g') as double) as x from v) "


@query(_MODEL + "select id, round(case when x < 500 then x * 100000 / 12 else x end, 2) as income, try_cast(age as double) as age, coalesce(try_cast(credit_score as double), try_cast(cibil as double), try_cast(cibil_score as double)) as score, lower(nullif(employment_type, '')) as employment, coalesce(try_cast(work_experience_months as double), try_cast(work_experience as double), try_cast(experience_months as double)) as experience, try_cast(dti_ratio as double) as dti, case when try_cast(monthly_income as double) > 0 then try_cast(monthly_income as double) end as plain_income, case when try_cast(credit_score as int) between 300 and 900 then try_cast(credit_score as int) end as plain_score, case when try_cast(age as int) between 18 and 80 then try_cast(age as int) end as plain_age from w")
def q54_model_profiles(spark, sf_dir):
    fenced = F.concat(F.lit("```json\n"), F.expr(_ANSWER.replace("e.event_id", "id")), F.lit("\n```"))
    t = X.computed(table(spark, sf_dir, "events").select(F.col("event_id").alias("id")), "j", X.fenced_json(fenced))
    m, b = X.model_profile(F.col("j")), X.bounded_profile(F.col("j"))
    return t.select("id", m["monthly_income"].alias("income"), m["age"].alias("age"), m["credit_score"].alias("score"), m["employment_type"].alias("employment"), m["work_experience_months"].alias("experience"), m["dti_ratio"].alias("dti"), b["monthly_income"].alias("plain_income"), b["credit_score"].alias("plain_score"), b["age"].alias("plain_age"))
