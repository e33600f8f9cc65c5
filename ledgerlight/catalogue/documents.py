"""Queries over uploaded documents, their tables, and scraped records, written from the tables of the test data.

The SQL states its patterns itself, so that it checks those of the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import uploads as U
from ..operators import records as R
from ..plans.spread import dealt
from . import cases
from .registry import query, table
from .texts import _first, _got, _int, _num, _once, _within

_TEXT = cases.pick(cases.UPLOADED, "c_custkey").replace("\n", "' || chr(10) || '")
_U = f"with q as (select c_custkey as id, {_TEXT} as s from customer) "
AS_OF = "2026-01-01"


def _uploaded(spark, sf_dir):
    return dealt(table(spark, sf_dir, "customer").select("c_custkey")).select(F.col("c_custkey").alias("id"), F.explode(F.array(F.expr(_TEXT))).alias("s"))


_TYPE = _first("s", {
    "cibil_report": r"cibil\s*score|credit\s*score|credit\s*report|equifax|experian",
    "salary_slip": r"salary\s*slip|pay\s*slip|payslip|pay\s*stub|gross\s*salary|net\s*salary",
    "bank_statement": r"bank\s*statement|account\s*statement|transaction|balance\s*forward",
    "itr": r"income\s*tax\s*return|itr|form\s*16|assessment\s*year|gross\s*total\s*income",
    "form_26as": r"form\s*26as|tds\s*certificate",
}, "'unknown'")
_SUM = r"\s*[:\-]?\s*₹?\s*([\d,]+(?:\.\d+)?)"


def _amount(pattern: str, monthly: str = "x") -> str:
    """The first plausible monthly amount among all matches."""
    every = f"list_transform(regexp_extract_all(s, '(?i){pattern}', 1), lambda x: try_cast(replace(x, ',', '') as double))"
    return f"list_filter(list_transform({every}, lambda x: {monthly}), lambda x: x between 3e3 and 1e7)[1]"


_YEARLY = "case when x > 5e5 then x / 12 else x end"
_INCOME = "round(coalesce(" + ", ".join((
    _amount(r"(?:net\s*(?:pay|salary|take.?home|amount\s*payable))" + _SUM),
    _amount(r"salary\s*(?:credited|received|paid|transferred)" + _SUM),
    _amount(r"(?:monthly\s*(?:salary|income|earnings?))" + _SUM),
    _amount(r"(?:gross\s*(?:pay|salary|earnings?))" + _SUM),
    _amount(r"([\d.]+)\s*lpa\b", "x * 100000 / 12"),
    _amount(r"(?:ctc|cost\s*to\s*company|annual\s*(?:ctc|salary|income|package))" + _SUM, _YEARLY),
    _amount(r"(?:total\s*income|gross\s*total\s*income)" + _SUM, _YEARLY),
)) + "), 2)"
_SCORE = "coalesce(" + ", ".join(_within(_int("s", p), "300", "900") for p in (
    r"(?:cibil|credit|equifax|experian)\s*score\s*[:\-]?\s*(\d{3})", r"score\s*[:\-]?\s*(\d{3})\s*(?:/\s*900)?", r"\b([7-9]\d{2})\b.*?(?:cibil|credit|score)", r"(?:cibil|credit|score)[^\n]{0,30}?(\d{3})",
)) + ")"


def _since(pattern: str) -> str:
    day = f"try_cast({_got('s', pattern, 3)} || '-' || {_got('s', pattern, 2)} || '-' || {_got('s', pattern, 1)} as date)"
    return f"date_diff('day', {day}, date '{AS_OF}')"


_BORN = f"cast(floor({_since(r'(?:dob|date\s*of\s*birth)\s*[:\-]?\s*(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})')} / 365) as int)"
_AGE = "coalesce(" + ", ".join(_within(x, "18", "80") for x in (_int("s", r"(?:age|date\s*of\s*birth)[^\n]{0,20}?(\d{2})\s*years?"), _int("s", r"(\d{2})\s*years?\s*(?:old|of\s*age)"), _BORN)) + ")"
_EMPLOYMENT = _first("s", {
    "government": r"\bgovernment\b|\bpsu\b|\bpublic\s*sector|\bcivil\s*servant|\bcentral\s*govt",
    "self_employed": r"self.?employ|\bpropriet|\bpartner\b|\bpartnership|\bllp\b|\bpvt\s*ltd\b|\bprivate\s*limited",
    "professional": r"\bdoctor\b|\bca\b|\bchartered\s*accountant|\badvocate\b|\blawyer\b|\bengineer\b",
    "salaried": r"\bsalaried\b|\bemployee\b|\bpayslip\b|\bpay\s*slip\b|\bcompany\b|\bemployer\b",
})
_SERVICE = r"(?:experience|tenure|service)\s*[:\-]?\s*(\d+)\s*years?(?:\s*(\d+)\s*months?)?"
_MONTHS = "coalesce(" + ", ".join(f"case when {x} > 0 and {x} < 600 then {x} end" for x in (
    f"({_int('s', _SERVICE)} * 12 + coalesce({_int('s', _SERVICE, 2)}, 0))", f"({_int('s', r'(\d+)\s*years?\s*(?:of\s*)?(?:experience|service|employment)')} * 12)", f"cast(floor({_since(r'(?:joining|date\s*of\s*joining)\s*[:\-]?\s*(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})')} / 30) as int)",
)) + ")"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


_NAME = "coalesce(" + ", ".join(rf"case when len(regexp_extract_all({x}, '\S+')) >= 2 and length({x}) <= 50 then {x} end" for x in (_strip(_got("s", p)) for p in (
    r"(?:name\s*of\s*(?:employee|applicant|customer|borrower))\s*[:\-]?\s*([A-Z][A-Za-z\s]{2,40})", r"(?:employee\s*name|customer\s*name)\s*[:\-]?\s*([A-Z][A-Za-z\s]{2,40})", r"(?:dear|to)\s*(?:mr\.?|mrs\.?|ms\.?|dr\.?)?\s*([A-Z][A-Za-z\s]{2,30})",
))) + ")"
_EMPLOYER = "coalesce(" + ", ".join(f"case when length({x}) between 3 and 60 then {x} end" for x in (f"regexp_replace({_strip(f"nullif(regexp_extract(s, '{p}', 1), '')")}, '[.,]+$', '')" for p in (
    r"(?:employer|company|organisation|organization)\s*(?:name)?\s*[:\-]?\s*([A-Z][A-Za-z0-9\s&.,]{2,60})", r"(?:paid\s*by|issued\s*by|from)\s*[:\-]?\s*([A-Z][A-Za-z0-9\s&.,]{2,60})",
))) + ")"
_PAN = r"nullif(regexp_extract(s, '\b([A-Z]{5}[0-9]{4}[A-Z])\b', 1), '')"
_LOAN = "coalesce(" + ", ".join(_within(_num("s", p + _SUM), "1e3", "1e9") for p in (r"(?:loan\s*(?:amount|requested|applied))", r"(?:borrow|disburse|sanction)\s*(?:amount)?")) + ")"
_BALANCE = "coalesce(" + ", ".join(_num("s", p + _SUM) for p in (r"(?:closing\s*balance|available\s*balance|current\s*balance)", r"(?:balance\s*as\s*on|balance\s*forward)")) + ")"
_RATIO = f"try_cast({_got('s', r'(?:dti|debt.to.income|emi.to.income)\s*(?:ratio)?\s*[:\-]?\s*([\d.]+)\s*%?')} as double)"
_RATIO = f"(case when {_RATIO} > 1.5 then {_RATIO} / 100 else {_RATIO} end)"
_READ = _U + f", f as (select id, s, {_TYPE} as kind, {_INCOME} as income, {_SCORE} as score, {_AGE} as age, {_EMPLOYMENT} as employment, {_MONTHS} as months, {_NAME} as name, {_EMPLOYER} as employer, substr({_PAN}, 1, 5) || '****' || substr({_PAN}, 10, 1) as pan, {_LOAN} as loan, {_BALANCE} as balance, case when {_RATIO} > 0 and {_RATIO} < 1 then {_RATIO} end as ratio from q), g as (select *, round((cast(income is not null as int) + cast(score is not null as int) + cast(age is not null as int) + cast(employment is not null as int)) / 4e0, 2) as confidence from f) "


@query(_READ + "select id, kind, income, round(income * 12, 2) as annual, score, age, employment, months, name, employer, pan, loan, balance, ratio, confidence from g")
def q55_document_fields(spark, sf_dir):
    names = {"kind": "document_type", "income": "monthly_income", "annual": "annual_income", "score": "credit_score", "age": "age", "employment": "employment_type", "months": "work_experience_months", "name": "name", "employer": "employer_name", "pan": "pan_number", "loan": "loan_amount_requested", "balance": "bank_balance", "ratio": "dti_ratio", "confidence": "extraction_confidence"}
    f = U.fields(F.col("s"), AS_OF)
    return _uploaded(spark, sf_dir).select("id", *[f[v].alias(k) for k, v in names.items()])


@query(_READ + "select kind, count(*) as n, round(avg(confidence), 6) as confidence from g group by 1")
def q56_document_confidence(spark, sf_dir):
    f = U.fields(F.col("s"), AS_OF)
    d = _uploaded(spark, sf_dir).select(f["document_type"].alias("kind"), f["extraction_confidence"].alias("c"))
    return d.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("confidence"))


_ASKS = "case id % 3 when 0 then '' when 1 then 'can I get a Personal loan ' else ' salary is fine ' end"


@query(_READ + f"select id, {_once(f"concat_ws(' ', nullif(trim({_ASKS}), ''), case when kind <> 'unknown' then 'document: ' || replace(kind, '_', ' ') end, case when income is not null then 'salary ' || printf('%.0f', income) || ' monthly income' end, 'CIBIL credit score ' || score, employment, 'age ' || age, 'personal loan eligibility criteria requirements')")} as query from g")
def q5a_document_query(spark, sf_dir):
    f = U.fields(F.col("s"), AS_OF)
    return _uploaded(spark, sf_dir).select("id", U.retrieval_query(F.expr(_ASKS), f, f["document_type"]).alias("query"))


# ---- tables

#: A table for every five parts: named or numbered columns, two or three of them, with cells that stand for nothing.
_ID, _K = "cast(floor(p_partkey / 5) as bigint)", "cast(p_partkey % 5 + 1 as int)"
_CELL = f"case when {_K} = 4 then ' - ' when p_partkey % 11 = 0 then 'NaN' else ' n  ' || p_partkey end"
_LINES = f"with l as (select {_ID} as id, {_K} as k, {_CELL} as a, cast(p_size as varchar) || '%' as b, p_brand as c, {_ID} % 3 as kind from part), z as (select *, case when lower(regexp_replace(trim(a), '\\s+', ' ', 'g')) in ('nan', 'none', '-') then '' else regexp_replace(trim(a), '\\s+', ' ', 'g') end as x from l) "


def _tables(spark, sf_dir):
    l = table(spark, sf_dir, "part").select(F.expr(_ID).alias("id"), F.expr(_K).alias("k"), F.expr(_CELL).alias("a"), F.concat(F.col("p_size").cast("string"), F.lit("%")).alias("b"), F.col("p_brand").alias("c"))
    rows = l.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "a", "b", "c"))).alias("r"))
    kind = F.col("id") % 3
    cells = F.when(kind == 0, F.transform("r", lambda r: F.array(r["a"], r["b"]))).otherwise(F.transform("r", lambda r: F.array(r["a"], r["b"], r["c"])))
    words = lambda *x: F.array(*map(F.lit, x))
    heads = F.when(kind == 0, words("Name", " Share ")).when(kind == 1, words("Name", "", "Flag")).otherwise(words("0", "1", "Unnamed: 2"))
    return rows.select("id", T.promoted(heads, cells).alias("t")).select("id", "t.headers", "t.rows")


@query(_LINES + f""", h as (select id, kind, arg_min(x, k) as h1, arg_min(b, k) as h2, arg_min(c, k) as h3, min(k) as first from z group by 1, 2),
e as (select z.id, z.k, case z.kind when 0 then case when x <> '' then x || ': ' || b || '.' end when 1 then 'For this entry: ' || concat_ws(', ', case when x <> '' then 'Name is ' || x end, b, 'Flag is ' || c) || '.'
 else 'For this entry: ' || concat_ws(', ', case when x <> '' and h1 <> '' then h1 || ' is ' || x when x <> '' then x end, h2 || ' is ' || b, h3 || ' is ' || c) || '.' end as say,
 case z.kind when 0 then case when x <> '' then x || ': ' || b || '.' end when 1 then concat_ws(' | ', case when x <> '' then 'Name: ' || x end, 'Flag: ' || c) || '.' else concat_ws(' | ', case when x <> '' and h1 <> '' then h1 || ': ' || x end, h2 || ': ' || b, h3 || ': ' || c) || '.' end as up
 from z join h using (id) where z.kind < 2 or z.k > first)
select h.id, coalesce(string_agg(say, ' ' order by k), '') as told, coalesce(string_agg(up, ' ' order by k), '') as uploaded from h left join e on e.id = h.id group by 1""")
def q61_table_sentences(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return t.select("id", F.array_join(T.sentences(F.col("headers"), F.col("rows")), " ").alias("told"), F.array_join(T.upload_sentences(F.col("headers"), F.col("rows")), " ").alias("uploaded"))


@query("""with l as (select cast(floor(p_partkey / 5) as bigint) as id, cast(p_partkey % 5 + 1 as int) as k, p_brand as a, cast(p_size as varchar) as b, p_type as c from part), h as (select id, arg_min(a, k) as ha, arg_min(b, k) as hb, arg_min(c, k) as hc, min(k) as first, count(*) as n from l group by 1)
select id, string_agg(case when n > 1 and l.k % 3 <> 0 then ha || ': ' || a || ' | ' || hb || ': ' || b || ' | ' || hc || ': ' || c when l.k % 3 = 0 then a || ': ' || b else a || ' | ' || b || ' | ' || c end, ' ' order by l.k) as told from l join h using (id) where n = 1 or l.k > first group by 1""")
def q6a_page_table_sentences(spark, sf_dir):
    l = table(spark, sf_dir, "part").select(F.expr(_ID).alias("id"), F.expr(_K).alias("k"), F.col("p_brand").alias("a"), F.col("p_size").cast("string").alias("b"), F.col("p_type").alias("c"))
    row = F.when(F.col("k") % 3 == 0, F.array("a", "b")).otherwise(F.array("a", "b", "c"))
    g = l.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", row.alias("r")))).alias("rs"))
    return g.select("id", F.array_join(T.page_sentences(F.transform("rs", lambda x: x["r"])), " ").alias("told"))


# ---- records

#: A scraped record for each part: scalars that both engines read alike.
_REC = """select p_partkey as id, case p_partkey % 7 when 0 then 'Axis Bank' when 1 then 'HDFC Bank' when 2 then 'onlinesbi' when 3 then 'BankBazaar' when 4 then '' else 'bank' || (p_partkey % 7) end as bank, case when p_partkey % 9 = 0 then 'home' else 'personal' end as loan_type,
 case when p_partkey % 50 = 0 then '' else 'https://h' || (p_partkey % 5) || '.example/p' || (p_partkey % 400) end as source_url, case when p_partkey % 4 = 0 then null else cast(floor(p_retailprice) as double) / 100 - 8 end as rate_low, case when p_partkey % 4 = 0 then null else cast(floor(p_retailprice / 1.5) as double) / 100 end as rate_high,
 case when p_partkey % 3 = 0 then null else cast(floor(p_retailprice * (p_partkey % 40)) as double) end as min_income, case when p_partkey % 5 = 0 then null else cast(250 + p_partkey % 700 as int) end as min_cibil, case when p_partkey % 6 = 0 then '' else repeat(p_name || ' ', 1 + cast(p_partkey % 15 as int)) end as content,
 case when p_partkey % 8 = 0 then null else cast(15 + p_partkey % 30 as int) end as age_low, cast(30 + p_partkey % 60 as int) as age_high, cast(p_partkey * 37 % 90000 - 2000 as double) as amount_low, cast(p_partkey * 91 % 400000 as double) as amount_high, cast(p_partkey % 50 as int) as tenure_low, cast(p_partkey % 420 as int) as tenure_high,
 case when p_partkey % 4 = 1 then cast(p_partkey % 200000 as double) end as processing_fee, case when p_partkey % 4 > 1 then (p_partkey % 130) / 10e0 end as processing_fee_pct, (p_partkey % 110) / 10e0 as foreclosure_fee, cast(p_partkey % 30 as int) as min_experience, (p_partkey % 12) / 10e0 as given from part"""


def _records(spark, sf_dir):
    r = spark.sql(_REC.replace("from part", "from {part}"), part=table(spark, sf_dir, "part"))
    pair = lambda a, b: F.when(F.col(a).isNotNull(), F.array(a, b)).otherwise(F.array().cast("array<double>" if "age" not in a and "tenure" not in a else "array<int>"))
    words = F.when(F.col("id") % 2 == 0, F.array(F.lit("salaried"), F.lit("nri"))).otherwise(F.array().cast("array<string>"))
    features = F.when(F.col("id") % 3 == 1, F.array(F.lit(" Quick approval.."), F.lit(" "), F.concat(F.lit("Offer "), F.col("id").cast("string")))).otherwise(F.array().cast("array<string>"))
    return r.withColumns({"interest_rate": pair("rate_low", "rate_high"), "age_range": pair("age_low", "age_high"), "loan_amount": pair("amount_low", "amount_high"), "tenure": pair("tenure_low", "tenure_high"), "confidence": F.col("given"), "employment_type": words, "features": features})


_R = f"with rec as ({_REC}) "
_OUT = lambda f, x, low, high: f"case when {x} not between {low} and {high} then '{f}=' || {x} || ' outside [{low}, {high}]' end"
_PAIRS = (("interest_rate", "rate", "0.5", "50.0"), ("loan_amount", "amount", "1000", "1000000000"), ("age_range", "age", "18", "80"), ("tenure", "tenure", "1", "360"))
_KNOWN = {"rate": "rate_low is not null", "amount": "true", "age": "age_low is not null", "tenure": "true"}
_ISSUES = "list_filter([" + ", ".join([
    "case when bank = '' then 'Missing required field: bank' end", "case when source_url = '' then 'Missing required field: source_url' end", "case when content = '' then 'Missing required field: content' end",
    "case when content <> '' and length(trim(content)) < 50 then 'Content too short (' || length(content) || ' chars) — likely failed extraction' end",
    _OUT("processing_fee", "processing_fee", 0, 100000), _OUT("processing_fee_pct", "processing_fee_pct", 0, 10), _OUT("foreclosure_fee", "foreclosure_fee", 0, 10), _OUT("min_income", "min_income", 5000, 50000000), _OUT("confidence", "given", 0.0, 1.0),
    "case when min_cibil not between 300 and 900 then 'min_cibil=' || min_cibil || ' outside [300,900]' end",
    *[f"case when {_KNOWN[s]} and {s}_low not between {a} and {z} then '{f} value ' || {s}_low || ' outside [{a}, {z}]' when {_KNOWN[s]} and {s}_high not between {a} and {z} then '{f} value ' || {s}_high || ' outside [{a}, {z}]' end" for f, s, a, z in _PAIRS],
    *[f"case when {_KNOWN[s]} and {s}_low > {s}_high then '{f}: min (' || {s}_low || ') > max (' || {s}_high || ') — swapping' end" for f, s, _, _ in _PAIRS],
    *[f"case when {_KNOWN[s]} and least({s}_low, {s}_high) < 0 then 'Negative value in {f}' end" for f, s, _, _ in _PAIRS if s != "age"],
]) + "], lambda x: x is not null)"
_USUAL = "case when contains(lower(bank), 'axis bank') then 'Axis' when contains(lower(bank), 'hdfc bank') then 'HDFC' when contains(lower(bank), 'sbi') then 'SBI' when contains(lower(bank), 'bankbazaar') then 'BankBazaar' else bank end"


@query(_R + f"select id, {_USUAL} as bank, bank <> '' and source_url <> '' and content <> '' and length(trim(content)) >= 50 as valid, case when min_cibil between 300 and 900 then min_cibil end as min_cibil, case when rate_low is null then '' else array_to_string(list_filter([least(rate_low, rate_high), greatest(rate_low, rate_high)], lambda x: x >= 0), ',') end as rates, array_to_string(list_filter([least(amount_low, amount_high), greatest(amount_low, amount_high)], lambda x: x >= 0), ',') as amounts, array_to_string({_ISSUES}, ';') as issues from rec")
def q57_record_validation(spark, sf_dir):
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return R.validated(_records(spark, sf_dir)).select("id", "bank", "valid", "min_cibil", joined("interest_rate").alias("rates"), joined("loan_amount").alias("amounts"), F.array_join("issues", ";").alias("issues"))


_FILLED = "round_even((cast(rate_low is not null as int) + cast(age_low is not null as int) + 2 + cast(id % 3 = 1 as int) + cast(coalesce(min_income, 0) <> 0 as int) + cast(min_cibil is not null as int) + cast(length(content) > 200 as int)) / 8e0, 2)"


@query(_R + f" select bank, count(*) as n, count(rate_low) as has_rate, count_if(min_income > 0) as has_income, count(min_cibil) as has_cibil, round(avg({_FILLED}), 6) as avg_confidence, count(distinct source_url) as urls from rec group by bank")
def q58_scrape_summary(spark, sf_dir):
    return R.summary(_records(spark, sf_dir))


@query(_R + ", h as (select *, substr(sha256(content), 1, 16) as hash from rec) select id from (select id, row_number() over (partition by hash order by id) as a, row_number() over (partition by source_url order by id) as b from h where length(content) > 0) where a = 1 and b = 1")
def q59_record_distinct(spark, sf_dir):
    return R.distinct_records(_records(spark, sf_dir).filter("length(content) > 0")).select("id")


_SENTENCES = """concat_ws(' ', case when bank <> '' then bank || ' ' || loan_type || ' loan.' end, case when rate_low is not null then 'Interest rate: ' || printf('%.2f', rate_low) || '% to ' || printf('%.2f', rate_high) || '% per annum.' end,
 'Loan amount: ₹' || format('{:,.0f}', amount_low) || ' to ₹' || format('{:,.0f}', amount_high) || '.', 'Tenure: ' || tenure_low || ' to ' || tenure_high || ' months.', case when min_income <> 0 then 'Minimum monthly income: ₹' || format('{:,.0f}', min_income) || '.' end,
 case when age_low is not null then 'Age requirement: ' || age_low || ' to ' || age_high || ' years.' end, case when id % 2 = 0 then 'Eligible employment types: salaried, nri.' end, 'Minimum CIBIL score: ' || min_cibil || '.',
 case when processing_fee is not null then 'Processing fee: ₹' || format('{:,.0f}', processing_fee) || '.' when processing_fee_pct is not null then 'Processing fee: ' || printf('%.2f', processing_fee_pct) || '% of loan amount.' end, case when min_experience <> 0 then 'Minimum work experience: ' || min_experience || ' months.' end,
 case when id % 3 = 1 then 'Quick approval. Offer ' || id || '.' end, case when length(content) > 100 then substr(content, 1, 800) end)"""


@query(_R + rf" select id, regexp_replace(concat_ws('_', nullif(replace(lower(bank), ' ', '_'), ''), loan_type, substr(md5(source_url), 1, 8)), '[^A-Za-z0-9_-]', '_', 'g') as slug, {_SENTENCES} as rag from rec")
def q60_record_text(spark, sf_dir):
    return _records(spark, sf_dir).select("id", R.slug().alias("slug"), R.rag_text().alias("rag"))


@query(_R + f""", o as (select bank, {_FILLED} as c, row_number() over (partition by bank order by id) as k from rec)
, fold as (select * from (with recursive w as (select bank, cast(0 as bigint) as k, 0e0 as m from (select distinct bank from o) union all select w.bank, w.k + 1, round_even((w.m * w.k + o.c) / (w.k + 1), 2) from w join o on o.bank = w.bank and o.k = w.k + 1) select bank, arg_max(m, k) as running from w group by bank)) select * from fold""")
def q62_running_confidence(spark, sf_dir):
    return R.running_confidence(_records(spark, sf_dir), "id")


@query(_R + """, h as (select *, substr(sha256(content), 1, 16) as hash from rec), s as (select hash, source_url from h where loan_type = 'home') select id from h where loan_type <> 'home' and hash not in (select hash from s) and source_url not in (select source_url from s)""")
def q63_record_unseen(spark, sf_dir):
    h = _records(spark, sf_dir).withColumn("content_hash", F.substring(F.sha2("content", 256), 1, 16))
    return R.unseen(h.filter("loan_type <> 'home'"), h.filter("loan_type = 'home'").select("content_hash", "source_url")).select("id")


@query("select source, cast(sum(length(text)) as bigint) as total_chars, count(distinct substr(md5(text), 1, 12)) as chunk_hashes, count(distinct substr(sha256(text), 1, 16)) as file_hashes from documents group by source")
def q64_sizes_and_hashes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.sum(F.length("text")).alias("total_chars"), F.countDistinct(F.substring(F.md5("text"), 1, 12)).alias("chunk_hashes"), F.countDistinct(F.substring(F.sha2("text", 256), 1, 16)).alias("file_hashes"))
