"""Fields of uploaded documents (score reports, pay slips, statements, returns), as columns over their text.

Null in, null out. Ages and lengths of service that follow from a date are counted to a stated day. The fixed values are
the pattern tables and bounds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .extract import between, bound, distinct_words, first_pattern, found, number, whole

# What a document is, in order.
DOCUMENT_TYPES = (
    ("cibil_report", "cibil\\s*score|credit\\s*score|credit\\s*report|equifax|experian"),
    ("salary_slip", "salary\\s*slip|pay\\s*slip|payslip|pay\\s*stub|gross\\s*salary|net\\s*salary"),
    ("bank_statement", "bank\\s*statement|account\\s*statement|transaction|balance\\s*forward"),
    ("itr", "income\\s*tax\\s*return|itr|form\\s*16|assessment\\s*year|gross\\s*total\\s*income"),
    ("form_26as", "form\\s*26as|tds\\s*certificate"),
)
# Income patterns, how far each is trusted, and whether it is a yearly amount (L: in lakhs).
INCOMES = (
    ("(?:net\\s*(?:pay|salary|take.?home|amount\\s*payable))\\s*[:\\-]?\\s*₹?\\s*([\\d,]+(?:\\.\\d+)?)", 1.0, ""),
    ("salary\\s*(?:credited|received|paid|transferred)\\s*[:\\-]?\\s*₹?\\s*([\\d,]+(?:\\.\\d+)?)", 1.0, ""),
    ("(?:gross\\s*(?:pay|salary|earnings?))\\s*[:\\-]?\\s*₹?\\s*([\\d,]+(?:\\.\\d+)?)", 0.85, ""),
    ("(?:monthly\\s*(?:salary|income|earnings?))\\s*[:\\-]?\\s*₹?\\s*([\\d,]+(?:\\.\\d+)?)", 1.0, ""),
    ("(?:ctc|cost\\s*to\\s*company|annual\\s*(?:ctc|salary|income|package))\\s*[:\\-]?\\s*₹?\\s*([\\d,]+(?:\\.\\d+)?)", 0.7, "Y"),
    ("([\\d.]+)\\s*lpa\\b", 0.8, "L"),
    ("(?:total\\s*income|gross\\s*total\\s*income)\\s*[:\\-]?\\s*₹?\\s*([\\d,]+(?:\\.\\d+)?)", 0.7, "Y"),
)
SCORES = (
    "(?:cibil|credit|equifax|experian)\\s*score\\s*[:\\-]?\\s*(\\d{3})",
    "score\\s*[:\\-]?\\s*(\\d{3})\\s*(?:/\\s*900)?",
    "\\b([7-9]\\d{2})\\b.*?(?:cibil|credit|score)",
    "(?:cibil|credit|score)[^\\n]{0,30}?(\\d{3})",
)
AGES = ("(?:age|date\\s*of\\s*birth)[^\\n]{0,20}?(\\d{2})\\s*years?", "(\\d{2})\\s*years?\\s*(?:old|of\\s*age)")
BORN = "(?:dob|date\\s*of\\s*birth)\\s*[:\\-]?\\s*(\\d{1,2})[/\\-.](\\d{1,2})[/\\-.](\\d{4})"
EMPLOYMENT = (
    ("government", "\\bgovernment\\b|\\bpsu\\b|\\bpublic\\s*sector|\\bcivil\\s*servant|\\bcentral\\s*govt"),
    ("self_employed", "self.?employ|\\bpropriet|\\bpartner\\b|\\bpartnership|\\bllp\\b|\\bpvt\\s*ltd\\b|\\bprivate\\s*limited"),
    ("professional", "\\bdoctor\\b|\\bca\\b|\\bchartered\\s*accountant|\\badvocate\\b|\\blawyer\\b|\\bengineer\\b"),
    ("salaried", "\\bsalaried\\b|\\bemployee\\b|\\bpayslip\\b|\\bpay\\s*slip\\b|\\bcompany\\b|\\bemployer\\b"),
)
SERVICE = "(?:experience|tenure|service)\\s*[:\\-]?\\s*(\\d+)\\s*years?(?:\\s*(\\d+)\\s*months?)?"
SERVICE_YEARS = "(\\d+)\\s*years?\\s*(?:of\\s*)?(?:experience|service|employment)"
JOINED = "(?:joining|date\\s*of\\s*joining)\\s*[:\\-]?\\s*(\\d{1,2})[/\\-.](\\d{1,2})[/\\-.](\\d{4})"
NAMES = (
    "(?:name\\s*of\\s*(?:employee|applicant|customer|borrower))\\s*[:\\-]?\\s*([A-Z][A-Za-z\\s]{2,40})",
    "(?:employee\\s*name|customer\\s*name)\\s*[:\\-]?\\s*([A-Z][A-Za-z\\s]{2,40})",
    "(?:dear|to)\\s*(?:mr\\.?|mrs\\.?|ms\\.?|dr\\.?)?\\s*([A-Z][A-Za-z\\s]{2,30})",
)
EMPLOYERS = (
    "(?:employer|company|organisation|organization)\\s*(?:name)?\\s*[:\\-]?\\s*([A-Z][A-Za-z0-9\\s&.,]{2,60})",
    "(?:paid\\s*by|issued\\s*by|from)\\s*[:\\-]?\\s*([A-Z][A-Za-z0-9\\s&.,]{2,60})",
)
LOANS = ("(?:loan\\s*(?:amount|requested|applied))\\s*[:\\-]?\\s*₹?\\s*([\\d,]+(?:\\.\\d+)?)", "(?:borrow|disburse|sanction)\\s*(?:amount)?\\s*[:\\-]?\\s*₹?\\s*([\\d,]+(?:\\.\\d+)?)")
BALANCES = ("(?:closing\\s*balance|available\\s*balance|current\\s*balance)\\s*[:\\-]?\\s*₹?\\s*([\\d,]+(?:\\.\\d+)?)", "(?:balance\\s*as\\s*on|balance\\s*forward)\\s*[:\\-]?\\s*₹?\\s*([\\d,]+(?:\\.\\d+)?)")
RATIO = "(?:dti|debt.to.income|emi.to.income)\\s*(?:ratio)?\\s*[:\\-]?\\s*([\\d.]+)\\s*%?"
#: The words that end every query built from a document.
TAIL = "personal loan eligibility criteria requirements"


def document_type(t: Column) -> Column:
    return first_pattern(t, DOCUMENT_TYPES, "unknown")


def income(t: Column) -> Column:
    """Monthly income from the most trusted pattern that gives a plausible amount anywhere; the first of equals."""

    def read(pattern: str, kind: str) -> Column:
        every = F.transform(F.regexp_extract_all(t, F.lit("(?i)" + pattern), F.lit(1)), lambda x: F.regexp_replace(x, ",", "").try_cast("double"))
        monthly = {"": lambda x: x, "L": lambda x: x * 100000 / 12, "Y": lambda x: F.when(x > 5e5, x / 12).otherwise(x)}[kind]
        return F.get(F.filter(F.transform(every, monthly), lambda x: (x >= 3e3) & (x <= 1e7)), F.lit(0))

    return F.round(F.coalesce(*[read(p, kind) for p, _, kind in sorted(INCOMES, key=lambda x: -x[1])]), 2)


def score(t: Column) -> Column:
    return F.coalesce(*[between(found(t, p).try_cast("int"), 300, 900) for p in SCORES])


def _date(t: Column, pattern: str) -> Column:
    day, month, year = (found(t, pattern, g).try_cast("int") for g in (1, 2, 3))
    return F.try_to_date(F.concat_ws("-", year.cast("string"), month.cast("string"), day.cast("string")), "y-M-d")


def _days(t: Column, pattern: str, as_of: str) -> Column:
    return F.date_diff(F.lit(as_of).cast("date"), _date(t, pattern))


def age(t: Column, as_of: str) -> Column:
    """Years that are told, else from a date of birth (days by 365)."""
    told = [found(t, p).try_cast("int") for p in AGES]
    return F.coalesce(*[between(x, 18, 80) for x in (*told, F.floor(_days(t, BORN, as_of) / 365).cast("int"))])


def employment(t: Column) -> Column:
    return first_pattern(t, EMPLOYMENT)


def experience_months(t: Column, as_of: str) -> Column:
    """Years and months of service that are told, else months since joining (days by 30)."""
    years, months = found(t, SERVICE).try_cast("int"), F.coalesce(found(t, SERVICE, 2).try_cast("int"), F.lit(0))
    joined = F.floor(_days(t, JOINED, as_of) / 30).cast("int")
    plausible = lambda v: F.when((v > 0) & (v < 600), v)
    return F.coalesce(*[bound(x, plausible) for x in (years * 12 + months, found(t, SERVICE_YEARS).try_cast("int") * 12, joined)])


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, "^\\s+|\\s+$", "")


def name(t: Column) -> Column:
    """Two words at least; the pattern reads any case, so that other words may pass for a name."""
    fits = lambda x: F.when((F.regexp_count(x, F.lit("\\S+")) >= 2) & (F.length(x) <= 50), x)
    return F.coalesce(*[bound(_stripped(found(t, p)), fits) for p in NAMES])


def employer(t: Column) -> Column:
    sensitive = lambda p: bound(F.regexp_extract(t, p, 1), lambda x: F.when(x != "", x))
    fits = lambda x: F.when((F.length(x) >= 3) & (F.length(x) <= 60), x)
    return F.coalesce(*[bound(F.regexp_replace(_stripped(sensitive(p)), "[.,]+$", ""), fits) for p in EMPLOYERS])


def pan_masked(t: Column) -> Column:
    pan = F.regexp_extract(t, "\\b([A-Z]{5}[0-9]{4}[A-Z])\\b", 1)
    return bound(pan, lambda x: F.when(x != "", F.concat(F.substring(x, 1, 5), F.lit("****"), F.substring(x, 10, 1))))


def loan_amount(t: Column) -> Column:
    return F.coalesce(*[between(number(t, p), 1e3, 1e9) for p in LOANS])


def balance(t: Column) -> Column:
    return F.coalesce(*[number(t, p) for p in BALANCES])


def ratio(t: Column) -> Column:
    x = bound(found(t, RATIO).try_cast("double"), lambda v: F.when(v > 1.5, v / 100).otherwise(v))
    return bound(x, lambda v: F.when((v > 0) & (v < 1), v))


def fields(t: Column, as_of: str) -> dict[str, Column]:
    """Everything that is read of a document, and the share of its four core fields that was found."""
    core = {"monthly_income": income(t), "credit_score": score(t), "age": age(t, as_of), "employment_type": employment(t)}
    return core | {
        "annual_income": F.round(core["monthly_income"] * 12, 2),
        "work_experience_months": experience_months(t, as_of),
        "name": name(t), "employer_name": employer(t), "pan_number": pan_masked(t),
        "loan_amount_requested": loan_amount(t), "bank_balance": balance(t), "dti_ratio": ratio(t),
        "document_type": document_type(t), "extraction_confidence": extraction_confidence(*core.values()),
    }


def extraction_confidence(*core: Column) -> Column:
    return F.round(sum((c.isNotNull().cast("int") for c in core), F.lit(0)) / len(core), 2)


def with_tables(text: Column, told: Column) -> Column:
    """A document's text, then its tables' sentences under a mark, as the extractors read them."""
    return F.when(F.size(told) > 0, F.concat(text, F.lit("\n[TABLE DATA]\n"), F.array_join(told, "\n"))).otherwise(text)


def retrieval_query(asked: Column, profile: dict[str, Column], kind: Column) -> Column:
    """The applicant's own words with what the document adds, without repeats."""
    parts = [
        bound(F.trim(asked), lambda x: F.when(x != "", x)),
        F.when(kind != "unknown", F.concat(F.lit("document: "), F.replace(kind, F.lit("_"), F.lit(" ")))),
        F.concat(F.lit("salary "), whole(profile["monthly_income"]), F.lit(" monthly income")),
        F.concat(F.lit("CIBIL credit score "), profile["credit_score"].cast("string")),
        profile["employment_type"],
        F.concat(F.lit("age "), profile["age"].cast("string")),
        F.lit(TAIL),
    ]
    return distinct_words(F.concat_ws(" ", *parts))
