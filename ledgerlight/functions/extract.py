"""Typed signals from free text, as columns: applicants' queries and the values that pages write.

Every function takes and returns columns; null in, null out. Patterns are searched without regard to case, and where one
is searched for a value the first match decides: if that is out of bounds, a later match is not tried. The fixed values
are the pattern tables and bounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row, however many others are made of it. A plain projection would be
    folded into each of them."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def bound(value: Column, fn) -> Column:
    """fn of value, which is computed once, however often fn names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def whole(x: Column) -> Column:
    """A number without decimals, as text; halves to even."""
    return bound(x, lambda v: F.when(v.isNotNull(), F.format_string("%.0f", F.rint(v))))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null without one. Bound, as a value that is named twice in a branch is read twice,
    and values are found in what was found: without it a row would cost some power of two of searches."""
    return bound(F.regexp_extract(text, "(?i)" + pattern, group), lambda x: F.when(x != "", x))


def number(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match as a number; commas are ignored."""
    return F.replace(found(text, pattern, group), F.lit(","), F.lit("")).try_cast("double")


def told(text: Column, pattern: str, read, group: int = 1) -> Column:
    """What read makes of the group of the first match; null without one."""
    return bound(found(text, pattern, group), lambda x: F.when(x.isNotNull(), read(x)))


def between(x: Column, low: float, high: float) -> Column:
    return bound(x, lambda v: F.when((v >= low) & (v <= high), v))


def says(text: Column, pattern: str) -> Column:
    return text.rlike("(?i)" + pattern)


def first_pattern(text: Column, table, default: str | None = None) -> Column:
    """The name of the first pattern of (name, pattern) that text holds."""
    out = F.lit(default)
    for name, pattern in reversed(table):
        out = F.when(says(text, pattern), F.lit(name)).otherwise(out)
    return out


def first_phrase(text: Column, table, default: str | None = None) -> Column:
    """The name of the first phrase of (phrase, name) that lower-cased text contains."""

    def first(t: Column) -> Column:
        out = F.lit(default)
        for phrase, name in reversed(table):
            out = F.when(F.contains(t, F.lit(phrase)), F.lit(name)).otherwise(out)
        return out

    return bound(F.lower(text), first)


def distinct_words(text: Column) -> Column:
    """Words in order, each once up to case, in its first spelling."""
    words = F.filter(F.split(text, "\\s+"), lambda x: x != "")
    first = lambda w, lower: F.array_join(F.filter(w, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1), " ")
    return bound(words, lambda w: bound(F.transform(w, F.lower), lambda lower: first(w, lower)))


# Informal words and what stands in for them, in the order in which they are replaced.
SLANG = (
    ("\\bmil\\s+jayega\\b", "will i get"),
    ("\\bmil\\s+sakta\\s+hai\\b", "can i get"),
    ("\\bmil\\s+sakta\\b", "can i get"),
    ("\\bkya\\s+loan\\b", "can i get loan"),
    ("\\bloan\\s+milega\\b", "will i get loan"),
    ("\\bkya\\b", ""),
    ("\\bpe\\b", "for"),
    ("\\bke\\s+liye\\b", "for"),
    ("\\bjaldi\\b", "fast urgent"),
    ("\\bkaun\\s*sa\\b", "which"),
    ("\\bkitna\\b", "how much"),
    ("\\bsaal\\b", "years"),
    ("\\brupaye\\b", "rupees"),
    ("\\bnahi\\b", "no"),
    ("\\bhoga\\b", "will be"),
    ("\\bbro\\b", ""),
    ("\\byaar\\b", ""),
    ("\\bdude\\b", ""),
)
# The wording for a language model differs from SLANG in these; None is left alone.
SLANG_FOR_MODELS = {"\\bjaldi\\b": "fast", "\\brupaye\\b": None}
# Phrases that name a lender, and loans, in order.
LENDERS = (("axis", "Axis"), ("hdfc", "HDFC"), ("icici", "ICICI"), ("sbi", "SBI"), ("state bank", "SBI"))
LOANS = (("personal loan", "personal"), ("home loan", "home"), ("housing loan", "home"), ("car loan", "car"), ("auto loan", "car"), ("business loan", "business"), ("education loan", "education"), ("gold loan", "gold"))
# What an intent sounds like, in the order that decides ties.
INTENTS = (
    ("eligibility", "\\beligib|\\bqualif|\\bcan i\\b|\\bam i\\b|\\bwill i\\b|\\bdo i qualify|\\bapply\\b|\\bget a loan\\b|\\bget approved\\b|\\bapproved\\b|\\bneed.*loan\\b|\\bwant.*loan\\b|\\bget.*loan\\b|\\bwhat to do\\b|\\burgent.*loan\\b|\\bloan.*urgent\\b"),
    ("interest_rate", "\\binterest rate|\\broi\\b|\\brate of interest|\\b% p\\.?a|\\bemi\\b|\\binstalment\\b|\\bminimum (?:salary|income|cibil|age|score)\\b|\\bwhat (?:is|are) (?:the )?(?:minimum|maximum|requirement)"),
    ("comparison", "\\bcompare|\\bvs\\.?\\b|\\bbetter\\b|\\bbest\\b|\\bwhich bank|\\bhighest|\\blowest\\b|\\bfastest\\b|\\bsafest\\b|\\bcheapest\\b|\\beasiest\\b|\\bquickest\\b"),
    ("fees", "\\bfee|\\bcharge|\\bpenalty|\\bprocessing fee|\\bforeclos|\\bprepay"),
    ("document", "\\bdocument|\\bkyc\\b|\\bpapers?\\b|\\bsubmit\\b|\\brequired.*doc|\\bdoc.*required|\\bpan(?:\\s*card)?\\b|\\baadhaar\\b|\\bproof\\b|\\bsalary\\s*slip\\b|\\bitr\\b|\\bbank\\s*statement\\b|\\bpassport\\b|\\bform\\s*16\\b"),
)
# Questions for facts, words of an applicant's profile, and wishes.
FACTUAL = "\\bwhat\\s+(?:is|are|documents?)\\b|\\bhow\\s+much\\b|\\bminimum\\b|\\bmaximum\\b|\\brequired\\b|\\bwhat\\s+do\\s+i\\s+need\\b"
PROFILE_WORDS = "salary|cibil|income|age|score|earn"
WISH = "\\bneed.*loan\\b|\\bwant.*loan\\b|\\bget.*loan\\b"
# Income patterns and their factors, in order; the third is lakhs a year.
INCOMES = (
    ("₹?\\s*(\\d[\\d,]*)\\s*(?:per\\s*month|/month|pm\\b|monthly)", 1.0),
    ("₹?\\s*(\\d+)\\s*k\\b", 1000.0),
    ("(\\d+(?:\\.\\d+)?)\\s*lpa\\b", None),
    ("salary\\s+(?:of\\s+)?₹?\\s*(\\d[\\d,]*)", 1.0),
    ("earn(?:ing|s)?\\s+₹?\\s*(\\d[\\d,]*)", 1.0),
    ("income\\s+(?:of\\s+)?₹?\\s*(\\d[\\d,]*)", 1.0),
)
SCORE = "\\b(cibil|credit\\s*score)\\s*(?:of|is|:|=)?\\s*(\\d{3})\\b"
AGE = "\\b(\\d{2})\\s*years?\\s*(?:old|of\\s*age)?\\b|(?:age|aged?)\\s*(?:of\\s*|is\\s*|:)?\\s*(\\d{2})\\b|(?:\\bam|is)\\s+(\\d{2})\\b"
EXPERIENCE = "(\\d+)\\s*years?\\s*(?:of\\s*)?(?:experience|service|work)"
EMPLOYMENT = (
    ("self_employed", "\\bself.?emp|\\bfreelance[rd]?\\b|\\bfreelancing\\b|\\bgig\\s*worker\\b|\\bconsultant\\b|\\bown\\s+business\\b|\\bproprietor\\b|\\bbusiness\\s+owner\\b"),
    ("unemployed", "\\bno\\s+job\\b|\\bunemployed\\b|\\bjobless\\b|\\bno\\s+(?:fixed\\s+)?income\\b"),
    ("government", "\\bgovernment\\b|\\bpsu\\b|\\bpublic\\s+sector\\b|\\bdefence\\b|\\bdefense\\b"),
    ("professional", "\\bprofessional\\b|\\bdoctor\\b|\\bca\\b|\\bchartered\\b|\\blawyer\\b|\\barchitect\\b"),
    ("salaried", "\\bsalaried\\b|\\bemployed\\b|\\bservice\\b|\\bworking\\b"),
)
# Fields that a query asks about.
HINTS = (
    ("credit_score", "\\bcibil\\b|credit.?score"),
    ("monthly_income", "\\bincome\\b|\\bsalary\\b|\\bearning"),
    ("age", "\\bage\\b|\\byears.old\\b"),
    ("dti_ratio", "\\bdti\\b|debt.to.income"),
    ("employment_type", "\\bemployment\\b|\\bsalaried\\b"),
    ("work_experience_months", "\\bexperience\\b|\\btenure\\b"),
    ("interest_rate", "\\binterest\\s*rate\\b|\\broi\\b"),
    ("fees", "\\bfee\\b|\\bcharge\\b|\\bpenalty\\b|\\bprocessing\\b|\\bforeclos\\b"),
)
# What is appended to a query for retrieval.
APPENDED = {"eligibility": "eligibility criteria requirements", "urgent": "instant disbursal pre-approved fast approval", "comparison": "compare difference vs lowest interest rate"}
URGENT = "\\burgent\\b|\\bfast\\b|\\bquick\\b|\\binstant\\b|\\bjaldi\\b"
SUPERLATIVE = "\\bbest\\b|\\bsafest\\b|\\bcheapest\\b|\\blowest\\b"


def normalise(q: Column, for_models: bool = False) -> Column:
    """Informal words in plain ones, blanks collapsed; everything below reads the normalised query."""
    q = F.trim(q)
    for pattern, word in SLANG:
        word = SLANG_FOR_MODELS.get(pattern, word) if for_models else word
        q = q if word is None else F.regexp_replace(q, "(?i)" + pattern, word)
    return F.trim(F.regexp_replace(q, "\\s{2,}", " "))


def lenders(q: Column) -> Column:
    return bound(F.lower(q), lambda x: F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(x, F.lit(k)), F.lit(v)) for k, v in LENDERS]))))


def income(q: Column) -> Column:
    """Monthly income: the first pattern whose first match is a plausible amount."""

    def read(pattern: str, by: float | None) -> Column:
        x = number(q, pattern)
        return bound(x * 100000 / 12 if by is None else x * by, lambda v: F.when((v > 5e3) & (v < 1e8), F.round(v, 2)))

    return F.coalesce(*[read(*p) for p in INCOMES])


def credit_score(q: Column) -> Column:
    """A named score; only where none is named, the first number that looks like one, if scores are spoken of."""
    named = found(q, SCORE, 2).try_cast("int")
    loose = F.when(says(q, "cibil|score"), found(q, "\\b([4-9]\\d{2})\\b").try_cast("int"))
    return between(F.when(says(q, SCORE), named).otherwise(loose), 300, 900)


def age(q: Column) -> Column:
    return between(F.coalesce(*[found(q, AGE, g) for g in (1, 2, 3)]).try_cast("int"), 18, 75)


def experience_months(q: Column) -> Column:
    return bound(found(q, EXPERIENCE).try_cast("int"), lambda y: F.when((y > 0) & (y < 50), y * 12))


def dti(q: Column) -> Column:
    x = bound(number(q, "\\bdti\\s*(?:of|is|=)?\\s*(\\d+)%?"), lambda v: F.when(v > 1.5, v / 100).otherwise(v))
    return bound(x, lambda v: F.when((v > 0) & (v < 1), F.round(v, 3)))


def employment(q: Column) -> Column:
    return first_pattern(q, EMPLOYMENT)


def intent_points(q: Column) -> dict[str, Column]:
    """Two for an intent's pattern; one for eligibility where applicants speak of themselves and ask for no fact, two
    where they wish for a loan; two for comparison where several lenders are named."""
    points = {name: F.when(says(q, p), 2).otherwise(0) for name, p in INTENTS}
    own = F.when(says(q, PROFILE_WORDS) & ~says(q, FACTUAL), 1).otherwise(0) + F.when(says(q, WISH), 2).otherwise(0)
    points["eligibility"] = points["eligibility"] + own
    points["comparison"] = points["comparison"] + F.when(F.size(lenders(q)) > 1, 2).otherwise(0)
    return points


def intent(q: Column) -> Column:
    """The intent of the most points; on a tie the first, where comparison by lenders alone comes last."""
    points = intent_points(q)
    first = {k: F.when(says(q, dict(INTENTS)["comparison"]), p) if k == "comparison" else p for k, p in points.items()}
    ranked = F.array(*first.values(), points["comparison"])
    names = F.array(*[F.lit(k) for k in (*first, "comparison")])
    return bound(ranked, lambda r: F.when(F.array_max(r) > 0, F.get(names, F.array_position(r, F.array_max(r)).cast("int") - 1)).otherwise(F.lit("general")))


def intent_confidence(q: Column) -> Column:
    total = lambda r: F.aggregate(r, F.lit(0), lambda a, x: a + x)
    return bound(F.array(*intent_points(q).values()), lambda r: F.when(total(r) == 0, F.lit(0.5)).otherwise(F.round(F.array_max(r) / total(r), 2)))


def hints(q: Column) -> Column:
    return F.array_compact(F.array(*[F.when(says(q, p), F.lit(n)) for n, p in HINTS]))


def reformulate(q: Column) -> Column:
    """The query with what was understood of it appended, without repeats."""
    read = F.struct(intent(q).alias("kind"), first_phrase(q, LOANS, "personal").alias("loan"))
    return bound(read, lambda r: distinct_words(F.concat_ws(" ", *_reformulated(q, r["kind"], r["loan"]))))


def _reformulated(q: Column, kind: Column, loan: Column) -> list[Column]:
    return [
        q,
        F.when(kind == "eligibility", F.lit(APPENDED["eligibility"])),
        F.when(says(q, URGENT), F.lit(APPENDED["urgent"])),
        F.when((kind == "comparison") | says(q, SUPERLATIVE), F.lit(APPENDED["comparison"])),
        F.when(loan != "personal", F.concat(loan, F.lit(" loan"))),
        F.array_join(lenders(q), " "),
        F.concat(F.lit("salary income "), whole(income(q))),
        F.concat(F.lit("CIBIL credit score "), credit_score(q).cast("string")),
        employment(q),
    ]


# The plainer reading of a query, where the one above can't be had.
PLAIN_INCOME = "(?:earn|salary|income|pay)\\s*(?:of|is|=|:)?\\s*₹?\\s*(\\d[\\d,]*)\\s*(k|thousand|lakh|lpa)?"
PLAIN_AMOUNT = "₹?\\s*(\\d[\\d,]+)\\s*(k\\b|thousand\\b)?"
PLAIN_SCORE = "(?:cibil|credit|score)\\s*(?:of|is|=|:)?\\s*(\\d{3})"
PLAIN_AGE = "(\\d{2})\\s*years?\\s*(?:old|of\\s*age)?\\b|(?:age|aged?)\\s*(?:of\\s*|is\\s*|:)?\\s*(\\d{2})\\b|(?:\\bam|is)\\s+(\\d{2})\\b"
PLAIN_EMPLOYMENT = (
    ("unemployed", "\\bno\\s+job\\b|\\bunemployed\\b|\\bjobless\\b"),
    ("self_employed", "\\bfreelance[rd]?\\b|\\bfreelancing\\b|\\bself.?emp\\b|\\bconsultant\\b|\\bown\\s+business\\b|\\bproprietor\\b|\\bgig\\b"),
    ("government", "\\bgovernment\\b|\\bpsu\\b|\\bdefence\\b|\\bdefense\\b"),
    ("salaried", "\\bsalaried\\b|\\bworking\\b|\\bemployed\\b|\\bservice\\b"),
)


def plain_profile(q: Column) -> dict[str, Column]:
    """monthly_income, credit_score, age, employment_type by the plainer reading."""
    x, unit = number(q, PLAIN_INCOME), F.lower(found(q, PLAIN_INCOME, 2))
    x = F.when(unit.isin("k", "thousand"), x * 1e3).when(unit == "lakh", x * 1e5).when(unit == "lpa", x * 1e5 / 12).otherwise(x)
    named = F.when((x > 3e3) & (x < 1e8), F.round(x, 2))
    y = number(q, PLAIN_AMOUNT)
    bare = F.when(found(q, PLAIN_AMOUNT, 2).isNotNull(), y * 1e3).otherwise(y)
    score = F.when(says(q, PLAIN_SCORE), found(q, PLAIN_SCORE)).otherwise(found(q, "\\b([4-9]\\d{2})\\b"))
    years = F.coalesce(*[found(q, PLAIN_AGE, g) for g in (1, 2, 3)]).try_cast("int")
    return {
        "monthly_income": F.coalesce(named, F.round(between(bare, 5e3, 5e5), 2)),
        "credit_score": between(score.try_cast("int"), 300, 900),
        "age": between(years, 18, 80),
        "employment_type": first_pattern(q, PLAIN_EMPLOYMENT),
    }


# ---- normalised values of scraped pages


def money(t: Column, as_coded: bool = False) -> Column:
    """Rupees: crores, lakhs, thousands, plain. As coded, the letters of "/month/year" are blanked first, so that most
    words for factors are never read."""
    x = F.lower(F.trim(t))
    x = F.trim(F.regexp_replace(x, "[₹,\\s/month/year]", " ")) if as_coded else F.regexp_replace(x, "[₹,]", "")

    def read(x: Column) -> Column:
        plain = number(F.replace(x, F.lit(" "), F.lit("")), "([\\d,]+(?:\\.\\d+)?)")
        scaled = [number(x, p) * by for p, by in (("([\\d.]+)\\s*cr(?:ore)?", 1e7), ("([\\d.]+)\\s*la(?:kh|c|cs)?", 1e5), ("([\\d.]+)\\s*(?:thousand|k)\\b", 1e3))]
        return F.coalesce(*scaled, plain)

    return bound(x, read)


def percent(t: Column) -> Column:
    return bound(number(t, "(\\d+(?:\\.\\d+)?)\\s*%"), lambda x: F.when((x > 0) & (x < 100), x))


def rate_range(t: Column) -> Column:
    """[low, high]: an explicit range, else least and greatest of all percentages."""
    pattern = "(\\d+(?:\\.\\d+)?)\\s*%?\\s*(?:to|–|—|-|upto|up\\s*to)\\s*(\\d+(?:\\.\\d+)?)\\s*%"
    pair = F.struct(*[number(t, pattern, g).alias(n) for g, n in ((1, "a"), (2, "b"))])
    every = F.filter(F.transform(F.regexp_extract_all(t, F.lit("(\\d+(?:\\.\\d+)?)\\s*%"), F.lit(1)), lambda s: s.cast("double")), lambda x: (x > 0) & (x < 100))
    explicit = bound(pair, lambda r: F.when((F.least(r["a"], r["b"]) > 0) & (F.greatest(r["a"], r["b"]) < 100), F.array(F.least(r["a"], r["b"]), F.greatest(r["a"], r["b"]))))
    return F.coalesce(explicit, bound(every, lambda x: F.when(F.size(x) > 0, F.array(F.array_min(x), F.array_max(x)))))


def tenure_months(t: Column) -> Column:

    def read(x: Column) -> Column:
        years, months = number(x, "(\\d+(?:\\.\\d+)?)\\s*(?:year|yr)"), number(x, "(\\d+)\\s*(?:month|mo\\b)")
        bare = bound(number(x, "^\\s*(\\d+)\\s*$"), lambda n: F.when(n <= 30, n * 12).otherwise(n))
        return F.coalesce(years * 12, months, bare).cast("int")

    return bound(F.lower(F.trim(t)), read)


def tenure_range(t: Column, as_coded: bool = False) -> Column:
    """[low, high] months. Documented reading: a bare number takes the unit of the part on its right; as coded it is
    read by itself, small numbers as years. Zero months are none."""

    def pair(parts: Column) -> Column:
        left, right = F.get(parts, 0), F.get(parts, 1)
        if not as_coded:
            unit = F.regexp_extract(right, "(year|yr|month|mo\\b)", 1)
            left = F.when(left.rlike("^\\s*\\d+\\s*$") & (unit != ""), F.concat(F.trim(left), F.lit(" "), unit)).otherwise(left)
        both = F.struct(tenure_months(left).alias("lo"), tenure_months(right).alias("hi"))
        ordered = lambda r: F.array(F.least(r["lo"], r["hi"]), F.greatest(r["lo"], r["hi"]))
        return F.when(F.size(parts) == 2, bound(both, lambda r: F.when((r["lo"] != 0) & (r["hi"] != 0), ordered(r))))

    one = bound(tenure_months(t), lambda m: F.when(m != 0, F.array(m, m)))
    return F.coalesce(bound(F.split(F.lower(t), "\\s*(?:to|–|—|-)\\s*"), pair), one)


def age_range(t: Column) -> Column:
    """[low, high]: a range, a least age (up to 65), else least and greatest of several two-digit ages."""
    pair = F.struct(*[found(t, "(\\d+)\\s*(?:to|–|—|-)\\s*(\\d+)", g).try_cast("int").alias(n) for g, n in ((1, "lo"), (2, "hi"))])
    least = found(t, "(?:min(?:imum)?|at\\s*least)\\s*(\\d+)").try_cast("int")
    ages = F.filter(F.transform(F.regexp_extract_all(t, F.lit("\\b(\\d{2})\\b"), F.lit(1)), lambda x: x.cast("int")), lambda x: (x >= 18) & (x <= 80))
    return F.coalesce(
        bound(pair, lambda r: F.when((r["lo"] >= 18) & (r["lo"] <= r["hi"]) & (r["hi"] <= 80), F.array(r["lo"], r["hi"]))),
        bound(least, lambda x: F.when((x >= 18) & (x <= 40), F.array(x, F.lit(65)))),
        bound(ages, lambda x: F.when(F.size(x) > 1, F.array(F.array_min(x), F.array_max(x)))),
    )


def monthly_income(t: Column, as_coded: bool = False) -> Column:
    """Lakhs a year, an amount a month, else a bare amount: yearly if large, none if small."""

    def read(x: Column) -> Column:
        lakhs = F.coalesce(number(x, "([\\d.]+)\\s*lpa\\b"), number(x, "([\\d.]+)\\s*lakh.*?(?:per\\s*annum|pa\\b|annually)"))
        pattern = "(?:₹|rs\\.?)?\\s*([\\d,]+(?:\\.\\d+)?)\\s*(k\\b|thousand)?\\s*(?:per\\s*month|monthly|pm\\b|/month)"
        named = number(x, pattern) * F.when(found(x, pattern, 2).isNotNull(), 1e3).otherwise(1.0)
        return F.coalesce(F.round(lakhs * 1e5 / 12, 2), named)

    bare = bound(money(t, as_coded), lambda v: F.when(v > 5e5, F.round(v / 12, 2)).when(v >= 5e3, v))
    return F.coalesce(bound(F.lower(t), read), bare)


def least_score(t: Column) -> Column:
    return between(found(t, "\\b([4-9]\\d{2})\\b").try_cast("int"), 300, 900)


# Words for kinds of employment, in order.
EMPLOYMENT_KINDS = (
    ("salaried", "salaried"), ("salary", "salaried"), ("employed", "salaried"),
    ("self.employ", "self_employed"), ("self employ", "self_employed"), ("business", "self_employed"),
    ("professional", "professional"), ("doctor", "professional"), ("ca\\b", "professional"),
    ("government", "government"), ("govt", "government"), ("psu", "government"), ("public sector", "government"),
    ("nri", "nri"),
)


def employment_kinds(t: Column) -> Column:
    return bound(F.lower(t), lambda x: F.array_distinct(F.array_compact(F.array(*[F.when(x.rlike(p), F.lit(v)) for p, v in EMPLOYMENT_KINDS]))))


# Names of lenders in records, and in addresses, in order.
BANK_NAMES = (
    ("axis bank", "Axis"), ("axisbank", "Axis"), ("hdfc bank", "HDFC"), ("hdfcbank", "HDFC"), ("icici bank", "ICICI"), ("icicidirect", "ICICI"),
    ("state bank of india", "SBI"), ("sbi", "SBI"), ("paisabazaar", "Paisabazaar"), ("bankbazaar", "BankBazaar"), ("rbi", "RBI"), ("reserve bank", "RBI"),
)
BANK_ADDRESSES = (("icici", "ICICI"), ("axis", "Axis"), ("sbi", "SBI"), ("hdfc", "HDFC"), ("paisabazaar", "Paisabazaar"), ("bankbazaar", "BankBazaar"), ("rbi", "RBI"))


def bank_name(t: Column) -> Column:
    """A lender's name as records have it; other names stay."""
    return F.coalesce(first_phrase(t, BANK_NAMES), t)


def bank_of_address(url: Column) -> Column:
    return first_phrase(url, BANK_ADDRESSES)


# What pages say of a loan, in order.
PAGE_INCOMES = (
    "(?:min(?:imum)?\\s*(?:monthly)?\\s*(?:income|salary|earning))\\s*(?:of|:)?\\s*([\\d,₹.\\s]+(?:lakh|lpa|k|thousand)?(?:\\s*per\\s*month|\\s*pm)?)",
    "(?:income|salary)\\s+(?:should\\s+be|must\\s+be|required|atleast)\\s*([\\d,₹.\\s]+(?:lakh|lpa|k)?)",
    "monthly\\s+(?:income|salary)\\s+(?:above|more\\s+than|greater\\s+than|at\\s+least)\\s*([\\d,₹.\\s]+)",
)
PAGE_AGES = ("(age\\s*(?:between|from|:)?\\s*\\d+\\s*(?:to|–|-|and)\\s*\\d+\\s*years)", "((?:minimum|min)?\\s*age\\s*(?:of|:)?\\s*\\d+\\s*years?)")
PAGE_AMOUNT = "(?:loan|borrow)\\s*(?:up\\s*to|upto|maximum|of|ranging\\s*from)?\\s*₹?\\s*([\\d.,]+\\s*(?:lakh|crore|k|thousand)?)\\s*(?:to|–)?\\s*₹?\\s*([\\d.,]+\\s*(?:lakh|crore|k|thousand)?)?"
PAGE_TENURE = "(tenure\\s*(?:of|:)?\\s*(?:up\\s*to\\s*)?\\d+\\s*(?:to\\s*\\d+)?\\s*(?:year|month))"
PAGE_SCORE = "(?:cibil|credit\\s*score)\\s*(?:of|above|minimum|min|:)?\\s*(\\d{3})\\+?"
PAGE_FEE = "processing\\s*(?:fee|charge)\\s*(?:of|:)?\\s*([\\d.]+)\\s*%"


def loan_terms(t: Column, as_coded: bool = False) -> dict[str, Column]:
    """The eight fields that a page's text may tell: each by the first pattern that gives a value, else null."""
    return {name: read() for name, read in _loan_terms(t, as_coded).items()}


def loan_term(t: Column, name: str, as_coded: bool = False) -> Column:
    """One of loan_terms(), without making the others."""
    return _loan_terms(t, as_coded)[name]()


def _loan_terms(t: Column, as_coded: bool) -> dict[str, Callable[[], Column]]:
    some = lambda x: bound(x, lambda v: F.when(v != 0, v))
    amounts = lambda low: F.struct(low.alias("low"), F.coalesce(told(t, PAGE_AMOUNT, lambda x: F.struct(money(x, as_coded).alias("x")), 2), F.struct(low.alias("x")))["x"].alias("high"))
    ordered = lambda r: F.when((r["low"] > 0) & (r["high"] > 0) & (r["low"] <= r["high"]), F.array(r["low"], r["high"]))
    return {
        "interest_rate": lambda: rate_range(t),
        "min_income": lambda: F.coalesce(*[told(t, p, lambda x: some(monthly_income(x, as_coded))) for p in PAGE_INCOMES]),
        "age_range": lambda: F.coalesce(*[told(t, p, age_range) for p in PAGE_AGES]),
        "loan_amount": lambda: told(t, PAGE_AMOUNT, lambda x: bound(money(x, as_coded), lambda low: bound(amounts(low), ordered))),
        "tenure": lambda: told(t, PAGE_TENURE, lambda x: tenure_range(x, as_coded)),
        "min_cibil": lambda: told(t, PAGE_SCORE, least_score),
        "processing_fee_pct": lambda: bound(number(t, PAGE_FEE), lambda x: F.when((x > 0) & (x < 10), x)),
        "employment_type": lambda: bound(employment_kinds(t), lambda x: F.when(F.size(x) > 0, x)),
    }


def layered(terms: list[dict[str, Column]]) -> dict[str, Column]:
    """Terms of several texts, each field from the first text that tells it."""
    return {k: F.coalesce(*[t[k] for t in terms]) for k in terms[0]}


# ---- what language models and searches return


def fenced_json(raw: Column) -> Column:
    """A model's answer without code fences."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(raw, "```(?:json)?", "")), "^`+|`+$", ""))


def model_profile(json: Column) -> dict[str, Column]:
    """A profile from the entities that a model parsed (a JSON object): alternative keys, amounts with signs, small
    incomes as lakhs a year. The first key that is there decides."""
    get = lambda *keys: F.coalesce(*[F.get_json_object(json, f"$.{k}") for k in keys])
    x = F.regexp_replace(get("monthly_income", "salary", "income"), "[₹,\\s]", "").try_cast("double")
    value = lambda *keys: F.coalesce(*[F.get_json_object(json, f"$.{k}").try_cast("double") for k in keys])
    return {
        "monthly_income": F.round(F.when(x < 500, x * 100000 / 12).otherwise(x), 2),
        "age": value("age"),
        "credit_score": value("credit_score", "cibil", "cibil_score"),
        "employment_type": F.lower(F.nullif(get("employment_type"), F.lit(""))),
        "work_experience_months": value("work_experience_months", "work_experience", "experience_months"),
        "dti_ratio": value("dti_ratio"),
    }


def bounded_profile(json: Column) -> dict[str, Column]:
    """A profile from a model's answer to the plain question for five fields: only plausible numbers."""
    value = lambda k: F.get_json_object(json, f"$.{k}").try_cast("double")
    return {
        "monthly_income": F.when(value("monthly_income") > 0, value("monthly_income")),
        "credit_score": between(value("credit_score").cast("int"), 300, 900),
        "age": between(value("age").cast("int"), 18, 80),
        "employment_type": F.lower(F.nullif(F.get_json_object(json, "$.employment_type"), F.lit(""))),
        "work_experience_months": value("work_experience_months"),
    }


def search_context(results: Column) -> Column:
    """Search results (title, snippet, url) as numbered lines for a prompt; empty without results."""
    line = lambda r, i: F.concat(F.lit("\n"), (i + 1).cast("string"), F.lit(". "), r["title"], F.lit("\n   "), r["snippet"], F.lit("\n   Source: "), r["url"])
    return F.when(F.size(results) > 0, F.concat_ws("\n", F.lit("[Web Search Results]"), F.transform(results, line))).otherwise(F.lit(""))


def json_strings(json: Column, longer: int = 20) -> Column:
    """The strings of a JSON document, in order, that are longer than that: what its keys hold, at any depth."""
    strings = F.regexp_extract_all(json, F.lit(r'"((?:[^"\\]|\\.)*)"\s*(:?)'), F.lit(0))
    values = F.transform(F.filter(strings, lambda s: ~s.rlike(":$")), lambda s: F.regexp_replace(F.regexp_extract(s, r'^"(.*)"\s*$', 1), r"\\(.)", "$1"))
    return F.filter(values, lambda s: F.length(s) > longer)
