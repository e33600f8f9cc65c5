"""Records from pages: a page's pieces, read layer by layer, then by the rules of its site.

Layers are texts in order (structured data, sections, tables, the whole text, descriptions); each field of a record is
what the first text that tells it says. A site's rules fill in what is still empty. A page that can't be parsed is read
as an empty one of no known site, so that every page gives a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions.tables import page_sentences
from ..plans.spread import dealt
from . import dom
from .html import absolute, host
from .records import confidence

_TEXTS = "array<string>"
PIECES = (
    f"site string, json {_TEXTS}, sections array<struct<heading:string,text:string,items:{_TEXTS}>>, tables array<array<{_TEXTS}>>, metas {_TEXTS}, full string, main string, "
    f"links array<struct<href:string,text:string>>, h1 string, rates {_TEXTS}, eligibility string, charges string, cells string, features {_TEXTS}, facts {_TEXTS}, compared string"
)


# Links worth following, sites' words for incomes, service and fees, and lengths.
RELEVANT = "eligib|interest.?rate|fee|charge|emi|apply|personal.?loan|home.?loan|compare|calculator"
INCOMES = {
    "ICICI": ("income\\s*(?:of|above|:)?\\s*([\\d,₹.\\s]+(?:lpa|lakh|k)?)",),
    "Axis": ("(?:net\\s*monthly|monthly\\s*(?:net|take.?home)?)\\s*income\\s*(?:of|above|:)?\\s*([\\d,₹.\\s]+(?:lakh|lpa|k)?)",),
    "SBI": ("(?:minimum\\s*)?(?:net\\s*monthly\\s*)?income\\s*(?:of)?\\s*₹?\\s*([\\d,]+)", "income\\s*(?:should\\s*be|of|:)\\s*₹?\\s*([\\d,]+)\\s*(?:per\\s*month)?"),
}
FEE = "processing\\s*(?:fee|charge)\\s*(?:of|:)?\\s*([\\d.]+)\\s*%"
FEE_ICICI = "processing\\s*fee\\s*(?:of|:)?\\s*([\\d.]+)\\s*%"
FORECLOSURE = "foreclos\\w*\\s*(?:charge|fee)?\\s*(?:of|:)?\\s*([\\d.]+)\\s*%"
SERVICE = "(?:minimum|at\\s*least)\\s*(\\d+)\\s*(year|month)"
SCORE_SBI = "cibil\\s*score\\s*(?:of\\s*|above\\s*|minimum\\s*)?(\\d{3})"
KINDS = {
    "ICICI": (("salaried", "salaried"), ("self_employed", "self.employ")),
    "Axis": (("salaried", "\\bsalaried\\b"), ("self_employed", "self.?employed\\b|business\\s*owner"), ("professional", "\\bprofessional\\b")),
    "SBI": (("salaried", "\\bsalaried\\b"), ("government", "government|pensioner|psu"), ("self_employed", "self.?employ")),
}
#: Characters that a section and a table need to count, and that are kept of texts.
LEAST_SECTION, LEAST_TABLE, SECTION, TABLE, META, MAIN, CONTENT = 50, 30, 400, 1000, 300, 3000, 4000


def _first(texts: Column, read, kind: str) -> Column:
    """What the first text says of which read tells something; later ones are not read."""
    return F.aggregate(texts, F.lit(None).cast(kind), lambda found, t: F.coalesce(found, read(t)))


def _site(name: str, value: Column) -> Column:
    return F.when(F.col("p_site") == name, value)


_KIND = {"interest_rate": "array<double>", "min_income": "double", "age_range": "array<int>", "loan_amount": "array<double>", "tenure": "array<int>", "min_cibil": "int", "processing_fee_pct": "double", "employment_type": "array<string>"}


def page_records(pages: DataFrame, as_coded: bool = False, structured: bool = True, deal: bool = True) -> DataFrame:
    """A record for each page (page_id, url, html). structured: also read what pages state for search engines. deal:
    deal pages over all cores first; without it they should be so already."""
    p = pages.select("page_id", "url", "html")
    p = dealt(p) if deal else p
    p = p.select("page_id", "url", F.pandas_udf(dom.pieces_of, PIECES)("html", host(F.col("url"))).alias("p"))
    p = p.select("page_id", "url", *[F.col(f"p.{c}").alias(f"p_{c}") for c in p.schema["p"].dataType.names])
    finance = F.filter("p_sections", lambda s: X.says(s["heading"], dom.FINANCE))
    full_text = lambda s: F.concat_ws(" ", s["heading"], F.nullif(s["text"], F.lit("")))
    items = F.filter(F.flatten(F.transform(finance, lambda s: s["items"])), lambda x: (F.length(x) > 10) & (F.length(x) < 300))
    metas = F.filter(F.array(F.array_join("p_metas", " ")), lambda t: t != "")
    columns = {
        "told": F.filter(F.transform(finance, full_text), lambda t: F.length(t) > LEAST_SECTION),
        "tabled": F.filter(F.transform("p_tables", lambda t: F.array_join(page_sentences(t), " ")), lambda t: F.length(t) > LEAST_TABLE),
        "stated": F.concat(F.col("p_json") if structured else F.array().cast(_TEXTS), F.col("told"), F.col("tabled")),
        "texts": F.concat(F.col("stated"), F.array("p_full"), metas),
        "early": _first(F.col("stated"), X.rate_range, "array<double>"),
        **{f: _first(F.col("texts"), lambda t, f=f: X.loan_term(t, f, as_coded), kind) for f, kind in _KIND.items()},
        "features": F.slice(F.array_distinct(items), 1, 20),
        "facts": F.slice(F.concat(F.transform("told", lambda t: F.substring(t, 1, SECTION)), F.transform("p_metas", lambda m: F.substring(m, 1, META))), 1, 10),
        "content": F.substring("p_main", 1, MAIN),
        # a record's confidence is that of its layers, before its site's rules
        "confidence": confidence(),
        "body": F.concat_ws(" ", F.nullif("content", F.lit("")), F.nullif(F.array_join(F.slice(F.transform("tabled", lambda t: F.substring(t, 1, TABLE)), 1, 5), " "), F.lit("")), F.nullif(F.array_join(F.slice("facts", 1, 5), " "), F.lit(""))),
    }
    for name, value in columns.items():
        p = X.computed(p, name, value)
    return _enriched(p, as_coded)


def _incomes(text: Column, name: str, as_coded: bool) -> Column:
    tail = " per month" if name == "SBI" else ""
    return F.coalesce(*[F.when(x != 0, x) for x in (X.monthly_income(F.concat(X.found(text, p), F.lit(tail)), as_coded) for p in INCOMES[name])])


def _enriched(p: DataFrame, as_coded: bool) -> DataFrame:
    """Records with what the rules of their site add."""
    near, dear, cells = F.col("p_eligibility"), F.col("p_charges"), F.col("p_cells")
    rates = F.coalesce(
        F.col("interest_rate"),
        _site("ICICI", F.coalesce(_first(F.col("p_rates"), X.rate_range, "array<double>"), X.rate_range(F.col("p_full")))),
        _site("Axis", X.rate_range(dear)), _site("SBI", X.rate_range(cells)), _site("Paisabazaar", _first(F.col("p_facts"), X.rate_range, "array<double>")),
        _site("BankBazaar", _first(F.filter("p_rates", lambda t: X.says(t, "start|from|@")), X.rate_range, "array<double>")),
    )
    income = F.coalesce(F.col("min_income"), *[_site(n, _incomes(cells if n == "SBI" else near, n, as_coded)) for n in INCOMES])
    ages = F.coalesce(F.col("age_range"), X.age_range(near))
    own = F.coalesce("employment_type", F.array().cast(_TEXTS))
    kinds = {n: F.array_compact(F.array(*[F.when(X.says(near, pattern), F.lit(k)) for k, pattern in table])) for n, table in KINDS.items()}
    employment = F.when((F.col("p_site") == "SBI") & near.isNotNull(), F.array_distinct(F.concat(own, kinds["SBI"]))).when((F.size(own) == 0) & near.isNotNull(), F.coalesce(_site("ICICI", kinds["ICICI"]), _site("Axis", kinds["Axis"]), own)).otherwise(own)
    months = X.found(near, SERVICE).try_cast("int") * F.when(F.lower(X.found(near, SERVICE, 2)) == "year", 12).otherwise(1)
    fee = F.coalesce(F.col("processing_fee_pct"), _site("ICICI", X.number(dear, FEE_ICICI)), _site("Axis", X.number(dear, FEE)))
    facts = F.concat(F.col("facts"), F.when((F.col("p_site") == "Axis") & near.isNotNull(), F.array(F.substring(near, 1, SECTION))).otherwise(F.array().cast(_TEXTS)), F.filter("p_facts", lambda f: (F.col("p_site") == "Paisabazaar") | ~F.array_contains("facts", f)))
    content = F.coalesce(_site("Paisabazaar", F.col("p_compared")), F.nullif(F.substring("body", 1, CONTENT), F.lit("")), _site("BankBazaar", F.col("p_compared")), _site("ICICI", F.col("p_h1")), F.lit(""))
    full = F.filter(F.transform("p_links", lambda x: F.struct(absolute(F.col("url"), x["href"]).alias("u"), (X.says(x["text"], RELEVANT) | X.says(x["href"], RELEVANT)).alias("r"), x["href"].alias("h"))), lambda x: x["r"] & (x["h"] != "") & ~x["h"].rlike("^(#|mailto:|tel:|javascript:)") & (host(x["u"]) == host(F.col("url"))))
    links = F.slice(F.array_distinct(F.transform(full, lambda x: x["u"])), 1, 15)
    used = {"jsonld": F.size("p_json") > 0, "sections": F.size("told") > 0, "tables": F.size("tabled") > 0, "regex": F.col("early").isNull() & F.col("interest_rate").isNotNull(), "meta": F.size("p_metas") > 0, "body": F.col("p_main") != "", "links": F.size(links) > 0}
    bank = F.when(F.col("p_site") == "Unknown", F.coalesce(X.bank_of_address(F.col("url")), F.lit("Unknown"))).otherwise(F.col("p_site"))
    return p.select(
        "page_id", F.col("url").alias("source_url"), bank.alias("bank"), F.lit("personal").alias("loan_type"), rates.alias("interest_rate"), fee.alias("processing_fee_pct"), _site("Axis", X.number(dear, FORECLOSURE)).alias("foreclosure_fee"), F.lit(None).cast("double").alias("processing_fee"),
        income.alias("min_income"), ages.alias("age_range"), employment.alias("employment_type"), F.coalesce(F.col("min_cibil"), _site("SBI", X.between(X.found(cells, SCORE_SBI).try_cast("int"), 300, 900))).alias("min_cibil"), _site("Axis", months).alias("min_experience"),
        F.col("loan_amount").alias("loan_amount"), F.col("tenure").alias("tenure"), F.array_distinct(F.concat("features", "p_features")).alias("features"), facts.alias("key_facts"), content.alias("content"), "confidence",
        F.concat_ws(",", *[F.when(c, F.lit(n)) for n, c in used.items()]).alias("extraction_method"), links.alias("linked_urls"),
    )


def sections(html: str) -> Column:
    """Headings of a page with the text and list items up to the next one."""
    return F.pandas_udf(dom.sections_of, "array<struct<heading:string,text:string,items:array<string>>>")(html)
