"""Scraped records: validation, deduplication, summaries and retrieval text.

A record has bank, loan_type, source_url, content; the ranges interest_rate, loan_amount, age_range, tenure (arrays of low
and high, empty or null if unknown); processing_fee, processing_fee_pct, foreclosure_fee, min_income, min_cibil,
min_experience, confidence; employment_type and features (arrays of strings).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import bank_name
from .retrieval import first_rows

# What a record must have, and plausible values. Values out of bounds are named and kept.
REQUIRED = ("bank", "source_url", "content")
BOUNDS = {"processing_fee": (0, 100000), "processing_fee_pct": (0, 10), "foreclosure_fee": (0, 10), "min_income": (5000, 50000000), "confidence": (0.0, 1.0)}
SCORE = (300, 900)
RANGES = {"interest_rate": (0.5, 50.0), "loan_amount": (1000, 1000000000), "age_range": (18, 80), "tenure": (1, 360)}
POSITIVE = ("interest_rate", "loan_amount", "tenure")
#: Characters of content: fewer reject a record; more tell something by themselves.
LEAST_CONTENT, TELLING_CONTENT = 50, 200


def _some(c: str) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def validated(records: DataFrame) -> DataFrame:
    """records with valid (nothing critical), issues in the order of their checks, an impossible score cleared, ranges
    in order and without negatives, content_hash, and the lender's usual name."""
    text = lambda x: x.cast("string")
    say = lambda cond, *parts: F.when(cond, F.concat(*[F.lit(p) if isinstance(p, str) else text(p) for p in parts]))
    outside = lambda x, low, high: ~x.between(low, high)
    length = F.length("content")
    critical = [say(F.coalesce(F.col(f), F.lit("")) == "", f"Missing required field: {f}") for f in REQUIRED]
    critical.append(say((length > 0) & (F.length(F.trim("content")) < LEAST_CONTENT), "Content too short (", length, " chars) — likely failed extraction"))
    issues = [say(outside(F.col(f), *b), f"{f}=", F.col(f), f" outside [{b[0]}, {b[1]}]") for f, b in BOUNDS.items()]
    issues.append(say(outside(F.col("min_cibil"), *SCORE), "min_cibil=", F.col("min_cibil"), f" outside [{SCORE[0]},{SCORE[1]}]"))
    swaps, negatives, ordered = [], [], {}
    for f, (low, high) in RANGES.items():
        bad = F.get(F.filter(f, lambda v: ~v.between(low, high)), F.lit(0))  # noqa: B023
        issues.append(say(bad.isNotNull(), f"{f} value ", bad, f" outside [{low}, {high}]"))
        a, b = F.get(f, F.lit(0)), F.get(f, F.lit(1))
        swapped = (F.size(f) == 2) & (a > b)
        swaps.append(say(swapped, f"{f}: min (", a, ") > max (", b, ") — swapping"))
        ordered[f] = F.when(swapped, F.reverse(f)).otherwise(F.col(f))
        if f in POSITIVE:
            negatives.append(say(F.exists(f, lambda v: v < 0), f"Negative value in {f}"))
            ordered[f] = F.filter(ordered[f], lambda v: v.isNull() | (v >= 0))
    out = records.withColumns({"critical": F.array_compact(F.array(*critical)), "found": F.array_compact(F.array(*issues, *swaps, *negatives))})
    cleared = {"min_cibil": F.when(F.col("min_cibil").between(*SCORE), F.col("min_cibil")), "bank": bank_name(F.col("bank")), "content_hash": F.substring(F.sha2("content", 256), 1, 16)}
    return out.withColumns({"valid": F.size("critical") == 0, "issues": F.concat("critical", "found"), **ordered, **cleared}).drop("critical", "found")


def confidence() -> Column:
    """The share of eight fields that a record holds."""
    filled = [_some(f) for f in ("interest_rate", "age_range", "loan_amount", "tenure", "features")]
    filled += [F.coalesce(F.col(f) != 0, F.lit(False)) for f in ("min_income", "min_cibil")] + [F.coalesce(F.length("content") > TELLING_CONTENT, F.lit(False))]
    share = sum((f.cast("int") for f in filled), F.lit(0)) / len(filled)
    return F.rint(share * 100) / 100


def summary(records: DataFrame) -> DataFrame:
    """Per lender: records, how many hold each field, mean confidence, distinct pages."""
    has = lambda c: F.count_if(c)
    return records.groupBy("bank").agg(F.count("*").alias("n"), has(_some("interest_rate")).alias("has_rate"), has(F.col("min_income") > 0).alias("has_income"), has(F.col("min_cibil") > 0).alias("has_cibil"), F.round(F.avg(confidence()), 6).alias("avg_confidence"), F.countDistinct("source_url").alias("urls"))


def distinct_records(records: DataFrame) -> DataFrame:
    """Records that are the first both of their content and of their page."""
    hashed = records.withColumn("content_hash", F.substring(F.sha2("content", 256), 1, 16))
    by_hash = first_rows(hashed.select("content_hash", "id"), ["content_hash"], ["id"]).select("id")
    by_url = first_rows(hashed.select("source_url", "id"), ["source_url"], ["id"]).select("id")
    return hashed.join(by_hash, "id", "left_semi").join(by_url, "id", "left_semi")


def unseen(records: DataFrame, seen: DataFrame) -> DataFrame:
    """Records of which neither content nor page is in seen (content_hash, source_url)."""
    return records.join(seen.select("content_hash"), "content_hash", "left_anti").join(seen.select("source_url"), "source_url", "left_anti")


def slug() -> Column:
    """A name for a record's files: lender, loan, and a hash of the page."""
    bank = F.nullif(F.replace(F.lower("bank"), F.lit(" "), F.lit("_")), F.lit(""))
    return F.regexp_replace(F.concat_ws("_", bank, F.nullif("loan_type", F.lit("")), F.substring(F.md5("source_url"), 1, 8)), "[^A-Za-z0-9_-]", "_")


def rag_text() -> Column:
    """A record in sentences, for retrieval: those whose fields it has."""
    amount = lambda c: F.format_string("%,.0f", F.rint(c.cast("double")))
    two = lambda c: F.format_string("%.2f", c.cast("double"))
    at = lambda c, k: F.get(c, F.lit(k))
    told = lambda cond, *parts: F.when(cond, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    pair = lambda c: F.size(c) >= 2
    text = lambda c: c.cast("string")
    features = F.transform(F.filter(F.slice("features", 1, 5), lambda f: F.trim(f) != ""), lambda f: F.concat(F.regexp_replace(F.trim(f), "[.]+$", ""), F.lit(".")))
    return F.concat_ws(
        " ",
        told((F.col("bank") != "") & (F.col("loan_type") != ""), F.col("bank"), " ", F.col("loan_type"), " loan."),
        F.when(F.size("interest_rate") == 2, F.concat(F.lit("Interest rate: "), two(at("interest_rate", 0)), F.lit("% to "), two(at("interest_rate", 1)), F.lit("% per annum."))).when(F.size("interest_rate") == 1, F.concat(F.lit("Interest rate: "), two(at("interest_rate", 0)), F.lit("% per annum."))),
        told(pair("loan_amount"), "Loan amount: ₹", amount(at("loan_amount", 0)), " to ₹", amount(at("loan_amount", 1)), "."),
        told(pair("tenure"), "Tenure: ", text(at("tenure", 0)), " to ", text(at("tenure", 1)), " months."),
        told(F.col("min_income") != 0, "Minimum monthly income: ₹", amount(F.col("min_income")), "."),
        told(pair("age_range"), "Age requirement: ", text(at("age_range", 0)), " to ", text(at("age_range", 1)), " years."),
        told(F.size("employment_type") > 0, "Eligible employment types: ", F.array_join("employment_type", ", "), "."),
        told(F.col("min_cibil") != 0, "Minimum CIBIL score: ", text(F.col("min_cibil")), "."),
        F.when(F.col("processing_fee").isNotNull(), F.concat(F.lit("Processing fee: ₹"), amount(F.col("processing_fee")), F.lit("."))).when(F.col("processing_fee_pct").isNotNull(), F.concat(F.lit("Processing fee: "), two(F.col("processing_fee_pct")), F.lit("% of loan amount."))),
        told(F.col("min_experience") != 0, "Minimum work experience: ", text(F.col("min_experience")), " months."),
        F.nullif(F.array_join(features, " "), F.lit("")),
        F.when(F.length("content") > 100, F.substring("content", 1, 800)),
    )


def running_confidence(records: DataFrame, order: str) -> DataFrame:
    """The mean confidence of each lender as a running mean that is rounded to two places after every record, in
    order; it depends on the order, so the records of a lender (a few scalars) are folded in one row."""
    c = records.groupBy("bank").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), confidence().alias("c")))).alias("cs"))
    step = lambda a, x: F.struct((a["n"] + 1).alias("n"), (F.rint((a["m"] * a["n"] + x["c"]) / (a["n"] + 1) * 100) / 100).alias("m"))
    return c.select("bank", F.aggregate("cs", F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("m")), step)["m"].alias("running"))
