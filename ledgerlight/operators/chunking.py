"""Chunking texts by sentences, and what is known of each chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.extract import bound, first_pattern, says
from ..plans.spread import dealt
from .retrieval import first_rows, words

SIZE, OVERLAP = 400, 75
#: Least words of a chunk, by where its text comes from.
LEAST = {"page": 20, "table": 20, "text": 15}


def sentences(text: Column) -> Column:
    return F.split(text, "(?<=[.!?])[ \\t\\n\\r\\f]+")


def chunk(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Sentences packed into chunks of size words; each chunk begins with the last overlap words of the one before.

    A chunk is a run of the text's words, so a fold over the sentences' word counts finds the bounds of the runs, and
    each is sliced once. A sentence that alone is longer than size is a chunk with what was carried over.
    """
    counts = F.transform(sentences(text), words)
    none = F.expr("cast(array() as array<struct<a:int,z:int>>)")
    run = lambda acc: F.array(F.struct(acc["a"].alias("a"), acc["at"].alias("z")))

    def step(acc: Column, n: Column) -> Column:
        held = acc["at"] - acc["a"]
        full = (held > 0) & (held + n > size)
        return F.struct(F.when(full, F.greatest(acc["a"], acc["at"] - overlap)).otherwise(acc["a"]).alias("a"), (acc["at"] + n).alias("at"), F.when(full, F.concat(acc["out"], run(acc))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("a"), F.lit(0).alias("at"), none.alias("out"))
    runs = F.aggregate(counts, start, step, lambda acc: F.when(acc["at"] > acc["a"], F.concat(acc["out"], run(acc))).otherwise(acc["out"]))
    every = F.filter(F.split(text, "[ \\t\\n\\r\\f]+"), lambda w: w != "")
    both = F.struct(every.alias("w"), runs.alias("r"))
    return bound(both, lambda b: F.transform(b["r"], lambda r: F.array_join(F.slice(b["w"], r["a"] + 1, r["z"] - r["a"]), " ")))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST["page"]) -> DataFrame:
    """doc, chunk_id, text, n_words, hash of every chunk of least words."""
    c = dealt(docs.select(id_col, text_col)).select(F.col(id_col).alias("doc"), F.posexplode(chunk(F.col(text_col))).alias("chunk_id", "text"))
    return c.withColumn("n_words", words(F.col("text"))).filter(F.col("n_words") >= least).withColumn("hash", F.substring(F.md5("text"), 1, 12))


def distinct_chunks(c: DataFrame) -> DataFrame:
    """The first chunk of each hash by document and place."""
    return first_rows(c, ["hash"], ["doc", "chunk_id"])


# The first pattern that a lower-cased chunk holds names its field.
HINTS = (
    ("monthly_income", "income|salary|earning|ctc|lpa"),
    ("credit_score", "cibil|credit\\s*score|credit\\s*rating"),
    ("age", "\\bage\\b|years\\s*old|minimum\\s*age|maximum\\s*age"),
    ("dti_ratio", "dti|debt.to.income|emi.*income|obligations"),
    ("employment_type", "employment|salaried|self.employed|professional"),
    ("work_experience_months", "experience|work.*month|tenure|service"),
    ("interest_rate", "interest\\s*rate|roi|rate\\s*of\\s*interest"),
    ("loan_amount", "loan\\s*amount|principal|disburs"),
    ("fees", "processing\\s*fee|charges|fees"),
    ("tenure", "repayment|tenure|emi|instalment"),
)
# What a chunk is, in order, unless its source's path says it.
SOURCES = (("comparison", "paisabazaar|bankbazaar"), ("regulatory", "rbi"))
TYPES = (
    ("eligibility", "eligib|criteria|qualify|minimum|required|age|income|salary"),
    ("interest_rate", "interest\\s*rate|roi|% p\\.?a|per\\s*annum|bps"),
    ("table", "\\|"),
    ("regulatory", "rbi|reserve\\s*bank|circular|guideline|regulation|compliance"),
    ("comparison", "vs\\.?\\s|compared?\\s*to|better\\s*than|paisabazaar|bankbazaar"),
    ("fees", "processing\\s*fee|charge|penalty|foreclosure|prepayment"),
)
HEADING = "^(eligibility|criteria|features?|benefits?|fees?|charges?|interest rate|documentation|documents\\s*required|terms?\\s*and\\s*conditions?|who\\s*can\\s*apply|about|overview|summary)\\b"


def field_hint(text: Column) -> Column:
    """The field that a chunk is about; empty without one."""
    return first_pattern(text, HINTS, "")


def chunk_type(text: Column, source: Column) -> Column:
    """The kind of a chunk: by the path of its source, else by its words."""
    return F.coalesce(first_pattern(source, SOURCES), first_pattern(text, TYPES, "pdf"))


def section_title(text: Column) -> Column:
    """The first line, if it is short and begins like a heading."""
    line = F.trim(F.get(F.split(F.trim(text), "\\n"), F.lit(0)))
    return F.when((F.length(line) < 80) & says(line, HEADING), line)


def table_chunk(told: Column, title: Column) -> Column:
    """The text of a table's chunk: its sentences under the title of their section; null if they are too few words."""
    text = F.trim(F.array_join(told, " "))
    full = F.when(F.coalesce(title, F.lit("")) != "", F.concat(title, F.lit(": "), text)).otherwise(text)
    return F.when(words(text) >= LEAST["table"], full)


def carry_titles(rows: DataFrame, doc: str, page: str, title: str = "title") -> DataFrame:
    """Pages without a title take that of the page before."""
    w = W.Window.partitionBy(doc).orderBy(page).rowsBetween(W.Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(title, ignorenulls=True).over(w))
