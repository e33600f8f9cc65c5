"""File sources: texts, cached chunks, scraped records, binary documents, and what was seen before."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "struct<text: string, source: string, bank: string, doc_type: string, chunk_id: int, field_hint: string, section_title: string, element_type: string, page_number: int, similarity_score: double>"
CACHE = f"source string, bank string, is_scanned boolean, method string, chunks array<{CHUNK}>"
RECORD = "bank string, loan_type string, source_url string, scraped_at double, interest_rate array<double>, processing_fee double, processing_fee_pct double, min_income double, max_income double, age_range array<int>, employment_type array<string>, min_cibil int, min_experience int, loan_amount array<double>, tenure array<int>, content string, features array<string>, key_facts array<string>, content_hash string, extraction_method string, confidence double"
#: Words in a path that name its lender, in order.
PATH_WORDS = (("axis", "Axis"), ("hdfc", "HDFC"), ("icici", "ICICI"), ("sbi", "SBI"))
PAGES = "path string, page_number int, text string, method string"


def lender_of(path: Column) -> Column:
    """The first lender whose word stands in the file's folder or name."""
    tail = F.lower(F.regexp_extract(path, "([^/]*/[^/]*)$", 1))
    out = F.lit("Unknown")
    for word, name in reversed(PATH_WORDS):
        out = F.when(F.contains(tail, F.lit(word)), F.lit(name)).otherwise(out)
    return out


def text_files(spark: SparkSession, folder: str, least_words: int = 15) -> DataFrame:
    """path, bank, text of every .txt file below folder with enough words."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    t = t.select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("text"))
    return t.filter(F.regexp_count("text", F.lit("[^ \\t\\n\\r\\f]+")) >= least_words).withColumn("bank", lender_of(F.col("path")))


def cached_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each chunk of the cache files."""
    c = spark.read.schema(CACHE).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return c.select(F.explode("chunks").alias("c")).select("c.*")


def pending(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files (path) without cached chunks (source); whole paths are compared, so that equal names do not collide."""
    return files.join(cache.select(F.col("source").alias("path")).distinct(), "path", "left_anti")


def scraped(spark: SparkSession, folder: str) -> DataFrame:
    """Scraped records as retrieval texts: content, then up to five longer features and facts, 2000 characters."""
    r = spark.read.schema(RECORD).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_scraped.json").json(folder)
    longer = lambda c: F.filter(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, 5), lambda x: F.length(x) > 20)
    parts = F.concat(F.array("content"), longer(F.col("features")), longer(F.col("key_facts")))
    return r.filter(F.length(F.trim("content")) >= 50).select("bank", "source_url", F.substring(F.array_join(parts, " "), 1, 2000).alias("text"), "confidence")


def uploads(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("pdf", "png", "jpg", "jpeg", "txt"), most_bytes: int = 10 << 20) -> DataFrame:
    """Files that may be analysed: not empty, not too large, of a known kind; with their hash."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    kind = F.lower(F.regexp_extract("path", "\\.([A-Za-z0-9]+)$", 1))
    return b.filter(F.col("length").between(1, most_bytes) & kind.isin(*extensions)).select("path", "length", kind.alias("kind"), F.substring(F.sha2("content", 256), 1, 16).alias("file_hash"), "content")


def pages_of(files: DataFrame, decode: Callable[[bytes], list[str]], fallback: Callable[[bytes, int], str] | None = None, least: int = 50) -> DataFrame:
    """A row for each page of each file. decode gives the text of every page; a page with less than least characters
    goes to fallback (text recognition, say). Decoders are plugged in, and run once for a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, raw in zip(b["path"], b["content"], strict=True):
                try:
                    texts = decode(bytes(raw))
                except Exception:  # a broken file is one row that says so
                    out.append((path, 0, "", "failed"))
                    continue
                for k, t in enumerate(texts):
                    thin = len(t.strip()) < least and fallback is not None
                    out.append((path, k + 1, fallback(bytes(raw), k) if thin else t, "recognised" if thin else "text"))
            yield pd.DataFrame(out, columns=["path", "page_number", "text", "method"])

    return files.select("path", "content").mapInPandas(run, PAGES)


def with_unseen(pages: DataFrame, more: DataFrame) -> DataFrame:
    """pages, and of a second decoder's pages those of a file whose text is in none of the first one's."""
    told = more.withColumn("_text", F.trim("text")).filter("_text <> ''")
    new = told.join(pages.select("path", F.trim("text").alias("_text")), ["path", "_text"], "left_anti")
    return pages.unionByName(new.select(pages.columns))


def recognised(primary: Column, sure: Column, secondary: Column, least: float = 0.5) -> Column:
    """The first engine's text where it is sure enough, else the second's, else whatever the first has."""
    return F.coalesce(F.when((sure > least) & (F.trim(primary) != ""), primary), F.nullif(F.trim(secondary), F.lit("")), primary)


def first_tables(*found: Column, least: float = 50.0) -> Column:
    """Of several extractors' tables (accuracy, headers, rows) those of the first that has any good enough."""
    good = [F.filter(t, lambda x: F.coalesce(x["accuracy"], F.lit(100.0)) >= least) for t in found]
    return F.coalesce(*[F.when(F.size(g) > 0, g) for g in good], F.slice(found[0], 1, 0))


#: Folders with the lender and the kind of what they hold.
FOLDERS = {"axis": ("Axis", "eligibility"), "hdfc_pdfs": ("HDFC", "eligibility"), "icici": ("ICICI", "eligibility"), "sbi_pdfs": ("SBI", "eligibility"), "bankbazaar": ("BankBazaar", "comparison"), "paisabazaar": ("Paisabazaar", "comparison"), "rbi": ("RBI", "regulatory"), "misc": ("Unknown", "pdf")}


def folder_kinds(files: DataFrame) -> DataFrame:
    """files (path) with bank and doc_type by the folder they stand in; others are Unknown pdf."""
    folder = F.lower(F.regexp_extract("path", "([^/]+)/[^/]*$", 1))
    pick = lambda k, other: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for f, v in FOLDERS.items() for x in (f, v[k])]), folder), F.lit(other))
    return files.withColumns({"bank": pick(0, "Unknown"), "doc_type": pick(1, "pdf")})


def load_cache(spark: SparkSession, folder: str, now: Column, ttl: str = "6 hours", version: str = "v3.4:") -> DataFrame:
    """Cached answers (key, first_ts, ...) of this version that have not expired."""
    c = spark.read.parquet(folder)
    return c.filter(F.startswith("key", F.lit(version)) & (F.col("first_ts") > now - F.expr(f"interval {ttl}")))


def is_scanned(pages: DataFrame) -> DataFrame:
    """path, is_scanned: fewer than half of the first five pages hold 50 characters."""
    full = F.avg((F.length(F.trim("text")) >= 50).cast("int"))
    return pages.filter("page_number <= 5").groupBy("path").agg((full < 0.5).alias("is_scanned"))


def waterfall(*texts: Column, enough: tuple[int, ...]) -> Column:
    """The first fetched text that is long enough, else the longest."""
    first = F.coalesce(*[F.when(F.length(t) >= n, t) for t, n in zip(texts, enough, strict=True)])
    longest = F.array_max(F.array(*[F.struct(F.length(F.coalesce(t, F.lit(""))).alias("n"), t.alias("t")) for t in texts]))["t"]
    return F.coalesce(first, longest)


def seen(spark: SparkSession, path: str) -> DataFrame:
    """content_hash, source_url from lines `h:...` and `u:...`."""
    t = spark.read.text(path)
    value = F.substring("value", 3, 1 << 20)
    return t.select(F.when(F.startswith("value", F.lit("h:")), value).alias("content_hash"), F.when(F.startswith("value", F.lit("u:")), value).alias("source_url"))
