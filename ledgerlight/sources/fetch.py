"""Fetching: pages and search results through plugged transports, and the chain from pages to new records.

Nothing here opens a connection by itself. A transport is a function of an address that returns a status and a text; a
provider is a function of a query that returns titles, snippets and addresses. They run in Arrow batches, and rows of a
host stay in one task, so that a pause between requests holds for the host.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import records as R
from ..operators.html import host
from ..operators.pages import page_records

Transport = Callable[[str], tuple[int, str]]
Provider = Callable[[str], list[dict]]

# How often a request is tried, what is tried again, how long to wait, and what counts as a page.
TRIES, AGAIN, BACKOFF, PAUSE, LEAST = 3, (429, 500, 502, 503, 504), 1.5, (1.5, 4.0), 500
#: What is appended to a web search, and how many results are read.
SUFFIX, RESULTS = " India personal loan", 5
#: Fewer retrieved chunks than this are looked up on the web.
FEW = 2
FETCHED = "url string, html string, method string, status int, tries int"


@dataclass(frozen=True)
class Patience:
    """How a transport is asked; wait is called with seconds."""

    tries: int = TRIES
    backoff: float = BACKOFF
    pause: tuple[float, float] = PAUSE
    least: int = LEAST
    wait: Callable[[float], None] = time.sleep


def fetch(url: str, transports: dict[str, Transport], how: Patience) -> tuple[str | None, str, int, int]:
    """html, method, status, tries: the first transport that gives a whole page; each is asked again while its status
    says that it may help. What raises counts as status 0."""
    status, asked = 0, 0
    for name, transport in transports.items():
        for k in range(how.tries):
            asked += 1
            how.wait(random.uniform(*how.pause) if k == 0 else how.backoff * 2 ** (k - 1))
            try:
                status, text = transport(url)
            except Exception:  # a transport may fail in any way; the next one is asked
                status, text = 0, ""
            if status == 200 and len(text) > how.least:
                return text, name, status, asked
            if status and status not in AGAIN:
                break
    return None, "failed", status, asked


def fetched(urls: DataFrame, transports: dict[str, Transport], how: Patience = Patience()) -> DataFrame:
    """FETCHED for each url; html is null where no transport gave a page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(u, *fetch(u, transports, how)) for u in b["url"]]
            yield pd.DataFrame(rows, columns=["url", "html", "method", "status", "tries"])

    return urls.select("url").repartition(host(F.col("url"))).mapInPandas(run, FETCHED)


def searched(queries: DataFrame, providers: list[Provider] | None = None, most: int = RESULTS) -> DataFrame:
    """query_id, results (title, snippet, url) of the first provider that has any; without providers none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for q in b["query"]:
                found: list[dict] = []
                for provider in providers or []:
                    try:
                        found = provider(f"{q}{SUFFIX}")[:most]
                    except Exception:  # a provider that is down has no results
                        found = []
                    if found:
                        break
                out.append([{k: str(r.get(k, "")) for k in ("title", "snippet", "url")} for r in found])
            yield pd.DataFrame({"query_id": b["query_id"], "results": out})

    return queries.select(F.col("query_id").cast("string").alias("query_id"), "query").mapInPandas(run, "query_id string, results array<struct<title:string,snippet:string,url:string>>")


def to_search(queries: DataFrame, retrieved: DataFrame, few: int = FEW) -> DataFrame:
    """The queries for which too few chunks were retrieved."""
    enough = retrieved.groupBy("query_id").count().filter(F.col("count") >= few)
    return queries.join(enough, "query_id", "left_anti")


def chosen_seeds(seeds: DataFrame, bank: str | None = None, dry: int | None = None) -> DataFrame:
    """Seeds (url) whose address holds a lender's name, in order; of a dry run the first few."""
    some = seeds if bank is None else seeds.filter(F.contains(F.lower("url"), F.lit(bank.lower())))
    return some.orderBy("url").limit(dry) if dry is not None else some


def new_records(pages: DataFrame, seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, rejected): pages read, named after their lender, validated, without what was seen before and without
    repeats of a content or an address. seen: content_hash, source_url."""
    checked = R.validated(page_records(pages).withColumn("id", F.col("page_id")))
    valid = checked.filter("valid")
    fresh = R.distinct_records(valid if seen is None else R.unseen(valid, seen))
    return fresh, checked.filter("not valid").select("page_id", "source_url", "issues")
