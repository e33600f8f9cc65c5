"""The engine's own operators: fixtures with known results, files, streams, and every query against its SQL."""

import json

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlight.catalogue import ORACLES, QUERIES
from ledgerlight.functions import extract as X
from ledgerlight.functions import plug, tables
from ledgerlight.functions import uploads as U
from ledgerlight.operators import chunking as C
from ledgerlight.operators import html as H
from ledgerlight.operators import pages as P
from ledgerlight.operators import records as R
from ledgerlight.operators import retrieval
from ledgerlight.operators import rules
from ledgerlight.sources import fetch, files, sinks
from ledgerlight.sources.rules import default_rules, read_rules

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PROFILE = "profile_id string, age double, monthly_income double, credit_score double, employment_type string, work_experience_months double, dti_ratio double"


@pytest.fixture(scope="module")
def known(spark):
    rows = [("strong", 30.0, 55000.0, 760.0, "salaried", 36.0, 0.20), ("borderline", 26.0, 28000.0, 705.0, "salaried", 20.0, 0.38), ("below", 24.0, 12000.0, 650.0, "salaried", 8.0, None), ("missing", 28.0, 40000.0, None, None, None, None), ("nothing", None, None, None, None, None, None)]
    return rules.evaluate(spark.createDataFrame(rows, PROFILE), default_rules())


def test_known_profiles(known):
    got = {(r.profile_id, r.bank): r for r in rules.by_bank(known).collect()}
    # lenders in order: axis, hdfc, icici, sbi; borderline: score fails at axis and sbi, income and experience at icici
    want = {"strong": (7, 7, 7, 7), "borderline": (6, 7, 5, 6), "below": (4, 4, 4, 4), "missing": (6, 6, 5, 6)}
    for name, counts in want.items():
        assert tuple(got[name, b].n_pass for b in ("axis", "hdfc", "icici", "sbi")) == counts
    decisions = {r.profile_id: r for r in rules.reason(known).collect()}
    assert {k: v.decision for k, v in decisions.items()} == {"strong": "Eligible", "borderline": "Partially Eligible", "below": "Not Eligible", "missing": "Not Eligible", "nothing": "Insufficient Data"}
    assert decisions["strong"].best_bank == "axis" and decisions["borderline"].best_bank == "hdfc" and decisions["strong"].confidence == 0.99


def test_rules_from_files_and_errors(spark, tmp_path):
    (tmp_path / "newbank.yaml").write_text("bank: New\nloan_type: home\nlogic: any\nrules:\n- {id: a, field: age, operator: '>=', value: 21, message: m}\n- {id: e, field: employment_type, operator: not_in, value: [unemployed]}\n- {id: x, field: age, operator: '~', value: 3}\n- {id: n, field: employment_type, operator: '>', value: 3}\n")
    got = read_rules(str(tmp_path))
    assert [(r.bank, r.logic, r.operator) for r in got] == [("newbank", "any", ">="), ("newbank", "any", "not_in"), ("newbank", "any", "~"), ("newbank", "any", ">")]
    p = spark.createDataFrame([("a", 30.0, 1.0, 1.0, "salaried", 1.0, 0.1), ("b", 20.0, 1.0, 1.0, "unemployed", 1.0, 0.1)], PROFILE)
    rows = {(r.profile_id, r.rule_id): r.status for r in rules.long(rules.evaluate(p, got)).collect()}
    assert [rows["a", k] for k in "aexn"] == ["pass", "pass", "error", "error"] and [rows["b", k] for k in "ae"] == ["fail", "fail"]
    assert {r.profile_id: r.eligible for r in rules.by_bank(rules.evaluate(p, got)).collect()} == {"a": True, "b": False}


def test_the_engine_does_not_shuffle(known):
    plan = rules.reason(known)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize(("text", "want"), [("am I eligible for axis loan, age 28, salary 40k, cibil 750", ("eligibility", "Axis", 40000.0, 750, 28)), ("compare hdfc and sbi for 30k salary", ("comparison", "HDFC,SBI", 30000.0, None, None)), ("5 lpa freelancer", ("general", "", 41666.67, None, None)), ("dti of 40% cibil 720", ("eligibility", "", None, 720, None)), ("what score do i need", ("eligibility", "", None, None, None))])
def test_queries(spark, text, want):
    s = F.col("s")
    r = spark.createDataFrame([(text,)], "s string").select(X.intent(s), F.array_join(X.lenders(s), ","), X.income(s), X.credit_score(s), X.age(s)).first()
    assert tuple(r) == want


@pytest.mark.parametrize(("f", "text", "want"), [(X.rate_range, "10.49% – 24%", [10.49, 24.0]), (X.rate_range, "10.5 to 21%", [10.5, 21.0]), (X.rate_range, "Starting 10.5%", [10.5, 10.5]), (X.tenure_months, "5 years", 60), (X.tenure_months, "84 months", 84), (X.tenure_range, "12–84 months", [12, 84]), (X.tenure_range, "1 to 5 years", [12, 60]), (X.age_range, "21 to 60 years", [21, 60]), (X.age_range, "Minimum 21 years", [21, 65]), (X.money, "₹10 lakh", 1000000.0), (U.pan_masked, "PAN ABCDE1234F", "ABCDE****F")])
def test_values(spark, f, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(f(F.col("s"))).first()[0] == want


def test_tenure_as_coded(spark):
    assert spark.createDataFrame([("12–84 months",)], "s string").select(X.tenure_range(F.col("s"), as_coded=True)).first()[0] == [84, 144]


def test_tables_and_chunks(spark):
    rows = F.array(F.array(F.lit("Interest Rate"), F.lit("10.49% per annum")))
    assert spark.range(1).select(tables.sentences(F.array(F.lit("Feature"), F.lit("Value")), rows)).first()[0] == ["Interest Rate: 10.49% per annum."]
    text = " ".join(f"w{i} w w w w w w w w end." for i in range(100))
    c = [r.text.split() for r in C.chunks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("chunk_id").collect()]
    assert len(c) > 2 and all(len(x) <= 400 for x in c)
    assert all(b[:75] == a[-75:] for a, b in zip(c, c[1:]))


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "axis_pdfs").mkdir()
    (tmp_path / "axis_pdfs/a.txt").write_text("word " * 20)
    (tmp_path / "axis_pdfs/short.txt").write_text("too short")
    (tmp_path / "axis_pdfs/r_scraped.json").write_text(json.dumps({"bank": "Axis", "source_url": "u", "content": "c" * 60, "features": ["short", "f" * 30], "key_facts": ["k" * 21], "confidence": 0.5}))
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache/x.json").write_text(json.dumps({"source": "s.pdf", "bank": "Axis", "chunks": [{"text": "t", "chunk_id": 1, "source": "s.pdf"}]}))
    t = files.text_files(spark, str(tmp_path)).collect()
    assert [(r.bank, len(r.text.split())) for r in t] == [("Axis", 20)]
    assert files.scraped(spark, str(tmp_path)).first().text == "c" * 60 + " " + "f" * 30 + " " + "k" * 21
    cache = files.cached_chunks(spark, str(tmp_path / "cache"))
    assert cache.first().chunk_id == 1
    assert files.pending(spark.createDataFrame([("s.pdf",), ("n.pdf",)], "path string"), cache).first().path == "n.pdf"
    up = files.uploads(spark, str(tmp_path / "axis_pdfs"))
    assert up.count() == 2
    pages = files.pages_of(up, lambda raw: [raw.decode(), ""], lambda raw, k: "x" * 60)
    assert {(r.page_number, r.method) for r in pages.collect()} == {(1, "text"), (1, "recognised"), (2, "recognised")}
    assert not any(r.is_scanned for r in files.is_scanned(pages).collect())
    rec = spark.createDataFrame([(1, "b", "personal", "https://x", [1.0, 2.0], [], [], [], [], [], 3.0, 700, None, None, None, "c" * 120)], "id long, bank string, loan_type string, source_url string, interest_rate array<double>, loan_amount array<double>, age_range array<int>, tenure array<int>, features array<string>, employment_type array<string>, min_income double, min_cibil int, processing_fee double, processing_fee_pct double, min_experience int, content string")
    sinks.save_records(rec, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/records")).count() == 1
    sinks.save_summary(rec, str(tmp_path / "summary"))
    hashed = rec.withColumn("content_hash", F.sha2("content", 256))
    sinks.remember(hashed, str(tmp_path / "seen"))
    assert R.unseen(hashed, files.seen(spark, str(tmp_path / "seen"))).count() == 0
    c = spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "chunk_id long, text string")
    sinks.save_index(c, c.select("chunk_id", plug.hashed(F.col("text")).alias("v")), str(tmp_path / "index"))
    assert sinks.load_index(spark, str(tmp_path / "index"))["postings"].count() == 3


def test_plugged_encoder_and_rerank(spark):
    d = spark.createDataFrame([("q", 1, "alpha", 1), ("q", 2, "alpha alpha beta", 2)], "query_id string, id long, text string, rank int")
    enc = plug.encoder(lambda texts: np.array([[len(t), 1.0] for t in texts]))
    assert abs(np.linalg.norm(d.select(enc("text")).first()[0]) - 1) < 1e-6
    assert abs(np.linalg.norm(d.select(plug.hashed(F.col("text"))).first()[0]) - 1) < 1e-5
    d = d.withColumn("q", F.lit("which of these is longer"))
    got = plug.rerank(d, lambda q, t: F.length(t).cast("double"), "q", "text", 1).collect()
    assert [(r.id, r.score) for r in got] == [(2, 1.0)]
    assert [r.id for r in plug.rerank(d, lambda q, t: F.length(t).cast("double"), "text", "text", 1).collect()] == [1]  # too few words
    assert [r.id for r in plug.rerank(d, None, "q", "text", 1).collect()] == [1]


def test_patient_and_first_encoders(spark):
    calls, waits = [], []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return np.ones((len(texts), 4))

    assert plug.patient(flaky, wait=waits.append)(["a"]).shape == (1, 4) and waits == [2.0, 4.0]

    def broken(texts):
        raise plug.Fatal

    with pytest.raises(plug.Fatal):
        plug.patient(broken, wait=waits.append)(["a"])
    assert len(waits) == 2
    assert plug.first_working({"x": broken, "y": lambda t: np.ones((len(t), 7))})[:2] == ("y", 7)
    assert {r.name: r.available for r in plug.availability(spark, ("numpy", "nothing_of_that_name")).collect()} == {"numpy": True, "nothing_of_that_name": False}


def test_fetching_and_new_records(spark):
    page = "<html><body><main><h1>Loan</h1><p>" + "Interest rate 9% to 11% for a loan. " * 20 + "{}</p></main></body></html>"

    def plain(url):
        if "down" in url:
            raise OSError
        return (404, "") if "gone" in url else (503, "") if "busy" in url else (200, page.format(url) if "same" not in url else page)

    archive = lambda url: (200, page.format(url)) if "gone" in url else (200, "short")
    urls = spark.createDataFrame([(f"https://{h}.org/{k}",) for k, h in enumerate(("a", "gone", "busy", "down", "same1", "same2"))], "url string")
    got = {r.url.split("//")[1].split(".")[0]: r for r in fetch.fetched(urls, {"plain": plain, "archive": archive}, fetch.Patience(pause=(0, 0), backoff=0, wait=lambda s: None)).collect()}
    assert [(got[k].method, got[k].tries) for k in ("a", "gone", "busy", "down")] == [("plain", 1), ("archive", 2), ("failed", 4), ("failed", 4)]
    pages = spark.createDataFrame([(k, r.url, r.html) for k, r in enumerate(sorted(got.values()))], "page_id long, url string, html string")
    new, rejected = fetch.new_records(pages)
    assert sorted(r.source_url.split("//")[1][:4] for r in new.collect()) == ["a.or", "gone", "same"] and rejected.count() == 2
    seen = new.select("content_hash", "source_url")
    assert fetch.new_records(pages, seen)[0].count() == 0
    q = spark.createDataFrame([("1", "rates"), ("2", "fees")], "query_id string, query string")
    assert [len(r.results) for r in fetch.searched(q).collect()] == [0, 0]
    found = fetch.searched(q, [lambda x: [], lambda x: [{"title": x, "snippet": "s", "url": "u"}] * 9]).collect()
    assert all(len(r.results) == 5 and r.results[0].title.endswith("India personal loan") for r in found)
    told = spark.createDataFrame(found).select(X.search_context(F.col("results"))).first()[0]
    assert told.startswith("[Web Search Results]\n\n1. rates India personal loan\n   s\n   Source: u\n\n2.")
    hits = spark.createDataFrame([("1", 7), ("1", 8), ("2", 9)], "query_id string, id long")
    assert [r.query_id for r in fetch.to_search(q, hits).collect()] == ["2"]
    assert fetch.chosen_seeds(urls, "SAME").count() == 2 and fetch.chosen_seeds(urls, dry=3).count() == 3


def test_decoders_tables_cache_and_artefacts(spark, tmp_path):
    pages = spark.createDataFrame([("f", 1, "one", "text")], files.PAGES)
    more = spark.createDataFrame([("f", 1, " one ", "other"), ("f", 2, "two", "other"), ("f", 3, "", "other")], files.PAGES)
    assert [r.text for r in files.with_unseen(pages, more).orderBy("page_number").collect()] == ["one", "two"]
    got = spark.createDataFrame([("a", 0.9, "b"), ("a", 0.1, "b"), ("a", 0.1, "")], "p string, c double, s string").select(files.recognised(F.col("p"), F.col("c"), F.col("s"))).collect()
    assert [r[0] for r in got] == ["a", "b", "a"]
    t = spark.createDataFrame([([(40.0, ["x"])], [(90.0, ["y"]), (10.0, ["z"])])], "a array<struct<accuracy:double,headers:array<string>>>, b array<struct<accuracy:double,headers:array<string>>>")
    assert [x.headers for x in t.select(files.first_tables(F.col("a"), F.col("b"))).first()[0]] == [["y"]]
    kinds = files.folder_kinds(spark.createDataFrame([("/d/rbi/x.pdf",), ("/d/else/y.pdf",)], "path string")).collect()
    assert [(r.bank, r.doc_type) for r in kinds] == [("RBI", "regulatory"), ("Unknown", "pdf")]
    c = spark.sql("select * from values ('v3.4:a', timestamp '2024-01-01 00:00:00', 1), ('v3.4:a', timestamp '2024-01-01 05:00:00', 2), ('v3.4:b', timestamp '2023-01-01 00:00:00', 3), ('v1:c', timestamp '2024-01-01 05:00:00', 4) as t(key, first_ts, answer)")
    sinks.save_cache(c, str(tmp_path / "cache"))
    assert [r.answer for r in files.load_cache(spark, str(tmp_path / "cache"), F.lit("2024-01-01 06:00:00").cast("timestamp")).collect()] == [2]
    sinks.save_artefacts(spark.createDataFrame([("h1", "raw", "{}", None)], "file_hash string, raw_text string, structured string, result string"), str(tmp_path / "up"))
    assert (tmp_path / "up/raw_text/file_hash=h1").exists() and not (tmp_path / "up/result/file_hash=h1").exists()
    assert sinks.save_apart(spark.createDataFrame([("Axis", "u"), ("", "u"), ("SBI", None)], "bank string, source_url string"), str(tmp_path / "apart")) == (1, 2)


def test_html(spark):
    page = "<html><head><title> T </title></head><body><nav>no</nav><h2>Eligibility</h2><p>age 21</p><ul><li>one</li></ul><a href='/a'>x</a><a href='b.html'>y</a><a href='#z'>z</a><a href='https://other.org/'>o</a></body></html>"
    p = spark.createDataFrame([(1, "https://h.org/dir/p", page)], "page_id long, url string, html string")
    assert p.select(H.title(F.col("html"))).first()[0] == "T" and "no" not in p.select(H.body(F.col("html"))).first()[0].split()
    assert [r.link for r in H.links(p).orderBy("pos").collect()] == ["https://h.org/a", "https://h.org/dir/b.html"]
    assert p.select(P.sections("html")).first()[0][0].asDict() == {"heading": "Eligibility", "text": "age 21 one x y z o", "items": ["one"]}


def test_page_records_of_odd_pages(spark):
    compared = "<table><thead><tr><th>Bank</th><th>Interest Rate</th><th>Fee</th></tr></thead>" + "".join(f"<tr><td>B{k}<td>{10 + k}.5% - {20 + k}%<td>{'2%' if k else ''}</tr>" for k in range(12)) + "</table>"
    structured = '<script type="application/ld+json">{"a": {"b": ["Interest rate 9% to 11% for a personal loan", 5]}, "c": "short"}</script><script type="application/ld+json">{broken</script>'
    page = lambda body: f"<html><body><nav><table><tr><td>no</td></tr></table></nav>{body}</body></html>"
    rows = [(1, "https://www.paisabazaar.com/p", page("<p>" + "x " * 2000 + "</p>" + compared)), (2, "https://h.org/p", page(structured + "<p>13%</p>")), (3, "https://h.org/q", "<p>un<b>closed <li>a<li>b<table><tr><td>1<td>2<tr><td>3"), (4, "https://h.org/s", None), (5, None, ""), (6, "https://www.icicibank.com/x", page("<h1>Only</h1>" + "<div>" * 300 + "deep"))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in P.page_records(frame).collect()}
    assert len(got) == 6
    assert got[1].key_facts[-12:] == [f"Bank: B{k} | Interest Rate: {10 + k}.5% - {20 + k}%" + (" | Fee: 2%" if k else "") for k in range(12)] and got[1].content.startswith("Bank | Interest Rate | Fee\nB0")
    assert got[2].interest_rate == [9.0, 11.0] and got[2].extraction_method == "jsonld,body"
    assert {r.page_id: r.interest_rate for r in P.page_records(frame, structured=False).collect()}[2] == [13.0, 13.0]
    assert got[3].content.split() == "un closed a b 1 2 3".split() and got[4].content == "" and got[5].bank == "Unknown" and "deep" in got[6].content


def test_updates_of_several_batches_hold_the_last(spark, tmp_path):
    from ledgerlight.streaming import state

    for k in range(3):
        spark.createDataFrame([(u, k * 10 + u, f"2024-01-01 0{k}:00:00", "view") for u in ((1, 2) if k < 2 else (1,))], "user_id long, event_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got = {r.user_id: (r.n, r.last_id) for r in state.stream_memory(spark, str(tmp_path / "events.parquet"), files=1).collect()}
    assert got == {1: (3, 21), 2: (2, 12)}
    cache = {r.key: (r.hits, r.misses) for r in state.stream_cache(spark, str(tmp_path / "events.parquet"), ttl=5400, files=1).collect()}
    assert cache == {"v3.4:view:1": (1, 2), "v3.4:view:2": (1, 1)}


def test_pack_stops_at_the_first_overflow(spark):
    d = spark.createDataFrame([(1, "a " * 5), (2, "a " * 9), (3, "a")], "id long, text string").withColumn("k", F.lit(1))
    assert [r.id for r in retrieval.pack(d, ["k"], ["id"], 6).collect()] == [1]


def _cell(x):
    if x is None or x is pd.NA or x is pd.NaT or x != x:
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, float, np.integer, np.floating)):
        return round(float(x), 6)
    return str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted([tuple(map(_cell, r)) for r in d[sorted(d.columns)].astype(object).itertuples(index=False)], key=str)
    assert rows(got) == rows(want)
