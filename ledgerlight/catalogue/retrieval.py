"""Queries over chunking, sparse and dense retrieval, fusion, packing and the cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as X
from ..operators import chunking as C
from ..operators import numbering as N
from ..operators import retrieval as R
from ..operators.rules import retrieval_confidence
from . import cases
from .registry import query, table
from .texts import _HINTS, _first, _listed, _says

_HINTED = {
    "monthly_income": "income|salary|earning|ctc|lpa", "credit_score": r"cibil|credit\s*score|credit\s*rating", "age": r"\bage\b|years\s*old|minimum\s*age|maximum\s*age", "dti_ratio": "dti|debt.to.income|emi.*income|obligations", "employment_type": "employment|salaried|self.employed|professional",
    "work_experience_months": "experience|work.*month|tenure|service", "interest_rate": r"interest\s*rate|roi|rate\s*of\s*interest", "loan_amount": r"loan\s*amount|principal|disburs", "fees": r"processing\s*fee|charges|fees", "tenure": "repayment|tenure|emi|instalment",
}
_WORDS = "len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+'))".replace("\\t", "\t").replace("\\n", "\n").replace("\\r", "\r").replace("\\f", "\f")
_TOK = "regexp_extract_all(lower(text), '[a-z0-9₹%.,\\-]+')"

_BM25 = f"""with w as (select doc_id as id, {_TOK} as w from documents), l as (select id, len(w) as dl from w), t as (select count(*) as n_docs, avg(dl) as avg_dl from l),
x as (select id, unnest(w) as term from w), p as (select term, id, count(*) as tf from x group by 1, 2), d as (select term, count(*) as df, ln((any_value(n_docs) - count(*) + 0.5e0) / (count(*) + 0.5e0) + 1) as idf from p cross join t group by 1),
a as (select item_id as query_id, unnest({_TOK}) as term from benchmark), b as (select query_id, term, count(*) as times from a group by 1, 2),
s as (select query_id, id, round(sum(times * idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avg_dl))), 6) as score from b join d using (term) join p using (term) join l using (id) cross join t group by 1, 2),
k as (select *, cast(row_number() over (partition by query_id order by score desc, id) as int) as rank from s where score > 0)
"""

_DENSE = """with q as (select vec_id as query_id, embedding as q from embeddings where vec_id % 100 = 0),
s as (select query_id, vec_id as id, label, round(list_inner_product(cast(embedding as double[]), cast(q as double[])), 6) as score from embeddings cross join q)
"""


def _bm25(spark, sf_dir):
    return R.Bm25(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v")), e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query(_BM25 + "select term, df, round(idf, 6) as idf from d")
def q20_bm25_stats(spark, sf_dir):
    return _bm25(spark, sf_dir)[0].idf.select("term", "df", F.round("idf", 6).alias("idf"))


@query(_BM25 + "select query_id, id, score, rank from k where rank <= 10")
def q21_bm25_topk(spark, sf_dir):
    index, asked = _bm25(spark, sf_dir)
    return index.best(asked, "item_id", "text", 10).select("query_id", "id", "score", "rank")


@query(_DENSE + "select * from (select query_id, id, score, cast(row_number() over (partition by query_id order by score desc, id) as int) as rank from s where score > 0) where rank <= 10")
def q22_dense_topk(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return R.dense_top(v, q, 10).select("query_id", "id", "score", "rank")


@query(_DENSE + "select * from (select query_id, id, score, cast(row_number() over (partition by query_id order by score desc, id) as int) as rank from s where score > 0 and label in (1, 2, 3)) where rank <= 5")
def q23_dense_filter_before(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return R.dense_top(v, q, 5, F.col("label").isin(1, 2, 3)).select("query_id", "id", "score", "rank")


@query(_DENSE + ", a as (select *, row_number() over (partition by query_id order by score desc, id) as r from s where score > 0) select * from (select query_id, id, score, cast(row_number() over (partition by query_id order by score desc, id) as int) as rank from a where r <= 50 and label in (1, 2, 3)) where rank <= 5")
def q24_dense_filter_after(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return R.dense_top(v, q, 5, F.col("label").isin(1, 2, 3), after=True).select("query_id", "id", "score", "rank")


# the dense queries stand for the benchmark's items: every 100th vector, numbered
_NUMBERED = _DENSE.replace("select vec_id as query_id", "select vec_id // 100 as query_id")
_RRF = _BM25.replace("with w as", _NUMBERED.rstrip().replace("s as (", "ds as (") + ", w as", 1) + """, dr as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from ds where score > 0),
u as (select query_id, id, 1.2e0/(60+rank) as s from dr where rank <= 20 union all select query_id, id, 1.0e0/(60+rank) from k where rank <= 20), f as (select query_id, id, round(sum(s), 6) as score from u group by 1, 2)
"""


def _rankings(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    index, asked = _bm25(spark, sf_dir)
    return R.dense_top(v, q.withColumn("query_id", F.expr("query_id div 100")), 20), index.best(asked, "item_id", "text", 20)


@query(_RRF + "select query_id, id, score from f")
def q25_rrf(spark, sf_dir):
    return R.fuse(*_rankings(spark, sf_dir))


_WISH = cases.pick(cases.ASKED, "item_id")


@query(_RRF + f""", tt as (select *, row_number() over (partition by query_id order by score desc, id) as r from f), aa as (select item_id as query_id, {_listed([(n, _says('s', p)) for n, p in _HINTS])} as hints from (select item_id, {_WISH} as s from benchmark)),
h as (select tt.query_id, tt.id, r, field, dr.score as cosine, case when coalesce(list_contains(hints, field), false) then round(least(tt.score + 0.15e0, 1e0), 6) else tt.score end as score from tt join (select doc_id, {_first('text', _HINTED, chr(39) * 2)} as field from documents) d on d.doc_id = tt.id left join aa on aa.query_id = tt.query_id left join dr on dr.query_id = tt.query_id and dr.id = tt.id and dr.rank <= 20 where r <= 20)
select query_id, id, field, cosine, score, cast(row_number() over (partition by query_id order by score desc, r) as int) as rank from h qualify rank <= 10""")
def q26_hint_boost(spark, sf_dir):
    dense, sparse = _rankings(spark, sf_dir)
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), X.hints(F.expr(_WISH)).alias("hints"))
    best = R.retrieve(dense, sparse, X.computed(chunks, "field_hint", C.field_hint(F.col("text"))).drop("text"), asked, 10)
    return best.select("query_id", "id", F.col("field_hint").alias("field"), "cosine", F.col("rank_score").alias("score"), "rank")


@query(_DENSE + ", k as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s where score > 0 qualify rank <= 20) select query_id, id, case when max(score) over w = min(score) over w then 1e0 else round((score - min(score) over w) / (max(score) over w - min(score) over w), 6) end as scaled from k window w as (partition by query_id)")
def q27_minmax(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return R.minmax(R.dense_top(v, q, 20)).select("query_id", "id", "scaled")


@query("select * from (select *, row_number() over (partition by lower(trim(substr(text, 1, 80), ' ')) order by doc_id) as k from (select doc_id, source, text from documents)) where k = 1".replace("select * from (", "select doc_id, source from (", 1))
def q28_prefix_distinct(spark, sf_dir):
    return R.distinct_prefixes(table(spark, sf_dir, "documents"), [], ["doc_id"]).select("doc_id", "source")


@query(f"with d as (select *, coalesce(try_cast(substr(source, 4) as int), 10) as pri, {_WORDS} as n from documents), s as (select lang, doc_id, sum(n) over (partition by lang order by pri, doc_id rows unbounded preceding) as words_so_far from d) select lang, doc_id, cast(words_so_far as bigint) as words_so_far from s where words_so_far <= 3000")
def q29_context_pack(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("pri", F.coalesce(F.substring("source", 4, 9).try_cast("int"), F.lit(10)))
    return R.pack(d, ["lang"], ["pri", "doc_id"]).select("lang", "doc_id", "words_so_far")


_OWN = "(case doc_id % 9 when 0 then 'Axis' when 1 then 'RBI' when 2 then 'Paisabazaar' when 3 then 'BankBazaar' when 4 then 'SBI' else 'Other' end)"
_NO_PREFIX = "lower(trim(substr(text, 1, 80), ' '))"


@query(f"""with d as (select doc_id % 40 as topic, doc_id, {_OWN} as bank, text from documents where text is not null), p as (select *, case bank when 'Axis' then 1 when 'SBI' then 1 when 'RBI' then 2 when 'Paisabazaar' then 3 when 'BankBazaar' then 3 else 10 end as pri from d), u as (select *, '[Source: ' || bank || ' | pdf]' || chr(10) || text as block from p qualify row_number() over (partition by topic, {_NO_PREFIX} order by pri, doc_id) = 1),
s as (select *, sum({_WORDS.replace('text', 'block')}) over (partition by topic order by pri, doc_id rows unbounded preceding) as so_far from u) select topic, md5(string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by pri, doc_id)) as context, count(*) as n from s where so_far <= 3000 group by 1""")
def q2a_context(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null").select((F.col("doc_id") % 40).alias("topic"), "doc_id", F.expr(_OWN).alias("bank"), F.lit("pdf").alias("doc_type"), "text")
    c = R.context(d, ["topic"], ["doc_id"])
    return c.select("topic", F.md5("context").alias("context"), (F.size(F.split("context", "\n\n---\n\n"))).cast("bigint").alias("n"))


@query(_DENSE + "select query_id, id, score from (select *, row_number() over (partition by query_id order by score desc, id) as r from s where score > 0 and id % 100 <> 0) where r = 1 and score >= 0.3")
def q30_cache_probe(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return R.probe_cache(v.filter("id % 100 <> 0"), q, 0.3).select("query_id", "id", "score")


@query("with e as (select cast(user_id as varchar) as key, min(ts) as first_ts from events group by 1), m as (select max(ts) as now from events) select key, first_ts from e cross join m where first_ts > now - interval 60 day order by first_ts desc, key limit 50")
def q31_cache_evict(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    entries = e.groupBy(F.col("user_id").cast("string").alias("key")).agg(F.min("ts").alias("first_ts"))
    now = e.agg(F.max("ts").alias("now"))
    return R.evict(entries.crossJoin(F.broadcast(now)), 50, "60 days", F.col("now")).select("key", "first_ts")  # now: one row


_SENT = "string_split(regexp_replace(text, '([.!?])[ \t\n\r\f]+', '\\1' || chr(1), 'g'), chr(1))"


@query(f"select doc_id, len({_SENT}) as n_sentences from documents")
def q32_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(C.sentences(F.col("text"))).cast("bigint").alias("n_sentences"))


_SPLIT = f"""with recursive s as (select doc_id as doc, {_SENT} as ss from documents), w as (select doc, list_transform(ss, lambda x: list_filter(regexp_split_to_array(x, '[ \t\n\r\f]+'), lambda y: y <> '')) as ws from s),
f as (select doc, ws, 0 as i, cast([] as varchar[]) as cur, cast([] as varchar[]) as out from w
 union all select doc, ws, i + 1, case when len(cur) > 0 and len(cur) + len(ws[i+1]) > 400 then list_concat(cur[greatest(len(cur) - 74, 1):], ws[i+1]) else list_concat(cur, ws[i+1]) end, case when len(cur) > 0 and len(cur) + len(ws[i+1]) > 400 then list_append(out, array_to_string(cur, ' ')) else out end from f where i < len(ws)),
e as (select doc, case when len(cur) > 0 then list_append(out, array_to_string(cur, ' ')) else out end as out from f where i = len(ws)),
u as (select doc, unnest(out) as text, unnest(range(len(out))) as chunk_id from e),
c as (select doc, cast(chunk_id as int) as chunk_id, text, len(string_split(text, ' ')) as n_words, substr(md5(text), 1, 12) as hash from u where len(string_split(text, ' ')) >= 20)
"""


@query(_SPLIT + "select doc, chunk_id, cast(n_words as int) as n_words, hash from c")
def q33_chunks(spark, sf_dir):
    return C.chunks(table(spark, sf_dir, "documents")).select("doc", "chunk_id", "n_words", "hash")


@query(_SPLIT + "select doc, chunk_id, hash from (select *, row_number() over (partition by hash order by doc, chunk_id) as k from c) where k = 1")
def q34_chunk_distinct(spark, sf_dir):
    return C.distinct_chunks(C.chunks(table(spark, sf_dir, "documents"))).select("doc", "chunk_id", "hash")


_KINDS = {
    "eligibility": "eligib|criteria|qualify|minimum|required|age|income|salary", "interest_rate": r"interest\s*rate|roi|% p\.?a|per\s*annum|bps", "table": r"\|", "regulatory": r"rbi|reserve\s*bank|circular|guideline|regulation|compliance",
    "comparison": r"vs\.?\s|compared?\s*to|better\s*than|paisabazaar|bankbazaar", "fees": r"processing\s*fee|charge|penalty|foreclosure|prepayment",
}
_HEADING = r"^(eligibility|criteria|features?|benefits?|fees?|charges?|interest rate|documentation|documents\s*required|terms?\s*and\s*conditions?|who\s*can\s*apply|about|overview|summary)\b"
_NOTES = (
    "Eligibility\nminimum age {a}", "CIBIL {n} and more", "Processing fee {a}%", "tenure {n} months", "Fees and charges of all kinds\npenalty", "salaried only", "years old", "debt to income", "the emi and the income", "interest rate of {a}% p.a.", "roi bps", "loan amount, principal", "repayment by instalment", "a | b",
    "RBI circular {n}", "better than others vs. them", "prepayment", "Overview of a very long title that goes on and on and on until it is no longer a title at all, {n}", "summary", "nothing", "credit rating of service", "foreclosure",
)
_PATHS = ("/data/paisabazaar/x.txt", "/data/arbiter/y.txt", "/data/z.pdf", "/data/z.pdf", "/data/z.pdf")
_NOTE = cases.pick(_NOTES, "p_partkey").replace("\n", "' || chr(10) || '")
_PATH = cases.pick(_PATHS, "p_partkey")
_LINE = "trim(string_split(trim(text), chr(10))[1])"


@query(f"with t as (select p_partkey as id, {_NOTE} as text, {_PATH} as source from part) select id, {_first('text', _HINTED, chr(39) * 2)} as hint, case when contains(source, 'paisabazaar') or contains(source, 'bankbazaar') then 'comparison' when contains(source, 'rbi') then 'regulatory' else {_first('text', _KINDS, chr(39) + 'pdf' + chr(39))} end as kind, case when length({_LINE}) < 80 and regexp_matches({_LINE}, '(?i){_HEADING}') then {_LINE} end as title from t")
def q35_field_hint(spark, sf_dir):
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(F.array(F.expr(_NOTE))).alias("text"), F.expr(_PATH).alias("source"))
    return t.select("id", C.field_hint(F.col("text")).alias("hint"), C.chunk_type(F.col("text"), F.col("source")).alias("kind"), C.section_title(F.col("text")).alias("title"))


@query("with t as (select conv_id, turn, case when role = 'system' then 'S' || conv_id || '-' || turn end as title from conversations) select conv_id, turn, last_value(title ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) as section from t")
def q36_section_carry(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").withColumn("title", F.expr("case when role = 'system' then 'S' || conv_id || '-' || turn end"))
    return C.carry_titles(t, "conv_id", "turn").select("conv_id", "turn", "section")


@query("select source, count(*) as n, arg_max(lang, doc_id) as last_lang, left(arg_min(text, doc_id), 120) as sample from documents group by source")
def q37_source_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.max_by("lang", "doc_id").alias("last_lang"), F.substring(F.min_by(F.substring("text", 1, 120), "doc_id"), 1, 120).alias("sample"))


@query("with d as (select doc_id, case when lang = 'en' then 'a' else 'b' end as part from documents) select doc_id, cast(row_number() over (order by part, doc_id) - 1 as int) as idx from d")
def q38_union_renumber(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    both = d.filter("lang = 'en'").select("doc_id", F.lit("a").alias("part")).unionByName(d.filter("lang <> 'en'").select("doc_id", F.lit("b").alias("part")))
    return N.number(both, "part", "doc_id").select("doc_id", F.col("idx").cast("int").alias("idx"))


@query(_BM25 + "select query_id, round_even(case when count(*) = 0 then 0.1e0 else least(0.60e0 + round_even(least(sum(score order by rank) / count(*), 1e0), 3) * 0.20e0, 0.84e0) end, 2) as confidence from k where rank <= 5 group by 1")
def q39_retrieval_confidence(spark, sf_dir):
    index, asked = _bm25(spark, sf_dir)
    best = index.best(asked, "item_id", "text", 5).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
    return best.select("query_id", retrieval_confidence(F.col("scores"), F.size("scores")).alias("confidence"))
