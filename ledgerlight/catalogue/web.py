"""Queries over pages: noise, text, links, routing and the crawl."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import html as H
from ..operators import pages as P
from ..plans.spread import dealt
from .registry import query, table

_CLEAN = "html"
for _t in H.NOISE:
    _CLEAN = f"regexp_replace({_CLEAN}, '(?is)<{_t}[^>]*>.*?</{_t}>', ' ', 'g')"
_PLAIN = "trim(regexp_replace(regexp_replace({}, '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'))"
_HOST = "lower(regexp_extract({}, '^[a-zA-Z]+://([^/:?#]+)', 1))"
_HREFS = "list_filter(regexp_extract_all(html, '(?i)<a[^>]*href=[\"'']([^\"'']*)[\"'']', 1), lambda h: not regexp_matches(h, '^(#|mailto:|tel:|javascript:)|^$'))"
_ROOT = "regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1)"
_DIR = "regexp_extract(url, '^([a-zA-Z]+://[^?#]*/)[^/?#]*', 1)"
_ABS = f"case when regexp_matches(h, '^[a-zA-Z]+://') then h when starts_with(h, '/') then {_ROOT} || h else case when length({_DIR}) > length({_ROOT}) + 1 then {_DIR} else {_ROOT} || '/' end || h end"
_LINKS = f"""with h as (select page_id, url, {_HREFS} as hs from pages), d as (select page_id, url, list_filter(hs, lambda x, i: list_position(hs, x) = i) as hs from h), a as (select page_id, url, unnest(hs) as h, unnest(range(len(hs))) as i from d), b as (select page_id, url, i, {_ABS} as link from a), l as (select page_id, url, link, cast(row_number() over (partition by page_id, url order by i) - 1 as int) as pos from b where {_HOST.format("link")} = {_HOST.format("url")}) """


@query("select page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') as title, nullif(regexp_extract(html, '(?is)<meta[^>]*(?:name|property)=[\"'']description[\"''][^>]*content=[\"'']([^\"'']*)', 1), '') as description from pages")
def q65_html_head(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.title(F.col("html")).alias("title"), H.meta(F.col("html"), "description").alias("description"))


_BODY = "coalesce(" + ", ".join(f"nullif(regexp_extract(c, '(?is)<{t}[^>]*>(.*)</{t}>', 1), '')" for t in ("main", "article", "body")) + ", c)"


@query(f"with k as (select page_id, {_CLEAN} as c from pages) select page_id, substr({_PLAIN.format(_BODY)}, 1, 3000) as body from k")
def q66_html_body(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.body(F.col("html")).alias("body"))


@query(_LINKS + "select page_id, pos, link from l where pos < 15")
def q67_html_links(spark, sf_dir):
    return H.links(table(spark, sf_dir, "pages"))


#: Addresses of known sites among those of the pages.
_AT = "case page_id % 7 when 0 then 'https://www.icicibank.com/p' when 1 then 'https://www.axisbank.com/p' when 2 then 'https://sbi.co.in/p' when 3 then 'https://retail.onlinesbi.sbi/p' when 4 then 'https://www.paisabazaar.com/p' when 5 then 'https://www.bankbazaar.com/p' else url end"


@query(f"select page_id, h as host, case when contains(h, 'icicibank.com') then 'ICICI' when contains(h, 'axisbank.com') then 'Axis' when contains(h, 'sbi.co.in') or contains(h, 'onlinesbi.sbi') then 'SBI' when contains(h, 'paisabazaar.com') then 'Paisabazaar' when contains(h, 'bankbazaar.com') then 'BankBazaar' else 'generic' end as reader from (select page_id, {_HOST.format('u')} as h from (select page_id, {_AT} as u from pages))")
def q68_html_route(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.expr(_AT).alias("u"))
    return p.select("page_id", H.host(F.col("u")).alias("host"), H.reader(F.col("u")).alias("reader"))


@query(_LINKS + ", s as (select distinct url from pages where page_id % 10 = 0), e as (select url, link from l where pos < 5), one as (select distinct link as url from e join s using (url) where link not in (select url from s)), two as (select distinct link as url from e join one using (url) where link not in (select url from s) and link not in (select url from one)) select url, 0 as depth from s union all select url, 1 from one union all select url, 2 from two")
def q69_crawl(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    edges = H.links(p).join(p.select("page_id", "url"), "page_id").select("url", "pos", "link")
    return H.crawl(p.filter("page_id % 10 = 0").select("url"), edges, depth=2)


@query()
def q70_html_sections(spark, sf_dir):
    s = dealt(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.posexplode(P.sections("html")).alias("pos", "s"))
    return s.select("page_id", "pos", "s.heading", "s.text", F.size("s.items").alias("n_items"))


@query()
def q71_page_records(spark, sf_dir):
    r = P.page_records(table(spark, sf_dir, "pages"))
    return r.select("page_id", "bank", "extraction_method", F.size("features").alias("n_features"), F.size("key_facts").alias("n_facts"), F.length("content").alias("n_content"), "confidence")


# ---- pages of known sites, written from the part table

_SITES = ("www.icicibank.com", "www.axisbank.com", "sbi.co.in", "www.paisabazaar.com", "www.bankbazaar.com", "example.org/axis")
_URL = "concat('https://', case p_partkey % 6 " + " ".join(f"when {k} then '{h}'" for k, h in enumerate(_SITES)) + " end, '/loan/', cast(p_partkey as string))"
_LOW, _AGE = "(8 + p_partkey % 9)", "(21 + p_partkey % 15)"
_HTML = f"""concat('<html><head><title>Loan</title><meta name="description" content="Loan ', cast(p_partkey as string), ' for all"><script>var x = "99%";</script></head><body><nav>no 77% here</nav><main><h1>Loan</h1>',
 '<div class="intro"><p>Some words about nothing in particular, to begin with.</p></div><h2>Interest rate</h2><p class="rate">Starting from ', cast({_LOW} as string), '.5% to 24% a year and more words to fill.</p>',
 '<h3>Eligibility</h3><ul><li>Age of ', cast({_AGE} as string), ' to 60 years for all</li><li>Minimum monthly income of ', cast(15 + p_partkey % 50 as string), ',000 per month</li><li>Salaried people may ask for it</li></ul>',
 '<h3>Fees</h3><p>Processing fee of 2.', cast(p_partkey % 9 as string), '% of the amount, foreclosure charge of 4% as well.</p>',
 '<table><tr><th>Bank</th><th>Rate</th></tr><tr><td>Alpha</td><td>9%</td></tr><tr><td>Beta</td><td></td></tr><tr><td>Gamma</td><td>', cast(p_partkey as string), '</td></tr></table>',
 '<div class="faq"><h4 class="question">Who can ask for this loan?</h4><p>Everyone who likes to, number ', cast(p_partkey as string), '.</p></div><a href="/fees#', cast(p_partkey as string), '">All fees</a><a href="mailto:x@y.z">mail</a><a href="/about">About</a></main><footer>1% 2%</footer></body></html>')"""


@query(f"""select p_partkey as id, case p_partkey % 6 when 0 then 'ICICI' when 1 then 'Axis' when 2 then 'SBI' when 3 then 'Paisabazaar' when 4 then 'BankBazaar' else 'Axis' end as bank, {_LOW} + 0.5e0 as rate_from, 24e0 as rate_to, (15 + p_partkey % 50) * 1e3 as income, case when p_partkey % 6 < 3 then {_AGE} end as age_from, case when p_partkey % 6 < 3 then 60 end as age_to, 2 + (p_partkey % 9) / 1e1 as fee,
 case when p_partkey % 6 = 1 then 4e0 end as foreclosure, case p_partkey % 6 when 4 then 4 else 3 end as n_features, case p_partkey % 6 when 1 then 6 when 2 then 7 when 3 then 7 when 4 then 8 else 5 end as n_facts, 'https://' || case p_partkey % 6 when 0 then 'www.icicibank.com' when 1 then 'www.axisbank.com' when 2 then 'sbi.co.in' when 3 then 'www.paisabazaar.com' when 4 then 'www.bankbazaar.com' else 'example.org' end || '/fees#' || p_partkey as link,
 case when p_partkey = 0 then 0.5e0 else 0.62e0 end as confidence, 'sections,tables,meta,body,links' as layers, case p_partkey % 6 when 3 then 'Bank | Rate' else 'Loan' end as begins from part""")
def q72_site_records(spark, sf_dir):
    p = dealt(table(spark, sf_dir, "part").select("p_partkey")).select(F.col("p_partkey").alias("page_id"), F.expr(_URL).alias("url"), F.expr(_HTML).alias("html"))
    r = P.page_records(p, deal=False)
    at = lambda c, k: F.get(c, F.lit(k))
    return r.select(F.col("page_id").alias("id"), "bank", at("interest_rate", 0).alias("rate_from"), at("interest_rate", 1).alias("rate_to"), F.col("min_income").alias("income"), at("age_range", 0).alias("age_from"), at("age_range", 1).alias("age_to"), F.col("processing_fee_pct").alias("fee"), F.col("foreclosure_fee").alias("foreclosure"),
        F.size("features").alias("n_features"), F.size("key_facts").alias("n_facts"), at("linked_urls", 0).alias("link"), "confidence", F.col("extraction_method").alias("layers"), F.regexp_extract("content", "^(Bank \\| Rate|Loan)", 1).alias("begins"))


def _written(spark, sf_dir):
    return dealt(table(spark, sf_dir, "part").select("p_partkey")).select(F.col("p_partkey").alias("page_id"), F.expr(_HTML).alias("html"))


@query("select p_partkey as page_id, 'Loan' as title, 'Loan ' || p_partkey || ' for all' as description from part")
def q73_site_heads(spark, sf_dir):
    return _written(spark, sf_dir).select("page_id", H.title(F.col("html")).alias("title"), H.meta(F.col("html"), "description").alias("description"))


@query("""select p_partkey as page_id, pos, heading, n_items, case pos when 4 then 'Everyone who likes to, number ' || p_partkey || '.' when 1 then 'Starting from ' || (8 + p_partkey % 9) || '.5% to 24% a year and more words to fill.' end as text from part, (values (0, 'Loan', 0), (1, 'Interest rate', 0), (2, 'Eligibility', 3), (3, 'Fees', 0), (4, 'Who can ask for this loan?', 0)) as h(pos, heading, n_items)""")
def q74_site_sections(spark, sf_dir):
    s = _written(spark, sf_dir).select("page_id", F.posexplode(P.sections("html")).alias("pos", "s"))
    return s.select("page_id", "pos", "s.heading", F.size("s.items").alias("n_items"), F.when(F.col("pos").isin(1, 4), F.col("s.text")).alias("text"))
