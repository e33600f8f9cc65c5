"""Pages as columns: noise, title, links, text, and the crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dom import NOISE, SITES


def without_noise(html: Column) -> Column:
    for tag in NOISE:
        html = F.regexp_replace(html, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return html


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def meta(html: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(html, f"(?is)<meta[^>]*(?:name|property)=[\"']{name}[\"'][^>]*content=[\"']([^\"']*)", 1), F.lit(""))


def plain(html: Column) -> Column:
    """Text without tags, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "(?s)<[^>]*>", " "), "[ \\t\\n\\r]+", " "))


def body(html: Column, most: int = 3000) -> Column:
    """The text of main, else article, else body, without noise."""
    clean = without_noise(html)
    parts = [F.nullif(F.regexp_extract(clean, f"(?is)<{t}[^>]*>(.*)</{t}>", 1), F.lit("")) for t in ("main", "article", "body")]
    return F.substring(plain(F.coalesce(*parts, clean)), 1, most)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/:?#]+)", 1))


def hrefs(html: Column) -> Column:
    found = F.regexp_extract_all(html, F.lit("(?i)<a[^>]*href=[\"']([^\"']*)[\"']"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda h: ~h.rlike("^(#|mailto:|tel:|javascript:)|^$")))


def absolute(base: Column, href: Column) -> Column:
    """href against its page: absolute, from the root, or beside the page."""
    root = F.regexp_extract(base, "^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(base, "^([a-zA-Z]+://[^?#]*/)[^/?#]*", 1)
    return F.when(href.rlike("^[a-zA-Z]+://"), href).when(F.startswith(href, F.lit("/")), F.concat(root, href)).otherwise(F.concat(F.when(F.length(folder) > F.length(root) + 1, folder).otherwise(F.concat(root, F.lit("/"))), href))


def links(pages: DataFrame, most: int = 15) -> DataFrame:
    """page_id, pos, link: the first links of each page that stay on its host."""
    p = pages.select("page_id", "url", F.transform(hrefs(F.col("html")), lambda h: absolute(F.col("url"), h)).alias("links"))
    same = F.slice(F.filter("links", lambda x: host(x) == host(F.col("url"))), 1, most)
    return p.select("page_id", F.posexplode(same).alias("pos", "link"))


def reader(url: Column) -> Column:
    """The site whose rules read a page: the first whose domain the host contains."""
    out = F.lit("generic")
    for part, site in reversed(SITES.items()):
        out = F.when(F.contains(host(url), F.lit(part)), F.lit(site.name)).otherwise(out)
    return out


def crawl(seeds: DataFrame, edges: DataFrame, depth: int = 1, per_page: int = 5) -> DataFrame:
    """Breadth-first rounds: url, depth of every page reached from seeds (url) along edges (url, pos, link), of which
    the first per_page links of each page count, visited or not. edges should be a stored table: each round reads it."""
    frontier = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    visited = frontier
    first = edges.filter(F.col("pos") < per_page)
    for d in range(1, depth + 1):
        nxt = frontier.select("url").join(first, "url").select(F.col("link").alias("url")).distinct().join(visited.select("url"), "url", "left_anti")
        frontier = nxt.withColumn("depth", F.lit(d))
        visited = visited.unionByName(frontier)
    return visited
