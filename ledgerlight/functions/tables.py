"""Tables of documents and pages (headers, rows of cells) as columns: cleaning, headers, and sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_cell(c: Column) -> Column:
    """Blanks collapsed; what stands for nothing is empty."""
    x = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+", " "))
    return F.when(F.lower(x).isin("nan", "none", "-"), F.lit("")).otherwise(x)


def is_numeric(c: Column) -> Column:
    return F.regexp_replace(c, "[₹%,\\s]", "").try_cast("double").isNotNull()


def promoted(headers: Column, rows: Column) -> Column:
    """(headers, rows): where all headers are numbers or unnamed, the first row takes their place. Cells are cleaned and
    empty rows go."""
    bare = F.forall(headers, lambda h: F.trim(h).rlike("^[0-9]+$") | F.startswith(F.trim(h), F.lit("Unnamed")))
    cleaned = lambda r: F.transform(r, clean_cell)
    head = F.when(bare, F.get(rows, F.lit(0))).otherwise(headers)
    rest = F.when(bare, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(rows)
    some = lambda r: F.exists(r, lambda c: c != "")
    return F.struct(cleaned(head).alias("headers"), F.filter(F.transform(rest, cleaned), some).alias("rows"))


def _pairs(headers: Column, row: Column, glue: str, bare: bool) -> Column:
    told = F.zip_with(headers, row, lambda h, c: F.when((F.trim(h) != "") & (F.trim(c) != ""), F.concat(F.trim(h), F.lit(glue), F.trim(c))).when(F.trim(c) != "", F.trim(c) if bare else F.lit(None)))
    return F.filter(F.slice(told, 1, F.greatest(F.least(F.size(headers), F.size(row)), F.lit(0))), lambda x: x.isNotNull())


def _keyed(rows: Column) -> Column:
    full = F.filter(rows, lambda r: (F.trim(r[0]) != "") & (F.trim(r[1]) != ""))
    return F.transform(full, lambda r: F.concat(F.trim(r[0]), F.lit(": "), F.trim(r[1]), F.lit(".")))


def _two(headers: Column, rows: Column) -> Column:
    return (F.size(headers) == 2) & F.forall(rows, lambda r: F.size(r) == 2)


def sentences(headers: Column, rows: Column) -> Column:
    """A sentence for each row of a document's table: `key: value.` for two columns with words as headers, else
    `For this entry: h is c, ....`; cells without a header stand by themselves."""
    described = F.filter(F.transform(rows, lambda r: _pairs(headers, r, " is ", True)), lambda p: F.size(p) > 0)
    many = F.transform(described, lambda p: F.concat(F.lit("For this entry: "), F.array_join(p, ", "), F.lit(".")))
    return F.when(_two(headers, rows) & ~F.exists(headers, is_numeric), _keyed(rows)).otherwise(many)


def upload_sentences(headers: Column, rows: Column) -> Column:
    """A sentence for each row of an uploaded document's table: `key: value.`, or `h: c | h: c.`."""
    described = F.filter(F.transform(rows, lambda r: _pairs(headers, r, ": ", False)), lambda p: F.size(p) > 0)
    return F.when(_two(headers, rows), _keyed(rows)).otherwise(F.transform(described, lambda p: F.concat(F.array_join(p, " | "), F.lit("."))))


def page_sentences(rows: Column) -> Column:
    """A sentence for each row of a page's table, whose first row is its header if there are others: `h: c | h: c` for
    rows as long as the header, `a: b` for others of two cells, else the cells. Rows hold no empty cells."""
    head = F.get(rows, F.lit(0))
    several = F.size(rows) > 1
    body = F.when(several, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(rows)
    paired = lambda r: F.array_join(F.zip_with(head, r, lambda h, c: F.concat(h, F.lit(": "), c)), " | ")
    two = lambda r: F.concat(r[0], F.lit(": "), r[1])
    return F.transform(body, lambda r: F.when(several & (F.size(r) == F.size(head)), paired(r)).when(F.size(r) == 2, two(r)).otherwise(F.array_join(r, " | ")))
