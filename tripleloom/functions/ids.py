"""Scalar functions over identifiers, years, codes and labels, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMIBIA = "namibia"
#: The addresses that may stand before an identifier.
PMID_HOSTS = ("pubmed.ncbi.nlm.nih.gov/", "www.ncbi.nlm.nih.gov/pubmed/", "ncbi.nlm.nih.gov/pubmed/")
WORK_HOSTS = ("openalex.org/",)
DOI_HOSTS = ("doi.org/", "dx.doi.org/")


def _address(hosts: tuple[str, ...]) -> str:
    """A pattern of one of the hosts with its scheme."""
    return f"https?://(?:{'|'.join(re.escape(h) for h in hosts)})"


def _only(c: Column, pattern: str) -> Column:
    """The group of a pattern that the whole trimmed text fits, else ``''``; one short expression, so that code can be generated for many of them."""
    return F.regexp_extract(F.trim(c.cast("string")), rf"\A{pattern}\z", 1)


def is_missing(c: Column) -> Column:
    """Null or blank."""
    return c.isNull() | (F.trim(c) == "")


def primary_component(c: Column) -> Column:
    """The first part of a ``|``-list, trimmed; blank is null."""
    return F.nullif(F.trim(F.split_part(c, F.lit("|"), F.lit(1))), F.lit(""))


def component_count(c: Column) -> Column:
    """How many parts a ``|``-list has; null for null."""
    return F.when(c.isNotNull(), F.size(F.split(c, "[|]")))


def passes_novelty(a: Column, b: Column) -> Column:
    """Both scores are numbers and neither is 0."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.coalesce((x != 0) & (y != 0), F.lit(False))


def share(n: Column, d: Column) -> Column:
    """n / d, null where d is 0 or null."""
    return F.try_divide(n.cast("double"), d)


def pmid_strict(c: Column) -> Column:
    """Digits, bare or in one of the two PubMed URL forms, without leading zeros; else null."""
    return F.nullif(_only(c, f"(?:{_address(PMID_HOSTS)})?0*([1-9][0-9]*)/?"), F.lit(""))


def pmid_loose(c: Column) -> Column:
    """``12.0`` as 12, the digits at the end of a path, else the text itself."""
    text = F.trim(c.cast("string"))
    tail = F.regexp_extract(text, r"([0-9]+)/*$", 1)
    return F.when(text.rlike(r"^[0-9]+[.]0$"), F.split_part(text, F.lit("."), F.lit(1))).when(tail != "", tail).otherwise(F.nullif(text, F.lit("")))


def pmid_tail(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"([0-9]+)$", 1), F.lit(""))


def work_strict(c: Column) -> Column:
    """``W`` and digits, bare or as the path of a URL; else null."""
    return F.nullif(_only(c, f"(?:{_address(WORK_HOSTS)})?(W[0-9]+)/?"), F.lit(""))


def work_loose(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(W[0-9]+)", 1), F.lit(""))


def doi_norm(c: Column) -> Column:
    """Lower-cased, without the resolver's address; blank is null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), rf"\A{_address(DOI_HOSTS)}", ""), F.lit(""))


def year_strict(c: Column) -> Column:
    """Text of four digits, the first of them 1 or 2, as an int; a bare cast would take more."""
    return _only(c, "([12][0-9]{3})").try_cast("int")


def date_year(c: Column) -> Column:
    """The four leading digits of a free-text date."""
    return year_strict(F.left(F.ltrim(c, F.lit(" \t\n\r\f\v")), F.lit(4)))


def country_code(code: Column, geo: Column, name: Column) -> Column:
    """Upper-case code, else the second source's; ``NA`` for Namibia even where a reader lost it."""
    return F.coalesce(F.nullif(F.upper(F.trim(code)), F.lit("")), F.nullif(F.upper(F.trim(geo)), F.lit("")), F.when(F.lower(F.trim(name)) == NAMIBIA, F.lit("NA")))


def pair(s: Column, o: Column) -> tuple[Column, Column]:
    """The unordered pair; null if either is null."""
    both = s.isNotNull() & o.isNotNull()
    return F.when(both, F.least(s, o)), F.when(both, F.greatest(s, o))


def predicate_phrase(c: Column) -> Column:
    """``AFFECTS_OF`` as ``affects of``."""
    return F.regexp_replace(F.lower(F.trim(F.replace(c, F.lit("_"), F.lit(" ")))), r"\s+", " ")


def pattern_label(node: Column, combination: Column, relation: Column) -> Column:
    """Which kinds of new knowledge are there: ``N+C+R`` and the like, or ``Repeated_Only``."""
    some = F.concat_ws("+", F.when(node, "N"), F.when(combination, "C"), F.when(relation, "R"))
    return F.when(some == "", "Repeated_Only").otherwise(some)


def valid_cui(c: Column) -> Column:
    return F.coalesce(c.rlike("^C[0-9]{7,}$"), F.lit(False))


def list_items(c: Column) -> Column:
    """The sorted distinct non-blank items of a ``;``-list."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(c, ";"), F.trim), lambda x: x != "")))


def listed(c: Column | str, separator: str) -> Column:
    """An aggregate: the sorted distinct values of a group as text; null if there are none."""
    values = F.array_sort(F.collect_set(c))
    return F.when(F.size(values) > 0, F.array_join(values, separator))
