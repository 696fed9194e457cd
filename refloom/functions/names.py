"""Person names: column expressions, and where names are taken apart, Arrow UDFs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from refloom.functions.text import folded

#: Fixed pattern: a token of one to four initials, with dots or hyphens or without.
INITIALS = r"^[A-Z](?:[.\-]?[A-Z]){0,3}\.?$"
#: Organisations that papers are credited to, and words that end an organisation's name.
ORGANISATIONS = (
    r"open\s?ai", "deepseek", "qwen", "google", "deepmind", "meta", r"essential\s?ai", "anthropic", "microsoft", "mistral", "cohere", "nvidia", r"hugging\s?face", r"allen\s?ai", "ai2",
    "stability", "alibaba", "baidu", "tencent", "bytedance",
)
ORGANISATION_WORDS = ("team", "teams", "labs?", "inc", "institute", "consortium", "collaboration", "contributors?", "group")
#: Fixed texts of the two findings on authors.
FIRST_DIFFERS, MOST_DIFFER = "first-author mismatch: cited '", "author list differs substantially from the canonical record"


def last_name(c: Column) -> Column:
    """What stands before the comma, else the last word, in lower case."""
    name = F.trim(c)
    return F.lower(F.when(F.contains(name, F.lit(",")), F.trim(F.regexp_extract(name, r"^([^,]*)", 1))).otherwise(F.regexp_extract(name, r"(\S+)$", 1)))


def surnames(authors: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(authors, last_name), lambda x: x != ""))


def surname_matches(a: Column, b: Column) -> Column:
    """Equal, or one starts with the other and both have four letters; an empty one matches none."""
    return (a != "") & (b != "") & ((a == b) | ((F.length(a) >= 4) & (F.length(b) >= 4) & (a.startswith(b) | b.startswith(a))))


def author_overlap(claimed: Column, canonical: Column) -> Column:
    """Share of the claimed surnames that the record has; 0 if either has none."""
    share = F.try_divide(F.size(F.array_intersect(claimed, canonical)), F.size(claimed))
    return F.when((F.size(claimed) > 0) & (F.size(canonical) > 0), share).otherwise(0.0)


def key_of(name: str | None) -> tuple[str, str]:
    """(surname, initial) of 'Last, First', 'Last FM', 'First Last' or glued 'LastF', folded; both empty for none."""
    plain = re.sub(r"^([A-Z]) (?=[a-z])", r"\1", (name or "").strip())  # a surname torn after its capital
    before, comma, after = plain.partition(",")
    if comma:
        return folded((before.split() or [""])[-1]), folded(after.strip()[:1])
    tokens = plain.split()
    if len(tokens) == 1:
        glued = _GLUED.fullmatch(plain)
        return (folded(glued.group(1)), folded(glued.group(2)[0])) if glued else (folded(plain), "")
    words, initials = [t for t in tokens if not _INITIALS.match(t)], [t for t in tokens if _INITIALS.match(t)]
    if len(words) > 1:
        return folded(words[-1]), folded(words[0][0])
    return folded(words[0]) if words else "", folded(initials[0][0]) if initials else ""


def one_person(a: str | None, b: str | None) -> bool:
    """Surnames are equal, or one begins with the other and both have four letters; initials agree where both have one."""
    (x, i), (y, j) = key_of(a), key_of(b)
    close = x == y or (min(len(x), len(y)) >= 4 and (x.startswith(y) or y.startswith(x)))
    return bool(x and y) and close and (not i or not j or i == j)


def issue_of(claimed: list[str], canonical: list[str]) -> str | None:
    """What is wrong with a cited author list, or None.

    The first authors differ, unless either is an organisation or they agree with hyphens as spaces; else under half of the
    claimed ones are in the record. Empty lists are not compared.
    """
    if not len(claimed) or not len(canonical):
        return None
    first, other = claimed[0] or "", canonical[0] or ""
    if not one_person(first, other):
        excused = _ORGANISATION.search(first) or _ORGANISATION.search(other) or one_person(first.replace("-", " "), other.replace("-", " "))
        return None if excused else f"{FIRST_DIFFERS}{first}' vs '{other}'"
    found = sum(any(one_person(a, b) for b in canonical) for a in claimed)
    return MOST_DIFFER if 2 * found < len(claimed) else None


_INITIALS, _GLUED = re.compile(INITIALS), re.compile(r"(.*[a-z])([A-Z]{1,3})")
_ORGANISATION = re.compile(r"(?i)\b(?:" + "|".join(ORGANISATIONS + ORGANISATION_WORDS) + r")\b")


def _each(f, *columns: pd.Series) -> pd.Series:
    return pd.Series([f(*row) for row in zip(*columns, strict=True)], dtype=object)


def _people(x) -> list:
    return [] if x is None else list(x)


@F.pandas_udf(StructType([StructField("surname", StringType()), StructField("initial", StringType())]))
def name_key(names: pd.Series) -> pd.DataFrame:
    """key_of() of a column of names."""
    return pd.DataFrame([key_of(x) for x in names], columns=["surname", "initial"])


@F.pandas_udf(StringType())
def author_issue(claimed: pd.Series, canonical: pd.Series) -> pd.Series:
    """issue_of() of two columns of author lists; null for none."""
    return _each(lambda a, b: issue_of(_people(a), _people(b)), claimed, canonical)


@F.pandas_udf(BooleanType())
def same_author(a: pd.Series, b: pd.Series) -> pd.Series:
    """one_person() of two columns of names."""
    return _each(one_person, a, b).astype(bool)


def first_token_surname(reference: Column) -> Column:
    """The word that a reference begins with, in lower case: its leading surname if surnames come first."""
    return F.lower(F.regexp_extract(F.coalesce(reference, F.lit("")), r"^\s*([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ'’-]+)", 1))


def candidate_first_surname(authors: Column) -> Column:
    """The last word of a candidate's first author, in lower case; '' without authors."""
    words = F.regexp_replace(F.coalesce(F.get(authors, F.lit(0)), F.lit("")), r"[^A-Za-z\s'’-]", " ")
    return F.lower(F.regexp_extract(words, r"(\S+)\s*$", 1))


def search_surname(reference: Column) -> Column:
    """The longest word of letters (three or more) in a reference's first author, the first of equals; '' without any."""
    head = F.get(F.split(F.trim(F.coalesce(reference, F.lit(""))), r"[.;]", 2), F.lit(0))
    comma = F.instr(head, ",")
    head = F.when((comma > 0) & (comma <= 40), F.substring(head, F.lit(1), comma - 1)).otherwise(head)
    words = F.filter(F.regexp_extract_all(F.substring(head, 1, 60), F.lit(r"\p{L}{3,}"), F.lit(0)), lambda w: F.lower(w) != "and")
    longest = F.aggregate(words, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))
    return longest


def citation_cell(authors: Column, title: Column, year: Column, raw: Column, cite_key: Column) -> Column:
    """'A, B, Title, 2020', with 'A et al.' for three authors and more; else the raw reference, else the key."""
    people = F.coalesce(authors, F.array().cast("array<string>"))
    who = F.when(F.size(people) > 2, F.concat(F.get(people, F.lit(0)), F.lit(" et al."))).otherwise(F.array_join(people, ", "))
    when = F.when(F.coalesce(year, F.lit(0)) != 0, year.cast("string"))
    parts = F.array_join(F.filter(F.array(who, title, when), lambda x: F.length(x) > 0), ", ")
    flat = F.trim(F.replace(F.replace(F.coalesce(raw, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))
    return F.coalesce(F.nullif(parts, F.lit("")), F.nullif(flat, F.lit("")), cite_key)


def who_year(authors: Column, title: Column, year: Column, raw: Column, cite_key: Column) -> Column:
    """'A, B (2020)' in 80 characters, with 'A et al.' for three authors and more; without any the title, 40 characters of the raw reference, or the key."""
    people = F.coalesce(authors, F.array().cast("array<string>"))
    named = F.when(F.size(people) > 2, F.concat(F.get(people, F.lit(0)), F.lit(" et al."))).when(F.size(people) > 0, F.array_join(people, ", "))
    who = F.coalesce(named, F.nullif(title, F.lit("")), F.nullif(F.substring(raw, 1, 40), F.lit("")), cite_key)
    label = F.concat(who, F.when(F.coalesce(year, F.lit(0)) != 0, F.concat(F.lit(" ("), year, F.lit(")"))).otherwise(""))
    return F.when(F.length(label) > 80, F.concat(F.rtrim(F.substring(label, 1, 79)), F.lit("…"))).otherwise(label)


def split_authors(c: Column) -> Column:
    """The names of an 'A and B and C' list."""
    return F.filter(F.transform(F.split(c, r"\s+and\s+"), lambda x: F.trim(x)), lambda x: x != "")


def is_organisation(name: Column) -> Column:
    return name.rlike(_ORGANISATION.pattern)
