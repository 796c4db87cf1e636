"""Column functions on code and text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing value, and split names with their aliases.
NULL_TEXTS = ["None", "null", ""]
SPLIT_ALIASES = {"train": "train", "dev": "valid", "validation": "valid", "val": "valid", "eval": "valid", "development": "valid", "valid": "valid", "testset": "test", "testing": "test", "test": "test"}
#: Words before a parenthesis that are no function names.
KEYWORDS = ["if", "for", "while", "return", "switch", "sizeof"]


#: White space of all kinds, as characters.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Ends of lines.
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.trim(c, F.lit(BLANKS))


def normal_scalar(c: Column) -> Column:
    """Trimmed text; null for what stands for a missing value."""
    t = strip(c)
    return F.when(~t.isin(NULL_TEXTS), t)


def normal_list(c: Column) -> Column:
    """The values of a list that aren't missing, joined; null if there are none."""
    found = F.filter(F.transform(c, normal_scalar), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, F.array_join(found, ";"))


def label(c: Column) -> Column:
    """0 or 1 from text: 1 for the words for true only."""
    return F.when(F.lower(strip(c)).isin("1", "true", "t", "yes", "vul", "vulnerable"), 1).otherwise(0)


def label_of_number(c: Column) -> Column:
    """0 or 1 from a number: 1 where its whole part isn't 0. A missing number is 0."""
    return F.when(F.coalesce(c.cast("double"), F.lit(0.0)).cast("long") != 0, 1).otherwise(0)


def label_of_sql(c: Column) -> Column:
    """0 or 1 from a dump's boolean."""
    return F.when(F.lower(strip(c)).isin("1", "true", "t", "yes"), 1).otherwise(0)


def split_name(c: Column) -> Column:
    """A split's usual name; null for unknown ones."""
    return F.create_map(*[F.lit(x) for kv in SPLIT_ALIASES.items() for x in kv])[F.lower(strip(c))]


def row_id(source: Column, split: Column, raw_id: Column) -> Column:
    """source_split_id without missing parts."""
    return F.concat_ws("_", source, split, raw_id)


def function_name(code: Column, explicit: Column | None = None) -> Column:
    """The explicit name; else the first identifier before a parenthesis, where lines that are comments or begin with a keyword's don't count."""
    lines = F.filter(F.transform(F.split(code, LINE_END), strip), lambda x: (x != "") & ~x.startswith("//"))
    found = F.transform(lines, lambda x: F.regexp_extract(x, r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\(", 1))
    guess = F.filter(found, lambda x: (x != "") & ~x.isin(KEYWORDS))
    guess = F.when(F.size(guess) > 0, F.element_at(guess, 1))
    return guess if explicit is None else F.when(strip(explicit) != "", strip(explicit)).otherwise(guess)


def year_in(c: Column, bare: bool = False) -> Column:
    """The year of the first CVE id in a text; else, if allowed, the first year from 1990 to 2029 that stands alone."""
    year = F.regexp_extract(c, r"(?i)CVE-(\d{4})-", 1).try_cast("int")
    return F.coalesce(year, F.regexp_extract(c, r"\b(199[0-9]|20[0-2][0-9])\b", 1).try_cast("int")) if bare else year


def first_cve(*values: Column) -> Column:
    """The first CVE id in any of the values, in upper case; null if there is none."""
    found = [F.upper(F.regexp_extract(v, r"(?i)CVE-\d{4}-\d+", 0)) for v in values]
    return F.coalesce(*[F.when(x != "", x) for x in found])


#: How dates are written besides ISO forms; those with a day before the month come after those with a month first.
DATE_FORMATS = [
    "yyyy-M-d'T'H:mmXXX", "yyyy-M-d H:mm:ss Z", "yyyy-M-d H:mm Z", "yyyy/M/d[ H:mm[:ss]]", "M/d/yyyy[ H:mm[:ss]]", "d/M/yyyy[ H:mm[:ss]]", "d.M.yyyy[ H:mm[:ss]]", "d MMM yyyy H:mm:ss Z", "d MMM yyyy[ H:mm[:ss]]", "d MMMM yyyy[ H:mm[:ss]]",
    "MMM d H:mm:ss yyyy Z", "MMM d H:mm:ss yyyy", "MMM d, yyyy[ H:mm[:ss]]", "MMMM d, yyyy[ H:mm[:ss]]", "MMM d yyyy", "yyyyMMdd", "yyyyMMdd'T'HHmmss",
]


def instant(t: Column) -> Column:
    """A time from trimmed text: ISO forms first, then DATE_FORMATS, a weekday before them left out; UTC where no zone is named. Null for others."""
    day = F.regexp_replace(F.regexp_replace(t, r"^(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", ""), " +", " ")
    tried = F.transform(F.array(*map(F.lit, DATE_FORMATS)), lambda f: F.try_to_timestamp(day, f))
    return F.coalesce(F.try_to_timestamp(t), F.get(F.filter(tried, lambda x: x.isNotNull()), 0))


def year_and_date(c: Column) -> tuple[Column, Column]:
    """Year and day (YYYY-MM-DD) of a date as text, in UTC; null where it can't be read or lies outside 1990 to 2030."""
    t = strip(c)
    at = instant(F.when(~F.lower(t).isin("", "nan", "none", "null"), t))
    good = F.year(at).between(1990, 2030)
    return F.when(good, F.year(at)), F.when(good, F.date_format(at, "yyyy-MM-dd"))


def commit_key(commit: Column, row: Column) -> Column:
    """The trimmed hash, or a key of the row's own where there is none."""
    t = strip(commit)
    return F.when(t.isNull() | F.lower(t).isin("none", "null", ""), F.concat(F.lit("_row_"), row.cast("string"))).otherwise(t)


def tolerant_timestamp(c: Column) -> Column:
    """A time from text: 10 to 13 digits are seconds since 1970 (the first ten count), else a date; null if neither."""
    t = strip(c)
    return F.when(t.rlike(r"^\d{10,13}$"), F.timestamp_seconds(F.substring(t, 1, 10).try_cast("long"))).otherwise(instant(t))


def description(c: Column) -> Column:
    """The first 4,000 characters; null for blank ones."""
    t = strip(c)
    return F.when(t != "", F.substring(t, 1, 4000))


def language_allowed(c: Column, allowed: list[str]) -> Column:
    """Whether a language is in a list, in any case; a missing one is."""
    return c.isNull() | F.lower(strip(c)).isin([a.lower() for a in allowed])


def without_comments(code: Column) -> Column:
    """Block comments go first, then line comments; strings are not looked at."""
    return F.regexp_replace(F.regexp_replace(code, r"(?s)/\*.*?\*/", ""), r"(?m)//.*?$", "")


def tidy(code: Column) -> Column:
    """No blanks at line ends, at most one empty line in a row, none at the borders."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(code, r"(?m)[ \t\r\f\x0B]+$", ""), r"\n{3,}", "\n\n"), r"\A\s+|\s+\z", "")


def n_tokens(c: Column) -> Column:
    """Runs of characters that are no white space."""
    return F.regexp_count(c, F.lit(r"(?U)\S+")).cast("long")


def n_lines(c: Column) -> Column:
    """Lines with more than white space."""
    return F.regexp_count(c, F.lit(r"(?m)^.*\S.*$")).cast("long")


def drop_reason(code: Column, min_lines: int = 3, min_tokens: int = 50) -> Column:
    """Why a cleaned text is dropped, the first reason only; null if it stays."""
    return F.when(F.coalesce(strip(code), F.lit("")) == "", "empty").when(n_lines(code) < min_lines, "min_lines").when(n_tokens(code) < min_tokens, "min_tokens")


def first_match_count(c: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur."""
    total = F.lit(0)
    for p in patterns:
        total = total + F.rlike(c, F.lit(p)).cast("int")
    return total


def extension_allowed(path: Column, allowed: list[str]) -> Column:
    """Whether a path's extension is allowed; a null path is."""
    return path.isNull() | F.regexp_extract(path, r"(\.[^./]+)$", 1).isin(allowed)


def truncated(c: Column, n: int, marker: str = " ...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n)), F.lit(marker))).otherwise(c)


def hints(c: Column, pattern: str) -> Column:
    """Distinct matches in order, upper case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.upper))


def comment_hints(code: Column, last_year: int = 2019) -> tuple[Column, Column]:
    """CWE and CVE ids that a text names, distinct and in order.

    CVE ids of later years are left out, and all CWE ids where there is one such: they would tell of the test's years.
    """
    cwes = F.array_distinct(F.transform(F.regexp_extract_all(code, F.lit(r"(?i)CWE[-\s]?(\d{1,4})"), F.lit(1)), lambda x: F.concat(F.lit("CWE-"), x.cast("int").cast("string"))))
    cves = F.array_distinct(F.transform(F.regexp_extract_all(code, F.lit(r"(?i)CVE[-\s]?(\d{4}-\d{4,7})"), F.lit(1)), lambda x: F.concat(F.lit("CVE-"), x)))
    late = lambda x: F.substring(x, 5, 4).cast("int") > last_year
    return F.when(F.exists(cves, late), F.array().cast("array<string>")).otherwise(cwes), F.filter(cves, lambda x: ~late(x))
