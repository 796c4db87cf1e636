"""Rows of each source as rows of one core schema, as projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

#: The core schema.
CORE = {"id": "string", "code": "string", "label": "int", "split": "string", "source_dataset": "string", "commit_hash": "string", "commit_date": "string", "year": "int", "cve": "string", "cwe": "string", "cve_desc": "string", "func_hash": "string", "file_hash": "string", "nvd_url": "string", "file_path": "string", "func_name": "string", "project": "string"}


def core(rows: DataFrame, source: str, **columns: Column) -> DataFrame:
    """The core columns of rows whose code isn't blank; what a source lacks is null."""
    made = rows.select(*[columns.get(c, F.lit(source) if c == "source_dataset" else F.lit(None)).cast(k).alias(c) for c, k in CORE.items()])
    return made.filter(T.strip(F.col("code")) != "")


def _split(c: Column) -> Column:
    t = F.lower(T.strip(c))
    return F.when(t != "", t)


def _bounded(year: Column) -> Column:
    return F.when(year.between(1990, 2030), year)


def _day(year: Column) -> Column:
    return F.when(year.isNotNull(), F.concat(year.cast("string"), F.lit("-01-01")))


def first_year(cve: Column, cwes: Column, cve_desc: Column) -> Column:
    """The year of a CVE id in the id, then in the list of CWEs, then in the description, where a year alone counts too."""
    listed = F.filter(F.transform(cwes, lambda x: T.year_in(x)), lambda y: y.isNotNull())
    return F.coalesce(T.year_in(cve), F.when(F.size(listed) > 0, F.element_at(listed, 1)), T.year_in(cve_desc, bare=True))


def primevul(raw: DataFrame) -> DataFrame:
    """From idx, func, target, split, commit_id, cve, cwe (a list), cve_desc, func_hash, file_hash, nvd_url."""
    split, year = _split(F.col("split")), first_year(F.col("cve"), F.col("cwe"), F.col("cve_desc"))
    own = {c: T.normal_scalar(F.col(c)) for c in ("func_hash", "file_hash", "cve", "cve_desc", "nvd_url")}
    ident = T.row_id(F.lit("primevul"), split, F.col("idx").cast("string"))
    return core(raw, "primevul", id=ident, code=F.col("func"), label=T.label(F.col("target")), split=split, year=year, commit_date=_day(year), commit_hash=T.normal_scalar(F.col("commit_id")), cwe=T.normal_list(F.col("cwe")), **own)


def first_metadata(meta: DataFrame, order: str) -> DataFrame:
    """One row a commit_id: the first with a CVE, else the first, in the order of a column."""
    has = F.coalesce(F.col("CVE"), F.lit("")) != ""
    best = meta.filter(T.strip(F.col("commit_id")) != "").groupBy(T.strip(F.col("commit_id")).alias("commit")).agg(F.min_by(F.struct("CVE", "CWE", "bug_info"), F.struct(~has, F.col(order))).alias("m"))
    return best.select("commit", "m.*")


def diversevul(raw: DataFrame, meta: DataFrame) -> DataFrame:
    """From hash, func, target, commit_id, message, cwe (a list) with metadata (commit, CVE, CWE, bug_info): a left join by commit."""
    m = meta.select("commit", F.col("CVE").alias("m_cve"), F.col("CWE").alias("m_cwe"), F.col("bug_info").alias("m_info"))
    j = raw.join(m, T.strip(raw["commit_id"]) == F.col("commit"), "left")
    cve = T.first_cve(F.col("m_cve"), F.col("message"))
    year = T.year_in(cve)
    return core(
        j, "diversevul", id=T.row_id(F.lit("diversevul"), F.lit(None), F.coalesce(F.col("hash"), F.col("commit_id"))), code=F.col("func"), label=T.label(F.col("target")), year=year, commit_date=_day(year),
        commit_hash=T.normal_scalar(F.col("commit_id")), cve=cve, cwe=F.coalesce(T.normal_scalar(F.col("m_cwe")), T.normal_list(F.col("cwe"))), cve_desc=T.normal_scalar(F.col("m_info")),
        nvd_url=F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), cve),
    )


def bigvul(raw: DataFrame) -> DataFrame:
    """From row, func_before, vul, cve, cwe, publish_date, commit_id: the day is that of publication, else the first of the CVE's year."""
    year, day = T.year_and_date(F.col("publish_date"))
    other = _bounded(T.year_in(F.col("cve")))
    return core(raw, "bigvul", id=F.concat(F.lit("bigvul_"), F.col("row").cast("string")), code=F.col("func_before"), label=T.label(F.col("vul")), year=F.coalesce(year, other), commit_date=F.coalesce(day, _day(other)), commit_hash=T.normal_scalar(F.col("commit_id")), cwe=T.normal_scalar(F.col("cwe")), cve=T.normal_scalar(F.col("cve")))


def earliest_known(*dates: Column, cve: Column) -> tuple[Column, Column]:
    """Year and day of the first of several dates that can be read; else those of the CVE's year."""
    found = [T.year_and_date(d) for d in dates]
    other = _bounded(T.year_in(cve))
    return reduce(lambda a, b: F.coalesce(a, b), [y for y, _ in found] + [other]), reduce(lambda a, b: F.coalesce(a, b), [d for _, d in found] + [_day(other)])


def relational(raw: DataFrame, source: str) -> DataFrame:
    """From method_id, method_before, vul, commit_hash, committer_date, author_date, published_date, cve, cwe, cve_desc, file_path."""
    year, day = earliest_known(F.col("committer_date"), F.col("author_date"), F.col("published_date"), cve=F.col("cve"))
    return core(
        raw, source, id=F.concat(F.lit(f"{source}_"), F.col("method_id").cast("string")), code=F.col("method_before"), label=T.label_of_sql(F.col("vul")), year=year, commit_date=day, commit_hash=T.normal_scalar(F.col("commit_hash")),
        cve=T.normal_scalar(F.col("cve")), cwe=T.normal_scalar(F.col("cwe")), cve_desc=T.description(F.col("cve_desc")), file_path=T.normal_scalar(F.col("file_path")),
    )


def mapped(raw: DataFrame, source: str, mapping: dict[str, str], languages: tuple[str, ...] = ()) -> DataFrame:
    """Any source by a mapping of core names to its columns; `lang` and `date_from_cve` name columns too."""
    has = lambda k: k in mapping and mapping[k] in raw.columns
    col = lambda k: F.col(mapping[k]) if has(k) else F.lit(None).cast("string")
    if languages and has("lang"):
        raw = raw.filter(T.language_allowed(col("lang"), list(languages)))
    split = _split(col("split"))
    day = F.coalesce(T.normal_scalar(col("commit_date")), _day(T.year_in(col("date_from_cve"))))
    return core(raw, source, id=T.row_id(F.lit(source), split, col("id").cast("string")), code=col("code"), label=T.label(col("label").cast("string")), split=split, commit_hash=T.normal_scalar(col("commit_hash")), commit_date=day, file_path=T.normal_scalar(col("file_path")), func_name=T.function_name(col("code"), col("func_name")), project=T.normal_scalar(col("project")))
