"""The gate before training: what a data set in splits must have, and what must not be in several splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import duplicates

#: Columns that each row has, splits that aren't empty, and texts of a commit that mean none.
REQUIRED = ("id", "code", "label", "source_dataset", "commit_hash", "commit_date")
SPLITS = ("train", "valid", "test")
NO_COMMIT = ("none", "null", "nan")


def gate(rows: DataFrame, required: tuple[str, ...] = REQUIRED, max_exact: int = 0, max_near: int = 0, near: bool = True) -> DataFrame:
    """One row: what was found, `issues` in words, and `passed`, whether there are none.

    rows: code, split, commit_hash and place, a number that orders rows by split and then as they come. Rows of other
    splits don't count. Columns of `required` that are missing and splits without rows are issues; then the rest is not
    looked at and counts 0, as a data set without them is no data set. exact_hashes are texts in several splits,
    exact_rows the rows of these splits less one, summed up over such texts, near_rows the rows that an earlier row equals
    or nearly equals, commits those in several splits, of which none may be. Null code counts as empty.
    """
    r = rows.withColumn("__split", T.split_name(F.col("split"))).filter(F.col("__split").isin(*SPLITS))
    sizes = r.groupBy("__split").agg(F.count("*").alias("size"))
    there = {x["__split"] for x in sizes.collect()}  # three at most
    missing, empty = [c for c in required if c not in rows.columns], [s for s in SPLITS if s not in there]
    early = [f"missing columns: {', '.join(missing)}"] * bool(missing) + [f"{s} is empty" for s in empty]
    if early:
        found = rows.sparkSession.range(1).select(*[F.lit(0).cast("long").alias(c) for c in ("exact_hashes", "exact_rows", "near_rows", "commits")])
    else:
        spread = r.groupBy(duplicates.digest(F.coalesce("code", F.lit(""))).alias("d"), "__split").agg(F.lit(1).alias("one")).join(F.broadcast(sizes), "__split")
        spread = spread.groupBy("d").agg(F.count("*").alias("k"), F.sum("size").alias("s")).filter("k > 1")
        key = T.strip(F.col("commit_hash"))
        commits = r.filter((key != "") & ~F.lower(key).isin(*NO_COMMIT)).groupBy(key.alias("c"), "__split").agg(F.lit(1).alias("one")).groupBy("c").agg(F.count("*").alias("k")).filter("k > 1")
        found = spread.agg(F.count("*").alias("exact_hashes"), F.coalesce(F.sum(F.col("s") - 1), F.lit(0)).alias("exact_rows"))
        found = found.crossJoin(near_rows(r) if near else rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("near_rows"))).crossJoin(commits.agg(F.count("*").alias("commits")))  # one row each
    said = lambda test, *words: F.when(test, F.concat(*[w if isinstance(w, Column) else F.lit(w) for w in words]))
    text = lambda c: F.col(c).cast("string")
    late = [
        said(F.col("exact_hashes") > max_exact, text("exact_hashes"), f" texts in several splits, {max_exact} may be"),
        said(F.col("near_rows") > max_near, text("near_rows"), f" rows near an earlier one, {max_near} may be"),
        said(F.col("commits") > 0, text("commits"), " commits in several splits"),
    ]
    issues = F.concat(F.array(*map(F.lit, early)) if early else F.array().cast("array<string>"), F.filter(F.array(*late), lambda x: x.isNotNull()))
    out = found.select(F.lit(len(missing)).alias("missing_columns"), F.lit(len(empty)).alias("empty_splits"), "exact_hashes", "exact_rows", "near_rows", "commits", issues.alias("issues"))
    return out.withColumn("passed", F.size("issues") == 0)


def near_rows(rows: DataFrame) -> DataFrame:
    """(near_rows): the rows that an earlier row equals or nearly equals; blank ones are near to nothing."""
    marked = duplicates.first_of_equal(rows, "code", [F.col("place")])
    near = duplicates.near_matched(marked.filter("keep"), "code", "place", True).withColumn("__near", F.lit(True))
    return marked.join(near, marked["place"] == near["at"], "left").agg(F.count_if(F.coalesce("__near", F.lit(False)) | ~F.col("keep")).alias("near_rows"))
