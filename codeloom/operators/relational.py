"""Upserts, paging, predicates, first-wins and set operations over any rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old without their key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn_ = 1").drop("rn_")


def first_n(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn_") <= n).drop("rn_")


def page(rows: DataFrame, order: list, number: int = 1, limit: int = 10, most: int = 50) -> DataFrame:
    """One page; numbers from 1, at most ``most`` rows."""
    limit = max(1, min(limit, most))
    return rows.orderBy(*order).offset((max(1, number) - 1) * limit).limit(limit)


def page_count(rows: DataFrame, limit: int = 10) -> DataFrame:
    """One row: rows, and pages of ``limit`` rows."""
    return rows.agg(F.count("*").alias("n_rows")).withColumn("n_pages", F.ceil(F.col("n_rows") / F.lit(float(limit))))


def counts(rows: DataFrame, by: str, distinct: str) -> DataFrame:
    """Rows and distinct values of each category."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_distinct(distinct).alias("n_distinct"))


def owned(rows: DataFrame, owner: str, user: Column) -> DataFrame:
    """Adds access: ok, forbidden (another owner's), or missing where the row has no owner."""
    return rows.withColumn("access", F.when(F.col(owner).isNull(), "missing").when(F.col(owner) == user, "ok").otherwise("forbidden"))


def any_matches(rows: DataFrame, array: str, **fields) -> DataFrame:
    """Rows whose array of structs has an element with these field values."""
    def same(x: Column) -> Column:
        out = F.lit(True)
        for k, v in fields.items():
            out = out & (x[k] == F.lit(v))
        return out

    return rows.where(F.exists(array, same))


def search(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows in which any of the columns has the text, whatever the case."""
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(text.lower()))
    return rows.where(out)


def incident(edges: DataFrame, nodes: DataFrame, node: str, source: str, target: str) -> DataFrame:
    """Edges with an end among the nodes."""
    n = nodes.select(F.col(node).alias("n_")).distinct()
    return edges.join(n, edges[source] == n["n_"], "left_semi").union(edges.join(n, edges[target] == n["n_"], "left_semi")).distinct()


def or_all(rows: DataFrame, test: Column) -> DataFrame:
    """Rows that pass the test, or all of them if none does. Whether any does is one row, a subquery of the plan, not a window over all."""
    any_ = rows.agg(F.coalesce(F.max(F.coalesce(test, F.lit(False)).cast("int")), F.lit(0)).alias("any_")).scalar()
    return rows.where(F.coalesce(test, F.lit(False)) | (any_ == 0))


def ordered_union(parts: list[DataFrame], key: str, order: str) -> DataFrame:
    """Distinct keys over the parts, those of earlier parts first."""
    every = None
    for k, p in enumerate(parts):
        own = p.select(key, order).withColumn("part_", F.lit(k))
        every = own if every is None else every.unionByName(own)
    return every.groupBy(key).agg(F.min(F.struct("part_", order)).alias("at_")).orderBy("at_").select(key, F.col("at_.part_").alias("part"))


def merged_maps(a: str, b: str) -> Column:
    """Entries of both maps; the second's win."""
    keep = F.map_filter(F.coalesce(F.col(a), F.create_map().cast("map<string,string>")), lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(b), k), F.lit(False)))
    return F.map_concat(keep, F.coalesce(F.col(b), F.create_map().cast("map<string,string>")))


def division(has: DataFrame, needs: DataFrame, group: str, item: str, target: str, at_least: str | None = None) -> DataFrame:
    """For each group and target the share of the target's items that the group has, where it has all of them (or ``at_least``)."""
    wanted = needs.groupBy(target).agg(F.count_distinct(item).alias("n_required"), *([F.max(at_least).alias("least_")] if at_least else []))
    got = has.select(group, item).distinct().join(needs.select(target, item).distinct(), item).groupBy(group, target).agg(F.count("*").alias("n_matched"))
    out = got.join(wanted, target)
    return out.where(F.col("n_matched") >= (F.coalesce("least_", "n_required") if at_least else F.col("n_required"))).withColumn("match_type", F.when(F.col("n_matched") >= F.col("n_required"), "full").otherwise("partial")).drop("least_")


def islands(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Runs of consecutive positions: key, first, last, n."""
    w = Window.partitionBy(key).orderBy(position)
    return rows.withColumn("g_", F.col(position) - F.row_number().over(w)).groupBy(key, "g_").agg(F.min(position).alias("first_pos"), F.max(position).alias("last_pos"), F.count("*").alias("n")).drop("g_")


# -- request checks --------------------------------------------------------------------------------------------------

def password_score(p: Column) -> Column:
    """A point each for 8 and 12 characters, lower, upper, digit, sign."""
    tests = [F.length(p) >= 8, F.length(p) >= 12, p.rlike("[a-z]"), p.rlike("[A-Z]"), p.rlike("[0-9]"), p.rlike("[^A-Za-z0-9]")]
    out = F.lit(0)
    for t in tests:
        out = out + t.cast("int")
    return out


def password_label(score: Column) -> Column:
    return F.when(score <= 1, "Very Weak").when(score == 2, "Weak").when(score == 3, "Fair").when(score <= 5, "Strong").otherwise("Very Strong")


def registration_errors(name: Column, email: Column, password: Column) -> Column:
    """Names of the failed checks."""
    checks = [("name", F.length(name).between(2, 100)), ("email", email.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")), ("password_length", F.length(password) >= 8),
              ("password_upper", password.rlike("[A-Z]")), ("password_lower", password.rlike("[a-z]")), ("password_digit", password.rlike("[0-9]"))]
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in checks]))


def acceptable_upload(name: Column, mime: Column, n_bytes: Column, most_mb: int = 50) -> Column:
    zipped = mime.isin("application/zip", "application/x-zip-compressed", "application/octet-stream") | F.lower(name).endswith(".zip")
    return F.coalesce(zipped & (n_bytes <= most_mb * 1024 * 1024), F.lit(False))
