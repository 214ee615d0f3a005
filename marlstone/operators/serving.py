"""Serving queries and load-time operators (SQ1-SQ17, LD1-LD4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .relational import best, qualify_first, top_with_rest
from .timeseries import without_leading_zeros


def names_table(df: DataFrame, names: list[str]) -> DataFrame:
    """The rows of a bounded list of names."""
    return df.where(F.col("name").isin(*names))


def overview(versions: DataFrame, metrics: DataFrame, names: list[str]) -> DataFrame:
    """SQ1: latest version with licenses, and the latest metrics with their change from the snapshot before."""
    latest = names_table(versions, names).groupBy("name").agg(best(F.struct("version", "licenses"), "ordinal").alias("v"))
    w = W.partitionBy("name").orderBy(F.desc("snapshot_at"))
    some = names_table(metrics, names).withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    values = [c for c in metrics.columns if c not in ("name", "snapshot_at")]
    change = some.select("name", "snapshot_at", "rn", *values, *[(F.col(c) - F.lead(c).over(w)).alias(f"{c}_delta") for c in values]).where("rn = 1").drop("rn")
    return latest.join(change, "name", "left").select("name", "v.version", "v.licenses", *[c for c in change.columns if c != "name"])


def downloads_trend(metrics: DataFrame, names: list[str], first: Column, last: Column) -> DataFrame:
    """SQ2, W19: metrics in a window with the previous snapshot's date (of the calendar, not of the package)."""
    days = metrics.select("snapshot_at").distinct()
    calendar = days.withColumn("previous_at", F.lag("snapshot_at").over(W.orderBy("snapshot_at")))
    return names_table(metrics, names).where(F.col("snapshot_at").between(first, last)).join(calendar, "snapshot_at")


def major(version: Column) -> Column:
    """leading digits, '' without any."""
    return F.regexp_extract(version, r"^[0-9]+", 0)


def numeric_first(m: Column) -> list[Column]:
    """L3: numeric majors in order of number, then the rest by text."""
    return [F.when(m.rlike(r"^[0-9]+$"), 0).otherwise(1), m.try_cast("decimal(38,0)"), m]


def dependents_trend(facts: DataFrame, names: list[str], first: Column, last: Column) -> DataFrame:
    """SQ3: dependents by major and snapshot, leading zeros cut."""
    rows = names_table(facts, names).where(F.col("snapshot_at").between(first, last))
    sums = rows.groupBy("name", F.split_part("version", F.lit("."), F.lit(1)).alias("major"), "snapshot_at").agg(F.sum("dependents").alias("dependents"))
    return without_leading_zeros(sums, ["name", "major"], "snapshot_at", "dependents")


def version_share(facts: DataFrame, names: list[str], at: Column | None = None) -> DataFrame:
    """SQ4, A13: share of dependents by major at a date, by default the latest."""
    rows = names_table(facts, names)
    day = rows.agg(F.max("snapshot_at").alias("__at")) if at is None else rows.sparkSession.range(1).select(at.alias("__at"))
    here = rows.join(F.broadcast(day), F.col("snapshot_at") == F.col("__at"))
    sums = here.groupBy("name", "snapshot_at", F.split_part("version", F.lit("."), F.lit(1)).alias("major")).agg(F.sum("dependents").alias("dependents"))
    return sums.withColumn("share", F.try_divide(F.col("dependents").cast("double"), F.sum("dependents").over(W.partitionBy("name"))))


def similar(pairs: DataFrame, packages: DataFrame, name: str, n: int) -> DataFrame:
    """SQ5, J1: the first ``n`` similar packages by rank, with names of both sides."""
    a, b = packages.select(F.col("package_id").alias("a_id"), F.col("name").alias("name")), packages.select(F.col("package_id").alias("b_id"), F.col("name").alias("similar"))
    return pairs.join(a.where(F.col("name") == name), "a_id").join(b, "b_id").orderBy("rank", "similar").limit(n).select("name", "similar", "rank")


def transition_status(row: dict[str, str] | None = None) -> Column:
    """SQ6: NO_DATA without a row, EMPTY where every count is 0, else OK."""
    total = F.col("retained") + F.col("inflow") + F.col("outflow") + F.col("unobserved")
    return F.when(total.isNull(), "NO_DATA").when(total == 0, "EMPTY").otherwise("OK")


def removal_reasons(scopes: DataFrame, reasons: DataFrame, period: str) -> DataFrame:
    """SQ7, J2: scope rows of a period with their reasons summed; a scope without reasons stays, with nulls."""
    sums = reasons.where(F.col("period") == period).groupBy("name", "period").agg(F.sum("removals").alias("removals"), F.sum("removals_no_replacement").alias("removals_no_replacement"))
    return scopes.where(F.col("period") == period).join(sums, ["name", "period"], "left")


def brief(versions: DataFrame, names: list[str], most: int = 50) -> DataFrame:
    """SQ8: latest version and description of at most ``most`` names."""
    if len(names) > most:
        raise ValueError(f"at most {most} names")
    return names_table(versions, names).groupBy("name").agg(best(F.struct("version", "description"), "ordinal").alias("v")).select("name", "v.*")


def like_escaped(text: str) -> str:
    """``text`` literally within a LIKE pattern whose escape is a backslash."""
    return text.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")


def search(packages: DataFrame, query: str, n: int = 20, popularity: str = "downloads") -> DataFrame:
    """SQ9, L3: names that contain the query: equal first, then beginning with it, then the rest; popular ones first, nulls last."""
    name, q = F.lower("name"), query.lower()
    tier = F.when(name == q, 0).when(name.startswith(q), 1).otherwise(2)
    return packages.where(name.like(f"%{like_escaped(q)}%")).withColumn("tier", tier).orderBy("tier", F.col(popularity).desc_nulls_last(), "name").limit(n)


def migration_targets(pairs: DataFrame, name: str, k: int = 5) -> DataFrame:
    """SQ10, L6: pairs of a source that pass the default filter; the first ``k`` by votes and one row 'etc' for the rest."""
    from .migration import passes_default

    rows = pairs.where((F.col("from_pkg") == name) & passes_default())
    return top_with_rest(rows, ["from_pkg"], "to_pkg", "votes", k)


def scope_flags(packages: DataFrame, **tables: DataFrame) -> DataFrame:
    """SQ11, P10: for each package whether each table has rows of it."""
    for flag, table in tables.items():
        packages = packages.join(table.select("name").distinct().withColumn(flag, F.lit(True)), "name", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return packages


def exists(df: DataFrame, condition: Column) -> bool:
    """SQ12."""
    return not df.where(condition).limit(1).isEmpty()


def existing(df: DataFrame, names: list[str]) -> DataFrame:
    return names_table(df, names).select("name").distinct()


def environments(envs: DataFrame, names: list[str], versions: list[str]) -> DataFrame:
    """SQ13: rows of (name, version) pairs given as two lists, in the order given."""
    spark = envs.sparkSession
    asked = spark.createDataFrame([(names, versions)], "n array<string>, v array<string>").select(F.posexplode(F.arrays_zip("n", "v")).alias("at", "p")).select("at", F.col("p.n").alias("name"), F.col("p.v").alias("version"))
    return envs.join(F.broadcast(asked), ["name", "version"])


def recent_versions(versions: DataFrame, names: list[str], n: int) -> DataFrame:
    """SQ14, J15: the latest ``n`` versions of each name; ``at`` is the name's place in the list."""
    spark = versions.sparkSession
    asked = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "at int, name string")
    return qualify_first(versions.join(F.broadcast(asked), "name"), ["at", "name"], [F.desc("ordinal"), "version"], n)


def best_of_majors(versions: DataFrame, names: list[str], n: int) -> DataFrame:
    """SQ15, W18: the greatest ordinal of each major, then the ``n`` latest majors of each name."""
    one = qualify_first(names_table(versions, names).withColumn("major", major(F.col("version"))), ["name", "major"], [F.desc("ordinal"), "version"])
    return qualify_first(one, ["name"], [F.desc("ordinal"), "version"], n)


def selected_issues(issues: DataFrame, since: Column, n: int) -> DataFrame:
    """SQ16: open or recently changed issues by comments, reactions and id."""
    return issues.where((F.col("state") == "open") | (F.col("updated_at") >= since)).dropDuplicates(["issue_id"]).orderBy(F.desc("comments"), F.desc("reactions"), "issue_id").limit(n)


def latest_comments(comments: DataFrame, n: int = 100) -> DataFrame:
    """SQ16: the latest ``n`` comments of each issue, each id once (its newest row)."""
    once = qualify_first(comments, ["issue_id", "comment_id"], [F.desc("created_at"), F.desc("body")])
    return qualify_first(once, ["issue_id"], [F.desc("created_at"), F.desc("comment_id")], n)


def to_clean_up(snapshots: DataFrame, keep: DataFrame, n: int) -> DataFrame:
    """SQ17: the ``n`` oldest snapshots that nothing refers to."""
    return snapshots.join(keep.select("snapshot_id"), "snapshot_id", "left_anti").orderBy("created_at", "snapshot_id").limit(n)


def ranked_pairs(raw: DataFrame, packages: DataFrame, most: int = 50) -> DataFrame:
    """LD1: both names to ids, no pair with itself, the best rank of each pair, re-ranked densely from 1, cut at ``most``."""
    ids = lambda a: packages.select(F.col("name").alias(f"{a}_name"), F.col("package_id").alias(f"{a}_id"))
    pairs = raw.join(ids("a"), "a_name").join(ids("b"), "b_name").where("a_id <> b_id").groupBy("a_id", "b_id").agg(F.min("rank").alias("source_rank"))
    w = W.partitionBy("a_id").orderBy("source_rank", "b_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def collapsed_scopes(scopes: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """LD2: one row a key; ``conflicts`` counts values that differ within it (must be 0)."""
    return scopes.groupBy(*keys).agg(*[F.min(v).alias(v) for v in values], sum((F.countDistinct(v) - 1 for v in values[1:]), F.countDistinct(values[0]) - 1).alias("conflicts"))


def resolution_counters(raw: DataFrame, packages: DataFrame, scope: DataFrame) -> DataFrame:
    """LD3: distinct names that resolve to no package, and packages that are out of scope."""
    known = packages.select("name", F.lit(True).alias("known")).distinct()
    inside = scope.select("name", F.lit(True).alias("inside")).distinct()
    rows = raw.join(known, "name", "left").join(inside, "name", "left")
    n = F.col("name")
    return rows.agg(F.countDistinct(F.when(F.col("known").isNull(), n)).alias("unresolved"), F.countDistinct(F.when(F.col("known") & F.col("inside").isNull(), n)).alias("out_of_scope"), F.countDistinct(F.when(F.col("inside"), n)).alias("matched"))


def load_quality(counters: DataFrame) -> dict:
    """LD4: the load's one-row record; nothing matched is an error."""
    row = counters.first().asDict()
    if not row["matched"]:
        raise ValueError(f"nothing matched: {row}")
    return row
