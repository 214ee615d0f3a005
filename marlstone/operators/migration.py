"""Dependency differences between consecutive releases, and which packages replace which."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.arrays import jaccard, ordered_difference, ordered_intersection, scaled_vote, votes

#: Rules of the grade tiers (fixed values).
TIERS = {"strict": {"votes": 12, "months": 10, "a_rate": 0.03}, "recommended": {"votes": 8, "months": 5, "share": 0.10}, "loose": {"votes": 3}}
LEAST_LIFT, DEFAULT_VOTES, DEFAULT_MONTHS = 5, 5, 3


#: What is taken off a repository's address (fixed pattern): an ending, and one prefix.
ADDRESS = r"\.git$|^git\+|^https?://|^git://|^ssh://git@"


def publisher(name: Column, repository: Column) -> Column:
    """The scope of a scoped name, else the normalised repository, else the name."""
    bare = F.trim(F.regexp_replace(F.lower(repository), ADDRESS, ""))
    return F.when(name.startswith("@"), F.split_part(name, F.lit("/"), F.lit(1))).otherwise(F.coalesce(F.nullif(bare, F.lit("")), name))


def transitions(releases: DataFrame, by: list[str], order: list, deps: str = "deps", others: str | None = None, version: str = "version", at: str = "published_at", keep: list[str] = ()) -> DataFrame:
    """Each release against the one before it in its line: removed, reclassified (moved to ``others``) and added, in order.

    ``order`` must be total. A release whose ``deps`` is null is unknown, not empty: its arrays come out null.
    """
    w = W.partitionBy(*by).orderBy(*order)
    rows = releases.withColumn("from_version", F.lag(version).over(w)).withColumn("__was", F.lag(deps).over(w)).withColumn("__n", F.row_number().over(w)).where("__n > 1")
    gone = ordered_difference(F.col("__was"), F.col(deps))
    other = F.coalesce(F.col(others), F.array().cast(rows.schema[deps].dataType)) if others else F.array().cast(rows.schema[deps].dataType)
    return rows.select(
        *by, *keep, "from_version", F.col(version).alias("to_version"), F.col(at).alias("to_ts"),
        ordered_difference(gone, other).alias("removed"), ordered_intersection(gone, other).alias("reclassified"), ordered_difference(F.col(deps), F.col("__was")).alias("added"),
    )


def removal_events(trans: DataFrame) -> DataFrame:
    """Removals that come with additions; each of k additions gets 1/k of a vote, as an integer."""
    k = F.size("added")
    return trans.where(k > 0).select("*", F.explode("removed").alias("removed_pkg")).withColumn("added_count", k).withColumn("vote", scaled_vote(k))


def base_rates(trans: DataFrame) -> DataFrame:
    """The share of all transitions that add a package."""
    n = trans.agg(F.count("*").alias("n"))
    return trans.select(F.explode("added").alias("to_pkg")).groupBy("to_pkg").agg(F.count("*").alias("adds")).crossJoin(n).select("to_pkg", F.try_divide(F.col("adds").cast("double"), "n").alias("b_rate"))


def month_key(publisher_: str, at: str) -> Column:
    """A4: publisher and month as one value."""
    return F.concat_ws("|", F.col(publisher_).cast("string"), F.date_format(at, "yyyy-MM"))


def migration_pairs(trans: DataFrame, name: str = "name", publisher_: str = "publisher") -> DataFrame:
    """For each (removed, added) pair: votes, co-events, publisher months, dependents, rates, lift, first and last seen."""
    pairs = (
        removal_events(trans).select("*", F.explode("added").alias("to_pkg")).where("to_pkg <> removed_pkg")
        .groupBy(F.col("removed_pkg").alias("from_pkg"), "to_pkg")
        .agg(
            F.sum(F.col("vote").cast("decimal(38,0)")).alias("votes_scaled"), F.count("*").alias("co_events"), F.countDistinct(month_key(publisher_, "to_ts")).alias("publisher_months"),
            F.countDistinct(name).alias("dependents"), F.min("to_ts").alias("first_seen"), F.max("to_ts").alias("last_seen"),
        )
    )
    counts = occurrences(trans)
    total = counts.where("n_removed > 0").select(F.col("pkg").alias("from_pkg"), F.col("n_removed").alias("removal_events"))
    every = counts.where("n_all > 0").select(F.col("n_all").alias("n"))
    rate = counts.where("n_added > 0").crossJoin(every).select(F.col("pkg").alias("to_pkg"), F.try_divide(F.col("n_added").cast("double"), "n").alias("b_rate"))
    rated = pairs.join(total, "from_pkg").join(rate, "to_pkg").withColumn("votes", votes(F.col("votes_scaled"))).withColumn("a_rate", F.col("co_events").cast("double") / F.col("removal_events"))
    return rated.withColumn("lift", F.try_divide("a_rate", "b_rate"))


def occurrences(trans: DataFrame) -> DataFrame:
    """(pkg, n_added, n_removed, n_all) in one pass: transitions that add a package, removals of it that come with additions, and, in the
    one row without a package, the number of transitions."""
    kind = dict(trans.dtypes)["added"].removeprefix("array<").removesuffix(">")
    one = lambda x, tag: F.struct(x.cast(kind).alias("pkg"), F.lit(tag).alias("tag"))
    none = F.array().cast(f"array<struct<pkg:{kind},tag:string>>")
    tagged = lambda c, tag: F.coalesce(F.transform(c, lambda x: one(x, tag)), none)
    gone = F.when(F.size("added") > 0, F.col("removed"))
    rows = trans.select(F.explode(F.concat(F.array(one(F.lit(None), "all")), tagged(F.col("added"), "added"), tagged(gone, "removed"))).alias("x")).select("x.*")
    return rows.groupBy("pkg").agg(*[F.count_if(F.col("tag") == t).alias(f"n_{t}") for t in ("added", "removed", "all")])


def with_shares(pairs: DataFrame, least_lift: float = LEAST_LIFT, least_votes: float = 3) -> DataFrame:
    """Pairs of enough lift with share of votes, share of publisher months, and whether the reverse pair is strong as well."""
    w = W.partitionBy("from_pkg")
    strong = pairs.where((F.col("lift") >= least_lift) & (F.col("votes") >= least_votes)).select(F.col("from_pkg").alias("to_pkg"), F.col("to_pkg").alias("from_pkg"), F.lit(True).alias("bidirectional"))
    rows = pairs.where(F.col("lift") >= least_lift)
    rows = rows.withColumn("share", F.col("votes_scaled").cast("double") / F.sum("votes_scaled").over(w).cast("double")).withColumn("share_pm", F.col("publisher_months").cast("double") / F.sum("publisher_months").over(w))
    return rows.join(strong, ["from_pkg", "to_pkg"], "left").withColumn("bidirectional", F.coalesce("bidirectional", F.lit(False)))


def strict() -> Column:
    t = TIERS["strict"]
    return (F.col("votes") >= t["votes"]) & (F.col("publisher_months") >= t["months"]) & (F.col("a_rate") >= t["a_rate"])


def recommended() -> Column:
    t = TIERS["recommended"]
    return (F.col("votes") >= t["votes"]) & (F.col("publisher_months") >= t["months"]) & (F.col("share") >= t["share"])


def grade() -> Column:
    """The strongest tier that a pair reaches."""
    return F.when(strict(), "strict").when(recommended(), "recommended").otherwise("loose")


def passes_default() -> Column:
    return (F.col("votes") >= DEFAULT_VOTES) & (F.col("publisher_months") >= DEFAULT_MONTHS)


def _removed(trans: DataFrame) -> DataFrame:
    return trans.select("*", F.explode("removed").alias("removed_pkg")).withColumn("replaced", F.coalesce(F.size("added"), F.lit(0)) > 0)


def removal_stats(trans: DataFrame, name: str = "name", publisher_: str = "publisher") -> DataFrame:
    """All removals of a package, with and without replacement."""
    return _removed(trans).groupBy("removed_pkg").agg(
        F.count("*").alias("removals_total"), F.count_if(~F.col("replaced")).alias("removals_no_replacement"), F.count_if("replaced").alias("removals_with_replacement"),
        F.countDistinct(name).alias("dependents"), F.countDistinct(month_key(publisher_, "to_ts")).alias("publisher_months"), F.min("to_ts").alias("first_seen"), F.max("to_ts").alias("last_seen"),
    )


def removals_by_year(trans: DataFrame, name: str = "name") -> DataFrame:
    """D11."""
    return _removed(trans).groupBy("removed_pkg", F.year("to_ts").alias("year")).agg(F.count("*").alias("removals"), F.count_if(~F.col("replaced")).alias("removals_no_replacement"), F.countDistinct(name).alias("dependents"))


def removals_by_period(trans: DataFrame, periods: DataFrame, name: str = "name") -> DataFrame:
    """Removals in (t1, t2] of each of a few overlapping periods (period, t1, t2)."""
    rows = _removed(trans).join(periods, (F.col("to_ts") > F.col("t1")) & (F.col("to_ts") <= F.col("t2")))
    return rows.groupBy("period", "removed_pkg").agg(
        F.count("*").alias("removals"), F.count_if(~F.col("replaced")).alias("removals_no_replacement"), F.count_if("replaced").alias("removals_with_replacement"), F.countDistinct(name).alias("dependents")
    )


def not_monotonic(by_period: DataFrame, stats: DataFrame, order: tuple[str, ...] = ("1y", "3y", "5y")) -> DataFrame:
    """Packages with more removals in a shorter period than in a longer one or in all; must be empty."""
    wide = by_period.groupBy("removed_pkg").agg(*[F.coalesce(F.max(F.when(F.col("period") == p, F.col("removals"))), F.lit(0)).alias(p) for p in order]).join(stats.select("removed_pkg", "removals_total"), "removed_pkg")
    steps = [*[F.col(p) for p in order], F.col("removals_total")]
    wrong = F.lit(False)
    for a, b in zip(steps, steps[1:], strict=False):
        wrong = wrong | (a > b)
    return wide.where(wrong)


def adopters(releases: DataFrame, from_pkgs: DataFrame, name: str = "name", deps: str = "deps") -> DataFrame:
    """How many packages ever declared one of ``from_pkgs`` (from_pkg). A semi join by element; no list is collected."""
    return releases.select(name, F.explode(deps).alias("from_pkg")).join(from_pkgs.select("from_pkg").distinct(), "from_pkg", "left_semi").agg(F.countDistinct(name).alias("adopters"))


def funnel(pairs: DataFrame) -> DataFrame:
    """How many pairs each further condition leaves, in one aggregate."""
    lift = F.col("lift") >= LEAST_LIFT
    steps = {"all_pairs": F.lit(True), "lift": lift, "votes3": lift & (F.col("votes") >= 3), "votes5_pm3": lift & passes_default(), "strict": lift & strict()}
    return pairs.agg(*[F.count_if(c).alias(k) for k, c in steps.items()])


def map_summary(pairs: DataFrame) -> DataFrame:
    """For each source: number of targets, the top target and its share."""
    top = F.max(F.struct("share", "to_pkg"))
    return pairs.groupBy("from_pkg").agg(F.count("*").alias("n_targets"), top["to_pkg"].alias("top_target"), top["share"].alias("top_share"))


def evidence(trans: DataFrame, removed, added) -> DataFrame:
    """Transitions that removed one package and added the other."""
    return trans.where(F.array_contains("removed", removed) & F.array_contains("added", added))


def reclassify_effect(legacy: DataFrame, full: DataFrame) -> DataFrame:
    """Legacy pairs beside those with the reclassification rule: gone, demoted (fewer votes), or same."""
    keys = ["from_pkg", "to_pkg"]
    both = legacy.select(*keys, F.col("votes").alias("votes_legacy")).join(full.select(*keys, F.col("votes").alias("votes_full")), keys, "full")
    return both.withColumn("effect", F.when(F.col("votes_full").isNull(), "gone").when(F.col("votes_legacy").isNull(), "new").when(F.col("votes_full") < F.col("votes_legacy"), "demoted").otherwise("same"))


def feature_candidates(pairs: DataFrame, trans: DataFrame, per_group: int = 5) -> DataFrame:
    """For each source its ``per_group`` strongest pairs with one example transition, the latest (ties by name and version)."""
    w = W.partitionBy("from_pkg").orderBy(F.desc("votes"), "to_pkg")
    some = pairs.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= per_group)
    example = removal_events(trans).select("*", F.explode("added").alias("to_pkg")).groupBy(F.col("removed_pkg").alias("from_pkg"), "to_pkg").agg(F.max(F.struct("to_ts", "name", "to_version")).alias("example"))
    return some.join(example, ["from_pkg", "to_pkg"], "left")


def peer_verdict(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Jaccard of two declared sets with a four-way verdict (null if either set is unknown)."""
    x, y = F.col(a), F.col(b)
    score = jaccard(x, y)
    verdict = F.when(x.isNull() | y.isNull(), F.lit(None).cast("string")).when((F.size(x) == 0) & (F.size(y) == 0), "both_empty").when((F.size(x) == 0) | (F.size(y) == 0), "one_empty").when(score > 0, "overlap").otherwise("disjoint")
    return pairs.withColumn("peer_jaccard", score).withColumn("peer_verdict", verdict)

