"""Requirement resolution and historical dependents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import semver
from .windows import deltas, islands, running

KINDS = (("Dependencies", "regular"), ("PeerDependencies", "peer"), ("OptionalDependencies", "optional"))


def declarations(requirements: DataFrame, keys: list[str], kinds=KINDS) -> DataFrame:
    """One row for each declaration with kind and original index; null arrays have none."""
    tagged = lambda c, k: F.transform(F.col(c), lambda x, i: F.struct(F.lit(k).alias("kind"), i.alias("declaration_index"), x["Name"].alias("declared_name"), x["Requirement"].alias("requirement")))
    kind = "array<struct<kind:string,declaration_index:int,declared_name:string,requirement:string>>"
    every = F.concat(*[F.coalesce(tagged(c, k).cast(kind), F.array().cast(kind)) for c, k in kinds])
    return requirements.select(*keys, F.explode(every).alias("d")).select(*keys, "d.*")


def lookup_id(name: Column, requirement: Column) -> Column:
    """SHA-256 of the (name, requirement) pair as JSON, nulls kept."""
    return F.sha2(F.to_json(F.struct(name.alias("name"), requirement.alias("requirement")), {"ignoreNullFields": "false"}), 256)


def lookups(declared: DataFrame) -> DataFrame:
    """Distinct (declared_name, requirement) with lookup_id: what is resolved once however often it is declared."""
    return declared.select("declared_name", "requirement").distinct().withColumn("lookup_id", lookup_id(F.col("declared_name"), F.col("requirement")))


def resolve(looked: DataFrame, versions: DataFrame) -> DataFrame:
    """``looked`` with status, target_version. ``versions``: name, version.

    The greatest version in a range is the last one before the range's upper bound, if that is not below the lower bound. So bounds
    and versions of a name are put in one order and each bound takes the version before it: a name with many versions and many
    requirements costs their sum, not their product. Equal versions are one, by the smaller text.

    Texts are parsed once for each distinct one: they come out of aggregates, below which the engine can't move a test of what they say.
    """
    once = looked.groupBy("lookup_id").agg(F.min("declared_name").alias("declared_name"), F.min("requirement").alias("requirement"))
    spec = once.withColumn("status", semver.spec_status(F.col("declared_name"), F.col("requirement"))).withColumn("ranges", semver.parse_range(F.col("requirement")))
    distinct = versions.groupBy("name", "version").agg(F.min("version").alias("v")).select(F.col("name").alias("declared_name"), F.col("v").alias("version"))
    eligible = distinct.where(semver.classify(F.col("version")) == "ELIGIBLE").groupBy("declared_name", semver.key(F.col("version")).alias("key")).agg(F.min("version").alias("version"))
    place = lambda key, side: F.struct(key.isNull().alias("end"), key.alias("key"), F.lit(side).alias("side") if isinstance(side, int) else side.alias("side"))
    ranges = spec.where("status is null").select("declared_name", "lookup_id", F.explode("ranges").alias("r"))
    # an open bound stands before an equal version, a closed one behind it
    bound = place(F.col("r.hi"), F.when(F.col("r.hi_open") | F.col("r.pre").isNotNull(), 0).otherwise(2))
    none = F.lit(None)
    both = ranges.select("declared_name", bound.alias("at"), none.cast("struct<key:array<bigint>,version:string>").alias("v"), "lookup_id", "r").unionByName(
        eligible.select("declared_name", place(F.col("key"), 1).alias("at"), F.struct("key", "version").alias("v"), none.cast("string").alias("lookup_id"), none.cast(semver.INTERVAL).alias("r"))
    )
    before = F.last("v", ignorenulls=True).over(W.partitionBy("declared_name").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    met = both.withColumn("v", before).where(F.col("lookup_id").isNotNull() & F.col("v").isNotNull()).where(semver.satisfies(F.col("v.key"), F.array("r")))
    best = met.groupBy("lookup_id").agg(F.max_by("v.version", "v.key").alias("target_version"))
    some = eligible.select("declared_name").distinct().withColumn("known", F.lit(True))
    out = spec.join(best, "lookup_id", "left").join(some, "declared_name", "left")
    status = F.coalesce("status", F.when(F.col("target_version").isNotNull(), "RESOLVED").when(F.col("known"), "NO_SATISFYING_VERSION").otherwise("NO_ELIGIBLE_TARGET"))
    return out.select("lookup_id", "declared_name", "requirement", status.alias("status"), "target_version")


def edges(declared: DataFrame, resolved: DataFrame, source: list[str]) -> DataFrame:
    """One row for each (source, target) with its kinds as a sorted set."""
    both = declared.withColumn("lookup_id", lookup_id(F.col("declared_name"), F.col("requirement"))).join(resolved.where("status = 'RESOLVED'").select("lookup_id", "target_version"), "lookup_id")
    return both.groupBy(*source, F.col("declared_name").alias("target_name"), "target_version").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))


def dependents_count(edge_list: DataFrame, population: DataFrame, source: str, target: list[str], errors: DataFrame | None = None) -> DataFrame:
    """Distinct dependents of each member of ``population``, 0 without any; null with a reason where ``errors`` (target keys) says so."""
    counts = edge_list.select(source, *target).distinct().groupBy(*target).agg(F.count("*").alias("dependents_count"))
    out = population.join(counts, target, "left").withColumn("dependents_count", F.coalesce("dependents_count", F.lit(0).cast("long")))
    if errors is None:
        return out
    bad = errors.select(*target).distinct().withColumn("__bad", F.lit(True))
    return out.join(bad, target, "left").withColumn("null_reason", F.when(F.col("__bad"), "DEPENDENCY_ERROR")).withColumn("dependents_count", F.when(F.col("__bad").isNull(), F.col("dependents_count"))).drop("__bad")


def birth_index(events: DataFrame, calendar: DataFrame, at: str, last: int) -> DataFrame:
    """The first calendar slot at or after an instant, ``last`` behind the calendar: the calendar's dates cut the time into half-open
    stretches, which are a small table of their own, met by the stretch's number as an array search finds it."""
    slots = calendar.agg(F.sort_array(F.collect_list(F.struct("snapshot_timestamp", "slot"))).alias("s")).first()["s"]
    if not slots:
        return events.withColumn("birth_index", F.lit(last))
    found = F.lit(last)
    # a balanced tree of comparisons, as the calendar is a parameter of some hundred dates
    def tree(low: int, high: int):
        if low == high:
            return F.lit(slots[low]["slot"]) if low < len(slots) else found
        middle = (low + high) // 2
        return F.when(F.col(at) <= F.lit(slots[middle]["snapshot_timestamp"]), tree(low, middle)).otherwise(tree(middle + 1, high))

    return events.withColumn("birth_index", F.when(F.col(at).isNull(), found).otherwise(tree(0, len(slots))))


def winners_over_time(candidates: DataFrame, by: list[str], close: int) -> DataFrame:
    """``candidates`` (by, birth_index, rank, target) -> [start_index, end_index) with the winning target: greatest rank so far.

    One candidate a birth (the best), a running maximum over births, change points, and lead: no list of versions is ever collected.
    """
    each = candidates.groupBy(*by, "birth_index").agg(F.max(F.struct("rank", "target")).alias("best"))
    w = W.partitionBy(*by).orderBy("birth_index")
    top = each.withColumn("best", F.max("best").over(w.rowsBetween(W.unboundedPreceding, 0)))
    changed = top.withColumn("was", F.lag("best").over(w)).where(F.col("was").isNull() | (F.col("best") != F.col("was")))
    return changed.select(*by, F.col("birth_index").alias("start_index"), F.coalesce(F.lead("birth_index").over(w), F.lit(close)).alias("end_index"), F.col("best.target").alias("target")).where("start_index < end_index")


def weighted_births(declared: DataFrame) -> DataFrame:
    """Equal (lookup_id, birth_index) collapsed into a weight before any interval is expanded."""
    return declared.groupBy("lookup_id", "birth_index").agg(F.count("*").alias("weight"))


def dependents_over_time(declared: DataFrame, intervals: DataFrame, close: int) -> DataFrame:
    """(target, start_index, end_index, active): distinct sources of each target over the calendar.

    ``declared``: source, lookup_id, birth_index; ``intervals``: lookup_id, start_index, end_index, target. A source that reaches a
    target by several declarations counts once: its intervals are merged first. Nothing is expanded to calendar slots.
    """
    cut = declared.join(intervals, "lookup_id").withColumn("start_index", F.greatest("birth_index", "start_index")).where("start_index < end_index")
    merged = islands(cut, ["source", "target"])
    return running(deltas(merged, ["target"]), ["target"], close)


def weighted_sweep(weights: DataFrame, intervals: DataFrame, close: int) -> DataFrame:
    """(target, start_index, end_index, active) where each (lookup_id, birth_index) counts its weight."""
    cut = weights.join(intervals, "lookup_id").withColumn("start_index", F.greatest("birth_index", "start_index")).where("start_index < end_index")
    return running(deltas(cut, ["target"], weight=F.col("weight")), ["target"], close)


#: Statuses of a source, in order of precedence (fixed values).
SOURCE_STATUSES = ("MISSING_REQUIREMENTS", "NULL_DEPENDENCY_LIST", "DEPENDENCY_EXTRACTION_ERROR", "DEPENDENCY_EXTRACTION_UNKNOWN", "OBSERVED_NO_DEPENDENCIES", "RESOLVED", "PARTIAL", "UNRESOLVED")


def standing(declared: Column) -> Column:
    """The status that a source has all the time, whatever resolves; null if that depends. From has_requirements, null_dependencies and dependency_error."""
    return (
        F.when(~F.col("has_requirements"), SOURCE_STATUSES[0]).when(F.col("null_dependencies"), SOURCE_STATUSES[1]).when(F.col("dependency_error"), SOURCE_STATUSES[2])
        .when(F.col("dependency_error").isNull(), SOURCE_STATUSES[3]).when(declared == 0, SOURCE_STATUSES[4])
    )


def source_intervals(sources: DataFrame, resolved: DataFrame, close: int) -> DataFrame:
    """(source, start_index, end_index, resolved_count, unresolved_count, status) from each source's birth to ``close``.

    ``sources``: source, birth_index, has_requirements, null_dependencies, dependency_error, declaration_count. ``resolved``: source,
    start_index, end_index of each declaration while it is resolved. A source's intervals change where the number of its
    resolved declarations does; a change of the target alone changes nothing.
    """
    births = sources.select("source", F.col("birth_index").alias("index"), F.lit(0).cast("long").alias("delta"))
    steps = births.unionByName(deltas(resolved, ["source"]).select("source", "index", F.col("delta").cast("long").alias("delta"))).groupBy("source", "index").agg(F.sum("delta").alias("delta"))
    w = W.partitionBy("source").orderBy("index")
    parts = steps.select(
        "source", F.col("index").alias("start_index"), F.lead("index", 1, close).over(w).alias("end_index"), F.sum("delta").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("resolved_count")
    ).where("start_index < end_index")
    n = F.col("declaration_count")
    status = F.coalesce(standing(n), F.when(F.col("resolved_count") == n, SOURCE_STATUSES[5]).when(F.col("resolved_count") > 0, SOURCE_STATUSES[6]).otherwise(SOURCE_STATUSES[7]))
    return parts.join(sources.drop("birth_index"), "source").select("source", "start_index", "end_index", "resolved_count", (n - F.col("resolved_count")).alias("unresolved_count"), status.alias("status"))


def first_resolutions(declared: DataFrame, firsts: DataFrame) -> DataFrame:
    """For each source declaration_count, never_resolved_count, and the first and last index at which a declaration of it is first resolved.

    ``declared``: source, birth_index, lookup_id; ``firsts``: lookup_id, first_resolved. A declaration isn't resolved before its source is born.
    """
    at = F.when(F.col("first_resolved").isNotNull(), F.greatest("birth_index", "first_resolved"))
    return declared.join(firsts, "lookup_id", "left").withColumn("at", at).groupBy("source").agg(
        F.min("birth_index").alias("birth_index"), F.count("*").alias("declaration_count"), F.count_if(F.col("at").isNull()).alias("never_resolved_count"), F.min("at").alias("first_any"), F.max("at").alias("last_first")
    )


def source_status(sources: DataFrame, close: int) -> DataFrame:
    """(source, start_index, end_index, status): one interval of a standing status, or UNRESOLVED until the first declaration is
    resolved, PARTIAL until the last one is, and RESOLVED from then on, where what is once resolved stays so.

    ``sources``: as :func:`first_resolutions` gives them, with has_requirements, null_dependencies and dependency_error.
    """
    part = lambda a, b, s: F.struct(a.cast("int").alias("start_index"), b.cast("int").alias("end_index"), s.alias("status"))
    born, end, always = F.col("birth_index"), F.lit(close), standing(F.col("declaration_count"))
    some, every = F.coalesce("first_any", end), F.when(F.col("never_resolved_count") == 0, F.coalesce("last_first", end)).otherwise(end)
    turns = F.array(part(born, some, F.lit("UNRESOLVED")), part(some, every, F.lit("PARTIAL")), part(every, end, F.lit("RESOLVED")))
    rows = F.when(always.isNotNull(), F.array(part(born, end, always))).otherwise(turns)
    return sources.select("source", F.explode(rows).alias("s")).select("source", "s.*").where("start_index < end_index")


def status_series(intervals: DataFrame, close: int, status: str = "status") -> DataFrame:
    """How many are in each status over the calendar."""
    return running(deltas(intervals, [status]), [status], close)


def closes_to_zero(intervals: DataFrame, by: list[str]) -> DataFrame:
    """Groups whose deltas don't sum to zero; must be empty."""
    return deltas(intervals, by).groupBy(*by).agg(F.sum("delta").alias("left")).where("left <> 0")


def population_over_time(births: DataFrame, close: int) -> DataFrame:
    """Cumulative population by index, from counts of births, without versions x calendar."""
    counts = births.groupBy("birth_index").agg(F.count("*").alias("born"))
    return counts.withColumn("population", F.sum("born").over(W.orderBy("birth_index").rowsBetween(W.unboundedPreceding, 0))).where(F.col("birth_index") < close)


def workload(declared: DataFrame, eligible: DataFrame, top: int = 50) -> tuple[DataFrame, DataFrame]:
    """(size buckets of candidates x lookups, the ``top`` heaviest names). Products are decimals: they outgrow 64 bits."""
    asked = declared.groupBy("declared_name").agg(F.countDistinct("requirement").alias("n_lookups"), F.count("*").alias("n_declarations"))
    sizes = asked.join(eligible.groupBy(F.col("name").alias("declared_name")).agg(F.count("*").alias("n_candidates")), "declared_name", "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
    work = sizes.withColumn("work", F.col("n_candidates").cast("decimal(38,0)") * F.col("n_lookups").cast("decimal(18,0)"))
    bucket = F.when(F.col("work") == 0, "0").when(F.col("work") < 100, "1-99").when(F.col("work") < 10_000, "100-9999").otherwise("10000+")
    return work.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("names"), F.sum("work").alias("work")), work.orderBy(F.desc("work"), "declared_name").limit(top)


def interval_load(bins: DataFrame) -> DataFrame:
    """LD5: (day) total, positive count and greatest number of active intervals, from distinct (day, start, end, n) bins."""
    net = deltas(bins, ["day"], "start", "end", F.col("n"))
    w = W.partitionBy("day").orderBy("index").rowsBetween(W.unboundedPreceding, 0)
    most = net.withColumn("active", F.sum("delta").over(w)).groupBy("day").agg(F.max("active").alias("most"))
    return bins.groupBy("day").agg(F.sum("n").alias("total"), F.count(F.when(F.col("n") > 0, 1)).alias("positive")).join(most, "day", "left")
