"""Activity per page and day, causal bursts, and features that read only what was known before a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.labels import is_bot

MASS_PAGES = 25
BASELINE_DAYS = 90
LEAST_STD = 1.0
LEAST_COUNT = 2
LEAST_Z = 3.0
CHANNELS = ("edits", "reverted_edits", "reverts", "bot_edits")


def with_channel(labels: DataFrame) -> DataFrame:
    """Adds ``day`` and ``channel``: reverts, then bots, then edits undone by the end of their day, then edits."""
    day = F.to_date("ts")
    undone = F.coalesce(F.to_date("reverted_by_ts") <= day, F.lit(False))
    channel = F.when(F.col("is_revert"), "reverts").when(is_bot(), "bot_edits").when(undone, "reverted_edits").otherwise("edits")
    return labels.withColumns({"day": day, "channel": channel})


def editor_days(labels: DataFrame) -> DataFrame:
    """Distinct pages of each editor and day, without bots and reverts: user_text, day, pages."""
    own = labels.filter(~F.col("is_revert") & ~is_bot() & F.col("user_text").isNotNull())
    return own.groupBy("user_text", F.to_date("ts").alias("day")).agg(F.count_distinct("page_id").alias("pages"))


def mass_editor_days(labels: DataFrame, mass_pages: int = MASS_PAGES) -> DataFrame:
    return editor_days(labels).filter(F.col("pages") > mass_pages)


def daily_activity(labels: DataFrame, mass_pages: int = MASS_PAGES) -> DataFrame:
    """One row per page and day with a revision: the channels, kept_edits, editors, those without mass editors, and the size at its end."""
    rows = with_channel(labels).withColumn("_user", F.coalesce("user_text", F.concat(F.lit("\0"), F.col("revision_id").cast("string"))))  # hidden users are no key
    mass = mass_editor_days(labels, mass_pages).select(F.col("user_text").alias("_user"), "day", F.lit(True).alias("mass"))
    rows = rows.join(mass, ["_user", "day"], "left")
    edit, own = F.col("channel") == "edits", F.col("mass").isNull()
    total = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    size = F.max(F.when(F.col("byte_size").isNotNull(), F.struct("revision_id", "byte_size")))
    counts = {c: total(F.col("channel") == c) for c in CHANNELS}
    counts["kept_edits"] = total(F.col("channel").isin("edits", "reverted_edits") & ~F.col("is_reverted"))
    counts["mass_edits"] = total(edit & ~own)
    by_user = rows.groupBy("page_id", "day", "user_text").agg(*[n.alias(c) for c, n in counts.items()], size.alias("size"))
    named = F.col("user_text").isNotNull() & (F.col("user_text") != "") & (F.col("edits") > 0)
    out = by_user.groupBy("page_id", "day").agg(
        *[F.sum(c).alias(c) for c in counts],
        F.count_if(named).alias("editors"),
        F.count_if(named & (F.col("edits") > F.col("mass_edits"))).alias("editors_excl_mass"),
        F.max("size")["byte_size"].alias("byte_size_eod"),
    )
    return out.select("page_id", "day", *CHANNELS, "kept_edits", "editors", "editors_excl_mass", "mass_edits", "byte_size_eod")


def _z(count: Column, base: Column, squares: Column, days: Column) -> Column:
    mean = F.when(days > 0, base / days).otherwise(0.0)
    variance = F.when(days > 0, squares / days - mean * mean).otherwise(0.0)
    return (count - mean) / F.greatest(F.sqrt(F.greatest(variance, F.lit(0.0))), F.lit(LEAST_STD))


def with_bursts(daily: DataFrame) -> DataFrame:
    """Adds first_day, burst_z and is_burst of each day's edits against the 90 calendar days before, and is_burst_excl_mass."""
    page = W.partitionBy("page_id")
    before = page.orderBy(F.unix_date("day")).rangeBetween(-BASELINE_DAYS, -1)
    dated = daily.withColumn("first_day", F.min("day").over(page))
    days = F.least(F.lit(BASELINE_DAYS), F.datediff("day", "first_day")).cast("double")

    def z(n: Column) -> Column:
        return _z(n.cast("double"), F.coalesce(F.sum(n).over(before), F.lit(0)).cast("double"), F.coalesce(F.sum(n * n).over(before), F.lit(0)).cast("double"), days)

    human = F.col("edits") - F.col("mass_edits")
    out = dated.withColumns({"burst_z": z(F.col("edits")), "_human_z": z(human)})
    flags = {"is_burst": (F.col("edits") >= LEAST_COUNT) & (F.col("burst_z") >= LEAST_Z), "is_burst_excl_mass": (human >= LEAST_COUNT) & (F.col("_human_z") >= LEAST_Z)}
    return out.withColumns(flags).drop("_human_z")


def co_bursts(daily: DataFrame) -> DataFrame:
    """Bursting pages of each day, those with two editors or more, and without mass editors."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    burst, other = F.col("is_burst"), F.col("is_burst_excl_mass")
    return daily.filter(burst | other).groupBy("day").agg(n(burst).alias("pages"), n(burst & (F.col("editors") >= 2)).alias("multi_editor"), n(other).alias("pages_excl_mass"))


def site_totals(daily: DataFrame) -> DataFrame:
    return daily.groupBy("day").agg(F.sum("edits").cast("bigint").alias("edits"))


def features(daily: DataFrame, labels: DataFrame, asked: DataFrame, created: DataFrame | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """The features of each asked (page_id, date), from days before it alone.

    ``daily`` with bursts. Asked rows are added to the activity rows with nothing to count, and so are the days on which the editors
    of a week change; running sums up to a day before a row and their differences do the rest, so no day of activity is joined to any
    question. A page never seen has no age and counts of 0. ``carried``: columns of ``asked`` to pass on; it then has each pair once.
    """
    d = F.unix_date("day")
    count = ["edits", "reverted_edits", "reverts", "bot_edits", "editors"]
    flag, none = F.col("is_burst").cast("int"), F.lit(0).cast("bigint")
    lacking = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in carried]
    nothing = [*[none.alias(c) for c in count], F.lit(0).alias("burst"), F.lit(None).cast("bigint").alias("byte_size_eod")]
    acts = daily.select("page_id", "day", *count, flag.alias("burst"), "byte_size_eod", none.alias("step"), F.lit("day").alias("kind"), *lacking)
    pairs = asked.select("page_id", F.col("date").alias("day"), *carried).dropna(subset=["page_id", "day"])
    asks = (pairs if carried else pairs.distinct()).select("page_id", "day", *nothing, none.alias("step"), F.lit("ask").alias("kind"), *carried)
    steps = editor_steps(labels).select("page_id", "day", *nothing, "step", F.lit("step").alias("kind"), *lacking)
    page = W.partitionBy("page_id")
    until = lambda c, b: F.coalesce(F.sum(c).over(page.orderBy(d).rangeBetween(W.unboundedPreceding, b)), F.lit(0)).cast("bigint")
    over = lambda c, a, b=-1: until(c, b) - until(c, a - 1)
    past = page.orderBy(d).rangeBetween(W.unboundedPreceding, -1)
    last_edit = F.max(F.when(F.col("edits") > 0, d)).over(past)
    first = F.min(F.when(F.col("kind") == "day", F.col("day"))).over(page)
    seen = acts.unionByName(asks).unionByName(steps).withColumn("first_day", first)
    days = F.greatest(F.least(F.lit(BASELINE_DAYS), F.datediff("day", "first_day") - 1), F.lit(0)).cast("double")
    squares = over(F.col("edits") * F.col("edits"), -91, -2).cast("double")
    return seen.select(
        "page_id", F.col("day").alias("date"), "kind", F.datediff("day", "first_day").cast("bigint").alias("page_age_days"),
        F.last("byte_size_eod", ignorenulls=True).over(past).alias("page_bytes"),
        (d - last_edit).cast("bigint").alias("days_since_last_edit"),
        *[over("edits", -k).alias(f"edits_{k}d") for k in (1, 7, 30, 365)],
        over("editors", -1).alias("editors_1d"), over("reverted_edits", -7).alias("reverted_edits_7d"), over("reverts", -7).alias("reverts_7d"), over("bot_edits", -30).alias("bot_edits_30d"),
        F.round(_z(over("edits", -1).cast("double"), over("edits", -91, -2).cast("double"), squares, F.coalesce(days, F.lit(0.0))), 6).alias("burst_z_1d"),
        (over("burst", -1) > 0).alias("is_burst_1d"), over("burst", -30).alias("burst_days_30d"),
        over("edits", -7, -7).alias("edits_lag7"), over("edits", -14, -14).alias("edits_lag14"), over("editors", -7, -7).alias("editors_lag7"),
        (over("burst", -7, -7) > 0).alias("is_burst_lag7"), (over("burst", -14, -14) > 0).alias("is_burst_lag14"),
        *carried, until("step", 0).alias("editors_7d"),
    ).filter("kind = 'ask'").drop("kind")


def editors_in_week(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distinct editors of the seven days before each (page_id, day): the day is spelled out as seven days and joined by equality."""
    users = with_channel(labels).filter((F.col("channel") == "edits") & (F.col("user_text") != "")).select("page_id", "day", "user_text").distinct()
    week = pairs.select("page_id", F.col("day").alias("date"), F.explode(F.sequence(F.date_sub("day", 7), F.date_sub("day", 1))).alias("day"))
    return week.join(users, ["page_id", "day"]).groupBy("page_id", "date").agg(F.count_distinct("user_text").alias("editors_7d"))


def editor_steps(labels: DataFrame) -> DataFrame:
    """Changes of the number of distinct editors of the seven days before a day: page_id, day, step.

    An editor is counted from the day after an edit to the seventh; edits that follow within seven days lengthen the time.
    """
    own = with_channel(labels).filter((F.col("channel") == "edits") & (F.col("user_text") != "") & F.col("day").isNotNull()).select("page_id", "user_text", F.unix_date("day").alias("d"))
    editor = W.partitionBy("page_id", "user_text").orderBy("d")
    near = own.select("page_id", "d", F.lag("d").over(editor).alias("before"), F.lead("d").over(editor).alias("after"))
    starts = F.when(F.col("before").isNull() | (F.col("d") - F.col("before") > 7), F.struct((F.col("d") + 1).alias("d"), F.lit(1).alias("step")))
    ends = F.when(F.col("after").isNull() | (F.col("after") - F.col("d") > 7), F.struct((F.col("d") + 8).alias("d"), F.lit(-1).alias("step")))
    each = near.select("page_id", F.explode(F.array_compact(F.array(starts, ends))).alias("s"))
    return each.groupBy("page_id", F.date_from_unix_date("s.d").alias("day")).agg(F.sum("s.step").alias("step"))


def with_context(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds day_of_week (Monday 0) and the site's edits of the day before; one row a day is joined."""
    before = totals.select(F.date_add("day", 1).alias("date"), F.col("edits").alias("site_edits_1d"))
    return rows.withColumn("day_of_week", F.weekday("date")).join(before, "date", "left").withColumn("site_edits_1d", F.coalesce("site_edits_1d", F.lit(0).cast("bigint")))


def with_co_bursts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds the other pages bursting on the day before: co_burst_1d and co_burst_multi_editor_1d; ``rows`` has is_burst_1d and editors_1d."""
    before = counts.select(F.date_add("day", 1).alias("date"), "pages", "multi_editor")
    own = F.col("is_burst_1d").cast("int")
    multi = (F.col("is_burst_1d") & (F.col("editors_1d") >= 2)).cast("int")
    zero = F.lit(0)
    joined = rows.join(before, "date", "left")
    return joined.withColumns({"co_burst_1d": (F.coalesce("pages", zero) - own).cast("bigint"), "co_burst_multi_editor_1d": (F.coalesce("multi_editor", zero) - multi).cast("bigint")}).drop("pages", "multi_editor")
