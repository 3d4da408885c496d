"""Segments from masks: their kind, the event test, verification against a catalog, and grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Detection, Repair
from . import ranges, rolling, runs

#: Kinds in the order that settles ties.
KINDS = ("sat", "missing", "freeze", "spike", "step")


def shares(samples: DataFrame, segments: DataFrame, flags: tuple[str, ...]) -> DataFrame:
    """Segments with the share of their samples that each flag holds for."""
    pairs = ranges.samples_in(samples.select("trace_id", "idx", *flags), segments)
    keys = segments.columns
    return pairs.groupBy(*keys).agg(*(F.avg(F.col(f).cast("double")).alias(f"{f}_share") for f in flags))


def primary_kind(samples: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments with the kind that most samples have, the first of equals; 'burst' where none has over 1 %."""
    rows = shares(samples, segments, KINDS)
    best = F.greatest(*(F.col(f"{k}_share") for k in KINDS))
    kind = F.lit("burst")
    for k in reversed(KINDS):
        kind = F.when(F.col(f"{k}_share") == best, F.lit("zero" if k == "missing" else k)).otherwise(kind)
    return rows.withColumn("kind", F.when(best > 0.01, kind).otherwise("burst")).withColumn("missing_share", F.col("missing_share")).select(*segments.columns, "kind", "missing_share")


def event_test(samples: DataFrame, segments: DataFrame, config: Detection) -> DataFrame:
    """Segments with is_event: long, clean, and with a strong head that decays smoothly."""
    w = config.samples(config.rms_short_s)
    pairs = ranges.samples_in(samples.select("trace_id", "idx", "x", "missing", "morph", "spike"), segments).withColumn("n", F.col("e") - F.col("s") + 1).withColumn("pos", F.col("idx") - F.col("s"))
    head, middle, tail = F.greatest(F.lit(3), F.floor(F.col("n") * 0.1)), F.greatest(F.lit(3), F.floor(F.col("n") * 0.3)), F.greatest(F.lit(2), F.floor(F.col("n") * 0.1))
    power = F.col("x") * F.col("x")
    rms = lambda where: F.sqrt(F.coalesce(F.avg(F.when(where, power)), F.lit(0.0)) + 1e-12)
    keys = segments.columns
    stats = pairs.groupBy(*keys, "n").agg(
        F.avg(F.col("missing").cast("double")).alias("m"), F.avg(F.col("morph").cast("double")).alias("f"), F.avg(F.col("spike").cast("double")).alias("j"),
        rms(F.col("pos") < head).alias("head"), rms((F.col("pos") >= head) & (F.col("pos") < head + middle)).alias("mid"), rms(F.col("pos") >= F.col("n") - tail).alias("tail"),
    )
    # the envelope within the segment: each segment is a trace of its own
    own = pairs.select(F.struct("trace_id", "s").alias("trace_id"), F.col("pos").alias("idx"), "x")
    envelope = rolling.rolling_rms(own, "x", w, "r")
    envelope = rolling.per_trace(envelope, _top=F.max("r")).withColumn("r", F.col("r") / (F.col("_top") + 1e-12))
    smooth = rolling.shifted(envelope, {"_p": ("r", -1)}).groupBy("trace_id").agg(rolling.median(F.abs(F.col("r") - F.col("_p"))).alias("smooth"))
    rows = stats.join(smooth.select(F.col("trace_id.trace_id").alias("trace_id"), F.col("trace_id.s").alias("s"), "smooth"), ["trace_id", "s"])
    ok = (F.col("n") >= config.samples(config.event_s)) & (F.col("m") <= config.event_missing) & (F.col("f") <= config.event_morph) & (F.col("j") <= config.event_spike)
    ok &= (F.col("head") >= config.event_head_mid * F.col("mid")) & ((F.col("head") <= 1e-6) | (F.col("tail") >= F.col("head") / config.event_coda)) & (F.col("smooth") <= config.event_smooth)
    return rows.select(*keys, ok.alias("is_event"))


def verified(segments: DataFrame, catalog: DataFrame, config: Detection) -> DataFrame:
    """Segments (with s_ts, e_ts, role, kind) judged by a catalog of event times: adds verdict.

    A segment hits if it meets the time from before to after an event. Hits of kind spike or missing are 'spike', other
    hits are 'event'; a detected event without a hit is to be repaired as a burst; others keep their role.
    """
    windows = catalog.select((F.col("event_ts") - F.expr(f"INTERVAL {config.catalog_before_s:.0f} SECONDS")).alias("w0"), (F.col("event_ts") + F.expr(f"INTERVAL {config.catalog_after_s:.0f} SECONDS")).alias("w1"))
    # buckets of time make this an equi-join; the reach of a window bounds its number of buckets
    size = 3600
    span = lambda a, b: F.explode(F.sequence(F.floor(F.unix_seconds(F.col(a).cast("timestamp")) / size), F.floor(F.unix_seconds(F.col(b).cast("timestamp")) / size)))
    w = windows.withColumn("b", span("w0", "w1"))
    held = segments.withColumn("b", span("s_ts", "e_ts")).alias("l").join(w.alias("r"), (F.col("l.b") == F.col("r.b")) & (F.col("s_ts") <= F.col("w1")) & (F.col("e_ts") >= F.col("w0")), "left_semi")
    hits = held.select("trace_id", "s", "e").distinct().withColumn("hit", F.lit(True))
    rows = segments.join(hits, ["trace_id", "s", "e"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    verdict = F.when(F.col("hit") & F.col("kind").isin("spike", "missing"), "spike").when(F.col("hit"), "event").when(F.col("role") == "event", "burst").otherwise(F.col("role"))
    return rows.withColumn("verdict", verdict)


def longest_run(segments: DataFrame, within: DataFrame, config: Repair | None = None) -> DataFrame:
    """Segments with the longest part that a run of `within` has in them, 0 if none; and how many parts there are for each repair by length (n_linear, n_zscore, n_core)."""
    spread = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / ranges.BUCKET), F.floor(F.col(b) / ranges.BUCKET)))
    r = within.select(F.col("trace_id").alias("_k"), F.col("s").alias("_s"), F.col("e").alias("_e"), spread("s", "e").alias("_rb"))
    left = segments.withColumn("_b", spread("s", "e"))
    rows = left.join(r, (F.col("trace_id") == F.col("_k")) & (F.col("_b") == F.col("_rb")) & (F.col("s") <= F.col("_e")) & (F.col("e") >= F.col("_s")), "left")
    size = F.when(F.col("_s").isNotNull(), F.least("e", "_e") - F.greatest("s", "_s") + 1)
    # a part over the edge of buckets is met in each of them, and counts in the first
    first = F.col("_b") == F.floor(F.greatest("s", "_s") / ranges.BUCKET)
    kind = graded_run(config or Repair(), size)
    counts = [F.count_if(F.coalesce(first & (kind == k), F.lit(False))).alias(f"n_{k}") for k in ("linear", "zscore", "core")]
    return rows.groupBy(*segments.columns).agg(F.coalesce(F.max(size), F.lit(0)).cast("long").alias("max_run"), *counts)


def note(method: Column) -> Column:
    """What a catalog says about a repaired segment with missing_share, max_run and the counts of its missing runs."""
    share = F.format_string("miss_frac=%.3f", "missing_share")
    by_length = F.concat(share, F.format_string(" lin=%d z=%d core=%d", "n_linear", "n_zscore", "n_core"))
    return F.when(method.isin("freeze_missing", "missing_runs"), by_length).when(method.isin("linear", "zscore"), F.format_string("max_run=%d", "max_run")).when(method.isin("core", "spike"), share).otherwise("")


def graded_run(config: Repair, n: Column | None = None) -> Column:
    """The repair of a run of missing samples by its length."""
    n = runs.length() if n is None else n
    return F.when(n <= config.linear_max, "linear").when(n <= config.zscore_max, "zscore").otherwise("core")


def graded(config: Repair) -> Column:
    """The repair of a segment by kind, missing_share and max_run."""
    sparse = F.when(F.col("missing_share") <= config.core_missing_share, "missing_runs").otherwise(graded_run(config, F.col("max_run")))
    return F.when(F.col("kind") == "freeze", "freeze_missing").when((F.col("kind") == "zero") | (F.col("missing_share") > config.missing_share), sparse).when(F.col("kind") == "spike", "spike").otherwise("core")


def detected(samples: DataFrame, config: Detection) -> tuple[DataFrame, DataFrame]:
    """Masked samples, and segments (trace_id, s, e, role, kind): all of detection for raw samples (trace_id, idx, v)."""
    from .masks import all_masks

    masked = all_masks(samples, config)
    morph = runs.runs(masked, "morph")
    bursts = runs.runs(masked.withColumn("_burst", F.col("energy") & ~F.col("morph")), "_burst").where(runs.length() >= config.samples(config.burst_s))
    tested = event_test(masked, bursts, config)
    joined = runs.merged(morph.unionByName(tested.where("NOT is_event").drop("is_event")), config.samples(config.merge_s))
    split = runs.split_long(primary_kind(masked, joined), config.samples(config.longest_s))
    kinds = split.where("role = 'repair'")
    longest = config.samples(config.longest_s)
    whole = kinds.where(runs.length() < longest)
    n = rolling.lengths(samples)
    wide = runs.padded(whole, n, config.sr, 10.0, config.samples(config.pad_short_s), config.samples(config.pad_long_s))
    events = tested.where("is_event").select("trace_id", "s", "e", F.lit("event").alias("role"), F.lit("event").alias("kind"))
    columns = ["trace_id", "s", "e", "role", "kind"]
    gaps = split.where("role = 'gap'")
    return masked, wide.select(columns).unionByName(kinds.where(runs.length() >= longest).select(columns)).unionByName(gaps.select(columns)).unionByName(events)
