"""Detection to verified repair of whole traces, as stages on samples and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Detection, Repair
from ..operators import fill, masks, ranges, runs, segments
from ..operators.storage import settled
from .replace import replaced, written_back

#: Repair steps by id, each a function of (samples, options) that adds the mask `bad`; what they mark is put on a line.
DETECTORS = {
    "threshold": lambda df, o: df.withColumn("bad", masks.threshold_outliers(F.col("v"), o.get("limit", 1020))),
    "mad": lambda df, o: masks.mad_outliers(df, "v", o.get("k", 5.0), "bad"),
    "z_score": lambda df, o: masks.zscore_outliers(df, "v", o.get("k", 4.0), "bad"),
    "moving_average": lambda df, o: masks.moving_average_outliers(df, "v", o.get("width", 25), o.get("limit", 300.0), "bad"),
    "spike": lambda df, o: masks.spike(df, o.get("config", Detection()), "v", "bad"),
}


def cleaned(samples: DataFrame, methods: list[tuple[str, dict]]) -> DataFrame:
    """Samples (trace_id, idx, v) through detectors in order; each one's marks are filled before the next looks."""
    for name, options in methods:
        marked = settled(DETECTORS[name](settled(samples.select("trace_id", "idx", "v"), "step"), options), "marked")
        samples = fill.clamped_fill(marked, "bad", "v", "w").select("trace_id", "idx", F.col("w").alias("v"))
    return samples


def repaired(samples: DataFrame, detection: Detection | None = None, repair: Repair | None = None, protected: DataFrame | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Samples (trace_id, idx, v) with w and whether they were taken for a spike, and a catalog of what was done (trace_id, s, e, role, method).

    Runs of missing samples are graded by length: short ones lie on a line, middle ones, of which no sample is known, at the level of their surroundings,
    long ones are rebuilt from both sides; runs longer than the longest repair are gaps and stay. Spikes are put on a line.
    Protected segments (trace_id, s, e) are written back as they were. What is repaired looks at the samples as given.
    """
    detection, repair = detection or Detection(), repair or Repair()
    df = settled(samples.select("trace_id", "idx", "v").withColumn("bad", masks.missing_counts(F.col("v"))), "raw")
    found = settled(runs.runs(df, "bad").withColumn("method", segments.graded_run(repair)), "runs")
    if protected is not None:
        found = ranges.overlapping(found, protected, "left_anti")
    gaps = found.where(runs.length() > detection.samples(detection.longest_s))
    work = found.where(runs.length() <= detection.samples(detection.longest_s))
    values, report = replaced(df, work.where("method = 'core'").select("trace_id", "s", "e", "method"), detection.sr, repair.reference_gap_s, seed)
    core = settled(written_back(df, settled(values, "core")), "rebuilt")
    small = ranges.samples_in(df.select("trace_id", "idx"), work.where("method = 'linear'")).select("trace_id", "idx", F.lit(True).alias("_small"))
    levels = fill.background(df, work.where("method = 'zscore'"), "bad", "v", detection.sr, repair.zscore_context_s)
    level = ranges.samples_in(df.select("trace_id", "idx"), levels).select("trace_id", "idx", "level")
    marked = core.join(small, ["trace_id", "idx"], "left").join(level, ["trace_id", "idx"], "left")
    marked = marked.select("trace_id", "idx", "v", "bad", F.coalesce("level", "w").alias("x"), F.coalesce("_small", F.lit(False)).alias("_fill"))
    lined = settled(fill.clamped_fill(settled(marked, "marked"), "_fill", "x", "y"), "lined")
    spiky = masks.spike(lined.select("trace_id", "idx", F.col("y").alias("x")), detection, "x", "_spike").select("trace_id", "idx", "_spike")
    both = settled(lined.join(spiky, ["trace_id", "idx"]), "spikes")
    done = fill.clamped_fill(both, "_spike", "y", "z")
    keep = F.lit(False)
    if protected is not None:
        inside = ranges.samples_in(df.select("trace_id", "idx"), protected.select("trace_id", "s", "e")).select("trace_id", "idx", F.lit(True).alias("_keep")).distinct()
        done = done.join(inside, ["trace_id", "idx"], "left")
        keep = F.coalesce("_keep", F.lit(False))
    in_gap = ranges.samples_in(df.select("trace_id", "idx"), gaps).select("trace_id", "idx", F.lit(True).alias("_gap"))
    done = done.join(in_gap, ["trace_id", "idx"], "left")
    value = F.when(keep | F.coalesce("_gap", F.lit(False)), F.col("v")).otherwise(F.greatest(F.lit(1.0), F.rint("z")) if repair.quantize else F.col("z"))
    out = done.select("trace_id", "idx", "v", value.alias("w"), (F.col("_spike") & ~keep).alias("spike"))
    rows = work.select("trace_id", "s", "e", F.lit("repair").alias("role"), "method").unionByName(gaps.select("trace_id", "s", "e", F.lit("gap").alias("role"), F.lit("keep").alias("method")))
    if protected is not None:
        rows = rows.unionByName(protected.select("trace_id", "s", "e", F.lit("event").alias("role"), F.lit("catalog_protect").alias("method")))
    return out, rows
