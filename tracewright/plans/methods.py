"""Methods by id on selections of traces: an ordered list of ids is compiled to the stages that a selection goes through.

Per selection: rebuilding methods come first, each over the whole selection; interpolation of missing samples excludes all other steps; a protected repair of spikes excludes the fill; else the masks of all
detectors are united and filled once, from the selection's other samples. Selections don't overlap, and what lies outside them stays as it is.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fill, masks, ranges, spikes
from ..operators.storage import settled
from . import rounds
from .replace import rebuilt

REBUILDING, INTERPOLATION, PROTECTED = ("reference_spectrum", "reference_level"), "missing_value_interpolation", "protected_spike"
#: What marks samples: functions of (rows of selections as traces of their own, options, name of the mask).
DETECTORS = {
    "threshold": lambda df, o, out: df.withColumn(out, masks.threshold_outliers(F.col("v"), o.get("threshold", 3))),
    "mad": lambda df, o, out: masks.mad_outliers(df, "v", o.get("mad_threshold", 3.0), out),
    "z_score": lambda df, o, out: masks.zscore_outliers(df, "v", o.get("z_threshold", 3.0), out),
    "moving_avg": lambda df, o, out: masks.moving_average_outliers(df, "v", o.get("window_size", 5), o.get("amplitude_threshold", 3.0), out),
}
#: The value that stands for a missing sample.
SENTINEL = -1.0


class Stages(NamedTuple):
    """What a list of methods comes to, for every selection."""

    rebuild: list[tuple[str, dict]]
    interpolate: dict | None
    protect: dict | None
    detect: list[tuple[str, dict]]


def compiled(methods: Sequence[tuple[str, dict]]) -> Stages:
    """The stages of an ordered list of (id, options); an id that isn't known is an error."""
    for name, _ in methods:
        if name not in (*REBUILDING, INTERPOLATION, PROTECTED, *DETECTORS):
            raise ValueError(f"no such method: {name}")
    first = lambda wanted: next((o for name, o in methods if name == wanted), None)
    rebuild = [m for m in methods if m[0] in REBUILDING]
    interpolate = first(INTERPOLATION)
    if interpolate is not None:
        return Stages(rebuild, interpolate, None, [])
    protect = first(PROTECTED)
    return Stages(rebuild, None, protect, [] if protect is not None else [m for m in methods if m[0] in DETECTORS])


def _rebuilt(df: DataFrame, selections: DataFrame, method: str, options: dict, sr: float) -> DataFrame:
    """Selections rebuilt from left to right, each seeing what those before it became."""
    gap_s = options.get("reference_gap_sec", 0.5)
    rows = settled(df.withColumn("bad", F.col("v") == SENTINEL), "to-rebuild")
    kernel = lambda contexts: rebuilt(contexts.withColumn("method", F.lit("core")), sr, round(gap_s * sr), options.get("random_seed", 0))
    values, _ = rounds.in_rounds(rows, selections.withColumn("round", F.lit(0)), selections.limit(0), rounds.at_reference_level if method == "reference_level" else kernel, sr, gap_s)
    w = F.rint("w") if options.get("quantize_to_int", True) else F.col("w")
    changed = F.col("w") != F.col("v")
    return settled(rounds.applied(rows, values).select("trace_id", "idx", F.when(changed, w).otherwise(F.col("v")).alias("v")), "rebuilt")


def applied(samples: DataFrame, selections: DataFrame, methods: Sequence[tuple[str, dict]], sr: float) -> DataFrame:
    """Samples (trace_id, idx, v) with the methods applied to selections (trace_id, s, e)."""
    stages = compiled(methods)
    df, selections = settled(samples.select("trace_id", "idx", F.col("v").cast("double").alias("v")), "samples"), settled(selections.select("trace_id", "s", "e"), "selections")
    for method, options in stages.rebuild:
        df = _rebuilt(df, selections, method, options, sr)
    if stages.interpolate is not None:
        inside = ranges.samples_in(df.select("trace_id", "idx"), selections, "left_semi").withColumn("_in", F.lit(True))
        rows = settled(df.withColumn("_gone", F.col("v") == SENTINEL).join(inside, ["trace_id", "idx"], "left"), "interpolate")
        lined = fill.clamped_fill(rows, "_gone", "v", "_w")
        return lined.select("trace_id", "idx", F.when(F.col("_gone") & F.col("_in"), F.col("_w")).otherwise(F.col("v")).alias("v"))
    own = ranges.samples_in(df, selections).select(F.struct("trace_id", "s").alias("trace_id"), (F.col("idx") - F.col("s")).alias("idx"), "v")
    if stages.protect is not None:
        new = spikes.replaced(settled(own, "own"), "v", "_w", sr, **stages.protect).select("trace_id", "idx", "_w")
    elif stages.detect:
        marked = settled(own, "own")
        for k, (name, options) in enumerate(stages.detect):
            marked = settled(DETECTORS[name](marked, options, f"m{k}"), "marked")
        union = F.lit(False)
        for k in range(len(stages.detect)):
            union |= F.coalesce(F.col(f"m{k}"), F.lit(False))
        rows = marked.select(F.col("trace_id.trace_id").alias("trace_id"), F.col("trace_id.s").alias("seg_id"), "idx", "v", union.alias("_off"))
        new = fill.segment_fill(settled(rows, "united"), "_off", "v", "_w").where("_off").select(F.struct("trace_id", F.col("seg_id").alias("s")).alias("trace_id"), "idx", "_w")
    else:
        return df
    back = new.select(F.col("trace_id.trace_id").alias("trace_id"), (F.col("trace_id.s") + F.col("idx")).alias("idx"), "_w")
    return df.join(back, ["trace_id", "idx"], "left").select("trace_id", "idx", F.coalesce("_w", "v").alias("v"))
