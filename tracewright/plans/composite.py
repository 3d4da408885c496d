"""The whole repair by kinds: what detection finds is verified, joined, bounded and graded, then repaired in rounds, and events and gaps stay as given."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Detection, Repair
from ..functions.edges import Chunk
from ..operators import anomalies, fill, masks, ranges, restore, runs, segments
from ..operators.storage import settled
from . import rounds
from .replace import core

KEY = ["trace_id", "s", "e"]
CATALOG = ["trace_id", "s", "e", "role", "kind", "method"]
#: Rounds of the rebuilding: missing runs of segments, whole segments, what those that were given up leave, stretches of good samples that stand out.
RUNS, WHOLE, REST, STRETCHES = 3, 4, 5, 6


def _marks(df: DataFrame, segs: DataFrame, name: str) -> DataFrame:
    """df with a flag for the samples that segments hold."""
    inside = ranges.samples_in(df.select("trace_id", "idx"), segs.select(*KEY)).select("trace_id", "idx", F.lit(True).alias(name)).distinct()
    return df.join(inside, ["trace_id", "idx"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def _runs_in(df: DataFrame, flag: Column, segs: DataFrame) -> DataFrame:
    """trace_id, s, e of the runs of a flag in each of the segments, cut at its ends, with the segment's seg_s."""
    inside = ranges.samples_in(df.where(flag).select("trace_id", "idx"), segs.select("trace_id", F.col("s").alias("seg_s"), F.col("e").alias("seg_e")), s="seg_s", e="seg_e")
    own = inside.select(F.struct("trace_id", "seg_s").alias("trace_id"), "idx", F.lit(True).alias("_f"))
    return runs.runs(own, "_f").select("trace_id.*", "s", "e")


def found_segments(samples: DataFrame, detection: Detection, events: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Masked samples, and segments (trace_id, s, e, role, kind) of samples (trace_id, idx, v, and ts if there are events).

    With a catalog of events (event_ts) only what it has is an event; detected ones that it hasn't are to be repaired, and spikes within its windows are spikes.
    """
    masked, found = segments.detected(samples, detection)
    found = settled(found, "found")
    if events is not None:
        at = samples.select("trace_id", "idx", "ts")
        timed = found.join(at.withColumnsRenamed({"idx": "s", "ts": "s_ts"}), ["trace_id", "s"]).join(at.withColumnsRenamed({"idx": "e", "ts": "e_ts"}), ["trace_id", "e"])
        judged = segments.verified(settled(timed, "timed"), events, detection)
        kind = F.when(F.col("verdict") == "burst", "burst").when(F.col("verdict") == "spike", "spike").when(F.col("verdict") == "event", "event").otherwise(F.col("kind"))
        role = F.when(F.col("verdict").isin("burst", "spike"), "repair").otherwise(F.col("verdict"))
        found = settled(judged.select(*KEY, role.alias("role"), kind.alias("kind")), "verified")
    return masked, found


def planned(samples: DataFrame, detection: Detection, repair: Repair, events: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Samples (trace_id, idx, v, bad, spike), walls (events and gaps), segments with kind and method, and tasks (trace_id, s, e, method, seg_s).

    Segments whose references would overlap are one, of the first one's kind; all are widened to where the trace is back at its level. Of frozen and of sparsely missing segments only the missing
    runs are repaired, by length, and of the latter also stretches of good samples that stand out; others are repaired whole.
    """
    masked, found = found_segments(samples, detection, events)
    df = settled(masked.select("trace_id", "idx", F.col("v").cast("double").alias("v"), F.col("missing").alias("bad"), "spike"), "samples")
    walls = settled(found.where("role IN ('event', 'gap')").select("trace_id", "s", "e", "role", "kind"), "walls")
    todo = settled(runs.merged_overlapping(found.where("role = 'repair'").select("trace_id", "s", "e", "kind")), "todo")
    joined = settled(runs.merged_by_reference(todo, detection.sr, repair.reference_min_s, repair.reference_max_s, repair.reference_share, repair.merged_max_s), "joined")
    firsts = ranges.samples_in(todo.select("trace_id", F.col("s").alias("idx"), "kind"), joined).groupBy(*KEY).agg(F.min_by("kind", "idx").alias("kind"))
    wide = settled(restore.refined(settled(firsts, "kinds"), df, "v", "bad", walls, detection.sr), "refined")
    rows = segments.longest_run(segments.shares(df.withColumnRenamed("bad", "missing"), wide, ("missing",)), runs.runs(df, "bad"))
    graded = settled(rows.withColumn("method", segments.graded(repair)), "graded")
    within = graded.where("method IN ('freeze_missing', 'missing_runs')")
    single = _runs_in(df, F.col("bad"), within).withColumn("method", segments.graded_run(repair))
    out_there = anomalies.anomaly_runs(df, graded.where("method = 'missing_runs'"), detection.sr)
    stretches = out_there.select("trace_id", F.col("seg_s"), "s", "e", F.concat(F.lit("stretch_"), segments.graded_run(repair)).alias("method"))
    whole = graded.where("method NOT IN ('freeze_missing', 'missing_runs')").select("trace_id", F.col("s").alias("seg_s"), "s", "e", F.when(F.col("method") == "core", "whole").otherwise(F.col("method")).alias("method"))
    tasks = single.select(*KEY, "method", "seg_s").unionByName(whole.select(*KEY, "method", "seg_s")).unionByName(stretches.select(*KEY, "method", "seg_s"))
    return df, walls, graded.select(*KEY, "kind", "method", "missing_share"), settled(tasks, "tasks")


def _finish(detection: Detection) -> rounds.Finish:
    """What is rebuilt stays if the guard lets it; then it is put on the line of its surroundings, and fades at its edges."""

    sr = detection.sr

    def finish(s: int, e: int, w: np.ndarray, near: Chunk) -> tuple[np.ndarray | None, str]:
        verdict, around = near.guard(s, e, w, int(300.0 * sr))
        if verdict != "kept":
            return None, verdict
        lined = near.realigned(s, e, w, around, int(45.0 * sr), int((35.0 if e - s + 1 > int(60.0 * sr) else 10.0) * sr))
        lined = np.where(np.isnan(lined), near.v[near.cut(s, e)], lined)
        return near.crossfaded(s, e, lined, int(10.0 * sr), int(30.0 * sr)), verdict

    return finish


def _rebuilt_in_rounds(df: DataFrame, tasks: DataFrame, events: DataFrame, detection: Detection, repair: Repair, rebuild: rounds.Rebuild) -> tuple[DataFrame, DataFrame | None]:
    """df (trace_id, idx, v, bad, first, first_bad) with what the tasks (with a round) make of it, and the verdicts."""
    values, verdicts = rounds.in_rounds(df, tasks, events, rebuild, detection.sr, repair.reference_gap_s, repair.reference_max_s, _finish(detection))
    after = rounds.applied(df, values)
    made = values.select("trace_id", "idx").distinct().withColumn("_made", F.lit(True))
    after = after.join(made, ["trace_id", "idx"], "left").withColumn("bad", F.col("bad") & F.col("_made").isNull())
    return settled(after.select("trace_id", "idx", F.col("w").alias("v"), "bad", "first", "first_bad", "spike"), "rounds"), verdicts


def light_rounds(df: DataFrame, tasks: DataFrame, kinds: DataFrame, walls: DataFrame, detection: Detection, repair: Repair) -> DataFrame:
    """The first rounds: single spikes and short missing runs on a line, spikes of spike segments, then middle runs at the level of their surroundings. df gets `v` and `bad` anew."""
    spiky = settled(kinds.where("method = 'spike'").select(*KEY), "spiky")
    marked = _marks(_marks(_marks(df, spiky, "_in_spiky"), walls, "_wall"), settled(tasks.where("method IN ('linear', 'spike')").select(*KEY), "linear"), "_short")
    line = (F.col("spike") & ~F.col("_in_spiky") & ~F.col("_wall")) | (F.col("bad") & F.col("_short"))
    marked = settled(marked.withColumns({"_on": line, "_off": line | F.col("bad")}), "marked")
    lined = fill.clamped_fill(marked, "_off", "v", "_y").withColumns({"v": F.when(F.col("_on"), F.col("_y")).otherwise(F.col("v")), "bad": F.col("bad") & ~(F.col("_on") & F.col("_y").isNotNull())})
    lined = settled(lined.drop("_y", "_on", "_off", "_short", "_wall"), "lined")
    if not spiky.isEmpty():
        calm = fill.spike_fill(lined.where("NOT bad").select("trace_id", "idx", "v"), "v", "_s", repair.spike_window, repair.spike_k).select("trace_id", "idx", "_s")
        lined = lined.join(calm, ["trace_id", "idx"], "left").withColumn("v", F.when(F.col("_in_spiky"), F.coalesce("_s", "v")).otherwise(F.col("v"))).drop("_s")
    lined = settled(lined.drop("_in_spiky"), "round-1")
    middle = settled(tasks.where("method = 'zscore'").select(*KEY), "middle")
    filled = _marks(fill.zscore_fill(lined, middle, "bad", "v", "_z", detection.sr, repair.zscore_context_s, repair.zscore), middle, "_m")
    return settled(filled.withColumns({"v": F.when(F.col("_m"), F.col("_z")).otherwise(F.col("v")), "bad": F.col("bad") & ~F.col("_m")}).drop("_z", "_m"), "round-2")


def composite(samples: DataFrame, detection: Detection | None = None, repair: Repair | None = None, seed: int = 42, events: DataFrame | None = None, rebuild: rounds.Rebuild | None = None) -> tuple[DataFrame, DataFrame]:
    """Samples (trace_id, idx, v) with w, how, and a catalog (trace_id, s, e, role, kind, method).

    Spikes and short missing runs go first, then middle ones, then long ones and whole segments from left to right, each seeing what those before it became, while later segments and
    events stand at their level in its references. What is rebuilt is given up where the guard says so ('energy', 'alive'); what is missing in a segment that was given up is then repaired by length. Stretches
    that stand out come last. Events keep their samples but for spikes and missing runs of up to 20; gaps keep all. Whatever still isn't above 0 lies on a line, 1 at least. how says what changed
    a sample: 'repair', 'event', or 'floor' (that line).
    rebuild: what makes values from references (the spectral kernel, if not given).
    """
    detection, repair = detection or Detection(), repair or Repair()
    df, walls, kinds, tasks = planned(samples, detection, repair, events)
    calm = settled(walls.where("role = 'event'").select(*KEY), "events")
    gap = round(repair.reference_gap_s * detection.sr)
    rebuild = rebuild or functools.partial(core, sr=detection.sr, gap=gap, seed=seed)

    light = light_rounds(df, tasks, kinds, walls, detection, repair)
    first = df.select("trace_id", "idx", F.col("v").alias("first"), F.col("bad").alias("first_bad"))
    state = settled(light.join(first, ["trace_id", "idx"]), "light")
    number = F.when(F.col("method") == "core", RUNS).otherwise(WHOLE)
    heavy = tasks.where("method IN ('core', 'whole')").select(*KEY, "method", number.alias("round"))
    state, verdicts = _rebuilt_in_rounds(state, heavy, calm, detection, repair, rebuild)

    given_up = verdicts.where("verdict <> 'kept' AND method = 'whole'").select(*KEY) if verdicts is not None else heavy.select(*KEY).limit(0)
    rest = settled(_runs_in(state, F.col("bad"), settled(given_up, "given-up")).withColumn("method", segments.graded_run(repair)).select(*KEY, "method"), "rest")
    small = tasks.where("method IN ('stretch_linear', 'stretch_zscore')").select(*KEY, F.lit("zscore").alias("method"))
    state = light_rounds(state.withColumn("spike", F.lit(False)), rest.unionByName(small), kinds.limit(0), walls.limit(0), detection, repair)
    late = rest.where("method = 'core'").select(*KEY, "method", F.lit(REST).alias("round")).unionByName(tasks.where("method = 'stretch_core'").select(*KEY, "method", F.lit(STRETCHES).alias("round")))
    state, _ = _rebuilt_in_rounds(state, late, calm, detection, repair, rebuild)

    out = _marks(_marks(state, calm, "_event"), settled(walls.where("role = 'gap'").select(*KEY), "gaps"), "_gap")
    out = settled(out.select("trace_id", "idx", "first", "first_bad", "v", "_event", "_gap"), "repaired")
    # within events: what was given, but for single spikes and missing runs of up to 20
    short = _runs_in(df, F.col("bad"), calm).where(runs.length() <= repair.zscore_max)
    inside = _marks(masks.spike(df.select("trace_id", "idx", F.when(~F.col("bad"), F.col("v")).alias("x")), detection, "x", "_sp").select("trace_id", "idx", F.coalesce("_sp", F.lit(False)).alias("_sp")), settled(short, "short"), "_sh")
    out = out.join(inside, ["trace_id", "idx"])
    on = F.col("_event") & ~F.col("_gap") & ((F.col("_sp") & ~F.col("first_bad")) | (F.col("first_bad") & F.col("_sh")))
    out = settled(out.withColumns({"_on": on, "_off": on | (F.col("first_bad") & F.col("_event")), "x": F.when(F.col("_event") | F.col("_gap"), F.col("first")).otherwise(F.col("v"))}), "events-back")
    lined = settled(fill.clamped_fill(out, "_off", "x", "_y").withColumn("y", F.when(F.col("_on"), F.col("_y")).otherwise(F.col("x"))).withColumn("_keep", F.col("_gap") | (F.col("_event") & ~F.col("_on"))), "events-done")
    done = fill.floored(lined, "y", "z", "_keep") if repair.quantize else lined.withColumn("z", F.col("y"))
    w = F.when(F.col("_keep"), F.col("first")).otherwise(F.col("z"))
    how = F.when(F.col("_keep") | w.eqNullSafe(F.col("first")), None).when(F.col("_on"), "event").when(F.col("y").isNull() | (F.col("y") <= 0), "floor").when(F.col("v").eqNullSafe(F.col("first")), "floor").otherwise("repair")
    result = settled(done.select("trace_id", "idx", F.col("first").alias("v"), w.alias("w"), how.alias("how")), "composite")

    judged = kinds.join(verdicts.where("method = 'whole'").select(*KEY, "verdict"), KEY, "left") if verdicts is not None else kinds.withColumn("verdict", F.lit(None).cast("string"))
    method = F.when(F.col("verdict").isin("energy", "alive"), F.concat(F.lit("given_up_"), F.col("verdict"))).otherwise(F.col("method"))
    catalog = judged.select(*KEY, F.lit("repair").alias("role"), "kind", method.alias("method"))
    return result, catalog.unionByName(walls.withColumn("method", F.when(F.col("role") == "event", "protect").otherwise("keep")).select(CATALOG))
