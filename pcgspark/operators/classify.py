"""Classification and correction of raw peaks, one recording in one task (decisions depend on all earlier ones)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pcgspark import schema
from pcgspark.functions.shipping import ship
from pcgspark.operators.blocks import spread
from pcgspark.params import DEFAULTS, Params


#: What an analysis can give besides the start rate and the recovery phase.
PARTS = ("peaks", "reasons", "belief")
SLICE = 8192  # peaks, beyond which results leave a worker


def _analysed(batches, p: Params, parts: tuple[str, ...]):
    import numpy as np
    import pandas as pd

    from pcgspark.functions import tracker

    names = ["recording_id", "sample_rate", "status", "peaks", "belief", "start_bpm", "peak_bpm_time_sec", "recovery_end_sec"]
    for pdf in batches:
        rows, held = [], 0
        for r in pdf.itertuples(index=False):
            if held >= SLICE:
                yield pd.DataFrame(rows, columns=names)
                rows, held = [], 0
            idx = np.asarray(r.raw_peaks, int)
            env, floor = np.asarray(r.env, float), np.asarray(r.floor, float)
            held += len(idx) + 1
            hint = None if r.start_bpm_hint is None or r.start_bpm_hint != r.start_bpm_hint else r.start_bpm_hint
            if len(idx) < 2:
                rows.append((r.recording_id, r.sample_rate, r.status, [], [], hint, None, None))
                continue
            peaks = tracker.peaks_of(idx, idx / r.sample_rate, env, floor, p)
            start, recovery, beats, verdicts, history = tracker.analyse(peaks, p, hint, parts=parts)
            final = {b.idx for b in beats}
            out = []
            for x in peaks if "peaks" in parts else ():
                v = verdicts.get(x.idx)
                reasons = [{"tag": tag, "note": note, "steps": [dict(zip(("kind", "by", "of", "against"), step, strict=True)) for step in steps]} for tag, note, steps in v.reasons] if v and "reasons" in parts else []
                out.append({"sample_idx": x.idx, "t_sec": x.t, "amp": x.env, "floor": x.floor, "peak_type": v.kind if v else None, "reasons": reasons, "confidence": v.confidence if v else None, "is_final_beat": x.idx in final})
            belief = [{"step_no": i, "t_sec": t, "bpm": b} for i, (t, b) in enumerate(history)] if "belief" in parts else []
            status = r.status if len(beats) >= 2 or "peaks" not in parts else "too few beats"
            rows.append((r.recording_id, r.sample_rate, status, out, belief, start, *(recovery or (None, None))))
        yield pd.DataFrame(rows, columns=names)


def analyse(prepared: DataFrame, settings: DataFrame | None = None, p: Params = DEFAULTS, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """Two passes, conflicts and corrections for every prepared recording; ``settings`` (recording_id, start_bpm_hint)
    may give hints. Only the peaks are sent to Python, not the samples between them. What is not among ``parts`` is left empty
    and not worked out; without ``peaks`` the status is that of the preparation. Results leave a worker some thousand peaks at
    a time."""
    ship(prepared.sparkSession)
    rows = prepared.join(settings, "recording_id", "left") if settings is not None else prepared.withColumn("start_bpm_hint", F.lit(None).cast("double"))
    at_peaks = lambda c: F.transform("raw_peaks", lambda i: F.get(c, i.cast("int"))).alias(c)
    rows = rows.select("recording_id", "sample_rate", "status", "start_bpm_hint", "raw_peaks", at_peaks("env"), at_peaks("floor"))
    return spread(rows, "recording_id").mapInPandas(lambda it: _analysed(it, p, parts), schema.ANALYSES)


def peaks_of(analyses: DataFrame) -> DataFrame:
    """One row for each raw peak."""
    return analyses.select("recording_id", F.explode("peaks").alias("p")).select("recording_id", "p.*")


def beats_of(analyses: DataFrame) -> DataFrame:
    """The final beats with t_us."""
    return peaks_of(analyses).filter("is_final_beat").select("recording_id", "sample_idx", "t_sec", F.round(F.col("t_sec") * 1e6).cast("bigint").alias("t_us"))


def belief_of(analyses: DataFrame) -> DataFrame:
    return analyses.select("recording_id", F.explode("belief").alias("b")).select("recording_id", "b.*")


def drop_conflicts(beats: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Of two beats too close the stronger stays, as a native fold over a recording's beats (t_us, amp)."""
    part = beats.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("t_us", "amp"))).alias("b"))
    gaps = F.transform(F.sequence(F.lit(1), F.size("b") - 1), lambda i: F.col("b")[i].t_us - F.col("b")[i - 1].t_us)
    median = part.select("recording_id", "b", F.explode_outer(F.when(F.size("b") > 1, gaps)).alias("g")).groupBy("recording_id").agg(F.first("b").alias("b"), F.median("g").alias("m"))
    least = F.col("m") * p.rr_correction_threshold_pct

    def merge(kept, x):
        last = F.element_at(kept, -1)
        replaced = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(x))
        return F.when((F.size(kept) == 0) | (x.t_us - last.t_us >= least), F.concat(kept, F.array(x))).when(x.amp > last.amp, replaced).otherwise(kept)

    empty = F.col("b").cast("array<struct<t_us:bigint,amp:double>>")
    folded = F.when(F.size("b") < 5, empty).otherwise(F.aggregate("b", F.slice(empty, 1, 0), merge))
    return median.select("recording_id", F.explode(folded).alias("k")).select("recording_id", "k.*")
