"""Beat tracking of live peak streams: the batch tracker's step as a stateful processor with typed state.

A decision needs the next peak, so verdicts lag by one peak. Quantities of a whole recording (median intervals, the
preliminary pass) are not known to a stream: the starting rate is a parameter, and the correction passes are left to
the batch analysis. Peaks of a recording must arrive in order of time; those of one trigger are sorted, earlier ones are
dropped as late. What a recording is left with between triggers are the columns of ``STATE``, which Spark's state data source
reads (``stateVarName`` ``tracker``), so that a running query can be looked into; a query that is started again from its
checkpoint goes on in the middle of a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pcgspark.functions.shipping import ship
from pcgspark.functions.tracker import TINY, Peak, Tracker
from pcgspark.params import DEFAULTS, Params

VERDICTS = "recording_id string, sample_idx bigint, t_sec double, peak_type string, confidence double, belief_bpm double"
STATE = (
    "bpm double, beats bigint, rejections bigint, just_beaten boolean, paired array<boolean>, lone array<bigint>, before_t double, skip boolean, dev double, "
    + ", ".join(", ".join(f"{name}_{c} {'bigint' if c == 'idx' else 'double'}" for c in ("idx", "t", "env", "floor", "dev")) for name in ("last", "pending"))
)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NO_PEAK = (None,) * 5


@dataclass
class Live:
    """A recording's tracker, the peak that waits for the next one, and whether that is the second of a pair."""

    params: Params = DEFAULTS
    start_bpm: float = 80.0
    tracker: Tracker = field(init=False)
    pending: Peak | None = None
    dev: float = float("nan")
    skip: bool = False

    def __post_init__(self) -> None:
        self.tracker = Tracker(self.params, self.start_bpm)

    def _decide(self, following: Peak | None) -> list[tuple]:
        if self.skip:
            self.skip = False
            return []
        times = {x.idx: x.t for x in (self.pending, following) if x is not None}
        made = self.tracker.step(self.pending, following)
        self.skip = len(made) == 2
        return [(v.idx, times[v.idx], v.kind, v.confidence, self.tracker.bpm) for v in made]

    def push(self, idx: int, t: float, env: float, floor: float) -> list[tuple]:
        """The next peak; returns verdicts (sample_idx, t_sec, peak_type, confidence, belief_bpm). A late one is dropped."""
        if self.pending is None:
            self.pending = Peak(idx, t, env, floor, self.dev)
            return []
        if t <= self.pending.t:
            return []
        new = Peak(idx, t, env, floor, self.dev)
        a, b = self.pending.strength, new.strength
        self.dev = new.dev = abs(b - a) / (max(a, b) + TINY)
        made = self._decide(new)
        self.pending = new
        return made

    def finish(self) -> list[tuple]:
        """The pending peak is the last."""
        return [] if self.pending is None else self._decide(None)

    # -- as columns -----------------------------------------------------------------------------------------------
    def state(self) -> tuple:
        t = self.tracker
        peak = lambda x: _NO_PEAK if x is None else astuple(x)
        return (t.bpm, t.beats, t.rejections, t.just_beaten, [bool(x) for x in t.paired], [int(x) for x in t.lone], None if t.before is None else t.before.t, self.skip, self.dev, *peak(t.last), *peak(self.pending))

    @classmethod
    def of(cls, state: tuple, params: Params) -> Live:
        bpm, beats, rejections, just_beaten, paired, lone, before_t, skip, dev, *peaks = state
        out = cls(params, bpm)
        last, out.pending = (None if x[0] is None else Peak(*x) for x in (peaks[:5], peaks[5:]))
        t = out.tracker
        t.beats, t.rejections, t.just_beaten, t.last = beats, rejections, just_beaten, last
        t.before = None if before_t is None else Peak(-1, before_t, 0.0, 0.0, 0.0)  # only its time counts
        t.paired.extend(paired)
        t.lone.extend(lone)
        out.skip, out.dev = skip, dev
        return out


class Processor(StatefulProcessor):
    def __init__(self, params: Params, start_bpm: float, idle_ms: int | None):
        self.params, self.start_bpm, self.idle_ms = params, start_bpm, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("tracker", STATE)

    def _live(self) -> Live:
        return Live.of(tuple(self.kept.get()), self.params) if self.kept.exists() else Live(self.params, self.start_bpm)

    @staticmethod
    def _verdicts(key: tuple, made: list[tuple]):
        import pandas as pd

        return pd.DataFrame([(key[0], *v) for v in made], columns=["recording_id", "sample_idx", "t_sec", "peak_type", "confidence", "belief_bpm"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803 (Spark's names)
        import pandas as pd

        live, made = self._live(), []
        for r in pd.concat(list(rows)).sort_values("t_sec").itertuples(index=False):
            made += live.push(int(r.sample_idx), float(r.t_sec), float(r.amp), float(r.floor))
        self.kept.update(live.state())
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._verdicts(key, made)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        made = self._live().finish()
        self.kept.clear()
        yield self._verdicts(key, made)

    def close(self) -> None:
        pass


def track_stream(peaks: DataFrame, p: Params = DEFAULTS, start_bpm: float = 80.0, idle_ms: int | None = None) -> DataFrame:
    """Verdicts on a stream of (recording_id string, sample_idx, t_sec, amp, floor). With ``idle_ms``, a recording
    without new peaks for so long is closed: its pending peak is its last, and its state goes; such a query has batches without
    new rows and runs until it is stopped. Typed state needs Spark's RocksDB state store, which the session must name."""
    spark = peaks.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKS:
        raise ValueError(f"set {PROVIDER} to {ROCKS}")
    ship(spark)
    rows = peaks.select("recording_id", "sample_idx", "t_sec", "amp", "floor")
    return rows.groupBy("recording_id").transformWithStateInPandas(Processor(p, start_bpm, idle_ms), VERDICTS, "Append", "None" if idle_ms is None else "ProcessingTime")
