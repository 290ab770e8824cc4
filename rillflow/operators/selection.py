"""Adaptive selection of frames from a series of change measurements, as a resumable state machine.

Pixels never come here: a row holds what decoding measured, namely the share of
changed pixels, the share of the frame that the change spans, and a signature
whose distance to another frame's tells how much both differ.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame

CALM, EARLY, STRONG = "coverage", "early_change", "significant_change"
OUT = "key string, frame_id long, at_sec double, net double, reason string, is_fallback boolean"


@dataclass(frozen=True)
class SelectionParams:
    """Thresholds and intervals; the defaults are those of the sampler's constructor."""

    threshold: float = 0.001
    history: int = 30
    vote_of: int = 1
    vote_needs: int = 1
    max_gap_sec: float = 15.0
    early_ratio: float = 0.4
    early_of: int = 3
    early_needs: int = 2
    early_interval_sec: float = 3.0
    early_cooldown_sec: float = 4.0
    strong_interval_sec: float = 1.0
    strong_cooldown_sec: float = 4.0
    dedup_ratio: float = 0.5
    single_frame: bool = True
    single_frame_floor_ratio: float = 2.0
    single_frame_max_area: float = 0.35
    long_baseline: bool = True
    fast_interval_sec: float = 0.5
    slow_interval_sec: float = 3.0


@dataclass
class Baseline:
    """A reference frame that is renewed every interval, with its own noise history."""

    at: float | None = None
    signature: float | None = None
    previous: float = 0.0
    history: list[float] = field(default_factory=list)

    def rising(self, at: float, signature: float | None, interval: float, early: float, keep: int) -> bool:
        """Whether the change since the reference is early-sized and growing; renews the reference when it is due."""
        if signature is None:
            return False
        if self.signature is None:
            self.at, self.signature = at, signature
            return False
        change = abs(signature - self.signature)
        net = max(0.0, change - (median(self.history) if self.history else 0.0))
        hit = net >= early and net > self.previous
        self.previous = net
        if at - self.at >= interval:
            self.history = [*self.history, change][-keep:]
            self.at, self.signature, self.previous = at, signature, 0.0
        return hit


@dataclass
class SelectionState:
    """Everything that the next frame's decision needs; it can be stored between batches."""

    started: bool = False
    last_at: float = 0.0
    first: tuple | None = None
    last_signature: float | None = None
    pending_best: tuple | None = None
    pending_early: tuple | None = None
    strong_until: float = float("-inf")
    early_until: float = float("-inf")
    ratios: list[float] = field(default_factory=list)
    votes: list[bool] = field(default_factory=list)
    early_votes: list[bool] = field(default_factory=list)
    fast: Baseline = field(default_factory=Baseline)
    slow: Baseline = field(default_factory=Baseline)
    selected: int = 0

    def dump(self) -> dict:
        plain = lambda x: {k: list(v) if isinstance(v, list) else v for k, v in vars(x).items()}
        return plain(self) | {"fast": plain(self.fast), "slow": plain(self.slow)}

    @classmethod
    def load(cls, stored: dict) -> SelectionState:
        state = cls(**{k: v for k, v in stored.items() if k not in ("fast", "slow")})
        state.fast, state.slow = Baseline(**stored["fast"]), Baseline(**stored["slow"])
        for name in ("first", "pending_best", "pending_early"):
            value = getattr(state, name)
            setattr(state, name, tuple(value) if value is not None else None)
        return state


class FrameSelector:
    """Feeds frames (frame_id, at_sec, ratio, area, signature) in time order; ``take`` returns the rows selected by one frame."""

    def __init__(self, params: SelectionParams, state: SelectionState | None = None) -> None:
        self.p, self.s = params, state or SelectionState()
        self.out: list[tuple] = []

    def _emit(self, frame: tuple, reason: str, fallback: bool = False) -> None:
        self.s.selected += 1
        self.out.append((frame[0], frame[1], frame[2], reason, fallback))

    def _duplicate(self, frame: tuple) -> bool:
        """Whether a frame is close to the last selected one; unknown signatures never are."""
        mark, last = frame[3], self.s.last_signature
        return mark is not None and last is not None and abs(mark - last) < self.p.dedup_ratio * self.p.threshold

    def _density(self, at: float) -> tuple[str, float]:
        if at < self.s.strong_until:
            return STRONG, self.p.strong_interval_sec
        if at < self.s.early_until:
            return EARLY, self.p.early_interval_sec
        return CALM, self.p.max_gap_sec

    def _passed(self, votes: list[bool], vote: bool, of: int, needs: int) -> bool:
        votes.append(vote)
        del votes[:-of]
        return vote and sum(votes) >= needs

    def _flush_early(self) -> None:
        """Select the armed frame at its own time unless it is a near duplicate (frames from a baseline are exempt)."""
        armed = self.s.pending_early
        if armed is not None and (armed[4] or not self._duplicate(armed)):
            self._emit(armed, "early_change")
        self.s.pending_early = None

    def take(self, frame_id: int, at: float, ratio: float, area: float | None, signature: float | None) -> list[tuple]:
        p, s = self.p, self.s
        self.out = []
        if not s.started:
            s.started, s.last_at, s.first, s.last_signature = True, at, (frame_id, at, 0.0, signature, False), signature
            s.fast.signature = s.slow.signature = signature
            s.fast.at = s.slow.at = at
            return self.out
        s.ratios = [*s.ratios, ratio][-p.history :]
        floor = median(s.ratios)
        net = max(0.0, ratio - floor)
        early_from = p.early_ratio * p.threshold
        long = False
        if p.long_baseline:
            hits = [b.rising(at, signature, every, early_from, p.history) for b, every in ((s.fast, p.fast_interval_sec), (s.slow, p.slow_interval_sec))]
            long = any(hits)
        frame = (frame_id, at, net, signature, long)
        if self._passed(s.votes, net >= p.threshold, p.vote_of, p.vote_needs):
            self._flush_early()
            self._emit(frame, "threshold_exceeded")
            s.last_at, s.last_signature, s.pending_best, s.early_votes = at, signature, None, []
            s.strong_until, s.early_until = at + p.strong_cooldown_sec, at + p.early_cooldown_sec
            return self.out
        before, _ = self._density(at)
        early = net >= early_from or long
        chosen = False
        spike = net >= p.single_frame_floor_ratio * (floor if floor > 0 else early_from)
        if p.single_frame and early and area is not None and spike and area <= p.single_frame_max_area:
            self._flush_early()
            if not self._duplicate(frame):
                self._emit(frame, "single_frame_change")
                chosen, s.last_at, s.last_signature, s.pending_best = True, at, signature, None
                s.early_until = at + p.early_cooldown_sec
        if not chosen and early and s.pending_early is None and before == CALM:
            s.pending_early = frame
        confirmed = self._passed(s.early_votes, early, p.early_of, p.early_needs)
        if confirmed:
            s.early_until = at + p.early_cooldown_sec
        armed = s.pending_early
        if not chosen and not confirmed and early and armed is not None and armed[0] != frame_id and at - s.last_at >= p.early_interval_sec and not self._duplicate(frame):
            self._emit(frame, "early_change")
            chosen, s.last_at, s.last_signature, s.pending_best = True, at, signature, None
        if not any(s.early_votes):
            s.pending_early = None
        now, interval = self._density(at)
        if not chosen and before == CALM and now == EARLY:
            onset = s.pending_early or frame
            if onset[4] or not self._duplicate(onset):
                self._emit(onset, "early_change")
                chosen, s.last_at, s.last_signature, s.pending_best = True, at, onset[3], None
            s.pending_early = None
        if not chosen:
            if s.pending_best is None or net >= s.pending_best[2]:
                s.pending_best = frame
            if at - s.last_at >= interval:
                self._cover(at, now)
        return self.out

    def _cover(self, at: float, reason: str) -> None:
        best = self.s.pending_best
        if reason != CALM and at - self.s.last_at < self.p.max_gap_sec and self._duplicate(best):
            return  # it stays pending
        self._emit(best, reason)
        self.s.last_at, self.s.last_signature, self.s.pending_best = at, best[3], None

    def finish(self) -> list[tuple]:
        """Rows selected by the end of input: a due pending frame, and the first frame if nothing was ever selected."""
        self.out = []
        best = self.s.pending_best
        if best is not None:
            reason, interval = self._density(best[1])
            if best[1] - self.s.last_at >= interval:
                self._cover(best[1], reason)
        if not self.s.selected and self.s.first is not None:
            self._emit(self.s.first, "fallback", True)
        return self.out


def select_rows(frames: Iterable[tuple], params: SelectionParams) -> list[tuple]:
    """All selected rows of one video's frames in time order, in order of their times."""
    machine, out = FrameSelector(params), []
    for frame in frames:
        out += machine.take(*frame)
    return sorted(out + machine.finish(), key=lambda r: (r[1], r[0]))


def select_frames(frames: DataFrame, key: str, frame_id: str, at: str, ratio: str, area: str, signature: str, params: SelectionParams | None = None) -> DataFrame:
    """Selected frames of every video.  A video's decisions depend on each other, so each video is one group."""
    chosen = params or SelectionParams()

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values([at, frame_id], kind="stable")
        clean = lambda v: None if pd.isna(v) else float(v)
        found = select_rows(((int(f), float(t), float(r), clean(a), clean(s)) for f, t, r, a, s in zip(rows[frame_id], rows[at], rows[ratio], rows[area], rows[signature], strict=True)), chosen)
        return pd.DataFrame([(str(group[key].iloc[0]), *r) for r in found], columns=["key", "frame_id", "at_sec", "net", "reason", "is_fallback"])

    return frames.select(key, frame_id, at, ratio, area, signature).groupBy(key).applyInPandas(fold, OUT)
