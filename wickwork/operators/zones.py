"""Order-block retests and gap fills: folds over each symbol's bars with at most `most` live zones a side.

Zones are evicted and used up as bars pass, so no window expresses them; the fold's state is of fixed size and is
carried over batches (operators.recursive.scanned).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recursive import scanned


@dataclass
class _Zones:
    """Live zones of one kind, oldest first, as [low, high, birth]; side 1 for bull, -1 for bear."""

    side: int
    most: int
    max_age: int
    live: list = field(default_factory=list)

    def add(self, low: float, high: float, birth: int, unless_newest: bool) -> None:
        if unless_newest and self.live and self.live[-1][:2] == [low, high]:
            return
        self.live = [*self.live, [low, high, birth]][-self.most :]

    def step(self, i: int, bar: tuple, atr: float | None, fired: bool) -> bool:
        """Drops old and broken zones; whether one was returned to (then it is used up). Only one a bar, over both sides."""
        open_, high, low, close = bar
        kept = []
        for zone in self.live:
            bottom, top, birth = zone
            broken = atr is not None and (close < bottom - atr if self.side > 0 else close > top + atr)
            if i - birth > self.max_age or broken:
                continue
            if not fired and (low <= top < close and close > open_ if self.side > 0 else high >= bottom > close and close < open_):
                fired = True
                continue
            kept.append(zone)
        self.live = kept
        return fired


class _Fold:
    def __init__(self, max_age: int, most: int):
        self.blocks = [_Zones(1, most, max_age), _Zones(-1, most, max_age)]
        self.gaps = [_Zones(1, most, max_age), _Zones(-1, most, max_age)]
        self.i, self.past = -1, []

    def step(self, open_: float, high: float, low: float, close: float, atr: float | None) -> tuple[int, int]:
        self.i += 1
        i, bar, past = self.i, (open_, high, low, close), self.past
        out = [0, 0]
        if i >= 3:
            moved = close - past[-3][3]
            for zones, way in zip(self.blocks, (1, -1), strict=True):
                if atr is not None and way * moved > 1.5 * atr:
                    against = next((b for b in reversed(past[-4:]) if way * (b[3] - b[0]) < 0), None)
                    if against:
                        zones.add(against[2], against[1], i, unless_newest=True)
            out[0] = self._fire(self.blocks, i, bar, atr)
        if i >= 2:
            two = past[-2]
            if low > two[1]:
                self.gaps[0].add(two[1], low, i, unless_newest=False)
            if high < two[2]:
                self.gaps[1].add(high, two[2], i, unless_newest=False)
            out[1] = self._fire(self.gaps, i, bar, atr)
        self.past = [*past, bar][-4:]
        return out[0], out[1]

    @staticmethod
    def _fire(pair: list[_Zones], i: int, bar: tuple, atr: float | None) -> int:
        bull = pair[0].step(i, bar, atr, False)
        both = pair[1].step(i, bar, atr, bull)
        return 1 if bull else -1 if both else 0


def zone_signals(df: DataFrame, max_age: int = 50, most: int = 3) -> DataFrame:
    """df (with open, high, low, close, ATR_14) and sig_ob_retest, sig_fvg_fill."""
    out = scanned(df, lambda: _Fold(max_age, most), ["sig_ob_retest", "sig_fvg_fill"], ["open", "high", "low", "close", "ATR_14"])
    return out.withColumns({c: F.col(c).cast("int") for c in ("sig_ob_retest", "sig_fvg_fill")})
