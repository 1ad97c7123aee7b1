"""Rolling measures of bar series. Every frame is bounded: it runs in blocks of a series, which take a few rows from beside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scans
from ..functions.scalars import true_range
from ..sources.tables import SERIES, placed


def near():
    """Bars around a bar: for `rolling` alone, whose blocks hold the rows that its frames reach."""
    return scans.in_block(SERIES, "bar_index")


def rows(first: int, last: int):
    return near().rowsBetween(first, last)


def rolling(bars: DataFrame, columns: list[dict[str, Column]], behind: int = 0, ahead: int = 0, size: int = scans.BLOCK) -> DataFrame:
    """Bars with columns, step by step, whose frames over `near()` reach so many bars back and ahead. A bar_index comes and goes
    where the bars have none."""
    out = scans.framed(placed(bars), SERIES, "bar_index", columns, behind, ahead, size)
    return out if "bar_index" in bars.columns else out.drop("bar_index")


def _true_ranges() -> list[dict[str, Column]]:
    before = F.lag("close").over(near())
    return [{"tr": true_range(F.col("high"), F.col("low"), before), "tr_after": F.when(before.isNotNull(), true_range(F.col("high"), F.col("low"), before))}]


def _mean_range(period: int) -> dict[str, Column]:
    return {"atr": F.coalesce(F.avg("tr_after").over(rows(1 - period, 0)), F.lit(0.0))}


def with_true_range(bars: DataFrame) -> DataFrame:
    """tr: high - low where no bar is before; tr_after: NULL there."""
    return rolling(bars, _true_ranges(), 1)


def atr_partial(bars: DataFrame, period: int = 14) -> DataFrame:
    """Mean true range of at most `period` bars up to each; the first bar's is 0."""
    return rolling(bars, [*_true_ranges(), _mean_range(period)], period).drop("tr", "tr_after")


def atr_strict(bars: DataFrame, period: int = 14) -> DataFrame:
    """Mean true range of exactly `period` bars; NULL before there are so many."""
    w = rows(1 - period, 0)
    return rolling(bars, [*_true_ranges(), {"atr": F.when(F.count("tr").over(w) == period, F.avg("tr").over(w))}], period).drop("tr", "tr_after")


def trailing_means(bars: DataFrame, delta_bars: int = 20, volume_bars: int = 30) -> DataFrame:
    """Mean |delta| and mean volume of the bars before and the bar itself."""
    means = {"mean_abs_delta": F.avg(F.abs("delta")).over(rows(-delta_bars, 0)), "mean_volume": F.avg("volume").over(rows(-volume_bars, 0))}
    return rolling(bars, [means], max(delta_bars, volume_bars))


def forward_extrema(bars: DataFrame, horizon: int) -> DataFrame:
    """Highest high and lowest low of the next `horizon` bars, and how many there are.

    Cut a series into runs of `horizon` bars: the bars from the next one to the horizon are the rest of one run and the beginning of
    the following. Both extrema are running ones, so the work is the same for every horizon.
    """
    run = F.floor(F.col("bar_index") / horizon)
    whole = scans.in_block(SERIES, "bar_index").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    of_run = W.partitionBy(*SERIES, "_block", "_run").orderBy("bar_index")
    begun, rest = of_run.rowsBetween(W.unboundedPreceding, 0), of_run.rowsBetween(0, W.unboundedFollowing)
    steps: list[dict[str, Column]] = [
        {"_run": run},
        {"_high_begun": F.max("high").over(begun), "_low_begun": F.min("low").over(begun), "_high_rest": F.max("high").over(rest), "_low_rest": F.min("low").over(rest)},
        {"_last": F.max("bar_index").over(whole), "_last_run": F.max("_run").over(whole)}
        | {f"_{k}_end": F.coalesce(F.lead(f"_{k}_begun", horizon).over(near()), F.last(f"_{k}_begun").over(whole)) for k in ("high", "low")}
        | {f"_{k}_next": F.lead(f"_{k}_rest").over(near()) for k in ("high", "low")},
    ]
    # Where the series ends in the run that the next bar is in, that bar's rest of the run is all there is.
    two = F.floor((F.col("bar_index") + 1) / horizon) < F.least(F.col("_last_run"), F.floor((F.col("bar_index") + horizon) / horizon))
    end = lambda k: F.when(two, F.col(f"_{k}_end"))
    out = {
        "next_high": F.greatest("_high_next", end("high")),
        "next_low": F.least("_low_next", end("low")),
        "next_bars": F.least(F.col("_last") - F.col("bar_index"), F.lit(horizon).cast("long")),
    }
    size = -(-scans.BLOCK // horizon) * horizon
    return rolling(bars, [*steps, out], 0, horizon, size).drop(*(f"_{k}_{n}" for k in ("high", "low") for n in ("begun", "rest", "end", "next")), "_run", "_last", "_last_run")


def lead_atr(bars: DataFrame, ahead: int = 5, period: int = 14) -> DataFrame:
    """The range `ahead` bars later, or the series' last."""
    return rolling(bars, [*_true_ranges(), _mean_range(period), {"atr_after": F.last("atr").over(rows(0, ahead))}], period, ahead).drop("tr", "tr_after")
