"""The stages of a full run, each a lazy DataFrame built from the previous stage's table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optionlake import names as N
from optionlake.functions.grid import SurfaceSettings
from optionlake.functions.sqlmath import not_finite
from optionlake.operators import calendar as cal
from optionlake.operators import compare, evaluate, forecast, hedge, panel, splits, surface
from optionlake.operators.features import FeatureSettings, build_features
from optionlake.operators.forest import ForestSettings, forest_forecasts
from optionlake.operators.gate import Gate, KeySet, summary
from optionlake.sources import quotes
from optionlake.sources.stages import StageTables

#: Contracts of the stage writes; see ``Run``.
GATES = ("ingest", "surface_inputs", "coverage", "losses", "hedging")
#: Enough days for the session before the first date and the target after the last one.
CALENDAR_PADDING = dt.timedelta(days=31)


@dataclass(frozen=True)
class RunSettings:
    surface: SurfaceSettings
    cleaning: panel.CleaningRules = panel.CleaningRules()
    market: cal.MarketRules = cal.MarketRules()
    features: FeatureSettings = FeatureSettings()
    walkforward: splits.WalkforwardSettings = splits.WalkforwardSettings()
    hedging: hedge.HedgeSettings = hedge.HedgeSettings()
    tuning_splits: int = 3
    benchmark: str = "naive"
    loss_metrics: tuple[str, ...] = ("observed_mse_total_variance",
                                     "observed_qlike_total_variance")
    positive_floor: float = 1.0e-8
    run_id: str = "run"
    fitted: tuple[forecast.FitPlan, ...] = ()
    forest: ForestSettings | None = None
    # NULL: from the quotes, with CALENDAR_PADDING on both sides
    calendar_start: dt.date | None = None
    calendar_end: dt.date | None = None
    sessions: Callable | None = field(default=None, compare=False)
    #: NULL: every underlying, every date
    symbols: tuple[str, ...] | None = None
    sample_window: tuple[dt.date, dt.date] = (dt.date(1000, 1, 1), dt.date(9999, 12, 31))
    gates: tuple[str, ...] = GATES
    #: The quotes come from a stored columnar table: it is read again rather than copied, unless the
    #: ingest gate has to hold a copy.
    source_is_table: bool = False


class Run:
    """Stage tables of one run. Every stage is written once and then read from storage.

    The gates named in the settings hold the writes: ``ingest`` (null keys, foreign underlyings or
    dates, files without one quote date), ``surface_inputs`` (usable quotes with unusable values),
    ``coverage`` (every model forecasts the same days and splits), ``losses`` (every model has
    the same finite losses by date) and ``hedging`` (one result per forecast). A breach raises
    ``ContractError`` before any later stage reads the table.
    """

    def __init__(self, bronze: Callable[[], DataFrame], settings: RunSettings,
                 tables: StageTables) -> None:
        self._bronze = bronze
        self.settings = settings
        self.tables = tables
        self._span: tuple[dt.date | None, dt.date | None] | None = None
        self.grid = settings.surface.grid

    def lookup(self) -> DataFrame:
        make = self.settings.sessions or cal.exchange_sessions
        start, end = self.calendar_span()
        sessions = make(self.tables.spark, start, end)
        return cal.session_lookup(cal.session_table(sessions, self.settings.market), start, end)

    def calendar_span(self) -> tuple[dt.date, dt.date]:
        """The configured span, or the dates of the quotes and expirations with padding."""
        start, end = self.settings.calendar_start, self.settings.calendar_end
        if start is None or end is None:
            if self._span is None:
                rows = self.bronze()
                last = [F.max(c) for c in (N.DATE, "expiration") if c in rows.columns]
                found = rows.agg(F.min(N.DATE).alias("low"), F.greatest(*last, last[0]).alias("high"))
                self._span = tuple(found.first())
            low, high = (d or dt.date(2004, 1, 1) for d in self._span)
            start, end = start or low - CALENDAR_PADDING, end or high + CALENDAR_PADDING
        return start, end

    def _gate(self, name: str, make: Callable[[], Gate]) -> Callable[[], Gate] | None:
        return make if name in self.settings.gates else None

    def bronze(self) -> DataFrame:
        def gate() -> Gate:
            low, high = self.settings.sample_window
            foreign = ~F.coalesce(quotes.wanted(self.settings.symbols), F.lit(False))
            nulls = {f"{c} is null": F.col(c).isNull() for c in quotes.KEY_COLUMNS}
            outside = ~F.coalesce(F.col(N.DATE).between(F.lit(low), F.lit(high)), F.lit(False))
            return Gate("bronze", nulls | {"foreign underlying": foreign, "outside the window": outside})

        table = self.tables.get("bronze", self._bronze, self._gate("ingest", gate))
        if "ingest" in self.settings.gates and "source_zip" in table.columns:
            self.ingest(table)
        return table

    def ingest(self, bronze: DataFrame | None = None) -> DataFrame:
        """Counts and status of each file."""
        def gate() -> Gate:
            return Gate("ingest", {s: F.col("status") == s for s in quotes.ERROR_STATUSES})

        table = bronze if bronze is not None else self.tables.get("bronze", self._bronze)
        return self.tables.get("ingest", lambda: quotes.ingest_summary(
            table, self.settings.symbols, *self.settings.sample_window), self._gate("ingest", gate))

    def _reads_source(self, stage: str) -> bool:
        """Whether later stages derive this one from the source instead of storing it."""
        return (self.settings.source_is_table and "ingest" not in self.settings.gates
                and stage not in self.tables._written)

    def _flagged(self) -> DataFrame:
        s, lookup = self.settings, self.lookup()
        rows = self._bronze() if self._reads_source("bronze") else self.bronze()
        if "tau_years" not in rows.columns:
            rows = cal.add_tau_years(rows, lookup, s.market).drop("last_tradable_session")
        derived = panel.add_derived_fields(cal.add_decision_timestamp(rows, lookup))
        return panel.flag_quality(derived, s.cleaning)

    def silver(self) -> DataFrame:
        """Flagged panel; quotes that already carry tau_years keep theirs."""
        def gate() -> Gate:
            broken = F.col("is_valid_observation") & panel.broken_inputs()
            return Gate("silver", {"usable quote with an unusable input": broken})

        return self.tables.get("silver", self._flagged, self._gate("surface_inputs", gate))

    def flagged(self) -> DataFrame:
        """The flagged panel for one pass over all quotes: the stored one, or derived on the way."""
        return self._flagged() if self._reads_source("silver") else self.silver()

    def assigned(self) -> DataFrame:
        return panel.assign_grid_cell(panel.valid_rows(self.silver()), self.grid)

    def quote_sums(self) -> DataFrame:
        """All that surfaces and spots need of the quotes, from one pass."""
        def gate() -> Gate:
            return Gate("quote_sums", {"usable quote with an unusable input": F.col("n_broken") > 0})

        return self.tables.get("quote_sums", lambda: surface.quote_sums(
            self.flagged(), self.grid), self._gate("surface_inputs", gate))

    def gold(self) -> DataFrame:
        return self.tables.get("gold", lambda: surface.gold_of_cells(
            surface.summed_cells(self.quote_sums(), self.settings.surface), self.settings.surface))

    def spots(self) -> DataFrame:
        return self.tables.get("spots", lambda: panel.spot_of_prices(
            surface.summed_prices(self.quote_sums())))

    def features(self) -> DataFrame:
        return self.tables.get("features", lambda: build_features(
            self.gold(), self.grid, self.lookup(), self.settings.features))

    def splits(self) -> DataFrame:
        return self.tables.get("splits", lambda: splits.walkforward_splits(
            self.features(), self.settings.walkforward))

    def boundary(self) -> DataFrame:
        return splits.clean_boundary(self.splits(), self.settings.tuning_splits)

    def test_dates(self) -> DataFrame:
        return splits.clean_splits(self.splits(), self.settings.tuning_splits).filter(
            "role = 'test'")

    def forecasts(self) -> DataFrame:
        def build() -> DataFrame:
            s = self.settings
            made = forecast.project_forecasts(self.features(), self.test_dates(), s.run_id)
            if s.fitted:
                made = made.unionByName(forecast.fit_forecasts(
                    self.features(), self.boundary(), s.fitted, s.walkforward, self.grid,
                    s.run_id, s.features))
            if s.forest:
                members = splits.clean_splits(self.splits(), s.tuning_splits)
                made = made.unionByName(forest_forecasts(
                    self.tables, self.features(), members, s.run_id, s.forest, s.features))
            return made

        def gate() -> Gate:
            day = (N.SYMBOL, N.DATE, N.TARGET_DATE, "split_id")
            models = {m: KeySet(day, F.col("model_name") == m) for m in self.models()}
            unknown = ~F.col("model_name").isin(*self.models())
            return Gate("forecasts", {"unknown model": unknown}, models | {
                "trades": KeySet(hedge.TRADE_KEY)}, alike=tuple(models))

        return self.tables.get("forecasts", build, self._gate("coverage", gate))

    def models(self) -> tuple[str, ...]:
        """Names of all models of the run."""
        return tuple(dict.fromkeys((*forecast.PROJECTED_MODELS,
                                    *(p.model_name for p in self.settings.fitted),
                                    *(("random_forest",) if self.settings.forest else ()))))

    def panel(self) -> DataFrame:
        return evaluate.realization_panel(self.forecasts(), self.gold(), self.grid,
                                          self.settings.positive_floor)

    def daily_loss(self) -> DataFrame:
        def gate() -> Gate:
            models = {m: KeySet((N.SYMBOL, N.TARGET_DATE), F.col("model_name") == m)
                      for m in self.models()}
            return Gate("daily_loss", {f"{m} is not finite": not_finite(m)
                                       for m in self.settings.loss_metrics}, models, tuple(models))

        return self.tables.get("daily_loss", lambda: evaluate.daily_loss(
            self.panel(), self.settings.positive_floor), self._gate("losses", gate))

    def losses(self) -> DataFrame:
        return compare.melt_losses(self.daily_loss(), self.settings.loss_metrics)

    def loss_series(self) -> DataFrame:
        return compare.loss_series(self.losses())

    def trades(self) -> DataFrame:
        return hedge.hedge_trades(self.forecasts(), self.gold(), self.spots())

    def hedging(self) -> DataFrame:
        def gate() -> Gate:
            self.forecasts()
            expected = {"trades": summary(self.tables.observed["forecasts"], "trades")} \
                if "forecasts" in self.tables.observed else {}
            return Gate("hedging", key_sets={"trades": KeySet(hedge.TRADE_KEY)}, expected=expected)

        return self.tables.get("hedging", lambda: hedge.evaluate_hedging(
            self.trades(), self.grid, self.settings.hedging), self._gate("hedging", gate))
