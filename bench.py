"""Stage timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import pathlib
import sys
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from checks import view  # noqa: E402
from checks.queries import MSE, SETTINGS, STRESS  # noqa: E402
from optionlake import deploy  # noqa: E402
from optionlake.operators import compare, evaluate, forecast, hedge, report  # noqa: E402
from optionlake.operators import shape, splits, surface  # noqa: E402
from optionlake.plans.pipeline import Run, RunSettings  # noqa: E402
from optionlake.sources.stages import StageTables  # noqa: E402


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return deploy.prepare(spark)


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the executors
    large = SETTINGS.__dict__ | {"walkforward": splits.WalkforwardSettings(504, 126, 21, 21)}
    fitted = (forecast.FitPlan("ridge", {"alpha": 1.0}),
              forecast.FitPlan("elasticnet", {"alpha": 0.01, "l1_ratio": 0.1}),
              forecast.FitPlan("har_factor", {"n_factors": 5, "alpha": 1.0}))
    run = Run(lambda: view.raw_quotes(spark, sf_dir), RunSettings(**(large | {"fitted": fitted})),
              StageTables(spark))
    sweep = [forecast.FitPlan("ridge", {"alpha": a}) for a in (0.1, 1.0, 10.0, 100.0)] + [
        forecast.FitPlan("har_factor", {"n_factors": k, "alpha": 1.0}) for k in (2, 5, 8)] + [
        forecast.FitPlan("elasticnet", {"alpha": a, "l1_ratio": 0.1}) for a in (0.01, 0.1)]

    def tests() -> None:
        drain(compare.diebold_mariano(run.losses(), "naive"))
        drain(compare.spa_test(run.loss_series(), "naive"))
        drain(compare.model_confidence_set(run.loss_series()))

    def reports() -> None:
        slices = evaluate.slice_metrics(run.panel(), STRESS)
        drain(report.slice_leaders(slices, "wrmse_total_variance", "naive"))
        drain(report.cell_leaders(run.panel(), "naive"))
        drain(report.tail_risk(run.daily_loss(), MSE, "naive"))
        drain(report.worst_days(run.daily_loss(), MSE, "naive"))
        drain(shape.diagnostic_summary(
            shape.all_shape_diagnostics(run.forecasts(), run.gold(), run.grid)))
        drain(surface.sensitivity_summary(surface.completion_sensitivity(
            run.gold(), SETTINGS.surface, ("moneyness", "maturity"))))
        drain(hedge.hedging_summary(run.hedging()))

    steps: dict[str, Callable] = {
        "01_ingest_bronze": run.bronze,
        "02_option_panel": run.silver,
        "03_surfaces": run.gold,
        "04_features": run.features,
        "05_sweep": lambda: drain(forecast.validation_sweep(forecast.sweep_scores(
            forecast.validation_forecasts(run.features(), sweep, run.settings.walkforward, 3,
                                          run.grid), run.features()))),
        "06_walkforward": run.forecasts,
        "07_losses": run.daily_loss,
        "07_tests": tests,
        "08_spots": run.spots,
        "08_hedging": run.hedging,
        "09_report": reports,
    }
    seconds = {}
    for name, step in steps.items():
        start = time.perf_counter()
        step()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "full surface, forecast, test, hedging and report run",
        "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": pathlib.Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
