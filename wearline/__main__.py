"""Command line: process, flagship, models, sequence and charts."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators.recurrent import RecurrentParams
from .operators.scoring import score, worst
from .operators.tree import BoostParams, TreeParams
from .plans import workflows
from .schema import DEFAULT_CAP, DEFAULT_WINDOW, SUBSETS, subset_code
from .sources import sinks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="wearline", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("process", "flagship", "models", "sequence", "charts"):
        p = commands.add_parser(name)
        p.add_argument("subset", nargs="*" if name == "process" else "?", default=None if name == "process" else "FD001", type=_subset)
        p.add_argument("--rul-cap", type=int, default=DEFAULT_CAP)
        p.add_argument("--window", type=int, default=DEFAULT_WINDOW)
        p.add_argument("--data-dir", default="data/raw")
        p.add_argument("--out-dir", default="data/processed")
        if name == "process":
            p.add_argument("--report-only", action="store_true")
        if name in ("flagship", "models"):
            p.add_argument("--normalize", action="store_true")
        if name in ("flagship", "charts"):
            p.add_argument("--n-trees", type=int, default=100)
            p.add_argument("--learning-rate", type=float, default=0.1)
            p.add_argument("--max-depth", type=int, default=3)
            p.add_argument("--min-samples-leaf", type=int, default=20)
        if name == "sequence":
            p.add_argument("--hidden-size", type=int, default=32)
            p.add_argument("--epochs", type=int, default=50)
            p.add_argument("--learning-rate", type=float, default=1e-3)
            p.add_argument("--batch-size", type=int, default=32)
    return top


def _subset(text: str) -> str:
    try:
        return subset_code(text)
    except ValueError as e:
        raise argparse.ArgumentTypeError(str(e)) from e


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("wearline").getOrCreate()
    if a.command == "process":
        done, failed = workflows.process_all(spark, a.data_dir, None if a.report_only else a.out_dir, a.subset or list(SUBSETS), cap=a.rul_cap, window=a.window)
        for code, df in done.items():
            print(code)
            df.show(100, truncate=False)
        for code, e in failed.items():
            print(f"{code}: {e}", file=sys.stderr)
        return int(bool(failed))
    p = workflows.load(spark, a.data_dir, a.subset, a.rul_cap, a.command == "sequence" or getattr(a, "normalize", False))
    normalized = getattr(a, "normalize", False)
    if a.command in ("flagship", "charts"):
        params = BoostParams(a.n_trees, a.learning_rate, TreeParams(a.max_depth, a.min_samples_leaf))
    if a.command == "charts":
        for name, df in workflows.chart_data(p, a.window, params=params).items():
            df.write.mode("overwrite").csv(f"{a.out_dir}/charts/{name}.csv", header=True)
        return 0
    if a.command == "flagship":
        pred, model = workflows.boosted_predictions(p, a.window, params)
        sinks.write_csv(model.curve_table(spark), sinks.prediction_path(a.out_dir, a.subset, "flagship_training_curve", normalized), ("tree_number",), one_file=True)
        models, kind = {"flagship": "pred"}, "flagship_predictions"
    elif a.command == "models":
        pred, models, kind = workflows.baseline_predictions(p, a.window), {"linear": "pred_linear", "rf": "pred_rf"}, "test_predictions"
    else:
        pred, losses = workflows.recurrent_predictions(p, a.window, RecurrentParams(a.hidden_size, a.epochs, a.learning_rate, a.batch_size))
        print("loss by epoch:", *(f"{x:.2f}" for x in losses))
        models, kind = {"lstm": "pred_lstm"}, "sequence_predictions"
    pred = pred.cache()
    for name, column in models.items():
        print(name)
        score(pred.where(f"{column} is not null"), column).show(truncate=False)
        worst(pred.where(f"{column} is not null"), pred=column).show(truncate=False)
    sinks.write_csv(sinks.predictions(pred, models), sinks.prediction_path(a.out_dir, a.subset, kind, normalized), ("unit",), one_file=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
