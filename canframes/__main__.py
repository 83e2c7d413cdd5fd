"""Command line over a directory holding the six frame CSV files (or datasets).

    python -m canframes train-evaluate DATA_DIR OUT_DIR   # metrics table + leakage audit
    python -m canframes export DATA_DIR OUT_DIR [--tune-on val|test]
    python -m canframes compare TRUTH_FILE OTHER_FILE OUT_DIR  # ROC-AUC of two prediction files

The session comes from the environment (``spark-submit`` or ``getOrCreate``); results are
written as CSV under OUT_DIR, nothing is collected.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="canframes")
    sub = ap.add_subparsers(dest="cmd", required=True)
    te = sub.add_parser("train-evaluate")
    te.add_argument("data_dir")
    te.add_argument("out_dir")
    te.add_argument("--partitioned", action="store_true", help="files are source=<name> directories")
    ex = sub.add_parser("export")
    ex.add_argument("data_dir")
    ex.add_argument("out_dir")
    ex.add_argument("--tune-on", default="val", choices=["val", "test"])
    ex.add_argument("--partitioned", action="store_true")
    cp = sub.add_parser("compare")
    cp.add_argument("first")
    cp.add_argument("second")
    cp.add_argument("out_dir")
    args = ap.parse_args(argv)

    spark = SparkSession.builder.appName(f"canframes-{args.cmd}").getOrCreate()
    from canframes.sources import sinks

    if args.cmd == "train-evaluate":
        from canframes.plans.train_evaluate import train_evaluate_frames
        from canframes.sources.frame_csv import load_frames

        frames = load_frames(spark, args.data_dir, partitioned=args.partitioned).frames
        metrics, audit = train_evaluate_frames(frames)
        sinks.write_table_csv(metrics, f"{args.out_dir}/metrics.csv")
        sinks.write_table_csv(audit, f"{args.out_dir}/leakage_audit.csv")
    elif args.cmd == "export":
        from canframes.plans.export import export_artifacts_frames
        from canframes.sources.frame_csv import load_frames

        frames = load_frames(spark, args.data_dir, partitioned=args.partitioned).frames
        export_artifacts_frames(frames, args.out_dir, tune_on=args.tune_on)
    else:
        from canframes.operators import metrics as M
        from canframes.sources.score_csv import compare_files

        long = compare_files(spark, ("first", args.first), ("second", args.second))
        sinks.write_table_csv(M.auc_and_totals(M.curve(long)).select("model", "auc"), f"{args.out_dir}/roc_auc.csv")
        sinks.write_ordered_csv(M.roc_curve(M.shared_curve(long)), f"{args.out_dir}/roc_curve.csv", "model", "fpr", "tpr")


if __name__ == "__main__":
    main()
