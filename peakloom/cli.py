"""Command line: the same verbs as functions."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .params import Params, read_params
from .plans import workflows
from .sources import projects


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="peakloom")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for name in ("untargeted", "batch", "sample-table", "timestamps", "outliers", "build-classifier"):
        p = verbs.add_parser(name)
        p.add_argument("data", help="folder of raw files; for outliers, of feature Parquet; for build-classifier, of the long matrix in Parquet")
        p.add_argument("--out", default="output")
        p.add_argument("--params", help="CSV of parameters")
        p.add_argument("--samples", help="CSV of samples")
        p.add_argument("--group", default="group", help="column of the sample table to classify by")
        p.add_argument("--features", help="Parquet of the aligned features, for build-classifier: of these, annotated ones of good shape are taken")
    args = parser.parse_args(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName("peakloom").getOrCreate()
    params = read_params(spark, args.params) if args.params else Params()
    if args.verb == "untargeted":
        workflows.untargeted(spark, args.data, args.out, params, args.samples)
    elif args.verb == "batch":
        workflows.batch_file_processing(spark, args.data, args.out, params).write.mode("overwrite").csv(f"{args.out}_errors", header=True)
    elif args.verb == "sample-table":
        projects.sample_table(spark, args.data).coalesce(1).write.mode("overwrite").csv(args.out, header=True)
    elif args.verb == "timestamps":
        projects.timestamps(spark, args.data).coalesce(1).write.mode("overwrite").csv(args.out, header=True)
    elif args.verb == "build-classifier":
        from pyspark.ml.feature import StringIndexer
        from pyspark.sql import functions as F

        samples = projects.read_samples(spark, args.samples).where(F.col(args.group).isNotNull() & ~F.col("is_qc") & ~F.col("is_blank"))
        labels = StringIndexer(inputCol=args.group, outputCol="label", stringOrderType="alphabetAsc").fit(samples).transform(samples).select("sample_id", "label", args.group)
        model, columns, rows = workflows.build_classifier(spark.read.parquet(args.data), labels, features=spark.read.parquet(args.features) if args.features else None)
        for name, table in workflows.assess_classifier(rows).items():
            table.coalesce(1).write.mode("overwrite").csv(f"{args.out}/{name}", header=True)
        model.write().overwrite().save(f"{args.out}/model")
        columns.write.mode("overwrite").parquet(f"{args.out}/columns")
        labels.select("label", args.group).distinct().coalesce(1).write.mode("overwrite").csv(f"{args.out}/groups", header=True)
    else:
        found = workflows.run_evaluation(spark.read.parquet(args.data), projects.read_samples(spark, args.samples))
        found.coalesce(1).write.mode("overwrite").csv(args.out, header=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
