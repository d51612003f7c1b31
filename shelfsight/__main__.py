"""Command line: ``spark-submit -m shelfsight <job> ...`` or ``python -m shelfsight``.

    python -m shelfsight oos --stock S --closed C --out DIR
    python -m shelfsight rank --input R --out DIR
    python -m shelfsight inventory --sales S --report R --subcategory SC --vendor V \\
        --start 2019-04-01 --out DIR

The session comes from ``SparkSession.builder.getOrCreate()`` (cluster
settings from spark-submit); ``--local N`` starts a local session instead.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def _session(local: int | None, input_gb: float | None, cores: int | None) -> SparkSession:
    from shelfsight.plans.execution import cluster_settings, local_session, session_defaults

    if local:
        return local_session(local, shuffle_partitions=local)
    conf = (cluster_settings(input_gb * 1024 ** 3, cores) if input_gb and cores
            else session_defaults())
    b = SparkSession.builder.appName("shelfsight")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="shelfsight")
    p.add_argument("--local", type=int, default=None, help="run on local[N]")
    p.add_argument("--format", default="csv", choices=["csv", "parquet"])
    p.add_argument("--input-gb", type=float, default=None,
                   help="input size, to size partitions (with --cores)")
    p.add_argument("--cores", type=int, default=None, help="total executor cores of the cluster")
    sub = p.add_subparsers(dest="job", required=True)
    o = sub.add_parser("oos", help="out-of-stock report")
    o.add_argument("--stock", required=True)
    o.add_argument("--closed", default=None)
    o.add_argument("--out", required=True)
    o.add_argument("--window-days", type=int, default=7)
    r = sub.add_parser("rank", help="week-over-week rank flags")
    r.add_argument("--input", required=True)
    r.add_argument("--out", required=True)
    i = sub.add_parser("inventory", help="shelf-space analysis")
    for a in ("--sales", "--report", "--subcategory", "--vendor", "--start", "--out"):
        i.add_argument(a, required=True)
    i.add_argument("--all-stores", action="store_true", help="every store in one job")
    args = p.parse_args(argv)

    from shelfsight.plans import jobs
    from shelfsight.plans.params import inventory_params

    spark = _session(args.local, args.input_gb, args.cores)
    if args.job == "oos":
        jobs.run_oos_job(spark, args.stock, args.closed, args.out, args.format, args.window_days)
    elif args.job == "rank":
        jobs.run_rank_job(spark, args.input, args.out, args.format)
    else:
        params = inventory_params(args.report, args.start)
        jobs.run_inventory_job(spark, args.sales, args.report, args.subcategory, args.vendor,
                               params, args.out, args.format, all_stores=args.all_stores)
    return 0


if __name__ == "__main__":
    sys.exit(main())
