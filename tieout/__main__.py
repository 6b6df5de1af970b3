"""``python -m tieout``: reconcile a named dataset or a folder of exports, evaluate labelled datasets, or time runs."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession

from tieout.conf import Settings
from tieout.plans.service import Service
from tieout.sources import ingest


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tieout", description=__doc__)
    what = parser.add_mutually_exclusive_group(required=True)
    what.add_argument("--dataset", help="name of a folder below --root")
    what.add_argument("--input", help="folder of exports")
    what.add_argument("--evaluate", nargs="*", metavar="NAME", help="labelled datasets, all if none is named")
    what.add_argument("--benchmark", nargs="+", metavar="NAME", help="datasets to time")
    parser.add_argument("--root", default="data", help="folder of datasets")
    parser.add_argument("--store", default="store", help="folder of worklist, ledger and evaluations")
    parser.add_argument("--out", help="folder to write results to")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("tieout").getOrCreate()
    service = Service(spark, args.root, args.store, Settings.of(spark))
    if args.evaluate is not None:
        rows = service.evaluation(args.evaluate or None).toJSON().collect()  # one row
    elif args.benchmark:
        rows = []
        for name in args.benchmark:
            began = time.time()
            n = service.reconcile(name).metrics().first().entries
            took = time.time() - began
            rows.append(json.dumps({"dataset": name, "entries": n, "seconds": round(took, 3), "entries_per_sec": round(n / took, 1)}))
    else:
        result = service.reconcile(args.dataset) if args.dataset else service.reconcile_files(ingest.existing(spark, args.input))
        rows = result.metrics().toJSON().collect() + result.money().toJSON().collect() + result.fingerprint().toJSON().collect()  # three rows
        if args.out:
            service.write(result, args.out)
    print("\n".join(rows))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
