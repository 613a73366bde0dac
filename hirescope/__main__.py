"""Command line: build every model, or add one day of keyword counts.

  python -m hirescope build [--postings-raw T] [--descriptions-raw T]
                            [--keyword-snapshots T] [--target-schema S]
                            [--location-root DIR]
  python -m hirescope snapshot --date YYYY-MM-DD [--silver T] [--out T]
  python -m hirescope stream --landing DIR --checkpoint DIR --latest DIR [--out T]
                             [--descriptions-raw T] [--state-partitions N] [--continuous [--interval I]]

``T`` is a catalog table name or a Parquet folder (anything with ``/``).
Defaults are the catalog names the source project reads and writes. The
session comes from ``spark-submit`` / the platform; nothing here sets
cluster options.
"""

import argparse
import sys

from pyspark.sql import SparkSession

from hirescope.plans.project import build_all
from hirescope.plans.snapshots import keyword_snapshot
from hirescope.sources.readers import (
    newest_partition_date,
    read_descriptions_raw,
    read_keyword_snapshots,
    read_postings_raw,
    read_source,
)
from hirescope.sources.sinks import (
    BRONZE_SCHEMA,
    DESCRIPTIONS_RAW_TABLE,
    KEYWORD_SNAPSHOTS_TABLE,
    MODEL_TABLES,
    POSTINGS_RAW_TABLE,
    SILVER_SCHEMA,
    publish,
    release_staged,
    write_snapshot,
)
from hirescope.streaming import latest_postings_stream, read_latest, silver_from_latest
from hirescope.streaming.landing import ROCKSDB_STATE_STORE


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="hirescope")
    sub = p.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("build", help="build the silver and gold tables")
    b.add_argument("--postings-raw", default=f"{BRONZE_SCHEMA}.{POSTINGS_RAW_TABLE}")
    b.add_argument("--descriptions-raw", default=f"{BRONZE_SCHEMA}.{DESCRIPTIONS_RAW_TABLE}")
    b.add_argument("--keyword-snapshots", default=f"{SILVER_SCHEMA}.{KEYWORD_SNAPSHOTS_TABLE}")
    b.add_argument("--target-schema", default="default")
    b.add_argument("--location-root", default=None)
    b.add_argument("--catalog", default=None, help="catalog of the tables written (and of stored models read)")
    b.add_argument("--select", nargs="+", default=None, choices=sorted(MODEL_TABLES),
                   help="build only these models; others are read from their stored tables")
    s = sub.add_parser("snapshot", help="count keywords over silver postings for one date")
    s.add_argument("--date", required=True)
    s.add_argument("--silver", default=".".join(MODEL_TABLES["silver_postings"]))
    s.add_argument("--out", default=f"{SILVER_SCHEMA}.{KEYWORD_SNAPSHOTS_TABLE}")
    r = sub.add_parser("stream", help="keep silver postings up to date as raw files land")
    r.add_argument("--landing", required=True, help="folder the raw posting files land in")
    r.add_argument("--checkpoint", required=True, help="streaming checkpoint folder (shared storage)")
    r.add_argument("--latest", required=True, help="folder the latest postings are kept in (shared storage)")
    r.add_argument("--interval", default="1 minute", help="how often --continuous looks for new files")
    r.add_argument("--out", default=".".join(MODEL_TABLES["silver_postings"]))
    r.add_argument("--descriptions-raw", default=f"{BRONZE_SCHEMA}.{DESCRIPTIONS_RAW_TABLE}",
                   help="join descriptions to emit the whole silver model; 'none' for postings only")
    r.add_argument("--state-partitions", type=int, default=None)
    r.add_argument("--heap-state", action="store_true",
                   help="keep streaming state on the JVM heap instead of RocksDB")
    r.add_argument("--continuous", action="store_true",
                   help="keep running (default: process what has landed, then stop)")
    return p


def _stream(spark, args) -> None:
    def rebuild():
        if args.descriptions_raw == "none":
            df = read_latest(spark, args.latest)
        else:
            df = silver_from_latest(spark, args.latest, lambda: read_descriptions_raw(spark, args.descriptions_raw))
        if "/" in args.out:
            df.write.mode("overwrite").parquet(args.out)
        else:
            schema, _, table = args.out.rpartition(".")
            publish(df, schema or "default", table)

    q = latest_postings_stream(spark, args.landing, args.checkpoint, args.latest,
                               available_now=not args.continuous, trigger_interval=args.interval,
                               state_partitions=args.state_partitions,
                               state_store_provider=None if args.heap_state else ROCKSDB_STATE_STORE,
                               after_merge=rebuild if args.continuous else None)
    q.awaitTermination()
    # Also without a new posting: descriptions may have landed since.
    rebuild()


def main(argv=None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"hirescope-{args.cmd}").getOrCreate()
    if args.cmd == "build":
        wanted = set(args.select or MODEL_TABLES)
        needs_raw = "silver_postings" in wanted
        needs_snaps = bool(wanted & {"keyword_latest", "keyword_trends"})
        tables = build_all(
            read_postings_raw(spark, args.postings_raw) if needs_raw else None,
            read_descriptions_raw(spark, args.descriptions_raw) if needs_raw else None,
            read_keyword_snapshots(spark, args.keyword_snapshots) if needs_snaps else None,
            target_schema=args.target_schema,
            location_root=args.location_root,
            select=set(args.select) if args.select else None,
            catalog=args.catalog,
            spark=spark,
            newest_date=newest_partition_date(spark, args.keyword_snapshots) if "keyword_latest" in wanted else None,
        )
        for name in tables:
            print(f"built {name}")
    elif args.cmd == "snapshot":
        write_snapshot(keyword_snapshot(read_source(spark, args.silver), args.date), args.out)
        print(f"wrote keyword snapshot {args.date} to {args.out}")
    else:
        _stream(spark, args)
        print(f"stream caught up; stored {args.out}")
    release_staged(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
