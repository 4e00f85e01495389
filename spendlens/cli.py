"""Command-line jobs.

    python -m spendlens.cli land --csv <export files> --out <parquet dir> [--layout working] [--preamble 1]
    python -m spendlens.cli land --parquet <extract dir> --out <parquet dir> [--layout working]
    python -m spendlens.cli export --lines <landed dir> --params <json> --bids <csv> [--bids <csv>] --out <dir>

``land`` reads an ERP extract once (CSV with title line, or Parquet),
converts it to the canonical schema with file-order ``line_id`` and writes
it partitioned by fiscal year; the reports then read the landed copy.
"""

from __future__ import annotations

import argparse

from spendlens.params import DEFAULT_PARAMS, params_from_json
from spendlens.schema import BID_SCHEMA


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="spendlens")
    sub = ap.add_subparsers(dest="cmd", required=True)
    land = sub.add_parser("land", help="land an ERP extract as canonical Parquet")
    src = land.add_mutually_exclusive_group(required=True)
    src.add_argument("--csv", help="CSV export files (glob)")
    src.add_argument("--parquet", help="Parquet extract folder")
    land.add_argument("--layout", default="working", help="sheet header layout (cube / working)")
    land.add_argument("--preamble", type=int, default=1, help="title lines before the CSV header")
    land.add_argument("--out", required=True)
    exp = sub.add_parser("export", help="write the report set as CSV")
    exp.add_argument("--lines", required=True, help="landed PO-line Parquet folder")
    exp.add_argument("--bids", action="append", default=[], help="bid-log CSV (repeatable)")
    exp.add_argument("--params", required=True, help="JSON file of report parameters (periods, buyer lists, limits)")
    exp.add_argument("--out", required=True)
    args = ap.parse_args(argv)

    from spendlens.session import build_session

    spark = build_session()
    try:
        if args.cmd == "land":
            from spendlens.sources.files import land_po_lines, read_po_lines_csv, read_po_lines_parquet

            if args.csv:
                df = read_po_lines_csv(spark, args.csv, layout=args.layout, preamble_lines=args.preamble)
            else:
                df = read_po_lines_parquet(spark, args.parquet, layout=args.layout)
            land_po_lines(df, args.out, DEFAULT_PARAMS.fiscal_year_start_month)
        else:
            from spendlens.plans import platform as plat
            from spendlens.plans.export import export_reports
            from spendlens.sources.files import read_bid_log

            # fiscal_year, the landing's folder column, stays: reports of a year read its folders only
            lines = spark.read.parquet(args.lines)
            logs = [read_bid_log(spark, b) for b in args.bids]
            bids = plat.all_bids(*logs) if logs else spark.createDataFrame([], BID_SCHEMA)
            export_reports(lines, bids, args.out, params_from_json(args.params))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
