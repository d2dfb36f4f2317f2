"""``python -m fiscalith``: run a named query, list them, link texts, or write the report."""

from __future__ import annotations

import argparse

from fiscalith import catalog
from fiscalith.plans.linking import link_queries
from fiscalith.plans.pipeline import executive_report
from fiscalith.plans.trends import elements
from fiscalith.session import local_session
from fiscalith.sources.sinks import save


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="fiscalith")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("query")
    run.add_argument("folder")
    run.add_argument("--out")
    run.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    link = commands.add_parser("link")
    link.add_argument("folder")
    link.add_argument("text", nargs="+")
    report = commands.add_parser("report")
    report.add_argument("folder")
    report.add_argument("out")
    report.add_argument("--first", type=int, default=2020)
    report.add_argument("--last", type=int, default=2025)
    report.add_argument("text", nargs="*")
    args = parser.parse_args(argv)
    if args.command == "list":
        print(*sorted(catalog.QUERIES), sep="\n")
        return
    spark = local_session()
    if args.command == "run":
        df = catalog.QUERIES[args.query](spark, args.folder)
        save(df, args.out, args.format) if args.out else df.show(20, truncate=80)
    elif args.command == "link":
        link_queries(spark.createDataFrame([(t,) for t in args.text], "query string"), elements(spark, args.folder)).orderBy("query", "rank").show(50, truncate=60)
    else:
        executive_report(spark, args.folder, args.text, args.first, args.last, args.out)


if __name__ == "__main__":
    main()
