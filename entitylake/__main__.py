"""Run a job or a report: ``python -m entitylake <job|report> ...`` (under spark-submit on a cluster)."""

from __future__ import annotations

import argparse
from datetime import date
from typing import get_type_hints

from pyspark.sql import DataFrame

from entitylake.plans import jobs
from entitylake.plans.reports import REPORTS
from entitylake.session import session
from entitylake.sources.store import LayerStore

JOBS = (
    "known-entities",
    "articles",
    "refine-entities",
    "refine-articles",
    "sentiment",
    "mappings",
    "affiliations",
    "mentions",
    "article-sentiment",
)


def _pairs(values: list[str]) -> dict[str, str]:
    return dict(v.split("=", 1) for v in values)


def _typed(report: str, values: dict[str, str]) -> dict[str, str | int]:
    """Parameters in the types the report declares; names it does not know are left to it."""
    wanted = get_type_hints(REPORTS[report])
    return {k: int(v) if wanted.get(k) is int else v for k, v in values.items()}


def _table_options(values: list[str]) -> dict[str, dict[str, str]]:
    """``TABLE:NAME=VALUE`` by table."""
    options: dict[str, dict[str, str]] = {}
    for value in values:
        table, _, pair = value.partition(":")
        name, _, setting = pair.partition("=")
        if not (table and name):
            raise ValueError(f"{value!r} is not TABLE:NAME=VALUE")
        options.setdefault(table, {})[name] = setting
    return options


def show_all(df: DataFrame) -> None:
    """All rows, tab-separated; one partition at a time is held."""
    print(*df.columns, sep="\t")
    for row in df.toLocalIterator():
        print(*("" if value is None else value for value in row), sep="\t")


def parser() -> argparse.ArgumentParser:
    result = argparse.ArgumentParser(prog="entitylake", description=__doc__)
    result.add_argument("--store", default="table", help="table, jdbc or a file format such as parquet")
    result.add_argument("--root", help="folder of a file store")
    result.add_argument("--option", action="append", default=[], metavar="NAME=VALUE", help="store option")
    result.add_argument(
        "--table-option", action="append", default=[], metavar="TABLE:NAME=VALUE",
        help="read option of one table, such as partitionColumn of a large JDBC table",
    )
    commands = result.add_subparsers(dest="command", required=True)
    for name in JOBS:
        job = commands.add_parser(name)
        if name == "known-entities":
            job.add_argument("--raw_data_filepath", required=True, help="CSV file or glob")
        if name == "articles":
            job.add_argument("--landing", required=True, help="folder of API responses")
            job.add_argument("--days_back", type=int, default=7)
            job.add_argument("--as_of", type=date.fromisoformat, default=date.today())
        if name == "refine-articles":
            job.add_argument("--dedupe", action="store_true", help="keep one article per key")
        if name == "sentiment":
            job.add_argument("--positive", required=True, help="comma-separated words")
            job.add_argument("--negative", required=True, help="comma-separated words")
        if name == "mappings":
            job.add_argument("--threshold", type=float, default=80)
    report = commands.add_parser("report")
    report.add_argument("name", choices=sorted(REPORTS))
    report.add_argument("--parameter", action="append", default=[], metavar="NAME=VALUE")
    report.add_argument("--output", help="write Parquet here instead of showing rows")
    return result


def run(args: argparse.Namespace, store: LayerStore) -> None:
    match args.command:
        case "known-entities":
            jobs.load_known_entities(store, args.raw_data_filepath)
        case "articles":
            jobs.load_articles(store, args.landing, args.as_of, args.days_back)
        case "refine-entities":
            jobs.refine_entities(store)
        case "refine-articles":
            jobs.refine_articles(store, dedupe_articles=args.dedupe)
        case "sentiment":
            jobs.score_articles(store, jobs.lexicon(args.positive.split(","), args.negative.split(",")))
        case "mappings":
            jobs.map_entities(store, args.threshold)
        case "affiliations":
            jobs.publish_affiliations(store)
        case "mentions":
            jobs.publish_mentions(store)
        case "article-sentiment":
            jobs.publish_sentiment(store)
        case "report":
            parameters = _typed(args.name, _pairs(args.parameter))
            result = REPORTS[args.name](jobs.report_tables(store), **parameters)
            if args.output:
                result.write.mode("overwrite").parquet(args.output)
            else:
                show_all(result)


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = session(f"entitylake {args.command}")
    options, of_tables = _pairs(args.option), _table_options(args.table_option)
    run(args, LayerStore(spark, args.store, args.root, options, of_tables))


if __name__ == "__main__":
    main()
