"""python -m cairnfield.cli explore|dump|query PATH ...: looks into a geodatabase directory."""

from __future__ import annotations

import argparse
import json
import sys

from cairnfield.plans.query import Query
from cairnfield.sources import filegdb


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cairnfield")
    commands = parser.add_subparsers(dest="command", required=True)
    explore = commands.add_parser("explore", help="files and tables")
    explore.add_argument("path")
    for name, text in (("dump-table", "field descriptors"), ("dump-tablx", "row offsets"), ("dump-records", "rows, without Spark")):
        sub = commands.add_parser(name, help=text)
        sub.add_argument("path")
        sub.add_argument("layer")
        sub.add_argument("--limit", type=int, default=20)
    query = commands.add_parser("query", help="rows that meet a filter")
    query.add_argument("path")
    query.add_argument("layer")
    query.add_argument("--where")
    query.add_argument("--box", type=float, nargs=4)
    query.add_argument("--limit", type=int, default=20)
    args = parser.parse_args(argv)
    database = filegdb.Geodatabase(args.path)
    show = lambda x: print(json.dumps(x, default=str, ensure_ascii=False))
    if args.command == "explore":
        for entry in database.files:
            show({"file": entry.name, "bytes": entry.size})
        for name, number in database.names.items():
            show({"table": name, "id": number})
    elif args.command == "dump-table":
        for f in database.open(args.layer).fields:
            show({"name": f.name, "alias": f.alias, "type": f.kind, "width": f.width, "nullable": f.nullable})
    elif args.command == "dump-tablx":
        for fid, at in enumerate(database.open(args.layer).offsets()[: args.limit]):
            show({"fid": fid, "offset": at})
    elif args.command == "dump-records":
        for k, (fid, row) in enumerate(database.open(args.layer).rows()):
            if k == args.limit:
                break
            show({"fid": fid, **row})
    else:
        from pyspark.sql import SparkSession

        from cairnfield.catalog import Dataset

        dataset = Dataset.open(SparkSession.builder.getOrCreate(), args.path)
        for row in dataset.layer(args.layer).cursor(Query(where=args.where, box=tuple(args.box) if args.box else None, by_fid=True, limit=args.limit, with_geometry=False)):
            show(row.asDict())
    return 0


if __name__ == "__main__":
    sys.exit(main())
