"""Command line: queries over a folder of tables, or building its indexes.

python -m slatewing.cli --data DIR [--index DIR] [--loose] query.sql ...
python -m slatewing.cli --build --data DIR --index DIR schema.sql ...
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from slatewing.plans.script import run, split
from slatewing.sources.catalog import Catalog
from slatewing.sources.ddl import parse_create
from slatewing.sources.index import IndexStore
from slatewing.sources.pipe import lines


def main(argv: list[str] | None = None, out=None) -> int:
    parser = argparse.ArgumentParser(prog="slatewing", description=__doc__)
    parser.add_argument("--data", required=True, help="folder with the tables' files")
    parser.add_argument("--index", help="folder of the indexes: where to build them, or which to use in filters")
    parser.add_argument("--build", action="store_true", help="build the declared indexes and stop")
    parser.add_argument("--loose", action="store_true", help="allow selected columns that are not grouped")
    parser.add_argument("scripts", nargs="+")
    args = parser.parse_args(argv)
    out = out or sys.stdout
    spark = SparkSession.builder.appName("slatewing").getOrCreate()
    catalog = Catalog(spark, args.data)
    texts = [Path(x).read_text() for x in args.scripts]
    if args.build:
        if not args.index:
            parser.error("--build needs --index")
        for statement in (s for text in texts for s in split(text) if s[:6].lower() == "create"):
            catalog.declare(parse_create(statement))
        for path in IndexStore(spark, args.index).build_all(catalog):
            print(path, file=out)
        return 0
    store = IndexStore(spark, args.index) if args.index else None
    for text in texts:
        for df in run(spark, text, catalog, args.loose, store):
            for row in lines(df):
                print(row, file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
