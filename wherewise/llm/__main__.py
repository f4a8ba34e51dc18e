"""python -m wherewise.llm OPERATOR FOLDER: one of the contract queries over a folder of tables."""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    from .queries import QUERIES

    if len(args) != 2 or args[0] not in QUERIES:
        print(__doc__, *QUERIES, sep="\n")
        return 2
    from pyspark.sql import SparkSession

    QUERIES[args[0]](SparkSession.builder.appName("wherewise.llm").getOrCreate(), args[1]).show(20)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
