"""python -m wherewise list | run QUERY FOLDER | query TEXT: queries by name over a folder of tables, or one phrase's parse."""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    if args[:1] == ["query"] and len(args) > 1:
        from .functions.parser import parse

        q = parse(" ".join(args[1:]))
        print(q.relation_type, q.frame_hint or "-", *[f"{p.label} {p.relation or ''}".strip() for p in q.chain], sep=" | ")
        return 0
    from .plans import all_queries

    if args == ["list"]:
        print(*sorted(all_queries.QUERIES), sep="\n")
        return 0
    if args[:1] == ["run"] and len(args) == 3:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("wherewise").getOrCreate()
        all_queries.QUERIES[args[1]](spark, args[2]).show(20, truncate=False)
        return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
