"""Commands: load-db <folder>, most-tagged <root> [n], best-rated <root> [n]."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from .functions.text import duration_text
from .plans.connection import connect
from .sources import movies


def main(args: list[str] | None = None, spark: SparkSession | None = None, out=print) -> int:
    """Exit codes: 0 done, 1 no or an unknown command, 2 bad options, 3 bad arguments."""
    parser = argparse.ArgumentParser("vellum", exit_on_error=False)
    parser.add_argument("--root", default="vellum-store", help="folder of the store")
    parser.add_argument("--master", default=None)
    parser.add_argument("command", nargs="?")
    parser.add_argument("args", nargs="*")
    try:
        given = parser.parse_args(args)
    except (argparse.ArgumentError, SystemExit):
        return 2
    if given.command not in ("load-db", "most-tagged", "best-rated"):
        out(parser.format_usage())
        return 1
    most = 1 if given.command == "load-db" else 2
    if not 1 <= len(given.args) <= most or (len(given.args) == 2 and not given.args[1].isdigit()):
        out(f"Usage: {given.command} " + ("<folder>" if most == 1 else "<root id> [n]"))
        return 3
    if spark is None:
        builder = SparkSession.builder.appName("vellum")
        spark = (builder.master(given.master) if given.master else builder).getOrCreate()
    began = time.time()
    connection = connect(spark, given.root)
    if given.command == "load-db":
        out(f"Database root: {movies.load_dataset(connection, given.args[0], out).node_id}")
    else:
        db, n = connection.load_database(given.args[0]), int(given.args[1]) if len(given.args) > 1 else 10
        rows = (movies.most_tagged if given.command == "most-tagged" else movies.best_rated)(db, n).collect()
        out("\t".join(rows[0].asDict()) if rows else "nothing found")
        for r in rows:
            out("\t".join("" if v is None else str(v) for v in r))
    out(f"took {duration_text(time.time() - began)}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
