"""python -m galeframe QUERY SF_DIR OUT: runs a query and writes its result; python -m galeframe lists the queries."""

from __future__ import annotations

import argparse
import logging


def main(args: list[str] | None = None) -> None:
    from galeframe.plans import assembly, distributions, evaluation, files, formats, learning, services

    queries = {k: f for m in (distributions, assembly, evaluation, learning, files, formats, services) for k, f in m.QUERIES.items()}
    p = argparse.ArgumentParser(prog="galeframe", description="Runs a query over a folder of tables.")
    p.add_argument("query", nargs="?", choices=sorted(queries))
    p.add_argument("sf_dir", nargs="?")
    p.add_argument("out", nargs="?")
    a = p.parse_args(args)
    if not a.query:
        print("\n".join(f"{k}: {(f.__doc__ or '').strip().splitlines()[0] if f.__doc__ else ''}".rstrip(": ") for k, f in sorted(queries.items())))
        return
    if not a.sf_dir or not a.out:
        p.error("a query needs SF_DIR and OUT")
    from pyspark.sql import SparkSession

    from galeframe.sources.tables import write_table

    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    write_table(queries[a.query](spark, a.sf_dir), a.out, mode="overwrite")
    logging.info("wrote %s", a.out)


if __name__ == "__main__":
    main()
