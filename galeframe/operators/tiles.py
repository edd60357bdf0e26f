"""Work done tile by tile, with a file for each tile and a report of what went well."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.operators.cut import cut
from galeframe.sources.ranges import exists, system


def run_tiles(rows: DataFrame, tile: str, compute: Callable[[pd.DataFrame], pd.DataFrame], path: str, tries: int = 2) -> DataFrame:
    """(tile, status, n, error): the rows of each tile computed side by side, a task for a tile, each written as tile_<id>.csv.

    A tile that has a file is skipped. One that raises is a fail with the error's text, and doesn't stop the others; it
    is asked for again, `tries` times in all. A file appears whole or not at all, so that a lost task can be repeated.
    A tile is a bounded piece of the grid; its rows are held by one task.
    """
    fs, root = system(path)
    fs.create_dir(root, recursive=True)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        name = f"tile_{part[tile].iloc[0]}.csv"
        row = {"tile": str(part[tile].iloc[0]), "status": "skipped", "n": None, "error": None}
        if not exists(f"{path}/{name}"):
            fs, root = system(path)
            own = f"{root}/_{name}-{uuid.uuid4().hex}"
            try:
                got = compute(part)
                with fs.open_output_stream(own, compression=None) as out:
                    out.write(got.to_csv(index=False).encode())
                fs.move(own, f"{root}/{name}")
                row |= {"status": "ok", "n": len(got)}
            except Exception as e:
                row |= {"status": "fail", "error": f"{type(e).__name__}: {e}"}
        return pd.DataFrame([row])

    report = None
    for _ in range(tries):
        todo = rows if report is None else rows.join(report.where("status = 'fail'").select(F.col("tile").alias("_t")), F.col(tile).cast("string") == F.col("_t"), "left_semi")
        # Written, so that reading the report doesn't do the work again.
        new = cut(todo.groupBy(tile).applyInPandas(one, "tile string, status string, n long, error string"))
        report = new if report is None else cut(report.where("status <> 'fail'").unionByName(new))
        if report.where("status = 'fail'").isEmpty():
            break
    return report
