"""Operator 4, line dedup: winnowing over line hashes, with DataFrame operations only.

The lines of a document that hold a word are a sequence of hashes. In each window of `window` consecutive lines the
smallest hash (the last of equals) is selected; its position is a fingerprint, a row that carries the runs of lines
before and after it in the windows that selected it. Two equal runs of `window` lines or more always share a
fingerprint. Fingerprints are joined by their hash, and only those that stand at two positions are followed: from each
the match is extended to both sides, over those of its runs whose content stands at another position with this
fingerprint too. Runs that overlap make up the whole match. It stays where it stands first in the corpus (by id, then
line) and its lines are deleted wherever it comes later, in the same document too.

Defined results: a null text stays null and has no lines; lines without a word are never matched or deleted; rows with
equal id and equal text are one document; documents of fewer lines than the window lose nothing; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import row_key
from galeframe.llm.store import Work


def fingerprints(window: int) -> Column:
    """Of the lines l (number i, hashes a and b): position and hash of each window minimum, and the runs of lines that selected it. p: the minimum's place for each window."""
    least = f"transform(sequence(0, size(l) - {window}), j -> j + {window - 1} - cast(array_position(reverse(slice(l.a, j + 1, {window})), array_min(slice(l.a, j + 1, {window}))) - 1 as int))"
    run = f"named_struct('at', l[j].i, 'covers', slice(l.i, j + 1, {window}), 'c1', xxhash64(slice(l.a, j + 1, {window})), 'c2', xxhash64(slice(l.b, j + 1, {window})))"
    runs = f"transform(filter(sequence(greatest(0, k - {window - 1}), least(k, size(l) - {window})), j -> p[j] = k), j -> {run})"
    return F.expr(f"transform(array({least}), p -> transform(array_distinct(p), k -> named_struct('at', l[k].i, 'print', l[k].a, 'runs', {runs})))[0]")


def repeated_lines(docs: DataFrame, work: Work, window: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _key and gone (the numbers of the lines to delete, from 0), for documents with such lines."""
    lines = F.expr("filter(transform(split(_text, '\n'), (x, i) -> named_struct('i', i, 'a', xxhash64(x), 'b', xxhash64(x, 1), 'w', x rlike '[^\\\\x20\\\\x09-\\\\x0D]')), x -> x.w)")
    base = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("_key"), F.col(text_col).alias("_text"))
    seq = base.select("_id", "_key", lines.alias("l"))
    marks = seq.select("_id", "_key", F.explode_outer(F.when(F.size("l") >= window, fingerprints(window))).alias("f")).where("f is not null")
    marks = marks.select("_id", "_key", "f.print", "f.runs")  # found twice from the documents, which costs less than keeping them
    twice = marks.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print")
    # What is aggregated by a key is written before it is joined by it: else the join takes over its partitions, and a
    # fingerprint that many documents hold can't be split over tasks.
    near = marks.join(work.write(twice), "print", "left_semi").select("_id", "_key", "print", F.explode("runs").alias("r")).select("_id", "_key", "print", "r.*")
    first = near.groupBy("print", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("_id", "_key", "at")).alias("first")).where("n > 1").drop("n")
    later = near.join(work.write(first), ["print", "c1", "c2"]).where(~F.struct("_id", "_key", "at").eqNullSafe(F.col("first")))
    return later.groupBy("_id", "_key").agg(F.array_distinct(F.flatten(F.collect_set("covers"))).alias("gone"))


def dedup_lines(docs: DataFrame, window: int = 2, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False) -> DataFrame:
    """docs with the later repeated runs of lines deleted, and n_lines and n_deleted as last columns (replacing columns of these names). drop_emptied: without the documents that lost all lines that hold a word."""
    if window < 1:
        raise ValueError("a window has a line at least")
    names = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    gone = repeated_lines(docs, Work(docs.sparkSession), window, id_col, text_col)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_a"), row_key(id_col, text_col).alias("_b"))
    out = rows.join(gone, (F.col("_b") == F.col("_key")) & F.col("_a").eqNullSafe(F.col("_id")), "left")
    out = out.withColumn("_lines", F.when(F.col("gone").isNotNull(), F.split(F.col(f"_row.`{text_col}`"), "\n")))
    kept = F.expr("transform(array_except(sequence(0, size(_lines) - 1), gone), i -> _lines[i])")
    text = F.when(F.col("gone").isNull(), F.col(f"_row.`{text_col}`")).otherwise(F.array_join(kept, "\n"))
    if drop_emptied:
        out = out.withColumn("_text", text).where(F.col("gone").isNull() | F.col("_text").rlike("[^\\x20\\x09-\\x0D]"))
        text = F.col("_text")
    n = F.coalesce(F.length(F.col(f"_row.`{text_col}`")) - F.length(F.replace(F.col(f"_row.`{text_col}`"), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    return out.select(*[text.alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in names], n.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"))
