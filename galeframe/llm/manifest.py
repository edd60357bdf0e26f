"""Merkle manifest of a dataset: a leaf for each row, a tree for each group, a tree over the groups' roots, and a proof for each row.

Bottom-up, a level's nodes are grouped by the number of their parent and written; the written level holds each parent
with its children. Top-down, the children of a level join their parents, and each prepends its siblings to the proof
suffix that its parent has inherited. A level is a half (or less) of the one below, so both ways together move about
twice the leaves, and the number of jobs is the logarithm of the largest group. A run of children is one small array;
a group of any size is spread over tasks by the numbers of its nodes. All of it is DataFrame functions.

H is the lowercase hexadecimal SHA-256 of its concatenated inputs; digests go in as their hexadecimal text.

Defined cases: a NULL field is `-` in the leaf, a NULL group a group of its own before all others, a NULL id before all
ids. Rows with equal ids stand in order of their leaf, so repeated rows are leaves of their own, side by side; they are
told apart by nothing, and either order gives the same tree. A group of one row has its leaf as root. An empty table
has no rows. Further columns of the input aren't read, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.llm.store import Work
from galeframe.operators import ordered

#: The fields of a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(*fields: Column) -> Column:
    """H of the fields, each with its UTF-8 length before it."""
    told = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in told])


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def build(leaves: DataFrame, work: Work, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels of a forest, and its roots.

    leaves: (tree long, idx long, n long, digest), idx from 0 to n - 1 in each tree. A level is (tree, idx, n, digest,
    children): the nodes of one height with the digests of their children, n being the tree's nodes at this height.
    roots: (tree, digest).
    """
    levels, roots, now = [], [leaves.where("n = 1").select("tree", "digest")], leaves.where("n > 1").select("tree", "idx", "n", "digest")
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        run = now.groupBy("tree", F.expr(f"idx div {arity}").alias("idx"), F.expr(f"(n - 1) div {arity} + 1").alias("n")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("children"))
        level = work.write(run.select("tree", "idx", "n", F.col("children.digest").alias("children")).select("tree", "idx", "n", digest(_joined(F.col("children"))).alias("digest"), "children"))
        levels.append(level)
        roots.append(level.where("n = 1").select("tree", "digest"))
        now, most = level.where("n > 1").select("tree", "idx", "n", "digest"), (most - 1) // arity + 1
    return levels, reduce(DataFrame.unionByName, roots)


def _step(children: Column, place: Column) -> Column:
    """The siblings of the child at that place: those before it and those after it."""
    return F.struct(F.slice(children, F.lit(1), place.cast("int")).alias("before"), F.slice(children, place.cast("int") + 2, F.size(children)).alias("after"))


def push(levels: list[DataFrame], inherited: DataFrame, work: Work, arity: int) -> DataFrame | None:
    """(tree, idx, children, proof, ...) of the nodes just above the leaves; None where all trees are single leaves.

    inherited: (tree, proof, ...): the suffix that each root gets, and what else its leaves are to know.
    """
    given = None
    for level in reversed(levels):
        nodes = level.select("tree", "idx", "children", "n")
        top = nodes.where("n = 1").drop("n").join(inherited, "tree")
        if given is not None:
            below = nodes.where("n > 1").select("tree", F.expr(f"idx div {arity}").alias("_up"), F.expr(f"idx % {arity}").alias("_place"), "idx", "children")
            parents = given.withColumnsRenamed({"idx": "_up", "children": "_run"})
            below = below.join(parents, ["tree", "_up"]).withColumn("proof", F.concat(F.array(_step(F.col("_run"), F.col("_place"))), F.col("proof"))).drop("_up", "_place", "_run")
            top = top.unionByName(below)
        given = work.write(top) if level is not levels[0] else top
    return given


def attach(leaves: DataFrame, levels: list[DataFrame], inherited: DataFrame, work: Work, arity: int) -> DataFrame:
    """The leaves with their whole proof, and what their root has inherited besides."""
    alone = leaves.where("n = 1").join(inherited, "tree")
    above = push(levels, inherited, work, arity)
    if above is None:
        return alone
    above = above.withColumnsRenamed({"idx": "_up", "children": "_run"})
    found = leaves.where("n > 1").withColumn("_up", F.expr(f"idx div {arity}")).join(above, ["tree", "_up"])
    return alone.unionByName(found.withColumn("proof", F.concat(F.array(_step(F.col("_run"), F.expr(f"idx % {arity}"))), F.col("proof"))).drop("_up", "_run"))


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda at, s: digest(_joined(s["before"]), at, _joined(s["after"])))


def proof_digest(proof: Column) -> Column:
    """H of the siblings from the leaf's level up to the root's, left to right in each."""
    return digest(_joined(F.transform(proof, lambda s: F.concat(_joined(s["before"]), _joined(s["after"])))))


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, claimed: Column | None = None, arity: int = 2, work: Work | None = None) -> DataFrame:
    """(key, leaf, claimed, subroot, root, proof) for each row: its leaf, the leaf that a holder of the row claims, and its proof.

    Leaves ascend by key within their group; every `arity` consecutive nodes become one, until one is left, the group's
    subroot; subroots in order of the group likewise become the root. proof is an array of steps from the leaf to the
    root, each with the siblings before and after. claimed is an expression over the row, the leaf itself by default:
    fold(claimed, proof) is the root that it leads to.
    """
    work = work or Work(docs.sparkSession)
    own = leaf(*[F.col(f) for f in fields])
    told = F.when(claimed.eqNullSafe(own), None).otherwise(claimed) if claimed is not None else F.lit(None).cast("string")
    rows = docs.select(F.col(key).alias("_key"), F.col(group).cast("string").alias("_group"), own.alias("leaf"), told.alias("_claimed"))
    placed = ordered.positions(rows, [F.col("_key").asc_nulls_first(), F.col("leaf").asc()], ["_group"], "idx", write=work.write)
    groups = ordered.positions(placed.groupBy("_group").agg(F.count("*").alias("n")), [F.col("_group").asc_nulls_first()], name="tree", write=work.write)
    groups = work.write(groups)
    named = groups.select(F.col("_group").alias("_named"), "tree", "n")
    leaves = work.write(placed.join(named, F.col("_group").eqNullSafe(F.col("_named"))).select("tree", "idx", "n", F.col("leaf").alias("digest"), F.col("_key").alias(key), "_claimed"))
    levels, subroots = build(leaves, work, arity)

    upper = work.write(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(groups.count()).cast("long").alias("n"), "digest"))
    upper_levels, root = build(upper, work, arity)
    step = "array<struct<before:array<string>,after:array<string>>>"
    none = root.select("tree", F.col("digest").alias("root"), F.array().cast(step).alias("proof"))
    inherited = attach(upper, upper_levels, none, work, arity).select(F.col("idx").alias("tree"), F.col("digest").alias("subroot"), "root", "proof")
    got = attach(leaves, levels, work.write(inherited), work, arity)
    return got.select(key, F.col("digest").alias("leaf"), F.coalesce("_claimed", "digest").alias("claimed"), "subroot", "root", "proof")


def verify(rows: DataFrame) -> DataFrame:
    """Adds folded_root, what the claimed leaf leads to, and verified, whether that is the root."""
    folded = rows.withColumn("folded_root", fold(F.col("claimed"), F.col("proof")))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
