"""Operator 10, embedding near-duplicates by lattice hashing.

Vectors are compared inside a label.  In each of several tables a vector falls into the cell of the
E8 lattice points nearest to its random projections, and probes neighbouring cells.

1. ``_balls``: hot groups first.  The least id of every cell leads it; a vector at most half the
   linking angle from a leader that is near no lesser leader joins that leader's ball.  By the triangle
   inequality all vectors of a ball are linked, so their links are counted, never listed.
2. ``_ball_pairs``: balls meet where a member's own cell is another's own or probed cell.  Cells hold
   a ball once, so a cell of a hot group is one row.
3. The angle between two centres decides most pairs of balls: all members linked, or none.  Members
   of the others are compared one by one.  Every cosine is taken in double precision.
4. Components are those of the balls; a component is named by its least vector id.

Recall rests on 3.'s candidates only; the tables' parameters reach well over 0.99 at the threshold
(tests measure it against brute force).  No pair below the threshold is linked.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors
with a null label or id, have no links and their own id as component; vectors of different lengths are
not compared; rows repeating an id count as the least of them; an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glazier.llm.common import batch_of, column, longs, read_table, stored
from glazier.llm.components import components
from glazier.llm.lattice import LatticeTables

TABLES, BLOCKS, SCALE, PROBES = 8, 2, 0.6, 16
ROUNDING = 1e-9  # angles within this of a bound are decided by the members' cosines


def _vectors(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    col = column(batch, name)
    flat, ends = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _matrices(batch: pa.RecordBatch, names: tuple[str, ...]):
    """Rows of equal vector length with their matrices, at most 2048 rows at once."""
    sides = [_vectors(batch, n) for n in names]
    lengths = np.array([len(v) for v in sides[0]])
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        for at in range(0, len(rows), 2048):
            some = rows[at:at + 2048]
            yield int(dim), some, [np.stack([side[i] for i in some]) for side in sides]


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def _comparable(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, grp, v) of the vectors that can have links; ``v`` scaled by its largest component."""
    v = F.col(embedding).cast("array<double>")
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    return (vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), v.alias("v"))
            .filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0))
            .filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))))
            .withColumn("top", top).filter("top > 0")
            .select("vec_id", F.xxhash64("label", F.size("v")).alias("grp"),
                    F.transform("v", lambda x: x / F.col("top")).alias("v")))


def _cells(comparable: DataFrame, tables: int, blocks: int, scale: float, probes: int, seed: int) -> DataFrame:
    """(vec_id, grp, place, cell, own): own and probed cells; ``place`` is the table."""
    schema = pa.schema([("vec_id", pa.int64()), ("grp", pa.int64()), ("place", pa.int32()), ("cell", pa.int64()),
                        ("own", pa.bool_())])

    def hash_vectors(batches):
        hashers: dict[int, LatticeTables] = {}
        for batch in batches:
            ids, grps = longs(batch, "vec_id"), longs(batch, "grp")
            for dim, rows, (x,) in _matrices(batch, ("v",)):
                if dim not in hashers:
                    hashers[dim] = LatticeTables(dim, tables, blocks, scale, probes, seed)
                unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
                own, probed = hashers[dim].keys(unit)
                cell = np.concatenate([own[:, :, None], probed], axis=2)
                n, width = len(rows), 1 + probes
                yield batch_of(schema, np.repeat(ids[rows], tables * width), np.repeat(grps[rows], tables * width),
                               np.tile(np.repeat(np.arange(tables, dtype=np.int32), width), n), cell.ravel(),
                               np.tile(np.arange(width) == 0, n * tables))

    return stored(comparable.mapInArrow(hash_vectors, "vec_id long, grp long, place int, cell long, own boolean"), "e8-cells")


def _angles(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and the cosine of the columns va and vb."""
    kinds = pairs.select(*keep).schema.add("cosine", "double")

    def measure(batches):
        for batch in batches:
            cosine = np.empty(batch.num_rows)
            for _, rows, (a, b) in _matrices(batch, ("va", "vb")):
                cosine[rows] = _cosines(a, b)
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in keep], pa.array(cosine)], [*keep, "cosine"])

    return pairs.mapInArrow(measure, kinds)


def _balls(comparable: DataFrame, cells: DataFrame, angle: float) -> DataFrame:
    """(vec_id, ball, turn): every vector's ball, named by its centre, and the angle to the centre."""
    own = cells.filter("own").select("vec_id", "grp", "place", "cell")
    leaders = own.groupBy("grp", "place", "cell").agg(F.min("vec_id").alias("leader"))
    asked = own.join(leaders, ["grp", "place", "cell"]).filter("leader <> vec_id").select("vec_id", "leader").distinct()
    vectors = comparable.select("vec_id", "v")
    pairs = (asked.join(vectors.withColumnRenamed("v", "va"), "vec_id")
             .join(vectors.select(F.col("vec_id").alias("leader"), F.col("v").alias("vb")), "leader")
             .select("vec_id", "leader", "va", "vb"))
    near = stored(_angles(pairs, ["vec_id", "leader"])
                  .withColumn("turn", F.acos(F.least(F.lit(1.0), F.col("cosine"))) + ROUNDING)
                  .filter(F.col("turn") <= angle / 2 - 2 * ROUNDING), "e8-near")
    # A leader near a lesser leader leads no ball.
    centres = near.select("leader").distinct().join(near.select(F.col("vec_id").alias("leader")), "leader", "left_anti")
    chosen = (near.join(centres, "leader", "left_semi").groupBy("vec_id")
              .agg(F.min_by(F.struct("leader", "turn"), F.struct("leader", "turn")).alias("b"))
              .select("vec_id", F.col("b.leader").alias("ball"), F.col("b.turn").alias("turn")))
    return stored(comparable.select("vec_id").join(chosen, "vec_id", "left").select(
        "vec_id", F.coalesce("ball", "vec_id").alias("ball"), F.coalesce("turn", F.lit(0.0)).alias("turn")), "e8-balls")


def _ball_pairs(cells: DataFrame, balls: DataFrame) -> DataFrame:
    """Distinct pairs of balls (a < b) that meet in a cell one of them owns."""
    dealt = (cells.join(balls.select("vec_id", "ball"), "vec_id")
             .groupBy("grp", "place", "cell", "ball").agg(F.max("own").alias("own")))
    visits = dealt.select("grp", "place", "cell", F.col("ball").alias("other"))
    return (dealt.filter("own").join(visits, ["grp", "place", "cell"]).filter("ball <> other")
            .select(F.least("ball", "other").alias("a"), F.greatest("ball", "other").alias("b")).distinct())


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding",
                    label: str = "label", tables: int = TABLES, blocks: int = BLOCKS, scale: float = SCALE,
                    probes: int = PROBES, seed: int = 20) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector; of rows with one vec_id the least by label, then
    embedding, nulls first, counts."""
    rows = vectors.select(vec_id, embedding, label)
    least = rows.filter(F.col(vec_id).isNotNull()).groupBy(vec_id).agg(F.min(F.struct(label, embedding)).alias("row"))
    rows = least.select(vec_id, f"row.{embedding}", f"row.{label}").union(rows.filter(F.col(vec_id).isNull()))
    comparable = stored(_comparable(rows, vec_id, embedding, label), "e8-vectors")
    angle = math.acos(threshold)
    cells = _cells(comparable, tables, blocks, scale, probes, seed)
    balls = _balls(comparable, cells, angle)
    sizes = balls.groupBy("ball").agg(F.count(F.lit(1)).alias("members"), F.max("turn").alias("radius"))
    about = stored(sizes.join(comparable.select(F.col("vec_id").alias("ball"), "v"), "ball"), "e8-about")

    def side(of: str) -> DataFrame:
        return about.select(F.col("ball").alias(of), F.col("members").alias(f"m{of}"), F.col("radius").alias(f"r{of}"),
                            F.col("v").alias(f"v{of}"))

    met = _angles(_ball_pairs(cells, balls).join(side("a"), "a").join(side("b"), "b"), ["a", "b", "ma", "mb", "ra", "rb"])
    turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cosine"))))
    reach = F.col("ra") + F.col("rb")
    alone = (F.col("ma") == 1) & (F.col("mb") == 1)
    judged = stored(met.withColumn("linked", F.when(alone, F.col("cosine") >= threshold)
                                   .when(turn + reach <= angle - ROUNDING, F.lit(True))
                                   .when(turn - reach > angle + ROUNDING, F.lit(False)))
                    .filter("linked is null or linked").select("a", "b", "ma", "mb", "linked"), "e8-judged")
    sure = judged.filter("linked")
    by_ball = (sure.select(F.col("a").alias("ball"), F.col("mb").alias("n")).union(sure.select("b", "ma"))
               .groupBy("ball").agg(F.sum("n").alias("n_ball")))
    members = balls.join(comparable.select("vec_id", "v"), "vec_id").select("ball", "vec_id", "v")
    unsure = (judged.filter("linked is null").select("a", "b")
              .join(members.select(F.col("ball").alias("a"), F.col("vec_id").alias("x"), F.col("v").alias("va")), "a")
              .join(members.select(F.col("ball").alias("b"), F.col("vec_id").alias("y"), F.col("v").alias("vb")), "b"))
    single = stored(_angles(unsure, ["a", "b", "x", "y"]).filter(F.col("cosine") >= threshold).drop("cosine"), "e8-single")
    by_vector = (single.select(F.col("x").alias("vec_id")).union(single.select("y")).groupBy("vec_id")
                 .agg(F.count(F.lit(1)).alias("n_single")))
    parts = components(sure.select("a", "b").union(single.select("a", "b").distinct()), "a", "b")
    placed = balls.join(parts.withColumnRenamed("id", "ball"), "ball", "left").select(
        "vec_id", "ball", F.coalesce("component", "ball").alias("component"))
    least = placed.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    linked = (placed.join(least, "component").join(sizes.select("ball", "members"), "ball").join(by_ball, "ball", "left")
              .join(by_vector, "vec_id", "left")
              .select("vec_id", "component_id", (F.col("members") - 1 + F.coalesce("n_ball", F.lit(0))
                                                 + F.coalesce("n_single", F.lit(0))).cast("long").alias("n_links")))
    out = rows.select(F.col(vec_id).cast("long").alias("vec_id")).join(linked, "vec_id", "left")
    named = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), named.alias("component_id"),
                      F.coalesce(F.col("vec_id") == named, F.lit(True)).alias("kept"))


def op10_e8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.93."""
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
