"""Operator 11, hard-negative mining with rotated one-bit codes.

Vectors are scaled to integers (floor(256 * x)).  A row stores, for ``LEVELS`` fixed random rotations one after
the other, the signs of its rotated rest as a bit code, the rest's alignment with that code vector (its
component along it), and the length of what is left after the last.  So

    row = a_1 c_1 + ... + a_L c_L + rest,

and the inner product of an anchor with a code vector is a popcount: the rotated anchor is rounded to
``PLANES`` bit planes, whose bits are counted under the code.  By Cauchy-Schwarz the rest changes the product by
|anchor| * |rest| at most, and the rounding by a known length: that gives an interval which holds the score
for certain.  Only rows whose interval reaches the scores asked for are scored in integers.

1. Rows are prepared once, in a narrow pass, and stored in blocks of a bounded number of rows.
2. Every block of anchors meets every block of rows (the anchors are a stated query set).  First the rows of the
   anchor's label: the best ``positives`` of each block by exact score, where the threshold is the score of
   the best-estimated ones; then, with the positives known, the rows of other labels whose interval meets
   [``low`` %, ``high`` %] of a positive's score.
3. The blocks' best are merged by rank.  A block returns ``positives`` or ``negatives`` rows an anchor and positive,
   so nothing grows with the number of near rows; no label or hot key is a group.

Blocks hold at most ``BLOCK_ROWS`` rows and ``BLOCK_ANCHORS`` anchors at every input size, and fewer where that leaves
tasks idle; a row is dealt once for every block of anchors.

Defined cases: rows without vec_id, label or vector, with a null or non-finite component, or with a component
beyond +-2**25 once scaled (not scored in 64 bits) take no part; rows with one vec_id count once (least label, then
least vector); vectors of another dimension are not compared; empty vectors have score 0; ties go to the
smaller vec_id; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glazier.llm.common import column, longs, read_table, stored, tasks

LEVELS = 4
PLANES = 8
SCALE = 256
MOST = 2**25            # components beyond are not scored: products of 8,192 dimensions stay within 64 bits
BLOCK_ROWS = 65_536
BLOCK_ANCHORS = 8_192
LEAST_ROWS = 2_048      # a block of rows is not made smaller than this for the sake of idle tasks
_AT_ONCE = 32           # anchors estimated in one step: bounds the matrix of estimates


@lru_cache(maxsize=4)
def rotations(width: int) -> np.ndarray:
    """``LEVELS`` fixed random orthogonal matrices of ``width``."""
    draw = np.random.default_rng(20_11)
    return np.stack([np.linalg.qr(draw.standard_normal((width, width)))[0] for _ in range(LEVELS)])


def _width(dim: int) -> int:
    return max(64, -(-dim // 64) * 64)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows, level, words), alignments (rows, level) and rest lengths of integer vectors."""
    rows, dim = vectors.shape
    width = _width(dim)
    rest = np.zeros((rows, width))
    rest[:, :dim] = vectors
    codes, aligned = np.zeros((rows, LEVELS, width // 64), np.uint64), np.zeros((rows, LEVELS))
    for level, turn in enumerate(rotations(width)):
        turned = rest @ turn
        bits = turned > 0
        codes[:, level] = np.packbits(bits, axis=1, bitorder="little").view("<u8")
        signs = np.where(bits, 1.0, -1.0) / np.sqrt(width)
        aligned[:, level] = (turned * signs).sum(1)
        rest -= (aligned[:, level, None] * signs) @ turn.T
    return codes, aligned, np.linalg.norm(rest, axis=1)


def interval(anchors: np.ndarray, codes: np.ndarray, aligned: np.ndarray, rest: np.ndarray, lengths: np.ndarray):
    """(estimate, half width) of the scores of all anchors (integer vectors) with all coded rows; ``lengths``: norms
    of the rows."""
    width = codes.shape[2] * 64
    query = np.zeros((len(anchors), width))
    query[:, :anchors.shape[1]] = anchors
    norm = np.linalg.norm(query, axis=1)
    estimate = np.zeros((len(anchors), len(codes)))
    slack = norm[:, None] * rest
    for level, turn in enumerate(rotations(width)):
        turned = query @ turn
        low = turned.min(1, keepdims=True)
        step = np.maximum((turned.max(1, keepdims=True) - low) / (2**PLANES - 1), 1e-300)
        rounded = np.rint((turned - low) / step)
        off = np.linalg.norm(turned - (low + step * rounded), axis=1)
        planes = np.stack([np.packbits((rounded.astype(np.int64) >> j & 1).astype(bool), axis=1, bitorder="little").view("<u8")
                           for j in range(PLANES)], 1)
        ones = np.bitwise_count(codes[:, level]).sum(1, dtype=np.int64)
        whole = (low * width + step * rounded.sum(1, keepdims=True))[:, 0]
        for q in range(len(anchors)):
            counted = np.zeros(len(codes), np.int64)
            for word in range(codes.shape[2]):
                code = np.ascontiguousarray(codes[:, level, word])
                for j in range(PLANES):
                    if planes[q, j, word]:
                        counted += np.bitwise_count(code & planes[q, j, word]).astype(np.int64) << j
            product = (2 * (step[q] * counted + low[q] * ones) - whole[q]) / np.sqrt(width)
            estimate[q] += aligned[:, level] * product
        slack += off[:, None] * np.abs(aligned[:, level])
    # Rounding of the doubles above stays far below this share of the norms.
    return estimate, slack + 1e-9 * (1 + norm[:, None] * lengths)


# --- preparation -----------------------------------------------------------------------------------

PREPARED = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("dim", T.IntegerType()),
    T.StructField("vector", T.BinaryType()), T.StructField("codes", T.BinaryType()), T.StructField("aligned", T.BinaryType())])


def prepare(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, label, embedding) that take part, as integers with their codes."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= MOST / SCALE))
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("int"),
                       F.col("embedding").cast("array<double>")).filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    once = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", "row.*")

    def code(batches):
        for batch in batches:
            lists = column(batch, "embedding")
            cuts = lists.offsets.to_numpy()
            flat = np.floor(lists.values.to_numpy(zero_copy_only=False) * SCALE).astype(np.int64)
            dims = np.diff(cuts)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                vectors = flat[cuts[at][:, None] + np.arange(dim)]
                codes, aligned, rest = encode(vectors)
                tail = np.concatenate([aligned, rest[:, None]], 1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(longs(batch, "vec_id")[at]), pa.array(longs(batch, "label")[at], pa.int32()),
                    pa.array(np.full(len(at), dim), pa.int32()), *(pa.array([r.tobytes() for r in part], pa.binary())
                                                                   for part in (vectors.astype("<i4"), codes, tail))],
                    names=PREPARED.names)

    return once.mapInArrow(code, PREPARED)


def _unpack(table: pa.Table, dim: int):
    """ids, labels, integer vectors, codes, alignments and rest lengths of a group's rows, by vec_id."""
    table = table.sort_by("vec_id")
    n = table.num_rows
    joined = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
    tail = joined("aligned", "<f8").reshape(n, LEVELS + 1)
    return (table["vec_id"].to_numpy(), table["label"].to_numpy(),
            joined("vector", "<i4").reshape(n, dim).astype(np.int64),
            joined("codes", "<u8").reshape(n, LEVELS, -1), tail[:, :LEVELS], tail[:, LEVELS])


def _best(ids: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` by falling score, then id."""
    if len(scores) > 4 * most:
        kept = np.flatnonzero(scores >= np.partition(scores, -most)[-most])
        return kept[np.lexsort((ids[kept], -scores[kept]))][:most]
    return np.lexsort((ids, -scores))[:most]


def _top(values: np.ndarray, most: int) -> np.ndarray:
    return np.arange(len(values)) if len(values) <= most else np.argpartition(values, -most)[-most:]


def _block_positives(anchors, rows, most: int):
    """The best rows of an anchor's label in one block: (anchor, row, score) places and scores."""
    a_ids, a_labels, a_vectors = anchors[:3]
    r_ids, r_labels, r_vectors = rows[:3]
    lengths = np.linalg.norm(r_vectors.astype(float), axis=1)
    for label in np.intersect1d(a_labels, r_labels).tolist():
        mine, held = np.flatnonzero(a_labels == label), np.flatnonzero(r_labels == label)
        coded = [part[held] for part in rows[3:]]
        vectors, ids = r_vectors[held], r_ids[held]
        for at in range(0, len(mine), _AT_ONCE):
            some = mine[at:at + _AT_ONCE]
            estimate, slack = interval(a_vectors[some], *coded, lengths[held])
            for q, (e, s) in zip(some.tolist(), zip(estimate, slack)):
                other = ids != a_ids[q]
                e = np.where(other, e, -np.inf)
                first = _top(e, most)
                first = first[other[first]]
                if len(first) == most:
                    worst = (vectors[first] @ a_vectors[q]).min()
                    places = np.flatnonzero(e + s >= worst)
                else:
                    places = np.flatnonzero(other)
                scores = vectors[places] @ a_vectors[q]
                best = _best(ids[places], scores, most)
                yield q, held[places[best]], scores[best]


def _block_negatives(anchors, goals: list, rows, most: int, low: int, high: int):
    """For every anchor and goal (a positive's score), the best rows of other labels in one block with scores from low
    to high per cent of the goal."""
    a_ids, a_labels, a_vectors = anchors[:3]
    r_ids, r_labels, r_vectors = rows[:3]
    lengths = np.linalg.norm(r_vectors.astype(float), axis=1)
    for at in range(0, len(a_ids), _AT_ONCE):
        estimate, slack = interval(a_vectors[at:at + _AT_ONCE], *rows[3:], lengths)
        for q, (e, s) in enumerate(zip(estimate, slack), at):
            other = r_labels != a_labels[q]
            lower, upper = np.where(other, e - s, np.inf), np.where(other, e + s, -np.inf)
            scored: dict[tuple[int, int], tuple] = {}
            for rank, goal in enumerate(goals[q]):
                least, greatest = -(-low * goal // 100), high * goal // 100
                if least > greatest:
                    continue
                if (least, greatest) not in scored:
                    # Rows inside for certain, the best-estimated first: their scores raise the threshold.
                    inside = np.flatnonzero((lower >= least) & (upper <= greatest))
                    floor = least
                    if len(inside) >= most:
                        first = inside[_top(e[inside], most)]
                        floor = max(least, int((r_vectors[first] @ a_vectors[q]).min()))
                    places = np.flatnonzero((upper >= floor) & (lower <= greatest))
                    scores = r_vectors[places] @ a_vectors[q]
                    fits = (scores >= least) & (scores <= greatest)
                    places, scores = places[fits], scores[fits]
                    best = _best(r_ids[places], scores, most)
                    scored[least, greatest] = places[best], scores[best]
                yield q, rank, *scored[least, greatest]


# --- the operator -----------------------------------------------------------------------------------

def _dealt(rows: DataFrame, blocks: int, key: str, copies: int, other: str) -> DataFrame:
    """``rows`` in ``blocks`` by vec_id, once for every block of the other side."""
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    return rows.withColumn(key, block).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))


def _first_ranks(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= most)


def mine_hard_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5,
                        low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors, the rows whose vec_id is
    divisible by ``every``.  ``rows``: vec_id, label, embedding."""
    spark = rows.sparkSession
    ready = stored(prepare(rows), "coded")
    anchors = ready.filter(F.col("vec_id") % every == 0).select("vec_id", "label", "dim", "vector", "codes", "aligned")
    n_rows, n_anchors = ready.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first()
    per_block = min(BLOCK_ROWS, max(LEAST_ROWS, n_rows // (2 * tasks(spark))))
    row_blocks, anchor_blocks = max(1, -(-n_rows // per_block)), max(1, -(-n_anchors // BLOCK_ANCHORS))
    keys = ["anchor_block", "row_block", "dim"]
    held = _dealt(ready.toDF(*ready.columns), row_blocks, "row_block", anchor_blocks, "anchor_block").groupBy(*keys)

    near = T.StructType([T.StructField(n, T.LongType()) for n in ("anchor_id", "vec_id", "score")])

    def find_positives(key, a: pa.Table, r: pa.Table) -> pa.Table:
        found = {n: [] for n in near.names}
        if a.num_rows and r.num_rows:
            a, r = _unpack(a, key[2].as_py()), _unpack(r, key[2].as_py())
            for q, places, scores in _block_positives(a, r, positives):
                found["anchor_id"] += [int(a[0][q])] * len(places)
                found["vec_id"] += r[0][places].tolist()
                found["score"] += scores.tolist()
        return pa.table(found, pa.schema([(n, pa.int64()) for n in near.names]))

    dealt = _dealt(anchors, anchor_blocks, "anchor_block", row_blocks, "row_block").groupBy(*keys)
    best = _first_ranks(dealt.cogroup(held).applyInArrow(find_positives, near), ["anchor_id"],
                        [F.desc("score"), F.asc("vec_id")], positives)
    best = stored(best.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
                              F.col("rank").alias("place")), "positives")

    goals = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("goals"))
    hard = T.StructType([*near.fields, T.StructField("place", T.IntegerType())])

    def find_negatives(key, a: pa.Table, r: pa.Table) -> pa.Table:
        found = {n: [] for n in hard.names}
        if a.num_rows and r.num_rows:
            a, r = a.sort_by("vec_id"), _unpack(r, key[2].as_py())
            goals, a = a["goals"].to_pylist(), _unpack(a, key[2].as_py())
            for q, rank, places, scores in _block_negatives(a, goals, r, negatives, low, high):
                found["anchor_id"] += [int(a[0][q])] * len(places)
                found["vec_id"] += r[0][places].tolist()
                found["score"] += scores.tolist()
                found["place"] += [rank + 1] * len(places)
        return pa.table(found, pa.schema([(n, pa.int64()) for n in near.names] + [("place", pa.int32())]))

    dealt = _dealt(anchors.join(goals, "vec_id"), anchor_blocks, "anchor_block", row_blocks, "row_block").groupBy(*keys)
    mined = _first_ranks(dealt.cogroup(held).applyInArrow(find_negatives, hard), ["anchor_id", "place"],
                         [F.desc("score"), F.asc("vec_id")], negatives)
    return mined.join(best, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def relabelled(rows: DataFrame) -> DataFrame:
    """``rows`` with label (label + 1) mod 10 where vec_id is divisible by 7."""
    label = F.col("label").cast("long")
    return rows.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
                       .cast("int").alias("label"))


def op11_onebit_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every 100th vector, against all vectors."""
    return mine_hard_negatives(relabelled(read_table(spark, sf_dir, "embeddings")))


ORACLE_SQL = """
WITH valid AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM valid a JOIN valid b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
negatives AS (
    SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
           CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
    FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
    WHERE 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5
"""
