"""Operator 12, periodic runs of words found with string synchronising sets.

A run is a stretch of words with smallest period p, of at least ``min_length`` words and three periods, that no
neighbouring word extends.  A group of texts is one array of word numbers with a separator of its own after
every text, longest texts first, so that a scale works on the front of the array only.

1. Hashes of all stretches of 1, 2, 4, ... words are built by doubling.
2. Periods 1 to 5 are detected directly, by comparing the array with itself.
3. At scale t = 4, 8, 16, ... a position is chosen where the least hash of the stretches of t words that
   start within t words of it lies at its own or its last stretch, stretches of a period up to t / 3 left out
   (those lie in the runs of smaller scales).  The choice depends on 2 t words only, so the same words choose
   the same places wherever they stand.
4. Chosen positions with equal 2 t words at a distance from (3 t - 1) / 2 to 3 t propose that distance as a
   period.  A run of such a period p holds a stretch of 3 t - 1 words without a period up to t / 3 that starts
   2 p - 3 t + 1 words from its start at most (else its first 2 p words had that period, and p were not its smallest), so
   it has a chosen position whose copy one period later lies in it as well: no run is missed.  Equal
   contexts are more than t / 3 apart, so a position meets at most nine others.
5. A proposal is extended both ways by binary search over the hashes.  Proposals of one stretch keep the
   smallest period.  Every returned run is compared word by word; should two hashes have met, the group is
   done again with another seed.

The pass is narrow: nothing is shuffled, and a text is never cut.  Work and memory grow with n log n of a
group of about ``GROUP_BYTES`` or of the longest text.

Defined cases: words are maximal stretches of bytes other than 0x20 and 0x09 to 0x0D; a null or empty text has no
words and no runs and collapses to ""; repeated rows are treated each; a null doc_id is kept (and the
query leaves that text as it is); an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glazier.llm.common import column, mix64, read_table, text_or_empty

MIN_LENGTH = 24
PERIODS = 3             # periods a run holds at least; the choice of scales rests on three
DIRECT = 5              # periods detected directly; scale 4 starts at 6
GROUP_BYTES = 2 << 20
_NEVER = np.uint64(2**64 - 1)


def _hashes(x: np.ndarray, fronts, seed: int) -> list[np.ndarray]:
    """Hash of the 2**k words from every position, for every k; ``fronts(n)``: end of the texts of n words or more."""
    levels = [mix64(x.astype(np.uint64) + np.uint64(seed))]
    width = 1
    while (end := fronts(2 * width)) > 0:
        h = levels[-1][:end]
        levels.append(mix64(h[:-width] * np.uint64(0x9E3779B97F4A7C15) + h[width:]))
        width *= 2
    return levels


def _equal(h: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the stretches at i and at j (j > i) have one hash; places outside have none."""
    inside = (i >= 0) & (j < len(h))
    return inside & (h[np.where(inside, i, 0)] == h[np.where(inside, j, 0)])


def _extend(levels: list[np.ndarray], at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the longest stretch around ``at`` where words ``period`` apart are identical."""
    left, right = at.copy(), at.copy()
    for k in reversed(range(len(levels))):
        width = 1 << k
        right += np.where(_equal(levels[k], right, right + period), width, 0)
        left -= np.where(_equal(levels[k], left - width, left - width + period), width, 0)
    return left, right + period


def _direct(x: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    same = np.zeros(len(x) + 2, np.int8)
    same[1:len(x) - period + 1] = x[:-period] == x[period:]
    turns = np.flatnonzero(np.diff(same))
    start, end = turns[::2], turns[1::2] + period
    long = end - start >= PERIODS * period
    return start[long], end[long]


def _proposals(levels: list[np.ndarray], k: int, end: int, low: int, high: int, runs) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) pairs of scale 2**k, one at least for every stretch of a proposed period."""
    scale = 1 << k
    own = np.minimum(levels[k][:end - scale + 1], _NEVER - np.uint64(1))
    periodic = np.zeros(len(own) + 1, np.int32)
    for start, stop, period in runs:
        inner = (period <= scale // PERIODS) & (stop - start >= scale) & (stop <= end)
        np.add.at(periodic, start[inner], 1)
        np.add.at(periodic, stop[inner] - scale + 1, -1)
    own[np.cumsum(periodic[:-1]) > 0] = _NEVER
    least = own
    for j in range(k):
        least = np.minimum(least[:-(1 << j)], least[1 << j:])
    least = np.minimum(least[:-1], least[1:])  # of own[i], ..., own[i + scale]
    chosen = np.flatnonzero((least != _NEVER) & ((least == own[:len(least)]) | (least == own[scale:scale + len(least)])))
    context = levels[k + 1][chosen]
    order = np.argsort(context, kind="stable")
    context, place = context[order], chosen[order]
    at, period, step = [], [], 1
    while step < len(place):
        gap = place[step:] - place[:-step]
        near = (context[step:] == context[:-step]) & (gap < high)
        if not near.any():
            break
        near &= gap >= low
        at.append(place[:-step][near])
        period.append(gap[near])
        step += 1
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, period = np.concatenate(at), np.concatenate(period)
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    # Contexts that touch share their stretch: the first of them is enough.
    first = np.concatenate([[True], (np.diff(period) != 0) | (np.diff(at) > 2 * scale)]) if len(at) else np.zeros(0, bool)
    return at[first], period[first]


def find_runs(x: np.ndarray, sizes: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of all runs of ``x``, by start, then period.

    ``x``: texts of falling ``sizes`` one after the other, a word that occurs nowhere else after each."""
    ends = np.cumsum(sizes + 1)

    def fronts(n: int) -> int:
        held = int(np.searchsorted(-sizes, -n, "right"))
        return int(ends[held - 1]) if held else 0

    seed = 0
    while True:
        found = []
        for period in range(1, DIRECT + 1):
            if (end := fronts(PERIODS * period)) > period:
                start, stop = _direct(x[:end], period)
                found.append((start, stop, np.full(len(start), period)))
        levels = _hashes(x, fronts, seed)
        k = 2
        while True:
            scale = 1 << k
            low, high = (PERIODS * scale) // 2, PERIODS * scale
            end = fronts(PERIODS * low)
            if not end:
                break
            at, period = _proposals(levels, k, end, low, high, found)
            start, stop = _extend(levels, at, period)
            long = stop - start >= PERIODS * period
            found.append((start[long], stop[long], period[long]))
            k += 1
        if not found:
            return (np.zeros(0, np.int64),) * 3
        start, stop, period = (np.concatenate(v).astype(np.int64) for v in zip(*found))
        long = stop - start >= min_length
        start, stop, period = start[long], stop[long], period[long]
        order = np.lexsort((period, stop, start))
        start, stop, period = start[order], stop[order], period[order]
        first = np.concatenate([[True], (np.diff(start) != 0) | (np.diff(stop) != 0)]) if len(start) else np.zeros(0, bool)
        start, stop, period = start[first], stop[first], period[first]
        if all(np.array_equal(x[a:b - p], x[a + p:b]) for a, b, p in zip(start.tolist(), stop.tolist(), period.tolist())):
            order = np.lexsort((period, start))
            return start[order], stop[order], period[order]
        seed += 1


def runs_of_texts(texts: list[list[bytes]], min_length: int = MIN_LENGTH) -> list[np.ndarray]:
    """For every text (a list of words) its runs as rows of (start, length, period)."""
    numbers: dict[bytes, int] = {}
    number = numbers.setdefault
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    x = np.empty(int((sizes + 1).sum()), np.int64)
    for at, size, i in zip(starts.tolist(), sizes.tolist(), order):
        x[at:at + size] = [number(w, len(numbers)) for w in texts[i]]
        x[at + size] = -1 - i
    start, stop, period = find_runs(x, sizes, min_length)
    text = np.searchsorted(starts, start, "right") - 1
    rows = np.stack([start - starts[text], stop - start, period], 1) if len(start) else np.zeros((0, 3), np.int64)
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    out = [rows[:0]] * len(texts)
    for j, i in enumerate(order):
        out[i] = rows[cuts[j]:cuts[j + 1]]
    return out


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words left when every run keeps its first period only, joined by one space."""
    if len(runs):
        covered = np.zeros(len(words) + 1, np.int32)
        np.add.at(covered, runs[:, 0] + runs[:, 2], 1)
        np.add.at(covered, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(covered[:-1]) == 0).tolist()]
    return b" ".join(words)


_RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
RUNS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
                     T.StructField("runs", T.ArrayType(_RUN, False)), T.StructField("collapsed", T.StringType())])


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``docs`` (doc_id, text)."""
    names = [f.name for f in _RUN]
    run = pa.struct([pa.field(n, pa.int64(), False) for n in names])
    kinds = pa.list_(pa.field("element", run, False))

    def detect(batches):
        for batch in batches:
            doc_ids, texts = column(batch, "doc_id"), column(batch, "text")
            at = 0
            while at < len(texts):
                words, size, first = [], 0, at
                while at < len(texts) and size < GROUP_BYTES:
                    text = texts[at].as_py().encode()
                    words.append(text.split())  # ASCII white space: 0x20 and 0x09 to 0x0D
                    size, at = size + len(text) + 1, at + 1
                runs = runs_of_texts(words, min_length)
                flat = np.concatenate(runs)
                cuts = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]), pa.int32())
                values = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(run))
                yield pa.RecordBatch.from_arrays([
                    doc_ids[first:at], pa.array([len(w) for w in words], pa.int64()),
                    pa.ListArray.from_arrays(cuts, values, type=kinds),
                    pa.array([collapse(w, r) for w, r in zip(words, runs)], pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(detect, RUNS)


def with_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with a periodic end in about a tenth of the texts.

    With h = crc32 of the decimal doc_id, g = h div 10: if h is divisible by 10, the words from a = g mod n on repeat their
    first p = 1 + (n - a) div (3 + g mod 8) words until the text's n words are reached."""
    words = F.filter(F.split(F.col("text"), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    hashed = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    chosen = F.coalesce(hashed % 10 == 0, F.lit(False))
    rows = rows.withColumns({"g": F.floor(hashed / 10), "n": F.when(chosen, F.size(words)).otherwise(0)})
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    left = F.col("n") - F.col("a")
    block = F.slice(words, F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), F.col("a")), tail), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of all documents: their number, the one of the greatest exponent, and checksums."""
    found = periodic_runs(with_repeats(read_table(spark, sf_dir, "documents")))
    best = F.reduce("runs", F.lit(None).cast(_RUN), lambda held, r: F.when(
        held.isNull() | (r["length"] * held["period"] > held["length"] * r["period"]), r).otherwise(held))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                         F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                        "runs_sha256", "collapsed_sha256")
