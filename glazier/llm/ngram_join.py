"""Operator 3, exact n-gram Jaccard join with set-relation skipping.

A document's set are the distinct hashes of its five-word shingles.  Documents with equal sets are
one member of the index.  The steps:

1. ``_statistics``: one pass counts all shingles in hashed buckets, so that shingles of passages that
   many documents share come last in the order, and gives each set a signature and a parity bitmap.
2. ``_index``: prefix index lists.  In the global order (bucket count, hash) two sets of the wanted
   similarity share a shingle of their prefixes.  Lists of one set are dropped; the others are
   ordered by set size and position and cut into blocks.
3. Index-level skipping: pairs of blocks whose size ranges exclude the similarity are never formed,
   and inside a block size, prefix kind and position of both entries skip pairs before any set is read.
4. Answer-level skipping: where lists hold many similar sets, a few sets per list (leaders) are
   compared with the list first.  A set similar to a leader takes over the leader's answers: it is in
   the leader's component, and none of its pairs inside that component is formed.  The rounds go on
   while they save pairs; then all pairs left between different components are formed.
5. Every pair is checked by the bitmaps' bound first and then by the exact intersection of both sets.

All steps are exact: prefix, size, position and bitmap tests only drop pairs that cannot be similar.

Bounds: at most 2^22 frequent buckets are broadcast, after a check of their number, and a bitmap of 4 MB
that picks the documents whose sets are read again.  Lists are streamed and cut into blocks, copies
are collapsed before the shuffle, and no list, component or set of pairs is collected.  Entries carry whether
their list is long and has several blocks, so only those lists are dealt again; a step's shuffles go with it.

Defined cases: documents without words have an empty set, no links and their own id as component; with
fewer than five words the whole sequence is one shingle; repeated rows are in one component; an empty
table gives no rows; extra columns are not read.  Documents with a null id are left out of links.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glazier.llm.common import batch_of, column, longs, mix64, read_table, shuffles_dropped, stored, tasks, tasks_for
from glazier.llm.components import components
from glazier.llm.shingles import shingle_set

WORDS, PERCENT = 5, 75
RANGE_BITS = 16  # hashed buckets of shingle counts are counted by ranges of 2^RANGE_BITS
MOST_FREQUENT = 1 << 22  # frequent buckets broadcast at most
LEAST_FREQUENT = 32
FLUSH = 1_000_000  # shingles counted at once in a task, at least
PAIRS = 250_000  # pairs of entries tested at once in a task
BLOCK = 1024  # entries of a list block
LONG, LIST_CELLS = 64, 1024  # lists of so many entries carry bitmaps of so many cells
MARKS = 1 << 25  # bits of the bitmap that picks documents to read again
LEADERS = 8  # orders in which lists choose their leaders, a round
# Rows a task of a Python step takes at least, where there are more shuffle partitions than those need.
TEXTS, ENTRIES, FOUND = 4_000, 400_000, 50_000


def _signature(shingles: np.ndarray) -> tuple[int, int]:
    both = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(both[:8], "little", signed=True), int.from_bytes(both[8:], "little", signed=True)


def _bitmap(shingles: np.ndarray) -> bytes:
    """Parity of the shingles of each of n to 2n cells (1024 to 65536)."""
    cells = min(max(LIST_CELLS, 1 << (len(shingles) - 1).bit_length()), 1 << 16)
    return np.packbits(np.bincount((shingles & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).tobytes()


def _bitmap_distance(a: bytes, b: bytes) -> int:
    """A lower bound of the number of shingles in one set only."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _needed(n_a, n_b):
    """Least intersection of similar sets of these sizes."""
    return -(-PERCENT * (n_a + n_b) // (100 + PERCENT))


def _texts(batch: pa.RecordBatch):
    """The batch's texts as bytes, a few at a time."""
    texts = column(batch, "text").cast(pa.binary())
    for at in range(0, len(texts), 256):
        yield from texts.slice(at, 256).to_pylist()


# --- statistics -------------------------------------------------------------------------------

_COUNTED = "part int, doc_id long, n long, sid long, sid2 long, bitmap binary, buckets binary"
_STATISTICS = "doc_id long, n long, sid long, sid2 long, bitmap binary, bucket long, times long"


def _bucket_bits(texts: int) -> int:
    """Bits of a shingle's count bucket: about 256 buckets a document, so that buckets hold few chance meetings."""
    return min(max(26, (texts * 256 - 1).bit_length()), 40)


def _statistics(docs: DataFrame, bits: int, n_tasks: int) -> DataFrame:
    """Rows of documents (size, signature, bitmap) and rows of buckets with their frequent counts."""
    ranges = 1 << (bits - RANGE_BITS)
    flush = max(FLUSH, 64 * ranges)
    counted = pa.schema([("part", pa.int32())] + [(c, pa.int64()) for c in ("doc_id", "n", "sid", "sid2")]
                        + [("bitmap", pa.binary()), ("buckets", pa.binary())])

    def bucket_rows(found: list[np.ndarray]) -> pa.RecordBatch:
        buckets = np.sort(np.concatenate(found) >> np.uint64(64 - bits))
        cuts = np.searchsorted(buckets, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(RANGE_BITS))
        low = (buckets & np.uint64((1 << RANGE_BITS) - 1)).astype(np.uint16)
        parts = np.flatnonzero(cuts[:-1] < cuts[1:]).tolist()
        nulls = [None] * len(parts)
        return batch_of(counted, parts, nulls, nulls, nulls, nulls, nulls,
                        [low[cuts[r]:cuts[r + 1]].tobytes() for r in parts])

    def count(batches):
        found, held = [], 0
        for batch in batches:
            rows = {f.name: [] for f in counted}
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), _texts(batch)):
                shingles = shingle_set(text, WORDS)
                sid, sid2 = _signature(shingles)
                for name, value in zip(rows, (sid & (ranges - 1), doc_id, len(shingles), sid, sid2,
                                              _bitmap(shingles) if len(shingles) else None, None)):
                    rows[name].append(value)
                found.append(shingles)
                held += len(shingles)
                if held >= flush:
                    yield bucket_rows(found)
                    found, held = [], 0
            yield pa.RecordBatch.from_pydict(rows, counted)
        if held:
            yield bucket_rows(found)

    out = pa.schema([(c, pa.int64()) for c in ("doc_id", "n", "sid", "sid2")]
                    + [("bitmap", pa.binary()), ("bucket", pa.int64()), ("times", pa.int64())])

    def add_up(batches):
        part, times = None, None

        def frequent():
            at = np.flatnonzero(times >= LEAST_FREQUENT)
            nulls = pa.nulls(len(at), pa.int64())
            return batch_of(out, nulls, nulls, nulls, nulls, pa.nulls(len(at), pa.binary()),
                            (part << RANGE_BITS) + at, times[at])

        for batch in batches:
            is_document = column(batch, "buckets").is_null()
            rows = batch.filter(is_document)
            if rows.num_rows:
                yield batch_of(out, *[column(rows, c) for c in ("doc_id", "n", "sid", "sid2", "bitmap")],
                               pa.nulls(rows.num_rows, pa.int64()), pa.nulls(rows.num_rows, pa.int64()))
            rows = batch.filter(column(batch, "buckets").is_valid())
            for p, blob in zip(longs(rows, "part").tolist(), column(rows, "buckets").to_pylist()):
                if p != part:
                    if part is not None:
                        yield frequent()
                    part, times = p, np.zeros(1 << RANGE_BITS, np.int64)
                times += np.bincount(np.frombuffer(blob, np.uint16), minlength=1 << RANGE_BITS)
        if part is not None:
            yield frequent()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, _COUNTED)
    return stored(rows.repartition(tasks(docs.sparkSession), "part").sortWithinPartitions("part")
                  .coalesce(n_tasks).mapInArrow(add_up, _STATISTICS), "ngram-statistics")


def _frequent_buckets(statistics: DataFrame):
    """Broadcast of the frequent buckets and their counts.  Buckets of ``LEAST_FREQUENT`` shingles or more
    are frequent; were they more than ``MOST_FREQUENT``, the bound is doubled until they are not.  The
    order stays exact for any bound: it only decides which shingles come last."""
    least = LEAST_FREQUENT
    while statistics.filter(F.col("times") >= least).count() > MOST_FREQUENT:
        least *= 2
    rows = statistics.filter(F.col("times") >= least).select("bucket", "times").toArrow()
    bucket, times = rows["bucket"].to_numpy().astype(np.uint64), rows["times"].to_numpy().astype(np.int64)
    order = np.argsort(bucket)
    return statistics.sparkSession.sparkContext.broadcast((bucket[order], times[order]))


# --- index lists ------------------------------------------------------------------------------

def _prefix(shingles: np.ndarray, buckets: np.ndarray, times: np.ndarray, bits: int) -> np.ndarray:
    """The first shingles of a set in the global order: as many as can miss all similar sets, plus one."""
    n = len(shingles)
    length = n - -(-PERCENT * n // 100) + 1
    if not len(buckets):
        return shingles[:length]
    bucket = shingles >> np.uint64(64 - bits)
    at = np.minimum(np.searchsorted(buckets, bucket), len(buckets) - 1)
    frequent = buckets[at] == bucket
    rare = shingles[~frequent]
    if len(rare) >= length:
        return rare[:length]
    often = shingles[frequent]
    return np.concatenate([rare, often[np.argsort(times[at[frequent]], kind="stable")]])[:length]


_LISTS = pa.schema([(c, pa.int64()) for c in ("token", "sid", "place", "entry")] + [(c, pa.bool_()) for c in ("long", "blocks")])


def _index(docs: DataFrame, frequent, bits: int, n_tasks: int) -> DataFrame:
    """Entries of lists of two sets or more: token, sid, place (size << 32 | position), entry number, and whether
    the list is long (``LONG`` entries or more) and has several blocks, so that later steps deal only such lists anew."""
    posted = pa.schema([("token", pa.int64()), ("sid", pa.int64()), ("place", pa.int64())])

    def post(batches):
        buckets, times = frequent.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            tokens, sids, places, held = [], [], [], 0
            for text in _texts(batch):
                shingles = shingle_set(text, WORDS)
                if not len(shingles) or (signature := _signature(shingles)) in seen:
                    continue  # a copy in this task has the same entries
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(signature)
                prefix = _prefix(shingles, buckets, times, bits)
                tokens.append(prefix.view(np.int64))
                sids.append(np.full(len(prefix), signature[0]))
                places.append((len(shingles) << 32) + np.arange(len(prefix), dtype=np.int64))
                held += len(prefix)
                if held >= 400_000:
                    yield batch_of(posted, *map(np.concatenate, (tokens, sids, places)))
                    tokens, sids, places, held = [], [], [], 0
            if held:
                yield batch_of(posted, *map(np.concatenate, (tokens, sids, places)))

    def number(batches):
        # The last list waits for the next batch: all its rows while they are at most ``most``, none of them
        # written yet; then its last row only, with the number of rows written.
        most, rest, written = max(LONG, BLOCK), None, 0
        for batch in itertools.chain(batches, [None]):  # None: the list held back ends too
            rows = [longs(batch, c) for c in posted.names] if batch is not None else [x[:0] for x in rest or []]
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows)]
            if not rows or not len(rows[0]):
                continue
            token, sid, place = rows
            first = np.ones(len(token), bool)
            first[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1]) | (place[1:] != place[:-1])
            token, sid, place = token[first], sid[first], place[first]
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            lengths = np.diff(np.r_[starts, len(token)])
            entry = np.arange(len(token)) - np.repeat(starts, lengths)
            keep = np.repeat(lengths > 1, lengths)
            total = lengths.copy()
            if written:  # the first row is the last one written
                entry[:lengths[0]] += written - 1
                total[0] += written - 1
                keep[:lengths[0]] = True
                keep[0] = False
            whole = batch is None or total[-1] > most
            if not whole:
                keep[starts[-1]:] = False
            yield batch_of(_LISTS, token[keep], sid[keep], place[keep], entry[keep],
                           *(np.repeat(x, lengths)[keep] for x in (total >= LONG, total > BLOCK)))
            at, written = (len(token) - 1, int(total[-1])) if whole else (int(starts[-1]), 0)
            rest = [x[at:] for x in (token, sid, place)]

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(post, "token long, sid long, place long")
    return stored(rows.repartition(tasks(docs.sparkSession), "token").sortWithinPartitions("token", "place", "sid")
                  .coalesce(n_tasks).mapInArrow(number, "token long, sid long, place long, entry long, long boolean, blocks boolean"),
                  "ngram-lists")


def _with_bits(lists: DataFrame, sets: DataFrame, n_tasks: int) -> DataFrame:
    """Entries of long lists with their sets' bitmaps, folded to ``LIST_CELLS`` cells; of others with NULL."""
    schema = pa.schema([("sid", pa.int64()), ("bits", pa.binary())])

    def fold(batches):
        for batch in batches:
            folded = [np.bitwise_xor.reduce(np.frombuffer(b, np.uint8).reshape(-1, LIST_CELLS // 8), axis=0).tobytes()
                      for b in column(batch, "bitmap").to_pylist()]
            yield batch_of(schema, column(batch, "sid"), folded)

    bits = sets.select("sid", "bitmap").dropDuplicates(["sid"]).coalesce(n_tasks).mapInArrow(fold, "sid long, bits binary")
    columns = [c for c in lists.columns if c != "long"]
    short = lists.filter("not long").select(*columns, F.lit(None).cast("binary").alias("bits"))
    return stored(short.union(lists.filter("long").join(bits, "sid", "left").select(*columns, "bits")).coalesce(n_tasks),
                  "ngram-entries")


def _blocks(lists: DataFrame) -> DataFrame:
    """Entries dealt to pairs of blocks (i, j) of their list: side 0 for i = j, else 1 in i and 2 in j.
    Pairs of blocks are skipped if the sizes in them exclude the similarity."""
    block = F.floor(F.col("entry") / BLOCK).cast("long")
    rows = lists.withColumn("i", block)
    alone = rows.select("token", "i", F.col("i").alias("j"), F.lit(0).alias("side"), "sid", "place", "label", "bits")
    size = F.shiftright("place", 32)
    longer = rows.filter("blocks")
    ranges = longer.groupBy("token", "i").agg(F.min(size).alias("low"), F.max(size).alias("high"))
    right = ranges.select("token", F.col("i").alias("j"), F.col("low").alias("least"))
    pairs = ranges.join(right, "token").filter((F.col("i") < F.col("j")) & (F.col("high") * 100 >= F.col("least") * PERCENT))
    dealt = [longer.withColumnRenamed("i", "b").join(pairs.select("token", "i", "j", F.col(at).alias("b")), ["token", "b"])
             .select("token", "i", "j", F.lit(side).alias("side"), "sid", "place", "label", "bits")
             for at, side in (("i", 1), ("j", 2))]
    return alone.union(dealt[0]).union(dealt[1])


def _list_pairs(group, token, side, sid, place, label, bits, leaders: int | None):
    """Arrays of pairs (smaller, larger) of entries that may be similar; ``group`` tells pairs of blocks apart."""
    size, position = place >> 32, place & 0xFFFFFFFF
    runs = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    lengths = np.diff(np.r_[runs, len(group)])

    def tested(a, b):
        swap = size[a] > size[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        n, m, p, q = size[a], size[b], position[a], position[b]
        ok = (label[a] != label[b]) & (100 * n >= PERCENT * m)
        # Of the smaller set a shorter prefix suffices.
        ok &= p <= n - -(-2 * PERCENT * n // (100 + PERCENT))
        ok &= np.minimum(p, q) + np.minimum(n - p, m - q) >= _needed(n, m)
        a, b = a[ok], b[ok]
        if bits is not None and len(a):
            most = size[a] + size[b] - 2 * _needed(size[a], size[b])
            far = np.concatenate([np.bitwise_count(bits[a[k:k + 50_000]] ^ bits[b[k:k + 50_000]]).sum(axis=1, dtype=np.int64)
                                  for k in range(0, len(a), 50_000)])
            a, b = a[far <= most], b[far <= most]
        return a, b

    if leaders is not None:
        salt = (token.view(np.uint64) % np.uint64(LEADERS)) + np.uint64(LEADERS * leaders)
        run = np.repeat(np.arange(len(runs)), lengths)
        order = np.lexsort((mix64(sid.view(np.uint64) ^ mix64(salt)), side == 2, run))
        leader = order[runs][run]
        others = np.flatnonzero((np.arange(len(group)) != leader) & (side != 1))
        yield tested(leader[others], others)
        return
    alone = side[runs] == 0
    for length in np.unique(lengths[alone]).tolist():
        if length < 2:
            continue
        starts = runs[alone & (lengths == length)]
        i, j = np.triu_indices(length, 1)
        step = max(1, PAIRS // len(i))
        for at in range(0, len(starts), step):
            some = starts[at:at + step, None]
            yield tested((some + i).ravel(), (some + j).ravel())
    for start, length in zip(runs[~alone].tolist(), lengths[~alone].tolist()):
        split = start + int(np.searchsorted(side[start:start + length], 2))
        a, b = np.arange(start, split), np.arange(split, start + length)
        few = max(1, PAIRS // max(len(b), 1))
        for at in range(0, len(a) if len(b) else 0, few):
            some = a[at:at + few]
            yield tested(np.repeat(some, len(b)), np.tile(b, len(some)))


def _bits(batch: pa.RecordBatch) -> np.ndarray:
    """The entries' bitmaps as rows of 64-bit words; zero where there is none, which excludes no pair of a list."""
    none = bytes(LIST_CELLS // 8)
    return np.frombuffer(b"".join(b or none for b in column(batch, "bits").to_pylist()), np.uint64).reshape(batch.num_rows, -1)


_ENTRY = ("token", "i", "j", "side", "sid", "place", "label")


def _pairs(lists: DataFrame, n_tasks: int, leaders: int | None = None) -> DataFrame:
    """Pairs of sets (sids) that lists hold and no test skips.  With ``leaders``, those of a round's leaders, and
    rows with the number of all pairs in ``total``, a pair counting once for every list."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("total", pa.int64())])

    def form(batches):
        rest = None
        for batch in itertools.chain(batches, [None]):  # None: the lists held back end too
            arrays = [*[longs(batch, c) for c in _ENTRY], _bits(batch)] if batch is not None else [x[:0] for x in rest or []]
            if rest is not None:
                arrays = [np.concatenate(x) for x in zip(rest, arrays)]
            if not arrays or not len(arrays[0]):
                continue
            token, i, j = arrays[:3]
            group = np.cumsum(np.r_[0, (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            whole = int(np.searchsorted(group, group[-1])) if batch is not None else len(group)
            rest = [x[whole:] for x in arrays]
            if not whole:
                continue
            token, _, _, side, sid, place, label, bits = (x[:whole] for x in arrays)
            bits = bits if bits.any() else None
            entries = (group[:whole], token, side, sid, place, label, bits)
            for a, b in _list_pairs(*entries, leaders):
                if len(a):
                    both = np.unique(np.stack([sid[a], sid[b]], axis=1), axis=0)
                    yield batch_of(schema, np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1]),
                                   pa.nulls(len(both), pa.int64()))
            if leaders is not None:
                yield batch_of(schema, [None], [None], [sum(len(a) for a, _ in _list_pairs(*entries, None))])

    dealt = (_blocks(lists).repartition(tasks(lists.sparkSession), "token", "i", "j")
             .sortWithinPartitions("token", "i", "j", "side", "place", "sid").coalesce(n_tasks))
    return dealt.mapInArrow(form, "a long, b long, total long")


# --- verification and components --------------------------------------------------------------

def _mark_cells(ids: np.ndarray) -> np.ndarray:
    return (mix64(ids.view(np.uint64)) & np.uint64(MARKS - 1)).astype(np.int64)


def _marked(wanted: DataFrame):
    """Broadcast of a bitmap of ``MARKS`` bits (4 MB at any size) with a bit set for every wanted document."""
    schema = pa.schema([("word", pa.int64()), ("bits", pa.int64())])

    def mark(batches):
        for batch in batches:
            cell = _mark_cells(longs(batch, "doc_id"))
            word, at = np.unique(cell >> 6, return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, at, np.uint64(1) << (cell & 63).astype(np.uint64))
            yield batch_of(schema, word, bits.view(np.int64))

    rows = wanted.mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(MARKS >> 6, np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return wanted.sparkSession.sparkContext.broadcast(words)


def _links(docs: DataFrame, pairs: DataFrame, sets: DataFrame, n_pairs: int) -> tuple[DataFrame, int]:
    """Pairs of sets (ids of their first documents) that are similar, by bitmaps first, then exactly; and their number.
    ``n_pairs`` (about as many as ``pairs`` has) decides the number of tasks only."""
    n_tasks = tasks_for(docs.sparkSession, n_pairs, FOUND)
    def side(of: str) -> DataFrame:
        return sets.select(F.col("sid").alias(of), *[F.col(c).alias(f"{c}_{of}") for c in ("rep", "n", "bitmap")])

    schema = pa.schema([(c, pa.int64()) for c in ("rep_a", "rep_b", "n_a", "n_b")])

    def bounded(batches):
        for batch in batches:
            n_a, n_b = longs(batch, "n_a"), longs(batch, "n_b")
            most = n_a + n_b - 2 * _needed(n_a, n_b)
            near = [_bitmap_distance(a, b) <= m for a, b, m in zip(
                column(batch, "bitmap_a").to_pylist(), column(batch, "bitmap_b").to_pylist(), most.tolist())]
            yield batch.select(schema.names).filter(pa.array(near, pa.bool_()))

    near = stored(pairs.distinct().join(side("a"), "a").join(side("b"), "b").filter("rep_a <> rep_b")
                  .select(*schema.names, "bitmap_a", "bitmap_b").coalesce(n_tasks)
                  .mapInArrow(bounded, "rep_a long, rep_b long, n_a long, n_b long"), "ngram-near")
    wanted = near.select(F.col("rep_a").alias("doc_id")).union(near.select("rep_b"))  # a bit may be set twice
    marks = _marked(wanted)
    held = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def read(batches):
        words = marks.value
        for batch in batches:
            batch = batch.filter(column(batch, "doc_id").is_valid())
            cell = _mark_cells(longs(batch, "doc_id"))
            batch = batch.filter(pa.array((words[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1) == 1))
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                yield batch_of(held, column(some, "doc_id"),
                               [shingle_set(t, WORDS).view(np.int64) for t in _texts(some)])

    # The marks pass all wanted documents and few others; the joins below are exact.
    shingled = stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
                      .mapInArrow(read, "doc_id long, shingles array<bigint>"), "ngram-sets")

    def of(s: str) -> DataFrame:
        return shingled.select(F.col("doc_id").alias(f"rep_{s}"), F.col("shingles").alias(f"shingles_{s}"))

    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    union = F.size("shingles_a") + F.size("shingles_b") - common
    found = stored(near.join(of("a"), "rep_a").join(of("b"), "rep_b").filter(common * 100 >= union * PERCENT)
                   .select("rep_a", "rep_b").distinct().coalesce(n_tasks), "ngram-links")
    return found, found.count()


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    with shuffles_dropped(docs.sparkSession):
        return _components(docs)


def _components(docs: DataFrame) -> DataFrame:
    spark, texts = docs.sparkSession, docs.count()
    bits, n_tasks = _bucket_bits(texts), tasks_for(docs.sparkSession, texts, TEXTS)
    statistics = _statistics(docs, bits, n_tasks)
    documents = statistics.filter("bucket is null")
    sets = stored(documents.filter("n > 0 and doc_id is not null").groupBy("sid", "sid2").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap")).coalesce(n_tasks), "ngram-members")
    lists = _index(docs, _frequent_buckets(statistics), bits, n_tasks)
    lists = _with_bits(lists, sets, n_tasks)
    entries = lists.count()
    list_tasks = max(n_tasks, tasks_for(spark, entries, ENTRIES))
    labelled, links, n_links, parts, before, turn = lists.withColumn("label", F.col("sid")), None, 0, None, None, 0

    def joined(found: DataFrame, n: int) -> None:
        nonlocal links, n_links, parts
        links, n_links = found if links is None else links.union(found), n_links + n
        parts = stored(components(links, "rep_a", "rep_b", n_links), "ngram-parts")

    while True:
        # One dealing of the lists tells how many pairs are left and forms the leaders' pairs.
        asked = stored(_pairs(labelled, list_tasks, leaders=turn), "ngram-leaders")
        left, led = asked.agg(F.sum("total"), F.count("a")).first()
        left = left or 0
        # Leaders are asked while they save pairs and the pairs are more than the entries.
        if left <= entries or (before is not None and left > 0.8 * before):
            break
        joined(*_links(docs, asked.filter("total is null").select("a", "b"), sets, led))
        labels = sets.join(parts, sets["rep"] == parts["id"]).select("sid", "component")
        labelled = stored(lists.join(labels, "sid", "left").select(
            *lists.columns, F.coalesce("component", "sid").alias("label")).coalesce(list_tasks), "ngram-labelled")
        before, turn = left, turn + 1
    if left:
        joined(*_links(docs, _pairs(labelled, list_tasks).select("a", "b"), sets, left))
    full = documents.filter("n > 0 and doc_id is not null").select("doc_id", "n", "sid", "sid2")
    members = full.join(sets.select("sid", "sid2", "rep"), ["sid", "sid2"])
    if parts is not None:
        members = members.join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    else:
        members = members.withColumn("component", F.col("rep"))
    rest = documents.filter("n = 0 or doc_id is null")
    return members.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")).union(
        rest.select("doc_id", "n", F.col("doc_id")))


def op3_set_relation_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return jaccard_components(read_table(spark, sf_dir, "documents"))


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every component the document with the least id stays, once; rows without id stay."""
    kept = jaccard_components(docs).filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns).union(
        docs.filter("doc_id is null"))
