"""Operator 9, packing: first-fit decreasing with a tournament tree of free capacities, run
independently in randomised groups of documents.

1. One narrow pass tokenizes whole texts, adds the end id, and cuts a document into pieces of
   ``capacity`` ids plus a rest.  Only the pieces' lengths and checksums leave the pass (the ids
   too, if asked for), together with a group drawn at random from (doc_id, row).
2. A group holds about ``group_docs`` documents at every input size, so the work of a group is
   bounded.  Inside it, pieces are placed by falling length into the first sequence with room.
   The tournament tree keeps the largest free capacity below every node, so that sequence is
   found from the root in logarithmic time.
3. Sequence numbers are group << 32 | number in the group.

Tokens: a space before a word starts a new pre-token of the byte-level vocabulary, so a text's ids
are the ids of its space-separated chunks, which a bounded cache keeps.  Chunks of plain characters
missing there are encoded by tiktoken with the same vocabulary, all others, and texts with runs of
spaces, by ``tokenizers``.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; a null
doc_id is kept as null; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glazier.llm.common import column, mix64, read_table, tasks

CAPACITY = 2048
END_ID = 1
GROUP_DOCS = 4096
CACHE_CHUNKS = 400_000  # distinct chunks kept per worker
_UNUSUAL = re.compile(r"[^\x20-\x7e\nÀ-ɏ]|<\|")


def tokenizer_files() -> tuple[str, str]:
    """The vocabulary for ``tokenizers`` and the same one as ranks for tiktoken."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class _ChunkIds(dict):
    """Space-led chunk -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, json_file: str, ranks_file: str | None):
        from tokenizers import Tokenizer
        self.full = Tokenizer.from_file(json_file)
        self.quick = None
        if ranks_file:
            import public_tokenizers
            import tiktoken
            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                           special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.quick is not None and not _UNUSUAL.search(text):
            ids = self.quick.encode_ordinary(text)
        else:
            ids = self.full.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        ids = self.encode(" " + chunk)
        if len(chunk) <= 40:
            self[chunk] = ids
        return ids

    def text(self, text: str) -> bytes:
        if not text:
            return b""
        if "  " in text:
            return self.encode(text)
        first, *rest = text.split(" ")
        return (self.encode(first) if first else b"") + b"".join(map(self.__getitem__, rest))


@lru_cache(maxsize=2)
def chunk_ids(json_file: str, ranks_file: str | None) -> _ChunkIds:
    """One cache per worker process."""
    return _ChunkIds(json_file, ranks_file)


PIECES = T.StructType([
    T.StructField("group", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("row", T.LongType()),
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType())])
PACKED = T.StructType([f for f in PIECES if f.name not in ("group", "row")] + [
    T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
_IDS = T.StructField("ids", T.BinaryType())


def cut_documents(docs: DataFrame, groups: int, capacity: int = CAPACITY, files: tuple[str, str | None] | None = None,
                  with_ids: bool = False) -> DataFrame:
    """Tokenize ``docs`` (doc_id, text) and cut each document into pieces of at most ``capacity`` ids."""
    json_file, ranks_file = files or tokenizer_files()
    end = np.array([END_ID], dtype="<u4").tobytes()
    width = 4 * capacity
    schema = pa.schema([(f.name, pa.int64()) for f in PIECES] + ([("ids", pa.binary())] if with_ids else []))

    def cut(batches):
        cache = chunk_ids(json_file, ranks_file)
        row = 0
        for batch in batches:
            doc_ids = column(batch, "doc_id").to_pylist()
            out = {f.name: [] for f in schema}
            for doc_id, text in zip(doc_ids, column(batch, "text").to_pylist()):
                ids = cache.text(text or "") + end
                group = int(mix64(np.array([(doc_id or 0) & (2**64 - 1) ^ row << 20], np.uint64))[0] % np.uint64(groups))
                for at in range(0, len(ids), width):
                    piece = ids[at:at + width]
                    for name, value in zip(schema.names, (group, doc_id, row, at // 4, len(piece) // 4,
                                                          zlib.crc32(piece), len(ids) // 4, piece)):
                        out[name].append(value)
                row += 1
            yield pa.RecordBatch.from_pydict(out, schema)

    kinds = T.StructType([*PIECES, _IDS]) if with_ids else PIECES
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, kinds)


class FirstFit:
    """Tournament tree over sequences: every node holds the largest free capacity below it."""

    def __init__(self, capacity: int, most: int):
        self.leaves = 1 << max(most - 1, 0).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> int:
        """Put ``length`` into the first sequence with room and return its number."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < length:
                node += 1
        free[node] -= length
        chosen = node - self.leaves
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
        return chosen


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every item; full items get sequences of their own after the others."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = lengths >= capacity
    part = np.flatnonzero(~full)
    part = part[np.argsort(-lengths[part], kind="stable")]
    tree, filled = FirstFit(capacity, len(part)), {}
    for item in part.tolist():
        length = int(lengths[item])
        chosen = tree.place(length)
        sequence[item], offset[item] = chosen, filled.get(chosen, 0)
        filled[chosen] = filled.get(chosen, 0) + length
    sequence[full] = len(filled) + np.arange(int(full.sum()))
    return sequence, offset


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS,
                   files: tuple[str, str | None] | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and offset there (``with_ids``: and their ids)."""
    spark = docs.sparkSession
    groups = max(1, -(-docs.count() // group_docs))
    pieces = cut_documents(docs, groups, capacity, files, with_ids)
    kinds = T.StructType([*PACKED, _IDS]) if with_ids else PACKED

    names = [f.name for f in kinds]

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("row", "ascending"), ("start", "ascending")])
        sequence, offset = first_fit_decreasing(table["length"].to_numpy(), capacity)
        first = table["group"][0].as_py() << 32
        return table.append_column("sequence_id", pa.array(first + sequence)).append_column(
            "offset", pa.array(offset)).select(names)

    return (pieces.repartition(min(groups, 4 * tasks(spark)), "group").groupBy("group").applyInArrow(pack, kinds))


def op9_ffd_packing(spark, sf_dir: str) -> DataFrame:
    """All documents into sequences of at most 2048 ids."""
    return pack_documents(read_table(spark, sf_dir, "documents"))
