"""Operator 13, byte-level BPE encoding and decoding with vectorised pre-tokenisation.

1. A group of texts is one byte array.  Its code points become an array of classes (letter kinds, number,
   apostrophe, space, other white space, other) through a table that is asked of the tiktoken library
   itself, so that both read the same Unicode version.
2. The pattern of the vocabulary is a small automaton over the classes.  A character is a function from
   state to state, and functions compose associatively: the functions that can arise are numbered once,
   with a table of their compositions, and a blocked scan over the numbers gives the state before every
   character.  State, class and next class tell where a pre-token starts.  A text's first character is a
   constant function, so no state passes from one text to the next.  No regex is run.
3. The slices between starts are merged by rank, with a bounded cache of distinct slices; long slices by
   a heap over linked neighbours, so that a text without any boundary takes n log n steps.
4. Every id keeps its byte offset; decoding writes the ids' bytes to their offsets.

Both directions are narrow passes over Arrow batches: nothing is shuffled.  A pass works on about
``GROUP_BYTES`` at a time and scans longer texts in windows that hand on the state.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded each;
a null doc_id is kept; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glazier.llm.common import column, read_table, text_or_empty

GROUP_BYTES = 2 << 20   # texts are worked on in groups of about so many bytes
CACHE_SLICES = 300_000  # distinct slices kept per worker
CACHE_WIDTH = 48        # longer slices are not kept
LONG_SLICE = 64         # slices longer than this are merged with a heap

# Classes of characters.
LETTER, STMD, RV, E, L, NUMBER, QUOTE, OTHER, SPACE, WHITE, END = range(11)
# States: what the characters so far leave open.
FRESH, WORD, DIGITS, SIGNS, GLUE, BLANK, TICK, TICK_RV, TICK_L, CLOSED = range(10)
_CLASSES, _STATES = 11, 10
_LETTERS = (LETTER, STMD, RV, E, L)


def tokenizer_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


# --- classes, automaton and scan ------------------------------------------------------------------

@lru_cache(maxsize=1)
def class_table() -> bytes:
    """The class of every code point, compressed.  tiktoken is asked with a vocabulary that merges "a", "1" or
    "!" with a following byte: the merge happens only if the pattern keeps both characters in one slice."""
    import tiktoken
    ranks = {bytes([b]): b for b in range(256)}
    for probe in b"a1!":
        ranks |= {bytes([probe, b]): 256 * (1 + b"a1!".index(probe)) + b for b in range(256)}
    asked = tiktoken.Encoding("classes", pat_str=pattern(), mergeable_ranks=ranks, special_tokens={})
    ascii_points = [chr(c) for c in range(0x80)]
    points = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    table = np.full(0x110000, WHITE, np.uint8)
    for n, (probe, kind) in enumerate((("a", LETTER), ("1", NUMBER), ("!", OTHER)), 1):
        # The bytes of other characters and the line feeds between are never a probe, alone or merged.
        ids = np.array(asked.encode_ordinary("\n".join(probe + chr(c) for c in points)))
        merged = ids[(ids == ord(probe)) | (ids // 256 == n)] >= 256
        table[np.array(points)[merged]] = kind
        table[:0x80][[len(asked.encode_ordinary(probe + c)) == 1 for c in ascii_points]] = kind
    for kind, chars in ((STMD, "stmd"), (RV, "rv"), (E, "e"), (L, "l"), (QUOTE, "'"), (SPACE, " ")):
        table[[ord(c) for c in chars]] = kind
    return zlib.compress(table.tobytes())


def _next_state(state: int, kind: int) -> int:
    if kind == SPACE:
        return GLUE
    if kind == WHITE:
        return BLANK
    if kind == NUMBER:
        return DIGITS
    if kind == OTHER:
        return SIGNS
    if kind == QUOTE:  # opens a contraction only where a slice starts
        return SIGNS if state in (GLUE, SIGNS, TICK) else TICK
    if state == TICK:
        return {STMD: CLOSED, RV: TICK_RV, L: TICK_L}.get(kind, WORD)
    if (state, kind) in ((TICK_RV, E), (TICK_L, L)):
        return CLOSED
    return WORD


def _starts_slice(state: int, kind: int, after: int) -> bool:
    """Whether a slice starts at a character, given the state before it and the class after it."""
    if state == FRESH:
        return True
    if kind in (SPACE, WHITE):  # the last white space of a run before a text starts a slice of its own
        return state not in (GLUE, BLANK) or after not in (SPACE, WHITE, END)
    if state == GLUE:
        return False
    if state in (BLANK, CLOSED):
        return True
    if kind in _LETTERS:
        if state == TICK:
            return not (kind == STMD or (kind, after) in ((RV, E), (L, L)))
        return state in (DIGITS, SIGNS)
    if kind == NUMBER:
        return state != DIGITS
    return state not in (SIGNS, TICK)


@lru_cache(maxsize=1)
def automaton():
    """Numbers of the functions that can arise: (generator of every class and of every class at a text's start,
    composition table, state table, identity, table of starts)."""
    steps = [tuple(_next_state(s, k) for s in range(_STATES)) for k in range(END)]
    steps += [(step[FRESH],) * _STATES for step in steps]
    identity = tuple(range(_STATES))
    number, order = {identity: 0}, [identity]
    for f in order:
        for step in steps:
            g = tuple(step[s] for s in f)
            if g not in number:
                number[g] = len(order)
                order.append(g)
    functions = np.array(order, np.uint8)
    compose = np.array([[number[tuple(g[f])] for g in functions] for f in functions], np.uint8)
    starts = np.array([[[_starts_slice(s, k, a) for a in range(_CLASSES)] for k in range(_CLASSES)]
                       for s in range(_STATES)])
    return (np.array([number[s] for s in steps], np.uint8), compose.ravel(), functions, 0, starts.ravel())


def _compose(f: np.ndarray, g: np.ndarray, table: np.ndarray) -> np.ndarray:
    width = np.uint16(int(len(table) ** 0.5))
    return table[f.astype(np.uint16) * width + g]


def states_before(functions: np.ndarray, state: int, rows: int = 256) -> tuple[np.ndarray, int]:
    """The state before every character, and after the last, by a blocked scan of composed functions: along
    the blocks in step, over the blocks' totals by doubling."""
    _, table, apply, identity, _ = automaton()
    n = len(functions)
    blocks = max(1, -(-n // rows))
    grid = np.full(blocks * rows, identity, np.uint8)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(blocks, rows).T)
    for j in range(1, rows):
        grid[j] = _compose(grid[j - 1], grid[j], table)
    totals = grid[-1].copy()
    step = 1
    while step < blocks:
        totals[step:] = _compose(totals[:-step], totals[step:], table)
        step *= 2
    entry = np.concatenate([[state], apply[totals[:-1], state]]).astype(np.uint8)
    before = np.empty((rows, blocks), np.uint8)
    before[0] = entry
    before[1:] = apply.ravel()[grid[:-1].astype(np.uint16) * np.uint16(_STATES) + entry]
    return before.T.reshape(-1)[:n], int(apply[totals[-1], state])


def _code_points(data: np.ndarray, leads: np.ndarray) -> np.ndarray:
    """Code points of the UTF-8 sequences that start at ``leads``; ``data`` has three spare bytes at its end."""
    first = data[leads].astype(np.int32)
    points = first.copy()
    for least, mask, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        at = np.flatnonzero(first >= least)
        if len(at):
            value = first[at] & mask
            for k in range(1, more + 1):
                value = value << 6 | (data[leads[at] + k] & 0x3F)
            points[at] = value
    return np.minimum(points, 0x10FFFF)


def slice_starts(data: bytes, texts: np.ndarray, classes: np.ndarray, window: int = GROUP_BYTES) -> np.ndarray:
    """Byte offsets where the slices of the texts in ``data`` start; ``texts``: offsets where texts start."""
    generators, _, _, _, starts = automaton()
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[texts] = True
    found, at, state = [], 0, FRESH
    while at < n:
        stop = min(at + window, n)
        while stop < n and raw[stop] & 0xC0 == 0x80:
            stop += 1
        ahead = min(stop + 1, n)  # one more character tells the class after the last
        leads = at + np.flatnonzero((raw[at:ahead] & 0xC0) != 0x80)
        kinds, fresh = classes[_code_points(raw, leads)], first[leads]
        after = np.full(len(kinds), END, np.uint8)
        after[:-1] = np.where(fresh[1:], END, kinds[1:])
        here = len(kinds) - (ahead - stop)
        kinds, fresh, after, leads = kinds[:here], fresh[:here], after[:here], leads[:here]
        before, state = states_before(generators[kinds + np.uint8(END) * fresh], state)
        before[fresh] = FRESH
        index = (before.astype(np.uint16) * np.uint16(_CLASSES) + kinds) * np.uint16(_CLASSES) + after
        found.append(leads[starts[index]])
        at = stop
    return np.concatenate(found) if found else np.zeros(0, np.int64)


# --- merging and the vocabulary ---------------------------------------------------------------------

def _merge_short(piece: bytes, ranks: dict) -> list[int]:
    none, get = 1 << 40, ranks.get
    cuts = list(range(len(piece) + 1))
    pairs = [get(piece[i:i + 2], none) for i in range(len(piece) - 1)]  # rank of every two neighbours
    while pairs:
        best = min(pairs)
        if best == none:
            break
        at = pairs.index(best)
        del cuts[at + 1], pairs[at]
        if at < len(pairs):
            pairs[at] = get(piece[cuts[at]:cuts[at + 2]], none)
        if at:
            pairs[at - 1] = get(piece[cuts[at - 1]:cuts[at + 1]], none)
    return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])]


def _merge_long(piece: bytes, ranks: dict) -> list[int]:
    """The same merges (least rank, then leftmost) with a heap; a part is known by its start."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[piece[i:i + 2]], i, i + 2) for i in range(n - 1) if piece[i:i + 2] in ranks]
    heapq.heapify(heap)
    alive = bytearray(b"\1") * n
    while heap:
        _, at, stop = heapq.heappop(heap)
        middle = end[at]
        if not alive[at] or middle >= n or end[middle] != stop or middle >= stop:
            continue
        alive[middle], end[at] = 0, stop
        if stop < n:
            before[stop] = at
            rank = ranks.get(piece[at:end[stop]])
            if rank is not None:
                heapq.heappush(heap, (rank, at, end[stop]))
        left = before[at]
        if left >= 0:
            rank = ranks.get(piece[left:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, left, stop))
    return [ranks[piece[i:end[i]]] for i in range(n) if alive[i]]


class Vocabulary(dict):
    """Slice -> its ids as little-endian 32-bit bytes, a bounded cache over the merges by rank."""

    def __init__(self, ranks_file: str):
        with open(ranks_file, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int32)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def __missing__(self, piece: bytes) -> bytes:
        rank = self.ranks.get(piece)
        ids = [rank] if rank is not None else (_merge_long if len(piece) > LONG_SLICE else _merge_short)(piece, self.ranks)
        out = np.array(ids, "<i4").tobytes()
        if len(piece) <= CACHE_WIDTH:
            if len(self) >= CACHE_SLICES:
                self.clear()
            self[piece] = out
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """The bytes of ids that stand at ``offsets`` (gapless from the first)."""
        lengths = self.lengths[ids]
        total = int(lengths.sum())
        source = np.arange(total) + np.repeat(self.starts[ids] - (offsets - (offsets[0] if len(offsets) else 0)), lengths)
        return self.bytes[source].tobytes()


@lru_cache(maxsize=2)
def vocabulary(ranks_file: str) -> Vocabulary:
    """One cache per worker process."""
    return Vocabulary(ranks_file)


@lru_cache(maxsize=1)
def _classes_of(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def _groups(offsets: np.ndarray, most: int):
    """Row ranges whose texts take about ``most`` bytes together, one row at least."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(stop, rows)
        at = min(stop, rows)


def encode_group(data: bytes, offsets: np.ndarray, vocab: Vocabulary, classes: np.ndarray):
    """Ids of all texts in ``data`` (text i at offsets[i]:offsets[i + 1]), their byte offsets in their text, and
    the number of ids before every text."""
    starts = slice_starts(data, offsets[:-1][offsets[1:] > offsets[:-1]], classes)
    cuts = starts.tolist()
    ids = [vocab[data[a:b]] for a, b in zip(cuts, cuts[1:] + [len(data)])]
    counts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)])
    before = counts[np.searchsorted(starts, offsets)]
    ids = np.frombuffer(b"".join(ids), "<i4")
    places = np.cumsum(vocab.lengths[ids], dtype=np.int64) - vocab.lengths[ids]
    return ids, places - np.repeat(offsets[:-1], np.diff(before)), before


_LIST = T.ArrayType(T.IntegerType(), False)
ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
                        T.StructField("ids", _LIST), T.StructField("offsets", _LIST)])


def encode_documents(docs: DataFrame, ranks_file: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, offsets) of every row of ``docs`` (doc_id, text): the ids of the whole text
    without special tokens, and the byte of the text at which every id starts."""
    ranks_file, packed = ranks_file or tokenizer_file(), class_table()
    kinds = pa.list_(pa.field("element", pa.int32(), False))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", kinds), ("offsets", kinds)])

    def encode(batches):
        vocab, classes = vocabulary(ranks_file), _classes_of(packed)
        for batch in batches:
            texts = column(batch, "text").cast(pa.large_string())
            bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
            for a, b in _groups(bounds, GROUP_BYTES):
                buffer = texts.buffers()[2]
                data = buffer[int(bounds[a]):int(bounds[b])].to_pybytes() if buffer else b""
                ids, places, before = encode_group(data, bounds[a:b + 1] - bounds[a], vocab, classes)
                cuts = pa.array(before, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    column(batch, "doc_id")[a:b], pa.array(np.diff(before)),
                    pa.ListArray.from_arrays(cuts, pa.array(ids, pa.int32()), type=kinds),
                    pa.ListArray.from_arrays(cuts, pa.array(places, pa.int32()), type=kinds)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(encode, ENCODED)


def decode_documents(encoded: DataFrame, ranks_file: str | None = None) -> DataFrame:
    """``encoded`` with ``ids`` and ``offsets`` replaced by ``decoded``, the ids' bytes; other columns stay."""
    ranks_file = ranks_file or tokenizer_file()
    kept = [f for f in encoded.schema if f.name not in ("ids", "offsets")]

    def decode(batches):
        vocab = vocabulary(ranks_file)
        for batch in batches:
            ids, places = column(batch, "ids"), column(batch, "offsets")
            cuts = ids.offsets.to_numpy()
            flat, spots = ids.values.to_numpy(), places.values.to_numpy()
            shift = places.offsets.to_numpy()[0] - cuts[0]
            out = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                step = 1 << 18
                out.append(b"".join(vocab.decode(flat[i:min(i + step, b)], spots[i + shift:min(i + step, b) + shift])
                                    for i in range(a, b, step)))
            names = [f.name for f in kept]
            yield pa.RecordBatch.from_arrays([column(batch, n) for n in names] + [pa.array(out, pa.binary())],
                                             [*names, "decoded"])

    return encoded.mapInArrow(decode, T.StructType([*kept, T.StructField("decoded", T.BinaryType())]))


def op13_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded: checksums of the ids and of the decoded bytes."""
    encoded = encode_documents(read_table(spark, sf_dir, "documents"))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    decoded = decode_documents(encoded.select("doc_id", "n_tokens", digest.alias("ids_sha256"), "ids", "offsets"))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
