"""Operator 7, document fingerprints: I-Match over several randomised lexicon subsets.

* Lexicon: terms whose inverse document frequency over the whole corpus lies in a chosen band.
  With a band up to ``max_idf`` a term occurs in at least exp(-max_idf) of all documents, so the
  lexicon holds at most (terms per document) x exp(max_idf) terms whatever the corpus size.
* Subsets: bits of a term's hash put it into randomised subsets of falling rates (1 / 2^bits for
  the ``RATES``, ``CLASSES`` subsets each), so that short and long documents both have subsets with a few terms.
* Fingerprint: for every subset, the document's distinct terms there are sorted and hashed; a
  subset without terms leaves an empty field, and so do the subsets of rates too dense for the
  text, which any edit would change.  Sparser rates follow the ``RATES`` until the last one suits a
  text with all terms of the lexicon, so no text is too long for all of them.  Fields are joined by dots.
* Likeness of two fingerprints: equal fields over fields filled in either, 0 if none is.

Everything is DataFrame expressions.  The lexicon reaches the documents as a constant array
indexed by bits of the term hash, so fingerprinting is a projection without a shuffle.

Following texts (``with_next``) need the documents in order of ids: ids are cut at bounds taken
from their quantiles, each cut is ordered by itself, and a document on a bound is also copied to
the cut above it, where it only serves as the last one's follower.

Defined cases: a null text is empty; texts without lexicon terms have only empty fields; equal
texts have equal fingerprints; repeated rows follow each other in order of their texts; a single
document follows itself; an empty table gives no rows; ``fingerprint_texts`` keeps extra columns.
"""

from __future__ import annotations

import json
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glazier.llm.common import read_table, tasks, text_or_empty

# Subset rates as bits of the term hash, subsets per rate, and bits of lexicon cells.
RATES = (3, 5, 7, 9, 11)
CLASSES = 8
CELL_BITS = 14
FULL = 8  # subsets of a rate that takes more terms of a text than this on average are left out
_FIRST_BIT = {bits: sum(RATES[:i]) for i, bits in enumerate(RATES)}
_CELL_AT = sum(RATES)
MIN_IDF, MAX_IDF = math.log(2), math.log(1000)


def _bits(h: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << width) - 1))


def rates_for(terms: int) -> tuple[int, ...]:
    """The RATES and as many sparser ones as texts of up to ``terms`` lexicon terms need."""
    rates = list(RATES)
    while FULL << rates[-1] < terms:
        rates.append(rates[-1] + 2)
    return tuple(rates)


def _subset(h: Column, bits: int) -> Column:
    """Number of a term at a rate: bits of its own up to the last of RATES, of its hash's hash beyond."""
    return _bits(h, _FIRST_BIT[bits], bits) if bits in _FIRST_BIT else _bits(F.xxhash64(h, F.lit(bits)), 0, bits)


class Cells(NamedTuple):
    """A lexicon as a constant column, and the rates its size asks for."""
    known: Column
    rates: tuple[int, ...]


def term_hashes(text: Column) -> Column:
    """Distinct 64-bit hashes of a text's lower-cased words."""
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))
    return F.transform(F.filter(words, lambda w: w != F.lit("")), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, min_idf: float = MIN_IDF, max_idf: float = MAX_IDF) -> DataFrame:
    """Terms (as hashes) with min_idf <= ln(documents / document frequency) <= max_idf,
    in at least two documents."""
    total = docs.select(F.count(F.lit(1)).alias("_docs"))
    found = (docs.select(F.explode(term_hashes(text_or_empty())).alias("term"))
             .groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
    idf = F.log(total.scalar().cast("double") / F.col("df"))
    return found.filter((idf >= F.lit(min_idf)) & (idf <= F.lit(max_idf))).select("term", "df")


def lexicon_cells(terms: DataFrame) -> Cells:
    """The lexicon as a constant: an array of 2^CELL_BITS arrays of term hashes.  Its terms, bounded by
    the band (above), pass through the driver into the plan."""
    cells: list[list[int]] = [[] for _ in range(1 << CELL_BITS)]
    for (term,) in terms.select("term").toLocalIterator():
        cells[(term >> _CELL_AT) & ((1 << CELL_BITS) - 1)].append(term)
    return Cells(F.from_json(F.lit(json.dumps([sorted(c) for c in cells])), "array<array<bigint>>"),
                 rates_for(sum(map(len, cells))))


def fingerprint(text: Column, cells: Cells) -> Column:
    """Fingerprint column of ``text`` given the lexicon as ``lexicon_cells``."""
    def known(h: Column) -> Column:
        return F.array_contains(F.element_at(cells.known, (_bits(h, _CELL_AT, CELL_BITS) + 1).cast("int")), h)

    def field(terms: Column, bits: int, chosen: int) -> Column:
        held = F.filter(terms, lambda h: _subset(h, bits) == F.lit(chosen))
        return F.when(F.size(held) == 0, F.lit("")).otherwise(F.lpad(F.lower(F.hex(
            F.xxhash64(held).bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"))

    def fields(terms: Column, bits: int) -> Column:
        held = terms if 1 << bits <= CLASSES else F.filter(
            terms, lambda h: _subset(h, bits) < F.lit(CLASSES))
        filled = _bound(held, lambda t: F.concat_ws(".", *[field(t, bits, chosen) for chosen in range(CLASSES)]))
        return F.when(F.size(terms) > (FULL << bits), F.lit("." * (CLASSES - 1))).otherwise(filled)

    terms = F.sort_array(F.filter(term_hashes(text), known))
    return _bound(terms, lambda t: F.concat_ws(".", *[fields(t, bits) for bits in cells.rates]))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fingerprint_texts(docs: DataFrame, cells: Cells, text: str = "text", name: str = "fingerprint") -> DataFrame:
    return docs.withColumn(name, fingerprint(text_or_empty(text), cells))


def likeness(a: str, b: str) -> Column:
    """Equal filled fields over fields filled in either fingerprint."""
    pairs = F.arrays_zip(F.split(F.col(a), r"\.").alias("x"), F.split(F.col(b), r"\.").alias("y"))
    same = F.size(F.filter(pairs, lambda p: (p["x"] == p["y"]) & (p["x"] != F.lit(""))))
    filled = F.size(F.filter(pairs, lambda p: (p["x"] != F.lit("")) | (p["y"] != F.lit(""))))
    return F.when(filled == 0, F.lit(0.0)).otherwise(same / filled)


def with_next(docs: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """``docs`` with the values ``columns`` of the next row in descending ``key`` order (the last row:
    of the first) as ``next_<column>``; ``order`` settles equal keys."""
    spark = docs.sparkSession
    cuts = 4 * tasks(spark)
    shares = [i / cuts for i in range(1, cuts)]
    # At most ``cuts`` bounds reach the driver; they are keys of the table.
    bounds = docs.agg(F.percentile_approx(key, shares, 100_000).alias("at"), F.min(key).alias("low"),
                      F.max(key).alias("high")).first()
    if bounds["low"] is None:
        return docs.select("*", *[F.lit(None).cast(docs.schema[c].dataType).alias(f"next_{c}") for c in columns])
    tops = sorted({*bounds["at"], bounds["high"]})
    # Cut of a key: how many tops lie below it.
    known = F.array(*[F.lit(t) for t in tops])
    cut = F.size(F.filter(known, lambda t: t < F.col(key)))
    # The top of cut c also ends cut c+1; the highest key of all ends cut 0.
    copied_to = (cut + 1) % F.lit(len(tops))
    places = F.when(F.array_contains(known, F.col(key)),
                    F.array(F.struct(cut.alias("cut"), F.lit(0).alias("copy")),
                            F.struct(copied_to.alias("cut"), F.lit(1).alias("copy")))) \
        .otherwise(F.array(F.struct(cut.alias("cut"), F.lit(0).alias("copy"))))
    placed = docs.withColumn("_place", F.explode(places)).select("*", "_place.cut", "_place.copy").drop("_place")
    # Copies come last in a cut, in their own order.
    line = Window.partitionBy("cut").orderBy("copy", F.col(key).desc(), *order)
    return (placed.select("*", *[F.lead(c).over(line).alias(f"next_{c}") for c in columns])
            .filter("copy = 0").drop("cut", "copy"))


def op7_imatch_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with likenesses."""
    docs = read_table(spark, sf_dir, "documents")
    cells = lexicon_cells(lexicon(docs))
    base = docs.select("doc_id", text_or_empty().alias("text"))
    pairs = with_next(fingerprint_texts(base, cells), "doc_id", ["text", "fingerprint"], ["text"])
    n, k = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = pairs.select(
        "doc_id", "fingerprint", "next_fingerprint", n.cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), n - k), F.substring("next_text", F.lit(1), k)).alias("edited"))
    out = fingerprint_texts(edited.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)),
                            cells, "edited", "edited_fingerprint")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                      likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
                      likeness("fingerprint", "next_fingerprint").alias("near_next"))
