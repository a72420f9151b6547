"""Operator 6, toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, maps homoglyphs (Cyrillic, Greek, full-width) to Latin letters, and maps digits,
signs and look-alike letters inside words to one letter each, so ``1D10T`` and ``idiot`` are the same.

Learning (``learn_lexicon``) uses labelled rows only, at most ``max_rows`` of them, half of either
label (a bounded sample in hash order).  Rows of one label with the same least hash of three words
are copies of each other and count once.  Candidate terms are beginnings of folded words (at least
``MIN_STEM`` letters, up to the whole word; shorter words only whole) that toxic texts use many times
as often for their length, beyond chance by the number of texts and of uses (likelihood ratios, held
against the number of terms tested).  They are taken in the order of that evidence; of terms that
begin each other the first stays.  A term's weight is the log ratio of its rates.  Exception phrases
are a lexicon word with its neighbour that clean texts use and toxic ones do not; given ones are added.

Scoring (``score_documents``) is one narrow pass over whole texts: the automaton reports terms at
word starts, and matches inside an exception phrase do not count.  The weights found are held against
what a text must show: ``base``, the prior odds, and ``half`` for each unit of its length, the rate at
which toxic texts use the lexicon.  score = found / (found + base + half * length).

Defined cases: a null or empty text scores 0; without toxic labels the lexicon is empty and every
score 0; repeated labels of a document count once, a document with both labels as toxic; repeated
rows are scored each; an empty table gives no rows; extra columns are kept but for output names.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glazier.llm.common import batch_of, column, read_table, stored

# Look-alikes of Latin letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k",
    "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ɡ": "g", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i",
    "κ": "k", "τ": "t", "υ": "u", "ı": "i"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
               "|": "i", "l": "i"}
FULL_WIDTH = {chr(c): chr(c - 0xFEE0).lower() for c in range(0xFF01, 0xFF5F)}
_FOLD = str.maketrans({**SUBSTITUTES, **HOMOGLYPHS, **{k: SUBSTITUTES.get(v, v) for k, v in FULL_WIDTH.items()},
                       "​": "", "­": ""})
_WORD = re.compile(r"[^\W_]+")
MIN_STEM = 4
LENGTH_UNIT = 6  # characters counted as one word
MARGIN = 10  # odds against toxicity besides the prior ones, so that clean texts are left alone


def fold(text: str) -> str:
    return text.lower().translate(_FOLD)


@dataclass
class Lexicon:
    """Folded word beginnings (with a last space: whole words) with weights, folded exception phrases, and the
    weight that scores one half: ``base`` and ``half`` for each unit of length."""
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    half: float = 0.01
    base: float = 0.0

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True)


def folded_words(text: str) -> list[str]:
    return _WORD.findall(fold(text))


def _stems(word: str) -> list[str]:
    return [word[:n] for n in range(MIN_STEM, len(word) + 1)] or [word + " "]


class Matcher:
    """Aho-Corasick automaton over a lexicon's terms and exception phrases."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick
        self.half, self.base = lexicon.half, lexicon.base
        self.machine = ahocorasick.Automaton()
        for term, weight in lexicon.weights.items():
            self.machine.add_word(term.rstrip(), (len(term.rstrip()), weight, term.endswith(" ")))
        for phrase in lexicon.exceptions:
            # A phrase that is itself a term is never a term any more.
            self.machine.add_word(phrase, (len(phrase), 0.0, True))
        if lexicon.weights:
            self.machine.make_automaton()
        self.empty = not lexicon.weights

    def found(self, folded: str) -> float:
        """Weights of the terms found at word starts, without those inside exception phrases."""
        best: dict[int, float] = {}
        spared = []
        for end, (length, weight, whole) in self.machine.iter(folded):
            start = end - length + 1
            if start and folded[start - 1].isalnum():
                continue
            if whole and end + 1 < len(folded) and folded[end + 1].isalnum():
                continue
            if weight:
                best[start] = max(weight, best.get(start, 0.0))
            else:
                spared.append((start, end))
        for low, high in spared:
            for start in [s for s in best if low <= s <= high]:
                del best[start]
        return sum(best.values())

    def score(self, text: str) -> float:
        if self.empty or not text:
            return 0.0
        folded = fold(text)
        found = self.found(folded)
        return found / (found + self.base + self.half * (1 + len(folded) / LENGTH_UNIT)) if found else 0.0


def learn_lexicon(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000, least: int = 3, ratio: float = 10.0,
                  exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Lexicon from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); reads no other column.

    ``max_rows`` bounds the labelled rows; a term needs ``least`` toxic texts and ``ratio`` times the clean rate.
    The driver holds the terms that pass the tests.
    """
    known = (labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id")
             .agg((F.max(F.col("toxic").cast("int")) == 1).alias("toxic")))
    rows = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two numbers
    if not rows.get(True):
        return Lexicon()
    taken = [known.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows // 2)
             for kind in (True, False)]
    sample = stored(_families(
        docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .join(F.broadcast(taken[0].unionByName(taken[1])), "doc_id").select("toxic", "text")),  # at most max_rows label rows
        "toxicity-sample")
    size = {r["toxic"]: (r["texts"], r["units"]) for r in sample.groupBy("toxic").agg(
        F.count(F.lit(1)).alias("texts"), F.sum(1 + F.length("text") / LENGTH_UNIT).alias("units")).collect()}
    if True not in size:
        return Lexicon()
    (toxic, toxic_units), (clean, clean_units) = size[True], size.get(False, (1, 1.0))
    counts = _counted(sample, lambda text: Counter(t for w in folded_words(text) for t in _stems(w)))
    tried = stored(counts.filter(F.col("toxic_docs") >= least), "toxicity-terms")
    need = 2 * math.log(max(tried.count(), 1) / 0.05)
    rise = (F.log((F.col("toxic_uses") + 0.5) / toxic_units) - F.log((F.col("clean_uses") + 0.5) / clean_units))
    by_texts = _evidence(F.col("toxic_docs"), toxic, F.col("clean_docs"), clean)
    by_uses = _rate_evidence(F.col("toxic_uses"), toxic_units, F.col("clean_uses"), clean_units)
    passed = tried.withColumns({"by_texts": by_texts, "by_uses": by_uses}).filter(
        (rise >= math.log(ratio)) & ((F.col("by_texts") >= need) | (F.col("by_uses") >= need) & (F.col("by_texts") >= SOME)))
    weights, rate = {}, 0.0
    for r in choose_terms(passed.select("term", "toxic_uses", "clean_uses", "by_uses").collect()):
        weights[r["term"]] = round(math.log((r["toxic_uses"] + 0.5) / (toxic_units + 1))
                                   - math.log((r["clean_uses"] + 0.5) / (clean_units + 1)), 6)
        rate += r["toxic_uses"] / toxic_units - r["clean_uses"] / clean_units
    lexicon = Lexicon(weights)
    if weights:
        lexicon.exceptions = sorted({fold(p) for p in exceptions} | _exception_phrases(sample, lexicon))
        # A text whose weights just meet the odds and the rate scores 0.7.
        odds = max(0.0, math.log(MARGIN * (rows.get(False, 0) + 0.5) / (rows[True] + 0.5)))
        lexicon.base, lexicon.half = odds * 3 / 7, rate * 3 / 7
    return lexicon


SOME = 10.83  # likelihood ratio by texts that one term in 1,000 reaches by chance


def _families(rows: DataFrame) -> DataFrame:
    """One text of each family of copies: those of a label with the same least hash of three words."""
    schema = pa.schema([("toxic", pa.bool_()), ("text", pa.string()), ("family", pa.int64())])

    def named(batches):
        for batch in batches:
            texts = column(batch, "text").to_pylist()
            words = [folded_words(t) for t in texts]
            yield batch_of(schema, column(batch, "toxic"), texts, [
                min((zlib.crc32(" ".join(w[i:i + 3]).encode()) for i in range(max(1, len(w) - 2)))) for w in words])

    return (rows.mapInArrow(named, "toxic boolean, text string, family long").groupBy("toxic", "family")
            .agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("toxic", "text"))


def _share(count: Column, part: Column) -> Column:
    return F.when(count > 0, count * F.log(part)).otherwise(0.0)


def _evidence(a: Column, n: int, b: Column, m: int) -> Column:
    """Likelihood ratio statistic of a of n texts against b of m."""
    mean = (a + b) / F.lit(float(n + m))
    return 2 * (_share(a, F.try_divide(a / float(n), mean)) + _share(n - a, F.try_divide(1 - a / float(n), 1 - mean))
                + _share(b, F.try_divide(b / float(m), mean)) + _share(m - b, F.try_divide(1 - b / float(m), 1 - mean)))


def _rate_evidence(a: Column, u: float, b: Column, v: float) -> Column:
    """The same of a uses in length u against b in v."""
    mean = (a + b) / F.lit(u + v)
    return 2 * (_share(a, F.try_divide(a / u, mean)) + _share(b, F.try_divide(b / v, mean)))


def _counted(sample: DataFrame, features) -> DataFrame:
    """Toxic and clean texts and uses of every feature, counted per batch before the shuffle."""
    names = ["toxic_docs", "clean_docs", "toxic_uses", "clean_uses"]
    schema = pa.schema([("term", pa.string()), *((n, pa.int64()) for n in names)])

    def count(batches):
        for batch in batches:
            seen, uses = {True: Counter(), False: Counter()}, {True: Counter(), False: Counter()}
            for toxic, text in zip(column(batch, "toxic").to_pylist(), column(batch, "text").to_pylist()):
                found = features(text)
                seen[toxic].update(found.keys())
                uses[toxic].update(found)
            terms = sorted(seen[True].keys() | seen[False].keys())
            yield batch_of(schema, terms, *([held[kind][t] for t in terms] for held in (seen, uses) for kind in (True, False)))

    return (sample.mapInArrow(count, "term string, " + ", ".join(f"{n} long" for n in names)).groupBy("term")
            .agg(*(F.sum(n).alias(n) for n in names)))


def choose_terms(rows: list) -> list:
    """Rows (term, by_uses) in the order of their evidence, the longest of equals first, without terms that begin
    a chosen one or that a chosen one begins."""
    chosen, begun, kept = set(), set(), []
    for r in sorted(rows, key=lambda r: (-r["by_uses"], -len(r["term"]), r["term"])):
        word = r["term"].rstrip()
        starts = {word[:n] for n in range(1, len(word) + 1)}
        if word not in begun and not starts & chosen:
            chosen.add(word)
            begun |= starts
            kept.append(r)
    return kept


def _exception_phrases(sample: DataFrame, lexicon: Lexicon, least: int = 2) -> set[str]:
    """Two-word phrases with a lexicon word that ``least`` clean texts of the sample use and no toxic one."""
    terms = tuple(t for t in lexicon.weights if not t.endswith(" "))
    whole = {t.rstrip() for t in lexicon.weights if t.endswith(" ")}

    def phrases(text: str) -> Counter:
        words = folded_words(text)
        listed = [w.startswith(terms) or w in whole for w in words]
        return Counter(f"{words[i]} {words[i + 1]}" for i in range(len(words) - 1) if listed[i] or listed[i + 1])

    found = _counted(sample, phrases).filter((F.col("toxic_docs") == 0) & (F.col("clean_docs") >= least))
    return {r["term"] for r in found.select("term").collect()}


_MATCHERS: dict[str, Matcher] = {}


def _matcher(described: str) -> Matcher:
    """One automaton per worker process and lexicon."""
    if described not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[described] = Matcher(Lexicon(**json.loads(described)))
    return _MATCHERS[described]


def score_documents(docs: DataFrame, lexicon: Lexicon, text: str = "text", name: str = "score",
                    keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (None: all) of ``docs`` and the toxicity score of the whole texts."""
    described = lexicon.to_json()
    docs = docs.drop(name)
    keep = [c for c in (docs.columns if keep is None else keep)]
    kinds = docs.select(*keep).schema.add(name, "double")

    def score(batches):
        matcher = _matcher(described)
        for batch in batches:
            scores = [matcher.score(t or "") for t in column(batch, text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in keep], pa.array(scores, pa.float64())],
                                             [*keep, name])

    return docs.mapInArrow(score, kinds)


THRESHOLD = 0.7


def held_out(doc_id) -> F.Column:
    """Rows that learning never sees: crc32 of the id as text leaves 1 by 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def op6_toxic_lexicon(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out(F.col("doc_id")))
    scored = score_documents(docs, learn_lexicon(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored below the threshold, with their columns."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out(F.col("doc_id")))
    lexicon = learn_lexicon(docs, labels)
    return score_documents(docs, lexicon, name="_toxicity").filter(F.col("_toxicity") < THRESHOLD).drop("_toxicity")
