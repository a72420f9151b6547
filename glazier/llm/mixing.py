"""Operator 4, mixing sources to target weights by iterative proportional fitting.

1. Every document gets its token weight (words) and a topic.  Topics are those of a small k-means
   model of hashed word counts less the mean of the document's language class, so that topics cross
   languages.  Texts are read once into stored word counts; means and rounds are sums over the
   distinct ones of all documents, so copies count once.  Sums are of whole numbers: no order of
   tasks changes a topic.
2. Token weights are summed per cell of the target classes: source x language x topic.  Every source
   has a target: those without one of their own share that of ``*`` by their tempered shares.  Languages
   without one share the class ``*``.  The cells, sources x targets, pass through the driver.
3. Raking: the cell weights are scaled to each marginal in turn until all agree with the targets.
   Classes without documents leave their share to the others of their marginal.  Targets that no
   weights meet together are warned of with the largest miss; the last marginal (topic) is met then.
4. A document's probability is the raked weight of its cell over the cell's tokens, scaled so that the
   expected sample holds ``budget`` of all tokens; probabilities stop at 1 and the others make up for it.
5. A document is sampled if a uniform number drawn from its id lies below its probability, so the
   same document is drawn the same way again after a lost task.

Defined cases: null values count as the class ``*`` (or none if there is no such class: weight 0);
null or empty texts have weight 0 and the probability of their cell; repeated rows are drawn alike, and
documents without an id by their text; an
empty table gives no rows; extra columns are kept but for output names.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glazier.llm.common import column, mix64, read_table, stored
from glazier.llm.shingles import word_hashes

REST = "*"
TOPICS, TOPIC_CELLS = 6, 256
# Production targets: shares of tokens by source and language.
TARGETS = {
    "source": {"src0": 0.15, "src1": 0.06, "src2": 0.06, "src3": 0.06, REST: 0.67},
    "lang": {"en": 0.55, "de": 0.16, "fr": 0.16, "es": 0.11, REST: 0.02},
}
TOPIC_TEMPER = 0.8  # topic targets, and sources within *: shares of tokens to this power
BUDGET = 0.5
MISSED = 1e-6
_UNIT = 2.0**30  # vectors are summed as whole numbers of 1 / _UNIT: 2^33 documents fit a sum


def _word_counts(words: np.ndarray) -> bytes:
    """Hashed word counts, each in as few bytes as the largest one needs."""
    counts = np.bincount((words & np.uint64(TOPIC_CELLS - 1)).astype(np.int64), minlength=TOPIC_CELLS)
    return counts.astype(np.min_scalar_type(counts.max())).tobytes()


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1.0)


def _word_vectors(counts: list[bytes]) -> np.ndarray:
    """Unit vectors of the square roots of word counts."""
    rows = [np.frombuffer(c, f"u{len(c) // TOPIC_CELLS}").astype(float) for c in counts]
    return _unit(np.sqrt(np.array(rows).reshape(-1, TOPIC_CELLS)))


def _texts(batch: pa.RecordBatch, text: str) -> list[bytes | None]:
    return column(batch, text).cast(pa.binary()).to_pylist()


def _known(value, targets: dict[str, float]):
    return value if value in targets and value != REST else REST


class Topics:
    """Mean word vectors of the language classes, and topic centres of what differs from them."""

    def __init__(self, means: dict[str, np.ndarray], centres: np.ndarray):
        self.means, self.centres = means, centres

    def differences(self, counts: list[bytes], langs: list[str]) -> np.ndarray:
        none = np.zeros(TOPIC_CELLS)
        return _word_vectors(counts) - np.array([self.means.get(g, none) for g in langs]).reshape(-1, TOPIC_CELLS)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        # Row by row sums, so that a document's topic does not depend on its batch.
        return np.stack([(x * c).sum(axis=1) for c in self.centres], axis=1).argmax(axis=1)

    def of(self, counts: list[bytes], langs: list[str]) -> np.ndarray:
        return self.nearest(self.differences(counts, langs))


def _sums(vectors: DataFrame, grouped) -> dict[str, tuple[np.ndarray, int]]:
    """Sums and numbers of the vectors of every group; ``grouped`` gives a batch's groups and vectors.  A task
    passes on one row a group, and the groups' sums reach the driver."""
    def add(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            names, x = grouped(column(batch, "counts").to_pylist(), column(batch, "lang").to_pylist())
            x = np.column_stack([np.rint(x * _UNIT).astype(np.int64), np.ones(len(x), np.int64)])
            for k in sorted(set(names.tolist())):
                held[str(k)] = held.get(str(k), 0) + x[names == k].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(
            [v.tolist() for v in held.values()], pa.list_(pa.int64()))], ["name", "parts"])

    rows = (vectors.mapInArrow(add, "name string, parts array<long>").select("name", F.posexplode("parts").alias("at", "part"))
            .groupBy("name", "at").agg(F.sum("part").alias("part")).collect())
    found = {r["name"]: np.zeros(TOPIC_CELLS + 1, np.int64) for r in rows}
    for r in rows:
        found[r["name"]][r["at"]] = r["part"]
    return {k: (v[:-1] / _UNIT, int(v[-1])) for k, v in found.items()}


def fit_topics(measured: DataFrame, langs: dict[str, float], lang: str = "lang", topics: int = TOPICS, rounds: int = 20,
               seed: int = 4) -> Topics:
    """Topics from the distinct word counts of all rows of ``profile``."""
    vectors = stored(measured.select(F.coalesce(_class(lang, langs), F.lit(REST)).alias("lang"), "counts").distinct(), "vectors")
    sums = _sums(vectors, lambda counts, of: (np.array(of, dtype=object), _word_vectors(counts)))
    model = Topics({k: total / n for k, (total, n) in sorted(sums.items())},
                   _unit(np.random.default_rng(seed).standard_normal((topics, TOPIC_CELLS))))

    def near(counts, of):
        x = _unit(model.differences(counts, of))
        return model.nearest(x), x

    for _ in range(rounds if sums else 0):
        centres = model.centres.copy()
        for k, (total, _n) in _sums(vectors, near).items():
            centres[int(k)] = total
        centres = _unit(centres)
        if (centres == model.centres).all():
            break
        model = Topics(model.means, centres)
    return model


def _profiles(batch: pa.RecordBatch, text: str, key: str, seed: int):
    """Token weights, word counts and uniform numbers of a batch's documents."""
    weights, counts = [], []
    for t in _texts(batch, text):
        words = word_hashes(t or b"")
        weights.append(len(words))
        counts.append(_word_counts(words))
    ids = column(batch, key).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False).copy()
    missing = np.flatnonzero(column(batch, key).is_null().to_numpy(zero_copy_only=False))
    if len(missing):  # documents without an id are drawn by their text, each text apart
        texts = column(batch, text).take(pa.array(missing)).to_pylist()
        ids[missing] = [xxhash.xxh3_64_intdigest((t or "").encode()) - 2**63 for t in texts]
    uniform = (mix64(ids.view(np.uint64) * np.uint64(2) + mix64(np.array([seed], np.uint64))) >> np.uint64(11)) / 2.0**53
    return weights, counts, uniform


def profile(docs: DataFrame, keep: list[str], text: str = "text", key: str = "doc_id", seed: int = 4) -> DataFrame:
    """The columns ``keep`` of ``docs`` with n_words, counts (of hashed words) and the document's uniform number."""
    kinds = docs.select(*keep).schema.add("n_words", "long").add("counts", "binary").add("uniform", "double")

    def measure(batches):
        for batch in batches:
            weights, counts, uniform = _profiles(batch, text, key, seed)
            yield pa.RecordBatch.from_arrays(
                [*[column(batch, c) for c in keep], pa.array(weights, pa.int64()), pa.array(counts, pa.binary()),
                 pa.array(uniform)], [*keep, "n_words", "counts", "uniform"])

    return docs.mapInArrow(measure, kinds)


def with_topics(measured: DataFrame, topics: Topics, langs: dict[str, float], lang: str = "lang") -> DataFrame:
    """Rows of ``profile`` with their topic (as text) in place of the counts."""
    kept = [c for c in measured.columns if c not in ("counts", "uniform")]
    kinds = measured.select(*kept).schema.add("topic", "string").add("uniform", "double")

    def name(batches):
        for batch in batches:
            found = topics.of(column(batch, "counts").to_pylist(), [_known(g, langs) for g in column(batch, lang).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*[column(batch, c) for c in kept], pa.array([str(k) for k in found], pa.string()), column(batch, "uniform")],
                [*kept, "topic", "uniform"])

    return measured.mapInArrow(name, kinds)


def rake(tokens: np.ndarray, classes: list[np.ndarray], targets: list[np.ndarray], rounds: int = 500,
         within: float = 1e-9) -> np.ndarray:
    """Cell weights with the given marginal shares, as near the cells' tokens as proportional fitting
    leaves them.  ``classes[d]`` is each cell's class number in marginal d, ``targets[d]`` the shares.
    Warns if a share is missed by more than ``MISSED`` after all rounds."""
    weights = tokens.astype(float) / max(tokens.sum(), 1)
    wanted = []
    for c, t in zip(classes, targets):
        held = np.bincount(c, weights=weights, minlength=len(t)) > 0
        share = np.where(held, t, 0.0)
        wanted.append(share / share.sum() if share.sum() else share)
    for _ in range(rounds):
        worst = 0.0
        for c, t in zip(classes, wanted):
            now = np.bincount(c, weights=weights, minlength=len(t))
            factor = np.divide(t, now, out=np.zeros_like(t), where=now > 0)
            worst = max(worst, float(np.abs(now - t).max()))
            weights = weights * factor[c]
        if worst < within:
            break
    missed = [float(np.abs(np.bincount(c, weights=weights, minlength=len(t)) - t).max()) for c, t in zip(classes, wanted)]
    if max(missed, default=0.0) > MISSED:
        warnings.warn(f"targets conflict: after {rounds} rounds the marginals miss theirs by up to "
                      + ", ".join(f"{m:.2g}" for m in missed), stacklevel=2)
    return weights


def probabilities(tokens: np.ndarray, weights: np.ndarray, budget: float) -> np.ndarray:
    """Inclusion probabilities min(1, c * weight / tokens) whose expected tokens are ``budget`` of all."""
    ratio = np.divide(weights, tokens, out=np.zeros(len(tokens)), where=tokens > 0)
    goal = budget * tokens.sum()
    full = np.zeros(len(tokens), bool)
    scale = 0.0
    for _ in range(len(tokens) + 1):
        open_weight = (ratio * tokens)[~full].sum()
        if open_weight <= 0:
            break
        scale = (goal - tokens[full].sum()) / open_weight
        over = ~full & (ratio * scale > 1)
        if not over.any():
            break
        full |= over
    return np.where(full, 1.0, np.clip(ratio * scale, 0.0, 1.0))


def _class(name: str, targets: dict[str, float]):
    own = [v for v in targets if v != REST]
    value = F.col(name).cast("string")
    return F.when(value.isin(own), value).otherwise(F.lit(REST if REST in targets else None))


def calibrate(profiles: DataFrame, targets: dict[str, dict[str, float]], budget: float, tokens: str = "n_words"):
    """Cells as rows (classes ..., tokens, weight, probability): at most the product of the targets' sizes."""
    names = list(targets)
    rows = (profiles.groupBy(*[_class(n, targets[n]).alias(n) for n in names])
            .agg(F.sum(tokens).alias("tokens")).orderBy(*names).collect())
    rows = [r for r in rows if all(r[n] is not None for n in names)]
    held = np.array([r["tokens"] for r in rows], float)
    classes = [np.array([list(targets[n]).index(r[n]) for r in rows], np.int64) for n in names]
    weights = rake(held, classes, [np.array(list(targets[n].values()), float) for n in names]) if rows else held
    chances = probabilities(held, weights, budget) if rows else held
    return [(*[r[n] for n in names], int(r["tokens"]), float(w), float(p)) for r, w, p in zip(rows, weights, chances)]


def mix_documents(profiles: DataFrame, targets: dict[str, dict[str, float]], budget: float) -> DataFrame:
    """``profiles`` with weight (share of the mix per token of the document's cell), probability and sampled."""
    spark, names = profiles.sparkSession, list(targets)
    cells = calibrate(profiles, targets, budget)
    kinds = ", ".join([*[f"_{n} string" for n in names], "_tokens long", "_weight double", "probability double"])
    found = profiles.withColumns({f"_{n}": _class(n, targets[n]) for n in names}).join(
        F.broadcast(spark.createDataFrame(cells, kinds)), [f"_{n}" for n in names], "left")
    chance = F.coalesce("probability", F.lit(0.0))
    return (found.withColumn("weight", F.coalesce(F.col("_weight") / F.nullif(F.col("_tokens"), F.lit(0)), F.lit(0.0)))
            .withColumn("probability", chance).withColumn("sampled", F.col("uniform") < chance)
            .drop(*[f"_{n}" for n in names], "_tokens", "_weight"))


def tempered(profiles: DataFrame, name: str, power: float, tokens: str = "n_words") -> dict[str, float]:
    """Targets of a column with few values: its shares of tokens to a power below 1, which evens them out."""
    held = {r[name]: float(r["n"]) for r in profiles.groupBy(name).agg(F.sum(tokens).alias("n")).collect() if r["n"]}
    parts = {k: (n / sum(held.values())) ** power for k, n in sorted(held.items())}
    return {k: p / sum(parts.values()) for k, p in parts.items()} or {REST: 1.0}


def spread(profiles: DataFrame, name: str, targets: dict[str, float], power: float, tokens: str = "n_words") -> dict[str, float]:
    """``targets`` with the share of ``*`` dealt to the column's other values by their tempered shares; nulls keep
    the class ``*``."""
    value = F.col(name).cast("string")
    own = [v for v in targets if v != REST]
    others = tempered(profiles.withColumn(name, F.coalesce(value, F.lit(REST))).filter(~F.col(name).isin(own)), name, power, tokens)
    return {**{v: targets[v] for v in own}, **{v: targets[REST] * p for v, p in others.items()}}


def _production(docs: DataFrame) -> tuple[Topics, DataFrame, dict[str, dict[str, float]]]:
    """Topics, stored profiles of all documents, and the production targets."""
    measured = stored(profile(docs, ["doc_id", "source", "lang"]), "word-counts")
    topics = fit_topics(measured, TARGETS["lang"])
    profiles = stored(with_topics(measured, topics, TARGETS["lang"]), "profiles")
    return topics, profiles, {**TARGETS, "source": spread(profiles, "source", TARGETS["source"], TOPIC_TEMPER),
                              "topic": tempered(profiles, "topic", TOPIC_TEMPER)}


def op4_ipf_mixing(spark, sf_dir: str) -> DataFrame:
    """Weight, probability and draw of all documents for the production targets."""
    _, profiles, targets = _production(read_table(spark, sf_dir, "documents"))
    return mix_documents(profiles, targets, BUDGET).drop("uniform")


def sample_mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents drawn for the production targets, with their columns."""
    topics, profiles, targets = _production(docs)
    chances = {cell[:3]: cell[-1] for cell in calibrate(profiles, targets, BUDGET)}
    langs = targets["lang"]

    def draw(batches):
        for batch in batches:
            _, counts, uniform = _profiles(batch, "text", "doc_id", 4)
            spoken = column(batch, "lang").to_pylist()
            found = topics.of(counts, [_known(g, langs) for g in spoken])
            rows = zip(column(batch, "source").to_pylist(), spoken, [str(k) for k in found])
            classes = [tuple(_known(v, targets[n]) for n, v in zip(targets, row)) for row in rows]
            yield batch.filter(pa.array([u < chances.get(c, 0.0) for c, u in zip(classes, uniform)], pa.bool_()))

    return docs.mapInArrow(draw, docs.schema)
