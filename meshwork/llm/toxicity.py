"""A toxicity classifier with a counterfactual penalty.

Features of a text are the presence of words and of word beginnings ("lower*"), and that several words begin
so ("lower*3": three or more, repeats included). Those that tell toxic from other labelled texts best are
chosen by their log-odds over their standard error, from counts over the training texts; identity terms
are always among them. A logistic regression is fitted to the labels with a penalty on score changes: for
each training text that names a group, the term is swapped for others of its kind or left out, and the
squared difference of the scores is added to the loss. So a neutral mention of a group adds no score. A
swap changes the features of the two terms and nothing else, so swaps are counted by the two terms, and
texts by their label and features, before they reach the driver: what it gets is bounded by the sample's
rows and the features chosen, not by the texts' length.

Fitting uses at most SAMPLE_ROWS labelled rows, chosen by the hash of their id; scoring runs over
every whole text. Null and empty texts have no features and get the score of the intercept.
Null labels are left out; of repeated labels the highest counts. Without training rows of both
kinds there is nothing to tell apart: every score is 0. Words of over LONGEST_WORD characters, as texts
without blanks have, count by their runs of RUN characters, all along. Repeated rows give repeated results; an empty table gives
an empty one; columns other than those named are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.rows import id_type, keyed, map_slices, strings

#: Labelled rows used to fit, at most.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
BEGINNINGS = (4, 5, 6)
SEVERAL = (2, 3, 5)
LONGEST_WORD, RUN = 40, 4

# Identity terms, by kind; a term is swapped for others of its kind.
IDENTITY_TERMS = {
    "gender": ("women", "men", "girls", "boys", "woman", "man", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    "religion": ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "christian", "muslim", "jewish", "hindu", "buddhist", "catholic"),
    "origin": ("african", "american", "asian", "european", "arab", "mexican", "chinese", "indian", "german", "french", "spanish", "turkish", "immigrants", "refugees", "natives"),
    "colour": ("black", "white", "brown"),
    "orientation": ("gay", "lesbian", "straight", "bisexual", "heterosexual", "homosexual", "transgender"),
    "age": ("young", "old", "elderly", "teenage"),
    "ability": ("blind", "deaf", "disabled", "paralyzed"),
}
KIND_OF = {t: k for k, terms in IDENTITY_TERMS.items() for t in terms}
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> Counter[str]:
    """Runs of letters and digits of any script, in lower case, and how often each is there."""
    return Counter(WORD.findall(text.lower()))


def names_of(word: str) -> tuple[list[str], list[str]]:
    """The features that a word brings about, and the beginnings that are counted over all words."""
    if len(word) > LONGEST_WORD:
        return ["~" + word[k : k + RUN] for k in range(len(word) - RUN + 1)], []
    return [word], [word[:n] + "*" for n in BEGINNINGS if len(word) > n] if word not in KIND_OF else []


def features_of(words: Counter[str]) -> set[str]:
    own, begun = set(), Counter()
    for word, n in words.items():
        names, beginnings = names_of(word)
        own.update(names)
        for x in beginnings:
            begun[x] += n
    return own | begun.keys() | {f"{x}{k}" for x, n in begun.items() if n > 1 for k in SEVERAL if n >= k}


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = 0.0

    def scorer(self):
        """A function from text to score. A feature counts once a text."""
        place = {n: k for k, n in enumerate(self.weights)}
        weight = np.array([*self.weights.values(), 0.0])

        levels = (("", 1), *((str(k), k) for k in SEVERAL))
        begun = {x: [(n, place[x + level]) for level, n in levels if x + level in place] for x in {k[: k.index("*") + 1] for k in place if "*" in k}}

        class Known(dict):
            """Word -> (places of its features, the beginnings of it that count)."""

            def __missing__(self, word: str):
                if len(self) > 500_000:
                    self.clear()
                names, beginnings = names_of(word)
                got = (tuple({place[n] for n in names if n in place}), tuple(x for x in beginnings if x in begun))
                got = got if any(got) else None
                if len(word) <= LONGEST_WORD:
                    self[word] = got
                return got

        known = Known()

        def score(text: str) -> float:
            found, several = set(), {}
            for word, n in words_of(text).items():
                got = known[word]
                if got:
                    found.update(got[0])
                    for x in got[1]:
                        several[x] = several.get(x, 0) + n
            found.update(at for x, n in several.items() for least, at in begun[x] if n >= least)
            # In order, so that a score does not depend on that of a set.
            z = self.intercept + float(weight[sorted(found)].sum()) if found else self.intercept
            return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that never teach: crc32 of the id as text, modulo 3, is 1. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """(label, text) of the sample. Its ids are few enough to broadcast."""
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    few = one.orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(rows)
    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).join(F.broadcast(few), id_col).select("label", "text")


def count_features(rows: DataFrame) -> DataFrame:
    """name, toxic, other: in how many training texts a feature is. Counted within tasks first."""

    def run(batches):
        toxic, other = Counter(), Counter()

        def out():
            names = list(toxic.keys() | other.keys())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()), pa.array([other[n] for n in names], pa.int64())], ["name", "toxic", "other"])

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
                (toxic if label else other).update(features_of(words_of(text)))
                if len(toxic) + len(other) > 400_000:
                    yield out()
                    toxic.clear()
                    other.clear()
        yield out()

    return rows.mapInArrow(run, "name string, toxic long, other long").groupBy("name").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def choose_features(counts: DataFrame, n_toxic: int, n_other: int, least_z: float = 3.0) -> list[str]:
    """All that tell the kinds apart; the sample bounds their number."""
    a, b = F.col("toxic") + 0.5, F.col("other") + 0.5
    odds = F.log(a / (n_toxic + 1 - a)) - F.log(b / (n_other + 1 - b))
    z = odds / F.sqrt(1 / a + 1 / b)
    chosen = counts.select("name", z.alias("z")).where(F.abs("z") >= least_z)
    return [r[0] for r in chosen.orderBy(F.abs("z").desc(), "name").collect()]


def swaps(words: Counter[str]) -> list[tuple[str, str | None]]:
    """Each identity term of a text with each other one of its kind that it is exchanged for, and with None where it
    is left out (else the weights of all terms could rise together) or the other one is there already."""
    out = []
    for term in sorted(words.keys() & KIND_OF.keys()):
        out += [(term, None if other in words else other) for other in IDENTITY_TERMS[KIND_OF[term]] if other != term] + [(term, None)]
    return out


def design(rows: DataFrame, names: list[str]) -> DataFrame:
    """label, x (places of the features present), n: texts with these; and, with a null label, x of two places, of a
    term and of the one that it is swapped for (-1: none), n: how often."""
    place = {n: k for k, n in enumerate(names)} | {None: -1}

    def run(batches):
        for batch in batches:
            texts = [words_of(t) for t in strings(batch.column(1))]
            x = [sorted(place[n] for n in features_of(words) if n in place) for words in texts]
            pairs = Counter((place[a], place[b]) for words in texts for a, b in swaps(words))
            labels = [*batch.column(0).to_pylist(), *[None] * len(pairs)]
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array([*x, *map(list, pairs)], pa.list_(pa.int32())), pa.array([*[1] * len(x), *pairs.values()], pa.int64())], ["label", "x", "n"])

    return rows.mapInArrow(run, "label int, x array<int>, n long").groupBy("label", "x").agg(F.sum("n").alias("n"))


def train(labels: np.ndarray, x: list, n: np.ndarray, pairs: np.ndarray, n_features: int, fairness: float = 1.0, ridge: float = 3e-5, steps: int = 400, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise mean log loss + ridge * |w|^2 + fairness * mean squared
    difference of scores (log-odds) over swaps. x: places of the features of a kind of text, of which there are n;
    pairs: rows of term, other term (-1: none) and the number of such swaps. Adam on the whole sample."""
    total = float(n.sum())
    lens = np.array([len(r) for r in x], np.int64)
    rows, cols = np.repeat(np.arange(len(x)), lens), np.fromiter((k for r in x for k in r), np.int64, int(lens.sum()))
    term, other, often = np.asarray(pairs, np.int64).reshape(-1, 3).T
    other = np.where(other < 0, n_features, other)
    y = labels.astype(float)
    toxic = float(n[labels].sum())
    w, b = np.zeros(n_features), float(np.log((toxic + 1) / (total - toxic + 1)))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(rows, w[cols], len(x))
        d = n * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / total
        grad = np.bincount(cols, d[rows], n_features) + 2 * ridge * w
        if len(term):
            padded = np.append(w, 0.0)
            gap = 2 * fairness * often / often.sum() * (padded[term] - padded[other])
            grad += np.bincount(term, gap, n_features) - np.bincount(other, gap, n_features + 1)[:-1]
        g = np.append(grad, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - float(step[-1])
    return w, b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS, fairness: float = 1.0) -> Model:
    sample = training_rows(docs, labels, id_col, text_col, label_col, rows)
    n = dict(map(tuple, sample.groupBy("label").count().collect()))
    n_toxic, n_other = sum(c for k, c in n.items() if k), n.get(0, 0)
    if not n_toxic or not n_other:
        return Model(intercept=-40.0)
    names = choose_features(count_features(sample), n_toxic, n_other)
    names += sorted(KIND_OF.keys() - set(names))
    got = sorted((tuple(r) for r in design(sample, names).collect()), key=str)  # in one order, whatever task was first
    kinds, pairs = [r for r in got if r[0] is not None], [(*r[1], r[2]) for r in got if r[0] is None]
    w, b = train(np.array([r[0] for r in kinds]) > 0, [r[1] for r in kinds], np.array([r[2] for r in kinds]), pairs, len(names), fairness)
    return Model(dict(zip(names, map(float, w))), b)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id and the score. The model's size follows from the sample's bound."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        value = held.value.scorer()

        def handle(part: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([part.column(0), pa.array([value(t) for t in strings(part.column(1))], pa.float64())], [id_col, "score"])

        return handle

    return map_slices(keyed(docs, id_col, text_col), make, f"`{id_col}` {id_type(docs, id_col)}, score double")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def make():
        value = held.value.scorer()
        return lambda part: part.filter(pa.array([value(t) < threshold for t in strings(part.column(at))], pa.bool_()))

    return map_slices(docs, make, docs.schema, text_at=at)


def digest(scored: DataFrame, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
