"""Quality rules: text statistics and a learned decision list.

The list is learned by sequential covering from labelled statistics: a rule is a conjunction
of thresholds, grown on two thirds of the rows by the gain in information over its predecessor,
pruned on the last third, and taken off the rows it covers before the next one is sought. Its
result is an ordered Spark conditional expression (F.when(...).when(...).otherwise(...)), which
can be read, edited and stored as text.

Null and empty texts have no words. A text without words fails the base rule. Repeated rows
give repeated results, an empty table an empty one; columns other than those named are ignored.
Labels: null labels are left out; of repeated labels the lowest counts. Without labels of both
kinds the list is empty and keeps everything.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.rows import id_type, keyed, map_slices, strings

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 5
#: Labelled rows that the list is learned from, at most.
SAMPLE_ROWS = 20_000

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_chars_all", "n_ends")

#: What the rules' thresholds look at.
FEATURES = {
    "n_words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_ratio": "n_symbols / greatest(n_words, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "upper_ratio": "n_upper / greatest(word_chars, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
    "end_ratio": "n_ends / greatest(n_lines, 1)",
}


class Numbered(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def repeated_words(ids: np.ndarray) -> int:
    """Words within a window of WINDOW words that is found twice or more, the first included."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    mix = np.random.default_rng(7).integers(1, 2**63, WINDOW, np.uint64) * np.uint64(2) + np.uint64(1)
    key = sum((ids[k : n + k].astype(np.uint64) + np.uint64(1)) * mix[k] for k in range(WINDOW))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    a, b = order[:-1][same], order[1:][same]
    if any((ids[a + k] != ids[b + k]).any() for k in range(WINDOW)):  # two windows with one key
        _, back, count = np.unique(np.lib.stride_tricks.sliding_window_view(ids, WINDOW), axis=0, return_inverse=True, return_counts=True)
        hit = count[back.ravel()] > 1
    else:
        hit = np.zeros(n, bool)
        hit[a] = hit[b] = True
    covered = np.zeros(len(ids), bool)
    for k in range(WINDOW):
        covered[k : n + k] |= hit
    return int(covered.sum())


def measure(text: str, numbers: Numbered) -> tuple[int, ...]:
    words = text.encode("utf-8", "surrogatepass").split()
    blanks = sum(map(text.count, BLANKS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    upper = len(text) - len(text.translate(NO_UPPER)) if text else 0
    ends = sum(x.rstrip(BLANKS)[-1] in ".!?\"'" for x in lines)
    return len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids), len(lines), upper, len(text), ends


NO_UPPER = {ord(c): None for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: the id and STATISTICS (long)."""

    def make():
        def handle(part: pa.RecordBatch) -> pa.RecordBatch:
            numbers = Numbered()
            rows = [measure(t, numbers) for t in strings(part.column(1))]
            return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows))], [id_col, *STATISTICS])

        return handle

    return map_slices(keyed(df, id_col, text_col), make, f"`{id_col}` {id_type(df, id_col)}, " + ", ".join(f"{c} long" for c in STATISTICS))


def base_failed() -> Column:
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


def features() -> list[Column]:
    return [F.expr(e).cast("double").alias(f"f_{k}") for k, e in FEATURES.items()]


@dataclass(frozen=True)
class Rule:
    """If all conditions (feature, '<=' or '>', threshold) hold, the text is rejected."""

    conditions: tuple[tuple[str, str, float], ...]
    covered: int
    right: int

    def column(self) -> Column:
        out = F.lit(True)
        for name, op, x in self.conditions:
            value = F.expr(FEATURES[name]).cast("double")
            out = out & (value <= F.lit(x) if op == "<=" else value > F.lit(x))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {op} {x:.6g}" for n, op, x in self.conditions) + f" -> reject  # {self.right} of {self.covered}"


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...]

    def verdict(self) -> Column:
        """True if the text is kept: the first rule that holds decides, without one it is kept."""
        out = None
        for rule in self.rules:
            out = F.when(rule.column(), F.lit(False)) if out is None else out.when(rule.column(), F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join([*map(str, self.rules), "else -> keep"])


def best_cut(x: np.ndarray, bad: np.ndarray, p0: float) -> tuple[float, str, float]:
    """The gain, side and threshold that tell the bad rows best; FOIL's measure."""
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], bad[order]
    edge = np.flatnonzero(xs[1:] > xs[:-1])
    if not len(edge):
        return 0.0, "<=", 0.0
    left_p, left_n = np.cumsum(ys)[edge], edge + 1.0
    total_p, total = ys.sum(), len(ys)
    best = (0.0, "<=", 0.0)
    for op, p, n in (("<=", left_p, left_n), (">", total_p - left_p, total - left_n)):
        gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / n) - np.log2(p0)), 0.0)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), op, float((xs[edge[k]] + xs[edge[k] + 1]) / 2))
    return best


def holds(values: dict[str, np.ndarray], conditions) -> np.ndarray:
    out = np.ones(len(next(iter(values.values()))), bool)
    for name, op, x in conditions:
        out &= values[name] <= x if op == "<=" else values[name] > x
    return out


def learn(values: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.8, least: int = 8, most_rules: int = 12, most_conditions: int = 4, seed: int = 11) -> DecisionList:
    """Sequential covering. A rule stays if at least this share of what it rejects in the pruning rows is bad."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    rng = np.random.default_rng(seed)
    grows = rng.random(len(bad)) < 2 / 3
    while len(rules) < most_rules and bad[left].sum() >= least:
        grow, prune = left & grows, left & ~grows
        conditions: list[tuple[str, str, float]] = []
        held = grow.copy()
        while len(conditions) < most_conditions and held.any() and 0 < bad[held].sum() < held.sum():
            cuts = {name: best_cut(v[held], bad[held].astype(float), float(bad[held].mean())) for name, v in values.items()}
            name = max(cuts, key=lambda k: cuts[k][0])
            if cuts[name][0] <= 1e-9:
                break
            conditions.append((name, *cuts[name][1:]))
            held = grow & holds(values, conditions)
        if not conditions:
            break

        def worth(c) -> float:
            h = prune & holds(values, c)
            p, n = bad[h].sum(), (~bad[h]).sum()
            return (p - n) / max(p + n, 1) + 1e-3 * np.log1p(p)

        # Drop final conditions as long as the rule is worth no less on the rows it wasn't grown on.
        lengths = range(len(conditions), 0, -1)
        conditions = conditions[: max(lengths, key=lambda k: (worth(conditions[:k]), -k))]
        covered = left & holds(values, conditions)
        judged = prune & covered
        if covered.sum() < least or judged.sum() == 0 or bad[judged].mean() < precision:
            break
        rules.append(Rule(tuple(conditions), int(covered.sum()), int(bad[covered].sum())))
        left &= ~covered
    return DecisionList(tuple(rules))


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, rows: int) -> DataFrame:
    """At most `rows` labelled ids, chosen by their hash: small enough to broadcast."""
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).cast("int").alias("label"))
    return one.orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(rows)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS, **options) -> DecisionList:
    """Learns from at most `rows` labelled documents; label 0 is a bad text. Rows that the base rule
    rejects anyway are left out."""
    few = docs.select(id_col, text_col).join(F.broadcast(labelled_sample(labels, id_col, label_col, rows)), id_col)
    label = few.select(F.col(id_col).alias("id"), F.struct("label").alias("more"), F.col(text_col).cast("string").alias("text"))
    stats = statistics(label.select(F.struct("id", "more").alias("id"), "text"), "id", "text")
    got = stats.where(~base_failed()).select(F.col("id.more.label").alias("label"), F.xxhash64(F.col("id.id").cast("string")).alias("at"), *features()).toPandas().sort_values("at", kind="stable")
    return learn({k: got[f"f_{k}"].to_numpy() for k in FEATURES}, (got["label"] == 0).to_numpy(), **options)


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """stats with base_failed and kept."""
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.verdict())
