"""Quality rules: text statistics, and a decision list learned from labels that ends as a Spark expression."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import fraction, quoted, table_operator, with_text_columns, words

WINDOW = 8
_CONTINUATION = bytes(range(0x80, 0xC0))
_SPACE = b" \t\n\x0b\x0c\r"
#: Fixed value: the symbols that are counted.
SYMBOLS = b"#*$%&|<>"
BASE = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long"}
#: What the rules may look at.
FEATURES = {
    "f_words": "double", "f_word_length": "double", "f_symbols": "double", "f_dup_lines": "double",
    "f_repeats": "double", "f_distinct": "double", "f_top_word": "double", "f_upper": "double",
    "f_digits": "double", "f_line_words": "double", "f_stops": "double", "f_exclaims": "double",
}
_UPPER = bytes(range(0x41, 0x5B))
_DIGITS = b"0123456789"


def _repeated_words(found: list[bytes]) -> tuple[int, int, int]:
    """Words inside a WINDOW-word window that occurs again, distinct words, and the most frequent word's count.

    Windows get exact numbers by doubling: words, pairs of words, pairs of pairs and so on.
    """
    n = len(found)
    if not n:
        return 0, 0, 0
    seen: dict[bytes, int] = {}
    ranks = np.fromiter((seen.setdefault(w, len(seen)) for w in found), np.int64, n)
    top = int(np.bincount(ranks).max())
    if n <= WINDOW:
        return 0, len(seen), top
    step, distinct = 1, len(seen)
    while step < WINDOW:
        pair = ranks[:-step] * np.int64(distinct) + ranks[step:]
        values, ranks = np.unique(pair, return_inverse=True)
        distinct, step = len(values), 2 * step
    again = np.bincount(ranks, minlength=distinct)[ranks] > 1
    edge = np.zeros(n + 1, np.int64)
    edge[:-WINDOW][again[: n - WINDOW + 1]] += 1
    edge[WINDOW:][again[: n - WINDOW + 1]] -= 1
    return int((np.cumsum(edge)[:n] > 0).sum()), len(seen), top


def measure(text: bytes | None) -> tuple:
    """The base counts and the features of a whole text."""
    text = text or b""
    found = words(text)
    n = len(found)
    chars = len(text.translate(None, _CONTINUATION + _SPACE))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeats, distinct, top = _repeated_words(found)
    size = max(len(text), 1)
    share = lambda kept: (len(text) - len(text.translate(None, kept))) / size
    count = max(n, 1)
    return (
        n, chars, symbols, dup_lines, repeats,
        float(n), chars / count, symbols / count, dup_lines / max(len(lines), 1),
        repeats / count, distinct / count, top / count, share(_UPPER),
        share(_DIGITS), n / max(len(lines), 1), share(b".,"), share(b"!?"),
    )


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts and the features; null texts count as empty."""
    return with_text_columns(docs, text, BASE | FEATURES, measure)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        x = values[self.feature]
        return x >= self.threshold if self.above else x <= self.threshold

    def column(self) -> Column:
        x = F.col(quoted(self.feature))
        return x >= F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)


@dataclass(frozen=True)
class Rule:
    """A conjunction that marks a document as bad; precision is from rows that took no part in growing."""

    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        size = len(next(iter(values.values())))
        return np.logical_and.reduce([np.ones(size, bool), *(c.holds(values) for c in self.conditions)])

    def __str__(self) -> str:
        return " and ".join(f"{c.feature} {'>=' if c.above else '<='} {c.threshold:.6g}" for c in self.conditions)


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...] = field(default=())

    def rule_number(self) -> Column:
        """The first rule that holds, from 1; 0 if none does. One ordered CASE expression."""
        chain = None
        for i, rule in enumerate(self.rules, 1):
            test = rule.conditions[0].column()
            for c in rule.conditions[1:]:
                test = test & c.column()
            chain = F.when(test, F.lit(i)) if chain is None else chain.when(test, F.lit(i))
        return F.lit(0) if chain is None else chain.otherwise(F.lit(0))

    def keeps(self) -> Column:
        return self.rule_number() == F.lit(0)


def _foil(p: int, n: int, p0: int, n0: int) -> float:
    return p * (np.log2(max(p, 1e-9) / (p + n)) - np.log2(p0 / (p0 + n0))) if p else -np.inf


def _best_condition(values: dict[str, np.ndarray], bad: np.ndarray, cuts: int) -> tuple[float, Condition | None]:
    p0, n0 = int(bad.sum()), int((~bad).sum())
    best: tuple[float, Condition | None] = (0.0, None)
    for name, x in values.items():
        for cut in np.unique(np.quantile(x[bad], np.linspace(0, 1, cuts))).tolist():
            for above in (True, False):
                hit = x >= cut if above else x <= cut
                p = int((hit & bad).sum())
                gain = _foil(p, int(hit.sum()) - p, p0, n0)
                if gain > best[0] + 1e-9:
                    best = (gain, Condition(name, above, cut))
    return best


def learn_decision_list(
    values: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, max_conditions: int = 4,
    cuts: int = 24, min_precision: float = 0.9, min_covered: int = 5,
) -> DecisionList:
    """Sequential covering: grow a conjunction on two thirds of the rows by information gain, prune its end on
    the rest, keep it if it is precise there, remove what it covers, and go on until no such rule is left."""
    rows = np.arange(len(bad))
    left = np.ones(len(bad), bool)
    rules: list[Rule] = []
    while len(rules) < max_rules and (left & bad).any():
        grow, prune = left & (rows % 3 != 0), left & (rows % 3 == 0)
        inside = {k: x[grow] for k, x in values.items()}
        target, conditions = bad[grow], []
        while len(conditions) < max_conditions and target.any() and not target.all():
            _, condition = _best_condition(inside, target, cuts)
            if condition is None:
                break
            conditions.append(condition)
            hit = condition.holds(inside)
            inside, target = {k: x[hit] for k, x in inside.items()}, target[hit]
        if not conditions:
            break
        held, truth, scored = {k: x[prune] for k, x in values.items()}, bad[prune], []
        for size in range(1, len(conditions) + 1):
            hit = Rule(tuple(conditions[:size]), 0, 0).holds(held)
            p, n = int((hit & truth).sum()), int((hit & ~truth).sum())
            scored.append(((p - n) / (p + n) if p + n else -1.0, -size, p, n))
        _, size, p, n = max(scored)
        if p + n < min_covered or p < min_precision * (p + n):
            break
        rule = Rule(tuple(conditions[:-size]), p / (p + n), p + n)
        rules.append(rule)
        covered = rule.holds(values)
        if not (covered & left).any():
            break
        left &= ~covered
    return DecisionList(tuple(rules))


def fit_decision_list(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality",
    sample: int = 12_000, **settings,
) -> DecisionList:
    """Learn the list from at most ``sample`` labelled rows, those whose key has the smallest hash.

    Labels with a null key or quality aren't used; of repeated keys, one row with the lowest quality. The
    labels are ranked first, so only the sampled texts are measured, by Spark; the driver gets their figures.
    """
    usable = labels.where(F.col(key).isNotNull() & F.col(quality).isNotNull())
    # counted first, so that only about four times the sample is put in order, however many labels there are
    share = 4 * sample / max(usable.count(), 1)
    chosen = (
        usable.where(fraction(F.col(key)) < share).groupBy(F.col(key).alias("__key")).agg(F.min(quality).alias("__quality"))
        .orderBy(fraction(F.col("__key")), "__key").limit(sample)
    )
    # at most ``sample`` narrow rows, so the broadcast is bounded
    labelled = docs.select(F.col(key).alias("__doc"), F.col(text).alias("__text")).join(
        F.broadcast(chosen), F.col("__doc") == F.col("__key")
    )
    rows = (
        with_statistics(labelled, "__text").groupBy("__key", "__quality")
        .agg(*[F.min(f).alias(f) for f in FEATURES]).orderBy(fraction(F.col("__key")), "__key").collect()
    )
    if not rows:
        return DecisionList()
    values = {f: np.array([r[f] for r in rows], float) for f in FEATURES}
    return learn_decision_list(values, np.array([r["__quality"] == 0 for r in rows]), **settings)


@table_operator([*BASE, *FEATURES, "base_failed", "rule", "kept"])
def judge(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """Add the base counts, base_failed, rule (number of the first rule that holds, 0: none) and kept.

    Null and empty texts have no words and fail the base. Repeated rows get the same answer; columns with the
    new names are replaced, others stay; an empty table stays empty.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        with_statistics(docs, text).withColumn("base_failed", failed).withColumn("rule", rules.rule_number())
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)).drop(*FEATURES)
    )
