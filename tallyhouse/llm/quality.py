"""Quality rules: a decision list learned by sequential covering, run as one conditional expression.

``statistics`` counts what a text holds, with DataFrame functions alone.
``learn`` grows and prunes conjunctions of thresholds on at most ``SAMPLE``
labelled rows (those with the smallest hash of doc_id: a documented bound of the
fit, nothing else is sampled).  ``verdict`` turns the ordered rules into
``CASE WHEN a AND b THEN false ... ELSE true END``.

Defined results: a null text is empty and fails the base rules; labels with null
or other values than 0 and 1 are ignored, several labels of a document count as
the worst; without labels of both kinds the list is empty and keeps everything;
repeated rows are judged alike; empty tables give no rows; other columns pass
``keep_good`` unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import let, words_of

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 5
#: Labelled rows that the fit looks at, at most.
SAMPLE = 4096
#: What rules may test: shares and means alone, as counts and the share of distinct words follow a text's length.
FEATURES = ("mean_word", "symbols_per_word", "repeat_share", "dup_line_share", "upper_share", "bang_per_word", "comma_per_word", "digit_share", "words_per_line")


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def repeated_words(words: Column) -> Column:
    """Words inside windows of five words that occur twice or more in the array.

    Windows are compared by 64-bit hashes of their words' hashes.
    """

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def covered(g: Column) -> Column:
        ranked = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def starts(s: Column) -> Column:
            marked = F.transform(s, lambda e, k: F.when(F.get(s, k - 1)["x"].eqNullSafe(e["x"]) | F.get(s, k + 1)["x"].eqNullSafe(e["x"]), e["i"]))
            return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

        def total(p: Column) -> Column:
            own = F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW))))
            return F.aggregate(own, F.lit(0), lambda a, b: a + b)

        return let(let(ranked, starts), total)

    def any_twice(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(covered(g))

    return F.when(F.size(words) <= WINDOW, 0).otherwise(let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), any_twice))


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct column ``stats`` of counts and ratios."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda l: F.translate(l, BLANKS, "") != "")

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
        )

    def of_lines(own: Column) -> Column:
        return F.struct(F.size(own).cast("long").alias("n_lines"), (F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("n_dup_lines"))

    w, l = let(words_of(text), of_words), let(lines, of_lines)
    counts = docs.withColumn("stats", F.struct(
        w.alias("w"), l.alias("l"), F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"), _count(text, SYMBOLS).cast("long").alias("n_symbols"),
        _count(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("upper"), _count(text, "!").alias("bangs"), _count(text, ",;").alias("commas"), _count(text, "0123456789").alias("digits"),
    ))
    s = F.col("stats")
    n, chars, n_lines = s["w"]["n_words"], s["word_chars"], s["l"]["n_lines"]

    def per(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    return counts.withColumn("stats", F.struct(
        n.alias("n_words"), chars.alias("word_chars"), s["n_symbols"].alias("n_symbols"), s["l"]["n_dup_lines"].alias("n_dup_lines"), s["w"]["n_repeat_words"].alias("n_repeat_words"),
        per(chars, n).alias("mean_word"), per(s["n_symbols"], n).alias("symbols_per_word"), per(s["w"]["n_repeat_words"], n).alias("repeat_share"), per(s["l"]["n_dup_lines"], n_lines).alias("dup_line_share"),
        per(s["upper"], chars).alias("upper_share"), per(s["bangs"], n).alias("bang_per_word"), per(s["commas"], n).alias("comma_per_word"), per(s["digits"], chars).alias("digit_share"), per(n, n_lines).alias("words_per_line"),
    ))


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])


@dataclass(frozen=True)
class Rule:
    """Documents that meet all conditions (feature, below, threshold) are rejected."""

    conditions: tuple[tuple[str, bool, float], ...]

    def covers(self, rows: np.ndarray) -> np.ndarray:
        hit = np.ones(len(rows), bool)
        for name, below, threshold in self.conditions:
            value = rows[:, FEATURES.index(name)]
            hit &= value <= threshold if below else value > threshold
        return hit

    def column(self, stats: Column) -> Column:
        hit = F.lit(True)
        for name, below, threshold in self.conditions:
            hit = hit & (stats[name] <= threshold if below else stats[name] > threshold)
        return hit


def _gain(p: np.ndarray, n: np.ndarray, p0: int, n0: int) -> np.ndarray:
    """Positives kept times the bits by which they became likelier."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1.0)


def _best_condition(rows: np.ndarray, bad: np.ndarray, inside: np.ndarray, cuts: list[np.ndarray], features: range | list[int]) -> tuple[str, bool, float] | None:
    p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
    best, found = 1e-9, None
    for f in features:
        under = rows[:, f, None] <= cuts[f]
        for below, hit in ((True, under), (False, ~under)):
            hit = hit & inside[:, None]
            gain = _gain((hit & bad[:, None]).sum(0), (hit & ~bad[:, None]).sum(0), p0, n0)
            if len(gain) and gain.max() > best:
                best, found = gain.max(), (FEATURES[f], below, float(cuts[f][gain.argmax()]))
    return found


def _grow(rows: np.ndarray, bad: np.ndarray, cuts: list[np.ndarray], first: int, most: int) -> Rule:
    """A conjunction that begins with feature ``first`` and grows until it covers no good row."""
    conditions: list[tuple[str, bool, float]] = []
    inside = np.ones(len(rows), bool)
    while len(conditions) < most and (inside & ~bad).any():
        one = _best_condition(rows, bad, inside, cuts, range(len(FEATURES)) if conditions else [first])
        if one is None:
            break
        conditions.append(one)
        inside &= Rule((one,)).covers(rows)
    return Rule(tuple(conditions))


def _prune(rule: Rule, rows: np.ndarray, bad: np.ndarray) -> Rule:
    """The shortest head of the rule with the best precision on rows it didn't grow on."""

    def worth(r: Rule) -> float:
        hit = r.covers(rows)
        return (int((hit & bad).sum()) + 1) / (int(hit.sum()) + 2)

    heads = [Rule(rule.conditions[: k + 1]) for k in range(len(rule.conditions))]
    return max(heads, key=worth) if heads else rule


def learn(rows: np.ndarray, bad: np.ndarray, precision: float = 0.98, most_rules: int = 16, most_conditions: int = 3) -> list[Rule]:
    """Sequential covering: in each round a rule is grown from each feature on two thirds
    of the rows left and pruned on the others; of those whose precision on all rows left is
    at least ``precision`` the one that covers most bad rows joins the list and its rows go.
    It ends when no such rule covers three bad rows."""
    rules: list[Rule] = []
    part = np.arange(len(rows)) % 3 == 2
    left = np.ones(len(rows), bool)
    cuts = []
    for f in range(rows.shape[1] if len(rows) else 0):
        values = np.unique(rows[:, f])
        middles = (values[1:] + values[:-1]) / 2
        cuts.append(middles if len(middles) <= 64 else middles[np.linspace(0, len(middles) - 1, 64).astype(int)])
    while len(rules) < most_rules and (left & bad & ~part).sum() >= 3:
        best, most = None, 2
        for first in range(len(FEATURES)):
            rule = _prune(_grow(rows[left & ~part], bad[left & ~part], cuts, first, most_conditions), rows[left & part], bad[left & part])
            hit = rule.covers(rows) & left
            p = int((hit & bad).sum())
            if rule.conditions and p > most and p >= precision * hit.sum():
                best, most = rule, p
        if best is None:
            break
        rules.append(best)
        left &= ~best.covers(rows)
    return rules


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and badness of at most ``sample`` labelled documents, in a fixed order.

    The labels joined are at most ``sample`` rows, hence broadcast.
    """
    key = F.xxhash64("doc_id")
    chosen = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(key, "doc_id").limit(sample)
    found = statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    rows = found.select(key.alias("k"), "quality", *[F.col("stats")[x].cast("double").alias(x) for x in FEATURES]).orderBy("k", *FEATURES).limit(sample).collect()
    return np.array([[r[x] for x in FEATURES] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r["quality"] == 0 for r in rows], bool)


def verdict(stats: Column, rules: list[Rule]) -> Column:
    """True for documents that no rule rejects."""
    kept = F.lit(True)
    for rule in reversed(rules):
        kept = F.when(rule.column(stats), False).otherwise(kept)
    return kept


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``stats``, ``base_failed`` and ``kept``."""
    rules = learn(*labelled(docs, labels, sample))
    found = statistics(docs)
    failed = base_failed(F.col("stats"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(F.col("stats"), rules))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that are kept, with their own columns."""
    rules = learn(*labelled(docs, labels, sample))
    found = statistics(docs.select(F.struct("*").alias("row"), "text"))
    return found.where(~base_failed(F.col("stats")) & verdict(F.col("stats"), rules)).select("row.*")
