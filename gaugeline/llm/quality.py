"""Quality rules with an isolation forest on rule statistics.

Each whole text gives counts: words, their code points, symbols, repeated lines, words in repeated five-word windows,
upper-case words, exclamation and question marks, lines, words equal to the one before, distinct words. Two base rules
reject outright: fewer than 10 words, or more than a fifth of the words in repeated windows. An isolation forest judges
the rest: trees of random splits over rates of all the counts, grown on small random subsets of labelled rows; a short
mean path marks an anomaly.

A rate enters as its distance from the range that good labelled rows have, in their deviations: good texts meet near
one point, however their rates vary, and a split anywhere beyond isolates the others. The threshold is set on scores
that labelled rows get from forests of the other folds, so each is held out: it is the score, the most lenient of
equals, at which the share of bad rows that stay plus `price` times the share of good rows that go is least. Ranges and
threshold come from labels alone.

The forest uses at most `fit_rows` labelled rows, those of the smallest seeded hash; every text is counted and scored.

Defined results: a null or empty text has no words and fails; equal rows get equal verdicts; without good and bad
labelled rows that pass the base rules only these reject; a document with several labels counts as bad if one says so; an empty table
gives no rows; other columns are not looked at, and `keep` returns all of them.
"""

from __future__ import annotations

from math import ceil, inf, log, log2
from operator import eq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_parts

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper_words", "n_marks", "n_lines", "n_echo_words", "n_distinct_words")
SYMBOLS, WINDOW = "#*$%&|<>", 5
#: Words of a common text that every text's rates are thinned with, so that those of short ones vary less, and their length.
COMMON, LETTERS = 20.0, 5.0


def text_stats(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = text.encode().split()  # bytes are split at blank and x09 to x0D only
    n = len(words)
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    repeated = 0
    if n > WINDOW:
        windows = list(zip(*(words[i : n - WINDOW + 1 + i] for i in range(WINDOW)), strict=True))
        if len(set(windows)) < len(windows):
            seen: dict = {}
            for w in windows:
                seen[w] = seen.get(w, 0) + 1
            upto = 0
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += i + WINDOW - max(upto, i)
                    upto = i + WINDOW
    return (
        n,
        len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        sum(1 for w in words if len(w) > 3 and w.isupper()),
        text.count("!") + text.count("?"),
        len(lines),
        sum(map(eq, words, words[1:])),
        len(set(words)),
    )


def base_failed(s):
    """Of an array of statistics, a row each."""
    return (s[:, 0] < 10) | (100 * s[:, 4] > 20 * s[:, 0])


def rates(s):
    """Of an array of statistics, a row each: symbols, upper-case words, marks, repeated lines, repeated and echoed words,
    length of words, distinct words (which grow with a power of the words) and lines."""
    import numpy as np

    n, lines = s[:, 0].astype(float), s[:, 7]
    return np.stack(
        [
            s[:, 2] / (n + 1),
            s[:, 5] / (n + COMMON),
            s[:, 6] / (n + 1),
            s[:, 3] / (lines + COMMON),
            s[:, 4] / (n + COMMON),
            s[:, 8] / (n + COMMON),
            (s[:, 1] + LETTERS * COMMON) / (n + COMMON),
            np.log((s[:, 9] + 10) / (n + 10) ** 0.85),
            np.log((lines + 1) / (n + COMMON)),
        ],
        axis=1,
    )


def usual(x, share: float = 0.0005):
    """The range that holds all but a share of good rows' rates at either end, and their deviations."""
    import numpy as np

    low, high = np.quantile(x, [share, 1 - share], axis=0)
    return low, high, x.std(0) + 1e-3


def features(s, span):
    import numpy as np

    x, (low, high, deviation) = rates(s), span
    return np.log1p((np.maximum(0, x - high) + np.maximum(0, low - x)) / deviation)


def _mean_path(n: int) -> float:
    """Of unsuccessful searches in a binary tree of n."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class IsolationForest:
    def __init__(self, trees: int = 200, subset: int = 256, seed: int = 7) -> None:
        self.trees, self.subset, self.seed, self.threshold, self.span = trees, subset, seed, inf, None

    def fit(self, x):
        import numpy as np

        rng = np.random.default_rng(self.seed)
        size, self.rows = min(self.subset, len(x)), len(x)
        depth = ceil(log2(max(2, size)))
        self.depth, self.norm = depth, _mean_path(size) or 1.0
        width = 2 ** (depth + 1) - 1
        self.feature = np.zeros((self.trees, width), np.int64)
        self.cut = np.full((self.trees, width), inf)
        self.path = np.zeros((self.trees, width))

        def grow(t, node, rows, level):
            spread = rows.max(0) - rows.min(0) if len(rows) else np.zeros(x.shape[1])
            open_ = np.flatnonzero(spread > 0)
            if level == depth or not len(open_):
                self.path[t, node] = level + _mean_path(len(rows))
                return
            f = rng.choice(open_)
            c = rng.uniform(rows[:, f].min(), rows[:, f].max())
            self.feature[t, node], self.cut[t, node] = f, c
            grow(t, 2 * node + 1, rows[rows[:, f] <= c], level + 1)
            grow(t, 2 * node + 2, rows[rows[:, f] > c], level + 1)

        for t in range(self.trees):
            grow(t, 0, x[rng.choice(len(x), size, replace=False)], 0)
        self.inner = np.isfinite(self.cut)
        return self

    def score(self, x):
        """2 ** -(mean path / expected path): near 1 for anomalies."""
        import numpy as np

        out = np.empty(len(x))
        tree = np.arange(self.trees)
        for at in range(0, len(x), 4096):
            some = x[at : at + 4096]
            node = np.zeros((len(some), self.trees), np.int64)
            rows = np.arange(len(some))[:, None]
            for _ in range(self.depth):
                right = some[rows, self.feature[tree, node]] > self.cut[tree, node]
                node = np.where(self.inner[tree, node], 2 * node + 1 + right, node)
            out[at : at + 4096] = self.path[tree, node].mean(1)
        return 2.0 ** (-out / self.norm)

    def calibrate(self, scores, bad, price: float):
        """bad: labels, aligned with scores."""
        import numpy as np

        found = np.unique(scores)
        cuts = np.append((found[1:] + found[:-1]) / 2, inf)
        stay = np.searchsorted(np.sort(scores[bad]), cuts) / max(1, bad.sum())
        go = 1 - np.searchsorted(np.sort(scores[~bad]), cuts) / max(1, (~bad).sum())
        loss = stay + price * go
        self.threshold = float(cuts[len(loss) - 1 - np.argmin(loss[::-1])])
        return self


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = 4096, price: float = 10.0, folds: int = 5, seed: int = 7) -> IsolationForest | None:
    """None where no labelled document is there."""
    import numpy as np

    one = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.min(label).alias("label"))
    some = one.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(some), "doc_id")

    def run(found):
        import pyarrow as pa

        for b in in_parts(found):
            stats = [text_stats(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(b.column("label").to_pylist(), pa.int32()), pa.array(stats, pa.list_(pa.int64()))], names=["doc_id", "label", "stats"])

    counted = rows.mapInArrow(run, "doc_id long, label int, stats array<long>").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("stats").alias("stats")).orderBy("doc_id").collect()  # fit_rows at most
    if not counted:
        return None
    stats = np.array([r["stats"] for r in counted], np.int64)
    bad = np.array([r["label"] == 0 for r in counted])
    failed = base_failed(stats)
    good, passed = ~bad & ~failed, ~failed
    fold = np.random.default_rng(seed).permutation(len(stats)) % folds

    def grown(rows):
        if not (rows & good).any():
            return None
        forest = IsolationForest(seed=seed)
        forest.span = usual(rates(stats[rows & good]))
        return forest.fit(features(stats[rows], forest.span))  # rows that base rules reject show how far values can go

    forest, scores, held = grown(np.ones(len(stats), bool)), np.zeros(len(stats)), np.zeros(len(stats), bool)
    for k in range(folds):
        other, rows = grown(fold != k), (fold == k) & passed
        if other and rows.any():
            scores[rows], held = other.score(features(stats[rows], other.span)), held | rows
    if not (held & bad).any() or not (held & good).any():
        return None
    return forest.calibrate(scores[held], bad[held], price)


def judge(forest: IsolationForest | None, texts: list[str | None]):
    """Statistics, base verdicts, scores and verdicts of texts."""
    import numpy as np

    stats = np.array([text_stats(t) for t in texts], np.int64).reshape(-1, len(STATS))
    failed = base_failed(stats)
    score = forest.score(features(stats, forest.span)) if forest else np.zeros(len(stats))
    return stats, failed, score, ~failed & (score <= (forest.threshold if forest else inf))


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id, the statistics, base_failed, score, kept of all rows."""
    forest = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key, text, **how))

    def run(found):
        import pyarrow as pa

        for b in in_parts(found):
            stats, failed, score, kept = judge(forest.value, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in stats.T), pa.array(failed), pa.array(score), pa.array(kept)], names=["doc_id", *STATS, "base_failed", "score", "kept"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id long, {', '.join(f'{s} long' for s in STATS)}, base_failed boolean, score double, kept boolean")


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows that are kept, with all their columns."""
    forest = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key, text, **how))
    at = docs.columns.index(text)

    def run(found):
        import pyarrow as pa

        for b in in_parts(found):
            yield b.filter(pa.array(judge(forest.value, b.column(at).to_pylist())[3]))

    return docs.mapInArrow(run, docs.schema)
