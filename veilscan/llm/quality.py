"""Quality classifier by Bradley-Terry pairwise ranking.

Every whole text gets figures of its form (shares of letter cases, symbols, repeats and so on). From
labelled rows, preference pairs (a good document, a bad one) are drawn; the chance that the first is
preferred is the logistic function of the difference of their scores, and scores are additive in the
binned figures. Logistic loss on feature differences gives the weights. The verdict's threshold is a
quantile of the training scores; scores are then mapped to 0..1 so that the threshold sits at 0.3.

The fit uses every labelled row. Spark counts the figures' values (four digits) for the bins' edges, deals the
rows out to parts of about `most_rows`, each of which fits weights on pairs that all its rows are in, and the weights'
mean is the ranker's. Rows of the rarer label go to several parts where a part had too few of them. Spark counts the
scores of all rows for the threshold. The driver holds edges, the parts' weights and counts of scores.

Defined results: a null text is empty and gets the score of an empty text; without labels of both
kinds every score is 0.5; repeated rows give equal scores; labels of no document are ignored; whole texts are read, however long; texts
that score alike stay alike on either side of the threshold; an empty table gives no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilscan.llm._common import map_batches, materialise, release, texts

FIGURES = ("log_words", "upper", "digit", "symbol", "exclaim", "pipe", "punct", "space", "unique", "adjacent", "same_lines", "word_length", "line_words", "top_word", "repeat3")
CUT = 0.3
# The step in which scores are counted for the threshold.
STEP = 1e-3
# Labels that may be broadcast (12 bytes each), counted before.
BROADCAST_ROWS = 1_000_000

# Byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 symbol, 5 exclamation mark, 6 bar, 7 stop or comma, 8 white space, 9 continuation byte.
CLASS = np.zeros(256, np.uint8)
CLASS[97:123], CLASS[65:91], CLASS[48:58] = 1, 2, 3
CLASS[list(b"#*$%&<>^~=+@\\{}[]_")] = 4
CLASS[ord("!")], CLASS[ord("|")] = 5, 6
CLASS[list(b".,;:?'\"()-")] = 7
CLASS[list(b" \t\n\r\x0b\x0c")] = 8
CLASS[128:192] = 9


def figures(text: str) -> list[float]:
    """The figures of one whole text, in the order of FIGURES."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FIGURES)
    count = np.bincount(CLASS[np.frombuffer(raw, np.uint8)], minlength=10)
    chars = len(raw) - int(count[9])
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct = set(words)
    often = 0
    if n > 1:
        tally: dict[bytes, int] = {}
        for w in words:
            tally[w] = tally.get(w, 0) + 1
        often = max(tally.values())
    threes = set(zip(words, words[1:], words[2:]))  # noqa: B905
    letters = max(1, int(count[1] + count[2]))
    return [
        math.log(n),
        count[2] / letters,
        count[3] / chars,
        count[4] / chars,
        count[5] / chars,
        count[6] / chars,
        count[7] / chars,
        count[8] / chars,
        len(distinct) / n**0.9,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines),
        (chars - int(count[8])) / n,
        math.log(n / len(lines)),
        often / n,
        1 - len(threes) / max(1, n - 2),
    ]


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, figures) of every row of `docs` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [figures(t) for t in texts(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "figures"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, figures array<double>")


class Ranker:
    """Additive Bradley-Terry scores over binned figures."""

    def __init__(self, bins: int = 12, pairs: int = 200_000, l2: float = 1e-3, seed: int = 7) -> None:
        self.bins, self.pairs, self.l2, self.seed = bins, pairs, l2, seed
        self.edges: list[np.ndarray] | None = None

    def _binned(self, x: np.ndarray) -> np.ndarray:
        """Place of each figure in one long list of bins."""
        places, start = [], 0
        for j, edges in enumerate(self.edges):
            places.append(start + np.searchsorted(edges, x[:, j], "right"))
            start += len(edges) + 1
        return np.stack(places, 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Ranker:
        good, bad = x[y == 1], x[y == 0]
        if not len(good) or not len(bad):
            return self
        # Quantiles of both kinds alike, so that rare bad documents shape the bins too.
        weights = np.where(y == 1, len(bad), len(good))
        edges = []
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            upto = np.cumsum(weights[order])
            edges.append(np.unique(x[order, j][np.searchsorted(upto * self.bins, np.arange(1, self.bins) * upto[-1])]))
        self.edges = edges
        self.weights = self.learned(x, y)
        found = pd.DataFrame({"cell": self.cells(x), "y": y}).value_counts().reset_index(name="n")
        return self.settle(found)

    def learned(self, x: np.ndarray, y: np.ndarray, part: int = 0) -> np.ndarray:
        """Weights of the bins from pairs of these rows, each of which is in some."""
        rng = np.random.default_rng(self.seed + part)
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        places = self._binned(x)
        size = sum(len(e) + 1 for e in self.edges)
        pairs, batch = max(self.pairs, len(good), len(bad)), 4000
        in_turn = lambda rows: np.concatenate([rng.permutation(rows) for _ in range(-(-pairs // len(rows)))])[:pairs]
        i, k = in_turn(good), in_turn(bad)
        w = np.zeros(size)
        first, second = np.zeros(size), np.zeros(size)
        for step in range(1, 1 + max(300, -(-pairs // batch))):  # Adam on the logistic loss of score differences
            take = np.arange((step - 1) * batch, step * batch) % pairs
            a, b = places[i[take]], places[k[take]]
            pull = 1 / (1 + np.exp(np.clip(w[a].sum(1) - w[b].sum(1), -30, 30))) / len(take)
            grad = self.l2 * w
            grad -= np.bincount(a.ravel(), np.repeat(pull, a.shape[1]), size)
            grad += np.bincount(b.ravel(), np.repeat(pull, b.shape[1]), size)
            first = 0.9 * first + 0.1 * grad
            second = 0.99 * second + 0.01 * grad**2
            w -= 0.05 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        return w

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Scores in whole steps."""
        return np.floor(self.raw(x) / STEP).astype(np.int64)

    def settle(self, counts: pd.DataFrame) -> Ranker:
        """Sets threshold and scale from the number n of rows of each score and label (cell, y)."""
        n = counts.pivot_table(index="cell", columns="y", values="n", aggfunc="sum", fill_value=0).reindex(columns=[0, 1], fill_value=0).sort_index()
        cells, bad, good = n.index.to_numpy(), n[0].to_numpy(), n[1].to_numpy()
        upto = np.cumsum(bad + good)
        at = lambda levels: np.minimum(np.searchsorted(upto, levels * upto[-1], "right"), len(cells) - 1)
        # Threshold: the quantile of the training scores with the fewest wrong verdicts.
        levels = np.linspace(0, 1, 401)[1:-1]
        below = np.cumsum(bad) - bad, np.cumsum(good) - good
        right = (below[0] + good.sum() - below[1])[at(levels)]
        self.level = float(levels[right >= right.max()].mean())
        self.cut = float(cells[at(self.level)] * STEP)
        mean = np.average(cells, weights=bad + good)
        self.scale = max(1e-6, float(np.sqrt(np.average((cells - mean) ** 2, weights=bad + good))) * STEP / 2)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self._binned(x)].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0..1, the threshold's quantile at CUT."""
        if self.edges is None:
            return np.full(len(x), 0.5)
        z = (self.raw(x) - self.cut) / self.scale + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def labelled_rows(labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """(doc_id, y) of the labelled rows outside the held fold (none is held if `held` is negative)."""
    rows = labels.filter(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y"))
    return rows.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) != held)


def edges_of(rows: DataFrame, n: dict[int, int], bins: int) -> list[np.ndarray]:
    """The bins' edges of each figure of `rows` (y, figures): quantiles in which both labels weigh alike, from counts of values of four digits."""
    ten = F.pow(F.lit(10.0), 3 - F.floor(F.log10(F.abs("value"))))
    value = F.when(F.col("value") == 0, 0.0).otherwise(F.round(F.col("value") * ten) / ten)
    counts = rows.select("y", F.posexplode("figures").alias("j", "value")).groupBy("j", value.alias("value"), "y").agg(F.count(F.lit(1)).alias("n"))
    weighed = counts.groupBy("j", "value").agg(F.sum(F.when(F.col("y") == 1, F.col("n") * n[0]).otherwise(F.col("n") * n[1])).alias("weight"))
    before = Window.partitionBy("j").orderBy("value")  # a figure has 9000 values for each power of ten, at most
    met = weighed.withColumn("upto", F.sum("weight").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    total = 2 * n[0] * n[1]
    met = met.filter(F.expr(f"least({bins - 1}, upto * {bins} div {total}) > (upto - weight) * {bins} div {total}"))
    found: list[list[float]] = [[] for _ in FIGURES]
    for r in met.select("j", "value").collect():  # some for each figure
        found[r["j"]].append(r["value"])
    return [np.sort(np.array(x)) for x in found]


def train(measured: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, most_rows: int = 20_000) -> Ranker:
    """Fits on all labelled rows whose crc32(doc_id as text) mod `folds` isn't `held`, in parts of about `most_rows`; of rows that share a doc_id on one, that of the least figures."""
    rows = labelled_rows(labels, label, folds, held).distinct()
    first = F.min("figures").alias("figures")
    if rows.count() <= BROADCAST_ROWS:
        found = measured.join(F.broadcast(rows), "doc_id").groupBy("doc_id", "y").agg(first)
    else:  # partial minima first, so that no task holds all rows of an id
        found = measured.groupBy("doc_id").agg(first).join(rows, "doc_id")
    found = materialise(found.select("doc_id", "y", "figures"))
    n = {0: 0, 1: 0} | {r["y"]: r["count"] for r in found.groupBy("y").count().collect()}
    ranker = Ranker()
    if not n[0] or not n[1]:
        return ranker
    ranker.edges = edges_of(found, n, ranker.bins)
    parts = -(-sum(n.values()) // most_rows)
    few = min(n, key=n.get)
    copies = min(parts, max(1, -(-parts * most_rows // (4 * n[few]))))  # so that a part has a quarter of its rows of it, or all there are
    own = F.sequence(F.lit(0), F.when(F.col("y") == few, copies - 1).otherwise(0))
    dealt = found.withColumn("copy", F.explode(own)).withColumn("part", (F.pmod(F.xxhash64("doc_id", "y"), F.lit(parts)) + F.col("copy")) % parts)

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "y"])
        x, y = np.stack(part["figures"].to_numpy()), part["y"].to_numpy()
        weights = ranker.learned(x, y, int(part["part"].iloc[0])) if 0 < y.sum() < len(y) else None
        return pd.DataFrame({"part": part["part"].iloc[:1], "n": len(part), "weights": [weights]})

    learned = dealt.select("part", "doc_id", "y", "figures").groupBy("part").applyInPandas(learn, "part long, n long, weights array<double>")
    learned = sorted((r for r in learned.collect() if r["weights"]), key=lambda r: r["part"])  # a row for `most_rows` labelled ones
    if not learned:
        return Ranker()
    ranker.weights = np.average([r["weights"] for r in learned], axis=0, weights=[r["n"] for r in learned])

    @F.pandas_udf("long")
    def cell(x: pd.Series) -> pd.Series:
        return pd.Series(ranker.cells(np.stack(x.to_numpy())) if len(x) else [], dtype="int64")

    counts = found.select(cell("figures").alias("cell"), "y").groupBy("cell", "y").agg(F.count(F.lit(1)).alias("n"))
    return ranker.settle(pd.DataFrame([r.asDict() for r in counts.collect()]))  # at most a row for each step of scores and label


def train_on(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = 20_000) -> Ranker:
    """Fits on all labels; only labelled rows are measured, while their ids may be broadcast."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    ids = labelled_rows(labels, label, 1, -1).select("doc_id").distinct()
    if ids.count() <= BROADCAST_ROWS:
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    return train(materialise(measure(docs)), labels, label, 1, -1, most_rows)


def keep(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """The rows of `docs` that score CUT or more, with all their columns."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        found = pd.Series(ranker.score(np.array([figures(t or "") for t in text])) if len(text) else [])
        release()
        return found

    return docs.filter(score(F.col("text").cast("string")) >= CUT)


def scored(measured: DataFrame, ranker: Ranker) -> DataFrame:
    """(doc_id, score) of every row."""

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(ranker.score(np.stack(x.to_numpy())) if len(x) else [])

    return measured.select("doc_id", score("figures").alias("score"))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs`."""
    measured = materialise(measure(docs))
    out = scored(measured, train(measured, labels, folds=folds, held=held))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
