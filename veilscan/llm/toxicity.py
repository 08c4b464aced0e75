"""Toxicity by a convolutional text classifier, trained in numpy.

Words (lower case, outer punctuation off) and their beginnings are hashed to embedding rows, whose sum
stands for the word, so that inflected forms share weight; filters of widths 1 to 3 slide over the
whole text, each filter's greatest value is kept, and a logistic layer weighs them.
The language is guessed from the text's own function words, and each language's threshold is moved
to 0.3. Thresholds are set on all labelled rows of a fold kept from the fit, in the mix of labels that
they have, with the same values over whole texts that the verdict uses.

The fit uses a sample of whole labelled texts, at most `most_rows` of them and about `most_chars`
characters, bounds by design; scoring reads every word of every text.

Defined results: a null text is empty and scores like padding alone; without labels of both kinds
every score is 0; repeated rows give equal scores; whole texts are read, however long; texts
that score alike stay alike on either side of the threshold; an empty table gives no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm._common import WordIds, map_batches, materialise, texts

ROWS = 1 << 16
WIDTH = 8  # numbers an embedding has
FILTERS = 8  # of each width
WIDTHS = (1, 2, 3)
CUT = 0.3
STEPS = 64  # of a logit, in the counts that thresholds are set on
FARTHEST = 30  # logits beyond it count as if at it
STARTS = (3, 4, 5, 7)  # characters of a word's beginnings
PARTS = 1 + len(STARTS)  # rows that make up a word
STRIP = b".,;:!?*$%&#|\"'()[]{}<>-_"

# Common function words by language.
FUNCTION_WORDS = {
    "en": "the of and to is that it for with was this are on by not be have",
    "de": "der die das und ist nicht ein eine mit von den zu im auf sich auch",
    "fr": "le la les des et est une du dans que qui pour pas sur avec au",
    "es": "el los las y es una del en que por con para su al se como",
}
LANGUAGES = (*FUNCTION_WORDS, "other")


class Vocabulary:
    """Numbers, embedding rows and language votes of words, remembered up to `limit` words; number 0 is padding."""

    def __init__(self, limit: int = 300_000) -> None:
        self.limit = limit
        self._reset()

    def _reset(self) -> None:
        self.words = WordIds()
        self.words[b" "] = 0
        self.rows, self.votes = np.zeros((1, PARTS), np.int32), np.zeros(1, np.uint8)

    def batch(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """(numbers of all words in turn, words of each text, how many words were known before: 0 after forgetting)."""
        import xxhash

        if len(self.words) > self.limit:
            self._reset()
        before = len(self.rows) if len(self.rows) > 1 else 0
        at: list[int] = []
        counts = np.zeros(len(batch), np.int64)
        for i, text in enumerate(batch):
            words = text.encode().split()
            counts[i] = len(words)
            at.extend(map(self.words.__getitem__, words))
        if fresh := self.words.fresh:
            bare = [w.strip(STRIP).decode().lower() for w in fresh]
            sets = [set(x.split()) for x in FUNCTION_WORDS.values()]
            rows = np.zeros((len(bare), PARTS), np.int32)
            hashed = xxhash.xxh32_intdigest
            for i, w in enumerate(bare):
                rows[i, 0] = 1 + hashed(w) % (ROWS - 1)
                for j, n in enumerate(STARTS):
                    if len(w) <= n:
                        break
                    rows[i, 1 + j] = 1 + hashed(w[:n] + "-") % (ROWS - 1)
            votes = np.fromiter((sum(1 << j for j, s in enumerate(sets) if w in s) for w in bare), np.uint8, len(bare))
            self.rows, self.votes = np.concatenate([self.rows, rows]), np.concatenate([self.votes, votes])
            self.words.fresh = []
        return np.array(at, np.int64), counts, before


def languages(votes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Language number of each text, from the votes of all words in turn: most function words; none: other."""
    ends = np.cumsum(counts)
    tally = np.stack([np.diff(np.concatenate([[0], np.cumsum((votes >> j) & 1)])[np.concatenate([[0], ends])]) for j in range(len(FUNCTION_WORDS))], 1)
    return np.where(tally.max(1) > 0, tally.argmax(1), len(FUNCTION_WORDS))


def padded(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with two padding words (0) after each text, and where each text starts."""
    pad = max(WIDTHS) - 1
    starts = np.cumsum(counts + pad) - counts - pad
    out = np.zeros(int(counts.sum()) + pad * len(counts), np.int64)
    out[np.arange(len(rows)) + np.repeat(starts - np.cumsum(counts) + counts, counts)] = rows
    return out, starts


class Taps:
    """Each known word's embedding through each filter tap: scoring is look-ups and sums."""

    def __init__(self, model: TextCNN) -> None:
        self.model, self.used = model, 0
        self.table = {(w, j): np.zeros((0, FILTERS), np.float32) for w in WIDTHS for j in range(w)}

    def learn(self, vocabulary: Vocabulary, before: int) -> None:
        p, n = self.model.params, len(vocabulary.rows)
        emb = p["emb"][vocabulary.rows[before:n]].sum(1)
        for (w, j), old in self.table.items():
            if len(old) < n:
                self.table[w, j] = grown = np.zeros((2 * n, FILTERS), np.float32)
                grown[:before] = old[:before]
            self.table[w, j][before:n] = emb @ p[f"k{w}"][j]


class TextCNN:
    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.rng = rng
        n = len(WIDTHS) * FILTERS
        self.params = {"emb": np.zeros((ROWS, WIDTH), np.float32), "bias": np.zeros(n, np.float32), "out": np.full(n, 0.3, np.float32), "out_bias": np.zeros(1, np.float32)}
        for w in WIDTHS:
            kernel = rng.normal(0, 0.3, (w, WIDTH, FILTERS)).astype(np.float32)
            kernel[:, 0, :] = np.abs(kernel[:, 0, :]) + 0.3 / w
            self.params[f"k{w}"] = kernel
        self.fitted = False

    def pooled(self, words: np.ndarray, starts: np.ndarray, rows: np.ndarray | None = None, taps: Taps | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Greatest value of every filter in every text; without `taps`, from the words' `rows`, also where it is."""
        p, best, where = self.params, [], []
        pads = np.flatnonzero(words == 0)
        emb = None if taps else p["emb"][rows[words]].sum(1)
        ends = np.append(starts[1:], len(words))
        for w in WIDTHS:
            value = None
            for j in range(w):
                part = taps.table[w, j][words] if taps else emb @ p[f"k{w}"][j]
                if j:
                    value[: len(words) - j] += part[j:]
                else:
                    value = part
            value[pads] = 0  # a window of padding alone; so none reaches into the next text
            top = np.maximum.reduceat(value, starts, axis=0)
            best.append(top)
            if not taps:
                where.append(np.stack([a + value[a:b].argmax(0) for a, b in zip(starts, ends, strict=True)]))
        return np.concatenate(best, 1), (np.concatenate(where, 1) if where else None)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.params["bias"], 0) @ self.params["out"] + self.params["out_bias"][0]

    def fit(self, docs: list[np.ndarray], rows: np.ndarray, y: np.ndarray, epochs: int = 8, rate: float = 0.01) -> TextCNN:
        """docs: word numbers of each text; rows: embedding rows of each word number."""
        if len(set(y.tolist())) < 2:
            return self
        rng = self.rng
        own = rng.permutation(len(docs))
        # Rows seen in few texts stay at zero; the others start from how much likelier toxic texts hold them.
        held = np.zeros((2, ROWS))
        for i in own:
            held[int(y[i]), np.unique(rows[docs[i]])] += 1
        known = held.sum(0) >= 3
        n1, n0 = max(1, int(y[own].sum())), max(1, int((1 - y[own]).sum()))
        prior = 5 * (held.sum(0) + 1) / (n1 + n0)
        emb = rng.normal(0, 0.05, (ROWS, WIDTH))
        emb[:, 0] = 0.6 * np.log((held[1] + prior) / (n1 + 5) / ((held[0] + prior) / (n0 + 5)))
        emb[~known] = 0
        emb[0] = 0
        known[0] = False
        p = self.params
        p["emb"][:] = emb
        p["out_bias"][0] = -2
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items() if k != "emb"}
        squares = np.full(ROWS, 1e-4, np.float32)
        step = 0
        for _ in range(epochs):
            for chunk in np.array_split(rng.permutation(own), max(1, len(own) // 64)):
                step += 1
                words, starts = padded(np.concatenate([docs[i] for i in chunk]), np.array([len(docs[i]) for i in chunk]))
                pooled, where = self.pooled(words, starts, rows)
                act = np.maximum(pooled + p["bias"], 0)
                z = act @ p["out"] + p["out_bias"][0]
                err = ((1 / (1 + np.exp(-z)) - y[chunk]) / len(chunk)).astype(np.float32)
                grad = {"out": act.T @ err + 1e-4 * p["out"], "out_bias": err.sum(keepdims=True)}
                back = np.outer(err, p["out"]) * (act > 0)
                grad["bias"] = back.sum(0)
                at_emb, g_emb = [], []
                for n, w in enumerate(WIDTHS):
                    cols = slice(n * FILTERS, (n + 1) * FILTERS)
                    spot = where[:, cols]
                    g = back[:, cols] * (words[spot] != 0)
                    kernel = np.zeros_like(p[f"k{w}"])
                    for j in range(w):
                        r = rows[words[np.minimum(spot + j, len(words) - 1)]]  # texts x filters x parts
                        kernel[j] = np.einsum("dfe,df->ef", p["emb"][r].sum(2), g)
                        at_emb.append(r.ravel())
                        g_emb.append(np.repeat((g[:, :, None] * p[f"k{w}"][j].T[None]).reshape(-1, WIDTH), PARTS, axis=0))
                    grad[f"k{w}"] = kernel + 1e-4 * p[f"k{w}"]
                for k, g in grad.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
                at, gs = np.concatenate(at_emb), np.concatenate(g_emb)
                touched, inverse = np.unique(at, return_inverse=True)
                total = np.zeros((len(touched), WIDTH), np.float32)
                np.add.at(total, inverse, gs)
                total[~known[touched]] = 0
                squares[touched] += (total**2).sum(1)
                p["emb"][touched] -= 0.5 * rate * total / np.sqrt(squares[touched])[:, None]
        self.fitted = True
        return self


def threshold(z: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> float | None:
    """The cut between the rising logits `z` of best F1, from the toxic and clean rows at each; None for few rows."""
    if ones.sum() < 5 or zeros.sum() < 5 or len(z) < 2:
        return None
    cuts = (z[1:] + z[:-1]) / 2
    hit, wrong = np.cumsum(ones[::-1])[::-1][1:], np.cumsum(zeros[::-1])[::-1][1:]  # at or above each cut
    f1 = 2 * hit / (hit + wrong + ones.sum())
    return float(np.median(cuts[f1 >= f1.max() - 1e-9]))


def thresholds(raw: DataFrame, labelled: DataFrame) -> list[float]:
    """Each language's threshold: best F1 on `labelled` (doc_id, y); languages with few rows take that of all.

    Rows are counted in Spark by language, label and step of the logit, so every row counts and what is
    collected has a fixed bound.
    """
    step = F.round(F.greatest(F.least("z", F.lit(FARTHEST)), F.lit(-FARTHEST)) * STEPS).cast("int")
    counted = raw.join(labelled, "doc_id").groupBy("lang", "y", step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    tally = np.zeros((len(LANGUAGES), 2, 2 * FARTHEST * STEPS + 1))
    for r in counted.collect():
        tally[r["lang"], r["y"], r["step"] + FARTHEST * STEPS] = r["n"]

    def of(zeros: np.ndarray, ones: np.ndarray) -> float | None:
        used = np.flatnonzero(zeros + ones)
        return threshold(used / STEPS - FARTHEST, ones[used], zeros[used])

    overall = of(*tally.sum(0))
    overall = -0.85 if overall is None else overall
    found = []
    for zeros, ones in tally:
        own = of(zeros, ones)
        # Few rows give a shaky threshold: drawn towards that of all.
        n = float(ones.sum())
        found.append(overall if own is None else (n * own + 20 * overall) / (n + 20))
    return found


def labelled_rows(labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """(doc_id, y, kept) of the labelled rows outside the held fold; a fifth is kept from the fit for the thresholds."""
    rows = labels.filter(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y"))
    rows = rows.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) != held)
    return rows.withColumn("kept", F.pmod(F.xxhash64(F.lit("kept"), "doc_id"), F.lit(5)) == 0)


def train(docs: DataFrame, rows: DataFrame, most_rows: int = 8_000, most_chars: int = 40_000_000) -> TextCNN:
    """Fits on whole texts of labelled `rows` (doc_id, y): of each label those with the smallest hashes."""
    by_hash = (F.xxhash64("doc_id"), F.col("doc_id"))
    rows = rows.filter("y = 1").orderBy(*by_hash).limit(most_rows // 2).unionByName(rows.filter("y = 0").orderBy(*by_hash).limit(most_rows // 2))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    chosen = docs.select(F.col("doc_id").cast("long"), text.alias("text")).join(F.broadcast(rows.distinct()), "doc_id")  # bounded: most_rows
    # Of rows that share a doc_id one is fitted on, the first in order of texts; and no text that is an eighth of all.
    chosen = chosen.filter(F.length("text") <= most_chars // 8).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    # The driver's memory bounds rows, never a text's words: a label's rows end before the one that goes over its half.
    sizes = chosen.select("doc_id", "y", F.length("text").alias("chars"), F.xxhash64("doc_id").alias("hash"))
    sizes = sizes.toPandas().sort_values(["hash", "doc_id"], kind="stable")
    fits = sizes.groupby("y")["chars"].cumsum() <= most_chars // 2
    if not fits.all():
        some = docs.sparkSession.createDataFrame(sizes.loc[fits, ["doc_id", "y"]], "doc_id long, y int")
        chosen = chosen.join(F.broadcast(some), ["doc_id", "y"])
    found = chosen.toPandas().sort_values(["doc_id", "y"], kind="stable")
    if not len(found):
        return TextCNN()
    vocabulary = Vocabulary(limit=1 << 62)
    words, counts, _ = vocabulary.batch(found["text"].tolist())
    return TextCNN().fit(np.split(words, np.cumsum(counts)[:-1]), vocabulary.rows, found["y"].to_numpy())


def logits(docs: DataFrame, model: TextCNN) -> DataFrame:
    """(doc_id, z, lang) of every row: the whole text's logit and language number."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, vocabulary = shared.value, Vocabulary()
        taps = Taps(model)
        for batch in batches:
            words, counts, before = vocabulary.batch(texts(batch["text"]))
            taps.learn(vocabulary, before)
            z, lang = np.zeros(0), np.zeros(0, np.int64)
            if len(counts):
                around, starts = padded(words, counts)
                z, lang = model.logits(model.pooled(around, starts, taps=taps)[0]), languages(vocabulary.votes[words], counts)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(z.astype(np.float64)), pa.array(lang, pa.int32())], names=["doc_id", "z", "lang"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, z double, lang int")


def scored(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held: int = 2, most_rows: int = 8_000) -> DataFrame:
    """(doc_id, score) of every row, 0..1; a logit at its language's threshold comes to CUT."""
    rows = labelled_rows(labels, label, folds, held)
    model = train(docs, rows.filter("NOT kept"), most_rows=most_rows)
    if not model.fitted:  # a handful of labels: the kept ones are needed for the fit
        model = train(docs, rows, most_rows=most_rows)
    if not model.fitted:
        return docs.select(F.col("doc_id").cast("long"), F.lit(0.0).alias("score"))
    raw = materialise(logits(docs, model))  # read twice: for the thresholds and for the scores
    shift = F.array(*map(F.lit, thresholds(raw, rows.filter("kept"))))
    z = F.col("z") - F.get(shift, F.col("lang")) + F.lit(float(np.log(CUT / (1 - CUT))))
    return raw.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, most_rows: int = 8_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs`."""
    out = scored(docs, labels, folds=folds, held=held, most_rows=most_rows)
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
