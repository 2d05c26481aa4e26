"""Quality classifier: a weak-label model teaches a hashed linear scorer.

1. Overlapping heuristic labellers look at each text and vote clean, junk or not at all.
2. Expectation-maximisation estimates how often each labeller votes what on clean and on
   junk texts, and the share of junk. The votes' patterns are counted over all documents
   (at most ``3 ** labellers`` counts, whatever the input), which is all that it needs.
3. The posterior of each pattern labels a bounded sample (``SAMPLE`` rows) on which a
   logistic scorer over hashed character-shape trigrams and hashed words is trained.
4. The scorer judges every document; those likelier junk than not are rejected.

Defined results: null counts as empty; a text without words gets no votes and only the
scorer's intercept, and is kept; repeated rows are judged alike; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm._columns import raw_text, slices
from docsift.llm.repeats import Rolling

#: Documents on which the scorer is trained at most, and features: of hashed trigrams, of
#: hashed words, and the share of words that repeat the one before.
SAMPLE, TRIGRAMS, WORDS = 4096, 2048, 2048
REPEATED = TRIGRAMS + WORDS
FEATURES = REPEATED + 1
#: Words added to a text's own when shares of words are taken, so that a few words prove little.
DAMPING = 50
#: Least deviation that a feature is scaled by: trigrams and words. Rare words stay small.
LEAST_DEVIATION, LEAST_WORD_DEVIATION = 1e-3, 2e-2
STEP_BYTES = 1 << 19
#: Words within which a pair of words counts as recurring, however long a text is.
NEAR = 256
#: Votes of either kind that the label model adds to each class and labeller.
ADDED = 0.1

#: Classes of bytes: letters by case, digits, blanks, line ends; other ASCII stands for itself.
_LOWER, _UPPER, _DIGIT, _BLANK, _LINE = 1, 2, 3, 4, 5
_SENTENCE = b".,;:!?'\"()-"
#: What a word of prose may end in besides letters and digits.
_ENDS = b".,;:?'\")-"
_words = Rolling(37)


def _classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[0x80:] = out[ord("a") : ord("z") + 1] = _LOWER
    out[ord("A") : ord("Z") + 1] = _UPPER
    out[ord("0") : ord("9") + 1] = _DIGIT
    out[[9, 11, 12, 32]] = _BLANK
    out[[10, 13]] = _LINE
    rest = [b for b in range(33, 127) if not out[b]]
    out[rest] = 6 + np.arange(len(rest))
    return out


CLASS = _classes()
SHAPES = 64
#: Where each of the SHAPES ** 3 trigrams of classes hashes to.
SLOT = ((np.arange(SHAPES**3, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % TRIGRAMS
SLOT = SLOT.astype(np.uint16)  # two bytes for each byte of a text


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _recurring(hashes: np.ndarray, text_no: np.ndarray, texts: int) -> np.ndarray:
    """For each text, how many of its word pairs stood there within the last ``NEAR`` words."""
    if len(hashes) < 2:
        return np.zeros(texts)
    inside = text_no[1:] == text_no[:-1]
    at = np.flatnonzero(inside)
    pair = hashes[:-1][inside] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[1:][inside]
    order = np.argsort(pair, kind="stable")  # positions rise already
    again = np.zeros(len(at), bool)
    again[1:] = (pair[order][1:] == pair[order][:-1]) & (np.diff(at[order]) <= NEAR) & (text_no[at[order]][1:] == text_no[at[order]][:-1])
    return np.bincount(text_no[at[order[again]]] - 1, minlength=texts).astype(np.float64)


class Batch:
    """What labellers and scorer read off the texts of a slice."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        self.kind = kind = CLASS[data]
        count = lambda x: _sums(x, offsets)
        blank = (kind == _BLANK) | (kind == _LINE)
        inside = ~blank
        before = np.ones(len(data), bool)
        before[1:] = blank[:-1]
        first = np.zeros(len(data) + 1, bool)
        first[offsets[:-1]] = True
        start = inside & (before | first[:-1])
        self.words = count(start)
        self.dense = np.maximum(count(inside), 1)
        self.lower, self.upper = count(kind == _LOWER), count(kind == _UPPER)
        plain = np.isin(data, np.frombuffer(_SENTENCE, np.uint8))
        self.symbols = count((kind > _LINE) & ~plain)
        self.pipes, self.bangs = count(data == ord("|")), count(data == ord("!"))
        starts = np.flatnonzero(start)
        last = inside.copy()
        last[:-1] &= blank[1:] | first[1:-1]
        self.decorated = count(last & (kind > _LINE) & ~np.isin(data, np.frombuffer(_ENDS, np.uint8)))
        ends = np.flatnonzero(last) + 1
        prefix = _words.prefix(data)
        hashes = _words.of(prefix, starts, ends)
        same = np.zeros(len(data), bool)
        if len(starts) > 1:
            same[starts[1:]] = hashes[1:] == hashes[:-1]
        text_no = np.searchsorted(offsets, starts, side="right")
        same[starts[np.r_[True, np.diff(text_no) > 0]] if len(starts) else []] = False
        self.repeated = count(same)
        self.word_slots = (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % WORDS + TRIGRAMS
        self.word_slots = self.word_slots.astype(np.uint16)
        del prefix
        self.word_edges = np.searchsorted(starts, offsets)
        self.recurring = _recurring(hashes, text_no, len(offsets) - 1)

    def votes(self) -> np.ndarray:
        """Rows of votes: 0 none, 1 clean, 2 junk; a column for each of LABELLERS."""
        words = np.maximum(self.words, 1)
        letters = np.maximum(self.lower + self.upper, 1)
        return np.stack(
            [
                _vote(self.symbols / self.dense, 0.02, 0.10, self.words >= 3),
                _vote(self.upper / letters, 0.20, 0.50, letters >= 20),
                _vote(self.bangs / words, 0.05, 0.30, self.words >= 5),
                _vote(self.repeated / words, 0.05, 0.20, self.words >= 5),
                _vote(self.recurring / words, 0.10, 0.40, self.words >= 5),
                _vote(self.pipes / words, 0.02, 0.15, self.words >= 5),
                _vote(self.decorated / words, 0.05, 0.30, self.words >= 5),
                _vote(np.abs(self.dense / words - 7), 4, 13, self.words >= 5),
            ],
            axis=1,
        )

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text the places of its features that are not 0, rising, and their values."""
        at = SLOT[self.trigrams()]
        repeated = self.repeated / np.maximum(self.words, 1)
        edges = zip(self.offsets, self.offsets[1:], self.word_edges, self.word_edges[1:], repeated, strict=False)
        for a, b, first, stop, again in edges:
            found = [np.unique(at[a : max(a, b - 2)], return_counts=True), np.unique(self.word_slots[first:stop], return_counts=True)]
            values = [found[0][1] / max(b - a - 2, 1), found[1][1] / (stop - first + DAMPING), [again]]
            yield np.concatenate([found[0][0], found[1][0], [REPEATED]]).astype(np.uint16), np.concatenate(values).astype(np.float32)

    def trigrams(self) -> np.ndarray:
        k = self.kind.astype(np.int32)
        return (k[:-2] * SHAPES + k[1:-1]) * SHAPES + k[2:] if len(k) > 2 else np.zeros(0, np.int32)

    def margins(self, weights: np.ndarray, intercept: float) -> np.ndarray:
        """The linear scorer's value for each text."""
        values = np.zeros(len(self.data) + 1)
        at = self.trigrams()
        np.cumsum(weights[SLOT].astype(np.float64)[at], out=values[1 : len(at) + 1])
        values[len(at) + 1 :] = values[len(at)]
        a, b = self.offsets[:-1], np.maximum(self.offsets[1:] - 2, self.offsets[:-1])
        share = (values[b] - values[a]) / np.maximum(b - a, 1)
        words = np.zeros(len(self.word_slots) + 1)
        np.cumsum(weights[self.word_slots], out=words[1:])
        share += np.diff(words[self.word_edges]) / (np.diff(self.word_edges) + DAMPING)
        return share + weights[REPEATED] * self.repeated / np.maximum(self.words, 1) + intercept


LABELLERS = ("symbols", "capitals", "exclamations", "repeated words", "recurring pairs", "table bars", "decorated words", "word length")


def _vote(value: np.ndarray, clean: float, junk: float, sure: np.ndarray) -> np.ndarray:
    return np.where(~sure, 0, np.where(value > junk, 2, np.where(value < clean, 1, 0))).astype(np.int64)


def _pattern(votes: np.ndarray) -> np.ndarray:
    return votes @ 3 ** np.arange(votes.shape[1])


def _batches(column: pa.Array) -> Iterator[tuple[int, int, Batch]]:
    data, offsets = raw_text(column)
    for a, b in slices(offsets, STEP_BYTES):
        yield a, b, Batch(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, int] = {}
    for batch in batches:
        for _, _, texts in _batches(batch.column("text")):
            for key, n in zip(*np.unique(_pattern(texts.votes()), return_counts=True), strict=True):
                counts[int(key)] = counts.get(int(key), 0) + int(n)
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])


def expectation_maximisation(counts: dict[int, int], labellers: int = len(LABELLERS), rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of junk for every pattern, P(vote | class, labeller), share of junk.

    Starts from the belief that a text with a vote for junk is junk. A labeller that gives
    no vote says nothing. Each kind of junk is known to two labellers or more, so what one
    of them says alone counts for less than what several agree on; no estimate is bounded.
    """
    patterns = np.arange(3**labellers)
    votes = patterns[:, None] // 3 ** np.arange(labellers) % 3
    n = np.zeros(len(patterns))
    n[list(counts)] = list(counts.values())
    belief = np.where((votes == 2).any(axis=1), 0.9, 0.1)
    table = np.zeros((2, labellers, 3))  # no column 0: silence is no evidence
    share = 0.5
    for _ in range(rounds):
        before = belief
        for c, weight in enumerate((n * (1 - belief), n * belief)):
            for v in (1, 2):
                table[c, :, v] = weight @ (votes == v) + ADDED
            table[c, :, 1:] /= table[c, :, 1:].sum(axis=1, keepdims=True)
        share = (n @ belief + 1) / (n.sum() + 2)
        said = np.log(np.where(votes[None] == 0, 1.0, table[:, np.arange(labellers), votes]))
        logs = said.sum(axis=2)
        gap = np.clip(logs[1] - logs[0] + np.log(share / (1 - share)), -500, 500)
        belief = 1 / (1 + np.exp(-gap))
        if np.abs(belief - before)[n > 0].max(initial=0) < 1e-9:
            break
    return belief, table, share


def train(features: np.ndarray, labels: np.ndarray, rounds: int = 300, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps; ``features`` are scaled in place."""
    if not len(labels):
        return np.zeros(FEATURES), 0.0
    n, width = features.shape
    mean = features.mean(axis=0, dtype=np.float64)
    deviation = np.sqrt(np.maximum(np.einsum("ij,ij->j", features, features) / n - mean**2, 0))
    least = np.full(width, LEAST_DEVIATION)
    least[TRIGRAMS:REPEATED] = LEAST_WORD_DEVIATION
    scale = (1 / np.maximum(deviation, least)).astype(np.float32)
    x = features
    x *= scale
    labels = labels.astype(np.float32)
    v, b = np.ones(width, np.float32), np.float32(1)
    for _ in range(30):  # the steepest direction, by power iteration
        y = x @ v + b
        v, b = x.T @ y, y.sum()
        steepest = np.sqrt(v @ v + b * b)
        v, b = v / steepest, b / steepest
    step = 1 / (0.3 * steepest / n + penalty)
    w = v = np.zeros(width, np.float32)
    c = b = np.float32(0)
    for k in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(x @ v + b, -60, 60))) - labels
        w, old = (v - step * (x.T @ error / n + penalty * v)).astype(np.float32), w
        c, before = np.float32(b - step * error.mean()), c
        v, b = (w + k / (k + 3) * (w - old)).astype(np.float32), np.float32(c + k / (k + 3) * (c - before))
    return (w * scale).astype(np.float64), float(c)


def _examples(belief):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in _batches(batch.column("text")):
                rows = [at.tobytes() + values.tobytes() for at, values in texts.features()]
                labels = belief.value[_pattern(texts.votes())]
                order = batch.column("order").slice(a, b - a)
                yield pa.RecordBatch.from_arrays([order, pa.array(rows, pa.binary()), pa.array(labels)], ["order", "features", "label"])

    return run


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        belief, weights, intercept = model.value
        for batch in batches:
            for a, b, texts in _batches(batch.column("text")):
                junk = 1 / (1 + np.exp(-np.clip(texts.margins(weights, intercept), -60, 60)))
                posterior = belief[_pattern(texts.votes())]
                kept = (junk <= 0.5) | (texts.words == 0)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in range(batch.num_columns)), pa.array(1 - junk), pa.array(1 - posterior), pa.array(kept)],
                    [*batch.schema.names, "quality", "posterior", "kept"],
                )

    return run


class Classifier:
    """A fitted classifier."""

    def __init__(self, belief: np.ndarray, weights: np.ndarray, intercept: float, accuracies: dict[str, tuple[float, float]]) -> None:
        self.belief, self.weights, self.intercept, self.accuracies = belief, weights, intercept, accuracies

    def judge(self, docs: DataFrame) -> DataFrame:
        """doc_id, quality (the scorer's), posterior (the label model's; both 0 to 1), kept."""
        model = docs.sparkSession.sparkContext.broadcast((self.belief, self.weights, self.intercept))
        schema = "doc_id long, text string, quality double, posterior double, kept boolean"
        return docs.select("doc_id", "text").mapInArrow(_scores(model), schema).drop("text")

    def keep(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` that are kept, with all their columns."""
        model = docs.sparkSession.sparkContext.broadcast((self.belief, self.weights, self.intercept))
        names = [f"c{i}" for i in range(len(docs.columns))]
        plain = docs.toDF(*["text" if c == "text" else n for c, n in zip(docs.columns, names, strict=True)])
        schema = ", ".join(f"`{n}` {t}" for n, t in plain.dtypes) + ", quality double, posterior double, kept boolean"
        judged = plain.mapInArrow(_scores(model), schema).filter("kept")
        return judged.drop("quality", "posterior", "kept").toDF(*docs.columns)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Count votes over all documents, estimate the label model, train on a sample by hash.

    The sample are the ``sample`` rows whose id and text hash lowest among about 1.3 times
    as many that the hash picks.
    """
    spark = docs.sparkSession
    counted = docs.select("text").mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    counts = {r.pattern: r.n for r in counted.collect()}  # at most 3 ** labellers rows
    belief, table, _ = expectation_maximisation(counts)
    total = sum(counts.values())
    share = min(1.0, 1.3 * sample / max(total, 1))
    order = F.xxhash64("doc_id", "text")
    chosen = docs.select("text", order.alias("order")).filter(F.abs(F.col("order") % 1_000_000) < int(share * 1_000_000) + 1)
    examples = chosen.mapInArrow(_examples(spark.sparkContext.broadcast(belief)), "order long, features binary, label double")
    rows = examples.orderBy("order", "features").limit(sample).collect()  # the same rows however the table is partitioned
    features = np.zeros((len(rows), FEATURES), np.float32)
    for i, r in enumerate(rows):
        n = len(r.features) // 6  # two bytes for a place, four for a value
        features[i, np.frombuffer(r.features, np.uint16, n)] = np.frombuffer(r.features, np.float32, n, 2 * n)
    weights, intercept = train(features, np.array([r.label for r in rows]))
    accuracies = {name: (float(table[0, i, 1]), float(table[1, i, 2])) for i, name in enumerate(LABELLERS)}
    return Classifier(belief, weights, intercept, accuracies)


def keep_good(docs: DataFrame) -> DataFrame:
    """Fit on ``docs`` and return the rows that are kept."""
    return fit(docs).keep(docs)
