"""Toxic passages as maximum-scoring segments of token log-odds.

Words and their beginnings get log-odds ratios between toxic and other labelled documents
under a Dirichlet prior that follows their frequency in the whole corpus; a document counts
a token once, and near copies (labelled documents of one label whose smallest hashed run of
five words is equal) count as one document. Tokens whose ratio is significant form the
lexicon with the ratio's confidence bound nearest 0 as their score. A word scores by itself
or the beginning whose bound is furthest from 0, and every other word scores a small
negative drift. One linear scan finds all maximal scoring segments of a document.

Labelled documents kept out of the lexicon calibrate it. Random documents' best segments
follow an extreme-value law with the usual length correction, whose decay solves the moment
equation of the scores of words in documents not labelled toxic, and whose scale is fitted
to their best segments. A segment's score normalised by the law is minus the logarithm of
how many as good a random document of that length holds. Softened at 0, these add up over
all segments, and a logistic on the sum and the largest gives the document's score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import map_batches, read, staged, training_fold
from tessella.llm.near_duplicates import WordHashes, kmers
from tessella.llm.quality import labelled_sample

#: Labelled rows learnt from at most; words of prior; significance and confidence bound in standard deviations; drift; clip.
SAMPLE, PRIOR, SIGNIFICANT, BOUND, DRIFT, CLIP = 20_000, 5_000.0, 3.5, 2.0, 0.35, 6.0
#: Of the labelled rows, one in so many calibrates instead of giving words.
CALIBRATION = 5
#: A passage is toxic if random documents of that length have one as good less often than this.
LEVEL, THRESHOLD = 0.05, 0.3
#: Lengths of the beginnings of words that are features too, marked by an asterisk.
BEGINNINGS = (4, 5, 6, 7, 8)
HEAD = min(BEGINNINGS)
WORD = regex.compile(r"[\p{L}\p{N}]+")


def found_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def features(word: str) -> list[str]:
    """A word and those of its beginnings that are shorter than it."""
    return [word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) > k)]


class Lexicon(dict):
    """Scores of words and beginnings; ``of`` keeps the scores of words seen lately.

    ``heads`` are the first letters of all its tokens: other words needn't be looked up.
    """

    def __init__(self, scores: dict[str, float]):
        super().__init__(scores)
        self.heads = {t[:HEAD] for t in self}
        self.seen: dict[str, float | None] = {}

    def __reduce__(self):
        return Lexicon, (dict(self),)

    def of(self, word: str) -> float | None:
        if word not in self.seen:
            score = max((self[f] for f in features(word) if f in self), key=abs, default=None)
            if len(word) > 64:
                return score
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[word] = score
        return self.seen[word]


@dataclass
class Toxicity:
    lexicon: Lexicon
    decay: float = 1.0
    scale: float = 1.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def normalised(self, scores: list[float], n: int) -> np.ndarray:
        """Segment scores of a document of n words: minus the logarithms of how many as good a random one holds."""
        return self.decay * np.array(scores, float) - np.log(self.scale * max(1, n))

    def passages(self, text: str | None) -> tuple[list[tuple[int, int, float]], int, float]:
        """Significant segments (first word, last word, normalised score), the number of words, and the document's score."""
        found, n = segments(text, self.lexicon)
        z = self.normalised([s for *_, s in found], n)
        cut = -np.log(-np.log1p(-LEVEL))
        return [(a, b, float(x)) for (a, b, _), x in zip(found, z) if x >= cut], n, self.score(z)

    def score(self, z: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(measures(z) @ self.weights, -30, 30))))


def measures(z: np.ndarray) -> np.ndarray:
    """What the logistic sees of a document's normalised segment scores: their softened sum, the largest, and one."""
    return np.array([np.log1p(np.logaddexp(0, z).sum()), np.clip(z.max(initial=-20.0), -20, 200) / 10, 1.0])


def segments(text: str | None, lexicon: Lexicon) -> tuple[list[tuple[int, int, float]], int]:
    """All maximal scoring segments (first word, last word, score) of a text and its number of words, in linear time."""
    found = found_words(text)
    get, heads = lexicon.of, lexicon.heads
    hits = [(i, s) for i, w in enumerate(found) if w[:HEAD] in heads and (s := get(w)) is not None]
    # Candidates with the sums before (low) and after (high) them; sums fall by the drift between hits.
    stack: list[tuple[int, int, float, float]] = []
    total, last = 0.0, -1
    # For each candidate, the index of the nearest earlier one whose low is smaller.
    link: list[int] = []
    for i, s in hits:
        total -= DRIFT * (i - last - 1)
        last = i
        low, total = total, total + s
        if s <= 0:
            continue
        first, high = i, total
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = link[j]
            if j < 0 or stack[j][3] >= high:
                stack.append((first, i, low, high))
                link.append(j)
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:], link[j:]
    return [(a, b, high - low) for a, b, low, high in stack], len(found)


def log_odds(counts: list[tuple[str, int, int, int]], n1: int, n0: int, n_all: int) -> dict[str, float]:
    """The bounds of significant log-odds ratios from (token, toxic, other, everywhere) counts."""
    out = {}
    for token, c1, c0, c in counts:
        a = PRIOR * max(c, 1) / max(1, n_all)
        y1, y0 = c1 + a, c0 + a
        delta = np.log(y1 / (n1 + PRIOR - y1)) - np.log(y0 / (n0 + PRIOR - y0))
        error = np.sqrt(1 / y1 + 1 / y0)
        if abs(delta) / error >= SIGNIFICANT:
            out[token] = float(np.clip(np.sign(delta) * (abs(delta) - BOUND * error), -CLIP, CLIP))
    return out


def decay_rate(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum p exp(rate s) = 1, for scores of negative mean; 1 if there is none."""
    p = weights / max(1e-12, weights.sum())
    if not len(scores) or scores.max() <= 0 or p @ scores >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    value = lambda r: p @ np.exp(np.clip(r * scores, -700, 700)) - 1
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return (low + high) / 2


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression, lightly regularised, by Newton steps."""
    theta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (p - y) + 0.1 * theta
        theta -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1]), grad)
    return theta


def held_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (y, text) the batch's tokens with their toxic and other documents."""
    for batch in batches:
        held = Counter(), Counter()
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            held[y > 0].update({f for w in set(found_words(text.as_py())) for f in features(w)})
        token = list(held[0] | held[1])
        yield pa.RecordBatch.from_arrays([pa.array(token, pa.string()), *(pa.array([held[k][t] for t in token], pa.int64()) for k in (1, 0))], ["token", "c1", "c0"])


def corpus_counts(docs: DataFrame, tokens: list[str]) -> tuple[list[int], int]:
    """How many (document, word) pairs bear each token, and how many there are in all."""
    shared = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(tokens)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        heads = {t[:HEAD] for t in at}
        total = np.zeros(len(at) + 1, np.int64)  # the last is for all words

        def add(counts: Counter) -> None:
            total[-1] += counts.total()
            for w, n in counts.items():
                if w[:HEAD] in heads:
                    for f in features(w):
                        if f in at:
                            total[at[f]] += n
            counts.clear()

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(set(found_words(text.as_py())))
                if len(counts) > 100_000:
                    add(counts)
        add(counts)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["k", "n"])

    found = {r.k: r.n for r in map_batches(docs.select("text"), run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    shared.destroy()
    return [found.get(k, 0) for k in range(len(tokens))], found.get(len(tokens), 0)


def run_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the smallest hashed run of five words to (id, text, y)."""
    hashes = WordHashes()
    for batch in batches:
        keys = [int(k.min()) >> 1 if len(k := kmers(t.as_py(), hashes)) else 0 for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], ["id", "text", "y", "run"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Toxicity:
    """A model from at most ``sample`` labelled documents of the training fold and the words of all documents.

    Without both labels the lexicon is empty and all scores are one half.
    """
    own = docs.select(F.col("doc_id").alias("id"), "text")
    known = own.join(F.broadcast(labelled_sample(labels, "toxic", sample)), "id").select("id", "text", "y")
    kind = known.schema["id"].dataType.simpleString()
    known = map_batches(known, run_keys, f"id {kind}, text string, y double, run long")
    known = known.groupBy("run", "y").agg(F.min(F.struct("id", "text")).alias("x")).select("x.id", "run", "y", "x.text")
    known = staged(known, "labelled")
    aside = F.pmod(F.xxhash64("run"), F.lit(CALIBRATION)) == 0
    held = map_batches(known.where(~aside).select("y", "text"), held_tokens, "token string, c1 long, c0 long")
    counts = staged(held.groupBy("token").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0")), "tokens")
    n1, n0 = counts.where(~F.col("token").endswith("*")).agg(F.coalesce(F.sum("c1"), F.lit(0)), F.coalesce(F.sum("c0"), F.lit(0))).first()
    if not n1 or not n0:
        return Toxicity(Lexicon({}))
    # Tokens worth a closer look; a flat half count stands for the prior here.
    a, b = F.col("c1") + 0.5, F.col("c0") + 0.5
    z = F.abs(F.log(a / n1) - F.log(b / n0)) / F.sqrt(1 / a + 1 / b)
    rows = counts.where(z >= 2).orderBy("token").collect()
    everywhere, n_all = corpus_counts(docs, [r.token for r in rows])
    lexicon = Lexicon(log_odds([(r.token, r.c1, r.c0, n) for r, n in zip(rows, everywhere)], n1, n0, n_all))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [segments(t.as_py(), lexicon) for t in batch.column(1)]
            hits = [[] if y else [s for w in found_words(t.as_py()) if w[:HEAD] in lexicon.heads and (s := lexicon.of(w)) is not None] for t, y in zip(batch.column(1), batch.column(2).to_pylist())]
            lists = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([n for _, n in got], pa.int64()), pa.array([[s for *_, s in x] for x, _ in got], lists), pa.array(hits, lists)], ["id", "y", "n", "s", "hits"])

    measured = lambda rows: map_batches(rows.select("id", "text", "y"), found, f"id {kind}, y double, n long, s array<double>, hits array<double>").orderBy("id", "y").collect()
    seen = measured(known.where(aside))
    if len({r.y > 0 for r in seen}) < 2:
        seen = measured(known)
    model, other = Toxicity(lexicon), [r for r in seen if not r.y]
    hits = np.array([s for r in other for s in r.hits])
    rest = max(1.0, float(sum(r.n for r in other)) - len(hits))
    model.decay = decay_rate(np.r_[hits, -DRIFT], np.r_[np.ones(len(hits)), rest])
    best = [(max(1, r.n), max(r.s, default=0.0)) for r in other]
    model.scale = max(1e-12, len(best) / max(1e-300, sum(n * float(np.exp(-min(700.0, model.decay * s))) for n, s in best)))
    x = np.array([measures(model.normalised(r.s, r.n)) for r in seen])
    model.weights = logistic(x, np.array([float(r.y > 0) for r in seen]))
    return model


def scored(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id_col, score, n_words, passages (first_word, last_word, strength), all of them.

    Null and empty texts have no passages and the score of a text without any. Rows with
    null or repeated ids keep their own rows; other columns are ignored, whatever their
    names. Of an empty table there are no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    item = pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("strength", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            got = [m.passages(t.as_py()) for t in batch.column(1)]
            spans = [[{"first_word": a, "last_word": b, "strength": z} for a, b, z in x] for x, *_ in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for *_, s in got], pa.float64()), pa.array([n for _, n, _ in got], pa.int32()), pa.array(spans, pa.list_(item))], ["id", "score", "n_words", "passages"])

    own = docs.select(F.col(id_col).alias("id"), text_col)
    kind = own.schema["id"].dataType.simpleString()
    return map_batches(own, run, f"id {kind}, score double, n_words int, passages array<struct<first_word: int, last_word: int, strength: double>>").withColumnRenamed("id", id_col)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score and the toxic passages of every document."""
    docs = read(spark, sf_dir, "documents")
    out = scored(docs, train(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", (~training_fold(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages")
