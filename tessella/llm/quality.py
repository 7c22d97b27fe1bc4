"""Document quality by a factorisation machine over hashed words, structure and metadata.

A score is the logistic of w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j. The pairwise
part is half the sum over factors of (sum v_if x_i)^2 - sum (v_if x_i)^2, so a document costs
time linear in its distinct words. Words are hashed into a fixed number of buckets, so the
model's size doesn't depend on the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import map_batches, read, staged, training_fold

#: Word buckets; statistics and the bins of each; factors; labelled rows learnt from at most.
WORD_BITS, STATS, BINS, FACTORS, SAMPLE = 18, 12, 16, 8, 12_000
WIDTH = (1 << WORD_BITS) + STATS * BINS
THRESHOLD = 0.7
UPPER, LOWER, DIGIT, BLANK, BREAK, SYMBOL, WIDE = range(7)
KINDS = np.array([UPPER if 65 <= b <= 90 else LOWER if 97 <= b <= 122 else DIGIT if 48 <= b <= 57 else BREAK if b == 10 else BLANK if b in (32, 9, 13) else WIDE if b >= 128 else SYMBOL for b in range(256)], np.uint8)


class Buckets(dict):
    """Word buckets, kept for the words of usual length seen lately: some 12 MB at most."""

    def __missing__(self, word: str) -> int:
        b = xxhash.xxh64_intdigest(word.encode()) & ((1 << WORD_BITS) - 1)
        if len(word) <= 64:
            if len(self) >= 100_000:
                self.clear()
            self[word] = b
        return b


def binned(x: float, top: float) -> int:
    """One of BINS equal bins of 0 to top."""
    return min(BINS - 1, max(0, int(x / top * BINS)))


def features(text: str | None, n_chars: int | None, buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a whole document: unit-length log counts of its words, and one bin of each statistic."""
    text = text or ""
    found = text.split()
    ids, counts = np.unique(np.fromiter(map(buckets.__getitem__, found), np.int64, len(found)), return_counts=True)
    x = np.log1p(counts)
    x /= max(1e-9, float(np.sqrt((x * x).sum())))
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kinds = np.bincount(KINDS[raw], minlength=7) / max(1, len(raw))
    lines = text.split("\n")
    word = len(raw) * (1 - kinds[BLANK] - kinds[BREAK]) / max(1, len(found))
    letters = kinds[UPPER] + kinds[LOWER] + kinds[WIDE]
    stats = [
        binned(np.log2(1 + len(found)), 16), binned(word, 24), binned(kinds[UPPER] / max(1e-9, letters), 1), binned(kinds[DIGIT], 0.4),
        binned(kinds[SYMBOL], 0.4), binned(np.log2(len(lines)), 12), binned(np.log2(1 + len(raw) / len(lines)), 16), binned(1 - len(set(lines)) / len(lines), 1),
        binned(len(ids) / max(1, len(found)), 1), binned(max(map(len, found), default=0) ** 0.5, 32), binned(kinds[BLANK], 0.4), 0 if n_chars is None else 1 + min(BINS - 2, int(np.log2(1 + max(0, n_chars)) / 20 * (BINS - 1))),
    ]
    extra = (1 << WORD_BITS) + np.arange(STATS) * BINS + np.array(stats)
    return np.r_[ids, extra], np.r_[x, np.full(STATS, 0.5)]


@dataclass
class FactorisationMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    #: Whether both labels were seen.
    informed: bool = True

    def score(self, ids: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[ids] * x[:, None]
        total = v.sum(0)
        z = self.bias + self.weights[ids] @ x + 0.5 * float((total * total).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.08, decay: float = 1e-5, seed: int = 7) -> FactorisationMachine:
    """AdaGrad on the logistic loss. Without both labels the score is the labels' mean, or one half."""
    rng = np.random.default_rng(seed)
    mean = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    w, v = np.zeros(WIDTH, np.float32), rng.normal(0, 0.02, (WIDTH, FACTORS)).astype(np.float32)
    model = FactorisationMachine(float(np.log(mean / (1 - mean))), w, v)
    if len(set(labels.tolist())) < 2:
        model.factors, model.informed = np.zeros_like(v), False
        return model
    gw, gv = np.full(WIDTH, 1e-6, np.float32), np.full((WIDTH, FACTORS), 1e-6, np.float32)
    g0 = 1e-6
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
            ids = np.concatenate([rows[i][0] for i in part])
            x = np.concatenate([rows[i][1] for i in part]).astype(np.float32)
            starts = np.r_[0, np.cumsum([len(rows[i][0]) for i in part])[:-1]]
            sizes = [len(rows[i][0]) for i in part]
            vx = v[ids] * x[:, None]
            total = np.add.reduceat(vx, starts)
            z = model.bias + np.add.reduceat(w[ids] * x, starts) + 0.5 * ((total * total).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]).astype(np.float32) / len(part)
            each = np.repeat(error, sizes) * x
            used, at = np.unique(ids, return_inverse=True)
            dw = np.bincount(at, each, len(used)).astype(np.float32) + decay * w[used]
            grad = each[:, None] * (np.repeat(total, sizes, 0) - vx)
            dv = np.stack([np.bincount(at, grad[:, f], len(used)) for f in range(FACTORS)], 1).astype(np.float32) + decay * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * dv / np.sqrt(gv[used])
            g0 += float(error.sum()) ** 2
            model.bias -= rate * float(error.sum()) / g0**0.5
    return model


def labelled_sample(labels: DataFrame, label: str, bound: int, id_col: str = "doc_id") -> DataFrame:
    """(id, y): at most ``bound`` labelled rows of the training fold, those with the smallest hashed ids, staged."""
    rows = labels.where(training_fold(F.col(id_col)) & F.col(label).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("double").alias("y"))
    return staged(rows.orderBy(F.xxhash64("id"), "id").limit(bound), "sample")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorisationMachine:
    """A model from at most ``sample`` labelled documents of the training fold."""

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for b in batches:
            rows = [features(t.as_py(), n, buckets) for t, n in zip(b.column(2), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r[0].astype("<i4").tobytes() for r in rows]), pa.array([r[1].astype("<f4").tobytes() for r in rows])], ["id", "y", "ids", "x"])

    own = docs.select(F.col("doc_id").alias("id"), "text", F.col("n_chars").cast("long").alias("n"))
    known = own.join(F.broadcast(labelled_sample(labels, "quality", sample)), "id").select("id", "y", "text", "n")
    # The bound above holds for ids; rows that repeat an id are told apart by nothing else and count once.
    got = map_batches(known, sparse, "id long, y double, ids binary, x binary").dropDuplicates(["id"]).orderBy("id").collect()
    rows = [(np.frombuffer(r.ids, "<i4").astype(np.int64), np.frombuffer(r.x, "<f4")) for r in got]
    return fit(rows, np.array([r.y for r in got]))


def scored(docs: DataFrame, model: FactorisationMachine, columns: list[str], score_col: str = "score") -> DataFrame:
    """The named columns of docs and, as the last one, score_col (double) for every row, from its whole text and n_chars."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    needed = [*columns, *(c for c in ("text", "n_chars") if c not in columns)]
    width, text, n = len(columns), needed.index("text"), needed.index("n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, m = Buckets(), shared.value
        for b in batches:
            s = [m.score(*features(t.as_py(), c, buckets)) for t, c in zip(b.column(text), b.column(n).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(s, pa.float64())], [*(f"c{i}" for i in range(width)), "score"])

    schema = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))
    return map_batches(docs.select(*needed), run, f"{schema}, score double").toDF(*columns, score_col)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document.

    Null and empty texts are scored from their statistics alone; a null n_chars has a bin
    of its own; rows with null or repeated ids keep their own rows. Without labels all
    scores are one half.
    """
    docs = read(spark, sf_dir, "documents")
    out = scored(docs, train(docs, read(spark, sf_dir, "labels")), ["doc_id"])
    return out.select("doc_id", (~training_fold(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
