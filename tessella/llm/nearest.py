"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by the sum of one codeword from each of several full-dimensional
codebooks. The codebooks start as residual k-means on a bounded sample and are then refined
in turns: beam-search encoding, least squares for all codewords at once. Every vector is
encoded by beam search over the residuals, and the norms of the vector and of its
approximation are stored. A query scores a vector by adding one entry for each code from
its table of inner products, times the ratio of the norms.

A first pass over some ``LEVEL_ROWS`` vectors, chosen by hash, finds for each query the score
that a share ``rerank`` of all vectors reach. A second pass over all vectors scores every one
that reaches it by the exact inner product, and the best of each task merge by an
aggregation. So answers don't depend on how the vectors are dealt out, and recall doesn't fall
as tables grow. At least ``LEAST`` vectors are scored exactly, so small tables are searched in full.

Queries go out in groups of bounded size, each scored against all rows in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import map_batches, read, staged

#: Codebooks, codewords in each, beam, sampled vectors, rows of a block, queries of a group.
BOOKS, WORDS, BEAM, SAMPLE, ROWS, QUERIES = 16, 128, 4, 8_192, 16_384, 8_192
#: Share of all vectors, and least number, that each query scores exactly; vectors that the first pass reads.
RERANK, LEAST, LEVEL_ROWS = 0.04, 1_024, 32_768
TURNS, SEED = 4, 11


@dataclass
class AdditiveQuantiser:
    books: np.ndarray  # (books, words, dimensions)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes of each row by beam search over the residuals of the best partial sums."""
        books, words, _ = self.books.shape
        norms = (self.books**2).sum(2)
        out = np.empty((len(x), books), np.uint8)
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024]
            codes = np.zeros((len(part), 1, 0), np.uint8)
            residual, loss = part[:, None, :], (part**2).sum(1)[:, None]
            for m in range(books):
                # |r - c|^2 = |r|^2 - 2 r c + |c|^2
                cost = loss[:, :, None] - 2 * residual @ self.books[m].T + norms[m]
                flat = cost.reshape(len(part), -1)
                keep = min(beam, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                loss = np.take_along_axis(flat, best, 1)
                parent, word = best // words, best % words
                codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
                residual = np.take_along_axis(residual, parent[:, :, None], 1) - self.books[m][word]
            out[at : at + 1024] = codes[np.arange(len(part)), loss.argmin(1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[m][codes[:, m]] for m in range(len(self.books)))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of each query with every codeword: (queries, books * words)."""
        return queries @ self.books.reshape(-1, self.books.shape[2]).T


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, turns: int = TURNS) -> AdditiveQuantiser:
    """Codebooks for the rows of x, of which there may be fewer than words."""
    rng = np.random.default_rng(SEED)
    residual, found = x.copy(), []
    for _ in range(books):
        centres = residual[rng.choice(len(x), words, len(x) < words)].copy()
        for _ in range(8):
            near = ((centres**2).sum(1) - 2 * residual @ centres.T).argmin(1)
            counts = np.bincount(near, minlength=words)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, residual)
            centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], residual[rng.choice(len(x), words)])
        found.append(centres)
        residual = residual - centres[((centres**2).sum(1) - 2 * residual @ centres.T).argmin(1)]
    model = AdditiveQuantiser(np.stack(found).astype(np.float32))
    for _ in range(turns):
        codes = model.encode(x).astype(np.int64) + np.arange(books) * words
        # Normal equations of all codewords; ridge keeps unused ones at zero.
        design = np.zeros((len(x), books * words), np.float32)
        design[np.arange(len(x))[:, None], codes] = 1
        gram = design.T @ design + 1e-2 * np.eye(books * words, dtype=np.float32)
        model = AdditiveQuantiser(np.linalg.solve(gram, design.T @ x).reshape(model.books.shape).astype(np.float32))
    return model


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows with an id and a finite vector that isn't zero, without null components, of the dimensions most have."""
    v = F.col("v")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull()).where(ok)
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (size[0] if size else 0))


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", rerank: float = RERANK, least: int = LEAST) -> DataFrame:
    """For each row that ``is_query`` (a condition on id) the k other rows of largest inner product: query_id, rank, vec_id, score.

    Ties go to the smaller id. Vectors that are null or zero, or hold null or non-finite
    components, and those of other dimensions than most, take no part. Equal vectors are
    scored once: only the k + 1 smallest ids of a vector can be among anyone's k nearest,
    so each distinct vector keeps these. Rows that repeat an id with the same vector count
    once. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col).distinct()
    # The limit is in the plan before the shuffle, so a vector that a third of all rows share stays small.
    order = Window.partitionBy("v").orderBy("id")
    distinct = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = staged(distinct, "vectors")
    asked = staged(rows.where(is_query(F.col("id"))), "queries")
    if not distinct.staged_rows or not asked.staged_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Each task sends few more vectors than the sample holds: those of the smallest hashes.
    most = F.lit(min(1.0, 2 * SAMPLE / distinct.staged_rows) * 2**63)
    near_zero = distinct.where(F.abs(F.xxhash64("v")).cast("double") <= most)
    sample = near_zero.orderBy(F.abs(F.xxhash64("v")), F.col("ids")[0]).limit(SAMPLE).select("v").collect()
    model = spark.sparkContext.broadcast(train(np.array([r.v for r in sample], np.float32)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = floats(b.column(0))
            codes = model.value.encode(v.astype(np.float32))
            own = np.sqrt((v**2).sum(1))
            approximate = np.sqrt((model.value.decode(codes).astype(np.float64) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes]), pa.array(own), pa.array(approximate)], ["v", "ids", "codes", "norm", "code_norm"])

    indexed = staged(map_batches(distinct.select("v", "ids"), index, "v array<double>, ids array<long>, codes binary, norm double, code_norm double"), "index")
    share = -(-distinct.staged_rows // LEVEL_ROWS)
    want = max(1, round(max(least, rerank * distinct.staged_rows) / share))
    parts = -(-asked.staged_rows // QUERIES)
    found: list[str] = []
    for p in range(parts):
        # Groups by hashed id have QUERIES rows on average; each is fetched, sent out and answered on its own.
        group = asked.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(parts)) == p).orderBy("id").collect()
        if group:
            ids, q = np.array([r.id for r in group]), np.array([r.v for r in group])
            reached = levels(indexed, spark.sparkContext.broadcast(q), model, share, want)
            best = scored(indexed, spark.sparkContext.broadcast((ids, q, reached)), model, k)
            merged = best.groupBy("query_id").agg(F.flatten(F.collect_list("near")).alias("near"))
            top = F.slice(F.array_sort(F.transform("near", lambda x: F.struct((-x["score"]).alias("minus"), x["vec_id"].alias("vec_id")))), 1, k)
            found.append(staged(merged.select("query_id", F.posexplode(top).alias("rank", "x")), "nearest").staged_path)
    out = spark.read.schema("query_id long, rank int, x struct<minus: double, vec_id: long>").parquet(*found)
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.minus")).alias("score"))


def floats(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of ``rows`` rows or a little more."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(h.num_rows for h in held) >= rows:
            yield held
            held = []
    if held:
        yield held


def offsets(column: list[bytes], books: int, words: int) -> np.ndarray:
    """(books, rows): where each code's entry stands in a query's tables."""
    codes = np.frombuffer(b"".join(column), np.uint8).reshape(-1, books)
    return np.ascontiguousarray((codes.astype(np.int64) + np.arange(books) * words).T)


def approximate(tables: np.ndarray, at: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """(queries, rows): one table entry for each code, added up, times the norms' ratio."""
    out = np.take(tables, at[0], axis=1)
    for own in at[1:]:
        out += np.take(tables, own, axis=1)
    out *= ratio
    return out


def ratios(norm: pa.Array, code_norm: pa.Array) -> np.ndarray:
    return (norm.to_numpy() / np.maximum(code_norm.to_numpy(), 1e-300)).astype(np.float32)


def levels(indexed: DataFrame, queries, model, share: int, want: int) -> np.ndarray:
    """For each query the approximate score that ``want`` of one vector in ``share`` reach; minus infinity if there are fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, m = queries.value.astype(np.float32), model.value
        books, words, _ = m.books.shape
        best = np.full((len(q), want), -np.inf, np.float32)
        for held in blocks(batches, ROWS):
            at = offsets(sum((h.column(0).to_pylist() for h in held), []), books, words)
            ratio = np.concatenate([ratios(h.column(1), h.column(2)) for h in held])
            for k in range(0, len(q), 256):
                both = np.concatenate([best[k : k + 256], approximate(m.tables(q[k : k + 256]), at, ratio)], 1)
                best[k : k + 256] = -np.partition(-both, want - 1, axis=1)[:, :want]
        for k in range(0, len(q), 256):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, min(len(q), k + 256))), pa.array(list(best[k : k + 256]), pa.list_(pa.float32()))], ["query", "best"])

    part = indexed.where(F.pmod(F.xxhash64("v", F.lit(SEED)), F.lit(share)) == 0).select("codes", "norm", "code_norm")
    found = map_batches(part, run, "query long, best array<float>").groupBy("query").agg(F.sort_array(F.flatten(F.collect_list("best")), False)[want - 1].alias("level"))
    out = np.full(len(queries.value), -np.inf, np.float32)
    for r in found.collect():
        out[r.query] = r.level
    queries.unpersist()
    return out


def scored(indexed: DataFrame, queries, model, k: int) -> DataFrame:
    """(query_id, near): each query's k best (vec_id, score) of each block of rows, all that reach its level scored exactly."""
    item = pa.struct([("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (asked, q, least), m = queries.value, model.value
        books, words, _ = m.books.shape
        for held in blocks(batches, ROWS):
            v = np.concatenate([floats(h.column(0)) for h in held])
            own = [h.column(1) for h in held]
            sizes = np.concatenate([np.diff(x.offsets.to_numpy()) for x in own])
            ids, starts = np.concatenate([x.flatten().to_numpy() for x in own]), np.r_[0, np.cumsum(sizes)]
            at = offsets(sum((h.column(2).to_pylist() for h in held), []), books, words)
            ratio = np.concatenate([ratios(h.column(3), h.column(4)) for h in held])
            for p in range(0, len(asked), 256):
                part = q[p : p + 256]
                query, row = np.nonzero(approximate(m.tables(part.astype(np.float32)), at, ratio) >= least[p : p + 256, None])
                exact = np.concatenate([np.einsum("ij,ij->i", part[query[z : z + 65_536]], v[row[z : z + 65_536]]) for z in range(0, len(row), 65_536)] or [np.empty(0)])
                # One row for each id of a vector, but the query itself.
                n = sizes[row]
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                query, exact, vec = np.repeat(query, n), np.repeat(exact, n), ids[np.repeat(starts[row], n) + nth]
                other = vec != asked[p : p + 256][query]
                query, exact, vec = query[other], exact[other], vec[other]
                order = np.lexsort((vec, -exact, query))
                query, exact, vec = query[order], exact[order], vec[order]
                first = np.searchsorted(query, np.arange(len(part)))
                ends = np.minimum(np.r_[first[1:], len(query)], first + k)
                near = [[{"vec_id": x, "score": s} for x, s in zip(vec[a:b].tolist(), exact[a:b].tolist())] for a, b in zip(first, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(asked[p : p + 256]), pa.array(near, pa.list_(item))], ["query_id", "near"])

    return map_batches(indexed.select("v", "ids", "codes", "norm", "code_norm"), run, "query_id long, near array<struct<vec_id: long, score: double>>")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose vec_id 20 divides."""
    return nearest(read(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
