"""Approximate nearest neighbours by randomly rotated one-bit codes.

:func:`index` scales each vector to length 1, takes away a centre and turns what is left at random; it keeps the packed signs and two
correction scalars: the length of what is left, and the inner product of its direction with its code. :func:`search` turns a query the
same way, rounds its components to QUERY_BITS bits, and estimates inner products from packed bits alone: bits that code and query have in
common are counted, one plane of the query's bits after another. With direction u, code c and scalar f = <u, c>, <q, u> is about
<q, c> / f, off by a standard deviation of sqrt((1 - f^2) / (dim - 1) + step^2 / 12) / f, where step is that of the query's rounding.

In a block of vectors, each query's FIRST best by estimate are scored exactly, and the k-th of them is a limit that the k nearest reach.
Vectors whose estimate is at most EPSILON standard deviations below it are chosen for reranking by the exact cosine.

Queries and vectors are dealt into blocks of fixed size. Each vector block goes to each query block once, which is the stated query set
against all rows; a pair of blocks answers with k rows a query at most, and the k best are kept by rank. Vectors travel with their codes:
one bit a component tells little in few dimensions, and what survives the bounds as rows of (query, vector) would be more than the vectors
(on 51,282 random vectors of 64 components 10,000 for each query, at three standard deviations).

The centre is the mean of about SAMPLE vectors, drawn by hash; any centre gives right estimates, and all vectors are indexed.

Defined results: rows without an id, and vectors that are null, zero, or hold null or non-finite components take no part, neither as queries nor as
candidates; vectors of another length than the query's are no candidates for it. A query with fewer candidates gets all. Ties go to
the smaller id. A repeated id is a vector each time; rows of the query's own id are not candidates. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bound_arrow, freeing, freeing_groups

BLOCK_ROWS, QUERY_ROWS = 4096, 16_384
#: Standard deviations of the bound, bits of a query's component, vectors that are scored first as a multiple of k, vectors of the centre's sample.
EPSILON, QUERY_BITS, FIRST, SAMPLE = 3.0, 4, 8, 4096
SEED = 20_250_101
#: Estimates that are worked on at once.
CELLS = 1 << 19


def rotation(dim: int, seed: int = SEED):
    """A random orthogonal matrix, the same wherever it is made."""
    import numpy as np

    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v, dim) of the vectors that take part; single precision stays so."""
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    v = F.col(vector).cast(kind)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(F.col(key).isNotNull() & v.isNotNull() & finite & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def unit(x):
    """Rows of ``x`` in double precision, scaled to length 1."""
    import numpy as np

    x = x.astype(np.float64)
    x /= np.abs(x).max(1, initial=1e-300, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centres(rows: DataFrame, n: int) -> dict:
    """Mean of the sampled unit vectors of each length; ``n``: number of ``rows``."""
    import numpy as np

    span = 1 << 30
    some = rows.where(F.pmod(F.xxhash64(F.lit("centre"), "vec_id", "v"), F.lit(span)) < min(span, SAMPLE * span // max(1, n))).select("v", "dim").toArrow()
    dims, values = some["dim"].to_numpy(), some["v"].to_pylist()
    return {dim: unit(np.array([values[i] for i in np.flatnonzero(dims == dim).tolist()])).mean(0) for dim in np.unique(dims).tolist()}


def matrix(column, dim: int):
    """A list column of vectors of ``dim`` components as rows."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def packed(bits):
    """Rows of 0 and 1 as 64-bit words."""
    import numpy as np

    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), bool)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1).view(np.uint64)


def index(rows: DataFrame, means: dict) -> DataFrame:
    """``rows`` (vec_id, v, dim) with code (packed signs), norm (length of the centred unit vector) and fit (<its direction, code>)."""
    bound_arrow(rows.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        turns: dict = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            codes, norms, fits = [None] * len(dims), np.zeros(len(dims)), np.ones(len(dims))
            for dim in np.unique(dims).tolist():
                turn = turns[dim] = turns[dim] if dim in turns else rotation(dim)
                at = np.flatnonzero(dims == dim)
                x = unit(matrix(batch.column("v").take(pa.array(at)), dim)) - means.get(dim, 0.0)
                norm = np.sqrt((x * x).sum(1))
                y = (x / np.where(norm > 0, norm, 1)[:, None]) @ turn
                norms[at], fits[at] = norm, np.where(norm > 0, np.abs(y).sum(1) / np.sqrt(dim), 1.0)
                for i, word in zip(at.tolist(), packed(y >= 0), strict=True):
                    codes[i] = word.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), pa.array(norms), pa.array(fits)], [*batch.schema.names, "code", "norm", "fit"])

    return rows.mapInArrow(freeing(run), f"vec_id long, v {dict(rows.dtypes)['v']}, dim int, code binary, norm double, fit double")


class Query:
    """Rotated queries rounded to QUERY_BITS bits: a packed plane for each bit, and what turns counts into inner products."""

    def __init__(self, turned):
        import numpy as np

        low = turned.min(1, keepdims=True)
        self.step = np.maximum((turned.max(1, keepdims=True) - low) / ((1 << QUERY_BITS) - 1), 1e-12)
        level = np.rint((turned - low) / self.step).astype(np.int64)
        self.planes = [packed(level >> p & 1) for p in range(QUERY_BITS)]
        self.low, self.total = low, (low * turned.shape[1] + self.step * level.sum(1, keepdims=True))

    def products(self, some: slice, codes, ones, dim: int):
        """About <query, code> for the queries of ``some`` and all ``codes``; ``ones``: bits set in each code."""
        import numpy as np

        common = np.zeros((len(self.low[some]), len(codes)), np.int32)
        for p, plane in enumerate(self.planes):
            for w in range(codes.shape[1]):
                common += np.bitwise_count(plane[some, w][:, None] & codes[:, w][None]).astype(np.int32) << p
        return (2 * (self.low[some] * ones[None] + self.step[some] * common) - self.total[some]) / np.sqrt(dim)


def _search_block(means: dict, k: int, epsilon: float):
    def run(key, vectors, queries):
        import numpy as np
        import pyarrow as pa

        empty = pa.table({"query_id": pa.array([], pa.int64()), "query_row": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        n, m = vectors.num_rows, queries.num_rows
        if not n or not m:
            return empty
        dim = int(key[0].as_py())
        vectors = vectors.sort_by("vec_id")  # so that among equals the smaller id comes first
        x, q = (matrix(t.column("v"), dim).astype(np.float64) for t in (vectors, queries))
        ids, qids, qrows = vectors.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy(), queries.column("row").to_numpy()
        codes = np.frombuffer(b"".join(vectors.column("code").to_pylist()), np.uint64).reshape(n, -1)
        ones = np.bitwise_count(codes).sum(1)
        norm, fit = vectors.column("norm").to_numpy(), vectors.column("fit").to_numpy()
        lengths, q_lengths = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
        units, mean = unit(q), means.get(dim, np.zeros(dim))
        asked, base = Query(units @ rotation(dim)), units @ mean
        cosine = lambda i, at: (x[at] * q[i]).sum(1) / (lengths[at] * q_lengths[i])
        out_q, out_r, out_v, out_s = [], [], [], []
        step = max(1, CELLS // n)
        for lo in range(0, m, step):
            some = slice(lo, lo + step)
            # <query, v> = <query, centre> + norm * <query, direction>
            about = asked.products(some, codes, ones, dim) * (norm / fit)[None] + base[some, None]
            off = epsilon * norm[None] / fit[None] * np.sqrt(np.maximum(0, 1 - fit**2)[None] / max(1, dim - 1) + asked.step[some] ** 2 / 12) + 1e-6
            about[qids[some, None] == ids[None]] = -np.inf
            for j in range(len(about)):
                i, guess = lo + j, about[j]
                others = int(np.count_nonzero(guess > -np.inf))
                if not others:
                    continue
                first = np.argpartition(-guess, min(FIRST * k, others) - 1)[: min(FIRST * k, others)]
                limit = np.sort(cosine(i, first))[-min(k, len(first))]
                chosen = np.flatnonzero(guess + off[j] >= limit)
                chosen = np.union1d(chosen, first)
                score = cosine(i, chosen)
                best = np.argsort(-score, kind="stable")[:k]
                out_q += [int(qids[i])] * len(best)
                out_r += [int(qrows[i])] * len(best)
                out_v.append(ids[chosen[best]])
                out_s.append(score[best])
        if not out_q:
            return empty
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "query_row": pa.array(out_r, pa.int64()), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})

    return run


def search(indexed: DataFrame, queries: DataFrame, means: dict, n_vectors: int, n_queries: int, k: int = 5, epsilon: float = EPSILON) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest by cosine of each row of ``queries`` (vec_id, v, dim) in ``indexed``."""
    v_blocks, q_blocks = max(1, -(-n_vectors // BLOCK_ROWS)), max(1, -(-n_queries // QUERY_ROWS))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # by row, not by content: equal rows are dealt, too
    dealt = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    vectors = indexed.withColumn("vb", dealt(v_blocks)).withColumn("qb", each(q_blocks))
    asked = queries.withColumn("row", F.monotonically_increasing_id()).withColumn("qb", F.pmod(F.xxhash64("row"), F.lit(q_blocks)).cast("int")).withColumn("vb", each(v_blocks))
    by = ["dim", "vb", "qb"]
    kinds = "query_id long, query_row long, vec_id long, score double"
    near = vectors.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(freeing_groups(_search_block(means, k, epsilon)), kinds)
    w = W.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    rows = usable(embeddings, "vec_id", "embedding")
    asked = rows.where(F.col("vec_id") % every == 0)
    n = rows.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    means = centres(rows, n[0])
    return search(index(rows, means), asked, means, n[0], n[1], k)
