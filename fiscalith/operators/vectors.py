"""Vector top-k by exact cosine, queries in blocks against the whole corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fiscalith.session import cut_lineage, ship_package
from fiscalith.sources.tables import table_exists

#: Numbers, of vectors and of results, that the queries held against one scan of the corpus may take; more queries are done in further scans.
SCAN_NUMBERS = 1 << 23
#: Queries and corpus rows whose scores are computed at a time.
TILE = 1024


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length ``dim`` without nulls as a normalized matrix, and where they were."""
    flat = column.flatten()
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    where = np.flatnonzero(lengths == dim)
    if len(flat) == dim * len(where) and flat.null_count == 0:
        rows = flat.to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    else:
        good = [(i, v) for i, v in enumerate(column.to_pylist()) if v is not None and len(v) == dim and None not in v]
        where = np.array([i for i, _ in good], dtype=np.int64)
        rows = np.array([v for _, v in good], dtype=np.float64).reshape(-1, dim)
    norms = np.linalg.norm(rows, axis=1)
    use = norms > 0
    return rows[use] / norms[use, None], where[use]


class Best:
    """The ``k`` best of each of ``n`` queries so far: by score, equal ones by smaller id."""

    def __init__(self, n: int, k: int, ids: np.ndarray):
        self.k = k
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.zeros((n, k), dtype=ids.dtype) if ids.dtype != object else np.full((n, k), "", dtype=object)

    def add(self, at: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` of the queries ``at`` with rows ``ids``, which ascend."""
        kept = min(self.k, scores.shape[1])
        some = np.flatnonzero(scores.max(axis=1) >= self.scores[at, -1])
        if not len(some):
            return
        scores = scores[some]
        if kept < scores.shape[1]:
            # Of equal scores those on the left, which have the smaller ids: the last kept score decides, then the place.
            last = -np.partition(-scores, kept - 1, axis=1)[:, kept - 1 : kept]
            above, equal = scores > last, scores == last
            room = kept - above.sum(axis=1, keepdims=True)
            use = above | (equal & (np.cumsum(equal, axis=1) <= room))
            columns = np.nonzero(use)[1].reshape(len(some), kept)
        else:
            columns = np.broadcast_to(np.arange(kept), scores.shape)
        rows = some + (at.start or 0)
        s = np.concatenate([self.scores[rows], np.take_along_axis(scores, columns, axis=1)], axis=1)
        i = np.concatenate([self.ids[rows], ids[columns]], axis=1)
        place = i if i.dtype != object else np.unique(i, return_inverse=True)[1].reshape(i.shape)
        order = np.lexsort((place, -s), axis=-1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(s, order, axis=1)
        self.ids[rows] = np.take_along_axis(i, order, axis=1)


def top_k_cosine(
    queries: DataFrame,
    query_id: str,
    query_vector: str,
    corpus: DataFrame,
    corpus_id: str,
    corpus_vector: str,
    k: int,
    threshold: float = -1.0,
    digits: int = 6,
    block: int | None = None,
) -> DataFrame:
    """``query_id``, ``corpus_id``, ``score``, ``rank``: the ``k`` most similar corpus rows of each query.

    The queries are a stated set. They are counted; as many as ``SCAN_NUMBERS`` allows for (or ``block``) go to the workers at once and are held against
    one scan of the corpus, tile by tile. If there are more, each further part has a scan of its own, whose result is written down before the next
    part is read, so that the driver and the workers hold one part at a time and nothing is left out. A task keeps ``k`` rows a query, so the
    shuffle is small. Scores are rounded to ``digits`` before ranking, ties go to the smaller id. Null, empty, zero and differently long
    vectors match nothing; the length is that of the queries of a part. Scores below ``threshold`` are left out.
    """
    ship_package(corpus.sparkSession)
    usable = queries.where(F.col(query_vector).isNotNull() & (F.size(query_vector) > 0))
    about = usable.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(query_vector)).alias("dim")).first()
    ids_kind = corpus.schema[corpus_id].dataType
    ids_type = pa.int64() if isinstance(ids_kind, T.LongType) else pa.int32() if isinstance(ids_kind, T.IntegerType) else pa.string()
    out_type = T.StructType(
        [
            T.StructField(query_id, queries.schema[query_id].dataType),
            T.StructField(corpus_id, ids_kind),
            T.StructField("score", T.DoubleType()),
        ]
    )
    if not about.n:
        return corpus.sparkSession.createDataFrame([], T.StructType([*out_type.fields, T.StructField("rank", T.IntegerType())]))
    parts = -(-about.n // (block or max(1, SCAN_NUMBERS // (about.dim + 2 * k))))
    found = None
    for part in range(parts):
        mine = usable if parts == 1 else usable.where(F.pmod(F.xxhash64(query_id), F.lit(parts)) == part)
        held = mine.select(query_id, query_vector).toArrow()
        if held.num_rows == 0:
            continue
        vectors = held.column(1).combine_chunks()
        dim = len(vectors[0].as_py())
        matrix, where = _matrix(vectors, dim)
        shared = corpus.sparkSession.sparkContext.broadcast((matrix, held.column(0).combine_chunks().take(pa.array(where)), dim))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q, names, dim = shared.value
            best = None
            for batch in batches:
                rows, where = _matrix(batch.column(1), dim)
                if not len(rows) or not len(q):
                    continue
                ids = np.asarray(batch.column(0).to_pylist(), dtype=object if ids_type == pa.string() else np.int64)[where]
                order = np.argsort(ids, kind="stable")
                rows, ids = rows[order], ids[order]
                best = best or Best(len(q), k, ids)
                for a in range(0, len(q), TILE):
                    for b in range(0, len(rows), TILE):
                        scores = np.round(q[a : a + TILE] @ rows[b : b + TILE].T, digits)
                        scores[scores < threshold] = -np.inf
                        best.add(slice(a, a + TILE), scores, ids[b : b + TILE])
            if best is not None:
                at, place = np.nonzero(best.scores > -np.inf)
                columns = [names.take(pa.array(at)), pa.array(best.ids[at, place].tolist(), ids_type), pa.array(best.scores[at, place], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[query_id, corpus_id, "score"])

        one = corpus.select(corpus_id, corpus_vector).mapInArrow(run, out_type)
        if parts > 1:
            one = cut_lineage(one)
            shared.destroy()
        found = one if found is None else found.unionByName(one)
    place = Window.partitionBy(query_id).orderBy(F.desc("score"), corpus_id)
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


@lru_cache(maxsize=1 << 16)
def _word_features(word: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of a word and its letter trigrams."""
    padded = f"^{word}$"
    grams = [word, *(padded[i : i + 3] for i in range(len(padded) - 2))]
    codes = np.array([int.from_bytes(hashlib.md5(g.encode("utf-8", "surrogatepass")).digest()[:8], "big") for g in grams], dtype=np.uint64)
    weights = np.where(codes >> np.uint64(63), 1.0, -1.0)
    weights[0] *= 2
    return (codes % np.uint64(dim)).astype(np.int64), weights


def hashed_embedding(text: Column, dim: int = 256) -> Column:
    """A vector from text without any model: words and letter trigrams hashed with signs; null for blank text.

    Whole numbers, not of length one: cosines do not need it, and they come out the same everywhere. The stand-in for a sentence encoder;
    replace it by a function of the same shape to use one.
    """

    session = SparkSession.getActiveSession()
    if session is not None:
        ship_package(session)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            parts = [_word_features(w, dim) for w in (t or "").lower().split()]
            if not parts:
                out.append(None)
                continue
            v = np.bincount(np.concatenate([p for p, _ in parts]), np.concatenate([w for _, w in parts]), dim)
            out.append(v.astype(np.float32) if v.any() else None)
        return pd.Series(out)

    return embed(text)


def _with_hash(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("__text", F.xxhash64(text))


def missing_vectors(df: DataFrame, id_column: str, text: str, cache: DataFrame) -> DataFrame:
    """``id_column`` and ``text`` of the rows with a text whose vectors the cache has not: by id, and by the text's hash if the cache has it."""
    rows = _with_hash(df.where(F.col(text).isNotNull()), text)
    keys = [id_column, "__text"] if "__text" in cache.columns else [id_column]
    return rows.join(cache.select(*keys), keys, "left_anti").select(id_column, text)


def cached_vectors(df: DataFrame, id_column: str, text: str, path: str, embed=hashed_embedding) -> DataFrame:
    """``id_column`` and ``vector`` of all rows with a text, from a Parquet table in ``path`` to which those it has not yet are added first.

    A row whose text has changed is embedded again; vectors of rows that are gone stay in the table and are left out of the result. One writer
    at a time: two that run together may both add the same row, which the result shows once.
    """
    spark = df.sparkSession
    if table_exists(spark, path):
        fresh = missing_vectors(df, id_column, text, spark.read.parquet(path))
    else:
        fresh = df.where(F.col(text).isNotNull()).select(id_column, text)
    _with_hash(fresh, text).select(id_column, "__text", embed(F.col(text)).alias("vector")).write.mode("append").parquet(path)
    wanted = _with_hash(df.where(F.col(text).isNotNull()), text).select(id_column, "__text").distinct()
    have = spark.read.parquet(path).dropDuplicates([id_column, "__text"])
    return have.join(wanted, [id_column, "__text"], "left_semi").select(id_column, "vector")


def invalidate_vectors(spark: SparkSession, path: str) -> bool:
    """Deletes the table of ``cached_vectors``, so that all are embedded anew; whether there was one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
