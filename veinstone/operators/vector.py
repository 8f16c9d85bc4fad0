"""Vector search: exact top-k in blocks, inverted lists with trained centroids, diversity re-ranking, embedding by hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinstone.session import stored

#: Bytes of a block of vectors as numbers of 4 bytes, of queries and of the base, and of the score matrix that two blocks make.
QUERY_BYTES, BASE_BYTES, SCORE_BYTES = 4 << 20, 32 << 20, 64 << 20
#: Bound of the sample that centroids are fitted on.
SAMPLE = 20_000
_FOUND = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The vectors of an Arrow column as a matrix, straight from its buffer."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64, copy=False) if len(column) else np.zeros((0, 0))


def _scores(metric: str, queries: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Higher is nearer: inner product, cosine, or the negative square of the distance."""
    if metric == "cosine":
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        return unit(queries) @ unit(base).T
    dots = queries @ base.T
    if metric == "ip":
        return dots
    return 2 * dots - (queries**2).sum(1)[:, None] - (base**2).sum(1)[None, :]


def _block_top(metric: str, k: int):
    """The k best of a block for each query of another; scores are made for as many queries at a time as SCORE_BYTES hold."""

    def run(queries: pa.Table, base: pa.Table) -> pa.Table:
        if not len(queries) or not len(base):
            return _FOUND.empty_table()
        base = base.sort_by("id")
        ids, mine = base["id"].to_numpy(), queries["query_id"].to_numpy()
        left, right = _matrix(queries["vector"]), _matrix(base["base_vector"])
        step, found = max(1, SCORE_BYTES // (8 * len(ids))), []
        for at in range(0, len(mine), step):
            scores = _scores(metric, left[at : at + step], right)
            rounded = -np.round(scores, 9)
            some = np.arange(len(ids))
            for n, row in enumerate(rounded):
                if len(ids) > k:  # all that tie with the k-th stay, so the smaller id can win
                    some = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1])
                best = some[np.argsort(row[some], kind="stable")[:k]]
                found.append((np.full(len(best), mine[at + n]), ids[best], scores[n][best]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found)], schema=_FOUND)

    return run


def _blocks(rows: DataFrame, vector: str, most: int) -> int:
    """Into how many blocks rows go so that one has `most` bytes of vectors on average."""
    n, size = rows.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    return max(1, -(-n * 4 * (size or 1) // most))


def top_k(queries: DataFrame, base: DataFrame, k: int = 5, metric: str = "ip", at_least: float | None = None) -> DataFrame:
    """(query_id, id, score, rank): the exact k nearest of base(id, vector) for each of queries(query_id, vector).

    Blocks of queries meet blocks of base vectors, both of a bounded number of bytes whatever the dimension; each meeting is a few
    matrix products that keep their k best, and a window over these keeps the k best of all. Ties go to the smaller id. metric: ip,
    cosine or l2 (score is then the negative square of the distance). Null vectors take no part.
    """
    queries, base = queries.where("vector is not null"), base.where("vector is not null")
    counts = (_blocks(queries, "vector", QUERY_BYTES), _blocks(base, "vector", BASE_BYTES))
    q = queries.select("query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(counts[0])).cast("int").alias("i"))
    b = base.select(F.col("id").alias("id"), F.col("vector").alias("base_vector"), F.pmod(F.xxhash64("id"), F.lit(counts[1])).cast("int").alias("j"))
    q = q.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(counts[1] - 1))))
    b = b.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(counts[0] - 1))))
    part = q.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(_block_top(metric, k), "query_id long, id long, score double")
    return _best(part if at_least is None else part.where(F.col("score") >= at_least), k)


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    """Inner product in Catalyst, for single comparisons."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def fit_centroids(base: DataFrame, lists: int | None = None, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centroids by Lloyd's rounds on a sample of at most SAMPLE vectors (the rows of least hash). lists: how many, by default the
    root of the number of rows, at most 1,024."""
    rows = base.where("vector is not null")
    lists = lists or int(max(1, min(1024, rows.count() ** 0.5)))
    data = _matrix(rows.select("vector", F.xxhash64("id", F.lit(seed)).alias("h")).orderBy("h").limit(SAMPLE).select("vector").toArrow()["vector"])
    lists = min(lists, len(data))
    centroids = data[:lists].copy()
    for _ in range(rounds):
        near = _scores("l2", data, centroids).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, data)
        counts = np.bincount(near, minlength=lists)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


def build_lists(base: DataFrame, centroids: np.ndarray) -> DataFrame:
    """base with `list`, the nearest centroid: the inverted-list index; every row is indexed."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                near = _scores("l2", _matrix(batch.column(1)), centroids).argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype("int32"))], names=["id", "vector", "list"])

    return base.where("vector is not null").select("id", "vector").mapInArrow(assign, "id long, vector array<float>, list int")


def fit_probe(base: DataFrame, index: DataFrame, centroids: np.ndarray, k: int = 5, metric: str = "ip", target: float = 0.95, sample: int = 256) -> int:
    """How many lists a query must probe so that `target` of its exact k nearest are in them: measured on at most `sample` vectors of
    base (the rows of least hash) against all."""
    queries = base.where("vector is not null").orderBy(F.xxhash64("id", F.lit(11))).limit(sample).select(F.col("id").alias("query_id"), "vector")
    queries = stored(queries, "sample")
    truth = top_k(queries, base, k, metric).select("query_id", "id").join(index.select("id", "list"), "id").select("query_id", "list").collect()
    asked = queries.toArrow()
    order = np.argsort(-_scores(metric if metric != "cosine" else "l2", _matrix(asked["vector"]), centroids), axis=1)
    place = {q: {int(n): rank for rank, n in enumerate(row)} for q, row in zip(asked["query_id"].to_pylist(), order)}
    ranks = sorted(place[q][n] for q, n in truth)
    return ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)] + 1 if ranks else 1


def search_lists(queries: DataFrame, index: DataFrame, centroids: np.ndarray, k: int = 5, probe: int = 8, metric: str = "ip") -> DataFrame:
    """Like `top_k`, over the `probe` lists nearest to each query only. A list is met block by block, so a large one is spread; so are
    the queries of a list that many are near to."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                order = np.argsort(-_scores(metric if metric != "cosine" else "l2", _matrix(batch.column(1)), centroids), axis=1)[:, :probe].astype("int32")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype="int32") * order.shape[1]), pa.array(order.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["query_id", "vector", "list"])

    routed = queries.where("vector is not null").select("query_id", "vector").mapInArrow(route, "query_id long, vector array<float>, list array<int>")
    rows = lambda most: max(1, most // (4 * centroids.shape[1]))
    sizes = index.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / rows(BASE_BYTES)).cast("int").alias("blocks"))  # one row per centroid
    q = routed.select("query_id", "vector", F.explode("list").alias("list")).join(F.broadcast(sizes), "list")
    q = q.select("query_id", "vector", "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    b = index.join(F.broadcast(sizes), "list").select("id", F.col("vector").alias("base_vector"), "list", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    shares = _blocks(queries, "vector", QUERY_BYTES)
    q = q.withColumn("share", F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int"))
    b = b.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    at = ["list", "block", "share"]
    part = q.groupBy(*at).cogroup(b.groupBy(*at)).applyInArrow(_block_top(metric, k), "query_id long, id long, score double")
    return _best(part, k)


def diversify(candidates: DataFrame, k: int = 5, weight: float = 0.5, at_least: float | None = None) -> DataFrame:
    """(query_id, id, score, rank): maximal marginal relevance over each query's candidates(query_id, id, score, vector), which are
    few: weight * score - (1 - weight) * the greatest inner product with what is picked; ties go to the smaller id. at_least: score
    below which a candidate takes no part."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id").reset_index(drop=True)
        vectors, scores = np.array(rows["vector"].tolist(), float), rows["score"].to_numpy()
        alike, chosen = vectors @ vectors.T, []
        while len(chosen) < min(k, len(rows)):
            gain = scores.copy() if not chosen else weight * scores - (1 - weight) * alike[:, chosen].max(1)
            gain[chosen] = -np.inf
            chosen.append(int(np.round(gain, 9).argmax()))
        out = rows.loc[chosen, ["query_id", "id", "score"]]
        return out.assign(rank=np.arange(1, len(chosen) + 1, dtype="int32"))

    kept = candidates if at_least is None else candidates.where(F.col("score") >= at_least)
    return kept.groupBy("query_id").applyInPandas(pick, "query_id long, id long, score double, rank int")


def retrieve(queries: DataFrame, base: DataFrame, k: int = 5, fetch: int = 20, at_least: float | None = 0.7, weight: float = 0.5) -> DataFrame:
    """Retrieval as a chat uses it: the `fetch` nearest by inner product, those of `at_least` kept, `k` diverse ones picked."""
    near = stored(top_k(queries, base, fetch), "near").select("query_id", "id", "score")
    return diversify(near.join(base, "id"), k, weight, at_least)


def embed(text: Column, size: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: words hashed with signs into `size` numbers, unit length; zeros for a text
    without words, null for null."""
    named = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731 - a value bound to a name is made once
    words = F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != "")
    signed = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(size)).cast("int").alias("at"), F.when(F.xxhash64(w, F.lit(1)) % 2 == 0, 1.0).otherwise(-1.0).alias("sign")))
    place = lambda all_, n: F.aggregate(F.filter(all_, lambda x: x["at"] == n), F.lit(0.0), lambda a, x: a + x["sign"])
    sums = named(signed, lambda all_: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda n: place(all_, n)))
    scaled = named(sums, lambda v: F.struct(v.alias("v"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)).alias("norm")))
    unit = named(scaled, lambda p: F.transform(p["v"], lambda x: F.when(p["norm"] > 0, x / p["norm"]).otherwise(0.0).cast("float")))
    return F.when(text.isNotNull(), unit)


def save_index(index: DataFrame, path: str, centroids: np.ndarray | None = None) -> None:
    """The index partitioned by list, so that a probe reads its lists only, and its centroids beside it."""
    index.write.partitionBy("list").parquet(f"{path}/lists", mode="overwrite")
    if centroids is not None:
        rows = [(n, c.tolist()) for n, c in enumerate(centroids)]
        index.sparkSession.createDataFrame(rows, "list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids", mode="overwrite")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray] | None:
    """(index, centroids) of a saved index; None if there is none, or only part of one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not all(files.exists(at(f"{path}/{part}/_SUCCESS")) for part in ("lists", "centroids")):
        return None
    centroids = spark.read.parquet(f"{path}/centroids").orderBy("list").select("centroid").collect()
    return spark.read.parquet(f"{path}/lists").select("id", "vector", "list"), np.array([r[0] for r in centroids], float)


def load_or_build(base: DataFrame, path: str, lists: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """The index saved at path; if there is none, one is built over base and saved."""
    spark = base.sparkSession
    if (found := load_index(spark, path)) is None:
        centroids = fit_centroids(base, lists)
        save_index(build_lists(base, centroids), path, centroids)
        found = load_index(spark, path)
    return found


def evaluate(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: recall, precision and mean reciprocal rank at k of found(query_id, id, rank) against truth(query_id, id)."""
    hits = found.where(F.col("rank") <= k).join(truth.select("query_id", "id").distinct().withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    by = hits.groupBy("query_id").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.count(F.lit(1)).alias("shown"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    want = truth.select("query_id", "id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    rows = want.join(by, "query_id", "left").na.fill(0, ["hits", "shown"])
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return rows.agg(F.count(F.lit(1)).alias("queries"), mean(F.col("hits") / F.col("wanted"), "recall"), mean(F.coalesce(F.col("hits") / F.nullif("shown", F.lit(0)), F.lit(0.0)), "precision"), mean(F.coalesce(1 / F.col("first"), F.lit(0.0)), "mrr"))
