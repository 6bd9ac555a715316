"""Embedding whitening on distributed block matrices (operator 13).

1. Vectors are made whole numbers, x = floor(256 c); each distinct x once is
   the fit list, numbered without gaps from the counts of its partitions.
2. The centred rows of the fit list become an IndexedRowMatrix, that a
   BlockMatrix of ``ROWS`` rows a block.  Its transpose times itself is the
   scatter matrix, summed over ``splits`` of the middle dimension, so that no
   task gets more than its share of the blocks.
3. The scatter matrix (width x width numbers) is decomposed on the driver; the
   eigenvectors, over the roots of their eigenvalues, are the whitening matrix.
4. The BlockMatrix times the whitening matrix projects the rows; the same
   transpose product over these gives the covariance that is left.

Rows go back to their vectors by (x, salt): a vector that very many rows share
is met by a row for each of ``SALTS`` salts, and no more than that.

Results for odd rows: a vector that is null, empty, or has a null, NaN or
infinite entry gives no row, nor has one an entry whose 256-fold reaches 2^53
(no exact whole number), nor a vector of another width than the commonest (the
larger of equally common ones), as they span no common space.  Repeated rows
and null vec_ids are rows like others.  Components of zero variance (relative
1e-12) aren't numbered: a fit list of one vector, or an empty table, has no
rows.  ``deviation`` is decimal(38,0), exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtrails.llm.common import materialise

SCALE = 256
ROWS = 8192    # rows of a block: 4 MB at 64 columns
SALTS = 64

_DDL = ("vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, "
        "identity_error double")


def whole_vectors(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """vec_id, x, salt: the vectors in whole numbers; malformed ones go."""
    c = F.transform(F.col(vec), lambda e: e.cast("double") * SCALE)
    d = vectors.select("vec_id", c.alias("c")).where(
        F.col("c").isNotNull() & (F.size("c") > 0)
        & F.forall("c", lambda e: e.isNotNull() & (F.abs(e) < float(1 << 53))))  # NaN is above every number
    widths = d.groupBy(F.size("c").alias("width")).agg(F.count(F.lit(1)).alias("rows"))
    width = widths.orderBy(F.desc("rows"), F.desc("width")).limit(1).select("width").scalar()
    return d.where(F.size("c") == width).select(
        "vec_id", F.transform("c", lambda e: F.floor(e)).alias("x"),
        F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt"))


def fit_list(rows: DataFrame) -> DataFrame:
    """index, x, salts: every distinct vector, numbered from 0, with the salts
    of its rows."""
    once = materialise(
        rows.groupBy("x", "salt").agg(F.count(F.lit(1)).alias("m")).groupBy("x").agg(F.collect_set("salt").alias("salts"))
        .withColumn("at", F.spark_partition_id()).withColumn("id", F.monotonically_increasing_id()), "whitening-vectors")
    parts = once.groupBy("at").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("first"))
    # a row for each partition: few, whatever the vectors
    before = F.sum("m").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("at", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return once.join(F.broadcast(parts), "at").select((F.col("before") + F.col("id") - F.col("first")).alias("index"),
                                                      "x", "salts")


def block_matrix(rows: DataFrame, n: int, width: int, per_block: int = ROWS) -> BlockMatrix:
    """The rows (index, values: array of doubles) as a BlockMatrix."""
    v = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("values").alias("vector")), "vector")
    return IndexedRowMatrix(v, n, width).toBlockMatrix(per_block, width)


def gram(m: BlockMatrix, splits: int) -> np.ndarray:
    """m' m, the blocks dealt out over ``splits`` products and summed."""
    left, right = m.transpose()._java_matrix_wrapper, m._java_matrix_wrapper
    return BlockMatrix(left.call("multiply", right._java_model, splits), m.colsPerBlock, m.colsPerBlock
                       ).toLocalMatrix().toArray()


def rows_of(m: BlockMatrix) -> DataFrame:
    """index, values: the rows of a BlockMatrix."""
    found = callMLlibFunc("getIndexedRows", m.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return found.select("index", vector_to_array("vector").alias("values"))


def whiten(vectors: DataFrame, components: int = 4, vec: str = "embedding", per_block: int = ROWS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error:
    the leading whitened components of every well-formed vector."""
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", F.col(vec).alias("v"))
    rows = materialise(whole_vectors(vectors, "v"), "whitening-rows")
    fit = materialise(fit_list(rows), "whitening-fit")
    sums = fit.select(F.posexplode("x").alias("j", "e")).groupBy("j").agg(
        F.sum(F.col("e").cast("decimal(38,0)")).alias("s")).orderBy("j").collect()  # a row for each dimension
    n, width = fit.count(), len(sums)
    if not n:
        return spark.createDataFrame([], _DDL)
    total = F.array(*[F.lit(r["s"]).cast("decimal(38,0)") for r in sums])
    mean = F.array(*[F.lit(float(r["s"] / n)) for r in sums])

    centred = fit.select("index", F.zip_with("x", mean, lambda a, b: a.cast("double") - b).alias("values"))
    m = block_matrix(centred, n, width, per_block)
    splits = max(1, -(-n // (4 * per_block)))  # four blocks a product
    e, q = np.linalg.eigh(gram(m, splits) / n)
    e, q = e[::-1], q[:, ::-1]
    trace = e.sum()
    k = min(components, int((e > 1e-12 * max(e[0], 0)).sum())) if e[0] > 0 else 0
    if not k:
        return spark.createDataFrame([], _DDL)
    basis = np.asfortranarray(q[:, :k] / np.sqrt(e[:k]))
    w = Matrices.dense(width, k, basis.ravel(order="F"))
    projected = m.multiply(BlockMatrix(spark.sparkContext.parallelize([((0, 0), w)], 1), width, k, width, k))
    white = materialise(rows_of(projected), "whitening-projected")
    left = gram(block_matrix(white, n, k, per_block), splits) / n
    error = float(np.abs(left - np.eye(k)).max())

    gap = F.zip_with("x", total, lambda a, s: a.cast("decimal(38,0)") * F.lit(n) - s)
    square = F.aggregate(gap, F.lit(0).cast("decimal(38,0)"),
                         lambda acc, d: (acc + (d.cast("decimal(38,0)") * d.cast("decimal(38,0)"))).cast("decimal(38,0)"))
    share = F.array(*[F.lit(float(x / trace)) for x in e[:k]])
    own = fit.join(white, "index").select("x", F.explode("salts").alias("salt"), square.alias("deviation"), "values")
    return rows.join(own, ["x", "salt"]).select(
        "vec_id", F.lit(n).cast("bigint").alias("n"), "deviation", F.posexplode("values").alias("c", "whitened")).select(
        "vec_id", (F.col("c") + 1).alias("component"), "n", "deviation", "whitened",
        F.element_at(share, F.col("c") + 1).alias("explained"), F.lit(error).alias("identity_error"))
