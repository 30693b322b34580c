"""Whitening of embeddings by Spark MLlib block matrices: scatter by a transposed product, eigenvectors, projection."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.llm.common import written
from claimscope.session import scratch_path

BLOCK_ROWS = 2048
BLOCK_BYTES = 1 << 20
# An eigenvalue of a smaller share of the largest one is rounding noise: its component has no direction.
NOISE = 1e-11
_BLOCKS = "block bigint, rows int, ids array<bigint>, whole binary, sums array<decimal(38,0)>"
_FIELDS = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def scaled(vectors: DataFrame, factor: int, offset: int) -> DataFrame:
    """(vec_id, width, whole): floor(factor x component) + offset of the vectors that can take part."""
    embedding = F.col("embedding")
    # Past 2^52 the whole number wouldn't fit a long; this also leaves out what is not finite.
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(2.0**52)))
    return vectors.where(F.size(embedding) > 0).where(fine).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.size(embedding).alias("width"),
        F.transform(embedding, lambda x: F.floor(x.cast("double") * factor).cast("bigint") + offset).alias("whole"),
    )


def indexed_blocks(rows: DataFrame, width: int, block_rows: int) -> DataFrame:
    """The rows of one width under consecutive numbers, ``block_rows`` of them per row of the written result.

    Numbers come from the place of a row in a written table, so a task that is run again gives the same ones. Rows per written
    part (one row per write task) are added up in one task and broadcast.
    """
    own = written(rows.where(F.col("width") == width).select(
        "vec_id", "whole", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")
    ))
    parts = own.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    # One row per write task, in order.
    offsets, total = [], 0
    for row in parts.orderBy("part").collect():
        offsets.append((row["part"], total - row["first"]))
        total += row["n"]
    shift = rows.sparkSession.createDataFrame(offsets, "part int, shift bigint")
    index = own.join(F.broadcast(shift), "part").withColumn("index", F.col("place") + F.col("shift"))

    def assemble(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("index")
        whole = np.stack(group["whole"].to_numpy()).astype(np.int64)
        small = len(whole) * float(np.abs(whole).max()) < 2.0**62
        sums = whole.sum(axis=0) if small else whole.astype(object).sum(axis=0)
        ids = [None if pd.isna(name) else int(name) for name in group["vec_id"]]
        return pd.DataFrame({"block": [int(key[0])], "rows": [len(whole)], "ids": [ids], "whole": [whole.tobytes()], "sums": [[Decimal(x) for x in sums.tolist()]]})

    blocks = index.withColumn("vec_id", F.col("vec_id").cast("decimal(20,0)"))  # pandas would turn whole numbers beside nulls into doubles
    return written(blocks.withColumn("block", F.floor(F.col("index") / block_rows).cast("bigint")).groupBy("block").applyInPandas(assemble, _BLOCKS))


def _away(whole: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exactly: as long numbers where they fit, else as Python's."""
    if n * float(np.abs(whole).max(initial=0)) + max(map(abs, sums.tolist()), default=0) < 2.0**62:
        return n * whole - sums.astype(np.int64)
    return n * whole.astype(object) - sums


def _deviations(away: np.ndarray) -> list[int | None]:
    """Sums of squares of the rows, exactly; null where one doesn't fit a long."""
    if away.dtype != object and float(np.abs(away).max(initial=0)) ** 2 * away.shape[1] < 2.0**62:
        return (away * away).sum(axis=1).tolist()
    squares = [sum(x * x for x in row) for row in away.astype(object).tolist()]
    return [x if x < 2**63 else None for x in squares]


def _index(kind: T.DataType) -> T.StructField:
    return T.StructField("blockIndex", T.StructType([T.StructField("_1", kind), T.StructField("_2", kind)]))


def block_matrix(blocks: DataFrame, columns: list[str], entries, block_rows: int, rows: int, width: int) -> BlockMatrix:
    """A block per row of ``blocks``; ``entries`` turns the row into its rows x width array of doubles.

    The blocks go through a written table, whose column of structs is read back as one of matrices: no number passes
    through a Python object, and a lost block is read again.
    """

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                yield pd.DataFrame({"block": [row["block"]], "rows": [row["rows"]], "values": [np.ascontiguousarray(entries(row)).ravel()]})

    filled = blocks.select("block", "rows", *columns).mapInPandas(fill, "block bigint, rows int, values array<double>")
    none = F.lit(None).cast("array<int>")
    structs = filled.select(
        F.struct(F.col("block").alias("_1"), F.lit(0).cast("bigint").alias("_2")).alias("blockIndex"),
        F.struct(  # a dense matrix, row by row
            F.lit(1).cast("tinyint").alias("type"), F.col("rows").alias("numRows"), F.lit(width).alias("numCols"), none.alias("colPtrs"),
            none.alias("rowIndices"), F.col("values"), F.lit(True).alias("isTransposed"),
        ).alias("subMatrix"),
    )
    path = scratch_path(blocks.sparkSession, "matrix")
    structs.write.option("compression", "zstd").parquet(path)
    schema = T.StructType([_index(T.LongType()), T.StructField("subMatrix", MatrixUDT())])
    read = blocks.sparkSession.read.schema(schema).parquet(path)
    return BlockMatrix(callMLlibFunc("createBlockMatrix", read, block_rows, width, rows, width), block_rows, width)


def stored_blocks(matrix: BlockMatrix, spark) -> DataFrame:
    """(block, projected): the number of each block row, and its numbers column by column, of a matrix of one block column."""
    path = scratch_path(spark, "matrix")
    blocks = callMLlibFunc("getMatrixBlocks", matrix._java_matrix_wrapper._java_model).toDF("blockIndex", "subMatrix")
    blocks.write.option("compression", "zstd").parquet(path)
    plain = T.StructType([_index(T.IntegerType()), T.StructField("subMatrix", MatrixUDT.sqlType())])
    found = spark.read.schema(plain).parquet(path)
    return found.select(F.col("blockIndex._1").cast("bigint").alias("block"), F.col("subMatrix.values").alias("projected"))


def product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """``left`` x ``right``; the dimension between them is cut into ``splits`` parts, which are multiplied apart and added up."""
    found = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(found, left.rowsPerBlock, right.colsPerBlock)


def scatter(matrix: BlockMatrix, splits: int) -> np.ndarray:
    """The transposed matrix times the matrix, as a local array of width x width."""
    found = product(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()
    return (found + found.T) / 2


def _whiten(rows: DataFrame, width: int, components: int, block_rows: int) -> DataFrame:
    spark = rows.sparkSession
    block_rows = max(1, min(block_rows, BLOCK_BYTES // (8 * width)))
    blocks = indexed_blocks(rows, width, block_rows)
    n, count = blocks.agg(F.sum("rows"), F.count(F.lit(1))).first()
    places = blocks.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    sums = np.array([int(row["x"]) for row in places], object)
    splits = max(1, min(count, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def away(row) -> np.ndarray:
        return _away(np.frombuffer(row["whole"], np.int64).reshape(-1, width), n, sums)

    centred = block_matrix(blocks, ["whole"], lambda row: away(row).astype(float) / n, block_rows, n, width)
    covariance = scatter(centred, splits) / n
    values, directions = np.linalg.eigh(covariance)
    values, directions = values[::-1][:components], directions[:, ::-1][:, :components]
    sound = values > NOISE * max(float(values[0]), 0.0)
    rooted = directions[:, sound] / np.sqrt(values[sound])
    k, kept = len(values), int(sound.sum())
    shares = [max(float(e), 0.0) / float(np.trace(covariance)) if sound[0] else None for e in values]

    if kept:
        # A single block: width x components.
        turn = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(width, kept, rooted.ravel(order="F")))], 1), width, kept, width, kept)
        projected = stored_blocks(product(centred, turn, 1), spark)
    else:
        projected = blocks.select("block", F.lit(None).cast("array<double>").alias("projected"))

    def deviate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.iloc[i]
                yield pd.DataFrame({"block": [row["block"]], "deviations": [_deviations(away(row))]})

    deviations = blocks.select("block", "whole").mapInPandas(deviate, "block bigint, deviations array<bigint>")
    joined = written(blocks.select("block", "rows", "ids").join(deviations, "block").join(projected, "block"))
    error = _identity_error(joined, n, kept, block_rows, splits) if kept else None

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                out = np.full((row.rows, k), np.nan)
                if kept:
                    out[:, :kept] = row.projected.reshape(kept, row.rows).T
                yield pd.DataFrame({
                    "vec_id": pd.array(list(row.ids), "Int64").repeat(k), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), row.rows),
                    "n": n, "deviation": pd.array(list(row.deviations), "Int64").repeat(k), "whitened": pd.Series(out.ravel()).astype(object).where(~np.isnan(out.ravel()), None),
                    "explained": pd.array(shares * row.rows, "Float64"), "identity_error": pd.array([error] * (k * row.rows), "Float64"),
                })

    # Lists of whole numbers that may hold nulls reach pandas as doubles; as text they stay exact.
    as_text = joined.withColumns({name: F.transform(name, lambda x: x.cast("string")) for name in ("ids", "deviations")})
    return as_text.select("rows", "ids", "deviations", "projected").mapInPandas(lines, f"vec_id bigint, {_FIELDS}")


def _identity_error(projected: DataFrame, n: int, k: int, block_rows: int, splits: int) -> float:
    """The largest entry of the projected rows' covariance minus the identity."""

    def entries(row) -> np.ndarray:
        return row["projected"].reshape(k, -1).T

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                yield pd.DataFrame({"i": np.arange(k), "x": entries(row).sum(axis=0)})

    found = projected.select("projected").mapInPandas(add, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    mean = np.array([row["x"] for row in found]) / n
    centred = block_matrix(projected, ["projected"], lambda row: entries(row) - mean, block_rows, n, k)
    return float(np.abs(scatter(centred, splits) / n - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = 8, factor: int = 1024, offset: int = 100_000, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Whitened coordinates of each row of ``vectors`` (vec_id, embedding) on its first ``components`` principal components.

    Columns, a row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error, as the contract of op11 names
    them. Entries are made whole numbers x first. Rows are numbered and put in blocks of ``block_rows``; a block matrix of n x - S over n, the centred rows, is
    multiplied by itself transposed; its eigenvectors are found on the driver (width x width numbers), and the block matrix times
    the eigenvectors over the roots of their values gives the coordinates, whose covariance comes from one more transposed product.

    Vectors that are null or empty, hold null or non-finite entries, or entries of 2^52 and more take no part. Vectors of another
    length have a fit of their own (one after the other: lengths should be few). A repeated row counts and is returned as often as it occurs; a null
    vec_id stays null. A component with no variance has null coordinates and no part in ``identity_error``; without any
    variance ``explained`` and ``identity_error`` are null. A deviation that doesn't fit a long is null. Equal eigenvalues: any
    directions of their space. No rows give no rows; other columns are not read.
    """
    rows = scaled(vectors, factor, offset)
    widths = sorted(row["width"] for row in rows.select("width").distinct().collect())
    found = vectors.sparkSession.createDataFrame([], f"vec_id bigint, {_FIELDS}")
    for i, width in enumerate(widths):
        own = _whiten(rows, width, components, block_rows)
        found = own if i == 0 else found.union(own)
    kind = dict(vectors.dtypes)["vec_id"]
    return found if kind == "bigint" else found.withColumn("vec_id", F.col("vec_id").cast(kind))
