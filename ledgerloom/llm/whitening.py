"""Embedding whitening: principal components of exactly centred vectors, and the vectors projected and scaled by them.

Each entry becomes the integer x = floor(64 c) + 1000000. Sums are exact, so n x - S is an exact integer and a centred
row (n x - S) / n is rounded once. MLlib's RowMatrix adds up the Gramian of the centred rows; only d x d matrices of the
vectors' dimension reach the driver, where ``eigh`` finds the components, which are sent out with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond give no x of 64 bits; they count as not finite.
LARGEST = float(2**62 // SCALE)


def fit_rows(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) of the rows whose vector is whole: not null or empty, every entry finite.

    A vector shorter than the longest of the table lacks entries and is left out likewise.
    """
    fits = lambda c: F.when(F.abs(c) <= LARGEST, F.floor(c * SCALE).cast("long") + SHIFT)  # noqa: E731  NaN is above
    each = vectors.select(F.col(id_).alias("vec_id"), F.transform(F.col(vector).cast("array<double>"), fits).alias("x"))
    whole = each.where((F.size("x") > 0) & F.forall("x", lambda x: x.isNotNull()))
    longest = whole.agg(F.max(F.size("x"))).first()[0]  # one number, so that later passes read the vectors once each
    return whole.where(F.size("x") == F.lit(longest).cast("int"))


def exact_sums(fit: DataFrame) -> tuple[int, list[int], int]:
    """Rows, sums of each dimension and the largest size of an entry, exact. Each task sends one row a dimension."""
    each = fit.select(F.posexplode("x").alias("i", "x"))
    x = F.col("x").cast("decimal(19,0)")
    rows = each.groupBy("i").agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.max(F.abs(x)).alias("m")).collect()
    rows.sort()  # as many as dimensions
    return (rows[0].n if rows else 0), [int(r.s) for r in rows], max((int(r.m) for r in rows), default=0)


def centred(n: int, sums: list[int], most: int) -> Column:
    """Array of (n x - S) / n: long arithmetic where it is exact, decimals otherwise."""
    kind = "long" if 2 * n * most < 2**63 else "decimal(38,0)"
    shift = F.array(*[F.lit(str(s)).cast(kind) for s in sums])
    return F.zip_with("x", shift, lambda x, s: (x.cast(kind) * F.lit(n).cast(kind) - s).cast("double") / F.lit(float(n)))


def covariance(rows: DataFrame, column: Column, n: int) -> np.ndarray:
    """Gramian of an array column of centred rows, divided by n."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray() / n


def principal(cov: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; those of no variance beyond rounding are left out."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    real = values > max(0.0, float(np.trace(cov))) * len(cov) * np.finfo(float).eps
    return values[real], vectors[:, real]


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
    """n x - S as doubles rounded once, and the exact sums of its squares; null where such a sum exceeds 64 bits."""
    rough = float(n) * np.abs(x).max(initial=0).astype(float) + float(max(abs(int(s)) for s in sums))
    exact = x * n - sums.astype(np.int64) if rough < 2**62 else x.astype(object) * n - sums
    largest = float(np.abs(exact).max(initial=0))
    wide = exact if largest**2 * x.shape[1] < 2**62 else exact.astype(object)
    total = (wide * wide).sum(axis=1)
    return exact.astype(float), [int(t) if t < 2**63 else None for t in total]


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n, deviation, whitened array<double>, explained array<double>, identity_error for each whole vector.

    Repeated vectors and ids count each. Where the vectors span fewer dimensions than ``components``, a row has that
    many components; equal vectors alone have none, and give empty arrays. An empty table gives no rows. A null vec_id
    stays. Other columns are left aside.
    """
    fit = fit_rows(vectors, id_, vector)
    n, sums, most = exact_sums(fit)
    empty = "vec_id {}, n long, deviation long, whitened array<double>".format(fit.schema["vec_id"].dataType.simpleString())
    cov = covariance(fit, centred(n, sums, most), n) if n else np.zeros((0, 0))
    values, axes = principal(cov, components)
    # d x components doubles and d sums
    sent = vectors.sparkSession.sparkContext.broadcast((axes / np.sqrt(values), np.array(sums, dtype=object)))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scaled, total = sent.value
        for batch in batches:
            if len(batch):
                rows, deviation = _deviations(np.stack(batch["x"].to_list()), n, total)
                whitened = list((rows / n) @ scaled)
                deviation = pd.array(deviation, dtype="Int64")
                yield pd.DataFrame({"vec_id": batch["vec_id"], "n": n, "deviation": deviation, "whitened": whitened})

    out = materialize(fit.mapInPandas(apply, empty), "whitened")
    k, error = len(values), 0.0
    if n and k:
        means = out.select(F.posexplode("whitened").alias("i", "w")).groupBy("i").agg(F.avg("w").alias("w")).collect()
        mean = F.array(*[F.lit(r.w) for r in sorted(means)])
        own = covariance(out, F.zip_with("whitened", mean, lambda w, m: w - m), n)
        error = float(np.abs(own - np.eye(k)).max())
    explained = [F.lit(float(v / np.trace(cov))) for v in values]
    return out.withColumns({"explained": F.array(*explained).cast("array<double>"), "identity_error": F.lit(error)})


def components_of(whitened: DataFrame) -> DataFrame:
    """One row for each vector and component, numbered from 1."""
    each = whitened.select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "c"))
    return each.select(
        "vec_id",
        (F.col("i") + 1).alias("component"),
        "n",
        "deviation",
        F.col("c.whitened").alias("whitened"),
        F.col("c.explained").alias("explained"),
        "identity_error",
    )
