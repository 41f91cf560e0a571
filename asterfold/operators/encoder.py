"""A spectrum encoder as a pyspark.ml Estimator and Model: spectra on one grid, continuum divided out, projected by PCA.

The fit sums one Gram matrix over the training rows; embedding is one matrix product an Arrow batch. A model is saved
as its parameters and a Parquet row, and names its content by a hash, so a reloaded one gives equal vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from asterfold.operators import heads

#: Smallest ratio to the continuum, and spectra that a task prepares at once.
FLOOR, CHUNK = 1e-3, 256


def on_grid(flux: np.ndarray, wave: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Linear interpolation on the grid, flat beyond the ends."""
    return np.interp(grid, wave, flux)


def continuum_free(rows: np.ndarray, window: int) -> np.ndarray:
    """log of each row over its sliding median (edges repeat the nearest value), ratios floored; 0 where the median isn't positive."""
    half = window // 2
    wide = np.pad(rows, ((0, 0), (half, half)), mode="edge")
    middle = np.median(np.lib.stride_tricks.sliding_window_view(wide, window, axis=1), axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(middle > 0, rows / middle, 1.0)
    return np.log(np.maximum(np.where(np.isfinite(share), share, 1.0), FLOOR))


def _lists(column: pa.Array) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    edges, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype("f8")
    return [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def prepared(batch: pa.RecordBatch, grid: np.ndarray, window: int) -> Iterator[np.ndarray]:
    """Features of a batch of (flux, wave), CHUNK rows at a time."""
    flux, wave = _lists(batch.column(0)), _lists(batch.column(1))
    for low in range(0, len(flux), CHUNK):
        rows = [on_grid(f, w, grid) for f, w in zip(flux[low : low + CHUNK], wave[low : low + CHUNK], strict=True)]
        yield continuum_free(np.stack(rows), window)


class _Spectra(Params):
    """Columns and sizes that encoder and model share."""

    fluxCol = Param(Params._dummy(), "fluxCol", "column of fluxes", TypeConverters.toString)
    waveCol = Param(Params._dummy(), "waveCol", "column of ascending wavelengths", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "column of embeddings", TypeConverters.toString)
    components = Param(Params._dummy(), "components", "numbers of an embedding", TypeConverters.toInt)
    pixels = Param(Params._dummy(), "pixels", "points of the common grid", TypeConverters.toInt)
    window = Param(Params._dummy(), "window", "odd width of the continuum's median", TypeConverters.toInt)

    def _check(self, df: DataFrame) -> DataFrame:
        """The flux and wave columns; a row that lacks either, or has them of unlike length or none, raises when it is read."""
        if self.getOrDefault(self.window) % 2 == 0:
            raise ValueError("the window must be odd")
        flux, wave = F.col(self.getOrDefault(self.fluxCol)), F.col(self.getOrDefault(self.waveCol))
        fine = (F.size(flux) == F.size(wave)) & (F.size(flux) > 0) & F.forall(flux, lambda x: x.isNotNull()) & F.forall(wave, lambda x: x.isNotNull())
        sound = F.when(F.coalesce(fine, F.lit(False)), flux.cast("array<double>")).otherwise(F.raise_error(F.lit("flux and wave must be of one length and hold no null")))
        return df.withColumns({"__flux": sound, "__wave": wave.cast("array<double>")})


class SpectrumPca(Estimator, _Spectra, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the common grid (from the least to the largest wavelength of the training rows) and the components on it."""

    @keyword_only
    def __init__(self, *, fluxCol: str = "flux", waveCol: str = "wave", outputCol: str = "embedding", components: int = 128, pixels: int = 1024, window: int = 51):
        super().__init__()
        self._setDefault(fluxCol="flux", waveCol="wave", outputCol="embedding", components=128, pixels=1024, window=51)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> SpectrumPcaModel:
        rows = self._check(df)
        pixels, window, k = (self.getOrDefault(p) for p in (self.pixels, self.window, self.components))
        ends = rows.agg(F.min(F.array_min("__wave")).alias("low"), F.max(F.array_max("__wave")).alias("high"), F.count("*").alias("n")).first()
        if not ends.n or k > min(ends.n, pixels):
            raise ValueError(f"{ends.n} spectra of {pixels} pixels can't give {k} components")
        grid = np.linspace(ends.low, ends.high, pixels)

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in prepared(batch, grid, window):
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * pixels, pa.int32()), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([lists, pa.array(np.zeros(len(x), "i8"))], ["x", "g"])

        m = heads.grams(rows.select("__flux", "__wave").mapInArrow(features, "x array<double>, g long"), "x", [], "g")[0]
        mean = m[0, 1:] / m[0, 0]
        values, basis = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
        basis = basis[:, np.argsort(-values)[:k]]
        basis *= np.sign(basis[np.abs(basis).argmax(axis=0), range(k)])  # signs fixed by each largest weight
        return self._copyValues(SpectrumPcaModel(grid, mean, basis))


class SpectrumPcaModel(Model, _Spectra, MLReadable, MLWritable):
    """grid, mean and basis of a fit. transform() adds the embedding as floats; revision names the content."""

    def __init__(self, grid: np.ndarray, mean: np.ndarray, basis: np.ndarray):
        super().__init__()
        self.grid, self.mean, self.basis = grid, mean, basis

    @property
    def revision(self) -> str:
        window = str(self.getOrDefault(self.window)).encode()
        return hashlib.sha256(b"|".join([window, *(np.ascontiguousarray(x, "<f8").tobytes() for x in (self.grid, self.mean, self.basis))])).hexdigest()

    def _transform(self, df: DataFrame) -> DataFrame:
        grid, window, name = self.grid, self.getOrDefault(self.window), self.getOrDefault(self.outputCol)
        shared = df.sparkSession.sparkContext.broadcast((self.mean, self.basis))
        kept = [c for c in df.columns if c != name]
        rows = self._check(df).select("__flux", "__wave", *kept)

        def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mean, basis = shared.value
            for batch in batches:
                parts = [(x - mean) @ basis for x in prepared(batch, grid, window)] or [np.empty((0, basis.shape[1]))]
                out = np.concatenate(parts).astype("f4")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[2:], lists], [*kept, name])

        schema = StructType([*(df.schema[c] for c in kept), StructField(name, ArrayType(FloatType()))])
        return rows.mapInArrow(embed, schema)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: SpectrumPcaModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m, spark = self.model, self.sparkSession
        DefaultParamsWriter.saveMetadata(m, path, spark, extraMetadata={"revision": m.revision})
        row = (m.grid.tolist(), m.mean.tolist(), m.basis.T.tolist())
        spark.createDataFrame([row], "grid array<double>, mean array<double>, basis array<array<double>>").coalesce(1).write.parquet(f"{path}/data")


class _Reader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> SpectrumPcaModel:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        row = spark.read.parquet(f"{path}/data").first()
        model = self.cls(np.array(row.grid), np.array(row.mean), np.array(row.basis).T)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        if model.revision != metadata["revision"]:
            raise ValueError(f"{path} doesn't match its revision")
        return model
