"""Pairs of images and spectra: names of match output, labels, the paired manifest, spectra on one grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asterfold.functions import scores, vectors
from asterfold.operators import validation

#: Stable names of match output, by the side that they come from.
LEFT = {"object_id": "source_object_id", "survey": "source_survey", "ra": "source_ra", "dec": "source_dec", "source_row_id": "source_row_id", "selection_reason": "selection_reason", "selection_rank": "selection_rank"}
RIGHT = {"object_id": "desi_object_id", "ra": "desi_ra", "dec": "desi_dec", "redshift": "desi_z", "redshift_error": "desi_zerr", "zwarn": "desi_zwarn"}


def named_matches(matches: DataFrame, left: dict[str, str], right: dict[str, str], suffixes: tuple[str, str] = ("_source", "_desi"), distance: str = "_dist_arcsec") -> DataFrame:
    """Suffixed match output under its stable names; left and right name each side's own columns. Missing columns raise."""
    names = {f"{left[k]}{suffixes[0]}": v for k, v in LEFT.items()} | {f"{right[k]}{suffixes[1]}": v for k, v in RIGHT.items()} | {distance: "separation_arcsec"}
    validation.require_columns(matches, list(names))
    return matches.select(*[F.col(f"`{k}`").alias(v) for k, v in names.items()])


def labels(rows: DataFrame, object_id: str, redshift: str, zwarn: str) -> DataFrame:
    """object_id string, z double, zwarn boolean; repeated ids raise."""
    out = validation.require_columns(rows, [object_id, redshift, zwarn]).select(F.col(object_id).cast("string").alias("object_id"), F.col(redshift).cast("double").alias("z"), F.col(zwarn).cast("boolean").alias("zwarn"))
    return validation.require_unique(out, "object_id")


def paired_manifest(selected: DataFrame) -> DataFrame:
    """Selected matches as pairs: one image and one spectrum a row, each once; numbers that aren't finite raise."""
    numbers = {"spectrum_ra": "desi_ra", "spectrum_dec": "desi_dec", "z": "desi_z", "zerr": "desi_zerr", "separation_arcsec": "separation_arcsec"}
    image = F.col("source_object_id").cast("string")
    out = selected.select(image.alias("object_id"), image.alias("image_object_id"), F.col("desi_object_id").cast("string").alias("spectrum_object_id"), "source_row_id", *[F.col(c).cast("double").alias(n) for n, c in numbers.items()])
    validation.require(out, {f"{n} not finite": ~scores.finite(F.col(n)) for n in numbers})
    return validation.require_unique(validation.require_unique(out, "object_id"), "spectrum_object_id")


def spectra(rows: DataFrame, object_id: str, spectrum: str, flux: str, wave: str, ivar: str, mask: str) -> tuple[DataFrame, DataFrame]:
    """(object_id, flux, ivar, mask) and the one-row table of the wavelengths that all rows share.

    The fields must be of one length, and the grids alike within a tolerance; both are counted in one pass, and only
    one grid is gathered.
    """
    s = lambda f: F.col(f"{spectrum}.{f}")
    grid = rows.select(s(wave).alias("wave")).where("wave is not null").limit(1)
    checked = rows.crossJoin(F.broadcast(grid))
    size = F.size(s(flux))
    validation.require(checked, {"lengths": F.coalesce((F.size(s(wave)) != size) | (F.size(s(ivar)) != size) | (F.size(s(mask)) != size), F.lit(True)), "grid": ~vectors.all_close(s(wave), F.col("wave"), 1e-5, 1e-8)})
    floats = lambda c: F.transform(c, lambda x: x.cast("float"))
    return rows.select(F.col(object_id).cast("string").alias("object_id"), floats(s(flux)).alias("flux"), floats(s(ivar)).alias("ivar"), F.transform(s(mask), lambda x: x.cast("boolean")).alias("mask")), grid


def rows_by_place(manifest: DataFrame, source: DataFrame, wanted: str, place: str, key: str, vector: str, dim: int) -> DataFrame:
    """The source's vectors at the manifest's `wanted` row numbers, `place` in the source; a missing row, an unlike id or another length raises when it is read."""
    at = source.select(F.col(place).alias("__place"), F.col(key).cast("string").alias("__id"), F.col(vector).alias("__v"))
    joined = manifest.join(at, manifest[wanted] == F.col("__place"), "left")
    fault = F.when(F.col("__id").isNull(), "no row").when(F.col("__id") != F.col(key).cast("string"), "another id").when(F.size("__v") != dim, "another length")
    sound = F.when(fault.isNull(), F.col("__v")).otherwise(F.raise_error(F.concat_ws(" ", fault, F.lit("at"), F.col(wanted).cast("string"))))
    return joined.withColumn(vector, sound).drop("__place", "__id", "__v")
