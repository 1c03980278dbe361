"""Image geometry, augmentation recipes and pixel transforms; codecs are optional, arithmetic transforms are NumPy."""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The six operations in order, and the uniform draws of their parameters.
OPERATIONS = ("AutoContrast", "Gamma", "Contrast", "WhiteBalance", "JPEG", "IlluminationField")
POLICY = "Broad6-Compose2"
DRAWS = {
    "AutoContrast": (),
    "Gamma": (("gamma", 0.8, 1.25),),
    "Contrast": (("factor", 0.8, 1.2),),
    "WhiteBalance": (("r", 0.9, 1.1), ("g", 0.9, 1.1), ("b", 0.9, 1.1)),
    "JPEG": (("quality", 70, 96),),
    "IlluminationField": (("amplitude", 0.1, 0.2), ("angle", 0.0, 2 * math.pi)),
}


def _generator(tag: str, path: str, seed: int) -> np.random.Generator:
    return np.random.default_rng(zlib.crc32("|".join((str(seed), tag, path.replace("\\", "/"))).encode()))


def recipe(path: str, seed: int = 42, policy: str = POLICY) -> list[tuple[str, dict]]:
    """The two operations of an image, and their parameters, from its path alone."""
    pick = _generator("ASSIGN::" + policy, path, seed).choice(len(OPERATIONS), size=2, replace=False)
    out = []
    for op in (OPERATIONS[int(i)] for i in pick):
        rng = _generator(op, path, seed)
        if op == "JPEG":
            values = {name: int(rng.integers(lo, hi)) for name, lo, hi in DRAWS[op]}
        elif op == "WhiteBalance":
            gain = rng.uniform(0.9, 1.1, size=3)
            values = dict(zip("rgb", map(float, gain / np.prod(gain) ** (1 / 3)), strict=True))
        else:
            values = {name: float(rng.uniform(lo, hi)) for name, lo, hi in DRAWS[op]}
        out.append((op, values))
    return out


def recipes(paths: DataFrame, path: str = "path", seed: int = 42) -> DataFrame:
    """Adds first, second (operations) and params (JSON) to every row; a null path has none."""
    schema = paths.select("*").schema.add("first", "string").add("second", "string").add("params", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [None if p is None else recipe(p, seed) for p in b.column(b.schema.get_field_index(path)).to_pylist()]
            cols = [[g and g[0][0] for g in got], [g and g[1][0] for g in got], [g and json.dumps([v for _, v in g], sort_keys=True) for g in got]]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.string()) for c in cols)], names=[*b.schema.names, "first", "second", "params"])

    return paths.mapInArrow(run, schema)


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0, 255).astype(np.uint8)


def gamma(rgb: np.ndarray, power: float) -> np.ndarray:
    return _bytes((rgb.astype(np.float32) / 255) ** power * 255)


def gains(rgb: np.ndarray, r: float, g: float, b: float) -> np.ndarray:
    return _bytes(rgb.astype(np.float32) * np.array((r, g, b), np.float32))


def brightness(rgb: np.ndarray, factor: float) -> np.ndarray:
    return gains(rgb, factor, factor, factor)


def illumination(rgb: np.ndarray, amplitude: float, angle: float) -> np.ndarray:
    """A linear light field across the image, from 1 - amplitude to 1 + amplitude along the angle."""
    h, w = rgb.shape[:2]
    ramp = math.sin(angle) * np.linspace(-1, 1, h, dtype=np.float32)[:, None] + math.cos(angle) * np.linspace(-1, 1, w, dtype=np.float32)
    top = np.abs(ramp).max()
    return _bytes(rgb.astype(np.float32) * (1 + amplitude * (ramp / top if top > 0 else ramp))[..., None])


#: Transforms by operation that need no codec; others come in through ``codecs``.
PIXELS: dict[str, Callable] = {"Gamma": lambda x, p: gamma(x, p["gamma"]), "WhiteBalance": lambda x, p: gains(x, p["r"], p["g"], p["b"]), "IlluminationField": lambda x, p: illumination(x, p["amplitude"], p["angle"])}


def apply(rgb: np.ndarray, steps: list[tuple[str, dict]], codecs: dict[str, Callable] | None = None) -> np.ndarray:
    """The steps in order. An operation that needs an image library is looked up in ``codecs``."""
    known = PIXELS | (codecs or {})
    for op, params in steps:
        if op not in known:
            raise ValueError(f"{op} needs an image library: pass it in codecs")
        rgb = known[op](rgb, params)
    return rgb


def preprocessed_size(h: Column, w: Column, factor: float, least: int = 640, patch: int = 16) -> Column:
    """struct<h, w>: both sides times the factor; a short side below ``least`` is scaled up to it, in whole patches."""
    h, w = F.floor(h * factor), F.floor(w * factor)
    scale = least / F.least(h, w).cast("double")
    grown = lambda side: F.greatest(F.lit(least), (F.ceil(side * scale / patch) * patch).cast("int"))
    fits = F.least(h, w) >= least
    return F.struct(F.when(fits, h).otherwise(grown(h)).cast("int").alias("h"), F.when(fits, w).otherwise(grown(w)).cast("int").alias("w"))


def float32_above(thresholds: np.ndarray, strict: bool) -> np.ndarray:
    """For each double the smallest float32 that is at least it, or above it: comparing float32 scores with >= then is exact."""
    t = np.asarray(thresholds, np.float64)
    f = t.astype(np.float32)
    low = f.astype(np.float64) <= t if strict else f.astype(np.float64) < t
    return np.where(low, np.nextafter(f, np.float32(np.inf)), f)


def stitch(crops: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, x, value) from overlapping crops (keys, crop, y0, x0, y, x, value): of a cell's values the last crop's."""
    cell = crops.withColumns({"y": F.col("y0") + F.col("y"), "x": F.col("x0") + F.col("x")})
    return cell.groupBy(*keys, "y", "x").agg(F.max_by("value", "crop").alias("value"))
