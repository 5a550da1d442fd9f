"""Short forms: resizing a table of images by mode names, and a function for SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .errors import GENERIC, ResampleError
from .operators.rows import apply, resample_images, view
from .plans.plan import Format, Plan, Scaler

#: Modes as Python imaging libraries name them.
MODES = {"L": ("u8", "planar", 8), "LA": ("u8", "gray_alpha", 8), "RGB": ("u8", "rgb", 8), "RGBA": ("u8", "rgba", 8), "I;16": ("u16", "planar", 16), "I;16B": ("u16", "planar", 16), "F": ("f32", "planar", 0)}


def format_of(mode: str) -> Format:
    if mode not in MODES:
        raise ResampleError(GENERIC, f"no mode {mode!r}")
    return Format(*MODES[mode])


def resize(images: DataFrame, size: tuple[int, int], mode: str = "RGB", resampling: str | int = "lanczos3", premultiply_alpha: bool = True) -> DataFrame:
    """``images`` in a mode, resized. I;16B holds its bytes in network order; they are read and written so."""
    format = format_of(mode)
    out = images if mode != "I;16B" else images.withColumn("data", _reversed_pairs(F.col("data")))
    out = resample_images(out, Scaler(resampling), size, format.layout, premultiply_alpha)
    return out if mode != "I;16B" else out.withColumn("data", _reversed_pairs(F.col("data")))


@F.pandas_udf(BinaryType())
def _reversed_pairs(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else np.frombuffer(b, "<u2").byteswap().tobytes())


def plan(src: tuple[int, int], dst: tuple[int, int], mode: str = "RGB", resampling: str | int = "lanczos3", premultiply_alpha: bool = True) -> Plan:
    return Scaler(resampling).plan(src, dst, format_of(mode), premultiply_alpha)


def register(spark: SparkSession, name: str = "resize_image") -> None:
    """resize_image(data, width, height, to_width, to_height, mode, filter) for SQL: compact samples in and out."""

    @F.pandas_udf(BinaryType())
    def resize_image(data: pd.Series, w: pd.Series, h: pd.Series, tw: pd.Series, th: pd.Series, mode: pd.Series, which: pd.Series) -> pd.Series:
        rows = zip(data, w, h, tw, th, mode, which, strict=True)
        return pd.Series([_resized(d, size, format_of(m), f, True, m == "I;16B") for d, *size, m, f in rows], dtype=object)

    spark.udf.register(name, resize_image)


#: Layouts and sample types of the functions for SQL that name them, and what flags may say.
LAYOUTS, SAMPLES = ("rgba", "rgb", "cbcr", "planar"), {"8": "u8", "16": "u16", "_f32": "f32", "_f16": "f16"}
PREMULTIPLY_ALPHA, USE_MULTITHREADING = 1, 2


def register_formats(spark: SparkSession, prefix: str = "resize_") -> list[str]:
    """Sixteen functions for SQL, resize_rgba8 to resize_planar_f16: (data, width, height, to_width, to_height, depth, filter, flags).

    flags: PREMULTIPLY_ALPHA; USE_MULTITHREADING says nothing here, as Spark's partitions are what runs side by side.
    """
    names = []
    for layout in LAYOUTS:
        for suffix, sample in SAMPLES.items():
            names.append(f"{prefix}{layout}{suffix}")
            spark.udf.register(names[-1], _function(layout, sample))
    return names


def _function(layout: str, sample: str):
    @F.pandas_udf(BinaryType())
    def resize_format(data: pd.Series, w: pd.Series, h: pd.Series, tw: pd.Series, th: pd.Series, depth: pd.Series, which: pd.Series, flags: pd.Series) -> pd.Series:
        rows = zip(data, w, h, tw, th, depth, which, flags, strict=True)
        return pd.Series([_resized(d, size, Format(sample, layout, 8 if sample == "u8" else int(b)), f, bool(int(g) & PREMULTIPLY_ALPHA)) for d, *size, b, f, g in rows], dtype=object)

    return resize_format


def _resized(data: bytes | None, size: list, format: Format, which, premultiply: bool, network_order: bool = False) -> bytes | None:
    """One image's samples; null if they, or a side, are."""
    if data is None or any(pd.isna(s) for s in size):
        return None
    w, h, tw, th = map(int, size)
    px = view(np.frombuffer(data, "<u2").byteswap().tobytes() if network_order else data, w, h, 0, format)
    out = np.ascontiguousarray(apply(px, Scaler(which).plan((w, h), (tw, th), format, premultiply)))
    return (out.byteswap() if network_order else out).tobytes()
