"""Images in and out of DataFrames of one row per image."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..errors import (
    BUFFER_MISMATCH, DESTINATION_TOO_LARGE, EMPTY_PLAN, GENERIC, INVALID_DESTINATION_SIZE, INVALID_SCRATCH, INVALID_SOURCE_SIZE,
    INVALID_STRIDE, OUT_OF_MEMORY, SOURCE_TOO_LARGE, UNSUPPORTED_BIT_DEPTH, ZERO_SIZE, ResampleError,
)
from ..operators.rows import FEW, KINDS, TURNS, Batches, planned, resample_by, resample_images, turned, view
from ..plans.plan import LAYOUTS, Format, Plan, Scaler
from .codecs import Metadata, decode, encode, extract, upright

IMAGE = T.StructType([
    T.StructField("image_id", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
    T.StructField("channels", T.IntegerType()), T.StructField("sample", T.StringType()), T.StructField("bit_depth", T.IntegerType()),
    T.StructField("stride", T.IntegerType()), T.StructField("data", T.BinaryType()),
    T.StructField("metadata", T.StructType([T.StructField("icc", T.BinaryType()), T.StructField("exif", T.BinaryType()), T.StructField("xmp", T.BinaryType()), T.StructField("orientation", T.IntegerType())])),
])
_META = pa.struct([("icc", pa.binary()), ("exif", pa.binary()), ("xmp", pa.binary()), ("orientation", pa.int32())])


def from_buffer(spark: SparkSession, data: bytes, width: int, height: int, layout: str = "planar", sample: str = "u8", bit_depth: int = 0, stride: int = 0, image_id: int = 0) -> DataFrame:
    """One image from a buffer, checked as a table's rows are."""
    format = Format(sample, layout, bit_depth)
    view(data, width, height, stride, format)
    return spark.createDataFrame([(image_id, width, height, format.channels, sample, bit_depth, stride, data, None)], IMAGE)


def allocate(rows: DataFrame, width: int, height: int, layout: str = "planar", sample: str = "u8", bit_depth: int = 0) -> DataFrame:
    """An image of zeros for each row's image_id."""
    if width <= 0 or height <= 0:
        raise ResampleError(ZERO_SIZE, "an image of no width or height")
    size = width * height * LAYOUTS[layout] * np.dtype(KINDS[sample]).itemsize
    columns = {"width": width, "height": height, "channels": LAYOUTS[layout], "sample": sample, "bit_depth": bit_depth, "stride": 0}
    out = rows.select("image_id", *(F.lit(v).alias(k) for k, v in columns.items()), F.unhex(F.repeat(F.lit("00"), size)).alias("data"), F.lit(None).cast(IMAGE["metadata"].dataType).alias("metadata"))
    return out


def validate(images: DataFrame) -> DataFrame:
    """``images`` whose bad rows raise when they are read: no size, a stride shorter than a row, a buffer too short."""
    width = {k: np.dtype(v).itemsize for k, v in KINDS.items()}
    item = F.element_at(F.create_map(*[x for k, v in width.items() for x in (F.lit(k), F.lit(v))]), F.col("sample"))
    row = F.col("width") * F.col("channels")
    stride = F.when(F.col("stride") == 0, row).otherwise(F.col("stride"))
    need = (stride.cast("long") * (F.col("height") - 1) + row) * item
    bad = F.when((F.col("width") <= 0) | (F.col("height") <= 0), F.lit(f"[{ZERO_SIZE}] no width or height"))
    bad = bad.when(stride < row, F.lit(f"[{INVALID_STRIDE}] stride")).when(F.length("data") < need, F.lit(f"[{BUFFER_MISMATCH}] buffer"))
    return images.withColumn("data", F.when(bad.isNotNull(), F.raise_error(bad).cast("binary")).otherwise(F.col("data")))


#: Bytes of an address space, and bits that each sample type may have.
_MOST_BYTES = float(1 << 63)
_DEPTHS = {"u16": (1, 16), "s16": (1, 16)}


def problem_code(images: DataFrame, plan: Plan | None = None, memory: int | None = None) -> Column:
    """The code of a row's first fault, null for a good row.

    1 no size, 2 source too large to address, 3 target too large, 5 stride shorter than a line, 4 buffer too short, 6 bit depth; with a
    plan 12 an empty plan (equal sizes need none), 10 a size other than the plan's source, 11 one declared in to_width and to_height other than
    its target; 9 fewer bytes in ``scratch`` than a pass between needs, 8 more than ``memory`` bytes for it. Columns to_width,
    to_height and scratch count where ``images`` has them and they aren't null.
    """
    item = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, np.dtype(v).itemsize)])[F.col("sample")]
    w, h, n = (F.col(c).cast("double") for c in ("width", "height", "channels"))
    row = w * n
    stride = F.when(F.col("stride") == 0, row).otherwise(F.col("stride").cast("double"))
    has = lambda *names: all(c in images.columns for c in names)
    to_w, to_h = (F.col(c).cast("double") if has(c) else F.lit(plan.dst[i] if plan else None).cast("double") for i, c in enumerate(("to_width", "to_height")))
    # What the vertical pass leaves for the horizontal one.
    between = w * to_h * n * item
    cases = [(ZERO_SIZE, (w <= 0) | (h <= 0) | (to_w <= 0) | (to_h <= 0)), (SOURCE_TOO_LARGE, row * h * item >= _MOST_BYTES), (DESTINATION_TOO_LARGE, to_w * to_h * n * item >= _MOST_BYTES)]
    deep = F.create_map(*[F.lit(x) for k, v in _DEPTHS.items() for x in (k, v[1])])[F.col("sample")]
    cases += [(UNSUPPORTED_BIT_DEPTH, deep.isNotNull() & ~F.col("bit_depth").between(1, deep)), (INVALID_STRIDE, stride < row), (BUFFER_MISMATCH, F.octet_length("data") < (stride * (h - 1) + row) * item)]
    if plan:
        cases += [(INVALID_SOURCE_SIZE, (w != plan.src[0]) | (h != plan.src[1])), (INVALID_DESTINATION_SIZE, (to_w != plan.dst[0]) | (to_h != plan.dst[1])), (EMPTY_PLAN, F.lit(not plan.steps))]
    if has("scratch"):
        cases.append((INVALID_SCRATCH, F.col("scratch") < between))
    if memory is not None:
        cases.append((OUT_OF_MEMORY, between > memory))
    out = F.when(F.lit(False), F.lit(0))
    for code, bad in cases:
        out = out.when(F.coalesce(bad, F.lit(False)), F.lit(code))
    return out


def checked(images: DataFrame, plan: Plan | None = None, memory: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, (image_id, code) of the others): one pass, with nothing raised, so that a few bad images don't fail a job.

    Rows of null data, width or height have nothing to check and are good. See problem_code.
    """
    told = images.withColumn("_code", problem_code(images, plan, memory))
    return told.where("_code IS NULL").drop("_code"), told.where("_code IS NOT NULL").select("image_id", F.col("_code").alias("code"))


_FILE = T.StructType([T.StructField("path", T.StringType()), *IMAGE.fields, T.StructField("problem", T.StringType())])
_FILE_KINDS = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary(), _META, pa.string())


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Image files with their metadata: JPEG and GIF by Spark's image source, PNG (16 bits too) and BMP here.

    A file that can't be decoded is a row with null data, and ``problem`` says why. A file is a row, so a folder of any size is
    spread over tasks. Spark's source goes by a file's extension.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.xxhash64("path").alias("image_id"), "content")
    start = F.hex(F.substring("content", 1, 3))
    by_spark = start.startswith("FFD8") | (start == "474946")
    own = files.where(~by_spark).mapInArrow(_decoded, _FILE)
    theirs = files.where(by_spark).mapInArrow(_described, "path string, image_id long, metadata " + IMAGE["metadata"].dataType.simpleString())
    pixels = read_with_spark(spark, path, "*.{jpg,jpeg,jpe,gif,JPG,JPEG,JPE,GIF}", keep_path=True).drop("metadata", "image_id")
    met = theirs.join(pixels, "path", "left").withColumn("problem", F.when(F.col("data").isNull(), F.lit("Spark's image source can't decode it")))
    return own.unionByName(met.select(*_FILE.names))


def _metadata(data: bytes) -> dict:
    meta = extract(data)
    return {"icc": meta.icc, "exif": meta.exif, "xmp": meta.xmp, "orientation": meta.orientation}


def _row_of(name: str, key: int, data: bytes, pixels: bool = True) -> tuple:
    try:
        px, depth = decode(data)
        return (name, key, px.shape[1], px.shape[0], px.shape[2], "u8" if depth == 8 else "u16", depth, 0, np.ascontiguousarray(px).tobytes() if pixels else None, _metadata(data), None)
    except Exception as problem:  # whatever a damaged file leads to is told in its row
        return (name, key, *[None] * 8, f"{type(problem).__name__}: {problem}")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, key, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            row = _row_of(name, key, data)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _FILE_KINDS, strict=True)], _FILE.names)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_metadata(data) for data in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, _META)], ["path", "image_id", "metadata"])


def read_with_spark(spark: SparkSession, path: str, names: str = "*", keep_path: bool = False) -> DataFrame:
    """Whatever Spark's image source decodes (JPEG, PNG, GIF, BMP) of the files so named; its BGR order is turned to RGB. ``keep_path`` adds the file's path."""
    source = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", names).load(path).select("image.*")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [_swap(d, n) for d, n in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            columns = [batch.column(i) for i in range(4)] + [pa.array(["u8"] * batch.num_rows), pa.array([8] * batch.num_rows, pa.int32()), pa.array([0] * batch.num_rows, pa.int32()), pa.array(data, pa.binary()), pa.nulls(batch.num_rows, _META)]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[5:]], [*IMAGE.names, *batch.schema.names[5:]])

    origin = F.regexp_replace("origin", "^file:/+", "file:/")  # as the binary source writes it
    cells = source.select(F.xxhash64(origin).alias("image_id"), "width", "height", F.col("nChannels").alias("channels"), "data", *([origin.alias("path")] if keep_path else []))
    return cells.mapInArrow(each, T.StructType([*IMAGE.fields, *([T.StructField("path", T.StringType())] if keep_path else [])]))


def _swap(data: bytes, channels: int) -> bytes:
    if channels < 3:
        return data
    px = np.frombuffer(data, np.uint8).reshape(-1, channels)
    return px[:, [2, 1, 0, 3][:channels]].tobytes()


def auto_orient(images: DataFrame) -> DataFrame:
    """``images`` turned upright, each by the orientation in its own metadata, which then says 1; width and height follow.

    Images without metadata, of orientation 1 or of an unknown one, and rows of null data pass as they are. Rows don't depend on each other.
    """
    return images.mapInArrow(_turning(images.columns), images.schema)


def _turning(columns: list[str]) -> Batches:
    at = {c: columns.index(c) for c in ("width", "height", "channels", "sample", "bit_depth", "stride", "data", "metadata")}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            rows = [_upright_row(dict(zip(at, r, strict=True))) for r in zip(*(batch.column(i).to_pylist() for i in at.values()), strict=True)]
            columns = list(batch.columns)
            for c, i in at.items():
                columns[i] = pa.array([r[c] for r in rows], batch.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return each


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of FEW images at most, so that what is made of one stays small."""
    for batch in batches:
        yield from (batch.slice(lo, FEW) for lo in range(0, batch.num_rows, FEW))


def _upright_row(r: dict) -> dict:
    meta = r["metadata"]
    if r["data"] is None or not meta or meta["orientation"] not in TURNS:
        return r
    layout = {1: "planar", 2: "gray_alpha", 3: "rgb", 4: "rgba"}[r["channels"]]
    px = turned(view(r["data"], r["width"], r["height"], r["stride"] or 0, Format(r["sample"], layout, r["bit_depth"] or 8)), meta["orientation"])
    return r | {"width": px.shape[1], "height": px.shape[0], "stride": 0, "data": np.ascontiguousarray(px).tobytes(), "metadata": meta | {"exif": upright(meta["exif"]), "orientation": 1}}


def _file_of(r: dict, kind: str, icc: bool, exif: bool) -> bytes:
    layout = {1: "planar", 2: "gray_alpha", 3: "rgb", 4: "rgba"}[r["channels"]]
    px = view(r["data"], r["width"], r["height"], r["stride"] or 0, Format(r["sample"], layout, r["bit_depth"] or 8))
    m = r["metadata"] or {}
    return encode(px, kind, r["bit_depth"] or 8, Metadata(m.get("icc") if icc else None, m.get("exif") if exif else None))


def encoded(images: DataFrame, kind: str = "png", icc: bool = True, exif: bool = True, orient: bool = True) -> DataFrame:
    """(image_id, content): each image as a file; ICC and EXIF go along, XMP doesn't.

    ``orient``: images are turned upright first, and their EXIF says so; else both pixels and EXIF stay as they are.
    """
    if kind not in ("png", "bmp"):
        raise ResampleError(GENERIC, f"no encoder for {kind} files here")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_file_of(_upright_row(r) if orient else r, kind, icc, exif) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["image_id", "content"])

    return images.select(*IMAGE.names).mapInArrow(each, "image_id long, content binary")


def resize(images: DataFrame, box: tuple[int, int], layout: str, which: str | int = "lanczos3", orient: bool = True, premultiply: bool = True) -> DataFrame:
    """Images of any sizes to ``box``, turned upright first (``orient``), so that the box is that of what one sees; metadata goes along."""
    return resample_images(auto_orient(images) if orient else images, Scaler(which), box, layout, premultiply)


def save(images: DataFrame, folder: str, kind: str = "png", icc: bool = True, exif: bool = True, orient: bool = True) -> None:
    """Each image as a file <image_id>.<kind> below a folder that all executors share, written now and all or none.

    Tasks write into folders of their own, which are moved into place when all have ended well; a task that runs twice
    counts once, and a job that fails leaves nothing. Rows of null data have no file.
    """
    use(images.sparkSession)
    rows = images.select(*IMAGE.names).where("data IS NOT NULL")
    rows = auto_orient(rows) if orient else rows
    rows.write.format(ImageFiles.name()).mode("append").options(kind=kind, icc=icc, exif=exif).save(folder)


def as_rgb8(images: DataFrame) -> DataFrame:
    """``images`` of any layout and of u8 or u16 samples as 8-bit RGB: gray is repeated, alpha dropped."""
    at = {c: images.columns.index(c) for c in ("width", "height", "channels", "sample", "bit_depth", "stride", "data")}

    def one(w: int, h: int, n: int, sample: str, depth: int, stride: int, data: bytes | None) -> bytes | None:
        if data is None:
            return None
        px = view(data, w, h, stride or 0, Format(sample, {1: "planar", 2: "gray_alpha", 3: "rgb", 4: "rgba"}[n], depth or 8))
        if sample == "u16":
            px = (px.astype(np.uint32) * 255 + ((1 << depth) - 1) // 2) // ((1 << depth) - 1)
        return np.ascontiguousarray(np.broadcast_to(px[..., :1], (h, w, 3)) if n < 3 else px[..., :3]).astype(np.uint8).tobytes()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [one(*row) for row in zip(*(batch.column(i).to_pylist() for i in at.values()), strict=True)]
            columns, many = list(batch.columns), batch.num_rows
            for name, values in (("channels", [3] * many), ("sample", ["u8"] * many), ("bit_depth", [8] * many), ("stride", [0] * many), ("data", made)):
                columns[at[name]] = pa.array(values, batch.schema.field(at[name]).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return images.mapInArrow(each, images.schema)


def thirds(images: DataFrame, kind: str = "png") -> DataFrame:
    """(image_id, content): each image as RGB, shrunk to a third of each side by Lanczos3, as a file. Undecoded ones are left out."""
    small = resample_by(as_rgb8(images.where("data IS NOT NULL")), Scaler("lanczos3"), lambda w, h: (max(1, w // 3), max(1, h // 3)), "rgb")
    return encoded(small, kind, False, False)


#: Pixels that to_pixels gives out together.
_PIXELS = 1 << 16


def to_pixels(images: DataFrame, layout: str, orient: bool = False) -> DataFrame:
    """Pixel rows (image_id, y, x, v0, ...) of images; padding between rows is dropped.

    ``orient``: images are turned upright first, as by auto_orient, in the same Python worker.
    """
    turn, unpack = _turning(images.columns) if orient else None, _unpacking(images.columns, layout)
    return images.mapInArrow((lambda batches: unpack(turn(batches))) if orient else unpack, _pixels_of(layout))


def _pixels_of(layout: str) -> str:
    return "image_id long, y int, x int, " + ", ".join(f"v{c} double" for c in range(LAYOUTS[layout]))


def _unpacking(columns: list[str], layout: str) -> Batches:
    n = LAYOUTS[layout]
    at = [columns.index(c) for c in ("image_id", "width", "height", "sample", "bit_depth", "stride", "data")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in _few(batches):
            for r in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                if r[6] is None:
                    continue
                px = view(r[6], r[1], r[2], r[5] or 0, Format(r[3], layout, r[4] or 0)).reshape(-1, n)
                for lo in range(0, len(px), _PIXELS):
                    held.append((r[0], r[1], lo, px[lo : lo + _PIXELS]))
                    size += len(held[-1][3])
                    if size >= _PIXELS:
                        yield rows_of(held)
                        held, size = [], 0
        if held:
            yield rows_of(held)

    def rows_of(held: list[tuple[int | None, int, int, np.ndarray]]) -> pa.RecordBatch:
        many = [len(px) for *_, px in held]
        ids = pa.array([r[0] for r in held], pa.int64()).take(pa.array(np.repeat(np.arange(len(held)), many)))
        y, x = np.divmod(np.concatenate([np.arange(lo, lo + k) for (_, _, lo, _), k in zip(held, many, strict=True)]), np.repeat([r[1] for r in held], many))
        px = np.concatenate([r[3] for r in held])  # images of a table may differ in their samples' type, which numpy widens
        cells = [pa.array(px[:, c].astype(np.float64)) for c in range(n)]
        return pa.RecordBatch.from_arrays([ids, pa.array(y, pa.int32()), pa.array(x, pa.int32()), *cells], ["image_id", "y", "x", *(f"v{c}" for c in range(n))])

    return each


def integers(px: DataFrame) -> DataFrame:
    """The channels as whole numbers, as integer formats have them."""
    return px.withColumns({c: F.col(c).cast("long") for c in px.columns if c[0] == "v"})


def from_pixels(px: DataFrame, width: int, height: int, format: Format) -> DataFrame:
    """Images of pixel rows. Rows of pixels gather first, then images, each in one row, as it is stored."""
    return _gathered(px, format).mapInArrow(_packing(width, height, format), IMAGE)


def through_plan(px: DataFrame, plan: Plan) -> DataFrame:
    """Pixel rows of whole images through ``plan``: to_pixels of run_plan of from_pixels, in one Python worker a task instead of three."""
    pack, resize, unpack = _packing(*plan.src, plan.format), planned(IMAGE.names, plan), _unpacking(IMAGE.names, plan.format.layout)
    return _gathered(px, plan.format).mapInArrow(lambda batches: unpack(resize(pack(batches))), _pixels_of(plan.format.layout))


def _gathered(px: DataFrame, format: Format) -> DataFrame:
    """(image_id, v): all samples of an image in their order."""
    names = [f"v{c}" for c in range(format.channels)]
    cells = F.struct("x", F.array(*(F.col(c).cast("double") for c in names)).alias("v"))
    lines = px.repartition("image_id").groupBy("image_id", "y").agg(F.flatten(F.transform(F.array_sort(F.collect_list(cells)), lambda c: c["v"])).alias("v"))
    return lines.groupBy("image_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("y", "v"))), lambda r: r["v"])).alias("v"))


def _packing(width: int, height: int, format: Format) -> Batches:
    kind = KINDS[format.sample]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            data = [row.values.to_numpy().astype(kind).tobytes() for row in batch.column(1)]
            many = batch.num_rows
            fixed = [pa.array([v] * many, t) for v, t in ((width, pa.int32()), (height, pa.int32()), (format.channels, pa.int32()), (format.sample, pa.string()), (format.bit_depth, pa.int32()), (0, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *fixed, pa.array(data, pa.binary()), pa.nulls(many, _META)], IMAGE.names)

    return each


# ---- a data source -----------------------------------------------------------------------------------------------


def use(spark: SparkSession) -> None:
    """Makes spark.read.format("pixloom") and DataFrame.write.format("pixloom") known to a session."""
    spark.dataSource.register(ImageFiles)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


@dataclass
class _Written(WriterCommitMessage):
    folder: str | None
    files: int


class ImageFiles(DataSource):
    """A folder of PNG and BMP files as image rows, and back.

    Read options: ``bytes``, of files to a partition (64 MB); ``pixels``, false for metadata and sizes alone, with null data. Files that
    can't be decoded are rows whose ``problem`` says why. Write options: ``kind``, ``icc``, ``exif``; see save.
    """

    @classmethod
    def name(cls) -> str:
        return "pixloom"

    def schema(self) -> T.StructType:
        return _FILE

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ResampleError(GENERIC, "files are only ever added; name a new folder")
        return _Writer(self.options, schema.names)


def _flag(options: dict, name: str) -> bool:
    return str(options.get(name, "true")).lower() == "true"


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        """Files side by side up to a number of bytes; a larger file is alone. Only names and sizes are listed here."""
        system, where = fs.FileSystem.from_uri(_uri(self.options["path"]))
        most, out, held = int(self.options.get("bytes", 64 << 20)), [[]], 0
        found = system.get_file_info(fs.FileSelector(where, recursive=True))
        for f in sorted((f for f in found if f.type == fs.FileType.File and not _hidden(f.path, where)), key=lambda f: f.path):
            if out[-1] and held + f.size > most:
                out.append([])
                held = 0
            out[-1].append(f.path)
            held += f.size
        return [_Files(paths) for paths in out]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(_uri(self.options["path"]))
        pixels = _flag(self.options, "pixels")
        for path in partition.paths:
            with system.open_input_stream(path) as stream:
                content = stream.read()
            row = _row_of(path, zlib.crc32(path.encode()), content, pixels)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _FILE_KINDS, strict=True)], _FILE.names)


class _Writer(DataSourceArrowWriter):
    """Each attempt of a task writes into a folder below _temporary; committing moves a folder for each task."""

    def __init__(self, options: dict, names: list[str]):
        self.options, self.names, self.job = dict(options), names, uuid.uuid4().hex

    def _staging(self) -> str:
        return f"{_uri(self.options['path']).rstrip('/')}/_temporary-{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        task, files = f"part-{TaskContext.get().partitionId():05d}-{self.job[:8]}", 0
        system, top = fs.FileSystem.from_uri(f"{self._staging()}/{TaskContext.get().taskAttemptId()}/{task}")
        kind = self.options.get("kind", "png")
        for batch in batches:
            for r in batch.to_pylist():
                if not files:
                    system.create_dir(top, recursive=True)
                with system.open_output_stream(f"{top}/{r['image_id']}.{kind}") as out:
                    out.write(_file_of(r, kind, _flag(self.options, "icc"), _flag(self.options, "exif")))
                files += 1
        return _Written(top if files else None, files)

    def commit(self, messages: list) -> None:
        system, to = fs.FileSystem.from_uri(_uri(self.options["path"]))
        system.create_dir(to, recursive=True)
        for m in messages:
            if m is not None and m.folder:
                system.move(m.folder, f"{to.rstrip('/')}/{m.folder.rsplit('/', 1)[1]}")
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        system, staging = fs.FileSystem.from_uri(self._staging())
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)


def _uri(path: str) -> str:
    return path if "://" in path else f"file://{path.removeprefix('file:')}"


def _hidden(path: str, top: str) -> bool:
    return any(part[:1] in ("_", ".") for part in path[len(top) :].strip("/").split("/"))
