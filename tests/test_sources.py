import struct
import time

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from pixloom import api
from pixloom.errors import ResampleError
from pixloom.plans.plan import Scaler
from pixloom.sources import codecs, images
from pixloom.streaming import frames

EXIF = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x0112, 3, 1, 6) + struct.pack("<I", 0)


@pytest.mark.parametrize("channels,depth", [(1, 8), (2, 8), (3, 8), (4, 8), (1, 16), (3, 16)])
def test_png_round_trip(channels, depth):
    px = np.random.default_rng(channels).integers(0, 1 << depth, (7, 5, channels))
    got, bits = codecs.decode(codecs.encode(px, "png", depth))
    assert bits == depth and np.array_equal(got, px)


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    import zlib

    px = np.random.default_rng(kind).integers(0, 256, (4, 6, 3))
    line, rows, above = 18, [], np.zeros(18, int)
    for y in range(4):
        row = px[y].ravel()
        left = np.concatenate([np.zeros(3, int), row[:-3]])
        corner = np.concatenate([np.zeros(3, int), above[:-3]])
        p = left + above - corner
        d = np.stack([np.abs(p - left), np.abs(p - above), np.abs(p - corner)])
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], above, corner))
        guess = [np.zeros(line, int), left, above, (left + above) // 2, paeth][kind]
        rows.append(bytes([kind]) + ((row - guess) & 255).astype(np.uint8).tobytes())
        above = row
    plain = codecs.encode(px, "png")
    head = plain[: plain.index(b"IDAT") - 4]
    body = zlib.compress(b"".join(rows))
    made = head + struct.pack(">I", len(body)) + b"IDAT" + body + struct.pack(">I", zlib.crc32(b"IDAT" + body)) + plain[-12:]
    assert np.array_equal(codecs.decode(made)[0], px)


def test_bmp_and_metadata():
    px = np.random.default_rng(0).integers(0, 256, (3, 5, 3))
    assert np.array_equal(codecs.decode(codecs.encode(px, "bmp"))[0], px)
    made = codecs.encode(px, "png", meta=codecs.Metadata(icc=b"profile", exif=EXIF))
    found = codecs.extract(made)
    assert (found.icc, found.exif, found.orientation) == (b"profile", EXIF, 6)
    jpeg = codecs.inject(b"\xff\xd8\xff\xda", codecs.Metadata(icc=b"p" * 70000, exif=EXIF))
    found = codecs.extract(jpeg)
    assert found.icc == b"p" * 70000 and found.orientation == 6
    assert codecs.sniff(b"\0\0\0\x18ftypheic") == "heic"
    with pytest.raises(ResampleError):
        codecs.decode(b"\0\0\0\x18ftypheic")


def test_files_in_and_out(spark, tmp_path):
    px = np.random.default_rng(1).integers(0, 256, (8, 6, 3))
    (tmp_path / "a.png").write_bytes(codecs.encode(px, "png", meta=codecs.Metadata(exif=EXIF)))
    (tmp_path / "b.bmp").write_bytes(codecs.encode(px, "bmp"))
    read = images.read_files(spark, str(tmp_path)).drop("path")
    assert [bytes(r.data) for r in read.collect()] == [px.astype(np.uint8).tobytes()] * 2
    small = api.resize(read, (3, 4), "RGB")
    other = images.read_with_spark(spark, str(tmp_path / "b.bmp")).first()
    assert bytes(other.data) == px.astype(np.uint8).tobytes()
    # Orientation 6: the file with it is turned, and only then says that it is upright.
    files = {codecs.decode(f)[0].shape for f in (bytes(r.content) for r in images.encoded(small).collect())}
    assert files == {(3, 4, 3), (4, 3, 3)}
    kept = [codecs.extract(bytes(r.content)).orientation for r in images.encoded(read, orient=False).collect()]
    assert sorted(kept) == [1, 6]


@pytest.mark.parametrize("orientation", range(10))
def test_pixels_are_turned_by_their_own_orientation(spark, tmp_path, orientation):
    exif = EXIF.replace(struct.pack("<HHII", 0x0112, 3, 1, 6), struct.pack("<HHII", 0x0112, 3, 1, orientation))
    px = np.arange(3 * 2 * 3).reshape(2, 3, 3)
    (tmp_path / "a.png").write_bytes(codecs.encode(px, "png", meta=codecs.Metadata(icc=b"p", exif=exif)))
    # Where the stored row 0 and column 0 are to be seen, as the standard has it.
    want = {2: px[:, ::-1], 3: px[::-1, ::-1], 4: px[::-1], 5: px.transpose(1, 0, 2), 6: px.transpose(1, 0, 2)[:, ::-1], 7: px.transpose(1, 0, 2)[::-1, ::-1], 8: px.transpose(1, 0, 2)[::-1]}.get(orientation, px)
    read = images.read_files(spark, str(tmp_path)).drop("path")
    row = images.auto_orient(read).first()
    assert (row.height, row.width) == want.shape[:2] and bytes(row.data) == want.astype(np.uint8).tobytes()
    assert row.metadata.orientation == (orientation if orientation in (0, 9) else 1)
    file = bytes(images.encoded(read).first().content)
    assert np.array_equal(codecs.decode(file)[0], want) and codecs.extract(file).icc == b"p"
    assert codecs.extract(file).orientation == (orientation if orientation in (0, 9) else 1)
    made = images.resize(read, (6, 4), "rgb", "bilinear").first()
    assert (made.width, made.height) == (6, 4)


def test_source_and_committed_writes(spark, tmp_path):
    images.use(spark)
    px = [np.random.default_rng(i).integers(0, 256, (4, 5, 3)) for i in range(6)]
    for i, p in enumerate(px):
        (tmp_path / f"{i}.png").write_bytes(codecs.encode(p, "png", meta=codecs.Metadata(exif=EXIF) if i == 2 else codecs.Metadata()))
    (tmp_path / "x.png").write_bytes(b"no image")
    source = spark.read.format("pixloom").option("bytes", 200)
    read = source.load(str(tmp_path))
    rows = {r.path.rsplit("/", 1)[1]: r for r in read.collect()}
    assert len(rows) == 7 and rows["x.png"].problem and read.rdd.getNumPartitions() > 3
    assert all(bytes(rows[f"{i}.png"].data) == p.astype(np.uint8).tobytes() for i, p in enumerate(px))
    bare = source.option("pixels", "false").load(str(tmp_path)).where("problem IS NULL").collect()
    assert {r.data for r in bare} == {None} and {(r.width, r.height) for r in bare} == {(5, 4)} and sorted(r.metadata.orientation for r in bare) == [1] * 5 + [6]
    out = tmp_path / "out"
    named = read.where("problem IS NULL").withColumn("image_id", F.monotonically_increasing_id())
    images.save(named, str(out), "png")
    files = [f for f in out.rglob("*") if f.is_file()]
    assert len(files) == 6 and not list(out.glob("_temporary*"))
    shapes = sorted(codecs.decode(f.read_bytes())[0].shape for f in files)
    assert shapes == [(4, 5, 3)] * 5 + [(5, 4, 3)]  # one was turned
    # A task that fails leaves neither its own files nor those of the others.
    broken = named.withColumn("data", F.when(F.col("path").endswith("5.png"), F.lit(b"short")).otherwise(F.col("data")))
    with pytest.raises(Exception, match=r"\[4\]"):
        images.save(broken, str(tmp_path / "none"), "png")
    assert not [f for f in (tmp_path / "none").rglob("*") if f.is_file()]


def test_rows_are_set_apart_by_code(spark):
    plan = api.plan((3, 2), (2, 2))
    base = images.allocate(spark.range(4).toDF("image_id"), 3, 2, "rgb")
    good, bad = images.checked(base, plan)
    assert good.count() == 4 and bad.count() == 0
    same = images.checked(base, api.plan((3, 2), (3, 2)))[1]
    assert {r.code for r in same.collect()} == {12}
    assert {r.code for r in images.checked(base, plan, memory=10)[1].collect()} == {8}
    assert {r.code for r in images.checked(base.withColumn("width", F.lit(0)))[1].collect()} == {1}
    assert images.checked(base.withColumn("data", F.lit(None).cast("binary")), plan)[0].count() == 4
    assert images.checked(base.limit(0), plan)[1].count() == 0


def test_folders_of_all_sorts(spark, tmp_path):
    px = np.random.default_rng(1).integers(0, 256, (9, 6, 3))
    (tmp_path / "a.png").write_bytes(codecs.encode(px, "png"))
    (tmp_path / "broken.png").write_bytes(codecs.encode(px, "png")[:60])
    (tmp_path / "c.heic").write_bytes(b"\0\0\0\x18ftypheic")
    (tmp_path / "d.jpg").write_bytes(b"\xff\xd8\xff\xe0 not a jpeg")
    made = spark._jvm.java.awt.image.BufferedImage(12, 6, 1)
    for x in range(12):
        for y in range(6):
            made.setRGB(x, y, 0x4080C0)
    assert spark._jvm.javax.imageio.ImageIO.write(made, "jpg", spark._jvm.java.io.File(str(tmp_path / "e.jpg")))
    read = images.read_files(spark, str(tmp_path))
    rows = {r.path.rsplit("/", 1)[1]: r for r in read.collect()}
    assert len(rows) == 5 and {n for n, r in rows.items() if r.problem} == {"broken.png", "c.heic", "d.jpg"}
    assert bytes(rows["a.png"].data) == px.astype(np.uint8).tobytes()
    photo = np.frombuffer(bytes(rows["e.jpg"].data), np.uint8).reshape(6, 12, 3).astype(int)
    assert np.abs(photo - [0x40, 0x80, 0xC0]).max() < 4 and rows["e.jpg"].metadata.orientation == 1
    small = {codecs.decode(bytes(r.content))[0].shape for r in images.thirds(read).collect()}
    assert small == {(3, 2, 3), (2, 4, 3)}
    out = tmp_path / "out"
    out.mkdir()
    images.save(read.where("problem IS NULL"), f"file://{out}", "bmp")
    files = list(out.rglob("*.bmp"))
    assert len(files) == 2 and codecs.decode(files[0].read_bytes())[0].shape[2] == 3


def test_stores(spark):
    made = images.allocate(spark.range(1, 3).toDF("image_id"), 3, 2, "rgb")
    assert {bytes(r.data) for r in made.collect()} == {b"\0" * 18}
    assert images.validate(made).count() == 2
    with pytest.raises(ResampleError):
        images.from_buffer(spark, b"12", 2, 2)
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match=r"\[4\]"):
        images.validate(made.withColumn("data", F.lit(b"123"))).collect()


def test_big_endian_mode_and_sql(spark):
    row = images.from_buffer(spark, np.full((4, 4), 258, ">u2").tobytes(), 4, 4, "planar", "u16", 16)
    out = api.resize(row, (2, 2), "I;16B").first()
    assert bytes(out.data) == np.full(4, 258, ">u2").tobytes()
    api.register(spark)
    got = spark.sql("SELECT resize_image(CAST(unhex(repeat('40', 16)) AS binary), 4, 4, 2, 2, 'L', 'bilinear') AS d").first().d
    assert bytes(got) == b"\x40" * 4
    swapped = spark.sql("SELECT resize_image(unhex(repeat('0102', 16)), 4, 4, 2, 2, 'I;16B', 'bilinear') AS d").first().d
    assert bytes(swapped) == b"\x01\x02" * 4


def test_functions_for_sql_by_format(spark):
    names = api.register_formats(spark)
    assert len(names) == 16
    assert bytes(spark.sql("SELECT resize_rgba8(unhex(repeat('40ff4080', 16)), 4, 4, 2, 2, 8, 'bilinear', 1) AS d").first().d) == b"\x40\xff\x40\x80" * 4
    assert np.frombuffer(spark.sql("SELECT resize_planar_f16(unhex(repeat('0038', 16)), 4, 4, 2, 2, 0, 'lanczos3', 0) AS d").first().d, "<f2").tolist() == [0.5] * 4
    assert spark.sql("SELECT resize_cbcr16(NULL, 4, 4, 2, 2, 10, 'bilinear', 0) AS d").first().d is None


def test_plan_resizes_images_of_its_size(spark):
    rows = images.allocate(spark.range(3).toDF("image_id"), 6, 4, "rgb")
    plan = api.plan((6, 4), (3, 2))
    assert plan.source_size == (6, 4) and plan.target_size == (3, 2) and "lanczos3" in repr(plan)
    assert {(r.width, r.height, bytes(r.data)) for r in plan.resize(rows).collect()} == {(3, 2, bytes(18))}
    with pytest.raises(Exception, match="in a plan for"):
        api.plan((5, 4), (3, 2)).resize(rows).collect()


def test_stream_of_frames(spark, tmp_path):
    source = images.allocate(spark.range(1, 4).toDF("image_id"), 8, 8, "rgb")
    source.write.parquet(str(tmp_path / "in"))
    out = frames.resampled(frames.read_frames(spark, str(tmp_path / "in")), Scaler("bilinear"), (4, 4), "rgb")
    query = frames.write_frames(out, str(tmp_path / "out"), str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    time.sleep(0.2)
    assert sorted(r.image_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert DATA
