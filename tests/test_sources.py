"""Packages, PNGs and layered files: round trips, rejection of damage, and the incremental operators on streams."""

import struct

import numpy as np
import pytest

from lamina.sources import package, png, psd
from lamina.streaming import streams


def test_png_round_trip():
    rng = np.random.default_rng(0)
    for shape in ((5, 7), (4, 3, 3), (6, 2, 4)):
        pixels = rng.integers(0, 256, shape, np.uint8)
        assert (png.decode(png.encode(pixels, 72)) == pixels).all()
    with pytest.raises(ValueError):
        png.decode(b"nothing of the kind")


def test_png_filters():
    import zlib

    rng = np.random.default_rng(2)
    raw = rng.integers(0, 256, (5, 12), np.uint8).astype(int)
    lines, above = b"", np.zeros(12, int)
    for y, row in enumerate(raw):
        left, corner = np.concatenate([np.zeros(3, int), row[:-3]]), np.concatenate([np.zeros(3, int), above[:-3]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = (np.zeros(12, int), left, above, (left + above) // 2, paeth)[y]
        lines += bytes([y]) + ((row - guess) & 255).astype(np.uint8).tobytes()
        above = row
    plain = png.encode(raw.astype(np.uint8).reshape(5, 4, 3))
    at = plain.index(b"IDAT") - 4
    damaged = plain[:at] + png._chunk(b"IDAT", zlib.compress(lines)) + png._chunk(b"IEND", b"")
    assert (png.decode(damaged).reshape(5, 12) == raw).all()


LAYER = {"id": "AAAA", "name": "One", "imageFile": "AAAA.png", "transform": {"origin": [0, 0], "size": [3, 2], "rotation": 0, "flipX": False, "flipY": False, "sampling": "Nearest"}}


def manifest(**changes):
    return {"format": "some.project", "version": 11, "colorSpace": "sRGB", "documentID": "D", "width": 3, "height": 2, "layers": [LAYER]} | changes


def test_package_round_trip(spark, tmp_path):
    rgba = np.random.default_rng(1).integers(0, 256, (2, 3, 4), np.uint8)
    package.write(str(tmp_path / "a"), manifest(), {"AAAA.png": rgba})
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken/manifest.json").write_text('{"format": "some.proj')
    package.write(str(tmp_path / "later"), manifest(version=12), {})
    found = package.manifests(spark, str(tmp_path), "some.project")
    assert found.count() == 1 and not package.violations(found).count()
    assert package.documents(found).first().resolution == 72.0
    layer = package.layers(found).first()
    assert (layer.z, layer.opacity, layer.blendMode, layer.isVisible) == (0, 1.0, "Normal", True)
    wanted = package.layers(found).selectExpr("package", "imageFile AS image_file")
    got = package.pixels(spark, str(tmp_path), wanted).orderBy("y", "x").toPandas()
    assert (got[["r", "g", "b", "a"]].to_numpy().reshape(2, 3, 4) == png.premultiplied(rgba)).all()


def test_package_rules(spark, tmp_path):
    bad = manifest(version=2, layers=[LAYER | {"opacity": 2.0}, LAYER | {"imageFile": "BBBB.png", "name": " "}, LAYER | {"id": "CCCC", "imageFile": "CCCC.png", "parentID": "AAAA"}], width=0)
    package.write(str(tmp_path / "a"), bad, {})
    rules = {r.rule for r in package.violations(package.manifests(spark, str(tmp_path))).collect()}
    assert {"opacity", "opacity before 3", "repeated id", "file name", "name", "parent", "size"} <= rules


def test_digest_sees_contents_not_times(spark, tmp_path):
    package.write(str(tmp_path / "a"), manifest(), {"AAAA.png": np.zeros((2, 3, 4), np.uint8)})
    one = package.digest(spark, str(tmp_path)).first().digest
    package.write(str(tmp_path / "a"), manifest(), {"AAAA.png": np.zeros((2, 3, 4), np.uint8)})
    assert package.digest(spark, str(tmp_path)).first().digest == one
    package.write(str(tmp_path / "a"), manifest(width=4), {})
    assert package.digest(spark, str(tmp_path)).first().digest != one


def layered(layers, width=4, height=3, large=False):
    """A small layered file: (name, box, planes by channel, section, run lengths or raw)."""
    long_ = ">Q" if large else ">I"
    records, data = b"", b""
    for name, (x0, y0, x1, y1), planes, section in layers:
        entries = b""
        for number, plane in planes.items():
            body = struct.pack(">H", 1)
            rows = [bytes([256 - (len(r) - 1), r[0]]) if len(r) > 1 and len(set(r)) == 1 else bytes([len(r) - 1]) + bytes(r) for r in plane.tolist()]
            body += b"".join(struct.pack(">I" if large else ">H", len(r)) for r in rows) + b"".join(rows)
            entries += struct.pack(">h", number) + struct.pack(long_, len(body))
            data += body
        padded = bytes([len(name)]) + name.encode() + b"\0" * (-(len(name) + 1) % 4)
        extra = struct.pack(">II", 0, 0) + padded + (b"8BIMlsct" + struct.pack(">II", 4, section) if section else b"")
        records += struct.pack(">iiiiH", y0, x0, y1, x1, len(planes)) + entries + b"8BIMnorm" + bytes([255, 0, 0, 0]) + struct.pack(">I", len(extra)) + extra
    info = struct.pack(">h", len(layers)) + records + data
    section = struct.pack(long_, len(info)) + info
    resource = b"8BIM" + struct.pack(">H", 1005) + b"\0\0" + struct.pack(">II", 4, 144 << 16)
    return b"8BPS" + struct.pack(">H6xHIIHH", 2 if large else 1, 4, height, width, 8, 3) + struct.pack(">I", 0) + struct.pack(">I", len(resource)) + resource + struct.pack(long_, len(section)) + section


PLANES = {k: np.random.default_rng(k + 5).integers(0, 256, (2, 3), np.uint8) for k in (0, 1, 2, -1)}


@pytest.mark.parametrize("large", [False, True])
def test_layered_files(spark, tmp_path, large):
    empty = (0, 0, 0, 0)
    file = layered([("</g>", empty, {}, 3), ("inside", (1, 0, 4, 2), PLANES, 0), ("folder", empty, {}, 1), ("top", (0, 1, 3, 3), PLANES, 0)], large=large)
    (tmp_path / "a.psd").write_bytes(file)
    psd.register(spark)
    rows = spark.read.format("layered").load(str(tmp_path / "*.psd")).orderBy("z").collect()
    assert [(r.name, r.parent) for r in rows] == [("inside", 2), ("folder", None), ("top", None)] and rows[0].resolution == 144
    a = PLANES[-1].astype(int)
    want = np.dstack([*[(PLANES[k].astype(int) * a + 127) // 255 for k in range(3)], a]).astype(np.uint8)
    assert bytes(rows[0].rgba) == want.tobytes()
    cropped = spark.read.format("layered").option("crop", "2,1,2,1").load(str(tmp_path / "*.psd")).filter("name = 'inside'").first()
    assert (cropped.x0, cropped.y0, cropped.width, cropped.height) == (2, 1, 2, 1) and bytes(cropped.rgba) == want[1:2, 1:3].tobytes()


def test_damaged_layered_files():
    good = layered([("one", (1, 0, 4, 2), PLANES, 0)])
    for bad in (b"GIF8" + good[4:], good[:60], good[:4] + b"\0\7" + good[6:], layered([("open", (0, 0, 0, 0), {}, 3)])):
        with pytest.raises(ValueError):
            psd.read(bad)


def replay(spark, tmp_path, frame, transform, mode):
    """Feeds rows file by file through a stream; the last state of the memory table."""
    path = str(tmp_path / "in")
    for part in sorted({r.part for r in frame.select("part").distinct().collect()}):
        frame.filter(f"part = {part}").drop("part").coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(frame.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(path)
    name = f"t{abs(hash(str(tmp_path)))}"
    query = transform(source).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "check")).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_changed_digests_on_a_stream(spark, tmp_path):
    rows = [(0, "k", 1, "a"), (0, "k", 2, "a"), (1, "k", 3, None), (1, "k", 4, "b"), (2, "k", 5, "b"), (2, "j", 6, "a")]
    got = replay(spark, tmp_path, spark.createDataFrame(rows, "part int, key string, seq long, digest string"), streams.changed, "append")
    assert {(r.key, r.digest) for r in got.collect()} == {("k", "a"), ("k", "b"), ("j", "a")} and got.count() == 3


def test_stroke_tail_is_provisional(spark, tmp_path):
    rows = [(0, "s", 1, 0.0, 0.0), (0, "s", 2, 3.0, 4.0), (1, "s", 3, 3.0, 10.0)]
    got = replay(spark, tmp_path, spark.createDataFrame(rows, "part int, stroke string, seq long, x double, y double"), streams.stroke_lengths, "update")
    assert (5.0, 11.0) in {(r.settled, r.provisional) for r in got.collect()}


def test_debounce_on_a_stream(spark, tmp_path):
    rows = spark.sql("SELECT 0 AS part, 'k' AS key, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s) AS ts FROM VALUES (0.0), (0.2), (0.4), (9.0), (500.0) AS t(s)")
    got = replay(spark, tmp_path, rows, lambda s: streams.debounced(s, "300 milliseconds", "1 second"), "append")
    assert sorted(r.n for r in got.collect()) == [1, 3]


def test_touched_tiles(spark):
    changes = spark.createDataFrame([(1, 250, 0, 260, 10)], "image_id int, x0 int, y0 int, x1 int, y1 int")
    assert {(r.ty, r.tx) for r in streams.touched_tiles(changes).collect()} == {(0, 0), (0, 1)}
