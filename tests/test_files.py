"""Files written and read back: images by a decoder of our own, textures through Spark's image source, catalogues, manifests, settings."""

import json
import struct
import xml.etree.ElementTree as ET

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae import __main__ as program
from tesserae.operators import inspect
from tesserae.operators import webp as W
from tesserae.sources import binary as B
from tesserae.sources import settings, sinks, textures
from tests.test_resample import noise
from tests.test_sources import KEY, body


class Bits:
    def __init__(self, data):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"), 0

    def take(self, n):
        out = sum(int(b) << k for k, b in enumerate(self.bits[self.at : self.at + n]))
        self.at += n
        return out


def read_code(bits, size):
    """A prefix code as {(length, code from its first bit)}: symbol}, by the format's description."""
    if bits.take(1):
        n, wide = bits.take(1) + 1, bits.take(1)
        symbols = [bits.take(8 if wide else 1)] + ([bits.take(8)] if n == 2 else [])
        return {(0, 0): symbols[0]} if n == 1 else {(1, 0): symbols[0], (1, 1): symbols[1]}
    order, small = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15), [0] * 19
    for k in range(bits.take(4) + 4):
        small[order[k]] = bits.take(3)
    assert not bits.take(1)
    inner, lengths = table(small), []
    while len(lengths) < size:
        s = symbol(bits, inner)
        assert s < 16
        lengths.append(s)
    return table(lengths)


def table(lengths):
    out, code = {}, 0
    for n in range(1, 16):
        for k, m in enumerate(lengths):
            if m == n:
                out[n, code] = k
                code += 1
        code <<= 1
    assert abs(sum(2.0**-n for n, _ in out) - 1) < 1e-9
    return out


def symbol(bits, code):
    n = c = 0
    while (n, c) not in code:
        c, n = c << 1 | bits.take(1), n + 1
    return code[n, c]


def read_webp(data):
    assert data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8L" and struct.unpack("<I", data[4:8])[0] == len(data) - 8 and len(data) % 2 == 0
    bits = Bits(data[20 : 20 + struct.unpack("<I", data[16:20])[0]])
    assert bits.take(8) == 0x2F
    width, height, _ = bits.take(14) + 1, bits.take(14) + 1, bits.take(4)
    assert [bits.take(1), bits.take(2), bits.take(1), bits.take(1), bits.take(1)] == [1, 2, 0, 0, 0]
    codes = [read_code(bits, n) for n in (280, 256, 256, 256, 40)]
    px = []
    for _ in range(width * height):
        g, r, b, a = (symbol(bits, c) for c in codes[:4])
        px.append(((r + g) & 255, g, (b + g) & 255, a))
    return np.array(px, np.uint8).reshape(height, width, 4)


def test_webp_round_trip():
    flat = np.full((5, 3, 4), (9, 8, 7, 255), np.uint8)
    two = flat.copy()
    two[2, 1] = (1, 2, 3, 0)
    steep = np.zeros((1, 6000, 4), np.uint8)  # counts like Fibonacci numbers would make a tree that is too deep
    a, b, at = 1, 1, 0
    for k in range(17):
        steep[0, at : at + a, 1] = k
        a, b, at = b, a + b, at + a
    for img in (flat, two, flat[:1, :1], noise(20, 31), steep):
        assert (read_webp(W.webp(img)) == img).all()
    assert W.code_lengths(1.7 ** np.arange(30)).max() <= 15
    with pytest.raises(ValueError):
        W.webp(np.zeros((0, 4, 4), np.uint8))


def test_image_files(spark, tmp_path):
    img = noise(6, 5)
    rows = spark.createDataFrame([(3, 7, 5, 6, bytearray(img.tobytes())), (12, 140, 5, 5, bytearray(b"short"))], "section int, index int, width int, height int, rgba binary")
    for kind in ("webp", "png"):
        got = {r.path: r for r in sinks.write_images(rows, str(tmp_path / "out"), kind).collect()}
        assert got[f"3/7.{kind}"].error is None and got[f"12/140.{kind}"].error == "no content"
        assert got[f"3/7.{kind}"].bytes == (tmp_path / "out" / "3" / f"7.{kind}").stat().st_size
    assert (read_webp((tmp_path / "out" / "3" / "7.webp").read_bytes()) == img).all()
    bad = spark.createDataFrame([("../x", b"1"), ("/x", b"1"), ("", b"1"), (None, b"1"), ("ok/é.bin", b"1")], "path string, content binary")
    assert [r.path for r in sinks.write_files(bad, "file://" + str(tmp_path / "two")).where("error is null").collect()] == ["ok/é.bin"]
    assert sorted(p.name for p in (tmp_path / "two").rglob("*") if p.is_file()) == ["é.bin"]


def test_manifest_and_report(spark, tmp_path):
    rows = spark.createDataFrame([(2, 12, "Maces", 140, "b", "m.bmd"), (1, 3, "Axes", 7, 'a "é"', "n.bmd")], "ordinal int, section int, section_name string, index int, name string, model_file string")
    sinks.write_manifest(rows, str(tmp_path / "m" / "manifest.json"))
    text = (tmp_path / "m" / "manifest.json").read_text()
    want = [{"section": 3, "section_name": "Axes", "index": 7, "name": 'a "é"', "model_file": "n.bmd", "image": "3/7.webp"}, {"section": 12, "section_name": "Maces", "index": 140, "name": "b", "model_file": "m.bmd", "image": "12/140.webp"}]
    assert json.loads(text) == want and text == json.dumps(want, indent=2, ensure_ascii=False)
    sinks.write_manifest(rows.where("false"), str(tmp_path / "empty.json"))
    assert json.loads((tmp_path / "empty.json").read_text()) == []
    assert [r.value for r in sinks.report(rows.where("ordinal = 1").select("section", F.lit(None).alias("none"), F.array("index").alias("list"))).collect()] == ["section=3  none=-  list=[7]"]


def test_catalogue_program(spark, tmp_path):
    def record(section, index, name):
        raw = bytearray(710)
        struct.pack_into("<HH", raw, 4, section, index)
        raw[528 : 528 + len(name)] = name
        raw[8:13], raw[268:273], raw[660], raw[673], raw[688] = b"Data\\", b"a.bmd", 3, 4, 5
        struct.pack_into("<H", raw, 646, 77)
        return bytes(raw)

    data = record(5, 1, b"B<&>\"") + record(2, 9, b"A") + record(5, 0, b"C")
    secret = B.xor3(np.frombuffer(data, np.uint8).reshape(3, 710), KEY).tobytes()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "c.bmd").write_bytes(struct.pack("<I", 3) + secret + b"tail")
    assert program.main(["decode", str(tmp_path / "in"), str(tmp_path / "out.xml"), "--key", KEY.hex()]) == 0
    root = ET.parse(tmp_path / "out.xml").getroot()
    assert [(s.get("Index"), s.get("Name"), [i.get("Index") for i in s]) for s in root] == [("2", "Section2", ["9"]), ("5", "Section5", ["1", "0"])]
    item = root[1][0]
    assert item.get("Name") == 'B<&>"' and item.get("MagicGladiator") == "3" and item.get("IceRes") == "4" and item.get("NonValue") == "5" and item.get("ReqLevel") == "77" and item.get("ModelPath") == "Data\\" and len(item.attrib) == 65
    again = B.read_xml_catalogue(spark, str(tmp_path / "out.xml")).collect()
    assert [(r.section, r["index"], r.name) for r in again] == [(2, 9, "A"), (5, 1, 'B<&>"'), (5, 0, "C")]
    (tmp_path / "in" / "bad.bmd").write_bytes(b"\0" * 9)
    assert program.main(["decode", str(tmp_path / "in"), str(tmp_path / "out.xml"), "--key", KEY.hex()]) == 1


def jpeg(spark, path, colour, size=(16, 8)):
    awt, image_io, file = spark._jvm.java.awt.image.BufferedImage, spark._jvm.javax.imageio.ImageIO, spark._jvm.java.io.File
    img = awt(*size, awt.TYPE_INT_RGB)
    for x in range(size[0]):
        for y in range(size[1]):
            img.setRGB(x, y, colour)
    assert image_io.write(img, "jpg", file(str(path)))
    return path.read_bytes()


def targa(px, w, h):
    return bytes([0, 0, 2, *[0] * 9]) + struct.pack("<HHBB", w, h, 32, 0x20) + px


def test_textures_of_items(spark, tmp_path, capsys):
    item = tmp_path / "Item"
    for d in ("texture/deep", "Jewel/Texture/a", "Jewel/texture", "Jewel/other", "loose"):
        (item / d).mkdir(parents=True)
    red = b"H" * 24 + jpeg(spark, tmp_path / "x.jpg", 0xC81E14)
    clear = b"H" * 4 + targa(bytes([3, 2, 1, 255, 6, 5, 4, 0, 6, 5, 4, 128]), 3, 1)
    for name, data in (("texture/deep/Blade.OZJ", red), ("Jewel/Texture/a/blade.ozj", b"late"), ("Jewel/texture/Blade.ozt", clear), ("Jewel/other/no.ozj", red), ("loose/no2.ozj", red), ("no3.ozj", red), ("texture/bad.ozj", b"B" * 99), ("texture/short.ozt", b"x"), ("texture/shortj.ozj", b"x"), ("Jewel/Texture/late.ozj", red), ("texture/cut.ozt", clear[:-2])):
        (item / name).write_bytes(data)
    (tmp_path / "Skill").mkdir()
    (tmp_path / "Skill" / "late.ozj").write_bytes(red)
    (tmp_path / "Skill" / "skill.ozj").write_bytes(red)
    index = {r.stem: r for r in textures.item_textures(spark, str(item), str(tmp_path / "Skill")).collect()}
    assert set(index) == {"blade", "bad", "short", "shortj", "late", "skill", "cut"}
    assert index["blade"].ozj.endswith("texture/deep/Blade.OZJ") and index["blade"].ozt.endswith("Jewel/texture/Blade.ozt") and index["late"].ozj.endswith("Jewel/Texture/late.ozj")
    images = textures.decode(B.files(spark, str(item), textures.NAMES))
    got = {r.path.split("/")[-1]: r for r in images.collect()}
    assert len(got) == 11 and (got["Blade.OZJ"].width, got["Blade.OZJ"].height) == (16, 8)
    assert np.abs(np.frombuffer(got["Blade.OZJ"].rgba, np.uint8).reshape(-1, 4).astype(int) - (0xC8, 0x1E, 0x14, 255)).max() <= 4
    assert got["Blade.ozt"].rgba == bytes([1, 2, 3, 255, 4, 5, 6, 0, 4, 5, 6, 128])
    assert all(got[n].error and got[n].rgba is None for n in ("bad.ozj", "short.ozt", "shortj.ozj", "cut.ozt", "blade.ozj"))
    names = spark.createDataFrame([("Data\\x\\BLADE.jpg",), ("blade.tga",), ("blade.bmp",), ("bad.jpg",), ("gone.jpg",), ("late.tga",)], "path string")
    rows = {r.path: r for r in textures.with_images(names, textures.item_textures(spark, str(item)), images).collect()}
    assert [rows[k].width for k in ("Data\\x\\BLADE.jpg", "blade.tga", "blade.bmp", "bad.jpg", "gone.jpg", "late.tga")] == [16, 3, 3, None, None, 16] and rows["gone.jpg"].texture_path is None
    seen = {r.path.split("/")[-1]: r for r in textures.opacity(images).collect()}
    assert (seen["Blade.ozt"].visible, seen["Blade.ozt"].opaque, seen["Blade.ozt"].percent) == (2, 1, 50.0) and seen["Blade.OZJ"].percent == 100.0
    assert program.main(["textures", str(item / "texture"), str(tmp_path / "dump")]) == 1
    assert (tmp_path / "dump" / "Blade_dump.jpg").read_bytes() == red[24:] and not (tmp_path / "dump" / "short_dump.tga").exists()
    (item / "texture" / "tex01.ozj").write_bytes(red)
    (tmp_path / "m.bmd").write_bytes(b"BMD\x0a" + body())
    assert program.main(["inspect", str(tmp_path / "m.bmd"), "--item-dir", str(item)]) == 0
    out = capsys.readouterr().out
    assert "stem=Tex01" in out and "percent=100.0" in out and "bones=[0,1]" in out and "quads=1" in out and "flat_ratio=0.0" in out and "bone=1  chain=[1]" in out


def test_leaf_chains(spark):
    bone = lambda p: ("", p, False, [0.0], [0.0])
    deep = [bone(k - 1) for k in range(200)]
    rows = spark.createDataFrame([("deep", None, "", [], deep), ("fork", None, "", [], [bone(-1), bone(0), bone(0), bone(9)]), ("bad", "error", None, None, None)], B.MODEL_SCHEMA)
    got = {(r.path, r.bone): r.chain for r in inspect.leaf_chains(rows).collect()}
    assert got == {("deep", 199): list(range(199, -1, -1)), ("fork", 1): [1, 0], ("fork", 2): [2, 0], ("fork", 3): [3]}
    assert inspect.shape_audit(rows).count() == 0 and inspect.mesh_audit(rows).count() == 0


def test_settings(tmp_path):
    base = tmp_path / "base"
    (base / "Data" / "Item").mkdir(parents=True)
    (base / "Data" / "xml").mkdir()
    (base / "Data" / "xml" / "ItemList.xml").write_text("")
    (tmp_path / "c.json").write_text(json.dumps({"output_dir": "out", "render_size": 64, "render_height": 32, "other": 1, "workers": 3}))
    s = settings.resolve(settings.load(str(tmp_path / "c.json")), [str(tmp_path), str(base)], webp_quality=50, workers=0)
    assert (s.base_dir, s.item_dir, s.output_dir) == (str(base), str(base / "Data" / "Item"), str(base / "out"))
    assert s.item_list_xml == str(base / "Data" / "xml" / "ItemList.xml") and s.trs_bmd.endswith("Data/Local/itemtrsdata.bmd")
    assert (s.render_width, s.render_height, s.supersample, s.webp_quality, s.workers) == (64, 32, 2, 50, 3)
    nowhere = settings.resolve(settings.Settings(item_dir="x"), [])
    assert (nowhere.base_dir, nowhere.item_dir, nowhere.output_dir, nowhere.render_width) == ("", "x", "", 256)
    assert settings.resolve(settings.Settings(base_dir="/b", item_dir="/abs"), []).item_list_xml == "/b/ItemList.xml"
    (tmp_path / "bad.json").write_text('{"render_size": "64"}')
    with pytest.raises(ValueError):
        settings.load(str(tmp_path / "bad.json"))
