"""Readers on files made to their layouts, with keys of our own."""

import struct

import numpy as np

from tesserae.functions import ciphers
from tesserae.sources import binary as B

KEY = b"\x11\x22\x33"


def test_config(spark, tmp_path):
    rows = np.array([(6177, 1, 2, 3, 10, -20, 30, 0.5), (5, 0, 0, 0, 0, 90, 0, 1)], B.CONFIG)
    secret = B.xor3(np.frombuffer(rows.tobytes(), np.uint8).reshape(2, 32), KEY).tobytes()
    (tmp_path / "a.bin").write_bytes(struct.pack("<I", 2) + secret)
    (tmp_path / "cut.bin").write_bytes(struct.pack("<I", 2) + secret[:40])
    (tmp_path / "empty.bin").write_bytes(b"")
    got = sorted((r.path[-5:], r.section, r["index"], r.rot_y) for r in B.read_config(spark, str(tmp_path), KEY).collect())
    assert got == [("a.bin", 0, 5, 90.0), ("a.bin", 12, 33, -20.0), ("t.bin", 12, 33, -20.0)]


def test_catalogue(spark, tmp_path):
    raw = bytearray(710)
    struct.pack_into("<HH", raw, 4, 3, 7)
    raw[528:534] = b"Caf\xe9 \0"
    struct.pack_into("<b", raw, 598, -1)
    struct.pack_into("<I", raw, 652, 4_000_000_000)
    secret = B.xor3(np.frombuffer(bytes(raw) * 2, np.uint8).reshape(2, 710), KEY).tobytes()
    (tmp_path / "a.bmd").write_bytes(struct.pack("<I", 2) + secret + b"tail")
    (tmp_path / "bad.bmd").write_bytes(struct.pack("<I", 0) + b"tail")
    rows = B.read_catalogue(spark, str(tmp_path), KEY).orderBy("path", "ordinal").collect()
    assert [(r.section, r["index"], r.name, r.slot, r.money, r.error) for r in rows] == [(3, 7, "Café", -1, 4_000_000_000, None)] * 2 + [(None, None, None, None, None, "0 records of 0 bytes")]


def body(meshes=1, count=3):
    tri = np.zeros(1, B.TRIANGLE)
    tri["polygon"], tri["v"] = 4, [[0, 1, 2, 0]]
    v = np.zeros(3, B.VERTEX)
    v["p"], v["node"] = [[0, 0, 0], [1, 0, 0], [0, 1, 0]], [0, 1, 1]
    mesh = struct.pack("<5h", count, 0, 1, 1, 0) + v.tobytes() + struct.pack("<2f", 0.5, 0.25) + tri.tobytes() + b"Tex01.jpg".ljust(32, b"\0")
    bones = b"\0" + b"root".ljust(32, b"\0") + struct.pack("<h", -1) + struct.pack("<12f", 1, 2, 3, 9, 9, 9, 4, 5, 6, 9, 9, 9) + b"\1"
    return b"blade".ljust(32, b"\0") + struct.pack("<3H", meshes, 2, 1) + mesh + struct.pack("<hB", 2, 0) + bones


def test_models(spark, tmp_path):
    key16, key32 = bytes(range(16)), bytes(range(32))
    plain = body().ljust(-(-len(body()) // 16) * 16, b"\0")
    chained, last = bytearray(), 0x5E
    for i, b in enumerate(plain):
        last_in = (b + last) & 255 ^ key16[i % 16]
        chained.append(last_in)
        last = (last_in + 0x3D) & 255
    lea = ciphers.lea256(plain, key32, decrypt=False)
    (tmp_path / "a.bmd").write_bytes(b"BMD\x0a" + body())
    (tmp_path / "b.bmd").write_bytes(b"BMD\x0c" + struct.pack("<I", len(chained)) + bytes(chained))
    (tmp_path / "c.bmd").write_bytes(b"BMD\x0f" + struct.pack("<I", len(lea)) + lea)
    for name, data in (("d", b"XYZ\x0a"), ("e", b"BMD\x0a" + body(101)), ("f", b"BMD\x0a" + body(count=-1)), ("g", b"BMD\x0a" + body()[:70])):
        (tmp_path / f"{name}.bmd").write_bytes(data)
    rows = {r.path[-5]: r for r in B.read_models(spark, str(tmp_path), B.decryptors(key16, key32)).collect()}
    for k in "abc":
        r = rows[k]
        assert r.error is None and r.name == "blade" and r.meshes[0].texture == "Tex01.jpg" and r.meshes[0].nodes == [0, 1, 1] and r.meshes[0].uvs == [0.5, 0.25]
        assert r.bones[0].position == [1, 2, 3] and r.bones[0].rotation == [4, 5, 6] and r.bones[1].dummy
    assert rows["d"].error == "not a model file" and rows["e"].error == "101 meshes" and rows["f"].error == "a negative count"
    assert rows["g"].error is None and rows["g"].meshes[0].vertices[3:] == [0.0] * 6  # cut short: zeros


def test_xml_catalogue(spark, tmp_path):
    (tmp_path / "items.xml").write_text('<ItemList><Section Index="1" Name="Swords"><Item Index="3" Name="A &amp; B" ModelPath="p" ModelFile="m.bmd"/><Item Index="4" Name="none" ModelFile=""/><Item Index="x" Name="bad" ModelFile="b"/></Section><Section Index="y" Name="odd"><Item Index="1" Name="n" ModelFile="f"/></Section></ItemList>')
    got = B.read_xml_catalogue(spark, str(tmp_path)).collect()
    assert [(r.section, r.section_name, r["index"], r.name, r.model_file) for r in got] == [(1, "Swords", 3, "A & B", "m.bmd")]


def test_textures(spark, tmp_path):
    for d, names in (("one", ("A.ozj", "a.ozt", "b.OZJ", "c.txt")), ("two", ("a.ozj", "d.ozt"))):
        (tmp_path / d).mkdir()
        for n in names:
            (tmp_path / d / n).write_bytes(b"x")
    got = {r.stem: r for r in B.texture_index(spark, str(tmp_path / "one"), str(tmp_path / "two")).collect()}
    assert set(got) == {"a", "b", "d"} and got["a"].ozj.endswith("one/A.ozj") and got["a"].ozt.endswith("one/a.ozt") and got["b"].ozt is None
    px = bytes([3, 2, 1, 9, 6, 5, 4, 8])
    head = lambda kind, flags: bytes([0, 0, kind, *[0] * 9]) + struct.pack("<HHBB", 1, 2, 32, flags)
    assert B.tga(head(2, 0x20) + px) == (1, 2, bytes([1, 2, 3, 9, 4, 5, 6, 8])) and B.tga(head(2, 0) + px)[2][:4] == bytes([4, 5, 6, 8])
    assert B.tga(head(10, 0x20) + bytes([0x81]) + px[:4])[2] == bytes([1, 2, 3, 9] * 2)
