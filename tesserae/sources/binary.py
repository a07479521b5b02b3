"""Fixed-layout binary files as DataFrames: configuration records, catalogues, model files, textures; keys are parameters.

Files come through Spark's binaryFile source, so any store that Spark reads will do. A file that can't be read as its layout is a
row with an error and not an exception.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import ciphers, more_ciphers

#: Layout of a configuration record: id, position, rotation in degrees, scale.
CONFIG = np.dtype([("id", "<u4"), ("pos_x", "<f4"), ("pos_y", "<f4"), ("pos_z", "<f4"), ("rot_x", "<f4"), ("rot_y", "<f4"), ("rot_z", "<f4"), ("scale", "<f4")])
#: Offsets, kinds and names of the numbers in a catalogue record; the strings are at 8, 268 and 528.
CATALOGUE = [
    ("section", 4, "<u2"), ("index", 6, "<u2"), ("kind_a", 592, "u1"), ("kind_b", 593, "u1"), ("type", 594, "u1"), ("two_hand", 595, "u1"), ("drop_level", 596, "<u2"), ("slot", 598, "i1"), ("skill_index", 600, "<u2"),
    ("width", 602, "u1"), ("height", 603, "u1"), ("damage_min", 604, "<u2"), ("damage_max", 606, "<u2"), ("successful_blocking", 608, "<u2"), ("defense", 610, "<u2"), ("walk_speed", 612, "<u2"), ("attack_speed", 614, "<u2"), ("durability", 616, "<u2"),
    ("magic_durability", 620, "<u2"), ("magic_power", 624, "<u4"), ("combat_power", 628, "<u2"), ("attack_rate", 632, "<u2"), ("strength", 636, "<u2"), ("dexterity", 638, "<u2"), ("energy", 640, "<u2"), ("vitality", 642, "<u2"), ("command", 644, "<u2"), ("level", 646, "<u2"),
    ("money", 652, "<u4"), ("set_attribute", 656, "u1"), ("elemental_defense", 702, "<u2"),
]
FLAGS = {"classes": (657, 16), "resistances": (673, 7), "trade": (680, 9)}
STRINGS = {"model_folder": (8, 260), "model_file": (268, 260), "name": (528, 64)}
LEAST_RECORD = 704


def xor3(data: np.ndarray, key: bytes) -> np.ndarray:
    """Records (rows of bytes), each with the key from its start."""
    return data ^ np.resize(np.frombuffer(key, np.uint8), data.shape[1])


def config_records(data: bytes, key: bytes) -> np.ndarray:
    """A count and records; a file that ends early gives those that are whole."""
    if len(data) < 4:
        return np.empty(0, CONFIG)
    n = min(struct.unpack_from("<I", data)[0], (len(data) - 4) // CONFIG.itemsize)
    rows = np.frombuffer(data, np.uint8, n * CONFIG.itemsize, 4).reshape(n, CONFIG.itemsize)
    return np.frombuffer(xor3(rows, key).tobytes(), CONFIG)


def text_at(record: bytes, at: int, size: int) -> str:
    """Up to the first NUL, Windows-1252, trimmed; beyond the end it is empty."""
    return record[at : at + size].split(b"\0")[0].decode("cp1252", "replace").strip()


def catalogue_records(data: bytes, key: bytes) -> list[dict]:
    """A count, records of one width and four closing bytes. No items, or records too short, are errors."""
    n = struct.unpack_from("<I", data)[0] if len(data) >= 8 else 0
    width = (len(data) - 8) // n if n else 0
    if width < LEAST_RECORD:
        raise ValueError(f"{n} records of {width} bytes")
    rows = xor3(np.frombuffer(data, np.uint8, n * width, 4).reshape(n, width), key)
    out = []
    for k, row in enumerate(rows):
        raw = row.tobytes()
        out.append({name: int(np.frombuffer(raw, kind, 1, at)[0]) for name, at, kind in CATALOGUE} | {f: list(raw[at : at + c]) for f, (at, c) in FLAGS.items()} | {s: text_at(raw, *p) for s, p in STRINGS.items()} | {"ordinal": k})
    return out


class Cursor:
    """Reads on from a place; past the end there are zeros."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        part = self.data[self.at : self.at + n]
        self.at += n
        return part.ljust(n, b"\0")

    def array(self, kind, n: int) -> np.ndarray:
        return np.frombuffer(self.take(np.dtype(kind).itemsize * n), kind)

    def string(self, n: int) -> str:
        return text_at(self.take(n), 0, n)


VERTEX = np.dtype([("node", "<i2"), ("pad", "<i2"), ("p", "<f4", 3)])
NORMAL = np.dtype([("node", "<i2"), ("pad", "<i2"), ("p", "<f4", 3), ("bind", "<i2"), ("pad2", "<i2")])
TRIANGLE = np.dtype([("polygon", "u1"), ("pad", "u1"), ("v", "<i2", 4), ("n", "<i2", 4), ("t", "<i2", 4), ("rest", "V38")])
MOST_MESHES = 100


def model_body(data: bytes) -> dict:
    """Meshes and bones of a decrypted body. Of the animations only the first key of the first action is kept; negative counts are errors."""
    c = Cursor(data)
    out = {"name": c.string(32), "meshes": [], "bones": []}
    meshes, bones, actions = (int(x) for x in c.array("<u2", 3))
    if meshes > MOST_MESHES:
        raise ValueError(f"{meshes} meshes")
    for _ in range(meshes):
        nv, nn, nu, nt, _texture = (int(x) for x in c.array("<i2", 5))
        if min(nv, nn, nu, nt) < 0:
            raise ValueError("a negative count")
        v, _, uv, t = c.array(VERTEX, nv), c.take(NORMAL.itemsize * nn), c.array("<f4", 2 * nu), c.array(TRIANGLE, nt)
        out["meshes"].append({"nodes": v["node"].tolist(), "vertices": v["p"].ravel().tolist(), "uvs": uv.tolist(), "polygons": t["polygon"].tolist(), "corners": t["v"].ravel().tolist(), "uv_corners": t["t"].ravel().tolist(), "texture": c.string(32)})
    keys = []
    for _ in range(actions):
        n = int(c.array("<i2", 1)[0])
        if n < 0:
            raise ValueError("a negative count")
        if c.take(1)[0]:
            c.take(12 * n)
        keys.append(n)
    for _ in range(bones):
        if c.take(1)[0]:
            out["bones"].append({"name": "", "parent": -1, "dummy": True, "position": [0.0] * 3, "rotation": [0.0] * 3})
            continue
        bone = {"name": c.string(32), "parent": int(c.array("<i2", 1)[0]), "dummy": False, "position": [0.0] * 3, "rotation": [0.0] * 3}
        for k, n in enumerate(keys):
            p, r = c.array("<f4", 3 * n), c.array("<f4", 3 * n)
            if not k and n:
                bone["position"], bone["rotation"] = p[:3].tolist(), r[:3].tolist()
        out["bones"].append(bone)
    return out


def model_file(data: bytes, decrypt: dict[int, Callable[[bytes], bytes]]) -> dict:
    """Magic, version, and a body that is plain unless decrypt knows the version; then a size stands before it."""
    if data[:3] != b"BMD" or len(data) < 4:
        raise ValueError("not a model file")
    if (f := decrypt.get(data[3])) is None:
        return model_body(data[4:])
    size = struct.unpack_from("<I", data.ljust(8, b"\0"), 4)[0]
    return model_body(f(data[8 : 8 + size]))


def chained_xor_bytes(data: bytes, key: bytes, start: int = 0x5E, step: int = 0x3D) -> bytes:
    """ciphers.chained_xor for a whole buffer."""
    b = np.frombuffer(data, np.uint8)
    chain = np.r_[np.uint8(start), b[:-1] + np.uint8(step)][: len(b)].astype(np.uint8)
    return ((b ^ np.resize(np.frombuffer(key, np.uint8), len(b))) - chain).astype(np.uint8).tobytes()


def decryptors(xor_key: bytes | None = None, lea_key: bytes | None = None, stage_key: bytes | None = None, cast_boxes: Sequence | None = None, gost_boxes: Sequence | None = None) -> dict[int, Callable[[bytes], bytes]]:
    """By version of the file; versions without a key are left out. Files whose selectors ask for boxes that weren't given become error rows."""
    out: dict[int, Callable[[bytes], bytes]] = {}
    if xor_key:
        out[12] = lambda b: chained_xor_bytes(b, xor_key)
    if lea_key:
        out[15] = lambda b: ciphers.lea256(b, lea_key)
    if stage_key:
        out[14] = lambda b: more_ciphers.two_stage(b, stage_key, cast_boxes, gost_boxes)
    return out


def tga(data: bytes) -> tuple[int, int, bytes]:
    """Width, height and RGBA of a TGA image of 24 or 32 bits, plain or run-length coded, rows from the top."""
    skip, _, kind = data[0], data[1], data[2]
    width, height, depth, flags = struct.unpack_from("<HHBB", data, 12)
    if kind not in (2, 10) or depth not in (24, 32):
        raise ValueError(f"TGA kind {kind} of {depth} bits")
    size, at, need = depth // 8, 18 + skip, width * height
    if kind == 2:
        px = np.frombuffer(data, np.uint8, need * size, at).reshape(need, size)
    else:
        parts, n = [], 0
        while n < need:
            head, at = data[at], at + 1
            k = (head & 127) + 1
            raw = data[at : at + size * (1 if head & 128 else k)]
            parts.append(raw * k if head & 128 else raw)
            at, n = at + len(raw), n + k
        px = np.frombuffer(b"".join(parts), np.uint8, need * size).reshape(need, size)
    rgba = np.full((need, 4), 255, np.uint8)
    rgba[:, :3] = px[:, 2::-1]
    if size == 4:
        rgba[:, 3] = px[:, 3]
    rows = rgba.reshape(height, width, 4)
    return width, height, (rows if flags & 0x20 else rows[::-1]).tobytes()


#: Bytes before the image proper, by extension.
TEXTURE_HEADERS = {".ozj": 24, ".ozt": 4}

CONFIG_SCHEMA = "path string, section int, index int, pos_x float, pos_y float, pos_z float, rot_x float, rot_y float, rot_z float, scale float"
CATALOGUE_SCHEMA = "path string, error string, ordinal int, model_folder string, model_file string, name string, " + ", ".join(f"{n} bigint" for n, _, _ in CATALOGUE) + ", " + ", ".join(f"{f} array<int>" for f in FLAGS)
MODEL_SCHEMA = "path string, error string, name string, meshes array<struct<nodes:array<int>,vertices:array<float>,uvs:array<float>,polygons:array<int>,corners:array<int>,uv_corners:array<int>,texture:string>>, bones array<struct<name:string,parent:int,dummy:boolean,position:array<float>,rotation:array<float>>>"


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")


def _rows(df: DataFrame, one: Callable[[str, bytes], list[dict]], schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = one(path, content)
                except (ValueError, IndexError, struct.error) as e:
                    rows = [{"path": path, "error": str(e)}]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return df.mapInArrow(run, schema)


def read_config(spark: SparkSession, path: str, key: bytes) -> DataFrame:
    """Configuration records; section and index are id div 512 and id mod 512. Of rows with one id the last of a file counts, which is the caller's choice."""

    def one(path, content):
        return [{"path": path, "section": int(r["id"]) // 512, "index": int(r["id"]) % 512} | {k: float(r[k]) for k in CONFIG.names[1:]} for r in config_records(content, key)]

    return _rows(files(spark, path), one, CONFIG_SCHEMA)


def read_catalogue(spark: SparkSession, path: str, key: bytes) -> DataFrame:
    return _rows(files(spark, path), lambda p, b: [{"path": p} | r for r in catalogue_records(b, key)], CATALOGUE_SCHEMA)


def read_models(spark: SparkSession, path: str, decrypt: dict[int, Callable[[bytes], bytes]] | None = None) -> DataFrame:
    """One row a file: meshes and bones, or an error."""
    return _rows(files(spark, path), lambda p, b: [{"path": p} | model_file(b, decrypt or {})], MODEL_SCHEMA)


def read_xml_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Sections and items of a catalogue in XML, in document order. Rows without a model file or with an index that is no whole number don't count."""
    schema = "Section array<struct<_Index:string,_Name:string,Item:array<struct<_Index:string,_Name:string,_ModelPath:string,_ModelFile:string>>>>"
    lists = spark.read.format("xml").option("rowTag", "ItemList").option("attributePrefix", "_").schema(schema).load(path)
    s = lists.select(F.posexplode("Section").alias("so", "s"))
    i = s.select("so", F.col("s._Index").alias("section"), F.col("s._Name").alias("section_name"), F.posexplode("s.Item").alias("io", "i"))
    whole = lambda c: c.rlike("^[+-]?[0-9]+$")
    rows = i.where(whole(F.col("section")) & whole(F.col("i._Index")) & (F.coalesce(F.col("i._ModelFile"), F.lit("")) != ""))
    return rows.select(F.col("section").cast("int").alias("section"), "section_name", F.col("i._Index").cast("int").alias("index"), F.col("i._Name").alias("name"), F.col("i._ModelFile").alias("model_file"), F.col("i._ModelPath").alias("model_path"), (F.col("so").cast("long") * (1 << 32) + F.col("io")).alias("ordinal"))


def texture_index(spark: SparkSession, *paths: str) -> DataFrame:
    """stem, ozj, ozt: for each stem the first file of each kind, folders in the order given and paths in theirs. Contents aren't read."""
    found = [spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p).select("path", F.lit(k).alias("folder")) for k, p in enumerate(paths)]
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    name = F.substring_index("path", "/", -1)
    rows = rows.select("path", "folder", F.lower(F.regexp_replace(name, r"\.[^.]*$", "")).alias("stem"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("ext")).where(F.col("ext").isin(*TEXTURE_HEADERS))
    first = lambda e: F.min_by(F.when(F.col("ext") == e, F.col("path")), F.when(F.col("ext") == e, F.struct("folder", "path")))
    return rows.groupBy("stem").agg(first(".ozj").alias("ozj"), first(".ozt").alias("ozt"))


def texture_payload(content: Column, ext: Column) -> Column:
    """The image proper, without the header of its kind; a file no longer than its header gives null."""
    out = None
    for e, n in TEXTURE_HEADERS.items():
        cut = F.when((ext == e) & (F.length(content) > n), F.substring(content, n + 1, 1 << 30))
        out = cut if out is None else F.coalesce(out, cut)
    return out
