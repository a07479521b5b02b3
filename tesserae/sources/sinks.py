"""Files out of tables: single files by executors, ordered documents as a stream through the driver, reports as text.

Folders are anything that pyarrow's file systems open (local paths, file:, hdfs:, s3:) and that all executors reach.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators import catalogue as C
from tesserae.operators.resample import map_images
from tesserae.operators.tables import cut
from tesserae.sources.binary import TEXTURE_HEADERS, texture_payload


def place(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))


def write_file(store: fs.FileSystem, path: str, parts: Iterable[bytes]) -> int:
    """The whole file or none of it: it gets its name when it is complete, so a task that runs again does no harm."""
    store.create_dir(path.rpartition("/")[0], recursive=True)
    aside, n = f"{path}.{uuid.uuid4().hex}.part", 0
    with store.open_output_stream(aside) as f:
        for p in parts:
            f.write(p)
            n += len(p)
    store.move(aside, path)
    return n


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Each row (path string below folder, content binary) as a file; (path, bytes, error) once all are written.

    Folders are made as needed. A path that is empty or leads out of folder, null content and a failed write are error rows. Of rows
    with one path any one stays.
    """

    def run(batches):
        store, root = place(folder)
        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if content is None or not path or path.startswith("/") or ".." in path.split("/"):
                    out.append((path, None, "no content" if content is None else "not a path below the folder"))
                    continue
                try:
                    out.append((path, write_file(store, f"{root.rstrip('/')}/{path}", [content]), None))
                except OSError as e:
                    out.append((path, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["path", "bytes", "error"])

    return cut(rows.select(F.col("path").cast("string"), F.col("content").cast("binary")).mapInArrow(run, "path string, bytes long, error string"), "files")


def write_images(images: DataFrame, folder: str, kind: str = "webp") -> DataFrame:
    """Images (section, index, width, height, rgba) as section/index.kind, webp or png, both lossless."""
    name = F.concat(F.col("section").cast("string"), F.lit("/"), F.col("index").cast("string"))
    done = map_images(images.select(name.alias("key"), "width", "height", "rgba"), lambda img: img, kind)
    return write_files(done.select(F.concat("key", F.lit(f".{kind}")).alias("path"), F.col(kind).alias("content")), folder)


def dump_textures(files: DataFrame, folder: str) -> DataFrame:
    """The image inside each texture file (path, content) as stem_dump.jpg or .tga; files no longer than their header are error rows."""
    name = F.substring_index("path", "/", -1)
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    out = F.concat(F.regexp_replace(name, r"\.[^.]*$", "_dump"), F.when(ext == ".ozj", ".jpg").otherwise(".tga"))
    return write_files(files.where(ext.isin(*TEXTURE_HEADERS)).select(out.alias("path"), texture_payload(F.col("content"), ext).alias("content")), folder)


def write_stream(lines: Iterable[str], path: str) -> int:
    """One UTF-8 file from pieces of text, of which only the current one is held."""
    store, at = place(path)
    return write_file(store, at, (x.encode() for x in lines))


def write_manifest(items: DataFrame, path: str, ordinal: str = "ordinal", kind: str = "webp") -> int:
    """A JSON array with an object an item in the order of ordinal, failed items too. Rows pass through the driver a partition at a time."""

    def parts():
        rows, n = C.manifest(items.orderBy(ordinal), kind), 0
        for n, r in enumerate(rows.toLocalIterator(), 1):
            body = json.dumps(r.asDict(), indent=2, ensure_ascii=False).replace("\n", "\n  ")
            yield ("[\n  " if n == 1 else ",\n  ") + body
        yield "\n]" if n else "[]"

    return write_stream(parts(), path)


#: Attributes of an item in the order of the document, and the columns that they show.
ATTRIBUTES = [
    ("Index", "index"), ("Name", "name"), ("KindA", "kind_a"), ("KindB", "kind_b"), ("Type", "type"), ("Slot", "slot"), ("TwoHand", "two_hand"), ("SkillIndex", "skill_index"), ("Width", "width"), ("Height", "height"),
    ("DamageMin", "damage_min"), ("DamageMax", "damage_max"), ("Defense", "defense"), ("SuccessfulBlocking", "successful_blocking"), ("AttackSpeed", "attack_speed"), ("WalkSpeed", "walk_speed"), ("Durability", "durability"),
    ("MagicDurability", "magic_durability"), ("MagicPower", "magic_power"), ("DropLevel", "drop_level"), ("CombatPower", "combat_power"), ("AttackRate", "attack_rate"), ("ReqLevel", "level"), ("ReqStrength", "strength"),
    ("ReqDexterity", "dexterity"), ("ReqEnergy", "energy"), ("ReqVitality", "vitality"), ("ReqCommand", "command"), ("Money", "money"), ("SetAttrib", "set_attribute"),
    ("DarkWizard", "classes[0]"), ("DarkKnight", "classes[1]"), ("FairyElf", "classes[2]"), ("MagicGladiator", "classes[3]"), ("DarkLord", "classes[4]"), ("Summoner", "classes[5]"), ("RageFighter", "classes[6]"), ("GrowLancer", "classes[7]"),
    ("RuneWizard", "classes[8]"), ("Slayer", "classes[9]"), ("GunCrusher", "classes[10]"), ("LightWizard", "classes[11]"), ("LemuriaMage", "classes[12]"), ("IllusionKnight", "classes[13]"), ("Alchemist", "classes[14]"), ("Crusader", "classes[15]"),
    ("IceRes", "resistances[0]"), ("PoisonRes", "resistances[1]"), ("LightRes", "resistances[2]"), ("FireRes", "resistances[3]"), ("EarthRes", "resistances[4]"), ("WindRes", "resistances[5]"), ("WaterRes", "resistances[6]"),
    ("Dump", "trade[0]"), ("Transaction", "trade[1]"), ("PersonalStore", "trade[2]"), ("StoreWarehouse", "trade[3]"), ("SellToNPC", "trade[4]"), ("ExpensiveItem", "trade[5]"), ("Repair", "trade[6]"), ("Overlap", "trade[7]"), ("NonValue", "trade[8]"),
    ("ElementalDefense", "elemental_defense"), ("ModelPath", "model_folder"), ("ModelFile", "model_file"),
]


def item_element() -> Column:
    """An item's line; the strings are escaped, the numbers have nothing to escape."""
    shown = [F.concat(F.lit(f' {a}="'), F.coalesce(C.xml_escape(F.expr(f"string({c})")), F.lit("")), F.lit('"')) for a, c in ATTRIBUTES]
    return F.concat(F.lit("\t\t<Item"), *shown, F.lit("></Item>\n"))


def write_catalogue(records: DataFrame, path: str, names: dict[int, str] | None = None) -> int:
    """Records of read_catalogue as one XML document: sections by number, items as they came. Elements are made by executors, the driver joins them."""

    def parts():
        yield '<?xml version="1.0" encoding="UTF-8"?>\n<ItemList>\n'
        rows, last = records.where("error is null").select("section", "path", "ordinal", item_element().alias("line")).orderBy("section", "path", "ordinal"), None
        for r in rows.toLocalIterator():
            if r.section != last:
                name = (names or {}).get(r.section) or f"Section{r.section}"
                for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
                    name = name.replace(a, b)
                yield ("" if last is None else "\t</Section>\n") + f'\t<Section Index="{r.section}" Name="{name}">\n'
                last = r.section
            yield r.line
        yield ("" if last is None else "\t</Section>\n") + "</ItemList>\n"

    return write_stream(parts(), path)


def report(df: DataFrame) -> DataFrame:
    """Rows as lines of text, name=value by name=value, for Spark's text sink; nested values as JSON, missing ones as -."""
    shown = [F.concat(F.lit(f"{f.name}="), F.coalesce((F.to_json(F.col(f"`{f.name}`")) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f"`{f.name}`").cast("string")), F.lit("-"))) for f in df.schema.fields]
    return df.select(F.concat_ws("  ", *shown).alias("value"))
