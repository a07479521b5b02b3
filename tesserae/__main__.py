"""python -m tesserae: the catalogue as XML, audits of any number of model files, texture payloads, settings. Keys are hexadecimal."""

from __future__ import annotations

import argparse
import sys
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tesserae.operators import inspect
from tesserae.sources import binary, settings, sinks, textures


def show(df: DataFrame) -> None:
    """All rows as text, a partition at a time on the driver."""
    for r in sinks.report(df).toLocalIterator():
        print(r.value)


def arguments(argv: list[str]) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="tesserae", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    decode = sub.add_parser("decode", help="a catalogue file or a folder of them as one XML document")
    decode.add_argument("catalogue")
    decode.add_argument("out")
    decode.add_argument("--key", type=bytes.fromhex, required=True)
    dump = sub.add_parser("textures", help="the images inside texture files as files of their own")
    dump.add_argument("folder")
    dump.add_argument("out")
    sub.add_parser("settings", help="a settings file with all that it leaves open").add_argument("file")
    audit = sub.add_parser("inspect", help="meshes, shapes and bone chains of model files")
    audit.add_argument("models", nargs="+")
    audit.add_argument("--item-dir", help="textures of this folder are looked up and their opacity is shown")
    for k in ("xor", "lea", "stage"):
        audit.add_argument(f"--{k}-key", type=bytes.fromhex)
    return top.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    a = arguments(sys.argv[1:] if argv is None else argv)
    if a.command == "settings":
        print(*(f"{k}={v}" for k, v in asdict(settings.resolve(settings.load(a.file))).items()), sep="\n")
        return 0
    spark = SparkSession.builder.appName("tesserae").getOrCreate()
    if a.command == "decode":
        records = binary.read_catalogue(spark, a.catalogue, a.key)
        sinks.write_catalogue(records, a.out)
        bad = records.where("error is not null").select("path", "error")
    elif a.command == "textures":
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", textures.NAMES).load(a.folder)
        bad = sinks.dump_textures(files, a.out).where("error is not null")
    else:
        models = reduce(DataFrame.unionByName, (binary.read_models(spark, p, binary.decryptors(a.xor_key, a.lea_key, a.stage_key)) for p in a.models))
        meshes = inspect.mesh_audit(models)
        if a.item_dir:
            files = binary.files(spark, a.item_dir, textures.NAMES)
            index, shown = textures.item_textures(spark, a.item_dir), textures.opacity(textures.decode(files))
            meshes = textures.resolve(meshes, index, "texture").join(shown.withColumnRenamed("path", "texture_path"), "texture_path", "left")
        show(meshes.orderBy("path", "mesh"))
        show(inspect.shape_audit(models).orderBy("path"))
        show(inspect.leaf_chains(models).orderBy("path", "bone"))
        bad = models.where("error is not null").select("path", "error")
    show(bad)
    return int(not bad.isEmpty())


if __name__ == "__main__":
    sys.exit(main())
