"""Settings of a program run: a JSON file, what the caller sets over it, and defaults found beside the data."""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Iterable
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    """Empty and zero mean: not set."""

    base_dir: str = ""
    item_dir: str = ""
    item_list_xml: str = ""
    trs_bmd: str = ""
    custom_trs_json: str = ""
    output_dir: str = ""
    render_size: int = 0
    render_width: int = 0
    render_height: int = 0
    supersample: int = 0
    webp_quality: int = 0
    workers: int = 0


#: Where things lie under the base folder (of several the first that is there), and numbers in place of zero.
PLACES = {
    "item_dir": ("Data/Item",),
    "item_list_xml": ("ItemList.xml", "Data/Xml/ItemList.xml", "Data/xml/ItemList.xml"),
    "trs_bmd": ("Data/Local/itemtrsdata.bmd",),
    "custom_trs_json": ("custom_trs.json",),
    "output_dir": ("Data/Item-renders",),
}
NUMBERS = {"render_size": 256, "supersample": 2, "webp_quality": 90}


def load(path: str) -> Settings:
    """The file's settings; names that aren't settings don't count, a value of another type is an error."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    if not isinstance(found, dict):
        raise ValueError(f"{path}: not a JSON object")
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    own = {k: v for k, v in found.items() if k in kinds and v is not None}
    for k, v in own.items():
        if not isinstance(v, kinds[k]) or isinstance(v, bool):
            raise ValueError(f"{path}: {k} is {v!r}")
    return Settings(**own)


def likely_bases() -> list[str]:
    """The program's folder and the two above it, the working folder and the one above it."""
    program = os.path.dirname(os.path.abspath(sys.argv[0] or "."))
    here = os.getcwd()
    return [program, os.path.dirname(program), os.path.dirname(os.path.dirname(program)), here, os.path.dirname(here)]


def find_base(folders: Iterable[str]) -> str:
    """The first folder with items under it, or nothing."""
    return next((d for d in folders if os.path.exists(os.path.join(d, "Data", "Item"))), "")


def resolve(s: Settings, folders: Iterable[str] | None = None, **over) -> Settings:
    """s with what over sets, paths made absolute under the base folder, and defaults for the rest. Without a base folder paths stay as they are."""
    s = replace(s, **{k: v for k, v in over.items() if v})
    base = s.base_dir or find_base(likely_bases() if folders is None else folders)
    if base:
        chosen = {}
        for name, places in PLACES.items():
            under = [os.path.join(base, *p.split("/")) for p in places]
            chosen[name] = os.path.join(base, getattr(s, name)) if getattr(s, name) else next(filter(os.path.exists, under), under[0])
        s = replace(s, base_dir=base, **chosen)
    s = replace(s, **{k: v for k, v in NUMBERS.items() if getattr(s, k) <= 0})
    sides = {k: s.render_size for k in ("render_width", "render_height") if getattr(s, k) <= 0}
    return replace(s, workers=s.workers if s.workers > 0 else os.cpu_count() or 1, **sides)
