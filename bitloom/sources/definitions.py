"""Definitions of model layouts: which modules are compressed, and how names are seen. Built-in ones and TOML files."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SINGLE_FILE = {"comfyui-native", "diffusers-single"}
LAYOUTS = {"transformers", "diffusers", *SINGLE_FILE}


class BadDefinition(ValueError):
    """code says which rule a definition breaks."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass
class Definition:
    name: str
    layout: str
    format_version: str
    units: list[tuple[str, list[str]]]
    threads_per_block: list[int] = field(default_factory=lambda: [512])
    bytes_per_thread: int = 8
    source: str = "published layout"
    has_keys: bool = False
    strip: list[str] = field(default_factory=list)
    drop: list[str] = field(default_factory=list)
    rename: list[tuple[str, str]] = field(default_factory=list)

    def validate(self) -> Definition:
        for what in ("name", "format_version", "source"):
            if not getattr(self, what):
                raise BadDefinition("empty", what)
        if self.layout not in LAYOUTS:
            raise BadDefinition("parse", f"layout {self.layout}")
        if not self.units:
            raise BadDefinition("no_units", self.name)
        if self.bytes_per_thread < 1 or not self.threads_per_block or min(self.threads_per_block) < 1:
            raise BadDefinition("bad_number", f"{self.threads_per_block}, {self.bytes_per_thread}")
        for pattern in (*self.drop, *(p for p, _ in self.rename)):
            try:
                re.compile(pattern)
            except re.error as e:
                raise BadDefinition("bad_key_rule", f"{pattern}: {e}") from e
        seen = set()
        for pattern, attrs in self.units:
            if pattern in seen:
                raise BadDefinition("duplicate_pattern", pattern)
            seen.add(pattern)
            if len(set(attrs)) != len(attrs):
                raise BadDefinition("duplicate_attr", pattern)
        return self

    @property
    def single_file(self) -> bool:
        return self.layout in SINGLE_FILE

    def config(self) -> dict:
        return {"version": self.format_version, "threads_per_block": self.threads_per_block, "bytes_per_thread": self.bytes_per_thread, "pattern_dict": {p: list(a) for p, a in self.units}}

    def unit_rows(self, spark: SparkSession) -> DataFrame:
        from ..operators.catalog import java_pattern

        rows = [(pi, java_pattern(p), ai, a, len(attrs or [""])) for pi, (p, attrs) in enumerate(self.units) for ai, a in enumerate(attrs or [""])]
        return spark.createDataFrame(rows, "pi int, pattern string, ai int, attr string, n_attrs int")


def expand(text: str) -> list[str]:
    """The attributes of a line: see the head of layouts.txt."""
    out = []
    for m in re.finditer(r"(\S*?)<(\d+)-(\d+)>\.\((.*?)\)(?=\s|$)|(\S*?)\{(.*?)\}|(\S+)", text):
        if m[4] is not None:
            out += [f"{m[1]}{i}.{x}" for i in range(int(m[2]), int(m[3]) + 1) for x in expand(m[4])]
        elif m[6] is not None:
            out += [m[5] + x for x in m[6].split()]
        else:
            out.append(m[7])
    return out


def built_in() -> dict[str, Definition]:
    out: dict[str, Definition] = {}
    for line in (Path(__file__).parent / "layouts.txt").read_text().splitlines():
        if not line or line.startswith("#"):
            continue
        if not line.startswith(" "):
            name, layout, version = line.split(" | ")
            d = out[name] = Definition(name, layout, version, [])
            continue
        line = line.strip()
        word, _, rest = line.partition(" ")
        if line == "keys":
            d.has_keys = True
        elif word in ("strip", "drop") and " : " not in line:
            getattr(d, word).append(rest)
        elif word == "rename":
            d.rename.append(tuple(rest.split(" -> ")))
        else:
            pattern, _, attrs = line.partition(" :")
            d.units.append((pattern, expand(attrs)))
    return {k: v.validate() for k, v in out.items()}


def from_toml(text: str) -> Definition:
    try:
        t = tomllib.loads(text)
        keys = t.get("keys")
        extra = set(keys or ()) - {"strip_prefix", "drop", "rename"} or {k for r in (keys or {}).get("rename", []) for k in r} - {"pattern", "replacement"}
        if extra:
            raise BadDefinition("parse", f"unknown {sorted(extra)}")
        keys = keys or {}
        return Definition(
            t["name"], t["layout"], t["format_version"], [(u["pattern"], list(u["attrs"])) for u in t.get("unit", [])], list(t["threads_per_block"]), int(t["bytes_per_thread"]), t["source"],
            "keys" in t, list(keys.get("strip_prefix", [])), list(keys.get("drop", [])), [(r["pattern"], r["replacement"]) for r in keys.get("rename", [])],
        ).validate()
    except (tomllib.TOMLDecodeError, KeyError, TypeError) as e:
        raise BadDefinition("parse", str(e)) from e


def all_definitions(extra_dir: str | None = None) -> dict[str, Definition | BadDefinition]:
    """By name; files of a folder take the place of built-in ones, those that can't be read as their error."""
    out: dict[str, Definition | BadDefinition] = dict(built_in())
    for p in sorted(Path(extra_dir).glob("*.toml")) if extra_dir else ():
        try:
            out[p.stem] = from_toml(p.read_text())
        except BadDefinition as e:
            out[p.stem] = e
    return out


def load(spec: str, extra_dir: str | None = None) -> Definition:
    if spec.endswith(".toml"):
        return from_toml(Path(spec).read_text())
    found = all_definitions(extra_dir).get(spec)
    if isinstance(found, BadDefinition):
        raise found
    if found is None:
        raise BadDefinition("unknown", f"{spec}: architectures() lists the names")
    return found


def architectures(spark: SparkSession, extra_dir: str | None = None) -> DataFrame:
    """(name, layout, units, source): all definitions; layout INVALID and the reason for those that can't be read."""
    rows = [(n, "INVALID", 0, str(d)) if isinstance(d, BadDefinition) else (n, d.layout, len(d.units), d.source) for n, d in all_definitions(extra_dir).items()]
    return spark.createDataFrame(rows, "name string, layout string, units int, source string").orderBy(F.col("name"))
