"""What surrounds the codec: resource plans, config schemas, manifests, repacking, byte differences, stand-in inputs."""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import canonical

HELD, HELD_SAFE, SHARE = 6.0, 10.0, 0.8  # bytes a weight that a worker holds, with checking too; the share of memory to use


def worker_count(largest: Column, budget: Column, cores: Column, asked: Column, safe: Column, available: Column) -> Column:
    """Units at once: as asked for, else what fits the budget or the share of what is available, from 1 to the cores; all cores if neither is known."""
    room = F.coalesce(budget.cast("double"), F.floor(available * SHARE).cast("double"))
    each = F.greatest(largest * F.when(safe, HELD_SAFE).otherwise(HELD), F.lit(1.0))
    fits = F.coalesce(F.floor(room / each), cores.cast("long"))
    return F.when(asked.isNotNull(), F.greatest(asked.cast("long"), F.lit(1))).otherwise(F.greatest(F.lit(1), F.least(fits, F.greatest(cores.cast("long"), F.lit(1)))))


def read_in_turn(mode: Column, rotational: Column) -> Column:
    """Whether reads go one at a time: as forced, else only on a device known to turn."""
    return F.when(mode == "sequential", True).when(mode == "concurrent", False).otherwise(F.coalesce(rotational, F.lit(False)))


def mem_available(meminfo: str) -> int | None:
    """Bytes, of the text of the kernel's account of memory."""
    m = re.search(r"^MemAvailable:\s+(\d+)", meminfo, re.M)
    return int(m[1]) * 1024 if m else None


def group_headroom(limit: str | None, usage: str | None) -> int | None:
    """What a container may still take; none without a limit."""
    if limit is None or not limit.strip().isdigit() or int(limit) >= 1 << 60:
        return None
    used = int(usage) if usage and usage.strip().isdigit() else 0
    return max(0, int(limit) - used)


def device_numbers(dev: Column) -> tuple[Column, Column]:
    """Major and minor of a 64-bit device number."""
    major = F.shiftright(dev, 8).bitwiseAND(0xFFF).bitwiseOR(F.shiftright(dev, 32).bitwiseAND(~0xFFF & 0xFFFFFFFF))
    return major, dev.bitwiseAND(0xFF).bitwiseOR(F.shiftright(dev, 12).bitwiseAND(~0xFF & 0xFFFFFFFF))


def config_minimal(source: dict, block: dict, key: str) -> dict:
    return dict(source) | {key: block}


def config_full(source: dict, block: dict, key: str, library_version: str) -> dict:
    """The newer schema: dtype, rope parameters in one place, the layers' kinds, a padding token, the version as declared.

    A sliding window in use is refused, for how its layers are to be named isn't known.
    """
    if source.get("sliding_window") is not None and source.get("use_sliding_window"):
        raise NotImplementedError("layers with a sliding window")
    out = {k: v for k, v in source.items() if k not in ("torch_dtype", "rope_theta", "rope_scaling") or (k == "rope_scaling" and "rope_theta" not in source)}
    if "torch_dtype" in source:
        out["dtype"] = source["torch_dtype"]
    if "rope_theta" in source:
        scaling = source.get("rope_scaling") or {}
        out["rope_parameters"] = {"rope_theta": source["rope_theta"], "rope_type": "default"} | dict(scaling)
    out["layer_types"] = ["full_attention"] * source["num_hidden_layers"]
    out.setdefault("pad_token_id", None)
    return out | {"transformers_version": library_version, key: block}


def config_text(config: dict) -> str:
    return json.dumps(config, sort_keys=True, indent=2) + "\n"


def manifest(tensors: DataFrame) -> DataFrame:
    """(file, name, dtype, n_bytes, sha256) of tensors with their bytes."""
    return tensors.select("file", "name", "dtype", F.length("bytes").cast("long").alias("n_bytes"), F.sha2("bytes", 256).alias("sha256"))


def manifest_totals(rows: DataFrame, suffixes: list[str]) -> DataFrame:
    """(file, unit_tensors, others, total_bytes): tensors of units by their last name, and the rest."""
    own = F.regexp_extract("name", r"([^.]+)$", 1).isin(suffixes)
    return rows.groupBy("file").agg(F.count(F.when(own, 1)).alias("unit_tensors"), F.count(F.when(~own, 1)).alias("others"), F.sum("n_bytes").alias("total_bytes"))


def tree_diff(ours: DataFrame, official: DataFrame, release: DataFrame) -> DataFrame:
    """(file, in_ours, same_as_official, same_as_release) of (file, sha256) trees, over every file that any has."""
    out = ours.select("file", F.col("sha256").alias("a")).join(official.select("file", F.col("sha256").alias("b")), "file", "full_outer").join(release.select("file", F.col("sha256").alias("c")), "file", "full_outer")
    return out.select("file", F.col("a").isNotNull().alias("in_ours"), F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same_as_official"), F.coalesce(F.col("a") == F.col("c"), F.lit(False)).alias("same_as_release"))


def repacked(tensors: DataFrame, files: int, stem: str = "part") -> DataFrame:
    """``tensors`` with ``file`` dealt round robin in the order of names; one file if files is 1."""
    order = canonical(tensors.select("name", F.lit("U8").alias("dtype"), F.lit(0).cast("long").alias("n_bytes"))).select("name", "place")
    return tensors.drop("file").join(order, "name").withColumn("file", F.format_string(f"{stem}-%03d.safetensors", (F.col("place") % files).cast("int"))).drop("place")


def merged_units(tensors: DataFrame) -> DataFrame:
    """(unit, suffixes, files): units put together from whatever files hold their tensors."""
    t = tensors.select(F.regexp_extract("name", r"^(.*)\.([^.]+)$", 1).alias("unit"), F.regexp_extract("name", r"^(.*)\.([^.]+)$", 2).alias("suffix"), "file")
    return t.where("unit <> ''").groupBy("unit").agg(F.array_sort(F.collect_set("suffix")).alias("suffixes"), F.countDistinct("file").alias("files"))


def first_difference(a: bytes, b: bytes, around: int = 8) -> dict | None:
    """Where two byte strings differ first, in bytes and bits, with what stands around it."""
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8)[:n], np.frombuffer(b, np.uint8)[:n]
    at = np.flatnonzero(x != y)
    if not len(at) and len(a) == len(b):
        return None
    k = int(at[0]) if len(at) else n
    lo = max(0, k - around)
    return {"byte": k, "bit": 8 * k, "ours": a[lo : k + around].hex(), "theirs": b[lo : k + around].hex(), "lengths": (len(a), len(b))}


def truncated(tensors: DataFrame, layers: int, rows: int, tables: tuple[str, ...] = ("model.embed_tokens.weight", "lm_head.weight")) -> DataFrame:
    """A smaller model of (name, shape, bytes): its first layers, and the first rows of its embeddings."""
    layer = F.expr(r"try_cast(regexp_extract(name, '^model[.]layers[.]([0-9]+)[.]', 1) as int)")
    kept = tensors.where(layer.isNull() | (layer < layers))
    cut = F.col("name").isin(*tables) & F.expr(f"get(shape, 0) > {rows}")
    data = F.expr(f"substring(bytes, 1, cast(length(bytes) div greatest(get(shape, 0), 1) as int) * {rows})")
    shape = F.expr(f"concat(array({rows}L), slice(shape, 2, greatest(size(shape), 1)))")
    return kept.withColumns({"bytes": F.when(cut, data).otherwise(F.col("bytes")), "shape": F.when(cut, shape).otherwise(F.col("shape"))})


def instances(pattern: str) -> list[str]:
    """Names that a pattern of literals, digit runs and small classes matches: digit runs are 0 and 1, a class each of its members."""
    out = [""]
    for m in re.finditer(r"\\d\+\+?|\[([^\]]+)\]|\(([^)]*)\)|\\(.)|(.)", pattern):
        if m[0].startswith(r"\d"):
            choices = ["0", "1"]
        elif m[1] is not None:
            choices = list(re.sub(r"(.)-(.)", lambda r: "".join(map(chr, range(ord(r[1]), ord(r[2]) + 1))), m[1]))
        elif m[2] is not None:
            choices = [x for part in m[2].removeprefix("?:").split("|") for x in instances(part)]
        else:
            choices = [m[3] or m[4]]
        out = [a + b for a in out for b in choices]
    return [x for x in out if re.fullmatch(pattern, x)]


def seed_for(name: str) -> int:
    return zlib.crc32(name.encode())


def stand_in(name: str, n: int) -> np.ndarray:
    """n BF16 weights of a seeded normal distribution, as a model's would be spread."""
    return (np.random.default_rng(seed_for(name)).normal(0, 0.02, n).astype(np.float32).view(np.uint32) >> 16).astype(np.uint16)


def release_map(definitions: DataFrame, releases: DataFrame) -> DataFrame:
    """(release, definition): the least name of the definitions with a release's patterns and geometry (column key), or none."""
    best = definitions.groupBy("key").agg(F.min("name").alias("definition"))
    return releases.join(best, "key", "left").select("release", "definition")
