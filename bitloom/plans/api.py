"""compress, verify and architectures over containers: catalogs as DataFrames, a unit's arrays in one Arrow task."""

from __future__ import annotations

import json
import os
import shutil
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as cat
from ..operators import packed
from ..operators.codec import CHUNK_BITS, CHUNK_BYTES, MOST_TABLES, WINDOWS_PER_CHUNK
from ..operators.sampling import plan as sample_plan
from ..shipping import ship
from ..sources import container
from ..sources.definitions import Definition, architectures, load

__all__ = ["architectures", "compress", "verify", "discover", "CompressError"]

CONFIG_KEY = "dfloat11_config"
REMAINDERS = {"transformers": "model.safetensors", "diffusers": "diffusion_pytorch_model.safetensors", "comfyui-native": "model.safetensors", "diffusers-single": "model.safetensors"}
OUT = "file string, name string, dtype string, shape array<long>, bytes binary, refused string"


class CompressError(ValueError):
    def __init__(self, code: str, detail):
        super().__init__(f"{code}: {detail}")
        self.code, self.detail = code, detail


def _config(source: str) -> dict | None:
    folder = source if os.path.isdir(source) else os.path.dirname(source)
    path = os.path.join(folder, "config.json")
    return json.load(open(path)) if os.path.exists(path) else None


def visible_names(tensors: DataFrame, arch: Definition, config: dict | None) -> DataFrame:
    """(name, visible): names as the definition sees them."""
    names = tensors.select("name")
    if arch.layout == "comfyui-native" and names.where(F.col("name").startswith("model.diffusion_model.")).limit(1).count():
        mapped = cat.strip_prefix(names, "model.diffusion_model.")
        ruled = cat.apply_rules(mapped.select(F.col("visible").alias("name")), arch.strip, arch.drop, arch.rename).withColumnsRenamed({"name": "v0", "visible": "v1"})
        mapped = mapped.join(ruled, F.col("visible") == F.col("v0")).select("name", F.col("v1").alias("visible"))
    else:
        mapped = cat.apply_rules(names, arch.strip, arch.drop, arch.rename)
    clash = cat.collisions(mapped).limit(1).collect()
    if clash:
        raise CompressError("collision", clash[0].visible)
    heads = any(p == "lm_head" for p, _ in arch.units)
    return cat.tied_alias(mapped, bool((config or {}).get("tie_word_embeddings")), heads)


def discover(spark: SparkSession, tensors: DataFrame, arch: Definition, config: dict | None = None) -> DataFrame:
    """``tensors`` with visible, role (unit, sibling, passthrough), unit and ai; refuses what discovery refuses."""
    mapped = visible_names(tensors, arch, config)
    names, units = mapped.select(F.col("visible").alias("name")), arch.unit_rows(spark)
    found = cat.candidates(names, units).cache()  # a model has some thousands of names
    error = cat.first_error(found, names, units)
    if error:
        raise CompressError(*error)
    order = cat.discovered(found).select("unit_idx", F.col("unit").alias("module"))
    own = found.join(order, "module").select(F.col("name").alias("visible"), F.col("module").alias("unit"), "unit_idx", "ai", F.lit("unit").alias("role"))
    near = cat.siblings(found, names).withColumnRenamed("name", "visible").join(order.withColumnRenamed("module", "unit"), "unit").select("visible", "unit", "unit_idx", F.lit(None).cast("int").alias("ai"), F.lit("sibling").alias("role"))
    roles = own.unionByName(near)
    return tensors.join(mapped, "name").join(roles, "visible", "left").withColumn("role", F.coalesce("role", F.lit("passthrough")))


def _encoder(correct: bool, block: int | None, safe: bool):
    def run(unit: pa.Table) -> pa.Table:
        rows = sorted(unit.to_pylist(), key=lambda r: r["ai"])
        name = rows[0]["unit"]
        tensors = [np.frombuffer(r["bytes"], "<u2") for r in rows]
        try:
            out, _ = packed.encode(tensors, correct, block)
            if safe:
                by = {n: b for n, _, _, b in out}
                w = np.concatenate(tensors)
                pos = np.frombuffer(by["output_positions"], "<u4").astype(np.int64)
                e = packed.decode_stream(np.frombuffer(by["luts"], np.uint8).reshape(-1, 256), by["encoded_exponent"], packed.unpack_gaps(by["gaps"]), pos)
                if not np.array_equal(packed.recombined(e, np.frombuffer(by["sign_mantissa"], np.uint8)), w):
                    raise packed.Refused("weight_mismatch")
        except packed.Refused as e:
            return _table([(rows[0]["to_file"], name, "", [], b"", str(e))])
        return _table([(rows[0]["to_file"], f"{name}.{n}", d, s, b, None) for n, d, s, b in out])

    return run


def _table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.binary(), pa.string())
    return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "name", "dtype", "shape", "bytes", "refused"])


def compress(spark: SparkSession, source: str, arch: str | Definition, out: str, luts: str = "compat", safe: bool = False, hashes: bool = False, index: str = "base", idx8_block: int | None = None) -> DataFrame:
    """Writes a folder of containers and its config; returns (file, tensors, bytes, source_bytes, ratio).

    ``index`` is base or idx8, whose blocks hold 64 symbols unless said otherwise. What can't be compressed rightly
    is refused before anything is written: other types than BF16, units of discovery's errors, reserved exponents.
    """
    if idx8_block is not None and index != "idx8":
        raise CompressError("arguments", "idx8_block goes with index='idx8'")
    if luts not in ("compat", "correct") or index not in ("base", "idx8"):
        raise CompressError("arguments", f"luts={luts}, index={index}")
    ship(spark)
    d = arch if isinstance(arch, Definition) else load(arch)
    block = (idx8_block or 64) if index == "idx8" else None
    config = _config(source)
    heads = container.read_tensors(spark, source, with_bytes=False).drop("bytes")
    twice = container.duplicates(heads).limit(1).collect()
    if twice:
        raise CompressError("malformed", f"{twice[0].name} in {twice[0].files} files")
    roles = discover(spark, heads.drop("metadata"), d, config)
    other = roles.where((F.col("role") == "unit") & (F.col("dtype") != "BF16")).orderBy("unit_idx", "ai").limit(1).collect()
    if other:
        raise CompressError("not_bf16", f"{other[0].name} is {other[0].dtype}")
    single = REMAINDERS[d.layout]
    file = F.lit(single) if d.single_file else F.when(F.col("role") == "passthrough", F.lit(single)).otherwise(cat.shard_name(F.col("unit")))
    roles = roles.withColumn("to_file", file).select("name", "visible", "role", "unit", "ai", "to_file")
    tensors = container.read_tensors(spark, source).select("name", "dtype", "shape", "bytes").join(roles, "name")
    # A unit's tensors make up one stream, so a unit is one task's work, as large as the largest unit.
    coded = tensors.where("role = 'unit'").select("unit", "ai", "to_file", "bytes").groupBy("unit").applyInArrow(_encoder(luts == "correct", block, safe), OUT)
    rest = tensors.where("role <> 'unit'").select(F.col("to_file").alias("file"), F.col("visible").alias("name"), "dtype", "shape", "bytes", F.lit(None).cast("string").alias("refused"))
    if (config or {}).get("tie_word_embeddings"):
        both = rest.where(F.col("name").isin("lm_head.weight", "model.embed_tokens.weight")).select("name", F.sha2("bytes", 256).alias("h")).collect()
        if len(both) == 2 and both[0].h == both[1].h:
            rest = rest.where("name <> 'lm_head.weight'")
    staging = f"{out.rstrip('/')}.staging"
    try:
        coded.unionByName(rest).write.mode("overwrite").parquet(staging)
        rows = spark.read.parquet(staging)
        refused = rows.where("refused is not null").select("name", "refused").limit(1).collect()
        if refused:
            raise CompressError(refused[0].refused.split(":")[0], f"{refused[0].name}: {refused[0].refused}")
        os.makedirs(out, exist_ok=True)
        meta: dict[str, dict[str, str]] = {"*": {}, single: {"format": "pt"}}
        stamps = ({"luts": "correct"} if luts == "correct" else {}) | ({"index": "idx8"} if block else {})
        files = [r.file for r in rows.select("file").distinct().collect()]
        meta = {f: (meta.get(f, {}) | stamps) for f in files}
        if hashes:
            for r in rows.select("file", "name", F.sha2("bytes", 256).alias("h")).collect():
                meta[r.file][f"sha256.{r.name}"] = r.h
        container.write_tensors(rows, out, meta)
        _write_configs(source, out, d, config, block)
        sizes = rows.groupBy("file").agg(F.count("*").alias("tensors"), F.sum(F.length("bytes")).cast("long").alias("bytes")).collect()
    finally:
        shutil.rmtree(staging, ignore_errors=True)
    total = heads.agg(F.coalesce(F.sum(F.col("off_end") - F.col("off_begin")), F.lit(0))).first()[0]
    done = sum(r.bytes for r in sizes)
    return spark.createDataFrame([(r.file, r.tensors, r.bytes, total, done / total if total else 0.0) for r in sizes], "file string, tensors long, bytes long, source_bytes long, ratio double")


def build_config(source: dict | None, d: Definition, block: int | None = None) -> dict | None:
    """The output's config: none for node-based layouts; all of the source's keys for transformers, else its model_type."""
    if d.layout == "comfyui-native":
        return None
    kept = {k: v for k, v in (source or {}).items() if k != CONFIG_KEY} if d.layout == "transformers" else {k: v for k, v in (source or {}).items() if k == "model_type" and v is not None}
    return kept | {(f"idx8_{CONFIG_KEY}" if block else CONFIG_KEY): d.config() | ({"idx8_block": block} if block else {})}


def _write_configs(source: str, out: str, d: Definition, config: dict | None, block: int | None) -> None:
    built = build_config(config, d, block)
    if built is not None:
        path = os.path.join(out, "config.json")
        with open(f"{path}.tmp", "w") as f:
            json.dump(built, f, indent=2)
            f.write("\n")
        os.replace(f"{path}.tmp", path)
    folder = source if os.path.isdir(source) else os.path.dirname(source)
    extra = os.path.join(folder, "generation_config.json")
    if os.path.exists(extra):
        shutil.copyfile(extra, os.path.join(out, "generation_config.json"))


def _unit_check(unit: pa.Table) -> pa.Table:
    """(unit, rule, detail) for each rule that a unit breaks by itself, and its shape for sampling."""
    rows = {r["suffix"]: r for r in unit.to_pylist()}
    name = unit.column("unit")[0].as_py()
    out = [("hash", s) for s, r in rows.items() if r["stored"] and r["stored"] != container.sha256_of(r["bytes"])]
    missing = packed.SUFFIXES - set(rows)
    if missing:
        out.append(("missing", ",".join(sorted(missing))))
        return _found(name, out)
    luts, enc, sm, gaps = (rows[k]["bytes"] for k in ("luts", "encoded_exponent", "sign_mantissa", "gaps"))
    pos, split = np.frombuffer(rows["output_positions"]["bytes"], "<u4").astype(np.int64), np.frombuffer(rows["split_positions"]["bytes"], "<i8")
    n, chunks = len(sm), -(-len(enc) // CHUNK_BYTES)
    tables = len(luts) // 256 - 1
    if len(luts) % 256 or tables < 1:
        out.append(("luts_rows", str(len(luts))))
    elif tables > MOST_TABLES:
        out.append(("luts_tables", str(tables)))
    else:
        v = np.frombuffer(luts[: tables * 256], np.uint8).astype(int)
        if ((v >= 240) & (256 - v >= tables)).any():
            out.append(("luts_jump", str(int(np.argmax((v >= 240) & (256 - v >= tables))))))
    if len(pos) != chunks + 1:
        out.append(("outpos_count", f"{len(pos)} for {chunks} chunks"))
    if len(gaps) != -(-chunks * WINDOWS_PER_CHUNK * 5 // 8):
        out.append(("gaps_bytes", str(len(gaps))))
    if len(pos) and pos[0] != 0:
        out.append(("outpos_first", str(pos[0])))
    if not len(pos) or pos[-1] != n:
        out.append(("outpos_total", f"{pos[-1] if len(pos) else None} of {n}"))
    step = np.diff(pos)
    if ((step < 0) | (step > CHUNK_BITS)).any():
        out.append(("outpos_step", str(int(np.argmax((step < 0) | (step > CHUNK_BITS))))))
    if len(split) and ((np.diff(split, prepend=0) <= 0) | (split >= n)).any():
        out.append(("split_inside", str(split.tolist()[:9])))
    return _found(name, out)


def _found(name: str, out: list[tuple[str, str]]) -> pa.Table:
    return pa.table({"unit": pa.array([name] * len(out), pa.string()), "rule": pa.array([a for a, _ in out], pa.string()), "detail": pa.array([b for _, b in out], pa.string())})


def _full_check(unit: pa.Table) -> pa.Table:
    """Decodes chunk by chunk through tables and indices, and holds every weight against the source."""
    rows = unit.to_pylist()
    name = rows[0]["unit"]
    out = {r["suffix"]: r["bytes"] for r in rows if r["suffix"]}
    tensors = [np.frombuffer(r["bytes"], "<u2") for r in sorted((r for r in rows if not r["suffix"]), key=lambda r: r["ai"])]
    w = np.concatenate(tensors)
    sm = np.frombuffer(out["sign_mantissa"], np.uint8)
    if len(w) != len(sm):
        return _found(name, [("weight_count", f"{len(sm)} of {len(w)}")])
    if np.cumsum([len(t) for t in tensors])[:-1].tolist() != np.frombuffer(out["split_positions"], "<i8").tolist():
        return _found(name, [("split_positions", "differ from the source's")])
    pos = np.frombuffer(out["output_positions"], "<u4").astype(np.int64)
    gaps = packed.unpack_gaps(out["gaps"])
    luts = np.frombuffer(out["luts"], np.uint8).reshape(-1, 256)
    picks = json.loads(rows[0]["picks"]) if rows[0]["picks"] else range(len(pos) - 1)
    bad = []
    if not rows[0]["picks"]:
        try:  # all chunks together; only what is wrong is looked for chunk by chunk
            if np.array_equal(packed.recombined(packed.decode_stream(luts, out["encoded_exponent"], gaps, pos), sm), w):
                return _found(name, [])
        except packed.Refused:
            pass
    for c in picks:
        lo, hi = int(pos[c]), int(pos[c + 1])
        data = out["encoded_exponent"][c * CHUNK_BYTES : (c + 1) * CHUNK_BYTES + 8]
        try:
            e = packed.decode(luts, data, hi - lo, int(gaps[c * WINDOWS_PER_CHUNK]))
        except packed.Refused as x:
            bad.append((x.code, f"chunk {c}: {x.facts}"))
            continue
        wrong = np.flatnonzero(packed.recombined(e, sm[lo:hi]) != w[lo:hi])
        if len(wrong):
            bad.append(("weight_mismatch", f"chunk {c}, weight {lo + int(wrong[0])}"))
    return _found(name, bad)


def verify(spark: SparkSession, output: str, source: str | None = None, arch: str | Definition | None = None, level: str | None = None, samples: int = 1000, seed: int | None = None) -> DataFrame:
    """(unit, rule, detail): what is wrong, no row if all is right.

    Levels: integrity, hashes and structure alone; sample, also some chunks against the source, the first, the last
    and those at tensor boundaries always; full, every chunk. Without a source only integrity can be checked.
    """
    if (source is None) != (arch is None):
        raise CompressError("arguments", "source and arch go together")
    level = level or ("sample" if source else "integrity")
    if level not in ("integrity", "sample", "full"):
        raise CompressError("arguments", f"level {level}")
    if level != "integrity" and source is None:
        raise CompressError("needs_source", level)
    ship(spark)
    rows = container.read_tensors(spark, output)
    if rows.where(F.col("metadata")["index"] == "idx8").limit(1).count():
        raise CompressError("idx8_unsupported", "a block-indexed output has no window gaps to check against")
    split = rows.select(F.regexp_extract("name", r"^(.*)\.([^.]+)$", 1).alias("unit"), F.regexp_extract("name", r"^(.*)\.([^.]+)$", 2).alias("suffix"), "bytes", F.element_at("metadata", F.concat(F.lit("sha256."), "name")).alias("stored"))
    units = split.where(F.col("suffix").isin(*packed.SUFFIXES))
    broken = units.groupBy("unit").applyInArrow(_unit_check, "unit string, rule string, detail string")
    if level == "integrity":
        if not units.limit(1).count():
            return spark.createDataFrame([("", "no_units", output)], "unit string, rule string, detail string")
        return broken
    d = arch if isinstance(arch, Definition) else load(arch)
    heads = container.read_tensors(spark, source, with_bytes=False).drop("bytes", "metadata")
    roles = discover(spark, heads, d, _config(source)).where("role = 'unit'").select("name", "unit", "unit_idx", "ai")
    want = roles.select("unit").distinct()
    absent = want.join(units.select("unit").distinct(), "unit", "left_anti").select("unit", F.lit("absent").alias("rule"), F.lit("").alias("detail"))
    broken = broken.unionByName(absent)
    bad = [r.unit for r in broken.select("unit").distinct().collect()]
    good = want.where(~F.col("unit").isin(bad)) if bad else want
    picks = _picks(spark, units.join(good, "unit", "left_semi"), roles, samples, int(time.time_ns()) if seed is None else seed) if level == "sample" else good.select("unit", F.lit(None).cast("string").alias("picks"))
    theirs = container.read_tensors(spark, source).select("name", "bytes").join(roles, "name").select("unit", F.lit("").alias("suffix"), "ai", "bytes")
    both = units.select("unit", "suffix", F.lit(-1).alias("ai"), "bytes").unionByName(theirs).join(picks, "unit")
    return broken.unionByName(both.groupBy("unit").applyInArrow(_full_check, "unit string, rule string, detail string"))


def _picks(spark: SparkSession, units: DataFrame, roles: DataFrame, samples: int, seed: int) -> DataFrame:
    """(unit, picks): the chunks to decode of each unit, as JSON; from the units' small indices alone."""
    small = units.where(F.col("suffix").isin("output_positions", "split_positions")).select("unit", "suffix", "bytes").collect()
    order = [r.unit for r in roles.select("unit", "unit_idx").distinct().orderBy("unit_idx").collect()]
    by: dict[str, dict[str, np.ndarray]] = {}
    for r in small:
        by.setdefault(r.unit, {})[r.suffix] = np.frombuffer(r.bytes, "<u4" if r.suffix == "output_positions" else "<i8").astype(np.int64)
    names = [u for u in order if u in by]
    shapes = []
    for u in names:
        pos, split = by[u]["output_positions"], by[u]["split_positions"]
        edges = np.unique(np.concatenate([split - 1, split])) if len(split) else split
        shapes.append((len(pos) - 1, sorted({int(np.searchsorted(pos[:-1], e, "right")) - 1 for e in edges})))
    chosen: dict[str, list[int]] = {u: [] for u in names}
    for u, c in sample_plan(shapes, samples, seed & (2**64 - 1)):
        chosen[names[u]].append(c)
    return spark.createDataFrame([(u, json.dumps(c)) for u, c in chosen.items()], "unit string, picks string")
