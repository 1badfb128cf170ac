"""The tensor catalog: visible names, discovery of units by patterns, canonical and natural order, layouts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.bits import natural_key
from ..functions.prefix import exclusive_sum

#: Bytes an element takes, and the rank by which a container orders tensors, widest last. Types without a width have only a rank.
WIDTHS = {"BOOL": 1, "U8": 1, "I8": 1, "F8_E5M2": 1, "F8_E4M3": 1, "I16": 2, "U16": 2, "F16": 2, "BF16": 2, "I32": 4, "U32": 4, "F32": 4, "F64": 8, "I64": 8, "U64": 8}
RANKED = "BOOL F4 F6_E2M3 F6_E3M2 U8 I8 F8_E5M2 F8_E4M3 F8_E8M0 F8_E4M3FNUZ F8_E5M2FNUZ I16 U16 F16 BF16 I32 U32 F32 C64 F64 I64 U64".split()


def _lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def width(dtype: Column) -> Column:
    return _lookup(WIDTHS, dtype)


def rank(dtype: Column) -> Column:
    return _lookup({k: i for i, k in enumerate(RANKED)}, dtype)


def consistent(dtype: Column, shape: Column, n_bytes: Column) -> Column:
    """Whether shape times width is the size; unknown types pass; a product too large fails."""
    n = F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: F.try_multiply(a, x))
    return F.when(width(dtype).isNull(), True).otherwise(F.coalesce(F.try_multiply(n, width(dtype).cast("long")) == n_bytes, F.lit(False)))


def canonical(tensors: DataFrame) -> DataFrame:
    """``tensors`` (name, dtype, n_bytes) with place and off_begin, off_end: wider types first, then by name's bytes.

    Places come from ranks within a bucket of names and the buckets' sizes, not from one sort by one task.
    """
    t = tensors.withColumn("rk", -rank(F.col("dtype"))).withColumn("cell", F.substring("name", 1, 12))
    cells = t.groupBy("rk", "cell").agg(F.count("*").alias("c"), F.sum("n_bytes").alias("s"))
    upto = Window.orderBy("rk", "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("rk", "cell", F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("c0"), F.coalesce(F.sum("s").over(upto), F.lit(0)).alias("s0"))
    inside = Window.partitionBy("rk", "cell").orderBy("name")
    t = t.withColumns({"k": F.row_number().over(inside), "b": F.coalesce(F.sum("n_bytes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    t = t.join(cells, ["rk", "cell"])
    return t.select(*tensors.columns, (F.col("c0") + F.col("k") - 1).alias("place"), (F.col("s0") + F.col("b")).alias("off_begin"), (F.col("s0") + F.col("b") + F.col("n_bytes")).alias("off_end"))


def strip_prefix(names: DataFrame, prefix: str) -> DataFrame:
    """(name, visible): names without the prefix are hidden."""
    return names.where(F.col("name").startswith(prefix)).select("name", F.expr(f"substring(name, {len(prefix) + 1})").alias("visible"))


def apply_rules(names: DataFrame, strip: list[str] = (), drop: list[str] = (), rename: list[tuple[str, str]] = ()) -> DataFrame:
    """(name, visible): the first prefix that fits goes, then dropped names, then renames in turn, each at its first match.

    A lazy lead-in keeps a rename to the first match, which Spark's replacement alone does not.
    """
    cut = reduce(lambda other, p: F.when(F.col("name").startswith(p), F.expr(f"substring(name, {len(p) + 1})")).otherwise(other), reversed(list(strip)), F.col("name"))
    out = names.select("name", cut.alias("visible"))
    for pattern in drop:
        out = out.where(~F.col("visible").rlike(pattern))
    for pattern, into in rename:
        groups = re.compile(pattern).groups
        shifted = re.sub(r"\\(\d)|\$(\d)", lambda m: f"${int(m[1] or m[2]) + 1}", into)
        assert groups or "$" not in shifted
        out = out.withColumn("visible", F.regexp_replace("visible", f"(?s)^(.*?){pattern}", "$1" + shifted))
    return out


def collisions(mapped: DataFrame) -> DataFrame:
    """(visible, names): what more than one name would be seen as."""
    return mapped.groupBy("visible").agg(F.count("*").alias("names")).where("names > 1")


def tied_alias(mapped: DataFrame, tied: bool, compresses_head: bool, head: str = "lm_head.weight", embedding: str = "model.embed_tokens.weight") -> DataFrame:
    """``mapped`` with the head as another name of the embedding, where the model ties them and has no head of its own."""
    if not (tied and compresses_head):
        return mapped
    alias = mapped.where(F.col("visible") == embedding).select("name", F.lit(head).alias("visible"))
    own = mapped.where(F.col("visible") == head).select("visible")
    return mapped.unionByName(alias.join(own, "visible", "left_anti").select("name", "visible"))


def java_pattern(pattern: str) -> str:
    """A pattern as the definitions write it: of possessive marks only the last may stand, and is dropped."""
    cut = re.sub(r"(?<!\\)([+*?}])\+$", r"\1", pattern)
    if re.search(r"(?<!\\)[+*?}]\+", cut):
        raise ValueError(f"possessive mark inside pattern {pattern!r}")
    return cut


def candidates(names: DataFrame, units: DataFrame) -> DataFrame:
    """(pi, ai, n_attrs, module, name): every name that a pattern's attribute claims.

    units has (pi, pattern, ai, attr, n_attrs), attr '' for a module that is itself one tensor. Names meet
    attributes by equality of their ends: each name offers all its ends after a dot, and only those that
    meet one are held against the pattern.
    """
    parts = names.where(F.col("name").endswith(".weight")).select("name", F.split(F.expr("substring(name, 1, length(name) - 7)"), r"\.").alias("p"))
    ends = parts.select("name", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("k"))
    ends = ends.select("name", F.array_join(F.slice("p", 1, F.col("k")), ".").alias("module"), F.expr("array_join(slice(p, k + 1, size(p)), '.')").alias("attr"))
    met = ends.join(F.broadcast(units), "attr")  # a definition's patterns: some tens of rows
    return met.where((F.col("module") != "") & F.expr("module rlike concat('^(?:', pattern, ')$')")).select("pi", "ai", "n_attrs", "module", "name")


def contested(found: DataFrame) -> DataFrame:
    """(name, claims): tensors claimed more than once."""
    return found.groupBy("name").agg(F.count("*").alias("claims")).where("claims > 1")


def incomplete(found: DataFrame, units: DataFrame) -> DataFrame:
    """(pi, module, attr): declared attributes that a unit lacks."""
    want = found.select("pi", "module").distinct().join(F.broadcast(units.select("pi", "ai", "attr")), "pi")
    return want.join(found.select("pi", "module", "ai"), ["pi", "module", "ai"], "left_anti").select("pi", "module", "attr")


def ambiguous(found: DataFrame, names: DataFrame, units: DataFrame) -> DataFrame:
    """(module): units of several tensors that have a weight of their own as well."""
    several = found.join(F.broadcast(units.where("attr <> ''").select("pi").distinct()), "pi").select("module").distinct()
    return several.join(names.select(F.expr("substring(name, 1, length(name) - 7)").alias("module"), F.col("name").endswith(".weight").alias("w")).where("w"), "module", "left_semi")


def nested(found: DataFrame) -> DataFrame:
    """(outer_unit, inner_unit): units inside others; each unit offers the modules around it, which meet units by equality."""
    modules = found.select("module").distinct()
    around = modules.select(F.col("module").alias("inner_unit"), F.split("module", r"\.").alias("p")).where("size(p) > 1")
    around = around.select("inner_unit", F.explode(F.expr("transform(sequence(1, size(p) - 1), k -> array_join(slice(p, 1, k), '.'))")).alias("module"))
    return around.join(modules, "module").select(F.col("module").alias("outer_unit"), "inner_unit")


def discovered(found: DataFrame) -> DataFrame:
    """(unit_idx, unit, tensors): by pattern, then natural order; tensors in declared order."""
    units = found.groupBy("pi", "module").agg(F.transform(F.array_sort(F.collect_list(F.struct("ai", "name"))), lambda x: x["name"]).alias("tensors"))
    order = Window.orderBy("pi", natural_key(F.col("module")), "module")  # a model's units are few
    return units.select((F.row_number().over(order) - 1).alias("unit_idx"), F.col("module").alias("unit"), "tensors")


def siblings(found: DataFrame, names: DataFrame) -> DataFrame:
    """(unit, name): other tensors inside a unit's module."""
    units = found.select(F.col("module").alias("unit")).distinct()
    around = names.join(found.select("name").distinct(), "name", "left_anti").withColumn("p", F.split("name", r"\."))
    around = around.select("name", F.explode(F.expr("transform(sequence(1, size(p) - 1), k -> array_join(slice(p, 1, k), '.'))")).alias("unit"))
    return around.join(units, "unit").select("unit", "name")


def passthrough(found: DataFrame, names: DataFrame) -> DataFrame:
    """(name): what no unit claims or holds."""
    return names.select("name").join(found.select("name").distinct(), "name", "left_anti").join(siblings(found, names).select("name"), "name", "left_anti")


def first_error(found: DataFrame, names: DataFrame, units: DataFrame) -> tuple[str, list] | None:
    """The first rule that discovery breaks, in the order in which they are to be told."""
    for code, rows in (
        ("contested", contested(found)),
        ("no_units_found", found.sparkSession.range(1).join(found.select("pi").limit(1), how="left_anti", on=F.lit(True))),
        ("ambiguous_module", ambiguous(found, names, units)),
        ("nested_units", nested(found)),
        ("incomplete_unit", incomplete(found, units)),
    ):
        got = rows.limit(1).collect()
        if got:
            return code, list(got[0])
    return None


def manifest_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, status) for manifests (name, dtype, n_bytes, sha256): missing from b, extra in b, mismatch or same."""
    x, y = a.select("name", F.struct("dtype", "n_bytes", "sha256").alias("x")), b.select("name", F.struct("dtype", "n_bytes", "sha256").alias("y"))
    return x.join(y, "name", "full_outer").select("name", F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").when(F.col("x").eqNullSafe(F.col("y")), "same").otherwise("mismatch").alias("status"))


def shard_name(unit: Column) -> Column:
    return F.concat(F.replace(unit, F.lit("."), F.lit("_")), F.lit(".safetensors"))


def interleaved(names: DataFrame, files: int) -> DataFrame:
    """(name, file): round robin over files in name order."""
    t = canonical(names.select("name", F.lit("U8").alias("dtype"), F.lit(0).cast("long").alias("n_bytes")))
    return t.select("name", (F.col("place") % files).alias("file"))


def with_offsets(tensors: DataFrame, group: list[str], order: str, n_bytes: str) -> DataFrame:
    """Running byte offsets inside each file."""
    return exclusive_sum(tensors, group, order, n_bytes, "off_begin")
