"""Every registered codec and catalog query against its SQL, at the smallest size; and hand-made cases."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.functions import bits
from bitloom.functions.prefix import exclusive_sum
from bitloom.operators import catalog, codec, limiter, packed, sampling, verify
from bitloom.plans import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: The slower queries are left to the comparison at the next size.
QUICK = [q for q in queries.ORACLES if q not in {"structure_violations", "sample_mandatory", "chunk_of_element", "idx8_block_decode", "chunk_decode", "gaps_unpacked", "size_report", "launch_geometry", "outpos_delta_bounds", "idx8_block_ranges", "idx8_superblocks"}]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(row):
    return tuple(None if x is None or isinstance(x, float) and math.isnan(x) else round(x, 5) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted((plain(r) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted((plain(r) for r in want.select(*columns).fetchall()), key=repr)


def test_bf16_bits_next_to_powers_of_two(spark):
    values = [s * m * 2.0**k for k in range(-140, 128, 3) for m in (1.0, 1.5, 1.9999998807907104, 1.0078125) for s in (1, -1)] + [0.0, math.inf]
    values = [float(x) for x in np.array(values, np.float32)]
    rows = spark.createDataFrame([(v,) for v in values], "v float").select("v", bits.bf16_bits(F.col("v")).alias("w")).collect()
    for r in rows:
        assert r.w == int(np.float32(r.v).view(np.uint32) >> 16), r


def test_exclusive_sum_over_stretches(spark):
    rows = [(u, o, o % 5 + 1) for u in (1, 2) for o in range(0, 300, 3)]
    got = exclusive_sum(spark.createDataFrame(rows, "u int, o long, v int"), ["u"], "o", "v", "s", stretch=16).collect()
    for r in got:
        assert r.s == sum(v for u, o, v in rows if u == r.u and o < r.o)
    assert len(got) == len(rows)


def test_codebook_equals_heap(spark):
    hists = {0: [(7, 100)], 1: [(3, 5), (200, 5)], 2: [(s, f) for s, f in enumerate(limiter.fibonacci(25))], 3: [(s, 4) for s in range(31)]}
    h = spark.createDataFrame([(u, s, f) for u, x in hists.items() for s, f in x], "unit int, e int, cnt long")
    rows = codec.codebook(h).orderBy("unit", "ord").collect()
    for u, x in hists.items():
        assert [(r.sym, r.bits, r.val) for r in rows if r.unit == u] == limiter.prefix_code(x)


@pytest.mark.parametrize("correct", [False, True])
def test_luts_equal_packed_ones(spark, correct):
    hists = {1: [(3, 5), (200, 5)], 2: [(s, f) for s, f in enumerate(limiter.fibonacci(25))]}
    b = codec.codebook(spark.createDataFrame([(u, s, f) for u, x in hists.items() for s, f in x], "unit int, e int, cnt long"))
    t = codec.prefix_tables(b)
    rows = codec.luts(b, t, codec.lut_cells(b, t), correct).orderBy("unit", "tbl", "byte").collect()
    for u, x in hists.items():
        assert [r.v for r in rows if r.unit == u] == packed.tables_of(limiter.prefix_code(x), correct).ravel().tolist()


def test_rows_and_arrays_encode_alike(spark):
    """The last code straddles a window, the stream ends on a byte, one symbol alone: both accounts agree on every byte."""
    rng = np.random.default_rng(3)
    streams = {u: rng.choice([110, 111, 112, 113, 119], n, p=[0.5, 0.25, 0.15, 0.05, 0.05]).astype(int) for u, n in enumerate([1, 5, 8, 63, 200, 777])}
    streams[9] = np.full(64, 120)
    w = spark.createDataFrame([(u, i, int(e), 0) for u, s in streams.items() for i, e in enumerate(s)], "unit int, i long, e int, sm int")
    h = codec.histogram(w)
    b = codec.codebook(h)
    c, t = codec.coded(w, b).cache(), codec.unit_totals(h, b).cache()
    stream = codec.bitstream(c, t).orderBy("unit", "byte_idx").collect()
    gap = codec.packed_gaps(codec.padded_gaps(codec.gaps(c, t), t)).orderBy("unit", "byte_idx").collect()
    pos = codec.output_positions(c, t).orderBy("unit", "chunk").collect()
    for u, s in streams.items():
        out = {a: x for a, _, _, x in packed.encode([(s.astype(np.uint16) << 7)])[0]}
        assert bytes(r.b for r in stream if r.unit == u) == out["encoded_exponent"]
        assert bytes(r.b for r in gap if r.unit == u) == out["gaps"]
        assert [r.pos for r in pos if r.unit == u] == np.frombuffer(out["output_positions"], "<u4").tolist()


def test_structure_finds_what_is_broken(spark):
    luts = spark.createDataFrame([(1, t, x, 250 if (t, x) == (0, 9) else 7) for t in range(2) for x in range(256)], "unit int, tbl int, byte int, v int")
    stream = spark.createDataFrame([(1, k, 0) for k in range(10)], "unit int, byte_idx long, b int")
    gaps = spark.createDataFrame([(1, k, 0) for k in range(319)], "unit int, byte_idx long, b int")
    pos = spark.createDataFrame([(1, 0, 1), (1, 1, 40000)], "unit int, chunk long, pos long")
    splits = spark.createDataFrame([(1, 1, 5), (1, 2, 5)], "unit int, tensor_idx long, split long")
    found = {r.rule for r in verify.structure(luts, stream, gaps, pos, splits, spark.createDataFrame([(1, 39)], "unit int, n long")).collect() if r.violations}
    assert found == {"luts_jump", "gaps_bytes", "outpos_first", "outpos_total", "outpos_step", "outpos_bounds", "split_inside"}


def test_sampler():
    units = [(1278, [3, 9]), (1, []), (50, [49]), (0, []), (900, [])]
    for budget in (0, 10, 500, 1500, 9999):
        picks = sampling.plan(units, budget, 42)
        assert len(set(picks)) == len(picks) == max(9, min(budget, 2229)) and picks == sampling.plan(units, budget, 42)
        assert {(0, 0), (0, 1277), (0, 3), (0, 9), (1, 0), (2, 0), (2, 49), (4, 0), (4, 899)} <= set(picks)
    assert sampling.splitmix(0)[0] == 0xE220A8397B1DCDAF


def test_chunk_of_element_takes_the_last_of_equal_starts(spark):
    pos = spark.createDataFrame([(1, 0, 0), (1, 1, 10), (1, 2, 10), (1, 3, 25)], "unit int, chunk long, pos long")
    got = sampling.chunk_of_elements(spark.createDataFrame([(1, i) for i in (0, 9, 10, 24, 25, 99)], "unit int, i long"), pos)
    assert {r.i: r.chunk for r in got.collect()} == {0: 0, 9: 0, 10: 2, 24: 2}


def test_discovery_rules(spark):
    units = spark.createDataFrame([(0, r"m\.\d+", 0, "a", 2), (0, r"m\.\d+", 1, "b", 2), (1, "head", 0, "", 1)], "pi int, pattern string, ai int, attr string, n_attrs int")

    def names(*x):
        return spark.createDataFrame([(n,) for n in x], "name string")

    def error(*x):
        n = names(*x)
        return catalog.first_error(catalog.candidates(n, units), n, units)

    whole = ["m.0.a.weight", "m.0.b.weight", "head.weight", "x.m.0.a.weight", "m.0.c.bias"]
    assert error(*whole) is None
    assert error("q.weight")[0] == "no_units_found"
    assert error(*whole, "m.0.weight") == ("ambiguous_module", ["m.0"])
    assert error(*whole[1:])[0] == "incomplete_unit"
    n = names(*whole)
    found = catalog.candidates(n, units)
    assert [r.name for r in catalog.siblings(found, n).collect()] == ["m.0.c.bias"]
    assert [r.name for r in catalog.passthrough(found, n).collect()] == ["x.m.0.a.weight"]
    assert [r.unit for r in catalog.discovered(catalog.candidates(names("m.10.a.weight", "m.9.a.weight", "head.weight"), units)).orderBy("unit_idx").collect()] == ["m.9", "m.10", "head"]


def test_renames_touch_the_first_match_and_possessives_are_refused(spark):
    n = spark.createDataFrame([("p.aa.a",), ("keep",), ("p.drop",)], "name string")
    got = {r.name: r.visible for r in catalog.apply_rules(n, ["q.", "p."], ["^drop"], [("a", "b")]).collect()}
    assert got == {"p.aa.a": "ba.a", "keep": "keep"}
    assert catalog.java_pattern(r"m\.\d++") == r"m\.\d+"
    with pytest.raises(ValueError, match="possessive"):
        catalog.java_pattern(r"m\.\d++x")
    tied = catalog.tied_alias(spark.createDataFrame([("model.embed_tokens.weight", "model.embed_tokens.weight")], "name string, visible string"), True, True)
    assert {r.visible for r in tied.collect()} == {"model.embed_tokens.weight", "lm_head.weight"}
