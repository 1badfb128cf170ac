import numpy as np
import pytest

from bitloom.operators import support


def test_memory_facts():
    assert support.mem_available("MemFree: 1 kB\nMemAvailable:   20 kB\nSwapFree: 9 kB") == 20480 and support.mem_available("x") is None
    assert support.group_headroom("100", "30") == 70 and support.group_headroom("10", "30") == 0
    assert support.group_headroom("max", "1") is None and support.group_headroom(str(1 << 62), "1") is None and support.group_headroom("5", None) == 5


def test_configs():
    source = {"torch_dtype": "bfloat16", "rope_theta": 1e6, "rope_scaling": None, "num_hidden_layers": 2, "a": 1}
    full = support.config_full(source, {"v": 1}, "k", "5.0")
    assert full == {"num_hidden_layers": 2, "a": 1, "dtype": "bfloat16", "rope_parameters": {"rope_theta": 1e6, "rope_type": "default"}, "layer_types": ["full_attention"] * 2, "pad_token_id": None, "transformers_version": "5.0", "k": {"v": 1}}
    assert support.config_minimal(source, {"v": 1}, "k") == source | {"k": {"v": 1}}
    assert support.config_text({"b": 1, "a": 2}) == '{\n  "a": 2,\n  "b": 1\n}\n'
    with pytest.raises(NotImplementedError):
        support.config_full(source | {"sliding_window": 4, "use_sliding_window": True}, {}, "k", "5")


def test_first_difference():
    assert support.first_difference(b"abc", b"abc") is None
    d = support.first_difference(b"abcdef", b"abXdef", around=2)
    assert d["byte"] == 2 and d["bit"] == 16 and d["ours"] == b"abcd".hex()
    assert support.first_difference(b"ab", b"abc")["byte"] == 2


def test_instances_and_stand_ins():
    assert support.instances(r"a\.\d+\.[xy]") == ["a.0.x", "a.0.y", "a.1.x", "a.1.y"]
    assert support.instances(r"(?:up|down)\d++") == ["up0", "up1", "down0", "down1"]
    assert np.array_equal(support.stand_in("n", 5), support.stand_in("n", 5)) and not np.array_equal(support.stand_in("n", 5), support.stand_in("m", 5))


def test_repacking_truncating_and_manifests(spark):
    rows = [("f", f"model.layers.{k}.w.weight", "BF16", [2, 2], bytes(8)) for k in range(4)] + [("f", "lm_head.weight", "BF16", [4, 2], bytes(range(16))), ("f", "u.gaps", "U8", [1], b"x")]
    t = spark.createDataFrame(rows, "file string, name string, dtype string, shape array<long>, bytes binary")
    r = support.repacked(t, 2).collect()
    assert [x.file for x in sorted(r, key=lambda x: x.name)] == ["part-000.safetensors", "part-001.safetensors"] * 3
    small = {x.name: x for x in support.truncated(t, 2, 3).collect()}
    assert set(small) == {"model.layers.0.w.weight", "model.layers.1.w.weight", "lm_head.weight", "u.gaps"}
    assert small["lm_head.weight"].shape == [3, 2] and bytes(small["lm_head.weight"].bytes) == bytes(range(12))
    m = support.manifest_totals(support.manifest(t), ["gaps"]).first()
    assert (m.unit_tensors, m.others, m.total_bytes) == (1, 5, 49)
