import json

import numpy as np
import pytest

from bitloom.operators import packed
from bitloom.plans import api
from bitloom.sources import container
from bitloom.sources.definitions import BadDefinition, Definition, all_definitions, expand, from_toml

TINY = Definition("tiny", "transformers", "0.2.0", [("lm_head", []), (r"model\.layers\.\d+", ["mlp.up_proj", "mlp.down_proj"])])


def bf16(rng, n):
    return (rng.normal(0, 0.02, n).astype(np.float32).view(np.uint32) >> 16).astype("<u2")


@pytest.fixture(scope="module")
def model(tmp_path_factory):
    """Two files with twelve layers, siblings, a norm and a head."""
    rng, folder = np.random.default_rng(7), tmp_path_factory.mktemp("model")
    tensors = [("lm_head.weight", "BF16", [50, 4], bf16(rng, 200).tobytes()), ("model.norm.weight", "F32", [4], np.ones(4, "<f4").tobytes())]
    for k in range(12):
        for a, n in (("mlp.up_proj", 3000 + k), ("mlp.down_proj", 5000 + k)):
            tensors.append((f"model.layers.{k}.{a}.weight", "BF16", [n], bf16(rng, n).tobytes()))
        tensors.append((f"model.layers.{k}.norm.weight", "BF16", [2], bf16(rng, 2).tobytes()))
    container.write_file(str(folder / "a.safetensors"), tensors[:20], {"format": "pt"})
    container.write_file(str(folder / "b.safetensors"), tensors[20:], {})
    (folder / "config.json").write_text(json.dumps({"model_type": "tiny", "hidden": 4, "dfloat11_config": {"old": 1}}))
    (folder / "generation_config.json").write_text("{}")
    return folder


@pytest.fixture(scope="module")
def compressed(spark, model, tmp_path_factory):
    out = tmp_path_factory.mktemp("out") / "c"
    report = api.compress(spark, str(model), TINY, str(out), safe=True, hashes=True).collect()
    return out, report


def test_compress_writes_a_shard_a_unit_and_keeps_the_rest(spark, model, compressed):
    out, report = compressed
    assert {r.file for r in report} == {"model.safetensors", "lm_head.safetensors", *(f"model_layers_{k}.safetensors" for k in range(12))}
    assert 0.6 < report[0].ratio < 0.8
    rows = {r.name: r for r in container.read_tensors(spark, str(out)).collect()}
    source = {r.name: r for r in container.read_tensors(spark, str(model)).collect()}
    assert bytes(rows["model.norm.weight"].bytes) == bytes(source["model.norm.weight"].bytes)
    assert rows["model.layers.3.norm.weight"].file.endswith("model_layers_3.safetensors")
    assert rows["model.norm.weight"].metadata["format"] == "pt"
    config = json.loads((out / "config.json").read_text())
    assert list(config) == ["model_type", "hidden", "dfloat11_config"] and list(config["dfloat11_config"]["pattern_dict"]) == ["lm_head", r"model\.layers\.\d+"]
    assert (out / "generation_config.json").exists() and not list(out.glob(".*part"))


def test_verify_passes_what_compress_wrote(spark, model, compressed):
    out, _ = compressed
    assert api.verify(spark, str(out)).count() == 0
    assert api.verify(spark, str(out), str(model), TINY, "full").count() == 0
    assert api.verify(spark, str(out), str(model), TINY, samples=3, seed=1).count() == 0


def damaged(out, tmp_path, file, suffix, at, keep_hash=False):
    """A copy of the output with one byte of a tensor changed."""
    import shutil

    to = tmp_path / "d"
    shutil.copytree(out, to)
    tensors, meta, start = container.read_header(str(to / file))
    t = next(t for t in tensors if t["name"].endswith(suffix))
    data = bytearray((to / file).read_bytes())
    data[start + t["off_begin"] + at] ^= 0x40
    (to / file).write_bytes(data)
    return to


@pytest.mark.parametrize(("suffix", "at"), [("encoded_exponent", 100), ("sign_mantissa", 9), ("gaps", 0)])
def test_a_changed_byte_is_found_in_the_right_unit(spark, compressed, model, tmp_path, suffix, at):
    to = damaged(compressed[0], tmp_path, "model_layers_5.safetensors", suffix, at)
    found = api.verify(spark, str(to), str(model), TINY, "full").collect()
    assert {r.unit for r in found} == {"model.layers.5"} and "hash" in {r.rule for r in found}


def test_a_missing_unit_is_told(spark, compressed, model, tmp_path):
    import shutil

    to = tmp_path / "d"
    shutil.copytree(compressed[0], to)
    (to / "model_layers_7.safetensors").unlink()
    assert [(r.unit, r.rule) for r in api.verify(spark, str(to), str(model), TINY, "full").collect()] == [("model.layers.7", "absent")]


def test_other_types_and_reserved_exponents_are_refused_before_writing(spark, tmp_path):
    for dtype, data, code in (("F16", np.ones(4, "<f2"), "not_bf16"), ("BF16", np.array([0x3F80, 0x7F80, 0x3F80, 0], "<u2"), "reserved_exponent")):
        folder = tmp_path / dtype
        folder.mkdir()
        container.write_file(str(folder / "m.safetensors"), [("lm_head.weight", dtype, [4], data.tobytes())], {})
        with pytest.raises(api.CompressError) as e:
            api.compress(spark, str(folder), Definition("t", "transformers", "1", [("lm_head", [])]), str(folder / "out"))
        assert e.value.code == code and not (folder / "out").exists()


def test_idx8_and_single_file_layouts(spark, model, tmp_path):
    d = Definition("tiny", "comfyui-native", "0.5.0", TINY.units)
    api.compress(spark, str(model), d, str(tmp_path / "o"), index="idx8", luts="correct")
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == ["generation_config.json", "model.safetensors"]
    names = {r.name for r in container.read_tensors(spark, str(tmp_path / "o"), with_bytes=False).collect()}
    assert "lm_head.idx8_lengths" in names and "model.layers.0.norm.weight" in names
    with pytest.raises(api.CompressError, match="idx8"):
        api.verify(spark, str(tmp_path / "o"))
    with pytest.raises(api.CompressError, match="arguments"):
        api.compress(spark, str(model), d, str(tmp_path / "p"), idx8_block=32)


def test_source_pushes_names_down_and_refuses_bad_headers(spark, model, tmp_path):
    one = container.read_tensors(spark, str(model)).where("name = 'model.norm.weight'")
    assert [r.name for r in one.collect()] == ["model.norm.weight"]
    good = {"dtype": "F32", "shape": [1], "data_offsets": [0, 4]}
    for bad in ({"a": good | {"shape": [-1]}}, {"a": good | {"data_offsets": [4, 0]}}, {"a": good | {"data_offsets": [0, 5]}}, {"a": good | {"shape": [2]}}, {"a": good | {"shape": [1.5]}}, []):
        with pytest.raises(container.Malformed):
            container.parse_header(json.dumps(bad).encode(), 4)
    assert container.parse_header(json.dumps({"a": good | {"dtype": "NEW", "shape": [9]}, "__metadata__": {"x": 1, "y": "z"}}).encode(), 4)[1] == {"y": "z"}
    (tmp_path / "x.safetensors").write_bytes(b"\xff" * 8)
    with pytest.raises(container.Malformed):
        container.read_header(str(tmp_path / "x.safetensors"))


def test_headers_are_padded_and_ordered():
    raw = container.header_bytes([("a", "F32", [1], 4)], {"b": "1", "a": "2"})
    assert len(raw) % 8 == 0
    order = sorted([("b", "BF16", [], b""), ("a", "BF16", [], b""), ("z", "F32", [], b""), ("q", "U8", [], b""), ("i", "I64", [], b"")], key=container.canonical_key)
    assert [t[0] for t in order] == ["i", "z", "a", "b", "q"]
    with pytest.raises(container.Malformed):
        container.canonical_key(("x", "NEW", [], b""))


@pytest.mark.parametrize("n", [1, 2, 7, 300, 5000])
def test_packed_round_trip(n):
    rng = np.random.default_rng(n)
    tensors = [bf16(rng, n), bf16(rng, n + 3)]
    out = {a: b for a, _, _, b in packed.encode(tensors, idx8_block=64)[0]}
    e = packed.decode(np.frombuffer(out["luts"], np.uint8).reshape(-1, 256), out["encoded_exponent"], 2 * n + 3)
    assert np.array_equal(packed.recombined(e, np.frombuffer(out["sign_mantissa"], np.uint8)), np.concatenate(tensors))


def test_block_index_edges():
    x = packed.block_index(np.array([40] * 2100 + [2]), 7)
    assert x["minlen"] == 280 and x["lengths"].tolist()[-1] == 0 if 2101 % 7 == 0 else x["escapes"].tolist() == [[300, 2]]
    y = np.ones(40, int)
    y[14], y[21] = 253 + 6 - 6 + 1, 255
    x = packed.block_index(y, 7)
    assert x["lengths"].tolist()[2:4] == [253, 254]
    with pytest.raises(packed.Refused):
        packed.block_index(np.array([1]), 0)


def test_definitions():
    every = all_definitions()
    assert len(every) == 35 and not any(isinstance(d, BadDefinition) for d in every.values())
    assert expand("a.{b c} d e.<0-1>.(x.{y z} w)") == ["a.b", "a.c", "d", "e.0.x.y", "e.0.x.z", "e.0.w", "e.1.x.y", "e.1.x.z", "e.1.w"]
    text = 'name="n"\nlayout="transformers"\nformat_version="1"\nthreads_per_block=[512]\nbytes_per_thread=8\nsource="s"\n'
    with pytest.raises(BadDefinition, match="no_units"):
        from_toml(text)
    unit = '[[unit]]\npattern="a"\nattrs=["x","x"]\n'
    with pytest.raises(BadDefinition, match="duplicate_attr"):
        from_toml(text + unit)
    with pytest.raises(BadDefinition, match="unknown"):
        from_toml(text + '[keys]\nrnme=[]\n' + unit)
