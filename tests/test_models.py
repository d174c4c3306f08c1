"""Model-folder validation and the JSON readers, on generated folders."""

import json
import struct

from tuneframe import sinks
from tuneframe.operators.models import build_manifests, validate_model_dirs
from tuneframe.sources import files as S

GOOD_CFG = {"model_type": "llama", "architectures": ["LlamaForCausalLM"]}
T = {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}


def st(header, data=b"\0" * 8):
    h = json.dumps(header).encode()
    return struct.pack("<Q", len(h)) + h + data


def build(root, name, files):
    d = root / name
    for rel, body in files.items():
        p = d / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body if isinstance(body, bytes) else (body if isinstance(body, str) else json.dumps(body)).encode())


def test_validate_model_dirs_error_priority(spark, tmp_path):
    base = {"config.json": GOOD_CFG, "tokenizer.json": {}, "model.safetensors": st({"w": T})}
    cases = {
        "m01_good": (base, None),
        "m02_noconfig": ({"tokenizer.json": {}, "model.safetensors": st({"w": T})}, "no_config"),
        "m03_badconfig": (dict(base, **{"config.json": "{nope"}), "config_invalid"),
        "m04_notype": (dict(base, **{"config.json": {"architectures": []}}), "no_model_type"),
        "m05_notcausal": (dict(base, **{"config.json": {"model_type": "bert", "architectures": ["BertModel"]}}),
                          "not_causal_lm"),
        "m06_noweights": ({"config.json": GOOD_CFG, "tokenizer.json": {}}, "no_weights"),
        "m07_notok": ({"config.json": GOOD_CFG, "model.safetensors": st({"w": T})}, "no_tokenizer"),
        "m08_bpe": ({"config.json": GOOD_CFG, "vocab.json": {}, "merges.txt": "a b", "w.bin": b"PK\x03\x04x"}, None),
        "m09_tokbad": (dict(base, **{"tokenizer.json": [1]}), "tokenizer_invalid"),
        "m10_emptyindex": (dict(base, **{"model.safetensors.index.json": {"weight_map": {}}}), "index_invalid"),
        "m11_unsafeindex": (dict(base, **{"model.safetensors.index.json": {"weight_map": {"w": "../x"}}}),
                            "index_invalid"),
        "m12_missing": (dict(base, **{"model.safetensors.index.json":
                                      {"weight_map": {"a": "model.safetensors", "b": "s2.safetensors",
                                                      "c": "s1.safetensors"}}}), "missing_shards"),
        "m13_badheader": (dict(base, **{"model.safetensors": st({"w": dict(T, data_offsets=[0, 99])})}),
                          "weight_invalid"),
        "m14_badmagic": ({"config.json": GOOD_CFG, "tokenizer.json": {}, "w.bin": b"nope"}, "weight_invalid"),
        "m16_nan": (dict(base, **{"config.json": '{"model_type": "llama", "x": NaN, "y": 1, "y": 2}'}), None),
        "m17_upper": (dict({k: v for k, v in base.items() if k != "tokenizer.json"}, **{"Tokenizer.JSON": [1]}),
                      "tokenizer_invalid"),
        "m18_confcase": ({("Config.json" if k == "config.json" else k): v for k, v in base.items()}, "no_config"),
        "m19 space%20x": (base, None),
        "m15_nested": ({"sub/config.json": GOOD_CFG, "sub/tokenizer.json": {}, "sub/model.safetensors": st({"w": T}),
                        "outside.bin": b"bad!"}, None),
    }
    for name, (files, _) in cases.items():
        build(tmp_path, name, files)
    rows = {r.upload_id: r for r in validate_model_dirs(spark, str(tmp_path)).collect()}
    assert {k: rows[k].error for k in cases} == {k: v[1] for k, v in cases.items()}
    assert rows["m12_missing"].detail == "s1.safetensors, s2.safetensors"
    assert rows["m13_badheader"].detail == "model.safetensors"
    good = rows["m01_good"]
    assert (good.model_type, good.weight_file_count, good.tokenizer_files, good.sharded) == ("llama", 1, "tokenizer.json", False)
    assert rows["m08_bpe"].tokenizer_files == ""
    assert rows["m15_nested"].weight_file_count == 1


def test_manifests_roundtrip_and_assets(spark, tmp_path):
    manifests = spark.createDataFrame(
        [("u1", "upload", None, 3, ["a", "b"], "llama", ["LlamaForCausalLM"], 1, ["tokenizer.json"], False),
         ("u2", "hub", "org/m", 2, ["c"], "gpt2", [], 2, [], True)],
        "upload_id string, source string, repo_id string, file_count bigint, files array<string>, model_type string, "
        "architectures array<string>, weight_file_count bigint, tokenizer_files array<string>, sharded boolean")
    out = str(tmp_path / "manifests")
    sinks.write_manifests(manifests, out)
    back = spark.read.json(out)
    assert {(r.upload_id, r.source, tuple(r.files)) for r in back.collect()} == {("u1", "upload", ("a", "b")),
                                                                                ("u2", "hub", ("c",))}
    models = tmp_path / "models"
    build(models, "u1", {"upload-manifest.json": json.dumps({"upload_id": "u1", "files": ["a"], "sharded": False},
                                                             indent=2),
                         "deep/config.json": GOOD_CFG, "config.json": GOOD_CFG, "x/tokenizer.json": "[]"})
    build(models, "u2", {"config.json": "{broken"})
    got = S.read_manifests(spark, str(models)).collect()
    assert [(r.upload_id, r.files) for r in got] == [("u1", ["a"])]
    assets = S.read_json_assets(spark, str(models))
    roots = {r.upload_id: r.config_path.rsplit("/models/", 1)[1] for r in S.model_roots(assets).collect()}
    assert roots == {"u1": "u1/config.json", "u2": "u2/config.json"}
    kinds = {(r.upload_id, r.asset, r.is_object) for r in assets.collect()}
    assert ("u1", "tokenizer", False) in kinds and ("u2", "config", False) in kinds
    listing = {r.rel_path for r in S.list_artifacts(spark, str(models)).collect()}
    assert "u1/deep/config.json" in listing and "u2/config.json" in listing


def test_repo_listing_filter_from_files(spark, tmp_path):
    from tuneframe.operators.validation import filter_listing
    listings = {
        "ok.json": [{"type": "file", "path": "config.json"}, {"type": "directory", "path": "sub"},
                    {"type": "file", "path": ".git/HEAD"}, {"type": "file", "path": 5}, {"type": "file"}],
        "empty.json": [{"type": "directory", "path": "x"}, {"type": "file", "path": ".git/config"}],
        "many.json": [{"type": "file", "path": f"w{i}.bin"} for i in range(4001)],
    }
    for name, body in listings.items():
        (tmp_path / name).write_text(json.dumps(body))
    entries = S.read_repo_listings(spark, str(tmp_path))
    got = {r.listing.rsplit("/", 1)[1]: (r.files, r.status) for r in filter_listing(entries, "listing").collect()}
    assert got == {"ok.json": (1, "ok"), "empty.json": (0, "empty"), "many.json": (4001, "too_many")}


def test_pair_request_lists(spark):
    from tuneframe.operators.artifacts import pair_request_lists
    df = spark.createDataFrame([(1, ["a", "b"], ["x/a", "x/b"]), (2, ["a"], ["x", "y"]), (3, [], [])],
                               "req int, files array<string>, paths array<string>")
    got = sorted((r.req, r.ordinal, r.file, r.path, r.problem) for r in pair_request_lists(df).collect())
    assert got == [(1, 1, "a", "x/a", None), (1, 2, "b", "x/b", None), (2, None, None, None, "length_mismatch"),
                   (3, None, None, None, "count_out_of_range")]


def test_manifests_of_uploaded_folders(spark, tmp_path):
    models = tmp_path / "models"
    good = {"config.json": {"model_type": "gpt2", "architectures": "GPT2LMHeadModel"}, "sub/tokenizer.json": {},
            "model.safetensors": st({"w": T})}
    build(models, "u1", good)
    build(models, "u2", {"config.json": {"model_type": "x"}, "sub/tokenizer.json": {}})
    rows = build_manifests(spark, str(models))
    got = {r.upload_id: r for r in rows.collect()}
    one = got["u1"]
    size = sum(f.stat().st_size for f in (models / "u1").rglob("*") if f.is_file())
    assert (one.error, one.file_count, one.size_bytes, one.files) == (
        None, 3, size, ["config.json", "model.safetensors", "sub/tokenizer.json"])
    assert (one.model_path, one.model_type, one.architectures) == (f"{models}/u1", "gpt2", ["GPT2LMHeadModel"])
    assert (one.weight_file_count, one.tokenizer_files, one.sharded) == (1, ["tokenizer.json"], False)
    assert (got["u2"].error, got["u2"].file_count, got["u2"].architectures) == ("no_weights", 2, [])
    sinks.write_manifests(rows.where("error IS NULL").drop("error"), str(tmp_path / "out"))
    assert [r.upload_id for r in spark.read.json(str(tmp_path / "out")).collect()] == ["u1"]
