"""Rules of the scalar functions on hand-made values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediarill.functions import scalars as S


def one(spark, column, **values):
    row = spark.range(1).select(*[v.alias(k) if hasattr(v, "alias") else F.lit(v).alias(k) for k, v in values.items()] or ["id"])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "f, given, want",
    [
        (S.norm_tag, "Blue__Eyes", "blue eyes"), (S.norm_tag, " blue eyes ", "blue eyes"), (S.norm_tag, None, ""),
        (S.name_base, "Oliver (3).jpg", "Oliver"), (S.name_base, "a_(2).png", "a"), (S.name_base, "(4).gif", "(4)"), (S.name_base, "noext", "noext"), (S.name_base, ".hidden", ""),
        (S.natural_key, "Img10 a2.png", "img0000000010 a0000000002.png"), (S.natural_key, "x12345678901", "x12345678901"), (S.natural_key, "1234567890z", "1234567890z"), (S.natural_key, "0001", "0000000001"),
        (S.clean_search_text, "A (masterpiece:1.2), 4k_art 12", "a masterpiece 4k art"), (S.media_type, "a/b.MP4", "video"), (S.media_type, "x.gif", "gif"), (S.media_type, "x", "image"),
        (S.safe_filename, "C:\\x\\..\\a<b>.jpg ", "ab.jpg"), (S.safe_filename, " .. ", "dropped"), (S.iso_compact_date, "20240131", "2024:01:31"), (S.iso_compact_date, "2024", "2024"),
        (S.path_leaf, "a\\b/c", "c"), (S.path_parent, "a/b/c", "a/b"), (S.path_ancestors, "a/b\\c", ["a", "a/b", "a/b/c"]), (S.path_ancestors, None, []),
        (S.split_keywords, "a; b,A , ," + "x" * 101, ["a", "b"]), (S.split_keywords, None, []),
    ],
)
def test_texts(spark, f, given, want):
    assert one(spark, f(F.lit(given).cast("string"))) == want


def test_keywords_merge(spark):
    assert one(spark, S.merge_keywords(F.lit("Cat, dog"), F.lit("DOG; bird"))) == "Cat, dog, bird"


@pytest.mark.parametrize("d, want", [(0, 100), (1, 99), (3, 98), (13, 94), (128, 50), (256, 0)])
def test_hamming_pct(spark, d, want):
    assert one(spark, S.hamming_pct(F.lit(d))) == want


def test_hex_and_hamming(spark):
    assert one(spark, S.pack_hex(F.lit("ff"), 64)) == [0, 255]
    assert one(spark, S.pack_hex(F.lit("xyz"), 64)) is None
    assert one(spark, S.hamming(S.pack_hex(F.lit("ff"), 64), S.pack_hex(F.lit("f0"), 64))) == 4


def test_infotext(spark):
    text = 'a cat, <b>\nNegative prompt: ugly\nSteps: 20, Sampler: "Euler, a", Size: 512x768, Hires upscale: 2, Odd Key: 1, Odd key: 2, Seed: 1, Seed: 2'
    got = one(spark, S.parse_infotext(F.lit(text)))
    assert got == {"prompt": "a cat, <b>", "negative_prompt": "ugly", "steps": "20", "sampler": "Euler, a", "size": "512x768", "hires_upscale": "2", "odd_key": "1", "seed": "2", "hires_size": "1024x1536"}
    assert one(spark, S.parse_infotext(F.lit("a dog, Steps: 5"))) == {"prompt": "a dog", "steps": "5"}
    assert one(spark, S.parse_infotext(F.lit("only words"))) == {"prompt": "only words"}
    assert one(spark, S.parse_infotext(F.lit(None).cast("string"))) == {}


def test_node_graph(spark):
    graph = (
        '{"1": {"class_type": "ImpactWildcardProcessor", "inputs": {"populated_text": "a fox"}}, "2": {"class_type": "CLIPTextEncode", "inputs": {"text": ["1", 0]}},'
        ' "3": {"class_type": "UNETLoader", "inputs": {"unet_name": "sd\\\\m.safetensors"}}, "4": {"class_type": "LoraLoader", "inputs": {"lora_name": "l.pt", "strength_model": 0.8, "strength_clip": 1.0}}}'
    )
    got = one(spark, S.parse_node_graph(F.lit(graph)))
    assert (got["prompt"], got["models"], got["loras"]) == ("a fox", "m", "l (model 0.8, clip 1)")
    assert one(spark, S.parse_node_graph(F.lit("no json")))["prompt"] is None


def test_gps_keys_maps(spark):
    deg = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, S.gps_decimal(deg(10, 30, 0), F.lit("S"), deg(20, 15, 36), F.lit("E"))) == "-10.500000, 20.260000"
    meta = F.create_map(F.lit("IFD0:CameraModel"), F.lit("X"), F.lit("File:Size"), F.lit("1"), F.lit("XMP:CameraModel"), F.lit("Y"))
    assert one(spark, S.normalize_keys(meta)) == {"camera_model": "X"}
    assert one(spark, S.search_document(F.create_map(F.lit("b"), F.lit("Two"), F.lit("a"), F.lit("One"), F.lit("error"), F.lit("no")))) == "one two"


def test_signatures(spark):
    rng = np.random.default_rng(1)
    px = rng.normal(size=(8, 8))
    col = F.array(*[F.lit(float(x)) for x in px.reshape(-1)])
    k, i = np.arange(8)[:, None], np.arange(8)[None]
    m = 2 * np.cos(np.pi * k * (2 * i + 1) / 16)
    bits = lambda a: [int("".join("1" if x > np.median(a) else "0" for x in a.reshape(-1)[w : w + 32]), 2) for w in (0, 32)]
    assert one(spark, S.vector_signature(col)) == bits(px)
    assert one(spark, S.dct_signature(col)) == bits(m @ px @ m.T)
    cells = px.reshape(4, 2, 4, 2).mean((1, 3)) - px.mean()
    assert one(spark, S.tile_signature(col)) == np.rint(cells / cells.std() * 64).astype(int).reshape(-1).tolist()
    assert one(spark, S.score_to_probability(F.array(F.lit(-1.0), F.lit(0.5))))[0] == pytest.approx(1 / (1 + math.e))


def test_larger_pictures(spark):
    from mediarill.functions.luma import dct_signatures

    px = np.random.default_rng(2).normal(size=64).tolist()
    df = spark.createDataFrame([(1, px), (2, None), (3, [1.0])], "id long, px array<double>")
    got = {r["id"]: r["words"] for r in dct_signatures(df, 8, 8).collect()}
    want = df.where("id = 1").select(S.dct_signature(F.col("px")).alias("w")).first()["w"]
    assert got == {1: want, 2: None, 3: None}
    assert len(dct_signatures(spark.createDataFrame([(1, [0.5] * 4095 + [1.0])], "id long, px array<double>")).first()["words"]) == 8
