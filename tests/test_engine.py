"""The engine from shards to CSV, and the operators around it."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill import __main__, engine
from corpusmill.functions import scores, text
from corpusmill.functions import vocabulary as v
from corpusmill.operators import balance, images, ocr, records, report, zero_shot
from corpusmill.sources import arrow_shards, numbering, results

CAPTIONS = {"ct": "Axial CT scan of the chest", "us": "Ultrasound of the node", "mrt_hirn": "Brain MRI with FLAIR signal", "xray": "Chest X-ray, frontal view"}


@pytest.fixture(scope="module")
def shards(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shards")
    names = list(CAPTIONS)
    for k in range(3):
        rows = []
        for i in range(40 * k, 40 * k + 40):
            caption = CAPTIONS[names[i % 4]] + (" of a mouse" if i % 10 == 9 else "") + (', "quoted",\nnext line' if i % 8 == 0 else "")
            rows.append({"PMC_ID": f"PMC{i}", "full_caption": caption, "modality": "R"} if i % 20 != 19 else {"PMC_ID": f"PMC{i}"})
        table = pa.table({"__key__": [f"k{40 * k + i}" for i in range(40)], "jsonl": [json.dumps(r).encode() for r in rows], "jpg": [b"x%d" % i for i in range(40)]})
        arrow_shards.write_shard(table, str(folder / f"data-{k:05d}.arrow"))
    return str(folder)


def test_rows_are_numbered(spark, shards):
    got = engine.load(spark, shards).select("__key__", "row_id").collect()
    assert {r["__key__"]: r.row_id for r in got} == {f"k{i}": i for i in range(120)}
    assert numbering.numbered(spark.range(0)).count() == 0


@pytest.mark.parametrize("profile", ["override", "agreement", "fusion"])
def test_run_from_shards_to_csv(spark, shards, tmp_path, profile):
    def models(df):
        right = F.col("rule_pred")
        vec = scores.one_hot(right, v.CLASSES_FUSION)
        pairs = F.map_from_arrays(F.array(right), F.array(F.lit(0.9)))
        return df.withColumns({"trash_conf": F.when(F.col("row_id") % 7 == 0, 0.99).otherwise(0.1), "cnn1_label": right, "cnn1_conf": F.lit(0.9), "cnn2_label": right, "cnn2_conf": F.lit(0.9), "bert_scores": vec, "cnn1_scores": pairs, "cnn2_scores": pairs})

    config = engine.EngineConfig(output=str(tmp_path / "out"), profile=profile, per_class=6, early_presample=40, refill_presample=50, max_rounds=5, first=("ct", "us"), second=("xray", "mrt_hirn"))
    result = engine.run(engine.load(spark, shards, "__key__,jsonl,jpg"), config, models, image="jpg")
    rows = result.final.collect()
    count = {}
    for r in rows:
        i = int(r.row_id)
        name = list(CAPTIONS)[i % 4]
        assert r.final_label == name and i % 10 != 9 and r.caption.startswith(CAPTIONS[name]) and r.pmc_id == f"PMC{i}"
        assert ("quoted" in r.caption) == (i % 8 == 0)
        count[name] = count.get(name, 0) + 1
    assert len({r.row_id for r in rows}) == len(rows)
    assert count == dict.fromkeys(CAPTIONS, 6)
    assert [r.final_label for r in rows] == sorted((r.final_label for r in rows), key=v.CLASSES_OVERRIDE.index if profile == "override" else v.CLASSES_FUSION.index)
    assert len(list((tmp_path / "out" / "images").rglob("*.jpg"))) == 24
    assert {r.value: r.n for r in result.report["final_label"].collect()} == count
    early = results.read_results(spark, str(tmp_path / "out" / "early_rules"))
    assert 0 < early.count() <= 24 and {"matched", "rule_reason"} <= set(early.columns)
    assert result.report["filters"].first()["total"] == early.count()
    spark.read.option("header", "true").csv(str(tmp_path / "out" / "disagreements")).count()


def test_inspection_only(spark, shards, tmp_path):
    result = engine.run(engine.load(spark, shards), engine.EngineConfig(output=str(tmp_path / "none"), inspect_only=True))
    peek = {r.name: r for r in result.report["schema"].collect()}
    assert peek["jsonl"].type == "binary" and "PMC_ID" in peek["jsonl"].json_keys and peek["jsonl"].preview.startswith("{")
    assert not (tmp_path / "none").exists() and result.final is None


def test_arguments():
    a = __main__.arguments(["--dataset_root", "/in", "--output", "/out", "--per_class", "7", "--first", "ct,us"])
    assert (a.per_class, a.first, a.early_presample, a.cnn_thresh, a.profile) == (7, ("ct", "us"), 14500, 0.82, "override")


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'a "b", c\nd', {"x": 1.5}, [1, 2], b"\x00"), (2, "", None, None, None), (3, None, {}, [], None)]
    d = spark.createDataFrame(rows, "row_id int, caption string, m map<string,double>, a array<int>, raw binary")
    results.write_results(d, str(tmp_path / "r"))
    got = {r.row_id: r for r in results.read_results(spark, str(tmp_path / "r")).collect()}
    assert got["1"].caption == 'a "b", c\nd' and got["1"].m == '{"x":1.5}' and got["1"].a == "[1,2]" and "raw" not in got["1"].asDict()
    assert got["2"].pred_label == got["3"].pred_label == "unknown" and got["1"].pred_label is None


def test_early_sample_stops_as_a_scan_would(spark):
    rows = [(i, ["a", "b", "c"][i * i % 3], i % 4 > 0) for i in range(200)]
    d = spark.createDataFrame(rows, "i int, label string, fine boolean")
    for k, limit, presample in [(5, None, None), (5, 30, None), (50, None, 40), (50, None, 41), (3, None, 150), (50, 60, 50), (50, None, 1000), (5, 0, None)]:
        want, count = [], {}
        for seen, (i, label, fine) in enumerate(rows[: limit if limit is not None else len(rows)], 1):
            if not fine or label == "c" or count.get(label, 0) >= k:
                continue
            count[label] = count.get(label, 0) + 1
            want.append(i)
            if presample and seen >= presample:
                break
        got = balance.early_sample(d, "label", [F.col("i")], k, ["a", "b"], F.col("fine"), limit, presample)
        assert sorted(r.i for r in got.collect()) == want, (k, limit, presample)


def test_images_that_break_are_counted(spark):
    d = spark.createDataFrame([(1, b"\x01" * 48), (2, b"bad"), (3, None), (4, b"\x07" * 48), (5, b"\x02" * 32)], "i int, jpg binary")

    def decode(raw):
        return np.frombuffer(raw, np.uint8).reshape(4, 4, -1)  # two channels are too few for the network

    out = {r.i: r for r in images.score_images(d, ["jpg"], decode, images.random_weights(2, [2], 4), [False], side=8, error="error").collect()}
    assert len(out[1].scores) == len(out[4].scores) == 2 and out[1].error is None
    assert out[2].scores == out[3].scores == [] and out[2].error is None  # nothing to score
    assert out[5].scores == [] and out[5].error


def test_image_folder(spark, tmp_path):
    for name in ("a/x.JPG", "b/x.JPG", "b/y.png", "z.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    got = {r.name: r.path for r in images.file_index(images.image_files(spark, str(tmp_path))).collect()}
    assert set(got) == {"x.JPG", "y.png"} and got["x.JPG"].endswith("b/x.JPG")


def test_ocr_stage(spark):
    def read(raw):
        if raw == b"bad":
            raise ValueError
        return [([[0, 0], [1, 1]], "A", 0.9), ([[0, 0], [1, 1]], "(b)", 0.5)]

    d = spark.createDataFrame([(1, b"good"), (2, b"bad"), (3, None)], "i int, jpg binary")
    out = {r.i: r for r in ocr.with_ocr(d, "jpg", read).select("*", text.ocr_word_panels(F.col("ocr_text")).alias("p")).collect()}
    assert out[1].ocr_text == "A (b)" and out[1].p == ["A", "B"] and out[1].ocr_meta[1].conf == 0.5
    assert out[2].ocr_text == out[3].ocr_text == "" and out[2].ocr_meta == [] and out[3].p == []


def test_zero_shot_with_an_encoder(spark):
    words = sorted({w for t in v.CLASS_TEXTS.values() for w in t.lower().replace(",", " ").split()})
    place = {w: k for k, w in enumerate(words)}

    def encode(texts):
        out = np.zeros((len(texts), len(words)))
        for k, t in enumerate(texts):
            for w in t.lower().replace(",", " ").split():
                if w in place:
                    out[k, place[w]] += 1
        return out

    d = spark.createDataFrame([(1, "doppler ultrasound sonography echography"), (2, "zzz"), (3, None)], "i int, text string")
    out = {r.i: r for r in zero_shot.zero_shot(zero_shot.with_vectors(d, "text", encode), "vector", zero_shot.class_vectors(encode)).collect()}
    assert out[1].text_pred == "us" and out[1].text_top2[0].label == "us" and len(v.CLASS_TEXTS) == 13
    assert out[2].text_pred == out[3].text_pred == "unknown"


def test_evidence_has_defaults(spark):
    r = records.with_evidence(spark.createDataFrame([("c", None, "x")], "caption string, modality_gt string, cnn_pred string")).first()
    assert (r.modality_gt, r.cnn_pred, r.ocr_used, r.ocr_selected_texts, r.ocr_selected_panel_count, r.full_caption) == ("unknown", "x", False, [], 0, "c")


def test_linear_head_and_top_values(spark):
    d = spark.createDataFrame([([1.0, 2.0],), ([0.0, -1.0],)], "x array<double>")
    weights, bias = [[0.5, 1.0], [-1.0, 2.0]], [0.1, 0.0]
    for r in d.select("x", scores.linear_head(F.col("x"), weights, bias).alias("p")).collect():
        z = np.exp(np.array(weights) @ np.array(r.x) + bias)
        assert np.allclose(r.p, z / z.sum())
    few = report.top_values(spark.createDataFrame([(x,) for x in "aabbbc"], "x string"), "x", 2).collect()
    assert [(r.value, r.n) for r in few] == [("b", 3), ("a", 2)]
