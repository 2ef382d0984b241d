"""Operators on inline rows: rulebook outcomes, panels, decisions, the refill loop, shards and images."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import rules, scores, text
from corpusmill.functions import vocabulary as v
from corpusmill.operators import balance, decide, images, panels, refill, report
from corpusmill.sources import arrow_shards, payload

EXPECTED = [
    ("Axial CT scan of the chest", "ct", "hits=2", "ct", "hits=11"), ("PET/CT of the liver", "unknown", "no_rule_match", "ct", "hits=9"),
    ("Fused PET/CT image", "unknown", "no_rule_match", v.HYBRID, "forced_hybrid_ct"), ("FDG-PET-CT image of the neck", v.HYBRID, "forced_hybrid_ct", "ct", "hits=9"),
    ("Brain MRI with FLAIR signal", "mrt_hirn", "hits=2", "mrt_hirn", "hits=1"), ("Knee MRI after trauma", "mrt_body", "hits=1", "mrt_body", "hits=1"),
    ("Ultrasound and biopsy of the node", "pathology", "forced_filter:pathology", "pathology", "forced_filter:pathology"), ("Chest X-ray, frontal view", "xray", "hits=1", "xray", "hits=1"),
    ("Portable x-ray film", "xray", "hits=3", "xray", "hits=3"), ("Coronary angiography before stent placement", v.ANGIO, "forced_angiography", v.ANGIO, "forced_angiography"),
    ("MR angiography of the head", v.ANGIO, "forced_angiography", v.ANGIO, "forced_angiography"), ("CT scan compared with ultrasound", "ct", "hits=1", "ct", "hits=10"),
    ("", "unknown", "empty_text", "unknown", "empty_text"), (None, "unknown", "empty_text", "unknown", "empty_text"), ("A plain sentence about nothing", "unknown", "no_rule_match", "unknown", "no_rule_match"),
    ("Schematic workflow of the study", "chart_or_diagram", "forced_filter:chart_or_diagram", "chart_or_diagram", "forced_filter:chart_or_diagram"),
    ("Intraoperative photograph of the wound", "surgery_real", "forced_filter:surgery_real", "surgery_real", "forced_filter:surgery_real"), ("Colonoscopy of the sigmoid", "endoscopy", "forced_filter:endoscopy", "endoscopy", "forced_filter:endoscopy"),
    ("Röntgen image of the hand", "xray", "hits=1", "xray", "hits=1"), ("Contrast-enhanced CT and knee MRI", "mrt_body", "hits=1", "ct", "hits=10"), ("Mouse brain MRI", "mrt_hirn", "hits=1", "unknown", "no_rule_match"),
]


@pytest.mark.parametrize(("book", "at"), [(rules.OVERRIDE, 1), (rules.FUSION, 3)])
def test_rule_outcomes(spark, book, at):
    df = spark.createDataFrame([(i, e[0]) for i, e in enumerate(EXPECTED)], "i int, text string")
    for r in rules.classify(df, "text", book).collect():
        assert r.rule_pred == EXPECTED[r.i][at] and r.rule_reason.endswith(EXPECTED[r.i][at + 1]), EXPECTED[r.i]


def test_repeated_patterns_count_twice(spark):
    df = spark.createDataFrame([("Ultrasound and biopsy of the node",), ("photograph",)], "text string")
    found = [{h.label: h.score for h in r.rule_hits} for r in rules.with_rule_hits(df, "text", rules.OVERRIDE).collect()]
    assert found[0]["pathology"] == 2 and found[1]["surgery_real"] == 2
    assert len([p for ps in rules.OVERRIDE.patterns.values() for p in ps]) == 266


def test_guards_are_in_every_match():
    samples = [e[0].lower() for e in EXPECTED if e[0]] + ["pelvic mri of prostate t2 with dwi and adc", "digital subtraction angiography dsa", "co-registered spect and ct"]
    for book in rules.PROFILES.values():
        for p in (p for ps in book.patterns.values() for p in ps):
            for t in samples:
                assert not re.search(p, t) or rules.required_literal(p) in t
    assert rules.required_literal(r"\bbrain\b.*\bt1\b") == "brain" and rules.required_literal(r"\b[ab]\w*") == ""


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([p.replace("\\b", "").replace("\\w*", "x").replace("\\s+", " ") for ps in rules.FUSION.patterns.values() for p in ps] + ["é", "ct", "-", "/"]), max_size=8))
def test_rulebook_equals_python(spark_once, parts):
    t = " ".join(parts).lower()
    spark_once.append(t)


@pytest.fixture(scope="module")
def spark_once(spark):
    """Texts gathered by the property test, checked together at the end."""
    texts: list[str] = []
    yield texts
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = rules.with_rule_hits(df, "text", rules.FUSION).withColumn("n", text.normalize_for_rules(F.col("text"))).collect()
    for r in rows:
        want = {label: [p for p in ps if re.search(p, r.n)] for label, ps in rules.FUSION.patterns.items()}
        assert {h.label: list(h.patterns) for h in r.rule_hits} == {k: x for k, x in want.items() if x}


def test_normalization_is_idempotent(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([("".join(rng.choices("aB -_/\\\n\r\t\xa0é", k=20)),) for _ in range(200)] + [(None,)], "t string")
    once = df.select(text.normalize_for_rules(F.col("t")).alias("t"))
    assert once.where(text.normalize_for_rules(F.col("t")) != F.col("t")).count() == 0
    assert once.where("t is null").count() == 0


def test_payloads(spark):
    rows = [(b'{"PMC_ID": "P1", "full_caption": "x", "more": 3}',), (b"{broken",), (b"[1]",), (b"",), (None,), (b'  {"modality": null} ',)]
    out = payload.with_payload(spark.createDataFrame(rows, "jsonl binary")).collect()
    assert [r.PMC_ID for r in out] == ["P1", None, None, None, None, None] and out[0].full_caption == "x"


PANELS = "Imaging. (A) Axial CT scan of chest shows nodule. (B) Coronal CT image of the abdomen now."


def test_panels(spark):
    rows = [(0, PANELS, "A"), (1, PANELS, "B A"), (2, PANELS, "x 7 A A"), (3, PANELS, "Z"), (4, PANELS, "C"), (5, "Findings as shown in (A) are typical.", "A"), (6, None, "A")]
    out = {r.i: r for r in panels.narrow_to_panels(spark.createDataFrame(rows, "i int, text string, ocr_text string")).collect()}
    assert out[0].text == "Imaging. Axial CT scan of chest shows nodule." and out[0].ocr_used
    assert out[1].ocr_found_panels == ["B", "A"] and out[1].ocr_selected_texts[0].startswith("Imaging. Coronal")
    assert out[2].ocr_found_panels == ["7", "A"] and len(out[2].ocr_selected_texts) == 1
    assert (out[3].text, out[3].ocr_text, out[3].ocr_used) == (PANELS, "Z", False)
    assert (out[4].text, out[4].ocr_text, out[4].ocr_used) == (PANELS, "", False)
    assert out[5].text == rows[5][1] and out[6].text is None


def test_panel_marks():
    assert panels.split_strict("(A-C) Axial CT images of the chest.")[0].keys() == {"A", "B", "C"}
    assert panels.split_strict("(a, b) Axial CT images of the chest.")[0].keys() == {"A", "B"}
    assert panels.split_strict("(D-A) Axial CT images of the chest.")[0] == {}
    assert panels.split_strict("no marks ") == ({}, "no marks")
    assert panels.split_strict("(T) weighted image of the brain here.")[0] == {}
    assert panels.split_strict("(A) Axial CT scan here. (A) And again with contrast media.")[0]["A"].count("contrast") == 1
    assert panels.split_free("Panel A shows x. Panel B shows y.", "fusion")[0] == {"A": "shows x.", "B": "shows y."}
    assert panels.split_free("see (1) one (2) two", "agreement")[0] == {"1": "one", "2": "two"}


def test_thresholds():
    assert [round(scores.adaptive_threshold(0.58, 0.40, r, 0.02), 3) for r in range(11)] == [0.58, 0.56, 0.54, 0.52, 0.5, 0.48, 0.46, 0.44, 0.42, 0.4, 0.4]
    assert [round(x, 3) for x in refill.compounded(0.82, 0.55, 0.04, 6)] == [0.82, 0.78, 0.7, 0.58, 0.55, 0.55]
    assert [round(x, 3) for x in refill.compounded(0.88, 0.60, 0.035, 6)] == [0.88, 0.845, 0.775, 0.67, 0.6, 0.6]
    assert [round(x, 4) for x in scores.log_weights(v.CNN1_COUNTS, v.CLASSES_FUSION)] == [0.8424, 0.6185, 0.7785, 0.6503, 0.5731, 0.8879, 1.0]
    assert scores.log_weights({}, ["a"]) == [0.0]


def test_score_ties(spark):
    df = spark.createDataFrame([(1, [0.0] * 7), (2, []), (3, None), (4, [0.1, 0.9, 0.9, 0.0, 0.0, 0.0, 0.0])], "i int, v array<double>")
    vec = F.col("v")
    out = {r.i: r for r in df.select("i", scores.top_label(vec, v.CLASSES_OVERRIDE).alias("l"), scores.confidence(vec).alias("c"), scores.margin(vec).alias("m"), scores.top_k(vec, v.CLASSES_OVERRIDE, 2).alias("k")).collect()}
    assert (out[1].l, out[2].l, out[3].l, out[4].l) == ("ct", "none", "none", v.HYBRID)
    assert (out[2].c, out[2].m, out[4].m) == (0.0, 0.0, 0.0)
    assert [x.label for x in out[4].k] == [v.HYBRID, "us"]


def test_uncertain(spark):
    df = spark.createDataFrame([(0.39, 0.2), (0.9, 0.02), (0.9, 0.3)], "c double, m double")
    assert [r[0] for r in df.select(scores.is_uncertain(F.col("c"), F.col("m"))).collect()] == [True, True, False]


def test_agreement_returns_accepted_rows(spark):
    df = spark.createDataFrame([("ct", 0.1, "ct", 0.9, "xray", 0.1), ("us", 0.1, "ct", 0.9, "xray", 0.1), ("ct", 0.99, "ct", 0.3, "xray", 0.3)], "rule_pred string, trash_conf double, cnn1_label string, cnn1_conf double, cnn2_label string, cnn2_conf double")
    out = decide.decide_agreement(df, ["ct"], ["xray"]).collect()
    assert [(r.final_label, r.filter_reason) for r in out] == [("ct", None), ("ct", "rule_cnn_disagreement"), ("unknown", "cnn3_strong")]


def test_balance_is_stable_under_partitioning(spark):
    rows = [(i, f"c{i % 3}", i) for i in range(1000)]
    df = spark.createDataFrame(rows, "row_id long, label string, x int")
    pick = lambda d: sorted(r.row_id for r in balance.top_per_class(d, "label", [balance.stable_hash(F.col("row_id"))], 10).collect())
    assert len(pick(df)) == 30 and pick(df) == pick(df.repartition(7))
    with pytest.raises(ValueError, match="c0"):
        balance.require_balance(df, "label", ["c0", "c1"], 5)


def test_refill(spark, tmp_path):
    rows = spark.createDataFrame([("P", i, v.CLASSES_OVERRIDE[i % 7], 0.3 if i % 2 else 0.9) for i in range(420)], "pmc_id string, row_id long, final_label string, final_conf double")
    start = rows.where("row_id < 7").withColumn("final_margin", F.lit(1.0))

    def score(chunk, threshold):
        return chunk.withColumns({"final_margin": F.lit(1.0), "is_filtered": F.lit(False)})

    config = refill.RefillConfig(per_class=12, chunk=70, max_rounds=10)
    out = refill.refill(rows, start, score, v.CLASSES_OVERRIDE, config, str(tmp_path / "rounds")).collect()
    assert len(out) == 84 and len({r.row_id for r in out}) == 84
    assert {r.row_id for r in start.collect()} <= {r.row_id for r in out}
    assert len(list((tmp_path / "rounds").iterdir())) >= 1
    strict = refill.refill(rows, start, score, v.CLASSES_OVERRIDE, refill.RefillConfig(per_class=40, chunk=70, max_rounds=10, pool_bypass=False)).collect()
    assert all(r.final_conf >= 0.58 or r.row_id < 7 for r in strict)
    assert refill.refill(rows.limit(0), start, score, v.CLASSES_OVERRIDE, config).count() == 7


def test_arrow_shards(spark, tmp_path):
    schema = pa.schema([("__key__", pa.string()), ("__url__", pa.string()), ("jpg", pa.struct([("bytes", pa.binary()), ("path", pa.string())])), ("jsonl", pa.binary())])
    for k in range(3):
        arrow_shards.write_shard(pa.table({"__key__": [f"k{k}{i}" for i in range(5)], "__url__": ["u"] * 5, "jpg": [{"bytes": b"x", "path": None}] * 5, "jsonl": [b"{}"] * 5}, schema=schema), str(tmp_path / f"data-{k}.arrow"))
    arrow_shards.register(spark)
    df = spark.read.format("arrow_shards").load(str(tmp_path))
    assert df.count() == 15 and df.rdd.getNumPartitions() == 3 and df.first().jpg.bytes == b"x"
    assert spark.read.format("arrow_shards").option("columns", "__key__,jsonl").load(str(tmp_path)).columns == ["__key__", "jsonl"]
    with pytest.raises(FileNotFoundError):
        arrow_shards.shard_files(str(tmp_path / "none"))


def test_convolution_and_images(spark, tmp_path):
    rng = np.random.default_rng(0)
    x, w, b = rng.random((1, 2, 5, 6)), rng.random((3, 2, 3, 3)), rng.random(3)
    pad = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    slow = np.array([[[(pad[0, :, i : i + 3, j : j + 3] * w[k]).sum() + b[k] for j in range(6)] for i in range(5)] for k in range(3)])
    assert np.allclose(images.conv3x3(x, w, b)[0], slow)
    assert images.to_tensor(np.full((10, 7, 3), 255, np.uint8)).shape == (3, 224, 224) and np.isclose(images.to_tensor(np.full((10, 7, 3), 255, np.uint8)).max(), 1)
    p = images.forward(rng.random((2, 3, 16, 16)), images.random_weights(4, [4, 8, 8], 6, flat=32), [True, True, True], flatten=True)
    assert p.shape == (2, 4) and np.allclose(p.sum(1), 1)

    def bad(raw):
        raise ValueError

    assert images.decode_first([None, b"x"], bad) is None and images.decode_first([{"bytes": b""}, b"x"], len) == 1
    df = spark.createDataFrame([("P", 1, "ct", None, b"img"), ("P", 2, None, "us", b"img"), ("P", 3, "ct", None, None)], "pmc_id string, row_id long, final_label string, rule_pred string, jpg binary")
    assert images.export_images(df, "jpg", str(tmp_path / "out")) == 2
    assert (tmp_path / "out" / "us" / "P_2.jpg").read_bytes() == b"img"


def test_views(spark):
    df = spark.createDataFrame([(1, "a", [1, 2])], "row_id long, caption string, l array<int>")
    assert {(r.name, r.value) for r in report.details(df, "row_id").collect()} == {("row_id", "1"), ("caption", "a"), ("l", "[1,2]")}
    assert report.as_csv_view(df).first().l == "[1,2]" and report.only_uncertain(df).count() == 1
    with pytest.raises(ValueError, match="no such view"):
        report.dataset("x", {})
    assert report.filter_rates(spark.createDataFrame([(True,)], "is_filtered boolean")).first().of_kept is None


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_neighbours_across_gaps(spark, parts):
    ids = sorted([5, 7, 4000, 90_000, 90_001, *range(200_000, 200_040), 10**9, 10**12])
    got = {r.row_id: (r.prev2, r.prev1, r.next1, r.next2) for r in report.neighbours(spark.createDataFrame([(i,) for i in ids], "row_id long"), parts=parts).collect()}
    far = [None, None, *ids, None, None]
    assert got == {i: (far[k], far[k + 1], far[k + 3], far[k + 4]) for k, i in enumerate(ids)}
    assert report.neighbours(spark.createDataFrame([], "row_id long"), parts=parts).count() == 0


def test_stands_without_the_add_on(tmp_path):
    """The package imports and lists its queries where the llm folders are absent."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parent.parent
    shutil.copytree(repo / "corpusmill", tmp_path / "corpusmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert int(said.stdout) > 60
