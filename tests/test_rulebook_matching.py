"""The rulebook is matched by words: the same hits as every pattern alone, with few patterns tried."""

import random
import re

import pyarrow as pa

from corpusmill.functions import literals, rules
from corpusmill.functions.vocabulary import ANIMAL_PATTERNS
from corpusmill.operators import panels
from corpusmill.plans import catalogue


def test_words_that_matches_must_contain():
    words = literals.required_words
    assert words(r"\bbrain\b.*\bt1\b") == ["brain", "t1"] and words(r"\bprostat\w*\b.*\bmri\b") == ["prostat", "mri"]
    assert words(r"\bx[- ]?ray\b") == [] and words(r"\bpets?\s+(and\s+)?ct\b") == ["pet"] and words(r"\bct\b|\bmr\b") == []


def test_matcher_equals_every_pattern_alone():
    rng = random.Random(5)
    for patterns, flags in [*((tuple(p for ps in b.patterns.values() for p in ps), 0) for b in rules.PROFILES.values()), (tuple(dict.fromkeys(ANIMAL_PATTERNS)), re.I)]:
        parts = [re.sub(r"\\[bw]\*?", "", p).replace(r"\s+", " ").replace(r"\s*", "").replace("[- ]", " ") for p in patterns] + ["é", "ct", "(mri", "brain,t1", "h & e", "_ct", "Σ", "RATS", "x\x1cct"]
        m, tried = literals.matcher(patterns, flags), 0
        for _ in range(400):
            raw = "".join(rng.choice(parts) + rng.choice([" ", " ", ". ", "", "é"]) for _ in range(rng.randrange(9)))
            text = raw if flags else rules.normalized(raw)
            assert list(m.found(text, text.lower())) == [k for k, p in enumerate(patterns) if re.search(p, text, flags)], text
        m = literals.Matcher(patterns, flags)
        for k, test in enumerate(m.tests):
            m.tests[k] = lambda x, test=test: (counted.append(x), test(x))[1]
        counted = []
        list(m.found(plain := "the lesion and the margins of a long report " * 50, plain))
        assert len(counted) <= 1


def test_patterns_are_tried_only_where_all_their_letters_stand():
    patterns = (r"\bpet\s*/\s*ct\b", r"\bpet\s+ct\b", r"\bcta?\b", r"\bctangle\b")
    m, tried = literals.Matcher(patterns), []
    m.tests = [lambda x, k=k, test=test: (tried.append(k), test(x))[1] for k, test in enumerate(m.tests)]
    assert list(m.found("(pet ct) ctas", "(pet ct) ctas")) == [1, 2] and tried == [1, 2]
    assert list(m.found("act, pet/ct", "act, pet/ct")) == [0, 2] and literals.required_literals(r"\bct\b|\bmr\b") == [""]


def test_matcher_keeps_nothing_of_the_texts():
    m = literals.Matcher((r"\bbrain\b.*\bt1\b", r"\bct\b"))
    size = len(repr(vars(m)))
    for k in range(1000):
        assert list(m.found(x := f"invented{k}, brainy{k} (ct)", x)) == [1]
    assert len(repr(vars(m))) == size


def test_animals_are_filtered_after_the_texts_are_dealt_out(spark):
    df = catalogue.QUERIES["early_candidates"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Repartition") and "Filter" not in plan[plan.index("Repartition") :].replace("PushedFilters", "")
    assert plan.count("_any_animal") == 1 or plan.count("ArrowEvalPython") == 2


def test_panels_of_a_batch_of_many_pieces(spark):
    texts = [f"Scans {i}. (A) Axial CT scan of chest shows nodule. (B) Coronal CT image of the abdomen now." for i in range(300)] + [None, ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string").coalesce(1)
    for r in panels.split_panels(df, "text").collect():
        sections, prefix = panels.split_strict(texts[r.i] or "")
        assert r.prefix == prefix and {s.panel: s.text for s in r.sections} == sections
    assert len(list(literals.each_text(pa.array(texts)))) == 302


def test_batches_of_the_splitter_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    panels.split_panels(spark.createDataFrame([("x",)], "text string"), "text")
    assert spark.conf.get(key) == str(4 << 20)
