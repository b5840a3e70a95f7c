"""Problems 5 to 8."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scrivane.llm import encode, mix, residue, sample

RANKS = encode.read_ranks()
ENCODER = encode.Encoder(RANKS)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@given(st.text(max_size=120))
@settings(max_examples=300, deadline=None)
def test_encoding_round_trip(text):
    assert encode.decode(ENCODER.encode(text), encode.by_id(RANKS)) == text


@pytest.mark.parametrize("text", ["", "  \n\t ", "<|endoftext|>", "naïve 日本語 🎉", "a" * 5000, "aaab" * 3000, "don't we'll  x", " " * 3000, "Üß" * 500])
def test_encoding_equals_the_public_library(reference, text):
    assert ENCODER.encode(text) == reference.encode_ordinary(text)


def test_encoded_table(spark, reference):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "hello world", "z"), (3, "hello world", "z"), (3, "hello world", "z")], "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, list(r.ids)) for r in encode.encoded(df).collect()), key=str)
    hello = reference.encode_ordinary("hello world")
    assert got == sorted([(1, []), (2, []), (None, hello), (3, hello), (3, hello)], key=str)
    assert encode.encoded(df.where("false")).collect() == []


TARGET = "target_name string, category string, target_share double, min_records int"


def test_sample_quotas_minimums_and_exhaustion(spark):
    rows = [(k, (" big", "Mid", "small ")[0 if k < 600 else 1 if k < 900 else 2]) for k in range(910)] + [(5, " big")] * 3 + [(None, "big"), (2000, None), (2001, "  ")]
    df = spark.createDataFrame([(i, c, 1, "x", 2) for i, c in rows], "id long, category string, priority int, cell string, take int")
    targets = spark.createDataFrame([("t", "BIG", 0.5, None), ("t", "mid", 0.4, 100), ("t", "SMALL", 0.1, 50), ("t", "GONE", 0.0, 5)], TARGET)
    drawn, report = sample.draw(df, targets)
    got = Counter(r.category for r in drawn.collect())
    assert got == {"BIG": 91, "MID": 100, "SMALL": 10} and drawn.count() == drawn.distinct().count()
    rep = {r.category: (r.available, r.wanted, r.quota, r.status) for r in report.collect()}
    assert rep == {"BIG": (600, 91, 91, "met"), "MID": (300, 100, 100, "met"), "SMALL": (10, 50, 10, "exhausted"), "GONE": (0, 5, 0, "missing")}
    again = {tuple(r) for r in sample.draw(df.repartition(7), targets)[0].collect()}
    assert again == {tuple(r) for r in drawn.collect()}


def test_sample_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id long, category string")
    targets = spark.createDataFrame([("t", "BIG", 1.0, None)], TARGET)
    drawn, report = sample.draw(df, targets)
    assert drawn.collect() == [] and report.first().status == "missing"


DOCS = "doc_id long, text string, source string, n_tokens int, block string, shard int, take int"


def test_mix_reaches_weights_within_the_caps(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(20, 60))), ["hot", "hot", "hot", " cold "][k % 4] if k % 50 else "tiny", 1, "b", 2, 3) for k in range(3000)]
    rows += [(9001, None, "hot", 1, "b", 2, 3), (9002, "", "hot", 1, "b", 2, 3), (None, "x", "hot", 1, "b", 2, 3), (9003, "x", None, 1, "b", 2, 3), rows[0], rows[0]]
    targets = spark.createDataFrame([("m", "hot", 0.5, 1), ("m", "cold", 0.3, 2), ("m", "tiny", 0.1, 3), ("m", "absent", 0.1, 9), ("n", "cold", 1.0, None)], "mix_name string, source string, target_weight double, max_repeats int")
    out, report = mix.mixed(spark.createDataFrame(rows, DOCS), targets)
    rep = {(r.mix_name, r.source): r for r in report.collect()}
    live = {"hot": 0.5 / 0.9, "cold": 0.3 / 0.9, "tiny": 0.1 / 0.9}
    for source, weight in live.items():
        assert abs(rep["m", source].actual_share - weight) < 0.01
    assert rep["m", "absent"].tokens == 0 and rep["n", "cold"].actual_share == 1.0
    uses = Counter((r.mix_name, r.source, r.doc_id) for r in out.collect())
    caps = {("m", "hot"): 1, ("m", "cold"): 2, ("m", "tiny"): 3, ("n", "cold"): 1}
    assert all(n <= caps[k[:2]] for k, n in uses.items())
    shard = Counter(r.shard for r in out.where("mix_name = 'm'").collect())
    assert len(shard) == mix.SHARDS and max(shard.values()) < 3 * min(shard.values())
    places = out.where("mix_name = 'm' and shard = 3").orderBy("position").collect()
    assert [r.position for r in places] == list(range(1, len(places) + 1))


def test_mix_of_an_empty_table(spark):
    targets = spark.createDataFrame([("m", "hot", 1.0, 1)], "mix_name string, source string, target_weight double, max_repeats int")
    out, report = mix.mixed(spark.createDataFrame([], DOCS), targets)
    assert out.collect() == [] and report.first().actual_share == 0.0


@given(st.lists(st.integers(0, 40), min_size=1, max_size=5), st.integers(1, 9))
@settings(max_examples=100, deadline=None)
def test_splitting_tree_is_exact(quota, shards):
    parts = mix.split_tree(np.array(quota), shards, np.random.default_rng(1))
    assert len(parts) == shards and sum(parts).tolist() == quota and all((p >= 0).all() for p in parts)
    sizes = [int(p.sum()) for p in parts]
    assert max(sizes) - min(sizes) <= max(2, shards)


REAL = "I've known this colleague for 9 years and can speak for their records, deliveries and vehicles. Experience with market research or similar is welcome."


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (REAL + " Dear {{ first_name }}, thanks.", "field"), (REAL + " Dear [Your Name],", "field"), (REAL + " at &lt;Company Name&gt;.", "field"), ("Reports to: ##POSITION##", "field"), ("Reply to (add your city here) now", "field"),
        ("with ________ (name of employer).", "field"), ("Hallo «Vorname», " + REAL, "field"), ("at INSERT COMPANY HERE.", "field"), (REAL + " *|DATE|* ${DATE} %PHONE%", "field"),
        (REAL + " Lorem ipsum dolor sit amet consectetur adipiscing elit.", "filler"), ("bla bla bla bla bla bla bla", "filler"), ("Text goes here. Text goes here. Text goes here.", "filler"), ("asdf qwerty asdf zxcv asdf qwerty", "filler"),
        ("HTTP 404 Not Found. The profile at this address does not exist.", "page"), ("Menu Close\nPlease enable JavaScript to view this profile.\nBack to top", "page"), ("ERREUR 404. LA PAGE DEMANDÉE EST INTROUVABLE.", "page"),
        ("Wrote mail-merge templates whose fields, such as [Your Name], are filled from the staff database. " + REAL, None), ("Replaced the lorem ipsum of the old brochure with copy agreed by legal. " + REAL, None),
        ("Tools [in order of use]: {Java, Python}, C#, F#, __init__.py packaging, <5% defect rate. " + REAL, None), ("Designed friendly 404 pages and a maintenance notice, serving 47 people a day. " + REAL, None),
        ("Skip to content\nHome | Jobs | Sign in | Contact\n" + REAL, None), (REAL, None), ("", None), ("  \n", None), (None, None),
    ],
)
def test_residue_labels(text, want):
    terms = residue.exemplar_terms()
    common = {t: 900 for t in ("this", "the", "for", "and", "is", "or", "with", "to", "at", "of", "in", "a", "can")}
    index = residue.Index({t: common.get(t, 5) for t in terms}, 1000)
    assert residue.label(text, index) == want


def test_residue_table(spark):
    rows = [(k, REAL + f" number {k}", "x") for k in range(50)] + [(60, REAL + " {{ company }}", "y"), (60, REAL + " {{ company }}", "y"), (61, None, "z"), (62, " ", "z"), (None, "{{ company }}", "z"), (63, "test " * 100_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    assert sorted(tuple(r) for r in residue.residue(df).collect()) == [(60, "field"), (63, "filler")]
    kept = residue.without_residue(df)
    assert kept.columns == df.columns and kept.count() == 53
    assert residue.residue(df.where("false")).collect() == []
