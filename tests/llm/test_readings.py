import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import toxicity
from ledgerloom.llm import wordkernel as wk


@pytest.fixture(scope="module")
def model():
    text = "you are an idiot and a moron " * 50 + "the stupid and the bullshit one of an ass would die " * 50
    counts = np.zeros(toxicity.SYMBOLS**3, np.int64)
    s = toxicity._SYMBOL[np.frombuffer(text.encode(), np.uint8)]
    np.add.at(counts, (s[:-2] * toxicity.SYMBOLS + s[1:-1]) * toxicity.SYMBOLS + s[2:], 1)
    return toxicity.character_model(counts)


def hashes(text, model):
    (_, _, data, offsets), *_ = wk.chunks(pa.array([text]))
    return toxicity.features(data, offsets, model)


@pytest.mark.parametrize(
    "noisy, plain",
    [("idioot", "idiot"), ("stuppid", "stupid"), ("a55", "ass"), ("di3", "die"), ("idi07", "idiot"), ("a s s", "ass"), ("bull$h!+", "bullshit"), ("bull$h!+.", "bullshit"), ("a$$!", "ass"), ("idiot!", "idiot"), ("4 5 5", "ass"), ("455", "ass")],
)
def test_obfuscated_words_are_read(model, noisy, plain):
    want = hashes(plain, None)[1][0, 0]
    assert want in hashes(f"so {noisy} here", model)[1][0]


def test_readings_of_a_token_count_once(model):
    (h,) = hashes("idiot", None)[1][:1, 0]
    weights = toxicity.Weights(np.array([h]), np.array([2.0]), 1.0)
    for text in ("idiot idiot!", "idioot idi07", "an idiot! idioot."):
        assert toxicity.evidence(*hashes(text, model), 1, weights)[0] == 2.0


def test_doubled_letters_that_are_meant_stay(model):
    want = hashes("bullshit", None)[1][0, 0]
    assert want in hashes("bullshit", model)[1][0]
    assert hashes("xxyy", None)[1][0, 0] in hashes("xxyy", model)[1][0]


def test_doubled_letters_of_more_bytes_have_two_readings():
    for text in ("schéén", "éé", "ああ", "aé日日"):
        (_, _, data, offsets), *_ = wk.chunks(pa.array([text]))
        assert toxicity.suspects(wk.words(data, offsets, False)) == [(0, len(text.encode()))]
    (_, _, data, offsets), *_ = wk.chunks(pa.array(["schön é日é plain"]))
    assert toxicity.suspects(wk.words(data, offsets, False)) == []


def test_training_keeps_all_but_equal_texts(spark):
    phrase = "in any case"  # unrelated texts that share their least word pair
    texts = [f"{phrase} {' '.join(f'q{i}w{k}' for k in range(3))}" for i in range(40)] + ["one", "two", "", None, "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(44)] + [(44, 1)], "doc_id long, toxic int")
    got = sorted((r["toxic"], r["text"] or "") for r in toxicity.training_rows(docs, labels).collect())
    assert got == sorted([*((int(i % 4 == 0), t or "") for i, t in enumerate(texts[:44]))])
