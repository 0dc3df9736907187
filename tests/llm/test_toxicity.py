import random
import zlib

import pytest
from pyspark.sql import functions as F

from assaylake.llm import toxicity

from .conftest import docs_frame


def test_folding():
    assert toxicity.fold("1d10t").split() == toxicity.fold("IDIOT").split() == toxicity.fold("іdіоt").split() == toxicity.fold("ｉｄｉｏｔ").split() == toxicity.fold("ídi​ot").split()
    assert toxicity.fold("l0$er").split() == toxicity.fold("Loser").split() and toxicity.fold("tr@sh!").split() == ["trash"]
    assert toxicity.fold(None) == toxicity.fold("") == " " and toxicity.fold("a-b,c").split() == ["a", "b", "c"]


def test_weights_and_exceptions():
    m = toxicity.Matcher({"trash": 2.0, "idio": 1.0}, frozenset({("trash", "can")}))
    assert m.total(toxicity.fold("a trash can and trash, IDIOTS!")) == 3.0
    assert toxicity.Matcher({}, frozenset()).total(" trash ") == 0.0


def corpus(n=1500):
    rnd = random.Random(4)
    syllables = ["ba", "do", "ki", "ra", "me", "tu", "so", "ne"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 5)))
    docs, labels = [], []
    for i in range(n):
        toxic = rnd.random() < 0.2
        text = [word() for _ in range(rnd.randrange(5, 200))]
        for _ in range(rnd.randrange(1, 4) if toxic else 0):
            text.insert(rnd.randrange(len(text)), rnd.choice(["grolk", "Gr0lk", "vexiba", "vexido", "vexira", "plimf"]))
        if not toxic and rnd.random() < 0.01:
            text[2:2] = ["plimf", "garden"]
        docs.append((i, " ".join(text), "a"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    frame, known = docs_frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(frame, known)
    assert {"groik", "vexi"} & set(model.terms) and ("piimf", "garden") in model.phrases
    got = toxicity.score(frame, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).join(known, "doc_id").collect()
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held"]]
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.97 * len(held)
    # Labels of held-out rows have no effect.
    flipped = known.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(frame, flipped) == model


@pytest.mark.parametrize("labels", [[], [(0, 1, 1)], [(0, 1, None), (None, 1, 1), (99, 1, 0), (1, 0, 7)]])
def test_odd(spark, odd, none, labels):
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(odd, toxicity.fit(odd, known)).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.score(none, toxicity.fit(none, known)).collect() == []


def test_unrelated_texts_are_learned_from(spark):
    rnd = random.Random(6)
    common_pair = min((f"a{x} b{y}" for x in "cdefghijk" for y in "mnopqrtuvw"), key=lambda p: zlib.crc32(toxicity.fold(p).strip().encode()))
    docs = [(i, " ".join(["".join(rnd.choice("cdefghmnopqr") for _ in range(7)) for _ in range(60)] + [common_pair]), "a") for i in range(80)]
    docs += [(100 + i, docs[i][1].replace(common_pair, common_pair.upper()), "a") for i in range(10)]
    known = spark.createDataFrame([(i, 1, 0) for i, _, _ in docs], "doc_id long, quality int, toxic int")
    taken = [i for i, _, _ in docs if zlib.crc32(str(i).encode()) % 5]
    got = [(r["folded"], r["share"]) for r in toxicity.training_rows(docs_frame(spark, docs), known).collect()]
    folded = [toxicity.fold(docs[i if i < 80 else i - 20][1]) for i in taken]
    assert sorted(got) == sorted((t, 1 / folded.count(t)) for t in folded)


def test_long_words_and_neighbours(spark):
    long = "x" * 300
    m = toxicity.Matcher({"trash": 2.0}, frozenset({(long, "trash"), ("trash", long)}))
    assert m.total(toxicity.fold(f"trash {long}")) == m.total(toxicity.fold(f"{long}    trash")) == 0.0 and m.total(toxicity.fold(f"trash y{long} trash")) == 4.0
    docs = [(i, f"word{i % 7} of a text {'abcdefghijklmnopqr' if i % 3 == 0 else 'abcdefghijklmnopst'} and other{i}", "a") for i in range(300)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    terms = toxicity.lexicon(toxicity.training_rows(docs_frame(spark, docs), labels))
    assert toxicity.fold("abcdefghijklmnopqr").strip() in terms and not any("abcdefghijklmnopst".replace("l", "i").startswith(t) for t in terms)


def test_too_many_terms_is_an_error(spark):
    docs, labels = corpus(400)
    with pytest.raises(ValueError, match="fit_rows"):
        toxicity.lexicon(toxicity.training_rows(docs_frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), max_terms=1)
