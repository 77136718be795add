"""Multiple-instance learning: held-out documents, the sentences at fault, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from aqspark.llm import queries as Q
from aqspark.llm import toxicity as X
from aqspark.llm.queries import op5_toxicity


def made_up(n=400, seed=3):
    random = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re") for b in ("ta", "so", "vi", "ne", "du")]
    texts, labels = [], []
    for i in range(n):
        lines = [" ".join(random.choice(words, 8)) + "." for _ in range(int(random.integers(1, 9)))]
        if i % 4 == 0:
            at = int(random.integers(len(lines)))
            lines[at] = lines[at].replace(" ", f" grumpf{random.choice(['a', 'ig', 'on'])} ", 1)
        texts.append(" ".join(lines))
        labels.append(int(i % 4 == 0))
    return texts, labels


def test_weights_find_the_words_behind_the_labels():
    texts, labels = made_up()
    scorer = X.Scorer(X.fit(texts, labels))
    more, truth = made_up(100, seed=5)
    scores = scorer.score(more)
    assert ((scores >= 0.3) == np.array(truth)).all()
    # a beginning is learned, so an ending never seen is recognised
    assert scorer.score(["kata losovi. mita grumpfelei nune."])[0] > 0.3
    text = more[truth.index(1)]
    spans = scorer.offending(text, 0.3)
    assert len(spans) == 1 and "grumpf" in text[spans[0]["start"]:spans[0]["stop"]]


def test_long_clean_texts_stay_clean():
    texts, labels = made_up()
    scorer = X.Scorer(X.fit(texts, labels))
    clean = " ".join(t for t, l in zip(texts, labels, strict=True) if not l)
    assert scorer.score([clean])[0] < scorer.score([clean + " grumpfa ta."])[0]


def test_sentences_are_cut():
    ends = np.array([False, True, False] + [False] * 70 + [True])
    assert X.instances(ends).tolist() == [0, 2, 66]
    assert X.instances(np.array([], bool)).tolist() == []


def test_odd_rows(spark):
    texts, labels = made_up(200)
    rows = [(i, t, l, 0.5) for i, (t, l) in enumerate(zip(texts, labels, strict=True))]
    rows += [(900, None, 1, None), (901, "", 0, None), (902, "12. !", None, None), (None, "grumpfa kata.", None, None), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int, score double")
    found = X.score_toxicity(docs, X.learn_toxicity(docs)).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    assert [by_id[i]["score"] for i in (900, 901, 902)] == [0.0, 0.0, 0.0]
    assert by_id[None]["predicted"] == 1 and all(0 <= r["score"] <= 1 for r in found)


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, toxic int")
    model = X.learn_toxicity(empty)
    assert X.score_toxicity(empty, model).count() == 0
    assert X.Scorer(model).score(["any words"])[0] < 0.01


def test_held_out_documents(spark):
    found = op5_toxicity(spark, "/root/testdata/sf0.1").where("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("toxic IS NOT NULL")
    rows = found.join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"]]
    clean = [r["predicted"] for r in rows if not r["toxic"]]
    assert np.mean(toxic) > 0.95 and np.mean(clean) < 0.01


def plain_score(model, text):
    """Noisy-or over sentences, word by word."""
    sentences, own, length = [], [], 0
    for token in X.TOKEN.findall((text or "").lower()):
        if X.is_end(token):
            sentences.append(own)
            own, length = [], 0
            continue
        if length == X.LONGEST:
            sentences.append(own)
            own, length = [], 0
        own.append(token)
        length += 1
    clean = 1.0
    for own in [*sentences, own]:
        if own:
            z = model.bias + sum(model.weights[f] for token in own for f in X.word_features(token))
            clean *= 1 / (1 + np.exp(z))
    return 1 - clean


def test_query_equals_plain_noisy_or(spark, monkeypatch):
    models, learn = [], Q.learn_toxicity
    monkeypatch.setattr(Q, "learn_toxicity", lambda rows: (models.append(learn(rows)), models[-1])[1])
    folder = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in Q.op5_toxicity(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    assert np.count_nonzero(models[0].weights)
    for doc in docs:
        row, want = found[doc["doc_id"]], plain_score(models[0], doc["text"])
        assert abs(row["score"] - want) < 1e-9
        assert row["predicted"] == int(row["score"] >= 0.3)
        # sentences at fault are told only where the document is
        assert bool(row["offending"]) <= bool(row["predicted"])
