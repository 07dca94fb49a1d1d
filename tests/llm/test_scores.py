import random
import zlib

import numpy as np

from mathquarry.llm import quality, toxicity
from mathquarry.llm.labelled import labelled_sample

WORDS = [a + b for a in ("ta", "mi", "ro", "le", "su", "pe") for b in ("na", "ko", "", "rim", "vel", "tas")]


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def corpus(n=400):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(30, 90))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["grobnik", "zlofel" + rng.choice("abcdef")]))
        bad = i % 4 == 1
        lines = [" ".join(words[k : k + 12]) + "." for k in range(0, len(words), 12)]
        if bad:
            lines = [lines[0], *(" | ".join(x.split()) for x in lines), "spam " * 40]
        docs.append((i, "\n".join(lines), "en"))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def test_models_tell_held_out_rows(spark):
    docs, labels = corpus()
    odd = [(1000, None, "x"), (1001, "", "x"), (None, "a\n\nb", "x"), (3, docs[3][1], "y"), (1002, "word " * 40000, "x")]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (7, None, None), (9, labels[9][1], labels[9][2])], "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in labels}
    for scored, kind in ((quality.score_quality(d, quality.train_quality(d, lab)), 0), (toxicity.score_toxicity(d, toxicity.train_toxicity(d, lab)), 1)):
        rows = scored.collect()
        assert len(rows) == len(docs) + len(odd)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= (0.3 if kind else 0.7)) for r in rows)
        assert all(r.held_out == is_held_out(r.doc_id) for r in rows if r.doc_id is not None)
        out = [(r.predicted, truth[r.doc_id][kind]) for r in rows if r.doc_id in truth and r.held_out]
        assert np.mean([p == y for p, y in out]) > 0.97
        assert len({r.score for r in rows if r.doc_id == 3}) == 1
    empty = d.limit(0)
    assert quality.score_quality(empty, quality.train_quality(empty, lab)).count() == 0
    assert toxicity.score_toxicity(empty, toxicity.train_toxicity(empty, lab.limit(0))).count() == 0


def test_held_out_labels_are_never_sampled(spark):
    docs, labels = corpus(120)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ids = [r.doc_id for r in labelled_sample(d, lab, "quality", 50).collect()]
    assert len(ids) == 50 and not any(map(is_held_out, ids))


def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(1)
    first = np.array([0, 1, 5, 8])
    odds, pair = rng.normal(size=8), rng.normal(size=(2, 2))
    good = quality.marginals(odds, first, pair)
    for a, b in zip(first[:-1], first[1:]):
        total, each = 0.0, np.zeros(b - a)
        for path in range(2 ** (b - a)):
            y = [path >> k & 1 for k in range(b - a)]
            w = np.exp(sum(o * v for o, v in zip(odds[a:b], y)) + sum(pair[u, v] for u, v in zip(y, y[1:])))
            total += w
            each += w * np.array(y)
        assert np.allclose(good[a:b], each / total)


def test_line_features_count_words():
    f, first = quality.line_features([b"", b"a a b\n\nThe x!", "é é".encode()])
    names = list(quality._FEATURES)
    assert first.tolist() == [0, 1, 4, 5]
    assert np.allclose(f[:, names.index("distinct")], [0, 2 / 3, 0, 1, 0.5])
    assert np.allclose(f[:, names.index("repeated")], [0, 1 / 3, 0, 0, 0.5])


def test_grammar_tells_negation_and_reported_speech():
    model = toxicity.ToxicModel({"grob": 2.0}, {})
    total = lambda t: 0.0 if (x := model.features(t)) is None else round(float(np.expm1(x[0])), 6)
    assert total("grob") == 2 and total("they are grob") == 3 and total("grob, grob") == 4
    assert total("he is not a grob") == total("You aren’t a grob") == total("you aren't a grob") == 0.6
    assert total("she said he was grob") == 1.2 and total("He said, \"you are grob\"") == total("He said: you are grob") == 1.2
    assert total("“you are grob”, she said") == 1.2 and total("\"you\" are grob, she said") == 3
    assert total("not here. grob there") == 2 and total("he said no. grob") == 2
    assert total("he did not bring anything to them about this grob") == 3  # too far from the negation
    assert total("I will kill you, so") == 3 and total("she said, I will kill you") == 1.2
    assert total("kill that grob") == 6 and total("never kill you") == 0.6
    assert model.features("time to kill. you see") is None and model.features("grobe") is None
    # and the score follows: single words count only through their sentence
    model.beta = np.array([1.5, 0.5, 0.5, 0.2, -3.0])
    texts = ["you are grob", "grob", "she said you are grob", "you are not grob", "nothing"]
    assert model.scores(toxicity.pa.array(texts)).tolist() == sorted(model.scores(toxicity.pa.array(texts)), reverse=True)


def test_composed_transducer_is_its_parts_side_by_side():
    rng = random.Random(8)
    for _ in range(300):
        kinds = rng.choices(range(7), weights=[9, 3, 2, 3, 2, 1, 1], k=rng.randrange(40))
        states, want = [0] * 5, []
        for c in kinds:
            weight, said = 1.0, c == toxicity.INSULT or c == toxicity.TARGET and states[1] == 1
            for k, part in enumerate(toxicity.PARTS):
                states[k], w = part.get((states[k], c), (states[k], 1.0))
                weight *= w
            want.append(weight if said else 0.0)
        state, got = 0, []
        for c in kinds:
            got.append(toxicity.WEIGHTS[state][c])
            state = toxicity.MOVES[state][c]
        assert np.allclose(got, want)


def test_sample_takes_long_documents_and_is_bounded(spark):
    docs = [(i, "word " * 50_000 if i % 2 else "short text") for i in range(60)] + [(4, "other text")] * 30
    labels = [(i, 1, 0) for i in range(60)] + [(1000 + i, 1, 0) for i in range(500)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = labelled_sample(d, lab, "quality", 20).collect()
    assert len(found) == len({r.doc_id for r in found}) == 20 and any(len(r.text) > 100_000 for r in found)
