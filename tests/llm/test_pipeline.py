import hashlib
import random

import corpus_pipeline
import pytest
from mathquarry.llm import mixing, quality

public_tokenizers = pytest.importorskip("public_tokenizers")


def corpus():
    rng = random.Random(9)
    words = [a + b for a in ("ta", "mi", "ro", "le", "su", "pe", "ka") for b in ("na", "ko", "", "rim", "vel", "tas", "do")]
    docs, labels = [], []
    for i in range(260):
        body = [rng.choice(words) for _ in range(rng.randrange(60, 160))]
        bad = i % 5 == 1
        lines = [" ".join(body[k : k + 12]) + "." for k in range(0, len(body), 12)]
        docs.append((i, "\n".join(" | ".join(x.split()) for x in lines) if bad else "\n".join(lines), "en", f"s{i % 3}", 0))
        labels.append((i, int(not bad), 0))
    docs += [(300 + k, docs[10][1], "en", "s0", 0) for k in range(20)]
    copy = docs[22][1].split(" ")
    docs.append((400, " ".join([*copy[:30], "other", *copy[31:]]), "en", "s1", 0))
    return docs, labels


def test_stages_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, labels = corpus()
    sf = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    label_rows = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    label_rows.write.parquet(f"{sf}/labels.parquet")
    table = spark.read.parquet(f"{sf}/documents.parquet")
    columns = table.columns
    # quality: the model's own scores, row by row
    model = quality.train_quality(table, label_rows)
    kept = [d for d in docs if model.scores([d[1].encode()])[0] >= quality.ACCEPT]
    good = {i for i, q, _ in labels if q}
    assert {d[0] for d in kept} >= good and not {d[0] for d in kept} & ({i for i, _, _ in labels} - good)
    # exact: the largest id of each text
    last = {}
    for d in kept:
        last[d[1]] = max(d, last.get(d[1], d))
    kept = list(last.values())
    # near: components over the exact similarity of five-word shingles
    sets = [{" ".join(x) for x in zip(*(d[1].lower().split()[k:] for k in range(5)))} for d in kept]
    group = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    first = {}
    for d, g in zip(kept, group):
        first[g] = min(d, first.get(g, d))
    kept = sorted(first.values())
    assert {d[0] for d in kept} & {22, 400} == {22}
    near = spark.createDataFrame(kept, table.schema)
    copies = {r.doc_id: r.copies for r in mixing.mix_plan(near).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d in kept:
        e = library.encode(d[1], add_special_tokens=False)
        want += [(d[0], len(e.ids), hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest())] * copies[d[0]]
    got = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, sf).columns == columns
        assert stage(spark, table.limit(0), sf).count() == 0


def test_stages_take_odd_rows(spark, tmp_path):
    docs, labels = corpus()
    sf = str(tmp_path)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    odd = [(None, None, None, None, None), (None, docs[3][1], None, None, 1), (5, "", "en", None, 0), (70, docs[4][1], "en", "s", 1), (70, docs[4][1], "en", "s", 1), (7, "word " * 30000, "en", "s", 1)]
    table = spark.createDataFrame([(*d, "extra") for d in docs[:60] + odd], "doc_id long, text string, lang string, source string, n_chars long, copies string")
    n = table.count()
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, sf)
        found[name] = sorted((r.doc_id is not None, r.doc_id or 0) for r in out.collect())
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == table.columns
    ids = sorted((d[0] is not None, d[0] or 0) for d in docs[:60] + odd)
    good = [i for i, q, _ in labels[:60] if q]
    assert {(True, i) for i in good} <= set(found["quality classifier"]) <= set(ids)
    exact = found["exact dedup"]
    # docs[3] has an id, so its copy without one goes; of the rows without text 5 stays; of 4 and its copies the largest id, once
    assert exact == sorted((True, i) for i in [*(d[0] for d in docs[:60] if d[0] not in (4, 5, 7)), 5, 5, 7, 7, 70])
    near = found["SimHash near-dedup"]
    assert (True, 70) not in near and (True, 4) in near and (False, 0) not in near and len(near) >= 60
    assert found["BPE encoding and decoding"] == ids and len(ids) == n
    mixed = [found["mixing sources to target weights"].count(x) for x in set(ids)]
    assert max(mixed) <= 3 * 3 and sum(mixed) > 0
