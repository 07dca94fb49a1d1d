import hashlib
import random
import re

from mathquarry.llm import substring_dedup as sd


def brute(rows, window):
    ordered = sorted({(i if i is not None else -(2**63), t or "") for i, t in rows})
    first = {}
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in ordered]
    for i, words in docs:
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for i, t in rows:
        j = i if i is not None else -(2**63)
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < (j, s):
                gone.update(range(s, s + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((-1 if i is None else i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = ["ab", "ba", "c", "É", "x\x1cy", "nbsp sep", "Ab"]
    passage = [rng.choice(vocabulary) + str(rng.randrange(9)) for _ in range(30)]
    rows = [(None, "a b c d " * 3), (0, None), (1, ""), (2, " \t\n"), (3, "same " * 300)]
    for i in range(4, 60):
        words = [rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 60))]
        at = rng.randrange(len(words))
        if i % 3 == 0:
            words[at:at] = passage[: rng.randrange(3, 30)]
        rows.append((i, rng.choice(["\n", " ", " \x0b "]).join(words)))
    rows += [(70, rows[40][1]), (65, rows[40][1]), (65, rows[40][1])]
    docs = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, starts string").repartition(5)
    for window in (3, 20):
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in sd.substring_dedup(docs, window=window).collect())
        assert got == brute(rows, window)
    monkeypatch.setattr(sd, "BUCKET_BYTES", 100)
    assert sorted(r.n_removed for r in sd.substring_dedup(docs, window=3).collect()) == sorted(x[2] for x in brute(rows, 3))
    assert sd.substring_dedup(docs.limit(0)).count() == 0


def test_words_made_to_collide_stay_apart(spark):
    # a Thue-Morse word and its complement have equal polynomial hashes modulo 2**64 in every base
    word = "".join("ab"[k.bit_count() % 2] for k in range(4096))
    other = word.translate(str.maketrans("ab", "ba"))
    tail = [f"w{k}" for k in range(19)]
    rows = [(1, " ".join([word, *tail])), (2, " ".join([other, *tail])), (3, " ".join([*tail, word])), (4, " ".join([other, *tail, "x"]))]
    got = {r.doc_id: r.n_removed for r in sd.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 20}
    hashes, _, _ = sd.windows([t.encode() for _, t in rows])
    assert len({tuple(x) for x in hashes.tolist()}) == 4 and len(hashes) == 5


def test_packed_blocks_come_back_whole():
    docs, starts = sd.np.array([3, 3, 9, 9, 9]), sd.np.array([0, 70000, 2, 3, 8])
    hashes = sd.np.arange(10, dtype=sd.np.uint64).reshape(-1, 2) << sd.np.uint64(28)
    found = sd._unpacked(sd._packed(docs, starts, hashes))
    assert found[0].tolist() == docs.tolist() and found[1].tolist() == starts.tolist()
    assert found[2].tolist() == (hashes & sd.np.array([2**64 - 1, 2**16 - 1], dtype=sd.np.uint64)).tolist()
    assert len(sd._unpacked(sd._packed(docs, starts))[2]) == 0
