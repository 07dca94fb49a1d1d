import re

import numpy as np
import xxhash

from mathquarry.llm import simhash
from mathquarry.llm.components import connected_components


def slow_fingerprint(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= 3 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


TEXTS = ["", " \t\n", "Ab", "ab  AB", "a b c", "a b c d e f", "É É é x\x0by\x1cz", "q " * 5000, "w%d " * 3 % (1, 2, 3), " ".join(f"w{i % 700}" for i in range(3000))]


def test_fingerprint_is_the_plain_definition():
    for n in (3, 5):
        assert simhash.fingerprints([t.encode() for t in TEXTS], n)[:, 0].tolist() == [slow_fingerprint(t, n) for t in TEXTS]


def spread(rng, words):
    base = rng.integers(0, 2**64, (40, words), dtype=np.uint64)
    flips = [(0b1,), (0b1111,), (0x8000000000000003,), (0b111 << 60,)]
    more = [base ^ np.array(list(f) + [0] * (words - 1), dtype=np.uint64) for f in flips]
    values = np.concatenate([base, *more])
    rng.shuffle(values)
    return values


def far(a, b):
    return sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(a, b))


def test_near_pairs_and_clusters_find_each_link():
    rng = np.random.default_rng(3)
    for words, radius in ((1, 3), (1, 1), (4, 3), (4, 110)):
        values = spread(rng, words)
        n = len(values)
        found = {(int(a), int(b)) for x, y in simhash.near_pairs(values, n - 1 - np.arange(n), radius) for a, b in zip(x, y)}
        want = {(i, j) for i in range(n) for j in range(i + 1, n) if far(values[i], values[j]) <= radius}
        assert found == want
        forest = simhash.Forest(n)
        forest.join(np.array([i for i, _ in want]), np.array([j for _, j in want]))
        assert simhash.clusters(values, radius, front=7).tolist() == forest.up.tolist()


def test_groups_hold_against_brute_force(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    near = [" ".join([*words[:k], "new", *words[k + 1 :]]) for k in range(60)]
    texts = [*TEXTS, None, *near, " ".join(words), " ".join(words)]
    rows = [(i if i != 5 else None, t, "x") for i, t in enumerate(texts)] + [(3, TEXTS[3], "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    for block, small in ((4096, 32), (4096, 2), (8, 32)):
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash, "SMALL", small)
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.fp0 % 2**64, r.component_id if r.component_id is not None else -1) for r in simhash.simhash_groups(docs, shingle=3, scheme=simhash.EXACT).collect())
        fps = [slow_fingerprint(t or "", 3) for _, t, _ in rows]
        label = components(fps)
        low = {}
        for (i, _, _), c in zip(rows, label):
            if i is not None:
                low[c] = min(i, low.get(c, i))
        assert got == sorted((i if i is not None else -1, f, low.get(c, -1)) for (i, _, _), f, c in zip(rows, fps, label))
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


def test_wide_groups_find_similar_texts(spark):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(2000)]
    rows = []
    for g in range(60):
        text = rng.choice(words, 300).tolist()
        rows.append((3 * g, " ".join(text)))
        for k, changes in ((1, 5), (2, 60)):  # similarities of about 0.85 and 0.3
            copy = list(text)
            for at in np.linspace(0, 299, changes).astype(int):
                copy[at] = "new"
            rows.append((3 * g + k, " ".join(copy)))
    found = {r.doc_id: r.component_id for r in simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert np.mean([found[3 * g + 1] == 3 * g for g in range(60)]) > 0.95
    assert all(found[3 * g] == 3 * g and found[3 * g + 2] == 3 * g + 2 for g in range(60))


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(1, k) for k in range(2, 60)]
    got = dict(connected_components(spark.createDataFrame([*chain, *hub, (7, 7), (900, -5), (None, 3)], "a long, b long")).collect())
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 1 for k in range(1, 60)}, 900: -5, -5: -5}


def shingle_set(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {" ".join(words[i : i + n]) for i in range(max(len(words) - n + 1, min(len(words), 1)))}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def jaccard_components(texts):
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8 and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def test_texts_that_share_a_repeated_line_stay_apart(spark, monkeypatch):
    rng = np.random.default_rng(11)
    line = " ".join(f"c{i}" for i in range(9))
    own = lambda k, n: " ".join(f"t{k}x{x}" for x in rng.integers(0, 10**6, n))
    texts = [own(k, n) + f" {line}" * times for k, (n, times) in enumerate([(100, 20), (100, 10), (200, 40), (200, 20)] * 4)]
    texts += [texts[0] + " end", texts[2] + " end", "", "one two", "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (simhash.CONFIRMED, 300):
        monkeypatch.setattr(simhash, "CONFIRMED", most)
        found = dict(simhash.simhash_groups(docs).select("doc_id", "component_id").collect())
        assert [found[k] for k in range(len(texts))] == jaccard_components(texts)


def test_similar_clusters_hold_against_brute_force():
    rng = np.random.default_rng(5)
    base = [rng.choice(10**6, 60, replace=False) for _ in range(6)]
    sets = [np.unique(np.concatenate([base[k % 6][: 60 - cut], rng.integers(10**6, 10**7, k % 9)])).astype("<u8") for k, cut in enumerate(rng.integers(0, 9, 80))]
    label = list(range(80))
    for i in range(80):
        for j in range(i):
            if jaccard(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert simhash.similar_clusters(sets, (4, 5)).tolist() == label


def test_links_are_those_of_brute_force_around_the_threshold(spark):
    rng = np.random.default_rng(19)
    texts = []
    for g in range(150):
        words = [f"g{g}w{x}" for x in rng.integers(0, 10**6, 200 if g % 2 else 40)]
        shingles = len(words) - 4
        texts.append(" ".join(words))
        # both lose a part of the end and get another: similarities from about 0.66 to 0.84
        swapped = round(shingles * (0.09 + 0.11 * (g % 30) / 30))
        texts.append(" ".join([*words[: len(words) - swapped], *(f"g{g}new{x}" for x in range(swapped))]))
    sets = [shingle_set(t) for t in texts]
    near = [jaccard(sets[k], sets[k + 1]) for k in range(0, 300, 2)]
    assert sum(0.8 <= x < 0.85 for x in near) >= 30 and sum(0.7 <= x < 0.8 for x in near) >= 50
    found = dict(simhash.simhash_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "component_id").collect())
    assert [found[k] for k in range(300)] == jaccard_components(texts)


def test_rows_of_a_key_are_linked_as_by_brute_force(monkeypatch):
    rng = np.random.default_rng(23)
    values = spread(rng, 2)
    keys = rng.integers(0, 9, len(values)).astype(np.uint64)
    for small in (64, 3):
        monkeypatch.setattr(simhash, "SMALL", small)
        a, b = simhash.key_links(values, keys, 3)
        got, want = simhash.Forest(len(values)), simhash.Forest(len(values))
        got.join(a, b)
        pairs = [(i, j) for i in range(len(values)) for j in range(i) if keys[i] == keys[j] and far(values[i], values[j]) <= 3]
        want.join(np.array([i for i, _ in pairs]), np.array([j for _, j in pairs]))
        assert got.up.tolist() == want.up.tolist() and len(pairs) > 9


def test_masks_leave_no_near_pair_out_and_widen():
    for n in (10, 10**9, 10**13):
        masks = simhash.EXACT.masks(n)[:, 0]
        assert min(int(m).bit_count() for m in masks) >= min(25, n.bit_length() - 3)
        rng = np.random.default_rng(1)
        for _ in range(200):
            flips = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
            assert any(int(m) & flips == 0 for m in masks)
    for n in (10, 10**6, 10**9):
        masks = simhash.WIDE.masks(n)
        width = max(12, n.bit_length() - 5)
        assert {sum(int(x).bit_count() for x in row) for row in masks} == {width}
        if n < 10**8:  # 151 of 1,000 bits differ at a similarity of 0.8
            pairs = np.packbits(rng.random((4000, 256)) < 0.151, axis=1).view("<u8")
            met = np.zeros(len(pairs), dtype=bool)
            for mask in masks:
                met |= ~(pairs & mask).any(axis=1)
            assert met.mean() > 0.99


def test_oversized_keys_are_dealt_out(spark, monkeypatch):
    rng = np.random.default_rng(29)
    base = rng.integers(0, 2**63, 2, dtype=np.uint64)
    values = np.unique(base ^ (np.uint64(1) << rng.integers(0, 63, (300, 2), dtype=np.uint64)), axis=0)
    values = np.concatenate([values, np.zeros_like(values)], axis=1)
    nodes = spark.createDataFrame([tuple(map(int, x.view(np.int64))) for x in values], "fp0 long, fp1 long, fp2 long, fp3 long")
    monkeypatch.setattr(simhash, "BLOCK", 100)
    monkeypatch.setattr(simhash, "n_tables", lambda *_: 4)
    masks = simhash.WIDE.masks(len(values))
    t, _, m = simhash.hot_keys(nodes, masks, len(values))
    assert len(t) and m.min() > 1
    linked = {x for r in simhash.near_links(nodes, simhash.WIDE).collect() for x in (r.a, r.b)}
    assert linked == set(simhash._nodes(values[:, :2]).tolist())


def test_groups_of_supplied_documents_are_those_of_exact_similarity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = dict(docs.collect())
    sets = {i: shingle_set(t or "") for i, t in texts.items()}
    holders = {}
    for i, found in sets.items():
        for x in found:
            holders.setdefault(x, []).append(i)
    shared = {}
    for found in holders.values():
        for k, a in enumerate(found):
            for b in found[:k]:
                shared[a, b] = shared.get((a, b), 0) + 1
    links = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    label = {i: i for i in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        label[high] = low
    got = dict(simhash.simhash_groups(docs).select("doc_id", "component_id").collect())
    together = sum(got[a] == got[b] for a, b in links)
    assert len(links) > 30 and together >= 0.99 * len(links)
    # nothing is linked that exact similarity does not link, directly or by others
    assert all(root(i) == root(c) for i, c in got.items())
