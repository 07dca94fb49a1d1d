import hashlib
import random

import numpy as np

from mathquarry.llm import exact_dedup, mixing
from mathquarry.llm.queries import OP7_SQL


def test_chunks_are_content_defined_and_whole():
    rng = random.Random(3)
    body = bytes(rng.randrange(256) for _ in range(60_000))
    values = [b"", b"x", body, b"prefix" * 50 + body, b"\0" * 50_000]
    parts = {}
    for row, pos, chunk in exact_dedup.chunks(values):
        assert pos == len(parts.setdefault(row, []))
        parts[row].append(chunk)
    assert [b"".join(parts[k]) for k in range(len(values))] == values
    assert all(len(c) <= exact_dedup.LONGEST + exact_dedup.SHORTEST for x in parts.values() for c in x)
    assert len(set(parts[2]) & set(parts[3])) > 0.8 * len(parts[2])


def texts():
    rng = random.Random(5)
    long = "".join(rng.choice("abcdef ") for _ in range(30_000))
    return [None, "", "a", "a", "A", "a ", long, long, long + "x", "x" + long, "é", "é"]


def test_exact_groups_against_brute_force(spark, monkeypatch):
    rows = [(i, t, "k") for i, t in enumerate(texts())] + [(None, "a", "k"), (None, "q", "k"), (3, "a", "k"), (3, "b", "k"), (3, "b", "k"), (3, "b", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, recipe string").repartition(4)
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    want = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest(), ids.count(i)) for i in ids]
    for clash in (False, True):
        monkeypatch.setattr(exact_dedup, "REPEATS", 2)
        if clash:  # all identifiers stand for many chunks
            monkeypatch.setattr(exact_dedup.xxhash, "xxh3_64_intdigest", lambda x: 5)
            monkeypatch.setattr(exact_dedup, "CLASH_BROADCAST", 0)
        got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256, r.n_rows) for r in exact_dedup.exact_groups(docs).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
    kept = exact_dedup.rows_of(docs, exact_dedup.exact_groups(docs).where("kept"))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted((i or -1, t) for t, i in ((t, max([x for x in ids if x is not None], default=None)) for t, ids in groups.items()))
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_mix_against_sql_and_targets(spark):
    import duckdb

    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice(["b", "a", "a", "é", None, "c"]), 1) for i in range(3000)]
    rows += [(5000, None, "empty", 1), (5001, "", "empty", 1), (None, "x y", "a", 1), (7, rows[7][1], rows[7][2], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    plan = mixing.mix_plan(docs).collect()
    documents = docs.toArrow()  # noqa: F841
    want = duckdb.sql(OP7_SQL).fetchall()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.source_size, r.target, r.size * r.copies) for r in plan)
    assert got == sorted((-1 if i is None else i, *x) for i, *x in want)
    taken, target = {}, {}
    for r in plan:
        source = r.row.source
        taken[source] = taken.get(source, 0) + r.size * r.copies
        target[source] = r.target
        assert 0 <= r.copies <= 3
    assert all(abs(taken[s] - target[s]) <= 0.15 * target[s] for s in target)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in plan)
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_excess_is_shared_again(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 10), ("d", 2000), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    left, weight, caps = 3020.0, {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}, {"a": 30, "b": 3000, "c": 30, "d": 6000, None: 0}
    target, open_ = {}, dict(weight)
    while True:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in share if share[s] > caps[s]]
        if not over:
            break
        for s in over:
            target[s] = caps[s]
            left -= caps[s]
            del open_[s]
    target |= share
    assert all(np.isclose(got[s], target[s]) for s in weight) and np.isclose(sum(got.values()), 3020)


def test_names_with_dots(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 1), (2, "a b", "s", 2)], "doc_id long, text string, source string, `x.y` int")
    kept = exact_dedup.rows_of(docs, exact_dedup.exact_groups(docs).where("kept"))
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "a b", "s", 2)]
    assert mixing.mixed(docs).columns == docs.columns
