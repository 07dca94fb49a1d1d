import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from mathquarry.llm import bpe, token_store  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY, OWN = Tokenizer.from_file(PATH), bpe.WordBPE(PATH)
TEXTS = ["", " \n ", "Hello hello, it's <|endoftext|>x 12", "Straße ΣΑΣ İstanbul naïve 中文😀", "a" * 3000, "  x\u0085y z \x1c", None, "re'll 've' <|start"]


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_automaton_is_the_library(text):
    ids = [i for piece in text.encode(errors="ignore").decode().replace("\n", " ").split(" ") for i in OWN.encode(piece)]
    text = text.encode(errors="ignore").decode()
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_small_alphabets_have_every_tie():
    rng = random.Random(2)
    for _ in range(3000):
        word = "".join(rng.choice("aaab") for _ in range(rng.randrange(1, 14)))
        assert OWN.encode(word) == LIBRARY.encode(word, add_special_tokens=False).ids


def test_long_words_take_linear_time():
    import time

    rng = random.Random(6)
    spent = []
    for n in (50_000, 200_000):
        word = "".join(rng.choice("abcdefghij") for _ in range(n))
        began = time.process_time()
        ids = OWN.encode(word)
        spent.append(time.process_time() - began)
        assert ids == LIBRARY.encode(word, add_special_tokens=False).ids
    assert spent[1] < 10 * spent[0] + 1


def test_overlapping_merges():
    vocab = {t: i for i, t in enumerate(["a", "b", "aa", "ab", "aab", "aaaa"])}
    plain = bpe.Automaton(vocab, [("a", "a"), ("a", "b"), ("aa", "b"), ("aa", "aa")], suffix="")
    labels = lambda w: [plain.labels[i] for i in plain.encode_word(w)]
    assert labels("aaa") == ["aa", "a"]
    assert labels("aaaaa") == ["aaaa", "a"]
    assert labels("aaab") == ["aa", "ab"]


def test_tables(spark):
    import hashlib

    rows = [(i, t, 5) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], 5), (None, "x y", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    want = sorted(
        (-1 if i is None else i, len(e.ids), hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(e.ids, skip_special_tokens=False).encode()).hexdigest())
        for i, t, _ in rows
        for e in [LIBRARY.encode(t or "", add_special_tokens=False)]
    )
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in bpe.bpe_digests(docs, PATH).collect()) == want
    full = bpe.bpe_table(docs, PATH).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, len(r.ids), hashlib.sha256(r.decoded.encode()).hexdigest()) for r in full) == [(x[0], x[1], x[3]) for x in want]
    assert bpe.bpe_digests(docs.limit(0), PATH).count() == 0


@given(st.lists(st.integers(0, 2**13 - 1), max_size=60), st.integers(13, 32), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_images_come_back(ids, bits, block):
    ids = np.array(ids, dtype=np.uint32)
    ends = np.array([len(ids) // 2, len(ids) // 2, len(ids)])
    image = token_store.Image(token_store.write_image([1, None, 7], ends, ids, bits, block))
    assert image.doc_ids == [1, None, 7]
    assert image.ids().tolist() == ids.tolist()
    for a in range(0, len(ids) + 1, 7):
        assert image.ids(a, a + 9).tolist() == ids[a : a + 9].tolist()
    assert image.document(2).tolist() == ids[len(ids) // 2 :].tolist()
    assert image.document(1).tolist() == []


def test_bits_and_misfits():
    assert [token_store.bits_for(n) for n in (1, 2, 3, 256, 257, 49408)] == [1, 1, 2, 8, 9, 16]
    with pytest.raises(ValueError):
        token_store.write_image([1], np.array([1]), np.array([4], dtype=np.uint32), 2)


def xxhash64(text):
    """Spark's hash of a string: seed 42, signed; a null leaves the seed."""
    import xxhash

    found = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return found - 2**64 if found >> 63 else found


def test_store_takes_other_tokenizer_files(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["Hello World, it is", "a\n\nb", "", None, "İ  ß " * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert not token_store.by_pieces(path) and token_store.by_pieces(PATH)
    got = {r.doc_id: r.ids_crc32 for r in token_store.read_store(token_store.write_store(docs, path, token_store.new_path(docs), end_id=None)).collect()}
    assert got == {i: zlib.crc32(np.array(library.encode(t or "", add_special_tokens=False).ids, dtype="<u4")) for i, t in enumerate(texts)}


def test_store(spark):
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(6, TEXTS[2]), (6, "b"), (None, "x y")]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    store = token_store.write_store(docs, PATH, token_store.new_path(docs))
    got = sorted((r.start, -1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.read_store(store).collect())
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, xxhash64(r[1]))):
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((at, -1 if i is None else i, len(ids), zlib.crc32(np.array(ids, dtype="<u4"))))
        at += len(ids)
    assert got == want
    empty = docs.limit(0)
    assert token_store.read_store(token_store.write_store(empty, PATH, token_store.new_path(empty))).count() == 0


@given(st.lists(st.text(st.sampled_from(list("aAbÉßÀ.,'<|> \n\t1!é́ΣİK中")), max_size=25) | st.sampled_from(["<|endoftext|>", "a,<|ENDOFTEXT|>.", "A.b, C.\x85d,", "x,\u2003y."]), max_size=5))
@settings(max_examples=300, deadline=None)
def test_pieces_give_whole_texts(texts):
    import pyarrow as pa

    from mathquarry.llm.pieces import pieces_of

    pieces, which, starts = pieces_of(pa.array(texts, pa.string()))
    for text, a, b in zip(texts, starts[:-1], starts[1:]):
        assert [i for k in which[a:b] for i in OWN.encode(pieces[k])] == LIBRARY.encode(text, add_special_tokens=False).ids


@given(st.lists(st.text(st.sampled_from(list("aAzÉßÀŉǅªĿİ中Σ1,é́ķ")), max_size=9), max_size=6))
@settings(max_examples=300, deadline=None)
def test_pieces_by_the_model_are_those_of_the_library(pieces):
    import numpy as np

    got = [np.frombuffer(x, np.uint32).tolist() for x in token_store.encode_pieces(LIBRARY, pieces)]
    assert got == [LIBRARY.encode(p, add_special_tokens=False).ids for p in pieces]
