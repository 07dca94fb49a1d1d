"""BPE encoding and decoding by a tokenization automaton.

The automaton's states are "the last token was t"; an arc s -t-> t is there when the token pair
(s, t) can stand side by side in a tokenization, and every path spells exactly one tokenization of
its text. It is built by one gadget per merge, in order of priority. The gadget of merge k,
(u, v) -> w,

* adds state w, whose arcs are those that state v had at step k,
* adds arcs labelled w wherever arcs labelled u were at step k and v could follow, and
* removes the arc v from state u.

All arcs together would be about as many as the square of the vocabulary (2.4e9 for 49k tokens), so
the gadgets are kept as the columns ``left``, ``right``, ``made`` and ``cut``; an arc is looked up
through them when it is first met and then stands in the transition table, whose size has a bound.
Encoding follows the arcs that spell a word through the transition table; decoding emits arc labels.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from mathquarry.llm.common import sliced, texts_of
from mathquarry.llm.pieces import TEXT_BYTES, Remembering, pieces_of

#: Arcs and words that a worker's tables hold before they start anew.
ARCS, WORDS = 300_000, 10_000
SUFFIX = "</w>"
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes are themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Automaton:
    """Compiled from a vocabulary {token: id} and its merges in order of priority."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = SUFFIX):
        size = max(vocab.values()) + 1
        self.labels = [""] * size
        for token, i in vocab.items():
            self.labels[i] = token
        self.suffix = suffix
        self.left, self.right, self.made = [-1] * size, [-1] * size, [-1] * size
        self.cut: dict[tuple[int, int], int] = {}
        for k, (a, b) in enumerate(merges):
            self._gadget(k, vocab[a], vocab[b], vocab[a + b])
        # arc labels by spelling: those inside a word, and those that end one
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        self.reach: dict[str, int] = {}  # longest label with the same first four letters; three where there is none
        for token, i in vocab.items():
            body, ends = self._spelled(token)
            if self.made[i] < 0 and len(body) > 1:
                continue  # no merge makes it
            (self.final if ends else self.inner)[body] = i
            if not ends or not suffix:
                self.reach[body[:4]] = max(len(body), self.reach.get(body[:4], 0))
        if not suffix:
            self.final = self.inner
        self.longest = max(map(len, self.final), default=0)
        self.table: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def _spelled(self, token: str) -> tuple[str, bool]:
        ends = bool(self.suffix) and token.endswith(self.suffix) and token != self.suffix
        return token[: -len(self.suffix)] if ends else token, ends

    def _gadget(self, k: int, u: int, v: int, w: int) -> None:
        self.cut.setdefault((u, v), k)
        if self.made[w] < 0:
            self.left[w], self.right[w], self.made[w] = u, v, k

    def arc(self, s: int, t: int) -> bool:
        """Whether state s has an arc labelled t."""
        key = s << 20 | t
        found = self.table.get(key)
        if found is None:
            if len(self.table) >= ARCS:
                self.table.clear()
            found = self.table[key] = self._resolve(s, t)
        return found

    def _resolve(self, s: int, t: int) -> bool:
        # until: only removals before that step count; a removal at the very step of t's own merge
        # counts too, as of equal merges the one further left goes first
        until, made, cut = len(self.cut) + 1, self.made, self.cut
        while True:
            at = cut.get((s, t))
            if at is not None and at < until:
                return False
            if made[s] < 0 and made[t] < 0:
                return True
            if made[s] >= made[t]:
                until, s = min(until, made[s]), self.right[s]
            else:
                until, t = min(until, made[t] + 1), self.left[t]

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-split word in byte letters: the labels of the only path that spells it.

        From each place the longest label goes first. A prefix has one path only, so a place that
        leads nowhere is given up once and for all.
        """
        known = self.words.get(word)
        if known is not None:
            return known
        n = len(word)
        inner, reach, arc, tabled = self.inner.get, self.reach.get, self.arc, self.table.get
        path: list[tuple[int, int, int]] = []
        dead: set[int] = set()
        state, j, k, fresh = -1, 0, 0, True
        while n:
            if fresh:
                t = self.final.get(word[j:]) if n - j <= self.longest else None
                if t is not None and (state < 0 or arc(state, t)):
                    path.append((j, n, t))
                    break
                k = min(n - 1, j + reach(word[j : j + 4], 3))
            while k > j:
                t = inner(word[j:k])
                if t is not None and k not in dead:
                    if state < 0:
                        break
                    open_ = tabled(state << 20 | t)
                    if arc(state, t) if open_ is None else open_:
                        break
                k -= 1
            fresh = k > j
            if fresh:
                path.append((j, k, t))
                state, j = t, k
            else:
                dead.add(j)
                j, k, _ = path.pop()
                state = path[-1][2] if path else -1
                k -= 1
        found = tuple([t for _, _, t in path])
        if n <= 64:
            if len(self.words) >= WORDS:
                self.words.clear()
            self.words[word] = found
        return found


class WordBPE:
    """A tokenizer file of the kind "BPE with word ends": NFC, white space dropped, lower case, split, byte letters."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        size = max([*self.special.values(), len(self.automaton.labels) - 1]) + 1
        self.automaton.labels += [""] * (size - len(self.automaton.labels))
        for content, i in self.special.items():
            self.automaton.labels[i] = content
        self._special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        pattern = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._split = regex.compile(pattern.replace(r"[^\s", f"[^{_WHITE}"))
        self._letters = {b: c for b, c in byte_letters().items() if chr(b) != c}
        # what the plain way below can't be sure to do as the library goes through the library's own pre-split
        self._library = Tokenizer.from_file(path)

    def words(self, piece: str) -> list[str]:
        """A piece's pre-split words in byte letters."""
        if piece.isascii() or max(piece) < "\u0250" and "\u0130" not in piece and "\x85" not in piece and "\xa0" not in piece:
            found = self._split.findall(piece.lower())
            return found if piece.isascii() and piece.isprintable() else [w.encode().decode("latin-1").translate(self._letters) for w in found]
        text = self._library.normalizer.normalize_str(piece)
        return [w for w, _ in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, piece: str) -> list[int]:
        ids: list[int] = []
        for part in self._special.split(piece) if "<|" in piece else (piece,):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for word in self.words(part):
                    ids += self.automaton.encode_word(word)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: labels joined by a space, special ones included."""
        return " ".join(map(self.automaton.labels.__getitem__, ids))


def bpe_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its ids and the text they decode to: doc_id long, ids array<int>, decoded string.

    Null and empty texts have no ids and decode to the empty text; repeated rows each get a row; an
    empty table gives none. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBPE(path)
        coded = Remembering(lambda pieces: [bpe.encode(p) for p in pieces])
        for batch in sliced(batches, "text", TEXT_BYTES):
            pieces, which, starts = pieces_of(batch.column("text"))
            ids = coded(pieces)
            places = which.tolist()
            rows = [[i for k in places[a:b] for i in ids[k]] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.int32())), pa.array(map(bpe.decode, rows), pa.string())], ["doc_id", "ids", "decoded"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`bpe_table`, but digests instead of ids and text: n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBPE(path)
        numbers = [str(i) for i in range(len(bpe.automaton.labels))]

        def shown(pieces: list[str]) -> list[tuple[int, bytes, bytes]]:
            ids = [bpe.encode(p) for p in pieces]
            return [(len(x), " ".join([numbers[i] for i in x]).encode(), bpe.decode(x).encode()) for x in ids]

        coded, digest = Remembering(shown), lambda x: hashlib.sha256(x).hexdigest()
        for batch in sliced(batches, "text", TEXT_BYTES):
            pieces, which, starts = pieces_of(batch.column("text"))
            values = coded(pieces)
            counts, ids, words = ([v[k] for v in values] for k in range(3))
            n, a, b = [], [], []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                places = [k for k in which[lo:hi].tolist() if counts[k]]
                n.append(sum(map(counts.__getitem__, places)))
                a.append(digest(b" ".join(map(ids.__getitem__, places))))
                b.append(digest(b" ".join(map(words.__getitem__, places))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
