"""White-space pieces of many texts, each distinct piece once.

The tokenizers here never join anything across white space, so a text's tokens are those of its
pieces one after the other, and only a slice's distinct pieces need to be encoded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from mathquarry.llm.common import lengths

#: Distinct pieces that a worker remembers at least, and half of what it remembers at most.
REMEMBERED = 90_000
_MARK = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}])([.,])(?:[ \t\n\v\f\r]|$)"


#: Bytes of text whose pieces are told apart at once; more text repeats more of its pieces.
TEXT_BYTES = 6_000_000


def pieces_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct pieces, which one stands at each place, where each text begins among the places).

    For tokenizers that lower-case and end a token between a letter and a comma or full stop, pieces
    are told apart after that, so fewer are distinct: A-Z is lowered (unless a "<|" in the texts may
    begin a special token, which is taken as written) and such a mark at a word's end stands alone.
    """
    filled = pc.fill_null(texts, "")
    if not pc.any(pc.match_substring(filled, "<|")).as_py():
        filled = pc.ascii_lower(filled)
    filled = pc.replace_substring_regex(filled, _MARK, r"\1 \2 ")
    split = pc.ascii_split_whitespace(filled)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), out=starts[1:])
    coded = pc.dictionary_encode(split.flatten())
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), starts


class Remembering:
    """``encode`` maps new pieces to values; known ones come from memory.

    Memory has a bound: when the young generation is full it becomes the old one, which is dropped
    then, and what is used again moves to the young one. Very long pieces are not remembered.
    """

    def __init__(self, encode: Callable[[list[str]], list], most: int = REMEMBERED):
        self.encode, self.most, self.young, self.old = encode, most, {}, {}

    def __call__(self, pieces: list[str]) -> list:
        young = self.young
        missing = [p for p in pieces if p not in young]
        beside = {}
        if missing:
            old = self.old
            again = {p: old[p] for p in missing if p in old}
            young.update(again)
            new = [p for p in missing if p not in again]
            for p, value in zip(new, self.encode(new), strict=True):
                (young if len(p) <= 64 else beside)[p] = value
        found = [young[p] if p in young else beside[p] for p in pieces] if beside else list(map(young.__getitem__, pieces))
        if len(young) > self.most:
            self.young, self.old = {}, young
        return found


def ragged(values: list[bytes], which: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values (packed uint32) of the places in one array, and where each text begins in it."""
    sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
    flat = np.frombuffer(b"".join(values), dtype=np.uint32)
    base = np.cumsum(sizes) - sizes
    n = sizes[which]
    ends = np.cumsum(n)
    out = flat[np.repeat(base[which] - (ends - n), n) + np.arange(int(n.sum()))]
    return out, np.append(0, ends)[starts]


__all__ = ["Remembering", "lengths", "pieces_of", "ragged"]
