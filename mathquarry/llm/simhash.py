"""SimHash near-duplicate groups with bit-sliced comparison.

Fingerprints are made per document in numpy. Candidates agree in a chosen set of bits, and there are
many such choices; each is a table whose rows are dealt into buckets, packed as binary blocks.
Within a bucket the fingerprints are stored as vertical bit planes, the distances of whole rows of
64-bit lanes are counted by carry-save adders, and words whose lanes have all exceeded the radius are
abandoned. Links become components by star contraction.

Two schemes are here. EXACT: 64 bits cut into b blocks, each choice of b - 3 of them a table;
fingerprints that differ in at most three bits agree in one of the choices, so no link is missed.
WIDE: fingerprints of 256 bits, each shingle counted once, whose distance estimates the similarity of
shingle sets. Its tables look at random bits of these, as many tables as leave a pair at a similarity of
0.8 without a common key once in 200 times, and one at 0.85 once in 1,500. Distances are taken over the
first 128 bits: 0.8 is about 19 (standard deviation 4), and the radius is 34. Such pairs are only
candidates: components of them are read again, and links are made where the Jaccard similarity of the
sets of 64-bit shingle hashes is 0.8 or more.

In both, keys widen with the number of fingerprints, so that a key keeps a few rows: of n fingerprints
the WIDE scheme makes about n ** 1.3 rows of 20 bytes, instead of comparing n ** 2 pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathquarry.llm.common import SPACE, as_bytes, forget, joined, mixed_hash, sliced, texts_of, word_bounds, written
from mathquarry.llm.components import connected_components

#: Rows of a bucket, and of one key that one task compares; keys of more rows are dealt out as pairs of blocks.
BUCKET, BLOCK = 200_000, 32_768
#: Keys that are dealt out so: the block grows where there would be more of them, so that this bounds what the driver holds.
HOT = 200_000
#: Fingerprints that a task deals at once.
DEALT = 200_000
#: Keys of up to this many rows are compared side by side, larger ones each on its own.
SMALL = 128
#: Shingles of a candidate group that one task confirms; larger groups are dealt out as pairs of blocks.
CONFIRMED = 1 << 20
#: Oversized candidate groups up to this many are joined by broadcast (16 bytes each), more by a shuffle.
HOT_BROADCAST = 50_000


#: Share of pairs at the very similarity that may have no key in common.
MISSED = 0.005


@dataclass(frozen=True)
class Scheme:
    words: int  # 64-bit words of a fingerprint
    sent: int  # of these, the first ones are compared
    radius: int
    similar: tuple[int, int] | None = None  # Jaccard similarity of shingle sets that links need, as a fraction

    def masks(self, n: int) -> np.ndarray:
        """For n fingerprints: the bits in which candidates of each table agree, (tables, words)."""
        size = max(1, n).bit_length()
        if not self.similar:  # of the blocks, at most `radius` differ: no pair within the radius is missed
            blocks = self.radius + 2
            while 64 * (blocks - self.radius) < (size - 2) * blocks:
                blocks += 1
            ends = [64 * k // blocks for k in range(blocks + 1)]
            cut = [((1 << b - a) - 1) << a for a, b in zip(ends, ends[1:])]
            return np.array([[sum(x)] for x in combinations(cut, blocks - self.radius)], dtype=np.uint64)
        width, bits = max(12, size - 5), 64 * self.words
        tables = n_tables(bits, width, self.similar)
        rng = np.random.default_rng(20260103)
        chosen = [x for _ in range(-(-tables // (bits // width))) for x in np.split(rng.permutation(bits)[: bits // width * width], bits // width)]
        out = np.zeros((tables, bits), dtype=np.uint8)
        for row, x in zip(out, chosen):
            row[x] = 1
        return np.packbits(out, axis=1, bitorder="little").view("<u8")


def n_tables(bits: int, width: int, similar: tuple[int, int]) -> int:
    """Tables of ``width`` random bits that leave a share of MISSED of pairs at that similarity without a common key.

    The distance of a pair varies as a binomial; given it, the tables are as good as independent.
    """
    over, under = similar
    differ = math.acos(2 * over / (over + under)) / math.pi
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    far = range(bits - width)
    chance = np.array([math.exp(choose(bits, d) + d * math.log(differ) + (bits - d) * math.log(1 - differ)) for d in far])
    common = np.array([math.exp(choose(bits - d, width) - choose(bits, width)) for d in far])
    tables = 1
    while chance @ (1 - common) ** tables > MISSED:
        tables += 1 + tables // 50
    return tables


EXACT = Scheme(1, 1, 3)
WIDE = Scheme(4, 2, 34, (4, 5))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER[SPACE] = 0x20
#: A byte spread over eight byte lanes of one 64-bit word.
_LANES = ((np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).view(np.uint64).ravel()


def fingerprints(values: list[bytes], shingle: int = 5, words: int = 1) -> np.ndarray:
    """SimHash of each text, a row of 64-bit words: a bit is 1 if more than half of its shingle hashes have it; 0 without words.

    The first word is from XXH64 (seed 42) of the shingles, further ones from that hash mixed anew.
    """
    return _fingerprints(*shingle_hashes(values, shingle), words)


def shingle_hashes(values: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of every shingle, text by text in their order, and how many each text has."""
    data, starts = joined(values)
    first, end = word_bounds(data)
    if not len(first):
        return np.zeros(0, dtype="<u8"), np.zeros(len(values), dtype=np.int64)
    size = end - first
    space = SPACE[data]
    kept = ~space
    kept[end] = True
    text = _LOWER[data[kept]].tobytes()
    to = np.cumsum(size + 1) - 1
    at = to - size
    size = np.diff(np.searchsorted(first, starts))
    last = np.cumsum(size)
    begin = last - size
    count = np.where(size == 0, 0, np.maximum(size - shingle + 1, 1))
    live = np.flatnonzero(count)
    total = int(count.sum())
    group = np.repeat(live, count[live])
    offset = np.cumsum(count) - count
    word = begin[group] + np.arange(total) - offset[group]
    stop = np.minimum(word + shingle, last[group]) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], 42) for a, b in zip(at[word].tolist(), to[stop].tolist(), strict=True)), dtype="<u8", count=total)
    return hashes, count


def shingle_sets(values: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`shingle_hashes`, each hash once a text, in rising order."""
    hashes, count = shingle_hashes(values, shingle)
    owner = np.repeat(np.arange(len(values)), count)
    hashes = hashes[np.lexsort((hashes, owner))]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(values))


def _fingerprints(hashes: np.ndarray, count: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros((len(count), words), dtype=np.uint64)
    live = np.flatnonzero(count)
    if not len(live):
        return out
    offset = np.cumsum(count) - count
    # sums of at most 255 rows fit a byte lane; then lanes are widened and added per document
    pieces = (count[live] + 254) // 255
    owner = np.repeat(live, pieces)
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cut = offset[owner] + 255 * nth
    head = np.cumsum(pieces) - pieces
    for word_no in range(words):
        if word_no:
            hashes = mixed_hash(hashes + np.uint64(0x9E3779B97F4A7C15))
        lanes = np.empty((len(cut), 8), dtype=np.uint64)
        by_byte = hashes.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            lanes[:, k] = np.add.reduceat(_LANES[by_byte[:, k]], cut)
        ones = np.add.reduceat(lanes.view(np.uint8).astype(np.int64), head, axis=0)
        bits = ones * 2 > count[live][:, None]
        out[live, word_no] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint_table(docs: DataFrame, id_col: str, text_col: str, shingle: int, scheme: Scheme) -> DataFrame:
    """(doc_id, fp0, fp1, ..., node): node stands for what is compared; where sets of shingles count, also (alike), which stands for the set."""
    distinct, words = scheme.similar is not None, scheme.words
    names = [f"fp{k}" for k in range(words)]
    columns = ["doc_id", *names, "node", *(["alike"] if distinct else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            values = as_bytes(batch.column("text"))
            hashes, count = shingle_sets(values, shingle) if distinct else shingle_hashes(values, shingle)
            found = _fingerprints(hashes, count, words)
            made = [*(found[:, k].view(np.int64) for k in range(words)), _nodes(found[:, : scheme.sent])]
            if distinct:
                made.append(np.array([_alike(x) for x in _split(hashes, count)], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, made)], columns)

    return texts_of(docs, id_col, text_col).mapInArrow(run, ", ".join(f"{x} long" for x in columns))


def _nodes(values: np.ndarray) -> np.ndarray:
    """One 64-bit value for each row of words: the word itself, or a hash. A collision only joins candidates."""
    out = values[:, 0].copy()
    for k in range(1, values.shape[1]):
        out = mixed_hash(out) + values[:, k]
    return out.view(np.int64)


def _split(hashes: np.ndarray, count: np.ndarray) -> list[bytes]:
    """The hashes of each text as bytes."""
    data, ends = hashes.tobytes(), (np.cumsum(count) * 8).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _alike(one: bytes) -> int:
    return xxhash.xxh3_64_intdigest(one) - 2**63


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes of rows of 64-bit words; lane i of a plane (bit i % 64 of word i // 64) is that bit of row i."""
    n, words = values.shape
    padded = np.zeros((-(-n // 64) * 64, words), dtype="<u8")
    padded[:n] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(len(padded), words * 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _lanes(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1, bitorder="little").view("<u8")


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder of three planes: sum and carry."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def within(n_planes: int, differ: Callable[[int, np.ndarray], np.ndarray], live: np.ndarray, active: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Lanes of ``active`` whose distance is at most ``radius``: (words still live, their lanes).

    ``differ(p, live)`` gives the lanes that differ in plane p, for the live words (the last axis).
    Eight planes at a time run through a tree of carry-save adders; now and then, words of which all
    lanes have gone beyond the radius are abandoned.
    """
    shape = (*active.shape[:-1], len(live))
    counts = [np.zeros(shape, dtype=np.uint64) for _ in range(n_planes.bit_length())]
    active = active[..., live]
    near = active
    for g in range(0, n_planes, 8):
        x = [differ(p, live) for p in range(g, g + 8)]
        ones, a = _add(counts[0], x[0], x[1])
        ones, b = _add(ones, x[2], x[3])
        twos, c = _add(counts[1], a, b)
        ones, a = _add(ones, x[4], x[5])
        counts[0], b = _add(ones, x[6], x[7])
        counts[1], d = _add(twos, a, b)
        counts[2], carry = _add(counts[2], c, d)
        for i in range(3, len(counts)):
            counts[i], carry = counts[i] ^ carry, counts[i] & carry
        if n_planes > 64 and (g // 8) % 4 != 3:
            continue
        beyond, equal = np.zeros(shape, dtype=np.uint64), ~np.zeros(shape, dtype=np.uint64)
        for i in range(len(counts) - 1, -1, -1):
            if radius >> i & 1:
                equal = equal & counts[i]
            else:
                beyond |= equal & counts[i]
                equal = equal & ~counts[i]
        near = active & ~beyond
        some = near.any(axis=tuple(range(near.ndim - 1))) if near.ndim > 1 else near != 0
        if not some.all():
            live, active, near = live[some], active[..., some], near[..., some]
            counts = [c[..., some] for c in counts]
            shape = near.shape
            if not len(live):
                break
    return live, near


def near_pairs(values: np.ndarray, reach: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within ``radius`` bits. Row i is held against rows i+1 to i+reach[i], one shift d of all rows at a time."""
    n = len(values)
    planes = planes_of(values)
    width = planes.shape[1]
    for d in range(1, int(reach.max(initial=0)) + 1):
        open_ = np.zeros(width * 64, dtype=bool)
        open_[:n] = reach >= d
        active = _lanes(open_)
        jump, bit = divmod(d, 64)

        def differ(p: int, live: np.ndarray, jump: int = jump, bit: int = bit) -> np.ndarray:
            plane = planes[p]
            low = live + jump
            shifted = np.where(low < width, plane[np.minimum(low, width - 1)], 0)
            if bit:
                after = np.where(low + 1 < width, plane[np.minimum(low + 1, width - 1)], 0)
                shifted = (shifted >> np.uint64(bit)) | (after << np.uint64(64 - bit))
            return plane[live] ^ shifted

        live, near = within(len(planes), differ, np.flatnonzero(active), active, radius)
        if len(live):
            word, lane = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            a = live[word] * 64 + lane
            if len(a):
                yield a, a + d


def clusters(values: np.ndarray, radius: int, front: int = 64) -> np.ndarray:
    """For each row of one bucket the lowest row that a chain of links leads to.

    Breadth first: ``front`` rows at a time are held against the rows that no cluster has yet, so a
    dense bucket is done after a few passes.
    """
    n, words = values.shape
    root = np.full(n, -1)
    free = np.arange(n)
    all_bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(n, words * 8), axis=1, bitorder="little").astype(bool)
    while len(free):
        seed = int(free[0])
        root[seed] = seed
        free = free[1:]
        waiting = [np.array([seed])]
        while waiting and len(free):
            todo = np.concatenate(waiting)
            waiting = [todo[front:]] if len(todo) > front else []
            asked = all_bits[todo[:front]]
            planes = planes_of(values[free])
            open_ = np.zeros(planes.shape[1] * 64, dtype=bool)
            open_[: len(free)] = True
            active = np.broadcast_to(_lanes(open_), (len(asked), planes.shape[1]))
            flips = np.where(asked.T, np.uint64(2**64 - 1), np.uint64(0))
            live, near = within(len(planes), lambda p, live, planes=planes, flips=flips: planes[p][live][None, :] ^ flips[p][:, None], np.arange(planes.shape[1]), active, radius)
            if len(live):
                hit = np.bitwise_or.reduce(near, axis=0)
                word, lane = np.nonzero(np.unpackbits(hit.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                found = live[word] * 64 + lane
                root[free[found]] = seed
                waiting.append(free[found])
                free = np.delete(free, found)
    return root


class Forest:
    """Union of rows by vectorised hooking to the lowest root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.up[a], self.up[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(further := self.up[self.up], self.up):
                self.up = further


def _keys(values: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's masked words; what collides is only compared in vain."""
    out = np.zeros(len(values), dtype=np.uint64)
    for k in np.flatnonzero(mask):
        out = mixed_hash(out + (values[:, k] & mask[k]) + np.uint64(0x9E3779B97F4A7C15 + int(k)))
    return out


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[np.ndarray]:
    """Rows of long columns as rows of 64-bit words, about ``most`` at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1).view(np.uint64))
        n += batch.num_rows
        if n >= most:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def key_links(values: np.ndarray, keys: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) that connect what is within the radius of each other, among rows of one key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
    sizes = np.diff(ends, prepend=0)
    a, b = [], []
    for k in np.flatnonzero(sizes > SMALL).tolist():
        part = order[ends[k] - sizes[k] : ends[k]]
        root = clusters(values[part], radius)
        linked = np.flatnonzero(root != np.arange(len(root)))
        a.append(part[linked])
        b.append(part[root[linked]])
    reach = np.repeat(ends, sizes) - 1 - np.arange(len(keys))
    busy = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
    rows, reach = order[busy], reach[busy]
    forest = Forest(len(rows))
    for x, y in near_pairs(np.ascontiguousarray(values[rows]), reach, radius):
        forest.join(x, y)
    linked = np.flatnonzero(forest.up != np.arange(len(rows)))
    return np.concatenate([*a, rows[linked]]), np.concatenate([*b, rows[forest.up[linked]]])


def hot_keys(nodes: DataFrame, masks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table, key, blocks) of keys with more than BLOCK rows, in order of table and key.

    Each task reports keys that stand eight times or more among the DEALT rows that it holds at once. It
    leaves out at most seven rows a key each time, so a key that isn't found has at most that many more
    than BLOCK. At most HOT keys are found: where there would be more, longer ones only.
    """
    usual, most = 8, max(BLOCK, len(masks) * n // HOT)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values in _gathered(batches, DEALT):
            for t, mask in enumerate(masks):
                keys, rows = np.unique(_keys(values, mask), return_counts=True)
                often = rows >= usual
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(often.sum()), t, dtype=np.int32)), pa.array(keys[often].view(np.int64)), pa.array(rows[often])], ["t", "k", "n"])

    counted = nodes.mapInArrow(count, "t int, k long, n long").groupBy("t", "k").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    found = sorted((t, k % 2**64, -(-2 * n // most)) for t, k, n in counted.collect())
    return tuple(np.array([x[i] for x in found], dtype=kind) for i, kind in enumerate((np.int64, np.uint64, np.int64)))


def near_links(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """``nodes``: distinct fingerprints (fp0, fp1, ...), written. Links (a, b) of their nodes that connect all candidates within the radius."""
    n = nodes.count()
    masks = scheme.masks(n)
    hot_t, hot_k, hot_m = hot_keys(nodes, masks, n)
    hot_base = np.cumsum(hot_m * hot_m) - hot_m * hot_m
    parts = -(-n // BUCKET)

    def blocks(t: int, part: np.ndarray, keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(part, kind="stable")
        part = part[order]
        cut = np.append(0, np.flatnonzero(part[1:] != part[:-1]) + 1)
        short, whole = keys[order].astype("<u4"), np.ascontiguousarray(values[order, : scheme.sent])
        packed = [short[a:b].tobytes() + whole[a:b].tobytes() for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(part)])]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cut), t, dtype=np.int32)), pa.array(part[cut].astype(np.int64)), pa.array(packed, pa.binary())], ["t", "part", "block"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values in _gathered(batches, DEALT):
            for t, mask in enumerate(masks):
                keys = _keys(values, mask)
                plain = np.ones(len(keys), dtype=bool)
                a, b = np.searchsorted(hot_t, [t, t + 1])
                if a < b:
                    place = np.minimum(a + np.searchsorted(hot_k[a:b], keys), b - 1)
                    plain = hot_k[place] != keys
                    rows, at = np.flatnonzero(~plain), place[~plain]
                    m = hot_m[at]
                    own = (_nodes(values[rows, : scheme.sent]).view(np.uint64) % m.astype(np.uint64)).astype(np.int64)
                    for j in range(int(m.max(initial=0))):  # a row meets each block of its key once
                        some = m > j
                        low, high = np.minimum(own, j)[some], np.maximum(own, j)[some]
                        if len(low):
                            yield blocks(t, -1 - (hot_base[at[some]] + low * m[some] + high), keys[rows[some]], values[rows[some]])
                if plain.any():
                    yield blocks(t, (keys[plain] >> np.uint64(40)) % np.uint64(parts), keys[plain], values[plain])

    row = 4 + 8 * scheme.sent

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []
        bucket = None

        def links() -> pa.RecordBatch:
            short, whole = (b"".join(x) for x in zip(*held))
            held.clear()
            values = np.frombuffer(whole, dtype=np.uint64).reshape(-1, scheme.sent)
            a, b = key_links(values, np.frombuffer(short, dtype="<u4"), scheme.radius)
            names = _nodes(values)
            return pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[b])], ["a", "b"])

        for batch in batches:
            for t, part, block in zip(batch.column("t").to_pylist(), batch.column("part").to_pylist(), batch.column("block"), strict=True):
                if bucket != (t, part):
                    if held:
                        yield links()
                    bucket = (t, part)
                data = block.as_py()
                n_keys = len(data) // row * 4
                held.append((data[:n_keys], data[n_keys:]))
        if held:
            yield links()

    # partitions follow the rows, so that a task's share stays the same as the input grows
    dealt = nodes.mapInArrow(deal, "t int, part long, block binary")
    place = F.when(F.col("part") < 0, F.xxhash64("t", "part")).otherwise(F.col("t") * F.lit(parts) + F.col("part"))
    count = -(-len(masks) * n // BUCKET) + 1
    return dealt.repartitionById(count, F.pmod(place, F.lit(count).cast("long")).cast("int")).sortWithinPartitions("t", "part").mapInArrow(compare, "a long, b long")


def similar_clusters(sets: list[np.ndarray], similar: tuple[int, int]) -> np.ndarray:
    """For each set (distinct values, none empty) the lowest row that a chain of similar sets leads to.

    Breadth first: one row at a time is held against the rows that no cluster has yet.
    """
    over, under = similar
    size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    owned = np.split(place, np.cumsum(size)[:-1])
    has = np.zeros(len(values), dtype=bool)
    root = np.arange(len(sets))
    free, place, begin = root[1:].copy(), place[size[0] :], np.cumsum(size[1:]) - size[1:]
    seed, waiting = 0, [0]
    while len(free):
        at = waiting.pop()
        has[owned[at]] = True
        shared = np.add.reduceat(has[place], begin, dtype=np.int64)
        has[owned[at]] = False
        near = under * shared >= over * (size[at] + size[free] - shared)
        root[free[near]] = seed
        waiting += free[near].tolist()
        rest = ~near
        if not waiting:
            seed = int(free[0])
            waiting, rest[0] = [seed], False
        if not rest.all():
            place = place[np.repeat(rest, size[free])]
            free = free[rest]
            begin = np.cumsum(size[free]) - size[free]
    return root


def similar_links(texts: DataFrame, marked: DataFrame, groups: DataFrame, shingle: int, similar: tuple[int, int]) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) that connect all nodes of one candidate group whose shingle sets are ``similar``, and the tables that they are made from.

    ``groups``: (alike, root) of all that has candidates. Only their texts are read again, and sets are
    compared within a group, so what is linked is decided by the sets alone.
    """
    spark = texts.sparkSession
    wanted = marked.join(groups.select("alike"), "alike", "left_semi").groupBy("alike").agg(F.min("doc_id").alias("wanted")).select("wanted").distinct()

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            hashes, count = shingle_sets(as_bytes(batch.column("text")), shingle)
            some = [(_alike(x), len(x) // 8, x) for x in _split(hashes, count) if x]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in some], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["alike", "n", "shingles"])

    sets = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").mapInArrow(sets_of, "alike long, n long, shingles binary")
    rooted = written(sets.dropDuplicates(["alike"]).join(groups, "alike"), "sets")
    hot = written(rooted.groupBy("root").agg(F.sum("n").alias("n")).where(F.col("n") > CONFIRMED).select("root", F.ceil(F.col("n") * 2 / CONFIRMED).cast("int").alias("m")), "hot")
    many, zero = hot.count(), F.lit(0)
    dealt = rooted.select("root", zero.alias("i"), zero.alias("j"), "alike", "shingles")
    if many:
        j = F.col("j")
        dealt = (
            rooted.join(F.broadcast(hot) if many <= HOT_BROADCAST else hot, "root", "left")
            .withColumn("own", F.coalesce(F.pmod(F.xxhash64("alike"), F.col("m")).cast("int"), zero))
            .withColumn("j", F.explode(F.sequence(zero, F.coalesce(F.col("m"), F.lit(1)) - 1)))
            .select("root", F.least("own", j).alias("i"), F.greatest("own", j).alias("j"), "alike", "shingles")
        )

    def links(rows: list[tuple]) -> pa.RecordBatch:
        a, b, at = [], [], 0
        while at < len(rows):
            to = at + 1
            while to < len(rows) and rows[to][0] == rows[at][0]:
                to += 1
            if to - at > 1:
                for k, up in enumerate(similar_clusters([np.frombuffer(x[2], dtype="<u8") for x in rows[at:to]], similar).tolist()):
                    if up != k:
                        a.append(rows[at + k][1])
                        b.append(rows[at + up][1])
            at = to
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for *key, alike, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= CONFIRMED * 8 and key != held[-1][0]:
                    yield links(held)
                    held, size = [], 0
                held.append((key, alike, shingles))
                size += len(shingles)
        yield links(held)

    total = rooted.agg(F.sum("n")).first()[0] or 0
    return dealt.repartition(-(-2 * total // CONFIRMED) + 1, "root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(run, "a long, b long"), [rooted, hot]


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, scheme: Scheme = WIDE) -> DataFrame:
    """Near-duplicate groups of the whole table: (doc_id long, fp0, fp1, ... long, component_id long).

    Texts are lower-cased (A-Z only) and cut into words ``[^\\x20\\x09-\\x0D]+``; ``shingle`` words
    form a shingle, a shorter text is one shingle, a text without words has fingerprint zero and is
    linked like any other. Null text is empty. component_id is the smallest id that is reachable over
    links within the scheme's radius, or of the scheme's similarity if it has one (texts without words
    are then alike to each other only). Rows of the same id each get their row; a null id never becomes
    a component_id unless the group has no other id. An empty table gives no rows. Other columns,
    whatever their names, are not looked at.
    """
    marked = written(fingerprint_table(docs, id_col, text_col, shingle, scheme), "fp")
    names = [f"fp{k}" for k in range(scheme.words)]
    distinct = written(marked.select(*names).distinct(), "nodes")
    roots = written(connected_components(near_links(distinct, scheme)), "roots")
    forget(distinct)
    own = "node"
    if scheme.similar:
        # texts of one fingerprint are candidates, too, if their sets differ
        own = "alike"
        placed = marked.groupBy("alike").agg(F.first("node").alias("node")).join(roots, "node", "left").select("alike", F.coalesce("root", "node").alias("root"))
        placed = written(placed, "placed")
        some = placed.groupBy("root").count().where("count > 1").select("root")
        candidates = written(placed.join(some, "root", "left_semi"), "candidates")
        alike, used = similar_links(texts_of(docs, id_col, text_col), marked, candidates, shingle, scheme.similar)
        forget(roots)
        roots = written(connected_components(alike), "roots")
        for done in (placed, candidates, *used):
            forget(done)
    nodes = marked.groupBy(own).agg(F.min("doc_id").alias("low"))
    named = nodes.join(roots.withColumnRenamed("node", own), own, "left").select(own, "low", F.coalesce("root", own).alias("root"))
    named = written(named, "named")
    # written, so that the join with a large component can be split
    lowest = written(named.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    by_node = written(named.join(lowest, "root").select(own, "component_id"), "classes")
    for done in (named, lowest, roots):
        forget(done)
    return marked.join(by_node, own).select("doc_id", *names, "component_id")
