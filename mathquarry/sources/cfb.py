"""Streams of a compound file (the public MS-CFB format), in pure Python."""

from __future__ import annotations

import struct

MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
_FREE = 0xFFFFFFFA  # from here on, sector numbers are marks


class CompoundError(ValueError):
    """Not a compound file, or a damaged one."""


def is_compound(data: bytes | None) -> bool:
    return bool(data) and data[:8] == MAGIC and len(data) >= 1536


class Compound:
    """``names()`` lists the streams in tree order; ``read(name)`` gives one. Names join storages by "/"."""

    def __init__(self, data: bytes):
        if not is_compound(data):
            raise CompoundError("no compound file")
        self.data = data
        major, _, shift, mini_shift = struct.unpack_from("<HHHH", data, 26)
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        self.wide = major > 3
        n_fat, root, _, self.cutoff, mini_fat, n_mini, difat, n_difat = self._header()
        sectors = [s for s in struct.unpack_from("<109I", data, 76) if s < _FREE]
        seen = 0
        while difat < _FREE and seen <= n_difat:
            *more, difat = struct.unpack(f"<{self.size // 4}I", self._sector(difat))
            sectors += [s for s in more if s < _FREE]
            seen += 1
        self.fat = self._numbers(b"".join(map(self._sector, sectors[: n_fat or None])))
        self.mini_fat = self._numbers(self._chain(mini_fat)) if mini_fat < _FREE and n_mini else []
        self.entries = self._directory(self._chain(root))
        top = self.entries[0]
        self.mini = self._chain(top["start"])[: top["size"]] if top["start"] < _FREE and top["size"] else b""
        self.streams: dict[str, dict] = {}
        self._list(top["child"], "", set())

    def _header(self) -> tuple[int, ...]:
        n_fat, root, mark, cutoff, mini_fat, n_mini, difat, n_difat = struct.unpack_from("<IIIIIIII", self.data, 44)
        return n_fat, root, mark, cutoff, mini_fat, n_mini, difat, n_difat

    def _sector(self, k: int) -> bytes:
        at = (k + 1) * self.size
        found = self.data[at : at + self.size]
        if not found:
            raise CompoundError(f"sector {k} is missing")
        return found.ljust(self.size, b"\0")

    @staticmethod
    def _numbers(data: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(data) // 4}I", data[: len(data) // 4 * 4]))

    def _walk(self, k: int, table: list[int]):
        seen = 0
        while k < _FREE:
            if k >= len(table) or seen > len(table):
                raise CompoundError("broken chain of sectors")
            yield k
            k, seen = table[k], seen + 1

    def _chain(self, k: int) -> bytes:
        return b"".join(map(self._sector, self._walk(k, self.fat)))

    def _directory(self, data: bytes) -> list[dict]:
        out = []
        for at in range(0, len(data) - 127, 128):
            length, kind, _, left, right, child = struct.unpack_from("<HBBIII", data, at + 64)
            start, size = struct.unpack_from("<IQ", data, at + 116)
            name = data[at : at + max(0, min(length, 64) - 2)].decode("utf-16-le", errors="replace")
            out.append({"name": name, "kind": kind, "left": left, "right": right, "child": child, "start": start, "size": size if self.wide else size & 0xFFFFFFFF})
        if not out or out[0]["kind"] != 5:
            raise CompoundError("no root entry")
        return out

    def _list(self, k: int, prefix: str, seen: set[int]) -> None:
        """In order within each storage, as names are ordered in its tree."""
        path: list[int] = []
        while path or k < len(self.entries):
            while k < len(self.entries):
                if k in seen:
                    raise CompoundError("a directory entry stands twice")
                seen.add(k)
                path.append(k)
                k = self.entries[k]["left"]
            entry = self.entries[k := path.pop()]
            if entry["kind"] == 2:
                self.streams[prefix + entry["name"]] = entry
            elif entry["kind"] == 1:
                self._list(entry["child"], prefix + entry["name"] + "/", seen)
            k = entry["right"]

    def names(self) -> list[str]:
        return list(self.streams)

    def read(self, name: str) -> bytes:
        entry = self.streams[name]
        if entry["size"] < self.cutoff:
            parts = (self.mini[k * self.mini_size : (k + 1) * self.mini_size] for k in self._walk(entry["start"], self.mini_fat)) if entry["size"] else ()
            found = b"".join(parts)
        else:
            found = self._chain(entry["start"])
        if len(found) < entry["size"]:
            raise CompoundError(f"stream {name!r} is cut off")
        return found[: entry["size"]]
