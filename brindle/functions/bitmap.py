"""Sets of row addresses, held by containers of 65,536 values: sorted places where sparse, bits where dense."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_DENSE = 4096  # places of a container above which it is bits


class Bitmap:
    def __init__(self, values: Iterable[int] = ()):
        self.parts: dict[int, np.ndarray] = {}  # high bits -> bool array of 65,536, or sorted uint16 places
        self.update(values)

    @classmethod
    def of_range(cls, start: int, stop: int) -> "Bitmap":
        return cls(np.arange(start, stop, dtype=np.int64))

    @staticmethod
    def _bits(part: np.ndarray | None) -> np.ndarray:
        if part is not None and part.dtype == bool:
            return part.copy()
        bits = np.zeros(65_536, bool)
        if part is not None:
            bits[part] = True
        return bits

    def _put(self, high: int, bits: np.ndarray) -> None:
        n = int(bits.sum())
        if n:
            self.parts[high] = bits if n > _DENSE else np.flatnonzero(bits).astype(np.uint16)
        else:
            self.parts.pop(high, None)

    def update(self, values: Iterable[int]) -> None:
        x = np.unique(np.fromiter(values, np.int64) if not isinstance(values, np.ndarray) else values.astype(np.int64))
        if len(x) and x[0] < 0:
            raise ValueError("a bitmap holds numbers of at least 0")
        for high in np.unique(x >> 16).tolist():
            bits = self._bits(self.parts.get(high))
            bits[x[(x >> 16) == high] & 0xFFFF] = True
            self._put(high, bits)

    def add(self, value: int) -> None:
        self.update([value])

    def discard(self, value: int) -> None:
        high = value >> 16
        if high in self.parts:
            bits = self._bits(self.parts[high])
            bits[value & 0xFFFF] = False
            self._put(high, bits)

    def __contains__(self, value: int) -> bool:
        part = self.parts.get(value >> 16)
        return part is not None and bool(part[value & 0xFFFF] if part.dtype == bool else np.any(part == (value & 0xFFFF)))

    def __len__(self) -> int:
        return sum(int(p.sum()) if p.dtype == bool else len(p) for p in self.parts.values())

    def __iter__(self) -> Iterator[int]:
        for high in sorted(self.parts):
            part = self.parts[high]
            yield from ((high << 16) + (np.flatnonzero(part) if part.dtype == bool else part).astype(np.int64)).tolist()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Bitmap) and self.parts.keys() == other.parts.keys() and all((self._bits(self.parts[k]) == self._bits(other.parts[k])).all() for k in self.parts)

    __hash__ = None

    def _with(self, other: "Bitmap", keys: Iterable[int], op) -> "Bitmap":
        out = Bitmap()
        for high in keys:
            out._put(high, op(self._bits(self.parts.get(high)), self._bits(other.parts.get(high))))
        return out

    def __or__(self, other: "Bitmap") -> "Bitmap":
        return self._with(other, self.parts.keys() | other.parts.keys(), np.logical_or)

    def __and__(self, other: "Bitmap") -> "Bitmap":
        return self._with(other, self.parts.keys() & other.parts.keys(), np.logical_and)

    def __sub__(self, other: "Bitmap") -> "Bitmap":
        return self._with(other, self.parts.keys(), lambda a, b: a & ~b)

    def __xor__(self, other: "Bitmap") -> "Bitmap":
        return self._with(other, self.parts.keys() | other.parts.keys(), np.logical_xor)

    def dumps(self) -> bytes:
        """Number of containers; for each its high bits, kind and size, then its places or bits. Little-endian."""
        out = [len(self.parts).to_bytes(4, "little")]
        for high in sorted(self.parts):
            part = self.parts[high]
            dense = part.dtype == bool
            body = np.packbits(part, bitorder="little").tobytes() if dense else part.astype("<u2").tobytes()
            out += [high.to_bytes(6, "little"), bytes([dense]), len(body).to_bytes(4, "little"), body]
        return b"".join(out)

    @classmethod
    def loads(cls, data: bytes) -> "Bitmap":
        out, at = cls(), 4
        for _ in range(int.from_bytes(data[:4], "little")):
            high, dense, n = int.from_bytes(data[at : at + 6], "little"), data[at + 6], int.from_bytes(data[at + 7 : at + 11], "little")
            body = np.frombuffer(data[at + 11 : at + 11 + n], np.uint8)
            out.parts[high] = np.unpackbits(body, bitorder="little").astype(bool) if dense else body.view("<u2").astype(np.uint16)
            at += 11 + n
        return out

    def fragments(self) -> set[int]:
        """Numbers of the fragments that the addresses lie in."""
        return {high >> 16 for high in self.parts}

    def to_df(self, spark):
        """(_rowaddr), to be an allow or block list of a scan."""
        return spark.createDataFrame([(v,) for v in self], "_rowaddr long")


def remap(addresses: Bitmap, moved: dict[int, int | None]) -> Bitmap:
    """The addresses after rows moved: an old address to its new one, or None where its row is gone; others stay."""
    return Bitmap(v for a in addresses if (v := moved.get(a, a)) is not None)
