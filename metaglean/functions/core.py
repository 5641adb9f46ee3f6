"""Errors, options and byte helpers of the format handlers (no Spark here)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import NamedTuple


class MetaError(Exception):
    """Base of the errors that handlers raise; ``offset`` is a byte position or None."""

    def __init__(self, message: str, offset: int | None = None):
        super().__init__(message)
        self.offset = offset


class InvalidFormat(MetaError):
    pass


class Corrupted(MetaError):
    pass


class OutOfBounds(MetaError):
    pass


class Unsupported(MetaError):
    pass


class BoxError(MetaError):
    pass


class SvgError(MetaError):
    pass


class Row(NamedTuple):
    """One structure row of a file: a segment, chunk, block, tag or box."""

    seq: int
    parent_seq: int | None
    depth: int
    kind: str
    offset: int
    size: int
    data_offset: int
    data_size: int
    attrs: dict[str, str]


FLAG_OF_FIELD = {"Orientation": "orientation", "ICC Profile": "color_profile", "Copyright": "copyright", "Title": "title", "Description": "description"}


@dataclass(frozen=True)
class Options:
    """What a removal keeps, removes, redacts and injects."""

    orientation: bool = False
    color_profile: bool = False
    copyright: bool = False
    title: bool = False
    description: bool = False
    remove: tuple[str, ...] = ()
    keep: tuple[str, ...] = ()
    gps_redact: str | None = None
    inject: dict[str, str] = field(default_factory=dict)
    pdf_password: str | None = None

    def resolved(self) -> Options:
        """Field lists turned into flags: a deny list keeps all other known fields, an allow list adds to what is kept."""
        on = {f for n, f in FLAG_OF_FIELD.items() if (self.remove and n not in self.remove) or n in self.keep}
        return replace(self, **{f: True for f in on}) if on else self


def u16(d: bytes, o: int, le: bool = False) -> int:
    if o < 0 or o + 2 > len(d):
        raise OutOfBounds("read past the end", o)
    return int.from_bytes(d[o : o + 2], "little" if le else "big")


def u32(d: bytes, o: int, le: bool = False) -> int:
    if o < 0 or o + 4 > len(d):
        raise OutOfBounds("read past the end", o)
    return int.from_bytes(d[o : o + 4], "little" if le else "big")


def put16(x: int, le: bool = False) -> bytes:
    return x.to_bytes(2, "little" if le else "big")


def put32(x: int, le: bool = False) -> bytes:
    return x.to_bytes(4, "little" if le else "big")


def latin(d: bytes, o: int = 0, n: int | None = None) -> str:
    return bytes(d[o:] if n is None else d[o : o + n]).decode("latin-1")


def unique(names: list[str]) -> list[str]:
    """Distinct names in the order of their first appearance."""
    return list(dict.fromkeys(names))


def blank(d: bytearray, start: int, end: int, with_byte: int = 0) -> None:
    end = min(end, len(d))
    if end > start:
        d[start:end] = bytes([with_byte]) * (end - start)
