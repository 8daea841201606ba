"""JSON Pointers (RFC 6901) as immutable values."""

from __future__ import annotations

import re
from dataclasses import dataclass


class InvalidEscape(ValueError):
    """Not a pointer: a `~` without 0 or 1 behind it, or no leading slash."""

    def __init__(self):
        super().__init__("invalid JSON Pointer escape: ~ must be followed by 0 or 1")


class InvalidUtf8(ValueError):
    def __init__(self):
        super().__init__("JSON Pointer is not valid UTF-8")


def encode_token(segment: str) -> str:
    return segment.replace("~", "~0").replace("/", "~1")


def decode_token(token: str) -> str:
    if re.search("~(?![01])", token):
        raise InvalidEscape
    return token.replace("~1", "/").replace("~0", "~")


@dataclass(frozen=True)
class JsonPointer:
    segments: tuple[str, ...] = ()

    @classmethod
    def parse(cls, source: str | bytes | bytearray) -> JsonPointer:
        if isinstance(source, (bytes, bytearray)):
            try:
                source = source.decode()
            except UnicodeDecodeError:
                raise InvalidUtf8 from None
        if source and not source.startswith("/"):
            raise InvalidEscape
        return cls(tuple(map(decode_token, source.split("/")[1:])))

    @property
    def is_root(self) -> bool:
        return not self.segments

    def __len__(self) -> int:
        return len(self.segments)

    def push(self, segment: str) -> JsonPointer:
        return JsonPointer((*self.segments, segment))

    def pop(self) -> JsonPointer:
        return JsonPointer(self.segments[:-1])

    parent = pop

    def truncate(self, length: int) -> JsonPointer:
        return JsonPointer(self.segments[:length])

    def remove(self, index: int) -> JsonPointer:
        """Without segment index; unchanged if there is none."""
        if not 0 <= index < len(self.segments):
            return self
        return JsonPointer(self.segments[:index] + self.segments[index + 1 :])

    def segment_at(self, index: int) -> str | None:
        return self.segments[index] if 0 <= index < len(self.segments) else None

    def __str__(self) -> str:
        return "".join("/" + encode_token(s) for s in self.segments)

    def display(self) -> str:
        """The encoded pointer, or `root`."""
        return str(self) or "root"
