"""MessagePack, as its published specification has it, without extension types."""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of values of a fixed width, and their struct formats.
NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
#: Codes that a length follows: what they hold, and the length's format.
SIZED = {0xC4: (bytes, ">B"), 0xC5: (bytes, ">H"), 0xC6: (bytes, ">I"), 0xD9: (str, ">B"), 0xDA: (str, ">H"), 0xDB: (str, ">I"), 0xDC: (list, ">H"), 0xDD: (list, ">I"), 0xDE: (dict, ">H"), 0xDF: (dict, ">I")}
SINGLE = {0xC0: None, 0xC2: False, 0xC3: True}


def unpacked(data: bytes) -> Any:
    """The one value in ``data``; ValueError if there isn't exactly one."""
    value, end = _read(data, 0)
    if end != len(data):
        raise ValueError("bytes are left after the value")
    return value


def _read(data: bytes, at: int) -> tuple[Any, int]:
    if at >= len(data):
        raise ValueError("the value is cut short")
    code, at = data[at], at + 1
    if code <= 0x7F:
        return code, at
    if code >= 0xE0:
        return code - 0x100, at
    if code in SINGLE:
        return SINGLE[code], at
    if code in NUMBERS:
        return _number(data, at, NUMBERS[code])
    if code <= 0x8F:
        kind, size = dict, code & 0x0F
    elif code <= 0x9F:
        kind, size = list, code & 0x0F
    elif code <= 0xBF:
        kind, size = str, code & 0x1F
    elif code in SIZED:
        kind, form = SIZED[code]
        size, at = _number(data, at, form)
    else:
        raise ValueError(f"code {code:#x} has no value here")
    if kind in (bytes, str):
        if at + size > len(data):
            raise ValueError("the value is cut short")
        raw = data[at : at + size]
        return (raw if kind is bytes else raw.decode()), at + size
    items = []
    for _ in range(size * (2 if kind is dict else 1)):
        item, at = _read(data, at)
        items.append(item)
    if kind is list:
        return items, at
    if not all(isinstance(k, str) for k in items[::2]):
        raise ValueError("a key isn't text")
    return dict(zip(items[::2], items[1::2], strict=True)), at


def _number(data: bytes, at: int, form: str) -> tuple[Any, int]:
    end = at + struct.calcsize(form)
    if end > len(data):
        raise ValueError("the value is cut short")
    return struct.unpack(form, data[at:end])[0], end


def packed(value: Any) -> bytes:
    """The shortest form of a value, floats in 64 bits."""
    if value is None or isinstance(value, bool):
        return bytes([next(c for c, v in SINGLE.items() if v is value)])
    if isinstance(value, int):
        if -0x20 <= value <= 0x7F:
            return bytes([value & 0xFF])
        for code, form in NUMBERS.items():
            if form[1] in ("BHIQ" if value > 0 else "bhiq"):
                try:
                    return bytes([code]) + struct.pack(form, value)
                except struct.error:
                    continue
        raise ValueError("the number has more than 64 bits")
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, dict):
        return _head(dict, len(value), 0x80, 0x0F) + b"".join(packed(k) + packed(v) for k, v in value.items())
    if isinstance(value, list | tuple):
        return _head(list, len(value), 0x90, 0x0F) + b"".join(map(packed, value))
    if isinstance(value, str):
        raw = value.encode()
        return _head(str, len(raw), 0xA0, 0x1F) + raw
    return _head(bytes, len(value), 0, -1) + bytes(value)


def _head(kind: type, size: int, short: int, most: int) -> bytes:
    if size <= most:
        return bytes([short | size])
    code, form = next((c, f) for c, (k, f) in SIZED.items() if k is kind and size < 1 << 8 * struct.calcsize(f))
    return bytes([code]) + struct.pack(form, size)


def as_json(payload: Column) -> Column:
    """Payloads as JSON texts, binary values in base64; null where bytes aren't MessagePack."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(_json)

    return texts(payload)


def _json(data: bytes | None) -> str | None:
    try:
        return None if data is None else json.dumps(unpacked(bytes(data)), allow_nan=False, default=lambda b: base64.b64encode(b).decode())
    except (ValueError, RecursionError):
        return None
