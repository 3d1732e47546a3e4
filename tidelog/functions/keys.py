"""Order of node keys with arguments of any JSON type, and arguments in URL paths."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path segments with these beginnings are JSON, or a text that begins with the mark itself.
JSON_MARK, TEXT_MARK = "~", "~~"


def _text_bytes(text: str) -> bytes:
    """UTF-16 units behind a mark each, then an end that is smaller than any mark."""
    units = text.encode("utf-16-be", "surrogatepass")
    return b"".join(b"\x01" + units[i : i + 2] for i in range(0, len(units), 2)) + b"\x00"


def value_bytes(value: object) -> bytes:
    """Bytes that sort as the values do: null, booleans, numbers, texts by UTF-16 units, arrays, objects by their sorted entries."""
    if value is None:
        return b"\x00"
    if isinstance(value, bool):
        return b"\x01" + bytes([value])
    if isinstance(value, (int, float)):
        bits = struct.unpack(">Q", struct.pack(">d", float(value) + 0.0))[0]
        return b"\x02" + struct.pack(">Q", bits ^ (0xFFFFFFFFFFFFFFFF if bits >> 63 else 1 << 63))
    if isinstance(value, str):
        return b"\x03" + _text_bytes(value)
    if isinstance(value, list):
        return b"\x04" + b"".join(b"\x01" + value_bytes(v) for v in value) + b"\x00"
    entries = sorted(((_text_bytes(k), v) for k, v in value.items()), key=lambda e: e[0])
    return b"\x05" + b"".join(b"\x01" + k + value_bytes(v) for k, v in entries) + b"\x00"


def node_order(head: Column, args: Column) -> Column:
    """Binary sort key of nodes: by head, number of arguments, then argument by argument; ``args`` is the text of a JSON array.

    Spark orders the key by its bytes, so a sort by it is distributed like any other.
    The key of a null or malformed array is null.
    """

    def keys(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for heads, arrays in batches:
            out = []
            for h, a in zip(heads, arrays):
                try:
                    values = json.loads(a, parse_int=float) if h is not None and a is not None else None
                except ValueError:
                    values = None
                out.append(_text_bytes(h) + struct.pack(">I", len(values)) + b"".join(map(value_bytes, values)) if isinstance(values, list) else None)
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(keys, "binary")(head, args)


def url_arguments(path: Column) -> Column:
    """Arguments in a raw URL path (what follows the head), as an array of JSON texts.

    Segments are percent-decoded, which keeps encoded slashes within arguments. Empty
    texts are left out. A segment that is no JSON behind its mark gives null.
    """

    def argument(s: Column) -> Column:
        rest = F.substr(s, F.lit(2))
        text = lambda t: F.regexp_extract(F.to_json(F.array(t)), r"(?s)\A\[(.*)\]\z", 1)
        parsed = F.when(F.try_parse_json(rest).isNotNull(), rest)
        return F.when(F.startswith(s, F.lit(TEXT_MARK)), text(rest)).when(F.startswith(s, F.lit(JSON_MARK)), parsed).otherwise(text(s))

    decoded = F.transform(F.split(path, "/", -1), lambda s: F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))))
    return F.filter(F.transform(decoded, argument), lambda a: a.isNull() | (a != '""'))
