"""Arrow text columns as bytes, inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def each_bytes(texts: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text, a null as empty, one at a time."""
    for value in texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary()):
        yield value.as_py() or b""
