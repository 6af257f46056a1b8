"""Arrays of numbers as compressed bytes, for rows that are shuffled and saved. Reading them runs no code."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A level that is worth its time for what is shuffled and saved.
_CODEC = pa.Codec("zstd", compression_level=5)


def pack(*arrays) -> bytes:
    """Arrays of whole numbers from 0 (by planes of bytes, without the high planes that are all zero) and of floats."""
    head, body = [len(arrays)], []
    for x in arrays:
        x = np.asarray(x)
        if x.dtype.kind == "f":
            head += [0, len(x)]
            body.append(x.astype("<f8").tobytes())
        else:
            u = np.ascontiguousarray(x, dtype="<u8") if x.dtype.kind == "u" else x.astype("<i8").view("<u8")
            k = max(1, (int(u.max()).bit_length() + 7) // 8) if len(u) else 1
            head += [k, len(x)]
            body.append(np.ascontiguousarray(u.view(np.uint8).reshape(-1, 8)[:, :k].T).tobytes())
    raw = b"".join([np.array(head, "<i8").tobytes(), *body])
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    """What pack() was given, as 64-bit numbers: unsigned ones if the high plane is used."""
    raw = _CODEC.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    at, out = 8 + 16 * n, []
    for k, m in np.frombuffer(raw, "<i8", 2 * n, 8).reshape(-1, 2).tolist():
        if not m:
            out.append(np.empty(0, np.int64 if k else float))
        elif not k:
            out.append(np.frombuffer(raw, "<f8", m, at))
            at += 8 * m
        else:
            u = np.zeros((m, 8), np.uint8)
            u[:, :k] = np.frombuffer(raw, np.uint8, k * m, at).reshape(k, m).T
            at += k * m
            out.append(u.reshape(-1).view("<u8" if k == 8 else "<i8"))
    return out
