"""The Ogg checksum: CRC-32 with polynomial 0x04c11db7, most significant bit first, from 0, without a final xor.

It is the mirror of the common CRC-32, so bytes are mirrored, the C routine does the work, and the result
is mirrored back.
"""

from __future__ import annotations

import zlib

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def ogg_crc(data: bytes) -> int:
    """The checksum; the C routine's own complements are undone on both sides."""
    reflected = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{reflected:032b}"[::-1], 2)
