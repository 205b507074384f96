"""The range coder (RFC 6716, section 4.1): a pure encoder and decoder over 32-bit arithmetic in Python integers.

Symbols are ``(low, high, total)`` of a frequency table; raw bits are kept at the end of the buffer.  The
encoder carries through runs of 255; ``finish`` pads to the size asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

_TOP, _BOTTOM, _MASK = 1 << 31, 1 << 23, 0xFFFFFFFF


class Encoder:
    def __init__(self) -> None:
        self.low, self.range = 0, _TOP
        self.held, self.run = -1, 0
        self.out = bytearray()
        self.tail = bytearray()
        self.window, self.n_window, self.total_bits = 0, 0, 33

    def _carry(self, symbol: int) -> None:
        if symbol == 255:
            self.run += 1
            return
        carry = symbol >> 8
        if self.held >= 0:
            self.out.append(self.held + carry & 255)
        self.out += bytes([255 + carry & 255]) * self.run
        self.run = 0
        self.held = symbol & 255

    def _normalise(self) -> None:
        while self.range <= _BOTTOM:
            self._carry(self.low >> 23)
            self.low = (self.low << 8) & (_TOP - 1)
            self.range = (self.range << 8) & _MASK
            self.total_bits += 8

    def encode(self, low: int, high: int, total: int) -> None:
        unit = self.range // total
        if low > 0:
            self.low += self.range - unit * (total - low)
            self.range = unit * (high - low)
        else:
            self.range -= unit * (total - high)
        self._normalise()

    def bit_logp(self, bit: int, logp: int) -> None:
        """A bit that is 1 with probability ``2**-logp``."""
        part = self.range >> logp
        if bit:
            self.low += self.range - part
            self.range = part
        else:
            self.range -= part
        self._normalise()

    def icdf(self, symbol: int, table: Sequence[int], bits: int) -> None:
        """``table``: falling complements of the cumulative frequencies, of ``2**bits``."""
        unit = self.range >> bits
        if symbol > 0:
            self.low += self.range - unit * table[symbol - 1]
            self.range = unit * (table[symbol - 1] - table[symbol])
        else:
            self.range -= unit * table[symbol]
        self._normalise()

    def uniform(self, value: int, total: int) -> None:
        """A value below ``total``: the top 8 bits coded, the rest raw."""
        bits = max(0, (total - 1).bit_length() - 8)
        if bits:
            top = ((total - 1) >> bits) + 1
            self.encode(value >> bits, (value >> bits) + 1, top)
            self.raw(value & (1 << bits) - 1, bits)
        else:
            self.encode(value, value + 1, total)

    def raw(self, value: int, bits: int) -> None:
        self.window |= value << self.n_window
        self.n_window += bits
        while self.n_window >= 8:
            self.tail.append(self.window & 255)
            self.window >>= 8
            self.n_window -= 8
        self.total_bits += bits

    def tell(self) -> int:
        """Bits used so far, rounded up."""
        return self.total_bits - self.range.bit_length()

    def finish(self, size: int | None = None) -> bytes:
        """The shortest end that decodes alike whatever follows; padded with zeros between the two ends."""
        bits = 32 - self.range.bit_length()
        mask = (_TOP - 1) >> bits
        end = (self.low + mask) & ~mask & _MASK
        if end | mask >= self.low + self.range:
            bits, mask = bits + 1, mask >> 1
            end = (self.low + mask) & ~mask & _MASK
        while bits > 0:
            self._carry(end >> 23)
            end = (end << 8) & (_TOP - 1)
            bits -= 8
        if self.held >= 0 or self.run:
            self._carry(0)
        if self.n_window:
            self.tail.append(self.window & 255)
        head = bytes(self.out)
        while size is None and head.endswith(b"\0") and not self.tail:
            head = head[:-1]
        gap = 0 if size is None else size - len(head) - len(self.tail)
        if gap < 0:
            raise ValueError("the buffer is too small")
        return head + b"\0" * gap + bytes(reversed(self.tail))


class Decoder:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.end = data, 0, len(data)
        self.range, self.total_bits = 128, 9
        self.rem = self._next()
        self.value = 127 - (self.rem >> 1)
        self.window, self.n_window = 0, 0
        self._normalise()

    def _next(self) -> int:
        b = self.data[self.at] if self.at < len(self.data) else 0
        self.at += 1
        return b

    def _normalise(self) -> None:
        while self.range <= _BOTTOM:
            self.total_bits += 8
            self.range <<= 8
            last, self.rem = self.rem, self._next()
            symbol = (last << 8 | self.rem) >> 1 & 255
            self.value = (self.value << 8) + (255 - symbol) & (_TOP - 1)

    def frequency(self, total: int) -> int:
        """Where in ``total`` the next symbol lies; ``take`` must follow."""
        self.unit = self.range // total
        return total - min(self.value // self.unit + 1, total)

    def take(self, low: int, high: int, total: int) -> None:
        rest = self.unit * (total - high)
        self.value -= rest
        self.range = self.unit * (high - low) if low > 0 else self.range - rest
        self._normalise()

    def bit_logp(self, logp: int) -> int:
        part = self.range >> logp
        bit = int(self.value < part)
        if bit:
            self.range = part
        else:
            self.value -= part
            self.range -= part
        self._normalise()
        return bit

    def icdf(self, table: Sequence[int], bits: int) -> int:
        unit = self.range >> bits
        symbol, high = 0, self.range
        low = unit * table[0]
        while self.value < low:
            symbol += 1
            high, low = low, unit * table[symbol]
        self.value -= low
        self.range = high - low
        self._normalise()
        return symbol

    def uniform(self, total: int) -> tuple[int, bool]:
        """``(value, in range)``; a value out of range saturates."""
        bits = max(0, (total - 1).bit_length() - 8)
        if not bits:
            v = self.frequency(total)
            self.take(v, v + 1, total)
            return v, True
        top = ((total - 1) >> bits) + 1
        v = self.frequency(top)
        self.take(v, v + 1, top)
        v = v << bits | self.raw(bits)
        return (v, True) if v < total else (total - 1, False)

    def raw(self, bits: int) -> int:
        while self.n_window < bits:
            self.end -= 1
            self.window |= (self.data[self.end] if self.end >= 0 else 0) << self.n_window
            self.n_window += 8
        value = self.window & (1 << bits) - 1
        self.window >>= bits
        self.n_window -= bits
        self.total_bits += bits
        return value

    def tell(self) -> int:
        return self.total_bits - self.range.bit_length()


