"""Key codecs ("lexicoders"): values to bytes whose unsigned order is the values' order.

Tables are ordered by their typed columns, which sort alike; bytes serve the manifests'
boundaries, ``bytes`` tables and the encode/decode API. A configuration is a name
(``"integer"``) or a name with parameters (``("tuple", "integer", "string")``).
"""

from __future__ import annotations

import datetime as dt
import math
import struct
from abc import ABC, abstractmethod

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IllegalArgument

_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)


class Codec(ABC):
    """Extension point for key types."""

    config: object
    #: Whether a column of this key sorts downwards.
    descending = False

    @abstractmethod
    def encode(self, value) -> bytes: ...

    @abstractmethod
    def decode(self, data: bytes): ...

    def column(self, value: Column) -> Column:
        """The encoded key as a BINARY column of built-in functions."""
        raise IllegalArgument(f"no column form for {self.config!r}")

    def rejects(self, value: Column) -> Column:
        """True where a column's value is no valid key."""
        return value.isNull()

    def accepts(self, kind: T.DataType) -> bool:
        return True


class BytesCodec(Codec):
    config = "bytes"

    def encode(self, value) -> bytes:
        if not isinstance(value, (bytes, bytearray)) or not value:
            raise IllegalArgument(f"not a non-empty byte string: {value!r}")
        return bytes(value)

    def decode(self, data: bytes) -> bytes:
        if not data:
            raise IllegalArgument("no bytes to decode")
        return bytes(data)

    def column(self, value: Column) -> Column:
        return value

    def rejects(self, value: Column) -> Column:
        return value.isNull() | (F.octet_length(value) == 0)

    def accepts(self, kind: T.DataType) -> bool:
        return isinstance(kind, T.BinaryType)


class StringCodec(Codec):
    def __init__(self, charset: str = "UTF-8"):
        try:
            "".encode(charset)
        except LookupError as e:
            raise IllegalArgument(f"unknown charset {charset!r}") from e
        self.charset = charset
        self.config = "string" if charset == "UTF-8" else ("string", charset)

    def encode(self, value) -> bytes:
        if not isinstance(value, str) or not value:
            raise IllegalArgument(f"not a non-empty string: {value!r}")
        return value.encode(self.charset, "replace")

    def decode(self, data: bytes) -> str:
        if not data:
            raise IllegalArgument("no bytes to decode")
        return bytes(data).decode(self.charset)

    def column(self, value: Column) -> Column:
        return F.encode(value, self.charset)

    def rejects(self, value: Column) -> Column:
        return value.isNull() | (value == "")

    def accepts(self, kind: T.DataType) -> bool:
        return isinstance(kind, T.StringType)


def _as_long(value: int) -> bytes:
    return (value & (1 << 64) - 1).to_bytes(8)


class IntegerCodec(Codec):
    """A header that holds sign and length, then the significant bytes."""

    config = "integer"

    def encode(self, value) -> bytes:
        if isinstance(value, bool) or not isinstance(value, int) or not -(1 << 63) <= value < 1 << 63:
            raise IllegalArgument(f"not a 64-bit integer: {value!r}")
        n = max(1, ((value if value >= 0 else ~value).bit_length() + 7) // 8)
        return bytes([0x7F + n if value >= 0 else 0x80 - n]) + _as_long(value)[8 - n :]

    def decode(self, data: bytes) -> int:
        if not data:
            raise IllegalArgument("no bytes to decode")
        n = data[0] - 0x7F if data[0] >= 0x80 else 0x80 - data[0]
        if len(data) != n + 1 or n > 8:
            raise IllegalArgument(f"{len(data) - 1} bytes for an integer of {n}")
        magnitude = int.from_bytes(data[1:])
        if n == 8:
            return magnitude - (1 << 64) if magnitude >> 63 else magnitude
        return magnitude if data[0] >= 0x80 else magnitude - (1 << 8 * n)

    def column(self, value: Column) -> Column:
        value = value.cast("long")
        least = F.when(value >= 0, value).otherwise(F.bitwise_not(value))
        n = F.lit(8)
        for k in range(7, 0, -1):
            n = F.when(least < (1 << 8 * k), k).otherwise(n)
        header = F.when(value >= 0, n + 0x7F).otherwise(F.lit(0x80) - n)
        digits = F.lpad(F.hex(value), 16, "0")
        return F.unhex(F.concat(F.hex(header.cast("long")), F.right(digits, 2 * n)))

    def accepts(self, kind: T.DataType) -> bool:
        return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


class FloatCodec(Codec):
    """IEEE bits as an integer, negative ones turned round; -0.0 is 0.0."""

    config = "float"

    def encode(self, value) -> bytes:
        if not isinstance(value, float) or math.isnan(value):
            raise IllegalArgument(f"not a float, or NaN: {value!r}")
        bits = struct.unpack(">q", struct.pack(">d", value or 0.0))[0]
        return IntegerCodec().encode(bits if bits >= 0 else ~bits - (1 << 63))

    def decode(self, data: bytes) -> float:
        bits = IntegerCodec().decode(data)
        bits = bits if bits >= 0 else ~(bits + (1 << 63))
        return struct.unpack(">d", _as_long(bits))[0]

    def column(self, value: Column) -> Column:
        # bits by arithmetic: powers of two and products with them are exact
        value = value.cast("double")
        size = F.abs(value)
        two = lambda n: F.pow(F.lit(2.0), n)
        guess = F.floor(F.log2(size)).cast("int")  # may be off by one
        lead = size / two(guess)
        power = guess + F.when(lead >= 2, 1).when(lead < 1, -1).otherwise(0)
        lead = size / two(power)
        normal = (power + 1023).cast("long") * F.lit(1 << 52) + ((lead - 1) * two(F.lit(52))).cast("long")
        small = (size * two(F.lit(537)) * two(F.lit(537))).cast("long")
        bits = F.when(size == float("inf"), F.lit(0x7FF << 52)).when(size < 2.0**-1022, small).otherwise(normal)
        return IntegerCodec().column(F.when(value < 0, -bits - 1).otherwise(bits))

    def rejects(self, value: Column) -> Column:
        return value.isNull() | F.isnan(value)

    def accepts(self, kind: T.DataType) -> bool:
        return isinstance(kind, (T.FloatType, T.DoubleType))


class InstantCodec(Codec):
    """Milliseconds since the epoch; finer parts are cut off, downwards."""

    config = "instant"

    def encode(self, value) -> bytes:
        if not isinstance(value, dt.datetime):
            raise IllegalArgument(f"not an instant: {value!r}")
        value = value if value.tzinfo else value.replace(tzinfo=dt.UTC)
        return IntegerCodec().encode((value - _EPOCH) // dt.timedelta(milliseconds=1))

    def decode(self, data: bytes) -> dt.datetime:
        return _EPOCH + dt.timedelta(milliseconds=IntegerCodec().decode(data))

    def column(self, value: Column) -> Column:
        return IntegerCodec().column(F.unix_millis(value.cast("timestamp")))

    def accepts(self, kind: T.DataType) -> bool:
        return isinstance(kind, (T.TimestampType, T.TimestampNTZType))


def escape(data: bytes) -> bytes:
    """No zero byte is left: 00 -> 01 01, 01 -> 01 02."""
    return data.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01")


def unescape(data: bytes) -> bytes:
    return data.replace(b"\x01\x01", b"\x00").replace(b"\x01\x02", b"\x01")


def _escape_column(value: Column) -> Column:
    # on hex digits, pair by pair
    pairs = F.regexp_replace(F.regexp_replace(F.hex(value), "(..)", "$1 "), "01 ", "01 02 ")
    return F.unhex(F.replace(F.regexp_replace(pairs, "00 ", "01 01 "), F.lit(" "), F.lit("")))


class SeqCodec(Codec):
    def __init__(self, element):
        self.element = codec(element)
        self.config = ("seq", self.element.config)

    def encode(self, value) -> bytes:
        if not isinstance(value, (list, tuple)):
            raise IllegalArgument(f"not a sequence: {value!r}")
        return b"\x00".join(escape(self.element.encode(x)) for x in value)

    def decode(self, data: bytes) -> list:
        return [self.element.decode(unescape(x)) for x in bytes(data).split(b"\x00")] if data else []

    def column(self, value: Column) -> Column:
        parts = F.transform(value, lambda x: F.hex(_escape_column(self.element.column(x))))
        return F.unhex(F.array_join(parts, "00"))

    def accepts(self, kind: T.DataType) -> bool:
        return isinstance(kind, T.ArrayType) and self.element.accepts(kind.elementType)


class TupleCodec(Codec):
    def __init__(self, *elements):
        if not elements:
            raise IllegalArgument("a tuple needs elements")
        self.elements = [codec(e) for e in elements]
        self.config = ("tuple", *(e.config for e in self.elements))

    def encode(self, value) -> bytes:
        if not isinstance(value, (list, tuple)) or len(value) != len(self.elements):
            raise IllegalArgument(f"not {len(self.elements)} values: {value!r}")
        return b"\x00".join(escape(c.encode(x)) for c, x in zip(self.elements, value))

    def decode(self, data: bytes) -> tuple:
        parts = bytes(data).split(b"\x00")
        if len(parts) != len(self.elements):
            raise IllegalArgument(f"{len(parts)} parts for {len(self.elements)} values")
        return tuple(c.decode(unescape(x)) for c, x in zip(self.elements, parts))

    def columns(self, values: list[Column]) -> Column:
        parts: list[Column] = []
        for c, v in zip(self.elements, values):
            parts += [F.lit(b"\x00"), _escape_column(c.column(v))]
        return F.concat(*parts[1:])


class ReverseCodec(Codec):
    """Flips every byte. Tables sort downwards by the value itself, which also holds where
    one key begins another (flipped bytes alone do not turn those round)."""

    def __init__(self, inner):
        self.inner = codec(inner)
        self.config = ("reverse", self.inner.config)
        self.descending = not self.inner.descending

    @staticmethod
    def _flip(data: bytes) -> bytes:
        return bytes(255 - b for b in data)

    def encode(self, value) -> bytes:
        return self._flip(self.inner.encode(value))

    def decode(self, data: bytes):
        return self.inner.decode(self._flip(data))

    def column(self, value: Column) -> Column:
        return F.unhex(F.translate(F.hex(self.inner.column(value)), "0123456789ABCDEF", "FEDCBA9876543210"))

    def rejects(self, value: Column) -> Column:
        return self.inner.rejects(value)

    def accepts(self, kind: T.DataType) -> bool:
        return self.inner.accepts(kind)


#: Codec constructors by name; add to it for further key types.
REGISTRY = {"bytes": BytesCodec, "string": StringCodec, "integer": IntegerCodec, "float": FloatCodec, "instant": InstantCodec, "seq": SeqCodec, "tuple": TupleCodec, "reverse": ReverseCodec}


def codec(config) -> Codec:
    """The codec of a configuration (or a codec itself)."""
    if isinstance(config, Codec):
        return config
    name, args = (config, ()) if isinstance(config, str) else (config[0], tuple(config[1:])) if isinstance(config, (list, tuple)) and config else (None, ())
    if not isinstance(name, str) or name not in REGISTRY:
        raise IllegalArgument(f"not a key codec: {config!r}")
    try:
        return REGISTRY[name](*args)
    except TypeError as e:
        raise IllegalArgument(f"bad parameters: {config!r}") from e


def parts_of(c: Codec) -> list[Codec]:
    """A codec for each key column."""
    return c.elements if isinstance(c, TupleCodec) else [c]


def sort_token(c: Codec, value) -> tuple:
    """What sorts in Python as the key does in the table."""
    out = []
    values = value if isinstance(c, TupleCodec) else (value,)
    for part, v in zip(parts_of(c), values):
        base = part
        while isinstance(base, ReverseCodec):
            base = base.inner
        raw = base.encode(v)
        out.append(_Down(raw) if part.descending else raw)
    return tuple(out)


class _Down:
    __slots__ = ("raw",)

    def __init__(self, raw: bytes):
        self.raw = raw

    def __lt__(self, other: _Down) -> bool:
        return self.raw > other.raw

    def __le__(self, other: _Down) -> bool:
        return self.raw >= other.raw

    def __eq__(self, other) -> bool:
        return isinstance(other, _Down) and self.raw == other.raw

    def __hash__(self) -> int:
        return hash(self.raw)


# -- the key value type -----------------------------------------------------------------


class Key:
    """An immutable byte string with unsigned order, a shorter prefix first."""

    __slots__ = ("_data",)

    def __init__(self, data: bytes):
        self._data = bytes(data)

    @classmethod
    def parse(cls, text: str) -> Key:
        return cls(bytes.fromhex(text))

    def hex(self) -> str:
        return self._data.hex()

    def __bytes__(self) -> bytes:
        return self._data

    def __eq__(self, other) -> bool:
        return isinstance(other, Key) and self._data == other._data

    def __lt__(self, other: Key) -> bool:
        return self._data < other._data

    def __le__(self, other: Key) -> bool:
        return self._data <= other._data

    def __hash__(self) -> int:
        return hash(self._data)

    def __repr__(self) -> str:
        return f"Key({self.hex()!r})"


def before(a: Key, b: Key) -> bool:
    return a < b


def after(a: Key, b: Key) -> bool:
    return b < a
