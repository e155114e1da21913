import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.errors import IllegalArgument
from vellum.functions import keys as K

LONGS = st.integers(-(2**63), 2**63 - 1)
FLOATS = st.floats(allow_nan=False)
TEXT = st.text(min_size=1, max_size=12).filter(lambda s: not any(0xD800 <= ord(c) < 0xE000 for c in s))
INSTANTS = st.datetimes(dt.datetime(1900, 1, 1), dt.datetime(2200, 1, 1)).map(lambda d: d.replace(microsecond=d.microsecond // 1000 * 1000, tzinfo=dt.UTC))
CASES = [
    ("bytes", st.binary(min_size=1, max_size=12), lambda v: v),
    ("string", TEXT, lambda v: v.encode()),
    ("integer", LONGS, lambda v: v),
    ("float", FLOATS, lambda v: v),
    ("instant", INSTANTS, lambda v: v),
    (("seq", "integer"), st.lists(LONGS, min_size=1, max_size=5), lambda v: v),
    (("tuple", "integer", "string"), st.tuples(LONGS, TEXT), lambda v: (v[0], v[1].encode())),
    (("tuple", "integer", ("tuple", "float", "instant")), st.tuples(LONGS, st.tuples(FLOATS, INSTANTS)), lambda v: v),
]


@pytest.mark.parametrize(("value", "hexed"), [(0, "8000"), (-1, "7fff"), (-0x7FFFFFFFFF000000, "788000000001000000"), (255, "80ff"), (256, "810100"), (-256, "7f00"), (-257, "7efeff")])
def test_integer_vectors(value, hexed):
    assert K.codec("integer").encode(value).hex() == hexed
    assert K.codec("integer").decode(bytes.fromhex(hexed)) == value


@pytest.mark.parametrize(("value", "hexed"), [(0.0, "8000"), (-0.0, "8000"), (1.0, "873ff0000000000000"), (-1.0, "78c00fffffffffffff")])
def test_float_vectors(value, hexed):
    assert K.codec("float").encode(value).hex() == hexed
    assert K.codec("float").decode(bytes.fromhex(hexed)) == value


def test_tuple_vector():
    c = K.codec(("tuple", "integer", "integer"))
    assert c.encode((123, 456)).hex() == "807b00810102c8" and c.decode(bytes.fromhex("807b00810102c8")) == (123, 456)


@pytest.mark.parametrize(("config", "values", "rank"), CASES, ids=lambda c: str(c)[:20])
def test_round_trip_and_order(config, values, rank):
    c = K.codec(config)

    @settings(max_examples=150, deadline=None)
    @given(values, values)
    def check(a, b):
        assert c.decode(c.encode(a)) == (tuple(a) if isinstance(a, tuple) else a)
        x, y = c.encode(a), c.encode(b)
        assert (x < y) == (rank(a) < rank(b)) and (x == y) == (rank(a) == rank(b))
        assert (K.sort_token(c, a) < K.sort_token(c, b)) == (rank(a) < rank(b))

    check()


@settings(max_examples=150, deadline=None)
@given(TEXT, TEXT)
def test_reverse_sorts_downwards_even_for_prefixes(a, b):
    c = K.codec(("reverse", "string"))
    assert c.decode(c.encode(a)) == a
    assert (K.sort_token(c, a) < K.sort_token(c, b)) == (a.encode() > b.encode())


@pytest.mark.parametrize(
    ("config", "value"),
    [("bytes", b""), ("bytes", "x"), ("string", ""), ("string", 5), ("integer", 1.0), ("integer", True), ("integer", 2**63), ("float", math.nan), ("float", 1), ("instant", "now"), (("seq", "integer"), 5), (("tuple", "integer"), (1, 2)), (("tuple", "integer", "integer"), 1)],
)
def test_rejects(config, value):
    with pytest.raises(IllegalArgument):
        K.codec(config).encode(value)


@pytest.mark.parametrize("config", ["nothing", (), None, 5, ("tuple",), ("seq",), ("integer", 1), ("string", "no-such-charset")])
def test_bad_configs(config):
    with pytest.raises(IllegalArgument):
        K.codec(config)


@pytest.mark.parametrize("data", [b"", b"\x81\x01", b"\x80"])
def test_truncated(data):
    with pytest.raises(IllegalArgument):
        K.codec("integer").decode(data)


def test_columns_as_the_codecs(spark):
    longs = [0, 1, -1, 255, 256, -256, -257, 2**31, -(2**63), 2**63 - 1, 65535, 65536]
    df = spark.createDataFrame([(v, f"é{v}") for v in longs], "i long, s string")
    rows = df.select("i", "s", K.codec("integer").column(F.col("i")).alias("ki"), K.codec(("reverse", "integer")).column(F.col("i")).alias("kr"), K.codec(("tuple", "integer", "string")).columns([F.col("i"), F.col("s")]).alias("kt")).collect()
    for r in rows:
        assert bytes(r.ki) == K.codec("integer").encode(r.i)
        assert bytes(r.kr) == K.codec(("reverse", "integer")).encode(r.i)
        assert bytes(r.kt) == K.codec(("tuple", "integer", "string")).encode((r.i, r.s))


def test_key_values():
    a, b = K.Key(b"\x01"), K.Key(b"\x01\x00")
    assert K.before(a, b) and K.after(b, a) and min(a, b) == a and max(a, b) == b
    assert K.Key.parse("0100") == b and b.hex() == "0100" and repr(b) == "Key('0100')" and len({b, K.Key.parse("0100")}) == 1


def test_column_form_of_floats_and_sequences(spark):
    import random
    import struct

    rnd = random.Random(5)
    floats = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, math.inf, -math.inf, 0.1, 2.0, 1.9999999999999998]
    floats += [x for x in (struct.unpack(">d", rnd.randbytes(8))[0] for _ in range(500)) if not math.isnan(x)]
    floats += [2.0**k * f for k in range(-1060, 1023, 37) for f in (1, 1 - 2**-53, 1 + 2**-52)]
    c = K.codec("float")
    rows = spark.createDataFrame([(x,) for x in floats], "x double")
    assert [(r.x, bytes(r.k)) for r in rows.select("x", c.column(rows.x).alias("k")).collect()] == [(x, c.encode(x)) for x in floats]
    c, lists = K.codec(("seq", "integer")), [[1, 256, -1, 0], [7], []]
    rows = spark.createDataFrame([(x,) for x in lists], "x array<long>")
    assert [bytes(r.k) for r in rows.select(c.column(rows.x).alias("k")).collect()] == [c.encode(x) for x in lists]
