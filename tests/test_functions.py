import math

import pytest
from pyspark.sql import functions as F

from keyloom.functions import patterns, scalars
from keyloom.sources import binary_log, readers


@pytest.mark.parametrize(
    "pattern,text,want",
    [
        ("*", "", True), ("h?llo", "hello", True), ("h?llo", "hllo", False), ("h*o", "ho", True), ("h[ae]llo", "hallo", True),
        ("h[^e]llo", "hello", False), ("h[a-c]x", "hbx", True), ("h[c-a]x", "hbx", True), ("\\*", "*", True), ("\\*", "a", False),
        ("[abc", "b", True), ("[^", "z", True), ("[", "z", False), ("a[]b", "ab", False), ("a\\", "a\\", True), ("a.c", "abc", False),
        ("**x**", "wxyz", True), ("[\\]]", "]", True), ("[a-]", "-", True), ("x{1}", "x{1}", True), ("a\nb", "a\nb", True), ("?", "\n", True),
    ],
)
def test_glob(spark, pattern, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(patterns.glob(F.col("t"), pattern)).first()[0]
    assert got is want


def test_glob_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"\xff\x00a"),)], "t binary")
    assert df.select(patterns.glob(F.col("t"), b"??a", binary=True)).first()[0]


@pytest.mark.parametrize("start,end,want", [(-10, -10, "h"), (-10, -6, "h"), (-10, -5, "h"), (-6, -10, ""), (-5, -10, ""), (-5, -6, ""), (0, -10, "h"), (0, -6, "h"), (2, -10, ""), (-3, -1, "llo"), (-100, 2, "hel"), (2, -100, ""), (0, -1, "hello"), (-1, -1, "o"), (0, 99, "hello"), (-9999999999999, -1, "hello")])
def test_getrange(spark, start, end, want):
    from keyloom.operators import strings

    assert spark.createDataFrame([("hello",)], "v string").select(strings.getrange(F.col("v"), start, end)).first()[0] == want


def test_numbers(spark):
    values = [3.0, 1e10, -0.0, 0.1, 1e-7, 1e17, math.inf, -math.inf, 10.6, 123456.789, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(scalars.format_float(F.col("v"))).collect()]
    assert got == ["3", "10000000000", "0", "0.1", "0.0000001", "100000000000000000", "inf", "-inf", "10.6", "123456.789", None]
    texts = ["1", "007", " 1", "+5", "-9223372036854775808", "9223372036854775808", "1d", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.parse_int(F.col("t"))).collect()]
    assert got == [1, 7, None, 5, None, None, None, None, None]
    texts = ["1.5", "inf", "-INF", "nan", "1e3", " 1", "1e999", "abc"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.parse_float(F.col("t"))).collect()]
    assert got == [1.5, math.inf, -math.inf, None, 1000.0, None, None, None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in ["0", "-1", "01", "-0", "9223372036854775807", "99999999999999999999"]], "t string").select(scalars.is_canonical_int(F.col("t"))).collect()]
    assert got == [True, True, False, False, True, False]


def test_memory_sizes():
    assert [scalars.parse_memory(x) for x in ("1", "1b", "1k", "1kb", "2MB", "1g")] == [1, 1, 1024, 1000, 2_000_000, 1 << 30]
    with pytest.raises(ValueError):
        scalars.parse_memory("x")


def test_bounds():
    r = patterns.ScoreRange.parse("(1", "+inf")
    assert (r.lo, r.lo_open, r.hi) == (1.0, True, math.inf)
    with pytest.raises(ValueError):
        patterns.ScoreRange.parse("nan", 1)
    with pytest.raises(ValueError):
        patterns.LexRange.parse("a", "+")
    assert patterns.LexRange.parse("+", "-") == patterns.LexRange()


def test_inline():
    assert readers.parse_inline('SET k "a b\\x41\\n" \'it\\\'s\'') == [b"SET", b"k", b"a bA\n", b"it's"]
    with pytest.raises(ValueError):
        readers.parse_inline('GET "k')


def test_config(tmp_path, monkeypatch):
    f = tmp_path / "c"
    f.write_text("databases 8 # few\nshards 4\n")
    monkeypatch.setenv("KEYLOOM_SHARDS", "32")
    assert readers.load_config(str(f), flags={"dir": "/x"}) == {"databases": "8", "shards": "32", "dir": "/x"}


def test_binary_log(spark, tmp_path):
    assert binary_log.crc32c(b"123456789") == 0xE3069283
    for n in (8191, 8192, 8193, 70_001):
        data = bytes(i * i % 251 for i in range(n))
        crc = 0xFFFFFFFF
        for b in data:
            crc = binary_log._CRC[(crc ^ b) & 255] ^ crc >> 8
        assert binary_log.crc32c(data) == crc ^ 0xFFFFFFFF
    records = [(0, [b"SET", b"k", b"v\r\n\x00"]), (3, [b"del", b"k"])]
    data = binary_log.encode_segment(records, b"TESTLOG1", base=100)
    (tmp_path / "a.seg").write_bytes(data + b"\x05\x00")
    rows = binary_log.read_segments(spark, str(tmp_path)).orderBy("offset").collect()
    assert [(r.offset, r.db, r.verb, [bytes(a) for a in r.args]) for r in rows][0] == (100, 0, "SET", [b"k", b"v\r\n\x00"])
    assert rows[1].verb == "DEL" and rows[1].db == 3
    broken = bytearray(data)
    broken[-3] ^= 1
    assert [x[3] for x in binary_log.decode_segment(bytes(broken))] == ["ok", "corrupt"]
    assert [x[3] for x in binary_log.decode_segment(data[:-1])] == ["ok", "torn"]
    with pytest.raises(ValueError):
        binary_log.decode_args(b"*1\r\n$2\r\nabc\r\n")


