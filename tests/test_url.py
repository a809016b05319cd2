import pytest
from pyspark.sql import functions as F

from notegrid.functions import url_fault

GOOD = """http://h https://h. HTTPS://H.Example/x http:h.example http:/h.example http:///h.example https://h:/ https://h:00080/ https://h:65535 http://u:p@h http://a@b@h
http://1.2.3.4 http://1.2.3.4. http://1.2.65535 http://16909060 http://0x1020304 http://017.0.0.1 http://0x.0x.0 http://4294967295 http://1.2.3.4.h http://256.256.256.256.a
http://[::] http://[::1] http://[1:2:3:4:5:6:7:8] http://[1:2:3:4:5:6:7::] http://[::1.2.3.4] http://[1:2:3:4:5:6:1.2.3.4]:9/ http://%68 http://h/%zz http://h?q#f http://ü.example http://a_b http://a+b
mailto:a data:, foo:// foo:///x foo://h:1/ foo://a%b foo:bar:99999 urn:a:b file: file:///x file://h/x file://C:/x file:C:/x javascript:1 a-b.c+d:x http://h/\\x ws://h wss://h:1""".split()
BAD = {
    "scheme": ["", "h", "h.example/x", "/x", "?x", ":x", "1a:x", "ü:x", "a b:x"], "host": ["http:", "http://", "http://?", "http://:80", "http://u@", "https://#x", "http://a<b", "http://a|b", "http://a^b", "http://%", "http://%20", "http://a%zz", "http://a\u007fb", "http://a b", "foo://a b", "foo://:1", "foo://u@/", "ftp:///"],
    "ipv4": ["http://1.2.3.256", "http://256.1.1.1", "http://1.2.3.4.5", "http://4294967296", "http://08", "http://1.2.3.08", "http://1..2", "http://0x100000000", "http://a.1", "http://1.2.65536", "http://99999999999999999999999999", "http://a.0x1"],
    "ipv6": ["http://[", "http://[::1", "http://[]", "http://[:]", "http://[:::]", "http://[1:2:3:4:5:6:7]", "http://[1:2:3:4:5:6:7:8:9]", "http://[1::2::3]", "http://[1:2:3:4::5:6:7:8]", "http://[12345::]", "http://[g::]", "http://[::1.2.3]", "http://[::01.2.3.4]", "http://[::1.2.3.4:5]", "http://[::256.1.1.1]", "foo://[x]"],
    "port": ["http://h:65536", "http://h:a", "http://h:8 0", "http://h:-1", "http://[::1]x", "http://[::1]:x", "http://h:999999999999", "foo://h:65536", "http://a:b:1"],
}


def faults(spark, texts):
    return [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, u string").orderBy("i").select(url_fault(F.col("u"))).collect()]


def test_good_urls(spark):
    assert [u for u, f in zip(GOOD, faults(spark, GOOD), strict=True) if f] == []


@pytest.mark.parametrize("fault", sorted(BAD))
def test_bad_urls(spark, fault):
    assert [(u, f) for u, f in zip(BAD[fault], faults(spark, BAD[fault]), strict=True) if f != fault] == []


def test_space_null_and_length(spark):
    assert faults(spark, [" \n http://h/x \u0000", "ht\ntp://h", None, "http://h/" + "x" * 1_500_000, "http://" + "a" * 1_500_000 + "<", "http://h:1\u2028", "http://1.2.3.4\u2028"]) == [None, None, None, None, "host", "port", None]
