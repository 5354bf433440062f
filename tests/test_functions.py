import pytest
from pyspark.sql import functions as F

from gossamer import terms as T
from gossamer.functions.registry import BUILTINS, Arg, get
from gossamer.terms import SWAP, lit, seq, xsd

FN = "http://www.w3.org/2006/xpath-functions#"


def i(n):
    return xsd(n, "integer")


def subject(x):
    return Arg(items=[subject(y) for y in x]) if isinstance(x, tuple) else Arg(F.lit(x))


def L(*items):  # noqa: N802
    return seq("L", list(items))


def S(*items):  # noqa: N802
    return seq("S", list(items))


FORWARD = [
    ("math#sum", (i(1), i(2), xsd("3.5", "decimal")), xsd("6.5", "decimal")),
    ("math#sum", (), i(0)),
    ("math#sum", (i(1), lit("x")), None),
    ("math#product", (i(3), i(4)), i(12)),
    ("math#difference", (i(3), i(5)), i(-2)),
    ("math#difference", (i(3),), None),
    ("math#quotient", (i(7), i(2)), xsd("3.5", "double")),
    ("math#quotient", (i(7), i(0)), None),
    ("math#integerQuotient", (i(-7), i(2)), i(-4)),
    ("math#remainder", (i(7), i(-3)), i(-2)),
    ("math#remainder", (i(-7), i(3)), i(2)),
    ("math#remainder", (i(7), i(0)), None),
    ("math#exponentiation", (i(2), i(10)), i(1024)),
    ("math#bit", (i(5), i(2)), i(1)),
    ("math#negation", i(3), i(-3)),
    ("math#absoluteValue", i(-3), i(3)),
    ("math#rounded", xsd("-2.5", "decimal"), xsd("-3.0", "double")),
    ("math#memberCount", (i(1), i(2)), i(2)),
    ("math#cos", i(0), xsd("1.0", "double")),
    ("maths#sum", (lit("1"), lit("2.0")), lit("3")),
    ("maths#quotient", (lit("6"), lit("2")), lit("3")),
    ("string#concatenation", (lit("a"), i(1)), lit("a1")),
    ("string#scrape", (lit("abc123"), lit("([0-9]+)")), lit("123")),
    ("string#scrape", (lit("abc"), lit("([0-9]+)")), None),
    ("string#search", (lit("k=v"), lit("(.)=(.)")), L(lit("k"), lit("v"))),
    ("string#split", (lit("a,b,c"), lit(","), i(1)), L(lit("a"), lit("b,c"))),
    ("string#format", (lit("%s-%03d"), lit("x"), i(7)), lit("x-007")),
    ("string#encodeForURI", lit("a b/é~"), lit("a%20b%2F%C3%A9~")),
    ("string#xmlEscapeData", lit("a<b&c"), lit("a&#60;b&#38;c")),
    ("string#xmlEscapeAttribute", lit('"'), lit("&#34;")),
    ("string#stringToList", lit("abc"), L(lit("a"), lit("b"), lit("c"))),
    ("time#inSeconds", lit("1970-01-02T00:00:00+05:30"), i(66600)),
    ("time#inSeconds", lit("no date"), None),
    ("time#month", lit("2024-03-01T01:02:03Z"), i(3)),
    ("time#dayOfWeek", lit("1970-01-01"), i(3)),
    ("time#format", (lit("2024-03-01T01:02:03Z"), lit("%Y/%m at %H")), lit("2024/03 at 01")),
    ("time#timeZone", lit("2024-03-01T01:02:03-05:00"), lit("-05:00")),
    ("time#parseToSeconds", (lit("1970/01/02"), lit("%Y/%m/%d")), i(86400)),
    ("times#formatSeconds", (i(0), lit("%Y")), lit("1970")),
    ("list#last", (i(1), i(2)), i(2)),
    ("list#append", ((i(1),), (i(2), i(3))), L(i(1), i(2), i(3))),
    ("list#members", (i(2), i(1), i(2)), S(i(1), i(2))),
    ("set#union", (S(i(1)), S(i(2))), S(i(1), i(2))),
    ("set#intersection", (S(i(1), i(2)), S(i(2))), S(i(2))),
    ("set#difference", (S(i(1), i(2)), S(i(2))), S(i(1))),
    ("set#symmetricDifference", (S(i(1), i(2)), S(i(2), i(3))), S(i(1), i(3))),
    ("crypto#md5", lit("a"), lit("0cc175b9c0f1b6a831c399e269772661")),
    ("log#uri", "<http://a#b>", lit("http://a#b")),
    ("log#racine", "<http://a#b>", "<http://a>"),
    ("log#rawType", i(1), f"<{T.LOG}Literal>"),
    ("sparqlCwm#dtLit", (lit("1"), "<http://x>"), '"1"^^<http://x>'),
    ("sparqlCwm#langLit", (lit("a"), lit("en")), '"a"@en'),
    ("xml#nodeName", lit("<a><b/>t</a>"), lit("a")),
    ("xml#nodeValue", lit("<a><b/>t</a>"), lit("t")),
    ("xml#namespaceURI", lit("<a xmlns='u:n'/>"), lit("u:n")),
    ("xml#hasChildNodes", lit("<a/>"), xsd("false", "boolean")),
    (FN + "substring", (lit("12345"), xsd("1.5", "decimal"), xsd("2.6", "decimal")), lit("234")),
    (FN + "substring", (lit("12345"), i(4)), lit("45")),
    (FN + "string-length", lit("abc"), i(3)),
    (FN + "compare", (lit("a"), lit("b")), i(-1)),
    (FN + "string-join", ((lit("a"), lit("b")), lit("-")), lit("a-b")),
    (FN + "translate", (lit("bar"), lit("abc"), lit("AB")), lit("BAr")),
    (FN + "replace", (lit("aaa"), lit("a"), lit("b")), lit("bbb")),
    (FN + "substring-before", (lit("tattoo"), lit("attoo")), lit("t")),
    (FN + "substring-after", (lit("tattoo"), lit("tat")), lit("too")),
    (FN + "normalize-space", lit(" a  b "), lit("a b")),
    (FN + "codepoints-to-string", (i(97), i(8364)), lit("a€")),
    (FN + "string-to-codepoints", lit("a€"), L(i(97), i(8364))),
    (FN + "normalize-unicode", (lit("é"), lit("NFC")), lit("é")),
    (FN + "iri-to-uri", lit("http://a/é"), lit("http://a/%C3%A9")),
    (FN + "escape-html-uri", lit("a é"), lit("a %C3%A9")),
    (FN + "resolve-uri", (lit("b"), lit("http://x/a")), lit("http://x/b")),
    (FN + "round-half-to-even", xsd("-2.5", "decimal"), xsd("-2.0", "double")),
    (FN + "codepoint-equal", (lit("a"), lit("a")), xsd("true", "boolean")),
]
REVERSE = [
    ("math#sumOf", L(i(1), i(2)), i(3)),
    ("math#negation", i(4), i(-4)),
    ("string#concat", L(lit("a"), lit("b")), lit("ab")),
    ("string#concat", L(lit("a"), "<b>"), None),
    ("log#uri", lit("http://a"), "<http://a>"),
    ("log#uri", lit("no colon"), None),
    ("time#inSeconds", i(0), lit("1970-01-01T00:00:00Z")),
    ("sparqlCwm#dtLit", i(1), L(lit("1"), f"<{T.XSD}integer>")),
    ("set#oneOf", L(i(2), i(1)), S(i(1), i(2))),
]
TESTS = [
    ("math#greaterThan", i(10), i(9), True),
    ("math#equalTo", i(1), xsd("1.0", "decimal"), True),
    ("log#equalTo", i(1), xsd("1.0", "decimal"), False),
    ("string#lessThan", lit("a"), lit("b"), True),
    ("string#containsRoughly", lit("A  \n b c"), lit("a b"), True),
    ("string#notMatches", lit("abc"), lit("^b"), True),
    ("list#in", i(1), L(i(1), i(2)), True),
    ("time#equalTo", lit("2024-01-01T01:00:00+01:00"), lit("2024-01-01T00:00:00Z"), True),
    ("sparqlCwm#equals", i(1), xsd("1.0", "double"), True),
    ("sparqlCwm#equals", lit("a"), lit("a", lang="en"), False),
    ("sparqlCwm#lessThan", lit("a"), i(1), None),
    ("sparqlCwm#truthValue", lit(""), xsd("false", "boolean"), True),
]


def full(name):
    return get(f"<{name if name.startswith('http') else SWAP + name}>")


def test_functions(spark):
    cols = [full(n).fwd(subject(a)).alias(f"c{k}") for k, (n, a, _) in enumerate(FORWARD)]
    cols += [full(n).rev(subject(a)).alias(f"r{k}") for k, (n, a, _) in enumerate(REVERSE)]
    got = spark.range(1).select(*cols).first()
    want = [w for *_, w in FORWARD] + [w for *_, w in REVERSE]
    assert [(n, g) for (n, *_), g in zip([*FORWARD, *REVERSE], got)] == [(n, w) for (n, *_), w in zip([*FORWARD, *REVERSE], want)]


def test_tests(spark):
    got = spark.range(1).select(*[full(n).test(subject(a), subject(b)).alias(f"t{k}") for k, (n, a, b, _) in enumerate(TESTS)]).first()
    assert [(t[0], g) for t, g in zip(TESTS, got)] == [(t[0], t[3]) for t in TESTS]


@pytest.mark.parametrize("ns,n", [("string#", 24), ("math#", 30), ("maths#", 22), ("time#", 16), ("times#", 16), ("list#", 5), ("set#", 7), ("os#", 4), ("xml#", 17), ("sparqlCwm#", 10)])
def test_families_are_there(ns, n):
    get("<>")
    assert sum(k.startswith(f"<{SWAP}{ns}") for k in BUILTINS) >= n


def test_rsa_keys_and_signatures(spark):
    import random

    from gossamer.functions import rsa

    key = rsa.generated(256, random.Random(1).getrandbits)
    assert key.n.bit_length() == 256 and rsa.Key.read(key.text()) == key and rsa.Key.read(key.public.text()) == key.public
    signature = rsa.signed("0" * 20, key)
    assert rsa.verified(key.public, "0" * 20, signature) and not rsa.verified(key.public, "1" * 20, signature)
    [row] = spark.range(1).select(get(f"<{SWAP}crypto#keyLength>").rev(Arg(F.lit(i(256)))).alias("made")).select("made", get(f"<{SWAP}crypto#keyLength>").fwd(Arg(F.col("made"))).alias("bits")).collect()
    assert rsa.Key.read(T.parts(row.made)[0]).d and row.bits == lit("256")
    with pytest.raises(ValueError):
        rsa.signed("0", key.public)
