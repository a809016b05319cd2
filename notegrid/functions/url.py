"""URLs by the grammar that browsers follow, as expressions of the JVM: which texts are one, and what is wrong with the others.

A text is trimmed of white space and control characters and loses tabs and line ends inside it. It needs a scheme. The schemes
of SPECIAL need a host (``file`` may have none), take a backslash for a slash, and their hosts are names or addresses: a host
whose last label is a number is an IPv4 address of one to four decimal, octal or hexadecimal parts, one in brackets is IPv6.
Hosts of other schemes are opaque and need no slashes at all. Ports are at most 65,535. Paths, queries and fragments take any
character. A name beyond ASCII counts as good unless it has a forbidden character: mapping it is the resolver's work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Schemes whose hosts are names or addresses.
SPECIAL = ("http", "https", "ws", "wss", "ftp", "file")
#: Characters that no host may have, and those that no name may have besides.
FORBIDDEN = r"[\x00\t\n\r #/:<>?@\[\\\]^|]"
FORBIDDEN_NAME = r"[\x00-\x20\x7f\uFFFD#%/:<>?@\[\\\]^|]"
#: A number in a host, and one group of an IPv6 address.
NUMBER = r"(?:[0-9]+|0[xX][0-9A-Fa-f]*)"
GROUP = r"[0-9A-Fa-f]{1,4}"
BYTE = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often then names it. Expressions that name one another several times would
    else grow with every step, in the plan and in memory."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def cleaned(text: Column) -> Column:
    """text without control characters and spaces at its ends, and without tabs and line ends anywhere."""
    return F.regexp_replace(F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")


def ipv6(host: Column) -> Column:
    """Whether the text within a host's brackets is an IPv6 address: eight groups, of which one run may be written as ``::``, and
    the last two as four bytes."""
    four = rf"{BYTE}(?:\.{BYTE}){{3}}"
    whole = F.regexp_replace(host, rf"(?<=^|:){four}\z", "0:0")

    def groups(side: Column) -> Column:
        return F.when(side == "", 0).otherwise(F.size(F.split(side, ":", -1)))

    def good(side: Column) -> Column:
        return side.rlike(rf"^(?:{GROUP}(?::{GROUP})*)?\z")

    def holds(sides: Column) -> Column:
        n, known = F.aggregate(sides, F.lit(0), lambda sum_, side: sum_ + groups(side)), F.forall(sides, good)
        return known & (((F.size(sides) == 1) & (n == 8)) | ((F.size(sides) == 2) & (n <= 7)))

    return let(F.split(whole, "::", -1), holds)


def part_value(part: Column) -> Column:
    """The value of a part of an IPv4 address as decimal(38, 0): hexadecimal after 0x, octal after 0; null if it is none or has
    more than 11 digits that count, which no address can hold."""
    digits = F.regexp_replace(F.regexp_replace(part, r"^0[xX]", ""), r"^0+(?=.)", "")
    hexa, octal = part.rlike(r"^0[xX][0-9A-Fa-f]*\z"), part.rlike(r"^0[0-7]*\z")
    fits = F.length(digits) <= 11
    of = lambda base: F.conv(F.when(digits == "", "0").otherwise(digits), base, 10)
    value = F.when(hexa & fits, of(16)).when(octal & fits, of(8)).when(part.rlike(r"^[1-9][0-9]*\z") & fits, digits)
    return value.cast("decimal(38,0)")


def ipv4(host: Column) -> Column:
    """Whether a host that ends in a number is an address: at most four parts, all but the last at most 255, and the last at most
    what the bytes that are left can hold."""

    def holds(values: Column) -> Column:
        n = F.size(values)
        most = F.element_at(F.array(*[F.lit(256 ** (5 - k) - 1).cast("decimal(38,0)") for k in range(1, 5)]), F.least(n, F.lit(4)))
        first = F.slice(values, 1, F.greatest(n - 1, F.lit(0)))
        return F.coalesce((n <= 4) & F.forall(values, lambda v: v.isNotNull()) & F.forall(first, lambda v: v <= 255) & (F.element_at(values, -1) <= most), F.lit(False))

    return let(F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\.", -1), part_value), holds)


def name_fault(name: Column, special: Column) -> Column:
    """What is wrong with a host that is not empty and has no brackets."""
    last = F.element_at(F.split(F.regexp_replace(name, r"\.$", ""), r"\.", -1), -1)
    forbidden = F.when(special, name.rlike(FORBIDDEN_NAME)).otherwise(name.rlike(FORBIDDEN))
    return F.when(forbidden, "host").when(special & last.rlike(rf"^{NUMBER}\z") & ~ipv4(name), "ipv4")


def place_fault(scheme: Column, user: Column, place: Column) -> Column:
    """What is wrong with a host and port."""
    special, bracket, file = scheme.isin(*SPECIAL), place.startswith("["), scheme == "file"
    host = F.when(bracket, F.regexp_extract(place, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(place, r"^([^:]*)", 1))
    # of a file URL a colon is no port: a drive letter is a path, other colons are forbidden in its host
    port = F.when(bracket, F.regexp_extract(place, r"^\[[^\]]*\]([\s\S]*)", 1)).otherwise(F.regexp_extract(place, r"^[^:]*([\s\S]*)", 1))

    def faults(s: Column) -> Column:
        host, port = s["host"], s["port"]
        digits = F.regexp_replace(port, r"^:0*", "")
        name = F.when(special, F.try_url_decode(F.regexp_replace(F.regexp_replace(host, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B"))).otherwise(host)
        return (
            F.when(bracket & (~place.contains("]") | ~ipv6(host)), "ipv6")
            .when((port != "") & (file | ~port.rlike(r"^:[0-9]*\z") | (F.length(digits) > 5) | (digits.try_cast("int") > 65_535)), "port")
            .when(bracket, None)
            .when(host == "", F.when((special & ~file) | user | (port != ""), "host"))
            .otherwise(let(name, lambda n: name_fault(n, special)))
        )

    return let(F.struct(host.alias("host"), port.alias("port")), faults)


def authority_fault(scheme: Column, rest: Column) -> Column:
    """What is wrong with what follows the scheme."""
    special, file = scheme.isin(*SPECIAL), scheme == "file"
    # any number of slashes opens the authority of a special URL, two that of another one
    opened = (special & ~file) | (file & rest.rlike(r"^[/\\]{2}")) | (~special & rest.startswith("//"))
    after = F.when(file, F.regexp_replace(rest, r"^[/\\]{2}", "")).when(special, F.regexp_replace(rest, r"^[/\\]*", "")).otherwise(F.regexp_replace(rest, "^//", ""))
    authority = F.when(special, F.regexp_extract(after, r"^([^/\\?#]*)", 1)).otherwise(F.regexp_extract(after, r"^([^/?#]*)", 1))

    def faults(a: Column) -> Column:
        drive = file & a.rlike(r"^[A-Za-z][:|]\z")
        return F.when(~drive, let(F.regexp_replace(a, r"^[\s\S]*@", ""), lambda place: place_fault(scheme, a.contains("@"), place)))

    return F.when(opened, let(authority, faults))


def url_fault(text: Column) -> Column:
    """Why text is no URL: ``scheme``, ``host``, ``ipv4``, ``ipv6`` or ``port``; null for a URL, and for null."""

    def faults(url: Column) -> Column:
        parts = F.struct(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)).alias("scheme"), F.regexp_replace(url, r"^[^:]*:", "").alias("rest"))
        return let(parts, lambda s: F.when(s["scheme"] == "", "scheme").otherwise(authority_fault(s["scheme"], s["rest"])))

    return let(text, lambda t: F.when(t.isNotNull(), let(cleaned(t), faults)))
