"""Scalar functions on strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarack.plans.language import Condition

# fixed values: words that stand for a separator or a scheme in a defanged indicator
SEPARATOR_WORDS = {"dot": ".", "at": "@"}
SCHEME_WORDS = ("hxxp", "meow")
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# one grammar for both reading and recognising: a separator, or its word, inside brackets that may be escaped
_OPEN, _CLOSE = r"\\?[\[({]\s?", r"\s?\\?[\])}]"
_BRACKETED = rf"(?i){_OPEN}(:?//|[.:@]|{'|'.join(SEPARATOR_WORDS)}){_CLOSE}"
_SCHEME = rf"(?i)\b(?:{'|'.join(SCHEME_WORDS)})(s?)(?=:)"

# fixed values: names under which no public mail domain can be registered (RFC 2606, 6761, 6762, 8375 and private use)
RESERVED_SUFFIXES = ("example", "invalid", "localhost", "test", "local", "localdomain", "lan", "internal", "intranet", "corp", "home.arpa", "example.com", "example.net", "example.org")


def folded(column: str | Column) -> Column:
    """A key: trimmed, blanks collapsed, lower case."""
    column = F.col(column) if isinstance(column, str) else column
    return F.lower(F.trim(F.regexp_replace(column, r"\s+", " ")))


def slug(column: str | Column) -> Column:
    """A key with underscores for blanks and hyphens."""
    column = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s_-]+", "_")


def like(column: Column, c: Condition) -> Column:
    """The positive form of a text operator on a folded column."""
    values = [" ".join(v.split()).lower() for v in c.values]
    match c.operator.removeprefix("not_"):
        case "contains":
            return column.contains(values[0])
        case "starts_with":
            return column.startswith(values[0])
        case "ends_with":
            return column.endswith(values[0])
        case _:
            return column.isin(*values)


def refanged(column: str | Column) -> Column:
    """Text in which indicators are spelled as they are: separators without brackets, schemes without disguise.

    Blanks around a bracketed dot go with it. Text that shows no sign of a disguise is not looked through again.
    """
    column = F.col(column) if isinstance(column, str) else column
    bare = F.translate(column, _INVISIBLE, "")
    for word, mark in SEPARATOR_WORDS.items():
        bare = F.regexp_replace(bare, rf"(?i)\s?{_OPEN}{word}{_CLOSE}\s?", mark)
    bare = F.regexp_replace(bare, rf"\s?{_OPEN}\.{_CLOSE}\s?", ".")
    bare = F.regexp_replace(bare, _BRACKETED, "$1")
    bare = F.regexp_replace(bare, _SCHEME, "http$1")
    disguised = column.rlike(_BRACKETED) | column.rlike(_SCHEME)
    for c in _INVISIBLE:
        disguised = disguised | column.contains(c)
    return F.when(disguised, bare).otherwise(column)


def looks_defanged(column: str | Column) -> Column:
    """Whether a separator stands in brackets or a scheme is spelled hxxp."""
    column = F.col(column) if isinstance(column, str) else column
    return column.rlike(_BRACKETED) | column.rlike(r"(?i)\bhxxps?:")


def normal_url(column: str | Column) -> Column:
    """Lower-case scheme and host, no default port, no fragment, at least a slash; what is no URL stays."""
    column = F.trim(F.col(column) if isinstance(column, str) else column)
    scheme, user, host, port, rest = (F.regexp_extract(column, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#@]*@)?([^/?#:@]+)(?::(\d+))?([^#]*)", i) for i in range(1, 6))
    scheme = F.lower(scheme)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    tail = F.regexp_extract(rest, r"^[^?]*(.*)$", 1)
    path = F.concat(_without_dots(F.regexp_extract(rest, r"^([^?]*)", 1)), tail)
    path = F.when((rest == "") | rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(path)
    return F.when(scheme == "", column).otherwise(F.concat(scheme, F.lit("://"), user, F.lower(host), F.when(default, "").otherwise(F.concat(F.lit(":"), port)), path))


def _without_dots(path: Column) -> Column:
    """A path without its dot segments: "." goes, ".." goes with the segment before it."""
    parts = F.split(path, "/", -1)
    up = lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")), up)
    # a dot segment at the end leaves its slash
    ended = F.when(path.rlike(r"/\.{1,2}$"), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), F.array_join(ended, "/")).otherwise(path)


def normal_email(column: str | Column) -> Column:
    """The address in lower case, or null if it is none, too long, redacted or in a reserved domain.

    Both sides of the sign are looked at part by part: a local part is atoms with dots between, a domain labels.
    """
    column = F.col(column) if isinstance(column, str) else column
    bare = F.trim(refanged(F.regexp_replace(F.trim(column), r"\s*(?=[\[({]\s?(?i:@|at)\s?[\])}])|(?<=[\])}])\s+", "")))
    bare = F.lower(F.regexp_replace(bare, r"(?i)^mailto:", ""))
    bare = F.regexp_replace(F.regexp_replace(bare, "^<|>$", ""), r"\.$", "")
    sides = F.split(bare, "@", -1)
    local, domain = F.try_element_at(sides, F.lit(1)), F.try_element_at(sides, F.lit(2))
    atoms, labels = F.split(local, r"\.", -1), F.split(domain, r"\.", -1)
    atom = F.forall(atoms, lambda x: x.rlike("^[a-z0-9!#$%&'+/=?^_`{|}~-]+$"))
    label = F.forall(labels, lambda x: x.rlike("^[a-z0-9-]{1,63}$") & ~x.startswith("-") & ~x.endswith("-"))
    top = F.try_element_at(labels, F.lit(-1))
    public = (top.rlike("^[a-z]{2,}$") | top.startswith("xn--")) & (F.size(labels) > 1)
    dotted = F.concat(F.lit("."), domain)
    reserved = F.lit(False)
    for suffix in RESERVED_SUFFIXES:
        reserved = reserved | dotted.endswith(f".{suffix}")
    short = (F.length(bare) <= 254) & (F.length(local) <= 64) & (F.length(domain) <= 253)
    return F.when((F.size(sides) == 2) & atom & label & public & ~reserved & short, bare)


def hash_type(column: str | Column) -> Column:
    """md5, sha1 or sha256 by the length of a hexadecimal value, else null."""
    column = F.trim(F.col(column) if isinstance(column, str) else column)
    return F.when(column.rlike("^[0-9a-fA-F]+$"), F.when(F.length(column) == 32, "md5").when(F.length(column) == 40, "sha1").when(F.length(column) == 64, "sha256"))


def csv_cell(column: str | Column) -> Column:
    """A cell of a CSV file: formulas are defused, quotes doubled where a reader needs them."""
    column = F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))
    safe = F.when(column.rlike("^[=+\\-@\t\r]"), F.concat(F.lit("'"), column)).otherwise(column)
    return F.when(safe.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def bucket(column: str | Column, count: int) -> Column:
    """A power-of-two bucket from the first 32 bits of the SHA-256 of a key."""
    column = F.col(column) if isinstance(column, str) else column
    return F.conv(F.substring(F.sha2(column, 256), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(count - 1)).cast("int")


def uuid5(namespace: str, column: Column) -> Column:
    """A version 5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), column.cast("binary")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), F.substr(variant, nibble, F.lit(1)), part(18, 3), F.lit("-"), part(21, 12))


def note_value(column: str | Column, key: str) -> Column:
    """The value of the last ``key=value`` among parts of a note that `` | `` separates."""
    column = F.col(column) if isinstance(column, str) else column
    parts = F.filter(F.split(column, r" \| "), lambda x: F.lower(F.trim(x)).startswith(f"{key}="))
    return F.trim(F.substring(F.trim(F.try_element_at(parts, F.lit(-1))), len(key) + 2, 1 << 20))


def csv_time(column: str | Column, zone: str = "UTC") -> Column:
    """A UTC time for a CSV cell: with a Z, or as the wall clock of a zone with its offset."""
    column = F.col(column) if isinstance(column, str) else column
    if zone == "UTC":
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    utc = column.cast("timestamp_ntz")
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    minutes = F.timestamp_diff("MINUTE", utc, local)
    size = F.abs(minutes)
    offset = F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((size % 60).cast("string"), 2, "0"))
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), offset)
