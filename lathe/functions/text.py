"""Scalar text functions with the semantics the operators need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(s: Column) -> Column:
    return F.translate(s, _UPPER, _LOWER)


def strip(s: Column) -> Column:
    """Trim all white space, that of Unicode and the four ASCII separators included; null is empty."""
    space = r"[\s\x1C-\x1F\x85\p{Z}]+"
    return F.regexp_replace(F.coalesce(s, F.lit("")), rf"\A{space}|{space}\z", "")


def digits_or_zero(s: Column) -> Column:
    return F.when(s.rlike(r"^[0-9]+$"), s.try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def site(url: Column) -> Column:
    """Authority without ``www.``, lower-cased; https is assumed; malformed or null is empty.

    Credentials of an app, ``android://hash@package/`` or ``androidapp://package``, give ``app:package``.
    """
    url = strip(url)
    full = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))
    host = F.lower(F.coalesce(F.try_parse_url(full, F.lit("AUTHORITY")), F.lit("")))
    package = F.lower(F.regexp_replace(F.regexp_replace(url, "^[^:]*://(?:[^@]*@)?", ""), "/+$", ""))
    app = url.rlike("^android(app)?://")
    return F.when(app, F.concat(F.lit("app:"), package)).otherwise(F.regexp_replace(host, r"^www\.", ""))


def dispatch(tag: Column, arms: dict[str, Column]) -> Column:
    """Union elimination: one value for each tag; an unknown tag is an error."""
    out = None
    for name, value in arms.items():
        out = F.when(tag == name, value) if out is None else out.when(tag == name, value)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown tag "), F.coalesce(tag, F.lit("null")))))


def right_fold(items: Column, zero: Column, step) -> Column:
    """List fold from the right: step(item, acc) starts at the last item."""
    return F.aggregate(F.reverse(items), zero, lambda acc, x: step(x, acc))


def broken_rules(rules: dict[str, Column]) -> Column:
    """Names of the rules whose condition holds (a null condition doesn't), in order."""
    return F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in rules.items())))


def substitute(template: Column, values: dict[str, Column]) -> Column:
    """Fills ``@name@`` places one after the other; a null value is empty."""
    for name, value in values.items():
        template = F.replace(template, F.lit(f"@{name}@"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def split_once(s: Column, mark: str) -> tuple[Column, Column]:
    """What stands before and after the first mark; without one, all and null."""
    at = F.instr(s, mark)
    return F.when(at > 0, F.substring(s, F.lit(1), at - 1)).otherwise(s), F.when(at > 0, F.substring(s, at + len(mark), F.length(s)))


def file_time(name: Column) -> Column:
    """The instant in a name like 2024-05-06_07-08-09.jpg, in the session's time zone; else null."""
    return F.try_to_timestamp(F.regexp_extract(name, r"\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}", 0), F.lit("yyyy-MM-dd_HH-mm-ss"))


def decode_text(data: Column) -> Column:
    """Text of UTF-8 bytes, or of ISO-8859-15 where they are no UTF-8."""
    # The eight places where that charset differs from ISO-8859-1.
    other = F.translate(F.decode(data, "ISO-8859-1"), "¤¦¨´¸¼½¾", "€ŠšŽžŒœŸ")
    return F.coalesce(F.try_validate_utf8(data.cast("string")), other)


def gib(n: Column) -> Column:
    """Bytes as GiB, two places, half to even."""
    return F.bround(n / (1 << 30), 2)


def gib_to_bytes(n: Column) -> Column:
    return n.cast("bigint") * (1 << 30)


def percent_encoded(s: Column) -> Column:
    """As in a query: a space is a plus; letters, digits and ``_.-~`` stay."""
    return F.replace(F.replace(F.url_encode(s), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def tag_value(line: Column) -> tuple[Column, Column]:
    """Identifier and value of ``ID desc: value``; the value ends at a second ``: ``."""
    return F.split(line, r"\s+", 2)[0], F.get(F.split(line, ": "), 1)


def padded(value: Column, width: int) -> Column:
    """Right-aligned and never cut."""
    text = value.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit(" "))


def utc_iso(ts: Column) -> Column:
    """Seconds of UTC as 2024-05-06T07:08:09Z, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def date_path(day: Column) -> Column:
    return F.date_format(day, "yyyy/MM/dd")


def without_returns(s: Column) -> Column:
    return F.replace(s, F.lit("\r"), F.lit(""))


def quoted_names(names: Column) -> Column:
    """Names in backticks, a backtick doubled, joined by commas."""
    return F.array_join(F.transform(names, lambda n: F.concat(F.lit("`"), F.replace(n, F.lit("`"), F.lit("``")), F.lit("`"))), ",")


def json_base64(doc: Column, path: str) -> Column:
    """Text of the Base64 value at a JSON path; null where there is none."""
    return F.decode(F.unbase64(F.get_json_object(doc, path)), "UTF-8")


def first_field(line: Column, prefix: str | None = None) -> Column:
    """What stands before the first white space, that in front left out.

    With a prefix, of a line that begins with it the first field, fields being divided by spaces and tabs; null for other lines.
    """
    if prefix is not None:
        return F.when(line.startswith(prefix), F.regexp_extract(line, r"^[ \t]*([^ \t]*)", 1))
    return F.split(F.regexp_replace(line, r"^\s+", ""), r"\s+", 2)[0]


def by_suffix(name: Column, arms: dict[str, Column], other: Column) -> Column:
    """The value of the first suffix that the name, in lower case, ends in."""
    for suffix, value in reversed(arms.items()):
        other = F.when(F.lower(name).endswith(suffix), value).otherwise(other)
    return other


def digits_or_fail(s: Column, what: str) -> Column:
    """The number; anything but digits is an error, as an unknown count must not pass for 0."""
    return F.when(s.rlike("^[0-9]+$"), s.cast("bigint")).otherwise(F.raise_error(F.concat(F.lit(f"no {what}: "), F.coalesce(s, F.lit("null")))).cast("bigint"))


#: Fixed value: characters of a message text at most.
LONGEST_TEXT = 400


def request_rules(request: Column) -> dict[str, Column]:
    """Reasons to refuse a request, a JSON text of network, target, text and is_action."""
    get = lambda k: F.get_json_object(request, f"$.{k}")
    doc = F.try_parse_json(request)
    kind = lambda k: F.coalesce(F.schema_of_variant(F.try_variant_get(doc, f"$.{k}", "variant")), F.lit("VOID"))
    text, target, network = get("text"), get("target"), get("network")
    return {
        "no json": doc.isNull(), "missing": doc.isNotNull() & ((kind("text") == "VOID") | (kind("target") == "VOID") | (kind("network") == "VOID")),
        "no text": ~kind("text").isin("STRING", "VOID"), "empty": text == "", "too long": F.length(text) > LONGEST_TEXT, "control": text.rlike(r"[\x00-\x1f\x7f]"),
        "target": target.rlike("[, ]"), "network": F.contains(network, F.lit("/")), "action": ~kind("is_action").isin("BOOLEAN", "VOID"),
    }
