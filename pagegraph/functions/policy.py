"""Retry, content and formatting rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegraph.functions.urls import let

RETRYABLE = [429, 500, 502, 503, 504]
CONTENT = ["html", "javascript", "json", "xml"]


def retry_after_ms(header: Column) -> Column:
    """Seconds in a Retry-After header, in any decimal notation, as milliseconds; dates and negative numbers do not count."""
    number = F.when(header.rlike("^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), header.try_cast("double"))
    return F.coalesce(F.when(number >= 0, F.round(F.least(number, F.lit(9e15)) * 1000).cast("long")), F.lit(0).cast("long"))


def retry_delay_cap_ms(attempt: Column, header: Column) -> Column:
    """The most that the wait after this attempt may take: exponential to 30 s, Retry-After at least."""
    return F.greatest(F.least(F.lit(30000), (500 * F.pow(F.lit(2.0), attempt)).cast("long")), retry_after_ms(header))


def retryable(error: Column) -> Column:
    """Whether a transport error may be tried again; false without an error."""
    return F.coalesce(error != "too many redirects", F.lit(False))


def exit_code(error: Column, status: Column) -> Column:
    """0 without an error, the exit status if there is one, else -1."""
    return F.when(error.isNull(), 0).otherwise(F.coalesce(status.cast("int"), F.lit(-1)))


def routes(out: Column) -> Column:
    """The writers of an output option: - is event lines alone, a path is what is shown and lines there, none is what is shown."""
    lines = F.concat(F.lit("lines:"), out)
    return F.when(out == "-", F.array(lines)).when(F.coalesce(out, F.lit("")) != "", F.array(F.lit("shown"), lines)).otherwise(F.array(F.lit("shown")))


def should_retry(attempt: Column, status: Column, error: Column, most: int = 3) -> Column:
    """Transport errors, but not too many redirects, and the retryable statuses, while attempts are left."""
    return (attempt < most) & (retryable(error) | (error.isNull() & status.isin(*RETRYABLE)))


def legacy_retry(attempt: Column, status: Column, error: Column, most: int = 2) -> Column:
    return (attempt < most) & error.isNull() & (status == 429)


def legacy_delay_ms(header: Column) -> Column:
    return F.greatest(F.lit(5000), retry_after_ms(header))


def content_allowed(content_type: Column, allowed: list[str] | None = None) -> Column:
    """One of the words stands in the type; an empty list allows all."""
    words = CONTENT if allowed is None else allowed
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.instr(kind, w) > 0) if words else F.lit(True)


def capped(body: Column, most: int) -> tuple[Column, Column]:
    """The first bytes of a binary body, and whether it was longer."""
    return F.substring(body, 1, most), F.octet_length(body) > most


def human_bytes(n: Column) -> Column:
    shown = lambda unit, name: F.concat(F.replace(F.format_number(n / F.lit(float(unit)), 1), F.lit(",")), F.lit(f" {name}"))
    return F.when(n >= 1 << 20, shown(1 << 20, "MB")).when(n >= 1 << 10, shown(1 << 10, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def scale_label(n: Column) -> Column:
    short = lambda unit, name: F.concat((n / unit).cast("long").cast("string"), F.lit(name))
    return F.when((n >= 1_000_000) & (n % 1_000_000 == 0), short(1_000_000, "m")).when((n >= 1000) & (n % 1000 == 0), short(1000, "k")).otherwise(n.cast("string"))


def classify_ratio(observed: Column, scale: Column) -> Column:
    rel = observed / scale
    return F.when(scale <= 0, "n/a").when(rel < 0.75, "sub-linear").when(rel > 1.25, "super-linear").otherwise("roughly linear")


def html_safe_json(text: Column) -> Column:
    """JSON text in which <, >, & and the two line separators are escaped."""
    for c, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        text = F.replace(text, F.lit(c), F.lit(code))
    for k in (*range(0x0B, 0x0C), *range(0x0E, 0x10), *range(0x1A, 0x20)):  # escapes of control characters have small letters
        text = F.replace(text, F.lit(f"\\u00{k:02X}"), F.lit(f"\\u00{k:02x}"))
    return text


def basic_auth(credentials: Column) -> Column:
    """The header for user:password; null without a colon."""
    return F.when(credentials.contains(":"), F.concat(F.lit("Basic "), F.base64(F.encode(credentials, "utf-8"))))


TOKEN_KEYS = ["token", "access_token", "accessToken", "jwt", "id_token"]


def token_from_json(body: Column) -> Column:
    """The first of the token fields that is a non-empty string."""
    tree = F.try_parse_json(body)
    strings = [F.when(F.schema_of_variant(F.try_variant_get(tree, f"$.{k}", "variant")) == "STRING", F.try_variant_get(tree, f"$.{k}", "string")) for k in TOKEN_KEYS]
    return F.coalesce(*[F.nullif(s, F.lit("")) for s in strings])


def json_number(x: Column) -> Column:
    """A double as a JSON number: the shortest digits, with an exponent below 1e-6 and from 1e21 on; null for what is no number."""
    text = F.abs(x).cast("string")

    def made(s: Column) -> Column:
        whole, rest = F.regexp_extract(s, "^([0-9]+)", 1), F.regexp_replace(F.regexp_extract(s, "[.]([0-9]+)", 1), "^0$", "")
        power = F.coalesce(F.nullif(F.regexp_extract(s, "E(-?[0-9]+)$", 1), F.lit("")).cast("int"), F.lit(0))
        digits = F.concat(whole, rest)
        tail = F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest))
        up = F.concat(F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, F.lit("0")), F.when(F.length(digits) > power + 1, F.concat(F.lit("."), F.substring(digits, power + 2, F.lit(99)))).otherwise(""))
        plain = F.when(power == 0, F.concat(whole, tail)).when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)).otherwise(up)
        short = F.concat(whole, tail, F.when(power < 0, "e-").otherwise("e+"), F.abs(power).cast("string"))
        return F.when((x != 0) & ((F.abs(x) < 1e-6) | (F.abs(x) >= 1e21)), short).otherwise(plain)

    signed = F.concat(F.when((x < 0) | (x.cast("string") == "-0.0"), "-").otherwise(""), let(text, made))
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), signed)


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's bytes."""
    hexed = F.hex(F.encode(text, "utf-8"))
    byte = lambda i: F.conv(F.substring(hexed, 2 * i + 1, F.lit(2)), 16, 10).cast("bigint")
    places = F.sequence(F.lit(0), (F.length(hexed) / 2).cast("int") - 1)
    return F.when(F.length(hexed) == 0, F.lit(2166136261).cast("bigint")).otherwise(F.aggregate(places, F.lit(2166136261).cast("bigint"), lambda h, i: (h.bitwiseXOR(byte(i)) * 16777619) % (1 << 32)))


def quoted(text: Column) -> Column:
    """A text in double quotes, with quotes, backslashes and line ends escaped."""
    for c, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        text = F.replace(text, F.lit(c), F.lit(code))
    return F.concat(F.lit('"'), text, F.lit('"'))
