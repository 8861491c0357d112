"""Stable identities: fingerprints of findings, hashes of evidence and of contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what separates the parts of a hashed key.
SEPARATOR = "|~|"


def joined_hash(*parts: Column) -> Column:
    return F.sha1(F.concat_ws(SEPARATOR, *parts))


def json_string(c: Column) -> Column:
    """A JSON string literal; characters beyond ASCII stay as they are."""
    named = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
    out = c
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"')):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    control = out
    for code in range(0x20):
        control = F.replace(control, F.lit(chr(code)), F.lit(named.get(chr(code), f"\\u{code:04x}")))
    out = F.when(out.rlike(r"[\x00-\x1F]"), control).otherwise(out)
    return F.concat(F.lit('"'), out, F.lit('"'))


def canonical_location(**fields: Column) -> Column:
    """A JSON object with sorted keys, a space after each comma and colon."""
    items = [F.concat(F.lit(f'"{k}": '), json_string(fields[k])) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *items), F.lit("}"))


def fingerprint(rule: Column, **location: Column) -> Column:
    """A finding's identity: rule and place, never the observed value."""
    return joined_hash(rule, canonical_location(**location))


def evidence_hash(*observed: Column) -> Column:
    """Changes with what was observed."""
    return joined_hash(*observed)


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)
