"""Column functions over strings: amounts, labels, titles, sentences, fragments, answers.

Word characters are letters, digits and ``_`` of any script and white space includes the
non-breaking kinds, in every pattern here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{85}\x{1C}-\x{1F}]"
NOT_WORD = r"[^\p{L}\p{N}_\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{85}\x{1C}-\x{1F}]"

# The phrases of page titles and step numbers that are recognised.
COUNTRY_IN_TITLE = (r"\bals u in (.+?) woont\b", r"\bin (.+?) woont\b")
STEP_NUMBER = r"(?iu)^stap\s*[0-9]+\s*[:.\-–]?\s*"
COUNTRY_MARK = "<land>"
#: Sentences shorter than this many characters are not compared.
LEAST_SENTENCE = 15


def collapse(c: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def casefold(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "ß", "ss")


# An amount: whole, with groups of three digits, with two decimals, or both, after a euro sign or without one.
_AMOUNT = (
    rf"^{SPACE}*(?:€{SPACE}*)?("
    r"[0-9]{1,3}(?:\.[0-9]{3})+(?:,[0-9]{2})?|[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]{2})?|[0-9]+(?:[.,][0-9]{2})?"
    rf"){SPACE}*$"
)


def _amount_body(raw: Column) -> tuple[Column, Column, Column]:
    """The figures of an amount, '' if there is none, and its last mark: before two decimals, or before a group of three."""
    body = F.regexp_extract(raw, _AMOUNT, 1)
    mark = lambda place: F.when(F.substring(body, place, 1).isin(".", ","), F.substring(body, place, 1))
    return body, mark(-3), mark(-4)


def amount_text(raw: Column) -> Column:
    """The amount as text with the decimals it was written with: '139' and '139.00' differ; null if none."""
    body, cents, group = _amount_body(raw)
    digits = F.translate(body, ".,", "")
    plain = lambda x: F.coalesce(F.nullif(F.ltrim(x, F.lit("0")), F.lit("")), F.lit("0"))
    with_cents = F.concat(plain(F.substring(digits, F.lit(1), F.length(digits) - 2)), F.lit("."), F.substring(digits, -2, 2))
    return F.when(body == "", None).when(cents.isNotNull(), with_cents).when(group.isNotNull(), F.concat(plain(digits), F.lit(".00"))).when(body != "", plain(digits))


def amount(raw: Column) -> Column:
    return amount_text(raw).cast("decimal(38,2)")


def notation(raw: Column) -> Column:
    """'nl' (1.234,56) or 'en' (1,234.56); whole numbers count as 'nl'; null if no amount."""
    body, cents, group = _amount_body(raw)
    en = (cents == ".") | (cents.isNull() & (group == ","))
    return F.when(body == "", None).when(F.coalesce(en, F.lit(False)), "en").when(body != "", "nl")


def value_key(raw: Column) -> Column:
    """What values are compared by: the amount, or else the folded text."""
    return F.coalesce(amount_text(raw), casefold(collapse(raw)))


def has_euro(raw: Column) -> Column:
    return F.contains(raw, F.lit("€"))


def label_key(label: Column) -> Column:
    """Footnote marks and punctuation go; spaces that deleted punctuation leaves are kept."""
    bare = collapse(F.regexp_replace(label, r"\*+$", ""))
    return F.trim(casefold(F.regexp_replace(bare, NOT_WORD, "")))


def country(title: Column, variant: Column) -> Column:
    """The country that a title names, or the page's variant key."""
    found = [F.nullif(F.regexp_extract(title, p, 1), F.lit("")) for p in COUNTRY_IN_TITLE]
    return F.coalesce(*found, variant)


def mask_country(text: Column, name: Column) -> Column:
    """Replace the country wherever it stands, inside words too; an empty name changes nothing."""
    return F.when(F.coalesce(name, F.lit("")) == "", text).otherwise(F.regexp_replace(text, F.concat(F.lit("(?iu)\\Q"), name, F.lit("\\E")), F.lit(COUNTRY_MARK)))


def without_number(title: Column) -> Column:
    return F.regexp_replace(F.trim(title), STEP_NUMBER, "")


def title_key(text: Column, name: Column) -> Column:
    """What step and accordion titles are compared by."""
    bare = without_number(mask_country(text, name))
    return collapse(casefold(F.regexp_replace(bare, r"[^\p{L}\p{N}_\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{85}\x{1C}-\x{1F}<>]", " ")))


def shorten(text: Column, most: int = 110) -> Column:
    t = collapse(text)
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…"))).otherwise(t)


def sentences(text: Column, name: Column) -> Column:
    """array<struct<key, text>> of a section's sentences of ``LEAST_SENTENCE`` characters or more."""
    cut = F.flatten(F.transform(F.split(text, "\n"), lambda line: F.split(line, r"(?<=[.!?])\s+(?=[A-Z0-9\"“‘(])")))
    kept = F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: F.length(s) >= LEAST_SENTENCE)
    return F.transform(kept, lambda s: F.struct(title_key(s, name).alias("key"), mask_country(s, name).alias("text")))


def sentence_ends(text: Column) -> Column:
    """The text with every mark that ends a sentence as a full stop; lengths stay."""
    return F.translate(text, "!?\n", "...")


def fragment(text: Column, start: Column, length: Column, ends: Column | None = None) -> Column:
    """The sentence around a hit; ``start`` counts from 0, ``ends`` is ``sentence_ends`` of the text if known.

    Looks for the nearest full stop on each side, without a pattern over all that stands before.
    """
    flat = sentence_ends(text) if ends is None else ends
    before = F.length(F.substring_index(F.substring(flat, F.lit(1), start), ".", -1))
    past = start + length
    rest = F.instr(F.substring(flat, past + 1, F.length(flat)), ".")
    last = F.when(rest > 0, past + rest).otherwise(F.length(flat))
    return collapse(F.substring(text, start - before + 1, last - start + before))


def escape_html(text: Column) -> Column:
    steps = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), steps, text)


def marked(text: Column, term: Column) -> Column:
    """Escaped text with the first occurrence of the term, in any case, inside <mark>."""
    at = F.instr(F.lower(text), F.lower(term))
    size = F.length(term)
    inside = F.concat(
        escape_html(F.substring(text, F.lit(1), at - 1)), F.lit("<mark>"), escape_html(F.substring(text, at, size)), F.lit("</mark>"),
        escape_html(F.substring(text, at + size, F.length(text))))
    return F.when((at > 0) & (size > 0), inside).otherwise(escape_html(text))


def counted(n: Column, one: str, many: str) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, one).otherwise(many))


def answer(text: Column, variants: dict[str, str], other: str) -> Column:
    """Names of the variants whose pattern is found, in the order given, each with its first group."""
    hits = []
    for name, pattern in variants.items():
        p = f"(?ium){pattern}"
        said = F.lit(name)
        if "(" in pattern.replace("(?", "").replace("\\(", ""):
            group = F.regexp_extract(text, p, 1)
            said = F.when(group != "", F.concat(F.lit(f"{name} "), group)).otherwise(said)
        hits.append(F.when(text.rlike(p), said))
    joined = F.concat_ws(" + ", *hits)
    return F.when(text.isNull(), F.lit(None)).when(joined == "", F.lit(other)).otherwise(joined)


def search_key(*parts: Column) -> Column:
    return casefold(F.concat_ws(" ", *parts))
