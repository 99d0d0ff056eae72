"""Text functions as columns: normalising, folding, keys and checks. Everything runs in the JVM."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import quote  # noqa: F401  (public helper for callers that build URLs in Python)

from pyspark.sql import Column
from pyspark.sql import functions as F


def _alphabet() -> tuple[str, str]:
    """Latin letters with marks, and the letters below them."""
    have, want = [], []
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != chr(c):
            have.append(chr(c))
            want.append(plain)
    return "".join(have), "".join(want)


MARKED, PLAIN = _alphabet()


def _compositions() -> tuple[str, str]:
    """Letter and combining mark, two characters each, and the letters they make (canonical composition; two marks in either order)."""
    pairs = {}
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base, *marks = unicodedata.normalize("NFD", chr(c))
        for order in {tuple(marks), tuple(reversed(marks))}:
            below = unicodedata.normalize("NFC", base + "".join(order[:-1]))
            if order and len(below) == 1 and unicodedata.normalize("NFC", below + order[-1]) == chr(c):
                pairs[below + order[-1]] = chr(c)
    return "".join(pairs), "".join(pairs.values())


PAIRS, COMPOSED = _compositions()
#: Letters and digits one by one: Java looks up a class of single characters in a table, and asks each range of one in turn.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: What counts as white space at the ends of a word.
SPACES = " \t\n\x0b\x0c\r\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def nfc(x: Column) -> Column:
    """Latin letters and their combining marks composed. Texts without combining marks are left as they are at once."""

    def add(done: Column, c: Column) -> Column:
        at = F.position(F.concat(F.right(done, F.lit(1)), c), F.lit(PAIRS))
        joined = F.concat(F.left(done, F.length(done) - 1), F.substring(F.lit(COMPOSED), F.floor((at + 1) / 2).cast("int"), F.lit(1)))
        return F.when((done != "") & c.rlike("\\p{M}") & (at > 0), joined).otherwise(F.concat(done, c))

    return F.when(x.rlike("\\p{M}"), F.aggregate(F.split(x, ""), F.lit(""), add)).otherwise(x)


def strip_marks(x: Column) -> Column:
    """Without diacritics: composed Latin letters by table, combining marks by class."""
    return F.translate(F.regexp_replace(x, "\\p{M}+", ""), MARKED, PLAIN)


def norm_headword(x: Column) -> Column:
    return F.lower(F.btrim(nfc(x), F.lit(SPACES)))


def fold_key(x: Column) -> Column:
    return F.trim(F.lower(strip_marks(x)))


def sense_key(x: Column) -> Column:
    """Letters and digits of a folded sense, single-spaced: what makes two senses the same."""
    kept = F.regexp_replace(F.lower(strip_marks(x)), f"[^{LOWER}{DIGITS} ]+", " ")
    return F.trim(F.regexp_replace(kept, "  +", " "))


def det_id(*parts: Column) -> Column:
    """26 hex digits that depend on the parts alone."""
    return F.substring(F.sha2(F.concat_ws("\x01", *[p.cast("string") for p in parts]), 256), 1, 26)


def is_headword(x: Column) -> Column:
    return F.length(x).between(1, 64) & x.rlike("^[\\p{L}\\p{M}'\\-\\s]+$")


def split_homonym(x: Column) -> Column:
    """struct(word, homonym): digits after a letter at the end, with punctuation around them dropped."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(nfc(x), "\\s+", " ")), "[\\s,;:.]+$", "")
    number = F.regexp_extract(bare, "\\p{L}(\\d+)$", 1)
    word = F.when(number != "", F.regexp_replace(bare, "\\d+$", "")).otherwise(bare)
    return F.struct(word.alias("word"), F.when(number != "", number.cast("int")).alias("homonym"))


def url_word(word: Column) -> Column:
    """A word as a component of a URL: blanks become %20, and !'()~* stay."""
    out = F.url_encode(word)
    for have, want in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(have), F.lit(want))
    return out


def url_of(base: str, word: Column) -> Column:
    return F.concat(F.lit(base), url_word(word))


def truthy(x: Column) -> Column:
    """A flag parameter: absent stays absent; an empty one counts as set."""
    return F.when(x.isNotNull(), F.lower(x).isin("", "1", "true"))


def list_param(x: Column, allowed: list[str]) -> Column:
    return F.filter(F.transform(F.split(x, ","), lambda v: F.trim(v)), lambda v: v.isin(allowed))


#: What a grammatical abbreviation is: nothing, a short word with a stop, two letters with stops, or a number.
ABBREVIATION = "^(?:[a-zăâîșț]{1,6}\\.|[a-zăâîșț]\\.-?[a-zăâîșț]\\.|[0-9]+|)$"


def is_abbreviation(x: Column) -> Column:
    return F.lower(F.btrim(x, F.lit(SPACES))).rlike(ABBREVIATION)


def error_kind(message: Column) -> Column:
    m = F.lower(message)
    return (
        F.when(m.contains("timeout") | m.contains("abort"), "timeout").when(m.contains("quota"), "quota_exceeded")
        .when(m.contains("robots"), "robots_disallowed").when(m.contains("429") | m.contains("rate"), "rate_limited").otherwise("upstream_error")
    )


def plain_text(html: Column) -> Column:
    """Text of an HTML string: scripts, styles and tags out, entities in, blanks single."""
    x = F.regexp_replace(html, "(?is)<(script|style)\\b[^>]*>.*?</\\1\\s*>", " ")
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(x, "(?s)<!--.*?-->|<[^>]*>", " ")), "[ \\t\\n\\x0B\\f\\r ]+", " "))


def decode_entities(x: Column) -> Column:
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return x


def query_terms(text: str) -> list[list[str]]:
    """A search text as phrases of folded words; the last word of each is a prefix. Nothing left: an empty list."""
    cleaned = "".join(c if unicodedata.category(c)[0] in "LMN" or c.isspace() or c in "'-" else " " for c in text)
    out = []
    for token in (t.strip("-'") for t in cleaned.split()):
        folded = "".join(c for c in unicodedata.normalize("NFD", token.lower()) if not unicodedata.combining(c))
        if words := re.findall(r"[^\W_]+", folded):
            out.append(words)
    return out


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(strip_marks(F.coalesce(x, F.lit("")))), F.lit("[\\p{L}\\p{N}]+"), 0)
