"""Text, names, e-mails and counts as column expressions; all run inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\u00A0\u2000-\u200A\u202F\u205F\u3000]"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
#: Name suffixes and forms of address that do not tell people apart.
NAME_SUFFIXES = ["phd", r"ph\.d", "md", r"m\.d", "jr", "sr", "ii", "iii", "iv", "esq", "mba", "dds"]
HONORIFICS = ["dr", "mr", "mrs", "ms", "prof", "professor", "sir", "dame"]
#: Local parts of shared inboxes.
SHARED_INBOXES = [
    "info", "contact", "support", "admin", "hello", "sales", "office", "webmaster", "noreply", "no-reply",
    "help", "press", "media", "enquiries", "subscriptions", "billing", "careers", "jobs", "abuse", "postmaster",
]


def _accent_map() -> tuple[str, str]:
    """Letters that decompose to one plain letter and marks, from the Unicode tables."""
    pairs = [(chr(c), "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _accent_map()


def strip_accents(x: Column) -> Column:
    return F.regexp_replace(F.translate(x, _ACCENTED, _PLAIN), r"[\u0300-\u036F]", "")


def fold(x: Column) -> Column:
    """Lower case, without accents, other characters than letters and digits as single spaces."""
    plain = F.regexp_replace(F.lower(strip_accents(x)), SPACE + "+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9 ]+", " "), " +", " "))


def null_if_empty(x: Column) -> Column:
    return F.when(F.length(x) > 0, x)


def clean_text(x: Column) -> Column:
    """Tags become spaces, six entities are decoded (&amp; first), white space is collapsed and taken from inside
    brackets and before punctuation; null when nothing is left."""
    t = F.regexp_replace(x, r"<[^>]+>", " ")
    for entity, char in (("&amp;", "&"), ("&#39;", "'"), ("&quot;", '"'), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.trim(F.regexp_replace(t, SPACE + "+", " "))
    t = F.regexp_replace(t, r" +([.,;:!?%)\]}])", "$1")
    return null_if_empty(F.regexp_replace(t, r"([(\[{]) +", "$1"))


def slugify(x: Column) -> Column:
    return F.replace(fold(x), F.lit(" "), F.lit("-"))


def normalize_title(x: Column) -> Column:
    """The folded title without one leading article."""
    return F.regexp_replace(fold(x), r"^(?:the|an|a) ", "")


def normalize_person(x: Column) -> Column:
    """A personal name in given-family order, folded, without one trailing suffix and without forms of address."""
    t = F.trim(F.regexp_replace(strip_accents(x), SPACE + "+", " "))
    t = F.regexp_replace(t, r"(?i),?\s*\b(?:" + "|".join(NAME_SUFFIXES) + r")\b\.?$", "")
    comma = F.instr(t, ",")
    turned = F.concat(F.trim(F.substring(t, comma + 1, F.length(t))), F.lit(" "), F.trim(F.substring(t, F.lit(1), comma - 1)))
    t = F.lower(F.when(comma > 0, turned).otherwise(t))
    t = F.regexp_replace(t, r"\b(?:" + "|".join(HONORIFICS) + r")\b\.?", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9 ]+", " "), " +", " "))


def person_block_key(x: Column) -> Column:
    """Family name and first initial, for blocking; a single name is its own key, '' if nothing is left."""
    return block_key(normalize_person(x))


def block_key(n: Column) -> Column:
    """The block of an already folded name."""
    last = F.regexp_extract(n, r"([^ ]+)$", 1)
    return F.when(F.instr(n, " ") > 0, F.concat(last, F.lit(":"), F.substring(n, 1, 1))).otherwise(n)


def extract_emails(x: Column) -> Column:
    """The distinct addresses of a text in lower case, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(EMAIL), F.lit(0)), F.lower))


def keep_email(email: Column, page_url: Column) -> Column:
    """Whether an address found on a page belongs to the page's owner: all on the page's own registrable domain,
    elsewhere those that are not a shared inbox."""
    from quillon.functions.urls import host, registrable

    own = registrable(F.regexp_extract(email, "@(.*)$", 1)) == registrable(host(page_url))
    return F.coalesce(own, F.lit(False)) | ~F.lower(F.regexp_extract(email, "^([^@]*)", 1)).isin(SHARED_INBOXES)


def parse_count(x: Column) -> Column:
    """1234 out of '1,234 reviews'; null without a number."""
    return F.regexp_extract(F.replace(x, F.lit(","), F.lit("")), r"(\d+)", 1).try_cast("bigint")


def to_number(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9.\-]", "").try_cast("double")


def split_byline(x: Column) -> Column:
    """The names of a byline: the lead word off, cut at ; & | and 'and'/'with', commas unless the comma turns one name."""
    t = F.regexp_replace(F.trim(x), r"(?i)^(?:written by|by|author)\s*:?\s+", "")
    parts = F.split(t, r"(?i)\s*(?:;|&|\||\band\b|\bwith\b)\s*")
    turned = lambda p: (F.size(F.split(p, ",")) == 2) & (F.size(F.split(F.trim(p), SPACE + "+")) <= 3)
    names = F.flatten(F.transform(parts, lambda p: F.when(turned(p), F.array(p)).otherwise(F.split(p, r"\s*,\s*"))))
    return F.filter(F.transform(names, F.trim), lambda n: F.length(n) > 1)


#: Named transforms of declarative extraction recipes.
TRANSFORMS = {
    "strip": F.trim,
    "lower": F.lower,
    "upper": F.upper,
    "title": F.initcap,
    "clean": clean_text,
    "int": lambda x: F.regexp_extract(F.replace(x, F.lit(","), F.lit("")), r"(-?\d+)", 1).try_cast("int"),
    "float": lambda x: F.regexp_extract(F.replace(x, F.lit(","), F.lit("")), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double"),
}
