"""Text as column expressions. Patterns say what Java's regular expressions mean by them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lexical token, the counted token, sentence ends, and what noise looks like.
TOKEN = r"[0-9a-zA-Zа-яА-ЯёЁ]+"
COUNTED = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
SENTENCE_END = r"(?<=[.!?…])\s+|\n{2,}"
PAGE_NUMBER = r"^\s*[-–—]?\s*(?:\d{1,4}|[ivxlcdmIVXLCDM]{1,8})\s*[-–—]?\s*$"
CONTENTS_LINE = r"(?:\.\s?){3,}\s*\d{1,4}\s*$"
TERMS = 12


def fold(x: Column) -> Column:
    return F.replace(F.lower(x), F.lit("ё"), F.lit("е"))


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(fold(x), F.lit(TOKEN), F.lit(0))


def capitals(x: Column) -> Column:
    """Upper case with one letter for each: Spark's own makes two of ß, which then no longer compares with the text as it was."""
    return F.upper(F.replace(x, F.lit("ß"), F.lit("ẞ")))


def spaced(x: Column) -> Column:
    """The lexical tokens as one string, each between spaces of its own (" one  two "); no tokens: two spaces.

    A count of a token is then a replacement of a fixed string, which needs neither arrays nor lambdas.
    """
    return F.concat(F.lit(" "), F.array_join(tokens(x), "  "), F.lit(" "))


def spaced_count(spaced_text: Column, key: str) -> Column:
    """How often a token, or two different neighbouring ones ("of the"), are in a ``spaced`` text."""
    wanted = f" {key.replace(' ', '  ')} "
    return ((F.length(spaced_text) - F.length(F.replace(spaced_text, F.lit(wanted), F.lit("")))) / len(wanted)).cast("int")


def spaced_length(spaced_text: Column) -> Column:
    """The number of tokens of a ``spaced`` text."""
    n = F.length(spaced_text) - F.length(F.replace(spaced_text, F.lit(" "), F.lit("")))
    return F.when(F.length(spaced_text) == 2, 0).otherwise(n / 2).cast("int")


def query_terms(x: Column, stop: Sequence[str] = (), most: int = TERMS) -> Column:
    """Distinct terms in order without stop words; ``most`` of them (a limit of queries, not of texts)."""
    kept = F.filter(F.array_distinct(tokens(x)), lambda t: ~t.isin(*stop)) if stop else F.array_distinct(tokens(x))
    return F.slice(kept, 1, most)


def token_count(x: Column) -> Column:
    return F.size(F.regexp_extract_all(x, F.lit(COUNTED), F.lit(0)))


def model_tokens(pieces: Column) -> Column:
    """What a model would count: 1.35 a piece, rounded up, at least one."""
    return F.greatest(F.lit(1), F.ceil(pieces * 1.35)).cast("bigint")


def squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def content_hash(x: Column) -> Column:
    return F.sha2(squeezed(x), 256)


# Fixed value: the standard's namespace for addresses.
URL_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The UUID of version 5 that a name has in a namespace; null stays null."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    parts = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return F.when(name.isNotNull(), parts)


# formulas' commands and the symbols that they stand for in queries.
SYMBOLS = {"∀": "forall", "∃": "exists", "¬": "neg", "∧": "land", "∨": "lor", "→": "to", "↔": "leftrightarrow"}


def symbols_spelt(x: Column) -> Column:
    """A query whose logical symbols are spelt as formulas' commands, each a word of its own."""
    for symbol, name in SYMBOLS.items():
        x = F.replace(x, F.lit(symbol), F.lit(f" {name} "))
    return x


def specific_terms(x: Column) -> Column:
    """Names, abbreviations and identifiers of Latin script as they are written, in order, once whatever their case: with a
    capital, a digit or an underscore, of three characters or with a digit. Parts joined by hyphens are one name unless
    one of them is a single character."""
    names = F.regexp_extract_all(x, F.lit(r"[0-9A-Za-z]+(?:[-_][0-9A-Za-z]+)*"), F.lit(0))
    whole = lambda w: F.forall(F.split(w, "-"), lambda p: F.length(p) >= 2)
    parts = F.flatten(F.transform(names, lambda w: F.when(whole(w), F.array(w)).otherwise(F.split(w, "-"))))
    digit = lambda w: w.rlike("[0-9]")
    kept = F.filter(parts, lambda w: ~w.rlike("^[0-9]+$") & ((F.length(w) >= 3) | digit(w)) & (digit(w) | w.contains("_") | w.rlike("[A-Z]")))
    return F.aggregate(kept, F.array().cast("array<string>"), lambda out, w: F.when(F.exists(out, lambda y: fold(y) == fold(w)), out).otherwise(F.concat(out, F.array(w))))


def excerpt(x: Column, most: int) -> Column:
    s = squeezed(x)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, most - 1)), F.lit("…")))


def sentences(x: Column) -> Column:
    return F.filter(F.split(x, SENTENCE_END), lambda s: F.trim(s) != "")


def reading_minutes(chars: Column) -> Column:
    """1200 characters a minute, to the nearest five (halves to even), five at least."""
    return F.greatest(F.lit(5), F.bround(chars / 1200 / 5).cast("int") * 5)


def roman(x: Column) -> Column:
    """The value of a Roman numeral; null if it isn't one."""
    value = F.create_map(*[F.lit(v) for p in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for v in p])
    digits = F.transform(F.filter(F.split(F.upper(x), ""), lambda c: c != ""), lambda c: value[c])
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))
    step = lambda s, d: F.struct((s["sum"] + F.when(d < s["last"], -d).otherwise(d)).alias("sum"), d.alias("last"))
    return F.when(F.upper(x).rlike("^[IVXLCDM]+$"), F.aggregate(F.reverse(digits), start, step)["sum"])


def number(x: Column) -> Column:
    """A number out of text: comma or point, spaces in it, a Unicode minus, a unit after it."""
    plain = F.regexp_replace(F.translate(F.translate(x, "−–", "--"), ",", "."), r"(?<=\d)\s(?=\d)", "")
    return F.regexp_extract(plain, r"^\s*([-+]?\d+(?:\.\d+)?)\s*[^\d\s]{0,12}\s*$", 1).try_cast("double")


def duration(seconds: Column) -> Column:
    """h:mm:ss, or m:ss under an hour."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def normalized_url(x: Column) -> Column:
    """For comparison: lower-case host without www. or m., no fragment, no slash at the end."""
    host = F.regexp_replace(F.lower(F.regexp_extract(x, r"^https?://([^/?#]+)", 1)), r"^(?:www|m)\.", "")
    rest = F.regexp_extract(x, r"^https?://[^/?#]+([^#]*)", 1)
    return F.concat(host, F.regexp_replace(rest, r"/+$", ""))


def video_id(x: Column) -> Column:
    """The eleven-character identifier in a video's address (watch?v=, short host, embed or shorts path); null without one."""
    found = F.regexp_extract(x, r"(?:[?&]v=|youtu\.be/|/embed/|/shorts/)([A-Za-z0-9_-]{11})(?:[?&#/]|$)", 1)
    return F.nullif(found, F.lit(""))


def public_url(x: Column) -> Column:
    """http or https, no user, a host with a dot that isn't a private or local address."""
    host = F.lower(F.regexp_extract(x, r"^https?://([^/?#:@]+)(?::\d+)?(?:[/?#]|$)", 1))
    private = host.rlike(r"^(?:127\.|10\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2\d|3[01])\.|0\.)") | host.isin("localhost") | host.endswith(".local")
    return (host != "") & host.contains(".") & ~private


def quality(x: Column) -> tuple[Column, Column]:
    """Shares of plausible characters and of ones that decoding errors leave, of all that aren't white space."""
    n = F.nullif(matched(x, r"\S+"), F.lit(0))
    return matched(x, r"[\p{L}\p{N}.,;:!?()\"'-]+") / n, matched(x, r"[\x{FFFD}ÃÂ\x{0080}-\x{009F}]+") / n


def matched(x: Column, pattern: str) -> Column:
    """Characters in all matches. Collecting matches is several times faster than replacing what a negated class names."""
    return F.length(F.array_join(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), ""))
