"""Column functions for text: folding, wrapped lines, trimming, fuzzy forms.

Every function takes and returns Columns and stays inside the JVM. Null in, null out.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.binding import let

# Code points that folding rewrites.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}
LATE_LIGATURES = {"ﬅ": "st", "ﬆ": "st"}
SINGLE_QUOTES = "‘’‚′"
DOUBLE_QUOTES = "“”„″«»"
SPACES = "   "
HYPHENS = "‐‑"
DROPPED = "­​‌‍﻿"
DASH = "[–—-]"
#: White space of any kind, as Unicode has it.
WHITE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def _replace_all(c: Column, pairs: dict[str, str]) -> Column:
    for old, new in pairs.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def fold_text(c: Column) -> Column:
    """Ligatures, curly quotes, odd spaces and hyphens as plain characters; soft hyphens and zero-width marks go."""
    one_to_one = SINGLE_QUOTES + DOUBLE_QUOTES + SPACES + HYPHENS
    plain = "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + " " * len(SPACES) + "-" * len(HYPHENS)
    c = F.translate(c, one_to_one + DROPPED, plain)  # what has no counterpart is deleted
    return _replace_all(c, LIGATURES | {"\u2026": "..."})


def fold_ligatures(c: Column) -> Column:
    """The seven Latin ligatures spelled out."""
    return _replace_all(c, LIGATURES | LATE_LIGATURES)


def collapse_spaces(c: Column) -> Column:
    """One blank for runs of blanks, none around line ends, one empty line at most."""
    c = F.regexp_replace(c, r"[ \t\f\x0B]+", " ")
    return F.regexp_replace(F.regexp_replace(c, r" *\n *", "\n"), r"\n{3,}", "\n\n")


def trim_all(c: Column) -> Column:
    """Trim white space of any kind, not only blanks."""
    return F.trim(c, F.lit(WHITE))


def trim_right(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE))


def strip_italic_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)</?i>", "")


def italic_segments(c: Column) -> Column:
    """The trimmed, non-empty texts between italic tags."""
    found = F.regexp_extract_all(c, F.lit(r"(?is)<i>(.*?)</i>"), 1)
    return F.filter(F.transform(found, trim_all), lambda x: x != "")


def tidy_punct(c: Column) -> Column:
    """No blank before punctuation or inside parentheses."""
    c = F.regexp_replace(c, r"\s+([,.;:!?])", "$1")
    return F.regexp_replace(F.regexp_replace(c, r"\(\s+", "("), r"\s+\)", ")")


def strip_trailing_dot(c: Column) -> Column:
    return F.rtrim(F.rtrim(c, F.lit(".,;:")), F.lit(" \t\n\x0b\f\r"))


def ends_with_broken_url(c: Column) -> Column:
    """Whether a line ends inside a scheme, host or path, or with `doi:`."""
    return c.rlike(r"https?://\S*[/:]\z|https?:/{0,2}\z|(?i:doi:)\z")


def escape_regex(text: str) -> str:
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", text)


def join_wrapped_lines(lines: Column) -> Column:
    """An array of wrapped lines as one line, by a fold with the state (text so far, how its last line went on).

    A line that breaks off inside an address takes the next line's first token without a blank, and the rest after one; a
    hyphen after a letter or digit is kept where the line holds an address (and so on while lines end in hyphens), dropped
    between small letters, kept before a capital; else lines are joined by a blank. A line that was itself glued to the one
    before is not looked at again, save in an address.
    """
    state = lambda text, last, mode: F.struct(text.alias("text"), last.alias("last"), mode.alias("mode"))
    plain, glued, chain = F.lit(0), F.lit(1), F.lit(2)

    def step(acc: Column, line: Column) -> Column:
        last, text = acc["last"], acc["text"]
        open_mode = acc["mode"] != 1
        ends = last.rlike(r"-\z")
        cut = F.regexp_replace(text, r"-\z", "")
        token = F.regexp_substr(line, F.lit(r"^\S*"))
        rest = F.regexp_replace(line, r"^\S*\s*", "")
        inside = ends & last.rlike(r"[a-z0-9]-\z") & last.rlike(r"10\.[0-9]{4,}/|https?://")
        return (
            F.when(text.isNull(), state(line, line, plain))
            .when((acc["mode"] == 2) & ends, state(F.concat(text, line), F.concat(last, line), chain))
            .when(open_mode & (acc["mode"] != 2) & ends_with_broken_url(last), F.when(rest == "", state(F.concat(text, line), F.concat(last, token), glued)).otherwise(state(F.concat(text, token, F.lit(" "), rest), rest, plain)))
            .when(open_mode & (acc["mode"] != 2) & inside, state(F.concat(text, line), F.concat(last, line), chain))
            .when(open_mode & ends & last.rlike(r"[a-z]-\z") & line.rlike(r"^[a-z]"), state(F.concat(cut, line), line, glued))
            .when(open_mode & ends & last.rlike(r"[a-z]-\z") & line.rlike("^[A-ZÀ-ɏ]"), state(F.concat(text, line), line, glued))
            .otherwise(state(F.concat(text, F.lit(" "), line), line, plain))
        )

    none = F.lit(None).cast("string")
    return F.aggregate(lines, state(none, none, plain), step, lambda acc: F.coalesce(acc["text"], F.lit("")))


def _letters_with_marks() -> tuple[str, str]:
    """Characters whose canonical decomposition is a small Latin letter and marks, and that letter."""
    found = {}
    for code in range(0xC0, 0x2C00):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0].isascii() and parts[0].isalpha() and all("\u0300" <= x <= "\u036F" for x in parts[1:]):
            found[chr(code)] = parts[0].lower()
    return "".join(found), "".join(found.values())


def without_marks(c: Column) -> Column:
    """Lower case, accents off Latin letters (canonical decomposition without combining marks)."""
    accented, plain = _letters_with_marks()
    # ASCII has none: translate looks up every character
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(F.lower(c), accented + "".join(map(chr, range(0x300, 0x370))), plain))


def fuzzy_norm(c: Column, keep_spaces: bool = True) -> Column:
    """Small ASCII letters and digits without accents; other runs become one blank, or nothing."""
    c = F.regexp_replace(without_marks(c), "[^a-z0-9]+", " " if keep_spaces else "")
    return F.coalesce(F.trim(c), F.lit(""))


def normalize_for_match(c: Column, dehyphenate: bool = False) -> Column:
    """Ligatures folded, hyphenated line ends rejoined if asked for, letters and digits of any script in lower case."""
    c = fold_ligatures(c)
    if dehyphenate:
        c = F.regexp_replace(c, r"-\s+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def decode_entities(c: Column) -> Column:
    """Named references of markup, and numeric ones by their code point; texts without an ampersand have none."""
    return let(c, lambda c: F.when(c.contains("&"), _decoded(c)).otherwise(c))


def _decoded(c: Column) -> Column:
    numbered = F.regexp_extract_all(c, F.lit(r"(&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});)"), 1)

    def one(text: Column, ref: Column) -> Column:
        digits = F.regexp_extract(ref, r"&#[xX]?([0-9a-fA-F]+);", 1)
        code = F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("int")
        # char() stops at 255: larger code points go by way of UTF-32
        character = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.replace(text, ref, F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), character).otherwise(F.lit("\uFFFD")))

    c = F.aggregate(F.array_distinct(numbered), c, one)
    # the ampersand comes last, so that decoding is done once
    return _replace_all(c, {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&amp;": "&"})


def strip_number_prefix(c: Column) -> Column:
    """Drop `[n]`, then `(n)`, then `n. ` from the start."""
    return F.regexp_replace(c, r"^(?:\s*\[\d+\]\s*)?(?:\s*\(\d+\)\s*)?(?:\s*\d+\.\s+)?", "")
