"""Rendered entries of HTML as runs of text with their style, and plain and annotated text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.binding import let
from scriptorium.functions.text import decode_entities, trim_all

RUN = "struct<text:string,italic:boolean,bold:boolean,sup:boolean>"


def label(html: Column) -> Column:
    """The content of the entry's left margin, or null."""
    raw = F.nullif(F.regexp_extract(html, r'(?is)<div[^>]*class="csl-left-margin"[^>]*>(.*?)</div>', 1), F.lit(""))
    return trim_all(plain_text(raw))


def without_label(html: Column) -> Column:
    return F.regexp_replace(html, r'(?is)<div[^>]*class="csl-left-margin"[^>]*>.*?</div>', "")


def plain_text(html: Column) -> Column:
    """Text without tags, references decoded."""
    return decode_entities(F.regexp_replace(html, r"<[^>]+>", ""))


def runs(html: Column) -> Column:
    """array<struct(text, italic, bold, sup)>: text between tags with the styles that are open there."""
    # every piece is a tag's content and the text that follows it
    pieces = F.filter(F.split(F.concat(F.lit("<>"), html), "<"), lambda p: p != "")

    def step(acc: Column, piece: Column) -> Column:
        text = decode_entities(F.regexp_replace(piece, r"^[^>]*>", ""))

        def flags(tag: Column) -> Column:
            opens = lambda names, style: tag.rlike(rf"^(?:{names})(?:\s|\z)") | (tag.rlike(r"^span\b") & tag.rlike(style))
            closes = lambda names: tag.rlike(rf"^/(?:{names})\z")
            flag = lambda kind, names, style: F.when(opens(names, style), True).when(closes(names), False).otherwise(acc[kind]).alias(kind)
            return F.struct(flag("italic", "i|em", "italic"), flag("bold", "b|strong", r"font-weight:\s*bold"), flag("sup", "sup", "vertical-align:\\s*sup"))

        def with_run(on: Column, text: Column) -> Column:
            open_now = [on[kind].alias(kind) for kind in ("italic", "bold", "sup")]
            run = F.struct(text.alias("text"), *open_now).cast(RUN)
            return F.struct(F.when(text == "", acc["runs"]).otherwise(F.concat(acc["runs"], F.array(run))).alias("runs"), *open_now)

        tag = F.lower(F.regexp_extract(piece, r"^([^>]*)>", 1))
        return let(let(tag, flags), lambda on: let(text, lambda text: with_run(on, text)))

    off = F.lit(False)
    start = F.struct(F.array().cast(f"array<{RUN}>").alias("runs"), off.alias("italic"), off.alias("bold"), off.alias("sup"))
    return F.aggregate(pieces, start, step, lambda acc: acc["runs"])


def plain(of: Column) -> Column:
    return F.array_join(F.transform(of, lambda r: r["text"]), "")


def annotated(of: Column) -> Column:
    """Text with italic runs in <i> tags."""
    return F.array_join(F.transform(of, lambda r: F.when(r["italic"], F.concat(F.lit("<i>"), r["text"], F.lit("</i>"))).otherwise(r["text"])), "")


def html(of: Column) -> Column:
    """Runs as HTML with i, b and sup elements; `runs` reads the same runs back."""
    escaped = lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = lambda on, name, t: F.when(on, F.concat(F.lit(f"<{name}>"), t, F.lit(f"</{name}>"))).otherwise(t)
    return F.array_join(F.transform(of, lambda r: tag(r["italic"], "i", tag(r["bold"], "b", tag(r["sup"], "sup", escaped(r["text"]))))), "")
