"""Scalar column functions (F1-F14), all built-in Spark expressions.

Nothing here leaves the JVM: each function returns a ``Column`` that stays
inside whole-stage codegen.
"""

from __future__ import annotations

import re
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Token pattern: runs of two or more Unicode letters, digits or underscores
# (the vectoriser's default "\b\w\w+\b" with Unicode word characters).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
# A line "bears a tag" when it contains "<...>" (lazy, like the model's test).
TAG_TEST = r"<.*?>"
TAG = r"<[^>]*>"
# -----------------------------------------------------------------------------


def strip_leading_zeros(c: Column) -> Column:
    """external ids are compared with leading zeros removed."""
    return F.regexp_replace(c, r"^0+", "")


def strip_eol(c: Column) -> Column:
    """drop trailing CR/LF characters."""
    return F.regexp_replace(c, r"[\r\n]+$", "")


def last_path_segment(c: Column) -> Column:
    """file name of a path or URL."""
    return F.element_at(F.split(c, "/"), -1)


def entity_names() -> dict[str, str]:
    """Entity name (with its semicolon; the old ones also without) -> text."""
    return dict(html5)


def _constant_map(pairs: dict[str, str]) -> Column:
    """A map literal made of two strings, which the optimizer folds."""
    cut = lambda values: F.split(F.lit("\x01".join(values)), "\x01")
    return F.map_from_arrays(cut(pairs.keys()), cut(pairs.values()))


def _code_point(code: Column) -> Column:
    """The character of a numeric reference: 0x80-0x9F mean Windows-1252, what
    is no character gives U+FFFD, control and non-characters give nothing."""
    old = {str(c): bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0)}
    low = code.bitwiseAND(F.lit(0xFFFF))
    nothing = (code.between(0x1, 0x8) | code.between(0xE, 0x1F) | code.isin(0xB, 0x7F) | code.between(0xFDD0, 0xFDEF)
               | (low >= 0xFFFE))
    return (F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit("\ufffd"))
            .when(code.between(0x80, 0x9F), F.try_element_at(_constant_map(old), code.cast("string")))
            .when(nothing, F.lit("")).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))


def unescape_entities(c: Column) -> Column:
    """Named, decimal and hexadecimal references decoded in one pass, as
    browsers do: names by lookup, the old ones also without a semicolon,
    nothing decoded twice.  Text without ``&`` is returned as it is."""
    names = entity_names()
    by_name = _constant_map(names)
    old = "|".join(sorted((n for n in names if not n.endswith(";")), key=lambda n: (-len(n), n)))

    def decoded(p: Column) -> Column:
        dec, hexa = F.regexp_extract(p, "^#0*([0-9]+);?", 1), F.regexp_extract(p, "^#[xX]0*([0-9a-fA-F]+);?", 1)
        code = (F.when((F.length(dec) > 7) | (F.length(hexa) > 6), F.lit(0x110000).cast("long"))
                .when(dec != "", dec.cast("long")).otherwise(F.conv(hexa, 16, 10).cast("long")))
        after = F.regexp_replace(p, "^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", "")
        name = F.regexp_extract(p, "^[A-Za-z][A-Za-z0-9]{0,31};?", 0)
        start = F.regexp_extract(p, f"^(?:{old})", 0)
        named = lambda n: F.concat(F.try_element_at(by_name, n), F.substr(p, F.length(n) + 1))
        return (F.when((dec != "") | (hexa != ""), F.concat(_code_point(code), after))
                .when(F.try_element_at(by_name, name).isNotNull(), named(name))
                .when(start != "", named(start)).otherwise(F.concat(F.lit("&"), p)))

    parts = F.split(c, "&")
    return F.when(F.contains(c, F.lit("&")), F.concat(
        F.get(parts, 0), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), decoded), ""))).otherwise(c)


def strip_tags(c: Column) -> Column:
    """F8: on lines that bear a tag, remove tags and decode entities;
    other lines are returned unchanged."""
    return F.when(F.regexp_like(c, F.lit(TAG_TEST)),
                  unescape_entities(F.regexp_replace(c, TAG, ""))).otherwise(c)


def tokenize(c: Column) -> Column:
    """lower-case, then every run of >= 2 word characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), 0)


def normalise_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def srt_clean(c: Column, mode: str = "reference") -> Column:
    """2.10: subtitle file text -> script text (each kept line + one space).

    ``reference``: drop the first 3 lines; every blank line drops itself and
    the next 2 lines (the next cue's number and timing).  ``cue``: drop cue
    numbers, timing lines and blanks by pattern.
    """
    t = normalise_newlines(c)
    t = F.when(t.endswith("\n"), t).otherwise(F.concat(t, F.lit("\n")))
    if mode == "reference":
        t = F.regexp_replace(t, r"\A(?:[^\n]*\n){0,3}", "")
        t = F.regexp_replace(t, r"(?m)^\n(?:[^\n]*\n){0,2}", "")
    elif mode == "cue":
        t = F.regexp_replace(t, r"(?m)^[0-9]+\n(?=[0-9:,.]+ --> )", "")
        t = F.regexp_replace(t, r"(?m)^[0-9:,.]+ --> [^\n]*\n", "")
        t = F.regexp_replace(t, r"(?m)^\n", "")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    lines = F.split(t, "\n")
    kept = F.slice(lines, 1, F.size(lines) - 1)
    return F.array_join(F.transform(kept, lambda x: F.concat(strip_tags(x), F.lit(" "))), "")


# --- HTML extraction (F12-F14), regex based ----------------------------------
def drop_scripts(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")


def paragraphs(html: Column, css_class: str | None = None) -> Column:
    """trimmed text of every <p> element (tags inside removed), or of those
    that bear ``css_class`` among the names of their class attribute."""
    if css_class is None:
        pattern = r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"
    else:
        if not re.fullmatch(r"[^\s\"'<>=\\]+", css_class):
            raise ValueError(f"not a class name: {css_class!r}")
        name = rf"\Q{css_class}\E"
        value = rf"(?:\"(?:[^\"]*\s)?{name}(?:\s[^\"]*)?\"|'(?:[^']*\s)?{name}(?:\s[^']*)?'|{name}(?=[\s>]))"
        pattern = rf"(?s)<[pP](?=\s)(?=[^>]*\s(?i:class)\s*=\s*{value})[^>]*>(.*?)</[pP]>"
    ps = F.regexp_extract_all(drop_scripts(html), F.lit(pattern), 1)
    return F.transform(ps, lambda x: F.regexp_replace(
        unescape_entities(F.regexp_replace(x, TAG, "")), r"^\s+|\s+$", ""))


def base_url(url: Column) -> Column:
    return F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)


ANCHOR = r"(?is)<a(?:\s[^>]*?)?\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))[^>]*>(.*?)</a>"


def link_by_text(html: Column, url: Column, label: str) -> Column:
    """absolute URL of the first link whose visible text equals ``label``.

    The href may be quoted either way or not at all.  Absolute links stay, links from the
    root or without a slash are put under the page's host.
    """
    h = drop_scripts(html)
    group = lambda i: F.regexp_extract_all(h, F.lit(ANCHOR), i)
    links = F.arrays_zip(group(1).alias("a"), group(2).alias("b"), group(3).alias("c"), group(4).alias("text"))
    hit = F.get(F.filter(links, lambda x: F.regexp_replace(x["text"], TAG, "") == F.lit(label)), F.lit(0))
    href = F.concat(hit["a"], hit["b"], hit["c"])
    return (F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
            .when(href.startswith("/"), F.concat(base_url(url), href))
            .when(href.isNotNull(), F.concat(base_url(url), F.lit("/"), href)))


def section_text(html: Column, open_tag_regex: str, close_tag: str) -> Column:
    """every non-empty text node of the first matching container,
    newline-joined, up to the first close tag; :func:`container_text` follows nesting."""
    block = F.regexp_extract(drop_scripts(html), f"(?is){open_tag_regex}(.*?){close_tag}", 1)
    nodes = F.filter(F.split(block, TAG), lambda x: x != F.lit(""))
    return F.array_join(nodes, "\n")


def _attribute(name: str, value: str, words: bool) -> str:
    """Pattern of a tag's attribute that is ``value``, or has it among its words."""
    if not re.fullmatch(r"[^\s\"'<>=\\]+", value):
        raise ValueError(f"not a name: {value!r}")
    word = rf"\Q{value}\E"
    if not words:
        return rf"(?=[^>]*\s(?i:{name})\s*=\s*(?:\"{word}\"|'{word}'|{word}(?=[\s>/])))"
    return (rf"(?=[^>]*\s(?i:{name})\s*=\s*(?:\"(?:[^\">]*\s)?{word}(?:\s[^\">]*)?\"|'(?:[^'>]*\s)?{word}(?:\s[^'>]*)?'"
            rf"|{word}(?=[\s>])))")


def container_text(html: Column, tag: str = "div", css_class: str | None = None, element_id: str | None = None) -> Column:
    """F14 with nesting: the non-empty text nodes of the first ``tag`` of a class
    or id, newline-joined; NULL if there is none.

    The text after the open tag is cut at every open and close tag of that name; a running depth
    over those marks finds the close that balances it (none: the text's end).
    """
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9]*", tag):
        raise ValueError(f"not a tag: {tag!r}")
    wanted = ("" if css_class is None else _attribute("class", css_class, True)) + \
        ("" if element_id is None else _attribute("id", element_id, False))
    h = drop_scripts(html)
    opened = rf"(?s)<(?i:{tag})(?=[\s>/]){wanted}[^>]*>"
    after = F.regexp_extract(h, rf"{opened}(.*)\z", 1)
    mark = rf"</?(?i:{tag})(?:[\s/][^>]*)?>"
    marks, parts = F.regexp_extract_all(after, F.lit(mark), 0), F.split(after, mark)
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"))
    inside = F.aggregate(
        marks, start, lambda acc, m: F.when(acc["depth"] == 0, acc).otherwise(F.struct(
            (acc["depth"] + F.when(m.startswith("</"), -1).otherwise(1)).alias("depth"), (acc["at"] + 1).alias("at"))),
        lambda acc: F.when(acc["depth"] == 0, acc["at"]).otherwise(acc["at"] + 1))
    nodes = F.flatten(F.transform(F.slice(parts, F.lit(1), inside), lambda p: F.split(p, TAG)))
    return F.when(h.rlike(opened), F.array_join(F.filter(nodes, lambda x: x != ""), "\n"))
