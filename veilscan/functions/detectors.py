"""Detectors as column expressions: text in, array of findings out.

A finding shows a masked preview and a hash of the evidence, never the evidence itself, so that a
report of concealed secrets doesn't copy them. A null text has no findings.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions import patterns as P

FINDING = "struct<detector:string,kind:string,ordinal:int,preview:string,evidence_sha256:string,severity:int>"


def none() -> Column:
    return F.array().cast("array<string>")


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches, none for a null text, in time that grows as the text (see patterns.LINEAR)."""
    if pattern in P.LAST:
        text = F.regexp_extract(text, P.LAST[pattern], 0)
    found = F.regexp_extract_all(text, F.lit(P.LINEAR.get(pattern, pattern)), F.lit(group))
    found = F.when(F.contains(text, F.lit(P.NEEDS[pattern])), found) if pattern in P.NEEDS else found
    return F.coalesce(found, none())


def findings(hits: Column, detector: str, kind: str, severity: int) -> Column:
    """Findings of an array of matched strings."""
    one = lambda x, i: F.struct(
        F.lit(detector).alias("detector"),
        F.lit(kind).alias("kind"),
        i.cast("int").alias("ordinal"),
        F.concat(F.substring(x, 1, 2), F.lit("***(" ), F.length(x).cast("string"), F.lit(")")).alias("preview"),
        F.sha2(x, 256).alias("evidence_sha256"),
        F.lit(severity).alias("severity"),
    )
    return F.transform(hits, one)


# T1 to T7


def invisible_chars(text: Column) -> Column:
    return matches(text, P.INVISIBLE)


def mixed_script_words(text: Column) -> Column:
    """Few texts have a Cyrillic letter: the others' words aren't looked at."""
    return F.when(text.rlike(P.CYRILLIC), F.filter(matches(text, P.LETTERS), lambda w: w.rlike(P.CYRILLIC) & w.rlike(P.LATIN))).otherwise(none())


def base64_runs(text: Column) -> Column:
    return F.filter(matches(text, P.BASE64), lambda x: ~x.rlike(P.PURE_HEX))


def hex_runs(text: Column) -> Column:
    return matches(text, P.HEX)


def decoded(run: Column, form: str) -> Column:
    """What a run stands for, null unless that is text."""
    return F.try_validate_utf8(F.try_to_binary(run, F.lit(form)).cast("string"))


def payloads(base64: Column, hexed: Column) -> Column:
    """The texts that runs decode to."""
    both = F.concat(F.transform(base64, lambda x: decoded(x, "base64")), F.transform(hexed, lambda x: decoded(x, "hex")))
    return F.filter(both, lambda x: x.isNotNull())


def readable_payloads(text: Column) -> Column:
    """T3: what base64 and hex runs decode to, where that is text."""
    return payloads(base64_runs(text), hex_runs(text))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once: a column that a lambda uses would be computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def carried(bits: Column) -> Column:
    """The text that a string of 0 and 1 carries, eight to a byte, as an array of one or none: two bytes at least, and readable."""
    return once(bits, spelled)


def spelled(bits: Column) -> Column:
    byte = lambda x: F.lpad(F.conv(x, 2, 16), 2, "0")
    digits = F.array_join(F.transform(F.regexp_extract_all(bits, F.lit("[01]{8}"), F.lit(0)), byte), "")
    text = F.try_validate_utf8(F.try_to_binary(F.when((F.length(bits) >= 16) & (F.length(bits) % 8 == 0), digits), F.lit("hex")).cast("string"))
    return F.filter(F.array(text), lambda x: x.isNotNull() & ~F.contains(x, F.lit("\0")))


def invisible_payloads(text: Column) -> Column:
    """T1p: what zero-width spaces and non-joiners spell."""
    return carried(F.translate(F.array_join(matches(text, P.ZERO_WIDTH_BITS), ""), "\u200b\u200c", "01"))


def blank_payloads(text: Column) -> Column:
    """T5p: what blanks and tabs at line ends spell, from the first line to the last."""
    return blanks_carry(matches(text, P.LINE_END_BITS))


def blanks_carry(trailing: Column) -> Column:
    """T5p from what T5 has found: its pattern is that of the bits."""
    return carried(F.translate(F.array_join(trailing, ""), " \t", "01"))


def entropy(token: str) -> float:
    """Bits a character."""
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def high_entropy_tokens(bits: float = 4.0) -> Callable[[Column], Column]:
    """T4: tokens of 20 characters or more whose characters carry `bits` or more each. One small vectorised helper."""

    @F.pandas_udf("array<string>")
    def pick(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda ts: [t for t in ts if entropy(t) >= bits - 1e-9])

    return lambda text: pick(matches(text, P.TOKEN))


def trailing_whitespace(text: Column) -> Column:
    return matches(text, P.TRAILING)


def credentials(text: Column) -> Column:
    return matches(text, P.ASSIGNMENT, 1)


def key_blocks(text: Column) -> Column:
    return matches(text, P.KEY_BLOCK)


def emails(text: Column) -> Column:
    return matches(text, P.EMAIL)


def ipv4s(text: Column) -> Column:
    return matches(text, P.IPV4)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    at = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
    doubled = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, doubled(at(i))).otherwise(at(i)))
    return total % 10 == 0


def card_numbers(text: Column) -> Column:
    return F.filter(matches(text, P.DIGITS), luhn)


# P1 to P3


def html_comments(html: Column) -> Column:
    return matches(html, P.COMMENT, 1)


def html_hidden_elements(html: Column) -> Column:
    return matches(html, P.HIDDEN_ELEMENT)


def html_nonvisible_blocks(html: Column) -> Column:
    return F.concat(matches(html, P.SCRIPT, 1), matches(html, P.STYLE, 1))


def style_hidden_elements(html: Column) -> Column:
    """P2s: start tags whose class or id a style sheet of the page hides; selectors of one class or id, with or without an element's name."""
    sheets = F.array_join(matches(html, P.STYLE, 1), "\n")
    selectors = F.flatten(F.transform(matches(sheets, P.HIDING_RULE, 1), lambda x: F.transform(F.split(x, ","), lambda y: F.trim(F.regexp_replace(y, r"[\s]+", " ")))))
    single = F.array_distinct(F.filter(selectors, lambda x: x.rlike(P.ONE_NAME)))
    value = lambda tag, pattern: F.concat_ws("", *(F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)))
    named = lambda tag: F.concat(F.transform(F.split(value(tag, P.CLASS_VALUE), r"[\s]+"), lambda x: F.concat(F.lit("."), x)), F.array(F.concat(F.lit("#"), value(tag, P.ID_VALUE))))
    own = lambda tag: F.lower(F.regexp_extract(tag, "^<([a-zA-Z][a-zA-Z0-9]*)", 1))
    holds = lambda hidden, tag: F.arrays_overlap(hidden, F.concat(named(tag), F.transform(named(tag), lambda x: F.concat(own(tag), x))))
    return F.coalesce(once(single, lambda hidden: F.when(F.size(hidden) > 0, F.filter(matches(html, P.NAMED_TAG), lambda tag: holds(hidden, tag)))), none())


def code_points(numbers: Column) -> Column:
    """The characters of an array of numbers; a number that is none becomes U+FFFD."""

    def one(n: Column) -> Column:
        pair = n - 0x10000
        high, low = F.lit(0xD800) + F.floor(pair / 1024), F.lit(0xDC00) + F.pmod(pair, F.lit(1024))
        units = F.when(n < 0x10000, F.lpad(F.hex(n), 4, "0")).otherwise(F.concat(F.hex(high.cast("long")), F.hex(low.cast("long"))))
        good = (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
        return F.when(good, F.decode(F.unhex(units), "UTF-16BE")).otherwise(F.lit("\ufffd"))

    return F.transform(numbers, one)


def referenced(text: Column) -> Column:
    """The text with its character references read, once, each where it stands."""
    names = F.create_map(*(F.lit(x) for k, v in P.NAMED.items() for x in (f"&{k};", v)))
    digits = lambda x: F.regexp_replace(x, "[&#xX;]", "")
    number = lambda x: F.when(x.rlike("^&#[xX]"), F.conv(digits(x), 16, 10).cast("long")).when(x.rlike("^&#"), digits(x).cast("long")).otherwise(F.try_element_at(names, x).cast("long"))

    def read(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(P.REFERENCE), F.lit(0))
        chars = F.concat(code_points(F.transform(found, number)), F.array(F.lit("")))
        return F.array_join(F.zip_with(F.split(t, P.REFERENCE), chars, lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), "")

    return once(text, lambda t: F.when(F.contains(t, F.lit("&")), read(t)).otherwise(t))


#: Named, switchable detectors of text: kind, what they find, severity. Severity 0 is reported but doesn't
#: set the verdict. Each is given the text and what the detectors before it have found, by name.
TEXT = {
    "T1": ("invisible_char", lambda t, _: invisible_chars(t), 3),
    "T2": ("mixed_script_word", lambda t, _: mixed_script_words(t), 3),
    "T3b": ("base64_run", lambda t, _: base64_runs(t), 2),
    "T3h": ("hex_run", lambda t, _: hex_runs(t), 1),
    "T3d": ("readable_payload", lambda _, found: payloads(found["T3b"], found["T3h"]), 0),
    "T3s": ("payload_secret", lambda _, found: F.filter(found["T3d"], suspicious), 3),
    "T5": ("trailing_blank", lambda t, _: trailing_whitespace(t), 1),
    "T6": ("credential", lambda t, _: credentials(t), 3),
    "T6k": ("key_block", lambda t, _: key_blocks(t), 3),
    "T7e": ("email", lambda t, _: emails(t), 0),
    "T7i": ("ipv4", lambda t, _: ipv4s(t), 0),
    "T7c": ("card_number", lambda t, _: card_numbers(t), 1),
    "T1p": ("invisible_payload", lambda t, found: F.when(F.size(found["T1"]) >= 16, invisible_payloads(t)).otherwise(none()), 3),
    "T5p": ("blank_payload", lambda t, found: blanks_carry(found["T5"]) if "T5" in found else blank_payloads(t), 3),
    "T4": ("high_entropy_token", lambda t, found: unnamed(high_entropy_tokens()(t), *(found[x] for x in ("T3b", "T3h", "T6", "T7e", "T7c") if x in found)), 1),
}
#: Text detectors of a page and of its parts. Blanks before a line's end are layout there (T5, T5p).
IN_PAGES = {name: d for name, d in TEXT.items() if name not in ("T5", "T5p")}


def unnamed(tokens: Column, *named: Column) -> Column:
    """Those tokens that are no part of what other detectors report, nor hold it."""
    others = F.concat(none(), *named)
    return F.filter(tokens, lambda t: ~F.exists(others, lambda x: F.contains(x, t) | F.contains(t, x)))


def suspicious(body: Column) -> Column:
    """Whether a text detector that sets the verdict finds something in a payload or a page's part; T4 apart."""
    found = [invisible_chars, mixed_script_words, base64_runs, hex_runs, credentials, key_blocks, card_numbers]
    return functools.reduce(lambda a, b: a | b, (F.size(f(body)) > 0 for f in found))


def suspicious_bodies(bodies: Column) -> Column:
    """Bodies that trip a text detector. T4 is Python, which can't run inside a lambda: it sees all bodies at once."""

    @F.pandas_udf("array<struct<body:string,entropic:boolean>>")
    def marked(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda xs: [{"body": x, "entropic": any(entropy(t) >= 4.0 - 1e-9 for t in re.findall(P.TOKEN, x))} for x in xs])

    return F.transform(F.filter(marked(bodies), lambda x: x["entropic"] | suspicious(x["body"])), lambda x: x["body"])


def without(html: Column, pattern: str) -> Column:
    """A blank for each match, up to where the last one ends, as the search does."""
    shown = lambda t, end: F.concat(F.regexp_replace(F.substring(t, F.lit(1), end), pattern, " "), F.substring(t, end + 1, F.length(t)))
    return once(html, lambda t: once(F.length(F.regexp_extract(t, P.LAST[pattern], 0)), lambda end: shown(t, end)))


def page_text(html: Column) -> Column:
    """What stands between the tags, without comments, scripts and styles, its character references read. Each step is computed once."""
    for pattern in (P.COMMENT, P.SCRIPT, P.STYLE):
        html = without(html, pattern)
    return referenced(F.regexp_replace(html, P.TAG, " "))


#: Pages: comments and scripts are on every page, so they count only where their body trips a text
#: detector. Then the text detectors on the page's own text.
PAGES = {
    "P1": ("comment", lambda h, _: html_comments(h), 0),
    "P1s": ("comment_secret", lambda _, found: suspicious_bodies(found["P1"]), 3),
    "P2": ("hidden_element", lambda h, _: html_hidden_elements(h), 2),
    "P2s": ("style_hidden_element", lambda h, _: style_hidden_elements(h), 2),
    "P3": ("nonvisible_block", lambda h, _: html_nonvisible_blocks(h), 0),
    "P3s": ("nonvisible_secret", lambda _, found: suspicious_bodies(found["P3"]), 3),
    "text": ("", lambda h, _: page_text(h), None),  # no detector: what the others are given from here on
} | IN_PAGES
