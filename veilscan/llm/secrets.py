"""Secret scans: an Aho-Corasick keyword pass, anchored expressions near hits, embedded checksums.

Three base kinds are defined by expression alone (assign, access, hex). The method adds tokens whose
last characters are a checksum of the others, signed web tokens, key blocks and card numbers; these
are reported only if their own check holds (checksum, JSON parts, stated length of the key, Luhn sum).
Hex runs and card numbers have no keyword, so their expressions read the whole text. Work is per
document, in time that grows as its length: no shuffle.

Defined results: a null or empty text has no spans; whole texts are read, however long; of equal spans
of several kinds each is listed; repeated rows give repeated results; an empty table gives no rows;
extra columns are ignored by `scan` and kept by `redact`, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm._common import map_batches, release, texts

# The base kinds' expressions.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# What the added kinds look like from their keyword on.
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
BLOCK = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])")
KINDS = ("assign", "access", "hex", "checked", "signed", "block", "card")
KEYWORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "checked": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"), "signed": ("eyj",), "block": ("-----begin ",)}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, masked string"


def checksum62(body: str) -> str:
    """crc32 of the body as six digits of base 62."""
    n, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0 and len(set(digits)) > 1


def _json_part(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except (ValueError, binascii.Error):
        return False


def key_block(body: str) -> bool:
    """Whether the body is a key by its own marks: a DER sequence that is as long as it says, or the OpenSSH form."""
    try:
        raw = base64.b64decode("".join(body.split()), validate=True)
    except (ValueError, binascii.Error):
        return False
    if raw.startswith(b"openssh-key-v1\0"):
        return True
    if len(raw) < 2 or raw[0] != 0x30:
        return False
    more = raw[1] & 0x7F if raw[1] & 0x80 else 0
    size = int.from_bytes(raw[2 : 2 + more], "big") if more else raw[1]
    return len(raw) == 2 + more + size


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def spans(text: str, words) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets, by start, then kind as listed. `words`: automaton()."""
    low = text.lower()
    if len(low) != len(text):  # some letters grow in lower case: positions must stay
        low = text.translate(ASCII_LOWER)
    hits: dict[str, list[int]] = {}
    for end, (kind, n) in words.iter(low):
        hits.setdefault(kind, []).append(end - n + 1)
    out: list[tuple[int, int, str]] = []

    def anchored(kind: str, pattern: re.Pattern, good) -> None:
        done = 0
        for at in sorted(hits.get(kind, ())):
            if at >= done and (m := pattern.match(text, at)):
                done = m.end()
                if good(m):
                    out.append((m.start(), m.end(), kind))

    anchored("assign", ASSIGN, lambda m: len(m[2]) >= 6)
    anchored("access", ACCESS, lambda m: m.end() - m.start() >= 20)
    out.extend((m.start(), m.end(), "hex") for m in HEX.finditer(text))
    anchored("checked", CHECKED, lambda m: checksum62(m[1]) == m[2])
    anchored("signed", SIGNED, lambda m: _json_part(m[1]) and _json_part(m[2]))
    anchored("block", BLOCK, lambda m: key_block(m[2]))
    out.extend((m.start(), m.end(), "card") for m in CARD.finditer(text) if luhn(re.sub("[ -]", "", m[0])))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def mask(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with every span, overlapping ones joined, replaced by its first span's kind."""
    parts, at = [], 0
    for start, end, kind in found:
        if start >= at:
            parts += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def scan(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Spans of every whole text of `docs` (doc_id, text); `masked` is the text without them, null unless asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc_id, text in zip(batch["doc_id"].to_pylist(), texts(batch["text"]), strict=True):
                found = spans(text, words)
                kinds = [s[2] for s in found]
                base = ",".join(f"{k}:{a}:{b}" for a, b, k in found if k in KINDS[:3])
                row = (doc_id, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for a, b, k in found), mask(text, found) if with_text else None)
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
            kinds_ = [pa.int64()] * 4 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds_, strict=True)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "masked"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCANNED)


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every span of text replaced by its kind, and n_chars (if there) to match; a null text stays."""

    @F.pandas_udf("string")
    def masked(text: pd.Series) -> pd.Series:
        words = automaton()
        found = text.map(lambda t: None if t is None else mask(t, spans(t, words)))
        release()
        return found

    out = docs.withColumn("text", masked(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
