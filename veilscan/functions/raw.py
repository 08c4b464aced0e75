"""B1 to B3: byte structure of raw files, in one vectorised helper.

A null or empty content has no kind, nothing behind its end and nothing inside.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.detectors import findings
from veilscan.functions.detectors import none as no_hits
from veilscan.functions.patterns import SIGNATURES

# How each type ends. A zip's end record is 22 bytes and a comment whose length it states.
ENDS = {"png": b"IEND\xaeB`\x82", "jpg": b"\xff\xd9", "pdf": b"%%EOF"}
ZIP_END = b"PK\x05\x06"
# Signatures of two bytes occur by chance: only longer ones are looked for inside.
INSIDE = {k: bytes.fromhex(v) for k, v in SIGNATURES.items() if len(v) >= 8 and k != "gif"} | {"gif": b"GIF89a"}
SEVERITY = {"B1": 3, "B2": 2, "B3": 2}
ANY_INSIDE = re.compile(b"|".join(re.escape(v) for v in INSIDE.values()))


def kind_of(content: bytes) -> str | None:
    return next((k for k, v in SIGNATURES.items() if content.startswith(bytes.fromhex(v))), None)


def trailing_bytes(content: bytes) -> int:
    """Bytes after the end of a PNG, JPEG, PDF or zip file; line ends after a PDF's end don't count."""
    kind = kind_of(content)
    if kind == "zip":
        at = content.rfind(ZIP_END)
        if at < 0 or len(content) < at + 22:
            return 0
        return max(0, len(content) - at - 22 - int.from_bytes(content[at + 20 : at + 22], "little"))
    if kind not in ENDS:
        return 0
    end = ENDS[kind]
    at = content.find(end) if kind == "png" else content.rfind(end)
    if at < 0:
        return 0
    rest = content[at + len(end) :]
    return len(rest.strip(b"\r\n")) if kind == "pdf" else len(rest)


def embedded(content: bytes) -> list[int]:
    """Places past 0 where a signature of another file starts."""
    return [m.start() for m in ANY_INSIDE.finditer(content) if m.start() > 0]


def structure(content: Column) -> Column:
    """struct(kind, trailing, embedded) of each file; a null content has none."""

    @F.pandas_udf("kind string, trailing long, embedded array<long>")
    def look(content: pd.Series) -> pd.DataFrame:
        some = [b"" if c is None else bytes(c) for c in content]
        return pd.DataFrame({"kind": [kind_of(c) for c in some], "trailing": [trailing_bytes(c) for c in some], "embedded": [embedded(c) for c in some]})

    return look(content)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def wrong_type(extension: Column, kind: Column) -> Column:
    """B1: whether the leading bytes are those of another type than the extension says."""
    return F.when(kind.isNotNull(), extension != kind).otherwise(extension.isin(*SIGNATURES))


def byte_findings(path: Column, content: Column) -> Column:
    """B1 to B3 as an array of findings: another type than the extension says, bytes past the end, another file inside."""
    found = structure(content)
    kind = found["kind"]
    none = no_hits()
    mismatch = F.when(wrong_type(extension(path), kind), F.array(F.concat_ws(" ", extension(path), kind))).otherwise(none)
    trailing = F.when(found["trailing"] > 0, F.array(F.concat(found["trailing"].cast("string"), F.lit(" bytes")))).otherwise(none)
    inside = F.transform(found["embedded"], lambda at: F.concat(F.lit("at "), at.cast("string")))
    return F.concat(findings(mismatch, "B1", "type_mismatch", SEVERITY["B1"]), findings(trailing, "B2", "trailing_bytes", SEVERITY["B2"]), findings(inside, "B3", "embedded_file", SEVERITY["B3"]))
