"""Fill-in-middle transformation of whole documents, cut at line units by a parallel automaton scan.

A text is read by an automaton that knows where units (`[^\\n]*\\n|[^\\n]+`) begin and where a tag ends.
Texts of up to a chunk (64 KB) are read in batches, one after the other with a reset between them. Longer
ones are cut into chunks that are dealt to all tasks: each chunk gives its transition function and its counts
for every state it may be entered in, their composition gives each chunk's entry, the chunk that holds a
cut is chosen by the counts before it, and that chunk alone finds the place. Digests of long outputs are taken
over their pieces in order, so no task holds a long text.

Defined results: a null text is empty; an empty text is plain with n = 0; a null doc_id draws from "7:"
alone; repeated rows give repeated results; texts of any length that a row can hold are cut; an empty table gives
no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm import automaton
from veilscan.llm._common import map_batches, materialise

# The tags of prefix, suffix and middle.
TAGS = ("<P>", "<S>", "<M>")
#: Parts of an output in their order, by form, and each part's place in the text.
ORDER = {"psm": "PSM", "spm": "SPM"}
IN_TEXT = "PMS"
MADE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, output string"
FIRST = MADE + ", row_id long, h array<long>, chunk int, content binary"


def draws(seed: int) -> Column:
    """h1 to h4 of a doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)))


def arrange(prefix: bytes, middle: bytes, suffix: bytes, form: str) -> list[bytes]:
    """The parts of an output, tags among them."""
    part = {"P": prefix, "M": middle, "S": suffix}
    return [x for p in ORDER[form] for x in (f"<{p}>".encode(), part[p])]


def restore(output: bytes, form: str) -> bytes:
    """The text, from an output and its form alone."""
    if form == "plain":
        return output
    found, at = {}, 0
    for p, q in zip(ORDER[form], [*ORDER[form][1:], ""], strict=True):
        end = output.index(f"<{q}>".encode(), at) if q else len(output)
        found[p], at = output[at + 3 : end], end
    return b"".join(found[p] for p in IN_TEXT)


@dataclass
class Infilling:
    """rate: per cent of texts that are cut; spm: per cent of those whose suffix comes first; chunk: bytes above which a text goes in chunks."""

    seed: int = 7
    rate: int = 100
    spm: int = 50
    chunk: int = 1 << 16
    fan: int = 64

    def form(self, h: list[int], plain: bool) -> str:
        return "plain" if plain or h[2] % 100 >= self.rate else "spm" if h[3] % 100 < self.spm else "psm"

    def run(self, docs: DataFrame, with_text: bool = True) -> DataFrame:
        """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 and, if asked for, the output, a row a row of `docs` (doc_id, text)."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("content"))
        rows = rows.select("doc_id", draws(self.seed).alias("h"), "content", F.monotonically_increasing_id().alias("row_id"))
        first = materialise(map_batches(rows, lambda batches: self._first(batches, with_text), FIRST))
        names = [c for c in first.columns if c in MADE.replace(",", " ").split() and (with_text or c != "output")]
        short = first.filter("chunk IS NULL").select(names)
        return short.unionByName(self._long(first.filter("chunk IS NOT NULL"), with_text).select(names))

    def _first(self, batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
        """Results of texts of a chunk or less, and the chunks of longer ones."""
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string()), ("output", pa.string()), ("row_id", pa.int64()), ("h", pa.list_(pa.int64())), ("chunk", pa.int32()), ("content", pa.binary())])
        for batch in batches:
            rows = list(zip(batch["doc_id"].to_pylist(), batch["h"].to_pylist(), batch["content"].to_pylist(), batch["row_id"].to_pylist(), strict=True))
            short = [r for r in rows if len(r[2]) <= self.chunk]
            made = [dict(zip(schema.names, r, strict=False)) for r in self._cut(short, with_text)]
            yield pa.RecordBatch.from_pylist(made, schema)
            for doc_id, h, content, row_id in rows:
                if len(content) > self.chunk:
                    some = [{"doc_id": doc_id, "row_id": row_id, "h": h, "chunk": i // self.chunk, "content": content[i : i + self.chunk]} for i in range(0, min(len(content), 1 << 20), self.chunk)]
                    yield pa.RecordBatch.from_pylist(some, schema)
                    for j in range(len(some) * self.chunk, len(content), self.chunk):
                        yield pa.RecordBatch.from_pylist([{"doc_id": doc_id, "row_id": row_id, "h": h, "chunk": j // self.chunk, "content": content[j : j + self.chunk]}], schema)

    def _cut(self, rows: list[tuple], with_text: bool) -> Iterator[tuple]:
        """Short texts, read one after the other."""
        data = np.frombuffer(b"".join(x for r in rows for x in (bytes([automaton.RESET]), r[2])), np.uint8)
        units, tags = automaton.lines(TAGS).places(data, 0, "units", "tags")
        chars = np.concatenate([[0], np.cumsum(automaton.starts(data))])
        begin = np.cumsum([1 + len(r[2]) for r in rows]) - np.array([len(r[2]) for r in rows], np.int64)
        for (doc_id, h, text, _), at in zip(rows, begin.tolist(), strict=True):
            end = at + len(text)
            own = units[np.searchsorted(units, at) : np.searchsorted(units, end)]
            n = len(own)
            form = self.form(h, not text or bool(np.searchsorted(tags, end) - np.searchsorted(tags, at)))
            if form == "plain":
                digest = hashlib.sha256(text).hexdigest()
                yield doc_id, n, form, None, None, digest, digest, text.decode() if with_text else None
                continue
            a, b = (int(own[k]) if k < n else end for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
            output = b"".join(arrange(text[: a - at], text[a - at : b - at], text[b - at :], form))
            restored = hashlib.sha256(restore(output, form)).hexdigest()
            yield doc_id, n, form, int(chars[a] - chars[at]), int(chars[b] - chars[a]), hashlib.sha256(output).hexdigest(), restored, output.decode() if with_text else None

    def _long(self, chunks: DataFrame, with_text: bool) -> DataFrame:
        """Results of texts in chunks (row_id, doc_id, h, chunk, content)."""
        dealt = chunks.select("row_id", "doc_id", "h", "chunk", "content").repartition("row_id", "chunk")
        nodes = materialise(dealt.select("row_id", "doc_id", "h", "chunk", summarise("content").alias("f")))
        entered = nodes.join(automaton.entries(nodes, "row_id", self.fan), ["row_id", "chunk"])
        own = lambda name: F.get(F.col("f")[name], F.col("entry.state"))
        entered = materialise(entered.select("row_id", "doc_id", "h", "chunk", "entry", own("units").alias("units"), own("tags").alias("tags"), "f.chars", "f.bytes"))
        sums = entered.groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.first("h").alias("h"), *(F.sum(c).alias(c) for c in ("units", "tags", "chars", "bytes")))
        h = lambda i: F.get("h", F.lit(i))
        form = F.when((F.col("tags") > 0) | (h(2) % 100 >= self.rate), "plain").when(h(3) % 100 < self.spm, "spm").otherwise("psm")
        k = [h(i) % (F.col("units") + 1) for i in (0, 1)]
        plans = materialise(sums.select("row_id", "doc_id", "chars", "bytes", F.col("units").alias("n"), form.alias("form"), F.array(F.least(*k), F.greatest(*k)).alias("k")))
        # The chunk of each cut, by the units before it; a cut behind the last unit is the text's end.
        wanted = plans.filter("form <> 'plain'").select("row_id", F.posexplode("k").alias("which", "unit"))
        chosen = entered.select("row_id", "chunk", "entry", "units").join(wanted, "row_id").filter("unit >= entry.units AND unit < entry.units + units")
        found = chosen.join(chunks.select("row_id", "chunk", "content"), ["row_id", "chunk"])
        found = found.select("row_id", "which", "entry", place("content", F.col("entry.state"), F.col("unit") - F.col("entry.units")).alias("p"))
        found = found.select("row_id", "which", F.struct((F.col("entry.bytes") + F.col("p.bytes")).alias("bytes"), (F.col("entry.chars") + F.col("p.chars")).alias("chars")).alias("p"))
        cuts = found.groupBy("row_id").agg(*(F.max(F.when(F.col("which") == i, F.col("p"))).alias(c) for i, c in enumerate("ab")))
        end = F.struct("bytes", "chars")
        plans = plans.join(cuts, "row_id", "left").select("row_id", "doc_id", "n", "form", F.coalesce("a", end).alias("a"), F.coalesce("b", end).alias("b"), "bytes")
        plans = materialise(plans)
        made = plans.filter("form <> 'plain'").select("row_id", "form", F.explode(F.array(*(F.lit(p) for p in IN_TEXT))).alias("part"))
        tags = made.select("row_id", "form", seg().alias("seg"), F.lit(-1).cast("long").alias("place"), F.encode(F.concat(F.lit("<"), "part", F.lit(">")), "UTF-8").alias("content"))
        pieces = materialise(self._pieces(chunks, plans).unionByName(tags))
        outputs = digests(pieces, ["seg", "place"], with_text).withColumnRenamed("sha256", "output_sha256")
        # From the output alone: without its tags, and its parts in the text's order.
        text_place = F.when(F.col("form") == "plain", 0).otherwise(F.expr(" ".join(["CASE", *(f"WHEN form = '{f}' AND seg = {i} THEN {IN_TEXT.index(p)}" for f, ps in ORDER.items() for i, p in enumerate(ps)), "END"])))
        back = pieces.filter("place >= 0").select("row_id", text_place.alias("part"), "place", "content")
        restored = digests(back, ["part", "place"]).select("row_id", F.col("sha256").alias("restored_sha256"))
        plans = plans.join(outputs, "row_id").join(restored, "row_id")
        sizes = (F.when(F.col("form") != "plain", c) for c in (F.col("a.chars"), F.col("b.chars") - F.col("a.chars")))
        return plans.select("doc_id", "n", "form", *(c.alias(x) for c, x in zip(sizes, ("prefix_chars", "middle_chars"), strict=True)), "output_sha256", "restored_sha256", "output")

    def _pieces(self, chunks: DataFrame, plans: DataFrame) -> DataFrame:
        """(row_id, form, seg, place, content): chunks cut where the parts end, with their place in the output."""
        rows = chunks.select("row_id", "chunk", "content").join(plans.select("row_id", "form", "a.bytes", F.col("b.bytes").alias("second")), "row_id")
        start = F.col("chunk").cast("long") * self.chunk
        size = F.octet_length("content")
        a, b = (F.least(F.greatest(F.col(c) - start, F.lit(0)), size).cast("int") for c in ("bytes", "second"))
        cut = lambda part, lo, hi: F.struct(F.lit(part).alias("part"), (start + lo).alias("place"), F.substring("content", lo + 1, hi - lo).alias("content"))
        whole = F.array(cut("P", F.lit(0), size))
        parts = F.when(F.col("form") == "plain", whole).otherwise(F.array(cut("P", F.lit(0), a), cut("M", a, b), cut("S", b, size)))
        rows = rows.select("row_id", "form", F.inline(F.filter(parts, lambda x: F.octet_length(x["content"]) > 0)))
        return rows.select("row_id", "form", seg().alias("seg"), "place", "content")


def seg() -> Column:
    """Place of `part` among an output's parts, by `form`; all of a plain text is one."""
    return F.expr(" ".join(["CASE", *(f"WHEN form = '{f}' AND part = '{p}' THEN {i}" for f, ps in ORDER.items() for i, p in enumerate(ps)), "ELSE 0 END"]))


def summarise(content: str) -> Column:
    """SUMMARY of each chunk."""

    @F.pandas_udf(automaton.SUMMARY)
    def summary(content: pd.Series) -> pd.DataFrame:
        own = automaton.lines(TAGS)
        return pd.DataFrame([own.summary(np.frombuffer(x, np.uint8)) for x in content], columns=["to", "units", "tags", "chars", "bytes"])

    return summary(content)


def place(content: str, state: Column, unit: Column) -> Column:
    """Where a chunk's unit of that number begins."""

    @F.pandas_udf("bytes long, chars long")
    def find(content: pd.Series, state: pd.Series, unit: pd.Series) -> pd.DataFrame:
        out = []
        for x, s, k in zip(content, state, unit, strict=True):
            data = np.frombuffer(x, np.uint8)
            at = int(automaton.lines(TAGS).places(data, int(s), "units")[0][k])
            out.append((at, int(automaton.starts(data[:at]).sum())))
        return pd.DataFrame(out, columns=["bytes", "chars"])

    return find(content, state, unit)


def digests(pieces: DataFrame, order: list[str], with_text: bool = False) -> DataFrame:
    """(row_id, sha256, output) of each row's pieces in order; they pass through a task one by one, and are kept only for the text."""
    dealt = pieces.select("row_id", *order, "content").repartition("row_id").sortWithinPartitions("row_id", *order).select("row_id", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha, held = None, hashlib.sha256(), []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"row_id": last, "sha256": sha.hexdigest(), "output": b"".join(held).decode() if with_text else None}], pa.schema([("row_id", pa.int64()), ("sha256", pa.string()), ("output", pa.string())]))

        for batch in batches:
            for row_id, content in zip(batch["row_id"].to_pylist(), batch["content"].to_pylist(), strict=True):
                if last is not None and row_id != last:
                    yield done()
                    sha, held = hashlib.sha256(), []
                last = row_id
                sha.update(content)
                if with_text:
                    held.append(content)
        if last is not None:
            yield done()

    return materialise(map_batches(dealt, run, "row_id long, sha256 string, output string"))
