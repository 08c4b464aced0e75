"""V1 to V6: scan, verdict, findings, summary, top documents, outliers.

Defined results: a null text has no findings; empty texts and empty tables give no findings; repeated
rows give repeated results; whole texts are searched, however long. An input column that has the name
of a column that an operator makes, in any case, gives way to it; all others are kept, dots in their names or not.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilscan.functions import detectors as D
from veilscan.functions.raw import SEVERITY, byte_findings, extension, wrong_type
from veilscan.sources import ranges
from veilscan.sources.tables import materialise, others, quoted

VERDICT = ("hiding", "n_findings", "detectors", "score")
FINDING = ("detector", "kind", "ordinal", "preview", "evidence_sha256", "severity")


def scan(docs: DataFrame, text: str = "text", names: dict | None = None) -> DataFrame:
    """V1: `docs` without the text, with `findings`. Projections over one scan, no exchange.

    Every detector's hits are a column first, so that those which build on others don't search again.
    Write the result before filtering or exploding it: Catalyst would run the expressions again.
    """
    rows = docs.select(F.struct(*others(docs, text, "findings")).alias("row"), quoted(text).cast("string").alias("text"))
    hits: dict[str, Column] = {}
    found = []
    for name, (kind, expr, severity) in (names or D.TEXT).items():
        made = expr(F.col("text"), hits)
        if severity is None:
            rows = rows.withColumn("text", made)
            continue
        rows = rows.withColumn(name, made)
        hits[name] = F.col(name)
        found.append(D.findings(hits[name], name, kind, severity))
    return rows.select("row.*", F.concat(*found).alias("findings"))


def scan_files(files: DataFrame) -> DataFrame:
    """V1 on raw files (path, content and others): findings of their bytes and of their content read as text; the content goes.

    A null content has no findings.
    """
    none = F.array().cast(f"array<{D.FINDING}>")
    own = F.when(F.col("content").isNotNull(), byte_findings(F.col("path"), F.col("content"))).otherwise(none)
    rows = files.select(F.struct(*others(files, "content", "findings")).alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), own.alias("own"))
    return scan(rows).select("file.*", F.concat("findings", "own").alias("findings"))


def verdict(scanned: DataFrame) -> DataFrame:
    """V2: hiding, n_findings, detectors and score of each row, clean ones too; no shuffle."""
    hits = F.filter("findings", lambda f: f["severity"] > 0)
    named = F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda f: f["detector"]))), ",")
    score = F.aggregate("findings", F.lit(0).cast("long"), lambda a, f: a + f["severity"])
    return scanned.select(*others(scanned, "findings", *VERDICT), (F.size(hits) > 0).alias("hiding"), F.size("findings").cast("long").alias("n_findings"), named.alias("detectors"), score.alias("score"))


def verdict_files(files: DataFrame, most_bytes: int = 64 << 20, size: int = 16 << 20) -> DataFrame:
    """V2 of raw files (path, length, content and others): the file's own columns and the verdict.

    Files above `most_bytes` are read by byte ranges of `size` from their path, not from `content`, which isn't
    read then. A null length is that of a file read whole.
    """
    large = F.coalesce(F.col("length") > most_bytes, F.lit(False))
    keep = others(files, "content", "findings", *VERDICT)
    small = verdict(scan_files(files.filter(~large).select(*keep, "content")))
    return small.unionByName(verdict_ranges(files.filter(large).select(*keep), size))


def verdict_ranges(files: DataFrame, size: int = 16 << 20) -> DataFrame:
    """V2 of files of any size (path, length and others, parts where they lie in such), by byte ranges: the file's own columns and the verdict.

    Ranges are dealt to all tasks. Each has its text's findings and what its bytes say of the file; a file's
    verdict is the sum of its ranges', combined before they are shuffled, so no row grows with the file. Text is cut between
    lines (see `ranges.cut`), so a finding is lost only if it is a run or an assignment across such a cut. The
    verdict of a file of unknown length is unknown (null).
    """
    parts = ["parts"] if "parts" in files.columns and "path:string" in files.schema["parts"].dataType.simpleString() else []
    keyed = files.select(F.struct(*others(files, *VERDICT)).alias("file"), "path", "length", *parts)
    listed = materialise(keyed.select("path", "length", *parts).distinct())
    facts = ranges.read_ranges(listed, size)
    texts = facts.withColumn("text", F.make_valid_utf8(F.col("content").cast("string"))).drop("content")
    parts = verdict(scan(texts))
    n_inside = F.size("embedded").cast("long")
    total = parts.groupBy("path", "length").agg(
        F.bool_or("hiding").alias("texts"),
        F.sum("n_findings").alias("n"),
        F.collect_set("detectors").alias("names"),
        F.sum("score").alias("points"),
        F.sum(n_inside).alias("inside"),
        F.max("kind").alias("kind"),
        *ranges.ends(),
    )
    total = ranges.with_trailing(total.join(listed, ["path", "length"]) if parts else total)
    b1 = F.coalesce(wrong_type(extension(F.col("path")), F.col("kind")), F.lit(False))
    hits = {"B1": b1.cast("long"), "B2": (F.col("trailing") > 0).cast("long"), "B3": F.col("inside")}
    names = F.filter(F.flatten(F.transform("names", lambda x: F.split(x, ","))), lambda x: x != "")
    names = F.array_sort(F.array_distinct(F.concat(names, *(F.when(n > 0, F.array(F.lit(d))).otherwise(F.array().cast("array<string>")) for d, n in hits.items()))))
    score = F.col("points") + sum((n * SEVERITY[d] for d, n in hits.items()), F.lit(0))
    made = ((F.size(names) > 0), F.col("n") + sum(hits.values(), F.lit(0)), F.array_join(names, ","), score)
    verdicts = total.select("path", "length", *(c.alias(n) for c, n in zip(made, VERDICT, strict=True)))
    return keyed.join(verdicts, ["path", "length"], "left").select("file.*", *VERDICT)


def explode_findings(scanned: DataFrame) -> DataFrame:
    """V3: one row per finding, from a written scan."""
    return scanned.select(*others(scanned, "findings", *FINDING), F.inline("findings"))


def summary(findings: DataFrame, *by: str) -> DataFrame:
    """V4: number of findings by the columns `by`, with subtotals; level tells them apart."""
    grouped = findings.rollup(*by).agg(F.count(F.lit(1)).alias("n_findings"), F.grouping_id().cast("long").alias("level"))
    return grouped.select(*by, "level", "n_findings")


def top_k_per_source(verdicts: DataFrame, k: int) -> DataFrame:
    """V5: the k rows of highest score of each source. Ties go to the smaller doc_id."""
    order = Window.partitionBy("source").orderBy(F.desc("score"), "doc_id")
    return verdicts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def symbol_ratio(text: Column) -> Column:
    """Share of characters that are neither letters, digits nor white space."""
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]")) / F.length(text)).otherwise(F.lit(0.0))


def outliers(docs: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """V6 by mean and deviation: documents whose symbol ratio is far from their language's norm; `robust_outliers` isn't moved by the outliers themselves.

    The norms are aggregated (a row a language) and joined back; a window would put a language in one task.
    Ratios are written, so that texts are read once.
    """
    rated = docs.select("doc_id", "lang", F.round(symbol_ratio(F.col("text")), 9).alias("ratio"))
    rated = materialise(rated)
    norms = rated.groupBy("lang").agg(F.avg("ratio").alias("mean"), F.stddev_pop("ratio").alias("spread"))
    far = rated.join(norms, rated["lang"].eqNullSafe(norms["lang"])).drop(norms["lang"])
    return far.filter(F.abs(F.col("ratio") - F.col("mean")) > sigmas * F.col("spread")).select("doc_id", "lang", "ratio")


def char_entropy(text: Column) -> Column:
    """Bits a character of a whole text; 0 for a null or empty one."""

    @F.pandas_udf("double")
    def bits(text: pd.Series) -> pd.Series:
        return text.map(lambda t: D.entropy(t) if t else 0.0)

    return bits(text)


def middle(counts: DataFrame, value: str) -> DataFrame:
    """(lang, median) of a table of counts (lang, value, n): the least value that half of the rows don't exceed.

    The window holds a row for each value of a figure, which is rounded, so at most some thousands.
    """
    order = Window.partitionBy("lang").orderBy(value)
    run = counts.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    return run.filter(F.col("upto") * 2 >= F.col("all")).groupBy("lang").agg(F.min(value).alias("median"))


def robust_outliers(docs: DataFrame, times: float = 6.0) -> DataFrame:
    """V6: documents whose symbol ratio or entropy lies `times` as far from their language's median as half of its documents do.

    Figures are whole steps (a ten thousandth of the ratio, a hundredth of a bit), so medians and median
    deviations are exact, from counts by language and step; no figure of a document is sorted. A deviation below
    one step counts as one. Returns doc_id, lang, ratio and bits in steps, far_ratio and far_bits.
    """
    text = F.col("text").cast("string")
    steps = {"ratio": F.round(symbol_ratio(text) * 10_000), "bits": F.round(char_entropy(text) * 100)}
    rated = materialise(docs.select("doc_id", "lang", *(F.coalesce(x, F.lit(0)).cast("long").alias(c) for c, x in steps.items())))
    for c in steps:
        counts = rated.groupBy("lang", F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        medians = middle(counts, "value").select(F.col("lang").alias("lang_"), "median")
        away = counts.join(F.broadcast(medians), counts["lang"].eqNullSafe(medians["lang_"])).groupBy("lang", F.abs(F.col("value") - F.col("median")).alias("value")).agg(F.sum("n").alias("n"))
        spreads = middle(away, "value").select(F.col("lang").alias("lang_"), F.greatest("median", F.lit(1)).alias("spread"))
        norms = medians.join(spreads.withColumnRenamed("lang_", "lang_2"), F.col("lang_").eqNullSafe(F.col("lang_2"))).drop("lang_2")
        rated = rated.join(F.broadcast(norms), rated["lang"].eqNullSafe(norms["lang_"])).drop("lang_")
        rated = rated.withColumn(f"far_{c}", F.abs(F.col(c) - F.col("median")) > F.lit(times) * F.col("spread")).drop("median", "spread")
    return rated.filter("far_ratio OR far_bits")
