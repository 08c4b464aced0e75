"""Flow 1: the corpus verdict, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilscan.operators import scan as S
from veilscan.sources.tables import materialise, read_text_docs, spread, write_findings


def corpus_verdict(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, lang, source and the verdict of every document: one scan, nothing shuffled unless the files are too few for the cores."""
    return S.verdict(S.scan(spread(read_text_docs(spark, folder))))


def corpus_report(spark: SparkSession, folder: str, out: str, k: int = 20) -> None:
    """Verdicts, findings by detector, a summary with subtotals and each source's worst documents, all from one written scan."""
    scanned = materialise(S.scan(spread(read_text_docs(spark, folder))))
    verdicts = S.verdict(scanned)
    verdicts.write.mode("overwrite").parquet(f"{out}/verdicts")
    found = S.explode_findings(scanned)
    write_findings(found, f"{out}/findings")
    S.summary(found, "lang", "source", "detector").write.mode("overwrite").parquet(f"{out}/summary")
    S.top_k_per_source(verdicts, k).write.mode("overwrite").parquet(f"{out}/top")
