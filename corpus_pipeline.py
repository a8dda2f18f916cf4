"""A training-corpus pipeline over ``documents``: five stages, each written as
Parquet and read again as the next one's input.

1. language_id: labels every text, learning from the rows that aren't held out;
   texts without a letter, texts in scripts that no language was learned for and
   texts in which no language holds three tenths of the letters go (one in two
   languages stays). The lang column becomes the label.
2. near_dedup: sets of five-word shingles, similarity 0.8; of each component the
   smallest id stays. Texts without words have no duplicates and stay.
3. decontaminate: documents of which a twentieth or more of the words lies in
   13-word windows of ``benchmark`` go.
4. secrets: found spans are replaced in the text; all documents stay.
5. byte_bpe: encodes every text and decodes it again; one row per document.

Defined cases are those of the operators: a null text has no letter, so stage 1
drops it; rows that share an id count as one document; an empty table passes
through as empty tables. SQL can't express stages 1 and 5 (learned labels and
merge ranks), so there is no SQL; tests compare with brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import byte_bpe, decontaminate, language, near_dedup, secrets
from sievewright.llm.common import discard, held_out, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit_languages(docs.where(~held_out(F.col("doc_id"))))
    labelled = language.label_languages(docs, model, extra=("text", "source", "n_chars"))
    kept = labelled.where("lang_pred <> 'und' AND score >= 0.3")
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(docs, k=5, percent=80)
    gone = found.where("NOT kept").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), extra=COLUMNS[1:])
    return decontaminate.contamination_digest(found, *COLUMNS[1:]).where("NOT contaminated").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    redacted = secrets.redact(docs.select(*COLUMNS))
    return redacted.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.token_digest(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_duplicates),
    ("decontaminate", decontamination),
    ("secrets", secret_scan),
    ("byte_bpe", encoding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(spark, *before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
