"""From raw documents to token files: five of the text operators, one after another.

Every stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor
kept and returns a DataFrame; ``run`` writes each result to the shared folder as
Parquet and reads it again for the next. All stages but the last return the
columns of ``documents``; columns that ``docs`` has beyond those are dropped.

1. quality rules: documents with too few or too many repeated words go, and so do
   outliers among their language and source.
2. near duplicates: documents whose SimHash fingerprints over three-word shingles
   differ in two bits at most are linked; of each component one document stays, the
   one with the smallest doc_id.
3. decontamination: documents that hold a benchmark item go.
4. mixing: blocks of words are drawn so that sources have their target shares. A
   document has a row for each pass over its source that takes any of it, with the
   words taken; a document taken whole keeps its text.
5. token files: the mix is encoded and written, and read back as one row per
   document row: doc_id, start, n_tokens, ids_crc32.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lotframe.llm.decontamination import without_contaminated
from lotframe.llm.mixing import Mix
from lotframe.llm.near_duplicates import near_duplicate_components, one_per_component
from lotframe.llm.quality import kept_documents
from lotframe.llm.token_files import token_file_digest
from lotframe.sources.staging import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHINGLE_WORDS, MOST_BITS = 3, 2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_documents(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    return one_per_component(docs, near_duplicate_components(docs, SHINGLE_WORDS, MOST_BITS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without_contaminated(docs.select(*COLUMNS), benchmark)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = Mix(docs.select(*COLUMNS)).texts()
    return mixed.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_file_digest(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source mix", source_mix),
    ("token files", token_files),
]

#: No SQL states the outlier estimates, the component search or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``sf_dir``/documents.parquet."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, function) in enumerate(STAGES):
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{number}-{name.replace(' ', '-')}")
    return docs
