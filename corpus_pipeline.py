"""Pipeline from raw documents to packed sequences, a stage at a time.

Each stage takes all that its predecessor kept, as a Parquet table, and its
decisions take effect; all but the last return the columns of ``documents``.

Nulls and edge cases, alike for all stages: an empty table gives an empty table;
further columns of any name (also names that the operators give their results,
or with dots) are handed on unchanged; a row is judged by its own text, also
where several rows share a ``doc_id`` or have none.  What a stage does with null
and empty texts and with repeated rows stands in its docstring.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import decontamination, line_dedup, ngram_join, packing, toxicity
from strandloom.llm.shared import one_each, remove, sent, with_rest, without_rest, write_table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator scores under its threshold.

    A null or empty text scores like a text without matched clauses; repeated
    rows score alike, so all of them stay or go; where the labels teach no toxic
    word all rows stay.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat; ``n_chars``, where there is one, follows the text.

    A null text stays null, an empty one empty, and a text that loses every line
    becomes empty; equal rows of one ``doc_id`` do not cut each other, and a row
    without a ``doc_id`` is neither cut nor compared.
    """
    cut = line_dedup.line_dedup(with_rest(docs), keep=("rest",))
    if "n_chars" not in docs.columns:
        return without_rest(cut, docs.columns)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    at, kind = others.index("n_chars"), docs.schema["n_chars"].dataType
    followed = F.when(F.col("n_removed") > 0, F.char_length("text").cast(kind)).otherwise(F.col(f"rest._{at}"))
    rest = F.struct(*[followed.alias(f"_{k}") if k == at else F.col(f"rest._{k}") for k in range(len(others))])
    return without_rest(cut.withColumn("rest", rest), docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest ``doc_id``.

    Near copies share four fifths of their five-word shingles; the defaults of
    ``ngram_components`` are those of op7's query.  Rows are told apart by a
    number of their own, written with them, so of equal rows one stays and of
    rows that share a ``doc_id`` only those go that are copies; where every row
    has a whole number of its own as ``doc_id``, that is it.  A null
    ``doc_id`` comes after all others; texts without words are copies of nothing.
    """
    if one_each(docs, "doc_id"):
        rows = with_rest(docs).withColumn("row", F.col("doc_id").cast("long"))
    else:
        rows = write_table(with_rest(docs).withColumn("row", F.monotonically_increasing_id()), "numbered")
    classes = ngram_join.ngram_components(rows, n=5, percent=80, id_col="row")
    ranked = classes.select(F.col("doc_id").alias("row"), "component_id").join(rows.select("row", "doc_id"), "row")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    stays = ranked.groupBy("component_id").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    stays = write_table(stays, "stays")  # of its own, so that the join with it can split a component of very many rows
    copies = ranked.join(stays, "component_id").where(F.col("row") != F.col("first.row")).select("row")
    return without_rest(rows.join(sent(write_table(copies, "copies")), "row", "left_anti"), docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages are less than a twentieth.

    Null and empty texts have no words and stay; repeated rows are judged alike.
    """
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contamination(with_rest(docs), bench, keep=("text", "rest"))
    return without_rest(found.where(~F.col("contaminated")), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of 1024 ids.

    A null text is empty and has its end id; repeated rows are packed each.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", cut_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Learned scores and byte-pair ids have no SQL form; tests hold each stage to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage before it is written and read again.

    A stage's table is removed once the next stage's has been written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
