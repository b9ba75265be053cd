"""From raw documents to packed sequences: the stages, their order and their SQL.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Columns of
docs beyond those a stage reads are carried along, whatever their names.
"""

import public_tokenizers
from pyspark.sql import functions as F

from riskmart.llm import decontamination, jaccard, packing, pii, toxicity
from riskmart.llm.storing import kept, rows_with


BATCH_ROWS = 1000        # whole texts that pass between Spark and Python at once


def _numbered(docs):
    """The rows under numbered names, so that no names clash with an operator's, and the text's name.

    Every stage begins here, so this also bounds the batches that its tasks hold.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), f"c{docs.columns.index('text')}"


def _named(rows, docs):
    """The columns of docs, from numbered ones."""
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def drop_toxic(spark, docs, sf_dir):
    """Documents that the severity model does not find toxic; null and empty texts stay."""
    rows, text = _numbered(docs)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _named(toxicity.score_toxicity(rows, model, text).where("p_toxic < 0.5"), docs)


def drop_near_duplicates(spark, docs, sf_dir):
    """One row of each group of near duplicates: of those with its smallest id the first by text.

    Rows of one id are told apart by their texts. Documents without words and rows without an
    id belong to no group and stay.
    """
    rows, text = _numbered(docs)
    name = f"c{docs.columns.index('doc_id')}"
    sets = kept(jaccard.placed_sets(docs))
    ids = sets.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("head")
    ).where("head").select(F.col("doc_id").alias(name), (F.col("n") > 1).alias("again"))
    ids = kept(ids)
    once = rows_with(rows, kept(ids.where("not again").select(name)), name).select(*rows.columns)
    # rows that repeat an id: each by its own set
    again = kept(ids.where("again").select(name))
    named = jaccard.with_names(rows_with(rows, again, name).select(*rows.columns), text)
    heads = sets.where("n_shingles > 0 and doc_id = component_id").select(F.col("doc_id").alias(name), "key", "root").distinct()
    placed = rows_with(named, kept(heads.join(again, name, "left_semi")), [name, "key"])
    row = F.struct(*rows.columns)
    first = placed.groupBy("root").agg(F.min_by(row, text).alias("row")).select("row.*")
    empty = named.where("n_shingles = 0").select(*rows.columns)
    return _named(once.unionByName(first).unionByName(empty).unionByName(rows.where(f"{name} is null")), docs)


def drop_leaks(spark, docs, sf_dir):
    """Documents in which no benchmark item is found."""
    rows, text = _numbered(docs)
    found = decontamination.find_leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text)
    return _named(found.where(F.size("leaks") == 0), docs)


def mask_personal(spark, docs, sf_dir):
    """All documents, with personal data in their texts replaced by its kind and n_chars counted anew."""
    rows, text = _numbered(docs)
    model = pii.fit(docs)
    whole = _named(pii.mask_personal(rows, model, text), docs)
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return whole.withColumn("n_chars", length)


def pack_sequences(spark, docs, sf_dir):
    """One row per piece of a document: its place in a sequence of 1024 tokens and a digest of its ids."""
    _numbered(docs)
    vocabulary = [public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken")]
    pieces = packing.token_pieces(docs, *vocabulary)
    digests = kept(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packing.pack(digests, ["doc_id", "start", "salt"]).drop("salt")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", mask_personal),
    ("packing", pack_sequences),
]
ORACLE_SQL = None      # models and tokenizers have no SQL; the tests compare with brute force


def run(spark, sf_dir):
    """Applies STAGES to the documents of a folder; each stage's rows are stored before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir))
    return docs
