"""Exact duplicates by a persistent index of text digests.

The index is a table in the shared folder, bucketed and sorted by digest. New data is reduced
to one row per digest, deduplicated by a sort-merge anti-join with the index, which the
buckets leave where it is, and what is new is appended. DataFrame and SQL functions only.
"""

from string import ascii_lowercase, ascii_uppercase
from uuid import uuid4

from pyspark.sql import DataFrame, functions as F

from riskmart.lineage import shared_folder
from riskmart.llm.storing import kept, partitions
from riskmart.operators.keys import HOT_SHARE, join_many_to_one


def text_digest(text_col):
    """SHA-256 of the whole text, A-Z in lower case, as bytes; a null text counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.unhex(F.sha2(F.translate(text, ascii_uppercase, ascii_lowercase), 256))


class DigestIndex:
    """(digest, keep_id): every text seen so far and the id of the row that stays for it.

    A text that is in the index keeps its row, whatever comes later. Adding the same batch
    again adds nothing, so a batch that failed half-way can be repeated.
    """

    def __init__(self, spark, path, buckets, id_type):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digests_{uuid4().hex}"
        spark.sql(
            f"create table {self.name} (digest binary, keep_id {id_type}) using parquet "
            f"clustered by (digest) sorted by (digest) into {buckets} buckets location '{path}/digests'"
        )

    @classmethod
    def create(cls, spark, path=None, buckets=None, id_type="bigint"):
        """A new, empty index; by default in the shared folder, with as many buckets as there are shuffle partitions."""
        path = path or f"{shared_folder(spark).rstrip('/')}/digest-index-{uuid4().hex}"
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        layout = spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(id_type).alias("id_type"))
        layout.write.json(f"{path}/layout")
        return cls(spark, path, buckets, id_type)

    @classmethod
    def open(cls, spark, path):
        """An index that an earlier session has left under the path."""
        layout = spark.read.schema("buckets int, id_type string").json(f"{path}/layout").first()
        return cls(spark, path, layout["buckets"], layout["id_type"])

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, batch: DataFrame) -> None:
        """Appends the digests of (digest, id) rows that are new, each with its largest id."""
        best = batch.groupBy("digest").agg(F.max("id").alias("keep_id"))
        fresh = best.join(self.table().hint("merge"), "digest", "left_anti")
        fresh.select("digest", "keep_id").write.insertInto(self.name)

    def close(self) -> None:
        """Forgets the table's name; its files stay and can be opened again."""
        self.spark.sql(f"drop table if exists {self.name}")


def digest_rows(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, digest, place), stored: texts are read and hashed once. `place` tells equal rows apart."""
    return kept(docs.select(
        F.col(id_col).alias("id"), text_digest(text_col).alias("digest"), F.monotonically_increasing_id().alias("place")
    ))


def add_by_id(index: DigestIndex, rows: DataFrame, rounds=4) -> None:
    """Adds stored rows with whole-number ids in rounds of falling ids, so that of equal texts
    the row with the largest id stays. Rows without an id come last."""
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    if low is not None:
        edges = [low + (high - low + 1) * i // rounds for i in range(rounds + 1)]
        for start, end in reversed(list(zip(edges, edges[1:]))):
            if start < end:
                index.add(rows.where((F.col("id") >= start) & (F.col("id") < end)))
    index.add(rows.where("id is null"))


def matched(index: DigestIndex, rows: DataFrame) -> DataFrame:
    """The rows with keep_id, group_size (rows of that text among `rows`) and kept.

    One row of a text stays at most, also where an id repeats; none, if the index had the text
    before. Texts with very many rows meet their group over salts.
    """
    sizes = rows.groupBy("digest").agg(
        F.count("*").alias("group_size"), F.max(F.struct("id", "place"))["place"].alias("last")
    )
    groups = kept(sizes.join(index.table().hint("merge"), "digest"))
    least = rows.count() / (HOT_SHARE * partitions(rows))
    # fewer than HOT_SHARE times the partitions
    hot = [r["digest"] for r in groups.where(F.col("group_size") > least).select("digest").collect()]
    stays = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("place") == F.col("last"))
    return join_many_to_one(rows, groups, "digest", hot=hot).withColumn("kept", stays)


def exact_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", index=None) -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept and text_sha256.

    Texts are equal when they are the same after A-Z became lower case. Of equal texts the row
    with the largest id stays; a text that `index` already holds keeps the row it has there.
    Null and empty texts are equal. Rows without an id count as the smallest; of rows that
    repeat id and text one stays. An empty table gives no rows; other columns are not read.
    Texts are hashed whole, whatever their length.
    """
    rows = digest_rows(docs, id_col, text_col)
    mine = index or DigestIndex.create(docs.sparkSession, id_type=docs.schema[id_col].dataType.simpleString())
    add_by_id(mine, rows)
    out = matched(mine, rows).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )
    if index is None:
        mine.close()
    return out
