"""Feature matrices over a stream.

A fitted builder's transform is a projection, so it runs on a streaming frame as it
does on a batch: REDUCED, or FULL with the child-table features on the row.
"""

from riskmart import schema as S
from riskmart.operators import features


def stream_matrix(stream, builder, for_linear=False, key=S.KEY):
    tier = builder.getOrDefault("tier").upper()
    if tier == features.FULL:
        return features.build_full(stream, builder, for_linear, None, key, validate=False)
    return features.build_reduced(stream, builder, for_linear, key)


def run_stream(spark, source, schema, builder, sink, checkpoint, for_linear=False, key=S.KEY):
    """Parquet folder to Parquet folder, everything available now; returns the query."""
    stream = spark.readStream.schema(schema).parquet(source)
    return (
        stream_matrix(stream, builder, for_linear, key)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("append")
        .start(sink)
    )
