import pyarrow as pa
from pyspark.sql import functions as F

from acrely.session import prepare


def test_batches_of_long_texts_are_bounded_in_bytes(spark):
    prepare(spark)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "bytes"])

    long = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    found = long.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in found) == 400
    assert len(found) > 1 and max(r.bytes for r in found) < 17_000_000
