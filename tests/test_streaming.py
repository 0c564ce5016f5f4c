import tempfile
import uuid

from binscope.streaming.apply import bin_stream


def test_bins_on_a_stream_equal_batch(spark, sf001):
    li = spark.read.parquet(f"{sf001}/lineitem.parquet")
    splits = {"l_quantity": [13.0, 26.0, 38.0], "l_discount": [0.02, 0.05]}
    src = tempfile.mkdtemp(prefix="binscope-stream-") + "/in"
    li.write.parquet(src)
    stream = spark.readStream.schema(li.schema).parquet(src)
    out = bin_stream(stream, list(splits), splits, keep=["l_orderkey", "l_linenumber"])
    name = "bins_" + uuid.uuid4().hex[:8]
    q = out.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql(f"SELECT factor, bin, count(*) AS n FROM {name} GROUP BY factor, bin")
    batch = bin_stream(li, list(splits), splits, keep=["l_orderkey", "l_linenumber"]) \
        .groupBy("factor", "bin").count().withColumnRenamed("count", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    assert sum(r.n for r in got.collect()) == 2 * li.count()
