"""A stream gives what the batch gives for the windows that are closed."""

from quarry.streaming.counts import first_of_each, windowed

SF = "/root/testdata/sf0.001"


def run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_windows(spark):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(batch.schema).parquet(f"{SF}/events.parquet*")
    want = {tuple(r) for r in windowed(batch, "ts", "6 hours", "1 hour", ["event_type"], "value").select("event_type", "start", "n").collect()}
    got = {tuple(r) for r in run(spark, windowed(stream, "ts", "6 hours", "1 hour", ["event_type"], "value"), "windows").select("event_type", "start", "n").collect()}
    assert got and got <= want and len(want) - len(got) <= 10


def test_repeats(spark):
    batch = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts")
    stream = spark.readStream.schema(batch.schema).parquet(f"{SF}/events.parquet*")
    got = run(spark, first_of_each(stream.union(stream), "ts", "1 hour", ["event_id"]), "firsts")
    assert got.count() == batch.count()
