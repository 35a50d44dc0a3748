from inkmill.streaming import events


def _drain(spark, df, name, mode="append"):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_windows_agree_with_batch(spark, sf_dir):
    stream = events.tumbling(events.events(spark, sf_dir)).select("window.start", "event_type", "n")
    batch = events.tumbling(spark.read.schema(events.SCHEMA).parquet(f"{sf_dir}/events.parquet")).select("window.start", "event_type", "n")
    got = _drain(spark, stream, "hourly")
    assert got.count() > 0 and got.join(batch, ["start", "event_type", "n"], "left_anti").count() == 0


def test_rescored(spark, sf_dir):
    got = _drain(spark, events.rescored(events.events(spark, sf_dir)), "rescored", "update")
    assert got.count() > 0 and all(30 <= r.score <= 100 for r in got.collect())


def test_two_phase(spark, sf_dir, tmp_path):
    query = events.two_phase(events.events(spark, sf_dir), f"{tmp_path}/out", f"{tmp_path}/ck")
    query.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()
