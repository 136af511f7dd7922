import datetime

import pandas as pd
from pyspark.sql import functions as F

from cellspindle.streaming import blocks

SCHEMA = "qname string, flag int, chrom string, pos int, tags map<string,string>, loaded_at timestamp"


def test_stream_equals_batch(spark, tmp_path):
    day = datetime.datetime(2024, 6, 1)
    rows = [(f"q{i}", 0, "c", i, {"CB": f"b{i % 3}"} if i % 7 else {}, day + datetime.timedelta(hours=i)) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = blocks.running_counts(stream).writeStream.format("memory").queryName("running").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in blocks.running_counts(df).collect()}
    assert {tuple(r) for r in spark.table("running").collect()} == want and len(want) > 3


def test_deliveries(spark, tmp_path):
    day = datetime.datetime(2024, 6, 1)
    df = spark.createDataFrame([("q", 0, "c", 1, {}, day), ("q", 0, "c", 1, {}, day + datetime.timedelta(days=1)), ("r", 0, "c", 1, {}, day)], SCHEMA)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = blocks.first_deliveries(stream).writeStream.format("memory").queryName("first").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.qname for r in spark.table("first").collect()) == ["q", "r"]


def reads(spark):
    rows = [(0, i, f"r{i}|||CB:Z:{c}", s, "I" * len(s)) for i, (c, s) in enumerate([("A", "AC"), ("A", "ACG"), ("B", "G"), ("A", "T")])] + [(0, 9, "bare", "T", "I")]
    return spark.createDataFrame(rows, "file_no int, record_no long, name string, seq string, qual string")


def test_block_ids(spark):
    got = {r.record_no: r.block for r in blocks.block_ids(reads(spark).where("record_no < 9"), ["CB"]).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 3}


def test_apply(spark):
    def longest(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.loc[[pdf["seq"].str.len().idxmax()]].assign(name="new")

    out = blocks.apply_to_blocks(reads(spark), ["CB"], longest)
    assert {tuple(r) for r in out.collect()} == {("new|||CB:Z:A", "ACG", "III"), ("new|||CB:Z:B", "G", "I")}
    assert {r.name for r in blocks.apply_to_blocks(reads(spark), ["CB"], longest, least=2).collect()} == {"new|||CB:Z:A"}
    kept = blocks.apply_to_blocks(reads(spark), ["CB"], longest, least=2, keep_small=True)
    assert {r.name for r in kept.collect()} == {"new|||CB:Z:A", "r2|||CB:Z:B"}
    sliced = blocks.apply_to_blocks(reads(spark), ["CB"], lambda p: p, slice_rows=1)
    assert sliced.select(F.sum(F.length("seq"))).first()[0] == 7
