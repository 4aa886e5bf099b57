import random

from strandloom.streaming import counts as C


def test_batches_add_up_to_the_whole(spark, tmp_path):
    rng = random.Random(3)
    base = "".join(rng.choice("ACGT") for _ in range(120))
    rows = [(i, base[i : i + 60]) for i in range(0, 60, 5)] + [(99, None), (100, "ACG")]
    for k in range(3):
        spark.createDataFrame(rows[k::3], "read_id long, seq string").write.parquet(f"{tmp_path}/in/part={k}")
    stream = spark.readStream.schema("read_id long, seq string").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in/part=*")
    C.ingest(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    whole = C.kmer_counts(spark.createDataFrame(rows, "read_id long, seq string"))
    assert sorted(map(tuple, C.current(spark, f"{tmp_path}/out").collect())) == sorted(map(tuple, whole.collect()))
