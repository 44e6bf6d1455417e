from readqc.operators import cube
from readqc.schema import READS
from readqc.streaming import incremental
from tests.test_operators import frame, random_reads


def test_stream_of_files_gives_the_counts_of_all(spark, tmp_path):
    reads = frame(spark, random_reads(120))
    source = str(tmp_path / "in")
    reads.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(READS).option("maxFilesPerTrigger", 1).parquet(source)
    seen = {}

    def keep(df, _):
        seen["rows"] = {(r.pos, r.base, r.q): r.n for r in df.collect()}

    q = incremental.follow(incremental.position_counts(stream), keep, str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert seen["rows"] == {(r.pos, r.base, r.q): r.n for r in cube.exploded(reads).collect()}


def test_key_sample_counts_its_keys_wholly(spark):
    reads = frame(spark, random_reads(300))
    whole = {r.seq: r.n for r in incremental.key_counts(reads).collect()}
    some = {r.seq: r.n for r in incremental.key_counts(reads, 3).collect()}
    assert 0 < len(some) < len(whole) and all(whole[k] == n for k, n in some.items())
