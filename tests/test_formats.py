"""Text formats: readers, detection, tags, counters and compressed input."""

import gzip

from readloom.sources import records as R


def test_read_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">chr1 first\nACGT\nAC\n>chr2\nggtt\n")
    (tmp_path / "a.fq").write_text("@r1/1\nACGT\n+\n@III\n@r2 2:Y:18:ATCACG\nTT\n+\nII\n")
    with gzip.open(tmp_path / "a.map.gz", "wt") as f:
        f.write("ID\tACGT\t####\t1:1\tchr1:-:20:4,chr9:+:50:2C1\nA/1\tAAA\t###\t0\t-\n")
    (tmp_path / "a.sam").write_text("@SQ\tSN:chr1\tLN:9\nq\t16\tchr1\t5\t60\t3M1I2D4M\t*\t0\t0\tACGTACGT\tIIIIIIII\tNM:i:3\tXA:Z:a\n")
    read = lambda n: R.read_alignments(spark, str(tmp_path / n))
    assert [tuple(r) for r in read("a.fa").orderBy("seq_name").collect()] == [("chr1", "ACGTAC"), ("chr2", "GGTT")]
    fq = {r.tag: r for r in read("a.fq").collect()}
    assert (fq["r1"].pair, fq["r1"].read, fq["r1"].qualities) == (1, "ACGT", "@III")
    assert (fq["r2"].pair, fq["r2"].casava) == (2, "2:Y:18:ATCACG")
    maps = {r.tag: r for r in read("a.map.gz").collect()}
    assert [m.position for m in maps["ID"].maps] == [20, 50] and maps["ID"].counters == [1, 1]
    assert maps["A"].maps == [] and maps["A"].pair == 1
    sam = read("a.sam").collect()[0]
    assert (sam.flag, sam.pos, sam.tags["NM"], [e.op for e in sam.script]) == (16, 5, "3", ["M", "I", "D", "M"])


def test_counters(spark):
    row = spark.createDataFrame([("0:1+0x3",), ("0:2",), ("!",)], "t string").select(*[c.alias(n) for n, c in R.parse_counters(R.F.col("t")).items()]).collect()
    assert (row[0].counters, row[0].mcs) == ([0, 1, 0, 0, 0], 2)
    assert (row[1].counters, row[1].mcs, row[2].not_unique) == ([0, 2], None, True)


def test_streaming_template_size(spark, tmp_path):
    from readloom.streaming.template_length import windowed_template_size

    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id) AS ts, id AS template_length FROM range(50)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_template_size(stream).writeStream.format("memory").queryName("sizes").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("SELECT * FROM sizes").orderBy("begin").collect()
    assert got == windowed_template_size(rows).orderBy("begin").collect() and len(got) == 3


def test_fastq_across_splits(spark, tmp_path):
    """Quality lines that begin with @ and look like names, in splits of some dozen bytes."""
    from readloom.sources import records as R

    rows = [(f"r{i}/1", "ACGT" * (i % 5 + 1), ("@r" + "+" * 30)[: 4 * (i % 5 + 1)]) for i in range(300)]
    (tmp_path / "a.fastq").write_text("".join(f"@{n}\n{r}\n+\n{q}\n" for n, r, q in rows))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "700")
    try:
        got = R.read_fastq(spark, str(tmp_path / "a.fastq"))
        assert got.rdd.getNumPartitions() >= 1 and sorted((f"{x.tag}/{x.pair}", x.read, x.qualities) for x in got.collect()) == sorted(rows)
    finally:
        spark.conf.set(name, before)


def test_counters_of_many_strata(spark):
    from pyspark.sql import functions as F

    from readloom.sources import records as R

    df = spark.createDataFrame([([1] * 1500,)], "c array<long>")
    text = df.select(R.render_counters(F.col("c"), 2).alias("t")).first().t
    assert text == "1:1+" + ":".join(["1"] * 1498)
    back = df.select(*[c.alias(n) for n, c in R.parse_counters(F.lit(text)).items()]).first()
    assert (len(back.counters), back.mcs) == (1500, 2)
