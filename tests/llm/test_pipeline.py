"""The corpus pipeline on planted cases, stage by stage."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rnd = random.Random(7)
    voc = [f"term{k}" for k in range(4000)]
    line = lambda n: " ".join(rnd.choice(voc) for _ in range(n)) + "."
    text = lambda k=4: "\n".join(line(25) for _ in range(k))
    clean = {i: text() + ("\n\n \n" + text(1) + "\n" if i % 3 == 0 else "") for i in range(30)}  # blank lines stay too
    item = line(40)
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in clean.items()]
    long_line = " ".join(rnd.choice(voc) for _ in range(1500)) + "."
    near = long_line.replace(long_line.split()[700], "otherword", 1)
    rows += [(40, clean[3], "en", "src1", 1), (41, "A | b | c | d\n" * 30, "en", "src1", 1), (42, text(2) + "\n" + item, "en", "src2", 1), (43, None, None, None, None), (50, long_line, "en", "src0", 1), (51, near, "en", "src0", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    keep = set(clean)
    assert ids[0] == keep | {40, 42, 50, 51} and ids[1] == keep | {42, 50, 51}
    assert ids[2] == keep | {42, 50} and ids[3] == ids[2] - {42}
    assert ids[4] <= ids[3]
    same = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "s3")).collect()}
    assert all(same[i] == t for i, t in clean.items())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.select("doc_id", "epoch", "taken").collect())) == sorted(map(tuple, docs.select("doc_id", "epoch", "taken").collect()))


def test_defined_cases(spark, tmp_path):
    """Nulls, repeated rows, an empty table and columns with awkward names."""
    rnd = random.Random(9)
    text = lambda: "\n".join(" ".join(f"t{rnd.randrange(5000)}" for _ in range(30)) + "." for _ in range(4))
    one, two = text(), text()
    rows = [(1, one, "en", None, 0, "a"), (1, one, "en", None, 0, "b"), (2, two, None, "s", 0, None), (None, text(), "en", "s", 0, "c"), (3, None, None, None, None, None), (4, "", "de", "s", 0, "d"), (5, "short", "de", "s", 0, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, position string")
    df = df.withColumnsRenamed({"lang": "lines"}).withColumn("leaks", df.position)
    spark.createDataFrame([(1, "an item that nothing holds at all here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs, want in ((df, {1, 2, None}), (df.limit(0), set())):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == df.columns if k < 4 else out.columns == [*df.columns, "epoch", "taken", "position_"]
            path = str(tmp_path / f"d{k}{len(want)}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            assert {r.doc_id for r in docs.select("doc_id").collect()} == want
