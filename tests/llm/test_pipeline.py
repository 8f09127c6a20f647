import numpy as np
from pyspark.sql import functions as F


def test_stages_keep_columns_and_take_effect(spark):
    import corpus_pipeline as p
    from fieldloom.llm import decontam, neardup, toxicity
    from fieldloom.llm.common import table

    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents").cache()
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "mixing"]
    frames = [docs]
    for name, stage in p.STAGES:
        out = stage(spark, frames[-1], d).cache()
        if name != "mixing":
            assert out.columns == docs.columns
        frames.append(out)
    ids = [{r["doc_id"] for r in f.select("doc_id").collect()} for f in frames]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] == ids[4] == ids[5]
    scored = toxicity.scores(docs, toxicity.train(docs, table(spark, d, "labels")))
    assert ids[1] == {r["doc_id"] for r in scored.filter("predicted = 0").collect()}
    assert ids[2] == {r["doc_id"] for r in neardup.near_duplicates(frames[1]).filter("kept").collect()}
    assert ids[2] - ids[3] == {r["doc_id"] for r in decontam.contaminated(frames[2],
        table(spark, d, "benchmark")).collect()}
    assert frames[4].filter(F.col("text").rlike(r"[a-z]@[a-z0-9]+\.example")).count() == 0
    assert frames[5].filter("taken > 2 * size").count() == 0


def tables(spark, folder, docs, labels, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_with_nulls_repeated_ids_and_leaks(spark, tmp_path):
    import corpus_pipeline as p

    words = lambda tag, n: " ".join(f"{tag}{j}" for j in range(n))
    item = words("item", 30)
    docs = [(1, words("x", 40), "en", "a", 0), (1, words("x", 40), "en", "a", 0), (5, words("x", 40), "en", None, 0),
        (5, words("own", 30), None, "b", 0)]
    docs += [(6, None, None, None, None), (7, "", "en", "a", 0), (None, words("n", 20), "en", "b", 0),
        (8, f"{words('pre', 9)} {item} {words('post', 9)}", "en", "a", 0)]
    docs += [(9, f"write to kim@site.org {words('long', 3000)}", "en", "b", 0),
        (10, f"vile0 vile1 {words('calm', 5)}", "en", "b", 0)]
    docs += [(100 + i, f"vile{i % 3} vile{i % 2} {words(f'k{i}', 20)}" if i % 4 == 0 else f"{words(f'm{i}', 20)}", "en",
        "a", 0) for i in range(80)]
    pool = [w for t in ("x", "own", "n", "pre", "item", "post", "long", "calm") for w in words(t, 60).split()]
    rng = np.random.default_rng(1)
    docs += [(1000 + i, " ".join(rng.choice(pool, 60)), "en", "a", 0) for i in range(200)]
    labels = [(1000 + i, 1, 0) for i in range(200)] + [(100 + i, 1, int(i % 4 == 0)) for i in range(80)] + [(None, 1,
        1), (6, 1, None), (999, 0, 1)]
    sf = tables(spark, tmp_path, docs, labels, [(1, item), (2, None), (3, "")])
    frames = [spark.read.parquet(f"{sf}/documents.parquet")]
    for _, stage in p.STAGES:
        frames.append(stage(spark, frames[-1], sf).cache())
    assert all(f.columns == frames[0].columns for f in frames[:-1])
    kept = [(r["doc_id"], r["text"]) for r in frames[4].collect()]
    ids = [i for i, _ in kept]
    assert ids.count(1) == 1 and ids.count(5) == 1 and ids.count(None) == 1 and 8 not in ids and {6, 7, 9} <= set(ids)
    assert dict(kept)[5] == words("own", 30) and dict(kept)[9] == f"write to <EMAIL> {words('long', 3000)}" and dict(
        kept)[6] is None
    assert all(100 + i in ids for i in range(80) if i % 4)
    assert frames[5].count() == len(kept)
    assert sorted(map(str, p.run(spark, sf).collect())) == sorted(map(str, frames[5].collect()))


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    assert p.run(spark, tables(spark, tmp_path, [], [], [])).count() == 0
