"""The pipeline's stages on a small corpus, each against what it must keep."""

import random

from test_llm_operators import brute_components, words

import corpus_pipeline


def test_stages(spark, tmp_path):
    r = random.Random(1)
    texts = [" ".join(words(i, 60, 5000)) for i in range(200)]
    toxic = [i for i in range(200) if i % 5 == 0]
    for i in toxic:
        texts[i] += " idiot moron scum"
    texts += [texts[1], texts[2] + " ", None, "12 34", texts[3].replace(" ", "  ")]
    near = texts[7].split()
    near[30] = "changed"
    texts.append(" ".join(near))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(200) if r.random() < 0.9], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        frame = spark.read.parquet(f"{tmp_path}/{k}")
        assert frame.columns == [c.split()[0] for c in shape.split(", ")]
        kept[name] = {x.doc_id for x in frame.collect()}
    whole = set(range(len(texts)))
    assert kept["toxicity"] == whole - set(toxic)
    assert kept["language"] == kept["toxicity"] - {202, 203}
    assert kept["exact_dedup"] == kept["language"] - {200, 2, 3} and {201, 204} <= kept["exact_dedup"]
    left = sorted(kept["exact_dedup"])
    want = {left[root] for _, root in brute_components([texts[i] for i in left], 5, 80)}
    assert kept["shingle_join"] == want and 205 not in want
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {x.doc_id for x in packed.select("doc_id").distinct().collect()} == want


def test_stages_of_nothing(spark, tmp_path):
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], shape).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
