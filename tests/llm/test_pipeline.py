"""The pipeline on a small table, stage by stage."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    import random

    rng = random.Random(2)
    words = [f"word{k}" for k in range(300)]
    text = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(12)) + "." for _ in range(n))
    docs = [(k, text(6)) for k in range(60)]
    docs += [(100 + k, docs[k][1]) for k in range(5)] + [(200 + k, " ".join(w + "***" for w in text(4).split())) for k in range(20)]
    rows = [(i, t, "en", "s", len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 200), 0) for i, _ in docs], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert len(pipeline.STAGES) == 5
    at, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    columns = at.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        at.unpersist()
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{k}"))
        at = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen.append(sorted(r[0] for r in at.select("doc_id").collect()))
        assert k == len(pipeline.STAGES) - 1 or at.columns == columns
    assert seen[0] == [*range(60), *range(100, 105)]
    assert seen[1] == list(range(60)) and seen[2] == list(range(60))
    assert set(seen[3]) == set(seen[4]) == set(range(60))
    assert pipeline.run(spark, str(tmp_path)).count() == at.count()
