"""The five stages on a small corpus: what has to go goes, clean documents stay, and columns are kept."""

import random

import corpus_pipeline
from reliefgrid.llm import language_id


def test_stages(spark, tmp_path):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = []
    for k in range(40):
        rows.append((k, "\n".join(" ".join(word() for _ in range(30)) for _ in range(4)), ["en", "de"][k % 2], f"s{k % 3}", 0))
    near = rows[7][1].split(" ")
    near[50] = "other"
    rows += [(40, "12 34", "en", "s0", 5), (41, None, "en", "s1", 0), (42, rows[5][1], "de", "s2", 0), (43, " ".join(near), "en", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "bpe":
            assert out.columns == docs.columns
        seen[name] = out.collect()
        docs = spark.createDataFrame(seen[name], out.schema)
    ids = {k: {x.doc_id for x in v} for k, v in seen.items()}
    assert ids["language_id"] == set(range(44)) - {40, 41}
    assert all(x.lang in ("en", "de") for x in seen["language_id"])
    assert next(x.text for x in seen["line_dedup"] if x.doc_id == 42) == ""
    assert ids["ngram_join"] >= set(range(40))
    assert ids["mixing"] <= ids["ngram_join"] and ids["bpe"] == ids["mixing"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["bpe"])


def test_the_model_decides(spark):
    """A wrong label and a missing one are set by the model, and a text that is as much of one language as of the others goes."""
    r = random.Random(4)
    say = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(k, say(["abcde", "fghij", "klmno"][k % 3], 60), ["aa", "ff", "kk"][k % 3], "s", 0) for k in range(60)]
    rows += [(60, say("abcde", 30), "ff", "s", 0), (61, say("fghij", 30), None, "s", 0), (None, say("klmno", 9), "kk", "s", 0)]
    strange = [(100 + k, say("pqrstuvwxyz", 1), None, "s", 0) for k in range(100)]
    docs = spark.createDataFrame(rows + strange, "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id: x.lang for x in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert got[60] == "aa" and got[61] == "ff" and got[None] == "kk"
    model = language_id.train(docs)
    unsure = {x[0] for x, p in zip(strange, model.predict([x[1] for x in strange])[1]) if p < corpus_pipeline.SURE}
    assert unsure and unsure == {x[0] for x in strange} - set(got)
    assert all(got[k] == lang for k, _, lang, *_ in rows[:60])
