from collections import Counter

import corpus_pipeline as P
from test_decontaminate import plain_words
from test_shingles import brute as groups

from leafmill.llm import mixing, sharding, toxicity

SF = "/root/testdata/sf0.001"


def test_each_stage_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in map(plain_words, items) for i in range(max(1, len(w) - 9))}
    at, ids = docs, {}
    for name, stage in P.STAGES:
        before = {r.doc_id: r for r in at.collect()}
        out = stage(spark, at, SF)
        if name != "sharding":
            assert out.columns == docs.columns
        rows = out.collect()
        ids[name] = Counter(r.doc_id for r in rows)
        if name == "toxicity":
            net = toxicity.trained(at, spark.read.parquet(f"{SF}/labels.parquet"))
            scores = toxicity.Scorer(net).scores([before[i].text for i in before])
            assert set(ids[name]) == {i for i, s in zip(before, scores, strict=True) if s < 0.3}
            assert labels
        if name == "simhash_near_dedup":
            found = groups({i: r.text for i, r in before.items()})  # five words, a similarity of 0.8, all pairs
            assert set(ids[name]) == set(found.values()) and len(found) > len(ids[name])
        if name == "decontamination":
            hit = {i for i, r in before.items() if any(tuple(w[k : k + 10]) in windows for w in [plain_words(r.text)] for k in range(len(w) - 9))}
            assert set(ids[name]) == before.keys() - hit and hit
        if name == "mixing":
            want = {r.id: r.copies if r.size else 1 for r in mixing.decisions(at).collect()}
            assert ids[name] == Counter({i: n for i, n in want.items() if n})
        if name == "sharding":
            assert ids[name] == ids["mixing"]
            total = Counter()
            for r in rows:
                total[r.shard] += len(r.text.encode())
            assert max(total.values()) <= sharding.LIMIT
        if name != "mixing":
            assert max(ids[name].values()) == 1 or name == "sharding"
        at = spark.createDataFrame(rows, out.schema)


def test_stages_take_nulls_anywhere(spark):
    long = "ein langes wort und noch eins " * 4000
    rows = [
        (1, "a b c d e f", "en", "s", 11, "x", 1), (2, None, None, None, None, None, None), (None, "p q r s t u", "en", None, 11, None, 2), (None, None, "en", "s", 0, "y", 3),
        (3, "", "de", "s", 0, "z", 4), (4, long, None, "t", len(long), "z", 5), (1, "a b c d e f", "en", "s", 11, "x", 1), (5, "a b c d e f", "fr", "u", None, "x", 6), (None, "p q r s t u", None, None, 11, None, 2),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxicity string, shard int, id int, fp int, w int, size int, copies int, hw int"
    docs = spark.createDataFrame([(*r, 0, 0, 0, 0, 0, 0) for r in rows], schema)
    at = docs
    for name, stage in P.STAGES:
        out = stage(spark, at, SF)
        if name != "sharding":
            assert out.columns == docs.columns
        if name in ("toxicity", "decontamination"):
            assert out.count() == at.count()
        at = spark.createDataFrame(out.collect(), out.schema)
    kept = {r.doc_id for r in at.collect()}
    assert {2} <= kept and at.where("doc_id = 5").count() == 0 and at.count() > 0


def test_run_and_empty_documents(spark, tmp_path):
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    out = P.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "text", "shard"} <= set(out.columns)
