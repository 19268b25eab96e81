import random

import pytest

import corpus_pipeline
from threshline.llm import decontam, lines, mixing, simhash, toxicity

ITEM = "A train leaves Paris at 9 and travels 120 km in 2 hours before it stops. How far does it travel in 5 hours more on the same line?"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    prose = lambda n: "\n".join(" ".join(word() for _ in range(9)) for _ in range(n))
    shared = prose(20)
    docs = [(i, prose(12), "en", f"s{i % 4}", 0) for i in range(200)]
    docs += [(200 + i, prose(5) + " idiot scum\n" + prose(5), "en", "s1", 0) for i in range(40)]
    docs += [(300 + i, prose(6) + "\n" + shared + "\n" + prose(6), "en", "s2", 0) for i in range(10)]
    docs += [(400 + i, docs[i][1].replace("\n", " ") + " tail", "en", "s0", 0) for i in range(10)]
    docs += [(450 + i, docs[400 - 400 + i][1].replace("\n", " ") + " tail more", "en", "s0", 0) for i in range(10)]
    docs += [(500 + i, prose(4) + "\n" + ITEM + "\n" + prose(4), "en", "s3", 0) for i in range(5)]
    docs += [(600, None, None, None, None), (None, "x", "en", "s0", 1)]
    out = tmp_path_factory.mktemp("sf")
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{out}/{name}.parquet")
    write("documents", docs, "doc_id long, text string, lang string, source string, n_chars long")
    write("labels", [(i, 1, int(200 <= i < 240)) for i in range(0, 260)], "doc_id long, quality int, toxic int")
    write("benchmark", [(1, ITEM)], "item_id long, text string")
    return str(out)


def test_stages_in_order_and_effective(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = {r.doc_id: r for r in out.collect()}
        seen.append((name, set(rows)))
        if name != "mixing":
            assert out.columns == columns
            docs = spark.createDataFrame(list(rows.values()), docs.schema)
    kept = dict(seen)
    assert not {200 + i for i in range(40)} & kept["toxicity"] and len(kept["toxicity"]) == 225 + 12
    assert kept["line dedup"] == kept["toxicity"]
    assert {400 + i for i in range(10)} <= kept["line dedup"] and not {450 + i for i in range(10)} & kept["near duplicates"]
    assert not {500 + i for i in range(5)} & kept["decontamination"]
    assert {i for i in range(200)} <= kept["mixing"] and {600, None} & kept["mixing"]


def test_run_equals_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    docs = simhash.drop_near_duplicates(lines.dedup_runs(docs))
    docs = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    want = sorted(str((r.id, r.size, r.taken)) for r in mixing.mix_documents(docs).collect())
    assert sorted(str((r.doc_id, r["size"], r.taken)) for r in corpus_pipeline.run(spark, sf_dir).collect()) == want
