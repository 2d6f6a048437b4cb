"""Stages of the pipeline on planted documents, and the registration of its queries."""

import random
from pathlib import Path

import pytest

import __spark_entry__
import corpus_pipeline
from tagloom.llm.common import settle
from tagloom.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
    passage, item = text(60), text(30)
    docs = [(i, text(120)) for i in range(200)]
    docs += [(300 + i, " ".join([text(60), "blockhead", text(30), "nitwits", "blockhead", text(10)])) for i in range(60)]
    docs += [(400, docs[0][1]), (401, docs[1][1] + " end"), (402, f"{text(80)} {passage} {text(70)}"), (403, f"{text(80)} {passage} {text(70)}"), (404, f"{text(40)} {item} {text(30)}")]
    folder = tmp_path_factory.mktemp("sf")
    table = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    table.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, 1, int(300 <= d < 400)) for d, _ in docs if d < 400], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), passage


def test_stages(spark, sf_dir):
    folder, passage = sf_dir
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == columns
    assert sum(300 <= d < 400 for d in kept["toxicity"]) < 6 and sum(d < 300 for d in kept["toxicity"]) > 195
    assert {400, 401}.isdisjoint(kept["near_dedup"]) and {402, 403, 404} <= set(kept["near_dedup"])
    assert passage in kept["suffix_dedup"][402]["text"] and passage[5:-5] not in kept["suffix_dedup"][403]["text"]
    assert kept["suffix_dedup"][403]["n_chars"] == len(kept["suffix_dedup"][403]["text"])
    assert set(kept["suffix_dedup"]) - set(kept["decontamination"]) == {404}
    assert set(kept["packing"]) == set(kept["decontamination"])
    assert corpus_pipeline.run(spark, folder).select("doc_id").distinct().count() == len(kept["packing"])


def test_registration():
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(QUERIES) and {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_only_the_entry_guards_imports():
    for file in [*Path("tagloom/llm").glob("*.py"), Path("corpus_pipeline.py")]:
        text = file.read_text()
        assert "ImportError" not in text and "ModuleNotFoundError" not in text and "find_spec" not in text, file


def test_stages_on_odd_and_no_rows(spark, sf_dir):
    folder, _ = sf_dir
    base = spark.read.parquet(f"{folder}/documents.parquet")
    word = " ".join(f"w{i}" for i in range(90))
    odd = [(None, word, None, None, None), (7001, None, None, None, None), (7002, "", "en", "s", 0), (7003, word + " x", "en", "s", 1), (7003, word + " x", "en", "s", 1), (7004, "one", None, "s", 3), (7005, " \n\t", "en", None, 2)]
    docs, none = spark.createDataFrame(odd, base.schema).union(base.limit(40)).repartition(3), base.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs, none = settle(stage(spark, docs, folder), f"odd-{name}"), settle(stage(spark, none, folder), f"none-{name}")
        assert none.count() == 0
        left = [r.doc_id for r in docs.collect()]
        if name == "near_dedup":  # nulls and texts without words are linked with nothing
            assert left.count(None) == 1 and {7001, 7002, 7004, 7005} <= set(left) and left.count(7003) == 2
        if name == "suffix_dedup":  # what has no text left goes, what never had any stays out too
            assert None in left and 7004 in left
    assert docs.where("sequence_id IS NULL").count() == 0
