import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tallyloom.llm import substrings
from tests.llm.test_decontaminate import plain as plain_hits
from tests.llm.test_packing import check, ids_of
from tests.llm.test_simhash import plain_groups
from tests.llm.test_substrings import brute

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean documents, copies, toxic ones, leaks and shared passages, with null and empty texts."""
    rng, path = random.Random(21), str(tmp_path_factory.mktemp("tables"))
    vocabulary = [f"term{i}" for i in range(900)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(25)) for i in range(8)]
    docs, labels = [], []
    for i in range(260):
        toxic = i % 4 == 0
        w = say(rng.randint(30, 120)).split()
        if toxic:
            for bad in ("idiot", "clown", "stupid"):
                w.insert(rng.randrange(len(w)), bad)
        docs.append((i, " ".join(w)))
        if i < 200:
            labels.append((i, 1, int(toxic)))
    passage = say(70)
    docs += [(300 + i, f"{say(40)} {passage} {say(40)}") for i in range(4)]
    docs += [(310, docs[1][1]), (311, docs[1][1]), (320, f"{say(30)} {items[2][1]} {say(30)}"), (330, None), (331, ""), (332, "")]
    longest = max((t for i, t in docs[:260] if i % 4), key=lambda t: len(t.split()))
    docs.append((340, " ".join(["changed", *longest.split()[1:]])))  # a near copy
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    frame.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def test_each_stage_against_plain_versions(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, []
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash", "suffix_array", "decontamination", "packing"]
    frames = {}
    for name in list(stages)[:-1]:
        docs = stages[name](spark, docs, path)
        assert docs.columns == columns
        kept.append(docs.collect())
        frames[name] = {r.doc_id: r.text for r in kept[-1]}
        docs = spark.createDataFrame(kept[-1], spark.read.parquet(f"{path}/documents.parquet").schema)
    clean = frames["toxicity"]
    assert not [i for i in clean if i < 260 and i % 4 == 0]
    assert len([i for i in clean if i < 260]) == 195 and {300, 310, 320, 330, 331} <= set(clean)
    ids = sorted(clean)
    assert sorted(frames["simhash"]) == sorted({ids[k] for k in plain_groups([clean[i] for i in ids])})
    assert not {310, 311, 340} & set(frames["simhash"])
    one = frames["simhash"]
    for (i, text), (_, removed, _, _) in zip(sorted(one.items()), brute([one[i] for i in sorted(one)]), strict=True):
        assert len((frames["suffix_array"][i] or "").encode()) == len((text or "").encode()) - removed
    assert all(r.n_chars == len(r.text) for r in kept[2] if r.text is not None)
    cut = frames["suffix_array"]
    hits = plain_hits([cut[i] for i in sorted(cut)], items)
    assert sorted(frames["decontamination"]) == [i for i, h in zip(sorted(cut), hits, strict=True) if not h[3]]
    assert 320 not in frames["decontamination"]
    packed = stages["packing"](spark, docs, path).withColumnRenamed("doc_id", "id").collect()
    check(packed, {i: ids_of(t) for i, t in frames["decontamination"].items()})
    whole = __spark_entry__.queries()["pipeline"](spark, path).select("doc_id", "start").collect()
    assert {r.doc_id for r in whole} == set(frames["decontamination"])


def test_stages_keep_columns_whatever_their_names(spark, folder, tmp_path):
    path, _ = folder
    names = ["leak_id", "leak_th", "a.b", "id", "th", "t1", "cut_1", "kept", "scores", "Scores_0", "fp", "component", "n_hit", "own", "found"]
    docs = spark.read.parquet(f"{path}/documents.parquet").filter("doc_id < 40 or doc_id >= 300")
    plain, odd = docs, docs.select("*", *[F.lit(f"x{i}").alias(n) for i, n in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, wide = stage(spark, plain, path), stage(spark, odd, path)
        assert wide.columns == odd.columns
        wide.write.parquet(f"{tmp_path}/{name}")
        odd = spark.read.parquet(f"{tmp_path}/{name}")
        assert sorted(odd.select("doc_id", "text").collect(), key=str) == sorted(plain.select("doc_id", "text").collect(), key=str)
        assert odd.filter(" or ".join(f"`{n}` <> 'x{i}'" for i, n in enumerate(names))).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd, path).count() > 0


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_cut_texts_stay_whole_characters(spark):
    shared = "é" * 150
    docs = spark.createDataFrame([(1, "a" + shared + "b"), (2, "c" + shared + "d"), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in substrings.without_repeats(docs, length_col=None).collect()}
    assert out == {1: "ab", 2: "cd", 3: None}
