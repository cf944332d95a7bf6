import hashlib
import math
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestone.operators import model_calls as M

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the models below travel whole


class Aborted(BaseException):
    pass


def picky(prompt):
    if prompt == "p3":
        raise ValueError("not this one")
    return None if prompt == "p4" else f"<{prompt}>"


def cut_off(prompt):
    if prompt == "p7":
        raise Aborted
    return "first"


def items(spark, n=10):
    return spark.createDataFrame([(f"i{k}", f"p{k}") for k in range(n)], "item string, prompt string")


def test_a_second_run_does_only_what_failed(spark, tmp_path):
    path = str(tmp_path / "log")
    first = M.run(items(spark), picky, path, slices=3)
    assert first.count() == 10
    assert {(r["item"], r["calls"], r["error"]) for r in M.failures(first).collect()} == {("i3", 1, "ValueError: not this one"), ("i4", 1, "no answer")}
    second = M.run(items(spark, 12), M.StandIn("ok "), path)
    assert {r["item"] for r in second.where("run = 2").collect()} == {"i3", "i4", "i10", "i11"}
    got = {r["item"]: (r["answer"], r["run"]) for r in M.answers(second).collect()}
    assert len(got) == 12 and got["i0"] == ("<p0>", 1) and got["i3"] == ("ok " + hashlib.md5(b"p3").hexdigest(), 2)
    assert M.run(items(spark, 12), picky, path).count() == second.count()
    assert M.failures(second).isEmpty()


def test_a_run_that_is_cut_off_keeps_finished_slices(spark, tmp_path):
    path, slices = str(tmp_path / "log"), 5
    with pytest.raises(Exception):
        M.run(items(spark, 40), cut_off, path, slices=slices)
    at = {r["item"]: r["s"] for r in items(spark, 40).select("item", F.pmod(F.xxhash64("item"), F.lit(slices)).alias("s")).collect()}
    kept = {r["item"] for r in M.log(spark, path).collect()}
    assert {i for i, s in at.items() if s < at["i7"]} <= kept and "i7" not in kept
    done = M.run(items(spark, 40), lambda p: "second", path, slices=slices)
    assert {r["item"]: r["answer"] for r in M.answers(done).collect()} == {i: "first" if i in kept else "second" for i in at}


def test_attempts_nulls_and_repeated_items(spark, tmp_path):
    path = str(tmp_path / "log")
    odd = spark.createDataFrame([("a", "y"), ("a", "x"), (None, "z"), ("b", None)], "item string, prompt string")
    for _ in range(3):
        calls = M.run(odd, picky, path, attempts=2)
    assert sorted((r["item"], r["run"], r["answer"], r["error"]) for r in calls.collect()) == [("a", 1, "<x>", None), ("b", 1, None, "no prompt"), ("b", 2, None, "no prompt")]
    assert M.run(odd.where("false"), picky, str(tmp_path / "none")).isEmpty()


def test_articles_of_concepts(spark):
    concepts = spark.createDataFrame([("c1", "what {contexts}", 3), ("c2", None, 1)], "name string, definition string, frequency int")
    docs = spark.createDataFrame([(i, f"t{i}", "x\n" * 60) for i in range(5)] + [(9, "t9", "short")], "doc_id long, title string, content string")
    mentions = spark.createDataFrame([("c1", i) for i in (9, 4, 4, 3, 2, 1)], "name string, doc_id long")
    contexts = M.concept_contexts(concepts, mentions, docs)
    line = " ".join(["x"] * 60)
    text = "\n".join(f"{k}. t{k}: {line}" for k in (1, 2, 3))
    assert {r["name"]: r["contexts"] for r in contexts.collect()} == {"c1": text}
    prompts = {r["item"]: r["prompt"] for r in M.concept_prompts(concepts, contexts, "N {name} D {definition} C {contexts}.").collect()}
    assert prompts == {"c1": f"N c1 D what {{contexts}} C {text}.", "c2": "N c2 D  C ."}
    calls = spark.createDataFrame([("c1", 1, None, "e"), ("c1", 2, " body ", None), ("c2", 1, "b2", None)], M.LOG)
    got = {r["name"]: (r["content"], r["run"]) for r in M.concept_articles(concepts, calls).collect()}
    assert got["c1"] == ("# c1\n\n> 概念 | 出现频次: 3\n> 定义: what {contexts}\n> 来源: LLM生成\n\nbody", 2)
    assert got["c2"] == ("# c2\n\n> 概念 | 出现频次: 1\n> 来源: LLM生成\n\nb2", 1)


def test_hashing_embedder(spark):
    t = spark.createDataFrame([(1, "Red fox, red hen"), (2, "red fox red HEN"), (3, ""), (4, None), (5, "blue sky")], "id long, text string")
    v = {r["id"]: r["embedding"] for r in M.HashingEmbedder(256)(t).collect()}
    assert v[1] == v[2] != v[5] and math.isclose(sum(x * x for x in v[1]), 1, rel_tol=1e-6)
    assert set(v[3]) == set(v[4]) == {0.0} and len(v[4]) == 256
