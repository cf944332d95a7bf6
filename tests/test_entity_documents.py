"""Entity documents in a budget: order, whole texts or windows, articles first, all names before any."""

from lodestone.operators import search


def test_packing(spark):
    chunks = spark.createDataFrame(
        [(1, "a", "alpha and beta [[Gamma|x]]"), (2, "b", "only beta"), (3, "c", "x" * 9000 + " alpha " + "y" * 9000), (4, "c", "beta"), (5, "d", "alpha " + "word " * 400), (6, "e", "other")],
        "chunk_id long, doc_id string, content string",
    )
    entries = spark.createDataFrame([("alpha", "entity", 5), ("beta", "entity", 4), ("lonely", "entity", 1)], "name string, type string, frequency long")
    edges = spark.createDataFrame([("alpha", 1), ("beta", 1), ("beta", 2), ("alpha", 3), ("alpha", 5), ("beta", 4)], "name string, chunk_id long")
    req = spark.createDataFrame([(1, "alpha", 1), (1, "beta", 2), (2, "alpha", 1), (3, "lonely", 1), (4, "lonely", 1), (4, "beta", 2)], "query_id long, name string, name_pos int")
    articles = spark.createDataFrame([("alpha", "about [[alpha]]"), ("nobody", "x")], "name string, content string")
    run = lambda budget: {(r["query_id"], r["pos"]): r for r in search.entity_documents(req, entries, edges, chunks, articles, budget).collect()}
    got = run(6000)
    assert [(got[1, p]["kind"], got[1, p]["name"]) for p in (1, 2)] == [("article", "alpha"), ("document", "a")] and (1, 3) not in got  # chunk 1 alone holds both names
    assert got[1, 1]["content"] == "about alpha" and got[1, 2]["content"].startswith("alpha and beta Gamma")
    assert [got[2, p]["name"] for p in (1, 2, 3, 4)] == ["alpha", "a", "c", "d"]
    c = got[2, 3]
    assert not c["whole"] and c["tokens"] >= 3000 and "alpha" in c["content"] and len(c["content"]) < 500
    assert got[2, 4]["upto"] == got[2, 1]["tokens"] + got[2, 2]["tokens"] + search.SNIPPETS + got[2, 4]["tokens"]
    assert not [k for k in got if k[0] == 3]  # a known name without a chunk
    assert [got[4, p]["name"] for p in (1, 2, 3)] == ["a", "b", "c"]  # no chunk of both names: of any
    few = run(got[2, 3]["upto"])
    assert (2, 3) in few and (2, 4) not in few
