"""Links, contexts, snippets, query analysis and SQL functions."""

from pyspark.sql import functions as F

from lodestone.functions.register import register
from lodestone.operators import linking, routing


def test_links():
    p = linking.pattern_of(["data base", "data", "C++", "中文"])
    assert linking.annotate_text("data base, data; metadata [[data]] C++ 中文字", p) == ("[[data base]], [[data]]; metadata [[data]] [[C++]] [[中文]]字", 4)
    assert linking.missing_in_text("[[data]] C++ C++", p) == ["C++"] and linking.annotate_text("", p) == ("", 0)


def test_automaton_finds_what_the_pattern_finds():
    import random

    rng = random.Random(3)
    for _ in range(400):
        names = ["".join(rng.choices("ab_ +中", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))]
        text = "".join(rng.choices("aab_ +中[]", k=rng.randint(0, 60)))
        p, n = linking.pattern_of(sorted(set(names), key=lambda x: (-len(x), x))), linking.Names(names)
        assert linking.annotate_text(text, p) == linking.annotate_text(text, n) and linking.missing_in_text(text, p) == linking.missing_in_text(text, n)


def test_contexts():
    t = "x" * 500 + "KEY" + "y" * 500
    assert linking.context_of(t, ["key"]) == "x" * 200 + "KEY" + "y" * 200 and linking.context_of(t, ["none"]) == "x" * 400
    assert linking.islands([(5, 7), (0, 3), (3, 4)]) == [(0, 4), (5, 7)]
    got = linking.snippets_of("a" * 2000 + "key key" + "b" * 2000 + "key", ["key"])
    assert [s["mentions"] for s in got] == [2, 1]


def test_query_analysis(spark):
    q = spark.createDataFrame([("有哪些相关项目",), ("plain",)], "q string")
    got = [tuple(r["s"]) for r in q.select(routing.sizes(F.col("q"), F.lit(False)).alias("s")).collect()]
    assert got == [(40, 9, 10), (40, 15, 10)]
    assert routing.profile("nope").id == "baseline"
    a = spark.createDataFrame([('x [{"name": " A ", "type": "entity"}, {"name": ""}, {"name": "b", "type": "?"}] y',), ("none",)], "a string")
    assert [[tuple(x) for x in r["e"]] for r in a.select(routing.parse_entities(F.col("a")).alias("e")).collect()] == [[("A", "entity"), ("b", "concept")], []]
    n = spark.createDataFrame([("Redis",), ("张三",), ("中国银行",), ("some system",)], "n string")
    assert [r["c"] for r in n.select(routing.entity_category(F.col("n")).alias("c")).collect()] == ["技术组件", "人员", "客户企业", "项目系统"]


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("SELECT kb_tokenize('A b-C') AS t, kb_estimate_tokens('abcd中文字') AS n, kb_strip_links('[[x]]') AS s, kb_cosine(array(1D, 0D), array(1D, 0D)) AS c").first()
    assert (r["t"], r["n"], r["s"], r["c"]) == (["a", "b", "c"], 3, "x", 1.0)
    assert spark.sql("SELECT * FROM kb_chunk('d', 'One sentence.')").count() == 1


def test_names_of_short_runs_meet_only_their_own_texts(spark, monkeypatch):
    """Names of one short run each: sought by that run alone, every name met every text that holds it."""
    import random

    rng = random.Random(5)
    names = sorted({"".join(rng.choices("éóñ", k=rng.randint(1, 5))) + "es" + "".join(rng.choices("éóñ", k=rng.randint(0, 5))) for _ in range(150)})
    texts = [" ".join(rng.choices([*names, "es", "esé", "yes", "éesés", "ñ", "é es", "中éesé"], k=20)) for _ in range(60)]
    names += ["a b", "b", "ab es", "é", "éé", "ñ ñ"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    entries = spark.createDataFrame([(n,) for n in names], "name string")
    want = sorted(map(tuple, linking.annotate(chunks, names).collect()))
    monkeypatch.setattr(linking, "MAX_NAMES", 5)
    assert sorted(map(tuple, linking.annotate_joined(chunks, entries).collect())) == want
    anchors = linking.with_anchors(entries)
    find, keys = linking.Anchors.of(anchors), [r["anchor"] for r in anchors.collect()]
    met = sum(keys.count(a) for t in texts for a in find(t))
    assert met < 60 * len(names) / 4 and max(map(keys.count, keys)) <= 4
