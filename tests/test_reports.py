from pyspark.sql import functions as F

from lodestone.operators import linking, reports

TABLE = "| a | b |\n| --- | --- |\n| 1 | 2 |"


def chunks(spark):
    long = "word " * 40
    rows = [(1, 0, f"{long}\n{TABLE}"), (1, 1, "| 3 | 4 |\n| 5 | 6 |"), (2, 0, long), (2, 1, "| lone |"), (3, 0, None), (3, 1, ""), (None, 0, f"{TABLE}\ntext\n| x |")]
    return spark.createDataFrame(rows, "doc_id long, chunk_index int, content string")


def test_figures_are_taken_while_chunks_are_written(spark, tmp_path):
    passed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            passed.add(b.num_rows)
            yield b

    source = chunks(spark)
    r = reports.write_chunks(source.mapInArrow(counted, source.schema), str(tmp_path / "c"))
    assert r.summary == {"chunks": 7, "tables": 4, "cut": 3, "short": 4, "least": 0, "most": 234, "mean": 84}
    assert passed.value == 7  # the source was read once
    assert [(x["doc_id"], x["chunk_index"]) for x in r.details.collect()] == [(None, 0), (1, 1), (2, 1)]
    assert passed.value == 7
    again = r.rows.agg(F.count("*"), F.count_if("has_table"), F.count_if("is_cut"), F.min(F.length("content")), F.max(F.length("content"))).first()
    assert tuple(again) == (7, 4, 3, 0, 234)
    assert {(x["doc_id"], x["chunks"], x["tables"], x["cut"]) for x in reports.document_counts(r).collect()} == {(None, 1, 1, 1), (1, 2, 2, 1), (2, 2, 1, 1), (3, 2, 0, 0)}
    assert len(reports.write_chunks(source, str(tmp_path / "d"), 2).details.collect()) == 2


def test_reports_of_nothing(spark, tmp_path):
    r = reports.write_chunks(chunks(spark).where(F.length("content") > 10_000), str(tmp_path / "c"))
    assert set(r.summary.values()) == {0} and r.details.isEmpty()
    assert reports.markdown("None", r).count("| --- |") == 1


def test_missing_links_and_saved_report(spark, tmp_path):
    c = spark.createDataFrame([(3, "data base and [[data]]"), (1, "metadata"), (2, "data, data base"), (4, None)], "chunk_id long, content string")
    names = ["data base", "data"]
    r = reports.write_missing_links(c, names, str(tmp_path / "m"))
    want = {}
    for x in linking.missing_links(c, names).collect():
        want.setdefault(x["chunk_id"], []).append(x["name"])
    assert {x["chunk_id"]: sorted(x["missing"]) for x in r.rows.collect()} == {k: sorted(v) for k, v in want.items()}
    assert r.summary == {"chunks": 4, "with_missing": len(want), "missing_links": sum(map(len, want.values()))}
    assert [x["chunk_id"] for x in r.details.collect()] == sorted(want)
    reports.save(spark, "Links", r, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/summary")).first().asDict() == r.summary
    assert spark.read.json(str(tmp_path / "out/details")).count() == len(want)
    text = "\n".join(x["value"] for x in spark.read.text(str(tmp_path / "out/markdown")).collect())
    assert text.startswith("# Links") and "| with_missing | " in text
