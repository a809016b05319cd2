import catalog_fixture as fx
from notegrid.operators import compare, validate
from notegrid.sources.tables import SOURCE, marked_table, new_path, read_table

RULES = validate.SOURCE_RULES


def test_broken_lines_have_cause_and_place(spark, tmp_path):
    lines = ['{"ordinal": 1, "id": "a"}', '{"ordinal": 2, "id": ', "", "words", '{"ordinal": "x", "id": "b"}', "[1, 2]", '{"ordinal": 3, "id": {"a": 1}}', '{"ordinal": 4} {', "null", '{"ordinal": 5, "line": "own", "file": 1}']
    (tmp_path / "t.json").write_text("\n".join(lines))
    df = marked_table(spark, str(tmp_path), SOURCE)
    got = [(r["ordinal"], r["id"]) for r in df.where("line is null").collect()]
    assert {(1, "a"), (None, "b"), (3, '{"a": 1}'), (4, None), (5, None)} <= set(got)
    issues = validate.line_issues(df, "sources").collect()
    assert {lines[1], lines[3]} <= {r["message"] for r in issues} and not {lines[k] for k in (0, 4, 6, 9)} & {r["message"] for r in issues}
    assert all(r["path"].endswith("t.json") and r["code"] == "malformed" and r["ordinal"] is None for r in issues)
    assert validate.line_issues(df, "sources").count() == len(issues) and df.where("block = 0").count() == df.count()
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "t.json").write_text("")
    assert marked_table(spark, str(tmp_path / "none"), SOURCE).count() == 0


def test_counts_come_from_the_job_that_writes(spark):
    rows = [(i, f"s{i}", "" if i % 3 == 0 else "n", "open_dataset", "x", "any" if i % 5 == 0 else "open_reuse", None if i % 7 == 0 else True, "n", None if i % 2 else "http://[") for i in range(50)]
    df = fx.sources(spark, rows)
    tracker, path = spark.sparkContext.statusTracker(), new_path(spark)
    spark.sparkContext.setJobGroup("writes", "one job")
    counts = validate.write_valid(df, "sources", RULES(), path)
    jobs = tracker.getJobIdsForGroup("writes")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1
    want = {(r["path"], r["code"]): r["count"] for r in validate.record_issues(df, "sources", RULES()).groupBy("path", "code").count().collect()}
    got = {(r["path"], r["code"]): r["n"] for r in counts.collect()}
    kept = read_table(spark, path, SOURCE)
    assert got.pop((None, "accepted")) == kept.count() and kept.columns == df.columns
    assert {k: n for k, n in got.items() if n} == want and len(got) == len(RULES())
    assert not validate.record_issues(kept, "sources", RULES()).count()
    none = validate.write_valid(df.where("false"), "sources", RULES(), new_path(spark)).collect()
    assert {r["n"] for r in none} == {0}


def test_overlay(spark):
    urls = ["/atlas", "/atlas?compare=", "/atlas?compare=plum", "/atlas?compare=plum,rose", "/atlas?compare=rose%2Cplum,ash", "/atlas?compare=gone,plum", "/atlas?compare=plum,plum", "/atlas?compare=gone,gone2,plum", None]
    asked = spark.createDataFrame(list(enumerate(urls)), "id int, url string")
    out = {r["id"]: r for r in compare.overlay(asked, "url", "id", fx.descriptors(spark)).collect()}
    assert [out[i]["arity"] for i in range(9)] == ["empty", "empty", "pending", "compared", "compared", "pending", "compared", "empty", "empty"]
    assert [(out[i]["first"], out[i]["second"]) for i in (3, 4, 5, 6)] == [("plum", "rose"), ("rose", "plum"), ("plum", None), ("plum", "plum")]
    assert (out[3]["biggest"]["dim"], out[3]["biggest"]["difference"]) == ("sourness", 1.5) and out[3]["same_categoryId"] is None and out[3]["shared_modalities"] == []
    assert out[6]["same_categoryId"] == "fruit" and len(out[6]["similar"]) == 6 and out[5]["differences"] is None and out[2]["biggest"] is None
