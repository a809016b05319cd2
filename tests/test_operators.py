import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import catalog_fixture as fx
from notegrid.operators import catalog, compare, layout, ordering, related, search, selection
from notegrid.sources import field_table, index_table, map_table, page_paths, source_matrix, text_list, with_ordinal
from notegrid.sources.tables import DIMENSION_IDS, dimension_table, label_table, request_state


def slugs(df):
    return [r["slug"] for r in df.orderBy("ordinal").collect()]


def test_search(spark):
    d = fx.descriptors(spark)
    find = lambda q="", c="": slugs(search.filter_descriptors(d, search.descriptor_text(), q, c))
    assert find("PLUM ") == ["plum"] and find("alias") == ["plum", "apple", "rose", "ash"] and find("ashes") == ["ash"]
    assert find("plum plum字") == ["plum"] and find("a%e") == [] and find("^") == ["plum", "apple", "rose", "ash"]
    assert find("", "fruit") == ["plum", "apple"] and find("", "Fruit") == [] and find("rose", "fruit") == []


def test_order(spark):
    ranks = fx.categories(spark).select(F.col("ordinal").alias("rank"), F.col("id").alias("categoryId"))
    d = fx.descriptors(spark).withColumn("name", F.col("labels.en"))
    out = ordering.sort_by_category_then_name(d, ranks, "categoryId", "name", "ordinal").orderBy("position")
    assert [r["slug"] for r in out.collect()] == ["rose", "apple", "plum", "ash"]
    known = ordering.sort_by_category_then_name(d, ranks.where("rank <> 2"), "categoryId", "name", "ordinal").orderBy("position")
    assert [r["slug"] for r in known.collect()] == ["ash", "rose", "apple", "plum"]
    assert slugs(ordering.first_k(d.where(search.not_canonical(F.col("descriptorStatus"))), 4)) == ["rose"]
    with pytest.raises(ValueError):
        ordering.first_k(d, -1)


def test_related_ties_bonus_and_k(spark):
    rows = [(0, [0.0, 0.0], "a"), (1, [3.0, 4.0], "a"), (2, [1.0, 0.0], "b"), (3, [0.0, 1.0], "b"), (4, None, "a"), (5, [1.0, 0.0], None)]
    d = spark.createDataFrame(rows, "key long, profile array<double>, category string")
    out = related.related(d, d.where("key = 0"), "key", "profile", "category", k=4).orderBy("rank").collect()
    assert [(r["key"], r["score"]) for r in out] == [(2, 1.0), (3, 1.0), (5, 1.0), (1, 3.0)]
    assert related.related(d, d.where("key = 0"), "key", "profile", "category", k=0).count() == 0
    assert related.related(d, d, "key", "profile", "category", k=99).groupBy("query").count().where("count <> 4").count() == 0
    with pytest.raises(ValueError):
        related.related(d, d, "key", "profile", "category", k=-1)


def pair_of(spark, a, b):
    d = fx.descriptors(spark)
    x, y = d.where(F.col("slug") == a).alias("a"), d.where(F.col("slug") == b).alias("b")
    dims = [[F.col(f"{t}.sensoryAssociation.{k}.typical") for k in DIMENSION_IDS] for t in "ab"]
    same = {k: (F.col(f"a.{k}"), F.col(f"b.{k}")) for k in ("categoryId", "confidence", "evidenceStatus")}
    return compare.compare(x.crossJoin(y), DIMENSION_IDS, *dims, same, (F.col("a.sensoryModalities"), F.col("b.sensoryModalities"))).first()


def test_compare(spark):
    r = pair_of(spark, "apple", "plum")
    assert r["biggest"]["dim"] == "aromaProminence" and r["same_categoryId"] == "fruit"
    assert [x["dim"] for x in r["differences"]][:3] == ["aromaProminence", "sourness", "bitterness"]
    assert r["shared_modalities"] == ["retronasal", "retronasal", "taste"] and r["similar"] == ["bitterness", "sweetness", "body", "roastFermentation"]
    own = pair_of(spark, "rose", "rose")
    assert [x["dim"] for x in own["differences"]] == list(DIMENSION_IDS) and own["similar"] == list(DIMENSION_IDS)
    assert pair_of(spark, "rose", "plum")["same_categoryId"] is None


@pytest.mark.parametrize(("d", "similar"), [(0.45, 1), (math.nextafter(0.45, 1), 0), (math.nextafter(0.45, 0), 1)])
def test_similar_threshold(spark, d, similar):
    assert spark.range(1).where(search.similar(F.lit(d))).count() == similar


def test_lookups(spark):
    d, c, s = fx.descriptors(spark), fx.categories(spark), fx.sources(spark)
    assert catalog.with_category(d, c, "categoryId", "id", {"colorToken": "colour"}).where("slug = 'rose'").first()["colour"] == "c1"
    with pytest.raises(PySparkException, match="Missing category smoke"):
        catalog.with_category(d, c.where("id <> 'smoke'"), "categoryId", "id", {"colorToken": "colour"}).collect()
    with pytest.raises(catalog.NotFound):
        catalog.by_slug(d, "none")
    page = catalog.specimen(d, "plum", c, s).first()
    assert page["sources"] == ["Book", "Own"] and page["category"]["en"] == "Fr"
    assert page["related"] == ["apple", "rose", "ash"] and [r["dim"] for r in page["ranges"]] == list(DIMENSION_IDS)
    assert (page["ranges"][1]["track"]["left"], page["ranges"][1]["track"]["typical"]) == (50.0, 60.0) and catalog.specimen(d, "rose", c, s).first()["editorialNote"]["en"] == "note"
    asked = spark.createDataFrame([(1, ["rose", "none", "plum", "rose"])], "r int, want array<string>")
    assert [x["slug"] for x in catalog.selected(asked, F.col("want"), d, "slug").orderBy("pos").collect()] == ["rose", "plum", "rose"]
    assets = spark.createDataFrame([("rose", "bloom")], "slug string, motionFamily string")
    assert dict(catalog.with_asset(d, assets).select("slug", "motion").collect()) == {"plum": "drift", "apple": "drift", "rose": "bloom", "ash": "drift"}
    assert catalog.assets_with_descriptors(assets, d).count() == 1 and catalog.keyed(d, "slug").count() == 4


def test_tables(spark):
    ranks = fx.categories(spark).select(F.col("ordinal").alias("rank"), F.col("id").alias("categoryId"))
    d = ordering.sort_by_category_then_name(fx.descriptors(spark).withColumn("name", F.col("labels.en")), ranks, "categoryId", "name", "ordinal")
    assert [r["path"] for r in page_paths(d.select("slug", "ordinal")).orderBy("ordinal").collect()][:4] == ["/", "/atlas", "/methodology", "/flavor/plum"]
    first = index_table(d, fx.categories(spark)).orderBy("position").first()
    assert (first["no"], first["status"], first["evidence"], first["category"]) == ("01", "Boundary", "Project-curated draft / Medium", "Floral")
    assert map_table(d).count() == 4 and field_table(d, 4).count() == 4 and source_matrix(fx.sources(spark)).count() == 2
    assert text_list(d).orderBy("position").first()["text"] == "Rose字 / Rose"
    assert dimension_table(spark).count() == 6 and label_table(spark, {"a": ("A", "B")}).count() == 1
    state = spark.range(1).select(request_state(F.lit("/atlas?q=x&view=zzz")).alias("s")).first()["s"]
    assert state.asDict() == {"q": "x", "category": "", "view": "field", "compare": ""}


def test_ordinals(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(1000), 300)], "x int").repartition(5)
    out = with_ordinal(df, "x").orderBy("x").collect()
    assert [r["ordinal"] for r in out] == list(range(300))


def test_segments_are_circular(spark):
    nodes = spark.createDataFrame([(i, float(i), float(-i)) for i in range(3)], "position long, x double, y double")
    assert [r["x2"] for r in layout.segments(layout.with_total(nodes)).orderBy("position").collect()] == [1.0, 2.0, 0.0]
    assert layout.procedural_points(nodes, F.col("position")).count() == 27


def fold_by_hand(items):
    out = []
    for x in items:
        if x not in out:
            out = [*out, x][-2:]
    return out


def test_selection(spark):
    rng = random.Random(3)
    rows = [(u, i, rng.choice(["a", "b", "c,d", ""])) for u in range(5) for i in range(rng.randint(1, 30))]
    df = spark.createDataFrame(rows, "u int, i int, x string")
    want = {u: fold_by_hand([x for v, _, x in rows if v == u]) for u in range(5)}
    assert dict(selection.fold(df, "u", ["i"], "x").select("u", "selection").collect()) == want
    arr = lambda *x: F.array(*map(F.lit, x))
    row = spark.range(1).select(selection.add(arr("a", "b"), F.lit("c")), selection.add(arr("a"), F.lit("a")), selection.remove(arr("a", "a"), F.lit("a")), selection.arity(arr("a"))).first()
    assert tuple(row) == (["b", "c"], ["a"], [], "pending")
