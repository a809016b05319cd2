import pytest
from pyspark.sql import functions as F

import catalog_fixture as fx
from notegrid.operators import validate
from notegrid.sources.tables import DESCRIPTOR


def changed(**change):
    return [*fx.ROWS[1:], tuple((dict(zip(fx.NAMES, fx.ROWS[0], strict=True)) | change).values())]


def issues(spark, rows=fx.ROWS, categories=fx.CATEGORIES, sources=fx.SOURCES, **more):
    out = validate.validate(fx.categories(spark, categories), fx.sources(spark, sources), fx.descriptors(spark, rows), **more)
    return sorted((r["table"], r["path"], r["code"]) for r in out.collect())


def scores(**change):
    base = {k: (1.0, 2.0, 3.0) for k in ("sourness", "sweetness", "bitterness", "aromaProminence", "body", "roastFermentation")}
    return tuple((base | change).values())


def test_valid(spark):
    assert issues(spark) == []
    assert len(validate.check(fx.categories(spark), fx.sources(spark), fx.descriptors(spark))) == 3


@pytest.mark.parametrize(
    ("change", "path", "code"),
    [
        ({"id": " 　"}, "id", "too_small"), ({"descriptorStatus": "Canonical"}, "descriptorStatus", "invalid_enum"), ({"confidence": None}, "confidence", "invalid_enum"),
        ({"sensoryAssociation": scores(body=(0.0, 2.0, 5.1))}, "sensoryAssociation.body.max", "out_of_range"),
        ({"sensoryAssociation": scores(body=(2.5, 2.0, 3.0))}, "sensoryAssociation.body.min", "out_of_order"),
        ({"sensoryAssociation": scores(body=(1.0, 3.5, 3.0))}, "sensoryAssociation.body.typical", "out_of_order"),
        ({"sensoryModalities": []}, "sensoryModalities", "too_small"), ({"sensoryModalities": ["sight"]}, "sensoryModalities", "invalid_enum"), ({"aliases": ([""], [])}, "aliases.en", "too_small"),
        ({"visualProfile": ("m", -0.1, 0.5, 0.5, "drift")}, "visualProfile.density", "out_of_range"), ({"visualProfile": ("m", -0.0, 0.5, 0.5, "spin")}, "visualProfile.motion", "invalid_enum"),
        ({"editorialNote": ("x", " ")}, "editorialNote.zhHans", "too_small"), ({"categoryId": "none"}, "categoryId", "missing_reference"),
    ],
)
def test_one_rule(spark, change, path, code):
    assert issues(spark, changed(**change)) == [("descriptors", path, code)]


def test_nan_breaks_bounds_and_maybe_order(spark):
    found = issues(spark, changed(sensoryAssociation=scores(body=(1.0, float("nan"), 3.0))))
    assert ("descriptors", "sensoryAssociation.body.typical", "out_of_range") in found


def test_missing_sources_by_occurrence(spark):
    assert [x[1] for x in issues(spark, changed(sourceIds=["gone", "book", "gone"]))] == ["sourceIds.0", "sourceIds.2"]


def test_duplicates_and_strict_order(spark):
    twice = [*fx.ROWS, (9, *fx.ROWS[0][1:])]
    assert issues(spark, twice) == [("descriptors", "id", "not_unique"), ("descriptors", "slug", "not_unique")]
    cats = [*fx.CATEGORIES, (3, *fx.CATEGORIES[0][1:])]
    with pytest.raises(validate.Invalid, match="categories floral id"):
        validate.check(fx.categories(spark, cats), fx.sources(spark), fx.descriptors(spark, twice))
    many = [fx.descriptor(i, f"d{i}", "none", (1.0,) * 6, sourceIds=["gone", "own", "gone"]) for i in range(150)]
    with pytest.raises(validate.Invalid) as found:
        validate.check(fx.categories(spark), fx.sources(spark), fx.descriptors(spark, many))
    lines = str(found.value).split("\n")
    assert len(lines) == found.value.issues.count() == 450 and [x.split()[2] for x in lines[3:6]] == ["categoryId:", "sourceIds.0:", "sourceIds.2:"]
    text = validate.joined_messages(found.value.issues).where("key = 'd7'").first()["messages"]
    assert text == "d7 references missing category none\nd7 references missing source gone\nd7 references missing source gone"
    d = fx.descriptors(spark)
    assert [validate.every(d, x).first()["every"] for x in (F.col("ordinal") >= 0, F.col("ordinal") > 0, F.lit(None).cast("boolean"))] == [True, False, False]
    assert validate.every(d.where("false"), F.lit(False)).first()["every"]


def test_sources_and_notes(spark):
    bad = [(0, "book", "Book", "blog", "x", "reference_only", None, "n", "not a url"), fx.SOURCES[1]]
    assert {x[1] for x in issues(spark, sources=bad)} == {"sourceType", "attributionRequired", "url"}
    assert issues(spark, changed(descriptorStatus="boundary"), notes_for_boundary=True) == [("descriptors", "editorialNote", "missing_note")]


def test_trimmed(spark):
    out = validate.trimmed(fx.descriptors(spark, changed(id="　plum ")), DESCRIPTOR)
    assert out.where("id = 'plum'").count() == 1 and validate.trimmed(out, DESCRIPTOR).exceptAll(out).count() == 0
