"""A small catalogue of our own."""

from notegrid.sources.tables import CATEGORY, DESCRIPTOR, SOURCE, schema_of


def pair(x):
    return (x, f"{x}字")


NAMES = "ordinal id slug labels aliases categoryId descriptorStatus sensoryModalities summary sensoryAssociation confidence evidenceStatus sourceIds visualProfile editorialNote".split()


def descriptor(i, slug, category, scores, **change):
    row = {
        "ordinal": i, "id": slug, "slug": slug, "labels": pair(slug.title()), "aliases": ([f"alias {slug}"], []), "categoryId": category, "descriptorStatus": "canonical", "sensoryModalities": ["taste", "retronasal"],
        "summary": pair("s"), "sensoryAssociation": tuple((max(0.0, s - 0.5), s, min(5.0, s + 0.5)) for s in scores), "confidence": "medium", "evidenceStatus": "project_curated_draft", "sourceIds": ["own", "book"],
        "visualProfile": ("dot", 0.2, 0.5, 1.0, "drift"), "editorialNote": None,
    }
    return tuple((row | change).values())


ROWS = [
    descriptor(0, "plum", "fruit", (2.0, 3.0, 0.5, 3.0, 1.0, 0.0)),
    descriptor(1, "apple", "fruit", (2.5, 3.0, 0.2, 2.0, 1.0, 0.0), sensoryModalities=["retronasal", "retronasal", "taste"], sourceIds=["book"]),
    descriptor(2, "rose", "floral", (0.5, 2.0, 0.5, 4.5, 1.0, 0.0), sensoryModalities=["orthonasal"], descriptorStatus="boundary", editorialNote=pair("note")),
    descriptor(3, "ash", "smoke", (0.1, 0.2, 3.5, 3.0, 3.0, 4.5), labels=pair("Áshes")),
]
CATEGORIES = [(0, "floral", "floral", pair("Floral"), pair("F"), pair("d"), "c1"), (1, "fruit", "fruit", pair("Fruit"), pair("Fr"), pair("d"), "c2"), (2, "smoke", "smoke", pair("Smoke"), pair("S"), pair("d"), "c3")]
SOURCES = [(0, "book", "Book", "reference_framework", "x", "reference_only", True, "n", None), (1, "own", "Own", "project_curation", "x", "project_created", False, "n", "https://example.org/a")]


def descriptors(spark, rows=ROWS):
    return spark.createDataFrame(rows, schema_of(DESCRIPTOR))


def categories(spark, rows=CATEGORIES):
    return spark.createDataFrame(rows, schema_of(CATEGORY))


def sources(spark, rows=SOURCES):
    return spark.createDataFrame(rows, schema_of(SOURCE))
