"""The catalogue's own views over records that Spark makes of the given tables, with the SQL that must give the same rows.

Parts are descriptors: six ranges of scores from the key, a category, status, confidence and evidence, sources among the
suppliers, and on some an asset and a note. Suppliers are the registry of sources, the parts' categories the dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrid import functions as fn
from notegrid.operators import catalog, compare, layout, ordering, search, selection, validate
from notegrid.plans.queries import query, r6
from notegrid.sources import (
    ASSET, CATEGORY, CONFIDENCE_LABELS, DESCRIPTOR, DIMENSION_IDS, EVIDENCE_LABELS, MODALITY_LABELS, SOURCE, STATUS_LABELS, dimension_table, field_table, index_table, label_table, map_table, marked_table, raw_table, read_table,
    new_path, request_state, source_matrix, text_list, with_ordinal, write_table,
)

CATEGORIES = (*fn.profile.BANDS, "other")


def pick(values: tuple[str, ...] | list[str], by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), by.cast("int") % len(values) + 1)


def sql_pick(values, by: str) -> str:
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def pair(en: Column, zh: Column) -> Column:
    return F.struct(en.alias("en"), zh.alias("zhHans"))


def descriptors(t) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    typical = [(k * (i + 3) % 51) / F.lit(10.0) for i in range(6)]
    ranges = [fn.score(F.greatest(F.lit(0.0), x - 0.5), x, F.least(F.lit(5.0), x + 0.5)).alias(d) for d, x in zip(DIMENSION_IDS, typical, strict=True)]
    modalities = list(MODALITY_LABELS)
    return t("part").select(
        k.cast("long").alias("ordinal"), F.concat(F.lit("p"), k).alias("id"), F.concat(F.lit("part-"), k).alias("slug"), pair(F.col("p_name"), F.col("p_brand")).alias("labels"),
        F.struct(F.split("p_name", " ").alias("en"), F.filter(F.array("p_brand"), lambda _: size % 2 == 0).alias("zhHans")).alias("aliases"), pick(CATEGORIES, size).alias("categoryId"),
        pick(list(STATUS_LABELS), size).alias("descriptorStatus"), F.array(pick(modalities, k), pick(modalities, k + size), pick(modalities, k)).alias("sensoryModalities"), pair(F.col("p_type"), F.col("p_brand")).alias("summary"),
        F.struct(*ranges).alias("sensoryAssociation"), pick(list(CONFIDENCE_LABELS), size).alias("confidence"), pick(list(EVIDENCE_LABELS), k).alias("evidenceStatus"),
        F.array(F.concat(F.lit("s"), k % 5), F.concat(F.lit("s"), k % 7)).alias("sourceIds"),
        F.struct(F.lit("dot").alias("motif"), (size / 50).alias("density"), F.lit(0.5).alias("curvature"), F.lit(1.0).alias("halo"), pick(validate.MOTIONS, k).alias("motion")).alias("visualProfile"),
        F.when(k % 3 == 0, pair(F.col("p_type"), F.col("p_brand"))).alias("editorialNote"),
    )


_T = ", ".join(f"CAST(p_partkey * {i + 3} % 51 AS DOUBLE) / 10 AS t{i}" for i in range(6))
_M = list(MODALITY_LABELS)
RECORDS = f"""
SELECT p_partkey AS ordinal, 'p' || p_partkey AS id, 'part-' || p_partkey AS slug, p_name AS en, p_brand AS zh, p_type, p_size, {sql_pick(CATEGORIES, 'p_size')} AS category, {sql_pick(list(STATUS_LABELS), 'p_size')} AS status,
       [{sql_pick(_M, 'p_partkey')}, {sql_pick(_M, '(p_partkey + p_size)')}, {sql_pick(_M, 'p_partkey')}] AS modalities, {sql_pick(list(CONFIDENCE_LABELS), 'p_size')} AS confidence,
       {sql_pick(list(EVIDENCE_LABELS), 'p_partkey')} AS evidence, ['s' || p_partkey % 5, 's' || p_partkey % 7] AS sources, {sql_pick(validate.MOTIONS, 'p_partkey')} AS motion, p_partkey % 3 = 0 AS noted, {_T}
FROM part
"""


def categories(t) -> DataFrame:
    """The categories that the parts have, in alphabetical order: a dimension of at most len(CATEGORIES) rows."""
    ids = t("part").select(pick(CATEGORIES, F.col("p_size")).alias("id")).distinct()
    names = pair(F.initcap("id"), F.upper("id"))
    return with_ordinal(ids, "id").select("ordinal", "id", F.col("id").alias("slug"), names.alias("labels"), names.alias("shortLabel"), names.alias("description"), F.lit("c").alias("colorToken"))


def sources(t) -> DataFrame:
    k = F.col("s_suppkey")
    return t("supplier").select(
        k.cast("long").alias("ordinal"), F.concat(F.lit("s"), k).alias("id"), F.col("s_name").alias("name"), pick(validate.SOURCE_TYPES, k).alias("sourceType"), F.concat(F.lit("licence "), k).alias("licenseStatus"),
        pick(validate.REUSE_POLICIES, k).alias("reusePolicy"), (k % 2 == 0).alias("attributionRequired"), F.lower("s_name").alias("notes"), F.when(k % 3 == 0, F.concat(F.lit("https://example.org/"), k)).alias("url"),
    )


def assets(t) -> DataFrame:
    k = F.col("p_partkey")
    return t("part").where(k % 4 == 0).select(F.concat(F.lit("part-"), k).alias("slug"), F.lit("own").alias("library"), F.when(k % 8 == 0, F.lit("bloom")).alias("motionFamily"))


def sorted_records(t, query_: str = "", category: str = "") -> DataFrame:
    """Filtered by text and category, then in the order of category and name, with positions."""
    found = search.filter_descriptors(descriptors(t), search.descriptor_text(), query_, category).withColumn("name", F.col("labels.en"))
    return ordering.sort_by_category_then_name(found, categories(t).select(F.col("id").alias("categoryId"), F.col("ordinal").alias("rank")), "categoryId", "name", "ordinal")


_SORTED = f"SELECT *, row_number() OVER (ORDER BY category, en, ordinal) - 1 AS position FROM ({RECORDS}) WHERE {{}}"
_ALL, _FOUND = _SORTED.format("true"), _SORTED.format("contains(lower(en || ' ' || zh || ' ' || en || CASE WHEN p_size % 2 = 0 THEN ' ' || zh ELSE '' END || ' ' || slug || ' ' || id), 'widget brand#1')")
_NO = "CASE WHEN position < 9 THEN '0' || (position + 1) ELSE CAST(position + 1 AS VARCHAR) END"


def sql_label(labels: dict, by: str, which: int = 0) -> str:
    return f"CASE {by} " + " ".join(f"WHEN '{k}' THEN '{v[which]}'" for k, v in labels.items()) + " END"


# --- views --------------------------------------------------------------------------------------------------------------


@query(f"""
SELECT CAST(position AS BIGINT) AS position, {_NO} AS no, zh, en, upper(left(category, 1)) || substr(category, 2) AS category, {sql_label(STATUS_LABELS, 'status')} AS status,
       {sql_label(EVIDENCE_LABELS, 'evidence')} || ' / ' || {sql_label(CONFIDENCE_LABELS, 'confidence')} AS evidence, '/flavor/' || slug AS path
FROM ({_FOUND})
""")
def atlas_index(t) -> DataFrame:
    """A search from the query to the numbered table: filter, order, decode."""
    return index_table(sorted_records(t, " WIDGET Brand#1"), categories(t))


_PCT = "greatest(0, least(100, {} / 5 * 100))"


@query(f"""
SELECT CAST(position AS BIGINT) AS position, slug, {_NO} AS no, round({_PCT.format('t1')}, 6) AS x, round(100 - {_PCT.format('t0')}, 6) AS y, round(100 - {_PCT.format('t0')} + 0.8::DOUBLE, 6) AS number_y,
       round({_PCT.format('t1')} + 2.6::DOUBLE, 6) AS text_x, round(100 - {_PCT.format('t0')} - 2.6::DOUBLE, 6) AS text_y, round((5 + t3 * 2.2::DOUBLE) * 0.22::DOUBLE + 1.2::DOUBLE, 6) AS node, upper(en) AS label
FROM ({_ALL})
""")
def atlas_map(t) -> DataFrame:
    m = map_table(sorted_records(t))
    return m.select("position", "slug", "no", *[r6(F.col(c)).alias(c) for c in ("x", "y", "number_y", "text_x", "text_y")], r6(F.col("marks.node")).alias("node"), "label")


_BAND = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fn.profile.BANDS.items()) + " ELSE 50 END"
_SEED = "CAST(list_sum(list_transform(string_split(id, ''), lambda c: CAST(ascii(c) AS BIGINT))) AS BIGINT)"


@query(f"""
SELECT CAST(position AS BIGINT) AS position, slug, round(greatest(8, least(92, 14 + t1 / 5 * 72 + sin(seed) * 7)), 6) AS x,
       round(greatest(13, least(88, band + cos(position / greatest(1, n - 1) * pi() * 2 + seed) * 8 - t0 / 5 * 9)), 6) AS y, round(1.5::DOUBLE + t3 * 0.46::DOUBLE, 6) AS size, zh || ' / ' || en AS label
FROM (SELECT *, {_SEED} AS seed, {_BAND} AS band, count(*) OVER () AS n FROM ({_ALL}))
""")
def atlas_field(t) -> DataFrame:
    rows = layout.with_total(sorted_records(t))
    return field_table(rows, F.col("total")).select("position", "slug", r6(F.col("at.x")).alias("x"), r6(F.col("at.y")).alias("y"), r6(F.col("size")).alias("size"), "label")


@query(f"SELECT CAST(position AS BIGINT) AS position, zh || ' / ' || en AS text, array_to_string(string_split(en, ' '), ', ') AS aliases, CASE WHEN p_size % 2 = 0 THEN zh ELSE '' END AS aliases_zh FROM ({_ALL})")
def atlas_text_list(t) -> DataFrame:
    return text_list(sorted_records(t))


@query(f"SELECT ordinal, {' || chr(59) || chr(32) || '.join(sql_label(MODALITY_LABELS, f'modalities[{i}]') for i in (1, 2, 3))} AS page, array_to_string(modalities, ' / ') AS panel, array_to_string(modalities, '、') AS zh FROM ({RECORDS})")
def rendered_lists(t) -> DataFrame:
    names = {k: v[0] for k, v in MODALITY_LABELS.items()}
    page = F.transform("sensoryModalities", lambda m: fn.decode(names, m))
    return descriptors(t).select("ordinal", fn.join_list(page, "page").alias("page"), fn.join_list(F.col("sensoryModalities"), "panel").alias("panel"), fn.join_list(F.col("sensoryModalities"), "zhHans").alias("zh"))


@query("SELECT s_suppkey AS ordinal, s_name AS name, " + sql_pick(validate.SOURCE_TYPES, "s_suppkey") + ' AS "sourceType", ' + sql_pick(validate.REUSE_POLICIES, "s_suppkey") + """ AS "reusePolicy", 'licence ' || s_suppkey AS "licenseStatus", lower(s_name) AS notes FROM supplier""")
def source_registry(t) -> DataFrame:
    return source_matrix(sources(t))


_TRACK = " || ',' || ".join(f"'{d}:' || CAST(CAST(round(({_PCT.format(f'greatest(0, t{i} - 0.5)')}) * 100) AS BIGINT) AS VARCHAR)" for i, d in enumerate(DIMENSION_IDS))


@query(f"""
WITH r AS ({RECORDS}), q AS (SELECT * FROM r WHERE ordinal % 50 = 0),
d AS (SELECT q.slug, e.slug AS near, e.ordinal, CASE WHEN q.category = e.category THEN -2 ELSE 0 END + sqrt({' + '.join(f'(q.t{i} - e.t{i}) * (q.t{i} - e.t{i})' for i in range(6))}) AS score FROM q JOIN r e ON q.slug <> e.slug),
k AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY score, ordinal) AS rank FROM d)
SELECT q.slug, upper(left(category, 1)) || substr(category, 2) AS category, (SELECT string_agg(near, ',' ORDER BY rank) FROM k WHERE k.slug = q.slug AND rank <= 4) AS related,
       (SELECT string_agg(s_name, ',' ORDER BY s_suppkey) FROM supplier WHERE list_contains(q.sources, 's' || s_suppkey)) AS sources, {_TRACK} AS lefts, CASE WHEN noted THEN p_type || '/' || zh ELSE '' END AS note
FROM q
""")
def specimen_pages(t) -> DataFrame:
    """The pages of a stated set of descriptors, each with its neighbours among all."""
    d = descriptors(t)
    out = catalog.specimens(d, d.where(F.col("ordinal") % 50 == 0), categories(t), sources(t))
    lefts = F.transform("ranges", lambda r: F.concat(r["dim"], F.lit(":"), F.round(r["track"]["left"] * 100).cast("long").cast("string")))
    note = F.coalesce(F.concat_ws("/", "editorialNote.en", "editorialNote.zhHans"), F.lit(""))
    return out.select("slug", F.col("category.en").alias("category"), F.array_join("related", ",").alias("related"), F.array_join("sources", ",").alias("sources"), F.array_join(lefts, ",").alias("lefts"), note.alias("note"))


@query("SELECT p_partkey AS ordinal, p_name AS en FROM part WHERE p_partkey = 7")
def specimen_by_slug(t) -> DataFrame:
    return catalog.by_slug(descriptors(t), "part-7").select("ordinal", F.col("labels.en").alias("en"))


@query(f"SELECT slug, id, md5(lower(en || ' ' || zh || ' ' || en || CASE WHEN p_size % 2 = 0 THEN ' ' || zh ELSE '' END || ' ' || slug || ' ' || id)) AS digest FROM ({RECORDS})")
def record_search_text(t) -> DataFrame:
    return descriptors(t).select("slug", "id", F.md5(search.descriptor_text()).alias("digest"))


# --- readers ------------------------------------------------------------------------------------------------------------


@query(f"""
SELECT ordinal, slug, en, CASE WHEN ordinal % 6 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 50 END AS density, CASE WHEN ordinal % 6 = 0 THEN 'out_of_range' ELSE '' END AS code, CASE WHEN noted THEN p_type END AS note FROM ({RECORDS})
""")
def json_records(t) -> DataFrame:
    """Written as JSON with a field that is not declared and, in some rows, a number that is none, and read as a raw table."""
    d = descriptors(t)
    path = new_path(d.sparkSession)
    ill = F.col("ordinal") % 6 == 0
    d.where(~ill).withColumn("undeclared", F.lit(1)).write.json(path)
    d.where(ill).withColumn("visualProfile", F.col("visualProfile").withField("density", F.lit("dense"))).write.mode("append").json(path)
    rows = raw_table(d.sparkSession, path, DESCRIPTOR)
    codes = validate.record_issues(rows, "descriptors", [validate.within("visualProfile.density", 0, 1)], "slug").select("ordinal", "code")
    out = rows.select("ordinal", "slug", "labels.en", "visualProfile.density", F.col("editorialNote.en").alias("note"))
    return out.join(codes, "ordinal", "left").withColumn("code", F.coalesce("code", F.lit("")))


@query(f"""
SELECT slug AS key, en, CASE WHEN ordinal % 7 = 3 THEN 'out_of_range' ELSE '' END AS code, '' AS line, true AS placed FROM ({RECORDS}) WHERE ordinal % 7 <> 5
UNION ALL SELECT '', '', 'malformed', '{{"slug": "' || slug, true FROM ({RECORDS}) WHERE ordinal % 7 = 5
""")
def marked_records(t) -> DataFrame:
    """Records as JSON lines among which some break off, and others have a number that is none: issues tell the broken lines'
    text and file, the others' rule."""
    d = descriptors(t)
    path, k = new_path(d.sparkSession), F.col("ordinal") % 7
    d.where(~k.isin(3, 5)).write.json(path)
    d.where(k == 3).withColumn("visualProfile", F.col("visualProfile").withField("density", F.lit("dense"))).write.mode("append").json(path)
    d.where(k == 5).select(F.concat(F.lit('{"slug": "'), "slug")).write.mode("append").text(path)
    rows = marked_table(d.sparkSession, path, DESCRIPTOR)
    issues = validate.line_issues(rows, "descriptors")
    codes = validate.record_issues(rows.where("line is null"), "descriptors", [validate.within("visualProfile.density", 0, 1)], "slug").select("ordinal", "code")
    placed = lambda c: F.contains(F.col(c), F.lit(path.rsplit("/", 1)[1]))
    good = rows.where("line is null").join(codes, "ordinal", "left").select(F.col("slug").alias("key"), "labels.en", F.coalesce("code", F.lit("")).alias("code"), F.lit("").alias("line"), placed("file").alias("placed"))
    return good.unionByName(issues.select(F.lit("").alias("key"), F.lit("").alias("en"), "code", F.col("message").alias("line"), placed("path").alias("placed")))


_ICON = "p_partkey % 3 = 0"


@query(f"""
WITH c AS (SELECT DISTINCT category FROM ({RECORDS}))
SELECT 'category' AS kind, category AS key, upper(left(category, 1)) || substr(category, 2) || '/' || upper(category) AS label, 'c' AS detail, '' AS credited FROM c
UNION ALL SELECT 'asset', 'part-' || p_partkey, 'own', p_name || '/' || p_brand, CASE WHEN {_ICON} THEN 'yes' ELSE 'no' END FROM part WHERE p_partkey % 4 = 0
""")
def category_asset_files(t) -> DataFrame:
    """Categories and assets written as JSON, with a field that is not declared, and read under their declared schemas."""
    c, k = categories(t), F.col("p_partkey")
    evaluation = F.struct(F.col("p_name").alias("recognizability"), F.col("p_brand").alias("styleFit"), F.lit("x").alias("undeclared"))
    a = t("part").where(k % 4 == 0).select(F.concat(F.lit("part-"), k).alias("slug"), F.lit("own").alias("library"), (k % 3 == 0).alias("attributionRequired"), evaluation.alias("evaluation"))
    paths = [new_path(c.sparkSession), new_path(c.sparkSession)]
    for df, path in zip((c, a), paths, strict=True):
        df.withColumn("undeclared", F.lit(1)).write.json(path)
    c, a = raw_table(c.sparkSession, paths[0], CATEGORY), raw_table(c.sparkSession, paths[1], ASSET)
    one = c.select(F.lit("category").alias("kind"), F.col("id").alias("key"), F.concat_ws("/", "labels.en", "shortLabel.zhHans").alias("label"), F.col("colorToken").alias("detail"), F.lit("").alias("credited"))
    two = a.select(F.lit("asset").alias("kind"), F.col("slug").alias("key"), F.col("library").alias("label"), F.concat_ws("/", "evaluation.recognizability", "evaluation.styleFit", "license").alias("detail"), F.when(F.col("attributionRequired"), "yes").otherwise("no").alias("credited"))
    return one.unionByName(two)


@query("SELECT s_suppkey AS ordinal, 's' || s_suppkey AS id, s_name AS name, s_suppkey % 2 = 0 AS \"attributionRequired\", CASE WHEN s_suppkey % 3 = 0 THEN 'https://example.org/' || s_suppkey END AS url FROM supplier")
def parquet_sources(t) -> DataFrame:
    """Written and read as a table of the declared columns."""
    s = sources(t)
    path = new_path(s.sparkSession)
    write_table(s.withColumn("undeclared", F.lit(1)), path)
    return read_table(s.sparkSession, path, SOURCE).select("ordinal", "id", "name", "attributionRequired", "url")


@query("SELECT n_nationkey, row_number() OVER (ORDER BY n_name, n_nationkey) - 1 AS ordinal FROM nation")
def file_order(t) -> DataFrame:
    return with_ordinal(t("nation"), "n_name", "n_nationkey").select("n_nationkey", "ordinal")


@query(f"""
SELECT id, CAST(i AS INTEGER) AS dim_ord, CASE i {' '.join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DIMENSION_IDS))} END AS dim_id, CASE i {' '.join(f'WHEN {i} THEN t{i}' for i in range(6))} END AS typical
FROM ({RECORDS}), (SELECT unnest(range(6)) AS i)
""")
def dimension_rows(t) -> DataFrame:
    """Profiles in long form, each score beside its dimension's metadata."""
    long = descriptors(t).select("id", F.explode(F.array(*[F.struct(F.lit(d).alias("dim_id"), F.col(f"sensoryAssociation.{d}.typical").alias("typical")) for d in DIMENSION_IDS])).alias("s")).select("id", "s.*")
    return long.join(F.broadcast(dimension_table(long.sparkSession)), "dim_id").select("id", "dim_ord", "dim_id", "typical")


@query(f"SELECT id, {sql_label(STATUS_LABELS, 'status', 1)} AS status, {sql_label(CONFIDENCE_LABELS, 'confidence', 1)} AS confidence, {sql_label(EVIDENCE_LABELS, 'evidence')} AS evidence, {sql_label(MODALITY_LABELS, 'modalities[2]', 1)} AS modality FROM ({RECORDS})")
def label_rows(t) -> DataFrame:
    """Keys beside their labels, by joins with the label tables."""
    rows = descriptors(t).select("id", F.col("descriptorStatus").alias("status"), "confidence", F.col("evidenceStatus").alias("evidence"), F.col("sensoryModalities")[1].alias("modality"))
    for name, labels, part in (("status", STATUS_LABELS, "zhHans"), ("confidence", CONFIDENCE_LABELS, "zhHans"), ("evidence", EVIDENCE_LABELS, "en"), ("modality", MODALITY_LABELS, "zhHans")):
        table = label_table(rows.sparkSession, labels).withColumnRenamed("id", "_id")
        rows = catalog.decoded_or_null(rows.withColumnRenamed(name, "_of"), table, "_of", "_id", f"labels.{part}", name).drop("_of")
    return rows.select("id", "status", "confidence", "evidence", "modality")


# --- lookups, comparison, selection ------------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def keyed_rows(t) -> DataFrame:
    rows = catalog.keyed(t("customer"), "c_custkey")
    return t("orders").join(rows, F.col("o_custkey") == F.col("key")).select("o_orderkey", "row.c_name", "row.c_mktsegment")


_ASSETS = "SELECT 'part-' || p_partkey AS slug, CASE WHEN p_partkey % 8 = 0 THEN 'bloom' END AS family FROM part WHERE p_partkey % 4 = 0"


@query(f"""
SELECT r.slug, coalesce(family, motion) AS motion, CASE WHEN a.slug IS NULL THEN 'procedural' ELSE 'asset ' || r.slug END AS caption FROM ({RECORDS}) r LEFT JOIN ({_ASSETS}) a USING (slug)
""")
def asset_motion(t) -> DataFrame:
    rows = catalog.with_asset(descriptors(t), assets(t))
    return rows.select("slug", "motion", fn.caption(F.col("asset"), F.concat(F.lit("asset "), F.col("asset.slug")), F.lit("procedural")).alias("caption"))


@query(f"SELECT slug, en FROM ({RECORDS}) JOIN ({_ASSETS}) USING (slug)")
def asset_descriptors(t) -> DataFrame:
    return catalog.assets_with_descriptors(assets(t), descriptors(t)).select("slug", "descriptor.labels.en")


_NEXT = f"SELECT a.ordinal, a.category AS ca, b.category AS cb, a.confidence AS fa, b.confidence AS fb, a.modalities AS ma, b.modalities AS mb FROM ({RECORDS}) a JOIN ({RECORDS}) b ON b.ordinal = a.ordinal + 1"


@query(f"""
SELECT ordinal, CASE WHEN ca = cb THEN upper(left(ca, 1)) || substr(ca, 2) END AS category, CASE WHEN fa = fb THEN fa END AS confidence, array_to_string(list_filter(ma, lambda m: list_contains(mb, m)), ',') AS shared FROM ({_NEXT})
""")
def shared_values(t) -> DataFrame:
    """Neighbouring descriptors compared: their category's name if they share it, and modalities in the first one's order."""
    d = descriptors(t)
    a = d.select("ordinal", *[F.col(c).alias(f"a_{c}") for c in ("categoryId", "confidence", "sensoryModalities", "sensoryAssociation")])
    b = d.select((F.col("ordinal") - 1).alias("ordinal"), *[F.col(c).alias(f"b_{c}") for c in ("categoryId", "confidence", "sensoryModalities", "sensoryAssociation")])
    dims = [[F.col(f"{s}_sensoryAssociation.{k}.typical") for k in DIMENSION_IDS] for s in "ab"]
    out = compare.compare(a.join(b, "ordinal"), DIMENSION_IDS, *dims, {k: (F.col(f"a_{k}"), F.col(f"b_{k}")) for k in ("categoryId", "confidence")}, (F.col("a_sensoryModalities"), F.col("b_sensoryModalities")))
    out = catalog.decoded_or_null(out, categories(t), "same_categoryId", "id", "labels.en", "category")
    return out.select("ordinal", "category", F.col("same_confidence").alias("confidence"), F.array_join("shared_modalities", ",").alias("shared"))


_TWO = f"""
SELECT a.ordinal, a.slug AS a, b.slug AS b, a.category AS ca, b.category AS cb, a.status AS sa, b.status AS sb, a.modalities AS ma, b.modalities AS mb,
       [{', '.join(f'abs(a.t{i} - b.t{i})' for i in range(6))}] AS d
FROM ({RECORDS}) a LEFT JOIN ({RECORDS}) b ON b.ordinal = a.ordinal + 1
"""
_DIM = f"[{', '.join(repr(d) for d in DIMENSION_IDS)}]"


@query(f"""
WITH k AS (SELECT *, CASE WHEN ordinal % 4 = 0 THEN 'empty' WHEN ordinal % 4 = 1 OR b IS NULL THEN 'pending' ELSE 'compared' END AS arity FROM ({_TWO}))
SELECT ordinal, arity, CASE WHEN arity <> 'empty' THEN a END AS first, CASE WHEN arity = 'compared' THEN b END AS second,
       CASE WHEN arity = 'compared' THEN {_DIM}[list_position(d, list_max(d))] END AS biggest, CASE WHEN arity = 'compared' AND ca = cb THEN ca END AS category, CASE WHEN arity = 'compared' AND sa = sb THEN sa END AS status,
       CASE WHEN arity = 'compared' THEN array_to_string(list_filter(ma, lambda m: list_contains(mb, m)), ',') END AS shared
FROM k
""")
def compare_overlay(t) -> DataFrame:
    """From the URL of a request to what its comparison shows: nothing, one record that waits, or two compared."""
    d, k = descriptors(t), F.col("ordinal")
    slug = lambda n: F.concat(F.lit("part-"), n)
    url = F.when(k % 4 == 0, "https://h.example/atlas?compare=none,,").when(k % 4 == 1, F.concat(F.lit("https://h.example/atlas?compare="), slug(k), F.lit(",none&view=map")))
    url = url.otherwise(F.concat(F.lit("https://h.example/atlas?view=map&compare=%20"), slug(k), F.lit("%2C"), slug(k + 1), F.lit(",part-1")))
    out = compare.overlay(d.select("ordinal", url.alias("url")), "url", "ordinal", d)
    return out.select("ordinal", "arity", "first", "second", F.col("biggest.dim").alias("biggest"), F.col("same_categoryId").alias("category"), F.col("same_descriptorStatus").alias("status"), F.array_join("shared_modalities", ",").alias("shared"))


@query("""
WITH s AS (SELECT user_id, list(DISTINCT event_type) AS kinds FROM events GROUP BY user_id)
SELECT user_id, array_to_string(list_sort(list_filter(kinds, lambda x: x <> 'click')), ',') AS left_over,
       CASE least(2, len(list_filter(kinds, lambda x: x <> 'click'))) WHEN 0 THEN 'empty' WHEN 1 THEN 'pending' ELSE 'compared' END AS arity FROM s
""")
def selection_removed(t) -> DataFrame:
    kinds = t("events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("kinds"))  # at most one entry for a kind
    rest = kinds.withColumn("rest", selection.remove(F.col("kinds"), F.lit("click")))
    return rest.select("user_id", F.array_join("rest", ",").alias("left_over"), selection.arity(F.col("rest")).alias("arity"))


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'index' WHEN 1 THEN 'map' ELSE 'field' END AS view, event_type || ' ü' AS q, CASE WHEN event_id % 2 = 0 THEN 'fruit' ELSE '' END AS category, user_id || ',x' AS compare FROM events
""")
def url_state(t) -> DataFrame:
    view = F.element_at(F.array(*map(F.lit, ("index", "map", "grid", ""))), (F.col("event_id") % 4 + 1).cast("int"))
    url = F.concat(F.lit("https://h.example/atlas?q="), F.col("event_type"), F.lit("%20%C3%BC&view="), view, F.when(F.col("event_id") % 2 == 0, "&category=fruit").otherwise(""), F.lit("&compare="), F.col("user_id"), F.lit("%2Cx"))
    return t("events").select("event_id", request_state(url).alias("s")).select("event_id", "s.view", "s.q", "s.category", "s.compare")


@query("""
SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/' WHEN 1 THEN '/flavor/' || page_id || '/' WHEN 2 THEN '/atlas/?q=' || page_id WHEN 3 THEN '/methodology/' ELSE '/flavor/' || page_id || '/x' END AS path, page_id % 5 = 0 AS home FROM pages
""")
def page_rewrites(t) -> DataFrame:
    k = F.col("page_id")
    path = F.when(k % 5 == 0, "/").when(k % 5 == 1, F.concat(F.lit("/flavor/"), k)).when(k % 5 == 2, F.concat(F.lit("/atlas?q="), k)).when(k % 5 == 3, "/methodology").otherwise(F.concat(F.lit("/flavor/"), k, F.lit("/x")))
    return t("pages").select("page_id", fn.trailing_slash(path).alias("path"), fn.is_home(path).alias("home"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, printf('%.1f', l_extendedprice / 7.03::DOUBLE) AS one, printf('%.2f', l_extendedprice / 7.03::DOUBLE) AS two FROM lineitem")
def fixed_decimals(t) -> DataFrame:
    x = F.col("l_extendedprice") / 7.03
    return t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", fn.to_fixed(x).alias("one"), fn.to_fixed(x, 2).alias("two"))


# --- validation --------------------------------------------------------------------------------------------------------


def broken(t) -> DataFrame:
    """Descriptors some of which break a rule, by their ordinal."""
    k = F.col("ordinal")
    d = descriptors(t)
    return (
        d.withColumn("labels", F.col("labels").withField("en", F.when(k % 11 == 0, F.lit("  ")).otherwise(F.col("labels.en"))))
        .withColumn("sensoryModalities", F.when(k % 13 == 0, F.array().cast("array<string>")).when(k % 13 == 1, F.array(F.lit("touch"))).otherwise(F.col("sensoryModalities")))
        .withColumn("aliases", F.col("aliases").withField("en", F.when(k % 17 == 0, F.array(F.lit("x"), F.lit(""))).otherwise(F.col("aliases.en"))))
        .withColumn("visualProfile", F.col("visualProfile").withField("halo", F.when(k % 19 == 0, F.lit(1.5)).when(k % 19 == 1, F.lit(float("nan"))).otherwise(F.lit(1.0))))
        .withColumn("sourceIds", F.when(k % 23 == 0, F.array().cast("array<string>")).otherwise(F.col("sourceIds")))
        .withColumn("editorialNote", F.when(k % 29 == 0, pair(F.lit(""), F.lit("x"))).otherwise(F.col("editorialNote")))
    )


_BROKEN = (
    ("labels.en", "too_small", "ordinal % 11 = 0"), ("sensoryModalities", "too_small", "ordinal % 13 = 0"), ("sensoryModalities", "invalid_enum", "ordinal % 13 = 1"), ("aliases.en", "too_small", "ordinal % 17 = 0"),
    ("visualProfile.halo", "out_of_range", "ordinal % 19 IN (0, 1)"), ("sourceIds", "too_small", "ordinal % 23 = 0"), ("editorialNote.en", "too_small", "ordinal % 29 = 0"),
)


@query(" UNION ALL ".join(f"SELECT ordinal, slug AS key, '{path}' AS path, '{code}' AS code FROM ({RECORDS}) WHERE {where}" for path, code, where in _BROKEN))
def validate_records(t) -> DataFrame:
    return validate.record_issues(broken(t), "descriptors", validate.descriptor_rules(), "slug").select("ordinal", "key", "path", "code")


@query(f"SELECT ordinal, slug AS key FROM ({RECORDS}) WHERE status = 'boundary' AND NOT noted")
def validate_boundary_notes(t) -> DataFrame:
    return validate.record_issues(descriptors(t), "descriptors", validate.descriptor_rules(True), "slug").where("code = 'missing_note'").select("ordinal", "key")


@query("""
SELECT s_suppkey AS ordinal, 'attributionRequired' AS path FROM supplier WHERE s_suppkey % 4 = 1
UNION ALL SELECT s_suppkey, 'url' FROM supplier WHERE s_suppkey % 5 = 2 UNION ALL SELECT s_suppkey, 'reusePolicy' FROM supplier WHERE s_suppkey % 7 = 3
""")
def validate_sources(t) -> DataFrame:
    k = F.col("ordinal")
    s = sources(t).withColumns({
        "attributionRequired": F.when(k % 4 == 1, None).otherwise(F.col("attributionRequired")), "url": F.when(k % 5 == 2, "not a url").otherwise(F.col("url")),
        "reusePolicy": F.when(k % 7 == 3, "any").otherwise(F.col("reusePolicy")),
    })
    return validate.record_issues(s, "sources", validate.SOURCE_RULES()).select("ordinal", "path")


_MISSING = f"""
SELECT ordinal, slug AS key, -1 AS place, 'categoryId' AS path, slug || ' references missing category ' || category AS message FROM ({RECORDS}) WHERE category = 'fruit'
UNION ALL SELECT ordinal, slug, i, 'sourceIds.' || i, slug || ' references missing source ' || sources[i + 1] FROM ({RECORDS}), (SELECT unnest([0, 1]) AS i) WHERE sources[i + 1] IN ('s2', 's3')
"""


def missing_references(t) -> DataFrame:
    return validate.reference_issues(descriptors(t), categories(t).where("id <> 'fruit'"), sources(t).where("id not in ('s2', 's3')"))


@query(f"SELECT ordinal, key, CAST(place AS INTEGER) AS place, path, message FROM ({_MISSING})")
def validate_references(t) -> DataFrame:
    return missing_references(t).select("ordinal", "key", F.col("place").cast("int").alias("place"), "path", "message")


_STEPS = " UNION ALL ".join([
    *(f"SELECT 2 AS step, 'descriptors' AS \"table\", ordinal, slug AS key, '{path}' AS path, '{code}' AS code FROM ({RECORDS}) WHERE {where}" for path, code, where in _BROKEN),
    f"SELECT 5, 'descriptors', ordinal, 'twice', 'id', 'not_unique' FROM (SELECT *, row_number() OVER (ORDER BY ordinal) AS nth FROM ({RECORDS}) WHERE ordinal % 31 = 0) WHERE nth = 2",
    f"SELECT 7, 'descriptors', ordinal, slug, 'categoryId', 'missing_reference' FROM ({RECORDS}) WHERE category = 'fruit'",
    f"SELECT 7, 'descriptors', ordinal, slug, 'sourceIds.' || i, 'missing_reference' FROM ({RECORDS}), (SELECT unnest([0, 1]) AS i) WHERE ordinal % 23 <> 0 AND (sources[i + 1] IN ('s2', 's3') OR NOT EXISTS (SELECT 1 FROM supplier WHERE 's' || s_suppkey = sources[i + 1]))",
])


@query(f'SELECT CAST(step AS INTEGER) AS step, step = (SELECT min(step) FROM ({_STEPS})) AS first, "table", ordinal, key, path, code FROM ({_STEPS})')
def validate_dataset(t) -> DataFrame:
    """All three tables through all steps: the issues of each, and whether theirs is the step that fails first."""
    d = broken(t).withColumn("id", F.when(F.col("ordinal") % 31 == 0, "twice").otherwise(F.col("id")))
    issues = validate.validate(categories(t).where("id <> 'fruit'"), sources(t).where("id not in ('s2', 's3')"), d)
    first = issues.agg(F.min("step").alias("_first"))
    return issues.join(F.broadcast(first)).select("step", (F.col("step") == F.col("_first")).alias("first"), "table", "ordinal", "key", "path", "code")


@query(f"""
SELECT path, code, count(*) AS n FROM ({' UNION ALL '.join(f"SELECT '{path}' AS path, '{code}' AS code FROM ({RECORDS}) WHERE {where}" for path, code, where in _BROKEN)}) GROUP BY path, code
UNION ALL SELECT '', name, count(*) FROM ({RECORDS}), (SELECT unnest(['accepted', 'written']) AS name) WHERE NOT ({' OR '.join(where for _, _, where in _BROKEN)}) GROUP BY name
""")
def validate_while_writing(t) -> DataFrame:
    """How many rows break each rule, counted by the job that writes the others, and how many rows the written table has."""
    d = broken(t)
    path = new_path(d.sparkSession)
    counts = validate.write_valid(d, "descriptors", validate.descriptor_rules(), path).where("n > 0").select(F.coalesce("path", F.lit("")).alias("path"), "code", "n")
    return counts.unionByName(read_table(d.sparkSession, path, DESCRIPTOR).groupBy(F.lit("").alias("path"), F.lit("written").alias("code")).agg(F.count("*").alias("n")))


#: URLs made of a page's number, and what is wrong with them.
_URLS = (
    ("https://user:pw@h{}.example:8080/a b?q=[{}]#x", ""), ("http:\\\\h.example\\{}", ""), ("mailto:{}@example.org", ""), ("http://0x7f.{}/", "ipv4"), ("http://[::ffff:1.2.3.4]:80/{}", ""), ("http://[::{}::1]/", "ipv6"),
    ("ftp://h.example:65536/{}", "port"), ("http://a b.example/{}", "host"), ("https://%41.example/{}", ""), ("//h.example/{}", "scheme"), ("file:///C:/{}", ""), ("http://1.2.3.256/{}", "ipv4"), ("https://?{}", "host"),
)


@query(f"""
SELECT page_id, CASE {' '.join(f"WHEN page_id % {len(_URLS)} = {i} THEN '{fault}'" for i, (_, fault) in enumerate(_URLS) if i != 3)} WHEN page_id + 1 > 16777216 THEN 'ipv4' ELSE '' END AS made, '' AS given FROM pages
""")
def url_faults(t) -> DataFrame:
    """The fault of every page's URL, and of one made of its number in one of many forms."""
    k = F.col("page_id")
    made = F.element_at(F.array(*[F.format_string(form.replace("%", "%%").replace("{}", "%1$d"), k + 1) for form, _ in _URLS]), (k % len(_URLS)).cast("int") + 1)
    return t("pages").select("page_id", F.coalesce(fn.url_fault(made), F.lit("")).alias("made"), F.coalesce(fn.url_fault(F.col("url")), F.lit("")).alias("given"))


@query(f"SELECT ordinal, key, string_agg(message, chr(10) ORDER BY place) AS messages FROM ({_MISSING}) GROUP BY ordinal, key")
def validate_messages(t) -> DataFrame:
    return validate.joined_messages(missing_references(t)).select("ordinal", "key", "messages")


@query(f"SELECT ordinal, slug, en, 14 AS columns FROM ({RECORDS})")
def trimmed_records(t) -> DataFrame:
    """White space of every kind about a text goes, and so does a column that is not declared."""
    wide = descriptors(t).withColumn("labels", F.col("labels").withField("en", F.concat(F.lit("　\t"), F.col("labels.en"), F.lit("﻿\n")))).withColumn("undeclared", F.lit(1))
    out = validate.trimmed(wide, DESCRIPTOR)
    return out.select("ordinal", "slug", "labels.en", F.lit(len(out.columns) - 1).alias("columns"))


@query("SELECT l_returnflag, bool_and(l_quantity >= 2) AS every FROM lineitem GROUP BY l_returnflag UNION ALL SELECT 'all', bool_and(l_quantity >= 1) FROM lineitem")
def every_row_holds(t) -> DataFrame:
    rows = t("lineitem")
    whole = validate.every(rows, F.col("l_quantity") >= 1).select(F.lit("all").alias("l_returnflag"), "every")
    return validate.every(rows, F.col("l_quantity") >= 2, "l_returnflag").unionByName(whole)
