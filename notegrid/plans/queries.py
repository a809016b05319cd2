"""Every operator of the library applied to the given tables, with the SQL that must give the same rows.

Roles: embeddings are profiles with a category, documents are text with a category, part and lineitem have the numbers of
ranges and scores, the star schema's keys are references, events are clicks. Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrid import functions as fn
from notegrid.operators import catalog, compare, layout, neighbours, ordering, refresh, related, scan, search, search_index, selection, validate
from notegrid.sources import bucketed, page_paths, url_write_back
from notegrid.streaming.ordered import replayed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TOP = str(Path(__file__).resolve().parents[2])


def query(sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # workers find this package
            paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
            if TOP not in paths:
                spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [TOP, *paths]))
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return register


def r6(x):
    return F.round(x + F.lit(0.0), 6)


# --- neighbours, distance, comparison ---------------------------------------------------------------------------------


@query("""
WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0),
d AS (SELECT q.vec_id AS query, e.vec_id AS key, q.label = e.label AS same,
             sqrt(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))) AS distance
      FROM q JOIN embeddings e ON q.vec_id <> e.vec_id),
r AS (SELECT query, key, distance, CASE WHEN same THEN distance - 2 ELSE distance END AS score FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9), key) AS rank FROM r)
SELECT query, CAST(rank AS BIGINT) AS rank, key, round(distance, 6) AS distance, round(score, 6) AS score FROM k WHERE rank <= 4
""")
def related_topk(t) -> DataFrame:
    e = t("embeddings")
    out = related.related(e, e.where(F.col("vec_id") % 50 == 0), "vec_id", "embedding", "label")
    return out.select("query", F.col("rank").cast("long").alias("rank"), "key", r6(F.col("distance")).alias("distance"), r6(F.col("score")).alias("score"))


@query("""
WITH d AS (SELECT q.vec_id AS query, e.vec_id AS key, q.label = e.label AS same,
             sqrt(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))) AS distance
      FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id),
r AS (SELECT query, key, distance, CASE WHEN same THEN distance - 2 ELSE distance END AS score FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9), key) AS rank FROM r)
SELECT query, CAST(rank AS BIGINT) AS rank, key, round(distance, 6) AS distance, round(score, 6) AS score FROM k WHERE rank <= 4
""")
def related_all(t) -> DataFrame:
    e = t("embeddings")
    out, _ = neighbours.exact_related(e, e, "vec_id", "embedding", "label")
    return out.select("query", F.col("rank").cast("long").alias("rank"), "key", r6(F.col("distance")).alias("distance"), r6(F.col("score")).alias("score"))


@query(SQL["related_topk"])
def refreshed_related(t) -> DataFrame:
    """Lists of an earlier state of the table, brought to the present one: rows missing, others altered, others since removed."""
    e = t("embeddings").select("vec_id", "embedding", "label")
    k = F.col("vec_id")
    absent, altered, since_removed = k % 101 == 7, k % 103 == 9, k % 107 == 11
    turned = F.transform("embedding", lambda x: -x)
    before = e.where(~absent).withColumn("embedding", F.when(altered, turned).otherwise(F.col("embedding")))
    extra = e.where(since_removed).withColumn("vec_id", -k - 1)
    before = before.unionByName(extra)
    asked = k % 50 == 0
    lists = refresh.build(before, before.where(asked), "vec_id", "embedding", "label")
    changed = e.where(absent | altered).select(k.alias("key")).unionByName(extra.select(k.alias("key")))
    refresh.refresh(lists, e, e.where(asked), changed)
    out = lists.ranked(e.sparkSession)
    return out.select("query", F.col("rank").cast("long").alias("rank"), "key", r6(F.col("distance")).alias("distance"), r6(F.col("score")).alias("score"))


_PAIRS = """
SELECT a.vec_id AS a_id, b.vec_id AS b_id, a.embedding AS x, b.embedding AS y, a.label AS la, b.label AS lb
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
"""


def _pairs(t) -> DataFrame:
    e = t("embeddings").select("vec_id", "embedding", "label")
    b = e.select((F.col("vec_id") - 1).alias("_k"), F.col("vec_id").alias("b_id"), F.col("embedding").alias("y"), F.col("label").alias("lb"))
    return e.join(b, F.col("vec_id") == F.col("_k")).select(F.col("vec_id").alias("a_id"), "b_id", F.col("embedding").alias("x"), "y", F.col("label").alias("la"), "lb")


@query(f"""
SELECT a_id, b_id, round(sqrt(list_sum(list_transform(list_zip(x, y), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))), 6) AS distance
FROM ({_PAIRS})
""")
def pair_distance(t) -> DataFrame:
    n = 64
    unrolled = fn.distance([F.col("x")[i] for i in range(n)], [F.col("y")[i] for i in range(n)])
    return _pairs(t).select("a_id", "b_id", r6(unrolled).alias("distance"))


_DIMS = ("d0", "d1", "d2", "d3", "d4", "d5")
_DIFF = f"""
SELECT a_id, b_id, la, lb, CAST(i AS INTEGER) AS i, 'd' || i AS dim, abs(CAST(x[i + 1] AS DOUBLE) - CAST(y[i + 1] AS DOUBLE)) AS difference
FROM ({_PAIRS}), (SELECT unnest(range(6)) AS i)
"""


def _compared(t) -> DataFrame:
    a, b = ([F.col(c)[i].cast("double") for i in range(6)] for c in ("x", "y"))
    return compare.compare(_pairs(t), _DIMS, a, b, {"label": (F.col("la"), F.col("lb"))})


@query(f"""
SELECT a_id, b_id, CAST(row_number() OVER (PARTITION BY a_id, b_id ORDER BY difference DESC, i) AS INTEGER) AS place, dim, round(difference, 6) AS difference FROM ({_DIFF})
""")
def compare_dims(t) -> DataFrame:
    rows = _compared(t).select("a_id", "b_id", F.posexplode("differences").alias("p", "d"))
    return rows.select("a_id", "b_id", (F.col("p") + 1).alias("place"), F.col("d.dim").alias("dim"), r6(F.col("d.difference")).alias("difference"))


@query(f"""
SELECT a_id, b_id, coalesce(max(CASE WHEN la = lb THEN CAST(la AS VARCHAR) END), '') AS same_label, arg_max(dim, (difference, -i)) AS biggest, round(max(difference), 6) AS difference,
       coalesce(string_agg(CASE WHEN difference <= 0.45 THEN dim END, ',' ORDER BY difference DESC, i), '') AS similar
FROM ({_DIFF}) GROUP BY a_id, b_id
""")
def compare_summary(t) -> DataFrame:
    return _compared(t).select("a_id", "b_id", F.coalesce(F.col("same_label").cast("string"), F.lit("")).alias("same_label"), F.col("biggest.dim").alias("biggest"), r6(F.col("biggest.difference")).alias("difference"), F.array_join("similar", ",").alias("similar"))


# --- search -------------------------------------------------------------------------------------------------------------

_NORMAL = "trim(lower(strip_accents(text)))"
_TERMS = ("ÉAU ", "ungkeit", "cionosa", "the inn", "zzzzz")


@query(f"SELECT q, doc_id FROM documents, (SELECT unnest([{', '.join(repr(q) for q in _TERMS)}]) AS q) WHERE contains({_NORMAL}, trim(lower(strip_accents(q))))")
def search_normalized(t) -> DataFrame:
    docs = t("documents").select("doc_id", fn.normalize_term(F.col("text")).alias("t"))
    hits = F.filter(F.array(*[F.when(search.matches(F.col("t"), q), F.lit(q)) for q in _TERMS]), lambda x: x.isNotNull())
    return docs.select(F.explode(hits).alias("q"), "doc_id")


_INDEXED = (*_TERMS, "", " ^ ", "q", "ñ", "é ", "th", "the", "mail3.example", "%", "_", "the of.", "no such term at all")


@query(f"SELECT q, doc_id FROM documents, (SELECT unnest([{', '.join(repr(q) for q in _INDEXED)}]) AS q) WHERE contains({_NORMAL}, trim(lower(strip_accents(replace(q, '^', '')))))")
def search_indexed(t) -> DataFrame:
    docs = t("documents")
    return search_index.find(docs.sparkSession, search_index.build(docs, "doc_id", "text"), list(_INDEXED)).withColumnRenamed("key", "doc_id")


@query(f"SELECT doc_id, lang FROM documents WHERE lang = 'fr' AND contains({_NORMAL}, 'ementre')")
def search_filtered(t) -> DataFrame:
    return search.filter_descriptors(t("documents"), fn.normalize_term(F.col("text")), "ÉMENTRE", "fr", "lang").select("doc_id", "lang")


@query("SELECT doc_id FROM documents")
def search_empty_query(t) -> DataFrame:
    return search.filter_descriptors(t("documents"), fn.normalize_term(F.col("text")), " ^ ").select("doc_id")


@query(f"SELECT doc_id, length({_NORMAL}) AS n, md5({_NORMAL}) AS digest FROM documents")
def normalized_text(t) -> DataFrame:
    docs = t("documents").select("doc_id", fn.normalize_term(F.col("text")).alias("t"))
    return docs.select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


# --- order -------------------------------------------------------------------------------------------------------------

_TYPES = ("PROMO", "MEDIUM", "ECONOMY", "LARGE", "SMALL", "STANDARD")


def _ranks(df: DataFrame, types: tuple[str, ...]) -> DataFrame:
    return df.sparkSession.createDataFrame(list(enumerate(types)), "rank int, p_type string")


def _ranked_parts(t, types: tuple[str, ...] = _TYPES) -> DataFrame:
    part = t("part")
    return ordering.sort_by_category_then_name(part, _ranks(part, types), "p_type", "p_name", "p_partkey")


def _sorted_sql(types: tuple[str, ...]) -> str:
    cases = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(types))
    return f"SELECT *, CASE p_type {cases} ELSE 0 END AS rank, row_number() OVER (ORDER BY CASE p_type {cases} ELSE 0 END, p_name, p_partkey) - 1 AS position FROM part"


_NO = "CASE WHEN position < 9 THEN '0' || (position + 1) ELSE CAST(position + 1 AS VARCHAR) END"


@query(f"SELECT p_partkey, rank, position, {_NO} AS no FROM ({_sorted_sql(_TYPES)})")
def sort_category_name(t) -> DataFrame:
    return _ranked_parts(t).select("p_partkey", "rank", "position", fn.ordinal_label(F.col("position")).alias("no"))


@query(f"SELECT p_partkey, rank, position FROM ({_sorted_sql(_TYPES[:3])})")
def sort_unknown_rank(t) -> DataFrame:
    return _ranked_parts(t, _TYPES[:3]).select("p_partkey", "rank", "position")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'O' ORDER BY o_orderkey LIMIT 4")
def first_k_status(t) -> DataFrame:
    return ordering.first_k(t("orders").where(F.col("o_orderstatus") != "O"), 4, "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, pos, x FROM (SELECT o_orderkey, unnest(range(2)) AS pos, unnest([o_orderstatus, left(o_orderpriority, 1)]) AS x FROM orders)")
def last_two_of_list(t) -> DataFrame:
    three = F.array(F.col("o_custkey").cast("string"), F.col("o_orderstatus"), F.left("o_orderpriority", F.lit(1)))
    rows = t("orders").select("o_orderkey", F.posexplode(ordering.last_two(three)).alias("pos", "x"))
    return rows.select("o_orderkey", F.col("pos").cast("long").alias("pos"), "x")


# --- map, field, marks ------------------------------------------------------------------------------------------------

_SCORES = {"sweet": "p_size / 10", "sour": "(p_partkey % 51) / 10.0", "aroma": "(p_retailprice - 900) / 20"}


def _scored(df: DataFrame) -> DataFrame:
    return df.withColumns({"sweet": F.col("p_size") / 10, "sour": (F.col("p_partkey") % 51) / F.lit(10.0), "aroma": (F.col("p_retailprice") - 900) / 20})


_SQL_SCORED = "SELECT *, CAST(p_size AS DOUBLE) / 10 AS sweet, CAST(p_partkey % 51 AS DOUBLE) / 10 AS sour, (p_retailprice - 900) / 20 AS aroma"
_PCT = "greatest(0, least(100, {} / 5 * 100))"


@query(f"SELECT p_partkey, round({_PCT.format('sweet')}, 6) AS x, round(100 - {_PCT.format('sour')}, 6) AS y, round(5 + aroma * 2.2::DOUBLE, 6) AS radius FROM ({_SQL_SCORED} FROM part)")
def map_point(t) -> DataFrame:
    p = _scored(t("part")).select("p_partkey", fn.map_point(F.col("sweet"), F.col("sour"), F.col("aroma")).alias("p"))
    return p.select("p_partkey", r6(F.col("p.x")).alias("x"), r6(F.col("p.y")).alias("y"), r6(F.col("p.radius")).alias("radius"))


@query(f"""
SELECT p_partkey, confidence, round((5 + aroma * 2.2::DOUBLE) * 0.35::DOUBLE + 2.2::DOUBLE, 6) AS halo, round((5 + aroma * 2.2::DOUBLE) * 0.22::DOUBLE + 1.2::DOUBLE, 6) AS node,
       CASE confidence WHEN 'high' THEN 0.68::DOUBLE ELSE 0.38::DOUBLE END AS stroke, CASE confidence WHEN 'low' THEN 0.42::DOUBLE WHEN 'medium' THEN 0.68::DOUBLE ELSE 0.92::DOUBLE END AS opacity
FROM (SELECT *, CASE WHEN p_size < 17 THEN 'low' WHEN p_size < 34 THEN 'medium' ELSE 'high' END AS confidence FROM ({_SQL_SCORED} FROM part))
""")
def map_encoding(t) -> DataFrame:
    p = _scored(t("part")).withColumn("confidence", F.when(F.col("p_size") < 17, "low").when(F.col("p_size") < 34, "medium").otherwise("high"))
    p = p.select("p_partkey", "confidence", fn.map_encodings(fn.map_point(F.col("sweet"), F.col("sour"), F.col("aroma"))["radius"], F.col("confidence")).alias("m"))
    return p.select("p_partkey", "confidence", r6(F.col("m.halo")).alias("halo"), r6(F.col("m.node")).alias("node"), "m.stroke", "m.opacity")


_LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


@query(f"""
SELECT {_LINE}, round(p1, 6) AS "left", round(p3 - p1, 6) AS width, round(p2, 6) AS typical
FROM (SELECT *, {_PCT.format('(l_discount * 20)')} AS p1, {_PCT.format('(l_tax * 50)')} AS p2, {_PCT.format('(l_quantity / 10)')} AS p3 FROM lineitem)
""")
def range_track(t) -> DataFrame:
    r = fn.score(F.col("l_discount") * 20, F.col("l_tax") * 50, F.col("l_quantity") / 10)
    rows = t("lineitem").withColumn("r", r)
    rows = rows.select(*_LINE.split(", "), fn.range_track(F.col("r.min"), F.col("r.typical"), F.col("r.max")).alias("k"))
    return rows.select(*_LINE.split(", "), r6(F.col("k.left")).alias("left"), r6(F.col("k.width")).alias("width"), r6(F.col("k.typical")).alias("typical"))


_SEED = "list_sum(list_transform(string_split(p_name, ''), lambda c: CAST(ascii(c) AS BIGINT)))"
_FIELD = f"""
SELECT p_partkey, position, seed,
       greatest(8, least(92, 14 + sweet / 5 * 72 + sin(seed) * 7)) AS x, greatest(13, least(88, 50 + cos(position / greatest(1, n - 1) * pi() * 2 + seed) * 8 - sour / 5 * 9)) AS y, 1.5::DOUBLE + aroma * 0.46::DOUBLE AS size
FROM ({_SQL_SCORED}, CAST({_SEED} AS BIGINT) AS seed, count(*) OVER () AS n FROM ({_sorted_sql(_TYPES)}))
"""


def _field(t) -> DataFrame:
    p = layout.with_total(_scored(_ranked_parts(t))).withColumn("seed", fn.char_seed(F.col("p_name")))
    p = p.withColumn("at", fn.field_position(F.col("seed"), F.col("position"), F.col("total"), F.col("sweet"), F.col("sour")))
    return p.select("p_partkey", "position", "total", "seed", "at.x", "at.y", fn.node_size(F.col("aroma")).alias("size"))


@query(f"SELECT p_partkey, position, seed, round(x, 6) AS x, round(y, 6) AS y, round(size, 6) AS size FROM ({_FIELD})")
def field_layout(t) -> DataFrame:
    return _field(t).drop("total").withColumns({c: r6(F.col(c)) for c in ("x", "y", "size")})


@query(f"""
SELECT a.p_partkey, round(a.x, 6) AS x, round(a.y, 6) AS y, round(b.x, 6) AS x2, round(b.y, 6) AS y2
FROM ({_FIELD}) a JOIN ({_FIELD}) b ON b.position = (a.position + 1) % (SELECT count(*) FROM part)
""")
def field_segments(t) -> DataFrame:
    out = layout.segments(_field(t).select("p_partkey", "position", "total", "x", "y"))
    return out.select("p_partkey", *[r6(F.col(c)).alias(c) for c in ("x", "y", "x2", "y2")])


@query(f"""
SELECT p_partkey, CAST(i AS INTEGER) AS i, round(100 + cos(2 * pi() * i / 9 + seed * 0.011::DOUBLE) * (34 + (seed + i * 17) % 42), 6) AS x, round(100 + sin(2 * pi() * i / 9 + seed * 0.011::DOUBLE) * (34 + (seed + i * 17) % 42), 6) AS y,
       3 + (seed + i) % 5 AS r, round(0.2::DOUBLE + i * 0.035::DOUBLE, 6) AS opacity
FROM (SELECT p_partkey, CAST({_SEED} AS BIGINT) AS seed FROM part), (SELECT unnest(range(9)) AS i)
""")
def procedural_points(t) -> DataFrame:
    out = layout.procedural_points(t("part").select("p_partkey", "p_name"), fn.char_seed(F.col("p_name")))
    return out.select("p_partkey", "i", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), "r", r6(F.col("opacity")).alias("opacity"))


# --- lookups -----------------------------------------------------------------------------------------------------------

_STATUS = {"O": "Open", "F": "Filled", "P": "Partial"}


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Filled' WHEN 'P' THEN 'Partial' END AS status, n_name AS nation, upper(o_orderpriority) || ' / ' || c_mktsegment AS label
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
""")
def decode_labels(t) -> DataFrame:
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = catalog.with_category(rows, t("nation"), "c_nationkey", "n_nationkey", {"n_name": "nation"})
    return rows.select("o_orderkey", fn.decode(_STATUS, F.col("o_orderstatus")).alias("status"), "nation", fn.bilingual(fn.upper_label(F.col("o_orderpriority")), F.col("c_mktsegment")).alias("label"))


@query("SELECT DISTINCT c_mktsegment AS segment, n_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def membership_sources(t) -> DataFrame:
    lists = t("customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.collect_set("c_nationkey").alias("ids"))  # at most one entry for a nation
    return catalog.members(lists, F.col("ids"), t("nation"), "n_nationkey").select("segment", "n_nationkey", "n_name")


@query("""
SELECT s_suppkey, CAST(pos AS INTEGER) AS pos, n_nationkey, n_name
FROM (SELECT s_suppkey, unnest([0, 1]) AS pos, unnest([s_nationkey, (s_nationkey * 7) % 40]) AS want FROM supplier) JOIN nation ON want = n_nationkey
""")
def selection_lookup(t) -> DataFrame:
    text = F.concat(F.lit(" "), F.col("s_nationkey"), F.lit(" ,, "), (F.col("s_nationkey") * 7) % 40, F.lit(",3"))
    nation = t("nation").withColumn("key", F.col("n_nationkey").cast("string"))
    return catalog.selected(t("supplier").select("s_suppkey", text.alias("compare")), fn.comma_list(F.col("compare")), nation, "key").select("s_suppkey", "pos", "n_nationkey", "n_name")


@query("""
SELECT user_id, list_reduce(list_prepend('', list(event_type ORDER BY ts, event_id)),
    lambda s, x: CASE WHEN s = '' THEN x WHEN list_contains(string_split(s, ','), x) THEN s WHEN contains(s, ',') THEN string_split(s, ',')[2] || ',' || x ELSE s || ',' || x END) AS selection
FROM events GROUP BY user_id
""")
def selection_fold(t) -> DataFrame:
    return selection.fold(t("events"), "user_id", ["ts", "event_id"], "event_type").withColumn("selection", F.array_join("selection", ","))


#: Two thirds of the users count as one, so that one key has most of the rows.
_HOT_KEY = "CASE WHEN user_id % 3 < 2 THEN -1 ELSE user_id END"


@query(f"""
SELECT user_key, list_reduce(list_prepend('', list(event_type ORDER BY ts, event_id)),
    lambda s, x: CASE WHEN s = '' THEN x WHEN list_contains(string_split(s, ','), x) THEN s WHEN contains(s, ',') THEN string_split(s, ',')[2] || ',' || x ELSE s || ',' || x END) AS selection
FROM (SELECT *, {_HOT_KEY} AS user_key FROM events) GROUP BY user_key
""")
def selection_fold_hot(t) -> DataFrame:
    e = t("events").withColumn("user_key", F.expr(_HOT_KEY))
    return selection.fold(e, "user_key", ["ts", "event_id"], "event_type").withColumn("selection", F.array_join("selection", ","))


@query("""
SELECT user_id, list_reduce(list_prepend('', list(event_type ORDER BY ts, event_id)),
    lambda s, x: CASE WHEN s = '' THEN x WHEN list_contains(string_split(s, ','), x) THEN s WHEN contains(s, ',') THEN string_split(s, ',')[2] || ',' || x ELSE s || ',' || x END) AS selection
FROM events GROUP BY user_id
""")
def selection_stream(t) -> DataFrame:
    out = replayed(t("events"), "user_id", "ts", "event_id", "event_type")
    return out.select(F.col("key").cast("long").alias("user_id"), F.array_join("selection", ",").alias("selection"))


@query(f"""
WITH RECURSIVE e AS (SELECT event_id, user_key, value, row_number() OVER (PARTITION BY user_key ORDER BY ts, event_id, value) AS n FROM (SELECT *, {_HOT_KEY} AS user_key FROM events)),
s(user_key, n, event_id, state) AS (
    SELECT user_key, n, event_id, value * 0.18::DOUBLE FROM e WHERE n = 1
    UNION ALL SELECT e.user_key, e.n, e.event_id, s.state + (e.value - s.state) * 0.18::DOUBLE FROM s JOIN e ON e.user_key = s.user_key AND e.n = s.n + 1)
SELECT event_id, user_key, round(state, 9) AS smoothed FROM s
""")
def smoothed_values(t) -> DataFrame:
    e = t("events").select("event_id", "ts", "value", F.expr(_HOT_KEY).alias("user_key"))
    return scan.smoothed(e, "user_key", ["ts", "event_id"], "value").select("event_id", "user_key", F.round("smoothed", 9).alias("smoothed"))


@query("""
WITH s AS (SELECT DISTINCT user_id, event_type FROM events)
SELECT e.user_id, e.event_id, e.event_type FROM events e JOIN s ON s.user_id = e.user_id + 1 AND s.event_type = e.event_type
""")
def shared_elements(t) -> DataFrame:
    e = t("events").select("user_id", "event_id", "event_type")
    kinds = e.select((F.col("user_id") - 1).alias("user_id"), "event_type").groupBy("user_id").agg(F.collect_set("event_type").alias("other"))  # at most one entry for a kind
    own = e.select("user_id", "event_id", F.array("event_type").alias("a")).join(kinds, "user_id")
    return own.select("user_id", "event_id", F.explode(compare.shared_elements(F.col("a"), F.col("other"))).alias("event_type"))


@query("""
SELECT 0 AS ordinal, '/' AS path UNION ALL SELECT 1, '/atlas' UNION ALL SELECT 2, '/methodology' UNION ALL SELECT p_partkey + 3, '/flavor/' || p_partkey FROM part
""")
def page_path_list(t) -> DataFrame:
    return page_paths(t("part").select(F.col("p_partkey").cast("string").alias("slug"), F.col("p_partkey").alias("ordinal")))


@query(r"""
SELECT page_id, CASE WHEN regexp_matches(url, '[?&]page=') THEN regexp_extract(url, '[?&]page=([^&#]*)', 1) ELSE '' END AS page,
       CASE WHEN regexp_matches(url, '[?&]ref=') THEN regexp_extract(url, '[?&]ref=([^&#]*)', 1) ELSE 'none' END AS ref,
       'q=new' || CASE WHEN regexp_extract(url, '[?&]page=([^&#]*)', 1) <> '' THEN '&page=' || regexp_extract(url, '[?&]page=([^&#]*)', 1) ELSE '' END AS written
FROM pages
""")
def request_parameters(t) -> DataFrame:
    p = t("pages").select("page_id", fn.query_parameter(F.col("url"), "page").alias("page"), fn.query_parameter(F.col("url"), "ref", "none").alias("ref"))
    state = F.map_filter(F.create_map(F.lit("page"), F.col("page"), F.lit("ref"), F.col("ref")), lambda _, v: v != "")
    new = F.array_sort(F.map_entries(url_write_back(state, {"q": "new", "ref": None})))
    text = F.array_join(F.transform(F.reverse(new), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&")
    return p.select("page_id", "page", "ref", text.alias("written"))


@query("""
SELECT d.doc_id, d.source, s.first_doc, s.n_docs
FROM documents d LEFT JOIN (SELECT source, min(doc_id) AS first_doc, count(*) AS n_docs FROM documents GROUP BY source) s ON d.source = s.source
""")
def stored_lookup(t) -> DataFrame:
    """Every document with the row of its source in a registry, both stored in buckets: nothing is shuffled to join them."""
    docs = t("documents").select("doc_id", "source")
    registry = docs.groupBy("source").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_docs"))
    names = bucketed.store(docs, "source", registry, "source", "doc_id")
    return bucketed.looked_up(docs.sparkSession, names, {"first_doc": "first_doc", "n_docs": "n_docs"})


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def stored_references(t) -> DataFrame:
    """Documents that have no row in labels, both stored in buckets."""
    docs = t("documents").select("doc_id", "source")
    return bucketed.dangling(docs.sparkSession, bucketed.store(docs, "doc_id", t("labels"), "doc_id", "doc_id"))


# --- validation --------------------------------------------------------------------------------------------------------


@query(f"""
WITH r AS (SELECT {_LINE}, l_discount * 100 + 0.0 AS lo, l_tax * 100 + 0.0 AS mid, l_quantity / 8 AS hi FROM lineitem),
i AS (
    SELECT {_LINE}, 'r.min' AS path, 'out_of_range' AS code FROM r WHERE lo < 0 OR lo > 5
    UNION ALL SELECT {_LINE}, 'r.typical', 'out_of_range' FROM r WHERE mid < 0 OR mid > 5
    UNION ALL SELECT {_LINE}, 'r.max', 'out_of_range' FROM r WHERE hi < 0 OR hi > 5
    UNION ALL SELECT {_LINE}, 'r.min', 'out_of_order' FROM r WHERE lo > mid
    UNION ALL SELECT {_LINE}, 'r.typical', 'out_of_order' FROM r WHERE mid > hi)
SELECT l_orderkey AS ordinal, l_partkey || '-' || l_suppkey || '-' || l_linenumber AS key, path, code FROM i
""")
def validate_range_issues(t) -> DataFrame:
    r = fn.score(F.col("l_discount") * 100 + 0.0, F.col("l_tax") * 100 + 0.0, F.col("l_quantity") / 8)
    rows = t("lineitem").select(F.col("l_orderkey").alias("ordinal"), F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber").alias("id"), r.alias("r"))
    return validate.record_issues(rows, "lineitem", validate.range_rules("r")).select("ordinal", "key", "path", "code")


@query("""
SELECT 'orders' AS "table", o_orderkey AS ordinal, 'o_orderstatus' AS path FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
UNION ALL SELECT 'orders', o_orderkey, 'o_orderpriority' FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')
UNION ALL SELECT 'events', event_id, 'event_type' FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')
""")
def validate_enum_issues(t) -> DataFrame:
    orders = validate.record_issues(t("orders"), "orders", [validate.member("o_orderstatus", ("O", "F")), validate.member("o_orderpriority", ("1-URGENT", "2-HIGH"))], "o_orderkey", "o_orderkey")
    events = validate.record_issues(t("events"), "events", [validate.member("event_type", ("view", "click", "purchase"))], "event_id", "event_id")
    return orders.unionByName(events).select("table", "ordinal", "path")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def validate_unique(t) -> DataFrame:
    return validate.duplicates(t("lineitem"), "l_orderkey", "l_linenumber")


@query("""
SELECT ordinal, v AS key FROM (SELECT p_name AS v, p_partkey AS ordinal, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part) WHERE k = 2
""")
def validate_unique_issues(t) -> DataFrame:
    return validate.unique_issues(t("part").withColumnRenamed("p_partkey", "ordinal"), "part", "p_name").select("ordinal", "key")


@query("""
SELECT 'customer.none' AS relation, c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'part.none', p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)
UNION ALL SELECT 'orders.none', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'documents.none', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'labels.doc_id', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
""")
def validate_fk(t) -> DataFrame:
    checks = [
        ("customer.none", "customer", "c_custkey", "orders", "o_custkey"), ("part.none", "part", "p_partkey", "lineitem", "l_partkey"), ("orders.none", "orders", "o_orderkey", "lineitem", "l_orderkey"),
        ("documents.none", "documents", "doc_id", "labels", "doc_id"), ("labels.doc_id", "labels", "doc_id", "documents", "doc_id"),
    ]
    rows = [validate.missing(t(a).select(F.col(k).alias("key")), "key", t(b), j).select(F.lit(name).alias("relation"), F.col("key").cast("long").alias("key")) for name, a, k, b, j in checks]
    return reduce(DataFrame.unionByName, rows)
