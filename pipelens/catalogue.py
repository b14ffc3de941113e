"""Named queries over the driver's tables, each with the DuckDB SQL that must return the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipelens.analyses import shadow, whatif
from pipelens.functions import expr as E
from pipelens.functions import text as T
from pipelens.functions.hashing import fractions, draw
from pipelens.operators import cleaning, corruption, diagnostics, features, metrics, models
from pipelens.operators import relational as R
from pipelens.plans.executor import Executor
from pipelens.plans.session import Session
from pipelens.sources.readers import RID, read_parquet, with_rid

QUERIES: dict = {}
ORACLE: dict = {}
KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "nation": "n_nationkey", "documents": "doc_id", "labels": "doc_id", "embeddings": "vec_id", "events": "event_id", "part": "p_partkey", "supplier": "s_suppkey", "pages": "page_id", "conversations": None, "lineitem": None, "benchmark": "item_id"}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    path = f"{d}/{name}.parquet"
    return read_parquet(spark, path, KEYS[name]) if KEYS.get(name) else spark.read.parquet(path)


def U(rid: str, seed: int = 0, stream: int = 0) -> str:  # noqa: N802
    """The seeded hash of functions.hashing as SQL."""
    return f"(('0x' || substr(md5(CAST(CAST({rid} AS BIGINT) AS VARCHAR) || ':{seed}:{stream}'), 1, 8))::BIGINT % 2147483648)"


def r4(c):
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 4)


# --- sources, projections -------------------------------------------------------------------------------------------

@query("scan_parquet", "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice, o_orderpriority FROM orders")
def _(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", r4("o_totalprice").alias("o_totalprice"), "o_orderpriority")


@query("project_cols", "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def _(spark, d):
    return R.project(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag"])


@query("assign_expr", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem")
def _(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r4(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


@query("assign_const", "SELECT c_custkey, 0 AS flag, 'x' AS mark FROM customer")
def _(spark, d):
    return t(spark, d, "customer").select("c_custkey", F.lit(0).alias("flag"), F.lit("x").alias("mark"))


def _labelled(spark, d):
    """Documents with their labels, where there are any: a source of missing values."""
    return R.merge(t(spark, d, "documents").drop("text"), t(spark, d, "labels").drop(RID), on=["doc_id"], how="left")


LABELLED = "(SELECT d.doc_id, d.lang, d.source, d.n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@query("cast_types", f"SELECT doc_id, coalesce(CAST(quality AS VARCHAR), 'nan') AS quality_s, CAST(n_chars AS DOUBLE) AS n_chars_d FROM {LABELLED}")
def _(spark, d):
    return _labelled(spark, d).select("doc_id", E.astype(F.col("quality"), "str").alias("quality_s"), E.astype(F.col("n_chars"), "double").alias("n_chars_d"))


@query("fillna_frame", f"SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic, lang FROM {LABELLED}")
def _(spark, d):
    return R.fillna(_labelled(spark, d).select("doc_id", "quality", "toxic", "lang"), 0)


@query("fillna_series", f"SELECT doc_id, coalesce(toxic, 7) AS toxic FROM {LABELLED}")
def _(spark, d):
    return _labelled(spark, d).select("doc_id", E.fill(F.col("toxic"), 7).alias("toxic"))


@query("replace_scalar", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderpriority = 'F' THEN 'done' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def _(spark, d):
    return R.replace(t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "F", "done")


@query("replace_dict", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders")
def _(spark, d):
    return t(spark, d, "orders").select("o_orderkey", E.replace_values(F.col("o_orderstatus"), {"F": "filled", "O": "open"}).alias("status"))


@query("label_binarize", "SELECT doc_id, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS y FROM labels")
def _(spark, d):
    return t(spark, d, "labels").select("doc_id", E.binarize(F.col("quality"), [0, 1])[0].alias("y"))


@query("label_binarize_many", "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS is_f, CAST(o_orderstatus = 'O' AS INT) AS is_o, CAST(o_orderstatus = 'P' AS INT) AS is_p FROM orders")
def _(spark, d):
    f, o, p = E.binarize(F.col("o_orderstatus"), ["F", "O", "P"])
    return t(spark, d, "orders").select("o_orderkey", f.alias("is_f"), o.alias("is_o"), p.alias("is_p"))


@query("random_source", f"SELECT range AS id, round(({U('range', 3)}) / 2147483648.0, 6) AS u FROM range(1000)")
def _(spark, d):
    from pipelens.sources.readers import random_numbers

    return random_numbers(spark, 1000, 3).select(F.col(RID).alias("id"), F.round("array", 6).alias("u"))


# --- filters --------------------------------------------------------------------------------------------------------

@query("filter_cmp_null_semantics", f"SELECT doc_id, coalesce(quality = 1, false) AS eq, coalesce(quality <> 1, true) AS ne, coalesce(quality < 1, false) AS lt, coalesce(toxic >= 1, false) AS ge FROM {LABELLED} WHERE coalesce(quality <> 1, true)")
def _(spark, d):
    q, x = F.col("quality"), F.col("toxic")
    return _labelled(spark, d).where(E.ne(q, 1)).select("doc_id", E.eq(q, 1).alias("eq"), E.ne(q, 1).alias("ne"), E.lt(q, 1).alias("lt"), E.ge(x, 1).alias("ge"))


@query("filter_bool_logic", "SELECT o_orderkey FROM orders WHERE (o_totalprice > 150000 AND o_orderstatus = 'F') OR ((o_orderpriority = '1-URGENT') <> (o_orderstatus = 'O') AND o_totalprice < 50000)")
def _(spark, d):
    p, s, u = F.col("o_totalprice"), F.col("o_orderstatus"), F.col("o_orderpriority")
    keep = E.either(E.both(E.gt(p, 150000), E.eq(s, "F")), E.both(E.exclusive(E.eq(u, "1-URGENT"), E.eq(s, "O")), E.lt(p, 50000)))
    return t(spark, d, "orders").where(keep).select("o_orderkey")


@query("filter_isin_invert", f"SELECT doc_id, lang FROM {LABELLED} WHERE NOT coalesce(toxic IN (1), false) AND lang IN ('en', 'de')")
def _(spark, d):
    return _labelled(spark, d).where(E.both(E.invert(E.isin(F.col("toxic"), [1])), E.isin(F.col("lang"), ["en", "de"]))).select("doc_id", "lang")


@query("dropna", f"SELECT doc_id, quality, toxic FROM {LABELLED} WHERE quality IS NOT NULL AND toxic IS NOT NULL AND lang IS NOT NULL")
def _(spark, d):
    return R.dropna(_labelled(spark, d).select("doc_id", "quality", "toxic", "lang")).select("doc_id", "quality", "toxic")


@query("sample_frac_seeded", f"SELECT o_orderkey FROM (SELECT *, row_number() OVER (ORDER BY {U('o_orderkey', 5)}, o_orderkey) AS r, count(*) OVER () AS n FROM orders) WHERE r <= round_even(n * 0.3, 0)")
def _(spark, d):
    return R.sample(t(spark, d, "orders"), 0.3, seed=5).select("o_orderkey")


# --- scalar functions -----------------------------------------------------------------------------------------------

@query("arith_ops", "SELECT l_orderkey, l_linenumber, round(l_quantity + 2, 4) AS plus, round(100 - l_quantity, 4) AS minus, round(l_quantity * l_tax, 4) AS times, round(l_extendedprice / nullif(l_discount, 0), 4) AS ratio FROM lineitem")
def _(spark, d):
    a = E.ARITHMETIC
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r4(a["+"](F.col("l_quantity"), 2)).alias("plus"), r4(a["-"](100, F.col("l_quantity"))).alias("minus"), r4(a["*"](F.col("l_quantity"), F.col("l_tax"))).alias("times"), r4(a["/"](F.col("l_extendedprice"), F.col("l_discount"))).alias("ratio"))


@query("str_len_match_contains", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n, regexp_matches(text, '^(?:[A-M])') AS starts, regexp_matches(text, 'th(e|a)') AS has, contains(text, 'on.') AS literal FROM documents")
def _(spark, d):
    c = F.col("text")
    return t(spark, d, "documents").select("doc_id", E.length(c).alias("n"), E.matches(c, "[A-M]").alias("starts"), E.contains(c, "th(e|a)").alias("has"), E.contains(c, "on.", regex=False).alias("literal"))


_PUNCT = T.PUNCTUATION.replace("'", "''")


@query("text_cleaning", f"SELECT page_id, md5(trim(translate(regexp_replace(regexp_replace(lower(url), 'https?://[^\\s]+', '', 'g'), '[0-9]+', '', 'g'), '{_PUNCT}', ''))) AS h, md5(trim(translate(regexp_replace(regexp_replace(lower(html), 'https?://[^\\s]+', '', 'g'), '[0-9]+', '', 'g'), '{_PUNCT}', ''))) AS b FROM pages")
def _(spark, d):
    return t(spark, d, "pages").select("page_id", F.md5(T.clean(F.col("url"))).alias("h"), F.md5(T.clean(F.col("html"))).alias("b"))


@query("sentence_explode", "SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INT) AS place, md5(unnest(s)) AS h FROM (SELECT doc_id, regexp_split_to_array(text, '[.!?]\\s+') AS s FROM documents)")
def _(spark, d):
    return T.sentences(t(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "place", F.md5("sentence").alias("h"))


@query("pair_features", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, CAST(levenshtein(a.n_name, b.n_name) AS INT) AS edits, CAST(abs(length(a.n_name) - length(b.n_name)) AS INT) AS gap FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def _(spark, d):
    n = t(spark, d, "nation").drop(RID)
    m = R.merge(n, n, on=["n_regionkey"], suffixes=("_a", "_b"))
    f = T.word_features(F.col("n_name_a"), F.col("n_name_b"))
    return m.select(F.col("n_nationkey_a").alias("a"), F.col("n_nationkey_b").alias("b"), f["levenshtein"].alias("edits"), f["length_gap"].alias("gap"))


@query("image_parse", "SELECT o_orderkey, list_sum(list_transform(string_split(o_orderkey || ':' || o_custkey || ':7', ':'), lambda x: CAST(x AS INT))) AS total FROM orders")
def _(spark, d):
    px = T.parse_image(F.concat_ws(":", "o_orderkey", "o_custkey", F.lit("7")))
    return t(spark, d, "orders").select("o_orderkey", F.aggregate(px, F.lit(0.0), lambda a, x: a + x).cast("decimal(38,0)").cast("long").alias("total"))


# --- joins ----------------------------------------------------------------------------------------------------------

@query("merge_on", "SELECT o_orderkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    o, c, n = t(spark, d, "orders"), t(spark, d, "customer").drop(RID).withColumnRenamed("c_custkey", "o_custkey"), t(spark, d, "nation").drop(RID)
    return R.merge(R.merge(o, c, on=["o_custkey"]), n, left_on=["c_nationkey"], right_on=["n_nationkey"]).select("o_orderkey", "n_name")


@query("merge_left_right_on", "SELECT o_orderkey, o_custkey, c_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    return R.merge(t(spark, d, "orders"), t(spark, d, "customer").drop(RID), left_on=["o_custkey"], right_on=["c_custkey"]).select("o_orderkey", "o_custkey", "c_custkey", "c_mktsegment")


@query("merge_left", f"SELECT doc_id, quality FROM {LABELLED}")
def _(spark, d):
    return _labelled(spark, d).select("doc_id", "quality")


@query("merge_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    return R.merge(t(spark, d, "orders"), t(spark, d, "customer").drop(RID), left_on=["o_custkey"], right_on=["c_custkey"], how="right").select("c_custkey", "o_orderkey")


@query("merge_outer", "SELECT coalesce(a.k, b.k) AS k, x, y FROM (SELECT p_size AS k, count(*) AS x FROM part GROUP BY 1) a FULL JOIN (SELECT l_linenumber * 9 AS k, count(*) AS y FROM lineitem GROUP BY 1) b ON a.k = b.k")
def _(spark, d):
    a = t(spark, d, "part").groupBy(F.col("p_size").alias("k")).agg(F.count("*").alias("x"))
    b = t(spark, d, "lineitem").groupBy((F.col("l_linenumber") * 9).alias("k")).agg(F.count("*").alias("y"))
    return R.merge(a, b, on=["k"], how="outer")


@query("merge_suffixes", "SELECT a.n_regionkey AS n_regionkey, a.n_name AS n_name_x, b.n_name AS n_name_y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def _(spark, d):
    n = t(spark, d, "nation").select("n_regionkey", "n_name")
    return R.merge(n, n, on=["n_regionkey"])


@query("merge_null_keys", f"SELECT a.doc_id AS doc_id, b.n FROM {LABELLED} a JOIN (SELECT quality, count(*) AS n FROM {LABELLED} GROUP BY 1) b ON a.quality IS NOT DISTINCT FROM b.quality")
def _(spark, d):
    a = _labelled(spark, d).select("doc_id", "quality")
    return R.merge(a, a.groupBy("quality").agg(F.count("*").alias("n")), on=["quality"]).select("doc_id", "n")


@query("fuzzy_merge_levenshtein", "WITH p AS (SELECT DISTINCT p_name AS s FROM part WHERE p_name IS NOT NULL) SELECT a.s AS s_x, b.s AS s_y FROM p a JOIN p b ON abs(length(a.s) - length(b.s)) <= 0.15 * greatest(length(a.s), length(b.s)) + 1 AND 1 - CAST(levenshtein(a.s, b.s) AS DOUBLE) / greatest(length(a.s), length(b.s)) >= 0.85")
def _(spark, d):
    p = t(spark, d, "part").select(F.col("p_name").alias("s")).distinct()
    return R.fuzzy_merge(p, p, "s", "s", 0.85)


@query("fuzzy_merge_names", "SELECT a.n_name AS n_name_x, b.s AS s FROM nation a JOIN (SELECT DISTINCT upper(substr(n_name, 2)) AS s FROM nation) b ON 1 - CAST(levenshtein(a.n_name, b.s) AS DOUBLE) / greatest(length(a.n_name), length(b.s)) >= 0.6")
def _(spark, d):
    n = t(spark, d, "nation").select(F.col("n_name").alias("n_name_x"))
    return R.fuzzy_merge(n, n.select(F.upper(F.expr("substring(n_name_x, 2)")).alias("s")).distinct(), "n_name_x", "s", 0.6)


_DIST = "sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))))"
_TOP4 = f"SELECT query, doc, distance, rank FROM (SELECT a.vec_id AS query, b.vec_id AS doc, {_DIST} AS distance, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DIST}, b.vec_id) AS INT) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE rank <= 4"


def _top4(spark, d):
    e = t(spark, d, "embeddings")
    return R.top_k(e.where("vec_id % 50 = 0"), e, 4)  # the stated query set of a search, against all rows


@query("rag_topk_join", f"SELECT query, doc, round(distance, 4) AS distance, rank FROM ({_TOP4})")
def _(spark, d):
    return _top4(spark, d).select("query", "doc", r4("distance").alias("distance"), "rank")


@query("rag_or_join_changed", f"SELECT DISTINCT query FROM ({_TOP4}) JOIN embeddings ON doc = vec_id WHERE label = 3")
def _(spark, d):
    return diagnostics.flipped_predictions(_top4(spark, d), t(spark, d, "embeddings").where("label = 3"))


@query("rag_vote", f"SELECT query, CAST(label AS INT) AS prediction FROM (SELECT query, label, row_number() OVER (PARTITION BY query ORDER BY count(*) DESC, label) AS r FROM ({_TOP4}) JOIN embeddings ON doc = vec_id GROUP BY query, label) WHERE r = 1")
def _(spark, d):
    e = t(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0")
    return models.RetrievalVote().respond(q.select(RID), _top4(spark, d), e.withColumn("texts", F.lit("")), "label").select("query", "prediction")


@query("provenance_join_back", "SELECT o_orderpriority, c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000 GROUP BY 1, 2")
def _(spark, d):
    s = Session(spark)
    o, c = s.read_parquet(f"{d}/orders.parquet", key="o_orderkey"), s.read_parquet(f"{d}/customer.parquet", key="c_custkey")
    j = o.merge(c, left_on="o_custkey", right_on="c_custkey")[["o_orderpriority", "o_totalprice"]]
    j = j[j["o_totalprice"] > 100000]
    ex = Executor()
    rows, source = ex.value(s.plan, j.node), ex.value(s.plan, c.node)
    # the segment was projected away; the row's way back to its customer was not
    return rows.join(source.select(F.col("_prov_1").alias("at"), "c_mktsegment"), F.col("_prov_1") == F.col("at")).groupBy("o_orderpriority", "c_mktsegment").agg(F.count("*").alias("n"))


@query("provenance_groupby_restart", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS m, true AS own_rows FROM orders GROUP BY 1")
def _(spark, d):
    s = Session(spark)
    g = s.read_parquet(f"{d}/orders.parquet", key="o_orderkey").groupby("o_orderpriority").agg(m=("o_totalprice", "mean"))
    df = Executor().value(s.plan, g.node)
    return df.select("o_orderpriority", r4("m").alias("m"), (F.col("_prov_1") == F.col(RID)).alias("own_rows"))


@query("concat_columns", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def _(spark, d):
    o = t(spark, d, "orders")
    return R.concat_columns(o.select(RID, "o_orderkey", "o_orderstatus"), o.select(RID, "o_orderpriority")).drop(RID)


# --- aggregations, splits -------------------------------------------------------------------------------------------

@query("groupby_named_agg", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(sum(o_totalprice), 2) AS total, round(min(o_totalprice), 4) AS lo, round(max(o_totalprice), 4) AS hi, count(o_totalprice) AS n, count(DISTINCT o_custkey) AS customers, round(median(o_totalprice), 4) AS med, round(stddev_samp(o_totalprice), 4) AS sd, round(var_samp(o_totalprice), 1) AS var, arg_min(o_custkey, o_orderkey) AS first_c, arg_max(o_custkey, o_orderkey) AS last_c, count(*) AS size FROM orders GROUP BY 1")
def _(spark, d):
    g = R.group_agg(t(spark, d, "orders"), ["o_orderpriority"], {"mean": ("o_totalprice", "mean"), "total": ("o_totalprice", "sum"), "lo": ("o_totalprice", "min"), "hi": ("o_totalprice", "max"), "n": ("o_totalprice", "count"), "customers": ("o_custkey", "nunique"), "med": ("o_totalprice", "median"), "sd": ("o_totalprice", "std"), "var": ("o_totalprice", "var"), "first_c": ("o_custkey", "first"), "last_c": ("o_custkey", "last"), "size": ("o_orderkey", "size")})
    return g.withColumns({c: r4(c) for c in ("mean", "lo", "hi", "med", "sd")} | {"total": F.round("total", 2), "var": F.round("var", 1)})


@query("groupby_drops_null_keys", f"SELECT quality, count(*) AS n FROM {LABELLED} WHERE quality IS NOT NULL GROUP BY 1")
def _(spark, d):
    return R.group_agg(_labelled(spark, d), ["quality"], {"n": ("doc_id", "count")})


@query("groupby_mean_join_back", "SELECT o_orderkey, o_totalprice > 1.2 * avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS y FROM orders")
def _(spark, d):
    o = t(spark, d, "orders")
    m = R.group_agg(o, ["o_orderpriority"], {"mean_price": ("o_totalprice", "mean")})
    return R.merge(o, m, on=["o_orderpriority"]).select("o_orderkey", E.gt(F.col("o_totalprice"), F.col("mean_price") * 1.2).alias("y"))


_SPLIT = f"SELECT o_orderkey, row_number() OVER (ORDER BY {U('o_orderkey', 1, 1)}, o_orderkey) <= ceil(count(*) OVER () * 0.25) AS test FROM orders"


@query("train_test_split_seeded", _SPLIT)
def _(spark, d):
    train, test = R.train_test_split(t(spark, d, "orders").select(RID, "o_orderkey"), 0.25, 1)
    return train.select("o_orderkey", F.lit(False).alias("test")).unionAll(test.select("o_orderkey", F.lit(True).alias("test")))


@query("nested_row_selection", f"SELECT o_orderkey, r <= floor(n * 0.2) AS a, r <= floor(n * 0.5) AS b, r <= floor(n * 0.9) AS c FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {U('o_orderkey', 4)}, o_orderkey) AS r, count(*) OVER () AS n FROM orders)")
def _(spark, d):
    o = t(spark, d, "orders")
    a, b, c = fractions(o, F.col(RID), [0.2, 0.5, 0.9], 4)
    return o.select("o_orderkey", a.alias("a"), b.alias("b"), c.alias("c"))


# --- features -------------------------------------------------------------------------------------------------------

@query("standard_scale", "SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 4) AS z FROM orders")
def _(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("z"))
    return features.StandardScaler(["z"]).fit(o).apply(o).withColumn("z", r4("z"))


@query("robust_scale", "SELECT o_orderkey, round((o_totalprice - (SELECT median(o_totalprice) FROM orders)) / (SELECT quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) FROM orders), 4) AS z FROM orders")
def _(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("z"))
    return features.RobustScaler(["z"]).fit(o).apply(o).withColumn("z", r4("z"))


@query("onehot", "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS DOUBLE) AS \"o_orderstatus=F\", CAST(o_orderstatus = 'O' AS DOUBLE) AS \"o_orderstatus=O\", CAST(o_orderstatus = 'P' AS DOUBLE) AS \"o_orderstatus=P\" FROM orders")
def _(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return features.OneHotEncoder(["o_orderstatus"]).fit(o).apply(o).drop("o_orderstatus")


@query("kbins_uniform", "WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT o_orderkey, CAST(least(4, floor((o_totalprice - lo) / ((hi - lo) / 5))) AS DOUBLE) AS bin FROM orders, b")
def _(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("bin"))
    return features.KBinsDiscretizer(["bin"], 5).fit(o).apply(o)


@query("kbins_quantile", "WITH b AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders) SELECT o_orderkey, CAST(CAST(o_totalprice >= a AS INT) + CAST(o_totalprice >= b AS INT) + CAST(o_totalprice >= c AS INT) AS DOUBLE) AS bin FROM orders, b")
def _(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("bin"))
    return features.KBinsDiscretizer(["bin"], 4, "quantile").fit(o).apply(o)


def _impute(strategy, **o):
    def run(spark, d):
        x = _labelled(spark, d).select("doc_id", F.col("quality").cast("double").alias("q"))
        return features.SimpleImputer(["q"], strategy, **o).fit(x).apply(x).withColumn("q", r4("q"))

    return run


for _s, _f in (("mean", "avg"), ("median", "median")):
    query(f"impute_{_s}", f"SELECT doc_id, round(coalesce(CAST(quality AS DOUBLE), (SELECT {_f}(quality) FROM {LABELLED})), 4) AS q FROM {LABELLED}")(_impute(_s))
query("impute_mode", f"SELECT doc_id, round(coalesce(CAST(quality AS DOUBLE), (SELECT quality FROM {LABELLED} WHERE quality IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)), 4) AS q FROM {LABELLED}")(_impute("most_frequent"))
query("impute_const_indicator", f"SELECT doc_id, coalesce(CAST(quality AS DOUBLE), 9) AS q, CAST(quality IS NULL AS INT) AS q_missing FROM {LABELLED}")(_impute("constant", fill_value=9, add_indicator=True))


@query("tfidf_idf_values", "WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS term FROM documents) SELECT term, round(ln((1 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1, 4) AS idf FROM w GROUP BY 1")
def _(spark, d):
    docs = t(spark, d, "documents")
    n = docs.count()
    terms = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]{2,}"), F.lit(0))).alias("term")).distinct()
    return terms.groupBy("term").agg(F.round(F.log((F.lit(1 + n)) / (F.lit(1.0) + F.count("*"))) + 1, 4).alias("idf"))


# --- metrics --------------------------------------------------------------------------------------------------------

_PRED = "(SELECT l.doc_id, quality AS label, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS prediction, lang, source FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def _predicted(spark, d):
    m = R.merge(t(spark, d, "labels"), t(spark, d, "documents").drop(RID, "text"), on=["doc_id"])
    return m.select("doc_id", F.col("quality").alias("label"), (F.col("n_chars") > 1000).cast("int").alias("prediction"), "lang", "source")


@query("accuracy", f"SELECT round(avg(CAST(label = prediction AS INT)), 4) AS accuracy FROM {_PRED}")
def _(spark, d):
    return _predicted(spark, d).agg(F.round(metrics.accuracy(), 4).alias("accuracy"))


_FNR = "round(avg(CASE WHEN label = 1 THEN CAST(prediction = 0 AS INT) END), 4)"


@query("metric_frame_fnr", f"SELECT lang AS group_name, {_FNR} AS value FROM {_PRED} GROUP BY 1 UNION ALL SELECT 'overall', {_FNR} FROM {_PRED}")
def _(spark, d):
    return metrics.metric_frame(_predicted(spark, d), "false_negative_rate", "lang").withColumn("value", r4("value"))


@query("equalized_odds", f"SELECT round(greatest(max(t) - min(t), max(f) - min(f)), 4) AS value FROM (SELECT avg(CASE WHEN label = 1 THEN prediction END) AS t, avg(CASE WHEN label = 0 THEN prediction END) AS f FROM {_PRED} GROUP BY lang)")
def _(spark, d):
    return metrics.equalized_odds_difference(_predicted(spark, d), "lang").withColumn("value", r4("value"))


# --- corruptions ----------------------------------------------------------------------------------------------------

_HIT = f"(row_number() OVER (ORDER BY {U('o_orderkey', 1)}, o_orderkey) <= floor(count(*) OVER () * 0.5))"


def _corrupted(kind, column, fraction=0.5):
    def run(spark, d):
        o = corruption.corrupt(t(spark, d, "orders"), column, kind, fraction, 1)
        return o.select("o_orderkey", r4(column).alias("v") if column == "o_totalprice" else F.col(column).alias("v"))

    return run


_FACTOR = f"CASE ({U('o_orderkey', 1, 2)}) % 3 WHEN 0 THEN 10 WHEN 1 THEN 100 ELSE 1000 END"
query("corruption_scaling", f"SELECT o_orderkey, round(CASE WHEN {_HIT} THEN o_totalprice * {_FACTOR} ELSE o_totalprice END, 4) AS v FROM orders")(_corrupted("scaling", "o_totalprice"))
query("corruption_missing", f"SELECT o_orderkey, round(CASE WHEN {_HIT} THEN NULL ELSE o_totalprice END, 4) AS v FROM orders")(_corrupted("missing_values", "o_totalprice"))
query("corruption_broken_chars", f"SELECT o_orderkey, CASE WHEN {_HIT} THEN translate(o_orderpriority, '{corruption.LOOK_ALIKE[0]}', '{corruption.LOOK_ALIKE[1]}') ELSE o_orderpriority END AS v FROM orders")(_corrupted("broken_characters", "o_orderpriority"))
query("corruption_cat_shift", f"WITH c AS (SELECT s, coalesce(lead(s) OVER (ORDER BY s), first_value(s) OVER (ORDER BY s)) AS n FROM (SELECT DISTINCT o_orderstatus AS s FROM orders)) SELECT o_orderkey, CASE WHEN hit THEN n ELSE o_orderstatus END AS v FROM (SELECT *, {_HIT} AS hit FROM orders) JOIN c ON s = o_orderstatus")(_corrupted("categorical_shift", "o_orderstatus"))


def _noise_sql():
    from pipelens.functions.hashing import STEPS

    x = f"({U('o_orderkey', 1)})"
    steps, cols = f"SELECT o_orderkey, o_totalprice, {_HIT} AS hit, {x} AS x0 FROM orders", []
    for k in range(12):
        steps = f"SELECT *, (x{k} * {STEPS[k % 4]} + {12345 + k * 7919}) % 2147483648 AS x{k + 1} FROM ({steps})"
        cols.append(f"x{k + 1} / 2147483648e0")
    return f"SELECT o_orderkey, round(CASE WHEN hit THEN o_totalprice + 2 * (SELECT stddev_pop(o_totalprice) FROM orders) * ({' + '.join(cols)} - 6) ELSE o_totalprice END, 2) AS v FROM ({steps})"


@query("corruption_noise", _noise_sql())
def _(spark, d):
    o = corruption.corrupt(t(spark, d, "orders"), "o_totalprice", "gaussian_noise", 0.5, 1)
    return o.select("o_orderkey", F.round("o_totalprice", 2).alias("v"))


_PERMUTE = f"SELECT a.o_orderkey, b.o_orderpriority AS v FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) a JOIN (SELECT o_orderpriority, row_number() OVER (ORDER BY {U('o_orderkey', 1)}, o_orderkey) AS r FROM orders) b ON a.r = b.r"


@query("permute_column", _PERMUTE)
def _(spark, d):
    return corruption.permute(t(spark, d, "orders"), "o_orderpriority", 1).select("o_orderkey", F.col("o_orderpriority").alias("v"))


@query("typos", None)
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(corruption.typos(F.col("text"), F.col(RID), 1)).alias("h"))


# --- cleaning -------------------------------------------------------------------------------------------------------

_REPAIR = {"mean": "avg(v)", "median": "median(v)", "mode": "(SELECT v FROM inside GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"}
_BOUNDS = {"sd": "avg(l_extendedprice) - 3 * stddev_pop(l_extendedprice) AS lo, avg(l_extendedprice) + 3 * stddev_pop(l_extendedprice) AS hi", "iqr": "quantile_cont(l_extendedprice, 0.25) - 1.5 * (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) AS lo, quantile_cont(l_extendedprice, 0.75) + 1.5 * (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) AS hi"}


def _outliers(rule, repair):
    def run(spark, d):
        x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("v"))
        return cleaning.repair_outliers(x, x, "v", rule, repair).withColumn("v", r4("v"))

    return run


for _rule in ("sd", "iqr"):
    for _how, _e in _REPAIR.items():
        _val = f"(SELECT {_e} FROM inside)" if _how != "mode" else _e
        query(f"clean_outliers_{_rule}_{_how}", f"WITH b AS (SELECT {_BOUNDS[_rule]} FROM lineitem), inside AS (SELECT l_extendedprice AS v FROM lineitem, b WHERE l_extendedprice BETWEEN lo AND hi) SELECT l_orderkey, l_linenumber, round(CASE WHEN l_extendedprice BETWEEN lo AND hi THEN l_extendedprice ELSE {_val} END, 4) AS v FROM lineitem, b")(_outliers(_rule, _how))


@query("clean_drop_duplicates", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def _(spark, d):
    return R.drop_duplicates(t(spark, d, "documents"), ["text"]).select("doc_id")


@query("clean_drop_missing", f"SELECT doc_id FROM {LABELLED} WHERE quality IS NOT NULL")
def _(spark, d):
    x = _labelled(spark, d)
    return cleaning.repair_missing(x, x, "quality", "delete").select("doc_id")


# --- diagnostics ----------------------------------------------------------------------------------------------------

_SHAPLEY = f"""
WITH d AS (SELECT a.vec_id AS test, b.vec_id AS train, {_DIST} AS d, CAST(a.label = b.label AS INT) AS m FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND b.vec_id % 50 <> 0),
r AS (SELECT *, row_number() OVER w AS i, lead(m) OVER w AS nx, count(*) OVER (PARTITION BY test) AS n FROM d WINDOW w AS (PARTITION BY test ORDER BY d, train)),
s AS (SELECT *, CASE WHEN nx IS NULL THEN CAST(m AS DOUBLE) / n ELSE (m - nx) * least(1, i) / CAST(i AS DOUBLE) / 1 END AS step FROM r),
v AS (SELECT train, avg(s) AS shapley FROM (SELECT train, sum(step) OVER (PARTITION BY test ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s FROM s) GROUP BY 1)
"""


def _shapley(spark, d):
    e = t(spark, d, "embeddings")
    return diagnostics.knn_shapley(e.where("vec_id % 50 <> 0"), e.where("vec_id % 50 = 0"))


@query("knn_shapley_values", _SHAPLEY + "SELECT train, round(shapley, 6) AS shapley FROM v")
def _(spark, d):
    return _shapley(spark, d).select("train", F.round("shapley", 6).alias("shapley"))


@query("knn_shapley_topk", _SHAPLEY + "SELECT train, round(shapley, 6) AS shapley FROM v ORDER BY round(shapley, 9), train LIMIT 20")
def _(spark, d):
    return _shapley(spark, d).orderBy(F.round("shapley", 9), "train").limit(20).select("train", F.round("shapley", 6).alias("shapley"))


_SLICES = f"(SELECT coalesce(lang, 'nan') AS lang, coalesce(source, 'nan') AS source, CAST(label <> prediction AS DOUBLE) AS e FROM {_PRED})"


@query("slice_finder_top1", f"WITH t AS (SELECT count(*) AS n, avg(e) AS m FROM {_SLICES}), g AS (SELECT lang, source, count(*) AS size, sum(e) AS error_sum FROM {_SLICES} GROUP BY GROUPING SETS ((lang), (source), (lang, source))) SELECT lang, source, size, error_sum, round(0.95 * (error_sum / size / m - 1) - 0.05 * (n / CAST(size AS DOUBLE) - 1), 4) AS score FROM g, t WHERE error_sum > 0 AND 0.95 * (error_sum / size / m - 1) - 0.05 * (n / CAST(size AS DOUBLE) - 1) > 0 ORDER BY score DESC, lang NULLS FIRST, source NULLS FIRST LIMIT 1")
def _(spark, d):
    p = _predicted(spark, d).withColumn("e", (F.col("label") != F.col("prediction")).cast("int"))
    return diagnostics.slice_finder(p, ["lang", "source"], "e").withColumn("score", r4("score"))


@query("changed_rows_diff", f"SELECT o_orderkey AS _rid FROM (SELECT *, {_HIT} AS hit FROM orders) WHERE hit")
def _(spark, d):
    o = t(spark, d, "orders")
    return R.changed_rows(o, corruption.corrupt(o, "o_totalprice", "scaling", 0.5, 1), ["o_totalprice", "o_orderstatus"])


@query("prediction_diff_merge", f"SELECT o_orderkey, CAST(CASE WHEN hit THEN o_totalprice * {_FACTOR} ELSE o_totalprice END > 200000 AS INT) AS prediction FROM (SELECT *, {_HIT} AS hit FROM orders)")
def _(spark, d):
    o = t(spark, d, "orders")
    predict = lambda x: x.select(RID, "o_orderkey", (F.col("o_totalprice") > 200000).cast("int").alias("prediction"))
    bad = corruption.corrupt(o, "o_totalprice", "scaling", 0.5, 1)
    changed = R.changed_rows(o, bad, ["o_totalprice"])
    return R.merge_predictions(predict(o), predict(R.semi(bad, changed))).select("o_orderkey", "prediction")


# --- what-if reports ------------------------------------------------------------------------------------------------

def orders_pipeline(d: str, model=lambda: models.Stump(0)):
    """Orders that cost more than 1.2 times their priority's mean, told by price."""

    def record(s: Session):
        o, c = s.read_parquet(f"{d}/orders.parquet", key="o_orderkey"), s.read_parquet(f"{d}/customer.parquet", key="c_custkey")
        j = o.merge(c, left_on="o_custkey", right_on="c_custkey")
        m = j.groupby("o_orderpriority").agg(mean_price=("o_totalprice", "mean"))
        j = j.merge(m, on="o_orderpriority")
        j = j.assign(label=(j["o_totalprice"] > j["mean_price"] * 1.2).map(lambda c: c.cast("int"), "int"))
        j = j[j["o_orderstatus"].isin(["F", "O"])]
        train, test = j.train_test_split(0.25, seed=1)
        made = features.ColumnTransformer(features.StandardScaler(["o_totalprice", "c_acctbal"]), features.OneHotEncoder(["c_mktsegment"]))
        train.fit(made, model, "label").score(test)

    return record


def plan_of(spark, d, **o):
    s = Session(spark)
    orders_pipeline(d, **o)(s)
    return s.plan


def report(spark, d, analysis, schema: str, rules=None) -> DataFrame:
    rows = whatif.run(plan_of(spark, d), [analysis], rules)[0][0]
    names = [x.split(" ")[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(round(r[c], 4) if isinstance(r[c], float) else r[c] for c in names) for r in rows], schema)


def base_sql(where: str = "o_orderstatus IN ('F', 'O')") -> str:
    return f"""
j AS (SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority, c_acctbal, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey),
m AS (SELECT o_orderpriority, avg(o_totalprice) AS mean_price FROM j GROUP BY 1),
l AS (SELECT j.*, CASE WHEN o_totalprice > mean_price * 1.2 THEN 1 ELSE 0 END AS label FROM j JOIN m ON j.o_orderpriority = m.o_orderpriority WHERE {where}),
s AS (SELECT *, row_number() OVER (ORDER BY {U('o_orderkey', 1, 1)}, o_orderkey) <= ceil(count(*) OVER () * 0.25) AS test FROM l),
p AS (SELECT o_orderkey, test, label, o_totalprice AS v, c_acctbal, row_number() OVER (PARTITION BY test ORDER BY {U('o_orderkey', 1)}, o_orderkey) AS r, count(*) OVER (PARTITION BY test) AS n, {_FACTOR} AS f FROM s)"""


CUT = "(SELECT (avg(v) FILTER (label = 1) + avg(v) FILTER (label = 0)) / 2 FROM {0} WHERE NOT test)"


def accuracy_sql(rows: str, cut_from: str | None = None) -> str:
    return f"(SELECT round(avg(CAST((v > {CUT.format(cut_from or rows)}) = (label = 1) AS INT)), 4) FROM {rows} WHERE test)"


def _corrupt_sql():
    parts, ctes = [], []
    for i, f in enumerate((0.2, 0.5, 0.9)):
        ctes.append(f"x{i} AS (SELECT test, label, CASE WHEN test AND r <= floor(n * {f}) THEN v * f ELSE v END AS v FROM p), y{i} AS (SELECT test, label, CASE WHEN r <= floor(n * {f}) THEN v * f ELSE v END AS v FROM p)")
        parts.append(f"SELECT 'o_totalprice', {f}, {accuracy_sql(f'x{i}')}, {accuracy_sql(f'y{i}')}")
    first = f"SELECT NULL AS \"column\", CAST(NULL AS DOUBLE) AS corruption_percentage, {accuracy_sql('p')} AS accuracy_corrupt_test_only, {accuracy_sql('p')} AS accuracy_corrupt_train_and_test"
    return f"WITH {base_sql()}, {', '.join(ctes)} {' UNION ALL '.join([first, *parts])}"


@query("whatif_corruption_report", _corrupt_sql())
def _(spark, d):
    return report(spark, d, whatif.DataCorruption([("o_totalprice", "scaling")], also_train=True), "column string, corruption_percentage double, accuracy_corrupt_test_only double, accuracy_corrupt_train_and_test double")


@query("whatif_corruption_unoptimised", _corrupt_sql())
def _(spark, d):
    from pipelens.plans.optimizer import Rules

    return report(spark, d, whatif.DataCorruption([("o_totalprice", "scaling")], also_train=True), "column string, corruption_percentage double, accuracy_corrupt_test_only double, accuracy_corrupt_train_and_test double", Rules(False, False, False, False, False))


_MODE = "(SELECT label FROM p WHERE NOT test GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_DUMMY = f"(SELECT round(avg(CAST(label = {_MODE} AS INT)), 4) FROM p WHERE test)"


def _models_sql():
    ctes = [f"x{i} AS (SELECT test, label, CASE WHEN test AND r <= floor(n * {f}) THEN v * f ELSE v END AS v FROM p)" for i, f in enumerate((0.2, 0.5, 0.9))]
    rows = []
    for model in ("stump", "dummy"):
        rows.append(f"SELECT '{model}' AS model, CAST(NULL AS DOUBLE) AS corruption_percentage, {accuracy_sql('p') if model == 'stump' else _DUMMY} AS accuracy_corrupt_test_only")
        rows += [f"SELECT '{model}', {f}, {accuracy_sql(f'x{i}') if model == 'stump' else _DUMMY}" for i, f in enumerate((0.2, 0.5, 0.9))]
    return f"WITH {base_sql()}, {', '.join(ctes)} {' UNION ALL '.join(rows)}"


@query("whatif_corruption_x_models", _models_sql())
def _(spark, d):
    return report(spark, d, whatif.DataCorruptionWithModels([("o_totalprice", "scaling")], [("stump", lambda: models.Stump(0)), ("dummy", models.Dummy)]), "model string, corruption_percentage double, accuracy_corrupt_test_only double")


def _cleaning_sql():
    rows, ctes = [f"SELECT NULL AS corrupted_column, NULL AS cleaning_method, {accuracy_sql('p')} AS accuracy"], []
    for rule in ("sd", "iqr"):
        b = _BOUNDS[rule].replace("l_extendedprice", "v")
        ctes.append(f"b_{rule} AS (SELECT {b} FROM p WHERE NOT test), i_{rule} AS (SELECT v FROM p, b_{rule} WHERE NOT test AND v BETWEEN lo AND hi)")
        for how in ("mean", "median", "mode"):
            val = {"mean": f"(SELECT avg(v) FROM i_{rule})", "median": f"(SELECT median(v) FROM i_{rule})", "mode": f"(SELECT v FROM i_{rule} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"}[how]
            ctes.append(f"c_{rule}_{how} AS (SELECT test, label, CASE WHEN v BETWEEN lo AND hi THEN v ELSE {val} END AS v FROM p, b_{rule})")
            rows.append(f"SELECT 'o_totalprice', '{rule}_{how}', {accuracy_sql(f'c_{rule}_{how}')}")
    return f"WITH {base_sql()}, {', '.join(ctes)} {' UNION ALL '.join(rows)}"


@query("whatif_cleaning_report", _cleaning_sql())
def _(spark, d):
    methods = [f"{r}_{h}" for r in ("sd", "iqr") for h in ("mean", "median", "mode")]
    return report(spark, d, whatif.DataCleaning({"o_totalprice": whatif.ErrorType.OUTLIERS}, methods), "corrupted_column string, cleaning_method string, accuracy double")


@query("whatif_operator_impact_report", f"WITH {base_sql()} SELECT NULL AS operator_type, NULL AS strategy_description, {accuracy_sql('p')} AS accuracy UNION ALL SELECT 'Transformer', 'passthrough', {accuracy_sql('p')} UNION ALL SELECT 'Selection', 'drop', (WITH {base_sql('true')} SELECT {accuracy_sql('p')})")
def _(spark, d):
    return report(spark, d, whatif.OperatorImpact(), "operator_type string, strategy_description string, accuracy double")


_CENTROID = """(WITH z AS (SELECT *, (v - (SELECT avg(v) FROM p WHERE NOT test)) / (SELECT stddev_pop(v) FROM p WHERE NOT test) AS a, (c_acctbal - (SELECT avg(c_acctbal) FROM p WHERE NOT test)) / (SELECT stddev_pop(c_acctbal) FROM p WHERE NOT test) AS b, c_mktsegment AS g FROM p JOIN s USING (o_orderkey, test, label, c_acctbal)),
k AS (SELECT label AS y, avg(a) AS ka, avg(b) AS kb, avg(CAST(g = 'AUTOMOBILE' AS INT)) AS k1, avg(CAST(g = 'BUILDING' AS INT)) AS k2, avg(CAST(g = 'FURNITURE' AS INT)) AS k3, avg(CAST(g = 'HOUSEHOLD' AS INT)) AS k4, avg(CAST(g = 'MACHINERY' AS INT)) AS k5 FROM z WHERE NOT test GROUP BY 1),
e AS (SELECT o_orderkey, label, arg_min(y, (a - ka) ** 2 + (b - kb) ** 2 + (CAST(g = 'AUTOMOBILE' AS INT) - k1) ** 2 + (CAST(g = 'BUILDING' AS INT) - k2) ** 2 + (CAST(g = 'FURNITURE' AS INT) - k3) ** 2 + (CAST(g = 'HOUSEHOLD' AS INT) - k4) ** 2 + (CAST(g = 'MACHINERY' AS INT) - k5) ** 2) AS y FROM z, k WHERE test GROUP BY 1, 2)
SELECT round(avg(CAST(y = label AS INT)), 4) FROM e)"""


@query("whatif_model_variants_report", f"WITH {base_sql()} SELECT NULL AS model_variant, {accuracy_sql('p')} AS accuracy UNION ALL SELECT 'dummy', {_DUMMY} UNION ALL SELECT 'centroid', {_CENTROID}")
def _(spark, d):
    return report(spark, d, whatif.ModelVariants([("dummy", models.Dummy), ("centroid", models.NearestCentroid)]), "model_variant string, accuracy double")


@query("whatif_permutation_report", f"WITH {base_sql()}, q AS (SELECT a.test, a.label, b.v FROM (SELECT *, row_number() OVER (PARTITION BY test ORDER BY o_orderkey) AS k FROM p) a JOIN p b ON a.test = b.test AND a.k = b.r WHERE a.test UNION ALL SELECT test, label, v FROM p WHERE NOT test) SELECT NULL AS \"column\", {accuracy_sql('p')} AS accuracy UNION ALL SELECT 'o_totalprice', {accuracy_sql('q')} UNION ALL SELECT 'c_acctbal', {accuracy_sql('p')} UNION ALL SELECT 'c_mktsegment', {accuracy_sql('p')}")
def _(spark, d):
    return report(spark, d, whatif.PermutationFeatureImportance(), "column string, accuracy double")


@query("whatif_filter_variants_report", f"WITH {base_sql()}, q AS (SELECT * FROM p WHERE c_acctbal > 0) SELECT NULL AS filter_variant, {accuracy_sql('p')} AS accuracy UNION ALL SELECT 'in credit', {accuracy_sql('q')} UNION ALL SELECT 'dummy model', {_DUMMY}")
def _(spark, d):
    return report(spark, d, whatif.DataFilterVariants({"in credit": ("c_acctbal", lambda c: E.gt(c, 0))}, add_dummy_model=True), "filter_variant string, accuracy double")


_ROBUST = f"""WITH {base_sql()}, h AS (SELECT *, CASE WHEN test AND row_number() OVER (PARTITION BY test ORDER BY {U('o_orderkey', 2)}, o_orderkey) <= floor(n * 0.1) THEN v * CASE ({U('o_orderkey', 2, 2)}) % 3 WHEN 0 THEN 10 WHEN 1 THEN 100 ELSE 1000 END ELSE v END AS w FROM p),
x AS (SELECT test, label, w AS v FROM h), b AS (SELECT {_BOUNDS['iqr'].replace('l_extendedprice', 'v')} FROM p WHERE NOT test),
g AS (SELECT test, label, CASE WHEN w BETWEEN lo AND hi THEN w ELSE (SELECT avg(v) FROM p, b WHERE NOT test AND v BETWEEN lo AND hi) END AS v FROM h, b),
a AS (SELECT {accuracy_sql('p')} AS before, {accuracy_sql('x', 'p')} AS corrupted, {accuracy_sql('g', 'p')} AS fixed)
SELECT 'o_totalprice' AS "column", before, corrupted, CASE WHEN before * 0.99 < corrupted THEN NULL ELSE fixed END AS fixed FROM a"""


@query("data_error_report", _ROBUST)
def _(spark, d):
    found = shadow.DataErrorRobustness().check(plan_of(spark, d), Executor())["o_totalprice"]
    return spark.createDataFrame([("o_totalprice", *(None if x is None else round(x, 4) for x in found.values()))], "column string, before double, corrupted double, fixed double")


@query("label_errors_report", None)
def _(spark, d):
    found = shadow.LabelErrors().check(plan_of(spark, d), Executor())
    return spark.createDataFrame([(found["before"], found["after"], found["flipped"])], "before double, after double, flipped long")


@query("fairness_slices_report", None)
def _(spark, d):
    found = shadow.FairnessSlices(("c_mktsegment", "o_orderpriority")).check(plan_of(spark, d), Executor())
    return spark.createDataFrame([(str(found.get("slice")), found.get("before"), found.get("after"))], "slice string, before double, after double")


@query("changed_pipeline_report", f"WITH {base_sql()} SELECT 'first' AS run, {accuracy_sql('p')} AS accuracy, 0 AS replacement UNION ALL SELECT 'changed', {_DUMMY}, 1 UNION ALL SELECT 'back', {accuracy_sql('p')}, 1")
def _(spark, d):
    """A pipeline, an edit of its model, and back again; each run takes over what the one before has left."""
    from pipelens import api

    edits = [("first", {}), ("changed", {"model": models.Dummy}), ("back", {})]
    rows, earlier = [], None
    for name, edit in edits:
        record = orders_pipeline(d, **edit)
        r = (api.on_changed(spark, earlier, record) if earlier else api.on_pipeline(spark, record)).execute()
        if earlier and not r.info["reused"]:
            raise AssertionError("nothing of the earlier run was taken over")
        rows.append((name, round(r.scores["accuracy"], 4), r.changes.replacement if r.changes else 0))
        earlier = r.extraction
    return spark.createDataFrame(rows, "run string, accuracy double, replacement int")


# --- models of pyspark.ml: values depend on the library, so rows only --------------------------------------------------

def _ml(model):
    def run(spark, d):
        plan = plan_of(spark, d, model=model)
        return spark.createDataFrame([(k, v) for k, v in Executor().scores([plan])[0].items()], "score string, value double")

    return run


for _name, _model in {"ml_decision_tree_accuracy": models.decision_tree, "ml_logreg_accuracy": models.logistic_regression, "ml_sgd_hinge_accuracy": lambda: models.sgd("hinge"), "ml_svc_accuracy": models.svc, "ml_gbt_accuracy": lambda: models.boosted_trees(5), "ml_mlp_accuracy": lambda: models.neural_network([7, 5, 2], maxIter=20)}.items():
    query(_name, None)(_ml(_model))


@query("ml_grid_search_accuracy", None)
def _(spark, d):
    from pyspark.ml.classification import LogisticRegression

    return _ml(lambda: models.GridSearch(LogisticRegression, {"regParam": [0.0, 0.1]}, 2))(spark, d)


def _vector_norms(df, c):
    from pyspark.ml.functions import vector_to_array

    return df.select(RID, F.round(F.sqrt(F.aggregate(vector_to_array(c), F.lit(0.0), lambda a, x: a + x * x)), 4).alias("norm"))


@query("ml_pca", None)
def _(spark, d):
    x = t(spark, d, "orders")
    return _vector_norms(features.PCATransformer(["o_totalprice", "o_custkey"], 1).fit(x).apply(x), "pca")


@query("ml_svd", None)
def _(spark, d):
    x = t(spark, d, "orders")
    return _vector_norms(features.TruncatedSVD(["o_totalprice", "o_custkey"], 1).fit(x).apply(x), "svd")


@query("hashing_tf", None)
def _(spark, d):
    x = t(spark, d, "documents")
    return _vector_norms(features.HashingVectorizer(["text"]).apply(x), "hashed")


@query("count_vectorizer", None)
def _(spark, d):
    x = t(spark, d, "conversations").withColumn(RID, F.col("conv_id") * 1000 + F.col("turn"))
    return _vector_norms(features.CountVectorizer(["text"], max_features=2000).fit(x).apply(x), "counts")


@query("word2vec", None)
def _(spark, d):
    x = t(spark, d, "nation").withColumn("text", F.col("n_name"))
    return _vector_norms(features.Word2VecTransformer(["text"], 4).fit(x).apply(x), "w2v")


@query("random_hash_stream", f"SELECT o_orderkey, {U('o_orderkey', 9, 3)} AS u FROM orders")
def _(spark, d):
    o = with_rid(t(spark, d, "orders"))
    return o.select("o_orderkey", draw(F.col(RID), 9, 3).alias("u"))


from pipelens import catalogue_more  # noqa: E402, F401  registers the rest
