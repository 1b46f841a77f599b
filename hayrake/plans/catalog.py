"""Named queries over the test tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions import numeric as num
from ..functions import text as tx
from ..operators import asked
from ..operators import evaluation as ev
from ..operators import features as ft
from ..operators import fusion, geography, history, learn, lexical, pool, relational, vectors
from ..sources import tables
from . import fixtures as fx
from .fixtures import CORPUS_SQL, INTER_SQL, bm25_sql, fold_sql

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
SEED = CONFIG.seed


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    """The other modules register their queries as they are imported; they build on this one."""
    from . import blocks, hybrid, learning, ranking  # noqa: F401


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def c_(body: str) -> str:
    return f"WITH {CORPUS_SQL.strip()}{body}"


def i_(body: str) -> str:
    return f"WITH {INTER_SQL.strip()}{body}"


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---------------------------------------------------------------- text


@query(c_(f"SELECT item_id, {fold_sql('body')} AS norm, length({fold_sql('title')})::INT AS title_chars FROM corpus"))
def norm_text_projection(s, d):
    c = fx.corpus(s, d)
    return c.select("item_id", tx.folded(F.col("body")).alias("norm"), F.length(tx.folded(F.col("title"))).alias("title_chars"))


@query(c_("SELECT item_id, term, count(*)::BIGINT AS tf FROM (SELECT item_id, unnest(terms) AS term FROM body_terms) GROUP BY ALL"))
def token_counts(s, d):
    return lexical.term_counts(fx.body_terms(s, d), "item_id", "terms")


@query(c_("SELECT item_id, len(terms)::INT AS n_terms, len(list_distinct(terms))::INT AS n_distinct FROM body_terms"))
def doc_lengths(s, d):
    return fx.body_terms(s, d).select("item_id", F.size("terms").alias("n_terms"), F.size(F.array_distinct("terms")).alias("n_distinct"))


@query(c_("""SELECT term, count(*)::BIGINT AS n FROM (SELECT unnest(terms) AS term FROM body_terms) GROUP BY term ORDER BY n DESC, term LIMIT 500"""))
def vocab_topn(s, d):
    """The vocabulary cap: the most frequent terms of the corpus."""
    tf = fx.body_terms(s, d).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return tf.orderBy(F.desc("n"), "term").limit(500)


@query(c_(""", capped AS (SELECT term FROM (SELECT unnest(terms) AS term FROM title_terms) GROUP BY term ORDER BY count(*) DESC, term LIMIT 1000)
SELECT item_id, term, count(*)::BIGINT AS tf FROM (SELECT item_id, unnest(terms) AS term FROM title_terms) WHERE term IN (FROM capped) GROUP BY ALL"""))
def capped_term_counts(s, d):
    return lexical.term_counts(fx.title_terms(s, d), "item_id", "terms", cap=1000)


@query("""SELECT page_id, try_cast(nullif(regexp_extract(html, 'track\\(([0-9]{1,9})\\)', 1), '') AS DOUBLE) AS captured,
coalesce(try_cast(nullif(regexp_extract(html, 'track\\(([0-9]{1,9})\\)', 1), '') AS DOUBLE) >= 100, false) AS at_least FROM pages""")
def regex_capture_threshold(s, d):
    got = F.nullif(F.regexp_extract("html", r"track\(([0-9]{1,9})\)", 1), F.lit("")).try_cast("double")
    return tables.read(s, d, "pages", "page_id", "html").select("page_id", got.alias("captured"), F.coalesce(got >= 100, F.lit(False)).alias("at_least"))


@query("SELECT (length(p_type || ' ' || p_name) >= 15)::INT + (length(p_type || ' ' || p_name) >= 25)::INT AS bin, length(p_type || ' ' || p_name) AS size, count(*)::BIGINT AS n FROM part GROUP BY ALL")
def length_bins(s, d):
    size = F.length(F.concat_ws(" ", "p_type", "p_name")).cast("bigint")
    return tables.read(s, d, "part", "p_type", "p_name").groupBy(num.length_bin(size).alias("bin"), size.alias("size")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, coalesce(try_cast(props AS DOUBLE), -1) AS parsed, coalesce(nullif(event_type, 'click'), '') AS filled,
round(ln(1 + greatest(value, 0)), 6) AS logged FROM events""")
def null_fill_and_safe_cast(s, d):
    e = tables.read(s, d, "events", "event_id", "props", "event_type", "value")
    return e.select("event_id", F.coalesce(num.safe_double(F.col("props")), F.lit(-1.0)).alias("parsed"), F.coalesce(F.nullif(F.col("event_type"), F.lit("click")), F.lit("")).alias("filled"), r6(num.log1p_floor(F.col("value"))).alias("logged"))


@query("""SELECT count(*) - count(DISTINCT host) - count(*) FILTER (host IS NULL) AS repeated, count(*) FILTER (host IS NULL) AS missing, count(*) FILTER (NOT regexp_full_match(host, 'www[.][a-z]+[.](com|org)')) AS malformed
FROM (SELECT nullif(regexp_extract(url, '//([a-z.0-9-]+)', 1), '') AS host FROM pages)""")
def format_predicates(s, d):
    """Repeated, missing and malformed keys: hosts of pages under a stated form."""
    hosts = tables.read(s, d, "pages", "url").select(F.nullif(F.regexp_extract("url", "//([a-z.0-9-]+)", 1), F.lit("")).alias("host"))
    return tables.require(hosts, "host", ("host", r"^www\.[a-z]+\.(com|org)$"))


@query()
def html_unescape(s, d):
    """Full normalisation with entities and compatibility forms: Python, so without SQL."""
    return tables.read(s, d, "pages", "page_id", "html").select("page_id", tx.normalized(F.col("html")).alias("norm"))


_GRAMS = """grams AS (SELECT item_id, unnest(flatten(list_transform(list_filter(string_split(norm, ' '), lambda w: w <> ''),
  lambda w: flatten(list_transform(list_filter([3, 4, 5], lambda n: n = 3 OR length(w) + 2 >= n),
    lambda n: list_transform(range(1, greatest(length(w) + 4 - n, 2)), lambda i: substring(' ' || w || ' ', i, n))))))) AS term FROM titles)"""


@query(c_(f""", titles AS (SELECT item_id, {fold_sql('title')} AS norm FROM corpus), {_GRAMS}
SELECT item_id, term, count(*)::BIGINT AS tf FROM grams GROUP BY ALL"""))
def char_ngrams(s, d):
    c = fx.corpus(s, d).select("item_id", tx.char_grams(tx.folded(F.col("title"))).alias("grams"))
    return lexical.term_counts(c, "item_id", "grams")


def _words(q: DataFrame) -> DataFrame:
    """The distinct words of queries, of weight 1."""
    return q.select("query_id", F.explode(F.array_distinct("q_terms")).alias("term"), F.lit(1.0).alias("w"))


def _channels(s, d) -> dict:
    """Postings, queries and digits of the three lexical channels."""
    words = _words(fx.query_terms(s, d))
    indexes = {n[0]: (fx.bm25_index(s, d, n), words, lexical.SCORE_DIGITS) for n in ("body", "title")}
    return indexes | {"c": (*fx.char_queries(s, d), lexical.DIGITS)}


def _char_scores(s, d, k=None):
    return asked.scores(*_asked(*fx.char_queries(s, d)), lexical.DIGITS, k)


def _asked(index: asked.Postings, queries: DataFrame) -> tuple:
    return index, "item_id", queries, "query_id"


def _best(s, d, k):
    """(query_id, item_id, channel, score, place): the k best of every query in each channel, from one pass over the documents."""
    place = F.row_number().over(Window.partitionBy("query_id", "channel").orderBy(num.ranking_key(F.col("score")).desc(), "item_id"))
    return lexical.channel_scores(_channels(s, d), "item_id", "query_id", k=k).withColumn("place", place).where(F.col("place") <= k)


_CHAR_SQL = f""", titles AS (SELECT item_id, {fold_sql('title')} AS norm FROM corpus), {_GRAMS},
g_tf AS (SELECT item_id, term, count(*) AS tf FROM grams GROUP BY ALL),
g_idf AS (SELECT term, ln((1 + (SELECT count(*) FROM corpus)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM g_tf GROUP BY term HAVING count(*) >= 2),
g_raw AS (SELECT item_id, term, (1 + ln(tf)) * idf AS w FROM g_tf JOIN g_idf USING (term)),
g_w AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM g_raw),
q_grams AS (SELECT item_id AS query_id, term FROM (WITH titles AS (SELECT query_id AS item_id, {fold_sql('query_text')} AS norm FROM queries), {_GRAMS} SELECT * FROM grams)),
q_tf AS (SELECT query_id, term, count(*) AS tf FROM q_grams GROUP BY ALL),
q_raw AS (SELECT query_id, term, (1 + ln(tf)) * idf AS w FROM q_tf JOIN g_idf USING (term)),
q_w AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM q_raw),
chars AS (SELECT query_id, item_id, round(sum(q_w.w * g_w.w), 9) AS score FROM q_w JOIN g_w USING (term) GROUP BY ALL)"""


@query(c_(_CHAR_SQL + """ SELECT query_id, item_id, score, place::INT AS place FROM (
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS place FROM chars) WHERE place <= 20"""))
def char_tfidf_top20(s, d):
    return pool.stable_topk(_char_scores(s, d, 20), 20, "query_id", "item_id").select("query_id", "item_id", "score", "place")


# ---------------------------------------------------------------- BM25


def _body(s, d, k=None):
    """Scores of the bodies; with k only those that are among a task's k best."""
    return asked.scores(*_asked(fx.bm25_index(s, d, "body"), _words(fx.query_terms(s, d))), lexical.SCORE_DIGITS, k)


def _title(s, d, k=None):
    return asked.scores(*_asked(fx.bm25_index(s, d, "title"), _words(fx.query_terms(s, d))), lexical.SCORE_DIGITS, k)


_TOP = """SELECT query_id, item_id, score, place::INT AS place FROM (
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS place FROM {}) WHERE place <= {}"""


def _top(scores, k):
    return pool.stable_topk(scores, k, "query_id", "item_id").select("query_id", "item_id", "score", "place")


@query(c_("," + bm25_sql("body", "body_terms") + _TOP.format("body", 50)))
def bm25_top50(s, d):
    return _top(_body(s, d, 50), 50)


@query(c_("," + bm25_sql("titled", "title_terms") + _TOP.format("titled", 50)))
def bm25_title_field(s, d):
    return _top(_title(s, d, 50), 50)


@query(c_(", langs AS (SELECT query_id, [q_terms[1], q_terms[2]] AS q_terms FROM query_terms WHERE len(q_terms) >= 2)," + bm25_sql("filtered", "body_terms", "langs") + _TOP.format("filtered", 20)))
def bm25_filter_query(s, d):
    """A short text (two words of the query) asked of the body index; real filter texts are in ``baseline_score_full``."""
    q = fx.query_terms(s, d).where(F.size("q_terms") >= 2).select("query_id", F.slice("q_terms", 1, 2).alias("q_terms"))
    return _top(asked.scores(*_asked(fx.bm25_index(s, d, "body"), _words(q)), lexical.SCORE_DIGITS, 20), 20)


@query(c_("," + bm25_sql("body", "body_terms") + "SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM body_idf"))
def idf_table(s, d):
    docs = fx.body_terms(s, d)
    return lexical.idf_table(lexical.term_counts(docs, "item_id", "terms"), docs.agg(F.count("*").alias("n"))).withColumn("idf", r6("idf"))


@query(c_("," + bm25_sql("body", "body_terms") + "SELECT query_id, item_id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score FROM body"))
def bm25_normalised(s, d):
    return lexical.max_normalised(_body(s, d), "query_id").withColumn("score", r6("score"))


@query(c_("," + bm25_sql("titled", "title_terms") + """, pairs AS (SELECT query_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS place FROM titled) WHERE place <= 50),
wanted AS (SELECT query_id, unnest(list_distinct(q_terms)) AS term, len(list_distinct(q_terms)) AS n FROM query_terms),
marked AS (SELECT *, idf, coalesce(idf, (SELECT max(idf) FROM titled_idf)) AS full_idf FROM wanted LEFT JOIN titled_idf USING (term)),
total AS (SELECT query_id, max(n) AS n, sum(full_idf) AS total FROM marked GROUP BY 1),
hit AS (SELECT query_id, item_id, count(*) AS have, sum(idf) AS got FROM pairs JOIN marked USING (query_id) JOIN titled_tf USING (item_id, term) WHERE idf IS NOT NULL GROUP BY ALL)
SELECT query_id, item_id, round(coalesce(have, 0) / n::DOUBLE, 6) AS share, round(coalesce(got, 0) / total, 6) AS idf_share FROM pairs LEFT JOIN hit USING (query_id, item_id) JOIN total USING (query_id)"""))
def token_coverage_features(s, d):
    docs, q = fx.title_terms(s, d), fx.query_terms(s, d)
    pairs = pool.stable_topk(_title(s, d, 50), 50, "query_id", "item_id").select("query_id", "item_id")
    idf = lexical.idf_table(lexical.term_counts(docs, "item_id", "terms"), docs.agg(F.count("*").alias("n")))
    out = lexical.coverage(pairs, q, "query_id", "q_terms", docs, "item_id", "terms", idf)
    return out.select("query_id", "item_id", r6("share").alias("share"), r6("idf_share").alias("idf_share"))


# ---------------------------------------------------------------- interactions


@query(i_("SELECT DISTINCT context_key, query_norm, search_location, filters, category, delivery FROM inter"))
def context_key_sha256(s, d):
    return fx.interactions(s, d).select("context_key", *fx.KEY).distinct()


@query(i_("SELECT DISTINCT context_key, item_id FROM inter"))
def dedup_context_item(s, d):
    return relational.distinct_pairs(fx.interactions(s, d), "context_key", "item_id")


@query(i_("SELECT (SELECT count(*) FROM inter) - (SELECT count(*) FROM (SELECT DISTINCT context_key, item_id FROM inter)) AS repeated"))
def duplicate_pair_count(s, d):
    n = fx.interactions(s, d).groupBy("context_key", "item_id").agg(F.count("*").alias("n"))
    return n.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))


@query(i_("SELECT context_key, item_id, l_quantity FROM inter WHERE item_id IN (SELECT item_id FROM items WHERE p_size <= 30)"))
def semi_join_corpus(s, d):
    return relational.within(fx.interactions(s, d), fx.items(s, d).where("p_size <= 30"), "item_id").select("context_key", "item_id", "l_quantity")


@query(i_("SELECT context_key, item_id, l_quantity FROM inter WHERE item_id NOT IN (SELECT item_id FROM items WHERE p_size <= 30)"))
def anti_join_history(s, d):
    return relational.without(fx.interactions(s, d), fx.items(s, d).where("p_size <= 30"), "item_id").select("context_key", "item_id", "l_quantity")


@query(i_("""SELECT context_key, query_norm, item_id FROM inter WHERE query_norm NOT IN (SELECT query_norm FROM inter WHERE search_location = 0 AND l_quantity < 2)
AND item_id NOT IN (SELECT item_id FROM items WHERE p_retailprice > 1500) AND context_key NOT IN (SELECT context_key FROM inter WHERE l_extendedprice > 40000)"""))
def compound_purge(s, d):
    h = fx.interactions(s, d)
    out = relational.purge(h, query_norm=h.where("search_location = 0 AND l_quantity < 2"), item_id=fx.items(s, d).where("p_retailprice > 1500"), context_key=h.where("l_extendedprice > 40000"))
    return out.select("context_key", "query_norm", "item_id")


@query(i_("SELECT item_id, micro, coalesce(p, 0)::DOUBLE AS price FROM inter LEFT JOIN (SELECT item_id, p_retailprice AS p FROM items WHERE p_size <= 30) USING (item_id)"))
def left_lookup_default(s, d):
    prices = fx.items(s, d).where("p_size <= 30").select("item_id", F.col("p_retailprice").alias("price"))
    return relational.look_up(fx.interactions(s, d).select("item_id", "micro"), prices, "item_id", "price", 0.0)


@query(i_("SELECT DISTINCT ON (context_key) context_key, query_norm FROM inter ORDER BY context_key"))
def distinct_context_first(s, d):
    return relational.first_by(fx.interactions(s, d).select("context_key", "query_norm"), ["context_key"], [F.col("query_norm")])


@query(i_("SELECT count(DISTINCT query_norm) AS texts, count(DISTINCT context_key) AS contexts, round(avg((search_location = item_location)::INT), 6) AS same_place FROM inter"))
def history_profile(s, d):
    h = fx.interactions(s, d)
    same = F.avg((F.col("search_location") == F.col("item_location")).cast("double"))
    return h.agg(F.count_distinct("query_norm").alias("texts"), F.count_distinct("context_key").alias("contexts"), r6(same).alias("same_place"))


@query(c_("SELECT round(quantile_cont(length(body), 0.5), 6) AS p50, round(quantile_cont(length(body), 0.95), 6) AS p95, round(quantile_cont(length(body), 0.99), 6) AS p99, max(length(body))::INT AS longest FROM corpus"))
def length_percentiles(s, d):
    n = F.length("body")
    p = F.percentile(n, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return fx.corpus(s, d).agg(p.alias("p"), F.max(n).alias("longest")).select(*[r6(F.get("p", k)).alias(f"p{q}") for k, q in enumerate((50, 95, 99))], "longest")


# ---------------------------------------------------------------- geography


@query("""SELECT c_nationkey AS place, median(c_acctbal) AS lat, median(c_custkey)::DOUBLE AS lon FROM customer GROUP BY 1""")
def location_centres_median(s, d):
    c = tables.read(s, d, "customer", "c_custkey", "c_nationkey", "c_acctbal").withColumnRenamed("c_nationkey", "place")
    return geography.centres(c, "place", "c_acctbal", "c_custkey")


_KM = """km AS (SELECT a.location AS search_location, b.location AS item_location, 2 * 6371.0::DOUBLE * asin(sqrt(least(greatest(
  pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2), 0), 1))) AS km FROM places a, places b)"""
_MOVES = """counts AS (SELECT search_location, item_location, count(*) AS n FROM inter GROUP BY ALL),
moves AS (SELECT *, sqrt(n / max(n) OVER w::DOUBLE) * least(1, sum(n) OVER w / 20.0::DOUBLE) AS strength, n / sum(n) OVER w::DOUBLE AS p, ln(1 + sum(n) OVER w) AS support FROM counts WINDOW w AS (PARTITION BY search_location))"""
_GEO = """geo AS (SELECT search_location, item_location, CASE WHEN max(g) OVER (PARTITION BY search_location) = 0 THEN 1 ELSE g END AS geo FROM (
SELECT search_location, item_location, CASE WHEN search_location = item_location THEN 1 ELSE greatest(coalesce(0.7::DOUBLE * exp(-km / 40.0::DOUBLE), 0), coalesce(strength, 0)) END AS g
FROM km LEFT JOIN moves USING (search_location, item_location)))"""


def _km(s, d):
    p = fx.places(s, d)
    return geography.distances(p.withColumnRenamed("location", "search_location"), "search_location", p.withColumnRenamed("location", "item_location"), "item_location")


def _geo(s, d):
    moves = geography.transitions(fx.interactions(s, d), "search_location", "item_location")
    return geography.compatibility(_km(s, d), moves, "search_location", "item_location")


@query(i_(f", {_KM} SELECT search_location, item_location, round(km, 5) AS km FROM km"))
def haversine_pairs(s, d):
    return _km(s, d).withColumn("km", F.round("km", 5))


@query(i_(f", {_KM}, {_MOVES}, {_GEO} SELECT search_location, item_location, round(geo, 6) AS geo FROM geo"))
def geo_compatibility(s, d):
    return _geo(s, d).withColumn("geo", r6("geo"))


@query(i_(f", {_MOVES} SELECT search_location, item_location, n::BIGINT AS n, round(strength, 6) AS strength FROM moves"))
def location_transitions(s, d):
    m = geography.transitions(fx.interactions(s, d), "search_location", "item_location")
    return m.select("search_location", "item_location", "n", r6("strength").alias("strength"))


@query(i_(f", {_MOVES} SELECT search_location, item_location, round(p, 6) AS p, round(support, 6) AS support FROM moves"))
def transition_probability(s, d):
    m = geography.transitions(fx.interactions(s, d), "search_location", "item_location")
    return m.select("search_location", "item_location", r6("p").alias("p"), r6("support").alias("support"))


@query(i_(""", g AS (SELECT avg((search_location = item_location)::INT) AS g FROM inter)
SELECT micro, count(*)::BIGINT AS n, round((sum((search_location = item_location)::INT) + 50 * max(g)) / (count(*) + 50), 6) AS share FROM inter, g GROUP BY micro"""))
def smoothed_same_place(s, d):
    h = fx.interactions(s, d).withColumn("same", F.col("search_location") == F.col("item_location"))
    return geography.smoothed(h, "micro", "same", 50.0).withColumn("share", r6("share"))


@query("""WITH n AS (SELECT c_custkey, c_nationkey % 5 AS place, -60.0::DOUBLE + 5 * c_nationkey AS lat, -170.0::DOUBLE + 13 * c_nationkey AS lon FROM customer),
m AS (SELECT place, median(lat) AS clat, median(lon) AS clon FROM n GROUP BY 1),
k AS (SELECT place, 2 * 6371.0::DOUBLE * asin(sqrt(least(greatest(pow(sin((radians(lat) - radians(clat)) / 2), 2) + cos(radians(clat)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(clon)) / 2), 2), 0), 1))) AS km FROM n JOIN m USING (place))
SELECT place, count(*)::BIGINT AS support, round(quantile_cont(km, 0.5), 4) AS spread_p50, round(quantile_cont(km, 0.9), 4) AS spread_p90 FROM k GROUP BY 1""")
def context_centres(s, d):
    c = tables.read(s, d, "customer", "c_custkey", "c_nationkey")
    n = F.col("c_nationkey")
    rows = c.select(F.pmod(n, F.lit(5)).alias("place"), (-60.0 + 5 * n).alias("lat"), (-170.0 + 13 * n).alias("lon"))
    out = geography.context_centres(rows, "place", "lat", "lon")
    return out.select("place", "support", F.round("spread_p50", 4).alias("spread_p50"), F.round("spread_p90", 4).alias("spread_p90"))


@query("""SELECT n_nationkey, CASE WHEN la BETWEEN -90 AND 90 AND lo BETWEEN -180 AND 180 AND NOT (la = 0 AND lo = 0) THEN la END AS lat,
CASE WHEN la BETWEEN -90 AND 90 AND lo BETWEEN -180 AND 180 AND NOT (la = 0 AND lo = 0) THEN lo END AS lon
FROM (SELECT n_nationkey, (n_nationkey - 3) * 10.0::DOUBLE AS la, (n_nationkey - 3) * 15.0::DOUBLE AS lo FROM nation)""")
def coordinate_cleaning(s, d):
    n = tables.read(s, d, "nation", "n_nationkey")
    lat, lon = num.clean_coordinates((F.col("n_nationkey") - 3) * 10.0, (F.col("n_nationkey") - 3) * 15.0)
    return n.select("n_nationkey", lat.alias("lat"), lon.alias("lon"))


# ---------------------------------------------------------------- classes


_DIST = "dist AS (SELECT query_norm, micro, n, n / greatest(sum(n) OVER (PARTITION BY query_norm), 1)::DOUBLE AS p FROM (SELECT query_norm, micro, count(*) AS n FROM inter GROUP BY ALL))"


@query(i_(f", {_DIST} SELECT query_norm, micro, n::BIGINT AS n, round(p, 6) AS p FROM dist"))
def category_distribution(s, d):
    counts = fx.interactions(s, d).groupBy("query_norm", "micro").agg(F.count("*").alias("n"))
    return relational.shares(counts, "query_norm").withColumn("p", r6("p"))


@query(i_(f", {_DIST} SELECT query_norm, round(sum(-p * ln(greatest(p, 1e-12))) / ln(25), 6) AS entropy, round(max(p), 6) AS peak FROM dist GROUP BY 1"))
def category_entropy_peak(s, d):
    counts = fx.interactions(s, d).groupBy("query_norm", "micro").agg(F.count("*").alias("n"))
    out = relational.entropy_and_peak(relational.shares(counts, "query_norm"), "query_norm", 25)
    return out.select("query_norm", r6("entropy").alias("entropy"), r6("peak").alias("peak"))


@query(i_("""SELECT query_norm, micro, n::BIGINT AS n, round(n / t::DOUBLE, 6) AS share, round(n / t::DOUBLE * least(sqrt(t), 16), 6) AS weight FROM (
SELECT *, sum(n) OVER (PARTITION BY query_norm) AS t FROM (SELECT query_norm, micro, count(*) AS n FROM inter GROUP BY ALL))"""))
def soft_targets(s, d):
    out = learn.soft_targets(fx.interactions(s, d), "query_norm", "micro")
    return out.select("query_norm", "micro", "n", r6("share").alias("share"), r6("weight").alias("weight"))


@query(i_(f""", {_DIST}, m AS (SELECT query_norm, micro, CASE WHEN micro IN (SELECT micro FROM items WHERE p_retailprice > 1400) THEN p ELSE 0 END AS q FROM dist)
SELECT query_norm, micro, round(CASE WHEN sum(q) OVER w > 0 THEN q / sum(q) OVER w ELSE 0 END, 6) AS p FROM m WINDOW w AS (PARTITION BY query_norm)"""))
def class_masking(s, d):
    counts = fx.interactions(s, d).groupBy("query_norm", "micro").agg(F.count("*").alias("n"))
    p = relational.shares(counts, "query_norm")
    return learn.masked(p, "query_norm", fx.items(s, d).where("p_retailprice > 1400"), "micro").select("query_norm", "micro", r6("p").alias("p"))


@query(i_(f""", {_DIST}, r AS (SELECT *, rank() OVER (PARTITION BY query_norm ORDER BY round(p, 9) DESC) AS place FROM dist),
t AS (SELECT query_norm, max(p) AS peak, list_sort(list(p), 'DESC')[2] AS second FROM dist GROUP BY 1)
SELECT query_norm, micro, round(ln(greatest(p, 1e-8)), 6) AS log_p, round(ln(1 + place), 6) AS log_rank, round(peak, 6) AS peak, round(peak - coalesce(second, 0), 6) AS margin FROM r JOIN t USING (query_norm)"""))
def class_candidate_features(s, d):
    counts = fx.interactions(s, d).groupBy("query_norm", "micro").agg(F.count("*").alias("n"))
    p = relational.shares(counts, "query_norm").withColumn("key", F.round("p", 9))
    top = p.groupBy("query_norm").agg(F.sort_array(F.collect_list("p"), False).alias("ps"))
    ranked = p.withColumn("log_rank", pool.log_rank("query_norm", F.col("key"))).join(top, "query_norm")
    return ranked.select(
        "query_norm", "micro", r6(F.log(F.greatest("p", F.lit(1e-8)))).alias("log_p"), r6("log_rank").alias("log_rank"),
        r6(F.get("ps", 0)).alias("peak"), r6(F.get("ps", 0) - F.coalesce(F.get("ps", 1), F.lit(0.0))).alias("margin"),
    )


_TEXT_GRAMS = _GRAMS.replace("item_id", "query_norm")
_KNN_SQL = f""", titles AS (SELECT DISTINCT query_norm, query_norm AS norm FROM inter), {_TEXT_GRAMS},
t_tf AS (SELECT query_norm, term, count(*) AS tf FROM grams GROUP BY ALL),
t_idf AS (SELECT term, ln((1 + (SELECT count(*) FROM titles)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM t_tf GROUP BY term HAVING count(*) >= 2),
t_raw AS (SELECT query_norm, term, (1 + ln(tf)) * idf AS w FROM t_tf JOIN t_idf USING (term)),
t_w AS (SELECT query_norm, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_norm)) AS w FROM t_raw),
sims AS (SELECT a.query_norm AS query_norm, b.query_norm AS other, round(sum(a.w * b.w), 9) AS score FROM t_w a JOIN t_w b USING (term) WHERE a.query_norm <> b.query_norm GROUP BY ALL),
nearest AS (SELECT query_norm, other, pow(greatest(score - 0.2::DOUBLE, 0), 3) AS w FROM (SELECT *, row_number() OVER (PARTITION BY query_norm ORDER BY score DESC, other) AS place FROM sims) WHERE place <= 20),
moved AS (SELECT nearest.query_norm, micro, sum(w * p) AS v FROM nearest JOIN dist ON other = dist.query_norm GROUP BY ALL)
SELECT query_norm, micro, round(CASE WHEN max(v) OVER (PARTITION BY query_norm) > 0 THEN v / max(v) OVER (PARTITION BY query_norm) ELSE 1 END, 6) AS compatibility FROM moved"""


@query(i_(f", {_DIST}" + _KNN_SQL))
def category_transfer_knn(s, d):
    """Classes of a text from its 20 nearest other texts; a known text's own classes are category_distribution."""
    h = fx.interactions(s, d)
    dist = relational.shares(h.groupBy("query_norm", "micro").agg(F.count("*").alias("n")), "query_norm")
    texts = h.select("query_norm").distinct().select("query_norm", tx.char_grams(F.col("query_norm")).alias("grams"))
    w, _ = lexical.tfidf_vectors(texts, "query_norm", "grams", cap=None)
    sims = lexical.sparse_product(w, "query_norm", w.withColumnRenamed("query_norm", "other"), "other").where("query_norm <> other")
    near = pool.stable_topk(sims, CONFIG.neighbours, "query_norm", "other")
    weight = F.pow(F.greatest(F.col("score") - CONFIG.neighbour_least, F.lit(0.0)), 3)
    moved = near.select("query_norm", "other", weight.alias("w")).join(dist.select(F.col("query_norm").alias("other"), "micro", "p"), "other")
    v = moved.groupBy("query_norm", "micro").agg(F.sum(F.col("w") * F.col("p")).alias("v"))
    top = F.max("v").over(Window.partitionBy("query_norm"))
    return v.select("query_norm", "micro", r6(F.when(top > 0, F.col("v") / top).otherwise(1.0)).alias("compatibility"))


# ---------------------------------------------------------------- vectors

_VEC = """dots AS (SELECT q.vec_id AS query_id, e.vec_id AS vec_id, e.label, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score
FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM dots) WHERE place <= {k})"""


def _near(s, d, k, skip_self=False):
    e = tables.read(s, d, "embeddings", "vec_id", "embedding")
    q = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return vectors.exact_topk(e, "vec_id", q, "query_id", "embedding", k, skip_self)


@query(f"WITH {_VEC.format(k=10)} SELECT query_id, vec_id, round(score, 4) AS score, place::INT AS place FROM near")
def vector_topk_cosine(s, d):
    return _near(s, d, 10).select("query_id", "vec_id", F.round("score", 4).alias("score"), "place")


@query(f"WITH {_VEC.format(k=10)} SELECT query_id, vec_id, round(exp((score - 1) / 0.05::DOUBLE) * (0.03::DOUBLE + 0.97::DOUBLE * 0.5::DOUBLE), 4) AS affinity FROM near")
def vector_affinity(s, d):
    return _near(s, d, 10).select("query_id", "vec_id", F.round(num.affinity(F.col("score"), F.lit(0.5)), 4).alias("affinity"))


@query("SELECT label, (i - 1)::INT AS pos, round(avg(embedding[i]::DOUBLE), 5) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY ALL")
def vector_centroid_by_label(s, d):
    return vectors.centroids(tables.read(s, d, "embeddings", "label", "embedding"), "label", "embedding").withColumn("mean", F.round("mean", 5))


@query(f"""WITH {_VEC.format(k=24)} SELECT query_id, label, round(w / sum(w) OVER (PARTITION BY query_id), 4) AS share FROM (
SELECT query_id, label, sum(exp(score / 0.1::DOUBLE)) AS w FROM near GROUP BY ALL)""")
def neighbour_softmax_share(s, d):
    near = _near(s, d, 24).join(tables.read(s, d, "embeddings", "vec_id", "label"), "vec_id")
    return vectors.softmax_shares(near, "query_id", "label").withColumn("share", F.round("share", 4))


@query("SELECT text, count(*)::BIGINT AS n FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM documents) GROUP BY 1")
def texts_to_encode(s, d):
    """Distinct whole texts before encoding; each goes to the encoder once."""
    return tables.read(s, d, "benchmark", "text").unionByName(tables.read(s, d, "documents", "text")).groupBy("text").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- pool, features, scores

_CHANNELS = "," + bm25_sql("body", "body_terms") + "," + bm25_sql("titled", "title_terms").strip() + _CHAR_SQL


def _tops(name: str, k: int) -> str:
    return f"top_{name} AS (SELECT query_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS place FROM {name}) WHERE place <= {k})"


_POOL = _CHANNELS + ", " + ", ".join(_tops(n, 50) for n in ("body", "titled", "chars")) + """, pool AS (SELECT query_id, item_id,
max((ch = 'body')::INT) AS from_body, max((ch = 'title')::INT) AS from_title, max((ch = 'char')::INT) AS from_char FROM (
SELECT *, 'body' AS ch FROM top_body UNION ALL SELECT *, 'title' FROM top_titled UNION ALL SELECT *, 'char' FROM top_chars) GROUP BY ALL)"""


def _pool(s, d, k=50):
    flags = [F.max((F.col("channel") == n[0]).cast("int")).alias(f"from_{n}") for n in ("body", "title", "char")]
    return _best(s, d, k).groupBy("query_id", "item_id").agg(*flags)


@query(c_(_POOL + " SELECT query_id, item_id FROM pool"))
def candidate_pool_union(s, d):
    return _pool(s, d).select("query_id", "item_id")


@query(c_(_POOL + " SELECT query_id, item_id, from_body, from_title, from_char FROM pool"))
def pool_source_flags(s, d):
    return _pool(s, d)


@query(c_("," + bm25_sql("titled", "title_terms") + """, lowest AS (SELECT item_id FROM corpus ORDER BY item_id LIMIT 50),
filled AS (FROM titled UNION ALL SELECT query_id, l.item_id, 0 FROM queries, lowest l WHERE NOT exists(SELECT 1 FROM titled t WHERE t.query_id = queries.query_id AND t.item_id = l.item_id))
""" + _TOP.format("filled", 50)))
def zero_fill_topk(s, d):
    full = pool.zero_fill(_title(s, d), fx.queries(s, d), "query_id", fx.corpus(s, d), "item_id", 50)
    return _top(full, 50)


@query("""SELECT q AS query_id, l_partkey AS item_id, place::INT AS place FROM (SELECT l_suppkey AS q, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY sc DESC, l_partkey) AS place FROM (
SELECT l_suppkey, l_partkey, max(l_quantity) AS sc FROM lineitem GROUP BY ALL)) WHERE place <= 5""")
def stable_topk_ties(s, d):
    """Many equal scores: the lower item wins."""
    sc = tables.read(s, d, "lineitem", "l_suppkey", "l_partkey", "l_quantity").groupBy("l_suppkey", "l_partkey").agg(F.max("l_quantity").alias("score"))
    out = pool.stable_topk(sc, 5, "l_suppkey", "l_partkey")
    return out.select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("item_id"), "place")


@query(c_(_POOL + " SELECT query_id, item_id FROM top_body EXCEPT SELECT query_id, item_id FROM top_titled"))
def pool_set_difference(s, d):
    a, b = (pool.stable_topk(x, 50, "query_id", "item_id").select("query_id", "item_id") for x in (_body(s, d, 50), _title(s, d, 50)))
    return pool.difference(a, b, "query_id", "item_id")


_SCORED = _POOL + """, mb AS (SELECT query_id, item_id, score / max(score) OVER (PARTITION BY query_id) AS b FROM body),
mt AS (SELECT query_id, item_id, score / max(score) OVER (PARTITION BY query_id) AS t FROM titled),
mc AS (SELECT query_id, item_id, score / max(score) OVER (PARTITION BY query_id) AS c FROM chars),
scored AS (SELECT query_id, item_id, q.location AS ql, i.location AS il, coalesce(b, 0)::DOUBLE AS b, coalesce(t, 0)::DOUBLE AS t, coalesce(c, 0)::DOUBLE AS c,
  CASE WHEN q.location = i.location THEN 1::DOUBLE ELSE 0.7::DOUBLE * exp(-abs(q.location - i.location) * 10 / 40.0::DOUBLE) END AS geo
  FROM pool JOIN queries q USING (query_id) JOIN corpus i USING (item_id) LEFT JOIN mb USING (query_id, item_id) LEFT JOIN mt USING (query_id, item_id) LEFT JOIN mc USING (query_id, item_id)),
final AS (SELECT *, round((0.3::DOUBLE * t + 0.5::DOUBLE * b + 0.2::DOUBLE * c) * sqrt(0.03::DOUBLE + 0.97::DOUBLE * geo), 9) AS baseline,
  round((0.5::DOUBLE * t + 0.3::DOUBLE * b + 0.2::DOUBLE * c) * (0.03::DOUBLE + 0.97::DOUBLE * geo), 9) AS mixed FROM scored)"""


def scored_pool(s, d, k=50):
    """Pool with the three normalised scores, places and the two combined scores; places lie 10 km apart on a line."""
    names = ("b", "t", "c")
    best = tables.staged(_best(s, d, k).where(F.col("score") > 0), "best")
    pairs = lexical.channel_scores(_channels(s, d), "item_id", "query_id", best)
    side = lambda n, c, f: F.coalesce(f(F.when(F.col("channel") == n, F.col(c))), F.lit(0.0))
    tops = best.groupBy("query_id").agg(*[side(n, "score", F.max).alias(f"top_{n}") for n in names])
    out = pairs.groupBy("query_id", "item_id").agg(*[side(n, "score", F.max).alias(n) for n in names]).join(tops, "query_id")
    for n in names:
        out = out.withColumn(n, F.when(F.col(f"top_{n}") > 0, F.col(n) / F.col(f"top_{n}")).otherwise(0.0)).drop(f"top_{n}")
    out = out.join(fx.queries(s, d).select("query_id", F.col("location").alias("ql")), "query_id").join(fx.corpus(s, d).select("item_id", F.col("location").alias("il")), "item_id")
    geo = F.when(F.col("ql") == F.col("il"), 1.0).otherwise(CONFIG.geo_weight * F.exp(-F.abs(F.col("ql") - F.col("il")) * 10 / CONFIG.geo_km))
    out = out.withColumn("geo", geo)
    one = F.lit(1.0)
    args = [F.col("t"), F.col("b"), F.col("c")]
    return out.withColumn("baseline", F.round(num.baseline_score(*args, F.lit(0.0), F.col("geo"), one), 9)).withColumn("mixed", F.round(num.mixed_score(*args, F.col("geo"), one), 9))


def _ranked(scores, column, k):
    return pool.stable_topk(scores.withColumn("score", F.col(column)), k, "query_id", "item_id")


@query(c_(_SCORED + _TOP.format("(SELECT query_id, item_id, baseline AS score FROM final)", 50).replace("SELECT query_id", " SELECT query_id", 1)))
def baseline_score_top50(s, d):
    return _ranked(scored_pool(s, d), "baseline", 50).select("query_id", "item_id", "score", "place")


@query(c_(_SCORED + " SELECT query_id, item_id, mixed FROM final"))
def mixed_channel_score(s, d):
    return scored_pool(s, d).select("query_id", "item_id", "mixed")


@query(c_(_SCORED + """ SELECT query_id, item_id, round(ln(1 + rank() OVER (PARTITION BY query_id ORDER BY baseline DESC)), 6) AS log_baseline_rank,
round(ln(1 + rank() OVER (PARTITION BY query_id ORDER BY round(b, 9) DESC)), 6) AS log_body_rank, (ql = il)::INT::DOUBLE AS same_location FROM final"""))
def rank_features_log(s, d):
    p = scored_pool(s, d).withColumn("b", F.round("b", 9))
    out = ft.rank_block(p, "query_id", {"baseline": "baseline", "body": "b"})
    return out.select("query_id", "item_id", r6("log_baseline_rank").alias("log_baseline_rank"), r6("log_body_rank").alias("log_body_rank"), (F.col("ql") == F.col("il")).cast("double").alias("same_location"))


@query(c_(_SCORED + f""" SELECT query_id, item_id, contains({fold_sql('title')}, {fold_sql('query_text')})::INT::DOUBLE AS query_in_title, ({fold_sql('title')} = {fold_sql('query_text')})::INT::DOUBLE AS query_equals_title,
length({fold_sql('query_text')})::INT AS query_characters, round(ln(1 + n_chars), 6) AS log_price, round(ln(1 + length(title)), 6) AS log_title_characters FROM final JOIN queries USING (query_id) JOIN corpus USING (item_id)"""))
def text_and_item_features(s, d):
    q, found = fx.queries(s, d), tables.staged(_pool(s, d).select("query_id", "item_id"), "pool")
    c = tables.staged(fx.corpus(s, d).select("item_id", "title", "n_chars").join(found.select("item_id").distinct(), "item_id", "left_semi"), "pool-items")
    pairs = found.join(q.select("query_id", tx.folded(F.col("query_text")).alias("q")), "query_id").join(c.select("item_id", tx.folded(F.col("title")).alias("t")), "item_id")
    out = ft.text_block(pairs, "q", "t").join(ft.item_block(c, "item_id", "n_chars", {"title": "title"}), "item_id")
    return out.select("query_id", "item_id", "query_in_title", "query_equals_title", "query_characters", r6("log_price").alias("log_price"), r6("log_title_characters").alias("log_title_characters"))


@query(c_("," + bm25_sql("body", "body_terms") + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS place FROM body),
p AS (SELECT query_id, max(score) AS top, max(CASE WHEN place = 50 THEN score END) AS nth, avg(score) FILTER (place <= 512) AS mean, stddev_pop(score) FILTER (place <= 512) AS dev FROM r GROUP BY 1)
SELECT query_id, item_id, round(top - score, 9) AS gap_first, round(score - nth, 9) AS gap_nth, CASE WHEN dev > 1e-9 THEN round((score - mean) / dev, 5) END AS standard, place::INT AS place FROM r JOIN p USING (query_id)"""))
def score_relative_features(s, d):
    out = pool.relative_scores(_body(s, d), "query_id", "item_id", best=_body(s, d, 512))
    return out.select("query_id", "item_id", F.round("gap_first", 9).alias("gap_first"), F.round("gap_nth", 9).alias("gap_nth"), F.round("standard", 5).alias("standard"), "place")


@query(i_(f""", {_DIST} SELECT query_norm, round(ln(1 + sum(n)), 6) AS log_pairs, round(sum(-p * ln(greatest(p, 1e-12))) / ln(25), 6) AS entropy, round(max(p), 6) AS peak FROM dist GROUP BY 1"""))
def history_features(s, d):
    out = ft.history_block(fx.interactions(s, d), "query_norm", "micro", 25)
    return out.select("query_norm", *[r6(c).alias(c) for c in ("log_pairs", "entropy", "peak")])


@query(i_(""" SELECT item_id, round(ln(1 + count(*)), 6) AS log_count, round(ln(1 + count(DISTINCT query_norm)), 6) AS log_texts, round(ln(1 + count(DISTINCT search_location)), 6) AS log_places FROM inter GROUP BY 1"""))
def item_history_features(s, d):
    out = ft.item_history_block(fx.interactions(s, d), "item_id", "query_norm", "search_location")
    return out.select("item_id", *[r6(c).alias(c) for c in ("log_count", "log_texts", "log_places")])


@query(i_(""", b AS (SELECT micro, item_location, count(*) AS n FROM inter GROUP BY ALL)
SELECT micro, item_location, round(ln(1 + n), 6) AS log_class_place, round(ln(1 + sum(n) OVER (PARTITION BY item_location)), 6) AS log_place, round(n / sum(n) OVER (PARTITION BY micro)::DOUBLE, 6) AS place_share FROM b"""))
def service_location_frequency(s, d):
    out = ft.service_location_block(fx.interactions(s, d), "micro", "item_location")
    return out.select("micro", "item_location", *[r6(c).alias(c) for c in ("log_class_place", "log_place", "place_share")])


# ---------------------------------------------------------------- fusion


def _rrf(parts: list[tuple[str, float]]) -> str:
    return " + ".join(f"{w}::DOUBLE / (60 + rank() OVER (PARTITION BY query_id ORDER BY {c} DESC))" for c, w in parts)


@query(c_(_SCORED + f" SELECT query_id, item_id, round({_rrf([('baseline', 0.5), ('mixed', 0.5)])}, 9) AS fused FROM final"))
def rrf_two_way(s, d):
    return fusion.fuse(scored_pool(s, d), "query_id", {"baseline": 0.5, "mixed": 0.5}).select("query_id", "item_id", F.round("fused", 9).alias("fused"))


@query(c_(_SCORED + f""", one AS (SELECT *, round({_rrf([('mixed', 0.5), ('baseline', 0.5)])}, 12) AS f1 FROM final)
SELECT query_id, item_id, round({_rrf([('round(b, 9)', 0.25), ('f1', 0.75)])}, 9) AS fused FROM one"""))
def rrf_nested(s, d):
    p = scored_pool(s, d).withColumn("b", F.round("b", 9))
    one = fusion.fuse(p, "query_id", {"mixed": 0.5, "baseline": 0.5}, "f1").withColumn("f1", F.round("f1", 12))
    return fusion.fuse(one, "query_id", {"b": 0.25, "f1": 0.75}).select("query_id", "item_id", F.round("fused", 9).alias("fused"))


@query(c_(_SCORED + f" SELECT query_id, item_id, round({_rrf([('baseline', 0.4), ('mixed', 0.2), ('round(b, 9)', 0.2), ('round(c, 9)', 0.2)])}, 9) AS fused FROM final"))
def rrf_kway(s, d):
    p = scored_pool(s, d).withColumn("b", F.round("b", 9)).withColumn("c", F.round("c", 9))
    return fusion.fuse(p, "query_id", {"baseline": 0.4, "mixed": 0.2, "b": 0.2, "c": 0.2}).select("query_id", "item_id", F.round("fused", 9).alias("fused"))


# ---------------------------------------------------------------- history regimes


def _hash_sql(key: str) -> str:
    return f"sha256('{SEED}:' || ({key})::VARCHAR)"


def _fold_sql(key: str) -> str:
    return i_(f" SELECT {key}, ((row_number() OVER (ORDER BY {_hash_sql(key)}, {key}) - 1) % 3)::INT AS fold FROM (SELECT DISTINCT {key} FROM inter)")


@query(_fold_sql("query_norm"))
def oof_folds_by_text(s, d):
    return history.folds(fx.interactions(s, d), "query_norm", 3, SEED)


@query(_fold_sql("context_key"))
def oof_folds_by_context(s, d):
    return history.folds(fx.interactions(s, d), "context_key", 3, SEED)


@query(i_(f" SELECT item_id, CASE WHEN (row_number() OVER (ORDER BY {_hash_sql('item_id')}, item_id) - 1) % 2 = 0 THEN 'development' ELSE 'holdout' END AS side FROM items"))
def development_holdout(s, d):
    return history.halves(fx.items(s, d), "item_id", SEED).select("item_id", "side")


_HELD = f"held AS (SELECT query_norm, context_key FROM inter WHERE l_quantity >= 50 AND query_norm IN (SELECT query_norm FROM (SELECT DISTINCT query_norm FROM inter) ORDER BY {_hash_sql('query_norm')}, query_norm LIMIT 16))"


def _held(h):
    """Rows that are asked: those of a large quantity among 16 texts in seeded order."""
    return relational.within(h.where("l_quantity >= 50"), history.choose(h, "query_norm", 16, SEED), "query_norm")


@query(i_(f", {_HELD} SELECT context_key, item_id, micro FROM inter WHERE query_norm NOT IN (SELECT query_norm FROM held)"))
def history_unseen_text(s, d):
    h = fx.interactions(s, d)
    return history.for_queries(h, _held(h), "unseen_text", "query_norm", "context_key", "item_id").select("context_key", "item_id", "micro")


@query(i_(f", {_HELD} SELECT context_key, item_id, micro FROM inter WHERE context_key NOT IN (SELECT context_key FROM held)"))
def history_held_context(s, d):
    h = fx.interactions(s, d)
    return history.for_queries(h, _held(h), "held_context", "query_norm", "context_key", "item_id").select("context_key", "item_id", "micro")


_GOLD = "gold AS (SELECT DISTINCT context_key, item_id FROM inter WHERE item_id IN (SELECT item_id FROM items))"


@query(i_(f""", {_HELD}, {_GOLD}, fit AS (SELECT * FROM inter WHERE context_key NOT IN (SELECT context_key FROM held)),
k AS (SELECT avg((query_norm IN (SELECT query_norm FROM fit))::INT) AS known_texts FROM (SELECT DISTINCT context_key, query_norm FROM held)),
p AS (SELECT avg(s) AS positives_seen FROM (SELECT context_key, avg((item_id IN (SELECT item_id FROM fit))::INT) AS s FROM gold WHERE context_key IN (SELECT context_key FROM held) GROUP BY 1))
SELECT round(known_texts, 6) AS known_texts, round(positives_seen, 6) AS positives_seen, (SELECT count(*) FROM (SELECT DISTINCT context_key FROM held) WHERE context_key IN (SELECT context_key FROM fit)) AS own_contexts FROM k, p"""))
def history_coverage(s, d):
    h = fx.interactions(s, d)
    q = _held(h).select("query_norm", "context_key").distinct()
    fit = history.for_queries(h, q, "held_context", "query_norm", "context_key", "item_id")
    g = history.gold(h, "context_key", "item_id", fx.items(s, d))
    out = history.coverage(q, fit, g, "query_norm", "context_key", "item_id")
    return out.select(r6("known_texts").alias("known_texts"), r6("positives_seen").alias("positives_seen"), "own_contexts")


@query(i_(f" SELECT item_id FROM items WHERE ('0x' || substring({_hash_sql('item_id')}, 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.9"))
def cold_item_fraction(s, d):
    return history.cold_items(fx.items(s, d), "item_id", 0.9, SEED)


@query(i_(f", {_GOLD} SELECT context_key, list_sort(list(item_id)) AS items, len(list(item_id))::INT AS n FROM gold GROUP BY 1"))
def gold_sets(s, d):
    g = history.gold(fx.interactions(s, d), "context_key", "item_id", fx.items(s, d))
    return g.select("context_key", "items", F.size("items").alias("n"))


@query(i_(f""", chosen AS (SELECT query_norm FROM (SELECT DISTINCT query_norm FROM inter) ORDER BY {_hash_sql('query_norm')}, query_norm LIMIT 20)
SELECT query_norm, context_key FROM (SELECT *, row_number() OVER (PARTITION BY query_norm ORDER BY {_hash_sql('context_key')}, context_key) AS k FROM (SELECT DISTINCT query_norm, context_key FROM inter WHERE query_norm IN (FROM chosen))) WHERE k = 1"""))
def select_contexts(s, d):
    return history.select_contexts(fx.interactions(s, d), "query_norm", "context_key", 20, SEED)


@query(i_(f""" SELECT query_norm, context_key FROM (SELECT *, row_number() OVER (PARTITION BY query_norm ORDER BY {_hash_sql('context_key')}, context_key) AS k FROM (SELECT DISTINCT query_norm, context_key FROM inter)) WHERE k <= 4"""))
def first_n_per_text(s, d):
    p = fx.interactions(s, d).select("query_norm", "context_key").distinct()
    return relational.first_by(p, ["query_norm"], [tx.hashed(SEED, "context_key"), F.col("context_key")], 4)


_NEG = "," + bm25_sql("body", "body_terms") + f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS place FROM body),
marked AS (SELECT r.query_id, r.item_id, place, (t.item_id IS NOT NULL)::INT AS y FROM ranked r LEFT JOIN truth t ON r.query_id = t.query_id AND r.item_id = t.item_id),
wrong AS (SELECT *, CASE WHEN y = 0 THEN row_number() OVER (PARTITION BY query_id, y ORDER BY place, item_id) END AS nth FROM marked),
tailed AS (SELECT *, row_number() OVER (PARTITION BY query_id, nth > 20 ORDER BY {_hash_sql("query_id::VARCHAR || '/' || item_id::VARCHAR")}, item_id) AS t FROM wrong),
sample AS (SELECT query_id, item_id, y, CASE WHEN y = 1 THEN 'positive' WHEN nth <= 20 THEN 'hard' WHEN t <= 10 THEN 'tail' END AS kind FROM tailed WHERE y = 1 OR nth <= 20 OR t <= 10)"""


def _sample(s, d):
    index, words = fx.bm25_index(s, d, "body"), _words(fx.query_terms(s, d))

    def scores(k=None, pairs=None, queries=None):
        if pairs is not None:
            return asked.pair_scores(index, "item_id", words, "query_id", pairs, lexical.SCORE_DIGITS)
        some = words if queries is None else words.join(queries, "query_id", "left_semi")
        return asked.scores(index, "item_id", some, "query_id", lexical.SCORE_DIGITS, k)

    marked = history.sample_candidates(scores, "query_id", "item_id", fx.truth(s, d), 20, 10, SEED)
    return history.group_sample(marked, "query_id", "item_id", {"score": 20}, 10, SEED)


@query(c_(_NEG + " SELECT query_id, item_id, y, kind FROM sample"))
def hard_negative_sample(s, d):
    return _sample(s, d).select("query_id", "item_id", "y", "kind")


@query(c_(_NEG + """, w AS (SELECT query_id, item_id, 100.0::DOUBLE / count(*) OVER (PARTITION BY query_id, y) AS w FROM sample)
SELECT query_id, item_id, round(w / (SELECT avg(w) FROM w), 6) AS weight FROM w"""))
def query_equal_weights(s, d):
    return history.query_weights(_sample(s, d), "query_id").select("query_id", "item_id", r6("weight").alias("weight"))


@query(i_(f""", {_HELD}, g AS (SELECT DISTINCT context_key, query_norm IN (SELECT query_norm FROM inter WHERE search_location = 0 AND l_quantity < 2) AS known FROM held)
SELECT context_key, known, round(CASE WHEN known THEN 0.3736::DOUBLE / o ELSE (1 - 0.3736::DOUBLE) / (1 - o) END, 6) AS weight FROM g, (SELECT avg(known::INT) AS o FROM g)"""))
def regime_weights(s, d):
    h = fx.interactions(s, d)
    q = _held(h).select("query_norm", "context_key").distinct()
    known = history.known_texts(q, h.where("search_location = 0 AND l_quantity < 2"), "query_norm")
    return history.regime_weights(known, 0.3736).select("context_key", "known", r6("weight").alias("weight"))


# ---------------------------------------------------------------- evaluation

_RANKED = "," + bm25_sql("body", "body_terms") + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS place FROM body),
joined AS (SELECT t.query_id, t.item_id, place FROM truth t LEFT JOIN ranked r ON r.query_id = t.query_id AND r.item_id = t.item_id)"""


def _answer(s, d, k):
    return pool.stable_topk(_body(s, d, k), k, "query_id", "item_id")


@query(c_(_RANKED + """ SELECT k::INT AS k, round(avg(r), 6) AS recall FROM (SELECT query_id, k, avg(coalesce((place <= k)::INT, 0)) AS r FROM joined, (SELECT unnest([1, 5, 10, 20, 50, 100, 300]) AS k) GROUP BY ALL) GROUP BY k"""))
def recall_at_k_curve(s, d):
    out = ev.recall_curve(_answer(s, d, 300), fx.truth(s, d), "query_id", "item_id", [1, 5, 10, 20, 50, 100, 300])
    return out.withColumn("recall", r6("recall"))


@query(c_(_RANKED + " SELECT query_id, count(*)::BIGINT AS n, round(avg(coalesce((place <= 5)::INT, 0)), 6) AS recall FROM joined GROUP BY 1"))
def per_query_recall(s, d):
    return ev.recall(_answer(s, d, 5), fx.truth(s, d), "query_id", "item_id").withColumn("recall", r6("recall"))


@query(c_(_RANKED + " SELECT round(avg(r), 6) AS recall FROM (SELECT query_id, avg(coalesce((place <= 5)::INT, 0)) AS r FROM joined GROUP BY 1)"))
def macro_recall(s, d):
    return ev.recall(_answer(s, d, 5), fx.truth(s, d), "query_id", "item_id").agg(r6(F.avg("recall")).alias("recall"))


@query(c_(_POOL + " SELECT round(avg(r), 6) AS recall FROM (SELECT t.query_id, avg((p.item_id IS NOT NULL)::INT) AS r FROM truth t LEFT JOIN pool p ON p.query_id = t.query_id AND p.item_id = t.item_id GROUP BY 1)"))
def pool_recall(s, d):
    return ev.recall(_pool(s, d), fx.truth(s, d), "query_id", "item_id").agg(r6(F.avg("recall")).alias("recall"))


@query(c_(_RANKED + """, per AS (SELECT query_id, avg(coalesce((place <= 5)::INT, 0)) AS recall FROM joined GROUP BY 1),
st AS (SELECT query_id, recall, location < 12 AS near FROM per JOIN queries USING (query_id)),
want AS (SELECT location < 12 AS near, count(*) AS want FROM queries WHERE (location < 12) IN (SELECT near FROM st) GROUP BY 1),
have AS (SELECT near, count(*) AS have, sum(recall) AS r FROM st GROUP BY 1),
w AS (SELECT *, (want / (SELECT sum(want) FROM want)) / (have / (SELECT count(*) FROM st)::DOUBLE) AS w FROM want JOIN have USING (near))
SELECT round(sum(w * r) / sum(w * have), 6) AS recall, round(pow(sum(w * have), 2) / sum(w * w * have), 6) AS effective FROM w"""))
def matched_recall(s, d):
    near = (F.col("location") < 12).alias("near")
    q = fx.queries(s, d).select("query_id", near)
    per = ev.recall(_answer(s, d, 5), fx.truth(s, d), "query_id", "item_id").join(q, "query_id")
    target = q.join(per.select("near").distinct(), "near", "left_semi")
    out = ev.matched_recall(per, target, ["near"])
    return out.select(r6("recall").alias("recall"), r6("effective").alias("effective"))


@query(c_(_POOL + """, a AS (SELECT query_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS place FROM titled) WHERE place <= 5)
SELECT CASE WHEN a.item_id IS NOT NULL THEN 'found' WHEN p.item_id IS NOT NULL THEN 'lost at selection' ELSE 'lost before pool' END AS stage, count(*)::BIGINT AS n
FROM truth t LEFT JOIN pool p ON p.query_id = t.query_id AND p.item_id = t.item_id LEFT JOIN a ON a.query_id = t.query_id AND a.item_id = t.item_id GROUP BY 1"""))
def loss_attribution(s, d):
    return ev.attribution(fx.truth(s, d), _pool(s, d), pool.stable_topk(_title(s, d, 5), 5, "query_id", "item_id"), "query_id", "item_id")


@query(c_(_RANKED + """ SELECT q.location = i.location AS same_location, count(*)::BIGINT AS n, round(avg(coalesce((place <= 5)::INT, 0)), 6) AS found FROM joined JOIN queries q USING (query_id) JOIN corpus i USING (item_id) GROUP BY 1"""))
def recall_by_flag(s, d):
    t = fx.truth(s, d).join(fx.queries(s, d).select("query_id", F.col("location").alias("ql")), "query_id").join(fx.corpus(s, d).select("item_id", F.col("location").alias("il")), "item_id")
    hit = t.join(_answer(s, d, 5).select("query_id", "item_id", F.lit(1.0).alias("hit")), ["query_id", "item_id"], "left")
    return hit.groupBy((F.col("ql") == F.col("il")).alias("same_location")).agg(F.count("*").alias("n"), r6(F.avg(F.coalesce("hit", F.lit(0.0)))).alias("found"))


@query(c_(_RANKED + " SELECT query_id, string_agg(item_id::VARCHAR, ' ' ORDER BY place) AS answer FROM ranked WHERE place <= 50 GROUP BY 1"))
def answer_rows(s, d):
    return ev.answers(_answer(s, d, 50), "query_id", "item_id")


@query(c_(_RANKED + """, good AS (SELECT query_id, string_agg(item_id::VARCHAR, ' ' ORDER BY place) AS answer FROM ranked WHERE place <= 50 GROUP BY 1),
bad AS (SELECT query_id, CASE query_id % 7 WHEN 2 THEN answer || ' ' || split_part(answer, ' ', 1) WHEN 3 THEN NULL WHEN 4 THEN 'x9 ' || answer ELSE answer END AS answer FROM good WHERE query_id % 7 <> 0
  UNION ALL SELECT query_id, answer FROM good WHERE query_id % 7 = 1 UNION ALL SELECT query_id + 1000000, answer FROM good WHERE query_id % 7 = 5),
ids AS (SELECT query_id, unnest(string_split(answer, ' ')) AS id FROM bad)
SELECT (SELECT count(*) - count(DISTINCT query_id) FROM bad) AS repeated_queries, (SELECT count(*) FROM bad WHERE answer IS NULL) AS nulls, (SELECT count(*) FROM bad WHERE len(string_split(answer, ' ')) > 50) AS too_many,
(SELECT count(*) FROM bad WHERE len(string_split(answer, ' ')) <> len(list_distinct(string_split(answer, ' ')))) AS repeated_ids, (SELECT count(*) FROM ids WHERE id NOT IN (SELECT item_id::VARCHAR FROM corpus)) AS unknown,
(SELECT count(*) FROM queries WHERE query_id NOT IN (SELECT query_id FROM bad)) AS missing_queries, (SELECT count(*) FROM bad WHERE query_id NOT IN (SELECT query_id FROM queries)) AS foreign_queries"""))
def answer_validation(s, d):
    """Counts of violations among answers into which every kind has been planted."""
    good = ev.answers(_answer(s, d, 50), "query_id", "item_id")
    kind = F.pmod("query_id", F.lit(7))
    broken = F.when(kind == 2, F.concat("answer", F.lit(" "), F.split_part("answer", F.lit(" "), F.lit(1)))).when(kind == 3, F.lit(None)).when(kind == 4, F.concat(F.lit("x9 "), "answer")).otherwise(F.col("answer"))
    bad = good.where(kind != 0).select("query_id", broken.alias("answer")).unionByName(good.where(kind == 1)).unionByName(good.where(kind == 5).withColumn("query_id", F.col("query_id") + 1000000))
    return ev.validate(bad, fx.queries(s, d), fx.corpus(s, d), "query_id", "item_id", 50)


@query(c_(_POOL + " SELECT round((SELECT count(*) FROM (SELECT * FROM top_body INTERSECT SELECT * FROM top_titled)) / (SELECT count(DISTINCT query_id) FROM top_body)::DOUBLE, 6) AS mean_common"))
def answer_overlap(s, d):
    a, b = (pool.stable_topk(x, 50, "query_id", "item_id").select("query_id", "item_id") for x in (_body(s, d, 50), _title(s, d, 50)))
    return ev.overlap(a, b, "query_id", "item_id").select(r6("mean_common").alias("mean_common"))


_GRID = [(t, b, 1 - t - b) for t, b in ((0.3, 0.5), (0.5, 0.3), (0.2, 0.2))]
_GRID_SQL = ", ".join(f"({k}, {t}::DOUBLE, {b}::DOUBLE, {round(c, 2)}::DOUBLE)" for k, (t, b, c) in enumerate(_GRID))


@query(c_(_SCORED + f""", g(config, wt, wb, wc) AS (VALUES {_GRID_SQL}),
r AS (SELECT config, query_id, item_id, row_number() OVER (PARTITION BY config, query_id ORDER BY round(wt * t + wb * b + wc * c, 9) DESC, item_id) AS place FROM final, g)
SELECT config::INT AS config, round(avg(x), 6) AS recall FROM (SELECT config, query_id, avg(f) AS x FROM (SELECT g.config, tr.query_id, coalesce((r.place <= 5)::INT, 0) AS f FROM truth tr CROSS JOIN g
LEFT JOIN r ON r.config = g.config AND r.query_id = tr.query_id AND r.item_id = tr.item_id) GROUP BY ALL) GROUP BY config"""))
def weight_grid_search(s, d):
    """All settings over one set of cached features."""
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("config"), F.lit(t).alias("wt"), F.lit(b).alias("wb"), F.lit(round(c, 2)).alias("wc")) for k, (t, b, c) in enumerate(_GRID)]))
    rows = scored_pool(s, d).withColumn("g", grid).select("query_id", "item_id", "g.config", F.round(F.col("g.wt") * F.col("t") + F.col("g.wb") * F.col("b") + F.col("g.wc") * F.col("c"), 9).alias("score"))
    place = F.row_number().over(Window.partitionBy("config", "query_id").orderBy(F.desc("score"), "item_id"))
    best = rows.withColumn("place", place).where("place <= 5")
    want = fx.truth(s, d).withColumn("config", F.explode(F.array(*[F.lit(k) for k in range(len(_GRID))])))
    hit = want.join(best.select("config", "query_id", "item_id", F.lit(1.0).alias("hit")), ["config", "query_id", "item_id"], "left")
    per = hit.groupBy("config", "query_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("r"))
    return per.groupBy("config").agg(r6(F.avg("r")).alias("recall"))


@query("""SELECT p_brand AS name, round(avg(p_retailprice), 6) AS matched, round(avg(p_size), 6) AS unseen FROM part GROUP BY 1 HAVING avg(p_size) >= (SELECT avg(p_size) FROM part) - 0.5 ORDER BY round(avg(p_retailprice), 6) DESC, name LIMIT 1""")
def admissible_best(s, d):
    p = tables.read(s, d, "part", "p_brand", "p_retailprice", "p_size")
    configs = p.groupBy(F.col("p_brand").alias("name")).agg(r6(F.avg("p_retailprice")).alias("matched"), F.avg("p_size").alias("unseen")).crossJoin(p.agg(F.avg("p_size").alias("base")))
    return ev.admissible_best(configs, F.col("base"), 0.5).select("name", "matched", r6("unseen").alias("unseen"))


@query(c_("," + bm25_sql("body", "body_terms") + "," + bm25_sql("titled", "title_terms") + """, bt AS (SELECT t.query_id, avg(coalesce((place <= 5)::INT, 0)) AS r FROM truth t LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS place FROM body) x ON x.query_id = t.query_id AND x.item_id = t.item_id GROUP BY 1),
tt AS (SELECT t.query_id, avg(coalesce((place <= 5)::INT, 0)) AS r FROM truth t LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS place FROM titled) x ON x.query_id = t.query_id AND x.item_id = t.item_id GROUP BY 1)
SELECT count(*) FILTER (bt.r > tt.r) AS improved, count(*) FILTER (bt.r < tt.r) AS worsened FROM bt JOIN tt USING (query_id)"""))
def improved_worsened(s, d):
    return ev.changes(_deltas(s, d))


def _deltas(s, d):
    t = fx.truth(s, d)
    a = ev.recall(_answer(s, d, 5), t, "query_id", "item_id").select("query_id", F.col("recall").alias("a"))
    b = ev.recall(pool.stable_topk(_title(s, d, 5), 5, "query_id", "item_id"), t, "query_id", "item_id").select("query_id", F.col("recall").alias("b"))
    return a.join(b, "query_id").select("query_id", (F.col("a") - F.col("b")).alias("delta"))


_DELTAS = """, bt AS (SELECT t.query_id, avg(coalesce((place <= 5)::INT, 0)) AS r FROM truth t LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS place FROM body) x ON x.query_id = t.query_id AND x.item_id = t.item_id GROUP BY 1),
tt AS (SELECT t.query_id, avg(coalesce((place <= 5)::INT, 0)) AS r FROM truth t LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS place FROM titled) x ON x.query_id = t.query_id AND x.item_id = t.item_id GROUP BY 1),
deltas AS (SELECT query_id, bt.r - tt.r AS delta FROM bt JOIN tt USING (query_id))"""
_DRAWS = 2000
_POISSON = " + ".join(f"(u >= {x!r}::DOUBLE)::INT" for x in ev.POISSON)


@query(c_("," + bm25_sql("body", "body_terms") + "," + bm25_sql("titled", "title_terms").strip() + _DELTAS + f""", drawn AS (SELECT draw, delta, {_POISSON} AS w FROM (
  SELECT draw, delta, ('0x' || substring(sha256('{SEED}:' || draw::VARCHAR || ':' || query_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM deltas, generate_series(1, {_DRAWS}) g(draw))),
means AS (SELECT draw, sum(delta * w) / greatest(sum(w), 1) AS mean FROM drawn GROUP BY 1)
SELECT round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high, count(*)::BIGINT AS draws FROM means"""))
def bootstrap_ci(s, d):
    out = ev.bootstrap(_deltas(s, d), "query_id", _DRAWS, SEED)
    return out.select(r6("low").alias("low"), r6("high").alias("high"), "draws")


@query(c_(_RANKED + " SELECT count(*)::BIGINT AS n, sum(('0x' || substring(sha256(item_id::VARCHAR || chr(31) || place::VARCHAR || chr(31) || query_id::VARCHAR), 1, 15))::BIGINT)::VARCHAR AS digest FROM ranked WHERE place <= 50"))
def table_digest(s, d):
    """Repeatability: an order-free digest of a result."""
    return tables.digest(_answer(s, d, 50).select("query_id", "item_id", "place"))


@query("SELECT count(*)::BIGINT AS n_rows, 1::BIGINT AS n_files FROM lineitem")
def footer_profile(s, d):
    """Rows and files of a table as its footers have them (its SQL holds for a table of one file); tests hold bytes and row groups."""
    return tables.footer_profile(tables.footers(s, f"{d}/lineitem.parquet")).select("n_rows", "n_files")


_COUNTED = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*)::BIGINT AS n_values, (count(*) - count({c}))::BIGINT AS n_nulls FROM orders" for c in _COUNTED))
def column_footers(s, d):
    """Values and nulls of each column, from footers alone."""
    found = tables.column_profile(tables.footers(s, f"{d}/orders.parquet"), 1 << 20)
    return found.where(F.col("column").isin(*_COUNTED)).select("column", "n_values", "n_nulls")


@query()
def largest_columns(s, d):
    """The six largest columns of the documents table by bytes before compression."""
    return tables.column_profile(tables.footers(s, f"{d}/documents.parquet"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) - 1 AS row_id FROM lineitem")
def dense_row_numbers(s, d):
    """All order lines numbered in the order of price, without a window over all of them."""
    rows = tables.read(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    return relational.numbered(rows, [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "row_id")


# ---------------------------------------------------------------- learners


FEATURES = ["b", "t", "c", "geo", "baseline", "mixed", "log_baseline_rank", "log_mixed_rank"]


@query()
def gbt_pointwise(s, d):
    """A boosted pointwise ranker over the pool on query-equal weights; every query is scored by a model that never saw it."""
    rows = ft.rank_block(scored_pool(s, d), "query_id", {"baseline": "baseline", "mixed": "mixed"}).join(fx.truth(s, d).withColumn("y", F.lit(1)), ["query_id", "item_id"], "left").na.fill(0, ["y"])
    rows = rows.join(history.folds(fx.queries(s, d), "query_id", 2, SEED), "query_id")
    rows = tables.staged(history.query_weights(rows, "query_id"), "sample")
    scored = [learn.score(learn.fit_ranker(rows.where(F.col("fold") != k), FEATURES), rows.where(F.col("fold") == k)) for k in range(2)]
    out = scored[0].unionByName(scored[1]).withColumn("score", F.round("score", 9))
    return pool.stable_topk(out, CONFIG.answer_size, "query_id", "item_id").select("query_id", "item_id", "score", "place")


@query(c_(_SCORED + f""", f AS (SELECT query_id, item_id, round({_rrf([('baseline', 0.5), ('mixed', 0.5)])}, 12) AS score FROM final) """ + _TOP.format("f", 50)))
def flagship(s, d):
    """Hybrid retrieval: BM25 on two fields, character TF-IDF, place damping, pool, fusion, top 50."""
    fused = fusion.fuse(scored_pool(s, d), "query_id", {"baseline": 0.5, "mixed": 0.5}, "score").withColumn("score", F.round("score", 12))
    return pool.stable_topk(fused, CONFIG.answer_size, "query_id", "item_id").select("query_id", "item_id", "score", "place")
