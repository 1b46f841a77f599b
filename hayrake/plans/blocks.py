"""Feature blocks of places and stated attributes over the hybrid pool, and all blocks in one frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import haversine
from ..operators import features, geography, pool, relational, vectors
from ..sources.tables import sorted_side
from . import hybrid
from .catalog import _SQL, query, r6
from .fixtures import places
from .hybrid import _LEX_POOL, _NEAR, _SEM, _WIDE, PLACES, Search, _rank_sql, h_

KEYS = ["query_id", "item_id"]
CONTEXT = ["context_distance", "context_source", "context_support", "context_spread_p50", "context_spread_p90", "context_confidence", "context_same_share", "context_peak_share", "context_entropy", "context_available"]


def located(x: Search) -> DataFrame:
    """Items with coordinates: those of every fourth place have none, as real ones may, so that centres fall back to the history."""
    return x.items.where(F.col("location") % 4 != 3).select("location").join(places(x.s, x.d), "location")


def context_geo(x: Search) -> DataFrame:
    moves = x.counted("search_location", "item_location")
    every = x.s.range(PLACES).withColumnRenamed("id", "location")
    block = geography.context_block(every, located(x), moves)
    at = located(x).groupBy("location").agg(F.median("lat").alias("i_lat"), F.median("lon").alias("i_lon"))
    pairs = x.hybrid_pool.select(*KEYS).join(sorted_side(x.q.select("query_id", "search_location")), "query_id").join(x.listed("item_id", "location"), "item_id")
    out = pairs.join(block, "search_location", "left").join(at, "location", "left")
    km = haversine(F.col("context_lat"), F.col("context_lon"), F.col("i_lat"), F.col("i_lon"))
    return out.withColumn("context_distance", F.log1p(km)).select(*KEYS, *[r6(F.col(c).cast("double")).alias(c) for c in CONTEXT])


_KM_SQL = "2 * 6371.0::DOUBLE * asin(sqrt(least(greatest(pow(sin((radians({b}lat) - radians({a}lat)) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin((radians({b}lon) - radians({a}lon)) / 2), 2), 0), 1)))"


def _quantile_sql(source: str, value: str, shares: dict[str, float]) -> str:
    columns = ", ".join(f"min(CASE WHEN upto >= {share} * total THEN v END) AS {name}" for name, share in shares.items())
    return f"""(SELECT search_location, {columns} FROM (SELECT search_location, v, sum(w) OVER (PARTITION BY search_location ORDER BY v) AS upto, sum(w) OVER (PARTITION BY search_location) AS total
  FROM (SELECT search_location, {value} AS v, sum(n) AS w FROM {source} WHERE {value} IS NOT NULL GROUP BY ALL)) GROUP BY 1)"""


_CONTEXT = f""", g_moves AS (SELECT search_location, item_location, count(*) AS n FROM h_fit GROUP BY ALL),
g_at AS (SELECT location, median(lat) AS lat, median(lon) AS lon FROM h_items JOIN places USING (location) WHERE location % 4 <> 3 GROUP BY 1),
g_known AS (SELECT search_location, item_location, n, lat, lon FROM g_moves JOIN g_at ON item_location = location),
g_base AS (SELECT e.range AS search_location, CASE WHEN a.lat IS NOT NULL THEN 0 WHEN h_lat IS NOT NULL THEN 1 ELSE 2 END AS source, coalesce(a.lat, h_lat) AS lat, coalesce(a.lon, h_lon) AS lon
  FROM range({PLACES}) e LEFT JOIN g_at a ON a.location = e.range LEFT JOIN {_quantile_sql('g_known', 'lat', {'h_lat': 0.5})} m ON m.search_location = e.range LEFT JOIN {_quantile_sql('g_known', 'lon', {'h_lon': 0.5})} o ON o.search_location = e.range),
g_far AS (SELECT k.search_location, n, round({_KM_SQL.format(a='b.', b='k.')}, 6) AS km FROM g_known k JOIN g_base b USING (search_location)),
g_p AS (SELECT *, n / sum(n) OVER (PARTITION BY search_location)::DOUBLE AS p FROM g_moves),
g_dealt AS (SELECT search_location, sum(n) AS total, sum(CASE WHEN search_location = item_location THEN p ELSE 0 END) AS same, max(p) AS peak, sum(-p * ln(p)) AS entropy FROM g_p GROUP BY 1)
SELECT w.query_id, w.item_id, round(ln(1 + {_KM_SQL.format(a='b.', b='i.')}), 6) AS context_distance, source::DOUBLE AS context_source, round(ln(1 + coalesce(total, 0)), 6) AS context_support, round(p50, 6) AS context_spread_p50, round(p90, 6) AS context_spread_p90,
  round(coalesce(total, 0) / (coalesce(total, 0) + 20.0::DOUBLE), 6) AS context_confidence, round(same, 6) AS context_same_share, round(peak, 6) AS context_peak_share, round(entropy, 6) AS context_entropy, (b.lat IS NOT NULL)::INT::DOUBLE AS context_available
FROM h_pool w JOIN h_q q USING (query_id) JOIN h_items t USING (item_id) LEFT JOIN g_base b ON b.search_location = q.search_location LEFT JOIN g_at i ON i.location = t.location
LEFT JOIN {_quantile_sql('g_far', 'km', {'p50': 0.5, 'p90': 0.9})} s ON s.search_location = q.search_location LEFT JOIN g_dealt d ON d.search_location = q.search_location"""


@query(h_(_WIDE + _LEX_POOL + _SEM + _CONTEXT))
def context_geo_features_10(s, d):
    """Distance from the centre of a search's place, where that centre comes from, and how choices spread around it."""
    return context_geo(Search(s, d))


KIND, TYPE, REMOTE, TRAVEL = "вид услуги", "тип услуги", "удаленно", "выезд"
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _stated(no: str, form: str):
    """A text of ``name: value`` pairs from columns; which of them it has depends on the number."""
    n = F.col(no)
    kind = F.when(n % 4 != 0, F.concat(F.lit("Вид услуги:  услуга "), (n % 3).cast("string"))).otherwise("без вида")
    shape = F.when(n % 5 != 0, F.concat(F.lit("; Тип услуги: "), F.col(form), F.lit("-"), (n % 4).cast("string"))).otherwise("; тип:")
    return F.concat(kind, shape, F.when(n % 7 == 0, "; Удаленно").otherwise(""), F.when(n % 6 == 0, "; Выезд: да").otherwise(""))


def structural(x: Search) -> DataFrame:
    q = x.q.select("query_id", "search_location", _stated("q_no", "delivery").alias("q_text"))
    form = F.element_at(F.array(*[F.lit(c) for c in SEGMENTS]), (F.col("item_id") % len(SEGMENTS) + 1).cast("int"))
    i = x.items.withColumn("form", form).select("item_id", "micro", "location", _stated("item_id", "form").alias("i_text"))
    wanted, had = (sorted_side(features.attributes(*of)) for of in ((q, "query_id", "q_text"), (i, "item_id", "i_text")))
    pairs = x.hybrid_pool.select(*KEYS).join(sorted_side(q), "query_id").join(sorted_side(i), "item_id")
    pairs = pairs.join(x.geo.select("search_location", F.col("item_location").alias("location"), "km"), ["search_location", "location"], "left")
    counts = lambda keys, name: x.items.groupBy(*keys).agg(F.count("*").alias(name))
    pairs = pairs.join(counts(["location"], "place_n"), "location", "left").join(counts(["micro", "location"], "class_place_n"), ["micro", "location"], "left").join(counts(["micro"], "class_n"), "micro", "left")
    out = features.structural_block(pairs, "query_id", "item_id", wanted, had, {"kind": KIND, "type": TYPE}, {"remote": REMOTE, "travel": TRAVEL}, "km")
    return out.select(*KEYS, *[r6(c).alias(c) for c in out.columns[2:]])


def _stated_sql(no: str, form: str) -> str:
    return f"""CASE WHEN {no} % 4 <> 0 THEN 'Вид услуги:  услуга ' || ({no} % 3)::VARCHAR ELSE 'без вида' END || CASE WHEN {no} % 5 <> 0 THEN '; Тип услуги: ' || {form} || '-' || ({no} % 4)::VARCHAR ELSE '; тип:' END
  || CASE WHEN {no} % 7 = 0 THEN '; Удаленно' ELSE '' END || CASE WHEN {no} % 6 = 0 THEN '; Выезд: да' ELSE '' END"""


def _attributes_sql(name: str, key: str, source: str, text: str) -> str:
    return f"""{name} AS (SELECT DISTINCT {key}, trim(regexp_replace(split_part(piece, ':', 1), '\\s+', ' ', 'g')) AS name, trim(regexp_replace(substr(piece, strpos(piece, ':') + 1), '\\s+', ' ', 'g')) AS value
  FROM (SELECT {key}, unnest(string_split(lower({text}), ';')) AS piece FROM {source}) WHERE contains(piece, ':'))"""


_MATCH = "CASE WHEN query_id IN (SELECT query_id FROM qa WHERE name = '{n}' AND value <> '') AND item_id IN (SELECT item_id FROM ia WHERE name = '{n}' AND value <> '') THEN exists(SELECT 1 FROM qa JOIN ia USING (name, value) WHERE name = '{n}' AND value <> '' AND qa.query_id = w.query_id AND ia.item_id = w.item_id)::INT::DOUBLE END"


def _structural_sql() -> str:
    form = f"({SEGMENTS!r})[(item_id % {len(SEGMENTS)} + 1)::INT]"
    return f""", qt AS (SELECT query_id, search_location, {_stated_sql('q_no', 'delivery')} AS q_text FROM h_q),
it AS (SELECT item_id, micro, location, {_stated_sql('item_id', form)} AS i_text FROM h_items),
{_attributes_sql('qa', 'query_id', 'qt', 'q_text')}, {_attributes_sql('ia', 'item_id', 'it', 'i_text')},
fl AS (SELECT location, count(*) AS place_n FROM h_items GROUP BY 1), fc AS (SELECT micro, location, count(*) AS class_place_n FROM h_items GROUP BY ALL), fm AS (SELECT micro, count(*) AS class_n FROM h_items GROUP BY 1)
SELECT query_id, item_id, {_MATCH.format(n=KIND)} AS kind_match, (query_id IN (SELECT query_id FROM qa WHERE name = '{KIND}' AND value <> ''))::INT::DOUBLE AS kind_stated,
  {_MATCH.format(n=TYPE)} AS type_match, (query_id IN (SELECT query_id FROM qa WHERE name = '{TYPE}' AND value <> ''))::INT::DOUBLE AS type_stated, remote, travel,
  round(ln(1 + place_n), 6) AS place_log_count, round(ln(1 + class_place_n), 6) AS class_place_log_count, round(class_place_n / class_n::DOUBLE, 6) AS class_place_share, round(travel * ln(1 + km), 6) AS travel_log_distance
FROM (SELECT p.query_id, p.item_id, (contains(lower(q_text), '{REMOTE}') OR contains(lower(i_text), '{REMOTE}'))::INT::DOUBLE AS remote, (contains(lower(q_text), '{TRAVEL}') OR contains(lower(i_text), '{TRAVEL}'))::INT::DOUBLE AS travel,
    place_n, class_place_n, class_n, km FROM h_pool p JOIN qt USING (query_id) JOIN it USING (item_id) JOIN fl USING (location) JOIN fc USING (micro, location) JOIN fm USING (micro)
    LEFT JOIN km ON km.search_location = qt.search_location AND km.item_location = it.location) w"""


@query(h_(_WIDE + _LEX_POOL + _SEM + _structural_sql()))
def structural_features_10(s, d):
    """What texts state outright: kinds and types that agree, flags, and how frequent the item's place is."""
    return structural(Search(s, d))


# ---------------------------------------------------------------- neighbours, whole


def neighbour_block(x: Search) -> DataFrame:
    """Nine columns of every candidate from the query's nearest known texts; what no neighbour says is null.

    Beside the class columns: the cosine of the item and the neighbours' weighted centre, its rank, and the weight of the neighbours
    that have the item's class (a reconstruction from the columns' names).
    """
    near, texts, held = hybrid.neighbours(x)
    parts = near.join(held, "t_no").select("query_id", "w", F.posexplode("embedding").alias("pos", "v")).groupBy("query_id", "pos").agg(F.sum(F.col("w") * F.col("v").cast("double")).alias("v"))
    centre = parts.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda c: c["v"]).alias("centre"))
    said = near.join(texts, "t_no").join(x.seen.select("query_norm", "micro").distinct(), "query_norm").groupBy("query_id", "micro").agg(F.sum("w").alias("coverage"))
    pairs = x.hybrid_pool.select(*KEYS).join(x.listed("item_id", "micro"), "item_id").join(sorted_side(centre), "query_id")
    pairs = x.with_vectors(pairs, "embedding")
    length = F.sqrt(vectors.dot(F.col("centre"), F.col("centre")))
    pairs = pairs.withColumn("centre_cosine", F.round(vectors.dot(F.col("centre"), F.col("embedding")) / length, 9)).drop("centre", "embedding")
    out = pairs.join(sorted_side(hybrid.neighbour_classes(x)), ["query_id", "micro"], "left").join(sorted_side(said), ["query_id", "micro"], "left")
    own = ["probability", "relative_probability", "entropy", "top_similarity", "margin", "effective_count"]
    return out.select(*KEYS, *[F.col(c).alias(f"neighbour_{c}") for c in own], F.col("centre_cosine").alias("neighbour_centre_cosine"), r6(pool.log_rank("query_id", F.col("centre_cosine"))).alias("neighbour_log_centre_rank"), r6(F.coalesce("coverage", F.lit(0.0))).alias("neighbour_coverage"))


_NEIGHBOUR9 = f""", n_parts AS (SELECT query_id, i, sum(w * v[i]) AS c FROM nw JOIN ntv USING (t_no), range(1, 4097) r(i) WHERE i <= len(v) GROUP BY ALL),
n_centre AS (SELECT query_id, list(c ORDER BY i) AS centre FROM n_parts GROUP BY 1),
n_said AS (SELECT query_id, micro, sum(w) AS coverage FROM nw JOIN nt USING (t_no) JOIN (SELECT DISTINCT query_norm, micro FROM h_fit) USING (query_norm) GROUP BY ALL),
n_cos AS (SELECT p.query_id, p.item_id, i.micro, round(list_dot_product(centre, nv.v) / sqrt(list_dot_product(centre, centre)), 9) AS cosine
  FROM h_pool p JOIN h_items i USING (item_id) JOIN n_centre USING (query_id) CROSS JOIN nn JOIN nv ON vec_id = p.item_id % n)
SELECT query_id, item_id, probability AS neighbour_probability, relative_probability AS neighbour_relative_probability, entropy AS neighbour_entropy, top_similarity AS neighbour_top_similarity, margin AS neighbour_margin, effective_count AS neighbour_effective_count,
  cosine AS neighbour_centre_cosine, {_rank_sql('cosine')} AS neighbour_log_centre_rank, round(coalesce(coverage, 0), 6) AS neighbour_coverage FROM n_cos LEFT JOIN nc USING (query_id, micro) LEFT JOIN n_said USING (query_id, micro)"""


@query(h_(_WIDE + _LEX_POOL + _SEM + _NEAR + _NEIGHBOUR9))
def neighbour_features_9(s, d):
    return neighbour_block(Search(s, d))


# ---------------------------------------------------------------- classes and places

#: A stand-in: the reference does not publish how strongly it shrinks.
PRIOR, LEAST = 20.0, 20
_SERVICE = f""", v_moves AS (SELECT micro, search_location, item_location, count(*) AS n FROM h_fit GROUP BY ALL),
v_g AS (SELECT search_location, item_location, g_n / sum(g_n) OVER (PARTITION BY search_location)::DOUBLE AS g FROM (SELECT search_location, item_location, sum(n) AS g_n FROM v_moves GROUP BY ALL)),
v_here AS (SELECT micro, search_location, sum(n) AS here, sum(n) FILTER (search_location = item_location) AS same_n FROM v_moves GROUP BY ALL),
v_same AS (SELECT avg((search_location = item_location)::INT) AS g_same FROM h_fit)"""


@query(h_(_SERVICE + f""" SELECT micro, search_location, item_location, round((coalesce(n, 0) + {PRIOR}::DOUBLE * g) / (here + {PRIOR}::DOUBLE), 6) AS transition
FROM v_here JOIN v_g USING (search_location) LEFT JOIN v_moves USING (micro, search_location, item_location)"""))
def service_transitions(s, d):
    """Transition rates per class, drawn to those of all classes."""
    out, _ = geography.service_geography(Search(s, d).fit, "micro", "search_location", "item_location", PRIOR, LEAST)
    return out.withColumn("transition", r6("transition"))


@query(h_(_SERVICE + f""" SELECT micro, search_location, round((coalesce(same_n, 0) + {PRIOR}::DOUBLE * g_same) / (here + {PRIOR}::DOUBLE), 6) AS same, round(ln(1 + sum(here) OVER (PARTITION BY micro)), 6) AS support, round(ln(1 + here), 6) AS local_support,
(here >= {LEAST})::INT::DOUBLE AS supported FROM v_here, v_same"""))
def service_geography_pilot(s, d):
    """Share of choices at the place itself per class, drawn to that of all, and what supports it."""
    _, out = geography.service_geography(Search(s, d).fit, "micro", "search_location", "item_location", PRIOR, LEAST)
    return out.select("micro", "search_location", *[r6(c).alias(c) for c in ("same", "support", "local_support")], "supported")


@query(h_(""", w_dist AS (SELECT query_norm, micro, n / sum(n) OVER (PARTITION BY query_norm)::DOUBLE AS p FROM (SELECT query_norm, micro, count(*) AS n FROM h_fit GROUP BY ALL)),
w_per AS (SELECT query_norm, max(p) AS peak, list_sort(list(p), 'DESC')[2] AS second, sum(-p * ln(greatest(p, 1e-12))) AS entropy FROM w_dist GROUP BY 1),
w_r AS (SELECT *, rank() OVER (PARTITION BY query_norm ORDER BY round(p, 9) DESC) AS place FROM w_dist), w_ok AS (SELECT DISTINCT micro FROM h_items WHERE price > 1500)
SELECT query_norm, micro, round(CASE WHEN ok THEN p END, 6) AS probability, round(CASE WHEN ok THEN ln(greatest(p, 1e-8)) END, 6) AS log_probability, round(CASE WHEN ok THEN ln(1 + place) END, 6) AS log_rank,
round(CASE WHEN ok THEN peak END, 6) AS peak, round(CASE WHEN ok THEN peak - coalesce(second, 0) END, 6) AS margin, round(CASE WHEN ok THEN entropy END, 6) AS entropy, ok::INT::DOUBLE AS supported
FROM (SELECT *, micro IN (FROM w_ok) AS ok FROM w_r) JOIN w_per USING (query_norm)"""))
def class_candidate_features_7(s, d):
    """Seven columns of every known text and class; classes without a dear item are not supported."""
    x = Search(s, d)
    p = relational.shares(x.fit.groupBy("query_norm", "micro").agg(F.count("*").alias("n")), "query_norm").select("query_norm", "micro", "p")
    out = features.class_candidate_block(p, "query_norm", "micro", x.items.where("price > 1500"))
    return out.select("query_norm", "micro", *[r6(c).alias(c) for c in out.columns[2:-1]], "supported")


# ---------------------------------------------------------------- one frame

#: The blocks of the whole frame, by the query that gives them.
BLOCKS = ["feature_frame_45", "learned_vector_features", "context_geo_features_10", "neighbour_features_9", "quality_features_12", "field_vector_features_8", "second_encoder_features_4", "structural_features_10"]


def whole_frame(x: Search) -> DataFrame:
    """All 104 columns of every candidate.

    Each block is a stage table, made by itself, so that the driver holds the plan and the broadcasts of one block at a time.  They
    are joined on the pair and share one partitioning.
    """
    made = [hybrid.feature_frame_45, hybrid.learned_vector_features, context_geo_features_10, neighbour_features_9, hybrid.quality_features_12, hybrid.field_vector_features_8, hybrid.second_encoder_features_4, structural_features_10]
    parts = [x.kept(f"block-{name}", lambda block=block: block(x.s, x.d)) for name, block in zip(BLOCKS, made, strict=True)]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(sorted_side(part), KEYS)
    return out


@query("SELECT * FROM " + " JOIN ".join(f"({_SQL[b]})" + (" USING (query_id, item_id)" if k else "") for k, b in enumerate(BLOCKS)))
def feature_frame_104(s, d):
    """Every feature block in one frame."""
    return whole_frame(Search(s, d))
