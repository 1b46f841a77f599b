"""Class models and the query projection over texts of interactions, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stem
from ..functions import text as tx
from ..operators import classes, evaluation, history, learn, lexical, neural, pool, relational, vectors
from ..sources.tables import indexed, staged
from . import fixtures as fx
from .catalog import SEED, query, r6
from .fixtures import CORPUS_SQL, bm25_sql, terms_sql
from .hybrid import Search, _gram_sql, h_

ALPHA, BUCKETS, HIDDEN, STEPS = 0.005, 1 << 11, 48, 35
SHOWN = 10


def inputs(texts: DataFrame) -> DataFrame:
    """(query_norm, term, x): character n-grams and words of each text, as shares of either."""
    return classes.term_shares(texts, "query_norm", {"c": (tx.char_grams(F.col("query_norm")), 1.0), "w": (tx.tokens(tx.folded(F.col("query_norm"))), 1.0)})


def _texts(x: Search) -> DataFrame:
    return x.past.select("query_norm").distinct()


def _known(x: Search) -> DataFrame:
    """Soft targets of the texts that the seen history holds; the held texts have none."""
    return learn.soft_targets(x.fit, "query_norm", "micro")


def bayes(x: Search) -> DataFrame:
    """(query_norm, micro, p) of all texts, by naive Bayes on the seen ones."""
    terms = x.kept("class-terms", lambda: inputs(_texts(x)))
    known = _known(x)
    model = classes.fit_bayes(terms.join(known.select("query_norm").distinct(), "query_norm", "left_semi"), known, "query_norm", "micro", ALPHA)
    return classes.bayes_probabilities(terms, model, "query_norm", "micro")


def _top(p: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_norm").orderBy(F.round("p", 9).desc(), "micro"))
    return p.withColumn("place", place).where(F.col("place") <= SHOWN).select("query_norm", "micro", r6("p").alias("p"), "place")


_BAYES = f""", b_texts AS (SELECT DISTINCT query_norm, query_norm AS norm FROM h_past), {_gram_sql('b_grams', 'b_texts', 'query_norm')},
b_words AS (SELECT query_norm, unnest({terms_sql('query_norm')}) AS term FROM b_texts),
b_x AS (SELECT query_norm, term, n / sum(n) OVER (PARTITION BY query_norm, b)::DOUBLE AS x FROM (
  SELECT query_norm, 'c' AS b, 'c:' || term AS term, count(*) AS n FROM b_grams GROUP BY ALL UNION ALL SELECT query_norm, 'w', 'w:' || term, count(*) FROM b_words GROUP BY ALL)),
b_targets AS (SELECT query_norm, micro, n / t::DOUBLE * least(sqrt(t), 16) AS weight FROM (SELECT query_norm, micro, n, sum(n) OVER (PARTITION BY query_norm) AS t FROM (SELECT query_norm, micro, count(*) AS n FROM h_fit GROUP BY ALL))),
b_mass AS (SELECT micro, term, sum(x * weight) AS m FROM b_x JOIN b_targets USING (query_norm) GROUP BY ALL),
b_size AS (SELECT count(DISTINCT term) AS v FROM b_mass),
b_priors AS (SELECT micro, ln(sum(weight) / (SELECT sum(weight) FROM b_targets)) AS prior FROM b_targets GROUP BY 1),
b_base AS (SELECT micro, prior, ln({ALPHA}::DOUBLE / (coalesce(m, 0) + {ALPHA}::DOUBLE * v)) AS base FROM b_priors LEFT JOIN (SELECT micro, sum(m) AS m FROM b_mass GROUP BY 1) USING (micro), b_size),
b_length AS (SELECT query_norm, coalesce(sum(x) FILTER (term IN (SELECT term FROM b_mass)), 0) AS length FROM b_x GROUP BY 1),
b_said AS (SELECT query_norm, micro, sum(x * ln((m + {ALPHA}::DOUBLE) / {ALPHA}::DOUBLE)) AS said FROM b_x JOIN b_mass USING (term) GROUP BY ALL),
b_log AS (SELECT query_norm, micro, prior + base * length + coalesce(said, 0) AS z FROM b_length CROSS JOIN b_base LEFT JOIN b_said USING (query_norm, micro)),
b_p AS (SELECT query_norm, micro, e / sum(e) OVER (PARTITION BY query_norm) AS p FROM (SELECT *, exp(z - max(z) OVER (PARTITION BY query_norm)) AS e FROM b_log)),
b_top AS (SELECT query_norm, micro, p, row_number() OVER (PARTITION BY query_norm ORDER BY round(p, 9) DESC, micro) AS place FROM b_p)"""


@query(h_(_BAYES + f" SELECT query_norm, micro, round(p, 6) AS p, place FROM b_top WHERE place <= {SHOWN}"))
def naive_bayes_soft(s, d):
    """The ten most probable classes of every text, held ones too, by naive Bayes on soft labels."""
    return _top(bayes(Search(s, d)))


@query(h_(_BAYES + " SELECT query_norm, micro FROM b_top WHERE place = 1"))
def naive_bayes_classes(s, d):
    """The most probable class of every text, from soft labels."""
    return _top(bayes(Search(s, d))).where("place = 1").select("query_norm", "micro")


_QUALITY = """, b_want AS (SELECT query_norm, micro, count(*) AS n FROM h_past WHERE query_norm IN (FROM h_held) GROUP BY ALL),
b_ranked AS (SELECT *, rank() OVER (PARTITION BY query_norm ORDER BY round(p, 9) DESC) AS nth FROM b_p),
b_each AS (SELECT query_norm, sum(n * (nth <= 1)::INT) / sum(n)::DOUBLE AS r1, sum(n * (nth <= 3)::INT) / sum(n)::DOUBLE AS r3, sum(n * (nth <= 5)::INT) / sum(n)::DOUBLE AS r5, sum(n * (nth <= 10)::INT) / sum(n)::DOUBLE AS r10,
  sum(n * -ln(greatest(round(p, 9), 1e-8::DOUBLE))) / sum(n) AS nll FROM b_want JOIN b_ranked USING (query_norm, micro) GROUP BY 1)
SELECT round(avg(r1), 6) AS recall_1, round(avg(r3), 6) AS recall_3, round(avg(r5), 6) AS recall_5, round(avg(r10), 6) AS recall_10, round(avg(nll), 6) AS nll FROM b_each"""


def _quality(x: Search, p: DataFrame) -> DataFrame:
    """Recall of true classes and log-likelihood on the held texts, which no model has seen."""
    from .hybrid import held

    want = relational.within(x.past, held(x.past), "query_norm").groupBy("query_norm", "micro").agg(F.count("*").alias("n"))
    out = evaluation.class_metrics(want, p.withColumn("p", F.round("p", 9)), "query_norm", "micro", [1, 3, 5, 10])
    return out.select(*[r6(c).alias(c) for c in ("recall_1", "recall_3", "recall_5", "recall_10", "nll")])


@query(h_(_BAYES + _QUALITY))
def naive_bayes_held_quality(s, d):
    x = Search(s, d)
    return _quality(x, bayes(x))


def perceptron(x: Search) -> DataFrame:
    """(query_norm, micro, p) of all texts by a network with one hidden layer on the seen texts' soft labels."""
    terms, known = x.kept("class-terms", lambda: inputs(_texts(x))), _known(x)
    labels = [r.micro for r in known.select("micro").distinct().orderBy("micro").collect()]
    rows = staged(neural.perceptron_rows(terms, known, "query_norm", "micro", labels, BUCKETS), "perceptron")
    model = neural.fit_perceptron(rows, labels, BUCKETS, HIDDEN, STEPS, rate=0.01, seed=SEED)
    return neural.perceptron_probabilities(model, rows, BUCKETS).withColumnsRenamed({"key": "query_norm", "label": "micro"})


@query()
def mlp_classes(s, d):
    """The most probable class of every text by the network."""
    return _top(perceptron(Search(s, d))).where("place = 1").select("query_norm", "micro")


@query()
def mlp_held_quality(s, d):
    x = Search(s, d)
    return _quality(x, perceptron(x))


# ---------------------------------------------------------------- query projection


@query()
def query_projection(s, d):
    """Recall at 50 of exact vector search over the chosen items, before and after a projection of the query vectors is learnt.

    Queries are asked contexts; those of one fold of three are held, the others' (query, item) pairs train the map.
    """
    x = Search(s, d)
    q, i = x.vectors()
    dealt = history.folds(x.q, "query_id", 3, SEED)
    seen = relational.within(x.gold, dealt.where("fold <> 0"), "query_id")
    pairs = seen.join(q.withColumnRenamed("embedding", "q"), "query_id").join(i.withColumnRenamed("embedding", "d"), "item_id")
    blocks = staged(neural.projection_blocks(pairs.select(F.col("query_id").alias("query"), F.col("item_id").alias("item"), "q", "d"), seed=SEED), "projection")
    size = s.createDataFrame([], "n int") if not blocks.take(1) else blocks.select(F.size(F.col("rows")[0]["q"]).alias("n")).limit(1)
    p, losses = neural.fit_projection(blocks, (size.first() or [1])[0], rate=0.002)
    held = relational.within(q, dealt.where("fold = 0"), "query_id")
    truth = relational.within(x.gold, held, "query_id")
    rows = []
    for name, asked in (("before", held), ("after", neural.projected(held, "embedding", p))):
        found = vectors.text_key_topk(i, "item_id", asked, "query_id", "embedding", 50)
        rows.append(evaluation.recall(found, truth, "query_id", "item_id").agg(F.lit(name).alias("map"), F.avg("recall").alias("recall_50"), F.count("*").alias("queries")))
    return rows[0].unionByName(rows[1])


# ---------------------------------------------------------------- stems in the index

#: Latin letters as Cyrillic ones, so that the tables' words have endings to be taken off.
_LATIN, _CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувьюыз"


def _russian(column: str):
    return F.translate(F.lower(F.coalesce(F.col(column), F.lit(""))), _LATIN, _CYRILLIC)


def _stem_sql(words: str) -> str:
    """CTEs that end in st(term, stem): the published algorithm in regular expressions, apart from the engine's own."""
    v, ends = "аеиоуыэюя", lambda words: "(?:" + "|".join(words) + ")$"
    cut = lambda c, e: f"regexp_replace({c}, '{ends(e)}', '')"
    has = lambda c, e: f"regexp_matches({c}, '{ends(e)}')"
    cut_after = lambda c, e: f"regexp_replace({c}, '([ая]){ends(e)}', '\\1')"
    has_after = lambda c, e: f"regexp_matches({c}, '[ая]{ends(e)}')"
    return f"""
st_words AS ({words}),
st_0 AS (SELECT term, CASE WHEN regexp_matches(term, '[{v}]') THEN regexp_extract(term, '^[^{v}]*[{v}]') ELSE term END AS head,
  CASE WHEN regexp_matches(term, '^[^{v}]*[{v}]+[^{v}][^{v}]*[{v}]+[^{v}]') THEN length(regexp_extract(term, '^[^{v}]*[{v}]+[^{v}][^{v}]*[{v}]+[^{v}]')) ELSE length(term) END AS r2 FROM st_words),
st_1 AS (SELECT *, substr(term, length(head) + 1) AS a FROM st_0),
st_2 AS (SELECT *, {cut('a', stem.REFLEXIVE)} AS b FROM st_1),
st_3 AS (SELECT *, {cut('b', stem.ADJECTIVE)} AS c FROM st_2),
st_4 AS (SELECT term, head, r2, CASE WHEN {has('a', stem.GERUND)} THEN {cut('a', stem.GERUND)} WHEN {has_after('a', stem.GERUND_AFTER)} THEN {cut_after('a', stem.GERUND_AFTER)}
  WHEN b <> c THEN CASE WHEN {has('c', stem.PARTICIPLE)} THEN {cut('c', stem.PARTICIPLE)} WHEN {has_after('c', stem.PARTICIPLE_AFTER)} THEN {cut_after('c', stem.PARTICIPLE_AFTER)} ELSE c END
  WHEN {has('b', stem.VERB)} THEN {cut('b', stem.VERB)} WHEN {has_after('b', stem.VERB_AFTER)} THEN {cut_after('b', stem.VERB_AFTER)} ELSE {cut('b', stem.NOUN)} END AS d FROM st_3),
st_5 AS (SELECT term, head, r2, regexp_replace(d, 'и$', '') AS e FROM st_4),
st_6 AS (SELECT term, head, CASE WHEN regexp_matches(e, 'ость?$') AND length(head) + length(regexp_replace(e, 'ость?$', '')) >= r2 THEN regexp_replace(e, 'ость?$', '') ELSE e END AS f FROM st_5),
st_7 AS (SELECT *, regexp_replace(f, 'ейше?$', '') AS g FROM st_6),
st AS (SELECT term, CASE WHEN NOT regexp_matches(term, '[а-я]') THEN term ELSE head || CASE WHEN ends_with(g, 'нн') THEN left(g, -1) WHEN g = f THEN regexp_replace(g, 'ь$', '') ELSE g END END AS stem FROM st_7)"""


def _translated(c: str) -> str:
    return f"translate(lower(coalesce({c}, '')), '{_LATIN}', '{_CYRILLIC}')"


_STEMS = f"""WITH {CORPUS_SQL.strip()},
ru_docs AS (SELECT item_id, {terms_sql(_translated('title'))} AS terms FROM corpus), ru_asked AS (SELECT query_id, {terms_sql(_translated('query_text'))} AS q_terms FROM queries),
{_stem_sql("SELECT DISTINCT term FROM (SELECT unnest(terms) AS term FROM ru_docs UNION ALL SELECT unnest(q_terms) FROM ru_asked)").strip()},
rs_docs AS (SELECT item_id, coalesce(list(stem), []) AS terms FROM (SELECT item_id, unnest(terms) AS term FROM ru_docs) JOIN st USING (term) GROUP BY 1 UNION ALL SELECT item_id, [] FROM ru_docs WHERE len(terms) = 0),
rs_asked AS (SELECT query_id, list(stem) AS q_terms FROM (SELECT query_id, unnest(q_terms) AS term FROM ru_asked) JOIN st USING (term) GROUP BY 1),"""


def _stem_rows(s, d) -> tuple[DataFrame, DataFrame]:
    docs = fx.corpus(s, d).select("item_id", tx.tokens(tx.folded(_russian("title"))).alias("terms"))
    return docs, fx.queries(s, d).select("query_id", tx.tokens(tx.folded(_russian("query_text"))).alias("q_terms"))


@query(_STEMS + bm25_sql("rs", "rs_docs", "rs_asked") + " SELECT query_id, item_id, score, place FROM (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS place FROM rs) WHERE place <= 20")
def bm25_stems_top20(s, d):
    """The twenty best titles of every passage by BM25 over stems, of Cyrillic words."""
    docs, asked = _stem_rows(s, d)
    index = indexed(s, f"{d}/documents.parquet", "bm25-stems", lambda: lexical.bm25_index(docs, "item_id", "terms", stems=True))
    scores = lexical.bm25_query(index, "item_id", stem.stemmed_terms(asked, "query_id", "q_terms"), "query_id", "q_terms")
    return pool.stable_topk(scores, 20, "query_id", "item_id").select("query_id", "item_id", "score", F.col("place").cast("bigint").alias("place"))


@query(_STEMS.rstrip(",") + " SELECT term, stem FROM st WHERE term IN (SELECT unnest(terms) FROM ru_docs)")
def stem_vocabulary(s, d):
    """Every word of the titles with its stem."""
    return stem.stem_table(_stem_rows(s, d)[0].select(F.explode("terms").alias("term")))
