import pytest

from hayrake.functions.stem import stem, stem_table, stemmed_terms
from hayrake.operators import lexical


@pytest.mark.parametrize(
    ("word", "want"),
    [("вавиловка", "вавиловк"), ("вагнера", "вагнер"), ("вагоне", "вагон"), ("важная", "важн"), ("важнее", "важн"), ("важнейшими", "важн"), ("важничал", "важнича"),
     ("важно", "важн"), ("важности", "важност"), ("валил", "вал"), ("валивший", "вал"), ("ремонта", "ремонт"), ("услуги", "услуг"), ("в", "в"), ("cat", "cat")],
)
def test_published_examples(word, want):
    assert stem(word) == want


def test_table_and_rows(spark):
    d = spark.createDataFrame([(1, ["вагона", "cat", "вагоны"]), (2, []), (3, None), (4, ["вагона"])], "k int, w array<string>")
    assert {r.k: r.w for r in stemmed_terms(d, "k", "w").collect()} == {1: ["вагон", "cat", "вагон"], 2: [], 3: [], 4: ["вагон"]}
    words = spark.createDataFrame([("вагона",), ("вагона",), ("cats",)], "term string")
    assert sorted(map(tuple, stem_table(words).collect())) == [("cats", "cats"), ("вагона", "вагон")]


def test_bm25_over_stems(spark):
    docs = spark.createDataFrame([(1, ["ремонта", "крана"]), (2, ["ремонт", "окна", "ремонты"]), (3, ["cat"])], "k int, w array<string>")
    asked = spark.createDataFrame([("q", ["ремонтом"])], "q string, t array<string>")
    score = lambda stems, terms: {r.k: r.score for r in lexical.bm25_query(lexical.bm25_index(docs, "k", "w", stems), "k", terms, "q", "t").collect()}
    assert score(False, asked) == {}
    want = lexical.bm25_scores(docs.selectExpr("k", "transform(w, x -> case when x like 'ремонт%' then 'ремонт' else x end) as w"), "k", "w", asked.selectExpr("q", "array('ремонт') as t"), "q", "t")
    assert score(True, stemmed_terms(asked, "q", "t")) == {r.k: r.score for r in want.collect()}
