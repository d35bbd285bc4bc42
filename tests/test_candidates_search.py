import math
import os

import pytest
from pyspark.sql import functions as F

from vitrine.operators import candidates as K
from vitrine.operators import search as S
from vitrine.operators.analytics import facet_rows
from vitrine.plans.jobs import run_search
from vitrine.session import run_dir
from vitrine.sources import io, schemas
from vitrine.sources.schemas import FACETS


def test_string_form_round_trip(spark):
    lists = spark.createDataFrame([("c1", " a  b c "), ("c2", ""), ("c3", "z")], "customer_id string, predicted_article_ids string")
    rows = K.explode_candidates(lists)
    assert sorted((r.customer_id, r.article_id, r["rank"]) for r in rows.collect()) == [("c1", "a", 1), ("c1", "b", 2), ("c1", "c", 3), ("c3", "z", 1)]
    back = {r.customer_id: r.predicted_article_ids for r in K.collapse_candidates(rows).collect()}
    assert back == {"c1": "a b c", "c3": "z"}


def _feed(spark, rows):
    return spark.createDataFrame(rows, "customer_id string, article_id string, rank int")


def test_price_band_and_unknowns(spark, tx):
    df = tx([("c1", "a", 0, 100), ("c1", "b", 1, 120), ("c2", "far", 0, 900), ("c2", "low", 0, 70)])
    cands = _feed(spark, [("c1", "a", 1), ("c1", "far", 2), ("c1", "noprice", 3), ("c1", "low", 4), ("new", "a", 1)])
    assert {r.article_id for r in K.price_band(cands, df, 0.2).collect()} == {"a"}
    assert {r.article_id for r in K.price_band(cands, df, 0.3).collect()} == {"a", "low"}
    kept = {(r.customer_id, r.article_id) for r in K.price_band(cands, df, 0.2, keep_unknown=True).collect()}
    assert kept == {("c1", "a"), ("c1", "noprice"), ("new", "a")}


def test_rules_keep_order_and_drop_unknown_articles(spark, tx):
    df = tx([("c1", a, i, 100) for i, a in enumerate("abcd")])
    arts = spark.createDataFrame([("a", "Coat"), ("b", "Top"), ("c", "Bag")], "article_id string, product_type_name string")
    cands = _feed(spark, [("c1", "d", 1), ("c1", "c", 2), ("c1", "a", 3), ("c1", "b", 4)])
    out = K.filter_candidates(cands, arts, df).orderBy("rank").collect()
    assert [(r.article_id, r["rank"]) for r in out] == [("c", 1), ("a", 2), ("b", 3)]
    seasons = spark.createDataFrame([("winter_autumn", "Coat"), ("summer_spring", "Top"), ("all_seasons", "Bag")], "season string, product_type_name string")
    warm = K.filter_candidates(cands, arts, df, season_map=seasons, as_of=F.lit("2020-05-01").cast("date")).orderBy("rank")
    assert [r.article_id for r in warm.collect()] == ["c", "b"]


ARTS = "article_id string, prod_name string, product_type_name string, product_group_name string, department_name string, colour_group_name string, graphical_appearance_name string, detail_desc string"


def _articles(spark):
    return spark.createDataFrame(
        [("1", "Jade", "Top", "G", "D", "Red", "P", "Red cotton shirt"), ("2", None, "Top", "G", "D", "Blue", "P", None),
         ("3", "Ola", "Bag", "H", "D", "Red", "P", "red RED bag"), ("4", "Una", "Bag", "H", "D", None, "P", "blue shirt, cotton")], ARTS)


def test_feed_view_facets(spark):
    feed = _feed(spark, [("c", "3", 1), ("c", "9", 2), ("c", "2", 3), ("c", "1", 4)])
    shown, options = K.feed_view(feed, _articles(spark))
    rows = shown.orderBy("rank").collect()
    assert [r.article_id for r in rows] == ["3", "9", "2", "1"]
    assert rows[1].prod_name == "N/A" and rows[2].detail_desc == "" and rows[0].image_path == "/images/000/0000000003.jpg"
    only, same = K.feed_view(feed, _articles(spark), {"colour_group": "Red", "product_type": "", "bogus": "x"})
    assert [r.article_id for r in only.orderBy("rank").collect()] == ["3", "1"]
    assert sorted(map(tuple, options.collect())) == sorted(map(tuple, same.collect()))
    assert ("colour_group", None) not in [tuple(r) for r in facet_rows(_articles(spark), FACETS).collect()]
    assert K.feed_view(feed, _articles(spark), limit=2)[0].count() == 2
    assert [r["rank"] for r in K.page(feed, 2, 2).orderBy("rank").collect()] == [3, 4]
    assert K.page_counts(feed, 3).first().pages == 2


def _expected_weights(docs, limit=5000):
    counts = {k: {} for k in docs}
    for k, words in docs.items():
        for w in words:
            counts[k][w] = counts[k].get(w, 0) + 1
    df = {}
    for c in counts.values():
        for w in c:
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log((1 + len(docs)) / (1 + n)) + 1 for w, n in df.items()}
    out = {}
    for k, c in counts.items():
        length = math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
        out.update({(k, w): n * idf[w] / length for w, n in c.items()})
    return out, idf


def test_tfidf_matches_the_formula(spark):
    model = S.fit_tfidf(_articles(spark))
    docs = {"1": ["red", "cotton", "shirt"], "2": [], "3": ["red", "red", "bag"], "4": ["blue", "shirt", "cotton"]}
    want, idf = _expected_weights(docs)
    got = {(r.article_id, r.term): r.weight for r in model.weights.collect()}
    assert got == pytest.approx(want)
    assert {r.term: r.idf for r in model.vocabulary.collect()} == pytest.approx(idf)
    small = S.fit_tfidf(_articles(spark), max_features=1)
    assert [r.term for r in small.vocabulary.collect()] == ["red"]


def test_text_search_order_threshold_and_unknown_words(spark):
    model = S.fit_tfidf(_articles(spark))
    feed = _feed(spark, [("c", "4", 1), ("c", "3", 2), ("c", "2", 3), ("c", "1", 4)])
    hits = S.text_search("A RED zzz shirt", feed, model).orderBy("rank").collect()
    assert [r.article_id for r in hits] == ["4", "3", "1"] and max(r.similarity for r in hits) <= 1
    assert S.text_search("zzz the", feed, model).count() == 0
    zeros = S.text_search("zzz", feed, model, threshold=0.0)
    assert zeros.count() == 4 and {r.similarity for r in zeros.collect()} == {0.0}
    one = run_search("text", "bag", feed, _articles(spark), model, customer_id="c")
    assert [r.detail_desc for r in one.collect()] == ["red RED bag"]
    assert run_search("text", "bag", feed, _articles(spark), model, customer_id="x").count() == 0
    path = run_dir(spark, "results")
    run_search("text", "bag", feed, _articles(spark), model, output=path)
    saved = io.read_json(spark, path, schemas.SEARCH_RESULT).collect()
    assert [r.article_id for r in saved] == ["3"] and saved[0].similarity > 0.2
    with pytest.raises(ValueError):
        run_search("smell", "bag", feed, _articles(spark), model)


def test_ngrams(spark):
    df = spark.createDataFrame([("1", "Blue cotton the shirt"), ("2", "one"), ("3", None), ("4", "a b")], "article_id string, detail_desc string")
    got = sorted(r.term for r in S.tokens(df, ngram=(1, 3)).collect())
    assert got == sorted(["blue", "cotton", "shirt", "blue cotton", "cotton shirt", "blue cotton shirt", "one"])


def test_words_keep_accents_and_long_texts(spark):
    text = "Été l'ÉTÉ été_1 x " + "mot " * 5000
    df = spark.createDataFrame([("1", text)], "article_id string, detail_desc string")
    got = {r.term: r.tf for r in S.term_counts(df, "detail_desc").collect()}
    assert got == {"été": 2, "été_1": 1, "mot": 5000}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the given tables are not here")
def test_projections_find_most_neighbours(spark):
    from vitrine.plans import QUERIES

    sf = "/root/testdata/sf0.001"
    exact = {(r.query_id, r.article_id): r.similarity for r in QUERIES["knn_catalog"](spark, sf).collect()}
    found = {(r.query_id, r.article_id): r.similarity for r in QUERIES["knn_lsh"](spark, sf).collect()}
    assert len(set(exact) & set(found)) >= 0.9 * len(exact)
    assert all(abs(found[p] - exact[p]) < 2e-9 for p in set(exact) & set(found))


def test_projections_with_missing_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("z", [0.0, 0.0]), ("n", None)]
    emb = spark.createDataFrame(rows, "article_id string, embedding array<float>")
    asked = emb.select(F.col("article_id").alias("query_id"), F.col("embedding").alias("vec"))
    got = {(r.query_id, r.article_id): r.rank for r in S.knn_lsh(asked, emb, 2, 2, 0.5).collect()}
    assert got == {("a", "a"): 1, ("a", "b"): 2, ("b", "b"): 1, ("b", "a"): 2}


def test_projections_form_no_pairs_of_rows(spark):
    rows = [(f"a{i:02d}", [math.sin(i * j + j) for j in range(1, 5)]) for i in range(40)] + [("a07", [1.0, 0.0, 0.0, 0.0])]
    emb = spark.createDataFrame([*rows, rows[3]], "article_id string, embedding array<float>")
    asked = emb.select(F.col("article_id").alias("query_id"), F.col("embedding").alias("vec"))
    # One bucket holds everything, so the nearest are the exact ones; a row that comes twice counts once.
    found = S.knn_lsh(asked, emb, 4, 5, -1.0, width=1000.0)
    assert "Join" not in found._jdf.queryExecution().toString()
    once = emb.distinct()
    want = S.knn(once.select(F.col("article_id").alias("query_id"), F.col("embedding").alias("vec")), once, 4, 60)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append(r.similarity)
    best = {}
    for r in want.collect():
        best.setdefault(r.query_id, []).append(r.similarity)
    assert set(got) == set(best) and all(len(v) == 5 for v in got.values())
    for q in got:
        assert sorted(got[q], reverse=True) == pytest.approx(sorted(best[q], reverse=True)[:5], abs=2e-9)


def test_words_are_counted_in_bounded_parts(spark, monkeypatch):
    df = spark.createDataFrame([(str(i), "some words here") for i in range(50)], "article_id string, detail_desc string")
    monkeypatch.setattr(S, "TASK_CHARS", 50)
    counts = S.term_counts(df, "detail_desc")
    assert counts.rdd.getNumPartitions() == 15 and counts.count() == 50
