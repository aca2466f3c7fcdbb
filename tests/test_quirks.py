"""Quirks of SURVEY 2.12 implemented as intended behaviour, and edge cases."""

import datetime as dt
import os
import tempfile

import pytest

from mensura.operators import filters as fl
from mensura.operators import metrics as mt
from mensura.operators.reconstruct import reconstruct


def test_q2_leaky_yoy_not_in_default_features(spark):
    from mensura.plans.flows import level_features
    rows = [("s", dt.date(2015 + i // 12, i % 12 + 1, 1), float(100 + i), 1.0) for i in range(30)]
    panel = spark.createDataFrame(rows, "series_id string, period date, target double, c double")
    _, feats = level_features(panel, ["c"])
    assert "target_yoy_pct" not in feats and "target_prev_yoy_pct" in feats


def test_q7_blank_columns_dropped_before_null_filter(spark):
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "f.csv"), "w") as f:
        f.write("date,v,,\n2020-01-01,1,,\n2020-02-01,2,,\n")
    raw = spark.read.option("header", True).csv(d)
    assert fl.drop_null(raw).count() == 0                      # the reference's trap: every row has a null
    assert fl.drop_null(fl.drop_unnamed(raw), ["v"]).count() == 2


def test_q11_sentiment_series_is_a_dataframe(spark):
    from mensura.operators import text
    docs = spark.createDataFrame([(1, "ci orre"), (2, "no ci")], "post_id long, text string")
    times = spark.createDataFrame([(1, 1577836800), (2, 1580515200)], "post_id long, created_utc long")
    s = text.sentiment_series(docs, text.lexicon_frame(spark), times)
    got = {r.period: r.consumer_sentiment for r in s.collect()}
    assert got[dt.date(2020, 1, 1)] == pytest.approx(3.8 / (3.8 ** 2 + 15) ** 0.5)
    assert got[dt.date(2020, 2, 1)] == pytest.approx(-1.11 / (1.11 ** 2 + 15) ** 0.5)  # negated 1.5


def test_unknown_target_kind_is_an_error_row(spark):
    df = spark.createDataFrame([("weird", 1.0, 0.1, 0.2, 0.3, 0.0)],
                               "target_kind string, log_lag1 double, log_lag12 double, trend_next double, "
                               "x double, pred_target double")
    r = reconstruct(df).first()
    assert r.predicted is None and "unknown target kind" in r.error


def test_keyword_boundaries_with_accents(spark):
    df = spark.createDataFrame([(1, "Le thé est chaud"), (2, "the shop"), (3, "éthe shop"), (4, "other")],
                               "id int, text string")
    got = sorted(r.id for r in fl.keyword_filter(df, "text", ["the"], ["shop", "store"]).collect())
    assert got == [2]  # 'thé' and 'éthe' are different words; 'other' contains 'the' inside a word


def test_dynamic_partition_overwrite_is_idempotent(spark):
    from mensura.sources.upsert import read_partitions, write_partitions
    path = os.path.join(tempfile.mkdtemp(), "t")
    a = spark.createDataFrame([(2020, "s", 1.0), (2021, "s", 2.0)], "year int, series_id string, v double")
    write_partitions(a, path, ["year"])
    b = spark.createDataFrame([(2021, "s", 5.0)], "year int, series_id string, v double")
    write_partitions(b, path, ["year"])
    write_partitions(b, path, ["year"])  # replay after a failure: same result
    got = {r.year: r.v for r in read_partitions(spark, path).collect()}
    assert got == {2020: 1.0, 2021: 5.0}


def test_one_row_series_metrics(spark):
    df = spark.createDataFrame([("s", 10.0, 12.0)], "series_id string, actual double, predicted double")
    m = mt.forecast_metrics(df).first()
    assert m.n == 1 and m.R2 is None and m.RMSE == 2.0 and m.MAPE_pct == pytest.approx(20.0)


def test_exclude_periods_and_select_resolved(spark):
    df = spark.createDataFrame([("s", dt.date(2021, 1, 1), 1.0, 7.0), ("s", dt.date(2021, 2, 1), 2.0, 8.0)],
                               "series_id string, period date, revenue_raw double, CTA double")
    assert fl.exclude_periods(df, ["2021-01"]).count() == 1
    out = fl.select_resolved(df, ["series_id", "period"], ["target", "ridership", "missing"],
                             {"target": ["revenue_raw"], "ridership": ["CTA"]})
    assert out.columns == ["series_id", "period", "target", "ridership"]


def test_sentence_rules_by_hand(spark):
    from math import sqrt

    from mensura.operators import text
    lex = text.lexicon_frame(spark, [("good", 1.9), ("bad", -2.5), ("die", -2.9), ("to die for", 3.0)])
    cases = {
        "This is good": [1.9], "this is not very good": [(1.9 + 0.293) * -0.74], "It isn’t good": [1.9 * -0.74],
        "GOOD!!!": [1.9 + 3 * 0.292], "it is GOOD!!!!!!": [1.9 + 0.733 + 4 * 0.292], "very, very good": [1.9 + 0.293 * 1.95],
        "slightly bad": [-2.5 + 0.293], "it was good but the end was bad": [1.9 * 0.5 - 2.5 * 1.5],
        "a cake to die for": [3.0], "we die": [-2.9], "Good. Bad?? Nothing here": [1.9, -2.5 - 0.36, 0.0],
        "not one of these words reaches good": [1.9], "": [], "!!!": [], "word " * 50_000 + "good": [1.9],
    }
    rows = [(i, t, "x") for i, t in enumerate(cases)] + [(99, None, "x")]
    df = spark.createDataFrame(rows, "post_id long, text string, valence string")
    got = {r.post_id: r for r in text.sentence_sentiment(df, "text", lex).collect()}
    assert len(got) == len(rows) and got[99].compound == 0.0 and got[99].n_sentences == 0
    for i, sums in enumerate(cases.values()):
        assert got[i].n_sentences == len(sums)
        assert abs(got[i].raw_score - sum(sums)) < 1e-9
        assert abs(got[i].compound - sum(v / sqrt(v * v + 15) for v in sums) / max(len(sums), 1)) < 1e-9
    assert text.sentence_sentiment(df.limit(0), "text", lex).count() == 0


def test_sentence_rules_move_texts_not_words(spark, monkeypatch):
    """Many small shares that ask for their n-grams give what one share that
    is told all phrases gives; no window moves the words of a sentence."""
    from mensura.operators import text
    lex = text.lexicon_frame(spark, [("good", 1.9), ("bad", -2.5), ("to die for", 3.0), ("die", -2.9), ("very good", 2.2)])
    said = ["This is good. It is VERY good!!", "never a good day, but bad?? bad", "A cake to die for", "to die, for", "", None,
            "die die for to die for good", "It isn't very good"] * 3
    rows = [(i if i % 5 else None, t) for i, t in enumerate(said)] + [(1, said[1]), (1, said[0]), (2, said[2])]
    df = spark.createDataFrame(rows, "post_id bigint, text string")

    def scored():
        out = text.sentence_sentiment(df, "text", lex)
        assert "Window" not in out._jdf.queryExecution().toString()
        return sorted((r.post_id is None, r.post_id or 0, r.n_sentences, round(r.raw_score, 9), round(r.compound, 9))
                      for r in out.collect())

    told = scored()
    monkeypatch.setattr(text, "TEXT_SHARE", 40)
    monkeypatch.setattr(text, "TOLD", 0)
    assert scored() == told and len(told) == len({k for k, _ in rows})
    assert [r[2] for r in told if not r[0] and r[1] == 1] == [6]
