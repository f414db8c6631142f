"""Queries run over all of their input."""

from hopline.plans import catalog

SF = "/root/testdata/sf0.001"


def test_isochrone_has_the_hops_of_all_feeds(spark, monkeypatch):
    monkeypatch.setattr(catalog.routing, "isochrone", lambda e, *a, **b: e)
    e = catalog.QUERIES["x10_isochrone"](spark, SF)
    assert e.select("source").distinct().count() == 5
    assert e.where("stop != concat(source, ':', stop_id) OR NOT startswith(next_stop, source)").isEmpty()


def test_race_draws(spark, monkeypatch):
    asked = []

    def draw(*args, n=3650, **named):
        asked.append(n)
        return spark.range(1)

    monkeypatch.setattr(catalog, "materialize", lambda df, tag: df)
    monkeypatch.setattr(catalog.race, "race_pairs", draw)
    catalog.QUERIES["x31_race_pairs"](spark, SF)
    assert asked == [3650]
