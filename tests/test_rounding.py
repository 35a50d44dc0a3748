"""Rounded doubles beside a tie are those of DuckDB."""

import math

import duckdb

from inkmill.plans import shared


def test_rounding_is_duckdbs(spark):
    ties = [k / 20 for k in range(1, 2000, 2)]
    values = [sign * x for t in ties for x in (t, math.nextafter(t, 0), math.nextafter(t, 99)) for sign in (1, -1)]
    spark.createDataFrame([(x,) for x in values], "x double").createOrReplaceTempView("near_ties")
    got = {r.x: r.y for r in spark.sql(shared._rounded("SELECT x, round(x, 1) AS y FROM near_ties")).collect()}
    want = dict(duckdb.connect().execute("SELECT x, round(x, 1) FROM (SELECT unnest(?) AS x)", [values]).fetchall())
    assert got == want
    assert shared._rounded("bround(x, 0), round(greatest(a, b), 4)") == "bround(x, 0), (round((greatest(a, b)) * 1e4, 0) / 1e4)"
