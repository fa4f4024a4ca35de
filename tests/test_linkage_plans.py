"""Joins of the linkage step that no size estimate turns into a broadcast."""

from courtside.operators import linkage as ln
from courtside.plans.linkage import part_draws
from courtside.session import spread
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


class Parts:
    """Few rows: by their bytes alone every join below would be a broadcast."""

    def __init__(self, spark):
        self.rows = spark.createDataFrame(
            [(k, f"large ring{k % 3}", f"Brand#{k % 4}", 1 + k % 9) for k in range(40)],
            "p_partkey long, p_name string, p_brand string, p_size int")

    def table(self, name):
        return self.rows


def test_a_spread_side_is_not_broadcast(spark):
    a, b = spark.range(5), spark.range(3)
    assert "Broadcast" in plan(a.join(b, "id")) and "Broadcast" not in plan(a.join(spread(b), "id"))


def test_finals_and_draws_are_linked_without_broadcasts(spark):
    from courtside.plans.fixtures import Fixtures

    fx = Fixtures(spark, "")
    fx.table = Parts(spark).table
    linked, scored = ln.link_finals(fx.final_rows, fx.archive_names), ln.score_draws(part_draws(fx), fx.archive_names)
    assert "Broadcast" not in plan(linked) and "Broadcast" not in plan(scored)
    assert linked.select(F.countDistinct("row_id")).first()[0] == linked.count() > 0 and not scored.isEmpty()


def test_seasons_are_assigned_in_place_and_large_ones_in_rounds(spark, monkeypatch):
    """Every draw wants the same tournaments, so rounds would take one pair each; none is needed for a small season."""
    rows = [(2000 + y, f"d{y}-{i}", f"t{y}-{j}", 3.0 + (i * j) % 2, i, j) for y in range(3) for i in range(12) for j in range(12 if y else 20)]
    rows += rows[:5]                                            # edges listed twice
    edges = spark.createDataFrame(rows, "year int, path string, key string, score double, d_ord int, t_ord int")
    want, paths, keys = set(), set(), set()
    for _, p, k, *_ in sorted(rows, key=lambda r: (-r[3], r[4], r[5])):
        if p not in paths and k not in keys:
            paths.add(p), keys.add(k), want.add((p, k))
    got = lambda df: {(r["path"], r["key"]) for r in df.collect()}
    rounds, used = ln.assign_one_to_one, []
    monkeypatch.setattr(ln, "assign_one_to_one", lambda e: used.append(e.select("year" if "year" in e.columns else "path").distinct().count()) or rounds(e))
    assert got(ln.assign_by_season(edges)) == want and not used
    assert got(ln.assign_by_season(edges, most=200)) == want and used == [12]      # only the season of 240 edges
    assert ln.assign_by_season(edges.limit(0)).isEmpty()
