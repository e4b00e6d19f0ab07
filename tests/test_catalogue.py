import pytest

from fleetsense.plans import catalogue

from .oracle import assert_same

SF = "/root/testdata/sf0.001"
ORACLES = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, name):
    assert_same(catalogue.queries()[name](spark, SF), ORACLES[name], SF)


def unit(column):
    """The column lies in [0, 1] and each node has one row."""
    return lambda rows: all(0 <= r[column] <= 1 for r in rows) and len({r["node_id"] for r in rows}) == len(rows)


def tours(rows):
    return all(len(set(r["path"])) == len(r["path"]) <= 8 and r["distance_m"] > 0 and r["total_cost"] >= 0 for r in rows)


def in_budget(rows):
    return all(len(set(r["path"])) == len(r["path"]) and r["distance_m"] <= r["budget_m"] + 1e-6 and r["collected"] >= 0 for r in rows)


def policies(rows):
    of = {(r["policy"], r["alpha"]): r for r in rows}
    full, prized = of["A_static_full", None], of["E_orienteering", None]
    warped = [r for (p, _), r in of.items() if p == "C_warped"]
    return (
        len(of) == 10 and all(r["n_visited"] <= full["n_visited"] for r in rows) and all(r["n_visited"] == full["n_visited"] for r in warped)
        and full["distance_km"] <= min(r["distance_km"] for r in warped) + 1e-6 and prized["distance_km"] <= 0.66 * full["distance_km"] + 0.1
    )


def one_tour(rows):
    return sorted(r["pos"] for r in rows) == list(range(1, len(rows) + 1)) and len({r["node_id"] for r in rows}) == len(rows)


#: What must hold of the results that have no twin.
HOLDS = {
    "optimal_route_refined": tours, "routes_by_sql": tours, "orienteering_app": in_budget, "orienteering_exp": in_budget, "policy_comparison": policies, "network_tour": one_tour,
    "refined_tour_gain": lambda rows: all(r["after_m"] <= r["before_m"] + 1e-6 for r in rows),
    "target_routes": lambda rows: all(r["total_cost"] >= 0 for r in rows) and len({r["route_id"] for r in rows}) == len(rows),
    "equity_sweep": lambda rows: len({r["gamma"] for r in rows}) == len(rows) == 4 and all(0 <= r["gini_visits"] <= 1 and r["mean_wait_h"] <= r["worst_wait_h"] for r in rows),
    "rf_priority_scores": unit("score"), "rf_serving_scores": unit("score"), "dispatched_priorities": unit("priority"), "dispatched_forward": unit("priority"), "predicted_costs": unit("predicted_cost"),
    "forward_risk": lambda rows: all(0 <= r["p10"] <= r["p50"] <= r["p90"] <= 24 and 0 <= r["hazard_prob"] <= 1 and 0 <= r["risk"] <= 1 for r in rows),
    "quantile_forest_tto": lambda rows: all(0 <= r["p10"] <= r["p50"] <= r["p90"] <= 24 for r in rows) and len({r["reading_id"] for r in rows}) == len(rows),
    "rollup_quantiles": lambda rows: all(0 <= r["p10"] <= r["p50"] <= r["p95"] <= 1 and 0 < r["humidities"] <= 51 for r in rows) and len({r["group_id"] for r in rows}) == len(rows),
    "model_bake_off": lambda rows: {r["model"] for r in rows} == {"mean", "ridge_state", "random_forest", "boosted_trees"} and all(r["r2"] <= 1 and r["mae"] >= 0 and r["mse"] >= r["mae"] ** 2 - 1e-9 for r in rows),
    "group_fold_errors": lambda rows: sorted(r["fold"] for r in rows) == list(range(5)) and all(r["mse"] >= r["mae"] ** 2 - 1e-9 for r in rows),
    "feature_importance": lambda rows: len({r["feature"] for r in rows}) == len(rows) > 10,
    "forest_importances": lambda rows: abs(sum(r["importance"] for r in rows) - 1) < 1e-6 and all(r["importance"] >= 0 for r in rows),
    "hazard_forest_balanced": lambda rows: all(r["hazard"] in (0, 1) and r["predicted"] in (0, 1) and r["rows"] > 0 for r in rows),
}


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(ORACLES)))
def test_holds(spark, name):
    rows = [r.asDict() for r in catalogue.queries()[name](spark, SF).collect()]
    assert rows and HOLDS.get(name, lambda _: True)(rows)


def test_scan_is_pruned_and_filtered(spark, tmp_path):
    from fleetsense.sources.views import Tables

    df = Tables(spark, SF).reading.where("reading_id = 5").select("node_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_id), EqualTo(event_id,5)]" in plan and "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan


def test_bucket_window_uses_no_python(spark):
    plan = catalogue.queries()["rolling_features_train"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
