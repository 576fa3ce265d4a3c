"""Routes, decisions and history of deals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import Settings, cost_of, decide_margin, margin_of, net_of

#: Fixed values: (condition, route, value column, graded, buy and maybe thresholds), in order.
ROUTES = (
    ("raw", "raw_flip", "raw", False, 30.0, 20.0),
    ("raw", "grade_psa9", "psa9", True, 45.0, 35.0),
    ("raw", "grade_psa10", "psa10", True, 45.0, 35.0),
    ("psa9", "psa9_slab", "psa9", False, 20.0, 10.0),
    ("psa10", "psa10_slab", "psa10", False, 20.0, 10.0),
)


def _routes(s: Settings) -> Column:
    """An array of the routes open to a deal's condition; other conditions are as raw."""
    def route(i: int) -> Column:
        _, name, value, graded, buy, maybe = ROUTES[i]
        cost = F.col("cost") + (F.when(F.col("cost") > 0, s.grading_fee).otherwise(0.0) if graded else 0.0)
        net, margin = net_of(F.col(value), cost, s), margin_of(F.col(value), cost, s)
        free = decide_margin(margin, buy, maybe)
        capped = F.coalesce((cost > s.high_end_cost) & (free == "BUY"), F.lit(False))
        return F.struct(
            F.lit(i).alias("ord"), F.lit(name).alias("route"), cost.alias("route_cost"), net.alias("net"), (net - cost).alias("profit"),
            margin.alias("margin"), F.when(capped, "MAYBE").otherwise(free).alias("decision"), capped.alias("capped"),
            F.when(cost <= 0, "idle").when(margin.isNull(), "missing").otherwise("ready").alias("state"))

    slab = F.col("condition").isin("psa9", "psa10")
    return F.when(~F.coalesce(slab, F.lit(False)), F.array(route(0), route(1), route(2))).when(
        F.col("condition") == "psa9", F.array(route(3))).otherwise(F.array(route(4)))


def deal_routes(deals: DataFrame, values: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per deal and route. ``deals``: id, card_id, condition, shop_price_yen; ``values``: card_id, raw, psa9, psa10."""
    joined = deals.join(values, "card_id", "left").withColumn("cost", cost_of(F.col("shop_price_yen"), settings))
    return joined.select("id", F.inline(_routes(settings)))


def best_route(routes: Column) -> Column:
    """The ready route of best decision, then margin; ties keep the order. Null where none is ready."""
    ready = F.filter(routes, lambda r: (r["state"] == "ready") & r["margin"].isNotNull())
    rank = lambda r: F.when(r["decision"] == "BUY", 2).when(r["decision"] == "MAYBE", 1).otherwise(0)
    return F.array_max(F.transform(ready, lambda r: F.struct(rank(r).alias("rank"), r["margin"].alias("m"), (-r["ord"]).alias("o"), r.alias("r"))))["r"]


def decide(deals: DataFrame, values: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per deal: best route, decision and warning."""
    joined = deals.join(values, "card_id", "left").withColumn("cost", cost_of(F.col("shop_price_yen"), settings))
    picked = joined.withColumn("routes", _routes(settings)).withColumn("best", best_route(F.col("routes")))
    raw, nine, ten = (F.get("routes", i)["margin"] for i in range(3))
    trap = (F.size("routes") == 3) & (raw.isNull() | (raw < 20)) & (nine.isNull() | (nine < 35)) & F.coalesce(ten >= 45, F.lit(False))
    missing = (F.col("cost") > 0) & F.col("best").isNull()
    warning = F.when(trap, "PSA_10_TRAP").when(missing, "VALUES_MISSING").when(F.col("best.capped"), "HIGH_END_RISK")
    return picked.select(
        "id", "cost", F.col("best.route").alias("route"), F.col("best.net").alias("net"), F.col("best.profit").alias("profit"), F.col("best.margin").alias("margin"),
        F.coalesce(F.col("best.decision"), F.lit("SKIP")).alias("decision"),
        F.when(F.col("cost") <= 0, "idle").when(F.col("best").isNull(), "missing").otherwise("ready").alias("state"), warning.alias("warning"))


def bought_totals(deals: DataFrame, settings: Settings = Settings()) -> DataFrame:
    mine = deals.where(F.col("status") == "bought")
    return mine.agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("shop_price_yen"), F.lit(0.0)), 2).alias("yen"),
                    F.round(F.coalesce(F.sum(cost_of(F.col("shop_price_yen"), settings)), F.lit(0.0)), 2).alias("dkk"))


def newest_first(deals: DataFrame, n: int | None = None, by: str = "card_id") -> DataFrame:
    """The deals of each card with their place, newest first; with ``n`` the ``n`` newest alone."""
    w = Window.partitionBy(by).orderBy(F.desc("created_at"), F.desc("id"))
    placed = deals.withColumn("place", F.row_number().over(w))
    return placed if n is None else placed.where(F.col("place") <= n)


def decide_fully(deals: DataFrame, values: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``decide``, with the margins of all graded values and a warning of manual values where there is no other.

    ``values`` holds psa7, psa8, psa95 and is_manual as well."""
    cost = cost_of(F.col("shop_price_yen"), settings)
    graded = {f"{k}_margin": margin_of(F.col(k), cost, settings) for k in ("psa7", "psa8", "psa95")}
    more = deals.join(values, "card_id", "left").select("id", *(c.alias(k) for k, c in graded.items()), F.coalesce("is_manual", F.lit(False)).alias("_manual"))
    decided = decide(deals, values.select("card_id", "raw", "psa9", "psa10"), settings).join(more, "id")
    return decided.withColumn("warning", F.coalesce("warning", F.when(F.col("_manual"), "MANUAL_VALUES"))).drop("_manual")


def append_deals(history: DataFrame, new: DataFrame) -> DataFrame:
    return history.unionByName(new)


def set_status(history: DataFrame, changes: DataFrame) -> DataFrame:
    """The history with the statuses of ``changes`` (id, status)."""
    new = changes.select("id", F.col("status").alias("_s"))
    return history.join(new, "id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s").select(*history.columns)


def delete_deals(history: DataFrame, gone: DataFrame) -> DataFrame:
    return history.join(gone.select("id"), "id", "left_anti").select(*history.columns)


def saved_deals(deals: DataFrame, decided: DataFrame) -> DataFrame:
    """The records of a history: what was asked and what was decided."""
    return deals.join(decided.drop("cost"), "id").select(
        "id", "card_id", "condition", "shop_price_yen", "status", "created_at", "route", "net", "profit", "margin", "decision", "warning")
