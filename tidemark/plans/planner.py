"""Subscription plans: a day's events as demands, evaluated every twenty minutes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import planner
from .queries import query

_LIMITS = planner.Limits(target=3, hard=5, cooldown=3 * 3600.0, together=1500.0)
# k: stock; the state is current (list), ret (stock and until), kn (stock and rank of those that stay), applied
_SQL = f"""WITH RECURSIVE e AS (SELECT epoch(ts::DATE)::BIGINT // 86400 AS key, (epoch_us(ts) // 1200000000 + 1) * 1200.0::DOUBLE AS pos, user_id % 23 AS k, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS pr, event_id % 4 + 1 AS sig, epoch_us(ts) / 1000000.0::DOUBLE AS ob FROM events),
d AS (SELECT key, pos, k, min(pr) AS pr, sum(sig)::BIGINT AS sig, max(ob) AS ob FROM e GROUP BY 1, 2, 3),
r AS (SELECT key, pos, list({{'r': (pr, -sig, -ob, k), 'k': k}} ORDER BY pr, -sig, -ob, k) AS dm, list(k ORDER BY pr, -sig, -ob, k) AS ranked, row_number() OVER (PARTITION BY key ORDER BY pos) AS n FROM d GROUP BY 1, 2),
f(key, n, pos, cur, ret, kn, applied, added, removed, cooling, supplement, coalesced) AS (
  SELECT DISTINCT key, 0::BIGINT, NULL::DOUBLE, []::BIGINT[], []::STRUCT(k BIGINT, u DOUBLE)[], []::STRUCT(r STRUCT(a BIGINT, b BIGINT, c DOUBLE, d BIGINT), k BIGINT)[], NULL::DOUBLE, []::BIGINT[], []::BIGINT[], []::BIGINT[], []::BIGINT[], FALSE FROM r
  UNION ALL SELECT key, n, pos, CASE WHEN co THEN cur ELSE aft END, CASE WHEN co THEN ret ELSE list_filter(ret2, lambda x: list_contains(aft, x.k)) END, CASE WHEN co THEN kn ELSE list_filter(rk, lambda x: list_contains(aft, x.k)) END, CASE WHEN co THEN applied ELSE pos END,
    CASE WHEN co THEN [] ELSE list_sort(list_filter(aft, lambda x: NOT list_contains(cur, x))) END, CASE WHEN co THEN [] ELSE list_sort(list_filter(cur, lambda x: NOT list_contains(aft, x))) END,
    CASE WHEN co THEN list_filter(cur, lambda x: list_contains(list_transform(ret, lambda y: y.k), x)) ELSE list_filter(aft, lambda x: list_contains(cool, x)) END, CASE WHEN co THEN list_filter(ranked, lambda x: NOT list_contains(cur, x)) ELSE list_filter(ranked, lambda x: NOT list_contains(aft, x)) END, co
  FROM (SELECT *, list_filter(cur, lambda x: list_contains(want, x) OR list_contains(cool, x)) || list_filter(want, lambda x: NOT list_contains(cur, x)) AS aft
    FROM (SELECT *, list_transform(list_sort(list_filter(rk, lambda x: list_contains(cur, x.k) AND NOT list_contains(want, x.k) AND list_contains(list_transform(list_filter(ret2, lambda y: y.u > pos), lambda y: y.k), x.k))), lambda x: x.k)[:{_LIMITS.hard} - len(want)] AS cool
      FROM (SELECT *, list_filter(ret, lambda x: NOT list_contains(want, x.k) AND x.u > pos) || list_transform(list_filter(cur, lambda x: NOT list_contains(want, x) AND NOT list_contains(list_transform(ret, lambda y: y.k), x)), lambda x: {{'k': x, 'u': pos + {_LIMITS.cooldown}::DOUBLE}}) AS ret2,
          list_filter(kn, lambda x: NOT list_contains(ranked, x.k)) || dm AS rk
        FROM (SELECT r.key, r.n, r.pos, r.dm, r.ranked, f.cur, f.ret, f.kn, f.applied, r.ranked[:{_LIMITS.target}] AS want, coalesce(r.pos - f.applied < {_LIMITS.together}, FALSE) AS co FROM f JOIN r ON r.key = f.key AND r.n = f.n + 1)))))
SELECT key, pos AS "at", array_to_string(cur, ',') AS subscriptions, array_to_string(added, ',') AS added, array_to_string(removed, ',') AS removed, array_to_string(cooling, ',') AS cooling, array_to_string(supplement, ',') AS supplement, coalesced FROM f WHERE n > 0"""


@query(_SQL)
def subscription_plans(spark, d):
    """What is subscribed, added, removed, kept to cool down and left to the supplement at every evaluation of a day."""
    e = table(spark, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    kind = F.col("event_type")
    demands = e.select(
        F.floor(us / 86_400_000_000).alias("key"), ((F.floor(us / 1_200_000_000) + 1) * 1200.0).alias("at"), (F.col("user_id") % 23).alias("stock"), F.when(kind == "purchase", 1).when(kind == "click", 2).otherwise(3).alias("priority"),
        (F.col("event_id") % 4 + 1).alias("signals"), (us / 1e6).alias("observed"),
    )
    p = planner.plans(demands, _LIMITS)
    return p.select("key", "at", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("subscriptions", "added", "removed", "cooling", "supplement")], "coalesced")
