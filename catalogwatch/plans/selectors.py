"""Selector queries: extraction log from the event table; two time halves as the two stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogwatch.operators import selectors as S
from catalogwatch.plans.bindings import REQUESTS, requests
from catalogwatch.plans.registry import query

AS_OF_US = 1_711_929_600_000_000  # 2024-04-01
MID_US = 1_705_276_800_000_000  # 2024-01-15

LOG = f"""{REQUESTS}, x AS (SELECT id, us, key % 10 AS domain, kind AS field, 's' || k % 20 AS selector, k % 10 < 7 AS ok, latency FROM requests WHERE {{where}}),
l AS (SELECT domain, field, selector, max(us) FILTER (WHERE ok) AS ls, max(us) FILTER (WHERE NOT ok) AS lf FROM x GROUP BY ALL),
c AS (SELECT domain, field, selector, count(*) AS n, count(*) FILTER (WHERE ok) AS good, min(us) AS first_discovered, max(us) AS last_used,
  count(*) FILTER (WHERE ok AND (lf IS NULL OR us > lf)) AS cs, count(*) FILTER (WHERE NOT ok AND (ls IS NULL OR us > ls)) AS cf
  FROM x JOIN l USING (domain, field, selector) GROUP BY ALL),
{{name}} AS (SELECT domain, field, selector, n AS total_attempts, good AS success_count, first_discovered, last_used, cs AS consecutive_successes, cf AS consecutive_failures,
  n AS usage_count, good / n AS success_rate,
  round(good / n * 0.6 + least(1.0, cs / 10.0::DOUBLE) * 0.2 + least(1.0, n / 100.0::DOUBLE) * 0.1 + least(1.0, ({AS_OF_US} - first_discovered) / 2.592e12::DOUBLE) * 0.1, 9)::DOUBLE AS confidence_score,
  CASE WHEN n < 5 THEN 0 ELSE round(good / n * 0.7 + (1.0 - abs(cs - cf) / n) * 0.2 + least(1.0, n / 50.0::DOUBLE) * 0.1, 9) END::DOUBLE AS reliability_score,
  good / n >= 0.8 AND n >= 5 AND cs >= 3 AS is_reliable, ({AS_OF_US} - last_used) / 8.64e10::DOUBLE > 30 AND good / n < 0.7 AS is_stale FROM c)"""
STATE_SQL = LOG.format(where="TRUE", name="st")


def _log(spark, d):
    r = requests(spark, d)
    return r.select(
        "id", "us", (F.col("key") % 10).alias("domain"), F.col("kind").alias("field"),
        F.concat(F.lit("s"), F.col("k") % 20).alias("selector"), (F.col("k") % 10 < 7).alias("ok"), "latency",
    )


KEYS = ["domain", "field", "selector"]


def state(spark, d, where=None):
    log = _log(spark, d)
    if where:
        log = log.where(where)
    return S.selector_state(log, KEYS, "us", "id", F.col("ok"), "latency", F.lit(AS_OF_US))


@query("selector_state", f"WITH {STATE_SQL} SELECT * FROM st")
def selector_state(spark, d):
    """Statistics and scores per selector."""
    return state(spark, d).drop("avg_seconds")


@query(
    "selector_statistics",
    f"""WITH {STATE_SQL} SELECT domain, field, count(*) AS selectors, count(*) FILTER (WHERE is_reliable) AS reliable, count(*) FILTER (WHERE is_stale) AS stale,
      round(sum(confidence_score), 9) / count(confidence_score) AS avg_confidence, round(sum(success_rate), 9) / count(success_rate) AS avg_success_rate FROM st GROUP BY ALL""",
)
def selector_statistics(spark, d):
    """Selector figures per domain and field."""
    return S.store_statistics(state(spark, d), ["domain", "field"])


@query(
    "best_selectors",
    f"""WITH {STATE_SQL} SELECT domain, field, selector, CAST(row_number() OVER (PARTITION BY domain, field ORDER BY confidence_score DESC, reliability_score DESC, last_used, selector) AS INTEGER) AS rank
    FROM st QUALIFY rank <= 5""",
)
def best_selectors(spark, d):
    """Five best selectors per domain and field."""
    return S.best_selectors(state(spark, d), ["domain", "field"], "selector").select("domain", "field", "selector", "rank")


STORES_SQL = f"""fs AS (WITH {LOG.format(where=f"us < {MID_US} AND key % 10 <> 3 AND k <> 5", name="st")} SELECT * FROM st),
ds AS (WITH {LOG.format(where=f"us >= {MID_US} AND key % 10 <> 4", name="st")} SELECT * FROM st),
rec AS (SELECT coalesce(f.domain, d.domain) AS domain, coalesce(f.field, d.field) AS field, coalesce(f.selector, d.selector) AS selector,
  CASE WHEN d.domain IS NULL THEN 'file_only' WHEN f.domain IS NULL THEN 'db_only' WHEN f.last_used > d.last_used THEN 'file_newer' WHEN d.last_used > f.last_used THEN 'db_newer'
    ELSE 'file_tiebreaker' END AS reason, f.confidence_score AS fc, d.confidence_score AS dc
  FROM fs f FULL JOIN ds d ON f.domain = d.domain AND f.field = d.field AND f.selector = d.selector),
report AS (SELECT domain, count(*) FILTER (WHERE reason = 'file_only') AS file_only, count(*) FILTER (WHERE reason = 'db_only') AS db_only,
  count(*) FILTER (WHERE reason NOT IN ('file_only', 'db_only')) AS conflicts, count(*) FILTER (WHERE reason IN ('file_newer', 'file_tiebreaker')) AS file_wins,
  count(*) FILTER (WHERE reason = 'db_newer') AS db_wins FROM rec GROUP BY domain),
rs AS (SELECT *, CASE WHEN conflicts > 0 THEN 'conflicts' WHEN file_only > 0 AND db_only > 0 THEN 'synced' WHEN file_only > 0 THEN 'file_only' ELSE 'db_only' END AS state FROM report)"""


def _reconciled(spark, d):
    cols = [*KEYS, *S.STORE_COLUMNS]
    # one selector value is missing from the file store
    log = _log(spark, d).join(requests(spark, d).where("k = 5").select("id"), "id", "left_anti").where(f"us < {MID_US} AND domain <> 3")
    file_store = S.selector_state(log, KEYS, "us", "id", F.col("ok"), "latency", F.lit(AS_OF_US)).select(*cols)
    table_store = state(spark, d, f"us >= {MID_US} AND domain <> 4").select(*cols)
    return S.reconcile(file_store, table_store, KEYS)


@query(
    "reconciled_selectors",
    f"WITH {STORES_SQL} SELECT domain, field, selector, reason, CASE WHEN reason LIKE 'file%' THEN fc ELSE dc END AS confidence_score FROM rec",
)
def reconciled_selectors(spark, d):
    """Two selector stores merged, with the reason of each choice."""
    return _reconciled(spark, d).select("domain", "field", "selector", "reason", "confidence_score")


@query(
    "reconcile_report",
    f"""WITH {STORES_SQL} SELECT *, CASE state WHEN 'file_only' THEN 'migrate_to_table' WHEN 'db_only' THEN 'sync_to_file' WHEN 'synced' THEN 'in_sync'
      ELSE CASE WHEN file_wins > db_wins THEN 'file_is_newer' WHEN db_wins > file_wins THEN 'table_is_newer' ELSE 'balanced' END END AS advice FROM rs""",
)
def reconcile_report(spark, d):
    """Reconciliation figures per domain."""
    return S.reconcile_report(_reconciled(spark, d), "domain")


@query(
    "reconcile_totals",
    f"""WITH {STORES_SQL} SELECT count(*) AS total_domains, count(*) FILTER (WHERE state = 'conflicts') AS domains_with_conflicts, count(*) FILTER (WHERE state = 'file_only') AS domains_file_only,
      count(*) FILTER (WHERE state = 'db_only') AS domains_db_only, count(*) FILTER (WHERE state = 'synced') AS domains_synced, CAST(sum(conflicts) AS BIGINT) AS total_conflicts FROM rs""",
)
def reconcile_totals(spark, d):
    """Reconciliation totals."""
    return S.reconcile_totals(reconcile_report(spark, d))


@query(
    "selector_chains",
    f"""WITH {REQUESTS}, s AS (SELECT key % 10 AS domain, kind AS field, 's' || k % 20 AS selector, 0 AS step, min(id) AS pos FROM requests WHERE k > 60 GROUP BY ALL
      UNION ALL SELECT key % 10, kind, 's' || k % 20, 1, min(id) FROM requests WHERE k <= 60 GROUP BY ALL),
    f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY domain, field, selector ORDER BY step, pos) = 1)
    SELECT domain, field, selector, CAST(step AS INTEGER) AS step, CAST(row_number() OVER (PARTITION BY domain, field ORDER BY step, pos, selector) AS INTEGER) AS position FROM f""",
)
def selector_chains(spark, d):
    """Selectors of two steps chained without repeats."""
    log = _log(spark, d).join(requests(spark, d).select("id", "k"), "id")
    steps = [log.where(c).groupBy("domain", "field", "selector").agg(F.min("id").alias("pos")) for c in ("k > 60", "k <= 60")]
    return S.selector_chain(steps, ["domain", "field"])
