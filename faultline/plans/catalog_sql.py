"""SQL twins of the catalog queries, for another engine over the same tables."""

from __future__ import annotations

from .. import constants as K

DAY = 86400000000
LOG_A = """log_a AS (
  SELECT o_orderkey AS event_id, o_orderdate AS ts, epoch_us(o_orderdate) AS us, r_name AS region, n_name AS installation,
    c_mktsegment AS module, c_name AS equipment, n_name || ' - ' || c_mktsegment || ' - ' || c_name AS asset_id
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""
LOG_B = """log_b AS (
  SELECT event_id, ts, epoch_us(ts) AS us, 'R' AS region, CAST(user_id % 5 AS VARCHAR) || ' - ' || CAST(user_id % 3 AS VARCHAR)
    || ' - ' || CAST(user_id AS VARCHAR) AS asset_id, value
  FROM events WHERE event_type = 'error')"""


def days(later: str, earlier: str) -> str:
    return f"CAST(floor(({later} - {earlier}) / {DAY}.0) AS BIGINT)"


def r6(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"


def div(num: str, den: str) -> str:
    return f"coalesce(({num}) / nullif(CAST(({den}) AS DOUBLE), 0), 0)"


def series(log: str) -> str:
    return f"""series AS (
  SELECT *, {days('us', 'lag(us) OVER w')} AS tbf, row_number() OVER w AS cumulative_failures,
    {days('us', 'min(us) OVER (PARTITION BY asset_id)')} AS asset_age_days
  FROM {log} WINDOW w AS (PARTITION BY asset_id ORDER BY ts, event_id))"""


STATS = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
ROLL = ", ".join(
    f"CAST({fn}(tbf) OVER (PARTITION BY asset_id ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS DOUBLE)"
    f" AS tbf_{s}_{n}"
    for n in K.ROLLING_WINDOWS
    for s, fn in STATS.items()
)
W = "OVER (PARTITION BY asset_id ORDER BY ts, event_id)"
FEATURES = f"""rolled AS (SELECT *, {ROLL}, lag(tbf) {W} AS previous, quantile_cont(tbf, 0.5) OVER (PARTITION BY asset_id) AS middle FROM series),
feat AS (SELECT *, (tbf - previous) / nullif(CAST(previous AS DOUBLE), 0) AS tbf_pct_change,
  tbf_std_3 / (tbf_mean_3 + 1e-6) AS tbf_volatility_3, tbf / (tbf_mean_3 + 1e-6) AS ratio_vs_mean_3,
  tbf / (tbf_mean_6 + 1e-6) AS ratio_vs_mean_6, tbf - tbf_min_6 AS dist_from_min_6, tbf_max_6 - tbf AS dist_from_max_6,
  (tbf - tbf_mean_6) / (tbf_std_6 + 1e-6) AS tbf_zscore_6 FROM rolled)"""
UNFILLED = [
    *[f"tbf_{s}_{n}" for n in K.ROLLING_WINDOWS for s in STATS],
    "tbf_pct_change", "tbf_volatility_3", "ratio_vs_mean_3", "ratio_vs_mean_6", "dist_from_min_6", "dist_from_max_6",
    "tbf_zscore_6",
]


def feature_sql(log_cte: str, log: str, names: list[str], fill: bool) -> str:
    def one(c: str) -> str:
        if not fill:
            return f"{r6(c)} AS {c}"
        value = "coalesce(tbf, middle, 0)" if c == "tbf" else f"coalesce({c}, 0)"
        return f"{r6(f'CAST({value} AS DOUBLE)')} AS {c}"

    return f"WITH {log_cte}, {series(log)}, {FEATURES} SELECT event_id, {', '.join(one(c) for c in names)} FROM feat"


def targets_sql(log_cte: str, log: str) -> str:
    cols = ", ".join(f"CASE WHEN gap <= {h} THEN 1 ELSE 0 END AS fails_within_{h}d" for h in K.HORIZONS)
    return f"""{log_cte}, gaps AS (SELECT *, {days(f'lead(us) {W}', 'us')} AS gap FROM {log}),
labelled AS (SELECT *, gap IS NULL AS is_censored, {cols} FROM gaps)"""


HORIZON_LIST = ", ".join(f"fails_within_{h}d" for h in K.HORIZONS)
CUTS = f"cuts AS (SELECT quantile_cont(us, 0.6) AS q1, quantile_cont(us, 0.8) AS q2 FROM labelled)"
SPLIT = "CASE WHEN us <= q1 THEN 'train' WHEN us <= q2 THEN 'val' ELSE 'test' END"
SPLIT_CTES = f"{targets_sql(LOG_A, 'log_a')}, {CUTS}, parts AS (SELECT *, {SPLIT} AS split FROM labelled, cuts)"

RISK = f"CASE WHEN p >= 0.70 THEN '{K.HIGH_RISK}' WHEN p >= 0.30 THEN '{K.MEDIUM_RISK}' ELSE '{K.LOW_RISK}' END"
ACTION = "CASE risk " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.ACTION_BY_RISK.items()) + " END"
LATEST = "latest AS (SELECT * FROM log_a QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY ts DESC, event_id DESC) = 1)"
SCORES = f"""{LOG_A}, {LATEST}, probs AS (SELECT asset_id, event_id, 30 AS horizon, ((event_id * 7919) % 1000) / 1000.0 AS p FROM latest),
scores AS (SELECT asset_id, horizon, CAST(p AS DOUBLE) AS probability, {RISK} AS risk FROM probs)"""
TOP = f"SELECT asset_id, probability, risk, {ACTION} AS action FROM scores WHERE risk <> '{K.LOW_RISK}' ORDER BY probability DESC, asset_id"
PROBS = "probs AS (SELECT o_orderkey, CAST(((o_orderkey * 7919) % 1000) / 1000.0 AS DOUBLE) AS p FROM orders)"

LINES = "l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus"
GAPPY = """gappy AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate,
  CASE WHEN l_orderkey % 5 <> 0 THEN l_quantity END AS q FROM lineitem)"""


def fill_sql(value: str) -> str:
    return f"WITH {GAPPY} SELECT l_orderkey, l_linenumber, l_partkey, {value} AS q FROM gappy"


def duplicates_sql(direction: str, where: str = "n = 1") -> str:
    order = ", ".join(f"{c} {direction}" for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"))
    return f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY {order}) AS n,
  count(*) OVER (PARTITION BY l_partkey, l_linenumber) AS copies FROM lineitem)
SELECT l_partkey, l_linenumber, l_orderkey, epoch_us(l_shipdate) AS l_shipdate_us, l_extendedprice FROM r WHERE {where}"""


def scale_sql(offset: str, width: str) -> str:
    def one(c: str, name: str) -> str:
        return f"{r6(f'({c} - (SELECT {offset.format(c=c)} FROM lineitem)) / (SELECT {width.format(c=c)} FROM lineitem)')} AS {name}"

    return f"SELECT l_orderkey, l_linenumber, l_partkey, {one('l_extendedprice', 'price')}, {one('l_quantity', 'quantity')} FROM lineitem"


SCORED = """base AS (SELECT o_orderkey AS event_id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS y,
  CASE WHEN year(o_orderdate) < 1998 THEN 'val' ELSE 'test' END AS split FROM orders),
scored AS (SELECT event_id, y, split, 'a' AS model, CAST((event_id * 7919) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) * CAST(0.8 AS DOUBLE) + y * CAST(0.2 AS DOUBLE) AS p FROM base
  UNION ALL SELECT event_id, y, split, 'b', CAST((event_id * 104729) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) FROM base)"""
COUNTS = """CAST(count(*) FILTER (y = 0 AND pred = 0) AS BIGINT) AS tn, CAST(count(*) FILTER (y = 0 AND pred = 1) AS BIGINT) AS fp,
  CAST(count(*) FILTER (y = 1 AND pred = 0) AS BIGINT) AS fn, CAST(count(*) FILTER (y = 1 AND pred = 1) AS BIGINT) AS tp"""
RATE = {
    "accuracy": div("tp + tn", "tp + tn + fp + fn"), "precision": div("tp", "tp + fp"), "recall": div("tp", "tp + fn"),
    "f1": div("2 * tp", "2 * tp + fp + fn"), "specificity": div("tn", "tn + fp"),
}
RATES = ", ".join(f"{r6(v)} AS {k}" for k, v in RATE.items())
AT_HALF = f"{SCORED}, marked AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS pred FROM scored)"
ONE_CLASS = "tp + fn = 0 OR tn + fp = 0"
THRESHOLDS = f"""{SCORED}, grid AS (SELECT i, i / CAST(20 AS DOUBLE) AS threshold FROM range(1, 20) t(i)),
marked AS (SELECT model, split, y, threshold, CASE WHEN p >= threshold THEN 1 ELSE 0 END AS pred FROM scored, grid)"""

GAPS = f"{LOG_A}, {series('log_a')}, gaps AS (SELECT *, CASE WHEN event_id % 4 <> 0 THEN 1 ELSE 0 END AS event FROM series WHERE tbf IS NOT NULL)"


def km(event: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""c AS (SELECT {lead}t, CAST(sum(d) AS BIGINT) AS deaths, CAST(sum(s) AS BIGINT) AS censored FROM (
  SELECT {lead}tbf AS t, CASE WHEN {event} = 1 THEN 1 ELSE 0 END AS d, CASE WHEN {event} = 0 THEN 1 ELSE 0 END AS s FROM gaps
  UNION ALL SELECT DISTINCT {lead}0, 0, 0 FROM gaps) GROUP BY ALL),
k AS (SELECT *, CAST(sum(deaths + censored) OVER ({part} ORDER BY t DESC) AS BIGINT) AS at_risk FROM c),
km AS (SELECT {lead}t, deaths, censored, at_risk, CASE WHEN max(CASE WHEN deaths = at_risk THEN 1 ELSE 0 END) OVER ({part} ORDER BY t) = 1 THEN 0.0
  ELSE exp(sum(CASE WHEN deaths < at_risk THEN ln(1 - deaths / CAST(at_risk AS DOUBLE)) END) OVER ({part} ORDER BY t)) END AS survival FROM k)"""


def weibull(event: str, by: str, tail: str) -> str:
    return f"""WITH RECURSIVE {GAPS}, h AS (SELECT {by} AS region, CAST(tbf AS DOUBLE) AS t, CAST(sum({event}) AS DOUBLE) AS d, CAST(count(*) AS DOUBLE) AS n
  FROM gaps WHERE tbf > 0 GROUP BY ALL),
g AS (SELECT region, max(t) AS top, sum(d) AS d FROM h GROUP BY region),
l AS (SELECT h.region, ln(h.t / g.top) AS l, h.d, h.n FROM h JOIN g ON h.region = g.region),
m AS (SELECT region, sum(d * l) / sum(d) AS ml FROM l GROUP BY region),
it(i, region, k) AS (SELECT 0, region, CAST(1 AS DOUBLE) FROM m
  UNION ALL
  SELECT i + 1, region, k - (s1 / s0 - 1 / k - ml) / (s2 / s0 - (s1 / s0) * (s1 / s0) + 1 / (k * k)) FROM (
    SELECT it.i, it.region, it.k, m.ml, sum(l.n * exp(it.k * l.l)) AS s0, sum(l.n * exp(it.k * l.l) * l.l) AS s1,
      sum(l.n * exp(it.k * l.l) * l.l * l.l) AS s2
    FROM it JOIN l ON l.region = it.region JOIN m ON m.region = it.region WHERE it.i < 30 GROUP BY it.i, it.region, it.k, m.ml) q),
w AS (SELECT it.region, it.k AS shape, g.top * pow(sum(l.n * exp(it.k * l.l)) / g.d, 1 / it.k) AS scale
  FROM it JOIN l ON l.region = it.region JOIN g ON g.region = it.region WHERE it.i = 30 GROUP BY it.region, it.k, g.top, g.d)
{tail}"""


TIMES = "times AS (SELECT DISTINCT l_quantity * CAST(7.3 AS DOUBLE) AS t FROM lineitem)"

WEEK = 7 * DAY


def cause_ctes(width: int = WEEK, name: str = "", names: tuple[str, ...] = ("value", "tbf", "cumulative_failures")) -> str:
    w = f"OVER (PARTITION BY asset_id ORDER BY us RANGE BETWEEN {width} PRECEDING AND 1 PRECEDING)"
    b = f"OVER (PARTITION BY asset_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND {width + 1} PRECEDING)"
    each = " UNION ALL ".join(
        f"SELECT asset_id, event_id, us, '{c}' AS feature, count(*) {w} AS n_window, count(*) {b} AS n_baseline, avg({c}) {w} AS window_mean,"
        f" stddev_samp({c}) {w} AS window_sd, CAST(first_value({c}) {w} AS DOUBLE) AS first, CAST(last_value({c}) {w} AS DOUBLE) AS last,"
        f" avg({c}) {b} AS base_mean, stddev_samp({c}) {b} AS base_sd FROM hist"
        for c in names
    )
    return f"""stats{name} AS ({each}),
z{name} AS (SELECT *, (window_mean - base_mean) / nullif(base_sd, 0) AS z_score FROM stats{name}),
anom{name} AS (SELECT asset_id, event_id, us, feature, z_score, n_window,
  CASE WHEN abs(z_score) >= 4 THEN 'CRÍTICA' WHEN abs(z_score) >= 3 THEN 'ALTA' WHEN abs(z_score) >= 2 THEN 'MODERADA' ELSE 'BAIXA' END AS severity,
  window_mean, base_mean AS baseline_mean, CASE WHEN base_mean <> 0 THEN (window_mean - base_mean) / base_mean * 100 ELSE 0 END AS deviation_pct,
  CASE WHEN z_score > 0 THEN 'Aumento' ELSE 'Queda' END AS impact,
  CASE WHEN n_window > 1 THEN CASE WHEN last > first THEN 'crescente' ELSE 'decrescente' END ELSE 'estável' END AS trend,
  coalesce(window_sd, 0) AS volatility FROM z{name} WHERE abs(z_score) > 2)"""


HIST = f"{LOG_B}, {series('log_b')}, hist AS (SELECT asset_id, event_id, us, value, coalesce(tbf, 0) AS tbf, cumulative_failures FROM series)"
CAUSES = f"{HIST}, {cause_ctes()}"
HOUR = "CAST(hour(make_timestamp(us)) AS DOUBLE)"
WIDE = f"value * value AS square, value / (coalesce(tbf, 0) + 1) AS rate, {HOUR} AS hour, value * {HOUR} AS late"


def similar(past: str = "anom") -> str:
    return f"""past AS (SELECT DISTINCT asset_id, us, feature FROM {past}),
size_now AS (SELECT event_id, count(*) AS n FROM anom GROUP BY event_id),
pairs AS (SELECT a.event_id, a.us, p.us AS past_us, count(*) AS shared, string_agg(a.feature, ',' ORDER BY a.feature) AS common
  FROM anom a JOIN past p ON a.asset_id = p.asset_id AND a.feature = p.feature AND p.us < a.us GROUP BY a.event_id, a.us, p.us),
sim AS (SELECT pairs.*, shared / CAST(n AS DOUBLE) AS similarity_score FROM pairs JOIN size_now USING (event_id) WHERE shared / CAST(n AS DOUBLE) >= 0.3
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY shared DESC, past_us) <= 5),
n_sim AS (SELECT event_id, count(*) AS n_similar FROM sim GROUP BY event_id),
recurs AS (SELECT event_id, f AS feature, count(*) AS times FROM sim, unnest(string_split(common, ',')) u(f) GROUP BY event_id, f)"""


RANKED = """scored_causes AS (SELECT a.*, coalesce(r.times, 0) AS times, least(abs(z_score) / 4, 1) AS strength,
  coalesce(r.times, 0) / CAST(greatest(coalesce(s.n_similar, 0), 1) AS DOUBLE) AS share
  FROM anom a LEFT JOIN recurs r ON r.event_id = a.event_id AND r.feature = a.feature LEFT JOIN n_sim s ON s.event_id = a.event_id),
causes AS (SELECT *, strength * 0.7 + share * 0.3 AS probability_score,
  CASE WHEN share > 0.5 AND strength > 0.75 THEN 'ALTA' WHEN share > 0.3 OR strength > 0.5 THEN 'MÉDIA' ELSE 'BAIXA' END AS confidence,
  row_number() OVER (PARTITION BY event_id ORDER BY strength * 0.7 + share * 0.3 DESC, abs(z_score) DESC, feature) - 1 AS pos FROM scored_causes)"""
WORDS = "CASE feature WHEN 'value' THEN 'Value' WHEN 'tbf' THEN 'Tbf' ELSE 'Cumulative Failures' END"
CONFIDENCE = """CASE WHEN count(a.feature) = 0 THEN 0 ELSE 0.6 * least(avg(abs(a.z_score)) / 4, 1)
  + 0.4 * least(coalesce(max(s.n_similar), 0) / CAST(3 AS DOUBLE), 1) END"""

HISTORY = f"""pred AS (SELECT o_orderkey * 100 + h AS prediction_id, CAST(o_custkey AS VARCHAR) AS asset_id, o_orderdate AS predicted_at, h AS horizon,
  CAST(((o_orderkey * 7919) % 1000) / 1000.0 AS DOUBLE) AS p FROM orders, (VALUES (15), (30)) t(h)),
outc AS (SELECT CAST(o_custkey AS VARCHAR) AS asset_id, o_orderdate + INTERVAL 30 HOURS AS occurred_at, CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 0 END AS failed,
  (o_orderkey * 7919) % 1000003 AS seq FROM orders WHERE o_orderkey % 4 <> 0),
hist AS (SELECT pred.prediction_id, any_value(pred.asset_id) AS asset_id, any_value(predicted_at) AS predicted_at, any_value(horizon) AS horizon, any_value(p) AS p,
  any_value({RISK}) AS risk, arg_min(failed, seq) AS outcome, arg_min(occurred_at, seq) AS occurred_at
  FROM pred LEFT JOIN outc ON pred.asset_id = outc.asset_id AND outc.occurred_at >= pred.predicted_at
    AND outc.occurred_at < pred.predicted_at + (pred.horizon + 1) * INTERVAL 1 DAY
  GROUP BY pred.prediction_id),
ev AS (SELECT *, outcome AS y, CASE WHEN risk <> '{K.LOW_RISK}' THEN 1 ELSE 0 END AS pred FROM hist WHERE outcome IS NOT NULL)"""
SPAN = "OVER (ORDER BY predicted_at RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW)"

LINEAR = {"tbf": -0.01, "cumulative_failures": 0.05, "asset_age_days": 0.001, "month": 0.02}
PHI = " UNION ALL ".join(
    f"SELECT asset_id, ts, event_id, '{c}' AS feature, {w} * ({c} - avg({c}) OVER ()) AS phi FROM full_" for c, w in LINEAR.items()
)
ATTRIBUTED = f"""{LOG_A}, {series('log_a')}, {FEATURES}, full_ AS (SELECT asset_id, ts, event_id, coalesce(tbf, middle, 0) AS tbf,
  CAST(cumulative_failures AS DOUBLE) AS cumulative_failures, CAST(asset_age_days AS DOUBLE) AS asset_age_days, CAST(month(ts) AS DOUBLE) AS month FROM feat),
phis AS ({PHI})"""

SQL = {
    "repeat_rates_by_region": f"""WITH {targets_sql(LOG_A, 'log_a')}, s AS (SELECT *, {days('us', f'lag(us) {W}')} AS tbf FROM labelled)
SELECT region, count(*) AS failures, {r6('avg(tbf)')} AS mean_tbf, {r6('avg(fails_within_30d)')} AS repeat_rate_30d FROM s GROUP BY region""",
    "io1_failure_log": f"""WITH {LOG_A} SELECT event_id, us AS ts_us, CASE WHEN event_id % 3 <> 0 THEN region END AS region, installation, module,
  equipment, asset_id, o_orderpriority AS maintenance_type FROM log_a JOIN orders ON o_orderkey = event_id WHERE event_id % 7 <> 0 AND event_id % 11 <> 0""",
    "io1_date_formats": f"""WITH {LOG_A}, r AS (SELECT *, event_id % 5 AS way FROM log_a)
SELECT event_id, CASE way WHEN 2 THEN epoch_us(date_trunc('day', ts)) WHEN 1 THEN epoch_us(date_trunc('minute', ts)) ELSE epoch_us(date_trunc('second', ts)) END AS ts_us,
  asset_id, (SELECT count(*) FROM r WHERE way = 0) AS n_unread FROM r WHERE way <> 0""",
    "io2_work_orders": """SELECT CAST(l_suppkey AS VARCHAR) || ' - ' || CAST(l_partkey AS VARCHAR) AS asset_id, epoch_us(l_shipdate) AS opened_at_us,
  l_returnflag AS maintenance_type, 'Manutenção preventiva programada' AS description FROM lineitem""",
    "io2_work_orders_by_position": """SELECT l_returnflag || ' - ' || CAST(l_suppkey AS VARCHAR) || ' - ' || CAST(l_partkey AS VARCHAR) AS asset_id,
  epoch_us(l_shipdate) AS opened_at_us, 'Preventiva' AS maintenance_type, 'texto' AS description FROM lineitem""",
    "io3_csv_encoding_fallback": "SELECT c_custkey, 'Região é ' || c_mktsegment AS text FROM customer",
    "io4_mapped_table": """SELECT CAST(o_orderkey % 101 AS VARCHAR) AS progresso, o_orderpriority AS responsavel, CAST(o_orderkey AS VARCHAR) AS tarefa FROM orders""",
    "io4_action_plans": """SELECT 'Ação ' || chr(10) || '"' || o_orderstatus || '", ok' AS status, 'José ' || o_orderkey AS responsavel,
  CASE WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS prazo FROM orders""",
    "io7_model_metadata": f"""WITH per AS (SELECT o_orderdate, dayofweek(o_orderdate) + 1 AS w, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f
  FROM orders GROUP BY ALL), h(horizon) AS (VALUES (3), (30))
SELECT strftime(o_orderdate, 'v%Y%m%d') AS version, epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS created_at_us, horizon,
  CASE WHEN w <> 1 THEN 'RandomForest' ELSE 'Unknown' END AS model_name, CAST(CASE WHEN w <> 2 THEN 0.25 ELSE 0.5 END AS DOUBLE) AS threshold,
  2 AS n_features, {r6('f / n')} AS f1_val, CAST(n AS DOUBLE) AS rows_val, CASE WHEN w <> 3 THEN {r6('f / n')} END AS f1_test FROM per, h
UNION ALL SELECT strftime(o_orderdate, 'v%Y%m%dx'), NULL, 7, 'Unknown', 0.5, NULL, NULL, NULL, NULL FROM per""",
    "io5_prediction_sink": f"WITH {SCORES} SELECT asset_id, horizon, probability, risk, '2024-01-01' AS run_date FROM scores",
    "io8_prediction_history": f"""WITH {HISTORY} SELECT prediction_id, asset_id, epoch_us(predicted_at) AS predicted_at_us, horizon, p AS probability, risk, 'v1' AS model_version FROM hist""",
    "io9_report_counts": f"""WITH {SCORES} SELECT count(*) AS total_assets, count(*) FILTER (risk = '{K.HIGH_RISK}') AS high_risk,
  count(*) FILTER (risk = '{K.MEDIUM_RISK}') AS medium_risk FROM scores""",
    "io9_report_top_assets": f"WITH {SCORES} {TOP} LIMIT 10",
    "u1_high_and_medium": f"WITH {SCORES} {TOP} LIMIT 25",
    "p15_riskiest_assets": f"WITH {SCORES} SELECT asset_id, probability, risk FROM ({TOP} LIMIT 20)",
    "p1_normalized_names": r"""SELECT c_custkey, regexp_replace(regexp_replace(trim(lower(regexp_replace(strip_accents('  Ação/Nº_' || c_name || ' - É ' || c_mktsegment || '  %'),
  '[^\x00-\x7F]', '', 'g'))), '[^a-z0-9\s]', '', 'g'), '\s+', '_', 'g') AS name FROM customer""",
    "p1_normalized_texts": r"""SELECT doc_id, md5(name) AS name_md5, length(name) AS n FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(
  lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '^\s+|\s+$', '', 'g'), '[^a-z0-9\s]', '', 'g'), '\s+', '_', 'g') AS name FROM documents)""",
    "p2_date_range": f"WITH {LOG_A} SELECT event_id, us AS ts_us FROM log_a WHERE ts >= TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '1997-12-31'",
    "p3_fill_zero": fill_sql("coalesce(q, 0)"),
    "p3_fill_mean": fill_sql(r6("coalesce(q, (SELECT avg(q) FROM gappy))")),
    "p3_fill_median": fill_sql("coalesce(q, (SELECT quantile_cont(q, 0.5) FROM gappy))"),
    "p3_fill_median_infinite": f"""WITH {GAPPY}, g AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 7 = 0 THEN CAST('inf' AS DOUBLE)
  WHEN l_orderkey % 11 = 0 THEN CAST('-inf' AS DOUBLE) ELSE CAST(q AS DOUBLE) END AS q FROM gappy)
SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, coalesce(q, (SELECT quantile_cont(q, 0.5) FROM g)) AS q FROM g) WHERE isfinite(q)""",
    "p3_forward_fill_null_key_cut": f"""WITH {GAPPY}, f AS (SELECT l_orderkey, l_linenumber, last_value(q IGNORE NULLS) OVER (
  PARTITION BY CASE WHEN l_partkey % 3 <> 0 THEN l_partkey END ORDER BY l_shipdate, l_orderkey, l_linenumber) AS q FROM gappy)
SELECT l_orderkey, l_linenumber, sum(q) AS q, count(*) AS n FROM f GROUP BY ALL""",
    "p3_forward_fill": f"""WITH {GAPPY}, f AS (SELECT l_orderkey, l_linenumber, last_value(q IGNORE NULLS) OVER (PARTITION BY l_partkey
  ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM gappy)
SELECT l_orderkey, l_linenumber, sum(q) AS q, count(*) AS n FROM f GROUP BY ALL""",
    "p4_outliers_zscore": f"""SELECT {LINES} FROM lineitem, (SELECT avg(l_extendedprice) AS m1, stddev_samp(l_extendedprice) AS s1, avg(l_quantity) AS m2, stddev_samp(l_quantity) AS s2 FROM lineitem)
WHERE abs((l_extendedprice - m1) / (s1 + 1e-10)) <= 1.5 AND abs((l_quantity - m2) / (s2 + 1e-10)) <= 1.5""",
    "p5_outliers_iqr": f"""SELECT {LINES} FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.25) AS a1, quantile_cont(l_extendedprice, 0.75) AS a3,
  quantile_cont(l_quantity, 0.25) AS b1, quantile_cont(l_quantity, 0.75) AS b3 FROM lineitem)
WHERE l_extendedprice BETWEEN a1 - 0.3 * (a3 - a1) AND a3 + 0.3 * (a3 - a1) AND l_quantity BETWEEN b1 - 0.3 * (b3 - b1) AND b3 + 0.3 * (b3 - b1)""",
    "p6_first_of_duplicates": duplicates_sql("ASC"),
    "p6_last_of_duplicates": duplicates_sql("DESC"),
    "p6_unrepeated_rows": duplicates_sql("ASC", "copies = 1"),
    "p7_one_hot": "SELECT o_orderkey, " + ", ".join(
        f"CASE WHEN o_orderkey % 9 <> 0 AND o_orderpriority = '{v}' THEN 1 ELSE 0 END AS \"prio_{v}\""
        for v in ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    ) + " FROM orders",
    "p8_label_encoding": """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey END AS who FROM orders),
f AS (SELECT who, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code FROM r WHERE who IS NOT NULL GROUP BY who)
SELECT o_orderkey, r.who, coalesce(code, -1) AS code FROM r LEFT JOIN f ON r.who = f.who""",
    "p9_scale_standard": scale_sql("avg({c})", "stddev_pop({c})"),
    "p9_scale_robust": scale_sql("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
    "p9_scale_minmax": scale_sql("min({c})", "max({c}) - min({c})"),
    "p10_failure_schema": f"""WITH {LOG_A} SELECT 'module' AS "column", 'not_null' AS "check", count(*) AS n_failures, min(CAST(event_id AS VARCHAR)) AS sample_key FROM log_a WHERE event_id % 13 = 0
UNION ALL SELECT 'ts', 'type', count(*), min(CAST(event_id AS VARCHAR)) FROM log_a WHERE event_id % 17 = 0
UNION ALL SELECT 'description', 'present', 1, NULL""",
    "p11_feature_checks": """SELECT 'a' AS feature, false AS missing, count(*) FILTER (l_orderkey % 5 = 0) AS n_null, 0 AS n_infinite, 0 AS n_out_of_range FROM lineitem
UNION ALL SELECT 'b', false, 0, count(*) FILTER (l_linenumber = 1), 0 FROM lineitem
UNION ALL SELECT 'c', false, 0, 0, count(*) FILTER (l_partkey % 10 = 0) FROM lineitem UNION ALL SELECT 'absent', true, 0, 0, 0""",
    "p12_training_input": """SELECT count(*) AS n_rows, 2 AS n_features, 0 AS rows_with_null, 0 AS null_targets,
  count(DISTINCT l_returnflag = 'R') AS n_classes, 'ok' AS verdict FROM lineitem""",
    "p13_risk_class": f"WITH {PROBS} SELECT o_orderkey, {RISK} AS risk FROM probs",
    "p14_interval": f"""WITH {PROBS}, b AS (SELECT o_orderkey, greatest(p - CAST(0.05 AS DOUBLE), 0) AS lo, least(p + CAST(0.05 AS DOUBLE), 1) AS hi FROM probs)
SELECT o_orderkey, {r6('lo')} AS lower, {r6('hi')} AS upper, printf('%.2f', lo) || ' - ' || printf('%.2f', hi) AS text FROM b""",
    "p16_action_by_risk": f"WITH {PROBS}, r AS (SELECT {RISK} AS risk FROM probs) SELECT risk, {ACTION} AS action, count(*) AS n FROM r GROUP BY risk",
    "p17_feature_columns": f"""WITH {LOG_A}, {series('log_a')}, {FEATURES} """ + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) AS n, {r6(f'avg({e})')} AS mean FROM feat"
        for c, e in {
            "tbf": "coalesce(tbf, middle, 0)", "cumulative_failures": "cumulative_failures", "asset_age_days": "asset_age_days",
            "month": "month(ts)", "weekday": "isodow(ts) - 1", "year": "year(ts)", "quarter": "quarter(ts)",
            **{c: f"coalesce({c}, 0)" for c in UNFILLED},
            "month_sin": "sin(month(ts) * 2 * pi() / 12)", "month_cos": "cos(month(ts) * 2 * pi() / 12)",
            "quarter_sin": "sin(quarter(ts) * 2 * pi() / 4)", "quarter_cos": "cos(quarter(ts) * 2 * pi() / 4)", "survival_30d": "0.5",
        }.items()
    ),
    "p18_calendar_parts": "SELECT event_id, month(ts) AS month, isodow(ts) - 1 AS weekday, year(ts) AS year, quarter(ts) AS quarter FROM events WHERE event_type = 'error'",
    "p19_cyclic_parts": f"""SELECT o_orderkey AS event_id, {r6('sin(2 * pi() * month(o_orderdate) / 12)')} AS month_sin, {r6('cos(2 * pi() * month(o_orderdate) / 12)')} AS month_cos,
  {r6('sin(2 * pi() * quarter(o_orderdate) / 4)')} AS quarter_sin, {r6('cos(2 * pi() * quarter(o_orderdate) / 4)')} AS quarter_cos FROM orders""",
    "w1_w3_series": f"WITH {LOG_A}, {series('log_a')} SELECT event_id, asset_id, tbf, cumulative_failures, asset_age_days FROM series",
    "w1_w3_series_same_day": f"WITH {LOG_B}, {series('log_b')} SELECT event_id, asset_id, tbf, cumulative_failures, asset_age_days FROM series",
    "w4_rolling_statistics": feature_sql(LOG_A, "log_a", UNFILLED[:12], False),
    "w5_w6_trends": feature_sql(LOG_A, "log_a", UNFILLED[12:14], False),
    "w7_w8_interactions": feature_sql(LOG_A, "log_a", UNFILLED[14:], False),
    "w9_feature_table": feature_sql(LOG_A, "log_a", ["tbf", *UNFILLED], True),
    "w9_feature_table_same_day": feature_sql(LOG_B, "log_b", ["tbf", *UNFILLED[:14], "ratio_vs_mean_3", "dist_from_min_6"], True),
    "w10_horizon_targets": f"WITH {targets_sql(LOG_A, 'log_a')} SELECT event_id, is_censored, {HORIZON_LIST} FROM labelled",
    "w10_horizon_targets_same_day": f"WITH {targets_sql(LOG_B, 'log_b')} SELECT event_id, is_censored, {HORIZON_LIST} FROM labelled",
    "w13_sequences": f"WITH {LOG_A}, {series('log_a')}, s AS (SELECT *, coalesce(tbf, 0) AS x FROM series) SELECT event_id, event_id % 2 AS y, " + ", ".join(
        f"CAST(lag(x, {4 - i}) {W} AS DOUBLE) AS s{i}_0, CAST(lag(cumulative_failures, {4 - i}) {W} AS DOUBLE) AS s{i}_1" for i in range(5)
    ) + " FROM s QUALIFY cumulative_failures >= 5",
    "w14_padded_sequences": f"WITH {LOG_A}, {series('log_a')}, s AS (SELECT *, coalesce(tbf, 0) AS x FROM series) SELECT event_id, " + ", ".join(
        f"CAST(coalesce(lag(x, {4 - i}) {W}, first_value(x) {W}) AS DOUBLE) AS s{i}_0,"
        f" CAST(coalesce(lag(cumulative_failures, {4 - i}) {W}, first_value(cumulative_failures) {W}) AS DOUBLE) AS s{i}_1" for i in range(5)
    ) + " FROM s",
    "t2_temporal_split": f"WITH {SPLIT_CTES} SELECT event_id, split FROM parts",
    "t2_purged_split": f"""WITH {SPLIT_CTES} SELECT event_id, split FROM parts
WHERE split = 'test' OR us + {30 * DAY} <= CASE WHEN split = 'train' THEN q1 ELSE q2 END""",
    "a5_class_balance": f"WITH {SPLIT_CTES} " + " UNION ALL ".join(
        f"SELECT split, {h} AS horizon, count(*) AS n_rows, CAST(sum(fails_within_{h}d) AS BIGINT) AS positives, {r6(f'avg(fails_within_{h}d)')} AS positive_rate FROM parts GROUP BY split"
        for h in K.HORIZONS
    ),
    "a6_class_weights": f"""WITH {targets_sql(LOG_A, 'log_a')}, c AS (SELECT fails_within_30d, count(*) AS n_class FROM labelled GROUP BY 1)
SELECT fails_within_30d, n_class, {r6('sum(n_class) OVER () / CAST(count(*) OVER () * n_class AS DOUBLE)')} AS weight FROM c""",
    "t4_undersample": f"""WITH {targets_sql(LOG_A, 'log_a')}, c AS (SELECT fails_within_30d, count(*) AS n FROM labelled GROUP BY 1)
SELECT fails_within_30d, (SELECT min(n) FROM c) AS n, (SELECT min(n) FROM c) AS n_distinct FROM c""",
    "t6_stratified_folds": f"""WITH {targets_sql(LOG_A, 'log_a')}, c AS (SELECT fails_within_30d, count(*) AS n_all FROM labelled GROUP BY 1)
SELECT fails_within_30d, CAST(f AS INTEGER) AS fold, n_all // 5 + CASE WHEN f < n_all % 5 THEN 1 ELSE 0 END AS n FROM c, range(0, 5) t(f)""",
    "t6_folds_null_label": f"""WITH {targets_sql(LOG_A, 'log_a')}, c AS (SELECT CASE WHEN event_id % 5 <> 0 THEN fails_within_30d END AS y, count(*) AS n_all FROM labelled GROUP BY 1)
SELECT y, CAST(f AS INTEGER) AS fold, n_all // 5 + CASE WHEN f < n_all % 5 THEN 1 ELSE 0 END AS n,
  CASE WHEN y IS NULL THEN 0 ELSE n_all // 5 + CASE WHEN f < n_all % 5 THEN 1 ELSE 0 END END AS n_weighted FROM c, range(0, 5) t(f)""",
    "a1_aggregate_by_asset": f"""WITH {LOG_A}, {series('log_a')} SELECT asset_id, {r6('avg(tbf)')} AS tbf_mean, {r6('stddev_samp(tbf)')} AS tbf_std, min(tbf) AS tbf_min,
  max(tbf) AS tbf_max, CAST(sum(tbf) AS BIGINT) AS tbf_sum, count(tbf) AS tbf_count, quantile_cont(tbf, 0.5) AS tbf_median,
  arg_min(tbf, cumulative_failures) FILTER (tbf IS NOT NULL) AS tbf_first, arg_max(tbf, cumulative_failures) FILTER (tbf IS NOT NULL) AS tbf_last,
  max(cumulative_failures) AS cumulative_failures_max FROM series GROUP BY asset_id""",
    "a2_failures_per_asset": f"WITH {LOG_A} SELECT asset_id, count(*) AS failures FROM log_a GROUP BY asset_id ORDER BY failures DESC, asset_id LIMIT 10",
    "a3_distinct_assets": f"WITH {LOG_A} SELECT count(DISTINCT asset_id) AS assets FROM log_a",
    "a4_tbf_histogram": f"""WITH {LOG_A}, {series('log_a')}, s AS (SELECT CAST(min(tbf) AS DOUBLE) AS lo, (max(tbf) - min(tbf)) / CAST(50 AS DOUBLE) AS w FROM series WHERE tbf > 0)
SELECT CAST(least(floor((tbf - lo) / w), 49) AS INTEGER) AS bin, {r6('any_value(lo) + least(floor((tbf - lo) / w), 49) * any_value(w)')} AS bin_from, count(*) AS n
FROM series, s WHERE tbf > 0 GROUP BY least(floor((tbf - lo) / w), 49)""",
    "a7_confusion_metrics": f"WITH {AT_HALF}, c AS (SELECT model, split, {COUNTS} FROM marked GROUP BY model, split) SELECT model, split, tn, fp, fn, tp, {RATES} FROM c",
    "a8_a9_ranking_metrics": f"""WITH {SCORED}, d AS (SELECT model, split, p, sum(y) AS pos, count(*) - sum(y) AS neg FROM scored GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w - pos AS pa, sum(pos) OVER w AS tp, sum(pos + neg) OVER w AS n FROM d WINDOW w AS (PARTITION BY model, split ORDER BY p DESC))
SELECT model, split, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
  {r6('sum(neg * (pa + pos / CAST(2 AS DOUBLE))) / (sum(pos) * CAST(sum(neg) AS DOUBLE))')} AS auc_roc,
  {r6('sum(pos * tp / CAST(n AS DOUBLE)) / sum(pos)')} AS auc_pr FROM c GROUP BY model, split""",
    "a10_cost_metrics": f"""WITH {AT_HALF}, c AS (SELECT model, {COUNTS} FROM marked GROUP BY model),
k AS (SELECT *, fp * CAST(100 AS DOUBLE) AS cost_fp, fn * CAST(1000 AS DOUBLE) AS cost_fn, tp * CAST(50 AS DOUBLE) AS cost_tp, CAST(0 AS DOUBLE) AS revenue_tn FROM c)
SELECT *, cost_fp + cost_fn + cost_tp AS total_cost, revenue_tn - (cost_fp + cost_fn + cost_tp) AS net_result,
  {r6('CASE WHEN cost_fp + cost_fn + cost_tp > 0 THEN (revenue_tn - (cost_fp + cost_fn + cost_tp)) / (cost_fp + cost_fn + cost_tp) * 100 ELSE 0 END')} AS roi_pct FROM k""",
    "a11_class_report": f"""WITH {AT_HALF}, c AS (SELECT model, k, count(*) FILTER (y = k AND pred = k) AS hits, count(*) FILTER (pred = k) AS predicted, count(*) FILTER (y = k) AS support
  FROM marked, (VALUES (0), (1)) t(k) GROUP BY model, k),
r AS (SELECT model, k, {div('hits', 'predicted')} AS precision, {div('hits', 'support')} AS recall, {div('2 * hits', 'predicted + support')} AS f1, support FROM c)
SELECT model, CAST(k AS VARCHAR) AS "class", {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1, support FROM r
UNION ALL SELECT model, 'macro', {r6('avg(precision)')}, {r6('avg(recall)')}, {r6('avg(f1)')}, CAST(sum(support) AS BIGINT) FROM r GROUP BY model
UNION ALL SELECT model, 'weighted', {r6('sum(precision * support) / sum(support)')}, {r6('sum(recall * support) / sum(support)')},
  {r6('sum(f1 * support) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM r GROUP BY model""",
    "a12_model_comparison": f"WITH {AT_HALF}, c AS (SELECT model, {COUNTS} FROM marked GROUP BY model) SELECT model, {', '.join(f'{r6(RATE[k])} AS {k}' for k in ('accuracy', 'f1', 'recall'))} FROM c ORDER BY f1 DESC",
    "a13_threshold_table": f"""WITH {THRESHOLDS}, c AS (SELECT model, threshold, {COUNTS} FROM marked GROUP BY model, threshold)
SELECT model, {r6('threshold')} AS threshold, tn, fp, fn, tp, {r6(RATE['precision'])} AS precision, {r6(RATE['recall'])} AS recall,
  CASE WHEN {ONE_CLASS} THEN 0 ELSE {r6(RATE['f1'])} END AS f1 FROM c""",
    "a13_best_threshold": f"""WITH {THRESHOLDS}, c AS (SELECT model, split, threshold, {COUNTS} FROM marked GROUP BY ALL), f AS (SELECT *, CASE WHEN {ONE_CLASS} THEN 0 ELSE {RATE['f1']} END AS f1 FROM c)
SELECT model, split, {r6('threshold')} AS threshold, {r6('f1')} AS score FROM f QUALIFY row_number() OVER (PARTITION BY model, split ORDER BY f1 DESC, threshold) = 1""",
    "a14_champions": f"""WITH {AT_HALF}, c AS (SELECT CASE WHEN event_id % 2 = 0 THEN 15 ELSE 30 END AS horizon, model, {COUNTS} FROM marked WHERE split = 'val' GROUP BY ALL)
SELECT horizon, model, {r6(RATE['f1'])} AS f1 FROM c QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY {RATE['f1']} DESC, model) = 1""",
    "r1_kaplan_meier": f"WITH {GAPS}, {km('1')} SELECT t, deaths, censored, at_risk, {r6('survival')} AS survival FROM km",
    "r1_kaplan_meier_censored": f"WITH {GAPS}, {km('event', 'region')} SELECT region, t, deaths, censored, at_risk, {r6('survival')} AS survival FROM km",
    "r2_weibull_fit": weibull("event", "'all'", "SELECT round(shape, 5) AS shape, round(scale, 4) AS scale FROM w"),
    "r2_weibull_by_region": weibull("1", "region", "SELECT region, round(shape, 5) AS shape, round(scale, 4) AS scale FROM w"),
    "r3_weibull_summary": weibull("1", "region", """SELECT region, round(scale * pow(ln(CAST(2 AS DOUBLE)), 1 / shape), 4) AS median_life,
  round(scale * gamma(1 + 1 / shape), 4) AS mean_life FROM w"""),
    "r4_survival_nearest": f"""WITH {GAPS}, {km('1')}, {TIMES} SELECT {r6('times.t')} AS t, {r6('arg_min(km.survival, struct_pack(g := abs(km.t - times.t), a := km.t))')} AS survival
FROM times, km GROUP BY times.t""",
    "r4_survival_weibull": f"WITH {TIMES} SELECT {r6('t')} AS t, {r6('exp(-pow(t / 215.4, 1.02))')} AS survival FROM times",
    "r5_conditional_survival": f"""WITH {LOG_A}, {series('log_a')}, s AS (SELECT event_id, CAST(coalesce(tbf, 0) AS DOUBLE) AS t FROM series)
SELECT event_id, {r6('exp(-pow((t + 30) / 215.4, 1.02)) / (exp(-pow(t / 215.4, 1.02)) + 1e-6)')} AS survival_30d FROM s""",
    "r6_survival_curve": f"""WITH {GAPS}, {km('1')} SELECT 'kaplan_meier' AS curve, {r6('CAST(t AS DOUBLE)')} AS t, {r6('survival')} AS survival FROM km
UNION ALL SELECT 'weibull', {r6('top * i / CAST(99 AS DOUBLE)')}, {r6('exp(-pow(top * i / CAST(99 AS DOUBLE) / 215.4, 1.02))')} FROM (SELECT CAST(max(tbf) AS DOUBLE) AS top FROM gaps), range(0, 100) r(i)""",
    "w12_window_statistics": f"WITH {CAUSES} SELECT event_id, n_window, n_baseline, feature, "
    + ", ".join(f"{r6(c)} AS {c}" for c in ("window_mean", "window_sd", "first", "last", "base_mean", "base_sd")) + " FROM stats",
    "w12_scaled_values": f"WITH {HIST.replace('SELECT asset_id, event_id, us, value,', 'SELECT asset_id, event_id, us, value * 1e-7 AS small, value AS plain, value * 1e9 AS large,')}, "
    f"{cause_ctes(names=('small', 'plain', 'large'))} SELECT s.event_id, s.feature, s.n_window, s.n_baseline, {r6('s.window_mean / f.factor')} AS window_mean, "
    f"{r6('s.base_sd / f.factor')} AS base_sd, {r6('z.z_score')} AS z_score, z.severity FROM stats s "
    "JOIN (VALUES ('small', CAST(1e-7 AS DOUBLE)), ('plain', 1), ('large', 1e9)) f(feature, factor) ON f.feature = s.feature "
    "LEFT JOIN anom z ON z.event_id = s.event_id AND z.feature = s.feature",
    "c1_c2_anomalies": f"WITH {CAUSES} SELECT event_id, feature, {r6('z_score')} AS z_score, severity, {r6('window_mean')} AS window_mean, {r6('baseline_mean')} AS baseline_mean, "
    f"{r6('deviation_pct')} AS deviation_pct, impact, trend, {r6('volatility')} AS volatility FROM anom",
    "c3_similar_failures": f"""WITH {CAUSES}, {similar()} SELECT event_id, past_us AS date_us, {r6('similarity_score')} AS similarity_score, shared AS n_common, common,
  {days('us', 'past_us')} AS days_ago FROM sim""",
    "c3_similar_failures_wide": f"""WITH {HIST.replace('AS tbf, cumulative_failures FROM', 'AS tbf, cumulative_failures, ' + WIDE + ' FROM')},
{cause_ctes(names=("value", "tbf", "cumulative_failures", "square", "rate", "hour", "late"))}, {similar()}
SELECT event_id, past_us AS date_us, {r6('similarity_score')} AS similarity_score, common, {days('us', 'past_us')} AS days_ago FROM sim""",
    "c4_c6_causes": f"""WITH {CAUSES}, {similar()}, {RANKED} SELECT event_id, pos, feature AS cause_feature, {r6('probability_score')} AS probability_score, confidence,
  times AS historical_recurrence, severity, {WORDS} || ': ' || lower(impact) || ' de ' || printf('%.1f', abs(deviation_pct)) || '% em relação ao baseline'
  || CASE trend WHEN 'estável' THEN '' ELSE ' (tendência ' || trend || ')' END AS description FROM causes""",
    "c5_confidence": f"""WITH {CAUSES}, {similar()} SELECT h.event_id, {r6(CONFIDENCE)} AS confidence_score
FROM hist h LEFT JOIN anom a ON a.event_id = h.event_id LEFT JOIN n_sim s ON s.event_id = h.event_id GROUP BY h.event_id""",
    "c7_recommendations": f"""WITH {CAUSES}, {similar()}, {RANKED} SELECT event_id, CAST(pos + 1 AS INTEGER) AS priority,
  CASE feature WHEN 'tbf' THEN '{K.ACTION_RULES[0][1]}' WHEN 'cumulative_failures' THEN 'Ativo crítico - Considerar substituição ou overhaul'
    ELSE 'Analisar comportamento de ' || feature || ' - Desvio de ' || printf('%.1f', deviation_pct) || '%' END AS action,
  feature AS cause, confidence, CASE WHEN severity IN ('CRÍTICA', 'ALTA') THEN 'ALTA' ELSE 'MÉDIA' END AS urgency FROM causes WHERE pos < 3
UNION ALL SELECT DISTINCT event_id, 99, 'Revisar logs operacionais de ' || asset_id || ' no período precedente à falha', 'análise_geral', 'ALTA', 'MÉDIA' FROM causes""",
    "c8_cause_report": f"""WITH {CAUSES}, {similar()}, {RANKED} SELECT h.event_id, CASE WHEN max(w.n_window) > 0 THEN 'ok' ELSE 'no rows in window' END AS status, 7 AS window_days,
  count(a.feature) AS n_anomalies, coalesce(max(s.n_similar), 0) AS n_similar, max(CASE WHEN a.pos = 0 THEN a.feature END) AS top_cause,
  least(count(a.feature), 3) + CASE WHEN count(a.feature) > 0 THEN 1 ELSE 0 END AS n_recommendations, {r6(CONFIDENCE)} AS confidence_score
FROM hist h JOIN (SELECT event_id, max(n_window) AS n_window FROM stats GROUP BY 1) w ON w.event_id = h.event_id
  LEFT JOIN causes a ON a.event_id = h.event_id LEFT JOIN n_sim s ON s.event_id = h.event_id GROUP BY h.event_id""",
    "c8_cause_report_longer_window": f"""WITH {HIST}, {cause_ctes(10 * DAY)}, {cause_ctes(WEEK, '_past')}, {similar('anom_past')} SELECT h.event_id,
  CASE WHEN max(w.n_window) > 0 THEN 'ok' ELSE 'no rows in window' END AS status, count(a.feature) AS n_anomalies, coalesce(max(s.n_similar), 0) AS n_similar, {r6(CONFIDENCE)} AS confidence_score
FROM hist h JOIN (SELECT event_id, max(n_window) AS n_window FROM stats GROUP BY 1) w ON w.event_id = h.event_id
  LEFT JOIN anom a ON a.event_id = h.event_id LEFT JOIN n_sim s ON s.event_id = h.event_id GROUP BY h.event_id""",
    "j1_match_outcomes": f"WITH {HISTORY} SELECT prediction_id, outcome, epoch_us(occurred_at) AS occurred_at_us FROM hist",
    "a15_feedback_summary": f"WITH {HISTORY} SELECT count(*) AS total_predictions, count(outcome) AS with_feedback, count(*) - count(outcome) AS pending_feedback FROM hist",
    "a16_feedback_metrics": f"WITH {HISTORY}, c AS (SELECT horizon, {COUNTS} FROM ev GROUP BY horizon) SELECT horizon, tn, fp, fn, tp, {RATES} FROM c",
    "w11_metrics_over_time": f"""WITH {HISTORY}, c AS (SELECT prediction_id, sum(y * pred) {SPAN} AS tp, sum((1 - y) * pred) {SPAN} AS fp, sum(y * (1 - pred)) {SPAN} AS fn,
  count(*) {SPAN} AS n_samples FROM ev WHERE horizon = 30)
SELECT prediction_id, {r6(RATE['f1'])} AS f1, {r6(RATE['precision'])} AS precision, {r6(RATE['recall'])} AS recall, 0.0 AS auc, n_samples FROM c WHERE n_samples >= 5""",
    "a17_drift": f"""WITH {HISTORY}, l AS (SELECT horizon, max(predicted_at) AS last, count(*) AS n_rows FROM ev GROUP BY 1),
p AS (SELECT ev.horizon, n_rows, y, pred, CASE WHEN predicted_at >= last - INTERVAL 30 DAYS THEN 'current' WHEN predicted_at >= last - INTERVAL 120 DAYS THEN 'baseline' END AS part
  FROM ev JOIN l ON ev.horizon = l.horizon),
s AS (SELECT horizon, n_rows, count(*) FILTER (part = 'baseline') AS baseline_samples, count(*) FILTER (part = 'current') AS current_samples,
  {div("2 * count(*) FILTER (part = 'baseline' AND y = 1 AND pred = 1)", "2 * count(*) FILTER (part = 'baseline' AND y = 1 AND pred = 1) + count(*) FILTER (part = 'baseline' AND y <> pred)")} AS fb,
  {div("2 * count(*) FILTER (part = 'current' AND y = 1 AND pred = 1)", "2 * count(*) FILTER (part = 'current' AND y = 1 AND pred = 1) + count(*) FILTER (part = 'current' AND y <> pred)")} AS fc
  FROM p GROUP BY horizon, n_rows),
t AS (SELECT *, CASE WHEN n_rows < 20 THEN 'too few rows' WHEN least(baseline_samples, current_samples) < 5 THEN 'too few rows in a window' ELSE 'ok' END AS status FROM s)
SELECT horizon, n_rows, baseline_samples, current_samples, status, {r6("CASE WHEN status = 'ok' THEN fb END")} AS f1_baseline, {r6("CASE WHEN status = 'ok' THEN fc END")} AS f1_current,
  {r6("CASE WHEN status = 'ok' THEN fb - fc END")} AS f1_drop, status = 'ok' AND fb - fc > 0.05 AS drift_detected FROM t""",
    "j3_latest_rows": f"WITH {LOG_A}, {LATEST} SELECT asset_id, event_id, us AS ts_us FROM latest",
    "x1_linear_attribution": f"WITH {ATTRIBUTED} SELECT event_id, feature, {r6('phi')} AS phi FROM phis",
    "x2_coalitions_of_linear_model": f"WITH {ATTRIBUTED} SELECT event_id, feature, {r6('phi')} AS phi FROM phis",
    "x2_coalitions_add_up": f"WITH {LOG_A}, {LATEST} SELECT event_id, CAST(6 AS BIGINT) AS features, true AS adds_up, true AS bounded FROM latest",
    "a18_global_importance": f"""WITH {ATTRIBUTED}, i AS (SELECT feature, avg(abs(phi)) AS importance FROM phis GROUP BY feature)
SELECT feature, {r6('importance')} AS importance, {r6('importance / sum(importance) OVER () * 100')} AS importance_pct FROM i""",
    "x3_top_drivers": f"""WITH {ATTRIBUTED}, r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(phi) DESC, feature) - 1 AS pos FROM phis)
SELECT event_id, CAST(pos AS INTEGER) AS pos, feature, {r6('phi')} AS phi FROM r WHERE pos < 2""",
    "j4_planning_rows": f"""WITH {ATTRIBUTED}, {LATEST}, probs AS (SELECT asset_id, event_id, ((event_id * 7919) % 1000) / 1000.0 AS p FROM latest),
r AS (SELECT phis.*, row_number() OVER (PARTITION BY phis.event_id ORDER BY abs(phi) DESC, feature) AS pos FROM phis JOIN latest USING (event_id)),
d AS (SELECT asset_id, string_agg(feature, ',' ORDER BY pos) AS drivers FROM r WHERE pos <= 3 GROUP BY asset_id),
f AS (SELECT * FROM log_a QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY ts, event_id) = 1)
SELECT f.asset_id, f.region, f.equipment, CAST(p AS DOUBLE) AS probability, {RISK} AS risk, drivers FROM f JOIN probs ON probs.asset_id = f.asset_id JOIN d ON d.asset_id = f.asset_id""",
    "j6_global_statistics": f"""WITH s AS (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS sd, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, {r6('(l_quantity - m) / sd')} AS z, {r6('l_quantity - q1')} AS over_q1, {r6('q3 - l_quantity')} AS under_q3 FROM lineitem, s""",
}

for _name in (
    "w9_feature_table", "w14_padded_sequences", "p3_forward_fill", "a8_a9_ranking_metrics", "c8_cause_report", "w11_metrics_over_time",
):
    SQL[f"{_name}_cut"] = SQL[_name]
SQL["w10_horizon_targets_cut"] = SQL["w10_horizon_targets_same_day"]
SQL["t1_canonical_order"] = """SELECT o_orderkey AS event_id, o_orderpriority AS asset_id,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS place FROM orders"""
SQL["t5_smote_counts"] = f"""WITH {targets_sql(LOG_A, 'log_a')}, c AS (SELECT fails_within_30d AS y, count(*) AS n FROM labelled GROUP BY 1)
SELECT y, false AS synthetic, n FROM c UNION ALL SELECT y, true, (SELECT max(n) FROM c) - n FROM c WHERE n < (SELECT max(n) FROM c)"""
SQL["j1_match_outcomes_cut"] = """WITH pred AS (SELECT o_orderkey * 100 + h AS prediction_id, o_custkey % 3 AS asset_id, o_orderdate AS predicted_at, h AS horizon
  FROM orders, (VALUES (15), (30)) t(h)),
outc AS (SELECT o_custkey % 3 AS asset_id, o_orderdate + INTERVAL 30 HOURS + ((o_orderkey * 7919) % 1000003 % 600) * INTERVAL 1 MINUTE AS occurred_at,
  CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 0 END AS failed, (o_orderkey * 7919) % 1000003 AS seq FROM orders WHERE o_orderkey % 4 <> 0),
spans AS (SELECT asset_id, predicted_at, horizon, arg_min(failed, seq) AS outcome, arg_min(occurred_at, seq) AS occurred_at FROM
  (SELECT DISTINCT asset_id, predicted_at, horizon FROM pred) p JOIN outc USING (asset_id)
  WHERE outc.occurred_at >= p.predicted_at AND outc.occurred_at < p.predicted_at + (p.horizon + 1) * INTERVAL 1 DAY GROUP BY ALL)
SELECT prediction_id, outcome, epoch_us(occurred_at) AS occurred_at_us FROM pred LEFT JOIN spans USING (asset_id, predicted_at, horizon)"""
for _name, _asset in (("j1_logged_order", "o_custkey"), ("j1_logged_order_cut", "o_custkey % 3")):
    SQL[_name] = f"""WITH pred AS (SELECT o_orderkey * 100 + h AS prediction_id, {_asset} AS asset_id, o_orderdate AS predicted_at, h AS horizon,
  ((o_orderkey * 100 + h) * 104729) % 1000003 AS logged FROM orders, (VALUES (15), (30)) t(h)),
outc AS (SELECT {_asset} AS asset_id, o_orderdate + INTERVAL 30 HOURS AS occurred_at,
  CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 0 END AS failed, (o_orderkey * 7919) % 1000003 AS seq FROM orders WHERE o_orderkey % 4 <> 0),
spans AS (SELECT prediction_id, arg_min(failed, seq) AS outcome, arg_min(occurred_at, seq) AS occurred_at FROM pred p JOIN outc USING (asset_id)
  WHERE outc.occurred_at >= p.predicted_at AND outc.occurred_at < p.predicted_at + (p.horizon + 1) * INTERVAL 1 DAY AND seq > logged GROUP BY ALL)
SELECT prediction_id, outcome, epoch_us(occurred_at) AS occurred_at_us FROM pred LEFT JOIN spans USING (prediction_id)"""
# the fitted value of a score is the largest, over the starts before it, of the smallest mean up to an end after it
SQL["m4_isotonic"] = SQL["m4_isotonic_cut"] = f"""WITH {SCORED}, c AS (SELECT model, p AS s, count(*) AS w, sum(y) AS p FROM scored GROUP BY ALL),
n AS (SELECT *, row_number() OVER o AS i, CAST(sum(w) OVER o AS DOUBLE) AS cw, CAST(sum(p) OVER o AS DOUBLE) AS cp FROM c WINDOW o AS (PARTITION BY model ORDER BY s)),
j AS (SELECT a.model, a.i AS j, b.i AS k, (b.cp - a.cp + a.p) / (b.cw - a.cw + a.w) AS mean FROM n a JOIN n b ON a.model = b.model AND a.i <= b.i),
l AS (SELECT model, j, k AS i, min(mean) OVER (PARTITION BY model, j ORDER BY k DESC) AS low FROM j),
f AS (SELECT model, i, round(max(low), 12) AS value FROM l GROUP BY model, i)
SELECT model, {r6('min(s)')} AS first, {r6('max(s)')} AS last, {r6('CAST(sum(w) AS DOUBLE)')} AS weight, {r6('value')} AS value
FROM f JOIN n USING (model, i) GROUP BY model, f.value"""
SQL["t5_neighbours"] = f"""WITH x AS (SELECT c_custkey AS k, round(c_acctbal / 100, 1) AS a, CAST(c_nationkey AS DOUBLE) AS b, CAST(c_custkey % 3 AS DOUBLE) AS c FROM customer),
d AS (SELECT p.k, q.k AS o, sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b) + (p.c - q.c) * (p.c - q.c)) AS d FROM x p JOIN x q ON p.k <> q.k),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, o) AS n FROM d)
SELECT k AS customer, CAST(n AS INTEGER) AS place, o AS neighbour, {r6('d')} AS distance FROM r WHERE n <= 5"""
SQL["io3_mixed_encodings"] = SQL["io3_csv_encoding_fallback"]
SQL["io8_json_history"] = f"""WITH {HISTORY} SELECT asset_id, epoch_us(predicted_at) AS predicted_at_us, horizon, p AS probability, risk, 'v1' AS model_version,
  outcome, epoch_us(occurred_at) AS occurred_at_us FROM hist"""
SQL["p7_one_hot_sparse"] = """WITH r AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 9 <> 0 THEN c_name END AS who FROM customer),
w AS (SELECT who, row_number() OVER (ORDER BY who) - 2 AS i FROM (SELECT DISTINCT who FROM r WHERE who IS NOT NULL)),
s AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 2 AS i FROM (SELECT DISTINCT c_mktsegment FROM r))
SELECT c_custkey, CASE WHEN w.i >= 0 THEN w.i END AS who_hot_index, CASE WHEN s.i >= 0 THEN s.i END AS segment_index,
  CASE WHEN s.i >= 0 THEN 1 ELSE 0 END AS segment_ones FROM r LEFT JOIN w USING (who) LEFT JOIN s USING (c_mktsegment)"""
SQL["a8_null_scores"] = SQL["a8_a9_ranking_metrics"].replace("FROM scored GROUP BY ALL", "FROM scored WHERE event_id % 7 <> 0 GROUP BY ALL")
SQL["m9_missing_features"] = f"""WITH {LOG_A}, {LATEST}, n AS (SELECT count(*) AS assets, count(*) FILTER (event_id % 11 = 0) AS failed FROM latest)
SELECT h AS horizon, assets, failed, failed AS without_score, assets - failed AS scored FROM n, (VALUES (3), (7), (15), (30)) t(h)"""
SQL["st1_outcome_feed"] = SQL["j1_match_outcomes"]
SQL["st1_stream_join"] = SQL["j1_match_outcomes"] + " WHERE outcome IS NOT NULL"

CANDIDATES = "m(model) AS (VALUES ('RandomForest'), ('GradientBoosting'), ('GradientBoostingDeep'), ('LogisticRegression'), ('StackingEnsemble'))"
SQL["m1_m5_m8_training"] = f"WITH {SPLIT_CTES}, {CANDIDATES} " + " UNION ALL ".join(
    f"""SELECT {h} AS horizon, model, split, count(*) AS n_rows, CAST(sum(fails_within_{h}d) AS BIGINT) AS positives, true AS best_by_f1, true AS bounded
FROM parts, m WHERE split <> 'train' GROUP BY model, split""" for h in K.HORIZONS
)
TEST_ROWS = f"WITH {SPLIT_CTES} SELECT event_id, {{}} FROM parts WHERE split = 'test'"
Y = "CAST(fails_within_30d AS DOUBLE) AS y"
SQL["m2_boosting_isotonic"] = TEST_ROWS.format(f'{Y}, true AS "GradientBoosting_bounded", true AS "GradientBoostingDeep_bounded"')
SQL["m7_stacking"] = TEST_ROWS.format(f"{Y}, 4 AS bases, true AS bounded")
SQL["j5_base_probabilities"] = TEST_ROWS.format(
    ", ".join(f'true AS "{n}_bounded"' for n in ("RandomForest", "GradientBoosting", "GradientBoostingDeep", "LogisticRegression"))
    + ", CAST(0.5 AS DOUBLE) AS p_broken"
)
