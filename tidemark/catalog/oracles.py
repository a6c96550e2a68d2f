"""The registered queries as ANSI SQL over the same tables."""

from __future__ import annotations

from tidemark.plans.scenario import scenarios


def _calendar(raw: str, step: str, columns: str) -> str:
    """Common tables that put ``raw (series_id, ts, ..)`` on a calendar without gaps, as ``s``."""
    return f"""
    raw AS ({raw}),
    bounds AS (SELECT series_id, min(ts) lo, max(ts) hi FROM raw GROUP BY 1),
    cal AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 {step})) ts FROM bounds),
    s AS (SELECT c.series_id, c.ts,
                 CAST(row_number() OVER (PARTITION BY c.series_id ORDER BY c.ts) - 1 AS BIGINT) t, {columns}
          FROM cal c LEFT JOIN raw r ON r.series_id = c.series_id AND r.ts = c.ts)"""


SUPPLIERS = _calendar(
    "SELECT CAST(l_suppkey AS VARCHAR) series_id, date_trunc('month', l_shipdate) ts, sum(l_quantity) y FROM lineitem GROUP BY 1, 2",
    "MONTH", "coalesce(r.y, 0.0) y",
)
REVENUE = _calendar(
    "SELECT c_mktsegment series_id, date_trunc('month', o_orderdate) ts, sum(o_totalprice) y"
    " FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    "MONTH", "coalesce(r.y, 0.0) y",
)
SHIPMENTS = _calendar(
    "SELECT l_returnflag series_id, date_trunc('day', l_shipdate) ts, sum(l_quantity) y FROM lineitem GROUP BY 1, 2",
    "DAY", "coalesce(r.y, 0.0) y",
)
HOLIDAYS = """CASE strftime(c.ts, '%m-%d') WHEN '01-01' THEN 'NewYear' WHEN '05-01' THEN 'MayDay'
              WHEN '12-25' THEN 'Christmas' ELSE 'no' END public_holiday"""
ORDERS = _calendar(
    "SELECT o_orderpriority series_id, date_trunc('day', o_orderdate) ts, CAST(count(*) AS DOUBLE) y FROM orders GROUP BY 1, 2",
    "DAY", f"coalesce(r.y, 0.0) y, {HOLIDAYS}",
)
EVENTS = _calendar(
    "SELECT event_type series_id, date_trunc('hour', ts) ts, CAST(count(*) AS DOUBLE) y, avg(value) v, max(value) w FROM events GROUP BY 1, 2",
    "HOUR", "coalesce(r.y, 0.0) y, r.v v0, r.w w0",
) + """,
    e AS (SELECT series_id, ts, t, y, CASE WHEN t % 17 <> 3 THEN v0 END v, CASE WHEN t % 13 <> 5 THEN w0 END w FROM s)"""

MARKED = """m AS (SELECT series_id, ts, t, CASE
        WHEN month(ts) = 5 AND isodow(ts) = 7 AND day(ts) BETWEEN 8 AND 14 THEN 'MothersDay'
        WHEN month(ts) = 2 AND day(ts) = 14 THEN 'Valentine' ELSE public_holiday END public_holiday FROM s)"""


def r(expression: str, digits: int = 6) -> str:
    return f"floor(({expression}) * 1e{digits} + 0.5003) / 1e{digits}"


def _full(expression: str, n: int, last: int = -1, partition: str = "series_id", order: str = "t") -> str:
    """Aggregate ``expression`` over the n rows ending ``last`` rows from here, NULL unless all are present."""
    def bound(k: int) -> str:
        return "CURRENT ROW" if k == 0 else f"{-k} PRECEDING"

    over = f"OVER (PARTITION BY {partition} ORDER BY {order} ROWS BETWEEN {bound(last - n + 1)} AND {bound(last)})"
    return f"CASE WHEN count(y) {over} = {n} THEN {expression} {over} END"


BY_T = "OVER (PARTITION BY series_id ORDER BY t)"


def _lag(n: int, c: str = "y") -> str:
    return f"lag({c}, {n}) {BY_T}"


def _split(source: str, share: float, name: str = "p") -> str:
    return f"""{name} AS (SELECT *, CASE WHEN t < n_train THEN 'train' ELSE 'test' END split FROM
        (SELECT *, CAST(floor(count(*) OVER (PARTITION BY series_id) * {share}) AS BIGINT) n_train FROM {source}))"""


ORACLES: dict[str, str] = {}

ORACLES["q_densify"] = f"WITH {SUPPLIERS} SELECT series_id, strftime(ts, '%Y-%m-%d') AS day, t, {r('y')} AS y FROM s"
ORACLES["q_lags"] = f"WITH {SUPPLIERS} SELECT series_id, t, " + ", ".join(
    f"{r(_lag(i))} AS stat_y_lag{i}" for i in (1, 2, 3)) + " FROM s"
ORACLES["q_seasonal_lags"] = f"WITH {SUPPLIERS} SELECT series_id, t, " + ", ".join(
    f"{r(_lag(11 + i))} AS stat_y_seaslag{i}" for i in (1, 2, 3)) + " FROM s"
ORACLES["q_seasonal_diff"] = f"WITH {SUPPLIERS} SELECT series_id, t, {r('y - ' + _lag(12))} AS dy FROM s"
ORACLES["q_rolling"] = f"""WITH {SUPPLIERS} SELECT series_id, t,
    {r(_full('avg(y)', 12))} AS stat_y_rolling_mean12, {r(_full('max(y)', 12))} AS stat_y_rolling_max12 FROM s"""
ORACLES["q_rolling_seasonal"] = f"""WITH {SUPPLIERS} SELECT series_id, t,
    {r(_full('avg(y)', 6, -13))} AS stat_y_rolling_seasonal_mean6, {r(_full('max(y)', 6, -13))} AS stat_y_rolling_seasonal_max6 FROM s"""
ORACLES["q_rolling_weekday"] = f"""WITH {SHIPMENTS}, d AS (SELECT *, isodow(ts) wd FROM s) SELECT series_id, t,
    {r(_full('avg(y)', 4, partition='series_id, wd'))} AS stat_y_weekday_rolling_mean4,
    {r(_full('max(y)', 4, partition='series_id, wd'))} AS stat_y_weekday_rolling_max4 FROM d"""
ORACLES["q_position"] = """SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS BIGINT) AS t, first_order, n
    FROM (SELECT CAST(o_custkey AS VARCHAR) series_id, o_orderdate ts, min(o_orderkey) first_order, count(*) n FROM orders GROUP BY 1, 2)"""
_BEFORE = "OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_MOVING = "OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"
ORACLES["q_standardize_expanding"] = f"""WITH {SUPPLIERS} SELECT series_id, t, count(y) {_BEFORE} AS n_seen,
    {r(f'avg(y) {_BEFORE}', 5)} AS mean_seen, {r(f'stddev_samp(y) {_BEFORE}', 5)} AS std_samp_seen,
    {r(f'stddev_pop(y) {_BEFORE}', 5)} AS std_pop_seen,
    {r(f'CASE WHEN count(y) {_MOVING} = 24 THEN avg(y) {_MOVING} END', 5)} AS mean_moving,
    {r(f'CASE WHEN count(y) {_MOVING} = 24 THEN stddev_samp(y) {_MOVING} END', 5)} AS std_moving FROM s"""

# --- calendar ---
ORACLES["q_date_parts"] = f"""WITH {EVENTS} SELECT series_id, t, CAST(month(ts) AS INT) AS cal_date_month,
    CAST(day(ts) AS INT) AS cal_date_day_of_month, CAST(isodow(ts) - 1 AS INT) AS cal_date_weekday, CAST(hour(ts) AS INT) AS cal_date_hour FROM e"""
ORACLES["q_valentine_mothersday"] = f"WITH {ORDERS}, {MARKED} SELECT series_id, t, public_holiday FROM m"


def _counter(name: str, condition: str) -> str:
    return f"""CAST(coalesce(max(CASE WHEN {condition} THEN t END)
        OVER (PARTITION BY series_id ORDER BY t RANGE BETWEEN 3 PRECEDING AND 7 FOLLOWING) - t, 99) AS INT) AS {name}"""


_ANY = _counter("\"cal_PublicHoliday_Counter\"", "public_holiday <> 'no'")
ORACLES["q_holiday_counters"] = f"WITH {ORDERS}, {MARKED} SELECT series_id, t, {_ANY} FROM m"
_DAYS = ", ".join(_counter(f'"cal_{d}_Counter"', f"public_holiday = '{d}'") for d in ("Valentine", "MothersDay"))
ORACLES["q_special_day_counters"] = f"WITH {ORDERS}, {MARKED} SELECT series_id, t, {_ANY}, {_DAYS} FROM m"
ORACLES["q_holiday_counters_sparse"] = f"""WITH {ORDERS}, {MARKED},
    h AS (SELECT series_id, t + k t, max(t) last FROM (SELECT series_id, t, unnest([-14, -7, 0, 7]) k FROM m WHERE public_holiday <> 'no') GROUP BY 1, 2)
    SELECT m.series_id, m.t, CAST(coalesce(h.last - m.t, 99) AS INT) AS "cal_PublicHoliday_Counter"
    FROM m LEFT JOIN h ON h.series_id = m.series_id AND h.t = m.t"""

# --- preparation ---
ORACLES["q_resample_week"] = f"""WITH {SHIPMENTS} SELECT series_id, strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%Y-%m-%d') AS week_end,
    {r('sum(y)')} AS y, {r('avg(y)')} AS level, {r('avg(CAST(month(ts) AS DOUBLE))')} AS month FROM s GROUP BY 1, 2"""
ORACLES["q_resample_month"] = f"""WITH {SHIPMENTS} SELECT series_id, strftime(last_day(ts), '%Y-%m-%d') AS month_end, {r('avg(y)')} AS y FROM s GROUP BY 1, 2"""
ORACLES["q_onehot"] = "SELECT c_custkey, " + ", ".join(
    f"CAST(c_mktsegment = '{v}' AS INT) AS \"c_mktsegment_{v}\"" for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
) + " FROM customer"
ORACLES["q_condense"] = f"SELECT l_orderkey, l_linenumber, {r('l_discount + l_tax')} AS rates FROM lineitem"
ORACLES["q_drop_columns"] = "SELECT s_suppkey, s_nationkey FROM supplier"
ORACLES["q_drop_dates"] = f"""WITH {SHIPMENTS} SELECT series_id, strftime(ts, '%Y-%m-%d') AS day, {r('y')} AS y FROM s
    WHERE NOT (CAST(ts AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-06-30')"""
ORACLES["q_set_types"] = """SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, CAST(p_size AS DOUBLE) AS p_size,
    CAST(p_retailprice AS DOUBLE) AS p_retailprice, p_brand FROM part"""
ORACLES["q_dup_columns"] = """WITH c AS (SELECT bool_and(o_totalprice IS NOT DISTINCT FROM o_totalprice) a,
    bool_and(o_orderstatus IS NOT DISTINCT FROM o_orderstatus) b FROM orders)
    SELECT 'price_copy' AS column_name, 'o_totalprice' AS same_as FROM c WHERE a UNION ALL
    SELECT 'status_copy', 'o_orderstatus' FROM c WHERE b"""
ORACLES["q_nan_zero"] = "SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 0.0 ELSE value END AS value FROM events"
ORACLES["q_missing_check"] = f"""WITH {EVENTS} SELECT series_id, bool_or(y IS NULL) AS y_missing, bool_or(v IS NULL) AS v_missing,
    bool_or(w IS NULL) AS w_missing FROM e GROUP BY 1"""
ORACLES["q_variants"] = f"""WITH {SHIPMENTS} SELECT series_id, 'ship' AS variant, count(*) AS n, {r('sum(y)', 2)} AS total FROM s GROUP BY 1
    UNION ALL SELECT series_id, 'ship_before_break', count(*), {r('sum(y)', 2)} FROM s WHERE ts < TIMESTAMP '1998-01-01' GROUP BY 1"""

_HOLES = f"{EVENTS}, {_split('e', 0.8)}"


def _simple_fill(aggregate: str) -> str:
    parts = ", ".join(
        f"CASE WHEN count({c}) < count(*) THEN {aggregate}({c}) END f{c}" for c in ("v", "w"))
    return f"""WITH {_HOLES}, f AS (SELECT series_id, {parts} FROM p WHERE split = 'train' GROUP BY 1)
        SELECT p.series_id, p.t, {r('coalesce(v, fv)')} AS v, {r('coalesce(w, fw)')} AS w FROM p JOIN f ON f.series_id = p.series_id"""


ORACLES["q_impute_mean"] = _simple_fill("avg")
ORACLES["q_impute_median"] = _simple_fill("median")


def _neighbours(c: str, o: str) -> str:
    return f"""k{c} AS (SELECT series_id, t, avg(dv) f FROM (
        SELECT a.series_id, a.t, d.{c} dv, row_number() OVER (PARTITION BY a.series_id, a.t ORDER BY (a.{o} - d.{o}) * (a.{o} - d.{o}) * 2, d.t) k
        FROM p a JOIN p d ON d.series_id = a.series_id AND d.split = 'train' AND d.{c} IS NOT NULL AND d.{o} IS NOT NULL
        WHERE a.{c} IS NULL AND a.{o} IS NOT NULL) WHERE k <= 10 GROUP BY 1, 2)"""


ORACLES["q_impute_knn"] = f"""WITH {_HOLES}, {_neighbours('v', 'w')}, {_neighbours('w', 'v')},
    f AS (SELECT series_id, CASE WHEN count(v) < count(*) THEN avg(v) END fv, CASE WHEN count(w) < count(*) THEN avg(w) END fw
          FROM p WHERE split = 'train' GROUP BY 1)
    SELECT p.series_id, p.t, {r('coalesce(p.v, kv.f, fv)')} AS v, {r('coalesce(p.w, kw.f, fw)')} AS w
    FROM p JOIN f ON f.series_id = p.series_id LEFT JOIN kv ON kv.series_id = p.series_id AND kv.t = p.t
    LEFT JOIN kw ON kw.series_id = p.series_id AND kw.t = p.t"""
ORACLES["q_imputed_split"] = f"""WITH {EVENTS}, n AS (SELECT *, count(*) OVER (PARTITION BY series_id) n FROM e),
    f AS (SELECT *, unnest(generate_series(0, CAST(ceil(n / 360.0) AS INT) - 1)) fold FROM n),
    g AS (SELECT *, t < least(240 + fold * 120, n) tr FROM f WHERE t < 360 + fold * 120),
    m AS (SELECT series_id, fold, CASE WHEN count(v) < count(*) THEN avg(v) END fv, CASE WHEN count(w) < count(*) THEN avg(w) END fw
          FROM g WHERE tr GROUP BY 1, 2)
    SELECT g.series_id, CAST(g.fold AS INT) AS fold, t, CASE WHEN tr THEN 'train' ELSE 'test' END AS split,
    {r('coalesce(v, fv)')} AS v, {r('coalesce(w, fw)')} AS w FROM g JOIN m ON m.series_id = g.series_id AND m.fold = g.fold"""
ORACLES["q_quantile"] = f"SELECT CAST(l_suppkey AS VARCHAR) AS series_id, {r('quantile_cont(l_extendedprice, 0.9)', 4)} AS p90 FROM lineitem GROUP BY 1"

# --- splits and transforms ---
_SUP8 = f"{SUPPLIERS}, {_split('s', 0.8)}"
ORACLES["q_split_pct"] = f"WITH {_SUP8} SELECT series_id, t, split, n_train FROM p"
ORACLES["q_split_ts"] = f"""WITH {SUPPLIERS}, n AS (SELECT *, count(*) OVER (PARTITION BY series_id) n FROM s),
    f AS (SELECT *, unnest(generate_series(0, CAST(ceil(n / 36.0) AS INT) - 1)) fold FROM n),
    g AS (SELECT *, least(24 + fold * 12, n) n_train FROM f)
    SELECT series_id, CAST(fold AS INT) AS fold, t, CASE WHEN t < n_train THEN 'train' ELSE 'test' END AS split, CAST(n_train AS BIGINT) AS n_train
    FROM g WHERE t < n_train + 12"""
ORACLES["q_split_shuffle"] = f"""WITH {SUPPLIERS}, n AS (SELECT series_id, count(*) n FROM s GROUP BY 1 HAVING count(*) >= 30),
    f AS (SELECT series_id, n, CAST(ceil(n * 0.2) AS BIGINT) k, unnest(generate_series(0, 4)) fold FROM n)
    SELECT series_id, CAST(fold AS INT) AS fold, 'test' AS split, k AS n FROM f
    UNION ALL SELECT series_id, CAST(fold AS INT), 'train', n - k FROM f"""
ORACLES["q_standardize"] = f"""WITH {_SUP8}, f AS (SELECT series_id, avg(y) m, stddev_samp(y) d FROM p WHERE split = 'train' GROUP BY 1)
    SELECT p.series_id, t, {r('(y - m) / CASE WHEN d = 0 THEN 1 ELSE d END')} AS y FROM p JOIN f ON f.series_id = p.series_id"""
ORACLES["q_log"] = f"""WITH {SUPPLIERS}, f AS (SELECT series_id, CAST(bool_or(y = 0) AS INT) z FROM s GROUP BY 1)
    SELECT s.series_id, t, {r('ln(y + z)')} AS y, z AS log_shift FROM s JOIN f ON f.series_id = s.series_id"""
_YJ = "CASE WHEN abs(lam) < 1e-9 THEN ln(1 + y) ELSE (pow(y + 1, lam) - 1) / lam END"
ORACLES["q_power"] = f"""WITH {REVENUE}, {_split('(SELECT series_id, t, y / 1e6 y FROM s)', 0.8)},
    g AS (SELECT series_id, y, lam, {_YJ} z FROM p, (SELECT -2 + k * CAST(0.25 AS DOUBLE) lam FROM generate_series(0, 16) x(k)) WHERE split = 'train'),
    l AS (SELECT series_id, lam, avg(z) m, stddev_pop(z) d, -count(*) / 2.0 * ln(var_pop(z)) + (lam - 1) * sum(ln(1 + y)) ll FROM g GROUP BY 1, 2)
    SELECT series_id, {r('arg_max(lam, ll)')} AS lambda, {r('arg_max(m, ll)')} AS z_mean, {r('arg_max(d, ll)')} AS z_std FROM l GROUP BY 1"""
ORACLES["q_pca_variance"] = f"""WITH {SUPPLIERS}, b AS (SELECT * FROM (SELECT series_id, t - 1 t, y, {_lag(1)} before FROM s) WHERE before IS NOT NULL),
    {_split('b', 0.8)}, c AS (SELECT series_id, (1 + abs(corr(y, before))) / 2 share FROM p WHERE split = 'train' GROUP BY 1)
    SELECT series_id, CASE WHEN share > 0.95 THEN 1 ELSE 2 END AS n_components, {r('share')} AS share FROM c"""
_SCENARIOS = ", ".join(
    f"({s['scenario_id']}, {s['start_off']}, {s['end_off']}, {s['slope']}, {s['max_factor']})" for s in scenarios(12))
ORACLES["q_ramp"] = f"""WITH {REVENUE}, {_split('s', 0.6)},
    c AS (SELECT * FROM (VALUES {_SCENARIOS}) x(scenario_id, so, eo, slope, m)),
    q AS (SELECT series_id, scenario_id, t, y, CAST(slope AS DOUBLE) slope, CAST(m AS DOUBLE) m, n_train + so st, n_train + eo en, abs(round(CAST(m AS DOUBLE) - 1, 3)) a FROM p, c),
    k AS (SELECT *, floor(st + a / slope) full_up, floor(en - a / slope) down FROM q),
    g AS (SELECT *, full_up <= down AND a >= slope ok, greatest(least(least(greatest(t - st + 1, 0), full_up - st + 1) * slope, a)
          - greatest(t - down + 1, 0) * slope, 0.0) lev FROM k)
    SELECT series_id, CAST(scenario_id AS INT) AS scenario_id, t, CASE WHEN ok THEN 'ok' ELSE 'infeasible' END AS status,
    {r('CASE WHEN ok AND t >= st AND t < en THEN y * (1 + sign(m - 1) * lev) ELSE y END', 4)} AS y FROM g"""

# --- baselines and metrics ---


def _walk(k: int) -> str:
    return f"""WITH {_SUP8}, l AS (SELECT series_id, t - (n_train - {k}) ph, y last FROM p WHERE t >= n_train - {k} AND t < n_train)
        SELECT p.series_id, p.t, {r(f'coalesce(lag(y, {k}) OVER (PARTITION BY p.series_id ORDER BY p.t), -9999.0)')} AS one_step,
        {r(f"CASE WHEN split = 'test' THEN last ELSE lag(y, {k}) OVER (PARTITION BY p.series_id ORDER BY p.t) END")} AS many_steps
        FROM p LEFT JOIN l ON l.series_id = p.series_id AND split = 'test' AND l.ph = (p.t - n_train) % {k}"""


ORACLES["q_rw"] = _walk(1)
ORACLES["q_seasonal_rw"] = _walk(12)
_TRAIN_MEAN = "(SELECT series_id, avg(y) m FROM p WHERE split = 'train' GROUP BY 1)"
ORACLES["q_hist_avg"] = f"""WITH {_SUP8}, f AS {_TRAIN_MEAN} SELECT p.series_id, t,
    {r("CASE WHEN split = 'test' THEN avg(y) OVER (PARTITION BY p.series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ELSE m END")} AS one_step,
    {r('m')} AS many_steps FROM p JOIN f ON f.series_id = p.series_id"""
ORACLES["q_drop_dummy"] = f"WITH {SUPPLIERS} SELECT * FROM (SELECT series_id, t, {r(_lag(12))} AS prediction FROM s) WHERE prediction IS NOT NULL"
ORACLES["q_rmse_baselines"] = f"""WITH {_SUP8}, f AS {_TRAIN_MEAN},
    l AS (SELECT series_id, t - n_train + 12 ph, y last FROM p WHERE t >= n_train - 12 AND t < n_train),
    a AS (SELECT p.series_id, p.y, m, l.last seas, l1.last rw FROM p JOIN f ON f.series_id = p.series_id
          JOIN l ON l.series_id = p.series_id AND l.ph = (p.t - n_train) % 12 JOIN l l1 ON l1.series_id = p.series_id AND l1.ph = 11 WHERE split = 'test'),
    b AS (SELECT series_id, 'rw' model, y, rw q FROM a UNION ALL SELECT series_id, 'seasonal_rw', y, seas FROM a
          UNION ALL SELECT series_id, 'hist_avg', y, m FROM a)
    SELECT series_id, model, {r('sqrt(avg((q - y) * (q - y)))')} AS rmse, 'ok' AS status FROM b GROUP BY 1, 2"""

RUNS = """runs AS (SELECT *, n_cps * CAST(20 AS DOUBLE) rmse_base FROM (SELECT l_suppkey param_id, l_linenumber - 1 scenario_id,
    CASE l_returnflag WHEN 'A' THEN 20 WHEN 'N' THEN 50 ELSE 100 END season, sum(l_quantity) rmse, count(*) n_cps, max(l_orderkey) n_refits
    FROM lineitem GROUP BY 1, 2, 3)), rr AS (SELECT *, rmse / rmse_base rmse_ratio FROM runs)"""
_VALUES = ("rmse", "rmse_ratio", "rmse_base")
ORACLES["q_run_summary"] = f"""WITH {RUNS} SELECT param_id, season, """ + ", ".join(
    [f"{r(f'avg({v})', 5)} AS {v}_mean, {r(f'stddev_pop({v})', 5)} AS {v}_std" for v in _VALUES]
) + f""", CAST(sum(n_cps) AS BIGINT) AS n_cps, CAST(sum(n_refits) AS BIGINT) AS n_refits, {r('median(rmse_ratio)', 5)} AS rmse_ratio_median
    FROM rr GROUP BY GROUPING SETS ((param_id, season), (param_id))"""
ORACLES["q_pivot_scenarios_by_season"] = f"WITH {RUNS} SELECT param_id, CAST(season AS INT) AS season, " + ", ".join(
    f"{r(f'max(CASE WHEN scenario_id = {s} THEN {v} END)')} AS {v}_scen{s}" for v in _VALUES for s in range(7)
) + " FROM rr GROUP BY 1, 2"
ORACLES["q_rmse_ratio"] = f"""WITH {RUNS}, b AS (SELECT scenario_id, season, avg(rmse) m FROM runs GROUP BY 1, 2)
    SELECT param_id, CAST(scenario_id AS INT) AS scenario_id, CAST(season AS INT) AS season, {r('rmse / m')} AS rmse_ratio FROM runs JOIN b USING (scenario_id, season)"""
ORACLES["q_fold_summary_by_season"] = f"""WITH {RUNS} SELECT param_id, CAST(season AS INT) AS season, {r('avg(rmse)')} AS rmse_mean, {r('stddev_pop(rmse)')} AS rmse_std,
    string_agg(CAST(CAST(rmse AS BIGINT) AS VARCHAR), ',' ORDER BY scenario_id) AS folds FROM runs GROUP BY 1, 2"""
ORACLES["q_best_setting"] = f"""WITH {RUNS}, c AS (SELECT season, param_id, avg(rmse) m, stddev_pop(rmse) d FROM runs GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY m, param_id) k FROM c WHERE d <> 0)
    SELECT CAST(season AS INT) AS season, param_id AS config_id, {r('m')} AS shuf_cv_rmse_mean, {r('d')} AS shuf_cv_rmse_std FROM k WHERE k = 1"""
_UPTO = "OVER (PARTITION BY season ORDER BY param_id ROWS BETWEEN UNBOUNDED PRECEDING AND {} )"
ORACLES["q_running_best"] = f"""WITH {RUNS}, c AS (SELECT season, param_id, avg(rmse) m FROM runs GROUP BY 1, 2)
    SELECT CAST(season AS INT) AS season, param_id AS config_id, {r('m')} AS rmse_test, {r('min(m) ' + _UPTO.format('CURRENT ROW'))} AS best_so_far,
    coalesce(m < min(m) {_UPTO.format('1 PRECEDING')}, true) AS improved FROM c"""
ORACLES["q_tail"] = f"WITH {_SUP8} SELECT series_id, t, y FROM p WHERE t < n_train AND t >= n_train - 12"

# --- scale, detectors, triggers, augmentation ---
_NOW, _P1, _P2 = _full("avg(y)", 2, 0), _full("avg(y)", 2, -12), _full("avg(y)", 2, -24)
_SCALED = f"""sc AS (SELECT *, (now / nullif(p1, 0) + now / nullif(p2, 0)) / 2 scale FROM
    (SELECT *, {_NOW} now, {_P1} p1, {_P2} p2 FROM {{}}))"""
ORACLES["q_output_scale"] = f"""WITH {SUPPLIERS}, {_SCALED.format('s')}
    SELECT series_id, t, {r('now')} AS mean_now, {r('p1')} AS mean_prev1, {r('p2')} AS mean_prev2, {r('scale')} AS scale FROM sc"""


def _sdar(source: str, name: str) -> str:
    """Recursion of the discounting model of order 1 over ``source (series_id, i, x)``; first value at i = 0."""
    return f"""{name}_1(series_id, i, x, px, mu, c0, c1, sg) AS (
        SELECT series_id, i, x, CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM {source} WHERE i = 0
        UNION ALL
        SELECT series_id, i, x, px, mu, c0, c1, 0.6 * psg + 0.4 * (x - (mu + c1 / CASE WHEN c0 = 0 THEN 1 ELSE c0 END * (px - mu)))
            * (x - (mu + c1 / CASE WHEN c0 = 0 THEN 1 ELSE c0 END * (px - mu))) FROM (
          SELECT series_id, i, x, px, psg, mu, 0.6 * pc0 + 0.4 * (x - mu) * (x - mu) c0, 0.6 * pc1 + 0.4 * (x - mu) * (px - mu) c1 FROM (
            SELECT b.series_id, b.i, b.x, q.x px, q.sg psg, q.c0 pc0, q.c1 pc1, 0.6 * q.mu + 0.4 * b.x mu FROM {name}_1 q JOIN {source} b ON b.series_id = q.series_id AND b.i = q.i + 1))),
    {name} AS (SELECT series_id, i, 0.5 * ln(2 * pi() * greatest(sg, 1e-12)) + (x - f) * (x - f) / (2 * greatest(sg, 1e-12)) loss FROM
        (SELECT *, mu + c1 / CASE WHEN c0 = 0 THEN 1 ELSE c0 END * (px - mu) f FROM {name}_1 WHERE i > 0))"""


# order 1, r 0.4, windows of 4 and 2: the first score belongs to the 8th difference
_CF = f"""{SUPPLIERS},
    df AS (SELECT series_id, t - 12 i, x FROM (SELECT series_id, t, y - {_lag(12)} x FROM s) WHERE t >= 12),
    {_sdar('df', 'first')},
    sm AS (SELECT series_id, i - 4 i, x FROM (SELECT series_id, i, avg(loss) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) x FROM first) WHERE i >= 4),
    {_sdar('sm', 'second')},
    sc AS (SELECT series_id, i + 16 t, x FROM (SELECT series_id, i, avg(loss) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) x FROM second) WHERE i >= 2),
    cf AS (SELECT s.series_id, s.t, s.y, CASE WHEN s.t >= 12 THEN coalesce(sc.x, 0.0) END score FROM s LEFT JOIN sc ON sc.series_id = s.series_id AND sc.t = s.t)"""
ORACLES["q_cf_scores"] = f"WITH RECURSIVE {_CF} SELECT series_id, t, {r('score', 5)} AS score FROM cf"
ORACLES["q_cf_change_points"] = f"""WITH RECURSIVE {_CF}, {_split('cf', 0.6)},
    h AS (SELECT series_id, quantile_cont(score, 0.7) thr FROM p WHERE t < n_train AND score IS NOT NULL GROUP BY 1)
    SELECT p.series_id, t, t - n_train AS "offset", {r('score', 5)} AS score, {r('thr', 5)} AS threshold
    FROM p JOIN h ON h.series_id = p.series_id WHERE t >= n_train AND score >= thr"""
_TRIG = f"""{SUPPLIERS}, {_split('s', 0.6)}, {_SCALED.format('p')},
    fl AS (SELECT series_id, t, scale, coalesce(abs(y / nullif(b, 0) - 1) > 0.3, false) cp, n_train FROM (SELECT *, {_lag(1)} b FROM sc)),
    tr(series_id, t, s_in, r_in, fired, s_out, r_out) AS (
        SELECT series_id, n_train - 1, CAST(1 AS DOUBLE), CAST(-1 AS BIGINT), false, CAST(1 AS DOUBLE), CAST(-1 AS BIGINT) FROM fl WHERE t = n_train
        UNION ALL
        SELECT series_id, t, s_in, r_in, hit, CASE WHEN hit THEN scale ELSE s_in END, CASE WHEN hit THEN t ELSE r_in END FROM (
            SELECT f.series_id, f.t, q.s_out s_in, q.r_out r_in, f.scale,
                   coalesce(f.cp AND f.scale <> 0 AND abs(f.scale - q.s_out) / q.s_out > 0.1, false) hit
            FROM tr q JOIN fl f ON f.series_id = q.series_id AND f.t = q.t + 1)),
    st AS (SELECT tr.*, fl.scale FROM tr JOIN fl ON fl.series_id = tr.series_id AND fl.t = tr.t WHERE tr.t >= fl.n_train),
    ends AS (SELECT series_id, t refit_t, scale FROM st WHERE fired)"""
ORACLES["q_triggers"] = f"WITH RECURSIVE {_TRIG} SELECT series_id, t, fired AS triggered, r_in AS refit_t, {r('s_in')} AS scale_old FROM st"
ORACLES["q_model_in_force"] = f"""WITH RECURSIVE {_TRIG} SELECT series_id, max(r_in) AS last_refit, CAST(count(*) FILTER (WHERE fired) AS BIGINT) AS n,
    true AS same FROM st GROUP BY 1"""
_PAST = "FROM ends e JOIN s ON s.series_id = e.series_id AND s.t <= e.refit_t AND s.t > e.refit_t - 24"
ORACLES["q_training_windows"] = f"""WITH RECURSIVE {_TRIG} SELECT e.series_id, refit_t, count(*) AS n, {r('sum(y)')} AS total, min(t) AS first_t
    {_PAST} GROUP BY 1, 2"""
ORACLES["q_augment_scaled"] = f"WITH RECURSIVE {_TRIG} SELECT e.series_id, refit_t, t, {r('y * scale')} AS y {_PAST}"
ORACLES["q_augment_append"] = f"""WITH RECURSIVE {_TRIG} SELECT e.series_id, refit_t, t, {r('y * scale')} AS y, true AS scaled {_PAST}
    UNION ALL SELECT e.series_id, refit_t, t, {r('y')}, false {_PAST}"""

# --- search ---


def _quoted(*names: str) -> str:
    return "'[' || " + " || ', ' || ".join(f"'\"' || {n} || '\"'" for n in names) + " || ']'"


_B = "(VALUES (1, 'constant'), (2, 'matern'), (3, 'periodic'), (4, 'rbf'), (5, 'rational_quadratic'), (6, 'white'))"
_SINGLE, _A, _BB, _C = _quoted("a.n"), _quoted("a.n"), _quoted("b.n"), _quoted("c.n")
_FORMS = {
    2: [f"{_A} || ', ' || {_BB}", _quoted("a.n", "b.n")],
    3: [f"{_A} || ', ' || {_BB} || ', ' || {_C}", _quoted("a.n", "b.n", "c.n"), f"{_quoted('a.n', 'b.n')} || ', ' || {_C}",
        f"{_A} || ', ' || {_quoted('b.n', 'c.n')}", f"{_quoted('a.n', 'c.n')} || ', ' || {_BB}"],
}
_KERNELS = " UNION ALL ".join(
    [f"SELECT '[' || {_SINGLE} || ']' kernel FROM base a"]
    + [f"SELECT '[' || {f} || ']' FROM base a JOIN base b ON a.i < b.i" for f in _FORMS[2]]
    + [f"SELECT '[' || {f} || ']' FROM base a JOIN base b ON a.i < b.i JOIN base c ON b.i < c.i" for f in _FORMS[3]]
)
ORACLES["q_kernel_grid"] = f"""WITH base(i, n) AS {_B}, g AS ({_KERNELS})
    SELECT series_id, kernel FROM (SELECT DISTINCT c_mktsegment series_id FROM orders JOIN customer ON o_custkey = c_custkey), g"""

# --- files ---
ORACLES["q_csv_roundtrip"] = f"WITH {SHIPMENTS} SELECT series_id, strftime(ts, '%Y-%m-%d') AS day, {r('y')} AS y, {r('y / 8')} AS eighth FROM s"
ORACLES["q_results_roundtrip"] = f"""WITH {RUNS} SELECT param_id, CAST(scenario_id AS INT) AS scenario_id, CAST(season AS INT) AS season, {r('rmse')} AS rmse,
    {r('rmse_base')} AS rmse_base, n_cps, n_refits FROM runs"""

ORACLES["q_gpr_inducing"] = f"""WITH {SHIPMENTS},
    k AS (SELECT *, exp(-0.5 * pow((t / 100.0 - 5) / 2, 2)) k1, exp(-0.5 * pow((t / 100.0 - 15) / 2, 2)) k2, exp(-12.5) c FROM s),
    g AS (SELECT series_id, count(*) n, avg(y) m, stddev_pop(y) sd, sum(k1 * k1) + 0.5 a11, sum(k1 * k2) + 0.5 * any_value(c) a12,
              sum(k2 * k2) + 0.5 a22, sum(k1 * y) b1, sum(k2 * y) b2, sum(k1) s1, sum(k2) s2 FROM k GROUP BY 1),
    w AS (SELECT *, (b1 - m * s1) / sd p1, (b2 - m * s2) / sd p2, a11 * a22 - a12 * a12 det FROM g),
    f AS (SELECT k.series_id, t, n, ((a22 * p1 - a12 * p2) * k1 + (a11 * p2 - a12 * p1) * k2) / det * sd + m prediction,
              1.96 * sd * sqrt(greatest(1 - (k1 * k1 - 2 * c * k1 * k2 + k2 * k2) / (1 - c * c)
                  + 0.5 * (a22 * k1 * k1 - 2 * a12 * k1 * k2 + a11 * k2 * k2) / det, 0)) half
          FROM k JOIN w ON k.series_id = w.series_id)
    SELECT series_id, t, {r("prediction", 4)} prediction, {r("prediction - half", 4)} lower_conf, {r("prediction + half", 4)} upper_conf,
        'inducing' AS method, n AS rows_used FROM f"""

_FINE = "(t % 11) NOT IN (5, 6, 7, 8)"
_WITH_FAILURES = _TRIG.replace("CASE WHEN hit THEN", f"CASE WHEN hit AND {_FINE} THEN")
ORACLES["q_online_failures"] = f"""WITH RECURSIVE {_WITH_FAILURES}
    SELECT series_id, t, fired AS triggered, r_in AS refit_t, {r('s_in')} AS scale_old, fired AND NOT {_FINE} AS failed FROM st"""

# run lengths: lists by run length k, with alpha = 1 + k / 2 and kappa = 1 + k; the hazard is 1 / 48
_RUNS = f"""{EVENTS}, {_split('s', 0.6)},
    df AS (SELECT * FROM (SELECT series_id, t, n_train, y - {_lag(24)} dy FROM p) WHERE dy IS NOT NULL),
    tm AS (SELECT series_id, avg(dy) m, stddev_pop(dy) sd FROM df WHERE t < n_train GROUP BY 1),
    sn AS (SELECT *, avg(dy) OVER b ma, stddev_pop(dy) OVER b sa, row_number() OVER (PARTITION BY series_id ORDER BY t) i
           FROM df WINDOW b AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    z AS (SELECT sn.series_id, i, t, n_train, CASE WHEN t < n_train THEN coalesce((dy - m) / nullif(sd, 0), 0)
            ELSE coalesce((dy - ma) / nullif(sa, 0), 0) END x FROM sn JOIN tm ON tm.series_id = sn.series_id),
    rl(series_id, i, mass, mu, beta) AS (
        SELECT series_id, CAST(0 AS BIGINT), [1.0::DOUBLE], [0.0::DOUBLE], [1.0::DOUBLE] FROM tm
        UNION ALL
        SELECT series_id, i, list_transform(list_prepend(list_sum(grown) / 47, grown), lambda g: g / (list_sum(grown) * 48 / 47)), mu, beta FROM (
            SELECT q.series_id, z.i,
                list_transform(q.mass, lambda g, k: g * 47 / 48 * exp(lgamma(1 + k / 2.0) - lgamma(0.5 + k / 2.0)
                    - 0.5 * ln(2 * pi() * q.beta[k] * (k + 1) / k)
                    - (k + 2) / 2.0 * ln(1 + pow(x - q.mu[k], 2) * k / (2 * q.beta[k] * (k + 1))))) grown,
                list_prepend(0.0::DOUBLE, list_transform(q.mu, lambda a, k: (k * a + x) / (k + 1))) mu,
                list_prepend(1.0::DOUBLE, list_transform(q.beta, lambda c, k: c + k * pow(x - q.mu[k], 2) / (2 * (k + 1)))) beta
            FROM rl q JOIN z ON z.series_id = q.series_id AND z.i = q.i + 1)),
    ru AS (SELECT z.series_id, t, n_train, CAST(list_position(mass, list_max(mass)) - 1 AS BIGINT) run_length
           FROM rl JOIN z ON z.series_id = rl.series_id AND z.i = rl.i)"""
ORACLES["q_bocd_change_points"] = f"""WITH RECURSIVE {_RUNS}
    SELECT series_id, t, run_length, t > n_train AND run_length < lag(run_length) {BY_T} AS change_point FROM ru"""
