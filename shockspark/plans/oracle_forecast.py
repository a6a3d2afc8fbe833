"""Oracle SQL builders for the series / forecast family (DuckDB dialect)."""

from __future__ import annotations



def dense_sql(keyed: bool) -> str:
    """Daily series -> gap-free calendar -> train/test split, per (destination,) metric."""
    k = "destination_id, " if keyed else ""
    part = "destination_id, metric" if keyed else "metric"
    using = "destination_id, metric, date" if keyed else "metric, date"
    blocks = [("bookings", "CAST(SUM(bookings) AS DOUBLE)", "sum"),
              ("search_demand", "CAST(SUM(search_demand) AS DOUBLE)", "sum"),
              ("adr", "AVG(adr)", "mean"), ("cancellations", "CAST(SUM(cancellations) AS DOUBLE)", "sum")]
    grp = "GROUP BY destination_id, date" if keyed else "GROUP BY date"
    ds = "\n  UNION ALL ".join(
        f"SELECT {k}date, '{m}' AS metric, {e} AS value, '{h}' AS how FROM daily_metrics {grp}" for m, e, h in blocks)
    return f"""
ds AS ({ds}),
bnd AS (SELECT {part}, MIN(date) AS lo, MAX(date) AS hi, MIN(how) AS how FROM ds GROUP BY {part}),
cal AS (SELECT {part}, how, lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM bnd),
jn AS (SELECT cal.*, ds.value FROM cal LEFT JOIN ds USING ({using})),
dense AS (SELECT {part}, date, CAST(date_diff('day', lo, date) AS INTEGER) AS t,
  CASE WHEN how = 'mean' THEN COALESCE(value, LAST_VALUE(value IGNORE NULLS) OVER w1, FIRST_VALUE(value IGNORE NULLS) OVER w2, 0.0)
       ELSE COALESCE(value, 0.0) END AS value
  FROM jn WINDOW w1 AS (PARTITION BY {part} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 w2 AS (PARTITION BY {part} ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
split AS (SELECT *, COUNT(*) OVER (PARTITION BY {part}) > 30
  AND date_diff('day', date, MAX(date) OVER (PARTITION BY {part})) < 30 AS is_test FROM dense
  QUALIFY COUNT(*) OVER (PARTITION BY {part}) >= 14),
tr AS (SELECT * FROM split WHERE NOT is_test),
te AS (SELECT * FROM split WHERE is_test)"""


def trend_season_sql(keyed: bool, src: str = "tr", horizon: int = 90, name: str = "fc") -> str:
    """M1 over the rows of ``src`` -> CTE ``name`` (part..., model, date, forecast, lower, upper)."""
    part = "destination_id, metric" if keyed else "metric"
    on = "{a}.destination_id = {b}.destination_id AND {a}.metric = {b}.metric" if keyed else "{a}.metric = {b}.metric"
    sel = ", ".join(f"hz.{c}" for c in part.split(", "))
    return f"""
{name}_fit AS (SELECT {part}, COUNT(*) AS n, COALESCE(regr_slope(value, t), 0.0) AS slope, regr_intercept(value, t) AS icpt0,
  MAX(date) AS train_end, arg_max(value, date) AS last_value, MAX(t) AS t_end FROM {src} GROUP BY {part}),
{name}_fit2 AS (SELECT *, COALESCE(icpt0, last_value) AS icpt FROM {name}_fit),
{name}_res AS (SELECT s.*, dayofweek(s.date) AS dow, s.value - (f.icpt + f.slope * s.t) AS r FROM {src} s
  JOIN {name}_fit2 f ON {on.format(a='s', b='f')}),
{name}_seas AS (SELECT {part}, dow, AVG(r) AS season FROM {name}_res GROUP BY {part}, dow),
{name}_sig AS (SELECT {', '.join('r.' + c for c in part.split(', '))}, STDDEV_SAMP(r.r - s.season) AS sigma FROM {name}_res r
  JOIN {name}_seas s ON {on.format(a='r', b='s')} AND r.dow = s.dow GROUP BY {', '.join('r.' + c for c in part.split(', '))}),
{name}_hz AS (SELECT f.*, u.h, CAST(f.train_end + CAST(u.h AS INTEGER) AS DATE) AS date
  FROM {name}_fit2 f, unnest(generate_series(1, {horizon})) AS u(h)),
{name}_0 AS (SELECT {sel}, 'trend_season' AS model, hz.date, hz.n, hz.last_value,
  CASE WHEN hz.n < 7 THEN hz.last_value ELSE hz.icpt + hz.slope * (hz.t_end + hz.h) + COALESCE(se.season, 0.0) END AS forecast,
  COALESCE(sg.sigma, 0.0) * 1.28 AS band
  FROM {name}_hz hz LEFT JOIN {name}_seas se ON {on.format(a='se', b='hz')} AND se.dow = dayofweek(hz.date)
  LEFT JOIN {name}_sig sg ON {on.format(a='sg', b='hz')}),
{name} AS (SELECT {part}, model, date, forecast,
  CASE WHEN n < 7 THEN last_value * 0.8 ELSE forecast - band END AS lower,
  CASE WHEN n < 7 THEN last_value * 1.2 ELSE forecast + band END AS upper FROM {name}_0)"""


def accuracy_sql(keyed: bool, fc: str = "fc") -> str:
    part = "destination_id, metric" if keyed else "metric"
    on = "f.destination_id = t.destination_id AND f.metric = t.metric" if keyed else "f.metric = t.metric"
    on2 = "a.destination_id = s.destination_id AND a.metric = s.metric" if keyed else "a.metric = s.metric"
    lags = ", ".join(f"LAG(value, {k}) OVER w AS l{k}" for k in range(1, 8))
    return f"""
trl AS (SELECT *, {lags} FROM tr WINDOW w AS (PARTITION BY {part} ORDER BY date)),
sc0 AS (SELECT {part}, COUNT(*) AS n_train, AVG(abs(value - l7)) AS s1,
  AVG(abs(value * 1 + l1 * -7 + l2 * 21 + l3 * -35 + l4 * 35 + l5 * -21 + l6 * 7 + l7 * -1)) AS s2 FROM trl GROUP BY {part}),
sc AS (SELECT {part}, CASE WHEN n_train >= 8 AND s1 <> 0 THEN s1 END AS scale_seasonal,
  CASE WHEN n_train >= 8 AND s2 <> 0 THEN s2 END AS scale_order FROM sc0),
acc0 AS (SELECT {', '.join('f.' + c for c in part.split(', '))}, f.model, AVG(abs(t.value - f.forecast)) AS mae,
  sqrt(AVG((t.value - f.forecast) * (t.value - f.forecast))) AS rmse,
  AVG(abs((t.value - f.forecast) / t.value)) FILTER (WHERE abs(t.value) > 1e-8) * 100 AS mape, COUNT(*) AS n
  FROM {fc} f JOIN te t ON {on} AND f.date = t.date GROUP BY {', '.join('f.' + c for c in part.split(', '))}, f.model),
acc AS (SELECT a.*, a.mae / s.scale_seasonal AS mase, a.mae / s.scale_order AS mase_ref FROM acc0 a LEFT JOIN sc s ON {on2})"""


def seasonal_ar_sql(keyed: bool, src: str = "tr", horizon: int = 90, name: str = "ar") -> str:
    """M3 over the rows of ``src`` -> CTE ``name``.  The normal equations of the centred lags
    are solved by elimination, one lag after the other; the horizon is a recursive query
    that carries the last eight values.  The enclosing WITH must be RECURSIVE."""
    part = "destination_id, metric" if keyed else "metric"
    g = f"GROUP BY {part}"
    return f"""
{name}_l AS (SELECT {part}, date, t, value AS y, LAG(value, 1) OVER w AS a, LAG(value, 7) OVER w AS b, LAG(value, 8) OVER w AS c FROM {src}
  WINDOW w AS (PARTITION BY {part} ORDER BY date)),
{name}_m AS (SELECT {part}, COUNT(*) AS m, AVG(a) AS ma, AVG(b) AS mb, AVG(c) AS mc, AVG(y) AS my,
    covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, b) AS bb, covar_pop(b, c) AS bc, covar_pop(c, c) AS cc,
    covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, covar_pop(c, y) AS cy, var_pop(y) AS yy FROM {name}_l WHERE c IS NOT NULL {g}),
{name}_e1 AS (SELECT *, bb - ab * ab / nullif(aa, 0) AS b1, bc - ab * ac / nullif(aa, 0) AS bc1, cc - ac * ac / nullif(aa, 0) AS c1,
    by_ - ab * ay / nullif(aa, 0) AS y1, cy - ac * ay / nullif(aa, 0) AS z1 FROM {name}_m),
{name}_e2 AS (SELECT *, c1 - bc1 * bc1 / nullif(b1, 0) AS c2, z1 - bc1 * y1 / nullif(b1, 0) AS z2 FROM {name}_e1),
{name}_ok AS (SELECT *, coalesce(aa * b1 * c2 > 1e-9 * aa * bb * cc, false) AS good FROM {name}_e2),
{name}_two AS (SELECT *, coalesce(aa * b1 > 1e-9 * aa * bb, false) AS fair FROM {name}_ok),
{name}_w3 AS (SELECT *, if(good, z2 / c2, 0) AS wc FROM {name}_two),
{name}_w2 AS (SELECT *, if(good OR fair, (y1 - bc1 * wc) / b1, coalesce(by_ / nullif(bb, 0), 0)) AS wb FROM {name}_w3),
{name}_w1 AS (SELECT *, if(good OR fair, (ay - ab * wb - ac * wc) / aa, 0) AS wa FROM {name}_w2),
{name}_fit AS (SELECT *, my - wa * ma - wb * mb - wc * mc AS base,
    if(m > 4, sqrt(greatest(yy - wa * ay - wb * by_ - wc * cy, 0) * m / (m - 4)), 0) AS sigma FROM {name}_w1),
{name}_s AS (SELECT {part}, COUNT(*) AS n, MAX(date) AS train_end, arg_max(value, date) AS last_value,
    list(value ORDER BY date)[-8:] AS recent FROM {src} {g}),
{name}_r AS (SELECT {part}, 0 AS h, n, train_end, last_value, recent, wa, wb, wc, base, sigma FROM {name}_s LEFT JOIN {name}_fit USING ({part})
  UNION ALL SELECT {part}, h + 1, n, train_end, last_value,
    if(n < 30, recent, list_append(recent[-7:], base + wa * recent[-1] + wb * recent[-7] + wc * recent[-8])), wa, wb, wc, base, sigma
  FROM {name}_r WHERE h < {horizon}),
{name} AS (SELECT {part}, 'seasonal_ar' AS model, CAST(train_end + h AS DATE) AS date, if(n < 30, last_value, recent[-1]) AS forecast,
    if(n < 30, last_value * 0.8, recent[-1] - 1.2815515655446004 * sigma) AS lower,
    if(n < 30, last_value * 1.2, recent[-1] + 1.2815515655446004 * sigma) AS upper FROM {name}_r WHERE h > 0)"""


def crisis_pair_sql(start: str, horizon: int = 90) -> str:
    """The fits of ``trend_season_sql`` on the rows before the crisis (nc) and on all
    (al), evaluated on the same days -> CTE x16."""
    def side(p):
        return (f"SELECT f.destination_id, f.metric, d.date, if(f.n < 7, f.last_value, f.icpt + f.slope * date_diff('day', f.train_end - f.t_end, d.date) "
                f"+ coalesce(s.season, 0)) AS forecast, f.n, f.last_value, coalesce(g.sigma, 0) * 1.28 AS band FROM {p}_fit2 f CROSS JOIN days d "
                f"LEFT JOIN {p}_seas s ON s.destination_id = f.destination_id AND s.metric = f.metric AND s.dow = dayofweek(d.date) "
                f"LEFT JOIN {p}_sig g ON g.destination_id = f.destination_id AND g.metric = f.metric")

    def ends(p, name):
        return (f"round({p}.forecast, 6) AS {name}_forecast, round(if({p}.n < 7, {p}.last_value * 0.8, {p}.forecast - {p}.band), 6) AS {name}_lower, "
                f"round(if({p}.n < 7, {p}.last_value * 1.2, {p}.forecast + {p}.band), 6) AS {name}_upper")

    return f"""
days AS (SELECT CAST(DATE '{start}' + CAST(h AS INTEGER) AS DATE) AS date FROM range({horizon}) u(h)),
before AS (SELECT * FROM dense WHERE date < DATE '{start}'),{trend_season_sql(True, 'before', 1, 'nc')},{trend_season_sql(True, 'dense', 1, 'al')},
left_side AS ({side('nc')}),
right_side AS ({side('al')}),
x16 AS (SELECT l.destination_id, l.metric, l.date, {ends('l', 'no_crisis')}, {ends('r', 'crisis')}, round(r.forecast - l.forecast, 6) AS impact
  FROM left_side l JOIN right_side r ON l.destination_id = r.destination_id AND l.metric = r.metric AND l.date = r.date)"""


def regression_sql(name: str, src: str, part: str, y: str, xs: list[str], penalty: dict[str, str] | None = None, more: str = "") -> str:
    """Least squares of ``y`` on ``xs`` with intercept over the complete rows of ``src`` -> CTE
    ``name`` (part, m, mean, variance, beta, base, sigma), by elimination in a recursive query."""
    n, g = len(xs), f"GROUP BY {part}"
    pairs = [(a, b) for i, a in enumerate(xs) for b in xs[i:]]
    whole = " AND ".join(f"{c} IS NOT NULL" for c in [y, *xs])

    def cell(a, b):
        known = f"{a}_{b}" if (a, b) in pairs else f"{b}_{a}"
        return f"{known} * (1 + 1e-6) + {(penalty or {}).get(a, 0)}" if a == b else known

    rows = ", ".join("[" + ", ".join([*(cell(a, b) for b in xs), f"y_{a}"]) + "]" for a in xs)
    own = " + ".join(f"beta[{xs.index(a) + 1}] * beta[{xs.index(b) + 1}] * {a}_{b} * {1 if a == b else 2}" for a, b in pairs)
    return f"""
{name}_m AS (SELECT {part}, COUNT(*) AS m, AVG({y}) AS mean, var_pop({y}) AS variance, {', '.join(f'AVG({x}) AS m_{x}' for x in xs)},
  {', '.join(f'covar_pop({x}, {y}) AS y_{x}' for x in xs)}, {', '.join(f'covar_pop({a}, {b}) AS {a}_{b}' for a, b in pairs)}{more}
  FROM {src} WHERE {whole} {g}),
{name}_e AS (SELECT {part}, 1 AS k, [{rows}] AS a FROM {name}_m
  UNION ALL SELECT {part}, k + 1, if(a[k][k] > 0, list_transform(a, lambda r, i: if(i = k, r, list_transform(r, lambda v, j: v - r[k] / a[k][k] * a[k][j]))), a)
  FROM {name}_e WHERE k <= {n}),
{name}_b AS (SELECT {part}, list_transform(a, lambda r, i: if(r[i] > 0, r[{n + 1}] / r[i], 0)) AS beta FROM {name}_e WHERE k = {n + 1}),
{name} AS (SELECT {part}, m, mean, variance, beta, mean - ({' + '.join(f'beta[{i}] * m_{x}' for i, x in enumerate(xs, 1))}) AS base,
  if(m > {n + 1}, sqrt(greatest(variance - 2 * ({' + '.join(f'beta[{i}] * y_{x}' for i, x in enumerate(xs, 1))}) + ({own}), 0) * m / (m - {n + 1})), 0) AS sigma
  FROM {name}_m JOIN {name}_b USING ({part}))"""


def seasonal_arma_sql(keyed: bool, src: str = "tr", horizon: int = 90, name: str = "sa") -> str:
    """The two regressions of M3 with moving-average terms, the recursion of the forecast and
    that of the psi weights -> CTE ``name``.  The enclosing WITH must be RECURSIVE."""
    part = "destination_id, metric" if keyed else "metric"
    long, own = (1, 2, 3, 7, 8, 14, 15, 21, 22), (1, 7, 8)
    w = f"WINDOW w AS (PARTITION BY {part} ORDER BY date)"
    return f"""
{name}_l AS (SELECT {part}, date, value AS y, {', '.join(f'LAG(value, {k}) OVER w AS y{k}' for k in long)} FROM {src} {w}),{regression_sql(
        name + '_long', name + '_l', part, 'y', [f'y{k}' for k in long])},
{name}_r AS (SELECT l.*, y - base - ({' + '.join(f'beta[{i}] * y{k}' for i, k in enumerate(long, 1))}) AS e FROM {name}_l l JOIN {name}_long USING ({part})),
{name}_t AS (SELECT *, {', '.join(f'LAG(e, {k}) OVER w AS e{k}' for k in own)} FROM {name}_r {w}),{regression_sql(
        name + '_two', name + '_t', part, 'y', [f'y{k}' for k in own] + [f'e{k}' for k in own])},
{name}_s AS (SELECT {part}, MAX(date) AS train_end, arg_max(y, date) AS last_value, list(y ORDER BY date)[-8:] AS recent,
  list(coalesce(e, 0) ORDER BY date)[-8:] AS es FROM {name}_t GROUP BY {part}),
{name}_f AS (SELECT * FROM {name}_s JOIN {name}_two USING ({part})),
{name}_w AS (SELECT {part}, 1 AS n, [1.0::double] AS psi FROM {name}_f
  UNION ALL SELECT {part}, n + 1, list_append(psi, CASE n WHEN 1 THEN beta[4] WHEN 7 THEN beta[5] WHEN 8 THEN beta[6] ELSE 0 END
    + beta[1] * psi[n] + if(n >= 7, beta[2] * psi[n - 6], 0) + if(n >= 8, beta[3] * psi[n - 7], 0)) FROM {name}_w JOIN {name}_f USING ({part}) WHERE n < {horizon}),
{name}_p AS (SELECT {part}, psi, list_max(list_transform(psi[{max(1, horizon - 13)}:], lambda x: abs(x))) <= 1 AS settled FROM {name}_w WHERE n = {horizon}),
{name}_h AS (SELECT {part}, 0 AS h, recent FROM {name}_f
  UNION ALL SELECT {part}, h + 1, list_append(p.recent[-7:], base + beta[1] * p.recent[-1] + beta[2] * p.recent[-7] + beta[3] * p.recent[-8]
    + if(h < 1, beta[4] * es[-1], 0) + if(h < 7, beta[5] * es[h + 2], 0) + if(h < 8, beta[6] * es[h + 1], 0))
  FROM {name}_h p JOIN {name}_f f USING ({part}) WHERE h < {horizon}),
{name}_o AS (SELECT {part}, CAST(train_end + h AS DATE) AS date, m, last_value, if(settled, p.recent[-1], mean) AS f,
  1.2815515655446004 * if(settled, sigma * sqrt(list_sum(list_transform(psi[:h], lambda x: x * x))), sqrt(variance)) AS band
  FROM {name}_h p JOIN {name}_f f USING ({part}) JOIN {name}_p USING ({part}) WHERE h > 0),
{name} AS (SELECT {part}, 'seasonal_arma' AS model, date, if(m < 30, last_value, f) AS forecast,
  if(m < 30, last_value * 0.8, f - band) AS lower, if(m < 30, last_value * 1.2, f + band) AS upper FROM {name}_o)"""


def trend_breaks_sql(keyed: bool, breaks: int, bend: float, crisis: tuple[str, str], src: str = "tr", horizon: int = 90, name: str = "tb") -> str:
    """M1 with breaks on the same basis -> CTE ``name``.  The enclosing WITH must be RECURSIVE."""
    part = "destination_id, metric" if keyed else "metric"
    corners = [0.8 * (i + 1) / (breaks + 1) for i in range(breaks)]
    xs = ["u", *[f"h{i}" for i in range(breaks)], "crisis"]
    hinges = lambda u: ", ".join(f"greatest({u} - {c!r}, 0) AS h{i}" for i, c in enumerate(corners))
    inside = lambda d: f"CAST({d} BETWEEN DATE '{crisis[0]}' AND DATE '{crisis[1]}' AS DOUBLE) AS crisis"
    line = "base + " + " + ".join(f"beta[{i}] * {x}" for i, x in enumerate(xs, 1))
    return f"""
{name}_u AS (SELECT {part}, date, value AS y, t / greatest(MAX(t) OVER (PARTITION BY {part}), 1)::double AS u, {inside('date')},
  value - LAG(value, 7) OVER (PARTITION BY {part} ORDER BY date) AS week FROM {src}),
{name}_x AS (SELECT *, {hinges('u')} FROM {name}_u),{regression_sql(name + '_g', name + '_x', part, 'y', xs, {
        x: f"coalesce(least(noise / nullif(variance, 0), 1), 1) / (m * {bend * bend!r})" for x in xs[1:-1]}, ', var_pop(week) / 2 AS noise')},
{name}_r AS (SELECT {part}, date, dayofweek(date) AS dow, y - ({line}) AS r FROM {name}_x JOIN {name}_g USING ({part})),
{name}_s AS (SELECT {part}, dow, AVG(r) AS season FROM {name}_r GROUP BY {part}, dow),
{name}_v AS (SELECT {part}, COALESCE(STDDEV_SAMP(r - season), 0) AS spread FROM {name}_r JOIN {name}_s USING ({part}, dow) GROUP BY {part}),
{name}_e AS (SELECT {part}, COUNT(*) AS n, MAX(date) AS train_end, arg_max(value, date) AS last_value, greatest(MAX(t), 1)::double AS t_end FROM {src} GROUP BY {part}),
{name}_d AS (SELECT e.*, h, CAST(train_end + CAST(h AS INTEGER) AS DATE) AS date, (t_end + h) / t_end AS u FROM {name}_e e, unnest(generate_series(1, {horizon})) AS q(h)),
{name}_f AS (SELECT *, {hinges('u')}, {inside('date')}, dayofweek(date) AS dow FROM {name}_d),
{name}_o AS (SELECT f.*, {line} + COALESCE(season, 0) AS v,
  1.28 * sqrt(spread * spread + {breaks / 0.8!r} * ({' + '.join(f'beta[{i + 2}] * beta[{i + 2}]' for i in range(breaks))}) / {breaks} * pow(h / t_end, 3) / 3) AS band
  FROM {name}_f f JOIN {name}_g USING ({part}) JOIN {name}_v USING ({part}) LEFT JOIN {name}_s USING ({part}, dow)),
{name} AS (SELECT {part}, 'trend_breaks' AS model, date, if(n < 14, last_value, v) AS forecast, if(n < 14, last_value * 0.8, v - band) AS lower,
  if(n < 14, last_value * 1.2, v + band) AS upper FROM {name}_o)"""
