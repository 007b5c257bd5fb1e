"""The registered queries in DuckDB's SQL."""

from __future__ import annotations

import numpy as np

from tidemark.functions import design

ORACLES: dict[str, str] = {}

_EVENTS = "SELECT event_type AS channel, event_id AS seq, epoch_us(ts) * 1000 AS ts_ns, value FROM events"
_ORDERS = "SELECT o_orderpriority AS channel, o_orderkey AS seq, epoch_us(o_orderdate) * 1000 AS ts_ns, o_totalprice AS value FROM orders"
_END = "SELECT channel, seq, ts_ns, round(value, {d}) + 0.0 AS value FROM r"


def put(name: str, result: str, source: str = _EVENTS, digits: int = 6, more: str = "", final: str | None = None) -> None:
    """Adds a query whose CTE r has the samples; ``more`` are CTEs between s and r."""
    ORACLES[name] = f"WITH RECURSIVE s AS ({source}), {more} r AS ({result}) {final or _END.format(d=digits)}"


def _rolling(expr: str, window_ns: int) -> str:
    return f"SELECT channel, seq, ts_ns, {expr} AS value FROM s WINDOW w AS (PARTITION BY channel ORDER BY ts_ns RANGE BETWEEN {window_ns} PRECEDING AND CURRENT ROW)"


_HOUR = 3600 * 10**9
put("w1_rolling_mean", _rolling("avg(value) OVER w", _HOUR))
put("w2_rolling_rms", _rolling("sqrt(avg(value * value) OVER w)", _HOUR))
put("w3_rolling_min", _rolling("min(value) OVER w", _HOUR))
put("w4_rolling_max", _rolling("max(value) OVER w", _HOUR))
put("w1_rolling_mean_ties", "SELECT a.channel, a.seq, a.ts_ns, avg(b.value) + 1.23e-6 AS value FROM s a JOIN s b ON a.channel = b.channel AND b.ts_ns BETWEEN a.ts_ns - 604800000000000 AND a.ts_ns AND (b.ts_ns, b.seq) <= (a.ts_ns, a.seq) GROUP BY ALL", _ORDERS, 4)

_NEAR = "n AS (SELECT *, lag(ts_ns) OVER w AS pt, lag(value) OVER w AS pv, lead(ts_ns) OVER w AS nt, lead(value) OVER w AS nv, row_number() OVER w AS rn FROM s WINDOW w AS (PARTITION BY channel ORDER BY ts_ns, seq)),"
put("w5_derivative", "SELECT *  EXCLUDE (value), (coalesce(nv, value) - coalesce(pv, value)) / ((coalesce(nt, ts_ns) - coalesce(pt, ts_ns)) / 1e9) AS value FROM n", more=_NEAR)
put("w6_integral", "SELECT channel, seq, ts_ns, coalesce(sum(0.5 * (value + pv) * ((ts_ns - pt) / 1e9)) OVER (PARTITION BY channel ORDER BY ts_ns, seq), 0) AS value FROM n", more=_NEAR, digits=2)
_FILL = "SELECT channel, seq, ts_ns, coalesce({f}(CASE WHEN abs(value - 50) > 25 THEN value END IGNORE NULLS) OVER (PARTITION BY channel ORDER BY ts_ns, seq ROWS BETWEEN {w}), value) AS value FROM s"
put("w7_forward_fill", _FILL.format(f="last_value", w="UNBOUNDED PRECEDING AND CURRENT ROW"))
put("x1_backward_fill", _FILL.format(f="first_value", w="CURRENT ROW AND UNBOUNDED FOLLOWING"))
put("w15_reverse", "SELECT channel, -seq AS seq, min(ts_ns) OVER (PARTITION BY channel) + max(ts_ns) OVER (PARTITION BY channel) - ts_ns AS ts_ns, value FROM s")


def _lag(stage: str, source: str, high: bool = False) -> str:
    """CTEs of one first-order stage over CTE ``source`` with column value, rn, alpha."""
    y = "x.value - l.y" if high else "l.y"
    return (
        f"l{stage} AS (SELECT channel, rn, value AS y FROM {source} WHERE rn = 1 UNION ALL SELECT x.channel, x.rn, x.alpha * x.value + (1 - x.alpha) * l.y FROM l{stage} l JOIN {source} x ON x.channel = l.channel AND x.rn = l.rn + 1), "
        f"y{stage} AS (SELECT x.* EXCLUDE (value), {y} AS value FROM {source} x JOIN l{stage} l ON x.channel = l.channel AND x.rn = l.rn),"
    )


_ALPHA = _NEAR + " d AS (SELECT *, (coalesce(nt, ts_ns) - pt) * CASE WHEN nt IS NULL THEN 1e-9 ELSE 0.5e-9 END AS dt FROM n), a AS (SELECT *, dt / (3600 + dt) AS alpha FROM d),"
put("w8_low_pass", "SELECT * FROM y1", more=_ALPHA + _lag("1", "a"))
put("w9_high_pass", "SELECT * FROM y1", more=_ALPHA + _lag("1", "a", True))
put("w10_pt2", "SELECT * FROM y2", more=_ALPHA + _lag("1", "a") + _lag("2", "y1"))
_BACK = (
    "b0 AS (SELECT channel, -seq AS seq, min(ts_ns) OVER (PARTITION BY channel) + max(ts_ns) OVER (PARTITION BY channel) - ts_ns AS ts_ns, value FROM y1), "
    "b1 AS (SELECT *, lag(ts_ns) OVER w AS pt, lead(ts_ns) OVER w AS nt, row_number() OVER w AS rn FROM b0 WINDOW w AS (PARTITION BY channel ORDER BY ts_ns, seq)), "
    "b2 AS (SELECT *, (coalesce(nt, ts_ns) - pt) * CASE WHEN nt IS NULL THEN 1e-9 ELSE 0.5e-9 END AS dt FROM b1), b3 AS (SELECT *, dt / (3600 + dt) AS alpha FROM b2), "
)
_FLIP = "SELECT channel, -seq AS seq, min(ts_ns) OVER (PARTITION BY channel) + max(ts_ns) OVER (PARTITION BY channel) - ts_ns AS ts_ns, value FROM "
put("w16_filtfilt", _FLIP + "y2", more=_ALPHA + _lag("1", "a") + _BACK + _lag("2", "b3"))
_MEAN = "SELECT channel, seq, ts_ns, avg(value) OVER (PARTITION BY channel ORDER BY ts_ns RANGE BETWEEN 3600000000000 PRECEDING AND CURRENT ROW) AS value FROM "
put("w16_filtfilt_mean", _FLIP + "m2", more=f"m1 AS ({_MEAN}s), v AS ({_FLIP}m1), m2 AS ({_MEAN}v),")


def _interp(grid: str, other: str, gaps: bool = False) -> str:
    """(g.*, other) for CTEs of one name space; other's values at grid's times."""
    keep = "WHERE g.ts_ns BETWEEN e.t0 AND e.t1" if gaps else ""
    return (
        f"SELECT g.*, CASE WHEN lo.ts_ns IS NULL THEN hi.value WHEN hi.ts_ns IS NULL THEN lo.value ELSE lo.value + (g.ts_ns - lo.ts_ns) / (hi.ts_ns - lo.ts_ns)::DOUBLE * (hi.value - lo.value) END AS other "
        f"FROM {grid} g ASOF LEFT JOIN {other} lo ON g.channel = lo.channel AND g.ts_ns > lo.ts_ns ASOF LEFT JOIN {other} hi ON g.channel = hi.channel AND g.ts_ns <= hi.ts_ns "
        f"JOIN (SELECT channel, min(ts_ns) AS t0, max(ts_ns) AS t1 FROM {other} GROUP BY channel) e ON e.channel = g.channel {keep}"
    )


def _pair(a: str = "click", b: str = "purchase") -> str:
    return f"a AS (SELECT 'pair' AS channel, seq, ts_ns, value FROM s WHERE channel = '{a}'), b AS (SELECT 'pair' AS channel, seq, ts_ns, value FROM s WHERE channel = '{b}'),"


_EVEN = (
    "k AS (SELECT channel, min(ts_ns) AS t0, max(ts_ns) AS t1 FROM s GROUP BY channel), "
    "g AS (SELECT channel, i AS seq, t0 + i * {step} AS ts_ns FROM (SELECT *, unnest(range(0, (t1 - t0) // {step} + 1)) AS i FROM k)),"
)
put("f7_resample", "SELECT * EXCLUDE (other), other AS value FROM (" + _interp("g", "s") + ")", more=_EVEN.format(step=900 * 10**9))


def _sections(name: str, sos: np.ndarray) -> None:
    """A cascade by direct recurrences over evenly resampled events."""
    more = _EVEN.format(step=600 * 10**9) + "x0 AS (SELECT channel, seq, ts_ns, seq + 1 AS rn, other AS value FROM (" + _interp("g", "s") + ")),"
    for k, (b0, b1, b2, a1, a2) in enumerate(sos.tolist(), 1):
        more += (
            f"c{k} AS (SELECT channel, rn, {b0!r} * value AS y, value AS x1, 0.0::DOUBLE AS x2, 0.0::DOUBLE AS y1 FROM x{k - 1} WHERE rn = 1 UNION ALL "
            f"SELECT x.channel, x.rn, {b0!r} * x.value + {b1!r} * c.x1 + {b2!r} * c.x2 - {a1!r} * c.y - {a2!r} * c.y1, x.value, c.x1, c.y FROM c{k} c JOIN x{k - 1} x ON x.channel = c.channel AND x.rn = c.rn + 1), "
            f"x{k} AS (SELECT x.* EXCLUDE (value), c.y AS value FROM x{k - 1} x JOIN c{k} c ON x.channel = c.channel AND x.rn = c.rn),"
        )
    put(name, f"SELECT * FROM x{len(sos)}", more=more)


_FS = 1 / 600
_sections("w11_butterworth", design.design("butterworth", 0, 4, (1e-4,), _FS))
_sections("w12_cheby1", design.design("cheby1", 1, 3, (1e-4,), _FS, 1.0))
_sections("w13_cheby2", design.design("cheby2", 2, 2, (1e-4, 3e-4), _FS, 0.0, 30.0))
_sections("w14_elliptic", design.design("elliptic", 3, 3, (1e-4, 3e-4), _FS, 1.0, 40.0))

_V = "(value - 50.0)"
_W = "(value / 200 - 0.25)"
for _name, _sql in {
    "abs": f"abs({_V})", "sqrt": f"CASE WHEN {_V} < 0 THEN 'nan'::DOUBLE ELSE sqrt(abs({_V})) END", "log": f"CASE WHEN {_V} < 0 THEN 'nan'::DOUBLE WHEN {_V} = 0 THEN '-inf'::DOUBLE ELSE ln(nullif(abs({_V}), 0)) END",
    "sin": f"sin({_V})", "cos": f"cos({_V})", "tan": f"tan({_V})", "asin": f"CASE WHEN abs({_W}) <= 1 THEN asin(greatest(-1, least(1, {_W}))) ELSE 'nan'::DOUBLE END",
    "acos": f"CASE WHEN abs({_W}) <= 1 THEN acos(greatest(-1, least(1, {_W}))) ELSE 'nan'::DOUBLE END", "atan": f"atan({_V})", "exp": f"exp({_W})",
    "log10": f"CASE WHEN {_V} < 0 THEN 'nan'::DOUBLE WHEN {_V} = 0 THEN '-inf'::DOUBLE ELSE log10(nullif(abs({_V}), 0)) END", "floor": f"floor({_V})", "ceil": f"ceil({_V})", "round": f"round({_V})", "sign": f"sign({_V})::DOUBLE", "negate": f"-{_V}",
}.items():
    put(f"e_{_name}", f"SELECT channel, seq, ts_ns, {_sql} AS value FROM s")
put("e14_round_tolerance", "SELECT channel, seq, ts_ns, CASE WHEN abs(value - round(value)) <= 0.2 THEN round(value) ELSE value END AS value FROM s")
put("e16_limit", "SELECT channel, seq, ts_ns, greatest(20, least(80, value)) AS value FROM s")
put("e18_round_significant", "SELECT channel, seq, ts_ns, CASE WHEN v = 0 THEN 0 ELSE round(v / p) * p END AS value FROM (SELECT *, value * 1234.5 AS v, pow(10, floor(log10(abs(value * 1234.5))) - 2) AS p FROM s)", digits=3)
ORACLES["e19_as_double"] = "SELECT channel, count(*) AS n, round(sum(value), 2) + 0.0 AS total FROM (SELECT 'l_partkey' AS channel, l_partkey::DOUBLE AS value FROM lineitem UNION ALL SELECT 'l_linenumber', l_linenumber FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem) GROUP BY channel"

_ALIGNED = _pair() + (
    "o AS (SELECT greatest((SELECT min(ts_ns) FROM a), (SELECT min(ts_ns) FROM b)) AS lo, least((SELECT max(ts_ns) FROM a), (SELECT max(ts_ns) FROM b)) AS hi), "
    "ai AS (SELECT a.* FROM a, o WHERE ts_ns BETWEEN lo AND hi), bi AS (SELECT b.* FROM b, o WHERE ts_ns BETWEEN lo AND hi), "
    "u AS (SELECT (SELECT count(*) FROM ai) >= (SELECT count(*) FROM bi) AS use_a), "
    f"p AS (SELECT channel, seq, ts_ns, value AS x, other AS y FROM ({_interp('ai', 'b')}), u WHERE use_a UNION ALL SELECT channel, seq, ts_ns, other, value FROM ({_interp('bi', 'a')}), u WHERE NOT use_a),"
)
for _name, _sql in {
    "add": "x + y", "subtract": "x - y", "multiply": "x * y", "divide": "CASE WHEN y = 0 THEN 'nan'::DOUBLE ELSE x / y END", "power": "pow(x, y)", "mod": "CASE WHEN y = 0 THEN 'nan'::DOUBLE ELSE fmod(x, y) END",
    "atan2": "atan2(x, y)", "min": "least(x, y)", "max": "greatest(x, y)",
}.items():
    _source = _EVENTS.replace(", value FROM", ", CASE event_type WHEN 'click' THEN value / 100 + 0.5 ELSE value / 100 END AS value FROM") if _name == "power" else _EVENTS
    put(f"b_{_name}", f"SELECT channel, seq, ts_ns, {_sql} AS value FROM p", _source, more=_ALIGNED)
put("b10_replace", "SELECT channel, seq, ts_ns, CASE WHEN abs(x - 50) <= 20 THEN y ELSE x END AS value FROM p", more=_ALIGNED)
put("b_same_grid", "SELECT channel, seq, ts_ns, value / (value * value) AS value FROM s")
put("b_scalar", "SELECT channel, seq, ts_ns, 'nan'::DOUBLE AS value FROM s")

ORACLES["j1_same_grid_pairs"] = f"WITH s AS ({_ORDERS}) SELECT channel, seq, ts_ns, round(value, 2) + 0.0 AS a, round(2 * value, 2) + 0.0 AS b FROM s"
_BOTH = "SELECT channel, seq, ts_ns, round(value, 6) + 0.0 AS value, round(other, 6) + 0.0 AS other FROM r"
put("j2_interpolated_clamped", _interp("a", "b"), more=_pair(), final=_BOTH)
put("j3_interpolated_gaps", "SELECT a.*, i.other FROM a LEFT JOIN i ON i.seq = a.seq", more=_pair("purchase", "click") + f"i AS ({_interp('a', 'b', True)}),", final=_BOTH)
put("j5_xy_pairs", _interp("a", "b", True), more=_pair(), final="SELECT channel, seq, ts_ns, round(value, 6) + 0.0 AS x, round(other, 6) + 0.0 AS y FROM r")
_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
put("j4_union_grid", "SELECT *, row_number() OVER (PARTITION BY channel, ts_ns ORDER BY seq) AS occurrence FROM s", _ORDERS,
    final="SELECT ts_ns, occurrence, " + ", ".join(f"round(max(value) FILTER (channel = '{p}'), 2) + 0.0 AS \"{p}\"" for p in _PRIORITIES) + " FROM r GROUP BY ts_ns, occurrence")

_REL = "q AS (SELECT *, ts_ns - min(ts_ns) OVER (PARTITION BY channel) AS rel FROM s),"
put("f1_slice", "SELECT * FROM q WHERE rel BETWEEN 500000000000000 AND 1000000000000000", more=_REL)
put("f2_band_zero", "SELECT * EXCLUDE (value), CASE WHEN rel / 1e9 BETWEEN 5e5 AND 1e6 THEN 0 ELSE value END AS value FROM q", more=_REL)
put("f3_band_keep", "SELECT * EXCLUDE (value), CASE WHEN rel / 1e9 BETWEEN 5e5 AND 1e6 THEN value ELSE 0 END AS value FROM q", more=_REL)
_RUNS = _pair() + (
    f"g AS (SELECT *, other BETWEEN 10 AND 70 AS inside FROM ({_interp('a', 'b')})), "
    "h AS (SELECT *, lag(inside, 1, false) OVER w AS was, lag(ts_ns) OVER w AS pt FROM g WINDOW w AS (ORDER BY ts_ns, seq)), "
    "runs AS (SELECT *, sum(CASE WHEN inside AND NOT was THEN 1 ELSE 0 END) OVER (ORDER BY ts_ns, seq) AS run FROM h), "
    "kept AS (SELECT * FROM runs WHERE inside),"
)
put("f4_gate_real_time", "SELECT * FROM (SELECT *, max(ts_ns) OVER (PARTITION BY run) - min(ts_ns) OVER (PARTITION BY run) AS lasts FROM kept) WHERE lasts >= 1800000000000", more=_RUNS)
_MEDIAN = "steps AS (SELECT ts_ns - pt AS d FROM h WHERE pt IS NOT NULL), med AS (SELECT list_sort(list(d))[count(*) // 2 + 1] AS m FROM steps),"
put("f4_gate_smash", "SELECT channel, seq, first_value(ts_ns) OVER (ORDER BY ts_ns, seq) + sum(step) OVER (ORDER BY ts_ns, seq) AS ts_ns, value FROM (SELECT *, CASE WHEN row_number() OVER (ORDER BY ts_ns, seq) = 1 THEN 0 WHEN NOT was THEN m ELSE ts_ns - pt END AS step FROM kept, med)",
    more=_RUNS + _MEDIAN, final="SELECT channel, seq, ts_ns::BIGINT AS ts_ns, round(value, 6) + 0.0 AS value FROM r")
put("f5_shift", "SELECT channel, seq, ts_ns - 1500000000 AS ts_ns, value FROM s")
put("f6_repeat", "SELECT channel, seq + c * seqs AS seq, ts_ns + c * (span + floor(span / (n - 1) + 0.5)::BIGINT) AS ts_ns, value FROM s JOIN (SELECT channel, count(*) AS n, max(ts_ns) - min(ts_ns) AS span, max(seq) - min(seq) + 1 AS seqs FROM s GROUP BY channel) USING (channel), range(3) t(c)")
put("f8_resample_onto", "SELECT channel, seq, ts_ns, other AS value FROM (" + _interp("b", "a", True) + ")", more=_pair())
put("f9_select_channels", "SELECT * FROM s WHERE channel IN ('click', 'view', 'purchase') AND ts_ns - (SELECT min(ts_ns) FROM s WHERE channel IN ('click', 'view', 'purchase')) <= 1000000000000000")
put("f10_rebase_time", "SELECT channel, seq, (ts_ns - (SELECT min(ts_ns) FROM s)) / 1e9 AS x, value FROM s", final="SELECT channel, seq, round(x, 6) + 0.0 AS x, round(value, 6) + 0.0 AS value FROM r")
put("i8_i9_relative_time", "SELECT channel, seq, ts_ns - arg_min(ts_ns, seq) OVER (PARTITION BY channel) + 5000000000 AS ts_ns, value FROM s")
for _how, _sql in {"first": "arg_min(value, seq)", "last": "arg_max(value, seq)", "mean": "avg(value) + 1.23e-6"}.items():
    put(f"i10_collapse_{_how}", f"SELECT channel, min(seq) AS seq, ts_ns, {_sql} AS value FROM s GROUP BY channel, ts_ns", _ORDERS, 2)
_STAIRS = "SELECT event_type AS channel, event_id AS seq, epoch_us(ts) * 1000 AS ts_ns, floor(value / 50) AS value FROM events"
_PLATEAUS = "p AS (SELECT *, lag(value) OVER w AS pv FROM s WINDOW w AS (PARTITION BY channel ORDER BY ts_ns, seq)), z AS (SELECT *, sum(CASE WHEN pv IS NULL OR pv <> value THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY ts_ns, seq) AS run FROM p),"
for _how, _f in {"first": "arg_min", "last": "arg_max"}.items():
    put(f"i11_plateaus_{_how}", f"SELECT channel, {_f}(seq, ts_ns) AS seq, {_f}(ts_ns, ts_ns) AS ts_ns, any_value(value) AS value FROM z GROUP BY channel, run", _STAIRS, more=_PLATEAUS)
_REPEATS = "p AS (SELECT *, lag({c}) OVER w AS pv FROM s WINDOW w AS (PARTITION BY channel ORDER BY ts_ns, seq)),"
_COUNTED = "SELECT channel, count(*) AS n, sum(CASE WHEN pv = {c} THEN 1 ELSE 0 END)::BIGINT AS repeats FROM p GROUP BY channel"
put("q3_duplicate_instants", _COUNTED.format(c="ts_ns"), _ORDERS, more=_REPEATS.format(c="ts_ns"), final="SELECT *, n >= 2 AND repeats * 10 > n AS warn FROM r")
put("q4_value_plateaus", _COUNTED.format(c="value"), _STAIRS, more=_REPEATS.format(c="value"), final="SELECT *, n >= 2 AND repeats * 10 > 3 * n AS warn FROM r")
put("q5_shared_write_loss", _COUNTED.format(c="ts_ns"), _ORDERS, more=_REPEATS.format(c="ts_ns"),
    final="SELECT count(*) AS channels, sum(repeats)::BIGINT AS dropped, (SELECT channel FROM r ORDER BY repeats DESC, channel LIMIT 1) AS worst_channel, max(repeats) AS worst_dropped FROM r WHERE repeats > 0")

_FACTS = (
    "i AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY ts_ns, seq) - 1 AS i FROM s), "
    "f AS (SELECT channel, count(*) AS n, 1.0 / ((max(ts_ns) - min(ts_ns)) * 1e-9 / (count(*) - 1)) AS fs, greatest(2, pow(2, ceil(log2(count(*)))))::BIGINT AS n_fft FROM s GROUP BY channel), "
)


def _dft(weight: str) -> str:
    return _FACTS + (
        f"x AS (SELECT channel, i, value, n, fs, n_fft, {weight} AS w FROM i JOIN f USING (channel)), ks AS (SELECT channel, unnest(range(0, n_fft // 2 + 1)) AS k FROM f), "
        "d AS (SELECT channel, k, any_value(fs) AS fs, any_value(n_fft) AS n_fft, sum(w) AS ws, sum(value * w * cos(2 * pi() * ((k * i) % n_fft) / n_fft)) AS re, -sum(value * w * sin(2 * pi() * ((k * i) % n_fft) / n_fft)) AS im FROM x JOIN ks USING (channel) GROUP BY channel, k), "
        "m AS (SELECT *, sqrt(re * re + im * im) AS m, floor(k * (fs / n_fft) * 1e9 + 0.5)::BIGINT AS ts_ns FROM d),"
    )


_HANN = "0.5 - 0.5 * cos(2 * pi() * i / (n - 1))"
_FLAT = "0.21557895 - 0.41663158 * cos(2 * pi() * i / (n - 1)) + 0.277263158 * cos(4 * pi() * i / (n - 1)) - 0.083578947 * cos(6 * pi() * i / (n - 1)) + 0.006947368 * cos(8 * pi() * i / (n - 1))"
_AMPLITUDE = "SELECT channel, k AS seq, ts_ns, m * CASE WHEN k = 0 OR k * 2 = n_fft THEN 1 ELSE 2 END / ws AS value FROM m"
put("p1_fft", _AMPLITUDE, more=_dft(_HANN), digits=5)
put("p1_fft_flat_top", _AMPLITUDE, more=_dft(_FLAT), digits=5)
put("p2_rfft_magnitude", "SELECT channel, k AS seq, ts_ns, m AS value FROM m", more=_dft("1.0"), digits=3)
put("p3_rfft_phase", "SELECT channel, k AS seq, ts_ns, CASE WHEN abs(atan2(im, re)) > 3.14159 THEN pi() ELSE atan2(im, re) END AS value FROM m", more=_dft("1.0"), digits=4)
put("p4_revert_fft", "SELECT f.channel, j AS seq, t0 + floor(j * (1e9 / (f.n_fft * df)) + 0.5)::BIGINT AS ts_ns, coalesce(i.value, 0) AS value FROM (SELECT *, unnest(range(0, n_fft)) AS j FROM f) f JOIN z ON z.channel = f.channel LEFT JOIN i ON i.channel = f.channel AND i.i = j",
    more=_FACTS + "z AS (SELECT s.channel, min(ts_ns) AS t0, floor(any_value(fs / n_fft) * 1e9 + 0.5) / 1e9 AS df FROM s JOIN f USING (channel) GROUP BY s.channel),", digits=5)
_INVERSE = (
    "SELECT x.channel, any_value(s.seq) AS seq, any_value(s.ts_ns) AS ts_ns, coalesce(sum(CASE WHEN k = 0 OR k * 2 = m.n_fft THEN 1 ELSE 2 END * (re * cos(2 * pi() * ((k * x.i) % m.n_fft) / m.n_fft) - im * sin(2 * pi() * ((k * x.i) % m.n_fft) / m.n_fft)) / m.n_fft) FILTER ({f}), 0) AS value "
    "FROM x JOIN i s ON s.channel = x.channel AND s.i = x.i JOIN m ON m.channel = x.channel GROUP BY x.channel, x.i"
)
_IN_BAND = "k * (m.fs / m.n_fft) BETWEEN 1e-5 AND 1e-4"
put("p5_fft_cut", _INVERSE.format(f=f"NOT ({_IN_BAND})"), more=_dft("1.0"), digits=5)
put("p6_fft_keep", _INVERSE.format(f=_IN_BAND), more=_dft("1.0"), digits=5)
put("p5_p6_complement", "SELECT * FROM s", digits=5)
put("p7_peak_hz", "SELECT t.channel, (t.k + CASE WHEN b.m IS NULL OR c.m IS NULL THEN 0 ELSE greatest(-0.5, least(0.5, 0.5 * (ln(b.m) - ln(c.m)) / (ln(b.m) - 2 * ln(t.m) + ln(c.m)))) END) * (t.fs / t.n_fft) AS value FROM (SELECT * FROM m WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY channel ORDER BY m DESC, k) = 1) t LEFT JOIN m b ON b.channel = t.channel AND b.k = t.k - 1 LEFT JOIN m c ON c.channel = t.channel AND c.k = t.k + 1",
    more=_dft(_HANN), final="SELECT channel, round(value * 1e6, 4) + 0.0 AS peak_uhz FROM r")
put("p8_fft_welch", "SELECT 'pair' AS channel, k AS seq, floor(k * (fs / n_fft) * 1e9 + 0.5)::BIGINT AS ts_ns, avg(m) AS value FROM m GROUP BY k, fs, n_fft", digits=5, more=_RUNS + (
    f"w0 AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts_ns, seq) - 1 AS i, count(*) OVER (PARTITION BY run) AS n FROM kept), w1 AS (SELECT *, {_HANN} AS w FROM w0 WHERE n > 1), "
    "q AS (SELECT greatest(2, pow(2, ceil(log2((SELECT max(n) FROM w0)))))::BIGINT AS n_fft, 1e9 / (SELECT max(ts_ns) FILTER (i = 1) - min(ts_ns) FROM w1 WHERE run = (SELECT min(run) FROM w1)) AS fs), "
    "d AS (SELECT run, k, any_value(fs) AS fs, any_value(n_fft) AS n_fft, sum(w) AS ws, sum(value * w * cos(2 * pi() * ((k * i) % n_fft) / n_fft)) AS re, sum(value * w * sin(2 * pi() * ((k * i) % n_fft) / n_fft)) AS im FROM w1, q, (SELECT unnest(range(0, (SELECT n_fft FROM q) // 2 + 1)) AS k) GROUP BY run, k), "
    "m AS (SELECT *, CASE WHEN ws > 0 THEN sqrt(re * re + im * im) * CASE WHEN k = 0 OR k * 2 = n_fft THEN 1 ELSE 2 END / ws ELSE 0 END AS m FROM d),"))  # fmt: skip

_CUT = "c AS (SELECT min(ts_ns) + (max(ts_ns) - min(ts_ns)) // 4 AS x1, min(ts_ns) + (max(ts_ns) - min(ts_ns)) // 4 * 3 AS x2 FROM s), "
_STATS = "k AS (SELECT s.*, lag(ts_ns) OVER w AS pt, lag(value) OVER w AS pv FROM s, c WHERE ts_ns BETWEEN x1 AND x2 WINDOW w AS (PARTITION BY channel ORDER BY ts_ns, seq)), st AS (SELECT channel, count(*) AS n, min(value) AS min, max(value) AS max, avg(value) AS mean, sqrt(avg(value * value)) AS rms, stddev_samp(value) AS sigma, sum(0.5 * (value + pv) * ((ts_ns - pt) / 1e9)) AS area FROM k GROUP BY channel),"
_AT = "g AS (SELECT DISTINCT channel, 1 AS nth, x1 AS ts_ns FROM s, c UNION ALL SELECT DISTINCT channel, 2, x2 FROM s, c), y AS (SELECT channel, max(other) FILTER (nth = 1) AS y1, max(other) FILTER (nth = 2) AS y2, (SELECT x2 - x1 FROM c) / 1e9 AS dx FROM (" + _interp("g", "s") + ") GROUP BY channel), cu AS (SELECT channel, y1, y2, y2 - y1 AS delta, (y2 - y1) / dx AS slope, y2 / y1 AS ratio, 20 * log10(y2 / y1) AS db, abs(y2 - y1) AS peak_to_peak FROM y),"
_R = lambda names, d: ", ".join(f"round({n}, {d}) + 0.0 AS {n}" for n in names)
_S, _C = ("min", "max", "mean", "rms", "sigma", "area"), ("y1", "y2", "delta", "slope", "ratio", "db")
put("a1_gate_stats", "SELECT * FROM st", more=_CUT + _STATS, final=f"SELECT channel, n, {_R(_S, 3)} FROM r")
put("a2_cursor_values", "SELECT * FROM cu", more=_CUT + _AT, final=f"SELECT channel, {_R((*_C, 'peak_to_peak'), 6)} FROM r")
put("a3_measure", "SELECT cu.* EXCLUDE (peak_to_peak), st.* EXCLUDE (channel), max - min AS peak_to_peak FROM cu JOIN st ON cu.channel = st.channel", more=_CUT + _STATS + _AT, final=f"SELECT channel, n, {_R((*_C, 'peak_to_peak', *_S), 3)} FROM r")
put("a4_value_range", "SELECT left(channel, 1) AS \"group\", min(value) AS a, max(value) AS b FROM s WHERE (ts_ns - (SELECT min(ts_ns) FROM s)) / 1e9 BETWEEN 1e5 AND 1e6 GROUP BY 1",
    final="SELECT \"group\", round(a - CASE WHEN a = b THEN 0.5 ELSE (b - a) * 0.05 END, 6) + 0.0 AS low, round(b + CASE WHEN a = b THEN 0.5 ELSE (b - a) * 0.05 END, 6) + 0.0 AS high FROM r")
put("a5_downsample", "SELECT channel, bin, count(*) AS n, min(value) AS mn, arg_min(ts_ns, (value, ts_ns)) AS min_ts_ns, max(value) AS mx, arg_min(ts_ns, (-value, ts_ns)) AS max_ts_ns FROM (SELECT *, least(99, floor((ts_ns - t0) * 100.0::DOUBLE / greatest(span, 1)))::BIGINT AS bin FROM s JOIN (SELECT channel, min(ts_ns) AS t0, max(ts_ns) - min(ts_ns) AS span FROM s GROUP BY channel) USING (channel)) GROUP BY channel, bin",
    final="SELECT channel, bin, n, round(mn, 6) + 0.0 AS min, min_ts_ns, round(mx, 6) + 0.0 AS max, max_ts_ns FROM r")
put("a6_channel_summary", "SELECT channel, count(*) AS n, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM s GROUP BY channel", _EVENTS.replace("event_type", "user_id::VARCHAR"),
    final="SELECT *, round((last_ns - first_ns) / 1e9, 6) + 0.0 AS span_s, round(CASE WHEN last_ns > first_ns THEN (n - 1) / ((last_ns - first_ns) / 1e9) ELSE 0 END, 9) + 0.0 AS rate_hz FROM r")

put("c1_add_replace", "SELECT channel, seq, ts_ns, CASE WHEN channel = 'click' THEN -value ELSE value END AS value FROM s")
put("c2_c3_rename_remove", "SELECT CASE WHEN channel = 'click' THEN 'press' ELSE channel END AS channel, seq, ts_ns, value FROM s WHERE channel <> 'view'")
put("c4_merge_unique", "SELECT * FROM s UNION ALL SELECT 'click (2)', seq, ts_ns, value FROM s WHERE channel = 'click' UNION ALL SELECT CASE WHEN channel = 'click' THEN 'click (3)' ELSE 'view (2)' END, seq, ts_ns, value FROM s WHERE channel IN ('click', 'view')")
put("c5_derived", "SELECT 'sum' AS channel, seq, ts_ns, 3 * value AS value FROM s WHERE channel = 'click'")
put("c5_derived_chain", "SELECT 'd' || k AS channel, seq, ts_ns, a * value AS value FROM s, chain WHERE channel = 'click'", more="chain(k, a, b) AS (SELECT 1, 0.5::DOUBLE, 1.0::DOUBLE UNION ALL SELECT k + 1, a + b, a FROM chain WHERE k < 10),")
put("c6_alias", "SELECT * FROM s WHERE channel = 'click' UNION ALL SELECT 'copy', seq, ts_ns, value FROM s WHERE channel = 'click'")

put("o1_wide_table", "SELECT t.ts_ns, x.other AS a, y.other AS b FROM t LEFT JOIN x ON x.ts_ns = t.ts_ns LEFT JOIN y ON y.ts_ns = t.ts_ns", more=_pair() + f"t AS (SELECT DISTINCT 'pair' AS channel, ts_ns FROM (SELECT ts_ns FROM a UNION SELECT ts_ns FROM b)), x AS ({_interp('t', 'a', True)}), y AS ({_interp('t', 'b', True)}),",
    final="SELECT ts_ns, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b FROM r")
put("o2_paired_table", "SELECT *, row_number() OVER (PARTITION BY channel ORDER BY ts_ns, seq) - 1 AS row FROM s WHERE channel IN ('click', 'purchase')",
    final="SELECT row, " + ", ".join(f"max(ts_ns) FILTER (channel = '{c}') AS {c}_x, round(max(value) FILTER (channel = '{c}'), 6) + 0.0 AS {c}_v" for c in ("click", "purchase")) + " FROM r GROUP BY row")
ORACLES["o3_number_format"] = f"WITH s AS ({_EVENTS}) SELECT seq, replace(format('{{:.3f}}', round(value, 2)), '.', ',') AS cell FROM s"
ORACLES["n1_flatten"] = "SELECT 'embedding[' || (i - 1) || ']' AS channel, count(*) AS n, round(sum(v::DOUBLE), 2) + 0.0 AS total FROM (SELECT unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY i UNION ALL SELECT 'label', count(*), round(sum(label), 2) + 0.0 FROM embeddings"
put("t1_accepted", "SELECT channel, seq, CASE WHEN seq % 7 = 0 THEN ts_ns + 5 ELSE ts_ns END AS ts_ns, value FROM s WHERE seq % 11 <> 0")
put("t2_running_totals", "SELECT channel, sum(CASE WHEN seq % 11 <> 0 THEN 1 ELSE 0 END)::BIGINT AS received, sum(CASE WHEN seq % 11 = 0 THEN 1 ELSE 0 END)::BIGINT AS overruns FROM s GROUP BY channel", final="SELECT * FROM r")
put("t3_live_window", "SELECT min(value) AS a, max(value) AS b, count(*) AS n FROM s WHERE ts_ns >= (SELECT max(ts_ns) FROM s) - 100000000000000", final="SELECT '' AS \"group\", round(a - (b - a) * 0.05, 6) + 0.0 AS low, round(b + (b - a) * 0.05, 6) + 0.0 AS high, n FROM r")
put("t4_fan_out", "SELECT channel, seq * n + i AS seq, ts_ns + floor(i * (1000000.0 / n))::BIGINT AS ts_ns, v AS value FROM (SELECT label::VARCHAR AS channel, vec_id AS seq, vec_id * 1000000 AS ts_ns, len(embedding) AS n, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS i FROM embeddings)", digits=5)

_KEYLESS = "SELECT channel, ts_ns, round(value, 6) + 0.0 AS value FROM r"
put("s1_s2_grid_import", "SELECT 'value' AS channel, ts_ns, value FROM s", final=_KEYLESS)
put("s4_o2_csv_round_trip", "SELECT * FROM s WHERE channel IN ('click', 'view')", final=_KEYLESS)
put("s8_o5_json_round_trip", "SELECT * FROM s", final=_KEYLESS)
_CELL = "CASE WHEN seq % 9 = 0 OR seq % 10 = 0 THEN 0 ELSE value END AS value"
put("i1_i5_i6_import", f"SELECT 'v' AS channel, seq, ((ts_ns // 1000000)::DOUBLE * 1e6)::BIGINT AS ts_ns, {_CELL} FROM s WHERE seq BETWEEN 100 AND 8000 UNION ALL SELECT 'ColC', event_id, ((epoch_us(ts) // 1000)::DOUBLE * 1e6)::BIGINT, user_id FROM events")
put("i2_i7_frequency_import", f"SELECT 'v' AS channel, seq, seq * 1000000000000 AS ts_ns, {_CELL} FROM s WHERE seq % 4 <> 0")
put("i3_i4_rate_import", f"SELECT 'v' AS channel, seq, (seq - 50) * 4000000 AS ts_ns, {_CELL} FROM s WHERE seq >= 50")
put("i8_i9_import", "SELECT 'v' AS channel, event_id AS seq, (epoch_us(ts) - (SELECT arg_min(epoch_us(ts), event_id) FROM events)) * 1000 + 2500000000 AS ts_ns, user_id::DOUBLE AS value FROM events")
ORACLES["q1_bad_cells"] = "SELECT 'B' AS \"column\", false AS axis, count(*) AS count, 'n/a' AS first_cell, min(event_id) AS first_row FROM events WHERE event_id % 9 = 0 UNION ALL SELECT 'A', true, count(*), 'x' || min(event_id), min(event_id) FROM events WHERE event_id % 50 = 7"
ORACLES["s6_json_records"] = "SELECT count(event_id) AS n, 0::BIGINT AS nested, round(sum(value), 2) + 0.0 AS total FROM events"
put("s10_o6_session", "SELECT * FROM s WHERE channel IN ('click', 'error')")
put("o7_split_domains", "SELECT count(*) AS n, greatest(2, pow(2, ceil(log2(count(*)))))::BIGINT AS n_fft FROM s GROUP BY channel", final="SELECT sum(n)::BIGINT AS n_time, sum(n_fft // 2 + 1)::BIGINT AS n_frequency FROM r")
put("t1_stream_record", "SELECT * FROM s WHERE seq % 11 <> 0")
ORACLES["t5_stream_integral"] = ORACLES["w6_integral"]
ORACLES["t5_stream_forward_fill"] = ORACLES["w7_forward_fill"]
ORACLES["t5_stream_low_pass"] = ORACLES["w8_low_pass"]
ORACLES["t5_stream_high_pass"] = ORACLES["w9_high_pass"]
ORACLES["t5_stream_pt2"] = ORACLES["w10_pt2"]
ORACLES["t2_stream_totals"] = ORACLES["t2_running_totals"]
put("t1_stream_late", "SELECT *, coalesce(ts_ns < max(ts_ns) OVER (PARTITION BY channel ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 864000000000000, false) AS late FROM s",
    _EVENTS.replace("event_id AS seq", "event_id + user_id * 10000000 AS seq"), final="SELECT channel, seq, ts_ns, round(value, 6) + 0.0 AS value, late FROM r")
put("s3_o4_noted_csv", "SELECT CASE channel WHEN 'click' THEN 't' ELSE channel END AS channel, ts_ns, value, 'V' AS unit FROM s WHERE channel IN ('click', 'view')", final="SELECT channel, ts_ns, round(value, 6) + 0.0 AS value, unit FROM r")
put("s5_paired_export", "SELECT channel, ((ts_ns // 1000000)::DOUBLE * 1e6)::BIGINT AS ts_ns, value, CASE channel WHEN 'click' THEN 'V' ELSE '' END AS unit FROM s WHERE channel IN ('click', 'view')", final="SELECT channel, ts_ns, round(value, 6) + 0.0 AS value, unit FROM r")
ORACLES["s7_json_columnar"] = "SELECT event_id AS t, round(value, 6) + 0.0 AS a FROM events"
put("s9_json_guess", "SELECT 'a' AS channel, seq * 500000000 AS ts_ns, value FROM s UNION ALL SELECT 'flag', seq * 500000000, (seq % 2 = 0)::INT FROM s", final=_KEYLESS)
put("i13_many_files", "SELECT channel || '.csv:v' AS channel, seq, ts_ns - arg_min(ts_ns, seq) OVER (PARTITION BY channel) AS ts_ns, CASE channel WHEN 'error' THEN 0 ELSE value END AS value FROM s WHERE channel <> 'view'")
ORACLES["i13_report"] = "SELECT 'in/' || event_type || '.csv' AS file, CASE event_type WHEN 'view' THEN 0 ELSE 1 END::BIGINT AS n_channels, CASE event_type WHEN 'view' THEN 0 ELSE count(*) END::BIGINT AS n_samples FROM events GROUP BY event_type"
ORACLES["q2_unit_report"] = "SELECT 'A' AS \"column\", 'hours' AS unit, 'seconds' AS read_as, count(*) AS cells FROM events WHERE event_id >= 10 AND event_id % 4 <> 0 UNION ALL SELECT 'C', 'rpm', 'Hz', count(*) FROM events WHERE event_id >= 10"
put("u1_registered_operator", "SELECT channel, seq, ts_ns, value * 0.5 AS value FROM s")
ORACLES["s1_quoted_grid"] = """
    SELECT CASE k WHEN 3 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS n,
           CASE k WHEN 0 THEN v || '"xtail' WHEN 1 THEN v || 'd,ef' WHEN 2 THEN v || ',,' || id ELSE v || 'b' END AS c0,
           CASE k WHEN 3 THEN '' WHEN 2 THEN NULL ELSE id END AS c1, CASE k WHEN 3 THEN id END AS c2
    FROM (SELECT event_id % 5 AS k, event_type AS v, event_id::VARCHAR AS id FROM events) WHERE k <> 4"""
ORACLES["t5_stream_disordered_integral"] = ORACLES["w6_integral"]
ORACLES["t5_stream_disordered_pt2"] = ORACLES["w10_pt2"]
# A row is late if it is older than what its channel's or all channels' newest row of the batches before releases.
put(
    "t5_stream_too_late",
    """SELECT a.channel, a.seq, a.ts_ns, a.value FROM a JOIN newest g ON g.channel IS NULL AND g.batch = a.batch JOIN newest o ON o.channel = a.channel AND o.batch = a.batch
       WHERE a.ts_ns < greatest(o.before, g.before // 1000000 * 1000000) - 86400000000000""",
    more="""a AS (SELECT s.*, (ts_ns + CASE WHEN (ts_ns, seq) = (last_ns, last_seq) THEN 86400000000000 WHEN seq % 50 = 0 THEN 3456000000000000 ELSE seq * 7919 % 86400 * 1000000000 END) // 864000000000000 AS batch
                  FROM s JOIN (SELECT channel, max(ts_ns) AS last_ns, arg_max(seq, (ts_ns, seq)) AS last_seq FROM s GROUP BY channel) e ON s.channel = e.channel),
            newest AS (SELECT c.channel, b.batch, (SELECT max(ts_ns) FROM a WHERE a.batch < b.batch AND a.channel = c.channel) AS before FROM (SELECT DISTINCT channel FROM a) c, (SELECT DISTINCT batch FROM a) b
                       UNION ALL SELECT NULL, b.batch, (SELECT max(ts_ns) FROM a WHERE a.batch < b.batch) FROM (SELECT DISTINCT batch FROM a) b),""",
)
_ARRIVED = "SELECT event_type AS channel, event_id + user_id * 10000000 AS seq, CASE WHEN event_id % 7 = 0 THEN epoch_us(ts) * 1000 + 5 ELSE epoch_us(ts) * 1000 END AS ts_ns, value, event_id % 11 <> 0 AS valid FROM events"
_JUDGED = "m AS (SELECT *, valid AND coalesce(ts_ns < max(CASE WHEN valid THEN ts_ns END) OVER (PARTITION BY channel ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 864000000000000, false) AS late FROM s),"
put("t1_stream_samples", "SELECT * FROM m WHERE valid AND NOT late", _ARRIVED, more=_JUDGED)
put("t1_stream_side", "SELECT * FROM m WHERE late OR NOT valid", _ARRIVED, more=_JUDGED, final="SELECT channel, seq, ts_ns, round(value, 6) + 0.0 AS value, valid, late FROM r")
_TYPE_LIST = "['BOOL', 'SINT', 'USINT', 'INT', 'UINT', 'DINT', 'UDINT', 'LINT', 'ULINT', 'REAL', 'LREAL']"
put(
    "t1_typed_payloads",
    """SELECT 'of ' || kind AS channel, id AS seq, ts_ns, kind AS data_type, ([1, 1, 1, 2, 2, 4, 4, 8, 8, 4, 8][id % 11 + 1] + CASE WHEN id % 13 = 0 THEN 1 ELSE 0 END)::INTEGER AS payload_len,
              CASE WHEN id % 13 <> 0 THEN CASE WHEN kind IN ('INT', 'DINT', 'LINT') THEN -n WHEN kind IN ('SINT', 'USINT') THEN n % 100 WHEN kind = 'BOOL' THEN n % 2 ELSE n END END::DOUBLE AS value, id % 13 <> 0 AS valid FROM s""",
    f"SELECT event_id AS id, {_TYPE_LIST}[event_id % 11 + 1] AS kind, event_id % 1000 + 1 AS n, epoch_us(ts) * 1000 AS ts_ns FROM events",
    final="SELECT * FROM r",
)
put(
    "t2_stream_events",
    "SELECT channel, tick * 86400000000000 AS tick_ns, (sum(bad) OVER (PARTITION BY channel ORDER BY tick))::BIGINT AS overruns, bad AS rise FROM ticks WHERE bad > 0",
    more="ticks AS (SELECT channel, (CASE WHEN seq % 7 = 0 THEN ts_ns + 5 ELSE ts_ns END) // 86400000000000 AS tick, (count(*) FILTER (seq % 11 = 0))::BIGINT AS bad FROM s GROUP BY ALL),",
    final="SELECT * FROM r",
)
put(
    "t3_stream_window",
    "SELECT CASE WHEN channel < 'm' THEN 'low' ELSE 'high' END AS g, min(value) AS a, max(value) AS b, count(*) AS n FROM s WHERE ts_ns // 1000000000000 >= (SELECT (max(ts_ns) - 100000000000000) // 1000000000000 FROM s) GROUP BY g",
    final="SELECT g AS \"group\", round(a - (b - a) * 0.05, 6) + 0.0 AS low, round(b + (b - a) * 0.05, 6) + 0.0 AS high, n FROM r",
)
put(
    "n1_nested",
    """SELECT 'cells[' || k || '].a' AS channel, seq, ts_ns, value * (k + 1) AS value FROM s, range(2) x(k)
       UNION ALL SELECT 'cells[' || k || '].b[0]', seq, ts_ns, value + k + 1 FROM s, range(2) x(k) UNION ALL SELECT 'cells[' || k || '].b[1]', seq, ts_ns, seq FROM s, range(2) x(k)
       UNION ALL SELECT 'rows[' || i || '][' || j || ']', seq, ts_ns, value * (j + 1) FROM s, range(3) x(i), range(3) y(j) WHERE j <= i AND i <= seq % 3
       UNION ALL SELECT 'grid[' || (k // 2 + 1) || ',' || (k % 2) || ']', seq, ts_ns, value + k FROM s, range(4) x(k)""",
    final="SELECT channel, seq, ts_ns, round(value, 6) + 0.0 AS value, 'cells[].text' AS skipped FROM r",
)
put(
    "s10_typed_session",
    """SELECT event_type || ' ' || kind AS channel, event_id AS seq, epoch_us(ts) * 1000 AS ts_ns, kind AS data_type,
              CASE kind WHEN 'LINT' THEN (event_id - 4611686018427387904)::HUGEINT::VARCHAR WHEN 'ULINT' THEN (9223372036854775808::HUGEINT + event_id)::VARCHAR END AS exact,
              CASE kind WHEN 'REAL' THEN event_id * 0.5 WHEN 'LREAL' THEN round(value, 6) + 0.0 END::DOUBLE AS value FROM s""",
    "SELECT *, ['LINT', 'ULINT', 'REAL', 'LREAL'][event_id % 4 + 1] AS kind FROM events",
    final="SELECT * FROM r",
)
put("i13_library", "SELECT channel || '.csv:v' AS channel, seq, ts_ns, value FROM s WHERE channel NOT LIKE '%k' OR seq % 3 = 0")
ORACLES["s6_json_pieces"] = r"""SELECT event_id, '],{ "' || event_type || '\",[' AS note, round(value, 6) + 0.0 AS a, NULL::VARCHAR AS more FROM events"""
ORACLES["s7_json_pieces"] = """SELECT event_id AS t, round(value, 6) + 0.0 AS a, event_type || ',"]' AS b FROM events"""
