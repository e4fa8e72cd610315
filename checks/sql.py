"""DuckDB text of the same tables, written independently of the Spark operators."""

from __future__ import annotations

import re

PARTS: dict[str, str] = {}


def part(name: str, body: str) -> None:
    PARTS[name] = body.strip()


def assemble(query: str) -> str:
    """Prefix a query with the named parts it mentions, dependencies first."""
    ordered: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for word in re.findall(r"(?:FROM|JOIN|,)\s+([a-z_][a-z0-9_]*)", text):
            if word in PARTS and word not in seen:
                seen.add(word)
                visit(PARTS[word])
                ordered.append(word)

    visit(query)
    if not ordered:
        return query.strip()
    bodies = ",\n".join(f"{name} AS MATERIALIZED (\n{PARTS[name]}\n)" for name in ordered)
    return f"WITH {bodies}\n{query.strip()}"


part("quotes", """
SELECT CASE WHEN l_suppkey % 5 = 0 THEN 'BBB' ELSE 'AAA' END AS underlying_symbol,
       quote_date,
       CASE WHEN l_linenumber % 3 = 0 THEN 'SPX' ELSE 'SPXW' END AS root,
       quote_date + exp_days AS expiration,
       spot * exp(m) AS strike,
       CASE WHEN cents % 223 = 0 THEN NULL WHEN cents % 211 = 0 THEN 'X'
            WHEN cents % 2 = 0 THEN 'C' ELSE 'P' END AS option_type,
       CAST(l_quantity AS BIGINT) AS trade_volume,
       CASE WHEN cents % 97 = 0 THEN NULL WHEN l_quantity = 1 THEN 0E0
            ELSE l_quantity / 10E0 END AS bid_1545,
       CASE WHEN cents % 101 = 0 THEN CAST('NaN' AS DOUBLE) WHEN l_quantity = 50 THEN 4E0
            ELSE l_quantity / 10E0 + 0.05E0 + l_discount END AS ask_1545,
       spot AS active_underlying_price_1545,
       CASE WHEN cents % 89 = 0 THEN 0E0
            ELSE 0.15E0 + l_discount + 0.5E0 * m * m + l_tax / 4E0 END AS implied_volatility_1545,
       CASE WHEN cents % 83 = 0 THEN 0E0 ELSE l_quantity * (1E0 - l_discount) END AS vega_1545,
       'UnderlyingOptionsEODCalcs_' || CAST(quote_date AS VARCHAR) || '.zip' AS source_zip,
       exp_days, exp_days / 365E0 AS tau_years
FROM (SELECT *, (cents % 801) / 1000E0 - 0.3995E0 AS m,
             CAST(1000 + (dn * 37) % 41 AS DOUBLE) AS spot
      FROM (SELECT CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
                   CAST(DATE '1995-01-01' + shipped - greatest((shipped + 6) % 7 - 4, 0) AS DATE)
                     AS quote_date,
                   shipped - greatest((shipped + 6) % 7 - 4, 0) AS dn,
                   CAST((l_partkey * 7 + l_suppkey * 13) % 401 AS INTEGER) AS exp_days,
                   l_suppkey, l_linenumber, l_quantity, l_discount, l_tax
            FROM (SELECT *, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))
                                 AS INTEGER) AS shipped FROM lineitem)))
""")

part("derived", """
SELECT *, (bid_1545 + ask_1545) / 2E0 AS mid_1545, ask_1545 - bid_1545 AS spread_1545,
       ln(strike) - ln(active_underlying_price_1545) AS log_moneyness,
       implied_volatility_1545 * implied_volatility_1545 * tau_years AS total_variance,
       CAST(quote_date AS VARCHAR) || 'T15:45:00-0' ||
         CAST(CAST((epoch(timezone('America/New_York', quote_date + TIME '15:45:00'))
                    - epoch(quote_date + TIME '15:45:00')) / 3600 AS BIGINT) AS VARCHAR)
         || ':00' AS effective_decision_timestamp
FROM quotes
""")

_CHAIN = [
    *[(f"MISSING_{c.upper()}", f"{c} IS NULL") for c in (
        "option_type", "bid_1545", "ask_1545", "implied_volatility_1545", "vega_1545",
        "active_underlying_price_1545", "strike", "mid_1545", "tau_years", "total_variance")],
    ("NONFINITE_BID_1545", "NOT isfinite(bid_1545)"),
    ("NONFINITE_ASK_1545", "NOT isfinite(ask_1545)"),
    ("NONFINITE_IV_1545", "NOT isfinite(implied_volatility_1545)"),
    ("NONFINITE_VEGA_1545", "NOT isfinite(vega_1545)"),
    ("NONFINITE_UNDERLYING_1545", "NOT isfinite(active_underlying_price_1545)"),
    ("NONFINITE_STRIKE", "NOT isfinite(strike)"),
    ("NON_POSITIVE_STRIKE", "strike <= 0"),
    ("NONFINITE_MID_1545", "NOT isfinite(mid_1545)"),
    ("NONFINITE_TAU_YEARS", "NOT isfinite(tau_years)"),
    ("NONFINITE_TOTAL_VARIANCE", "NOT isfinite(total_variance)"),
    ("INVALID_OPTION_TYPE", "option_type NOT IN ('C', 'P')"),
    ("NON_POSITIVE_BID", "bid_1545 <= 0"),
    ("NON_POSITIVE_ASK", "ask_1545 <= 0"),
    ("ASK_LT_BID", "ask_1545 < bid_1545"),
    ("NON_POSITIVE_IV", "implied_volatility_1545 <= 0"),
    ("NON_POSITIVE_VEGA", "vega_1545 <= 0"),
    ("NON_POSITIVE_UNDERLYING_PRICE", "active_underlying_price_1545 <= 0"),
    ("NON_POSITIVE_MID", "mid_1545 <= 0"),
    ("TAU_TOO_SHORT", "tau_years < 1E-4"),
    ("TAU_TOO_LONG", "tau_years > 1.05E0"),
    ("NON_POSITIVE_TOTAL_VARIANCE", "total_variance <= 0"),
    ("MISSING_LOG_MONEYNESS", "log_moneyness IS NULL"),
    ("NONFINITE_LOG_MONEYNESS", "NOT isfinite(log_moneyness)"),
    ("OUTSIDE_MONEYNESS_RANGE", "abs(log_moneyness) > 0.35E0"),
]
part("flagged", "SELECT *, invalid_reason IS NULL AS is_valid_observation FROM (SELECT *, CASE "
     + " ".join(f"WHEN {cond} THEN '{code}'" for code, cond in _CHAIN)
     + " END AS invalid_reason FROM derived)")

part("placed", """
SELECT *, CASE WHEN ok THEN CAST((tau_years >= 18.5E0/365E0)::INT + (tau_years >= 60.5E0/365E0)::INT
                               + (tau_years >= 227.5E0/365E0)::INT AS BIGINT) END AS maturity_index,
       CASE WHEN ok THEN CAST((log_moneyness >= -0.2E0)::INT + (log_moneyness >= -0.05E0)::INT
                            + (log_moneyness >= 0.05E0)::INT + (log_moneyness >= 0.2E0)::INT AS BIGINT)
       END AS moneyness_index
FROM (SELECT *, in_tau AND in_m AS ok,
             CASE WHEN in_tau AND in_m THEN 'VALID_GRID_DOMAIN'
                  WHEN NOT in_tau AND NOT in_m THEN 'OUTSIDE_MATURITY_AND_MONEYNESS_GRID_DOMAIN'
                  WHEN NOT in_tau THEN 'OUTSIDE_MATURITY_GRID_DOMAIN'
                  ELSE 'OUTSIDE_MONEYNESS_GRID_DOMAIN' END AS grid_domain_reason
      FROM (SELECT *, tau_years BETWEEN 7E0/365E0 AND 364E0/365E0 AS in_tau,
                   log_moneyness BETWEEN -0.3E0 AND 0.3E0 AS in_m
            FROM flagged WHERE is_valid_observation))
""")

part("grid_cells", """
SELECT mi * 5 + ki AS cell_index, mi AS maturity_index, ki AS moneyness_index,
       ([7, 30, 91, 364])[mi + 1] AS maturity_days,
       ([7, 30, 91, 364])[mi + 1] / 365E0 AS tau,
       ([-0.3E0, -0.1E0, 0E0, 0.1E0, 0.3E0])[ki + 1] AS moneyness_point
FROM (SELECT i // 5 AS mi, i % 5 AS ki FROM range(20) t(i))
""")

part("cells_seen", """
SELECT underlying_symbol, quote_date, maturity_index, moneyness_index,
       max(effective_decision_timestamp) AS effective_decision_timestamp,
       sum(total_variance * vega_1545) / sum(vega_1545) AS observed_total_variance,
       sum(implied_volatility_1545 * vega_1545) / sum(vega_1545) AS observed_iv,
       sum(spread_1545 * vega_1545) / sum(vega_1545) AS weighted_spread_1545,
       sum(vega_1545) AS vega_sum, count(*) AS observation_count
FROM placed WHERE ok GROUP BY ALL
""")

part("dense", """
SELECT d.underlying_symbol, d.quote_date, d.effective_decision_timestamp, g.*,
       c.observed_total_variance, c.observed_iv,
       coalesce(c.weighted_spread_1545, 0) AS weighted_spread_1545,
       coalesce(c.vega_sum, 0) AS vega_sum,
       coalesce(c.observation_count, 0) AS observation_count,
       coalesce(c.observation_count >= 1, false) AS observed_mask
FROM (SELECT underlying_symbol, quote_date,
             max(effective_decision_timestamp) AS effective_decision_timestamp
      FROM cells_seen GROUP BY ALL) d
CROSS JOIN grid_cells g
LEFT JOIN cells_seen c USING (underlying_symbol, quote_date, maturity_index, moneyness_index)
""")


def _pass(source: str, axis: str) -> str:
    """One completion pass along an axis: monotone cubic inside, flat outside."""
    line = "underlying_symbol, quote_date, " + (
        "moneyness_index" if axis == "maturity" else "maturity_index")
    x = "tau" if axis == "maturity" else "moneyness_point"
    end = ("CASE WHEN sign({e}) <> sign({d0}) THEN 0E0 "
           "WHEN sign({d0}) <> sign({d1}) AND abs({e}) > 3 * abs({d0}) THEN 3 * {d0} ELSE {e} END")

    def edge(h0: str, h1: str, d0: str, d1: str) -> str:
        e = f"(((2 * {h0} + {h1}) * {d0} - {h0} * {d1}) / ({h0} + {h1}))"
        return end.format(e=e, d0=d0, d1=d1)

    return f"""
SELECT p.* EXCLUDE (w, st),
       CASE WHEN p.w IS NOT NULL OR b.k IS NULL THEN p.w
            WHEN b.k = 1 OR p.{x} < b.x_first THEN b.w_first
            WHEN p.{x} > b.x_last THEN b.w_last
            ELSE s.w + u * s.slope + u * u * (3 * s.d - 2 * s.slope - s.slope_next) / s.h
                 + u * u * u * (s.slope + s.slope_next - 2 * s.d) / (s.h * s.h) END AS w,
       CASE WHEN p.w IS NOT NULL OR b.k IS NULL THEN p.st
            WHEN b.k = 1 OR p.{x} < b.x_first OR p.{x} > b.x_last
            THEN 'extrapolated_boundary_fill' ELSE 'interpolated' END AS st
FROM (SELECT * FROM {source}) p
LEFT JOIN (SELECT {line}, count(*) AS k, min({x}) AS x_first, max({x}) AS x_last,
                  arg_min(w, {x}) AS w_first, arg_max(w, {x}) AS w_last
           FROM {source} WHERE w IS NOT NULL GROUP BY ALL) b USING ({line})
LEFT JOIN (
  SELECT *, lead(slope) OVER line AS slope_next, {x} AS x0, {x} + h AS x1
  FROM (SELECT *, CASE
          WHEN k = 1 THEN NULL
          WHEN k = 2 THEN coalesce(d, dp)
          WHEN hp IS NULL THEN {edge('h', 'hn', 'd', 'dn')}
          WHEN h IS NULL THEN {edge('hp', 'hpp', 'dp', 'dpp')}
          WHEN sign(d) <> sign(dp) OR d = 0 OR dp = 0 THEN 0E0
          ELSE (3 * h + 3 * hp) / ((2 * h + hp) / dp + (h + 2 * hp) / d) END AS slope
        FROM (SELECT *, lead(h) OVER line AS hn, lead(d) OVER line AS dn,
                     lag(h) OVER line AS hp, lag(d) OVER line AS dp,
                     lag(h, 2) OVER line AS hpp, lag(d, 2) OVER line AS dpp,
                     count(*) OVER (PARTITION BY {line}) AS k
              FROM (SELECT {line}, {x}, w, lead({x}) OVER line - {x} AS h,
                           (lead(w) OVER line - w) / (lead({x}) OVER line - {x}) AS d
                    FROM {source} WHERE w IS NOT NULL
                    WINDOW line AS (PARTITION BY {line} ORDER BY {x}))
              WINDOW line AS (PARTITION BY {line} ORDER BY {x})))
  WINDOW line AS (PARTITION BY {line} ORDER BY {x})
) s ON p.underlying_symbol = s.underlying_symbol AND p.quote_date = s.quote_date
   AND p.{line.split(', ')[2]} = s.{line.split(', ')[2]}
   AND p.w IS NULL AND p.{x} > s.x0 AND p.{x} < s.x0 + s.h,
LATERAL (SELECT p.{x} - s.x0 AS u)
"""


part("pass_start", """
SELECT underlying_symbol, quote_date, maturity_index, moneyness_index, cell_index, tau,
       moneyness_point,
       CASE WHEN observed_mask THEN observed_total_variance END AS w,
       CASE WHEN observed_mask THEN 'observed' ELSE 'missing' END AS st
FROM dense
""")
for label, order in (("fill", ("maturity", "moneyness")), ("alt", ("moneyness", "maturity"))):
    source = "pass_start"
    for step in range(4):
        part(f"{label}_{step + 1}", _pass(source, order[step % 2]))
        source = f"{label}_{step + 1}"

part("gold", """
SELECT d.*, greatest(f.w, 1E-8) AS completed_total_variance,
       sqrt(greatest(f.w, 1E-8) / d.tau) AS completed_iv, f.st AS completion_status
FROM dense d JOIN fill_4 f USING (underlying_symbol, quote_date, cell_index)
""")

# ---- calendar -------------------------------------------------------------------------

# Weekday holidays and 13:00 closes of the New York exchange, 1994-12 to 2003-03.
HOLIDAYS = """
1994-12-26 1995-01-02 1995-02-20 1995-04-14 1995-05-29 1995-07-04 1995-09-04 1995-11-23 1995-12-25
1996-01-01 1996-02-19 1996-04-05 1996-05-27 1996-07-04 1996-09-02 1996-11-28 1996-12-25
1997-01-01 1997-02-17 1997-03-28 1997-05-26 1997-07-04 1997-09-01 1997-11-27 1997-12-25
1998-01-01 1998-01-19 1998-02-16 1998-04-10 1998-05-25 1998-07-03 1998-09-07 1998-11-26 1998-12-25
1999-01-01 1999-01-18 1999-02-15 1999-04-02 1999-05-31 1999-07-05 1999-09-06 1999-11-25 1999-12-24
2000-01-17 2000-02-21 2000-04-21 2000-05-29 2000-07-04 2000-09-04 2000-11-23 2000-12-25
2001-01-01 2001-01-15 2001-02-19 2001-04-13 2001-05-28 2001-07-04 2001-09-03 2001-09-11 2001-09-12
2001-09-13 2001-09-14 2001-11-22 2001-12-25
2002-01-01 2002-01-21 2002-02-18 2002-03-29 2002-05-27 2002-07-04 2002-09-02 2002-11-28 2002-12-25
2003-01-01 2003-01-20 2003-02-17
""".split()
EARLY_CLOSES = """
1995-07-03 1995-11-24 1996-07-05 1996-11-29 1996-12-24 1997-07-03 1997-11-28 1997-12-24 1997-12-26 1998-11-27
1998-12-24 1999-11-26 1999-12-31 2000-07-03 2000-11-24 2001-07-03 2001-11-23 2001-12-24 2002-07-05
2002-11-29 2002-12-24
""".split()


def _dates(values: list[str]) -> str:
    return ", ".join(f"DATE '{v}'" for v in values)


part("session_days", f"""
SELECT CAST(d AS DATE) AS session_date, row_number() OVER (ORDER BY d) AS session_no,
       timezone('America/New_York', CAST(d AS DATE) + CASE WHEN CAST(d AS DATE) IN
         ({_dates(EARLY_CLOSES)}) THEN TIME '13:00:00' ELSE TIME '16:00:00' END) AS close_ts,
       timezone('America/New_York', CAST(d AS DATE) + CASE WHEN CAST(d AS DATE) IN
         ({_dates(EARLY_CLOSES)}) THEN TIME '12:45:00' ELSE TIME '15:45:00' END) AS decision_ts,
       CAST(d AS DATE) IN ({_dates(EARLY_CLOSES)}) AS early
FROM generate_series(TIMESTAMP '1994-12-01', TIMESTAMP '2003-03-31', INTERVAL 1 DAY) t(d)
WHERE dayofweek(d) BETWEEN 1 AND 5 AND CAST(d AS DATE) NOT IN ({_dates(HOLIDAYS)})
""")
part("session_map", """
SELECT CAST(d AS DATE) AS calendar_date,
       (SELECT max(session_date) FROM session_days WHERE session_date < CAST(d AS DATE)) AS previous_session,
       (SELECT min(session_date) FROM session_days WHERE session_date > CAST(d AS DATE)) AS next_session,
       (SELECT max(session_date) FROM session_days WHERE session_date <= CAST(d AS DATE)) AS settlement_session
FROM generate_series(TIMESTAMP '1994-12-01', TIMESTAMP '2003-03-31', INTERVAL 1 DAY) t(d)
""")
part("contracts", "SELECT DISTINCT quote_date, root, expiration FROM quotes")
part("tradable", """
SELECT c.*, CASE WHEN c.root = 'SPX' THEN b.previous_session ELSE e.settlement_session END
         AS last_tradable_session
FROM contracts c JOIN session_map e ON c.expiration = e.calendar_date
LEFT JOIN session_map b ON e.settlement_session = b.calendar_date
""")
part("taus", """
SELECT t.*, CASE WHEN q.session_date IS NULL THEN NULL
                 WHEN t.quote_date > t.last_tradable_session THEN 0E0
                 ELSE greatest(epoch(x.close_ts) - epoch(q.decision_ts), 0) / 31536000E0 END AS tau
FROM tradable t LEFT JOIN session_days q ON t.quote_date = q.session_date
LEFT JOIN session_days x ON t.last_tradable_session = x.session_date
""")

# ---- features, splits, forecasts -------------------------------------------------------



def _running(days: int) -> str:
    """Mean of the last days in date order. A windowed avg adds in an order of the engine's
    choosing, and its last-bit noise would decide violation counts of flat surfaces."""
    terms = [f"lag(completed_total_variance, {k}) OVER l" for k in range(days - 1, 0, -1)]
    return "(" + " + ".join([*terms, "completed_total_variance"]) + f") / {days}"


part("feat", f"""
SELECT * FROM (
  SELECT underlying_symbol, quote_date, cell_index, maturity_days, moneyness_point, tau,
         effective_decision_timestamp,
         lead(quote_date) OVER l AS target_date,
         lead(effective_decision_timestamp) OVER l AS target_effective_decision_timestamp,
         completed_total_variance AS mean_01,
         {_running(5)} AS mean_05,
         {_running(22)} AS mean_22,
         CAST(observed_mask AS INT) AS mask_01,
         avg(CAST(observed_mask AS INT)) OVER (l ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mask_05,
         avg(CAST(observed_mask AS INT)) OVER (l ROWS BETWEEN 21 PRECEDING AND CURRENT ROW) AS mask_22,
         completed_total_variance - lag(completed_total_variance) OVER l AS change_01,
         lead(completed_total_variance) OVER l AS target_w,
         lead(CAST(observed_mask AS DOUBLE)) OVER l AS target_mask,
         lead(vega_sum) OVER l AS target_vega,
         row_number() OVER l AS rn
  FROM gold WINDOW l AS (PARTITION BY underlying_symbol, cell_index ORDER BY quote_date))
WHERE rn >= 22 AND target_date IS NOT NULL
""")
part("positions", """
SELECT underlying_symbol, quote_date,
       row_number() OVER (PARTITION BY underlying_symbol ORDER BY quote_date) - 1 AS i,
       count(*) OVER (PARTITION BY underlying_symbol) AS n
FROM (SELECT DISTINCT underlying_symbol, quote_date FROM feat)
""")
part("split_rows", """
SELECT p.underlying_symbol, s.s AS split_no, printf('split_%04d', s.s) AS split_id,
       CASE WHEN p.i < 126 + 21 * s.s THEN 'train' WHEN p.i < 147 + 21 * s.s THEN 'validation'
            ELSE 'test' END AS role, p.quote_date
FROM positions p
JOIN (SELECT DISTINCT underlying_symbol, unnest(range((n - 168) // 21 + 1)) AS s
      FROM positions WHERE n >= 168) s USING (underlying_symbol)
WHERE p.i < 168 + 21 * s.s
""")
part("edges", """
SELECT e.*, max(CASE WHEN split_no < 3 THEN last_validation END)
              OVER (PARTITION BY underlying_symbol) AS max_hpo_validation_date
FROM (SELECT underlying_symbol, split_no, split_id,
             max(quote_date) FILTER (role = 'validation') AS last_validation,
             min(quote_date) FILTER (role = 'test') AS first_test
      FROM split_rows GROUP BY ALL) e
""")
part("tested", """
SELECT r.underlying_symbol, r.split_id, r.quote_date
FROM split_rows r JOIN edges e USING (underlying_symbol, split_no)
WHERE r.role = 'test' AND e.first_test > e.max_hpo_validation_date
""")
part("fc", """
SELECT m.model_name, f.*, t.split_id,
       CASE m.model_name WHEN 'naive' THEN mean_01 WHEN 'mean5' THEN mean_05 ELSE mean_22 END
         AS predicted_total_variance
FROM feat f JOIN tested t USING (underlying_symbol, quote_date)
CROSS JOIN (SELECT unnest(['naive', 'mean5', 'mean22']) AS model_name) m
""")
part("joined", """
SELECT f.model_name, f.underlying_symbol, f.quote_date, f.target_date, f.split_id, f.cell_index,
       f.maturity_days, f.moneyness_point, f.tau, f.predicted_total_variance,
       a.completed_total_variance AS actual_completed_total_variance,
       a.completed_iv AS actual_completed_iv, a.observed_mask AS actual_observed_mask,
       a.completion_status AS actual_completion_status,
       o.completed_iv AS origin_completed_iv,
       sqrt(greatest(f.predicted_total_variance, 1E-8) / f.tau) AS predicted_iv,
       a.completed_iv - o.completed_iv AS actual_iv_change,
       sqrt(greatest(f.predicted_total_variance, 1E-8) / f.tau) - o.completed_iv AS predicted_iv_change,
       CASE WHEN a.observed_mask THEN a.vega_sum ELSE 0E0 END AS observed_weight
FROM fc f
JOIN gold a ON a.underlying_symbol = f.underlying_symbol AND a.quote_date = f.target_date
           AND a.cell_index = f.cell_index
JOIN gold o ON o.underlying_symbol = f.underlying_symbol AND o.quote_date = f.quote_date
           AND o.cell_index = f.cell_index
""")


def metrics(scope: str, member: str, weight: str) -> str:
    """The seven metrics of a scope as aggregate text over the joined panel."""
    y, p = "actual_completed_total_variance", "predicted_total_variance"
    ratio = f"(greatest({y}, 1E-8) / greatest({p}, 1E-8))"

    def mean(expr: str) -> str:
        return (f"(sum({weight} * {expr}) FILTER ({member}) / "
                f"nullif(sum({weight}) FILTER ({member}), 0))")

    gap, iv, change = f"({p} - {y})", "(predicted_iv - actual_completed_iv)", \
        "(predicted_iv_change - actual_iv_change)"
    prefix = f"{scope}_" if scope else ""
    return ", ".join([
        f"sqrt({mean(gap + ' * ' + gap)}) AS {prefix}wrmse_total_variance",
        f"{mean(f'abs{gap}')} AS {prefix}wmae_total_variance",
        f"{mean(gap + ' * ' + gap)} AS {prefix}mse_total_variance",
        f"sqrt({mean(iv + ' * ' + iv)}) AS {prefix}wrmse_iv",
        f"{mean(f'abs{iv}')} AS {prefix}wmae_iv",
        f"{mean(change + ' * ' + change)} AS {prefix}mse_iv_change",
        f"avg({ratio} - ln({ratio}) - 1) FILTER ({member}) AS {prefix}qlike_total_variance",
    ])


part("daily", f"""
SELECT underlying_symbol, model_name, quote_date, target_date,
       {metrics('observed', 'actual_observed_mask', 'observed_weight')},
       {metrics('full', 'true', '1E0')},
       count(*) FILTER (actual_completion_status = 'interpolated') AS interpolated_cell_count,
       count(*) FILTER (actual_completion_status = 'extrapolated_boundary_fill') AS extrapolated_cell_count,
       count(*) FILTER (actual_observed_mask) AS observed_cell_count,
       count(*) AS full_grid_cell_count
FROM joined GROUP BY ALL
""")
part("summary", """
SELECT underlying_symbol, model_name, avg(observed_mse_total_variance) AS mean_observed_mse_total_variance,
       avg(observed_qlike_total_variance) AS mean_observed_qlike_total_variance,
       stddev_samp(observed_mse_total_variance) AS std_observed_mse_total_variance,
       stddev_samp(observed_qlike_total_variance) AS std_observed_qlike_total_variance,
       count(*) AS n_target_dates
FROM daily GROUP BY ALL
""")

STRESS = [("crisis_1998", "1998-08-01", "1998-10-31"), ("late_1998", "1998-10-01", "1998-12-31"),
          ("autumn_2001", "2001-09-01", "2001-10-31")]
_families = [
    ("maturity", "maturity_days || 'd'", "CAST(maturity_days AS DOUBLE)", "true"),
    ("moneyness", "printf('%+.2f', moneyness_point)", "moneyness_point", "true"),
    *[("stress_window", f"'{label}'", "CAST(NULL AS DOUBLE)",
       f"target_date BETWEEN DATE '{a}' AND DATE '{b}'") for label, a, b in STRESS]]
part("sliced", " UNION ALL ".join(
    f"""SELECT underlying_symbol, model_name, '{family}' AS slice_family, {label} AS slice_label,
       {value} AS slice_value_float, '{scope}' AS evaluation_scope, {metrics('', member, weight)},
       count(*) FILTER ({member}) AS cell_count,
       count(DISTINCT CASE WHEN {member} THEN target_date END) AS target_day_count
FROM joined WHERE {where} GROUP BY ALL"""
    for family, label, value, where in _families
    for scope, member, weight in (("observed", "actual_observed_mask", "observed_weight"),
                                  ("full", "true", "1E0"))))

# ---- normal distribution, shape -------------------------------------------------------


def cdf(x: str) -> str:
    """Hart's approximation (West's double-precision form) as SQL text."""
    a = f"abs({x})"
    num = ["3.52624965998911E-02", "0.700383064443688E0", "6.37396220353165E0",
           "33.912866078383E0", "112.079291497871E0", "221.213596169931E0", "220.206867912376E0"]
    den = ["8.83883476483184E-02", "1.75566716318264E0", "16.064177579207E0",
           "86.7807322029461E0", "296.564248779674E0", "637.333633378831E0",
           "793.826512519948E0", "440.413735824752E0"]

    def poly(c: list[str]) -> str:
        text = c[0]
        for v in c[1:]:
            text = f"({text} * {a} + {v})"
        return text

    frac = f"({a} + 0.65E0)"
    for step in (4, 3, 2, 1):
        frac = f"({a} + {step} / {frac})"
    tail = (f"(CASE WHEN {a} > 37 THEN 0E0 WHEN {a} < 7.07106781186547E0 THEN exp(-{a} * {a} / 2) "
            f"* {poly(num)} / {poly(den)} ELSE exp(-{a} * {a} / 2) / {frac} / 2.506628274631E0 END)")
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


part("surfaces", """
SELECT underlying_symbol, model_name, split_id, quote_date, target_date, cell_index // 5 AS mi,
       cell_index % 5 AS ki, moneyness_point AS m, predicted_total_variance AS w FROM fc
UNION ALL
SELECT underlying_symbol, 'actual_surface', NULL, quote_date, quote_date, cell_index // 5, cell_index % 5,
       moneyness_point, completed_total_variance FROM gold
""")
part("shaped", f"""
SELECT *, 2 * ((lead(price) OVER k - price) / (lead(strike) OVER k - strike)
             - (price - lag(price) OVER k) / (strike - lag(strike) OVER k))
          / (lead(strike) OVER k - lag(strike) OVER k) AS curvature,
       w - lag(w) OVER t AS rise,
       lead(w) OVER t - 2 * w + lag(w) OVER t AS bend_t,
       lead(w) OVER k - 2 * w + lag(w) OVER k AS bend_k
FROM (SELECT *, {cdf('d1')} - strike * {cdf('d2')} AS price
      FROM (SELECT *, d1 - sqrt(w) AS d2
            FROM (SELECT *, exp(m) AS strike, (0.5E0 * w - m) / sqrt(w) AS d1 FROM surfaces)))
WINDOW k AS (PARTITION BY underlying_symbol, model_name, quote_date, target_date, mi ORDER BY ki),
       t AS (PARTITION BY underlying_symbol, model_name, quote_date, target_date, ki ORDER BY mi)
""")
part("shape_daily", """
SELECT underlying_symbol, model_name, quote_date, target_date,
       count(*) FILTER (rise < 0) AS calendar_violation_count,
       coalesce(-sum(rise) FILTER (rise < 0), 0) AS calendar_violation_magnitude,
       count(*) FILTER (curvature < 0) AS convexity_violation_count,
       coalesce(-sum(curvature) FILTER (curvature < 0), 0) AS convexity_violation_magnitude
FROM shaped GROUP BY ALL
""")
part("liquid", """
SELECT underlying_symbol, quote_date, count(*) FILTER (observed_mask) AS observed_cell_count,
       count(*) AS grid_cell_count, sum(vega_sum) AS daily_vega_sum,
       sum(observation_count) AS daily_option_count,
       count(*) FILTER (observed_mask) / CAST(count(*) AS DOUBLE) AS coverage_ratio,
       CASE WHEN sum(vega_sum) > 0 THEN sum(weighted_spread_1545 * vega_sum) / sum(vega_sum)
            ELSE 0 END AS daily_weighted_spread_1545
FROM gold GROUP BY ALL
""")
part("sensitive", """
SELECT underlying_symbol, quote_date, count(*) FILTER (observed_mask) AS observed_cell_count,
       count(*) AS total_cell_count, avg(abs(d)) AS mean_abs_diff, sqrt(avg(d * d)) AS rmse_diff,
       max(abs(d)) AS max_abs_diff
FROM (SELECT g.*, greatest(a.w, 1E-8) - g.completed_total_variance AS d
      FROM gold g JOIN alt_4 a USING (underlying_symbol, quote_date, cell_index)) GROUP BY ALL
""")
part("spot_days", """
SELECT underlying_symbol, quote_date, median(active_underlying_price_1545) AS spot,
       count(*) AS spot_row_count, count(DISTINCT active_underlying_price_1545) AS spot_distinct_count,
       min(active_underlying_price_1545) AS spot_min, max(active_underlying_price_1545) AS spot_max
FROM flagged WHERE is_valid_observation GROUP BY ALL
""")

# ---- forecast comparison --------------------------------------------------------------

part("melted", """
SELECT underlying_symbol, 'observed_mse_total_variance' AS loss_metric, model_name, target_date,
       observed_mse_total_variance AS loss FROM daily
UNION ALL
SELECT underlying_symbol, 'observed_qlike_total_variance', model_name, target_date,
       observed_qlike_total_variance FROM daily
""")
part("pairs", """
SELECT c.underlying_symbol, c.loss_metric, c.model_name AS model_b, c.target_date,
       b.loss AS loss_a, c.loss AS loss_b, b.loss - c.loss AS d
FROM melted c JOIN melted b USING (underlying_symbol, loss_metric, target_date)
WHERE b.model_name = 'naive' AND c.model_name <> 'naive'
""")
part("dm_lags", """
SELECT *, lag(c, 1) OVER o AS c1, lag(c, 2) OVER o AS c2
FROM (SELECT *, d - avg(d) OVER (PARTITION BY underlying_symbol, loss_metric, model_b) AS c FROM pairs)
WINDOW o AS (PARTITION BY underlying_symbol, loss_metric, model_b ORDER BY target_date)
""")
part("dm", f"""
SELECT *, 1 - {cdf('statistic')} AS p_value
FROM (SELECT *, mean_differential / sqrt(long_run_variance / n_obs) AS statistic
      FROM (SELECT underlying_symbol, loss_metric, model_b, count(*) AS n_obs,
                   avg(loss_a) AS mean_loss_a, avg(loss_b) AS mean_loss_b, avg(d) AS mean_differential,
                   greatest((sum(c * c) + 2 * (2E0 / 3E0) * sum(c * c1) + 2 * (1E0 / 3E0) * sum(c * c2))
                            / count(*), 0) AS long_run_variance
            FROM dm_lags GROUP BY ALL))
""")
part("numbered", """
SELECT *, row_number() OVER (PARTITION BY underlying_symbol, loss_metric, model_name
                             ORDER BY target_date) - 1 AS pos,
       count(*) OVER (PARTITION BY underlying_symbol, loss_metric, model_name) AS n
FROM melted
""")


def draws(seed: int) -> str:
    """Sampled positions of every replication: block 5, 500 replications."""
    p = 2147483647
    return f"""
SELECT n, rep, (start + off) % n AS pos
FROM (SELECT n, rep, k, ((a3 * 69621) % {p}) % n AS start
      FROM (SELECT n, rep, k, (a2 * a2 + k + 1) % {p} AS a3
            FROM (SELECT n, rep, k, (a1 * 48271) % {p} AS a2
                  FROM (SELECT n, rep, k, ({seed} * 7919 + rep * 104729 + k * 1299709 + 15485863)
                               % {p} AS a1
                        FROM (SELECT DISTINCT n FROM numbered), range(500) r(rep),
                             LATERAL (SELECT unnest(range(CAST(ceil(n / 5E0) AS BIGINT))) AS k)))))
     , range(5) o(off)
WHERE k * 5 + off < n
"""


part("draws_7", draws(7))
part("draws_8", draws(8))
for _seed in (7, 8):
    part(f"rep_means_{_seed}", f"""
SELECT underlying_symbol, loss_metric, model_name, rep, sum(loss) / any_value(l.n) AS rep_mean
FROM draws_{_seed} d JOIN numbered l ON d.n = l.n AND d.pos = l.pos GROUP BY ALL
""")
part("model_means", """
SELECT underlying_symbol, loss_metric, model_name, avg(loss) AS mean_loss, count(*) AS n
FROM melted GROUP BY ALL
""")
part("spa_scale", """
SELECT underlying_symbol, loss_metric, model_b, avg(d) AS mean_d, count(*) AS n,
       CASE WHEN stddev_samp(d) > 0 THEN stddev_samp(d) ELSE 1 END AS scale
FROM pairs GROUP BY ALL
""")
part("spa", """
SELECT underlying_symbol, loss_metric, any_value(observed_statistic) AS observed_statistic,
       avg(CAST(stat >= observed_statistic AS INT)) AS p_value
FROM (SELECT underlying_symbol, loss_metric, rep,
             max(sqrt(n) * (b.rep_mean - c.rep_mean - greatest(mean_d, 0)) / scale) AS stat
      FROM rep_means_7 c JOIN rep_means_7 b USING (underlying_symbol, loss_metric, rep)
      JOIN spa_scale s USING (underlying_symbol, loss_metric)
      WHERE b.model_name = 'naive' AND s.model_b = c.model_name GROUP BY ALL)
JOIN (SELECT underlying_symbol, loss_metric, max(sqrt(n) * mean_d / scale) AS observed_statistic
      FROM spa_scale GROUP BY ALL) USING (underlying_symbol, loss_metric)
GROUP BY ALL
""")


def tmax(source: str, models: str) -> str:
    """One elimination step over the models named in a table."""
    return f"""
SELECT underlying_symbol, loss_metric, any_value(t) AS test_statistic,
       avg(CAST(bt >= t AS INT)) AS p_value
FROM (SELECT underlying_symbol, loss_metric, rep, max(abs(c) / e) AS bt, max(abs(md) / e) AS t
      FROM (SELECT *, sqrt(CASE WHEN var_samp(c) OVER g > 0 THEN var_samp(c) OVER g ELSE 1 END / n) AS e
            FROM (SELECT i.underlying_symbol, i.loss_metric, i.rep, i.model_name AS a, j.model_name AS b,
                         mi.n, mi.mean_loss - mj.mean_loss AS md,
                         i.rep_mean - j.rep_mean - (mi.mean_loss - mj.mean_loss) AS c
                  FROM {source} i JOIN {source} j USING (underlying_symbol, loss_metric, rep)
                  JOIN {models} mi ON mi.underlying_symbol = i.underlying_symbol
                    AND mi.loss_metric = i.loss_metric AND mi.model_name = i.model_name
                  JOIN {models} mj ON mj.underlying_symbol = i.underlying_symbol
                    AND mj.loss_metric = i.loss_metric AND mj.model_name = j.model_name
                  WHERE i.model_name < j.model_name)
            WINDOW g AS (PARTITION BY underlying_symbol, loss_metric, a, b))
      GROUP BY ALL)
GROUP BY ALL
"""


part("tmax_7", tmax("rep_means_7", "model_means"))
part("survivors", """
SELECT m.* FROM model_means m JOIN tmax_7 t USING (underlying_symbol, loss_metric)
WHERE t.p_value < 0.1 QUALIFY row_number() OVER (PARTITION BY underlying_symbol, loss_metric
                                               ORDER BY mean_loss DESC, model_name) > 1
""")
part("tmax_8", tmax("rep_means_8", "survivors"))
part("kept", """
SELECT m.underlying_symbol, m.loss_metric, m.model_name
FROM (SELECT *, row_number() OVER (PARTITION BY underlying_symbol, loss_metric
                                   ORDER BY mean_loss DESC, model_name) AS bad FROM model_means) m
JOIN tmax_7 a USING (underlying_symbol, loss_metric)
LEFT JOIN tmax_8 b USING (underlying_symbol, loss_metric)
WHERE bad > CASE WHEN a.p_value >= 0.1 THEN 0 WHEN b.p_value >= 0.1 THEN 1 ELSE 2 END
""")

# ---- hedging --------------------------------------------------------------------------

BOOK = [("atm_call_long", "C", "1E0", "0E0", 30), ("atm_put_long", "P", "1E0", "0E0", 30),
        ("rr_put_long", "P", "1E0", "-0.1E0", 30), ("rr_call_short", "C", "-1E0", "0.1E0", 30),
        ("cal_call_long", "C", "0.5E0", "0E0", 90), ("cal_call_short", "C", "-0.5E0", "0E0", 30),
        ("cal_put_long", "P", "0.5E0", "0E0", 90), ("cal_put_short", "P", "-0.5E0", "0E0", 30)]
STRADDLE = [("hedge_call", "C", "1E0", "0E0", 30), ("hedge_put", "P", "1E0", "0E0", 30)]


def _rows(rows: list[tuple], hedge: bool) -> str:
    return ", ".join(f"('{a}', '{b}', {c}, {d}, {e}, {str(hedge).lower()})" for a, b, c, d, e in rows)


part("instruments", "SELECT * FROM (VALUES " + _rows(BOOK, False) + ", " + _rows(STRADDLE, True)
     + ") v(label, option_type, quantity, shift, days, is_hedge)")
part("trade_paths", """
SELECT DISTINCT f.underlying_symbol, f.model_name, f.quote_date, f.target_date, a.spot AS spot_t,
       b.spot AS spot_t1
FROM fc f JOIN spot_days a ON a.underlying_symbol = f.underlying_symbol AND a.quote_date = f.quote_date
JOIN spot_days b ON b.underlying_symbol = f.underlying_symbol AND b.quote_date = f.target_date
""")
part("positions_valued", """
SELECT t.underlying_symbol, t.model_name, t.quote_date, t.target_date, i.label, i.option_type,
       i.quantity, i.is_hedge, s.state, t.spot_t * exp(i.shift) AS strike,
       CASE WHEN s.state IN ('t0_actual', 'sizing') THEN t.spot_t ELSE t.spot_t1 END AS spot,
       i.days - CASE WHEN s.state = 't0_actual' THEN 0
                     ELSE date_diff('day', t.quote_date, t.target_date) END AS remaining_days
FROM trade_paths t CROSS JOIN instruments i
CROSS JOIN (SELECT unnest(['t0_actual', 't1_predicted', 't1_actual', 'sizing']) AS state) s
WHERE NOT (i.is_hedge AND s.state = 't1_predicted')
""")
part("hedge_cells", """
SELECT 'actual' AS kind, underlying_symbol, NULL AS model_name, quote_date AS at_date, maturity_days,
       moneyness_point, completed_total_variance AS w FROM gold
UNION ALL
SELECT 'predicted', underlying_symbol, model_name, target_date, maturity_days, moneyness_point,
       predicted_total_variance FROM fc
""")
part("axis_d", "SELECT * FROM (VALUES (7, 30), (30, 91), (91, 364)) v(d0, d1)")
part("axis_m", "SELECT * FROM (VALUES (-0.3E0, -0.1E0), (-0.1E0, 0E0), (0E0, 0.1E0), (0.1E0, 0.3E0)) v(m0, m1)")
part("located", """
SELECT p.*, ln(p.strike / p.spot) AS log_moneyness, d0, d1, m0, m1,
       (remaining_days - d0) / CAST(d1 - d0 AS DOUBLE) AS td, (ln(p.strike / p.spot) - m0) / (m1 - m0) AS tm,
       CASE WHEN state IN ('t0_actual', 't1_actual') THEN 'actual' ELSE 'predicted' END AS kind,
       CASE WHEN state = 't0_actual' THEN quote_date ELSE target_date END AS at_date
FROM positions_valued p
JOIN axis_d ON remaining_days >= d0 AND (remaining_days < d1 OR (d1 = 364 AND remaining_days = d1))
JOIN axis_m ON ln(p.strike / p.spot) >= m0 AND (ln(p.strike / p.spot) < m1
                                               OR (m1 = 0.3E0 AND ln(p.strike / p.spot) <= m1))
""")
part("with_sigma", """
SELECT l.underlying_symbol, l.model_name, l.quote_date, l.target_date, label, option_type, quantity,
       is_hedge, state, any_value(strike) AS strike, any_value(spot) AS spot,
       any_value(remaining_days) AS remaining_days, any_value(log_moneyness) AS log_moneyness,
       any_value(remaining_days) / 365E0 AS tau_years,
       sqrt(sum(c.w * (CASE WHEN c.maturity_days = d0 THEN 1 - td ELSE td END)
                    * (CASE WHEN c.moneyness_point = m0 THEN 1 - tm ELSE tm END))
            / (any_value(remaining_days) / 365E0)) AS sigma
FROM located l JOIN hedge_cells c
  ON c.kind = l.kind AND c.underlying_symbol = l.underlying_symbol AND c.at_date = l.at_date
 AND (l.kind = 'actual' OR c.model_name = l.model_name)
 AND c.maturity_days IN (d0, d1) AND c.moneyness_point IN (m0, m1)
GROUP BY ALL
""")
part("priced", f"""
SELECT * EXCLUDE (d1, d2),
       quantity * CASE option_type WHEN 'C' THEN spot * {cdf('d1')} - strike * {cdf('d2')}
            ELSE strike * {cdf('(-d2)')} - spot * {cdf('(-d1)')} END AS price,
       quantity * ({cdf('d1')} - CASE option_type WHEN 'C' THEN 0 ELSE 1 END) AS delta,
       quantity * spot * exp(-d1 * d1 / 2) / sqrt(2 * pi()) * sqrt(tau_years) AS vega
FROM (SELECT *, d1 - sigma * sqrt(tau_years) AS d2
      FROM (SELECT *, (ln(spot / strike) + 0.5E0 * sigma * sigma * tau_years)
                      / (sigma * sqrt(tau_years)) AS d1 FROM with_sigma))
""")
part("hedged", """
SELECT *, unhedged_pnl + straddle_quantity * (s1 - s0) + underlying_quantity * (spot_t1 - spot_t) AS hedged_pnl
FROM (SELECT *, -(bd + straddle_quantity * sd) AS underlying_quantity,
             predicted_book_value_t1 - actual_book_value_t1 AS revaluation_error,
             actual_book_value_t1 - book_value_t0 AS unhedged_pnl
      FROM (SELECT *, -bv / sv AS straddle_quantity
            FROM (SELECT underlying_symbol, model_name, quote_date, target_date,
                         max(spot) FILTER (state = 't0_actual') AS spot_t,
                         max(spot) FILTER (state = 't1_actual') AS spot_t1,
                         sum(price) FILTER (state = 't0_actual' AND NOT is_hedge) AS book_value_t0,
                         sum(price) FILTER (state = 't1_predicted' AND NOT is_hedge) AS predicted_book_value_t1,
                         sum(price) FILTER (state = 't1_actual' AND NOT is_hedge) AS actual_book_value_t1,
                         sum(price) FILTER (state = 't0_actual' AND is_hedge) AS s0,
                         sum(price) FILTER (state = 't1_actual' AND is_hedge) AS s1,
                         sum(delta) FILTER (state = 'sizing' AND NOT is_hedge) AS bd,
                         sum(vega) FILTER (state = 'sizing' AND NOT is_hedge) AS bv,
                         sum(delta) FILTER (state = 'sizing' AND is_hedge) AS sd,
                         sum(vega) FILTER (state = 'sizing' AND is_hedge) AS sv
                  FROM priced GROUP BY ALL)))
""")
part("hedge_means", """
SELECT underlying_symbol, model_name, avg(abs(revaluation_error)) AS mean_abs_revaluation_error,
       avg(revaluation_error * revaluation_error) AS mean_squared_revaluation_error,
       avg(abs(hedged_pnl)) AS mean_abs_hedged_pnl, avg(hedged_pnl * hedged_pnl) AS mean_squared_hedged_pnl,
       var_samp(hedged_pnl) AS hedged_pnl_variance, count(*) AS n_trades
FROM hedged GROUP BY ALL
""")

# ---- report tables --------------------------------------------------------------------

part("ranks", """
SELECT *, row_number() OVER (PARTITION BY underlying_symbol
                             ORDER BY mean_observed_mse_total_variance, model_name) AS rank,
       (base - mean_observed_mse_total_variance) / base * 100 AS improvement_vs_benchmark_pct
FROM summary JOIN (SELECT underlying_symbol, mean_observed_mse_total_variance AS base
                   FROM summary WHERE model_name = 'naive') USING (underlying_symbol)
""")
part("hedge_ranks", """
SELECT *, row_number() OVER (PARTITION BY underlying_symbol
                             ORDER BY mean_abs_revaluation_error, model_name) AS rank,
       (base - mean_abs_revaluation_error) / base * 100 AS improvement_vs_benchmark_pct
FROM hedge_means JOIN (SELECT underlying_symbol, mean_abs_revaluation_error AS base
                       FROM hedge_means WHERE model_name = 'naive') USING (underlying_symbol)
""")
part("tails", """
SELECT t.*, (b.p95_loss - t.p95_loss) / b.p95_loss * 100 AS p95_improvement_vs_benchmark_pct,
       (b.max_loss - t.max_loss) / b.max_loss * 100 AS max_improvement_vs_benchmark_pct
FROM tail_base t JOIN tail_base b ON b.underlying_symbol = t.underlying_symbol AND b.model_name = 'naive'
""")
part("tail_base", """
SELECT underlying_symbol, model_name, avg(v) AS mean_loss,
       max(v) FILTER (pos = CAST(floor(0.90E0 * (n - 1) + 0.5E0) AS BIGINT) + 1) AS p90_loss,
       max(v) FILTER (pos = CAST(floor(0.95E0 * (n - 1) + 0.5E0) AS BIGINT) + 1) AS p95_loss,
       max(v) FILTER (pos = CAST(floor(0.99E0 * (n - 1) + 0.5E0) AS BIGINT) + 1) AS p99_loss,
       max(v) AS max_loss, count(*) AS n_target_dates
FROM (SELECT underlying_symbol, model_name, observed_mse_total_variance AS v,
             row_number() OVER (PARTITION BY underlying_symbol, model_name
                                ORDER BY observed_mse_total_variance) AS pos,
             count(*) OVER (PARTITION BY underlying_symbol, model_name) AS n FROM daily)
GROUP BY ALL
""")
part("leaders", """
SELECT s.underlying_symbol, s.slice_family, s.slice_label, s.evaluation_scope,
       s.model_name AS best_model_name, s.wrmse_total_variance AS best_metric_value,
       b.wrmse_total_variance AS benchmark_metric_value,
       (b.wrmse_total_variance - s.wrmse_total_variance) / b.wrmse_total_variance * 100
         AS improvement_vs_benchmark_pct
FROM (SELECT *, row_number() OVER (PARTITION BY underlying_symbol, slice_family, slice_label,
        evaluation_scope ORDER BY coalesce(wrmse_total_variance, CAST('inf' AS DOUBLE)), model_name) AS r
      FROM sliced) s
JOIN sliced b USING (underlying_symbol, slice_family, slice_label, evaluation_scope)
WHERE s.r = 1 AND b.model_name = 'naive'
""")
part("cell_mses", """
SELECT underlying_symbol, maturity_days, moneyness_point, model_name, count(*) AS n,
       sum(observed_weight * (predicted_total_variance - actual_completed_total_variance) ** 2)
         / sum(observed_weight) AS mse
FROM joined WHERE actual_observed_mask GROUP BY ALL
""")
