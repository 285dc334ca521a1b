"""DuckDB SQL fragments shared by several oracle queries (the oracle side only)."""
from kassa.sources.testdata import LEDGER_CATEGORIES

WS = r"[ \t\n\r\x0B\f]"

CLEAN_LEDGER = (f"SELECT transaction_id, user_id, date, "
                f"lower(regexp_replace(description, '^{WS}+|{WS}+$', '', 'g')) AS description, "
                f"amount, category FROM ledger")

WORDS = "len(list_filter(regexp_split_to_array({x}, '" + WS + "+'), lambda t: t <> ''))"

SIZE = ("CASE WHEN {a} <= 0 THEN NULL WHEN {a} <= 10 THEN 'tiny' WHEN {a} <= 50 THEN 'small' "
        "WHEN {a} <= 100 THEN 'medium' WHEN {a} <= 500 THEN 'large' WHEN {a} IS NOT NULL THEN 'huge' END")


def calendar(d: str = "date", name: bool = True) -> str:
    parts = [f"year({d}) AS year", f"month({d}) AS month", f"day({d}) AS day",
             f"isodow({d}) - 1 AS day_of_week"]
    if name:
        parts.append(f"dayname({d}) AS day_name")
    parts += [f"weekofyear({d}) AS week_of_year", f"quarter({d}) AS quarter",
              f"CASE WHEN isodow({d}) >= 6 THEN 1 ELSE 0 END AS is_weekend",
              f"CASE WHEN day({d}) = 1 THEN 1 ELSE 0 END AS is_month_start",
              f"CASE WHEN CAST({d} AS DATE) = last_day({d}) THEN 1 ELSE 0 END AS is_month_end"]
    return ", ".join(parts)


def amounts(a: str = "amount", size: bool = True) -> str:
    parts = [f"abs({a}) AS amount_abs", f"CASE WHEN {a} > 0 THEN 1 ELSE 0 END AS is_income",
             f"CASE WHEN {a} < 0 THEN 1 ELSE 0 END AS is_expense"]
    if size:
        parts.append(SIZE.format(a=f"abs({a})") + " AS transaction_size")
    return ", ".join(parts)


def rolling(v: str, keys: str = "user_id", order: str = "date, transaction_id") -> str:
    w7 = f"(PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
    w30 = f"(PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"
    return (f"avg({v}) OVER {w7} AS rolling_7d_mean, coalesce(stddev_samp({v}) OVER {w7}, 0) AS rolling_7d_std, "
            f"avg({v}) OVER {w30} AS rolling_30d_mean, coalesce(stddev_samp({v}) OVER {w30}, 0) AS rolling_30d_std")


def days_since_last(keys: str = "user_id") -> str:
    return (f"coalesce(floor((epoch_us(date) - epoch_us(lag(date) OVER (PARTITION BY {keys} "
            f"ORDER BY date, transaction_id))) / 86400000000), 0) AS days_since_last")


def count_7d(keys: str = "user_id") -> str:
    return (f"count(*) OVER (PARTITION BY {keys} ORDER BY epoch_us(date) RANGE BETWEEN 604799999999 PRECEDING "
            f"AND 1 PRECEDING) + row_number() OVER (PARTITION BY {keys}, date ORDER BY transaction_id) "
            f"AS transaction_count_7d")


def one_hot(values=LEDGER_CATEGORIES, col: str = "category") -> str:
    return ", ".join(f"coalesce({col} = '{v}', false) AS \"cat_is_{v}\"" for v in values)


def features_training(src: str = "b", keys: str = "user_id", with_cat: bool = True) -> str:
    """E1 in SQL over a cleaned ledger relation ``src``."""
    cat_join = ("LEFT JOIN (SELECT category, avg(abs(amount)) AS cat_mean, stddev_samp(abs(amount)) AS cat_std, "
                f"count(amount) AS cat_count FROM {src} WHERE category IS NOT NULL GROUP BY category) c USING (category)"
                if with_cat else "")
    return f"""
SELECT w.*, m.* EXCLUDE ({keys}, year_month),
       m.monthly_income / (m.monthly_expense + 1) AS income_expense_ratio
       {', c.* EXCLUDE (category), ' + one_hot() if with_cat else ''}
FROM (
  SELECT {src}.*, strftime(date, '%Y-%m') AS year_month, {calendar()}, {amounts()},
         length(description) AS description_length, {WORDS.format(x='description')} AS description_word_count,
         {rolling('abs(amount)', keys)}, {days_since_last(keys)}, {count_7d(keys)}
  FROM {src}) w
LEFT JOIN (
  SELECT {keys}, strftime(date, '%Y-%m') AS year_month, sum(amount) AS monthly_total, avg(amount) AS monthly_mean,
         stddev_samp(amount) AS monthly_std, count(amount) AS monthly_count, sum(abs(amount)) AS monthly_abs_sum,
         avg(abs(amount)) AS monthly_abs_mean, coalesce(sum(amount) FILTER (WHERE amount > 0), 0) AS monthly_income,
         abs(coalesce(sum(amount) FILTER (WHERE amount < 0), 0)) AS monthly_expense
  FROM {src} GROUP BY ALL) m USING ({keys}, year_month)
{cat_join}"""


def features_serving(src: str = "b", keys: str = "user_id") -> str:
    """E2 in SQL over a cleaned ledger relation ``src``."""
    return f"""
SELECT w.*, coalesce(p.cat_mean, 0) AS cat_mean, coalesce(p.cat_std, 0) AS cat_std, coalesce(p.cat_count, 0) AS cat_count,
       m.* EXCLUDE ({keys}, year_month),
       abs(m.monthly_income) / (abs(m.monthly_expense) + 1) AS income_expense_ratio
FROM (
  SELECT {src}.*, strftime(date, '%Y-%m') AS year_month, {calendar(name=False)}, {amounts(size=False)},
         length(coalesce(description, '')) AS description_length,
         {WORDS.format(x="coalesce(description, '')")} AS description_word_count,
         {rolling('amount', keys)}, {days_since_last(keys)},
         row_number() OVER (PARTITION BY {keys}, CAST(date AS DATE) ORDER BY date, transaction_id) AS transaction_count_7d,
         substr(coalesce(description, ''), 1, 10) AS _prefix
  FROM {src}) w
LEFT JOIN (SELECT substr(coalesce(description, ''), 1, 10) AS _prefix, avg(amount) AS cat_mean,
                  stddev_samp(amount) AS cat_std, count(amount) AS cat_count FROM {src} GROUP BY 1) p USING (_prefix)
LEFT JOIN (
  SELECT {keys}, strftime(date, '%Y-%m') AS year_month, sum(amount) AS monthly_total, avg(amount) AS monthly_mean,
         coalesce(stddev_samp(amount), 0) AS monthly_std, count(amount) AS monthly_count,
         sum(abs(amount)) AS monthly_abs_sum, avg(abs(amount)) AS monthly_abs_mean,
         coalesce(sum(amount) FILTER (WHERE amount > 0), 0) AS monthly_income,
         coalesce(sum(amount) FILTER (WHERE amount < 0), 0) AS monthly_expense
  FROM {src} GROUP BY ALL) m USING ({keys}, year_month)"""


SAFE_KEY = ("coalesce(nullif(regexp_replace(regexp_replace(regexp_replace({x}, '^" + WS + "+|" + WS + "+$', '', 'g'), "
            "'[^\\p{{L}}\\p{{N}}_-]', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'category')")


def daily_sql(src: str, key: str | None) -> str:
    k = f"{key} AS series_key, " if key else "'total' AS series_key, "
    where = f" AND {key} IS NOT NULL" if key else ""
    return (f"SELECT {k}CAST(date AS DATE) AS ds, sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS y "
            f"FROM {src} WHERE date IS NOT NULL AND amount IS NOT NULL{where} GROUP BY 1, 2")


def fit_sql(daily: str, keys: str = "series_key", min_points: int = 30, safe: bool = True) -> str:
    sk = (SAFE_KEY.format(x="series_key") + " AS safe_key, ") if safe else ""
    return f"""SELECT {keys}, {sk}'moving_average_v1' AS model_type, max(ds) AS train_ds_max,
       count(*) FILTER (WHERE rn <= 7) AS window, avg(y) FILTER (WHERE rn <= 7) AS yhat,
       stddev_pop(y) FILTER (WHERE rn <= 7) AS sigma, count(*) AS n_days
FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ds DESC) AS rn FROM ({daily}) d0) r
GROUP BY {keys} HAVING count(*) >= {min_points}"""


def project_sql(models: str, days: int = 30, key: str = "series_key", keep: str = "") -> str:
    return f"""SELECT {keep}{key} AS category, g.ds AS ds, yhat, yhat - 1.96 * sigma AS yhat_lower, yhat + 1.96 * sigma AS yhat_upper,
       CAST(train_ds_max AS TIMESTAMP) AS train_ds_max
FROM ({models}) m0, unnest(generate_series(CAST(train_ds_max AS TIMESTAMP),
     CAST(train_ds_max AS TIMESTAMP) + INTERVAL {days} DAY, INTERVAL 1 DAY)) AS g(ds)"""
