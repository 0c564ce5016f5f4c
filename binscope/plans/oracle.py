"""DuckDB SQL for the registered queries (the driver's correctness oracle).

Per-column statistics are written as one ``SELECT`` per column joined with
``UNION ALL``; the generators below take the column list so the SQL and the
Spark query always cover the same columns.  Rounding mirrors
:func:`binscope.plans.queries.rounded`.
"""

from __future__ import annotations

from binscope.functions.exprs import NUMERIC_STRING_RE, TOKEN_RE, WORD_RE
from binscope.operators.types import BOOLEAN_STRINGS
from binscope.plans import fixtures as X

SQL: dict[str, str] = {}

# physical schemas of the driver tables used below: (column, kind)
SCHEMAS = {
    "lineitem": [("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"), ("l_linenumber", "int"),
                 ("l_quantity", "float"), ("l_extendedprice", "float"), ("l_discount", "float"),
                 ("l_tax", "float"), ("l_returnflag", "string"), ("l_linestatus", "string"),
                 ("l_shipdate", "temporal")],
    "orders": [("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "string"),
               ("o_totalprice", "float"), ("o_orderdate", "temporal"), ("o_orderpriority", "string")],
    "documents": [("doc_id", "int"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "int")],
    "part": [("p_partkey", "int"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "float")],
    "events": [("event_id", "int"), ("ts", "temporal"), ("user_id", "int"), ("event_type", "string"),
               ("value", "float"), ("props", "string")],
    "conversations": [("conv_id", "int"), ("turn", "int"), ("role", "string"), ("text", "string")],
    "labels": [("doc_id", "int"), ("quality", "int"), ("toxic", "int")],
}
SCHEMAS["nulls_orders"] = SCHEMAS["orders"]

# Spark datetime patterns of exprs.DATETIME_FORMATS in strftime form, same order
DUCK_DATETIME_FORMATS = ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S.%g", "%Y-%m-%dT%H:%M:%S",
                         "%Y-%m-%dT%H:%M:%S.%g", "%Y/%m/%d", "%Y/%m/%d %H:%M:%S", "%m/%d/%Y",
                         "%m/%d/%Y %H:%M:%S", "%d.%m.%Y", "%Y-%m-%d %H:%M", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S.%f",
                         "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%d %H:%M:%S%z", "%d %b %Y", "%d %B %Y",
                         "%b %d, %Y", "%B %d, %Y", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S.%fZ", "%Y-%m-%d %H:%M:%SZ")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def with_ctes(*ctes: str) -> str:
    ctes = [c for c in ctes if c]
    return ("WITH " + ",\n".join(ctes) + "\n") if ctes else ""


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(f"({p})" for p in parts)


# ---------------------------------------------------------------------------
# C: column statistics and the type rule
# ---------------------------------------------------------------------------
def column_stats_sql(src: str, cols: list[tuple[str, str]]) -> str:
    """One row per column: column_name, position, kind, n_rows, n_null, n_distinct, n_bad_numeric,
    dt_ok (a format parses every value), max_tokens, max_token_freq."""
    parts = []
    for i, (c, kind) in enumerate(cols):
        vc = f"(SELECT CAST({c} AS VARCHAR) AS v, count(*) AS cnt FROM {src} GROUP BY 1)"
        nonblank = "v IS NOT NULL AND trim(v) <> ''"
        if kind == "string":
            bad = f"count(*) FILTER (WHERE {nonblank} AND NOT regexp_matches(v, {q(NUMERIC_STRING_RE)}))"
            boolean_like = ("coalesce(sum(cnt) FILTER (WHERE v IS NOT NULL AND lower(trim(v)) IN ("
                            + ", ".join(q(b) for b in BOOLEAN_STRINGS) + ")), 0)")
            dt_checks = " OR ".join(
                f"count(*) FILTER (WHERE {nonblank} AND try_strptime(v, {q(f)}) IS NULL) = 0"
                for f in DUCK_DATETIME_FORMATS)
            dt_ok = f"(count(*) FILTER (WHERE {nonblank}) > 0 AND ({dt_checks}))"
            tok = (f"(SELECT max(nt) AS mt, max(fr) AS mf FROM (SELECT t, sum(cnt) AS fr, max(nt) AS nt FROM "
                   f"(SELECT cnt, len(regexp_extract_all(v, {q(TOKEN_RE)})) AS nt, "
                   f"unnest(regexp_extract_all(v, {q(TOKEN_RE)})) AS t FROM {vc} WHERE v IS NOT NULL) "
                   f"GROUP BY t))")
        else:
            bad, dt_ok, tok = "0", "false", "(SELECT NULL AS mt, NULL AS mf)"
            boolean_like = "0"
        parts.append(
            f"SELECT {q(c)} AS column_name, {i} AS position, {q(kind)} AS kind, "
            f"coalesce(sum(cnt), 0) AS n_rows, coalesce(sum(cnt) FILTER (WHERE v IS NULL), 0) AS n_null, "
            f"count(v) AS n_distinct, {bad} AS n_bad_numeric, {dt_ok} AS dt_ok, {boolean_like} AS n_boolean_like, "
            f"(SELECT mt FROM {tok}) AS max_tokens, (SELECT mf FROM {tok}) AS max_token_freq FROM {vc}")
    return union(parts)


def types_rule_sql(stats: str) -> str:
    """The ordered rule over ``column_stats_sql`` rows -> (column_name, position, data_type)."""
    return f"""SELECT column_name, position,
  CASE WHEN n_distinct < 1 THEN 'Unsupported'
       WHEN (CASE WHEN kind IN ('int','float','bool','temporal') OR (kind = 'string' AND n_bad_numeric = 0)
                  THEN n_distinct <= 8 AND kind = 'int' AND n_null = 0
                  ELSE n_distinct <= 20 END)
            AND n_distinct / nullif(n_rows - n_null, 0) <= 0.2 THEN 'Categorical'
       WHEN kind = 'temporal' THEN 'DateTime'
       WHEN kind IN ('int','float','bool') THEN 'Numeric'
       WHEN kind = 'string' AND n_bad_numeric = 0 THEN 'Numeric'
       WHEN kind = 'string' AND dt_ok THEN 'DateTime'
       WHEN kind = 'string' AND max_tokens > 5 AND max_token_freq > 3 THEN 'Text'
       ELSE 'Id' END AS data_type
FROM ({stats})"""


def types_sql(table: str, cte: str = "") -> str:
    return with_ctes(cte) + types_rule_sql(column_stats_sql(table, SCHEMAS[table]))


for _t in ("lineitem", "orders", "documents", "part", "events", "conversations", "labels"):
    SQL[f"get_data_types_{_t}"] = types_sql(_t)
SQL["get_data_types_nulls_orders"] = types_sql("nulls_orders", X.NULLS_ORDERS_SQL)

SQL["numeric_columns_documents"] = f"""
SELECT column_name, position,
       (kind IN ('int','float','bool','temporal') OR (kind = 'string' AND n_bad_numeric = 0)) AS is_numeric
FROM ({column_stats_sql('documents', SCHEMAS['documents'])})"""

SQL["invert_type_map_lineitem"] = f"""
SELECT data_type, string_agg(column_name, ',' ORDER BY position) AS columns
FROM ({types_sql('lineitem')}) GROUP BY data_type"""

SQL["guess_roles_events"] = f"""
SELECT column_name, min(position) AS position
FROM ({types_sql('events')}) WHERE data_type IN ('Numeric','Categorical','Text') GROUP BY column_name"""

SQL["role_candidates_lineitem"] = f"""
WITH t AS ({types_sql('lineitem')}),
y AS (SELECT column_name, min(CASE data_type WHEN 'Numeric' THEN 0 ELSE 1 END) AS o, min(position) AS p
      FROM t WHERE data_type IN ('Numeric','Categorical') GROUP BY column_name),
x AS (SELECT column_name, min(CASE data_type WHEN 'Numeric' THEN 0 WHEN 'Text' THEN 1 ELSE 2 END) AS o,
             min(position) AS p
      FROM t WHERE data_type IN ('Numeric','Text','Categorical') AND column_name <> 'l_extendedprice'
      GROUP BY column_name)
SELECT 'y' AS role, column_name, CAST(row_number() OVER (ORDER BY o, p) AS INTEGER) AS rank FROM y
UNION ALL
SELECT 'x' AS role, column_name, CAST(row_number() OVER (ORDER BY o, p) AS INTEGER) AS rank FROM x"""


# ---------------------------------------------------------------------------
# D: profile
# ---------------------------------------------------------------------------
def profile_table_sql(src: str, cte: str, cols: list[tuple[str, str]]) -> str:
    k = len(cols)
    ms = [f"(count(*) - count({c}))" for c, _ in cols]
    total = " + ".join(ms)
    with_m = " + ".join(f"CAST({m} > 0 AS INTEGER)" for m in ms)
    all_m = " + ".join(f"CAST({m} = count(*) AND count(*) > 0 AS INTEGER)" for m in ms)
    return with_ctes(cte) + f"""SELECT count(*) AS n_rows, CAST({k} AS BIGINT) AS n_columns,
  CAST({total} AS BIGINT) AS n_cells_missing, round(({total}) / nullif(count(*) * {k}.0, 0), 6) AS p_cells_missing,
  CAST({with_m} AS BIGINT) AS n_columns_with_missing, CAST({all_m} AS BIGINT) AS n_columns_all_missing
FROM {src}"""


SQL["profile_table"] = profile_table_sql("nulls_orders", X.NULLS_ORDERS_SQL, SCHEMAS["orders"])


def profile_common_sql(src: str, cte: str, cols: list[tuple[str, str]]) -> str:
    parts = []
    for i, (c, _) in enumerate(cols):
        parts.append(f"""SELECT {q(c)} AS column_name, {i} AS position,
  CAST(coalesce(sum(cnt) FILTER (WHERE v IS NOT NULL), 0) AS BIGINT) AS n,
  CAST(coalesce(sum(cnt) FILTER (WHERE v IS NULL), 0) AS BIGINT) AS n_missing,
  round(coalesce(sum(cnt) FILTER (WHERE v IS NULL), 0) / nullif(sum(cnt), 0), 6) AS p_missing,
  count(v) AS n_distinct,
  round(count(v) / nullif(coalesce(sum(cnt) FILTER (WHERE v IS NOT NULL), 0), 0), 6) AS p_distinct,
  count(*) FILTER (WHERE v IS NOT NULL AND cnt = 1) AS n_unique,
  round(count(*) FILTER (WHERE v IS NOT NULL AND cnt = 1)
        / nullif(coalesce(sum(cnt) FILTER (WHERE v IS NOT NULL), 0), 0), 6) AS p_unique,
  (count(*) FILTER (WHERE v IS NOT NULL AND cnt = 1) = coalesce(sum(cnt) FILTER (WHERE v IS NOT NULL), 0)
   AND coalesce(sum(cnt) FILTER (WHERE v IS NOT NULL), 0) > 0) AS is_unique
FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS cnt FROM {src} GROUP BY 1)""")
    return with_ctes(cte) + union(parts)


SQL["profile_common"] = profile_common_sql("nulls_orders", X.NULLS_ORDERS_SQL, SCHEMAS["orders"])
SQL["profile_common_lineitem"] = profile_common_sql("lineitem", "", SCHEMAS["lineitem"])


def profile_numeric_sql(src: str, cte: str, names: list[str]) -> str:
    parts = []
    for i, c in enumerate(names):
        parts.append(f"""SELECT {q(c)} AS column_name, {i} AS position, count(x) AS n,
  round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(var_samp(x), 2) AS variance,
  round(min(x), 6) AS min, round(max(x), 6) AS max, round(sum(x), 2) AS sum,
  round(max(x) - min(x), 6) AS range, round(stddev_samp(x) / nullif(avg(x), 0), 6) AS cv,
  count(*) FILTER (WHERE x = 0) AS n_zeros, round(count(*) FILTER (WHERE x = 0) / nullif(count(x), 0), 6) AS p_zeros,
  count(*) FILTER (WHERE x < 0) AS n_negative,
  round(count(*) FILTER (WHERE x < 0) / nullif(count(x), 0), 6) AS p_negative,
  count(*) FILTER (WHERE isinf(r)) AS n_infinite,
  round(count(*) FILTER (WHERE isinf(r)) / nullif(count(r), 0), 6) AS p_infinite,
  round(skewness(x), 6) AS skewness, round(kurtosis(x), 6) AS kurtosis
FROM (SELECT CAST({c} AS DOUBLE) AS r, CASE WHEN isinf(CAST({c} AS DOUBLE)) THEN NULL
      ELSE CAST({c} AS DOUBLE) END AS x FROM {src})""")
    return with_ctes(cte) + union(parts)


SQL["profile_numeric"] = profile_numeric_sql("lineitem", "", X.LINEITEM_NUMERIC)

SQL["profile_moments"] = union([
    f"SELECT {q(c)} AS column_name, {i} AS position, round(skewness(CAST({c} AS DOUBLE)), 6) AS skewness, "
    f"round(kurtosis(CAST({c} AS DOUBLE)), 6) AS kurtosis FROM lineitem"
    for i, c in enumerate(X.LINEITEM_NUMERIC)])


def profile_quantiles_sql(src: str, cte: str, names: list[str]) -> str:
    parts = []
    for i, c in enumerate(names):
        x = f"CAST({c} AS DOUBLE)"
        qs = ", ".join(f"round(quantile_cont({x}, {p}), 6) AS p{round(p * 100):02d}"
                       for p in (0.05, 0.25, 0.5, 0.75, 0.95))
        parts.append(f"""SELECT {q(c)} AS column_name, {i} AS position, {qs},
  round(quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25), 6) AS iqr,
  round((SELECT quantile_cont(abs({x} - m.med), 0.5) FROM {src},
         (SELECT quantile_cont({x}, 0.5) AS med FROM {src}) m), 6) AS mad
FROM {src} WHERE {c} IS NOT NULL""")
    return with_ctes(cte) + union(parts)


SQL["quantile_sketch_error"] = union([
    f"SELECT {q(c)} AS column_name, {i} AS position, CAST(p AS DOUBLE) AS prob, count({c}) AS n, true AS within "
    f"FROM lineitem, (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS p) GROUP BY p"
    for i, c in enumerate(X.LINEITEM_NUMERIC)])
SQL["profile_quantiles"] = profile_quantiles_sql("lineitem", "", X.LINEITEM_NUMERIC)
SQL["profile_quantiles_nulls"] = profile_quantiles_sql("nulls_orders", X.NULLS_ORDERS_SQL,
                                                       ["o_totalprice", "o_custkey"])

SQL["profile_extremes"] = union([
    f"""SELECT column_name, side, CAST(rank AS INTEGER) AS rank, round(value, 6) AS value, cnt FROM (
  SELECT {q(c)} AS column_name, s.side, row_number() OVER (PARTITION BY s.side ORDER BY
         CASE WHEN s.side = 'min' THEN v ELSE -v END) AS rank, v AS value, cnt
  FROM (SELECT CAST({c} AS DOUBLE) AS v, count(*) AS cnt FROM lineitem GROUP BY 1) vc,
       (SELECT 'min' AS side UNION ALL SELECT 'max') s) WHERE rank <= 5"""
    for c in X.LINEITEM_NUMERIC])


def profile_top_values_sql(src: str, cte: str, names: list[str], k: int = 10) -> str:
    parts = []
    for c in names:
        parts.append(f"""SELECT {q(c)} AS column_name, CAST(rank AS INTEGER) AS rank, value, cnt,
  round(cnt / tot, 6) AS share FROM (
  SELECT v AS value, cnt, row_number() OVER (ORDER BY cnt DESC, v) AS rank, sum(cnt) OVER () AS tot
  FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS cnt FROM {src} WHERE {c} IS NOT NULL GROUP BY 1))
  WHERE rank <= {k}
UNION ALL
SELECT {q(c)}, CAST({k + 1} AS INTEGER), '(other)', CAST(sum(cnt) AS BIGINT), round(sum(cnt) / max(tot), 6) FROM (
  SELECT cnt, row_number() OVER (ORDER BY cnt DESC, v) AS rank, sum(cnt) OVER () AS tot
  FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS cnt FROM {src} WHERE {c} IS NOT NULL GROUP BY 1))
  WHERE rank > {k} HAVING count(*) > 0""")
    return with_ctes(cte) + union(parts)


SQL["profile_top_values"] = profile_top_values_sql("nulls_orders", X.NULLS_ORDERS_SQL,
                                                   ["o_orderstatus", "o_orderpriority", "o_custkey"])

SQL["profile_histogram"] = union([
    f"""SELECT {q(c)} AS column_name, CAST(b AS INTEGER) AS bin, round(lo + b * ((hi - lo) / 10), 6) AS lo,
  round(lo + (b + 1) * ((hi - lo) / 10), 6) AS hi, count(*) AS cnt FROM (
  SELECT CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / ((hi - lo) / 10)), 9) END AS b, lo, hi
  FROM (SELECT CAST({c} AS DOUBLE) AS x FROM lineitem),
       (SELECT min(CAST({c} AS DOUBLE)) AS lo, max(CAST({c} AS DOUBLE)) AS hi FROM lineitem))
GROUP BY b, lo, hi""" for c in X.LINEITEM_NUMERIC])

SQL["profile_categorical"] = union([
    f"""SELECT {q(c)} AS column_name, {i} AS position, count(*) AS n_distinct,
  first(v ORDER BY cnt DESC, v) AS top, CAST(max(cnt) AS BIGINT) AS freq,
  round(sum(-(cnt / tot) * log2(cnt / tot)), 6) AS entropy,
  round(CASE WHEN count(*) > 1 THEN 1 - sum(-(cnt / tot) * log2(cnt / tot)) / log2(count(*)) ELSE 0.0 END, 6)
    AS imbalance
FROM (SELECT v, cnt, sum(cnt) OVER () AS tot FROM
      (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS cnt FROM lineitem WHERE {c} IS NOT NULL GROUP BY 1))"""
    for i, c in enumerate(["l_returnflag", "l_linestatus", "l_linenumber"])])

SQL["profile_datetime"] = """SELECT 'l_shipdate' AS column_name, 0 AS position,
  strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S') AS min, strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') AS max,
  round((epoch_us(max(l_shipdate)) - epoch_us(min(l_shipdate))) / 1e6, 6) AS range_seconds,
  count(DISTINCT l_shipdate) AS n_distinct
FROM lineitem"""

SQL["profile_boolean"] = with_ctes(X.BOOL_LINEITEM_SQL) + union([
    f"""SELECT {q(c)} AS column_name, {i} AS position, count(*) FILTER (WHERE {c}) AS n_true,
  count(*) FILTER (WHERE NOT {c}) AS n_false, round(count(*) FILTER (WHERE {c}) / nullif(count({c}), 0), 6) AS p_true,
  round(count(*) FILTER (WHERE NOT {c}) / nullif(count({c}), 0), 6) AS p_false FROM bool_lineitem"""
    for i, c in enumerate(["is_returned", "big_discount"])])

SQL["profile_text"] = union([
    f"""SELECT {q(c)} AS column_name, {i} AS position, count(DISTINCT {c}) AS n_distinct,
  CAST(min(length({c})) AS BIGINT) AS min_length, round(avg(length({c})), 6) AS mean_length,
  CAST(max(length({c})) AS BIGINT) AS max_length FROM documents WHERE {c} IS NOT NULL"""
    for i, c in enumerate(["text", "lang"])])

SQL["word_frequencies"] = f"""SELECT 'text' AS column_name, token, count(*) AS cnt FROM
  (SELECT unnest(regexp_extract_all(lower(text), {q(WORD_RE)})) AS token FROM documents) GROUP BY token"""

SQL["word_frequencies_tokens"] = f"""SELECT 'text' AS column_name, token, count(*) AS cnt FROM
  (SELECT unnest(regexp_extract_all(text, {q(TOKEN_RE)})) AS token FROM conversations) GROUP BY token"""


# ---------------------------------------------------------------------------
# E: binning tables with fixed splits
# ---------------------------------------------------------------------------
def _fmt2(v: float) -> str:
    return f"{v:.2f}"


def skeleton_sql(splits: dict[str, list[float]], label_length: int | None = None) -> str:
    rows = []
    for p, (f, cuts) in enumerate(splits.items()):
        edges = [None] + list(cuts) + [None]
        for i in range(len(cuts) + 1):
            lo, hi = edges[i], edges[i + 1]
            if lo is None and hi is None:
                label = "(-inf, inf)"
            elif lo is None:
                label = f"(-inf, {_fmt2(hi)})"
            elif hi is None:
                label = f"[{_fmt2(lo)}, inf)"
            else:
                label = f"[{_fmt2(lo)}, {_fmt2(hi)})"
            if label_length and len(label) > label_length:
                label = label[:label_length] + "..."
            rows.append(f"({q(f)}, {p}, {i}, {'NULL' if lo is None else lo}, {'NULL' if hi is None else hi}, "
                        f"'regular', {q(label)})")
        rows.append(f"({q(f)}, {p}, {len(cuts) + 1}, NULL, NULL, 'special', 'Special')")
        rows.append(f"({q(f)}, {p}, {len(cuts) + 2}, NULL, NULL, 'missing', 'Missing')")
    return ("sk AS (SELECT factor, CAST(position AS INTEGER) AS position, CAST(bin_id AS INTEGER) AS bin_id, "
            "CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, kind, bin FROM (VALUES "
            + ", ".join(rows) + ") v(factor, position, bin_id, lo, hi, kind, bin))")


def assigned_sql(src: str, splits: dict[str, list[float]], y_sql: str) -> str:
    parts = []
    for p, (f, cuts) in enumerate(splits.items()):
        x = f"CAST({f} AS DOUBLE)"
        case = f"CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN {len(cuts) + 2} " + \
            " ".join(f"WHEN {x} < {c} THEN {i}" for i, c in enumerate(cuts)) + f" ELSE {len(cuts)} END"
        parts.append(f"SELECT {q(f)} AS factor, {p} AS position, CAST({case} AS INTEGER) AS bin_id, "
                     f"{x} AS x, {y_sql} AS y FROM {src}")
    return "d AS (" + union(parts) + ")"


def continuous_table_sql(src: str, cte: str, splits, y: str, label_length=None) -> str:
    return with_ctes(cte, skeleton_sql(splits, label_length), assigned_sql(src, splits, f"CAST({y} AS DOUBLE)"),
                     """st AS (SELECT factor, bin_id, count(*) AS n, sum(y) AS sum_y, stddev_pop(y) AS sd,
  min(y) AS min_y, max(y) AS max_y, count(*) FILTER (WHERE y = 0) AS zeros, min(x) AS min_x, max(x) AS max_x
  FROM d WHERE y IS NOT NULL GROUP BY 1, 2)""",
                     """t AS (SELECT sk.*, coalesce(n, 0) AS n, coalesce(sum_y, 0) AS sum_y,
  sd, min_y, max_y, coalesce(zeros, 0) AS zeros, min_x, max_x,
  sum(coalesce(n, 0)) OVER (PARTITION BY sk.factor) AS tot_n,
  sum(coalesce(sum_y, 0)) OVER (PARTITION BY sk.factor) AS tot_sum
  FROM sk LEFT JOIN st ON sk.factor = st.factor AND sk.bin_id = st.bin_id)""",
                     """r AS (SELECT factor, position, bin_id, bin, kind, lo, hi, CAST(n AS BIGINT) AS count,
  n / nullif(tot_n, 0) AS count_pct, sum_y AS sum,
  sd AS std,
  sum_y / nullif(n, 0) AS mean, min_y AS min, max_y AS max, CAST(zeros AS BIGINT) AS zeros,
  coalesce(sum_y / nullif(n, 0) - tot_sum / nullif(tot_n, 0), 0) AS woe,
  coalesce(abs(sum_y / nullif(n, 0) - tot_sum / nullif(tot_n, 0)) * n / nullif(tot_n, 0), 0) AS iv,
  min_x, max_x FROM t)""",
                     """sa AS (SELECT factor AS f, stddev_pop(y) AS sd_all FROM d WHERE y IS NOT NULL GROUP BY 1)""",
                     """tt AS (SELECT factor, position, sum(count) AS count, sum(sum) AS sum,
  min(min) AS min, max(max) AS max, sum(zeros) AS zeros, sum(abs(woe)) AS woe, sum(iv) AS iv,
  min(min_x) AS min_x, max(max_x) AS max_x FROM r GROUP BY 1, 2)""") + \
        """SELECT factor, position, bin_id, bin, kind, round(lo, 6) AS lo, round(hi, 6) AS hi, count,
  round(count_pct, 6) AS count_pct, round(sum, 2) AS sum, round(std, 4) AS std, round(mean, 4) AS mean,
  round(min, 6) AS min, round(max, 6) AS max, zeros, round(woe, 4) AS woe, round(iv, 4) AS iv,
  round(min_x, 6) AS min_x, round(max_x, 6) AS max_x FROM r
UNION ALL
SELECT factor, position, CAST(NULL AS INTEGER), 'Totals', 'totals', NULL, NULL, CAST(count AS BIGINT),
  CASE WHEN count > 0 THEN 1.0 END, round(sum, 2),
  round(sd_all, 4),
  round(sum / nullif(count, 0), 4), round(min, 6), round(max, 6), CAST(zeros AS BIGINT), round(woe, 4),
  round(iv, 4), round(min_x, 6), round(max_x, 6) FROM tt LEFT JOIN sa ON sa.f = tt.factor"""


def binary_table_body_sql() -> list[str]:
    return ["""st AS (SELECT factor, bin_id, count(*) AS n, sum(y) AS events, min(x) AS min_x, max(x) AS max_x
  FROM d WHERE y IS NOT NULL GROUP BY 1, 2)""",
            """t AS (SELECT sk.*, coalesce(n, 0) AS n, coalesce(events, 0) AS e, min_x, max_x,
  sum(coalesce(n, 0)) OVER (PARTITION BY sk.factor) AS tot_n,
  sum(coalesce(events, 0)) OVER (PARTITION BY sk.factor) AS tot_e
  FROM sk LEFT JOIN st ON sk.factor = st.factor AND sk.bin_id = st.bin_id)""",
            """pq AS (SELECT *, (n - e) / nullif(tot_n - tot_e, 0) AS p, e / nullif(tot_e, 0) AS q FROM t)""",
            """r AS (SELECT factor, position, bin_id, bin, kind, lo, hi, CAST(n AS BIGINT) AS count,
  n / nullif(tot_n, 0) AS count_pct, CAST(n - e AS BIGINT) AS non_event, CAST(e AS BIGINT) AS event,
  e / nullif(n, 0) AS event_rate,
  CASE WHEN e > 0 AND n - e > 0 THEN ln(p / q) ELSE 0 END AS woe,
  CASE WHEN e > 0 AND n - e > 0 THEN (p - q) * ln(p / q) ELSE 0 END AS iv,
  coalesce(0.5 * (CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END
                + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END), 0) AS js,
  min_x, max_x FROM pq)"""]


def binary_table_sql(src: str, cte: str, splits, y_sql: str) -> str:
    return with_ctes(cte, skeleton_sql(splits), assigned_sql(src, splits, y_sql), *binary_table_body_sql()) + \
        """SELECT factor, position, bin_id, bin, kind, round(lo, 6) AS lo, round(hi, 6) AS hi, count,
  round(count_pct, 6) AS count_pct, non_event, event, round(event_rate, 6) AS event_rate, round(woe, 6) AS woe,
  round(iv, 6) AS iv, round(js, 6) AS js, round(min_x, 6) AS min_x, round(max_x, 6) AS max_x FROM r
UNION ALL
SELECT factor, position, CAST(NULL AS INTEGER), 'Totals', 'totals', NULL, NULL, CAST(sum(count) AS BIGINT),
  CASE WHEN sum(count) > 0 THEN 1.0 END, CAST(sum(non_event) AS BIGINT), CAST(sum(event) AS BIGINT),
  round(sum(event) / nullif(sum(count), 0), 6), NULL, round(sum(iv), 6), round(sum(js), 6),
  round(min(min_x), 6), round(max(max_x), 6) FROM r GROUP BY factor, position"""


def multiclass_table_sql(src: str, cte: str, splits, y_sql: str) -> str:
    return with_ctes(cte, skeleton_sql(splits), assigned_sql(src, splits, y_sql),
                     "st AS (SELECT factor, bin_id, y AS class, count(*) AS n FROM d WHERE y IS NOT NULL GROUP BY 1, 2, 3)",
                     "cl AS (SELECT DISTINCT factor, class FROM st)",
                     """j AS (SELECT sk.*, cl.class, coalesce(st.n, 0) AS n FROM sk JOIN cl ON sk.factor = cl.factor
  LEFT JOIN st ON sk.factor = st.factor AND sk.bin_id = st.bin_id AND cl.class = st.class)""",
                     """r AS (SELECT factor, position, bin_id, bin, kind, lo, hi, class,
  sum(n) OVER (PARTITION BY factor, bin_id) AS count, n AS event,
  n / nullif(sum(n) OVER (PARTITION BY factor, bin_id), 0) AS event_rate,
  sum(n) OVER (PARTITION BY factor, bin_id) / nullif(sum(n) OVER (PARTITION BY factor), 0) AS count_pct FROM j)""",
                     """tt AS (SELECT factor, position, class, sum(event) AS event FROM r GROUP BY 1, 2, 3)""") + \
        """SELECT factor, position, bin_id, bin, kind, round(lo, 6) AS lo, round(hi, 6) AS hi, class,
  CAST(count AS BIGINT) AS count, CAST(event AS BIGINT) AS event, round(event_rate, 6) AS event_rate,
  round(count_pct, 6) AS count_pct FROM r
UNION ALL
SELECT factor, position, CAST(NULL AS INTEGER), 'Totals', 'totals', NULL, NULL, class,
  CAST(sum(event) OVER (PARTITION BY factor) AS BIGINT), CAST(event AS BIGINT),
  round(event / nullif(sum(event) OVER (PARTITION BY factor), 0), 6),
  CASE WHEN sum(event) OVER (PARTITION BY factor) > 0 THEN 1.0 END FROM tt"""


_LI = "lineitem"
_REG_Y = "l_extendedprice"
SQL["binning_table_continuous"] = continuous_table_sql(_LI, "", X.REG_SPLITS, _REG_Y)
SQL["binning_table_binary"] = binary_table_sql("bin_lineitem", X.BIN_LINEITEM_SQL, X.BIN_SPLITS, "y")
SQL["binning_table_multiclass"] = multiclass_table_sql(_LI, "", X.BIN_SPLITS, "l_returnflag")

SQL["assign_bin"] = with_ctes(assigned_sql(_LI, X.BIN_SPLITS, f"CAST({_REG_Y} AS DOUBLE)")) + \
    "SELECT factor, position, bin_id, x, y FROM d"

SQL["bin_labels"] = with_ctes(skeleton_sql(X.REG_SPLITS, 9)) + "SELECT factor, bin_id, bin FROM sk " \
    "UNION ALL SELECT DISTINCT factor, CAST(NULL AS INTEGER), 'Totals' FROM sk"


def trend_sql(table_sql: str, metric: str, group: str = "factor") -> str:
    """E15 over the regular bins of a table given as SQL."""
    return f"""SELECT {group}, CASE WHEN count(*) <= 1 THEN 'undefined'
    WHEN count(*) FILTER (WHERE dd < 0) = 0 THEN 'ascending'
    WHEN count(*) FILTER (WHERE dd > 0) = 0 THEN 'descending'
    WHEN max(bin_id) FILTER (WHERE dd > 0) < min(bin_id) FILTER (WHERE dd < 0) THEN 'peak'
    WHEN max(bin_id) FILTER (WHERE dd < 0) < min(bin_id) FILTER (WHERE dd > 0) THEN 'valley'
    ELSE 'no monotonic' END AS monotonic_trend
FROM (SELECT {group}, bin_id, {metric} - lag({metric}) OVER (PARTITION BY {group} ORDER BY bin_id) AS dd
      FROM ({table_sql}) WHERE kind = 'regular') GROUP BY {group}"""


def _unrounded_cont_sql() -> str:
    return with_ctes(skeleton_sql(X.REG_SPLITS), assigned_sql(_LI, X.REG_SPLITS, f"CAST({_REG_Y} AS DOUBLE)"),
                     """st AS (SELECT factor, bin_id, count(*) AS n, sum(y) AS sum_y FROM d WHERE y IS NOT NULL
  GROUP BY 1, 2)""",
                     """t AS (SELECT sk.*, coalesce(n, 0) AS n, coalesce(sum_y, 0) AS sum_y,
  sum(coalesce(n, 0)) OVER (PARTITION BY sk.factor) AS tot_n,
  sum(coalesce(sum_y, 0)) OVER (PARTITION BY sk.factor) AS tot_sum
  FROM sk LEFT JOIN st ON sk.factor = st.factor AND sk.bin_id = st.bin_id)""") + \
        """SELECT factor, position, bin_id, kind, sum_y / nullif(n, 0) AS mean,
  coalesce(sum_y / nullif(n, 0) - tot_sum / nullif(tot_n, 0), 0) AS woe,
  coalesce(abs(sum_y / nullif(n, 0) - tot_sum / nullif(tot_n, 0)) * n / nullif(tot_n, 0), 0) AS iv FROM t"""


def _unrounded_bin_sql() -> str:
    return with_ctes(X.BIN_LINEITEM_SQL, skeleton_sql(X.BIN_SPLITS), assigned_sql("bin_lineitem", X.BIN_SPLITS, "y"),
                     *binary_table_body_sql()) + "SELECT * FROM r"


SQL["monotonic_trend"] = trend_sql(_unrounded_cont_sql(), "mean")

SQL["continuous_summary"] = f"""WITH c AS ({_unrounded_cont_sql()}),
tr AS ({trend_sql('SELECT * FROM c', 'mean')})
SELECT c.factor, min(position) AS position, CAST(count(*) FILTER (WHERE kind = 'regular') AS INTEGER) AS n_bins,
  round(sum(abs(woe)), 4) AS woe, round(sum(iv), 4) AS iv, min(tr.monotonic_trend) AS monotonic_trend
FROM c JOIN tr ON c.factor = tr.factor GROUP BY c.factor"""

SQL["iv_js_gini"] = f"""WITH b AS ({_unrounded_bin_sql()}),
tr AS ({trend_sql('SELECT * FROM b', 'event_rate')}),
g0 AS (SELECT factor, event / sum(event) OVER (PARTITION BY factor) AS e,
              non_event / sum(non_event) OVER (PARTITION BY factor) AS ne, event_rate, bin_id
       FROM b WHERE count > 0),
g1 AS (SELECT factor, e, ne, sum(e) OVER (PARTITION BY factor ORDER BY event_rate DESC, bin_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ce FROM g0),
g AS (SELECT factor, abs(2 * sum(ne * (2 * ce - e) / 2) - 1) AS gini FROM g1 GROUP BY factor)
SELECT b.factor, min(position) AS position, CAST(count(*) FILTER (WHERE kind = 'regular') AS INTEGER) AS n_bins,
  round(sum(iv), 6) AS iv, round(sum(js), 6) AS js, round(coalesce(min(g.gini), 0), 6) AS gini,
  min(tr.monotonic_trend) AS monotonic_trend
FROM b JOIN tr ON b.factor = tr.factor LEFT JOIN g ON b.factor = g.factor GROUP BY b.factor"""

SQL["event_rates"] = f"""WITH b AS ({_unrounded_bin_sql()})
SELECT factor, string_agg(bin, '|' ORDER BY bin_id) AS bins,
  string_agg(printf('%.6f', event_rate), '|' ORDER BY bin_id) AS event_rates
FROM b WHERE kind = 'regular' GROUP BY factor"""

SQL["multiclass_summary"] = with_ctes(
    skeleton_sql(X.BIN_SPLITS), assigned_sql(_LI, X.BIN_SPLITS, "l_returnflag"),
    "st AS (SELECT factor, bin_id, y AS class, count(*) AS n FROM d WHERE y IS NOT NULL GROUP BY 1, 2, 3)",
    "cl AS (SELECT DISTINCT factor, class FROM st)",
    """j AS (SELECT sk.*, cl.class, coalesce(st.n, 0) AS n FROM sk JOIN cl ON sk.factor = cl.factor
  LEFT JOIN st ON sk.factor = st.factor AND sk.bin_id = st.bin_id AND cl.class = st.class)""",
    """r AS (SELECT factor, position, bin_id, kind, class, n AS event,
  n / nullif(sum(n) OVER (PARTITION BY factor, bin_id), 0) AS event_rate,
  n / nullif(sum(n) OVER (PARTITION BY factor, class), 0) AS p FROM j)""",
    """h AS (SELECT factor, class, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) AS h FROM r GROUP BY 1, 2)""",
    """mh AS (SELECT factor, avg(h) AS mh, count(*) AS nc FROM h GROUP BY 1)""",
    """mx AS (SELECT r.factor, sum(p) / min(nc) AS m FROM r JOIN mh ON r.factor = mh.factor GROUP BY r.factor, bin_id)""",
    """js AS (SELECT mx.factor, sum(CASE WHEN m > 0 THEN -m * ln(m) ELSE 0 END) - min(mh.mh) AS js
  FROM mx JOIN mh ON mx.factor = mh.factor GROUP BY mx.factor)""",
    f"""tr AS ({trend_sql('SELECT * FROM r', 'event_rate', 'factor, class')})""",
    """trs AS (SELECT factor, string_agg(printf('Class[%d]]:%s=%s', i, class, monotonic_trend), ' , ' ORDER BY i) AS t
  FROM (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY class) - 1 AS i FROM tr) GROUP BY factor)""") + \
    """SELECT s.factor, min(s.position) AS position, CAST(count(DISTINCT s.bin_id) AS INTEGER) AS n_bins,
  round(min(js.js), 6) AS js, min(trs.t) AS monotonic_trend
FROM sk s JOIN js ON s.factor = js.factor JOIN trs ON s.factor = trs.factor WHERE s.kind = 'regular'
GROUP BY s.factor"""


# ---------------------------------------------------------------------------
# Rank correlations
# ---------------------------------------------------------------------------
_RANK_X = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def spearman_sql(src: str, xs: list[str], y: str) -> str:
    parts = []
    for f in xs:
        parts.append(f"""SELECT {q(f)} AS factor, round(corr(xr.r, yr.r), 8) AS spearman FROM
  (SELECT CAST({f} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {src} WHERE {f} IS NOT NULL AND {y} IS NOT NULL) l
  JOIN (SELECT v, sum(c) OVER (ORDER BY v) - c + (c + 1) / 2.0 AS r FROM
        (SELECT CAST({f} AS DOUBLE) AS v, count(*) AS c FROM {src} WHERE {f} IS NOT NULL AND {y} IS NOT NULL
         GROUP BY 1)) xr ON l.x = xr.v
  JOIN (SELECT v, sum(c) OVER (ORDER BY v) - c + (c + 1) / 2.0 AS r FROM
        (SELECT CAST({y} AS DOUBLE) AS v, count(*) AS c FROM {src} WHERE {f} IS NOT NULL AND {y} IS NOT NULL
         GROUP BY 1)) yr ON l.y = yr.v""")
    return union(parts)


def kendall_pairs_sql(src: str, xs: list[str], y: str) -> str:
    """tau-b from a self-join of the weighted distinct (x, y) pairs (cheap when pairs are few)."""
    parts = []
    for f in xs:
        parts.append(f"""SELECT {q(f)} AS factor, round(CASE WHEN (n0 - n1) * (n0 - n2) > 0
    THEN s / sqrt((n0 - n1) * (n0 - n2)) END, 8) AS kendall_tau_b FROM
  (SELECT sum(a.w * b.w * sign(a.x - b.x) * sign(a.y - b.y)) / 2.0 AS s FROM p_{f} a, p_{f} b),
  (SELECT sum(w) * (sum(w) - 1) / 2.0 AS n0 FROM p_{f}),
  (SELECT sum(t * (t - 1) / 2.0) AS n1 FROM (SELECT sum(w) AS t FROM p_{f} GROUP BY x)),
  (SELECT sum(t * (t - 1) / 2.0) AS n2 FROM (SELECT sum(w) AS t FROM p_{f} GROUP BY y))""")
    ctes = [f"p_{f} AS (SELECT CAST({f} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y, CAST(count(*) AS DOUBLE) AS w "
            f"FROM {src} WHERE {f} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1, 2)" for f in xs]
    return with_ctes(*ctes) + union(parts)


SQL["spearman"] = spearman_sql("lineitem", _RANK_X, "l_extendedprice")
SQL["kendall_tau_b_supplier"] = kendall_pairs_sql("supplier", ["s_nationkey"], "s_acctbal")
SQL["kendall_tau_b_ties"] = kendall_pairs_sql("lineitem", ["l_linenumber", "l_quantity"], "l_tax")
SQL["kendall_tau_b_bucketed"] = SQL["kendall_tau_b_ties"]


# ---------------------------------------------------------------------------
# F: chart series, G: statistics and encodings
# ---------------------------------------------------------------------------
SQL["bin_series"] = f"""WITH b AS ({_unrounded_bin_sql()})
SELECT factor, CAST(row_number() OVER (PARTITION BY factor ORDER BY bin_id) - 1 AS INTEGER) AS x, count,
  round(event_rate, 6) AS metric, kind,
  CASE WHEN length(bin) > 10 THEN substr(bin, 1, 10) || '...' ELSE bin END AS label
FROM b WHERE kind IN ('regular', 'special', 'missing')"""

SQL["actual_scale_series"] = with_ctes(
    skeleton_sql(X.REG_SPLITS), assigned_sql(_LI, X.REG_SPLITS, f"CAST({_REG_Y} AS DOUBLE)"),
    """st AS (SELECT factor, bin_id, count(*) AS n, sum(y) AS sum_y FROM d WHERE y IS NOT NULL GROUP BY 1, 2)""",
    """mm AS (SELECT factor, min(x) AS lo_x, max(x) AS hi_x FROM d WHERE y IS NOT NULL GROUP BY 1)""",
    """t AS (SELECT sk.*, coalesce(n, 0) AS n, sum_y FROM sk LEFT JOIN st ON sk.factor = st.factor
  AND sk.bin_id = st.bin_id)""") + \
    """SELECT t.factor, bin_id, round(coalesce(lo, lo_x), 4) AS "left", round(coalesce(hi, hi_x), 4) AS "right",
  round(coalesce(hi, hi_x) - coalesce(lo, lo_x), 4) AS width, round((coalesce(lo, lo_x) + coalesce(hi, hi_x)) / 2, 4) AS mid,
  CAST(n AS BIGINT) AS count, round(sum_y / nullif(n, 0), 4) AS metric
FROM t JOIN mm ON t.factor = mm.factor WHERE kind = 'regular'"""

SQL["multiclass_series"] = with_ctes(
    skeleton_sql(X.BIN_SPLITS), assigned_sql(_LI, X.BIN_SPLITS, "l_returnflag"),
    "st AS (SELECT factor, bin_id, y AS class, count(*) AS n FROM d WHERE y IS NOT NULL GROUP BY 1, 2, 3)",
    "cl AS (SELECT DISTINCT factor, class FROM st)",
    """j AS (SELECT sk.*, cl.class, coalesce(st.n, 0) AS n FROM sk JOIN cl ON sk.factor = cl.factor
  LEFT JOIN st ON sk.factor = st.factor AND sk.bin_id = st.bin_id AND cl.class = st.class
  WHERE sk.kind = 'regular')""") + \
    """SELECT factor, CAST(dense_rank() OVER (PARTITION BY factor ORDER BY bin_id) - 1 AS INTEGER) AS x, bin_id, class,
  CAST(n AS BIGINT) AS count,
  CAST(coalesce(sum(n) OVER (PARTITION BY factor, bin_id ORDER BY class ROWS BETWEEN UNBOUNDED PRECEDING
       AND 1 PRECEDING), 0) AS BIGINT) AS base,
  round(n / nullif(sum(n) OVER (PARTITION BY factor, bin_id), 0), 6) AS event_rate, kind
FROM j"""

SQL["factor_stats"] = with_ctes(X.NULLS_ORDERS_SQL) + union([
    f"""SELECT {q(c)} AS factor, {i} AS position, round(round((count(*) - count({c})) / count(*), 2), 4) AS missing,
  {f'round(stddev_samp(CAST({c} AS DOUBLE)), 4)' if num else '0.0'} AS std,
  {f'round(min(CAST({c} AS DOUBLE)), 4)' if num else 'CAST(NULL AS DOUBLE)'} AS min_value,
  {f'round(max(CAST({c} AS DOUBLE)), 4)' if num else 'CAST(NULL AS DOUBLE)'} AS max_value,
  {'CAST(NULL AS VARCHAR)' if num else f'min({c})'} AS min_text, {'CAST(NULL AS VARCHAR)' if num else f'max({c})'} AS max_text
  FROM nulls_orders"""
    for i, (c, num) in enumerate([("o_totalprice", True), ("o_custkey", True), ("o_orderpriority", False),
                                  ("o_orderstatus", False)])])

SQL["label_encode"] = with_ctes(X.NULLS_ORDERS_SQL) + union([
    f"""SELECT {q(c)} AS column_name, v AS value, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM nulls_orders WHERE {c} IS NOT NULL)"""
    for c in ["o_orderpriority", "o_orderstatus", "o_custkey"]])

SQL["tfidf"] = f"""WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), {q(WORD_RE)})) AS token
  FROM documents WHERE text IS NOT NULL),
tf AS (SELECT doc_id, token, count(*) AS tf FROM tok GROUP BY 1, 2),
dfq AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
n AS (SELECT count(*) AS n_docs FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, tf.token, tf * (ln((1 + n_docs) / (1 + df)) + 1) AS w FROM tf JOIN dfq ON tf.token = dfq.token, n),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS nrm FROM w GROUP BY 1)
SELECT w.doc_id, token, round(w / nrm, 8) AS tfidf FROM w JOIN nrm ON w.doc_id = nrm.doc_id"""

SQL["join_tokens"] = f"""SELECT conv_id, turn, array_to_string(regexp_extract_all(text, {q(TOKEN_RE)}), ' ') AS text
FROM conversations"""


# ---------------------------------------------------------------------------
# B, H, I, A
# ---------------------------------------------------------------------------
SQL["select_factors"] = "SELECT l_quantity, l_tax, l_extendedprice FROM lineitem"
SQL["drop_null_pair"] = with_ctes(X.NULLS_ORDERS_SQL) + \
    "SELECT o_totalprice, o_custkey FROM nulls_orders WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL"
SQL["drop_null_rows"] = with_ctes(X.NULLS_ORDERS_SQL) + \
    "SELECT o_totalprice, o_orderpriority, o_custkey FROM nulls_orders " \
    "WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL AND o_custkey IS NOT NULL"
SQL["fill_null_by_types"] = with_ctes(X.NULLS_ORDERS_SQL) + \
    "SELECT coalesce(o_totalprice, 0.0) AS o_totalprice, coalesce(o_orderpriority, '0') AS o_orderpriority, " \
    "coalesce(o_orderdate, TIMESTAMP '1970-01-01 00:00:00') AS o_orderdate, o_custkey FROM nulls_orders " \
    "WHERE o_custkey IS NOT NULL"
SQL["normalise_non_finite"] = with_ctes(X.NULLS_ORDERS_SQL) + \
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 13 = 0 THEN NULL " \
    "ELSE o_totalprice END AS ratio FROM nulls_orders"
SQL["cast_float"] = "SELECT CAST(l_orderkey AS DOUBLE) AS l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber, " \
    "l_returnflag FROM lineitem"
SQL["round_report"] = "SELECT l_orderkey, l_linenumber, round(l_extendedprice / 7, 3) AS price7, " \
    "round(l_discount / 3, 2) AS missing FROM lineitem"


def _band_sql(c: str, expr: str, dark: bool) -> str:
    pal = ("40E0D0", "6495ED", "FF7F50", "FC3468") if dark else ("00ffd4", "98f5ff", "fed8b1", "ff7f7d")
    band = (f"CASE WHEN {expr} IS NULL THEN NULL WHEN {expr} <= q1_{c} THEN 1 WHEN {expr} <= q2_{c} THEN 2 "
            f"WHEN {expr} <= q3_{c} THEN 3 ELSE 4 END")
    return (f"CAST({band} AS INTEGER) AS {c}_band, "
            f"CASE {band} WHEN 1 THEN '{pal[0]}' WHEN 2 THEN '{pal[1]}' WHEN 3 THEN '{pal[2]}' "
            f"WHEN 4 THEN '{pal[3]}' END AS {c}_colour")


SQL["quartile_bands"] = with_ctes(X.NULLS_ORDERS_SQL) + f"""SELECT o_orderkey, o_totalprice, o_custkey AS score_value,
  {_band_sql('o_totalprice', 'o_totalprice', False)}, {_band_sql('score_value', 'CAST(o_custkey AS DOUBLE)', True)}
FROM nulls_orders,
  (SELECT quantile_cont(o_totalprice, 0.25) AS q1_o_totalprice, quantile_cont(o_totalprice, 0.5) AS q2_o_totalprice,
          quantile_cont(o_totalprice, 0.75) AS q3_o_totalprice,
          quantile_cont(CAST(o_custkey AS DOUBLE), 0.25) AS q1_score_value,
          quantile_cont(CAST(o_custkey AS DOUBLE), 0.5) AS q2_score_value,
          quantile_cont(CAST(o_custkey AS DOUBLE), 0.75) AS q3_score_value FROM nulls_orders)"""

SQL["split_by_datetime"] = "SELECT event_id, ts, CASE WHEN ts < TIMESTAMP '2024-06-01 00:00:00' THEN 'train' " \
    "ELSE 'test' END AS split FROM events"
SQL["replace_literals"] = "SELECT conv_id, turn, replace(replace(replace(text, 'the', 'THE'), 'a', 'A'), " \
    "'THE', 'the') AS text FROM conversations"
_RT = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
  strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate FROM lineitem"""
SQL["read_delimited"] = _RT
SQL["read_tsv"] = _RT
SQL["read_parquet_table"] = _RT
SQL["read_json_table"] = _RT
SQL["read_xml_table"] = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders"""
SQL["read_json_lines"] = _RT
SQL["read_table_encoded"] = "SELECT doc_id, translate(text, chr(10) || chr(13), '  ') AS text, lang, source FROM documents"
SQL["detect_encoding"] = "SELECT 'gb18030' AS written, 'GB18030' AS found UNION ALL SELECT 'utf8', 'utf8'"
SQL["replace_in_text_file"] = """SELECT replace(replace(replace(l, 'the', 'THE'), 'a', ''), 'THE', 't') AS value
FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)"""
_BIN4 = """CASE WHEN x < 10 THEN 0 WHEN x < 20 THEN 1 WHEN x < 40 THEN 2 ELSE 3 END"""
_LABELS4 = """(VALUES (0, '(-inf, 10.00)'), (1, '[10.00, 20.00)'), (2, '[20.00, 40.00)'), (3, '[40.00, inf)'),
  (4, 'Special'), (5, 'Missing')) AS k(b, bin)"""
SQL["binning_table_large_offset"] = f"""WITH d AS (SELECT CAST(l_quantity AS DOUBLE) AS x,
  CAST(1.7e9 AS DOUBLE) + CAST(l_discount AS DOUBLE) AS y FROM lineitem),
g AS (SELECT {_BIN4} AS b, count(*) AS n, stddev_pop(y) AS sd FROM d GROUP BY 1)
SELECT 'l_quantity' AS factor, bin, coalesce(n, 0) AS count, round(sd, 4) AS std FROM {_LABELS4} LEFT JOIN g USING (b)
UNION ALL SELECT 'l_quantity', 'Totals', count(*), round(stddev_pop(y), 4) FROM d"""
_NAN = """d AS (SELECT CAST(l_quantity AS DOUBLE) AS x, l_linenumber % 2 AS y FROM lineitem WHERE l_orderkey % 7 <> 0)"""
SQL["choose_binning_nan"] = f"WITH {_NAN} SELECT 'y' AS target, count(DISTINCT y) AS n_classes, 'binary' AS kind FROM d"
SQL["binning_table_binary_nan"] = f"""WITH {_NAN}, g AS (SELECT {_BIN4} AS b, count(*) AS n, sum(y) AS e FROM d GROUP BY 1)
SELECT 'l.quantity' AS factor, bin, coalesce(n, 0) AS count, CAST(coalesce(e, 0) AS BIGINT) AS event
FROM {_LABELS4} LEFT JOIN g USING (b)
UNION ALL SELECT 'l.quantity', 'Totals', count(*), CAST(sum(y) AS BIGINT) FROM d"""
SQL["candidate_bins_distinct"] = " UNION ALL ".join(
    f"(SELECT DISTINCT '{f}' AS factor, CAST({f} AS DOUBLE) AS cut FROM lineitem WHERE {f} > (SELECT min({f}) FROM lineitem))"
    for f in ("l_quantity", "l_discount", "l_linenumber"))

SQL["column_flags_documents"] = f"""
SELECT column_name, position,
  (kind IN ('int','float','bool','temporal') OR (kind = 'string' AND n_bad_numeric = 0)) AS is_numeric,
  coalesce(n_distinct >= 1 AND (CASE WHEN kind IN ('int','float','bool','temporal')
                    OR (kind = 'string' AND n_bad_numeric = 0)
               THEN n_distinct <= 8 AND kind = 'int' AND n_null = 0 ELSE n_distinct <= 20 END)
   AND n_distinct / nullif(n_rows - n_null, 0) <= 0.2, false) AS is_categorical,
  (kind = 'temporal' OR (kind = 'string' AND dt_ok)) AS is_datetime,
  coalesce(kind = 'string' AND max_tokens > 5 AND max_token_freq > 3, false) AS is_text
FROM ({column_stats_sql('documents', SCHEMAS['documents'])})"""

SQL["choose_binning"] = """SELECT 'l_returnflag' AS target, count(DISTINCT l_returnflag) AS n_classes,
  CASE WHEN count(DISTINCT l_returnflag) > 2 THEN 'multiclass' ELSE 'binary' END AS kind FROM lineitem
UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus),
  CASE WHEN count(DISTINCT l_linestatus) > 2 THEN 'multiclass' ELSE 'binary' END FROM lineitem
UNION ALL SELECT 'l_extendedprice', count(DISTINCT l_extendedprice), 'continuous' FROM lineitem"""

SQL["to_long"] = """SELECT 'l_quantity' AS factor, 0 AS position, CAST(l_quantity AS DOUBLE) AS x,
  CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem
UNION ALL SELECT 'l_discount', 1, CAST(l_discount AS DOUBLE), CAST(l_extendedprice AS DOUBLE) FROM lineitem"""

SQL["binning_factors"] = f"""SELECT o.factor, o.position FROM
  (SELECT * FROM (VALUES ('l_quantity', 0), ('l_discount', 1), ('l_tax', 2), ('l_linenumber', 3),
                         ('l_returnflag', 4)) v(factor, position)) o
JOIN ({types_sql('lineitem')}) t ON t.column_name = o.factor AND t.data_type = 'Numeric'"""

SQL["chart_series_binary"] = SQL["bin_series"]

SQL["profile_monotonic"] = with_ctes(X.NULLS_ORDERS_SQL) + union([
    f"""SELECT {q(c)} AS column_name, {i} AS position, coalesce(bool_and(dd >= 0), true) AS monotonic_increasing,
  coalesce(bool_and(dd <= 0), true) AS monotonic_decreasing
FROM (SELECT v - lag(v) OVER (ORDER BY o) AS dd FROM
      (SELECT o_orderkey AS o, CAST({e} AS DOUBLE) AS v FROM nulls_orders WHERE {e} IS NOT NULL))"""
    for i, (c, e) in enumerate([("o_orderkey", "o_orderkey"), ("o_totalprice", "o_totalprice"),
                                ("o_custkey", "o_custkey"), ("neg_key", "-o_orderkey")])])
SQL["profile_monotonic_bucketed"] = SQL["profile_monotonic"]

SQL["rank_correlations"] = f"""WITH k AS ({kendall_pairs_sql("lineitem", ["l_linenumber", "l_quantity"], "l_tax")}),
s AS ({spearman_sql("lineitem", ["l_linenumber", "l_quantity"], "l_tax")})
SELECT k.factor, k.kendall_tau_b, s.spearman FROM k JOIN s ON k.factor = s.factor"""


def semantic_types_sql(table: str) -> str:
    """C8 over ``column_stats_sql`` rows (same thresholds as operators.types.semantic_types)."""
    return f"""SELECT column_name, position,
  CASE WHEN n_distinct < 1 THEN 'Unsupported'
       WHEN kind = 'bool' THEN 'Boolean'
       WHEN kind = 'string' AND n_boolean_like = n_rows - n_null AND n_distinct <= 2 THEN 'Boolean'
       WHEN kind = 'temporal' THEN 'DateTime'
       WHEN kind IN ('int', 'float') THEN CASE WHEN n_distinct <= 5 THEN 'Categorical' ELSE 'Numeric' END
       WHEN kind = 'string' AND n_bad_numeric = 0 THEN 'Numeric'
       WHEN kind = 'string' AND dt_ok THEN 'DateTime'
       WHEN n_distinct <= 50 AND n_distinct / nullif(n_rows, 0) < 0.5 THEN 'Categorical'
       ELSE 'Text' END AS data_type
FROM ({column_stats_sql(table, SCHEMAS[table])})"""


SQL["semantic_types_lineitem"] = semantic_types_sql("lineitem")
SQL["profile_type_counts"] = f"""SELECT data_type, count(*) AS n_columns FROM ({semantic_types_sql('lineitem')})
GROUP BY data_type"""
SQL["semantic_types_documents"] = semantic_types_sql("documents")


def _alerts_sql(table: str = "nulls_orders", cte: str = X.NULLS_ORDERS_SQL) -> str:
    cols = SCHEMAS[table]
    num = [(i, c) for i, (c, k) in enumerate(cols) if k in ("int", "float")]
    cat = [(i, c) for i, (c, k) in enumerate(cols) if k not in ("int", "float")]
    nm = union([f"""SELECT {q(c)} AS column_name,
  count(*) FILTER (WHERE CAST({c} AS DOUBLE) = 0) / nullif(count({c}), 0) AS p_zeros,
  count(*) FILTER (WHERE isinf(CAST({c} AS DOUBLE))) AS n_infinite,
  skewness(CAST({c} AS DOUBLE)) AS skewness FROM {table}""" for _, c in num])
    ct = union([f"""SELECT {q(c)} AS column_name,
  CASE WHEN count(*) > 1 THEN 1 - sum(-(cnt / tot) * log2(cnt / tot)) / log2(count(*)) ELSE 0.0 END AS imbalance
FROM (SELECT cnt, sum(cnt) OVER () AS tot FROM
      (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS cnt FROM {table} WHERE {c} IS NOT NULL GROUP BY 1))"""
                for _, c in cat])
    return with_ctes(cte,
                     f"st AS ({semantic_types_sql(table)})",
                     f"cm AS ({profile_common_sql(table, '', cols)})",
                     f"nm AS ({nm})", f"ct AS ({ct})") + f"""SELECT column_name, position, alert FROM (
  SELECT cm.column_name, cm.position, unnest([
    CASE WHEN cm.n_distinct = 1 THEN 'CONSTANT' END,
    CASE WHEN cm.is_unique AND cm.n_distinct > 1 THEN 'UNIQUE' END,
    CASE WHEN cm.n_missing > 0 THEN 'MISSING' END,
    CASE WHEN nm.p_zeros > {0.05} THEN 'ZEROS' END,
    CASE WHEN nm.n_infinite > 0 THEN 'INFINITE' END,
    CASE WHEN abs(nm.skewness) > 20 THEN 'SKEWED' END,
    CASE WHEN st.data_type = 'Categorical' AND cm.n_distinct > 50 THEN 'HIGH_CARDINALITY' END,
    CASE WHEN st.data_type = 'Categorical' AND ct.imbalance > 0.5 THEN 'IMBALANCE' END,
    CASE WHEN st.data_type = 'Unsupported' THEN 'UNSUPPORTED' END]) AS alert
  FROM cm JOIN st ON cm.column_name = st.column_name
  LEFT JOIN nm ON cm.column_name = nm.column_name LEFT JOIN ct ON cm.column_name = ct.column_name)
WHERE alert IS NOT NULL"""


SQL["profile_alerts"] = _alerts_sql()
SQL["profile_alerts_lineitem"] = _alerts_sql("lineitem", "")


# ---------------------------------------------------------------------------
# G8, G12, G13
# ---------------------------------------------------------------------------
SQL["assemble_features"] = f"""SELECT doc_id, 'n_chars' AS factor, CAST(NULL AS VARCHAR) AS token, CAST(n_chars AS DOUBLE) AS value FROM documents
UNION ALL
SELECT doc_id, 'lang', NULL, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS DOUBLE) FROM documents
UNION ALL
SELECT doc_id, 'text', token, tfidf FROM ({SQL["tfidf"]})"""

SQL["ordered_target_statistics"] = with_ctes(X.BIN_DOCUMENTS_SQL) + """
, rows AS (SELECT doc_id, c.column_name, c.value, quality AS y, o, md5(CAST(doc_id AS VARCHAR) || ':' || o) AS h
  FROM (SELECT * FROM bin_documents WHERE quality IS NOT NULL) d,
       (SELECT unnest([0, 1, 2, 3]) AS o),
       LATERAL (SELECT 'lang' AS column_name, d.lang AS value UNION ALL SELECT 'source', d.source) c),
before AS (SELECT doc_id, column_name, o,
    coalesce(sum(y) OVER w, 0) AS s, count(*) OVER w AS n
  FROM rows WINDOW w AS (PARTITION BY column_name, value, o ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, column_name, round(avg((s + (SELECT avg(quality) FROM bin_documents)) / (n + 1)), 8) AS code
FROM before GROUP BY doc_id, column_name"""

SQL["importance_planted"] = """WITH v AS (
  SELECT 'l_quantity' AS factor, var_pop(l_quantity / 50) AS v FROM lineitem
  UNION ALL SELECT 'l_discount', var_pop(5 * l_discount) FROM lineitem
  UNION ALL SELECT 'l_tax', 0 UNION ALL SELECT 'l_suppkey', 0)
SELECT factor, CASE WHEN v > 0 THEN CAST(row_number() OVER (ORDER BY v DESC) AS INTEGER) END AS place, v = 0 AS below_tenth FROM v"""

SQL["rank_factors"] = f"""SELECT name, round(iv, 3) AS feature_importance, round(js, 3) AS js, round(gini, 3) AS gini,
  CAST(row_number() OVER (ORDER BY round(iv, 3) DESC, round(js, 3) DESC, name) AS INTEGER) AS place
FROM (SELECT factor AS name, iv, js, gini FROM ({SQL["iv_js_gini"]}))"""


# ---------------------------------------------------------------------------
# C5 on date strings; E4, E6, E7, E15 over all partitions
# ---------------------------------------------------------------------------
SCHEMAS["date_strings"] = [(c, "string") for c in X.DATE_STRINGS]
SQL["get_data_types_date_strings"] = types_sql("date_strings", X.DATE_STRINGS_SQL)

SQL["candidate_cuts"] = union([f"""SELECT DISTINCT '{c}' AS factor, v.x AS cut FROM
    (SELECT x, sum(n) OVER (ORDER BY x) AS upto, n, sum(n) OVER () AS total, min(x) OVER () AS least, count(*) OVER () AS d
     FROM (SELECT CAST({c} AS DOUBLE) AS x, count(*) AS n FROM lineitem GROUP BY 1)) v,
    (SELECT unnest(range(1, 256)) AS i) p
  WHERE v.x > v.least AND (d <= 256 OR v.upto >= greatest(1, ceil(i * total / 256.0))
                           AND v.upto - v.n < greatest(1, ceil(i * total / 256.0)))"""
    for c in ("l_extendedprice", "l_orderkey", "l_partkey")])

SQL["candidate_bins"] = f"""WITH few AS ({SQL["candidate_bins_distinct"]}),
cuts AS (SELECT * FROM few WHERE factor <> 'l_linenumber' UNION ALL
         SELECT * FROM ({SQL["candidate_cuts"]}) WHERE factor = 'l_extendedprice'),
listed AS (SELECT factor, list(cut ORDER BY cut) AS c FROM cuts GROUP BY factor),
rows AS ({union([f"SELECT '{c}' AS factor, CAST({c} AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem" for c in X.BIN_X])}),
v AS (SELECT factor, x, count(*) AS k FROM rows GROUP BY 1, 2),
f AS (SELECT factor, x, CAST(len(list_filter(c, lambda e: e <= x)) AS INTEGER) AS fine_id FROM v JOIN listed USING (factor))
SELECT factor, fine_id, count(*) AS n, round(sum(y), 4) AS sum_y, round(var_pop(y) * count(*), -3) AS m2_y, round(min(y), 4) AS min_y,
  round(max(y), 4) AS max_y, count(*) FILTER (WHERE y = 0) AS zeros, round(min(x), 4) AS min_x, round(max(x), 4) AS max_x
FROM rows JOIN f USING (factor, x) GROUP BY 1, 2"""


def all_partitions_sql(objective: str, metric: str, event: str) -> str:
    """The best of the 64 partitions of l_linenumber's 7 values by the rule for ``auto``.

    Rising or falling partitions compete; those with one turn win if their
    objective is at least 1.1 times as great.
    """
    return f"""WITH v AS (SELECT l_linenumber AS x, count(*) AS n, sum({event}) AS s FROM lineitem GROUP BY 1),
r AS (SELECT x, n, s, row_number() OVER (ORDER BY x) - 1 AS i FROM v),
g AS (SELECT mask, bit_count(mask & ((1 << CAST(i AS INTEGER)) - 1)) AS bin, x, n, s FROM r, (SELECT unnest(range(64)) AS mask)),
b AS (SELECT mask, bin, min(x) AS lo, sum(n) AS n, CAST(sum(s) AS DOUBLE) AS s FROM g GROUP BY 1, 2),
t AS (SELECT sum(n) AS nn, CAST(sum(s) AS DOUBLE) AS ss FROM v),
c AS (SELECT mask, bin, lo, {objective} AS o, {metric} - lag({metric}) OVER (PARTITION BY mask ORDER BY bin) AS d FROM b, t),
p AS (SELECT mask, sum(o) AS objective, count(*) AS n_bins,
    coalesce(max(bin) FILTER (WHERE d > 1e-12), -1) AS last_up, coalesce(min(bin) FILTER (WHERE d > 1e-12), 99) AS first_up,
    coalesce(max(bin) FILTER (WHERE d < -1e-12), -1) AS last_down, coalesce(min(bin) FILTER (WHERE d < -1e-12), 99) AS first_down,
    string_agg(printf('%.6f', CAST(lo AS DOUBLE)), '|' ORDER BY lo) FILTER (WHERE bin > 0) AS splits FROM c GROUP BY mask),
mono AS (SELECT * FROM p WHERE last_up = -1 OR last_down = -1 ORDER BY objective DESC LIMIT 1),
turn AS (SELECT * FROM p WHERE last_up < first_down OR last_down < first_up ORDER BY objective DESC LIMIT 1),
best AS (SELECT * FROM turn WHERE objective >= 1.1 * (SELECT objective FROM mono)
         UNION ALL SELECT * FROM mono WHERE NOT EXISTS (SELECT 1 FROM turn WHERE objective >= 1.1 * (SELECT objective FROM mono)))
SELECT 'l_linenumber' AS factor, coalesce(splits, '') AS splits, CAST(n_bins AS INTEGER) AS n_bins, round(objective, 6) AS objective FROM best"""


SQL["optimal_binning_all_partitions"] = all_partitions_sql("abs(s / n - ss / nn)", "s / n", "l_extendedprice")
SQL["optimal_binning_all_partitions_binary"] = all_partitions_sql(
    "CASE WHEN s > 0 AND s < n THEN ((n - s) / (nn - ss) - s / ss) * ln(((n - s) / (nn - ss)) / (s / ss)) ELSE 0 END",
    "s / n", "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END")

SQL["trend_shape"] = with_ctes(assigned_sql(_LI, X.REG_SPLITS, f"CAST({_REG_Y} AS DOUBLE)")) + """
, b AS (SELECT factor, bin_id, avg(y) AS m, (min(x) + max(x)) / 2 AS mid FROM d WHERE y IS NOT NULL GROUP BY 1, 2),
s AS (SELECT *, (m - lag(m) OVER w) / (mid - lag(mid) OVER w) AS slope FROM b WINDOW w AS (PARTITION BY factor ORDER BY bin_id)),
e AS (SELECT *, slope - lag(slope) OVER (PARTITION BY factor ORDER BY bin_id) AS bend FROM s)
SELECT factor, CASE WHEN count(bend) = 0 THEN 'undefined'
  WHEN count(*) FILTER (WHERE bend > 0) = 0 AND count(*) FILTER (WHERE bend < 0) = 0 THEN 'linear'
  WHEN count(*) FILTER (WHERE bend < 0) = 0 THEN 'convex' WHEN count(*) FILTER (WHERE bend > 0) = 0 THEN 'concave'
  ELSE 'mixed' END AS trend_shape FROM e GROUP BY factor"""

SQL["split_by_samples"] = """SELECT o_orderkey, o_custkey,
  CASE WHEN CAST('0x' || substr(md5('42|' || length(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey), 1, 8) AS BIGINT) % 1000
       < 800 THEN 'train' ELSE 'test' END AS split FROM orders"""

SQL["bin_series_others"] = with_ctes(X.BIN_DOCUMENTS_SQL) + union([
    f"""SELECT {q(f)} AS factor, CAST(sum(n) AS BIGINT) AS count, round(sum(e) / sum(n), 6) AS metric, 'others' AS kind,
  true AS after_regular
FROM (SELECT {f}, count(*) AS n, sum(CASE WHEN quality = (SELECT max(quality) FROM bin_documents) THEN 1 ELSE 0 END) AS e,
      sum(count(*)) OVER () AS nn
      FROM bin_documents WHERE quality IS NOT NULL GROUP BY {f}) WHERE {f} IS NOT NULL AND n < 0.2 * nn HAVING count(*) > 0"""
    for f in ("source", "lang")])
