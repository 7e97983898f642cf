"""The isolation forest as SQL: draws from MD5, trees grown level by level by recursion, rows walked down by joins."""

from __future__ import annotations

from quietwire import config as C

PRIME = (1 << 52) - 47
N = len(C.FEATURE_NAMES)
LIST = "[" + ", ".join(C.FEATURE_NAMES) + "]"


def number(text: str, at: int) -> str:
    """Thirteen hex digits as a number."""
    return f"CAST('0x' || substr({text}, {at}, 13) AS BIGINT)"


def each(expression: str) -> str:
    """A list of one expression per feature, ``#`` being its number."""
    return "[" + ", ".join(expression.replace("#", str(i + 1)) for i in range(N)) + "]"


def scaled(values: str) -> str:
    return f"list_transform(range(1, {N + 1}), lambda i: floor(({values}[i] - sm[i]) / ss[i] * 1e9 + 0.5) / 1e9)"


def path(n: str) -> str:
    return (
        f"(CASE WHEN {n} <= 1 THEN 0.0::DOUBLE WHEN {n} = 2 THEN 1.0::DOUBLE"
        f" ELSE 2.0::DOUBLE * (ln({n} - 1.0::DOUBLE) + 0.5772156649::DOUBLE) - 2.0::DOUBLE * ({n} - 1.0::DOUBLE) / {n} END)"
    )


SPLIT = f"""
  SELECT *, list_filter(range(1, {N + 1}), lambda i: hi[i] > lo[i]) AS varying, md5('{{seed}}:' || tree || ':' || node) AS h
  FROM {{rows}}"""
CUT = f"""
  SELECT *, n > 1 AND depth < deep AND len(varying) > 0 AS inside,
    varying[1 + CAST(floor({number("h", 1)} / 4503599627370496.0::DOUBLE * len(varying)) AS BIGINT)] AS f,
    {number("h", 14)} / 4503599627370496.0::DOUBLE AS u FROM ({{split}})"""
THRESHOLD = "CASE WHEN lo[f] + u * (hi[f] - lo[f]) >= hi[f] THEN lo[f] ELSE lo[f] + u * (hi[f] - lo[f]) END"


def grown(rows: str, seed: int) -> str:
    """Rows with the split of their node: ``inside``, feature ``f``, threshold ``thr``."""
    split = SPLIT.format(rows=rows, seed=seed)
    return f"SELECT *, CASE WHEN inside THEN {THRESHOLD} ELSE 0.0::DOUBLE END AS thr FROM ({CUT.format(split=split)})"


def forest_ctes(source: str, key: str, n_trees: int = 100, most: int = 256, seed: int = 42) -> str:
    """``fs`` (tree, key): the samples; ``ft``: the node table; ``fz``: mean and scale; ``fdim``: size and depth.

    ``source`` holds the key and the features by name.
    """
    noise = "(n * 2.220446049250313e-16::DOUBLE)"
    varies = f"d[i] * d[i] > {noise} * d[i] * d[i] + ({noise} * m[i]) * ({noise} * m[i])"
    low = each("min(x[#]) OVER w")
    high = each("max(x[#]) OVER w")
    return f"""
fz AS (SELECT n, m AS sm, list_transform(range(1, {N + 1}), lambda i: CASE WHEN {varies} THEN d[i] ELSE 1.0::DOUBLE END) AS ss
  FROM (SELECT count(*) AS n, [{", ".join(f"avg({c})" for c in C.FEATURE_NAMES)}] AS m,
    [{", ".join(f"stddev_pop({c})" for c in C.FEATURE_NAMES)}] AS d FROM {source})),
fdim AS (SELECT least({most}, n) AS size, CAST(ceil(log2(greatest(least({most}, n), 2))) AS BIGINT) AS deep FROM fz),
fx AS (SELECT {key} AS k, {scaled(LIST)} AS x, md5('{seed}:' || CAST({key} AS VARCHAR)) AS h FROM {source}, fz),
fs AS (SELECT CAST(tree AS INT) AS tree, k, x FROM (
    SELECT k, x, tree, ({number("h", 1)} + {number("h", 14)} * (tree + 1)) % {PRIME} AS draw
    FROM fx, (SELECT unnest(range({n_trees})) AS tree)), fdim
  QUALIFY row_number() OVER (PARTITION BY tree ORDER BY draw, k) <= size),
fg AS (
  SELECT tree, CAST(0 AS BIGINT) AS node, CAST(0 AS BIGINT) AS depth, k, x, deep, {low} AS lo, {high} AS hi, count(*) OVER w AS n
  FROM fs, fdim WINDOW w AS (PARTITION BY tree)
  UNION ALL
  SELECT tree, node, depth, k, x, deep, {low}, {high}, count(*) OVER w
  FROM (SELECT tree, 2 * node + CASE WHEN x[f] <= thr THEN 1 ELSE 2 END AS node, depth + 1 AS depth, k, x, deep
    FROM ({grown("fg", seed)}) WHERE inside)
  WINDOW w AS (PARTITION BY tree, node)),
ft AS (SELECT DISTINCT CAST(tree AS INT) AS tree, CAST(node AS INT) AS node,
    CAST(CASE WHEN inside THEN 2 * node + 1 ELSE -1 END AS INT) AS "left",
    CAST(CASE WHEN inside THEN 2 * node + 2 ELSE -1 END AS INT) AS "right",
    CAST(CASE WHEN inside THEN f - 1 ELSE -1 END AS INT) AS feature, thr AS threshold, CAST(n AS INT) AS n,
    CAST(depth AS INT) AS depth FROM ({grown("fg", seed)}))"""


def score_ctes(source: str, key: str, prefix: str = "fv") -> str:
    """``{prefix}(k, score)`` for the rows of ``source``."""
    p = prefix
    return f"""
{p}x AS (SELECT {key} AS k, {scaled(LIST)} AS x FROM {source}, fz),
{p}w AS (
  SELECT k, tree, CAST(0 AS INT) AS node FROM {p}x, (SELECT DISTINCT tree FROM ft)
  UNION ALL
  SELECT w.k, w.tree, CASE WHEN v.x[t.feature + 1] <= t.threshold THEN t."left" ELSE t."right" END
  FROM {p}w w JOIN ft t ON t.tree = w.tree AND t.node = w.node AND t."left" >= 0 JOIN {p}x v ON v.k = w.k),
{p} AS (SELECT k, floor(-pow(2.0::DOUBLE, -(avg(t.depth + {path("t.n")}) / any_value({path("size")}))) * 1e12 + 0.5) / 1e12 AS score
  FROM {p}w w JOIN ft t ON t.tree = w.tree AND t.node = w.node AND t."left" < 0, fdim GROUP BY k)"""


def offset_cte(prefix: str = "fv", contamination: float = 0.01) -> str:
    """``fo(cut)``: the interpolated quantile of the scores."""
    return f"""
fo AS (SELECT s[k + 1] + (pos - k) * (s[least(k + 2, len(s))] - s[k + 1]) AS cut FROM (
  SELECT s, (len(s) - 1) * {contamination}::DOUBLE AS pos, CAST(floor((len(s) - 1) * {contamination}::DOUBLE) AS BIGINT) AS k
  FROM (SELECT list(score ORDER BY score) AS s FROM {prefix})))"""


def stats_select(prefix: str = "fv", features: bool = True) -> str:
    width = f"CAST({N} AS INT) AS n_features, " if features else ""
    return f"""SELECT count(*) AS n_samples, {width}count(*) FILTER (WHERE score < cut) AS n_anomalies,
  round(count(*) FILTER (WHERE score < cut) / CAST(count(*) AS DOUBLE), 6) AS anomaly_rate, round(avg(score), 6) AS score_mean,
  round(stddev_pop(score), 6) AS score_std, round(min(score), 6) AS score_min, round(max(score), 6) AS score_max
  FROM {prefix}, fo"""
