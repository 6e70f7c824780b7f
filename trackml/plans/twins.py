"""DuckDB SQL twins of the registered queries (run on the driver's tables).

Column names and types match the Spark results.  The common table
expressions rebuild the fixture inputs exactly as :mod:`trackml.sources.fixtures`
does.  ``t_labels`` etc. avoid the pre-registered ``labels`` view name.
"""

from __future__ import annotations

FIXTURE = """
t_features AS (
  SELECT l_orderkey AS track_id,
         CAST(count(*) AS DOUBLE) AS n_items,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS qty,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS cents,
         CAST(count(DISTINCT l_returnflag) AS DOUBLE) AS n_rf,
         CAST(count(DISTINCT l_linestatus) AS DOUBLE) AS n_ls
  FROM lineitem GROUP BY l_orderkey),
t_labels AS (SELECT o_orderkey AS track_id, o_orderpriority AS label FROM orders),
t_splits AS (
  SELECT o_orderkey AS track_id,
         CASE WHEN o_orderkey % 10 < 8 THEN 'TRAIN' ELSE 'TEST' END AS subset
  FROM orders),
t_year AS (SELECT o_orderkey AS track_id, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders),
joined AS (
  SELECT s.track_id, s.subset, l.label, f.n_items, f.qty, f.cents, f.n_rf, f.n_ls
  FROM t_splits s JOIN t_labels l ON s.track_id = l.track_id
  JOIN t_features f ON f.track_id = s.track_id),
gidx AS (
  SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS idx
  FROM joined GROUP BY label)
"""

# Most frequent TRAIN label; equal counts → lowest global label index.
MAJORITY = """
maj AS (
  SELECT j.label FROM joined j JOIN gidx g ON g.label = j.label
  WHERE j.subset = 'TRAIN' GROUP BY j.label, g.idx
  ORDER BY count(*) DESC, g.idx LIMIT 1),
n_train AS (SELECT count(*) AS n FROM joined WHERE subset = 'TRAIN'),
pred AS (
  SELECT j.track_id, j.label, (SELECT label FROM maj) AS predicted_label
  FROM joined j WHERE j.subset = 'TEST')
"""

CATEGORIES = """
cand AS (
  SELECT 0 AS slot, 'n_items' AS feature, n_items AS v FROM joined UNION ALL
  SELECT 1, 'qty', qty FROM joined UNION ALL
  SELECT 2, 'cents', cents FROM joined UNION ALL
  SELECT 3, 'n_rf', n_rf FROM joined UNION ALL
  SELECT 4, 'n_ls', n_ls FROM joined),
dv AS (SELECT DISTINCT slot, feature, v FROM cand),
small AS (SELECT slot FROM dv GROUP BY slot HAVING count(*) <= 4),
cats AS (
  SELECT slot, feature, v AS value,
         CAST(row_number() OVER (PARTITION BY slot ORDER BY v <> 0, v) - 1 AS INTEGER) AS idx
  FROM dv WHERE slot IN (SELECT slot FROM small))
"""

EMBEDDINGS = """
joined AS (
  SELECT vec_id AS track_id,
         CASE WHEN vec_id % 10 < 8 THEN 'TRAIN' ELSE 'TEST' END AS subset,
         CAST(label AS VARCHAR) AS label
  FROM embeddings),
gidx AS (
  SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS idx
  FROM joined GROUP BY label)
"""

ACCURACY_SELECT = """
SELECT CAST((SELECT n FROM n_train) AS BIGINT) AS n_train,
       CAST(count(*) AS BIGINT) AS n_test,
       CAST(sum(CASE WHEN label = predicted_label THEN 1 ELSE 0 END) AS BIGINT) AS n_correct,
       round(sum(CASE WHEN label = predicted_label THEN 1 ELSE 0 END) / count(*), 8) AS accuracy,
       round(1.0 - sum(CASE WHEN label = predicted_label THEN 1 ELSE 0 END) / count(*), 8)
         AS test_error
FROM pred
"""

# OLS year ~ qty on the year join; key-derived 70 / 30 split for the held-out check.
YEAR_JOIN = """
yj AS (SELECT y.track_id, y.year, f.n_items, f.qty, f.cents, f.n_rf, f.n_ls
       FROM t_year y JOIN t_features f ON f.track_id = y.track_id)
"""

# CV over TRAIN with folds = key mod 3: per fold, the model predicts the most
# frequent label of the other folds (ties → lowest global index).
CV_METRIC = """
tr AS (SELECT track_id, label, CAST(track_id % 3 AS INTEGER) AS fold
       FROM joined WHERE subset = 'TRAIN'),
folds AS (SELECT DISTINCT fold FROM tr),
fcount AS (SELECT f.fold, t.label, count(*) AS c FROM folds f JOIN tr t ON t.fold <> f.fold
           GROUP BY f.fold, t.label),
fmaj AS (SELECT fold, label FROM (
           SELECT fc.fold, fc.label,
                  row_number() OVER (PARTITION BY fc.fold ORDER BY fc.c DESC, g.idx) AS rn
           FROM fcount fc JOIN gidx g ON g.label = fc.label) r WHERE rn = 1),
facc AS (SELECT t.fold, avg(CASE WHEN t.label = m.label THEN 1.0 ELSE 0.0 END) AS acc
         FROM tr t JOIN fmaj m ON m.fold = t.fold GROUP BY t.fold),
metric AS (SELECT avg(acc) AS avg_metric, stddev_pop(acc) AS std_metric FROM facc),
grid AS (SELECT * FROM (VALUES
           (0, CAST(10 AS DOUBLE), CAST(0.3 AS DOUBLE), CAST(0.2 AS DOUBLE)),
           (1, CAST(10 AS DOUBLE), CAST(0.3 AS DOUBLE), CAST(0.8 AS DOUBLE)),
           (2, CAST(10 AS DOUBLE), CAST(0.1 AS DOUBLE), CAST(0.2 AS DOUBLE)),
           (3, CAST(10 AS DOUBLE), CAST(0.1 AS DOUBLE), CAST(0.8 AS DOUBLE)))
         AS g(grid_id, maxIter, regParam, elasticNetParam)),
results AS (
  SELECT CAST(g.grid_id AS INTEGER) AS grid_id, g.maxIter, g.regParam, g.elasticNetParam,
         round(m.avg_metric, 8) AS avg_metric, round(m.std_metric, 8) AS std_metric
  FROM grid g, metric m)
"""


# Quantity bands with the number of line statuses as the only feature; each
# category's majority among the other folds (fold -1: among all of TRAIN).
BANDED = """
b AS (SELECT s.track_id, s.subset, f.n_ls, CAST(s.track_id % 3 AS INTEGER) AS fold,
             CASE WHEN f.qty < 60 THEN 'light' WHEN f.qty < 120 THEN 'medium'
                  ELSE 'heavy' END AS label
      FROM t_splits s JOIN t_features f ON f.track_id = s.track_id),
bidx AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) AS idx
         FROM b GROUP BY label),
bfolds AS (SELECT unnest([-1, 0, 1, 2]) AS held),
bseen AS (SELECT k.held, t.n_ls, t.label FROM bfolds k JOIN b t
          ON t.subset = 'TRAIN' AND t.fold <> k.held),
bcat AS (SELECT held, n_ls, label AS predicted_label FROM (
           SELECT s.held, s.n_ls, s.label, row_number() OVER (
             PARTITION BY s.held, s.n_ls ORDER BY count(*) DESC, any_value(i.idx)) AS rn
           FROM bseen s JOIN bidx i ON i.label = s.label GROUP BY s.held, s.n_ls, s.label) r
         WHERE rn = 1),
ball AS (SELECT held, label AS predicted_label FROM (
           SELECT s.held, s.label, row_number() OVER (
             PARTITION BY s.held ORDER BY count(*) DESC, any_value(i.idx)) AS rn
           FROM bseen s JOIN bidx i ON i.label = s.label GROUP BY s.held, s.label) r
         WHERE rn = 1),
n_train AS (SELECT count(*) AS n FROM b WHERE subset = 'TRAIN'),
pred AS (SELECT b.track_id, b.label, c.predicted_label
         FROM b JOIN bcat c ON c.held = -1 AND c.n_ls = b.n_ls WHERE b.subset = 'TEST'),
bmetric AS (
  SELECT 'category' AS kind, avg(acc) AS m FROM (
    SELECT t.fold, avg(CASE WHEN t.label = c.predicted_label THEN 1.0 ELSE 0.0 END) AS acc
    FROM b t JOIN bcat c ON c.held = t.fold AND c.n_ls = t.n_ls
    WHERE t.subset = 'TRAIN' GROUP BY t.fold) x
  UNION ALL
  SELECT 'all' AS kind, avg(acc) AS m FROM (
    SELECT t.fold, avg(CASE WHEN t.label = c.predicted_label THEN 1.0 ELSE 0.0 END) AS acc
    FROM b t JOIN ball c ON c.held = t.fold
    WHERE t.subset = 'TRAIN' GROUP BY t.fold) x),
bresults AS (
  SELECT CAST(g.grid_id AS INTEGER) AS grid_id, CAST(100 AS DOUBLE) AS maxIter,
         g.regParam, g.elasticNetParam, round(m.m, 8) AS avg_metric
  FROM (VALUES (0, CAST(0.5 AS DOUBLE), CAST(0.0 AS DOUBLE), 'all'),
               (1, CAST(0.5 AS DOUBLE), CAST(1.0 AS DOUBLE), 'all'),
               (2, CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE), 'category'),
               (3, CAST(0.0 AS DOUBLE), CAST(1.0 AS DOUBLE), 'category'))
       AS g(grid_id, regParam, elasticNetParam, kind) JOIN bmetric m ON m.kind = g.kind)
"""


# Least squares by Gauss-Jordan elimination of the correlation matrix: entry
# c_i_j of step k; the last column is the label.
OLS_COLUMNS = ["n_items", "qty", "cents", "n_rf", "n_ls", "year"]


def _elimination(columns: list[str], table: str) -> str:
    d = len(columns) - 1
    cells = [(i, j) for i in range(d) for j in range(d + 1)]
    start = ", ".join(f"corr({columns[i]}, {columns[j]}) AS c_{i}_{j}" for i, j in cells)
    spread = ", ".join(f"stddev_samp({c}) AS s_{i}, avg({c}) AS a_{i}"
                       for i, c in enumerate(columns))
    steps = [f"e0 AS (SELECT {start}, {spread} FROM {table})"]
    rest = ", ".join(f"s_{i}, a_{i}" for i in range(d + 1))
    for p in range(d):
        new = ", ".join(f"c_{p}_{j} / c_{p}_{p} AS c_{i}_{j}" if i == p else
                        f"c_{i}_{j} - c_{i}_{p} * c_{p}_{j} / c_{p}_{p} AS c_{i}_{j}"
                        for i, j in cells)
        steps.append(f"e{p + 1} AS (SELECT {new}, {rest} FROM e{p})")
    return ",\n".join(steps)


def _ols_rows(columns: list[str]) -> str:
    d = len(columns) - 1
    rows = [f"SELECT '{c}' AS feature, round(c_{i}_{d} * s_{d}, 6) AS weight FROM e{d}"
            for i, c in enumerate(columns[:-1])]
    fitted = " + ".join(f"c_{i}_{d} * s_{d} / s_{i} * a_{i}" for i in range(d))
    rows.append(f"SELECT '(intercept)', round(a_{d} - ({fitted}), 6) FROM e{d}")
    return "\nUNION ALL ".join(rows)


def _names(columns: list[str]) -> str:
    return ", ".join(f"('{c}')" for c in [*columns, "(intercept)"])


# One depth-2 tree as a split search over histograms: class counts by node,
# feature and value give every candidate split's gain.  Features with at most
# four values are categorical, with all two-way groupings of their values.
TREE_FEATURES = {"priority": ["n_items", "qty", "cents", "n_rf", "n_ls"],
                 "band": ["n_items", "cents", "n_rf", "n_ls"]}
BAND = """CASE WHEN qty < 60 THEN 'light' WHEN qty < 120 THEN 'medium' ELSE 'heavy' END"""
IMPURITY = {"gini": "1 - sum(({c} / {n}) * ({c} / {n}))",
            "entropy": "-sum(CASE WHEN {c} > 0 THEN ({c} / {n}) * ln({c} / {n}) / ln(2) ELSE 0 END)"}


def _tree(target: str, impurity: str, depth: int = 2, learn: str = "subset = 'TRAIN'",
          judge: str = "subset = 'TEST'") -> str:
    """Predictions on the rows of ``judge`` by the tree learnt on the rows of ``learn``."""
    features = TREE_FEATURES[target]
    label = "label" if target == "priority" else BAND
    values = " UNION ALL ".join(
        f"SELECT track_id, subset, k, node, {i} AS f, {c} AS v FROM {{nodes}}"
        for i, c in enumerate(features))
    parts = [f"""
b0 AS (SELECT track_id, subset, {label} AS label, n_items, qty,
              floor(cents / 2000000) AS cents, n_rf, n_ls FROM joined),
kidx AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS k
         FROM b0 GROUP BY label),
n0 AS (SELECT b0.*, kidx.k, 1 AS node FROM b0 JOIN kidx ON kidx.label = b0.label),
v0 AS ({values.format(nodes='n0')}),
few AS (SELECT f FROM v0 GROUP BY f HAVING count(DISTINCT v) <= 4),
tv AS (SELECT DISTINCT f, v FROM v0 WHERE {learn}),
cat AS (SELECT f, list_sort(list(DISTINCT v)) AS vs FROM v0
        WHERE f IN (SELECT f FROM few) GROUP BY f),
split AS (
  SELECT f, v AS s, (v + lead(v) OVER (PARTITION BY f ORDER BY v)) / 2 AS cut,
         CAST(NULL AS DOUBLE[]) AS own
  FROM tv WHERE f NOT IN (SELECT f FROM few)
  UNION ALL
  SELECT f, s, NULL, list_filter(vs, lambda x, i: (CAST(s AS INTEGER) >> CAST(i - 1 AS INTEGER)) & 1 = 1)
  FROM (SELECT f, vs, unnest(range(1, CAST(2 ** (len(vs) - 1) AS BIGINT))) AS s FROM cat) c)"""]

    def of(c: str, n: str) -> str:
        return IMPURITY[impurity].format(c=c, n=n)

    for d in range(depth):
        parts.append(f"""
h{d} AS (SELECT node, f, v, k, count(*) AS c FROM ({values.format(nodes=f'n{d}')}) x
         WHERE {learn} GROUP BY node, f, v, k),
c{d} AS (SELECT h.node, h.f, s.s, any_value(s.cut) AS cut, any_value(s.own) AS own, h.k,
                CAST(sum(CASE WHEN h.v <= s.cut OR list_contains(s.own, h.v)
                              THEN c ELSE 0 END) AS DOUBLE) AS l,
                CAST(sum(c) AS DOUBLE) AS t
         FROM h{d} h JOIN split s ON s.f = h.f AND (s.cut IS NOT NULL OR s.own IS NOT NULL)
         GROUP BY h.node, h.f, s.s, h.k),
w{d} AS (SELECT *, t - l AS r, sum(l) OVER g AS nl, sum(t) OVER g AS nt,
                sum(t - l) OVER g AS nr
         FROM c{d} WINDOW g AS (PARTITION BY node, f, s)),
g{d} AS (SELECT node, f, s, any_value(cut) AS cut, any_value(own) AS own,
                ({of('t', 'nt')}) - any_value(nl / nt) * ({of('l', 'nl')})
                  - any_value(nr / nt) * ({of('r', 'nr')}) AS gain
         FROM w{d} WHERE nl > 0 AND nr > 0 GROUP BY node, f, s),
s{d} AS (SELECT * FROM (SELECT *, row_number() OVER (
           PARTITION BY node ORDER BY gain DESC, f, s) AS rn FROM g{d}) x
         WHERE rn = 1 AND gain > 0),
n{d + 1} AS (
  SELECT n.* REPLACE (CASE WHEN s.f IS NULL THEN n.node
    WHEN s.cut IS NOT NULL AND [{', '.join(f'n.{c}' for c in features)}][s.f + 1] <= s.cut
      OR list_contains(s.own, [{', '.join(f'n.{c}' for c in features)}][s.f + 1])
      THEN 2 * n.node ELSE 2 * n.node + 1 END AS node)
  FROM n{d} n LEFT JOIN s{d} s ON s.node = n.node)""")
    parts.append(f"""
leaf AS (SELECT node, label FROM (
  SELECT node, label, row_number() OVER (PARTITION BY node ORDER BY count(*) DESC, k) AS rn
  FROM n{depth} WHERE {learn} GROUP BY node, label, k) x WHERE rn = 1)""")
    return f"""SELECT * FROM ({_with(FIXTURE, *parts)}
SELECT '{target}' AS target, '{impurity}' AS impurity, n.track_id, n.label,
       leaf.label AS predicted_label
FROM n{depth} n JOIN leaf ON leaf.node = n.node WHERE {judge}) q"""


def _tree_cv() -> str:
    """Mean fold accuracy of depth and impurity; folds are the key's remainder by three."""
    points = []
    for i, (depth, impurity) in enumerate((d, m) for d in (1, 2) for m in IMPURITY):
        folds = " UNION ALL ".join(
            "SELECT avg(CASE WHEN label = predicted_label THEN 1.0 ELSE 0.0 END) AS acc FROM ("
            + _tree("priority", impurity, depth, f"subset = 'TRAIN' AND track_id % 3 <> {k}",
                    f"subset = 'TRAIN' AND track_id % 3 = {k}") + f") f{k}" for k in range(3))
        points.append(f"""SELECT CAST({i} AS INTEGER) AS grid_id, CAST(1 AS DOUBLE) AS "numTrees",
  CAST(512 AS DOUBLE) AS "maxBins", CAST({depth} AS DOUBLE) AS "maxDepth",
  '{impurity}' AS impurity, 'all' AS "featureSubsetStrategy",
  round(avg(acc), 8) AS avg_metric FROM ({folds}) p""")
    return "\nUNION ALL ".join(points)


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


SQL = {
    "track_join": _with(FIXTURE) + "SELECT * FROM joined",
    "year_join": _with(FIXTURE) + """
SELECT y.track_id, y.year, f.n_items, f.qty, f.cents, f.n_rf, f.n_ls
FROM t_year y JOIN t_features f ON f.track_id = y.track_id""",
    "subset_counts": _with(FIXTURE) + """
SELECT subset, count(*) AS n_rows FROM joined GROUP BY subset""",
    "subset_label_counts": _with(FIXTURE) + """
SELECT subset, label, count(*) AS n_rows FROM joined GROUP BY subset, label""",
    "train_rows": _with(FIXTURE) + "SELECT * FROM joined WHERE subset = 'TRAIN'",
    "test_rows": _with(FIXTURE) + "SELECT * FROM joined WHERE subset = 'TEST'",
    "text_inputs_join": _with(FIXTURE) + """
SELECT CAST(track_id AS VARCHAR) AS track_id, subset, label, n_items, qty, cents, n_rf, n_ls
FROM joined""",
    "quarantined_rows": """
SELECT input, reason, count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
FROM (SELECT i.input, o.o_orderkey, CASE
        WHEN o.o_orderkey % 50 = 1 THEN 'short' WHEN o.o_orderkey % 50 = 2 THEN 'long'
        WHEN o.o_orderkey % 50 = 3 AND i.typed THEN 'value' ELSE 'kept' END AS reason
      FROM orders o CROSS JOIN (VALUES ('features', true), ('labels', false),
                                       ('splits', false), ('years', true)) AS i(input, typed)) x
GROUP BY input, reason""",
    "assembled_features": _with(FIXTURE) + """
SELECT track_id, subset, label, n_items AS slot0, qty AS slot1, cents AS slot2,
       n_rf AS slot3, n_ls AS slot4
FROM joined""",
    "label_index": _with(FIXTURE) + "SELECT label, CAST(idx AS DOUBLE) AS idx FROM gidx",
    "feature_categories": _with(FIXTURE, CATEGORIES) + "SELECT slot, feature, value, idx FROM cats",
    "indexed_features": _with(FIXTURE, CATEGORIES) + """
SELECT j.track_id,
       coalesce(CAST(c0.idx AS DOUBLE), j.n_items) AS slot0,
       coalesce(CAST(c1.idx AS DOUBLE), j.qty) AS slot1,
       coalesce(CAST(c2.idx AS DOUBLE), j.cents) AS slot2,
       coalesce(CAST(c3.idx AS DOUBLE), j.n_rf) AS slot3,
       coalesce(CAST(c4.idx AS DOUBLE), j.n_ls) AS slot4
FROM joined j
LEFT JOIN cats c0 ON c0.slot = 0 AND c0.value = j.n_items
LEFT JOIN cats c1 ON c1.slot = 1 AND c1.value = j.qty
LEFT JOIN cats c2 ON c2.slot = 2 AND c2.value = j.cents
LEFT JOIN cats c3 ON c3.slot = 3 AND c3.value = j.n_rf
LEFT JOIN cats c4 ON c4.slot = 4 AND c4.value = j.n_ls""",
    "label_decode_roundtrip": _with(FIXTURE) + """
SELECT j.track_id, j.label, CAST(g.idx AS DOUBLE) AS label_idx, j.label AS decoded_label
FROM joined j JOIN gidx g ON g.label = j.label""",
    "key_split": _with(FIXTURE) + """
SELECT y.track_id, y.year,
       CASE WHEN y.track_id % 100 < 70 THEN 'TRAIN' ELSE 'TEST' END AS subset
FROM t_year y JOIN t_features f ON f.track_id = y.track_id""",
    "fold_counts": _with(FIXTURE) + """
SELECT CAST(track_id % 3 AS INTEGER) AS fold, count(*) AS n_rows
FROM joined WHERE subset = 'TRAIN' GROUP BY 1""",
    "logreg_default_predictions": _with(FIXTURE, MAJORITY) + "SELECT * FROM pred",
    "accuracy_test_error": _with(FIXTURE, MAJORITY) + ACCURACY_SELECT,
    "per_class_accuracy": _with(FIXTURE, MAJORITY) + """
SELECT label, count(*) AS n_rows,
       CAST(sum(CASE WHEN label = predicted_label THEN 1 ELSE 0 END) AS BIGINT) AS n_correct,
       round(sum(CASE WHEN label = predicted_label THEN 1 ELSE 0 END) / count(*), 8) AS accuracy
FROM pred GROUP BY label""",
    "sample_predictions": _with(FIXTURE, MAJORITY) + """
SELECT track_id, predicted_label, label FROM pred ORDER BY track_id LIMIT 5""",
    "embedding_logreg_accuracy": _with(EMBEDDINGS, MAJORITY) + ACCURACY_SELECT,
    "ols_year": _with(FIXTURE, YEAR_JOIN) + """
SELECT round(regr_slope(year, qty), 8) AS slope,
       round(regr_intercept(year, qty), 6) AS intercept,
       round(sqrt(regr_syy(year, qty) * (1 - regr_r2(year, qty)) / regr_count(year, qty)), 6)
         AS rmse,
       round(regr_r2(year, qty), 8) AS r2,
       CAST(count(*) AS BIGINT) AS n_rows
FROM yj""",
    "regression_metrics": _with(FIXTURE, YEAR_JOIN) + """,
ys AS (SELECT *, CASE WHEN track_id % 100 < 70 THEN 'TRAIN' ELSE 'TEST' END AS subset FROM yj),
fit AS (SELECT regr_slope(year, qty) AS b, regr_intercept(year, qty) AS a
        FROM ys WHERE subset = 'TRAIN')
SELECT subset, CAST(count(*) AS BIGINT) AS n_rows,
       round(sqrt(avg((year - (a + b * qty)) * (year - (a + b * qty)))), 6) AS rmse,
       round(1 - avg((year - (a + b * qty)) * (year - (a + b * qty))) / var_pop(year), 6) AS r2
FROM ys, fit GROUP BY subset""",
    "logreg_cv_grid": _with(FIXTURE, CV_METRIC) + "SELECT * FROM results",
    "best_params": _with(FIXTURE, CV_METRIC) + """
SELECT * FROM results ORDER BY avg_metric DESC, grid_id LIMIT 1""",
    "logreg_cv_test_error": _with(FIXTURE, MAJORITY) + ACCURACY_SELECT,
    "logreg_saturated": _with(FIXTURE, BANDED) + "SELECT * FROM pred",
    "forest_stump": _with(FIXTURE, BANDED) + "SELECT * FROM pred",
    "tree_depth2": "\nUNION ALL ".join(_tree(target, impurity) for target in TREE_FEATURES
                                       for impurity in IMPURITY),
    "tree_cv": _tree_cv(),
    "logreg_cv_saturated": _with(FIXTURE, BANDED) + "SELECT * FROM bresults",
    "best_params_saturated": _with(FIXTURE, BANDED) + """
SELECT * FROM bresults ORDER BY avg_metric DESC, grid_id LIMIT 1""",
    "cv_test_error_saturated": _with(FIXTURE, BANDED) + ACCURACY_SELECT,
    "logreg_certificate": _with(FIXTURE) + f"""
SELECT g.label, f.feature, true AS optimal
FROM gidx g CROSS JOIN (VALUES {_names(OLS_COLUMNS[:-1])}) AS f(feature)""",
    "ols_year_all": _with(FIXTURE, YEAR_JOIN, _elimination(OLS_COLUMNS, "yj"))
    + _ols_rows(OLS_COLUMNS),
    "year_certificate": f"""
SELECT p.penalty, f.feature, true AS optimal
FROM (VALUES ('reference'), ('light')) AS p(penalty)
CROSS JOIN (VALUES {_names(OLS_COLUMNS[:-1])}) AS f(feature)""",
    "objective_certificate": _with(FIXTURE, YEAR_JOIN) + """
SELECT 'logreg' AS model, count(*) AS n_rows, true AS agrees, true AS sparse
FROM joined WHERE subset = 'TRAIN'
UNION ALL SELECT 'year', count(*), true, true FROM yj""",
    "sweep_results": _with(FIXTURE) + """
SELECT CAST(r.run_id AS INTEGER) AS run_id, r.app_name, r.algorithm, 'done' AS status,
       CASE WHEN r.algorithm <> 'year' THEN
         (SELECT count(*) FROM joined WHERE subset = 'TRAIN') END AS n_train,
       CAST(1 AS BIGINT) AS n_attempts
FROM (VALUES (0, 'logreg orders orders orders', 'logreg'),
             (1, 'forest orders orders orders', 'forest'),
             (4, 'year orders_year orders -', 'year')) AS r(run_id, app_name, algorithm)""",
}
