"""The detector pipeline of the catalogue as one SQL chain, for comparison on DuckDB."""

from __future__ import annotations

from lanternflow.catalog.views import FLOWS

FEATURES = ["tok_uniq", "tok_top_share", "dst_uniq", "dst_top_share", "bytes_mean", "bytes_std", "repeat_last", "nll"]


def _windows(name: str, source: str, part: str) -> str:
    w = f"PARTITION BY {part} ORDER BY \"timestamp\", event_row_id"

    def top(x: str) -> str:
        return (f"list_max(list_transform(list_distinct({x}), lambda v: len(list_filter({x}, lambda y: y = v)))) / 4.0")

    return f"""{name}0 AS (
  SELECT *, row_number() OVER w - 1 AS pos, lag(token_id) OVER w AS t1, lag(token_id, 2) OVER w AS t2,
    list(token_id) OVER f AS toks, list(dst_id) OVER f AS dsts, avg(x) OVER f AS bytes_mean,
    stddev_pop(x) OVER f AS bytes_std
  FROM {source} WINDOW w AS ({w}), f AS ({w} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
{name} AS MATERIALIZED (
  SELECT * EXCLUDE (toks, dsts), CAST(len(list_distinct(toks)) AS DOUBLE) AS tok_uniq, {top('toks')} AS tok_top_share,
    CAST(len(list_distinct(dsts)) AS DOUBLE) AS dst_uniq, {top('dsts')} AS dst_top_share,
    CAST(token_id = t1 AS DOUBLE) AS repeat_last
  FROM {name}0 WHERE pos >= 3)"""


def _nll(name: str, source: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT w.*, -ln(least(greatest(
      coalesce(0.5 * coalesce(tri.c, 0) / h2.c2, 0) + coalesce(0.3 * coalesce(pr.c1y, 0) / h1.c1, 0)
      + (0.2 + CASE WHEN h2.c2 IS NULL THEN 0.5 ELSE 0 END + CASE WHEN h1.c1 IS NULL THEN 0.3 ELSE 0 END)
        * (coalesce(u.cy, 0) + 0.1) / (tot.n + 0.1 * voc.v), 1e-9), 1.0)) AS nll
  FROM {source} w CROSS JOIN tot CROSS JOIN voc
  LEFT JOIN tri ON w.t2 = tri.t2 AND w.t1 = tri.t1 AND w.token_id = tri.token_id
  LEFT JOIN h2 ON w.t2 = h2.t2 AND w.t1 = h2.t1 LEFT JOIN h1 ON w.t1 = h1.t1
  LEFT JOIN pr ON w.t1 = pr.t1 AND w.token_id = pr.token_id LEFT JOIN u ON w.token_id = u.token_id)"""


def _scored(name: str, source: str) -> str:
    zs = ",\n    ".join(
        f"least(greatest((n.{f} - coalesce(b.med_{f}, g.med_{f})) / greatest(coalesce(b.scale_{f}, g.scale_{f}), 1e-6), "
        f"-50), 50) AS z_{f}" for f in FEATURES)
    total = " + ".join(f"abs(z_{f})" for f in FEATURES)
    rest = " + ".join(f"abs(z_{f})" for f in FEATURES[:-1])
    best = "greatest(" + ", ".join(f"round(abs(z_{f}), 9)" for f in FEATURES) + ")"
    pick = " ".join(f"WHEN round(abs(z_{f}), 9) = {best} THEN '{f}'" for f in FEATURES)
    return f"""{name}z AS (
  SELECT n.*, (n.nll - coalesce(en.mean_nll, gn.mean_nll)) / greatest(coalesce(en.std_nll, gn.std_nll), 1e-6) AS nll_z,
    b.entity_id IS NOT NULL AS has_baseline,
    {zs}
  FROM {source} n CROSS JOIN gbase g CROSS JOIN gn LEFT JOIN ebase b ON n.entity_id = b.entity_id
  LEFT JOIN en ON n.entity_id = en.entity_id),
{name} AS MATERIALIZED (
  SELECT *, ({total}) / 8.0 AS score, ({rest}) / 7.0 AS score_without_nll,
    CASE {pick} END AS top_contributing_feature
  FROM {name}z)"""


_EBASE_MED = ", ".join(f"median({f}) AS med_{f}" for f in FEATURES)
_EBASE_MAD = ", ".join(f"median(abs(n.{f} - m.med_{f})) AS mad_{f}" for f in FEATURES)
_GMED = ", ".join(f"median({f}) AS med_{f}, greatest(0.25 * stddev_pop({f}), 1e-3) AS floor_{f}" for f in FEATURES)
_GSCALE = ", ".join(f"any_value(g.med_{f}) AS med_{f}, any_value(g.floor_{f}) AS floor_{f}, "
                    f"greatest(1.4826 * median(abs(n.{f} - g.med_{f})), any_value(g.floor_{f})) AS scale_{f}"
                    for f in FEATURES)
_ESCALE = ", ".join(f"any_value(m.med_{f}) AS med_{f}, greatest(1.4826 * median(abs(n.{f} - m.med_{f})), "
                    f"any_value(g.floor_{f})) AS scale_{f}" for f in FEATURES)

TOKENS = f"""{FLOWS},
tr AS MATERIALIZED (SELECT * FROM flows WHERE split = 'train' AND label = 'BENIGN'),
tops AS (SELECT dst_id, row_number() OVER (ORDER BY dst_id) - 1 AS di
  FROM (SELECT dst_id FROM tr GROUP BY dst_id ORDER BY count(*) DESC, dst_id LIMIT 5)),
kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS ei
  FROM (SELECT DISTINCT event_type FROM tr)),
edges AS MATERIALIZED (SELECT list_sort(list_distinct(quantile_cont(ln(1 + greatest(bytes, 0)),
  [0.0::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE, 1.0::DOUBLE]))) AS e FROM tr),
voc AS (SELECT (SELECT count(*) FROM kinds) * 6 * (len(e) - 1) + 2 AS v FROM edges),
parts AS (SELECT f.*, ln(1 + greatest(bytes, 0)) AS x, di, ei, e FROM flows f CROSS JOIN edges
  LEFT JOIN tops USING (dst_id) LEFT JOIN kinds USING (event_type)),
binned AS (SELECT * EXCLUDE (e), len(e) - 1 AS nb,
  greatest(least(len(list_filter(e, lambda q: q <= x)) - 1, len(e) - 2), 0) AS byte_bin FROM parts),
tok AS MATERIALIZED (SELECT *, coalesce(2 + (ei * 6 + coalesce(di, 5)) * nb + byte_bin, 1) AS token_id,
  CASE WHEN di IS NULL THEN 'DST=OTHER' ELSE 'DST=' || dst_id END AS dst_bucket,
  event_type || '|' || CASE WHEN di IS NULL THEN 'DST=OTHER' ELSE 'DST=' || dst_id END || '|BYTES_Q' || byte_bin AS token_str
  FROM binned)"""

MODEL = f"""{TOKENS},
ttr AS (SELECT * FROM tok WHERE split = 'train' AND label = 'BENIGN'),
{_windows('wtr', 'ttr', 'entity_id')},
tri AS MATERIALIZED (SELECT t2, t1, token_id, count(*) AS c FROM wtr GROUP BY ALL),
h2 AS (SELECT t2, t1, sum(c) AS c2 FROM tri GROUP BY ALL), h1 AS (SELECT t1, sum(c) AS c1 FROM tri GROUP BY ALL),
pr AS (SELECT t1, token_id, sum(c) AS c1y FROM tri GROUP BY ALL),
u AS (SELECT token_id, sum(c) AS cy FROM tri GROUP BY ALL), tot AS (SELECT sum(c) AS n FROM tri),
{_nll('ntr', 'wtr')}"""

CHAIN = f"""{MODEL},
gn AS MATERIALIZED (SELECT avg(nll) AS mean_nll, CASE WHEN stddev_pop(nll) > 0 THEN stddev_pop(nll) ELSE 1e-6 END AS std_nll FROM ntr),
en AS MATERIALIZED (SELECT entity_id,
  CASE WHEN s IS NULL OR s <= 1e-3 OR k < 5 THEN gn.mean_nll ELSE m END AS mean_nll,
  CASE WHEN s IS NULL OR s <= 1e-3 OR k < 5 THEN gn.std_nll ELSE s END AS std_nll
  FROM (SELECT entity_id, avg(nll) AS m, stddev_samp(nll) AS s, count(*) AS k FROM ntr GROUP BY 1) CROSS JOIN gn),
gmed AS (SELECT {_GMED} FROM ntr),
gbase AS MATERIALIZED (SELECT {_GSCALE} FROM ntr n CROSS JOIN gmed g),
emed AS (SELECT entity_id, {_EBASE_MED} FROM ntr GROUP BY 1 HAVING count(*) >= 30),
ebase AS MATERIALIZED (SELECT n.entity_id, {_ESCALE} FROM ntr n JOIN emed m USING (entity_id) CROSS JOIN gmed g GROUP BY 1),
tds AS (SELECT * FROM tok WHERE split <> 'train'),
{_windows('wst', 'tds', 'entity_id')},
{_windows('wds', 'tds', 'split, entity_id')},
{_nll('nst', 'wst')},
{_nll('nds', 'wds')},
{_scored('sst', 'nst')},
{_scored('sds', 'nds')},
thr AS MATERIALIZED (SELECT min(score) AS t FROM (
  SELECT score, row_number() OVER (ORDER BY score) - 1 AS k, count(*) OVER () AS n
  FROM sst WHERE split = 'dev' AND label = 'BENIGN') WHERE k >= ceil((n - 1) * 0.99::DOUBLE))"""


def threshold_of(source: str, column: str, where: str) -> str:
    """Scalar subquery: the upper-neighbour 0.99 quantile of a column."""
    return (f"(SELECT min({column}) FROM (SELECT {column}, row_number() OVER (ORDER BY {column}) - 1 AS k, "
            f"count(*) OVER () AS n FROM {source} WHERE {where}) WHERE k >= ceil((n - 1) * 0.99::DOUBLE))")
