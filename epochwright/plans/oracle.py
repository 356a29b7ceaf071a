"""Each query of the registry restated in SQL, for comparison by a second engine."""

from __future__ import annotations

SQL: dict[str, str] = {}

# --- shared table expressions -------------------------------------------------

NAMES = """
keyed AS (
  SELECT c_custkey AS pos,
         'SC4' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || (1 + (c_custkey // 100) % 2)::VARCHAR AS k
  FROM customer),
names AS (
  SELECT k || 'E' || (pos % 7)::VARCHAR || '-PSG.edf' AS name, pos, k, 0 AS side FROM keyed
  UNION ALL
  SELECT k || 'EC-Hypnogram.edf', pos, k, 1 FROM keyed WHERE pos % 100 < 80),
sides AS (
  SELECT substr(name, 1, 6) AS key,
         arg_max(CASE WHEN side = 0 THEN name END, CASE WHEN side = 0 THEN pos END) AS psg_name,
         arg_max(CASE WHEN side = 1 THEN name END, CASE WHEN side = 1 THEN pos END) AS hypnogram_name
  FROM names GROUP BY 1),
pairs AS (
  SELECT 'SC' || substr(key, 4, 2) AS subject_id, substr(key, 6, 1)::INTEGER AS night,
         psg_name, hypnogram_name
  FROM sides WHERE psg_name IS NOT NULL AND hypnogram_name IS NOT NULL)"""

TEXTS = """
texts AS (
  SELECT event_id, user_id, ts, value,
         CASE event_type WHEN 'click' THEN 'Sleep stage W' WHEN 'view' THEN 'Sleep stage 1'
           WHEN 'purchase' THEN 'Sleep stage 2' WHEN 'signup' THEN 'Sleep stage R'
           WHEN 'error' THEN 'Sleep stage ?' END AS description,
         CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1
           WHEN 'purchase' THEN 2 WHEN 'signup' THEN 4 END AS stage
  FROM events)"""

PLAN = (
    TEXTS
    + """,
ann AS (
  SELECT user_id, stage, value AS duration,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ann_idx,
         count(*) OVER (PARTITION BY user_id) AS n_ann
  FROM texts),
steps AS (
  SELECT user_id, stage, ann_idx, n_ann, 30.0 * ann_idx AS onset,
         unnest(generate_series(0, round_even(duration / 30, 0)::BIGINT - 1)) AS k
  FROM ann WHERE stage IS NOT NULL),
placed AS (
  SELECT user_id, stage, ann_idx, k, round_even((onset + k * 30) * 100, 0)::BIGINT AS start_sample
  FROM steps
  WHERE round_even((onset + k * 30) * 100, 0) >= 0
    AND round_even((onset + k * 30) * 100, 0) + 3000 <= 3000 * n_ann),
plan AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ann_idx, k) - 1 AS plan_idx,
         start_sample, stage
  FROM placed),
bounds AS (
  SELECT user_id, min(CASE WHEN stage <> 0 THEN plan_idx END) - 2 AS lo,
         max(CASE WHEN stage <> 0 THEN plan_idx END) + 2 AS hi
  FROM plan GROUP BY 1),
kept AS (
  SELECT user_id, plan_idx, start_sample, stage,
         (row_number() OVER (PARTITION BY user_id ORDER BY plan_idx) - 1)::INTEGER AS epoch_idx
  FROM plan JOIN bounds USING (user_id)
  WHERE lo IS NULL OR plan_idx BETWEEN lo AND hi)"""
)

GRID = (
    TEXTS
    + """,
ann AS (
  SELECT user_id, stage, value AS duration,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ann_idx
  FROM texts),
spans AS (
  SELECT user_id, stage, ann_idx,
         unnest(generate_series(ann_idx, ann_idx + round_even(duration / 30, 0)::BIGINT - 1)) AS epoch_idx
  FROM ann WHERE stage IS NOT NULL),
labels AS (
  SELECT user_id, epoch_idx, arg_max(stage, ann_idx) AS stage FROM spans GROUP BY 1, 2),
cells AS (
  SELECT user_id, unnest(generate_series(0, count(*) + 7)) AS epoch_idx FROM events GROUP BY 1),
grid AS (
  SELECT c.user_id, c.epoch_idx::INTEGER AS epoch_idx, coalesce(l.stage, -1) AS expert
  FROM cells c LEFT JOIN labels l ON l.user_id = c.user_id AND l.epoch_idx = c.epoch_idx)"""
)

STAGES = """
stages AS (
  SELECT * FROM (VALUES (0, 'W', 4), (1, 'N1', 2), (2, 'N2', 1), (3, 'N3', 0), (4, 'REM', 3))
    AS t(stage, name, ypos))"""

VECTORS = """
vec AS (
  SELECT 'SC' || lpad((vec_id % 20)::VARCHAR, 2, '0') AS subject_id,
         (1 + (vec_id // 20) % 2)::INTEGER AS night, (vec_id // 40)::INTEGER AS epoch_idx,
         label % 5 AS stage, embedding::DOUBLE[] AS signal
  FROM embeddings)"""

SAMPLES = (
    VECTORS
    + """,
samples AS (
  SELECT subject_id, night, epoch_idx, stage, unnest(generate_series(1, 64)) AS i, unnest(signal) AS x
  FROM vec)"""
)

# single 64-sample segment: mean removed, periodic Hann window, 33 bins, inner bins doubled
SPECTRUM = (
    SAMPLES
    + """,
windowed AS (
  SELECT subject_id, night, epoch_idx, i - 1 AS n,
         (x - avg(x) OVER (PARTITION BY subject_id, night, epoch_idx))
           * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / 64)) AS v
  FROM samples),
bins AS (SELECT unnest(generate_series(0, 32)) AS b),
psd AS (
  SELECT subject_id, night, epoch_idx, b, b * 100.0 / 64 AS hz,
         (pow(sum(v * cos(2 * pi() * b * n / 64)), 2) + pow(sum(v * sin(2 * pi() * b * n / 64)), 2))
           * CASE WHEN b IN (0, 32) THEN 1 ELSE 2 END AS p
  FROM windowed, bins GROUP BY subject_id, night, epoch_idx, b)"""
)

DIFFS = (
    SAMPLES
    + """,
d1 AS (
  SELECT *, x - lag(x) OVER w AS dx FROM samples
  WINDOW w AS (PARTITION BY subject_id, night, epoch_idx ORDER BY i)),
d2 AS (
  SELECT *, dx - lag(dx) OVER w AS ddx FROM d1
  WINDOW w AS (PARTITION BY subject_id, night, epoch_idx ORDER BY i)),
spread AS (
  SELECT subject_id, night, epoch_idx, var_pop(x) AS vx, var_pop(dx) AS vd, var_pop(ddx) AS vdd
  FROM d2 GROUP BY 1, 2, 3)"""
)

SPLIT = (
    VECTORS
    + """,
subjects AS (
  SELECT subject_id, array_sort(array_agg(DISTINCT stage)) AS stages FROM vec GROUP BY 1),
ordered AS (
  SELECT subject_id, stages, row_number() OVER (ORDER BY md5('42:' || subject_id)) - 1 AS position,
         count(*) OVER () AS n
  FROM subjects),
split AS (
  SELECT subject_id, stages,
         CASE WHEN position < greatest(1, round_even(n * 0.15, 0)) THEN 'test'
              WHEN position < 2 * greatest(1, round_even(n * 0.15, 0)) THEN 'val'
              ELSE 'train' END AS split
  FROM ordered)"""
)

ORDERS = """
p AS (
  SELECT o_custkey AS subject_id, 1 AS night, o_orderdate, o_orderkey,
         substr(o_orderpriority, 1, 1)::INTEGER - 1 AS stage,
         CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 5)::INTEGER
              ELSE substr(o_orderpriority, 1, 1)::INTEGER - 1 END AS pred
  FROM orders),
night AS (
  SELECT subject_id, night, stage, pred,
         (row_number() OVER (PARTITION BY subject_id ORDER BY o_orderdate, o_orderkey) - 1)::INTEGER
           AS epoch_idx
  FROM p)"""


def _metrics(rows: str, by: str = "0", true: str = "stage", pred: str = "pred") -> str:
    """Counts, per-class scores and kappa parts of ``rows``, one group per ``by`` value."""
    return f"""
src AS (SELECT {by} AS g, {true} AS t, {pred} AS p FROM {rows}),
groups AS (SELECT g, count(*) AS n_epochs, avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END) AS accuracy
           FROM src GROUP BY g),
cm AS (
  SELECT g.g, a.stage AS t, b.stage AS p,
         (SELECT count(*) FROM src s WHERE s.g = g.g AND s.t = a.stage AND s.p = b.stage) AS n
  FROM groups g, stages a, stages b),
rowsum AS (SELECT g, t AS stage, sum(n) AS true_n FROM cm GROUP BY 1, 2),
colsum AS (SELECT g, p AS stage, sum(n) AS pred_n FROM cm GROUP BY 1, 2),
hits AS (SELECT g, t AS stage, n AS hit FROM cm WHERE t = p),
scores AS (
  SELECT g, stage, name, true_n, pred_n, hit,
         CASE WHEN pred_n > 0 THEN hit / pred_n ELSE 0.0 END AS precision,
         CASE WHEN true_n > 0 THEN hit / true_n ELSE 0.0 END AS recall,
         CASE WHEN true_n + pred_n > 0 THEN 2.0 * hit / (true_n + pred_n) ELSE 0.0 END AS f1
  FROM rowsum JOIN colsum USING (g, stage) JOIN hits USING (g, stage) JOIN stages USING (stage)),
parts AS (
  SELECT g, sum(true_n)::DOUBLE AS n, sum(hit)::DOUBLE AS agreed,
         sum(true_n::DOUBLE * pred_n) AS chance,
         avg(f1) FILTER (WHERE true_n + pred_n > 0) AS macro_f1
  FROM scores GROUP BY g),
head AS (
  SELECT g, n_epochs, accuracy, macro_f1,
         CASE WHEN n * n - chance = 0 THEN 'NaN'::DOUBLE
              ELSE (n * agreed - chance) / (n * n - chance) END AS cohen_kappa
  FROM groups JOIN parts USING (g))"""


ORDER_METRICS = f"{STAGES}, {ORDERS}, {_metrics('p')}"

CHANCES = (
    SAMPLES
    + """,
parts AS (
  SELECT subject_id, night, epoch_idx, stage, (i - 1) // 13 AS c, sum(abs(x)) AS s
  FROM samples GROUP BY 1, 2, 3, 4, 5),
shares AS (
  SELECT subject_id, night, epoch_idx, stage, c::INTEGER AS c,
         s / sum(s) OVER (PARTITION BY subject_id, night, epoch_idx) AS p
  FROM parts),
chances AS (
  SELECT subject_id, night, epoch_idx, stage, list(p ORDER BY c) AS proba,
         arg_max(c, p) AS pred
  FROM shares GROUP BY 1, 2, 3, 4)"""
)

# --- discovery -----------------------------------------------------------------------

SQL["q_listing_names"] = """
WITH found AS (
  SELECT page_id AS page, regexp_extract_all(html, 'href="([^"]*)"', 1) AS names FROM pages),
hits AS (
  SELECT page, unnest(names) AS name, unnest(generate_series(0, len(names)::BIGINT - 1)) AS pos
  FROM found WHERE len(names) > 0)
SELECT name, min(page) AS page, arg_min(pos, (page, pos))::INTEGER AS pos FROM hits GROUP BY name"""

SQL["q_parse_stem"] = f"""
WITH {NAMES}
SELECT name, pos, substr(name, 1, 6) AS key, 'SC' || substr(name, 4, 2) AS subject_id,
       substr(name, 6, 1)::INTEGER AS night
FROM names"""

SQL["q_pair"] = f"WITH {NAMES} SELECT * FROM pairs"

SQL["q_unpaired"] = f"""
WITH {NAMES}
SELECT key, coalesce(psg_name, hypnogram_name) AS name,
       CASE WHEN psg_name IS NULL THEN 'signal' ELSE 'annotations' END AS missing
FROM sides WHERE psg_name IS NULL OR hypnogram_name IS NULL"""

SQL["q_limit"] = f"""
WITH {NAMES}
SELECT * FROM pairs
WHERE subject_id IN (SELECT DISTINCT subject_id FROM pairs ORDER BY 1 LIMIT 10)"""

SQL["q_manifest"] = f"""
WITH {NAMES}
SELECT subject_id, night, '/raw/' || psg_name AS psg_path, '/raw/' || hypnogram_name AS hypnogram_path
FROM pairs"""

SQL["q_missing_files"] = """
SELECT DISTINCT 'rec' || (event_id // 100)::VARCHAR || '-PSG.edf' AS name FROM events
EXCEPT
SELECT 'rec' || (vec_id // 50)::VARCHAR || '-PSG.edf' FROM embeddings"""

SQL["q_oversized_files"] = """
SELECT 'rec' || (vec_id // 50)::VARCHAR || '-PSG.edf' AS name,
       (256 * 3 + count(*) * (64 + 32) * 2)::BIGINT AS length
FROM embeddings GROUP BY vec_id // 50 HAVING 256 * 3 + count(*) * (64 + 32) * 2 > 10000"""

# --- annotations and plans -------------------------------------------------------------

SQL["q_map_annotation"] = f"""
WITH {TEXTS} SELECT event_id, description, stage FROM texts WHERE stage IS NOT NULL"""

SQL["q_plan"] = f"WITH {PLAN} SELECT * FROM plan"

SQL["q_trim"] = f"WITH {PLAN} SELECT * FROM kept"

SQL["q_stage_counts"] = f"""
WITH {STAGES}, {PLAN},
users AS (SELECT user_id, count(*) AS total FROM kept GROUP BY 1),
counts AS (SELECT user_id, stage, count(*) AS n FROM kept GROUP BY 1, 2)
SELECT u.user_id, s.stage, s.name, coalesce(c.n, 0)::BIGINT AS n,
       round(100.0 * coalesce(c.n, 0) / u.total, 6) AS pct
FROM users u CROSS JOIN stages s
LEFT JOIN counts c ON c.user_id = u.user_id AND c.stage = s.stage"""

SQL["q_expert_grid"] = f"WITH {GRID} SELECT * FROM grid"

SQL["q_expert_predictions"] = f"""
WITH {GRID}
SELECT user_id, epoch_idx, ((epoch_idx * 7 + user_id) % 5)::INTEGER AS pred, expert FROM grid"""

SQL["q_too_short"] = """
SELECT user_id, count(*) AS n_samples FROM events GROUP BY 1 HAVING count(*) < 64"""

SQL["q_scored_metrics"] = f"""
WITH {STAGES}, {GRID},
scored AS (
  SELECT user_id, expert, ((epoch_idx * 7 + user_id) % 5)::INTEGER AS pred
  FROM grid WHERE expert <> -1),
{_metrics('scored', 'user_id', 'expert')}
SELECT g AS user_id, n_epochs AS n_scored_epochs, round(accuracy, 6) AS accuracy,
       round(macro_f1, 6) AS macro_f1, round(cohen_kappa, 6) + 0.0 AS cohen_kappa
FROM head"""

# --- normalization and slicing ------------------------------------------------------------

SQL["q_zscore_stats"] = """
SELECT user_id, count(*) AS n_samples, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std
FROM events GROUP BY 1"""

SQL["q_zscore"] = """
SELECT event_id,
       round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-8), 6) + 0.0 AS z
FROM events WINDOW w AS (PARTITION BY user_id)"""

SQL["q_zscore_blocks"] = f"""
WITH {SAMPLES},
stats AS (
  SELECT subject_id, night, avg(x) AS mu, stddev_pop(x) AS sd FROM samples GROUP BY 1, 2)
SELECT subject_id, night, epoch_idx,
       list(round((x - mu) / (sd + 1e-8), 6) + 0.0 ORDER BY i) AS z
FROM samples JOIN stats USING (subject_id, night) GROUP BY 1, 2, 3"""

_INDEXED = """
indexed AS (
  SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos
  FROM events)"""

SQL["q_cut_epochs"] = f"""
WITH {_INDEXED}
SELECT user_id, (pos // 8)::INTEGER AS epoch_idx, list(value ORDER BY pos) AS signal
FROM indexed GROUP BY 1, 2 HAVING count(*) = 8"""

SQL["q_slice_blocks"] = f"""
WITH {_INDEXED}
SELECT user_id, (pos // 8)::INTEGER AS plan_idx, list(value ORDER BY pos) AS samples
FROM indexed GROUP BY 1, 2 HAVING count(*) = 8"""

# --- features ---------------------------------------------------------------------------------

SQL["q_band_powers"] = f"""
WITH {SPECTRUM},
power AS (
  SELECT subject_id, night, epoch_idx,
         sum(p) FILTER (WHERE hz >= 0.5 AND hz <= 30) AS total,
         sum(p) FILTER (WHERE hz >= 0.5 AND hz < 4) AS delta,
         sum(p) FILTER (WHERE hz >= 4 AND hz < 8) AS theta,
         sum(p) FILTER (WHERE hz >= 8 AND hz < 13) AS alpha,
         sum(p) FILTER (WHERE hz >= 11 AND hz < 16) AS sigma,
         sum(p) FILTER (WHERE hz >= 16 AND hz < 30) AS beta
  FROM psd GROUP BY 1, 2, 3)
SELECT subject_id, night, epoch_idx,
       round(CASE WHEN total > 0 THEN delta / total ELSE 0 END, 6) AS feat_bp_delta,
       round(CASE WHEN total > 0 THEN theta / total ELSE 0 END, 6) AS feat_bp_theta,
       round(CASE WHEN total > 0 THEN alpha / total ELSE 0 END, 6) AS feat_bp_alpha,
       round(CASE WHEN total > 0 THEN sigma / total ELSE 0 END, 6) AS feat_bp_sigma,
       round(CASE WHEN total > 0 THEN beta / total ELSE 0 END, 6) AS feat_bp_beta
FROM power"""

SQL["q_entropy"] = f"""
WITH {SPECTRUM},
shares AS (
  SELECT subject_id, night, epoch_idx,
         p / nullif(sum(p) OVER (PARTITION BY subject_id, night, epoch_idx), 0) AS s
  FROM psd WHERE b > 0)
SELECT subject_id, night, epoch_idx,
       round(CASE WHEN count(*) FILTER (WHERE s > 0) > 1
                  THEN -sum(s * ln(s)) FILTER (WHERE s > 0) / ln(count(*) FILTER (WHERE s > 0))
                  ELSE 0 END, 6) AS feat_spec_entropy
FROM shares GROUP BY 1, 2, 3"""

# segments of 256 samples, 128 apart, averaged; bins of 100 / 256 Hz
SQL["q_welch_segments"] = """
WITH samples AS (
  SELECT vec_id // 8 AS epoch, (vec_id % 8) * 64 + unnest(generate_series(0, 63)) AS i,
         unnest(embedding::DOUBLE[]) AS x
  FROM embeddings),
whole AS (SELECT epoch, count(*) AS samples FROM samples GROUP BY 1),
segments AS (
  SELECT epoch, g AS seg, i - 128 * g AS n, x
  FROM samples JOIN whole USING (epoch), (SELECT unnest([0, 1, 2]) AS g)
  WHERE i >= 128 * g AND i < 128 * g + 256 AND 128 * g + 256 <= whole.samples),
windowed AS (
  SELECT epoch, seg, n,
         (x - avg(x) OVER (PARTITION BY epoch, seg)) * (0.5 - 0.5 * cos(2 * pi() * n / 256)) AS v
  FROM segments),
bins AS (SELECT unnest(generate_series(0, 128)) AS b),
spectra AS (
  SELECT epoch, seg, b,
         (pow(sum(v * cos(2 * pi() * ((b * n) % 256) / 256)), 2)
          + pow(sum(v * sin(2 * pi() * ((b * n) % 256) / 256)), 2))
           * CASE WHEN b IN (0, 128) THEN 1 ELSE 2 END AS p
  FROM windowed, bins GROUP BY epoch, seg, b),
psd AS (SELECT epoch, b, b * 100.0 / 256 AS hz, avg(p) AS p FROM spectra GROUP BY epoch, b),
power AS (
  SELECT epoch,
         sum(p) FILTER (WHERE hz >= 0.5 AND hz <= 30) AS total,
         sum(p) FILTER (WHERE hz >= 0.5 AND hz < 4) AS delta,
         sum(p) FILTER (WHERE hz >= 4 AND hz < 8) AS theta,
         sum(p) FILTER (WHERE hz >= 8 AND hz < 13) AS alpha,
         sum(p) FILTER (WHERE hz >= 11 AND hz < 16) AS sigma,
         sum(p) FILTER (WHERE hz >= 16 AND hz < 30) AS beta,
         sum(p) FILTER (WHERE b > 0) AS ac
  FROM psd GROUP BY 1),
entropy AS (
  SELECT epoch, -sum(p / ac * ln(p / ac)) / ln(count(*)) AS e
  FROM psd JOIN power USING (epoch) WHERE b > 0 AND p > 0 GROUP BY 1)
SELECT epoch, round(delta / total, 6) AS feat_bp_delta, round(theta / total, 6) AS feat_bp_theta,
       round(alpha / total, 6) AS feat_bp_alpha, round(sigma / total, 6) AS feat_bp_sigma,
       round(beta / total, 6) AS feat_bp_beta, round(e, 6) AS feat_spec_entropy
FROM power JOIN entropy USING (epoch)"""

SQL["q_hjorth"] = f"""
WITH {DIFFS},
mob AS (
  SELECT subject_id, night, epoch_idx, vx,
         CASE WHEN vx > 0 THEN sqrt(vd / vx) ELSE 0 END AS m,
         CASE WHEN vd > 0 THEN sqrt(vdd / vd) ELSE 0 END AS md
  FROM spread)
SELECT subject_id, night, epoch_idx, round(vx, 6) AS feat_hjorth_activity,
       round(m, 6) AS feat_hjorth_mobility,
       round(CASE WHEN m > 0 THEN md / m ELSE 0 END, 6) AS feat_hjorth_complexity
FROM mob"""

SQL["q_rms"] = f"""
WITH {SAMPLES}
SELECT subject_id, night, epoch_idx, round(sqrt(avg(x * x)), 6) AS feat_rms
FROM samples GROUP BY 1, 2, 3"""

# --- cohort ---------------------------------------------------------------------------------------

SQL["q_subject_stages"] = f"WITH {SPLIT} SELECT subject_id, stages FROM subjects"

SQL["q_subject_overview"] = f"""
WITH {VECTORS}
SELECT count(*) AS n_rows, count(DISTINCT (subject_id, night)) AS n_recordings,
       count(DISTINCT subject_id) AS n_subjects
FROM vec"""

SQL["q_split"] = f"WITH {SPLIT} SELECT subject_id, split FROM split"

SQL["q_split_sizes"] = f"WITH {SPLIT} SELECT split, count(*) AS n_subjects FROM split GROUP BY 1"

SQL["q_coverage"] = f"""
WITH {SPLIT},
seen AS (SELECT DISTINCT split, unnest(stages) AS stage FROM split),
names AS (SELECT unnest(['train', 'val', 'test']) AS split)
SELECT n.split, coalesce(list(s.stage ORDER BY s.stage) FILTER (WHERE s.stage IS NOT NULL), []) AS covered,
       list_filter([0, 1, 2, 3, 4], lambda x: NOT list_contains(
         coalesce(list(s.stage) FILTER (WHERE s.stage IS NOT NULL), []), x)) AS missing
FROM names n LEFT JOIN seen s ON s.split = n.split GROUP BY n.split"""

SQL["q_disjoint"] = f"""
WITH {SPLIT}
SELECT (SELECT count(*) FROM (SELECT subject_id FROM split GROUP BY 1 HAVING count(DISTINCT split) > 1))
         AS n_overlapping,
       (SELECT count(*) FROM (SELECT DISTINCT subject_id FROM vec) v
        FULL JOIN (SELECT DISTINCT subject_id FROM split) s ON s.subject_id = v.subject_id
        WHERE v.subject_id IS NULL OR s.subject_id IS NULL) AS n_incomplete"""

SQL["q_split_document"] = f"""
WITH {SPLIT}
SELECT 42::BIGINT AS seed, 0.15::DOUBLE AS val_frac, 0.15::DOUBLE AS test_frac,
       split, shard, count(*) AS n_ids, list(subject_id ORDER BY subject_id) AS ids
FROM (SELECT *, ((row_number() OVER (PARTITION BY split ORDER BY subject_id) - 1) // 10000)::BIGINT AS shard FROM split)
GROUP BY split, shard"""

SQL["q_split_table"] = SQL["q_split"]

SQL["q_split_epochs"] = f"""
WITH {SPLIT}
SELECT subject_id, night, epoch_idx, stage FROM vec
WHERE subject_id IN (SELECT subject_id FROM split WHERE split = 'test')"""

_WEIGHTS = """
counts AS (SELECT stage, count(*) AS n FROM vec GROUP BY 1),
weights AS (
  SELECT stage, n, sum(n) OVER () / (count(*) OVER () * n)::DOUBLE AS weight,
         min(n) OVER () / n::DOUBLE AS relative
  FROM counts)"""

SQL["q_class_weights"] = f"""
WITH {VECTORS}, {_WEIGHTS}
SELECT stage, n, round(weight, 6) AS weight, round(relative, 6) AS relative FROM weights"""

SQL["q_row_weights"] = f"""
WITH {VECTORS}, {_WEIGHTS}
SELECT subject_id, night, epoch_idx, stage, round(weight, 6) AS weight
FROM vec JOIN weights USING (stage)"""

SQL["q_training_order"] = f"""
WITH {VECTORS}
SELECT subject_id, night, epoch_idx,
       row_number() OVER (ORDER BY md5('42:' || subject_id || ':' || night || ':' || epoch_idx)) - 1
         AS position
FROM vec"""

SQL["q_split_warning"] = f"""
WITH {SPLIT}
SELECT DISTINCT v.subject_id, v.night, s.split, s.split IS DISTINCT FROM 'test' AS not_test
FROM vec v LEFT JOIN split s ON s.subject_id = v.subject_id"""

# --- agreement ---------------------------------------------------------------------------------------

SQL["q_confusion"] = f"WITH {ORDER_METRICS} SELECT t AS true, p AS pred, n FROM cm"

SQL["q_confusion_norm"] = f"""
WITH {ORDER_METRICS}
SELECT c.t AS true, c.p AS pred,
       round(CASE WHEN r.true_n > 0 THEN c.n / r.true_n ELSE 0 END, 6) AS row_share
FROM cm c JOIN rowsum r ON r.stage = c.t"""

SQL["q_confusion_wide"] = f"""
WITH {ORDER_METRICS}
SELECT t AS true, sum(n) FILTER (WHERE p = 0)::BIGINT AS "pred_W",
       sum(n) FILTER (WHERE p = 1)::BIGINT AS "pred_N1", sum(n) FILTER (WHERE p = 2)::BIGINT AS "pred_N2",
       sum(n) FILTER (WHERE p = 3)::BIGINT AS "pred_N3", sum(n) FILTER (WHERE p = 4)::BIGINT AS "pred_REM"
FROM cm GROUP BY t"""

SQL["q_per_class"] = f"""
WITH {ORDER_METRICS}
SELECT stage, name, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, true_n::BIGINT AS support
FROM scores"""

SQL["q_headline"] = f"""
WITH {ORDER_METRICS}
SELECT n_epochs, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1,
       round(cohen_kappa, 6) AS cohen_kappa,
       CASE WHEN isnan(cohen_kappa) THEN NULL WHEN cohen_kappa < 0 THEN 'poor'
            WHEN cohen_kappa <= 0.2 THEN 'slight' WHEN cohen_kappa <= 0.4 THEN 'fair'
            WHEN cohen_kappa <= 0.6 THEN 'moderate' WHEN cohen_kappa <= 0.8 THEN 'substantial'
            ELSE 'almost perfect' END AS band
FROM head"""

SQL["q_subject_metrics"] = f"""
WITH {STAGES}, {ORDERS}, {_metrics('p', 'subject_id')}
SELECT g AS subject_id, n_epochs, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1,
       round(cohen_kappa, 6) + 0.0 AS cohen_kappa
FROM head"""

SQL["q_metrics_document"] = f"""
WITH {ORDER_METRICS}
SELECT 'rule' AS model, n_epochs, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1,
       round(cohen_kappa, 6) AS cohen_kappa,
       (SELECT round(f1, 6) FROM scores WHERE stage = 2) AS n2_f1,
       (SELECT true_n::BIGINT FROM scores WHERE stage = 4) AS rem_support,
       (SELECT list(n ORDER BY t, p) FROM cm) AS cells, 'W,N1,N2,N3,REM' AS class_names,
       (SELECT count(DISTINCT subject_id) FROM p) AS n_test_subjects, shard, test_subjects
FROM head, (
  SELECT shard, list(subject_id ORDER BY subject_id) AS test_subjects
  FROM (SELECT subject_id, ((row_number() OVER (ORDER BY subject_id) - 1) // 10000)::BIGINT AS shard
        FROM (SELECT DISTINCT subject_id FROM p))
  GROUP BY shard)"""

SQL["q_compare_models"] = f"""
WITH {STAGES}, {ORDERS},
two AS (
  SELECT 'mixed' AS model, stage, pred FROM p UNION ALL SELECT 'constant', stage, 2 FROM p),
{_metrics('two', 'model')},
long AS (
  SELECT g, 'accuracy' AS metric, accuracy AS value FROM head
  UNION ALL SELECT g, 'macro_f1', macro_f1 FROM head
  UNION ALL SELECT g, 'cohen_kappa', cohen_kappa FROM head
  UNION ALL SELECT g, 'f1_' || name, f1 FROM scores)
SELECT metric, round(max(value) FILTER (WHERE g = 'constant'), 6) + 0.0 AS constant,
       round(max(value) FILTER (WHERE g = 'mixed'), 6) + 0.0 AS mixed
FROM long GROUP BY metric"""

SQL["q_predictor_score"] = f"""
WITH {CHANCES}
SELECT subject_id, night, epoch_idx, pred,
       list_transform(proba, lambda p: round(p, 6)) AS proba
FROM chances"""

SQL["q_scorer_parity"] = f"""
WITH {CHANCES},
turned AS (
  SELECT c.proba AS pa, CASE WHEN v.signal[1] > 0 THEN list_reverse(c.proba) ELSE c.proba END AS pb
  FROM chances c JOIN vec v USING (subject_id, night, epoch_idx)),
gaps AS (
  SELECT list_position(pa, list_max(pa)) <> list_position(pb, list_max(pb)) AS differs,
         list_max([abs(pa[i] - pb[i]) FOR i IN range(1, 6)]) AS gap
  FROM turned)
SELECT count(*) AS n_epochs, count(*) FILTER (WHERE differs) AS label_diffs, round(max(gap), 6) AS max_gap FROM gaps"""

SQL["q_prob_strip"] = f"""
WITH {STAGES}, {CHANCES}
SELECT subject_id, night, epoch_idx, (4 - ypos)::INTEGER AS "row", name, round(p, 6) AS p
FROM shares JOIN stages s ON s.stage = c"""

SQL["q_expand_probabilities"] = f"""
WITH {CHANCES}
SELECT subject_id, night, epoch_idx,
       [round(proba[1], 6), 0.0, round(proba[2], 6), 0.0, round(proba[3], 6)]::DOUBLE[] AS proba
FROM chances"""

SQL["q_bad_probabilities"] = f"""
WITH {CHANCES}
SELECT subject_id, night, epoch_idx FROM chances WHERE pred = 0 AND proba[1] > 1e-4"""

SQL["q_unmatched_epochs"] = f"""
WITH {VECTORS}
SELECT subject_id, night, epoch_idx, stage = 0 AS predicted, stage = 3 AS expert
FROM vec WHERE stage IN (0, 3)"""

SQL["q_wrong_shape"] = f"""
WITH {VECTORS}
SELECT subject_id, night, epoch_idx, 63 AS size FROM vec WHERE stage = 0"""

# --- nights --------------------------------------------------------------------------------------------

_SUMMARY = """
totals AS (SELECT subject_id, night, count(*) AS total FROM night GROUP BY 1, 2),
counts AS (SELECT subject_id, night, pred, count(*) AS n FROM night GROUP BY 1, 2, 3),
summary AS (
  SELECT t.subject_id, t.night, s.stage, s.name, coalesce(c.n, 0)::BIGINT AS epochs,
         100.0 * coalesce(c.n, 0) / t.total AS pct, coalesce(c.n, 0) * 0.5 AS minutes
  FROM totals t CROSS JOIN stages s
  LEFT JOIN counts c ON c.subject_id = t.subject_id AND c.night = t.night AND c.pred = s.stage)"""

SQL["q_night_summary"] = f"""
WITH {STAGES}, {ORDERS}, {_SUMMARY}
SELECT subject_id, night, stage, name, epochs, round(pct::DOUBLE, 6) AS pct,
       round(minutes::DOUBLE, 6) AS minutes
FROM summary"""

_STATS = """
stats AS (
  SELECT subject_id, night, count(*) AS n_epochs,
         (count(*) FILTER (WHERE pred <> 0) * 0.5)::DOUBLE AS total_sleep_min,
         (count(*) * 0.5)::DOUBLE AS time_in_bed_min,
         100.0::DOUBLE * count(*) FILTER (WHERE pred <> 0) / count(*) AS sleep_efficiency_pct,
         (min(epoch_idx) FILTER (WHERE pred <> 0) * 0.5)::DOUBLE AS sleep_onset_min
  FROM night GROUP BY 1, 2)"""

SQL["q_sleep_stats"] = f"""
WITH {ORDERS}, {_STATS}
SELECT subject_id, night, n_epochs, round(total_sleep_min, 6) AS total_sleep_min,
       round(time_in_bed_min, 6) AS time_in_bed_min,
       round(sleep_efficiency_pct, 6) AS sleep_efficiency_pct,
       round(sleep_onset_min, 6) AS sleep_onset_min
FROM stats"""

SQL["q_summary_report"] = f"""
WITH {STAGES}, {ORDERS}, {_SUMMARY}
SELECT subject_id, night, name AS "Stage", epochs AS "Epochs", round_even(pct::DOUBLE, 1) AS "%",
       round_even(minutes::DOUBLE, 1) AS "Minutes"
FROM summary"""

SQL["q_summary_text"] = f"""
WITH {ORDERS}, {_STATS}
SELECT subject_id, night,
       n_epochs::VARCHAR || ' epochs, ' || printf('%.1f', round_even(n_epochs / 120.0::DOUBLE, 1)) || ' h'
         AS recording,
       round_even(total_sleep_min, 0)::BIGINT::VARCHAR || ' min' AS total_sleep,
       round_even(sleep_efficiency_pct, 0)::BIGINT::VARCHAR || '%' AS efficiency,
       coalesce(round_even(sleep_onset_min, 0)::BIGINT::VARCHAR || ' min', '—') AS sleep_onset,
       'sample: ' || subject_id || ' night ' || night AS source
FROM stats"""

def _fixed(value: str, places: int) -> str:
    return (
        f"CASE WHEN {value} IS NULL OR isnan({value}) THEN '—' "
        f"ELSE printf('%.{places}f', round_even(round({value}::DOUBLE, 9), {places})) END"
    )


SQL["q_metrics_text"] = f"""
WITH {STAGES}, {ORDERS}, even AS (SELECT * FROM p WHERE subject_id % 2 = 0), {_metrics('even', 'subject_id')},
lines AS (SELECT g, string_agg(name || ' ' || {_fixed('f1', 2)}, ' · ' ORDER BY stage) AS line
  FROM scores GROUP BY g)
SELECT s.subject_id,
       coalesce('accuracy ' || {_fixed('accuracy * 100', 1)} || '%, macro-F1 ' || {_fixed('macro_f1', 3)}
         || ', kappa ' || {_fixed('cohen_kappa', 3)} || ' over ' || n_epochs || ' scored epochs; F1 by stage: '
         || line, 'no expert scoring to compare with') AS metrics
FROM (SELECT DISTINCT subject_id FROM p) s LEFT JOIN head ON head.g = s.subject_id
LEFT JOIN lines ON lines.g = s.subject_id"""

SQL["q_listing_manifest"] = """
WITH listed AS (
  SELECT c_custkey AS page, 'SC4' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || '1' AS stem,
         chr((65 + c_custkey % 7)::INTEGER) AS mark FROM customer),
first AS (SELECT stem, mark, min(page) AS page FROM listed GROUP BY 1, 2)
SELECT 'SC' || substr(stem, 4, 2) AS subject_id, 1 AS night,
       '/raw/' || stem || arg_max(mark, page) || '0-PSG.edf' AS psg_path,
       '/raw/' || stem || 'EC-Hypnogram.edf' AS hypnogram_path
FROM first GROUP BY stem"""

SQL["q_hypnogram"] = f"""
WITH {STAGES}, {ORDERS}
SELECT n.subject_id, n.night, n.epoch_idx, round(n.epoch_idx * 30.0 / 3600.0, 6)::DOUBLE AS hours,
       t.ypos AS true_y, q.ypos AS pred_y
FROM night n
LEFT JOIN stages t ON t.stage = n.stage AND n.epoch_idx % 7 <> 6
LEFT JOIN stages q ON q.stage = n.pred"""

SQL["q_first_night"] = f"""
WITH {ORDERS}
SELECT subject_id, night, epoch_idx, stage, pred FROM night
WHERE subject_id = (SELECT min(subject_id) FROM night)"""

SQL["q_export"] = f"""
WITH {STAGES}, {ORDERS}
SELECT n.subject_id, n.night, n.epoch_idx, n.epoch_idx * 30 AS start_sec, q.name AS pred_stage,
       coalesce(t.name, 'unscored') AS expert_stage
FROM night n
LEFT JOIN stages t ON t.stage = n.stage AND n.epoch_idx % 7 <> 6
LEFT JOIN stages q ON q.stage = n.pred"""

SQL["q_export_files"] = f"""
WITH {STAGES}, {CHANCES}
SELECT c.subject_id, c.night, c.epoch_idx, c.epoch_idx * 30 AS start_sec, q.name AS pred_stage,
       t.name AS expert_stage
FROM chances c JOIN stages t ON t.stage = c.stage JOIN stages q ON q.stage = c.pred"""

# --- epoch store -------------------------------------------------------------------------------------------

SQL["q_epoch_store"] = f"""
WITH {STAGES}, {VECTORS},
totals AS (SELECT subject_id, count(*) AS total FROM vec GROUP BY 1),
counts AS (SELECT subject_id, stage, count(*) AS n FROM vec GROUP BY 1, 2)
SELECT t.subject_id, s.stage, s.name, coalesce(c.n, 0)::BIGINT AS n,
       round((100.0 * coalesce(c.n, 0) / t.total)::DOUBLE, 6) AS pct
FROM totals t CROSS JOIN stages s
LEFT JOIN counts c ON c.subject_id = t.subject_id AND c.stage = s.stage"""

SQL["q_sample"] = f"""
WITH {VECTORS}
SELECT subject_id, night, epoch_idx, stage,
       list_transform(signal, lambda x: round(x, 6) + 0.0) AS signal
FROM vec WHERE subject_id = 'SC08' AND night = 1"""

SQL["q_sample_meta"] = f"""
WITH {SPLIT}
SELECT v.subject_id, v.night, count(*) AS n_epochs, s.split, s.split <> 'test' AS not_test
FROM vec v JOIN split s ON s.subject_id = v.subject_id
WHERE v.subject_id = 'SC08' AND v.night = 1 GROUP BY 1, 2, 4"""

# --- files -------------------------------------------------------------------------------------------------------

SQL["q_file_headers"] = """
WITH f AS (SELECT vec_id // 50 AS file_no, count(*) AS n FROM embeddings GROUP BY 1)
SELECT file_no, 'EEG Fpz-Cz' AS channel, 100.0::DOUBLE AS sfreq, n * 64 AS n_samples FROM f
UNION ALL SELECT file_no, 'EOG horizontal', 50.0::DOUBLE, n * 32 FROM f"""

SQL["q_file_checks"] = """
SELECT DISTINCT vec_id // 50 AS file_no, 50 AS sample_rate, 100 AS expected,
       'EEG Fpz-Cz,EOG horizontal' AS available
FROM embeddings"""

# 16-bit samples of the range [-1, 1]
_DIGITAL = """
digital AS (
  SELECT vec_id // 50 AS file_no, (vec_id % 50) * 64 + i - 1 AS sample,
         round_even((greatest(-1.0, least(1.0, x)) + 1.0) * 32767.5, 0) * (2.0::DOUBLE / 65535) - 1.0
           AS value
  FROM (SELECT vec_id, unnest(generate_series(1, 64)) AS i, unnest(embedding::DOUBLE[]) AS x
        FROM embeddings))"""

SQL["q_file_signal"] = f"""
WITH {_DIGITAL} SELECT file_no, sample, round(value, 6) + 0.0 AS value FROM digital"""

SQL["q_file_stretch"] = f"""
WITH {_DIGITAL}
SELECT file_no, count(*) AS n_samples, round(min(value), 6) + 0.0 AS low, round(max(value), 6) + 0.0 AS high
FROM digital WHERE sample // 64 * 64 >= 500 AND sample // 64 * 64 < 2000 GROUP BY 1"""

SQL["q_file_stats"] = f"""
WITH {_DIGITAL}
SELECT file_no, count(*) AS n_samples, round(avg(value), 6) + 0.0 AS mean,
       round(stddev_pop(value), 6) AS std
FROM digital GROUP BY 1"""

SQL["q_file_annotations"] = f"""
WITH {TEXTS}
SELECT event_id // 100 AS file_no, ((event_id % 100) * 30)::DOUBLE AS onset,
       round(value, 6) AS duration, description
FROM texts"""

SQL["q_file_epochs"] = f"""
WITH {_DIGITAL},
stats AS (
  SELECT file_no, avg(value) AS mu, stddev_pop(value) AS sd, count(*) AS n FROM digital GROUP BY 1),
plan AS (
  SELECT e.vec_id // 50 AS file_no, e.vec_id % 50 AS k, e.label % 5 AS stage,
         row_number() OVER (PARTITION BY e.vec_id // 50 ORDER BY e.vec_id) - 1 AS plan_idx
  FROM embeddings e JOIN stats s ON s.file_no = e.vec_id // 50
  WHERE (e.vec_id % 50) * 100 + 100 <= s.n),
bounds AS (
  SELECT file_no, min(plan_idx) FILTER (WHERE stage <> 0) - 2 AS lo,
         max(plan_idx) FILTER (WHERE stage <> 0) + 2 AS hi
  FROM plan GROUP BY 1),
kept AS (
  SELECT p.*, p.plan_idx - greatest(coalesce(b.lo, 0), 0) AS epoch_idx
  FROM plan p JOIN bounds b USING (file_no)
  WHERE b.lo IS NULL OR p.plan_idx BETWEEN b.lo AND b.hi),
z AS (
  SELECT k.file_no, k.epoch_idx, k.stage, d.sample, (d.value - s.mu) / (s.sd + 1e-8) AS x
  FROM kept k JOIN digital d ON d.file_no = k.file_no AND d.sample // 100 = k.k
  JOIN stats s ON s.file_no = k.file_no),
d1 AS (
  SELECT *, x - lag(x) OVER (PARTITION BY file_no, epoch_idx ORDER BY sample) AS dx FROM z),
d2 AS (
  SELECT *, dx - lag(dx) OVER (PARTITION BY file_no, epoch_idx ORDER BY sample) AS ddx FROM d1),
spread AS (
  SELECT file_no, epoch_idx, stage, var_pop(x) AS vx, var_pop(dx) AS vd, var_pop(ddx) AS vdd,
         sqrt(avg(x * x)) AS rms
  FROM d2 GROUP BY 1, 2, 3)
SELECT 'SC' || file_no AS subject_id, 1 AS night, epoch_idx::INTEGER AS epoch_idx, stage,
       round(vx::FLOAT::DOUBLE, 6) AS feat_hjorth_activity,
       round(sqrt(vd / vx)::FLOAT::DOUBLE, 6) AS feat_hjorth_mobility,
       round((sqrt(vdd / vd) / sqrt(vd / vx))::FLOAT::DOUBLE, 6) AS feat_hjorth_complexity,
       round(rms::FLOAT::DOUBLE, 6) AS feat_rms
FROM spread"""

# --- fitted models: what holds whatever was fitted ------------------------------------------------------

_FACTS = f"""
WITH {SPLIT}
SELECT subject_id, night, epoch_idx, stage, 5 AS n_proba, true AS whole, true AS pred_is_argmax, true AS same
FROM vec WHERE subject_id IN (SELECT subject_id FROM split WHERE split = 'test')"""

SQL["q_train_score"] = _FACTS
SQL["q_raw_signal_score"] = _FACTS

SQL["q_tree_parity"] = f"""
WITH {SPLIT}
SELECT count(*) AS n_epochs, 0::BIGINT AS label_diffs, true AS close
FROM vec WHERE subject_id IN (SELECT subject_id FROM split WHERE split = 'test')"""

SQL["q_resample"] = f"""
WITH {VECTORS}, {_WEIGHTS}
SELECT subject_id, night, epoch_idx, stage FROM vec JOIN weights USING (stage)
WHERE ('0x' || substr(md5('42:' || subject_id || ':' || night || ':' || epoch_idx), 1, 8))::UBIGINT / 4294967296.0 < relative"""

SQL["q_stage_recordings"] = f"""
WITH {STAGES}, {_DIGITAL},
stats AS (SELECT file_no, avg(value) AS mu, count(*) AS n FROM digital GROUP BY 1),
ruled AS (
  SELECT d.file_no, d.sample // 100 AS epoch_idx,
         (count(*) FILTER (WHERE d.value > s.mu AND d.sample % 100 < 4))::INTEGER AS pred
  FROM digital d JOIN stats s USING (file_no)
  WHERE d.sample // 100 < s.n // 100 GROUP BY 1, 2),
staged AS (
  SELECT r.*, e.label % 5 AS expert
  FROM ruled r JOIN embeddings e ON e.vec_id = r.file_no * 50 + r.epoch_idx),
{_metrics('staged', 'file_no', 'expert')},
nights AS (
  SELECT file_no, count(*) AS n, count(*) FILTER (WHERE pred <> 0) AS asleep,
         min(epoch_idx) FILTER (WHERE pred <> 0) AS onset
  FROM staged GROUP BY 1)
SELECT file_no, n AS n_epochs, n_epochs AS n_scored_epochs, round(asleep / 60.0::DOUBLE, 6) AS total_sleep_min,
       round(n / 60.0::DOUBLE, 6) AS time_in_bed_min, round(100.0::DOUBLE * asleep / n, 6) AS sleep_efficiency_pct,
       round(onset / 60.0::DOUBLE, 6) AS sleep_onset_min, round(accuracy::DOUBLE, 6) AS accuracy,
       round(macro_f1::DOUBLE, 6) AS macro_f1, round(cohen_kappa, 6) + 0.0 AS cohen_kappa
FROM nights JOIN head ON g = file_no"""

# --- files that cannot be used, and stores built again --------------------------------------------------

SQL["q_file_rejects"] = """
SELECT DISTINCT vec_id // 50 AS file_no,
       CASE (vec_id // 50) % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'unreadable' WHEN 2 THEN 'truncated' END AS reason
FROM embeddings"""

SQL["q_build_again"] = """
WITH stats AS (SELECT vec_id // 50 AS file_no, count(*) * 64 AS n FROM embeddings GROUP BY 1),
plan AS (
  SELECT e.vec_id // 50 AS file_no, CASE WHEN e.vec_id // 50 = 0 THEN 4 ELSE e.label % 5 END AS stage,
         row_number() OVER (PARTITION BY e.vec_id // 50 ORDER BY e.vec_id) - 1 AS plan_idx
  FROM embeddings e JOIN stats s ON s.file_no = e.vec_id // 50
  WHERE (e.vec_id % 50) * 100 + 100 <= s.n),
bounds AS (
  SELECT file_no, min(plan_idx) FILTER (WHERE stage <> 0) - 2 AS lo,
         max(plan_idx) FILTER (WHERE stage <> 0) + 2 AS hi
  FROM plan GROUP BY 1)
SELECT 'SC' || file_no AS subject_id, stage::INTEGER AS stage, count(*) AS n
FROM plan JOIN bounds USING (file_no)
WHERE lo IS NULL OR plan_idx BETWEEN lo AND hi
GROUP BY 1, 2"""
