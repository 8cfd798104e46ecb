"""Plain SQL statements of what the registered queries must return.

They spell out the definitions directly (every epoch's samples as rows, moments
by built-in aggregates, spectra as explicit sums), so they share no shortcut
with the plans they check.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# --- shared pieces -----------------------------------------------------------------

VECTORS = """
vec AS (
  SELECT 'sub-' || lpad(CAST(label AS VARCHAR), 3, '0') AS SubjectID,
         'ep-' || vec_id AS EpochID, 'E0' AS Electrode,
         unnest(range(0, 64)) AS k, CAST(unnest(embedding) AS DOUBLE) AS x
  FROM embeddings)"""

LINES = """
samples AS (
  SELECT 'sub-' || l_suppkey AS SubjectID, l_returnflag || l_linestatus AS Electrode,
         row_number() OVER (PARTITION BY l_suppkey, l_returnflag, l_linestatus
           ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS j,
         l_extendedprice AS value
  FROM lineitem),
channels AS (SELECT SubjectID, Electrode, count(*) AS n FROM samples GROUP BY ALL),
recordings AS (SELECT SubjectID, {usable}(n) AS n_samples FROM channels GROUP BY ALL),
counts AS (
  SELECT SubjectID, CAST(greatest(ceil(
    ((n_samples - 1) / 64::DOUBLE - 0.5::DOUBLE) / {step}::DOUBLE), 0) AS BIGINT) AS n
  FROM recordings),
grid AS (
  SELECT SubjectID, i, CAST(trunc((CAST(i AS DOUBLE) * {step}::DOUBLE) * 64::DOUBLE) AS BIGINT)
    AS start
  FROM (SELECT SubjectID, unnest(range(0, n)) AS i FROM counts))"""

LONG = """
ep AS (
  SELECT g.SubjectID, 'ep-' || g.i AS EpochID, s.Electrode, s.j - g.start AS k, s.value
  FROM grid g JOIN samples s
    ON s.SubjectID = g.SubjectID AND s.j >= g.start AND s.j <= g.start + 32)"""

DETRENDED = """
vec AS (
  SELECT SubjectID, EpochID, Electrode, k, value - (b + m * k) AS x
  FROM (SELECT *,
          regr_slope(value, k) OVER (PARTITION BY SubjectID, EpochID, Electrode) AS m,
          regr_intercept(value, k) OVER (PARTITION BY SubjectID, EpochID, Electrode) AS b
        FROM ep))"""

MOMENTS = """
d1 AS (
  SELECT *, lead(x) OVER (PARTITION BY SubjectID, EpochID, Electrode ORDER BY k) - x AS dx
  FROM vec),
d2 AS (
  SELECT *, lead(dx) OVER (PARTITION BY SubjectID, EpochID, Electrode ORDER BY k) - dx AS ddx
  FROM d1),
stats AS (
  SELECT SubjectID, EpochID, Electrode, avg(x) AS Mean, stddev_pop(x) AS Std,
         var_pop(x) AS Variance, sqrt(avg(x * x)) AS RMS,
         sqrt(var_pop(dx) / var_pop(x)) AS HjorthMobility,
         sqrt(var_pop(ddx) / var_pop(dx)) / sqrt(var_pop(dx) / var_pop(x)) AS HjorthComplexity
  FROM d2 GROUP BY ALL)"""


def _spectrum(n: int, hop: int, segments: int, fmin: float, fmax: float, fs: int = 64) -> str:
    """psd(SubjectID, EpochID, Electrode, freq, p): the explicit transform of ``vec``."""
    return f"""
seg AS (SELECT unnest(range(0, {segments})) AS seg),
seen AS (
  SELECT SubjectID, EpochID, Electrode, seg, k - seg * {hop} AS jj,
         x - avg(x) OVER (PARTITION BY SubjectID, EpochID, Electrode, seg) AS x
  FROM vec JOIN seg ON k >= seg * {hop} AND k < seg * {hop} + {n}),
taper AS (
  SELECT jj, 0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * jj / {n}) AS w
  FROM (SELECT unnest(range(0, {n})) AS jj)),
bins AS (
  SELECT b, b * {fs}::DOUBLE / {n} AS freq FROM (SELECT unnest(range(0, {n // 2 + 1})) AS b)
  WHERE b * {fs}::DOUBLE / {n} BETWEEN {fmin} AND {fmax}),
waves AS (
  SELECT b, freq, jj, w * cos(2 * pi() * b * jj / {n}) AS c, w * sin(2 * pi() * b * jj / {n}) AS s
  FROM bins CROSS JOIN taper),
sums AS (
  SELECT SubjectID, EpochID, Electrode, seg, b, freq, sum(x * c) AS re, sum(x * s) AS im
  FROM seen JOIN waves USING (jj) GROUP BY ALL),
psd AS (
  SELECT SubjectID, EpochID, Electrode, freq,
         avg((re * re + im * im) * CASE WHEN b = 0 OR 2 * b = {n} THEN 1 ELSE 2 END
             / ({fs} * (SELECT sum(w * w) FROM taper))) AS p
  FROM sums GROUP BY ALL),
share AS (
  SELECT *, p / sum(p) OVER (PARTITION BY SubjectID, EpochID, Electrode) AS q FROM psd)"""


BANDS = """
bands(WaveBand, fmin, fmax) AS (
  VALUES ('Delta', 0.5, 4), ('Theta', 4, 8), ('Alpha', 8, 12), ('Beta', 12, 30))"""

EXTENDED = """
bands(WaveBand, fmin, fmax) AS (
  VALUES ('delta', 0.5, 4), ('theta', 4, 8), ('alpha', 8, 13), ('beta', 13, 30), ('gamma', 30, 100))
"""

POWER = """
power AS (
  SELECT SubjectID, EpochID, Electrode, WaveBand, avg(q) AS rel, avg(p) AS mean_p, sum(p) AS sum_p
  FROM share JOIN bands ON freq >= fmin AND freq < fmax GROUP BY ALL)"""

MIN = LINES.format(usable="min", step=0.3)
LINE_SPECTRUM = _spectrum(32, 32, 1, 0.5, 30)
LINE_FEATURES = [MIN, LONG, DETRENDED, MOMENTS, LINE_SPECTRUM, BANDS, POWER]


def _with(parts: list[str], select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


def r(sql: str, digits: int = 6) -> str:
    return f"round({sql}, {digits}) + 0.0"


def _cols(names: list[str], digits: int = 6) -> str:
    return ", ".join(f"{r(c, digits)} AS {c}" for c in names)


KEYS = "SubjectID, EpochID, Electrode"

# --- sources -----------------------------------------------------------------------

SUBJECTS = """
subjects AS (
  SELECT SubjectID, "Group" FROM (
    SELECT 'sub-' || s_suppkey AS SubjectID,
           CASE s_nationkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'F' ELSE 'X' END
             AS "Group"
    FROM supplier)
  WHERE "Group" IN ('A', 'C', 'F'))"""

ORACLE["participants_by_group"] = _with([SUBJECTS], 'SELECT SubjectID, "Group" FROM subjects')
ORACLE["subject_discovery"] = (
    "SELECT DISTINCT replace('sub-' || l_suppkey, 'sub-', '') AS subject FROM lineitem"
)
ORACLE["partitioned_roundtrip"] = ORACLE["bucketed_roundtrip"] = _with(
    [MIN, LONG, SUBJECTS],
    f"""SELECT SubjectID, count(DISTINCT (EpochID, Electrode)) AS n_rows,
    count(DISTINCT EpochID) AS n_epochs, {r("sum(value)", 2)} AS total
    FROM ep WHERE SubjectID IN (SELECT SubjectID FROM subjects) GROUP BY ALL""",
)

ORACLE["recordings_tree"] = _with(
    [MIN],
    f"""SELECT SubjectID || CASE WHEN lost THEN 'x' ELSE '' END AS SubjectID, CASE WHEN NOT lost THEN n END AS n_rows,
    CASE WHEN NOT lost THEN {r("total", 2)} END AS total, CASE WHEN lost THEN 'no file' END AS reason
    FROM (SELECT SubjectID, CAST(substr(SubjectID, 5) AS INT) % 10 = 3 AS lost, count(*) AS n, sum(value) AS total
      FROM samples GROUP BY ALL)""",
)

# --- epoching ----------------------------------------------------------------------

ORACLE["epoch_grid"] = _with([MIN], "SELECT SubjectID, i, start FROM grid")
ORACLE["epoch_samples"] = ORACLE["epoch_slices"] = _with([MIN, LONG], "SELECT * FROM ep")
ORACLE["epoch_detrend"] = ORACLE["epoch_detrend_long"] = _with(
    [MIN, LONG, DETRENDED], f"SELECT {KEYS}, k, CAST(round(x * 897600) AS BIGINT) AS detrended FROM vec"
)

EVENTS = """
notes AS (
  SELECT CAST(user_id AS VARCHAR) AS SubjectID,
         (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000::DOUBLE AS onset,
         3600::DOUBLE AS duration,
         CASE WHEN event_type = 'error' THEN 'BAD_boundary' ELSE event_type END AS description
  FROM events),
days AS (
  SELECT SubjectID, i, i * 28800 AS start
  FROM (SELECT SubjectID, unnest(range(0, CAST(greatest(ceil(
          (ceil(max(onset + duration)) - 86400) / 28800::DOUBLE), 0) AS BIGINT))) AS i
        FROM notes GROUP BY SubjectID)),
kept AS (
  SELECT * FROM days d WHERE NOT EXISTS (
    SELECT 1 FROM notes a WHERE a.SubjectID = d.SubjectID AND a.description = 'BAD_boundary'
      AND a.onset < d.start + 86400 AND a.onset + a.duration > d.start))"""
ORACLE["boundary_relabel"] = _with([EVENTS], "SELECT * FROM notes")
ORACLE["epoch_reject"] = _with([EVENTS], "SELECT * FROM kept")
ORACLE["epoch_ids"] = _with(
    [EVENTS],
    """SELECT *, 'ep-' || (row_number() OVER (PARTITION BY SubjectID ORDER BY start) - 1)
    AS EpochID FROM kept""",
)
ORACLE["epoch_pack"] = _with(
    [MIN, LONG],
    f"""SELECT SubjectID, EpochID, string_agg(DISTINCT Electrode, ',' ORDER BY Electrode) AS channels,
    count(DISTINCT Electrode) AS n_channels, count(*) AS n_values,
    {r("sum(value * place)", 2)} AS checksum
    FROM (SELECT *, row_number() OVER (PARTITION BY SubjectID, EpochID ORDER BY Electrode, k)
      AS place FROM ep) GROUP BY SubjectID, EpochID""",
)
ORACLE["epoch_unpack"] = ORACLE["epoch_samples"]
ORACLE["epoch_trim_uneven"] = _with(
    [MIN],
    f"""SELECT SubjectID, Electrode, count(*) AS n_kept, max(j) AS last_j,
    {r("sum(value)", 2)} AS total
    FROM samples JOIN recordings USING (SubjectID) WHERE j < n_samples GROUP BY ALL""",
)
META = """
meta AS (
  SELECT SubjectID, string_agg(Electrode, ',' ORDER BY Electrode) AS ChannelNames,
         64::DOUBLE AS SFreq, any_value(c.n) AS NumEpochs
  FROM channels JOIN counts c USING (SubjectID) GROUP BY SubjectID)"""
ORACLE["recording_metadata"] = _with([MIN, META], "SELECT * FROM meta")
ORACLE["epochs_with_metadata"] = _with(
    [MIN, LONG, META],
    f"""SELECT {KEYS}, any_value(ChannelNames) AS ChannelNames, any_value(SFreq) AS SFreq,
    count(*) AS n_times FROM ep LEFT JOIN meta USING (SubjectID) GROUP BY {KEYS}""",
)
ORACLE["epochs_union"] = _with(
    [MIN, LONG, VECTORS],
    """SELECT SubjectID, count(DISTINCT (EpochID, Electrode)) AS n_channel_epochs,
    count(DISTINCT EpochID) AS n_epochs, count(*) AS n_values
    FROM (SELECT SubjectID, EpochID, Electrode FROM ep
          UNION ALL SELECT SubjectID, EpochID, Electrode FROM vec) GROUP BY ALL""",
)
ORACLE["epoch_errors"] = _with(
    [LINES.format(usable="max", step=0.3), LONG],
    """SELECT SubjectID, EpochID, Electrode, 'incomplete' AS reason FROM (
      SELECT g.SubjectID, 'ep-' || g.i AS EpochID, c.Electrode
      FROM grid g JOIN channels c USING (SubjectID))
    LEFT JOIN (SELECT SubjectID, EpochID, Electrode, count(*) AS n FROM ep GROUP BY ALL)
      USING (SubjectID, EpochID, Electrode)
    WHERE coalesce(n, 0) < 33""",
)

# --- spectra -----------------------------------------------------------------------

LINE_PSD = [MIN, LONG, DETRENDED, LINE_SPECTRUM]
ORACLE["welch_psd"] = _with(LINE_PSD, f"SELECT {KEYS}, freq, {r('p', 0)} AS psd FROM psd")
ORACLE["welch_psd_overlap"] = _with(
    [MIN, LONG, DETRENDED, _spectrum(16, 8, 3, 0.5, 30)],
    f"SELECT {KEYS}, freq, {r('p', 0)} AS psd FROM psd",
)
ORACLE["psd_no_reject"] = _with(
    LINE_PSD, f"SELECT {KEYS}, {r('sum(p)', 0)} AS power FROM psd GROUP BY ALL"
)
ORACLE["psd_normalised"] = _with(LINE_PSD, f"SELECT {KEYS}, freq, {r('q')} AS psd FROM share")
ORACLE["band_power_relative"] = _with(
    [*LINE_PSD, BANDS, POWER], f"SELECT {KEYS}, WaveBand, {r('rel')} AS Power FROM power"
)
ORACLE["band_power_absolute"] = _with(
    [*LINE_PSD, BANDS, POWER], f"SELECT {KEYS}, WaveBand, {r('mean_p', 0)} AS Power FROM power"
)
SUMMARY = f"""SELECT {KEYS}, {r("avg(q)")} AS TotalPower, {r("sum(q * q)")} AS TotalEnergy,
  {r("-sum(q * log2(q + 1e-12))")} AS SpectralEntropy FROM share GROUP BY ALL"""
ORACLE["spectral_summary"] = _with(LINE_PSD, SUMMARY)
ORACLE["band_entropy"] = _with(
    [*LINE_PSD, BANDS],
    f"""SELECT {KEYS}, WaveBand, {r("-sum(q * log2(q + 1e-12))")} AS SpectralEntropy
    FROM (SELECT *, p / sum(p) OVER (PARTITION BY {KEYS}, WaveBand) AS q
      FROM (SELECT {KEYS}, freq, p FROM psd) JOIN bands ON freq >= fmin AND freq < fmax)
    GROUP BY ALL""",
)
VECTOR_SPECTRUM = _spectrum(64, 64, 1, 0.5, 30)
ORACLE["spectral_summary_vectors"] = _with([VECTORS, VECTOR_SPECTRUM], SUMMARY)

# --- time domain -------------------------------------------------------------------

BASIC = ["Mean", "Std", "Variance", "RMS"]
HJORTH = f"""SELECT {KEYS}, {_cols(["HjorthMobility", "HjorthComplexity"])},
  {r("2 * HjorthComplexity + 100 / (2 * HjorthMobility)")} AS HjorthIndex FROM stats"""
LINE_STATS = [MIN, LONG, DETRENDED, MOMENTS]
ORACLE["time_stats"] = ORACLE["epoch_udf"] = _with(
    [VECTORS, MOMENTS], f"SELECT {KEYS}, {_cols(BASIC)} FROM stats"
)
ORACLE["time_stats_recordings"] = _with(
    LINE_STATS,
    f"""SELECT {KEYS}, {_cols(["Mean", "Std", "RMS"], 3)}, {r("Variance", 0)} AS Variance
    FROM stats""",
)
ORACLE["hjorth"] = _with([VECTORS, MOMENTS], HJORTH)
ORACLE["hjorth_recordings"] = _with(LINE_STATS, HJORTH)
ORACLE["shape_stats"] = _with(
    [VECTORS],
    f"""SELECT {KEYS}, {r("avg((x - mu) ** 3) / sqrt(var_pop(x)) ** 3")} AS Skewness,
    {r("avg((x - mu) ** 4) / var_pop(x) ** 2 - 3")} AS Kurtosis
    FROM (SELECT *, avg(x) OVER (PARTITION BY SubjectID, EpochID, Electrode) AS mu FROM vec)
    GROUP BY {KEYS}""",
)
DIMENSIONS = f"""
sizes AS (SELECT {KEYS}, count(*) AS n FROM vec GROUP BY ALL),
curves AS (
  SELECT {KEYS}, step, a.k % step AS m, sum(abs(b.x - a.x)) AS total, count(*) AS steps
  FROM vec a CROSS JOIN (SELECT unnest(range(1, 11)) AS step) JOIN vec b USING ({KEYS})
  WHERE b.k = a.k + step GROUP BY ALL),
lengths AS (
  SELECT {KEYS}, step, sum(total * (n - 1) / (steps * step) / step) / step AS l
  FROM curves JOIN sizes USING ({KEYS}) GROUP BY {KEYS}, step),
higuchi AS (SELECT {KEYS}, regr_slope(ln(l), -ln(step)) AS HiguchiFD FROM lengths GROUP BY ALL),
katz AS (
  SELECT {KEYS}, log10(n - 1) / (log10(n - 1) + log10(far / total)) AS KatzFD FROM (
    SELECT {KEYS}, max(abs(v.x - f.x)) AS far FROM vec v
    JOIN (SELECT {KEYS}, x FROM vec WHERE k = 0) f USING ({KEYS}) GROUP BY ALL)
  JOIN (SELECT {KEYS}, sum(total) AS total FROM curves WHERE step = 1 GROUP BY ALL) USING ({KEYS})
  JOIN sizes USING ({KEYS}))"""
FRACTAL = f"SELECT {KEYS}, {_cols(['HiguchiFD', 'KatzFD'])} FROM higuchi JOIN katz USING ({KEYS})"
ORACLE["fractal_dimensions"] = _with([VECTORS, DIMENSIONS], FRACTAL)
ORACLE["fractal_dimensions_recordings"] = _with([MIN, LONG, DETRENDED, DIMENSIONS], FRACTAL)
ALIKE = f"""
stretches AS (
  SELECT {KEYS}, k, x AS x0, lead(x, 1) OVER w AS x1, lead(x, 2) OVER w AS x2,
         0.2 * stddev_samp(x) OVER (PARTITION BY {KEYS}) AS r, count(*) OVER (PARTITION BY {KEYS}) AS n
  FROM vec WINDOW w AS (PARTITION BY {KEYS} ORDER BY k)),
alike AS (
  SELECT {KEYS}, a.k, a.n, count(*) AS short,
         count(*) FILTER (a.x2 IS NOT NULL AND b.x2 IS NOT NULL) AS inner_short,
         count(*) FILTER (abs(a.x2 - b.x2) <= a.r) AS long
  FROM stretches a JOIN stretches b USING ({KEYS})
  WHERE abs(a.x0 - b.x0) <= a.r AND abs(a.x1 - b.x1) <= a.r GROUP BY ALL),
entropy AS (
  SELECT {KEYS},
         -ln(nullif(sum(long) FILTER (k < n - 2) - (any_value(n) - 2), 0)
             / (sum(inner_short) FILTER (k < n - 2) - (any_value(n) - 2))) AS SampleEntropy,
         avg(ln(short / (n - 1))) - avg(ln(long / (n - 2))) FILTER (k < n - 2) AS ApproximateEntropy
  FROM alike GROUP BY {KEYS})"""
ENTROPIES = f"SELECT {KEYS}, {_cols(['SampleEntropy', 'ApproximateEntropy'])} FROM entropy"
ORACLE["entropies"] = _with([VECTORS, ALIKE], ENTROPIES)
ORACLE["entropies_recordings"] = _with([MIN, LONG, DETRENDED, ALIKE], ENTROPIES)
LEVEL = {"Mean": 3, "Std": 3, "Variance": 0, "RMS": 3, "HjorthMobility": 6}
ORACLE["epoch_level_features"] = _with(
    [
        *LINE_STATS,
        f"""means AS (SELECT SubjectID, EpochID, {", ".join(f"avg({c}) AS {c}" for c in LEVEL)}
        FROM stats GROUP BY ALL)""",
    ],
    "\nUNION ALL ".join(
        f"""SELECT SubjectID, EpochID, CAST(NULL AS VARCHAR) AS Electrode,
        CAST(NULL AS VARCHAR) AS WaveBand, '{c}' AS FeatureName, {r(c, digits)} AS FeatureValue,
        'epoch' AS table_type FROM means"""
        for c, digits in LEVEL.items()
    ),
)

# --- feature tables ----------------------------------------------------------------

ELECTRODE = {"Mean": 3, "Std": 3, "RMS": 3, "HjorthMobility": 6, "HjorthComplexity": 6}


def _long_rows(table_type: str, digits: dict[str, int]) -> str:
    rows = [
        f"""SELECT {KEYS}, CAST(NULL AS VARCHAR) AS WaveBand, '{f}' AS FeatureName,
        {r(f, d)} AS FeatureValue, '{table_type}' AS table_type FROM stats"""
        for f, d in digits.items()
    ]
    rows += [
        f"""SELECT {KEYS}, WaveBand, '{f}', {r(f)}, 'band' FROM stats CROSS JOIN bands"""
        for f in ("HjorthMobility", "HjorthComplexity")
    ]
    rows.append(f"SELECT {KEYS}, WaveBand, 'Power', {r('rel')}, 'band' FROM power")
    return "\nUNION ALL ".join(rows)


LONG_ROWS = _long_rows("band", ELECTRODE)
ORACLE["features_long"] = _with(LINE_FEATURES, LONG_ROWS)
LINE_NOTES = """
notes AS (
  SELECT 'sub-' || s_suppkey AS SubjectID, abs(s_acctbal) / 10000::DOUBLE AS onset,
         0.25::DOUBLE AS duration, s_nationkey < 18 AS bad
  FROM supplier),
numbered AS (
  SELECT SubjectID, start, 'ep-' || (row_number() OVER (PARTITION BY SubjectID ORDER BY i) - 1)
    AS EpochID
  FROM grid g WHERE NOT EXISTS (
    SELECT 1 FROM notes a WHERE a.SubjectID = g.SubjectID AND a.bad
      AND a.onset < (g.start + 32) / 64::DOUBLE AND a.onset + a.duration > g.start / 64::DOUBLE)),
ep AS (
  SELECT g.SubjectID, g.EpochID, s.Electrode, s.j - g.start AS k, s.value
  FROM numbered g JOIN samples s
    ON s.SubjectID = g.SubjectID AND s.j >= g.start AND s.j <= g.start + 32)"""
ORACLE["features_long_rejected"] = _with(
    [MIN, LINE_NOTES, DETRENDED, MOMENTS, LINE_SPECTRUM, BANDS, POWER],
    _long_rows("electrode", ELECTRODE),
)
DENSE = LINES.format(usable="min", step=0.05)
ORACLE["features_long_dense"] = _with([DENSE, *LINE_FEATURES[1:]], LONG_ROWS)
ORACLE["routes_compared"] = _with(
    [DENSE, *LINE_FEATURES[1:]],
    f"""SELECT FeatureName, WaveBand, 'equal' AS class, count(*) AS n_rows FROM ({LONG_ROWS}) GROUP BY ALL""",
)
ORACLE["features_long_dense_rejected"] = _with(
    [DENSE, LINE_NOTES, DETRENDED, MOMENTS, LINE_SPECTRUM, BANDS, POWER], LONG_ROWS
)
SUMMED = """
summed AS (
  SELECT SubjectID, Electrode, j, sum(CAST(round(value * 100) AS BIGINT)) OVER (
    PARTITION BY SubjectID, Electrode ORDER BY j) / 100::DOUBLE AS value FROM samples)"""
ORACLE["features_long_drift"] = _with(
    [
        DENSE, SUMMED, LONG.replace("JOIN samples", "JOIN summed"), DETRENDED, MOMENTS,
        _spectrum(16, 16, 2, 0.5, 30), BANDS, POWER,
    ],
    # No bin lies in the lowest band: its power is null.
    LONG_ROWS.replace("FROM power", f"FROM stats CROSS JOIN bands LEFT JOIN power USING ({KEYS}, WaveBand)"),
)
ORACLE["features_long_vectors"] = _with(
    [VECTORS, MOMENTS, VECTOR_SPECTRUM, BANDS, POWER],
    _long_rows("band", dict.fromkeys(ELECTRODE, 6)),
)
ORACLE["features_subject"] = _with(
    [*LINE_FEATURES, SUBJECTS],
    f"SELECT * FROM ({LONG_ROWS}) WHERE SubjectID IN (SELECT SubjectID FROM subjects)",
)
UNEVEN = """
vec AS (
  SELECT SubjectID, EpochID, Electrode, k, x, n, n AS len FROM (
    SELECT SubjectID, EpochID, c.Electrode, k,
           CASE c.Electrode WHEN 'E0' THEN x ELSE y END AS x, n
    FROM (
      SELECT 'sub-' || lpad(CAST(label AS VARCHAR), 3, '0') AS SubjectID, 'ep-' || vec_id AS EpochID,
             unnest(range(0, 64)) AS k, CAST(unnest(embedding) AS DOUBLE) AS x,
             CAST(unnest(list_reverse(embedding)) AS DOUBLE) AS y, 30 + vec_id % 35 AS n
      FROM embeddings)
    CROSS JOIN (VALUES ('E0'), ('E1')) c(Electrode)
    WHERE k < n))"""
UNEVEN_SPECTRUM = """
seen AS (
  SELECT SubjectID, EpochID, Electrode, n, k // n AS seg, k % n AS jj,
         x - avg(x) OVER (PARTITION BY SubjectID, EpochID, Electrode, k // n) AS x
  FROM vec WHERE (k // n + 1) * n <= len),
sizes AS (SELECT DISTINCT n FROM vec),
taper AS (
  SELECT n, jj, 0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * jj / n) AS w
  FROM sizes CROSS JOIN (SELECT unnest(range(0, 64)) AS jj) WHERE jj < n),
energy AS (SELECT n, sum(w * w) AS e FROM taper GROUP BY n),
waves AS (
  SELECT n, b, b * 64::DOUBLE / n AS freq, jj, w * cos(2 * pi() * b * jj / n) AS c,
         w * sin(2 * pi() * b * jj / n) AS s
  FROM taper CROSS JOIN (SELECT unnest(range(0, 33)) AS b)
  WHERE 2 * b <= n AND b * 64::DOUBLE / n BETWEEN 0.5 AND 30),
sums AS (
  SELECT SubjectID, EpochID, Electrode, n, seg, b, freq, sum(x * c) AS re, sum(x * s) AS im
  FROM seen JOIN waves USING (n, jj) GROUP BY ALL),
psd AS (
  SELECT SubjectID, EpochID, Electrode, freq,
         avg((re * re + im * im) * CASE WHEN b = 0 OR 2 * b = n THEN 1 ELSE 2 END / (64 * e)) AS p
  FROM sums JOIN energy USING (n) GROUP BY ALL),
share AS (
  SELECT *, p / sum(p) OVER (PARTITION BY SubjectID, EpochID, Electrode) AS q FROM psd)"""
ORACLE["features_long_uneven"] = _with(
    [UNEVEN, MOMENTS, UNEVEN_SPECTRUM, BANDS, POWER], _long_rows("band", dict.fromkeys(ELECTRODE, 6))
)
ORACLE["epoch_trim_packed"] = _with(
    [UNEVEN], f"SELECT {KEYS}, count(*) AS n_times, {r('sum(x)')} AS total FROM vec GROUP BY ALL"
)
ORACLE["features_long_gaps"] = _with(
    [
        MIN,
        LONG.replace("ep AS (", "cut AS (") + """,
ep AS (
  SELECT * FROM (
    SELECT *, count(*) OVER (PARTITION BY SubjectID, EpochID, Electrode) AS n FROM (
      SELECT s.* FROM cut s JOIN (SELECT SubjectID, 'ep-' || i AS EpochID, start FROM grid) g
        USING (SubjectID, EpochID) WHERE (s.k + g.start) % 60 NOT BETWEEN 40 AND 41))
  WHERE n = 33)""",
        *LINE_FEATURES[2:],
    ],
    LONG_ROWS,
)
_COUNTS = "count(*) AS n_rows, count(DISTINCT SubjectID) AS n_subjects"
ORACLE["job_outcomes"] = _with(
    [
        LINES.format(usable="max", step=0.3), LINE_NOTES, f"""
expected AS (SELECT g.SubjectID, g.EpochID, c.Electrode FROM numbered g JOIN channels c USING (SubjectID)),
sizes AS (SELECT {KEYS}, count(*) AS n FROM ep GROUP BY ALL),
state AS (SELECT {KEYS}, coalesce(n, 0) = 33 AS whole FROM expected LEFT JOIN sizes USING ({KEYS})),
names(FeatureName, times) AS (
  VALUES ('Mean', 1), ('Std', 1), ('RMS', 1), ('HjorthMobility', 5), ('HjorthComplexity', 5), ('Power', 4))""",
    ],
    f"""SELECT 'features' AS outcome, FeatureName, NULL AS reason, {_COUNTS}, count(*) AS n_values, 0 AS n_epochs
    FROM state, names, range(times) WHERE whole GROUP BY FeatureName
    UNION ALL SELECT 'rejected_epochs', NULL, 'incomplete', {_COUNTS}, 0, 0 FROM state WHERE NOT whole HAVING count(*) > 0
    UNION ALL SELECT 'metadata', NULL, NULL, count(*), count(*), 0, (SELECT count(*) FROM numbered)
    FROM (SELECT DISTINCT SubjectID FROM channels)
    UNION ALL SELECT 'rejected_subjects', NULL, 'no epochs', {_COUNTS}, 0, 0 FROM recordings
    WHERE SubjectID NOT IN (SELECT SubjectID FROM numbered) HAVING count(*) > 0""",
)
ORACLE["rejected_signals"] = """
SELECT 'sub-' || lpad(CAST(label AS VARCHAR), 3, '0') AS SubjectID, 'ep-' || vec_id AS EpochID, Electrode,
  CASE WHEN vec_id % 7 <> 2 THEN 'missing sample' WHEN vec_id % 4 = 0 THEN 'no sample' ELSE 'too short' END AS reason
FROM embeddings CROSS JOIN (VALUES ('E0'), ('E1')) c(Electrode)
WHERE vec_id % 7 = 2 AND vec_id % 4 < 3 OR vec_id % 7 <> 2 AND vec_id % 3 = 0"""
ORACLE["duplicate_subjects"] = _with([SUBJECTS], "SELECT SubjectID, 2 AS n_rows FROM subjects")
ORACLE["rejected_subjects"] = _with(
    [MIN],
    """SELECT SubjectID, 'no epochs' AS reason FROM recordings
    WHERE (n_samples - 1) / 64::DOUBLE - 1.5 <= 0""",
)
ORACLE["spectral_quality"] = _with(
    LINE_PSD,
    f"""SELECT {KEYS}, count(*) AS n_bins, count(*) FILTER (isnan(p) OR p IS NULL) AS n_undefined,
    {r("min(p)", 0)} AS min_psd, {r("max(p)", 0)} AS max_psd, {r("sum(p)", 0)} AS total_psd,
    CAST(arg_max(freq, p) / 2 AS BIGINT) AS peak_bin FROM psd GROUP BY ALL""",
)
CHANNELS = ["AF", "AO", "NF", "NO", "RF", "RO"]


def _wide(digits: dict[str, int], bands: list[str]) -> str:
    cells = [
        f"""{r(f"max(CASE WHEN Electrode = '{ch}' THEN {f} END)", d)} AS "{f}_{ch}" """
        for f, d in digits.items()
        for ch in CHANNELS
    ]
    cells += [
        f"""{r(f"max(CASE WHEN Electrode = '{ch}' THEN p_{b} END)", 0)} AS "Power_{ch}_{b}" """
        for ch in CHANNELS
        for b in bands
    ]
    per_band = ", ".join(f"max(CASE WHEN WaveBand = '{b}' THEN sum_p END) AS p_{b}" for b in bands)
    return f"""SELECT SubjectID, EpochID, {", ".join(cells)}
    FROM stats LEFT JOIN (SELECT {KEYS}, {per_band} FROM power GROUP BY ALL)
      USING ({KEYS}) GROUP BY SubjectID, EpochID"""


ORACLE["features_wide"] = _with(LINE_FEATURES, _wide(ELECTRODE, ["Delta", "Theta", "Alpha", "Beta"]))
SHAPED = """
stats AS (
  SELECT SubjectID, EpochID, Electrode, avg(x) AS Mean, stddev_pop(x) AS Std,
         avg(x ** 3) / sqrt(var_pop(x)) ** 3 AS Skewness,
         avg(x ** 4) / var_pop(x) ** 2 - 3 AS Kurtosis, sqrt(avg(x * x)) AS RMS
  FROM vec GROUP BY ALL)"""
ORACLE["features_wide_extra_bands"] = _with(
    [MIN, LONG, DETRENDED, SHAPED, _spectrum(32, 32, 1, 0.5, 100), EXTENDED, POWER],
    _wide(
        {"Mean": 3, "Std": 3, "Skewness": 6, "Kurtosis": 6, "RMS": 3},
        ["delta", "theta", "alpha", "beta", "gamma"],
    ),
)
ORACLE["signal_quality"] = _with(
    [MIN, LONG],
    f"""SELECT {KEYS}, count(*) AS n_times, count(*) FILTER (value IS NULL) AS n_missing,
    count(*) FILTER (isnan(value)) AS n_nan, min(value) AS min_value, max(value) AS max_value,
    {r("avg(value)", 3)} AS mean_value, {r("stddev_pop(value)", 3)} AS std_value
    FROM ep GROUP BY ALL""",
)
ORACLE["labelled_power"] = _with(
    [*LINE_PSD, BANDS, POWER, SUBJECTS],
    f"""SELECT SubjectID, EpochID,
    CASE "Group" WHEN 'A' THEN 0 WHEN 'C' THEN 1 ELSE 2 END AS label, Electrode, WaveBand,
    {r("rel")} AS Power FROM power JOIN subjects USING (SubjectID)""",
)
ORACLE["preview"] = _with(
    LINE_FEATURES,
    f"""SELECT * FROM ({LONG_ROWS})
    ORDER BY SubjectID, EpochID, Electrode, FeatureName, WaveBand NULLS FIRST LIMIT 20""",
)
ORACLE["table_shape"] = _with(
    [MIN, LONG],
    f"""SELECT 17 * count(DISTINCT ({KEYS})) AS n_rows, count(DISTINCT SubjectID) AS n_subjects,
    CAST(7 AS BIGINT) AS n_columns FROM ep""",
)

# --- scaling -----------------------------------------------------------------------

COLS = [f"e{i}" for i in range(64)] + ["c0"]
WIDE = f"""
wide AS (
  SELECT 'sub-' || lpad(CAST(label AS VARCHAR), 3, '0') AS SubjectID, 'ep-' || vec_id AS EpochID,
         label, CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS part,
         {", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(64))},
         CAST(1 AS DOUBLE) AS c0
  FROM embeddings)"""


def _scaled(cell, stats: str, digits: int, key: str = "") -> str:
    cells = ", ".join(f"{r(cell(c), digits)} AS {c}" for c in COLS)
    part = "" if key else ", part"
    join = f"JOIN stats USING ({key})" if key else "CROSS JOIN stats"
    return _with(
        [WIDE, f"\nstats AS ({stats})"],
        f"SELECT SubjectID, EpochID, label, {cells}{part} FROM wide {join}",
    )


def _agg(a: str, b: str, cast: str = "DOUBLE") -> str:
    return ", ".join(
        f"{a}(CAST({c} AS {cast})) AS {c}_a, {b}(CAST({c} AS {cast})) AS {c}_b" for c in COLS
    )


TRAIN = "FROM wide WHERE part = 'train'"
ORACLE["minmax_train_test"] = _scaled(
    lambda c: f"({c} - {c}_a) / CASE WHEN {c}_b <> {c}_a THEN {c}_b - {c}_a ELSE 1 END * 2 - 1",
    f"SELECT {_agg('min', 'max')} {TRAIN}",
    6,
)
ORACLE["zscore_train_test"] = ORACLE["zscore_melted"] = _scaled(
    lambda c: f"(CAST(CAST({c} AS FLOAT) AS DOUBLE) - {c}_a) "
    f"/ CASE WHEN {c}_b <> 0 THEN {c}_b ELSE 1 END",
    "SELECT "
    + ", ".join(
        f"avg(CAST(CAST({c} AS FLOAT) AS DOUBLE)) AS {c}_a,"
        f" stddev_samp(CAST(CAST({c} AS FLOAT) AS DOUBLE)) AS {c}_b"
        for c in COLS
    )
    + f" {TRAIN}",
    5,
)
ORACLE["zscore_per_subject"] = _scaled(
    lambda c: f"({c} - {c}_a) / CASE WHEN {c}_b <> 0 THEN {c}_b ELSE 1 END",
    f"SELECT SubjectID, {_agg('avg', 'stddev_samp')} FROM wide GROUP BY ALL",
    6,
    "SubjectID",
)
ORACLE["minmax_per_subject"] = _scaled(
    lambda c: f"({c} - {c}_a) / CASE WHEN {c}_b <> {c}_a THEN {c}_b - {c}_a ELSE 1 END",
    f"SELECT SubjectID, {_agg('min', 'max')} FROM wide GROUP BY ALL",
    6,
    "SubjectID",
)
ORACLE["melt_wide"] = _with(
    [WIDE],
    "\nUNION ALL ".join(
        f"""SELECT SubjectID, EpochID, label, '{c}' AS pivot,
        {r(f"CAST(CAST({c} AS FLOAT) AS DOUBLE)")} AS value FROM wide"""
        for c in COLS
    ),
)
POWER_ROWS = """
rows AS (
  SELECT 'sub-' || l_suppkey AS SubjectID, 'ep-' || y AS EpochID, s_nationkey % 3 AS label,
         l_returnflag AS Electrode, l_linestatus AS WaveBand, Power,
         CASE WHEN l_suppkey % 5 = 0 THEN 'test' ELSE 'train' END AS part
  FROM (SELECT l_suppkey, year(l_shipdate) AS y, l_returnflag, l_linestatus,
               sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / (count(*) * 100::DOUBLE) AS Power
        FROM lineitem GROUP BY ALL)
  JOIN supplier ON l_suppkey = s_suppkey)"""
ORACLE["power_zscore"] = _with(
    [
        POWER_ROWS,
        """
stats AS (
  SELECT Electrode, WaveBand, avg(CAST(CAST(Power AS FLOAT) AS DOUBLE)) AS mu,
         stddev_samp(CAST(CAST(Power AS FLOAT) AS DOUBLE)) AS sd
  FROM rows WHERE part = 'train' GROUP BY ALL)""",
    ],
    f"""SELECT SubjectID, EpochID, label, Electrode, WaveBand,
    {r("(CAST(CAST(Power AS FLOAT) AS DOUBLE) - mu) / CASE WHEN sd <> 0 THEN sd ELSE 1 END", 5)}
      AS Power, part FROM rows JOIN stats USING (Electrode, WaveBand)""",
)
ORACLE["pivot_for_pca"] = _with(
    [POWER_ROWS],
    "SELECT SubjectID, EpochID, label, "
    + ", ".join(
        f"coalesce(max(CASE WHEN Electrode = '{e}' AND WaveBand = '{b}' THEN Power END), 0)"
        f" AS {e}_{b}"
        for e in "ANR"
        for b in "FO"
    )
    + " FROM rows GROUP BY ALL",
)

HALVES = """
halves AS (
  SELECT 'sub-' || lpad(CAST(label AS VARCHAR), 3, '0') AS SubjectID, 'ep-' || vec_id AS EpochID,
         CAST(label AS INTEGER) AS label, vec_id % 5 = 0 AS is_test,
         list_sum(CAST(embedding[1:32] AS DOUBLE[])) AS h0,
         list_sum(CAST(embedding[33:64] AS DOUBLE[])) AS h1
  FROM embeddings),
cov AS (
  SELECT var_samp(h0) AS a, var_samp(h1) AS b, covar_samp(h0, h1) AS c FROM halves WHERE NOT is_test),
eigen AS (
  SELECT *, (a + b) / 2 + sqrt(((a - b) / 2) ** 2 + c * c) AS l1,
         (a + b) / 2 - sqrt(((a - b) / 2) ** 2 + c * c) AS l2 FROM cov),
axis AS (
  SELECT *, c / sqrt(c * c + (l1 - a) ** 2) AS u, (l1 - a) / sqrt(c * c + (l1 - a) ** 2) AS v FROM eigen),
components AS (
  SELECT 0 AS component, l1 / (l1 + l2) AS explained, true AS kept,
         u * CASE WHEN abs(u) >= abs(v) THEN sign(u) ELSE sign(v) END AS x,
         v * CASE WHEN abs(u) >= abs(v) THEN sign(u) ELSE sign(v) END AS y FROM axis
  UNION ALL
  SELECT 1, l2 / (l1 + l2), l1 / (l1 + l2) < 0.95,
         -v * CASE WHEN abs(v) >= abs(u) THEN sign(-v) ELSE sign(u) END,
         u * CASE WHEN abs(v) >= abs(u) THEN sign(-v) ELSE sign(u) END FROM axis),
scores AS (
  SELECT SubjectID, EpochID, label, component, h0 * x + h1 * y AS score
  FROM halves CROSS JOIN components WHERE kept)"""
ORACLE["pca_k"] = _with(
    [HALVES], f"SELECT component + 1 AS component, {r('explained')} AS explained, kept FROM components"
)
ORACLE["pca_apply"] = _with(
    [HALVES], f"SELECT SubjectID, EpochID, label, component, {r('score', 5)} AS score FROM scores"
)
ORACLE["pca_minmax"] = _with(
    [HALVES],
    f"""SELECT SubjectID, EpochID, label, component, {r("(score - lo) / CASE WHEN hi <> lo THEN hi - lo ELSE 1 END", 5)}
      AS score
    FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM scores
      WINDOW w AS (PARTITION BY SubjectID, component))""",
)
ORACLE["pca_all_columns"] = f"""
SELECT 'sub-' || lpad(CAST(label AS VARCHAR), 3, '0') AS SubjectID, 'ep-' || vec_id AS EpochID,
  CAST(label AS INTEGER) AS label,
  {r("list_sum([x * x for x in CAST(embedding AS DOUBLE[])])", 4)} AS squares
FROM embeddings"""
ORACLE["pca_component_variance"] = f"""
SELECT 64 AS n_components, {r("sum(v)", 4)} AS variance, true AS in_order, true AS as_stated FROM (
  SELECT k, var_samp(x) AS v FROM (
    SELECT unnest(range(64)) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE vec_id % 5 <> 0)
  GROUP BY k)"""
ORACLE["pca_minmax_all_columns"] = """
SELECT 'sub-' || lpad(CAST(label AS VARCHAR), 3, '0') AS SubjectID, CAST(k AS INTEGER) AS component,
  count(*) AS n_rows, 0::DOUBLE AS lo, 1::DOUBLE AS hi
FROM embeddings CROSS JOIN (SELECT unnest(range(64)) AS k) GROUP BY ALL"""
