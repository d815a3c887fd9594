"""Queries of the spectral functions and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectrel.functions import windows as W
from spectrel.functions.tables import written
from spectrel.operators import features as feat
from spectrel.operators import kernels, robust
from spectrel.operators import spectral as sp
from spectrel.plans.fixtures import EMB_KEYS, EMB_SQL, FS, SHIP_SQL, SIZE, emb_arrays, emb_windows, ship_series, table
from spectrel.plans.registry import query

KEYS = EMB_KEYS
K = "group_id, part, label, window_id"
PI = "pi()"
HANN64 = "(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * n / 64))"
HANN32 = "(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * m / 32))"

#: Welch with segments of 32, half overlapping, by plain segments and a second pass for the mean.
WELCH_SQL = f"""
seg AS (SELECT {K}, s.j AS seg, n - 16 * s.j AS m, x FROM emb JOIN (SELECT unnest(range(3)) AS j) s ON n >= 16 * s.j AND n < 16 * s.j + 32),
det AS (SELECT {K}, seg, m, (x - avg(x) OVER (PARTITION BY window_id, seg)) * {HANN32} AS y FROM seg),
dft AS (SELECT {K}, seg, k, sum(y * cos(2 * pi() * ((k * m) % 32) / 32)) AS re, sum(y * sin(2 * pi() * ((k * m) % 32) / 32)) AS im FROM det CROSS JOIN (SELECT unnest(range(17)) AS k) GROUP BY {K}, seg, k),
psd AS MATERIALIZED (SELECT {K}, k, k * 2.0::DOUBLE AS freq_hz, avg((CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END) * (re * re + im * im) / (64 * 12.0::DOUBLE)) AS psd FROM dft GROUP BY {K}, k)"""
MAG_SQL = f"""
mdft AS (SELECT {K}, k, sum(x * {HANN64} * cos(2 * pi() * ((k * n) % 64) / 64)) AS re, sum(x * {HANN64} * sin(2 * pi() * ((k * n) % 64) / 64)) AS im FROM emb CROSS JOIN (SELECT unnest(range(33)) AS k) GROUP BY {K}, k),
mag AS MATERIALIZED (SELECT {K}, k, k * 1.0::DOUBLE AS freq_hz, (CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END) * sqrt(re * re + im * im) / 32 AS magnitude FROM mdft)"""
PIECES_SQL = f"""
pieces AS (SELECT {K}, freq_hz AS f, psd AS v, lead(freq_hz) OVER w AS g, lead(psd) OVER w AS u FROM psd WINDOW w AS (PARTITION BY window_id ORDER BY k))"""


def bands_sql(count: int) -> str:
    """Band powers by a join of pieces and bands."""
    return f"""
bd AS (SELECT i + 1 AS band, i * 32.0::DOUBLE / {count} AS a, (i + 1) * 32.0::DOUBLE / {count} AS b FROM (SELECT unnest(range({count})) AS i)),
cut AS (SELECT {K}, band, v, u, f, g, greatest(f, a) AS lo, least(g, b) AS hi FROM pieces JOIN bd ON g IS NOT NULL AND f < b AND g > a),
bp AS MATERIALIZED (SELECT {K}, band, sum((2 * v + (u - v) / (g - f) * (lo + hi - 2 * f)) / 2 * (hi - lo)) AS power FROM cut GROUP BY {K}, band)"""


TIME_SQL = f"tf AS (SELECT {K}, sqrt(avg(x * x)) AS rms, avg(x * x) AS mean_power, sum(x * x) AS energy, max(abs(x)) AS peak, max(abs(x)) / sqrt(avg(x * x)) AS crest_factor FROM emb GROUP BY {K})"
SPEC_SQL = f"""
sf AS (SELECT {K}, min(freq_hz) FILTER (WHERE r = 1) AS dominant_psd_hz, max(psd) AS psd_max, sum(freq_hz * psd) / sum(psd) AS c,
    sum(psd) AS s0 FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY round(psd, 12) DESC, k) AS r FROM psd) GROUP BY {K}),
sp AS (SELECT {', '.join('p.' + c.strip() for c in K.split(','))}, sqrt(sum((p.freq_hz - sf.c) * (p.freq_hz - sf.c) * p.psd) / min(sf.s0)) AS bw FROM psd p JOIN sf ON p.window_id = sf.window_id GROUP BY ALL),
ar AS (SELECT {K}, sum((v + u) / 2 * (g - f)) AS area FROM pieces WHERE g IS NOT NULL GROUP BY {K}),
dm AS (SELECT window_id, min(freq_hz) AS dominant_fft_hz FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY round(magnitude, 12) DESC, k) AS r FROM mag) WHERE r = 1 GROUP BY window_id)"""
#: The whole feature table ft with 4 bands.
FEATURE_CTES = "WITH " + ",".join([EMB_SQL, WELCH_SQL, MAG_SQL, PIECES_SQL, bands_sql(4), TIME_SQL, SPEC_SQL]) + f""",
ft AS MATERIALIZED (SELECT {', '.join('tf.' + c.strip() for c in K.split(','))}, rms, mean_power, energy, peak, crest_factor, dominant_fft_hz, dominant_psd_hz, psd_max, area AS psd_total_power, c AS spectral_centroid_hz, bw AS spectral_bandwidth_hz,
  {', '.join(f'b.p{i} AS band_power_{i}' for i in range(1, 5))}, {', '.join(f'b.p{i} / b.t AS rel_band_power_{i}' for i in range(1, 5))}
  FROM tf JOIN sf USING (window_id) JOIN sp USING (window_id) JOIN ar USING (window_id) JOIN dm USING (window_id)
  JOIN (SELECT window_id, {', '.join(f'sum(power) FILTER (WHERE band = {i}) AS p{i}' for i in range(1, 5))}, sum(power) AS t FROM bp GROUP BY window_id) b USING (window_id))"""
FEATURES4 = [*feat.BASE_FEATURES, *feat.band_columns(4, False), *feat.band_columns(4)]


def features4(spark, d):
    """The feature table of the windows from embeddings, by the Arrow kernel: no shuffle."""
    return kernels.feature_table(emb_arrays(spark, d), FS, 4, 32, "hann", "win", 16)


def rounded(df, digits: int, *cols: str):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def with_sql(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def record_windows(spark, d):
    """(group_id, part, n, size, name, w): every record's length and, by name, the weights of a window as long."""
    s = ship_series(spark, d).select("group_id", "part", "n")
    size = s.groupBy("group_id", "part").agg(F.count("*").alias("size"))
    names = ["boxcar", "hann", "hamming", "blackman"]
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("name"), W.weight(x, F.col("n"), F.col("size")).alias("w")) for x in names])).alias("p")
    return s.join(size, ["group_id", "part"]).select("group_id", "part", "n", "size", pairs).select("group_id", "part", "n", "size", "p.*")


@query("g01_window", f"WITH {SHIP_SQL}, w AS (SELECT group_id, part, n, count(*) OVER (PARTITION BY group_id, part) AS size, unnest(['boxcar', 'hann', 'hamming', 'blackman']) AS name FROM ser) SELECT group_id, part, name, n, round(CASE name WHEN 'boxcar' THEN 1.0::DOUBLE WHEN 'hann' THEN 0.5 - 0.5 * cos(2 * pi() * n / size) WHEN 'hamming' THEN 0.54 - 0.46 * cos(2 * pi() * n / size) ELSE 0.42 - 0.5 * cos(2 * pi() * n / size) + 0.08 * cos(4 * pi() * n / size) END, 9) + 0 AS w FROM w")
def g01(spark, d):
    """The windows over every record, as long as the record."""
    return record_windows(spark, d).withColumn("w", F.round("w", 9) + 0).drop("size")


@query("g02_window_metrics", f"""WITH {SHIP_SQL}, c AS (SELECT group_id, part, n, count(*) OVER (PARTITION BY group_id, part) AS size, unnest(['boxcar', 'hann', 'hamming', 'blackman']) AS name FROM ser), w AS (SELECT *, CASE name WHEN 'boxcar' THEN 1.0::DOUBLE WHEN 'hann' THEN 0.5 - 0.5 * cos(2 * pi() * n / size) WHEN 'hamming' THEN 0.54 - 0.46 * cos(2 * pi() * n / size) ELSE 0.42 - 0.5 * cos(2 * pi() * n / size) + 0.08 * cos(4 * pi() * n / size) END AS w FROM c WHERE size >= 4)
SELECT group_id, part, size, name, round(sum(w) / size, 9) AS coherent_gain, round(size * sum(w * w) / (sum(w) * sum(w)), 9) AS enbw_bins, round(sum(w * w) / (sum(w) * sum(w)) * 40e6, 3) AS enbw_hz FROM w GROUP BY group_id, part, size, name""")
def g02(spark, d):
    """Gain and noise bandwidth of the windows over every record of four samples or more."""
    out = W.window_metrics(record_windows(spark, d).where("size >= 4"), F.col("size"), 40e6, ("group_id", "part", "size"))
    return rounded(rounded(out, 9, "coherent_gain", "enbw_bins"), 3, "enbw_hz")


@query("g03_fft_magnitude", with_sql(EMB_SQL, MAG_SQL) + " SELECT window_id, CAST(k AS BIGINT) AS k, freq_hz, round(magnitude, 9) AS magnitude FROM mag")
def g03(spark, d):
    return rounded(kernels.fft_table(emb_arrays(spark, d), FS, window="hann"), 9, "magnitude")


@query("g03_fft_detrended", with_sql(EMB_SQL) + f""", f AS (SELECT window_id, avg(x) AS mx, avg(n) AS mn, covar_pop(n, x) / var_pop(n) AS b FROM emb GROUP BY window_id),
r AS (SELECT window_id, n, x - mx - b * (n - mn) AS y FROM emb JOIN f USING (window_id)),
t AS (SELECT window_id, k, sum(y * cos(2 * pi() * ((k * n) % 128) / 128)) AS re, sum(y * sin(2 * pi() * ((k * n) % 128) / 128)) AS im FROM r CROSS JOIN (SELECT unnest(range(65)) AS k) GROUP BY window_id, k)
SELECT window_id, CAST(k AS BIGINT) AS k, k * 0.5::DOUBLE AS freq_hz, round((CASE WHEN k IN (0, 64) THEN 1 ELSE 2 END) * sqrt(re * re + im * im) / 64, 9) AS magnitude FROM t""")
def g03b(spark, d):
    return rounded(kernels.fft_table(emb_arrays(spark, d), FS, n_fft=128, detrend=True), 9, "magnitude")


@query("g04_periodogram", with_sql(EMB_SQL) + """, r AS (SELECT window_id, n, x - avg(x) OVER (PARTITION BY window_id) AS y FROM emb),
t AS (SELECT window_id, k, sum(y * cos(2 * pi() * ((k * n) % 64) / 64)) AS re, sum(y * sin(2 * pi() * ((k * n) % 64) / 64)) AS im FROM r CROSS JOIN (SELECT unnest(range(33)) AS k) GROUP BY window_id, k)
SELECT window_id, CAST(k AS BIGINT) AS k, k * 1.0::DOUBLE AS freq_hz, round((CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END) * (re * re + im * im) / (64.0::DOUBLE * 64), 9) AS psd FROM t""")
def g04(spark, d):
    return rounded(kernels.periodogram_table(emb_arrays(spark, d), FS), 9, "psd")


@query("g05_welch_psd", with_sql(EMB_SQL, WELCH_SQL) + " SELECT window_id, CAST(k AS BIGINT) AS k, freq_hz, round(psd, 9) AS psd FROM psd")
def g05(spark, d):
    return rounded(welch_emb(spark, d), 9, "psd")


#: Complex windows: the samples of an embedding in pairs, 32 to a window.
PAIRS_SQL = "prs AS (SELECT window_id, part, label, n // 2 AS m, max(CASE WHEN n % 2 = 0 THEN x END) AS a, max(CASE WHEN n % 2 = 1 THEN x END) AS b FROM emb GROUP BY ALL)"
WELCH2_SQL = """sg AS (SELECT window_id, s.j AS seg, m - 8 * s.j AS m, a, b FROM prs JOIN (SELECT unnest(range(3)) AS j) s ON m >= 8 * s.j AND m < 8 * s.j + 16),
dt AS (SELECT window_id, seg, m, (a - avg(a) OVER w) * h AS a, (b - avg(b) OVER w) * h AS b FROM (SELECT *, 0.5::DOUBLE - 0.5 * cos(2 * pi() * m / 16) AS h FROM sg) WINDOW w AS (PARTITION BY window_id, seg)),
ft2 AS (SELECT window_id, seg, f, sum(a * cos(2 * pi() * f * m / 16) + b * sin(2 * pi() * f * m / 16)) AS re, sum(b * cos(2 * pi() * f * m / 16) - a * sin(2 * pi() * f * m / 16)) AS im FROM dt CROSS JOIN (SELECT unnest(range(-8, 8)) AS f) GROUP BY window_id, seg, f),
psd2 AS MATERIALIZED (SELECT window_id, f + 8 AS k, f * 2.0::DOUBLE AS freq_hz, avg((re * re + im * im) / (32 * 6.0::DOUBLE)) AS psd FROM ft2 GROUP BY window_id, f)"""


def pairs(spark, d):
    even = lambda first: F.filter("win", lambda v, i: i % 2 == first)
    return emb_arrays(spark, d).select("window_id", even(0).alias("re"), even(1).alias("im"))


@query("g03_fft_two_sided", with_sql(EMB_SQL, PAIRS_SQL) + """, t AS (SELECT window_id, f, sum(h * (a * cos(2 * pi() * f * m / 32) + b * sin(2 * pi() * f * m / 32))) AS re, sum(h * (b * cos(2 * pi() * f * m / 32) - a * sin(2 * pi() * f * m / 32))) AS im FROM (SELECT *, 0.5::DOUBLE - 0.5 * cos(2 * pi() * m / 32) AS h FROM prs) CROSS JOIN (SELECT unnest(range(-16, 16)) AS f) GROUP BY window_id, f)
SELECT window_id, CAST(f + 16 AS BIGINT) AS k, f * 1.0::DOUBLE AS freq_hz, round(sqrt(re * re + im * im) / 16, 9) AS magnitude FROM t""")
def g03c(spark, d):
    """Complex samples: frequencies of both signs, nothing doubled."""
    return rounded(kernels.fft_table(pairs(spark, d), 32.0, window="hann", column="re", imaginary="im"), 9, "magnitude")


@query("g05_welch_two_sided", with_sql(EMB_SQL, PAIRS_SQL, WELCH2_SQL) + " SELECT window_id, CAST(k AS BIGINT) AS k, freq_hz, round(psd, 9) AS psd FROM psd2")
def g05c(spark, d):
    return rounded(kernels.welch_table(pairs(spark, d), 32.0, 16, 8, "hann", column="re", imaginary="im"), 9, "psd")


@query("g08_band_power_two_sided", with_sql(EMB_SQL, PAIRS_SQL, WELCH2_SQL) + """, sd AS (SELECT window_id, freq_hz < 0 AS neg, abs(freq_hz) AS f, psd AS v, lead(abs(freq_hz)) OVER w AS g, lead(psd) OVER w AS u FROM psd2 WINDOW w AS (PARTITION BY window_id, freq_hz < 0 ORDER BY abs(freq_hz))),
bd AS (SELECT i + 1 AS band, i * 4.0::DOUBLE AS a, (i + 1) * 4.0::DOUBLE AS b FROM (SELECT unnest(range(4)) AS i)),
ct AS (SELECT window_id, band, v, u, f, g, greatest(f, a) AS lo, least(g, b) AS hi FROM sd JOIN bd ON g IS NOT NULL AND f < b AND g > a)
SELECT window_id, CAST(band AS BIGINT) AS band, round(sum((2 * v + (u - v) / (g - f) * (lo + hi - 2 * f)) / 2 * (hi - lo)), 9) AS power FROM ct GROUP BY window_id, band""")
def g08c(spark, d):
    """Bands of a two-sided spectrum: the mirrored negative side is added."""
    psd = kernels.welch_table(pairs(spark, d), 32.0, 16, 8, "hann", column="re", imaginary="im")
    return rounded(sp.band_powers(psd, sp.equal_bands(32.0, 4), ("window_id",)), 9, "power")


def bt_sql(compat: bool) -> str:
    value = "cos(2 * pi() * k * (lag + 16) / 64)" if compat else "cos(2 * pi() * k * lag / 64)"
    return with_sql(EMB_SQL) + f""", r AS (SELECT window_id, n, x - avg(x) OVER (PARTITION BY window_id) AS y FROM emb),
ac AS (SELECT a.window_id, b.n - a.n AS lag, sum(a.y * b.y) / 64 AS r FROM r a JOIN r b ON a.window_id = b.window_id AND b.n - a.n BETWEEN -16 AND 16 GROUP BY 1, 2),
w AS (SELECT window_id, lag, r * (0.42::DOUBLE - 0.5 * cos(2 * pi() * (lag + 16) / 33) + 0.08 * cos(4 * pi() * (lag + 16) / 33)) AS r FROM ac)
SELECT window_id, CAST(k AS BIGINT) AS k, k * 1.0::DOUBLE AS freq_hz, round(greatest(sum(r * {value}) / 64, 0), 9) + 0 AS psd FROM w CROSS JOIN (SELECT unnest(range(32)) AS k) GROUP BY window_id, k"""


@query("g06_blackman_tukey", bt_sql(False))
def g06(spark, d):
    return kernels.blackman_tukey_table(emb_arrays(spark, d), FS).withColumn("psd", F.round("psd", 9) + 0)


@query("g06_blackman_tukey_compat", bt_sql(True))
def g06c(spark, d):
    return kernels.blackman_tukey_table(emb_arrays(spark, d), FS, compat=True).withColumn("psd", F.round("psd", 9) + 0)


def welch_emb(spark, d, keys=("window_id",)):
    return kernels.welch_table(emb_arrays(spark, d), FS, 32, 16, "hann", keys)


@query("g07_psd_power", with_sql(EMB_SQL, WELCH_SQL, PIECES_SQL) + " SELECT window_id, round(sum((v + u) / 2 * (g - f)), 9) AS power FROM pieces WHERE g IS NOT NULL GROUP BY window_id")
def g07(spark, d):
    return rounded(sp.psd_power(welch_emb(spark, d), ("window_id",)), 9, "power")


@query("g08_band_power", with_sql(EMB_SQL, WELCH_SQL, PIECES_SQL, bands_sql(10)) + " SELECT window_id, CAST(band AS BIGINT) AS band, round(power, 9) AS power FROM bp")
def g08(spark, d):
    return rounded(sp.band_powers(welch_emb(spark, d), sp.equal_bands(FS, 10), ("window_id",)), 9, "power")


@query("g09_psd_diagnostics", with_sql(EMB_SQL, WELCH_SQL) + ", q AS (SELECT window_id, median(10 * log10(greatest(psd, 1e-30))) AS a, max(10 * log10(greatest(psd, 1e-30))) AS b FROM psd GROUP BY window_id) SELECT window_id, round(a, 6) AS floor_db, round(b, 6) AS peak_db, round(greatest(b - a, 0), 6) AS contrast_db FROM q")
def g09(spark, d):
    return rounded(sp.diagnostics(welch_emb(spark, d), ("window_id",)), 6, "floor_db", "peak_db", "contrast_db")


@query("g10_equal_bands", "SELECT s_suppkey, CAST(i + 1 AS BIGINT) AS band, i * (s_suppkey * 1000 / 2.0::DOUBLE) / 20 AS low_hz, (i + 1) * (s_suppkey * 1000 / 2.0::DOUBLE) / 20 AS high_hz FROM supplier CROSS JOIN range(20) t(i)")
def g10(spark, d):
    """Twenty bands for every supplier's rate."""
    rates = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 1000.0).alias("fs"))
    return sp.band_table(rates, 20).select("s_suppkey", "band", "low_hz", "high_hz")


@query("g11_time_features", with_sql(EMB_SQL, TIME_SQL) + " SELECT window_id, round(rms, 9) AS rms, round(mean_power, 9) AS mean_power, round(energy, 9) AS energy, round(peak, 9) AS peak, round(crest_factor, 9) AS crest_factor FROM tf")
def g11t(spark, d):
    return rounded(feat.time_features(emb_windows(spark, d), ("window_id",)), 9, "rms", "mean_power", "energy", "peak", "crest_factor")


SPECTRAL = ("dominant_fft_hz", "dominant_psd_hz", "psd_max", "psd_total_power", "spectral_centroid_hz", "spectral_bandwidth_hz")


@query("g11_spectral_features", FEATURE_CTES + f" SELECT window_id, {', '.join(f'round({c}, 6) AS {c}' for c in SPECTRAL)} FROM ft")
def g11s(spark, d):
    """Relationally, as the SQL."""
    out = feat.feature_table(emb_windows(spark, d), FS, SIZE, 4, 32, "hann", ("window_id",), 16)
    return rounded(out.select("window_id", *SPECTRAL), 6, *SPECTRAL)


@query("g12_feature_table", FEATURE_CTES + f" SELECT group_id, part, label, window_id, {', '.join(f'round({c}, 6) AS {c}' for c in FEATURES4)} FROM ft")
def g12(spark, d):
    return rounded(features4(spark, d), 6, *FEATURES4)


@query("c07_band_fold", with_sql(EMB_SQL, WELCH_SQL, PIECES_SQL, bands_sql(20)) + f", t AS (SELECT window_id, sum(power) AS t FROM bp GROUP BY window_id) SELECT window_id, {', '.join(f'round(sum(power / t) FILTER (WHERE band BETWEEN {5 * i + 1} AND {5 * i + 5}), 9) AS rel_band_power_{i + 1}' for i in range(4))} FROM bp JOIN t USING (window_id) GROUP BY window_id")
def c07(spark, d):
    wide = feat.relative_bands(sp.band_powers(welch_emb(spark, d), sp.equal_bands(FS, 20), ("window_id",)), 20, ("window_id",))
    folded = feat.fold_bands(wide.select("window_id", *feat.band_columns(20)), 20, 4)
    return rounded(folded, 9, *feat.band_columns(4))


@query("g22_alias", "SELECT l_orderkey, l_linenumber, round(abs(((l_extendedprice * 1000 + (10e6::DOUBLE + l_suppkey) / 2) % (10e6::DOUBLE + l_suppkey)) - (10e6::DOUBLE + l_suppkey) / 2), 3) AS alias_hz FROM lineitem")
def g22(spark, d):
    """Where a frequency made of a line's price appears at a rate made of its supplier."""
    fs = F.lit(10e6) + F.col("l_suppkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(sp.alias_frequency(F.col("l_extendedprice").cast("double") * 1000, fs), 3).alias("alias_hz"))


@query("g23_peak_estimate", with_sql(EMB_SQL, MAG_SQL) + ", p AS (SELECT window_id, median(magnitude) AS fl, max(magnitude) AS top FROM mag GROUP BY window_id), q AS (SELECT window_id, freq_hz FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY round(magnitude, 12) DESC, k) AS r FROM mag) WHERE r = 1) SELECT window_id, freq_hz AS peak_hz, round(20 * log10((top + 1e-12) / (fl + 1e-12)), 6) AS contrast_db, abs(freq_hz - 10) AS error_hz FROM p JOIN q USING (window_id)")
def g23(spark, d):
    mag = kernels.fft_table(emb_arrays(spark, d), FS, window="hann")
    return rounded(sp.peak_estimate(mag, 10.0, ("window_id",)), 6, "contrast_db")


@query("g24_unit_area", with_sql(EMB_SQL, WELCH_SQL, PIECES_SQL) + ", a AS (SELECT window_id, sum((v + u) / 2 * (g - f)) AS area FROM pieces WHERE g IS NOT NULL GROUP BY window_id) SELECT window_id, CAST(k AS BIGINT) AS k, round(psd / area, 9) AS shape FROM psd JOIN a USING (window_id)")
def g24(spark, d):
    return rounded(sp.unit_area(welch_emb(spark, d), ("window_id",)), 9, "shape").select("window_id", "k", "shape")


@query("g25_closed_band", with_sql(EMB_SQL, WELCH_SQL) + ", p AS (SELECT window_id, freq_hz AS f, psd AS v, lead(freq_hz) OVER w AS g, lead(psd) OVER w AS u FROM psd WHERE freq_hz BETWEEN 7 AND 21 WINDOW w AS (PARTITION BY window_id ORDER BY k)) SELECT window_id, round(sum((v + u) / 2 * (g - f)), 9) AS power FROM p GROUP BY window_id")
def g25(spark, d):
    return rounded(sp.closed_band_power(welch_emb(spark, d), 7.0, 21.0, ("window_id",)), 9, "power")


@query("g25_nearest_bin", with_sql(EMB_SQL, WELCH_SQL) + " SELECT window_id, freq_hz, round(10 * log10(greatest(psd, 1e-30)), 6) AS gain_db FROM psd WHERE k = 4")
def g25n(spark, d):
    return rounded(sp.nearest_bin(welch_emb(spark, d), 8.7, ("window_id",)), 6, "gain_db")


@query("e10_median_spectrum", with_sql(EMB_SQL, WELCH_SQL) + " SELECT part, CAST(k AS BIGINT) AS k, min(freq_hz) AS freq_hz, round(median(psd), 9) AS psd FROM psd GROUP BY part, k")
def e10(spark, d):
    spectra = written(kernels.welch_arrays(emb_arrays(spark, d), FS, 32, 16, "hann", ("part", "window_id")), "spectra")
    return rounded(sp.median_spectrum(spectra, 17, FS / 32), 9, "psd")


@query("c03_search_band", with_sql(EMB_SQL, WELCH_SQL) + """, r AS (SELECT window_id, freq_hz, row_number() OVER (PARTITION BY window_id ORDER BY round(psd, 12) DESC, k) AS r FROM psd WHERE freq_hz > 0.02 * 32 AND freq_hz < 0.92 * 32)
SELECT window_id, freq_hz AS peak_hz, greatest(1.0::DOUBLE, freq_hz - 2) AS low_hz, least(0.95 * 32::DOUBLE, freq_hz + 2) AS high_hz FROM r WHERE r = 1""")
def c03(spark, d):
    """The band about the largest density of the search range."""
    return sp.band_around(welch_emb(spark, d), FS, 4.0, ("window_id",))


@query("c03_interior_power", with_sql(EMB_SQL, WELCH_SQL) + " SELECT window_id, count(*) AS bins, round(sum(psd), 9) AS total FROM psd WHERE k BETWEEN 1 AND 15 GROUP BY window_id")
def c03i(spark, d):
    return sp.interior(welch_emb(spark, d), FS).groupBy("window_id").agg(F.count("*").alias("bins"), F.round(F.sum("psd"), 9).alias("total"))


@query("g24_band_choice", with_sql(EMB_SQL, WELCH_SQL, PIECES_SQL, bands_sql(10)) + """, b AS (SELECT part, label, band, sum(power) AS power FROM bp GROUP BY ALL), s AS (SELECT part, band, sum(CASE label WHEN 'target' THEN q ELSE -q END) AS d FROM (SELECT *, power / sum(power) OVER (PARTITION BY part, label) AS q FROM b) GROUP BY part, band)
SELECT part, CAST(band AS BIGINT) AS band, round(d, 9) AS difference FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY round(abs(d), 12) DESC, band) AS r FROM s) WHERE r = 1""")
def g24c(spark, d):
    """By part the band in which the shares of the two labels' power differ most."""
    keys = ("part", "label", "window_id")
    powers = sp.band_powers(welch_emb(spark, d, keys), sp.equal_bands(FS, 10), keys).groupBy("part", "label", "band").agg(F.sum("power").alias("power"))
    return rounded(sp.most_different_band(powers, "label", "target", "background", ("part",)), 9, "difference")


@query("e11_argmax", with_sql(EMB_SQL) + " SELECT window_id, CAST(min(n) FILTER (WHERE r = 1) AS BIGINT) AS at FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY x DESC, n) AS r FROM emb) GROUP BY window_id")
def e11(spark, d):
    from spectrel.functions.columns import first_max

    return emb_arrays(spark, d).select("window_id", first_max(F.col("win")).cast("long").alias("at"))


@query("e02_group_vector", FEATURE_CTES + f", pm AS (SELECT group_id, part, {', '.join(f'median({c}) AS {c}' for c in FEATURES4)} FROM ft GROUP BY group_id, part) SELECT group_id, {', '.join(f'round(avg({c}), 6) AS {c}' for c in FEATURES4)} FROM pm GROUP BY group_id")
def e02(spark, d):
    return rounded(robust.group_vectors(features4(spark, d), FEATURES4), 6, *FEATURES4)
