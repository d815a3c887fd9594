"""Queries over whole records: spectra, autocorrelations and long filters of the suppliers' series, in thousands."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from spectrel.operators import filters as fi
from spectrel.operators import longfft as lf
from spectrel.plans.fixtures import FS, SHIP_SQL, ship_series
from spectrel.plans.registry import query
from spectrel.plans.spectral_queries import rounded

G = "group_id, part"
#: The series in thousands, with each record's length, and the line through it.
REC_SQL = f"WITH {SHIP_SQL}, rc AS (SELECT {G}, n, x / 1000 AS x, count(*) OVER (PARTITION BY {G}) AS size FROM ser), ln AS (SELECT {G}, avg(x) AS mx, avg(n) AS mn, CASE WHEN var_pop(n) = 0 THEN 0 ELSE covar_pop(n, x) / var_pop(n) END AS b FROM rc GROUP BY {G})"
HANN = "(0.5::DOUBLE - 0.5 * cos(2 * pi() * n / size))"
DFT_SQL = f"f AS (SELECT {G}, size, k, sum(y * cos(2 * pi() * ((k * n) % size) / size)) AS re, sum(y * sin(2 * pi() * ((k * n) % size) / size)) AS im FROM w CROSS JOIN (SELECT unnest(range((SELECT max(size) // 2 + 1 FROM rc))) AS k) WHERE k <= size // 2 GROUP BY {G}, size, k)"
#: Factors that a task holds in these queries, so that the short records of the tables take the same way as long ones.
SMALL = {"block": 256, "largest": 32}


def thousands(spark, d):
    return ship_series(spark, d).select("group_id", "part", "n", (F.col("x") / 1000).alias("x"))


@query("g03_record_fft", f"{REC_SQL}, w AS (SELECT {G}, n, size, (x - mx - b * (n - mn)) * {HANN} AS y FROM rc JOIN ln USING ({G})), {DFT_SQL} SELECT {G}, CAST(k AS BIGINT) AS k, round(k * 64.0::DOUBLE / size, 9) AS freq_hz, round((CASE WHEN k = 0 OR k = size // 2 THEN 1 ELSE 2 END) * sqrt(re * re + im * im) / (size / 2.0::DOUBLE), 6) AS magnitude FROM f")
def g03_record(spark, d):
    """Whole records without their lines, Hann window; by the four-step transform, of prime lengths by the chirp."""
    return rounded(rounded(lf.record_spectrum(thousands(spark, d), FS, "hann", "linear", **SMALL), 6, "magnitude"), 9, "freq_hz")


@query("g04_record_psd", f"{REC_SQL}, w AS (SELECT {G}, n, size, (x - mx) * (0.54::DOUBLE - 0.46 * cos(2 * pi() * n / size)) AS y FROM rc JOIN ln USING ({G})), {DFT_SQL} SELECT {G}, CAST(k AS BIGINT) AS k, round((CASE WHEN k = 0 OR 2 * k = size THEN 1 ELSE 2 END) * (re * re + im * im) / (64 * size * (0.54::DOUBLE * 0.54 + 0.46::DOUBLE * 0.46 / 2)), 6) AS psd FROM f WHERE size >= 8")
def g04_record(spark, d):
    """Densities of whole records without their means, Hamming window; records of 8 samples or more."""
    return rounded(lf.record_spectrum(thousands(spark, d), FS, "hamming", "constant", True, least=8), 6, "psd").select("group_id", "part", "k", "psd")


@query("g06_record_autocorrelation", f"{REC_SQL} SELECT a.group_id, a.part, a.n - b.n AS lag, round(sum((a.x - mx) * (b.x - mx)) / max(a.size), 6) + 0 AS r FROM rc a JOIN ln ON a.group_id = ln.group_id AND a.part = ln.part JOIN rc b ON a.group_id = b.group_id AND a.part = b.part AND a.n - b.n BETWEEN 0 AND 90 GROUP BY 1, 2, 3")
def g06_record(spark, d):
    """Lags up to 90 over records in blocks of 128 samples."""
    return lf.record_autocorrelation(thousands(spark, d), 90, block=128).withColumn("r", F.round("r", 6) + 0)


BT_LAGS = 16


@query("g06_record_blackman_tukey", f"""{REC_SQL}, r AS (SELECT a.group_id, a.part, a.n - b.n AS lag, sum((a.x - mx) * (b.x - mx)) / max(a.size) AS r FROM rc a JOIN ln ON a.group_id = ln.group_id AND a.part = ln.part JOIN rc b ON a.group_id = b.group_id AND a.part = b.part AND a.n - b.n BETWEEN 0 AND {BT_LAGS} WHERE a.size > {BT_LAGS} GROUP BY 1, 2, 3),
w AS (SELECT *, 0.42::DOUBLE - 0.5 * cos(2 * pi() * (lag + {BT_LAGS}) / 33) + 0.08 * cos(4 * pi() * (lag + {BT_LAGS}) / 33) AS u, 0.42::DOUBLE - 0.5 * cos(2 * pi() * ({BT_LAGS} - lag) / 33) + 0.08 * cos(4 * pi() * ({BT_LAGS} - lag) / 33) AS v FROM r)
SELECT {G}, CAST(k AS BIGINT) AS k, k * 1.0::DOUBLE AS freq_hz, round(greatest(sum(CASE WHEN lag = 0 THEN r * u ELSE r * (u + v) * cos(2 * pi() * lag * k / 64) END) / 64, 0), 6) + 0 AS psd FROM w CROSS JOIN (SELECT unnest(range(32)) AS k) GROUP BY {G}, k""")
def g06_record_bt(spark, d):
    s = thousands(spark, d)
    long = s.groupBy("group_id", "part").count().where(f"count > {BT_LAGS}")
    return lf.record_blackman_tukey(s.join(long, ["group_id", "part"], "left_semi"), FS, BT_LAGS, n_fft=64, block=128).withColumn("psd", F.round("psd", 6) + 0)


LONG_TAPS = [math.cos(0.3 + i / 40) / 200 for i in range(257)]


@query("g16_long_fir", f"{REC_SQL}, h AS (SELECT i, cos(0.3::DOUBLE + i / 40.0::DOUBLE) / 200 AS v FROM range(257) t(i)) SELECT a.group_id, a.part, a.n, round(sum(b.x * v), 6) + 0 AS y FROM rc a CROSS JOIN h JOIN rc b ON a.group_id = b.group_id AND a.part = b.part AND b.n = a.n - h.i GROUP BY 1, 2, 3")
def g16_long(spark, d):
    """257 taps: blocks of 256 samples with the 256 before them, convolved by FFT."""
    y = fi.apply_fir(thousands(spark, d), LONG_TAPS, block=256)
    return y.select("group_id", "part", "n", (F.round("y", 6) + 0).alias("y"))
