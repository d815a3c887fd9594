"""Queries of conditioning, framing, generators and perturbations."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from spectrel.functions import udtfs
from spectrel.functions.columns import first_max, gaussian
from spectrel.operators import conditioning as co
from spectrel.operators import framing as fr
from spectrel.operators import kernels
from spectrel.operators import spectral as sp
from spectrel.operators import synth as sy
from spectrel.plans.fixtures import EMB_SQL, SHIP_SQL, USER_SQL, emb_windows, series_user, ship_series
from spectrel.plans.registry import query
from spectrel.plans.spectral_queries import rounded

G = "group_id, part"
U = f"row_number() OVER (PARTITION BY {G} ORDER BY n)"


def pick(df, *cols):
    return df.select("group_id", "part", "n", *cols)


@query("b01_norm_maxabs", f"WITH {SHIP_SQL} SELECT {G}, n, round(x / greatest(max(abs(x)) OVER w, 1e-12), 9) AS x FROM ser WINDOW w AS (PARTITION BY {G})")
def b01m(spark, d):
    return pick(rounded(co.normalize(ship_series(spark, d), "maxabs"), 9, "x"), "x")


@query("b01_norm_rms", f"WITH {SHIP_SQL} SELECT {G}, n, round(x / greatest(sqrt(avg(x * x) OVER w), 1e-12), 9) AS x FROM ser WINDOW w AS (PARTITION BY {G})")
def b01r(spark, d):
    return pick(rounded(co.normalize(ship_series(spark, d), "rms"), 9, "x"), "x")


@query("b01_norm_zscore", f"WITH {USER_SQL}, c AS (SELECT {G}, n, x - avg(x) OVER (PARTITION BY {G}) AS y, stddev_pop(x) OVER (PARTITION BY {G}) AS sd FROM ser) SELECT {G}, n, round(y / greatest(sd, 1e-12), 8) AS x FROM c")
def b01z(spark, d):
    return pick(rounded(co.normalize(series_user(spark, d), "zscore"), 8, "x"), "x")


PRE = f"pre AS (SELECT {G}, label, n, y / greatest(max(abs(y)) OVER (PARTITION BY {G}), 1e-12) AS x FROM (SELECT {G}, label, n, x - avg(x) OVER (PARTITION BY {G}) AS y FROM ser))"


@query("b02_preprocess", f"WITH {SHIP_SQL}, {PRE} SELECT {G}, n, round(x, 6) + 0 AS x FROM pre")
def b02(spark, d):
    return pick(co.preprocess(ship_series(spark, d)).withColumn("x", F.round("x", 6) + 0), "x")


def frames_sql(size: int, hop: int) -> str:
    return f"len AS (SELECT {G}, min(label) AS label, count(*) AS len FROM ser GROUP BY {G}), frm AS (SELECT {G}, label, i AS idx, i * {hop} AS start, i * {hop} + {size} AS stop FROM (SELECT *, unnest(range(CASE WHEN len >= {size} THEN (len - {size}) // {hop} + 1 ELSE 0 END)) AS i FROM len))"


@query("b03_frames", f"WITH {SHIP_SQL}, {frames_sql(32, 16)} SELECT {G}, label, CAST(idx AS BIGINT) AS idx, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM frm")
def b03(spark, d):
    return fr.frame_table(ship_series(spark, d), 32, 16)


@query("b03_frames_padded", f"""WITH {USER_SQL}, len AS (SELECT {G}, count(*) AS len FROM ser GROUP BY {G}),
a AS (SELECT {G}, len, unnest(range(CASE WHEN len >= 24 THEN (len - 24) // 10 + 1 ELSE 0 END)) * 10 AS start FROM len),
b AS (SELECT {G}, len, greatest(len - 24, 0) AS start FROM len WHERE len < 24 OR ((len - 24) // 10) * 10 + 24 < len),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT {G}, CAST(row_number() OVER (PARTITION BY {G} ORDER BY start) - 1 AS BIGINT) AS idx, CAST(start AS BIGINT) AS start, CAST(least(start + 24, len) AS BIGINT) AS stop FROM u""")
def b03p(spark, d):
    return fr.frame_table(series_user(spark, d), 24, 10, drop_last=False).drop("label")


@query("b03_frame_rms", f"WITH {SHIP_SQL}, {frames_sql(32, 16)} SELECT {G}, CAST(idx AS BIGINT) AS idx, round(sqrt(avg(x * x)), 6) AS rms FROM frm JOIN ser USING (group_id, part) WHERE n >= start AND n < stop GROUP BY {G}, idx")
def b03r(spark, d):
    return fr.framed(ship_series(spark, d), 32, 16).groupBy("group_id", "part", "idx").agg(F.round(F.sqrt(F.avg(F.col("x") * F.col("x"))), 6).alias("rms"))


STARTS = f"""cnt AS (SELECT {G}, count(*) AS c FROM frm GROUP BY {G}),
pos AS (SELECT {G}, c, unnest(range(7)) AS j FROM cnt WHERE c > 7),
chosen AS (SELECT {G}, CASE WHEN j = 6 THEN c - 1 ELSE floor(j * ((c - 1) / 6.0::DOUBLE)) END AS idx FROM pos UNION ALL SELECT frm.group_id, frm.part, idx FROM frm JOIN cnt ON frm.group_id = cnt.group_id AND frm.part = cnt.part WHERE c <= 7)"""


@query("b04_starts", f"WITH {SHIP_SQL}, {frames_sql(32, 16)}, {STARTS} SELECT {G}, CAST(idx AS BIGINT) AS idx, CAST(idx * 16 AS BIGINT) AS start FROM chosen")
def b04(spark, d):
    return fr.deterministic_starts(fr.frame_table(ship_series(spark, d), 32, 16), 7).select("group_id", "part", "idx", "start")


@query("b05_sampled_frames", f"WITH {SHIP_SQL}, {frames_sql(32, 16)}, {STARTS} SELECT concat(group_id, '_', lower(part), ':', CAST(row_number() OVER (PARTITION BY {G} ORDER BY idx) - 1 AS VARCHAR)) AS window_id, CAST(idx * 16 AS BIGINT) AS start, round(m, 8) AS mean FROM (SELECT {G}, idx, avg(x) AS m FROM chosen JOIN ser USING (group_id, part) WHERE n >= idx * 16 AND n < idx * 16 + 32 GROUP BY {G}, idx)")
def b05(spark, d):
    chosen = fr.sampled_windows(ship_series(spark, d), 32, 16, 7)
    mean = F.aggregate("win", F.lit(0.0), lambda a, v: a + v) / 32
    return chosen.select(F.concat("group_id", F.lit("_"), F.lower("part"), F.lit(":"), F.col("number").cast("string")).alias("window_id"), "start", F.round(mean, 8).alias("mean"))


@query("b06_representative", f"""WITH {SHIP_SQL}, r AS (SELECT {G}, n // 32 AS idx, sqrt(avg(x * x)) AS rms, count(*) AS c FROM ser WHERE n < 640 GROUP BY {G}, n // 32 HAVING count(*) = 32),
m AS (SELECT *, median(rms) OVER (PARTITION BY {G}) AS mid FROM r), q AS (SELECT *, row_number() OVER (PARTITION BY {G} ORDER BY round(abs(rms - mid), 6), idx) AS o FROM m)
SELECT {G}, CAST(idx AS BIGINT) AS idx, round(rms, 6) AS rms FROM q WHERE o = 1""")
def b06(spark, d):
    return rounded(fr.representative(ship_series(spark, d), 32, 20), 6, "rms")


@query("b07_renormalize", f"WITH {EMB_SQL}, c AS (SELECT {G}, window_id, n, x - avg(x) OVER (PARTITION BY {G}) AS y FROM emb) SELECT {G}, window_id, n, round(y / max(abs(y)) OVER (PARTITION BY {G}), 9) AS x FROM c")
def b07(spark, d):
    return rounded(co.renormalize_sets(emb_windows(spark, d)), 9, "x").select("group_id", "part", "window_id", "n", "x")


@query("b08_chunks", f"WITH {SHIP_SQL}, {frames_sql(32, 16)} SELECT {G}, CAST(idx AS BIGINT) AS idx, CAST(ntile(4) OVER (PARTITION BY {G} ORDER BY idx) - 1 AS INTEGER) AS chunk FROM frm")
def b08(spark, d):
    return fr.chunks(fr.frame_table(ship_series(spark, d), 32, 16), 4).select("group_id", "part", "idx", "chunk")


@query("b09_clip_range", f"WITH {SHIP_SQL} SELECT {G}, round(quantile_cont(x, 0.005), 6) AS low, round(quantile_cont(x, 0.995), 6) AS high FROM ser GROUP BY {G}")
def b09(spark, d):
    return rounded(co.clip_range(ship_series(spark, d)), 6, "low", "high")


@query("h01_tones", f"WITH {SHIP_SQL} SELECT {G}, n, round(sin(2 * pi() * 5 * n / 64.0::DOUBLE) + 0.4 * sin(2 * pi() * 11 * n / 64.0::DOUBLE + 0.3), 9) + 0 AS x, round((1 + 0.6 * sin(2 * pi() * 2 * n / 64.0::DOUBLE)) * sin(2 * pi() * 17 * n / 64.0::DOUBLE), 9) + 0 AS am FROM ser")
def h01(spark, d):
    """Two tones, and a modulated one, over every record's time."""
    c = F.col("n") / 64.0
    return pick(ship_series(spark, d).select("group_id", "part", "n", (F.round(sy.tones(c, [(5, 1.0, 0.0), (11, 0.4, 0.3)]), 9) + 0).alias("x"), (F.round(sy.amplitude_modulated(c, 17, 2, 0.6), 9) + 0).alias("am")), "x", "am")


def hex_uniform(text: str, turn: int = 0) -> str:
    return f"((('0x' || substr(md5({text}), {1 + 8 * turn}, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def normal_sql(text: str) -> str:
    return f"(sqrt(-2 * ln({hex_uniform(text)})) * cos(2 * pi() * {hex_uniform(text, 1)}))"


@query("h02_white_noise", f"WITH {SHIP_SQL} SELECT {G}, n, round({normal_sql("concat('7:', group_id, ':', part, ':', CAST(n AS VARCHAR))")}, 9) AS x FROM ser")
def h02(spark, d):
    return ship_series(spark, d).select("group_id", "part", "n", F.round(gaussian(7, F.col("group_id"), F.col("part"), F.col("n")), 9).alias("x"))


ID = "concat('11:', group_id, ':', part, ':', CAST(n AS VARCHAR))"


@query("h02_awgn", f"WITH {SHIP_SQL} SELECT {G}, n, round(x + sqrt(avg(x * x) OVER (PARTITION BY {G})) * power(10, -10 / 20.0::DOUBLE) * {normal_sql(ID)}, 5) AS x FROM ser")
def h02a(spark, d):
    return pick(rounded(sy.add_noise(ship_series(spark, d), 10.0, 11), 5, "x"), "x")


@query("h03_quantize", f"WITH {SHIP_SQL}, b AS (SELECT unnest([3, 4, 8, 12]) AS bits), m AS (SELECT {G}, x / 1000 AS x, max(abs(x / 1000)) OVER (PARTITION BY {G}) AS s FROM ser), q AS (SELECT {G}, bits, x, (round_even(CAST((greatest(-1, least(1, x / s)) + 1) / 2 * (2 ** bits - 1) AS DOUBLE), 0) / (2 ** bits - 1) * 2 - 1) * s AS y FROM m, b) SELECT {G}, CAST(bits AS INTEGER) AS bits, round(avg((x - y) * (x - y)), 8) AS mse, round(max(abs(x - y)), 8) AS worst FROM q GROUP BY {G}, bits")
def h03(spark, d):
    """The error of four numbers of bits over every record, in thousands."""
    base = ship_series(spark, d).select("group_id", "part", "n", (F.col("x") / 1000).alias("x"))
    out = None
    for bits in (3, 4, 8, 12):
        e = F.col("x") - F.col("xq")
        one = co.quantize(base, bits).groupBy("group_id", "part").agg(F.lit(bits).alias("bits"), F.round(F.avg(e * e), 8).alias("mse"), F.round(F.max(F.abs(e)), 8).alias("worst"))
        out = one if out is None else out.unionByName(one)
    return out


@query("h03_quantize_records", f"WITH {SHIP_SQL}, m AS (SELECT *, max(abs(x)) OVER (PARTITION BY {G}) AS s FROM ser) SELECT {G}, n, round((round_even(CAST((greatest(-1, least(1, x / s)) + 1) / 2 * 255 AS DOUBLE), 0) / 255 * 2 - 1) * s, 6) AS xq FROM m")
def h03r(spark, d):
    return pick(rounded(co.quantize(ship_series(spark, d), 8), 6, "xq"), "xq")


@query("h04_tone", f"WITH {SHIP_SQL}, t AS (SELECT *, sin(2 * pi() * 5 * (n / 64.0::DOUBLE) + CASE part WHEN 'H' THEN 0 ELSE pi() / 7 END) AS y FROM ser), m AS (SELECT *, sqrt(avg(x * x) OVER w) AS r, sqrt(avg(y * y) OVER w) AS o FROM t WINDOW w AS (PARTITION BY {G})) SELECT {G}, n, round(x + y * (r / power(10, 6 / 20.0::DOUBLE) / o), 5) AS x FROM m")
def h04(spark, d):
    return pick(rounded(sy.add_tone(ship_series(spark, d), 64.0, 5.0, 6.0), 5, "x"), "x")


ID5 = "concat('5:', group_id, ':', part, ':', CAST(n AS VARCHAR))"


@query("h05_impulses", f"WITH {SHIP_SQL}, t AS (SELECT *, {hex_uniform(ID5)} AS u, {hex_uniform(ID5, 1)} AS v, count(*) OVER (PARTITION BY {G}) AS c, sqrt(avg(x * x) OVER (PARTITION BY {G})) AS r FROM ser), m AS (SELECT *, row_number() OVER (PARTITION BY {G} ORDER BY u, n) AS o FROM t) SELECT {G}, n, round(x + CASE WHEN o <= greatest(1, round_even(CAST(c * 0.02::DOUBLE AS DOUBLE), 0)) THEN (CASE WHEN v < 0.5 THEN -1 ELSE 1 END) * 6 * r ELSE 0 END, 5) AS x FROM m")
def h05(spark, d):
    return pick(rounded(sy.add_impulses(ship_series(spark, d), 0.02, 6.0, 5), 5, "x"), "x")


@query("h06_cap_per_group", "SELECT group_id, window_id FROM (SELECT concat('u_', CAST(user_id AS VARCHAR)) AS group_id, event_id AS window_id, row_number() OVER (PARTITION BY user_id ORDER BY md5(concat('42:', CAST(event_id AS VARCHAR))), event_id) AS r FROM events) WHERE r <= 10")
def h06(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("u_"), F.col("user_id").cast("string")).alias("group_id"), F.col("event_id").alias("window_id"))
    return sy.cap_per_group(rows, 10, 42)


@query("h07_controls", f"""WITH {SHIP_SQL}, l AS (SELECT group_id AS g, part AS p, n, n / 40e6::DOUBLE AS t, count(*) OVER (PARTITION BY {G}) / 40e6::DOUBLE AS span FROM ser), k AS (
SELECT g, p, 'noise' AS group_id, n, {normal_sql("concat('42:noise:', g, ':', p, ':', CAST(n AS VARCHAR))")} AS x FROM l UNION ALL SELECT g, p, 'tone_1mhz', n, sin(2 * pi() * 1e6 * t) FROM l UNION ALL SELECT g, p, 'tone_10_5mhz', n, sin(2 * pi() * 10.5e6 * t) FROM l
UNION ALL SELECT g, p, 'two_tones', n, sin(2 * pi() * 4e6 * t) + 0.7 * sin(2 * pi() * 12e6 * t) FROM l UNION ALL SELECT g, p, 'am', n, (1 + 0.6 * sin(2 * pi() * 200e3 * t)) * sin(2 * pi() * 8e6 * t) FROM l
UNION ALL SELECT g, p, 'chirp', n, sin(2 * pi() * (4e6 * t + 0.5 * ((16e6 - 4e6) / span) * t * t)) FROM l),
q AS (SELECT g, p, group_id, 'L' AS part, x FROM k UNION ALL SELECT g, p, group_id, 'H', 0.98 * x + 0.02 * {normal_sql("concat('43:', g, ':', p, ':', group_id, ':', CAST(n AS VARCHAR))")} FROM k)
SELECT g, p, group_id, part, count(*) AS n, round(sqrt(avg(x * x)), 6) AS rms, round(max(abs(x)), 6) AS peak FROM q GROUP BY g, p, group_id, part""")
def h07(spark, d):
    """The six controls over the time of every record."""
    x = F.col("x")
    s = ship_series(spark, d).select(F.col("group_id").alias("g"), F.col("part").alias("p"), "n")
    span = s.groupBy("g", "p").agg((F.count("*") / 40e6).alias("span"))
    axis = s.join(co.by_record(span), ["g", "p"]).withColumn("t", F.col("n") / 40e6)
    return sy.controls_over(axis, ["g", "p"]).groupBy("g", "p", "group_id", "part").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(x * x)), 6).alias("rms"), F.round(F.max(F.abs(x)), 6).alias("peak"))


#: The sweeps' windows: a row for each value and sample.
SWEEP_N = 200


def mag_sql(key: str) -> str:
    """Hann spectra of windows w (key, fs, n, x) of 200 samples, their largest frequency and its contrast."""
    hann = "(0.5::DOUBLE - 0.5 * cos(2 * pi() * n / 200))"
    return f"""ms AS (SELECT {key}, fs, k, sum(x * {hann} * cos(2 * pi() * ((k * n) % 200) / 200)) AS re, sum(x * {hann} * sin(2 * pi() * ((k * n) % 200) / 200)) AS im FROM w CROSS JOIN (SELECT unnest(range(101)) AS k) GROUP BY {key}, fs, k),
mg AS MATERIALIZED (SELECT {key}, fs, k, (CASE WHEN k IN (0, 100) THEN 1 ELSE 2 END) * sqrt(re * re + im * im) / 100 AS m FROM ms),
pk AS (SELECT {key}, fs, k, m, median(m) OVER (PARTITION BY {key}) AS fl, row_number() OVER (PARTITION BY {key} ORDER BY round(m, 9) DESC, k) AS r FROM mg)"""


#: Suppliers whose samples one task makes.
SUPPLIERS = 2000


def suppliers(spark, d):
    """The keys of all suppliers, dealt to tasks by their number: each of a small table's rows becomes hundreds of samples, which the table's size doesn't tell of."""
    keys = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey").where("s_suppkey is not null")
    return keys.repartition(max(spark.sparkContext.defaultParallelism, math.ceil(keys.count() / SUPPLIERS)), "s_suppkey")


def numbers_to(size: int):
    return F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))


def noisy(size: int, at, snr_db):
    """The numbers that at(n) gives for n below size, as an array, with noise of their own power less snr_db (a number or a column). Made in the supplier's row: no table of samples is
    joined, and the RMS is found once a row."""
    level = F.pow(F.lit(10.0), -snr_db / 20) if isinstance(snr_db, Column) else F.lit(10 ** (-snr_db / 20))
    n = numbers_to(size)
    mixed = lambda total: F.transform(n, lambda i: at(i) + F.sqrt(total / size) * level * gaussian(3, F.col("s_suppkey"), i))
    return F.aggregate(F.transform(n, at), F.lit(0.0), lambda a, v: a + v * v, mixed)


def swept(rows, expected, *keep):
    """(s_suppkey, fs, keep, expected_hz, peak_hz, error_hz, contrast_db) of the suppliers' windows as arrays: s_suppkey, fs, win. Narrow."""
    mag = kernels.spectrum_arrays(rows, "magnitude", lambda x: kernels.fft_batch(x, float(SWEEP_N), SWEEP_N, "hann"), ["s_suppkey", "fs", *keep])
    digits = F.transform("magnitude", lambda v: F.round(v, 9))
    place = first_max(digits)
    floor = F.array_sort("magnitude")[SWEEP_N // 4]  # the middle of SWEEP_N / 2 + 1 values
    top = F.element_at("magnitude", (place + 1).cast("int"))
    peak_hz = place * F.col("fs") / SWEEP_N
    return mag.select("s_suppkey", "fs", *keep, expected.alias("expected_hz"), peak_hz.alias("peak_hz"), F.round(F.abs(peak_hz - expected), 6).alias("error_hz"), (20 * F.log10((top + 1e-12) / (floor + 1e-12))).alias("contrast_db"))


@query("h08_rate_sweep", "WITH w AS (SELECT s_suppkey, 700 + 300.0::DOUBLE * (s_suppkey % 12) AS fs, n, sin(2 * pi() * 450 * (n / (700 + 300.0::DOUBLE * (s_suppkey % 12)))) AS x FROM supplier, range(200) t(n)), " + mag_sql("s_suppkey") + ", e AS (SELECT s_suppkey, fs, round(abs(((450 + fs / 2) % fs) - fs / 2), 6) AS expected_hz, k * fs / 200 AS peak_hz FROM pk WHERE r = 1) SELECT s_suppkey, fs, expected_hz, peak_hz, round(abs(peak_hz - expected_hz), 6) AS error_hz, 450 > fs / 2 AS aliased FROM e")
def h08(spark, d):
    """A tone of 450 Hz at every supplier's rate: where it appears, and whether it is an alias."""
    rates = suppliers(spark, d).distinct().select("s_suppkey", (700 + 300.0 * (F.col("s_suppkey") % 12)).alias("fs"))
    w = rates.select("s_suppkey", "fs", F.transform(numbers_to(SWEEP_N), lambda n: sy.tone(n / F.col("fs"), 450.0)).alias("win"))
    out = swept(w, F.round(sp.alias_frequency(F.lit(450.0), F.col("fs")), 6))
    return out.select("s_suppkey", "fs", "expected_hz", "peak_hz", "error_hz", (F.lit(450.0) > F.col("fs") / 2).alias("aliased"))


SWEEP_NOISE = normal_sql("concat('3:', CAST(snr AS VARCHAR), ':', CAST(n AS VARCHAR))")


@query("h08_snr_sweep", f"WITH s AS (SELECT s_suppkey AS snr, s_suppkey % 46 - 5 AS db, n, sin(2 * pi() * 450 * (n / 2000.0::DOUBLE)) AS t FROM supplier, range(200) r(n)), w AS (SELECT snr, 2000.0::DOUBLE AS fs, n, t + sqrt(avg(t * t) OVER (PARTITION BY snr)) * power(10, -db / 20.0::DOUBLE) * {SWEEP_NOISE} AS x FROM s), {mag_sql('snr')} SELECT snr AS s_suppkey, k * fs / 200 AS peak_hz, round(abs(k * fs / 200 - 450), 6) AS error_hz, round(20 * log10((m + 1e-12) / (fl + 1e-12)), 6) AS contrast_db FROM pk WHERE r = 1")
def h08n(spark, d):
    """The same tone in noise, at every supplier's level and seed: how well its peak is found."""
    win = noisy(SWEEP_N, lambda n: sy.tone(n / 2000.0, 450.0), F.col("s_suppkey") % 46 - 5)
    w = suppliers(spark, d).distinct().select("s_suppkey", F.lit(2000.0).alias("fs"), win.alias("win"))
    return rounded(swept(w, F.lit(450.0)).drop("expected_hz", "fs"), 6, "contrast_db")


@query("h08_bit_sweep", f"WITH s AS (SELECT s_suppkey, 2 + s_suppkey % 11 AS bits, n, sin(2 * pi() * (100 + s_suppkey % 700) * (n / 2000.0::DOUBLE)) AS t FROM supplier, range(200) r(n)), w AS (SELECT s_suppkey, bits, 2000.0::DOUBLE AS fs, n, t, (round_even(CAST((greatest(-1, least(1, t / s)) + 1) / 2 * (2 ** bits - 1) AS DOUBLE), 0) / (2 ** bits - 1) * 2 - 1) * s AS x FROM (SELECT *, max(abs(t)) OVER (PARTITION BY s_suppkey) AS s FROM s)), e AS (SELECT s_suppkey, bits, avg((t - x) * (t - x)) AS mse FROM w GROUP BY s_suppkey, bits), {mag_sql('s_suppkey')} SELECT s_suppkey, CAST(bits AS INTEGER) AS bits, k * fs / 200 AS peak_hz, round(mse, 10) AS mse FROM pk JOIN e USING (s_suppkey) WHERE r = 1")
def h08b(spark, d):
    """Every supplier's tone on few levels: its peak and the error of quantising."""
    bits = (2 + F.col("s_suppkey") % 11).cast("int")
    t = F.transform(numbers_to(SWEEP_N), lambda n: sy.tone(n / 2000.0, 100 + F.col("s_suppkey") % 700))
    w = suppliers(spark, d).distinct().select("s_suppkey", bits.alias("bits"), F.lit(2000.0).alias("fs"), t.alias("t"))
    top = F.aggregate("t", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v)), lambda s: F.transform("t", lambda v: co.on_levels(v, s, F.pow(F.lit(2.0), F.col("bits")) - 1)))
    w = w.withColumn("win", top)
    off = F.aggregate(F.zip_with("t", "win", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v) / SWEEP_N
    w = w.select("s_suppkey", "bits", "fs", "win", F.round(off, 10).alias("mse"))
    return swept(w, F.lit(450.0), "bits", "mse").select("s_suppkey", "peak_hz", "bits", "mse")


@query("h09_recovery", f"""WITH s AS (SELECT s_suppkey AS v, 100 + s_suppkey % 300 AS hz, n, sin(2 * pi() * (100 + s_suppkey % 300) * n / 2000.0::DOUBLE) AS a FROM supplier, range(500) t(n)), y AS (SELECT v, n, a + 0.4 * sin(2 * pi() * 620 * n / 2000.0::DOUBLE) AS t FROM s), z AS (SELECT v, n, t + sqrt(avg(t * t) OVER (PARTITION BY v)) * power(10, -10 / 20.0::DOUBLE) * {normal_sql("concat('3:', CAST(v AS VARCHAR), ':', CAST(n AS VARCHAR))")} AS x FROM y),
sg AS (SELECT v, g, n - 64 * g AS m, x FROM z JOIN (SELECT unnest(range(6)) AS g) ON n >= 64 * g AND n < 64 * g + 128), dt AS (SELECT v, g, m, (x - avg(x) OVER (PARTITION BY v, g)) * (0.5::DOUBLE - 0.5 * cos(2 * pi() * m / 128)) AS x FROM sg),
fm AS (SELECT v, g, k, power(sum(x * cos(2 * pi() * ((k * m) % 128) / 128)), 2) + power(sum(x * sin(2 * pi() * ((k * m) % 128) / 128)), 2) AS p FROM dt CROSS JOIN (SELECT unnest(range(65)) AS k) GROUP BY v, g, k), pw AS (SELECT v, k, avg(p) * (CASE WHEN k IN (0, 64) THEN 1 ELSE 2 END) AS p FROM fm GROUP BY v, k)
SELECT v AS s_suppkey, (100 + v % 300) * 1.0::DOUBLE AS expected_hz, arg_max(k, round(p, 6)) * 15.625::DOUBLE AS estimated_hz, abs(arg_max(k, round(p, 6)) * 15.625::DOUBLE - (100 + v % 300)) AS error_hz FROM pw GROUP BY v""")
def h09r(spark, d):
    """Every supplier's tone in a noisy sum of two, by Welch: the frequency found."""
    hz = 100 + F.col("s_suppkey") % 300
    win = noisy(500, lambda n: sy.tone(n / 2000.0, hz) + sy.tone(n / 2000.0, 620.0, 0.4), 10.0)
    w = suppliers(spark, d).distinct().select("s_suppkey", win.alias("win"))
    psd = kernels.welch_arrays(w, 2000.0, 128, 64, "hann", ("s_suppkey",))
    found = first_max(F.transform("psd", lambda v: F.round(v, 9))) * (2000.0 / 128)
    return psd.select("s_suppkey", hz.cast("double").alias("expected_hz"), found.alias("estimated_hz"), F.abs(found - hz).alias("error_hz"))


@query("h09_noisy_tone", f"WITH s AS (SELECT s_suppkey, n, sin(2 * pi() * 180 * n / 2000.0::DOUBLE) AS x FROM supplier, range(500) t(n)), y AS (SELECT s_suppkey, n, x + sqrt(avg(x * x) OVER (PARTITION BY s_suppkey)) * power(10, -5 / 20.0::DOUBLE) * {normal_sql("concat('3:', CAST(s_suppkey AS VARCHAR), ':', CAST(n AS VARCHAR))")} AS x FROM s) SELECT s_suppkey, round(avg(x * x), 6) AS power, round(max(abs(x)), 6) AS peak, count(*) AS samples FROM y GROUP BY s_suppkey")
def h09(spark, d):
    """Every supplier's tone in noise: its power, peak and length."""
    x = F.col("x")
    y = suppliers(spark, d).select("s_suppkey", F.explode(noisy(500, lambda n: sy.tone(n / 2000.0, 180.0), 5.0)).alias("x"))
    return y.groupBy("s_suppkey").agg(F.round(F.avg(x * x), 6).alias("power"), F.round(F.max(F.abs(x)), 6).alias("peak"), F.count("*").alias("samples"))


@query("m_frames_in_sql", f"WITH {SHIP_SQL} SELECT group_id, part, CAST(i AS BIGINT) AS idx, n, n - 8 * i AS m, x FROM ser JOIN (SELECT unnest(range(2000)) AS i) f ON n BETWEEN 8 * i AND 8 * i + 15 JOIN (SELECT group_id AS g, part AS p, count(*) AS size FROM ser GROUP BY ALL) l ON group_id = g AND part = p AND 8 * i + 16 <= size")
def m_frames(spark, d):
    """Frames by a table function in SQL, over parts in the order of their samples."""
    udtfs.register(spark)
    s = ship_series(spark, d).select("group_id", "part", "n", "x")
    return spark.sql("SELECT * FROM frames(TABLE(SELECT * FROM {samples}) PARTITION BY (group_id, part) ORDER BY (n), 16, 8)", samples=s)


@query("m_perturbation_in_sql", f"WITH {SHIP_SQL}, t AS (SELECT *, 0.8 * max(abs(x)) OVER (PARTITION BY group_id, part) AS top FROM ser) SELECT group_id, part, n, round(least(greatest(x, -top), top), 6) AS x FROM t")
def m_perturbation(spark, d):
    """A user's function, registered by name: samples clipped at a share of their part's largest."""
    udtfs.register(spark, {"clipped": lambda x, share: x.clip(-abs(x).max() * share, abs(x).max() * share)})
    s = ship_series(spark, d).select("group_id", "part", "n", "x")
    return rounded(spark.sql("SELECT * FROM clipped(TABLE(SELECT * FROM {samples}) PARTITION BY (group_id, part) ORDER BY (n), 0.8)", samples=s), 6, "x")
