"""Queries of filters, sources, relational plumbing, folds and replay."""

from __future__ import annotations

import math
import uuid

import pandas as pd

from pyspark.sql import Window
from pyspark.sql import functions as F

from spectrel.functions.columns import finite_or, is_finite, mapped
from spectrel.functions.tables import shared_folder, stored, written
from spectrel.operators import conditioning as co
from spectrel.operators import decision as de
from spectrel.operators import filters as fi
from spectrel.operators import learning as le
from spectrel.operators import ranks, robust
from spectrel.plans import fixtures
from spectrel.plans.decision_queries import ACTIVITY, BIN, GROUP_CTES, REJECTION, SCORE_COLUMNS, THRESHOLD, binary, group_scores, top
from spectrel.plans.fixtures import SHIP_SQL, USER_SQL, manifest as recordings, one_line_series, series_user, ship_series, table
from spectrel.plans.registry import query
from spectrel.plans.spectral_queries import FEATURE_CTES, features4, rounded
from spectrel.sources import names as na
from spectrel.sources import readers as rd
from spectrel.sources import sinks as sk
from spectrel.streaming import live, replay

G = "group_id, part"
TAPS = [float(v) for v in fi.design_fir("lowpass", 64.0, 8.0, 9)]
FIR_SQL = "h AS (SELECT i, CASE WHEN i = 4 THEN 0.25::DOUBLE ELSE sin(pi() * 0.25 * (i - 4)) / (pi() * (i - 4)) END * (0.54 - 0.46 * cos(2 * pi() * i / 8)) AS v FROM range(9) t(i)), taps AS (SELECT i, v / (SELECT sum(v) FROM h) AS v FROM h)"


#: A lowpass of nine taps for every supplier, at 64 Hz.
SUPPLIER_FIR_SQL = "hs AS (SELECT s_suppkey, i, CASE WHEN i = 4 THEN 2 * c / 64 ELSE sin(pi() * 2 * c / 64 * (i - 4)) / (pi() * (i - 4)) END * (0.54 - 0.46 * cos(2 * pi() * i / 8)) AS v FROM (SELECT s_suppkey, 2.0::DOUBLE + s_suppkey % 28 AS c FROM supplier) CROSS JOIN range(9) t(i)), tps AS (SELECT s_suppkey, i, v / sum(v) OVER (PARTITION BY s_suppkey) AS v FROM hs)"


def supplier_fir(spark, d):
    cut = table(spark, d, "supplier").select("s_suppkey", (F.lit(2.0) + F.col("s_suppkey") % 28).alias("cut"))
    return fi.designed(cut, ["s_suppkey"], lambda row: (fi.design_fir("lowpass", 64.0, float(row.cut), 9), [1.0]))


@query("g14_fir_taps", f"WITH {SUPPLIER_FIR_SQL} SELECT s_suppkey, CAST(i AS INTEGER) AS i, round(v, 9) + 0 AS tap FROM tps")
def g14(spark, d):
    return supplier_fir(spark, d).select("s_suppkey", "i", (F.round("b", 9) + 0).alias("tap"))


@query("g16_fir_filter", f"WITH {SHIP_SQL}, {FIR_SQL} SELECT a.group_id, a.part, a.n, round(sum(b.x * v), 4) AS y FROM ser a JOIN taps ON true JOIN ser b ON a.group_id = b.group_id AND a.part = b.part AND b.n = a.n - taps.i GROUP BY 1, 2, 3")
def g16(spark, d):
    return rounded(fi.apply_fir(ship_series(spark, d), TAPS), 4, "y").select("group_id", "part", "n", "y")


IIR = fi.design_iir("lowpass", 64.0, 8.0, 4)


def recursion_sql(name: str, source: str, b, a, first) -> str:
    """A recursive table: the transposed direct form over source (group_id, part, m from 0, x), from the state first * x0."""
    n = len(a) - 1
    v = lambda x: repr(float(x)) + "::DOUBLE"
    y = lambda x, d: f"({v(b[0])} * {x} + {d[0]})"
    after = lambda x, d: ", ".join(f"{(d[i + 1] + ' + ') if i + 1 < n else ''}{v(b[i + 1])} * {x} - {v(a[i + 1])} * {y(x, d)} AS d{i}" for i in range(n))
    start, on = [f"{v(z)} * x" for z in first], [f"r.d{i}" for i in range(n)]
    return f"{name} AS (SELECT group_id, part, m, {y('x', start)} AS y, {after('x', start)} FROM {source} WHERE m = 0 UNION ALL SELECT e.group_id, e.part, e.m, {y('e.x', on)} AS y, {after('e.x', on)} FROM {name} r JOIN {source} e ON e.group_id = r.group_id AND e.part = r.part AND e.m = r.m + 1)"


ZI = fi.steady_state(*[fi.np.asarray(v, dtype=float) for v in IIR])
IIR_SQL = f"""WITH RECURSIVE {SHIP_SQL}, sr AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY {G}) AS len, first_value(x) OVER (PARTITION BY {G} ORDER BY n) AS x0, first_value(x) OVER (PARTITION BY {G} ORDER BY n DESC) AS x1 FROM ser),
ext AS MATERIALIZED (SELECT {G}, n + 15 AS m, x FROM sr UNION ALL SELECT {G}, 15 - n, 2 * x0 - x FROM sr WHERE n BETWEEN 1 AND 15 UNION ALL SELECT {G}, 15 + 2 * (len - 1) - n, 2 * x1 - x FROM sr WHERE n BETWEEN len - 16 AND len - 2),
{recursion_sql('fw', 'ext', *IIR, ZI)}, rv AS MATERIALIZED (SELECT fw.group_id, fw.part, t.top - fw.m AS m, y AS x FROM fw JOIN (SELECT {G}, max(m) AS top FROM ext GROUP BY {G}) t ON fw.group_id = t.group_id AND fw.part = t.part), {recursion_sql('bw', 'rv', *IIR, ZI)}"""


@query("g16_iir_filter", IIR_SQL + f" SELECT bw.group_id, bw.part, len + 14 - m AS n, round(y, 4) + 0 AS y FROM bw JOIN (SELECT {G}, max(len) AS len FROM sr GROUP BY {G}) l ON bw.group_id = l.group_id AND bw.part = l.part WHERE m BETWEEN 15 AND len + 14")
def g16i(spark, d):
    """Forward and backward, in blocks of 96 samples between which states are carried."""
    out = fi.apply_iir(ship_series(spark, d), *IIR, block=96)
    return out.select("group_id", "part", "n", (F.round("y", 4) + 0).alias("y"))


@query("g16_iir_causal", f"WITH RECURSIVE {SHIP_SQL}, ext AS MATERIALIZED (SELECT {G}, n AS m, x FROM ser), {recursion_sql('fw', 'ext', *IIR, [0.0] * 4)} SELECT {G}, m AS n, round(y, 4) + 0 AS y FROM fw")
def g16c(spark, d):
    out = fi.apply_iir(ship_series(spark, d), *IIR, zero_phase=False, block=64)
    return out.select("group_id", "part", "n", (F.round("y", 4) + 0).alias("y"))


@query("g17_freq_response", f"WITH {SUPPLIER_FIR_SQL}, r AS (SELECT s_suppkey, k, sum(v * cos(pi() * k * i / 64)) AS re, -sum(v * sin(pi() * k * i / 64)) AS im FROM tps CROSS JOIN range(64) t(k) GROUP BY s_suppkey, k) SELECT s_suppkey, CAST(k AS BIGINT) AS k, k * 0.5::DOUBLE AS freq_hz, round(re, 9) + 0 AS re, round(im, 9) + 0 AS im, round(sqrt(re * re + im * im), 9) AS magnitude FROM r")
def g17(spark, d):
    out = fi.responses(supplier_fir(spark, d), ["s_suppkey"], 64.0, 64)
    return out.withColumns({c: F.round(c, 9) + 0 for c in ("re", "im", "magnitude")})


@query("g19_iir_response", "WITH w AS (SELECT s_suppkey, k, pi() * k / 64 AS w, 0.1 + 0.1 * (s_suppkey % 8) AS p FROM supplier CROSS JOIN range(64) t(k)), c AS (SELECT s_suppkey, k, 0.2 + 0.3 * cos(w) + 0.1 * cos(2 * w) AS br, -0.3 * sin(w) - 0.1 * sin(2 * w) AS bi, 1 - p * cos(w) AS ar, p * sin(w) AS ai FROM w) SELECT s_suppkey, CAST(k AS BIGINT) AS k, round((br * ar + bi * ai) / (ar * ar + ai * ai), 9) + 0 AS re, round((bi * ar - br * ai) / (ar * ar + ai * ai), 9) + 0 AS im FROM c")
def g19(spark, d):
    """One pole for every supplier, at a place of its own."""
    b = F.array(F.struct(F.lit(0).alias("i"), F.lit(0.2).alias("b"), F.lit(1.0).alias("a")), F.struct(F.lit(1).alias("i"), F.lit(0.3).alias("b"), (-(F.lit(0.1) + 0.1 * (F.col("s_suppkey") % 8))).alias("a")), F.struct(F.lit(2).alias("i"), F.lit(0.1).alias("b"), F.lit(0.0).alias("a")))
    out = fi.responses(table(spark, d, "supplier").select("s_suppkey", F.inline(b)), ["s_suppkey"], 64.0, 64)
    return out.select("s_suppkey", "k", *[(F.round(c, 9) + 0).alias(c) for c in ("re", "im")])


#: The poles in closed form: the analog prototype's, moved to the band, by the bilinear transform; zeros at 1 and -1.
POLES_SQL = """WITH e AS (SELECT s_suppkey, 4 * tan(pi() * (5e6::DOUBLE + (s_suppkey % 10) * 1e6) / 40e6) AS w1, 4 * tan(pi() * (6.5e6::DOUBLE + (s_suppkey % 10) * 1e6) / 40e6) AS w2 FROM supplier),
p AS (SELECT s_suppkey, cos(pi() * (2 * k + 3) / 8) * (w2 - w1) / 2 AS a, sin(pi() * (2 * k + 3) / 8) * (w2 - w1) / 2 AS b, w1 * w2 AS q FROM e, range(1, 5) t(k)),
s AS (SELECT s_suppkey, a, b, a * a - b * b - q AS u, 2 * a * b AS v FROM p), r AS (SELECT s_suppkey, a, b, sqrt((sqrt(u * u + v * v) + u) / 2) AS x, CASE WHEN v < 0 THEN -1 ELSE 1 END * sqrt((sqrt(u * u + v * v) - u) / 2) AS y FROM s),
z AS (SELECT s_suppkey, a + f * x AS a, b + f * y AS b FROM r, (SELECT unnest([1, -1]) AS f)), o AS (SELECT s_suppkey, 'pole' AS kind, (16 - a * a - b * b) / ((4 - a) * (4 - a) + b * b) AS re, 8 * b / ((4 - a) * (4 - a) + b * b) AS im FROM z UNION ALL SELECT s_suppkey, 'zero', unnest([1, 1, 1, 1, -1, -1, -1, -1]), 0 FROM supplier)
SELECT s_suppkey, kind, round(re, CASE kind WHEN 'pole' THEN 5 ELSE 2 END) + 0 AS re, round(im, CASE kind WHEN 'pole' THEN 5 ELSE 2 END) + 0 AS im, bool_and(re * re + im * im < 1) FILTER (WHERE kind = 'pole') OVER (PARTITION BY s_suppkey) AS stable FROM o"""


@query("g18_zeros_poles", POLES_SQL)
def g18(spark, d):
    """Of a bandpass for every supplier; its zeros are fourfold, which roots of a polynomial show to two decimals."""
    edges = table(spark, d, "supplier").select("s_suppkey", (F.lit(5e6) + (F.col("s_suppkey") % 10) * 1e6).alias("low"))

    def run(frames):
        known = {}
        for frame in frames:
            out = []
            for key, low in frame.itertuples(index=False):
                if low not in known:
                    b, a = fi.design_iir("bandpass", 40e6, [low, low + 1.5e6], 4)
                    z, p = fi.zeros_and_poles(b, a)
                    known[low] = [(kind, round(float(v.real), k) + 0.0, round(float(v.imag), k) + 0.0, fi.is_stable(a)) for kind, roots, k in (("zero", z, 2), ("pole", p, 5)) for v in roots]
                out += [(key, *r) for r in known[low]]
            yield pd.DataFrame(out, columns=["s_suppkey", "kind", "re", "im", "stable"])

    return edges.mapInPandas(run, "s_suppkey long, kind string, re double, im double, stable boolean")


#: Paths made of suppliers and lines, and some from pages' URLs.
PATHS = "(select distinct concat('raw/', lpad(cast(l_suppkey as {s}), 5, '0'), case when l_linenumber % 2 = 0 then 'l' else 'H' end, '_', cast(l_linenumber as {s}), case when l_linenumber = 1 then '' else '.csv' end) as path from {l} union select url from {p} union select concat('data/no_drone/', lang, '_x.NPY') from {o} union select concat('data/set/Bebop_', lang, '.txt') from {o})"
PATHS_SQL = "pth AS " + PATHS.format(s="varchar", l="lineitem", p="pages", o="documents")
NAME, STEM = "regexp_extract(path, '[^/]*$')", "regexp_replace(regexp_extract(path, '[^/]*$'), '^(.+)\\.[^.]*$', '\\1')"
FOLDER = "lower(coalesce(string_split(path, '/')[-2], ''))"


def paths(spark, d):
    tables = {k: table(spark, d, n) for k, n in (("l", "lineitem"), ("p", "pages"), ("o", "documents"))}
    return spark.sql(PATHS.format(s="string", l="{l}", p="{p}", o="{o}")[1:-1], **tables)


def terms(where: str, words) -> str:
    return "(" + " OR ".join(f"contains({w}, '{t}')" for t in words for w in where.split("|")) + ")"


@query("a02_supported", f"WITH {PATHS_SQL} SELECT path, lower(regexp_extract({NAME}, '^.+(\\.[^.]*)$', 1)) IN ('.csv', '.mat', '.npy', '.npz', '.txt') OR regexp_matches({STEM}, '(?i)^(\\d{{5}})([LH])_(\\d+)$') AS supported FROM pth")
def a02(spark, d):
    return paths(spark, d).select("path", na.is_supported(F.col("path")).alias("supported"))


@query("a03_parse_names", f"WITH {PATHS_SQL}, q AS (SELECT path, nullif(regexp_extract({STEM}, '(?i)^(\\d{{5}})([LH])_(\\d+)$', 1), '') AS code, upper(nullif(regexp_extract({STEM}, '(?i)^(\\d{{5}})([LH])_(\\d+)$', 2), '')) AS part, nullif(regexp_extract({STEM}, '(?i)^(\\d{{5}})([LH])_(\\d+)$', 3), '') AS segment FROM pth) SELECT *, code || '_' || segment AS segment_id FROM q")
def a03(spark, d):
    return paths(spark, d).select("path", *[v.alias(k) for k, v in na.parsed(F.col("path")).items()])


LABEL_SQL = f"CASE WHEN regexp_matches({STEM}, '(?i)^00000[LH]_\\d+$') THEN 'background' WHEN regexp_matches({STEM}, '(?i)^\\d{{5}}[LH]_\\d+$') THEN 'target' WHEN {terms('lower(' + NAME + ')|' + FOLDER, na.BACKGROUND_TERMS)} THEN 'background' WHEN contains(lower({NAME}), 'drone') OR {terms('lower(' + NAME + ')|' + FOLDER, na.MODEL_TERMS)} THEN 'target' ELSE 'unknown' END"


@query("a04_infer_label", f"WITH {PATHS_SQL} SELECT path, {LABEL_SQL} AS label FROM pth")
def a04(spark, d):
    return paths(spark, d).select("path", na.inferred_label(F.col("path")).alias("label"))


@query("a05_manifest", f"WITH {PATHS_SQL} SELECT path, {LABEL_SQL} AS label, CASE WHEN regexp_matches({STEM}, '(?i)^\\d{{5}}[LH]_\\d+$') THEN 'rec_' || regexp_extract({STEM}, '^(\\d{{5}})', 1) || '_' || regexp_extract({STEM}, '(\\d+)$', 1) ELSE regexp_replace(path, '\\.[^./]*$', '') END AS group_id, lower(regexp_extract({NAME}, '^.+(\\.[^.]*)$', 1)) AS suffix, regexp_extract({STEM}, '(?i)^(\\d{{5}})[LH]_\\d+$', 1) AS code, upper(regexp_extract({STEM}, '(?i)^\\d{{5}}([LH])_\\d+$', 1)) AS part, regexp_extract({STEM}, '(?i)^\\d{{5}}[LH]_(\\d+)$', 1) AS segment FROM pth")
def a05(spark, d):
    return na.manifest(paths(spark, d))


#: A line of numbers for each supplier.
LINES_SQL = "ln AS (SELECT l_suppkey AS k, string_agg(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), ', ' ORDER BY l_orderkey, l_linenumber, l_quantity) AS v FROM lineitem GROUP BY l_suppkey)"


def lines(spark, d, end: str):
    item = F.struct("l_orderkey", "l_linenumber", "l_quantity")
    text = F.transform(F.array_sort(F.collect_list(item)), lambda s: F.concat(s["l_quantity"].cast("int").cast("string"), F.lit(end)))
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(text.alias("v"))


@query("a07_text_numbers", f"WITH {LINES_SQL}, x AS (SELECT k, CAST(unnest(string_split(v, ', ')) AS DOUBLE) AS x FROM ln) SELECT k, count(*) + CASE WHEN k % 3 = 1 THEN 4 ELSE 0 END AS samples, sum(x) + CASE WHEN k % 3 = 1 THEN 7 ELSE 0 END AS total FROM x GROUP BY k")
def a07(spark, d):
    """Texts with a header row, with a first row of nan and inf, and without either."""
    first = F.when(F.col("k") % 3 == 0, "value_a, value_b\n").when(F.col("k") % 3 == 1, "nan, inf\n7;-Infinity ").otherwise("")
    text = lines(spark, d, "").select("k", F.concat(first, F.array_join("v", ", ")).alias("v"))
    x = text.select("k", rd.numbers(F.col("v")).alias("x"))
    return x.select("k", F.size("x").cast("long").alias("samples"), F.aggregate("x", F.lit(0.0), lambda a, v: a + F.when(is_finite(v), v).otherwise(0.0)).alias("total"))


@query("a07_one_line_files", f"WITH {SHIP_SQL} SELECT group_id, part, n, x FROM ser")
def a07_files(spark, d):
    """Series written as files of one line and read again by byte ranges, cut at commas; numbered by the counts of the ranges and the index of the series."""
    return one_line_series(spark, d).select("group_id", "part", "n", "x")


@query("a08_one_line_files", f"WITH {SHIP_SQL} SELECT group_id, part, count(*) AS samples, CAST(sum(CAST(floor(x / 10) AS BIGINT)) AS BIGINT) AS total, CAST(sum(n * CAST(floor(x / 10) AS BIGINT)) AS BIGINT) AS moment FROM ser GROUP BY group_id, part")
def a08_files(spark, d):
    """Strict integers with six zero decimals from files of one line: count, sum and first moment by record."""
    whole = F.concat(F.floor(F.col("x") / 10).cast("long").cast("string"), F.lit(".000000"))
    s = one_line_series(spark, d, whole).withColumn("x", F.col("x").cast("long"))
    return s.groupBy("group_id", "part").agg(F.count("*").alias("samples"), F.sum("x").alias("total"), F.sum(F.col("n") * F.col("x")).alias("moment"))


@query("a08_strict_integers", f"WITH {LINES_SQL}, x AS (SELECT k, CAST(unnest(string_split(v, ', ')) AS INTEGER) AS x FROM ln) SELECT k, count(*) AS samples, CAST(sum(x) AS BIGINT) AS total FROM x GROUP BY k")
def a08(spark, d):
    text = lines(spark, d, ".000000").select("k", F.concat(F.array_join("v", ","), F.lit(",")).alias("v"))
    return text.select("k", rd.strict_integers(F.col("v")).alias("x")).select("k", F.size("x").cast("long").alias("samples"), F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query("a09_complex_power", "SELECT l_orderkey, round(sum(l_quantity * l_quantity + l_tax * l_tax), 6) AS power FROM lineitem GROUP BY l_orderkey")
def a09(spark, d):
    z = rd.complex_pairs(table(spark, d, "lineitem"), ("l_quantity", "l_tax"))
    return z.groupBy("l_orderkey").agg(F.round(F.sum(F.col("z.re") * F.col("z.re") + F.col("z.im") * F.col("z.im")), 6).alias("power"))


@query("a10_load_record", f"WITH {USER_SQL}, m AS (SELECT DISTINCT group_id FROM ser WHERE label = 'target') SELECT {G}, n, round(x / greatest(max(abs(x)) OVER (PARTITION BY {G}), 1e-12), 9) AS x FROM ser JOIN m USING (group_id)")
def a10(spark, d):
    s = series_user(spark, d)
    wanted = s.where("label = 'target'").select("group_id").distinct()
    return rounded(co.normalize(s.join(wanted, "group_id", "left_semi")), 9, "x").select("group_id", "part", "n", "x")


CATALOGUE_SQL = """c AS (SELECT * FROM (VALUES ('00000', 'background', 'none', 'none', 20), ('10000', 'target', 'bebop', 'connected', 20), ('10001', 'target', 'bebop', 'hovering', 20), ('10010', 'target', 'bebop', 'flying', 20), ('10011', 'target', 'bebop', 'video', 20), ('10100', 'target', 'ar', 'connected', 20), ('10101', 'target', 'ar', 'hovering', 20), ('10110', 'target', 'ar', 'flying', 20), ('10111', 'target', 'ar', 'video', 17), ('11000', 'target', 'phantom', 'connected', 20)) v(code, activity, model, mode, top)),
r AS (SELECT *, 'dev' AS partition, unnest(range(CASE code WHEN '00000' THEN 10 ELSE 5 END)) AS segment FROM c UNION ALL SELECT *, 'eval', unnest(CASE code WHEN '00000' THEN [15, 16, 17] ELSE [top - 1] END) FROM c UNION ALL SELECT *, 'holdout', unnest(CASE code WHEN '00000' THEN [18, 19, 20] ELSE [top] END) FROM c),
sel AS (SELECT code, activity, model, mode, partition, CAST(segment AS INTEGER) AS segment, part, 'rec_' || code || '_' || CAST(segment AS VARCHAR) AS group_id FROM r CROSS JOIN (SELECT unnest(['L', 'H']) AS part))"""
#: The table's recordings: a class by the supplier's last digit, a segment and a partition by the digits before it.
RECORDINGS_SQL = "rcs AS (SELECT DISTINCT 's_' || CAST(l_suppkey AS VARCHAR) AS group_id, CASE WHEN l_linenumber % 2 = 0 THEN 'L' ELSE 'H' END AS part, k.code, k.activity, CAST(l_suppkey // 10 AS INTEGER) AS segment, CASE WHEN (l_suppkey // 10) % 10 < 6 THEN 'dev' WHEN (l_suppkey // 10) % 10 < 9 THEN 'eval' ELSE 'holdout' END AS partition FROM lineitem JOIN (SELECT row_number() OVER (ORDER BY code) - 1 AS i, code, activity FROM c) k ON l_suppkey % 10 = k.i)"


@query("a14_catalogue", f"WITH {CATALOGUE_SQL}, {RECORDINGS_SQL} SELECT sel.*, coalesce(files, 0) AS files FROM sel LEFT JOIN (SELECT code, segment, part, count(*) AS files FROM rcs GROUP BY ALL) f USING (code, segment, part)")
def a14(spark, d):
    """The selection, and how many of the table's recordings each of its rows has."""
    there = recordings(spark, d).groupBy("code", "segment", "part").agg(F.count("*").alias("files"))
    return na.selection(spark).drop("max_segment").join(there, ["code", "segment", "part"], "left").withColumn("files", F.coalesce("files", F.lit(0)))


@query("a12_manifest_partitions", f"WITH {CATALOGUE_SQL}, {RECORDINGS_SQL} SELECT partition, count(*) AS files, count(DISTINCT group_id) AS groups, CAST(sum(segment) AS BIGINT) AS segments FROM rcs WHERE partition IN ('dev', 'eval') GROUP BY partition")
def a12(spark, d):
    """A manifest of the table's recordings, written as JSON and read again, by partition."""
    files = recordings(spark, d).withColumn("sha256", F.sha2("relative_path", 256))
    path = f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    sk.write_json(files.groupBy(F.lit("local_subset_ready").alias("status")).agg(F.collect_list(F.struct(*files.columns)).alias("files")), path)
    got = rd.partition_files(rd.read_manifest(spark, path), ["dev", "eval"])
    return got.groupBy("partition").agg(F.count("*").alias("files"), F.count_distinct("group_id").alias("groups"), F.sum("segment").alias("segments"))


@query("a13_missing_files", f"WITH {CATALOGUE_SQL}, {RECORDINGS_SQL} SELECT group_id, part FROM rcs WHERE segment % 4 = 3 OR part = 'H' AND segment = 2")
def a13(spark, d):
    files = recordings(spark, d).withColumn("size_bytes", F.lit(10).cast("long"))
    there = files.where("segment % 4 <> 3").select(F.col("relative_path").alias("path"), F.when((F.col("part") == "H") & (F.col("segment") == 2), 9).otherwise(10).cast("long").alias("size_bytes"))
    return rd.missing_files(files, there).select("group_id", "part")


@query("a15_background_pairs", "WITH f AS (SELECT o_orderkey AS segment, o_orderstatus, 'p' || CAST(o_orderkey AS VARCHAR) AS path FROM orders) SELECT l.segment, l.path || 'L' AS path_l, h.path || 'H' AS path_h FROM f l LEFT JOIN f h ON l.segment = h.segment AND h.o_orderstatus <> 'F'")
def a15(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("segment"), "o_orderstatus", F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("path"))
    low = o.select("segment", F.lit("L").alias("part"), F.concat("path", F.lit("L")).alias("path"))
    high = o.where("o_orderstatus <> 'F'").select("segment", F.lit("H").alias("part"), F.concat("path", F.lit("H")).alias("path"))
    return rd.pairs(low.unionByName(high))


@query("a25_canonical_hash", "SELECT doc_id, sha256(regexp_replace(replace(text, chr(10), chr(13) || chr(10)), '\\r\\n?', chr(10), 'g')) AS hash FROM documents")
def a25(spark, d):
    return table(spark, d, "documents").select("doc_id", rd.canonical_hash(F.regexp_replace("text", "\n", "\r\n")).alias("hash"))


@query("c01_partition_filter", "SELECT count(*) AS rows, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_shipdate >= TIMESTAMP '1995-01-01'")
def c01(spark, d):
    x = table(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "R") & (F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")))
    return x.agg(F.count("*").alias("rows"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("c02_stage_filter", GROUP_CTES + " SELECT group_id, truth FROM gs WHERE label = 'target'")
def c02(spark, d):
    return le.filter_stage(group_scores(spark, d), le.StageSpec("model", "truth", "label = 'target'")).select("group_id", "truth")


@query("c04_not_finite", "SELECT event_id FROM events WHERE value < 0.2 OR event_id % 97 = 0")
def c04(spark, d):
    bad = F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).when(F.col("value") < 0.2, F.lit(None)).otherwise(F.col("value"))
    return robust.not_finite(table(spark, d, "events").withColumn("v", bad), ["v"]).select("event_id")


@query("c05_sanitize", "SELECT event_type, round(sum(CASE WHEN event_id % 13 = 0 THEN 0 ELSE value END), 4) AS total FROM events GROUP BY event_type")
def c05(spark, d):
    bad = F.when(F.col("event_id") % 26 == 0, F.lit(float("nan"))).when(F.col("event_id") % 13 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.sum(finite_or(bad)), 4).alias("total"))


@query("c06_projection", "SELECT event_id, value * 1000 AS value_milli, round(value / 1e6, 12) AS value_mega, CAST(user_id AS VARCHAR) AS user_name FROM events")
def c06(spark, d):
    return table(spark, d, "events").select("event_id", (F.col("value") * 1000).alias("value_milli"), F.round(F.col("value") / 1e6, 12).alias("value_mega"), F.col("user_id").cast("string").alias("user_name"))


@query("c10_label_names", "SELECT event_id, CASE event_type WHEN 'click' THEN 'target' WHEN 'view' THEN 'background' ELSE event_type END AS label FROM events")
def c10(spark, d):
    return table(spark, d, "events").select("event_id", mapped(F.concat(F.lit(" "), F.upper("event_type"), F.lit(" ")), {"click": "target", "view": "background"}).alias("label"))


@query("d01_lookup", "SELECT n.n_name AS nation, count(*) AS customers FROM customer LEFT JOIN nation n ON c_nationkey = n_nationkey GROUP BY n.n_name")
def d01(spark, d):
    joined = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    checked = F.coalesce("n_name", F.raise_error(F.lit("a key has no match")).cast("string"))
    return joined.groupBy(checked.alias("nation")).agg(F.count("*").alias("customers"))


@query("d03_part_pairing", f"WITH {USER_SQL}, p AS (SELECT {G}, count(*) AS c FROM ser GROUP BY {G}) SELECT l.group_id, l.c AS low, h.c AS high FROM p l JOIN p h ON l.group_id = h.group_id AND l.part = 'L' AND h.part = 'H'")
def d03(spark, d):
    p = series_user(spark, d).groupBy("group_id").agg(F.count_if(F.col("part") == "L").alias("low"), F.count_if(F.col("part") == "H").alias("high"))
    return p.where("low > 0 and high > 0")


@query("d04_permuted_labels", GROUP_CTES + ", a AS (SELECT group_id, row_number() OVER (ORDER BY md5('7:from:' || group_id), group_id) AS i FROM gs), b AS (SELECT label, row_number() OVER (ORDER BY md5('7:' || group_id), group_id) AS i FROM gs) SELECT group_id, label FROM a JOIN b USING (i)")
def d04(spark, d):
    return le.permuted_labels(group_scores(spark, d).select("group_id", "label"), "label", 7)


FOLDS_SQL = GROUP_CTES + ", fo AS (SELECT group_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('42:' || group_id), group_id) - 1) % 5 AS INTEGER) AS fold FROM gs)"


@query("i04_group_folds", FOLDS_SQL + " SELECT group_id, label, fold FROM fo")
def i04(spark, d):
    return le.group_folds(features4(spark, d), "label", 5)


@query("i05_group_split", GROUP_CTES + ", q AS (SELECT group_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || group_id), group_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM gs) SELECT group_id, label, r <= ceil(n * 0.25) AS test FROM q")
def i05(spark, d):
    return le.train_test_groups(features4(spark, d), "label", 0.25)


@query("d05_leak_check", FOLDS_SQL + ", v AS (SELECT group_id, CASE WHEN md5('9:' || group_id) < '4' THEN 0 ELSE fold END AS other FROM fo) SELECT f.group_id FROM fo f WHERE f.fold = 1 AND EXISTS (SELECT 1 FROM v WHERE v.group_id = f.group_id AND v.other <> 1)")
def d05(spark, d):
    """Groups of the test fold that a faulty split (some groups dealt anew) has in its training side, too."""
    f = stored(le.group_folds(features4(spark, d), "label", 5))
    faulty = f.withColumn("other", F.when(le.hash_order(9) < "4", 0).otherwise(F.col("fold")))
    return f.where("fold = 1").select("group_id").join(faulty.where("other <> 1").select("group_id"), "group_id", "left_semi")


@query("d06_missing_parts", f"WITH {USER_SQL}, p AS (SELECT group_id, count(DISTINCT part) AS c, min(part) AS p FROM ser WHERE n >= 30 GROUP BY group_id) SELECT group_id, CASE p WHEN 'L' THEN 'H' ELSE 'L' END AS missing FROM p WHERE c = 1")
def d06(spark, d):
    return robust.missing_parts(series_user(spark, d).where("n >= 30"))


@query("d07_parameter_join", FEATURE_CTES + ", p AS (SELECT median(crest_factor) AS m, stddev_pop(crest_factor) AS s FROM ft) SELECT window_id, round((crest_factor - m) / s, 6) + 0 AS z FROM ft, p")
def d07(spark, d):
    f = features4(spark, d)
    p = f.agg(F.median("crest_factor").alias("m"), F.stddev_pop("crest_factor").alias("s"))
    return f.crossJoin(F.broadcast(p)).select("window_id", (F.round((F.col("crest_factor") - F.col("m")) / F.col("s"), 6) + 0).alias("z"))


@query("d08_manifest_join", f"WITH {CATALOGUE_SQL}, {RECORDINGS_SQL} SELECT s.group_id, s.part, r.code IS NOT NULL AS present FROM sel s LEFT JOIN (SELECT DISTINCT code, segment, part FROM rcs) r USING (code, segment, part)")
def d08(spark, d):
    """The files of the selection, and whether the table's recordings have them."""
    s = na.selection(spark).withColumn("relative_path", F.concat_ws("_", "code", "segment", "part")).withColumn("size_bytes", F.lit(1).cast("long"))
    there = recordings(spark, d).select(F.concat_ws("_", "code", "segment", "part").alias("path"), F.lit(1).cast("long").alias("size_bytes")).distinct()
    lost = rd.missing_files(s, there).select("group_id", "part", F.lit(False).alias("present"))
    return s.select("group_id", "part").join(lost, ["group_id", "part"], "left").select("group_id", "part", F.coalesce("present", F.lit(True)).alias("present"))


@query("d09_condition_grid", "SELECT CAST(snr AS INTEGER) AS snr, CAST(rep AS INTEGER) AS rep, r_name AS region FROM (SELECT unnest([-5, 0, 5, 10, 20]) AS snr), (SELECT unnest(range(5)) AS rep), region")
def d09(spark, d):
    snr = spark.createDataFrame([(v,) for v in (-5, 0, 5, 10, 20)], "snr int")
    return snr.crossJoin(F.broadcast(spark.range(5).select(F.col("id").cast("int").alias("rep")))).crossJoin(F.broadcast(table(spark, d, "region").select(F.col("r_name").alias("region"))))


@query("e04_extremes", FEATURE_CTES + " SELECT label, round(median(crest_factor), 6) AS centre, round(max(crest_factor), 6) AS most FROM ft GROUP BY label")
def e04(spark, d):
    f = stored(features4(spark, d))
    most = f.groupBy("label").agg(F.round(F.max("crest_factor"), 6).alias("most"))
    return rounded(robust.exact_medians(f, ["label"], ["crest_factor"]).withColumnRenamed("crest_factor", "centre"), 6, "centre").join(most, "label")


@query("e08_crosstab", "SELECT coalesce(l_returnflag, 'All') AS flag, count(*) FILTER (WHERE l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_linestatus = 'O') AS o, count(*) AS total FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def e08(spark, d):
    x = table(spark, d, "lineitem").rollup("l_returnflag").agg(F.count_if(F.col("l_linestatus") == "F").alias("f"), F.count_if(F.col("l_linestatus") == "O").alias("o"), F.count("*").alias("total"))
    return x.select(F.coalesce("l_returnflag", F.lit("All")).alias("flag"), "f", "o", "total")


@query("e09_ordered_counts", "SELECT o.i, o.kind, count(DISTINCT e.user_id) AS users FROM (SELECT unnest(range(3)) AS i, unnest(['click', 'view', 'absent']) AS kind) o LEFT JOIN events e ON e.event_type = o.kind GROUP BY o.i, o.kind")
def e09(spark, d):
    order = spark.createDataFrame([(i, k) for i, k in enumerate(("click", "view", "absent"))], "i long, kind string")
    counts = table(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count_distinct("user_id").alias("users"))
    return order.join(counts, "kind", "left").select("i", "kind", F.coalesce("users", F.lit(0)).alias("users"))


@query("e13_consistency", "SELECT user_id, count(DISTINCT event_type) AS values FROM events GROUP BY user_id HAVING count(DISTINCT event_type) <> 1")
def e13(spark, d):
    return robust.inconsistent(table(spark, d, "events"), "user_id", "event_type")


@query("k01_sorted_rank", "SELECT event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY user_id, ts, event_id) AS INTEGER) AS place FROM events")
def k01(spark, d):
    """Numbers by range partitions and what comes before them: no task holds an event type."""
    e = table(spark, d, "events").select("event_id", "event_type", "user_id", "ts")
    return ranks.global_rank(e, ["user_id", "ts", "event_id"], ["event_type"], name="place").select("event_id", F.col("place").cast("int").alias("place"))


@query("k01_global_rank", "SELECT event_id, rank() OVER (ORDER BY user_id % 7, floor(value / 10)) AS place FROM events")
def k01_global(spark, d):
    """One order of all events, with many ties, some of which are longer than a range."""
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 7).alias("u"), F.floor(F.col("value") / 10).alias("v"))
    return ranks.global_rank(e, ["u", "v"], name="place").select("event_id", "place")


@query("k02_best_row", "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def k02(spark, d):
    best = F.min(F.struct((-F.col("value")).alias("v"), "event_id", "value"))
    return table(spark, d, "events").groupBy("event_type").agg(best.alias("b")).select("event_type", "b.event_id", "b.value")


@query("k03_top_report", "SELECT user_id, count(*) AS events FROM events GROUP BY user_id ORDER BY events DESC, user_id LIMIT 5")
def k03(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "user_id").limit(5)


@query("k04_union_all", "SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def k04(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")))


@query("k05_union_by_name", BIN + ", m AS (SELECT group_id, 'model' AS stage, s_a FROM gs) SELECT group_id, 'activity' AS stage, round(s_act, 6) AS s_act, NULL::DOUBLE AS s_a FROM bin UNION ALL SELECT group_id, stage, NULL, round(s_a, 6) FROM m")
def k05(spark, d):
    a = binary(spark, d).select("group_id", F.lit("activity").alias("stage"), F.round("s_act", 6).alias("s_act"))
    b = top(spark, d).select("group_id", F.lit("model").alias("stage"), F.round("s_a", 6).alias("s_a"))
    return a.unionByName(b, allowMissingColumns=True)


@query("k06_set_operations", "SELECT 'both' AS which, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL SELECT 'only', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def k06(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    b = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).select(F.lit("both").alias("which"), "k").unionByName(a.subtract(b).select(F.lit("only").alias("which"), "k"))


@query("k07_first_per_key", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def k07(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("b")).select("user_id", "b.event_id")


@query("k08_unique_values", "SELECT DISTINCT round(l_discount, 2) AS value FROM lineitem")
def k08(spark, d):
    return table(spark, d, "lineitem").select(F.round("l_discount", 2).alias("value")).distinct()


REPLAY_SQL = GROUP_CTES.split(",\ngp AS")[0] + ", ix AS (SELECT f.group_id, f.part, row_number() OVER (PARTITION BY f.group_id, f.part ORDER BY f.window_id) - 1 AS idx, " + SCORE_COLUMNS["s_act"] + " AS s FROM ft f), ln AS (SELECT group_id, part, least(count(*), 200) AS n FROM ix GROUP BY group_id, part), st AS (SELECT group_id, part, unnest(range(1, n // 2 + 1)) * 2 AS stop FROM ln), pm AS (SELECT st.group_id, st.part, stop, median(s) AS s FROM st JOIN ix ON st.group_id = ix.group_id AND st.part = ix.part AND idx < stop GROUP BY ALL)"


def placed_scores(spark, d):
    """Scores of windows with their place in the part, a few hundred a part."""
    x = de.linear_scores(features4(spark, d), ACTIVITY).withColumnRenamed("score__target", "score")
    w = Window.partitionBy("group_id", "part").orderBy("window_id")
    return x.select("group_id", "part", "score", (F.row_number().over(w) - 1).cast("long").alias("idx"))


@query("l_replay_prefix", REPLAY_SQL + " SELECT group_id, CAST(stop AS BIGINT) AS stop, round(avg(s), 6) AS score, count(*) AS parts_used FROM pm GROUP BY group_id, stop")
def l_replay(spark, d):
    return rounded(replay.progressive_scores(placed_scores(spark, d), step=2), 6, "score")


@query("l_evolution", REPLAY_SQL + f""", e AS (SELECT group_id, stop, avg(s) AS score, count(*) AS parts_used FROM pm GROUP BY group_id, stop), v AS (SELECT *, CASE WHEN abs(score - {THRESHOLD}) < {REJECTION} THEN 'inconclusive' WHEN score >= {THRESHOLD} THEN 'target' ELSE 'background' END AS visible FROM e)
SELECT group_id, CAST(stop AS BIGINT) AS stop, round(score, 6) AS score, parts_used, {THRESHOLD}::DOUBLE AS threshold, visible, coalesce(lag(visible) OVER (PARTITION BY group_id ORDER BY stop) <> visible, false) AS changed FROM v""")
def l_evolution(spark, d):
    """How the decision goes as windows come in."""
    return rounded(replay.evolution(placed_scores(spark, d), THRESHOLD, REJECTION, step=2), 6, "score")


LIVE_THRESHOLD, LIVE_REJECTION = 1.0, 0.001
LIVE_SQL = f"""WITH {SHIP_SQL}, sc AS (SELECT {G}, n, (x - avg(x) OVER (PARTITION BY {G})) / 20000 AS x FROM ser),
fr AS (SELECT {G}, i, sqrt(avg(x * x)) AS score FROM sc JOIN (SELECT unnest(range(400)) AS i) f ON n BETWEEN 8 * i AND 8 * i + 15 GROUP BY {G}, i HAVING count(*) = 16),
st AS (SELECT {G}, s.stop, median(score) AS m FROM fr JOIN (SELECT unnest(range(4, 44, 4)) AS stop) s ON i < s.stop GROUP BY {G}, s.stop HAVING count(*) = s.stop),
gr AS (SELECT group_id, stop, avg(m) AS score, count(*) AS parts_used FROM st GROUP BY group_id, stop),
vi AS (SELECT *, CASE WHEN abs(score - {LIVE_THRESHOLD}) < {LIVE_REJECTION} THEN 'inconclusive' WHEN score >= {LIVE_THRESHOLD} THEN 'target' ELSE 'background' END AS visible FROM gr)
SELECT group_id, stop, round(score, 6) AS score, parts_used, {LIVE_THRESHOLD}::DOUBLE AS threshold, visible, coalesce(lag(visible) OVER (PARTITION BY group_id ORDER BY stop) <> visible, false) AS changed FROM vi"""


@query("l_live_evolution", LIVE_SQL)
def l_live(spark, d):
    """The suppliers' series as samples that arrive in three micro-batches: framed, scored by their RMS and decided by a stream with state; the last row of each step."""
    s = co.preprocess(ship_series(spark, d), "none").select("group_id", "part", "n", (F.col("x") / 20000).alias("x"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n")).alias("ts"))
    at = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    turns = written(s.withColumn("turn", F.least(F.floor(F.col("n") / 100), F.lit(2)).cast("int")), "turns")
    count = max(1, math.ceil(turns.count() / fixtures.LINES))  # files of a micro-batch, written after those of the one before
    for turn in range(3):
        turns.where(F.col("turn") == turn).drop("turn").repartition(count).write.parquet(f"{at}/samples/turn={turn}")
    files = spark.readStream.schema(s.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", count).parquet(f"{at}/samples")
    stream = live.live_decisions(live.live_scores(files, 16, 8, live.frame_rms, 4, 40, "1 day"), LIVE_THRESHOLD, LIVE_REJECTION)
    return rounded(live.last_rows(live.run_to_table(stream, f"{at}/rows", f"{at}/checkpoint")), 6, "score")


@query("l_event_windows", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS events, round(sum(value), 4) AS value_sum FROM events GROUP BY 1, 2")
def l_events(spark, d):
    return rounded(replay.event_windows(table(spark, d, "events")), 4, "value_sum")


FEATURE_SET = ["peak", "crest_factor", "spectral_centroid_hz", "rel_band_power_1", "rel_band_power_2"]


@query("i07_oof_scores")
def i07(spark, d):
    return le.out_of_fold(features4(spark, d), FEATURE_SET, "label", 5)


@query("i13_nested")
def i13(spark, d):
    """Five repetitions of five outer and four inner folds."""
    return le.nested_binary(features4(spark, d), FEATURE_SET, "label", 5, 4, 42, 5)[0]


@query("i13_group_separation", FEATURE_CTES + """, gl AS (SELECT DISTINCT group_id, label FROM ft), fd AS (SELECT r, group_id, (row_number() OVER (PARTITION BY r, label ORDER BY md5(concat(42 + r, ':', group_id)), group_id) - 1) % 5 AS own FROM gl CROSS JOIN range(5) a(r))
SELECT CAST(r AS INTEGER) AS repeat, CAST(f AS INTEGER) AS fold, group_id, CASE WHEN own = f THEN 'test' ELSE 'threshold,train' END AS roles FROM fd CROSS JOIN range(5) b(f)""")
def i13s(spark, d):
    """What every group was used for in each outer fold: to be tested, or to train and to find the threshold."""
    _, trace = le.nested_binary(features4(spark, d), FEATURE_SET, "label", 5, 4, 42, 5)
    return trace.groupBy("repeat", "fold", "group_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


@query("i06_holdout_report")
def i06(spark, d):
    return le.evaluate(features4(spark, d), FEATURE_SET, "label", 0.25)


@query("i06_cross_validation")
def i06c(spark, d):
    """Fold sizes and metrics by fold and on the whole (fold -1)."""
    return le.cross_validation(features4(spark, d), FEATURE_SET, "label", 5)


@query("i27_permutation")
def i27(spark, d):
    """100 permutations with five folds, 500 models fitted together."""
    return le.permutation_scores(features4(spark, d), FEATURE_SET, "label", range(100), 5)


@query("i27_p_value")
def i27p(spark, d):
    """How often permuted labels do as well as the true ones."""
    rows = stored(features4(spark, d))
    own = le.out_of_fold(rows, FEATURE_SET, "label", 5).withColumn("score", F.round("score__target", 9))
    own = stored(own.crossJoin(F.broadcast(de.choose_threshold(own, "score").select("threshold"))))
    observed = de.report(de.decide_binary(own, F.col("threshold"), 0.0), "label", "prediction").select(F.round("balanced_accuracy", 12).alias("observed"))
    permuted = le.permutation_scores(rows, FEATURE_SET, "label", range(100), 5)
    return de.p_values(permuted.withColumn("balanced_accuracy", F.round("balanced_accuracy", 12)), observed)


@query("j12_partition_table", f"WITH {CATALOGUE_SQL}, {RECORDINGS_SQL} SELECT partition, activity, count(DISTINCT group_id) AS groups, count(*) AS files FROM rcs GROUP BY partition, activity")
def j12(spark, d):
    return recordings(spark, d).groupBy("partition", "activity").agg(F.count_distinct("group_id").alias("groups"), F.count("*").alias("files"))