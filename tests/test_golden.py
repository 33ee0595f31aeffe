"""Known values and invariants of every operator."""

import itertools
import math

import numpy as np
import pytest
from brute import apm, coherence, cosine, inner
from pyspark.sql import functions as F

from pitchloom.functions.pitch import convert_pitch, register
from pitchloom.model import SpectrumSpec, TensorParams, multiset
from pitchloom.operators import batch, circular, harmony, kernels, profiles, spectra, tensor
from pitchloom.plans import cost, grids

DIATONIC, WHOLE, CLAVE = (0, 2, 4, 5, 7, 9, 11), (0, 2, 4, 6, 8, 10), (0, 3, 6, 10, 12)
MAJOR, MINOR, JI = (0, 400, 700), (0, 300, 700), (0, 386.31, 701.96)


def one(df, column=None):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0][column] if column else rows[0]


def series(df, key, value):
    return [r[value] for r in df.orderBy(key).collect()]


@pytest.mark.parametrize("value, source, target, expected", [(440, "hz", "midi", 69), (440, "hz", "cents", 6900), (60, "midi", "hz", 261.6255653), (440, "hz", "mel", 549.6386753811), (440, "hz", "bark", 4.3851666667), (440, "hz", "erb", 9.9681007116), (440, "hz", "greenwood", 0.2614428397)])
def test_convert(spark, value, source, target, expected):
    df = spark.createDataFrame([(float(value),)], "v double")
    assert one(df.select(convert_pitch("v", source, target).alias("x")), "x") == pytest.approx(expected, rel=1e-9)
    assert one(df.select(convert_pitch("v", source.upper(), source).alias("x")), "x") == value


def test_sql_functions_and_unknown_scale(spark):
    assert "convert_hz_to_midi" in register(spark)
    assert spark.sql("SELECT convert_hz_to_midi(440D) AS x").first().x == pytest.approx(69)
    with pytest.raises(ValueError):
        convert_pitch("v", "hz", "furlong")


def test_spectra(spark, sets):
    out = spectra.add_spectra(sets({"a": (0, 700)}), SpectrumSpec.of("custom", (0, 1200), (1, 0.5)))
    assert sorted((r.p, r.w) for r in out.collect()) == [(0, 1), (700, 1), (1200, 0.5), (1900, 0.5)]
    out = spectra.add_spectra(sets({"a": (0,)}), SpectrumSpec.of("harmonic", 4, "geometric", 0.5))
    assert sorted((r.w for r in out.collect()), reverse=True) == [1, 0.5, 0.25, 0.125]
    stiff = spectra.add_spectra(sets({"a": (0,)}), SpectrumSpec.of("stiff", 2, 0.01, "powerlaw", 1))
    assert max(r.p for r in stiff.collect()) == pytest.approx(1200 * math.log2(2 * math.sqrt(1.04) / math.sqrt(1.01)))
    linear = spectra.add_spectra(sets({"a": (0,)}), SpectrumSpec.of("freqlinear", 2, 0.5, "powerlaw", 1))
    assert max(r.p for r in linear.collect()) == pytest.approx(1200 * math.log2(2.5 / 1.5))


@pytest.mark.parametrize("spec", [("tartini", 3, "powerlaw", 1), ("harmonic", 0, "powerlaw", 1), ("harmonic", 3, "linear", 1), ("harmonic", 3, "geometric", 1.5), ("stretched", 3, 0, "powerlaw", 1), ("freqlinear", 3, -1, "powerlaw", 1), ("stiff", 3, -0.1, "powerlaw", 1), ("custom", (0,), (1, 2))])
def test_spectrum_errors(spec):
    with pytest.raises(ValueError):
        SpectrumSpec.of(*spec)


def test_parameter_errors():
    for bad in (dict(r=0), dict(r=1, relative=True), dict(sigma=0), dict(period=0)):
        with pytest.raises(ValueError):
            TensorParams(**({"sigma": 1.0} | bad))


def test_circular(spark, sets):
    df = sets({"aug": (0, 400, 800), "dia": [100 * p for p in DIATONIC]})
    got = {r.set_id: r.balance for r in circular.balance(df, 1200).collect()}
    assert got["aug"] == pytest.approx(1) and got["dia"] == pytest.approx(0.9617215439)
    even = {r.set_id: r.evenness for r in circular.evenness(sets({"w": WHOLE, "d": DIATONIC, "one": (3,)}), 12).collect()}
    assert even["w"] == pytest.approx(1) and even["d"] == pytest.approx(0.9888464387) and even["one"] is None
    moved = {r.set_id: r.evenness for r in circular.evenness(sets({"in": (0, 400, 700), "out": (0, 1600, 700)}), 1200).collect()}
    assert moved["in"] == pytest.approx(0.970, abs=1e-3) and moved["out"] == pytest.approx(0.173, abs=1e-3)
    clave = sets({"c": CLAVE})
    assert series(circular.edges(clave, 16), "x", "edge") == pytest.approx([0.0918, 0.8843, 0.8925, 0, 0.8925, 0.8843, 0.0918, 1.4655, 0.0078, 1.5578, 0.6653, 0, 0.6653, 1.5578, 0.0078, 1.4655], abs=1e-4)
    assert series(circular.mean_offset(clave, 16), "x", "offset") == pytest.approx([-0.125, 0.25, -0.375, 0, 0.375, -0.25, 0.125, 0.5, -0.125, -0.75, -0.375, 0, 0.375, 0.75, 0.125, -0.5])
    assert circular.proj_centroid(clave, 16).first().phase == pytest.approx(11)
    assert circular.proj_centroid(sets({"d": DIATONIC}), 12).first().phase == pytest.approx(2)
    f = circular.dft(sets({"d": DIATONIC}), 12).orderBy("k").collect()
    z = np.fft.fft(np.exp(2j * np.pi * np.array(DIATONIC) / 12)) / 7
    assert [r.mag for r in f] == pytest.approx(list(abs(z)))


def test_markov_looks_back(spark, sets):
    clave = sets({"c": CLAVE})
    assert series(circular.markov_s(clave, 16), "x", "value") == pytest.approx([1, 0, 0.2, 0.5, 0, 0.2, 0.5, 0, 0.2, 0.5, 1, 0, 0.2, 0, 0.2, 0.5])
    with pytest.raises(Exception, match="positions must lie"):
        circular.markov_s(sets({"c": (-1, 3)}), 16).collect()


@pytest.mark.parametrize("decay", [0.0, 0.03])
def test_apm(spark, sets, decay):
    m = circular.circ_apm(sets({"c": CLAVE}), 16, decay)
    got = np.zeros((16, 16))
    for r in m.collect():
        got[r.lag, r.phase] = r.r
    s = np.zeros(16)
    s[list(CLAVE)] = 1
    assert np.allclose(got, apm(s, 16, decay))
    if not decay:
        assert series(circular.apm_phases(m), "phase", "r_phase") == [48, 8, 32, 24, 32, 8, 48, 8, 32, 8, 48, 8, 48, 8, 32, 8]
        assert series(circular.apm_lags(m), "lag", "r_lag") == [80, 0, 16, 32, 32, 0, 48, 32, 0, 32, 48, 0, 32, 32, 16, 0]


def test_intervals(spark, sets):
    df = sets({"d": DIATONIC, "w": WHOLE})
    got = {r.set_id: (r.nc, r.c) for r in circular.coherence(df, 12).collect()}
    assert got["d"][0] == 1 and got["d"][1] == pytest.approx(0.9928571429) and got["w"] == (0, 1)
    assert coherence(DIATONIC, 12) == 1
    same = {r.set_id: (r.n_diff, r.sq) for r in circular.sameness(df, 12).collect()}
    assert same["d"][0] == 1 and same["d"][1] == pytest.approx(0.9920634921) and same["w"] == (0, 1)
    two = one(circular.coherence(sets({"t": (0, 5)}), 12))
    assert two.c is None and two.nc == 0
    for op in (circular.coherence, circular.sameness):
        with pytest.raises(Exception, match="distinct modulo"):
            op(sets({"r": (0, 12, 5)}), 12).collect()
        assert op(sets({"r": (0, 12, 5), "s": (1,)}), 12, on_invalid="null").count() == 0


def test_n_tuples(spark, sets):
    df = sets({"d": DIATONIC})
    assert one(circular.n_tuple_entropy(sets({"w": WHOLE}), 12), "entropy") == pytest.approx(0, abs=1e-12)
    assert one(circular.n_tuple_entropy(df, 12, 2, normalize=False), "entropy") == pytest.approx(1.5566567075)
    assert [one(circular.n_tuple_entropy(df, 12, k), "entropy") for k in (1, 2)] == pytest.approx([0.2407613939, 0.2171092037])
    assert one(circular.n_tuple_entropy(df, 12, 1, sigma=0.2), "entropy") == pytest.approx(0.2407822288)
    assert one(circular.n_tuple_entropy(df, 12, 2, sigma=0.5), "entropy") == pytest.approx(0.3871685235)
    assert [one(circular.n_tuple_entropy(sets({"c": CLAVE}), 16, k), "entropy") for k in (1, 2)] == pytest.approx([0.3804820237, 0.2902410119])
    with pytest.raises(ValueError):
        circular.n_tuple_entropy(df, 1001, 3)
    with pytest.raises(Exception, match="more elements"):
        circular.n_tuple_entropy(sets({"t": (0, 4, 7)}), 12, 3).collect()


def test_smoothed_n_tuples_make_no_row_of_a_bin(spark, sets):
    """One row is made of each tuple, none of a bin, and a set is moved once."""
    df = circular.n_tuple_entropy(sets({"d": DIATONIC, "c": (0, 1, 4), "w": WHOLE}), 12, 2, sigma=0.5)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 1 and plan.count("Exchange hashpartitioning") == 1
    got = {r.set_id: r.entropy for r in df.collect()}
    kernel = np.exp(-(np.minimum(np.arange(12), 12 - np.arange(12)) ** 2) / 0.5)
    kernel /= kernel.sum()
    for name, p in (("d", DIATONIC), ("c", (0, 1, 4)), ("w", WHOLE)):
        s = [(b - a) % 12 for a, b in zip(p, [*p[1:], p[0]], strict=True)]
        v = sum(np.outer(np.roll(kernel, a), np.roll(kernel, b)) for a, b in zip(s, [*s[1:], s[0]], strict=True)) / len(p)
        assert got[name] == pytest.approx(-(v * np.log(v)).sum() / (2 * np.log(12)))


@pytest.mark.parametrize("block", [1, 7, 500, 1 << 20])
def test_smoothed_sums_in_blocks(block):
    """Blocks of sets, of bins, and both give the sums of the whole histogram."""
    r = np.random.default_rng(3)
    start, kernel = np.array([0, 3, 4, 9, 14]), r.random(5)
    steps, count = r.integers(0, 5, (14, 3)), r.integers(1, 4, 14)
    total, moment = kernels.smoothed_sums(start, steps, count, kernel, block)
    for i in range(4):
        v = sum(count[j] * np.einsum("a,b,c->abc", *(np.roll(kernel, s) for s in steps[j])) for j in range(start[i], start[i + 1]))
        assert total[i] == pytest.approx(v.sum()) and moment[i] == pytest.approx((v * np.log(v)).sum())


def pair(sets, a, b, t, how=tensor.cosine):
    left, right = sets({"a": a}), sets({"b": b})
    pairs = left.select(F.lit("a").alias("a_id"), F.lit("b").alias("b_id")).distinct()
    return one(how(left, right, pairs, t), "similarity")


@pytest.mark.parametrize("r, rel, per", [(1, False, True), (1, False, False), (2, False, True), (2, False, False), (2, True, True), (2, True, False), (3, True, True), (3, True, False)])
def test_cosine_against_brute_force(spark, sets, r, rel, per):
    a, wa, b, wb = (0, 390, 702, 1100), (1, 0.8, 0.6, 1.5), (10, 300, 690), (1, 2, 0.5)
    expected = cosine(a, wa, b, wb, 40, r, rel, per, 1200)
    t = TensorParams(40, r, rel, per, 1200)
    assert pair(sets, list(zip(a, wa)), list(zip(b, wb)), t) == pytest.approx(expected, rel=1e-10)
    if r == 2 and not rel:
        assert pair(sets, list(zip(a, wa)), list(zip(b, wb)), t, tensor.cosine_absolute_pairs) == pytest.approx(expected, rel=1e-10)
    if rel:
        assert pair(sets, [x + 77 for x in b], b, t) == pytest.approx(1, abs=1e-12)


def test_cosine_golden(spark, sets):
    spec, t = SpectrumSpec.of("harmonic", 12, "powerlaw", 1), TensorParams(10)
    left, right = spectra.add_spectra(sets({"a": MAJOR}), spec), spectra.add_spectra(sets({"b": MINOR}), spec)
    pairs = spark.createDataFrame([("a", "b")], "a_id string, b_id string")
    assert one(tensor.cosine(left, right, pairs, t), "similarity") == pytest.approx(0.7372741437597163, rel=1e-12)
    dia = [100 * p for p in DIATONIC]
    assert pair(sets, MAJOR, dia, TensorParams(10, 2, True, False)) == pytest.approx(0.5819162069)
    assert pair(sets, MAJOR, dia, TensorParams(10, 2, True, True)) == pytest.approx(0.7825089781)
    assert pair(sets, MAJOR, dia, TensorParams(10, 3, True, True)) == pytest.approx(0.2927700660)
    assert pair(sets, (0,), (0, 1), TensorParams(1, 2, False, True, 12)) is None


def test_density(spark, sets):
    values = tensor.evaluate_raw(sets({"a": (0, 4, 7)}), grids.integers(12), TensorParams(0.5, 1, False, True, 12))
    assert [int(r.x) for r in values.where("value > 0.5").orderBy("x").collect()] == [0, 4, 7]
    pdf = tensor.evaluate_raw(sets({"a": (0, 4, 7)}), grids.linspace(0, 12, 1200, endpoint=False), TensorParams(0.5, 1, False, True, 12), "pdf")
    assert one(pdf.agg((F.sum("value") * 0.01).alias("x")), "x") == pytest.approx(1, abs=0.01)
    dyads = tensor.evaluate_raw(sets({"a": (0, 4, 7)}), F.array(F.array(F.lit(0.0), F.lit(4.0))), TensorParams(0.5, 2, False, False))
    assert one(dyads, "value") == pytest.approx(1, abs=1e-3)
    with pytest.raises(ValueError):
        tensor.evaluate_raw(sets({"a": (0,)}), grids.integers(3), TensorParams(1), "unit")


def test_relative_periodic_forms_differ(spark, sets):
    """The density wraps each difference, the inner product wraps differences of differences."""
    t = TensorParams(400, 3, True, True, 1200)
    got = one(tensor.evaluate_raw(sets({"a": [(0, 1), (590, 1), (610, 1)]}), F.array(F.array(F.lit(0.0), F.lit(0.0))), t), "value")
    total = 0.0
    for u in ((0, 590, 610), (0, 610, 590), (590, 0, 610), (590, 610, 0), (610, 0, 590), (610, 590, 0)):
        d = [(u[1] - u[0] + 600) % 1200 - 600, (u[2] - u[0] + 600) % 1200 - 600]
        total += math.exp(-(d[0] ** 2 + d[1] ** 2 - (d[0] + d[1]) ** 2 / 3) / (2 * 400**2))
    assert got == pytest.approx(total)


def test_batch(spark):
    schema = "row_id int, a array<double>, b array<double>, wa array<double>"
    dia = [100.0 * p for p in DIATONIC]
    rows = [(1, [0.0, 400.0, 700.0], dia, [1.0, 0.8, 0.6]), (2, [1200.0, 1600.0, 1900.0], dia, [1.0, 0.8, 0.6]), (3, [0.0, float("nan"), None], dia, [1.0, 1.0, 1.0]), (4, [50.0, 450.0, 750.0], [p + 50 for p in dia], [1.0, 0.8, 0.6])]
    df = spark.createDataFrame(rows, schema)
    t = TensorParams(10, 2, False, True)
    got = {r.row_id: r.similarity for r in batch.batch_cos_sim(df, t, weights_a="wa", precision=6).collect()}
    expected = cosine((0, 400, 700), (1, 0.8, 0.6), dia, [1] * 7, 10, 2, False, True, 1200)
    assert got[1] == pytest.approx(expected) and got[2] == got[1] and got[3] is None and got[4] == got[1]
    keyed = batch.canonical(df.where("row_id <> 3").select("row_id", batch.elements(F.col("a"), F.col("wa")).alias("ea"), batch.elements(F.col("b"), None).alias("eb")), t, 6)
    assert keyed.select("ka", "kb").distinct().count() == 1
    rel = TensorParams(10, 2, True, True)
    got = {r.row_id: r.similarity for r in batch.batch_cos_sim(df, rel, weights_a="wa", precision=6).collect()}
    assert got[1] == pytest.approx(cosine((0, 400, 700), (1, 0.8, 0.6), dia, [1] * 7, 10, 2, True, True, 1200))


def test_entropies(spark, sets):
    assert one(tensor.entropy_exp_tens(sets({"a": MAJOR}), TensorParams(10)), "entropy") == pytest.approx(0.6798425499)
    assert one(tensor.entropy_exp_tens(sets({"a": range(12)}), TensorParams(100, period=12)), "entropy") > 0.95
    assert one(tensor.entropy_exp_tens(sets({"a": [(0, 0)]}), TensorParams(1, period=12)), "entropy") == 0
    with pytest.raises(ValueError):
        tensor.entropy_exp_tens(sets({"a": MAJOR}), TensorParams(10, periodic=False))
    with pytest.raises(ValueError):
        tensor.entropy_exp_tens(sets({"a": MAJOR}), TensorParams(10, 2))
    spec = SpectrumSpec.of("harmonic", 24, "powerlaw", 1)
    got = {r.set_id: r.entropy for r in harmony.spectral_entropy(sets({"ji": JI, "edo": MAJOR}), 12, spectrum=spec).collect()}
    assert got == pytest.approx({"ji": 0.8446353707, "edo": 0.8460058458}, rel=1e-8)


def test_harmonicity(spark, sets):
    spec = SpectrumSpec.of("harmonic", 24, "powerlaw", 1)
    got = {r.set_id: (r.h_max, r.h_entropy) for r in harmony.template_harmonicity(sets({"ji": JI, "edo": MAJOR}), chord_spectrum=spec).collect()}
    assert got["ji"] == pytest.approx((0.6172614436, 0.9522071969)) and got["edo"] == pytest.approx((0.6118776242, 0.9523314434))
    assert one(harmony.template_harmonicity(sets({"edo": MAJOR})))[1:] == pytest.approx((0.3702616641, 0.8972392288))
    fine = harmony.virtual_pitches(sets({"ji": [6000 + p for p in JI]}), chord_spectrum=spec)
    assert one(fine.groupBy("set_id").agg(F.max_by("vp_p", "vp_w").alias("x")), "x") == pytest.approx(6698, abs=0.5)
    args = (25.0, SpectrumSpec.of("harmonic", 8, "powerlaw", 1), SpectrumSpec.of("harmonic", 4, "powerlaw", 1), 25.0)
    native = {round(r.vp_p, 6): r.vp_w for r in harmony.profile_native(sets({"m": MAJOR}), *args).collect()}
    fast = {round(r.vp_p, 6): r.vp_w for r in harmony.virtual_pitches(sets({"m": MAJOR}), args[0], spectrum=args[1], chord_spectrum=args[2], resolution=args[3]).collect()}
    assert native == pytest.approx(fast, abs=1e-9)
    twelve = SpectrumSpec.of("harmonic", 12, "powerlaw", 1)
    h = {r.set_id: r.h for r in harmony.tensor_harmonicity(sets({"u": (0, 0), "t": (0, 600)}), size=2, spectrum=twelve).collect()}
    assert h == pytest.approx({"u": 3.1299532768, "t": 0.1015510515})
    assert one(harmony.tensor_harmonicity(sets({"j": JI}), size=3, spectrum=twelve), "h") == pytest.approx(0.2531253910)
    assert one(harmony.tensor_harmonicity(sets({"j": JI}), size=3, spectrum=spec), "h") == pytest.approx(0.2656406522)


def brute_density(chord, offsets, weights, copies, sigma):
    """All ordered tuples of distinct elements over the copies of a template."""
    elements, k, total = [(o, w) for o, w in zip(offsets, weights) for _ in range(copies)], len(chord), 0.0
    x = sorted(chord)
    for tup in itertools.permutations(elements, k):
        d = [u - tup[0][0] - (b - x[0]) for (u, _), b in zip(tup[1:], x[1:])]
        total += math.prod(w for _, w in tup) * math.exp(-(sum(v * v for v in d) - sum(d) ** 2 / k) / (2 * sigma**2))
    return total


@pytest.mark.parametrize("chord, partials, duplicate", [((0, 400), 6, 0), ((0, 0, 700), 5, 0), ((0, 390, 702), 4, 2), ((0, 0, 0, 1200), 3, 0), ((0, 300, 700, 1190), 4, 1)])
def test_tensor_harmonicity_against_brute_force(spark, sets, chord, partials, duplicate):
    spec = SpectrumSpec.of("harmonic", partials, "powerlaw", 1)
    offsets, weights = 1200 * np.log2(np.arange(1, partials + 1)), 1 / np.arange(1, partials + 1)
    expected = brute_density(chord, offsets, weights, duplicate or len(chord), 12)
    got = one(harmony.tensor_harmonicity(sets({"c": chord}), spectrum=spec, duplicate=duplicate), "h")
    assert got == pytest.approx(expected, rel=1e-9, abs=1e-12)
    if len(chord) == 2:
        unit = one(harmony.tensor_harmonicity(sets({"c": chord}), spectrum=spec, normalize="pdf"), "h")
        mass = math.fsum(math.prod(w for _, w in t) for t in itertools.permutations([(o, w) for o, w in zip(offsets, weights) for _ in range(2)], 2))
        assert unit == pytest.approx(expected / mass / math.sqrt(2 * math.pi * 144) * math.sqrt(0.5))


def test_tensor_harmonicity_of_other_sizes(spark, sets):
    got = {r.set_id: r.h for r in harmony.tensor_harmonicity(sets({"three": MAJOR, "one": (5,), "four": (0, 400, 700, 1000)}), size=3).collect()}
    assert got["three"] > 0 and got["one"] is None and got["four"] is None
    assert one(harmony.tensor_harmonicity(sets({"four": (0, 400, 700, 1000)})), "h") > 0  # 64 partials, four pitches


def test_spectral_entropy_is_whole_at_its_reach(spark, sets):
    near, far = (one(harmony.spectral_entropy(sets({"a": JI}), reach=reach), "entropy") for reach in (9.0, 39.0))
    assert near == pytest.approx(far, rel=1e-12)


def test_profiles(spark):
    rng = np.random.default_rng(4)
    values = {k: rng.integers(0, 9, 60).astype(float) for k in ("a", "b")}
    df = spark.createDataFrame([(k, float(i), float(v)) for k, vs in values.items() for i, v in enumerate(vs)], "set_id string, x double, value double")
    got = profiles.peaks(df, 2.0, 5.0, 4).orderBy("set_id", "rank").collect()
    for k, y in values.items():
        own = [(r.x, r.value) for r in got if r.set_id == k]
        assert 0 < len(own) <= 4 and all(y[int(x)] == v for x, v in own) and [v for _, v in own] == sorted((v for _, v in own), reverse=True)
        assert all(abs(a[0] - b[0]) >= 5 for a, b in itertools.combinations(own, 2))
        assert own[0][1] == max(y[1:-1][[y[i] > y[i - 1] and y[i] >= y[i + 1] for i in range(1, 59)]])
    squeezed = profiles.gamma_compress(df, "value", 2.0, "set_id").collect()
    for r in squeezed:
        y = values[r.set_id]
        assert r.value == pytest.approx(((y[int(r.x)] - y.min()) / np.ptp(y)) ** 2 * np.ptp(y) + y.min())
    flat = df.withColumn("value", F.lit(3.0))
    assert {r.value for r in profiles.gamma_compress(flat, "value", 2.0).collect()} == {3.0}
    above = profiles.above_floor(df, 1.0).groupBy("set_id").count().collect()
    assert {r.set_id: r["count"] for r in above} == {k: int((v > np.median(v)).sum()) for k, v in values.items()}


def test_generator_sweep():
    """A mirrored sweep has its peaks twice, and the labels keep their distance."""
    y = np.array([0, 1, 0, 3, 0, 2, 0, 3, 0, 1, 0.0])
    assert profiles.spaced(np.arange(5.0), np.array([1, 3, 2, 3, 1.0]), 2, None) == [1, 3]
    assert profiles.spaced(np.arange(5.0), np.array([1, 3, 2, 3, 1.0]), 0, 3) == [1, 3, 2]
    assert y[np.array(profiles.spaced(np.arange(len(y)), y, 4, 2))].tolist() == [3, 3]


def test_weights(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 2.0, 3.0), ("a", float("nan"), 1.0)], "set_id string, p double, w double")
    assert sorted((r.p, r.w) for r in multiset(df).collect()) == [(1, 1), (2, 3)]
    assert {r.w for r in multiset(df, w=0.5).collect()} == {0.5} and {r.w for r in multiset(df, w=None).collect()} == {1.0}
    rows = spark.createDataFrame([(1, [0.0, 4.0, 7.0], [0.0, 4.0, 7.0], [0.5]), (2, [0.0, 4.0, 7.0], [0.0, 4.0, 7.0], []), (3, None, [1.0], None)], "row_id int, a array<double>, b array<double>, wa array<double>")
    t = TensorParams(1.0, 2, False, True, 12)
    assert {r.row_id: r.similarity for r in batch.batch_cos_sim(rows, t, weights_a="wa").collect()} == pytest.approx({1: 1.0, 2: 1.0, 3: None})
    with pytest.raises(Exception, match="as many as positions"):
        batch.batch_cos_sim(rows.withColumn("wa", F.array(F.lit(1.0), F.lit(2.0))), t, weights_a="wa").collect()


def test_merged_differences_change_nothing(spark, sets):
    """Large relative sets merge equal differences first; small ones do not."""
    t = TensorParams(10, 2, True, True, 1200)
    p, w = [1200 * i / 24 for i in range(24)], [1 + i % 3 for i in range(24)]
    expected = cosine(p, w, JI, (1, 1, 1), 10, 2, True, True, 1200)
    assert one(tensor.cosine_with(sets({"a": list(zip(p, w))}), "ji", JI, t), "similarity") == pytest.approx(expected, rel=1e-9)


def test_roughness(spark, sets):
    r = lambda x, **k: one(harmony.roughness(sets({"a": x}), **k), "roughness")
    assert r((440,)) == 0 and r((300, 330)) == pytest.approx(0.8667171162)
    assert r((300, 300, 330), average=True) == pytest.approx(2 * 0.8667171162 / 3)
    chord = [(440 * 2 ** ((m - 69) / 12) * n, 1 / n) for m in (60, 64, 67) for n in range(1, 9)]
    assert r(chord) == pytest.approx(2.8427313259)
    for bad in ((0, 300), (-5, 300)):
        with pytest.raises(Exception, match="must be positive"):
            r(bad)
    mixed = sets({"zero": (0, 300), "good": (300, 330)}).union(spark.createDataFrame([("null", None, 1.0)], "set_id string, p double, w double"))
    assert [(x.set_id, round(x.roughness, 6)) for x in harmony.roughness(mixed, on_invalid="null").collect()] == [("good", 0.866717)]


def test_cost():
    assert cost.ordered_tuples(72, 3) == 357_840 and cost.kernel_pairs(102, 102, 2) == 10_302 * 5_151
    assert cost.estimate_comp_time(1e6, 1, "test") > 0
    with pytest.raises(ValueError):
        cost.guard(10**13)


def test_inner_symmetry():
    a, b = (0, 4, 7), (0, 3, 7)
    assert inner(a, (1,) * 3, b, (1,) * 3, 1, 2, True, True, 12) == pytest.approx(inner(b, (1,) * 3, a, (1,) * 3, 1, 2, True, True, 12))
