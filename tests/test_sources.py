"""Audio peaks of synthesised files, streaming balance, and the registered queries' contract."""

import math
import wave
from importlib.util import find_spec

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pitchloom import queries
from pitchloom.sources import audio
from pitchloom.streaming.circular import windowed_balance


def tone(path, parts, rate=44100, seconds=1.0, width=2, channels=1):
    t = np.arange(int(rate * seconds)) / rate
    x = sum(a * np.sin(2 * np.pi * f * t) for f, a in parts) / (sum(a for _, a in parts) or 1)
    v = np.repeat(np.round(x * (2 ** (8 * width - 1) - 1)).astype(np.int64), channels)
    raw = (v + 128).astype(np.uint8).tobytes() if width == 1 else v.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(raw)


@pytest.mark.parametrize("width, channels", [(1, 1), (2, 1), (2, 2), (3, 1), (4, 2)])
def test_peaks_of_formats(tmp_path, spark, width, channels):
    tone(tmp_path / "a.wav", [(440, 1), (1000, 0.5)], width=width, channels=channels)
    got = sorted((r.f, r.w) for r in audio.audio_peaks(spark, str(tmp_path), audio.PeakParams(min_prominence=0.1)).collect())
    assert [f for f, _ in got] == pytest.approx([440, 1000]) and [w for _, w in got] == pytest.approx([1, 0.5], abs=0.02)


@pytest.mark.parametrize("kind", ["pcm8", "pcm16", "pcm24", "pcm32", "float32", "float64"])
def test_encoded_sounds_are_read_back(kind):
    t = np.arange(4410) / 44100
    x = 0.5 * np.sin(2 * np.pi * 440 * t)
    for channels in (1, 2):
        got, rate = audio.decode(audio.encode(x, 44100, kind, channels))
        assert rate == 44100 and np.abs(got - x).max() < (0.01 if kind == "pcm8" else 1e-4)
    plain = audio.encode(x, 44100, kind)
    head = bytearray(plain[20:36])
    kind_of = head[:2]
    head[:2] = b"\xfe\xff"
    extensible = plain[:16] + (40).to_bytes(4, "little") + bytes(head) + (22).to_bytes(2, "little") + b"\0" * 6 + bytes(kind_of) + b"\0" * 14 + plain[36:]
    assert audio.decode(extensible)[0] == pytest.approx(audio.decode(plain)[0])


def test_other_formats_need_soundfile():
    if find_spec("soundfile"):
        pytest.skip("soundfile is here")
    with pytest.raises(ValueError, match="WAV"):
        audio.decode(b"fLaC" + b"\0" * 40)
    with pytest.raises(ValueError, match="is not read"):
        audio.decode(audio.encode(np.zeros(8), 8000).replace((1).to_bytes(2, "little"), (7).to_bytes(2, "little"), 1))


def test_details_of_sounds(spark):
    files = queries.sounds(spark)
    found = {r.path: r for r in audio.samples_of(files).collect()}
    assert len(found) == 5 and all(len(r.samples) == r.rate == 44100 for r in found.values())
    raw = audio.spectra_of(files).where("path = 'tone A4'").orderBy(F.desc("magnitude")).first()
    assert raw.f == pytest.approx(440)
    smooth = audio.spectra_of(files, audio.PeakParams(sigma=9.0), smoothed=True).where("path = 'tone A4'").orderBy(F.desc("magnitude")).first()
    assert smooth.f == pytest.approx(440, rel=2e-3)


def test_workflows(spark):
    best = queries.generator_peaks(spark).orderBy("rank").collect()
    assert len(best) == 15 and best[0].similarity == best[1].similarity and best[0].generator + best[1].generator == pytest.approx(1200)
    assert all(abs(a.generator - b.generator) >= 24 for i, a in enumerate(best) for b in best[:i])
    assert {(r.a_id, r.b_id) for r in queries.audio_similarity(spark).where("similarity between 0 and 1").collect()} == {(a, b) for a in queries.SOUNDS for b in queries.SOUNDS if a < b}
    assert queries.audio_features(spark).where("n_smooth between 1 and n_plain + 2 and entropy between 0 and 1").count() == 5
    trials = entry.queries()["batch_chord_harmonicity"](spark, "").collect()
    assert len(trials) == 144 and len({(r.chord, r.h) for r in trials}) == 4  # every root of a type has the same intervals


def test_smoothed_peaks(tmp_path, spark):
    tone(tmp_path / "a.wav", [(440, 1), (660, 0.8)])
    got = sorted(r.f for r in audio.audio_peaks(spark, str(tmp_path), audio.PeakParams(sigma=12, noise_factor=2)).collect())
    assert len(got) == 2 and got == pytest.approx([440, 660], rel=2e-3)


def test_silence_and_errors(tmp_path, spark):
    tone(tmp_path / "a.wav", [(440, 0)])
    assert audio.audio_peaks(spark, str(tmp_path)).count() == 0
    with pytest.raises(ValueError):
        audio.audio_peaks(spark, str(tmp_path), audio.PeakParams(f_min=100, f_max=50))
    with pytest.warns(UserWarning):
        audio.peaks(np.ones(100), 1000, audio.PeakParams(ramp_duration=1))


def test_pchip_is_monotone_and_exact_at_the_data():
    x, y = np.array([0.0, 1, 2.5, 3, 7]), np.array([0.0, 1, 1, 4, 5])
    assert audio.pchip(x, y, x) == pytest.approx(y)
    fine = audio.pchip(x, y, np.linspace(0, 7, 500))
    assert (np.diff(fine) >= -1e-12).all() and audio.pchip(x, y, np.array([-1.0, 8.0])).tolist() == [0, 0]


def brute_prominence(y):
    out = {}
    i = 1
    while i < len(y) - 1:
        j = i
        while j < len(y) - 1 and y[j + 1] == y[i]:
            j += 1
        if y[i - 1] < y[i] and j < len(y) - 1 and y[j + 1] < y[i]:
            low = []
            for k, step in ((i, -1), (j, 1)):
                least = y[i]
                while 0 <= k < len(y) and y[k] <= y[i]:
                    least = min(least, y[k])
                    k += step
                low.append(least)
            out[(i + j) // 2] = y[i] - max(low)
        i = j + 1
    return out


def test_prominence_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        y = rng.integers(0, 6, rng.integers(3, 40)).astype(float)
        expected = sorted(k for k, v in brute_prominence(y).items() if v >= 2)
        assert audio.prominent(y, 2).tolist() == expected


def test_streaming_equals_batch(tmp_path, spark):
    rows = [("a", f"2024-01-0{d} {h:02d}:00:00", float(h + d)) for d in (1, 2) for h in (1, 5, 9, 20)]
    df = spark.createDataFrame(rows, "k string, t string, v double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "in"))
    args = ("t", "k", F.hour("__t"), F.col("v"), 24)
    stream = windowed_balance(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), *args)
    q = stream.writeStream.format("memory").queryName("balances").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.window.start, r.set_id): r.balance for r in spark.table("balances").collect()}
    expected = {(r.window.start, r.set_id): r.balance for r in windowed_balance(df, *args).collect()}
    assert len(expected) == 2 and got == pytest.approx(expected)
    day = [(h, h + 1) for h in (1, 5, 9, 20)]
    z = sum(w * np.exp(2j * math.pi * h / 24) for h, w in day) / sum(w for _, w in day)
    assert min(abs(b - (1 - abs(z))) for b in expected.values()) < 1e-12


def test_entry_points(spark):
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", ["similarity_profiles", "balance_hours", "coherence_strict", "batch_spcs", "roughness_p1", "tensor_harmonicity_triads", "edo_approximation", "generator_chains", "batch_scales_chords", "triad_measures"])
def test_query_equals_sql(spark, name):
    import duckdb

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("events", "lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    r = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in r.description]
    expected = sorted(map(repr, r.fetchall()))
    got = entry.queries()[name](spark, d)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr(tuple(x)) for x in got.select(*columns).collect()) == expected
