import numpy as np

from ostinato.operators import audio
from ostinato.sources import wav


def put(folder, name, x, rate=8000):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(wav.encode(x, rate))


def test_chunk_is_found(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=40_000)
    put(tmp_path, "a.wav", x)
    blocks = wav.read_blocks(spark, str(tmp_path), block=8192, overlap=1024)
    r = audio.find_chunk(blocks, x[23_000:24_024]).first()
    assert r["at"] == 23_000


def test_shift_between_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    tones = [np.sin(2 * np.pi * rng.integers(200, 3000) * np.arange(2000) / 8000) * np.hanning(2000) for _ in range(60)]
    x = np.concatenate(tones)
    put(tmp_path / "a", "a.wav", x)
    put(tmp_path / "b", "b.wav", np.concatenate([np.zeros(128 * 50), x]))
    prints = []
    for name in "ab":
        blocks = wav.read_blocks(spark, str(tmp_path / name), block=16384, overlap=1024)
        prints.append(audio.fingerprints(audio.spectral_peaks(blocks, size=256, around_s=0.1, percentile=95.0), most=60))
    r = audio.file_offset(*prints).first()
    assert abs(r["delay"] - 50) < 1 and r["share"] > 0.05


def test_peaks_dont_depend_on_where_blocks_end(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=30_000)
    put(tmp_path, "a.wav", x)
    power = {}
    for block in (4096, 1 << 18):
        p = audio.band_power(wav.read_blocks(spark, str(tmp_path), block=block, overlap=512), size=512)
        power[block] = {r["frame"]: round(r["power"], 3) for r in p.collect()}
    assert power[4096] == power[1 << 18]


def test_regions_between_silences(spark, tmp_path):
    rate = 8000
    tone = np.sin(2 * np.pi * 440 * np.arange(rate) / rate)
    x = np.concatenate([tone * 0, tone, tone * 0, tone, tone[:800] * 0, tone, tone * 0]) + 1e-5 * np.random.default_rng(3).normal(size=rate * 6 + 800)
    put(tmp_path, "a.wav", x)
    got = audio.sounding_regions(audio.band_power(wav.read_blocks(spark, str(tmp_path), block=9000 // 256 * 256, overlap=512), size=512, fmax=3900)).orderBy("start").collect()
    assert [(round(r["start"], 1), round(r["end"], 1)) for r in got] == [(1.0, 2.0), (3.0, 5.1)]


def test_interesting_points():
    rng = np.random.default_rng(4)
    x = rng.normal(size=8000 * 12) * 0.01
    x[8000 * 5 : 8000 * 6] *= 50 * np.hanning(8000)
    points = audio.interesting_points(x, 8000, count=1)
    assert len(points) == 1 and abs(points[0] - 5) < 1.2
