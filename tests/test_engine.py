"""Operators that SQL does not express, and the edges of those it does."""

import io
import tarfile
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.functions import image_udfs as U
from siftline.functions import jpeg
from siftline.functions import pixels as P
from siftline.operators import dedup, grid, images, matching, sampling, splits
from siftline.plans import storage
from siftline.sources import archives, discovery, manifest
from siftline.sources.manifest import path_exists


def png(h, w, seed=0):
    return U.write_png(np.random.default_rng(seed).integers(0, 256, (h, w, 3)).astype(np.uint8))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=5))
def test_deficit_schedule_keeps_shares(counts):
    steps, n = list(sampling.deficit_schedule(counts)), sum(counts)
    assert [steps.count(k) for k in range(len(counts))] == counts
    for t in range(1, n + 1):
        for k, c in enumerate(counts):
            assert abs(steps[:t].count(k) - c * t / n) <= len(counts)


@pytest.mark.parametrize(("counts", "target"), [([450, 450] + [800] * 8, 5000), ([10, 50, 1000, 3, 700], 900), ([5, 5], 100), ([3], 0)])
def test_water_fill(spark, counts, target):
    df = spark.createDataFrame([(f"s{k}", c) for k, c in enumerate(counts)], "source string, available long")
    keep = {r.source: r.keep for r in sampling.water_fill(df, target).collect()}
    assert sum(keep.values()) == min(target, sum(counts)) and all(keep[f"s{k}"] <= c for k, c in enumerate(counts))
    free = [v for k, v in keep.items() if v < counts[int(k[1:])]]
    assert not free or max(free) - min(free) <= 1


def test_splits_are_disjoint(spark):
    df = spark.createDataFrame([(s, k) for s in range(10) for k in range(50)], "src int, k int").select(F.concat(F.lit("s"), "src").alias("src"), "k")
    for part in (splits.holdout(df, "src"), splits.cv_splits(df, "src", k=5).where("fold = 0")):
        assert splits.mixed_sources(part, "src").count() == 0 and part.count() == 500
    with pytest.raises(ValueError):
        splits.cv_splits(df, "src", "image_kfold")


def test_append_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(f"d/{k % 3}", "d", "train", "p", 1, 1, 1, 1, "h", "f") for k in range(5)], manifest.MANIFEST)
    path = f"file://{tmp_path}/m"
    assert manifest.read_manifest(spark, path).columns == manifest.MANIFEST.names
    assert [manifest.append_rows(spark, path, rows) for _ in range(2)] == [3, 0]
    with pytest.raises(ValueError):
        manifest.conform(rows.drop("image_hash"))


def test_archives_and_ingest(spark, tmp_path):
    layout = archives.LAYOUTS["bdd100k"]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for k in range(3):
            z.writestr(f"{layout.prefix}train/{k}.jpg", jpeg.write(np.random.default_rng(k).integers(0, 256, (20, 30 + k, 3)).astype(np.uint8), 90))
        z.writestr(f"{layout.prefix}val/bad.jpg", b"not an image")
        z.writestr("other/readme.txt", b"x")
    zips = [f"file://{tmp_path}/a.zip"]
    assert archives.count_canonical(spark, zips, layout) == 4
    first = archives.ingest(spark, zips, layout, f"file://{tmp_path}/pool", 16)
    again = archives.ingest(spark, zips, layout, f"file://{tmp_path}/pool", 16)
    assert first["materialized"] == 3 and first["errors"] == 1 and again["materialized"] == 0
    sides = {(r.materialized_h, r.materialized_w) for r in manifest.read_manifest(spark, f"file://{tmp_path}/pool/manifest").collect()}
    assert all(max(s) == 16 for s in sides)
    a2d2 = archives.LAYOUTS["a2d2"]
    with tarfile.open(tmp_path / "b.tar", "w") as t:
        for name in (f"{a2d2.prefix}s1/camera/cam_front_center/1.png", f"{a2d2.prefix}s1/label/cam_front_center/1.png"):
            info = tarfile.TarInfo(name)
            info.size = 3
            t.addfile(info, io.BytesIO(b"abc"))
    assert archives.count_canonical(spark, [f"file://{tmp_path}/b.tar"], a2d2) == 1


def test_codecs():
    rgb = np.random.default_rng(1).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert (U.decode(U.write_png(rgb)) == rgb).all()
    assert (U.decode(b"P6 7 5 255\n" + rgb.tobytes()) == rgb).all()
    half = np.dstack([rgb, np.zeros((5, 7, 1), np.uint8)])
    assert (U.to_rgb(half) == 255).all()
    gray = np.random.default_rng(4).random((3, 40, 50))
    assert U.phash(gray) == U.phash(gray * 0.5) != U.phash(gray[:, ::-1])
    assert U.phash(gray[1:2]) == U.phash(gray)[1:2]


def test_equal_coefficients_get_equal_bits():
    g = np.random.default_rng(5).integers(48, 205, (200, 8, 8)).astype(float)
    hashes = U.phash(np.triu(g) + np.triu(g, 1).transpose(0, 2, 1))
    bits = np.unpackbits(np.array([list(bytes.fromhex(h)) for h in hashes], np.uint8), axis=1).reshape(-1, 8, 8)
    assert (bits == bits.transpose(0, 2, 1)).all()
    assert U.phash(np.full((1, 30, 40), 91.0)) == ["8000000000000000"]
    # The middle coefficients of this picture, (2, 6) and (6, 2), are equal.
    picture = np.frombuffer(bytes.fromhex("6f7c9279769672696f72798e97959d8a6785839077917b91926f709381786b7b8a848288688e6397796f9e8c7d7b7c9b8d7d59907b847f6d7c67936e79887e89"), np.uint8).reshape(1, 8, 8).astype(float)
    assert U.phash(picture) == U.phash(picture * 0.3) == ["8e9015e7735c8372"]


@pytest.mark.parametrize("shape", [(33, 50, 3), (16, 16, 3), (7, 5, 1), (1, 1, 3), (64, 40, 1)])
def test_jpeg_comes_back_nearly_the_same(shape):
    y, x, c = np.meshgrid(*(np.arange(n) for n in shape), indexing="ij")
    img = np.rint(127 + 90 * np.sin(x / 9 + c) * np.cos(y / 7)).astype(np.uint8)
    data = jpeg.write(img, 95)
    back = U.decode(data)
    assert back.shape == shape and np.abs(back.astype(int) - img).mean() < 4
    assert len(jpeg.write(img, 30)) <= len(data)
    for cut in (10, len(data) // 2):
        assert U._or_none(U.decode)(data[:cut]) is None or U._or_none(U.decode)(data[:cut]).shape == shape
    with pytest.raises(NotImplementedError):
        jpeg.read(data.replace(b"\xff\xc0", b"\xff\xc2"))


def test_png_filters():
    """Rows filtered by each of the five rules come back."""
    import struct
    import zlib

    img = np.random.default_rng(3).integers(0, 256, (5, 6, 3)).astype(int)
    raw = b""
    for y, mode in enumerate((0, 1, 2, 3, 4)):
        line = []
        for x in range(6):
            for c in range(3):
                a, b, d = (img[y, x - 1, c] if x else 0), (img[y - 1, x, c] if y else 0), (img[y - 1, x - 1, c] if x and y else 0)
                paeth = min((abs(b - d), 0, a), (abs(a - d), 1, b), (abs(a + b - 2 * d), 2, d))[2]
                line.append(int(img[y, x, c] - (0, a, b, a + b >> 1, paeth)[mode]) & 255)
        raw += bytes([mode, *line])
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + bytes(4)
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (U.read_png(data) == img).all()


def test_task_and_view_settings(spark):
    assert images.list_tasks() == ["blur", "color_permutation", "frequency", "patch_shuffle", "rotation", "solarization"]
    df = spark.createDataFrame([(k, [0.5] * 64) for k in range(3)] + [(9, None)], "id int, img array<double>")
    assert images.pretext(df, "img", "blur", 1, 8, 8, 1, "id").count() == 4
    assert [r.img for r in df.select(U.blur_udf((1, 8, 8))("img", F.lit(1.0)).alias("img")).collect()][3] is None
    with pytest.raises(KeyError):
        images.pretext(df, "img", "none", 1, 8, 8, 1, "id")
    for bad in ({"scale": (0.0, 1.0)}, {"scale": (0.5, 1.5)}, {"ratio": (2.0, 1.0)}, {"flip": 1.5}, {"out": (0, 4)}):
        with pytest.raises(ValueError):
            images.two_views(df, "img", 1, 8, 8, **({"out": (4, 4), "seed": 1, "key": "id"} | bad))
    erased = images.TRANSFORMS["erasing"](1, 8, 8, 3, F.col("id"))
    assert all(r.img != [0.5] * 64 for r in df.where("img is not null").select(erased(F.col("img")).alias("img")).collect())


def test_transforms(spark):
    img = [k / 16 for k in range(16)]
    df = spark.createDataFrame([(1, img)], "id int, img array<double>")
    x = F.col("img")
    turned = P.rotate_quarter(P.rotate_quarter(x, 1, 4, 4, 1), 1, 4, 4, 3)
    r = df.select(turned.alias("a"), P.flip_rows(P.flip_columns(x, 1, 4, 4), 1, 4, 4).alias("b"), P.rotate_quarter(x, 1, 4, 4, 1).alias("c"), P.Pipeline([lambda v: P.brightness(v, 9)])(x).alias("d")).first()
    assert r.a == img and r.b == img[::-1] and r.c == np.rot90(np.array(img).reshape(4, 4)).ravel().tolist() and max(r.d) == 1
    assert set(images.PRESETS) == {"simclr_v1", "simclr_v2", "byol", "aggressive", "mocov3_v3_v2", "dino_v1"}
    with pytest.raises(KeyError):
        images.build("none", 3, 4, 4, F.lit(1))


def test_bands():
    for side in (16, 15):
        img = np.random.default_rng(2).random((2, 3, side, side))
        assert np.allclose(U.remove_bands(img, np.array([0, 0])), img) and U.band_energy(img).sum(axis=1) == pytest.approx(1)
        assert U.radial(side, side).max() == 1


def test_mutual_nearest(spark):
    rows = [(0, 0, 1.0, [1.0, 0.0]), (0, 1, 2.0, [0.9, 0.1]), (0, 2, 2.0, [0.0, 1.0]), (1, 3, 1.0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "img int, id int, s double, v array<double>")
    assert [(r.i, r.j, r.log_r) for r in matching.mutual_nearest(df, "img", "id", "s", "v").collect()] == [(0, 1, 1.0)]


def test_exclude_by_table_uses_every_row(spark):
    cells = spark.range(12_000).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"))
    rows = [(k, None) for k in range(11_900)] + [(11_950, 1), (11_951, 11_951 % 7), (None, 6)]
    left = grid.exclude_by_table(cells, spark.createDataFrame(rows, "a long, b long"))
    assert {r.a for r in left.collect()} == {k for k in range(11_900, 12_000) if k % 7 != 6 and k not in (11_951,) and not (k == 11_950 and k % 7 == 1)}
    assert grid.exclude_by_table(cells, spark.createDataFrame([(None, None)], "a long, b long")).count() == 0
    assert grid.exclude_by_table(cells, spark.createDataFrame([], "a long, b long")).count() == 12_000


def test_cells_resume(spark, tmp_path):
    g = grid.expand(spark, {"method": ["a", "b"], "dataset": ["x"], "fraction": [1.0]}, [0])

    def runner(cell):
        if cell["method"] == "b":
            raise RuntimeError("no")
        return {"metric_value": 0.5}

    keys = ["method", "dataset", "fraction", "seed"]
    path = f"file://{tmp_path}/r"
    assert {r.status for r in grid.run_cells(spark, g, runner, path, keys).collect()} == {"ok", "failed"}
    assert grid.run_cells(spark, g, lambda c: {}, path, keys).where("status = 'ok'").count() == 2
    with pytest.raises(ValueError):
        grid.load_methods([{"name": "a", "ckpt": "x"}, {"name": "a", "path": "y"}])


def test_discovery(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.JPG").write_bytes(b"x")
    (tmp_path / "list.txt").write_text("sub/a.JPG\n\n  b.png \n")
    assert discovery.list_images(spark, str(tmp_path)).count() == 1
    assert [r.path for r in discovery.resolve_split(spark, "../list.txt", str(tmp_path)).collect()] == ["sub/a.JPG", "b.png"]
    assert discovery.discover(spark, None, str(tmp_path))["mode"] == "ssl_only"
    with pytest.raises(discovery.ConfigError):
        discovery.discover(spark)
    lines = spark.createDataFrame([("http://x/1 # c",), ("# all",), ("http://x/2",)], "value string")
    assert [r.name for r in discovery.load_sources(lines).collect()] == ["ds_01", "ds_02"]
    log = discovery.build_logger(spark, "parquet", "r", f"file://{tmp_path}/log")
    assert [log.log({"a": 1.0}), log.log({"b": 2.0}, 7), log.log({"a": 3.0})] == [0, 7, 8]


def test_noise_has_its_spread_and_is_the_row_s(spark):
    df = spark.createDataFrame([(k, [0.5] * 1024) for k in range(8)], "id int, img array<double>")
    out = {r.id: np.array(r.x) for r in df.select("id", P.noise(F.col("img"), 0.05, 3, F.col("id")).alias("x")).collect()}
    again = {r.id: np.array(r.x) for r in df.repartition(3).select("id", P.noise(F.col("img"), 0.05, 3, F.col("id")).alias("x")).collect()}
    every = np.concatenate(list(out.values())) - 0.5
    assert abs(every.mean()) < 0.003 and abs(every.std() - 0.05) < 0.003
    assert all((out[k] == again[k]).all() for k in out) and (out[0] != out[1]).any()


def test_wide_hamming_radius_is_refused(spark):
    rows = spark.createDataFrame([(1, 5)], "id int, bits long")
    assert dedup.hamming_pairs(rows, rows, 7).count() == 1
    with pytest.raises(ValueError):
        dedup.hamming_pairs(rows, rows, 8)


def test_shared_folder_is_refused_on_a_cluster(monkeypatch):
    class Context:
        master, applicationId = "spark://x:7077", "a"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://n/x/"}
    assert storage.shared_dir(Session()) == "hdfs://n/x"


def test_forget_deletes_own_tables_only(spark, tmp_path):
    own = storage.write_back(spark.range(5), "gone")
    spark.range(3).write.parquet(f"file://{tmp_path}/other")
    other = spark.read.parquet(f"file://{tmp_path}/other")
    storage.forget(own, other)
    assert other.count() == 3 and not path_exists(spark, own.inputFiles()[0])
