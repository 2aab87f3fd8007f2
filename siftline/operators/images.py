"""Registries of transforms and presets, and the queries over small images made from vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import image_udfs as U
from siftline.functions import pixels as P
from siftline.functions.scalars import let
from siftline.functions.tables import table

#: Names of the changes and how to build them: name -> factory(c, h, w, seed, key, **settings) -> change.
TRANSFORMS: dict = {}


def transform(name: str):
    """Registers a factory; a name may be registered again."""
    def put(f):
        TRANSFORMS[name] = f
        return f

    return put


@transform("hflip")
def _hflip(c, h, w, seed, key):
    return lambda x: P.flip_columns(x, c, h, w)


@transform("vflip")
def _vflip(c, h, w, seed, key):
    return lambda x: P.flip_rows(x, c, h, w)


@transform("brightness")
def _brightness(c, h, w, seed, key, low=0.6, high=1.4):
    return lambda x: P.brightness(x, P.between(seed, low, high, key))


@transform("contrast")
def _contrast(c, h, w, seed, key, low=0.6, high=1.4):
    return lambda x: P.contrast(x, c, h, w, P.between(seed, low, high, key))


@transform("saturation")
def _saturation(c, h, w, seed, key, low=0.6, high=1.4):
    return lambda x: P.saturation(x, h, w, P.between(seed, low, high, key))


@transform("hue")
def _hue(c, h, w, seed, key, delta=0.1):
    return lambda x: P.hue(x, h, w, P.between(seed, -delta, delta, key))


@transform("color_jitter")
def _jitter(c, h, w, seed, key, brightness=0.4, contrast=0.4, saturation=0.2, hue=0.1):
    """The four colour changes in one of four rotations, chosen by the row."""
    parts = [_brightness(c, h, w, seed, key, 1 - brightness, 1 + brightness), _contrast(c, h, w, seed + 1, key, 1 - contrast, 1 + contrast), _saturation(c, h, w, seed + 2, key, 1 - saturation, 1 + saturation), _hue(c, h, w, seed + 3, key, hue)]

    def change(x):
        turn, out = F.floor(P.uniform(seed + 4, key) * 4), None
        for k in range(4):
            y = x
            for step in parts[k:] + parts[:k]:
                y = let(y, step)
            out = F.when(turn == k, y) if out is None else out.when(turn == k, y)
        return out

    return change


@transform("grayscale")
def _grayscale(c, h, w, seed, key):
    return lambda x: P.grayscale(x, h, w)


@transform("solarize")
def _solarize(c, h, w, seed, key, threshold=0.5):
    return lambda x: P.solarize(x, threshold)


@transform("posterize")
def _posterize(c, h, w, seed, key, bits=4):
    return lambda x: P.posterize(x, bits)


@transform("equalize")
def _equalize(c, h, w, seed, key):
    return lambda x: P.equalize(x, c, h, w)


@transform("cutout")
def _cutout(c, h, w, seed, key, max_h=32, max_w=32, num_holes=1):
    """Rectangles of zeros at drawn places, one after the other."""
    eh, ew = min(max_h, h), min(max_w, w)

    def change(x):
        for k in range(num_holes):
            top, left = (F.floor(P.uniform(seed + 2 * k + d, key) * (n + 1)) for d, n in ((0, h - eh), (1, w - ew)))
            x = P.cutout(x, c, h, w, top, left, eh, ew)
        return x

    return change


@transform("grid_mask")
def _grid(c, h, w, seed, key, grid=16, ratio=0.5):
    """Periodic squares, moved by a drawn offset."""
    return lambda x: P.grid_mask(x, c, h, w, grid, ratio, F.floor(P.uniform(seed, key) * grid), F.floor(P.uniform(seed + 1, key) * grid))


@transform("noise")
def _noise(c, h, w, seed, key, std=0.05):
    return lambda x: P.noise(x, std, seed, key)


@transform("rotate")
def _rotate(c, h, w, seed, key, degrees=30.0):
    return lambda x: U.rotate_udf((c, h, w))(x, P.between(seed, -degrees, degrees, key))


@transform("affine")
def _affine(c, h, w, seed, key, degrees=10.0, shift=0.1, low=0.9, high=1.1):
    return lambda x: U.affine_udf((c, h, w))(x, P.between(seed, -degrees, degrees, key), P.between(seed + 1, -shift, shift, key), P.between(seed + 2, -shift, shift, key), P.between(seed + 3, low, high, key))


@transform("blur")
def _blur(c, h, w, seed, key, kernel_size=5, low=0.1, high=2.0):
    return lambda x: U.blur_udf((c, h, w), kernel_size)(x, P.between(seed, low, high, key))


@transform("sharpen")
def _sharpen(c, h, w, seed, key, strength=1.0):
    return lambda x: U.sharpen_udf((c, h, w), strength)(x)


@transform("rotate90")
def _rotate90(c, h, w, seed, key):
    """One, two or three quarter turns by the row."""
    def change(x):
        turn = F.floor(P.uniform(seed, key) * 3)
        return F.when(turn == 0, P.rotate_quarter(x, c, h, w, 1)).when(turn == 1, P.rotate_quarter(x, c, h, w, 2)).otherwise(P.rotate_quarter(x, c, h, w, 3))

    return change


@transform("erasing")
def _erasing(c, h, w, seed, key, scale=(0.02, 0.33), ratio=(0.3, 3.3)):
    return lambda x: P.erase(x, c, h, w, seed, key, scale, ratio)


# The named pipelines, as (transform, probability, settings). "blur" sizes follow the image side.
_JITTER = {"brightness": 0.4, "contrast": 0.4, "saturation": 0.2, "hue": 0.1}
_JITTER_V3 = {"brightness": 0.4, "contrast": 0.4, "saturation": 0.4, "hue": 0.1}
PRESETS = {
    "simclr_v1": [("hflip", 0.5, {}), ("color_jitter", 0.8, _JITTER), ("grayscale", 0.2, {}), ("blur", 0.5, None)],
    "simclr_v2": [("hflip", 0.5, {}), ("color_jitter", 0.8, _JITTER), ("grayscale", 0.2, {}), ("blur", 0.5, None), ("solarize", 0.2, {"threshold": 0.5})],
    "byol": [("hflip", 0.5, {}), ("color_jitter", 0.8, _JITTER), ("grayscale", 0.2, {}), ("blur", 1.0, None), ("solarize", 0.0, {"threshold": 0.5})],
    "aggressive": [("hflip", 0.5, {}), ("rotate", 0.3, {"degrees": 15}), ("color_jitter", 0.9, {"brightness": 0.5, "contrast": 0.5, "saturation": 0.3, "hue": 0.15}), ("grayscale", 0.3, {}), ("blur", 0.5, {}), ("solarize", 0.2, {"threshold": 0.5}), ("cutout", 0.3, {"max_h": 48, "max_w": 48}), ("noise", 0.2, {"std": 0.03})],
    "mocov3_v3_v2": [("color_jitter", 0.8, _JITTER_V3), ("grayscale", 0.2, {}), ("blur", 0.5, None)],
    "dino_v1": [("color_jitter", 0.8, _JITTER_V3), ("grayscale", 0.2, {}), ("blur", 0.5, None), ("solarize", 0.2, {"threshold": 0.5})],
}


def build(name: str, c: int, h: int, w: int, key: Column, seed: int = 0) -> P.Pipeline:
    """A named pipeline for images of one shape."""
    if name not in PRESETS:
        raise KeyError(f"no preset {name}; there are {sorted(PRESETS)}")
    steps = []
    for k, (kind, p, settings) in enumerate(PRESETS[name]):
        if settings is None:
            settings = {"kernel_size": max(3, max(h, w) // 64 * 2 + 1)}
        steps.append(P.sometimes(TRANSFORMS[kind](c, h, w, seed + 100 * k, key, **settings), p, seed + 100 * k + 50, key))
    return P.Pipeline(steps)


def pretext_label(seed: int, n: int, key: Column) -> Column:
    """Label of a row among n."""
    return F.floor(P.uniform(seed, key) * n).cast("int")


def by_label(img: Column, label: Column, forms: list) -> Column:
    """The form of the row's label."""
    out = F.when(label == 0, forms[0](img))
    for k, f in enumerate(forms[1:], 1):
        out = out.when(label == k, f(img))
    return out


#: Tasks that predict what was done to an image: name -> (labels, change(img, label, c, h, w)).
TASKS: dict = {}


def register_task(name: str, labels: int):
    """Registers a task; a name may be registered again."""
    def put(f):
        TASKS[name] = (labels, f)
        return f

    return put


def list_tasks() -> list[str]:
    return sorted(TASKS)


@register_task("rotation", 4)
def _task_rotation(img, label, c, h, w):
    return by_label(img, label, [lambda x, k=k: P.rotate_quarter(x, c, h, w, k) for k in range(4)])


@register_task("solarization", len(P.SOLARIZE_LEVELS))
def _task_solarization(img, label, c, h, w):
    return by_label(img, label, [lambda x, t=t: x if t is None else P.solarize(x, t) for t in P.SOLARIZE_LEVELS])


@register_task("color_permutation", len(P.CHANNEL_ORDERS))
def _task_permutation(img, label, c, h, w):
    return by_label(img, label, [lambda x, o=o: P.permute_channels(x, h, w, o) for o in P.CHANNEL_ORDERS])


@register_task("patch_shuffle", len(P.QUARTER_ORDERS))
def _task_shuffle(img, label, c, h, w):
    return by_label(img, label, [lambda x, o=o: P.shuffle_quarters(x, c, h, w, o) for o in P.QUARTER_ORDERS])


# Width and size of the blurs by label; the first label is the image itself.
BLUR_LEVELS = ((0.5, 3), (1.5, 5), (3.0, 7))


@register_task("blur", 1 + len(BLUR_LEVELS))
def _task_blur(img, label, c, h, w):
    return by_label(img, label, [lambda x: x, *(lambda x, s=s, k=k: U.blur_udf((c, h, w), k)(x, F.lit(s)) for s, k in BLUR_LEVELS)])


@register_task("frequency", len(U.BANDS))
def _task_frequency(img, label, c, h, w):
    return U.remove_bands_udf((c, h, w))(img, label)


def pretext(df: DataFrame, img: str, task: str, c: int, h: int, w: int, seed: int, key: str) -> DataFrame:
    """The image changed by the task's label of the row, which is added as ``label``."""
    if task not in TASKS:
        raise KeyError(f"no task {task}; there are {list_tasks()}")
    n, change = TASKS[task]
    return df.withColumn("label", pretext_label(seed, n, F.col(key))).withColumn(img, change(F.col(img), F.col("label"), c, h, w))


def composite(df: DataFrame, img: str, tasks: list[str], c: int, h: int, w: int, seed: int, key: str) -> DataFrame:
    """Several tasks one on top of the other, with their labels in a map."""
    pairs = []
    for k, task in enumerate(tasks):
        df = pretext(df, img, task, c, h, w, seed + k, key).withColumnRenamed("label", f"__label{k}")
        pairs += [F.lit(task), F.col(f"__label{k}")]
    return df.withColumn("labels", F.create_map(*pairs)).drop(*(f"__label{k}" for k in range(len(tasks))))


def check_views(out: tuple[int, int], scale: tuple[float, float], ratio: tuple[float, float], flip: float) -> None:
    """Raises for settings that no crop can have."""
    if min(out) < 1 or not 0 < scale[0] <= scale[1] <= 1 or not 0 < ratio[0] <= ratio[1] or not 0 <= flip <= 1:
        raise ValueError("sides from 1 on, shares of the area in (0, 1], positive ratios and a probability are needed")


def two_views(df: DataFrame, img: str, c: int, h: int, w: int, out: tuple[int, int], seed: int, key: str, scale=(0.2, 1.0), ratio=(3 / 4, 4 / 3), flip: float = 0.5) -> DataFrame:
    """A row for each of two views: ``view``, the crop in ``img``, its ``box`` and ``flipped``; places follow by ``pixels.coordinate_map``."""
    check_views(out, scale, ratio, flip)
    boxes = F.array(*(F.struct(F.lit(v).alias("view"), P.crop_boxes(seed + 10 * v, F.col(key), h, w, scale, ratio).alias("box"), (P.uniform(seed + 10 * v + 4, F.col(key)) < flip).alias("flipped")) for v in (0, 1)))
    d = df.withColumn("__v", F.explode(boxes)).select("*", "__v.*").drop("__v")
    return d.withColumn(img, U.crop_udf((c, h, w), out)(F.col(img), F.col("box.cx"), F.col("box.cy"), F.col("box.hw"), F.col("box.hh"), F.col("flipped")))


def auto_scaled(img: Column, limit: float = 2.0) -> Column:
    """Values in 0..255 brought to 0..1, told by a largest value over ``limit``."""
    return let(F.array_max(img), lambda m: F.transform(img, lambda v: F.when(m > limit, v / 255).otherwise(v)))


def augment_patch(df: DataFrame, img: str, c: int, h: int, w: int, size: int, seed: int, key: str, brightness: float = 0.2, contrast: float = 0.2, sigma: float = 0.5, view_scale: float | None = None) -> DataFrame:
    """Jittered, blurred and resized patches; with ``view_scale`` detail finer than it is lost first."""
    draw = [P.between(seed + k, -m, m, F.col(key)) for k, m in enumerate((brightness, contrast))]
    return df.withColumn(img, U.patch_view_udf((c, h, w), size, view_scale, sigma)(F.col(img), *draw))


def _images(spark, sf_dir, c=1):
    """Vectors of 64 numbers as 8 by 8 grey images, or, with their first 8 numbers again at the end, as 3 by 4 by 6 colour ones."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform(F.col("embedding") if c == 1 else F.concat("embedding", F.slice("embedding", 1, 8)), lambda v: F.round((v.cast("double") + 1) / 2, 4)).alias("img"))


def _fold(name: str, img: Column) -> Column:
    """A number that depends on every value and its place."""
    return F.round(F.aggregate(F.transform(img, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v) + 1e-9, 5).alias(name)


def q_photometric(spark, sf_dir):
    d = _images(spark, sf_dir, 3)
    x = F.col("img")
    return d.select("vec_id", _fold("brightness", P.brightness(x, 1.3)), _fold("contrast", P.contrast(x, 3, 4, 6, 0.7)), _fold("saturation", P.saturation(x, 4, 6, 0.5)), _fold("gray", P.grayscale(x, 4, 6)), _fold("solarize", P.solarize(x, 0.5)), _fold("posterize", P.posterize(x, 4)), _fold("hue", P.hue(x, 4, 6, 0.05)))


def q_geometric(spark, sf_dir):
    d = _images(spark, sf_dir)
    x = F.col("img")
    return d.select("vec_id", _fold("hflip", P.flip_columns(x, 1, 8, 8)), _fold("vflip", P.flip_rows(x, 1, 8, 8)), _fold("rot1", P.rotate_quarter(x, 1, 8, 8, 1)), _fold("rot2", P.rotate_quarter(x, 1, 8, 8, 2)), _fold("grid", P.grid_mask(x, 1, 8, 8, 4, 0.5)), _fold("cutout", P.cutout(x, 1, 8, 8, 2, 3, 4, 2)), _fold("quarters", P.shuffle_quarters(x, 1, 8, 8, (3, 1, 0, 2))))


def q_equalize(spark, sf_dir):
    return _images(spark, sf_dir).select("vec_id", _fold("equalized", P.equalize(F.col("img"), 1, 8, 8)))


def q_resized_sides(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 2000 + 1).alias("h"), (F.col("doc_id") % 1500 + 1).alias("w"))
    s = P.resized_sides(F.col("h"), F.col("w"))
    return d.select("doc_id", s["h"].alias("mh"), s["w"].alias("mw"))


def q_pretext_views(spark, sf_dir):
    """One row for each image and task; the colour and frequency tasks have queries of their own."""
    d, out = _images(spark, sf_dir), None
    for k, task in enumerate(("rotation", "solarization", "patch_shuffle", "blur")):
        part = pretext(d, "img", task, 1, 8, 8, 30 + k, "vec_id").select("vec_id", F.lit(task).alias("task"), "label", _fold("view", F.col("img")))
        out = part if out is None else out.unionByName(part)
    return out


def q_pretext_colors(spark, sf_dir):
    return pretext(_images(spark, sf_dir, 3), "img", "color_permutation", 3, 4, 6, 35, "vec_id").select("vec_id", "label", _fold("view", F.col("img")))


def q_pretext_frequency(spark, sf_dir):
    return pretext(_images(spark, sf_dir), "img", "frequency", 1, 8, 8, 36, "vec_id").select("vec_id", "label", _fold("view", F.col("img")))


def q_pretext_composite(spark, sf_dir):
    d = composite(_images(spark, sf_dir), "img", ["rotation", "solarization"], 1, 8, 8, 40, "vec_id")
    return d.select("vec_id", F.col("labels")["rotation"].alias("turn"), F.col("labels")["solarization"].alias("level"), _fold("view", F.col("img")))


def q_task_registry(spark, sf_dir):
    return spark.createDataFrame([(t, TASKS[t][0]) for t in list_tasks()], "task string, labels int")


def q_preset_registry(spark, sf_dir):
    return spark.createDataFrame([(n, k, kind, float(p)) for n, steps in PRESETS.items() for k, (kind, p, _) in enumerate(steps)], "preset string, step int, transform string, p double")


def q_augmentation_preset(spark, sf_dir):
    d = build("dino_v1", 3, 4, 6, F.col("vec_id")).on(_images(spark, sf_dir, 3), "img")
    return d.select("vec_id", _fold("view", F.col("img")))


def q_drawn_pipeline(spark, sf_dir):
    """A pipeline of changes that SQL has too, each drawn by the row, with the final clamp."""
    k = F.col("vec_id")
    steps = [P.sometimes(TRANSFORMS["hflip"](1, 8, 8, 50, k), 0.5, 51, k), P.sometimes(TRANSFORMS["brightness"](1, 8, 8, 52, k), 0.8, 53, k), P.sometimes(TRANSFORMS["solarize"](1, 8, 8, 54, k), 0.2, 55, k), P.sometimes(TRANSFORMS["posterize"](1, 8, 8, 56, k), 0.3, 57, k)]
    return P.Pipeline(steps).on(_images(spark, sf_dir), "img").select("vec_id", _fold("view", F.col("img")))


def q_drawn_masks(spark, sf_dir):
    d, k = _images(spark, sf_dir), F.col("vec_id")
    return d.select("vec_id", _fold("holes", TRANSFORMS["cutout"](1, 8, 8, 60, k, max_h=3, max_w=2, num_holes=2)(F.col("img"))), _fold("grid", TRANSFORMS["grid_mask"](1, 8, 8, 70, k, grid=4)(F.col("img"))), _fold("patches", P.patch_mask(F.col("img"), 1, 8, 8, 2, 0.4, 75, k)))


def q_neighbourhood(spark, sf_dir):
    d, k = _images(spark, sf_dir), F.col("vec_id")
    d = d.select("vec_id", "img", TRANSFORMS["blur"](1, 8, 8, 80, k)(F.col("img")).alias("b"), TRANSFORMS["sharpen"](1, 8, 8, 81, k)(F.col("img")).alias("s"), TRANSFORMS["rotate"](1, 8, 8, 82, k)(F.col("img")).alias("r"), TRANSFORMS["affine"](1, 8, 8, 83, k)(F.col("img")).alias("a"))
    return d.select("vec_id", _fold("blurred", F.col("b")), _fold("sharpened", F.col("s")), _fold("rotated", F.col("r")), _fold("moved", F.col("a")))


def q_two_views(spark, sf_dir):
    return two_views(_images(spark, sf_dir), "img", 1, 8, 8, (4, 5), 90, "vec_id").select("vec_id", "view", "flipped", _fold("crop", F.col("img")))


def q_augmented_patches(spark, sf_dir):
    d = _images(spark, sf_dir)
    a = augment_patch(d, "img", 1, 8, 8, 4, 120, "vec_id").select("vec_id", _fold("plain", F.col("img")))
    b = augment_patch(d, "img", 1, 8, 8, 4, 130, "vec_id", view_scale=0.5).select("vec_id", _fold("degraded", F.col("img")))
    return a.join(b, "vec_id")


def q_auto_scaled(spark, sf_dir):
    d = _images(spark, sf_dir).withColumn("img", F.when(F.col("vec_id") % 2 == 0, F.transform("img", lambda v: v * 255)).otherwise(F.col("img")))
    return d.select("vec_id", _fold("view", auto_scaled(F.col("img"))))


def q_crop_coordinates(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select("vec_id", P.crop_boxes(5, F.col("vec_id"), 480, 640).alias("box"))
    m = P.coordinate_map(F.col("box"), 4, 4, P.uniform(9, F.col("vec_id")) < 0.5)
    d = d.select("vec_id", F.inline(m)).groupBy("vec_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return d.select("vec_id", *(F.round(F.col(c) + 1e-10, 7).alias(c) for c in ("x0", "x1", "y0", "y1")))


def q_coordinates_on_features(spark, sf_dir):
    """A crop's map of 16 by 16 places brought to 4 by 4 feature cells."""
    d = table(spark, sf_dir, "embeddings").select("vec_id", P.coordinate_map(P.crop_boxes(5, F.col("vec_id"), 480, 640), 16, 16, F.lit(False)).alias("m"))
    d = d.select("vec_id", F.concat(F.transform("m", lambda p: p["x"]), F.transform("m", lambda p: p["y"])).alias("m"))
    return d.select("vec_id", U.resize_udf((2, 16, 16), 4, 4)("m").alias("m")).select("vec_id", _fold("places", F.col("m")))


def q_phash_dct(spark, sf_dir):
    return _images(spark, sf_dir).select("vec_id", U.phash_udf((1, 8, 8))("img").alias("phash"))


def q_freq_band_energy(spark, sf_dir):
    d = _images(spark, sf_dir).select("vec_id", U.band_energy_udf((1, 8, 8))("img").alias("e"))
    return d.select("vec_id", *(F.round(F.col("e")[k] + 1e-10, 7).alias(n) for k, n in enumerate(("low", "mid", "high"))))


def q_patch_udtf(spark, sf_dir):
    spark.udtf.register("siftline_patches", U.patches_udtf((1, 8, 8), per_scale=2, size=4))
    _images(spark, sf_dir).createOrReplaceTempView("siftline_images")
    d = spark.sql("SELECT vec_id, p.patch_id, p.log_scale, p.cx, p.cy, p.patch FROM siftline_images, LATERAL siftline_patches(vec_id, img) p")
    return d.select("vec_id", "patch_id", *(F.round(F.col(c) + 1e-10, 7).alias(c) for c in ("log_scale", "cx", "cy")), _fold("patch", F.col("patch")))


QUERIES = {f.__name__[2:]: f for f in (q_photometric, q_geometric, q_equalize, q_resized_sides, q_pretext_views, q_pretext_colors, q_pretext_frequency, q_pretext_composite, q_task_registry, q_preset_registry, q_augmentation_preset, q_drawn_pipeline, q_drawn_masks, q_neighbourhood, q_two_views, q_augmented_patches, q_auto_scaled, q_crop_coordinates, q_coordinates_on_features, q_phash_dct, q_freq_band_energy, q_patch_udtf)}
_I = "v AS (SELECT vec_id, list_transform((embedding || embedding)[1:{n}], lambda x: round((x::DOUBLE + 1) / 2, 4)) AS img FROM embeddings), e AS (SELECT vec_id, img, unnest(range({n})) AS i, unnest(img) AS x FROM v)"
_S = "round(sum(({}) * (i + 1)) + 1e-9, 5) AS {}"


def _u0(seed, *parts: str) -> str:
    """``pixels.uniform`` in SQL; the seed may be an expression."""
    text = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in (seed, *(parts or ("vec_id",))))
    return f"(('0x' || substr(sha256({text}), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0::DOUBLE)"


def _reflected(i: str, n: int = 8) -> str:
    """A place mirrored into 0 to n - 1, as an integer expression."""
    m = f"(abs({i})::INT % {2 * (n - 1)})"
    return f"(CASE WHEN {m} >= {n} THEN {2 * (n - 1)} - {m} ELSE {m} END)"


def _bilinear(y: str, x: str) -> str:
    """Value of the 8 by 8 list img at a fractional place, mirrored at the border."""
    def at(a, b):
        return f"img[{_reflected(f'floor({y}) + {a}')} * 8 + {_reflected(f'floor({x}) + {b}')} + 1]"

    fy, fx = f"({y} - floor({y}))", f"({x} - floor({x}))"
    return f"({at(0, 0)} * (1 - {fy}) * (1 - {fx}) + {at(0, 1)} * (1 - {fy}) * {fx} + {at(1, 0)} * {fy} * (1 - {fx}) + {at(1, 1)} * {fy} * {fx})"


def _soft(z: str) -> str:
    return f"(1 / (1 + exp(-least(60, greatest(-60, ({z}) / 0.02::DOUBLE)))))"


def _jittered(prev: str, j: int) -> str:
    """The j-th of the four colour changes of a row's rotation, on rows of ``prev`` (vec_id, i, x, t, b, c, s, h) of 3 by 24 pixels."""
    hue = []
    for row in ((0.299, 0.701, 0.168, 0.587, -0.587, 0.330, 0.114, -0.114, -0.497), (0.299, -0.299, -0.328, 0.587, 0.413, 0.035, 0.114, -0.114, 0.292), (0.299, -0.300, 1.250, 0.587, -0.588, -1.050, 0.114, 0.886, -0.203)):
        hue.append(" + ".join(f"{ch} * ({row[3 * k]}::DOUBLE + {row[3 * k + 1]}::DOUBLE * cos(h) + {row[3 * k + 2]}::DOUBLE * sin(h))" for k, ch in enumerate(("r", "g", "bl"))))
    planes = ", ".join(f"max(CASE WHEN i // 24 = {k} THEN x END) OVER (PARTITION BY vec_id, i % 24) AS {ch}" for k, ch in enumerate(("r", "g", "bl")))
    return f"""j{j} AS (SELECT vec_id, i, CASE (t + {j}) % 4 WHEN 0 THEN x * b WHEN 1 THEN (x - m) * c + m WHEN 2 THEN (r + g + bl) / 3 * (1 - s) + x * s
        ELSE CASE i // 24 WHEN 0 THEN {hue[0]} WHEN 1 THEN {hue[1]} ELSE {hue[2]} END END AS x, t, b, c, s, h FROM (SELECT *, avg(x) OVER (PARTITION BY vec_id, i // 24) AS m, {planes} FROM {prev}))"""


_BOX = f"""s AS (SELECT vec_id, {_u0(5)} AS a, {_u0(6)} AS r, {_u0(7)} AS ux, {_u0(8)} AS uy FROM embeddings), z AS (SELECT *, (0.2::DOUBLE + a * 0.8::DOUBLE) * 307200 AS area, exp(ln(0.75::DOUBLE) + r * (ln(4 / 3.0::DOUBLE) - ln(0.75::DOUBLE))) AS asp FROM s),
    c AS (SELECT *, least(sqrt(area * asp), 640) AS cw, least(sqrt(area / asp), 480) AS ch FROM z), b AS (SELECT vec_id, (ux * (640 - cw) + cw / 2) / 640 AS cx, (uy * (480 - ch) + ch / 2) / 480 AS cy, cw / 1280 AS hw, ch / 960 AS hh FROM c)"""
ORACLES = {
    "photometric": "WITH " + _I.format(n=72) + ", p AS (SELECT *, i // 24 AS c, avg(x) OVER (PARTITION BY vec_id, i // 24) AS m, img[i % 24 + 1] AS r, img[i % 24 + 25] AS g, img[i % 24 + 49] AS b, cos(0.05::DOUBLE * 3.14159 * 2) AS ch, sin(0.05::DOUBLE * 3.14159 * 2) AS sh FROM e) SELECT vec_id, " + ", ".join(_S.format(*z) for z in (
        ("x * 1.3::DOUBLE", "brightness"), ("(x - m) * 0.7::DOUBLE + m", "contrast"), ("(r + g + b) / 3 + (x - (r + g + b) / 3) * 0.5::DOUBLE", "saturation"), ("0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b", "gray"),
        ("CASE WHEN x > 0.5 THEN 1 - x ELSE x END", "solarize"), ("floor(x * 16) / 16", "posterize"),
        ("CASE c WHEN 0 THEN r * (0.299 + 0.701 * ch + 0.168 * sh) + g * (0.587 - 0.587 * ch + 0.330 * sh) + b * (0.114 - 0.114 * ch - 0.497 * sh) WHEN 1 THEN r * (0.299 - 0.299 * ch - 0.328 * sh) + g * (0.587 + 0.413 * ch + 0.035 * sh) + b * (0.114 - 0.114 * ch + 0.292 * sh) ELSE r * (0.299 - 0.300 * ch + 1.250 * sh) + g * (0.587 - 0.588 * ch - 1.050 * sh) + b * (0.114 + 0.886 * ch - 0.203 * sh) END", "hue"))) + " FROM p GROUP BY 1",
    "geometric": "WITH " + _I.format(n=64) + ", p AS (SELECT *, i // 8 AS y, i % 8 AS c FROM e) SELECT vec_id, " + ", ".join(_S.format(*z) for z in (
        ("img[y * 8 + 7 - c + 1]", "hflip"), ("img[(7 - y) * 8 + c + 1]", "vflip"), ("img[c * 8 + 7 - y + 1]", "rot1"), ("img[(7 - y) * 8 + 7 - c + 1]", "rot2"), ("CASE WHEN y % 4 < 2 AND c % 4 < 2 THEN 0 ELSE x END", "grid"),
        ("CASE WHEN y BETWEEN 2 AND 5 AND c BETWEEN 3 AND 4 THEN 0 ELSE x END", "cutout"), ("img[([3, 1, 0, 2][(y // 4) * 2 + c // 4 + 1] // 2 * 4 + y % 4) * 8 + [3, 1, 0, 2][(y // 4) * 2 + c // 4 + 1] % 2 * 4 + c % 4 + 1]", "quarters"))) + " FROM p GROUP BY 1",
    "equalize": "WITH " + _I.format(n=64) + """, b AS (SELECT *, least(255, greatest(0, floor(x * 255)))::INT AS l FROM e), c AS (SELECT *, count(*) OVER (PARTITION BY vec_id ORDER BY l RANGE UNBOUNDED PRECEDING) AS cdf FROM b), m AS (SELECT *, min(cdf) OVER (PARTITION BY vec_id) AS low FROM c)
        SELECT vec_id, round(sum(CASE WHEN low = 64 THEN x ELSE (cdf - low) / (64 - low)::DOUBLE END * (i + 1)) + 1e-9, 5) AS equalized FROM m GROUP BY 1""",
    "resized_sides": "WITH d AS (SELECT doc_id, n_chars % 2000 + 1 AS h, doc_id % 1500 + 1 AS w FROM documents) SELECT doc_id, CASE WHEN greatest(h, w) <= 640 THEN h ELSE greatest(1, round_even(h * 640 / greatest(h, w)::DOUBLE, 0)) END::INT AS mh, CASE WHEN greatest(h, w) <= 640 THEN w ELSE greatest(1, round_even(w * 640 / greatest(h, w)::DOUBLE, 0)) END::INT AS mw FROM d",
    "pretext_views": "WITH " + _I.format(n=64) + f""", l AS (SELECT vec_id, img, floor({_u0(30)} * 4)::INT AS l0, floor({_u0(31)} * 4)::INT AS l1, floor({_u0(32)} * 24)::INT AS l2, floor({_u0(33)} * 4)::INT AS l3 FROM v),
        p AS (SELECT *, i // 8 AS y, i % 8 AS c, img[i + 1] AS x FROM l, (SELECT unnest(range(64))::INT AS i)),
        o AS (SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS k, [a, b, c, 6 - a - b - c] AS o FROM (SELECT unnest(range(4)) AS a), (SELECT unnest(range(4)) AS b), (SELECT unnest(range(4)) AS c) WHERE a <> b AND a <> c AND b <> c),
        g AS (SELECT j, unnest([NULL, 0.5, 1.5, 3.0])::DOUBLE AS s, unnest([0, 1, 2, 3]) AS k FROM (SELECT 1 AS j)),
        w AS (SELECT k, s, d, exp(-d * d / (2 * s * s)) / sum(exp(-d * d / (2 * s * s))) OVER (PARTITION BY k) AS w FROM g, (SELECT unnest(range(-3, 4)) AS d) WHERE k > 0 AND abs(d) <= k),
        b AS (SELECT vec_id, l3, i, sum(a.w * e.w * img[{_reflected('y + a.d')} * 8 + {_reflected('c + e.d')} + 1]) AS z FROM p JOIN w a ON a.k = l3 JOIN w e ON e.k = l3 GROUP BY 1, 2, 3)
        SELECT vec_id, 'rotation' AS task, l0 AS label, {_S.format("img[CASE l0 WHEN 0 THEN i WHEN 1 THEN c * 8 + 7 - y WHEN 2 THEN 63 - i ELSE (7 - c) * 8 + y END + 1]", "view")} FROM p GROUP BY 1, l0
        UNION ALL SELECT vec_id, 'solarization', l1, {_S.format("CASE WHEN l1 > 0 AND x > [1, 0.75, 0.5, 0.25][l1 + 1] THEN 1 - x ELSE x END", "view")} FROM p GROUP BY 1, l1
        UNION ALL SELECT vec_id, 'patch_shuffle', l2, {_S.format("img[(o[(y // 4) * 2 + c // 4 + 1] // 2 * 4 + y % 4) * 8 + o[(y // 4) * 2 + c // 4 + 1] % 2 * 4 + c % 4 + 1]", "view")} FROM p JOIN o ON k = l2 GROUP BY 1, l2
        UNION ALL SELECT vec_id, 'blur', l3, {_S.format("x", "view")} FROM p WHERE l3 = 0 GROUP BY 1, l3 UNION ALL SELECT vec_id, 'blur', l3, {_S.format("z", "view")} FROM b GROUP BY 1, l3""",
    "pretext_colors": "WITH " + _I.format(n=72) + f""", o AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS k, [a, b, 3 - a - b] AS o FROM (SELECT unnest(range(3)) AS a), (SELECT unnest(range(3)) AS b) WHERE a <> b)
        SELECT vec_id, k::INT AS label, {_S.format("img[o[i // 24 + 1] * 24 + i % 24 + 1]", "view")} FROM e JOIN o ON k = floor({_u0(35)} * 6) GROUP BY 1, 2""",
    "pretext_frequency": "WITH " + _I.format(n=64) + f""", l AS (SELECT vec_id, img, floor({_u0(36)} * 7)::INT AS label FROM v), t AS (SELECT unnest(range(8))::INT AS t),
        f AS (SELECT vec_id, label, a.t AS u, b.t AS v, sum(img[i + 1] * cos(2 * pi() * (a.t * (i // 8) + b.t * (i % 8)) / 8)) AS re, -sum(img[i + 1] * sin(2 * pi() * (a.t * (i // 8) + b.t * (i % 8)) / 8)) AS im FROM l, t a, t b, (SELECT unnest(range(64))::INT AS i) GROUP BY 1, 2, 3, 4),
        d AS (SELECT *, sqrt((((u + 4) % 8) - 4) ** 2 + (((v + 4) % 8) - 4) ** 2) / sqrt(32::DOUBLE) AS d FROM f),
        k AS (SELECT *, {_soft('d - 0.1')} AS kl, least(1, greatest(0, {_soft('0.1 - d')} + {_soft('d - 0.4')})) AS km, {_soft('0.4 - d')} AS kh FROM d),
        m AS (SELECT *, CASE WHEN label IN (1, 4, 5) THEN kl ELSE 1 END * CASE WHEN label IN (2, 4, 6) THEN km ELSE 1 END * CASE WHEN label IN (3, 5, 6) THEN kh ELSE 1 END AS m FROM k),
        z AS (SELECT vec_id, label, i, least(1, greatest(0, sum(m * (re * cos(2 * pi() * (u * (i // 8) + v * (i % 8)) / 8) - im * sin(2 * pi() * (u * (i // 8) + v * (i % 8)) / 8))) / 64)) AS z FROM m, (SELECT unnest(range(64))::INT AS i) GROUP BY 1, 2, 3)
        SELECT vec_id, label, {_S.format("z", "view")} FROM z GROUP BY 1, 2""",
    "pretext_composite": "WITH " + _I.format(n=64) + f""", l AS (SELECT vec_id, img, floor({_u0(40)} * 4)::INT AS turn, floor({_u0(41)} * 4)::INT AS level FROM v), p AS (SELECT *, i // 8 AS y, i % 8 AS c FROM l, (SELECT unnest(range(64))::INT AS i)),
        r AS (SELECT *, img[CASE turn WHEN 0 THEN i WHEN 1 THEN c * 8 + 7 - y WHEN 2 THEN 63 - i ELSE (7 - c) * 8 + y END + 1] AS x FROM p)
        SELECT vec_id, turn, level, {_S.format("CASE WHEN level > 0 AND x > [1, 0.75, 0.5, 0.25][level + 1] THEN 1 - x ELSE x END", "view")} FROM r GROUP BY 1, 2, 3""",
    "preset_registry": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {k}, '{kind}', {p}::DOUBLE)" for n, steps in PRESETS.items() for k, (kind, p, _) in enumerate(steps)) + ") t(preset, step, transform, p)",
    "task_registry": "SELECT * FROM (VALUES ('blur', 4), ('color_permutation', 6), ('frequency', 7), ('patch_shuffle', 24), ('rotation', 4), ('solarization', 4)) t(task, labels)",
    "augmentation_preset": "WITH " + _I.format(n=72) + f""", j AS (SELECT vec_id, i, x, floor({_u0(4)} * 4)::INT AS t, 0.6::DOUBLE + {_u0(0)} * 0.8::DOUBLE AS b, 0.6::DOUBLE + {_u0(1)} * 0.8::DOUBLE AS c, 0.6::DOUBLE + {_u0(2)} * 0.8::DOUBLE AS s, (-0.1::DOUBLE + {_u0(3)} * 0.2::DOUBLE) * 3.14159 * 2 AS h FROM e),
        {_jittered("j", 0)}, {_jittered("j0", 1)}, {_jittered("j1", 2)}, {_jittered("j2", 3)},
        a AS (SELECT e.vec_id, e.i, CASE WHEN {_u0(50, 'e.vec_id')} < 0.8 THEN j3.x ELSE e.x END AS x FROM e JOIN j3 ON j3.vec_id = e.vec_id AND j3.i = e.i),
        g AS (SELECT vec_id, i, CASE WHEN {_u0(150)} < 0.2 THEN sum(x * CASE i // 24 WHEN 0 THEN 0.299::DOUBLE WHEN 1 THEN 0.587::DOUBLE ELSE 0.114::DOUBLE END) OVER (PARTITION BY vec_id, i % 24) ELSE x END AS x FROM a),
        l AS (SELECT vec_id, list(x ORDER BY i) AS img, 0.1::DOUBLE + {_u0(200)} * 1.9::DOUBLE AS sg FROM g GROUP BY 1), d AS (SELECT unnest([-1, 0, 1]) AS d),
        w AS (SELECT vec_id, i, exp(-(p.d * p.d + q.d * q.d) / (2 * sg * sg)) AS w, img[i // 24 * 24 + {_reflected('i % 24 // 6 + p.d', 4)} * 6 + {_reflected('i % 6 + q.d', 6)} + 1] AS v, img FROM l, d p, d q, (SELECT unnest(range(72))::INT AS i)),
        z AS (SELECT vec_id, i, CASE WHEN {_u0(250)} < 0.5 THEN sum(w * v) / sum(w) ELSE any_value(img[i + 1]) END AS x FROM w GROUP BY 1, 2), o AS (SELECT vec_id, i, CASE WHEN {_u0(350)} < 0.2 AND x > 0.5 THEN 1 - x ELSE x END AS x FROM z)
        SELECT vec_id, {_S.format("least(1, greatest(0, x))", "view")} FROM o GROUP BY 1""",
    "drawn_pipeline": "WITH " + _I.format(n=64) + f""", a AS (SELECT vec_id, i, CASE WHEN {_u0(51)} < 0.5 THEN img[i // 8 * 8 + 7 - i % 8 + 1] ELSE x END AS x FROM e), b AS (SELECT vec_id, i, CASE WHEN {_u0(53)} < 0.8 THEN least(1, greatest(0, x * (0.6::DOUBLE + {_u0(52)} * 0.8::DOUBLE))) ELSE x END AS x FROM a),
        c AS (SELECT vec_id, i, CASE WHEN {_u0(55)} < 0.2 AND x > 0.5 THEN 1 - x ELSE x END AS x FROM b), d AS (SELECT vec_id, i, CASE WHEN {_u0(57)} < 0.3 THEN floor(x * 16) / 16 ELSE x END AS x FROM c)
        SELECT vec_id, {_S.format("least(1, greatest(0, x))", "view")} FROM d GROUP BY 1""",
    "drawn_masks": "WITH " + _I.format(n=64) + f""", d AS (SELECT *, i // 8 AS y, i % 8 AS c, floor({_u0(60)} * 6) AS t0, floor({_u0(61)} * 7) AS l0, floor({_u0(62)} * 6) AS t1, floor({_u0(63)} * 7) AS l1, floor({_u0(70)} * 4)::INT AS dy, floor({_u0(71)} * 4)::INT AS dx FROM e),
        p AS (SELECT vec_id, p FROM v, (SELECT unnest(range(16)) AS p) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY {_u0(75, 'vec_id', 'p')}, p) <= 6),
        g AS (SELECT d.*, p.p IS NOT NULL AS gone FROM d LEFT JOIN p ON p.vec_id = d.vec_id AND p.p = y // 2 * 4 + c // 2)
        SELECT vec_id, {_S.format("CASE WHEN (y >= t0 AND y < t0 + 3 AND c >= l0 AND c < l0 + 2) OR (y >= t1 AND y < t1 + 3 AND c >= l1 AND c < l1 + 2) THEN 0 ELSE x END", "holes")}, {_S.format("CASE WHEN (y + dy) % 4 < 2 AND (c + dx) % 4 < 2 THEN 0 ELSE x END", "grid")}, {_S.format("CASE WHEN gone THEN 0 ELSE x END", "patches")} FROM g GROUP BY 1""",
    "neighbourhood": "WITH " + _I.format(n=64) + f""", d AS (SELECT *, i // 8 AS y, i % 8 AS c, 0.1::DOUBLE + {_u0(80)} * 1.9::DOUBLE AS s, radians(-30::DOUBLE + {_u0(82)} * 60) AS r, radians(-10::DOUBLE + {_u0(83)} * 20) AS a, -0.1::DOUBLE + {_u0(84)} * 0.2::DOUBLE AS ty, -0.1::DOUBLE + {_u0(85)} * 0.2::DOUBLE AS tx, 0.9::DOUBLE + {_u0(86)} * 0.2::DOUBLE AS z FROM e),
        k AS (SELECT unnest(range(-2, 3)) AS d), w AS (SELECT vec_id, i, a.d AS dy, b.d AS dx, img, y, c, exp(-a.d * a.d / (2 * s * s)) * exp(-b.d * b.d / (2 * s * s)) AS w FROM d, k a, k b),
        bl AS (SELECT vec_id, i, sum(w * img[{_reflected('y + dy')} * 8 + {_reflected('c + dx')} + 1]) / sum(w) AS b FROM w GROUP BY 1, 2),
        sh AS (SELECT vec_id, i, avg(img[least(7, greatest(0, y + dy)) * 8 + least(7, greatest(0, c + dx)) + 1]) AS m FROM w WHERE abs(dy) < 2 AND abs(dx) < 2 GROUP BY 1, 2),
        q AS (SELECT *, cos(r) * (y - 3.5) - sin(r) * (c - 3.5) + 3.5 AS ry, sin(r) * (y - 3.5) + cos(r) * (c - 3.5) + 3.5 AS rx, (cos(a) * (y - 3.5 - ty * 8) - sin(a) * (c - 3.5 - tx * 8)) / z + 3.5 AS ay, (sin(a) * (y - 3.5 - ty * 8) + cos(a) * (c - 3.5 - tx * 8)) / z + 3.5 AS ax FROM d),
        f AS (SELECT vec_id, i, x, {_bilinear('ry', 'rx')} AS ro, {_bilinear('ay', 'ax')} AS mo FROM q)
        SELECT f.vec_id, {_S.replace("(i + 1)", "(f.i + 1)").format("b", "blurred")}, {_S.replace("(i + 1)", "(f.i + 1)").format("least(1, greatest(0, x + (x - m)))", "sharpened")}, {_S.replace("(i + 1)", "(f.i + 1)").format("ro", "rotated")}, {_S.replace("(i + 1)", "(f.i + 1)").format("mo", "moved")}
        FROM f JOIN bl USING (vec_id, i) JOIN sh USING (vec_id, i) GROUP BY 1""",
    "two_views": "WITH " + _I.format(n=64) + f""", s AS (SELECT vec_id, img, view, {_u0('90 + 10 * view')} AS a, {_u0('91 + 10 * view')} AS r, {_u0('92 + 10 * view')} AS ux, {_u0('93 + 10 * view')} AS uy, {_u0('94 + 10 * view')} < 0.5 AS flipped FROM v, (SELECT unnest([0, 1]) AS view)),
        z AS (SELECT *, (0.2::DOUBLE + a * 0.8::DOUBLE) * 64 AS area, exp(ln(0.75::DOUBLE) + r * (ln(4 / 3.0::DOUBLE) - ln(0.75::DOUBLE))) AS asp FROM s), b AS (SELECT *, least(sqrt(area * asp), 8) AS cw, least(sqrt(area / asp), 8) AS ch FROM z),
        p AS (SELECT *, i // 5 AS y, CASE WHEN flipped THEN 4 - i % 5 ELSE i % 5 END AS c FROM b, (SELECT unnest(range(20))::INT AS i)),
        q AS (SELECT *, least(7, greatest(0, ((uy * (8 - ch) + ch / 2) / 8 + (2 * (y + 0.5) / 4 - 1) * ch / 16) * 8 - 0.5)) AS ry, least(7, greatest(0, ((ux * (8 - cw) + cw / 2) / 8 + (2 * (c + 0.5) / 5 - 1) * cw / 16) * 8 - 0.5)) AS rx FROM p)
        SELECT vec_id, view, flipped, {_S.format(_bilinear('ry', 'rx'), "crop")} FROM q GROUP BY 1, 2, 3""",
    "augmented_patches": "WITH " + _I.format(n=64) + f""", t AS (SELECT vec_id, i, x, i // 8 AS y, i % 8 AS c FROM e), h AS (SELECT vec_id, y // 2 * 4 + c // 2 AS i, avg(x) AS x FROM t GROUP BY 1, 2), hv AS (SELECT vec_id, list(x ORDER BY i) AS h FROM h GROUP BY 1),
        u AS (SELECT vec_id, i, least(3, greatest(0, (i // 8 + 0.5) / 2 - 0.5)) AS ry, least(3, greatest(0, (i % 8 + 0.5) / 2 - 0.5)) AS rx, h FROM hv, (SELECT unnest(range(64))::INT AS i)),
        both_ AS (SELECT vec_id, i, x, 120 AS s FROM e UNION ALL SELECT vec_id, i, (h[floor(ry)::INT * 4 + floor(rx)::INT + 1] * (1 - ry + floor(ry)) + h[least(3, floor(ry) + 1)::INT * 4 + floor(rx)::INT + 1] * (ry - floor(ry))) * (1 - rx + floor(rx)) + (h[floor(ry)::INT * 4 + least(3, floor(rx) + 1)::INT + 1] * (1 - ry + floor(ry)) + h[least(3, floor(ry) + 1)::INT * 4 + least(3, floor(rx) + 1)::INT + 1] * (ry - floor(ry))) * (rx - floor(rx)), 130 FROM u),
        j AS (SELECT vec_id, s, i // 8 AS y, i % 8 AS c, (x - avg(x) OVER (PARTITION BY vec_id, s)) * (1 + (-0.2::DOUBLE + {_u0('s + 1')} * 0.4::DOUBLE)) + avg(x) OVER (PARTITION BY vec_id, s) + (-0.2::DOUBLE + {_u0('s')} * 0.4::DOUBLE) AS x FROM both_),
        k AS (SELECT d, exp(-d * d / 0.5::DOUBLE) / sum(exp(-d * d / 0.5::DOUBLE)) OVER () AS w FROM (SELECT unnest([-1, 0, 1]) AS d)),
        g AS (SELECT vec_id, s, y - a.d AS y, c - b.d AS c, sum(x * a.w * b.w) AS x FROM j, k a, k b WHERE y - a.d BETWEEN 0 AND 7 AND c - b.d BETWEEN 0 AND 7 GROUP BY 1, 2, 3, 4), o AS (SELECT vec_id, s, y // 2 * 4 + c // 2 AS i, avg(x) AS x FROM g GROUP BY 1, 2, 3)
        SELECT vec_id, round(sum(CASE WHEN s = 120 THEN x * (i + 1) ELSE 0 END) + 1e-9, 5) AS plain, round(sum(CASE WHEN s = 130 THEN x * (i + 1) ELSE 0 END) + 1e-9, 5) AS degraded FROM o GROUP BY 1""",
    "auto_scaled": "WITH " + _I.format(n=64) + f""", s AS (SELECT vec_id, i, CASE WHEN vec_id % 2 = 0 THEN x * 255 ELSE x END AS x FROM e), m AS (SELECT *, max(x) OVER (PARTITION BY vec_id) > 2 AS big FROM s) SELECT vec_id, {_S.format("CASE WHEN big THEN x / 255 ELSE x END", "view")} FROM m GROUP BY 1""",
    "crop_coordinates": f"WITH {_BOX}, m AS (SELECT *, CASE WHEN {_u0(9)} < 0.5 THEN 1 ELSE 0 END AS f FROM b) SELECT vec_id, round(cx - 0.75 * hw + 1e-10, 7) AS x0, round(cx + 0.75 * hw + 1e-10, 7) AS x1, round(cy - 0.75 * hh + 1e-10, 7) AS y0, round(cy + 0.75 * hh + 1e-10, 7) AS y1 FROM m",
    "coordinates_on_features": f"WITH {_BOX}, p AS (SELECT *, i // 16 AS k, i % 16 // 4 AS y, i % 4 AS x FROM b, (SELECT unnest(range(32))::INT AS i)) SELECT vec_id, " + _S.format("CASE k WHEN 0 THEN cx + (2 * (x + 0.5) / 4 - 1) * hw ELSE cy + (2 * (y + 0.5) / 4 - 1) * hh END", "places") + " FROM p GROUP BY 1",
    "phash_dct": "WITH " + _I.format(n=64) + """, r AS (SELECT unnest(range(32))::INT AS i), t AS (SELECT unnest(range(8))::INT AS k),
        m AS (SELECT u.k AS u, t.k AS k, sum(cos(pi() * (2 * i + 1) * u.k / 64) * greatest(0, 1 - abs(least(7, greatest(0, (i + 0.5) / 4 - 0.5)) - t.k))) AS m FROM r, t, t u GROUP BY 1, 2),
        c AS (SELECT vec_id, a.u AS u, b.u AS v, sum(a.m * b.m * img[a.k * 8 + b.k + 1]) AS x FROM v, m a, m b GROUP BY 1, 2, 3), h AS (SELECT *, x > median(x) OVER (PARTITION BY vec_id) AS bit FROM c),
        y AS (SELECT vec_id, u, sum(CASE WHEN bit THEN 1 << (7 - v) ELSE 0 END)::INT AS byte FROM h GROUP BY 1, 2) SELECT vec_id, string_agg(format('{:02x}', byte), '' ORDER BY u) AS phash FROM y GROUP BY 1""",
    "freq_band_energy": "WITH " + _I.format(n=64) + """, t AS (SELECT unnest(range(8))::INT AS t), f AS (SELECT vec_id, a.t AS u, b.t AS v, sqrt(sum(x * cos(2 * pi() * (a.t * (i // 8) + b.t * (i % 8)) / 8)) ** 2 + sum(x * sin(2 * pi() * (a.t * (i // 8) + b.t * (i % 8)) / 8)) ** 2) AS m FROM e, t a, t b GROUP BY 1, 2, 3),
        d AS (SELECT *, sqrt((((u + 4) % 8) - 4) ** 2 + (((v + 4) % 8) - 4) ** 2) / sqrt(32::DOUBLE) AS d FROM f), s AS (SELECT vec_id, sum(CASE WHEN d < 0.1 THEN m ELSE 0 END) AS l, sum(CASE WHEN d >= 0.1 AND d < 0.4 THEN m ELSE 0 END) AS mi, sum(CASE WHEN d >= 0.4 THEN m ELSE 0 END) AS h FROM d GROUP BY 1)
        SELECT vec_id, round(l / (l + mi + h + 1e-8) + 1e-10, 7) AS low, round(mi / (l + mi + h + 1e-8) + 1e-10, 7) AS mid, round(h / (l + mi + h + 1e-8) + 1e-10, 7) AS high FROM s""",
    "patch_udtf": "WITH " + _I.format(n=64) + f""", q AS (SELECT vec_id, img, p AS patch_id, [0.2, 0.5][p // 2 + 1]::DOUBLE AS s FROM v, (SELECT unnest(range(4))::INT AS p)),
        b AS (SELECT *, s / 2 + (1 - s) * {_u0('2 * patch_id')} AS cx, s / 2 + (1 - s) * {_u0('2 * patch_id + 1')} AS cy FROM q), p AS (SELECT *, i // 4 AS y, i % 4 AS c FROM b, (SELECT unnest(range(16))::INT AS i)),
        r AS (SELECT *, least(7, greatest(0, (cy + (2 * (y + 0.5) / 4 - 1) * s / 2) * 8 - 0.5)) AS ry, least(7, greatest(0, (cx + (2 * (c + 0.5) / 4 - 1) * s / 2) * 8 - 0.5)) AS rx FROM p)
        SELECT vec_id, patch_id, round(ln(s) + 1e-10, 7) AS log_scale, round(cx + 1e-10, 7) AS cx, round(cy + 1e-10, 7) AS cy, {_S.format(_bilinear('ry', 'rx'), "patch")} FROM r GROUP BY 1, 2, s, cx, cy""",
}
