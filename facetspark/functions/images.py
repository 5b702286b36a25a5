"""Image maps of documents: layouts and URLs.

Flat layout: ``map<key, struct<imgid, rev, sizes map, …>>`` with keys like ``1`` (an upload),
``front`` or ``front_fr`` (a selection). Split layout: ``struct<uploaded map, selected map>``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetspark.functions.codes import code_path

# Selections, size names with their pixel sizes, and how a selection was made.
IMAGE_TYPES = ("front", "ingredients", "nutrition", "packaging")
IMAGE_SIZES = {"": 400, "small_": 200, "thumb_": 100}
DISPLAY_SIZES = {"display": 400, "small": 200, "thumb": 100}
GENERATION_KEYS = ("geometry", "x1", "y1", "x2", "y2", "angle", "coordinates_image_size", "normalize", "white_magic")


def flatten_images(images: Column) -> Column:
    """The split layout as the flat one: selections keyed ``type_lang``, sizes without their URLs.

    How a selection was made becomes plain string fields, null for uploads.
    """
    def sizes(c: Column) -> Column:
        return F.transform_values(c, lambda k, s: F.struct(s["h"].alias("h"), s["w"].alias("w")))

    missing = F.lit(None).cast("string")
    uploads = F.transform(
        F.map_entries(images["uploaded"]),
        lambda e: F.struct(
            e["key"].alias("key"),
            F.struct(
                missing.alias("imgid"), missing.alias("rev"), sizes(e["value"]["sizes"]).alias("sizes"),
                e["value"]["uploaded_t"].alias("uploaded_t"), e["value"]["uploader"].alias("uploader"),
                *[missing.alias(k) for k in GENERATION_KEYS],
            ).alias("value"),
        ),
    )
    selections = F.flatten(F.transform(
        F.map_entries(images["selected"]),
        lambda by_type: F.transform(
            F.map_entries(by_type["value"]),
            lambda e: F.struct(
                F.concat_ws("_", by_type["key"], e["key"]).alias("key"),
                F.struct(
                    e["value"]["imgid"].alias("imgid"), e["value"]["rev"].alias("rev"),
                    sizes(e["value"]["sizes"]).alias("sizes"),
                    F.lit(None).cast("long").alias("uploaded_t"), missing.alias("uploader"),
                    *[e["value"]["generation"][k].alias(k) for k in GENERATION_KEYS],
                ).alias("value"),
            ),
        ),
    ))
    # Uploads are keyed by number and selections by type, so the keys never meet.
    both = F.filter(F.array(uploads, selections), lambda part: part.isNotNull())
    return F.map_from_entries(F.flatten(both))


def image_urls(
    df: DataFrame, base_url: str, code: str = "code", images: str = "images", lang: str = "lang",
    lang_codes: str | None = "languages_codes", types: Sequence[str] = IMAGE_TYPES,
) -> DataFrame:
    """URLs of the selected images in three sizes, as columns ``image_front_url``, ….

    The plain selection of a type is preferred to the one in the document's language; the front
    images also come as ``image_url``, …. ``selected_images`` maps type, size and language to URLs,
    for every language of the document that has a selection.
    """
    m, path = F.col(images), code_path(F.col(code))

    def has_sizes(key: Column) -> Column:
        return F.coalesce(F.size(m[key]["sizes"]) > 0, F.lit(False))

    def url(key: Column, pixels: int) -> Column:
        name = F.concat_ws(".", key, m[key]["rev"].cast("string"), F.lit(str(pixels)))
        full = F.concat(F.lit(base_url.rstrip("/") + "/"), path, F.lit("/"), name, F.lit(".jpg"))
        return F.when(key.isNotNull(), full)

    columns = {}
    for kind in types:
        own = F.concat(F.lit(f"{kind}_"), F.col(lang))
        key = F.when(has_sizes(F.lit(kind)), F.lit(kind)).when(has_sizes(own), own)
        for size, pixels in IMAGE_SIZES.items():
            columns[f"image_{kind}_{size}url"] = url(key, pixels)
            if kind == "front":
                columns[f"image_{size}url"] = url(key, pixels)
    if lang_codes:
        def by_lang(kind: str, pixels: int) -> Column:
            present = F.filter(F.col(lang_codes), lambda l: has_sizes(F.concat(F.lit(f"{kind}_"), l)))
            return F.map_from_entries(F.transform(
                F.array_distinct(present), lambda l: F.struct(l, url(F.concat(F.lit(f"{kind}_"), l), pixels))
            ))

        per_type = F.map_from_arrays(
            F.array(*[F.lit(k) for k in types]),
            F.array(*[
                F.map_from_arrays(
                    F.array(*[F.lit(s) for s in DISPLAY_SIZES]),
                    F.array(*[by_lang(kind, p) for p in DISPLAY_SIZES.values()]),
                )
                for kind in types
            ]),
        )
        columns["selected_images"] = F.map_filter(
            per_type, lambda k, v: F.coalesce(F.size(v["display"]) > 0, F.lit(False))
        )
    return df.withColumns(columns)
