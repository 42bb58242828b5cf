"""Product labels in XML: discovery, parsing (once a label, in Arrow batches), companion files, sun angles."""

from __future__ import annotations

import re
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyquilt.functions import text as X

SKIP_MARKERS = ("_brw", "_grd")
CORNER_NAMES = (("upper_left", "ul"), ("upper_right", "ur"), ("lower_right", "lr"), ("lower_left", "ll"))


def discover(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(labels as ``path, xml``, passed-over files as ``path, reason``) under root; browse and grid labels are not opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(root)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    skip = name.contains(SKIP_MARKERS[0]) | name.contains(SKIP_MARKERS[1])
    return files.where(~skip).select("path", F.decode("content", "UTF-8").alias("xml")), files.where(skip).select("path", F.lit("auxiliary label").alias("reason"))


def any_of(tag: str) -> str:
    return f'//*[local-name()="{tag}"]'


#: Elements whose first occurrence, at any depth, is read.
SINGLE = ("logical_identifier", "file_name", "data_type", "pixel_resolution", "projection", "area", "start_date_time", "stop_date_time", "sun_elevation", "sun_azimuth", "solar_incidence", "file_size", "md5_checksum")
#: Image arrays in order of precedence, axes, and blocks of corners in order of precedence.
ARRAYS = ("Array_2D_Image", "Array_3D_Spectrum", "Array_3D_Image")
AXES = ("line", "sample", "band")
BLOCKS = ("Refined_Corner_Coordinates", "System_Level_Coordinates")
CORNERS = tuple(f"{c}_{x}" for c, _ in CORNER_NAMES for x in ("latitude", "longitude"))
PROLOGUE = re.compile(r"^\ufeff?\s*(<\?xml[^>]*\?>)?")
FIELDS = pa.struct([(n, pa.string()) for n in (*SINGLE, "component")] + [(n, pa.list_(pa.string())) for n in (*AXES, "corners")])


def fields(xml: str | None) -> dict | None:
    """What is read from one label, in one pass; None where the text is no well-formed observational label."""
    try:
        root = ElementTree.fromstring(PROLOGUE.sub("", xml or "", count=1))
    except (ElementTree.ParseError, ValueError):
        return None
    local = lambda e: e.tag.rpartition("}")[2]
    text = lambda e: "".join(e.itertext()).strip(" \t\n\v\f\r") or None
    if local(root) != "Product_Observational":
        return None
    by_name: dict[str, list] = {}
    for e in root.iter():
        by_name.setdefault(local(e), []).append(e)

    def length(array: str, axis: str) -> str | None:
        for e in by_name.get(array, ()):
            for part in e.iter():
                if part is not e and local(part) == "Axis_Array":
                    names = [text(c) for c in part if local(c) == "axis_name"]
                    if names and " ".join((names[0] or "").split()).lower() == axis:
                        for c in part:
                            if local(c) == "elements":
                                return text(c)
        return None

    def inside(block: str) -> list[str | None]:
        found: dict[str, str | None] = {}
        for e in by_name.get(block, ()):
            for c in e.iter():
                if (name := local(c)) in CORNERS:
                    found.setdefault(name, text(c))
        return [found.get(c) for c in CORNERS]

    out: dict = {n: text(by_name[n][0]) for n in SINGLE if n in by_name}
    out["component"] = next((text(c) for e in by_name.get("Observing_System_Component", ()) for c in e if local(c) == "name"), None)
    out |= {axis: [length(array, axis) for array in ARRAYS] for axis in AXES}
    out["corners"] = inside(BLOCKS[0] if BLOCKS[0] in by_name else BLOCKS[1])
    return out


def parse(labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Products of labels (``path, xml``); texts that are no well-formed observational label give no row.

    A row needs an instrument, both dimensions and a file name; the footprint may be empty: corners are those of the
    refined block if there is one, else of the system block, and none if any value is missing.
    """

    def read(xml: pa.Array) -> pa.Array:
        return pa.array([fields(x.as_py()) for x in xml], FIELDS)

    read.__annotations__ = {"xml": pa.Array, "return": pa.Array}
    names = ", ".join(f"{f.name}: {'string' if f.type == pa.string() else 'array<string>'}" for f in FIELDS)
    found = labels.where(F.col("xml").isNotNull()).select("path", *keep, "xml", F.arrow_udf(read, f"struct<{names}>")("xml").alias("x")).where(F.col("x").isNotNull())
    get = lambda tag: F.col(f"x.{tag}")
    num = lambda tag: get(tag).try_cast("double")
    axis = lambda name: F.coalesce(*[F.get(f"x.{name}", F.lit(k)).try_cast("long") for k in range(len(ARRAYS))])
    corner = lambda k: F.get("x.corners", F.lit(k)).try_cast("double")
    corners = F.array(*[F.struct(corner(2 * k).alias("lat"), corner(2 * k + 1).alias("lon")) for k in range(4)])
    footprint = F.when(F.forall(corners, lambda c: c["lat"].isNotNull() & c["lon"].isNotNull()), corners).otherwise(F.slice(corners, 1, 0))
    file_name = get("file_name")
    kind = X.instrument(get("component"), get("logical_identifier"), file_name, F.col("xml"))
    rows = found.select(
        *keep, kind.alias("instrument"), F.regexp_replace("path", "[^/]+$", F.coalesce(file_name, F.lit(""))).alias("file_path"), F.col("path").alias("label_path"),
        axis("line").alias("lines"), axis("sample").alias("samples"), get("data_type").alias("datatype"), footprint.alias("footprint"),
        X.strip(F.regexp_replace(file_name, r"\.[^.]*$", "")).alias("product_id"), get("logical_identifier").alias("logical_identifier"), num("pixel_resolution").alias("pixel_resolution_m"),
        get("projection").alias("projection"), get("area").alias("area"), get("start_date_time").alias("start_time"), get("stop_date_time").alias("stop_time"),
        num("sun_elevation").alias("sun_elevation_deg"), num("sun_azimuth").alias("sun_azimuth_deg"), num("solar_incidence").alias("solar_incidence_deg"),
        F.coalesce(axis("band"), F.lit(1)).cast("long").alias("bands"), get("file_size").try_cast("long").alias("file_size_bytes"), get("md5_checksum").alias("md5_checksum"), file_name.alias("_file"),
    )
    return rows.where("instrument IS NOT NULL AND lines IS NOT NULL AND samples IS NOT NULL AND _file IS NOT NULL").drop("_file")


def band_table(xml: Column) -> Column:
    """Struct ``centers, widths, min_center, max_center`` of a spectral label."""
    texts = lambda tag: F.transform(F.xpath(xml, F.lit(f"{any_of(tag)}/text()")), lambda x: x.try_cast("double"))
    c = texts("center_wavelength")
    return F.struct(c.alias("centers"), texts("band_width").alias("widths"), F.array_min(c).alias("min_center"), F.array_max(c).alias("max_center"))


def sun_angles(products: DataFrame) -> DataFrame:
    """``product_id, elev, azim``; of repeated ids the last path wins."""
    return products.groupBy("product_id").agg(F.max_by(F.struct(F.col("sun_elevation_deg").alias("elev"), F.col("sun_azimuth_deg").alias("azim")), "label_path").alias("a")).select("product_id", "a.elev", "a.azim")


def companions(products: DataFrame, listing: DataFrame) -> DataFrame:
    """products with ``geometry_csv_path``: in the nearest geometry folder above the label, the file of the same stem, else the only grid there.

    listing: ``path`` of all grid files. A folder with several grids and no exact match decides for null.
    """
    grids = listing.select(F.col("path").alias("grid"), F.regexp_replace("path", "/geometry/[^/]*$", "").alias("at")).where(F.col("grid").rlike("/geometry/[^/]*$"))
    depth = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.array_join(F.slice(F.split("label_path", "/"), 1, F.greatest(F.size(F.split("label_path", "/")) - 1 - i, F.lit(1))), "/")))
    want = F.lower(F.regexp_replace(F.element_at(F.split("label_path", "/"), -1), r"_d_img_(.*)\.xml$", "_g_grd_$1.csv"))
    climbed = products.select("label_path", want.alias("want"), depth.alias("up", "at")).join(grids, "at")
    folder = climbed.groupBy("label_path", "up").agg(F.max(F.when(F.lower(F.element_at(F.split("grid", "/"), -1)) == F.col("want"), F.col("grid"))).alias("exact"), F.count_if(F.lower("grid").rlike(r"_g_grd_[^/]*\.csv$")).alias("n"), F.max(F.when(F.lower("grid").rlike(r"_g_grd_[^/]*\.csv$"), F.col("grid"))).alias("only"))
    decided = folder.where("exact IS NOT NULL OR n > 0").withColumn("nth", F.row_number().over(Window.partitionBy("label_path").orderBy("up"))).where("nth = 1")
    return products.drop("geometry_csv_path").join(decided.select("label_path", F.coalesce("exact", F.when(F.col("n") == 1, F.col("only"))).alias("geometry_csv_path")), "label_path", "left")
