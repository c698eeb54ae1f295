"""Projections, predicates and unit rules as Columns. Missing is NULL; predicates are never NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverlens import config as C


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def to_db(c, floor: float = 1e-6) -> Column:
    """P1. greatest() skips NULL, so nodata is guarded."""
    c = _col(c)
    return F.when(c.isNotNull(), 10 * F.log10(F.greatest(c, F.lit(floor))))


def tier_a(post, pre, drop: float = C.VV_DROP_DB, water: float = C.VV_WATER_DB) -> Column:
    """P2. Drop below -3 dB, now below -15 dB, before at or above it."""
    post, pre = _col(post), _col(pre)
    return _true((post - pre < drop) & (post < water) & (pre >= water))


def water_single(vv, ref, valid, water: float = C.VV_WATER_DB) -> Column:
    """P3. Dark now, no reference water, among valid pixels."""
    return _true((_col(vv) < water) & ~_true(_col(ref)) & _true(_col(valid)))


def wet_for_window(post, pre, occurrence, slope) -> Column:
    """P4. P2 without permanent water (occurrence 60 or more) and steep ground (above 5 degrees)."""
    return tier_a(post, pre) & ~_true(_col(occurrence) >= 60) & ~_true(_col(slope) > 5)


def agreement_label(a, b, ref, pre, valid, water: float = C.VV_WATER_DB) -> Column:
    """P5. 1 both wet, 0 both dry, -1 disagreement, permanent water or no data."""
    a, b = _true(_col(a)), _true(_col(b))
    bad = ~_true(_col(valid)) | _true(_col(ref)) | _col(pre).isNull() | _true(_col(pre) < water)
    return F.when(bad, -1).when(a & b, 1).when(~a & ~b, 0).otherwise(-1)


def strict_label(dvv, vv, slope, ref) -> Column:
    """P6. 1 for clear water, 0 for clear land, NULL between."""
    dvv, vv, slope = _col(dvv), _col(vv), _col(slope)
    land = ~_true(_col(ref))
    return F.when(_true((dvv < -5) & (vv < -16) & (slope < 2)) & land, 1).when(_true((dvv > -1) & (vv > -13)) & land, 0)


def feature_stack(df: DataFrame, keep=("pixel",)) -> DataFrame:
    """P7. From post_vv, post_vh, pre_vv, pre_vh, slope, elevation, occurrence."""
    made = {"vv_vh": "post_vv - post_vh", "dvv": "post_vv - pre_vv", "dvh": "post_vh - pre_vh"}
    return df.select(*keep, "post_vv", "post_vh", *(F.expr(e).alias(n) for n, e in made.items()), "slope", "elevation", "occurrence")


def reflectance(dn, offset: float = -1000.0, scale: float = 10000.0) -> Column:
    """P8."""
    dn = _col(dn)
    return F.when(dn != 0, (dn + offset) / scale)


def ndwi(green, nir, eps: float = 1e-6) -> Column:
    """P9."""
    g, n = _col(green), _col(nir)
    return F.when(F.abs(g + n) >= eps, (g - n) / (g + n))


#: Scene classes that hide the ground (no data, defects, shadow, clouds, cirrus).
HIDDEN_CLASSES = (0, 1, 3, 8, 9, 10)


def classify_water(index, scl, t_water: float = 0.1, t_dry: float = -0.1) -> Column:
    """P10. 1 water, 0 dry, NULL uncertain (hidden classes, a missing or NaN index, between the bounds);
    both bounds count."""
    if t_dry > t_water:
        raise ValueError("the dry bound is above the water bound")
    i = _col(index)
    return F.when(_col(scl).isin(*HIDDEN_CLASSES) | i.isNull() | F.isnan(i), F.lit(None).cast("int")).when(i >= t_water, 1).when(i <= t_dry, 0)


def palette_class(r, g, b, a, colour: tuple[int, int, int], tolerance: int = 10, alpha: int = 128) -> Column:
    """P11."""
    near = [F.abs(_col(x) - v) <= tolerance for x, v in zip((r, g, b), colour, strict=True)]
    return _true(near[0] & near[1] & near[2] & (_col(a) >= alpha))


def pixel_area_m2(y, px: float, py: float | None = None) -> Column:
    """P12. Ground area of a Web-Mercator pixel whose centre has northing y."""
    lat = 2 * F.atan(F.exp(_col(y) / C.EARTH_RADIUS)) - F.lit(1.5707963267948966)
    return F.pow(F.cos(lat), 2) * px * (py or px)


def _finite(c) -> Column:
    c = _col(c).cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def to_density(c, area, nodata: float | None = None) -> Column:
    """P13. Nodata, missing and non-finite counts are zero, so that totals are conserved."""
    return F.when(_col(c) == nodata, 0.0).otherwise(_finite(c)) / _col(area) if nodata is not None else _finite(c) / _col(area)


def to_counts(d, area) -> Column:
    """P13. Back to counts; non-finite densities are zero."""
    return _finite(d) * _col(area)


def edge_class(c, edges) -> Column:
    """P14. Number of edges reached."""
    total = F.lit(0)
    for e in edges:
        total = total + F.coalesce((_col(c) >= e).cast("int"), F.lit(0))
    return total


def pixel_xy(idx, width: int, x0: float, y0: float, size: float) -> list[Column]:
    """P15. row, col and the centre of a flat pixel index on a north-up grid."""
    i = _col(idx)
    row, col = F.floor(i / width).cast("long"), F.pmod(i, F.lit(width)).cast("long")
    return [row.alias("row"), col.alias("col"), (x0 + (col + 0.5) * size).alias("x"), (y0 - (row + 0.5) * size).alias("y")]


def pixel_index(row, col, width: int) -> Column:
    return _col(row) * width + _col(col)


def render_alerts(flagged: DataFrame, templates: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """P16. One text per flagged zone and language; a language without a template is an error.
    Templates hold {zone} and {km2}; they are a few rows, so they are broadcast."""
    if languages:
        want = templates.sparkSession.createDataFrame([(x,) for x in languages], "lang string")
        templates = want.join(templates, "lang", "left").withColumn("template", F.when(F.col("template").isNull(), F.raise_error(F.concat(F.lit("no template: "), "lang"))).otherwise(F.col("template")))
    text = F.replace(F.replace("template", F.lit("{zone}"), F.col("zone").cast("string")), F.lit("{km2}"), F.format_string("%.1f", "km2"))
    return flagged.crossJoin(F.broadcast(templates)).select("zone", "lang", text.alias("text"))


def to_ha(value, unit) -> Column:
    """P17. An unknown unit or a negative value is an error."""
    unit = F.lower(F.trim(_col(unit)))
    factor = F.create_map(*(F.lit(x) for kv in C.HA_PER.items() for x in kv))[unit]
    bad = factor.isNull() | (_col(value) < 0)
    return F.when(bad, F.raise_error(F.concat(F.lit("bad area unit or value: "), F.coalesce(unit, F.lit("null")))).cast("double")).otherwise(_col(value) * factor)


def normalize_value(value, unit) -> Column:
    """P17. struct(value, unit): areas in hectares, amounts of money and counts as they are. A unit that
    is neither, and a negative value, is an error."""
    name, v = F.lower(F.trim(_col(unit))), _col(value)
    factor = F.create_map(*(F.lit(x) for kv in C.HA_PER.items() for x in kv))[name]
    plain = name.isin(*C.PLAIN_UNITS)
    bad = F.coalesce(v < 0, F.lit(False)) | ~(factor.isNotNull() | F.coalesce(plain, F.lit(False)))
    as_is = F.struct((v * F.coalesce(factor, F.lit(1.0))).alias("value"), F.when(plain, name).otherwise(F.lit("ha")).alias("unit"))
    said = F.concat_ws(" ", F.lit("no value and unit to go by:"), v.cast("string"), name)
    return F.when(bad, F.raise_error(said).cast("struct<value: double, unit: string>")).otherwise(as_is)


def feet_to_m(c) -> Column:
    return _col(c) * C.METRES_PER_FOOT


def cusec_to_bcm_day(c) -> Column:
    return _col(c) * C.CUSEC_TO_BCM_DAY


def km2(ha) -> Column:
    return _col(ha) / 100


#: Metric to class, so that classes are never mixed.
METRIC_CLASS = {
    "max_area_affected": "wet_area",
    "area_affected": "wet_area",
    "crop_damage_area": "crop_damage_area",
    "crop_damage_value": "crop_damage_value",
    "lives_lost": "lives",
    "houses_damaged": "houses",
}


def metric_class(c) -> Column:
    """P18."""
    return F.create_map(*(F.lit(x) for kv in METRIC_CLASS.items() for x in kv))[_col(c)]


def milestones(df: DataFrame, cls: str) -> DataFrame:
    return df.where(metric_class("metric") == cls)


def num(c) -> Column:
    """P19. Blank, NA and NaN become NULL, as does what is no number."""
    d = F.trim(_col(c).cast("string")).try_cast("double")
    return F.when(~F.isnan(d), d)


def pct_of_capacity(df: DataFrame, capacity: DataFrame) -> DataFrame:
    """P20. df(dam, storage) joined with capacity(dam, capacity); an unknown dam is an error."""
    j = df.join(capacity, "dam", "left")
    cap = F.when(F.col("capacity").isNull(), F.raise_error(F.concat(F.lit("unknown dam: "), "dam")).cast("double")).otherwise(F.col("capacity"))
    return j.withColumn("pct_capacity", 100 * F.col("storage") / cap)


def value_at_risk(ha, yield_t: float = C.PADDY_T_PER_HA, price: float = C.PADDY_INR_PER_T) -> Column:
    """P21."""
    return _col(ha) * yield_t * price


def headroom_deficit(actual_bcm, median_bcm, capacity_bcm) -> list[Column]:
    """P22. Storage above the median in BCM and as points of capacity."""
    d = _col(actual_bcm) - _col(median_bcm)
    return [d.alias("deficit_bcm"), F.try_divide(100 * d, _col(capacity_bcm)).alias("deficit_pct")]


def absorbable_days(deficit_bcm, peak_cusec) -> Column:
    return F.try_divide(_col(deficit_bcm), cusec_to_bcm_day(peak_cusec))


def label_events(df: DataFrame, threshold: float = C.EVENT_FRACTION) -> DataFrame:
    """P23. Strictly above."""
    return df.withColumn("wet_event", (F.col("fraction") > threshold).cast("int"))


#: Spellings of zones that differ between boundary layers and tables.
ZONE_ALIASES = {
    "Shahid Bhagat Singh Nagar": "Nawanshahr",
    "Shaheed Bhagat Singh Nagar": "Nawanshahr",
    "SBS Nagar": "Nawanshahr",
    "S.B.S. Nagar": "Nawanshahr",
    "Nawan Shahr": "Nawanshahr",
    "Nawanshahr": "Nawanshahr",
    "Ferozepur": "Firozpur",
    "Ferozepore": "Firozpur",
    "Firozepur": "Firozpur",
    "Ropar": "Rupnagar",
    "Roopnagar": "Rupnagar",
    "Tarn Taran Sahib": "Tarn Taran",
    "Taran Taran": "Tarn Taran",
    "Sri Muktsar Sahib": "Muktsar",
    "S.A.S. Nagar": "Sahibzada Ajit Singh Nagar",
    "SAS Nagar": "Sahibzada Ajit Singh Nagar",
    "Mohali": "Sahibzada Ajit Singh Nagar",
}
#: Districts that were split off later, for comparison with the older layer.
SPLIT_ZONES = {"Fazilka": "Firozpur", "Pathankot": "Gurdaspur", "Malerkotla": "Sangrur"}


def canonical_zone(c) -> Column:
    """P24. White space collapsed, aliases mapped, unknown names kept."""
    name = F.trim(F.regexp_replace(_col(c), r"\s+", " "))
    return F.coalesce(F.create_map(*(F.lit(x) for kv in ZONE_ALIASES.items() for x in kv))[name], name)


def merged_zone(c) -> Column:
    """P24. The canonical zone, with split zones under the zone they came from."""
    name = canonical_zone(c)
    return F.coalesce(F.create_map(*(F.lit(x) for kv in SPLIT_ZONES.items() for x in kv))[name], name)


def normalize_subzone(c) -> Column:
    """P25. A trailing roman numeral becomes -II; other names stay."""
    c = F.trim(_col(c))
    head, tail = F.regexp_extract(c, r"^(.*?)[\s-]+([IVXivx]+)$", 1), F.upper(F.regexp_extract(c, r"^(.*?)[\s-]+([IVXivx]+)$", 2))
    return F.when(tail.isin("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"), F.concat(head, F.lit("-"), tail)).otherwise(c)


def slug(c) -> Column:
    """P26."""
    return F.regexp_replace(F.lower(F.trim(_col(c))), "[^a-z0-9]+", "_")


#: The two basins used as spatial folds.
BASINS = {
    "ravi_beas": ["Gurdaspur", "Amritsar", "Kapurthala", "Tarn Taran", "Hoshiarpur", "Jalandhar"],
    "sutlej": ["Firozpur", "Faridkot", "Ludhiana", "Moga", "Rupnagar", "Nawanshahr", "Fatehgarh Sahib"],
}


def fold_of(c) -> Column:
    """P27. The basin of a zone, NULL outside both."""
    z, out = canonical_zone(c), F.lit(None).cast("string")
    for basin, zones in BASINS.items():
        out = F.coalesce(F.when(z.isin(zones), basin), out)
    return out
