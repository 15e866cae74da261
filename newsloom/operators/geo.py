"""Nearest place of a point, place filters and the geographic drill-down."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from newsloom.plans.filters import EventFilter, has_country, select_events
from newsloom.sources.lookups import with_country_names

LAT, LON, COUNTRY = "ActionGeo_Lat", "ActionGeo_Long", "ActionGeo_CountryCode"

# Cube sides of the search as straight-line distance on a unit globe: 3 km, 25 km and 204 km.
CUBE_SIDES = (0.0005, 0.004, 0.032)
# Sides for points farther than that from any place: 1,630 km, 204 km and 25 km.
DESCENT_SIDES = (0.256, 0.032, 0.004)
# Distances are compared in whole steps of 1e-12, so that ties do not hang on rounding.
DISTANCE_STEPS = 1e12
# Added to squared bounds, so that neither steps nor rounding rule out a nearest place.
SLACK = 1e-9


ON_GLOBE = {
    "x": "cos(radians(lat)) * cos(radians(lon))",
    "y": "cos(radians(lat)) * sin(radians(lon))",
    "z": "sin(radians(lat))",
}


def _on_globe() -> dict[str, Column]:
    return {axis: F.expr(text) for axis, text in ON_GLOBE.items()}


def _span(side: float) -> int:
    return int(2 / side) + 6


def _cube(side: float) -> str:
    """Number of the cube of side `side` around (x, y, z), as SQL text."""
    x, y, z = (f"(floor({axis} / {side}D) + {int(1 / side) + 3})" for axis in "xyz")
    return f"(({x} * {_span(side)} + {y}) * {_span(side)} + {z})"


def _cubes_around(side: float) -> str:
    """The cube of (x, y, z) and the 26 cubes that touch it, as SQL text."""
    near, span = (-1, 0, 1), _span(side)
    shifts = (f"{(i * span + j) * span + k}L" for i in near for j in near for k in near)
    return f"transform(array({', '.join(shifts)}), shift -> {_cube(side)} + shift)"


@dataclass(frozen=True)
class PlaceIndex:
    """Distinct places as the search reads them.

    `near` holds per cube side the places with their cube, `boxes` per side of the descent the occupied cubes
    with the smallest box around their places and, below the first side, the cube `above` they lie in.
    """

    near: dict[float, DataFrame]
    boxes: tuple[DataFrame, ...]


def place_index(places: DataFrame) -> PlaceIndex:
    """The index of `places`, computed wherever it is read; `write_place_index` stores it.

    Of places with equal coordinates the one with the smallest id stays; places without coordinates are left out.
    """
    spots = (
        places.where("lat IS NOT NULL AND lon IS NOT NULL")
        .groupBy("lat", "lon")
        .agg(F.min_by(F.struct("place_id", "country_code", "state", "city"), "place_id").alias("place"))
    )
    spots = spots.select("place", *(column.alias(axis) for axis, column in _on_globe().items()))
    first, *smaller = DESCENT_SIDES
    inner = (_boxes(spots, side, f"{_cube(upper)} AS above") for upper, side in zip(DESCENT_SIDES, smaller))
    return PlaceIndex({side: _near(spots, side) for side in CUBE_SIDES}, (_boxes(spots, first), *inner))


def write_place_index(places: DataFrame, folder: str, buckets: int | None = None) -> None:
    """Stores the index of `places` below `folder`, in place of the one that was read there before.

    The tables are bucketed by the cube the search joins on, so that a search beyond the broadcast threshold shuffles
    points only. `buckets` is the session's number of shuffle partitions unless given. Every call writes a build of its
    own and names it in `<folder>/builds` when all its tables are complete: a write may stop anywhere, and searches
    under way keep the build they began with.
    """
    spark = places.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    build = uuid.uuid4().hex
    tables = _tables(place_index(places))
    for name, rows in tables.items():
        key = _bucket_key(name)
        rows = rows.repartition(buckets, key).write.option("path", f"{_build_path(folder, build)}/{name}")
        rows.bucketBy(buckets, key).sortBy(key).saveAsTable(_table_name(build, name))
    fields = (F.lit(_fields(rows)).alias(name) for name, rows in tables.items())
    done = spark.range(1).select(F.lit(build).alias("build"), F.lit(buckets).alias("buckets"), F.current_timestamp().alias("at"), *fields)
    done.coalesce(1).write.mode("append").parquet(_builds_path(folder))


def read_place_index(spark: SparkSession, folder: str) -> PlaceIndex:
    """The newest complete index below `folder`, whichever session wrote it."""
    newest = spark.read.parquet(_builds_path(folder)).orderBy(F.desc("at"), "build").first()
    tables = {}
    for name in (*(f"near_{at}" for at in range(len(CUBE_SIDES))), *(f"boxes_{at}" for at in range(len(DESCENT_SIDES)))):
        table, key = _table_name(newest.build, name), _bucket_key(name)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({newest[name]}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) "
            f"INTO {newest.buckets} BUCKETS LOCATION '{_build_path(folder, newest.build)}/{name}'"
        )
        tables[name] = spark.table(table)
    return PlaceIndex(
        {side: tables[f"near_{at}"] for at, side in enumerate(CUBE_SIDES)},
        tuple(tables[f"boxes_{at}"] for at in range(len(DESCENT_SIDES))),
    )


def _builds_path(folder: str) -> str:
    return f"{folder.rstrip('/')}/builds"


def _build_path(folder: str, build: str) -> str:
    return f"{folder.rstrip('/')}/build={build}"


def _tables(index: PlaceIndex) -> dict[str, DataFrame]:
    near = {f"near_{at}": index.near[side] for at, side in enumerate(CUBE_SIDES)}
    return near | {f"boxes_{at}": rows for at, rows in enumerate(index.boxes)}


def _fields(rows: DataFrame) -> str:
    return ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in rows.schema)


def _bucket_key(name: str) -> str:
    return "cube" if name.startswith("near") or name == "boxes_0" else "above"


def _table_name(build: str, name: str) -> str:
    return f"place_index_{build}_{name}"


def nearest_places(points: DataFrame, places: DataFrame | PlaceIndex) -> DataFrame:
    """The nearest place of every distinct (lat, lon), exactly; ties go to the smaller id.

    Points and places lie on a unit globe cut into cubes, so neither the date line nor
    the poles need care. A point looks into its own cube and those around it: whatever is
    nearer than one cube side is found there. Points that find nothing that near go on to
    larger cubes. Dense regions are thus settled in small cubes. Both sides hold distinct
    coordinates, which bounds what one cube can hold; points already settled carry a key of
    their own and spread evenly. Points far from any place descend from large cubes to small
    ones and open only those that can hold the nearest place.

    Joins carry no hint: a table of places below Spark's size threshold is broadcast, and
    then the points stay partitioned as they are; a larger one is shuffled by cube, unless it
    is a stored index, which lies in buckets by cube already.
    """
    index = places if isinstance(places, PlaceIndex) else place_index(places)
    found = points.select("lat", "lon").where("lat IS NOT NULL AND lon IS NOT NULL").distinct()
    found = found.withColumn("place", F.lit(None).cast(index.near[CUBE_SIDES[0]].schema["near"].dataType))
    for side in CUBE_SIDES:
        found = _look(found, index, side)
    opened = cubes_to_open(found, index).join(index.near[DESCENT_SIDES[-1]], "cube", "left")
    return _nearest(opened, "near IS NOT NULL").select("lat", "lon", "place.*")


_SQUARE = "(pow(x - near_x, 2) + pow(y - near_y, 2) + pow(z - near_z, 2))"

# The key of a point that looks into no cube: like no cube's number, and spread evenly.
_OWN_KEY = f"-1L - abs(xxhash64(lat, lon) % {1 << 40}L)"


def _rank(fits: str) -> str:
    return f"if({fits}, struct(floor({_SQUARE} * {DISTANCE_STEPS}D) AS steps, near.place_id AS id), NULL)"


def _near(spots: DataFrame, side: float) -> DataFrame:
    return spots.selectExpr(f"{_cube(side)} AS cube", "place AS near", "x AS near_x", "y AS near_y", "z AS near_z")


def _nearest(asking: DataFrame, fits: str) -> DataFrame:
    """Each point with the place it has, or the nearest one it met that fits."""
    return asking.groupBy("lat", "lon").agg(F.expr(f"coalesce(first(place), min_by(near, {_rank(fits)}))").alias("place"))


def _look(found: DataFrame, index: PlaceIndex, side: float) -> DataFrame:
    """Give points without a place the nearest one within `side`, from their cube and those around it."""
    asking = found.withColumns(_on_globe())
    asking = asking.withColumn("cube", F.expr(f"explode(if(place IS NULL, {_cubes_around(side)}, array({_OWN_KEY})))"))
    return _nearest(asking.join(index.near[side], "cube", "left"), f"near IS NOT NULL AND {_SQUARE} <= {side * side!r}D")


def _boxes(spots: DataFrame, side: float, *above: str) -> DataFrame:
    """The occupied cubes of one side, with the smallest box that holds a cube's places."""
    bounds = (f(axis).alias(f"{name}_{axis}") for axis in "xyz" for name, f in (("low", F.min), ("high", F.max)))
    return spots.groupBy(*map(F.expr, above), F.expr(f"{_cube(side)} AS cube")).agg(*bounds)


def _least(box: str = "") -> str:
    """Square of the least distance from (x, y, z) to a box, as SQL text."""
    return " + ".join(f"pow(greatest({box}low_{a} - {a}, {a} - {box}high_{a}, 0D), 2)" for a in "xyz")


def _most(box: str = "") -> str:
    """Square of the distance from (x, y, z) to the farthest corner of a box, as SQL text."""
    return " + ".join(f"pow(greatest({a} - {box}low_{a}, {box}high_{a} - {a}), 2)" for a in "xyz")


def cubes_to_open(found: DataFrame, index: PlaceIndex) -> DataFrame:
    """Rows (lat, lon, place, x, y, z, cube): the smallest cubes of the descent that can hold a point's nearest place.

    No place is farther than the farthest corner of the best cube, so a cube whose box begins
    beyond that is not opened. The largest cubes number a few hundred whatever the number of places,
    since so many cover the globe; they reach the points as one array. Smaller ones are
    joined by the cube they lie in. A point that has a place, or for which there is none, keeps one row with its own key.
    """
    boxes, *inner = index.boxes
    every = boxes.agg(F.collect_list(F.struct(*boxes.columns)).alias("boxes")).scalar()
    asking = found.withColumns(_on_globe()).withColumn("boxes", F.when(F.col("place").isNull(), every))
    asking = asking.withColumn("bound", F.expr(f"array_min(transform(boxes, b -> {_most('b.')}))"))
    opened = F.expr(f"explode_outer(filter(boxes, b -> {_least('b.')} <= bound + {SLACK}D))")
    asking = asking.withColumn("box", opened).withColumn("above", F.expr(f"coalesce(box.cube, {_OWN_KEY})"))
    by_point = Window.partitionBy("lat", "lon")
    for smaller in inner:
        asking = asking.select("lat", "lon", "place", *"xyz", "above")
        inside = asking.join(smaller, "above", "left")
        inside = inside.withColumn("bound", F.min(F.expr(_most())).over(by_point))
        asking = inside.where(f"bound IS NULL OR {_least()} <= bound + {SLACK}D").withColumn("above", F.coalesce("cube", "above"))
    return asking.select("lat", "lon", "place", *"xyz", F.col("above").alias("cube"))


def event_points(events: DataFrame) -> DataFrame:
    return events.select(F.col(LAT).alias("lat"), F.col(LON).alias("lon"))


def _same_name(column: str, name: str) -> Column:
    return F.lower(F.trim(F.col(column))) == name.strip().lower()


def keep_place(rows: DataFrame, places: DataFrame, state: str | None, city: str | None) -> DataFrame:
    """Events whose nearest place has the given state and city name."""
    located = nearest_places(event_points(rows), places)
    if state:
        located = located.where(_same_name("state", state))
    if city:
        located = located.where(_same_name("city", city))
    located = located.select(F.col("lat").alias(LAT), F.col("lon").alias(LON))
    return rows.join(located, [LAT, LON], "left_semi")


def drill_countries(events: DataFrame, f: EventFilter, names: DataFrame, limit: int = 40) -> DataFrame:
    rows = select_events(events, f.with_(country_code=None), None, has_country())
    counts = rows.groupBy(F.col(COUNTRY).alias("code")).agg(F.count("*").alias("count"))
    top = counts.orderBy(F.desc("count"), "code").limit(limit)
    named = with_country_names(top, names, "code", "code")
    return named.select(
        F.coalesce("code_name", "code").alias("name"), "code", F.col("code_display").alias("display"), "count"
    )


def drill_places(
    events: DataFrame,
    f: EventFilter,
    places: DataFrame,
    country_code: str,
    state: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """States of a country, or cities of one of its states, by number of events.

    Events are counted per point before the points are located, so the search runs over
    distinct points only. All points take part.
    """
    here = F.col(COUNTRY) == country_code.upper()
    rows = select_events(events, f.with_(country_code=None), None, here)
    counts = (
        rows.where(F.col(LAT).isNotNull() & F.col(LON).isNotNull())
        .groupBy(F.col(LAT).alias("lat"), F.col(LON).alias("lon"))
        .agg(F.count("*").alias("n"))
    )
    located = counts.join(nearest_places(counts, places), ["lat", "lon"])
    if state is not None:
        located = located.where(F.col("state") == state)
    level = "state" if state is None else "city"
    named = located.where(F.col(level) != "").groupBy(F.col(level).alias("name"))
    counts = named.agg(F.sum("n").alias("count"))
    return counts.orderBy(F.desc("count"), "name").limit(limit or (20 if state is None else 15))


def drill_available(events: DataFrame, f: EventFilter, country_code: str) -> DataFrame:
    """Whether a country has located events in the window, and why not."""
    here = F.col(COUNTRY) == country_code.upper()
    rows = select_events(events, f.with_(country_code=None), None, here)
    located = rows.where(F.col(LAT).isNotNull() & F.col(LON).isNotNull())
    available = F.count("*") > 0
    reason = F.when(
        ~available,
        "State drill needs the latitude and longitude of the action; load newer data.",
    )
    return located.agg(available.alias("state_available"), reason.alias("state_reason"))
