"""Places: lookups, distances, nearest cities and countries for tables of points.

Tables: countries (name, iso2, iso3, phone_code), states (name, state_code, iso2), places (cca2, name, lat, lon of a country's middle),
cities (name, country_code, state_code, lat, lon). Points: a key, lat and lon.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_accents
from ..workers import ready
from .models import KNearestNeighbors

EARTH_KM = 6371.0


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    a, b, c, d = (F.radians(F.col(x) if isinstance(x, str) else x) for x in (lat1, lon1, lat2, lon2))
    u, v = F.sin((c - a) / 2), F.sin((d - b) / 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(u * u + F.cos(a) * F.cos(c) * v * v)))


def norm(name: Column | str) -> Column:
    t = F.regexp_replace(strip_accents(F.lower(F.col(name) if isinstance(name, str) else name)), r"[^\p{L}\p{N}\s]+", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def similarity(a: Column, b: Column) -> Column:
    """1 if equal, .92 if one contains the other, else by edit distance; 0 for empty ones."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.92).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(a, b) / F.nullif(longest, F.lit(0))))


MANY = 2_000_000  # cities whose coordinates a worker holds (24 bytes each)
KM_A_DEGREE = EARTH_KM * np.pi / 180


def _km(lat: float, lon: float, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
    a, b, c, d = (np.radians(x) for x in (lat, lon, lats, lons))
    u, v = np.sin((c - a) / 2), np.sin((d - b) / 2)
    return 2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(u * u + np.cos(a) * np.cos(c) * v * v)))


def _degrees(lat: float, lon: float, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
    return np.sqrt((lats - lat) ** 2 + (lons - lon) ** 2)


def _around(lat: float, lon: float, k: int, places: tuple[np.ndarray, np.ndarray, np.ndarray], distance, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the k nearest places, which are sorted by latitude: a band of latitudes that grows until it must hold them.

    No place beyond the band is nearer than the band's half width, in the units of ``distance`` (``unit`` a degree).
    """
    ids, lats, lons = places
    half = 0.5
    while True:
        a, b = np.searchsorted(lats, lat - half, "left"), np.searchsorted(lats, lat + half, "right")
        d = distance(lat, lon, lats[a:b], lons[a:b])
        kth = np.partition(d, k - 1)[k - 1] if len(d) >= k else np.inf
        if kth <= half * unit * (1 - 1e-9) or (a == 0 and b == len(lats)):
            near = np.flatnonzero(d <= kth)
            near = near[np.lexsort((ids[a:b][near], d[near]))][:k]
            return ids[a:b][near], d[near]
        half *= 2


def nearest(points: DataFrame, key: str, cities: DataFrame, city_key: str, k: int, in_km: bool, keep: int | None = None, within_km: float | None = None) -> DataFrame | None:
    """key, rank, city_key, distance_km of the k nearest cities, by kilometres or by degrees; None if there are too many cities to hold.

    Of a point's k the first ``keep`` within ``within_km`` come out, numbered anew: only these leave the worker and are sorted.
    Points are spread by key, however few files they come in. Cities are counted first; up to ``MANY`` of them go to every worker, where each point looks at a band of latitudes.
    """
    if cities.count() > MANY:
        return None
    rows = cities.select(city_key, "lat", "lon").toPandas().sort_values("lat", kind="stable")
    held = points.sparkSession.sparkContext.broadcast(tuple(rows[c].to_numpy() for c in (city_key, "lat", "lon")))
    distance, unit = (_km, KM_A_DEGREE) if in_km else (_degrees, 1.0)

    def run(batches):
        ids, lats, lons = held.value
        where = None if in_km else {i: n for n, i in enumerate(ids)}
        for b in batches:
            out = []
            for i, lat, lon in zip(b[key], b["lat"].astype(float), b["lon"].astype(float)):
                if len(ids) and np.isfinite(lat) and np.isfinite(lon):
                    found, d = _around(lat, lon, min(k, len(ids)), held.value, distance, unit)
                    if not in_km:
                        at = np.array([where[x] for x in found])
                        d = _km(lat, lon, lats[at], lons[at])
                    near = [(x, float(y)) for x, y in zip(found, d) if within_km is None or y <= within_km][:keep]
                    out += [(i, n, x, y) for n, (x, y) in enumerate(near, 1)]
            yield pd.DataFrame(out, columns=[key, "rank", city_key, "distance_km"])

    ready(points.sparkSession)
    kinds = dict(points.dtypes)[key], dict(cities.dtypes)[city_key]
    return points.select(key, "lat", "lon").repartition(F.col(key)).mapInPandas(run, f"`{key}` {kinds[0]}, rank int, `{city_key}` {kinds[1]}, distance_km double")


@dataclass
class Geo:
    countries: DataFrame
    states: DataFrame
    places: DataFrame
    cities: DataFrame

    def country_list(self) -> DataFrame:
        return self.countries.orderBy("name")

    def country(self, name_or_code: str) -> DataFrame:
        q = name_or_code.strip().lower()
        return self.countries.where((F.lower("name") == q) | (F.lower("iso2") == q) | (F.lower("iso3") == q))

    def states_of(self, name_or_code: str) -> DataFrame:
        return self.states.join(self.country(name_or_code).select("iso2"), "iso2", "left_semi").orderBy("name")

    def cities_of(self, country_code: str, state_code: str | None = None, limit: int = 500) -> DataFrame:
        d = self.cities.where(F.upper("country_code") == country_code.strip().upper())
        if state_code is not None:
            d = d.where(F.upper("state_code") == state_code.strip().upper())
        return d.orderBy("name", "lat", "lon").limit(limit)

    def nearest_cities(self, points: DataFrame, key: str, k: int = 5, within_km: float | None = None, country: str | None = None, city_key: str = "city_id") -> DataFrame:
        """key, rank, city_key, distance_km.

        Without a country the max(4k, 20) cities nearest in degrees are candidates, and stay in that order; with one, cities rank by kilometres.
        """
        mine = self.cities if country is None else self.cities.where(F.upper("country_code") == country.strip().upper())
        found = nearest(points, key, mine, city_key, max(4 * k, 20) if country is None else k, country is not None, k, within_km)
        if found is not None:
            rank = F.row_number().over(Window.partitionBy(key).orderBy("rank"))
            return found.withColumn("rank", rank).where(F.col("rank") <= k).select(key, "rank", city_key, "distance_km")
        if country is not None:
            c = self.cities.where(F.upper("country_code") == country.strip().upper()).select(city_key, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
            d = points.crossJoin(c).withColumn("distance_km", haversine_km("lat", "lon", "_lat", "_lon"))
            order = [F.col("distance_km"), F.col(city_key)]
        else:
            train = self.cities.select(F.col(city_key).alias("row_id"), F.array("lat", "lon").alias("features"), F.array("lat", "lon").alias("label"))
            q = points.select(key, F.array("lat", "lon").alias("features"), "lat", "lon")
            near = KNearestNeighbors(max(4 * k, 20)).fit(train).neighbours(q, key)
            d = near.join(points.select(key, "lat", "lon"), key).select(key, F.col("rank").alias("_r"), F.col("neighbour").alias(city_key), haversine_km("lat", "lon", F.col("label")[0], F.col("label")[1]).alias("distance_km"))
            order = [F.col("_r")]
        if within_km is not None:
            d = d.where(F.col("distance_km") <= within_km)
        rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
        return d.withColumn("rank", rank).where(F.col("rank") <= k).select(key, "rank", city_key, "distance_km")

    def centroids(self) -> DataFrame:
        """iso2, lat, lon: the country's own middle (by code or by name), else the mean of its cities, else 0, 0."""
        by_code = self.places.select(F.upper("cca2").alias("_c"), F.col("lat").alias("_la"), F.col("lon").alias("_lo"))
        by_name = self.places.select(F.lower("name").alias("_n"), F.col("lat").alias("_ma"), F.col("lon").alias("_mo"))
        mean = self.cities.groupBy(F.upper("country_code").alias("_k")).agg(F.avg("lat").alias("_ca"), F.avg("lon").alias("_co"))
        c = self.countries.where("iso2 <> ''").withColumn("_i", F.upper("iso2"))
        j = c.join(by_code, c["_i"] == by_code["_c"], "left").join(by_name, F.lower(c["name"]) == by_name["_n"], "left").join(mean, c["_i"] == mean["_k"], "left")
        return j.select(F.col("_i").alias("iso2"), F.coalesce("_la", "_ma", "_ca", F.lit(0.0)).alias("lat"), F.coalesce("_lo", "_mo", "_co", F.lit(0.0)).alias("lon")).dropDuplicates(["iso2"])

    def country_of(self, points: DataFrame, key: str) -> DataFrame:
        """key, iso2, distance_km, method: the nearest middle among countries whose cities' box holds the point, else among all; ties (to the micrometre) by code."""
        box = self.cities.where("country_code <> ''").groupBy(F.upper("country_code").alias("iso2")).agg(F.min("lat").alias("_a"), F.max("lat").alias("_b"), F.min("lon").alias("_c"), F.max("lon").alias("_d"))
        # one row a country: a fixed size, whatever the data; all of them meet a point in its row, so nothing is multiplied
        c = self.centroids().select("iso2", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).join(box, "iso2", "left").agg(F.collect_list(F.struct("iso2", "_lat", "_lon", "_a", "_b", "_c", "_d")).alias("_all"))

        def seen(x: Column) -> Column:
            inside = F.coalesce(F.col("lat").between(x["_a"], x["_b"]) & F.col("lon").between(x["_c"], x["_d"]), F.lit(False))
            return F.struct((~inside).alias("out"), F.round(haversine_km("lat", "lon", x["_lat"], x["_lon"]), 9).alias("km"), x["iso2"].alias("iso2"))

        d = points.select(key, "lat", "lon").repartition(F.col(key)).crossJoin(F.broadcast(c)).select(key, F.array_min(F.transform("_all", seen)).alias("_s"))
        best = d.where("_s is not null").groupBy(key).agg(F.min("_s").alias("s"))
        return best.select(key, "s.iso2", F.col("s.km").alias("distance_km"), F.when(F.col("s.out"), "nearest_centroid").otherwise("bbox_then_nearest_centroid").alias("method"))

    def search_place(self, query: str, k: int = 5) -> DataFrame:
        """type, name, country_code, state_code, confidence of the k most similar places, at least .55."""
        q = norm(F.lit(query))
        place = lambda df, kind, name, code, state, score: df.select(F.lit(kind).alias("type"), F.col(name).alias("name"), F.col(code).alias("country_code"), state.alias("state_code"), score.alias("confidence"))
        found = place(self.countries, "COUNTRY", "name", "iso2", F.lit(""), F.greatest(similarity(q, norm("name")), similarity(q, norm("iso2"))))
        found = found.unionByName(place(self.states, "STATE", "name", "iso2", F.col("state_code"), similarity(q, norm("name"))))
        found = found.unionByName(place(self.cities, "CITY", "name", "country_code", F.col("state_code"), similarity(q, norm("name"))))
        return found.where("confidence >= 0.55").orderBy(F.desc("confidence"), "type", "name", "country_code").limit(max(1, k))

    def gazetteer(self, max_cities: int | None = 10_000) -> DataFrame:
        """name, label: states over countries over cities. At most ``max_cities`` cities, by name, as the feature demands; None for all."""
        names = [self.states.select(F.lower("name").alias("name"), F.lit("STATE").alias("label"), F.lit(0).alias("p")), self.countries.select(F.lower("name").alias("name"), F.lit("COUNTRY").alias("label"), F.lit(1).alias("p"))]
        c = self.cities.select(F.lower("name").alias("name")).distinct()
        c = c if max_cities is None else c.orderBy("name").limit(max_cities)
        names.append(c.select("name", F.lit("CITY").alias("label"), F.lit(2).alias("p")))
        return names[0].unionByName(names[1]).unionByName(names[2]).where("name <> ''").groupBy("name").agg(F.min_by("label", "p").alias("label"))

    def city_name_index(self) -> DataFrame:
        return self.cities.groupBy(norm("name").alias("name")).agg(F.array_sort(F.collect_set(F.struct("country_code", "state_code", "lat", "lon"))).alias("cities"))

    def country_phone_index(self) -> DataFrame:
        """code, iso2; the last by iso2 wins."""
        code = F.regexp_replace("phone_code", r"\D+", "")
        return self.countries.select(code.alias("code"), "iso2").where("code <> ''").groupBy("code").agg(F.max("iso2").alias("iso2"))


def suggest(names: DataFrame, prefix: str, limit: int = 20, column: str = "name") -> DataFrame:
    """Names that begin with the prefix, in order."""
    return names.where(F.startswith(F.lower(column), F.lit(prefix.lower()))).select(column).distinct().orderBy(column).limit(limit)


def contains(names: DataFrame, name: Column | str, column: str = "name") -> DataFrame:
    """One row, ``found``: whether a name is there, whatever the case."""
    sought = F.lower(F.lit(name) if isinstance(name, str) else name)
    return names.agg(F.coalesce(F.bool_or(F.lower(column) == sought), F.lit(False)).alias("found"))


def code_number(code: Column | str) -> Column:
    c = F.upper(F.trim(F.col(code) if isinstance(code, str) else code))
    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(0), lambda s, x: s + F.ascii(x)) / 200.0


def geo_features(geo: Geo, points: DataFrame, key: str) -> DataFrame:
    """key, features: lat, lon, kilometres to the nearest city, the country code as a number."""
    near = geo.nearest_cities(points, key, 1).select(key, "distance_km")
    of = geo.country_of(points, key).select(key, "iso2")
    j = points.join(near, key, "left").join(of, key, "left")
    return j.select(key, F.array(F.col("lat").cast("double"), F.col("lon").cast("double"), F.coalesce("distance_km", F.lit(0.0)), F.coalesce(code_number("iso2"), F.lit(0.0))).alias("features"))
