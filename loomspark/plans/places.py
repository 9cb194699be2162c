"""Queries: geography from supplier, customer and nation keys, and images from embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geo as G
from ..operators import vision as V
from .tabular import r6, read


def _lat(key: str):
    return ((F.col(key) * 37) % 1400) / 10 - 70


def _lon(key: str):
    return ((F.col(key) * 91) % 3600) / 10 - 180


def _geo(spark, sf) -> G.Geo:
    n, s = read(spark, sf, "nation"), read(spark, sf, "supplier")
    key = F.col("n_nationkey")
    code = F.concat(F.lit("N"), F.chr(key + 65))
    countries = n.select(F.col("n_name").alias("name"), code.alias("iso2"), F.concat(code, F.lit("X")).alias("iso3"), F.concat(F.lit("+"), (key + 200).cast("string")).alias("phone_code"))
    states = n.join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat("n_name", F.lit(" "), "r_name").alias("name"), F.col("r_regionkey").cast("string").alias("state_code"), code.alias("iso2"))
    places = n.where("n_nationkey % 3 = 0").select(code.alias("cca2"), F.col("n_name").alias("name"), _lat("n_nationkey").alias("lat"), _lon("n_nationkey").alias("lon"))
    cities = s.select(F.col("s_suppkey").alias("city_id"), F.col("s_name").alias("name"), F.concat(F.lit("N"), F.chr(F.col("s_nationkey") + 65)).alias("country_code"), F.lit("0").alias("state_code"), _lat("s_suppkey").alias("lat"), _lon("s_suppkey").alias("lon"))
    return G.Geo(countries, states, places, cities)


def _points(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", (_lat("c_custkey") + 0.013).alias("lat"), (_lon("c_custkey") * 0.97 + 0.07).alias("lon"))


def geo_nearest(spark, sf):
    return _geo(spark, sf).nearest_cities(_points(spark, sf), "c_custkey", 3).select("c_custkey", "rank", "city_id", r6("distance_km").alias("km"))


def geo_nearest_in_country(spark, sf):
    return _geo(spark, sf).nearest_cities(_points(spark, sf), "c_custkey", 2, within_km=9000.0, country="nb").select("c_custkey", "rank", "city_id", r6("distance_km").alias("km"))


def geo_country(spark, sf):
    return _geo(spark, sf).country_of(_points(spark, sf), "c_custkey").select("c_custkey", "iso2", r6("distance_km").alias("km"), "method")


def geo_centroids(spark, sf):
    return _geo(spark, sf).centroids().select("iso2", r6("lat").alias("lat"), r6("lon").alias("lon"))


def geo_features(spark, sf):
    f = G.geo_features(_geo(spark, sf), _points(spark, sf), "c_custkey")
    return f.select("c_custkey", *[r6(F.col("features")[i]).alias(n) for i, n in enumerate(("lat", "lon", "km", "code"))])


def geo_search(spark, sf):
    return _geo(spark, sf).search_place("Supplier 00000001", 10).select("type", "name", "country_code", r6("confidence").alias("confidence"))


def geo_gazetteer(spark, sf):
    return _geo(spark, sf).gazetteer(None)


def geo_suggest(spark, sf):
    return G.suggest(_geo(spark, sf).cities, "supplier#00000000", 20)


def geo_phone_index(spark, sf):
    return _geo(spark, sf).country_phone_index()


def _pixels(spark, sf):
    """Each embedding as 21 pixels."""
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1500)).alias("v"))
    p = e.select("image_id", "v", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("pos"))
    return p.select("image_id", "pos", *[F.get("v", F.col("pos") * 3 + i).cast("double").alias(c) for i, c in enumerate("rgb")])


def skin_ratio(spark, sf):
    return V.skin_ratio(_pixels(spark, sf)).select("image_id", r6("skin_ratio").alias("ratio"), "risk", "n")


_SIGNALS = ("mean_r", "mean_g", "mean_b", "luma_std", "saturation", "clipping", "diversity", "flatness")


def forensics(spark, sf):
    return V.forensics(_pixels(spark, sf)).select("image_id", "n", *[r6(c).alias(c) for c in _SIGNALS])


def authenticity(spark, sf):
    d = V.forensics(_pixels(spark, sf)).withColumn("has_camera", F.col("image_id") % 2 == 0).withColumn("filename_hint", (F.col("image_id") % 6) / 5).withColumn("generator_hint", (F.col("image_id") % 5) / 4)
    return V.authenticity(d).select("image_id", r6("score").alias("score"), "risk", r6("confidence").alias("confidence"))


def palette_share(spark, sf):
    return V.palette(_pixels(spark, sf)).select("image_id", "rank", "hex", r6("share").alias("share"))


def image_sample(spark, sf):
    """Matrices back to pixels, at most ten of each image."""
    rows = _pixels(spark, sf).groupBy("image_id").agg(F.array(F.transform(F.array_sort(F.collect_list(F.struct("pos", "r", "g", "b"))), lambda x: F.array(x["r"], x["g"], x["b"]))).alias("matrix"))
    return V.from_matrix(rows, most=10).select("image_id", "pos", "r", "g", "b")


QUERIES = {f.__name__: f for f in (geo_nearest, geo_nearest_in_country, geo_country, geo_centroids, geo_features, geo_search, geo_gazetteer, geo_suggest, geo_phone_index, skin_ratio, forensics, authenticity, palette_share, image_sample)}

_GEO = """cities as (select s_suppkey as city_id, s_name as name, 'N' || chr(s_nationkey + 65) as country_code, ((s_suppkey * 37) % 1400) / 10.0::double - 70 as lat, ((s_suppkey * 91) % 3600) / 10.0::double - 180 as lon from supplier),
    places as (select 'N' || chr(n_nationkey + 65) iso2, ((n_nationkey * 37) % 1400) / 10.0::double - 70 as lat, ((n_nationkey * 91) % 3600) / 10.0::double - 180 as lon from nation where n_nationkey % 3 = 0),
    mean as (select country_code iso2, avg(lat) lat, avg(lon) lon from cities group by 1),
    cent as (select 'N' || chr(n_nationkey + 65) as iso2, coalesce(p.lat, m.lat, 0) lat, coalesce(p.lon, m.lon, 0) lon from nation left join places p on p.iso2 = 'N' || chr(n_nationkey + 65) left join mean m on m.iso2 = 'N' || chr(n_nationkey + 65)),
    pts as (select c_custkey, ((c_custkey * 37) % 1400) / 10.0::double - 70 + 0.013::double as lat, (((c_custkey * 91) % 3600) / 10.0::double - 180) * 0.97::double + 0.07::double as lon from customer)"""


def _km(a: str, b: str) -> str:
    return f"2 * 6371.0::double * asin(least(1.0::double, sqrt(sin(radians({b}.lat - {a}.lat) / 2) ** 2 + cos(radians({a}.lat)) * cos(radians({b}.lat)) * sin(radians({b}.lon - {a}.lon) / 2) ** 2)))"


_NEAR = f"""nc as (select c_custkey, city_id, {_km('p', 'c')} km, sqrt((p.lat - c.lat) ** 2 + (p.lon - c.lon) ** 2) deg from pts p, cities c),
    nr as (select *, row_number() over (partition by c_custkey order by deg, city_id) as rank from nc)"""
_OF = f"""box as (select country_code iso2, min(lat) a, max(lat) b, min(lon) c, max(lon) d from cities group by 1),
    cand as (select c_custkey, e.iso2, {_km('p', 'e')} km, coalesce(p.lat between a and b and p.lon between c and d, false) inside from pts p cross join cent e left join box on box.iso2 = e.iso2),
    best as (select * from cand qualify row_number() over (partition by c_custkey order by inside desc, round(km, 9), iso2) = 1)"""
_PX = """px as (select vec_id as image_id, pos, floor(abs(embedding[pos * 3 + 1]::double) * 1500)::double r0, floor(abs(embedding[pos * 3 + 2]::double) * 1500)::double g0, floor(abs(embedding[pos * 3 + 3]::double) * 1500)::double b0 from embeddings, range(21) t(pos)),
    pc as (select image_id, pos, least(255.0::double, r0) r, least(255.0::double, g0) g, least(255.0::double, b0) b from px)"""
_FOR = f"""{_PX}, fr as (select image_id, count(*) as n, avg(r) mean_r, avg(g) mean_g, avg(b) mean_b, stddev_pop(0.2126::double * r + 0.7152::double * g + 0.0722::double * b) luma_std, avg(case when greatest(r, g, b) <= 0 then 0 else (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) end) saturation,
    avg((r <= 3 or r >= 252)::int + (g <= 3 or g >= 252)::int + (b <= 3 or b >= 252)::int) / 3 clipping, count(distinct floor(r / 16) * 256 + floor(g / 16) * 16 + floor(b / 16)) / count(*)::double diversity from pc group by image_id), fo as (select *, 1 - least(1.0::double, luma_std / 64) flatness from fr)"""

ORACLE_SQL = {
    "geo_nearest": f"with {_GEO}, {_NEAR} select c_custkey, cast(rank as int) as rank, city_id, round(km, 6) as km from nr where rank <= 3",
    "geo_nearest_in_country": f"with {_GEO}, {_NEAR.split(', nr as')[0].rstrip().rstrip(',')} select c_custkey, cast(row_number() over (partition by c_custkey order by km, city_id) as int) as rank, city_id, round(km, 6) as km from nc join cities using (city_id) where country_code = 'NB' and km <= 9000 qualify row_number() over (partition by c_custkey order by km, city_id) <= 2",
    "geo_country": f"with {_GEO}, {_OF} select c_custkey, iso2, round(round(km, 9), 6) as km, case when inside then 'bbox_then_nearest_centroid' else 'nearest_centroid' end as method from best",
    "geo_centroids": f"with {_GEO} select iso2, round(lat, 6) as lat, round(lon, 6) as lon from cent",
    "geo_features": f"with {_GEO}, {_NEAR}, {_OF} select p.c_custkey, round(p.lat, 6) as lat, round(p.lon, 6) as lon, round(nr.km, 6) as km, round((ascii(iso2[1]) + ascii(iso2[2])) / 200.0::double, 6) as code from pts p join nr on nr.c_custkey = p.c_custkey and rank = 1 join best b on b.c_custkey = p.c_custkey",
    "geo_search": r"""with t as (select 'COUNTRY' as type, n_name as name, 'N' || chr(n_nationkey + 65) as country_code, lower('N' || chr(n_nationkey + 65)) as other from nation union all select 'STATE', n_name || ' ' || r_name, 'N' || chr(n_nationkey + 65), '' from nation join region on n_regionkey = r_regionkey
        union all select 'CITY', s_name, 'N' || chr(s_nationkey + 65), '' from supplier), q as (select 'supplier 00000001' q), n as (select *, trim(regexp_replace(regexp_replace(lower(name), '[^\p{L}\p{N}\s]+', ' ', 'g'), '\s+', ' ', 'g')) a from t, q),
        s as (select type, name, country_code, greatest(case when a = q then 1.0::double when contains(a, q) or contains(q, a) then 0.92::double else greatest(0, 1 - levenshtein(a, q) / greatest(length(a), length(q))::double) end, case when other = '' then 0 when contains(q, other) then 0.92::double else 1 - levenshtein(other, q) / greatest(length(other), length(q))::double end) c from n)
        select type, name, country_code, round(c, 6) as confidence from s where c >= 0.55 order by c desc, type, name, country_code limit 10""",
    "geo_gazetteer": "select name, case min(p) when 0 then 'STATE' when 1 then 'COUNTRY' else 'CITY' end as label from (select lower(n_name || ' ' || r_name) as name, 0 p from nation join region on n_regionkey = r_regionkey union all select lower(n_name), 1 from nation union all select lower(s_name), 2 from supplier) group by name",
    "geo_suggest": "select distinct s_name as name from supplier where starts_with(lower(s_name), 'supplier#00000000') order by name limit 20",
    "geo_phone_index": "select cast(n_nationkey + 200 as varchar) as code, 'N' || chr(n_nationkey + 65) as iso2 from nation",
    "skin_ratio": f"""with {_PX}, s as (select image_id, avg(((r0 > 95 and g0 > 40 and b0 > 20 and greatest(r0, g0, b0) - least(r0, g0, b0) > 15 and abs(r0 - g0) > 15 and r0 > g0 and r0 > b0)
        or (128.0::double - 0.168736::double * r0 - 0.331264::double * g0 + 0.5::double * b0 between 77 and 127 and 128.0::double + 0.5::double * r0 - 0.418688::double * g0 - 0.081312::double * b0 between 133 and 173))::int) x, count(*) n from px group by image_id)
        select image_id, round(x, 6) as ratio, case when x >= 0.55 then 'high' when x >= 0.30 then 'medium' else 'low' end as risk, n from s""",
    "forensics": f"with {_FOR} select image_id, n, {', '.join(f'round({c}, 6) as {c}' for c in _SIGNALS)} from fo",
    "authenticity": f"""with {_FOR}, s as (select image_id, round(0.45::double * ((image_id % 5) / 4.0::double) + 0.2::double * ((image_id % 6) / 5.0::double) + case when image_id % 2 = 0 then 0 else 0.12::double end + case when flatness > 0.58 then 0.12::double else 0 end + case when diversity < 0.08 then 0.1::double else 0 end + case when clipping > 0.35 then 0.1::double else 0 end, 12) sc from fo)
        select image_id, round(sc, 6) as score, case when sc >= 0.72 then 'high' when sc >= 0.45 then 'medium' else 'low' end as risk, round(0.45 + 0.5 * least(1, abs(sc - 0.5) * 2), 6) as confidence from s""",
    "image_sample": f"with {_PX} select image_id, cast(pos as int) as pos, r, g, b from pc where pos % 3 = 0",
}
