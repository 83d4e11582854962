"""Geography, k-means labels and marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridegauge.catalog.base import query, rounded
from ridegauge.catalog.cleaning import CLEAN, CLEAN_STATIONS, flat, stations, trips
from ridegauge.functions import points as pt
from ridegauge.operators import geo, kmeans as km, marts
from ridegauge.plans.bindings import PLACES, SPOTS, bind, table
from ridegauge.session import cut_lineage

ATTR_DOC = (
    "'{\"type\":\"FeatureCollection\",\"features\":[' || string_agg('{\"attributes\":{\"Name\":\"' || s_name || ' Metro Station\",\"city\":\"C' || "
    "CAST(s_nationkey AS VARCHAR) || '\",\"latitude\":' || CAST(s_suppkey AS VARCHAR) || '.5,\"longitude\":-118.25}}', ',' ORDER BY s_suppkey) || ']}'"
)


def attribute_documents(spark, sf):
    item = F.to_json(
        F.struct(
            F.struct(
                F.concat("s_name", F.lit(" Metro Station")).alias("Name"),
                F.concat(F.lit("C"), F.col("s_nationkey").cast("string")).alias("city"),
                F.concat(F.col("s_suppkey").cast("string"), F.lit(".5")).alias("latitude"),
                F.lit(-118.25).alias("longitude"),
            ).alias("attributes")
        )
    )
    docs = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(item), ",").alias("items"))
    return docs.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "items", F.lit("]}")).alias("document"))


def geometry_documents(spark, sf):
    item = F.to_json(
        F.struct(
            F.struct(F.concat("s_name", F.lit(", CA")).alias("Name"), F.lit("LA").alias("city")).alias("properties"),
            F.struct(
                F.array(F.lit(-118.5), F.col("s_suppkey").cast("double") + 0.25).alias("coordinates")
            ).alias("geometry"),
        )
    )
    docs = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(item), ",").alias("items"))
    return docs.select(F.concat(F.lit('{"features":['), "items", F.lit("]}")).alias("document"))


@query(
    "d01_feature_attributes",
    """SELECT s_name || ' Metro Station' AS station_name, 'C' || CAST(s_nationkey AS VARCHAR) AS city, CAST(NULL AS VARCHAR) AS state,
    CAST(s_suppkey + 0.5 AS DOUBLE) AS latitude, CAST(-118.25 AS DOUBLE) AS longitude FROM supplier""",
)
def _(spark, sf):
    return geo.explode_features(attribute_documents(spark, sf), "attributes")


@query(
    "d02_feature_geometry",
    """SELECT s_name || ', CA' AS station_name, 'LA' AS city, CAST(NULL AS VARCHAR) AS state, CAST(s_suppkey AS DOUBLE) + 0.25 AS latitude,
    CAST(-118.5 AS DOUBLE) AS longitude FROM supplier""",
)
def _(spark, sf):
    return geo.explode_features(geometry_documents(spark, sf), "geometry")


@query(
    "d03_nearest_join",
    f"""WITH l AS ({SPOTS}), r AS ({PLACES}), d AS (SELECT spot, l.latitude, l.longitude, zip_code,
      row_number() OVER (PARTITION BY spot ORDER BY sqrt((l.latitude - r.latitude) * (l.latitude - r.latitude)
        + (l.longitude - r.longitude) * (l.longitude - r.longitude)), zip_code) AS rn FROM l CROSS JOIN r)
    SELECT spot, round(latitude, 6) AS latitude, longitude, zip_code FROM d WHERE rn = 1""",
)
def _(spark, sf):
    return rounded(geo.nearest_join(bind(spark, sf, SPOTS), bind(spark, sf, PLACES), "spot", "zip_code"))


LOCATIONS = f"""{CLEAN}, loc AS (SELECT start_station AS station_id, start_lat AS latitude, start_lon AS longitude FROM clean
   QUALIFY row_number() OVER (PARTITION BY start_station ORDER BY trip_id) = 1
   UNION SELECT end_station, end_lat, end_lon FROM clean QUALIFY row_number() OVER (PARTITION BY end_station ORDER BY trip_id) = 1)"""


@query("d04_station_locations", f"WITH {LOCATIONS} SELECT * FROM loc")
def _(spark, sf):
    return flat(geo.station_locations(trips(spark, sf)))


@query(
    "d05_transit_stations",
    """SELECT s_name || ' ' AS station_name, 'C' || CAST(s_nationkey AS VARCHAR) AS city, 'California' AS state, CAST(s_suppkey + 0.5 AS DOUBLE) AS latitude,
      CAST(-118.25 AS DOUBLE) AS longitude, 'metro_station' AS station_type FROM supplier
    UNION ALL SELECT s_name, 'LA', 'California', CAST(s_suppkey AS DOUBLE) + 0.25, -118.5, 'amtrak_station' FROM supplier""",
)
def _(spark, sf):
    metro = geo.explode_features(attribute_documents(spark, sf), "attributes")
    rail = geo.explode_features(geometry_documents(spark, sf), "geometry")
    return geo.transit_stations(
        geo.transit_rows(metro, "metro_station", "California"),
        geo.transit_rows(rail, "amtrak_station", "California", trim="first_part"),
    )


ZIPPED = f"""{LOCATIONS}, zip AS (SELECT zip_code, CAST(34 AS DOUBLE) + latitude / 1000 AS latitude, CAST(-118 AS DOUBLE) - longitude / 1000 AS longitude FROM ({PLACES}) p),
  near AS (SELECT station_id, loc.latitude, loc.longitude, zip_code, row_number() OVER (PARTITION BY station_id, loc.latitude, loc.longitude
    ORDER BY sqrt((loc.latitude - zip.latitude) * (loc.latitude - zip.latitude) + (loc.longitude - zip.longitude) * (loc.longitude - zip.longitude)), zip_code) AS rn
    FROM loc CROSS JOIN zip)"""


def zipped_stations(spark, sf):
    loc = geo.station_locations(trips(spark, sf))
    loc = flat(loc).withColumn("place", F.struct("station_id", "latitude", "longitude"))
    zips = bind(spark, sf, PLACES).select(
        "zip_code", (F.lit(34.0) + F.col("latitude") / 1000).alias("latitude"), (F.lit(-118.0) - F.col("longitude") / 1000).alias("longitude")
    )
    return geo.nearest_join(loc, zips, "place", "zip_code").drop("place")


@query("d06_zip_counts", f"WITH {ZIPPED} SELECT zip_code, count(*) AS stations FROM near WHERE rn = 1 GROUP BY 1")
def _(spark, sf):
    return geo.zip_counts(zipped_stations(spark, sf))


@query("d07_population_view", "SELECT n_nationkey, n_name, 'California' AS state, 'Los Angeles' AS county FROM nation")
def _(spark, sf):
    return geo.population_view(table(spark, sf, "nation").select("n_nationkey", "n_name"), "California", "Los Angeles")


@query(
    "d08_station_density",
    """SELECT o_orderkey AS station_id, o_custkey AS zip_code, c_nationkey * 1000 AS total_population, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS land_area,
      round(CASE WHEN c_acctbal > 0 THEN c_nationkey * 1000 / c_acctbal END, 6) AS population_density
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def _(spark, sf):
    placed = table(spark, sf, "orders").select(F.col("o_orderkey").alias("station_id"), F.col("o_custkey").alias("zip_code"))
    customer = table(spark, sf, "customer")
    census = customer.select(F.col("c_custkey").alias("zip_code"), (F.col("c_nationkey") * 1000).alias("total_population"))
    land = customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("zip_code"), F.col("c_acctbal").alias("land_area"))
    return rounded(geo.station_density(placed, census, land))


@query(
    "d09_point_math",
    """SELECT vec_id, embedding[1] = embedding[2] AND embedding[2] = embedding[1] AS swapped_equal,
    round(sqrt((embedding[1]::DOUBLE - embedding[3]::DOUBLE) ** 2 + (embedding[2]::DOUBLE - embedding[4]::DOUBLE) ** 2), 6) AS distance FROM embeddings""",
)
def _(spark, sf):
    e = F.col("embedding")
    p, q, swapped = pt.point(e[0], e[1]), pt.point(e[2], e[3]), pt.point(e[1], e[0])
    return rounded(
        table(spark, sf, "embeddings").select(
            "vec_id", pt.point_eq(p, swapped).alias("swapped_equal"), pt.dist(p, q).alias("distance")
        )
    )


@query(
    "d10_avg_point",
    """SELECT label, round(avg(embedding[1]::DOUBLE), 6) AS x, round(avg(embedding[2]::DOUBLE), 6) AS y FROM embeddings GROUP BY label""",
)
def _(spark, sf):
    e = F.col("embedding")
    means = table(spark, sf, "embeddings").groupBy("label").agg(pt.avg_point(pt.point(e[0], e[1])).alias("m"))
    return rounded(means.select("label", F.col("m.x").alias("x"), F.col("m.y").alias("y")))


# ---- k-means -------------------------------------------------------------------------------------------------------

DPOINTS = f"{CLEAN}, pts AS (SELECT duration_minutes AS label, CAST(duration_minutes AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS y FROM clean GROUP BY 1)"
SPOINTS = f"{CLEAN}, pts AS (SELECT start_station AS label, CAST(count(*) AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y FROM clean GROUP BY 1)"
DURATION_SEEDS = [4, 33, 57, 98]
STATION_SEEDS = [2, 15, 40, 77]
DURATION_ROUNDS, STATION_ROUNDS, ELBOW_ROUNDS = 10, 15, 10


def unrolled(points: str, seeds: list[int], iterations: int, p: str = "", where: str = "") -> str:
    """K-means as a chain of CTEs: a{n} is the assignment of round n, m{n} the centres after it; ``p`` prefixes their names."""
    chosen = where or f"id IN ({', '.join(map(str, seeds))})"
    parts = [points, "ids AS (SELECT *, row_number() OVER (ORDER BY label) AS id FROM pts)"] if points else []
    parts.append(f"{p}m0 AS (SELECT row_number() OVER (ORDER BY id) AS cluster, x AS mx, y AS my FROM ids WHERE {chosen})")
    for i in range(1, iterations + 1):
        parts.append(
            f"{p}a{i} AS (SELECT label, x, y, cluster FROM pts CROSS JOIN {p}m{i - 1} QUALIFY row_number() OVER (PARTITION BY label "
            f"ORDER BY sqrt((x - mx) * (x - mx) + (y - my) * (y - my)), cluster) = 1)"
        )
        parts.append(f"{p}m{i} AS (SELECT cluster, avg(x) AS mx, avg(y) AS my FROM {p}a{i} GROUP BY 1)")
    n = iterations
    parts.append(f"{p}km AS (SELECT label, x, y, cluster, mx AS mean_x, my AS mean_y FROM {p}a{n} JOIN {p}m{n} USING (cluster))")
    parts.append(
        f"{p}cls AS (SELECT cluster, mean_x, mean_y, dense_rank() OVER (ORDER BY mean_x DESC, mean_y DESC) AS class "
        f"FROM (SELECT DISTINCT cluster, mean_x, mean_y FROM {p}km) c)"
    )
    return ", ".join(parts)


def duration_pts(spark, sf):
    return km.duration_points(trips(spark, sf))


def duration_km(spark, sf, iterations=DURATION_ROUNDS):
    pts = cut_lineage(duration_pts(spark, sf))
    return pts, km.kmeans(pts, DURATION_SEEDS, iterations)


@query("e01_duration_points", f"WITH {DPOINTS} SELECT * FROM pts")
def _(spark, sf):
    return duration_pts(spark, sf)


@query("e02_station_points", f"WITH {SPOINTS} SELECT * FROM pts")
def _(spark, sf):
    return km.station_points(trips(spark, sf))


@query(
    "e03_e04_first_assignment",
    f"WITH {unrolled(DPOINTS, DURATION_SEEDS, 1)} SELECT label, x, y, cluster FROM a1",
)
def _(spark, sf):
    pts = duration_pts(spark, sf)
    return km.assign(pts, km.seed_centers(pts, DURATION_SEEDS))


@query(
    "e05_update",
    f"WITH {unrolled(DPOINTS, DURATION_SEEDS, 1)} SELECT cluster, round(mx, 6) AS mean_x, round(my, 6) AS mean_y FROM m1",
)
def _(spark, sf):
    pts = duration_pts(spark, sf)
    return rounded(km.update(km.assign(pts, km.seed_centers(pts, DURATION_SEEDS))))


@query(
    "e06_kmeans_durations",
    f"WITH {unrolled(DPOINTS, DURATION_SEEDS, DURATION_ROUNDS)} SELECT label, x, y, cluster, round(mean_x, 6) AS mean_x, round(mean_y, 6) AS mean_y FROM km",
)
def _(spark, sf):
    return rounded(duration_km(spark, sf)[1])


@query(
    "e06_kmeans_stations",
    f"WITH {unrolled(SPOINTS, STATION_SEEDS, STATION_ROUNDS)} SELECT label, x, y, cluster, round(mean_x, 6) AS mean_x, round(mean_y, 6) AS mean_y FROM km",
)
def _(spark, sf):
    return rounded(km.kmeans(km.station_points(trips(spark, sf)), STATION_SEEDS, STATION_ROUNDS))


@query(
    "e07_kmeans_delta",
    f"WITH {unrolled(DPOINTS, DURATION_SEEDS, DURATION_ROUNDS)} SELECT label, cluster, round(mx, 6) AS mean_x, round(my, 6) AS mean_y FROM a10 JOIN m10 USING (cluster) "
    "EXCEPT ALL SELECT label, cluster, round(mx, 6), round(my, 6) FROM a9 JOIN m9 USING (cluster)",
)
def _(spark, sf):
    return rounded(km.kmeans_delta(duration_pts(spark, sf), DURATION_SEEDS, DURATION_ROUNDS))


@query(
    "e08_rank_classes",
    f"WITH {unrolled(DPOINTS, DURATION_SEEDS, DURATION_ROUNDS)} SELECT cluster, round(mean_x, 6) AS mean_x, round(mean_y, 6) AS mean_y, class FROM cls",
)
def _(spark, sf):
    return rounded(km.rank_classes(duration_km(spark, sf)[1]))


@query(
    "e09_wcss",
    f"WITH {unrolled(DPOINTS, DURATION_SEEDS, DURATION_ROUNDS)} SELECT round(sum((x - mean_x) ** 2 + (y - mean_y) ** 2), 4) AS wcss FROM km",
)
def _(spark, sf):
    return rounded(km.wcss(duration_km(spark, sf)[1]), 4)


@query(
    "e10_with_classes",
    f"WITH {unrolled(DPOINTS, DURATION_SEEDS, DURATION_ROUNDS)} SELECT label, x, y, class, round(cls.mean_x, 6) AS mean_x, round(cls.mean_y, 6) AS mean_y FROM km JOIN cls USING (cluster)",
)
def _(spark, sf):
    pts, clustered = duration_km(spark, sf)
    return rounded(km.with_classes(pts, clustered))


ELBOW = ", ".join(
    [DPOINTS, "ids AS (SELECT *, row_number() OVER (ORDER BY label) AS id, count(*) OVER () AS n FROM pts)"]
    + [unrolled("", [], ELBOW_ROUNDS, f"k{k}_", " OR ".join(f"id = least(n, n * {2 * j + 1} // {2 * k} + 1)" for j in range(k))) for k in (2, 3, 4, 5)]
)


@query(
    "e11_elbow",
    f"WITH {ELBOW} "
    + " UNION ALL ".join(f"SELECT {k} AS k, round(sum((x - mean_x) ** 2 + (y - mean_y) ** 2), 2) AS wcss FROM k{k}_km" for k in (2, 3, 4, 5)),
)
def _(spark, sf):
    return rounded(km.elbow(duration_pts(spark, sf), iterations=ELBOW_ROUNDS), 2)


# ---- marts ---------------------------------------------------------------------------------------------------------

DURATION_CASE = "CASE class WHEN 1 THEN 'long_trip_low_frequency' WHEN 2 THEN 'long_trip_mid_frequency' WHEN 3 THEN 'short_trip_high_frequency' ELSE 'very_short_trip_very_high_frequency' END"
TRAFFIC_CASE = "CASE class WHEN 1 THEN 'high_trafic' WHEN 2 THEN 'mid_trafic' WHEN 3 THEN 'low_trafic' ELSE 'very_low_trafic' END"
DCLASS = "dclass AS (SELECT label, class, mean_x, mean_y FROM km JOIN (SELECT cluster, class FROM cls) c USING (cluster))"
# Station classes for the mart: by thirds of trip count, derived relationally.
SCLASS = "sclass AS (SELECT start_station AS label, CAST(CASE WHEN count(*) >= 140 THEN 1 WHEN count(*) >= 120 THEN 2 WHEN count(*) >= 100 THEN 3 ELSE 4 END AS INT) AS class FROM clean GROUP BY 1)"


def duration_classes(spark, sf):
    pts, clustered = duration_km(spark, sf)
    return km.with_classes(pts, clustered)


def station_classes(spark, sf):
    n = F.col("x")
    return km.station_points(trips(spark, sf)).select(
        "label", F.when(n >= 140, 1).when(n >= 120, 2).when(n >= 100, 3).otherwise(4).alias("class")
    )


def mart(spark, sf):
    return marts.trip_mart(flat(trips(spark, sf)), stations(spark, sf), duration_classes(spark, sf), station_classes(spark, sf))


MOMENT = "CAST({p}_time AS DATE) AS date_{p}, year({p}_time) AS {p}_year, quarter({p}_time) AS {p}_quarter, month({p}_time) AS {p}_month, strftime({p}_time, '%H:%M:%S') AS time_{p}"
MART = f"""{unrolled(DPOINTS, DURATION_SEEDS, DURATION_ROUNDS)}, {DCLASS}, {CLEAN_STATIONS}, {SCLASS},
 mart AS (SELECT trip_id, duration_minutes, {DURATION_CASE.replace('class', 'd.class')} AS duration_class, {MOMENT.format(p='start')}, a.region AS region_start,
   start_station, start_lat, start_lon, {MOMENT.format(p='end')}, b.region AS region_end, end_station, end_lat, end_lon, trip_route_category,
   passholder_type, bike_id, bike_type, b.go_live_date AS station_start_date, b.status, {TRAFFIC_CASE.replace('class', 's.class')} AS start_station_class
   FROM clean JOIN dclass d ON duration_minutes = d.label JOIN stations a ON start_station = a.station_id JOIN stations b ON end_station = b.station_id
   JOIN sclass s ON start_station = s.label)"""
MART = MART.replace("d.class WHEN", "d.class WHEN")


@query(
    "f01_class_means",
    f"WITH {unrolled(DPOINTS, DURATION_SEEDS, DURATION_ROUNDS)}, {DCLASS} SELECT label, class, round(mean_x) AS mean_time, round(mean_y) AS mean_frequency FROM dclass",
)
def _(spark, sf):
    return marts.class_means(duration_classes(spark, sf))


@query(
    "f02_label_duration",
    f"WITH {unrolled(DPOINTS, DURATION_SEEDS, DURATION_ROUNDS)}, {DCLASS} SELECT trip_id, duration_minutes, {DURATION_CASE} AS duration_class FROM clean JOIN dclass ON duration_minutes = label",
)
def _(spark, sf):
    return marts.label_duration(trips(spark, sf), duration_classes(spark, sf)).select(
        "trip_id", "duration_minutes", "duration_class"
    )


@query(
    "f03_start_detail",
    f"WITH {CLEAN}, {CLEAN_STATIONS} SELECT trip_id, duration_minutes, {MOMENT.format(p='start')}, region AS region_start, start_station, start_lat, start_lon FROM clean JOIN stations ON start_station = station_id",
)
def _(spark, sf):
    return flat(marts.start_detail(flat(trips(spark, sf)), stations(spark, sf)))


@query(
    "f04_end_detail",
    f"""WITH {CLEAN}, {CLEAN_STATIONS} SELECT trip_id, {MOMENT.format(p='end')}, region AS region_end, end_station, end_lat, end_lon, trip_route_category,
    passholder_type, bike_id, bike_type, go_live_date AS station_start_date, status FROM clean JOIN stations ON end_station = station_id""",
)
def _(spark, sf):
    return flat(marts.end_detail(trips(spark, sf), stations(spark, sf)))


@query(
    "f05_trip_detail",
    f"""WITH {CLEAN}, {CLEAN_STATIONS}, s AS (SELECT trip_id, duration_minutes, {MOMENT.format(p='start')}, region AS region_start, start_station, start_lat, start_lon FROM clean JOIN stations ON start_station = station_id),
    e AS (SELECT trip_id, {MOMENT.format(p='end')}, region AS region_end, end_station, end_lat, end_lon, trip_route_category,
    passholder_type, bike_id, bike_type, go_live_date AS station_start_date, status FROM clean JOIN stations ON end_station = station_id)
    SELECT * FROM s JOIN e USING (trip_id)""",
)
def _(spark, sf):
    # Sentinel station ids repeat in the station table, so the self-join form multiplies only those; ids are unique here.
    return flat(marts.trip_detail(flat(trips(spark, sf)), stations(spark, sf)))


@query(
    "f06_label_station",
    f"WITH {CLEAN}, {SCLASS} SELECT trip_id, start_station, {TRAFFIC_CASE} AS start_station_class FROM clean JOIN sclass ON start_station = label",
)
def _(spark, sf):
    return marts.label_station(trips(spark, sf), station_classes(spark, sf)).select(
        "trip_id", "start_station", "start_station_class"
    )


CUBE = """cube AS (SELECT start_month, duration_class, start_station_class, count(*) AS count_number, grouping(start_month) AS all_months,
 grouping(duration_class) AS all_durations, grouping(start_station_class) AS all_stations FROM mart GROUP BY CUBE (start_month, duration_class, start_station_class))"""


@query("f07_traffic_cube", f"WITH {MART}, {CUBE} SELECT * FROM cube")
def _(spark, sf):
    return marts.traffic_cube(mart(spark, sf))


@query(
    "f08_cube_slice",
    f"""WITH {MART}, {CUBE} SELECT start_month, duration_class, start_station_class, count_number FROM cube WHERE all_months = 1 AND all_durations = 0 AND all_stations = 0
    AND duration_class = 'very_short_trip_very_high_frequency'""",
)
def _(spark, sf):
    return marts.cube_slice(marts.traffic_cube(mart(spark, sf)))


@query(
    "f09_usage_cube",
    """WITH t AS (SELECT l_returnflag AS trip_route_category, l_suppkey AS bike_id, l_linestatus AS passholder_type, CAST(l_linenumber AS VARCHAR) AS bike_type, l_suppkey % 5 AS start_station FROM lineitem),
    g AS (SELECT trip_route_category, bike_id, passholder_type, bike_type, start_station, grouping(trip_route_category) AS all_trip_route_category, grouping(bike_id) AS all_bike_id,
      grouping(passholder_type) AS all_passholder_type, grouping(bike_type) AS all_bike_type, grouping(start_station) AS all_start_station, count(*) AS numbers,
      list(bike_id) AS bikes FROM t GROUP BY CUBE (trip_route_category, bike_id, passholder_type, bike_type, start_station))
    SELECT * EXCLUDE bikes, array_to_string(list_transform(list_sort(list_distinct(bikes)), lambda b: CAST(b AS VARCHAR) || 'x' || CAST(len(list_filter(bikes, lambda c: c = b)) AS VARCHAR)), ', ') AS bike_ids FROM g""",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("trip_route_category"),
        F.col("l_suppkey").alias("bike_id"),
        F.col("l_linestatus").alias("passholder_type"),
        F.col("l_linenumber").cast("string").alias("bike_type"),
        (F.col("l_suppkey") % 5).alias("start_station"),
    )
    return marts.usage_cube(rows)


@query("f10_trip_mart", f"WITH {MART} SELECT * FROM mart")
def _(spark, sf):
    return flat(mart(spark, sf))
