"""DuckDB SQL for the queries of plans.transit, with the bridge as common table expressions."""

from __future__ import annotations

from ..functions.gtfs import EARTH, FLOOR
from ..sources.bridge import CALENDAR, EXCEPTIONS, TRANSFERS
from .transit import ASKED_AT, ASKED_HORIZON, STATIONS


def _rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


WINDOW = "CASE WHEN ({0} // 3600) % 24 < 6 THEN 'overnight' WHEN ({0} // 3600) % 24 < 10 THEN 'morning_peak' WHEN ({0} // 3600) % 24 < 15 THEN 'midday' WHEN ({0} // 3600) % 24 < 19 THEN 'afternoon_peak' ELSE 'evening' END".format
METERS = f"2 * {EARTH} * asin(least(1.0::DOUBLE, sqrt(pow(sin((radians({{1}} - {{0}})) / 2), 2) + cos(radians({{0}})) * cos(radians({{1}})) * pow(sin((radians({{3}} - {{2}})) / 2), 2))))".format

VIEWS = {
    "stops": """SELECT s_suppkey AS stop_id, s_name AS stop_name, s_suppkey // 4 AS parent_station, 49 + (s_suppkey % 97) / 100.0::DOUBLE AS stop_lat, -123 - (s_suppkey % 89) / 100.0::DOUBLE AS stop_lon FROM supplier""",
    "trips": "SELECT o_orderkey AS trip_id, o_custkey % 50 AS route_id, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey % 2 END AS direction_id, o_orderpriority AS service_id FROM orders",
    "routes": """SELECT DISTINCT route_id, route_id % 4 AS route_type, CASE WHEN route_id % 5 <> 0 THEN 'R' || route_id END AS short_name, CASE WHEN route_id % 10 <> 0 THEN 'Route ' || route_id END AS long_name
        FROM trips""",
    "stop_times": """SELECT trip_id, stop_id, stop_sequence, d - 60 AS arrival_seconds, d AS departure_seconds, CASE WHEN p % 11 = 0 THEN 1 WHEN p % 13 = 0 THEN 3 ELSE 0 END AS pickup_type,
        CASE WHEN p % 17 = 0 THEN 1 WHEN p % 19 = 0 THEN 3 ELSE 0 END AS drop_off_type
        FROM (SELECT trip_id, stop_id, stop_sequence, p, ((trip_id * 97) % 26) * 3600 + stop_sequence * 420 AS d
        FROM (SELECT l_orderkey AS trip_id, l_suppkey AS stop_id, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS stop_sequence FROM lineitem WHERE l_orderkey IN (SELECT trip_id FROM trips)))""",
    "calendar": f"SELECT service_id, days, start_date::DATE AS start_date, end_date::DATE AS end_date FROM (VALUES {_rows(CALENDAR)}) AS t(service_id, days, start_date, end_date)",
    "calendar_dates": f"SELECT service_id, service_date::DATE AS service_date, exception_type FROM (VALUES {_rows(EXCEPTIONS)}) AS t(service_id, service_date, exception_type)",
    "transfers": f"""SELECT from_stop_id::BIGINT AS from_stop_id, to_stop_id::BIGINT AS to_stop_id, transfer_type, min_transfer_time
        FROM (VALUES {_rows(TRANSFERS)}) AS t(from_stop_id, to_stop_id, transfer_type, min_transfer_time)""",
    "observations": """SELECT user_id AS trip_id, event_type AS stop_id, length(event_type) AS stop_sequence, ts::DATE AS service_date,
        CASE WHEN event_id % 50 <> 0 THEN hour(ts) * 3600 + minute(ts) * 60 END AS scheduled_arrival, ts AS observed_at, floor(value * 12)::BIGINT - 240 AS delay_seconds FROM events""",
    "hops": """SELECT h.*, route_id, direction_id, service_id
        FROM (SELECT trip_id, stop_id AS from_stop_id, lead(stop_id) OVER w AS to_stop_id, departure_seconds, lead(arrival_seconds) OVER w AS arrival_seconds, stop_sequence, pickup_type, lead(drop_off_type) OVER w AS drop_off_type
        FROM stop_times WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence)) h JOIN trips USING (trip_id) WHERE to_stop_id IS NOT NULL""",
    "latest": """SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY trip_id, stop_id, stop_sequence, service_date
        ORDER BY observed_at DESC, scheduled_arrival DESC NULLS LAST, delay_seconds DESC) AS k FROM observations) WHERE k = 1""",
    "samples": f"""SELECT trip_id, service_date, route_id, direction_id, {WINDOW('scheduled_arrival')} AS time_window, quantile_cont(delay_seconds, 0.5) AS delay, count(*) AS stops, max(observed_at) AS newest
        FROM latest JOIN trips USING (trip_id) WHERE scheduled_arrival IS NOT NULL GROUP BY ALL""",
    "judged": "SELECT *, coalesce(direction_id, -1) AS direction_key, (delay BETWEEN -120 AND 300)::INT::DOUBLE AS ok FROM samples",
    "p_network": "SELECT count(*) AS n, count(DISTINCT service_date) AS dates, avg(ok) AS on_time, avg(ok) AS reliability FROM judged HAVING count(*) > 0",
    "p_route": """SELECT g.*, g.n::DOUBLE / (g.n::DOUBLE + 20::DOUBLE) * g.on_time + 20::DOUBLE / (g.n::DOUBLE + 20::DOUBLE) * p.reliability AS reliability
        FROM (SELECT route_id, count(*) AS n, count(DISTINCT service_date) AS dates, avg(ok) AS on_time FROM judged GROUP BY ALL) g, p_network p""",
    "p_direction": """SELECT g.*, g.n::DOUBLE / (g.n::DOUBLE + 20::DOUBLE) * g.on_time + 20::DOUBLE / (g.n::DOUBLE + 20::DOUBLE) * p.reliability AS reliability
        FROM (SELECT route_id, direction_key, count(*) AS n, count(DISTINCT service_date) AS dates, avg(ok) AS on_time FROM judged GROUP BY ALL) g JOIN p_route p USING (route_id)""",
    "p_exact": """SELECT g.*, g.n::DOUBLE / (g.n::DOUBLE + 20::DOUBLE) * g.on_time + 20::DOUBLE / (g.n::DOUBLE + 20::DOUBLE) * p.reliability AS reliability, g.n < 10 AS insufficient
        FROM (SELECT route_id, direction_key, time_window, count(*) AS n, count(DISTINCT service_date) AS dates, avg(ok) AS on_time, avg(delay) AS mean, avg(abs(delay)) AS mean_abs, round(stddev_samp(delay), 6) AS stddev,
        quantile_cont(delay, 0.5) AS p50, round(quantile_cont(abs(delay), 0.9), 6) AS p90_abs, avg((delay < -120)::INT::DOUBLE) AS early, avg((delay > 300)::INT::DOUBLE) AS late FROM judged
        GROUP BY ALL) g JOIN p_direction p USING (route_id, direction_key)""",
    "service_days": """SELECT service_id, service_date FROM (SELECT service_id, days, unnest(generate_series(start_date, end_date, INTERVAL 1 DAY))::DATE AS service_date FROM calendar) d
        WHERE substr(days, isodow(service_date)::INT, 1) = '1'
        AND NOT EXISTS (SELECT 1 FROM calendar_dates x WHERE x.service_id = d.service_id AND x.service_date = d.service_date AND exception_type = 2) UNION SELECT service_id, service_date FROM calendar_dates WHERE exception_type = 1""",
    "clique": """SELECT * FROM transfers UNION ALL SELECT a.stop_id, b.stop_id, 2, 120 FROM stops a JOIN stops b USING (parent_station) WHERE a.stop_id <> b.stop_id AND NOT EXISTS (SELECT 1 FROM transfers t
        WHERE t.from_stop_id = a.stop_id AND t.to_stop_id = b.stop_id)""",
    "alternatives": f"""SELECT trip_id, destination, departure, arrival, reliability, round(-ln(greatest(reliability, {FLOOR})), 9) AS cost, 0 AS transfers, route_id FROM (SELECT a.*, coalesce(e.reliability, d.reliability, r.reliability, w.reliability, 0) AS reliability

        FROM (SELECT o.trip_id, o.route_id, coalesce(o.direction_id, -1) AS direction_key, o.stop_sequence AS o_seq, x.stop_sequence AS d_seq, o.departure_seconds AS departure, x.to_stop_id AS destination, x.arrival_seconds AS arrival, {WINDOW('x.arrival_seconds')} AS time_window
        FROM hops o JOIN hops x ON o.trip_id = x.trip_id AND x.stop_sequence >= o.stop_sequence WHERE o.from_stop_id = 1) a
        LEFT JOIN p_exact e USING (route_id, direction_key, time_window) LEFT JOIN p_direction d USING (route_id, direction_key) LEFT JOIN p_route r USING (route_id) LEFT JOIN p_network w ON true)""",
}

NAME = "coalesce(short_name, long_name, route_id::VARCHAR)"
# Labels of a round: l0 are the origins with what is near on foot; each round boards from the labels of the one before.
_SEARCH = """, today AS (SELECT * FROM hops WHERE service_id IN (SELECT service_id FROM service_days WHERE service_date = DATE '2026-06-29')),
    walks AS (SELECT from_stop_id AS a, to_stop_id AS b, min(coalesce(min_transfer_time, 0))::BIGINT AS s FROM clique WHERE transfer_type <> 3 AND from_stop_id <> to_stop_id GROUP BY ALL),
    paths(a, b, s, k) AS (SELECT a, b, s, 1 FROM walks UNION SELECT p.a, w.b, p.s + w.s, p.k + 1 FROM paths p JOIN walks w ON w.a = p.b WHERE p.k < 10),
    foot AS (SELECT a, b, min(s) AS s FROM paths GROUP BY ALL),
    rules AS (SELECT from_stop_id AS stop_id, max(coalesce(min_transfer_time, 0)) AS wait, max((transfer_type = 3)::INT) AS forbidden FROM clique WHERE from_stop_id = to_stop_id GROUP BY ALL),
    starts AS (SELECT * FROM (VALUES (1, 1::BIGINT, 28800::BIGINT), (2, 2, 28800), (3, 1, 50400)) AS t(query_id, stop_id, until)),
    s0 AS (SELECT query_id, stop_id, until AS arrival, until AS ready FROM starts UNION ALL SELECT query_id, b, until + s, until + s FROM starts JOIN foot ON a = stop_id),
    l0 AS (SELECT query_id, stop_id, min(arrival) AS arrival, min(ready) AS ready FROM s0 GROUP BY ALL)"""
_ROUND = """,
    b{k} AS (SELECT query_id, trip_id, min(stop_sequence) AS s FROM l{p} JOIN (SELECT query_id, until FROM starts) USING (query_id)
        JOIN today h ON h.from_stop_id = l{p}.stop_id AND h.departure_seconds >= ready AND h.departure_seconds <= until + 10800 AND pickup_type <> 1 AND drop_off_type <> 1 GROUP BY ALL),
    r{k} AS (SELECT query_id, to_stop_id AS stop_id, min(arrival_seconds) AS arrival FROM b{k} JOIN today USING (trip_id) WHERE stop_sequence >= s GROUP BY ALL),
    t{k} AS (SELECT query_id, stop_id, arrival, CASE WHEN coalesce(forbidden, 0) = 0 THEN arrival + coalesce(wait, 0) END AS ready FROM r{k} LEFT JOIN rules USING (stop_id)
        UNION ALL SELECT query_id, b, arrival + s, arrival + s FROM r{k} JOIN foot ON a = stop_id),
    l{k} AS (SELECT query_id, stop_id, min(arrival) AS arrival, min(ready) AS ready FROM t{k} GROUP BY ALL)"""
_ROUNDS = _SEARCH + "".join(_ROUND.format(k=k, p=k - 1) for k in (1, 2)) + ", every AS (" + " UNION ALL ".join(f"SELECT query_id, stop_id, {k} AS boardings, arrival FROM l{k}" for k in range(3)) + ")"

# Hops of the date with what a leg that ends there costs.
_COSTED = f""", costed AS (SELECT h.*, -ln(greatest(coalesce(e.reliability, d.reliability, r.reliability, w.reliability, 0), {FLOOR})) AS leg_cost
        FROM (SELECT *, coalesce(direction_id, -1) AS direction_key, {WINDOW('arrival_seconds')} AS time_window FROM today) h LEFT JOIN p_exact e USING (route_id, direction_key, time_window)
        LEFT JOIN p_direction d USING (route_id, direction_key) LEFT JOIN p_route r USING (route_id) LEFT JOIN p_network w ON true)"""
_JOURNEYS = f"""{_SEARCH}{_COSTED},
    asks AS (SELECT a.stop_id * 1000 + b.stop_id AS query_id, a.stop_id AS origin, b.stop_id AS destination FROM stops a JOIN stops b ON b.parent_station = a.parent_station + 1 WHERE a.parent_station IN {STATIONS}),
    e0 AS (SELECT query_id, destination, origin AS stop_id, {ASKED_AT}::BIGINT AS arrival, 0::DOUBLE AS cost, NULL::BIGINT AS trip FROM asks
        UNION ALL SELECT query_id, destination, b, {ASKED_AT} + s, 0, NULL FROM asks JOIN foot ON a = origin WHERE s <= {ASKED_HORIZON}),
    """ + ",".join(f"""j{k} AS MATERIALIZED (SELECT query_id, destination, x.to_stop_id AS stop_id, x.arrival_seconds AS arrival, l.cost + x.leg_cost AS cost, x.trip_id AS trip
        FROM {f'e{k - 1}'} l LEFT JOIN rules USING (stop_id) JOIN today h ON h.from_stop_id = l.stop_id AND h.departure_seconds >= l.arrival + coalesce(wait, 0) JOIN costed x ON x.trip_id = h.trip_id AND x.stop_sequence >= h.stop_sequence
        WHERE coalesce(forbidden, 0) = 0 AND h.departure_seconds <= {ASKED_AT + ASKED_HORIZON} AND h.pickup_type <> 1 AND h.drop_off_type <> 1 AND x.arrival_seconds <= {ASKED_AT + ASKED_HORIZON} AND h.trip_id IS DISTINCT FROM l.trip
            {'AND x.to_stop_id IN (SELECT l.destination UNION ALL SELECT a FROM foot WHERE b = l.destination)' if k == 2 else ''}),
    f{k} AS (SELECT query_id, destination, b AS stop_id, arrival + s AS arrival, cost, NULL::BIGINT AS trip FROM j{k} JOIN foot ON a = stop_id WHERE stop_id <> destination AND arrival + s <= {ASKED_AT + ASKED_HORIZON}),
    e{k} AS (SELECT * FROM j{k} WHERE stop_id <> destination UNION SELECT * FROM f{k})""" for k in (1, 2)) + f""",
    arrived AS (SELECT DISTINCT query_id, arrival, round(cost, 9) AS cost, transfers FROM ({' UNION ALL '.join(f'SELECT query_id, arrival, cost, {k - 1} AS transfers FROM {c}{k} WHERE stop_id = destination' for k in (1, 2) for c in 'jf')})),
    timely AS (SELECT * FROM arrived QUALIFY arrival <= min(arrival) OVER (PARTITION BY query_id) + 1800)
    SELECT query_id, arrival, round(cost, 6) AS cost, transfers FROM timely t WHERE NOT EXISTS (SELECT 1 FROM timely o
        WHERE o.query_id = t.query_id AND o.arrival <= t.arrival AND o.cost <= t.cost AND o.transfers <= t.transfers AND (o.arrival < t.arrival OR o.cost < t.cost OR o.transfers < t.transfers))"""
# Rules of single trips, by the first and the last stop of trips of three routes.
_TRIP_RULES = """, ends AS (SELECT trip_id, route_id, arg_min(stop_id, stop_sequence) AS first_stop, arg_max(stop_id, stop_sequence) AS last_stop FROM stop_times JOIN trips USING (trip_id) GROUP BY ALL),
    trip_rules AS (SELECT *, NULL::BIGINT AS from_trip_id, NULL::BIGINT AS to_trip_id FROM clique UNION ALL SELECT first_stop, first_stop, 3, NULL, NULL, trip_id FROM ends WHERE route_id = 7
        UNION ALL SELECT first_stop, first_stop, 2, 600, NULL, trip_id FROM ends WHERE route_id = 8 UNION ALL SELECT last_stop, last_stop, 2, 600, trip_id, NULL FROM ends WHERE route_id = 9)"""
_RULE = "SELECT {what} FROM trip_rules r WHERE r.from_stop_id = {stop} AND r.to_stop_id = {stop} AND (r.from_trip_id IS NULL OR r.from_trip_id = {own}) AND (r.to_trip_id IS NULL OR r.to_trip_id = {next})"
_STATES = _SEARCH + _TRIP_RULES + """,
    q0 AS (SELECT query_id, stop_id, NULL::BIGINT AS trip, true AS off, until AS arrival, until FROM starts UNION ALL SELECT query_id, b, NULL, true, until + s, until FROM starts JOIN foot ON a = stop_id)""" + "".join(f""",
    g{k} AS MATERIALIZED (SELECT query_id, x.trip_id AS trip, x.to_stop_id AS stop_id, x.drop_off_type = 0 AS off, min(x.arrival_seconds) AS arrival, until FROM q{k - 1} l
        JOIN today h ON h.from_stop_id = l.stop_id AND h.departure_seconds >= l.arrival JOIN today x ON x.trip_id = h.trip_id AND x.stop_sequence >= h.stop_sequence
        WHERE l.off AND h.pickup_type = 0 AND h.departure_seconds <= until + 10800 AND x.departure_seconds <= until + 10800 AND h.trip_id IS DISTINCT FROM l.trip
            AND NOT EXISTS ({_RULE.format(what='1', stop='l.stop_id', own='l.trip', next='h.trip_id')} AND (r.transfer_type = 3 OR h.departure_seconds < l.arrival + coalesce(r.min_transfer_time, 0))) GROUP BY ALL),
    q{k} AS (SELECT query_id, stop_id, trip, off, arrival, until FROM g{k} UNION SELECT query_id, b, trip, true, arrival + s, until FROM g{k} JOIN foot ON a = stop_id WHERE off)""" for k in (1, 2)) + """,
    reached AS (SELECT query_id, stop_id, transfers, min(arrival) AS arrival FROM (SELECT *, 0 AS transfers FROM q0 UNION ALL SELECT *, 0 FROM q1 UNION ALL SELECT *, 1 FROM q2) WHERE off GROUP BY ALL)
    SELECT query_id, stop_id, transfers, arrival FROM reached t WHERE NOT EXISTS (SELECT 1 FROM reached o WHERE o.query_id = t.query_id AND o.stop_id = t.stop_id AND o.transfers < t.transfers AND o.arrival <= t.arrival)"""
_CHAINS = _SEARCH + _COSTED + _TRIP_RULES + """,
    placed AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS position, drop_off_type = 0 AS off FROM costed),
    c1 AS (SELECT trip_id AS chain_id, 0 AS position, 'start' AS kind, from_stop_id AS stop_id, NULL::BIGINT AS departure, departure_seconds AS arrival, NULL::BIGINT AS trip_id, true AS can_alight, 0 AS transfers, 0::DOUBLE AS cost
        FROM placed WHERE position = 1
        UNION ALL SELECT trip_id, position, 'ride', to_stop_id, departure_seconds, arrival_seconds, trip_id, off, 0, leg_cost FROM placed),
    near AS (SELECT from_stop_id, (min((to_stop_id, coalesce(min_transfer_time, 0)))) AS w FROM clique WHERE from_stop_id <> to_stop_id AND transfer_type <> 3 GROUP BY ALL),
    c2 AS (SELECT chain_id, position + 1 AS position, 'walk' AS kind, w[1] AS stop_id, NULL::BIGINT AS departure, arrival + w[2] AS arrival, chain_id AS trip_id, true AS can_alight, 0 AS transfers, cost
        FROM (SELECT * FROM c1 QUALIFY position = max(position) OVER (PARTITION BY chain_id)) e JOIN near ON from_stop_id = stop_id),
    c3 AS (SELECT l.chain_id, l.position + 1 AS position, 'ride' AS kind, h.to_stop_id AS stop_id, h.departure_seconds AS departure, h.arrival_seconds AS arrival, h.trip_id, h.off AS can_alight, 1 AS transfers, l.cost + h.leg_cost AS cost
        FROM c2 l JOIN placed h ON h.from_stop_id = l.stop_id AND h.pickup_type = 0 AND h.trip_id <> l.chain_id AND h.departure_seconds BETWEEN l.arrival AND l.arrival + 10800
        QUALIFY row_number() OVER (PARTITION BY l.chain_id ORDER BY h.departure_seconds, h.trip_id, h.stop_sequence) = 1),
    sound AS MATERIALIZED (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3),
    spoilt AS (SELECT * REPLACE (stop_id + (chain_id % 10 = 1 AND position = 1)::INT AS stop_id, departure - 60 * (chain_id % 10 = 2 AND position = 1)::INT AS departure, arrival + 3600 * (chain_id % 10 = 3 AND position = 1 OR chain_id % 10 = 7 AND kind = 'walk')::INT AS arrival,
        CASE WHEN chain_id % 10 = 4 AND position = 1 THEN NOT can_alight ELSE can_alight END AS can_alight,
        CASE WHEN chain_id % 10 = 5 AND position = 1 THEN 1 ELSE transfers END AS transfers, cost + 0.5 * (chain_id % 10 = 6 AND position = 1)::INT AS cost) FROM sound),
    way AS MATERIALIZED (SELECT s.*, p.stop_id AS p_stop, p.arrival AS p_arrival, p.trip_id AS p_trip, p.can_alight AS p_off, p.cost AS p_cost, s.kind = 'ride' AND p.trip_id IS NOT NULL AND p.trip_id <> s.trip_id AS changes, s.kind = 'ride' AND p.trip_id IS DISTINCT
        FROM s.trip_id AS boards
        FROM spoilt s LEFT JOIN spoilt p ON p.chain_id = s.chain_id AND p.position = s.position - 1),
    paid AS (SELECT w.*, h.pickup_type, h.off, h.arrival_seconds, h.leg_cost, h.trip_id IS NOT NULL AS real, (SELECT sum(b.changes::INT) FROM way b WHERE b.chain_id = w.chain_id AND b.position <= w.position) AS counted,
        (SELECT arg_max(b.p_cost, b.position) FROM way b WHERE b.chain_id = w.chain_id AND b.position <= w.position AND b.boards) AS aboard
        FROM way w LEFT JOIN placed h ON w.kind = 'ride' AND h.trip_id = w.trip_id AND h.from_stop_id = p_stop AND h.to_stop_id = w.stop_id AND h.departure_seconds = w.departure),
    ends_of AS (SELECT chain_id, arg_min(stop_id, position) AS origin, arg_max(stop_id, position) AS destination, min(arrival) AS asked, max(position) AS last FROM sound GROUP BY ALL)
    SELECT chain_id, position, rule FROM (
        SELECT chain_id, position, unnest(["""
_BROKEN = {
    "begins elsewhere": "position = 0 AND (stop_id <> origin OR arrival <> asked)",
    "ends elsewhere": "position = last AND (stop_id <> destination OR NOT can_alight)",
    "goes back in time": "arrival < p_arrival",
    "a ride that there is not": "kind = 'ride' AND NOT real",
    "leaves before it has come": "kind = 'ride' AND departure < p_arrival",
    "arrives at another time": "real AND arrival <> arrival_seconds",
    "boards without a pickup": "real AND boards AND pickup_type <> 0",
    "gets off wrongly": "real AND can_alight <> off",
    "a walk that there is not": "kind = 'walk' AND NOT EXISTS (SELECT 1 FROM clique t WHERE t.from_stop_id = p_stop AND t.to_stop_id = paid.stop_id AND p_stop <> paid.stop_id AND t.transfer_type <> 3)",
    "a walk of another length": "kind = 'walk' AND EXISTS (SELECT 1 FROM clique t WHERE t.from_stop_id = p_stop AND t.to_stop_id = paid.stop_id AND p_stop <> paid.stop_id AND t.transfer_type <> 3) AND NOT EXISTS (SELECT 1 FROM clique t WHERE t.from_stop_id = p_stop AND t.to_stop_id = paid.stop_id AND p_stop <> paid.stop_id AND t.transfer_type <> 3 AND coalesce(t.min_transfer_time, 0) = arrival - p_arrival)",
    "walks from where none gets off": "kind = 'walk' AND NOT p_off",
    "changes where none gets off": "changes AND NOT p_off",
    "changes against a rule": f"changes AND EXISTS ({_RULE.format(what='1', stop='p_stop', own='p_trip', next='trip_id')} AND (r.transfer_type = 3 OR departure < p_arrival + coalesce(r.min_transfer_time, 0)))",
    "another number of changes": "transfers <> counted",
    "another cost": "abs(cost - CASE kind WHEN 'ride' THEN aboard + leg_cost WHEN 'walk' THEN p_cost ELSE 0 END) > 1e-6",
}
_CHAINS += ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in _BROKEN.items()) + "]) AS rule FROM paid JOIN ends_of USING (chain_id)) WHERE rule IS NOT NULL"

SELECTS = {
    "gtfs_time_parse_format": """SELECT trip_id, stop_sequence, printf('%02d:%02d:%02d', departure_seconds // 3600, departure_seconds % 3600 // 60, departure_seconds % 60) AS text, departure_seconds AS seconds FROM stop_times""",
    "time_window_bucket": f"SELECT {WINDOW('departure_seconds')} AS time_window, count(*) AS n FROM stop_times GROUP BY ALL",
    "delay_classification": "SELECT CASE WHEN delay_seconds < -120 THEN 'early' WHEN delay_seconds > 300 THEN 'late' ELSE 'on_time' END AS class, count(*) AS n FROM observations GROUP BY ALL",
    "haversine_pairs": f"""SELECT a.stop_id AS a, b.stop_id AS b, round({METERS('a.stop_lat', 'b.stop_lat', 'a.stop_lon', 'b.stop_lon')} / 1000, 6) AS km, round({METERS('a.stop_lat', 'b.stop_lat', 'a.stop_lon', 'b.stop_lon')} / 1000 / 120 * 3600, 4) AS seconds
        FROM stops a JOIN stops b USING (parent_station) WHERE a.stop_id < b.stop_id""",
    "route_display_name": f"SELECT route_id, {NAME} AS name FROM routes",
    "orphan_fk_rows": "SELECT trip_id, count(*) AS orphans FROM stop_times WHERE trip_id NOT IN (SELECT trip_id FROM trips WHERE route_id <> 7) GROUP BY ALL",
    "constraint_violations": """SELECT 'time_goes_back' AS rule, count(*) AS n FROM (SELECT arrival_seconds < lag(departure_seconds) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS b FROM stop_times) WHERE b
        HAVING count(*) > 0 UNION ALL SELECT 'pickup_type_unknown', count(*) FROM stop_times WHERE pickup_type NOT IN (0, 1, 2, 3) HAVING count(*) > 0 UNION ALL SELECT 'over_a_day', count(*)
        FROM stop_times WHERE departure_seconds >= 86400 HAVING count(*) > 0""",
    "connections_lead": f"""SELECT trip_id, from_stop_id, to_stop_id, departure_seconds, arrival_seconds, stop_sequence, route_id, coalesce(direction_id, -1) AS direction_id, service_id, {NAME} AS route_name FROM hops
        JOIN routes USING (route_id)""",
    "departures_from_stop": """SELECT trip_id, to_stop_id, departure_seconds, stop_sequence FROM hops WHERE from_stop_id = 1 AND departure_seconds >= 28800 AND pickup_type <> 1 AND drop_off_type <> 1
        ORDER BY departure_seconds, trip_id, stop_sequence LIMIT 20 OFFSET 5""",
    "departures_window": "SELECT trip_id, to_stop_id, departure_seconds, arrival_seconds FROM hops WHERE from_stop_id = 2 AND departure_seconds BETWEEN 25200 AND 36000 AND pickup_type <> 1",
    "bulk_departures": "SELECT from_stop_id, to_stop_id, trip_id, stop_sequence, service_id, departure_seconds, arrival_seconds FROM hops WHERE departure_seconds >= 28800 AND pickup_type <> 1",
    "trip_connections": "SELECT trip_id, stop_sequence, from_stop_id, to_stop_id, departure_seconds, arrival_seconds FROM hops WHERE trip_id = (SELECT max(trip_id) FROM trips) AND stop_sequence >= 2",
    "stop_search": "SELECT stop_id, stop_name FROM stops WHERE stop_id IN (SELECT stop_id FROM stop_times) AND contains(lower(stop_name), '#00000001') ORDER BY stop_name, stop_id LIMIT 20",
    "stops_with_service": "SELECT stop_id, stop_name, parent_station FROM stops WHERE stop_id IN (SELECT stop_id FROM stop_times)",
    "transfers_from": "SELECT * REPLACE (coalesce(min_transfer_time, -1) AS min_transfer_time) FROM transfers WHERE from_stop_id = 1",
    "station_clique_transfers": "SELECT * REPLACE (coalesce(min_transfer_time, -1) AS min_transfer_time) FROM clique",
    "same_stop_rules": """SELECT from_stop_id AS stop_id, max(coalesce(min_transfer_time, 0)) AS min_seconds, max((transfer_type = 3)::INT) AS forbidden FROM transfers WHERE from_stop_id = to_stop_id GROUP BY ALL""",
    "active_services": "SELECT service_id FROM service_days WHERE service_date = DATE '2026-07-27'",
    "service_day_expansion": "SELECT service_id, service_date::VARCHAR AS service_date FROM service_days",
    "first_active_date": "SELECT service_id, min(service_date)::VARCHAR AS first_date FROM service_days GROUP BY ALL",
    "next_operating_date": """SELECT trip_id, next_date FROM trips JOIN (SELECT d.service_id, min(d.service_date)::VARCHAR AS next_date
        FROM (SELECT service_id, days, unnest(generate_series(DATE '2026-07-28', end_date, INTERVAL 1 DAY))::DATE AS service_date FROM calendar) d
        LEFT JOIN calendar_dates x ON x.service_id = d.service_id AND x.service_date = d.service_date WHERE exception_type = 1 OR (exception_type IS DISTINCT
        FROM 2 AND substr(days, isodow(d.service_date)::INT, 1) = '1') GROUP BY ALL) USING (service_id)""",
    "service_range": "SELECT min(start_date)::VARCHAR AS first_date, max(end_date)::VARCHAR AS last_date FROM calendar",
    "rail_trips": """, rail AS (SELECT trip_id, route_id FROM trips JOIN routes USING (route_id) WHERE route_type = 1 AND service_id IN (SELECT service_id FROM service_days
        WHERE service_date = DATE '2026-06-29')) SELECT trip_id, route_id, (SELECT count(DISTINCT route_id) FROM rail) AS routes FROM rail""",
    "route_count_between": """SELECT count(DISTINCT route_id) AS routes, count(*) AS pairs FROM stop_times o JOIN stop_times d ON o.trip_id = d.trip_id AND d.stop_sequence > o.stop_sequence JOIN trips t ON t.trip_id = o.trip_id
        WHERE o.stop_id = 1 AND d.stop_id = 2""",
    "integration_cases": f""", sampled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY trip_id) AS k FROM trips) WHERE k = 1 ORDER BY route_id, trip_id LIMIT 500),
        candidate AS (SELECT *, row_number() OVER (PARTITION BY origin, destination ORDER BY service_date, departure, trip_id, o_seq) AS pair_rank FROM (
            SELECT o.stop_id AS origin, o.stop_sequence AS o_seq, o.departure_seconds AS departure, d.stop_id AS destination, d.arrival_seconds AS arrival, trip_id, route_id, service_date
            FROM sampled JOIN (SELECT service_id, min(service_date) AS service_date FROM service_days GROUP BY ALL) USING (service_id) JOIN stop_times o USING (trip_id)
            JOIN LATERAL (SELECT * FROM stop_times l WHERE l.trip_id = o.trip_id AND l.stop_sequence > o.stop_sequence AND l.stop_id <> o.stop_id AND l.drop_off_type <> 1
        ORDER BY l.stop_sequence DESC LIMIT 1) d ON true WHERE o.pickup_type <> 1)),
        unique_pairs AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY service_date, departure, trip_id, origin, destination) AS route_rank FROM candidate WHERE pair_rank = 1)
        SELECT origin, a.stop_name AS origin_name, destination, b.stop_name AS destination_name, service_date::VARCHAR AS service_date, departure, trip_id, route_id, {NAME} AS route_name, arrival
        FROM unique_pairs JOIN stops a ON a.stop_id = origin JOIN stops b ON b.stop_id = destination JOIN routes USING (route_id)
        WHERE route_rank = 1 ORDER BY departure >= 86400 DESC, unique_pairs.service_date, route_id, trip_id, origin, destination LIMIT 20""",
    "latest_observations": "SELECT * REPLACE (service_date::VARCHAR AS service_date, coalesce(scheduled_arrival, -1) AS scheduled_arrival) FROM latest",
    "observation_dedup": "SELECT trip_id, count(*) AS n FROM (SELECT DISTINCT trip_id, stop_id, stop_sequence, service_date, observed_at FROM observations) GROUP BY ALL",
    "trip_samples": "SELECT * REPLACE (service_date::VARCHAR AS service_date, coalesce(direction_id, -1) AS direction_id) FROM samples",
    "profile_network": "SELECT * FROM p_network",
    "profile_route": "SELECT * FROM p_route",
    "profile_route_direction": "SELECT * FROM p_direction",
    "profile_exact": "SELECT * FROM p_exact",
    "profiles_below_minimum": "SELECT count(*) AS n FROM p_exact WHERE insufficient",
    "delay_summary": """SELECT count(*) AS n, avg(delay_seconds) AS mean, round(coalesce(stddev_samp(delay_seconds), 0), 6) AS stddev, quantile_cont(delay_seconds, 0.5) AS p50, round(quantile_cont(abs(delay_seconds), 0.9), 6) AS p90_abs
        FROM observations""",
    "profile_resolution": f"""SELECT trip_id, CASE WHEN e.n IS NOT NULL THEN 'exact' WHEN d.n IS NOT NULL THEN 'route_direction' WHEN r.n IS NOT NULL THEN 'route' WHEN w.n IS NOT NULL THEN 'network' ELSE 'default' END AS level, round(coalesce(e.reliability, d.reliability, r.reliability, w.reliability, 0), 9) AS reliability, coalesce(e.n, d.n, r.n, w.n, 0) AS n, coalesce(e.n, d.n, r.n, w.n, 0) < 20 AS insufficient
        FROM (SELECT trip_id, route_id, coalesce(direction_id, -1) AS direction_key, {WINDOW('departure_seconds')} AS time_window FROM hops WHERE stop_sequence = 1) l LEFT
        JOIN p_exact e USING (route_id, direction_key, time_window) LEFT JOIN p_direction d USING (route_id, direction_key) LEFT JOIN p_route r USING (route_id) LEFT JOIN p_network w ON true""",
    "route_patterns": """SELECT route_id, coalesce(direction_id, -1) AS direction_id, stops, count(*) AS trips, min(trip_id) AS first_trip FROM (SELECT trip_id, route_id, direction_id, string_agg(from_stop_id::VARCHAR, '|'
        ORDER BY stop_sequence) || '|' || arg_max(to_stop_id, stop_sequence)::VARCHAR AS stops FROM hops GROUP BY ALL) GROUP BY ALL""",
    "observation_backfill": """SELECT observation_id, trip_id, stop_sequence, gap
        FROM (SELECT event_id AS observation_id, trip_id, stop_sequence, abs(hour(ts) * 3600 + minute(ts) * 60 - arrival_seconds) AS gap, row_number() OVER (PARTITION BY event_id
        ORDER BY abs(hour(ts) * 3600 + minute(ts) * 60 - arrival_seconds), stop_sequence) AS k FROM events JOIN stop_times ON trip_id = user_id) WHERE k = 1""",
    "max_speed_bound": f"""SELECT round(max({METERS('a.stop_lat', 'b.stop_lat', 'a.stop_lon', 'b.stop_lon')} / (arrival_seconds - departure_seconds)) * 1.001, 6) AS meters_per_second FROM hops
        JOIN stops a ON a.stop_id = from_stop_id JOIN stops b ON b.stop_id = to_stop_id WHERE arrival_seconds > departure_seconds""",
    "journeys_by_station": _JOURNEYS,
    "state_search_rounds": _STATES,
    "label_chain_violations": _CHAINS,
    "earliest_arrival_rounds": _ROUNDS + " SELECT query_id, stop_id, min(arrival) AS arrival FROM every GROUP BY ALL",
    "snapshot_search_rounds": _ROUNDS + " SELECT query_id, stop_id, boardings, arrival FROM (SELECT *, min(arrival) OVER (PARTITION BY query_id, stop_id ORDER BY boardings ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM every) WHERE before IS NULL OR arrival < before",
    "walks_closed": _SEARCH + " SELECT a AS from_stop_id, b AS to_stop_id, s AS seconds FROM foot",
    "pareto_alternatives": """SELECT DISTINCT destination, arrival, cost, transfers FROM alternatives a WHERE NOT EXISTS (SELECT 1 FROM alternatives b
        WHERE b.destination = a.destination AND b.arrival <= a.arrival AND b.cost <= a.cost AND b.transfers <= a.transfers AND (b.arrival < a.arrival OR b.cost < a.cost OR b.transfers < a.transfers))""",
    "rank_alternatives": """, x AS (SELECT * REPLACE (round(reliability, 6) AS reliability), arrival - departure AS duration, min(arrival - departure) OVER () AS fastest FROM alternatives
        WHERE destination = 2), s AS (SELECT *, round(greatest(0, least(100, 100 * (0.5::DOUBLE * reliability + 0.5::DOUBLE * least(1.0::DOUBLE, fastest::DOUBLE / greatest(1, duration))))), 6) AS score
        FROM x), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, reliability DESC, arrival, transfers, trip_id) AS rank
        FROM s) SELECT rank::INT AS rank, trip_id, departure, arrival, reliability, score FROM r WHERE rank <= 3""",
    "semantic_dedupe": "SELECT destination, count(*) AS n FROM (SELECT DISTINCT route_id, destination, departure, arrival FROM alternatives) GROUP BY ALL",
    "departures_per_stop": "SELECT from_stop_id, service_id, count(*) AS n, min(departure_seconds) AS first FROM hops WHERE departure_seconds >= 28800 AND pickup_type <> 1 GROUP BY ALL",
    "bulk_trip_connections": "SELECT trip_id, stop_sequence, from_stop_id, to_stop_id, departure_seconds, arrival_seconds FROM hops WHERE route_id = 7",
    "snapshot_connections": f"""SELECT trip_id, stop_sequence, from_stop_id, to_stop_id, departure_seconds, arrival_seconds, pickup_type, drop_off_type, route_id, service_id, {NAME} AS route_name FROM hops
        JOIN routes USING (route_id)""",
    "find_stops": "SELECT stop_id, stop_name, parent_station FROM stops WHERE stop_id IN (SELECT from_stop_id FROM transfers)",
    "stop_search_wildcards": "SELECT stop_id, stop_name FROM stops WHERE stop_name ILIKE '%SUPPLIER#%_3%' AND stop_id IN (SELECT stop_id FROM stop_times) ORDER BY stop_name, stop_id LIMIT 20",
    "leg_exists": """SELECT l.trip_id, l.stop_sequence, EXISTS (SELECT 1 FROM stop_times o JOIN stop_times d ON d.trip_id = o.trip_id AND d.stop_sequence > o.stop_sequence
        WHERE o.trip_id = l.trip_id AND o.stop_id = l.from_stop_id AND d.stop_id = l.to_stop_id AND o.departure_seconds = l.departure AND d.arrival_seconds = l.arrival_seconds) AS present
        FROM (SELECT *, departure_seconds + CASE WHEN trip_id % 3 = 0 THEN 60 ELSE 0 END AS departure FROM hops) l""",
    "feed_version": "SELECT min(start_date)::VARCHAR || ':' || max(end_date)::VARCHAR AS version FROM calendar",
    "profile_version": "SELECT coalesce(max(observed_at)::VARCHAR, 'no-profiles') AS version FROM observations",
    "service_dates": "SELECT (ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Vancouver')::DATE::VARCHAR AS service_date, count(*) AS n FROM events GROUP BY ALL",
    "speed_bound_metadata": f""", edges AS (SELECT from_stop_id, to_stop_id, arrival_seconds - departure_seconds AS seconds, 'ride' AS kind FROM hops UNION ALL SELECT from_stop_id, to_stop_id, coalesce(min_transfer_time, 0), 'transfer' FROM transfers WHERE transfer_type <> 3),
        placed AS (SELECT kind, seconds, {METERS('a.stop_lat', 'b.stop_lat', 'a.stop_lon', 'b.stop_lon')} AS metres FROM edges JOIN stops a ON a.stop_id = from_stop_id JOIN stops b ON b.stop_id = to_stop_id),
        scoped AS (SELECT 'rides' AS scope, * FROM placed WHERE kind = 'ride' UNION ALL SELECT 'all', * FROM placed),
        summed AS (SELECT scope, max(metres / CASE WHEN seconds > 0 THEN seconds END) AS most, count(*) AS edges, min(CASE WHEN seconds <= 0 THEN 'takes no time: ' || kind END) AS reason FROM scoped WHERE metres > 0 GROUP BY scope)
        SELECT scope, reason IS NULL AS enabled, CASE WHEN reason IS NULL THEN round(most * 1.001, 6) END AS meters_per_second, edges, reason FROM summed""",
    "diagnostics_counts": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in ("stops", "trips", "routes", "stop_times", "calendar", "calendar_dates", "transfers")),
    "profile_lookup": "SELECT route_id, direction_key, time_window, n, reliability FROM p_exact WHERE route_id IN (1, 5, 9) AND time_window IN ('midday', 'evening')",
    "profile_fallbacks": """SELECT 'route_direction' AS profile_level, route_id::VARCHAR AS route_key, direction_key, n, dates, on_time, reliability FROM p_direction
        UNION ALL SELECT 'route', route_id::VARCHAR, -1, n, dates, on_time, reliability FROM p_route UNION ALL SELECT 'network', '*', -1, n, dates, on_time, reliability FROM p_network""",
    "latest_count": "SELECT count(*) AS n FROM latest",
    "bulk_transfers": "SELECT * REPLACE (coalesce(min_transfer_time, -1) AS min_transfer_time) FROM transfers",
    "service_operates": """SELECT p.service_id, p.service_date::VARCHAR AS service_date,
        CASE exception_type WHEN 1 THEN true WHEN 2 THEN false ELSE coalesce(p.service_date BETWEEN start_date AND end_date AND substr(days, isodow(p.service_date)::INT, 1) = '1', false) END AS operates
        FROM (SELECT DISTINCT service_id, unnest(generate_series(DATE '2026-07-20', DATE '2026-08-10', INTERVAL 1 DAY))::DATE AS service_date FROM trips) p LEFT
        JOIN calendar_dates x ON x.service_id = p.service_id AND x.service_date = p.service_date LEFT JOIN calendar c ON c.service_id = p.service_id""",
    "active_or_unruled_services": """SELECT DISTINCT service_id FROM trips WHERE service_id = '4-NOT SPECIFIED' OR service_id IN (SELECT service_id FROM service_days WHERE service_date = DATE '2026-07-26')""",
    "calendar_rules": """SELECT c.service_id, days, start_date::VARCHAR AS start_date, end_date::VARCHAR AS end_date, coalesce(exception_type, -1) AS exception_type FROM calendar c LEFT
        JOIN calendar_dates x ON x.service_id = c.service_id AND x.service_date = DATE '2026-07-27'""",
    "feed_expiry": """SELECT max(end_date)::VARCHAR AS last_date, max(end_date) < DATE '2026-12-10' AS expired,
        CASE WHEN max(end_date) - DATE '2026-12-10' BETWEEN 0 AND 30 THEN 'expires on ' || max(end_date)::VARCHAR END AS warning FROM calendar""",
    "pareto_by_transfers": """, x AS (SELECT o_custkey % 100 AS customer, (o_orderdate::DATE - DATE '1992-01-01') * 60 AS arrival, round(o_totalprice, 2) AS cost, (o_orderkey % 23)::INT AS transfers FROM orders)
        SELECT DISTINCT customer, arrival, cost, transfers FROM x a WHERE NOT EXISTS (SELECT 1 FROM x b
        WHERE b.customer = a.customer AND b.arrival <= a.arrival AND b.cost <= a.cost AND b.transfers <= a.transfers AND (b.arrival < a.arrival OR b.cost < a.cost OR b.transfers < a.transfers))""",
    "structural_dedupe": """SELECT trip_id, count(*) AS n FROM (SELECT DISTINCT trip_id, o.stop_id AS a, d.stop_id AS b FROM stop_times o JOIN stop_times d USING (trip_id) WHERE d.stop_sequence > o.stop_sequence) GROUP BY ALL""",
    "trips_not_active": """SELECT trip_id FROM trips WHERE service_id IN (SELECT service_id FROM service_days WHERE service_date = DATE '2026-06-29') AND service_id NOT IN (SELECT service_id FROM service_days
        WHERE service_date = DATE '2026-07-27')""",
    "simulation_ranking": """, x AS (SELECT *, arrival - departure AS duration, min(arrival - departure) OVER (PARTITION BY destination) AS fastest
        FROM (SELECT DISTINCT concat_ws('-', trip_id, departure, arrival) AS itinerary_id, destination, departure, arrival, round(reliability, 6) AS adherence FROM alternatives)),
        s AS (SELECT *, round(greatest(0, least(100, 100 * (0.55::DOUBLE + 0.25::DOUBLE * adherence + 0.20::DOUBLE * CASE WHEN duration <= 0 THEN 1 ELSE greatest(0, least(1, fastest::DOUBLE / duration)) END))), 6) AS score FROM x)
        SELECT destination, rank::INT AS rank, itinerary_id, score FROM (SELECT *, row_number() OVER (PARTITION BY destination ORDER BY score DESC, arrival, itinerary_id) AS rank FROM s) WHERE rank <= 3""",
    "stored_departures": """SELECT trip_id, stop_sequence, from_stop_id, to_stop_id, departure_seconds, arrival_seconds FROM hops WHERE from_stop_id = 1 AND departure_seconds >= 28800 AND pickup_type <> 1 AND drop_off_type <> 1""",
    "stored_violations": """SELECT * FROM (SELECT 'hop starts at an unknown stop' AS rule, count(*) AS rows FROM hops WHERE from_stop_id = 5 UNION ALL SELECT 'hop ends at an unknown stop', count(*) FROM hops WHERE to_stop_id = 5
        UNION ALL SELECT 'transfer from an unknown stop', count(*) FROM transfers WHERE from_stop_id = 5 OR from_stop_id NOT IN (SELECT stop_id FROM stops)
        UNION ALL SELECT 'transfer to an unknown stop', count(*) FROM transfers WHERE to_stop_id = 5 OR to_stop_id NOT IN (SELECT stop_id FROM stops)
        UNION ALL SELECT 'calendar is not as long as when written', 1 UNION ALL SELECT 'calendar_dates is not as long as when written', 1
        UNION ALL SELECT 'stops is not as long as when written', 1) WHERE rows > 0""",
    "stored_rule_breaks": """, once AS (SELECT trip_id, stop_sequence, to_stop_id, from_stop_id + (trip_id % 10 = 2 AND stop_sequence = 2)::INT AS from_stop_id, departure_seconds - 7200 * (trip_id % 10 = 3 AND stop_sequence = 2)::INT AS departure_seconds,
            CASE WHEN trip_id % 10 = 6 AND stop_sequence = 1 THEN departure_seconds - 60 WHEN NOT (trip_id % 10 = 4 AND stop_sequence = 1) THEN arrival_seconds END AS arrival_seconds, CASE WHEN trip_id % 10 = 5 AND stop_sequence = 1 THEN 7 ELSE direction_id END AS direction_id FROM hops),
        again AS (SELECT * FROM once WHERE trip_id % 10 = 1 AND stop_sequence = 1), broken AS (SELECT * FROM once UNION ALL SELECT * FROM again),
        along AS (SELECT *, lag(arrival_seconds) OVER w AS come, lag(to_stop_id) OVER w AS place FROM broken WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence)), known AS (SELECT stop_id FROM stops)
        SELECT * FROM (SELECT 'hop arrives before it departs' AS rule, count(*) AS rows FROM broken WHERE arrival_seconds < departure_seconds UNION ALL SELECT 'hop has no time', count(*) FROM broken WHERE arrival_seconds IS NULL
        UNION ALL SELECT 'hop starts at an unknown stop', count(*) FROM broken WHERE from_stop_id NOT IN (FROM known) UNION ALL SELECT 'hop is there twice', count(*) FROM again
        UNION ALL SELECT 'hops is not as long as when written', count(*) FROM again UNION ALL SELECT 'hop with an unknown direction', count(*) FROM broken WHERE direction_id = 7
        UNION ALL SELECT 'trip leaves before it has come', count(*) FROM along WHERE departure_seconds < come UNION ALL SELECT 'trip goes on from another stop', count(*) FROM along WHERE from_stop_id <> place
        UNION ALL SELECT 'transfer from an unknown stop', count(*) FROM transfers WHERE from_stop_id NOT IN (FROM known) UNION ALL SELECT 'transfer to an unknown stop', count(*) FROM transfers WHERE to_stop_id NOT IN (FROM known)
        UNION ALL SELECT 'transfer of an unknown type', count(*) FROM transfers WHERE from_stop_id % 5 = 1 UNION ALL SELECT 'transfer takes negative time', count(*) FROM transfers WHERE from_stop_id % 2 = 0
        UNION ALL SELECT 'stop off the globe', count(*) FROM stops WHERE stop_id % 20 = 3 UNION ALL SELECT 'profiles: out of range', count(*) FROM p_exact WHERE route_id % 10 = 1 AND reliability > 0
        UNION ALL SELECT 'profiles: there twice', count(*) FROM p_exact WHERE route_id % 10 = 2 UNION ALL SELECT 'profiles is not as long as when written', count(*) FROM p_exact WHERE route_id % 10 = 2) WHERE rows > 0""",
    "stored_speed_bounds": f""", edges AS (SELECT from_stop_id, to_stop_id, arrival_seconds - departure_seconds AS seconds FROM hops UNION ALL SELECT from_stop_id, to_stop_id, min_transfer_time FROM transfers WHERE transfer_type <> 3 AND from_stop_id <> to_stop_id AND min_transfer_time > 0),
        placed AS (SELECT seconds, {METERS('a.stop_lat', 'b.stop_lat', 'a.stop_lon', 'b.stop_lon')} AS metres FROM edges LEFT JOIN stops a ON a.stop_id = from_stop_id LEFT JOIN stops b ON b.stop_id = to_stop_id),
        seen AS (SELECT CASE WHEN count(*) FILTER (metres IS NULL) > 0 THEN 'a place is missing: transfer' END AS fault, round(max(metres / seconds) * 1.001, 6) AS most FROM placed WHERE metres IS NULL OR metres > 0),
        judged_bounds AS (SELECT declared, CASE WHEN declared IS NULL THEN 'no bound is declared' WHEN declared <= 0 THEN 'the declared bound is no positive number' WHEN fault IS NOT NULL THEN fault WHEN declared < most THEN 'the declared bound is too low' END AS reason
            FROM seen, (VALUES (NULL::DOUBLE), (-1), (1), (100000)) AS d(declared))
        SELECT reason IS NULL AS enabled, CASE WHEN reason IS NULL THEN declared END AS meters_per_second, reason, declared FROM judged_bounds""",
    "itinerary_violations": _SEARCH.split("\n")[0] + """
        l1 AS (SELECT trip_id, arg_max(to_stop_id, stop_sequence) AS t1, arg_min(departure_seconds, stop_sequence) AS d1, arg_max(arrival_seconds, stop_sequence) AS a1 FROM today GROUP BY ALL),
        l2 AS (SELECT l1.trip_id, h.departure_seconds AS d2, h.arrival_seconds AS a2 FROM l1 JOIN today h ON h.from_stop_id = t1 AND h.trip_id <> l1.trip_id AND h.departure_seconds BETWEEN a1 AND a1 + 10800
            QUALIFY row_number() OVER (PARTITION BY l1.trip_id ORDER BY h.departure_seconds, h.trip_id, h.stop_sequence) = 1),
        whole AS (SELECT trip_id AS query_id, trip_id % 10 AS k, d1, a1, d2, coalesce(a2, a1) AS arrival FROM l1 LEFT JOIN l2 USING (trip_id))
        SELECT query_id, unnest(list_filter([CASE WHEN k = 1 THEN 'another destination' END, CASE WHEN k = 2 THEN 'nothing was found' END, CASE WHEN k = 3 OR (k = 7 AND d2 IS NOT NULL) THEN 'a wrong number of transfers' END,
            CASE WHEN k = 4 THEN 'a wrong duration' END, CASE WHEN k = 5 AND d2 - 7200 < a1 THEN 'departs before the last leg arrives' END, CASE WHEN (k = 5 AND d2 IS NOT NULL) OR k = 8 THEN 'a ride that there is not' END,
            CASE WHEN k = 6 THEN 'another departure' END, CASE WHEN k = 6 THEN 'departs before the departure asked for' END, CASE WHEN k = 6 AND arrival < d1 + 3600 THEN 'arrives before the departure asked for' END,
            CASE WHEN k = 7 THEN 'no legs' END, CASE WHEN k = 8 AND d2 IS NULL THEN 'does not end at the destination' END], lambda r: r IS NOT NULL)) AS rule FROM whole""",
    "csv_reason_codes": """SELECT reason, count(*) AS n, min(place) AS first_row, max(place) AS last_row FROM (SELECT
        CASE WHEN trip_id % 10 = 5 THEN 'wrong number of values at row ' || place WHEN trip_id % 10 = 4 THEN 'empty route_id' WHEN trip_id % 10 = 3 THEN 'invalid direction_id'
        WHEN route_id = 7 THEN 'orphan route_id' ELSE 'kept' END AS reason, place FROM (SELECT *, row_number() OVER (ORDER BY trip_id) + 1 AS place FROM trips)) GROUP BY ALL""",
    "ordered_scans": """SELECT 'stops' AS name, row_number() OVER (ORDER BY stop_id) AS place, concat_ws('|', stop_id, stop_lat >= 49, stop_lon >= -123) AS row FROM stops
        UNION ALL SELECT 'transfers', row_number() OVER (ORDER BY from_stop_id, to_stop_id, transfer_type, min_transfer_time NULLS FIRST), concat_ws('|', from_stop_id, to_stop_id, transfer_type, coalesce(min_transfer_time, -1)) FROM clique
        UNION ALL SELECT 'calendar', row_number() OVER (ORDER BY service_id), concat_ws('|', service_id, days, start_date, end_date) FROM calendar
        UNION ALL SELECT 'calendar_dates', row_number() OVER (ORDER BY service_date, service_id), concat_ws('|', service_date, service_id, exception_type) FROM calendar_dates
        UNION ALL SELECT 'profiles', row_number() OVER (ORDER BY route_id, direction_key, time_window), concat_ws('|', route_id, direction_key, time_window, n) FROM p_exact""",
    "insert_counts": """SELECT count(*) AS inserted, (SELECT 2 * count(*) FROM observations) - count(*) AS duplicates FROM (SELECT DISTINCT trip_id, stop_id, stop_sequence, service_date, observed_at FROM observations
        WHERE (trip_id, stop_id, stop_sequence, service_date, observed_at) NOT IN (SELECT trip_id, stop_id, stop_sequence, service_date, observed_at FROM observations WHERE stop_id = 'click'))""",
    "trip_reliability": f"""{_SEARCH}{_COSTED} SELECT trip_id, round(greatest(product(exp(-leg_cost)), {FLOOR}), 9) AS reliability FROM costed GROUP BY ALL""",
    "response_digest": """SELECT sha256(string_agg(line, chr(10) ORDER BY departure_seconds, trip_id, stop_sequence)) AS hash
        FROM (SELECT departure_seconds, trip_id, stop_sequence, '{"departure_seconds":' || departure_seconds || ',"stop_sequence":' || stop_sequence || ',"to_stop_id":' || to_stop_id || ',"trip_id":' || trip_id || '}' AS line
        FROM hops WHERE from_stop_id = 1 AND departure_seconds >= 28800 AND pickup_type <> 1 AND drop_off_type <> 1 ORDER BY departure_seconds, trip_id, stop_sequence LIMIT 20 OFFSET 5)""",
    "stream_window_counts": """SELECT CAST(epoch(date_trunc('hour', observed_at)) AS BIGINT) AS start, trip_id, count(*) AS n, round(avg(delay_seconds), 6) AS mean FROM observations
        WHERE date_trunc('hour', observed_at) + INTERVAL 1 HOUR <= (SELECT max(observed_at) - INTERVAL 1 HOUR FROM observations) GROUP BY ALL""",
    "stream_keyed_newest": "SELECT * REPLACE (service_date::VARCHAR AS service_date, coalesce(scheduled_arrival, -1) AS scheduled_arrival) FROM latest",
    "samples_merged": f""", early AS (SELECT trip_id, service_date, time_window, quantile_cont(delay_seconds, 0.5) AS delay, count(*) AS stops, max(observed_at) AS newest FROM (SELECT *, {WINDOW('scheduled_arrival')} AS time_window FROM latest WHERE stop_id <> 'click' AND scheduled_arrival IS NOT NULL) JOIN trips USING (trip_id) GROUP BY ALL)
        SELECT trip_id, service_date::VARCHAR AS service_date, time_window, coalesce(s.delay, e.delay) AS delay, coalesce(s.stops, e.stops) AS stops,
        CASE WHEN (s.delay, s.stops, s.newest) IS NOT DISTINCT FROM (e.delay, e.stops, e.newest) THEN '2026-01-01' ELSE '2026-01-02' END AS updated
        FROM samples s FULL JOIN early e USING (trip_id, service_date, time_window)""",
    "rt_schedule_match": """SELECT position, stop_sequence, stop_id FROM (SELECT position, t.stop_sequence, t.stop_id, row_number() OVER (PARTITION BY position ORDER BY t.stop_sequence NULLS LAST) AS k FROM
        (SELECT event_id AS position, user_id, CASE WHEN event_id % 3 <> 0 THEN event_id % 10 END AS stop, CASE WHEN event_id % 3 <> 1 THEN event_id % 4 + 1 END AS seq FROM events) e
        LEFT JOIN stop_times t ON t.trip_id = user_id AND (stop IS NULL OR stop = t.stop_id) AND (seq IS NULL OR seq = t.stop_sequence)) WHERE k = 1""",
    "stream_latest_observations": "SELECT * REPLACE (service_date::VARCHAR AS service_date, coalesce(scheduled_arrival, -1) AS scheduled_arrival) FROM latest",
}


def oracle_sql() -> dict[str, str]:
    views = ",\n".join(f"{k} AS ({v})" for k, v in VIEWS.items())
    return {k: f"WITH RECURSIVE {views}{'' if s.startswith(',') else chr(10)}{s}" for k, s in SELECTS.items()}
