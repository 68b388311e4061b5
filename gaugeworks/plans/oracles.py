"""DuckDB SQL for the registered queries."""

from __future__ import annotations

import math

from gaugeworks.plans.queries import ALPHA, CUTOFF, EULER, HZ, IDLE_NS, TOLERANCE_NS

_R = "r AS (SELECT user_id AS sensor_id, event_id AS seq, epoch_us(ts) * 1000 AS timestamp_ns, event_type, value FROM events WHERE NOT isnan(value) AND value BETWEEN -1000 AND 1000)"
_N = f"{_R}, n AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY seq) AS n FROM r)"
_I = "i AS (SELECT vec_id AS seq, " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS {c}" for k, c in enumerate(("ax", "ay", "az", "gx", "gy", "gz"))) + " FROM embeddings)"


def _d(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _status(keys: str, where: str = "") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    cols = f"{keys}, " if keys else ""
    return f"""SELECT *, CASE WHEN value > 1.5 * mean THEN 'HIGH' WHEN value < 0.5 * mean THEN 'LOW' ELSE 'NORMAL' END AS status FROM (
        SELECT {cols}seq, value, count(*) OVER w AS count, (sum(round(value * 100)::BIGINT) OVER w)::DOUBLE / 100::DOUBLE / count(*) OVER w AS mean
        FROM r {where} WINDOW w AS ({part}ORDER BY seq ROWS UNBOUNDED PRECEDING))"""


def _recursive(first: str, step: str, columns: str, pick: str) -> str:
    """A fold by sensor: first and step give `columns` (prefix p. for the state before, n. for the row)."""
    return f"""WITH RECURSIVE {_N},
        f AS (SELECT n.sensor_id, n.seq, n.n, n.value, {first} FROM n WHERE n.n = 1
              UNION ALL SELECT n.sensor_id, n.seq, n.n, n.value, {step} FROM f AS p JOIN n ON n.sensor_id = p.sensor_id AND n.n = p.n + 1)
        SELECT sensor_id, seq, {pick} FROM f{columns}"""


def _ema(alpha: float, name: str) -> str:
    return _recursive("n.value AS y", f"{_d(alpha)} * n.value + {_d(1 - alpha)} * p.y", "", f"value, y AS {name}")


_DT, _RC = 1 / HZ, 1 / (2 * math.pi * CUTOFF)
_HP = _RC / (_RC + _DT)
_GAIN = "(({p} + 0.01::DOUBLE) / (({p} + 0.01::DOUBLE) + 0.1::DOUBLE))"


def _kalman() -> str:
    gain = lambda p: _GAIN.format(p=p)
    cov = lambda p: f"(1 - {gain(p)}) * ({p} + 0.01::DOUBLE)"
    first = f"0::DOUBLE + {gain('1::DOUBLE')} * (n.value - 0::DOUBLE) AS x, {cov('1::DOUBLE')} AS c, {gain('1::DOUBLE')} AS g"
    step = f"p.x + {gain('p.c')} * (n.value - p.x), {cov('p.c')}, {gain('p.c')}"
    return _recursive(first, step, "", "value, x AS estimate, c AS error_covariance, g AS gain")


def _vec(name: str, *parts: str) -> str:
    return ", ".join(f"{p} AS {name}_{c}" for c, p in zip("xyz", parts, strict=True))


def _rotated() -> str:
    (cy, sy), (cp, sp), (cr, sr) = ((math.cos(a), math.sin(a)) for a in EULER)
    m = [[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]]
    return f"WITH {_I} SELECT seq, " + _vec("accel", *(f"round(ax * {_d(r[0])} + ay * {_d(r[1])} + az * {_d(r[2])}, 6)" for r in m)) + " FROM i"


_MAG = "sqrt(ax * ax + ay * ay + az * az)"
_PAIRS = f"""{_R}, p AS (SELECT * FROM r WHERE event_type = 'purchase'), s AS (SELECT * FROM r WHERE event_type = 'view'),
    m AS (SELECT p.sensor_id, p.seq, p.value, s.seq AS secondary_seq, s.value AS other, abs(p.timestamp_ns - s.timestamp_ns) AS time_diff, row_number() OVER (PARTITION BY p.seq ORDER BY abs(p.timestamp_ns - s.timestamp_ns), s.seq) AS k
          FROM p JOIN s ON s.timestamp_ns BETWEEN p.timestamp_ns - {{tol}} AND p.timestamp_ns + {{tol}}{{key}})"""
_NEAR = _PAIRS.format(tol=TOLERANCE_NS, key="")
_LAT = f"{_R}, l AS (SELECT *, round(value * 1000)::BIGINT AS latency_ns FROM r)"
_STAGES = f"{_LAT}, st AS (SELECT event_type AS name, ['output', 'output', 'filtered', 'dropped', 'error'][1 + seq % 5] AS outcome, latency_ns, timestamp_ns, seq FROM l)"
_QUEUE = "CASE event_type WHEN 'view' THEN 'send' WHEN 'click' THEN 'send' WHEN 'error' THEN 'drop' ELSE 'recv' END AS kind"
_STEP = "CASE kind WHEN 'send' THEN 1 WHEN 'recv' THEN -1 ELSE 0 END"


def _count(o: str, name: str) -> str:
    return f"count(*) FILTER (outcome = '{o}') AS {name}_count"


def _product() -> str:
    """Rotation about x, then about z, one after the other."""
    cz, sz, cx, sx = (_d(f(a)) for a in (EULER[0], EULER[2]) for f in (math.cos, math.sin))
    turned = f"SELECT seq, ax, ay, az, ax AS x1, {cx} * ay - {sx} * az AS y1, {sx} * ay + {cx} * az AS z1 FROM i"
    there = [("x", f"{cz} * x1 - {sz} * y1"), ("y", f"{sz} * x1 + {cz} * y1"), ("z", "z1")]
    cols = [f"round({e}, 6) AS {name}_{c}" for name in ("there", "by_row") for c, e in there] + [f"round(a{c}, 6) AS back_{c}" for c in "xyz"]
    return f"WITH {_I}, t AS ({turned}) SELECT seq, {', '.join(cols)} FROM t"


def _controller(key: str, high: float, low: float, hysteresis: int) -> str:
    return f"""WITH RECURSIVE {_R}, u AS (SELECT {key} AS key, seq, row_number() OVER (PARTITION BY {key} ORDER BY seq) AS n, CASE WHEN value / 100 > {_d(high)} THEN 1 WHEN value / 100 < {_d(low)} THEN -1 ELSE 0 END AS d FROM r),
        f AS (SELECT key, seq, n, 0 AS level, CASE WHEN d <> 0 THEN 1 ELSE 0 END AS c, 0 AS used, true AS accepted FROM u WHERE n = 1
              UNION ALL SELECT key, seq, n, level, CASE WHEN d = 0 OR level <> before THEN 0 ELSE c + 1 END, CASE WHEN level > 0 THEN used + 1 ELSE used END, level = 0 OR used % (1 << level) = 0
              FROM (SELECT u.key, u.seq, u.n, u.d, p.c, p.used, p.level AS before, CASE WHEN u.d <> 0 AND p.c >= {hysteresis} AND p.level + u.d BETWEEN 0 AND 4 THEN p.level + u.d ELSE p.level END AS level FROM f AS p JOIN u ON u.key = p.key AND u.n = p.n + 1))
        SELECT key AS {key}, seq, level AS quality, accepted FROM f"""


#: A token is 10^14 units, of which a nanosecond brings one.
_UNIT = 10**14
_BUCKET_BY_TYPE = f"""WITH RECURSIVE {_R}, n AS (SELECT event_type, seq, row_number() OVER (PARTITION BY event_type ORDER BY seq) AS n, coalesce(max(timestamp_ns) OVER (PARTITION BY event_type ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), timestamp_ns) AS before, timestamp_ns AS t FROM r),
        f AS (SELECT event_type, seq, n, {3 * _UNIT}::BIGINT AS had FROM n WHERE n = 1
              UNION ALL SELECT n.event_type, n.seq, n.n, least({3 * _UNIT}, CASE WHEN p.had >= {_UNIT} THEN p.had - {_UNIT} ELSE p.had END + greatest(n.t - n.before, 0)) FROM f AS p JOIN n ON n.event_type = p.event_type AND n.n = p.n + 1)
        SELECT event_type, seq, had >= {_UNIT} AS accepted, round(CASE WHEN had >= {_UNIT} THEN had - {_UNIT} ELSE had END / {_UNIT}::DOUBLE, 6) AS tokens FROM f"""

_SHARES = (("p50_ns", 0.5), ("p95_ns", 0.95), ("p99_ns", 0.99), ("p999_ns", 0.999))
_DISC = ", ".join(f"quantile_disc(latency_ns, {q}) AS {c}" for c, q in _SHARES)
_STATES = f"""WITH {_LAT}, b AS (SELECT event_type, least((length(ltrim(bin(greatest(latency_ns, 1)), '0')) - 1) * 10 // 3, 63)::INTEGER AS bucket, count(*) AS n FROM l GROUP BY ALL),
    t AS (SELECT event_type, bucket, sum(n) OVER (PARTITION BY event_type ORDER BY bucket) AS through, sum(n) OVER (PARTITION BY event_type) AS total FROM b),
    p AS (SELECT event_type, {", ".join(f"1::BIGINT << ((min(bucket) FILTER (through >= ceil(total * {q}))) * 3 // 10) AS {c}" for c, q in _SHARES)} FROM t GROUP BY event_type),
    m AS (SELECT event_type, count(*) AS count, min(latency_ns)::DOUBLE AS least, max(latency_ns)::DOUBLE AS most, round(avg(latency_ns), 3) AS mean, round(stddev_samp(latency_ns), 3) AS std_dev FROM l GROUP BY event_type)
    SELECT m.*, {", ".join(c for c, _ in _SHARES)} FROM m JOIN p USING (event_type)"""

#: Latency, jitter and counts of one stage or of the whole, as the exports tell them.
_TOLD = f"sum(latency_ns)::DOUBLE / count(latency_ns) AS mean_ns, {_DISC}, stddev_samp(latency_ns) AS std_dev_ns"
_WHOLE = f"w AS (SELECT count(*) AS i, count(latency_ns) AS o, (max(timestamp_ns) - min(timestamp_ns)) / 1e9::DOUBLE AS secs, {_TOLD} FROM (SELECT timestamp_ns, CASE WHEN outcome = 'output' THEN latency_ns END AS latency_ns FROM st))"


def _json() -> str:
    latency = "'\"count\": ' || o || ', \"mean_ns\": ' || format('{:.2f}', mean_ns)" + "".join(f" || ', \"{c}\": ' || {c}" for c, _ in _SHARES)
    counts = "".join(f" || ', \"{c}_count\": ' || {c}_count" for c in ("input", "output", "filtered", "dropped", "error"))
    stage = f"'{{\"name\": \"' || name || '\"'{counts} || ', \"throughput_ratio\": ' || format('{{:.4f}}', output_count / input_count) || ', \"latency\": {{\"mean_ns\": ' || format('{{:.2f}}', mean_ns) || ', \"p99_ns\": ' || p99_ns || '}}, \"jitter\": {{\"std_dev_ns\": ' || format('{{:.2f}}', std_dev_ns) || '}}}}'"
    return f"""WITH {_STAGES}, {_WHOLE}, c AS (SELECT name, count(*) AS input_count, {_count("output", "output")}, {_count("filtered", "filtered")}, {_count("dropped", "dropped")}, {_count("error", "error")}, {_TOLD} FROM st GROUP BY name)
        SELECT '{{"throughput": ' || format('{{:.2f}}', o / secs) || ', "total_input": ' || i || ', "total_output": ' || o || ', "drop_rate": ' || format('{{:.4f}}', 1 - o / i) || ', "elapsed_secs": ' || format('{{:.3f}}', secs)
        || ', "end_to_end_latency": {{' || {latency} || '}}, "end_to_end_jitter": {{"count": ' || o || ', "mean_ns": ' || format('{{:.2f}}', mean_ns) || ', "std_dev_ns": ' || format('{{:.2f}}', std_dev_ns)
        || '}}, "stages": [' || (SELECT string_agg({stage}, ', ' ORDER BY name) FROM c) || ']}}' AS json FROM w"""


_BURSTS = f"WITH {_R}, b AS (SELECT *, lead(timestamp_ns) OVER (PARTITION BY sensor_id ORDER BY timestamp_ns, seq) AS next FROM r) SELECT sensor_id, timestamp_ns + {IDLE_NS} AS at_ns, 'tick' AS cause, seq AS last_seq, value FROM b WHERE next IS NULL OR next > timestamp_ns + {IDLE_NS}"


ORACLES: dict[str, str] = {
    "flagship_status": f"WITH {_R} {_status('sensor_id')}",
    "flagship_status_global": f"WITH {_R} {_status('')}",
    "map_filter_chain": f"WITH {_R} SELECT seq, value * 2 + 1 AS value FROM r WHERE value * 2 > 50",
    "filter_map": f"WITH {_R} SELECT seq, value * 2 AS value FROM r WHERE value > 100",
    "four_stage": f"WITH {_R} SELECT sensor_id, seq, status, mean FROM ({_status('sensor_id', 'WHERE value BETWEEN 0 AND 1000')}) WHERE status <> 'NORMAL'",
    "payload_map": f"WITH {_R} SELECT timestamp_ns, seq, value + 0.5::DOUBLE AS data FROM r",
    "moving_average_10": f"WITH {_R} SELECT sensor_id, seq, value, avg(value) OVER (PARTITION BY sensor_id ORDER BY seq ROWS 9 PRECEDING) AS average FROM r",
    "moving_average_global": f"WITH {_R} SELECT seq, value, avg(value) OVER (ORDER BY seq ROWS 9 PRECEDING) AS average FROM r",
    "median_5": f"WITH {_R}, w AS (SELECT sensor_id, seq, value, list_sort(list(value) OVER (PARTITION BY sensor_id ORDER BY seq ROWS 4 PRECEDING)) AS l FROM r) SELECT sensor_id, seq, value, l[len(l) // 2 + 1] AS median FROM w",
    "ema": _ema(ALPHA, "ema"),
    "ema_time_constant": _ema(0.1 / 1.1, "ema"),
    "low_pass": _ema(_DT / (_RC + _DT), "low"),
    "high_pass": _recursive("n.value AS y", f"{_d(_HP)} * (p.y + n.value - p.value)", "", "value, y AS high"),
    "kalman": _kalman(),
    # Older readings than 300 weigh under 1e-29.
    "ema_global": f"""WITH {_R}, n AS (SELECT seq, value, row_number() OVER (ORDER BY seq) AS n FROM r), w AS (SELECT seq, value, n, list(value * CASE WHEN n = 1 THEN 1 ELSE {_d(ALPHA)} END) OVER (ORDER BY seq ROWS 300 PRECEDING) AS l FROM n)
        SELECT seq, value, round(list_sum(list_transform(l, lambda x, i: x * pow({_d(1 - ALPHA)}, len(l) - i))), 4) AS ema FROM w""",
    "imu_magnitude": f"WITH {_I} SELECT seq, {_MAG} AS accel_magnitude, gx * gx + gy * gy + gz * gz AS gyro_squared, ax * gx + ay * gy + az * gz AS dot FROM i",
    "imu_vector_ops": f"WITH {_I} SELECT seq, {_vec('sum', 'ax + gx', 'ay + gy', 'az + gz')}, {_vec('diff', 'ax - gx', 'ay - gy', 'az - gz')}, {_vec('scaled', *(f'{c} * 2.5::DOUBLE' for c in ('ax', 'ay', 'az')))}, "
    f"{_vec('cross', 'ay * gz - az * gy', 'az * gx - ax * gz', 'ax * gy - ay * gx')}, {_vec('unit', *(f'CASE WHEN {_MAG} > 1.1920929e-07 THEN {c} / {_MAG} ELSE 0 END' for c in ('ax', 'ay', 'az')))} FROM i",
    "imu_ned_to_enu": f"WITH {_I} SELECT seq, {_vec('accel', 'ay', 'ax', '-az')}, {_vec('gyro', 'gy', 'gx', '-gz')} FROM i",
    "imu_units": f"WITH {_I} SELECT seq, {_vec('accel', *(f'{c} * {_d(9.80665)}' for c in ('ax', 'ay', 'az')))}, {_vec('gyro', *(f'round(radians({c}), 6)' for c in ('gx', 'gy', 'gz')))} FROM i",
    "imu_calibrated": f"WITH {_I} SELECT seq, {_vec('accel', f'(ax - {_d(0.1)}) * 1', f'(ay - {_d(0.2)}) * 2', f'(az - {_d(0.3)}) * {_d(0.5)}')}, {_vec('gyro', *(f'{c} - {_d(0.01)}' for c in ('gx', 'gy', 'gz')))} FROM i",
    "rotate_zyx": _rotated(),
    "calibration_bias": f"WITH {_I} SELECT seq % 8 AS sensor_id, {_vec('bias', *(f'sum(round({c} * 10000)::BIGINT)::DOUBLE / count(*)' for c in ('ax', 'ay', 'az')))} FROM i GROUP BY seq % 8",
    "smoothed_magnitude": f"WITH {_I} SELECT seq, {_MAG} AS raw, avg({_MAG}) OVER (ORDER BY seq ROWS 9 PRECEDING) AS smoothed FROM i",
    "lidar_cartesian": f"""SELECT seq, i, round(r * cos(i * {_d(2 * math.pi / 64)}), 6) AS flat_x, round(r * sin(i * {_d(2 * math.pi / 64)}), 6) AS flat_y, round(r * cos(0.25::DOUBLE) * cos(i * 0.1::DOUBLE), 6) AS solid_x,
        round(r * cos(0.25::DOUBLE) * sin(i * 0.1::DOUBLE), 6) AS solid_y, round(r * sin(0.25::DOUBLE), 6) AS solid_z
        FROM (SELECT vec_id AS seq, unnest(generate_series(0, len(embedding) - 1))::INTEGER AS i, unnest(embedding)::DOUBLE AS r FROM embeddings)""",
    "lidar_valid_count": "SELECT vec_id AS seq, len(list_filter(embedding, lambda x: x > 0 AND isfinite(x)))::BIGINT AS valid, len(embedding)::BIGINT AS points, 2.5::DOUBLE AS angle_5 FROM embeddings",
    "seq_gaps": f"WITH {_R} SELECT sensor_id, seq, coalesce(greatest(seq - lag(seq) OVER (PARTITION BY sensor_id ORDER BY seq) - 1, 0), 0) AS dropped FROM r",
    "monotonic_clock": f"WITH {_R}, c AS (SELECT sensor_id, seq AS event, timestamp_ns - seq % 7 * 1000000000000 AS raw_ns FROM r) SELECT sensor_id, event, raw_ns, max(raw_ns) OVER w AS timestamp_ns, row_number() OVER w - 1 AS seq FROM c WINDOW w AS (PARTITION BY sensor_id ORDER BY event ROWS UNBOUNDED PRECEDING)",
    "clock_functions": f"WITH {_R}, c AS (SELECT seq, timestamp_ns AS t, timestamp_ns + (seq % 11 - 5) * 1000 AS o FROM r) SELECT seq, CASE WHEN t >= o THEN t - o END AS since, CASE WHEN o >= t THEN o - t END AS diff, greatest(seq - 100, 0) AS dropped, abs(t - o) <= 2000 AS near FROM c",
    "asof_nearest": f"WITH {_NEAR} SELECT seq, secondary_seq, time_diff FROM m WHERE k = 1",
    "asof_nearest_keyed": f"WITH {_PAIRS.format(tol=100 * TOLERANCE_NS, key=' AND s.sensor_id = p.sensor_id')} SELECT p.sensor_id, p.seq, secondary_seq, time_diff FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) AS b USING (seq)",
    "asof_unmatched": f"WITH {_NEAR} SELECT seq FROM p WHERE seq NOT IN (SELECT seq FROM m)",
    "asof_arrival": f"""WITH RECURSIVE {_R}, e AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY seq) AS n FROM r WHERE event_type IN ('purchase', 'view')),
        f AS (SELECT sensor_id, seq, n, event_type, CASE WHEN event_type = 'view' THEN [{{'t': timestamp_ns, 's': seq}}] ELSE [] END AS ring, NULL::BIGINT AS d, NULL::BIGINT AS s FROM e WHERE n = 1
              UNION ALL SELECT sensor_id, seq, n, event_type, CASE WHEN event_type = 'view' THEN list_append(ring, {{'t': t, 's': seq}})[-4:] WHEN hit IS NULL THEN ring ELSE list_filter(ring, lambda x: x.t >= t - {500 * TOLERANCE_NS}) END, hit.d, hit.s
              FROM (SELECT e.sensor_id, e.seq, e.n, e.event_type, e.timestamp_ns AS t, p.ring, CASE WHEN e.event_type = 'purchase' THEN
                    list_sort(list_transform(list_filter(p.ring, lambda x: abs(x.t - e.timestamp_ns) <= {500 * TOLERANCE_NS}), lambda x, i: {{'d': abs(x.t - e.timestamp_ns), 'i': i, 's': x.s}}))[1] END AS hit
                    FROM f AS p JOIN e ON e.sensor_id = p.sensor_id AND e.n = p.n + 1))
        SELECT sensor_id, seq, s AS secondary_seq, d AS time_diff FROM f WHERE event_type = 'purchase'""",
    "weighted_fusion": f"WITH {_NEAR} SELECT seq, value * 0.75::DOUBLE + other * 0.25::DOUBLE AS fused, value * 0.5::DOUBLE + other * 0.5::DOUBLE AS mean FROM m WHERE k = 1",
    "sample_every_4": f"WITH {_R} SELECT seq, value FROM (SELECT seq, value, row_number() OVER (ORDER BY seq) AS n FROM r) WHERE (n - 1) % 4 = 0",
    "drop_newest": f"WITH {_N} SELECT sensor_id, seq FROM n WHERE n <= 15",
    "drop_oldest": f"WITH {_R} SELECT sensor_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY seq DESC) AS k FROM r) WHERE k <= 15",
    "token_bucket": f"""WITH RECURSIVE {_N},
        f AS (SELECT sensor_id, seq, n, timestamp_ns, 3::DOUBLE AS had FROM n WHERE n = 1
              UNION ALL SELECT n.sensor_id, n.seq, n.n, n.timestamp_ns, least(3::DOUBLE, CASE WHEN p.had >= 1 THEN p.had - 1 ELSE p.had END + (n.timestamp_ns - p.timestamp_ns) * {_d(0.00001)} / 1e9::DOUBLE) FROM f AS p JOIN n ON n.sensor_id = p.sensor_id AND n.n = p.n + 1)
        SELECT sensor_id, seq, had >= 1 AS accepted, round(CASE WHEN had >= 1 THEN had - 1 ELSE had END, 6) AS tokens FROM f""",
    "adaptive_controller": _controller("sensor_id", 0.4, 0.2, 2),
    "adaptive_controller_spread": _controller("event_type", 0.4, 0.2, 2),
    "admission_adaptive": f"SELECT sensor_id, count(*) AS kept, max(seq) AS last FROM ({_controller('sensor_id', 0.8, 0.5, 10)}) WHERE accepted GROUP BY sensor_id",
    "admission_stats": f"""WITH {_R}, c AS (SELECT sensor_id, count(*) FILTER (event_type IN ('view', 'click')) AS accepted, count(*) FILTER (event_type = 'error') AS dropped, count(*) FILTER (event_type = 'signup') AS blocked, count(*) FILTER (event_type = 'purchase') AS sampled_out FROM r GROUP BY sensor_id)
        SELECT *, accepted + dropped + sampled_out AS total, coalesce((dropped + sampled_out) / nullif(accepted + dropped + sampled_out, 0), 0) AS drop_rate, coalesce(accepted / nullif(accepted + dropped + sampled_out, 0), 1) AS acceptance_rate FROM c""",
    "latency_percentiles": f"WITH {_LAT} SELECT event_type, count(*) AS count, sum(latency_ns)::DOUBLE / count(*) AS mean_ns, min(latency_ns) AS min_ns, max(latency_ns) AS max_ns, " + ", ".join(f"quantile_disc(latency_ns, {q}) AS {c}" for c, q in (("p50_ns", 0.5), ("p95_ns", 0.95), ("p99_ns", 0.99), ("p999_ns", 0.999))) + " FROM l GROUP BY event_type",
    "latency_buckets": f"WITH {_LAT}, b AS (SELECT least((length(ltrim(bin(greatest(latency_ns, 1)), '0')) - 1) * 10 // 3, 63)::INTEGER AS bucket FROM l) SELECT bucket, count(*) AS count, (1::BIGINT << (bucket * 3 // 10)) AS reported_ns FROM b GROUP BY bucket",
    "jitter": f"""WITH {_R}, t AS (SELECT sensor_id, seq, timestamp_ns // 1000000 AS ms FROM r), d AS (SELECT sensor_id, ms - lag(ms) OVER (PARTITION BY sensor_id ORDER BY seq) AS x FROM t)
        SELECT sensor_id, count(x) AS count, round(coalesce(avg(x), 0), 3) AS mean, round(coalesce(stddev_samp(x), 0), 3) AS std_dev, min(x) AS least, max(x) AS most, max(x) - min(x) AS range, round(CASE WHEN coalesce(avg(x), 0) <> 0 THEN coalesce(stddev_samp(x), 0) / avg(x) ELSE 0 END, 6) AS variation FROM d GROUP BY sensor_id""",
    "stage_counters": f"""WITH {_R}, c AS (SELECT sensor_id, count(*) FILTER (event_type = 'view') AS received, count(*) FILTER (event_type = 'click') AS processed, count(*) FILTER (event_type = 'signup') AS filtered, count(*) FILTER (event_type = 'purchase') AS dropped, count(*) FILTER (event_type = 'error') AS errors FROM r GROUP BY sensor_id)
        SELECT *, coalesce(dropped / nullif(received, 0), 0) AS drop_rate, coalesce(filtered / nullif(processed, 0), 0) AS filter_rate, coalesce(errors / nullif(received, 0), 0) AS error_rate FROM c""",
    "event_rate": f"WITH {_R}, c AS (SELECT sensor_id, count(*) AS count, (max(timestamp_ns) - min(timestamp_ns)) / 1e9::DOUBLE AS elapsed_secs FROM r GROUP BY sensor_id) SELECT *, CASE WHEN elapsed_secs > 0 THEN count / elapsed_secs ELSE 0 END AS rate FROM c",
    "target_check": f"""WITH {_LAT}, c AS (SELECT event_type, count(*)::DOUBLE AS throughput, quantile_disc(latency_ns, 0.99) AS p99_ns, round(stddev_samp(latency_ns)) AS std_dev_ns FROM l GROUP BY event_type),
        k AS (SELECT *, throughput >= 1000 AS throughput_ok, p99_ns / 1000 <= 200 AS latency_ok, std_dev_ns / 1e6 <= 0.05 AS jitter_ok FROM c) SELECT *, throughput_ok AND latency_ok AND jitter_ok AS all_ok FROM k""",
    "queue_depth": f"WITH {_R}, q AS (SELECT seq, {_QUEUE} FROM r) SELECT seq, kind, (sum({_STEP}) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING))::BIGINT AS depth FROM q",
    "queue_metrics": f"""WITH {_R}, q AS (SELECT sensor_id, seq, {_QUEUE} FROM r), d AS (SELECT *, (sum({_STEP}) OVER (PARTITION BY sensor_id ORDER BY seq ROWS UNBOUNDED PRECEDING))::BIGINT AS depth FROM q),
        c AS (SELECT sensor_id, count(*) FILTER (kind = 'send') AS sent, count(*) FILTER (kind = 'recv') AS received, count(*) FILTER (kind = 'drop') AS dropped, greatest(max(depth), 0) AS max_depth FROM d GROUP BY sensor_id)
        SELECT *, sent - received AS depth, (sent - received) * 100::DOUBLE / 10 AS utilization, (sent - received) * 100::DOUBLE / 10 >= 80 AS pressure, coalesce(dropped * 100::DOUBLE / nullif(sent, 0), 0) AS drop_rate FROM c""",
    "stage_metrics": f"""WITH {_STAGES}, c AS (SELECT name, count(*) AS input_count, {_count("output", "output")}, {_count("filtered", "filtered")}, {_count("dropped", "dropped")}, {_count("error", "error")}, count(*) * 8 AS bytes_processed, sum(latency_ns)::BIGINT AS total_ns,
        (max(timestamp_ns) - min(timestamp_ns)) / 1e9::DOUBLE AS elapsed_secs, sum(latency_ns)::DOUBLE / count(*) AS mean_ns, min(latency_ns) AS min_ns, max(latency_ns) AS max_ns, {_DISC}, max(latency_ns) - min(latency_ns) AS range_ns, round(stddev_samp(latency_ns), 3) AS std_dev_ns FROM st GROUP BY name)
        SELECT *, output_count / input_count AS throughput_ratio, filtered_count / input_count AS filter_rate, dropped_count / input_count AS drop_rate, total_ns / input_count AS avg_processing_ns, output_count / elapsed_secs AS throughput, bytes_processed / elapsed_secs AS bytes_per_sec FROM c""",
    "snapshot_csv": f"""WITH {_STAGES}, {_WHOLE}, c AS (SELECT name AS stage, count(*) AS input_count, {_count("output", "output")}, {_count("filtered", "filtered")}, {_count("dropped", "dropped")}, {_count("error", "error")}, {_TOLD} FROM st GROUP BY name
        UNION ALL SELECT '_pipeline', i, o, 0, i - o, 0, mean_ns, {", ".join(c for c, _ in _SHARES)}, std_dev_ns FROM w)
        SELECT format('{{:.3f}}', (SELECT secs FROM w)) AS timestamp, stage, input_count, output_count, filtered_count::BIGINT AS filtered_count, dropped_count, error_count::BIGINT AS error_count, format('{{:.4f}}', output_count / input_count) AS throughput_ratio, format('{{:.2f}}', mean_ns) AS mean_latency_ns,
        p99_ns AS p99_latency_ns, format('{{:.2f}}', std_dev_ns) AS jitter_ns FROM c""",
    "snapshot_json": _json(),
    "snapshot_summary": f"""WITH {_LAT}, c AS (SELECT count(*)::DOUBLE AS throughput, max(latency_ns) AS p99, min(latency_ns)::DOUBLE AS jit, count(*) AS i, count(*) FILTER (seq % 2 = 0) AS o FROM l GROUP BY event_type)
        SELECT count(*) AS snapshots, avg(throughput) AS avg_throughput, min(throughput) AS min_throughput, max(throughput) AS max_throughput, avg(p99) AS avg_p99_ns, max(p99)::DOUBLE AS max_p99_ns, avg(jit) AS avg_jitter_ns, max(jit) AS max_jitter_ns, sum(i)::BIGINT AS total_input, sum(o)::BIGINT AS total_output, 1 - sum(o)::DOUBLE / sum(i) AS overall_drop_rate FROM c""",
    "recorder": f"WITH {_R} SELECT sensor_id, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY seq DESC) AS k FROM r) WHERE k <= 3",
    "token_latency": f"WITH {_R} SELECT seq, timestamp_ns, CASE WHEN event_type <> 'view' THEN seq END AS latency_ns FROM r",
    "stage_counts": f"WITH {_R}, c AS (SELECT count(*) AS a, count(*) FILTER (value > 0) AS b, count(*) FILTER (value > 0 AND value * 2 < 60) AS c FROM r) "
    "SELECT 0 AS stage, 'filter' AS name, a AS input_count, b AS output_count, a - b AS filtered_count FROM c UNION ALL SELECT 1, 'map', b, b, 0 FROM c UNION ALL SELECT 2, 'filter', b, c, b - c FROM c",
    "rotation_product": _product(),
    "scan_geometry": f"SELECT vec_id AS seq, 0.0::DOUBLE AS angle_min, round({_d(2 * math.pi)}, 6) AS angle_max, round({_d(2 * math.pi / 64)}, 6) AS angle_increment, 0.05::DOUBLE AS range_min, 100.0::DOUBLE AS range_max FROM embeddings",
    "scaled_unbiased": f"WITH {_R} SELECT seq, value * 2.5::DOUBLE AS value, value * 2.5::DOUBLE - 0.75::DOUBLE AS unbiased FROM r",
    "imu_six_axes": f"WITH {_I} SELECT seq, ax AS accel_x, ay AS accel_y, az AS accel_z, gx AS gyro_x, gy AS gyro_y, gz AS gyro_z, 2::BIGINT AS parts, 0.0::DOUBLE AS zero FROM i",
    "fused_pairs": f"WITH {_NEAR} SELECT m.seq, m.value - other AS fused, abs(time_diff) AS time_diff_ns, r.timestamp_ns FROM m JOIN r ON r.seq = m.seq WHERE k = 1",
    "admission_strategies": f"WITH {_N}, c AS (SELECT *, count(*) OVER (PARTITION BY sensor_id) AS total FROM n), "
    "k AS (SELECT 'block' AS strategy, * FROM c UNION ALL SELECT 'sample', * FROM c WHERE (n - 1) % 3 = 0 UNION ALL SELECT 'drop_newest', * FROM c WHERE n <= 5 UNION ALL SELECT 'drop_oldest', * FROM c WHERE n > total - 5) "
    "SELECT sensor_id, count(*) AS kept, min(seq) AS first, max(seq) AS last, strategy FROM k GROUP BY sensor_id, strategy",
    "sequence_source": "SELECT i * 10000000 AS timestamp_ns, i AS seq, least(i + 1, 5)::INTEGER AS data, 'hold' AS mode FROM range(20) AS t(i) UNION ALL SELECT i * 10000000, i, (i % 3 + 1)::INTEGER, 'repeat' FROM range(20) AS t(i)",
    "sensor_generators": "SELECT 'demo' AS source, i AS seq, round(50 + 30 * sin(i * 0.1::DOUBLE), 6) AS value FROM range(1000) AS t(i) UNION ALL SELECT 'barometer', i, round(101325 + 100 * sin(i * 0.1::DOUBLE), 6) FROM range(1000) AS t(i)",
    "token_bucket_spread": _BUCKET_BY_TYPE,
    "hot_types_status": f"WITH {_R} {_status('event_type')}",
    "median_101": f"WITH {_R}, w AS (SELECT event_type, seq, value, list_sort(list(value) OVER (PARTITION BY event_type ORDER BY seq ROWS 100 PRECEDING)) AS l FROM r) SELECT event_type, seq, value, l[len(l) // 2 + 1] AS median FROM w",
    "latency_percentiles_global": f"WITH {_LAT} SELECT count(*) AS count, sum(latency_ns)::DOUBLE / count(*) AS mean_ns, min(latency_ns) AS min_ns, max(latency_ns) AS max_ns, {_DISC} FROM l",
    "latency_states": _STATES,
    "dead_letters": f"""WITH {_R}, k AS (SELECT seq, value, CASE WHEN event_type = 'error' THEN 'InvalidData' WHEN value < 5 THEN 'ReadFailed' END AS kind FROM r)
        SELECT seq, CASE WHEN kind IS NULL THEN value / 2 END AS half, kind, CASE kind WHEN 'InvalidData' THEN 'an error event' WHEN 'ReadFailed' THEN 'too small' END AS message, CASE kind WHEN 'InvalidData' THEN 'check' WHEN 'ReadFailed' THEN 'half' END AS stage FROM k""",
    "stream_asof_nearest": f"WITH {_NEAR} SELECT seq, secondary_seq, time_diff FROM m WHERE k = 1",
    "stream_debounce": _BURSTS,
    "debounce": _BURSTS,
    "stream_ema": _ema(ALPHA, "ema"),
    "windowed_counts": f"""WITH {_R}, w AS (SELECT event_type, value, (timestamp_ns // 1000 // 43200000000 - k) * 43200000000 AS start_us FROM r, (VALUES (0), (1)) AS t(k))
        SELECT event_type, start_us, start_us + 86400000000 AS end_us, count(*) AS n, max(value) AS most FROM w GROUP BY event_type, start_us""",
    "session_counts": f"""WITH {_R}, t AS (SELECT sensor_id, value, timestamp_ns // 1000 AS us FROM r), g AS (SELECT *, coalesce(us - lag(us) OVER o > 86400000000, true)::INTEGER AS new FROM t WINDOW o AS (PARTITION BY sensor_id ORDER BY us)),
        s AS (SELECT *, sum(new) OVER (PARTITION BY sensor_id ORDER BY us) AS k FROM g) SELECT sensor_id, min(us) AS start_us, max(us) + 86400000000 AS end_us, count(*) AS n, min(value) AS least FROM s GROUP BY sensor_id, k""",
    "snapshot_text": f"WITH {_STAGES}, {_WHOLE} SELECT printf('in %d, out %d, dropped %.2f%%, %.1f items/s, p99 %.1f us, jitter %.3f ms', i, o, (1 - o / i) * 100, o / secs, p99_ns / 1000, std_dev_ns / 1e6) AS text FROM w",
    "inspected_rows": f"WITH {_R} SELECT 'before' AS place, count(*) FILTER (value < 50) AS passed, count(*) AS rows, min(seq) AS first, max(value) AS most FROM r UNION ALL SELECT 'after', count(*), count(*), min(seq), max(value) FROM r WHERE value < 50",
    "callback_counts": f"WITH {_R} SELECT event_type, count(*) AS n, max(value) AS most FROM r GROUP BY event_type",
    "quarantined": "SELECT event_id AS seq, value, coalesce(NOT isnan(value) AND value BETWEEN 20 AND 60, false) AS good FROM events",
    "stage_latencies": f"""WITH {_LAT}, s AS (SELECT 0 AS stage, 'filter' AS name, latency_ns FROM l WHERE value > 0 UNION ALL SELECT 1, 'map', latency_ns FROM l WHERE value > 0 UNION ALL SELECT 2, 'filter', latency_ns FROM l WHERE value > 0 AND value * 2 < 60),
        b AS (SELECT stage, least((length(ltrim(bin(greatest(latency_ns, 1)), '0')) - 1) * 10 // 3, 63)::INTEGER AS bucket, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT stage, bucket, sum(n) OVER (PARTITION BY stage ORDER BY bucket) AS through, sum(n) OVER (PARTITION BY stage) AS total FROM b),
        p AS (SELECT stage, {", ".join(f"1::BIGINT << ((min(bucket) FILTER (through >= ceil(total * {q}))) * 3 // 10) AS {c}" for c, q in _SHARES)} FROM t GROUP BY stage),
        m AS (SELECT stage, name, count(*) AS output_count, sum(latency_ns)::BIGINT AS total_ns, min(latency_ns) AS min_ns, max(latency_ns) AS max_ns, round(stddev_samp(latency_ns), 3) AS std_dev_ns FROM s GROUP BY stage, name),
        i AS (SELECT *, CASE stage WHEN 0 THEN (SELECT count(*) FROM l) ELSE lag(output_count) OVER (ORDER BY stage) END AS input_count FROM m)
        SELECT i.*, output_count / input_count AS throughput_ratio, (input_count - output_count) / input_count AS filter_rate, {", ".join(c for c, _ in _SHARES)} FROM i JOIN p USING (stage)""",
}
