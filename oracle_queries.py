"""Plain SQL for the queries of the catalog, written independently: windows and brute-force joins.

Each statement runs on the given tables alone. Times are whole microseconds inside the statements.
"""

from __future__ import annotations

HOUR = 3_600_000_000
START, END = 1_704_067_200_000_000, 1_706_659_200_000_000  # 2024-01-01 and 2024-01-31
# The recorded containers of the three brokers.
BROKER_PATHS = (
    "/docker/eb89133e6713d59534cad8060c0dc1a504aa615100a1b9890972f544ee45954a",
    "/docker/b28a2bfc13fcebda950895c9b5d805fa79405c081cbcb374d0adee1bbfc3b4e4",
    "/docker/11c2aba204cab1a5d0db3318092c490977a827b15436101e0edfd541875584ef",
)

# --- inputs -------------------------------------------------------------------------------------

RECORDS = """rec AS (SELECT 'key-' || event_id AS key, props AS value, 'events' AS topic,
  CAST(user_id % 12 AS INTEGER) AS partition, event_id AS "offset", ts AS timestamp FROM events)"""

BATCHES = """rng AS (SELECT event_id // 50 AS batch_no, CAST(user_id % 12 AS INTEGER) AS p, min(event_id) AS lo,
    max(event_id) AS hi, count(*) AS n, max(ts) AS mx FROM events GROUP BY 1, 2),
bat0 AS (SELECT batch_no, sum(n) AS n, max(mx) AS mx, list(p ORDER BY p) AS parts,
    string_agg(p || ':' || lo || ':' || hi || ':' || n, '|' ORDER BY p) AS ranges FROM rng GROUP BY 1),
bat AS (SELECT *, sha256('perf-group|events|' || n || '|' || ranges) AS id FROM bat0)"""

USER_LOG = """al AS (SELECT CAST(user_id AS VARCHAR) AS id, event_type IN ('click', 'view') AS is_read,
    'group-' || (user_id % 3) AS grp, 'events' AS topic, epoch_us(ts) AS t, event_id AS seq,
    event_id % 50 + 1 AS rc, [user_id % 12] AS parts,
    (user_id % 12) || ':' || event_id || ':' || (event_id + event_id % 50) || ':' || (event_id % 50 + 1) AS ranges
  FROM events WHERE event_type IN ('click', 'view', 'purchase'))"""

BATCH_LOG = BATCHES + f""",
plan AS (SELECT *, unnest([0, 1, 2, 8]) AS h FROM bat),
al AS (SELECT id, h < 2 AS is_read, 'perf-group' AS grp, 'events' AS topic, epoch_us(mx) + h * {HOUR} AS t, 0 AS seq,
    n AS rc, parts, ranges, batch_no
  FROM plan WHERE h = 0 OR (h = 1 AND batch_no % 5 = 2) OR (h = 2 AND batch_no % 7 <> 3 AND batch_no % 11 <> 4)
    OR (h = 8 AND batch_no % 7 <> 3 AND batch_no % 11 = 4))"""


def lifecycle(horizon: str = "9e18") -> str:
    """Outcomes ``oc`` (and annotated events ``g``) of the log ``al``: 6 h threshold, 1 h ticks."""
    return f"""a AS (SELECT *, ((t + {6 * HOUR}) // {HOUR} + 1) * {HOUR} AS tk, lead(t) OVER k AS nxt,
    count(*) FILTER (NOT is_read) OVER (PARTITION BY id ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ep
  FROM al WINDOW k AS (PARTITION BY id ORDER BY t, seq)),
f AS (SELECT *, is_read AND CASE WHEN nxt IS NULL THEN tk <= {horizon} ELSE tk < nxt END AS fired FROM a),
g AS (SELECT *, count(*) FILTER (is_read) OVER cur AS n, count(*) FILTER (fired) OVER bef AS tb,
    first_value(t) OVER cur AS ft, first_value(grp) OVER cur AS fgrp,
    last_value(CASE WHEN is_read THEN t END IGNORE NULLS) OVER bef AS pt,
    last_value(CASE WHEN is_read THEN rc END IGNORE NULLS) OVER bef AS prc,
    last_value(CASE WHEN is_read THEN ranges END IGNORE NULLS) OVER bef AS pranges,
    last_value(CASE WHEN is_read THEN parts END IGNORE NULLS) OVER bef AS pparts
  FROM f WINDOW cur AS (PARTITION BY id, ep ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    bef AS (PARTITION BY id, ep ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
oc AS (
  SELECT id, 'REPLAY_OBSERVED' AS outcome, fgrp AS grp, topic, ft, pt AS lt, t AS ot, prc AS rc, n - 1 AS rp, tb AS tm,
    pranges AS ranges, pparts AS parts FROM g WHERE is_read AND n > 1
  UNION ALL SELECT id, CASE WHEN tb > 0 THEN 'LATE_COMMIT' ELSE 'COMMITTED' END, fgrp, topic, ft, t, t, prc, n - 1, tb,
    pranges, pparts FROM g WHERE NOT is_read AND n >= 1
  UNION ALL SELECT id, 'ESTIMATED_FAILED', fgrp, topic, ft, t, tk, rc, n - 1, tb + 1, ranges, parts FROM g WHERE fired)"""


OUTCOME_ROWS = """SELECT id AS "eventId", outcome, grp AS "consumerGroup", topic AS "sourceTopic",
  make_timestamp(ft) AS "firstSeenAt", make_timestamp(lt) AS "lastSeenAt", make_timestamp(ot) AS "observedAt",
  CAST(rc AS INTEGER) AS "recordCount", CAST(rp AS INTEGER) AS "replayCount", CAST(tm AS INTEGER) AS "timeoutCount", ranges
FROM oc"""


def counters(at: str = "0") -> str:
    """Increments of every counter (``st``) with the time bucket each falls in."""
    return f"""ob AS (SELECT *, {at} AS bk FROM oc),
st AS (
  SELECT 'audit_outcomes_total' AS metric, outcome, grp, topic, NULL AS part, 1 AS inc, bk FROM ob
  UNION ALL SELECT 'audit_batches_seen_total', NULL, grp, topic, NULL, 1, bk FROM ob
  UNION ALL SELECT 'audit_replay_count_total', NULL, grp, topic, NULL, rp, bk FROM ob WHERE rp > 0
  UNION ALL SELECT 'audit_timeout_count_total', NULL, grp, topic, NULL, tm, bk FROM ob WHERE tm > 0
  UNION ALL SELECT 'audit_replay_events_total', NULL, grp, topic, NULL, 1, bk FROM ob WHERE outcome = 'REPLAY_OBSERVED'
  UNION ALL SELECT 'audit_timeout_events_total', NULL, grp, topic, NULL, 1, bk FROM ob WHERE outcome = 'ESTIMATED_FAILED'
  UNION ALL SELECT 'audit_partition_outcomes_total', outcome, grp, topic, CAST(unnest(parts) AS VARCHAR), 1, bk FROM ob)"""


COUNTER_KEY = """'{"consumer_group":"' || grp || '"' || coalesce(',"outcome":"' || outcome || '"', '')
  || coalesce(',"partition":"' || part || '"', '') || ',"source_topic":"' || topic || '"}'"""


def counter_series(step: int) -> str:
    """Running counters as samples ``cs``; the outcome stands in ``inst``."""
    return counters(f"(ot // {step} + 1) * {step}") + f""",
cs AS (SELECT metric, {COUNTER_KEY} AS key, coalesce(outcome, '') AS inst, '' AS cid, '' AS svc, '' AS cname, '' AS cpu, '' AS mode,
    bk AS t, CAST(sum(sum(inc)) OVER (PARTITION BY metric, outcome, grp, topic, part ORDER BY bk) AS DOUBLE) AS v
  FROM st GROUP BY metric, outcome, grp, topic, part, bk)"""


SAMPLES = f"""ev0 AS (SELECT *, epoch_us(ts) AS t, 'kafka-' || (user_id % 3 + 1) AS kn, user_id % 5 AS form, user_id % 2 = 0 AS even,
    CASE user_id % 3 WHEN 0 THEN '{BROKER_PATHS[0]}' WHEN 1 THEN '{BROKER_PATHS[1]}' ELSE '{BROKER_PATHS[2]}' END AS path,
    CAST(event_id % 4001 AS DOUBLE) AS climb FROM events),
ev1 AS (SELECT *, CASE WHEN form IN (0, 3) THEN path ELSE '/docker/other' END AS cid, CASE WHEN form IN (1, 3) THEN kn ELSE '' END AS svc,
    CASE WHEN form IN (2, 3) THEN kn WHEN form = 4 THEN 'postgres' ELSE '' END AS cname FROM ev0),
ev2 AS (SELECT *, '{{' || CASE WHEN svc <> '' THEN '"container_label_com_docker_compose_service":"' || svc || '",' ELSE '' END
    || '"id":"' || cid || '"' || CASE WHEN cname <> '' THEN ',"name":"' || cname || '"' ELSE '' END || '}}' AS ckey FROM ev1),
sm AS (
  SELECT CASE event_type WHEN 'click' THEN 'kafka_broker_bytes_in_total' WHEN 'view' THEN 'kafka_broker_bytes_out_total'
      WHEN 'purchase' THEN 'kafka_broker_messages_in_total' WHEN 'error' THEN 'container_cpu_usage_seconds_total'
      ELSE 'node_cpu_seconds_total' END AS metric,
    CASE event_type WHEN 'error' THEN ckey
      WHEN 'signup' THEN '{{"cpu":"' || (user_id % 4) || '","mode":"' || CASE WHEN even THEN 'idle' ELSE 'user' END || '"}}'
      ELSE '{{"broker_id":"' || (user_id % 3 + 1) || '","instance":"' || kn || '"}}' END AS key,
    kn AS inst, cid, svc, cname, CAST(user_id % 4 AS VARCHAR) AS cpu, CASE WHEN even THEN 'idle' ELSE 'user' END AS mode, t,
    CASE WHEN event_type IN ('click', 'view') THEN climb * 512 ELSE climb END AS v
  FROM ev2
  UNION ALL
  SELECT CASE event_type WHEN 'click' THEN 'kafka_consumergroup_lag'
      WHEN 'view' THEN CASE WHEN even THEN 'jvm_heap_used_bytes' ELSE 'jvm_non_heap_used_bytes' END
      WHEN 'purchase' THEN 'jvm_process_cpu_load_ratio' WHEN 'error' THEN 'container_memory_usage_bytes'
      ELSE CASE WHEN even THEN 'node_memory_MemAvailable_bytes' ELSE 'node_memory_MemTotal_bytes' END END,
    CASE event_type WHEN 'click' THEN '{{"partition":"' || (user_id % 12) || '"}}' WHEN 'error' THEN ckey
      WHEN 'signup' THEN '{{"instance":"host"}}' ELSE '{{"instance":"' || kn || '"}}' END,
    kn, cid, svc, cname, '', '', t,
    CASE event_type WHEN 'click' THEN value WHEN 'view' THEN value * 1048576 WHEN 'purchase' THEN value / 1024
      WHEN 'error' THEN value * 1048576 ELSE CASE WHEN even THEN value ELSE value + 1000 END END
  FROM ev2)"""

# Attributes that belong to a series have one value in it; the others are never read.
_LABELS = "metric, key, " + ", ".join(f"any_value({c}) AS {c}" for c in ("inst", "cid", "svc", "cname", "cpu", "mode"))


def increase(name: str, window: int, step: int, source: str = "sm", per_second: bool = False, end: int = END) -> str:
    """Every sample meets every grid point whose window holds it."""
    over = f" / {window / 1e6}" if per_second else ""
    return f"""{name}_p AS (SELECT *, lag(t) OVER s AS pt, lag(v) OVER s AS pv FROM {source}
    WINDOW s AS (PARTITION BY metric, key ORDER BY t)),
{name}_e AS (SELECT *, unnest(range({START} + (t - {START} + {step} - 1) // {step} * {step}, least(t + {window}, {end} + 1), {step})) AS g
  FROM {name}_p),
{name} AS (SELECT {_LABELS}, g,
    sum(CASE WHEN pt > g - {window} THEN CASE WHEN v < pv THEN v ELSE v - pv END ELSE 0 END){over} AS value
  FROM {name}_e GROUP BY metric, key, g)"""


def instant(name: str, window: int, step: int, source: str = "sm") -> str:
    return f"""{name}_e AS (SELECT *, unnest(range({START} + (t - {START} + {step} - 1) // {step} * {step}, least(t + {window}, {END} + 1), {step})) AS g
  FROM {source}),
{name} AS (SELECT {_LABELS}, g, arg_max(v, t) AS value FROM {name}_e GROUP BY metric, key, g)"""


def vector(source: str, *more: str, labels: str = "key") -> str:
    extra = "".join(f"{m}, " for m in more)
    return f"SELECT {extra}{labels} AS labels, make_timestamp(g) AS ts, round(value + 1e-9, 6) AS value FROM {source}"


# --- rules ------------------------------------------------------------------------------------------
# Over rt (rates), it (instant values): each gives labels, g, value.

def _sum(metric: str, source: str = "rt", unit: str = "", fn: str = "sum") -> str:
    return f"SELECT '{{}}' AS labels, g, {fn}(value){unit} AS value FROM {source} WHERE metric = '{metric}' GROUP BY g"


def _sum_by(metric: str, unit: str) -> str:
    return (f"SELECT '{{\"instance\":\"' || inst || '\"}}' AS labels, g, sum(value){unit} AS value FROM rt "
            f"WHERE metric = '{metric}' GROUP BY inst, g")


_IN, _OUT = "kafka_broker_bytes_in_total", "kafka_broker_bytes_out_total"
_ADDED = (f"(SELECT a.inst, a.key, a.g, a.value + b.value AS value FROM rt a JOIN rt b ON a.key = b.key AND a.g = b.g "
          f"AND a.metric = '{_IN}' AND b.metric = '{_OUT}')")


def _by_broker(metric: str, source: str, unit: str) -> str:
    ranked = " UNION ALL ".join(
        [f"SELECT key, g, value, {i} AS r, 'kafka-{i + 1}' AS broker FROM {source} WHERE metric = '{metric}' AND cid = '{p}'"
         for i, p in enumerate(BROKER_PATHS)]
        + [f"SELECT key, g, value, {3 + i}, {c} FROM {source} WHERE metric = '{metric}' AND regexp_full_match({c}, 'kafka-[0-9]+')"
           for i, c in enumerate(("svc", "cname"))])
    return (f"SELECT '{{\"broker\":\"' || broker || '\"}}' AS labels, g, sum(value){unit} AS value FROM "
            f"(SELECT key, broker, g, arg_min(value, r) AS value FROM ({ranked}) GROUP BY ALL) GROUP BY broker, g")


_CPU = _by_broker("container_cpu_usage_seconds_total", "rt", " * 100")
_CLUSTER_CPU = f"SELECT '{{}}' AS labels, g, sum(value) AS value FROM ({_CPU}) GROUP BY g"
_CORES = ("SELECT '{}' AS labels, g, CAST(count(DISTINCT cpu) AS DOUBLE) AS value FROM it "
          "WHERE metric = 'node_cpu_seconds_total' AND mode = 'idle' GROUP BY g")
_PATHS = ", ".join(f"'{p}'" for p in BROKER_PATHS)

RULES = {
    "kafka_broker_bytes_in_kb_per_sec": _sum_by(_IN, " / 1024"),
    "kafka_broker_bytes_out_kb_per_sec": _sum_by(_OUT, " / 1024"),
    "kafka_broker_throughput_kb_per_sec":
        f"SELECT '{{\"instance\":\"' || inst || '\"}}' AS labels, g, sum(value) / 1024 AS value FROM {_ADDED} GROUP BY inst, g",
    "kafka_cluster_bytes_in_kb_per_sec": _sum(_IN, unit=" / 1024"),
    "kafka_cluster_bytes_out_kb_per_sec": _sum(_OUT, unit=" / 1024"),
    "kafka_cluster_throughput_bytes_per_sec": f"SELECT '{{}}' AS labels, g, sum(value) AS value FROM {_ADDED} GROUP BY g",
    "kafka_cluster_messages_per_sec": _sum("kafka_broker_messages_in_total"),
    "kafka_cluster_consumer_lag_messages": _sum("kafka_consumergroup_lag", "it"),
    "kafka_broker_cpu_percent": _CPU,
    "kafka_cluster_cpu_percent": _CLUSTER_CPU,
    "kafka_cluster_cpu_cores": f"SELECT labels, g, value / 100 AS value FROM ({_CLUSTER_CPU})",
    "kafka_host_cpu_cores": _CORES,
    "kafka_cluster_cpu_host_percent":
        f"SELECT a.labels, a.g, a.value / b.value AS value FROM ({_CLUSTER_CPU}) a JOIN ({_CORES}) b ON a.g = b.g",
    "kafka_cluster_jvm_cpu_percent": _sum("jvm_process_cpu_load_ratio", "it", " * 100", "avg"),
    "kafka_broker_container_memory_mb": _by_broker("container_memory_usage_bytes", "it", " / 1048576"),
    "kafka_cluster_container_memory_gb":
        "SELECT '{}' AS labels, g, sum(value) / 1073741824 AS value FROM it WHERE metric = 'container_memory_usage_bytes' "
        f"AND (cid IN ({_PATHS}) OR regexp_full_match(svc, 'kafka-[0-9]+') OR regexp_full_match(cname, 'kafka-[0-9]+')) GROUP BY g",
    "jvm_heap_used_gb": _sum("jvm_heap_used_bytes", "it", " / 1073741824"),
    "jvm_non_heap_used_gb": _sum("jvm_non_heap_used_bytes", "it", " / 1073741824"),
    "host_cpu_busy_percent":
        "SELECT '{}' AS labels, g, 100 * (1 - avg(value)) AS value FROM rt WHERE metric = 'node_cpu_seconds_total' AND mode = 'idle' GROUP BY g",
    "host_memory_used_percent":
        "SELECT a.key AS labels, a.g, (1 - a.value / b.value) * 100 AS value FROM it a JOIN it b ON a.key = b.key AND a.g = b.g "
        "AND a.metric = 'node_memory_MemAvailable_bytes' AND b.metric = 'node_memory_MemTotal_bytes'",
}
_W = 6 * HOUR
EVALUATED = f"{SAMPLES}, {increase('rt', _W, HOUR, per_second=True)}, {instant('it', _W, HOUR)}"


def named(plans: dict[str, str], base: str, column: str = "query") -> str:
    parts = " UNION ALL ".join(f"SELECT '{n}' AS {column}, labels, g, value FROM ({sql})" for n, sql in plans.items())
    return f"WITH {base}, al_q AS ({parts}) {vector('al_q', column, labels='labels')}"


def rules(*names: str) -> str:
    return named({n: RULES[n] for n in names}, EVALUATED)


WITH_COUNTERS = (
    f"{BATCH_LOG}, {lifecycle()}, {counter_series(HOUR)}, {SAMPLES}, "
    "sa AS (SELECT * FROM sm UNION ALL SELECT * FROM cs), "
    f"{increase('rt', _W, HOUR, 'sa', per_second=True)}, {instant('it', _W, HOUR, 'sa')}, "
    f"{increase('i5', 300_000_000, HOUR, 'cs')}, {increase('i15', 900_000_000, HOUR, 'cs')}"
)


def _outcome(o: str) -> str:
    return f"SELECT '{{}}' AS labels, g, sum(value) AS value FROM it WHERE metric = 'audit_outcomes_total' AND inst = '{o}' GROUP BY g"


EXPORTS = {
    "cluster_messages_per_sec": RULES["kafka_cluster_messages_per_sec"],
    "cluster_bytes_in_kb_per_sec": RULES["kafka_cluster_bytes_in_kb_per_sec"],
    "cluster_bytes_out_kb_per_sec": RULES["kafka_cluster_bytes_out_kb_per_sec"],
    "cluster_cpu_host_percent": RULES["kafka_cluster_cpu_host_percent"],
    "cluster_cpu_cores": RULES["kafka_cluster_cpu_cores"],
    "cluster_cpu_core_percent": RULES["kafka_cluster_cpu_percent"],
    "cluster_memory_gb": RULES["kafka_cluster_container_memory_gb"],
    "audit_committed_total": _outcome("COMMITTED"),
    "audit_replay_observed_total": _outcome("REPLAY_OBSERVED"),
    "audit_estimated_failed_total": _outcome("ESTIMATED_FAILED"),
    "audit_late_commit_total": _outcome("LATE_COMMIT"),
    "audit_batches_seen_total": _sum("audit_batches_seen_total", "it"),
}


def _failure_rate(source: str) -> str:
    return (
        f"SELECT '{{}}' AS labels, a.g, CASE WHEN b.value <> 0 THEN a.value / b.value WHEN a.value = 0 THEN 'nan'::DOUBLE "
        f"ELSE 'inf'::DOUBLE END AS value FROM "
        f"(SELECT g, sum(value) AS value FROM {source} WHERE metric = 'audit_outcomes_total' AND inst = 'ESTIMATED_FAILED' GROUP BY g) a "
        f"JOIN (SELECT g, sum(value) AS value FROM {source} WHERE metric = 'audit_batches_seen_total' GROUP BY g) b ON a.g = b.g")


PANELS = {
    "outcomes_by_type": "SELECT '{\"outcome\":\"' || inst || '\"}' AS labels, g, sum(value) AS value FROM i5 "
                        "WHERE metric = 'audit_outcomes_total' GROUP BY inst, g",
    "estimated_failure_rate": _failure_rate("i15"),
    "bytes_in_mb_per_sec": f"SELECT labels, g, value / 1024 AS value FROM ({RULES['kafka_cluster_bytes_in_kb_per_sec']})",
    "bytes_out_mb_per_sec": f"SELECT labels, g, value / 1024 AS value FROM ({RULES['kafka_cluster_bytes_out_kb_per_sec']})",
    "cpu_host_percent": RULES["kafka_cluster_cpu_host_percent"],
    "consumer_lag": RULES["kafka_cluster_consumer_lag_messages"],
    "memory_gb": RULES["kafka_cluster_container_memory_gb"],
}

# --- statements ----------------------------------------------------------------------------------------

_SINK = f"""{RECORDS}, snk AS (SELECT sha256(topic || '|' || partition || '|' || "offset") AS event_id, topic AS kafka_topic,
  partition AS kafka_partition, "offset" AS kafka_offset, value AS payload, timestamp AS created_at FROM rec,
  range(CASE WHEN "offset" % 97 = 0 THEN 0 WHEN "offset" % 101 = 0 THEN 2 ELSE 1 END))"""
_SINK_COLUMNS = "event_id, kafka_topic, kafka_partition, kafka_offset, payload, created_at"
_PAIRS = """SELECT id AS "eventId", CAST(sum(is_read::INT) AS BIGINT) AS reads, CAST(sum((NOT is_read)::INT) AS BIGINT) AS commits,
  make_timestamp(min(CASE WHEN is_read THEN t END)) AS first_read, make_timestamp(max(CASE WHEN is_read THEN t END)) AS last_read,
  make_timestamp(min(CASE WHEN NOT is_read THEN t END)) AS first_commit, make_timestamp(max(CASE WHEN NOT is_read THEN t END)) AS last_commit"""
_COUNTED = "SELECT metric, {key} AS labels, count(*) AS n, round(sum(v), 2) AS total FROM sm {where} GROUP BY 1, 2"
_PHASED = f"""WITH {SAMPLES}, ph AS (SELECT *, t - t // {24 * HOUR} * {24 * HOUR} AS o FROM sm)
SELECT strftime(make_timestamp(t), '%Y-%m-%d') AS run_label, CASE WHEN o < {2 * HOUR} THEN 'idle' WHEN o < {5 * HOUR} THEN 'warm_up'
  ELSE 'measured' END AS phase, metric, count(*) AS n, round(sum(v), 2) AS total FROM ph WHERE o < {20 * HOUR} GROUP BY 1, 2, 3"""
_MEANS = f"""{SAMPLES}, mn AS (SELECT 'run-' || (day(make_timestamp(t)) % 3) AS run_label, metric, avg(v) AS mean, count(*) AS n
  FROM sm GROUP BY 1, 2)"""
_CHUNKS = """WITH rn AS (SELECT 'events' AS topic, CAST(user_id % 12 AS INTEGER) AS partition, event_id,
  (row_number() OVER ({over} ORDER BY event_id) - 1) // 200 AS chunk FROM events)
SELECT topic, {cols} chunk, count(*) AS size, min(event_id) AS first_offset, max(event_id) AS last_offset FROM rn GROUP BY ALL"""
_COMMITS = f"""WITH {USER_LOG}, p AS (SELECT *, lag(is_read) OVER w AS pr, lag(seq) OVER w AS ps FROM al
  WINDOW w AS (PARTITION BY grp ORDER BY t, seq))
SELECT grp AS "consumerGroup", 'batch-' || ps AS "eventId", make_timestamp(t) AS timestamp, seq FROM p WHERE NOT is_read AND pr"""
_USER_OUTCOMES = f"WITH {USER_LOG}, {lifecycle()}"
_BATCH_OUTCOMES = f"WITH {BATCH_LOG}, {lifecycle()}"
_OPEN = f"""WITH {USER_LOG}, {lifecycle('(SELECT max(t) + 1000 FROM al)')}
SELECT id AS "eventId", fgrp AS "consumerGroup", topic AS "sourceTopic", make_timestamp(ft) AS "firstSeenAt", make_timestamp(t) AS "lastSeenAt",
  CASE WHEN fired THEN make_timestamp(tk) END AS "timedOutAt", CAST(rc AS INTEGER) AS "recordCount", CAST(n - 1 AS INTEGER) AS "replayCount",
  CAST(tb + fired::INT AS INTEGER) AS "timeoutCount", ranges FROM g WHERE is_read AND nxt IS NULL"""
_ONE = """WITH one AS (SELECT 'events_total' AS metric, '{}' AS key, '' AS inst, '' AS cid, '' AS svc, '' AS cname, '' AS cpu, '' AS mode,
  epoch_us(ts) AS t, CAST(event_id % 4001 AS DOUBLE) AS v FROM events)"""
# --- fixed values: the names of recorded series and the expressions of the others ---
_RECORDED = {
    "cluster_messages_per_sec": "kafka_cluster_messages_per_sec", "cluster_bytes_in_kb_per_sec": "kafka_cluster_bytes_in_kb_per_sec",
    "cluster_bytes_out_kb_per_sec": "kafka_cluster_bytes_out_kb_per_sec", "cluster_cpu_host_percent": "kafka_cluster_cpu_host_percent",
    "cluster_cpu_cores": "kafka_cluster_cpu_cores", "cluster_cpu_core_percent": "kafka_cluster_cpu_percent",
    "cluster_memory_gb": "kafka_cluster_container_memory_gb",
}
_EXPRESSIONS = {
    "audit_committed_total": 'sum(audit_outcomes_total{outcome="COMMITTED"})',
    "audit_replay_observed_total": 'sum(audit_outcomes_total{outcome="REPLAY_OBSERVED"})',
    "audit_estimated_failed_total": 'sum(audit_outcomes_total{outcome="ESTIMATED_FAILED"})',
    "audit_late_commit_total": 'sum(audit_outcomes_total{outcome="LATE_COMMIT"})',
    "audit_batches_seen_total": "sum(audit_batches_seen_total)",
}
_PROMQL = ", ".join(f"'{q} = {text}'" for q, text in (_RECORDED | _EXPRESSIONS).items())
_EXPORTED = " UNION ALL ".join(f"SELECT '{_RECORDED.get(q, '')}' AS metric, labels, g, value FROM ({sql})" for q, sql in EXPORTS.items())
# The kept bean attributes' metric names.
_BEANS = [
    ("kafka_broker_bytes_in_total", "counter"), ("kafka_broker_bytes_out_total", "counter"), ("kafka_broker_messages_in_total", "counter"),
    ("kafka_under_replicated_partitions", "gauge"), ("kafka_partition_count", "gauge"), ("kafka_leader_count", "gauge"),
    ("kafka_active_controller", "gauge"), ("jvm_heap_used_bytes", "gauge"), ("jvm_non_heap_used_bytes", "gauge"),
    ("jvm_process_cpu_load_ratio", "gauge"), ("jvm_system_cpu_load_ratio", "gauge"), ("kafka_jvm_threads_current", "gauge"),
    ("jvm_heap_max_bytes", "gauge"), ("kafka_request_produce_latency_p99_ms", "gauge"),
]
_BEAN_VALUES = ", ".join(f"({i}, '{m}', '{k}')" for i, (m, k) in enumerate(_BEANS))

ORACLE: dict[str, str] = {
    "lifecycle_outcomes": f"{_USER_OUTCOMES} {OUTCOME_ROWS}",
    "lifecycle_outcomes_by_type": f"{_USER_OUTCOMES} SELECT outcome, count(*) AS n FROM oc GROUP BY 1",
    "lifecycle_hot_keys":
        f"WITH {USER_LOG.replace('CAST(user_id AS VARCHAR) AS id', 'CAST(user_id % 4 AS VARCHAR) AS id')}, {lifecycle()} {OUTCOME_ROWS}",
    "lifecycle_batches": f"{_BATCH_OUTCOMES} {OUTCOME_ROWS}",
    "lifecycle_summary": f"""WITH {USER_LOG}, {lifecycle("epoch_us(TIMESTAMP '2024-01-29 12:00:00')")}
SELECT count(*) FILTER (is_read AND nxt IS NULL AND NOT fired) AS pending, count(*) FILTER (is_read AND n > 1) AS replays,
  count(*) FILTER (fired) AS "estimatedFailed", count(*) FILTER (NOT is_read AND n >= 1 AND tb > 0) AS "lateCommits",
  count(*) FILTER (NOT is_read AND n >= 1 AND tb = 0) AS committed, count(*) FILTER (NOT is_read AND n = 0) AS "unknownCommits" FROM g""",
    "lifecycle_streamed":
        f"WITH {USER_LOG}, {lifecycle('(SELECT max(t) // 1000 * 1000 FROM al)')} {OUTCOME_ROWS}",
    "lifecycle_late_events":
        f"WITH {USER_LOG}, {lifecycle('(SELECT max(t) + 1000 FROM al)')} {OUTCOME_ROWS}",
    "lifecycle_summary_streamed": f"""WITH {USER_LOG}, {lifecycle('(SELECT max(t) + 1000 FROM al)')}
SELECT count(*) FILTER (is_read AND nxt IS NULL AND NOT fired) AS pending, count(*) FILTER (is_read AND n > 1) AS replays,
  count(*) FILTER (fired) AS "estimatedFailed", count(*) FILTER (NOT is_read AND n >= 1 AND tb > 0) AS "lateCommits",
  count(*) FILTER (NOT is_read AND n >= 1 AND tb = 0) AS committed FROM g""",
    "read_commit_pairs_streamed": f"WITH {BATCH_LOG} {_PAIRS} FROM al GROUP BY id HAVING bool_or(is_read)",
    "audit_intake_streamed": """WITH c AS (SELECT event_id % 12 IN (0, 1, 9, 10) AS ok FROM events)
SELECT unnest(['counted_read', 'counted_good', 'good', 'counted_quarantined', 'quarantined']) AS rows,
  unnest([count(*), count(*) FILTER (ok), count(*) FILTER (ok), count(*) FILTER (NOT ok), count(*) FILTER (NOT ok)]) AS n FROM c""",
    "open_episodes": _OPEN,
    "pending_batches": _OPEN,
    "outcome_counters": f"""{_BATCH_OUTCOMES}, {counters()} SELECT metric, outcome, grp AS consumer_group, topic AS source_topic,
  part AS partition, CAST(sum(inc) AS BIGINT) AS value FROM st GROUP BY ALL""",
    "outcome_counter_samples":
        f"{_BATCH_OUTCOMES}, {counter_series(HOUR)} SELECT metric, key AS labels, make_timestamp(t) AS ts, round(v + 1e-9, 6) AS value FROM cs",
    "outcome_counters_streamed": f"{_BATCH_OUTCOMES}, {counters()} SELECT metric, {COUNTER_KEY} AS labels, CAST(sum(inc) AS BIGINT) AS value "
                                 "FROM st GROUP BY metric, outcome, grp, topic, part",
    "counters_incremental": f"{_BATCH_OUTCOMES}, {counters()} SELECT metric, {COUNTER_KEY} AS labels, CAST(sum(inc) AS BIGINT) AS value "
                            "FROM st GROUP BY metric, outcome, grp, topic, part",
    "export_totals": f"""{_BATCH_OUTCOMES} SELECT count(*) FILTER (outcome = 'COMMITTED') AS audit_committed_total,
  count(*) FILTER (outcome = 'REPLAY_OBSERVED') AS audit_replay_observed_total,
  count(*) FILTER (outcome = 'ESTIMATED_FAILED') AS audit_estimated_failed_total,
  count(*) FILTER (outcome = 'LATE_COMMIT') AS audit_late_commit_total, count(*) AS audit_batches_seen_total FROM oc""",
    "outcome_rates": f"""{_BATCH_OUTCOMES}, r AS (SELECT count(*) AS n FROM al WHERE is_read),
c AS (SELECT count(*) FILTER (outcome = 'ESTIMATED_FAILED') AS f, count(*) FILTER (outcome = 'REPLAY_OBSERVED') AS p,
  count(*) FILTER (outcome = 'LATE_COMMIT') AS l FROM oc)
SELECT 'perf-group' AS consumer_group, 'events' AS source_topic, n AS batches_read, round(f / n, 6) AS estimated_failure_rate,
  round(p / n, 6) AS replay_rate, round(l / f, 6) AS late_commit_ratio FROM r, c""",
    "replay_severity": f"""{_USER_OUTCOMES} SELECT grp AS "consumerGroup", topic AS "sourceTopic", CAST(sum(rp) AS BIGINT) AS replays,
  CAST(max(rp) AS INTEGER) AS worst FROM oc WHERE rp > 0 GROUP BY 1, 2""",
    "replay_severity_by_partition": f"""{_BATCH_OUTCOMES}, x AS (SELECT topic, rp, unnest(parts) AS partition FROM oc WHERE rp > 0)
SELECT topic AS "sourceTopic", partition, CAST(sum(rp) AS BIGINT) AS replays, CAST(max(rp) AS INTEGER) AS worst FROM x GROUP BY 1, 2""",
    "timeout_pressure": f"""{_USER_OUTCOMES} SELECT make_timestamp(ot // {6 * HOUR} * {6 * HOUR}) AS window_start,
  make_timestamp(ot // {6 * HOUR} * {6 * HOUR} + {6 * HOUR}) AS window_end, CAST(sum(tm) AS BIGINT) AS timeouts,
  count(*) FILTER (outcome = 'ESTIMATED_FAILED') AS failed FROM oc GROUP BY 1, 2""",
    "replay_concentration": f"""{_BATCH_OUTCOMES}, x AS (SELECT unnest(parts) AS partition FROM oc WHERE outcome = 'REPLAY_OBSERVED')
SELECT 'perf-group' AS consumer_group, 'events' AS source_topic, partition, count(*) AS replays,
  round(count(*) / (SELECT count(*) FROM x), 6) AS share FROM x GROUP BY partition""",
    "batch_ranges": """SELECT event_id // 50 AS batch_no, 'events' AS topic, CAST(user_id % 12 AS INTEGER) AS partition,
  min(event_id) AS "offsetMin", max(event_id) AS "offsetMax", CAST(count(*) AS INTEGER) AS "recordCount", max(ts) AS "lastTimestamp"
FROM events GROUP BY 1, 2, 3""",
    "batch_reads": f"""WITH {BATCHES} SELECT batch_no, id AS "eventId", 'BATCH_READ' AS stage, 'perf-group' AS "consumerGroup",
  'events' AS "sourceTopic", mx AS timestamp, CAST(n AS INTEGER) AS "recordCount", ranges FROM bat""",
    "commit_events": _COMMITS,
    "commit_events_hot": _COMMITS,
    "commit_offsets": f'WITH {RECORDS} SELECT topic, partition, max("offset") + 1 AS "nextOffset" FROM rec GROUP BY 1, 2',
    "chunk_sizes": _CHUNKS.format(over="PARTITION BY user_id % 12", cols="partition,"),
    "chunk_sizes_hot": _CHUNKS.format(over="", cols=""),
    "sink_stats": f"""WITH {BATCHES}, w AS (SELECT mx, n, batch_no % 7 = 3 AS bad, batch_no % 11 = 4 AND batch_no % 7 <> 3 AS half FROM bat),
x AS (SELECT mx > TIMESTAMP '2024-01-20' AS recent, bad, half, n,
  CASE WHEN bad THEN 0 WHEN half THEN greatest(1, n // 2) ELSE n END AS wr FROM w),
y AS (SELECT CAST(sum(n) AS BIGINT) AS tc, CAST(sum(wr) AS BIGINT) AS tw, count(*) FILTER (bad) AS we, count(*) FILTER (half) AS pw,
  CAST(sum(n) FILTER (recent) AS BIGINT) AS ic, CAST(sum(wr) FILTER (recent) AS BIGINT) AS iw FROM x)
SELECT tc AS total_consumed, tw AS total_written, we AS write_errors, pw AS partial_writes, ic AS interval_consumed, iw AS interval_written,
  round(ic / 950400.0, 6) AS interval_consumed_rate, round(iw / 950400.0, 6) AS interval_write_rate,
  round(tc / 2592000.0, 6) AS lifetime_consumed_rate, round(tw / 2592000.0, 6) AS lifetime_write_rate FROM y""",
    "records_scan": f"""WITH {RECORDS} SELECT topic, partition, count(*) AS n, min("offset") AS first_offset, max("offset") AS last_offset,
  min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM rec GROUP BY 1, 2""",
    "records_read_back": f"WITH {RECORDS} SELECT * FROM rec",
    "audit_json_parse": """SELECT event_id AS "offset", 'e' || event_id AS "eventId",
  CASE WHEN event_id % 12 = 1 THEN 'OFFSET_COMMITTED' ELSE 'BATCH_READ' END AS stage, 'g' AS "consumerGroup", 't' AS "sourceTopic",
  TIMESTAMP '2024-02-03 04:05:06.5' AS timestamp, CAST(CASE event_id % 12 WHEN 1 THEN 0 WHEN 9 THEN 7 ELSE 5 END AS INTEGER) AS "recordCount",
  CASE WHEN event_id % 12 = 1 THEN '' ELSE '3:' || event_id || ':' || event_id || ':1' END AS ranges
FROM events WHERE event_id % 12 IN (0, 1, 9, 10)""",
    "audit_json_rejects": "SELECT event_id % 12 AS form, count(*) AS n FROM events WHERE event_id % 12 NOT IN (0, 1, 9, 10) GROUP BY 1",
    "audit_json_round_trip": f"""WITH {BATCH_LOG} SELECT batch_no, id AS "eventId",
  CASE WHEN is_read THEN 'BATCH_READ' ELSE 'OFFSET_COMMITTED' END AS stage, make_timestamp(t) AS timestamp,
  CAST(CASE WHEN is_read THEN rc ELSE 0 END AS INTEGER) AS "recordCount", CASE WHEN is_read THEN ranges ELSE '' END AS ranges FROM al""",
    "outcome_json_parse": """SELECT event_id AS "offset", 'e' || event_id AS "eventId", 'COMMITTED' AS outcome,
  CASE WHEN event_id % 8 = 7 THEN 'unknown' ELSE 'g' END AS "consumerGroup", 't' AS "sourceTopic", TIMESTAMP '2026-03-20' AS "firstSeenAt",
  CASE WHEN event_id % 8 = 1 THEN TIMESTAMP '2026-03-20 00:00:05.25' ELSE TIMESTAMP '2026-03-20 00:00:05' END AS "lastSeenAt",
  CASE WHEN event_id % 8 = 1 THEN TIMESTAMP '2026-03-20 00:00:05.25' ELSE TIMESTAMP '2026-03-20 00:00:05' END AS "observedAt",
  CAST(CASE WHEN event_id % 8 = 2 THEN 0 ELSE 10 END AS INTEGER) AS "recordCount",
  CAST(CASE WHEN event_id % 8 = 2 THEN 0 ELSE 2 END AS INTEGER) AS "replayCount",
  CAST(CASE WHEN event_id % 8 = 2 THEN 0 ELSE 1 END AS INTEGER) AS "timeoutCount",
  CASE WHEN event_id % 8 = 3 THEN '' ELSE '0:' || event_id || ':104:5' END AS ranges
FROM events WHERE event_id % 8 NOT IN (4, 5)""",
    "outcome_json_rejects": "SELECT event_id % 8 AS form, count(*) AS n FROM events WHERE event_id % 8 IN (4, 5) GROUP BY 1",
    "outcome_json_round_trip": f"{_USER_OUTCOMES} {OUTCOME_ROWS}",
    "matrix_scan": """SELECT 'm_' || event_type AS metric, '{"user":"' || user_id || '"}' AS labels, ts, unnest([round(value + 1e-9, 6), 1.0::DOUBLE]) AS value
FROM events""",
    "sink_rows": f"""WITH {RECORDS} SELECT sha256(topic || '|' || partition || '|' || "offset") AS event_id, topic AS kafka_topic,
  partition AS kafka_partition, "offset" AS kafka_offset, value AS payload, timestamp AS created_at FROM rec""",
    "latest_write": f"""WITH {RECORDS} SELECT sha256(topic || '|' || partition || '|' || "offset") AS event_id, topic AS kafka_topic,
  partition AS kafka_partition, "offset" AS kafka_offset, CASE WHEN "offset" % 3 = 0 THEN 'v2-' ELSE '' END || value AS payload,
  timestamp + CASE WHEN "offset" % 3 = 0 THEN INTERVAL 1 MINUTE ELSE INTERVAL 0 MINUTE END AS created_at FROM rec""",
    "sink_upsert": f"""WITH {_SINK} SELECT DISTINCT event_id, kafka_topic, kafka_partition, kafka_offset,
  CASE WHEN kafka_offset % 5 = 0 THEN 'patched' ELSE payload END AS payload, created_at FROM snk""",
    "sink_upsert_files": f"""WITH {_SINK} SELECT DISTINCT event_id, kafka_topic, kafka_partition, kafka_offset,
  CASE WHEN kafka_offset % 5 = 0 THEN 'patched' ELSE payload END AS payload, created_at FROM snk""",
    # Offsets divisible by n+1 were last written by generation n; the repeats change nothing.
    "sink_compact_repeat": f"""WITH {_SINK} SELECT DISTINCT event_id, kafka_topic, kafka_partition, kafka_offset,
  CASE WHEN kafka_offset % 4 = 0 THEN 'g3-' WHEN kafka_offset % 3 = 0 THEN 'g2-' WHEN kafka_offset % 2 = 0 THEN 'g1-' ELSE 'g0-' END
  || payload AS payload, created_at FROM snk""",
    "sink_lookup": f"""WITH {_SINK} SELECT event_id, kafka_topic, kafka_partition, kafka_offset, 'again-' || any_value(payload) AS payload,
  any_value(created_at) AS created_at FROM snk GROUP BY 1, 2, 3, 4 HAVING count(*) > 1""",
    "sink_two_streams": f"""WITH {RECORDS} SELECT topic AS kafka_topic, partition AS kafka_partition, count(*) AS n,
  CAST(sum("offset") AS BIGINT) AS offset_sum FROM rec GROUP BY 1, 2""",
    "sink_streamed_restart": f"""WITH {RECORDS} SELECT sha256(topic || '|' || partition || '|' || "offset") AS event_id,
  partition AS kafka_partition, "offset" AS kafka_offset, value AS payload FROM rec""",
    "sink_append_files": f"""WITH {_SINK} SELECT kafka_topic, kafka_partition, count(*) AS n, count(DISTINCT kafka_offset) AS places
FROM snk GROUP BY 1, 2""",
    "sink_streamed": """SELECT count(*) AS stored, CAST(sum(event_id) AS BIGINT) AS offset_sum, count(*) AS audited,
  CAST(1 AS BIGINT) AS reads, CAST(1 AS BIGINT) AS commits FROM events""",
    "sink_missing": f"""WITH {RECORDS} SELECT topic AS kafka_topic, partition AS kafka_partition, "offset" AS kafka_offset
FROM rec WHERE "offset" % 97 = 0""",
    "sink_completeness": f"""WITH {RECORDS} SELECT topic AS kafka_topic, partition AS kafka_partition, count(*) AS missing,
  min("offset") AS first_missing, max("offset") AS last_missing FROM rec WHERE "offset" % 97 = 0 GROUP BY 1, 2""",
    "sink_duplicates": f"""WITH {_SINK} SELECT kafka_topic, kafka_partition, kafka_offset, count(*) AS copies FROM snk
GROUP BY 1, 2, 3 HAVING count(*) > 1""",
    "partial_batches": f"""WITH {BATCHES}, w AS (SELECT event_id // 50 AS batch_no, count(*) FILTER (event_id % 97 <> 0) AS written,
  count(*) AS expected FROM events GROUP BY 1)
SELECT batch_no, id AS "eventId", expected, written, round(written / expected, 6) AS written_share FROM bat JOIN w USING (batch_no)
WHERE written < expected""",
    "read_commit_pairs": f"WITH {BATCH_LOG} {_PAIRS} FROM al GROUP BY id HAVING bool_or(is_read) AND bool_or(NOT is_read)",
    "unmatched_reads": f"""WITH {BATCH_LOG}, p AS ({_PAIRS} FROM al GROUP BY id HAVING bool_and(is_read))
SELECT "eventId", reads, first_read, last_read FROM p""",
    "unknown_commits": f"""WITH {USER_LOG}, p AS ({_PAIRS.replace('id AS', "id || '-' || strftime(make_timestamp(t), '%Y%m%d') AS")} FROM al
  GROUP BY 1 HAVING NOT bool_or(is_read)) SELECT "eventId", commits, first_commit, last_commit FROM p""",
    "metric_names": f"WITH {SAMPLES} SELECT DISTINCT metric FROM sm",
    "keep_metrics": f"""WITH {SAMPLES} SELECT CASE WHEN metric LIKE 'container%' THEN 'cadvisor' ELSE 'node-exporter' END AS job, metric,
  count(*) AS n FROM sm WHERE metric IN ('container_cpu_usage_seconds_total', 'container_memory_usage_bytes')
  OR metric LIKE 'node_cpu_%' OR metric LIKE 'node_memory_%' GROUP BY 1, 2""",
    "attach_labels": "WITH " + SAMPLES + " " + _COUNTED.format(
        key="""'{"app":"kafka-exporter","cluster":"kafka-research",' || substr(key, 2)""", where="WHERE metric = 'kafka_consumergroup_lag'"),
    "match_labels": "WITH " + SAMPLES + " " + _COUNTED.format(
        key="key", where="""WHERE key = '{"broker_id":"2","instance":"kafka-2"}'"""),
    "label_replace": "WITH " + SAMPLES + " " + _COUNTED.format(
        key="""CASE WHEN cname LIKE 'kafka-%' THEN '{"broker":"' || cname || '",' || substr(key, 2) ELSE key END""",
        where="WHERE metric = 'container_memory_usage_bytes'"),
    "bean_metrics": f"""WITH b(i, metric, kind) AS (VALUES {_BEAN_VALUES})
SELECT metric, kind, '{{"instance":"kafka-' || (user_id % 3 + 1) || '"}}' AS labels, count(*) AS n, round(sum(value), 2) AS total
FROM events JOIN b ON event_id % 15 = i GROUP BY 1, 2, 3""",
    "file_names": """SELECT coalesce(nullif(trim(regexp_replace(CASE WHEN user_id % 10 = 0 THEN '._.' ELSE
  '._' || event_type || ' /é:' || (user_id % 3) || '.' END, '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), 'metric') AS file, count(*) AS n
FROM events GROUP BY 1""",
    "series_names": f"""WITH {SAMPLES} SELECT metric, CASE WHEN metric = 'jvm_process_cpu_load_ratio' THEN 'series_0'
  ELSE replace(replace(key, '":"', '": "'), '","', '", "') END AS series, count(*) AS n FROM sm GROUP BY 1, 2""",
    "last_values": f"""WITH {SAMPLES} SELECT metric, round(arg_max(v, t), 6) AS value, make_timestamp(max(t)) AS ts FROM sm
WHERE t % 2 = 0 GROUP BY 1""",
    "increase_6h": f"WITH {SAMPLES}, {increase('x', _W, HOUR)} {vector('x', 'metric')}",
    "increase_hot_series": f"WITH {SAMPLES}, {increase('x', 72 * HOUR, 24 * HOUR)} {vector('x', 'metric')}",
    "increase_long_series": f"{_ONE}, {increase('x', 900_000_000, 300_000_000, 'one')} {vector('x', 'metric')}",
    "instant_long_series": f"{_ONE}, {instant('x', HOUR, 300_000_000, 'one')} {vector('x', 'metric')}",
    "increase_15m": f"WITH {SAMPLES}, {increase('x', 900_000_000, 300_000_000)} {vector('x', 'metric')}",
    "rate_5m": f"WITH {SAMPLES}, {increase('x', 300_000_000, 300_000_000, per_second=True)} {vector('x', 'metric')}",
    "rate_uneven_step": f"WITH {SAMPLES}, {increase('x', 3_000_000_000, 2 * HOUR, per_second=True)} {vector('x', 'metric')}",
    "instant_grid": f"WITH {SAMPLES}, {instant('x', 5_400_000_000, HOUR)} {vector('x', 'metric')}",
    "sum_by_instance": f"""WITH {SAMPLES}, {instant('x', _W, HOUR)}, y AS (SELECT '{{"instance":"' || inst || '"}}' AS key, g, sum(value) AS value
  FROM x WHERE metric = 'jvm_heap_used_bytes' GROUP BY inst, g) {vector('y')}""",
    "average_load": f"""WITH {SAMPLES}, {instant('x', _W, HOUR)}, y AS (SELECT '{{}}' AS key, g, avg(value) AS value
  FROM x WHERE metric = 'jvm_process_cpu_load_ratio' GROUP BY g) {vector('y')}""",
    "vector_add": f"WITH {EVALUATED} {vector(_ADDED)}",
    "vector_or": f"""WITH {EVALUATED}, o AS (SELECT key, g, arg_min(value, metric) AS value FROM rt
  WHERE (metric = '{_IN}' AND inst <> 'kafka-3') OR metric = '{_OUT}' GROUP BY key, g) {vector('o')}""",
    "broker_throughput": rules("kafka_broker_bytes_in_kb_per_sec", "kafka_broker_bytes_out_kb_per_sec", "kafka_broker_throughput_kb_per_sec"),
    "cluster_throughput": rules("kafka_cluster_bytes_in_kb_per_sec", "kafka_cluster_bytes_out_kb_per_sec",
                                "kafka_cluster_throughput_bytes_per_sec", "kafka_cluster_messages_per_sec"),
    "consumer_lag": rules("kafka_cluster_consumer_lag_messages"),
    "broker_cpu": rules("kafka_broker_cpu_percent"),
    "cluster_cpu": rules("kafka_cluster_cpu_percent", "kafka_cluster_cpu_cores", "kafka_host_cpu_cores",
                         "kafka_cluster_cpu_host_percent", "kafka_cluster_jvm_cpu_percent"),
    "container_memory": rules("kafka_broker_container_memory_mb", "kafka_cluster_container_memory_gb"),
    "jvm_memory": rules("jvm_heap_used_gb", "jvm_non_heap_used_gb"),
    "host_usage": rules("host_cpu_busy_percent", "host_memory_used_percent"),
    "recorded_rules": named(RULES, EVALUATED, "metric"),
    "rules_streamed": f"SELECT * FROM ({named(RULES, EVALUATED, 'metric')}) WHERE ts <= (SELECT max(ts) FROM events)",
    "export_queries": named(EXPORTS, WITH_COUNTERS),
    "dashboard_panels": named(PANELS, WITH_COUNTERS),
    "failure_rate_panel": f"""{_BATCH_OUTCOMES}, {counter_series(300_000_000)}, {increase('i15', 900_000_000, 300_000_000, 'cs')},
r AS ({_failure_rate('i15')}) {vector('r', labels='labels')}""",
    "series_export": f"""WITH {WITH_COUNTERS}, sel AS ({_EXPORTED}),
x AS (SELECT 'selected' AS part, * FROM sel UNION ALL SELECT 'all_metrics', metric, key, g, value FROM it)
SELECT part, form, metric, labels, make_timestamp(g) AS ts, round(value + 1e-9, 6) AS value FROM x, (VALUES ('csv'), ('json')) AS f(form)""",
    "export_files": f"""WITH {SAMPLES} SELECT 'metric_names' AS file, metric AS line FROM (SELECT DISTINCT metric FROM sm)
UNION ALL SELECT 'metadata', unnest(['run_label=baseline', 'start_ts=1.7044128E9', 'end_ts=1.704672E9', 'step_seconds=3600.0', 'export_all_metrics=true'])
UNION ALL SELECT 'promql', unnest([{_PROMQL}])""",
    "export_csv_rows": f"""WITH {EVALUATED}, r AS ({" UNION ALL ".join(f"SELECT '{n}' AS query, labels, g, value FROM ({sql})" for n, sql in RULES.items())})
SELECT query, CASE labels WHEN '{{}}' THEN 'series_0' ELSE replace(labels, '":"', '": "') END AS series, g / 1e6 AS timestamp,
  round(value + 1e-9, 6) AS value FROM r""",
    "measured_window": "WITH " + SAMPLES + " " + _COUNTED.format(
        key="key", where="WHERE make_timestamp(t) BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-12 18:30:00'"),
    "phase_tagging": _PHASED,
    "phase_tagging_bucketed": _PHASED,
    "idle_subtraction": f"""WITH {_MEANS} SELECT a.run_label, a.metric, a.n, round(a.mean, 4) AS mean, round(b.mean, 4) AS idle_mean,
  round(a.mean - b.mean, 4) AS marginal FROM mn a JOIN mn b ON a.metric = b.metric AND b.run_label = 'run-0' AND a.run_label <> 'run-0'""",
    "run_comparison": f"""WITH {_MEANS}, p AS (SELECT metric, max(mean) FILTER (run_label = 'run-0') AS r0,
  max(mean) FILTER (run_label = 'run-1') AS r1, max(mean) FILTER (run_label = 'run-2') AS r2 FROM mn GROUP BY 1)
SELECT metric, round(r0, 4) AS run_0, round(r1, 4) AS run_1, round(r2, 4) AS run_2, round((r1 - r0) * 100 / r0, 4) AS run_1_overhead_percent,
  round((r2 - r0) * 100 / r0, 4) AS run_2_overhead_percent FROM p""",
}
