"""Named derived series, export queries and dashboard panels over metric samples."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from waybill.functions import columns as C
from waybill.operators import series as S
from waybill.schemas import OUTCOMES
from waybill.session import cut_lineage

# --- fixed values ------------------------------------------------------------------------------
# Container ids of the three brokers, as recorded for the measured cluster. Pass other selectors
# to Evaluation for another cluster.
BROKER_CONTAINERS = {
    "kafka-1": "/docker/eb89133e6713d59534cad8060c0dc1a504aa615100a1b9890972f544ee45954a",
    "kafka-2": "/docker/b28a2bfc13fcebda950895c9b5d805fa79405c081cbcb374d0adee1bbfc3b4e4",
    "kafka-3": "/docker/11c2aba204cab1a5d0db3318092c490977a827b15436101e0edfd541875584ef",
}
SERVICE_LABEL = "container_label_com_docker_compose_service"

# Management-bean attributes that are kept, the metric each becomes, and its kind.
BEAN_METRICS = [
    ("kafka.server<type=BrokerTopicMetrics, name=BytesInPerSec><>Count", "kafka_broker_bytes_in_total", "counter"),
    ("kafka.server<type=BrokerTopicMetrics, name=BytesOutPerSec><>Count", "kafka_broker_bytes_out_total", "counter"),
    ("kafka.server<type=BrokerTopicMetrics, name=MessagesInPerSec><>Count", "kafka_broker_messages_in_total", "counter"),
    ("kafka.server<type=ReplicaManager, name=UnderReplicatedPartitions><>Value", "kafka_under_replicated_partitions", "gauge"),
    ("kafka.server<type=ReplicaManager, name=PartitionCount><>Value", "kafka_partition_count", "gauge"),
    ("kafka.server<type=ReplicaManager, name=LeaderCount><>Value", "kafka_leader_count", "gauge"),
    ("kafka.controller<type=KafkaController, name=ActiveControllerCount><>Value", "kafka_active_controller", "gauge"),
    ("java.lang<type=Memory><HeapMemoryUsage>used", "jvm_heap_used_bytes", "gauge"),
    ("java.lang<type=Memory><NonHeapMemoryUsage>used", "jvm_non_heap_used_bytes", "gauge"),
    ("java.lang<type=OperatingSystem><>ProcessCpuLoad", "jvm_process_cpu_load_ratio", "gauge"),
    ("java.lang<type=OperatingSystem><>SystemCpuLoad", "jvm_system_cpu_load_ratio", "gauge"),
    ("java.lang<type=Threading><>ThreadCount", "kafka_jvm_threads_current", "gauge"),
    ("java.lang<type=Memory><HeapMemoryUsage>max", "jvm_heap_max_bytes", "gauge"),
    ("kafka.network<type=RequestMetrics, name=TotalTimeMs, request=Produce><>99thPercentile",
     "kafka_request_produce_latency_p99_ms", "gauge"),
]

# Metric names each scrape job keeps, and the labels each job attaches.
KEEP_LISTS = {
    "cadvisor": "(container_cpu_usage_seconds_total|container_memory_usage_bytes|container_spec_memory_limit_bytes)",
    "node-exporter": "(node_cpu_.*|node_memory_.*|node_load.*|node_context_switches.*|node_intr.*)",
}
JOB_LABELS = {
    "kafka-jmx-1": {"broker_id": "1", "instance": "kafka-1"},
    "kafka-jmx-2": {"broker_id": "2", "instance": "kafka-2"},
    "kafka-jmx-3": {"broker_id": "3", "instance": "kafka-3"},
    "kafka-exporter": {"app": "kafka-exporter"},
    "audit-outcomes-exporter": {"app": "audit-outcomes-exporter"},
}
# Metrics read as rates, as increases, and as instant values.
COUNTERS = (
    "kafka_broker_bytes_in_total", "kafka_broker_bytes_out_total", "kafka_broker_messages_in_total",
    "container_cpu_usage_seconds_total", "node_cpu_seconds_total",
)
OUTCOME_COUNTERS = (
    "audit_outcomes_total", "audit_batches_seen_total", "audit_replay_count_total", "audit_timeout_count_total",
    "audit_partition_outcomes_total",
)
INSTANTS = (
    "kafka_consumergroup_lag", "node_cpu_seconds_total", "jvm_process_cpu_load_ratio", "container_memory_usage_bytes",
    "jvm_heap_used_bytes", "jvm_non_heap_used_bytes", "node_memory_MemAvailable_bytes", "node_memory_MemTotal_bytes",
    *OUTCOME_COUNTERS,
)
# -----------------------------------------------------------------------------------------------


def default_selectors(containers: dict[str, str] = BROKER_CONTAINERS) -> list[S.Selector]:
    """A container belongs to a broker by its id, else by its service label, else by its name."""
    by_id = [S.Selector("id", path, broker) for broker, path in containers.items()]
    named = [S.Selector(src, "kafka-[0-9]+", "$1", "(kafka-[0-9]+)") for src in (SERVICE_LABEL, "name")]
    return by_id + named


def project_beans(raw: DataFrame) -> DataFrame:
    """Samples of the kept bean attributes (``source_name``) under their metric names."""
    names = raw.sparkSession.createDataFrame(BEAN_METRICS, "source_name string, metric string, kind string")
    # The name table is a constant of this module, hence the broadcast.
    return raw.join(F.broadcast(names), "source_name").select("metric", "labels", "ts", "value", "kind")


class Evaluation:
    """Samples seen on a grid. Rules ask it for rates, increases and instant values of one metric, and for other rules.

    With ``keep`` what several rules share is written once to the shared folder: the evaluated series (one row per series and grid
    point, however many samples lie behind them) and the rules that others read. ``plan`` finds out beforehand what is asked for,
    so that only metrics are evaluated that some rule reaches, and only what is shared is written.
    """

    def __init__(
        self,
        samples: DataFrame,
        grid: S.Grid,
        rate_window: str = "5 minutes",
        lookback: str = "5 minutes",
        selectors: list[S.Selector] | None = None,
        keep: bool = False,
        **split,
    ):
        self.samples, self.grid = samples, grid
        self.rate_window, self.lookback, self.split = rate_window, lookback, split
        self.selectors = default_selectors() if selectors is None else selectors
        self.keep = keep
        self._kept: dict[str, DataFrame] = {}
        self._rules: dict[str, DataFrame] = {}
        self._uses: Counter | None = None

    def plan(self, plans: Iterable[Callable[[Evaluation], DataFrame]]) -> None:
        """Learn what the plans ask for by making them on vectors without rows."""
        probe = _Probe(self)
        for make in plans:
            make(probe)
        before, self._uses = self._uses, probe.uses + (self._uses or Counter())
        # What was evaluated for an earlier plan may lack metrics of this one.
        for kind in {kind for kind, name in probe.uses if before is not None and not before[kind, name]}:
            self._kept.pop(kind, None)

    def _evaluated(self, name: str, metrics: tuple[str, ...], evaluate_: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """All metrics of one kind that are asked for in one pass; a later filter on metric or labels moves below it."""
        if name not in self._kept:
            asked = [m for m in metrics if self._uses is None or self._uses[name, m]]
            out = evaluate_(self.samples.where(F.col("metric").isin(*(asked or metrics))))
            shared = self._uses is None or sum(self._uses[name, m] for m in asked) > 1
            # In the order of metrics, so that a rule reads the row groups of its own.
            self._kept[name] = cut_lineage(out.sortWithinPartitions("metric")) if self.keep and shared else out
        return self._kept[name]

    def _pick(self, evaluated: DataFrame, metric: str, eq: dict[str, str] | None) -> DataFrame:
        rows = evaluated.where(F.col("metric") == metric)
        return (S.match_labels(rows, eq) if eq else rows).select("labels", "ts", "value")

    def rate(self, metric: str, eq: dict[str, str] | None = None) -> DataFrame:
        grown = self._evaluated(
            "rate", COUNTERS, lambda rows: S.rate(rows, self.rate_window, self.grid, **self.split))
        return self._pick(grown, metric, eq)

    def increase(self, metric: str, window: str, eq: dict[str, str] | None = None) -> DataFrame:
        grown = self._evaluated(
            f"increase {window}", OUTCOME_COUNTERS, lambda rows: S.increase(rows, window, self.grid, **self.split))
        return self._pick(grown, metric, eq)

    def instant(self, metric: str, eq: dict[str, str] | None = None) -> DataFrame:
        held = self._evaluated("instant", INSTANTS, lambda rows: S.instant(rows, self.grid, self.lookback))
        return self._pick(held, metric, eq)

    def rule(self, name: str) -> DataFrame:
        """The rule's vector, made once; written where several others read it."""
        if name not in self._rules:
            out = RULES[name](self)
            shared = self.keep and self._uses is not None and self._uses["rule", name] > 1
            self._rules[name] = cut_lineage(out) if shared else out
        return self._rules[name]

    def over(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Divide by a series without labels."""
        return S.vector_op(left, right, "/", on=[], points=self.grid.points)


class _Probe(Evaluation):
    """Stands in for an evaluation and counts what is asked of it; a rule asks for its inputs once."""

    def __init__(self, of: Evaluation):
        super().__init__(of.samples, of.grid, of.rate_window, of.lookback, of.selectors)
        self.uses: Counter = Counter()
        self._none = of.samples.sparkSession.createDataFrame([], "labels map<string,string>, ts timestamp, value double")

    def _asked(self, kind: str, metric: str) -> DataFrame:
        self.uses[kind, metric] += 1
        return self._none

    def rate(self, metric: str, eq: dict[str, str] | None = None) -> DataFrame:
        return self._asked("rate", metric)

    def increase(self, metric: str, window: str, eq: dict[str, str] | None = None) -> DataFrame:
        return self._asked(f"increase {window}", metric)

    def instant(self, metric: str, eq: dict[str, str] | None = None) -> DataFrame:
        return self._asked("instant", metric)

    def rule(self, name: str) -> DataFrame:
        self.uses["rule", name] += 1
        return RULES[name](self) if self.uses["rule", name] == 1 else self._none


def _throughput(e: Evaluation) -> DataFrame:
    return S.vector_op(e.rate("kafka_broker_bytes_in_total"), e.rate("kafka_broker_bytes_out_total"), "+")


def _broker_cpu(e: Evaluation) -> DataFrame:
    share = S.scale(e.rate("container_cpu_usage_seconds_total"), C.percent)
    return S.agg_by(S.relabelled_or(share, e.selectors, "broker"), "sum", ["broker"])


def _broker_memory(e: Evaluation) -> DataFrame:
    used = S.relabelled_or(e.instant("container_memory_usage_bytes"), e.selectors, "broker")
    return S.scale(S.agg_by(used, "sum", ["broker"]), C.mib)


def _cluster_memory(e: Evaluation) -> DataFrame:
    # Nothing is rewritten here, so "or" of the selections is the rows that any selector takes.
    chosen = reduce(lambda a, b: a | b, [C.matches(F.col("labels"), regex={s.label: s.regex}) for s in e.selectors])
    return S.scale(S.agg_by(e.instant("container_memory_usage_bytes").where(chosen), "sum"), C.gib)


def _host_memory(e: Evaluation) -> DataFrame:
    free = S.vector_op(e.instant("node_memory_MemAvailable_bytes"), e.instant("node_memory_MemTotal_bytes"), "/")
    return S.scale(free, lambda v: (1 - v) * 100)


RULES: dict[str, Callable[[Evaluation], DataFrame]] = {
    "kafka_broker_bytes_in_kb_per_sec":
        lambda e: S.scale(S.agg_by(e.rate("kafka_broker_bytes_in_total"), "sum", ["instance"]), C.kib),
    "kafka_broker_bytes_out_kb_per_sec":
        lambda e: S.scale(S.agg_by(e.rate("kafka_broker_bytes_out_total"), "sum", ["instance"]), C.kib),
    "kafka_broker_throughput_kb_per_sec":
        lambda e: S.scale(S.agg_by(_throughput(e), "sum", ["instance"]), C.kib),
    "kafka_cluster_bytes_in_kb_per_sec":
        lambda e: S.scale(S.agg_by(e.rate("kafka_broker_bytes_in_total"), "sum"), C.kib),
    "kafka_cluster_bytes_out_kb_per_sec":
        lambda e: S.scale(S.agg_by(e.rate("kafka_broker_bytes_out_total"), "sum"), C.kib),
    "kafka_cluster_throughput_bytes_per_sec": lambda e: S.agg_by(_throughput(e), "sum"),
    "kafka_cluster_messages_per_sec": lambda e: S.agg_by(e.rate("kafka_broker_messages_in_total"), "sum"),
    "kafka_cluster_consumer_lag_messages": lambda e: S.agg_by(e.instant("kafka_consumergroup_lag"), "sum"),
    "kafka_broker_cpu_percent": _broker_cpu,
    "kafka_cluster_cpu_percent": lambda e: S.agg_by(e.rule("kafka_broker_cpu_percent"), "sum"),
    "kafka_cluster_cpu_cores": lambda e: S.scale(e.rule("kafka_cluster_cpu_percent"), lambda v: v / 100),
    "kafka_host_cpu_cores": lambda e: S.count_groups(e.instant("node_cpu_seconds_total", {"mode": "idle"}), "cpu"),
    "kafka_cluster_cpu_host_percent":
        lambda e: e.over(e.rule("kafka_cluster_cpu_percent"), e.rule("kafka_host_cpu_cores")),
    "kafka_cluster_jvm_cpu_percent":
        lambda e: S.scale(S.agg_by(e.instant("jvm_process_cpu_load_ratio"), "avg"), C.percent),
    "kafka_broker_container_memory_mb": _broker_memory,
    "kafka_cluster_container_memory_gb": _cluster_memory,
    # Documented expressions that have no recorded name of their own.
    "jvm_heap_used_gb": lambda e: S.scale(S.agg_by(e.instant("jvm_heap_used_bytes"), "sum"), C.gib),
    "jvm_non_heap_used_gb": lambda e: S.scale(S.agg_by(e.instant("jvm_non_heap_used_bytes"), "sum"), C.gib),
    "host_cpu_busy_percent":
        lambda e: S.scale(S.agg_by(e.rate("node_cpu_seconds_total", {"mode": "idle"}), "avg"), lambda v: (1 - v) * 100),
    "host_memory_used_percent": _host_memory,
}


def _outcome_total(outcome: str) -> Callable[[Evaluation], DataFrame]:
    return lambda e: S.agg_by(e.instant("audit_outcomes_total", {"outcome": outcome}), "sum")


EXPORT_QUERIES: dict[str, Callable[[Evaluation], DataFrame]] = {
    "cluster_messages_per_sec": lambda e: e.rule("kafka_cluster_messages_per_sec"),
    "cluster_bytes_in_kb_per_sec": lambda e: e.rule("kafka_cluster_bytes_in_kb_per_sec"),
    "cluster_bytes_out_kb_per_sec": lambda e: e.rule("kafka_cluster_bytes_out_kb_per_sec"),
    "cluster_cpu_host_percent": lambda e: e.rule("kafka_cluster_cpu_host_percent"),
    "cluster_cpu_cores": lambda e: e.rule("kafka_cluster_cpu_cores"),
    "cluster_cpu_core_percent": lambda e: e.rule("kafka_cluster_cpu_percent"),
    "cluster_memory_gb": lambda e: e.rule("kafka_cluster_container_memory_gb"),
    **{f"audit_{o.lower()}_total": _outcome_total(o) for o in OUTCOMES},
    "audit_batches_seen_total": lambda e: S.agg_by(e.instant("audit_batches_seen_total"), "sum"),
}


def _mean_of(name: str, convert: Callable = lambda v: v) -> Callable[[Evaluation], DataFrame]:
    return lambda e: S.scale(S.agg_by(e.rule(name), "avg"), convert)


PANELS: dict[str, Callable[[Evaluation], DataFrame]] = {
    "outcomes_by_type": lambda e: S.agg_by(e.increase("audit_outcomes_total", "5 minutes"), "sum", ["outcome"]),
    "estimated_failure_rate": lambda e: e.over(
        S.agg_by(e.increase("audit_outcomes_total", "15 minutes", {"outcome": "ESTIMATED_FAILED"}), "sum"),
        S.agg_by(e.increase("audit_batches_seen_total", "15 minutes"), "sum"),
    ),
    "bytes_in_mb_per_sec": _mean_of("kafka_cluster_bytes_in_kb_per_sec", C.kib),
    "bytes_out_mb_per_sec": _mean_of("kafka_cluster_bytes_out_kb_per_sec", C.kib),
    "cpu_host_percent": _mean_of("kafka_cluster_cpu_host_percent"),
    "consumer_lag": lambda e: e.rule("kafka_cluster_consumer_lag_messages"),
    "memory_gb": _mean_of("kafka_cluster_container_memory_gb"),
}


def evaluate(e: Evaluation, plans: dict[str, Callable[[Evaluation], DataFrame]], names: list[str] | None = None) -> DataFrame:
    """The named plans as one table with a ``query`` column."""
    # A plan that is a rule is asked for as one, so that other rules share it.
    chosen = {name: (lambda e, n=name: e.rule(n)) if plans is RULES else plans[name] for name in (names or list(plans))}
    e.plan(chosen.values())
    parts = [make(e).select(F.lit(name).alias("query"), "labels", "ts", "value") for name, make in chosen.items()]
    return reduce(DataFrame.unionByName, parts)


def recorded(e: Evaluation, names: list[str] | None = None) -> DataFrame:
    """Recorded rules as samples, so that they can be stored and queried like scraped ones."""
    return evaluate(e, RULES, names).select(
        F.col("query").alias("metric"), "labels", "ts", "value", F.lit("gauge").alias("kind")
    )
