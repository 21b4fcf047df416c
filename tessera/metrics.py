"""What queries took, by their shape; what that says; and a page to look at it."""

from __future__ import annotations

import contextlib
import datetime as dt
import html
import http.server
import json
import math
import os
import re
import threading
import time
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from enum import Enum
from typing import Any


def shape(sql: str) -> str:
    """A statement without its literals, so that those which differ by values alone count as one."""
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)
    bare = re.sub(r"'(?:[^']|'')*'", "?", bare)
    bare = re.sub(r"(?<![\w`\"])[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?\b", "?", bare)
    bare = re.sub(r"\(\s*\?(?:\s*,\s*\?)+\s*\)", "(?)", bare)
    return " ".join(bare.split())


class Timer:
    """A histogram of durations: sixteen steps to every doubling, so that quantiles are right to a few per cent."""

    STEPS = 16

    def __init__(self):
        self.count, self.total, self.most = 0, 0.0, 0.0
        self.buckets: dict[int, int] = defaultdict(int)

    def add(self, seconds: float) -> None:
        self.count += 1
        self.total += seconds
        self.most = max(self.most, seconds)
        self.buckets[math.floor(math.log2(max(seconds, 1e-9)) * self.STEPS)] += 1

    def quantile(self, q: float) -> float:
        if not self.count:
            return 0.0
        left = q * self.count
        for b in sorted(self.buckets):
            left -= self.buckets[b]
            if left <= 0:
                return min(self.most, 2 ** ((b + 0.5) / self.STEPS))
        return self.most

    def minus(self, other: Timer) -> Timer:
        out = Timer()
        out.count, out.total, out.most = self.count - other.count, self.total - other.total, self.most
        for b, n in self.buckets.items():
            if n - other.buckets.get(b, 0):
                out.buckets[b] = n - other.buckets.get(b, 0)
        return out

    def copy(self) -> Timer:
        return self.minus(Timer())


@dataclass
class Snapshot:
    at: float
    timers: dict[str, Timer]
    counters: dict[str, int]
    gauges: dict[str, float]

    def minus(self, before: Snapshot) -> Snapshot:
        """What happened since an earlier snapshot."""
        timers = {k: t.minus(before.timers.get(k, Timer())) for k, t in self.timers.items()}
        counters = {k: n - before.counters.get(k, 0) for k, n in self.counters.items()}
        return Snapshot(self.at - before.at, {k: t for k, t in timers.items() if t.count}, {k: n for k, n in counters.items() if n}, self.gauges)

    def as_dict(self) -> dict[str, Any]:
        timers = {k: {"count": t.count, "total": t.total, "p50": t.quantile(0.5), "p99": t.quantile(0.99), "max": t.most} for k, t in self.timers.items()}
        return {"at": self.at, "timers": timers, "counters": self.counters, "gauges": self.gauges}


class Metrics:
    def __init__(self):
        self._lock = threading.Lock()
        self._timers: dict[str, Timer] = defaultdict(Timer)
        self._counters: dict[str, int] = defaultdict(int)
        self._gauges: dict[str, Any] = {}

    @contextlib.contextmanager
    def timed(self, sql: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        except Exception:
            self.count("errors")
            raise
        finally:
            with self._lock:
                self._timers[shape(sql)].add(time.perf_counter() - began)
            self.count("statements")

    def count(self, name: str, n: int = 1) -> None:
        with self._lock:
            self._counters[name] += n

    def gauge(self, name: str, value: Any) -> None:
        """A value, or a function that gives it when a snapshot is taken."""
        self._gauges[name] = value

    def snapshot(self) -> Snapshot:
        gauges = {k: float(v() if callable(v) else v) for k, v in self._gauges.items()}
        with self._lock:
            return Snapshot(time.time(), {k: t.copy() for k, t in self._timers.items()}, dict(self._counters), gauges)


class Cause(Enum):
    """What Spark and the store show of why statements are slow or fail."""

    SPILL = "sorts and aggregates spill to disk: use more, smaller partitions"
    GARBAGE = "tasks spend their time collecting garbage: give executors memory"
    FAILED_TASKS = "tasks fail and run again: executors are lost or code raises"
    FULL_CLUSTER = "all cores are taken"
    LOST_RACES = "changes of tables are made again because others were faster"
    FAILING = "many statements fail"


#: Cause, the ratio that tells it (a counter or gauge over another), and from what value on. ``Sampler`` feeds those of
#: tasks and cores, ``Store.metrics`` those of changes, ``timed`` those of statements.
RULES = (
    (Cause.SPILL, "spilled_bytes", "task_bytes", 0.5),
    (Cause.GARBAGE, "gc_ms", "task_ms", 0.2),
    (Cause.FAILED_TASKS, "failed_tasks", "tasks", 0.02),
    (Cause.FULL_CLUSTER, "busy_cores", "cores", 0.9),
    (Cause.LOST_RACES, "lost_races", "changes", 0.1),
    (Cause.FAILING, "errors", "statements", 0.05),
)


@dataclass(frozen=True)
class Finding:
    cause: Cause
    value: float
    limit: float


def diagnose(s: Snapshot, least: int = 20) -> list[Finding]:
    """Causes whose ratios are over their limits, worst first; nothing for fewer than ``least`` statements."""
    seen = {**s.gauges, **s.counters}
    if seen.get("statements", 0) < least:
        return []
    found = [Finding(c, seen.get(a, 0) / seen[b], limit) for c, a, b, limit in RULES if seen.get(b)]
    return sorted((f for f in found if f.value >= f.limit), key=lambda f: -f.value / f.limit)


@dataclass(frozen=True)
class QueryProfile:
    """What the operators of a query that ran gave."""

    operators: list[tuple[str, dict[str, str]]] = field(default_factory=list)

    @classmethod
    def of(cls, df) -> QueryProfile:
        """Runs a query to its last row and reads the metrics of its plan's nodes."""
        execution = df._jdf.queryExecution()
        execution.toRdd().count()
        out = []

        def walk(node, depth: int) -> None:
            if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
                walk(node.executedPlan(), depth)
                return
            values, it = {}, node.metrics().iterator()
            while it.hasNext():
                pair = it.next()
                values[pair._1()] = str(pair._2().value())
            out.append(("  " * depth + node.nodeName(), values))
            inner = node.plan() if node.getClass().getSimpleName().endswith("QueryStageExec") else None
            if inner is not None:
                walk(inner, depth + 1)
            for i in range(node.children().size()):
                walk(node.children().apply(i), depth + 1)

        walk(execution.executedPlan(), 0)
        return cls(out)


class Sampler:
    """Gauges of this machine and the driver's JVM, and what other processes take."""

    def __init__(self, spark, metrics: Metrics):
        runtime = spark._jvm.java.lang.Runtime.getRuntime()
        metrics.gauge("cores", os.cpu_count() or 1)
        metrics.gauge("busy_cores", lambda: os.getloadavg()[0])
        metrics.gauge("heap_used", lambda: runtime.totalMemory() - runtime.freeMemory())
        metrics.gauge("heap_most", lambda: runtime.maxMemory())
        metrics.gauge("active_jobs", lambda: len(spark.sparkContext.statusTracker().getActiveJobsIds()))
        status = spark._jsc.sc().statusStore()

        def over_executors(value):
            def total() -> float:
                found, out = status.executorList(False), 0
                for i in range(found.size()):
                    out += value(found.apply(i))
                return float(out)

            return total

        metrics.gauge("tasks", over_executors(lambda e: e.totalTasks()))
        metrics.gauge("failed_tasks", over_executors(lambda e: e.failedTasks()))
        metrics.gauge("task_ms", over_executors(lambda e: e.totalDuration()))
        metrics.gauge("gc_ms", over_executors(lambda e: e.totalGCTime()))
        metrics.gauge("task_bytes", over_executors(lambda e: e.totalInputBytes() + e.totalShuffleRead()))

        def spilled() -> float:
            stages, out = status.stageList(None), 0
            for i in range(stages.size()):
                out += stages.apply(i).diskBytesSpilled()
            return float(out)

        metrics.gauge("spilled_bytes", spilled)

    @staticmethod
    def other_processes(most: int = 5) -> list[tuple[int, str, float]]:
        """(process, name, CPU seconds so far) of those that took most, where the system tells."""
        ticks, found = os.sysconf("SC_CLK_TCK"), []
        for pid in filter(str.isdigit, os.listdir("/proc") if os.path.isdir("/proc") else []):
            with contextlib.suppress(OSError):
                text = open(f"/proc/{pid}/stat", encoding="utf-8", errors="replace").read()
                name, rest = text[text.index("(") + 1 : text.rindex(")")], text[text.rindex(")") + 2 :].split()
                if int(pid) != os.getpid():
                    found.append((int(pid), name, (int(rest[11]) + int(rest[12])) / ticks))
        return sorted(found, key=lambda x: -x[2])[:most]


class Recorder:
    """Writes snapshots as lines of JSON, a file per day, and deletes old days."""

    def __init__(self, folder: str, keep_days: int = 14):
        self.folder, self.keep_days = folder, keep_days
        os.makedirs(folder, exist_ok=True)

    def write(self, s: Snapshot, day: dt.date | None = None) -> str:
        path = os.path.join(self.folder, f"metrics-{day or dt.date.today()}.jsonl")
        with open(path, "a", encoding="utf-8") as f:
            f.write(json.dumps(s.as_dict()) + "\n")
        return path

    def delete_expired(self, today: dt.date | None = None) -> list[str]:
        limit, gone = (today or dt.date.today()) - dt.timedelta(days=self.keep_days), []
        for name in sorted(os.listdir(self.folder)):
            m = re.fullmatch(r"metrics-(\d{4}-\d\d-\d\d)\.jsonl", name)
            if m and dt.date.fromisoformat(m[1]) < limit:
                os.remove(os.path.join(self.folder, name))
                gone.append(name)
        return gone


def page(s: Snapshot) -> str:
    """The dashboard as HTML."""
    rows = "".join(
        f"<tr><td>{html.escape(k)}</td><td>{t.count}</td><td>{t.quantile(0.5) * 1000:.1f}</td><td>{t.quantile(0.99) * 1000:.1f}</td><td>{t.most * 1000:.1f}</td></tr>"
        for k, t in sorted(s.timers.items(), key=lambda kv: -kv[1].total)
    )
    findings = "".join(f"<li>{html.escape(f.cause.value)} ({f.value:.2f}, limit {f.limit:g})</li>" for f in diagnose(s))
    counters = "".join(f"<li>{html.escape(k)}: {v:g}</li>" for k, v in sorted({**s.counters, **s.gauges}.items()))
    return f"<!DOCTYPE html><meta charset=utf-8><title>Queries</title><h1>Queries</h1><ul>{findings}</ul><table><tr><th>statement<th>runs<th>p50 ms<th>p99 ms<th>max ms</tr>{rows}</table><ul>{counters}</ul>"


class Dashboard:
    """Serves the page, ``/metrics.json`` and ``/processes.json`` on this machine. With a recorder, a snapshot of what
    happened since the last one is written every ``every`` seconds, and old days are deleted."""

    def __init__(self, metrics: Metrics, port: int = 0, recorder: Recorder | None = None, every: float = 60.0):
        self._closed, self._written, self._recording = threading.Event(), 0, None
        if recorder is not None:
            self._recording = threading.Thread(target=self._record, args=(metrics, recorder, every), daemon=True)
            self._recording.start()

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self) -> None:
                s = metrics.snapshot()
                as_json = self.path.endswith(".json")
                shown = Sampler.other_processes() if self.path == "/processes.json" else s.as_dict()
                body = (json.dumps(shown) if as_json else page(s)).encode()
                self.send_response(200)
                self.send_header("Content-Type", "application/json" if as_json else "text/html; charset=utf-8")
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *args: Any) -> None:
                pass

        self._server = http.server.ThreadingHTTPServer(("127.0.0.1", port), Handler)
        self.port = self._server.server_address[1]
        threading.Thread(target=self._server.serve_forever, daemon=True).start()

    def recorded(self) -> int:
        """Statements that the recorder has written, once it has ended."""
        if self._recording is not None:
            self._recording.join()
        return self._written

    def _record(self, metrics: Metrics, recorder: Recorder, every: float) -> None:
        before = metrics.snapshot()
        while True:
            over = self._closed.wait(every)
            now = metrics.snapshot()
            recorder.write(now.minus(before))
            self._written += now.minus(before).counters.get("statements", 0)
            recorder.delete_expired()
            before = now
            if over:
                return

    def close(self) -> None:
        self._closed.set()
        self._server.shutdown()
        self._server.server_close()
