"""An open log with its derived variables, functions and tables, and the jobs that run over it."""

from __future__ import annotations

import shutil
import threading
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.plans.derived import classify, dependency_order, dependents_of, needed
from tidemark.plans.expression import Compiler, ExpressionError, Registry, referenced_functions
from tidemark.sources.series import Series


@dataclass(frozen=True)
class Workspace:
    """Every change gives a new workspace or raises and changes nothing. Derived variables stay unevaluated until asked for."""

    series: Series
    derived: Mapping[str, str] = field(default_factory=dict)
    registry: Registry = field(default_factory=Registry)

    def _checked(self) -> Workspace:
        """Analyses every derived variable; nothing is computed."""
        names = {*self.series.signals, self.series.time_column, *self.derived}
        for name in dependency_order(self.derived):
            if name in self.series.signals or name == self.series.time_column:
                raise ExpressionError(f"{name} is a column already")
            Compiler({n: F.lit(0.0) for n in names - {name}}, self.registry).compile(self.derived[name])
        return self

    def put(self, name: str, text: str) -> Workspace:
        """Add or edit a derived variable; whatever depends on it follows."""
        return replace(self, derived={**self.derived, name: text})._checked()

    def drop(self, name: str) -> Workspace:
        """Remove a derived variable that no other reads."""
        users = dependents_of(name, self.derived)
        if users:
            raise ExpressionError(f"{name} is read by {', '.join(users)}")
        return replace(self, derived={n: t for n, t in self.derived.items() if n != name})

    def with_registry(self, registry: Registry) -> Workspace:
        """New functions and tables, if every derived variable still compiles."""
        return replace(self, registry=registry)._checked()

    def users_of(self, function: str) -> list[str]:
        """Derived variables that call a function or table, directly or through other functions."""
        calls = {f.name: referenced_functions(f.body) for f in self.registry.functions.values()}
        reach, open_ = {function}, [function]
        while open_:
            name = open_.pop()
            more = {f for f, below in calls.items() if name in below} - reach
            reach |= more
            open_ += more
        return [n for n, t in self.derived.items() if referenced_functions(t) & reach]

    def problems(self) -> dict[str, str | None]:
        return classify(self.derived, self.series.signals, self.series.time_column, registry=self.registry)

    def view(self, *names: str) -> Series:
        """The named signals and derived variables as one plan; of the derived only what they need."""
        used = needed(self.derived, names)
        made = self.series.derive({n: self.derived[n] for n in used}, self.registry) if used else self.series
        return made.select(*names)


class Jobs:
    """Work in background threads, each in a Spark job group of its own, so that it can be cancelled.

    Each job ends in exactly one of its future's outcomes. A job of a kind that was begun again since is stale: ``latest``
    tells.
    """

    def __init__(self, spark: SparkSession, parallel: int = 4):
        self.spark = spark
        self.pool = ThreadPoolExecutor(max(1, parallel))
        self.groups: dict[Future, str] = {}
        self.generation: dict[str, int] = {}
        self.lock = threading.Lock()

    def submit(self, work: Callable[[], object], kind: str = "job") -> Future:
        group = f"tidemark-{uuid.uuid4().hex}"
        with self.lock:
            mine = self.generation[kind] = self.generation.get(kind, 0) + 1

        def run() -> object:
            self.spark.addTag(group)
            try:
                return work()
            finally:
                self.spark.removeTag(group)

        future = self.pool.submit(run)
        future.kind, future.generation = kind, mine
        self.groups[future] = group
        return future

    def latest(self, future: Future) -> bool:
        return self.generation.get(future.kind) == future.generation

    def cancel(self, future: Future) -> None:
        """A waiting job never starts; a running one's Spark jobs are cancelled."""
        if not future.cancel():
            self.spark.interruptTag(self.groups[future])

    def close(self) -> None:
        self.pool.shutdown(wait=False, cancel_futures=True)


@dataclass
class Request:
    """One export that waits: the bytes it will need of a volume and where it goes."""

    target: str
    volume: str
    n_bytes: int
    state: str = "waiting"
    memory: int = 0


class Queue:
    """First come, first served, ``parallel`` at a time; only the head may start.

    The head waits while its target is being written, its volume lacks room for all that run there, or the memory of all that
    run would be above the budget; alone it may have more. Two failures for lack of room stop what is left.
    """

    def __init__(self, parallel: int = 2, margin: int = 100 << 20, free: Callable[[str], int] | None = None, memory: int | None = None):
        self.parallel, self.margin, self.memory = parallel, margin, memory
        self.free = free or (lambda volume: shutil.disk_usage(volume).free)
        self.items: list[Request] = []
        self.full = 0

    def add(self, request: Request) -> Request:
        self.items.append(request)
        return request

    def running(self) -> list[Request]:
        return [r for r in self.items if r.state == "running"]

    def start_next(self) -> Request | None:
        """The head, now running; None if it has to wait."""
        head = next((r for r in self.items if r.state == "waiting"), None)
        busy = self.running()
        if head is None or len(busy) >= self.parallel or any(r.target == head.target for r in busy):
            return None
        if busy and self.memory is not None and head.memory + sum(r.memory for r in busy) > self.memory:
            return None
        asked = head.n_bytes + sum(r.n_bytes for r in busy if r.volume == head.volume)
        if asked + self.margin > self.free(head.volume):
            if not busy:
                self.finish(head, "no_room")
                return self.start_next()
            return None
        head.state = "running"
        return head

    def finish(self, request: Request, state: str = "done") -> None:
        request.state = state
        self.full += state == "no_room"
        if self.full >= 2:
            for r in self.items:
                if r.state == "waiting":
                    r.state = "stopped"

    def cancel(self, request: Request) -> None:
        if request.state in ("waiting", "running"):
            request.state = "cancelled"
