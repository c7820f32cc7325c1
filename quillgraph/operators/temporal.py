"""History: a log of commits and changes, queried as of a commit or over a window of them.

commits(commit_id, parents array, ts, author, message, branch)
changes(commit_id, entity: node | edge, op: add | remove | set, id, source, target, attr, value)

Commit ids grow with time.  A state is a query over the log: nothing is replayed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.operators.graph import Graph
from quillgraph.plans.staging import cut

#: Commits whose parents the driver takes.
DRIVER_COMMITS = 1_000_000

COMMITS = "commit_id long, parents array<long>, ts long, author string, message string, branch string"
CHANGES = "commit_id long, entity string, op string, id long, source long, target long, attr string, value string"


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a plan of constants, which no Python worker has to read."""
    cols = [c.strip().split(" ", 1) for c in schema.split(",")]
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in cols])
    put = lambda v, t: F.array(*[F.lit(x) for x in v]).cast(t) if isinstance(v, list) else F.lit(v).cast(t)
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[put(v, t).alias(n) for (n, t), v in zip(cols, r, strict=True)]) for r in rows])))


@dataclass(frozen=True)
class History:
    commits: DataFrame
    changes: DataFrame

    # --- writing ---

    def commit(self, changes: DataFrame, author: str = "", message: str = "", branch: str = "main", ts: int = 0, parents: list[int] | None = None) -> History:
        """The log with one more commit of the given changes (without commit_id)."""
        spark = self.commits.sparkSession
        top = self.commits.agg(F.coalesce(F.max("commit_id"), F.lit(-1))).first()[0]
        head = self.head(branch)
        row = values(spark, [(top + 1, parents if parents is not None else ([] if head is None else [head]), ts, author, message, branch)], COMMITS)
        return History(self.commits.unionByName(row), self.changes.unionByName(changes.withColumn("commit_id", F.lit(top + 1).cast("long")), allowMissingColumns=True))

    def head(self, branch: str = "main") -> int | None:
        return self.commits.where(F.col("branch") == branch).agg(F.max("commit_id")).first()[0]

    def branches(self) -> DataFrame:
        return self.commits.groupBy("branch").agg(F.max("commit_id").alias("head"))

    # --- the commit graph ---

    def ancestors(self, commit: int) -> DataFrame:
        """(commit_id) of a commit and all it stems from.

        Lines of commits are long and thin: up to ``DRIVER_COMMITS`` they are followed on the driver, which
        gets two numbers a commit; beyond, a generation a round.
        """
        spark = self.commits.sparkSession
        up = self.commits.select("commit_id", "parents")
        if up.limit(DRIVER_COMMITS + 1).count() <= DRIVER_COMMITS:
            parents = {r[0]: r[1] or () for r in up.collect()}
            seen, stack = set(), [commit]
            while stack:
                c = stack.pop()
                if c in parents and c not in seen:
                    seen.add(c)
                    stack += parents[c]
            return values(spark, [(c,) for c in sorted(seen)], "commit_id long") if len(seen) <= 1000 else spark.createDataFrame([(c,) for c in sorted(seen)], "commit_id long")
        up = cut(up.select("commit_id", F.explode("parents").alias("parent")), "history")
        known = front = self.commits.where(F.col("commit_id") == commit).select("commit_id")
        while True:
            step = front.join(up, "commit_id").select(F.col("parent").alias("commit_id")).distinct().join(self.commits, "commit_id", "left_semi")
            front = cut(step.join(known, "commit_id", "left_anti"), "history")
            if front.isEmpty():
                return known
            known = cut(known.unionByName(front), "history")

    def is_ancestor(self, a: int, b: int) -> bool:
        return not self.ancestors(b).where(F.col("commit_id") == a).isEmpty()

    def common_ancestor(self, a: int, b: int) -> int | None:
        return self.ancestors(a).intersect(self.ancestors(b)).agg(F.max("commit_id")).first()[0]

    def collect_garbage(self, heads: list[int]) -> History:
        """Only what some head stems from."""
        keep = None
        for h in heads:
            keep = self.ancestors(h) if keep is None else keep.union(self.ancestors(h)).distinct()
        return History(self.commits.join(keep, "commit_id", "left_semi"), self.changes.join(keep, "commit_id", "left_semi"))

    def commit_at(self, ts: int) -> int | None:
        """The latest commit at or before a time."""
        return self.commits.where(F.col("ts") <= ts).agg(F.max("commit_id")).first()[0]

    def commits_between(self, since: int, until: int) -> DataFrame:
        """Commits of a range of times, both ends included."""
        return self.commits.where(F.col("ts").between(since, until))

    # --- lifetimes and values ---

    def lifetimes(self, entity: str = "node") -> DataFrame:
        """(id, source, target, created, deleted): one row for each life of an entity."""
        log = self.changes.where((F.col("entity") == entity) & F.col("op").isin("add", "remove"))
        w = Window.partitionBy("id").orderBy("commit_id")
        nxt = log.withColumn("deleted", F.lead("commit_id").over(w))
        return nxt.where("op = 'add'").select("id", "source", "target", F.col("commit_id").alias("created"), "deleted")

    def alive_at(self, commit: int, entity: str = "node") -> DataFrame:
        """created <= commit < deleted."""
        return self.lifetimes(entity).where((F.col("created") <= commit) & (F.col("deleted").isNull() | (F.col("deleted") > commit)))

    def alive_in(self, start: int, end: int, entity: str = "node") -> DataFrame:
        """Lives that overlap [start, end]; one that ended exactly at the start counts."""
        return self.lifetimes(entity).where((F.col("created") <= end) & (F.col("deleted").isNull() | (F.col("deleted") >= start)))

    def values_at(self, commit: int, entity: str = "node") -> DataFrame:
        """(id, attr, value): the latest value of each attribute."""
        log = self.changes.where((F.col("entity") == entity) & (F.col("op") == "set") & (F.col("commit_id") <= commit))
        return log.groupBy("id", "attr").agg(F.max_by("value", "commit_id").alias("value"))

    def value_history(self, id: int, attr: str, start: int = 0, end: int = 1 << 62, entity: str = "node") -> DataFrame:
        log = self.changes.where((F.col("entity") == entity) & (F.col("op") == "set") & (F.col("id") == id) & (F.col("attr") == attr))
        return log.where(F.col("commit_id").between(start, end)).select("commit_id", "value")

    def as_of(self, asks: DataFrame, entity: str = "node") -> DataFrame:
        """Per row of (id, attr, commit_id): the value then.  Asks and changes meet in one sorted pass."""
        log = self.changes.where((F.col("entity") == entity) & (F.col("op") == "set")).select("id", "attr", "commit_id", "value", F.lit(0).alias("asked"))
        ask = asks.select("id", "attr", "commit_id", F.lit(None).cast("string").alias("value"), F.lit(1).alias("asked"))
        w = Window.partitionBy("id", "attr").orderBy("commit_id", "asked").rowsBetween(Window.unboundedPreceding, 0)
        seen = log.unionByName(ask).withColumn("value", F.last(F.when(F.col("asked") == 0, F.struct("value"))  , True).over(w)["value"])
        return seen.where("asked = 1").drop("asked")

    def snapshot(self, commit: int, directed: bool = False) -> Graph:
        """The graph as of a commit, attributes as text columns."""
        values = lambda e: self.values_at(commit, e)

        def wide(base: DataFrame, entity: str, key: str) -> DataFrame:
            v = values(entity)
            names = [r[0] for r in v.select("attr").distinct().orderBy("attr").collect()]
            if not names:
                return base
            return base.join(v.groupBy(F.col("id").alias(key)).pivot("attr", names).agg(F.first("value")), key, "left")

        nodes = wide(self.alive_at(commit, "node").select(F.col("id").alias("node_id")), "node", "node_id")
        edges = wide(self.alive_at(commit, "edge").select(F.col("id").alias("edge_id"), "source", "target"), "edge", "edge_id")
        return Graph(nodes, edges, directed)

    def neighbors_at(self, commit: int, direction: str = "both") -> DataFrame:
        return Graph(self.alive_at(commit, "node").select(F.col("id").alias("node_id")), self.alive_at(commit, "edge").select(F.col("id").alias("edge_id"), "source", "target")).neighbors(direction=direction)

    def neighbors_in(self, start: int, end: int, direction: str = "both") -> DataFrame:
        e = self.alive_in(start, end, "edge").select(F.col("id").alias("edge_id"), "source", "target")
        return Graph(e.select(F.explode(F.array("source", "target")).alias("node_id")).distinct(), e).neighbors(direction=direction)

    # --- differences and windows ---

    def diff(self, a: int, b: int, entity: str = "node") -> DataFrame:
        """(id, change): added, removed or changed between two commits."""
        x, y = (self.alive_at(c, entity).select("id").withColumn(n, F.lit(True)) for c, n in ((a, "x"), (b, "y")))
        both = x.join(y, "id", "full")
        vx, vy = self.values_at(a, entity), self.values_at(b, entity).withColumnRenamed("value", "new")
        moved = vx.join(vy, ["id", "attr"], "full").where(~F.col("value").eqNullSafe(F.col("new"))).select("id").distinct().withColumn("m", F.lit(True))
        kind = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("m"), "changed")
        return both.join(moved, "id", "left").select("id", kind.alias("change")).where("change IS NOT NULL")

    def changed(self, start: int, end: int) -> DataFrame:
        """(entity, id, kinds) touched in a window of commits."""
        return self.changes.where(F.col("commit_id").between(start, end)).groupBy("entity", "id").agg(F.array_sort(F.collect_set("op")).alias("kinds"))

    def window_aggregate(self, attr: str, start: int, end: int, how: str, entity: str = "node") -> DataFrame:
        """(id, value): count, first, last, sum, mean, min or max of an attribute's values in a window."""
        log = self.changes.where((F.col("entity") == entity) & (F.col("op") == "set") & (F.col("attr") == attr) & F.col("commit_id").between(start, end))
        x = F.col("value").try_cast("double")
        f = {"count": F.count("value").cast("double"), "first": F.min_by(x, "commit_id"), "last": F.max_by(x, "commit_id"), "sum": F.sum(x), "mean": F.avg(x), "min": F.min(x), "max": F.max(x)}[how]
        return log.groupBy("id").agg(f.alias("value"))

    def decayed(self, attr: str, at: int, half_life: float, entity: str = "node") -> DataFrame:
        """(id, value): values halved for every ``half_life`` commits of age, summed."""
        log = self.changes.where((F.col("entity") == entity) & (F.col("op") == "set") & (F.col("attr") == attr) & (F.col("commit_id") <= at))
        age = (F.lit(at) - F.col("commit_id")) / half_life
        return log.groupBy("id").agg(F.sum(F.col("value").try_cast("double") * F.pow(F.lit(0.5), age)).alias("value"))

    def statistics(self) -> DataFrame:
        """One row: commits, changes, entities."""
        c = self.commits.agg(F.count(F.lit(1)).alias("commits"))
        return c.crossJoin(F.broadcast(self.changes.agg(F.count(F.lit(1)).alias("changes"), F.count_distinct("entity", "id").alias("entities"))))


@dataclass
class Repository:
    """A history with branches as pointers, a current branch, and changes that aren't committed yet.

    Branches are few and live on the driver; commits and changes are frames.
    """

    history: History
    refs: dict[str, int | None]
    current: str = "main"
    pending: DataFrame | None = None

    @classmethod
    def of(cls, history: History) -> Repository:
        """Branches as the commits name them, each at its last commit."""
        refs = {r["branch"]: r["head"] for r in history.branches().collect()}
        return cls(history, refs or {"main": None})

    @property
    def head(self) -> int | None:
        return self.refs[self.current]

    # --- branches ---

    def create_branch(self, name: str, at: int | None = None) -> None:
        """A new pointer at a commit (the current head), without a commit of its own."""
        if name in self.refs:
            raise ValueError(f"there is a branch {name!r}")
        if at is not None and self.history.commits.where(F.col("commit_id") == at).isEmpty():
            raise ValueError(f"there is no commit {at}")
        self.refs[name] = self.head if at is None else at

    def checkout(self, name: str) -> int | None:
        """The branch that further commits go to; changes that aren't committed forbid it."""
        if name not in self.refs:
            raise ValueError(f"there is no branch {name!r}")
        if self.has_uncommitted_changes():
            raise ValueError("there are uncommitted changes")
        self.current = name
        return self.head

    def delete_branch(self, name: str) -> None:
        if name == self.current or name not in self.refs:
            raise ValueError(f"{name!r} is the current branch" if name == self.current else f"there is no branch {name!r}")
        del self.refs[name]

    def update_branch_head(self, name: str, commit: int) -> None:
        if self.history.commits.where(F.col("commit_id") == commit).isEmpty():
            raise ValueError(f"there is no commit {commit}")
        self.refs[name] = commit

    def branches(self) -> DataFrame:
        """(branch, head, current)."""
        return values(self.history.commits.sparkSession, [(b, h, b == self.current) for b, h in sorted(self.refs.items())], "branch string, head long, current boolean")

    # --- changes ---

    def stage(self, changes: DataFrame) -> None:
        """Changes (without commit_id) for the next commit."""
        self.pending = changes if self.pending is None else self.pending.unionByName(changes, allowMissingColumns=True)

    def has_uncommitted_changes(self) -> bool:
        return self.pending is not None and not self.pending.isEmpty()

    def reset_hard(self, commit: int | None = None) -> None:
        """Forget staged changes, and move the current branch to a commit if one is given."""
        self.pending = None
        if commit is not None:
            self.update_branch_head(self.current, commit)

    def commit(self, author: str = "", message: str = "", ts: int = 0) -> int:
        """The staged changes as a commit after the head."""
        changes = self.pending if self.pending is not None else self.history.changes.where(F.lit(False)).drop("commit_id")
        return self._commit(changes, author, message, ts, [] if self.head is None else [self.head])

    def merge(self, other: str, author: str = "", message: str = "", ts: int = 0) -> int:
        """A commit of the current branch with both heads as parents, bringing what the other branch changed
        since they parted; where both set a value, the other's stands."""
        a, b = self.head, self.refs[other]
        base = self.history.common_ancestor(a, b)
        since = self.history.ancestors(b)
        if base is not None:
            since = since.join(self.history.ancestors(base), "commit_id", "left_anti")
        brought = self.history.changes.join(since, "commit_id", "left_semi")
        key = ["entity", "id", F.coalesce("attr", F.lit(""))]
        last = Window.partitionBy(*key).orderBy(F.desc("commit_id"))
        brought = brought.withColumn("__k", F.row_number().over(last)).where("__k = 1").drop("__k", "commit_id")
        return self._commit(brought, author, message, ts, [a, b])

    def _commit(self, changes: DataFrame, author: str, message: str, ts: int, parents: list[int]) -> int:
        self.history = self.history.commit(changes, author, message, self.current, ts, parents)
        self.pending = None
        self.refs[self.current] = self.history.commits.agg(F.max("commit_id")).first()[0]
        return self.refs[self.current]

    # --- looking back ---

    def log(self, branch: str | None = None) -> DataFrame:
        """Commits that a branch stems from, latest first."""
        head = self.refs[branch or self.current]
        kept = self.history.commits if head is None else self.history.commits.join(self.history.ancestors(head), "commit_id", "left_semi")
        return (kept.where(F.lit(False)) if head is None else kept).orderBy(F.desc("commit_id"))

    def line(self, commit: int | None = None) -> History:
        """The history as one branch sees it: only what a commit (the head) stems from."""
        at = self.head if commit is None else commit
        kept = self.history.ancestors(at)
        return History(self.history.commits.join(kept, "commit_id", "left_semi"), self.history.changes.join(kept, "commit_id", "left_semi"))

    def snapshot(self, commit: int | None = None, directed: bool = False) -> Graph:
        """The graph as of a commit on its own line, whatever other branches did before it."""
        at = self.head if commit is None else commit
        return self.line(at).snapshot(at, directed)


@dataclass(frozen=True)
class Scope:
    """A window of commits or of times that queries share."""

    history: History
    start: int
    end: int

    @classmethod
    def between(cls, history: History, since: int, until: int) -> Scope:
        """From the first commit at or after a time to the last at or before another."""
        first = history.commits_between(since, until).agg(F.min("commit_id"), F.max("commit_id")).first()
        return cls(history, first[0] if first[0] is not None else 0, first[1] if first[1] is not None else -1)

    def nodes(self) -> DataFrame:
        return self.history.alive_in(self.start, self.end, "node")

    def edges(self) -> DataFrame:
        return self.history.alive_in(self.start, self.end, "edge")

    def changed(self) -> DataFrame:
        return self.history.changed(self.start, self.end)

    def aggregate(self, attr: str, how: str, entity: str = "node") -> DataFrame:
        return self.history.window_aggregate(attr, self.start, self.end, how, entity)


def from_log(spark, commits: list[tuple], changes: list[tuple]) -> History:
    return History(spark.createDataFrame(commits, COMMITS), spark.createDataFrame(changes, CHANGES))
