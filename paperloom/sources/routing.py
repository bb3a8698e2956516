"""User-registered transforms, tried by priority per document."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_PRIORITY = 100
UNROUTED = "no branch accepts the document"


@dataclass(frozen=True)
class Branch:
    """A named step with the predicate that says which rows it takes."""

    name: str
    accepts: Column
    transform: Callable[[DataFrame], DataFrame]
    priority: int = DEFAULT_PRIORITY


class TransformRegistry:
    """Branches in ascending priority; equal priorities keep their order."""

    def __init__(self) -> None:
        self._branches: list[Branch] = []

    def register(
        self,
        name: str,
        accepts: Column,
        transform: Callable[[DataFrame], DataFrame],
        priority: int = DEFAULT_PRIORITY,
    ) -> None:
        self._branches.append(Branch(name, accepts, transform, priority))
        self._branches.sort(key=lambda b: b.priority)

    @property
    def names(self) -> list[str]:
        return [b.name for b in self._branches]

    def branch(self) -> Column:
        """Name of the first branch that accepts a row, null if none does."""
        return F.coalesce(*[F.when(b.accepts, F.lit(b.name)) for b in self._branches], F.lit(None))

    def route(self, corpus: DataFrame) -> DataFrame:
        """Rows with the branch they go to; a null branch is a row nobody takes."""
        return corpus.withColumn("branch", self.branch())

    def convert(self, corpus: DataFrame, unrouted: str = "error") -> DataFrame:
        """Send every row through its branch and bring the results together.

        A row that no branch accepts is an error at run time; with ``unrouted="quarantine"`` it comes out as it went
        in, with a null branch and the reason in ``error``. No row is lost.
        """
        if unrouted not in ("error", "quarantine"):
            raise ValueError("unrouted is 'error' or 'quarantine'")
        routed = self.route(corpus)
        if unrouted == "error":
            refused = F.raise_error(F.lit(UNROUTED)).cast("string")
            routed = routed.withColumn("branch", F.coalesce("branch", refused))
        parts = []
        if unrouted == "quarantine":
            parts = [routed.filter(F.col("branch").isNull()).withColumn("error", F.lit(UNROUTED))]
        for b in self._branches:
            taken = b.transform(routed.filter(F.col("branch") == b.name).drop("branch"))
            parts.append(taken.withColumn("branch", F.lit(b.name)))
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)

    def convert_once(self, corpus: DataFrame, folder: str, unrouted: str = "error") -> DataFrame:
        """As ``convert``, with one read of the source.

        Rows are written to ``folder``, a part per branch, in the pass that decides their branch; every branch then reads
        its own part. So the source is scanned once and no predicate is evaluated twice for a row. ``folder`` must be
        shared by all executors; what is there is replaced.
        """
        if unrouted not in ("error", "quarantine"):
            raise ValueError("unrouted is 'error' or 'quarantine'")
        other = F.raise_error(F.lit(UNROUTED)).cast("string") if unrouted == "error" else F.lit("")
        names = {b.name: n for n, b in enumerate(self._branches)}  # numbers, as a name need not be good for a path
        branch = self.branch()
        number = F.create_map(*(F.lit(x) for kv in names.items() for x in kv)) if names else F.create_map().cast("map<string, int>")
        part = F.coalesce(F.element_at(number, F.coalesce(branch, other)), F.lit(-1))
        corpus.withColumn("_part", part).write.mode("overwrite").partitionBy("_part").parquet(folder)
        written = corpus.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in corpus.schema)}, _part int").parquet(folder)
        parts = []
        if unrouted == "quarantine":
            rest = written.filter("_part = -1").drop("_part")
            parts = [rest.withColumns({"branch": F.lit(None).cast("string"), "error": F.lit(UNROUTED)})]
        for b in self._branches:
            taken = b.transform(written.filter(F.col("_part") == names[b.name]).drop("_part"))
            parts.append(taken.withColumn("branch", F.lit(b.name)))
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
