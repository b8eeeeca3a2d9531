"""Metrics and scores of one's own: a registry with dependencies in order and a hash, and scoring by a Column, a function or a pandas UDF."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchforge.functions import derived

EVIDENCE = ("matchups", "minutes")


@dataclass(frozen=True)
class Metric:
    """A metric: `fn` makes its Column from the Columns of `deps`; `evidence` is what its values are weighed by; `source` where they come from."""

    name: str
    fn: Callable[..., Column]
    deps: tuple[str, ...]
    evidence: str = "matchups"
    source: str = "user"


@dataclass
class MetricRegistry:
    """Metrics by name. Dependencies may be columns, other metrics, or metrics of the library."""

    metrics: dict[str, Metric] = field(default_factory=dict)

    def register(self, name: str, fn: Callable[..., Column], deps: list[str], evidence: str = "matchups", source: str = "user") -> Metric:
        if evidence not in EVIDENCE:
            raise ValueError(f"evidence is one of {', '.join(EVIDENCE)}")
        if name in self.metrics or name in derived.NAMES:
            raise ValueError(f"{name} is registered already")
        self.metrics[name] = Metric(name, fn, tuple(deps), evidence, source)
        try:
            self.order([name])
        except ValueError:
            del self.metrics[name]
            raise
        return self.metrics[name]

    def order(self, names: list[str] | None = None) -> list[str]:
        """The metrics and all that they depend on, dependencies first, otherwise as they were registered; a circle is an error."""
        out: list[str] = []

        def visit(name: str, path: tuple) -> None:
            if name in path:
                raise ValueError("metrics depend on each other: " + " > ".join([*path[path.index(name) :], name]))
            if name in out or (name not in self.metrics and name not in derived.NAMES):
                return
            for dep in self.metrics[name].deps if name in self.metrics else ():
                visit(dep, (*path, name))
            out.append(name)

        for name in names if names is not None else self.metrics:
            visit(name, ())
        return out

    def inputs(self, names: list[str] | None = None) -> set[str]:
        """Columns that the metrics read in the end."""
        found: set[str] = set()
        for name in self.order(names):
            if name in self.metrics:
                found |= {d for d in self.metrics[name].deps if d not in self.metrics and d not in derived.NAMES}
            else:
                found |= derived.inputs(name)
        return found

    def columns(self, names: list[str] | None = None) -> list[str]:
        """Names of metrics by kind of evidence: those of `matchups` first."""
        order = [n for n in self.order(names) if n in self.metrics]
        return [n for e in EVIDENCE for n in order if self.metrics[n].evidence == e]

    def add(self, df: DataFrame, names: list[str] | None = None) -> DataFrame:
        """`df` with the metrics, dependencies in order; a column that is there already is taken as it is."""
        if missing := self.inputs(names) - set(df.columns):
            raise ValueError(f"columns that metrics read are missing: {sorted(missing)}")
        for name in self.order(names):
            if name not in df.columns:
                made = self.metrics[name].fn(*[F.col(d) for d in self.metrics[name].deps]) if name in self.metrics else derived.expression(name)
                df = df.withColumn(name, made)
        return df

    def version(self, names: list[str] | None = None) -> str:
        """A hash that changes with any definition: names, dependencies, evidence, source and the expression itself."""
        rows = []
        for name in self.order(names):
            if name in self.metrics:
                m = self.metrics[name]
                rows.append((name, m.deps, m.evidence, m.source, str(m.fn(*[F.col(d) for d in m.deps]))))
            else:
                rows.append((name, derived.registry_hash()))
        return hashlib.sha256(repr(sorted(rows)).encode()).hexdigest()


def score(df: DataFrame, model, columns: list[str] | None = None, name: str = "score") -> DataFrame:
    """`df` with a score: of a Column; of a function of the rows' Columns, which may be a pandas UDF; or of a function of the DataFrame that
    returns it with the score (`columns` None)."""
    if isinstance(model, Column):
        return df.withColumn(name, model)
    if columns is None:
        out = model(df)
        if name not in out.columns:
            raise ValueError(f"the model returned no column {name}")
        return out
    return df.withColumn(name, model(*[F.col(c) for c in columns]))
