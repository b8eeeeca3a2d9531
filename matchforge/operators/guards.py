"""Guards: which source columns a column follows from, by the analysed plan, and assertions over them."""

from __future__ import annotations

from pyspark.sql import DataFrame

# The keys that are known before a game, and labels of build sources, true for those that may reach accepted scoring.
PREGAME_KEYS = ("championid", "teamposition")
BUILD_SOURCES = {"pregame_marginal_build": True, "rl_candidate": True, "train_observed_build": False, "oracle_observed_build": False}


class Leak(ValueError):
    """A column follows from something that it must not follow from."""


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def column_sources(df: DataFrame) -> dict[str, set[str]]:
    """For each column the names of the columns of files, tables or local rows that its values are computed from.

    Follows projections, aggregates, windows, generators and unions by their expressions. A step that runs Python, and any other that makes
    columns of its own, passes on all that it reads. What only decides which rows stay, or how they are joined, is no source.
    """
    known: dict[int, set[str]] = {}

    def of(attributes) -> set[str]:
        return set().union(*(known.get(a.exprId().id(), {a.name()}) for a in attributes)) if attributes else set()

    def visit(node) -> None:
        children = _items(node.children())
        for child in children:
            visit(child)
        outputs = _items(node.output())
        if not children:
            for a in outputs:
                known.setdefault(a.exprId().id(), {a.name()})
            return
        below = [_items(c.output()) for c in children]
        made = {}
        for e in _items(node.expressions()):
            if e.getClass().getSimpleName() == "Alias":
                made[e.exprId().id()] = of(_items(e.references().toSeq()))
        if node.getClass().getSimpleName() == "Generate":
            made |= {a.exprId().id(): of(_items(node.generator().references().toSeq())) for a in _items(node.generatorOutput())}
        passed = {a.exprId().id() for side in below for a in side}
        union = node.getClass().getSimpleName() == "Union"
        for i, a in enumerate(outputs):
            key = a.exprId().id()
            if union:
                known[key] = of([side[i] for side in below])
            elif key in made:
                known[key] = made[key]
            elif key not in passed:
                known[key] = of([b for side in below for b in side])

    plan = df._jdf.queryExecution().analyzed()  # the classic session's plan: there is no public way to it
    visit(plan)
    return {a.name(): known[a.exprId().id()] for a in _items(plan.output())}


def assert_sources(df: DataFrame, columns: list[str], forbidden) -> None:
    """Raise Leak if a column follows from a forbidden one (names, or a function of a name)."""
    bad = forbidden if callable(forbidden) else set(forbidden).__contains__
    found = column_sources(df)
    leaks = {c: sorted(filter(bad, found[c])) for c in columns if any(map(bad, found[c]))}
    if leaks:
        raise Leak("; ".join(f"{c} follows from {', '.join(s)}" for c, s in sorted(leaks.items())))


def assert_pregame(df: DataFrame, keys: list[str], build: tuple = ("build",)) -> None:
    """A table for use before a game has the pregame keys and nothing else as keys, an integer and a text, and nothing in it follows from builds."""
    if sorted(keys) != sorted(PREGAME_KEYS):
        raise Leak(f"pregame keys are {', '.join(PREGAME_KEYS)}, not {', '.join(keys)}")
    kinds = dict(df.dtypes)
    if kinds[PREGAME_KEYS[0]] not in ("tinyint", "smallint", "int", "bigint") or kinds[PREGAME_KEYS[1]] != "string":
        raise Leak(f"{PREGAME_KEYS[0]} has to be a whole number and {PREGAME_KEYS[1]} a text")
    assert_sources(df, df.columns, build)


def assert_no_challenges(df: DataFrame) -> None:
    """No column follows from a challenge."""
    assert_sources(df, df.columns, lambda name: name.lower().startswith("challenge"))


def accepted_build_source(source: str) -> str:
    """The label, if it may reach accepted scoring."""
    if source not in BUILD_SOURCES:
        raise ValueError(f"unknown build source {source!r}")
    if not BUILD_SOURCES[source]:
        raise Leak(f"build source {source!r} is for training and diagnostics only")
    return source
