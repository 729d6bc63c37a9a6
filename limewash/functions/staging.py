"""Multi-step cell programs.

A value that several later expressions need is computed once, as a column of an
intermediate projection. All columns share the same few projections, and Spark runs
the whole chain inside one code-generated stage.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sealed(df: DataFrame, cells: Mapping[str, Column]) -> DataFrame:
    """``df`` with these columns added or replaced, in such a way that no filter moves below them.

    They leave the chain of steps as the fields of one generated row. A filter on another column
    still moves down to the scan, while one on a cell stays above; rewritten in terms of the raw
    column it would copy all steps several times over.
    """
    if not cells:
        return df
    fields = {name: f"__cell_{i}_{name}" for i, name in enumerate(cells)}
    done = F.inline(F.array(F.struct(*[cells[name].alias(field) for name, field in fields.items()])))
    kept = [_named(name) for name in df.columns if name not in cells]
    names = [*df.columns, *[name for name in cells if name not in df.columns]]
    return df.select(*kept, done).select(*[_named(fields[n]).alias(n) if n in fields else _named(n) for n in names])


def _named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class Cells:
    """Intermediate columns for a set of cells, keyed by (step, cell position)."""

    def __init__(self, df: DataFrame, tag: str, sources: Mapping[str, Column]):
        self.df, self.tag = df, tag
        self.targets = list(sources)
        self._temporaries: list[str] = []
        self.step("in", lambda i: list(sources.values())[i])

    def _name(self, step: str, i: int) -> str:
        return f"__{self.tag}_{step}_{i}"

    def get(self, step: str, i: int) -> Column:
        return F.col(self._name(step, i))

    def step(self, step: str, build) -> Cells:
        new = {self._name(step, i): build(i) for i in range(len(self.targets))}
        self.df = self.df.withColumns(new)
        self._temporaries += list(new)
        return self

    def finish(self, build) -> DataFrame:
        """Add the targets, replacing columns of the same name, and drop the intermediates."""
        if not self.targets:
            return self.df
        done = sealed(self.df, {name: build(i) for i, name in enumerate(self.targets)})
        return done.drop(*self._temporaries)
