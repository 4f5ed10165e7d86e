"""Query methods of a view by name, with arguments as texts: what a router calls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SpecError
from .views import View


@dataclass(frozen=True)
class Method:
    """equals: columns that the arguments of the same names must equal; one: the first row by key only. between: the column
    that `start` and `end`, both inclusive, bound. tenant: rows of the caller's tenant only."""

    name: str
    equals: tuple[str, ...] = ()
    between: str | None = None
    one: bool = False
    tenant: bool = False

    def route(self) -> str:
        """One argument stands in the path; several, and ranges, come as a query string."""
        return f"/{self.name}/{{{self.equals[0]}}}" if len(self.equals) == 1 and not self.between else f"/{self.name}"


def call(view: View, method: Method, arguments: dict[str, str], tenant_id: str | None = None) -> DataFrame:
    """The method's rows. Arguments are texts and are read as their columns' types; one that can't be is an error, as are an
    unknown argument and a missing one (a range may be open at either end)."""
    known = {*method.equals, *(("start", "end") if method.between else ())}
    if unknown := set(arguments) - known:
        raise SpecError(f"{method.name}: no argument {sorted(unknown)}")
    if missing := set(method.equals) - set(arguments):
        raise SpecError(f"{method.name}: lacks {sorted(missing)}")
    rows = view.rows
    if method.tenant:
        if tenant_id is None:
            raise SpecError(f"{method.name}: needs a tenant")
        rows = rows.where(F.col("tenant_id") == tenant_id)
    typed = lambda column, text: F.lit(text).cast(rows.schema[column].dataType)
    for column in method.equals:
        rows = rows.where(F.col(column) == typed(column, arguments[column]))
    if method.between:
        for name, test in (("start", lambda c, v: c >= v), ("end", lambda c, v: c <= v)):
            if name in arguments:
                rows = rows.where(test(F.col(method.between), typed(method.between, arguments[name])))
        rows = rows.orderBy(method.between)
    return rows.orderBy(view.key).limit(1) if method.one else rows
