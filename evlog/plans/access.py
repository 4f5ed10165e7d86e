"""Who may call what: rules of entities and of their methods, as metadata."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SpecError

#: From open to closed.
LEVELS = ("public", "internal", "private")


@dataclass(frozen=True)
class Rule:
    """public: anyone; internal: anyone within; private: those with one of the roles, or anyone known where none are named."""

    level: str = "internal"
    roles: tuple[str, ...] = ()

    def __post_init__(self):
        if self.level not in LEVELS:
            raise SpecError(f"no access level {self.level!r}")


@dataclass(frozen=True)
class Entity:
    """An entity's rule, and those of methods that have one of their own."""

    name: str
    rule: Rule = Rule()
    methods: dict[str, Rule | None] = field(default_factory=dict)

    def of(self, method: str) -> Rule:
        """A method's own rule goes before the entity's."""
        return self.methods.get(method) or self.rule


def rules(spark: SparkSession, entities: list[Entity]) -> DataFrame:
    """entity, method, level, roles: what holds for each method."""
    rows = [(e.name, m, e.of(m).level, list(e.of(m).roles)) for e in entities for m in e.methods]
    return spark.createDataFrame(rows, "entity string, method string, level string, roles array<string>")


def may(level: Column, roles: Column, known: Column, has: Column) -> Column:
    """Whether a caller may: known, whether the caller is known; has, the caller's roles."""
    return (level == "public") | known & ((level == "internal") | (F.size(roles) == 0) | F.arrays_overlap(roles, has))
