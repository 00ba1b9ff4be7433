"""Tables over several systems: the price fact and the location dimension."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from ..functions.prices import drug_unit_text
from ..operators.joins import join_grouped
from ..operators.reshape import conform, union_all
from ..schema import LOCATION_DIMENSION, PRICE_FACT


@dataclass
class SystemTable:
    """One system's table and how its columns map to the shared schema."""

    table: DataFrame
    literals: Mapping[str, object] = field(default_factory=dict)
    sources: Mapping[str, str | Column] = field(default_factory=dict)
    # location dimension only: attributes taken from the system's price fact, one value per facility
    fact: DataFrame | None = None
    fact_attributes: Sequence[str] = ()


def multisystem_fact(systems: Sequence[SystemTable]) -> DataFrame:
    """All systems' price rows in the shared 51 columns.

    Columns a system lacks are typed NULLs, so a filter on e.g. ``source_format`` removes whole branches and
    filters on passed-through columns reach each system's scan.
    """

    def one(s: SystemTable) -> DataFrame:
        sources = dict(s.sources)
        unit = sources.get("drug_unit", "drug_unit")
        if isinstance(unit, str) and unit in s.table.columns:
            sources["drug_unit"] = drug_unit_text(unit)
        return conform(s.table, PRICE_FACT, s.literals, sources)

    return union_all([one(s) for s in systems])


def location_dimension(systems: Sequence[SystemTable]) -> DataFrame:
    """All systems' locations in the shared 47 columns.

    Attributes a system only publishes with its prices come from its fact, reduced to one row per facility
    before the join.
    """

    def one(s: SystemTable) -> DataFrame:
        table = s.table
        if s.fact is not None:
            table = table.drop(*s.fact_attributes)
            table = join_grouped(table, s.fact, ["facility_id"], s.fact_attributes)
        return conform(table, LOCATION_DIMENSION, s.literals, s.sources)

    return union_all([one(s) for s in systems])
