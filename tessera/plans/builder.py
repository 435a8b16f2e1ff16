"""A fluent plan over the operators; each step wraps a lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from tessera import operators as ops
from tessera.sources.catalog import Catalog
from tessera.sources.sinks import text_rows


@dataclass(frozen=True)
class Plan:
    df: DataFrame

    @classmethod
    def scan(cls, catalog: Catalog, table: str, *columns: str) -> Plan:
        return cls(catalog.scan(table, columns or None))

    def where(self, predicate: Column) -> Plan:
        return Plan(ops.where(self.df, predicate))

    def map(self, expression: Column, name: str, kind: str) -> Plan:
        return Plan(ops.compute(self.df, expression, name, kind))

    def select(self, *columns: str) -> Plan:
        return Plan(ops.project(self.df, *columns))

    def join(self, right: Plan, left_keys: list[str], right_keys: list[str], residual: Column | None = None, build: str | None = None) -> Plan:
        return Plan(ops.hash_join(self.df, right.df, left_keys, right_keys, residual, build))

    def group_by(self, keys: list[str], *aggregates: Column, having: Column | None = None) -> Plan:
        return Plan(ops.group_by(self.df, keys, *aggregates, having=having))

    def aggregate(self, *aggregates: Column, empty_rows: int = 1) -> Plan:
        return Plan(ops.global_aggregate(self.df, *aggregates, empty_rows=empty_rows))

    def sort(self, keys: list[str], desc: bool = False) -> Plan:
        return Plan(ops.sort(self.df, keys, desc))

    def top_k(self, keys: list[str], k: int) -> Plan:
        return Plan(ops.top_k(self.df, keys, k))

    def pareto(self, keys: list[str], strategy: str = "auto") -> Plan:
        return Plan(ops.pareto(self.df, keys, strategy))

    def page(self, offset: int = 0, count: int = -1) -> Plan:
        return Plan(ops.page(self.df, offset, count))

    def text(self, columns: list[str], offset: int = 0, count: int = -1) -> DataFrame:
        return text_rows(self.df, columns, offset, count)
