"""Declarative schema planning: a wanted layout, its difference from the catalog,
and the actions that close it.  Also layout advice for promoted columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..context import CONJOINED, SCHEMA_PER_TENANT, SINGLE, tenant_schema
from ..functions import jsonpath
from ..promoted import PROMOTED_TYPES, Promoted, promote  # noqa: F401  promote is part of this module's interface
from ..store import TABLES

@dataclass
class Config:
    mode: str = SINGLE
    schema: str = "default"
    tenants: tuple[str, ...] = ()
    promoted: tuple[Promoted, ...] = ()
    tables: dict[str, object] = field(default_factory=lambda: dict(TABLES))


@dataclass(frozen=True)
class Action:
    kind: str
    schema: str
    table: str | None = None
    column: str | None = None
    sql: str = ""


@dataclass
class Plan:
    actions: list[Action] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


class SchemaPlanner:
    """Plans and applies the difference between a Config and the catalog; applying
    a plan twice does nothing the second time."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _schemas(self, config: Config) -> list[str]:
        return [tenant_schema(t) for t in config.tenants] if config.mode == SCHEMA_PER_TENANT else [config.schema]

    def plan(self, config: Config) -> Plan:
        out, catalog = Plan(), self.spark.catalog
        if config.mode == CONJOINED and any(s.fieldNames()[0] != "tenant_id" for s in config.tables.values()):
            out.warnings.append("a table without a tenant column cannot be conjoined")
        for schema in self._schemas(config):
            known = catalog.databaseExists(schema)
            if not known:
                out.actions.append(Action("create_schema", schema, sql=f"CREATE DATABASE IF NOT EXISTS `{schema}`"))
            for name, wanted in config.tables.items():
                fields = [(f.name, f.dataType.simpleString()) for f in wanted.fields]
                if name == "docs":
                    fields += [(p.column, PROMOTED_TYPES[p.kind]) for p in config.promoted]
                if not known or not catalog.tableExists(f"{schema}.{name}"):
                    columns = ", ".join(f"`{c}` {t}" for c, t in fields)
                    out.actions.append(Action("create_table", schema, name, sql=f"CREATE TABLE IF NOT EXISTS `{schema}`.`{name}` ({columns}) USING parquet"))
                    continue
                there = {f.name: f.dataType.simpleString() for f in self.spark.table(f"`{schema}`.`{name}`").schema}
                for c, t in fields:
                    if c not in there:
                        out.actions.append(Action("add_column", schema, name, c, f"ALTER TABLE `{schema}`.`{name}` ADD COLUMNS (`{c}` {t})"))
                    elif there[c] != t:
                        out.warnings.append(f"{schema}.{name}.{c} is {there[c]}, not {t}")
        return out

    def apply(self, plan: Plan) -> int:
        for a in plan.actions:
            self.spark.sql(a.sql)
        return len(plan.actions)

    def sync(self, config: Config) -> Plan:
        plan = self.plan(config)
        self.apply(plan)
        return plan

    def drift(self, config: Config) -> dict[str, list[str]]:
        """What is missing or different, by schema."""
        plan = self.plan(config)
        out: dict[str, list[str]] = {s: [] for s in self._schemas(config)}
        for a in plan.actions:
            out[a.schema].append(" ".join(x for x in (a.kind, a.table, a.column) if x))
        for w in plan.warnings:
            out.setdefault(w.split(".")[0], []).append(w)
        return out

    def down(self, config: Config) -> None:
        for schema in self._schemas(config):
            if self.spark.catalog.databaseExists(schema):
                for name in config.tables:
                    self.spark.sql(f"DROP TABLE IF EXISTS `{schema}`.`{name}`")


def suggest_promoted(docs: DataFrame, doc: str = "doc", sample: int = 1000, share: float = 0.8) -> list[Promoted]:
    """Top-level scalar fields that most documents of a sample have, as promoted columns."""
    fields = docs.limit(sample).select(F.explode(F.try_variant_get(F.col(doc), "$", "map<string,variant>")).alias("k", "v"))
    found = fields.groupBy("k", F.schema_of_variant("v").alias("t")).count().collect()
    n = min(sample, docs.limit(sample).count())
    kinds = {"STRING": "text", "BIGINT": "bigint", "DOUBLE": "numeric", "BOOLEAN": "boolean"}
    out = []
    for r in sorted(found, key=lambda r: (-r["count"], r.k)):
        kind = kinds.get(r.t, "numeric" if r.t.startswith("DECIMAL") else None)
        if kind and r["count"] >= share * n:
            out.append(Promoted(r.k, f"d_{r.k}", kind))
    return out


@dataclass(frozen=True)
class Advice:
    """What would help the queries on a path: promote, sort, bloom or lexemes."""

    path: str
    action: str
    uses: int
    reason: str


def advise(queries: list, promoted: list[Promoted] = (), least: int = 2) -> list[Advice]:
    """Advice from document queries (such as a slow-query log keeps): paths that `least`
    of them compare, and how.  Equality wants a promoted column with a Bloom filter,
    ranges and orders one that files are sorted by, full text kept lexemes."""
    from ..plans.predicate import _And, _Compare, _FullText, _Not, _Or

    uses: dict[tuple[str, str], int] = {}

    def walk(part: object) -> None:
        if isinstance(part, _Compare):
            kind = "bloom" if part.op == "eq" else "sort" if part.op in ("gt", "ge", "lt", "le", "between") else "promote"
            key = (".".join(jsonpath.parse(part.path)), kind)
            uses[key] = uses.get(key, 0) + 1
        elif isinstance(part, _FullText):
            uses["", "lexemes"] = uses.get(("", "lexemes"), 0) + 1
        elif isinstance(part, _Not):
            walk(part.part)
        elif isinstance(part, (_And, _Or)):
            for p in part.parts:
                walk(p)

    for query in queries:
        for p in query.spec.filters:
            walk(p)
        for source, path, *_ in query.spec.order:
            if source in (None, "docs"):
                key = (".".join(jsonpath.parse(path)), "sort")
                uses[key] = uses.get(key, 0) + 1
    known = {".".join(jsonpath.parse(p.path)) for p in promoted}
    why = {"bloom": "compared for equality", "sort": "compared by range or ordered by", "promote": "read by filters", "lexemes": "searched by words"}
    found = [Advice(path, action, n, why[action]) for (path, action), n in uses.items() if n >= least]
    found += [Advice(a.path, "promote", a.uses, "no native column yet") for a in found if a.action in ("bloom", "sort") and a.path not in known]
    return sorted(set(found), key=lambda a: (-a.uses, a.path, a.action))
