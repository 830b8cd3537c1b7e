"""Role-scoped, masked and suppressed reads of the published tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.masks import mask_digits, mask_name, suppress


@dataclass(frozen=True)
class Role:
    """What a reader may see: districts and blocks (None: all), people or aggregates only, the smallest cell shown."""

    name: str
    districts: tuple[str, ...] | None = None
    blocks: tuple[str, ...] | None = None
    people: bool = False
    audit: bool = False
    min_cell: int = 10
    programmes: tuple[str, ...] | None = None
    aggregates: bool = field(default=True)


class Refused(PermissionError):
    """The role may not do this."""


class GovernedSession:
    """The only way to the published tables: every read goes through `scoped`, which puts the role's row filter under the
    query, where Catalyst pushes it to the scan."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], role: Role):
        self._spark, self._tables, self.role = spark, tables, role

    def scoped(self, name: str) -> DataFrame:
        df = self._tables[name]
        for col, allowed in (("district", self.role.districts), ("block", self.role.blocks)):
            if allowed is not None:
                if col not in df.columns:
                    raise Refused(f"{name} has no {col} to scope by")
                df = df.filter(F.upper(F.trim(F.col(col))).isin(*[a.upper() for a in allowed]) if col == "block" else F.col(col).isin(*allowed))
        return df

    def need(self, what: str) -> None:
        if not getattr(self.role, what):
            raise Refused(f"{self.role.name}: {what}")

    def totals(self, name: str, by: list[str], sums: dict[str, str]) -> DataFrame:
        """Counts per group; where a count is suppressed, so are its sums."""
        self.need("aggregates")
        x = self.scoped(name).groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])
        shown = suppress(F.col("n"), self.role.min_cell)
        return x.select(*by, shown.alias("n"), *[F.when(shown.isNotNull(), F.col(k)).alias(k) for k in sums])

    def page(self, name: str, where: dict[str, object], order: list, offset: int = 0, size: int = 50, names: tuple[str, ...] = (), texts: tuple[str, ...] = ()) -> DataFrame:
        """A page of rows, at most 200, with names and long digit runs masked; filters are column comparisons, never text."""
        self.need("people")
        x = self.scoped(name)
        for k, v in where.items():
            x = x.filter(F.col(k) == F.lit(v))
        x = x.orderBy(*order).offset(max(0, offset)).limit(max(0, min(200, size)))
        return x.withColumns({**{c: mask_name(F.col(c)) for c in names}, **{c: mask_digits(F.col(c)) for c in texts}})

    def refused(self, name: str) -> int:
        """Rows of a table that are out of scope."""
        return self._tables[name].count() - self.scoped(name).count()


def catalogue(spark: SparkSession, roles: list[Role]) -> DataFrame:
    """The roles as rows: what each may see, a scope of null meaning everything."""
    rows = [(r.name, list(r.districts) if r.districts else None, list(r.blocks) if r.blocks else None, r.people, r.audit, r.aggregates, r.min_cell) for r in roles]
    return spark.createDataFrame(rows, "name string, districts array<string>, blocks array<string>, people boolean, audit boolean, aggregates boolean, min_cell int")
