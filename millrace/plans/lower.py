"""Statements to DataFrames. Catalyst does the rest.

Each table's columns are renamed to alias and name before joins, so that self joins and equal
names work. Top-level AND parts of WHERE that one table answers become its filter; the others
become join conditions as soon as their tables are joined; tables without a condition between
them are crossed last.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, FloatType, LongType, StringType, TimestampNTZType, TimestampType

from .. import errors as E
from ..catalog import Catalog, Entity
from ..functions import DATE_FORMAT, aggregate, is_integral, scalar, windowed
from ..operators import arrival
from . import syntax as S

MARK = "\x1f"
#: A join of columns that are unique on neither side gives so many rows a piece at least, in PIECES pieces a partition at most.
JOIN_ROWS, PIECES = 1 << 22, 4


@dataclass(frozen=True)
class Found:
    """A column of one of the statement's tables."""

    alias: str
    name: str
    kind: DataType

    @property
    def column(self) -> Column:
        return F.col(f"`{self.alias}{MARK}{self.name}`")


class Scope:
    """The tables of a statement and what their columns are called."""

    def __init__(self, catalog: Catalog, tables: tuple[S.Table, ...], view: Callable[[S.Select], DataFrame] | None = None):
        #: what inline views give
        self.views: dict[str, DataFrame] = {t.alias: view(t.select) for t in tables if t.select}
        self.entities: dict[str, Entity] = {t.alias: Entity(t.alias, self.views[t.alias].schema) if t.select else catalog[t.name] for t in tables}

    def find(self, name: str, error: type[E.DialectError] = E.InvalidColumnDescription) -> Found:
        head, _, tail = name.rpartition(".")
        if head:
            if head not in self.entities:
                raise error(f"no table {head} in the statement")
            hits = [head] if tail in self.entities[head].schema.fieldNames() else []
        else:
            hits = [a for a, e in self.entities.items() if name in e.schema.fieldNames()]
        if not hits:
            raise error(f"no column {name}")
        if len(hits) > 1:
            raise E.AmbiguousColumnName(f"{name} is a column of {' and '.join(hits)}")
        return Found(hits[0], tail, self.entities[hits[0]].schema[tail].dataType)

    def renamed(self, alias: str, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"`{c}`").alias(f"{alias}{MARK}{c}") for c in df.columns])

    def sequence(self, alias: str) -> tuple[str, ...]:
        order = self.entities[alias].order
        if not order:
            raise E.InvalidSQLStatement(f"{alias} has no sequence or id, so its rows have no order of arrival")
        return tuple(f"{alias}{MARK}{c}" for c in order)


class Lowering:
    def __init__(self, catalog: Catalog, read: Callable[[Entity], DataFrame], date_format: str = DATE_FORMAT, strict: bool = False, aggregates: dict[str, Callable[[Column], Column]] | None = None):
        self.catalog, self.read, self.date_format, self.strict = catalog, read, date_format, strict
        #: a session's own aggregates: from a column to an aggregate of it
        self.aggregates = aggregates or {}

    # -- conditions

    def value(self, literal: S.Literal, kind: DataType) -> Column:
        """A literal as the type of the column that it meets."""
        if literal.kind == "null":
            return F.lit(None).cast(kind)
        numeric = is_integral(kind) or isinstance(kind, (DoubleType, FloatType))
        if isinstance(kind, (TimestampType, TimestampNTZType)):
            if literal.kind != "string":
                raise E.InvalidConditionValue(f"{literal.text} is no date")
            return F.to_timestamp(F.lit(literal.text), self.date_format).cast(kind)
        if numeric and literal.kind == "string" or isinstance(kind, StringType) and literal.kind != "string" or isinstance(kind, BooleanType):
            raise E.InvalidConditionValue(f"{literal.text!r} doesn't suit a column of type {kind.simpleString()}")
        if not numeric and not isinstance(kind, StringType):
            raise E.InvalidCondition(f"a column of type {kind.simpleString()} can't be compared")
        if self.strict and numeric and is_integral(kind) != (literal.kind == "int"):
            raise E.InvalidConditionValue(f"{literal.text} doesn't suit a column of type {kind.simpleString()}")
        if literal.kind == "string":
            return F.lit(literal.text)
        return F.lit(int(literal.text)) if literal.kind == "int" else F.lit(float(literal.text))

    def condition(self, c, find: Callable[[object], tuple[Column, DataType]]) -> Column:
        """find: the column and type of a Column or Call."""
        if isinstance(c, (S.And, S.Or, S.Xor)):
            out, *rest = [self.condition(p, find) for p in c.parts]
            for p in rest:
                out = out & p if isinstance(c, S.And) else out | p if isinstance(c, S.Or) else out != p
            return out
        if isinstance(c, S.IsNull):
            column, _ = find(c.column)
            return column.isNotNull() if c.negated else column.isNull()
        if isinstance(c, S.InList):
            column, kind = find(c.column)
            hit = column.isin([self.value(v, kind) for v in c.values])
            return ~hit if c.negated else hit
        if isinstance(c, S.Contains):
            column, kind = find(c.column)
            if not isinstance(kind, StringType):
                raise E.InvalidCondition("LIKE needs a text column")
            hit = column.contains(self.value(c.value, kind))
            return ~hit if c.negated else hit
        if isinstance(c, S.Compare):
            return self.compare(c, find)
        raise E.InvalidCondition("IN [SELECT ...] stands only at the top of WHERE, joined by AND")

    def compare(self, c: S.Compare, find) -> Column:
        left, kind = find(c.left)
        if isinstance(c.right, S.Literal):
            right, other = self.value(c.right, kind), kind
        else:
            right, other = find(c.right)
        families = [("number" if is_integral(k) or isinstance(k, (DoubleType, FloatType)) else "date" if isinstance(k, (TimestampType, TimestampNTZType)) else k.simpleString()) for k in (kind, other)]
        if families[0] != families[1]:
            raise E.InvalidCondition(f"{families[0]} and {families[1]} can't be compared")
        if self.strict and c.operator not in ("=", "<>") and families[0] != "number":
            raise E.InvalidCondition(f"{c.operator} compares numbers only")
        return {"=": left == right, "<>": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[c.operator]

    # -- FROM and WHERE

    def joined(self, scope: Scope, where) -> DataFrame:
        conjuncts = [] if where is None else list(where.parts) if isinstance(where, S.And) else [where]
        find = lambda e: self.operand(scope, e)
        semi = [c for c in conjuncts if isinstance(c, S.InSelect)]
        waiting = [(self.tables_of(scope, c), self.condition(c, find), isinstance(c, S.Compare) and c.operator == "=", c) for c in conjuncts if not isinstance(c, S.InSelect)]
        frames = {a: scope.renamed(a, scope.views[a] if a in scope.views else self.read(e)) for a, e in scope.entities.items()}
        for a in frames:
            for used, condition, *_ in waiting:
                if used == {a}:
                    frames[a] = frames[a].where(condition)
        waiting = [w for w in waiting if len(w[0]) > 1]
        first, *others = frames
        out, done, unique = frames[first], {first}, self.keys(scope, first)
        while others:
            def links(a: str) -> list:
                return [w for w in waiting if a in w[0] and w[0] <= done | {a}]

            # a table with an equality to what is joined already, else with any condition, else the next
            best = max(others, key=lambda a: (any(w[2] for w in links(a)), bool(links(a)), -others.index(a)))
            now = links(best)
            if now:
                ways = [] if any(w[2] for w in now) else next((w[3].parts for w in now if self.any_equal(scope, w[3], best)), [])
                rest = [w[1] for w in now if not ways or w[3].parts is not ways]
                left, right = out, frames[best]
                equal = [pair for w in now if w[2] and (pair := self.sides(scope, w[3], best))]
                once = [any(k <= {p[side] for p in equal} for k in keys) for side, keys in enumerate((unique, self.keys(scope, best)))]
                unique = [*(unique if once[1] else ()), *(self.keys(scope, best) if once[0] else ())]
                if equal and not any(once):
                    left, right, more = self.pieces(scope, left, right, done, best, equal)
                    rest += more
                out = self.joined_by(left, right, [self.condition(p, find) for p in ways], rest)
            else:
                out, unique = out.crossJoin(frames[best]), []
            waiting = [w for w in waiting if not any(w is x for x in now)]
            others.remove(best)
            done.add(best)
        for _, condition, *_ in waiting:
            out = out.where(condition)
        for c in semi:
            found = scope.find(c.column.name)
            inner = self.select(c.select)
            if len(inner.columns) != 1:
                raise E.InvalidConditionValue("the list of IN [SELECT ...] needs one column")
            inner = inner.toDF("_in")
            if c.negated:
                # as SQL has it: a null in the list, or a null compared to a list, is no match, unless the list is empty
                facts = inner.agg(F.count(F.lit(1)).alias("_all"), F.count("_in").alias("_known"))  # one row
                out = out.join(inner.where("_in is not null"), found.column == F.col("_in"), "left_anti").crossJoin(F.broadcast(facts))
                out = out.where((F.col("_all") == 0) | (F.col("_all") == F.col("_known")) & found.column.isNotNull()).drop("_all", "_known")
            else:
                out = out.join(inner, found.column == F.col("_in"), "left_semi")
        return out

    def any_equal(self, scope: Scope, c, alias: str) -> bool:
        """Whether c is an OR of which each part is an equality between this table and others."""
        sides = lambda p: (self.tables_of(scope, p.left), self.tables_of(scope, p.right))
        return isinstance(c, S.Or) and all(isinstance(p, S.Compare) and p.operator == "=" and {alias} in sides(p) and set() not in sides(p) and sides(p)[0] != sides(p)[1] for p in c.parts)

    def joined_by(self, left: DataFrame, right: DataFrame, ways: list[Column], every: list[Column]) -> DataFrame:
        """The join on all of `every` and any of `ways`: a join for each way, without what an earlier one has given.

        So an OR of equalities is several equality joins, not a comparison of all rows with all.
        """
        out, before = None, None
        for way in ways or [None]:
            on = [*every, *([] if way is None else [way]), *([] if before is None else [~F.coalesce(before, F.lit(False))])]
            joined = left.join(right, functools.reduce(Column.__and__, on))
            out = joined if out is None else out.union(joined)
            before = way if before is None else before | way
        return out

    def sides(self, scope: Scope, c: S.Compare, alias: str) -> tuple[Found, Found] | None:
        """The columns that an equality compares, this table's last; None if it isn't one between plain columns of one type."""
        if not (isinstance(c.left, S.Column) and isinstance(c.right, S.Column)):
            return None
        a, b = sorted((scope.find(c.left.name), scope.find(c.right.name)), key=lambda f: f.alias == alias)
        return (a, b) if b.alias == alias != a.alias and a.kind == b.kind else None

    def keys(self, scope: Scope, alias: str) -> list[set[Found]]:
        """Columns of which a table has each value once, as the catalog says. Only the work depends on it, no result."""
        e = scope.entities[alias]
        names = [*([(e.id,)] if e.id else []), *(i.columns for i in e.indexes if i.unique)]
        return [{Found(alias, c, e.schema[c].dataType) for c in n} for n in names]

    def pieces(self, scope: Scope, left: DataFrame, right: DataFrame, done: set[str], best: str, equal: list[tuple[Found, Found]]) -> tuple[DataFrame, DataFrame, list[Column]]:
        """Both sides of a join, and more conditions for it, so that no task makes all rows of a frequent key.

        Spark deals a join by the sizes of what it reads, not of what it makes, so a few keys with many
        rows on both sides are made by as few tasks. Here the rows of such a key are cut into pieces on
        both sides, by a hash of the row, and each piece meets each of the other side's.
        """
        counts = lambda df, k, name: df.groupBy(*[e[k].column.alias(f"_k{i}") for i, e in enumerate(equal)]).agg(F.count(F.lit(1)).cast("double").alias(name))
        keys = [f"_k{i}" for i in range(len(equal))]
        made = counts(left, 0, "_a").join(counts(right, 1, "_b"), keys).withColumn("_n", F.col("_a") * F.col("_b"))
        n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        total = made.agg(F.coalesce(F.sum("_n"), F.lit(0.0))).first()[0]
        if total <= JOIN_ROWS:
            return left, right, []
        each = max(JOIN_ROWS, total / (n * PIECES * PIECES))
        # the sides are cut so that they are copied least
        cut = F.least(F.col("_a"), F.greatest(F.lit(1.0), F.round(F.sqrt(F.col("_n") / each * F.col("_a") / F.col("_b")))))
        across = F.least(F.col("_b"), F.greatest(F.lit(1.0), F.ceil(F.col("_n") / each / F.col("_left")).cast("double")))
        few = made.where(F.col("_n") > each).withColumn("_left", cut).withColumn("_right", across)
        few = few.select(*keys, F.col("_left").cast("int").alias("_left"), F.col("_right").cast("int").alias("_right"))

        def dealt(df: DataFrame, k: int, aliases: set[str]) -> DataFrame:
            own, others = (f"{best}{MARK}{MARK}{k}{i}" for i in (k, 1 - k))
            entities = {a: scope.entities[a] for a in sorted(aliases)}
            names = [f"{a}{MARK}{e.id}" for a, e in entities.items()] if all(e.id for e in entities.values()) else df.columns
            mine, copies = (("_left", "_right"), ("_right", "_left"))[k]
            on = functools.reduce(Column.__and__, [e[k].column == F.col(key) for e, key in zip(equal, keys)])
            df = df.join(F.broadcast(few), on, "left")
            df = df.withColumn(own, F.coalesce(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names]), F.col(mine)).cast("int"), F.lit(0)))
            df = df.withColumn(others, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(copies), F.lit(1)) - 1))).drop(*keys, "_left", "_right")
            return df.repartition(n * PIECES, *[e[k].column for e in equal], *[F.col(f"`{c}`") for c in ((own, others) if k == 0 else (others, own))])

        pairs = [F.col(f"`{best}{MARK}{MARK}0{i}`") == F.col(f"`{best}{MARK}{MARK}1{i}`") for i in (0, 1)]
        return dealt(left, 0, done).hint("merge"), dealt(right, 1, {best}), pairs

    def operand(self, scope: Scope, e) -> tuple[Column, DataType]:
        if isinstance(e, S.Column):
            found = scope.find(e.name)
            return found.column, found.kind
        if isinstance(e, S.Call) and e.function in S.SCALARS:
            column = scalar(e.function, scope.find(e.argument.name).column, self.date_format)
            return column, {"TO_NUMBER": DoubleType(), "TO_CHAR": StringType(), "TO_DATE": TimestampNTZType()}[e.function]
        raise E.InvalidCondition("an aggregate can't stand in WHERE")

    def tables_of(self, scope: Scope, c) -> set[str]:
        if isinstance(c, (S.And, S.Or, S.Xor)):
            return set().union(*[self.tables_of(scope, p) for p in c.parts])
        if isinstance(c, S.Compare):
            return self.tables_of(scope, c.left) | self.tables_of(scope, c.right)
        if isinstance(c, S.Call):
            return self.tables_of(scope, c.argument)
        if isinstance(c, S.Column):
            return {scope.find(c.name).alias}
        return self.tables_of(scope, c.column) if hasattr(c, "column") else set()

    # -- SELECT

    def checked(self, scope: Scope, s: S.Select) -> tuple[S.Item, ...]:
        """The items with * spelled out, after the rules on groups."""
        items = s.items
        if any(isinstance(i.expression, S.Star) for i in items):
            if len(items) > 1 or len(s.tables) > 1:
                raise E.InvalidColumnDescription("* stands alone, with one table")
            alias = s.tables[0].alias
            items = tuple(S.Item(S.Column(f"{alias}.{c}"), c) for c in scope.entities[alias].schema.fieldNames())
        calls = [i.expression for i in items if self.is_call(i)]
        plain = []
        for i in items:
            e = i.expression
            if isinstance(e, S.Column):
                plain.append(scope.find(e.name))
            elif not isinstance(e.argument, S.Star):
                found = scope.find(e.argument.name)
                if e.function in S.SCALARS:
                    plain.append(found)
        grouped = [scope.find(c.name, E.InvalidGroupByPart) for c in s.group]
        if s.group and not calls:
            raise E.InvalidGroupColumnSet("GROUP BY without an aggregate")
        if calls and plain and not s.group and not s.window:
            raise E.InvalidGroupColumnSet("aggregates beside plain columns need GROUP BY")
        if s.group and any(g not in plain for g in grouped):
            raise E.InvalidGroupColumnSet("a column of GROUP BY isn't selected")
        if s.group and any(p not in grouped for p in plain):
            raise E.InvalidGroupColumnSet("a selected column isn't in GROUP BY")
        if s.having is not None and not calls:
            raise E.InvalidGroupColumnSet("HAVING without an aggregate")
        names = [i.name for i in items]
        if len(set(names)) < len(names):
            raise E.InvalidColumnDescription("two result columns have the same name")
        if s.window:
            scope.find(s.window[0].name, E.InvalidWindowByPart)
            if len(s.tables) > 1:
                raise E.InvalidWindowByPart("WINDOW BY takes one table")
        return items

    def call(self, scope: Scope, e: S.Call) -> Column:
        if isinstance(e.argument, S.Star):
            return aggregate("COUNT", None, None)
        found = scope.find(e.argument.name)
        if e.function in self.aggregates:
            return self.aggregates[e.function](found.column)
        order = F.struct(*[F.col(f"`{c}`") for c in scope.sequence(found.alias)]) if e.function == "LAST" else None
        return aggregate(e.function, found.column, found.kind, order)

    def plain(self, scope: Scope, i: S.Item) -> Column:
        return self.operand(scope, i.expression)[0].alias(i.name)

    def is_call(self, i: S.Item) -> bool:
        return isinstance(i.expression, S.Call) and i.expression.function not in S.SCALARS

    def select(self, s: S.Select) -> DataFrame:
        scope = Scope(self.catalog, s.tables, self.select)
        items = self.checked(scope, s)
        rows = self.joined(scope, s.where)
        if s.window:
            out = self.windows(scope, s, items, rows)
            return self.ordered(out, scope, s, items, None)
        calls = [i for i in items if self.is_call(i)]
        if calls:
            having, extra = self.having(scope, s, items)
            keys = [scope.find(c.name) for c in s.group]
            grouped = rows.groupBy(*[k.column for k in keys]).agg(*[self.call(scope, i.expression).alias(i.name) for i in calls], *extra)
            out = grouped.where(having) if having is not None else grouped
            out = out.select(*[F.col(f"`{i.name}`") if self.is_call(i) else self.plain(scope, i) for i in items])
            return self.ordered(out.distinct() if s.distinct else out, scope, s, items, None)
        projected = [self.plain(scope, i) for i in items]
        if s.distinct:
            return self.ordered(rows.select(*projected).distinct(), scope, s, items, None)
        return self.ordered(rows, scope, s, items, projected)

    def having(self, scope: Scope, s: S.Select, items) -> tuple[Column | None, list[Column]]:
        """The condition over the grouped rows, and aggregates that only it names."""
        if s.having is None:
            return None, []
        extra: dict[S.Call, Column] = {}
        by_alias = {i.name: i for i in items}

        def find(e):
            if isinstance(e, S.Column) and e.name in by_alias and self.is_call(by_alias[e.name]):
                e = by_alias[e.name].expression
            if isinstance(e, S.Column):
                found = scope.find(e.name)
                return found.column, found.kind
            kind = LongType() if e.function == "COUNT" else scope.find(e.argument.name).kind
            name = next((i.name for i in items if i.expression == e), f"_having{len(extra)}")
            if not any(i.expression == e for i in items):
                extra.setdefault(e, self.call(scope, e).alias(name))
            return F.col(f"`{name}`"), kind

        return self.condition(s.having, find), list(extra.values())

    def ordered(self, rows: DataFrame, scope: Scope, s: S.Select, items, projected: list[Column] | None) -> DataFrame:
        """ORDER BY and LIMIT. projected: rows are joined rows, still to be projected; else they are results."""
        if s.order:
            names = {i.name: i for i in items}
            keys = []
            for o in s.order:
                if projected is None:
                    hit = o.column.name if o.column.name in names else next((i.name for i in items if isinstance(i.expression, S.Column) and scope.find(i.expression.name) == scope.find(o.column.name, E.InvalidOrderByPart)), None)
                    if hit is None:
                        raise E.InvalidOrderByPart(f"{o.column.name} isn't selected")
                    key = F.col(f"`{hit}`")
                elif o.column.name in names:
                    key = self.operand(scope, names[o.column.name].expression)[0]
                else:
                    key = scope.find(o.column.name, E.InvalidOrderByPart).column
                way = ("desc" if o.descending else "asc") + (f"_nulls_{o.nulls.lower()}" if o.nulls else "")
                keys.append(getattr(key, way)())
            rows = rows.orderBy(*keys)
        if projected is not None:
            rows = rows.select(*projected)
        rows = rows.offset(s.offset) if s.offset else rows
        return rows.limit(s.limit) if s.limit is not None else rows

    def combined(self, c: S.Select | S.Combined) -> DataFrame:
        """UNION, INTERSECT and EXCEPT, by place; the first SELECT names the columns."""
        if isinstance(c, S.Select):
            return self.select(c)
        left, right = self.combined(c.left), self.combined(c.right)
        if len(left.columns) != len(right.columns):
            raise E.InvalidColumnDescription(f"{c.operator} needs as many columns on both sides")
        if c.operator == "UNION":
            out = left.union(right)
            return out if c.every else out.distinct()
        if c.operator == "INTERSECT":
            return left.intersectAll(right) if c.every else left.intersect(right)
        return left.exceptAll(right) if c.every else left.subtract(right)

    # -- statements over rows in arrival order, in batch form

    def windows(self, scope: Scope, s: S.Select, items, rows: DataFrame) -> DataFrame:
        sequence = scope.sequence(s.tables[0].alias)
        return arrival.row_windows(self.used(scope, items, rows, sequence), sequence, s.window[1], self.over(scope, items))

    def over(self, scope: Scope, items) -> Callable[[Window], list[Column]]:
        """The result columns over a window."""

        def build(window) -> list[Column]:
            out = []
            for i in items:
                e = i.expression
                if not self.is_call(i):
                    out.append(F.first(self.operand(scope, e)[0]).over(window).alias(i.name))
                elif isinstance(e.argument, S.Star):
                    out.append(F.count(F.lit(1)).over(window).alias(i.name))
                else:
                    found = scope.find(e.argument.name)
                    own = self.aggregates.get(e.function)
                    out.append((own(found.column).over(window) if own else windowed(e.function, found.column, found.kind, window)).alias(i.name))
            return out

        return build

    def used(self, scope: Scope, items, rows: DataFrame, also: Sequence[str]) -> DataFrame:
        """The joined rows' columns that the result needs: what is frozen isn't pruned by itself."""
        names = dict.fromkeys(also)
        for i in items:
            e = i.expression
            c = e if isinstance(e, S.Column) else e.argument
            if not isinstance(c, S.Star):
                found = scope.find(c.name)
                names[f"{found.alias}{MARK}{found.name}"] = None
        return rows.select(*[F.col(f"`{n}`") for n in names])

    def replayed(self, s: S.Select) -> DataFrame:
        """What SELECT STREAM would have given for the rows so far."""
        if not s.group:
            return self.select(S.Select(s.items, s.tables, s.where, window=s.window))
        scope = Scope(self.catalog, s.tables)
        items = self.checked(scope, s)
        if len(s.tables) > 1:
            raise E.InvalidSQLStatement("a grouped stream takes one table")
        keys = [scope.find(c.name) for c in s.group]
        names = [f"{k.alias}{MARK}{k.name}" for k in keys]
        sequence = scope.sequence(s.tables[0].alias)
        numbered = arrival.runs(self.used(scope, items, self.joined(scope, s.where), [*sequence, *names]), sequence, names)
        calls = [self.call(scope, i.expression).alias(i.name) for i in items if self.is_call(i)]
        out = arrival.closed_runs(numbered, names, calls)
        return out.select(*[F.col(f"`{i.name}`") if self.is_call(i) else self.plain(scope, i) for i in items])
