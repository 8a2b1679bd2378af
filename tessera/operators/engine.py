"""From a parsed query to a DataFrame."""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..plans.errors import QueryError
from ..plans.names import check, constant, is_aggregate, output_name, unaliased
from ..plans.syntax import Aggregate, Binary, Call, Case, In, IsNull, Like, Literal, Name, Node, Query, Unary, aggregates, parse
from ..sources.catalog import Table

#: Rows of a query without aggregates and without LIMIT, and the most and usual values of top_k().
DEFAULT_LIMIT, MOST_TOP, USUAL_TOP = 200, 100, 10
#: Groups that ``collect`` brings to the driver at most.
MOST_GROUPS = 200_000


@dataclass
class Rows:
    """Collected rows with what was seen on the way."""

    columns: list[str]
    rows: list[tuple]
    keys: list[tuple]
    truncated: bool
    notes: list[str]
    elapsed_ms: float
    scanned: int | None = None
    matched: int | None = None


@dataclass
class Result:
    """A query's DataFrame, not yet run. ``keyed`` has the group keys of each row besides, as ``__key0`` and so on."""

    df: DataFrame
    keyed: DataFrame
    columns: list[str]
    key_columns: int
    limit: int | None
    window: int | None
    now: float
    notes: list[str] = field(default_factory=list)
    unlimited: DataFrame | None = None
    seen: Observation | None = None
    kept: Observation | None = None

    def collect(self, most: int = MOST_GROUPS) -> Rows:
        """Run it; one row more than the limit tells whether rows were cut off.

        No more than ``most`` rows come to the driver: of more groups those
        after it in the result's order are left out, and a note says so.
        """
        began = time.perf_counter()
        limit = most if self.limit is None else min(self.limit, most)
        found = (self.unlimited if self.unlimited is not None else self.keyed).limit(limit + 1).collect()
        cut = len(found) > limit
        notes = list(self.notes)
        if cut and (self.limit is None or self.limit > most):
            notes.append(f"There are more than {most:,} groups; the rest is left out. Add a condition, or group by a column with fewer values.")
        found = found[:limit]
        n = len(self.columns)
        rows = Rows(self.columns, [tuple(r)[:n] for r in found], [tuple(r)[n:] for r in found], cut, notes, (time.perf_counter() - began) * 1000)
        if self.seen is not None and self.kept is not None and found:
            rows = replace(rows, scanned=self.seen.get.get("n"), matched=self.kept.get.get("n"))
        return rows


class _Compiler:
    """Expressions over given columns; nodes in ``given`` (group keys, aggregates) are columns already."""

    def __init__(self, columns: dict[str, V.Value], now: float, given: dict[Node, V.Value] | None = None) -> None:
        self.columns, self.now, self.given = columns, now, given or {}

    def __call__(self, node: Node) -> V.Value:
        if node in self.given:
            return self.given[node]
        try:
            return self.of(node)
        except QueryError as e:
            if not e.end:
                e.start, e.end = node.start, node.end
            raise

    def of(self, node: Node) -> V.Value:
        match node:
            case Literal():
                return V.lit(node.value)
            case Name():
                return self.columns[node.name]
            case Unary(op="-"):
                if isinstance(node.operand, Literal) and isinstance(node.operand.value, (int, float)) and not isinstance(node.operand.value, bool):
                    return V.lit(-node.operand.value)
                n = V.number(self(node.operand))
                return V.Value(-n.column, n.kind)
            case Unary():
                return V.Value(~V.truthy(self(node.operand)), "bool")
            case Binary(op="and"):
                return V.Value(V.truthy(self(node.left)) & V.truthy(self(node.right)), "bool")
            case Binary(op="or"):
                a, b = self(node.left), self(node.right)
                return V.Value(V.truthy(a) | V.truthy(b), "bool", test=V.condition(a) | V.condition(b))
            case Binary(op="=" | "!="):
                same = V.equal(self(node.left), self(node.right))
                return V.Value(same if node.op == "=" else ~same, "bool")
            case Binary(op="<" | ">" | "<=" | ">="):
                return V.compare(node.op, self(node.left), self(node.right))
            case Binary(op="||"):
                return V.Value(F.concat(V.text(self(node.left)), V.text(self(node.right))), "string")
            case Binary():
                return V.arithmetic(node.op, self(node.left), self(node.right))
            case In():
                return V.among(self(node.operand), [self(o) for o in node.options], node.negated)
            case Like():
                if not isinstance(node.pattern, Literal) or not isinstance(node.pattern.value, str):
                    raise QueryError("LIKE takes a pattern written out in quotes.", node.pattern.start, node.pattern.end)
                return V.Value(V.like(self(node.operand), node.pattern.value, node.negated), "bool")
            case IsNull():
                empty = V.is_empty(self(node.operand))
                return V.Value(~empty if node.negated else empty, "bool")
            case Case():
                branches = [(V.truthy(self(b.condition)), self(b.value)) for b in node.branches]
                return V.case(branches, self(node.otherwise) if node.otherwise else V.lit(None))
            case Call():
                return V.scalar(node.name, [self(a) for a in node.args], self.now)
        raise QueryError(f"{type(node).__name__} can't be used here.", node.start, node.end)


def fold(node: Node) -> Node:
    """The node with arithmetic on written-out numbers done, so that ``5 % (2 + 1)`` and ``5 % 3`` are one key."""
    if isinstance(node, Binary):
        node = replace(node, left=fold(node.left), right=fold(node.right))
        a, b = node.left, node.right
        if all(isinstance(x, Literal) and isinstance(x.value, (int, float)) and not isinstance(x.value, bool) for x in (a, b)):
            done = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y}.get(node.op)
            if done:
                return Literal(done(a.value, b.value), start=node.start, end=node.end)
    return node


def cost(node: Node) -> int:
    """How dear a condition is, roughly: patterns most, then functions, lists, comparisons."""
    return sum({Like: 20, Call: 5, In: 3, Binary: 2, Name: 1}.get(type(x), 0) for x in node.walk())


def conditions(node: Node) -> list[Node]:
    """The parts that AND joins, the cheap ones first."""
    if isinstance(node, Binary) and node.op == "and":
        return sorted(conditions(node.left) + conditions(node.right), key=cost)
    return [node]


class Engine:
    """Queries over registered tables.

    Distinct counts are exact and percentiles come from sketches that merge;
    ``approximate`` set to true takes sketches for both, to false for neither.
    """

    def __init__(self, tables: dict[str, Table] | None = None, approximate: bool | None = None) -> None:
        self.tables, self.approximate = dict(tables or {}), approximate

    def register(self, name: str, table: Table) -> None:
        self.tables[name] = table

    def check(self, sql: str) -> Query:
        """Parse and analyse a query without running it."""
        query = parse(sql)
        self._plan(query, sql, 0.0, False, False)
        return query

    def sql(self, sql: str, now: float | None = None) -> DataFrame:
        return self.run(sql, now).df

    def run(self, sql: str, now: float | None = None, metrics: bool = False) -> Result:
        return self._plan(parse(sql), sql, now, metrics)

    def _plan(self, query: Query, sql: str, now: float | None, metrics: bool, fresh: bool = True) -> Result:
        table = self.tables.get(query.table.name)
        if table and query.window is not None and table.retention is not None and query.window > table.retention:
            raise QueryError(f"The window is longer than the {table.retention / 60:g} minutes that are kept.", 0, len(sql), f"Use WINDOW {table.retention // 60}m or less.")
        if table is None:
            raise QueryError(f"There is no table {query.table.name}.", query.table.start, query.table.end, "Tables: " + ", ".join(sorted(self.tables)) + ".")
        if query.window is not None and table.time is None:
            raise QueryError(f"{query.table.name} has no time to take a WINDOW of.", 0, len(sql))
        if fresh:
            table.refresh(now)
        columns = table.columns
        check(query, columns)
        uses_now = query.window is not None or any(isinstance(x, Call) and x.name == "now" for root in [*(i.value for i in query.items or ()), *query.groups, *(s.value for s in query.sorts), *([query.where] if query.where else [])] for x in root.walk())
        now = now if now is not None else table.now() if uses_now else 0.0
        df = table.since(now, query.window) if query.window is not None else table.df
        seen = kept = None
        if metrics:
            seen, kept = Observation(), Observation()
            df = df.observe(seen, F.count(F.lit(1)).alias("n"))
        compile_ = _Compiler({c: V.of_column(df[c], df.schema[c].dataType) for c in columns}, now)
        if query.where:
            for part in conditions(query.where):
                df = df.where(V.condition(compile_(part)))
        if kept is not None:
            df = df.observe(kept, F.count(F.lit(1)).alias("n"))
        items = [(i.value, output_name(i, k)) for k, i in enumerate(query.items)] if query.items is not None else [(Name(c), c) for c in columns]
        sorts = [(unaliased(s.value, query, columns), s.descending) for s in query.sorts]
        sorts = [(x, down) for x, down in sorts if any(isinstance(y, (Name, Aggregate)) for y in x.walk())]  # constants sort nothing
        plan = self._aggregated if is_aggregate(query, columns) else self._plain
        result = plan(df, query, compile_, items, sorts, table, columns)
        result.window, result.now, result.seen, result.kept = query.window, now, seen, kept
        return result

    def _plain(self, df: DataFrame, query: Query, compile_: _Compiler, items, sorts, table: Table, columns: list[str]) -> Result:
        order = [_sorted(compile_(x), down) for x, down in sorts]
        if table.order:
            order.append(F.col(table.order).asc() if order else F.col(table.order).desc())
        notes = [] if query.limit is not None else [f"No LIMIT given: the first {DEFAULT_LIMIT} rows."]
        limit = DEFAULT_LIMIT if query.limit is None else query.limit
        names = [name for _, name in items]
        ordered = df.orderBy(*order) if order else df
        chosen = [V.shown(compile_(x)).alias(name) for x, name in items]
        shown = ordered.limit(limit).select(*chosen)
        return Result(shown, shown, names, 0, limit, None, 0.0, notes, ordered.select(*chosen))

    def _aggregated(self, df: DataFrame, query: Query, compile_: _Compiler, items, sorts, table: Table, columns: list[str]) -> Result:
        keys = list(dict.fromkeys(fold(unaliased(g, query, columns)) for g in query.groups))
        items = [(fold(x), name) for x, name in items]
        sorts = [(fold(x), down) for x, down in sorts]
        found = list(dict.fromkeys(a for x in [*(x for x, _ in items), *(x for x, _ in sorts)] for a in aggregates(x)))
        given: dict[Node, V.Value] = {}
        groups = []
        for k, node in enumerate(keys):
            v = compile_(node)
            groups.append(v.column.cast("string").alias(f"__key{k}") if v.kind == "null" else v.column.alias(f"__key{k}"))
            given[node] = V.Value(F.col(f"__key{k}"), v.kind if v.kind != "null" else "string")
        measures: list[Column] = []
        tops: list[tuple[str, Aggregate]] = []
        for k, a in enumerate(found):
            name = f"__agg{k}"
            if a.name == "top_k":
                compile_(a.args[0])
                tops.append((name, a))
                given[a] = V.Value(F.coalesce(F.col(name), F.array().cast("array<struct<value:string,count:bigint>>")), "list")
            else:
                v = self._measure(a, compile_)
                measures.append(v.column.alias(name))
                given[a] = V.Value(F.col(name), v.kind)
        after = _Compiler({}, compile_.now, given)
        first = F.col(table.order) if table.order else F.lit(0)
        order: list[Column] = []
        sorting: set[str] = set()
        for k, (x, down) in enumerate(sorts):
            if any(isinstance(y, Name) and y not in given for y in _outside(x, given)):  # not grouped by: the group's first row tells
                v = compile_(x)
                measures.append(F.min_by(v.column, first).alias(f"__sort{k}"))
                sorting.add(f"__sort{k}")
                order.append(_sorted(V.Value(F.col(f"__sort{k}"), v.kind), down))
            else:
                order.append(_sorted(after(x), down))
        measures.append(F.min(first).alias("__first") if table.order else F.count(F.lit(1)).alias("__first"))
        if len(tops) == 1 and all(a.name in ("count", "sum", "avg", "min", "max", "top_k") for a in found):
            grouped = self._by_value(df, groups, found, tops[0][1], first, [(k, x) for k, (x, _) in enumerate(sorts) if f"__sort{k}" in sorting], compile_)
        else:
            grouped = df.groupBy(*groups).agg(*measures) if groups else df.agg(*measures)
            for name, a in tops:
                grouped = self._with_top(grouped, df, groups, name, a, compile_)
        if groups and table.order:
            order.append(F.col("__first").asc())
        names = [name for _, name in items]
        ordered = grouped.orderBy(*order) if order and groups else grouped
        shown = [V.shown(after(x)).alias(f"__out{k}") for k, (x, _) in enumerate(items)]
        identity = [F.col(f"__key{k}") for k in range(len(keys))]
        every = ordered.select(*shown, *identity)
        limited = ordered.limit(query.limit).select(*shown, *identity) if query.limit is not None else every
        labels = [*names, *(f"__key{k}" for k in range(len(keys)))]
        leading = 0
        for x, _ in items:
            if x not in keys:
                break
            leading += 1
        visible = limited.select(*[f"__out{k}" for k in range(len(names))]).toDF(*names)
        return Result(visible, limited.toDF(*labels), names, leading, query.limit, None, 0.0, [], every.toDF(*labels))

    def _measure(self, a: Aggregate, compile_: _Compiler) -> V.Value:
        args = [compile_(x) for x in a.args[:1]]
        if args and args[0].kind == "mixed" and a.name in ("sum", "avg", "percentile"):
            raise QueryError(f"{a.name}() needs numbers.", a.start, a.end)
        if args and args[0].kind == "string" and a.name in ("sum", "avg", "percentile"):
            raise QueryError(f"{a.name}() needs numbers, not text.", a.start, a.end)
        if a.name == "count":
            return V.Value(F.count(F.lit(1)), "int")
        if a.name == "count_distinct":
            return V.distinct(args[0], self.approximate is True)
        if a.name == "sum":
            return V.summed(args[0])
        if a.name == "avg":
            return V.averaged(args[0])
        if a.name == "percentile":
            return V.percentile(args[0], float(constant(a.args[1], "The percentile")), self.approximate is not False)
        return V.extreme(a.name, args[0])

    def _by_value(self, df: DataFrame, groups: list[Column], found: list[Aggregate], top: Aggregate, first: Column, sorts: list[tuple[int, Node]], compile_: _Compiler) -> DataFrame:
        """All aggregates with one top_k() in a single scan: by group and value first, then by group."""
        v, k, there = self._top(top, compile_)
        keys = [f"__key{i}" for i in range(len(groups))]
        parts: list[Column] = [F.count(F.lit(1)).alias("__n"), F.min(first).alias("__least")]
        whole: list[Column] = [F.min("__least").alias("__first")]
        for i, a in enumerate(found):
            part = f"__part{i}"
            x = compile_(a.args[0]) if a.args else None
            if a.name == "top_k":
                best = F.array_sort(F.collect_list(F.when(F.col("__there") & (F.col("__rank") <= k), F.struct("__rank", "__value", "__n"))))  # at most k
                done = F.transform(best, lambda b: F.struct(b["__value"].alias("value"), b["__n"].alias("count")))
            elif a.name == "count":
                done = F.coalesce(F.sum("__n"), F.lit(0))
            elif a.name == "avg":
                self._measure(a, compile_)
                number = F.lit(None).cast("double") if x.kind == "null" else x.column.cast("double")
                parts += [F.sum(number).alias(part), F.count(number).alias(f"{part}n")]
                done = F.coalesce(F.round(F.sum(part) / F.nullif(F.sum(f"{part}n"), F.lit(0)), 3), F.lit(0.0))
            else:
                self._measure(a, compile_)
                if a.name == "sum":
                    kind = "float" if x.kind == "float" else "int"
                    parts.append(F.sum(F.lit(0) if x.kind == "null" else x.column.cast("long") if x.kind == "bool" else x.column).alias(part))
                    done = V.summed(V.Value(F.col(part), kind)).column
                else:
                    parts.append(V.extreme(a.name, x).column.alias(part))
                    done = V.extreme(a.name, V.Value(F.col(part), x.kind if x.kind != "null" else "string")).column
            whole.append(done.alias(f"__agg{i}"))
        for i, x in sorts:
            parts.append(F.min_by(compile_(x).column, first).alias(f"__by{i}"))
            whole.append(F.min_by(f"__by{i}", "__least").alias(f"__sort{i}"))
        counts = df.groupBy(*groups, there.alias("__there"), F.when(there, V.text(v)).alias("__value")).agg(*parts)
        rank = F.row_number().over(Window.partitionBy(*(keys or [F.lit(1)])).orderBy(F.desc("__there"), F.desc("__n"), F.asc("__value")))
        ranked = counts.withColumn("__rank", rank)
        return ranked.groupBy(*keys).agg(*whole) if keys else ranked.agg(*whole)

    def _top(self, a: Aggregate, compile_: _Compiler) -> tuple[V.Value, int, Column]:
        """The value that is counted, how many are asked for, and which rows have one."""
        v = compile_(a.args[0])
        k = min(MOST_TOP, max(1, constant(a.args[1], "How many", whole=True) if len(a.args) > 1 else USUAL_TOP))
        there = F.lit(False) if v.kind == "null" else v.column["rank"] > 0 if v.kind == "mixed" else v.column.isNotNull()
        return v, k, there

    def _with_top(self, grouped: DataFrame, df: DataFrame, groups: list[Column], name: str, a: Aggregate, compile_: _Compiler) -> DataFrame:
        """Add the most frequent values of each group: counted in two steps, so that only the best k of a group meet."""
        v, k, there = self._top(a, compile_)
        keys = [f"__key{i}" for i in range(len(groups))]
        counts = df.where(there).groupBy(*groups, V.text(v).alias("value")).agg(F.count(F.lit(1)).alias("count"))
        rank = F.row_number().over(Window.partitionBy(*(keys or [F.lit(1)])).orderBy(F.desc("count"), F.asc("value")))
        best = counts.withColumn("rank", rank).where(F.col("rank") <= k)
        tops = F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "count"))), lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count")))
        lists = best.groupBy(*[F.col(x).alias(f"{x}t") for x in keys]).agg(tops.alias(name)) if keys else best.agg(tops.alias(name)).withColumn("__onet", F.lit(1))
        if not keys:
            return grouped.withColumn("__one", F.lit(1)).join(lists, F.col("__one") == F.col("__onet"), "left").drop("__one", "__onet")
        same = None
        for x in keys:
            equal = grouped[x].eqNullSafe(lists[f"{x}t"])
            same = equal if same is None else same & equal
        return grouped.join(lists, same, "left").drop(*[f"{x}t" for x in keys])


def _sorted(v: V.Value, down: bool) -> Column:
    return v.column.desc_nulls_last() if down else v.column.asc_nulls_first()


def _outside(node: Node, given: dict[Node, V.Value]):
    """The parts of a node that are not given."""
    if node not in given:
        yield node
        for p in node.parts():
            yield from _outside(p, given)
