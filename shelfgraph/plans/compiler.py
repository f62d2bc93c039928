"""Compiles a query to DataFrame operations; no user-defined function and no action, but one scan for the types of a map property.

Each pattern node is a filtered scan of the nodes, each hop an inner join over the edges. Predicates are ordinary expressions, so the optimiser pushes each
to its scan. The order of bindings is (first node, edge, edge, ...); it is carried only where it can be seen. Where only the number of bindings is seen, an end
of the pattern that no item reads is counted for each node that it hangs on, before it is joined, so that two fans at one node are not multiplied out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from shelfgraph.functions import values as V
from shelfgraph.graph import Graph
from shelfgraph.plans.syntax import Item, Lit, NodePattern, Op, Prop, Query, RelPattern, parse
from shelfgraph.schema import BOOL, FLOAT, INT, LIST, STR, GraphError


def run_query(graph: Graph, text: str, ordered: bool = False) -> DataFrame:
    """The result of ``text``, one column for each RETURN item. Rows are in the language's order if it has ORDER BY, SKIP, LIMIT or a relevance order, or if ``ordered``."""
    return _Compiler(graph, parse(text), ordered).frame()


def conjuncts(e: object) -> Iterator[object]:
    """The parts of a predicate that must all hold."""
    if isinstance(e, Op) and e.op == "and":
        for x in e.args:
            yield from conjuncts(x)
    elif e is not None:
        yield e


def directed(c: Column, desc: bool) -> Column:
    """Nulls are last, or first when descending."""
    return c.desc_nulls_first() if desc else c.asc_nulls_last()


@dataclass
class _Out:
    item: Item
    value: V.Value | None
    node: int | None


class _Compiler:
    def __init__(self, graph: Graph, query: Query, ordered: bool):
        self.g, self.q, self.ordered = graph, query, ordered
        self.place: dict[str, int] = {}
        for i, n in enumerate(query.nodes):
            if n.var is not None:
                self.place.setdefault(n.var, i)
        self.types = {c: graph.nodes.schema[c].dataType for c in graph.promoted.values()}

    # values

    def prop(self, i: int, prop: str) -> V.Value:
        if prop in ("name", "kind"):
            return V.of_column(F.col(f"n{i}_{prop}"), T.StringType())
        if prop in self.g.promoted:
            c = self.g.promoted[prop]
            return V.of_column(F.col(f"n{i}_{c}"), self.types[c])
        if "props" in self.g.nodes.columns:
            return V.of_map(F.col(f"n{i}_props"), prop)
        return V.null_value()

    def scalar(self, e: object) -> V.Value:
        if isinstance(e, Lit):
            return V.literal(e.value)
        if isinstance(e, Prop):
            i = self.place.get(e.var)
            if i is None:
                return V.null_value()
            # a bare variable is a node: never null, comparable with nothing
            return V.Value(F.lit(False)) if e.prop is None else self.prop(i, e.prop)
        return V.null_value()  # a predicate as an operand is null

    def test(self, e: object, strict: bool = True) -> Column:
        """A predicate. With ``strict`` it is true or false; else it may be null for false, as a filter takes it, so that a scan can use it."""
        done = V.total if strict else (lambda c: F.lit(False) if c is None else c)
        if not isinstance(e, Op):
            return V.truthy(self.scalar(e))
        a = e.args
        if e.op == "and":
            return self.test(a[0], strict) & self.test(a[1], strict)
        if e.op == "or":
            return self.test(a[0]) | self.test(a[1])
        if e.op == "not":
            return ~self.test(a[0])
        left = self.scalar(a[0])
        if e.op == "null":
            return left.null
        if e.op == "notnull":
            return ~left.null
        if e.op in ("starts", "ends", "contains", "fuzzy"):
            return done(V.text_match(e.op, left, a[1]))
        if e.op == "regex":
            return done(V.regex_match(left, a[1]))
        if e.op == "in":
            return self.within(left, a[1])
        return done(V.compare(e.op, left, self.scalar(a[1])))

    def within(self, left: V.Value, values: tuple) -> Column:
        parts = []
        for kind, column in ((bool, left.bool), ((int, float), left.num), (str, left.str)):
            own = [v for v in values if isinstance(v, kind) and (kind is bool or not isinstance(v, bool))]
            if own and column is not None:
                parts.append(V.total(column.isin([float(v) for v in own] if column is left.num else own)))
        out = F.lit(False)
        for p in parts:
            out = out | p
        return out

    def overlap(self, e: object) -> Column:
        if isinstance(e, Op) and e.op in ("and", "or"):
            return self.overlap(e.args[0]) + self.overlap(e.args[1])
        return self.test(e).cast("int")

    # frames

    def hop(self, i: int, j: int) -> tuple[RelPattern, bool]:
        """The relation between two neighbours, and whether its edges lead from i to j."""
        rel = self.q.rels[min(i, j)]
        return rel, rel.out == (i < j)

    def kinds(self, i: int) -> tuple[str, ...] | None:
        """The kinds that a node without a label can have, by the relations beside it; None if they are not known."""
        found: list[set[str]] = []
        for j in (i - 1, i + 1):
            if 0 <= j < len(self.q.nodes):
                rel, out = self.hop(j, i)
                if rel.types and all(t in self.g.ends for t in rel.types):
                    found.append({self.g.ends[t][1 if out else 0] for t in rel.types})
        return tuple(k for k in self.g.by_kind if k in set.intersection(*found)) if found else None

    def scan(self, i: int, pattern: NodePattern) -> DataFrame:
        kinds = self.kinds(i) if pattern.label is None else None
        nodes = reduce(DataFrame.unionByName, [self.g.by_kind[k] for k in kinds]) if kinds else self.g.nodes_of(pattern.label)
        nodes = nodes.select([F.col(c).alias(f"n{i}_{c}") for c in nodes.columns if c != "id" and c != "props_json"])
        for k, v in pattern.props:
            c = V.compare("=", self.prop(i, k), V.literal(v))
            nodes = nodes.where(F.lit(False) if c is None else c)
        return nodes

    def bindings(self) -> tuple[DataFrame, list[Column]]:
        frame, order = self.scan(0, self.q.nodes[0]), [F.col("n0_idx")]
        for j, rel in enumerate(self.q.rels, 1):
            edges = self.g.edges_of(rel.types)
            near, far = ("src", "dst") if rel.out else ("dst", "src")
            edges = edges.select(F.col("eseq").alias(f"e{j}_seq"), F.col(near).alias(f"e{j}_near"), F.col(far).alias(f"e{j}_far"))
            frame = frame.join(edges, F.col(f"n{j - 1}_idx") == F.col(f"e{j}_near")).join(self.scan(j, self.q.nodes[j]), F.col(f"e{j}_far") == F.col(f"n{j}_idx"))
            order.append(F.col(f"e{j}_seq"))
        if self.q.where is not None:
            frame = frame.where(self.test(self.q.where, strict=False))
        return frame, order

    def edges(self, i: int, j: int) -> DataFrame:
        """Edges between two neighbours, with ``near`` at i."""
        rel, out = self.hop(i, j)
        k = max(i, j)
        near, far = ("src", "dst") if out else ("dst", "src")
        return self.g.edges_of(rel.types).select(F.col(near).alias(f"e{k}_near"), F.col(far).alias(f"e{k}_far"))

    def mentioned(self, e: object) -> set[int]:
        """Places of the nodes that a predicate reads."""
        if isinstance(e, Op):
            return set().union(*map(self.mentioned, e.args))
        return {self.place[e.var]} if isinstance(e, Prop) and e.var in self.place else set()

    def counted(self, outs: list[_Out]) -> tuple[DataFrame, Column | None]:
        """The bindings of a query that returns aggregates, and the column that says how often each counts, None if all count once."""
        tests = list(conjuncts(self.q.where))
        read = {o.node for o in outs if o.node is not None and o.item.agg != "count"}.union(*(m for m in map(self.mentioned, tests) if len(m) != 1))
        last = len(self.q.nodes) - 1
        path = next((p for p in (range(last + 1), range(last, -1, -1)) if self.turn(p, read)), None)
        if path is None:
            return self.bindings()[0], None
        at: dict[int, list[Column]] = {}
        for e in tests:
            m = self.mentioned(e)
            at.setdefault(min(m) if len(m) == 1 else -1, []).append(self.test(e, strict=False))
        frame, times = self.walk(path, read, at)
        for c in at.get(-1, ()):
            frame = frame.where(c)
        return frame, times

    def turn(self, path: Sequence[int], read: set[int]) -> int | None:
        """The first inner place of ``path`` where edges meet head to head or tail to tail and past which nothing is read."""
        inner = range(1, len(path) - 1)
        return next((k for k in inner if self.hop(path[k - 1], path[k])[1] == self.hop(path[k + 1], path[k])[1] and not read & set(path[k + 1 :])), None)

    def tested(self, i: int, at: dict[int, list[Column]]) -> DataFrame:
        return reduce(DataFrame.where, at.get(i, ()), self.scan(i, self.q.nodes[i]))

    def walk(self, path: Sequence[int], read: set[int], at: dict[int, list[Column]]) -> tuple[DataFrame, Column | None]:
        """The bindings along ``path``; past the first turn there is only the number of bindings of the rest."""
        frame, stop = self.tested(path[0], at), self.turn(path, read)
        for i, j in pairwise(path if stop is None else path[: stop + 1]):
            e = max(i, j)
            frame = frame.join(self.edges(i, j), F.col(f"n{i}_idx") == F.col(f"e{e}_near")).join(self.tested(j, at), F.col(f"e{e}_far") == F.col(f"n{j}_idx"))
        if stop is None:
            return frame, None
        i, j = path[stop], path[stop + 1]
        near, far = F.col(f"e{max(i, j)}_near"), F.col(f"e{max(i, j)}_far")
        own = self.edges(i, j)
        if self.q.nodes[i].props or i in at:  # only the edges of nodes that stay
            own = own.join(self.tested(i, at).select(f"n{i}_idx"), near == F.col(f"n{i}_idx"), "left_semi")
        rest, times = self.walk(path[stop + 1 :], read, at)
        ends = own.join(rest, far == F.col(f"n{j}_idx")).groupBy(near.alias(f"t{i}_idx")).agg(F.sum(F.lit(1) if times is None else times).alias(f"t{i}_times"))
        return frame.join(ends, F.col(f"n{i}_idx") == F.col(f"t{i}_idx")), F.col(f"t{i}_times")

    def output(self, item: Item) -> _Out:
        if item.of is None:
            return _Out(item, None, None)
        i = self.place.get(item.of.var)
        if i is None:
            if item.agg == "count":
                return _Out(item, None, None)
            raise GraphError(f"unknown variable {item.of.var}")
        if item.of.prop is None:
            return _Out(item, None, i)
        return _Out(item, self.prop(i, item.of.prop), i)

    def native(self, out: _Out) -> Column:
        """The column that a caller sees: the value's own type; a map property of several types is a number if all are, else text."""
        if out.value is None:
            i = out.node
            return F.struct(F.col(f"n{i}_idx").alias("idx"), F.col(f"n{i}_kind").alias("kind"), F.col(f"n{i}_name").alias("name"))
        v = out.value
        if v.tag is None:
            for c in (v.int, v.num, v.str, v.bool, v.list):
                if c is not None:
                    return c
            return F.lit(None).cast("string")
        tags = self.g.tags_of(out.item.of.prop)
        if tags <= {BOOL}:
            return v.bool if tags else F.lit(None).cast("string")
        if tags == {INT}:
            return v.int
        if tags <= {INT, FLOAT}:
            return v.num
        if tags == {STR}:
            return v.str
        if tags == {LIST}:
            return v.list
        return F.when(v.tag == BOOL, v.bool.cast("string")).when(v.tag == INT, v.int.cast("string")).when(v.tag == FLOAT, v.num.cast("string")).when(v.tag == LIST, F.to_json(v.list)).otherwise(v.str)

    @staticmethod
    def sort_columns(v: V.Value) -> list[Column]:
        """Numbers, then strings, then truth values."""
        return [c for c in (v.num, v.str, v.bool) if c is not None]

    def frame(self) -> DataFrame:
        outs = [self.output(it) for it in self.q.items]
        names = [o.item.column for o in outs]
        if any(o.item.agg for o in outs):
            return self.grouped(outs, names)
        frame, order = self.bindings()
        limited = self.q.skip is not None or self.q.limit is not None
        keys: list[tuple[Column, bool]] = []  # (key, descending)
        if self.q.order:
            for ref, desc in self.q.order:
                keys += [(c, desc) for c in self.sort_columns(self.key_value(ref, outs))]
        elif self.q.where is not None and self.relevance(self.q.where):
            keys.append((self.overlap(self.q.where), True))
        if keys or limited or self.ordered:
            keys += [(c, False) for c in order]
        columns = [self.native(o).alias(f"c{k}") for k, o in enumerate(outs)]
        shown = [f"c{k}" for k in range(len(outs))]
        if not keys:
            frame = frame.select(*columns)
            return (frame.distinct() if self.q.distinct else frame).toDF(*names)
        frame = frame.select(*columns, *[c.alias(f"o{j}") for j, (c, _) in enumerate(keys)])
        by = [directed(F.col(f"o{j}"), desc) for j, (_, desc) in enumerate(keys)]
        if self.q.distinct:  # the first of equal rows stays; a rank of 1 is limited within each task before the shuffle
            frame = frame.withColumn("rank", F.row_number().over(Window.partitionBy(*shown).orderBy(*by))).where("rank = 1")
        return self.cut(frame.orderBy(*by).select(*shown)).toDF(*names)

    def key_value(self, ref: Prop, outs: list[_Out]) -> V.Value:
        if ref.prop is None:
            for o in outs:
                if o.item.alias == ref.var and o.value is not None:
                    return o.value
            if ref.var in self.place:
                return V.Value(F.lit(False))
            raise GraphError(f"unknown variable {ref.var} in ORDER BY")
        if ref.var not in self.place:
            raise GraphError(f"unknown variable {ref.var} in ORDER BY")
        return self.prop(self.place[ref.var], ref.prop)

    def relevance(self, e: object) -> bool:
        """Whether rows that hold can differ in the number of leaves that hold: only below an OR."""
        return isinstance(e, Op) and (e.op == "or" or e.op == "and" and any(self.relevance(x) for x in e.args))

    def cut(self, frame: DataFrame) -> DataFrame:
        if self.q.skip is not None:
            frame = frame.offset(self.q.skip)
        return frame if self.q.limit is None else frame.limit(self.q.limit)

    @staticmethod
    def aggregate(agg: str, num: Column, times: Column | None) -> Column:
        """An aggregate of ``num``, each value taken so many times."""
        if times is None or agg in ("min", "max"):
            return getattr(F, agg)(num).cast("double")
        if agg == "sum":
            return F.sum(num * times).cast("double")
        return F.sum(num.cast("double") * times) / F.sum(F.when(num.isNotNull(), times))

    def grouped(self, outs: list[_Out], names: list[str]) -> DataFrame:
        """Groups by the items that are not aggregates; no rows give no group. Integers and floats are different keys. ORDER BY sorts the groups."""
        frame, times = self.counted(outs)
        keys, aggs, shown = [], [(F.count(F.lit(1)) if times is None else F.sum(times)).alias("rows")], []
        for k, o in enumerate(outs):
            if o.item.agg is None:
                if o.value is not None and o.value.tag is not None:
                    keys.append(F.struct(o.value.tag.alias("t"), self.native(o).alias("v")).alias(f"k{k}"))
                    shown.append(F.col(f"k{k}.v").alias(f"c{k}"))
                else:
                    keys.append(self.native(o).alias(f"k{k}"))
                    shown.append(F.col(f"k{k}").alias(f"c{k}"))
            elif o.item.agg == "count":
                shown.append(F.col("rows").alias(f"c{k}"))
            else:
                num = o.value.num if o.value is not None and o.value.num is not None else F.lit(None).cast("double")
                aggs.append(self.aggregate(o.item.agg, num, times).alias(f"a{k}"))
                shown.append(F.col(f"a{k}").alias(f"c{k}"))
        grouped = frame.groupBy(*keys).agg(*aggs) if keys else frame.agg(*aggs).where("rows > 0")
        out = grouped.select(*shown)
        if self.q.distinct:
            out = out.distinct()
        order = []
        for ref, desc in self.q.order:
            at = next((k for k, o in enumerate(outs) if (ref.prop is None and o.item.alias == ref.var) or (o.item.agg is None and o.item.of == ref) or o.item.column == ref.var), None)
            if at is None:
                raise GraphError(f"ORDER BY {ref.var} is not among the returned columns")
            order.append(directed(F.col(f"c{at}"), desc))
        if order or self.q.skip is not None or self.q.limit is not None or self.ordered:
            order += [F.col(f"c{k}").asc_nulls_last() for k, o in enumerate(outs) if o.item.agg is None]
        if order:
            out = out.orderBy(*order)
        return self.cut(out).toDF(*names)
