"""Cypher statements that write: reading clauses, then CREATE, MERGE, SET and DELETE, as operations on the two tables.

Reading clauses see the graph before the statement; each writing clause sees the rows and tables the last one left.
Rows are written to the shared folder before new ids are given, so that an id stays the same when a task runs again.

CREATE makes one node for each row and unbound variable; new ids lie above the greatest one, with gaps. MERGE of a node makes one for
each combination of properties that no node has, and binds all that have it; a null property makes and binds none.
MERGE of an edge needs bound ends. SET reads the rows; where several rows set one property of a node, the greatest value
stays, and a variable read later shows the new one. DELETE of a node removes its edges too, of an edge all parallel
ones of its type. Edges from a node to itself, and at nodes that are null, are not made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import written
from .cypher import Clause, Compiler, CypherError, EdgePart, NodePart, Parser
from .graph import delete_nodes


def loose(t: T.DataType) -> T.DataType:
    """A type whose parts may all be null."""
    if isinstance(t, T.ArrayType):
        return T.ArrayType(loose(t.elementType))
    if isinstance(t, T.MapType):
        return T.MapType(t.keyType, loose(t.valueType))
    return T.StructType([T.StructField(f.name, loose(f.dataType)) for f in t]) if isinstance(t, T.StructType) else t


class Statement(Parser):
    def statement(self) -> tuple[list[Clause], list[Clause]]:
        reads, writes = [], []
        while self.at < len(self.toks):
            if self.take("create"):
                writes.append(Clause("create", patterns=self.patterns()))
            elif self.take("merge"):
                writes.append(Clause("merge", patterns=[self.pattern()]))
            elif self.take("set"):
                writes.append(Clause("set", items=self.several(self.assignment)))
            elif self.take("detach", "delete"):
                self.take("delete")
                writes.append(Clause("delete", items=self.several(self.name)))
            elif writes:
                raise CypherError(f"{self.peek()!r} may not follow a writing clause")
            else:
                reads.append(self.clause())
                if reads[-1].kind == "return":
                    raise CypherError("a statement that writes returns no rows")
        if not writes:
            raise CypherError("a writing clause is missing")
        return reads, writes

    def several(self, one) -> list:
        out = [one()]
        while self.take(","):
            out.append(one())
        return out

    def assignment(self) -> tuple:
        var = self.name()
        self.need(".")
        prop = self.name()
        self.need("=")
        return var, prop, self.expr()


class Writer:
    def __init__(self, nodes: DataFrame, edges: DataFrame, params: dict | None):
        self.nodes, self.edges, self.params = nodes, edges, params
        self.compiler = Compiler(nodes, edges, params)
        self.rows = None

    def run(self, reads: list[Clause], writes: list[Clause]) -> tuple[DataFrame, DataFrame]:
        self.rows = self.compiler.run(reads) if reads else self.nodes.sparkSession.range(0, 1, 1, 1).select(F.lit(True).alias("__row"))
        for c in writes:
            getattr(self, c.kind)(c)
        return self.nodes, self.edges

    # -- parts of a new row

    def value(self, e: tuple) -> Column:
        return self.compiler.column(self.rows, e)

    def record(self, schema: T.StructType, given: dict[str, Column]) -> Column:
        """A struct of a table's columns; those that are not given are null."""
        return F.struct(*[given.get(f.name, F.lit(None)).cast(loose(f.dataType)).alias(f.name) for f in schema])

    def props(self, given: dict[str, Column]) -> Column:
        t = self.nodes.schema["props"].dataType
        if isinstance(t, T.MapType):
            pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast(t.valueType).alias("value")) for k, v in given.items()])
            return F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull())) if given else F.create_map().cast(loose(t))
        unknown = set(given) - set(t.fieldNames())
        if unknown:
            raise CypherError(f"nodes have no property {sorted(unknown)[0]}")
        return self.record(t, given)

    def node(self, part: NodePart, id: Column, given: dict[str, Column]) -> Column:
        labels = F.array(*[F.lit(x) for x in part.labels]).cast("array<string>")
        return self.record(self.nodes.schema, {"id": id, "labels": labels, "props": self.props(given)})

    def next_id(self) -> DataFrame:
        return self.nodes.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("__next"))  # one row

    def numbered(self, rows: DataFrame) -> DataFrame:
        return written(rows.withColumn("__n", F.monotonically_increasing_id()).crossJoin(F.broadcast(self.next_id())), "numbered")

    def added(self, nodes: list[DataFrame]) -> None:
        """The node table with more rows; variables that are matched later see them."""
        self.nodes = reduce(DataFrame.unionByName, nodes, self.nodes)
        self.again()

    def again(self) -> None:
        fresh, self.compiler = self.compiler.fresh, Compiler(self.nodes, self.edges, self.params)
        self.compiler.fresh = fresh

    def bound(self, name: str, what: str) -> bool:
        """Whether a variable holds a node or an edge (what: id or src)."""
        t = self.rows.schema[name].dataType if name in self.rows.columns else None
        return isinstance(t, T.StructType) and what in t.fieldNames()

    # -- clauses

    def create(self, c: Clause) -> None:
        new: dict[str, NodePart] = {}
        for part in (p for parts in c.patterns for p in parts[::2]):
            part.var = self.compiler.named(part)
            if part.var in self.rows.columns or part.var in new:
                if part.labels or part.props:
                    raise CypherError(f"{part.var} is bound already")
            else:
                new[part.var] = part
        if new:
            rows = self.numbered(self.rows)
            for i, (name, part) in enumerate(new.items()):
                self.rows, id = rows, F.col("__next") + F.col("__n") * len(new) + i
                rows = rows.withColumn(name, self.node(part, id, {k: self.value(e) for k, e in part.props.items()}))
            self.rows = rows.drop("__n", "__next")
            self.added([self.rows.select(f"`{name}`.*") for name in new])
        for parts in c.patterns:
            for a, e, b in zip(parts[::2], parts[1::2], parts[2::2], strict=False):
                self.edge(a, e, b, fresh_only=False)

    def edge(self, a: NodePart, e: EdgePart, b: NodePart, fresh_only: bool) -> None:
        if len(e.types) != 1 or e.direction == "BOTH" or e.hops:
            raise CypherError("a new edge needs one type and one direction")
        if not (self.bound(a.var, "id") and self.bound(b.var, "id")):
            raise CypherError("a new edge needs nodes at both ends")
        src, dst = (a, b) if e.direction == "OUT" else (b, a)
        given = {k: self.value(x) for k, x in e.props.items()}
        unknown = set(given) - set(self.edges.columns) | set(given) & {"src", "dst", "type"}
        if unknown:
            raise CypherError(f"edges have no property {sorted(unknown)[0]}")
        given = ({"weight": F.lit(1.0)} if "weight" in self.edges.columns else {}) | given
        given |= {"src": F.col(f"`{src.var}`.id"), "dst": F.col(f"`{dst.var}`.id"), "type": F.lit(e.types[0])}
        made = self.rows.select(self.record(self.edges.schema, given).alias("e")).select("e.*").where("src <> dst")
        if fresh_only:
            there = self.edges.where(F.col("type") == e.types[0]).select("src", "dst").distinct()
            made = made.dropDuplicates(["src", "dst"]).join(there, ["src", "dst"], "left_anti").select(*self.edges.columns)
        self.edges = self.edges.unionByName(made)
        self.again()

    def merge(self, c: Clause) -> None:
        (parts,) = c.patterns
        if len(parts) == 3:
            return self.edge(*parts, fresh_only=True)
        (part,) = parts
        if len(parts) != 1 or (part.var and part.var in self.rows.columns):
            raise CypherError("MERGE takes a new node, or an edge between bound nodes")
        part.var = self.compiler.named(part)
        keys = [f"__p{i}" for i in range(len(part.props))]
        # one more key, the same for all rows, so that a node without properties is no special case
        rows = self.rows.select("*", F.lit(1).alias("__p"), *[self.value(e).alias(k) for k, e in zip(keys, part.props.values(), strict=True)])
        keys = ["__p", *keys]
        if len(keys) > 1:
            rows = rows.where(F.expr(" AND ".join(f"{k} IS NOT NULL" for k in keys)))

        def held() -> DataFrame:
            found = self.compiler.scan(NodePart(part.var, part.labels, {}), part.var)
            have = [self.compiler.property(found, ("prop", ("var", part.var), p)).alias(k) for k, p in zip(keys[1:], part.props, strict=True)]
            return found.select(part.var, F.lit(1).alias("__p"), *have)

        none = rows.select(*keys).distinct().join(held().select(*keys).distinct(), keys, "left_anti")
        made = self.numbered(none)
        given = {p: F.col(k) for k, p in zip(keys[1:], part.props, strict=True)}
        self.added([made.select(self.node(part, F.col("__next") + F.col("__n"), given).alias("n")).select("n.*")])
        self.rows = rows.join(held(), keys).drop(*keys)

    def set(self, c: Clause) -> None:
        t = self.nodes.schema["props"].dataType
        for var, prop, e in c.items:
            if not self.bound(var, "id"):
                raise CypherError(f"{var} is no node")
            kind = t.valueType if isinstance(t, T.MapType) else t[prop].dataType if prop in t.fieldNames() else None
            if kind is None:
                raise CypherError(f"nodes have no property {prop}")
            new = self.rows.select(F.col(f"`{var}`.id").alias("id"), self.value(e).cast(kind).alias("__v")).where("id is not null")
            new = written(new.groupBy("id").agg(F.max("__v").alias("__v")), "values")  # written: later clauses read it twice
            self.nodes = self.replaced(self.nodes, "id", "props", prop, new)
            inner = self.rows.withColumn("__id", F.col(f"`{var}`.id")).join(new.withColumnsRenamed({"id": "__id2"}), F.col("__id") == F.col("__id2"), "left")
            whole = F.col(f"`{var}`").withField("props", self.put(F.col(f"`{var}`.props"), prop))
            self.rows = inner.withColumn(var, F.when(F.col("__id2").isNotNull(), whole).otherwise(F.col(f"`{var}`"))).drop("__id", "__id2", "__v")
        self.again()

    def put(self, props: Column, prop: str) -> Column:
        """props with the value __v; a null value takes the entry out of a map."""
        if not isinstance(self.nodes.schema["props"].dataType, T.MapType):
            return props.withField(f"`{prop}`", F.col("__v"))
        rest = F.map_filter(F.coalesce(props, F.create_map().cast(loose(self.nodes.schema["props"].dataType))), lambda k, v: k != prop)
        return F.when(F.col("__v").isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(prop), F.col("__v"))))

    def replaced(self, table: DataFrame, key: str, column: str, prop: str, new: DataFrame) -> DataFrame:
        joined = table.join(new.withColumnsRenamed({"id": "__id"}), F.col(key) == F.col("__id"), "left")
        return joined.withColumn(column, F.when(F.col("__id").isNotNull(), self.put(F.col(column), prop)).otherwise(F.col(column))).select(*table.columns)

    def delete(self, c: Clause) -> None:
        names, columns = self.nodes.columns, self.edges.columns
        for var in c.items:
            if self.bound(var, "id"):
                self.nodes, self.edges = delete_nodes(self.nodes, self.edges, self.rows.select(F.col(f"`{var}`.id").alias("id")).where("id is not null"))
            elif self.bound(var, "src"):
                gone = self.rows.select(*[F.col(f"`{var}`.{k}").alias(k) for k in ("src", "dst", "type")]).distinct()
                self.edges = self.edges.join(gone, ["src", "dst", "type"], "left_anti")
            else:
                raise CypherError(f"{var} is no node or edge")
        self.nodes, self.edges = self.nodes.select(*names), self.edges.select(*columns)
        self.again()


def execute(text: str, nodes: DataFrame, edges: DataFrame, params: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """GRAPH.QUERY that writes: the node table and the edge table after the statement."""
    return Writer(nodes, edges, params).run(*Statement(text).statement())
