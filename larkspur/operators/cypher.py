"""A Cypher reader: query text is parsed and compiled to one DataFrame plan over a node table and an edge table.

Clauses: MATCH, OPTIONAL MATCH, WHERE, WITH, UNWIND, RETURN, DISTINCT, ORDER BY, SKIP, LIMIT. A variable-length
part reaches each target once for each source, at its least number of hops. Parallel edges to a neighbour are one
row. Variables that are bound already are joined, labels of targets are checked. Writing clauses are in
`cypher_write`.

props is a struct or a map. A struct keeps types; a map holds text, which a number is compared with as a number.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import visible

TOKEN = re.compile(r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>`[^`]+`|\$?[A-Za-z_]\w*)|(?P<op><=|>=|<>|=~|\.\.|[-+*/%=<>()\[\]{},.:|]))")
AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}
STOPS = {"match", "optional", "where", "with", "unwind", "return", "order", "skip", "limit"}
#: Hops of an open variable-length part.
MOST_HOPS = 20
#: Up to so many hops are planned at once; beyond it a round is checkpointed and the search ends when no row is new.
PLANNED_HOPS = 4


class CypherError(ValueError):
    pass


@dataclass
class NodePart:
    var: str | None
    labels: list[str]
    props: dict


@dataclass
class EdgePart:
    var: str | None
    types: list[str]
    direction: str
    hops: tuple[int, int] | None
    props: dict


@dataclass
class Clause:
    kind: str
    patterns: list = field(default_factory=list)
    optional: bool = False
    where: tuple | None = None
    items: list = field(default_factory=list)  # (expression, name)
    distinct: bool = False
    order: list = field(default_factory=list)  # (expression, printed, descending)
    skip: int = 0
    limit: int | None = None


class Parser:
    def __init__(self, text: str):
        self.text, self.toks, self.at = text, [], 0
        end = 0
        while text[end:].strip(" \t\r\n;"):
            m = TOKEN.match(text, end)
            if not m:
                raise CypherError(f"unexpected {text[end:].strip()[:20]!r}")
            kind = m.lastgroup
            self.toks.append((kind, m.group(kind), m.start(kind), m.end()))
            end = m.end()

    # -- tokens

    def peek(self, ahead: int = 0) -> str:
        at = self.at + ahead
        return self.toks[at][1] if at < len(self.toks) and self.toks[at][0] != "text" else ""

    def word(self, ahead: int = 0) -> str:
        return self.peek(ahead).lower()

    def take(self, *wanted: str) -> bool:
        if self.word() in wanted and self.at < len(self.toks):
            self.at += 1
            return True
        return False

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise CypherError(f"{wanted} expected, not {self.peek() or 'the end'!r}")

    def name(self) -> str:
        if self.at == len(self.toks) or self.toks[self.at][0] != "name":
            raise CypherError("a name is expected")
        self.at += 1
        return self.toks[self.at - 1][1].strip("`")

    # -- clauses

    def query(self) -> list[Clause]:
        out = []
        while self.at < len(self.toks):
            out.append(self.clause())
            if out[-1].kind == "return" and self.at < len(self.toks):
                raise CypherError("nothing may follow RETURN")
        if not out or out[-1].kind != "return":
            raise CypherError("RETURN is missing")
        return out

    def clause(self) -> Clause:
        """A reading clause."""
        if self.word() in ("optional", "match"):
            c = Clause("match", optional=self.take("optional"))
            self.need("match")
            c.patterns = self.patterns()
            c.where = self.expr() if self.take("where") else None
            return c
        if self.take("unwind"):
            e = self.expr()
            self.need("as")
            return Clause("unwind", items=[(e, self.name())])
        if self.word() in ("with", "return"):
            return self.projection(self.word())
        raise CypherError(f"unknown clause {self.peek()!r}")

    def patterns(self) -> list:
        out = [self.pattern()]
        while self.take(","):
            out.append(self.pattern())
        return out

    def projection(self, kind: str) -> Clause:
        self.at += 1
        c = Clause(kind, distinct=self.take("distinct"))
        while True:
            if self.peek() == "*":
                raise CypherError(f"{kind} * is not supported")
            e, printed = self.printed()
            c.items.append((e, self.name() if self.take("as") else printed))
            if not self.take(","):
                break
        if self.take("order"):
            self.need("by")
            while True:
                e, printed = self.printed()
                down = self.take("desc", "descending") or (self.take("asc", "ascending") and False)
                c.order.append((e, printed, bool(down)))
                if not self.take(","):
                    break
        c.skip = self.count() if self.take("skip") else 0
        c.limit = self.count() if self.take("limit") else None
        if kind == "with" and self.take("where"):
            c.where = self.expr()
        return c

    def count(self) -> int:
        e = self.expr()
        if e[0] != "lit" or not isinstance(e[1], int):
            raise CypherError("a whole number is expected")
        return e[1]

    def printed(self) -> tuple[tuple, str]:
        start = self.toks[self.at][2] if self.at < len(self.toks) else 0
        e = self.expr()
        return e, self.text[start : self.toks[self.at - 1][3]]

    # -- patterns

    def pattern(self) -> list:
        parts = [self.node()]
        while self.peek() in ("-", "<"):
            parts += [self.edge(), self.node()]
        return parts

    def node(self) -> NodePart:
        self.need("(")
        var = self.name() if self.peek() not in (":", "{", ")") else None
        labels = []
        while self.take(":"):
            labels.append(self.name())
        props = self.map() if self.peek() == "{" else {}
        self.need(")")
        return NodePart(var, labels, props)

    def edge(self) -> EdgePart:
        into = self.take("<")
        self.need("-")
        e = EdgePart(None, [], "BOTH", None, {})
        if self.take("["):
            e.var = self.name() if self.peek() not in (":", "*", "{", "]") else None
            if self.take(":"):
                e.types.append(self.name())
                while self.take("|"):
                    self.take(":")
                    e.types.append(self.name())
            if self.take("*"):
                low = self.whole()
                e.hops = (low or 1, low or MOST_HOPS) if low is None or self.peek() != ".." else (low, MOST_HOPS)
                if self.take(".."):
                    e.hops = (1 if low is None else low, self.whole() or MOST_HOPS)
                elif low == 0:
                    e.hops = (0, 0)
                if e.var:
                    raise CypherError("a variable-length edge can't have a variable")
            e.props = self.map() if self.peek() == "{" else {}
            self.need("]")
        self.need("-")
        out = self.take(">")
        e.direction = "BOTH" if into == out else "OUT" if out else "IN"
        return e

    def whole(self) -> int | None:
        if self.at < len(self.toks) and self.toks[self.at][0] == "num":
            self.at += 1
            return int(self.toks[self.at - 1][1])
        return None

    def map(self) -> dict:
        self.need("{")
        out = {}
        while not self.take("}"):
            key = self.name()
            self.need(":")
            out[key] = self.expr()
            if self.peek() != "}":
                self.need(",")
        return out

    # -- expressions, loosest first

    def expr(self) -> tuple:
        e = self.conjunction()
        while self.take("or"):
            e = ("or", e, self.conjunction())
        return e

    def conjunction(self) -> tuple:
        e = self.negation()
        while self.take("and"):
            e = ("and", e, self.negation())
        return e

    def negation(self) -> tuple:
        return ("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self) -> tuple:
        e = self.sum()
        while True:
            op = self.word()
            if op in ("=", "<>", "<", "<=", ">", ">=", "=~", "contains", "in"):
                self.at += 1
                e = (op, e, self.sum())
            elif op in ("starts", "ends"):
                self.at += 1
                self.need("with")
                e = (op, e, self.sum())
            elif op == "is":
                self.at += 1
                no = self.take("not")
                self.need("null")
                e = ("notnull" if no else "isnull", e)
            else:
                return e

    def sum(self) -> tuple:
        e = self.product()
        while self.peek() in ("+", "-"):
            self.at += 1
            e = (self.peek(-1), e, self.product())
        return e

    def product(self) -> tuple:
        e = self.unary()
        while self.peek() in ("*", "/", "%"):
            self.at += 1
            e = (self.peek(-1), e, self.unary())
        return e

    def unary(self) -> tuple:
        if self.take("-"):
            e = self.unary()
            return ("lit", -e[1]) if e[0] == "lit" and isinstance(e[1], (int, float)) else ("-", ("lit", 0), e)
        e = self.atom()
        while self.peek() == ".":
            self.at += 1
            e = ("prop", e, self.name())
        return e

    def atom(self) -> tuple:
        if self.at == len(self.toks):
            raise CypherError("an expression is expected")
        kind, t = self.toks[self.at][:2]
        if kind == "text":
            self.at += 1
            return ("lit", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), t[1:-1]))
        if kind == "num":
            self.at += 1
            return ("lit", int(t) if t.isdigit() else float(t))
        if self.take("("):
            e = self.expr()
            self.need(")")
            return e
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.expr())
                if self.peek() != "]":
                    self.need(",")
            return ("list", items)
        if self.peek() == "{":
            return ("map", self.map())
        if kind != "name" or t.lower() in STOPS:
            raise CypherError(f"unexpected {t!r}")
        self.at += 1
        if t.lower() in ("true", "false", "null"):
            return ("lit", {"true": True, "false": False, "null": None}[t.lower()])
        if t[0] == "$":
            return ("param", t[1:])
        if not self.take("("):
            return ("var", t.strip("`"))
        if self.take("*"):
            self.need(")")
            return ("call", t.lower(), False, [])
        distinct, args = self.take("distinct"), []
        while not self.take(")"):
            args.append(self.expr())
            if self.peek() != ")":
                self.need(",")
        return ("call", t.lower(), distinct, args)


def parse(text: str) -> list[Clause]:
    return Parser(text).query()


def children(e: tuple) -> list:
    if e[0] in ("lit", "var", "param"):
        return []
    if e[0] == "call":
        return e[3]
    if e[0] == "list":
        return e[1]
    if e[0] == "map":
        return list(e[1].values())
    return [x for x in e[1:] if isinstance(x, tuple)]


def variables(e: tuple) -> set[str]:
    return {e[1]} if e[0] == "var" else set().union(*map(variables, children(e))) if children(e) else set()


def aggregated(e: tuple) -> bool:
    return (e[0] == "call" and e[1] in AGGREGATES) or any(map(aggregated, children(e)))


def conjuncts(e: tuple) -> list[tuple]:
    return conjuncts(e[1]) + conjuncts(e[2]) if e[0] == "and" else [e]


NUMBERS = (T.NumericType,)


class Compiler:
    def __init__(self, nodes: DataFrame, edges: DataFrame, params: dict | None = None):
        keep = [c for c in ("id", "labels", "props", "embedding", "valid_from", "valid_to") if c in nodes.columns]
        self.nodes = nodes.select(F.struct(*keep).alias("n"))
        self.edges, self.params = edges, params or {}
        self.spark = nodes.sparkSession
        self.fresh = 0

    # -- expressions

    def type(self, rows: DataFrame, c: Column) -> T.DataType:
        return rows.select(c).schema[0].dataType

    def column(self, rows: DataFrame, e: tuple) -> Column:
        kind = e[0]
        if kind in ("lit", "param"):
            if kind == "param" and e[1] not in self.params:
                raise CypherError(f"no parameter {e[1]}")
            v = e[1] if kind == "lit" else self.params[e[1]]
            return F.lit(v).cast("long") if isinstance(v, int) and not isinstance(v, bool) else F.lit(v)
        if kind == "var":
            if e[1] not in rows.columns:
                raise CypherError(f"unknown variable {e[1]}")
            return F.col(f"`{e[1]}`")
        if kind == "prop":
            return self.property(rows, e)
        if kind == "list":
            return F.array(*[self.column(rows, x) for x in e[1]])
        if kind == "map":
            return F.struct(*[self.column(rows, x).alias(k) for k, x in e[1].items()])
        if kind == "call":
            return self.aggregate(rows, e) if e[1] in AGGREGATES else self.function(rows, e)
        a = self.column(rows, e[1])
        if kind == "not":
            return ~a
        if kind == "isnull":
            return a.isNull()
        if kind == "notnull":
            return a.isNotNull()
        b = self.column(rows, e[2])
        if kind in ("and", "or"):
            return F.when(a.isNotNull() & b.isNotNull(), (a & b) if kind == "and" else (a | b))
        if kind == "in":
            if not isinstance(self.type(rows, b), T.ArrayType):
                return F.lit(None).cast("boolean")
            return F.exists(b, lambda x: x.eqNullSafe(a))
        if kind in ("contains", "starts", "ends"):
            return getattr(a, {"contains": "contains", "starts": "startswith", "ends": "endswith"}[kind])(b)
        if kind == "=~":
            return self.like(a, e[2])
        return self.binary(rows, kind, a, b, e)

    def property(self, rows: DataFrame, e: tuple) -> Column:
        base = self.column(rows, e[1])
        t = self.type(rows, base)
        if not isinstance(t, T.StructType):
            return base[e[2]] if isinstance(t, T.MapType) else F.lit(None)
        names = t.fieldNames()
        if "props" in names:
            inside = t["props"].dataType
            if isinstance(inside, T.MapType):
                return base["props"][e[2]]
            if e[2] in inside.fieldNames():
                return base["props"][e[2]]
        return base[e[2]] if e[2] in names else F.lit(None)

    def like(self, a: Column, pattern: tuple) -> Column:
        """=~ knows exact text and .* at either end, nothing else of regular expressions."""
        if pattern[0] != "lit" or not isinstance(pattern[1], str):
            raise CypherError("=~ needs a text")
        p = pattern[1]
        front, back = p.startswith(".*"), p.endswith(".*") and len(p) > 2
        core = p[2 * front : len(p) - 2 * back]
        return a.contains(core) if front and back else a.endswith(core) if front else a.startswith(core) if back else a == core

    def binary(self, rows: DataFrame, op: str, a: Column, b: Column, e: tuple) -> Column:
        s, t = self.type(rows, a), self.type(rows, b)
        number = isinstance(s, NUMBERS), isinstance(t, NUMBERS)
        if number[0] != number[1] and isinstance(t if number[0] else s, T.StringType) and op != "+":
            # text of a map beside a number
            a, b = (c if n else c.try_cast("double") for c, n in zip((a, b), number, strict=True))
            number, s, t = (True, True), T.DoubleType(), T.DoubleType()
        if op in ("=", "<>"):
            if isinstance(s, T.NullType) or isinstance(t, T.NullType) or s == t or all(number):
                return a.eqNullSafe(b) if op == "=" else ~a.eqNullSafe(b)
            both = a.isNull() & b.isNull()
            return both if op == "=" else ~both
        if op in ("<", "<=", ">", ">="):
            if not all(number) and s != t:
                return F.lit(None).cast("boolean")
            a, b = (F.when(~F.isnan(c), c) if isinstance(k, (T.DoubleType, T.FloatType)) else c for c, k in ((a, s), (b, t)))
            return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        if op == "+" and isinstance(s, T.StringType) and isinstance(t, T.StringType):
            return F.concat(a, b)
        if not all(number):
            return F.lit(None)
        whole = isinstance(s, T.IntegralType) and isinstance(t, T.IntegralType)
        if op == "/":
            return F.call_function("div", a, F.when(b != 0, b)) if whole else F.try_divide(a.cast("double"), b.cast("double"))
        if op == "%":
            return F.when(b != 0, a) % F.when(b != 0, b)
        return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b)

    def function(self, rows: DataFrame, e: tuple) -> Column:
        name, args = e[1], [self.column(rows, x) for x in e[3]]
        if name == "coalesce" and args:
            return F.coalesce(*args)
        if len(args) != 1:
            return F.lit(None)
        (c,) = args
        if name in ("id", "labels", "type"):
            return c[name]
        if name == "size":
            return (F.octet_length(c) if isinstance(self.type(rows, c), T.StringType) else F.when(c.isNotNull(), F.size(c))).cast("long")
        casts = {"tointeger": "long", "toint": "long", "tofloat": "double", "tostring": "string"}
        return c.try_cast(casts[name]) if name in casts else F.lit(None)

    def aggregate(self, rows: DataFrame, e: tuple) -> Column:
        name, distinct = e[1], e[2]
        if not e[3]:
            return F.count(F.lit(1))
        c = self.column(rows, e[3][0])
        if name == "count":
            return F.count_distinct(c) if distinct else F.count(c)
        if name == "collect":
            return F.collect_set(c) if distinct else F.collect_list(c)
        if name == "sum":
            return F.coalesce(F.sum_distinct(c) if distinct else F.sum(c), F.lit(0))
        return {"avg": F.avg, "min": F.min, "max": F.max}[name](c)

    # -- patterns

    def scan(self, part: NodePart, name: str) -> DataFrame:
        rows = self.nodes.withColumnRenamed("n", name)
        return self.check(rows, part, name)

    def check(self, rows: DataFrame, part: NodePart | EdgePart, name: str) -> DataFrame:
        """Labels and inline properties as filters."""
        for label in getattr(part, "labels", []):
            rows = rows.where(F.array_contains(F.col(f"`{name}`.labels"), label))
        for key, value in part.props.items():
            rows = rows.where(self.column(rows, ("=", ("prop", ("var", name), key), value)))
        return rows

    def named(self, part: NodePart | EdgePart) -> str:
        if part.var:
            return part.var
        self.fresh += 1
        return f"__{self.fresh}"

    def ways(self, part: EdgePart, name: str | None) -> DataFrame:
        """(__a, __b[, edge]): a row for each edge and way along it."""
        e = self.edges.where(F.col("type").isin(part.types)) if part.types else self.edges
        if name:
            e = e.select("src", "dst", F.struct(*[c for c in e.columns]).alias(name))
            e = self.check(e, part, name)
        ends = {"OUT": ("src", "dst"), "IN": ("dst", "src")}
        ways = [e.select(F.col(a).alias("__a"), F.col(b).alias("__b"), *([name] if name else [])) for d, (a, b) in ends.items() if part.direction in (d, "BOTH")]
        return ways[0] if len(ways) == 1 else ways[0].unionByName(ways[1])

    def hop(self, part: EdgePart, name: str | None) -> DataFrame:
        """(__a, __b[, edge]): one row for each neighbour."""
        out = self.ways(part, name)
        if not name:
            return out.distinct()
        order = F.col(f"`{name}`.weight") if "weight" in self.edges.columns else F.col("__b")
        return out.groupBy("__a", "__b").agg(F.min_by(F.col(name), order).alias(name))

    def reach(self, sources: DataFrame, part: EdgePart) -> DataFrame:
        """(__a, __b): breadth-first from each source, each target once at its least hops, those within bounds.

        Only what a round reaches is made distinct, not the edges of the whole graph.
        """
        low, high = part.hops
        hop = self.ways(part, self.named(part) if part.props else None).select(F.col("__a").alias("__x"), F.col("__b").alias("__y"))
        now = sources.select(F.col("__a"), F.col("__a").alias("__b"), F.lit(0).alias("__d"))
        seen = now
        for d in range(1, high + 1):
            step = now.join(hop, now["__b"] == hop["__x"]).select("__a", F.col("__y").alias("__b")).distinct()
            now = step.join(seen, ["__a", "__b"], "left_anti").withColumn("__d", F.lit(d))
            if high > PLANNED_HOPS and self.spark.sparkContext.getCheckpointDir():
                now = now.checkpoint()
                if now.isEmpty():
                    break
            seen = seen.unionByName(now)
        return seen.where(F.col("__d").between(low, high)).select("__a", "__b")

    def ready(self, rows: DataFrame, waiting: list[tuple]) -> DataFrame:
        """Apply, and take from the list, the conditions whose variables are all bound: searches start from fewer rows."""
        for part in [x for x in waiting if variables(x) <= set(rows.columns)]:
            waiting.remove(part)
            rows = rows.where(self.column(rows, part))
        return rows

    def walk(self, rows: DataFrame | None, parts: list, waiting: list[tuple]) -> DataFrame:
        name = self.named(parts[0])
        if rows is None:
            rows = self.scan(parts[0], name)
        elif name in rows.columns:
            rows = self.check(rows, parts[0], name)
        else:
            rows = rows.join(self.scan(parts[0], name))
        rows = self.ready(rows, waiting)
        for edge, node in zip(parts[1::2], parts[2::2], strict=True):
            source, target = F.col(f"`{name}`.id"), self.named(node)
            if edge.hops:
                hop = self.reach(rows.select(source.alias("__a")).where("__a is not null").distinct(), edge)
            else:
                hop = self.hop(edge, self.named(edge) if edge.var or edge.props else None)
            if edge.var and edge.var in rows.columns:
                raise CypherError(f"{edge.var} is bound already")
            rows = rows.withColumn("__s", source).join(hop, F.col("__s") == F.col("__a")).drop("__s", "__a")
            if target in rows.columns:
                rows = rows.where(F.col("__b") == F.col(f"`{target}`.id"))
                rows = self.check(rows, node, target)
            else:
                ends = self.scan(node, target)
                rows = rows.join(ends, F.col("__b") == F.col(f"`{target}`.id"))
            rows, name = self.ready(rows.drop("__b"), waiting), target
        return rows

    def match(self, rows: DataFrame | None, c: Clause) -> DataFrame:
        if not c.optional or rows is None:
            waiting = conjuncts(c.where) if c.where else []
            for parts in c.patterns:
                rows = self.walk(rows, parts, waiting)
            for part in waiting:
                rows = rows.where(self.column(rows, part))  # raises, as a variable is unknown
            return rows.drop(*[x for x in rows.columns if x.startswith("__")])
        used = {p.var for parts in c.patterns for p in parts if p.var} | (variables(c.where) if c.where else set())
        shared = [x for x in rows.columns if x in used]
        if not shared:
            raise CypherError("OPTIONAL MATCH must begin at a bound variable")

        def key(x: str) -> Column:
            t = rows.schema[x].dataType
            names = t.fieldNames() if isinstance(t, T.StructType) else []
            return F.col(f"`{x}`.id") if "id" in names else F.struct(*[F.col(f"`{x}`.{k}") for k in ("src", "dst", "type")]) if "src" in names else F.col(f"`{x}`")

        keyed = rows.select("*", *[key(x).alias(f"__k{i}") for i, x in enumerate(shared)])
        keys = [f"__k{i}" for i in range(len(shared))]
        inner = self.match(keyed.select(*shared).dropDuplicates() if not self.maps(keyed, shared) else keyed.select(*shared, *keys).dropDuplicates(keys).drop(*keys), Clause("match", c.patterns, where=c.where))
        inner = inner.select(*[key(x).alias(f"__r{i}") for i, x in enumerate(shared)], *[x for x in inner.columns if x not in shared])
        on = [F.col(f"__k{i}").eqNullSafe(F.col(f"__r{i}")) for i in range(len(shared))]
        return keyed.join(inner, on, "left").drop(*keys, *[f"__r{i}" for i in range(len(shared))])

    def maps(self, rows: DataFrame, names: list[str]) -> bool:
        return any("map<" in rows.schema[x].dataType.simpleString() for x in names)

    # -- clauses

    def filter(self, rows: DataFrame, where: tuple | None) -> DataFrame:
        for part in conjuncts(where) if where else []:
            rows = rows.where(self.column(rows, part))
        return rows

    def project(self, rows: DataFrame | None, c: Clause) -> DataFrame:
        rows = self.spark.range(1).select() if rows is None else rows
        if any(aggregated(e) for e, _ in c.items):
            keys = [(e, n) for e, n in c.items if not aggregated(e)]
            rows = rows.groupBy(*[self.column(rows, e).alias(n) for e, n in keys]).agg(*[self.column(rows, e).alias(n) for e, n in c.items if aggregated(e)])
            rows = rows.select(*[f"`{n}`" for _, n in c.items])
        else:
            rows = rows.select(*[self.column(rows, e).alias(n) for e, n in c.items])
        if c.distinct:
            rows = rows.distinct()
        if c.order:
            rows = rows.orderBy(*[self.sort_key(rows, *o) for o in c.order])
        rows = rows.offset(c.skip) if c.skip else rows
        rows = rows.limit(c.limit) if c.limit is not None else rows
        return self.filter(rows, c.where)

    def sort_key(self, rows: DataFrame, e: tuple, printed: str, down: bool) -> Column:
        """By an output column, or an expression over them; null sorts lowest, as does a key that names none."""
        if printed in rows.columns:
            k = F.col(f"`{printed}`")
        else:
            k = self.column(rows, e) if variables(e) <= set(rows.columns) else F.lit(None)
        return k.desc_nulls_last() if down else k.asc_nulls_first()

    def run(self, clauses: list[Clause]) -> DataFrame:
        rows = None
        for c in clauses:
            if c.kind == "match":
                rows = self.match(rows, c)
            elif c.kind == "unwind":
                ((e, name),) = c.items
                rows = self.spark.range(1).select() if rows is None else rows
                rows = rows.select("*", F.explode(self.column(rows, e)).alias(name))
            else:
                rows = self.project(rows, c)
        return rows


def cypher(text: str, nodes: DataFrame, edges: DataFrame, params: dict | None = None, *, valid_at: int | None = None) -> DataFrame:
    """GRAPH.QUERY, read only. nodes: id, labels, props; edges: src, dst, type, weight.

    valid_at reads the graph as it was valid at a time (columns valid_from and valid_to of nodes and edges).
    """
    if valid_at is not None:
        nodes, edges = visible(nodes, valid_at), visible(edges, valid_at)
    return Compiler(nodes, edges, params).run(parse(text))


def explain(text: str) -> list[str]:
    """GRAPH.EXPLAIN: the operators of a query in order; the physical plan is that of the DataFrame `cypher` returns."""
    out, bound = [], set()
    for c in parse(text):
        if c.kind == "unwind":
            out.append("Unwind")
            bound.add(c.items[0][1])
            continue
        if c.kind == "match":
            for parts in c.patterns:
                if parts[0].var is None or parts[0].var not in bound:
                    out.append("NodeScan " + ":".join(parts[0].labels) if parts[0].labels else "NodeScan")
                out += [("Optional" if c.optional else "") + ("Expand" if e.hops is None else f"Expand *{e.hops[0]}..{e.hops[1]}") + (" " + "|".join(e.types) if e.types else "") for e in parts[1::2]]
                bound |= {p.var for p in parts if p.var}
            out += ["Filter"] if c.where else []
            continue
        out.append("Aggregate" if any(aggregated(e) for e, _ in c.items) else "Project")
        out += [name for name, there in (("Distinct", c.distinct), ("Sort", c.order), ("Skip", c.skip), ("Limit", c.limit is not None), ("Filter", c.where)) if there]
        bound = {name for _, name in c.items}
    return out
