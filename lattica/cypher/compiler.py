"""From tokens to a DataFrame: a pattern is joins, a variable a set of columns, a clause a step."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field
from functools import reduce
from itertools import count
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.cypher.lexer import QueryError, check_read_only
from lattica.graph import FACETS, Graph
from lattica.operators import cycles, shortest, traverse, walks
from lattica.operators.skew import counted, crossed, repeated

AGGREGATES = {"count", "collect", "max", "min", "sum", "avg"}
FUNCTIONS = {"abs", "coalesce", "elementid", "id", "labels", "length", "lower", "nodes", "relationships", "rels", "round", "size", "timestamp", "tolower", "toupper", "type", "upper"}
CLAUSES = {"CALL", "YIELD", "MATCH", "OPTIONAL", "WHERE", "RETURN", "WITH", "UNWIND", "ORDER", "SKIP", "LIMIT", "UNION"}
# Fixed values of the language.
ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


@dataclass
class Node:
    name: str
    labels: list[str]
    props: dict[str, Any]


@dataclass
class Edge:
    name: str
    types: list[str]
    direction: str  # out, in, both
    hops: tuple[int, int | None] | None
    every: bool | None = None  # of a shortest path: all of them, or one
    lean: bool = False  # only which ends are joined counts, not by how many walks
    enough: int | None = None  # so many walks will do


@dataclass
class State:
    df: DataFrame | None = None
    times: str | None = None  # column that says for how many rows a row stands
    nodes: dict[str, list[str]] = field(default_factory=dict)  # variable -> its properties
    edges: dict[str, str] = field(default_factory=dict)  # variable -> "" (types in a column)
    values: set[str] = field(default_factory=set)
    paths: dict[str, list] = field(default_factory=dict)  # named path -> its nodes and edges


class Compiler:
    def __init__(self, g: Graph, found: list[tuple[str, str]], params: dict[str, Any], most_hops: int | None = None):
        self.g, self.t, self.at, self.params, self.fresh, self.s = g, found, 0, params, count(), State()
        self.most_hops, self.now, self.within = most_hops, int(time.time() * 1000), False

    # ---- tokens ----

    def peek(self, ahead: int = 0) -> str:
        return self.t[self.at + ahead][1] if self.at + ahead < len(self.t) else ""

    def word(self) -> str:
        return self.peek().upper() if self.at < len(self.t) and self.t[self.at][0] == "name" else ""

    def take(self, want: str | None = None) -> str:
        got = self.peek()
        if want is not None and got.upper() != want:
            raise QueryError(f"expected {want}, found {got or 'the end'}")
        self.at += 1
        return got

    def maybe(self, *want: str) -> bool:
        if all(self.peek(k).upper() == w for k, w in enumerate(want)):
            self.at += len(want)
            return True
        return False

    def name(self) -> str:
        if self.at >= len(self.t) or self.t[self.at][0] != "name":
            raise QueryError(f"expected a name, found {self.peek() or 'the end'}")
        return self.take().strip("`")

    # ---- patterns ----

    def node(self) -> Node:
        self.take("(")
        name = self.name() if self.peek() not in (":", "{", ")") else f"_n{next(self.fresh)}"
        labels = []
        while self.maybe(":"):
            labels.append(self.name())
        props = {}
        if self.maybe("{"):
            while not self.maybe("}"):
                key = self.name()
                self.take(":")
                props[key] = self.value()
                self.maybe(",")
        self.take(")")
        return Node(name, labels, props)

    def value(self) -> Any:
        kind, text = self.t[self.at]
        self.at += 1
        if kind == "string":
            return _unescaped(text[1:-1])
        if kind == "number":
            return float(text) if "." in text or "e" in text.lower() else int(text)
        if kind == "param":
            if text[1:] not in self.params:
                raise QueryError(f"no parameter {text}")
            return self.params[text[1:]]
        if text.upper() in ("TRUE", "FALSE", "NULL"):
            return {"TRUE": True, "FALSE": False, "NULL": None}[text.upper()]
        if text == "-":
            return -self.value()
        raise QueryError(f"expected a value, found {text}")

    def edge(self) -> Edge:
        back = self.maybe("<-")
        if not back:
            self.take("-")
        name, types, hops = f"_r{next(self.fresh)}", [], None
        if self.maybe("["):
            if self.peek() not in (":", "*", "]"):
                name = self.name()
            if self.maybe(":"):
                types.append(self.name())
                while self.maybe("|"):
                    self.maybe(":")
                    types.append(self.name())
            if self.maybe("*"):
                low = int(self.take()) if self.peek().isdigit() else 1
                high = low if self.peek(-1).isdigit() else None
                if self.maybe(".."):
                    high = int(self.take()) if self.peek().isdigit() else None
                hops = (low, high)
            self.take("]")
        forth = self.maybe("->")
        if not forth:
            self.take("-")
        if back and forth:
            raise QueryError("an edge has one direction")
        return Edge(name, types, "in" if back else "out" if forth else "both", hops)

    def chain(self) -> list:
        out: list = [self.node()]
        while self.peek() in ("-", "<-"):
            out += [self.edge(), self.node()]
        return out

    def nodes_of(self, n: Node) -> DataFrame:
        labels = [x for x in n.labels if x not in FACETS]
        if len(labels) > 1:
            raise QueryError(f"no node is {' and '.join(labels)}")
        df = self.g.label(labels[0]).withColumn("label", F.lit(labels[0])) if labels else self.g.nodes()
        for facet in n.labels:
            if facet in FACETS:
                df = df.where(F.col(FACETS[facet]) if FACETS[facet] in df.columns else F.lit(False))
        for key, value in n.props.items():
            df = df.where(F.col(key) == F.lit(value)) if key in df.columns else df.where(F.lit(False))
        return df.select(*(F.col(c).alias(f"{n.name}__{c}") for c in df.columns))

    def walked(self, e: Edge, seeds: DataFrame, ends: DataFrame | None, closed: bool) -> DataFrame:
        """(origin, node, path) of the walks of an edge of several hops; no walk uses an edge twice.

        Where only the ends count, walks aren't listed: of one or more edges there is one between two nodes if a shortest
        one is short enough, and a node is on a closed one of one or two edges or more if it is on a simple cycle.
        """
        (low, high), types = e.hops, e.types or self.g.types
        bound = self.most_hops + 1 if high is None and self.most_hops is not None else high
        if e.lean and closed and 1 <= low <= 2 and e.direction != "both" and self.most_hops is None:
            found = self.on_cycle(types, low, high).join(seeds, "uid", "left_semi")
            return found.select(F.col("uid").alias("origin"), F.col("uid").alias("node"), F.array("uid").alias("path"))
        if e.lean and not closed and low <= 1 and (high is not None or self.most_hops is None):
            far = traverse.reach(self.g, seeds, types, high, e.direction).where("dist > 0").select("origin", "node")
            again = Edge(e.name, types, e.direction, (1, high), lean=True)
            near = self.walked(again, seeds, None, True).select("origin", "node")
            ends_ = far.unionByName(near.distinct())
            if low == 0:
                ends_ = ends_.unionByName(seeds.select(F.col("uid").alias("origin"), F.col("uid").alias("node"))).distinct()
            return ends_.withColumn("path", F.array("origin", "node"))
        if closed and bound is not None:
            out = walks.closed(self.g, types, low, bound, e.direction, seeds, e.enough)
        else:
            out = walks.walks(self.g, seeds, types, low, bound, e.direction, e.enough, ends)
            out = out.where("origin = node") if closed else out
        if bound != high and not out.where(F.col("hops") == bound).isEmpty():
            raise QueryError(f"walks of more than {self.most_hops} hops exist; name an upper bound or allow more")
        return out

    def on_cycle(self, types: list[str], low: int, high: int | None) -> DataFrame:
        """(uid): nodes on a closed walk of ``low`` (1 or 2) to ``high`` edges."""
        edges = self.g.rel(*types).select("src", "dst")
        loops = walks.numbered(self.g, types).where("src = dst").groupBy(F.col("src").alias("uid")).agg(F.count(F.lit(1)).alias("n"))
        found = loops.where(F.col("n") >= low).select("uid")
        if high is None:
            found = found.unionByName(cycles.components(edges).select("uid"))
        elif high > 1:
            found = found.unionByName(cycles.on_short(edges, high))
        return found.distinct()

    def steps(self, e: Edge, a: str, b: str, start: DataFrame | None, ends: DataFrame | None = None, closed: bool = False) -> DataFrame:
        """Edges as columns a__uid, b__uid, and those of the edge's variable."""
        if e.hops and e.every is None:
            seeds = self.g.nodes().select("uid") if start is None or f"{a}__uid" not in start.columns else start.select(F.col(f"{a}__uid").alias("uid")).distinct()
            out = self.walked(e, seeds, ends, closed)
            return out.select(F.col("origin").alias(f"{a}__uid"), F.col("node").alias(f"{b}__uid"), F.col("path").alias(f"{e.name}__path"))
        types = e.types or self.g.types
        all_ = [self.g.rel(t).withColumn("type", F.lit(t)) for t in types]
        df = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), all_)
        extra = [F.col(c).alias(f"{e.name}__{c}") for c in df.columns if c not in ("src", "dst")]
        one = df.select(F.col("src").alias(f"{a}__uid"), F.col("dst").alias(f"{b}__uid"), *extra)
        two = df.select(F.col("dst").alias(f"{a}__uid"), F.col("src").alias(f"{b}__uid"), *extra)
        return {"out": one, "in": two}[e.direction] if e.direction != "both" else one.unionByName(two)

    def join(self, left: DataFrame | None, right: DataFrame, how: str = "inner") -> DataFrame:
        if left is None:
            return right
        shared = [c for c in right.columns if c in left.columns and c.endswith("__uid")]
        if not shared:
            raise QueryError("patterns that share no variable would make every pair; join them by an edge")
        return left.join(right.drop(*(c for c in right.columns if c in left.columns and c not in shared)), shared, how)

    def matched(self, chain: list, start: DataFrame | None) -> DataFrame:
        """The rows of a chain, joined to ``start`` where they share variables."""
        df = start
        if len(chain) == 1:
            return self.join(df, self.nodes_of(chain[0])) if not self.bound(chain[0]) else df
        for k in range(1, len(chain), 2):
            a, e, b = chain[k - 1], chain[k], chain[k + 1]
            same = a.name == b.name
            other = f"_same{next(self.fresh)}" if same else b.name
            if e.hops and (a.labels or a.props) and (df is None or f"{a.name}__label" not in df.columns):
                df = self.join(df, self.nodes_of(a))  # paths are walked from these alone
            if e.every is not None:
                df = self.shortest(e, a, b, df)
                continue
            ends = self.nodes_of(b).select(F.col(f"{b.name}__uid").alias("uid")) if e.enough and (b.labels or b.props) else None
            step = self.steps(e, a.name, other, df, ends, same)
            if same:
                step = step.where(F.col(f"{a.name}__uid") == F.col(f"{other}__uid")).drop(f"{other}__uid")
            df = step if df is None else self.join(df, step)
            for n in (a, b):
                if (n.labels or n.props or not n.name.startswith("_n")) and f"{n.name}__label" not in df.columns:
                    df = self.join(df, self.nodes_of(n))
        return df

    def shortest(self, e: Edge, a: Node, b: Node, df: DataFrame | None) -> DataFrame:
        """Rows whose two nodes are joined, with one or all of the shortest paths between them; both nodes must be known.

        Parallel edges count as one. Of several shortest paths, one is the first by the uids along it.
        """
        low, high = e.hops or (1, 1)
        if low > 1:
            raise QueryError("a shortest path has a lower bound of 0 or 1")
        if b.labels or b.props or df is None or f"{b.name}__uid" not in df.columns:
            ends = self.nodes_of(b)
            if df is None or f"{b.name}__uid" in df.columns:
                df = self.join(df, ends)
            else:
                one = [x for x in (df, ends) if len(x.limit(2).collect()) < 2]
                if not one:
                    raise QueryError("match both ends of a shortest path first, or name one of them by its properties")
                df = df.join(F.broadcast(ends)) if one[0] is ends else ends.join(F.broadcast(df))  # a single row
        if f"{a.name}__uid" not in df.columns:
            raise QueryError("match both ends of a shortest path first, or name one of them by its properties")
        edges = self.g.rel(*(e.types or self.g.types)).select("src", "dst")
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        edges = {"out": edges, "in": back, "both": edges.unionByName(back)}[e.direction]
        pairs = df.select(F.col(f"{a.name}__uid").alias("start"), F.col(f"{b.name}__uid").alias("target"))
        found = shortest.shortest(edges, pairs, high, listed=True).where(F.col("hops") >= low)
        if not e.every:
            found = found.groupBy("start", "target").agg(F.min("path").alias("path"))
        return df.join(found.select(F.col("start").alias(f"{a.name}__uid"), F.col("target").alias(f"{b.name}__uid"), F.col("path").alias(f"{e.name}__path")), [f"{a.name}__uid", f"{b.name}__uid"])

    def bound(self, n: Node) -> bool:
        return self.s.df is not None and f"{n.name}__uid" in self.s.df.columns and not n.labels and not n.props

    # ---- clauses ----

    def run(self) -> DataFrame:
        done: list[tuple[DataFrame, bool]] = []
        while self.at < len(self.t):
            w = self.word()
            if self.maybe("OPTIONAL", "MATCH"):
                self.optional()
            elif self.maybe("MATCH"):
                self.match()
            elif self.maybe("UNWIND"):
                items = self.expr()
                self.take("AS")
                name = self.name()
                base = self.s.df if self.s.df is not None else self.g.spark.range(1).select()
                self.s.df = base.withColumn(name, F.explode(items))
            elif self.maybe("CALL"):
                self.procedure()
                if self.at == len(self.t) and not done:
                    return self.s.df
            elif self.maybe("WITH"):
                self.project(final=False)
                self.where()
            elif self.maybe("RETURN"):
                self.project(final=True)
                done.append((self.s.df, bool(done) and distinct))
            elif self.maybe("UNION"):
                distinct = not self.maybe("ALL")
                self.s = State()
            else:
                raise QueryError(f"unexpected {w or self.peek()}")
        if not done:
            raise QueryError("a query ends with RETURN")
        out = done[0][0]
        for df, once in done[1:]:
            out = out.unionByName(df).distinct() if once else out.unionByName(df)
        return out

    def match(self) -> None:
        """The patterns and the WHERE of a MATCH."""
        lean, had = self.lean(), set(self.s.paths)
        chains = self.pushed(self.chains())
        named = [id(e) for p in self.s.paths.keys() - had for e in self.s.paths[p][1::2]]
        for e in (e for chain in chains for e in chain[1::2] if e.hops):
            e.lean = lean and e.name.startswith("_r") and id(e) not in named
        if self.s.df is None and len(chains) == 1 and len(chains[0]) == 3 and chains[0][1].hops:
            chains[0][1].enough = self.limit()
        self.together(chains)
        self.where()

    def together(self, chains: list[list]) -> None:
        """Rows in which all chains hold: joined where they share variables, else by equalities of the WHERE that follows."""
        apart = [] if self.s.df is None else [self.s.df]
        for chain in chains:
            names = {f"{n.name}__uid" for n in chain[::2]}
            shared = [k for k, df in enumerate(apart) if names & set(df.columns)]
            self.s.df = apart[shared[0]] if shared else None
            df = self.matched(chain, self.s.df)
            for k in shared[1:]:
                df = self.join(df, apart[k])
            apart = [x for k, x in enumerate(apart) if k not in shared] + [df]
        parts = self.condition() if self.word() == "WHERE" else []
        while len(apart) > 1:
            apart = self.equal(apart, parts)
        self.s.df = apart[0]

    def equal(self, apart: list[DataFrame], parts: list[list[tuple[str, str]]]) -> list[DataFrame]:
        """Two of the tables joined by all equalities between them."""
        pairs: dict[tuple[int, int], list[tuple[str, str]]] = {}
        for part in parts:
            words = [x[1].strip("`") for x in part]
            if words[1:2] == ["."] and words[3:6:2] == ["=", "."] and len(words) == 7:
                left, right = f"{words[0]}__{words[2]}", f"{words[4]}__{words[6]}"
            elif words[1:2] == ["="] and len(words) == 3:
                left, right = f"{words[0]}__uid", f"{words[2]}__uid"
            else:
                continue
            x, y = ([k for k, df in enumerate(apart) if c in df.columns] for c in (left, right))
            if x and y and x != y:
                pairs.setdefault((min(x[0], y[0]), max(x[0], y[0])), []).append((left, right) if x[0] < y[0] else (right, left))
        if not pairs:
            raise QueryError("patterns that share no variable would make every pair; join them by an edge or an equality of their properties")
        (i, j), on = next(iter(pairs.items()))
        rest = [df for k, df in enumerate(apart) if k not in (i, j)]
        sides, times = [apart[i], apart[j]], [None, None]
        if not rest and self.plain():
            for k in (1, 0):  # one side: a pair that stands for very many takes longer than its rows
                columns = self.used(sides[k], [pair[k] for pair in on])
                if columns and not any(times):
                    times[k] = f"_times{next(self.fresh)}"
                    sides[k] = counted(sides[k].select(*columns), times[k])
        self.s.times = times[0] or times[1]
        return rest + [crossed(*sides, on, times=tuple(times)).drop(f"{self.s.times}_at")]

    def plain(self) -> bool:
        """Whether only a WHERE and a RETURN follow that makes one row of each row, in any order."""
        words = [x[1].upper() if x[0] == "name" else x[1] for x in self.ahead()]
        clauses = {w for k, w in enumerate(words) if w in CLAUSES and words[k - 1] != "." and not (w == "WITH" and words[k - 1] in ("STARTS", "ENDS"))}
        grouped = any(w.lower() in AGGREGATES and words[k + 1 : k + 2] == ["("] for k, w in enumerate(words))
        return clauses <= {"WHERE", "RETURN"} and not grouped and "DISTINCT" not in words and "*" not in words and "EXISTS" not in words

    def used(self, df: DataFrame, keys: list[str]) -> list[str]:
        """Of a table of one node the columns that ``keys`` and what follows ask for; none if it is named as a whole, or
        if they may differ in every row."""
        names = {c.split("__", 1)[0] for c in df.columns}
        words = [x[1].strip("`") if x[0] == "name" else x[1] for x in self.ahead()]
        at = [k for k, w in enumerate(words) if w in names and words[k - 1 : k] != ["."]]
        if len(names) > 1 or any(words[k + 1 : k + 2] != ["."] for k in at):
            return []
        asked = {*keys, *(f"{words[k]}__{words[k + 2]}" for k in at)}
        columns = [c for c in df.columns if c in asked]
        kinds = dict(df.dtypes)
        return [] if any(c.endswith("__uid") or "map<" in kinds[c] or "variant" in kinds[c] for c in columns) else columns

    def ahead(self) -> list[tuple[str, str]]:
        """The tokens up to the end of this query, or of the brackets around it."""
        depth, out = 0, []
        for kind, text in self.t[self.at :]:
            depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(text, 0)
            if depth < 0 or depth == 0 and kind == "name" and text.upper() == "UNION":
                break
            out.append((kind, text))
        return out

    def lean(self) -> bool:
        """Whether repeated rows make no difference: in a condition, or before RETURN DISTINCT without aggregates."""
        if self.within:
            return True
        words = [x[1].upper() if x[0] == "name" else x[1] for x in self.ahead()]
        last = max((k for k, w in enumerate(words) if w == "RETURN"), default=len(words))
        plain = not any(w == "UNWIND" or w == "WITH" and words[k - 1] not in ("STARTS", "ENDS") for k, w in enumerate(words))
        counted = any(w.lower() in AGGREGATES and words[k + 1 : k + 2] == ["("] for k, w in enumerate(words) if k > last)
        return plain and words[last + 1 : last + 2] == ["DISTINCT"] and not counted

    def limit(self) -> int | None:
        """How many rows of the patterns will do: where RETURN follows at once and only takes the first, in any order."""
        words = [x[1].upper() if x[0] == "name" else x[1] for x in self.ahead()]
        if words[:1] != ["RETURN"] or words[1:2] == ["DISTINCT"] or "ORDER" in words or "SKIP" in words or "LIMIT" not in words:
            return None
        at = words.index("LIMIT")
        if any(w.lower() in AGGREGATES and words[k + 1 : k + 2] == ["("] for k, w in enumerate(words)) or not words[at + 1 : at + 2] or not words[at + 1].isdigit():
            return None
        return int(words[at + 1])

    def procedure(self) -> None:
        """CALL name(arguments) [YIELD column [AS name], ...]: what the graph holds, as rows."""
        name = ""
        while self.peek() not in ("(", ""):
            name += self.take()
        self.take("(")
        args = []
        while not self.maybe(")"):
            args.append(self.value())
            self.maybe(",")
        df = _catalogue(self.g, name.lower(), args)
        if self.maybe("YIELD"):
            taken = []
            while True:
                column = self.name()
                if column not in df.columns:
                    raise QueryError(f"{name} gives {', '.join(df.columns)}, not {column}")
                taken.append(F.col(column).alias(self.name() if self.maybe("AS") else column))
                if not self.maybe(","):
                    break
            df = df.select(*taken)
        if self.s.df is not None:
            raise QueryError("CALL comes first in a query")
        self.s.df = df
        self.where()

    def chains(self) -> list[list]:
        out = []
        while True:
            path = every = None
            if self.peek(1) == "=":
                path = self.name()
                self.take("=")
            if self.word() in ("SHORTESTPATH", "ALLSHORTESTPATHS") and self.peek(1) == "(":
                every = self.name().lower().startswith("all")
                self.take("(")
            out.append(self.chain())
            if every is not None:
                self.take(")")
                if len(out[-1]) != 3:
                    raise QueryError("a shortest path has one edge")
                edge = out[-1][1]
                edge.every, edge.hops = every, edge.hops or (1, 1)
            if path:
                self.s.paths[path] = out[-1]
            if not self.maybe(","):
                return out

    def condition(self) -> list[list[tuple[str, str]]]:
        """The parts between the AND of the WHERE that stands here, as tokens; none if an OR stands beside them."""
        parts, depth, either = [[]], 0, False
        for k in range(self.at + 1, len(self.t)):
            kind, text = self.t[k]
            before = self.t[k - 1][1].upper()
            depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(text, 0)
            word = text.upper() if kind == "name" and depth == 0 and before != "." else ""
            if depth < 0 or word in CLAUSES and not (word == "WITH" and before in ("STARTS", "ENDS")):
                break
            either |= word == "OR"
            if word == "AND":
                parts.append([])
            else:
                parts[-1].append((kind, text))
        return [] if either else parts

    def pushed(self, chains: list[list]) -> list[list]:
        """The chains, with properties that the WHERE after them sets equal to a value put on their nodes.

        The WHERE still holds; walks of several hops then begin at the nodes it names instead of at all.
        """
        if self.word() != "WHERE":
            return chains
        for part in self.condition():
            if len(part) == 5 and [part[1][1], part[3][1]] == [".", "="] and part[0][0] == "name" and part[4][0] in ("string", "number", "param"):
                value = Compiler(self.g, part[4:], self.params).value()
                for node in (n for chain in chains for n in chain[::2] if n.name == part[0][1]):
                    node.props.setdefault(part[2][1].strip("`"), value)
        return chains

    def where(self) -> None:
        """A condition; patterns in it become anti and semi joins where they stand alone, else columns."""
        if self.word() != "WHERE":
            return
        parts = self.condition()
        self.take("WHERE")
        if not parts:
            self.keep(self.disjunction())
        for k in range(len(parts)):
            if k:
                self.take("AND")
            mark, negated = self.at, self.maybe("NOT")
            if self.begins_pattern():
                self.s.df = self.exists(self.s.df, "left_anti" if negated else "left_semi")
            else:
                self.at = mark
                self.keep(self.negation())

    def keep(self, condition: Column) -> None:
        df = self.s.df.where(condition)
        self.s.df = df.drop(*(c for c in df.columns if c.startswith("_found")))

    def is_pattern(self) -> bool:
        """Whether a bracket here opens a pattern: its match is followed by an edge."""
        if self.peek() != "(":
            return False
        depth, k = 0, 0
        while self.peek(k):
            depth += {"(": 1, ")": -1}.get(self.peek(k), 0)
            k += 1
            if depth == 0:
                return self.peek(k) == "<-" or self.peek(k) == "-" and self.peek(k + 1) in ("[", "-", "->")
        return False

    def begins_pattern(self) -> bool:
        return self.word() == "EXISTS" and self.peek(1) == "{" or self.is_pattern()

    def pattern_keys(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        """The distinct values of the query's variables for which the pattern here, or EXISTS { ... }, has a match."""
        keep, self.s, within, self.within = self.s, State(), self.within, True
        if self.maybe("EXISTS"):
            self.take("{")
            self.maybe("MATCH")
            self.match()
            self.take("}")
        else:
            chain = self.chain()
            for e in chain[1::2]:
                e.lean = True
            self.s.df = self.matched(chain, None)
        found, self.s, self.within = self.s.df, keep, within
        keys = [c for c in found.columns if c.endswith("__uid") and c in df.columns]
        if not keys:
            raise QueryError("a pattern condition needs a variable of the query")
        return found.select(keys).distinct(), keys

    def exists(self, df: DataFrame, how: str) -> DataFrame:
        found, keys = self.pattern_keys(df)
        return df.join(found, keys, how)

    def exists_column(self) -> Column:
        """Whether a pattern has a match, as a column of the current rows: for conditions under OR, and results."""
        found, keys = self.pattern_keys(self.s.df)
        name = f"_found{next(self.fresh)}"
        self.s.df = self.s.df.join(found.withColumn(name, F.lit(True)), keys, "left")
        return F.coalesce(F.col(name), F.lit(False))

    def optional(self) -> None:
        left, self.s.df = self.s.df, None
        chains = self.chains()
        known = [f"{n.name}__uid" for chain in chains for n in chain[::2] if left is not None and f"{n.name}__uid" in left.columns]
        if known and any(e.hops for chain in chains for e in chain[1::2]):
            self.s.df = left.select(*dict.fromkeys(known)).distinct()  # walks begin at the nodes that are known
        self.together(chains)
        self.where()
        found = self.s.df
        self.s.df = self.join(left, found, "left") if left is not None else found

    def project(self, final: bool) -> None:
        distinct = self.maybe("DISTINCT")
        items: list[tuple[str, Column, bool, str | None]] = []  # alias, column, aggregate, variable carried
        while True:
            begin = self.at
            variable = self.peek() if self.at < len(self.t) and self.t[self.at][0] == "name" and self.peek(1).upper() in (",", "", "WHERE", "ORDER", "LIMIT", "SKIP", "MATCH", "OPTIONAL", "RETURN", "WITH", "UNWIND", "AS") and self.s.df is not None and f"{self.peek()}__uid" in self.s.df.columns else None
            self.aggregate = False
            column = F.col(f"{self.take()}__uid") if variable else self.expr()
            text = "".join(x for _, x in self.t[begin : self.at])
            alias = self.name() if self.maybe("AS") else text
            items.append((alias, column, self.aggregate, variable))
            if not self.maybe(","):
                break
        df = self.s.df if self.s.df is not None else self.g.spark.range(1)
        carried = {alias: [c for c in df.columns if c.startswith(f"{v}__")] for alias, _, _, v in items if v and not final}
        keys: list[Column] = []
        for alias, column, aggregate, v in items:
            if alias in carried:
                keys += [F.col(c).alias(f"{alias}__{c.split('__', 1)[1]}") for c in carried[alias]]
            elif not aggregate:
                keys.append(column.alias(alias))
        made = [column.alias(alias) for alias, column, aggregate, _ in items if aggregate]
        orders = self.order(df, items, bool(made) or distinct)
        if made:
            df = df.groupBy(*keys).agg(*made) if keys else df.agg(*made)
        else:
            hidden = [c for c, _, _ in orders if c not in [i[0] for i in items]]
            df = df.select(*keys, *(o[2].alias(o[0]) for o in orders if o[0] in hidden), *([self.s.times] if self.s.times else []))
        if distinct:
            df = df.distinct()
        if orders:
            df = df.orderBy(*(F.col(f"`{c}`").desc_nulls_last() if down else F.col(f"`{c}`").asc_nulls_last() for c, down, _ in orders))
        if self.maybe("SKIP"):
            df = df.offset(int(self.value()))
        if self.maybe("LIMIT"):
            df = df.limit(int(self.value()))
        if final:
            df = df.select(*(F.col(f"`{i[0]}`") for i in items), *([self.s.times] if self.s.times else []))
        if self.s.times:
            df, self.s.times = repeated(df, self.s.times), None
        self.s.df = df

    def order(self, df: DataFrame, items: list, grouped: bool) -> list[tuple[str, bool, Column | None]]:
        out = []
        if self.maybe("ORDER", "BY"):
            names = {i[0] for i in items}
            while True:
                if self.peek() in names and self.peek(1).upper() in (",", "", "ASC", "DESC", "LIMIT", "SKIP", "WHERE", "MATCH", "OPTIONAL", "RETURN"):
                    name, column = self.take(), None
                elif grouped:
                    raise QueryError("after grouping, order by a name of the result")
                else:
                    name, column = f"_o{next(self.fresh)}", self.expr()
                down = self.maybe("DESC")
                if not down:
                    self.maybe("ASC")
                out.append((name, down, column))
                if not self.maybe(","):
                    break
        return out

    # ---- expressions ----

    def expr(self) -> Column:
        return self.disjunction()

    def disjunction(self) -> Column:
        out = self.conjunction()
        while self.maybe("OR"):
            out = out | self.conjunction()
        return out

    def conjunction(self) -> Column:
        out = self.negation()
        while self.maybe("AND"):
            out = out & self.negation()
        return out

    def negation(self) -> Column:
        if self.maybe("NOT"):
            return ~self.negation()
        return self.comparison()

    def comparison(self) -> Column:
        left = self.sum()
        if self.peek() == ":":
            raise QueryError("a label condition follows a variable")
        op = self.peek().upper()
        if op in ("=", "<>", "<", "<=", ">", ">="):
            self.at += 1
            right = self.sum()
            return {"=": left == right, "<>": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
        if op == "=~":
            self.at += 1
            return F.regexp_like(left, F.concat(F.lit("^(?:"), self.sum(), F.lit(")$")))
        if op == "IN":
            self.at += 1
            return F.array_contains(self.sum(), left)
        if op == "CONTAINS":
            self.at += 1
            return F.contains(left, self.sum())
        if self.maybe("STARTS", "WITH"):
            return F.startswith(left, self.sum())
        if self.maybe("ENDS", "WITH"):
            return F.endswith(left, self.sum())
        if self.maybe("IS", "NULL"):
            return left.isNull()
        if self.maybe("IS", "NOT", "NULL"):
            return left.isNotNull()
        return left

    def sum(self) -> Column:
        """Sums; of a text and anything, the joined text; of two lists, one behind the other."""
        text, out = self.is_text(), self.product()
        while self.peek() in ("+", "-"):
            plus = self.take() == "+"
            text |= plus and self.is_text()
            right = self.product()
            kinds = [self.kind(out), self.kind(right)] if plus and not text else []
            if text and plus or "string" in kinds:
                text, out = True, F.concat(out.cast("string"), right.cast("string"))
            elif kinds == ["array", "array"]:
                out = F.concat(out, right)
            else:
                out = out + right if plus else out - right
        return out

    def is_text(self) -> bool:
        return self.at < len(self.t) and self.t[self.at][0] == "string"

    def kind(self, column: Column) -> str | None:
        """The type of a column of the current rows; none inside a comprehension, whose variable has no rows."""
        base = self.s.df if self.s.df is not None else self.g.spark.range(1)
        try:
            return base.select(column).schema.fields[0].dataType.typeName()
        except AnalysisException:
            return None

    def product(self) -> Column:
        out = self.unary()
        while self.peek() in ("*", "/", "%"):
            op = self.take()
            right = self.unary()
            out = out * right if op == "*" else out / right if op == "/" else out % right
        return out

    def unary(self) -> Column:
        if self.maybe("-"):
            return -self.unary()
        out = self.atom()
        while self.peek() == "[":
            self.at += 1
            out = F.get(out, self.expr())
            self.take("]")
        return out

    def atom(self) -> Column:
        kind, text = self.t[self.at] if self.at < len(self.t) else ("", "")
        if kind in ("string", "number", "param") or text.upper() in ("TRUE", "FALSE", "NULL"):
            v = self.value()
            return F.array(*(F.lit(x) for x in v)) if isinstance(v, list | tuple) else F.lit(v)
        if self.begins_pattern():
            return self.exists_column()
        if self.maybe("{"):
            items = []
            while not self.maybe("}"):
                key = self.name()
                self.take(":")
                items.append(self.expr().alias(key))
                self.maybe(",")
            return F.struct(*items)
        if self.maybe("("):
            out = self.expr()
            self.take(")")
            return out
        if self.maybe("["):
            if self.t[self.at][0] == "name" and self.peek(1).upper() == "IN":
                return self.comprehension()
            items = []
            while not self.maybe("]"):
                items.append(self.expr())
                self.maybe(",")
            return F.array(*items)
        if text.upper() == "CASE":
            return self.case()
        if kind != "name":
            raise QueryError(f"unexpected {text or 'end'}")
        name = self.name()
        if self.peek() == "(":
            return self.call(name.lower())
        if self.maybe("."):
            return self.property(name, self.name())
        if self.peek() == ":" and self.is_node(name):
            self.at += 1
            return self.has_label(name, self.name())
        if self.is_node(name):
            return F.col(f"{name}__uid")
        return F.col(f"`{name}`")

    def is_node(self, name: str) -> bool:
        return self.s.df is not None and f"{name}__uid" in self.s.df.columns

    def property(self, name: str, key: str) -> Column:
        column = f"{name}__{key}"
        columns = self.s.df.columns if self.s.df is not None else []
        if column in columns:
            return F.col(column)
        if name in columns:
            return F.col(f"`{name}`").getField(key)
        if not any(c.startswith(f"{name}__") for c in columns):
            raise QueryError(f"no variable {name}")
        return F.lit(None)

    def has_label(self, name: str, label: str) -> Column:
        if label in FACETS:  # one that was never set isn't that facet
            return F.coalesce(self.property(name, FACETS[label]).cast("boolean"), F.lit(False))
        return F.col(f"{name}__label") == label

    def path_nodes(self, name: str) -> Column:
        """The uids along a named path, or along the variable of an edge of several hops."""
        if name not in self.s.paths:
            if f"{name}__path" not in self.s.df.columns:
                raise QueryError(f"no path {name}")
            return F.col(f"{name}__path")
        chain = self.s.paths[name]
        parts = [F.array(F.col(f"{chain[0].name}__uid"))]
        for e, n in zip(chain[1::2], chain[2::2], strict=True):
            walked = F.col(f"{e.name}__path") if e.hops else None
            parts.append(F.slice(walked, F.lit(2), F.size(walked)) if e.hops else F.array(F.col(f"{n.name}__uid")))
        return F.concat(*parts)

    def comprehension(self) -> Column:
        name = self.name()
        self.take("IN")
        nodes = self.peek(2) if self.word() == "NODES" and self.peek(1) == "(" and self.peek(3) == ")" else None
        if nodes:
            self.at += 4
        source = self.along(nodes, self.properties(name)) if nodes else self.unary()
        mark = self.at

        def inner(x: Column, condition: bool) -> Column:
            self.at = mark
            columns = self.col_as(name, x, bool(nodes))
            out = None
            if self.maybe("WHERE"):
                out = columns(self.expr)
            if not condition:
                out = columns(self.expr) if self.maybe("|") else x.getField("uid") if nodes else x
            return out

        has = self.peek().upper() == "WHERE"
        if has:
            source = F.filter(source, lambda x: inner(x, True))
        out = F.transform(source, lambda x: inner(x, False))
        self.take("]")
        return out

    def properties(self, name: str) -> list[str]:
        """Properties of a comprehension's variable that are named up to the bracket that ends it."""
        depth, out = 0, {}
        for k in range(self.at, len(self.t)):
            depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(self.t[k][1], 0)
            if depth < 0:
                break
            if self.t[k][1] == name and [x[1] for x in self.t[k + 1 : k + 2]] == ["."]:
                out[self.t[k + 2][1].strip("`")] = True
        return [x for x in out if x != "uid"]

    def along(self, path: str, keys: list[str]) -> Column:
        """The nodes of a path as an array of (uid, properties): distinct paths meet the nodes, then the rows."""
        uids, column = f"_uids{next(self.fresh)}", f"_nodes{next(self.fresh)}"
        self.s.df = self.s.df.withColumn(uids, self.path_nodes(path))
        if not keys:
            return F.transform(uids, lambda u: F.struct(u.alias("uid")))
        nodes = self.g.nodes()
        held = nodes.select(F.col("uid").alias("_uid"), *(F.col(k) if k in nodes.columns else F.lit(None).cast("string").alias(k) for k in keys))
        each = self.s.df.select(uids).distinct().select(uids, F.posexplode(uids).alias("_k", "_uid")).join(held, "_uid", "left")
        row = F.struct(F.col("_uid").alias("uid"), *keys)
        per = each.groupBy(uids).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", row.alias("row")))), lambda r: r["row"]).alias(column))
        self.s.df = self.s.df.join(per, uids, "left")
        return F.col(column)

    def col_as(self, name: str, x: Column, node: bool = False):
        def within(parse):
            keep = self.atom

            def atom() -> Column:
                if self.peek() == name and self.peek(1) != "(":
                    self.at += 1
                    return x.getField(self.name()) if self.maybe(".") else x.getField("uid") if node else x
                return keep()

            self.atom = atom
            try:
                return parse()
            finally:
                self.atom = keep

        return within

    def case(self) -> Column:
        self.take("CASE")
        subject = None if self.word() == "WHEN" else self.expr()
        out = None
        while self.maybe("WHEN"):
            condition = self.expr()
            condition = condition if subject is None else subject == condition
            self.take("THEN")
            value = self.expr()
            out = F.when(condition, value) if out is None else out.when(condition, value)
        if self.maybe("ELSE"):
            out = out.otherwise(self.expr())
        self.take("END")
        return out

    def call(self, name: str) -> Column:
        self.take("(")
        if name == "count" and self.maybe("*"):
            self.take(")")
            self.aggregate = True
            return F.count(F.lit(1))
        distinct = self.maybe("DISTINCT")
        args: list[Column] = []
        first = self.peek()
        if name in ("nodes", "rels", "relationships", "length", "type") and self.peek(1) == ")":
            self.at += 1  # a path or an edge, not a value
        while not self.maybe(")"):
            args.append(self.expr())
            self.maybe(",")
        if name in AGGREGATES:
            self.aggregate = True
            x = args[0]
            return {"count": F.count_distinct(x) if distinct else F.count(x), "collect": F.array_sort(F.collect_set(x)) if distinct else F.collect_list(x), "max": F.max(x), "min": F.min(x), "sum": F.sum(x), "avg": F.avg(x)}[name]
        simple = {"coalesce": F.coalesce, "size": F.size, "lower": F.lower, "tolower": F.lower, "upper": F.upper, "toupper": F.upper, "abs": F.abs}
        if name in simple:
            return simple[name](*args)
        if name == "round":
            return F.round(args[0].cast("double"), int(self.t[self.at - 2][1]) if len(args) > 1 else 0)
        if name in ("elementid", "id"):
            return F.col(f"{first}__seq" if name == "id" and f"{first}__seq" in self.s.df.columns else f"{first}__uid")
        if name == "timestamp":
            return F.lit(self.now)  # one time a query
        if name == "labels":
            return F.array(F.col(f"{first}__label"))
        if name == "type":
            return F.col(f"{first}__type")
        if name in ("nodes", "rels", "relationships", "length"):
            nodes = self.path_nodes(first)
            hops = F.size(nodes) - 1
            if name == "length":
                return hops.cast("long")
            return nodes if name == "nodes" else F.zip_with(F.slice(nodes, 1, hops), F.slice(nodes, 2, hops), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))
        raise QueryError(f"no function {name}")


def _catalogue(g: Graph, name: str, args: list) -> DataFrame:
    """The result of a procedure that tells what a graph holds."""
    spark = g.spark
    if name == "db.labels":
        return spark.createDataFrame([(x,) for x in g.labels], "label string")
    if name == "db.relationshiptypes":
        return spark.createDataFrame([(x,) for x in g.types], "relationshipType string")
    if name == "db.propertykeys":
        keys = {c for x in g.labels for c in g.label(x).columns} | {c for t in g.types for c in g.rel(t).columns} - {"src", "dst"}
        return spark.createDataFrame([(x,) for x in sorted(keys)], "propertyKey string")
    if name == "show_tables":
        return spark.createDataFrame([(x, "NODE") for x in g.labels] + [(x, "REL") for x in g.types], "name string, type string")
    if name == "table_info":
        if len(args) != 1 or args[0] not in [*g.labels, *g.types]:
            raise QueryError("table_info takes the name of a label or relationship type of the graph")
        held = g.label(args[0]) if args[0] in g.labels else g.rel(args[0])
        return spark.createDataFrame([(k, f.name, f.dataType.simpleString()) for k, f in enumerate(held.schema.fields)], "`property id` int, name string, type string")
    if name == "show_connection":
        if len(args) != 1 or args[0] not in g.types:
            raise QueryError("show_connection takes the name of a relationship type of the graph")
        return spark.createDataFrame([("node", "node", "uid", "uid")], "`source table name` string, `destination table name` string, `source table primary key` string, `destination table primary key` string")
    if name == "show_functions":
        return spark.createDataFrame([(x,) for x in sorted(AGGREGATES | FUNCTIONS)], "name string")
    if name == "current_setting":
        if len(args) != 1:
            raise QueryError("current_setting takes the name of a setting")
        return spark.createDataFrame([(spark.conf.get(str(args[0]), None),)], "value string")
    raise QueryError(f"no procedure {name}")


def _unescaped(text: str) -> str:
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|(.))", lambda m: chr(int(m[1], 16)) if m[1] else ESCAPES.get(m[2], m[2]), text, flags=re.DOTALL)


def run(g: Graph, text: str, params: dict[str, Any] | None = None, most_hops: int | None = None) -> DataFrame:
    """The result of a reading query over ``g``; nothing of its text reaches SQL.

    Walks of several hops may meet a node again but use no edge twice. A pattern that names no upper bound (``*``, ``*2..``)
    is walked until no edge is left; with ``most_hops``, a longer walk raises an error instead. Edges of a path, as ``rels``
    gives them, are (src, dst) in the order walked. EXPLAIN and PROFILE give one row, the plan.
    """
    found = check_read_only(text)
    explained = found[0][1].upper() in ("EXPLAIN", "PROFILE")
    out = Compiler(g, found[explained:], params or {}, most_hops).run()
    if explained:  # Spark has no profile before a run: both give the plan
        return g.spark.createDataFrame([(out._jdf.queryExecution().toString(),)], "plan string")
    return out
