"""Levels of detail: which labels and relationship types a view of the graph loads, and how much of it there is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.graph import FACETS, Graph
from lattica.scratch import written

# Labels by the level at which they first appear, and types that need a level of their own.
SPEC = "SpecClassDiagram SpecClass SpecMethod SpecField SpecRelation SpecSequence SpecParticipant SpecMessage SpecUseCaseDiagram SpecUseCase SpecActor SpecAssoc SpecActivityDiagram SpecProcess SpecAction".split()
WORKFLOW = "Flow Phase Requirement AcceptanceCriterion TestCase SourceAnalysis ArchitectureDecision".split()
LEVELS = {
    1: "Function Component Class State Module Endpoint File Task Epic Knowledge Annotation Effect DOMElement Topic Service Action BraindumpSession".split() + WORKFLOW + ["Change", "Idea", *SPEC],
    2: "Variable ReturnValue ControlFlow ReturnStatement ContinueStatement BreakStatement ThrowStatement".split(),
    3: ["ASTNode"],
}
LATE_TYPES = {"CONTAINS_AST": 3}


def labels(level: int) -> list[str]:
    """Labels up to a level, 1 to 3."""
    if level not in LEVELS:
        raise ValueError(f"levels are {', '.join(map(str, LEVELS))}")
    return [x for at in range(1, level + 1) for x in LEVELS[at]]


def at_level(g: Graph, level: int, hidden: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """The graph's labels and types that a view of this level loads, without ``hidden`` ones."""
    some = [x for x in labels(level) if x in g.labels and x not in FACETS and x not in hidden]
    return some, [t for t in g.types if LATE_TYPES.get(t, 1) <= level and t not in hidden]


def report(g: Graph, level: int, hidden: tuple[str, ...] = ()) -> DataFrame:
    """(label, n, connected, near): nodes of each label at a level, how many have an edge to another node of the level, and
    the labels that edges join it with, by commas."""
    some, types = at_level(g, level, hidden)
    nodes = g.nodes(some).select("uid", "label")
    at = [nodes.select(F.col("uid").alias(end), F.col("label").alias(name)) for end, name in (("src", "a"), ("dst", "b"))]
    inside = g.edges(types).where("src <> dst").select("src", "dst").join(at[0], "src").join(at[1], "dst")
    both = F.array(F.struct(F.col("src").alias("uid"), F.col("a").alias("own"), F.col("b").alias("other")), F.struct(F.col("dst").alias("uid"), F.col("b").alias("own"), F.col("a").alias("other")))
    # edges meet the labels once: both sums are of nodes and the labels next to them
    ends = written(inside.select(F.inline(both)).distinct())
    per = nodes.join(ends.select("uid", F.lit(True).alias("on")).distinct(), "uid", "left").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count("on").alias("connected"))
    near = ends.where("own <> other").groupBy(F.col("own").alias("label")).agg(F.array_join(F.array_sort(F.collect_set("other")), ",").alias("near"))
    return per.join(near, "label", "left").select("label", "n", "connected", F.coalesce("near", F.lit("")).alias("near"))
