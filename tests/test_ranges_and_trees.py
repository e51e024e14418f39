"""Line ranges, budgets and element trees against brute force."""

import random
import re

import pytest

from lattica.operators import budget, intervals
from lattica.sources import dom


@pytest.mark.parametrize("seed", range(1))
def test_ranges_that_overlap(spark, seed):
    rng = random.Random(seed)
    pick = lambda n, width: [("hot" if rng.random() < 0.4 else rng.choice("abc"), s := rng.randrange(1, 300), s + rng.choice([0, 0, 1, 5, rng.randrange(width)]), f"u{k}") for k in range(n)]
    left, right = pick(150, 300), pick(80, 250)
    left += [("hot", 5, 4, "empty"), (None, 1, 9, "no key"), ("a", None, 3, "no start"), ("a", 1, 1 << 40, "long"), ("b", -7, 2, "below")]
    schema = "file string, start long, end long, uid string"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    met = lambda x, y: x[0] is not None and x[0] == y[0] and x[1] is not None and x[1] <= x[2] and y[1] <= y[2] and x[1] <= y[2] and y[1] <= x[2]
    got = intervals.overlapping(a, b, "file").collect()
    assert sorted((r.uid, r.other_uid) for r in got) == sorted((x[3], y[3]) for x in left for y in right if met(x, y))
    lines = [("hot", n) for n in range(0, 320, 7)] * 2 + [("a", 50), ("none", 5), (None, 3)]
    want = []
    for f, n in lines:
        held = [(e - s, -s, u) for g, s, e, u in right if g == f and s <= n <= e]
        want.append((f, n, min(held)[2] if held else None))
    points = intervals.innermost(spark.createDataFrame(lines, "file string, line long"), b, "file")
    assert sorted((r.file, r.line, r.inner) for r in points.collect() if r.file) == sorted(w for w in want if w[0]) and points.count() == len(lines)
    parents = {}
    for f, s, e, u in right:
        over = [(e2 - s2, -s2, u2) for g, s2, e2, u2 in right if g == f and s2 <= s and e2 >= e and e2 - s2 > e - s]
        parents[u] = min(over)[2] if over else None
    assert {r.uid: r.parent for r in intervals.nested(b, "file").collect()} == parents


def test_touched_functions_and_empty_tables(spark):
    edits = spark.createDataFrame([("t1", "f", 1, 4, 10), ("t1", "f", 1, 4, 12), ("t1", "f", 6, 6, 11), ("t2", "g", 1, 1, 5)], "task string, file string, start long, end long, at long")
    spans = spark.createDataFrame([("outer", "f", 1, 9), ("inner", "f", 3, 6), ("other", "h", 1, 9)], "uid string, file string, start long, end long")
    got = {(r.task, r.uid): (r["at"], r.firstAt, r.edits, r.lines) for r in intervals.touches(edits, spans).collect()}
    assert got == {("t1", "outer"): (12, 10, 3, 9), ("t1", "inner"): (12, 10, 3, 5)}
    none = spans.where("false")
    assert intervals.touches(edits, none).count() == intervals.touches(edits.where("false"), spans).count() == 0
    assert intervals.nested(none, "file").count() == 0


def grown(nodes, edges, size, isolated):
    """The walk as its rules say, one node at a time over the whole graph."""
    near = {u: [] for u in nodes}
    for a, b in edges:
        if a != b and a in nodes and b in nodes:
            near[a].append(b)
            near[b].append(a)
    degree = {u: len(x) for u, x in near.items()}
    if len(nodes) <= size:
        return sorted(nodes)
    by_hub = lambda x: (-degree[x], x)
    share = {label: size * sum(x == label for x in nodes.values()) / len(nodes) for label in nodes.values()}
    hubs, kept, queued, queues, taken = sorted((u for u in nodes if degree[u]), key=by_hub), [], set(), {}, {}
    while len(kept) < size:
        heads = [label for label in queues if queues[label]]
        if not heads:
            left = [u for u in hubs if u not in kept]
            if not left:
                break
            heads, _ = [nodes[left[0]]], queues.setdefault(nodes[left[0]], []).append(left[0])
            queued.add(left[0])
        best = max(share[x] - taken.get(x, 0) for x in heads)
        label = next(x for x in queues if x in heads and share[x] - taken.get(x, 0) == best)
        u = queues[label].pop(0)
        kept.append(u)
        taken[label] = taken.get(label, 0) + 1
        for v in sorted(near[u], key=by_hub):
            if v not in queued:
                queued.add(v)
                queues.setdefault(nodes[v], []).append(v)
    if isolated:
        alone = sorted(u for u in nodes if not degree[u])[: max(1, size // 4)]
        kept = kept[: size - len(alone)] + alone
    return kept


@pytest.mark.parametrize("seed", range(2))
def test_budget(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(budget, "FETCH", rng.choice([1, 3, 64]))
    nodes = {f"n{k:02d}": rng.choice("AABC") for k in range(60)}
    names = list(nodes)
    edges = [(rng.choice(names[:45]), rng.choice(names[: rng.choice([3, 45])])) for _ in range(70)] + [("n01", "elsewhere")]
    edges += edges[:5]
    df, e = spark.createDataFrame(list(nodes.items()), "uid string, label string"), spark.createDataFrame(edges, "src string, dst string")
    for size in (1, 25, 59, 60):
        for isolated in (False, True):
            got = budget.connected(df, e, size, isolated).orderBy("place").collect()
            assert [r.uid for r in got] == grown(nodes, edges, size, isolated), (size, isolated)
            assert len(got) <= size and all(nodes[r.uid] == r.label for r in got)
            kept = {r.uid for r in got}
            if size == 25:
                assert budget.between(df.where(df.uid.isin(list(kept))), e).count() == sum(a in kept and b in kept for a, b in edges)
    with pytest.raises(ValueError, match="budget"):
        budget.connected(df, e, 0)


def stacked(html):
    """(tag, depth, parent, xpath) by a stack: an end tag with a partner takes the top away."""
    text = re.sub(r"(?s)<!--.*?-->", "", html or "")
    for name in dom.RAW:
        text = re.sub(dom.raw_pattern(name), r"\1\2", text)
    found, partner, waiting = [], {}, {}
    for k, raw in enumerate(re.findall(dom.TAG, text)):
        tag = re.match(dom.NAME, raw)[1].lower()
        if raw.startswith("</"):
            found.append((tag, "close"))
            if tag not in dom.VOID and waiting.get(tag):
                partner[k] = waiting[tag].pop()
                partner[partner[k]] = k
        else:
            leaf = tag in dom.VOID or raw.endswith("/>")
            found.append((tag, "leaf" if leaf else "open"))
            if not leaf:
                waiting.setdefault(tag, []).append(k)
    out, stack, seen = [], [], {}
    for k, (tag, kind) in enumerate(found):
        if kind == "close":
            if k in partner:
                stack.pop()
            continue
        parent = stack[-1] if stack else None
        seen[parent, tag] = seen.get((parent, tag), 0) + 1
        above = out[parent][3] if parent is not None else ""
        out.append((tag, len(stack), parent, f"{above}/{tag}[{seen[parent, tag]}]"))
        if kind == "open" and k in partner:
            stack.append(len(out) - 1)
    return out


def test_element_trees(spark):
    rng = random.Random(4)
    bits = ["<div>", "</div>", "<p class='a'>", "</p>", "<b>", "</b>", "<br>", "<img src=x/>", "</br>", "text", "<!-- <div> -->", '<script>var t="</p><div>";</script>', "<title><b></title>", "<UL>", "</ul >", "<li/>", "< div>", "<script>", "\n"]
    pages = [None, "", "no tags", "<p>", "</p>", "<a><b></a></b>", "<p><b>x<br><p>y</p>", "<div>" * 40 + "</div>" * 40]
    pages += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    df = spark.createDataFrame([(k, f"u{k}", h, "clash") for k, h in enumerate(pages)], "page_id long, url string, html string, tag string")
    got = {}
    for r in dom.tree(df).orderBy("page_id", "n").collect():
        assert r.n == len(got.setdefault(r.page_id, []))
        got[r.page_id].append((r.tagName, r.depth, r.parent, r.xpath))
    assert got == {k: rows for k, h in enumerate(pages) if (rows := stacked(h))}
