import random

import pytest
from quire.operators import hierarchy

SCHEMA = "id string, parent string, grp string, children array<string>, level int, ord long, depth string, state string"


def truth(rows):
    last = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: r[5]):
        last[r[0]] = r
    up = {k: (r[1] if r[1] is not None and r[1].strip() else None) for k, r in last.items()}
    out, depths = set(), {}
    for k in up:
        seen, at, n = [], k, 0
        while at in up and up[at] is not None and at not in seen:
            seen.append(at)
            at, n = up[at], n + 1
        if at in seen:
            out.add((k, "cycle" if at == k else "below_cycle"))
        elif at not in up:
            pass
        else:
            depths[k] = n
            if last[k][4] != n:
                out.add((k, "level"))
        if up[k] is not None and up[k] not in up:
            out.add((k, "orphan"))
        said = {c for c in last[k][3] or [] if c is not None and c.strip()}
        if said != {c for c, p in up.items() if p == k}:
            out.add((k, "children"))
    return out, depths, up


def forest(seed, n=120, across=False):
    rnd = random.Random(seed)
    rows = []
    ids = [f"n{i}" for i in range(n)]
    grp = {i: f"g{rnd.randrange(4)}" for i in ids}
    for i, k in enumerate(ids):
        pool = [p for p in ids[max(0, i - 6) : i] if across or grp[p] == grp[k]]
        kind = rnd.random()
        parent = rnd.choice(pool) if pool and kind < 0.8 else rnd.choice([None, "", "  ", "nowhere", k])
        if kind > 0.97:
            later = [p for p in ids if across or grp[p] == grp[k]]
            parent = rnd.choice(later)
        rows.append([k, parent, grp[k], None, rnd.choice([0, 1, 2, 3, None]), 1, "x", "y"])
    for r in rows:
        r[3] = rnd.choice([None, [], [c[0] for c in rows if c[1] == r[0]] * 2, [rnd.choice(ids), None, ""]])
    rows += [list(r) for r in rows[:10]] + [[None, "n1", "g1", None, 1, 1, "x", "y"]]
    return [tuple(r) for r in rows]


ARGS = {"id": "id", "parent": "parent", "children": "children", "level": "level", "order": "ord"}


@pytest.mark.parametrize("seed,group,block,across", [(1, "grp", 10_000, False), (2, "grp", 40, False), (3, None, 20, True), (4, "grp", 10_000, True), (5, None, 10_000, False)])
def test_faults_and_shapes(spark, seed, group, block, across):
    rows = forest(seed, across=across)
    df = spark.createDataFrame(rows, SCHEMA)
    want, depths, up = truth(rows)
    got = hierarchy.faults(df, **ARGS, group=group, block_rows=block).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    n = {r["id"]: r for r in hierarchy.nodes(df, **ARGS, group=group, block_rows=block).collect()}
    assert set(n) == set(up)
    assert {k: r["depth"] for k, r in n.items() if r["state"] == "tree"} == depths
    p = {r["id"]: r["path"] for r in hierarchy.paths(df, "id", "parent", group=group, order="ord", block_rows=block).collect()}
    for k, path in p.items():
        assert path[-1] == k and all(up[b] == a for a, b in zip(path, path[1:]))
    assert {k for k in depths} <= set(p)
    d = {(r["ancestor"], r["descendant"], r["distance"]) for r in hierarchy.descendants(df, "id", "parent", group=group, order="ord", block_rows=block).collect()}
    assert d >= {(a, path[-1], len(path) - 1 - i) for path in p.values() for i, a in enumerate(path[:-1])}
    sizes = {k: sum(1 for a, _, _ in d if a == k) for k in p}
    assert all(n[k]["subtree_size"] - 1 == sizes[k] for k in p)


def test_deep_chain_and_empty(spark):
    chain = [(f"c{i}", f"c{i - 1}" if i else None, "g", None, i, 1, "", "") for i in range(3000)]
    df = spark.createDataFrame(chain, SCHEMA)
    assert hierarchy.faults(df, "id", "parent", group="grp", level="level").count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert hierarchy.faults(empty, **ARGS, group="grp").count() == 0
    assert hierarchy.faults(empty, **ARGS).count() == 0
    assert hierarchy.descendants(empty, "id", "parent", group="grp").count() == 0


def test_chain_of_ten_thousand_beyond_a_block(spark):
    """One tree that no block holds, as high as it is large."""
    n = 10_000
    chain = [(f"c{i}", f"c{i - 1}" if i else None, "g", [f"c{i + 1}"] if i < n - 1 else [], i if i != 7777 else 3, 1, "", "") for i in range(n)]
    df = spark.createDataFrame(chain, SCHEMA)
    nodes = {r["id"]: r for r in hierarchy.nodes(df, "id", "parent", group="grp", children="children", level="level", block_rows=4000).collect()}
    assert len(nodes) == n and all(nodes[f"c{i}"]["depth"] == i and nodes[f"c{i}"]["subtree_size"] == n - i and nodes[f"c{i}"]["peel_no"] == n - 1 - i and nodes[f"c{i}"]["root"] == "c0" for i in range(n))
    assert [k for k, r in nodes.items() if r["level"] != r["depth"]] == ["c7777"] and all(r["children_match"] for r in nodes.values())


def test_cycle_and_tail_beyond_a_block(spark):
    ring = [(f"r{i}", f"r{(i + 1) % 70}", "g", None, 0, 1, "", "") for i in range(70)] + [(f"t{i}", f"t{i - 1}" if i else "r5", "g", None, 0, 1, "", "") for i in range(60)]
    df = spark.createDataFrame(ring, SCHEMA)
    nodes = {r["id"]: r for r in hierarchy.nodes(df, "id", "parent", group="grp", block_rows=40).collect()}
    assert len(nodes) == 130 and {k[0]: r["state"] for k, r in nodes.items()} == {"r": "cycle", "t": "below_cycle"}
    assert all(nodes[f"t{i}"]["subtree_size"] == 60 - i and nodes[f"t{i}"]["depth"] is None for i in range(60))
    far = hierarchy.descendants(df, "id", "parent", group="grp", block_rows=40)
    assert far.count() == 60 * 59 // 2 and far.filter("ancestor like 'r%'").count() == 0


def test_hot_group_of_many_trees(spark):
    """A group far above the block size, of trees below it, is placed by tree: no row goes through distributed rounds."""
    rnd = random.Random(8)
    rows = []
    for t in range(60):
        rows += [(f"{t}.{i}", f"{t}.{rnd.randrange(i)}" if i else None, "hot", None, 1, 1, "", "") for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    _, giant = hierarchy._split(hierarchy._normalised(df, "id", "parent", "grp", None, None, None), "grp", 400)
    assert giant is None
    want, depths, _ = truth(rows)
    n = {r["id"]: r["depth"] for r in hierarchy.nodes(df, "id", "parent", group="grp", block_rows=400).collect()}
    assert n == depths
    assert {tuple(r) for r in hierarchy.faults(df, "id", "parent", group="grp", level="level", block_rows=400).collect()} == {x for x in want if x[1] == "level"}
