"""Parent-child rows to full hierarchies by bottom-up leaf peeling.

Leaves are peeled first; a peeled node sends its subtree size (and, as a slice of the preorder, its descendant list) to its
parent, which is peeled once all its children are. What no round can peel lies on a cycle. Going through the peel order in
reverse, every parent is known before its children, so depth, root and path are assigned top-down.

Where it runs: rows are placed by ``group`` (a locality hint such as a document id), and every partition peels all its groups at
once with vectorised rounds. Rows of groups of more than ``block_rows`` rows, and all rows when links turn out to cross groups, are
placed by their tree instead, which pointer doubling finds in as many joins as the height has binary digits. Only a single tree of
more than ``block_rows`` rows is peeled in distributed rounds (one aggregation and one join a round, checkpointed) until what is left
fits one block, or rounds take off only few (a rest of long chains), the sizes of which double likewise; depths, roots and paths come
from pointer doubling again, so no round reads what earlier ones took off, and rounds are logarithmic in size and height.

Defined results: rows with a null id are ignored; of rows with the same id the one with the greatest ``order`` counts (any, if
equal or not given); a null or blank parent makes a root; a parent that is no id makes an orphan, whose subtree is kept with the
orphan as root and state ``orphan``; repeated, null and blank children count once or not at all; an empty table gives an empty
table. Extra columns are ignored, so their names cannot clash.
With ``group`` given, rows of one id must share their group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut, shuffle_partitions, written

TREE, ORPHAN, CYCLE, BELOW = "tree", "orphan", "cycle", "below_cycle"
_STATES = np.array([TREE, ORPHAN, CYCLE, BELOW], dtype=object)
NODE_SCHEMA = (
    "id string, parent string, state string, depth int, root string, peel_no int, subtree_size long, "
    "children_match boolean, level int, outside_parent boolean"
)
BLOCK_ROWS = 200_000
THIN = 1 / 16  # rounds that take off a smaller share than this are left to doubling


def _blank_to_null(c):
    return F.when(F.length(F.regexp_replace(c, r"(?U)\s+", "")) > 0, c)


def _normalised(df: DataFrame, id: str, parent: str, group: str | None, children: str | None, level: str | None, order: str | None) -> DataFrame:
    return df.select(
        F.col(id).cast("string").alias("id"),
        _blank_to_null(F.col(parent).cast("string")).alias("parent"),
        (F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.col(id).cast("string")).alias("grp"),
        (F.col(children) if children else F.lit(None)).cast("array<string>").alias("children"),
        (F.col(level) if level else F.lit(None)).cast("int").alias("level"),
        (F.col(order) if order else F.lit(0)).cast("long").alias("ord"),
    ).filter(F.col("id").isNotNull())


def peel_arrays(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Peel a forest given as parent positions (-1: none). Peel number of each node (-1: on a cycle), subtree sizes, peel rounds."""
    n = len(parent)
    pending = np.bincount(parent[parent >= 0], minlength=n)
    size = np.ones(n, dtype=np.int64)
    peel = np.full(n, -1, dtype=np.int32)
    rounds: list[np.ndarray] = []
    leaves = np.flatnonzero(pending == 0)
    while len(leaves):
        peel[leaves] = len(rounds)
        rounds.append(leaves)
        up = parent[leaves]
        sent = up >= 0
        np.add.at(size, up[sent], size[leaves[sent]])
        np.subtract.at(pending, up[sent], 1)
        up = np.unique(up[sent])
        leaves = up[pending[up] == 0]
    return peel, size, rounds


def _assign(parent: np.ndarray, top_state: np.ndarray, peel: np.ndarray, rounds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State, depth and root of each node, in reverse peel order. top_state: state of the nodes that have no parent here."""
    n = len(parent)
    state, depth, root = top_state.copy(), np.zeros(n, dtype=np.int32), np.arange(n)
    on_cycle = peel < 0
    state[on_cycle], depth[on_cycle], root[on_cycle] = 2, -1, -1
    for nodes in reversed(rounds):
        nodes = nodes[parent[nodes] >= 0]
        up = parent[nodes]
        state[nodes] = np.where(state[up] == 2, 3, state[up])
        known = depth[up] >= 0
        depth[nodes] = np.where(known, depth[up] + 1, -1)
        root[nodes] = np.where(known, root[up], -1)
    return state, depth, root


def _preorder(parent: np.ndarray, size: np.ndarray, rounds: list[np.ndarray], peel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Preorder place of each peeled node and the node at each place: the descendants of v are at places pre[v]+1 .. pre[v]+size[v]-1."""
    n = len(parent)
    pre = np.full(n, -1, dtype=np.int64)
    peeled = np.flatnonzero(peel >= 0)
    top = np.where((parent[peeled] >= 0) & (peel[parent[peeled]] >= 0), parent[peeled], -1)
    by = np.lexsort((peeled, top))
    nodes, ups = peeled[by], top[by]
    before = np.cumsum(size[nodes]) - size[nodes]
    start = np.r_[True, ups[1:] != ups[:-1]] if len(ups) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(start, np.arange(len(ups)), 0)) if len(ups) else np.zeros(0, int)
    offset = np.zeros(n, dtype=np.int64)
    offset[nodes] = before - before[first] if len(ups) else 0
    is_top = np.zeros(n, bool)
    is_top[nodes[ups < 0]] = True
    for level in reversed(rounds):
        t = level[is_top[level]]
        pre[t] = offset[t]
        c = level[~is_top[level]]
        pre[c] = pre[parent[c]] + 1 + offset[c]
    at = np.zeros(len(peeled), dtype=np.int64)
    at[pre[peeled]] = peeled
    return pre, at


class _Block:
    """All rows of one partition, de-duplicated and linked."""

    def __init__(self, batches: list[pa.RecordBatch]):
        df = pa.Table.from_batches(batches).to_pandas() if batches else pd.DataFrame()
        df = df.sort_values("ord", kind="stable").drop_duplicates("id", keep="last").reset_index(drop=True) if len(df) else df
        self.df, self.n = df, len(df)
        if not self.n:
            return
        self.ids = df["id"].to_numpy(object)
        self.index = pd.Index(self.ids)
        has = df["parent"].notna().to_numpy()
        self.parent = self.index.get_indexer(pd.Index(df["parent"].to_numpy(object)))
        self.parent[~has] = -1
        self.outside = has & (self.parent < 0)
        self.peel, self.size, self.rounds = peel_arrays(self.parent)
        self.state, self.depth, self.root = _assign(self.parent, np.where(self.outside, 1, 0), self.peel, self.rounds)

    def children_match(self) -> np.ndarray:
        """Whether the listed children, as a set, are the nodes that name this one as parent."""
        rows, names = [], []
        for i, listed in enumerate(self.df["children"].to_numpy(object)):
            if listed is not None and len(listed):
                kept = {c for c in listed if c is not None and c.strip()}
                rows.extend([i] * len(kept))
                names.extend(kept)
        said, child = np.array(rows, dtype=np.int64), self.index.get_indexer(pd.Index(np.array(names, dtype=object))) if names else np.zeros(0, np.int64)
        right = np.zeros(len(said), bool)
        known = child >= 0
        right[known] = self.parent[child[known]] == said[known]
        listed_n = np.bincount(said, minlength=self.n)
        right_n = np.bincount(said[right], minlength=self.n)
        true_n = np.bincount(self.parent[self.parent >= 0], minlength=self.n)
        return (listed_n == right_n) & (right_n == true_n)


def _nodes_of_blocks(only_faulty: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = _Block([x for x in batches if x.num_rows])
        if not b.n:
            return
        match = b.children_match()
        level = b.df["level"].to_numpy(dtype=object)
        out = pd.DataFrame(
            {
                "id": b.ids, "parent": b.df["parent"].to_numpy(object), "state": _STATES[b.state], "depth": b.depth,
                "root": np.where(b.root >= 0, b.ids[np.maximum(b.root, 0)], None), "peel_no": b.peel, "subtree_size": b.size,
                "children_match": match, "level": pd.array([None if v is None or v != v else int(v) for v in level], dtype="Int32"), "outside_parent": b.outside,
            }
        )
        if only_faulty:
            wrong = out["level"].isna() | (out["level"] != out["depth"])
            out = out[~match | b.outside | (b.state >= 2) | ((b.state == 0) & wrong.fillna(True).to_numpy(bool))]
        out.loc[out["depth"] < 0, "depth"] = None
        schema = pa.schema([("id", pa.string()), ("parent", pa.string()), ("state", pa.string()), ("depth", pa.int32()), ("root", pa.string()), ("peel_no", pa.int32()), ("subtree_size", pa.int64()), ("children_match", pa.bool_()), ("level", pa.int32()), ("outside_parent", pa.bool_())])
        yield from pa.Table.from_pandas(out, schema=schema, preserve_index=False).to_batches(max_chunksize=20_000)

    return run


def _descendants_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    b = _Block([x for x in batches if x.num_rows])
    if not b.n:
        return
    pre, at = _preorder(b.parent, b.size, b.rounds, b.peel)
    depth = np.zeros(b.n, dtype=np.int32)
    for level in reversed(b.rounds):
        up = b.parent[level]
        inside = (up >= 0) & (b.peel[np.maximum(up, 0)] >= 0)
        depth[level] = np.where(inside, depth[np.maximum(up, 0)] + 1, 0)
    nodes = np.flatnonzero((b.peel >= 0) & (b.size > 1))
    ends = np.cumsum(b.size[nodes] - 1)
    at_row = 0
    while at_row < len(nodes):  # a slice of nodes whose lists make up about 100,000 rows
        base = ends[at_row - 1] if at_row else 0
        to = max(at_row + 1, int(np.searchsorted(ends, base + 100_000, side="right")))
        some = nodes[at_row:to]
        n = b.size[some] - 1
        rep = np.repeat(some, n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + pre[rep] + 1
        below = at[place]
        yield pa.RecordBatch.from_arrays([pa.array(b.ids[rep], pa.string()), pa.array(b.ids[below], pa.string()), pa.array((depth[below] - depth[rep]).astype(np.int32))], names=["ancestor", "descendant", "distance"])
        at_row = to


def _paths_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    b = _Block([x for x in batches if x.num_rows])
    if not b.n:
        return
    paths: dict[int, list] = {}
    ids, out, held = [], [], 0
    for level in reversed(b.rounds):
        for v in level.tolist():
            if b.depth[v] < 0:
                continue
            up = int(b.parent[v])
            path = [*paths[up], b.ids[v]] if up >= 0 else [b.ids[v]]
            if b.size[v] > 1:
                paths[v] = path
            ids.append(b.ids[v])
            out.append(path)
            held += len(path)
            if held > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.list_(pa.string()))], names=["id", "path"])
                ids, out, held = [], [], 0
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.list_(pa.string()))], names=["id", "path"])


def _links_leave_groups(rows: DataFrame) -> bool:
    """Whether any parent stands in another group than its child, or an id in two groups: both break the blocks."""
    a = rows.select("id", "grp").distinct()
    b = rows.select(F.col("parent").alias("id"), F.col("grp").alias("from")).filter("id is not null").distinct()
    # one aggregation: the groups that hold an id, against those that name it
    both = a.select("id", "grp", F.lit(True).alias("own")).unionByName(b.select("id", F.col("from").alias("grp"), F.lit(False).alias("own")))
    spread = both.groupBy("id").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.max("own").alias("held"))
    return not spread.filter("held and lo <> hi").isEmpty()


def _outside_exists(block_nodes: DataFrame, rows: DataFrame) -> bool:
    """Whether a parent that was not found in its block is an id elsewhere. The few outside names are the build side, after a size check by the optimizer."""
    names = block_nodes.filter("outside_parent").select(F.col("parent").alias("id")).distinct()
    return not rows.select("id").join(names, "id", "left_semi").isEmpty()


def _sizes(rows: DataFrame, block_rows: int) -> tuple[int, list[str]]:
    """Number of rows, and the groups of more than block_rows rows: fewer than rows / block_rows names."""
    per = rows.groupBy("grp").count()
    r = per.agg(F.sum("count").alias("n"), F.collect_list(F.when(F.col("count") > block_rows, F.col("grp"))).alias("big")).first()
    return r["n"] or 0, r["big"]


def _placed(rows: DataFrame, n: int, block_rows: int) -> DataFrame:
    """Rows by group, in enough partitions that each holds about block_rows rows at most."""
    least = -(-2 * n // block_rows)
    return rows.repartition(least, "grp") if least > shuffle_partitions(rows.sparkSession) else rows.repartition("grp")


def _split(rows: DataFrame, group: str | None, block_rows: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Rows placed in blocks that no link leaves, and the rows of trees that no block can hold."""
    n, big = _sizes(rows, block_rows) if group else (0, [])
    if group and not _links_leave_groups(rows):
        if not big:
            return [_placed(rows, n, block_rows)], None
        hot = F.col("grp").isin(*big)
        calm, rows = [_placed(rows.filter(~hot), n, block_rows)], rows.filter(hot)
    else:
        calm = []
    rows = written(rows.groupBy("id").agg(F.max_by(F.struct("parent", "children", "level", "ord"), F.struct("ord", "parent")).alias("r")).select("id", "r.*"))
    trees = written(rows.join(_trees(rows), "id"))
    n, big = _sizes(trees, block_rows)
    if not big:
        return [*calm, _placed(trees, n, block_rows)], None
    giant = F.col("grp").isin(*big)
    return [*calm, _placed(trees.filter(~giant), n, block_rows)], trees.filter(giant)


def _doubled(live: DataFrame, more: dict) -> tuple[DataFrame, DataFrame, int]:
    """Pointer doubling. live: id, at (the node it points to, itself for a top), settled, and columns to be put together by more.

    Every round a node points twice as far, until it points to a top. Ends when no node gets there any more: then those left lie on or
    below cycles. Gives the settled nodes, those left, and their number.
    """
    names = list(more)
    while True:
        up = live.select(F.col("id").alias("at"), F.col("at").alias("u_at"), F.col("settled").alias("u_settled"), *[F.col(c).alias(f"u_{c}") for c in names])
        step = live.filter(~F.col("settled")).join(up, "at").select("id", F.col("u_at").alias("at"), F.col("u_settled").alias("settled"), *[f.alias(c) for c, f in more.items()])
        step = written(step)
        n = step.agg(F.count_if("settled").alias("new"), F.count_if(~F.col("settled")).alias("left")).first()
        live = live.filter("settled").unionByName(step)
        if not n["new"] or not n["left"]:
            return live.filter("settled"), live.filter(~F.col("settled")), n["left"]


def _on_cycles(left: DataFrame, n: int) -> DataFrame:
    """id, at, low of n nodes on and below cycles, doubled until each points at least n links on: to a node of its cycle, all of which it has seen."""
    for _ in range(n.bit_length() + 1):
        up = left.select(F.col("id").alias("at"), F.col("at").alias("u_at"), F.col("low").alias("u_low"))
        left = written(left.join(up, "at").select("id", F.col("u_at").alias("at"), F.least("low", "u_low").alias("low")))
    return left


def _trees(rows: DataFrame) -> DataFrame:
    """id and grp, a name of the tree (the top's id) or, on and below a cycle, of the cycle (its least id). rows: each id once."""
    there = rows.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    base = rows.select("id", "parent").join(there, "parent", "left").select("id", F.when(F.col("there"), F.col("parent")).otherwise(F.col("id")).alias("at"), F.col("there").isNull().alias("settled"))
    low = {"low": F.least("low", "u_low")}
    settled, left, n = _doubled(written(base.withColumn("low", F.least("id", "at"))), low)
    found = settled.select("id", F.col("at").alias("grp"))
    if not n:
        return found
    left = _on_cycles(left, n)
    return found.unionByName(left.join(left.select(F.col("id").alias("at"), F.col("low").alias("grp")), "at").select("id", "grp"))


def nodes(df: DataFrame, id: str, parent: str, *, group: str | None = None, children: str | None = None, level: str | None = None, order: str | None = None, only_faulty: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per node: state, depth, root, peel number, subtree size and whether the listed children are the true ones.

    only_faulty keeps the nodes that are orphans, on or below a cycle, at another depth than their level, or with other children.
    """
    rows = _normalised(df, id, parent, group, children, level, order)
    if group:
        n, big = _sizes(rows, block_rows)
        if not big:
            block = cut(_placed(rows, n, block_rows).mapInArrow(_nodes_of_blocks(only_faulty), NODE_SCHEMA))
            if not _outside_exists(block, rows):
                return block
    blocks, giant = _split(rows, group, block_rows)
    done = [x.mapInArrow(_nodes_of_blocks(only_faulty), NODE_SCHEMA) for x in blocks]
    return _all([*done, *([_faulty(_peel_distributed(giant, block_rows).drop("path"), only_faulty)] if giant is not None else [])])


def _faulty(n: DataFrame, only: bool) -> DataFrame:
    return n.filter(~F.col("children_match") | F.col("outside_parent") | F.col("state").isin(CYCLE, BELOW) | ((F.col("state") == TREE) & ~F.col("level").eqNullSafe(F.col("depth")))) if only else n


def paths(df: DataFrame, id: str, parent: str, *, group: str | None = None, order: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """id and path (ids from the root, or from the orphan, down to the node) of every node that is not on or below a cycle."""
    rows = _normalised(df, id, parent, group, None, None, order)
    blocks, giant = _split(rows, group, block_rows)
    done = [x.mapInArrow(_paths_of_blocks, "id string, path array<string>") for x in blocks]
    return _all([*done, *([_peel_distributed(giant, block_rows, paths=True).filter("path is not null").select("id", "path")] if giant is not None else [])])


def descendants(df: DataFrame, id: str, parent: str, *, group: str | None = None, order: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """ancestor, descendant, distance: the descendant lists as rows, since one list may be as long as the table."""
    rows = _normalised(df, id, parent, group, None, None, order)
    blocks, giant = _split(rows, group, block_rows)
    done = [x.mapInArrow(_descendants_of_blocks, "ancestor string, descendant string, distance int") for x in blocks]
    if giant is None:
        return _all(done)
    walked = _peel_distributed(giant, block_rows, paths=True, below_cycles=True).filter("path is not null")
    far = walked.select(F.col("id").alias("descendant"), F.size("path").alias("n"), F.posexplode("path").alias("at", "ancestor")).filter("at < n - 1").select("ancestor", "descendant", (F.col("n") - 1 - F.col("at")).cast("int").alias("distance"))
    return _all([*done, far])


def _peel_distributed(rows: DataFrame, block_rows: int, paths: bool = False, below_cycles: bool = False) -> DataFrame:
    """The same peeling in rounds over the cluster, for trees that no block can hold.

    A round takes the leaves off, sends their counts and sizes to the parents and keeps the rest. Once the rest is at most block_rows it
    is peeled in one task; once rounds take off only few (long chains, or nothing but cycles), see _tall. below_cycles: paths also for nodes below a cycle, from
    the first node off the cycle.
    """
    one = rows.groupBy("id").agg(F.max_by(F.struct("parent", "children", "level"), "ord").alias("r")).select("id", "r.parent", "r.children", "r.level")
    known = one.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    pairs_said = one.select(F.col("id").alias("p"), F.explode(F.array_distinct(F.filter(F.coalesce("children", F.array()), lambda c: F.length(F.trim(c)) > 0))).alias("c")).select("p", "c", F.lit(1).alias("s"), F.lit(0).alias("t"))
    pairs_true = one.filter("parent is not null").select(F.col("parent").alias("p"), F.col("id").alias("c"), F.lit(0).alias("s"), F.lit(1).alias("t"))
    odd = pairs_said.unionByName(pairs_true).groupBy("p", "c").agg(F.max("s").alias("s"), F.max("t").alias("t")).filter("s <> t").select(F.col("p").alias("id")).distinct().withColumn("odd", F.lit(True))
    pending = one.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("pending"))
    start = one.join(known, "parent", "left").join(odd, "id", "left").join(pending, "id", "left").select(
        "id", "parent", "level", F.coalesce("odd", F.lit(False)).alias("odd"), (F.col("parent").isNotNull() & F.col("there").isNull()).alias("outside"),
        F.coalesce("pending", F.lit(0)).cast("long").alias("pending"), F.lit(1).cast("long").alias("size"),
    )
    live = written(start)
    taken: list[DataFrame] = []
    left = live.count()
    while left > block_rows:
        leaves = live.filter("pending = 0")
        sent = leaves.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("gone"), F.sum("size").alias("more"))
        rest = written(live.filter("pending > 0").join(sent, "id", "left").select("id", "parent", "level", "odd", "outside", (F.col("pending") - F.coalesce("gone", F.lit(0))).alias("pending"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        now = rest.count()
        if now > left * (1 - THIN):
            break
        taken.append(leaves.withColumn("peel_no", F.lit(len(taken))))
        live, left = rest, now
    kept = ["id", "parent", "level", "odd", "outside", "size", "peel_no"]
    top = _tall(live, len(taken)) if left > block_rows else _finish_in_one_block(live, len(taken))
    all_nodes = written(_all([top.select(*kept), *[t.select(*kept) for t in taken]]))
    cycle = F.col("peel_no") < 0
    ups = all_nodes.select(F.col("id").alias("parent"), cycle.alias("up_on_cycle"))
    linked = all_nodes.join(ups, "parent", "left").withColumn("is_top", F.col("parent").isNull() | F.col("outside") | F.coalesce("up_on_cycle", F.lit(False)))
    own = F.array("id") if paths else F.lit(None).cast("array<string>")
    at_top = F.when(F.col("outside"), ORPHAN).when(F.col("parent").isNull(), TREE).otherwise(BELOW)
    start = linked.filter(~cycle).select("id", F.when(F.col("is_top"), F.col("id")).otherwise(F.col("parent")).alias("at"), F.col("is_top").alias("settled"), F.when(F.col("is_top"), 0).otherwise(1).alias("depth"), own.alias("path"), F.when(F.col("is_top"), at_top).alias("state"))
    # a node's path so far ends with itself; the path of the node it points to, up to its own pointer, is put before it
    more = {"depth": F.col("depth") + F.col("u_depth"), "path": F.concat("u_path", "path"), "state": F.col("u_state")}
    found, _, _ = _doubled(written(start), more)
    off = F.col("state") == BELOW
    return linked.join(found, "id", "left").select(
        "id", "parent", F.when(F.col("peel_no") < 0, CYCLE).otherwise(F.col("state")).alias("state"), F.when(~off, F.col("depth")).cast("int").alias("depth"), F.when(~off, F.col("at")).alias("root"),
        "peel_no", F.col("size").alias("subtree_size"), (~F.col("odd")).alias("children_match"), "level", F.col("outside").alias("outside_parent"), F.when(~off | F.lit(below_cycles), F.col("path")).alias("path"),
    )


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _tall(live: DataFrame, first_peel: int) -> DataFrame:
    """Peel numbers (-1 on a cycle) and sizes of a tall rest, all rounds of which at once by doubling: in round k every node sends what it
    knows of the nodes less than 2**k links below it to the node 2**k links above it."""
    alone = F.col("parent").isNull() | F.col("outside")
    base = live.select("id", F.when(alone, F.col("id")).otherwise(F.col("parent")).alias("at"), alone.alias("settled"))
    _, left, n = _doubled(written(base.withColumn("low", F.least("id", "at"))), {"low": F.least("low", "u_low")})
    on = written(_on_cycles(left, n).select(F.col("at").alias("id")).distinct().withColumn("on", F.lit(True))) if n else live.select("id", F.lit(True).alias("on")).limit(0)
    marked = live.join(on, "id", "left").join(on.select(F.col("id").alias("parent"), F.col("on").alias("up_on")), "parent", "left")
    link = F.when(alone | F.coalesce("on", F.lit(False)) | F.coalesce("up_on", F.lit(False)), None).otherwise(F.col("parent"))
    known = written(marked.select("id", link.alias("at"), "size", F.lit(0).alias("height")))
    far = 1
    while not known.filter("at is not null").isEmpty():
        sent = known.filter("at is not null").groupBy(F.col("at").alias("id")).agg(F.sum("size").alias("more"), F.max("height").alias("below"))
        up = known.select(F.col("id").alias("at"), F.col("at").alias("next"))
        merged = known.join(sent, "id", "left").join(up, "at", "left")
        known = written(merged.select("id", F.col("next").alias("at"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), F.greatest("height", F.col("below") + far).alias("height")))
        far *= 2
    done = known.join(on, "id", "left").select("id", "size", F.when(F.col("on"), -1).otherwise(F.col("height") + first_peel).cast("int").alias("peel_no"))
    return live.select("id", "parent", "level", "odd", "outside").join(done, "id")


def _finish_in_one_block(live: DataFrame, first_peel: int) -> DataFrame:
    """Peel numbers (-1 on a cycle) and sizes of the top of the forest, at most block_rows rows, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        ids, ups = (table.column(c).to_numpy() for c in ("id", "parent"))
        parent = pd.Index(ids).get_indexer(pd.Index(ups))
        parent[pd.isna(ups)] = -1
        peel, _, rounds = peel_arrays(parent)
        size = table.column("size").to_numpy().copy()
        for level in rounds:
            sent = level[parent[level] >= 0]
            np.add.at(size, parent[sent], size[sent])
        number = np.where(peel < 0, -1, peel + first_peel).astype(np.int32)
        out = table.drop_columns(["size"]).append_column("size", pa.array(size)).append_column("peel_no", pa.array(number))
        yield from out.select(["id", "parent", "level", "odd", "outside", "size", "peel_no"]).to_batches(max_chunksize=10_000)

    return live.coalesce(1).mapInArrow(run, "id string, parent string, level int, odd boolean, outside boolean, size long, peel_no int")


def faults(df: DataFrame, id: str, parent: str, *, group: str | None = None, children: str | None = None, level: str | None = None, order: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """id and issue (cycle, below_cycle, orphan, level, children), one row per fault."""
    n = nodes(df, id, parent, group=group, children=children, level=level, order=order, only_faulty=True, block_rows=block_rows)
    said = F.array_compact(
        F.array(
            F.when(F.col("state") == CYCLE, "cycle"),
            F.when(F.col("state") == BELOW, "below_cycle"),
            F.when(F.col("outside_parent"), "orphan"),
            F.when((F.col("state") == TREE) & ~F.col("level").eqNullSafe(F.col("depth")), "level") if level else F.lit(None).cast("string"),
            F.when(~F.col("children_match"), "children") if children else F.lit(None).cast("string"),
        )
    )
    return n.select("id", F.explode(said).alias("issue"))
