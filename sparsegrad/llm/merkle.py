"""Merkle manifest of a table of documents, with multiproofs for runs of leaves.

Every row is a leaf; the leaves of a language, in order of their id, form a
tree of eight children a node, and the roots of the languages form the tree on
top. The nodes of all trees are built together, three levels a shuffle, and
kept as one table (tree, level, idx, h).

Proofs are made by runs of neighbouring leaves, not leaf by leaf. A run works
out which node coordinates its leaves need and cannot derive themselves (the
union of an Octopus multiproof), fetches each of them once by a join, derives
the shared inner nodes, and expands the proof of each leaf locally.

Defined cases: a null field is ``-`` in the leaf; null languages form a tree of
their own, ordered first; null ids come first in their tree; rows with equal
ids are ordered by their leaf digest, and equal rows are neighbouring leaves; a
lone leaf is the root of its tree; an empty table gives an empty result;
columns other than the five fields do not matter.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialised, small, stored

FAN = 8
#: Tree levels built by one shuffle, so a group has at most FAN ** LEVELS nodes.
LEVELS = 3
#: A run has at most 2 ** RUN_BITS leaves.
RUN_BITS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Tree number of the tree whose leaves are the roots of the languages.
TOP = -1

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# -------------------------------------------------------------------- leaves

def field_code(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon, value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(**replaced: Column) -> Column:
    parts = [field_code(replaced.get(c, F.col(c))) for c in FIELDS]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """uid, doc_id, lang, leaf and, where the text was tampered with, the leaf
    that the changed text gives."""
    changed = leaf_digest(text=F.translate(F.col("text"), UPPER, LOWER))
    return docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id"), F.col("lang"),
                       leaf_digest().alias("leaf"),
                       F.when(tampered(F.col("doc_id")), changed).alias("changed"))


def ordered(leaves: DataFrame) -> DataFrame:
    """Leaves with ``at``, a number that ascends in the order of all trees and
    by one inside a range partition; ``part`` is that partition."""
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("uid")]
    ranges = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(ranges.withColumn("at", F.monotonically_increasing_id()).drop("uid"), "ordered")
    return rows.withColumn("part", F.shiftright("at", 33)).withColumn(
        "lkey", F.coalesce(F.concat(F.lit("s"), F.col("lang")), F.lit("n")))


def numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """Leaves with tree (rank of the language), size (leaves of the tree) and
    pos (place in the tree), and the number of trees. Places come from counts
    by (language, range partition), never from one sorted group."""
    heads = stored(rows.groupBy("lkey", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("head")), "heads")
    langs = heads.groupBy("lkey").agg(F.min("head").alias("start"), F.sum("n").alias("size")).withColumn(
        "first_part", F.shiftright("start", 33))
    # one row for each range partition
    parts = langs.groupBy("first_part").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_from", F.coalesce(F.sum("_n").over(Window.orderBy("first_part").rowsBetween(Window.unboundedPreceding, -1)),
                            F.lit(0))).drop("_n")
    inside = Window.partitionBy("first_part").orderBy("start")
    trees = stored(langs.join(F.broadcast(parts), "first_part").select(
        "lkey", "size", (F.row_number().over(inside) - 1 + F.col("_from")).cast("long").alias("tree")), "trees")
    n_trees = trees.count()
    before = Window.partitionBy("lkey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = heads.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(
        small(trees, n_trees), "lkey").drop("n")
    places = stored(places, "places")
    return stored(rows.join(small(places, places.count()), ["lkey", "part"]).select(
        "doc_id", "leaf", "changed", "at", "tree", "size",
        (F.col("before") + F.col("at") - F.col("head")).alias("pos")), "numbered"), n_trees


# --------------------------------------------------------------------- nodes

def _joined_up(children: Column) -> Column:
    """Digest of every FAN consecutive nodes; the last run may be shorter."""
    last = F.floor((F.size(children) - 1) / FAN).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(
        F.array_join(F.slice(children, i * FAN + 1, FAN), "").cast("binary"), 256))


def _above(size: Column, levels: int) -> Column:
    """Nodes of a tree that many levels further up."""
    return F.ceil(size / F.lit(FAN ** levels)).cast("long")


def _round(nodes: DataFrame, level: int) -> DataFrame:
    """The next LEVELS levels over the nodes (tree, size, idx, h) of ``level``
    of trees that have more than one node there."""
    group = FAN ** LEVELS
    row = F.sort_array(F.collect_list(F.struct("idx", "h")))
    cells = nodes.groupBy("tree", "size", F.floor(F.col("idx") / group).cast("long").alias("cell")).agg(row.alias("row"))
    cells = materialised(cells, l0=F.transform("row", lambda x: x["h"])).drop("row")
    for k in range(1, LEVELS + 1):
        grows = _above(F.col("size"), k - 1) > 1
        # bound by a generator, so a level is not worked out again for each node above it
        cells = materialised(cells, **{f"l{k}": F.when(grows, _joined_up(F.col(f"l{k - 1}")))})

    def rows(k: int) -> Column:
        first = F.col("cell") * (group // FAN ** k)
        made = F.transform(f"l{k}", lambda h, i: F.struct(
            F.lit(level + k).alias("level"), _above(F.col("size"), k).alias("size"), (first + i).alias("idx"), h.alias("h")))
        return F.coalesce(made, F.array().cast("array<struct<level:int,size:bigint,idx:bigint,h:string>>"))

    made = [rows(k) for k in range(1, LEVELS + 1)]
    return cells.select("tree", F.inline(F.concat(*made)))


def node_table(leaves: DataFrame, largest: int) -> DataFrame:
    """(tree, level, size, idx, h) of all nodes over the leaves (tree, size,
    idx, h); size is the tree's number of nodes at that level and ``largest``
    the greatest number of leaves. Each round is written before the next."""
    out = leaves.select("tree", F.lit(0).alias("level"), "size", "idx", "h")
    live, level = leaves, 0
    while largest > 1:
        made = stored(_round(live.filter("size > 1"), level), f"nodes{level}")
        out = out.unionByName(made)
        level += LEVELS
        largest = -(-largest // FAN ** LEVELS)
        live = made.filter(F.col("level") == level).drop("level")
    return out


# --------------------------------------------------------------- multiproofs

def level_sizes(size: int) -> list[int]:
    out = [size]
    while out[-1] > 1:
        out.append(-(-out[-1] // FAN))
    return out


def missing(indices: list[int], size: int) -> list[tuple[int, int]]:
    """(level, idx) of the nodes that proofs of these leaves need and that the
    leaves themselves do not give: the children of their ancestors which are
    neither leaves of the set nor ancestors."""
    out, have = [], sorted(set(indices))
    for level, n in enumerate(level_sizes(size)[:-1]):
        known, parents = set(have), sorted({i // FAN for i in have})
        out += [(level, k) for p in parents for k in range(p * FAN, min(p * FAN + FAN, n)) if k not in known]
        have = parents
    return out


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


Path = tuple[tuple[str, str], ...]


def derive(leaves: dict[int, str], size: int, fetched: dict[tuple[int, int], str],
           above: Path = ()) -> tuple[str, Callable[[int], Path]]:
    """(root, path_of) of one tree: the inner nodes that the leaves share are
    derived once; ``path_of(leaf)`` expands the leaf's proof, a (left, right)
    pair of sibling strings for each level, followed by ``above``."""
    sizes, have = level_sizes(size), dict(leaves)
    known = [have]
    for level, n in enumerate(sizes[:-1]):
        row = {k: have[k] if k in have else fetched[level, k]
               for p in {i // FAN for i in have} for k in range(p * FAN, min(p * FAN + FAN, n))}
        known[level] = row
        have = {p: digest("".join(row[k] for k in range(p * FAN, min(p * FAN + FAN, n))))
                for p in {i // FAN for i in have}}
        known.append(have)
    shared: dict[tuple[int, int], Path] = {(len(sizes) - 1, 0): above}

    def path(level: int, i: int) -> Path:
        if level == len(sizes) - 1:
            return above
        p, row = i // FAN, known[level]
        up = shared.get((level + 1, p))
        if up is None:
            up = shared[level + 1, p] = path(level + 1, p)
        last = min(p * FAN + FAN, sizes[level])
        return (("".join(row[k] for k in range(p * FAN, i)), "".join(row[k] for k in range(i + 1, last))), *up)

    return known[-1][0], lambda i: path(0, i)


def folded(leaf: str, path: Path) -> str:
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


def _wanted(n_trees: int):
    """Missing coordinates of a run, over the trees it touches and the top."""
    def run(key, batch):
        trees: dict[int, tuple[int, list[int]]] = {}
        for tree, size, pos in zip(*[batch.column(c).to_pylist() for c in ("tree", "size", "pos")]):
            trees.setdefault(tree, (size, []))[1].append(pos)
        found = [(tree, *x) for tree, (size, places) in trees.items() for x in missing(places, size)]
        found += [(TOP, *x) for x in missing(list(trees), n_trees)]
        cols = list(zip(*found)) or [(), (), ()]
        return pa.table({"run": pa.array([key[0].as_py()] * len(found), pa.int64()), "tree": pa.array(cols[0], pa.int64()),
                         "level": pa.array(cols[1], pa.int32()), "idx": pa.array(cols[2], pa.int64())})

    return run, "run long, tree long, level int, idx long"


def _expanded(n_trees: int):
    names = ["tree", "size", "pos", "leaf", "changed"]

    def run(batch, nodes):
        fetched: dict[int, dict[tuple[int, int], str]] = {}
        for tree, level, idx, h in zip(*[nodes.column(c).to_pylist() for c in ("tree", "level", "idx", "h")]):
            fetched.setdefault(tree, {})[level, idx] = h
        rows = list(zip(*[batch.column(c).to_pylist() for c in names]))
        trees: dict[int, tuple[int, dict[int, str]]] = {}
        for tree, size, pos, leaf, _ in rows:
            trees.setdefault(tree, (size, {}))[1][pos] = leaf
        subroots = {t: derive(leaves, size, fetched.get(t, {}))[0] for t, (size, leaves) in trees.items()}
        root, top_path = derive(subroots, n_trees, fetched.get(TOP, {}))
        paths = {t: derive(leaves, size, fetched.get(t, {}), top_path(t))[1] for t, (size, leaves) in trees.items()}
        out = []
        for tree, _, pos, leaf, changed in rows:
            path = paths[tree](pos)
            end = folded(changed or leaf, path)
            out.append((subroots[tree], root, digest("".join(a + b for a, b in path)), end, end == root))
        cols = list(zip(*out)) or [()] * 5
        table = {"doc_id": batch.column("doc_id"), "leaf": batch.column("leaf")}
        for name, col in zip(("subroot", "root", "proof_sha256", "folded_root"), cols):
            table[name] = pa.array(col, pa.string())
        return pa.table({**table, "verified": pa.array(cols[4], pa.bool_())})

    return run


class Manifest:
    """``leaves`` (numbered), ``nodes`` of all trees, ``n_trees`` and ``root``
    (None for an empty table) of the documents."""

    def __init__(self, docs: DataFrame):
        rows = ordered(stored(leaf_rows(docs), "leaves"))
        self.leaves, self.n_trees = numbered(rows)
        at_zero = self.leaves.select("tree", "size", F.col("pos").alias("idx"), F.col("leaf").alias("h"))
        below = node_table(at_zero, self.leaves.agg(F.max("size")).first()[0] or 0)
        roots = below.filter("size = 1").select(
            F.lit(TOP).cast("long").alias("tree"), F.lit(self.n_trees).cast("long").alias("size"),
            F.col("tree").alias("idx"), "h")
        above = node_table(stored(roots, "subroots"), self.n_trees)
        self.nodes = below.unionByName(above)
        last = above.filter("size = 1").select("h").first()
        self.root = last.h if last else None

    def requests(self, leaves: DataFrame) -> DataFrame:
        """Distinct (run, tree, level, idx) that the runs of ``leaves`` fetch."""
        run, schema = _wanted(self.n_trees)
        return leaves.select("run", "tree", "size", "pos").groupBy("run").applyInArrow(run, schema)

    def proofs(self, which: Column | None = None) -> DataFrame:
        """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of
        every leaf, or of those that ``which`` (over doc_id, leaf) selects."""
        leaves = self.leaves.withColumn("run", F.shiftright("at", RUN_BITS))
        if which is not None:
            leaves = leaves.filter(which)
        wanted = stored(self.requests(leaves), "wanted")
        fetched = stored(self.nodes.join(small(wanted, wanted.count()), ["tree", "level", "idx"]).select(
            "run", "tree", "level", "idx", "h"), "fetched")
        key = dict(self.leaves.dtypes)["doc_id"]
        schema = (f"doc_id {key}, leaf string, subroot string, root string, proof_sha256 string, "
                  "folded_root string, verified boolean")
        return leaves.drop("at").groupBy("run").cogroup(fetched.groupBy("run")).applyInArrow(
            _expanded(self.n_trees), schema)
