"""A Merkle tree over a document table, and what becomes of it when documents are tampered with.

Leaves of a language lie in the order of their doc_id; ``ARITY`` consecutive nodes have one parent. Aligned
blocks of ``ARITY ** BLOCK_LEVELS`` nodes are small persistent trees of one task each; the tops of the blocks
are the nodes of the next round, until one node a language is left, and the languages' nodes go the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayforge.llm.batches import map_rows, written
from assayforge.operators.skew import lookup_join

ARITY = 8
BLOCK_LEVELS = 3  # a block has 8^3 = 512 nodes: about 50 KB
WORLD = "*"  # the one group in which the languages' subroots lie


def digest(parts: bytes) -> bytes:
    """Lower-case hexadecimal SHA-256 as ASCII text."""
    return hashlib.sha256(parts).hexdigest().encode()


def field(value: Column) -> Column:
    """``-`` for null, else the value's length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, text))).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, letters, letters.lower())


def tampered(docs: DataFrame) -> Column:
    """Documents whose id's unsigned crc32 is divisible by 3; a null id is left alone."""
    return F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0, F.lit(False))


class PersistentTree:
    """Nodes that are never changed: a version is the number of its top node.

    ``levels`` of parents stand above the first version's leaves. ``changed`` gives the top of a new
    version that shares all nodes but the changed leaf and its ancestors.
    """

    def __init__(self, leaves: list[bytes], levels: int):
        self.digests: list[bytes] = list(leaves)
        self.children: list[tuple[int, ...]] = [()] * len(leaves)
        self.levels = levels
        nodes = list(range(len(leaves)))
        for _ in range(levels):
            nodes = [self._parent(tuple(nodes[i:i + ARITY])) for i in range(0, len(nodes), ARITY)]
        (self.first,) = nodes

    def _parent(self, children: tuple[int, ...]) -> int:
        self.digests.append(digest(b"".join([self.digests[c] for c in children])))
        self.children.append(children)
        return len(self.digests) - 1

    def _down(self, top: int, place: int) -> list[tuple[int, int]]:
        """(node, which child leads on) from ``top`` to the parent of leaf ``place``."""
        steps, node = [], top
        for level in reversed(range(self.levels)):
            turn = place // ARITY**level % ARITY
            steps.append((node, turn))
            node = self.children[node][turn]
        return steps

    def siblings(self, place: int) -> list[tuple[bytes, bytes]]:
        """The digests left and right of the leaf and of each ancestor below the top, from the leaf up."""
        out = []
        for node, turn in reversed(self._down(self.first, place)):
            run = [self.digests[c] for c in self.children[node]]
            out.append((b"".join(run[:turn]), b"".join(run[turn + 1:])))
        return out

    def changed(self, top: int, place: int, leaf: bytes) -> int:
        """A version like ``top`` with another leaf: one new node a level, everything else is shared."""
        steps = self._down(top, place)
        self.digests.append(leaf)
        self.children.append(())
        node = len(self.digests) - 1
        for parent, turn in reversed(steps):
            run = self.children[parent]
            node = self._parent((*run[:turn], node, *run[turn + 1:]))
        return node


def levels_of(total: int) -> int:
    """Levels above ``total`` nodes inside one block: as many as it takes to one node, at most those of a block."""
    levels = 0
    while levels < BLOCK_LEVELS and total > ARITY**levels:
        levels += 1
    return levels


def climbed(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The top reached from ``node`` by the digests left and right of it on each level."""
    for left, right in path:
        node = digest(left + node + right)
    return node


def _packed(path: list[tuple[bytes, bytes]]) -> str:
    return " ".join(f"{left.decode()},{right.decode()}" for left, right in path)


def _unpacked(path: str) -> list[tuple[bytes, bytes]]:
    return [tuple(side.encode() for side in level.split(",")) for level in path.split(" ")] if path else []


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[list]]:
    """The rows of one (group, block) after the other as lists of columns; both are the first two columns."""
    at, held = None, [[] for _ in range(width)]
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        start = 0
        keys = list(zip(columns[0], columns[1], strict=True))
        for end in range(1, len(keys) + 1):
            if end < len(keys) and keys[end] == keys[start]:
                continue
            if keys[start] != at and held[0]:
                yield held
                held = [[] for _ in range(width)]
            at = keys[start]
            for mine, column in zip(held, columns, strict=True):
                mine += column[start:end]
            start = end
    if held[0]:
        yield held


def _dealt(nodes: DataFrame, *order: Column | str) -> DataFrame:
    """Rows with their block as second column; the rows of a block lie together in the given order."""
    block = F.expr(f"place div {ARITY**BLOCK_LEVELS}").alias("block")
    rest = [c for c in nodes.columns if c != "grp"]
    return nodes.select("grp", block, *rest).repartition("grp", "block").sortWithinPartitions("grp", "block", *order)


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``place``, from 0 in each ``grp`` by ``order`` (ascending, nulls first), and ``total``, the group's rows.

    ``order`` must tell rows apart. Rows are cut into ranges of the whole order and written, so that one
    group or value may hold most of them; one row a range and group is summed up in one place.
    """
    at, kind = "_at", "_range"
    sorted_rows = nodes.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    ranged = written(sorted_rows.withColumn(at, F.monotonically_increasing_id()), "merkle-leaves")
    ranged = ranged.withColumn(kind, F.shiftright(at, 33))  # the upper bits are the partition's number
    sizes = ranged.groupBy("grp", kind).agg(F.min(at).alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy("grp")
    before = F.coalesce(F.sum("_n").over(whole.orderBy(kind).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("grp", kind, (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("total"))
    return lookup_join(ranged, offsets, ["grp", kind], "inner").select(
        *nodes.columns, (F.col(at) + F.col("_shift")).alias("place"), "total")


def block_tops(nodes: DataFrame) -> DataFrame:
    """The nodes of the next round, (grp, place, node, total), from those of this one."""
    def run(batches):
        for group, block, _, node, total in _blocks(batches, 5):
            tree = PersistentTree([n.encode() for n in node], levels_of(total[0]))
            yield {"grp": group[:1], "place": block[:1], "node": [tree.digests[tree.first].decode()],
                   "total": [-(-total[0] // ARITY**BLOCK_LEVELS)]}

    return written(map_rows(_dealt(nodes.select("grp", "place", "node", "total"), "place"), run,
                            "grp string, place long, node string, total long"), "merkle-nodes")


def rounds_above(nodes: DataFrame) -> list[DataFrame]:
    """The rounds after ``nodes`` until every group has one node; there is one at least."""
    rounds = [block_tops(nodes)]
    while rounds[-1].where("total > 1").limit(1).count():
        rounds.append(block_tops(rounds[-1]))
    return rounds


def paths_of(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """(grp, place, path, top) of ``nodes`` from the same columns of the round after them.

    ``path`` has the digests left and right of a node and of its ancestors, from the node up.
    """
    lines = nodes.select("grp", "place", "total", "node", F.lit("").alias("path"), F.lit("").alias("top")).unionByName(
        _path_lines(above).withColumn("node", F.lit("")))

    def run(batches):
        for group, _, place, total, node, path, top in _blocks(batches, 7):
            tree = PersistentTree([n.encode() for n in node[1:]], levels_of(total[1]))  # the path comes first
            own = [_packed(tree.siblings(i)) for i in range(len(node) - 1)]
            yield {"grp": group[1:], "place": place[1:], "top": top[:1] * len(own),
                   "path": [f"{p} {path[0]}".strip() for p in own]}

    return written(map_rows(_dealt(lines, F.col("total") >= 0, "place"), run,
                            "grp string, place long, path string, top string"), "merkle-paths")


def _path_lines(above: DataFrame) -> DataFrame:
    """One line a block, marked by the total -1, with the path from the block's top on."""
    return above.select("grp", (F.col("place") * ARITY**BLOCK_LEVELS).alias("place"),
                        F.lit(-1).cast("long").alias("total"), "path", "top")


def verify(docs: DataFrame, changed: Column | None = None, text: Column | None = None, *, proofs: bool = False) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``docs``.

    The tree is that of ``docs`` as they are: leaves of (doc_id, source, lang, n_chars, text), a subroot for
    each lang, nulls first, and the root above them. Where ``changed`` holds (by default, ``tampered``), the
    document is read again with ``text`` in place of its text (by default, with A-Z lower-cased); its leaf
    then makes a version of the tree of its own. ``folded_root`` is that version's root, and for other
    documents the root that the leaf and its siblings give. With ``proofs`` the siblings follow as a list of
    (left, right) digests, level by level, in ``proof``.

    A null doc_id comes first in its lang; rows of one doc_id go by leaf, equal rows have a leaf each and one
    order among them is as good as another. Null and empty texts differ. Other columns are ignored. No rows
    give no rows.
    """
    changed = tampered(docs) if changed is None else changed
    text = lower_ascii(docs["text"]) if text is None else text
    fields = [docs[c] for c in ("doc_id", "source", "lang", "n_chars")]
    read = docs.select(
        F.coalesce(F.concat(F.lit("+"), docs["lang"].cast("string")), F.lit("")).alias("grp"),
        docs["doc_id"].cast("long").alias("doc_id"), leaf_digest(*fields, docs["text"]).alias("leaf"),
        F.when(changed, leaf_digest(*fields, text)).alias("altered"), F.monotonically_increasing_id().alias("row"))
    leaves = placed(written(read, "merkle-read"), ["doc_id", "leaf", "altered", "row"])
    rounds = rounds_above(leaves.withColumnRenamed("leaf", "node"))

    subroots = rounds[-1].select(F.col("grp").alias("lang"), "node")
    world = placed(subroots.withColumn("grp", F.lit(WORLD)), ["lang"])
    above = rounds_above(world)
    ways = above[-1].select("grp", "place", F.lit("").alias("path"), F.col("node").alias("top"))
    for level in [*reversed(above[:-1]), world]:
        ways = paths_of(level, ways)
    langs = world.join(ways, ["grp", "place"]).select(
        F.col("lang").alias("grp"), F.lit(0).cast("long").alias("place"), "path",
        F.concat("node", F.lit(" "), "top").alias("top"))
    for level in reversed(rounds[:-1]):
        langs = paths_of(level, langs)

    lines = leaves.select("grp", "place", "total", "doc_id", "leaf", "altered", F.lit("").alias("path"),
                          F.lit("").alias("top")).unionByName(_path_lines(langs), allowMissingColumns=True)

    def run(batches):
        for _, _, _, total, ids, leaf, altered, path, top in _blocks(batches, 9):
            tree = PersistentTree([x.encode() for x in leaf[1:]], levels_of(total[1]))
            above = _unpacked(path[0])
            subroot, root = top[0].split(" ")
            n = len(ids) - 1
            out = {"doc_id": ids[1:], "leaf": leaf[1:], "subroot": [subroot] * n, "root": [root] * n}
            found, folded, ways = [], [], []
            for i, other in enumerate(altered[1:]):
                way = tree.siblings(i) + above
                found.append(digest(b"".join([side for level in way for side in level])).decode())
                if other is None:
                    folded.append(climbed(leaf[1 + i].encode(), way).decode())
                else:
                    version = tree.changed(tree.first, i, other.encode())
                    folded.append(climbed(tree.digests[version], above).decode())
                if proofs:
                    ways.append([{"left": left.decode(), "right": right.decode()} for left, right in way])
            yield out | {"proof_sha256": found, "folded_root": folded, "verified": [f == root for f in folded], "proof": ways}

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    schema += ", proof array<struct<left: string, right: string>>" * proofs
    return map_rows(_dealt(lines, F.col("total") >= 0, "place"), run, schema)
