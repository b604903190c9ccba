"""Merkle manifest of a dataset, and which rows have been tampered with.

Every row is a leaf. Within a group (a language) the leaves ascend by id and
each run of ``FANOUT`` consecutive nodes becomes the SHA-256 of its digests'
concatenated hex text, level by level, until one node, the group's subroot,
remains; the subroots, by group, give the root the same way.

Each tampered leaf makes one version of a persistent tree: the nodes from the
leaf up are copied, all others are shared with the original
(``PersistentTree``). Leaves are cut into aligned blocks of
``FANOUT ** block_levels``; a block is one row, so that no task holds more than
its blocks. The block roots are the leaves of the next layer, and so on until
each group has one node and, by the same steps over the groups, the whole has
one. Then paths go down: a block learns the siblings of all its ancestors above
it, so that it continues its versions beyond its own root and completes its
leaves' proofs by itself.

Shuffled are digests (32 bytes a row), never texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import frozen, quoted, ranked

FANOUT = 8
BLOCK_LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
PATH = "array<struct<before: binary, after: binary>>"


def lower_text(row: dict[str, bytes | None], leaf_id: str = "doc_id",
               text: str = "text") -> dict[str, bytes | None] | None:
    """The registered tampering: where 3 divides the crc32 of the decimal id, the
    text's A-Z become lower case. None: the row is left alone."""
    if row[leaf_id] is None or zlib.crc32(row[leaf_id]) % 3:
        return None
    return row | {text: None if row[text] is None else row[text].translate(_LOWER)}


def leaf_digest(values: Sequence[bytes | None]) -> bytes:
    """SHA-256 of the values, each ``-`` if None, else its length, ``:`` and itself."""
    h = hashlib.sha256()
    for v in values:
        if v is None:
            h.update(b"-")
        else:
            h.update(b"%d:" % len(v))
            h.update(v)
    return h.digest()


def joined(digests: Sequence[bytes]) -> bytes:
    return "".join(d.hex() for d in digests).encode()


class PersistentTree:
    """A tree over at most ``FANOUT ** levels`` leaf digests whose versions share
    what they have in common. A version is the number of its root node."""

    def __init__(self, leaves: Sequence[bytes], levels: int):
        self.digests, self.children, self.levels = list(leaves), [()] * len(leaves), levels
        nodes = list(range(len(leaves)))
        for _ in range(levels):
            nodes = [self._node(nodes[i:i + FANOUT]) for i in range(0, len(nodes), FANOUT)]
        self.version, = nodes

    def _node(self, children: Sequence[int]) -> int:
        self.children.append(tuple(children))
        self.digests.append(hashlib.sha256(joined([self.digests[c] for c in children])).digest())
        return len(self.digests) - 1

    def path(self, leaf: int, version: int | None = None) -> list[tuple[int, int]]:
        """(node, slot of its child on the path) from the root down to a leaf."""
        node, steps = self.version if version is None else version, []
        for level in reversed(range(self.levels)):
            slot = leaf // FANOUT ** level % FANOUT
            steps.append((node, slot))
            node = self.children[node][slot]
        return steps

    def changed(self, leaf: int, digest: bytes, version: int | None = None) -> int:
        """A new version with another leaf digest: only the leaf and its
        ancestors are new nodes."""
        steps = self.path(leaf, version)
        self.digests.append(digest)
        self.children.append(())
        node = len(self.digests) - 1
        for parent, slot in reversed(steps):
            old = self.children[parent]
            node = self._node(old[:slot] + (node,) + old[slot + 1:])
        return node

    def siblings(self, leaf: int) -> list[tuple[bytes, bytes]]:
        """Per level from the leaf up, the hex text before and after its place."""
        out = []
        for parent, slot in reversed(self.path(leaf)):
            run = [self.digests[c] for c in self.children[parent]]
            out.append((joined(run[:slot]), joined(run[slot + 1:])))
        return out


def climb(digest: bytes, path: Sequence[tuple[bytes, bytes]]) -> bytes:
    """The digest at the end of a path of siblings."""
    for before, after in path:
        digest = hashlib.sha256(before + digest.hex().encode() + after).digest()
    return digest


def levels_of(total: int, block_levels: int) -> int:
    """Levels that a block builds: all of them where the group is one block,
    else ``block_levels``, also above a last run of one node."""
    levels = 0
    while levels < block_levels and (total > 1):
        total, levels = -(-total // FANOUT), levels + 1
    return levels


def _leaves(docs: DataFrame, fields: Sequence[str], leaf_id: str, group: str,
            tamper: Callable[[dict], dict | None]) -> DataFrame:
    """id, grp, leaf, changed (the tampered leaf; null where not tampered)."""
    cols = quoted(docs, *fields)
    key, grp = quoted(docs, leaf_id, group)
    plain = docs.select(key.alias("id"), grp.alias("grp"),
                        *[c.cast("string").cast("binary").alias(f"f{i}") for i, c in enumerate(cols)])
    names = list(fields)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf, changed = [], []
            # Row by row from the buffers: the texts of a batch are never all copied.
            for i in range(b.num_rows):
                row = {n: b.column(2 + j)[i].as_py() for j, n in enumerate(names)}
                leaf.append(leaf_digest([row[n] for n in names]))
                other = tamper(row)
                changed.append(None if other is None else leaf_digest([other[n] for n in names]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(leaf, pa.binary()), pa.array(changed, pa.binary())],
                names=["id", "grp", "leaf", "changed"])

    id_type, grp_type = (plain.schema[n].dataType.simpleString() for n in ("id", "grp"))
    return plain.mapInArrow(digests, f"id {id_type}, grp {grp_type}, leaf binary, changed binary")


def _blocks(nodes: DataFrame, block_levels: int) -> DataFrame:
    """One row for each aligned block: its nodes in order, as arrays of at most
    ``FANOUT ** block_levels`` entries."""
    size = F.lit(FANOUT ** block_levels)
    members = F.sort_array(F.collect_list(F.struct("rank", "id", "leaf", "changed")))
    packed = (nodes.groupBy("grp", F.floor(F.col("rank") / size).cast("long").alias("block"))
              .agg(F.max("total").alias("total"), members.alias("m")))
    return frozen(packed.select("grp", "block", "total", F.col("m.id").alias("id"),
                                F.col("m.leaf").alias("leaf"), F.col("m.changed").alias("changed")))


def _roots(blocks: DataFrame, block_levels: int) -> DataFrame:
    """The next layer's nodes: a block's root, ranked as the block is."""
    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves, totals = b.column("leaf"), b.column("total").to_pylist()
            found = []
            for i, total in enumerate(totals):
                tree = PersistentTree(leaves[i].as_py(), levels_of(total, block_levels))
                found.append(tree.digests[tree.version])
            yield pa.RecordBatch.from_arrays(
                [b.column("grp"), b.column("block"), pa.array(found, pa.binary())],
                names=["grp", "rank", "leaf"])

    size = F.lit(FANOUT ** block_levels)
    grp = blocks.schema["grp"].dataType.simpleString()
    up = (blocks.select("grp", "block", "total", "leaf")
          .mapInArrow(roots, f"grp {grp}, rank long, leaf binary"))
    totals = blocks.select("grp", "block", F.ceil(F.col("total") / size).cast("long").alias("total"))
    return (up.join(totals, up["grp"].eqNullSafe(totals["grp"]) & (up["rank"] == totals["block"]))
            .select(up["grp"], "rank", "total", "leaf", F.lit(None).cast("binary").alias("changed"),
                    F.col("rank").alias("id")))


def _layers(nodes: DataFrame, block_levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every layer, from the leaves up, and each group's last node."""
    layers = []
    while True:
        blocks = _blocks(nodes, block_levels)
        layers.append(blocks)
        nodes = _roots(blocks, block_levels)
        # One number: whether any group has more than one block.
        if (nodes.agg(F.max("total")).first()[0] or 0) <= 1:
            return layers, nodes


def _with_paths(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """Blocks with the path (and ends) of their roots, matched by group and rank."""
    above = paths.select(F.col("grp").alias("_grp"), F.col("rank").alias("_rank"), "path",
                         "subroot", "root")
    return (blocks.join(above, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("block") == F.col("_rank")))
            .drop("_grp", "_rank"))


def _paths_below(blocks: DataFrame, paths: DataFrame, block_levels: int) -> DataFrame:
    """grp, rank, path, subroot, root for each node of a layer."""
    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                tree = PersistentTree(row["leaf"], levels_of(row["total"], block_levels))
                n = len(row["leaf"])
                path = [[{"before": x, "after": y} for x, y in tree.siblings(i)] + row["path"]
                        for i in range(n)]
                first = row["block"] * FANOUT ** block_levels
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["grp"]] * n, b.schema.field("grp").type),
                     pa.array(range(first, first + n), pa.int64()),
                     pa.array(path, b.schema.field("path").type),
                     pa.array([row["subroot"]] * n, pa.binary()),
                     pa.array([row["root"]] * n, pa.binary())],
                    names=["grp", "rank", "path", "subroot", "root"])

    grp = blocks.schema["grp"].dataType.simpleString()
    return (_with_paths(blocks.select("grp", "block", "total", "leaf"), paths)
            .mapInArrow(below, f"grp {grp}, rank long, path {PATH}, subroot binary, root binary"))


def _verified(blocks: DataFrame, paths: DataFrame, block_levels: int) -> DataFrame:
    """The manifest row of every leaf, with what its version folds to."""
    schema = blocks.schema["id"].dataType.elementType.simpleString()
    grp = blocks.schema["grp"].dataType.simpleString()

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(n)[i].as_py() for n in b.schema.names}
                tree = PersistentTree(row["leaf"], levels_of(row["total"], block_levels))
                above = [(p["before"], p["after"]) for p in row["path"]]
                rest = b"".join(x + y for x, y in above)
                untouched = climb(tree.digests[tree.version], above)
                root, n, proofs, folded = row["root"], len(row["leaf"]), [], []
                for at, changed in enumerate(row["changed"]):
                    proof = hashlib.sha256(b"".join(x + y for x, y in tree.siblings(at)))
                    proof.update(rest)
                    proofs.append(proof.hexdigest())
                    if changed is None:
                        folded.append(untouched)
                    else:
                        version = tree.changed(at, changed)
                        folded.append(climb(tree.digests[version], above))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(i, 1).flatten(),
                     pa.array([row["grp"]] * n, b.schema.field("grp").type),
                     pa.array([d.hex() for d in row["leaf"]]),
                     pa.array([row["subroot"].hex()] * n), pa.array([root.hex()] * n),
                     pa.array(proofs), pa.array([d.hex() for d in folded]),
                     pa.array([d == root for d in folded])],
                    names=["doc_id", "grp", "leaf", "subroot", "root", "proof_sha256",
                           "folded_root", "verified"])

    return _with_paths(blocks, paths).mapInArrow(
        leaves, f"doc_id {schema}, grp {grp}, leaf string, subroot string, root string, "
                "proof_sha256 string, folded_root string, verified boolean")


def manifest(docs: DataFrame, *, doc_id: str = "doc_id", group: str = "lang",
             fields: Sequence[str] = FIELDS, tamper: Callable[[dict], dict | None] = lower_text,
             block_levels: int = BLOCK_LEVELS, partitions: int | None = None) -> DataFrame:
    """doc_id, the group column, leaf, subroot, root, proof_sha256 (of all
    siblings up to the root), folded_root and verified, for every row.

    ``tamper`` gets a row's fields as bytes by name and returns them altered, or
    None; ``folded_root`` is the root of the version that the altered leaf makes
    (else the root itself), ``verified`` whether it equals the root.

    Null fields count as ``-``; a null id comes first in its group and the null
    group first of all; rows with equal ids are ordered by their digests, so
    that repeated rows are leaves of their own with one defined tree. A lone
    leaf is its group's subroot. An empty table gives no rows; other columns are
    ignored.
    """
    # The place splits what repeats a thousand times over range partitions.
    found = frozen(_leaves(docs, fields, doc_id, group, tamper)
                   .withColumn("_place", F.monotonically_increasing_id()))
    layers, subroots = _layers(
        ranked(found, "grp", ["id", "leaf", "_place"], partitions), block_levels)
    # The subroots are the leaves of one more tree, under a single group.
    tops = ranked(subroots.select(F.lit(0).alias("one"), "grp", "leaf"), "one", ["grp"], partitions)
    tops = frozen(tops.select(F.col("one").alias("grp"), "rank", "total", F.col("grp").alias("id"),
                              "leaf", F.lit(None).cast("binary").alias("changed")))
    upper, roots = _layers(tops, block_levels)
    paths = roots.select("grp", F.lit(0).cast("long").alias("rank"),
                         F.array().cast(PATH).alias("path"), F.col("leaf").alias("subroot"),
                         F.col("leaf").alias("root"))
    for blocks in reversed(upper):
        paths = frozen(_paths_below(blocks, paths, block_levels))
    paths = (paths.join(tops.select("rank", "id", F.col("leaf").alias("_subroot")), "rank")
             .select(F.col("id").alias("grp"), F.lit(0).cast("long").alias("rank"), "path",
                     F.col("_subroot").alias("subroot"), "root"))
    for blocks in reversed(layers[1:]):
        paths = frozen(_paths_below(blocks, paths, block_levels))
    return _verified(layers[0], paths, block_levels).withColumnRenamed("grp", group)
