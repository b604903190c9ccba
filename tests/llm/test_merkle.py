"""The manifest against a plain recursive tree, and the persistent tree itself."""

import hashlib
import random
import zlib

import pytest

from tidemark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, LEAF string, grp int"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h("".join(field(v) for v in (doc_id, source, lang, n_chars, text)))


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def fold(digests, at=None):
    """The tree's end, and the siblings met from place ``at`` up, in order."""
    met = []
    while len(digests) > 1:
        runs = [digests[i:i + 8] for i in range(0, len(digests), 8)]
        if at is not None:
            met += [d for i, d in enumerate(runs[at // 8]) if i != at % 8]
            at //= 8
        digests = [h("".join(r)) for r in runs]
    return digests[0], met


def expected(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {g: sorted(([r[0] is not None, r[0] or 0, leaf(*r[:5]), r] for r in rows if r[2] == g),
                        key=lambda x: x[:3]) for g in langs}
    subroots = [fold([x[2] for x in groups[g]])[0] for g in langs]
    root, out = fold(subroots)[0], []
    for place, g in enumerate(langs):
        digests = [x[2] for x in groups[g]]
        for at, (_, _, own, r) in enumerate(groups[g]):
            proof = fold(digests, at)[1] + fold(subroots, place)[1]
            other = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                other = leaf(r[0], lowered(r[1]), *r[2:5])
            sub = fold(digests[:at] + [other] + digests[at + 1:])[0]
            folded = fold(subroots[:place] + [sub] + subroots[place + 1:])[0]
            out.append((r[0], r[2], own, subroots[place], root, h("".join(proof)), folded,
                        folded == root))
    return out


def world(n, langs, seed):
    rng = random.Random(seed)
    rows = [(i if i % 37 else None, rng.choice(["Ab", "é Z", "", None, "low", "x" * 70_000 + "Q"]),
             rng.choice(langs), rng.choice(["s", None]), rng.choice([3, None])) for i in range(n)]
    return [r + (1, "x", 2) for r in rows + rows[:9] * 3]


@pytest.mark.parametrize("n, langs, levels", [(200, ["a", "b", None, "é", "zz", ""], 1),
                                              (70, [None], 2), (65, ["a"], 1), (9, ["a", "b"], 3)])
def test_manifest_equals_a_plain_tree(spark, n, langs, levels):
    rows = world(n, langs, n)
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), block_levels=levels, partitions=5)
    assert got.columns == ["doc_id", "lang", "leaf", "subroot", "root", "proof_sha256",
                           "folded_root", "verified"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected(rows)))


def test_many_groups_and_lone_leaves(spark):
    rows = [(i, "Text", f"lang{i}", "s", 1, 0, "", 0) for i in range(75)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), block_levels=1)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected(rows)))


def test_one_leaf_and_no_leaf(spark):
    one = spark.createDataFrame([(None, None, None, None, None, 1, "", 2)], SCHEMA)
    row, = merkle.manifest(one).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root == h("-----")
    assert row.proof_sha256 == h("") and row.verified
    assert merkle.manifest(one.limit(0)).count() == 0


def test_a_version_shares_all_but_its_path():
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(100)]
    tree = merkle.PersistentTree(digests, 3)
    before = list(tree.digests)
    version = tree.changed(77, b"\0" * 32)
    assert tree.digests[:len(before)] == before            # nothing is overwritten
    assert len(tree.digests) == len(before) + 4            # a leaf and three ancestors
    old, new = tree.path(77), tree.path(77, version)
    for (a, slot), (b, _) in zip(old, new):
        kept = [i for i in range(len(tree.children[a])) if i != slot]
        assert all(tree.children[a][i] == tree.children[b][i] for i in kept)
    # A second change on top of the first holds both.
    both = tree.changed(3, b"\1" * 32, version)
    plain = merkle.PersistentTree(digests[:3] + [b"\1" * 32] + digests[4:77] + [b"\0" * 32] + digests[78:], 3)
    assert tree.digests[both] == plain.digests[plain.version]
