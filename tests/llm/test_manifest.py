import hashlib

import pytest
from pyspark.sql import functions as F

from pricelake.llm import manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        row = out[-1]
        out.append([sha("".join(row[i:i + 2])) for i in range(0, len(row), 2)])
    return out


def siblings(tree, index):
    """(side, digest) a level; no digest where the node is alone."""
    out = []
    for row in tree[:-1]:
        other = index ^ 1
        out.append(("l" if other < index else "r", row[other]) if other < len(row) else ("-", ""))
        index >>= 1
    return out


def brute(rows):
    """rows of (group, id, digest, claimed) -> sorted (id, leaf, subroot, root, proof, folded, verified)."""
    groups = {}
    for g, i, d, c in rows:
        groups.setdefault("-" if g is None else "=" + g, []).append((i is not None, i or 0, d, c, i))
    names = sorted(groups, key=str.encode)
    trees = {g: levels([r[2] for r in sorted(groups[g], key=lambda r: r[:3])]) for g in names}
    whole = levels([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for k, (_, _, d, c, i) in enumerate(sorted(groups[g], key=lambda r: r[:3])):
            path = siblings(trees[g], k) + siblings(whole, at)
            node = c or d
            for side, digest in path:
                node = sha(digest + node if side == "l" else node + digest)
            out.append((i, d, trees[g][-1][0], whole[-1][0], "".join(x for _, x in path), node, node == whole[-1][0]))
    return sorted(out, key=str)


def run(spark, rows, size):
    df = spark.createDataFrame(rows, "grp string, id long, digest string, claimed string")
    df = df.withColumn("tree", manifest.tree_key(F.col("grp"))).repartition(5)
    out = manifest.prove_all(df, size).collect()
    return sorted(((r.id, r.leaf, r.subroot, r.root, r.proof, r.folded_root, r.verified) for r in out), key=str)


@pytest.mark.parametrize("size", [1, 2, 10])
def test_like_brute_force(spark, size):
    """Trees over several tiers, a lone leaf, null group and ids, equal ids, false claims."""
    rows = [("big", i, sha(f"b{i}"), sha("no") if i % 7 == 0 else None) for i in range(45)]
    rows += [("é", i % 3, sha(f"e{i}"), None) for i in range(9)] + [("alone", 5, sha("x"), sha("x"))]
    rows += [(None, None, sha(f"n{i}"), None) for i in range(2)] + [("two", 1, sha("a"), None), ("two", 2, sha("b"), sha("c"))]
    got = run(spark, rows, size)
    assert got == brute(rows)
    assert {v for *_, v in got} == {True, False}


def test_equal_rows_have_proofs_of_their_own(spark):
    rows = [("g", 1, sha("same"), None)] * 5 + [("g", 2, sha("other"), None)]
    got = run(spark, rows, 1)
    assert got == brute(rows) and all(v for *_, v in got)


def test_empty_and_single(spark):
    assert run(spark, [], 2) == []
    ((_, leaf, sub, root, proof, folded, ok),) = run(spark, [(None, None, sha("z"), None)], 2)
    assert leaf == sub == root == folded and proof == "" and ok


def test_places_are_those_of_the_append_order():
    """Closed-form places against a plain postorder walk, for every tree up to 70 leaves."""
    for n in range(1, 71):
        leaves = [sha(str(i)) for i in range(n)]
        tree = levels(leaves)
        log = manifest.write_block(leaves, n, size=10)
        assert len(log) == sum(map(len, tree))
        for height, row in enumerate(tree):
            for index, digest in enumerate(row):
                assert log[manifest.place(n, height, index)] == digest
        full = [manifest.write_block(leaves[:m], m, size=10) for m in (n - 1,) if m]
        keep = 2 * (n - 1) - (n - 1).bit_count()
        assert not full or full[0][:keep] == log[:keep]  # an append leaves full nodes where they are


def test_leaf_fields(spark):
    row = spark.createDataFrame([(7, None, "é")], "a long, b string, c string").select(
        manifest.leaf_digest([F.col("a"), F.col("b"), F.col("c")]).alias("d")).first()
    assert row.d == sha("1:7" + "-" + "2:é")


def test_extra_columns_do_not_clash(spark):
    df = spark.createDataFrame([("=g", 1, sha("a"), None, 3, 4, "x")],
                               "tree string, id long, digest string, claimed string, idx int, n int, root string")
    assert manifest.prove_all(df, 2).count() == 1
