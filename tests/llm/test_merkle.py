import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quernel.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx string, grp string, digest string, part string, path string, place string"


def h(*values):
    return hashlib.sha256("".join(values).encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, lower=False):
    i, text, lang, source, n = row
    if lower and i is not None and zlib.crc32(str(i).encode()) % 5 == 0 and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return h(framed(i), framed(source), framed(lang), framed(n), framed(text))


def tree(digests):
    """Levels of digests, from the leaves to the root."""
    levels = [digests]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + 16]) for i in range(0, len(below), 16)])
    return levels


def climb(levels, at, low):
    """(siblings, folded digest) of the node ``at`` with the digest ``low`` in its place."""
    found = []
    for level in levels[:-1]:
        first = at // 16 * 16
        run = level[first : first + 16]
        found += run[: at - first] + run[at - first + 1 :]
        low = h(*run[: at - first], low, *run[at - first + 1 :])
        at //= 16
    return found, low


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[name] = tree([leaf_of(r) for r in groups[name]])
    over = tree([trees[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for at, row in enumerate(groups[name]):
            near, low = climb(trees[name], at, leaf_of(row, True))
            far, root = climb(over, k, low)
            out.append((row[0], leaf_of(row), trees[name][-1][0], over[-1][0], h(*near, *far), root, root == over[-1][0]))
    return sorted(out, key=repr)


def run(spark, rows, tmp_path):
    full = [(*row, *"abcdef") for row in rows]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)


def test_equals_brute_force(spark, tmp_path):
    rows = [(i, f"Text {i % 7} Übung", "en", "hot", i) for i in range(300)]
    rows += [(i, None if i % 3 else "", None, f"s{i % 19}", None) for i in range(1000, 1060)]
    rows += [(None, "A", "de", None, 1), (None, "A", "de", None, 1), (None, "B", "de", None, 1)]  # null group, null and repeated ids
    rows += [(7, "Again", "fr", "hot", 5), (7, "again", "fr", "hot", 5), (5, "X" * 100_000, "en", "long", 100_000), (15, "Y", "en", "zoë", 1), (-3, "Z", "en", "", 1)]
    rows += [(11, "same row", "en", "copies", 8)] * 40
    found = run(spark, rows, tmp_path)
    assert found == brute(rows)
    assert {r[-1] for r in found} == {True, False}


@pytest.mark.parametrize("count", [1, 16, 17, 257])
def test_one_group(spark, tmp_path, count):
    rows = [(i, f"Text {i}", "en", "one", 6) for i in range(count)]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_empty(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


def test_one_changed_leaf_is_found(spark):
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    leaf = F.sha2(F.col("doc_id").cast("string"), 256)
    claimed = F.when(F.col("doc_id") == 42, F.sha2(F.lit("other"), 256)).otherwise(leaf)
    found = merkle.verified(merkle.manifest(rows, leaf, claimed=claimed, fanout=4)).collect()
    assert [r.doc_id for r in found if not r.verified] == [42] and len(found) == 100
