import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from tallyloom.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Nodes by the definition."""
    own = {}
    for conv, turn, role, text in rows:
        own.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts, key=lambda t: t[0])] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + ts[h:])
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    out = {}

    def walk(node):
        saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves = 0 if node in kids else 1
        for k in kids.get(node, []):
            s, n = walk(k)
            saved, leaves = saved + s, leaves + n
        ends = ",".join(str(c) for c in sorted(c for c in members[node] if len(built[c]) == len(node)))
        out[node] = (min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids.get(node, [])), leaves, saved, sha256(ends.encode()).hexdigest())
        return saved, leaves

    if built:
        walk(())
    return sorted(out.values(), key=repr)


def found(spark, rows, **kw):
    given = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in tries.prefix_trie(tries.rebuilt(tries.conversation_rows(given)), **kw).collect()), key=repr)


def some(seed, convs, words, longest):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(convs * 2), convs):
        hot = rng.random() < 0.3
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, "user" if t % 2 else "assistant", "same" if hot else rng.choice(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_turns", [40, 100_000])
def test_trie_equals_plain_version(spark, shard_turns):
    rows = some(1, 120, ["a", "bé", "", "ccc"], 7)
    assert found(spark, rows, shard_turns=shard_turns) == plain(rows)


def test_long_conversations_go_on_in_further_matrices_and_boundaries_are_joined_without_a_broadcast(spark):
    rows = some(2, 40, ["a", "b"], 3 * tries.WIDTH)
    rows += [(c, t, "user", f"t{t}") for c in (500, 501, 502) for t in range(100 + c % 5)]
    assert found(spark, rows, shard_turns=60, broadcast_nodes=0) == plain(rows)


def test_many_equal_conversations_fall_into_several_shards(spark, monkeypatch):
    monkeypatch.setattr(tries, "ENDS", 3)
    rows = [(c, t, "user", "x" * t) for c in range(0, 1500, 5) for t in range(3)]
    assert found(spark, rows, shard_turns=100) == plain(rows)


def test_nulls_missing_groups_and_empty_tables(spark):
    rows = [(7, None, None, None), (7, 3, "user", None), (7, 1, None, "x"), (11, 0, "", ""), (8, 5, "user", "y"), (-3, 0, "user", "z")]
    assert found(spark, rows + [(None, 1, "user", "left out")]) == plain(rows)
    one = [(c, 0, "user", "t") for c in range(1, 40, 5)]
    assert found(spark, one) == plain(one)  # conversations whose only turn is replaced by none have no turns
    assert found(spark, []) == []


def test_other_columns_do_not_clash(spark):
    rows = [(1, 0, "user", "a"), (5, 0, "user", "b"), (5, 1, "user", "c")]
    given = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", base int, `a.b` int, shard int")
    assert sorted((tuple(r) for r in tries.prefix_trie(tries.rebuilt(tries.conversation_rows(given))).collect()), key=repr) == plain(rows)


def test_shard_nodes_by_hand():
    paths = np.array([1, 1, 1, 1, 2, 2, 3, 3], dtype=np.int64)
    shard = tries._Shard(np.array([4, 9, 2]), paths, np.array([0, 2, 6, 8]), np.array([10, 10, 5, 7], dtype=np.int32))
    assert shard.count.tolist() == [3, 2, 1, 1] and shard.least.tolist() == [2, 4, 2, 9]
    assert shard.parent.tolist() == [-1, 0, 0, 1] and shard.chain(1) == [0, 1, 3]
