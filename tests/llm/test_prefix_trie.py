"""The trie of conversation prefixes against a plain Python trie, over many task borders, and against SQL."""

import hashlib
import random
import re
import zlib

import pytest

from planwright.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, key int"


def plain(rows, rebuild=True):
    own = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            h = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own.setdefault(c, []).append(((t is not None, t), role, h, text))
    own = {c: [(x[1], x[3]) for x in sorted(t, key=lambda x: (x[0][0], x[0][1] or 0, x[1], x[2]))] for c, t in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        made[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members, ends, below = {}, {}, {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    for node in members:
        if node:
            below.setdefault(node[:-1], []).append(node)
    words = lambda node: len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
    out, sums = [], {}
    for node in sorted(members, key=len, reverse=True):
        kids = below.get(node, [])
        saved = (len(members[node]) - 1) * words(node) + sum(sums[k][0] for k in kids)
        leaves = sum(sums[k][1] for k in kids) if kids else 1
        sums[node] = (saved, leaves)
        ids = ",".join(map(str, sorted(ends.get(node, []))))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids), leaves, saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


def built(spark, rows, rebuild=True, partitions=1):
    data = spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return sorted(map(tuple, prefix_trie.prefix_trie(data, rebuild).collect()), key=repr)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def dialogues(seed, n, deep=0):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        path = [rnd.randrange(2 if k < 3 else 3) for k in range(rnd.randrange(1, 7))] if c % 3 else [0, 1, 0]  # a third are copies
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"say {x} " * (x + 1) + f"at {t}") for t, x in enumerate(path)]
    rows += [(n + 1, t, "user", f"deep {t}") for t in range(deep)] + [(n + 2, t, "user", f"deep {min(t, deep - 5)}") for t in range(deep)]
    return rows


@pytest.mark.parametrize("partitions", [1, 5, 40])
@pytest.mark.parametrize("rebuild", [True, False])
def test_against_a_plain_trie(spark, partitions, rebuild):
    rows = dialogues(partitions, 120, 60)
    assert built(spark, rows, rebuild, partitions) == plain(rows, rebuild)


def test_nulls_ties_repeats_and_turnless(spark):
    rows = [(1, None, "user", "a"), (1, 0, None, "b c"), (1, 0, None, "b c"), (2, 0, "user", None), (2, 0, "assistant", ""), (None, 0, "user", "lost"), (25, 0, "user", "x" * 100_000), (25, 1, "", " \t\n"),
            (-3, 0, "user", "below"), (27, 0, "user", "a"), (32, 5, "user", "a"), (39, 1, "user", "a")]
    assert built(spark, rows, True, 3) == plain(rows)
    assert built(spark, rows, False, 3) == plain(rows, False)
    turnless = [(c, 0, "user", "alone") for c in range(101, 140) if c % 20]  # no opening exists: those that take turns from it keep none
    got = built(spark, turnless, True, 3)
    assert got == plain(turnless) and any(r[1] == 0 and r[7] != prefix_trie.EMPTY for r in got)


def test_no_rows(spark):
    assert built(spark, []) == []


def test_long_lists_of_ends_travel_in_pieces(spark):
    rows = [(c, 0, "user", "same") for c in range(2 * prefix_trie.PIECE + 100)] + [(c, 1, "assistant", "more") for c in range(0, 300, 2)]
    assert built(spark, rows, False, 3) == plain(rows, False)
