"""The trie against a dictionary of prefixes in plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from framelake.llm import prefix_trie
from tests.oracle import same

TURNS = "conv_id long, turn long, role string, text string, node long, `d` string"


def rows_of(seed):
    draw = random.Random(seed)
    rows = []
    for c in [*range(0, 90), 100, 119, 141, -3, -20, -25, 2**40 + 7]:
        if c in (20, 60):  # two bases that do not exist
            continue
        common = [("user", "hello there"), ("assistant", "hi"), ("user", "a  b\x0bc")]
        turns = common[: draw.randrange(4)] + [(draw.choice(["user", None, ""]), draw.choice(["x", "x y", "", None, "é z"])) for _ in range(draw.randrange(6))]
        if c in (41, 47):
            turns = [("user", f"t{k % 7}") for k in range(45)] + [("user", str(c))]
        turns = turns or [("user", "only")]
        for k, (role, text) in enumerate(turns):
            rows.append((c, None if k < 2 and c % 3 == 0 else k // (2 if c % 5 == 0 else 1), role, text, 1, "clash"))
    rows += [(None, 0, "user", "nobody", 1, "clash")]
    rows += [r for r in rows if r[0] == 33]
    rows += [(500 + k, 0, "user", "copied conversation", 1, "c") for k in range(60)] + [(500 + k, 1, "user", "end", 1, "c") for k in range(60)]
    draw.shuffle(rows)
    return rows


def by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            key = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()
            own[c].append(((turn is not None, turn or 0, key), (role or "", text or "")))
    own = {c: [x for _, x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(set)
    for n in members:
        if n:
            kids[n[:-1]].add(n)
    leaves, saved = defaultdict(int), defaultdict(int)
    for n, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            saved[n[:d]] += (len(m) - 1) * words
    ends = {n: hashlib.sha256(",".join(str(c) for c in sorted(m) if whole[c] == n).encode()).hexdigest() for n, m in members.items()}
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -(2**62), len(m), len(kids[n]), leaves[n], saved[n], ends[n]) for n, m in members.items())


@pytest.mark.parametrize(("seed", "chunk"), [(1, 8192), (2, 3)])
def test_against_a_dictionary(spark, seed, chunk):
    rows = rows_of(seed)
    found = prefix_trie.trie(spark.createDataFrame(rows, TURNS).repartition(5), chunk_ids=chunk)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for _, t in found.dtypes} == {"bigint", "string"}
    assert sorted(tuple(-(2**62) if x is None else x for x in r) for r in found.collect()) == by_hand(rows)


def test_few_rows(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "user", "x", 1, "")], TURNS)).count() == 0
    # Conversation 5 takes its heads from 0, which does not exist: it may have no turn at all.
    for c in range(1, 9):
        rows = [(c, None, None, None, 1, "")]
        assert sorted(tuple(-(2**62) if x is None else x for x in r) for r in prefix_trie.trie(spark.createDataFrame(rows, TURNS)).collect()) == by_hand(rows)


def test_long_texts_and_one_long_conversation(spark):
    rows = [(7, k, "user", "w " * (200_000 if k == 3 else 2), 1, "") for k in range(300)] + [(8, k, "user", "w " * 2, 1, "") for k in range(9)]
    assert sorted(tuple(-(2**62) if x is None else x for x in r) for r in prefix_trie.trie(spark.createDataFrame(rows, TURNS)).collect()) == by_hand(rows)


def test_sql_gives_the_same_rows(spark):
    same(spark, prefix_trie.op12_prefix_trie, prefix_trie.OP12_SQL, "/root/testdata/sf0.001")
