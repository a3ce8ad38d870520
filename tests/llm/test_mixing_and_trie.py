"""Source mixture and conversation trie against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from codelode.llm import prefix_trie
from codelode.llm.common import saved
from codelode.llm.mixing import Mixture, slot_schedule, source_targets

# --- 11 source mixture


def levels(sizes, weights=(1, 2, 3), limit=3):
    """Targets by sharing the excess again until no source is above its limit."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = Fraction(sum(sizes.values())), set()
    while True:
        rest = total - sum(limit * sizes[s] for s in capped)
        share = sum(weight[s] for s in order if s not in capped)
        target = {s: Fraction(limit * sizes[s]) if s in capped else rest * weight[s] / share for s in order}
        above = {s for s in order if target[s] > limit * sizes[s]}
        if not above:
            return target
        capped |= above


ROWS = "doc_id long, source string, text string, size string, target string, index string"


def mixed(spark, rows, **options):
    frame = saved(spark.createDataFrame([(i, s, t, "x", "y", "z") for i, s, t in rows], ROWS), "mix-test")
    mixture = Mixture(frame, **options)
    return mixture, mixture.documents().collect()


def source_rows(seed=4):
    rng = random.Random(seed)
    rows = [(1, "a", None), (2, "a", ""), (3, None, "of no source at all"), (None, "b", "no id"), (None, None, "neither"), (5, "empty", " \n"), (6, "ü", "one")]
    rows += [(10, "hot", "the same row again")] * 500  # equal rows, a third of all
    rows += [(100 + i, rng.choice(["a", "b", "hot", "hot", "Z"]), " ".join("w" for _ in range(rng.randrange(0, 40)))) for i in range(900)]
    rows.append((7, "b", "long " * 9000))
    return rows


@pytest.mark.parametrize("block", [1, 16, 1024])
def test_mixture_meets_its_targets(spark, block):
    rows = source_rows()
    _, got = mixed(spark, rows, block=block)
    sizes = Counter({s: 0 for _, s, _ in rows})
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    target = levels(sizes)
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, len((t or "").split())) for i, s, t in rows)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - float(target[r.source])) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - float(t)) <= 0.5 for s, t in target.items())


def test_slots_hold_every_block_once_and_stay_close_to_the_targets(spark):
    mixture, _ = mixed(spark, source_rows(9), block=8)
    spans = mixture.spans().collect()
    words = {r["index"]: r["words"] for r in mixture.targets.collect()}
    blocks = defaultdict(set)
    lengths = Counter()
    for r in spans:
        blocks[r["index"], r["rank"]].add(r["slot"])
        lengths[r["index"], r["rank"]] += r["length"]
    assert all(len(s) == 1 for s in blocks.values())
    assert len({s for x in blocks.values() for s in x}) == len(blocks)
    for (index, rank), n in lengths.items():
        assert n == min(8, words[index] - 8 * rank)
    slots = slot_schedule(mixture.targets, 8).collect()
    total, count = sum(words.values()), -(-sum(words.values()) // 8)
    for stop in range(50, count, 50):
        seen = Counter(r["index"] for r in slots if r["slot"] < stop)
        assert all(abs(seen[i] - stop * w / total) < 6 for i, w in words.items())


def test_reruns_and_other_partitions_agree(spark):
    rows = source_rows(5)
    first, again = (sorted(map(tuple, mixed(spark, x)[1]), key=repr) for x in (rows, rows[::-1]))
    assert first == again


def test_mixture_of_nothing(spark):
    assert mixed(spark, [])[1] == []
    assert [(r.taken, r.target) for r in mixed(spark, [(1, "a", None), (2, None, "")])[1]] == [(0, 0.0)] * 2


def test_targets_of_many_sources(spark):
    rng = random.Random(8)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 100, 10_000]) for i in range(40)} | {None: 7}
    units = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, size long, copies long")
    want = levels(sizes)
    for r in source_targets(units).collect():
        assert abs(r.target - float(want[r.source])) < 1e-6


# --- 12 conversation trie


def brute_trie(rows):
    """Nodes by the sets of conversations that begin with each sequence."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, tie, (role, text)))
    own = {c: [t[-1] for t in sorted(x)] for c, x in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - c % 20
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:]) if base != c else tuple(turns)
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, spared = Counter(), Counter()
    for node, convs in members.items():
        own_saving = (len(convs) - 1) * len(node[-1][1].split()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            spared[node[:d]] += own_saving
    return sorted(
        (
            (min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children[node], leaves[node], spared[node],
             hashlib.sha256(",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(node)).encode()).hexdigest())
            for node, convs in members.items()
        ), key=repr,
    )


TURNS = "conv_id long, turn long, role string, text string, depth string, words string, key string"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(spark, rows, **options):
    frame = saved(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURNS), "trie-test")
    return sorted((tuple(r) for r in prefix_trie.conversation_trie(frame, **options).select(*NODE).collect()), key=repr)


def talks(seed=3):
    rng = random.Random(seed)
    rows = [(None, 0, "user", "no conversation"), (500, None, None, None), (500, 1, "user", ""), (501, 1, "user", "a"), (501, 1, "user", "a"), (501, 1, "user", "b")]
    lines = [f"line {i} of a talk" for i in range(4)]
    for conv in range(0, 160):
        rows += [(conv, t, "user" if t % 2 == 0 else "assistant", rng.choice(lines)) for t in range(rng.randrange(1, 7))]
    rows += [(200 + c, t, "user", f"the same talk {t}") for c in range(100) for t in range(5)]  # copies
    rows += [(400, t, "user", f"long {t}") for t in range(700)] + [(420, t, "user", f"long {t}") for t in range(690)]
    rows += [(441, 5, "user", "own turns are all replaced"), (460, 0, "user", "x " * 20_000), (480, 0, "user", "x " * 20_000)]
    return rows


@pytest.mark.parametrize("turns", [7, 60, 50_000])
def test_trie_equals_brute_force(spark, turns):
    rows = talks()
    assert trie(spark, rows, range_turns=turns) == brute_trie(rows)


def test_trie_of_nothing_and_of_wide_nodes(spark):
    assert trie(spark, []) == [] and trie(spark, [(None, 1, "a", "b")]) == []
    rows = [(20 * c, 0, "user", f"first {c}") for c in range(600)]  # 600 children: layouts of 4, 16, 48 and 256
    assert trie(spark, rows) == brute_trie(rows)


def test_radix_tree_finds_its_keys():
    rng = random.Random(1)
    keys = sorted({bytes(rng.randrange(256) for _ in range(rng.randrange(0, 4))) for _ in range(4000)})
    root = prefix_trie.ArtNode(keys[0])
    root.end = 0
    for number in rng.sample(range(1, len(keys)), len(keys) - 1):
        prefix_trie.insert(root, keys[number], number)
    found, layouts, waiting = {}, Counter(), [(root, b"")]
    while waiting:
        node, lead = waiting.pop()
        layouts[node.layout] += 1
        if node.end >= 0:
            found[lead + node.path] = node.end
        for byte, child in node.ordered():
            assert node.find(byte) is child
            waiting.append((child, lead + node.path + bytes([byte])))
    assert found == {k: n for n, k in enumerate(keys)} and set(layouts) == {4, 16, 48, 256}
