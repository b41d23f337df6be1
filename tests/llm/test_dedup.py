import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from meshwork.llm import hamming, line_dedup, simhash, substring_dedup
from meshwork.llm.components import connected, forest
from tests.llm.cases import frame, texts


def groups_of(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: r for n, r in groups_of({x for e in edges for x in e}, edges).items() if n != r}
    assert got == want
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
    a, b = np.array(edges).T
    assert dict(zip(*(x.tolist() for x in forest(a, b)))) == want


def test_ring_keys_miss_no_link():
    rng = np.random.default_rng(0)
    for _ in range(4000):
        a = np.array([rng.integers(0, 2**64, dtype=np.uint64)])
        b = a.copy()
        flips = rng.choice(64, rng.integers(0, 6), replace=False)
        for k in flips:
            b ^= np.uint64(1 << int(k))
        a, b = a.view(np.int64), b.view(np.int64)
        met = any(x[0] == y[0] and simhash.ring_linked([a], [b], x)[0] for (x, _), (y, _) in zip(simhash.ring_keys(a), simhash.ring_keys(b)))
        assert met == (len(flips) <= 3)


@pytest.mark.parametrize("group, work", [(512, 10**8), (4, 10**8), (4, 0)])
def test_links_with_small_and_large_groups(spark, group, work, monkeypatch):
    """group 4 compares nearly all keys with pivots, and without work allowed sends them through the blocks."""
    monkeypatch.setattr(hamming, "WORK", work)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 6, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base[:4].tolist():
        for _ in range(25):
            fps.add(b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 4), replace=False)))
    fps = sorted(np.array(sorted(fps), np.uint64).view(np.int64).tolist())
    edges = hamming.links(spark.createDataFrame([(f,) for f in fps], "fp long"), simhash.ring_keys, simhash.ring_linked, "test", group)
    got = groups_of(fps, [(r.a, r.b) for r in edges.collect()])
    want = groups_of(fps, [(a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3])
    assert got == want


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark):
    rows = [(i, t) for i, t in texts() if i is not None]
    fp = {i: brute_fingerprint(t) for i, t in rows}
    want = groups_of(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    got = simhash.digest(simhash.near_duplicates(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{f:016x}", want[i]) for i, f in fp.items()}
    assert len({r for r in want.values()}) < len(fp)


def test_simhash_edges(spark):
    rows = texts()
    got = {r.fingerprint: r.component_id for r in simhash.digest(simhash.near_duplicates(frame(spark, rows))).where("doc_id is null").collect()}
    assert got[f"{brute_fingerprint(rows[3][1]):016x}"] == 3
    left = simhash.keep_first(frame(spark, rows)).collect()
    ids = [r.doc_id for r in left if r.doc_id is not None]
    assert set(range(40)) <= set(ids) and not set(range(40, 45)) & set(ids)
    assert simhash.near_duplicates(frame(spark, rows).where("false")).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(2))
        assert line_dedup.edit_distance(a, b) == levenshtein(a, b)


def plain_line(line):
    return " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)))


def brute_lines(rows):
    """Kept texts by edit distance between all pairs of lines that are compared, without sketches."""
    seen = [(i, k, line) for i, t in sorted(set(rows), key=str) for k, x in enumerate((t or "").split("\n")) if (line := plain_line(x))]
    seen.sort(key=lambda x: x[:2])
    distinct = sorted({x[2] for x in seen})
    far = [x for x in distinct if x.count(" ") >= 4 or len(x.encode()) >= 60]
    edges = [(a, b) for i, a in enumerate(far) for b in far[:i] if levenshtein(a, b) <= 0.2 * max(len(a), len(b))]
    group, first, gone = groups_of(distinct, edges), set(), defaultdict(set)
    for i, k, line in seen:
        if group[line] in first:
            gone[i].add(k)
        first.add(group[line])
    return {i: t if not t else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}, len(edges)


def test_lines_equal_brute_force(spark):
    rng = random.Random(6)
    pool = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(30)}" for _ in range(rng.randint(3, 40))) for _ in range(25)]
    pool += [" ".join(pool[k : k + 5]) for k in range(6)]
    pool += [x + " tail" for x in pool[-6:]] + [x.replace(" ", ", ").upper() for x in pool[:5]]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6)))) for k in range(40)] + [(50, ""), (51, None), (52, pool[3] + "\n" + pool[3])]
    want, links = brute_lines(rows)
    assert links > 0
    got = line_dedup.dedup_lines(frame(spark, rows), counts=True).collect()
    assert {r.doc_id: r.text for r in got} == want
    assert all(r.n_removed == ((dict(rows)[r.doc_id] or "").count("\n") - (r.text or "").count("\n") if r.text else r.n_lines) for r in got)


def changed(rng, line, vocabulary, kind, share):
    if kind == "words":
        words = line.split(" ")
        for k in rng.sample(range(len(words)), max(1, round(share * len(words)))):
            words[k] = rng.choice(vocabulary)
        return " ".join(words)
    signs = list(line)
    for k in rng.sample(range(len(signs)), max(1, round(share * len(signs)))):
        signs[k] = rng.choice("abcdefghijklmnop")
    return " ".join("".join(signs).split())


#: Share of alike pairs found, by kind and share of the edits, and by words: 5-10, 11-20, 21-40, 41-100, 101-300.
RECALL = {
    ("words", 0.05): (0.92, 0.95, 0.95, 0.95, 0.92),
    ("words", 0.1): (0.92, 0.92, 0.92, 0.92, 0.9),
    ("words", 0.15): (0.88, 0.82, 0.82, 0.84, 0.82),
    ("words", 0.2): (0.8, 0.76, 0.72, 0.72, 0.5),
    ("letters", 0.03): (0.92, 0.95, 0.95, 0.95, 0.9),
    ("letters", 0.06): (0.8, 0.74, 0.78, 0.78, 0.68),
    ("letters", 0.1): (0.3, 0.25, 0.25, 0.25, 0.1),
}


@pytest.mark.parametrize("edits", list(RECALL), ids=lambda e: f"{e[0]}-{e[1]}")
def test_changed_lines_are_found(spark, edits):
    """Recall against edit similarity alone, in each class of length; what is not alike stays."""
    rng = random.Random(str(edits))
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows, of, alike = [], {}, {}
    for c, words in enumerate(((5, 10), (11, 20), (21, 40), (41, 100), (101, 300))):
        for _ in range(80):
            a = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(*words)))
            b = changed(rng, a, vocabulary, *edits)
            k = len(rows)
            rows += [(k, a), (k + 1, b)]
            of[k + 1], alike[k + 1] = c, line_dedup.edit_distance(a, b) <= 0.2 * max(len(a), len(b))
    text = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    for c, least in enumerate(RECALL[edits]):
        pairs = [k for k, yes in alike.items() if yes and of[k] == c]
        assert sum(text[k] == "" for k in pairs) >= least * len(pairs), (c, sum(text[k] == "" for k in pairs), len(pairs))
    assert all(text[k] == t for k, t in rows if not alike.get(k))


def test_unrelated_lines_on_one_key_seldom_link():
    """Lines that share the three minima of a key and nothing else: links by chance joined most lines to one cluster."""
    rng = np.random.default_rng(8)
    n, size = 40_000, np.full(40_000, 200)
    a, b = (rng.integers(0, 1 << 16, (n, line_dedup.MINIMA), np.uint16) for _ in range(2))
    b[:, line_dedup.PLACES[0]] = a[:, line_dedup.PLACES[0]]
    none = np.zeros(n, np.int64)

    def side(keys, minima):
        sketch = [none, *minima.view(np.int64).T]
        return next(keys(np.arange(n), size, *sketch, *sketch))

    for keys, most in ((line_dedup.minima_keys, 0.06), (line_dedup.full_keys, 0.004)):
        (key, _, *x), (same, _, *y) = (side(keys, m) for m in (a, b))
        assert (key == same).all()
        assert line_dedup.near(x, x, key).all()
        assert line_dedup.near(x, y, key).mean() < most


def test_distances_of_many_pairs_are_exact():
    rng = random.Random(9)
    a, b = [], []
    for _ in range(2000):
        x = [rng.choice("abcdé 日") for _ in range(rng.randint(1, rng.choice((3, 63, 64, 65, 130))))]
        a.append("".join(x))
        for _ in range(rng.randint(0, len(x) // 3 + 1)):
            at = rng.randrange(len(x))
            x[at : at + rng.randrange(2)] = rng.choice(("", "x", "yz"))
            x = x or ["q"]
        b.append("".join(x))
    want = [levenshtein(x, y) for x, y in zip(a[:400], b[:400])] + [line_dedup.edit_distance(x, y) for x, y in zip(a[400:], b[400:])]
    kept = [k for k, y in enumerate(b) if y]
    got = line_dedup.edit_distances([a[k] for k in kept], [b[k] for k in kept])
    assert got.tolist() == [want[k] for k in kept]
    assert line_dedup.alike(a, b, 0.7).tolist() == [d <= int(0.3 * max(len(x), len(y)) + 1e-9) for x, y, d in zip(a, b, want)]


def pairs_of_many_lengths(rng, count):
    """Pairs of texts, the shorter one first: alike ones, shifted ones and unrelated ones."""
    out = []
    for _ in range(count):
        x = [rng.choice("abcdé 日") for _ in range(rng.randint(1, rng.choice((3, 63, 64, 65, 130, 400))))]
        y = list(x) if rng.random() < 0.8 else [rng.choice("abcdé 日") for _ in range(max(1, len(x) + rng.randint(-9, 9)))]
        for _ in range(rng.randint(0, len(y) // 3 + 1)):
            at = rng.randrange(len(y))
            y[at : at + rng.randrange(2)] = rng.choice(("", "x", "yz", "abcdefghijkl"))
            y = y or ["q"]
        out.append(sorted(("".join(x), "".join(y)), key=len))
    return out


def test_bounded_distances_are_exact():
    """On few diagonals, in blocks and on all diagonals that matter, at bounds about the distance too."""
    rng = random.Random(10)
    pairs = pairs_of_many_lengths(rng, 1500)
    a, b = map(list, zip(*pairs))
    far = np.array([line_dedup.edit_distance(x, y) for x, y in pairs])
    most = np.array([max(len(y) - len(x), rng.choice((0, 1, len(y) // 5, d - 1, d, d + 1))) for (x, y), d in zip(pairs, far.tolist())])
    want = (far <= most).tolist()
    assert [line_dedup.banded(x, y, k) for x, y, k in zip(a, b, most.tolist())] == want
    assert line_dedup.all_banded(a, b, most).tolist() == want
    told = line_dedup.Pairs(a, b, most)
    assert told.within(a, b).tolist() == want
    some = np.flatnonzero(told.more < 60)
    assert (told.narrow(some) >= np.minimum(far, most + 1)[some]).all()
    some = np.flatnonzero((told.m >= 64) & (far <= most))
    assert len(some) > 50 and (told.apart(some) <= far[some]).all()


def test_most_pairs_need_no_whole_table(monkeypatch):
    """Near ones show it on 64 diagonals, unrelated ones in blocks."""
    rng = random.Random(11)
    lines = ["".join(rng.choice("abcdefghijklm ") for _ in range(rng.randint(400, 900))) for _ in range(120)]
    near = [x[:100] + "xyz" + x[103:350] + x[352:] for x in lines]
    looked = []
    monkeypatch.setattr(line_dedup, "all_banded", lambda a, b, most: looked.extend(a) or np.zeros(len(a), bool))
    monkeypatch.setattr(line_dedup, "banded", lambda a, b, most: looked.append(a) or False)
    assert line_dedup.alike(lines, near, 0.8).all()
    assert not line_dedup.alike(lines, [x[: len(y)] + "a" * (len(y) - len(x)) for x, y in zip(lines[1:] + lines[:1], lines)], 0.8).any()
    assert not looked


def test_runs_of_clusters_reach_over_batches(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    root, h = np.sort(rng.integers(0, 300, 1000)), rng.integers(0, 3, 1000)
    none = np.zeros(1000, np.int64)
    rows = pa.table({"root": root, "i": none, "j": none, "h": h, "norm": [f"{a} {b}" for a, b in zip(root, h)]})
    for at_once, size in ((5, 1), (5, 7), (100, 64), (8192, 2000)):
        monkeypatch.setattr(line_dedup, "ROWS_AT_ONCE", at_once)
        got = list(line_dedup.clusters_of(iter(rows.to_batches(max_chunksize=size))))
        assert len(got) == len(set(root))
        assert sorted(x for r in got for x in r["norm"]) == sorted(set(rows["norm"].to_pylist()))
        assert all(x == f"{a} {b}" for r in got for a, b, x in zip(r["root"], r["h"], r["norm"]))
    assert not list(line_dedup.clusters_of(iter([])))


def test_clusters_of_far_pairs_are_looked_at_to_the_end(monkeypatch):
    """Chains of candidates of which only some are alike: the groups are those of all alike pairs."""
    monkeypatch.setattr(line_dedup, "ROUND", 3)
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh") for _ in range(40)) for _ in range(3)]
    lines = [x[:k] + "xyz" + x[k + 3 :] for x in base for k in range(0, 36, 6)]
    pairs = np.array([(i, j) for i in range(len(lines)) for j in range(i)])
    rng.shuffle(lines)
    held = [line_dedup.Cluster(np.arange(100, 100 + len(lines)), lines, pairs, True)]
    line_dedup.verify(held, 0.8)
    node, root = held[0].forest()
    found = groups_of(range(len(lines)), [(a - 100, b - 100) for a, b in zip(node.tolist(), root.tolist())])
    want = groups_of(range(len(lines)), [(i, j) for i, j in pairs.tolist() if levenshtein(lines[i], lines[j]) <= 8])
    assert len(set(want.values())) == 3
    assert {frozenset(k for k in found if found[k] == g) for g in found.values()} == {frozenset(k for k in want if want[k] == g) for g in want.values()}


def test_large_clusters_go_by_blocks(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"w{rng.randrange(900)}" for _ in range(40)]
    rows = [(k, " ".join(base[:j] + [f"v{k}"] + base[j + 1 :])) for k, j in ((k, k % 40) for k in range(150))]
    rows += [(500 + k, " ".join(rng.choice(base) for _ in range(40))) for k in range(20)]
    monkeypatch.setattr(line_dedup, "BLOCK", 20)
    text = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert sorted(k for k, t in text.items() if t) == [0, *range(500, 520)]


@pytest.mark.parametrize("block", [1024, 20])
def test_largest_clusters_go_by_keys(spark, monkeypatch, block):
    """No line is dealt out to all blocks of its cluster; the groups are those that brute force gives."""
    rng = random.Random(9)
    groups = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(60)}" for _ in range(30)) for _ in range(4)]
    lines = [(g, re.sub(r"\w+$", f"end{k}", x, count=1)) for g, x in enumerate(groups) for k in range(60)]
    rng.shuffle(lines)
    rows = [(k, line) for k, (_, line) in enumerate(lines)]
    monkeypatch.setattr(line_dedup, "BLOCKS", 0)
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    whole = []
    monkeypatch.setattr(line_dedup, "verified_by_keys", lambda far, least, was=line_dedup.verified_by_keys: whole.append(far.count()) or was(far, least))
    first = {}
    for k, (g, _) in enumerate(lines):
        first.setdefault(g, k)
    text = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert whole == [240] and text == {k: line if first[lines[k][0]] == k else "" for k, line in rows}


def test_short_and_unsegmented_lines(spark):
    east = "".join(chr(0x4E00 + k * k % 3000) for k in range(40))
    rows = [(1, "Menu\nRead more\nx y z w\n--"), (2, "menu!\nRead less\nread more\nX, y z w\n--"), (3, east), (4, east[:20] + "\u4e8c" + east[21:]), (5, east[::-1])]
    text = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert text == {1: rows[0][1], 2: "Read less\n--", 3: east, 4: "", 5: east[::-1]}


def test_lines_edges(spark):
    rows = texts() + [(None, "one two three four five six"), (900, "one two three four five six"), (901, "one two three four five six")]
    got = line_dedup.dedup_lines(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted(r.text for r in got if r.doc_id in (900, 901)) == ["", "one two three four five six"]
    assert [r.text for r in got if r.doc_id is None and r.text and r.text.startswith("one")] == ["one two three four five six"]
    assert line_dedup.digest(line_dedup.dedup_lines(frame(spark, rows).where("false"), counts=True)).count() == 0


def brute_spans(rows):
    n, first = substring_dedup.LENGTH, {}
    for i, t in sorted(rows):
        for k in range(len(t) - n + 1):
            first.setdefault(t[k : k + n], i)
    out = []
    for i, t in rows:
        goes = bytearray(len(t))
        for k in range(len(t) - n + 1):
            if first[t[k : k + n]] < i:
                goes[k : k + n] = b"\1" * n
        kept = bytes(c for c, g in zip(t, goes) if not g)
        out.append((i, len(t), sum(goes), sum(1 for k, g in enumerate(goes) if g and not (k and goes[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_substrings_equal_brute_force(spark):
    rng = random.Random(5)
    pool = ["".join(rng.choice("ab c") for _ in range(rng.randint(40, 140))) for _ in range(6)]
    rows = []
    for i in range(100):
        t = ""
        for _ in range(rng.randint(0, 5)):
            t += rng.choice([rng.choice(pool), "".join(rng.choice("ab \0é") for _ in range(rng.randint(0, 80))), "z" * rng.randint(0, 120), "ab" * rng.randint(0, 60)])
            if t and rng.random() < 0.3:
                k = rng.randrange(len(t))
                t = t[:k] + "#" + t[k + 1 :]
        rows.append((i, t))
    rows += [(200, rows[3][1]), (300, ""), (301, "x"), (302, "q" * 30_000), (303, "q" * 49), (304, "q" * 50)]
    got = sorted(tuple(r) for r in substring_dedup.digest(substring_dedup.remove_repeats(frame(spark, rows))).collect())
    assert got == brute_spans([(i, t.encode()) for i, t in rows])


def test_substrings_edges(spark):
    long = "w" * 20 + "".join(random.Random(1).choice("abcdefgh") for _ in range(80))
    rows = [(1, long), (2, long), (2, long), (None, long), (3, None), (4, "")]
    got = {(r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == {(1, 0), (2, 100), (None, 0), (3, 0), (4, 0)}
    assert substring_dedup.digest(substring_dedup.remove_repeats(frame(spark, rows).where("false"))).count() == 0
    second = [(1, long), (2, long + "!"), (2, "another text of the same id " * 3)]
    assert sum(r.n_removed for r in substring_dedup.remove_repeats(frame(spark, second)).collect()) in (0, 100)


def test_suffix_order_is_the_sorted_order():
    rng = np.random.default_rng(4)
    for _ in range(30):
        strings = ["".join(rng.choice(list("ab"), rng.integers(1, 80))) for _ in range(12)]
        symbols = np.concatenate([np.append(np.frombuffer(s.encode(), np.uint8).astype(np.uint16) + 1, 0) for s in strings]).astype(np.uint16)
        bucket = np.repeat(np.arange(12) // 5, [len(s) + 1 for s in strings]).astype(np.uint16)
        suffix = {}
        at = 0
        for s in strings:
            for k in range(len(s) + 1):
                suffix[at + k] = s[k:]
            at += len(s) + 1
        want = sorted(range(len(symbols)), key=lambda p: (bucket[p], suffix[p], p))
        assert substring_dedup.suffix_order(symbols, bucket).tolist() == want


def test_rows_counted(spark):
    df = frame(spark, texts())
    assert substring_dedup.remove_repeats(df).count() == df.count() == simhash.near_duplicates(df).count()
    assert df.where(F.col("doc_id").isNull()).count() == 2
