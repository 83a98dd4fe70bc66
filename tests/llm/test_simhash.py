"""Fingerprints, ball hashing and components against plain versions."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from orelode.llm import simhash
from orelode.llm.components import components
from orelode.llm.runtime import written


def plain_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs, nodes):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in nodes}


def test_fingerprints():
    rng = random.Random(5)
    for text in ["", " \n", "One", "one two  three", "É É É é a B\x0bc\x85d\xa0e", *(" ".join(rng.choices(["a", "The", "éX", "q r"], k=n)) for n in range(60))]:
        assert simhash.fingerprint(text, 4) % 2**64 == plain_fingerprint(text)


@pytest.mark.parametrize("bits", [64, 58])
@pytest.mark.parametrize("at_once", [2_000_000, 3_000])
def test_collisions(bits, at_once):
    rng = random.Random(bits)
    base = [rng.getrandbits(bits) for _ in range(8)]
    fp = list({b ^ sum(1 << i for i in rng.sample(range(bits), rng.randrange(7))) for b in base for _ in range(12)})
    links = {(a, b) for a in range(len(fp)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 4}
    arr = np.array(fp, np.uint64)
    got = [(int(a), int(b)) for x, y in simhash.collisions(arr, np.full(len(fp), 2), bits, at_once) for a, b in zip(x, y, strict=True)]
    assert all((max(p), min(p)) in links for p in got)
    assert plain_components(got, range(len(fp))) == plain_components(links, range(len(fp)))


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 20_000)
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for d in range(30):
        words = rng.choices(vocabulary, k=rng.randrange(1, 400))
        for c in range(rng.randrange(1, 6)):
            own = list(words)
            for _ in range(c // 2):
                own[rng.randrange(len(own))] = "changed"
            rows.append((len(rows), " ".join(own), "x"))
    rows += [(len(rows), "", "x"), (len(rows) + 1, None, "x"), (7, rows[7][1], "again"), (None, rows[3][1], "x"), (None, "alone here", "y")]
    rng.shuffle(rows)
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    groups = plain_components(links, range(len(rows)))
    low = {}
    for i, (d, _, _) in enumerate(rows):
        low[groups[i]] = min((x for x in (low.get(groups[i]), d) if x is not None), default=None)
    want = [(d, prints[i], low[groups[i]]) for i, (d, _, _) in enumerate(rows)]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in out), key=key) == sorted(want, key=key)
    assert len(links) > 40
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components(spark):
    rng = random.Random(9)
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1001 + i) for i in range(500)]
    ring = [(5000 + i, 5000 + (i * 7 + 3) % 40) for i in range(40)]
    pairs = chain + star + ring + [(9, 9), (None, 3), (4, None), (60, 61), (60, 61)]
    rng.shuffle(pairs)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()}
    real = [(a, b) for a, b in pairs if a is not None and b is not None and a != b]
    assert got == plain_components(real, {x for p in real for x in p})
    words = [(f"u{a}", f"u{b}") for a, b in real]
    got = {r.node: r.component for r in components(spark.createDataFrame(words, "a string, b string").repartition(3)).collect()}
    assert got == plain_components(words, {x for p in words for x in p})
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_similar_texts(spark, monkeypatch):
    """Pairs of 0.8 and more over five-word shingles against all pairs: near copies of all degrees, hot groups, odd texts."""
    monkeypatch.setattr(simhash, "SHORT_CELL", 100_000)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = []
    for d in range(120):
        words = rng.choices(vocabulary, k=rng.randrange(20, 500))
        for c in range(rng.randrange(1, 5)):
            own = list(words)
            for _ in range(rng.randrange(1 + len(own) // 40)):
                own[rng.randrange(len(own))] = "changed"
            texts.append(" ".join(own))
    base = rng.choices(vocabulary, k=200)
    for i in range(150):  # a large group of near copies
        own = list(base)
        own[rng.randrange(200)] = f"new{i}"
        texts.append(" ".join(own))
    texts += [texts[-1]] * 100 + ["", None, "  ", "one", "one", "ONE", "one two"]
    rows = [(i if i else None, t, "x") for i, t in enumerate(texts)]  # nulls come first
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").coalesce(1)
    sets = [frozenset(simhash.shingle_set(t or "", 5).tolist()) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if similarity(sets[a], sets[b]) >= 0.8]
    groups = plain_components(links, range(len(texts)))
    kept = {r.text or "" for r in simhash.similar_kept(docs).collect()}
    want = {texts[i] or "" for i, g in groups.items() if i == g}
    assert want <= kept and len(kept) <= len(want) * 1.02  # nothing goes that should stay; a few links may be missed
    assert sum(0.8 <= similarity(sets[a], sets[b]) < 0.9 for a, b in links) > 100
    again = simhash.similar_kept(docs)
    assert again.columns == docs.columns
    assert simhash.similar_kept(docs.limit(0)).collect() == []


def test_similar_pairs_found(spark):
    """Recall and precision of links between pairs of a planted similarity, each pair by itself."""
    rng = random.Random(4)
    texts, want = [], []
    for _ in range(300):
        n = rng.randrange(60, 300)
        a = [f"v{rng.randrange(10**6)}" for _ in range(n)]
        b = list(a)
        for at in rng.sample(range(n), max(1, round(n * rng.choice((0.005, 0.01, 0.02, 0.03))))):
            b[at] = "other"
        texts += [" ".join(a), " ".join(b)]
        x, y = (frozenset(simhash.shingle_set(t, 5).tolist()) for t in texts[-2:])
        if similarity(x, y) >= 0.8:
            want.append((len(texts) - 2, len(texts) - 1))
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    _, links = simhash.similar_links(docs, "row")
    got = {(r.a, r.b) for r in links.collect()}
    recall = len(got & set(want)) / len(want)
    print(f"recall {recall:.3f} of {len(want)} pairs")
    assert got <= set(want) and recall > 0.97


def items_of(texts, k=5):
    """What reaches a cell: all texts, with a prefix of no bits, so that each table is one cell."""
    rows = []
    for i, t in enumerate(texts):
        own = simhash.shingle_set(t, k)
        rows.append({"row": i, "class": i, "n": len(own), "marks": simhash.marks(own), **{f"s{j}": v for j, v in enumerate(simhash.sketch(own))}})
    names = ["row", "class", "n", "marks", *(f"s{j}" for j in range(simhash.WORDS))]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), *[pa.int64()] * simhash.WORDS]
    batch = pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in zip(names, kinds, strict=True)], names=names)
    made = pa.Table.from_batches(list(simhash.short_cells(iter([batch]), 0))).sort_by("cell")
    return made.combine_chunks().to_batches()


def pairs_of(items, nearest=False):
    return {(a, b) for r in simhash.colliding(iter(items), 0, nearest, 0.8) for a, b in zip(r.column("a").to_pylist(), r.column("b").to_pylist(), strict=True)}


@pytest.mark.parametrize("stranger", [0, 1, 2])
def test_strangers_between_lose_nothing(stranger):
    """Three rows of one fingerprint, two of them alike: the pair is found wherever the third lies."""
    alike, other = b"\x0f" * 64, b"\xf0" * 64
    told = [other if i == stranger else alike for i in range(3)]
    item = pa.RecordBatch.from_arrays([pa.array([0] * 3, pa.int64()), pa.array([77] * 3, pa.int64()), pa.array([0, 1, 2], pa.int64()), pa.array([2] * 3, pa.int32()), pa.array([0, 1, 2], pa.int64()), pa.array([100] * 3, pa.int32()), pa.array(told, pa.binary())], schema=simhash.ITEMS)
    assert pairs_of([item]) == {tuple(i for i in range(3) if i != stranger)}


@pytest.mark.parametrize(("families", "size"), [(20, 40), (4, 200), (1, 1200)])
def test_families_of_templates(families, size):
    """Planted pairs of 0.8 and more among texts that share most of a template: what collides in a table is found."""
    rng = random.Random(size)
    texts, want = [], []
    for _ in range(families):
        base = [f"t{rng.randrange(10**6)}" for _ in range(300)]
        for _ in range(size // 2):
            a = list(base)
            for at in rng.sample(range(300), 10):
                a[at] = f"v{rng.randrange(10**6)}"
            b = list(a)
            for at in rng.sample(range(300), 5):
                b[at] = f"v{rng.randrange(10**6)}"
            want.append((len(texts), len(texts) + 1))
            texts += [" ".join(a), " ".join(b)]
    sets = [simhash.shingle_set(t, 5) for t in texts]
    jaccard = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
    want = {p for p in want if jaccard(*p) >= 0.8}
    items = items_of(texts)
    collide = set()
    for batch in items:
        cells, fp, row = (batch.column(c).to_numpy() for c in ("cell", "fp", "row"))
        at = {(c, r): f for c, f, r in zip(cells.tolist(), fp.tolist(), row.tolist(), strict=True)}
        collide |= {(a, b) for a, b in want for c in set(cells.tolist()) if (c, a) in at and (c, b) in at and (at[c, a] ^ at[c, b]).bit_count() <= simhash.NEAR}
    fits = {(a, b) for a, b in collide if simhash.MARKS - sum((x ^ y).bit_count() for x, y in zip(simhash.marks(sets[a]), simhash.marks(sets[b]), strict=True)) >= simhash.LEAST}
    found = pairs_of(items) & want
    print(f"{families} families of {size}: {len(want)} pairs, {len(collide)} collide, {len(found)} found")
    assert found == fits and len(fits) >= 0.98 * len(collide) and len(found) >= 0.9 * len(want)


def test_the_least_key_stays(spark):
    """Whatever the order of rows and files."""
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[:at], "x", *base[at + 1 :]]) for at in range(0, 60, 3)] + ["alone here now"]
    for order in (1, -1):
        rows = list(enumerate(texts))[::order]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert {r.doc_id for r in simhash.similar_kept(docs.transform(written)).collect()} == {0, 20}


@pytest.mark.parametrize("changed", [6, 10])
def test_a_cell_hands_on_less_than_its_rows(changed):
    """Copies of one template, alike or just not: pairs grow with the square of the group, rows and links don't, and they join the same."""
    rng = random.Random(changed)
    base, texts = [f"t{i}" for i in range(400)], []
    for _ in range(160):
        own = list(base)
        for at in rng.sample(range(400), changed // 2):
            own[at] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    sets, items = [simhash.shingle_set(t, 5) for t in texts], items_of(texts)
    n = sum(b.num_rows for b in items)
    pairs = list(simhash.colliding(iter(items), 0, False, 0.8))
    met = list(simhash.meeting(iter(items), 0, 0.8))
    packed = [pa.RecordBatch.from_arrays([*b.columns, pa.array([sets[r].tobytes() for r in b.column("row").to_pylist()], pa.binary())], names=[*b.schema.names, "members"]) for b in met]
    links = [p for r in simhash.decided(iter(packed), 0, 0.8) for p in zip(r.column("a").to_pylist(), r.column("b").to_pylist(), strict=True)]
    members = [frozenset(s.tolist()) for s in sets]
    want = {p for r in pairs for p in zip(r.column("a").to_pylist(), r.column("b").to_pylist(), strict=True) if similarity(members[p[0]], members[p[1]]) >= 0.8}
    assert sum(r.num_rows for r in pairs) > n and sum(b.num_rows for b in met) <= n and len(links) < n
    assert all(similarity(members[a], members[b]) >= 0.8 for a, b in links)
    assert plain_components(links, range(len(texts))) == plain_components(want, range(len(texts)))


@pytest.mark.parametrize("of", ["collisions", "ball_pairs"])
def test_variants_are_sorted_in_bounded_memory(of):
    rng = np.random.default_rng(3)
    fp = np.unique(rng.integers(0, 1 << 40, 20_000, np.uint64))
    free = np.full(len(fp), 2)
    more = (np.arange(len(fp)),) if of == "ball_pairs" else ()
    tracemalloc.start()
    try:
        for _ in getattr(simhash, of)(fp, free, *more, 40):
            pass
        assert tracemalloc.get_traced_memory()[1] < 40 << 20
    finally:
        tracemalloc.stop()
