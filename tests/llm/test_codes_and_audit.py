"""Fingerprint trie, vector codes and source audit against plain versions."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from assetlake.llm import simhash_trie, source_audit, vector_codes

from .conftest import CLASHING, DOCS, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    words = (text or "").translate(LOWER).encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """For each number the least index reachable over at most three differing bits."""
    prints = np.array(prints, np.uint64)
    root = np.arange(len(prints))
    for i, x in enumerate(prints):
        near = root[np.flatnonzero(np.bitwise_count(prints ^ x) <= 3)]
        root[np.isin(root, near)] = min(near.min(), root[i])
    return root.tolist()


def linked(docs):
    prints = [fingerprint(t) for _, t in docs]
    least = {}
    for root, (d, _) in zip(components(prints), docs, strict=True):
        if d is not None:
            least[root] = min(d, least.get(root, d))
    return Counter((d, f"{p:016x}", least.get(r)) for (d, _), p, r in zip(docs, prints, components(prints), strict=True))


@pytest.mark.parametrize("leaf", [10_000, 4])
def test_documents_near_by_fingerprint(spark, odd, leaf):
    docs = [(d, t) for d, t, *_ in rows()]
    assert Counter(map(tuple, simhash_trie.link_by_fingerprint(odd, leaf=leaf).collect())) == linked(docs)


def test_fingerprints_of_no_documents(none):
    assert simhash_trie.link_by_fingerprint(none).count() == 0


def test_fingerprint_of_a_text_in_pieces(monkeypatch):
    texts = [" ".join(f"w{i * i % 31}" for i in range(n)) for n in (0, 1, 2, 3, 4, 50, 900)] + ["x" * 500, " \n" * 40 + "A b" + " " * 90]
    whole = [fingerprint(t) for t in texts]
    for segment, hashes in ((1 << 20, 1 << 18), (7, 3), (64, 1)):
        monkeypatch.setattr(simhash_trie, "SEGMENT", segment)
        monkeypatch.setattr(simhash_trie, "HASHES", hashes)
        assert simhash_trie.fingerprints([t.encode() for t in texts]).view(np.uint64).tolist() == whole


def ball(rnd, centers, count, flips):
    """Distinct numbers: dense groups around some, many alone."""
    near = [c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, flips))) for c in centers for _ in range(count)]
    return sorted({*centers, *near, *(rnd.getrandbits(64) for _ in range(count))})


@pytest.mark.parametrize("chunk", [200_000, 7])
def test_trie_walk_links_what_brute_force_links(monkeypatch, chunk):
    monkeypatch.setattr(simhash_trie, "CHUNK", chunk)
    rnd = random.Random(4)
    points = ball(rnd, [0, (1 << 64) - 1, rnd.getrandbits(64)], 150, 5)
    x = np.array(points, np.uint64)
    roots = [simhash_trie.walk(x, None, 0, 3)]
    turned = simhash_trie.turned(x)
    order = np.argsort(turned)
    other = simhash_trie.walk(turned[order], None, 0, 3)
    root = simhash_trie.merged(roots[0], order, order[other])
    assert root.tolist() == components(points)
    # Two different nodes of the same depth, too.
    cut = 1 << 63
    a, b = x[x < cut], x[x >= cut]
    cross = simhash_trie.walk(a, b, 1, 3)
    assert all(int(a[i] ^ b[j - len(a)]).bit_count() < 64 for j, i in enumerate(cross) if j >= len(a) > i)
    inside = simhash_trie.merged(simhash_trie.walk(a, None, 1, 3).copy(), np.zeros(0, int), np.zeros(0, int))
    both = simhash_trie.merged(np.concatenate([inside, len(a) + simhash_trie.walk(b, None, 1, 3)]), np.arange(len(x)), cross)
    both = simhash_trie.merged(both, order, order[other])
    assert both.tolist() == components(points)


def test_trie_rounds_over_tables(spark):
    rnd = random.Random(5)
    points = ball(rnd, [7, rnd.getrandbits(63)], 150, 4)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    frame = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    at = {p: n for n, p in enumerate(signed)}
    links = simhash_trie.near_links(frame, leaf=30).collect()
    a, b = (np.array([at[r[k]] for r in links], int) for k in (0, 1))
    assert simhash_trie.merged(np.arange(len(points)), a, b).tolist() == components(points)


def coded(vectors, parts=16, entries=64, rounds=2):
    vectors = sorted(vectors, key=lambda r: (r[0] is None, r[0] or 0, r[1] if r[1] and None not in r[1] else []))
    kept = [
        (i, [math.floor(256 * x) if abs(x) < 2**53 else int(x) * 256 for x in v], label)
        for i, v, label in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    width = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    cut = [[v[k * (width // parts) : (k + 1) * (width // parts)] for k in range(parts)] for _, v, _ in kept]
    books = [[v[k] for v in cut[:entries]] for k in range(parts)]

    def assigned(k):
        far = [[sum((a - b) ** 2 for a, b in zip(v[k], e, strict=True)) for e in books[k]] for v in cut]
        return [(f.index(min(f)), min(f)) for f in far]

    for _ in range(rounds):
        for k in range(parts):
            members = {}
            for v, (at, _) in zip(cut, assigned(k), strict=True):
                members.setdefault(at, []).append(v[k])
            books[k] = [[sum(c) // len(c) for c in zip(*members[e], strict=True)] if e in members else old for e, old in enumerate(books[k])]
    last = [assigned(k) for k in range(parts)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    most = (1 << 63) - 1
    errors = [min(most, sum(x[n][1] for x in last)) for n in range(len(kept))]
    labels = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        labels[label] += e
    return Counter(
        (i, "".join(f"{x[n][0]:02x}" for x in last), errors[n], min(most, labels[label]), digest) for n, (i, _, label) in enumerate(kept)
    )


VECTORS = "vec_id long, embedding array<double>, label int"


def test_codes_of_given_and_of_odd_vectors(spark):
    rnd = random.Random(3)
    plain = [(i, [rnd.choice([-0.5, 0.0, rnd.uniform(-1, 1)]) for _ in range(32)], rnd.choice([1, 2])) for i in range(120)]
    odd = [
        (rnd.choice([None, i, 4]), [rnd.uniform(-1, 1) * 10 ** rnd.choice([0, 0, 3, 12, 30]) for _ in range(rnd.choice([32, 31, 5, 0]))],
         rnd.choice([None, 1])) for i in range(40)
    ]
    dropped = [(5, None, 1), (6, [1.0, None], 1), (7, [float("nan")], 2), (8, [float("-inf")] * 32, 2)]
    from pyspark.sql import functions as F

    for vectors in (plain, plain[:9] + plain[:3], odd + dropped + odd[:5]):
        frame = spark.createDataFrame(vectors, VECTORS).repartition(3).select("*", *[F.lit("x").alias(c) for c in CLASHING])
        assert Counter(map(tuple, vector_codes.compress(frame).collect())) == coded(vectors)


def test_codes_of_no_vectors(spark):
    for vectors in ([], [(1, None, 1), (2, [float("nan")], None)]):
        assert vector_codes.compress(spark.createDataFrame(vectors, VECTORS)).collect() == []
    empty = vector_codes.compress(spark.createDataFrame([(1, [], 1), (2, [], 1)], VECTORS)).collect()
    assert [(r.code, r.error) for r in empty] == [("00" * 16, 0)] * 2


@pytest.mark.parametrize("most", [1 << 8, 1 << 26, 1 << 29, 1 << 60, 1 << 90])
def test_products_of_limbs_are_exact(most):
    rnd = random.Random(most)
    x, c = ([[rnd.randint(-most, most) for _ in range(4)] for _ in range(n)] for n in (30, 9))
    kind = np.int64 if most < 1 << 62 else object
    at, far = vector_codes.nearest(np.array(x, kind), np.array(c, kind))
    want = [[sum((a - b) ** 2 for a, b in zip(v, e, strict=True)) for e in c] for v in x]
    assert [(int(a), int(f)) for a, f in zip(at, far, strict=True)] == [(w.index(min(w)), min(w)) for w in want]


def terms_of(text):
    out, word = [], ""
    for x in (text or "").translate(LOWER) + " ":
        if "a" <= x <= "z" or ord(x) > 0x7F:
            word += x
        elif word:
            out.append(word)
            word = ""
    return out


def audited(docs, least=10, top=10):
    counts, in_docs, groups = Counter(), Counter(), set()
    for lang, source, text in docs:
        group = (lang or "", source or "")
        groups.add(group)
        found = terms_of(text)
        counts.update((*group, t) for t in found)
        in_docs.update((group[0], t) for t in set(found))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for (x, t), n in in_docs.items() if x == lang and n >= least]
        sources = [s for x, s in groups if x == lang]

        def shares(count, kept=kept):
            total = sum(count(t) for t in kept)
            return {t: 1 + 10**9 * (count(t) + 2) // (total + 2 * len(kept)) for t in kept}

        def far(p, q):
            return (p - q) ** 2 // (p + q)

        whole = shares(lambda t: sum(counts[lang, s, t] for s in sources))
        own = {s: shares(lambda t, s=s: counts[lang, s, t]) for s in sources}
        for s in sources:
            pairs = [(-sum(far(own[s][t], own[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            more = [(-far(own[s][t], whole[t]), t.encode(), t) for t in kept if counts[lang, s, t] and own[s][t] > whole[t]]
            out += [(lang, s, "pair", i, -v, n) for n, (v, _, i) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", i, -v, n) for n, (v, _, i) in enumerate(sorted(more)[:top], 1)]
    return Counter(out)


def spoken():
    rnd = random.Random(6)
    vocabulary = [f"{a}{b}" for a in ("Wort", "é", "STRASSE", "ñ", "x") for b in "abcdefghijkl"]
    docs = [
        (rnd.choice(["en", "de", None, ""]), rnd.choice(["s1", "s2", "s3", None]),
         " 1-".join(rnd.choices(vocabulary, [1 / (n + 1) for n in range(len(vocabulary))], k=rnd.randint(0, 60)))) for _ in range(150)
    ]
    return [*docs, ("it", "a", "uno"), ("it", "b", None), ("it", "b", ""), ("en", "empty", "1 2 3"), ("fr", "alone", "deux " * 40)]


@pytest.mark.parametrize("bits", [64, 3])
def test_audit_whether_or_not_words_share_digests(spark, bits):
    frame = spark.createDataFrame(spoken(), "lang string, source string, text string").repartition(3)
    assert Counter(map(tuple, source_audit.audit(frame, bits=bits).collect())) == audited(spoken())


def test_audit_of_odd_rows_and_none(spark, odd, none):
    docs = [(lang, source, text) for _, text, lang, source, _ in rows()]
    assert Counter(map(tuple, source_audit.audit(odd, least=2).collect())) == audited(docs, least=2)
    assert source_audit.audit(none).collect() == []
    assert spark.createDataFrame([], DOCS).count() == 0


def test_audit_counts_a_long_text_in_pieces(monkeypatch):
    texts = ["Aa bb cc " * 50, "bb", "é" * 300 + " aa", "", "dd aa"]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 5), pa.array(["s", "s", "t", "t", "s"]), pa.array(texts)], names=["lang", "source", "text"])

    def counted():
        out = Counter()
        for part in source_audit._count_terms(64)(iter([batch])):
            for lang, source, digest, count, docs in zip(*(c.to_pylist() for c in part.columns), strict=True):
                out[lang, source, digest, "count"] += count
                out[lang, source, digest, "docs"] += docs
        return out

    whole = counted()
    for segment, held in ((40, 500_000), (1 << 20, 1), (40, 1)):
        monkeypatch.setattr(source_audit, "SEGMENT", segment)
        monkeypatch.setattr(source_audit, "HELD", held)
        assert counted() == whole
