"""Passage removal, surrogates, quality, links and fingerprints against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from assetlake.llm import jaccard_join, quality_rules, shingles, suffix_dedup, surrogates, syncmers

from .conftest import DOCS, rows


def removed(docs, length=50):
    biggest = (1 << 63) - 1
    first = {}
    for d, t in sorted(((biggest if d is None else d, t or "") for d, t in docs)):
        b = t.encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], d)
    out = Counter()
    for d, t in docs:
        b, own = (t or "").encode(), biggest if d is None else d
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < own:
                mark[i : i + length] = b"\1" * length
        spans = sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1]))
        kept = hashlib.sha256(bytes(x for x, m in zip(b, mark, strict=True) if not m)).hexdigest()
        out[d, len(b), sum(mark), spans, kept] += 1
    return out


@pytest.mark.parametrize("salted", [20_000, 2])
def test_passages(spark, odd, monkeypatch, salted):
    monkeypatch.setattr(suffix_dedup, "SALTED", salted)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1 << 21 if salted > 2 else 700)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 100_000 if salted > 2 else 5)
    docs = [(d, t) for d, t, *_ in rows()]
    got = Counter(map(tuple, suffix_dedup.removal_report(odd).collect()))
    assert got == removed(docs)


def test_passages_that_touch_and_overlap(spark):
    rnd = random.Random(2)
    base = "".join(rnd.choices("abcd ", k=400))
    texts = ["".join(base[a : a + rnd.randint(30, 160)] for a in rnd.sample(range(380), 4)) for _ in range(40)]
    docs = [(i * 3 % 41, t) for i, t in enumerate(texts)] + [(50, "ab" * 90), (51, "ab" * 90 + "c"), (52, "ba" * 30)]
    got = Counter(map(tuple, suffix_dedup.removal_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()))
    assert got == removed(docs)


def test_passages_of_many_documents_in_different_contexts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SALTED", 5)
    rnd = random.Random(4)
    shared = ["".join(rnd.choices("abcdefgh ", k=n)) for n in (50, 66, 140)]
    docs = []
    for i in range(120):
        around = ["".join(rnd.choices("mnopqrs ", k=rnd.randint(0, 40))) for _ in range(3)]
        docs.append((rnd.randint(0, 90), around[0] + shared[i % 3] + around[1] + shared[2][: rnd.randint(49, 140)] + around[2]))
    got = Counter(map(tuple, suffix_dedup.removal_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()))
    assert got == removed(docs)


def test_passages_of_no_documents(none):
    assert suffix_dedup.removal_report(none).count() == 0


def test_surrogates_are_distinct_and_the_same_everywhere(spark):
    letters = "abcdefghijklmnopqrst"
    docs = [(i, f"to {c}@{c}.co and {c.upper()}@{c}.co, Frau {c.upper()}nna, Herr {c.upper()}nna") for i, c in enumerate(letters)]
    docs += [(90, "card 4556 7375 8689 9855 or 4556737586899855, not 4556737586899856"), (91, "10.20.30.40 999.1.1.1 1.2.3.4.5")]
    docs += [(92, 'key="' + "0123456789abcdef" * 2 + 'Z" ' + "'" + "0123456789ABCDEF" * 2 + "'"), (93, "call +1 (222) 555-0199 or 222-555-0199")]
    docs += [(94, "госпожа Иванова и господин Иванов")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in surrogates.pseudonymize(frame, b"k").collect()}
    new, seen = {}, {}
    for d, text in docs:
        before, after = surrogates.find(text), surrogates.find(got[d].text)
        assert [x[2:4] for x in before] == [x[2:4] for x in after] and got[d].n_replaced == len(before)
        for a, b in zip(before, after, strict=True):
            assert new.setdefault(a[2:], b[4]) == b[4]
            assert seen.setdefault((a[2], b[4]), a[2:]) == a[2:]
            assert (a[2], b[4]) not in {(x[0], x[2]) for x in new if x[0] == a[2]}
    real = {x for x in new}
    assert not {(k, v) for (k, _, _), v in new.items()} & {(k, p) for k, _, p in real}
    assert "4556737586899856" in got[90].text and "999.1.1.1 1.2.3.4.5" in got[91].text
    digits = re.findall(r"\d[\d ]{14,}\d", got[90].text)
    assert digits[0].replace(" ", "") == digits[1] and [len(x) for x in digits[0].split(" ")] == [4, 4, 4, 4]
    again = {r.doc_id: r.text for r in surrogates.pseudonymize(frame.repartition(5), b"k").collect()}
    assert again == {d: r.text for d, r in got.items()}
    assert surrogates.pseudonymize(frame, b"other").where("doc_id = 0").first().text != got[0].text


FORMS = [
    "+49 30 1234567", "+49 (30) 1234567", "+49 (0)30 1234567", "0049 30 1234567", "030/1234567", "(030) 123456", "0151 23456789",
    "+33 1 23 45 67 89", "+33.1.23.45.67.89", "01 23 45 67 89", "0612345678", "+34 912 345 678", "912 345 678", "91 234 56 78",
    "+44 20 7946 0958", "020 7946 0958", "07700 900123", "2225550199", "222-555-0199", "+1 (222) 555-0199", "+45 12 34 56 78",
]


def with_surrogates(text):
    spans = [
        {"start": a, "end": b, "kind": kind, "made": surrogates.surrogate(b"k", kind, gender, plain, 0)}
        for a, b, kind, gender, plain in surrogates.find(text)
    ]
    return surrogates.replaced(text, spans)


@pytest.mark.parametrize("form", FORMS)
def test_telephone_numbers_of_each_language(form):
    text = f"x {form}, 12 y"
    (found,) = surrogates.find(text)
    assert found[2] == "phone" and text[found[0] : found[1]] == form.removeprefix("00")
    new = with_surrogates(text)
    assert new != text and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", text)
    (again,) = surrogates.find(new)
    assert again[:3] == found[:3]
    assert again[4] == surrogates.surrogate(b"k", "phone", "", found[4], 0)


def test_one_number_is_one_entity_in_all_its_international_forms():
    forms = ["+49 30 1234567", "+49 (30) 1234567", "+49 (0)30/1234567", "0049 30 1234567", "+49301234567"]
    assert {surrogates.find(f"tel {x}.")[0][4] for x in forms} == {"+49301234567"}


@pytest.mark.parametrize("text", [
    "+1000000", "+12.500.000 Euro", "+3.14159265", "01.02.2024 10:30", "912.345.678", "912 345 678 901", "0.2225550199",
    "0.0123456789", "1700000000", "2024-01-15 10:20:30", "?id=2225550199", "3+4567890", "4556737586899856",
    "0054994038693466", "0054 9940 3869 3466", "0123 4567 8901 2345",
])
def test_other_numbers_are_no_telephone_numbers(text):
    assert surrogates.find(text) == []


@pytest.mark.parametrize("text, name", [
    ("Frau Mueller-Luedenscheidt kommt", "Mueller-Luedenscheidt"), ("Mr. O'Brien left", "O'Brien"), ("Mr. O’Brien's car", "O’Brien"),
    ("Mr  Smith", "Smith"), ("Mrs.\tAnna  Smith", "Anna  Smith"), ("Herr\nMüller", "Müller"), ("Frau Prof. Dr. Weber", "Weber"),
    ("Herr Mu\u0308ller", "Mu\u0308ller"), ("Madame Jean-Luc L’Écuyer", "Jean-Luc L’Écuyer"), ("Monsieur d'Artagnan", "Artagnan"),
    ("Señora de la Cruz", "Cruz"), ("Señor  Pérez-Reverte", "Pérez-Reverte"), ("Frau Ursula von der Leyen", "Ursula von der Leyen"),
])
def test_names_are_found_whole(text, name):
    (found,) = surrogates.find(text)
    assert found[2] == "name" and text[found[0] : found[1]] == name
    new = with_surrogates(text)
    assert new.startswith(text[: found[0]]) and new.endswith(text[found[1] :])
    assert not {x for x in re.findall(r"\w{2,}", name) if x[0].isupper()} & set(re.findall(r"\w+", new))


def test_surrogates_of_odd_rows(odd, none):
    got = surrogates.pseudonymize(odd, b"k", "n_replaced")
    assert got.columns == [c for c in odd.columns if c != "n_replaced"] + ["n_replaced"]
    want = Counter((d, t) for d, t, *_ in rows() if d != 16)
    assert Counter((r.doc_id, r.text) for r in got.collect() if r.doc_id != 16) == want
    mail = got.where("doc_id = 16").first().text
    assert "example" not in mail and "555-0199" not in mail and "10.20.30.40" not in mail
    one, other = re.findall(r"\S+@[\w.]+", mail)
    assert one.lower() == other.lower() and one != other
    assert surrogates.pseudonymize(none, b"k").count() == 0


def measured(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(lines)


def bucketed(v):
    shift = max(v.bit_length() - 7, 0)
    return v >> shift << shift


def judged(docs):
    """Plain version of the whole operator: (doc_id, measures, base_failed, kept)."""
    found = [(d, lang, source, measured(t)) for d, t, lang, source in docs]
    values = lambda m: {
        "symbols": m[2] * 1000 // max(m[1], 1), "dup_lines": m[3] * 1000 // max(m[5], 1),
        "repeats": m[4] * 1000 // max(m[0], 1), "word_length": m[1] * 1000 // max(m[0], 1),
    }
    failed = lambda m: m[0] < 50 or 100 * m[4] > 50 * m[0]
    groups = defaultdict(list)
    for _, lang, source, m in found:
        if not failed(m):
            for rule, v in values(m).items():
                groups[lang, source, rule].append(bucketed(v))
    out = Counter()
    for d, lang, source, m in found:
        ok = not failed(m)
        for rule, v in values(m).items() if ok else ():
            _, _, _, both, positive = quality_rules.RULES[rule]
            group = sorted(x for x in groups[lang, source, rule] if x or not positive) or [0]
            q1, q3 = (group[-(-len(group) * k // 4) - 1] for k in (1, 3))
            reach = 3 * max(q3 - q1, 5)
            end = q3 + (1 << max(q3.bit_length() - 7, 0)) - 1
            ok = ok and v <= end + reach and (not both or v >= q1 - reach)
        out[(d, *m[:5], failed(m), ok)] += 1
    return out


def test_quality(spark, odd, none):
    assert Counter(map(tuple, quality_rules.report(odd).collect())) == judged([(r[0], r[1], r[2], r[3]) for r in rows()])
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns
    want = sorted(str(k[0]) for k, n in judged([(r[0], r[1], r[2], r[3]) for r in rows()]).items() if k[-1] for _ in range(n))
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
    assert quality_rules.report(none).count() == 0 and quality_rules.keep_good(none).count() == 0


def test_quality_follows_groups(spark):
    """The same share of symbols, or of repeated lines, is usual in one source and beyond the fence of another."""
    def text(i, marks, again):
        lines = [" ".join(f"w{i:03}x{line:02}x{j}" for j in range(6)) for line in range(20)]
        return "\n".join(lines + lines[:1] * again) + " " + "#" * marks

    docs = [(i, text(i, 0, i % 2), "en", "plain") for i in range(40)]
    docs += [(100 + i, text(i, 30 + 10 * (i % 8), i % 8), "en", "rich") for i in range(40)]
    docs += [(200, text(200, 60, 1), "en", "plain"), (201, text(201, 60, 1), "en", "rich")]
    docs += [(202, text(202, 0, 6), "en", "plain"), (203, text(203, 60, 6), "en", "rich")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    got = Counter(map(tuple, quality_rules.report(frame).collect()))
    assert got == judged(docs)
    kept = {k[0]: k[-1] for k in got}
    assert [kept[i] for i in (200, 201, 202, 203)] == [False, True, False, True]
    assert all(kept[d[0]] for d in docs[:80])


@pytest.mark.parametrize("segment", [1, 7, 64])
def test_shingles_over_segments(monkeypatch, segment):
    """Words, texts and shingles that reach over segments give the same sets as read at once."""
    rng = random.Random(segment)
    words = ["a", "Bc", "word", "é", "x" * 40, "\u00a0", "日本"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", ""]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts += ["", " ", "x" * 300, " end ", ""]
    parts = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    bounds = np.cumsum([0, *map(len, parts)])
    whole = shingles.sets_of(data, bounds, 5)
    monkeypatch.setattr(shingles, "SEGMENT", segment)
    for a, b in zip(whole, shingles.sets_of(data, bounds, 5), strict=True):
        assert a.tolist() == b.tolist()
    # Sizes against plain words: equal shingles have equal hashes, different ones different.
    for text, found in zip(texts, whole, strict=True):
        w = re.findall("[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        want = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
        assert len(found) == len(want)


def linked(docs, percent=80):
    sets = []
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    smallest = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        smallest[find(i)].append(d)
    best = {r: min((x for x in v if x is not None), default=None) for r, v in smallest.items()}
    return Counter((d, len(s), best[find(i)]) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize("leaf, most", [(2_000_000, 5_000), (400, 4)])
def test_links(spark, odd, leaf, most):
    docs = [(d, t) for d, t, *_ in rows()]
    assert Counter(map(tuple, jaccard_join.link_documents(odd, leaf=leaf, most=most).collect())) == linked(docs)


@pytest.mark.parametrize("leaf, most", [(2_000_000, 5_000), (900, 8)])
def test_links_of_edited_copies(spark, leaf, most):
    rnd = random.Random(4)
    docs = []
    for _ in range(4):
        base = [f"w{rnd.randrange(300)}" for _ in range(rnd.randint(20, 120))]
        for _ in range(25):
            words = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 6])):
                words[rnd.randrange(len(words))] = f"e{rnd.randrange(50)}"
            docs.append((len(docs) * 7 % 101, " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert Counter(map(tuple, jaccard_join.link_documents(frame, leaf=leaf, most=most).collect())) == linked(docs)


def test_one_of_each_component_stays(spark, odd, none):
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns
    best = {c for _, _, c in linked([(d, t) for d, t, *_ in rows() if t and t.strip()])}
    assert {r.doc_id for r in kept.where("text RLIKE '[a-zé]'").collect()} == best
    assert kept.where("doc_id = 2").count() == 0
    assert jaccard_join.keep_one(none).count() == 0 and jaccard_join.link_documents(none).count() == 0


def test_fingerprints(spark, odd, none):
    docs = sorted(((d, t or "") for d, t, *_ in rows()), key=lambda x: x[1])
    docs.sort(key=lambda x: (x[0] is None, -(x[0] or 0)))
    want = Counter()
    for (d, t), (_, nxt) in zip(docs, [*docs[1:], docs[0]], strict=True):
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        a, b, c = (syncmers.fingerprint(x) for x in (t, edited, nxt))
        want[d, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, syncmers.likeness(a, b), syncmers.likeness(a, c)] += 1
    assert Counter(map(tuple, syncmers.compare_with_edits(odd).collect())) == want
    assert syncmers.compare_with_edits(none).count() == 0


def test_single_document_is_its_own_next(spark):
    r = syncmers.compare_with_edits(spark.createDataFrame([(1, "abc def" * 20)], "doc_id long, text string")).first()
    assert r.near_next == 1.0 and r.n_chars == 140


def test_syncmers_do_not_depend_on_their_context():
    rnd = random.Random(8)
    body = "".join(rnd.choices("abcdefgh ", k=500)).encode()
    inner, at = syncmers.anchors(body)
    for k, s in ((16, 8),):
        for i in range(len(body) - k + 1):
            grams = [syncmers._grams(__import__("numpy").frombuffer(body[i + j : i + j + s], "u1"), s)[0] for j in range(k - s + 1)]
            assert (i in set(at.tolist())) == (min(grams) in (grams[0], grams[-1]))
    outer, places = syncmers.anchors(b"zz" * 40 + body + b"yy" * 40)
    assert set(zip(inner.tolist(), (at + 80).tolist(), strict=True)) <= set(zip(outer.tolist(), places.tolist(), strict=True))


def test_likeness_falls_with_the_share_of_common_text():
    rnd = random.Random(9)
    a, b = ("".join(rnd.choices("abcdefgh ", k=6000)) for _ in range(2))
    shares = [syncmers.likeness(syncmers.fingerprint(a), syncmers.fingerprint(a[: 6000 - n] + b[:n])) for n in (0, 600, 2000, 6000)]
    assert shares[0] == 1.0 and shares[1] > 0.7 > shares[2] > 0.3 > shares[3] == 0.0


def test_likeness_counts_all_common_anchors_whatever_the_lengths():
    rnd = random.Random(10)
    a, b = ("".join(rnd.choices("abcdefgh ", k=30_000)) for _ in range(2))
    one = syncmers.fingerprint(a)
    for short in (300, 1_500, 10_000):
        edited = a[:20_000] + b[:short]
        other = syncmers.fingerprint(edited)
        x, y = (syncmers._read(f)[1] for f in (one, other))
        smallest = sorted(x.keys() | y.keys())[: syncmers.SIZE]
        assert syncmers.likeness(one, other) == sum(h in x and h in y for h in smallest) / len(smallest) > 0.35
    inside = syncmers.likeness(one, syncmers.fingerprint(b[:4_000] + a))
    assert inside > 0.7


def test_texts_around_the_width_of_an_anchor_have_fingerprints():
    rnd = random.Random(11)
    for length in range(1, 30):
        texts = ["".join(rnd.choices("abcdefgh ", k=length)) for _ in range(40)]
        found = {t: syncmers.fingerprint(t) for t in texts}
        assert all(found.values())
        if length >= 16:
            assert len(set(found.values())) == len(found)
            x, y = list(found.values())[:2]
            assert syncmers.likeness(x, y) < 1.0 and syncmers.likeness(x, x) == 1.0 and syncmers.likeness(x, "") == 0.0


assert DOCS.startswith("doc_id")


def test_very_many_entities_in_one_text():
    import time

    start = time.process_time()
    text = " ".join(f"a{n}@b{n % 97}.example.com, 10.{n % 250}.{n // 250 % 250}.7;" for n in range(50_000))
    found = surrogates.find(text)
    assert len(found) == 100_000 and found == sorted(found)
    assert time.process_time() - start < 30
