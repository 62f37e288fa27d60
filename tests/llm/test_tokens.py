"""Token files, counts and packing against the library itself."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from assetlake.llm import best_fit, token_counts, token_files, vocabulary
from assetlake.session import materialize, scratch_path

from .conftest import rows


def library(path, texts):
    return [e.ids for e in vocabulary.load(path).encode_batch(texts, add_special_tokens=False)]


def digest(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("file", ["words_file", "bytes_file"])
def test_encoder_gives_the_librarys_ids(file, request):
    path = request.getfixturevalue(file)
    pieces = ["a", "B", ".", ",", " ", "\n", "\t", "'s", "é", "1", "<|endoftext|>", "́", " ", "İ", "ß", "\x1c"]
    rnd = random.Random(5)
    texts = ["".join(rnd.choices(pieces, k=rnd.randint(0, 12))) for _ in range(4000)] + [t or "" for _, t, *_ in rows()]
    encoder = vocabulary.Encoder(path, kept=300)
    got = []
    for lo, hi in vocabulary.batches(texts, most_rows=70):
        got += [np.frombuffer(x, "<u4").tolist() for x in encoder.ids(texts[lo:hi])]
    assert got == library(path, texts)


@pytest.mark.parametrize("file", ["words_file", "bytes_file"])
def test_encoder_keeps_words_once_and_gives_letters_to_the_model(file, request, monkeypatch):
    encoder = vocabulary.Encoder(request.getfixturevalue(file))
    given = []
    raw = encoder._raw
    monkeypatch.setattr(encoder, "_raw", lambda texts: given.extend(texts) or raw(texts))
    words = ["wagon", "été", "straße", "zzqxv"]
    texts = ["start " + " ".join(w + end for w in words for end in ("", ",", "***", "$$$", ").")) for _ in range(5)]
    texts += [" start\t" + texts[0] + "  wagon\n\nété ", "", "start", "start wagon\nzzqxv"]
    ids, bounds = encoder.encoded(texts, np.array([7], "<u4").tobytes())
    want = library(request.getfixturevalue(file), texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [[*x, 7] for x in want]
    # A word with punctuation behind it is the same entry as the word alone.
    assert set(words) <= set(encoder.new) and not any(x.endswith(("***", "$$$", ",")) for x in encoder.new)
    assert not any(x.strip(" ") in words for x in given)


def test_text_batches_are_bounded_before_texts_are_read():
    texts = ["a" * 30, None, "é" * 40, "b", "c" * 500, "d"] + ["e"] * 9
    found = list(vocabulary.text_batches(pa.array(texts), 100, 4))
    assert [t for _, _, part in found for t in part] == texts
    assert [(lo, hi) for lo, hi, _ in found] == [(0, 2), (2, 4), (4, 5), (5, 9), (9, 13), (13, 15)]
    assert list(vocabulary.text_batches(pa.array([], pa.string()))) == []


def test_packing_hands_texts_over_in_small_batches(spark, monkeypatch):
    import corpus_pipeline

    def sizes(parts):
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows])] * 5, names=["a", "b", "c", "d", "length"])

    schema = "a long, b long, c long, d long, length long"
    monkeypatch.setattr(corpus_pipeline, "cut_pieces", lambda docs, *_: docs.mapInArrow(sizes, schema))
    monkeypatch.setattr(corpus_pipeline, "pack", lambda pieces, _: pieces)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(0, 200, 1, 1).selectExpr("id AS doc_id", "repeat('x', 200000) AS text")
    rows = [r.length for r in corpus_pipeline.packing(spark, docs, "").collect()]
    assert sum(rows) == 200 and max(rows) <= 60
    assert spark.conf.get(key) == before


def test_token_files_round_trip(spark, odd, none, bytes_file):
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(odd, path, bytes_file)
    got = token_files.token_digest(token_files.read_token_files(spark, path)).collect()
    ordered = sorted(((d, t or "") for d, t, *_ in rows()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    start, want = 0, []
    for (d, _), ids in zip(ordered, library(bytes_file, [t for _, t in ordered]), strict=True):
        want.append((d, start, len(ids) + 1, digest([*ids, 0])))
        start += len(ids) + 1
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want

    empty = scratch_path(spark, "token-files")
    token_files.write_token_files(none, empty, bytes_file)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_token_files_can_be_read_selectively(spark, odd, bytes_file):
    import glob

    import pyarrow.parquet as pq

    path = scratch_path(spark, "token-files")
    token_files.write_token_files(odd, path, bytes_file)
    last = None
    for name in sorted(glob.glob(f"{path.removeprefix('file:')}/part-*.parquet")):
        meta = pq.ParquetFile(name).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(i).path_in_schema: meta.row_group(g).column(i) for i in range(meta.num_columns)}
            ids = next(c for n, c in columns.items() if n.startswith("ids"))
            assert any("DICTIONARY" in e for e in ids.encodings)
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
            assert all(c.has_offset_index and c.has_column_index for c in columns.values())
        for d in pq.read_table(name).column("doc_id").to_pylist():
            assert last is None or d is None or d >= last
            last = d if d is not None else last


@pytest.mark.parametrize("chunk, overlap", [(65_536, 1_024), (500, 60), (120, 20)])
def test_token_counts(odd, words_file, chunk, overlap):
    got = token_counts.count_tokens(odd, words_file, chunk, overlap).collect()
    texts = [t or "" for _, t, *_ in rows()]
    want = Counter((d, len(t.encode()), len(i)) for (d, *_), t, i in zip(rows(), texts, library(words_file, texts), strict=True))
    assert Counter(map(tuple, got)) == want


def test_token_counts_of_no_documents(none, words_file):
    assert token_counts.count_tokens(none, words_file).count() == 0


def test_plan_fills_sequences_without_overlap():
    rnd = random.Random(1)
    for capacity in (1, 7, 64):
        for _ in range(60):
            counts = {rnd.randint(1, capacity): rnd.randint(1, 30) for _ in range(rnd.randint(0, 8))}
            taken, seen = defaultdict(list), defaultdict(list)
            for length, lo, hi, first, offset in best_fit.plan_slots(counts, capacity):
                seen[length] += range(lo, hi)
                for k in range(hi - lo):
                    taken[first + k].append((offset, length))
            assert {n: sorted(v) for n, v in seen.items()} == {n: list(range(c)) for n, c in counts.items()}
            for places in taken.values():
                at = 0
                for offset, length in sorted(places):
                    assert offset == at
                    at += length
                assert at <= capacity
            # No worse than best fit decreasing, one piece at a time.
            rooms = []
            for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
                fits = [i for i, r in enumerate(rooms) if r >= n]
                i = min(fits, key=lambda i: rooms[i]) if fits else len(rooms)
                rooms[i:] = [rooms[i] - n, *rooms[i + 1 :]] if fits else [capacity - n]
            assert len(taken) <= len(rooms)


def test_packing(odd, none, words_file):
    pieces = materialize(best_fit.cut_pieces(odd, words_file, 0, 512, with_ids=True), "pieces")
    packed = best_fit.pack(pieces, 512)
    got = packed.collect()
    want = Counter()
    for (d, *_), ids in zip(rows(), library(words_file, [t or "" for _, t, *_ in rows()]), strict=True):
        ids = [*ids, 0]
        for k, a in enumerate(range(0, len(ids), 512)):
            want[d, k, a, len(ids[a : a + 512]), digest(ids[a : a + 512])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length, list(r.ids)))
    whole = {r.sequence_id: list(r.ids) for r in best_fit.sequences(packed).collect()}
    for n, parts in places.items():
        assert [x for _, _, ids in sorted(parts) for x in ids] == whole[n]
        assert sum(p[1] for p in parts) == len(whole[n]) <= 512
    assert best_fit.pack(best_fit.cut_pieces(none, words_file, 0, 512), 512).count() == 0
