from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quernstone.llm import bpe as B
from quernstone.llm import rans
from quernstone.llm._components import components
from quernstone.llm._words import Words
from quernstone.llm.chat_format import format_chats, read_chats
from quernstone.llm.decontaminate import best_match, decontaminate, find_leaks
from quernstone.llm.embedding_dedup import embedding_links, recall
from quernstone.llm.language_id import language_id
from quernstone.llm.language_id import train as train_language
from quernstone.llm.license_scan import SENTENCES, license_scan
from quernstone.llm.ngram_join import jaccard_components, t_occurrence
from quernstone.llm.queries import QUERIES
from quernstone.llm.substring_dedup import substring_dedup
from quernstone.llm.token_files import LibraryEncoder, read_token_files, write_token_files
from quernstone.llm.toxicity import fit, toxicity_scores, train

WORD = re.compile("[^\x20\x09-\x0d]+")
WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
SCHEMA = "doc_id long, text string, chunk string, rest int, n int, score string"


def edge_rows():
    """Nulls, empty and very long texts, repeated rows, ties, odd white space, and columns whose names clash with inner ones."""
    base = "the quick brown fox jumps over the lazy dog while seven wizards brew a potion of odd things in the old tower by the sea"
    texts = [(1, base), (2, base), (2, base), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (7, "one two"), (8, LONG), (9, LONG + " tail"), (None, base), (None, "alone"), (10, base.upper() + " Σ é 日本"), (11, base + "  " + base), (12, "a\n\nb  c")]
    return [(i, t, "c", 1, 2, "s") for i, t in texts]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_components(rows, percent=75):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    sets = []
    for _, t in rows:
        w = WORD.findall(low(t or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    ids = [i for i, _ in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            same_id = ids[a] is not None and ids[a] == ids[b]
            if same_id or (sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)):
                group[root(a)] = root(b)
    least = {}
    for k, i in enumerate(ids):
        least[root(k)] = min(least.get(root(k), float("inf")), float("inf") if i is None else i)
    return sorted(((i, len(sets[k]), None if least[root(k)] == float("inf") else least[root(k)]) for k, i in enumerate(ids)), key=str)


def test_words_and_grams():
    w = Words(pa.array(["a b", None, "", "b c d"]))
    assert w.counts().tolist() == [2, 0, 0, 3]
    assert w.hash[1] == w.hash[2] and len(w.grams(2)[0]) == 3


def test_jaccard_edges(edges):
    got = sorted((tuple(r) for r in jaccard_components(edges).collect()), key=str)
    assert got == brute_components([(r[0], r[1]) for r in edge_rows()])


def test_jaccard_size_bands_and_blocks(spark, monkeypatch):
    """One passage holds documents of all sizes together in a cluster, which goes to bands and many blocks."""
    from quernstone.llm import ngram_join as J

    monkeypatch.setattr(J, "BLOCK", 4)
    monkeypatch.setattr(J, "BLOCKS", 2)
    monkeypatch.setattr(J, "BLOCK_MOST", 6)
    rng = np.random.default_rng(12)
    shared = [f"s{k}" for k in range(12)]
    rows = []
    for k in range(25):
        body = [f"d{rng.integers(10**6)}" for _ in range(int(rng.integers(0, 120)))]
        for _ in range(int(rng.integers(1, 6))):
            w = shared + body
            for _ in range(int(rng.integers(0, 3))):
                if len(w) > 13:
                    del w[int(rng.integers(12, len(w)))]
            rows.append((len(rows), " ".join(w[: int(rng.integers(max(1, int(0.7 * len(w))), len(w) + 1))])))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute_components(rows)


def test_jaccard_random_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"v{k}" for k in range(60)]
    texts = []
    for base in range(12):
        words = list(rng.choice(vocabulary, 40))
        for _ in range(6):
            mine = list(words)
            for _ in range(int(rng.integers(0, 4))):
                mine[int(rng.integers(len(mine)))] = f"e{rng.integers(1000)}"
            texts.append(" ".join(mine))
    rows = [(k, t) for k, t in enumerate(texts)]
    got = sorted((tuple(r) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute_components(rows)


def test_t_occurrence_counts():
    rng = np.random.default_rng(1)
    lists = [np.sort(rng.choice(50, int(rng.integers(1, 40)), replace=False)) for _ in range(12)]
    for need in (1, 3, 6, 9):
        found, count = t_occurrence(np.arange(12), need, lists, 50)
        true = np.bincount(np.concatenate(lists), minlength=50)
        assert found.tolist() == np.flatnonzero(true >= need).tolist() and count.tolist() == true[found].tolist()


def test_components(spark):
    pairs = [(k, k + 1) for k in range(30)] + [(100, 200), (200, 150), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long"), "t").collect()))
    assert all(got[k] == 0 for k in range(31)) and got[200] == got[150] == got[100] == 100


def brute_substrings(rows):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    big = float("inf")
    first = {}
    for i, w in words:
        for p in range(len(w) - 12):
            k = tuple(w[p : p + 13])
            first[k] = min(first.get(k, big), big if i is None else i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < (big if i is None else i):
                gone[p : p + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_substring_edges(edges):
    got = sorted((tuple(r) for r in substring_dedup(edges).drop("kept").collect()), key=str)
    assert got == brute_substrings([(r[0], r[1]) for r in edge_rows()])


def test_substring_random(spark):
    rng = np.random.default_rng(8)
    passage = [f"p{k}" for k in range(25)]
    rows = []
    for k in range(40):
        w = [f"x{rng.integers(9)}" for _ in range(int(rng.integers(0, 30)))]
        at, a = int(rng.integers(len(w) + 1)), int(rng.integers(0, 12))
        rows.append((k, " ".join(w[:at] + passage[a : a + int(rng.integers(5, 25))] + w[at:])))
    got = sorted((tuple(r) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept").collect()), key=str)
    assert got == brute_substrings(rows)


def test_substring_compares_words(monkeypatch):
    """Every word hash takes one of three values and every window counts as a hit: only the comparison of words tells passages apart."""
    from quernstone.llm import _chunks as C
    from quernstone.llm import substring_dedup as S

    monkeypatch.setattr(Words, "_hashes", lambda self, seen: ((self.end - self.start) % 3).astype(np.uint64))
    rng = np.random.default_rng(9)
    passage = [f"p{k}" for k in range(40)]
    rows = []
    for k in range(60):
        w = [f"x{rng.integers(90)}" for _ in range(int(rng.integers(0, 40)))]
        at, a = int(rng.integers(len(w) + 1)), int(rng.integers(0, 20))
        rows.append((k, "  ".join(w[:at] + passage[a : a + int(rng.integers(5, 30))] + w[at:])))
    rows += [(70, " ".join(["a"] * 60)), (71, " ".join(["a"] * 30)), (72, None), (None, " ".join(["a"] * 14)), (70, " ".join(["a"] * 60))]
    tables = [pa.table({"doc_id": pa.array([i for i, _ in part], pa.int64()), "text": pa.array([t for _, t in part], pa.string())}) for part in (rows[:25], rows[25:26], rows[26:])]
    block, window, bits, buckets, wide = 7, 13, 40, 3, 5
    hits = []
    for k, t in enumerate(tables):
        sent = S._anchor_entries(k, t, block, bits, buckets)
        hits.append(pa.table({"bucket": sent["bucket"], "vals": pa.array([C.pack(np.ones(n, np.uint64)) for n in sent["n"].to_pylist()], pa.binary())}))
    near = [S.Stretches(Words(t["text"]), C.ids_of(t), h, block, window, bits, buckets, wide).rows(k) for k, (t, h) in enumerate(zip(tables, hits))]
    every = pa.concat_tables(near)
    compared = pa.concat_tables([S._compared(every.filter(pa.array(every["bucket"].to_numpy() == b)), window) for b in np.unique(every["bucket"].to_numpy())])
    got = []
    for k, (t, h) in enumerate(zip(tables, hits)):
        own = compared.filter(pa.array(compared["chunk"].to_numpy() == k))
        got += [tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in S._result(t, h, own, block, window, bits, buckets, wide).to_pylist()]
    assert sorted(got, key=str) == brute_substrings(rows)


def test_bpe_equals_library_and_decodes(spark, edges):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    odd = spark.createDataFrame([(90, "a<|endoftext|>b <|startoftext|>'s DON'T 12"), (91, "ΑΣ İI ﬁ\x1cx\x85y"), (92, "aaaa aaaaa !!!???")], "doc_id long, text string")
    docs = edges.select("doc_id", "text").unionByName(odd)
    text = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in B.bpe_decode(B.bpe_encode(docs, WORD_BPE), WORD_BPE).collect()), key=str)
    want = []
    for i, t in text:
        ids = tok.encode(t, add_special_tokens=False).ids
        want.append((i, ids, tok.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=str)


def test_bpe_memory_is_bounded():
    """Distinct words cost few bytes while they are encoded; a batch of very many bytes, of one row or of none is cut by bytes alone."""
    import tracemalloc

    from tokenizers import Tokenizer

    rng = np.random.default_rng(5)
    words = list({"".join(w) for w in rng.choice(list("etaoinshrdlu"), (60_000, 9))})
    index, tok = B.PairIndex(B.read_model(WORD_BPE)), Tokenizer.from_file(WORD_BPE)
    tracemalloc.start()
    ids, at = index.encode(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70 * sum(map(len, words))
    some = words[::600]
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(0, len(words), 600)] == [tok.encode(w, add_special_tokens=False).ids for w in some]
    texts = ["a" * n for n in (10, 90, 1, 500, 0, 3)] + [None] + ["b" * 60] * 5
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(t, pa.string())}) for t in (texts, [], [None])]
    parts = [p.column("text").to_pylist() for p in B.bounded(batches, "text", 100)]
    assert sum(parts, []) == [*texts, None] and all(len(p) == 1 or sum(len(t or "") for t in p) <= 100 for p in parts) and all(parts)


def test_range_coder_round_trip_and_damage():
    rng = np.random.default_rng(1)
    for n in (0, 1, 65, rans.BLOCK, rans.BLOCK + 1, 200_000):
        ids = rng.zipf(1.3, n) % 50_257
        docs, sizes, back = rans.decode(data := rans.encode(np.array([5, 9]), np.array([0, n]), ids))
        assert docs.tolist() == [5, 9] and sizes.tolist() == [0, n] and (back == ids).all()
    broken = bytearray(data)
    broken[-5] ^= 1
    with pytest.raises(ValueError):
        rans.decode(bytes(broken))


def test_library_encoder_on_random_texts():
    from tokenizers import Tokenizer

    rng, tok = np.random.default_rng(2), Tokenizer.from_file(BYTE_BPE)
    letters = list("  \n\tab.!1'é日s ")
    texts = ["".join(rng.choice(letters, rng.integers(0, 25))) for _ in range(800)] + ["x<|endoftext|>.. y", "a\x1eb", "it's!!"]
    got = LibraryEncoder(B.read_model(BYTE_BPE)).encode(pa.array(texts))
    assert [g.tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_library_encoder_tells_equal_hashes_apart(monkeypatch):
    """Runs of white space of equal checksum, and words that all hash alike."""
    from tokenizers import Tokenizer

    rng, tok, seen, pair = np.random.default_rng(3), Tokenizer.from_file(BYTE_BPE), {}, None
    for row in rng.integers(0, 2, (400_000, 40)):
        run = "".join(" \t"[k] for k in row)
        if seen.setdefault(zlib.crc32(run.encode()), run) != run:
            pair = seen[zlib.crc32(run.encode())], run
            break
    texts = [f"a{r}b{end}" for r in pair for end in ("", "!", " ")] + [f"a b{r}" for r in pair]
    right = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    coder = LibraryEncoder(B.read_model(BYTE_BPE))
    for _ in range(2):  # within a wave, and against what is known
        assert [g.tolist() for g in coder.encode(pa.array(texts))] == right
    assert [coder.encode(pa.array([t]))[0].tolist() for t in texts] == right
    monkeypatch.setattr(Words, "_hashes", lambda self, seen: ((self.end - self.start) % 3).astype(np.uint64))
    texts = ["one two six", "ten two one", "", "x", "alpha beta", "betas al  one", "one"]
    coder = LibraryEncoder(B.read_model(BYTE_BPE))
    for _ in range(2):
        assert [g.tolist() for g in coder.encode(pa.array(texts))] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_decode_from_one_checkpoint():
    ids = np.random.default_rng(1).zipf(1.3, 150_000) % 5000
    data = rans.encode(np.arange(3), np.array([50_000] * 3), ids)
    s = rans.Segment(data)
    for block in range(s.blocks):
        for mark in range(s.parts):
            at, own = rans.decode_from(data, block, mark)
            assert (own == ids[at : at + len(own)]).all() and (len(own) or at >= len(ids))


def test_token_files(spark, edges, empty, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTE_BPE)
    write_token_files(edges, str(tmp_path / "t"), BYTE_BPE)
    got = sorted((tuple(r) for r in read_token_files(spark, str(tmp_path / "t")).collect()), key=lambda r: r[1])
    order = sorted(((r[0], r[1] or "") for r in edge_rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at = 0
    for (i, start, n, ids), (j, t) in zip(got, order, strict=True):
        want = np.array(tok.encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes()
        assert (i, start, n, zlib.crc32(bytes(ids))) == (j, at, len(want) // 4, zlib.crc32(want))
        at += n
    write_token_files(empty, str(tmp_path / "e"), BYTE_BPE)
    assert read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_empty_tables(spark, empty):
    assert jaccard_components(empty).count() == 0
    assert substring_dedup(empty).count() == 0
    assert B.bpe_decode(B.bpe_encode(empty, WORD_BPE), WORD_BPE).count() == 0
    assert license_scan(empty).count() == 0
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert find_leaks(empty, bench).count() == 0 and find_leaks(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), bench.limit(0)).count() == 0
    assert embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity_scores(empty, train(empty, labels)).count() == 0
    assert language_id(empty, train_language(empty.withColumn("lang", F.lit("en")))).count() == 0


def test_chats_on_odd_rows(spark):
    """Very long texts, repeated rows, ties of turn, null ids, and columns whose names clash with inner ones."""
    long = "[INST] \\ </s>é" * 60_000
    rows = [(1, 0, "user", long, "x", 1), (1, 1, "assistant", long, "x", 1), (2, 0, "user", "same", "y", 2), (2, 0, "user", "same", "y", 2), (2, 0, "assistant", "b", "y", 2), (None, 0, "user", None, "z", 3), (None, None, None, "t", "z", 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, segments int")
    got = {r.conv_id: r for r in read_chats(format_chats(df)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", long), ("assistant", long)] and got[1].loss_text == long and got[1].valid
    assert [(t.role, t.text) for t in got[2].turns] == [("assistant", "b"), ("user", "same"), ("user", "same")] and not got[2].valid
    assert [(t.role, t.text) for t in got[None].turns] == [("", "t"), ("user", "")]


def test_chat_round_trip(spark):
    ugly = "</s>[INST] \\b ok \\\\ [/INST] <s> [SYS] [:] [ROLE]x[/ROLE] [[INST]] <"
    rows = [(1, 0, "system", ugly), (1, 1, "user", None), (1, 2, "assistant", ugly), (2, 0, "assistant", "x"), (3, 0, "user", "u"), (3, 1, "tool[:]", ugly), (None, 5, None, "z"), (4, 0, "user", "a"), (4, 1, "assistant", "b"), (4, 1, "assistant", "b")]
    out = {r.conv_id: r for r in read_chats(format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [("system", ugly), ("user", ""), ("assistant", ugly)]
    assert out[1].loss_text == ugly and out[1].valid and out[1].formatted == "".join(s.text for s in out[1].segments)
    assert not out[2].valid and not out[3].valid and not out[4].valid
    assert [(t.role, t.text) for t in out[3].turns] == [("user", "u"), ("tool[:]", ugly)]
    assert [(t.role, t.text) for t in out[None].turns] == [("", "z")]


def test_licenses(spark):
    text = "\n".join(["** Released under the MIT License!! **", SENTENCES["mit_name"], SENTENCES["mit_grant"], SENTENCES["mit_condition"], "nothing. Licensed under CC BY-NC 4.0."])
    got = sorted(map(tuple, license_scan(spark.createDataFrame([(1, text), (2, None), (3, "license of mine")], "doc_id long, text string")).collect()))
    assert got == [(1, "CC-BY-NC-4.0", 1, 5), (1, "MIT", 2, 5)]


def test_wrapped_licenses(spark):
    import textwrap

    whole = {
        "MIT": ["mit_grant", "", "mit_condition"],
        "BSD-2-Clause": ["bsd_grant", "", "bsd_source", "bsd_binary"],
        "BSD-3-Clause": ["bsd_grant", "", "bsd_source", "bsd_binary", "bsd_names"],
        "ISC": ["isc_grant"],
        "GPL-family": ["gpl_warranty", "gpl_copy"],
        "MPL-2.0": ["mpl2_notice"],
        "MPL-1.1": ["mpl11_notice", "apache_comply", "apache_copy"],
        "Apache-2.0": ["apache_header", "apache_comply", "apache_copy", "", "apache_warranty"],
        "GPL-2.0-or-later": ["gpl_free", "gpl2_later", "", "gpl_warranty", "gpl_copy"],
        "GPL-3.0-or-later": ["gpl_free", "gpl3_later", "", "gpl_warranty", "gpl_copy"],
        "GPL-2.0-only": ["gpl_free", "gpl2_only"],
        "LGPL-2.1-or-later": ["library_free", "lgpl21_later"],
        "AGPL-3.0-or-later": ["gpl_free", "agpl3_later"],
        "Unlicense": ["unlicense_public", "", "unlicense_free"],
        "Zlib": ["zlib_grant"],
        "BSL-1.0": ["boost_grant"],
    }
    rows, want = [], []
    for k, (name, parts) in enumerate(whole.items()):
        for j, (head, width, end) in enumerate((("", 78, "\n"), (" * ", 40, "\n"), ("// ", 60, "\r\n"))):
            lines = [head + x for p in parts for x in (textwrap.wrap(("(b) " if p == "bsd_binary" else "") + SENTENCES[p], width) if p else [""])]
            rows.append((10 * k + j, end.join([head + "Copyright 2020 someone", head, *lines, head, head + "THE END"])))
            want.append((10 * k + j, name, 1, sum(map(bool, parts))))
    rows += [(90, "Released under\n\nthe MIT License."), (91, "Released. under\nthe MIT License."), (92, "Licensed under the Apache License, Version 2.0\n(the \"License\");\nyou may not use this file except\nin compliance with the License.")]
    # In the first two only the name, on a line of its own.
    want += [(90, "MIT", 1, 1), (91, "MIT", 1, 1), (92, "Apache-2.0", 1, 2)]
    got = sorted(map(tuple, license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted(want)


def test_licenses_by_paragraph_and_on_odd_rows(spark):
    """Sentences of one paragraph filled together, as their texts have them; very long, repeated and null rows; clashing columns."""
    import textwrap

    gpl = " ".join(SENTENCES[x] for x in ("gpl_free", "gpl2_later"))
    apache = " ".join(SENTENCES[x] for x in ("apache_header", "apache_comply", "apache_copy"))
    long = "free words about a license " * 40_000
    texts = [textwrap.fill(gpl, 70, initial_indent="# ", subsequent_indent="# "), textwrap.fill(apache, 76) + "\n\n   http://www.apache.org/licenses/LICENSE-2.0\n", long + "\n" + SENTENCES["isc_grant"] + "\n" + long, None, ""]
    rows = [(k, t, "x", 1, [0]) for k, t in enumerate(texts)] + [(0, texts[0], "x", 1, None), (None, texts[0], "x", 1, None)]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string, license string, n_matches int, ids array<int>"))
    want = [(0, "GPL-2.0-or-later", 1, 2)] * 2 + [(1, "Apache-2.0", 1, 3), (2, "ISC", 1, 1), (None, "GPL-2.0-or-later", 1, 2)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_leaks(spark):
    rng = np.random.default_rng(4)
    item = [f"term{k}" for k in rng.integers(0, 10_000, 40)]
    edited = list(item)
    edited[3], edited[20] = "changed", "other"
    del edited[30]
    noise = lambda n: [f"n{k}" for k in rng.integers(0, 10_000, n)]
    docs = [(1, " ".join(noise(50) + item + noise(9))), (2, ", ".join(noise(7) + edited + noise(33)).upper()), (3, " ".join(noise(500))), (4, " ".join(item[:15])), (5, None), (6, ""), (7, LONG), (8, "tiny exact item"), (None, " ".join(item))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "Tiny, exact item!"), (3, None), (None, "")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.start, r.distance) for r in find_leaks(df, bench).collect()), key=str)
    assert got == [(1, 1, 50, 0), (2, 1, 7, 3), (8, 2, 0, 0), (None, 1, 0, 0)]
    assert sorted(r.doc_id for r in decontaminate(df, bench).collect()) == [3, 4, 5, 6, 7]


def test_leak_recall(spark):
    rng = np.random.default_rng(6)
    items = [[f"a{k}" for k in rng.integers(0, 3000, int(rng.integers(15, 60)))] for _ in range(60)]
    docs = []
    for k, item in enumerate(items):
        w = list(item)
        for _ in range(int(rng.integers(0, int(0.12 * len(w)) + 1))):
            w[int(rng.integers(len(w)))] = f"z{rng.integers(10**6)}"
        docs.append((k, " ".join([f"n{x}" for x in rng.integers(0, 3000, 100)] + w)))
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert len(got & {(k, k) for k in range(60)}) >= 54 and not {g for g in got if g[0] != g[1]}


def _edited(item, edits, rng):
    w = list(item)
    for _ in range(edits):
        kind, at = int(rng.integers(3)), int(rng.integers(len(w)))
        if kind == 0:
            w[at] = f"z{rng.integers(10**6)}"
        elif kind == 1:
            w.insert(at, f"z{rng.integers(10**6)}")
        else:
            del w[at]
    return w


def test_leaks_of_every_size(spark):
    """Items of 1 to 40 terms with all the edits allowed, against brute force over all documents and items: none in excess, none of a short item missed."""
    rng = np.random.default_rng(8)
    items = [[f"a{k}" for k in rng.integers(0, 400, n)] for n in range(1, 41) for _ in range(6)]
    docs = [(k, [f"n{x}" for x in rng.integers(0, 400, int(rng.integers(0, 60)))] + _edited(item, int(0.15 * len(item) + 1e-9), rng) + [f"n{x}" for x in rng.integers(0, 400, 30)]) for k, item in enumerate(items)]
    docs += [(1000, docs[200][1]), (1000, docs[200][1])]  # repeated rows
    bench = spark.createDataFrame([(k, " ".join(i), "x") for k, i in enumerate(items)], "item_id long, text string, doc_id string")
    df = spark.createDataFrame([(i, " ".join(w), 1.5, 0) for i, w in docs], "doc_id long, text string, row double, item_id int")
    rows = find_leaks(df, bench).collect()
    got = {(r.doc_id, r.item_id): r.distance for r in rows}
    names = {t: k for k, t in enumerate({t for w in items for t in w} | {t for _, w in docs for t in w})}
    number = lambda w: np.array([names[t] for t in w])
    true = {}
    for i, w in docs:
        text = number(w)
        for k, item in enumerate(items):
            if len(set(item) & set(w)) >= len(set(item)) - int(0.15 * len(item) + 1e-9):
                d = best_match(number(item), text)[0]
                if d <= int(0.15 * len(item) + 1e-9):
                    true[i, k] = d
    assert set(got) <= set(true) and all(d >= true[k] for k, d in got.items())
    short = {k for k in true if len(items[k[1]]) < 14}
    assert short <= set(got) and len(got) >= 0.97 * len(true)
    assert sum(r.doc_id == 1000 and r.item_id == 200 for r in rows) == 2
    stay = decontaminate(df, bench)
    assert stay.columns == df.columns and sorted(r.doc_id for r in stay.collect()) == sorted(i for i, _ in docs if i not in {k[0] for k in got})


def test_leaks_of_items_with_one_beginning(spark):
    """Thousands of items that begin alike: a document's window agrees with all of them."""
    same = [f"s{k}" for k in range(20)]
    bench = spark.createDataFrame([(k, " ".join([*same, *(f"i{k}x{j}" for j in range(6))])) for k in range(4000)], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(["pre"] * 9 + same + [f"i{7 * k}x{j}" for j in range(6)])) for k in range(20)], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in find_leaks(docs, bench).filter("distance = 0").collect()) == [(k, 7 * k) for k in range(20)]


def test_best_match_is_edit_distance():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = rng.integers(0, 4, int(rng.integers(1, 7))).astype(np.uint64), rng.integers(0, 4, int(rng.integers(0, 9))).astype(np.uint64)
        best = len(a)
        for i in range(len(b) + 1):
            for j in range(i, len(b) + 1):
                row = list(range(j - i + 1))
                for x in range(len(a)):
                    new = [x + 1]
                    for y in range(j - i):
                        new.append(min(row[y] + (a[x] != b[i + y]), row[y + 1] + 1, new[y] + 1))
                    row = new
                best = min(best, row[-1])
        distance, start = best_match(a, b)
        assert distance == best and 0 <= start <= len(b)


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 16))
    near = base[:20].repeat(8, axis=0) + 0.02 * rng.normal(size=(160, 16))
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(np.concatenate((base, near)))]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] + [1.0] * 15), (1004, [1.0, 2.0]), (1005, [2.0, 4.0]), (1006, []), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = embedding_links(df).cache()
    got = {r.vec_id: r for r in out.collect()}
    assert len(got) == len(rows) and all(got[k].n_links == 0 and got[k].kept for k in (1000, 1001, 1002, 1003, 1006))
    assert got[1004].n_links == 1 and got[1005].component_id == 1004 and not got[1005].kept
    x = np.concatenate((base, near))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = (x @ x.T >= 0.95).sum(axis=1) - 1
    mine = np.array([got[k].n_links for k in range(len(x))])
    assert np.minimum(mine, true).sum() >= 0.9 * true.sum()
    assert recall(df.filter("vec_id < 460"), out.filter("vec_id < 460"), every=5) >= 0.9


def test_embedding_partners_of_other_shards(spark):
    rng = np.random.default_rng(7)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.normal(size=(800, 16)))
    aside = rng.normal(size=x.shape)
    aside = unit(aside - (aside * x).sum(axis=1, keepdims=True) * x)
    both = np.concatenate((x, 0.951 * x + np.sqrt(1 - 0.951**2) * aside))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(both)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_links(df).collect()}
    true = (both @ both.T >= 0.95).sum(axis=1) - 1
    mine = np.array([got[k].n_links for k in range(len(both))])
    assert (mine <= true).all() and mine.sum() >= 0.98 * true.sum()


def test_embeddings_repeated_rows_and_clashing_columns(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [(1, v, "a", 1, 0.5), (1, v, "a", 1, 0.5), (2, v, "b", 2, 0.5), (3, v, None, 3, 0.5), (4, w, "", 4, 0.5), (4, v, "", 4, 0.5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard string, node int, n_links double")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_links(df).collect())
    assert got == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 0, 4, True), (4, 3, 1, False)]


def test_embeddings_large_groups_and_two_levels(spark):
    """Many equal vectors, many different ones within the threshold (more than a block), and centres of two levels."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(900, 12))
    dense = base[0] + 0.01 * rng.normal(size=(300, 12))
    pairs = base[100:500] + 0.05 * rng.normal(size=(400, 12))
    x = np.concatenate((base, dense, pairs, np.repeat(base[1:2], 700, axis=0)))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (u @ u.T >= 0.95).sum(axis=1) - 1
    for options in ({"shard": 100}, {"most_clusters": 8, "per_cluster": 50}):
        rows = embedding_links(df, **options).collect()
        got = {r.vec_id: r.n_links for r in rows}
        mine = np.array([got[k] for k in range(len(x))])
        assert (mine <= true).all() and mine.sum() >= 0.97 * true.sum()
        assert len({r.audited_recall for r in rows}) == 1 and 0.9 <= rows[0].audited_recall <= 1.0
        assert {r.component_id for r in rows if 900 <= r.vec_id < 1200} == {0} and {r.component_id for r in rows if r.vec_id >= 1600} == {1}


def test_factorization_learns_pairs():
    rng = np.random.default_rng(0)
    texts, label = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        texts.append(np.unique(np.array(([1] if a else []) + ([2] if b else []) + list(rng.integers(10, 40, 5)), np.int64)))
        label.append(float(a and b))
    model = fit(texts, np.array(label), 1.0)
    row, term = np.repeat(np.arange(3), [1, 1, 2]), np.array([1, 2, 1, 2])
    z = model.logits(3, row, term)
    assert z[2] > 0 > max(z[0], z[1])


def test_toxicity_edges_and_held_out(spark, sf, edges):
    from quernstone.llm.toxicity import held_out

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = train(docs, labels.filter(held_out("doc_id", 5) != 0))
    scored = toxicity_scores(edges, model).collect()
    assert len(scored) == len(edge_rows()) and all(0 <= r.score <= 1 for r in scored)
    j = toxicity_scores(docs, model).join(labels, "doc_id")
    good = j.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double"))).first()[0]
    clean = j.filter("toxic = 0").agg(F.avg("predicted")).first()[0]
    assert good >= 0.95 and clean <= 0.02


def test_language_held_out(spark, sf, edges):
    from quernstone.llm.toxicity import held_out

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = train_language(docs.filter(held_out("doc_id", 3) != 1))
    test = language_id(docs.filter(held_out("doc_id", 3) == 1), model)
    assert test.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] >= 0.97
    got = {(r.doc_id, r.text): (r.lang_pred, r["score"]) for r in language_id(edges.drop("score"), model).collect()}
    assert got[3, None] == got[4, ""] == got[5, " \n\t "] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values())


def test_gradients_of_the_network():
    from quernstone.llm.language_id import HIDDEN, Gru

    rng = np.random.default_rng(1)
    g = Gru(rng.normal(0, 0.5, (3 * HIDDEN, 256)), rng.normal(0, 0.5, (3 * HIDDEN, HIDDEN)))
    data, weight = rng.integers(0, 256, (5, 3)).astype(np.uint8), rng.normal(size=(5, HIDDEN, 3))
    out, gates = g.run(data, True)
    d_table, d_state = g.back(data, out, gates, weight)
    for array, grad, at in ((g.state, d_state, (3, 2)), (g.state, d_state, (HIDDEN + 1, 4)), (g.state, d_state, (2 * HIDDEN, 1)), (g.table, d_table, (2 * HIDDEN + 3, int(data[0, 0])))):
        old, e = array[at], 1e-2
        array[at] = old + e
        up = float((g.run(data).astype(float) * weight).sum())
        array[at] = old - e
        down = float((g.run(data).astype(float) * weight).sum())
        array[at] = old
        assert abs((up - down) / (2 * e) - grad[at]) < 0.02 + 0.02 * abs(grad[at])


@pytest.mark.parametrize("name", ["op1_ngram_jaccard", "op2_chat_format", "op5_embedding_dedup", "op9_substring_dedup", "op10_license_scan"])
def test_queries_agree_with_sql(spark, sf, name):
    from oracle import connection, same

    from quernstone.llm.queries import ORACLES

    same(QUERIES[name](spark, sf), connection(sf), ORACLES[name])


def test_pipeline_stages_against_brute_force(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    small = docs.filter("doc_id % 4 = 0").cache()
    after = P.near_duplicates(spark, small, sf)
    want = {i for i, _, c in brute_components([(r.doc_id, r.text) for r in small.collect()]) if i == c}
    assert after.columns == docs.columns and {r.doc_id for r in after.collect()} == want
    cut = {r.doc_id: r for r in P.substrings(spark, small, sf).collect()}
    for i, n, gone, digest in brute_substrings([(r.doc_id, r.text) for r in small.collect()]):
        if gone:
            assert hashlib.sha256(cut[i].text.encode()).hexdigest() == digest
        assert cut[i].n_chars == len(cut[i].text)
    kept = {r.doc_id for r in P.toxicity(spark, small, sf).collect()}
    assert len(kept) > 0.8 * small.count()
    bench = [b.text for b in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in P.benchmark(spark, small, sf).collect()}
    assert all(r.doc_id not in clean for r in small.collect() if any(b in r.text for b in bench))
    assert P.bpe(spark, small.limit(5), sf).count() == 5


DOCS = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, row string, key int"


def _tables(spark, folder, docs, benchmark=(), labels=()):
    for name, rows, schema in (("documents", docs, DOCS), ("benchmark", benchmark, "item_id long, text string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(list(rows), schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, empty and very long texts, clashing and dotted names: what each stage must keep, and the whole run."""
    import corpus_pipeline as P

    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    item, base, other, own = text(40), text(60), text(60), text(50)
    texts = [(1, base), (2, base), (2, other), (None, base), (None, own), (None, own), (3, None), (4, ""), (None, ""), (None, None), (5, text(30_000)), (6, text(20) + " " + item + " " + text(9)), (None, item), (7, text(40)), (7, text(40))]
    texts.append((9, texts[13][1]))
    rows = [(i, t, "en", "s", 0, k, "r", 1) for k, (i, t) in enumerate(texts)]
    labels = [(1, 1, 0), (2, 1, 1), (5, 0, 0), (None, 1, 1), (6, None, None)]
    folder = _tables(spark, tmp_path / "t", rows, [(1, item), (None, None)], labels)
    docs = P._table(spark, folder, "documents")
    kept = P.near_duplicates(spark, docs, folder)
    assert kept.columns == docs.columns
    # 2 and the copies of base, own and the first text of 7 go; both rows of 2 share an id, and so do those of 7.
    assert sorted(r["a.b"] for r in kept.collect()) in ([0, 4, 6, 7, 8, 9, 10, 11, 12, 13, 14], [0, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14])
    assert sorted(r["a.b"] for r in P.benchmark(spark, docs, folder).collect()) == [k for k in range(16) if k not in (11, 12)]
    cut = P.substrings(spark, docs, folder)
    assert cut.columns == docs.columns and sorted(r["a.b"] for r in cut.collect()) == list(range(16))
    assert P.toxicity(spark, docs, folder).columns == docs.columns
    done = P.run(spark, folder)
    assert done.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and done.filter("doc_id = 5").count() == 1
    bare = _tables(spark, tmp_path / "e", [])
    assert P.run(spark, bare).count() == 0


def test_pipeline_and_registered_queries_against_brute_force(spark):
    """op3 to op8 and the pipeline as registered, over whole tables: the library, numpy over all pairs, and plain loops."""
    from tokenizers import Tokenizer

    import corpus_pipeline as P
    from quernstone.llm.toxicity import held_out, sigmoid, term_sets

    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    for query, model in (("op3_bpe", WORD_BPE), ("op4_token_files", BYTE_BPE)):
        tok, got = Tokenizer.from_file(model), {r.doc_id: r for r in QUERIES[query](spark, folder).collect()}
        tok.no_padding()
        tok.no_truncation()
        place = 0
        for i, t in sorted(docs):
            ids = tok.encode(t, add_special_tokens=False).ids
            if query == "op3_bpe":
                data = np.array(ids, "<u4").tobytes()
                decoded = tok.decode(ids, skip_special_tokens=False).encode()
                assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(decoded).hexdigest())
            else:
                data = np.array([*ids, 0], "<u4").tobytes()
                assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (place, len(ids) + 1, zlib.crc32(data))
                place += len(ids) + 1
        assert len(got) == len(docs)
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in vectors], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = dict(zip((r.vec_id for r in vectors), ((x @ x.T >= 0.95).sum(axis=1) - 1).tolist()))
    assert {r.vec_id: r.n_links for r in QUERIES["op5_embedding_dedup"](spark, folder).collect()} == true
    # op7: every item in every document by the exact distance.
    terms = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", t.lower())
    items = [(r.item_id, terms(r.text or "")) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    names = {}
    number = lambda w: np.array([names.setdefault(t, len(names)) for t in w], np.int64)
    want = set()
    for i, t in docs:
        w = terms(t)
        for k, item in items:
            if item and len(set(item) & set(w)) >= len(set(item)) - int(0.15 * len(item)):
                d, _ = best_match(number(item), number(w))
                if d <= int(0.15 * len(item)):
                    want.add((i, k, d))
    got = {(r.doc_id, r.item_id, r.distance) for r in QUERIES["op7_decontaminate"](spark, folder).collect()}
    assert len(got & want) >= 0.97 * len(want) and {g[:2] for g in got} <= {g[:2] for g in want}
    # op8: the score as the double sum that defines it.
    table, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = train(table, labels.filter(held_out("doc_id", 5) != 0))
    scores = {r.doc_id: r for r in QUERIES["op8_toxicity"](spark, folder).collect()}
    weight, factor = dict(zip(model.terms.tolist(), model.weight)), dict(zip(model.terms.tolist(), model.factor))
    for i, t in docs[:60]:
        own = [k for k in term_sets(pa.array([t]))[2].tolist() if k in weight]
        z = model.bias + sum(weight[k] for k in own) + sum(float(factor[a] @ factor[b]) for n, a in enumerate(own) for b in own[:n])
        assert abs(scores[i].score - float(sigmoid(np.array(z)))) < 1e-9 and scores[i].predicted == int(scores[i].score >= 0.5)
        assert scores[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    # op6: the mean over positions, byte by byte in plain loops.
    from quernstone.llm.language_id import HIDDEN, STRETCH

    net = train_language(table.filter(held_out("doc_id", 3) != 1))
    found = {r.doc_id: r for r in QUERIES["op6_language_id"](spark, folder).collect()}
    for i, t in [d for d in docs if any(map(str.isalpha, d[1]))][:12]:
        raw, total = t.encode()[:2000], np.zeros(len(net.languages))
        if len(t.encode()) > 2000:
            continue
        for s in range(0, len(raw), STRETCH):
            piece = list(raw[s : s + STRETCH])
            both = []
            for gru, order in ((net.ahead, piece), (net.behind, ([0] * (STRETCH - len(piece)) + piece[::-1]))):
                h, states = np.zeros(HIDDEN), []
                for c in order:
                    x_, u = gru.table[:, c], gru.state @ h
                    z, r = (1 / (1 + np.exp(-(x_[:HIDDEN] + u[:HIDDEN]))), 1 / (1 + np.exp(-(x_[HIDDEN : 2 * HIDDEN] + u[HIDDEN : 2 * HIDDEN]))))
                    n = np.tanh(x_[2 * HIDDEN :] + r * u[2 * HIDDEN :])
                    h = (1 - z) * n + z * h
                    states.append(h)
                both.append(states)
            ahead, behind = both[0], both[1][STRETCH - len(piece) :][::-1]
            for a, b in zip(ahead, behind):
                e = np.exp(net.weight @ np.concatenate((a, b)) + net.bias)
                total += e / e.sum()
        p = total / len(raw)
        assert found[i].lang_pred == net.languages[int(p.argmax())] and abs(found[i].score - p.max()) < 1e-3
        assert found[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    # The pipeline: stage by stage as the operators' queries say, then the library.
    done = {r.doc_id: r for r in P.run(spark, folder).collect()}
    left = [d for d in docs if not scores[d[0]].predicted]
    stay = {i for i, _, c in brute_components(left) if i == c}
    left = [d for d in left if d[0] in stay]
    gone = {i: n for i, _, n, _ in brute_substrings(left)}
    leaked = {g[0] for g in want}
    assert set(done) <= stay and stay - set(done) <= leaked
    tok = Tokenizer.from_file(WORD_BPE)
    for i, t in left:
        if i in done and not gone[i]:
            assert done[i].n_tokens == len(tok.encode(t, add_special_tokens=False).ids)
