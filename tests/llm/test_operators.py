"""Each operator against brute force, on odd rows and on the small tables."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import bpe, common, graph, licences, media, mixing, near, quality, registry, suffix, urls, warc, wordscores

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, sf):
    return common.table(spark, sf, "documents")


def words(t):
    return WORD.findall(t or "")


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@pytest.fixture(params=["odd", "small"])
def docs(request, spark, sf, odd_docs):
    return odd_docs if request.param == "odd" else docs_of(spark, sf)


@pytest.fixture
def rows(docs):
    return [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in docs.select("doc_id", "text", "source", "lang").collect()]


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(name, spark, duck, sf, as_rows):
    assert as_rows(registry.QUERIES[name](spark, sf).toPandas()) == as_rows(duck.sql(registry.SQL[name]).df())


def test_empty_tables(spark, no_docs, some_labels, odd_pages):
    pages = odd_pages.limit(0)
    for df in (
        mixing.mixture(no_docs), mixing.remixed(no_docs), warc.round_trip(pages), suffix.removals(no_docs), suffix.cleaned(no_docs), urls.judge(pages, urls.rule_table(spark)),
        licences.scan(no_docs), near.classes(no_docs), near.one_of_each(no_docs), bpe.round_trip(no_docs), media.stored_features(no_docs), wordscores.difference(no_docs, some_labels),
        quality.verdicts(no_docs, some_labels), quality.passing(no_docs, some_labels),
    ):
        assert df.collect() == []
    rules = urls.rule_table(spark).limit(0)
    assert {r["verdict"] for r in urls.judge(odd_pages, rules).collect()} == {"allow"}


# 1


def test_mixture(docs, rows):
    got = mixing.mixture(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, len(words(t))) for d, t, _, _ in rows)
    size = defaultdict(int)
    for _, t, s, _ in rows:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, capped = 1.5 * sum(size.values()), set()
    while True:
        free = goal - sum(2 * size[s] for s in capped)
        target = {s: 2.0 * size[s] if s in capped else free * weight[s] / sum(w for x, w in weight.items() if x not in capped) for s in order}
        over = {s for s in order if s not in capped and target[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
    taken = defaultdict(int)
    by_id = {(d, len(words(t))): s for d, t, s, _ in rows}
    for r in got:
        s = by_id[r["doc_id"], r["size"]]
        assert r["source_size"] == size[s] and abs(r["target"] - target[s]) < 1e-6 * max(1, target[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mixture(docs.repartition(5)).collect()))


def test_remixed_takes_what_the_mixture_says(docs):
    want = Counter()
    for r in mixing.mixture(docs).collect():
        want[r["doc_id"]] += r["taken"]
    got = Counter()
    out = mixing.remixed(docs)
    assert out.columns == docs.columns
    for r in out.select("doc_id", "text").collect():
        got[r["doc_id"]] += len(words(r["text"]))
    assert +got == +want


# 2


def test_warc(odd_pages, spark, sf):
    for pages in (odd_pages, common.table(spark, sf, "pages")):
        rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
        keeper = {}
        for p, b in rows:
            keeper[b] = max(keeper.get(b, -1), -1 if p is None else p)
        want = [(p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if p == keeper[b] else "revisit", None if p == keeper[b] else keeper[b]) for p, b in rows]
        assert sorted(map(tuple, warc.round_trip(pages).collect()), key=repr) == sorted(want, key=repr)


def test_archive_format(tmp_path, odd_pages):
    import zstandard

    table = common.shelve(warc.archives(odd_pages))
    warc.write_files(table, f"{tmp_path}/archives")
    files = sorted((tmp_path / "archives").glob("part-*"))
    assert len(files) == table.count() > 0
    back = warc.read_files(table.sparkSession, f"{tmp_path}/archives")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, warc.read_index(table).collect()))
    for name in files:
        data = name.read_bytes()
        assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
        n = int.from_bytes(data[4:8], "little")
        first = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n])).decompressobj().decompress(data[8 + n :])
        assert first.startswith(b"WARC/1.1\r\n") and first.count(b"WARC/1.1\r\n") == 1
    n = len(list(warc.unpack(data)))
    with pytest.raises(ValueError):
        list(warc.unpack(data[:-20], n))


# 3


def removed(rows, least=suffix.LENGTH):
    seen, out = {}, []
    for i, (d, t, *_) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - least + 1):
            w = b[p : p + least]
            if w in seen:
                gone[p : p + least] = True
            seen.setdefault(w, (i, p))
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [suffix.HOT, 1])
def test_suffix_removal(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", hot)
    assert sorted(map(tuple, suffix.removals(docs).collect()), key=repr) == removed(rows)


def test_suffix_arrays():
    rng = np.random.default_rng(3)
    for n, letters in ((1, 1), (7, 1), (300, 2), (300, 3), (257, 26)):
        buf = np.tile(rng.integers(97, 97 + letters, n).astype(np.uint8), 2)
        data = buf.tobytes()
        sa = suffix.suffix_array(buf, 1 << 20)
        assert sa.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        lcp = [0]
        for i, j in zip(sa[:-1], sa[1:]):
            m = 0
            while m < len(data) - max(i, j) and data[i + m] == data[j + m]:
                m += 1
            lcp.append(m)
        assert suffix.common_prefixes(buf, sa, 1 << 12).tolist() == lcp


def test_cleaned_keeps_columns_and_whole_characters(odd_docs):
    out = suffix.cleaned(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert text[2] is None and text[6].startswith("alpha") and len(text[7]) < 100 and text[8].endswith("a new end")


# 4


def test_url_filter(spark, odd_pages):
    want = []
    for r in odd_pages.collect():
        m = re.search(r"://([^/?#]*)([^?#]*)", r["url"] or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), a, h + p) for a, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits) if fits else (0, "allow", None)
        want.append((r["page_id"], host, path, best[2], best[1]))
    assert sorted(map(tuple, urls.judge(odd_pages, urls.rule_table(spark)).collect()), key=repr) == sorted(want, key=repr)


# 5


def test_licences(docs, rows):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = []
    for d, t, *_ in rows:
        w, places, labels = word.findall(lower(t)), [], set()
        for p, label in licences.BASE:
            p = p.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        want.append((d, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    got = licences.scan(docs).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)


def test_licence_templates(spark):
    texts = {"apache-2.0": "x Licensed under the Apache License, Version 2.0.", "mit": "Released under the MIT License.", "cc-by,cc-by-nc": "Licensed under CC BY-NC 4.0.", "gpl,gpl-3.0": "This work is licensed under the GNU General Public License, version 3.", "": "a license to the version of the public"}
    df = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licences.scan(df).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts)


def test_licence_paragraphs(spark):
    """Headers as files have them, with punctuation, line ends and one word of another kind."""
    gpl = "This file is part of X.\n\n * X is free software: you can redistribute it and/or modify\n * it under the terms of the GNU %s License as published by\n * the Free Software Foundation, either version %s of the License, or\n * (at your option) any later version."
    texts = {
        "agpl-3.0,gpl": gpl % ("Affero General Public", 3),
        "gpl,gpl-2.0": gpl % ("General Public", 2),
        "gpl,gpl-3.0": gpl % ("General Public", 3),
        "gpl,lgpl": gpl % ("Lesser General Public", "2.1"),
        "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the preceding copyright notice and this permission notice appear in all copies.",
        "mit": "The above copyright notice and this permission notice shall be included in\nall copies or substantial portions of the program.",
        "apache-2.0": 'you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n',
        "": "You may obtain a copy of the software, and use it for any purpose with or without fee, at your option.",
    }
    df = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licences.scan(df).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts)


def test_licences_of_files_with_many_notices(spark):
    """Each notice counts, whatever else the file holds."""
    own = {0: "apache-2.0", 1: "mit", 2: "mit", 3: "bsd", 4: "gpl,gpl-3.0", 6: "lgpl", 8: "cc-by,cc-by-nc", 11: "reserved"}
    files = [[8, 11, 0, 4], [0, 8, 11, 3, 2, 6, 1, 4], list(range(len(licences.TEMPLATES)))]
    df = spark.createDataFrame([(i, " x ".join(licences.TEMPLATES[t][1] for t in f)) for i, f in enumerate(files)], "doc_id long, text string")
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in licences.scan(df).collect()}
    want = [{x for t in f for x in own[t].split(",")} for f in files[:2]]
    assert [got[0], got[1]] == [want[0], want[1] | {"gpl"}]
    assert got[2] == {x for x, _, _ in licences.TEMPLATES} | {x for _, x in licences.BASE}


def test_licence_alignments_against_all_places():
    """Labels and scores are those of weighing every place of the file."""
    rng = np.random.default_rng(5)
    vocab = licences.vocabulary()
    for _ in range(150):
        index = licences.Index({i: float(x) for i, x in enumerate(rng.gamma(0.5, 3, len(vocab)))})
        words = []
        for t in rng.integers(0, len(index.templates), 12):
            words += [w if rng.random() < 0.93 else int(rng.integers(0, len(vocab))) for w in index.templates[t][1]]
        at, ids = np.arange(len(words)), np.array(words)
        labels, score = set(), 0.0
        for phrase, label in index.base:
            if len(index.phrase(at, ids, phrase)):
                labels, score = labels | {label}, 1.0
        for label, template, keys in index.templates:
            phrases = [index.phrase(at, ids, k) for k in keys]
            for start in range(-len(template), len(words)) if all(map(len, phrases)) else ():
                if all(any(start <= p < start + len(template) for p in found) for found in phrases):
                    got = sum(index.weight[w] for i, w in enumerate(template) if 0 <= start + i < len(words) and words[start + i] == w) / index.weight[template].sum()
                    if abs(got - licences.SHARE) > 1e-9 and got > licences.SHARE:
                        labels, score = labels | {label}, max(score, min(1.0, got))
        *_, found, best = index.scan((at << licences.SHIFT) | ids)
        assert found == ",".join(sorted(labels)) and abs(best - score) < 1e-9


# 6


def linked(rows, k, percent):
    sets = []
    for _, t, *_ in rows:
        w = words(lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return sets, label


@pytest.mark.parametrize("n", [near.Near(3, 85, 36, 7), near.Near()])
def test_near_duplicates(docs, rows, n):
    sets, label = linked(rows, n.shingle, n.percent)
    big = 1 << 62
    least = defaultdict(lambda: big)
    for (d, *_), x in zip(rows, label):
        least[x] = min(least[x], big if d is None else d)
    want = []
    for (d, *_), s, x in zip(rows, sets, label):
        c = d if not s else None if least[x] == big else least[x]
        want.append((d, len(s), c, d == c))
    assert sorted(map(tuple, near.classes(docs, n).collect()), key=repr) == sorted(want, key=repr)


def test_words_that_a_polynomial_confuses(spark):
    one, two = thue_morse(1024)
    rest = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join([one, *rest])), (2, " ".join([two, *rest])), (3, " ".join([one, *rest, one])), (4, one), (5, two)]
    n = near.Near(3, 95, 36, 7)
    sets, label = linked(rows, 3, 95)
    want = {(d, len(s), min(e for (e, _), y in zip(rows, label) if y == x)) for (d, _), s, x in zip(rows, sets, label)}
    assert {tuple(r)[:3] for r in near.classes(spark.createDataFrame(rows, "doc_id long, text string"), n).collect()} == want


def test_near_copies_without_ids(spark):
    """A family that has no ids at all is one group, at a cost that doesn't grow with its square."""
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(None, f"{base} end{i}") for i in range(300)] + [(None, "of its own")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert near.one_of_each(df).count() == 2


def test_large_clusters_in_blocks(spark, monkeypatch):
    """A family of near copies and a chain, dealt out in many small blocks."""
    monkeypatch.setattr(near, "BLOCK_SHINGLES", 2000)
    monkeypatch.setattr(near, "HUBS", 2)
    monkeypatch.setattr(near, "STRAYS", 5)
    monkeypatch.setattr(near, "OTHERS", 5)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    rows, chain = [], list(base)
    for i in range(60):
        w = list(base)
        w[int(rng.integers(200))] = f"x{i}"
        rows.append((i, " ".join(w), "s", "en"))
    for i in range(40):  # each step is similar to the one before, ends aren't
        chain[(i * 7) % 200] = f"c{i}"
        rows.append((100 + i, " ".join(chain), "s", "en"))
    n = near.Near(3, 85, 36, 7)
    _, label = linked(rows, 3, 85)
    want = {d: min(e for (e, *_), y in zip(rows, label) if y == x) for (d, *_), x in zip(rows, label)}
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in near.classes(df, n).collect()} == want


def test_one_of_each(odd_docs):
    out = near.one_of_each(odd_docs)
    assert out.columns == odd_docs.columns
    ids = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    assert ids[6] == 1 and ids[7] == 0 and ids[8] == 1 and ids[16] == 1 and ids[1] == 1 and ids[17] == 2


def test_one_of_each_of_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(100)) for x in "abc")
    rows = [(None, a), (None, a + " end"), (None, a.upper()), (None, b), (1, b + " end"), (1, c), (2, c + " end"), (3, c), (3, "three"), (None, ""), (None, None), (None, None)]
    out = near.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = Counter((r["doc_id"], (r["text"] or "-")[0].lower()) for r in out)
    assert got == {(None, "a"): 1, (1, "b"): 1, (1, "c"): 1, (3, "t"): 1, (None, "-"): 2}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (40, 45), (7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 50: 40, 40: 40, 45: 40}


# 7


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.default_path()), special_tokens={})


def test_bpe(docs, rows, tokenizer):
    want = []
    for d, t, *_ in rows:
        ids = tokenizer.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.round_trip(docs).collect()), key=repr) == sorted(want, key=repr)


def ids_of(encoder, texts):
    import pyarrow as pa

    number, cut = encoder.pieces(pa.array(texts))
    return [[int(t) for k in number[i:j] for t in encoder.ids[encoder.ends[k] : encoder.ends[k + 1]]] for i, j in zip(cut[:-1], cut[1:])]


def thue_morse(n):
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_long_pieces(tokenizer):
    rng = np.random.default_rng(4)
    latin = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(180, 501, 400)]
    thai = ["".join(map(chr, rng.integers(0xE01, 0xE2F, n))) for n in rng.integers(60, 167, 600)]
    runs = [x * n for x in ("a", "=", " ", "\u2500", "\n", "abc", "haha", "\u65e5\u672c\u8a9e") for n in (15, 16, 17, 63, 64, 65, 129, 1000)]
    one = "".join(map(chr, rng.integers(97, 123, 100_000)))
    texts = [" ".join(latin), " ".join(thai), *thai[:50], *runs, one, " ".join(thue_morse(1024)), "x" * 30_001]
    assert ids_of(bpe.Encoder(bpe.default_path()), texts) == [tokenizer.encode_ordinary(t) for t in texts]


def test_pieces_of_equal_hashes_are_told_apart(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "span_hashes", lambda buf, starts, ends: (ends - starts).astype(np.uint64) // np.uint64(3))
    texts = ["some words of equal hashes", "other words, equally long", "some words"]
    e = bpe.Encoder(bpe.default_path())
    for _ in range(2):
        assert ids_of(e, texts) == [tokenizer.encode_ordinary(t) for t in texts]


def test_states_that_go_on_in_another_query(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "STATE_ROWS", 50)
    text = "".join(map(chr, np.random.default_rng(6).integers(97, 123, 500)))
    codec = bpe.encoder(bpe.default_path()).codec
    assert codec._query([text.encode()])[0].tolist() == tokenizer.encode_ordinary(text)


def test_a_step_sorts_no_tokens():
    import pyarrow as pa

    rows = pa.table({"piece": pa.array([0], pa.int32()), "pos": pa.array([0], pa.int32()), "token": pa.array([65], pa.int32()), "tokens": [[65]], "ranks": [[1]]})  # noqa: F841
    plan = bpe.encoder(bpe.default_path()).codec.db.execute("EXPLAIN " + bpe.ENCODE, [9]).fetchall()[0][1].upper()
    assert "CTE" in plan and "HASH JOIN" in plan.replace("_", " ")
    assert "WINDOW" not in plan


def test_short_strings_go_on_from_their_tokens(tokenizer, monkeypatch):
    rng = np.random.default_rng(8)
    strings = ["".join(map(chr, rng.integers(a, a + 26, n))) for a in (97, 0xE01, 0x65E5) for n in range(1, 17)] * 2 + ["a" * n for n in range(1, 65)]
    want = [tokenizer.encode_ordinary(x) for x in strings]
    codec = bpe.encoder(bpe.default_path()).codec
    steps, calls = codec._steps, []
    monkeypatch.setattr(codec, "_steps", lambda n, ids, most: calls.append(most) or steps(n, ids, most))
    for rows in (bpe.STATE_ROWS, 50):
        monkeypatch.setattr(bpe, "STATE_ROWS", rows)
        assert [x.tolist() for x in codec._query([x.encode() for x in strings])] == want
    assert calls.count(2) > 5


def test_ids_in_decimal(tokenizer):
    import pyarrow as pa

    texts = ["", None, "one two", "\n", "!", "0123456789 ABCDEFGHIJ", "\u65e5\u672c\u8a9e", ""]
    want = [tokenizer.encode_ordinary(t or "") for t in texts]
    ids, off, joined = bpe.encode_column(pa.array(texts), bpe.default_path())
    assert [ids[i:j].tolist() for i, j in zip(off[:-1], off[1:])] == want
    assert joined == [",".join(map(str, x)).encode() for x in want]


def test_bpe_ids_decode(odd_docs):
    tokens = bpe.encode(odd_docs)
    got = Counter((r["doc_id"], bytes(r["data"])) for r in bpe.decode(tokens).collect())
    assert got == Counter((r["doc_id"], (r["text"] or "").encode()) for r in odd_docs.collect())
    with pytest.raises(Exception):
        bpe.encoder(bpe.default_path()).codec.decode(np.array([10**8], np.int32), np.array([0, 1]))


def test_pieces_as_the_pattern_has_them():
    import public_tokenizers
    import pyarrow as pa
    import regex
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from tessera.llm.rawtext import text_bytes

    pattern = regex.compile(public_tokenizers.PATTERN)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(alphabet=list("ab'stlredvm  \n\t1½.,!　 é日😀"), max_size=30), min_size=1, max_size=4))
    def check(texts):
        buf, off = text_bytes(pa.array(texts))
        starts = bpe.piece_starts(buf, off)
        ends = [*starts[1:], len(buf)]
        assert [buf[i:j].tobytes().decode() for i, j in zip(starts, ends)] == [p for t in texts for p in pattern.findall(t)]

    check()


# 8


def test_media(docs, rows):
    want = []
    for d, t, *_ in rows:
        data = (t or "").encode()
        p = media.padded(data)
        want.append((d, len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert sorted((tuple(r)[:5] for r in media.stored_features(docs).collect()), key=repr) == sorted(want, key=repr)


def test_png_filters_and_damage():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (48, 24)).astype(np.uint8)
    data = media.encode(image.tobytes())
    assert (media.decode(data) == image).all()
    with pytest.raises(ValueError):
        media.decode(data[:60] + bytes([data[60] ^ 1]) + data[61:])
    # All five filter types, as a plain reader of the format defines them.
    kinds = rng.integers(0, 5, 48)
    lines = np.zeros((48, 25), np.uint8)
    for y in range(48):
        for x in range(24):
            a = int(image[y, x - 1]) if x else 0
            b = int(image[y - 1, x]) if y else 0
            c = int(image[y - 1, x - 1]) if x and y else 0
            e = a + b - c
            paeth = min((a, b, c), key=lambda v: abs(e - v))
            lines[y, x + 1] = (int(image[y, x]) - (0, a, b, (a + b) // 2, paeth)[kinds[y]]) & 255
        lines[y, 0] = kinds[y]
    assert (media.unfilter(lines) == image).all()


# 9


def test_scores_separate(spark):
    good = ["the cat sat on the mat and the dog sat by the door"] * 30
    junk = ["zq xv jj qz vx zzq xxv jqj vzx qqx zjv"] * 30
    df = spark.createDataFrame(list(enumerate(good + junk)), "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(20)], "doc_id long")
    got = {r["doc_id"]: r["score"] for r in wordscores.score(df, ids).collect()}
    assert max(got[i] for i in range(20, 30)) < min(got[i] for i in range(30, 60))  # held out


def words_of(t):
    return re.findall(r"[\U00003000-\U0000DFFF\U00010000-\U0010FFFF]|[0-9A-Za-z\x80-\u2FFF\uE000-\uFFFF]+|[^\x20\x09-\x0D]", t or "")


@pytest.mark.parametrize("chunk", [1, wordscores.CHUNK])
def test_word_scores_against_brute_force(docs, rows, some_labels, chunk, monkeypatch):
    monkeypatch.setattr(wordscores, "CHUNK", chunk)
    ids = {r["doc_id"] for r in wordscores.good_ids(some_labels).collect()}
    count = {False: Counter(), True: Counter()}
    grams = []
    for d, t, *_ in rows:
        w = [None, *words_of(t)]
        grams.append(list(zip(w, w[1:])))
        for kind in {False, d in ids}:
            count[kind].update(grams[-1])
    v = len({w for g in grams for _, w in g})

    def losses(c, scale):
        one, context = Counter(), Counter()
        for (a, b), n in c.items():
            one[b] += n * scale
            context[a] += n * scale
        total, mu = sum(one.values()), wordscores.MU
        return lambda g: -np.log((c[g] * scale + mu * (one[g[1]] + 1) / (total + v)) / (context[g[0]] + mu))

    target, back = losses(count[True], 1), losses(count[False], sum(count[True].values()) / sum(count[False].values()))
    want = sorted(((d, len(g), *([None] * 2 if not g else [round(float(np.mean([f(x) for x in g])), 6) for f in (target, back)])) for (d, *_), g in zip(rows, grams)), key=repr)
    got = wordscores.difference(docs, some_labels).collect()
    assert sorted(((r[0], r[1], *(None if x is None else round(x, 6) for x in r[2:4])) for r in got), key=repr) == want


def test_op9_tells_all_words_apart(spark, tmp_path):
    texts = ["привет мир", "привет мир", "примет мир", "$ $", "$ $", "# #", "Word", "Word", "word", "日本", "日本", "日木", None, " "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in (0, 3, 6, 9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in registry.QUERIES["op9_lm_scoring"](spark, str(tmp_path)).collect()}
    assert all(got[i]["score"] < got[i + 2]["score"] and got[i]["score"] == got[i + 1]["score"] for i in (0, 3, 6, 9))
    assert [got[i]["n_tokens"] for i in (0, 3, 6, 9, 12, 13)] == [2, 2, 1, 2, 0, 0] and got[12]["score"] is None


def test_word_scores_of_no_rows(no_docs, some_labels):
    assert wordscores.difference(no_docs, some_labels).isEmpty()


def test_word_scores_leave_no_shuffled_chunks(spark, sf, some_labels):
    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {(x := files.apply(i)).getName(): x.length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = shuffled()
    df = wordscores.difference(spark.read.parquet(f"{sf}/documents.parquet"), some_labels)
    assert sum(n for name, n in shuffled().items() if name not in before) < 50_000  # the totals alone
    assert spark.conf.get(common.SHUFFLES_GO) == "false" and df.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


# 10


def test_quality_counts(docs, rows, some_labels):
    want = []
    for d, t, *_ in rows:
        w = words(t)
        at = defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        again = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)))
    got = quality.verdicts(docs, some_labels).collect()
    assert sorted((tuple(r)[:7] for r in got), key=repr) == sorted(want, key=repr)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def exact_most(n, level, alpha):
    total, k = Fraction(0), -1
    while k < n:
        total += math.comb(n, k + 1) * alpha ** (k + 1) * (1 - alpha) ** (n - k - 1)
        if total > level:
            return k
        k += 1
    return k


def brute_badness(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words):
    limits = (Fraction(5, 100), word_chars, n_symbols), (Fraction(3, 100), n_words, n_dup_lines), (Fraction(2, 10), n_words, n_repeat_words), (Fraction(12), n_words, word_chars)
    return max(1000, min(50_000, max(math.floor(1000 * x / (limit * size)) if size else 0 for limit, size, x in limits)))


def test_most_rejected(spark):
    from pyspark.sql import functions as F

    n = [1, 148, 149, 216, 217, 300, 1000, 2076]
    for level in (0.05, 0.0125):
        got = spark.createDataFrame([(x,) for x in n], "n long").select("n", quality.most_rejected(F.col("n"), level).alias("k")).collect()
        assert {r["n"]: r["k"] for r in got} == {x: exact_most(x, Fraction(level), Fraction(20, 1000)) for x in n}


def test_verdicts_with_cutoffs(spark):
    """Planted labels: strata with many, few and no labels; repeated, null and unknown ids; ties. Against brute force."""
    rng = np.random.default_rng(11)
    docs, labels = [], []
    for i in range(1400):
        lang = ["en", "de", "xx", None][min(3, int(rng.integers(0, 9)) // 2 if i % 3 else 0)]
        w = [f"w{x}" for x in rng.integers(0, 10_000, 60)]
        junk = int(rng.integers(0, 30)) if rng.random() < 0.06 else 0
        docs.append((i, " ".join(w) + " #" * junk + (" " + "l" * 900 if rng.random() < 0.02 else ""), lang))
        if lang != "xx" or i % 20 == 0:
            labels.append((i, int(junk < 20), 0))
    docs += [docs[3], (None, "a b " * 40, "en"), (5, "other text under one id " * 3 + "#" * 400, docs[5][2]), (2000, None, "en")]
    labels += [labels[0], (None, 1, 0), (99_999, 1, 0), (7, None, 0), (8, 0, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    out = quality.verdicts(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    lang = defaultdict(set)
    for i, _, x in docs:
        lang[i].add(x)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    # All rows of an id are of one language; those of id 5 differ.
    held = defaultdict(lambda: defaultdict(int))
    for r in out:
        if r["doc_id"] in good and not r["base_failed"]:
            (x,) = lang[r["doc_id"]]
            held[x][r["doc_id"]] = max(held[x][r["doc_id"]], brute_badness(*r[1:6]))
    alpha = Fraction(20, 1000)
    tested = {x: sorted(v.values()) for x, v in held.items() if (1 - alpha) ** len(v) <= Fraction(5, 100)}
    cut = {}
    for x, v in tested.items():
        most = exact_most(len(v), Fraction(5, 100) / len(tested), alpha)
        if most >= 0:
            cut[x] = min(c for c in {1000, *v} if sum(y > c for y in v) <= most)
    assert cut and set(cut) < set(held) | {"xx"} and "xx" not in cut
    rejected = 0
    for r in out:
        x = next(iter(lang[r["doc_id"]]))
        kept = not r["base_failed"] and not (x in cut and brute_badness(*r[1:6]) > cut[x])
        assert r["kept"] == kept, r
        rejected += not r["base_failed"] and not kept
    assert rejected > 5
    assert all(r["kept"] != r["base_failed"] for r in quality.verdicts(d, spark.createDataFrame(labels[:40], "doc_id long, quality int, toxic int")).collect())


def test_passing_keeps_columns(docs, some_labels):
    kept = Counter(r["doc_id"] for r in quality.verdicts(docs, some_labels).filter("kept").collect())
    out = quality.passing(docs, some_labels)
    assert out.columns == docs.columns and Counter(r["doc_id"] for r in out.collect()) == kept


def test_queries_are_whole(spark, sf):
    for name in ("op2_warc_round_trip", "op4_url_filter"):
        assert registry.QUERIES[name](spark, sf).count() == common.table(spark, sf, "pages").count()
