"""Corpus operators against brute force, libraries and round trips; nulls, empty and long texts, ties, repeats, empty tables."""

import random

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import bpe, decontaminate, html, licenses, pieces, pii, shingles, simhash, suffix, toxicity, webp

ODD = [None, "", " ", "a", "a\x00b", "▁x ", "İ ΣΑΣ X'starts it's", "a  b\n\n<s>é́ <0x0A> 😀\n", "<|endoftext|>x", "x" * 5000, "word " * 3000, "a", "�"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra int"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in enumerate(texts)], DOCS)


def test_pii(spark):
    texts = [*ODD, "mail é a.b@c.de, ip 1.2.3.4 and 1.2.3.400", "card 4111 1111 1111 1111 phone +1 (988) 555-2485", "x@y.z@w.v"]
    rows = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.base] for r in pii.find_pii(docs_of(spark, texts)).collect()}
    n = len(ODD)
    assert rows[n] == [("email", 7, 15), ("ip", 20, 27)]
    assert [k for k, *_ in rows[n + 1]] == ["card", "phone"] and rows[n + 1][0] == ("card", 5, 24)
    assert rows[n + 2] == [("email", 0, 5)] and rows[0] == []
    clean = pii.redact(docs_of(spark, texts)).where(f"doc_id = {n}").first()
    assert clean.text.startswith("mail é <EMAIL>, ip <IP>") and clean.extra == 1
    assert pii.find_pii(docs_of(spark, texts).limit(0)).count() == 0


def test_simhash_components(spark):
    random.seed(3)
    words = [f"w{i}" for i in range(500)]
    texts = [*ODD]
    for _ in range(6):
        base = [random.choice(words) for _ in range(300)]
        for k in range(25):
            t = list(base)
            for _ in range(k % 5):
                t[random.randrange(300)] = random.choice(words)
            texts.append(" ".join(t))
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    fp = np.array([np.uint64(got[i].fp & (2**64 - 1)) for i in range(len(texts))])
    root = list(range(len(texts)))
    for _ in texts:  # to a fixed point
        for i in range(len(texts)):
            near = np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 4)
            root[i] = min(root[j] for j in near)
    assert [got[i].component_id for i in range(len(texts))] == root
    assert simhash.fingerprint("A b") == np.uint64(xxhash.xxh64_intdigest(b"a b", 42)).view(np.int64)
    kept = simhash.keep_first(docs_of(spark, texts))
    assert kept.count() == len(set(root)) and "extra" in kept.columns


def test_near_copies_of_five_words(spark):
    random.seed(8)
    words = [f"w{i}" for i in range(500)]
    texts = [*ODD]
    for _ in range(40):  # clouds around a base, with up to four changed words in 60 to 250
        base = [random.choice(words) for _ in range(random.randrange(60, 250))]
        for k in range(6):
            t = list(base)
            for _ in range(k % 5):
                t[random.randrange(len(t))] = random.choice(words)
            texts.append(" ".join(t))
    t = [random.choice(words) for _ in range(88)]
    texts += [" ".join(t), " ".join(t[1:40] + t[:1] + t[40:])]  # one moved word
    sets = []
    for text in texts:
        w = (text or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    alike = [[j for j, b in enumerate(sets) if (len(a & b) >= 0.8 * len(a | b))] for a in sets]
    for _ in texts:  # to a fixed point
        root = [min(root[j] for j in alike[i]) for i in range(len(texts))]
    got = {r.doc_id: r.component_id for r in shingles.near_copies(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == root and root[-1] == len(texts) - 2
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs_of(spark, texts), None).collect()}
    assert kept == set(root)
    assert shingles.near_copies(docs_of(spark, texts).limit(0)).count() == 0


def test_near_copies_of_many_variants(spark, monkeypatch):
    """Variants of one text, most too far from each other to be linked: the pairs verified grow with the documents, not with their square."""
    random.seed(9)
    base = [f"w{i}" for i in range(150)]
    variants = []
    for k in range(400):
        t = list(variants[-1] if k % 40 == 1 else base)  # some are near another variant only
        for _ in range((1, 2, 5, 6, 7, 8)[k % 6] if k % 40 != 1 else 1):
            t[random.randrange(len(t))] = f"v{random.randrange(10**6)}"
        variants.append(t)
    texts = [" ".join(t) for t in variants]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in variants]
    root = list(range(len(texts)))
    alike = [[j for j, b in enumerate(sets) if len(a & b) >= 0.8 * len(a | b)] for a in sets]
    while (new := [min(root[j] for j in alike[i]) for i in range(len(texts))]) != root:
        root = new
    asked, verified = [], shingles._verified

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(shingles, "_verified", counted)
    got = {r.doc_id: r.component_id for r in shingles.near_copies(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == root and 20 < len(set(root)) < 380
    assert sum(asked) <= shingles.BANDS * len(texts)


def test_near_copies_by_simhash_alone(spark, monkeypatch):
    """Without any band, Hamming balls over the sets' SimHashes still link what is within 4 bits, and the exact similarity still decides."""
    random.seed(10)
    long = [f"w{random.randrange(5000)}" for _ in range(3000)]
    texts = ["", " ".join(long), " ".join([*long[:1500], "changed", *long[1501:]]), " ".join(f"w{random.randrange(5000)}" for _ in range(3000)), "a b c"]
    assert [shingles.sketch(shingles.shingles(t)) for t in ("", "a b")] == [0, simhash.fingerprint("a b")]
    filed = shingles._filed
    monkeypatch.setattr(shingles, "_filed", lambda docs, words: filed(docs, words).withColumn("keys", F.expr("cast(array() as array<long>)")))
    assert {r.doc_id: r.component_id for r in shingles.near_copies(docs_of(spark, texts)).collect()} == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4}


def test_decontamination(spark):
    item = "In the town of Springfield Anna buys 12 kg of apples and 7 pears before she walks back to the old mill by the river"
    again = item.replace("Anna", "Bella").replace("12", "31").replace("7", "9")
    bench = spark.createDataFrame([(0, item), (1, None), (2, "two words"), (3, "")], "item_id long, text string")
    texts = [*ODD, f"Some prose first. {item}. And after.", f"x {again} y", "apples and pears by the river of the old town", "say two words now"]
    n = len(ODD)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs_of(spark, texts), bench).collect()}
    assert got == {(n, 0), (n + 1, 0), (n + 3, 2)}
    assert decontaminate.drop_contaminated(docs_of(spark, texts), bench).count() == len(texts) - 3
    assert decontaminate.contaminated(docs_of(spark, texts), bench.limit(0)).count() == 0


def test_decontamination_of_separated_numbers(spark):
    item = "A baker sells one loaf for 2.50 and 1,200 rolls at 10:30 with 3/4 of the flour while the van goes 45.5 km/h to 1.75 markets on 01/02/2024, then rests"
    again = item.replace("2.50", "3.8").replace("1,200", "900").replace("10:30", "9").replace("3/4", "1/2").replace("45.5", "1,045.25").replace("1.75", "12").replace("01/02/2024", "3/11/2025")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    texts = [item, f"So. {again} and more", item.replace(" one loaf", " 1,000.00 loaves").replace("2.50 and", "2.50 or"), "v1.2 has 5 km/h, 7 m/s or 3 kg/box and 1..2, 12. Then \u0004x 1,234,567.89kg"]
    got = {r.doc_id: r for r in decontaminate.contaminated(docs_of(spark, texts), bench).collect()}
    assert got[0].coverage == got[1].coverage == 1.0 and got[1].matched == got[1].windows and got[1].consistent == 1.0
    w = docs_of(spark, texts).where("doc_id = 3").select(decontaminate.tokens().alias("w")).first().w
    number, unit, sep = "\u0002", "\u0003", "\u0004"
    assert w == ["v1", f"{number}2", "has", f"{number}5", f"{unit}km{sep}h", f"{number}7", f"{unit}m{sep}s", "or", f"{number}3", f"{unit}kg", "box", "and", f"{number}1{sep}2", f"{number}12", "then", "x", f"{number}1{sep}234{sep}567{sep}89", f"{unit}kg"]


def test_licences(spark):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "code"), ("a/b/c/y.py", "Licensed under the Apache License, Version 2.0.\ncode code code code"), ("d/z.py", None), (None, ""), ("a/x", "a licence to be silly about things")]
    df = spark.createDataFrame([(i, *f) for i, f in enumerate(files)], "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan(df, licenses.templates(spark)).collect()}
    assert got == {0: ("MIT", "own"), 1: ("MIT", "inherited"), 2: ("Apache-2.0", "own"), 3: (None, "none"), 4: (None, "none"), 5: ("MIT", "inherited")}


def test_wrapped_licences(spark):
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n\n"
    bsd = "/*\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:\n */\n"
    lgpl = "// This library is free software; you can redistribute it and/or\n// modify it under the terms of the GNU Lesser General Public\n// License as published by the Free Software Foundation; either\n// version 2.1 of the License, or (at your option) any later version.\n"
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */\n"
    grant = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
    notice = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rest = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
    mit = "MIT License\n\nCopyright (c) 2020 A. Nobody\n\n" + "\n\n".join(x.replace(" of ", " of\n").replace("is hereby", "is\nhereby") for x in (grant, notice, rest))
    code = "x = 1\n" * 80
    files = [("g/a.py", gpl + code), ("b/a.c", bsd + code), ("l/a.c", lgpl + code), ("m/a.c", mpl + code), ("t/LICENSE", mit), ("t/u/x.py", "code"), ("f/full", mit), ("f/x.py", "code"), ("o/a.py", grant + "\n" + code)]
    files += [("p/a", "this thing was released under the MIT License, so take what you like and go on with your day"), ("p/b", "it was released under the Foo License, so take care"), ("p/c", gpl.replace("version 3", "version 2") + code)]
    files += [("w/only", mpl), ("w/x", "code")]
    df = spark.createDataFrame([(i, *f) for i, f in enumerate(files)], "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan(df, licenses.templates(spark)).collect()}
    want = [("GPL-3.0", "own"), ("BSD-3-Clause", "own"), ("LGPL-2.1", "own"), ("MPL-2.0", "own"), ("MIT", "own"), ("MIT", "inherited"), ("MIT", "own"), ("MIT", "inherited"), ("MIT", "own"), ("MIT", "own"), (None, "none"), (None, "none"), ("MPL-2.0", "own"), ("MPL-2.0", "inherited")]
    assert [got[i] for i in range(len(files))] == want
    assert all(licenses.words_of(r.wording) == r.w for r in licenses.templates(spark).select("wording", licenses.terms(licenses.F.col("wording")).alias("w")).collect())


def test_counts_match_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    count = bpe.TokenCounter(path)
    texts = [t or "" for t in ODD]
    assert count.many(texts) == [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert count.many(texts) == count.many(texts)


def test_pieces_merged_in_step_match_one_agenda_each():
    p = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(5)
    keys = ["".join(rng.choice(["th", "ing", "é", "a", "aa", "ß", "x", ",", "#", "\u4e00", "tion"], int(rng.integers(1, 14)))) for _ in range(3000)] + ["", "\n", "\nthe", "a" * 30, "a" * 31, "th" * 400]
    got = dict(p.codes(keys))
    p.compare()
    for k in keys:
        ids = p.merge(k if k[:1] == "\n" else pieces.SPACE + k)
        assert got[k] == (np.array(ids, "<u4").tobytes(), p.plain(ids))
    p.codes(["the"]).__next__()
    p.fresh[0][1][0] += 1
    with pytest.raises(ValueError, match="otherwise"):
        p.compare()


def test_pieces_match_the_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in pieces.encode_decode(docs_of(spark, ODD), path).collect()}
    for i, t in enumerate(ODD):
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        assert got[i].ids == ids and got[i].decoded == lib.decode(ids)


def test_webp_round_trip():
    texts = [*ODD, "é" * 13000, "".join(map(chr, range(32, 2000)))]
    for (stored, px, n), t in zip(webp.media_rows(texts), texts):
        assert px.tobytes() == webp.payload_of(t)[0] and n == len((t or "").encode())
        first = stored[: 8 + int.from_bytes(stored[4:8], "little")]
        assert webp.read_webp(first)[..., 1:].astype(np.uint8).tobytes() == webp.payload_of(t)[0][: webp.TILE]
    with pytest.raises(ValueError):
        webp.read_webp(b"RIFF")


def test_webp_writes_references():
    random.seed(12)
    words = [f"word{i} " for i in range(300)]
    some = "".join(random.choice(words) for _ in range(900))
    texts = ["ab" * 9000, "x" * 12288, some + some, "".join(chr(random.randrange(32, 127)) for _ in range(5000)), *["line of one text\n" * k for k in range(1, 60, 7)], ""]
    for (stored, px, _), t in zip(webp.media_rows(texts), texts):
        assert px.tobytes() == webp.payload_of(t)[0]
    tiles = [webp.payload_of(t)[0][: webp.TILE] for t in texts]
    files, plain = webp.write_tiles(tiles), webp.write_literals(tiles)
    assert all(len(a) <= len(b) for a, b in zip(files, plain)) and len(files[0]) * 4 < len(plain[0]) and len(files[2]) < len(plain[2])
    for f, t in zip(files, tiles):  # the pixel by pixel reader sees the same
        assert webp.read_webp(f)[..., 1:].astype(np.uint8).tobytes() == t


def test_webp_writes_every_step_that_shortens_a_tile():
    rng = np.random.default_rng(2)
    n = 64 * 40
    values, at = rng.integers(0, 256, n), np.arange(n)
    colours = rng.integers(0, 256, (300, 3))
    rows = {  # what a tile of such pixels begins with: no transform and a cache, or the kind of its first transform
        "cache": colours[np.minimum(rng.geometric(0.01, n), 299)],
        "predictor": np.stack([at // 3, at // 2 + 7, at], 1),
        "cross": np.stack([2 * values + rng.integers(0, 4, n), values, -values], 1),
        "green": np.stack([values + rng.integers(0, 2, n), values, values], 1),
        "palette": colours[(rng.random(n) < 0.1).astype(int)],
    }
    tiles = [(v % 256).astype(np.uint8).tobytes() for v in rows.values()]
    files = webp.write_tiles(tiles)
    found = []
    for f in files:
        b = webp.Bits(f[21:])
        b.read(32)
        found.append(("predictor", "cross", "green", "palette")[b.read(2)] if b.read(1) else "cache" if b.read(1) else "none")
    assert found == [*rows]
    assert [x.tobytes() for x in webp.read_tiles(files)] == tiles
    assert all(len(f) < len(g) for f, g in zip(files, webp.write_literals(tiles)))
    for t in [*tiles, b" " * 192, bytes(range(192))]:  # each way of writing, read pixel by pixel
        made = [webp._write_cached(t), webp._write_palette(t), *(webp._write_transformed(t, g, p, c) for g in (0, 1) for p in (0, 1) for c in (0, 1))]
        assert all(webp.read_webp(f)[..., 1:].astype(np.uint8).tobytes() == t for f in made if f)


def test_webp_transforms_references_and_cache():
    """A stream put together by hand: subtract green, a colour cache, a back-reference; then the inverses one by one."""
    v, n = 0, 0

    def put(x, k):
        nonlocal v, n
        v |= x << n
        n += k

    put(7, 14), put(0, 14), put(0, 4)  # 8 by 1
    put(1, 1), put(2, 2), put(0, 1)  # subtract green
    put(1, 1), put(1, 4), put(0, 1)  # a colour cache of 2; one group
    lengths = [0] * 282
    key = (0x1E35A7BD * 0xFF010203 & 0xFFFFFFFF) >> 31
    for s in (2, 256 + 2, 280 + key):
        lengths[s] = 2
    lengths[3] = 2
    put(0, 1), put(1, 4)  # five code lengths: 17, 18, 0, 1, 2
    for k in (0, 2, 2, 0, 1):
        put(k, 3)
    put(0, 1)
    code = {18: (0b11, 2), 0: (0b01, 2), 2: (0b0, 1)}  # canonical: 2 -> 0, 0 -> 10, 18 -> 11, first bit lowest

    def zeros(k):
        while k:
            m = min(k, 138)
            if m >= 11:
                put(*code[18]), put(m - 11, 7)
            else:
                for _ in range(m):
                    put(*code[0])
            k -= m

    at = 0
    for s in sorted(k for k, x in enumerate(lengths) if x):
        zeros(s - at), put(*code[2])
        at = s + 1
    zeros(282 - at)
    put(0b101 | 1 << 3, 11), put(0b101 | 3 << 3, 11), put(0b101 | 255 << 3, 11), put(0b101 | 1 << 3, 11)  # red 1, blue 3, alpha 255, distance 2
    order = {s: i for i, s in enumerate(sorted(k for k, x in enumerate(lengths) if x))}
    sym = lambda s: put({0: 0, 1: 2, 2: 1, 3: 3}[order[s]], 2)
    sym(2), sym(280 + key), sym(3), sym(258), sym(2), sym(3)  # literal, cache, literal, three from the left neighbour (code 2), two literals
    data = b"\x2f" + v.to_bytes((n + 7) // 8, "little")
    px = webp.read_webp(b"RIFF" + (12 + len(data)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data)
    a, b = [255, 3, 2, 5], [255, 4, 3, 6]
    assert px[0].tolist() == [a, a, b, b, b, b, a, b]
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (9, 7, 4))
    for mode in range(14):
        resid = image.copy()
        rows = image.tolist()
        for y in range(9):
            for x in range(7):
                left = rows[y][x - 1] if x else None
                p = ([255, 0, 0, 0] if not x else left) if not y else rows[y - 1][0] if not x else webp._predict(mode, left, rows[y - 1][x], rows[y - 1][x + 1] if x < 6 else rows[y][0], rows[y - 1][x - 1])
                resid[y, x] = [(c - d) & 255 for c, d in zip(rows[y][x], p)]
        assert (webp.undo_predictor(resid, np.full((3, 2), mode), 2) == image).all()
    flat = webp.undo_cross_colour(image, np.zeros((3, 2, 4), np.int64), 2)
    assert (flat == image).all()


def test_toxicity(spark):
    texts = [f"the day was fine {i}" + (" you utter zorgling fool, idiot" if i % 4 == 0 else "") for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(0, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs_of(spark, texts), labels)
    assert "zorgling" in model[0]
    got = {r.doc_id: r.score for r in toxicity.score(docs_of(spark, [*texts[:8], *ODD]), model).collect()}
    assert got[0] > 0.7 and got[4] > 0.7 and max(got[i] for i in (1, 2, 3, 8, 9)) < 0.3
    g = toxicity.Grammar({})
    assert sum(g.clauses("he is not an idiot")) < sum(g.clauses("he is an idiot")) and sum(g.clauses("they said idiot")) < sum(g.clauses("you idiot"))
    assert toxicity.train(docs_of(spark, texts).limit(0), labels)[0] == {}


def test_suffix_arrays():
    random.seed(2)
    for _ in range(150):
        n, k = random.randint(0, 50), random.choice([1, 2, 3, 200])
        t = np.array([random.randrange(k) for _ in range(n)], np.int16)
        sa = suffix.suffix_array(t)
        assert sa.tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


def check_repeats(spark, texts, **how):
    got = {r.doc_id: r for r in suffix.remove_repeats(docs_of(spark, texts), **how).collect()}
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for t in raw:
        for i in range(len(t) - 399):
            seen[t[i : i + 400]] = seen.get(t[i : i + 400], 0) + 1
    for i, t in enumerate(raw):
        cover = np.zeros(len(t), bool)
        for p in range(len(t) - 399):
            if seen[t[p : p + 400]] > 1:
                cover[p : p + 400] = True
        assert bytes(got[i].kept) == bytes(np.frombuffer(t, np.uint8)[~cover]), i
        assert len(got[i].spans) == int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())


def test_repeats_against_brute_force(spark):
    random.seed(4)
    text = lambda n: "".join(random.choice("abcdé ") for _ in range(n))
    a, b = text(900), text(700)
    texts = [*ODD, text(300) + a + text(300), a[100:] + text(50), b, b, b[:399], text(200) + a[200:620] + b[:410] + text(10), "ab" * 700]
    check_repeats(spark, texts)
    assert suffix.remove_repeats(docs_of(spark, texts).limit(0)).count() == 0


def test_repeats_of_split_keys(spark):
    random.seed(5)
    text = lambda n: "".join(random.choice("abcd ") for _ in range(n))
    texts = []
    for n in (230, 370, 385, 396, 399, 400, 403, 460):
        shared = text(n)
        texts += [text(random.randrange(250)) + shared + text(random.randrange(250)) for _ in range(7)]
        texts += [shared, shared + "x", "x" + shared, texts[-1][3:], texts[-1] + texts[-2]]
    check_repeats(spark, texts, most=3)


def test_picks_of_long_texts(monkeypatch):
    raw = np.random.default_rng(6).integers(97, 100, 20_000).astype(np.uint8).tobytes()
    whole = suffix.occurrences(raw)
    monkeypatch.setattr(suffix, "STRIDE", 1500)
    assert all((x == y).all() for x, y in zip(whole, suffix.occurrences(raw)))


def test_html(spark):
    page = (
        '<html><head><title>no</title><script>var t="</p>";</script></head><body><nav>menu</nav><header>top</header><div class="ad">buy</div><article><h1>Head &amp; line</h1>'
        "<p>First  paragraph, with\n<b>bold</b> text,<br>and more of it, long enough to count.<p>Second one, also fairly long, for the score.<div class='comments'>nice!</div></article><aside>x</aside><footer>f</footer>"
    )
    assert html.main_text(page) == "Head & line First paragraph, with bold text, and more of it, long enough to count. Second one, also fairly long, for the score."
    assert html.main_text(None) == html.main_text("") == html.main_text("<p") [:0] == ""
    assert html.main_text("<div>" * 3000 + "deep text that is long enough, it is" + "</div>" * 3000) == "deep text that is long enough, it is"
    df = spark.createDataFrame([(1, "u", page), (2, None, None)], "page_id long, url string, html string")
    assert [r.n_chars for r in html.extract(df).orderBy("page_id").collect()] == [len(html.main_text(page)), 0]


def test_pipeline_runs(spark, tmp_path):
    random.seed(1)
    prose = lambda: " ".join(random.choice("red green blue of and the sun moon".split()) + str(random.randrange(9)) for _ in range(60))
    texts = [prose() for _ in range(40)]
    texts += [texts[0], texts[1] + " call a.b@c.de"]
    docs_of(spark, texts).drop("extra").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, texts[5])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 0 in got and 40 not in got and 5 not in got and len(got) >= 38
