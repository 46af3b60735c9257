"""Licences, byte-level BPE, token counts, MPEG audio."""

import hashlib
import random
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, collect, documents, table, words
from tidemark.llm import bpe, counts, licences, mpeg

tokenizers_files = pytest.importorskip("public_tokenizers")


# -- licences ------------------------------------------------------------------------------------------------------------------


HASHED = lambda text, mark="# ": "\n".join((mark + line).rstrip() for line in text.split("\n"))
MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """Copyright 2019 Some One

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = """
3. Neither the name of Some Company, Inc nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
NOTICES = {
    "MIT": [MIT, HASHED(MIT), HASHED(MIT, " * "), "Intro. Released under the MIT License.\nMore text.", "prose\nReleased under the\nMIT License. Prose", "// SPDX-License-Identifier: MIT", "This file is released under the terms of the MIT License.", "The MIT License (MIT)"],
    "Apache-2.0": [APACHE, HASHED(APACHE), HASHED(APACHE, "// "), "Licensed under the Apache License, Version 2.0.", "All code is distributed under the Apache License v2.0", "/* SPDX-License-Identifier: Apache-2.0 */"],
    "GPL-3.0": [GPL, HASHED(GPL), GPL.replace("This program", "Foo").replace("software:", "software;"), "This Work is LICENSED under the GNU\n general public license, Version 3.", "# SPDX-License-Identifier: GPL-3.0-or-later\ncode", "Licensed under GPLv3 or later."],
    "GPL-2.0": [GPL.replace("version 3", "version 2"), "SPDX-License-Identifier: GPL-2.0"],
    "LGPL-2.1": [GPL.replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1")],
    "AGPL-3.0": [HASHED(GPL.replace("GNU General", "GNU Affero General"))],
    "BSD-2-Clause": [BSD, HASHED(BSD), "BSD 2-Clause License\n\n" + BSD],
    "BSD-3-Clause": [BSD + BSD3, HASHED(BSD + BSD3, " * ")],
    "MPL-2.0": ["/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"],
    "ISC": ["Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.\n\nAnyone is free"],
    "Zlib": ["This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n"],
    "EPL-2.0": ["This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/\n"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a thing. Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."],
}
NONE = ["", None, "a license that nobody knows. warranty void", "He was licensed under the old law and permitted to sell.", BSD.split("\n\n")[1] + BSD.split("\n\n")[0], "MIT", "\n\n\n", "license " * 5000]


def test_published_notices(spark):
    texts = [(t, [name]) for name, ts in NOTICES.items() for t in ts] + [(t, []) for t in NONE] + [(f"{MIT}\n----\n{APACHE}\n{BSD}", ["Apache-2.0", "BSD-2-Clause", "MIT"])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string").withColumn("licences", F.lit(0))
    out = collect(licences.scan(df))
    assert [(t, out[i]["licences"]) for i, (t, _) in enumerate(texts)] == texts
    assert licences.scan(table(spark, [])).count() == 0


def test_every_identifier_serves_a_rule_and_passes_the_search():
    used = {i for _, rule in licences.RULES for i in rule}
    assert set(licences.SENTENCES.values()) == used
    import re

    assert all(re.search(licences.STEMS, text) for text in licences.TEXTS.values())
    assert all(re.search(licences.STEMS, f"Licensed under the {n}") for names in licences.LICENCES.values() for n in names)


def test_as_the_sql(spark):
    rng = random.Random(2)
    known = [*licences.SENTENCES, *licences.TEXTS.values(), *(t for ts in NOTICES.values() for t in ts), *(t for t in NONE if t)]
    rows = [(i, rng.choice([". ", ".\n", "; ", "\n", "\n#\n"]).join(rng.choice([rng.choice(known), "Some prose", "A licence, no"]).capitalize() for _ in range(rng.randint(0, 6))) + rng.choice([".", "", "\r\n"])) for i in range(300)]
    rows = [*rows, (300, None)]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {r[0]: (r[1], r[2], r[3]) for r in con.sql(licences.scan_sql()).fetchall()}
    assert {r["doc_id"]: (len(r["sentence_ids"]), ",".join(map(str, r["sentence_ids"])), ";".join(r["licences"])) for r in got} == want


# -- tokens --------------------------------------------------------------------------------------------------------------------

RANKS = tokenizers_files.path("byte_bpe_50k.tiktoken")
VOCAB = tokenizers_files.path("word_bpe_49k.json")
ODD = ["a", "A", "é", "Σ", "ΑΣ", "İ", "ß", "<|endoftext|>", "<|startoftext|>", " ", "\n", "\x1c", "\x85", "　", "1", "٣", "Ⅳ", "!!", "'s", "'S", "’", "漢字", "😀", "é", "ﬁ", "aaaa", "===", "\x00", "​", "ǅ", " " * 5000, "\n" * 4200, "x" * 70000, " word" * 15000]


def strings(seed, n=300):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD if rng.random() < 0.1 else ODD[:-4]) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_encoding_is_the_librarys(spark):
    enc = bpe.encoding(RANKS, tokenizers_files.PATTERN)
    texts = [None, *strings(4), *(r[1] for r in documents())]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("token_ids", F.lit(1)).withColumn("decoded", F.lit(1))
    back = bpe.decode_ids(bpe.encode_texts(df, RANKS, tokenizers_files.PATTERN, round_trip="same"), RANKS, tokenizers_files.PATTERN)
    out = collect(back)
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        assert out[i]["token_ids"] == enc.encode_ordinary(t or "")
        assert bytes(out[i]["decoded"]) == (t or "").encode() and out[i]["same"]
    assert bpe.encode_texts(table(spark, []), RANKS, tokenizers_files.PATTERN).count() == 0


def test_a_run_that_the_librarys_engine_gives_up_on():
    enc = bpe.encoding(RANKS, tokenizers_files.PATTERN)
    text = " " * 1_500_000 + "a" + "\n" * 1_200_000
    assert enc.decode_bytes(bpe.encode(enc, text)) == text.encode()


def test_counts_are_the_librarys(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCAB)
    texts = [None, *strings(7), *(r[1] for r in documents()), "ab" * 40_000, "a" * 5001, words(random.Random(1), 12_000).replace(" ", "")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("old"))
    out = collect(counts.count_tokens(df, VOCAB))
    for i, t in enumerate(texts):
        assert out[i]["n_tokens"] == len(library.encode(t or "", add_special_tokens=False).ids), repr(t)[:80]
    assert counts.count_tokens(table(spark, []), VOCAB).count() == 0


@pytest.mark.parametrize("n", [2047, 2048, 2049, 5000])
def test_counts_of_long_words(n):
    from tokenizers import Tokenizer

    library, merge, rng = Tokenizer.from_file(VOCAB), counts.RankMerger(VOCAB), random.Random(n)
    texts = ["-" * n, "a" * n, "=-" * (n // 2), "".join(rng.choice("abcdefghijkl") for _ in range(n)), "\x01" * n, "漢" * n, "https://a.b/" + "/".join(["x"] * n), "-" * n + " " + "-" * n]
    assert merge.count_texts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_counts_of_a_megabyte_of_one_character():
    from tokenizers import Tokenizer

    library, merge = Tokenizer.from_file(VOCAB), counts.RankMerger(VOCAB)
    for c in "-a":
        assert merge.count_texts([c * (1 << 20)]) == [len(library.encode(c * (1 << 20), add_special_tokens=False).ids)]


# -- MPEG audio ----------------------------------------------------------------------------------------------------------------


def frame(kbps_index=9, fill=b"", guarded=True, layer=3):
    start = mpeg._start(kbps_index, guarded)
    size = mpeg.header(start[:4]).size
    return start + fill[: size - len(start)].ljust(size - len(start), b"\0")


def test_round_trip(spark):
    rows = documents()
    df = table(spark, rows).withColumn("media", F.lit(1)).withColumn("audio", F.lit(1))
    out = collect(mpeg.parse_media(mpeg.store_texts(df)))
    for i, text, *_ in rows:
        data, a = (text or "").encode(), out[i]["audio"]
        payload = bytes(a["payload"])
        assert payload == mpeg.padded(data) and len(payload) % 64 == 0 and len(payload) >= max(64, len(data))
        assert a["crc_bad"] == 0 and a["crc_good"] == a["frames"] == a["vbr_frames"] and a["skipped_bytes"] == 0
        assert a["samples"] == 1152 * a["frames"] and a["sample_rate"] == 48000 and len(a["frame_offsets"]) == a["frames"] and len(a["vbr_toc"]) == 100
        media = bytes(out[i]["media"])
        assert all(media[o] == 0xFF for o in a["frame_offsets"])
    assert mpeg.parse_media(mpeg.store_texts(table(spark, []))).count() == 0


def test_any_bytes_round_trip():
    rng = random.Random(9)
    for n in (0, 1, 63, 937, 938, 5000):
        payload = rng.randbytes(n)
        assert mpeg.parse(mpeg.store(payload))["payload"] == payload


def test_resync_tags_and_checksums():
    good = [frame(9, bytes([i] * 50)) for i in range(4)]
    broken = bytearray(good[1])
    broken[4] ^= 1
    id3v1 = b"TAG" + b"Title".ljust(30, b"\0") + b"Who".ljust(30, b"\0") + b"Album".ljust(30, b"\0") + b"\0" * 35
    ape_item = struct.pack("<II", 5, 0) + b"Genre\0" + b"Noise"
    ape = ape_item + b"APETAGEX" + struct.pack("<IIII", 2000, len(ape_item) + 32, 1, 0) + bytes(8)
    found = mpeg.parse(b"junk\xff\xfbjunk" + good[0] + bytes(broken) + b"\xff\xff\x00gap" + good[2] + good[3] + ape + id3v1)
    assert (found["frames"], found["crc_good"], found["crc_bad"]) == (4, 3, 1)
    assert found["skipped_bytes"] == 10 + 6
    assert found["tags"] == {"TIT2": "Title", "TPE1": "Who", "TALB": "Album", "Genre": "Noise"}
    assert found["samples"] == 4 * 1152 and found["payload"] is None
    cut = mpeg.parse(good[0] + good[1][:50])
    assert cut["frames"] == 1 and cut["skipped_bytes"] == 50
    foreign_tag = b"TXXX" + mpeg._to_syncsafe(16) + b"\0\0" + b"\x03payload_bytes\0" + "²".encode()
    for nothing in (None, b"", b"no audio here", b"\xff" * 100, good[0][:4] + bytes(900), b"ID3\4\0\0" + mpeg._to_syncsafe(len(foreign_tag)) + foreign_tag, bytes(40) + b"APETAGEX" + struct.pack("<IIII", 2000, 60, 1 << 31, 0) + bytes(8)):
        assert mpeg.parse(nothing)["frames"] == 0 and mpeg.parse(nothing)["payload"] is None


def test_headers_of_all_kinds():
    for version, bits in (("1", 3), ("2", 2), ("2.5", 0)):
        for layer in (1, 2, 3):
            head = mpeg.header(bytes([0xFF, 0xE0 | bits << 3 | (4 - layer) << 1 | 1, 5 << 4, 0]))
            assert (head.version, head.layer, head.guarded, head.channels) == (version, layer, False, 2)
            want = {1: 384, 2: 1152, 3: 1152 if version == "1" else 576}[layer]
            assert head.samples == want
            seconds = head.samples / head.rate
            assert abs(head.size - seconds * head.kbps * 125) <= 4
    assert mpeg.checksum(bytes(2)) == mpeg.checksum(bytes(2)) != mpeg.checksum(b"\0\1")


def test_vbri():
    body = bytearray(frame(9, guarded=False))
    body[36:62] = b"VBRI" + bytes(6) + struct.pack(">IIHHH", 5000, 12, 2, 1, 2) + bytes(2)
    body[62:66] = struct.pack(">HH", 300, 400)
    found = mpeg.parse(bytes(body) + frame(9) * 2)
    assert (found["vbr_kind"], found["vbr_frames"], found["vbr_bytes"], found["vbr_toc"], found["frames"]) == ("VBRI", 12, 5000, [300, 400], 2)


def test_equal_texts_equal_media(spark):
    df = spark.createDataFrame([(1, "same", None, None, None), (2, "same", "x", "y", 4)], SCHEMA)
    a, b = mpeg.store_texts(df).collect()
    assert hashlib.sha256(a["media"]).digest() == hashlib.sha256(b["media"]).digest()


def test_foreign_vbri_tables(spark):
    """Tables of any widths, scales and counts: a row each, entries as they are for widths 1 to 4 and none for others."""
    rng, rows, want = random.Random(4), [], []
    for width in (0, 1, 2, 3, 4, 5, 8, 1000, 65535):
        for entries, scale in ((1, 1), (3, 65535), (200, 7)):
            body = rng.randbytes(1000)
            table_frame = bytearray(frame(9, rng.randbytes(20)))
            table_frame[36 : 36 + 26] = b"VBRI" + bytes(6) + struct.pack(">IIHHHHH", 12345, 1 << 31, entries, scale, width, 1, 0)[:16]
            table_frame[62:] = body[: len(table_frame) - 62]
            rows.append((len(rows), bytes(table_frame) + frame(9, b"x") * 3))
            left = body[: min(entries * width, len(table_frame) - 62)]
            want.append([int.from_bytes(left[i : i + width]) * scale for i in range(0, len(left) - width + 1, width)] if 1 <= width <= 4 else [])
    out = collect(mpeg.parse_media(spark.createDataFrame(rows, "doc_id long, media binary")))
    assert [out[i]["audio"]["vbr_toc"] for i in range(len(rows))] == want
    assert all(r["audio"]["vbr_kind"] == "VBRI" and r["audio"]["frames"] == 3 for r in out.values())


def test_any_bytes_parse(spark):
    rng, whole = random.Random(9), mpeg.store(b"y" * 4000)
    rows = []
    for i in range(300):
        data = bytearray(whole)
        for _ in range(rng.randint(1, 40)):
            data[rng.randrange(len(data) if i % 2 else 400)] = rng.randrange(256)
        rows.append((i, bytes(data[rng.randint(0, 100) * (i % 3) :])))
    assert mpeg.parse_media(spark.createDataFrame(rows, "doc_id long, media binary")).select("doc_id", "audio.frames").count() == 300


def test_a_payload_that_looks_like_a_tag():
    seen = set()
    for n in (200, 640, 1000, 3000):
        for mark, back in ((b"TAG", 128), (b"APETAGEX", 32)):
            made = mpeg.store(b"S" * n)
            payload = bytearray(b"S" * n)
            pad = len(made) - 1 - made.rindex(b"S")
            if (at := n - (back - pad)) < 0 or at + len(mark) > n:
                continue
            payload[at : at + len(mark)] = mark
            stream = mpeg.store(bytes(payload))
            if not stream[-back:].startswith(mark):  # a frame's head stands there
                continue
            seen.add(mark)
            got = mpeg.parse(stream)
            assert got["payload"] == bytes(payload) and got["skipped_bytes"] == 0 and got["crc_bad"] == 0
            tagged = mpeg.parse(mpeg.store(b"S" * n) + b"TAG" + b"title".ljust(125, b"\0"))
            assert tagged["tags"]["TIT2"] == "title" and tagged["payload"] == b"S" * n and tagged["skipped_bytes"] == 0
    assert len(seen) == 2


def test_layer_two_checksums():
    """Version 1, layer II, 48,000 samples a second, mono, 64 kilobits: 27 subbands, 88 bits of allocation; the first has one, so two more bits."""
    head, body = bytes([0xFF, 0xFC, 0x44, 0xC0]), bytearray(186)
    body[0] = 0x10
    bits = "".join(f"{x:08b}" for x in head[2:]) + "".join(f"{x:08b}" for x in body)[: 11 * 4 + 12 * 3 + 4 * 2 + 2]
    crc = 0xFFFF
    for b in bits:
        top = crc >> 15 ^ int(b)
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    frame = head + crc.to_bytes(2) + bytes(body)
    got = mpeg.parse(frame * 2 + head + (crc ^ 1).to_bytes(2) + bytes(body))
    assert (got["frames"], got["crc_good"], got["crc_bad"]) == (3, 2, 1)
