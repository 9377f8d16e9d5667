"""Training-data operators against brute force, round trips and held-out labels, and odd inputs."""

from __future__ import annotations

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import decontaminate, license_scan, line_dedup, media_avi, ngram_join, packing, pii, quality_crf, queries, substring_dedup, token_counts
from quern.llm.common import connected_components

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Extra columns whose names the operators use inside.
EXTRA = ("n", "unit", "sim", "key", "words", "line", "gone", "row", "form", "d1", "prefix", "node", "gram", "label", "score", "terms", "at", "seed")


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for c in EXTRA if extra else ():
        df = df.withColumn(c, F.lit("x"))
    return df


def nz(x):
    return -1 if x is None else x


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


ODD = [(1, None), (None, "some text with a null id, some text with a null id"), (2, ""), (3, " \n\t "), (4, "x" * 50_000), (5, "same line of many words here"), (5, "same line of many words here"), (6, "same line of many words here"), (7, "é́ ß İ   <|endoftext|> <|startoftext|>")]


@pytest.fixture
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture
def none(spark):
    return frame(spark, []).limit(0)


# --- token counts ------------------------------------------------------------------------
def test_token_counts(spark, odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_counts.tokenizer_path("byte_bpe_50k.json"))
    for df in (docs(spark), odd):
        got = sorted((nz(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(df).collect())
        rows = [(nz(r.doc_id), r.text or "") for r in df.collect()]
        assert got == sorted((i, len(t.encode()), n := len(tok.encode(t, add_special_tokens=False).ids), n > 1024) for i, t in rows)
    assert token_counts.token_counts(none).count() == 0


def test_safe_split():
    random.seed(1)
    for _ in range(300):
        t = "".join(random.choice("ab1. \n\t<|endoftext|>é,'s") for _ in range(random.randint(0, 400)))
        pieces = token_counts.split_safely(t, 20)
        assert "".join(pieces) == t
        path = token_counts.tokenizer_path("byte_bpe_50k.json")
        assert sum(token_counts.count_batch(pieces, path)) == token_counts.count_batch([t], path)[0]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_token_counts_of_other_files(spark, name):
    assert token_counts.token_counts(docs(spark), name).where("n_tokens > 0").count() == 200


def test_split_of_text_without_blanks():
    random.seed(12)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = token_counts.tokenizer_path(name)
        t = "".join(random.choice("天地玄黄宇宙洪荒日月あアー、。，！?a \u0301") for _ in range(3000))
        pieces = token_counts.split_safely(t, 50)
        assert len(pieces) > 20 and "".join(pieces) == t
        assert sum(token_counts.count_batch(pieces, path)) == token_counts.count_batch([t], path)[0]


# --- license scan ------------------------------------------------------------------------
def brute_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(k, lab) for p, lab in license_scan.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    return len(w), len(places), min(places, default=(None,))[0], max(places, default=(None,))[0], ",".join(sorted({x for _, x in places}))


def test_license_base(spark, odd, none):
    extra = [(10, "MIT License mit-license, MIT\nLicense"), (11, "apache license 2.0; GNU General Public License v3 or later"), (12, "submit license"), (13, "mit license " * 30_000), (14, "mit license, apache license. " * 2000 + "general public license")]
    for df in (docs(spark), odd, frame(spark, extra)):
        got = sorted((nz(r.doc_id), r.n_words, r.n_base, nz(r.first_word), nz(r.last_word), r.base_labels) for r in license_scan.scan_licenses(df).collect())
        want = []
        for r in df.collect():
            n, k, a, b, labels = brute_base(r.text)
            want.append((nz(r.doc_id), n, k, nz(a), nz(b), labels))
        assert got == sorted(want)
    assert license_scan.scan_licenses(none).count() == 0


def test_license_suppression(spark):
    rows = [(1, "Licensed under the Apache License, Version 2.0."), (2, "SPDX-License-Identifier: MIT"), (3, "GNU Lesser General Public License version 2.1 or any later version"), (4, "nothing here")]
    got = {r.doc_id: r for r in license_scan.scan_licenses(frame(spark, rows)).collect()}
    assert "apache-2.0" in got[1].labels and got[1].base_labels == "apache"
    assert got[2].labels == "mit" and got[2].base_labels == ""
    assert "lgpl-2.1+" in got[3].labels and "lgpl-2.1" not in got[3].labels.split(",")
    assert got[4].labels == "" and got[4].score == 0
    assert all(0 <= r.score <= 1 for r in got.values()) and len(license_scan.RULES) >= 300


def sample_text(items):
    """A random text that matches the parsed pattern."""
    out = ""
    for op, arg in items:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "BRANCH":
            out += sample_text(random.choice(arg[1]))
        elif op == "SUBPATTERN":
            out += sample_text(arg[3])
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(sample_text(arg[2]) for _ in range(random.randint(arg[0], min(arg[1], arg[0] + 2))))
        elif op == "IN":
            kind, value = arg[0]
            out += chr(value[0] if str(kind) == "RANGE" else value)
        else:
            assert op in ("ASSERT", "ASSERT_NOT")
    return out


def test_license_keywords_are_in_every_match():
    random.seed(10)
    for r in license_scan.RULES:
        for _ in range(30):
            assert r.keyword in sample_text(re._parser.parse(r.pattern)), r


def test_license_forms(spark):
    rows = [(1, "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express"), (2, "must display the following acknowledgement:"), (3, "must display the following acknowledgment:"), (4, "The software is provided as is.")]
    got = {r.doc_id: r.labels for r in license_scan.scan_licenses(frame(spark, rows)).collect()}
    assert got == {1: "disclaimer", 2: "bsd-4-clause", 3: "bsd-4-clause", 4: "disclaimer"}


# --- decontamination ---------------------------------------------------------------------
def test_decontamination(spark, odd, none):
    random.seed(5)
    vocab = ["".join(random.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    item = random.choices(vocab, k=40)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short")], "item_id long, text string")
    rows = []
    for k in range(40):
        body = random.choices(vocab, k=200)
        if k % 2:
            own = list(item)
            for p in random.sample(range(40), k // 8):
                own[p] = "changed"
            body[50:90] = own
        rows.append((k, " ".join(body)))
    rows.append((100, "ahead of it stands the phrase one that is too short at all"))
    got = {r.doc_id: r for r in decontaminate.contaminated(frame(spark, rows), bench).collect()}
    assert sorted(got) == list(range(1, 40, 2))
    assert all(r.item_id == 1 and 30 <= r.matched <= 40 - i // 8 and 50 <= r.start_word < 60 for i, r in got.items())
    left = decontaminate.drop_contaminated(frame(spark, rows), bench)
    assert sorted(r.doc_id for r in left.collect()) == [*range(0, 40, 2), 100] and set(EXTRA) <= set(left.columns)
    assert decontaminate.contaminated(odd, bench).count() == 0 and decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0


def best_segment(equal):
    """Best (score, -start, matched, length) of all runs, the shortest of equal ones."""
    runs = [(sum(equal[i:j]) - decontaminate.SUBSTITUTION * (j - i - sum(equal[i:j])), -i, i - j, sum(equal[i:j]), j - i) for i in range(len(equal)) for j in range(i + 1, len(equal) + 1)]
    score, start, _, matched, length = max(runs, default=(0, 0, 0, 0, 0))
    return score, -start, matched, length


def brute_leaks(rows, items):
    out = set()
    for doc_id, text in rows:
        d = [w for w in re.split(r"[\s!-/:-@\[-`{-~]+", (text or "").lower()) if w]
        for item_id, passage in items:
            w = [x for x in re.split(r"[\s!-/:-@\[-`{-~]+", (passage or "").lower()) if x]
            if len(w) < decontaminate.MIN_WORDS:
                continue
            masks = decontaminate.MASKS if len(w) >= 7 else ("1" * len(w),)
            best = None
            for diagonal in range(-len(w), len(d)):
                low, high = max(0, -diagonal), min(len(w), len(d) - diagonal)
                equal = [d[diagonal + k] == w[k] for k in range(low, high)]
                if any(all(equal[i + k] for k, c in enumerate(m) if c == "1") for m in masks for i in range(len(equal) - len(m) + 1)):
                    score, start, matched, length = best_segment(equal)
                    if score >= min(decontaminate.MIN_SCORE, len(w)):
                        best = max(best or (), (score, -(diagonal + low + start), matched, length, len(w)))
            if best:
                out.add((nz(doc_id), item_id, -best[1], *best[2:]))
    return out


def test_decontamination_against_all_diagonals(spark):
    random.seed(15)
    vocab = ["".join(random.choice("abcdefgh") for _ in range(3)) for _ in range(60)]
    items = [(k, " ".join(random.choices(vocab, k=n))) for k, n in enumerate((3, 4, 5, 6, 7, 8, 9, 12, 20, 30, 45))]
    rows = []
    for k in range(90):
        body = random.choices(vocab, k=random.choice([0, 3, 40, 60]))
        own = items[k % len(items)][1].split(" ")
        kind = k % 4
        if kind == 0:  # a quote of a part
            n = random.randint(1, len(own))
            at = random.randint(0, len(own) - n)
            own = own[at : at + n]
        elif kind == 1:  # an inserted word
            own.insert(random.randint(0, len(own)), "inserted")
        elif kind == 2:  # substituted words
            for p in random.sample(range(len(own)), len(own) // 5):
                own[p] = "other"
        at = random.randint(0, len(body))
        body[at:at] = own
        rows.append((k, " ".join(body)))
    rows += [(None, rows[5][1]), (5, "another row of this id"), (500, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(frame(spark, rows), bench)
    out = [(nz(r.doc_id), r.item_id, r.start_word, r.matched, r.overlap, r.item_words) for r in got.collect()]
    want = brute_leaks(rows, items)
    assert set(out) == want and len(out) == len(want) > 40
    keep = [(nz(r.doc_id), r.text) for r in decontaminate.drop_contaminated(frame(spark, rows), bench).collect()]
    bad = {(x[0]) for x in want}
    assert sorted(keep, key=str) == sorted([(nz(i), t) for i, t in rows if nz(i) not in bad or t == "another row of this id"], key=str)


def test_decontamination_on_tables(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    plain = lambda t: " ".join(re.sub(r"[^\w\s]", " ", t.lower()).split())
    items = {r.item_id: plain(r.text) for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs(spark).collect() for i, x in items.items() if x in plain(r.text)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark), bench).collect()}
    assert want and want <= got


# --- packing -----------------------------------------------------------------------------
def check_packing(rows, texts, window=2048):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_counts.tokenizer_path("word_bpe_49k.json"))
    ids = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t in texts]
    assert sum(r.length for r in rows) == sum(map(len, ids))
    known = collections.defaultdict(list)
    for (i, _), x in zip(texts, ids):
        known[i].append(x)
    for r in rows:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in known[r.doc_id])
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return len(bins) * window - sum(map(len, ids))


def test_packing(spark, odd, none):
    df = docs(spark)
    padding = check_packing(packing.pack_documents(df).collect(), [(r.doc_id, r.text) for r in df.collect()])
    assert padding < 2048 * df.rdd.getNumPartitions()
    check_packing(packing.pack_documents(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert packing.pack_documents(none).count() == 0
    row = packing.pack_documents(frame(spark, [(1, "a b")]), with_ids=True).head()
    assert zlib.crc32(np.array(row.ids, "<u4").tobytes()) == row.ids_crc32


def test_word_encoder_equals_library():
    random.seed(4)
    enc = packing.WordEncoder(token_counts.tokenizer_path("word_bpe_49k.json"))
    for _ in range(400):
        t = "".join(random.choice(["a", "B", "é", "É", "İ", "Σ", " ", "\n", "\t", "\u2028", "1", "!", "'s", "'", ",", "&&", "<|endoftext|>", "日"]) for _ in range(random.randint(0, 60)))
        assert enc.encode(t).tolist() == enc.tok.encode(t, add_special_tokens=False).ids


def test_sum_of_squares_rule():
    random.seed(2)
    p = packing.SumOfSquares(20)
    level = [0] * 21
    for _ in range(500):
        s = random.randint(1, 19)
        before = p.level.copy()
        p.place(s, None)
        best = None
        for h in range(20 - s + 1):
            if h and not before[h]:
                continue
            c = before.copy()
            if h:
                c[h] -= 1
            if h + s < 20:
                c[h + s] += 1
            cost = int((c[1:20] ** 2).sum())
            best = cost if best is None else min(best, cost)
        assert int((p.level[1:20] ** 2).sum()) == best
    assert level[0] == 0


# --- line dedup --------------------------------------------------------------------------
def edit(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        c = [i + 1]
        for j, y in enumerate(b):
            c.append(min(p[j + 1] + 1, c[j] + 1, p[j] + (x != y)))
        p = c
    return p[-1]


def brute_lines(rows):
    """The lines to remove, by edit similarity of all pairs alone: by characters or, from 16 words on, by words."""
    at = [(i, k, line.strip(" \t\r").lower().translate(str.maketrans("123456789", "0" * 9))) for i, t in rows for k, line in enumerate((t or "").split("\n"))]
    at = [x for x in at if x[2]]
    texts = sorted({x[2] for x in at})
    root = {u: u for u in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[:i]:
            near = lambda x, y: edit(x, y) <= int(max(len(x), len(y)) * (1 - line_dedup.MIN_SIMILARITY))
            wa, wb = a.split(" "), b.split(" ")
            if (min(len(wa), len(wb)) >= line_dedup.GRAM_WORDS and near(wa, wb)) or near(a, b):
                root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for i, k, t in at:
        groups[find(t)].append((i, k))
    return sorted((*x, *min(g)) for g in groups.values() for x in g if x != min(g))


def removed_lines(df):
    return sorted((r.doc_id, r.line, r.keep_doc_id, r.keep_line) for r in line_dedup.duplicate_lines(df).collect())


def test_line_groups_against_all_pairs(spark):
    random.seed(3)
    base = [" ".join("".join(random.choice("abcdefghij") for _ in range(5)) for _ in range(n)) for n in (1, 3, 12, 12, 20, 20, 30, 30)]
    rows = []
    for k in range(40):
        own = []
        for line in random.sample(base, 4):
            if random.random() < 0.5 and len(line) > 60:
                at = random.randrange(len(line))
                line = line[:at] + random.choice("xyz") + line[at + 1 :]
            own.append(line)
        rows.append((k, "\n".join(own)))
    got = removed_lines(frame(spark, rows))
    assert got == brute_lines(rows) and len(got) > 100


def test_line_recall_by_edit_similarity_alone(spark):
    """Shares of planted pairs found, by words of the line and kind of edit; nothing else is found."""
    random.seed(4)
    word = lambda: "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(random.randint(2, 9)))

    def letters(line, n):
        out = list(line)
        for at in random.sample([i for i, c in enumerate(line) if c != " "], n):
            out[at] = chr((ord(out[at]) - 96) % 26 + 97)
        return "".join(out)

    def words(line, n):
        out = line.split(" ")
        for at in random.sample(range(len(out)), n):
            out[at] = word()[: len(out[at])].ljust(len(out[at]), "q")
        return " ".join(out)

    cases = {}
    for n in (6, 12, 20, 45, 80, 150, 400):
        for name, change in (("one", lambda x: letters(x, 1)), ("three", lambda x: letters(x, 3)), ("words", lambda x: words(x, n // 10))):
            if name == "one" or n >= 20:
                cases[n, name] = [(x, change(x)) for x in (" ".join(word() for _ in range(n)) for _ in range(60))]
    rows, of = [], {}
    for case, pairs in cases.items():
        for pair in pairs:
            of[len(rows)] = case
            rows += [(len(rows) + k, t) for k, t in enumerate(pair)]
    got = collections.Counter()
    for r in line_dedup.duplicate_lines(frame(spark, rows)).collect():
        assert (r.doc_id, r.keep_doc_id) == (r.keep_doc_id + 1, r.keep_doc_id) and r.keep_doc_id in of
        got[of[r.keep_doc_id]] += 1
    share = {case: got[case] / 60 for case in cases}
    assert all(x >= (0.9 if name == "one" else 0.75) for (_, name), x in share.items()), share
    assert sum(x for (_, name), x in share.items() if name == "one") / 7 >= 0.95, share


def test_short_and_very_long_lines(spark):
    random.seed(6)
    long = " ".join("".join(random.choice("abcdefgh") for _ in range(6)) for _ in range(8000))
    far = " ".join("".join(random.choice("abcdefgh") for _ in range(6)) for _ in range(8000))
    rows = [(k, f"thanks\n{random.random()}\n}}") for k in range(20)] + [(100, long), (101, long.replace("ab", "b", 30)), (102, far), (103, "x" * 300_000), (104, "x" * 299_000 + "y")]
    got = removed_lines(frame(spark, rows))
    assert {(k, 0, 0, 0) for k in range(1, 20)} | {(101, 0, 100, 0)} <= set(got)
    assert all(r[0] not in (100, 102, 103) for r in got)


def test_template_lines_that_are_not_alike(spark):
    """A bucket of many lines that share words but are no copies costs no pairs and links nothing."""
    random.seed(8)
    word = lambda: "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    rows = [(k, "posted by the user in the part of the forum " + " ".join(word() for _ in range(12))) for k in range(3000)]
    assert removed_lines(frame(spark, rows)) == []


def test_line_dedup_odd(spark, odd, none):
    gone = line_dedup.duplicate_lines(odd)
    assert sorted((r.doc_id, r.line, r.keep_doc_id) for r in gone.collect()) == [(6, 0, 5)]
    left = line_dedup.drop_lines(odd, gone)
    assert left.columns == odd.columns
    assert sorted(nz(r.doc_id) for r in left.collect()) == sorted(nz(i) for i, _ in ODD if i != 6)
    assert line_dedup.duplicate_lines(none).count() == 0


def test_rows_that_repeat_an_id_lose_their_own_lines(spark):
    rows = [(1, "first line of text\nsecond line here"), (2, "first line of text"), (2, "quite another text stays"), (None, "second line here"), (None, "one more text of no id"), (3, None), (3, "")]
    df = frame(spark, rows)
    left = line_dedup.drop_lines(df, line_dedup.duplicate_lines(df))
    # Null ids rank first, so the second line stays there.
    assert sorted((nz(r.doc_id), r.text or "") for r in left.collect()) == [(-1, "one more text of no id"), (-1, "second line here"), (1, "first line of text"), (2, "quite another text stays"), (3, ""), (3, "")]


# --- media -------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 17, 64])
def test_avi_round_trip(n):
    for p in (os.urandom(64 * n), b"\0" * 64 * n, b"\xff\x00" * 32 * n, bytes(range(256)) * (n // 4 + 1)):
        data = media_avi.write_avi(p)
        back, frames, info = media_avi.read_avi(data)
        assert back == p and info["frames"] == len(frames)
    assert data[:4] == b"RIFF" and int.from_bytes(data[4:8], "little") == len(data) - 8


def test_avi_frame_by_a_plain_decoder():
    """One bit after the other, as the JPEG standard has it."""
    p = os.urandom(64 * 3)
    data = media_avi.write_avi(p)
    _, index = media_avi.parse_index(data)
    frame = data[index[0, 0] : index[0, 0] + index[0, 1]]
    scan = frame[frame.index(b"\xff\xda") + 10 : -2]
    out = []
    for segment in re.split(rb"\xff[\xd0-\xd7]", scan):
        bits = "".join(f"{b:08b}" for b in segment.replace(b"\xff\x00", b"\xff"))
        at, level = 0, 128
        for _ in range(64):
            size = int(bits[at : at + 4], 2)
            v = int(bits[at + 4 : at + 4 + size] or "0", 2)
            level += v if not size or bits[at + 4] == "1" else v - (1 << size) + 1
            assert bits[at + 4 + size] == "0"
            at += 5 + size
            out.append(level)
    assert bytes(out) == p


def foreign_frame(grey, rng, progressive=False):
    """A JPEG of blocks of 2x2 luma and two chroma components, with AC codes, tables of its own and restarts."""
    down, across = grey.shape
    segment = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2, "big") + b
    out = b"\xff\xd8" + segment(0xE0, b"other writer") + segment(0xDB, b"\x01" + bytes([4] * 64) + b"\x12" + (2).to_bytes(2, "big") * 64)
    out += segment(0xC2 if progressive else 0xC0, bytes([8]) + (down * 8).to_bytes(2, "big") + (across * 8).to_bytes(2, "big") + bytes([3, 1, 0x22, 1, 2, 0x11, 2, 3, 0x11, 2]))
    dc_values, ac_values = bytes(range(12)), bytes([0x00, 0x01, 0x12, 0xF0, 0x53])
    out += segment(0xC4, b"\x03" + bytes([0, 0, 0, 0, 12] + [0] * 11) + dc_values) + segment(0xC4, b"\x12" + bytes([0, 1, 1, 3] + [0] * 12) + ac_values)
    out += segment(0xDD, (2).to_bytes(2, "big")) + segment(0xDA, bytes([3, 1, 0x32, 2, 0x32, 3, 0x32, 0, 63, 0]))
    ac_code = dict(zip(ac_values, ("00", "010", "0110", "0111", "1000")))

    def number(v):
        n = abs(v).bit_length()
        return n, (f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else "")

    bits, level, scan = "", [0, 0, 0], b""
    order = [(r, c) for r in range(0, down, 2) for c in range(0, across, 2)]
    for m, (r, c) in enumerate(order):
        for i, value in [(0, int(grey[y, x])) for y in (r, r + 1) for x in (c, c + 1)] + [(1, 40), (2, 90)]:
            dc = (value - 128) * 2 if i == 0 else value
            n, body = number(dc - level[i])
            level[i] = dc
            bits += f"{n:05b}" + body
            for symbol in rng.sample([0x01, 0x12, 0xF0, 0x53], rng.randint(0, 3)):
                bits += ac_code[symbol] + "".join(rng.choice("01") for _ in range(symbol & 15))
            bits += ac_code[0]
        if m % 2 or m + 1 == len(order):
            bits += "1" * (-len(bits) % 8)
            scan += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
            scan += bytes([0xFF, 0xD0 + m // 2 % 8]) if m + 1 < len(order) else b""
            bits, level = "", [0, 0, 0]
    return out + scan + b"\xff\xd9"


def foreign_avi(frames):
    chunk = media_avi._chunk
    body, index, at = b"", b"", 4
    for f in frames:
        index += b"00dc" + (16).to_bytes(4, "little") + at.to_bytes(4, "little") + len(f).to_bytes(4, "little")
        body += chunk(b"00dc", f)
        at += 8 + len(f) + len(f) % 2
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", (40_000).to_bytes(4, "little") + bytes(12) + len(frames).to_bytes(4, "little") + bytes(36)))
    return chunk(b"RIFF", b"AVI " + head + chunk(b"LIST", b"movi" + body) + chunk(b"idx1", index))


def test_avi_of_another_writer(spark):
    rng = random.Random(4)
    np.random.seed(4)
    scenes = [np.random.randint(a, a + 60, (6, 10)) for a in (10, 180, 90)]
    greys = [scenes[k // 15] for k in range(45)]
    frames = [foreign_frame(g, rng) for g in greys]
    data = foreign_avi([*frames, b""])
    payload, got, info = media_avi.read_avi(data)
    assert payload == b"" and info["us"] == 40_000 and all((a == b).all() for a, b in zip(got, [*greys, greys[-1]]))
    rows = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(foreign_avi([])))], "doc_id long, media binary")
    assert [(r.doc_id, r.first_frame, r.n_frames, r.start_s) for r in media_avi.clip_rows(rows).orderBy("clip").collect()] == [(1, 0, 15, 0.0), (1, 15, 15, 0.6), (1, 30, 16, 1.2)]
    for bad in (foreign_frame(greys[0], rng, progressive=True), frames[0][:300], frames[0].replace(b"\xff\xc4", b"\xff\xe4"), b"no frame"):
        with pytest.raises(ValueError):
            media_avi.read_avi(foreign_avi([bad]))


def test_shots():
    diff = np.full(40, 0.02)
    diff[[10, 25]] = 0.6
    assert media_avi.find_shots(diff).tolist() == [11, 26]
    assert media_avi.find_shots(np.zeros(0)).tolist() == []


def test_media_digests(spark, odd, none):
    rows = media_avi.media_digests(odd).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        texts = [(t or "").encode() for i, t in ODD if i == r.doc_id]
        padded = [t + b"\0" * (max(64, -(-len(t) // 64) * 64) - len(t)) for t in texts]
        assert r.n_bytes in map(len, texts) and r.payload_sha256 in [hashlib.sha256(p).hexdigest() for p in padded]
        assert r.tail_crc32 in [zlib.crc32(p[-64:]) for p in padded]
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id in (5, 6)}) == 1
    assert media_avi.media_digests(none).count() == 0
    clips = media_avi.clip_rows(media_avi.store_texts(odd)).collect()
    assert all(r.end_s > r.start_s for r in clips) and {r.doc_id for r in clips} == {i for i, _ in ODD}


# --- quality -----------------------------------------------------------------------------
def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(0)
    counts = np.array([3, 1, 4])
    e, trans = rng.normal(size=8), rng.normal(size=(2, 2))
    good, pairs = quality_crf.forward_backward(e, counts, trans)
    want, at, total = np.zeros(8), 0, np.zeros((2, 2))
    for n in counts:
        z, part, pp = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            w = np.exp(sum(e[at + k] * y[k] for k in range(n)) + sum(trans[y[k], y[k + 1]] for k in range(n - 1)))
            z += w
            part += w * np.array(y)
            for k in range(n - 1):
                pp[y[k], y[k + 1]] += w
        want[at : at + n] = part / z
        total += pp / z
        at += n
    assert np.allclose(good, want) and np.allclose(pairs, total)


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality_crf.score_quality(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(out) > 40 and np.mean([r.predicted == r.quality for r in out]) > 0.95
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality_crf.score_quality(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert quality_crf.score_quality(none, labels).count() == 0
    assert {r.score for r in quality_crf.score_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_crf.keep_good(odd, labels.limit(0)).count() == len(ODD)


# --- n-gram join -------------------------------------------------------------------------
def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(sets):
        r = find(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return sorted((-1 if i is None else i, len(s), least[find(k)] if least[find(k)] is not None else -1) for k, (i, s) in enumerate(sets))


def test_ngram_join(spark, odd, none):
    random.seed(8)
    vocab = ["".join(random.choice("abcdef") for _ in range(4)) for _ in range(800)]
    rows = []
    for k in range(12):
        body = random.choices(vocab, k=random.randint(4, 150))
        for _ in range(12):
            own = list(body)
            for _ in range(random.randint(0, max(1, len(own) // 25))):
                own[random.randrange(len(own))] = random.choice(vocab)
            rows.append((len(rows), " ".join(own)))
    for df in (frame(spark, rows), odd, docs(spark).select("doc_id", "text")):
        got = sorted((nz(r.doc_id), r.n_shingles, nz(r.component_id)) for r in ngram_join.near_duplicates(df).collect())
        assert got == components([(r.doc_id, r.text) for r in df.collect()])
    assert ngram_join.near_duplicates(none).count() == 0
    kept = ngram_join.keep_one(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in components(rows)}) and set(EXTRA) <= set(kept.columns)


def test_keep_one_of_rows_that_repeat_an_id(spark, odd, none):
    text = " ".join(f"w{k}" for k in range(60))
    near = text.replace("w59", "other")
    rows = [(1, text), (1, "quite another text under the same id it stays"), (2, near), (2, near), (None, text), (None, "alone without any id but unique as a text"), (3, None), (3, None), (4, ""), (5, "copies of one row stand here twice"), (5, "copies of one row stand here twice"), (None, "no id at all and twice the same text"), (None, "no id at all and twice the same text")]
    got = sorted(((nz(r.doc_id), r.text or "") for r in ngram_join.keep_one(frame(spark, rows)).collect()))
    assert got == sorted([(1, text), (1, rows[1][1]), (-1, rows[5][1]), (3, ""), (3, ""), (4, ""), (5, rows[9][1]), (-1, rows[11][1])])
    assert ngram_join.keep_one(odd).columns == odd.columns and ngram_join.keep_one(odd).count() == len(ODD) - 2
    assert ngram_join.keep_one(none).count() == 0


def test_large_clusters_are_cut(spark):
    random.seed(9)
    vocab = ["".join(random.choice("abcdef") for _ in range(5)) for _ in range(2000)]
    body = random.choices(vocab, k=60)
    rows = []
    for k in range(90):
        own = list(body)
        for _ in range(random.randint(0, 3)):
            own[random.randrange(60)] = random.choice(vocab)
        rows.append((k, " ".join(own)))
    texts = frame(spark, rows, extra=False).withColumnRenamed("doc_id", "node")
    by_node = {}
    for k, t in rows:
        by_node[ngram_join._digest(ngram_join.shingle_sets([t])[0])[0]] = k
    nodes = spark.createDataFrame([(n, dict(rows)[k]) for n, k in by_node.items()], "node long, text string")
    sets = ngram_join.ordered_sets(nodes)
    small, large = ({(r.id, r.component_id) for r in ngram_join.link_sets(sets, b).collect()} for b in (8, 512))
    assert small == large and small and texts.count() == 90


def test_trie():
    random.seed(1)
    sets = [np.array(sorted(random.sample(range(30), random.randint(1, 12)))) for _ in range(60)]
    sets += sets[:5]
    found = {(k, int(p)) for k, hit in ngram_join.Trie.build(sets, list(range(65))).similar(sets) for p in hit}
    j = lambda a, b: 4 * len(np.intersect1d(a, b)) >= 3 * len(np.union1d(a, b))
    assert found == {(a, b) for a in range(65) for b in range(65) if j(sets[a], sets[b])}


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (7, 7), (200, 300), (300, 250)]
    out = {r.id: r.component_id for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[k] == 1 for k in range(1, 41)) and out[101] == 100 and out[250] == out[300] == out[200] == 200 and 7 in out


# --- substring dedup ---------------------------------------------------------------------
def test_substring_dedup(spark, odd, none):
    random.seed(6)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(6))
    sentence = lambda: " ".join(word() for _ in range(10)) + "."
    passage = " ".join(sentence() for _ in range(6))
    stock = sentence()
    rows = [(k, "\n".join([sentence(), f"{word()} {passage} {word()}" if k % 3 == 0 else sentence(), stock if k % 5 == 4 else sentence()])) for k in range(30)]
    df = frame(spark, rows)
    got = substring_dedup.duplicate_units(df).collect()
    assert {r.doc_id for r in got} == {k for k in range(1, 30) if k % 3 == 0 or k % 5 == 4 and k > 4}
    long = substring_dedup.duplicate_units(df, min_line_words=20).collect()
    assert {r.doc_id for r in long} == set(range(3, 30, 3)) and {r.keep_doc_id for r in long} == {0}
    texts = dict(rows)
    # Brute force: the units themselves, first places kept, runs of 20 words.
    first, units = {}, {}
    for k, t in rows:
        units[k] = substring_dedup.split_units(t)
        for n, (*_, norm) in enumerate(units[k]):
            first.setdefault(norm, (k, n))
    want = set()
    for k, own in units.items():
        run = []
        for n, (line, s, size, w, norm) in enumerate([*own, (0, 0, 0, 0, None)]):
            if norm is not None and first[norm] != (k, n):
                run.append((k, n, s, size, w))
                if all(first[x[4]] != (k, m) for m, x in enumerate(own) if x[0] == line):
                    want.add(run[-1])
            else:
                if sum(x[4] for x in run) >= substring_dedup.MIN_RUN_WORDS:
                    want |= set(run)
                run = []
    assert {(r.doc_id, r.unit, r.start, r.length, r.words) for r in got} == want
    assert all(" ".join(texts[r.doc_id][r.start : r.start + r.length].lower().split()) in passage + stock for r in got)
    assert [r.doc_id for r in substring_dedup.duplicate_units(odd).orderBy("doc_id").collect()] == [5, 6] and substring_dedup.duplicate_units(none).count() == 0
    nulls = [(None, "one line that repeats"), (None, "one line that repeats"), (None, "another one of them"), (3, "one line that repeats")]
    assert sorted(nz(r.doc_id) for r in substring_dedup.duplicate_units(frame(spark, nulls)).collect()) == [-1, 3]


def test_substring_dedup_of_passages_inside_sentences(spark):
    random.seed(7)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(6))
    words = lambda n: " ".join(word() for _ in range(n))
    rows, places = [], {}
    for k in range(40):
        # 60 words: the end of one sentence, a short one, the start of another.
        passage = f"{words(25)}. {words(8)}. {words(27)}" if k % 2 else words(60)
        for d in (2 * k, 2 * k + 1):
            head = words(20) + " "
            rows.append((d, f"{head}{passage} {words(20)}."))
            places[d] = (len(head), len(head) + len(passage))
    gone = collections.Counter()
    for r in substring_dedup.duplicate_units(frame(spark, rows)).collect():
        low, high = places[r.doc_id]
        assert r.doc_id % 2 and low <= r.start and r.start + r.length <= high + 1
        gone[r.doc_id] += r.length
    assert all(gone[d] * 2 >= places[d][1] - places[d][0] for d in range(1, 80, 2))


# --- PII ---------------------------------------------------------------------------------
def brute_pii(t):
    t = t or ""
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_pii_patterns():
    random.seed(2)
    for alphabet in ("aB@.-+1234 (),_%é\n0", "0123456789 -.+"):
        for _ in range(20_000):
            t = "".join(random.choice(alphabet) for _ in range(random.randint(1, 50)))
            assert pii.find_base(t) == brute_pii(t), t
    assert pii.find_base("1" * 200_000 + "." + "a" * 200_000 + "@" * 1000) == []
    for zeros, kept in ((5000, True), (5001, False)):
        t = "see 1.2.3." + "0" * 5000 + ("7" if kept else "7777")
        assert pii.find_base(t) == ([(4, len(t), 1)] if kept else [])


def test_pii_query(spark, odd, none):
    for df in (docs(spark), odd):
        rows = {(r.doc_id, r.base_sha256) for r in pii.find_pii(df).collect()}
        assert rows == {(r.doc_id, hashlib.sha256(pii.spans_text(brute_pii(r.text)).encode()).hexdigest()) for r in df.collect()}
    assert pii.find_pii(none).count() == 0


def test_disclosing_terms_against_a_recount(spark):
    random.seed(9)
    vocab = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 5))) for _ in range(150)] + ["ÄÖ", "İstanbul", "x" * 70]
    mails = [f"{random.choice(vocab[:20])}@h{k}.org" for k in range(12)] + ["10.0.0.1"]
    rows = []
    for k in range(120):
        lines = []
        for _ in range(random.randint(0, 4)):
            words = random.choices(vocab, k=random.choice([0, 3, 8, 150]))
            for _ in range(random.randint(0, 2)):
                k_mail = random.randrange(len(mails))
                words.insert(random.randrange(len(words) + 1), f"{mails[k_mail]} owner{k_mail}" if random.random() < 0.8 else mails[k_mail])
            lines.append(" ".join(words))
        rows.append((k, "\n".join(lines)))
    rows += [(500, None), (501, ""), (None, rows[3][1]), (502, rows[3][1])]
    pieces = []
    for _, t in rows:
        for line in (t or "").split("\n"):
            spans = brute_pii(line)
            terms = [(m.start(), m[0].lower()) for m in re.finditer(r"[^\W_]{3,}", line) if not any(a < m.end() and m.start() < b for a, b, _ in spans)]
            parts = [({x for _, x in terms[i : i + pii.PIECE_TERMS]}, set()) for i in range(0, max(1, len(terms)), pii.PIECE_TERMS)]
            for a, b, _ in spans:
                before = sum(s < a for s, _ in terms)
                parts[max(0, before - 1) // pii.PIECE_TERMS][1].add(line[a:b])
            pieces += parts
    n, want = len(pieces), {}
    for e in {e for _, es in pieces for e in es}:
        with_e = [ts for ts, es in pieces if e in es]
        ic = -math.log2(len(with_e) / n)
        for t in set().union(*with_e):
            p = sum(t in ts for ts, _ in pieces) / n
            pmi = math.log2((sum(t in ts for ts in with_e) + pii.SMOOTHING * p) / (len(with_e) + pii.SMOOTHING) / p)
            if ic > 0 and pmi >= pii.DISCLOSURE * ic:
                want[e, t] = (round(pmi, 9), round(ic, 9))
    got = {(r.entity, r.term): (round(r.pmi, 9), round(r.ic, 9)) for r in pii.disclosing_terms(frame(spark, rows)).collect()}
    assert got == want and len(want) >= len(mails)
    known = collections.defaultdict(set)
    for e, t in want:
        known[e].add(t)
    for limit in (100_000, 0):
        out = {(nz(r.doc_id), r.spans) for r in pii.find_pii(frame(spark, rows), broadcast_rows=limit).collect()}
        spans = set()
        for i, text in rows:
            base = brute_pii(text or "")
            own = set().union(*(known[text[a:b]] for a, b, _ in base)) if base else set()
            more = [(m.start(), m.end(), 4) for m in re.finditer(r"[^\W_]{3,}", text or "") if m[0].lower() in own and not any(a < m.end() and m.start() < b for a, b, _ in base)]
            spans.add((nz(i), pii.spans_text(sorted(base + more, key=lambda x: (x[0], x[2])))))
        assert out == spans


def test_pii_terms(spark):
    random.seed(3)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(6))
    rows = [(k, f"{word()} the secretname wrote to jo@x.example.org the {word()}") for k in range(6)]
    rows += [(100 + k, f"the {word()} the {word()}\nthe {word()}") for k in range(300)]
    for limit in (100_000, 0):  # one table for all workers, or a join
        out = {r.doc_id: r for r in pii.find_pii(frame(spark, rows), with_text=True, broadcast_rows=limit).collect()}
        assert all("[EMAIL]" in out[k].sanitized and "secretname" not in out[k].sanitized and " the " in out[k].sanitized for k in range(6))
        assert all(out[100 + k].spans == "" for k in range(300))
        assert all(r.n_email == (r.doc_id < 6) for r in out.values())


# --- registry and pipeline ---------------------------------------------------------------
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered(spark, name):
    out = queries.queries()[name](spark, SF)
    assert {"doc_id", "conv_id"} & set(out.columns) and out.count() > 0


def test_pipeline(spark):
    import corpus_pipeline as P

    table = docs(spark)
    columns = table.columns
    names = [n for n, _ in P.STAGES]
    assert names == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"] and P.ORACLE_SQL is None
    cur = table
    for name, stage in P.STAGES:
        out = stage(spark, cur, SF)
        if name == "packing":
            check_packing(out.collect(), [(r.doc_id, r.text) for r in cur.collect()])
            break
        assert out.columns == columns
        before, after = {r.doc_id: r.text for r in cur.collect()}, {r.doc_id: r.text for r in out.collect()}
        assert after.keys() <= before.keys()
        if name == "quality":
            score = {r.doc_id: r.predicted for r in quality_crf.score_quality(cur, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
            assert after.keys() == {k for k, v in score.items() if v}
        elif name == "near_duplicates":
            assert sorted(after) == sorted({c for _, _, c in components(list(before.items()))})
        elif name == "decontamination":
            items = [" ".join(re.sub(r"[^\w\s]", " ", r.text.lower()).split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            plain = lambda t: " ".join(re.sub(r"[^\w\s]", " ", t.lower()).split())
            assert not any(x in plain(t) for t in after.values() for x in items)
        else:
            gone = collections.defaultdict(set)
            for r in line_dedup.duplicate_lines(cur).collect():
                gone[r.doc_id].add(r.line)
            kept = {k: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[k]) for k, t in before.items()}
            assert after == {k: t for k, t in kept.items() if not gone[k] or t.strip()}
        cur = spark.createDataFrame(out.collect(), out.schema)
