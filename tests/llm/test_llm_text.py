"""Operators on texts against plain readings, on a small table of odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

import samples
from tablescout.llm import licenses, minhash, packing, quality, secrets, substring, words
from tablescout.llm.tokens import Encoder, public_path


@pytest.fixture(scope="module")
def rows():
    return samples.odd_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return samples.documents(spark, rows).repartition(5).cache()


def test_words_are_hashed_as_words(monkeypatch):
    monkeypatch.setattr(words, "STRETCH", 64)
    texts = ["", None, "a b\ta", " lead", "tail ", "é é\x0bè", "x" * 300 + " y", samples.prose(9, 200)]
    found = {}
    for row, bounds, hashes, first, last in words.hashed_words(pa.array(texts)):
        for i in range(len(bounds) - 1):
            data = (texts[row + i] or "").encode()
            found[row + i] = [(data[a:b].decode(), h) for a, b, h in zip(
                first[bounds[i] : bounds[i + 1]], last[bounds[i] : bounds[i + 1]], hashes[bounds[i] : bounds[i + 1]])]
    assert [[w for w, _ in found.get(i, [])] for i in range(len(texts))] == [samples.words(t) for t in texts]
    by_word = defaultdict(set)
    for own in found.values():
        for word, value in own:
            by_word[word].add(int(value))
    assert all(len(v) == 1 for v in by_word.values())
    assert len({min(v) for v in by_word.values()}) == len(by_word)


def kept(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"], r["kept_sha256"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("bucket_rows", [substring.BUCKET_ROWS, 3])
def test_repeats(docs, rows, bucket_rows):
    """Also with so small buckets that every common minimiser is dealt over several."""
    expected = [(i, n, gone, text, hashlib.sha256(text.encode()).hexdigest()) for i, n, gone, text in samples.without_repeats(rows)]
    assert kept(substring.drop_repeats(docs, bucket_rows=bucket_rows)) == sorted(expected, key=repr)


def test_repeats_in_dense_text(spark, monkeypatch):
    """Few different words: many windows of one minimiser, overlaps inside documents, small buffers."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 120))), None) for i in range(60)]
    expected = sorted(((i, n, gone, text) for i, n, gone, text in samples.without_repeats(rows, 8)), key=repr)
    found = substring.drop_repeats(samples.documents(spark, rows), window=8, gram=3, bucket_rows=50)
    assert [r[:4] for r in kept(found)] == expected


@pytest.mark.parametrize("bucket_rows", [substring.BUCKET_ROWS, 3])
def test_repeats_of_documents_with_one_id(spark, bucket_rows):
    """What repeats inside one NULL-id text stays in another, and of a passage both hold at one place one copy goes."""
    shared, twice = samples.prose(400, 40), samples.prose(401, 60)
    a = " ".join([shared, samples.prose(402, 60), twice, twice])
    b = " ".join([shared, samples.prose(403, 260)])
    for i in (None, 9):
        found = {r["n_words"]: r for r in substring.drop_repeats(
            samples.documents(spark, [(i, a, "a"), (i, b, "a")]), bucket_rows=bucket_rows).collect()}
        gone = found[220]["n_removed"], found[300]["n_removed"]
        assert gone in ((60, 40), (100, 0))
        assert found[300]["kept_text"] == " ".join(samples.words(b)[gone[1] :])


def test_later_windows_do_not_trust_digests(monkeypatch):
    monkeypatch.setattr(substring, "_digests", lambda rows: (np.zeros(len(rows), np.uint64),) * 2)
    grams = np.array([[1, 2], [3, 4], [1, 2], [3, 4], [5, 6]], dtype=np.uint64)
    later, *_ = substring.later_windows(np.zeros(5, np.int64), np.array([4, 1, 2, 1, 0]), np.array([0, 5, 0, 2, 0]), grams)
    assert later.tolist() == [True, True, False, False, False]


def test_near_duplicates(docs, rows):
    expected = samples.classes(rows)
    low = -(2**63)
    found = sorted(((low if r["doc_id"] is None else r["doc_id"], low if r["class_id"] is None else r["class_id"])
                    for r in minhash.near_duplicates(docs).collect()))
    assert found == sorted((low if i is None else i, expected[low if i is None else i]) for i, _, _ in rows)
    assert expected[8] == 6 and expected[9] == 9


def test_near_duplicates_in_a_crowded_bucket(spark):
    """A family of edited copies, compared in blocks of three."""
    base = samples.prose(20, 150)
    rng = random.Random(1)
    rows = [(0, base, None)]
    for i in range(1, 40):
        own = base.split(" ")
        for at in rng.sample(range(len(own)), rng.randint(1, 6)):
            own[at] = f"w{rng.random()}"
        rows.append((i, " ".join(own), None))
    found = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(samples.documents(spark, rows), block=3).collect()}
    assert found == samples.classes(rows)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])
    found = minhash.signatures(np.concatenate([np.sort(a), np.sort(b), a[:2]]), np.repeat([0, 1, 2], [400, 400, 2]), 3, 2000)
    assert np.isfinite(found).all()
    assert abs((found[0] == found[1]).mean() - 300 / 500) < 0.05
    assert (found[2] == found[0]).mean() < 0.02


def test_one_of_each_class_stays(docs, rows):
    expected = samples.classes(rows)
    found = minhash.keep_one(docs)
    assert found.columns == docs.columns
    low = -(2**63)
    assert sorted(low if r["doc_id"] is None else r["doc_id"] for r in found.collect()) == sorted(i for i, c in expected.items() if i == c)


def test_signatures_exclude_no_more_than_the_bands_lose():
    least = minhash.least_agreement(minhash.BANDS, minhash.BAND_ROWS, minhash.THRESHOLD)
    agrees = np.random.default_rng(8).binomial(96, 0.8, 400_000)
    assert least == 58 and (agrees < least).sum() <= 8  # 1.2 expected; 281 with the 64 of before


def clashing_ids():
    """Three NULL ids and one id on two texts; the copies of each text have plain ids."""
    texts = [samples.prose(300 + i, 80) for i in range(5)]
    rows = [(i, t, "a") for i, t in zip((None, None, None, 50, 50), texts)]
    return texts, rows + [(60 + i, t, "a") for i, t in enumerate(texts)] + [(70, samples.edited(texts[0], 70), "a"), (None, "", "a"), (None, None, "a")]


def test_documents_of_one_id_are_told_apart(spark):
    texts, rows = clashing_ids()
    docs = samples.documents(spark, rows).repartition(3)
    found = defaultdict(set)
    for r in minhash.near_duplicates(docs).collect():
        found[(r["class_id"], r["class_mark"])].add(r["doc_id"])
    assert sorted(map(sorted, ([-1 if i is None else i for i in ids] for ids in found.values()))) == [
        [-1], [-1], [-1, 60, 70], [-1, 61], [-1, 62], [50, 63], [50, 64]]
    kept_ = minhash.keep_one(docs).collect()
    assert sorted(((r["doc_id"] or 0, r["text"] or "") for r in kept_)) == sorted(((i or 0, t or "") for i, t, _ in rows if i in (None, 50)))


def test_encoder_equals_the_tokenizer():
    rng = random.Random(3)
    coder = Encoder(public_path())
    assert coder._words is not None
    texts = ["", " a", "a ", "a\n\nb", "a b   c　", "x <|endoftext|> y", "it's we'll 12!! 日本", "a\x1cb c\x85d", "a\r\nb"]
    texts += ["".join(rng.choice(" \n\t'abs1!é   d") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts += [t or "" for _, t, _ in samples.odd_rows()]
    texts += [" ".join(rng.choice(["don't", 'it.', '3.5,', '“q”', 'x—y', "'s", 'Wort', '日本']) for _ in range(30)) for _ in range(50)]
    assert [x.tobytes() for x in coder.encode(texts)] == coder._whole(texts)
    assert [x.tolist() for x in coder.encode(pa.array([None, 'a']))] == [[], coder.encode(['a'])[0].tolist()]


@pytest.mark.parametrize("window,shard", [(1024, 512), (64, 7)])
def test_packing_is_an_exact_round_trip(docs, rows, window, shard):
    coder = Encoder(public_path())
    pieces = packing.pack(docs, window=window, shard=shard).collect()
    checks = {(r["doc_id"], r["start"], r["sequence_id"], r["offset"]): r["ids_crc32"] for r in packing.digest(packing.pack(docs, window=window, shard=shard)).collect()}
    texts, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] > 0
        assert checks[p["doc_id"], p["start"], p["sequence_id"], p["offset"]] == zlib.crc32(p["ids"])
        sequences[p["sequence_id"]].append(p)
        texts[p["doc_id"]].append(p)
    padding = 0
    for own in sequences.values():
        own.sort(key=lambda p: p["offset"])
        ends = np.cumsum([p["length"] for p in own])
        assert [p["offset"] for p in own] == [0, *ends[:-1]] and ends[-1] <= window
        padding += 0 if ends[-1] & (ends[-1] - 1) == 0 else window - ends[-1]
    assert padding == 0
    expected = defaultdict(list)
    for i, text, _ in rows:
        expected[i].append(coder._whole([text or ""])[0] + bytes(4))
    for i, own in expected.items():
        if len(own) == 1:  # rows that share an identifier cannot be told apart here
            assert b"".join(bytes(p["ids"]) for p in sorted(texts[i], key=lambda p: p["start"])) == own[0]
        assert sum(p["length"] for p in texts[i]) * 4 == sum(map(len, own))


def test_bm25_ranks_like_the_formula():
    rng = np.random.default_rng(1)
    passages = [rng.integers(0, 30, rng.integers(1, 40)).astype(np.uint16) for _ in range(20)]
    idf, mean = rng.random(30), 17.0
    index = packing.Shard(passages, idf, mean)
    for seed in range(20):
        expected = [sum(idf[t] * (tf := (p == t).sum()) * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(p) / mean))
                        for t in set(passages[seed].tolist()) if t in p) for p in passages]
        assert np.allclose(index.scores(seed), expected)


def test_quality_features(docs, rows):
    found = sorted((tuple(r) for r in quality.digest(quality.judge(docs)).drop("kept", "probability").collect()), key=repr)
    expected = []
    for i, text, _ in rows:
        text = text or ""
        own = samples.words(text)
        windows = [tuple(own[k : k + 3]) for k in range(len(own) - 2)]
        covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)} if len(own) < 5000 else set()
        lines = [x for x in text.split("\n") if samples.words(x)]
        expected.append((i, len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
                         len(covered), len(own) < 50 or 100 * len(covered) > 50 * len(own)))
    assert found == sorted(expected, key=repr)


def test_quality_verdicts(spark):
    """Junk of several kinds goes, prose stays, also where one rule alone objects."""
    good = [(i, samples.prose(i, 120), None) for i in range(60)]
    shouting = [(100 + i, " ".join(w.upper() + "!!" for w in samples.words(samples.prose(300 + i, 30)) * 2), None) for i in range(6)]
    symbols = [(200 + i, " ".join(w + "###" for w in samples.words(samples.prose(400 + i, 90))), None) for i in range(6)]
    found = {r["doc_id"]: r["kept"] for r in quality.judge(samples.documents(spark, good + shouting + symbols)).select(
        samples_id("row"), "kept").collect()}
    assert all(found[i] for i in range(60)) and not any(found[i] for i in found if i >= 100)


def samples_id(name):
    from pyspark.sql import functions as F

    return F.col(name).alias("doc_id")


def test_quality_keeps_columns(docs):
    found = quality.keep_good(docs)
    assert found.columns == docs.columns
    assert {r["doc_id"] for r in found.collect()} >= {6, 7, None}


SECRETS = [
    (1, None, None), (2, "", None), (3, 'password = "hunter22" x', None), (4, "token=abc token = token = abcdef secret:=zzzzzz", None),
    (5, "AKIA" + "Z" * 15 + " AKIA" + "Q" * 16 + "é", None), (6, "\U0001F600 " + "deadbeef" * 3 + " " + "0" * 23, None),
    (7, "API_KEY: 'abcdef0123456789abcdef0123'", None), (8, "-----BEGIN RSA PRIVATE KEY-----", None), (None, "apikey=123456", None),
    (9, 'password = "hunter22" x', None), (9, 'password = "hunter22" x', None), (10, "paſsword=abcdefg Key toKen=abcdef", None),
]


def base_spans(text):
    kinds = (("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
             ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))
    spans = [(m.start(), k, m.end(), kind) for k, (kind, pattern, group, least) in enumerate(kinds)
             for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return [(kind, a, b) for a, _, b, kind in sorted(spans)]


def test_secrets(spark, docs, rows):
    for df, own in ((samples.documents(spark, SECRETS), SECRETS), (docs, rows)):
        found = sorted(((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"])
                        for r in secrets.digest(secrets.find_secrets(df)).collect()), key=repr)
        expected = []
        for i, text, _ in own:
            spans = base_spans(text)
            counts = [sum(s[0] == kind for s in spans) for kind in ("assign", "access", "hex")]
            expected.append((i, *counts, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
        assert found == sorted(expected, key=repr)


def test_ledger_scans_only_what_is_new(spark):
    old = samples.documents(spark, SECRETS[:6])
    first = secrets.scan(old)
    texts = {t or "" for _, t, _ in SECRETS[:6]}
    assert first.count() == len(texts) * len(secrets.RULES)
    everything = samples.documents(spark, SECRETS)
    new = {t or "" for _, t, _ in SECRETS} - texts
    changed = (secrets.Rule("hex", r"[0-9a-f]{26,}", version=2), *(r for r in secrets.RULES if r.name != "hex"))
    second = secrets.scan(everything, first, changed)
    assert second.groupBy("rule").count().where("rule = 'hex'").first()["count"] == len(texts | new)
    assert second.count() == len(new) * len(changed) + len(texts)
    assert secrets.scan(everything, first.unionByName(second), changed).isEmpty()
    direct = secrets.find_secrets(everything, rules=changed).collect()
    resumed = secrets.find_secrets(everything, first, changed).collect()
    assert sorted(map(repr, direct)) == sorted(map(repr, resumed))


def test_runs_with_a_ledger_equal_one_run(spark):
    everything = samples.documents(spark, SECRETS)
    ledger = None
    for part in (SECRETS[3:5], SECRETS[:2] + SECRETS[9:], SECRETS[3:8]):
        ledger = secrets.extend(samples.documents(spark, part), ledger)
    assert ledger.groupBy("blob", "rule", "version").count().where("count > 1").isEmpty()
    again = secrets.digest(secrets.find_secrets(everything, ledger)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, secrets.digest(secrets.find_secrets(everything)).collect()))


PLANTED = [
    ("private_key", "-----BEGIN PRIVATE KEY-----"), ("private_key", "-----BEGIN OPENSSH PRIVATE KEY-----"),
    ("github", "ghp_" + "aB3" * 12), ("github", "ghs_" + "Z" * 40), ("slack", "xoxb-1234567890-ab"),
    ("web_token", "eyJhbGciOiJI.eyJzdWIiOiIx.c2ln-_"), ("url_login", "https://user:pa55@"), ("url_login", "ftp://a:b@"),
]
HARMLESS = ["-----BEGIN PUBLIC KEY-----", "ghp_" + "Q" * 35, "ghx_" + "Q" * 40, "xoxb-123456789", "eyJhbGc.eyJzdWIiOiIx.x", "https://user@host/x", "a:b@c"]


def test_added_kinds_stand_where_they_were_planted(spark):
    own, expected = [], {}
    for k, (kind, secret) in enumerate(PLANTED):
        before = "é\U0001F600 " * k
        own.append((k, f"{before}{secret} {samples.prose(k, 20)} {secret}", None))
        ends = (len(before) + len(secret), len(own[-1][1]))
        expected[k] = ",".join(f"{kind}:{end - len(secret)}:{end}" for end in ends)
    own += [(100 + k, f"x {text} y", None) for k, text in enumerate(HARMLESS)]
    found = {r["doc_id"]: r["spans"] for r in secrets.digest(secrets.find_secrets(samples.documents(spark, own))).collect()}
    assert found == expected | {100 + k: "" for k in range(len(HARMLESS))}


def test_redaction(spark):
    df = samples.documents(spark, SECRETS)
    found = secrets.redact(df)
    assert found.columns == df.columns
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert by_id[3]["text"] == '[SECRET]" x' and by_id[3]["n_chars"] == len('[SECRET]" x')
    assert by_id[1]["text"] is None and by_id[2]["text"] == ""
    assert by_id[6]["text"] == "\U0001F600 [SECRET] " + "0" * 23
    assert by_id[7]["text"] == "[SECRET]'" and by_id[None]["text"] == "[SECRET]"


NOTICES = [
    (1, None, None), (2, "", None), (3, "x MIT License mit-license MIT LICENSE", None), (4, "Licensed under CC BY-NC 4.0.", None),
    (5, "This work is licensed under the GNU General Public License, version 3", None), (None, "Apache License", None),
    (6, "general public public license", None), (7, samples.prose(1, 50) + "\nPermission is hereby granted, free of charge, to any person "
     "obtaining a copy of this software and associated documentation files (the", None),
    (8, "hereby granted free of charge", None), (9, "mit license " * 3, None), (9, "mit license " * 3, None),
]


def test_licenses(spark, docs, rows):
    for df, own in ((samples.documents(spark, NOTICES), NOTICES), (docs, rows)):
        found = licenses.scan_licenses(df).collect()
        expected = []
        for i, text, _ in own:
            words_ = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
            places = [(k, label) for phrase, label in licenses.PHRASES for k in range(len(words_))
                      if words_[k : k + len(phrase.split())] == phrase.split()]
            starts = [k for k, _ in places]
            expected.append((i, len(words_), len(places), min(starts, default=None), max(starts, default=None),
                             ",".join(sorted({label for _, label in places}))))
        assert sorted((tuple(r)[:6] for r in found), key=repr) == sorted(expected, key=repr)
        assert all(0.0 <= r["score"] <= 1.0 and set(r["base_labels"].split(",")) <= set(r["labels"].split(",") + [""]) for r in found)


def test_license_templates(spark):
    found = {r["doc_id"]: r for r in licenses.scan_licenses(samples.documents(spark, NOTICES)).collect()}
    assert found[4]["labels"] == "cc-by-nc" and found[4]["score"] == 1.0
    assert found[7]["labels"] == "mit" and found[7]["matches"][0]["start"] == 50 and found[7]["score"] > 0.8
    assert found[8]["labels"] == ""
    assert found[6]["labels"] == "" and found[2]["score"] == 0.0


CHANGED = [
    # A word inserted, a word missing, both, an identifier line, a name inserted, other licences' words in between.
    (1, "one Redistribution and use in source and binary forms, with or without modification, are hereby permitted provided that the following "
     "conditions are met", None),
    (2, "one two Permission hereby granted, free of charge, to any person obtaining a copy of this software and documentation files", None),
    (3, "you may redistribute it and or even modify it under the terms of version 2 of the GNU General Public License", None),
    (4, "# SPDX-License-Identifier: MPL-2.0", None), (5, "SPDX-License-Identifier: BSD-3-Clause OR Apache-2.0", None),
    (6, "binary forms source permitted modification redistribution conditions unencumbered mozilla noninfringement", None),
    (7, "provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness "
     "for a particular purpose and noninfringement", None),
    (8, "are met Licensed under CC BY NC 4.0 Licensed under CC BY NC 4.0 this work", None),
    (9, " ".join(["redistribution", "a b c d e f", "use in source and binary forms with or without modification are permitted"]), None),
]


def chain(notice, weights, words_, start, gap):
    """The heaviest rising chain of equal words at shifts ``start`` to ``start + gap``, pair by pair."""
    best = {}
    for q, word in enumerate(notice):
        for p in range(max(start + q, 0), min(start + q + gap + 1, len(words_))):
            if words_[p] == word:
                best[q, p] = weights[word] + max((v for (a, b), v in best.items() if a < q and b < p), default=0.0)
    return max(best.values(), default=0.0) / sum(weights[w] for w in notice)


def test_license_starts_are_those_of_all_places(spark):
    own = [(k, text, None) for k, (_, text, _) in enumerate(NOTICES + CHANGED)]
    texts = [re.findall(r"[a-z0-9]+", (t or "").lower()) for _, t, _ in own]
    vocabulary = {w for t in licenses.TEMPLATES for w in re.findall(r"[a-z0-9]+", t.text.lower())}
    holders = {w: sum(w in t for t in texts) for w in vocabulary}
    weights = {w: math.log1p((len(own) - n + 0.5) / (n + 0.5)) for w, n in holders.items()}
    found = {r["doc_id"]: r for r in licenses.scan_licenses(samples.documents(spark, own)).collect()}
    for (k, text, _), words_ in zip(own, texts):
        expected, top = set(), 0.0
        for t in licenses.TEMPLATES:
            notice = re.findall(r"[a-z0-9]+", t.text.lower())
            for start in range(-len(notice) - licenses.GAP, len(words_)):
                score = chain(notice, weights, words_, start, licenses.GAP)
                stretch = f" {' '.join(words_[max(start, 0) : max(start + len(notice) + licenses.GAP, 0)])} "
                if score >= licenses.THRESHOLD - 1e-9 and all(f" {p} " in stretch for p in t.mandatory):
                    expected.add(t.label)
                    top = max(top, score)
        row = found[k]
        assert {m["label"] for m in row["matches"]} == expected, text
        assert not expected or row["score"] >= top - 1e-9


def test_changed_notices(spark):
    found = {r["doc_id"]: r for r in licenses.scan_licenses(samples.documents(spark, CHANGED)).collect()}
    assert found[1]["labels"] == "bsd" and [m["start"] for m in found[1]["matches"]] == [1]
    assert found[2]["labels"] == "mit" and found[3]["labels"] == "gpl"
    assert found[4]["labels"] == "mpl" and found[5]["labels"] == "bsd"
    assert found[6]["labels"] == "" and found[7]["labels"] == "mit"
    assert [m["start"] for m in found[8]["matches"] if m["label"] == "cc-by-nc"] == [2, 9]
    assert found[9]["labels"] == ""
