"""Every operator on nulls, empty and very long texts, ties, repeated rows and empty tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.llm.fingerprints import edited_pairs
from tallyloom.llm.langid import language_id
from tallyloom.llm.licenses import license_scan
from tallyloom.llm.lmscore import score_documents
from tallyloom.llm.mixing import mix_sources, mixed_rows
from tallyloom.llm.neardup import first_of_class, near_duplicates
from tallyloom.llm.packing import pack_documents, sequences
from tallyloom.llm.quality import keep_good, quality_rules
from tallyloom.llm.queries import tokenizer_path
from tallyloom.llm.suffixdedup import dedup_passages, without_repeats
from tallyloom.llm.warc import warc_round_trip

rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)]


def prose(n, seed=0):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


LONG = prose(30_000, 9)
EDGES = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, LONG), (6, prose(80, 1)), (6, prose(80, 1)), (7, prose(80, 1)),
    (None, prose(80, 2)), (None, None), (8, "é" * 300), (9, "a" * 5000), (10, "日本語 " * 20), (11, "x\x00y   z"), (12, "<|endoftext|> it's"),
]

OPERATORS = {
    "quality": quality_rules,
    "keep_good": keep_good,
    "suffix": dedup_passages,
    "without_repeats": without_repeats,
    "lm": lambda d: score_documents(d, tokenizer_path("piece_bpe_32k.model")),
    "packing": lambda d: pack_documents(d, tokenizer_path("word_bpe_49k.json")),
    "mixing": mix_sources,
    "mixed_rows": mixed_rows,
    "licenses": license_scan,
    "fingerprints": edited_pairs,
    "near": near_duplicates,
    "first_of_class": first_of_class,
    "langid": language_id,
    "warc": lambda d: warc_round_trip(d, "doc_id", "source", "text"),
}
PER_ROW = {"quality", "suffix", "without_repeats", "lm", "mixing", "licenses", "fingerprints", "near", "langid", "warc"}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(docs, name):
    out = OPERATORS[name](docs([(i, t, (None if k % 3 else "en", None if k % 4 == 0 else f"s{k % 2}")) for k, (i, t) in enumerate(EDGES)])).collect()
    if name in PER_ROW:
        assert sorted((r[0] if name != "warc" else r["page_id"]) or -1 for r in out) == sorted(i or -1 for i, _ in EDGES)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty(docs, name):
    assert OPERATORS[name](docs([])).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_all_null(docs, name):
    out = OPERATORS[name](docs([(None, None), (None, None), (3, None)]))
    if name in PER_ROW:
        assert out.count() == 3
    elif name == "first_of_class":
        assert [r["doc_id"] for r in out.collect()] == [3]
    elif name == "keep_good" or name == "mixed_rows":
        assert out.count() == 0
    else:
        assert [r["length"] for r in out.collect()] == [1, 1, 1]


def test_suffix_values(docs):
    p = prose(30, 3)
    rows = {r["doc_id"]: r for r in dedup_passages(docs([(3, "aa " + p), (1, p + " bb"), (2, p[:49]), (4, p + p), (9, "q" * 200)])).collect()}
    assert rows[1]["spans"] == [] and rows[2]["spans"] == [] and rows[9]["spans"] == []
    assert [tuple(s) for s in rows[3]["spans"]] == [(3, 3 + len(p))] and bytes(rows[3]["kept"]) == b"aa "
    assert bytes(rows[4]["kept"]) == b""


def test_suffix_brute_force(docs):
    r = random.Random(2)
    parts = [prose(12, i) for i in range(8)]
    rows = [(i, " ".join(r.choice(parts)[r.randint(0, 30) :] for _ in range(r.randint(1, 6)))) for i in range(40)]
    first = {}
    for i, t in rows:
        b = t.encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for got in dedup_passages(docs(rows)).collect():
        b = rows[got["doc_id"]][1].encode()
        gone = {x for k in range(len(b) - 49) if first[b[k : k + 50]] < got["doc_id"] for x in range(k, k + 50)}
        assert bytes(got["kept"]) == bytes(c for k, c in enumerate(b) if k not in gone)


def test_quality_values(docs):
    good = " ".join(["the", "of", *WORDS[:60]])
    out = {r["doc_id"]: r for r in quality_rules(docs([(1, good), (2, "the cat sat " * 40), (3, good.replace(" ", " $ ")), (4, "dup\ndup\n\nx")])).collect()}
    assert out[1]["kept"] and not out[1]["base_failed"] and out[1]["n_repeat_words"] == 0
    assert out[2]["base_failed"] and out[2]["n_repeat_words"] == 120
    assert not out[3]["kept"] and "symbols_per_word" in out[3]["failed_rules"]
    assert out[4]["n_dup_lines"] == 1


def test_near_values(docs):
    base = prose(300, 4).split()
    near = base[:150] + ["changed"] + base[151:]
    rows = [(5, " ".join(base)), (2, " ".join(near)), (9, " ".join(base).upper()), (1, prose(300, 6)), (7, " ".join(base[:100] + WORDS[:200]))]
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs(rows)).collect()}
    assert got == {5: 2, 2: 2, 9: 2, 1: 1, 7: 7}
    assert sorted(r["doc_id"] for r in first_of_class(docs(rows + [(2, " ".join(near))])).collect()) == [1, 2, 7]


def test_packing_round_trip(docs, spark):
    path = tokenizer_path("word_bpe_49k.json")
    rows = [(i, prose(5 + 7 * i, i)) for i in range(60)] + [(99, LONG)]
    out = pack_documents(docs(rows), path, with_ids=True)
    seqs = {r["sequence_id"]: r["ids"] for r in sequences(out).collect()}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    pieces = {}
    for r in out.collect():
        assert seqs[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    for i, text in rows:
        assert [x for _, ids in sorted(pieces[i]) for x in ids] == [*t.encode(text, add_special_tokens=False).ids, 1]
    total = sum(map(len, seqs.values()))
    assert max(map(len, seqs.values())) <= 4096 and len(seqs) == -(-total // 4096)


def test_plan_is_best_fit_decreasing():
    from tallyloom.llm.packing import plan

    r = random.Random(3)
    for _ in range(20):
        lengths = sorted((r.randint(1, 50) for _ in range(200)), reverse=True)
        rooms = []
        for n in lengths:
            fit = min((x for x in rooms if x >= n), default=None)
            if fit is None:
                rooms.append(50 - n)
            else:
                rooms.remove(fit)
                rooms.append(fit - n)
        bins = {}
        for length, first, last, at, per, offset in plan({n: lengths.count(n) for n in set(lengths)}, 50):
            for k in range(last - first + 1):
                bins.setdefault(at + k // per, []).append((offset + length * (k % per), length))
        assert sorted(50 - sum(n for _, n in b) for b in bins.values()) == sorted(rooms)
        for b in bins.values():
            assert all(o == sum(n for p, n in b if p < o) for o, _ in b)


def test_mixing_values(docs):
    rows = [(i, prose(20 + i % 7, i), ("en", f"s{i % 3}")) for i in range(300)]
    out = mix_sources(docs(rows)).collect()
    again = mix_sources(docs(rows[::-1])).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in out) == sorted((r["doc_id"], r["taken"]) for r in again)
    for s in ("s0", "s1", "s2"):
        own = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 13 and all(r["taken"] <= 3 * r["size"] for r in own)
    assert mixed_rows(docs(rows)).count() == sum(r["copies"] for r in out)


def test_fingerprint_values(docs):
    rows = [(i, prose(60, i)) for i in range(30)]
    for r in edited_pairs(docs(rows)).collect():
        own, following = rows[r["doc_id"]][1], rows[(r["doc_id"] + 1) % 30][1]
        half = len(own) // 2
        assert r["edited"] == own[: len(own) - half] + following[:half]


def test_license_values(docs):
    text = "x y\nGNU General Public License, and the MIT License; MIT license. This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
    r = license_scan(docs([(1, text), (2, "cc by"), (3, "gnu general cc")])).orderBy("doc_id").collect()
    assert (r[0]["n_base"], r[0]["first_word"], r[0]["base_labels"]) == (4, 2, "gpl,mit") and "gpl-notice" in r[0]["labels"]
    assert (r[1]["n_base"], r[1]["labels"], r[1]["score"]) == (1, "cc-by", 1.0)
    assert (r[2]["n_base"], r[2]["first_word"], r[2]["labels"]) == (0, None, "")


def test_warc_values(spark):
    big = "<p>" + "a" * 200
    pages = spark.createDataFrame([(3, "http://www.b.com/x", big), (1, "https://b.com/x#t", big), (2, "http://a.com", "s"), (4, "http://a.com", "s"), (5, None, None)], "page_id long, url string, html string")
    out = {r["page_id"]: r for r in warc_round_trip(pages).collect()}
    assert (out[3]["record_type"], out[3]["refers_to"], out[1]["record_type"], out[4]["record_type"]) == ("revisit", 1, "response", "response")
    assert out[3]["payload_digest"] == hashlib.sha256(big.encode()).hexdigest() and out[5]["payload_bytes"] == 0
    assert out[3]["urlkey"] == out[1]["urlkey"] == "com,b)/x"


def test_loser_tree():
    from tallyloom.llm.warc import loser_tree_merge

    r = random.Random(1)
    for k in range(9):
        runs = [sorted(r.randint(0, 20) for _ in range(r.randint(0, 9))) for _ in range(k)]
        assert list(loser_tree_merge(runs, lambda x: x)) == sorted(x for run in runs for x in run)


def test_lattice_sums_all_segmentations():
    import numpy as np

    from tallyloom.llm.lmscore import Lattice

    pieces = [b" ", b"a", b"b", b" a", b"ab", b"aba", b" ab"]
    p = np.array([0.1, 0.2, 0.1, 0.2, 0.2, 0.1, 0.1])
    prob = dict(zip(pieces, p, strict=True))

    def total(w):
        return 1.0 if not w else sum(prob.get(w[:k], 0) * total(w[k:]) for k in range(1, len(w) + 1))

    lattice = Lattice(pieces, np.log(p))
    words = [b"a", b"ab", b"abab", b"abaabab"]
    raw = np.frombuffer(b"".join(words), np.uint8)
    size = np.array([len(w) for w in words])
    got = lattice.words(raw, np.cumsum(size) - size, size)
    assert np.exp(got) == pytest.approx([total(b" " + w) for w in words])
    assert np.exp(lattice.one(b" abaabab")) == pytest.approx(total(b" abaabab"))


def test_held_out_language(docs):
    r = random.Random(7)
    bag = {"xx": ["akoto", "belu", "onna", "tiri"], "yy": ["schwun", "grepf", "druck", "zwist"]}
    rows = [(i, " ".join(r.choice(bag[lang]) for _ in range(30)), (lang, None)) for i in range(80) for lang in [r.choice(["xx", "yy"])]]
    truth = {i: more[0] for i, _, more in rows}
    out = language_id(docs(rows)).collect()
    assert all(x["lang_pred"] == truth[x["doc_id"]] for x in out) and any(x["held_out"] for x in out)
    assert language_id(docs([(2, "12 !!", ("xx", None)), (1, "ab", (None, None))])).where(F.col("lang_pred") != "und").count() == 0


def test_passages_write_two_tables(docs, monkeypatch):
    """A third, of what groups ask about anchors, was written though it is read once."""
    from tallyloom.llm import suffixdedup

    tables, write = [], suffixdedup.written
    monkeypatch.setattr(suffixdedup, "written", lambda df: tables.append(1) or write(df))
    passage = "the same passage of more than fifty bytes, in two documents of three"
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in suffixdedup.dedup_passages(docs([(1, "a " + passage), (2, passage + " b"), (3, "c")])).collect()}
    assert got == {1: "a " + passage, 2: " b", 3: "c"}
    assert len(tables) == 2
